"""Workbooks (zipped XML) as a table of cells: values, texts, formulas with their cached values, font colours, merged ranges."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CELLS = "path string, sheet string, row int, col int, text string, value double, formula string, rgb string"
_MERGED = "path string, sheet string, r0 int, c0 int, r1 int, c1 int"
_N = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REF = re.compile(r"\$?([A-Z]+)\$?(\d+)")


def place(ref: str) -> tuple[int, int]:
    letters, row = _REF.match(ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(row), col


def _open(content: bytes):
    """Visible sheets with their XML, the shared strings and the font colour of each style."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    names = set(archive.namelist())

    def xml(name: str):
        return ElementTree.fromstring(archive.read(name)) if name in names else None

    strings = ["".join(t.text or "" for t in si.iter(f"{_N}t")) for si in (xml("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in names else ())]
    colours: list[str | None] = []
    styles = xml("xl/styles.xml")
    if styles is not None:
        fonts = [next((c.get("rgb") for c in font.iter(f"{_N}color")), None) for font in styles.find(f"{_N}fonts") or ()]
        for xf in styles.find(f"{_N}cellXfs") or ():
            i = int(xf.get("fontId") or 0)
            rgb = fonts[i] if i < len(fonts) else None
            colours.append(rgb[-6:] if rgb else None)
    targets = {r.get("Id"): r.get("Target") for r in (xml("xl/_rels/workbook.xml.rels") or ())}
    book = xml("xl/workbook.xml")
    for sheet in book.find(f"{_N}sheets"):
        if sheet.get("state") not in ("hidden", "veryHidden"):
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            yield sheet.get("name"), xml(target if target.startswith("xl/") else f"xl/{target}"), strings, colours


def _cells_of(path: str, content: bytes):
    for name, root, strings, colours in _open(content):
        for c in root.iter(f"{_N}c"):
            row, col = place(c.get("r"))
            kind, v, f = c.get("t"), c.find(f"{_N}v"), c.find(f"{_N}f")
            raw = v.text if v is not None else None
            text = value = None
            if kind == "s" and raw is not None:
                text = strings[int(raw)]
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{_N}t"))
            elif kind in ("str", "e", "d"):
                text = raw
            elif raw is not None:
                value = float(raw)
            style = int(c.get("s") or 0)
            yield (path, name, row, col, text, value, f"={f.text}" if f is not None and f.text else None, colours[style] if style < len(colours) else None)


def _merged_of(path: str, content: bytes):
    for name, root, _, _ in _open(content):
        for m in root.iter(f"{_N}mergeCell"):
            a, _, b = m.get("ref").partition(":")
            (r0, c0), (r1, c1) = place(a), place(b or a)
            yield (path, name, r0, c0, r1, c1)


def _read(files: DataFrame, schema: str, make) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for r in make(path, content)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, schema)


def cells(files: DataFrame) -> DataFrame:
    return _read(files, _CELLS, _cells_of)


def merged(files: DataFrame) -> DataFrame:
    return _read(files, _MERGED, _merged_of)


def expand_merged(cells_: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds the text of a merged range to every cell that it covers."""
    covered = ranges.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    source = cells_.select("path", "sheet", F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("text").alias("span_text"))
    spread = covered.join(source, ["path", "sheet", "r0", "c0"]).select("path", "sheet", "row", "col", "span_text")
    return cells_.join(spread, ["path", "sheet", "row", "col"], "full_outer").withColumn("text", F.coalesce("text", "span_text")).drop("span_text")


def is_filing(cells_: DataFrame) -> DataFrame:
    """path, filing: a sheet's first column opens with a statement's title and no sheet is called model."""
    title = (F.col("col") == 1) & F.col("text").rlike(r"(?i)\bstatements?\s+of\b|balance\s+sheet|income\s+statement")
    return cells_.groupBy("path").agg((F.bool_or(F.coalesce(title, F.lit(False))) & ~F.bool_or(F.lower(F.trim("sheet")) == "model")).alias("filing"))


def value_columns(cells_: DataFrame, least: int = 2) -> DataFrame:
    """path, sheet, col: columns with at least two figures that are not years; columns headed Note are none."""
    year = F.col("value").between(1990, 2100) & (F.col("value") == F.floor("value"))
    per = cells_.groupBy("path", "sheet", "col").agg(F.count_if(F.col("value").isNotNull() & ~year).alias("n"), F.coalesce(F.bool_or(F.lower(F.trim("text")).rlike("^notes?$")), F.lit(False)).alias("note"))
    return per.where((F.col("n") >= least) & ~F.col("note")).select("path", "sheet", "col")


def needed_cells(cells_: DataFrame, wanted: DataFrame) -> DataFrame:
    """One semi-join for all points that a run will read: (sheet, row, col)."""
    return cells_.join(F.broadcast(wanted), ["sheet", "row", "col"], "left_semi")


def shown(value: Column, formula: Column) -> Column:
    """A cell's figure: its cached value, or that of typed arithmetic."""
    from ..functions.formula import literal_value

    return F.coalesce(value, literal_value(formula))


def header_parts(cells_: DataFrame, first_data_row: int) -> DataFrame:
    """path, sheet, col, header: the distinct stacked texts above a column's figures, in order."""
    above = cells_.where((F.col("row") < first_data_row) & F.col("text").isNotNull())
    parts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]))
    return above.groupBy("path", "sheet", "col").agg(F.array_join(parts, " ").alias("header"))


def wrapped_captions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, row, caption, has_values): a caption that begins in lower case goes on from the heading before it in its sheet."""
    w = Window.partitionBy(*keys).orderBy("row")
    goes_on = F.col("caption").rlike("^[a-z]") & ~F.lag("has_values").over(w)
    return rows.withColumn("caption", F.when(goes_on, F.concat_ws(" ", F.lag("caption").over(w), "caption")).otherwise(F.col("caption"))).where("has_values")


def row_predicates(label: Column, value: Column) -> tuple[Column, Column]:
    """Whether a figure is a year, and the scope that a row's label opens."""
    scope = F.when(label.rlike("(?i)consolidated"), "consolidated").when(label.rlike("(?i)standalone|separate"), "separate")
    return value.between(1990, 2100) & (value == F.floor(value)), scope


# --- workbooks that don't open ----------------------------------------------------------------------------

#: What print titles may say: rows or columns of a sheet, one or two such ranges.
_TITLES = re.compile(r"(?:(?:'(?:[^']|'')*'|[^'!,]+)!)?\$?(?:[A-Z]{1,3}:\$?[A-Z]{1,3}|\d+:\$?\d+)")
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_BARE = re.compile(r"&(?!(?:#\d+|#x[0-9A-Fa-f]+|amp|lt|gt|quot|apos);)")
_DEFINED = re.compile(r"<definedName\b[^>]*\bname=\"_xlnm\.Print_Titles\"[^>]*>(.*?)</definedName>", re.DOTALL)


def _readable_titles(value: str) -> bool:
    return all(_TITLES.fullmatch(part.strip()) for part in value.split(","))


def _open_strictly(content: bytes) -> None:
    """Read all of a workbook; a ValueError if something in it can't be read."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        book = archive.read("xl/workbook.xml").decode("utf-8")
    for m in _DEFINED.finditer(book):
        if not _readable_titles(m[1]):
            raise ValueError(f"print titles: {m[1]}")
    for _ in _cells_of("", content):
        pass


def _repair(content: bytes) -> tuple[bytes, list[str]]:
    """The package with its XML mended, and what was done: unreadable print titles dropped; illegal characters dropped and bare ampersands written out."""
    done, out = set(), io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as archive, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as mended:
        for item in archive.infolist():
            data = archive.read(item)
            if item.filename.endswith((".xml", ".rels")):
                text = data.decode("utf-8", "replace")
                fixed = _BARE.sub("&amp;", _ILLEGAL.sub("", text))
                if fixed != text:
                    done.add("xml_mended")
                if item.filename == "xl/workbook.xml":
                    kept = _DEFINED.sub(lambda m: m[0] if _readable_titles(m[1]) else "", fixed)
                    if kept != fixed:
                        done.add("print_titles_dropped")
                    fixed = kept
                data = fixed.encode("utf-8")
            mended.writestr(item.filename, data)
    return out.getvalue(), sorted(done)


def opened(files: DataFrame) -> DataFrame:
    """files(path, content) with issues: workbooks that open stay as they are; others are mended and read a second time, and what was done is said.

    One that doesn't open then either has no content and the issue ``unreadable``. Each file is tried by itself, so no one of them stops the others.
    """
    types = [pa.string(), pa.binary(), pa.list_(pa.string())]

    def one(path: str, content: bytes | None) -> tuple:
        try:
            _open_strictly(content)
            return path, content, []
        except Exception:
            try:
                mended, done = _repair(content)
                _open_strictly(mended)
                return path, mended, done
            except Exception:
                return path, None, ["unreadable"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one(path, content), types, strict=True)], ["path", "content", "issues"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, content binary, issues array<string>")
