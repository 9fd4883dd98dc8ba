"""Finding what a mapping asks for: statements by title and note, lines elsewhere, bound rows, near captions, overlapping boxes.

``keys`` name the company or page inside which things are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOWS = ("income_statement", "cash_flow")


def by_title(requests: DataFrame, statements: DataFrame, keys: list[str]) -> DataFrame:
    """keys, req, stmt, n for requests(keys, req, title): titles by substring, dashes and case aside.

    Of alternatives ('a || b') the first that any title holds counts; of its statements the readable ones come first, then the earlier.
    """
    fold = lambda c: F.regexp_replace(F.lower(c), r"\s*[-–—]\s*", "-")
    asked = requests.select(*keys, "req", F.posexplode(F.split("title", r"\s*\|\|\s*")).alias("turn", "want"))
    hits = asked.join(statements.select(*keys, "stmt", "ord", "readable", F.col("title").alias("has")), keys).where(F.contains(fold(F.col("has")), fold(F.col("want"))))
    first = hits.withColumn("best", F.min("turn").over(Window.partitionBy(*keys, "req"))).where("turn = best")
    found = first.groupBy(*keys, "req").agg(F.min_by("stmt", F.struct((~F.col("readable")).alias("u"), "ord")).alias("stmt"), F.count("*").alias("n"))
    return requests.select(*keys, "req").join(found, [*keys, "req"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def by_note(requests: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, req, stmt for requests(keys, req, note, target): a note at the period asked for; another one only if the note reports no other."""
    n = notes.withColumn("periods", F.size(F.collect_set("end").over(Window.partitionBy(*keys, "note"))))
    found = requests.join(n, [*keys, "note"]).where((F.col("end") == F.col("target")) | (F.col("periods") == 1)).groupBy(*keys, "req").agg(F.min("stmt").alias("stmt"))
    return requests.select(*keys, "req").join(found, [*keys, "req"], "left")


def withhold(values: Column, unverified: Column, col: Column) -> tuple[Column, Column]:
    """The figure of a column, and the reason why there is none: a figure that no witness confirms is withheld."""
    bad = F.array_contains(unverified, col)
    return F.when(~bad, F.get(values, col)), F.when(bad, "unverified")


def elsewhere(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, caption, kind for captions missing in their own statement: the only other primary statement that has it, else the only note."""
    primary = F.col("kind") != "note"
    counts = lines.groupBy(*keys, "caption").agg(F.countDistinct(F.when(primary, F.col("kind"))).alias("p"), F.max(F.when(primary, F.col("kind"))).alias("k"), F.count(F.when(~primary, 1)).alias("n"))
    return counts.select(*keys, "caption", F.when(F.col("p") == 1, F.col("k")).when((F.col("p") == 0) & (F.col("n") == 1), "note").alias("kind"))


def default_statement(section: Column) -> Column:
    """A row's statement is its section's."""
    return F.when(section != "other", section)


def is_balance(section: Column, basis: Column) -> Column:
    """A row is a balance unless its section is a flow; a basis of its own decides first."""
    return F.when(basis == "point_in_time", True).when(basis == "quarter", False).otherwise(~section.isin(*FLOWS))


def search_forms(wants: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds forms: a canonical field ('field:revenue') is searched by its spellings, never by its id. aliases(field, forms) is a small table."""
    return wants.withColumn("field", F.regexp_extract("want", r"^field:(\w+)$", 1)).join(aliases, "field", "left").withColumn("forms", F.coalesce("forms", F.array("want"))).drop("field")


def bind(mapping: DataFrame, layout: DataFrame, keys: list[str]) -> DataFrame:
    """keys, norm, occurrence, verdict of rows(keys, norm, occurrence, row): same, moved, missing in the layout, or new there."""
    a, b = mapping.withColumnRenamed("row", "a"), layout.withColumnRenamed("row", "b")
    verdict = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").when(F.col("a") != F.col("b"), "moved").otherwise("same")
    return a.join(b, [*keys, "norm", "occurrence"], "full_outer").select(*keys, "norm", "occurrence", verdict.alias("verdict"))


def unmapped(layout: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Layout rows whose label no mapping row has."""
    return layout.join(mapping, [*keys, "norm"], "left_anti")


def nearest(wants: DataFrame, captions: DataFrame, keys: list[str], top: int = 3, least: float = 0.6) -> DataFrame:
    """keys, want, place, caption, ratio: the ``top`` nearest captions by edit distance, if near enough; of equals the first in the alphabet."""
    ratio = 1 - F.levenshtein("want", "norm") / F.greatest(F.length("want"), F.length("norm"))
    near = wants.join(captions.select(*keys, "norm").distinct(), keys).withColumn("ratio", F.round(ratio, 6)).where(F.col("ratio") >= least)
    w = Window.partitionBy(*keys, "want").orderBy(F.desc("ratio"), "norm")
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select(*keys, "want", "place", F.col("norm").alias("caption"), "ratio")


def overlaps(fragments: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Fragments(keys, frag, x0, x1) with the columns(keys, col, l, r) that they overlap by half of the narrower one; joined inside a page."""
    over = F.least("x1", "r") - F.greatest("x0", "l")
    narrow = F.least(F.col("x1") - F.col("x0"), F.col("r") - F.col("l"))
    return fragments.join(ranges, keys).where(over >= narrow / 2).select(*keys, "frag", "col")


def signed_body(term: Column) -> tuple[Column, Column]:
    """Sign and rest of a term with stacked signs: an odd number of minuses makes it negative."""
    lead = F.regexp_extract(term, r"^([+\-\s]*)", 1)
    minus = F.length(lead) - F.length(F.replace(lead, F.lit("-")))
    return F.when(minus % 2 == 1, -1).otherwise(1), F.trim(F.regexp_replace(term, r"^[+\-\s]*", ""))


def column_terms(terms: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, value: each of terms(keys, row, caption, header) names its own column."""
    return terms.join(cells, [*keys, "caption", "header"]).groupBy(*keys, "row").agg(F.sum("value").alias("value"))


def found_or_null(wants: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Adds found and value: a printed dash of a found row is 0; a row that is not there stays null."""
    hit = wants.join(cells.withColumn("hit", F.lit(True)), [*keys, "caption"], "left")
    return hit.withColumn("found", F.coalesce("hit", F.lit(False))).withColumn("value", F.when(F.col("hit"), F.coalesce("value", F.lit(0.0)))).drop("hit")


def nearest_band(labels: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, band: each label of a tier takes the band above it whose centre is nearest."""
    return labels.join(bands, keys).groupBy(*keys, "label").agg(F.min_by("band", F.struct(F.abs(F.col("x") - F.col("c")), "band")).alias("band"))


def slots(short: DataFrame, layout: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, slots: a short row takes the columns of the one layout row that prints the same figures; of two such rows none."""
    full = layout.withColumn("values", F.filter("cells", lambda v: v.isNotNull()))
    hits = short.join(full, [*keys, "values"]).groupBy(*keys, "id").agg(F.count("*").alias("n"), F.first("cells").alias("cells"))
    return short.select(*keys, "id").join(hits, [*keys, "id"], "left").select(*keys, "id", F.when(F.col("n") == 1, F.col("cells")).alias("slots"))


def _grams(text: Column, n: int) -> Column:
    """The different runs of n characters of a text."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


#: How long the runs are by which names are looked up: the longest that a name holds says most about it.
RUNS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)


def containing(lines: DataFrame, names: DataFrame, text: str = "text", name: str = "name") -> DataFrame:
    """The pairs of lines(.., text) and names(.., name) in which the text holds the name as it is written.

    Different texts meet different names: what a thousand lines print is searched once. An index of runs of characters proposes pairs: each name is looked up by runs
    of at least half its length (64 characters if it has more), by the one of them that the fewest texts have; so a title made of common words is told apart
    by what no single word shows. Runs go by hash beside their text's hash, and only proposed pairs are tested, on whole texts. An empty name is in no line. No list
    goes to all tasks.
    """
    size = F.array_max(F.filter(F.array(*map(F.lit, RUNS)), lambda n: n <= F.length(name)))
    wanted = names.select(name).where(F.length(name) > 0).distinct().withColumn("__size", size)
    sizes = sorted(r[0] for r in wanted.select("__size").distinct().collect())  # at most as many as RUNS
    hashed = lambda grams: F.transform(grams, lambda g: F.xxhash64(g))
    own = F.coalesce(*[F.when(F.col("__size") == n, hashed(_grams(F.col(name), n))) for n in sizes or RUNS[:1]])
    runs = wanted.select(name, F.explode(F.array_distinct(own)).alias("__run"))
    texts = lines.where(F.col(text).isNotNull()).select(F.col(text).alias("__text")).distinct().withColumn("__id", F.xxhash64("__text"))
    every = F.explode(F.array_distinct(F.concat(*[hashed(_grams(F.col("__text"), n)) for n in sizes or RUNS[:1]])))
    held = texts.select("__id", every.alias("__run"))
    # How many texts have each run that names have.
    often = held.join(runs.select("__run").distinct(), "__run", "left_semi").groupBy("__run").agg(F.count("*").alias("__n"))
    # A name with a run that no text has is in no text.
    rarest = runs.join(often, "__run", "left").groupBy(name).agg(F.min_by("__run", F.struct(F.coalesce("__n", F.lit(0)), "__run")).alias("__run"), F.min(F.coalesce("__n", F.lit(0))).alias("__n")).where("__n > 0").drop("__n")
    proposed = held.join(rarest, "__run").select("__id", F.col(name).alias("__name")).distinct()
    hits = proposed.join(texts, "__id").where(F.contains("__text", "__name")).select("__text", "__name")
    found = hits.join(names.withColumn("__name", F.col(name)), "__name").select("__text", *(F.col(c).alias(f"__of_{c}") for c in names.columns))
    return lines.join(found, lines[text] == found["__text"]).select(*(lines[c] for c in lines.columns), *(found[f"__of_{c}"].alias(c) for c in names.columns))
