"""Selection over statements generated from the driver's tables: an order is a statement, its lines are rows named after their parts, so captions repeat, contain one another and clash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import select as S
from .registry import load, query

# An order's lines in the order of line, part and price: 'large widget economy' with a figure that is the same for equal captions in half of the orders.
_ROWS = """
    l AS (SELECT l_orderkey AS stmt, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS INTEGER) AS "row", p_name, lower(p_type) AS kind, l_returnflag AS flag, l_linestatus AS status FROM lineitem JOIN part ON l_partkey = p_partkey),
    r AS (SELECT stmt, "row", p_name || ' ' || kind AS norm, CASE WHEN stmt % 2 = 0 THEN 1 ELSE "row" END AS v, p_name, kind, flag, status FROM l)"""
# What is asked of each order: words of the part whose key is the order's, modulo the number of parts.
_ASKED = "n AS (SELECT count(*) AS n FROM part), a AS (SELECT o_orderkey AS req, p_name AS name, lower(p_type) AS kind FROM orders, n, part WHERE p_partkey = o_orderkey % n.n)"


def _found(wants: str, rows: str = "r") -> str:
    """The tiers of a lookup of w(req, norm) in r(stmt, row, norm, v), in SQL."""
    return f"""WITH {_ROWS}, {_ASKED}, w AS ({wants}),
    h AS (SELECT w.req, r."row", r.norm, r.v, CASE WHEN r.norm = w.norm THEN 1 WHEN contains(r.norm, w.norm) OR contains(w.norm, r.norm) THEN 3 WHEN contains(w.norm, ' ') AND list_has_all(string_split(r.norm, ' '), string_split(w.norm, ' ')) THEN 4 END AS tier FROM w JOIN {rows} ON r.stmt = w.req),
    f AS (SELECT req, tier, min("row") AS "row", count(DISTINCT CASE WHEN tier >= 3 THEN norm || v ELSE CAST("row" AS VARCHAR) END) AS n FROM h WHERE tier = (SELECT min(tier) FROM h x WHERE x.req = h.req) GROUP BY req, tier)
    SELECT w.req, CASE WHEN tier = 1 OR n = 1 THEN f."row" END AS "row", CASE tier WHEN 1 THEN 'exact' WHEN 3 THEN 'containment' WHEN 4 THEN 'words' END AS tier, CASE WHEN tier IS NULL THEN 'not_found' WHEN tier > 1 AND n > 1 THEN 'ambiguous' END AS reason FROM w LEFT JOIN f ON w.req = f.req"""  # fmt: skip


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stmt, row, caption, values, with p_name, kind, flag and status."""
    of = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus")
    items = items.join(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey")).withColumn("row", (F.row_number().over(of) - 1).cast("int"))
    value = F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(F.col("row")).cast("double")
    return items.select(F.col("l_orderkey").alias("stmt"), "row", F.initcap(F.concat_ws(", ", "p_name", "p_type")).alias("caption"), F.array(value).alias("values"), "p_name", F.lower("p_type").alias("kind"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """req, stmt, name, kind of each order."""
    part = load(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.lower("p_type").alias("kind"))
    n = part.count()
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("req"), F.col("o_orderkey").alias("stmt"))
    return orders.join(part, F.col("req") % n == F.col("p_partkey")).select("req", "stmt", "name", "kind")


def _find(spark, sf_dir, caption) -> DataFrame:
    return S.find_row(asked(spark, sf_dir).select("req", "stmt", F.array(caption).alias("captions")), lines(spark, sf_dir))


@query("f7_find_exact_facts", _found("SELECT req, name || ' ' || kind AS norm FROM a"))
def f7(spark, sf_dir):
    """Whole captions, printed with capitals and a comma."""
    return _find(spark, sf_dir, F.upper(F.concat_ws(" - ", "name", "kind")))


@query("f9_find_containment_facts", _found("SELECT req, name AS norm FROM a"))
def f9(spark, sf_dir):
    return _find(spark, sf_dir, F.initcap("name"))


@query("f10_find_words_facts", _found("SELECT req, kind || ' ' || regexp_extract(name, '[a-z]+$') AS norm FROM a"))
def f10(spark, sf_dir):
    """The kind before the last word of the name, as no line prints them."""
    return _find(spark, sf_dir, F.concat_ws(" ", "kind", F.regexp_extract("name", "[a-z]+$", 0)))


@query("f11_duplicate_lines_facts", _found("SELECT req, regexp_extract(name, '^[a-z]+') AS norm FROM a") + " WHERE tier = 3")
def f11(spark, sf_dir):
    """First words, which many lines have: equal lines with equal figures are one, others are refused."""
    return _find(spark, sf_dir, F.regexp_extract("name", "^[a-z]+", 0)).where("tier = 'containment'")


# Captions of a direction: 'economy gains', 'economy losses', or both in one.
_BOTH = "CASE flag WHEN 'A' THEN kind || ' gains' WHEN 'R' THEN kind || ' losses' ELSE kind || ' losses gains' END"


@query("f8_find_direction_facts", f"""WITH {_ROWS}, {_ASKED}, d AS (SELECT stmt, "row", kind, {_BOTH} AS norm FROM r), w AS (SELECT req, kind, CASE WHEN req % 2 = 0 THEN kind || ' gains' ELSE kind || ' losses gains' END AS norm FROM a),
    h AS (SELECT w.req, d."row", CASE WHEN d.norm = w.norm THEN 1 WHEN d.kind = w.kind AND (req % 2 = 1 OR d.norm = w.kind || ' losses gains') THEN 2 END AS tier FROM w JOIN d ON d.stmt = w.req),
    f AS (SELECT req, tier, min("row") AS "row", count(DISTINCT "row") AS n FROM h WHERE tier = (SELECT min(tier) FROM h x WHERE x.req = h.req) GROUP BY req, tier)
    SELECT w.req, CASE WHEN tier = 1 OR n = 1 THEN f."row" END AS "row", CASE tier WHEN 1 THEN 'exact' WHEN 2 THEN 'direction' END AS tier, CASE WHEN tier IS NULL THEN 'not_found' WHEN tier = 2 AND n > 1 THEN 'needs_a_sum' END AS reason FROM w LEFT JOIN f ON w.req = f.req""")  # fmt: skip
def f8(spark, sf_dir):
    """One direction may stand in a line of both; several lines of one direction each are a sum, which is refused."""
    both = F.when(F.col("flag") == "A", "gains").when(F.col("flag") == "R", "losses").otherwise("(losses) / gains")
    rows = lines(spark, sf_dir).withColumn("caption", F.concat_ws(" ", "kind", both))
    want = F.concat_ws(" ", "kind", F.when(F.col("req") % 2 == 0, "Gains").otherwise("(Losses) / Gains"))
    return S.find_row(asked(spark, sf_dir).select("req", "stmt", F.array(want).alias("captions")), rows)


@query("f12_nth_exact_facts", f"""WITH {_ROWS}, o AS (SELECT *, row_number() OVER (PARTITION BY stmt, kind ORDER BY "row") AS nth FROM r), t AS (SELECT unnest([1, 2, 3]) AS nth), {_ASKED}
    SELECT a.req * 10 + t.nth AS req, o."row" FROM a CROSS JOIN t LEFT JOIN o ON o.stmt = a.req AND o.kind = a.kind AND o.nth = t.nth""")  # fmt: skip
def f12(spark, sf_dir):
    """The first, second and third line of a kind."""
    wants = asked(spark, sf_dir).select("stmt", F.col("kind").alias("caption"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("nth")).withColumn("req", F.col("stmt") * 10 + F.col("nth"))
    return S.find_nth(wants, lines(spark, sf_dir).withColumn("caption", F.upper("kind")))


@query("f13_block_rows_facts", f"""WITH {_ROWS}, {_ASKED}, h AS (SELECT stmt, "row" * 2 AS "row", kind AS norm FROM r UNION ALL SELECT stmt, "row" * 2 + 1, 'net ' || p_name FROM r),
    c AS (SELECT a.req, min(h."row") AS anchor, count(*) AS n FROM a JOIN h ON h.stmt = a.req AND contains(' ' || h.norm || ' ', ' ' || a.kind || ' ') GROUP BY a.req),
    f AS (SELECT a.req, min(h."row") AS "row" FROM a JOIN c ON a.req = c.req AND c.n = 1 JOIN h ON h.stmt = a.req AND h."row" >= c.anchor AND (h.norm = regexp_extract(a.name, '[a-z]+$') OR ends_with(h.norm, ' ' || regexp_extract(a.name, '[a-z]+$'))) GROUP BY a.req)
    SELECT a.req, CAST(f."row" AS INTEGER) AS "row", CASE WHEN c.n IS NULL THEN 'no_heading' WHEN c.n > 1 THEN 'ambiguous_heading' WHEN f."row" IS NULL THEN 'not_found' END AS reason FROM a LEFT JOIN c ON a.req = c.req LEFT JOIN f ON a.req = f.req""")  # fmt: skip
def f13(spark, sf_dir):
    """Kinds are headings, and the line below one is asked for by the last word of its caption."""
    r = lines(spark, sf_dir)
    none = F.lit(None).cast("string")
    two = F.array(F.struct((F.col("row") * 2).alias("row"), F.upper("kind").alias("caption")), F.struct((F.col("row") * 2 + 1).alias("row"), F.concat(F.lit("Net "), F.initcap("p_name")).alias("caption")))
    rows = r.select("stmt", F.inline(two)).withColumn("heading", none)
    return S.find_block_row(asked(spark, sf_dir).select("req", "stmt", F.col("kind").alias("block"), F.regexp_extract("name", "[a-z]+$", 0).alias("caption")), rows)


def _word(*parts):
    """The parts as one word that is in no other."""
    return F.translate(F.concat_ws(" ", F.lit("q"), *parts), " ", "_")


@query("f14_alternatives_facts", f"""WITH {_ROWS}, {_ASKED}, w AS (SELECT req, 0 AS turn, 'sundry ' || kind || ' ' || name AS norm FROM a UNION ALL SELECT req, 1, name || ' ' || kind FROM a UNION ALL SELECT req, 2, name || ' promo' FROM a),
    f AS (SELECT w.req, w.turn, min(r."row") AS "row" FROM w JOIN r ON r.stmt = w.req AND r.norm = w.norm GROUP BY w.req, w.turn),
    b AS (SELECT req, min(turn) AS turn, arg_min("row", turn) AS "row" FROM f GROUP BY req) SELECT a.req, b."row", CAST(b.turn AS INTEGER) AS turn, CASE WHEN b.req IS NULL THEN 'not_found' END AS reason FROM a LEFT JOIN b ON a.req = b.req""")  # fmt: skip
def f14(spark, sf_dir):
    """The first of three spellings that the statement has as a whole line."""
    rows = lines(spark, sf_dir).withColumn("caption", F.concat_ws(" x ", _word("p_name"), "kind"))
    name = _word("name")
    text = F.concat_ws(" || ", F.concat_ws(" ", F.lit("sundry"), "kind", name, F.lit("zzz")), F.concat_ws(" x ", name, "kind"), F.concat_ws(" x ", name, F.lit("promo")))
    return S.find_alternatives(asked(spark, sf_dir).select("req", "stmt", text.alias("caption")), rows)


@query("f15_optional_terms_facts", f"""SELECT f.req, CASE WHEN tier = 'exact' THEN CAST(CASE WHEN f.req % 2 = 0 THEN 1 ELSE f."row" END AS DOUBLE) WHEN tier IS NULL THEN 0 END AS value, CASE WHEN tier <> 'exact' THEN 'near_match' END AS reason FROM ({_found("SELECT req, CASE WHEN req % 3 = 0 THEN name ELSE name || ' ' || kind END AS norm FROM a")}) f""")
def f15(spark, sf_dir):
    caption = F.when(F.col("req") % 3 == 0, F.col("name")).otherwise(F.concat_ws(" ", "name", "kind"))
    return S.optional_value(asked(spark, sf_dir).select("req", "stmt", caption.alias("caption")), lines(spark, sf_dir).withColumn("value", F.get("values", F.lit(0))))


# Spellings of a field: a brand's whole captions, in the order of its parts.
_ALIASES = "s AS (SELECT p_brand AS field, p_name || ' ' || lower(p_type) AS norm, min(p_partkey) AS turn FROM part GROUP BY ALL)"
_DISPATCHED = f"""WITH {_ROWS}, {_ASKED}, {_ALIASES}, q AS (SELECT a.req, CASE WHEN a.req % 4 = 0 THEN a.name || ' ' || a.kind END AS hint, CASE WHEN a.req % 3 <> 0 THEN p_brand END AS field FROM a, n JOIN part ON p_partkey = a.req % n.n),
    t AS (SELECT q.req, 0 AS turn, 0 AS ord, hint AS norm FROM q WHERE hint IS NOT NULL UNION ALL SELECT q.req, 1, s.turn, s.norm FROM q JOIN s ON s.field = q.field),
    h AS (SELECT t.req, t.turn, t.ord, min(r."row") AS "row" FROM t JOIN r ON r.stmt = t.req AND r.norm = t.norm GROUP BY ALL), b AS (SELECT req, arg_min("row", turn * 1000000 + ord) AS "row", min(turn) AS turn FROM h GROUP BY req)"""


def _exact_only(rows: DataFrame) -> DataFrame:
    """Captions as one word each, so that a line is found whole or not at all."""
    return rows.withColumn("caption", _word("p_name", "kind"))


def _fields(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    part = load(spark, sf_dir, "part")
    caption = _word("p_name", F.lower("p_type"))
    first = part.groupBy(F.col("p_brand").alias("field"), caption.alias("caption")).agg(F.min("p_partkey").alias("turn"))
    aliases = first.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "caption"))), lambda x: x["caption"]).alias("captions"))
    n = part.count()
    brand = part.select("p_partkey", "p_brand")
    hint = F.when(F.col("req") % 4 == 0, _word("name", "kind"))
    wants = asked(spark, sf_dir).join(brand, F.col("req") % n == F.col("p_partkey")).select("req", "stmt", hint.alias("hint"), F.when(F.col("req") % 3 != 0, F.col("p_brand")).alias("field"))
    return wants, aliases


@query("f16_lookup_dispatch_facts", _DISPATCHED + """ SELECT q.req, b."row", CASE b.turn WHEN 0 THEN 'caption' WHEN 1 THEN 'alias' ELSE 'absent' END AS by FROM q LEFT JOIN b ON q.req = b.req""")
def f16(spark, sf_dir):
    wants, aliases = _fields(spark, sf_dir)
    return S.dispatch(wants, aliases, _exact_only(lines(spark, sf_dir)))


@query("f17_field_aliases_facts", _DISPATCHED + """, x AS (SELECT req, arg_min("row", ord) AS "row" FROM h WHERE turn = 1 GROUP BY req) SELECT q.req, x."row", CASE WHEN x.req IS NOT NULL THEN 'exact' END AS tier FROM q LEFT JOIN x ON q.req = x.req WHERE q.field IS NOT NULL""")
def f17(spark, sf_dir):
    """Fields by their spellings, the first one that is printed."""
    wants, aliases = _fields(spark, sf_dir)
    return S.find_listed(wants, aliases, _exact_only(lines(spark, sf_dir))).select("req", "row", "tier")


# --- statements and columns --------------------------------------------------------------------------------

#: Kinds of an order's statement by its priority.
_KINDS = {"1-URGENT": "balance_sheet", "2-HIGH": "cash_flow", "3-MEDIUM": "comprehensive_income", "4-NOT SPECIFIED": "income_statement", "5-LOW": "equity"}
_KIND_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " END"


@query("f1_statement_by_kind_facts", f"""
    WITH s AS (SELECT o_custkey AS c, o_orderkey AS stmt, {_KIND_SQL} AS kind, o_orderstatus <> 'P' AS readable FROM orders), q AS (SELECT DISTINCT c, k AS kind FROM s, (VALUES ('balance_sheet'), ('income_statement'), ('equity')) AS v(k)),
    h AS (SELECT q.c, q.kind, s.stmt, CASE WHEN s.kind = q.kind THEN 0 ELSE 4 END + CASE WHEN s.readable THEN 0 ELSE 2 END AS rank FROM q JOIN s ON q.c = s.c AND (s.kind = q.kind OR (q.kind = 'income_statement' AND s.kind = 'comprehensive_income'))),
    b AS (SELECT c, kind, arg_min(stmt, rank * 1e12 + stmt) AS stmt FROM h GROUP BY c, kind)
    SELECT q.c || ' ' || q.kind AS req, b.stmt, CASE WHEN b.stmt IS NULL THEN 'no ' || q.kind END AS reason FROM q LEFT JOIN b ON q.c = b.c AND q.kind = b.kind""")  # fmt: skip
def f1(spark, sf_dir):
    """A customer's orders are the statements of a filing; three kinds are asked of each."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), F.col("o_orderpriority"))
    statements = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("filing"), F.col("o_orderkey").alias("stmt"), kind.alias("kind"), F.col("o_orderkey").alias("ord"), (F.col("o_orderstatus") != "P").alias("readable"))
    asked_kinds = F.explode(F.array(*map(F.lit, ("balance_sheet", "income_statement", "equity"))))
    requests = statements.select("filing").distinct().select("filing", asked_kinds.alias("kind")).withColumn("req", F.concat_ws(" ", "filing", "kind"))
    return S.pick_statement(requests, statements, ["filing"])


# Columns of an order: its lines' kinds as headers, all for one quarter; a line marked R prints the year to date.
def _columns(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    r = lines(spark, sf_dir)
    end = F.lit("2026-06-30").cast("date")
    columns = r.select("stmt", F.col("row").alias("col"), F.when(F.col("status") == "O", F.concat(F.lit("Total "), "kind")).otherwise(F.col("kind")).alias("header"), F.lit("period").alias("kind"), F.when(F.col("flag") == "R", 6).otherwise(3).alias("months"), end.alias("end"))
    return columns, r.select("stmt", F.col("row").alias("col"), F.lit(0).alias("row"), F.get("values", F.lit(0)).alias("value"))


def _picked(nth: str) -> str:
    return f"""WITH {_ROWS}, {_ASKED}, c AS (SELECT stmt, "row" AS col, CASE WHEN status = 'O' THEN 'total ' ELSE '' END || kind AS header, kind, CASE WHEN flag = 'R' THEN 6 ELSE 3 END AS months, v FROM r),
    g AS (SELECT a.req, c.*, row_number() OVER (PARTITION BY a.req ORDER BY col) AS i FROM a JOIN c ON c.stmt = a.req AND contains(' ' || c.header || ' ', ' ' || a.kind || ' ')),
    k AS (SELECT *, min(months) OVER (PARTITION BY req) AS top FROM g WHERE {nth}), b AS (SELECT req, count(*) AS n, min(col) AS col, min(months) AS months, count(DISTINCT header || '|' || months || '|' || v) AS d FROM k WHERE months = top GROUP BY req),
    n2 AS (SELECT DISTINCT stmt FROM c) SELECT a.req, CASE WHEN n = 1 OR d = 1 THEN b.col END AS col, CASE WHEN n = 1 OR d = 1 THEN CAST(b.months AS INTEGER) END AS months,
    CASE WHEN n2.stmt IS NULL THEN 'no_columns' WHEN b.req IS NULL THEN 'no_header' WHEN NOT (n = 1 OR d = 1) THEN 'ambiguous' WHEN b.months > 3 THEN 'cumulative' END AS reason FROM a LEFT JOIN n2 ON n2.stmt = a.req LEFT JOIN b ON b.req = a.req"""  # fmt: skip


def _pick(spark, sf_dir, header) -> DataFrame:
    columns, cells = _columns(spark, sf_dir)
    target = F.lit("2026-06-30").cast("date").alias("target")
    requests = asked(spark, sf_dir).select("req", "stmt", target, F.lit(3).alias("cadence"), F.lit(False).alias("balance"), header.alias("header"))
    return S.pick_column(requests, columns, cells)


@query("f5_header_narrowing_facts", _picked("i = req % 2 + 1"))
def f5(spark, sf_dir):
    """The first or the second column whose header holds the kind as whole words."""
    return _pick(spark, sf_dir, F.concat(F.upper("kind"), F.lit(" #"), (F.col("req") % 2 + 1).cast("string")))


@query("f6_tie_break_facts", _picked("true"))
def f6(spark, sf_dir):
    """Several columns of the kind: the quarter before the year to date; columns that print the same are one, others are refused."""
    return _pick(spark, sf_dir, F.col("kind"))
