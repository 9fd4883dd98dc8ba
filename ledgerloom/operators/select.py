"""Selecting statements, period columns and rows: every pick carries a count and a reason, and a tie is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import direction_variants, names_two_directions, normalize_label


def pick_statement(requests: DataFrame, statements: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """requests(keys, req, kind) against statements(keys, stmt, kind, ord, readable): the first readable one of the kind in the same filing.

    An income statement may be read from a statement of comprehensive income if there is no other. ``keys`` name the filing; ``req`` is unique.
    """
    keys = keys or []
    wants = requests.withColumn("k", F.explode(F.when(F.col("kind") == "income_statement", F.array(F.lit("income_statement"), F.lit("comprehensive_income"))).otherwise(F.array("kind"))))
    s = statements.select(*keys, F.col("kind").alias("k"), "stmt", "ord", "readable")
    ranked = wants.join(s, [*keys, "k"]).groupBy("req").agg(F.min_by("stmt", F.struct((F.col("k") != F.col("kind")).alias("other"), (~F.col("readable")).alias("unreadable"), "ord")).alias("stmt"))
    return requests.join(ranked, "req", "left").select("req", "stmt", F.when(F.col("stmt").isNull(), F.concat(F.lit("no "), "kind")).alias("reason"))


def header_holds(header: Column, wanted: Column) -> Column:
    """Whole words of the wanted text in the header; 'non current' is no 'current'."""
    return _holds(normalize_label(header), normalize_label(wanted))


def _holds(norm: Column, want: Column) -> Column:
    text = F.concat(F.lit(" "), norm, F.lit(" "))
    cleared = F.when(F.startswith(want, F.lit("non ")), text).otherwise(F.replace(text, F.concat(F.lit(" non "), want, F.lit(" ")), F.lit(" ")))
    return F.contains(cleared, F.concat(F.lit(" "), want, F.lit(" ")))


def pick_column(requests: DataFrame, columns: DataFrame, cells: DataFrame) -> DataFrame:
    """requests(req, stmt, target, cadence, balance, header) -> req, col, months, reason; ``req`` is unique.

    Balances match by end date, preferring columns of that kind. Flows match the cadence, else the shortest cumulative
    span with the same end. Of several matches the only 'Total' is taken, or the first if all print the same on every line.

    Requests meet columns once, by statement, and what is asked of a request's columns is counted where they are.
    """
    r = requests.withColumn("nth", F.nullif(F.regexp_extract("header", r"#(\d+)\s*$", 1), F.lit("")).cast("int")).withColumn("wanted", F.nullif(F.trim(F.regexp_replace("header", r"\s*#\d+\s*$", "")), F.lit("")))
    r = r.withColumn("want", normalize_label(F.col("wanted"))).drop("header")
    c = columns.select("stmt", "col", F.col("header").alias("printed"), "kind", "months", "end").withColumn("norm", normalize_label(F.col("printed")))
    of = Window.partitionBy("stmt", "req")
    held = F.col("col").isNotNull() & (F.col("wanted").isNull() | _holds(F.col("norm"), F.col("want")))
    on = F.col("end") == F.col("target")
    rank = F.when(F.col("balance"), F.when(on & (F.col("kind") == "point_in_time"), 0).when(on, 1)).when(on & (F.col("months") == F.col("cadence")), 0).when(on & (F.col("months") > F.col("cadence")), F.col("months"))
    met = r.join(c, "stmt", "left").select("stmt", "req", "col", "printed", "months", "cadence", "balance", "wanted", "nth", held.alias("held"), rank.alias("rank"))
    met = met.withColumn("i", F.row_number().over(of.orderBy(F.desc("held"), "col"))).withColumn("held", F.col("held") & (F.col("nth").isNull() | (F.col("i") == F.col("nth"))))
    met = met.withColumn("n_held", F.count(F.when(F.col("held"), 1)).over(of)).withColumn("top", F.min(F.when(F.col("held"), F.col("rank"))).over(of))
    # A balance's only column of that header is taken whatever its date.
    alone = (F.col("n_held") == 1) & F.col("balance") & F.col("wanted").isNotNull()
    best = F.col("held") & F.coalesce(F.col("rank") == F.col("top"), alone)
    # Columns that carry the same figures everywhere are one. They are compared inside of a statement, so that nothing is sent again.
    figures = cells.groupBy("stmt", F.col("col").alias("f_col")).agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("figures"))
    marked = met.select("stmt", "req", "col", "printed", "months", "cadence", "balance", "n_held", F.when(best, F.col("col")).alias("best")).alias("m")
    marked = marked.join(figures.alias("f"), (F.col("m.stmt") == F.col("f.stmt")) & F.col("best").between(F.col("f_col"), F.col("f_col")), "left").drop(F.col("f.stmt"))
    one = F.struct("col", "months")
    total = F.lower(F.trim("printed")) == "total"
    is_best = F.col("best").isNotNull()
    same = F.when(is_best, F.struct("printed", F.coalesce("months", F.lit(-1)).alias("months"), F.to_json(F.struct("figures")).alias("figures")))
    found = marked.withColumn("same", same).groupBy("stmt", "req").agg(
        F.count("col").alias("n_columns"),
        F.max("n_held").alias("n_held"),
        F.count("best").alias("n"),
        F.count(F.when(is_best & total, 1)).alias("n_total"),
        F.min(F.when(is_best & total, one)).alias("total"),
        F.min(F.when(is_best, one)).alias("first"),
        (F.min("same") == F.max("same")).alias("equal"),
        F.max(F.when(is_best, F.size("figures"))).alias("filled"),
        F.first("cadence").alias("cadence"),
        F.first("balance").alias("balance"),
    )
    pick = F.when(F.col("n") == 1, F.col("first")).when(F.col("n_total") == 1, F.col("total")).when(F.col("equal") & (F.col("filled") > 0), F.col("first"))
    reason = (
        F.when(F.col("n_columns") == 0, "no_columns")
        .when(F.col("n_held") == 0, "no_header")
        .when(F.col("n") == 0, "no_period")
        .when(F.col("pick").isNull(), "ambiguous")
        .when(~F.col("balance") & (F.col("pick.months") > F.col("cadence")), "cumulative")
    )
    return found.withColumn("pick", pick).select("req", "pick.col", "pick.months", reason.alias("reason"))


def find_row(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """requests(req, stmt, captions) against rows(stmt, row, caption, values) -> req, row, tier, reason; ``req`` is unique.

    Tiers: exact, one direction of a two-direction caption, containment either way, all words. The first tier with a hit
    decides; more than one distinct line there is refused. Captions are joined inside their statement only.
    """
    return _settle(_met(requests, rows), ["stmt", "req"]).select("req", "row", "tier", "reason")


def _met(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """Each request's captions beside each line of its statement, with the tier and turn of those that match; what a caption alone decides is worked out before they meet.

    All requests stay, so one join by statement is all that finding needs: a request's lines are where its statement is.
    """
    wants = requests.select("req", "stmt", F.posexplode_outer("captions").alias("ord", "w")).withColumn("w", normalize_label(F.col("w")))
    wants = wants.withColumns({"w_forms": _turned(F.col("w")), "w_words": _words("w")})
    lines = rows.withColumn("norm", normalize_label(F.col("caption"))).withColumn("forms", _turned(F.col("norm")))
    pairs = wants.join(lines, "stmt", "left")
    turned = (F.col("forms").isNotNull() | F.col("w_forms").isNotNull()) & F.arrays_overlap(F.coalesce("forms", F.array("norm")), F.coalesce("w_forms", F.array("w")))
    # Few lines have a caption's first word: only theirs are cut into words.
    words = (F.size("w_words") > 1) & F.contains("norm", F.get("w_words", F.lit(0))) & (F.size(F.array_except("w_words", F.split("norm", " "))) == 0)
    hit = F.when(F.col("norm") == F.col("w"), 1).when(turned, 2).when(F.contains("norm", "w") | F.contains("w", "norm"), 3).when(words, 4)
    # Within a tier: exact tries captions in order and takes the first line; later tiers try the longest caption first (directions: in order).
    return pairs.withColumn("tier", F.when((F.col("w") != "") & (F.col("norm") != ""), hit)).withColumn("turn", _turn(F.col("tier"), F.col("w"), F.col("ord")))


def _turned(c: Column) -> Column:
    """A caption with its directions' readings; null if it has none, as most."""
    return F.when(names_two_directions(c), F.array_union(F.array(c), direction_variants(c)))


def _words(c: Column) -> Column:
    return F.array_distinct(F.split(c, " "))


def _turn(tier: Column, w: Column, ord_: Column) -> Column:
    return F.when(tier <= 2, ord_).otherwise(-F.length(w) * 1000 + ord_)


def _forms(c: Column) -> Column:
    return F.array_union(F.array(c), direction_variants(c))


def _settle(hits: DataFrame, of: list[str], *carried: str) -> DataFrame:
    """of, row, tier, reason of hits(of, row, norm, values, tier, turn), ``carried`` columns of the first line: the first tier and turn decide; several different lines there are refused.

    ``of`` tells requests apart; a request whose lines all have no tier is not found.
    """
    hit, best = F.col("tier").isNotNull(), ("tier", "turn")
    hits = hits.select(*of, *best, "row", *carried, F.when(F.col("tier") >= 3, F.to_json(F.struct("norm", "values"))).when(F.col("tier") == 2, F.col("row").cast("string")).alias("same"))
    # Among the lines of the first tier and turn: the first row, and whether the least and the greatest content are one.
    found = hits.groupBy(*of).agg(
        F.min(F.when(hit, F.struct(*best, "row", *carried))).alias("first"),
        F.min(F.when(hit, F.struct(*best, "same"))).alias("least"),
        F.max(F.when(hit, F.struct(*[(-F.col(c)).alias(c) for c in best], "same"))).alias("greatest"),
    )
    found = found.select(*of, "first.*", ((F.col("first.tier") == 1) | (F.col("least.same") == F.col("greatest.same"))).alias("one"))
    name = F.when(F.col("tier") == 1, "exact").when(F.col("tier") == 2, "direction").when(F.col("tier") == 3, "containment").when(F.col("tier") == 4, "words")
    return found.select(*of, F.when(F.col("one"), F.col("row")).alias("row"), name.alias("tier"), F.when(F.col("tier").isNull(), "not_found").when(~F.col("one"), F.when(F.col("tier") == 2, "needs_a_sum").otherwise("ambiguous")).alias("reason"), *carried)


def find_listed(requests: DataFrame, aliases: DataFrame, rows: DataFrame) -> DataFrame:
    """find_row for requests(req, stmt, field) whose captions are their field's: aliases(field, captions).

    A line's best tier and turn depend on its field and caption only, so they are worked out once for each of these that meet, not for each request and spelling: whole
    captions and directions by equality; containment and words for the captions that have neither, against the spellings of their field.
    """
    of = ["field", "norm"]
    spelled = aliases.select("field", F.posexplode("captions").alias("ord", "w")).withColumn("w", normalize_label(F.col("w"))).where("w <> ''")
    lines = rows.withColumn("norm", normalize_label(F.col("caption"))).where("norm <> ''").select("stmt", "row", "norm", "values")
    known = requests.join(aliases.select("field").distinct(), "field", "left_semi").select("req", "stmt", "field")
    met = known.join(lines, "stmt")
    captions = met.select(*of).distinct()
    exact = spelled.groupBy("field", F.col("w").alias("norm")).agg(F.min("ord").alias("exact"))
    form = F.explode(_forms(F.col("norm"))).alias("form")
    asked = spelled.select("field", "ord", F.explode(_forms(F.col("w"))).alias("form")).groupBy("field", "form").agg(F.min("ord").alias("ord"))
    turned = captions.select(*of, form).join(asked, ["field", "form"]).groupBy(*of).agg(F.min("ord").alias("turned"))
    whole = captions.join(exact, of, "left").join(turned, of, "left").withColumn("turn", F.coalesce("exact", "turned"))
    near = whole.where("turn is null").select(*of).join(spelled, "field")
    tier = F.when(F.contains("norm", "w") | F.contains("w", "norm"), 3).when((F.size(_words("w")) > 1) & (F.size(F.array_except(_words("w"), _words("norm"))) == 0), 4)
    near = near.withColumn("tier", tier).where("tier is not null").groupBy(*of).agg(F.min(F.struct("tier", _turn(F.col("tier"), F.col("w"), F.col("ord")).alias("turn"))).alias("best"))
    best = whole.where("turn is not null").select(*of, F.when(F.col("exact").isNotNull(), 1).otherwise(2).alias("tier"), "turn").unionByName(near.select(*of, "best.tier", "best.turn"))
    found = _settle(met.join(best, of), ["req"])
    return known.select("req").join(found, "req", "left").select("req", "row", "tier", F.coalesce("reason", F.when(F.col("tier").isNull(), "not_found")).alias("reason"))


def find_nth(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """requests(req, stmt, caption, nth) -> req, row: the nth line of the statement that is the caption exactly."""
    same = Window.partitionBy("stmt", "norm").orderBy("row")
    lines = rows.select("stmt", normalize_label(F.col("caption")).alias("norm"), "row").withColumn("nth", F.row_number().over(same))
    return requests.select("req", "stmt", normalize_label(F.col("caption")).alias("norm"), "nth").join(lines, ["stmt", "norm", "nth"], "left").select("req", "row")


def find_alternatives(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """requests(req, stmt, caption 'A || B') -> req, row, turn, reason: the first alternative that is found, each looked up by itself."""
    each = requests.select("stmt", F.col("req").alias("whole"), F.posexplode(F.split("caption", r"\s*\|\|\s*")).alias("alternative", "c"))
    found = _settle(_met(each.select(F.struct("whole", "alternative").alias("req"), "stmt", F.array("c").alias("captions")), rows), ["stmt", "req"])
    best = found.groupBy("stmt", F.col("req.whole").alias("req")).agg(F.min_by(F.struct("row", F.col("req.alternative").alias("turn")), F.when(F.col("row").isNotNull(), F.col("req.alternative"))).alias("b"))
    return best.select("req", "b.row", "b.turn", F.when(F.col("b").isNull(), "not_found").alias("reason"))


def optional_value(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """requests(req, stmt, caption), rows with value -> req, value, reason: an optional line's value, 0 if nothing is like it; a line that is only near it is an error."""
    found = _settle(_met(requests.select("req", "stmt", F.array("caption").alias("captions")), rows), ["stmt", "req"], "value")
    value = F.when(F.col("tier") == "exact", F.col("value")).when(F.col("tier").isNull(), F.lit(0.0))
    return found.select("req", value.alias("value"), F.when(F.col("tier") != "exact", "near_match").alias("reason"))


def dispatch(requests: DataFrame, aliases: DataFrame, rows: DataFrame) -> DataFrame:
    """requests(req, stmt, hint, field), aliases(field, captions) -> req, row, by: by the recorded caption, else by the field's spellings in their order, else absent.

    A field is never looked up by its own name.
    """
    by = lambda found, turn, name: found.where("row is not null").select("req", "row", F.lit(turn).alias("turn"), F.lit(name).alias("by"))
    hinted = find_row(requests.where("hint is not null").select("req", "stmt", F.array("hint").alias("captions")), rows)
    found = by(hinted, 0, "caption").unionByName(by(find_listed(requests.where("field is not null"), aliases, rows), 1, "alias"))
    best = found.groupBy("req").agg(F.min_by(F.struct("row", "by"), "turn").alias("b")).select("req", "b.*")
    return requests.select("req").join(best, "req", "left").select("req", "row", F.coalesce("by", F.lit("absent")).alias("by"))


def find_block_row(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """requests(req, stmt, block, caption): the first line at or after a unique heading that is, or ends with, the caption; ``req`` is unique."""
    from ..functions.text import accent_free_label as plain

    lines = rows.select("stmt", "row", plain(F.col("heading")).alias("under"), plain(F.col("caption")).alias("norm"))
    w = requests.select("req", "stmt", plain(F.col("block")).alias("b"), plain(F.col("caption")).alias("c"))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    heads = F.col("row").isNotNull() & F.contains(padded(F.concat_ws(" ", "under", "norm")), padded(F.col("b")))
    fits = (F.col("norm") == F.col("c")) | F.endswith(F.col("norm"), F.concat(F.lit(" "), "c"))
    # Both questions are asked where a request's lines are, so they meet once.
    met = w.join(lines, "stmt", "left").select("stmt", "req", "row", F.when(heads, F.col("row")).alias("head"), fits.alias("fits"))
    of = Window.partitionBy("stmt", "req")
    met = met.withColumn("anchors", F.count("head").over(of)).withColumn("anchor", F.min("head").over(of))
    found = met.groupBy("stmt", "req").agg(F.max("anchors").alias("anchors"), F.min(F.when((F.col("anchors") == 1) & (F.col("row") >= F.col("anchor")) & F.col("fits"), F.col("row"))).alias("row"))
    return found.select("req", "row", F.when(F.col("anchors") == 0, "no_heading").when(F.col("anchors") > 1, "ambiguous_heading").when(F.col("row").isNull(), "not_found").alias("reason"))
