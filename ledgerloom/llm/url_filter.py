"""URL filters: rules, and for URLs without a rule a ratio of two character language models. Built-in functions only.

Characters of host and path are mapped to 32 symbols (letters, digits, the slash, the dot, the hyphen and others). For
accepted and for rejected URLs, those that rules judge, a variable-order Markov model predicts a symbol from up to three symbols before
it: an order's estimate is its counts plus ``STRENGTH`` times the next lower order's, so unseen contexts fall back to
shorter ones. The log ratio of the two models is one number for each of at most 32**4 symbol sequences: a table with a
fixed bound, broadcast. Each distinct host and path is scored once. A URL's score is the mean over its symbols; the cut is the one with the best balanced
accuracy on a fifth of the judged URLs, which the models have not seen.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and scores as an empty string; without
accepted or rejected URLs all scores are 0 and the cut is 0; a score at or above the cut is allowed; repeated rows get equal verdicts; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import core

#: (rule, verdict): host, then path. A rule fits its host and all subdomains where the path starts with its path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
ORDER, SYMBOLS, STRENGTH = 4, 32, 2.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Places in this string are symbols: 1 to 26 letters, 27 digits (mapped to 0), then / . - and others (mapped to ~).
_ALPHABET = _LOWER + "0/.-~"
_BINS = 64  # steps a unit of the score, for calibration


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    own = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
    return own & F.startswith(F.col("path"), F.lit(slash + path))


def rule_of(rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        fits = _fits(rule)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _symbols() -> Column:
    """The symbols of host and path, after three zeros and before one."""
    text = F.translate(F.concat("host", "path"), _UPPER + "123456789_", _LOWER + "000000000-")
    symbol = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(F.nullif(F.call_function("locate", c, F.lit(_ALPHABET)), F.lit(0)), F.lit(SYMBOLS - 1)))
    return F.concat(F.array_repeat(F.lit(0), ORDER - 1), symbol, F.array(F.lit(0)))


def _codes() -> Column:
    """One number for each symbol and the three before it. ``symbols`` must be a stored column: an expression would be worked out anew for each place."""
    code = lambda i: sum((F.element_at("symbols", i - k) * SYMBOLS**k for k in range(1, ORDER)), F.element_at("symbols", i))
    return F.transform(F.sequence(F.lit(ORDER), F.size("symbols")), code)


def _model(spark: SparkSession, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log ratios (code, ratio): after each known context of ORDER - 1 symbols, and after all contexts of one symbol less.

    judged: symbols, verdict. The tables have at most SYMBOLS**ORDER and exactly SYMBOLS**(ORDER - 1) rows.
    """
    seen = judged.select("verdict", F.explode(_codes()).alias("code")).groupBy("code").agg(F.count(F.when(F.col("verdict") == "allow", 1)).alias("allow"), F.count(F.when(F.col("verdict") == "block", 1)).alias("block"))
    seen = core.keep(spark, seen, "url_grams")

    def step(out: DataFrame, order: int) -> DataFrame:
        """Estimates after order - 1 symbols from those after one less."""
        gram = seen.groupBy((F.col("code") % SYMBOLS**order).alias("g")).agg(F.sum("allow").alias("g_allow"), F.sum("block").alias("g_block"))
        context = seen.groupBy((F.floor(F.col("code") / SYMBOLS) % SYMBOLS ** (order - 1)).cast("int").alias("h")).agg(F.sum("allow").alias("h_allow"), F.sum("block").alias("h_block"))
        out = out.withColumn("g", F.col("code") % SYMBOLS**order).withColumn("h", (F.floor(F.col("code") / SYMBOLS) % SYMBOLS ** (order - 1)).cast("int"))
        out = out.join(F.broadcast(gram), "g", "left").join(F.broadcast(context), "h", "left")
        return out.select("code", *[((F.coalesce(f"g_{c}", F.lit(0)) + STRENGTH * F.col(f"p_{c}")) / (F.coalesce(f"h_{c}", F.lit(0)) + STRENGTH)).alias(f"p_{c}") for c in ("allow", "block")])

    out = spark.range(SYMBOLS ** (ORDER - 1)).select(F.col("id").cast("int").alias("code"), *[F.lit(1.0 / SYMBOLS).alias(f"p_{c}") for c in ("allow", "block")])
    for order in range(1, ORDER):
        out = step(out, order)
    lower = core.keep(spark, out, "url_model_low")
    known = seen.select(F.floor(F.col("code") / SYMBOLS).cast("int").alias("c")).distinct().select(F.explode(F.sequence(F.col("c") * SYMBOLS, F.col("c") * SYMBOLS + SYMBOLS - 1)).alias("code"))
    low = F.broadcast(lower.withColumnRenamed("code", "l"))
    upper = step(known.join(low, F.col("code") % SYMBOLS ** (ORDER - 1) == F.col("l")).drop("l"), ORDER)
    ratio = F.log(F.col("p_allow") / F.col("p_block"))
    return core.keep(spark, upper.select("code", ratio.alias("ratio")), "url_model"), lower.select("code", ratio.alias("ratio"))


def _scored(urls: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """host, path, score of distinct urls(host, path, symbols): the mean log ratio of their symbols."""
    upper, lower = (m.select(F.col("code").alias(f"code_{i}"), F.col("ratio").alias(f"ratio_{i}")) for i, m in enumerate(model))
    each = urls.select("host", "path", F.explode(_codes()).alias("code"))
    each = each.join(F.broadcast(upper), F.col("code") == F.col("code_0"), "left").join(F.broadcast(lower), F.col("code") % SYMBOLS ** (ORDER - 1) == F.col("code_1"), "left")
    return each.groupBy("host", "path").agg(F.round(F.avg(F.coalesce("ratio_0", "ratio_1", F.lit(0.0))), 9).alias("score"))


def _cut(scored: DataFrame) -> float:
    """The cut with the best balanced accuracy; of equals the one nearest to 0."""
    bins = scored.select(F.floor(F.least(F.greatest(F.col("score"), F.lit(-8.0)), F.lit(8.0)) * _BINS).alias("bin"), "verdict")
    bins = bins.groupBy("bin").agg(F.count(F.when(F.col("verdict") == "allow", 1)).alias("a"), F.count(F.when(F.col("verdict") == "block", 1)).alias("b"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # 1,025 bins at most
    everything = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = bins.select("bin", F.coalesce(F.sum("a").over(upto), F.lit(0)).alias("lost"), F.coalesce(F.sum("b").over(upto), F.lit(0)).alias("caught"), F.sum("a").over(everything).alias("all_a"), F.sum("b").over(everything).alias("all_b"))
    worth = F.col("caught") / F.col("all_b") - F.col("lost") / F.col("all_a")
    best = below.where("all_a > 0 and all_b > 0").orderBy(worth.desc(), F.abs("bin"), "bin").first()
    return best["bin"] / _BINS if best else 0.0


def judge(spark: SparkSession, pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of pages(page_id, url)."""
    host, path = parts(F.col("url"))
    rule, says = rule_of(rules)
    pages = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumn("host", host).withColumn("path", path).drop("url")
    # Each distinct URL is judged once.
    urls = core.keep(spark, pages.select("host", "path").distinct().withColumns({"rule": rule, "says": says, "symbols": _symbols()}), "urls")
    urls = urls.repartition(core.partitions(spark), "host", "path")
    judged = urls.where("says is not null").withColumn("fold", F.conv(F.substring(F.md5(F.concat("host", "path")), 1, 7), 16, 10).cast("long") % 5)
    model = _model(spark, judged.where("fold <> 0").select("symbols", F.col("says").alias("verdict")))
    scored = core.keep(spark, _scored(urls.select("host", "path", "symbols"), model), "url_scores")
    cut = _cut(judged.where("fold = 0").select("host", "path", F.col("says").alias("verdict")).join(scored, ["host", "path"]))
    method = F.when(F.col("score") >= F.lit(cut), F.lit("allow")).otherwise(F.lit("block"))
    answers = urls.join(scored, ["host", "path"]).select("host", "path", "rule", F.coalesce("says", method).alias("verdict"), "score")
    return pages.join(answers, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "score")
