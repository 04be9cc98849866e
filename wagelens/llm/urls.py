"""Verdicts on urls: rules by host and path, and a character language model for the rest.

Urls that a rule allows or blocks are the training texts of two models. Each is a Markov model
of variable order: the chance of a character after up to four others, smoothed by the next
shorter context (Witten and Bell), down to a uniform one. A url without a rule is allowed if
the difference of its log-likelihoods per character reaches a threshold, which urls with a
rule that were held back from the models have set.

Built-in functions only; nothing here runs Python on rows. Every table of n-grams grows with
the corpus, and all joins are shuffles on n-grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wagelens.llm.tables import bound, held_out
from wagelens.session import staged

# Fixed values: (host, start of path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
ORDER = 5  # letters of an n-gram: four of context and one
BEGIN, END = "\2", "\3"
_BINS = 1_000  # steps of the threshold per unit of log-likelihood a character


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ``://``."""
    known = F.coalesce(url, F.lit(""))
    at = F.locate("://", known)
    rest = F.when(at > 0, F.substring(known, at + 3, F.length(known))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule, as its text and its verdict; both null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, start, judged in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name = F.when(fits, F.lit(domain + start)).otherwise(name)
        verdict = F.when(fits, F.lit(judged)).otherwise(verdict)
    return name, verdict


def _grams(url: Column) -> Column:
    """An n-gram for every character of a url and its end, contexts padded in front."""
    return bound(
        F.concat(F.array_repeat(F.lit(BEGIN), ORDER - 1), F.filter(F.split(url, ""), lambda c: c != ""), F.array(F.lit(END))),
        lambda letters: F.transform(
            F.sequence(F.lit(0), F.size(letters) - ORDER),
            lambda i: F.concat(*[F.get(letters, i + k) for k in range(ORDER)]),
        ),
    )


def _log_ratios(counted: DataFrame) -> DataFrame:
    """``gram, ratio`` from ``gram, allow, block``, counts of all n-grams of full order.

    Table k holds the chances of k letters; it takes the shorter context's from table k - 1. A
    context or an ending stands in at most as many n-grams as there are letters, so no key of
    these joins is hot.
    """
    tables = [counted]
    for size in range(ORDER - 1, 0, -1):
        shorter = tables[0].groupBy(F.right("gram", F.lit(size)).alias("gram"))
        tables.insert(0, shorter.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    below = None
    for size, table in enumerate(tables, 1):
        context = F.substring("gram", 1, size - 1) if size > 1 else F.lit("")
        named = table.withColumn("context", context)
        totals = named.groupBy("context").agg(
            *[F.sum(v).alias(f"n_{v}") for v in ("allow", "block")],
            *[F.sum((F.col(v) > 0).cast("bigint")).alias(f"kinds_{v}") for v in ("allow", "block")],
        )
        joined = named.join(totals, "context")
        if below is None:
            joined = joined.withColumns({"below_allow": F.lit(1 / 256), "below_block": F.lit(1 / 256)})
        else:
            joined = joined.withColumn("ending", F.right("gram", F.lit(size - 1))).join(
                below.select(F.col("gram").alias("ending"), F.col("p_allow").alias("below_allow"), F.col("p_block").alias("below_block")),
                "ending",
            )
        chances = {
            f"p_{v}": F.when(F.col(f"n_{v}") == 0, F.col(f"below_{v}")).otherwise(
                (F.col(v) + F.col(f"kinds_{v}") * F.col(f"below_{v}")) / (F.col(f"n_{v}") + F.col(f"kinds_{v}"))
            )
            for v in ("allow", "block")
        }
        below = staged(joined.withColumns(chances).select("gram", "p_allow", "p_block"), f"chances{size}")
    return staged(below.select("gram", (F.log("p_allow") - F.log("p_block")).alias("ratio")), "ratios")


def _threshold(scored: DataFrame) -> DataFrame:
    """One row: the cut with the best mean of both classes' shares judged right.

    From counts by steps of a thousandth, so from a bounded number of rows; ties go to the
    cut nearest 0, and without urls of both verdicts the cut is 0.
    """
    steps = F.greatest(F.least(F.floor(F.col("score") * _BINS), F.lit(20 * _BINS)), F.lit(-20 * _BINS))
    bins = scored.groupBy(steps.cast("int").alias("step")).agg(
        F.sum(F.when(F.col("verdict") == "allow", F.col("pages")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("verdict") == "block", F.col("pages")).otherwise(0)).alias("bad"),
    )
    every, upwards = W.partitionBy(), W.orderBy(F.col("step").desc())
    right = F.sum("good").over(upwards) / F.sum("good").over(every)
    wrong = F.sum("bad").over(upwards) / F.sum("bad").over(every)
    best = bins.select("step", (right - wrong).alias("gain")).where("gain IS NOT NULL")
    return best.agg(
        F.max(F.struct("gain", (-F.abs("step")).alias("near"), "step")).alias("best")
    ).select(F.coalesce(F.col("best.step") / _BINS, F.lit(0.0)).alias("threshold"))


def judged_pages(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages``.

    The score is the mean log-likelihood ratio a character, allow against block, rounded to
    nine places; a null url is judged as an empty one. Urls that repeat are scored once.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("address"),
        host.alias("host"), path.alias("path"),
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    ruled = rows.withColumns({"rule": rule, "by_rule": verdict})
    distinct = staged(
        ruled.groupBy("address").agg(F.count(F.lit(1)).alias("pages"), F.first("by_rule").alias("verdict")), "urls"
    )
    spread = distinct.select("address", "pages", "verdict", F.explode(_grams(F.col("address"))).alias("gram"))
    learns = ~held_out(F.col("address"))
    part = lambda v: F.sum(F.when((F.col("verdict") == v) & learns, F.col("pages")).otherwise(0))
    counted = staged(spread.groupBy("gram").agg(part("allow").alias("allow"), part("block").alias("block")), "grams")
    ratios = _log_ratios(counted)
    scored = spread.join(ratios, "gram").groupBy("address", "pages", "verdict").agg(
        F.round(F.avg("ratio"), 9).alias("score")
    )
    scored = staged(scored, "scored_urls")
    cut = _threshold(scored.where(F.col("verdict").isNotNull() & held_out(F.col("address")))).first()
    allowed = F.when(F.col("score") >= F.lit(cut.threshold), F.lit("allow")).otherwise(F.lit("block"))
    return ruled.join(scored.select("address", "score"), "address").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", allowed).alias("verdict"), "score"
    )
