"""URL filters, in DataFrame functions only: rules first, then character models of accepted and rejected URLs.

Of the URLs that a rule decides, four in five, picked by hash, train two variable-order Markov models (one of the allowed, one
of the blocked). A character's probability backs off from the longest context to the shortest, each smoothed by how
many different characters followed it. A URL is judged by the difference of its log-likelihoods, divided by its
length, against a threshold calibrated on the fifth of the URLs with a rule that the models have not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chunks, windows
from .common import discard, written

#: Rules' URLs whose hash leaves 0 by this number calibrate the threshold; the others train.
HELD_OUT = 5
#: Most rows of the table of likelihoods (each under 40 bytes) that are sent to every executor; beyond, the join shuffles.
BROADCAST_GRAMS = 200_000
#: Parts into which the pages of one URL are dealt, and the URLs of one gram where grams are joined by a shuffle.
SALTS, GRAM_SALTS = 64, 1024

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest(url: Column) -> Column:
    """What follows the first `://`; empty for null or where there is none."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.substr(rest(url), F.length(F.regexp_extract(rest(url), r"^[^/?#]*", 0)) + 1), r"^[^?#]*", 0)


def rule(rules: list[tuple[str, str]], h: Column, p: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; a rule is (verdict, host/path)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        rh, slash, rp = r.partition("/")
        fits = ((h == rh) | h.endswith(f".{rh}")) & p.startswith(slash + rp)
        name, verdict = F.when(fits, F.lit(r)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _grams(df: DataFrame, order: int, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns and gram: each character of `text` with the `order` characters before it; \\u0001 stands before the start.

    A place in a string is found by walking from its start, so grams are taken from short parts.
    """
    held = df.where(F.length("text") > 0).select(*keep, F.concat(F.lit("\u0001" * order), F.col("text")).alias("part"))
    for size in (8192, 128):
        held = held.select(*keep, F.explode(chunks(F.col("part"), order + 1, size)).alias("c")).select(*keep, F.col("c.part").alias("part"))
    return held.select(*keep, F.explode(windows(F.col("part"), order + 1)).alias("gram"))


def likelihoods(train: DataFrame, grams: DataFrame, order: int) -> DataFrame:
    """(gram, difference): log p(last character | the others) of accepted less that of rejected URLs.

    train has text and good (boolean). Goes from the shortest contexts to the longest. Each join is on keys that one
    side has once and the other at most once for each character there is, so no key grows with the corpus.
    """
    counted = written(_grams(train, order, ("good",)).groupBy("gram").agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("r")), "grams")
    below = None
    for k in range(order + 1):
        tail = lambda size: F.substr(F.col("gram"), F.lit(order + 1 - size), F.lit(size + 1))
        n = counted.groupBy(tail(k).alias("s")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = F.substr("s", F.lit(1), F.lit(k))
        by_context = n.groupBy(context.alias("c")).agg(F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr"))
        wanted = grams.select(tail(k).alias("s")).distinct().withColumn("c", context)
        held = wanted.join(n, "s", "left").join(by_context, "c", "left").fillna(0, ["a", "r", "na", "nr", "ta", "tr"])
        if below is None:
            held = held.withColumn("pa", F.lit(1.0 / 256)).withColumn("pr", F.lit(1.0 / 256))
        else:
            held = held.withColumn("t", F.substr("s", F.lit(2), F.lit(k))).join(below, "t")
        smooth = lambda x, total, kinds, p: F.when(F.col(total) > 0, (F.col(x) + F.col(kinds) * F.col(p)) / (F.col(total) + F.col(kinds))).otherwise(F.col(p))
        here = held.select("s", smooth("a", "na", "ta", "pa").alias("pa"), smooth("r", "nr", "tr", "pr").alias("pr"))
        below = written(here, "smoothed").withColumnRenamed("s", "t")
    return below.select(F.col("t").alias("gram"), (F.log("pa") - F.log("pr")).alias("difference"))


def threshold(scores: DataFrame) -> float:
    """What best parts the scores of accepted from those of rejected URLs, of 2 * 199 quantiles, in the middle of its gap; 0 where a
    kind is missing."""
    steps = [i / 200 for i in range(1, 200)]
    rows = {r["good"]: r["q"] for r in scores.groupBy("good").agg(F.percentile_approx("score", steps, 10_000).alias("q")).collect()}
    good, bad = rows.get(True), rows.get(False)
    if not good or not bad:
        return 0.0
    least = min(sorted(good + bad), key=lambda t: sum(x < t for x in good) + sum(x >= t for x in bad))
    return (least + max((x for x in good + bad if x < least), default=least)) / 2


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", order: int = 4) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    Where no rule fits, a URL whose score reaches the calibrated threshold is allowed. Null URLs and those without
    `://` have an empty host and path, no rule and score 0. Each different URL is scored once, so repeated rows cost
    nothing and agree. Null ids are passed on. Other columns are not read; an empty table gives an empty result. Without both
    kinds of URLs among those held out the threshold is 0; where the models lack a kind, that one is flat.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    named = src.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.translate(rest(F.col("url")), _UPPER, _LOWER).alias("text"))
    fitted, verdict = rule(rules, F.col("host"), F.col("path"))
    named = named.withColumn("rule", fitted).withColumn("ruled", verdict)
    kind = F.max(F.when(F.col("ruled") == "allow", 1).when(F.col("ruled") == "block", 0)).alias("kind")
    # A number, written once, stands for each URL from here on.
    urls = written(named.groupBy("text").agg(kind).withColumn("uid", F.monotonically_increasing_id()), "urls")
    held_out = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    train = urls.where("kind is not null").where(~held_out).select("text", (F.col("kind") == 1).alias("good"))
    grams = written(_grams(urls, order, ("uid",)), "url_grams")
    table = likelihoods(train, grams.select("gram").distinct(), order)
    if table.count() <= BROADCAST_GRAMS:
        valued = grams.join(F.broadcast(table), "gram")
    else:
        # All URLs may share a gram: theirs are dealt to parts. A rare gram has no more parts than URLs.
        dealt = grams.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(GRAM_SALTS)))
        valued = dealt.join(dealt.select("gram", "salt").distinct().join(table, "gram"), ["gram", "salt"])
    summed = valued.groupBy("uid").agg(F.avg("difference").alias("score"))
    scored = written(urls.join(summed, "uid", "left").select("text", "kind", F.coalesce("score", F.lit(0.0)).alias("score")), "scored")
    discard(grams)
    discard(urls)
    least = threshold(scored.where("kind is not null").where(held_out).select((F.col("kind") == 1).alias("good"), "score"))
    own = F.when(F.col("score") >= F.lit(least), F.lit("allow")).otherwise(F.lit("block"))
    # Many pages may have one URL: theirs are dealt to parts.
    dealt = named.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    salts = dealt.select("text", "salt").distinct().join(scored.select("text", "score"), "text")
    return dealt.join(salts, ["text", "salt"]).select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")
