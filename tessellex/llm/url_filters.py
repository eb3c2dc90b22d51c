"""Allow and block rules for URLs, matched through hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import salted, small, stage
from .columns import apart, named, together

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that the join is on.
SHORT = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#`` or the end. Both empty without ``://`` or for null."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every label suffix of the host (itself included) joined to every prefix of the path that has one of the lengths."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def candidates(asked: DataFrame, rules: DataFrame, short: int = SHORT) -> DataFrame:
    """Each expression's digest (asked, once each) beside every rule whose digest begins with the same ``short`` hex digits; both digests are there to be compared."""
    return asked.withColumn("short", F.substring("asked", 1, short)).join(small(rules.withColumn("short", F.substring("full", 1, short))), "short")


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", short: int = SHORT) -> DataFrame:
    """df with host, path, rule (host and path of the rule that decides, else null) and verdict of each URL.

    rules has host, path and verdict (allow or block). A rule fits its host and all subdomains if the
    URL's path starts with the rule's path; the longest rule wins, then the one with the longer host,
    then block. Rows without a fitting rule get ``default``. Null rules' fields count as empty; null
    verdicts are left out. A null URL, or one without ``://``, has an empty host and path. Columns of
    df named like the four results, in any case of letters, are replaced by them; all others stay.
    Rows repeat as they do in df.

    Different (host, path) pairs are expanded once, so a host with very many rows costs one. Each
    different expression's SHA-256, with how many pairs have it, is joined once with the rules' on the
    first ``short`` hex digits alone, so that a suffix which nearly every pair has is one row there; what
    meets is confirmed by the whole digest. What is confirmed goes back to the pairs: broadcast if its
    measured bytes allow it, else by a shuffle that deals such expressions out. Only pairs that have a rule are joined back: broadcast if their
    measured bytes allow it, else by a shuffle that deals hot pairs out. The driver gets the different
    lengths of the rules' paths, which a path's longest length bounds.
    """
    given = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rh"), F.coalesce("path", F.lit("")).alias("rp"), F.col("verdict").alias("rv")).filter("rv is not null")
    lengths = sorted(r[0] for r in given.select(F.length("rp")).distinct().collect())
    host, path = host_and_path(named(url))
    placed = apart(df, "host", "path", "rule", "verdict", host=host, path=path)
    if not lengths:
        return together(placed, host=F.col("host"), path=F.col("path"), rule=F.lit(None).cast("string"), verdict=F.lit(default))
    rank = F.struct((F.length("rh") + F.length("rp")).alias("n"), F.length("rh").alias("h"), (F.col("rv") == "block").alias("b"), F.concat("rh", "rp").alias("rule"), F.col("rv").alias("verdict"))
    keyed = stage(given.select(F.sha2(F.concat("rh", "rp"), 256).alias("full"), rank.alias("rank")).groupBy("full").agg(F.max("rank").alias("rank")), "rules")
    pairs = placed.select("host", "path").distinct()
    every = pairs.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("e")).select("host", "path", F.sha2("e", 256).alias("asked"))
    met = candidates(every.groupBy("asked").agg(F.count("*").alias("many")), keyed, short).filter(F.col("asked") == F.col("full"))
    fit = stage(met.select("asked", "many", "rank"), "fit")
    ranks = fit.select("asked", "rank")
    held = small(ranks)
    fitting = every.join(held, "asked") if held is not ranks else salted(every, ranks, ["asked"], counts=fit.select("asked", "many"))
    best = stage(fitting.groupBy("host", "path").agg(F.max("rank").alias("rank")), "ruled")
    held = small(best)
    judged = placed.join(held, ["host", "path"], "left") if held is not best else salted(placed, best, ["host", "path"], "left")
    return together(judged, host=F.col("host"), path=F.col("path"), rule=F.col("rank.rule"), verdict=F.coalesce("rank.verdict", F.lit(default)))
