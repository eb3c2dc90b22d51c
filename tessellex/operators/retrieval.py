"""Sparse retrieval over an inverted index of fielded documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.staging import stage
from .ids import dense_ids

K1, B = 1.2, 0.75


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def inverted_index(docs: DataFrame, doc: str, fields: dict[str, float]) -> DataFrame:
    """(field, token, doc, tf, length): how often each token stands in each field of each document."""
    each = [docs.select(F.lit(f).alias("field"), F.col(doc).alias("doc"), tokens(F.coalesce(F.col(f), F.lit(""))).alias("t")) for f in fields]
    every = each[0]
    for e in each[1:]:
        every = every.unionByName(e)
    return every.select("field", "doc", F.size("t").alias("length"), F.explode("t").alias("token")).groupBy("field", "token", "doc").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


#: Documents in a block; blocks that give a query its first floor; queries or blocks of one token that meet in one task.
BLOCK, SEEDS, DEAL = 64, 4, 2048


def weighted(index: DataFrame, documents: int, fields: dict[str, float], tokens_: DataFrame | None = None) -> DataFrame:
    """(token, doc, s): what each token adds to a document's BM25 over weighted fields; of the tokens asked for, if any are."""
    kept = index if tokens_ is None else index.join(tokens_, "token", "left_semi")
    spread = index.groupBy("field", "doc").agg(F.first("length").alias("length")).groupBy("field").agg(F.sum("length").alias("all"))
    frequency = kept.groupBy("field", "token").agg(F.count("*").alias("df"))
    weight = F.create_map(*(F.lit(x) for kv in fields.items() for x in kv))
    idf = F.log(1 + (documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = F.col("all") / F.lit(documents)
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    each = kept.join(frequency, ["field", "token"]).join(F.broadcast(spread), "field").select("token", "doc", (weight[F.col("field")] * idf * gain).alias("s"))
    return each.groupBy("token", "doc").agg(F.sum("s").alias("s"))


def in_blocks(scored: DataFrame, block: int = BLOCK) -> DataFrame:
    """scored with the block of each document: documents in the order of the token that adds most to them, so that those that share a rare word stand together, cut into equal ranges."""
    heads = scored.groupBy("doc").agg(F.max_by("token", F.struct("s", "token")).alias("head"))
    placed = dense_ids(heads, ["head", "doc"], "n", 0).select("doc", F.floor(F.col("n") / block).alias("block"))
    return scored.join(placed, "doc")


class Report:
    """How many (query, token, document) rows a retrieval added up, and how many there are."""

    read = every = 0


def bm25(index: DataFrame, documents: int, asked: DataFrame, fields: dict[str, float], top: int = 80, boost: DataFrame | None = None, block: int = BLOCK, report: Report | None = None) -> DataFrame:
    """(query, rank, doc, score): each query's best documents by weighted BM25 over fields, plus log(links + 1) where boost (doc, links) is given; ties to the smaller doc.

    asked has query and text; scores are rounded to 9 places. Postings stand in blocks of documents, each
    token with the most it adds in a block. The sum of these is a bound for a query's documents of
    that block: the SEEDS blocks of the largest bound are added up first, and their top-th score is
    the query's floor; of the others only blocks whose bound reaches it are read. No document that could
    be among the best is left out. Tokens that very many queries and blocks have are dealt into tasks
    of DEAL by DEAL, and postings join by token and block, so that a stop word is no hot key.
    """
    index = stage(index, "index")
    wanted = stage(asked.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")), "wanted")
    scored = stage(in_blocks(weighted(index, documents, fields, wanted.select("token").distinct()), block), "postings")
    extra = F.log(F.coalesce("links", F.lit(0)) + 1)
    added = stage(boost.select("doc", extra.alias("extra")), "boost") if boost is not None else None
    most = scored.groupBy("token", "block").agg(F.max("s").alias("most"))
    deals = lambda f, name: f.groupBy("token").agg(F.ceil(F.count("*") / DEAL).cast("int").alias(name))
    dealt = stage(deals(wanted, "dq").join(deals(most, "db"), "token"), "deals")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = wanted.join(dealt, "token").select("query", "token", F.pmod(F.xxhash64("query"), "dq").cast("int").alias("qd"), every("db").alias("bd"))
    right = most.join(dealt, "token").select("token", "block", "most", F.pmod(F.xxhash64("block"), "db").cast("int").alias("bd"), every("dq").alias("qd"))
    bounds = left.join(right, ["token", "qd", "bd"]).groupBy("query", "block").agg(F.sum("most").alias("bound"))
    if added is not None:
        high = scored.select("doc", "block").distinct().join(added, "doc").groupBy("block").agg(F.max("extra").alias("extra"))
        bounds = bounds.join(high, "block", "left").select("query", "block", (F.col("bound") + F.coalesce("extra", F.lit(0.0))).alias("bound"))
    order = F.row_number().over(W.Window.partitionBy("query").orderBy(F.desc("bound"), "block"))
    bounds = stage(bounds.withColumn("place", order), "bounds")

    def totals(pairs: DataFrame) -> DataFrame:
        found = pairs.select("query", "block").join(wanted, "query").join(scored, ["token", "block"]).groupBy("query", "doc").agg(F.sum("s").alias("score"), F.count("*").alias("read"))
        if added is not None:
            found = found.join(added, "doc", "left").withColumn("score", F.col("score") + F.coalesce("extra", F.lit(0.0)))
        return found.select("query", "doc", F.round("score", 9).alias("score"), "read")

    ranked = lambda f: f.withColumn("rank", F.row_number().over(W.Window.partitionBy("query").orderBy(F.desc("score"), "doc"))).filter(F.col("rank") <= top)
    first = stage(totals(bounds.filter(F.col("place") <= SEEDS)), "first")
    floors = ranked(first).filter(F.col("rank") == top).select("query", F.col("score").alias("floor"))
    rest = bounds.filter(F.col("place") > SEEDS).join(floors, "query", "left").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-6))
    both = first.unionByName(totals(rest))
    if report is not None:
        both = stage(both, "both")
        report.read = both.agg(F.sum("read")).first()[0] or 0
        report.every = wanted.join(scored.groupBy("token").agg(F.count("*").alias("n")), "token").agg(F.sum("n")).first()[0] or 0
    return ranked(both).select("query", "rank", "doc", "score")
