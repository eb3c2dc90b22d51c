"""Nearest neighbours by inner product: randomly rotated one-bit codes, then exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.staging import stage
from .columns import named

#: Standard deviations of an estimate's error that the bound allows.
CONFIDENCE = 3.0
#: Bits of a code at least: shorter vectors are padded by zeros before they are rotated, which halves the error for each four times of bits.
CODE_BITS = 512
#: Rows that a task holds, with their codes; queries that pass by them in one task; and tasks that there are at least, down to LEAST_BLOCK rows.
DATA_BLOCK, QUERY_GROUP, TASKS, LEAST_BLOCK = 1 << 16, 1 << 20, 24, 1024
#: Queries that are estimated at once, and rows of a block that are.
QUERY_BATCH, ROW_BATCH = 64, 8192


@lru_cache(maxsize=8)
def rotation(dim: int, bits: int, seed: int = 7) -> np.ndarray:
    """The first dim rows of a random orthogonal matrix of that many bits, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim].astype(np.float32)


def code_bits(dim: int) -> int:
    return max(CODE_BITS, -(-dim // 8) * 8)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of each rotated vector; the factor that turns their product with a rotated query into an estimate; and the estimate's error for a query of norm 1.

    A vector's direction o and its sign vector x (of norm 1) have the product a; x.q / a estimates
    o.q without bias, and errs by sqrt((1 - a^2) / (a^2 (bits - 1))) in the standard deviation.
    """
    bits = code_bits(vectors.shape[1])
    norms = np.linalg.norm(vectors, axis=1)
    turned = (vectors / norms[:, None]).astype(np.float32) @ rotation(vectors.shape[1], bits)
    a = np.abs(turned).sum(axis=1) / np.sqrt(bits)
    error = norms * np.sqrt(np.maximum(0, 1 - a**2) / a**2 / max(1, bits - 1))
    return np.packbits(turned > 0, axis=1), (norms / a / np.sqrt(bits)).astype(np.float32), error.astype(np.float32)


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last, as a plain loop does."""
    return np.cumsum(vectors.astype(np.float64) * query, axis=1)[:, -1]


class Block:
    """Rows with their codes, which queries are held against; ``computed`` counts the exact products, ``pairs`` all of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bits: np.ndarray, factor: np.ndarray, error: np.ndarray):
        self.ids, self.vectors, self.bits, self.factor = ids, vectors, bits, factor
        self.spread = CONFIDENCE * error + 1e-5 * np.sqrt(bits.shape[1] * 8) * factor  # and what float32 rounds off
        self.computed = self.pairs = 0

    def estimates(self, queries: np.ndarray) -> np.ndarray:
        """A row a query: x.q / a of every row, from its bits. Signs are unpacked ROW_BATCH rows at a time: twice the sum over set bits less the sum over all."""
        turned = queries.astype(np.float32) @ rotation(queries.shape[1], self.bits.shape[1] * 8)
        out = np.empty((len(queries), len(self.ids)), dtype=np.float32)
        for k in range(0, len(self.ids), ROW_BATCH):
            ones = np.unpackbits(self.bits[k : k + ROW_BATCH], axis=1).astype(np.float32)
            out[:, k : k + ROW_BATCH] = 2 * (turned @ ones.T) - turned.sum(axis=1)[:, None]
        return out * self.factor

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        """(place of the query, id, inner product): of each query the k nearest rows, as far as estimates let them through; a row with the query's id is none.

        The rows of the largest estimates are computed first; the k-th of these is a floor. Every row
        whose estimate plus its error bound reaches the floor is then computed.
        """
        probes = min(len(self.ids), 3 * k + 1)
        for begin in range(0, len(queries), QUERY_BATCH):
            some = queries[begin : begin + QUERY_BATCH]
            norms = np.linalg.norm(some, axis=1)
            estimates = self.estimates(some)
            for i, query in enumerate(some):
                mine = self.ids == query_ids[begin + i]
                first = np.argpartition(-estimates[i], probes - 1)[:probes]
                first = first[~mine[first]]
                scores = exact(self.vectors[first], query)
                floor = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
                rest = estimates[i] + norms[i] * self.spread >= floor
                rest[mine] = rest[first] = False
                at = np.flatnonzero(rest)
                scores = np.concatenate([scores, exact(self.vectors[at], query)])
                at = np.concatenate([first, at])
                self.computed += len(at)
                self.pairs += len(self.ids)
                for j in np.lexsort((self.ids[at], -scores))[:k]:
                    yield begin + i, int(self.ids[at[j]]), float(scores[j])


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite, and isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", data_block: int | None = None, query_group: int = QUERY_GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other rows by inner product, nearest first, ties to the smaller vec_id.

    Queries are the rows of df for which ``is_query`` (over vec_id) holds; all rows with another id are
    candidates, and all if they are fewer than k. Scores are exact inner products of the vectors as
    doubles. Vectors that are null, empty, zero or hold a null or non-finite component take no part,
    nor do rows without an id. Rows that repeat id and vector count once; different vectors of one id
    are rows of their own, so such an id may come twice, and as a query has an answer for each vector.
    Vectors meet those of their own length only. Other columns of df don't matter.

    All rows are encoded, and dealt into blocks of at most ``data_block`` (None: DATA_BLOCK, less for
    small tables, so that there are TASKS). A task holds one block; the queries, up to ``query_group``
    of them, pass by it in batches. So a vector moves once for each query group, a query once for each
    block, and at most k rows a query and block come out, however many are alike. Which rows are
    computed exactly follows from error bounds, which hold with high probability, so a near neighbour
    is missed rarely.
    """
    element = df.schema[vector].dataType.elementType.simpleString()
    kept = "float" if element in ("float", "tinyint", "smallint") else "double"  # exact in both
    vectors = df.select(named(vec_id).cast("long").alias("id"), named(vector).cast(f"array<{kept}>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v"))).distinct()

    def code(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, same in part.groupby(part["v"].map(len)):
                bits, factor, error = encode(np.stack(same["v"]).astype(np.float64))
                yield same.assign(bits=[b.tobytes() for b in bits], factor=factor, error=error)

    coded = stage(vectors.mapInPandas(code, f"id long, v array<{kept}>, bits binary, factor float, error float"), "codes")
    asked = coded.withColumn(vec_id, F.col("id")).withColumn("asks", is_query).select(F.size("v").alias("dim"), F.xxhash64("id", "v").alias("h"), "id", "v", "bits", "factor", "error", F.coalesce("asks", F.lit(False)).alias("asks"))
    block = F.lit(data_block) if data_block else F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(DATA_BLOCK), F.ceil(F.count("*") / TASKS)))
    sizes = asked.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.ceil(F.count_if("asks") / query_group).cast("int").alias("groups")).filter("groups > 0")
    sizes = stage(sizes.withColumn("before", (F.sum(F.col("blocks") * F.col("groups")).over(W.Window.orderBy("dim")) - F.col("blocks") * F.col("groups")).cast("int")), "sizes")  # a row for each length of vectors
    tasks = sizes.agg(F.sum(F.col("blocks") * F.col("groups"))).first()[0] or 1
    dealt = asked.join(F.broadcast(sizes), "dim")
    task = lambda block, group: F.col("before") + block * F.col("groups") + group
    none, every = F.lit(None), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = dealt.withColumn("g", every("groups")).select(task(F.pmod("h", "blocks").cast("int"), F.col("g")).alias("task"), F.lit(False).alias("asks"), "h", "id", "v", "bits", "factor", "error")
    asks = dealt.filter("asks").withColumn("b", every("blocks")).select(task(F.col("b"), F.pmod(F.xxhash64("h"), "groups").cast("int")).alias("task"), F.lit(True).alias("asks"), "h", "id", "v", none.cast("binary").alias("bits"), none.cast("float").alias("factor"), none.cast("float").alias("error"))

    def pass_by(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, data = None, [], None
        for part in parts:
            for at, same in part.groupby("task", sort=False):
                if at != now:
                    now, held, data = at, [], None
                own, query = same[~same["asks"]], same[same["asks"]]
                if len(own):  # rows stand before queries
                    held.append((own["id"].to_numpy(), np.stack(own["v"]), np.frombuffer(b"".join(own["bits"]), dtype=np.uint8).reshape(len(own), -1), own["factor"].to_numpy(), own["error"].to_numpy()))
                if len(query) and held:
                    data = data or Block(*map(np.concatenate, zip(*held)))
                    ids, hashes = query["id"].to_numpy(), query["h"].to_numpy()
                    found = [(ids[q], hashes[q], i, s) for q, i, s in data.best(ids, np.stack(query["v"]).astype(np.float64), k)]
                    yield pd.DataFrame(found, columns=["query_id", "h", "vec_id", "score"])

    met = rows.unionByName(asks).repartitionById(tasks, F.col("task")).sortWithinPartitions("task", "asks").mapInPandas(pass_by, "query_id long, h long, vec_id long, score double")
    nearest = W.Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
