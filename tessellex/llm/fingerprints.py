"""Locality-sensitive document fingerprints: quartile digests of hashed byte triplets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import apart, named, together

#: Buckets of a digest. Two bits say in which quartile of the counts a bucket lies.
BUCKETS = 256
#: Odd multipliers of the triplet hash, by place in the triplet, and the six triplets of a five-byte window that hold its first byte.
FACTORS = (2654435761, 2246822519, 3266489917)
TRIPLETS = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))
#: Differences at which likeness is 0: what unrelated bodies differ by on average, and the cap of the header's share.
BODY_BOUND, HEADER_BOUND = 1.625 * BUCKETS, 64


def bucket_counts(data: bytes) -> np.ndarray:
    """How often each bucket is hit by the hashed triplets of a sliding window of five bytes; short data is padded by zero bytes."""
    if not data:
        return np.zeros(BUCKETS, dtype=np.int64)
    x = np.frombuffer(data.ljust(5, b"\0"), dtype=np.uint8).astype(np.uint32)
    first, second, third = (x * np.uint32(f) for f in FACTORS)
    n = len(x) - 4
    out = np.zeros(BUCKETS, dtype=np.int64)
    for k, (i, j) in enumerate(TRIPLETS):
        h = first[:n] + second[i : i + n] + third[j : j + n] + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        out += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return out


def digest(text: str) -> str:
    """The fingerprint of a text: hex of its length code (2 digits), two quartile ratios (1 each) and two bits a bucket.

    The length code is the logarithm of the UTF-8 length to the base 1.1; the ratios are the first
    and second quartile of the counts in sixteenths of the third. Equal texts have equal
    fingerprints; the empty text has only zeros.
    """
    data = text.encode("utf-8", "replace")
    counts = bucket_counts(data)
    ordered = np.sort(counts)
    q1, q2, q3 = (ordered[BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    length = min(255, round(np.log(len(data) + 1) / np.log(1.1)))
    ratios = (int(15 * q1 // q3) << 4 | int(15 * q2 // q3)) if q3 else 0
    levels = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = levels.reshape(-1, 4) << np.array([6, 4, 2, 0], dtype=np.uint8)
    return f"{length:02x}{ratios:02x}" + packed.sum(axis=1, dtype=np.uint8).tobytes().hex()


def parsed(fingerprint: str) -> tuple[int, int, int, np.ndarray]:
    data = np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8)
    return int(data[0]), int(data[1]) >> 4, int(data[1]) & 15, (data[2:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8) & 3).ravel().astype(np.int8)


#: A bucket's difference by how many quartiles it moved: opposite ends weigh more.
STEP = np.array([0, 1, 2, 6])


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints down to 0: 1 less the bounded difference score.

    The score adds the moves of all buckets, and up to HEADER_BOUND for the distance of the length
    codes and quartile ratios, over BODY_BOUND + HEADER_BOUND; it ends at 1.
    """
    if a == b:
        return 1.0
    (la, ra, sa, xa), (lb, rb, sb, xb) = parsed(a), parsed(b)
    header = min(HEADER_BOUND, 2 * abs(la - lb) + 2 * (abs(ra - rb) + abs(sa - sb)))
    return max(0.0, 1 - (int(STEP[np.abs(xa - xb)].sum()) + header) / (BODY_BOUND + HEADER_BOUND))


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of each whole text; a null text counts as empty. A column of that name, in any case of letters, is replaced."""

    @F.pandas_udf("string")
    def digests(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(x or "") for x in texts])

    held = apart(df, out, text=F.coalesce(named(text), F.lit(""))).withColumn("digest", digests("text"))
    return together(held, **{out: F.col("digest")})


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(own: str, after: str) -> str:
    """own, its last half replaced by as much of the beginning of after, or all of that."""
    half = len(own) // 2
    return own[: len(own) - half] + after[:half]


def _range_of(ids: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts an id reaches: first among every g-th cut, then among the g that follow; a null id reaches none."""
    if not cuts:
        return F.lit(0)
    g = isqrt(len(cuts)) + 1
    reached = lambda some: F.size(F.filter(some, lambda c: c <= ids))
    group = reached(F.array(*map(F.lit, cuts[::g])))
    inner = reached(F.slice(F.array(*map(F.lit, cuts)), (group - 1) * g + 1, F.lit(g)))
    return F.when(ids.isNull() | (group == 0), 0).otherwise((group - 1) * g + inner)


def against_edits(df: DataFrame, text: str = "text", doc_id: str = "doc_id", parts: int | None = None) -> DataFrame:
    """EDITED's columns for each row: its fingerprint, that of its edited text, and likeness to that and to the next row's.

    The next row is the one after it by ascending doc_id (null ids first, repeated ids by text), after
    the last the first; a row alone is its own next. Null texts count as empty. Other columns of df
    don't matter; an empty table gives no rows.

    Rows go once to ``parts`` ranges of ids (the session's shuffle partitions if None), whose bounds
    are percentiles of all ids; the first row of each range also goes to the range before it. So each
    task walks its range in order and holds one row besides an Arrow batch.
    """
    spark = df.sparkSession
    source = df.select(named(doc_id).cast("long").alias("doc_id"), F.coalesce(named(text), F.lit("")).alias("text"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = source.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else []
    ids = F.col("doc_id")
    placed = source.withColumn("part", _range_of(ids, sorted(set(cuts or []))))
    firsts = {r["part"]: r["least"]["doc_id"] for r in placed.groupBy("part").agg(F.min(F.struct("doc_id")).alias("least")).collect()}
    if not firsts:
        return spark.createDataFrame([], EDITED)
    used, most = sorted(firsts), max(firsts) + 1
    before = {p: used[k - 1] for k, p in enumerate(used)}
    at = lambda values: F.get(F.array(*(F.lit(v).cast("long") for v in values)), F.col("part"))
    least, ahead = at([firsts.get(p) for p in range(most)]), at([before.get(p, 0) for p in range(most)]).cast("int")
    own, extra = F.struct(F.col("part").alias("p"), F.lit(False).alias("extra")), F.struct(ahead.alias("p"), F.lit(True).alias("extra"))
    dealt = placed.withColumn("c", F.explode(F.when(ids.eqNullSafe(least), F.array(own, extra)).otherwise(F.array(own))))
    # the id travels as text: Arrow's nulls would make it a float
    dealt = dealt.select("c.p", "c.extra", "doc_id", "text").repartitionById(most, F.col("p")).sortWithinPartitions("p", "extra", "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("string"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, over = None, None  # the row that waits for its next one; the range that has met its extra row
        for batch in batches:
            rows = []
            for p, extra, doc, body in zip(batch["p"], batch["extra"], batch["doc_id"], batch["text"]):
                if extra and over == p:
                    continue
                own = (p, None if doc is None else int(doc), body, digest(body))
                if last is not None:
                    changed = edited(last[2], body)
                    other = digest(changed)
                    rows.append((last[1], len(last[2]), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), last[3], other, likeness(last[3], other), likeness(last[3], own[3])))
                last, over = (None, p) if extra else (own, over)
            frame = pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return dealt.mapInPandas(walk, EDITED)
