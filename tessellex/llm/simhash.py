"""SimHash fingerprints of word shingles and their classes through Golay-code keys; classes of near-equal shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.staging import release, salted, small, stage
from ..operators.graph import connected_components
from .columns import named

BITS = 64
#: The [23,12,7] Golay code's generator polynomial, its length and the length of its check part.
GENERATOR, LENGTH, CHECK = 0xC75, 23, 11
#: Every word of 23 bits lies within 3 of a codeword, so two words at distance 2 have a word between them and share a codeword within 4 of both.
RADIUS = 4
#: Fingerprints of one key that a task compares at once, about; a key with more is dealt out in blocks of pairs.
BLOCK = 1 << 16
#: Such keys are found in the keys of one node in SAMPLE. What is dealt decides on tasks only, never on what is found.
SAMPLE = 64


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, joined by single spaces, with A-Z lower-cased; of all words if they are fewer.

    Words end at ASCII white space only (0x20, 0x09-0x0D), as bytes.split and bytes.lower have it.
    """
    words = data.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_digest
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))).tolist()
    begins = [0, *(e + 1 for e in ends)]
    found = [digest(line[b:e], 42) for b, e in zip(begins, ends[width - 1 :])] or [digest(line, 42)]
    return np.frombuffer(b"".join(found), dtype=">u8").astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit word through an invertible mix whose bits look independent of the word's."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def runs_of(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` word hashes, in order; of all of them if they are fewer."""
    n = max(1, len(words) - width + 1)
    out = np.zeros(n if len(words) else 0, dtype=np.uint64)
    for k in range(min(width, len(words))):
        out = mixed(out + words[k : k + n] + np.uint64(0x9E3779B97F4A7C15))
    return out


def majority(hashes: np.ndarray, bits: int = BITS) -> bytes:
    """The bits (little-endian) that are set in over half of the hashes; none without hashes. Bits beyond 64 come from the hashes mixed anew."""
    if not len(hashes):
        return bytes(bits // 8)
    words = [hashes]
    while 64 * len(words) < bits:
        words.append(mixed(hashes + np.uint64(len(words) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
    table = np.stack(words, axis=1).view(np.uint8)
    ones = sum(np.unpackbits(table[k : k + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8).astype(np.int64) for k in range(0, len(table), 255))
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def simhash(text: str | None, width: int) -> int:
    """The fingerprint as a signed long: a bit is 1 if it is set in over half the shingles' hashes; 0 without words."""
    return int.from_bytes(majority(shingle_hashes(text.encode("utf-8", "replace"), width) if text else np.zeros(0, np.uint64)), "little", signed=True)


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The check part of each 12-bit head; error patterns of up to RADIUS bits sorted by their syndrome; where each syndrome's patterns begin."""
    heads = np.arange(1 << (LENGTH - CHECK), dtype=np.int64) << CHECK
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        heads = np.where(heads >> bit & 1, heads ^ (GENERATOR << (bit - CHECK)), heads)
    patterns = np.array([sum(1 << i for i in c) for r in range(RADIUS + 1) for c in combinations(range(LENGTH), r)], dtype=np.int64)
    syndromes = heads[patterns >> CHECK] ^ (patterns & (1 << CHECK) - 1)
    order = np.argsort(syndromes, kind="stable")
    return heads, patterns[order], np.searchsorted(syndromes[order], np.arange((1 << CHECK) + 1))


def nearby_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in words, 12-bit codeword index) of every codeword within RADIUS of each 23-bit word."""
    heads, patterns, begins = golay()
    syndromes = heads[words >> CHECK] ^ (words & (1 << CHECK) - 1)
    first, many = begins[syndromes], begins[syndromes + 1] - begins[syndromes]
    at = np.repeat(np.arange(len(words)), many)
    inner = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    return at, (words[at] ^ patterns[first[at] + inner]) >> CHECK


def taken(fingerprints: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each fingerprint, packed."""
    out, k = np.zeros(len(fingerprints), dtype=np.int64), 0
    while k < len(bits):
        run = 1
        while k + run < len(bits) and bits[k + run] == bits[k] + run:
            run += 1
        out |= (fingerprints >> np.uint64(bits[k]) & np.uint64((1 << run) - 1)).astype(np.int64) << k
        k += run
    return out


def keys(fingerprints: np.ndarray, bound: int, blocks: int, exact: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, key): any two fingerprints within ``bound`` (up to 4) differing bits share a key.

    The bits form ``blocks`` blocks, of which bound errors leave at least ``exact`` untouched. For
    each choice of so many blocks, those bits stand in the key as they are; of the other bits two
    segments of up to 23 are decoded, one of which has at most bound // 2 errors, to the codewords
    within RADIUS of it.
    """
    edges = [round(BITS * k / blocks) for k in range(blocks + 1)]
    at, out, choice = [], [], 0
    for chosen in combinations(range(blocks), exact):
        same = [b for k in chosen for b in range(edges[k], edges[k + 1])]
        rest = [b for b in range(BITS) if b not in set(same)]
        half = (len(rest) + 1) // 2
        plain = taken(fingerprints, same)
        for segment in (rest[: min(half, LENGTH)], rest[half : half + LENGTH]):
            i, codeword = nearby_codewords(taken(fingerprints, segment))
            at.append(i)
            out.append(choice << (12 + len(same)) | plain[i] << 12 | codeword)
            choice += 1
    return np.concatenate(at), np.concatenate(out)


def split_for(n: int) -> tuple[int, int]:
    """(blocks, exact) by the number of different fingerprints: longer keys for more of them, so that few share a key by chance. Every choice finds all links."""
    return (5, 1) if n < 5_000_000 else (6, 2) if n < 500_000_000 else (7, 3)


def spanning(codes: np.ndarray, bound: int) -> list[tuple[int, int]]:
    """Pairs of rows within bound that join all rows that can be joined, at most len(codes) - 1 of them. codes: 64-bit words by row."""
    edges, rest = [], np.arange(len(codes))
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            own = front.pop()
            near = np.bitwise_count(codes[rest] ^ codes[own]).sum(axis=1) <= bound
            if near.any():
                front += (new := rest[near].tolist())
                edges += [(own, y) for y in new]
                rest = rest[~near]
    return edges


def run_links(run: np.ndarray, nodes: np.ndarray, codes: np.ndarray, bound: int) -> np.ndarray:
    """Edges (two node columns) within each run of equal run numbers, which ascend."""
    begins = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    sizes = np.diff(np.append(begins, len(run)))
    two = begins[sizes == 2]  # most runs
    near = two[np.bitwise_count(codes[two] ^ codes[two + 1]).sum(axis=1) <= bound]
    out = [np.stack([near, near + 1], axis=1)]
    for b, n in zip(begins[sizes > 2], sizes[sizes > 2]):
        out.append(np.array(spanning(codes[b : b + n], bound), dtype=np.int64).reshape(-1, 2) + b)
    at = np.concatenate(out)
    return nodes[at]


def runs(parts: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Batches again, in which every run of equal ``by`` columns is whole."""
    held: list[pd.DataFrame] = []
    for part in parts:
        if not len(part):
            continue
        ends = (part[by] != part[by].iloc[-1]).any(axis=1).to_numpy().nonzero()[0]
        cut = ends[-1] + 1 if len(ends) else 0
        if held and (part[by].iloc[0] != held[-1][by].iloc[-1]).any() or cut:
            yield pd.concat([*held, part[:cut]], ignore_index=True)
            held = []
        held.append(part[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def met(run: np.ndarray, words: np.ndarray, reach: int) -> np.ndarray:
    """Which rows have another row of their run (numbers ascend) whose word is at most ``reach`` bits away."""
    begins = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    sizes = np.diff(np.append(begins, len(run)))
    out = np.zeros(len(run), dtype=bool)
    two = begins[sizes == 2]
    near = two[np.bitwise_count(words[two] ^ words[two + 1]) <= reach]
    out[near] = out[near + 1] = True
    for b, n in zip(begins[sizes > 2], sizes[sizes > 2]):
        out[b + np.array(spanning(words[b : b + n, None], reach), dtype=np.int64).ravel()] = True
    return out


def links(nodes: DataFrame, bound: int, near: int = 4, reach: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): edges between different nodes whose codes are at most ``bound`` bits apart.

    nodes has node (long, different in each row), words (array of longs: 64-bit fingerprints from
    which keys are made) and code (binary, whole 64-bit words). Nodes meet if any of their words at
    the same place differ in at most ``near`` bits (up to 4), and if they share a key up to ``reach``
    bits; the edges then connect all that are linked among those that meet. Nodes that only share a
    key by chance are left out before codes are joined. Of each key's run a spanning forest comes out
    instead of its pairs, so a dense group of n costs n rows a key. A key with more than about
    ``block`` nodes is dealt into blocks before its nodes meet, and each two blocks meet in a task of
    their own; tasks so hold two blocks of a key. Such keys are estimated from one node in SAMPLE.
    """
    nodes = nodes.select("node", "words", "code")
    n = nodes.count()
    blocks, exact = split_for(n)

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in range(0, len(part), 2000):
                some = part[k : k + 2000]
                node, words = some["node"].to_numpy(dtype=np.int64), np.stack(some["words"]).view(np.uint64)
                for word in range(words.shape[1]):
                    at, key = keys(words[:, word], near, blocks, exact)
                    yield pd.DataFrame({"word": np.int8(word), "key": key, "node": node[at], "bits": words[at, word].view(np.int64)})

    by = ["word", "key", "pair"]

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in runs(parts, by):
            rows = rows[rows.duplicated(by, keep=False)]
            if len(rows):
                run = np.cumsum((rows[by] != rows[by].shift()).any(axis=1).to_numpy())
                rows = rows[met(run, rows["bits"].to_numpy(dtype=np.int64).view(np.uint64), reach)]
                yield rows[[*by, "node"]]

    keyed = nodes.select("node", "words").mapInPandas(spread, "word byte, key long, node long, bits long").withColumn("pair", F.lit(0).cast("long"))
    if n > block:
        some = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("node", "words").mapInPandas(spread, "word byte, key long, node long, bits long")
        hot = stage(some.groupBy("word", "key").agg((F.count("*") * SAMPLE).alias("n")).filter(F.col("n") > block).select("word", "key", F.ceil(F.col("n") / block).alias("deals")), "hot")
        if hot.head(1):
            own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("deals"))
            pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1), lambda j: F.least(own, j) * F.col("deals") + F.greatest(own, j))
            dealt = F.explode(F.when(F.col("deals").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(pairs)))
            keyed = keyed.drop("pair").join(small(hot), ["word", "key"], "left").withColumn("pair", dealt).drop("deals")
    shared = stage(keyed.repartition(*by).sortWithinPartitions(*by).mapInPandas(meet, "word byte, key long, pair long, node long"), "shared")

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in runs(parts, by):
            codes = np.frombuffer(b"".join(rows["code"]), dtype=np.uint64).reshape(len(rows), -1)
            run = np.cumsum((rows[by] != rows[by].shift()).any(axis=1).to_numpy())
            edges = run_links(run, rows["node"].to_numpy(dtype=np.int64), codes, bound)
            if len(edges):
                yield pd.DataFrame(np.sort(edges, axis=1), columns=["a", "b"]).drop_duplicates()

    coded = shared.join(nodes.select("node", "code"), "node").select("word", "key", "pair", "node", "code")
    return coded.repartition("word", "key", "pair").sortWithinPartitions("word", "key", "pair", "node").mapInPandas(compare, "a long, b long").distinct()


def _named(own: DataFrame, groups: DataFrame, edges: DataFrame) -> DataFrame:
    """own's rows with what was ``least``, now the smallest of all groups that edges connect to the row's node. Nodes of many rows, and classes of many nodes, are dealt into several tasks."""
    joined = stage(connected_components(edges), "components")
    placed = stage(groups.join(joined, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root")), "placed")
    roots = stage(placed.groupBy("root").agg(F.min("least").alias("least")), "roots")
    of_node = stage(salted(placed.select("node", "root"), roots, ["root"]).select("node", "least"), "named")
    return salted(own, of_node, ["node"])


def classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, bound: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row: its SimHash as 16 hex digits, and the smallest doc_id reachable over fingerprints at most ``bound`` bits apart, its own included.

    A null text, and one without words, has fingerprint zero and is linked like any other. Repeated
    rows each give a row; null doc_ids are smallest only where a class has no other. An empty table
    gives no rows. Other columns of df don't matter. Copies meet as one fingerprint before any join.
    """
    if not 0 <= bound <= 4:
        raise ValueError("bound is 0 to 4: the keys are complete up to four differing bits")

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(x, width) for x in texts], dtype="int64")

    own = stage(df.select(named(doc_id).alias("doc_id"), hashed(F.coalesce(named(text), F.lit(""))).alias("node")), "simhash")
    code = F.unhex(F.lpad(F.hex("node"), 16, "0"))
    groups = stage(own.groupBy("node").agg(F.min("doc_id").alias("least")).select("node", "least", F.array("node").alias("words"), code.alias("code")), "groups")
    return _named(own, groups.select("node", "least"), links(groups, bound, reach=bound)).select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


#: Shingles that a task sorts at once, in the mean.
BUCKET = 1 << 19
#: Texts, and shingles of these together, that a block of a cluster has at most, but for one text alone; a cluster with more is dealt out in blocks, of which at most two meet in a task.
CHUNK, SHINGLES = 1 << 14, 1 << 21
#: Texts beyond which a shingle is hot: its rows never meet in one task. The HOT_SHINGLES hottest are treated so.
HOT_TEXTS, HOT_SHINGLES = 1 << 18, 1 << 16
#: Texts of a cluster beyond one block that are compared with all of it first.
PIVOTS = 64


def scattered(rows: np.ndarray, by: np.ndarray, buckets: int) -> pd.DataFrame:
    """(bucket, data): the rows as bytes, by the remainder of ``by`` modulo ``buckets``."""
    bucket = (by % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    there, begins = np.unique(bucket[order], return_index=True)
    ends = np.append(begins[1:], len(rows))
    rows = rows[order]
    return pd.DataFrame({"bucket": there, "data": [rows[b:e].tobytes() for b, e in zip(begins, ends)]})


def gathered(df: DataFrame, dtype: np.dtype, each, schema: str) -> DataFrame:
    """What ``each`` makes of all rows of a bucket, as one array."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in runs(parts, ["bucket"]):
            out = each(np.frombuffer(b"".join(rows["data"]), dtype=dtype))
            if len(out):
                yield out

    return df.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, schema)


def run_numbers(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values in order: the number of each one's run of equals, and where the runs begin."""
    fresh = np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, dtype=bool)
    return np.cumsum(fresh) - 1, np.flatnonzero(fresh)


def overlap(size: np.ndarray, similarity: float) -> np.ndarray:
    """How many of its shingles a set of that size shares at least with any set of that Jaccard similarity."""
    return np.ceil(similarity * size - 1e-9).astype(np.int64)


def alike(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of sets of at least that Jaccard similarity which join all that can be joined, at most len(sets) - 1 of them.

    A set that is reached is compared with those that aren't yet; the table of shingles shrinks with
    them, so a dense group costs little more than one look at each of its sets.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))

    def table(here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, owner = np.concatenate([sets[i] for i in here]), np.repeat(np.arange(len(here), dtype=np.int32), sizes[here])
        order = np.argsort(values, kind="stable")
        return values[order], owner[order]

    here = np.arange(len(sets))
    values, owner = table(here)
    waiting, left = np.ones(len(sets), dtype=bool), len(sets)
    edges: list[tuple[int, int]] = []
    front: list[int] = []
    while left:
        if not front:
            root = int(waiting.argmax())
            waiting[root], left = False, left - 1
            front = [int(here[root])]
            continue
        if 2 * left <= len(here):
            here = here[waiting]
            values, owner = table(here)
            waiting = np.ones(left, dtype=bool)
        own = front.pop()
        first, last = np.searchsorted(values, sets[own], "left"), np.searchsorted(values, sets[own], "right")
        many = last - first
        at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        common = np.bincount(owner[at], minlength=len(here))
        near = np.flatnonzero(waiting & (common >= similarity * (sizes[here] + sizes[own] - common) - 1e-9))
        waiting[near], left = False, left - len(near)
        new = here[near].tolist()
        front += new
        edges += [(own, y) for y in new]
    return edges


def near_sets(texts: DataFrame, width: int, similarity: float, bucket: int = BUCKET, chunk: int = CHUNK, hot_texts: int = HOT_TEXTS, shingles: int = SHINGLES) -> DataFrame:
    """(a, b): edges that connect all nodes whose sets of ``width`` words have a Jaccard similarity of at least ``similarity``.

    texts (staged) has one row for each different set: node (long), size (of the set), text, and family:
    a number that nodes share which are known to be connected, their own node for others. Edges within a
    family aren't sought, though some may come out. No other
    such pair is lost, at any size of the table, but for hashes: of 64 bits for shingles, and of 32 for the
    families in step (1), where two that agree in them, and that share their shingles with no third
    one, pass for one; that has a chance of 2^-32 for each pair. A set shares at least similarity * size of its
    shingles with a near one, so (1) a text with fewer shingles that another family has too has none beyond its own.
    Of those left, (2) each takes the rarest shingles, one more than it may have alone: two near sets
    have one of these in common. (3) Texts connected by such shingles form a cluster, in which the
    sets themselves are compared.

    A shingle of more than about ``hot_texts`` texts, estimated from one text in SAMPLE, is known to be
    shared and frequent, so its rows need not meet (but for those beyond the HOT_SHINGLES most frequent):
    they are dealt out by text, and connect to a text of the sample that has it. A cluster of more than
    ``chunk`` texts, or of more than ``shingles`` shingles, is compared block by block, each with up to
    PIVOTS texts of the whole cluster; then what isn't in its largest class meets every block. That costs
    the square only of what is unlike its own cluster. Texts become sets as they come, so that a task
    holds the shingles of two blocks, some 40 bytes each, and no more than a batch of texts.
    """
    known = texts.agg(F.sum("size"), F.count("*")).first()
    buckets = max(1, -(-(known[0] or 0) // bucket))
    brief = np.dtype([("key", "<u4"), ("family", "<u4"), ("node", "<u2")])  # members of a family that agree in 16 bits are counted together: more pass

    def sets_of(part: pd.DataFrame) -> list[np.ndarray]:
        return [shingle_set(x, width) for x in part["text"]]

    def flat(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for part in parts:
            for k in range(0, len(part), 250):
                some = part[k : k + 250]
                sets = sets_of(some)
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                node, family = (some[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("node", "family"))
                yield np.concatenate(sets), np.repeat(node, sizes), np.repeat(family, sizes), np.repeat(sizes, sizes)

    def counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, node, _, _ in flat(parts):
            there, first, n = np.unique(key, return_index=True, return_counts=True)
            yield pd.DataFrame({"key": there.view(np.int64), "centre": node[first].view(np.int64), "n": n})

    hot, centre = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if known[1] > hot_texts:
        some = texts.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("node", "family", "text")
        found = some.mapInPandas(counts, "key long, centre long, n long").groupBy("key").agg(F.sum("n").alias("n"), F.min("centre").alias("centre"))
        rows = sorted((r["key"] & 0xFFFFFFFFFFFFFFFF, r["centre"]) for r in found.filter((F.col("n") >= 2) & (F.col("n") * SAMPLE > hot_texts)).orderBy(F.desc("n")).limit(HOT_SHINGLES).collect())
        hot, centre = np.array([k for k, _ in rows], dtype=np.uint64), np.array([c for _, c in rows], dtype=np.int64)
    hot_heads = np.unique(hot >> np.uint64(32))

    def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
        return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values if len(table) else np.zeros(len(values), dtype=bool)

    def spread_brief(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, node, family, _ in flat(parts):
            rows = np.empty(len(key), dtype=brief)
            rows["key"], rows["family"], rows["node"] = key >> np.uint64(32), family & np.uint64(0xFFFFFFFF), node >> np.uint64(48)
            yield scattered(rows, np.where(among(key, hot), node, key) & np.uint64(0xFFFFFFFF), buckets)

    def shared_by(rows: np.ndarray) -> pd.DataFrame:
        both = rows["key"].astype(np.uint64) << np.uint64(32) | rows["family"]
        order = np.argsort(both)
        both = both[order]
        member = (both & np.uint64(0xFFFFFFFF)) << np.uint64(16) | rows["node"][order]
        run, begins = run_numbers(both >> np.uint64(32))
        ends = np.append(begins[1:], len(both)) - 1
        member = member[((both[begins] != both[ends]) | among(both[begins] >> np.uint64(32), hot_heads))[run]]
        return scattered(member, member, buckets)

    def counted(members: np.ndarray) -> pd.DataFrame:
        member, n = np.unique(members, return_counts=True)
        return pd.DataFrame({"member": member.astype(np.int64), "shared": n.astype(np.int64)})

    packed = "bucket long, data binary"
    first = gathered(texts.select("node", "family", "text").mapInPandas(spread_brief, packed), brief, shared_by, packed)
    shared = stage(gathered(first, np.dtype("<u8"), counted, "member long, shared long"), "shared")
    member = F.shiftleft(F.col("family").bitwiseAND(F.lit(0xFFFFFFFF)), 16).bitwiseOR(F.shiftrightunsigned("node", 48))
    left = stage(texts.withColumn("member", member).join(small(shared), "member").filter(F.col("shared") >= F.ceil(similarity * F.col("size") - 1e-9)).select("node", "family", "size", "text"), "left")

    total = left.agg(F.sum("size")).first()[0] or 0
    fewer = max(1, -(-total // bucket))
    posting = np.dtype([("key", "<u8"), ("node", "<u8"), ("size", "<u4")])
    ranked = np.dtype([("key", "<u8"), ("node", "<u8"), ("size", "<u4"), ("df", "u1")])

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, node, _, size in flat(parts):
            rows = np.empty(len(key), dtype=posting)
            rows["key"], rows["node"], rows["size"] = key, node, size
            yield scattered(rows, np.where(among(key, hot), node, key), fewer)

    def with_frequency(rows: np.ndarray) -> pd.DataFrame:
        rows = rows[np.argsort(rows["key"])]
        run, begins = run_numbers(rows["key"])
        n = np.diff(np.append(begins, len(rows)))
        n = np.where(among(rows["key"][begins], hot), 255, n)[run]
        rows, n = rows[n > 1], n[n > 1]
        out = np.empty(len(rows), dtype=ranked)
        for c in posting.names:
            out[c] = rows[c]
        out["df"] = np.minimum(n, 255)
        return scattered(out, out["node"], fewer)

    def rarest(rows: np.ndarray) -> pd.DataFrame:
        rows = rows[np.lexsort((rows["key"], rows["df"], rows["node"]))]
        run, begins = run_numbers(rows["node"])
        n = np.diff(np.append(begins, len(rows)))[run]
        size = rows["size"].astype(np.int64)
        take = size - overlap(size, similarity) + 1 - (size - n)  # shingles that no other has come first
        rows = rows[np.arange(len(rows)) - begins[run] < take]
        out = np.empty(len(rows), dtype=posting)
        for c in posting.names:
            out[c] = rows[c]
        return scattered(out, np.where(among(out["key"], hot), out["node"], out["key"]), fewer)

    def stars(rows: np.ndarray) -> pd.DataFrame:
        rows = rows[np.lexsort((rows["node"], rows["key"]))]
        run, begins = run_numbers(rows["key"])
        node, heads = rows["node"].astype(np.int64), rows["key"][begins]
        middle, known = node[begins], among(heads, hot)
        middle[known] = centre[np.searchsorted(hot, heads[known])]
        out = pd.DataFrame({"a": middle[run], "b": node})
        return out[out["a"] != out["b"]].drop_duplicates()

    third = gathered(gathered(left.select("node", "family", "text").mapInPandas(spread, packed), posting, with_frequency, packed), ranked, rarest, packed)
    clusters = stage(connected_components(gathered(third, posting, stars, "a long, b long")), "clusters")

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, node, sets = None, [], []
        for part in chain(parts, [None]):
            out: list[tuple[int, int]] = []
            for *own, n, text in [(None, None, 0, "")] if part is None else zip(part["component"], part["task"], part["node"], part["text"]):
                if own != key:
                    out += [(node[x], node[y]) for x, y in (alike(sets, similarity) if len(sets) > 1 else ())]
                    key, node, sets = own, [], []
                node.append(n)
                sets.append(shingle_set(text, width))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    def compared(members: DataFrame) -> DataFrame:
        """members: (component, task, node); what meets in a task is compared."""
        dealt = members.join(left.select("node", "text"), "node").select("component", "task", "node", "text")
        return dealt.repartition("component", "task").sortWithinPartitions("component", "task", "node").mapInPandas(compare, "a long, b long").distinct()

    blocks_of = lambda n, size: F.greatest(F.ceil(n / chunk), F.ceil(size / shingles))
    sized = stage(clusters.join(left.select("node", "size"), "node"), "sized")
    sizes = stage(sized.groupBy("component").agg(blocks_of(F.count("*"), F.sum("size")).alias("deals")).filter("deals > 1"), "sizes")
    zero, block = F.lit(0).cast("long"), lambda deals: F.pmod(F.xxhash64("node"), F.col(deals))
    up_to = lambda deals: F.sequence(zero, F.col(deals) - 1)
    if not sizes.head(1):
        return compared(clusters.withColumn("task", zero))
    in_one = clusters.join(small(sizes), "component", "left_anti").select("component", zero.alias("task"), "node")
    in_many = stage(sized.join(small(sizes), "component"), "many")
    by_hash = W.Window.partitionBy("component").orderBy(F.xxhash64("node", F.lit(2)), "node")
    first_ones = in_many.withColumn("r", F.row_number().over(by_hash)).filter(F.col("r") <= PIVOTS)
    first_ones = first_ones.withColumn("upto", F.sum("size").over(by_hash)).filter((F.col("r") == 1) | (F.col("upto") <= shingles // 4))
    pivots = first_ones.select("component", F.explode(up_to("deals")).alias("task"), "node")
    blocks = in_many.select("component", block("deals").alias("task"), "node")
    edges = stage(compared(in_one.unionByName(blocks.unionByName(pivots).distinct())), "edges")

    label = F.coalesce("label", "node").alias("label")
    labelled = stage(in_many.join(connected_components(edges).withColumnRenamed("component", "label"), "node", "left").select("component", "node", "size", label), "labelled")
    most = labelled.groupBy("component", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size")).groupBy("component").agg(F.max(F.struct("n", "label", "size")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    others = blocks_of(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size"))
    most = stage(most.filter(F.col("n") > F.col("most.n")).select("component", F.col("most.label").alias("most"), blocks_of(F.col("most.n"), F.col("most.size")).alias("inner"), others.alias("outer")), "most")
    if not most.head(1):
        return edges
    placed = labelled.join(small(most), "component").withColumn("own", F.when(F.col("label") == F.col("most"), -1 - block("inner")).otherwise(block("outer")))
    # a task is a block outside the largest class by any block: those below zero are the class's
    meeting = lambda i, j: i * (F.col("inner") + F.col("outer")) + F.when(j < 0, -1 - j).otherwise(F.col("inner") + j)
    own = F.col("own")
    with_outer = F.transform(up_to("outer"), lambda j: F.when(own < 0, meeting(j, own)).otherwise(meeting(F.least(own, j), F.greatest(own, j))))
    with_inner = F.when(own < 0, F.array().cast("array<long>")).otherwise(F.transform(up_to("inner"), lambda j: meeting(own, -1 - j)))
    tasks = placed.select("component", F.explode(F.array_distinct(F.concat(with_outer, with_inner))).alias("task"), "node")
    return edges.unionByName(stage(compared(tasks), "rest"))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The different hashes of a text's runs of ``width`` words, ascending."""
    return np.unique(runs_of(shingle_hashes((text or "").encode("utf-8", "replace"), 1), width))


def _row_key(text, doc_id) -> tuple:
    """What a row is known by: whether it lacks an id, the id, and 128 bits of its text. Rows equal in all of these are copies of each other."""
    body = F.coalesce(text, F.lit(""))
    return F.isnull(doc_id).alias("anonymous"), doc_id.alias("doc_id"), F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2")


ROW_KEY = ("anonymous", "doc_id", "t1", "t2")


def alike_prints(nodes: DataFrame, texts: DataFrame, width: int, similarity: float, bound: int = 4) -> DataFrame:
    """(a, b), staged: edges between nodes whose SimHashes are at most ``bound`` bits apart and whose sets have a Jaccard similarity of at least ``similarity``.

    nodes (staged) has node and fingerprint, texts node and text. Fingerprints meet as in ``classes``: by
    Golay keys, a spanning forest of each key's run. A forest's edge stands for its two fingerprints'
    smallest nodes, and each other node of a fingerprint is joined to that. What is joined so and isn't
    alike is dropped: these edges are sure, but not all that there are.
    """
    prints = stage(nodes.groupBy("fingerprint").agg(F.min("node").alias("centre")), "prints")
    code = F.unhex(F.lpad(F.hex("fingerprint"), 16, "0"))
    near = links(prints.select(F.col("fingerprint").alias("node"), F.array("fingerprint").alias("words"), code.alias("code")), bound, reach=bound)
    held = small(prints)
    ends = [held.select(F.col("fingerprint").alias(x), F.col("centre").alias(f"centre_{x}")) for x in "ab"]
    across = near.join(ends[0], "a").join(ends[1], "b").select(F.col("centre_a").alias("a"), F.col("centre_b").alias("b"))
    within = salted(nodes.select("node", "fingerprint"), prints, ["fingerprint"]).filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    joined = stage(across.unionByName(within), "met")
    asked = stage(joined.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
    held = stage(texts.join(small(asked), "node", "left_semi").select("node", "text"), "held")

    @F.pandas_udf("boolean")
    def confirmed(one: pd.Series, other: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(one, other):
            x, y = shingle_set(x, width), shingle_set(y, width)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
        return pd.Series(out, dtype=bool)

    one, other = (held.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("a", "one"), ("b", "other")))
    pairs = salted(salted(joined, one, ["a"]), other, ["b"], counts=joined.groupBy("b").agg(F.count("*").alias("many")))
    sure = stage(pairs.filter(confirmed("one", "other")).select("a", "b"), "sure")
    for done in (prints, joined, asked, held):
        release(done)
    return sure


def _similar(df: DataFrame, text: str, doc_id: str, width: int, similarity: float, bucket: int = BUCKET, chunk: int = CHUNK, hot_texts: int = HOT_TEXTS, shingles: int = SHINGLES) -> DataFrame:
    """ROW_KEY of each row, and ``least``: the smallest such key of its class.

    Texts meet by SimHash first (alike_prints); what that connects is a family, and near_sets, which
    finds all that is alike, has only to look for edges between families.
    """

    @F.pandas_udf("node long, other long, size long, fingerprint long")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(x, width) for x in texts]
        rows = [(xxhash.xxh3_64_intdigest(b := s.tobytes()), xxhash.xxh3_64_intdigest(b, 1), len(s), int.from_bytes(majority(s), "little", signed=True)) for s in sets]
        return pd.DataFrame(rows, columns=["node", "other", "size", "fingerprint"]).astype({"node": "uint64", "other": "uint64"}).astype("int64")

    found = df.select(*_row_key(named(text), named(doc_id)), F.coalesce(named(text), F.lit("")).alias("text"))
    own = stage(found.withColumn("s", sketched("text")).select(*ROW_KEY, "text", "s.node", "s.other", "s.size", "s.fingerprint", F.monotonically_increasing_id().alias("row")), "sketches")
    # different sets with one node, if there are any, get nodes of their own
    twice = stage(own.groupBy("node").agg(F.min("other").alias("one"), F.max("other").alias("last")).filter("one <> last").select("node", "one"), "twice")
    if twice.head(1):
        apart = F.when(F.col("other") > F.col("one"), F.xxhash64("node", "other")).otherwise(F.col("node"))
        own = stage(own.join(small(twice), "node", "left").withColumn("node", apart).drop("one"), "sketches")
    groups = stage(own.groupBy("node").agg(F.min(F.struct(*ROW_KEY)).alias("least"), F.min("fingerprint").alias("fingerprint"), F.count("*").alias("n"), F.min("row").alias("chosen")), "groups")
    # of copies one goes on
    copies = stage(groups.filter("n > 1").select("node", "chosen"), "copies")
    many = own.select("node", "size", "text", "row")
    held = small(copies)
    once = (many.join(held, "node", "left") if held is not copies else salted(many, copies, ["node"], "left")).filter("chosen is null or chosen = row").select("node", "size", "text")
    once = stage(once, "texts") if held is copies else once
    sure = alike_prints(groups.select("node", "fingerprint"), once, width, similarity)
    families = stage(connected_components(sure).withColumnRenamed("component", "family"), "families")
    known = small(families)
    texts = once.join(known, "node", "left").withColumn("family", F.coalesce("family", "node"))
    edges = sure.unionByName(near_sets(stage(texts, "texts") if known is families else texts, width, similarity, bucket, chunk, hot_texts, shingles))
    return _named(own.select(*ROW_KEY, "node"), groups.select("node", "least"), edges).select(*ROW_KEY, "least")


def similar_classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, similarity: float = 0.8, bucket: int = BUCKET, chunk: int = CHUNK, hot_texts: int = HOT_TEXTS, shingles: int = SHINGLES) -> DataFrame:
    """(doc_id, component_id) of each row: classes of texts connected by a Jaccard similarity of their sets of ``width`` words of at least ``similarity``.

    All such pairs count and no others (near_sets). Nulls, empty texts, repeated rows and other
    columns as in ``classes``; bucket, chunk, hot_texts and shingles change the size of tasks only.
    """
    return _similar(df, text, doc_id, width, similarity, bucket, chunk, hot_texts, shingles).select("doc_id", F.col("least.doc_id").alias("component_id"))


def representatives(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of df that stay: one of each class of similar_classes, that with the smallest doc_id (null last), then the smallest hash of its text.

    Rows are known by their id and text, so ids that are null or repeat cost no other row: rows of one
    id stay if their texts are in different classes. Of rows that repeat id and text one stays. A null
    text counts as empty. Columns of df stay as they are, whatever their names; an empty table gives
    no rows.
    """
    known = stage(_similar(df, text, doc_id, width, similarity), "classes")
    key = F.struct(*ROW_KEY)
    gone = stage(known.filter(key != F.col("least")).select(*ROW_KEY).distinct(), "gone")
    again = stage(known.filter(key == F.col("least")).groupBy(*ROW_KEY).agg(F.count("*").alias("n")).filter("n > 1").select(*ROW_KEY), "again")
    rows = df.select(F.struct(*(named(c).alias(c) for c in df.columns)).alias("row"), *_row_key(named(text), named(doc_id)))

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        other = keys.select(*(F.col(c).alias(f"other_{c}") for c in ROW_KEY))
        same = (F.col("t1") == F.col("other_t1")) & (F.col("t2") == F.col("other_t2")) & F.col("doc_id").eqNullSafe(F.col("other_doc_id"))
        return rows.join(small(other), same, how)

    kept = among(rows, gone, "left_anti")
    if again.head(1):
        kept = among(kept, again, "left_anti").unionByName(among(kept, again, "left_semi").dropDuplicates([*ROW_KEY]))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in df.columns))
