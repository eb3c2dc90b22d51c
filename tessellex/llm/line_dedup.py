"""Lines that repeat, exactly or within one edit, across all documents; the earliest stays.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.staging import salted, small, stage
from .columns import apart, named, together

#: Pieces of a line of which one edit leaves all but one as they are, and the step to which their lengths are rounded down.
PIECES, STEP = 4, 16
#: What names a different line: two hashes and its length; and the place where it first stands. A document is its id and its text's hash.
LINE, PLACE = ("h1", "h2", "n"), ("doc", "th", "line")


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, n, doc, th, line, s) of every line of at least min_chars characters."""
    lines = docs.select("doc", "th", F.posexplode(F.split("text", "\n", -1)).alias("line", "s")).withColumn("n", F.length("s")).filter(F.col("n") >= min_chars)
    return lines.select(F.xxhash64("s").alias("h1"), F.hash("s").alias("h2"), "n", "doc", "th", "line", "s")


def _frame(k: Column | int, n: Column) -> tuple[Column, Column]:
    """The prefix and suffix lengths that frame k (0 to 2 PIECES - 1) of a line of n characters has.

    For the shorter line of a pair, of m characters, rounded down to t: an edit at p leaves the first
    q t / PIECES and the last (PIECES - 1 - q) t / PIECES characters alone for some q. Frame q is for
    m = n, frame PIECES + q for m = n - 1, as the line may be the longer one.
    """
    k = F.lit(k) if isinstance(k, int) else k
    t = F.floor((n - F.floor(k / PIECES)) / STEP) * STEP
    q = k % PIECES
    return F.floor(q * t / PIECES).cast("int"), F.floor((PIECES - 1 - q) * t / PIECES).cast("int")


def _frame_keys(s: Column, n: Column) -> list[Column]:
    """A hash of each frame's prefix and suffix; null for one that equals the frame for m = n."""
    out = []
    for k in range(2 * PIECES):
        a, b = _frame(k, n)
        key = F.xxhash64(F.substring(s, F.lit(1), a), F.substring(s, n - b + 1, b), a, b)
        out.append((key if k < PIECES else F.when(n % STEP == 0, key)).alias(f"k{k}"))
    return out


def _near(docs: DataFrame, lines: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, n) of the different lines that lie within one edit of an earlier one. lines: LINE, PLACE and frame keys of each.

    A line that shares no frame key with another has none within one edit. The others emit, for the
    places that their shared frames leave open, 96 bits of the line without the character there; each
    also stands for itself. Two lines differ by one substitution if they are equal without their p-th
    characters, by one insertion if the longer is equal to the shorter without one. So each line need
    only meet the earliest of its group, and is then compared with that as text. Lines that are equal
    without their p-th characters are at most as many as there are characters.
    """
    keyed = lines.select(*LINE, *PLACE, F.posexplode(F.array(*(f"k{k}" for k in range(2 * PIECES)))).alias("k", "key")).filter("key is not null")
    counts = keyed.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1")
    shared = stage(counts, "frames")
    held = small(shared.select("key"))
    several = keyed.join(held, "key") if held is not shared else salted(keyed, shared.select("key"), ["key"], counts=shared)
    open_ = stage(several.groupBy(*LINE, *PLACE).agg(F.bit_or(F.pow(F.lit(2), F.col("k")).cast("int")).alias("frames")), "open")
    own = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*LINE, *PLACE)]
    other = open_.select(*(F.col(c).alias(f"_{c}") for c in (*LINE, *PLACE)), "frames")
    texts = stage(_occurrences(docs, min_chars).join(small(other), on=_all(own), how="inner").select(*LINE, *PLACE, "s", "frames").dropDuplicates([*LINE, *PLACE]), "texts")

    def places(k: Column) -> Column:
        a, b = _frame(k, F.col("n"))
        return F.sequence(a, F.col("n") - b - 1)

    chosen = F.filter(F.sequence(F.lit(0), F.lit(2 * PIECES - 1)), lambda k: F.col("frames").bitwiseAND(F.pow(F.lit(2), k).cast("int")) > 0)
    gaps = F.array_distinct(F.flatten(F.transform(chosen, places)))
    spot = F.struct("doc", "th", "line", "h1").alias("spot")
    # each place is a row before its variant is hashed, so that this compiles
    rest = F.concat(F.substring("s", F.lit(1), F.col("p")), F.substring("s", F.col("p") + 2, F.col("n")))
    itself = F.col("p") < 0
    variants = texts.select(*LINE, spot, "s", F.explode(F.concat(F.array(F.lit(-1)), gaps)).alias("p"))
    variants = variants.select(*LINE, "spot", "p", F.when(itself, F.col("h1")).otherwise(F.xxhash64(rest)).alias("vh"), F.when(itself, F.col("h2")).otherwise(F.hash(rest)).alias("vi")).repartition("vh")
    group = W.Window.partitionBy("vh", "vi")
    substituted = F.min("spot").over(W.Window.partitionBy("vh", "vi", "p"))
    longer, whole = F.min(F.when(F.col("p") >= 0, F.col("spot"))).over(group), F.min(F.when(itself, F.col("spot"))).over(group)
    earliest = variants.withColumn("first", F.when(itself, longer).otherwise(F.least(substituted, whole))).filter("first < spot").groupBy(*LINE, "spot").agg(F.min("first").alias("first"))
    mine = texts.select(F.struct("doc", "th", "line", "h1").alias("spot"), F.col("s").alias("own"))
    other = texts.select(F.struct("doc", "th", "line", "h1").alias("first"), F.col("s").alias("other"))
    return earliest.join(mine, "spot").join(other, "first").filter(F.levenshtein("own", "other", 1) >= 0).select(*LINE).distinct()


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", max_edits: int = 1, min_chars: int = 24) -> DataFrame:
    """df with the repeated lines taken out of each text, and lines_total and lines_dropped (long).

    Lines end at a line feed. Of the lines with at least ``min_chars`` characters one is dropped if an
    earlier one, by doc_id (null first), then number of the line, is the same or at most ``max_edits``
    (0 or 1) inserted, deleted or replaced characters from it, whether that one is itself dropped or
    not. Shorter and empty lines stay. A text that loses all lines is left empty; a null text stays
    null, with no lines. Rows that repeat both id and text are one document: each keeps what the
    first keeps. Rows that share an id but not the text are ordered by a hash of it. Columns of df
    named like the results, in any case of letters, are replaced; all others stay. An empty table
    gives none.

    Texts are read again instead of shuffled; only hashes of lines and lines that share most of their
    characters with another move. Staged tables are broadcast if their measured bytes allow it
    (staging.BROADCAST_BYTES), else joined by shuffle, in which lines and frames of very many rows are
    dealt out.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    docs = df.select(named(doc_id).alias("doc"), F.xxhash64(named(text)).alias("th"), named(text).alias("text"))
    found = _occurrences(docs, min_chars)
    keys = _frame_keys(F.col("s"), F.col("n")) if max_edits else []
    place = F.struct(*PLACE)
    first_keys = [F.first(f"k{k}").alias(f"k{k}") for k in range(len(keys))]
    lines = stage(found.select(*LINE, *PLACE, *keys).groupBy(*LINE).agg(F.min(place).alias("first"), F.count("*").alias("many"), *first_keys).select(*LINE, "first.*", "many", *(f"k{k}" for k in range(len(keys)))), "lines")
    again = lines.filter("many > 1").select(*LINE, place.alias("first"), F.lit(False).alias("near"))
    if max_edits:
        none = F.lit(None).cast(again.schema["first"].dataType)
        again = again.unionByName(_near(docs, lines, min_chars).select(*LINE, none.alias("first"), F.lit(True).alias("near")))
    affected = stage(again.groupBy(*LINE).agg(F.max("first").alias("first"), F.bool_or("near").alias("near")), "affected")
    spots, held = found.select(*LINE, *PLACE), small(affected)
    repeated = spots.join(held, list(LINE)) if held is not affected else salted(spots, affected, list(LINE), counts=lines.select(*LINE, "many"))
    gone = repeated.filter(F.col("near") | (place != F.col("first")))
    # a document's key without nulls
    known = F.xxhash64(F.isnull("doc"), "doc").alias("dk")
    lost = stage(gone.groupBy("doc", "th").agg(F.collect_set("line").alias("lost")).select(known, "th", "lost"), "lost")
    rows = apart(df, "lines_total", "lines_dropped", doc=named(doc_id), th=F.xxhash64(named(text)), text=named(text)).withColumn("dk", known).drop("doc")
    joined = rows.join(small(lost), ["dk", "th"], "left")
    # a column of its own: inside the lambda it would be split anew for each line
    joined = joined.withColumn("pieces", F.when(F.col("lost").isNotNull(), F.split("text", "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), F.col("lost"))
    shorter = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("pieces"), i)), "\n"))
    total = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return together(joined, **{text: shorter, "lines_total": F.coalesce(total, F.lit(0)).cast("long"), "lines_dropped": F.coalesce(F.size("lost"), F.lit(0)).cast("long")})
