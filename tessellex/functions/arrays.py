"""Functions over arrays: delimited sets, spans, vectors and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_set(c: Column, sep: str = ",") -> Column:
    """The sorted different parts of a delimited text, trimmed, without empty ones."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(c, sep, -1), lambda w: F.trim(w)), lambda x: x != "")))


def format_set(c: Column, sep: str = ",") -> Column:
    return F.array_join(F.array_sort(c), sep)


SPAN = "^[0-9]+:[0-9]+:[0-9]+$"


def parse_spans(c: Column) -> Column:
    """Structs (fot_id, start, end) of ``id:start:end`` parts; other parts give none."""
    parts = F.filter(F.transform(F.split(c, ",", -1), lambda w: F.trim(w)), lambda x: x.rlike(SPAN))
    at = lambda x, i: F.get(F.split(x, ":"), F.lit(i))
    return F.transform(parts, lambda x: F.struct(at(x, 0).cast("long").alias("fot_id"), at(x, 1).cast("int").alias("start"), at(x, 2).cast("int").alias("end")))


def format_spans(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["fot_id"].cast("string"), s["start"].cast("string"), s["end"].cast("string"))), ",")


def valid_spans(c: Column) -> Column:
    """Whether a text is empty or a comma-joined list of ``id:start:end``."""
    return (c == "") | F.forall(F.split(c, ",", -1), lambda x: F.trim(x).rlike(SPAN))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def scaled(a: Column, by: Column) -> Column:
    """Each element over a number that is computed once, not for each element; 0 over 0."""
    return F.zip_with(a, F.array_repeat(by, F.size(a)), lambda x, n: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))


def normalized(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    return scaled(a, norm(a))


def _with_hash_counts(df: DataFrame, text: str, dim: int) -> DataFrame:
    """df with _bins, the different bins of a text's lower-cased characters, and _counts, how many characters each has, scaled to length 1.

    Characters are compared with the text's own bins only, each column computed once and not for each count.
    """
    chars = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "", -1), lambda c: c != "")
    each = df.withColumn("_each", F.transform(chars, lambda c: (F.ascii(c).cast("long") * 131 % dim).cast("int"))).withColumn("_bins", F.array_distinct("_each"))
    counts = F.transform("_bins", lambda b: (F.size("_each") - F.size(F.array_remove("_each", b))).cast("double"))
    return each.withColumn("_counts", counts).withColumn("_counts", normalized(F.col("_counts"))).drop("_each")


def with_hash_code(df: DataFrame, text: str, out: str, dim: int = 128) -> DataFrame:
    """df with counts of a text's lower-cased characters in dim bins, bin = code point * 131 mod dim, scaled to length 1; zeros for an empty text."""
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.coalesce(F.get("_counts", F.array_position("_bins", b).cast("int") - 1), F.lit(0.0)))
    return _with_hash_counts(df, text, dim).withColumn(out, dense).drop("_bins", "_counts")


def hash_weights(df: DataFrame, text: str, *keep: str, dim: int = 128) -> DataFrame:
    """(keep, bin, weight): the entries of with_hash_code above 0, a row each, without an array of all bins between.

    The outer form keeps Spark from filtering by the array's size, which it would compute below a distinct, for every row that goes into it.
    """
    z = F.explode_outer(F.arrays_zip(F.col("_bins").alias("bin"), F.col("_counts").alias("weight"))).alias("z")
    return _with_hash_counts(df, text, dim).select(*keep, z).select(*keep, "z.bin", "z.weight").filter("bin is not null")


def log_softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    raised = F.zip_with(scores, F.array_repeat(top, F.size(scores)), lambda x, m: F.exp(x - m))
    whole = top + F.log(F.aggregate(raised, F.lit(0.0), lambda s, x: s + x))
    return F.zip_with(scores, F.array_repeat(whole, F.size(scores)), lambda x, w: x - w)


def log_sigmoid(x: Column) -> Column:
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def left_aligned(values: Column, mask: Column, width: int, pad: Column) -> Column:
    """The masked-in values first, then pad up to width."""
    kept = F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["v"])
    return F.slice(F.concat(kept, F.array_repeat(pad, width)), 1, width)


def gather(values: Column, at: Column) -> Column:
    """values at 0-based places; null beyond the end."""
    return F.transform(at, lambda i: F.get(values, i))


def mean_of(values: Column, start: Column, end: Column) -> Column:
    """The mean of values[start..end], end inclusive; null for none."""
    part = F.slice(values, start + 1, end - start + 1)
    return F.try_divide(F.aggregate(part, F.lit(0.0), lambda s, x: s + x), F.size(part))


def greedy_spans(spans: Column) -> Column:
    """Of spans (score, start, end; end exclusive) by falling score, ties by start, those that no kept one overlaps; by start."""
    order = F.array_sort(spans, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["end"] - b["end"]))
    free = lambda kept, s: ~F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
    kept = F.aggregate(order, F.slice(spans, 1, 0), lambda k, s: F.when(free(k, s), F.concat(k, F.array(s))).otherwise(k))
    return F.array_sort(kept, lambda a, b: a["start"] - b["start"])



def sorted_together(*names: str) -> Column:
    """Parallel arrays as one array of structs, in the order of the first, then the second, and so on."""
    return F.array_sort(F.arrays_zip(*names))


def kilobytes(size: Column) -> Column:
    """Whole kilobytes of a size in bytes, 1 at least; 0 for none."""
    return F.when(size.isNull(), 0).otherwise(F.greatest(F.lit(1), F.ceil(size / 1024))).cast("long")
