"""Ids of titles that outlive a run: files that come later go on counting where earlier ones ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import release, stage
from ..operators.ids import dense_ids, patent_id

COLUMNS = "publication_number string, title string, ipc_code string"
TITLES, PARTS = "title string, n long, batch int", "n long, publication_number string, ipc_code string, batch int"


def _earlier(spark: SparkSession, ledger: str, kind: str, schema: str, batch: int) -> DataFrame:
    """What batches before this one have left."""
    if batch == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{ledger}/{kind}").filter(F.col("batch") < batch)


def book(ledger: str):
    """A batch function, for foreachBatch, that books rows (publication_number, title, ipc_code, file) under ``ledger``.

    A title that no earlier batch has gets the next numbers, in the order of file names and of rows in
    them; every row adds to its title's publication numbers and codes. A batch writes two folders of its
    own, titles/batch=N and parts/batch=N, and reads those of smaller N only, so a batch that runs again
    after a failure writes the same. Rows with an empty title are left out.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = F.concat("file", F.lit("|"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
        trimmed = [F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("publication_number", "title", "ipc_code")]
        rows = stage(batch.select(*trimmed, place.alias("place")).filter("title <> ''"), "rows")
        known = _earlier(spark, ledger, "titles", TITLES, number).select("title", "n")
        first = rows.groupBy("title").agg(F.min("place").alias("first")).join(known, "title", "left_anti")
        last = known.agg(F.max("n")).first()[0] or 0
        dense_ids(first, ["first", "title"], "n", last + 1).select("title", F.col("n").cast("long").alias("n")).write.mode("overwrite").parquet(f"{ledger}/titles/batch={number}")
        every = spark.read.schema(TITLES).parquet(f"{ledger}/titles").filter(F.col("batch") <= number).select("title", "n")
        rows.join(every, "title").select("n", "publication_number", "ipc_code").distinct().write.mode("overwrite").parquet(f"{ledger}/parts/batch={number}")
        release(rows)

    return step


def run(spark: SparkSession, folder: str, ledger: str) -> None:
    """Book all CSV files (with header) under ``folder`` that no earlier run with this ledger has read, as one batch; cells may hold line breaks."""
    rows = spark.readStream.schema(COLUMNS).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder, header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1)
    stream = rows.select("*", F.col("_metadata.file_path").alias("file"))
    stream.writeStream.foreachBatch(book(ledger)).option("checkpointLocation", f"{ledger}/progress").trigger(availableNow=True).start().awaitTermination()


def library(spark: SparkSession, ledger: str) -> DataFrame:
    """(patent_id, title, publication_numbers, ipc_codes) of all that was booked; the sets sorted."""
    parts = spark.read.schema(PARTS).parquet(f"{ledger}/parts").groupBy("n").agg(F.array_sort(F.collect_set("publication_number")).alias("publication_numbers"), F.array_sort(F.collect_set("ipc_code")).alias("ipc_codes"))
    titles = spark.read.schema(TITLES).parquet(f"{ledger}/titles").select("title", "n")
    return titles.join(parts, "n").select(patent_id(F.col("n")).alias("patent_id"), "title", "publication_numbers", "ipc_codes")
