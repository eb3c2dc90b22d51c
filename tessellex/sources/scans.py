"""Scans of delimited, JSON, triple, wiki, CoNLL and mention files into DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions import text as X
from ..functions.staging import small, stage
from ..operators.ids import dense_ids


def patents_csv(spark: SparkSession, path: str) -> DataFrame:
    """publication_number, title, ipc_code of all CSV files under a path (with header), trimmed, and place; cells may hold line breaks and any length.

    place sorts rows by the name of their file, then as they stand in it: a file with line breaks in
    its cells is read whole by one task, whose row numbers ascend.
    """
    names = ["publication_number", "title", "ipc_code"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1, pathGlobFilter="*.csv")
    place = F.concat(F.input_file_name(), F.lit("|"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    return rows.select(*(F.trim(F.coalesce(n, F.lit(""))).alias(n) for n in names), place.alias("place"))


def split_csv_records(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(file, record, value) of all CSV files under a path: every record as its text, numbered from 0 in its file; cells in quotes may hold line breaks, and a large file is read by many tasks.

    A line break ends a record where the quotes before it, from the beginning of the file, are even. So
    the lines of each byte range are counted with their quotes, ranges are composed in order (a row
    for each range), and each line then knows whether it begins a record and which. Only records of several
    lines are put together by a shuffle. Quotes stand around whole cells, doubled inside, as CSV has it.
    """
    lines = spark.read.text(path, lineSep="\n", pathGlobFilter=glob, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.withColumn("at", F.monotonically_increasing_id()).withColumn("quotes", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2)
    inside = W.Window.partitionBy("file", "block").orderBy("at")
    upto = F.sum("quotes").over(inside) - F.col("quotes")  # odd quotes before this line in its range
    told = lines.withColumn("odd", (upto % 2).cast("int"))
    # lines that begin a record if the range begins outside of quotes, and if it begins inside
    ranges = stage(told.groupBy("file", "block").agg((F.sum("quotes") % 2).cast("int").alias("turn"), F.count_if(F.col("odd") == 0).alias("even"), F.count_if(F.col("odd") == 1).alias("uneven")), "ranges")
    before = W.Window.partitionBy("file").orderBy("block")
    begun = ranges.withColumn("within", ((F.sum("turn").over(before) - F.col("turn")) % 2).cast("int")).withColumn("starts", F.when(F.col("within") == 0, F.col("even")).otherwise(F.col("uneven")))
    begun = stage(begun.select("file", "block", "within", (F.sum("starts").over(before) - F.col("starts")).alias("earlier")), "begun")
    placed = told.join(small(begun), ["file", "block"]).withColumn("first", (F.col("odd") == F.col("within")).cast("int"))
    placed = placed.withColumn("record", F.col("earlier") + F.sum("first").over(inside) - 1)
    alone = (F.col("first") == 1) & (F.col("quotes") == 0)
    single = placed.filter(alone).select("file", "record", "value")
    several = placed.filter(~alone).groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "\n").alias("value"))
    return single.unionByName(several).withColumn("value", F.regexp_replace("value", "\r$", ""))


def patents_csv_by_ranges(spark: SparkSession, path: str) -> DataFrame:
    """What patents_csv gives, of files however large: many tasks read one file (split_csv_records). place sorts rows by file, then record."""
    names = ["publication_number", "title", "ipc_code"]
    records = split_csv_records(spark, path).filter((F.col("record") > 0) & (F.col("value") != ""))
    cells = F.from_csv("value", ", ".join(f"{n} string" for n in names), {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"})
    place = F.concat("file", F.lit("|"), F.lpad(F.col("record").cast("string"), 20, "0"))
    return records.select(cells.alias("c"), place.alias("place")).select(*(F.trim(F.coalesce(F.col(f"c.{n}"), F.lit(""))).alias(n) for n in names), "place")


def nested_export(df: DataFrame, language: str = "en") -> DataFrame:
    """Flat rows of a warehouse export whose titles are localized and whose codes repeat: the title of a language, a row for each code."""
    titles = F.filter("title_localized", lambda t: t["language"] == language)
    return df.select("publication_number", F.get(F.transform(titles, lambda t: t["text"]), F.lit(0)).alias("title"), F.explode_outer("ipc").alias("i")).select("publication_number", "title", F.col("i.code").alias("ipc_code"))


def dry_run_rows(spark: SparkSession) -> DataFrame:
    """Three rows in the form of patents_csv."""
    return spark.createDataFrame([("US-123-A1", "Bread making device and method", "A21C"), ("US-456-B2", "Meat mincing machine", "A22C"), ("EP-789-A1", "Dough kneading apparatus", "A21C")], "publication_number string, title string, ipc_code string")


def tsv(spark: SparkSession, path: str, columns: list[str], numbers: tuple[str, ...] = ()) -> DataFrame:
    """A TSV file with header; rows whose number columns aren't whole numbers are left out."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.csv(path, schema=schema, sep="\t", header=True, quote="", maxCharsPerColumn=-1)
    rows = rows.select(*(F.col(c).try_cast("long").alias(c) if c in numbers else F.coalesce(c, F.lit("")).alias(c) for c in columns))
    for c in numbers:
        rows = rows.filter(F.col(c).isNotNull())
    return rows


def chunk_folders(spark: SparkSession, path: str, name: str, columns: list[str], numbers: tuple[str, ...] = (), first: int | None = None) -> DataFrame:
    """The TSV file ``name`` of every folder chunk_* under a path, with its chunk; of the first N folders by name if asked."""
    rows = tsv(spark, f"{path}/chunk_*/{name}", columns, numbers).withColumn("chunk", F.regexp_extract(F.input_file_name(), r"/(chunk_[^/]*)/", 1))
    if first is None:
        return rows
    names = rows.select("chunk").distinct().orderBy("chunk").limit(first)
    return rows.join(F.broadcast(names), "chunk")


def level_file(spark: SparkSession, path: str) -> DataFrame:
    """id, name, ipc_codes of a TSV file of a static level, whichever of id and name stands first; other lines are left out."""
    p = F.split("value", "\t", -1)
    at = lambda k: F.get(p, F.lit(k))
    swapped = at(1).rlike("^[0-9]+$")
    rows = spark.read.text(path).select(F.when(swapped, at(1)).otherwise(at(0)).try_cast("long").alias("id"), F.when(swapped, at(0)).otherwise(at(1)).alias("name"), F.coalesce(at(2), F.lit("")).alias("codes"))
    return rows.filter("id is not null and name <> ''").select("id", F.trim("name").alias("name"), F.filter(F.transform(F.split("codes", ","), lambda w: F.trim(w)), lambda x: x != "").alias("ipc_codes"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON array or of JSON lines; lines that can't be read are left out."""
    is_array = spark.read.text(path).filter(F.trim("value") != "").limit(1).filter(F.ltrim("value").startswith("[")).count() > 0
    return spark.read.json(path, schema=schema, multiLine=is_array, mode="DROPMALFORMED")


def entity_catalog(spark: SparkSession, path: str) -> DataFrame:
    """id (0-based line number), title, text, page_id of an entity file of JSON lines."""
    lines = spark.read.text(path, wholetext=False).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    parsed = lines.select("file", "at", F.from_json("value", "title string, text string, idx string").alias("r")).filter("r.title is not null")
    return dense_ids(parsed.select("file", "at", "r.*"), ["file", "at"], "id", 0).select("id", "title", "text", X.page_id("idx").alias("page_id"))


def last_by_title(catalog: DataFrame) -> DataFrame:
    """title, id: of equal titles the last id."""
    return catalog.groupBy("title").agg(F.max("id").alias("id"))


def triples(spark: SparkSession, path: str, predicate: str | None = None) -> DataFrame:
    """subject, predicate, object of blank-separated triples, and literal: the first quoted text of the object."""
    p = F.split("value", " ", 3)
    rows = spark.read.text(path).select(F.get(p, F.lit(0)).alias("subject"), F.get(p, F.lit(1)).alias("predicate"), F.get(p, F.lit(2)).alias("object")).filter("object is not null")
    rows = rows.withColumn("literal", F.when(F.col("object").rlike('"[^"]*"'), F.regexp_extract("object", '"([^"]*)"', 1)))
    return rows.filter(F.col("predicate").contains(predicate)) if predicate else rows


def names_of(text: Column) -> Column:
    """All names in a JSON document: a list of names or of records with a name, or an object whose values are such lists."""
    lists = F.coalesce(F.from_json(text, "array<string>"), F.flatten(F.map_values(F.from_json(text, "map<string,array<string>>"))))
    return F.filter(F.transform(lists, lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x)), lambda x: x.isNotNull())


def wikidata_dump(spark: SparkSession, path: str) -> DataFrame:
    """id, title, label, description, aliases of the entities of a JSON dump (an array with an entity a line) that have an English page."""
    item = "id string, labels struct<en:struct<value:string>>, descriptions struct<en:struct<value:string>>, aliases struct<en:array<struct<value:string>>>, sitelinks struct<enwiki:struct<title:string>>"
    rows = spark.read.text(path).select(F.from_json(F.regexp_replace("value", r",\s*$", ""), item).alias("e")).filter("e.sitelinks.enwiki.title is not null")
    return rows.select("e.id", F.col("e.sitelinks.enwiki.title").alias("title"), F.col("e.labels.en.value").alias("label"), F.col("e.descriptions.en.value").alias("description"), F.transform("e.aliases.en", lambda a: a["value"]).alias("aliases"))


def wiki_extracts(spark: SparkSession, path: str) -> DataFrame:
    """id, url, title, lines, intro_lines, num_tokens, links of ``<doc …>…</doc>`` records.

    The intro ends at the second blank line; links are struct(href, text) with the target decoded.
    """
    rows = spark.read.text(path, lineSep="</doc>").select(F.regexp_extract("value", r'<doc id="([^"]*)"', 1).alias("id"), F.regexp_extract("value", r'url="([^"]*)"', 1).alias("url"), F.regexp_extract("value", r'title="([^"]*)"', 1).alias("title"), F.trim(F.regexp_replace("value", r"(?s)^.*?<doc [^>]*>\s*", "")).alias("body")).filter("id <> ''")
    rows = rows.withColumn("lines", F.split(F.regexp_replace("body", r"\s+$", ""), "\n", -1))
    blank = F.array_position(F.transform(F.slice("lines", 3, 1 << 30), lambda x: F.trim(x) == ""), True)
    intro = F.when(blank > 0, F.slice("lines", F.lit(1), blank.cast("int") + 1)).otherwise(F.col("lines"))
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(1)).alias("h"), F.regexp_extract_all("body", F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(2)).alias("t"))
    return rows.select("id", "url", "title", "lines", intro.alias("intro_lines"), F.size(F.split("body", " ", -1)).alias("num_tokens"), F.transform(pairs, lambda z: F.struct(F.try_url_decode(z["h"]).alias("href"), z["t"].alias("text"))).alias("links"))


def id_mapping(spark: SparkSession, url: str, table: str, key: str, value: str) -> DataFrame:
    """Two columns of a table behind a JDBC address."""
    return spark.read.format("jdbc").options(url=url, query=f"SELECT {key}, {value} FROM {table}").load()


def mention_table(spark: SparkSession, path: str) -> DataFrame:
    """doc, mention, left, right, candidates (name, prior), gold of tab-separated mentions whose candidates are ``id,prior,name`` fields between CANDIDATES and GT:."""
    p = F.split("value", "\t", -1)
    at = lambda k: F.get(p, F.lit(k))
    end = F.array_position(p, "GT:")
    body = F.filter(F.slice(p, F.lit(7), F.greatest(end - 7, F.lit(0)).cast("int")), lambda c: (c != "") & (c != "EMPTYCAND"))
    parts = F.transform(body, lambda c: F.split(c, ",", 3))
    return spark.read.text(path).filter(F.array_contains(p, "GT:")).select(at(0).alias("doc"), at(2).alias("mention"), at(3).alias("left"), at(4).alias("right"), F.transform(parts, lambda c: F.struct(F.get(c, F.lit(2)).alias("name"), F.get(c, F.lit(1)).try_cast("double").alias("prior"))).alias("candidates"), F.element_at(F.split(F.element_at(p, -1), ",", 3), -1).alias("gold"))


def conll(spark: SparkSession, path: str) -> DataFrame:
    """doc, sentence, tokens, tags of CoNLL files: documents begin with -DOCSTART-, sentences end at blank lines.

    Each document is one record of the scan, so it is framed without a window over the file.
    """
    docs = spark.read.text(path, lineSep="-DOCSTART-").filter(F.trim("value") != "").select(F.trim(F.regexp_extract("value", r"^\s*(?:\(([^)]*)\))?", 1)).alias("doc"), F.regexp_replace("value", r"^[^\n]*\n", "").alias("body"))
    sent = docs.select("doc", F.posexplode(F.filter(F.split("body", r"\n[ \t]*\n", -1), lambda s: F.trim(F.regexp_replace(s, r"\s", "")) != "")).alias("sentence", "s"))
    lines = F.filter(F.split("s", "\n", -1), lambda x: F.trim(x) != "")
    return sent.select("doc", "sentence", F.transform(lines, lambda x: F.get(F.split(x, r"[\t ]"), F.lit(0))).alias("tokens"), F.transform(lines, lambda x: F.coalesce(F.get(F.split(x, r"[\t ]"), F.lit(1)), F.lit("O"))).alias("tags"))


def known_mentions(mentions: DataFrame, ids: DataFrame) -> DataFrame:
    """Mentions whose label (external id) ids (external, local) knows, with label_id; the others are dropped."""
    return mentions.join(ids.select(F.col("external").alias("label"), F.col("local").alias("label_id")), "label")


def window_examples(documents: DataFrame, mentions: DataFrame, most: int = 128) -> DataFrame:
    """Mentions (context_document_id, start_index, end_index inclusive, label_document_id) with their words and context of at most ``most`` words."""
    words = F.split("text", " ", -1)
    start, end = F.col("start_index"), F.col("end_index") + 1
    left, right = X.context(words, start, end, most)
    joined = mentions.join(documents.select(F.col("document_id").alias("context_document_id"), "text"), "context_document_id")
    return joined.select("context_document_id", "label_document_id", F.array_join(F.slice(words, start + 1, end - start), " ").alias("mention"), F.array_join(left, " ").alias("context_left"), F.array_join(right, " ").alias("context_right"))


def stored_vectors(spark: SparkSession, path: str, wanted: DataFrame, encode) -> DataFrame:
    """Vectors (id, v) of the wanted rows from a table at path, which first gets those it lacks: encode(rows) gives id and v."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    missing = wanted.join(spark.read.parquet(path).select("id"), "id", "left_anti") if there else wanted
    encode(missing).select("id", "v").write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted.select("id"), "id", "left_semi")


def in_order(df: DataFrame, by: str, order: str, value: str, out: str) -> DataFrame:
    """One row for each ``by`` with its values in order."""
    return df.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(out))


