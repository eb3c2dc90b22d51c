"""Queries that write tables in each file format and read them back, and the small filters, texts and rates over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import arrays as A
from ..functions import text as T
from ..functions.staging import fresh_folder
from ..operators import filters, ids, metrics, sampling, tagging
from ..operators import mentions as M
from ..sources import scans, sinks
from ..streaming import ledger
from ..streaming import queries as streams


def _folder(df: DataFrame) -> str:
    return fresh_folder(df.sparkSession, "files")


def _lines(df: DataFrame, line, order: str | None = None) -> str:
    """A text folder with a line for each row; if asked, files whose names follow that order, and so do the lines in each."""
    path = _folder(df)
    rows = df.select(line.alias("value"), *([order] if order else []))
    rows = rows.repartitionByRange(4, order).sortWithinPartitions(order).select("value") if order else rows
    rows.write.text(path)
    return path


@query("SELECT 'N-' || p_partkey::VARCHAR AS publication_number, trim(p_name) AS title, p_brand AS ipc_code FROM part")
def csv_scan(t):
    part = t("part").select(F.concat(F.lit("N-"), F.col("p_partkey").cast("string")).alias("publication_number"), F.concat(F.lit(" "), "p_name").alias("title"), F.col("p_brand").alias("ipc_code"))
    path = _folder(part)
    part.write.csv(path, header=True, quoteAll=True)
    return scans.patents_csv(part.sparkSession, path).select("publication_number", "title", "ipc_code")


@query("SELECT 'A' || lpad((row_number() OVER (ORDER BY max(p_partkey) DESC))::VARCHAR, 7, '0') AS patent_id, trim(p_name) AS title FROM part WHERE trim(p_name) <> '' GROUP BY trim(p_name)")
def csv_first_ids(t):
    part = t("part").select(F.col("p_partkey").cast("string").alias("publication_number"), F.col("p_name").alias("title"), F.col("p_brand").alias("ipc_code"), "p_partkey")
    path = _folder(part)
    part.repartitionByRange(4, F.desc("p_partkey")).sortWithinPartitions(F.desc("p_partkey")).drop("p_partkey").write.csv(path, header=True, quoteAll=True)
    return ids.title_groups(scans.patents_csv(part.sparkSession, path), "title", "publication_number", "ipc_code", "place").select("patent_id", "title")


@query("SELECT p_partkey::VARCHAR AS publication_number, CASE WHEN p_size % 5 = 0 THEN 'said \"' || p_name || '\"' || chr(10) || 'twice, ' || p_type ELSE trim(p_name) END AS title, p_brand AS ipc_code FROM part")
def csv_ranges(t):
    quoted = F.concat(F.lit('said "'), "p_name", F.lit('"\ntwice, '), "p_type")
    part = t("part").select(F.col("p_partkey").cast("string").alias("publication_number"), F.when(F.col("p_size") % 5 == 0, quoted).otherwise(F.col("p_name")).alias("title"), F.col("p_brand").alias("ipc_code"))
    path = _folder(part)
    part.write.csv(path, header=True, quoteAll=True, escape='"')
    return scans.patents_csv_by_ranges(part.sparkSession, path).select("publication_number", "title", "ipc_code")


@query("SELECT p_partkey AS id, p_name AS name, p_brand || ',' || p_type AS codes FROM part WHERE p_partkey % 7 <> 0")
def tsv_scan(t):
    key = F.when(F.col("p_partkey") % 7 == 0, "none").otherwise(F.col("p_partkey").cast("string"))
    df = t("part").select(key.alias("id"), F.col("p_name").alias("name"), F.array("p_type", "p_brand").alias("codes"))
    path = _folder(df)
    sinks.write_tsv(df, path)
    return scans.tsv(df.sparkSession, path, ["id", "name", "codes"], ("id",))


@query("SELECT 'chunk_' || (p_size % 3)::VARCHAR AS chunk, p_partkey AS fot_id, p_name AS fot_name FROM part WHERE p_size % 3 < 2")
def chunk_scan(t):
    part = t("part").select(F.col("p_partkey").alias("fot_id"), F.col("p_name").alias("fot_name"), F.col("p_size") % 3)
    path = _folder(part)
    for k in range(3):
        sinks.write_tsv(part.filter(part[2] == k).select("fot_id", "fot_name"), f"{path}/chunk_{k}/map.tsv")
    return scans.chunk_folders(part.sparkSession, path, "map.tsv", ["fot_id", "fot_name"], ("fot_id",), 2).select("chunk", "fot_id", "fot_name")


@query("SELECT p_partkey AS id, p_name AS name, p_brand || ';' || p_type AS codes FROM part")
def level_scan(t):
    key = F.col("p_partkey").cast("string")
    first, second = F.when(F.col("p_partkey") % 2 == 0, key).otherwise(F.col("p_name")), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(key)
    path = _lines(t("part"), F.concat_ws("\t", first, second, F.concat("p_brand", F.lit(", "), "p_type", F.lit(","))))
    return scans.level_file(t("part").sparkSession, path).select("id", "name", F.array_join("ipc_codes", ";").alias("codes"))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 5 <> 0")
def json_scan(t):
    record = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    path = _lines(t("part"), F.when(F.col("p_partkey") % 5 == 0, '{"id": broken').otherwise(record))
    return scans.json_records(t("part").sparkSession, path, "id long, name string")


@query("SELECT p_brand, p_partkey AS id, p_name AS name FROM part")
def json_by_key(t):
    df = t("part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    path = _folder(df)
    sinks.write_json_lines(df, path, "p_brand")
    return df.sparkSession.read.schema(df.schema).json(path)


@query("WITH e AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, p_name AS title FROM part) SELECT title, max(id) AS id FROM e GROUP BY 1")
def catalog_scan(t):
    record = F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("text"), F.concat(F.lit("https://x.org/wiki?curid="), F.col("p_partkey").cast("string")).alias("idx")))
    path = _lines(t("part"), record, "p_partkey")
    return scans.last_by_title(scans.entity_catalog(t("part").sparkSession, path))


@query("SELECT 'm.' || p_partkey::VARCHAR AS subject, p_name AS literal FROM part")
def triples_scan(t):
    subject = F.concat(F.lit("m."), F.col("p_partkey").cast("string"))
    df = t("part").select(F.explode(F.array(F.concat(subject, F.lit(' type.name "'), "p_name", F.lit('"@en .')), F.concat(subject, F.lit(" type.level 3 .")))).alias("line"))
    return scans.triples(df.sparkSession, _lines(df, F.col("line")), "name").select("subject", "literal")


@query("SELECT DISTINCT p_name AS name FROM part UNION ALL SELECT DISTINCT p_brand FROM part")
def names_scan(t):
    # a document for each brand, and one for each size
    lists = t("part").groupBy("p_brand").agg(F.to_json(F.collect_set(F.struct(F.col("p_name").alias("name")))).alias("j"))
    objects = t("part").groupBy("p_size").agg(F.to_json(F.struct(F.collect_set("p_brand").alias("level2"))).alias("j"))
    names = lambda f: f.select(F.explode(scans.names_of(F.col("j"))).alias("name")).distinct()
    return names(lists).unionByName(names(objects))


@query("SELECT 'Q' || p_partkey::VARCHAR AS id, p_name AS title, p_brand AS label, p_type AS description, p_type AS alias FROM part WHERE p_size % 4 <> 0")
def wikidata_scan(t):
    value = lambda c: F.struct(F.struct(F.col(c).alias("value")).alias("en"))
    title = F.when(F.col("p_size") % 4 != 0, F.struct(F.struct(F.col("p_name").alias("title")).alias("enwiki")))
    item = F.struct(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("id"), value("p_brand").alias("labels"), value("p_type").alias("descriptions"), F.struct(F.array(F.struct(F.col("p_type").alias("value"))).alias("en")).alias("aliases"), title.alias("sitelinks"))
    rows = scans.wikidata_dump(t("part").sparkSession, _lines(t("part"), F.concat(F.to_json(item), F.lit(","))))
    return rows.select("id", "title", "label", "description", F.array_join("aliases", "|").alias("alias"))


@query("SELECT p_partkey::VARCHAR AS id, p_name AS title, p_name || '|' || '|' || p_type || ' <a href=\"x%20y\">' || p_brand || '</a>' AS lines, len(string_split(p_name || chr(10) || chr(10) || p_type || ' <a href=\"x%20y\">' || p_brand || '</a>', ' '))::INT AS num_tokens, 'x y' AS href, p_brand AS anchor FROM part")
def wiki_scan(t):
    key = F.col("p_partkey").cast("string")
    record = F.concat(F.lit('<doc id="'), key, F.lit('" url="u'), key, F.lit('" title="'), "p_name", F.lit('">\n'), "p_name", F.lit("\n\n"), "p_type", F.lit(' <a href="x%20y">'), "p_brand", F.lit("</a>\n</doc>"))
    rows = scans.wiki_extracts(t("part").sparkSession, _lines(t("part"), record))
    return rows.select("id", "title", F.array_join("lines", "|").alias("lines"), "num_tokens", F.col("links")[0]["href"].alias("href"), F.col("links")[0]["text"].alias("anchor"))


@query("SELECT p_partkey::VARCHAR AS doc, s AS sentence, CASE s WHEN 0 THEN replace(p_name, ' ', '|') ELSE p_brand END AS tokens, CASE s WHEN 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda x: 'O'), '|') ELSE 'B-X' END AS tags FROM part, (SELECT unnest([0, 1])::INT AS s)")
def conll_scan(t):
    words = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(w, F.lit("\tO"))), "\n")
    record = F.concat(F.lit("-DOCSTART- ("), F.col("p_partkey").cast("string"), F.lit(")\n\n"), words, F.lit("\n\n"), "p_brand", F.lit("\tB-X\n"))
    rows = scans.conll(t("part").sparkSession, _lines(t("part"), record))
    return rows.select("doc", "sentence", F.array_join("tokens", "|").alias("tokens"), F.array_join("tags", "|").alias("tags"))


@query("SELECT p_partkey::VARCHAR AS doc, p_name AS mention, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand || '=0.25' END AS candidates, p_type AS gold FROM part")
def mention_scan(t):
    candidate = F.when(F.col("p_size") % 3 == 0, "EMPTYCAND").otherwise(F.concat(F.lit("7,0.25,"), "p_brand"))
    record = F.concat_ws("\t", F.col("p_partkey").cast("string"), F.lit("x"), "p_name", F.lit("left"), F.lit("right"), F.lit("CANDIDATES"), candidate, F.lit("GT:"), F.concat(F.lit("1,9,"), "p_type"))
    rows = scans.mention_table(t("part").sparkSession, _lines(t("part"), record))
    return rows.select("doc", "mention", F.array_join(F.transform("candidates", lambda c: F.concat_ws("=", c["name"], c["prior"].cast("string"))), "|").alias("candidates"), "gold")


@query("SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def vector_store(t):
    rows = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    path, same = _folder(rows), lambda x: x
    scans.stored_vectors(rows.sparkSession, path, rows.filter("id % 2 = 0"), same)
    found = scans.stored_vectors(rows.sparkSession, path, rows, same)
    return found.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT label AS cell, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY 1")
def vector_cells(t):
    rows = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("int").alias("cell"))
    path = _folder(rows)
    sinks.write_vectors(rows, path, "cell")
    return rows.sparkSession.read.parquet(path).groupBy("cell").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("WITH w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS token FROM benchmark) SELECT token, count(DISTINCT item_id) AS docs, count(*) AS tf FROM w GROUP BY 1")
def index_sink(t):
    docs = t("benchmark").select("item_id", F.col("text").alias("body"))
    path = _folder(docs)
    sinks.write_index(docs, "item_id", {"body": 1.0}, path)
    return docs.sparkSession.read.parquet(path).groupBy("token").agg(F.count("*").alias("docs"), F.sum("tf").cast("long").alias("tf"))


@query("SELECT p_partkey, CASE WHEN row_number() OVER (ORDER BY p_partkey) <= (count(*) OVER () + 1) // 2 THEN 1 ELSE 2 END AS half FROM part")
def half_split(t):
    return sampling.halves(t("part").select("p_partkey"), "p_partkey")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS characters FROM conversations GROUP BY 1")
def turns_in_order(t):
    c = t("conversations")
    sizes = c.groupBy("conv_id").agg(F.sum(F.length("text")).alias("characters"))
    return scans.in_order(c, "conv_id", "turn", "role", "r").join(sizes, "conv_id").select("conv_id", F.array_join("r", ",").alias("roles"), "characters")


@query("SELECT doc_id, len(string_split(text, ' '))::INT AS n FROM documents WHERE len(string_split(text, ' ')) >= 50")
def long_documents(t):
    return filters.long_enough(t("documents").select("doc_id", F.size(F.split("text", " ", -1)).alias("n")), "n", 50)


@query("SELECT p_partkey FROM part WHERE p_size % 6 <> 0 AND p_size % 10 <> 0")
def without_disambiguation(t):
    title = F.when(F.col("p_size") % 6 == 0, F.concat("p_name", F.lit(" (Disambiguation)"))).otherwise(F.col("p_name"))
    told = F.when(F.col("p_size") % 10 == 0, "a disambiguation page of the wiki").otherwise(F.lit(None).cast("string"))
    return filters.without_disambiguation(t("part").select("p_partkey", title.alias("title"), told.alias("description"))).select("p_partkey")


@query("WITH c AS (SELECT l_orderkey, list(DISTINCT l_partkey ORDER BY l_partkey) AS c, min(l_suppkey) % 4 AS k FROM lineitem GROUP BY 1) SELECT l_orderkey, c[k + 1] AS gold FROM c WHERE k + 1 <= len(c) AND k < 2")
def gold_within_top(t):
    c = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("c"), (F.min("l_suppkey") % 4).cast("int").alias("k")).withColumn("gold", F.get("c", F.col("k")))
    return filters.gold_within(filters.gold_within(c, "c", "gold"), "c", "gold", 2).select("l_orderkey", "gold")


@query("SELECT m, count(*) AS n FROM lineitem, (SELECT unnest(['joint', 'mention', 'both']) AS m) WHERE CASE m WHEN 'joint' THEN l_quantity >= 20 WHEN 'mention' THEN l_linenumber * 10 >= 20 ELSE l_quantity >= 20 AND l_linenumber * 10 >= 20 END GROUP BY 1")
def threshold_modes(t):
    df = t("lineitem").select(F.col("l_quantity").alias("joint"), (F.col("l_linenumber") * 10).alias("mention"))
    modes = [filters.passing(df, m, 20).select(F.lit(m).alias("m")) for m in ("joint", "mention", "both")]
    return modes[0].union(modes[1]).union(modes[2]).groupBy("m").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey % 30 AS s, l_suppkey % 40 AS e FROM lineitem WHERE l_suppkey % 40 >= l_partkey % 30 AND l_suppkey % 40 - l_partkey % 30 <= 10")
def fair_spans(t):
    return filters.fair_spans(t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 30).alias("s"), (F.col("l_suppkey") % 40).alias("e")), "s", "e", 10)


@query("SELECT 'm.' || c_custkey::VARCHAR AS subject, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 < 2 AND n_regionkey <> 1")
def levels_in_catalog(t):
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("m."), F.col("c_custkey").cast("string")).alias("subject"), "n_name", (F.col("c_custkey") % 3).cast("string").alias("level"))
    triples = rows.select("subject", F.lit("type.level").alias("predicate"), F.col("level").alias("literal")).unionByName(rows.select("subject", F.lit("type.name").alias("predicate"), F.col("n_name").alias("literal")))
    return filters.levels_in_catalog(triples, t("nation").filter("n_regionkey <> 1").select(F.col("n_name").alias("title")), "level")


@query("SELECT c_custkey, s_suppkey AS label_id FROM customer JOIN supplier ON c_custkey % 50 = s_suppkey")
def known_mentions(t):
    own = t("supplier").select(F.col("s_suppkey").alias("external"), F.col("s_suppkey").alias("local"))
    return scans.known_mentions(t("customer").select("c_custkey", (F.col("c_custkey") % 50).alias("label")), own).select("c_custkey", "label_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 100000 + l_partkey) <= 2")
def first_candidates(t):
    return sampling.first_rows(t("lineitem").withColumn("place", F.col("l_linenumber") * 100_000 + F.col("l_partkey")), "l_orderkey", "place", 2, "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, string_agg((l_partkey % 30)::VARCHAR || '-' || (l_partkey % 30 + l_linenumber)::VARCHAR || '=' || l_suppkey::VARCHAR, ',' ORDER BY l_partkey % 30, l_partkey % 30 + l_linenumber, l_suppkey) AS spans FROM lineitem GROUP BY 1")
def sorted_mentions(t):
    start = F.col("l_partkey") % 30
    lists = t("lineitem").groupBy("l_orderkey").agg(*(F.collect_list(c).alias(n) for c, n in ((start, "s"), (start + F.col("l_linenumber"), "e"), (F.col("l_suppkey"), "x"))))
    told = F.transform(A.sorted_together("s", "e", "x"), lambda z: F.concat(z["s"].cast("string"), F.lit("-"), z["e"].cast("string"), F.lit("="), z["x"].cast("string")))
    return lists.select("l_orderkey", F.array_join(told, ",").alias("spans"))


@query("SELECT p_partkey, p_name || ' is not ' || p_brand AS plain FROM part")
def contractions(t):
    return t("part").select("p_partkey", T.expand_contractions(F.concat("p_name", F.lit(" ' s not "), "p_brand")).alias("plain"))


@query("SELECT p_partkey, p_name || '  ' || p_brand AS bare, left(trim(p_type), 3) AS prefix, left(trim(p_type), 1) AS main FROM part")
def parentheses_and_prefixes(t):
    return t("part").select("p_partkey", T.drop_parentheses(F.concat("p_name", F.lit(" ("), "p_type", F.lit(") "), "p_brand")).alias("bare"), T.ipc_prefix("p_type").alias("prefix"), T.ipc_prefix("p_type", 1).alias("main"))


@query("SELECT p_brand, string_agg(DISTINCT '\"' || p_type || '\"', ' ' ORDER BY '\"' || p_type || '\"') AS aliases FROM part GROUP BY 1")
def quoted_aliases(t):
    every = F.concat(F.array_sort(F.collect_set("p_type")), F.array(F.lit(" "), F.lit("\U0001f600")))
    return t("part").groupBy("p_brand").agg(M.quoted_aliases(every).alias("aliases"))


@query("SELECT p_partkey, replace(p_name, ' ', '_') AS page, p_name AS back FROM part")
def page_names(t):
    page = F.replace("p_name", F.lit(" "), F.lit("_"))
    return t("part").select("p_partkey", page.alias("page"), F.replace(F.try_url_decode(F.url_encode(page)), F.lit("_"), F.lit(" ")).alias("back"))


@query("SELECT vec_id, round(list_avg((embedding::DOUBLE[])[vec_id % 8 + 1:vec_id % 8 + 5]), 9) AS pooled, round(embedding[1 + vec_id % 8]::DOUBLE + embedding[5 + vec_id % 8]::DOUBLE, 9) AS ends FROM embeddings")
def span_pooling(t):
    v = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 8).cast("int").alias("s"))
    ends = A.gather(F.col("v"), F.array(F.col("s"), F.col("s") + 4))
    return v.select("vec_id", F.round(A.mean_of(F.col("v"), F.col("s"), F.col("s") + 4), 9).alias("pooled"), F.round(ends[0] + ends[1], 9).alias("ends"))


@query("WITH l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_linenumber % 2 = 1) AS k FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string((coalesce(k, []) || [-1, -1, -1, -1])[:4], ',') AS kept FROM l")
def left_aligned(t):
    z = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("z"))
    kept = A.left_aligned(F.transform("z", lambda x: x["l_partkey"]), F.transform("z", lambda x: (x["l_linenumber"] % 2).cast("int")), 4, F.lit(-1).cast("long"))
    return z.select("l_orderkey", F.array_join(F.transform(kept, lambda x: x.cast("string")), ",").alias("kept"))


@query("WITH r AS (SELECT toxic AS g, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE quality END AS p FROM labels), c AS (SELECT count(*) FILTER (g = 1 AND p = 1) AS tp, count(*) FILTER (p = 1) AS predicted, count(*) FILTER (g = 1) AS gold FROM r WHERE p <> -1), x AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0.0) AS a, coalesce(tp / nullif(gold, 0), 0.0) AS b FROM c) SELECT tp, predicted, gold, a AS precision, b AS recall, coalesce(2 * a * b / nullif(a + b, 0), 0.0) AS f1 FROM x")
def rates_without_nil(t):
    return metrics.binary_rates(t("labels").select("toxic", F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.col("quality")).alias("p")), "toxic", "p", -1)


@query("SELECT k, avg(CASE WHEN (l_partkey % 40) BETWEEN 1 AND k THEN 1.0 ELSE 0 END) / k AS precision, avg(CASE WHEN (l_partkey % 40) BETWEEN 1 AND k THEN 1.0 ELSE 0 END) AS unnormalized, count(*) FILTER ((l_partkey % 40) BETWEEN 1 AND k) / count(*) FILTER (l_partkey % 40 >= 1) AS normalized FROM lineitem, (SELECT unnest([1, 5, 10]) AS k) GROUP BY 1")
def precision_at_k(t):
    return metrics.precision_at(t("lineitem").select((F.col("l_partkey") % 40).alias("r")), "r", [1, 5, 10])


@query("SELECT p_partkey, CASE WHEN p_size / 50 < 0.5 THEN least(1.5 * 1.1, 2.0) WHEN p_size / 50 > 0.8 THEN greatest(1.5 * 0.9, 0.5) ELSE 1.5 END::DOUBLE AS weight FROM part")
def weight_updates(t):
    return t("part").select("p_partkey", tagging.adjusted_weight(F.col("p_size") / 50, F.lit(1.5)).alias("weight"))


@query("SELECT p_partkey, round(-0.25 * (1 - (p_size / 51)) ** 2 * ln(p_size / 51), 9) AS loss FROM part")
def focal_loss(t):
    return t("part").select("p_partkey", F.round(metrics.focal_loss(F.col("p_size") / 51), 9).alias("loss"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE greatest(1, ceil(strlen(text) / 1024))::BIGINT END AS kb FROM documents")
def text_kilobytes(t):
    return t("documents").select("doc_id", A.kilobytes(F.octet_length("text")).alias("kb"))


@query("SELECT 'part' AS name, count(*) AS n FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def stage_counts(t):
    return metrics.stage_counts({n: t(n) for n in ("part", "orders", "lineitem")})


@query("SELECT DISTINCT event_type, ts::DATE::VARCHAR AS day FROM events")
def first_titles(t):
    events = t("events").select(F.to_date("ts").cast("string").alias("day"), "event_type", "ts")
    path = _folder(events)
    events.write.parquet(f"{path}/in")
    rows = streams.read_folder(events.sparkSession, f"{path}/in", events, 10_000).withColumn("key", F.concat_ws("|", "event_type", "day"))
    return streams.run_once(streams.first_titles(rows, "key", "ts", "1 day").select("event_type", "day"), f"{path}/out", f"{path}/state")


@query("""
WITH r AS (SELECT trim(p_name) AS title, (p_size % 2, p_partkey) AS place, p_partkey::VARCHAR AS pub, trim(p_brand) AS code FROM part WHERE trim(p_name) <> ''),
g AS (SELECT title, min(place) AS first, list_sort(list(DISTINCT pub)) AS pubs, list_sort(list(DISTINCT code)) AS codes FROM r GROUP BY title)
SELECT 'A' || lpad((row_number() OVER (ORDER BY first))::VARCHAR, 7, '0') AS patent_id, title, array_to_string(pubs, ',') AS publication_numbers, array_to_string(codes, ',') AS ipc_codes FROM g
""")
def titles_across_runs(t):
    part = t("part").select(F.col("p_partkey").cast("string").alias("publication_number"), F.col("p_name").alias("title"), F.col("p_brand").alias("ipc_code"), "p_partkey", "p_size")
    spark, path = part.sparkSession, _folder(part)
    for later in (0, 1):
        month = part.filter(F.col("p_size") % 2 == later).repartitionByRange(3, "p_partkey").sortWithinPartitions("p_partkey")
        month.drop("p_partkey", "p_size").write.csv(f"{path}/in/{later}", header=True, quoteAll=True)
        ledger.run(spark, f"{path}/in", f"{path}/ledger")
    return ledger.library(spark, f"{path}/ledger").select("patent_id", "title", *(F.array_join(c, ",").alias(c) for c in ("publication_numbers", "ipc_codes")))


@query("""
WITH e AS (SELECT user_id, ts::TIMESTAMP AS ts, CASE WHEN ts::TIMESTAMP <= lag(ts::TIMESTAMP) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS begins, max(ts) + INTERVAL 30 MINUTE AS ends, count(*) AS n FROM s GROUP BY user_id, s
""")
def user_sessions(t):
    return streams.sessions(t("events")).withColumn("begins", F.col("begins").cast("timestamp_ntz")).withColumn("ends", F.col("ends").cast("timestamp_ntz"))


@query("""
WITH RECURSIVE x AS (SELECT l_orderkey AS k, list([(l_partkey % 7) + l_partkey * 0.00137::DOUBLE, (l_suppkey % 5) + l_partkey * 0.00071::DOUBLE, (l_quantity % 6)::DOUBLE] ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS e FROM lineitem GROUP BY 1),
r AS (SELECT k, e, 1 AS i, list_transform(range(1, 4), lambda j: {'s': e[1][j] + [0.5, 0.31, -2.0][j], 'p': (j - 1)::VARCHAR}) AS b FROM x
  UNION ALL SELECT k, e, i + 1, list_transform(range(1, 4), lambda j: (WITHIN)) FROM r WHERE i < len(e))
SELECT k AS l_orderkey, arg_max(best, i) AS tags FROM (SELECT k, i, list_sort(list_transform(b, lambda z, j: {'s': -(z.s + [0.0, 0.17, 0.29][j]), 'p': z.p}))[1].p AS best FROM r) GROUP BY 1
""".replace("WITHIN", "{'s': -(list_sort(list_transform(b, lambda z, a: {'s': -(z.s + [[1.0137, 0.4171, -3.0291], [0.2213, 0.6337, 1.1459], [0.7591, 0.3539, 0.9677]][a][j]), 'p': z.p}))[1].s) + e[i + 1][j], 'p': list_sort(list_transform(b, lambda z, a: {'s': -(z.s + [[1.0137, 0.4171, -3.0291], [0.2213, 0.6337, 1.1459], [0.7591, 0.3539, 0.9677]][a][j]), 'p': z.p}))[1].p || (j - 1)::VARCHAR}"))
def crf_decoding(t):
    import numpy as np

    e = F.array((F.col("l_partkey") % 7) + F.col("l_partkey") * F.lit(0.00137), (F.col("l_suppkey") % 5) + F.col("l_partkey") * F.lit(0.00071), (F.col("l_quantity") % 6).cast("double"))
    x = t("lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", e.alias("e")))), lambda z: z["e"]).alias("e"))
    decode = tagging.viterbi(np.array([[1.0137, 0.4171, -3.0291], [0.2213, 0.6337, 1.1459], [0.7591, 0.3539, 0.9677]]), np.array([0.5, 0.31, -2.0]), np.array([0.0, 0.17, 0.29]))
    return x.select("l_orderkey", F.array_join(F.transform(decode("e"), lambda k: k.cast("string")), "").alias("tags"))


@query("""
WITH RECURSIVE x AS (SELECT l_orderkey AS k, list([(l_partkey % 7) + l_partkey * 0.00137::DOUBLE, (l_suppkey % 5) + l_partkey * 0.00071::DOUBLE, (l_quantity % 6)::DOUBLE] ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS e,
  list((l_partkey % 3) + 1 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS g FROM lineitem GROUP BY 1),
m AS (SELECT [[1.0137, 0.4171, -3.0291], [0.2213, 0.6337, 1.1459], [0.7591, 0.3539, 0.9677]]::DOUBLE[][] AS t, [0.5, 0.31, -2.0]::DOUBLE[] AS s, [0.0, 0.17, 0.29]::DOUBLE[] AS f),
r AS (SELECT k, e, g, len(e) AS i, f AS b FROM x, m
  UNION ALL SELECT k, e, g, i - 1, list_transform(range(1, 4), lambda j: ln(list_sum(list_transform(range(1, 4), lambda c: exp(t[j][c] + e[i][c] + b[c]))))) FROM r, m WHERE i > 1),
z AS (SELECT k, e, g, b, ln(list_sum(list_transform(range(1, 4), lambda j: exp(s[j] + e[1][j] + b[j])))) AS z FROM r, m WHERE i = 1),
p AS (SELECT k, z, exp(s[1] + e[1][1] + b[1] - z) AS first, s[g[1]] + list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i][g[i]])) + coalesce(list_sum(list_transform(range(2, len(e) + 1), lambda i: t[g[i - 1]][g[i]])), 0) + f[g[len(g)]] AS score FROM z, m)
SELECT k AS l_orderkey, round(z, 6) AS log_partition, round(first, 6) AS first_marginal, round(score, 6) AS path_score FROM p
""")
def crf_marginals(t):
    import numpy as np

    weights = np.array([[1.0137, 0.4171, -3.0291], [0.2213, 0.6337, 1.1459], [0.7591, 0.3539, 0.9677]]), np.array([0.5, 0.31, -2.0]), np.array([0.0, 0.17, 0.29])
    e = F.array((F.col("l_partkey") % 7) + F.col("l_partkey") * F.lit(0.00137), (F.col("l_suppkey") % 5) + F.col("l_partkey") * F.lit(0.00071), (F.col("l_quantity") % 6).cast("double"))
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", e.alias("e"), (F.col("l_partkey") % 3).cast("int").alias("g"))))
    x = t("lineitem").groupBy("l_orderkey").agg(lines.alias("z")).select("l_orderkey", F.transform("z", lambda z: z["e"]).alias("e"), F.transform("z", lambda z: z["g"]).alias("g"))
    both = x.select("l_orderkey", tagging.forward_backward(*weights)("e").alias("f"), tagging.path_score(*weights)("e", "g").alias("p"))
    first = F.get(F.get("f.marginals", F.lit(0)), F.lit(0))
    return both.select("l_orderkey", F.round("f.log_partition", 6).alias("log_partition"), F.round(first, 6).alias("first_marginal"), F.round("p", 6).alias("path_score"))
