"""Queries that clean, merge, filter and remap entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import arrays as A
from ..operators import dedup, filters, ids, joins
from .texts import _PHRASES, phrases

_MERGED = f"""{_PHRASES},
cleaned AS (SELECT p_partkey, trim(name) AS name, p_brand || ', ' || p_type AS codes FROM phrases),
exploded AS (SELECT name, trim(unnest(string_split(codes, ','))) AS c FROM cleaned),
sets AS (SELECT name, list_sort(list_distinct(list(c))) AS ipc_codes FROM exploded WHERE c <> '' GROUP BY 1),
merged AS (SELECT name, list_sort(list_distinct(list(p_partkey))) AS old_ids, min(p_partkey) AS first_id FROM cleaned GROUP BY 1)
"""


def merged(t):
    return dedup.merge_phrases(phrases(t).select("p_partkey", "name", F.concat("p_brand", F.lit(", "), "p_type").alias("codes")), "name", "p_partkey", "codes")


@query(f"WITH {_MERGED} SELECT name, array_to_string(old_ids, ',') AS old_ids, array_to_string(ipc_codes, ',') AS ipc_codes, first_id FROM merged JOIN sets USING (name)")
def merge_phrases(t):
    return merged(t).select("name", F.array_join(F.transform("old_ids", lambda x: x.cast("string")), ",").alias("old_ids"), F.array_join("ipc_codes", ",").alias("ipc_codes"), "first_id")


@query(f"WITH {_MERGED} SELECT name, row_number() OVER (ORDER BY name) + 11834 AS new_id FROM merged")
def reindex_ids(t):
    return ids.reindexed(merged(t), "name", 11834)


_ITEMS = """
items AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem),
m AS (SELECT p_partkey AS old_id, p_partkey * 10 + 1 AS new_id FROM part WHERE p_partkey % 4 <> 0)
"""


@query(f"""
WITH {_ITEMS}
SELECT l_orderkey AS patent_id, string_agg(coalesce(new_id, l_partkey)::VARCHAR || ':' || l_linenumber::VARCHAR || ':' || (l_linenumber + 1)::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS fot FROM items LEFT JOIN m ON l_partkey = old_id GROUP BY 1
""")
def remap_spans(t):
    span = F.struct(F.col("l_linenumber").cast("int").alias("at"), F.col("l_partkey").alias("fot_id"), F.col("l_linenumber").cast("int").alias("start"), (F.col("l_linenumber") + 1).cast("int").alias("end"))
    lists = t("lineitem").groupBy(F.col("l_orderkey").alias("patent_id")).agg(F.array_sort(F.collect_list(span)).alias("s"))
    spans = lists.select("patent_id", F.transform("s", lambda x: F.struct(x["fot_id"].alias("fot_id"), x["start"].alias("start"), x["end"].alias("end"))).alias("fot"))
    mapping = t("part").filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("old_id"), (F.col("p_partkey") * 10 + 1).alias("new_id"))
    return joins.remap_spans(spans, "fot", mapping, "patent_id").select("patent_id", A.format_spans(F.col("fot")).alias("fot"))


@query("SELECT p_partkey, p_name, p_brand FROM part p WHERE NOT EXISTS (SELECT 1 FROM part s WHERE s.p_size > 25 AND s.p_name = p.p_name AND s.p_brand = p.p_brand)")
def static_anti_filter(t):
    part = t("part")
    return filters.not_in(part, part.filter("p_size > 25"), ["p_name", "p_brand"]).select("p_partkey", "p_name", "p_brand")


def _blocks(t):
    one = lambda c: F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("text"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_retailprice").alias("score"))
    lists = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(F.col("p_partkey").alias("k"), one(None).alias("c"))))), lambda x: x["c"])
    return t("part").groupBy(F.col("p_brand").alias("ipc"), (F.col("p_size") % 5).alias("level"), F.concat(F.lit("q"), (F.col("p_size") % 5).cast("string")).alias("text")).agg(lists(F.col("p_partkey") % 2 == 0).alias("bi"), lists(F.col("p_partkey") % 2 == 1).alias("cross"))


_FLAT = """
flat AS (SELECT p_brand AS ipc, p_size % 5 AS level, 'q' || (p_size % 5)::VARCHAR AS query_text, CASE WHEN p_partkey % 2 = 0 THEN 'bi' ELSE 'cross' END AS list, row_number() OVER (PARTITION BY p_brand, p_size % 5, p_partkey % 2 ORDER BY p_partkey)::INT AS pos, p_partkey AS id, p_name AS name, p_type AS text, 'u' || p_partkey::VARCHAR AS url, p_retailprice AS score FROM part)
"""


@query(f"WITH {_FLAT} SELECT ipc, level, query_text, list, pos, id, name FROM flat WHERE name NOT IN ('red steel') AND regexp_matches(text, 'E|A') AND NOT (regexp_matches(name, 'a') AND regexp_matches(text, 'O'))")
def rules_filter(t):
    flat = filters.flatten_candidates(_blocks(t), ["bi", "cross"])
    return filters.rules_filter(flat, ["red steel"], {"text": "E|A"}, {"name": "a", "text": "O"}).select("ipc", "level", "query_text", "list", "pos", "id", "name")


@query(f"""
WITH {_FLAT}, keep AS (SELECT DISTINCT ipc, query_text, list, pos, pos * 100 AS parent_id FROM flat WHERE (pos + length(ipc)) % 3 = 1)
SELECT id, name, ipc, list, pos, parent_id FROM flat JOIN keep USING (ipc, query_text, list, pos)
""")
def positional_filter(t):
    flat = filters.flatten_candidates(_blocks(t), ["bi", "cross"])
    keep = flat.filter((F.col("pos") + F.length("ipc")) % 3 == 1).select("ipc", "query_text", "list", "pos", (F.col("pos") * 100).alias("parent_id")).distinct()
    return filters.positional_filter(flat, keep, ["ipc", "query_text", "list", "pos"]).select("id", "name", "ipc", "list", "pos", "parent_id")


@query("""
WITH catalog AS (SELECT upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS title, max(p_partkey) AS id FROM part GROUP BY 1),
n AS (SELECT DISTINCT p_name || '[' || left(p_brand, 3) || ']' AS entry FROM part WHERE p_size % 2 = 0 UNION SELECT DISTINCT upper(left(p_name, 1)) || lower(substr(p_name, 2)) FROM part UNION SELECT 'no such name' UNION SELECT 'nor this[A01]'),
s AS (SELECT entry, regexp_matches(entry, '^.+\\[\\w+\\]') AS coded FROM n),
x AS (SELECT coded, CASE WHEN coded THEN regexp_extract(entry, '^(.+)\\[(\\w+)\\]', 2) ELSE '' END AS ent_ipc, CASE WHEN coded THEN upper(left(trim(regexp_extract(entry, '^(.+)\\[(\\w+)\\]', 1)), 1)) || lower(substr(trim(regexp_extract(entry, '^(.+)\\[(\\w+)\\]', 1)), 2)) ELSE trim(entry) END AS name FROM s)
SELECT coalesce(id, -1)::BIGINT AS id, name, CASE WHEN id IS NULL THEN '' ELSE 'https://en.wikipedia.org/wiki?curid=' || id::VARCHAR END AS url, CASE WHEN coded THEN 1 ELSE 2 END AS level, ent_ipc FROM x LEFT JOIN catalog ON name = title WHERE NOT coded OR id IS NOT NULL
""")
def whitelist_augment(t):
    from ..functions.text import capitalize

    part = t("part")
    catalog = part.groupBy(capitalize("p_name").alias("title")).agg(F.max("p_partkey").alias("id")).withColumn("text", F.lit("x"))
    coded = part.filter("p_size % 2 = 0").select(F.concat("p_name", F.lit("["), F.substring("p_brand", 1, 3), F.lit("]")).alias("entry"))
    more = part.sparkSession.createDataFrame([("no such name",), ("nor this[A01]",)], "entry string")
    names = coded.unionByName(part.select(capitalize("p_name").alias("entry"))).unionByName(more).distinct()
    return filters.whitelist(names, catalog).select("id", "name", "url", "level", "ent_ipc")


@query("SELECT p_name AS name, arg_min(p_partkey, p_partkey) AS p_partkey, arg_min(p_type, p_partkey) AS p_type, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS codes FROM part GROUP BY 1")
def entity_dedupe_simple(t):
    done = dedup.dedupe_entities(t("part").select("p_name", "p_brand", "p_partkey", "p_type", F.col("p_partkey").alias("ord")), "p_name", "p_brand", "ord")
    return done.select(F.col("p_name").alias("name"), "p_partkey", "p_type", F.array_join("p_brand", ",").alias("codes"))


def _scored(t):
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name"))
    return t("part").select(F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_brand").alias("parent_ipc"), F.col("p_retailprice").alias("score"), (F.col("p_size") / 50.0).alias("sim"))


@query("""
WITH s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS name, p_brand AS parent_ipc, p_retailprice AS score, p_size / 50.0 AS sim FROM part),
r AS (SELECT *, row_number() OVER w AS n, list_sort(list_distinct(list(name) OVER (PARTITION BY lower(trim(name)), parent_ipc))) AS names FROM s WINDOW w AS (PARTITION BY lower(trim(name)), parent_ipc ORDER BY score DESC, sim DESC, id))
SELECT id, name, parent_ipc, CASE WHEN len(names) > 1 THEN array_to_string(names, ',') ELSE '' END AS aliases FROM r WHERE n = 1
""")
def entity_dedupe_exact(t):
    return dedup.dedupe_exact(_scored(t)).select("id", "name", "parent_ipc", F.array_join("aliases", ",").alias("aliases"))


@query()
def entity_dedupe_greedy(t):
    return dedup.dedupe_greedy(dedup.dedupe_exact(_scored(t)), 0.9).select("id", "name", "parent_ipc", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT DISTINCT string_split(text, ' ') AS tokens FROM documents")
def distinct_records(t):
    return t("documents").select(F.split("text", " ", -1).alias("tokens")).dropDuplicates()


@query("""
WITH a AS (SELECT DISTINCT p_name AS name, 'a' AS source FROM part WHERE p_size < 20), b AS (SELECT DISTINCT p_name AS name, 'b' AS source FROM part)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE name NOT IN (SELECT name FROM a)
""")
def union_first_wins(t):
    part = t("part")
    a = part.filter("p_size < 20").select(F.col("p_name").alias("name"), F.lit("a").alias("source")).distinct()
    return dedup.union_first([a, part.select(F.col("p_name").alias("name"), F.lit("b").alias("source")).distinct()], "name")


@query("SELECT p_brand AS code, count(*) AS n, avg(p_size)::DOUBLE AS mean, median(p_size)::DOUBLE AS median, max(p_partkey) AS largest FROM part GROUP BY 1")
def candidate_stats(t):
    return t("part").groupBy(F.col("p_brand").alias("code")).agg(F.count("*").alias("n"), F.avg("p_size").alias("mean"), F.median("p_size").alias("median"), F.max("p_partkey").alias("largest"))


@query("SELECT p_name FROM part WHERE p_size < 10 INTERSECT SELECT p_name FROM part WHERE p_size > 40")
def split_leak(t):
    part = t("part")
    return part.filter("p_size < 10").select("p_name").intersect(part.filter("p_size > 40").select("p_name"))
