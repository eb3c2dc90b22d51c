"""Whole chains: titles to phrases and their library, static entities, the hierarchy, and event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import arrays as A
from ..functions import text as T
from ..functions.staging import stage
from ..operators import dedup, filters, hierarchy, ids, joins, matching, sampling, similarity, tagging
from ..streaming.queries import event_counts as counted
from .entities import _FLAT, _blocks
from .linking import SPLIT_SQL, phrases
from .texts import _TITLES

OFFSET = 11834


def patents(rows: DataFrame, static: DataFrame, number: str, title: str, code: str, order: str) -> dict[str, DataFrame]:
    """titles, library (new_id, name, ipc_codes) and patents (patent_id, spans) of raw rows.

    Titles are de-duplicated and numbered; each gives the phrase of its first tokens; phrases are
    cleaned, merged and numbered after the offset, and names of the static level keep that level's id;
    the spans of patents point to the new ids.
    """
    titles = ids.title_groups(rows, title, number, code, order)
    found = titles.select("patent_id", "first", "ipc_codes", T.simple_phrase_tokens("title").alias("w")).filter(F.size("w") > 0)
    found = found.select("patent_id", F.col("first").alias("old_id"), T.clean_phrase(F.array_join("w", " ")).alias("name"), F.array_join("ipc_codes", ",").alias("codes"), (F.size("w") - 1).alias("end"))
    merged = dedup.merge_phrases(found, "name", "old_id", "codes")
    new = ids.reindexed(filters.not_in(merged, static, ["name"]), "name", OFFSET)
    named = new.unionByName(static.select("name", F.col("id").alias("new_id")))
    library = merged.join(named, "name").select("new_id", "name", "ipc_codes", "old_ids")
    mapping = library.select(F.explode("old_ids").alias("old_id"), "new_id")
    spans = F.array(F.struct(F.col("old_id").alias("fot_id"), F.lit(0).alias("start"), F.col("end").alias("end")))
    return {"titles": titles, "library": library, "patents": joins.remap_spans(found.select("patent_id", spans.alias("spans")), "spans", mapping, "patent_id")}


_PATENTS = f"""{_TITLES},
w AS (SELECT *, list_filter(string_split(trim(regexp_replace(title, '\\s+', ' ', 'g')), ' '), lambda x: regexp_matches(x, '^[\\p{{L}}\\p{{N}}]+$'))[:2] AS w FROM ids),
f AS (SELECT patent_id, ipcs, array_to_string(w, ' ') AS name, len(w) - 1 AS last FROM w WHERE len(w) > 0),
st AS (SELECT r_name AS name, r_regionkey AS id FROM region UNION ALL SELECT min(name), 77 FROM f),
n AS (SELECT name, row_number() OVER (ORDER BY name) + 11834 AS new_id FROM (SELECT DISTINCT name FROM f WHERE name NOT IN (SELECT name FROM st)) UNION ALL SELECT name, id FROM st)
"""


@query(f"WITH {_PATENTS} SELECT patent_id, new_id::VARCHAR || ':0:' || last::VARCHAR AS fot FROM f JOIN n USING (name)")
def patent_pipeline(t):
    done = patents(t("part"), _static(t), "p_partkey", "p_name", "p_brand", "p_partkey")
    return done["patents"].select("patent_id", A.format_spans(F.col("spans")).alias("fot"))


def _static(t):
    first = t("part").select(T.simple_phrase_tokens("p_name").alias("w")).filter(F.size("w") > 0).agg(F.min(F.array_join("w", " ")).alias("name")).select("name", F.lit(77).cast("long").alias("id"))
    return t("region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("id")).unionByName(first)


@query(f"WITH {_PATENTS}, c AS (SELECT name, unnest(ipcs) AS c FROM f) SELECT new_id, name, string_agg(DISTINCT c, ',' ORDER BY c) AS ipc_codes FROM c JOIN n USING (name) GROUP BY 1, 2")
def patent_library(t):
    done = patents(t("part"), _static(t), "p_partkey", "p_name", "p_brand", "p_partkey")
    return done["library"].select("new_id", "name", F.array_join("ipc_codes", ",").alias("ipc_codes"))


@query("""
WITH f AS (SELECT p_partkey AS id, p_name AS name, p_brand AS code, p_retailprice AS score FROM part WHERE regexp_matches(p_type, 'E|A') AND p_name <> 'red steel'),
d AS (SELECT *, row_number() OVER (PARTITION BY lower(name), code ORDER BY score DESC, id) AS n FROM f)
SELECT id, name, code, CASE WHEN id % 2 = 0 THEN 2 ELSE 3 END AS level FROM d WHERE n = 1
""")
def static_pipeline(t):
    flat = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("text"), F.col("p_brand").alias("parent_ipc"), F.col("p_retailprice").alias("score"), F.lit(0.0).alias("sim"))
    kept = dedup.dedupe_exact(filters.rules_filter(flat, ["red steel"], {"text": "E|A"}, {}))
    level2, level3 = (kept.filter(F.col("id") % 2 == r).select("id", "name", F.col("parent_ipc").alias("code"), F.lit(level).alias("level")) for r, level in ((0, 2), (1, 3)))
    return level2.unionByName(level3)


def static_stage(kept: DataFrame, listed: DataFrame, chosen: Column, encode: Callable[[Column], Column], prefix: int = 3, similar: float | None = None) -> DataFrame:
    """(id, name, level, codes, parent): the static vocabulary of candidates that a filter kept and entities that a whitelist lists.

    kept: ipc, level, id, name, text, score. Those of levels 1 and 2, and the listed ones, are level 2's
    seeds and go through. Of the rest the ``chosen`` get the seed of the largest cosine whose code begins
    alike (none: null parent; ties to the smaller id; listed names without an id are no parents) and are
    de-duplicated: by name, or, with ``similar``, by exact names and then near ones within a code. A
    candidate of several codes has one parent for all. Vectors are those of name and text.
    """
    own = kept.select("id", "name", F.coalesce("text", F.lit("")).alias("text"), F.col("ipc").alias("code"), "level", F.col("score").cast("double").alias("score"), chosen.alias("chosen"))
    seeds = own.filter("level <= 2").select("id", "name", "text", "code").unionByName(listed.select("id", "name", "text", F.col("ent_ipc").alias("code")))
    third = stage(own.filter("level > 2 and chosen").drop("chosen", "level"), "third")
    body = F.trim(F.concat_ws(" ", "name", "text"))
    vectors = lambda f: f.withColumn("body", body).groupBy(F.substring("code", 1, prefix).alias("block"), "id").agg(F.min("body").alias("body")).withColumn("v", encode(F.col("body"))).drop("body")
    parents = similarity.nearest_parent(vectors(third), vectors(seeds.filter("id >= 0")), False).groupBy("id").agg(F.max_by("parent", F.struct("sim", -F.col("parent"))).alias("parent"))
    if similar is None:
        once = dedup.dedupe_entities(third.select("name", "code", "id"), "name", "code", "id").withColumnRenamed("code", "codes")
    else:
        exact = dedup.dedupe_exact(third.select("id", "name", F.col("code").alias("parent_ipc"), "score", F.lit(0.0).alias("sim")))
        once = dedup.dedupe_greedy(exact, similar).select("id", "name", F.array("parent_ipc").alias("codes"))
    level3 = once.join(parents, "id", "left").select("id", "name", F.lit(3).alias("level"), "codes", "parent")
    return seeds.select("id", "name", F.lit(2).alias("level"), F.array("code").alias("codes"), F.lit(None).cast("long").alias("parent")).unionByName(level3)


_LETTERS = "aeilnorst"


def _letter_counts(text: Column) -> Column:
    return F.array(F.lit(1.0), *((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in _LETTERS))


@query(f"""
WITH {_FLAT}, kept AS (SELECT * FROM flat WHERE name <> 'red steel' AND regexp_matches(text, 'E|A')),
catalog AS (SELECT upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS title, max(p_partkey) AS id FROM part GROUP BY 1),
listed AS (SELECT DISTINCT id, title AS name, p_brand AS code FROM part JOIN catalog ON title = upper(left(p_name, 1)) || lower(substr(p_name, 2)) WHERE p_size = 7 UNION ALL SELECT -1, 'no such name', ''),
seeds AS (SELECT id, name, text, ipc AS code FROM kept WHERE level <= 2 UNION ALL SELECT id, name, CASE WHEN id >= 0 THEN 'x' ELSE '' END, regexp_replace(code, '#', '') FROM listed),
third AS (SELECT id, name, text, ipc AS code FROM kept WHERE level > 2 AND score >= 1000),
every AS (SELECT 's' AS kind, left(code, 7) AS block, id, min(trim(name || ' ' || text)) AS body FROM seeds WHERE id >= 0 GROUP BY ALL UNION ALL SELECT 't', left(code, 7), id, min(trim(name || ' ' || text)) FROM third GROUP BY ALL),
vectors AS (SELECT kind, block, id, list_transform(string_split_regex(',{_LETTERS}', ''), lambda c: CASE WHEN c = ',' THEN 1 ELSE len(body) - len(replace(body, c, '')) END::DOUBLE) AS e FROM every),
best AS (SELECT a.id, b.id AS parent, row_number() OVER (PARTITION BY a.id ORDER BY round(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)), 12) DESC, b.id) AS n FROM vectors a JOIN vectors b ON a.block = b.block WHERE a.kind = 't' AND b.kind = 's'),
names AS (SELECT name, min(id) AS id, array_to_string(list_sort(list_distinct(list(code))), ',') AS codes FROM third GROUP BY 1)
SELECT id, name, 2 AS level, code AS codes, NULL AS parent FROM seeds UNION ALL SELECT names.id, name, 3, codes, parent FROM names LEFT JOIN best ON names.id = best.id AND n = 1
""")
def static_chain(t):
    part = t("part")
    kept = filters.rules_filter(filters.flatten_candidates(_blocks(t), ["bi", "cross"]), ["red steel"], {"text": "E|A"}, {})
    catalog = part.groupBy(T.capitalize("p_name").alias("title")).agg(F.max("p_partkey").alias("id")).withColumn("text", F.lit("x"))
    # codes in brackets are word characters
    names = part.filter("p_size = 7").select(F.concat("p_name", F.lit("["), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("]")).alias("entry")).distinct()
    listed = filters.whitelist(names.unionByName(part.sparkSession.createDataFrame([("no such name",)], "entry string")), catalog)
    done = static_stage(kept, listed, F.col("score") >= 1000, _letter_counts, prefix=7)
    return done.select("id", "name", "level", F.array_join("codes", ",").alias("codes"), "parent")


def corpus(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, term: str, clean: Callable[[Column], Column] = T.squeeze, top: int = 50, times: int = 2, seed: int = 42) -> DataFrame:
    """(key, source_id, tokens, tags, split): tagged sentences of the first texts that hold each term, and untagged ones of texts that hold none.

    Texts are cleaned and cut at blanks; a term is tagged where it stands as whole tokens for the first
    time, and texts where it doesn't drop out; ``times`` as many texts without any term follow, whose
    source is unknown_entity. Of equal tokens the smallest (source, key) stays. Splits go by source.
    """
    source = stage(texts.select(F.col(key).alias("key"), clean(F.col(text)).alias("text")).filter("text is not null"), "texts")
    hits = stage(matching.substring_matches(source, "text", "key", vocabulary, term), "hits")
    found = matching.substring_join(source, "text", "key", vocabulary, term, top, hits).filter("key is not null").select("key", F.col("term").alias("source_id"))
    marked = tagging.single_entity_tags(found.join(source, "key").withColumn("tokens", F.split("text", " ", -1)), "tokens", F.col("source_id"), "tags")
    tagged = stage(marked.filter(F.array_contains("tags", "B-FOT")).select("key", "source_id", "tokens", "tags"), "tagged")
    held = hits.select("key").distinct()
    none = sampling.sample(source.select("key").join(held, "key", "left_anti"), "key", times * tagged.count(), seed)
    rest = source.join(none, "key", "left_semi").select("key", F.lit("unknown_entity").alias("source_id"), F.split("text", " ", -1).alias("tokens")).withColumn("tags", F.transform("tokens", lambda w: F.lit("O")))
    every = stage(tagged.unionByName(rest), "every")
    first = every.groupBy(F.sha2(F.array_join("tokens", " "), 256)).agg(F.min(F.struct("source_id", "key")).alias("r")).select("r.*")
    return sampling.group_split(every.join(first, ["source_id", "key"], "left_semi"), "source_id", "key", F.array_contains("tags", "B-FOT"), seed=seed)


@query(rf"""
WITH p AS (SELECT DISTINCT lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) AS term FROM benchmark),
d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL),
h AS (SELECT term, doc_id, text, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS n FROM p JOIN d ON contains(lower(text), term)),
pos AS (SELECT *, left(' ' || lower(text) || ' ', strpos(' ' || lower(text) || ' ', ' ' || term || ' ') - 1) AS before FROM h WHERE n <= 10 AND contains(' ' || lower(text) || ' ', ' ' || term || ' ')),
neg AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM h) ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id LIMIT (SELECT 2 * count(*) FROM pos)),
every AS (SELECT term AS g, doc_id AS k, text, true AS tagged, len(before) - len(replace(before, ' ', '')) AS at_token FROM pos UNION ALL SELECT 'unknown_entity', doc_id, text, false, -1 FROM neg),
rows_ AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY text ORDER BY g, k) = 1), {SPLIT_SQL}
SELECT k AS key, g AS source_id, md5(text) AS digest, at_token::BIGINT AS at, (CASE WHEN tagged THEN 2 ELSE 0 END)::BIGINT AS n_tagged, split FROM kinds JOIN splits USING (kind, unit)
""")
def corpus_stage(t):
    done = corpus(t("documents"), "doc_id", "text", phrases(t), "term")
    return done.select("key", "source_id", F.md5(F.array_join("tokens", " ")).alias("digest"), (F.array_position("tags", "B-FOT") - 1).cast("long").alias("at"), F.size(F.filter("tags", lambda x: x != "O")).cast("long").alias("n_tagged"), "split")


def build_hierarchy(vectors: DataFrame, static: DataFrame, eps: float, least: int, threshold: float) -> DataFrame:
    """(id, layer, parents): density clusters, layers by depth in each cluster's tree, then parents one layer up. Both frames have id, v, codes; static also layer."""
    clusters = hierarchy.density_clusters(vectors.select("id", "v"), eps, least)
    depths = hierarchy.cluster_depths(vectors.select("id", "v").join(clusters, "id"))
    layered = vectors.join(hierarchy.layers(depths, "cluster", "depth").select("id", "layer"), "id")
    every = layered.unionByName(static.select(*layered.columns))
    links = similarity.parents_by_class(layered, every, threshold=threshold).groupBy("id").agg(F.array_sort(F.collect_list("parent")).alias("parents"))
    return layered.select("id", "layer").join(links, "id", "left")


@query()
def hierarchy_pipeline(t):
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.array(F.concat(F.char(65 + F.col("label") % 4), F.lit("01"))).alias("codes"))
    done = build_hierarchy(v.filter("id % 5 <> 0"), v.filter("id % 5 = 0").withColumn("layer", F.lit(3)), 0.28, 3, 0.3)
    return done.select("id", "layer", F.array_join(F.transform("parents", lambda x: x.cast("string")), ";").alias("parent"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS begins, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(t):
    return counted(t("events")).withColumn("begins", F.col("begins").cast("timestamp_ntz"))
