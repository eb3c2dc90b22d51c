"""Queries over mentions and their candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import attention, joins, mentions
from .linking import _SPANS, _TAGGED, _tagged


@query("""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS a, string_split(source || ' ' || lang, ' ') || string_split(text, ' ') AS b FROM documents),
n AS (SELECT *, least(len(b), greatest(24, 48 - len(a))) AS nb FROM w)
SELECT doc_id, array_to_string(a[:least(len(a), 48 - nb)], ' ') AS a, array_to_string(b[:nb], ' ') AS b FROM n
""")
def truncate_pairs(t):
    words = F.split("text", " ", -1)
    df = t("documents").select("doc_id", words.alias("a"), F.concat(F.array("source", "lang"), words).alias("b"))
    a, b = mentions.truncated_pair(F.col("a"), F.col("b"), 48)
    return df.select("doc_id", F.array_join(a, " ").alias("a"), F.array_join(b, " ").alias("b"))


@query("SELECT doc_id, array_to_string((string_split(source, ' ') || ['[ENT]'] || string_split(text, ' '))[:30], ' ') AS tokens FROM documents")
def candidate_texts(t):
    return t("documents").select("doc_id", F.array_join(mentions.candidate_text(F.col("source"), F.col("text"), "[ENT]", 32), " ").alias("tokens"))


@query("""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w, len(string_split(text, ' '))::INT AS n FROM documents),
m AS (SELECT *, list_filter(list_transform([0.2, 0.4, 0.9], lambda x: {'s': floor(n * x)::INT, 'e': least(floor(n * x)::INT + 2, n)}), lambda m: m.e > m.s) AS ms FROM w),
k AS (SELECT *, list_filter(ms, lambda m: m.e - ms[1].s <= 40) AS ks FROM m),
b AS (SELECT *, coalesce(ks[1].s, 0) AS s, coalesce(list_max(list_transform(ks, lambda m: m.e)), 0) AS e FROM k),
r AS (SELECT *, greatest(40 - (e - s), 0) AS room FROM b),
l AS (SELECT *, least(s, greatest(room // 2, room - (n - e))) AS nl, least(n - e, greatest(room - room // 2, room - s)) AS nr FROM r)
SELECT doc_id, array_to_string(w[s - nl + 1:e + nr], ' ') AS window, array_to_string(list_transform(ks, lambda m: (m.s - s + nl)::VARCHAR || '-' || (m.e - s + nl)::VARCHAR), ',') AS mentions FROM l
""")
def mention_window(t):
    words = t("documents").select("doc_id", F.split("text", " ", -1).alias("w")).withColumn("n", F.size("w"))
    at = lambda x: F.struct(F.floor(F.col("n") * x).cast("int").alias("start"), F.least(F.floor(F.col("n") * x).cast("int") + 2, F.col("n")).alias("end"))
    df = words.withColumn("m", F.filter(F.array(at(F.lit(0.2)), at(F.lit(0.4)), at(F.lit(0.9))), lambda m: m["end"] > m["start"]))
    done = mentions.mention_windows(df, "w", "m", 40)
    return done.select("doc_id", F.array_join("window", " ").alias("window"), F.array_join(F.transform("shifted", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",").alias("mentions"))


@query("""
WITH c AS (SELECT p_brand, p_size % 3 AS k, string_split(p_brand || ' is a brand of size', ' ') AS ctx, list(string_split(p_name || ' ' || p_type, ' ') ORDER BY p_partkey) AS cands FROM part GROUP BY 1, 2),
e AS (SELECT p_brand, k, ctx, unnest(range(len(cands)))::INT AS pos, unnest(cands) AS c FROM c)
SELECT p_brand, k, pos, array_to_string((ctx || c[2:])[:8], ' ') AS pair FROM e
""")
def cross_pairs(t):
    tokens = F.struct("p_partkey", F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("c"))
    df = t("part").groupBy("p_brand", (F.col("p_size") % 3).alias("k")).agg(F.transform(F.array_sort(F.collect_list(tokens)), lambda x: x["c"]).alias("cands"))
    df = df.withColumn("ctx", F.split(F.concat("p_brand", F.lit(" is a brand of size")), " "))
    return mentions.cross_pairs(df, "ctx", "cands", 8).select("p_brand", "k", "pos", F.array_join("pair", " ").alias("pair"))


_ANCHORS = "anchors AS (SELECT CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN initcap_(p_name) ELSE upper(p_name) END AS text, p_brand AS entity FROM part)"
_INITCAP = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"


@query(f"""
WITH {_ANCHORS.replace('initcap_(p_name)', _INITCAP)}, asked AS (SELECT DISTINCT CASE WHEN length(p_name) % 2 = 0 THEN p_name ELSE upper(left(p_name, 3)) || substr(p_name, 4) END AS mention FROM part),
n AS (SELECT text, entity, count(*) AS n FROM anchors GROUP BY 1, 2), tot AS (SELECT text, sum(n) AS t FROM n GROUP BY 1),
f AS (SELECT mention, array_to_string(list_transform(string_split(mention, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS titled FROM asked),
b AS (SELECT mention, CASE WHEN coalesce(x.t, 0) >= coalesce(y.t, 0) THEN x.text ELSE y.text END AS text FROM f LEFT JOIN tot x ON x.text = titled LEFT JOIN tot y ON y.text = mention),
low AS (SELECT lower(text) AS text, entity, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lower(text)) AS t FROM n GROUP BY 1, 2)
SELECT mention, entity, round(n / t, 6) AS p FROM b JOIN n USING (text) JOIN tot USING (text) UNION ALL SELECT mention, entity, round(n / t, 6) FROM b JOIN low ON low.text = lower(mention) WHERE b.text IS NULL
""")
def candidate_priors(t):
    k = F.col("p_size") % 3
    anchors = t("part").select(F.when(k == 0, F.col("p_name")).when(k == 1, F.initcap("p_name")).otherwise(F.upper("p_name")).alias("text"), F.col("p_brand").alias("entity"))
    asked = t("part").select(F.when(F.length("p_name") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.upper(F.substring("p_name", 1, 3)), F.substring("p_name", 4, 1000))).alias("mention")).distinct()
    return mentions.candidate_priors(anchors, asked).select("mention", "entity", F.round("p", 6).alias("p"))


@query("""
WITH p AS (SELECT DISTINCT p_size % 10 AS doc, p_name AS "full" FROM part), m AS (SELECT DISTINCT p_size % 10 AS doc, split_part(p_name, ' ', 1) AS mention FROM part),
pairs AS (SELECT m.doc, mention, "full" FROM m JOIN p ON m.doc = p.doc AND mention <> "full" AND contains(' ' || "full" || ' ', ' ' || mention || ' ')),
pri AS (SELECT p_name AS "full", p_brand AS entity, count(*) / sum(count(*)) OVER (PARTITION BY p_name) AS p FROM part GROUP BY 1, 2),
k AS (SELECT doc, mention, count(*) AS n FROM pairs GROUP BY 1, 2)
SELECT doc, mention, entity, round(sum(p) / any_value(n), 6) AS score FROM pairs JOIN pri USING ("full") JOIN k USING (doc, mention) GROUP BY 1, 2, 3
""")
def coref_scores(t):
    part = t("part").select((F.col("p_size") % 10).alias("doc"), F.col("p_name").alias("mention"), "p_brand")
    pairs = joins.coreferences(part.select("doc", F.get(F.split("mention", " "), F.lit(0)).alias("mention")), part.select("doc", "mention"))
    names = part.select(F.col("mention").alias("text"), F.col("p_brand").alias("entity"))
    totals = names.groupBy("text").agg(F.count("*").alias("all"))
    priors = names.groupBy("text", "entity").agg(F.count("*").alias("n")).join(totals, "text").select(F.col("text").alias("mention"), "entity", (F.col("n") / F.col("all")).alias("p"))
    return mentions.coref_scores(pairs, priors).select("doc", "mention", "entity", F.round("score", 6).alias("score"))


@query("""
WITH c AS (SELECT l_orderkey, list(l_partkey ORDER BY l_quantity DESC, l_partkey) AS c, min(l_suppkey) AS s, any_value((SELECT 1)) AS one FROM lineitem GROUP BY 1)
SELECT l_orderkey, coalesce(nullif(list_position(c, list_min(c)), 0), -1)::INT AS lowest, coalesce(nullif(list_position(c, s), 0), -1)::INT AS other FROM c
""")
def gold_rank(t):
    c = t("lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("l_quantity")).alias("q"), "l_partkey"))), lambda x: x["l_partkey"]).alias("c"), F.min("l_suppkey").alias("s"))
    return c.select("l_orderkey", mentions.gold_rank(F.col("c"), F.array_min("c")).alias("lowest"), mentions.gold_rank(F.col("c"), F.col("s")).alias("other"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey * 100000 + l_suppkey) AS n, max(l_quantity >= 45) OVER (PARTITION BY l_orderkey) AS has FROM lineitem)
SELECT l_orderkey, l_partkey, l_quantity FROM r WHERE CASE WHEN has THEN l_quantity >= 45 ELSE n <= 2 END
""")
def mention_pruning(t):
    df = t("lineitem").withColumn("id", F.col("l_partkey") * 100_000 + F.col("l_suppkey"))
    return mentions.pruned(df, "l_orderkey", "l_quantity", 45, 2).select("l_orderkey", "l_partkey", "l_quantity")


@query(f"""
WITH {_SPANS}, w AS (SELECT conv_id * 1000 + turn AS k, string_split(text, ' ') AS w FROM conversations),
p AS (SELECT k, start, "end", trim(regexp_replace(regexp_replace(lower(array_to_string(w[start + 1:"end" + 1], ' ')), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS phrase FROM spans JOIN w USING (k) WHERE start % 6 <> 0 AND "end" % 6 <> 0)
SELECT k, phrase, start, "end" FROM p WHERE contains(phrase, ' ')
""")
def tagged_phrases(t):
    w = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.split("text", " ", -1).alias("w"))
    df = w.withColumn("pos", F.transform("w", lambda x, i: F.when(i % 6 == 0, "DET").otherwise("NOUN"))).join(_tagged(t), "k")
    return mentions.tagged_phrases(df, "k", "w", "pos", "tags")


@query(f"""
WITH {_TAGGED}, both_ AS (SELECT k, tags AS g, list_transform(tags, lambda x, i: CASE WHEN i % 7 = 0 THEN 'O' ELSE x END) AS p FROM tagged),
z AS (SELECT k, unnest(range(len(g))) AS pos, unnest(g) AS g, unnest(p) AS p FROM both_),
rg AS (SELECT *, count(*) FILTER (g IN ('B-FOT', 'O')) OVER (PARTITION BY k ORDER BY pos) AS a, count(*) FILTER (p IN ('B-FOT', 'O')) OVER (PARTITION BY k ORDER BY pos) AS b FROM z),
sg AS (SELECT k, min(pos) AS s, max(pos) AS e FROM rg WHERE g <> 'O' GROUP BY k, a HAVING bool_or(g = 'B-FOT')), sp AS (SELECT k, min(pos) AS s, max(pos) AS e FROM rg WHERE p <> 'O' GROUP BY k, b HAVING bool_or(p = 'B-FOT'))
SELECT (SELECT count(*) FILTER (p = 'B-FOT' AND g = 'B-FOT') / count(*) FILTER (p = 'B-FOT') FROM z) AS b_precision,
  avg(CASE WHEN (k, e - s) IN (SELECT (k, e - s) FROM sp) THEN 1.0 ELSE 0 END)::DOUBLE AS loose, avg(CASE WHEN (k, s, e) IN (SELECT (k, s, e) FROM sp) THEN 1.0 ELSE 0 END)::DOUBLE AS strict FROM sg
""")
def span_agreement(t):
    df = _tagged(t).withColumn("p", F.transform("tags", lambda x, i: F.when((i + 1) % 7 == 0, "O").otherwise(x)))
    return mentions.span_agreement(df, "k", "tags", "p")


@query("""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 5 ORDER BY l_quantity DESC, l_partkey * 100000 + l_suppkey) AS n FROM lineitem), g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey * 100000 + l_suppkey) AS r FROM f WHERE n = 1),
c AS (SELECT v AS threshold, count(*) FILTER (l_quantity >= v) AS predicted, count(*) FILTER (l_quantity >= v AND l_partkey % 3 = 0) AS tp FROM g, (SELECT unnest([10.0, 25.0, 40.0])::DOUBLE AS v) WHERE r <= 3 GROUP BY 1),
x AS (SELECT threshold, tp / predicted AS p, tp / 5000 AS r FROM c)
SELECT threshold, p AS precision, r AS recall, 2 * p * r / (p + r) AS f1 FROM x
""")
def threshold_tuning(t):
    df = t("lineitem").withColumn("id", F.col("l_partkey") * 100_000 + F.col("l_suppkey")).withColumn("entity", F.col("l_suppkey") % 5).withColumn("ok", F.col("l_partkey") % 3 == 0)
    return mentions.thresholds(df, "l_orderkey", "entity", "l_quantity", "ok", 5000, [10.0, 25.0, 40.0], 3)


@query("""
WITH e AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 3 ELSE p_size % 4 + 3 END AS layer, unnest(list_distinct([left(p_brand, 1), left(p_type, 1)])) AS class FROM part)
SELECT class, layer::INT AS layer, count(*)::INT AS n, min(id) AS first, max(id) AS last FROM e GROUP BY 1, 2
""")
def class_index(t):
    df = t("part").select(F.col("p_partkey").alias("id"), F.array("p_brand", "p_type").alias("codes"), F.when(F.col("p_size") % 4 > 0, F.col("p_size") % 4 + 3).cast("int").alias("layer"))
    parts = mentions.class_index(df).groupBy("class", "layer")
    return parts.agg(F.sum(F.size("ids")).cast("int").alias("n"), F.min(F.array_min("ids")).alias("first"), F.max(F.array_max("ids")).alias("last"))


@query("""
WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="/([^"]*)"', 1) AS l FROM pages), e AS (SELECT page_id, unnest(range(len(l))) AS o, unnest(l) AS node FROM l),
f AS (SELECT page_id, node, min(o) AS o FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY o, node)::INT AS place FROM f)
SELECT page_id::VARCHAR AS graph, node, place, 1 AS label FROM r WHERE place <= 5
""")
def star_graphs(t):
    links = t("pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("o", "node"))
    return mentions.star_edges(links, "page_id", "node", "o", 5)


@query("""
WITH s AS (SELECT vec_id // 64 AS batch, vec_id % 64 AS row, list_transform(embedding::DOUBLE[], lambda x: round(x, 4)) AS s FROM embeddings)
SELECT batch, avg(CASE WHEN list_position(s, list_max(s)) - 1 = row THEN 1.0 ELSE 0 END)::DOUBLE AS accuracy FROM s GROUP BY 1
""")
def in_batch_accuracy(t):
    df = t("embeddings").select(F.floor(F.col("vec_id") / 64).alias("batch"), (F.col("vec_id") % 64).alias("row"), F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("s"))
    return mentions.in_batch_accuracy(df, "batch", "row", "s")


@query("""
WITH n AS (SELECT p_brand AS graph, p_partkey AS node, [p_size / 50.0, p_retailprice / 2000.0, length(p_name) / 20.0]::DOUBLE[] AS x FROM part),
h AS (SELECT graph, node, [list_inner_product(x, [0.3, -0.2, 0.5]::DOUBLE[]), list_inner_product(x, [0.1, 0.4, -0.6]::DOUBLE[])] AS h FROM n),
s AS (SELECT *, list_inner_product(h, [0.7, -0.3]::DOUBLE[]) AS t, list_inner_product(h, [0.2, 0.9]::DOUBLE[]) AS s FROM h),
c AS (SELECT graph, min(node) AS centre FROM n GROUP BY graph),
e AS (SELECT graph, centre AS source, node AS target FROM n JOIN c USING (graph) UNION SELECT graph, node, centre FROM n JOIN c USING (graph) UNION SELECT graph, node, node FROM n),
w AS (SELECT e.graph, e.target AS node, exp(CASE WHEN a.t + b.s > 0 THEN a.t + b.s ELSE 0.2 * (a.t + b.s) END) AS w, b.h FROM e JOIN s a ON a.graph = e.graph AND a.node = e.target JOIN s b ON b.graph = e.graph AND b.node = e.source),
o AS (SELECT graph, node, sum(w * h[1]) / sum(w) AS x, sum(w * h[2]) / sum(w) AS y FROM w GROUP BY graph, node),
p AS (SELECT *, round(0.6 * x + 0.8 * y, 12) AS score, count(*) OVER (PARTITION BY graph) AS n FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY score DESC, node) AS place FROM p)
SELECT graph, node, round(x * tanh(score), 6) AS x, round(y * tanh(score), 6) AS y FROM r WHERE place <= ceil(n * 0.5)
""")
def graph_attention(t):
    import numpy as np

    v = F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 2000.0, F.length("p_name") / 20.0)
    nodes = t("part").select(F.col("p_brand").alias("graph"), F.col("p_partkey").alias("node"), v.alias("v"))
    centred = nodes.join(nodes.groupBy("graph").agg(F.min("node").alias("centre")), "graph")
    edges = centred.select("graph", F.col("centre").alias("source"), F.col("node").alias("target")).unionByName(centred.select("graph", F.col("node").alias("source"), F.col("centre").alias("target")))
    found = attention.attended(nodes, edges, np.array([[0.3, 0.1], [-0.2, 0.4], [0.5, -0.6]]), np.array([0.7, -0.3]), np.array([0.2, 0.9]))
    return attention.pooled(found, np.array([0.6, 0.8])).select("graph", "node", F.round(F.get("v", F.lit(0)), 6).alias("x"), F.round(F.get("v", F.lit(1)), 6).alias("y"))
