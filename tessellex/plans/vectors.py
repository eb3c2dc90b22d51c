"""Queries over embeddings and codes of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import arrays as A
from ..functions.staging import fresh_folder
from ..operators import graph_index, hierarchy, similarity

_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
_COS = "list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e))"


def _vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


@query("""
WITH n AS (SELECT DISTINCT p_name AS name FROM part), c AS (SELECT name, unnest(string_split(lower(name), '')) AS c FROM n),
b AS (SELECT name, ascii(c)::BIGINT * 131 % 128 AS bin, count(*) AS k FROM c GROUP BY 1, 2), z AS (SELECT name, sqrt(sum(k * k)) AS z FROM b GROUP BY 1)
SELECT name, bin::INT AS bin, round(k / z, 6) AS weight FROM b JOIN z USING (name)
""")
def hash_encode(t):
    return A.hash_weights(t("part").select(F.col("p_name").alias("name")).distinct(), "name", "name").select("name", "bin", F.round("weight", 6).alias("weight"))


@query(f"WITH {_V} SELECT a.id AS left_id, b.id AS right_id, round({_COS}, 6) AS sim FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id")
def cosine_pairs(t):
    v = _vectors(t).withColumnRenamed("label", "block")
    return similarity.cosines(v, v).select(F.col("id").alias("left_id"), F.col("other").alias("right_id"), F.round("score", 6).alias("sim"))


@query(f"WITH {_V}, s AS (SELECT a.id AS id, b.id AS other, round(list_inner_product(a.e, b.e), 12) AS s FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other)::INT AS rank FROM s) SELECT id, rank, other, round(s, 6) AS score FROM r WHERE rank <= 10")
def knn_exact(t):
    v = _vectors(t).select("id", "v")
    return similarity.exact_top(v.filter("id % 20 = 0"), v, 10).select("id", "rank", "other", F.round("score", 6).alias("score"))


@query()
def knn_ivf(t):
    v = _vectors(t).select("id", "v")
    return similarity.inverted_lists_top(v.filter("id % 20 = 0"), v, 10, lists=16, probes=12).select("id", "rank", "other", F.round("score", 6).alias("score"))


@query()
def knn_lsh(t):
    v = _vectors(t).select("id", "v")
    return similarity.hashed_projections_top(v.filter("id % 20 = 0"), v, 10, tables=64, bits=6).select("id", "rank", "other", F.round("score", 6).alias("score"))


@query()
def knn_graph(t):
    v = _vectors(t).select("id", "v")
    path = fresh_folder(v.sparkSession, "graph")
    graph_index.build(v, path)
    return graph_index.search(v.filter("id % 20 = 0"), path, 10).select("id", "rank", "other", F.round("score", 6).alias("score"))


_SPLIT = f"{_V}, kids AS (SELECT * FROM v WHERE id % 3 > 0), olds AS (SELECT * FROM v WHERE id % 3 = 0 AND label < 8)"
_BEST = f"s AS (SELECT a.id, b.id AS parent, a.label = b.label AS own, round({_COS}, 12) AS s FROM kids a, olds b), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY own DESC, s DESC, parent) AS n FROM s)"


@query(f"WITH {_SPLIT}, {_BEST} SELECT id, parent, round(s, 6) AS sim FROM r WHERE n = 1")
def nearest_parent_simple(t):
    v = _vectors(t).withColumnRenamed("label", "block")
    return similarity.nearest_parent(v.filter("id % 3 > 0"), v.filter("id % 3 = 0 and block < 8"), True).select("id", "parent", F.round("sim", 6).alias("sim"))


@query(f"WITH {_SPLIT}, {_BEST} SELECT id, CASE WHEN own THEN parent END AS parent, CASE WHEN own THEN round(s, 6) END AS sim FROM r WHERE n = 1")
def nearest_parent_strict(t):
    v = _vectors(t).withColumnRenamed("label", "block")
    return similarity.nearest_parent(v.filter("id % 3 > 0"), v.filter("id % 3 = 0 and block < 8"), False).select("id", "parent", F.round("sim", 6).alias("sim"))


_TOP = f"{_V}, s AS (SELECT a.id AS id, b.id AS other, round(list_inner_product(a.e, b.e), 12) AS s FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS r FROM s QUALIFY r <= 20)"
_ELBOW = "f AS (SELECT *, count(*) OVER w AS n, max(s) OVER w AS top, min(s) OVER w AS low FROM t WINDOW w AS (PARTITION BY id)), d AS (SELECT *, round(abs((n - 1) * (s - top) - (low - top) * (r - 1)) / sqrt((n - 1) * (n - 1) + (low - top) * (low - top)), 12) AS d FROM f), k AS (SELECT id, max(n) AS n, arg_max(r, (d, -r)) AS place FROM d GROUP BY 1), e AS (SELECT id, CASE WHEN n <= 1 THEN n ELSE greatest(least(place, 5), 1) END AS keep FROM k)"


@query(f"WITH {_TOP}, {_ELBOW} SELECT id, keep::INT AS keep FROM e")
def elbow_cut(t):
    v = _vectors(t).select("id", "v", F.col("label").alias("block"))
    return similarity.elbow(similarity.blocked_top(v, v, 20), "id", "score")


@query(f"WITH {_TOP} SELECT id, r::INT AS rank, other, round(s, 6) AS score FROM t WHERE r <= 5")
def knn_blocked(t):
    v = _vectors(t).select("id", "v", F.col("label").alias("block"))
    return similarity.blocked_top(v, v, 5).select("id", "rank", "other", F.round("score", 6).alias("score"))


_CODES = "x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, (4 + vec_id % 3)::INT AS layer, [chr((65 + label % 3)::INT) || '1', chr((66 + label % 2)::INT) || '2'] AS codes, vec_id % 4 = 0 AS old FROM embeddings)"


@query(f"""
WITH {_CODES}, olds AS (SELECT id, e, CASE WHEN id % 8 = 0 THEN 3 ELSE layer END AS layer, unnest(list_distinct(list_transform(codes, lambda c: left(c, 1)))) AS class FROM x WHERE old),
kids AS (SELECT id, e, layer, unnest(list_distinct(list_transform(codes, lambda c: left(c, 1)))) AS class FROM x WHERE NOT old),
w AS (SELECT k.*, CASE WHEN EXISTS (SELECT 1 FROM olds o WHERE o.class = k.class AND o.layer = k.layer - 1) THEN k.layer - 1 ELSE 3 END AS up FROM kids k),
s AS (SELECT DISTINCT a.id AS id, b.id AS other, round({_COS}, 12) AS s FROM w a JOIN olds b ON a.class = b.class AND a.up = b.layer),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS r FROM s QUALIFY r <= 20), {_ELBOW}
SELECT t.id, other AS parent, round(s, 6) AS sim FROM t JOIN e ON t.id = e.id WHERE r <= keep AND (s >= 0.3 OR r <= 1)
""")
def parents_dag(t):
    codes = F.array(F.concat(F.char(65 + F.col("label") % 3), F.lit("1")), F.concat(F.char(66 + F.col("label") % 2), F.lit("2")))
    v = _vectors(t).withColumn("layer", (4 + F.col("id") % 3).cast("int")).withColumn("codes", codes)
    olds = v.filter("id % 4 = 0").withColumn("layer", F.when(F.col("id") % 8 == 0, 3).otherwise(F.col("layer")))
    return similarity.parents_by_class(v.filter("id % 4 <> 0"), olds, threshold=0.3).select("id", "parent", F.round("sim", 6).alias("sim"))


@query(f"""
WITH RECURSIVE {_V}, near AS (SELECT a.id AS a, b.id AS b FROM v a, v b WHERE {_COS} >= 0.72 - 1e-12),
core AS (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= 3), edges AS (SELECT n.a, n.b FROM near n JOIN core x ON n.a = x.id JOIN core y ON n.b = y.id),
reach AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
named AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY 1),
border AS (SELECT n.a AS id, min(n.b) AS core FROM near n JOIN core c ON n.b = c.id WHERE n.a NOT IN (SELECT id FROM core) GROUP BY 1)
SELECT v.id, coalesce(m.cluster, bm.cluster, -1) AS cluster FROM v LEFT JOIN named m ON v.id = m.id LEFT JOIN border b ON v.id = b.id LEFT JOIN named bm ON b.core = bm.id
""")
def density_clusters(t):
    return hierarchy.density_clusters(_vectors(t).select("id", "v"), eps=0.28, least=3)


@query()
def reduced_vectors(t):
    return similarity.reduced(_vectors(t).select("id", "v"), 8).select("id", F.array_join(F.transform("v", lambda x: F.format_number(x, 6)), ";").alias("v"))


@query()
def ward_layers(t):
    v = _vectors(t).select("id", "v", F.col("label").cast("long").alias("cluster"))
    return hierarchy.layers(hierarchy.cluster_depths(v), "cluster", "depth").select("id", "cluster", "depth", "layer")


@query("""
WITH d AS (SELECT p_partkey AS id, p_brand AS g, p_size AS depth FROM part),
r AS (SELECT *, list(depth ORDER BY depth) OVER (PARTITION BY g ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, count(*) OVER (PARTITION BY g)::INT AS n FROM d),
x AS (SELECT *, l[CASE WHEN n * 1 // 7 = 0 THEN n ELSE n * 1 // 7 END] AS t0, l[CASE WHEN n * 3 // 7 = 0 THEN n ELSE n * 3 // 7 END] AS t1 FROM r)
SELECT id, CASE WHEN n < 2 THEN 6 ELSE 4 + (depth > t0)::INT + (depth > t1)::INT END::INT AS layer FROM x
""")
def layer_quantiles(t):
    return hierarchy.layers(t("part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size"), "p_brand", "p_size").select("id", "layer")
