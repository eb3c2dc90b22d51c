"""Queries that look up, join, match, retrieve, tag and evaluate."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import models
from ..catalog import query
from ..functions import arrays as A
from ..operators import joins, matching, metrics, retrieval, sampling, tagging
from ..operators import mentions as M
from ..operators.dedup import first_by


@query("""
WITH kb AS (SELECT n_name AS k, min(n_nationkey) AS v FROM nation GROUP BY 1),
a AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) WHEN 1 THEN replace('x', 'x', c_name) ELSE lower((SELECT n_name FROM nation WHERE n_nationkey = c_nationkey)) END AS first, upper(lower((SELECT n_name FROM nation WHERE n_nationkey = c_nationkey))) AS second FROM customer)
SELECT c_custkey, coalesce(x.v, CASE WHEN c_custkey % 4 > 1 THEN y.v END) AS resolved FROM a LEFT JOIN kb x ON first = x.k LEFT JOIN kb y ON second = y.k
""")
def lookup_cascade(t):
    nation = t("nation").select("n_nationkey", "n_name")
    rows = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")
    k = F.col("c_custkey") % 4
    first = F.when(k == 0, F.col("n_name")).when(k == 1, F.col("c_name")).otherwise(F.lower("n_name"))
    second = F.when(k > 1, F.upper(F.lower("n_name")))
    table = nation.groupBy(F.col("n_name").alias("key")).agg(F.min("n_nationkey").alias("value"))
    return joins.lookup_cascade(rows, [first, second], table, "key", "value", "resolved").select("c_custkey", "resolved")


@query("""
WITH links AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN c_name ELSE o_custkey::VARCHAR END AS target FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_custkey AS id, (SELECT count(*) FROM links WHERE target = c_name OR target = c_custkey::VARCHAR) AS num_incoming_links FROM customer
""")
def incoming_links(t):
    links = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.when(F.col("o_orderkey") % 3 == 0, F.col("c_name")).otherwise(F.col("o_custkey").cast("string")).alias("target"))
    return joins.incoming_links(links, t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))).select("id", "num_incoming_links")


@query("""
WITH p AS (SELECT DISTINCT p_size % 10 AS doc, p_name AS mention FROM part), m AS (SELECT DISTINCT p_size % 10 AS doc, split_part(p_name, ' ', 1 + p_size % 2) AS mention FROM part)
SELECT m.doc, m.mention, count(*) AS persons FROM m JOIN p ON m.doc = p.doc AND m.mention <> p.mention AND contains(' ' || p.mention || ' ', ' ' || m.mention || ' ') GROUP BY 1, 2
""")
def coref_candidates(t):
    part = t("part").select((F.col("p_size") % 10).alias("doc"), F.col("p_name").alias("mention"), "p_size")
    mentions = part.select("doc", F.get(F.split("mention", " "), F.col("p_size") % 2).alias("mention"))
    return joins.coreferences(mentions, part.select("doc", "mention")).groupBy("doc", "mention").agg(F.count("*").alias("persons"))


@query("""
WITH l AS (SELECT c_custkey % 5 AS doc, c_custkey AS k, 'Seg-' || (c_custkey % 3)::VARCHAR AS s FROM customer), r AS (SELECT s_suppkey % 5 AS doc, s_suppkey AS k, 'SEG ' || (s_suppkey % 3)::VARCHAR AS s FROM supplier),
a AS (SELECT *, lower(regexp_replace(s, '[^\\p{L}\\p{N}_]', '', 'g')) AS x, row_number() OVER (PARTITION BY doc, lower(regexp_replace(s, '[^\\p{L}\\p{N}_]', '', 'g')) ORDER BY k) AS n FROM l),
b AS (SELECT *, lower(regexp_replace(s, '[^\\p{L}\\p{N}_]', '', 'g')) AS x, row_number() OVER (PARTITION BY doc, lower(regexp_replace(s, '[^\\p{L}\\p{N}_]', '', 'g')) ORDER BY k) AS n FROM r)
SELECT a.doc, a.k AS left_k, a.s AS left_s, b.k AS right_k, b.s AS right_s FROM a JOIN b USING (doc, x, n)
""")
def mention_alignment(t):
    left = t("customer").select((F.col("c_custkey") % 5).alias("doc"), F.col("c_custkey").alias("k"), F.concat(F.lit("Seg-"), (F.col("c_custkey") % 3).cast("string")).alias("s"))
    right = t("supplier").select((F.col("s_suppkey") % 5).alias("doc"), F.col("s_suppkey").alias("k"), F.concat(F.lit("SEG "), (F.col("s_suppkey") % 3).cast("string")).alias("s"))
    return joins.aligned(left, right, "s", "k").select("doc", "left_k", "left_s", "right_k", "right_s")


_VOCABULARY = "vocabulary AS (SELECT DISTINCT lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) AS term FROM benchmark UNION SELECT DISTINCT lower(split_part(text, ' ', 4)) FROM documents WHERE split_part(text, ' ', 4) <> '')"


def _word(c, k):
    return F.coalesce(F.get(F.split(c, " ", k + 2), F.lit(k)), F.lit(""))


def phrases(t):
    return t("benchmark").select(F.lower(F.concat_ws(" ", _word("text", 0), _word("text", 1))).alias("term")).distinct()


def vocabulary(t):
    two = phrases(t)
    one = t("documents").select(F.lower(_word("text", 3)).alias("term")).filter("term <> ''")
    return two.union(one).distinct()


@query(f"""
WITH {_VOCABULARY},
hits AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS n FROM vocabulary JOIN documents ON contains(lower(text), term))
SELECT term, doc_id AS key, n::INT AS n FROM hits WHERE n <= 10 UNION ALL SELECT term, NULL, 0 FROM vocabulary WHERE term NOT IN (SELECT term FROM hits)
""")
def substring_join(t):
    return matching.substring_join(t("documents"), "text", "doc_id", vocabulary(t), "term", 50)


@query(f"WITH {_VOCABULARY} SELECT doc_id AS key, count(*) AS terms, sum(strpos(lower(text), term) - 1)::BIGINT AS places FROM documents JOIN vocabulary ON contains(lower(text), term) GROUP BY 1")
def substring_semi(t):
    return matching.substring_totals(t("documents"), "text", "doc_id", vocabulary(t), "term")


@query(f"""
WITH RECURSIVE {_VOCABULARY}, v AS (SELECT string_split(term, ' ') AS w FROM vocabulary), d AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: lower(x)) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(len(w))) AS s, w FROM d),
c AS (SELECT doc_id, s, max(s + len(v.w)) AS e FROM p JOIN v ON p.w[s + 1] = v.w[1] AND p.w[s + 1:s + len(v.w)] = v.w GROUP BY 1, 2),
n AS (SELECT a.doc_id, a.s, a.e, (SELECT min(b.s) FROM c b WHERE b.doc_id = a.doc_id AND b.s >= a.e) AS following FROM c a),
r AS (SELECT n.* FROM n JOIN (SELECT doc_id, min(s) AS s FROM c GROUP BY 1) f ON n.doc_id = f.doc_id AND n.s = f.s UNION ALL SELECT n.* FROM r JOIN n ON n.doc_id = r.doc_id AND n.s = r.following)
SELECT d.doc_id, coalesce(string_agg(s::VARCHAR || '-' || e::VARCHAR, ',' ORDER BY s), '') AS spans FROM d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY 1
""")
def dictionary_tag(t):
    spans = matching.dictionary_spans(t("documents").select("doc_id", F.split("text", " ", -1).alias("w")), "doc_id", "w", vocabulary(t), "term")
    return spans.select("doc_id", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


_TAGGED = """
tagged AS (SELECT conv_id * 1000 + turn AS k, list_transform(string_split(text, ' '), lambda w, i: CASE (length(w) + i) % 4 WHEN 0 THEN 'B-FOT' WHEN 1 THEN 'I-FOT' ELSE 'O' END) AS tags FROM conversations)
"""


def _tagged(t):
    tag = lambda w, i: F.when((F.length(w) + i + 1) % 4 == 0, "B-FOT").when((F.length(w) + i + 1) % 4 == 1, "I-FOT").otherwise("O")
    return t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.transform(F.split("text", " ", -1), tag).alias("tags"))


_SPANS = f"""{_TAGGED},
each AS (SELECT k, unnest(range(len(tags))) AS pos, unnest(tags) AS tag FROM tagged),
runs AS (SELECT *, count(*) FILTER (tag IN ('B-FOT', 'O')) OVER (PARTITION BY k ORDER BY pos) AS run FROM each),
spans AS (SELECT k, min(pos)::INT AS start, max(pos)::INT AS "end" FROM runs WHERE tag <> 'O' GROUP BY k, run HAVING bool_or(tag = 'B-FOT'))
"""


@query(f'WITH {_SPANS} SELECT k, start, "end" FROM spans')
def bio_spans(t):
    return tagging.bio_spans(_tagged(t), "k", "tags")


@query(f'WITH {_SPANS} SELECT avg("end" - start + 1)::DOUBLE AS mean_run FROM spans')
def run_lengths(t):
    return tagging.run_lengths(_tagged(t), "k", "tags")


@query(f"""
WITH {_TAGGED}, each AS (SELECT k, unnest(range(len(tags))) AS pos, unnest(tags) AS tag FROM tagged),
n AS (SELECT k, tag, CASE pos % 5 WHEN 0 THEN 'DET' WHEN 1 THEN 'ADP' ELSE 'NOUN' END AS p, lag(tag) OVER w AS b, lead(tag) OVER w AS a FROM each WINDOW w AS (PARTITION BY k ORDER BY pos))
SELECT k, round(sum(CASE WHEN b IS NULL THEN 0 ELSE (b = 'B-FOT' AND tag <> 'I-FOT')::INT * 0.5 + (tag = 'I-FOT' AND b = 'O')::INT + (tag <> 'O' AND p IN ('DET', 'ADP'))::INT * 0.8 + (tag = 'I-FOT' AND b <> 'B-FOT')::INT + (tag <> 'O' AND coalesce(a = 'O', false))::INT * 0.8 END) + CASE WHEN count(*) FILTER (tag <> 'O') = 0 THEN 1 ELSE 0 END, 6)::DOUBLE AS penalty FROM n GROUP BY k
""")
def tag_quality(t):
    pos = F.transform("tags", lambda x, i: F.when(i % 5 == 0, "DET").when(i % 5 == 1, "ADP").otherwise("NOUN"))
    return tagging.tag_penalty(_tagged(t).withColumn("pos", pos), "k", "tags", "pos").select("k", F.round("penalty", 6).alias("penalty"))


@query("""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), e AS (SELECT doc_id, w, lower(w[(doc_id % len(w)) + 1]) AS e FROM w),
p AS (SELECT doc_id, w, list_position(list_transform(w, lambda x: lower(x)), e) - 1 AS place FROM e)
SELECT doc_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN i - 1 = place THEN 'B-FOT' ELSE 'O' END), ' ') AS tags FROM p
""")
def single_entity_tag(t):
    w = t("documents").select("doc_id", F.split("text", " ", -1).alias("w")).withColumn("e", F.get("w", (F.col("doc_id") % F.size("w")).cast("int")))
    return tagging.single_entity_tags(w, "w", "e", "tags").select("doc_id", F.array_join("tags", " ").alias("tags"))


_PREFIX_SQL = """
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE contains(text, ' ')),
e AS (SELECT doc_id, w, lower(w[(doc_id % (len(w) - 1)) + 1]) AS a, left(lower(w[(doc_id % (len(w) - 1)) + 2]), 2) AS b FROM w),
p AS (SELECT doc_id, w, list_filter(range(1, len(w)), lambda i: lower(w[i]) = a AND starts_with(lower(w[i + 1]), b))[1] AS place FROM e)
"""


def _prefix_tagged(t):
    """Each text's tokens with the tags of one of its words and the first two letters of the next."""
    w = t("documents").select("doc_id", F.split("text", " ", -1).alias("w")).filter("size(w) > 1").withColumn("k", (F.col("doc_id") % (F.size("w") - 1)).cast("int"))
    entity = F.concat(F.get("w", F.col("k")), F.lit(" "), F.substring(F.get("w", F.col("k") + 1), 1, 2))
    return tagging.single_entity_tags(w.withColumn("e", entity), "w", "e", "tags", prefix=True)


@query(f"{_PREFIX_SQL} SELECT doc_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = place THEN 'B-FOT' WHEN i = place + 1 THEN 'I-FOT' ELSE 'O' END), ' ') AS tags FROM p")
def prefix_tag(t):
    return _prefix_tagged(t).select("doc_id", F.array_join("tags", " ").alias("tags"))


@query(f"{_PREFIX_SQL} SELECT doc_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = place THEN '[B:' || x || ']' WHEN i = place + 1 THEN '[I:' || x || ']' ELSE x END), ' ') AS line FROM p")
def annotated_texts(t):
    return _prefix_tagged(t).select("doc_id", M.annotated(F.col("w"), F.col("tags")).alias("line"))


@query("""
WITH c AS (SELECT p_partkey, s, unnest(string_split(lower(x), '')) AS c FROM (SELECT p_partkey, 'a' AS s, p_name AS x FROM part UNION ALL SELECT p_partkey, 'b', p_type FROM part)),
b AS (SELECT p_partkey, s, ascii(c)::BIGINT * 131 % 128 AS bin, count(*) AS k FROM c GROUP BY 1, 2, 3), z AS (SELECT p_partkey, s, sqrt(sum(k * k)) AS z FROM b GROUP BY 1, 2),
d AS (SELECT x.p_partkey, sum(x.k * y.k) AS d FROM b x JOIN b y ON x.p_partkey = y.p_partkey AND x.bin = y.bin WHERE x.s = 'a' AND y.s = 'b' GROUP BY 1),
s AS (SELECT p.p_partkey, p.p_brand, round(coalesce(d.d, 0) / (za.z * zb.z), 9) AS score FROM part p LEFT JOIN d USING (p_partkey) JOIN z za ON za.p_partkey = p.p_partkey AND za.s = 'a' JOIN z zb ON zb.p_partkey = p.p_partkey AND zb.s = 'b')
SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey)::INT AS rank, p_partkey, round(score, 6) AS score FROM s QUALIFY rank <= 3
""")
def reranked_pairs(t):
    found = models.rerank(t("part").select("p_partkey", "p_brand", "p_name", "p_type"), models.cosine_pair_scorer(), ["p_name", "p_type"], "p_brand", "p_partkey", 3)
    return found.select("p_brand", "rank", "p_partkey", F.round("score", 6).alias("score"))


def _scored_spans(t):
    s = (F.col("l_partkey") % 12).cast("int")
    span = F.struct((F.col("l_quantity") * 1.0).alias("score"), s.alias("start"), (s + (F.col("l_linenumber") % 4).cast("int") + 1).alias("end"))
    return t("lineitem").groupBy("l_orderkey").agg(F.array_distinct(F.collect_list(span)).alias("s"))


@query("""
WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey AS k, l_quantity::DOUBLE AS score, (l_partkey % 12)::INT AS a, (l_partkey % 12 + l_linenumber % 4 + 1)::INT AS b FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, a, b) AS n FROM s),
r AS (SELECT k, 0 AS n, CAST([] AS INT[]) AS taken, '' AS kept FROM (SELECT DISTINCT k FROM s)
  UNION ALL SELECT r.k, r.n + 1, CASE WHEN list_has_any(taken, range(a, b)::INT[]) THEN taken ELSE taken || range(a, b)::INT[] END, CASE WHEN list_has_any(taken, range(a, b)::INT[]) THEN kept ELSE kept || lpad(a::VARCHAR, 2, '0') || '-' || b::VARCHAR || ' ' END FROM r JOIN o ON o.k = r.k AND o.n = r.n + 1)
SELECT k AS l_orderkey, array_to_string(list_sort(string_split(trim(arg_max(kept, n)), ' ')), ' ') AS kept FROM r GROUP BY k
""")
def overlap_prune(t):
    kept = A.greedy_spans(F.col("s"))
    return _scored_spans(t).select("l_orderkey", F.array_join(F.transform(kept, lambda x: F.concat_ws("-", F.lpad(x["start"].cast("string"), 2, "0"), x["end"].cast("string"))), " ").alias("kept"))


@query("SELECT l_orderkey, l_partkey, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2")
def repeat_prune(t):
    own = first_by(t("lineitem"), ["l_orderkey", "l_partkey"], [F.desc("l_quantity"), "l_linenumber"])
    return own.select("l_orderkey", "l_partkey", F.col("l_quantity").alias("score"))


_BM = """
fields AS (SELECT item_id AS doc, 'title' AS field, split_part(text, '.', 1) AS x FROM benchmark UNION ALL SELECT item_id, 'body', text FROM benchmark),
toks AS (SELECT doc, field, list_filter(regexp_split_to_array(lower(x), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM fields),
each AS (SELECT doc, field, len(w) AS l, unnest(w) AS token FROM toks),
idx AS (SELECT doc, field, token, count(*) AS tf, any_value(l) AS l FROM each GROUP BY 1, 2, 3),
mean AS (SELECT field, sum(l) / (SELECT count(*) FROM benchmark) AS m FROM (SELECT DISTINCT doc, field, l FROM each) GROUP BY 1),
dfs AS (SELECT field, token, count(*) AS df FROM idx GROUP BY 1, 2),
asked AS (SELECT DISTINCT doc_id AS query, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS token FROM documents WHERE doc_id % 20 = 0),
s AS (SELECT query, doc, sum(CASE field WHEN 'title' THEN 1.0 ELSE 0.5 END * ln(1 + ((SELECT count(*) FROM benchmark) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / m))) AS score FROM asked JOIN idx USING (token) JOIN dfs USING (field, token) JOIN mean USING (field) GROUP BY 1, 2)
"""


@query(f"WITH {_BM}, b AS (SELECT query, doc, round(score + ln(coalesce(doc % 7, 0) + 1), 9) AS score FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INT AS rank FROM b) SELECT query, rank, doc, round(score, 6) AS score FROM k WHERE rank <= 10")
def bm25_topk(t):
    docs = t("benchmark").select("item_id", F.get(F.split("text", r"\.", -1), F.lit(0)).alias("title"), F.col("text").alias("body"))
    fields = {"title": 1.0, "body": 0.5}
    asked = t("documents").filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "text")
    boost = docs.select(F.col("item_id").alias("doc"), (F.col("item_id") % 7).alias("links"))
    found = retrieval.bm25(retrieval.inverted_index(docs, "item_id", fields), docs.count(), asked, fields, 10, boost)
    return found.select("query", "rank", "doc", F.round("score", 6).alias("score"))


def _lists(t):
    s = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ((F.col("l_partkey") * 7 + i * F.col("l_suppkey")) % 23) / 5.0)
    m = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when((F.col("l_partkey") + i) % 3 > 0, 1).otherwise(0))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", s.alias("s"), m.alias("m"))


_L = "x AS (SELECT l_orderkey, l_linenumber, l_partkey, list_transform(range(8), lambda i: ((l_partkey * 7 + i * l_suppkey) % 23) / 5.0) AS s, list_transform(range(8), lambda i: CASE WHEN (l_partkey + i) % 3 > 0 THEN 1 ELSE 0 END) AS m FROM lineitem)"


@query(f"""
WITH {_L}, e AS (SELECT *, list_transform(range(1, 9), lambda i: CASE WHEN m[i] = 1 THEN exp(s[i]) ELSE 0 END) AS e FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, (list_position(list_transform(e, lambda v: round(v / list_sum(e), 9)), list_max(list_transform(e, lambda v: round(v / list_sum(e), 9)))) - 1)::INT AS best, round(list_max(e) / list_sum(e), 6) AS probability FROM e
""")
def masked_softmax(t):
    p = _lists(t).withColumn("p", F.transform(metrics.masked_softmax(F.col("s"), F.col("m")), lambda x: F.round(x, 9)))
    return p.select("l_orderkey", "l_linenumber", "l_partkey", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("best"), F.round(F.array_max("p"), 6).alias("probability"))


@query(f"WITH {_L}, n AS (SELECT *, ln(list_sum(list_transform(s, lambda v: exp(v)))) AS z, -ln(1 + exp(-(l_partkey % 9 - 4.0))) AS g FROM x) SELECT l_orderkey, l_linenumber, l_partkey, round(list_max(s) - z + g, 6) AS joint FROM n")
def joint_score(t):
    joint = F.array_max(A.log_softmax(F.col("s"))) + A.log_sigmoid(F.col("l_partkey") % 9 - F.lit(4.0))
    return _lists(t).select("l_orderkey", "l_linenumber", "l_partkey", F.round(joint, 6).alias("joint"))


@query(f"""
WITH {_L}, g AS (SELECT l_orderkey, l_linenumber, l_partkey, s, unnest(range(8)) AS i FROM x), h AS (SELECT *, unnest(range(i, least(i + 3, 8))) AS j FROM g)
SELECT l_orderkey, l_linenumber, l_partkey, i::INT AS i, j::INT AS j, round(s[i + 1] + s[j + 1] + list_sum(s[i + 1:j + 1]), 6) AS score FROM h
""")
def span_scores(t):
    x = _lists(t).select("l_orderkey", "l_linenumber", "l_partkey", "s", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    x = x.select("*", F.explode(F.sequence("i", F.least(F.col("i") + 2, F.lit(7)))).alias("j"))
    inner = F.aggregate(F.slice("s", F.col("i") + 1, F.col("j") - F.col("i") + 1), F.lit(0.0), lambda a, v: a + v)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "i", "j", F.round(F.get("s", F.col("i")) + F.get("s", F.col("j")) + inner, 6).alias("score"))


@query("SELECT quality AS gold, count(*) FILTER (toxic = 0) AS p_0, count(*) FILTER (toxic = 1) AS p_1 FROM labels GROUP BY 1")
def confusion(t):
    return metrics.confusion(t("labels"), "quality", "toxic", [0, 1])


@query("""
WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (toxic = 1) AS predicted, count(*) FILTER (quality = 1) AS gold FROM labels),
r AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0.0) AS p, coalesce(tp / nullif(gold, 0), 0.0) AS r FROM c)
SELECT tp, predicted, gold, p AS precision, r AS recall, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f1 FROM r
""")
def prf(t):
    return metrics.binary_rates(t("labels"), "quality", "toxic")


_RANKED = "ranked AS (SELECT l_orderkey, l_returnflag AS dataset, (l_partkey % 40)::INT AS r FROM lineitem)"


def _ranked(t):
    return t("lineitem").select("l_orderkey", F.col("l_returnflag").alias("dataset"), (F.col("l_partkey") % 40).cast("int").alias("r"))


@query(f"WITH {_RANKED}, k AS (SELECT unnest([1, 10, 30]) AS k) SELECT dataset, k, avg(CASE WHEN r >= 1 AND r <= k THEN 1.0 ELSE 0 END) AS recall FROM ranked, k GROUP BY GROUPING SETS ((dataset, k), (k))")
def recall_at_k(t):
    return metrics.recall_at(_ranked(t), "r", [1, 10, 30], "dataset")


@query(f"WITH {_RANKED}, k AS (SELECT unnest([1, 4, 8, 16, 32]) AS k) SELECT dataset, k, avg(CASE WHEN r >= 1 AND r <= k THEN 1.0 ELSE 0 END) AS hits FROM ranked, k GROUP BY GROUPING SETS ((dataset, k), (k))")
def hits_rollup(t):
    return metrics.recall_at(_ranked(t), "r", [1, 4, 8, 16, 32], "dataset").withColumnRenamed("recall", "hits")


@query(f"WITH {_RANKED}, c AS (SELECT r, count(*) AS n FROM ranked WHERE r >= 1 GROUP BY 1) SELECT r, n, (sum(n) OVER (ORDER BY r) / (SELECT count(*) FROM ranked))::DOUBLE AS recall FROM c")
def recall_curve(t):
    return metrics.recall_curve(_ranked(t), "r")


@query(f"WITH {_RANKED}, p AS (SELECT dataset, count(*) AS n, count(*) FILTER (r = 1) AS c FROM ranked GROUP BY 1) SELECT (sum(c) / sum(n))::DOUBLE AS micro, avg(CASE WHEN c > 0 THEN c / n END) AS macro FROM p")
def macro_micro(t):
    return metrics.macro_micro(_ranked(t), "dataset", F.col("r") == 1)


@query(f"""
WITH {_SPANS}, p AS (SELECT k, start, CASE WHEN k % 3 = 0 THEN "end" + 1 ELSE "end" END AS "end" FROM spans WHERE k % 4 <> 0),
c AS (SELECT (SELECT count(*) FROM (SELECT * FROM spans INTERSECT SELECT * FROM p)) AS tp, (SELECT count(*) FROM p) AS predicted, (SELECT count(*) FROM spans) AS gold)
SELECT tp, predicted, gold, tp / predicted AS precision, tp / gold AS recall, 2 * (tp / predicted) * (tp / gold) / (tp / predicted + tp / gold) AS f1 FROM c
""")
def entity_prf(t):
    gold = tagging.bio_spans(_tagged(t), "k", "tags")
    predicted = gold.filter("k % 4 <> 0").withColumn("end", F.when(F.col("k") % 3 == 0, F.col("end") + 1).otherwise(F.col("end")))
    return metrics.span_rates(gold, predicted, ["k", "start", "end"])


#: Of rows (g: group, k: key, tagged) the split of each unit: a group, or a key of the unknown group.
SPLIT_SQL = """
kinds AS (SELECT *, CASE WHEN g = 'unknown_entity' THEN CASE WHEN tagged THEN 1 ELSE 2 END ELSE 0 END AS kind, CASE WHEN g = 'unknown_entity' THEN k::VARCHAR ELSE g END AS unit FROM rows_),
numbered AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(unit || '|42'), unit) - 1 AS place, count(*) OVER (PARTITION BY kind) AS total FROM (SELECT DISTINCT kind, unit FROM kinds WHERE g IS NOT NULL)),
splits AS (SELECT kind, unit, CASE WHEN place < floor(total * 0.8) THEN 'train' WHEN place < floor(total * 0.8) + floor(total * 0.1) THEN 'valid' ELSE 'test' END AS split FROM numbered)
"""


@query(f"""
WITH rows_ AS (SELECT o_orderkey AS k, CASE o_custkey % 10 WHEN 0 THEN 'unknown_entity' WHEN 1 THEN NULL ELSE o_custkey::VARCHAR END AS g, o_orderkey % 3 = 0 AS tagged FROM orders), {SPLIT_SQL}
SELECT k, kinds.g AS source_id, coalesce(split, 'train') AS split FROM kinds LEFT JOIN splits USING (kind, unit)
""")
def group_split(t):
    kind = F.col("o_custkey") % 10
    rows = t("orders").select(F.col("o_orderkey").alias("k"), F.when(kind == 0, "unknown_entity").when(kind > 1, F.col("o_custkey").cast("string")).alias("source_id"))
    return sampling.group_split(rows, "source_id", "k", F.col("k") % 3 == 0).select("k", "source_id", "split")


@query("""
WITH v AS (SELECT DISTINCT lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) AS term FROM benchmark), p AS (SELECT DISTINCT doc_id FROM documents JOIN v ON contains(lower(text), term)),
n AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p) ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id LIMIT (SELECT 2 * count(*) FROM p))
SELECT doc_id, true AS positive FROM p UNION ALL SELECT doc_id, false FROM n
""")
def balanced_sample(t):
    return sampling.balanced(t("documents"), "text", "doc_id", phrases(t), "term")


@query("""
WITH m AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE c_mktsegment END AS title, c_nationkey AS idx FROM customer)
SELECT k, coalesce(a.n_name, b.n_name, 'none') AS linked FROM m LEFT JOIN (SELECT 'BUILDING' AS t, 'first' AS n_name) a ON m.title = a.t LEFT JOIN nation b ON m.idx = b.n_nationkey AND b.n_regionkey <> 2
""")
def two_step_link(t):
    m = t("customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(F.col("c_mktsegment")).alias("title"), "c_nationkey")
    keys = t("nation").filter("n_regionkey <> 2").select(F.concat(F.lit("#"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"))
    table = keys.unionByName(keys.sparkSession.createDataFrame([("BUILDING", "first")], "key string, value string"))
    return joins.lookup_cascade(m, [F.col("title"), F.concat(F.lit("#"), F.col("c_nationkey").cast("string"))], table, "key", "value", "linked").select("k", F.coalesce("linked", F.lit("none")).alias("linked"))
