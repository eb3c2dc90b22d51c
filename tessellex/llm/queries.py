"""One query for each operator of this subpackage, over whole tables, and SQL where that can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from . import ann, best_fit, fingerprints, langid, lexical_search, line_dedup, packing, periodic_runs, pii, sentence_pieces, simhash, token_counts, url_filters

#: The rules that op3 judges by: (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def vocabulary(name: str) -> str:
    """The path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    profiles = langid.fit(docs.filter(~held_out & F.col("doc_id").isNotNull()).select("text", "lang"))
    judged = langid.predict(docs.select("doc_id", "text"), profiles)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_edits(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "lines_total", "lines_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model")).select("doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "exact")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), out="spans")
    told = lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))
    many = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    counts = [many(k) for k in pii.BASE_KINDS]
    base = F.array_join(F.transform(F.filter("spans", lambda s: s.kind.isin(*pii.BASE_KINDS)), told), ",")
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", told), ",").alias("spans"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    looped = table(spark, sf_dir, "documents").select("doc_id", periodic_runs.looped("text", F.crc32(F.col("doc_id").cast("string"))).alias("text"))
    told = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("s"), (-r.period).alias("p"))))
    found = periodic_runs.find(looped).withColumn("longest", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.s")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.p")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.p")).cast("long").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_fingerprints, op3_url_filters, op4_simhash, op5_line_dedup, op6_sentence_pieces, op7_token_counts, op8_pii, op9_packing, op10_nearest, op11_best_fit, op12_periodic_runs, op13_lexical_search, pipeline)
    return {f.__name__: _prepared(f) for f in own}


def _prepared(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return f(spark, sf_dir)

    return run


_RULES_SQL = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
) + " END"

OP3_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, {_RULES_SQL} AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({", ".join(f"'{h}{p}'" for h, p, v in URL_RULES if v == "block")}) THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

OP5_SQL = """
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
every AS (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS s FROM docs),
places AS (SELECT s, min((doc_id, line)) AS first FROM every WHERE length(s) >= 24 GROUP BY s),
shorter AS (SELECT s, first, p, s[:p] || s[p + 2:] AS v FROM (SELECT *, unnest(range(length(s))) AS p FROM places)),
pairs AS (
  SELECT a.s FROM shorter a JOIN shorter b ON a.v = b.v AND a.p = b.p WHERE b.first < a.first
  UNION SELECT a.s FROM shorter a JOIN places b ON a.v = b.s WHERE b.first < a.first
  UNION SELECT a.s FROM places a JOIN shorter b ON a.s = b.v WHERE b.first < a.first),
judged AS (SELECT e.doc_id, e.line, e.s, coalesce(length(e.s) >= 24 AND ((e.doc_id, e.line) <> p.first OR e.s IN (SELECT s FROM pairs)), false) AS gone FROM every e LEFT JOIN places p ON e.s = p.s)
SELECT doc_id, count(*) AS lines_total, count(*) FILTER (gone) AS lines_dropped, sha256(coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id
"""


_STARTS = "list_transform(range(len(m)), lambda i: coalesce(list_sum(list_transform(g[:i + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[:i], lambda x: length(x))), 0))"


def _kind_sql(kind: str, pattern: str, check: str) -> str:
    """A list of (kind, start, end) for a pattern's matches that pass a check on v (the match) and d (its digits)."""
    return f"""(SELECT list_transform(list_filter(list_zip(m, {_STARTS}), lambda z: {check.replace("$v", "z[1]").replace("$s", "z[2]")}), lambda z: '{kind}:' || z[2]::BIGINT || ':' || (z[2] + length(z[1]))::BIGINT)
      FROM (SELECT regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g))"""


_DIGITS = "regexp_replace($v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN reverse({_DIGITS})[i + 1]::INT WHEN reverse({_DIGITS})[i + 1]::INT > 4 THEN 2 * reverse({_DIGITS})[i + 1]::INT - 9 ELSE 2 * reverse({_DIGITS})[i + 1]::INT END)) % 10 = 0"
_MOD97 = "list_reduce(list_prepend(0, list_transform(string_split($v[5:] || $v[:4], ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE coalesce(try_cast(c AS INT), 0) END)), lambda a, x: (CASE WHEN x >= 10 THEN a * 100 + x ELSE a * 10 + x END) % 97) = 1"
_RUN = f"regexp_extract(substr(t, z[2]::BIGINT + 1, {pii.IBAN_REACH}), '^[A-Z0-9](?: ?[A-Z0-9]){{0,{pii.IBAN_REACH // 2 - 1}}}')"
_IBAN_LENGTH = "MAP {" + ", ".join(f"'{c}': {n}" for c, n in pii.IBAN_LENGTHS.items()) + "}[z[1][:2]]"
_KINDS_SQL = {
    "email": _kind_sql("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": _kind_sql("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split($v, '.'), lambda x: x::HUGEINT)) <= 255"),
    "card": _kind_sql("card", r"[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
    "phone": _kind_sql("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    "iban": f"""(SELECT list_transform(list_filter(list_transform(list_filter(list_zip(m, {_STARTS}), lambda z: NOT regexp_matches(substr(t, z[2]::BIGINT, 1), '[A-Za-z0-9]')),
        lambda z: [z[2]::BIGINT, coalesce(list_filter(range(1, {pii.IBAN_REACH}), lambda e: e <= length({_RUN}) AND length(replace(({_RUN})[:e], ' ', '')) = {_IBAN_LENGTH})[1], 0)]),
        lambda p: p[2] > 0 AND NOT regexp_matches(substr(t, p[1] + p[2] + 1, 1), '[A-Za-z0-9]') AND {_MOD97.replace("$v", "replace(substr(t, p[1] + 1, p[2]), ' ', '')")}),
        lambda p: 'iban:' || p[1] || ':' || (p[1] + p[2]))
      FROM (SELECT regexp_extract_all(t, '[A-Z]{{2}}[0-9]{{2}}') AS m, string_split_regex(t, '[A-Z]{{2}}[0-9]{{2}}') AS g))""",
    "ssn": _kind_sql("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches($v, '^(000|666|9)|-00-|-0000$') AND (contains(lower(t[greatest($s - 39, 1):$s::BIGINT]), 'ssn') OR contains(lower(t[greatest($s - 39, 1):$s::BIGINT]), 'social security'))"),
}
OP8_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, {", ".join(f"{sql} AS {kind}" for kind, sql in _KINDS_SQL.items())} FROM texts)
SELECT doc_id, {", ".join(f"len({k})::BIGINT AS n_{k}" for k in ("email", "ip", "card", "phone"))},
  sha256(coalesce(array_to_string(email || ip || card || phone, ','), '')) AS base_sha256, coalesce(array_to_string(email || ip || card || phone || iban || ssn, ','), '') AS spans
FROM found
"""

OP10_SQL = """
WITH vectors AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, q.v, c.vec_id, list_inner_product(q.v, c.v) AS score FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


_CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, s: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"

OP12_SQL = r"""
WITH parts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, $CRC32 AS h FROM documents),
loops AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a, h // 10 AS g FROM parts),
periods AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM loops),
words AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END)) AS word FROM periods),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 2),
lags AS (SELECT doc_id, q FROM pairs GROUP BY doc_id, q HAVING count(*) >= greatest(12 - q, q)),
placed AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs SEMI JOIN lags USING (doc_id, q)),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM placed GROUP BY doc_id, q, island HAVING count(*) >= greatest(12 - q, q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
texts AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
told AS (SELECT doc_id, count(*) AS n_runs, max((length, -start, -period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-best[2])::BIGINT AS start, best[1]::BIGINT AS length, (-best[3])::BIGINT AS period, (1000 * best[1] // -best[3])::BIGINT AS exponent_milli,
  sha256(coalesce(told.t, '')) AS runs_sha256, sha256(coalesce(texts.t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN told USING (doc_id) LEFT JOIN texts USING (doc_id)
""".replace("$CRC32", _CRC32)

OP13_SQL = r"""
WITH parts AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM parts GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS l FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, totals GROUP BY term, docs),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
repeats AS (SELECT item_id, term, count(*)::BIGINT AS r FROM asked GROUP BY ALL),
scored AS (SELECT item_id, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // l))))::BIGINT AS score
  FROM repeats JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filters": OP3_SQL, "op5_line_dedup": OP5_SQL, "op8_pii": OP8_SQL, "op10_nearest": OP10_SQL, "op12_periodic_runs": OP12_SQL, "op13_lexical_search": OP13_SQL}
