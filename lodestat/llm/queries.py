"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, clustering, iblt, licenses, mixing, pii, quality, scoring, secrets, sharding, simhash, warc
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its metrics, its host's shrunken failure rate and the verdict."""
    report = quality.quality_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "source", F.round("host_rate", 6).alias("host_rate"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, and hashes of its ids and of the bytes they decode to."""
    return bpe.token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's size and target, and the words that the mix takes of it."""
    return mixing.mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and its place there, by the law of equal bytes."""
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch, that of its edited text, and their likeness."""
    return iblt.version_fingerprints(table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: base spans, and those that learnt formats add."""
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the least id that links of three bits reach."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence sentences, their places, and the licences they state."""
    found = licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = lambda field: F.array_join(F.transform("sentence_ids", lambda x: x[field].cast("string")), ",")
    return found.select("doc_id", ids("id").alias("sentences"), ids("at").alias("places"), F.array_join("licenses", ",").alias("licenses"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as read back from the archives written."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's unigram and neural scores."""
    return scoring.score_documents(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every part, order of the five filters and step, what the step's filter removes and what that costs."""
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_threshold_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector's cluster after five rounds, its squared distance and the sums of distances."""
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: base spans, and those that the tagger adds."""
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_quality_rules, op2_byte_bpe, op3_mix_sources, op4_kd_sharding, op5_iblt_fingerprints, op6_secret_scans, op7_simhash, op8_license_rules, op9_warc_round_trip, op10_log_bilinear, op11_filter_audit, op12_threshold_clusters, op13_personal_data]
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op8_license_rules": op8_sql(), "op9_warc_round_trip": OP9_SQL, "op11_filter_audit": op11_sql(), "op12_threshold_clusters": op12_sql()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS spot FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN repeated r ON r.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS f FROM b GROUP BY source),
a AS (SELECT sum(f) / sum(n)::DOUBLE AS mean, sum(f * f / n::DOUBLE) / sum(n) - power(sum(f) / sum(n)::DOUBLE, 2) - sum(f) / sum(n)::DOUBLE * (1 - sum(f) / sum(n)::DOUBLE) * count(*) / sum(n) AS spread FROM h),
p AS (SELECT mean, CASE WHEN spread > 1e-12 THEN least(1e6, greatest(1, mean * (1 - mean) / spread - 1)) ELSE 1e6 END AS weight FROM a),
r AS (SELECT source, (f + mean * weight) / (n + weight) AS host_rate FROM h, p)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND host_rate <= 0.9 AS kept, b.source, round(host_rate, 6) AS host_rate
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS bytes FROM pages),
f AS (SELECT digest, max(page_id) AS first FROM p WHERE bytes >= 1000 GROUP BY digest)
SELECT page_id, bytes::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.digest = p.digest AND bytes >= 1000
"""


def op8_sql() -> str:
    sentences = ", ".join(f"('{s}', '{i}')" for i, s in licenses.SENTENCES.items())
    end = licenses.SENTENCE_END
    slots = "".join(f" UNION ALL SELECT doc_id, place, '{i}' FROM n WHERE regexp_full_match(s, '{whole}') AND s NOT IN (SELECT sentence FROM known)" for i, (_, whole) in licenses.SLOTS.items())
    rules = licenses.by_length()
    found = ", ".join(f"contains(line{i}, '{ids}') AS found{i}, replace(line{i}, '{ids}', '#') AS line{i + 1}" for i, (_, ids) in enumerate(rules))
    names = ", ".join(f"CASE WHEN found{i} THEN '{name}' END" for i, (name, _) in enumerate(rules))
    return f"""
WITH known(sentence, id) AS (VALUES {sentences}),
s AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '{end}')) AS s, unnest(range(len(string_split_regex(coalesce(text, ''), '{end}')))) AS place FROM documents),
n AS (SELECT doc_id, place, lower(trim(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g'))) AS s FROM s WHERE length(s) >= {licenses.SHORTEST}),
k AS (SELECT doc_id, place, id FROM n JOIN known ON sentence = s{slots}),
l AS (SELECT doc_id, string_agg(id, ',' ORDER BY place) AS sentences, string_agg(place::VARCHAR, ',' ORDER BY place) AS places, '|' || string_agg(id, '||' ORDER BY place) || '|' AS line0 FROM k GROUP BY doc_id),
f AS (SELECT *, {found} FROM l),
m AS (SELECT doc_id, sentences, places, array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))), ',') AS licenses FROM f)
SELECT d.doc_id, coalesce(sentences, '') AS sentences, coalesce(places, '') AS places, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id
"""


def op11_sql() -> str:
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(audit.FILTERS))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * (length(t.text) - length(regexp_replace(t.text, '[A-Z]', '', 'g'))) > 3 * length(t.text))::INT
    + 8 * regexp_matches(t.text, '[#$%&*|]')::INT + 16 * coalesce(t.doc_id > first, false)::INT AS mask
  FROM t JOIN firsts ON firsts.text = t.text LEFT JOIN l ON l.doc_id = t.doc_id),
c AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY part, mask),
o(filter_order) AS (VALUES {orders}),
s AS (SELECT filter_order, step, 1 << (instr('ABCDE', filter_order[step]) - 1) AS bit,
  list_sum([0] || list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', filter_order[i]) - 1))) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, before::BIGINT AS _b FROM c, s) GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM r
"""


def op12_sql() -> str:
    n, k = clustering.DIMENSIONS, clustering.CENTROIDS
    gap = f"list_sum(list_transform(range(1, {n + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    rounds = ""
    for turn in range(clustering.ROUNDS + 1):
        rounds += f""",
d{turn} AS MATERIALIZED (SELECT row, min({{'d': gap, 'c': c}}) AS best FROM (SELECT v.row, c.c, {gap}::BIGINT AS gap FROM v, c{turn} c) GROUP BY row)"""
        if turn < clustering.ROUNDS:
            rounds += f""",
s{turn} AS (SELECT best.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM d{turn} JOIN v ON v.row = d{turn}.row, (SELECT unnest(range(1, {n + 1})) AS i) GROUP BY 1, 2),
m{turn} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{turn} GROUP BY c),
c{turn + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{turn} c LEFT JOIN m{turn} m ON m.c = c.c)"""
    return f"""
WITH whole AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {n} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {n}),
v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({clustering.SCALE} * x::DOUBLE)::BIGINT) AS x FROM whole),
c0 AS MATERIALIZED (SELECT c, x FROM (SELECT row_number() OVER (ORDER BY sha256('{clustering.SEED}:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x FROM v) WHERE c < {k}){rounds}
SELECT vec_id, best.c::INT AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM d{clustering.ROUNDS} d JOIN v ON v.row = d.row JOIN c{clustering.ROUNDS} c ON c.c = best.c
"""
