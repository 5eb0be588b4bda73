"""The registered queries of the training-data operators, and SQL for those that SQL can express.

Each is a thin projection of its operator's result over whole tables with production parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.llm import storage

ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    storage.modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    from variorum.llm import urls

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.RULES, urls.PATTERNS).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op8_url_filter"] = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), listed AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '(^|\.)ads-track\.') OR regexp_matches(host, '(^|\.)doubleclick\.') THEN 'block'
  WHEN regexp_matches(path, '^/([^/]+/)*ads/') OR regexp_matches(path, '^/([^/]+/)*wp-login\.php$') OR regexp_matches(path, '^/([^/]+/)*checkout/') THEN 'block'
  ELSE 'allow' END AS verdict
FROM listed
"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    from variorum.llm import licenses

    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, and how many sentences offend."""
    from variorum.llm import toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    held = toxicity.held_out(F.col("doc_id")).alias("held_out")
    return toxicity.score(docs, model).select(F.col("doc_id").cast("long").alias("doc_id"), held, "score", "predicted", F.size("offending").alias("n_offending"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    from variorum.llm import langid

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    held = langid.held_out(F.col("doc_id")).alias("held_out")
    return langid.predict(docs.select("doc_id", "text"), model).select(F.col("doc_id").cast("long").alias("doc_id"), held, "lang_pred", "score", "rejected")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    from variorum.llm import bpe

    return bpe.digests(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from normalised archives."""
    from variorum.llm import warc

    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("url")


ORACLES["op5_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS response FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN response END AS refers_to
FROM r
"""


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth embedding, by inner product."""
    from variorum.llm import ann

    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated lines, and how many went."""
    from variorum.llm import linededup

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_equal", "n_near", F.sha2("text", 256).alias("text_sha256"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document."""
    from variorum.llm import neardup

    return neardup.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, or paraphrases of them."""
    from variorum.llm import decontam

    return decontam.leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""
    from variorum.llm import chat

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted(turns.unionByName(more)))


ORACLES["op11_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(regexp_replace(text, '(\[)(\\*/?(INST|SYS|ROLE|TURN)\])', '\1\\\2', 'g'), '(<)(\\*/?s>)', '\1\\\2', 'g'))
    + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 24 + length(role) END AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every embedding after five rounds, and how close it is."""
    from variorum.llm import clusters

    return clusters.cluster(_table(spark, sf_dir, "embeddings")).drop("scanned")


def _round_sql(i: int) -> str:
    """Assignment i to the centroids c{i}, and the centroids after it."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return f"""a{i} AS MATERIALIZED (
  SELECT id, vec_id, arg_min(number, (d, number)) AS cluster, min(d) AS distance FROM (SELECT v.id, v.vec_id, c.number, CAST({distance} AS BIGINT) AS d FROM v CROSS JOIN c{i} c) GROUP BY id, vec_id
), s{i} AS (
  SELECT cluster, i, CAST(floor_div(sum(x), count(*)) AS BIGINT) AS x FROM (SELECT a.cluster, unnest(range(1, 65)) AS i, unnest(v.x) AS x FROM a{i} a JOIN v USING (id)) GROUP BY cluster, i
), c{i + 1} AS MATERIALIZED (
  SELECT c.number, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS x FROM s{i} GROUP BY cluster) n ON n.cluster = c.number
)"""


# Floor of an exact quotient: integer division rounds towards zero.
_CLUSTER_ROUNDS = ",\n".join(_round_sql(i).replace("floor_div(sum(x), count(*))", "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)") for i in range(6))
ORACLES["op12_clusters"] = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS number, x FROM v QUALIFY number < 40
), {_CLUSTER_ROUNDS}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c5.x, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON c5.number = a5.cluster
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every embedding."""
    from variorum.llm import whitening

    return whitening.whiten(_table(spark, sf_dir, "embeddings"))
