"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import chat, decontam, html, lattice_lm, media, neardup, quality, sharding, sp_bpe, tokenfile
from siltstone.llm.common import materialize, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_documents(tokenfile.write_segments(table(spark, sf_dir, "documents")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_bpe.digests(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, stored = media.store(table(spark, sf_dir, "documents"))
    found = media.resolve(media.sequences(media.pages(rows), keep=("n_bytes",)), media.media_features(stored))
    own = found.filter(F.col("caption") == media.OWN)  # each page refers to its payload twice
    return own.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).alias("conv_id"), F.lit(k).alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    formatted = chat.format_turns(chat.canonical_turns(chat.pack_records(rows.unionByName(extra)), "record", said="said"))
    out = materialize(formatted.select("conv_id", "layout", "formatted", "loss_spans"), "chat")
    out = out.withColumn("turns", chat.parse_formatted(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    said_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_sharding, op2_decontamination, op3_token_file, op4_html_extraction, op5_sentencepiece, op6_lm_scoring, op7_quality, op8_media, op9_chat_formatting, op10_near_duplicates,
)}


def _shard_sql() -> str:
    names, m = ", ".join(f"('{s}', {i})" for i, s in enumerate(sharding.SHARDS)), sharding.TABLE_SIZE
    number = lambda text: f"CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)"
    return f"""
WITH RECURSIVE shards AS (
  SELECT name, i, {number("name || '/offset'")} % {m} AS start, {number("name || '/skip'")} % {m - 1} + 1 AS skip
  FROM (VALUES {names}) v(name, i)
), lists AS (SELECT list(start ORDER BY i) AS starts, list(skip ORDER BY i) AS skips FROM shards),
-- Each step is one look at one slot: a free one ('.') is claimed and ends the turn, else the shard moves on.
fill(turn, place, owner, skips) AS (
  SELECT 0, starts, repeat('.', {m}), skips FROM lists
  UNION ALL
  SELECT turn + CAST(free AS INTEGER),
    CASE WHEN free THEN place ELSE place[1:who] || [(place[who + 1] + skips[who + 1]) % {m}] || place[who + 2:] END,
    CASE WHEN free THEN left(owner, spot) || chr(65 + who) || substr(owner, spot + 2) ELSE owner END, skips
  FROM (SELECT *, turn % {len(sharding.SHARDS)} AS who, CAST(place[turn % {len(sharding.SHARDS)} + 1] AS INTEGER) AS spot,
    substr(owner, CAST(place[turn % {len(sharding.SHARDS)} + 1] AS INTEGER) + 1, 1) = '.' AS free FROM fill WHERE turn < {m})
), slots AS (
  SELECT CAST(p AS BIGINT) AS slot, ascii(substr(owner, CAST(p + 1 AS INTEGER), 1)) - 65 AS i FROM (SELECT owner FROM fill WHERE turn = {m}), range({m}) r(p)
), placed AS (
  SELECT doc_id, {number("coalesce(CAST(doc_id AS VARCHAR), '')")} % {m} AS slot FROM documents
)
SELECT doc_id, slot, name AS shard FROM placed JOIN slots USING (slot) JOIN shards USING (i)"""


def _chat_sql() -> str:
    esc = lambda x: f"replace(replace(replace({x}, '\\', '\\b'), '<', '\\l'), '>', '\\g')"
    return f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), packed AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    string_agg('<turn:' || {esc("role")} || '>' || {esc("text")} || '</turn>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS formatted,
    string_agg(role, ',' ORDER BY turn NULLS FIRST, role, text) AS roles
  FROM said GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(length(formatted) AS BIGINT) AS formatted_chars,
  CASE WHEN n_turns = 2 AND roles = 'user,assistant' THEN 'prompt'
       WHEN n_turns = 3 AND roles = 'system,user,assistant' THEN 'instruction' ELSE 'messages' END AS layout
FROM packed"""


def _near_sql() -> str:
    return r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, CAST(len(w) AS BIGINT) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sets
  UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.r = links.x
), parts AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN parts USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {"op1_sharding": _shard_sql(), "op9_chat_formatting": _chat_sql(), "op10_near_duplicates": _near_sql()}
