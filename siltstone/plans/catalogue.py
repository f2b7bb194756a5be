"""Registered queries of the deduplication engine and their DuckDB SQL.

Documents are taken as files: path from lang, source and doc_id, bytes from the text, plus one empty
file. Snapshot A is the documents; snapshot B has edits by doc_id modulo 10: 0 prepends a byte,
1 inserts one in the middle, 2 deletes 100 bytes from a third on, 3 appends a line, 4 drops the file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import columns as C
from siltstone.functions.config import mismatches
from siltstone.functions.gear import GEAR_SEED, low_ones, mask_bits
from siltstone.operators import chunking, dedup, resync, snapshots
from siltstone.operators.chunking import ChunkConfig
from siltstone.operators.ordering import running_total
from siltstone.repository import SNAPSHOTS, Repository
from siltstone.sources import filetree, formats
from siltstone.storage import materialize, new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FIXED, CDC = ChunkConfig.of_kib(1, fixed=True), ChunkConfig.of_kib(1)
STRATEGIES = {"cdc 1K": CDC, "fixed 1K": FIXED, "cdc 8K": ChunkConfig.of_kib(8), "fixed 8K": ChunkConfig.of_kib(8, fixed=True)}
MODE, MTIME = 33188, 1_700_000_000
IDS = ("20240101-000000", "20240102-000000")


def query(sql: str | None = None, name: str | None = None):
    """Register a query, and its SQL if there is any."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return register


# Inputs


def files(spark: SparkSession, sf_dir: str, snapshot: str = "A") -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    content, n = F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.octet_length("content")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.concat(part("lang"), F.lit("/"), part("source"), F.lit("/"), part("doc_id"), F.lit(".txt")).alias("path"), F.coalesce(F.pmod("doc_id", F.lit(10)), F.lit(9)).alias("edit"), content.alias("content"))
    if snapshot == "B":
        c, half, third = F.col("content"), F.floor(n / 2).cast("int"), F.floor(n / 3).cast("int")
        edited = F.when(F.col("edit") == 0, F.concat(F.lit(b"X"), c)).when(F.col("edit") == 1, C.insert_bytes(c, half, b"X")).when(F.col("edit") == 2, C.delete_bytes(c, third, 100))
        rows = rows.filter("edit <> 4").withColumn("content", edited.when(F.col("edit") == 3, F.concat(c, F.lit(b" appended line"))).otherwise(c))
    empty = spark.range(1).select(F.lit("empty.txt").alias("path"), F.lit(9).cast("long").alias("edit"), F.lit(b"").alias("content"))
    return rows.unionByName(empty).select("path", "edit", F.lit(MODE).alias("mode"), F.lit(MTIME).cast("long").alias("mtime_unix"), "content")


def recipes(spark: SparkSession, sf_dir: str, snapshot: str = "A", config: ChunkConfig = FIXED) -> DataFrame:
    """path, edit, mode, mtime_unix, size, file_digest and chunks: one pass over the files, no bytes behind it."""
    return chunking.recipes(files(spark, sf_dir, snapshot), config, keep=("edit", "mode", "mtime_unix"))


def chunked(spark: SparkSession, sf_dir: str, snapshot: str = "A", config: ChunkConfig = FIXED) -> DataFrame:
    return chunking.chunks_of(recipes(spark, sf_dir, snapshot, config))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes of both snapshots, written: what a query asks of chunks it asks of this table."""
    rows = [recipes(spark, sf_dir, s).withColumn("snapshot_id", F.lit(i)) for s, i in zip("AB", IDS, strict=True)]
    return materialize(rows[0].unionByName(rows[1]), "recipes")


def manifests(spark: SparkSession, sf_dir: str, both: DataFrame | None = None) -> DataFrame:
    if both is None:
        rows = [recipes(spark, sf_dir, s).withColumn("snapshot_id", F.lit(i)) for s, i in zip("AB", IDS, strict=True)]
        both = rows[0].unionByName(rows[1])
    return snapshots.manifest_of(both.drop("edit"))


def stored(spark: SparkSession, sf_dir: str, both: DataFrame) -> DataFrame:
    """digest, length and data of the distinct chunks of both snapshots; bytes are cut from the file of a chunk's first reference alone."""
    refs = chunking.chunks_of(both, keep=("snapshot_id",))
    first = refs.groupBy("digest").agg(F.min(F.struct("snapshot_id", "path", "offset", "length")).alias("f"))
    wanted = first.groupBy("f.snapshot_id", "f.path").agg(F.collect_list(F.struct("digest", "f.offset", "f.length")).alias("chunks"))
    whole = [files(spark, sf_dir, s).select(F.lit(i).alias("snapshot_id"), "path", "content") for s, i in zip("AB", IDS, strict=True)]
    rows = whole[0].unionByName(whole[1]).join(wanted, ["snapshot_id", "path"]).select("content", F.explode("chunks").alias("c"))
    return rows.select("c.digest", "c.length", C.cut(F.col("content"), F.col("c.offset"), F.col("c.length")).alias("data"))


def faulty(spark: SparkSession, sf_dir: str, both: DataFrame) -> DataFrame:
    """Stored chunks with faults: digests that begin with 00 are missing, with 01 corrupt."""
    rows = stored(spark, sf_dir, both).filter(~F.col("digest").startswith("00"))
    return rows.withColumn("data", F.when(F.col("digest").startswith("01"), F.concat("data", F.lit(b"!"))).otherwise(F.col("data")))


_PATH = "concat(coalesce(lang, ''), '/', coalesce(source, ''), '/', coalesce(CAST(doc_id AS VARCHAR), ''), '.txt')"
_BYTES = "encode(coalesce(text, ''))"
_CUT = "{0}[CAST({1} + 1 AS BIGINT):CAST({1} + {2} AS BIGINT)]"
_FILES = f"""
docs AS (SELECT {_PATH} AS path, coalesce(((doc_id % 10) + 10) % 10, 9) AS edit, {_BYTES} AS c FROM documents),
a AS (SELECT path, edit, c FROM docs UNION ALL SELECT 'empty.txt', 9, ''::BLOB),
b AS (SELECT path, edit, CASE edit WHEN 0 THEN 'X'::BLOB || c
  WHEN 1 THEN c[1:octet_length(c) // 2] || 'X'::BLOB || c[octet_length(c) // 2 + 1:octet_length(c)]
  WHEN 2 THEN c[1:octet_length(c) // 3] || c[octet_length(c) // 3 + 101:octet_length(c)]
  WHEN 3 THEN c || ' appended line'::BLOB ELSE c END AS c FROM a WHERE edit <> 4),
ab AS (SELECT '{IDS[0]}' AS snapshot_id, * FROM a UNION ALL SELECT '{IDS[1]}', * FROM b)"""


def _spans(size: int = FIXED.avg_size) -> str:
    return f"""
parts AS (SELECT snapshot_id, path, edit, c, octet_length(c) AS n, unnest(range(0, (octet_length(c) + {size - 1}) // {size})) AS i FROM ab),
spans AS (SELECT snapshot_id, path, edit, CAST(i AS INTEGER) AS seq, CAST(i * {size} AS BIGINT) AS "offset", CAST(least({size}, n - i * {size}) AS INTEGER) AS length,
  c[CAST(i * {size} + 1 AS BIGINT):CAST(least((i + 1) * {size}, n) AS BIGINT)] AS data FROM parts),
chunks AS (SELECT snapshot_id, path, edit, seq, "offset", length, data, sha256(data) AS digest FROM spans),
ca AS (SELECT * FROM chunks WHERE snapshot_id = '{IDS[0]}'), cb AS (SELECT * FROM chunks WHERE snapshot_id = '{IDS[1]}')"""


def sql(select: str, size: int = FIXED.avg_size) -> str:
    return f"WITH {_FILES}, {_spans(size)}\n{select}"


_UNIQUE = "(SELECT digest, min(length) AS length FROM {0} GROUP BY digest)"
_SIZES = """count(*) AS chunks, coalesce(CAST(sum(length) AS BIGINT), 0) AS bytes, coalesce(avg(length), 0.0) AS mean,
  coalesce(CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY length DESC) AS BIGINT), 0) AS median,
  CAST(coalesce(min(length), 0) AS BIGINT) AS least, CAST(coalesce(max(length), 0) AS BIGINT) AS largest"""


# Sources and scalar functions


@query(f"WITH {_FILES} SELECT path, {MODE} AS mode, CAST({MTIME} AS BIGINT) AS mtime_unix, CAST(octet_length(c) AS BIGINT) AS size, sha256(c) AS digest FROM a")
def scan_files(spark, sf_dir):
    return files(spark, sf_dir).select("path", "mode", "mtime_unix", F.octet_length("content").cast("long").alias("size"), C.sha256(F.col("content")).alias("digest"))


@query("SELECT 'p' || page_id AS path, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS size, sha256(encode(coalesce(html, ''))) AS digest FROM pages")
def file_digest(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("c"))
    return rows.select("path", F.octet_length("c").cast("long").alias("size"), C.sha256(F.col("c")).alias("digest"))


def _crc_table_sql() -> str:
    """CTEs up to crc(t): the 256 numbers of the reversed CRC-32 polynomial, each by eight halvings."""
    halve = lambda k: f"step{k + 1} AS (SELECT i, xor(x >> 1, CASE WHEN x % 2 = 1 THEN {0xEDB88320}::BIGINT ELSE 0::BIGINT END) AS x FROM step{k})"
    return "step0 AS (SELECT i, CAST(i AS BIGINT) AS x FROM range(256) r(i)), " + ", ".join(map(halve, range(8))) + ", crc AS MATERIALIZED (SELECT list(x ORDER BY i) AS t FROM step8)"


def _crc_sql(raw: str) -> str:
    """CRC-32 of a blob, with the table in ``t``."""
    bytes_ = f"list_transform(regexp_extract_all(hex({raw}), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend({0xFFFFFFFF}::BIGINT, {bytes_}), lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INTEGER) + 1])), {0xFFFFFFFF}::BIGINT)"


@query(f"WITH {_FILES}, {_crc_table_sql()}, checked AS (SELECT path, c FROM a UNION ALL SELECT 'check', '123456789'::BLOB) SELECT path, {_crc_sql('c')} AS crc32 FROM checked, crc")
def crc32_check(spark, sf_dir):
    check = spark.range(1).select(F.lit("check").alias("path"), F.lit(b"123456789").alias("content"))
    return files(spark, sf_dir).select("path", "content").unionByName(check).select("path", F.crc32("content").alias("crc32"))


@query(f"SELECT l_orderkey, l_linenumber, CAST((l_orderkey * 8 + l_linenumber) % 65536 AS INTEGER) AS mode, CAST(((l_orderkey * 8 + l_linenumber) % 65536) & 4095 AS INTEGER) AS permissions FROM lineitem")
def mode_mask(spark, sf_dir):
    mode = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) % 65536).cast("int")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", mode.alias("mode"), C.mode_bits(mode).alias("permissions"))


@query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS snapshot_id FROM events")
def snapshot_id(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", C.snapshot_id(F.col("ts")).alias("snapshot_id"))


@query("SELECT strftime(o_orderdate, '%Y%m%d-%H%M%S') AS snapshot_id, count(*) AS files, CAST(row_number() OVER (ORDER BY strftime(o_orderdate, '%Y%m%d-%H%M%S')) AS INTEGER) AS place FROM orders GROUP BY 1")
def list_snapshots(spark, sf_dir):
    """A repository whose snapshots are the orders' dates, listed; the place is that in the list."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(C.snapshot_id(F.col("o_orderdate")).alias("snapshot_id")).agg(F.count(F.lit(1)).alias("file_count"))
    repo = Repository.create(spark, new_path(spark, "listed"))
    spark.createDataFrame([], SNAPSHOTS).unionByName(rows, allowMissingColumns=True).write.parquet(f"{repo.path}/snapshots")
    listed = repo.list_snapshots().select("snapshot_id", F.col("file_count").alias("files"))
    return listed.withColumn("place", F.row_number().over(Window.orderBy("snapshot_id")))  # snapshots are few


def _edit_query(change: Callable, expression: str, name: str) -> None:
    @query(f"WITH {_FILES}, e AS (SELECT path, {expression} AS d FROM a) SELECT path, CAST(octet_length(d) AS BIGINT) AS size, sha256(d) AS digest FROM e", name)
    def run(spark, sf_dir):
        rows = files(spark, sf_dir)
        n = F.octet_length("content")
        return rows.select("path", change(F.col("content"), n).alias("d")).select("path", F.octet_length("d").cast("long").alias("size"), C.sha256(F.col("d")).alias("digest"))


_edit_query(lambda c, n: C.insert_bytes(c, F.lit(0), b"\xab"), "'\\xAB'::BLOB || c", "edit_insert_front")
_edit_query(lambda c, n: C.insert_bytes(c, F.floor(n / 2).cast("int"), b"\xab"), "c[1:octet_length(c) // 2] || '\\xAB'::BLOB || c[octet_length(c) // 2 + 1:octet_length(c)]", "edit_insert_mid")
_edit_query(lambda c, n: C.delete_bytes(c, F.floor(n / 3).cast("int"), 100), "c[1:octet_length(c) // 3] || c[octet_length(c) // 3 + 101:octet_length(c)]", "edit_delete")

# Chunking


@query(sql('SELECT path, seq, "offset", length, false AS content_defined FROM ca'))
def fixed_spans(spark, sf_dir):
    return chunking.fixed_spans(files(spark, sf_dir), FIXED.avg_size)


def _gear_sql() -> str:
    """CTEs up to gear(v, g): the table's 256 numbers, by the 64-bit Mersenne twister in SQL."""
    m = 1 << 64
    twist = lambda a, b: f"xor({a} >> 1, CASE WHEN ({b}) % 2 = 1 THEN {0xB5026F5AA96619E9}::HUGEINT ELSE 0::HUGEINT END)"
    mixed = "(s1.x - s1.x % 2147483648 + s2.x % 2147483648)"
    word = lambda far: f"xor({far}, {twist(mixed, 's2.x')})"
    temper = [f"xor(x, (x >> 29) & {0x5555555555555555}::HUGEINT)", f"xor(x, ((x & {(1 << 47) - 1}::HUGEINT) << 17) & {0x71D67FFFEDA60000}::HUGEINT)", f"xor(x, ((x & {(1 << 27) - 1}::HUGEINT) << 37) & {0xFFF7EEE000000000}::HUGEINT)", "xor(x, x >> 43)"]
    steps = ", ".join(f"temper{k + 1} AS (SELECT i, {x} AS x FROM {'twisted' if not k else f'temper{k}'})" for k, x in enumerate(temper))
    return f"""
seeds(i, x) AS (SELECT 0, {GEAR_SEED}::HUGEINT UNION ALL SELECT i + 1, ({6364136223846793005}::HUGEINT * xor(x, x >> 62) + i + 1) % {m}::HUGEINT FROM seeds WHERE i < 311),
low AS (SELECT s1.i, {word("far.x")} AS x FROM seeds s1 JOIN seeds s2 ON s2.i = s1.i + 1 JOIN seeds far ON far.i = s1.i + 156 WHERE s1.i < 156),
high AS (SELECT s1.i, {word("far.x")} AS x FROM seeds s1 JOIN seeds s2 ON s2.i = s1.i + 1 JOIN low far ON far.i = s1.i - 156 WHERE s1.i BETWEEN 156 AND 255),
twisted AS (SELECT * FROM low UNION ALL SELECT * FROM high), {steps},
gear64 AS MATERIALIZED (SELECT i AS v, x AS g FROM temper4)"""


def _cuts_sql(config: ChunkConfig, table: str, name: str = "spans") -> str:
    """CTEs up to a table of the spans of content-defined chunks: hash windows, and a recursive search for the next cut."""
    strict, loose = mask_bits(config.avg_size)
    mask, n = low_ones(strict), name
    full = " + ".join(f"coalesce(lag(g, {k}) OVER w, 0) * {1 << k}" for k in range(strict))
    shorts = [" + ".join(f"coalesce(lag(g, {k}) OVER w, 0) * {1 << k}" for k in range(m + 1)) for m in range(strict - 1)]
    seen = ", ".join(f"({x}) & {mask} = 0 AS s{m}, ({x}) & {low_ones(loose)} = 0 AS l{m}" for m, x in enumerate(shorts))
    any_short = " OR ".join(f"l{m}" for m in range(strict - 1))
    pick = " ".join(f"WHEN p - f.cut - {config.min_size} = {m} THEN (p - f.cut < {config.avg_size} AND s{m}) OR (p - f.cut >= {config.avg_size} AND l{m})" for m in range(strict - 1))
    keep = ", ".join(f"s{m}, l{m}" for m in range(strict - 1))
    return f"""
{n}_bytes AS (SELECT snapshot_id, path, unnest(regexp_extract_all(hex(c), '..')) AS h, generate_subscripts(regexp_extract_all(hex(c), '..'), 1) - 1 AS p FROM {table}),
{n}_hashed AS (SELECT snapshot_id, path, p, CAST(gear64.g % {mask + 1} AS BIGINT) AS g FROM {n}_bytes JOIN gear64 ON v = CAST('0x' || h AS INTEGER)),
{n}_tested AS (SELECT snapshot_id, path, p, ({full}) & {mask} = 0 AS strict, ({full}) & {low_ones(loose)} = 0 AS loose, {seen} FROM {n}_hashed WINDOW w AS (PARTITION BY snapshot_id, path ORDER BY p)),
{n}_hits AS MATERIALIZED (SELECT snapshot_id, path, p, strict, loose, {keep} FROM {n}_tested WHERE loose OR {any_short}),
{n}_walk(snapshot_id, path, n, seq, start, cut, defined) AS (
  SELECT snapshot_id, path, octet_length(c), -1, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM {table} WHERE octet_length(c) > 0
  UNION ALL
  SELECT f.snapshot_id, f.path, f.n, f.seq + 1, f.cut,
    CASE WHEN f.n - f.cut <= {config.min_size} THEN f.n ELSE coalesce(min(h.p) + 1, least(f.n, f.cut + {config.max_size})) END,
    f.n - f.cut > {config.min_size} AND min(h.p) IS NOT NULL
  FROM (SELECT * FROM {n}_walk WHERE cut < n) f LEFT JOIN (SELECT * FROM {n}_hits) h
    ON h.snapshot_id = f.snapshot_id AND h.path = f.path AND h.p >= f.cut + {config.min_size} AND h.p < least(f.n, f.cut + {config.max_size})
    AND CASE {pick} WHEN p - f.cut < {config.avg_size} THEN strict ELSE loose END
  GROUP BY f.snapshot_id, f.path, f.n, f.seq, f.cut
), {n} AS (SELECT snapshot_id, path, CAST(seq AS INTEGER) AS seq, start AS "offset", CAST(cut - start AS INTEGER) AS length, defined AS content_defined FROM {n}_walk WHERE seq >= 0)"""


def _cdc_sql(select: str, config: ChunkConfig = CDC, table: str = "only_a") -> str:
    """A query of content-defined spans, and chunks with their digests, of snapshot A or (``ab``) of both."""
    return f"""
WITH RECURSIVE {_FILES}, only_a AS (SELECT * FROM ab WHERE snapshot_id = '{IDS[0]}'), {_gear_sql()}, {_cuts_sql(config, table)},
chunks AS (SELECT s.*, t.edit, sha256({_CUT.format("t.c", 's."offset"', "s.length")}) AS digest FROM spans s JOIN {table} t ON t.snapshot_id = s.snapshot_id AND t.path = s.path),
ca AS (SELECT * FROM chunks WHERE snapshot_id = '{IDS[0]}'), cb AS (SELECT * FROM chunks WHERE snapshot_id = '{IDS[1]}')
{select}"""


def _strategy_sql() -> str:
    """Chunks of both snapshots by every strategy, and what is new in the second."""
    cuts, rows = [], []
    for k, (name, config) in enumerate(STRATEGIES.items()):
        if config.strategy == "cdc":
            cuts.append(_cuts_sql(config, "ab", f"spans{k}"))
            rows.append(f"SELECT '{name}' AS strategy, s.snapshot_id, s.length, sha256({_CUT.format('t.c', 's."offset"', 's.length')}) AS digest FROM spans{k} s JOIN ab t ON t.snapshot_id = s.snapshot_id AND t.path = s.path")
        else:
            size = config.avg_size
            piece = f"c[CAST(i * {size} + 1 AS BIGINT):CAST((i + 1) * {size} AS BIGINT)]"
            rows.append(f"SELECT '{name}', snapshot_id, CAST(octet_length({piece}) AS INTEGER), sha256({piece}) FROM (SELECT *, unnest(range(0, (octet_length(c) + {size - 1}) // {size})) AS i FROM ab)")
    return f"""
WITH RECURSIVE {_FILES}, {_gear_sql()}, {", ".join(cuts)}, chunks AS ({" UNION ALL ".join(rows)}),
by_chunk AS (SELECT strategy, digest, min(length) AS length, count(*) FILTER (WHERE snapshot_id = '{IDS[1]}') AS refs, CAST(NOT bool_or(snapshot_id = '{IDS[0]}') AS INTEGER) AS miss FROM chunks GROUP BY strategy, digest)
SELECT strategy, CAST(sum(refs) AS BIGINT) AS logical_chunks, CAST(sum(refs * length) AS BIGINT) AS logical_bytes, CAST(sum(miss) AS BIGINT) AS misses, CAST(sum(refs - miss) AS BIGINT) AS hits,
  CAST(sum(miss * length) AS BIGINT) AS new_bytes FROM by_chunk WHERE refs > 0 GROUP BY strategy"""


@query(_cdc_sql('SELECT path, seq, "offset", length, content_defined FROM spans'))
def cdc_spans(spark, sf_dir):
    return chunking.cdc_spans(files(spark, sf_dir), CDC)


@query(_cdc_sql('SELECT path, seq, "offset", length, content_defined, digest FROM chunks'))
def cdc_chunks(spark, sf_dir):
    return chunked(spark, sf_dir, "A", CDC)


@query(_cdc_sql("SELECT count(*) AS total, count_if(content_defined) AS content_defined, count(*) - count_if(content_defined) AS positional, coalesce(100.0::DOUBLE * (count(*) - count_if(content_defined)) / count(*), 0.0) AS positional_percent FROM spans").replace("count_if(content_defined) AS content_defined", "CAST(count_if(content_defined) AS BIGINT) AS content_defined").replace("count(*) - count_if(content_defined) AS positional", "CAST(count(*) - count_if(content_defined) AS BIGINT) AS positional"))
def boundary_origin(spark, sf_dir):
    return dedup.boundary_origin(chunking.cdc_spans(files(spark, sf_dir), CDC))


@query(sql(f"SELECT {_SIZES} FROM ca"))
def chunk_size_dist(spark, sf_dir):
    return dedup.size_stats(chunking.fixed_spans(files(spark, sf_dir), FIXED.avg_size))


@query(sql("SELECT CAST(least(length // 256, 16) AS INTEGER) AS bucket, count(*) AS chunks FROM ca GROUP BY 1"))
def size_histogram(spark, sf_dir):
    return dedup.size_histogram(chunking.fixed_spans(files(spark, sf_dir), FIXED.avg_size), 256)


@query(sql("SELECT digest, length, refs FROM (SELECT digest, min(length) AS length, count(*) AS refs FROM ca GROUP BY digest)"))
def unique_chunks(spark, sf_dir):
    return dedup.unique_chunks(chunked(spark, sf_dir))


@query(sql(f"SELECT {_SIZES} FROM {_UNIQUE.format('ca')}"))
def chunk_stats(spark, sf_dir):
    return dedup.size_stats(dedup.unique_chunks(chunked(spark, sf_dir)))


# Dedup joins


def _index(spark, sf_dir):
    return dedup.unique_chunks(chunked(spark, sf_dir, "A"))


@query(sql(f"SELECT digest, length FROM {_UNIQUE.format('cb')} WHERE digest NOT IN (SELECT digest FROM ca)"))
def dedup_new_chunks(spark, sf_dir):
    return dedup.new_chunks(chunked(spark, sf_dir, "B"), _index(spark, sf_dir))


@query(sql(f"SELECT digest, length FROM {_UNIQUE.format('cb')} WHERE digest IN (SELECT digest FROM ca)"))
def dedup_hits(spark, sf_dir):
    return dedup.known_chunks(chunked(spark, sf_dir, "B"), _index(spark, sf_dir))


@query(sql("""SELECT CAST(sum(refs) AS BIGINT) AS logical_chunks, CAST(sum(refs * length) AS BIGINT) AS logical_bytes, CAST(sum(miss) AS BIGINT) AS misses,
  CAST(sum(refs) - sum(miss) AS BIGINT) AS hits, CAST(sum(miss * length) AS BIGINT) AS new_bytes
  FROM (SELECT digest, min(length) AS length, count(*) AS refs, CASE WHEN digest IN (SELECT digest FROM ca) THEN 0 ELSE 1 END AS miss FROM cb GROUP BY digest)"""))
def dedup_summary(spark, sf_dir):
    return dedup.dedup_summary(chunked(spark, sf_dir, "B"), _index(spark, sf_dir))


_PACK = "(SELECT digest, length, CAST(sum(length) OVER (ORDER BY path, seq) - length AS BIGINT) AS \"offset\" FROM (SELECT digest, length, path, seq FROM ca QUALIFY row_number() OVER (PARTITION BY digest ORDER BY path, seq) = 1))"


@query(sql(f"SELECT * FROM {_PACK}"))
def pack_layout(spark, sf_dir):
    return dedup.pack_layout(chunked(spark, sf_dir))


@query(sql(f'SELECT digest, coalesce("offset", 0) AS "offset", coalesce(length, 0) AS length FROM (SELECT DISTINCT digest FROM cb) LEFT JOIN {_PACK} USING (digest)'))
def locate_chunk(spark, sf_dir):
    return dedup.locate(chunked(spark, sf_dir, "B"), dedup.pack_layout(chunked(spark, sf_dir)))


# Snapshots

_MANIFEST = f"""manifest AS (SELECT ab.snapshot_id, ab.path, {MODE} AS mode, CAST(octet_length(c) AS BIGINT) AS size, CAST({MTIME} AS BIGINT) AS mtime_unix, sha256(c) AS file_digest,
  coalesce(list(chunks.digest ORDER BY seq) FILTER (WHERE seq IS NOT NULL), []) AS chunk_digests
  FROM ab LEFT JOIN chunks USING (snapshot_id, path) GROUP BY ab.snapshot_id, ab.path, c)"""


def _manifest_sql(select: str) -> str:
    return f"WITH {_FILES}, {_spans()}, {_MANIFEST}\n{select}"


@query(_manifest_sql("SELECT snapshot_id, path, mode, size, mtime_unix, file_digest, array_to_string(chunk_digests, ' ') AS chunks FROM manifest"))
def manifest_build(spark, sf_dir):
    return manifests(spark, sf_dir).select("snapshot_id", "path", "mode", "size", "mtime_unix", "file_digest", F.array_join("chunk_digests", " ").alias("chunks"))


@query(_manifest_sql("SELECT snapshot_id, path, CAST(mode AS BIGINT) AS mode, size, mtime_unix, file_digest, array_to_string(chunk_digests, ' ') AS chunks FROM manifest"))
def manifest_scan(spark, sf_dir):
    """Manifests of both snapshots in their binary format, read back."""
    written = formats.write_manifests(manifests(spark, sf_dir))
    return formats.read_manifests(written).withColumn("chunks", F.array_join("chunk_digests", " ")).drop("chunk_digests")


@query(_manifest_sql(f"""SELECT count(*) FILTER (WHERE n = 0) = count(*) AS equal, count(*) FILTER (WHERE n > 0) AS only_left, count(*) FILTER (WHERE n < 0) AS only_right FROM (
  SELECT sum(CASE snapshot_id WHEN '{IDS[0]}' THEN 1 ELSE -1 END) AS n FROM manifest GROUP BY path, mode, size, mtime_unix, file_digest, chunk_digests)"""))
def manifest_equality(spark, sf_dir):
    """Whether the manifests of both snapshots are equal, and how many entries only one has."""
    rows = manifests(spark, sf_dir)
    sides = [rows.filter(F.col("snapshot_id") == i).drop("snapshot_id") for i in IDS]
    return snapshots.same_manifests(*sides)


@query(f"WITH {_FILES} SELECT lang, path, CAST(row_number() OVER (PARTITION BY lang ORDER BY path) AS INTEGER) AS place FROM (SELECT path, split_part(path, '/', 1) AS lang FROM a)")
def manifest_order(spark, sf_dir):
    rows = files(spark, sf_dir).select("path", F.substring_index("path", "/", 1).alias("lang"))
    before = running_total(rows, ["path"], F.lit(1), "before", ("lang",))
    return before.select("lang", "path", (F.col("before") + 1).cast("int").alias("place"))


@query(f"WITH {_FILES} SELECT snapshot_id, path, CAST(octet_length(c) AS BIGINT) AS size, sha256(c) AS digest FROM ab")
def restore(spark, sf_dir):
    both = _both(spark, sf_dir)
    rows = snapshots.restore(manifests(spark, sf_dir, both), stored(spark, sf_dir, both))
    return rows.select("snapshot_id", "path", F.octet_length("content").cast("long").alias("size"), C.sha256(F.col("content")).alias("digest"))


@query(f"WITH {_FILES} SELECT snapshot_id, path, CAST(octet_length(c) AS BIGINT) AS size, sha256(c) AS digest, true AS ok FROM ab")
def restore_check(spark, sf_dir):
    both = _both(spark, sf_dir)
    return snapshots.check_restored(snapshots.restore(manifests(spark, sf_dir, both), stored(spark, sf_dir, both)))


@query(f"WITH {_FILES} SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'extra' ELSE 'differs' END AS state FROM a FULL JOIN b ON a.path = b.path WHERE a.c IS DISTINCT FROM b.c")
def tree_compare(spark, sf_dir):
    return snapshots.compare_trees(files(spark, sf_dir, "A"), files(spark, sf_dir, "B"))


_STATUS = "CASE left(digest, 2) WHEN '00' THEN 'missing' WHEN '01' THEN 'corrupt' ELSE 'ok' END"


@query(sql(f"SELECT DISTINCT digest, {_STATUS} AS status FROM chunks"))
def verify_chunks(spark, sf_dir):
    both = _both(spark, sf_dir)
    return snapshots.chunk_status(manifests(spark, sf_dir, both), faulty(spark, sf_dir, both))


@query(sql(f"SELECT snapshot_id, path, seq, digest, {_STATUS} AS status FROM chunks WHERE {_STATUS} <> 'ok'"))
def verify_missing(spark, sf_dir):
    both = _both(spark, sf_dir)
    rows = manifests(spark, sf_dir, both)
    return snapshots.issues(rows, snapshots.chunk_status(rows, faulty(spark, sf_dir, both)))


@query(sql(f"""SELECT (SELECT count(DISTINCT snapshot_id) FROM ab) AS snapshots_checked, (SELECT count(*) FROM ab) AS files_checked, count(*) AS references_checked,
  count(DISTINCT CASE WHEN {_STATUS} = 'ok' THEN digest END) AS unique_chunks_verified, CAST(count_if({_STATUS} <> 'ok') AS BIGINT) AS issues FROM chunks"""))
def verify_summary(spark, sf_dir):
    both = _both(spark, sf_dir)
    rows = manifests(spark, sf_dir, both)
    return snapshots.verify_summary(rows, snapshots.chunk_status(rows, faulty(spark, sf_dir, both)))


@query(sql("SELECT digest, snapshot_id, path, seq FROM chunks QUALIFY row_number() OVER (PARTITION BY digest ORDER BY snapshot_id, path, seq) = 1"))
def first_reference(spark, sf_dir):
    return dedup.first_references(snapshots.references(manifests(spark, sf_dir)))


@query(f"WITH {_FILES} SELECT CAST(sum(octet_length(c)) AS BIGINT) AS logical_bytes, count(DISTINCT snapshot_id) AS snapshots FROM ab")
def logical_bytes(spark, sf_dir):
    both = [files(spark, sf_dir, s).select(F.lit(i).alias("snapshot_id"), F.octet_length("content").cast("long").alias("size")) for s, i in zip("AB", IDS, strict=True)]
    return both[0].unionByName(both[1]).agg(F.sum("size").alias("logical_bytes"), F.count_distinct("snapshot_id").alias("snapshots"))


@query(sql(f"""SELECT snapshots, logical_bytes, bytes AS physical_bytes, 100.0::DOUBLE * (1.0::DOUBLE - bytes::DOUBLE / logical_bytes) AS saved_percent, logical_bytes::DOUBLE / bytes AS factor, chunks AS unique_chunks, mean, median,
  printf('%.1f%% (%.2fx)', 100.0::DOUBLE * (1.0::DOUBLE - bytes::DOUBLE / logical_bytes), logical_bytes::DOUBLE / bytes) AS summary
  FROM (SELECT count(DISTINCT snapshot_id) AS snapshots, CAST(sum(octet_length(c)) AS BIGINT) AS logical_bytes FROM ab), (SELECT {_SIZES} FROM {_UNIQUE.format('chunks')})"""))
def stats_report(spark, sf_dir):
    sizes = [files(spark, sf_dir, s).select(F.lit(i).alias("snapshot_id"), F.octet_length("content").cast("long").alias("size")) for s, i in zip("AB", IDS, strict=True)]
    chunks = chunked(spark, sf_dir, "A").unionByName(chunked(spark, sf_dir, "B"))
    return dedup.stats_report(sizes[0].unionByName(sizes[1]), dedup.unique_chunks(chunks).select("digest", "length"))


# A repository from end to end


def _repository(spark, sf_dir) -> tuple[Repository, list[str]]:
    """A new repository with both snapshots, one a second, and their ids."""
    repo = Repository.create(spark, new_path(spark, "repository"), FIXED)
    return repo, [repo.backup(files(spark, sf_dir, s).drop("edit"), lambda k=k: 1_704_067_200 + k) for k, s in enumerate("AB")]


@query(ORACLE_SQL["stats_report"])
def repository_stats(spark, sf_dir):
    """Statistics after two backups, the second of which stores what the first lacks."""
    return _repository(spark, sf_dir)[0].stats()


@query(f"WITH {_FILES} SELECT snapshot_id, path, {MODE} AS mode, CAST({MTIME} AS BIGINT) AS mtime_unix, CAST(octet_length(c) AS BIGINT) AS size, sha256(c) AS digest FROM ab".replace(f"'{IDS[1]}'", "'20240101-000001'"))
def repository_restore(spark, sf_dir):
    """Both snapshots restored."""
    repo, ids = _repository(spark, sf_dir)
    rows = repo.restore_df(ids[0]).unionByName(repo.restore_df(ids[1]))
    return rows.select("snapshot_id", "path", "mode", "mtime_unix", F.octet_length("content").cast("long").alias("size"), C.sha256(F.col("content")).alias("digest"))


@query(sql("SELECT 2 AS snapshots_checked, (SELECT count(*) FROM ab) AS files_checked, count(*) AS references_checked, count(DISTINCT digest) AS unique_chunks_verified, CAST(0 AS BIGINT) AS issues FROM chunks").replace("SELECT 2 AS", "SELECT CAST(2 AS BIGINT) AS"))
def repository_verify(spark, sf_dir):
    """Verification of an intact repository."""
    return _repository(spark, sf_dir)[0].verify()[0]


@query(f"WITH {_FILES} SELECT path, {MODE & 0o7777} AS permissions, CAST({MTIME} AS BIGINT) AS mtime_unix, CAST(octet_length(c) AS BIGINT) AS size, sha256(c) AS digest FROM a")
def scan_tree(spark, sf_dir):
    """Snapshot A written as a tree of files, with modes and times, and read by the tree source."""
    root = new_path(spark, "tree").removeprefix("file:")
    filetree.write_tree(files(spark, sf_dir), root)
    rows = filetree.read_tree(spark, root)
    return rows.select("path", C.mode_bits(F.col("mode")).alias("permissions"), "mtime_unix", F.octet_length("content").cast("long").alias("size"), C.sha256(F.col("content")).alias("digest"))


# Comparisons

_COMPARE = """SELECT count(*) FILTER (WHERE o) AS old_chunks, count(*) FILTER (WHERE n) AS new_chunks, count(*) FILTER (WHERE o AND n) AS shared, count(*) FILTER (WHERE o AND NOT n) AS only_old, count(*) FILTER (WHERE n AND NOT o) AS only_new
FROM (SELECT digest, bool_or(snapshot_id = '{0}') AS o, bool_or(snapshot_id = '{1}') AS n FROM chunks GROUP BY digest)""".format(*IDS)


@query(sql(_COMPARE))
def identity_compare(spark, sf_dir):
    return dedup.compare(chunked(spark, sf_dir, "A"), chunked(spark, sf_dir, "B"))


@query(sql("SELECT digest FROM ca INTERSECT SELECT digest FROM cb"))
def identity_shared(spark, sf_dir):
    return dedup.shared(chunked(spark, sf_dir, "A"), chunked(spark, sf_dir, "B"))


@query(sql("SELECT digest FROM ca EXCEPT SELECT digest FROM cb"))
def identity_only_old(spark, sf_dir):
    return dedup.only_first(chunked(spark, sf_dir, "A"), chunked(spark, sf_dir, "B"))


@query(sql("SELECT digest FROM cb EXCEPT SELECT digest FROM ca"))
def identity_only_new(spark, sf_dir):
    return dedup.only_first(chunked(spark, sf_dir, "B"), chunked(spark, sf_dir, "A"))


@query(_cdc_sql(_COMPARE, table="ab"))
def identity_compare_cdc(spark, sf_dir):
    return dedup.compare(chunked(spark, sf_dir, "A", CDC), chunked(spark, sf_dir, "B", CDC))


@query(_strategy_sql())
def strategy_compare(spark, sf_dir):
    """New chunks and bytes of snapshot B by strategy and size: one pass over each snapshot's bytes."""
    old, new = (chunking.chunks_by_strategy(files(spark, sf_dir, s), STRATEGIES) for s in "AB")
    return dedup.summary_by_strategy(old, new)


_RESYNC = """SELECT new_chunks, count(*) AS files, min(edit) AS least_edit, max(edit) AS largest_edit FROM (
  SELECT b.path, b.edit, count(DISTINCT cb.digest) FILTER (WHERE ca.digest IS NULL) AS new_chunks FROM b JOIN cb ON b.path = cb.path LEFT JOIN (SELECT DISTINCT path, digest FROM ca) ca ON ca.path = cb.path AND ca.digest = cb.digest GROUP BY b.path, b.edit)
GROUP BY new_chunks"""


@query(sql(_RESYNC))
def resync_distribution(spark, sf_dir):
    """How many files have how many chunks that their former version lacks."""
    return _resync(spark, sf_dir, FIXED)


def _resync(spark, sf_dir, config):
    old, new = recipes(spark, sf_dir, "A", config), recipes(spark, sf_dir, "B", config)
    return resync.distribution(old.select("path", "chunks"), new.select("path", "edit", "chunks"))


@query(_cdc_sql(_RESYNC, table="ab"))
def resync_distribution_cdc(spark, sf_dir):
    return _resync(spark, sf_dir, CDC)


TRIALS = 50


@query(f"""WITH {_FILES}, trials AS (SELECT path, t, c, (CAST('0x' || substr(md5(path || '#' || t), 1, 12) AS BIGINT) % (octet_length(c) + 1)) AS place FROM a, range({TRIALS}) r(t) WHERE octet_length(c) > 0),
edited AS (SELECT path, t, c[1:place] || '\\xAB'::BLOB || c[place + 1:octet_length(c)] AS d FROM trials),
parts AS (SELECT path, t, d, unnest(range(0, (octet_length(d) + {FIXED.avg_size - 1}) // {FIXED.avg_size})) AS i FROM edited),
new AS (SELECT DISTINCT path, t, sha256(d[CAST(i * {FIXED.avg_size} + 1 AS BIGINT):CAST((i + 1) * {FIXED.avg_size} AS BIGINT)]) AS digest FROM parts),
ap AS (SELECT path, c, unnest(range(0, (octet_length(c) + {FIXED.avg_size - 1}) // {FIXED.avg_size})) AS i FROM a),
old AS (SELECT DISTINCT path, sha256(c[CAST(i * {FIXED.avg_size} + 1 AS BIGINT):CAST((i + 1) * {FIXED.avg_size} AS BIGINT)]) AS digest FROM ap),
counts AS (SELECT path, t, count(*) FILTER (WHERE old.digest IS NULL) AS new_chunks FROM new LEFT JOIN old USING (path, digest) GROUP BY path, t)
SELECT path, CAST(min(new_chunks) AS BIGINT) AS least, CAST(max(new_chunks) AS BIGINT) AS largest, avg(new_chunks) AS mean, count(*) AS trials FROM counts GROUP BY path""")
def offset_sweep(spark, sf_dir):
    """Of each file, how many new chunks one byte more makes at TRIALS places: least, largest and mean."""
    return resync.sweep(files(spark, sf_dir), {"fixed": FIXED}, TRIALS).drop("strategy")


@query()
def offset_sweep_cdc(spark, sf_dir):
    """The sweep by content-defined chunks, with how many files have which largest count."""
    rows = resync.sweep(files(spark, sf_dir), {"cdc": CDC}, TRIALS)
    return rows.groupBy("largest").agg(F.count(F.lit(1)).alias("files"), F.min("least").alias("least"), F.avg("mean").alias("mean"))


# Logs and configuration


def _records(spark, sf_dir):
    """Records of one log for each supplier key modulo 16: k, digest, offset, length."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 16).alias("log"), "o_orderkey")
    k = F.row_number().over(Window.partitionBy("log").orderBy("o_orderkey")) - 1
    return rows.select("log", k.alias("k"), C.sha256((F.col("o_orderkey") % 97).cast("string").cast("binary")).alias("digest"), (F.col("o_orderkey") * 1000).alias("offset"), (F.col("o_orderkey") % 65536).alias("length"))


_RECORDS = """r AS (SELECT o_orderkey % 16 AS log, CAST(row_number() OVER (PARTITION BY o_orderkey % 16 ORDER BY o_orderkey) - 1 AS INTEGER) AS k,
  sha256(CAST(o_orderkey % 97 AS VARCHAR)) AS digest, o_orderkey * 1000 AS "offset", CAST(o_orderkey % 65536 AS BIGINT) AS length FROM orders)"""


def _le_sql(value: str, size: int) -> str:
    """Hex of the little-endian bytes of a number."""
    return " || ".join(f"lpad(lower(hex(({value} >> {8 * k}) & 255)), 2, '0')" for k in range(size))


@query(f"""WITH {_RECORDS}, {_crc_table_sql()}, bodies AS (SELECT log, k, '01' || digest || {_le_sql('CAST("offset" AS BIGINT)', 8)} || {_le_sql("length", 4)} AS body FROM r)
SELECT log, k, {_le_sql("CAST(45 AS BIGINT)", 4)} || body || {_le_sql("CAST(sum_ AS BIGINT)", 4)} AS frame FROM (SELECT log, k, body, {_crc_sql("unhex(body)")} AS sum_ FROM bodies, crc)""")
def wal_encode(spark, sf_dir):
    rows = _records(spark, sf_dir)
    frames = formats.wal_frames(rows.withColumn("k", F.struct("log", "k")))
    return frames.select("k.log", "k.k", F.lower(F.hex("frame")).alias("frame"))


def _logs(spark, sf_dir):
    """A log's frames joined; every log whose key is odd ends with a torn frame."""
    frames = formats.wal_frames(_records(spark, sf_dir).withColumn("k", F.struct("log", "k"))).select("k.log", F.col("k.k").alias("seq"), F.col("frame").alias("data"))
    whole = frames.groupBy("log").agg(C.concat_ordered(F.collect_list(F.struct("seq", "data"))).alias("content"))
    torn = F.lit(bytes.fromhex("2D00000001DEADBEEF00"))
    return whole.withColumn("content", F.when(F.col("log") % 2 == 1, F.concat("content", torn)).otherwise(F.col("content")))


@query(f"""WITH {_RECORDS} SELECT log, digest, CAST(max_by("offset", k) AS BIGINT) AS "offset", max_by(length, k) AS length FROM r GROUP BY log, digest""")
def wal_replay(spark, sf_dir):
    index = formats.wal_index(formats.wal_records(_logs(spark, sf_dir)))
    return index.select("log", "digest", F.col("offset").cast("long").alias("offset"), "length")


@query("""SELECT p_partkey, concat_ws(', ', CASE WHEN p_partkey % 7 = 0 THEN 'strategy' END, CASE WHEN a <> 256 THEN 'min_size' END, CASE WHEN b <> 1024 THEN 'avg_size' END, CASE WHEN c <> 8192 THEN 'max_size' END) AS mismatches
FROM (SELECT p_partkey, 256 * (1 + p_partkey % 2) AS a, 1024 * (1 + p_partkey % 3) AS b, 8192 * (1 + p_partkey % 5) AS c FROM part)""")
def config_mismatch(spark, sf_dir):
    """What ``Repository.require`` would say of each of many configurations."""
    key = F.col("p_partkey")
    strategy = F.when(key % 7 == 0, F.lit("fixed")).otherwise(F.lit("cdc"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", strategy.alias("strategy"), (256 * (1 + key % 2)).alias("min_size"), (1024 * (1 + key % 3)).alias("avg_size"), (8192 * (1 + key % 5)).alias("max_size"))
    return rows.select("p_partkey", F.concat_ws(", ", mismatches(CDC)).alias("mismatches"))
