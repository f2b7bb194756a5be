"""Chunk boundaries against golden values, formats, the repository and its faults."""

import hashlib
import os
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from siltstone.functions.gear import gear_table, mt19937_64
from siltstone.operators import chunking, dedup
from siltstone.operators.chunking import ChunkConfig, cdc_cuts
from siltstone.repository import Repository, RepositoryError
from siltstone.sources import formats
from siltstone.sources.filetree import read_tree, walk

F1 = b"".join(hashlib.sha256(i.to_bytes(8, "little")).digest() for i in range(32768))


def recipe(data, config):
    return hashlib.sha256(b"".join(hashlib.sha256(data[o : o + n]).digest() for o, n, _ in cdc_cuts(data, config))).hexdigest()


def scalar_cuts(data, c):
    gear, bits = [int(g) for g in gear_table()], c.avg_size.bit_length() - 1
    strict, loose, at, out = (1 << bits + 2) - 1, (1 << (bits - 2 if bits > 2 else 1)) - 1, 0, []
    while at < len(data):
        left = len(data) - at
        if left <= c.min_size:
            out.append((at, left, False))
            break
        window, h, n, hit = min(left, c.max_size), 0, 0, False
        for n in range(c.min_size, window):
            h = (2 * h + gear[data[at + n]]) % 2**64
            if h & (strict if n < c.avg_size else loose) == 0:
                hit = True
                break
        out.append((at, n + 1 if hit else window, hit))
        at += out[-1][1]
    return out


def test_generator_and_gear():
    assert mt19937_64(5489, 10000)[-1] == 9981545732273789042
    assert [int(g) for g in gear_table()[:2]] == [0x07DA71A624DE0E7F, 0xF52ADBE5B8A6DC18]


@pytest.mark.parametrize(("config", "n", "first", "digest"), [
    (ChunkConfig(), 115, [(0, 9827), (9827, 4579), (14406, 8801)], "4283db017aa2d56b4099a759a00afba29355256de3a4b4787ce44caa4a743e30"),
    (ChunkConfig.of_kib(1), 904, [(0, 1304), (1304, 1575), (2879, 1715)], "c5f6fe042f46632a800ff25e6b0dc8e9b4553af74e9e85a32f1b9248bde1e991"),
])
def test_golden_cuts(config, n, first, digest):
    cuts = cdc_cuts(F1, config)
    assert len(cuts) == n and [c[:2] for c in cuts[:3]] == first and recipe(F1, config) == digest


def test_small_and_flat_inputs():
    c = ChunkConfig()
    assert cdc_cuts(b"", c) == [] and cdc_cuts(b"abc", c) == [(0, 3, False)]
    assert cdc_cuts(F1[:12000], c) == [(0, 9827, True), (9827, 2173, False)]
    assert [x[1] for x in cdc_cuts(bytes(200_000), c)] == [65536, 65536, 65536, 3392]


@pytest.mark.parametrize("sizes", [(1, 4, 64), (16, 17, 40), (2, 3, 9), (64, 256, 1024)])
def test_cuts_equal_a_scalar_loop(sizes):
    for n in [*range(0, 130), 5000]:
        assert cdc_cuts(F1[n : 2 * n], ChunkConfig(*sizes)) == scalar_cuts(F1[n : 2 * n], ChunkConfig(*sizes))


def test_one_byte_insert_moves_one_chunk():
    digests = lambda d: {hashlib.sha256(d[o : o + n]).digest() for o, n, _ in cdc_cuts(d, ChunkConfig())}
    for at in (0, len(F1) // 2):
        assert len(digests(F1) & digests(F1[:at] + b"\xab" + F1[at:])) == 114


def test_configs():
    for bad in ((0, 0, 0), (4, 4, 8), (2, 8, 8)):
        with pytest.raises(ValueError, match="min < avg < max"):
            ChunkConfig(*bad)
    with pytest.raises(ValueError, match="positive"):
        ChunkConfig(0, 0, 0, "fixed")


def test_upper_median_and_empty(spark):
    rows = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "length int")
    assert dedup.size_stats(rows).first()["median"] == 3
    assert tuple(dedup.size_stats(rows.filter("false")).first()) == (0, 0, 0.0, 0, 0, 0)


def test_udtf(spark):
    chunking.register_udtf(spark, "cuts_of", ChunkConfig.of_kib(1))
    spark.createDataFrame([(bytearray(F1[:20000]),)], "c binary").createOrReplaceTempView("f1")
    assert spark.sql("SELECT sum(length) FROM f1, LATERAL cuts_of(c)").first()[0] == 20000


def test_manifest_codec():
    digest = "ab" * 32
    entries = [{"path": p, "mode": 0o100644, "size": k, "mtime_unix": k, "file_digest": digest, "chunk_digests": [digest] * k} for k, p in enumerate(["src/main.cpp", "README.md", "empty.txt"])]
    raw = formats.encode_manifest("20260907-143022", 1799500222, entries)
    got = formats.decode_manifest(raw)
    assert [f["path"] for f in got["files"]] == ["README.md", "empty.txt", "src/main.cpp"] and got["snapshot_id"] == "20260907-143022"
    for bad in (b"NOTAMF00" + raw[8:], raw[:49], raw + b"x"):
        with pytest.raises(formats.FormatError):
            formats.decode_manifest(bad)
    with pytest.raises(formats.FormatError):
        formats.encode_manifest("x" * 16, 0, [])


def test_meta_codec():
    raw = formats.encode_meta(1, 2, 3, 2**63 + 1)
    assert len(raw) == 32 and formats.decode_meta(raw)["gear_seed"] == 2**63 + 1
    with pytest.raises(formats.FormatError):
        formats.decode_meta(raw[:-1])


def test_torn_log(spark):
    rows = spark.createDataFrame([(k, hashlib.sha256(bytes([k])).hexdigest(), k * 1000, k + 1) for k in range(55)], "k int, digest string, offset long, length long")
    log = b"".join(bytes(r["frame"]) for r in formats.wal_frames(rows).orderBy("k").collect())
    assert len(log) == 2915
    torn = spark.createDataFrame([("a", bytearray(log + bytes.fromhex("2D00000001DEADBEEF00"))), ("b", bytearray(log[:100] + b"\xff" + log[101:]))], "log string, content binary")
    assert {r["log"]: r["count"] for r in formats.wal_records(torn).groupBy("log").count().collect()} == {"a": 55, "b": 1}


def test_long_log(spark):
    """Reading a log takes time in proportion to its frames; a bad frame beyond the first slice ends it."""
    n = 200_000
    body = [struct.pack("<B32sQI", 1, bytes([k % 251]) * 32, 2**63 + k, k) for k in range(n)]
    frames = [struct.pack("<I", 45) + b + struct.pack("<I", zlib.crc32(b)) for b in body]
    log, bad = b"".join(frames), 150_000 * 53 + 20
    rows = [("whole", bytearray(log)), ("bad", bytearray(log[:bad] + bytes([log[bad] ^ 1]) + log[bad + 1 :])), ("torn", bytearray(log[:-1])), ("empty", bytearray()), ("null", None)]
    logs = spark.createDataFrame(rows, "log string, content binary")
    began = time.perf_counter()
    got = {r["log"]: tuple(r)[1:] for r in formats.wal_records(logs).groupBy("log").agg(F.count("k"), F.max("k"), F.max("offset"), F.sum("length")).collect()}
    assert time.perf_counter() - began < 60
    assert got == {name: (m, m - 1, 2**63 + m - 1, m * (m - 1) // 2) for name, m in (("whole", n), ("bad", 150_000), ("torn", n - 1))}
    last = {r["digest"]: (r["offset"], r["length"]) for r in formats.wal_index(formats.wal_records(logs.filter("log = 'bad'"))).collect()}
    assert last == {f"{d:02x}" * 32: (2**63 + k, k) for d, k in ((k % 251, k) for k in range(150_000))}


def tree(root):
    os.makedirs(f"{root}/sub/deep")
    for name, data, mode in (("small.txt", b"hello world\n", 0o600), (".hidden", b"h", 0o644), ("_under", F1[:30000], 0o644), ("sub/deep/nested.bin", F1[:51200], 0o644), ("sub/empty.txt", b"", 0o640)):
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
        os.chmod(f"{root}/{name}", mode)
        os.utime(f"{root}/{name}", (1_600_000_000, 1_600_000_000))
    os.symlink("sub", f"{root}/link")


def test_repository(spark, tmp_path):
    src, repo_dir, out = str(tmp_path / "src"), str(tmp_path / "repo"), str(tmp_path / "out")
    os.makedirs(src)
    tree(src)
    assert walk(src)[1] == [("link", "link to a directory")]
    with pytest.raises(RepositoryError):
        Repository(spark, repo_dir)
    repo = Repository.create(spark, repo_dir, ChunkConfig.of_kib(1))
    with pytest.raises(RepositoryError, match="avg_size"):
        Repository.create(spark, repo_dir, ChunkConfig.of_kib(2))
    files = read_tree(spark, src)
    ticks = iter((0, 0, 1))
    first, second = repo.backup(files, lambda: next(ticks)), repo.backup(files, lambda: next(ticks), lambda _: None)
    assert (first, second) == ("19700101-000000", "19700101-000001")
    stored = repo.chunks().count()
    assert stored == repo.index().count()  # the second one stored nothing
    assert repo.restore(first, out) == 5
    for path in walk(src)[0]:
        a, b = os.stat(f"{src}/{path}"), os.stat(f"{out}/{path}")
        assert (a.st_mode, int(a.st_mtime)) == (b.st_mode, int(b.st_mtime)) and open(f"{src}/{path}", "rb").read() == open(f"{out}/{path}", "rb").read()
    summary, issues = repo.verify()
    row = summary.first()
    assert (row["snapshots_checked"], row["files_checked"], row["issues"], issues.count()) == (2, 10, 0, 0)
    stats = repo.stats().first()
    assert stats["logical_bytes"] == 2 * (12 + 1 + 30000 + 51200) and stats["factor"] > 1.9
    assert repo.collect_orphans().isEmpty()


def test_restore_refuses_paths_outside(spark, tmp_path):
    from siltstone.sources.filetree import write_tree

    rows = spark.createDataFrame([("../x", 0o644, 0, bytearray(b""))], "path string, mode int, mtime_unix long, content binary")
    with pytest.raises(Exception, match="leaves the target"):
        write_tree(rows, str(tmp_path / "t"))


def test_streaming_ingest(spark, tmp_path):
    from siltstone.streaming.ingest import ingest

    rows = spark.createDataFrame([(f"f{k}", 0o644, 0, bytearray(F1[: 1000 * k])) for k in range(4)], "path string, mode int, mtime_unix long, content binary")
    rows.write.parquet(str(tmp_path / "in"))
    repo = Repository.create(spark, str(tmp_path / "repo"), ChunkConfig.of_kib(1))
    ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), repo, str(tmp_path / "cp")).awaitTermination()
    assert repo.list_snapshots().first()["file_count"] == 4


def test_fixed_spans_ignore_empty(spark):
    rows = spark.createDataFrame([("a", bytearray(b"x" * 2500)), ("b", bytearray(b"")), ("c", None)], "path string, content binary")
    assert [r["length"] for r in chunking.fixed_spans(rows, 1024).orderBy("seq").collect()] == [1024, 1024, 452]
    assert chunking.cdc_spans(rows, ChunkConfig.of_kib(1)).filter(F.col("path") != "a").isEmpty()


def test_entry_points():
    import __spark_entry__

    assert {"chunk_stats", "cdc_spans", "restore_check"} <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
