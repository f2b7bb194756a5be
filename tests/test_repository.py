"""The repository under interruption, damage and replay, its command line, and the tools."""

import os
import random
import re
import tracemalloc

import pytest
from pyspark.sql import functions as F
from test_engine import F1, scalar_cuts, tree

from siltstone import analysis
from siltstone.cli import main
from siltstone.functions.columns import concat_ordered
from siltstone.operators import chunking, resync, snapshots
from siltstone.operators.chunking import ChunkConfig
from siltstone.operators.ordering import running_total
from siltstone.repository import Repository, RepositoryError
from siltstone.sources import filetree, formats
from siltstone.storage import materialize
from siltstone.streaming.ingest import store

KIB = ChunkConfig.of_kib(1)


def files_of(spark, contents):
    return spark.createDataFrame([(p, 0o644, 0, bytearray(c)) for p, c in contents.items()], "path string, mode int, mtime_unix long, content binary")


def restored(repo, snapshot):
    return {r["path"]: bytes(r["content"]) for r in repo.restore_df(snapshot).collect()}


def test_interrupted_backups(spark, tmp_path, monkeypatch):
    """A backup that ends at any step leaves no snapshot; the next one is whole and uses the chunks that are there."""
    repo = Repository.create(spark, str(tmp_path / "r"), KIB)
    before, after = {"a": F1[:9000], "b": F1[9000:12000]}, {"a": F1[:9000] + b"more", "c": F1[20000:60000], "d": b""}
    first = repo.backup(files_of(spark, before), lambda: 0)
    calls = []

    def stop(*_, **__):
        calls.append(1)
        raise RuntimeError("power cut")

    whole = Repository._store
    for k, (owner, name, patched) in enumerate(((chunking, "chunks_of", stop), (Repository, "_store", lambda self, *a: (whole(self, *a), stop())), (snapshots, "manifest_of", stop), (F, "count", stop))):
        with monkeypatch.context() as m:
            m.setattr(owner, name, patched)
            with pytest.raises(RuntimeError, match="power cut"):
                repo.backup(files_of(spark, after), lambda k=k: 10 + k)
        again = Repository(spark, repo.path)
        assert [r["snapshot_id"] for r in again.list_snapshots().collect()] == [first]
        assert again.verify()[0].first()["issues"] == 0 and restored(again, first) == before
    assert len(calls) == 4
    stored = repo.chunks().count()
    last = repo.backup(files_of(spark, after), lambda: 20)
    assert repo.chunks().count() == stored  # an interrupted one had stored them all
    assert restored(repo, last) == after and restored(repo, first) == before
    assert repo.list_snapshots().count() == 2 and not os.listdir(f"{repo.path}/staging")


def test_ids_have_one_writer(spark, tmp_path):
    repo = Repository.create(spark, str(tmp_path / "r"), KIB)
    ticks = iter((5, 5, 5, 6))
    assert repo._reserve(lambda: next(ticks), lambda _: None) == ("19700101-000005", 5)
    assert repo._reserve(lambda: next(ticks), lambda _: None) == ("19700101-000006", 6)  # 5 is another writer's, though it has no snapshot yet
    with pytest.raises(RepositoryError, match="no free"):
        repo._reserve(lambda: 5, lambda _: None)
    rows = files_of(spark, {"a": b"1"})
    with pytest.raises(RepositoryError, match="once only: a"):
        repo.backup(rows.union(rows), lambda: 9)


def test_damaged_repository(spark, tmp_path):
    path = str(tmp_path / "r")
    repo = Repository.create(spark, path, KIB)
    contents = {"a": F1[:40000], "b": F1[:20000], "c": F1[50000:90000], "empty": b""}
    snapshot = repo.backup(files_of(spark, contents), lambda: 0)
    rows = repo.chunks().collect()
    r = random.Random(1)
    r.shuffle(rows)
    lost, bad = {x["digest"] for x in rows[:5]}, {x["digest"] for x in rows[5:9]}
    again = [(x["digest"], x["length"], x["data"] + b"!" if x["digest"] in bad else x["data"], x["prefix"]) for x in rows if x["digest"] not in lost]
    again += [(x["digest"], x["length"], x["data"] + b"?", x["prefix"]) for x in rows[9:12]]  # a bad copy beside a good one harms nothing
    spark.createDataFrame(again, "digest string, length int, data binary, prefix string").write.parquet(str(tmp_path / "new"))
    os.rename(f"{path}/chunks", f"{path}/chunks.old")
    spark.read.parquet(str(tmp_path / "new")).write.partitionBy("prefix").parquet(f"{path}/chunks")
    refs = [(p, k, chunking.SHA256.plain(c[o : o + n])) for p, c in contents.items() for k, (o, n, _) in enumerate(chunking.cdc_cuts(c, KIB))]
    want = sorted((snapshot, p, k, d, "missing" if d in lost else "corrupt") for p, k, d in refs if d in lost | bad)
    summary, issues = repo.verify()
    assert sorted(map(tuple, issues.collect())) == want and len(want) >= 9
    row = summary.first()
    assert (row["files_checked"], row["references_checked"], row["issues"], row["unique_chunks_verified"]) == (4, len(refs), len(want), len({d for *_, d in refs} - lost - bad))
    with pytest.raises(RepositoryError, match="can't be restored"):
        repo.restore(snapshot, str(tmp_path / "out"))
    assert not os.path.exists(str(tmp_path / "out"))
    assert main(["verify", "--repo", path], spark) == 1


def test_command_line(spark, tmp_path, capsys):
    src, path, out = (str(tmp_path / x) for x in ("src", "repo", "out"))
    os.makedirs(src)
    tree(src)
    assert main(["init", path], spark) == 0
    assert main(["backup", src, "--repo", path, "--threads", "2"], spark) == 0
    said = capsys.readouterr()
    snapshot = re.search(r"snapshot (\d{8}-\d{6}): 5 files, \d+ unique chunks", said.out)[1]
    assert "skipped link: link to a directory" in said.err
    assert main(["list", "--repo", path], spark) == main(["stats", "--repo", path], spark) == main(["verify", "--repo", path], spark) == 0
    said = capsys.readouterr().out
    assert f"{snapshot} 5" in said and "logical_bytes: 81213" in said and "issues=0" in said
    assert main(["restore", snapshot, out, "--repo", path], spark) == 0 and open(f"{out}/small.txt").read() == "hello world\n"
    assert main(["backup", src, "--repo", path, "--avg-chunk-kb", "4"], spark) == main(["backup", src, "--repo", path, "--avg-chunk-kb", "-1"], spark) == 1
    assert main(["restore", "20000101-000000", out, "--repo", path], spark) == main(["list", "--repo", str(tmp_path / "none")], spark) == main(["backup", str(tmp_path / "none"), "--repo", path], spark) == 1
    said = capsys.readouterr().err
    assert "avg_size" in said and "positive" in said and "no snapshot" in said and "no repository" in said
    assert main(["bench", src, "--repo", str(tmp_path / "b"), "--fixed-chunking", "--avg-chunk-kb", "1"], spark) == 0
    assert all(f"{x}_seconds=" in (said := capsys.readouterr().out if x == "chunk" else said) for x in ("chunk", "store", "manifest", "commit"))
    with pytest.raises(SystemExit):
        main(["unknown"], spark)


def test_tools(tmp_path, capsys):
    path = str(tmp_path / "f")
    assert main(["generate", path, "1"]) == main(["chunk-stats", path, "1"]) == main(["chunk-identity", path, "8"]) == 0
    said = capsys.readouterr().out
    assert len(open(path, "rb").read()) == 1 << 20 == sum(n for _, n, _ in chunking.cdc_cuts(analysis.read_file(path), KIB))
    assert "fixed: chunks=1024 bytes=1048576 mean=1024.00 median=1024" in said
    assert main(["chunk-stats", str(tmp_path / "none")]) == main(["chunk-stats", path, "0"]) == 1
    assert analysis.random_bytes(100, 3) == analysis.random_bytes(200, 3)[:100] != analysis.random_bytes(100, 4)
    assert analysis.size_distribution(b"", KIB)["median"] == 0


def test_resync_over_many_places():
    """One byte anywhere makes one new content-defined chunk (seldom two), and of fixed ones all behind it."""
    by_content, fixed = analysis.resync(F1, ChunkConfig()), analysis.resync(F1, ChunkConfig.of_kib(8, True))
    assert by_content["least"] == 1 and by_content["largest"] <= 2 and by_content["mean"] < 1.2
    places = [resync.place("", t, len(F1)) for t in range(50)]
    assert sorted(k for k, n in fixed["histogram"].items() for _ in range(n)) == sorted((len(F1) + 1 + 8191) // 8192 - p // 8192 for p in places)
    assert analysis.identity(F1, analysis.edits(F1)["1 byte in the middle"], ChunkConfig())["shared"] == 114


def test_sweep_of_files(spark):
    contents = {"a": F1[:5000], "b": b"x", "empty": b""}
    got = {(r["path"], r["strategy"]): (r["least"], r["largest"], r["mean"]) for r in resync.sweep(files_of(spark, contents), {"cdc": KIB}, 7).collect()}
    want = {}
    for p, c in contents.items():
        digests = lambda raw: {raw[o : o + n] for o, n, _ in scalar_cuts(raw, KIB)}
        counts = [len(digests(c[: resync.place(p, t, len(c))] + b"\xab" + c[resync.place(p, t, len(c)) :]) - digests(c)) for t in range(7)]
        if c:
            want[p, "cdc"] = (min(counts), max(counts), sum(counts) / 7)
    assert got == want


def test_kernel_memory():
    data = F1 * 16
    tracemalloc.start()
    spans = chunking.cdc_cuts(data, ChunkConfig())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for _, n, _ in spans) == len(data) and peak < 16 << 20  # windows, whatever the file's size
    assert chunking.cdc_cuts(F1, KIB) == scalar_cuts(F1, KIB)


@pytest.mark.parametrize("window", [64, 1000])
def test_windows_of_the_kernel(monkeypatch, window):
    monkeypatch.setattr(chunking, "WINDOW", window)
    for sizes in ((1, 4, 64), (64, 256, 1024), (256, 1024, 8192)):
        assert chunking.cdc_cuts(F1[:20000], ChunkConfig(*sizes)) == scalar_cuts(F1[:20000], ChunkConfig(*sizes))


def test_bytes_in_order(spark):
    r = random.Random(2)
    parts = [bytes(r.randrange(256) for _ in range(r.randrange(50))) for _ in range(300)]
    rows = spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(parts)], "seq int, data binary").orderBy(F.rand(1))
    assert bytes(rows.agg(concat_ordered(F.collect_list(F.struct("seq", "data")))).first()[0]) == b"".join(parts)


def test_running_totals(spark):
    r = random.Random(3)
    rows = [(r.choice(["x", "y", None]), f"same/prefix/{k:05d}", r.randrange(10)) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, path string, n int").repartition(7)
    got = {x["path"]: x["total"] for x in running_total(df, ["path"], F.col("n"), "total", ("g",)).collect()}
    sums, want = {}, {}
    for g, p, n in sorted(rows, key=lambda x: x[1]):
        want[p] = sums.get(g, 0)
        sums[g] = want[p] + n
    assert got == want
    assert running_total(df.limit(0), ["path"], F.col("n"), "total").count() == 0


def test_own_chunkers_and_hashers(spark):
    chunking.register_chunker("lines", lambda data, _: [(m.start(), len(m[0]), True) for m in re.finditer(rb"[^\n]*\n|[^\n]+", data)])
    try:
        crc = chunking.Hasher("crc32", lambda c: F.lower(F.hex(F.crc32(c))), lambda raw: f"{__import__('zlib').crc32(raw):x}")
        rows = files_of(spark, {"a": b"one\ntwo\nthree", "b": b""})
        for config, n in ((ChunkConfig(strategy="lines"), 3), (ChunkConfig.of_kib(1, True), 1)):
            got = {r["path"]: r for r in chunking.recipes(rows, config, hasher=crc).collect()}
            assert len(got["a"]["chunks"]) == n and got["b"]["chunks"] == [] and got["a"]["file_digest"] == crc.plain(b"one\ntwo\nthree")
            assert [c["digest"] for c in got["a"]["chunks"]][-1] == crc.plain(b"three" if n == 3 else b"one\ntwo\nthree")
    finally:
        del chunking.CHUNKERS["lines"]
    with pytest.raises(ValueError, match="unknown strategy"):
        ChunkConfig(strategy="lines")


def test_record_types(spark):
    rows = spark.createDataFrame([(k, "ab" * 32, k, 1) for k in range(3)], "k int, digest string, offset long, length long")
    log = b"".join(bytes(r["frame"]) for t in (formats.WAL_TYPE, 7) for r in formats.wal_frames(rows, t).orderBy("k").collect())
    logs = spark.createDataFrame([("x", bytearray(log))], "log string, content binary")
    assert formats.wal_records(logs).count() == 3 and formats.wal_records(logs, types=(formats.WAL_TYPE, 7)).count() == 6


def test_manifest_files(spark):
    rows = snapshots.build_manifest(files_of(spark, {"b": F1[:5000], "a": b"", "c/d": b"x"}), KIB).withColumn("snapshot_id", F.lit("20240101-000000"))
    back = formats.read_manifests(formats.write_manifests(rows))
    names = rows.columns
    assert tuple(snapshots.same_manifests(rows, back.select(*[F.col(c).cast(dict(rows.dtypes)[c]).alias(c) for c in names])).first()) == (True, 0, 0)
    other = rows.withColumn("chunk_digests", F.when(F.col("path") == "b", F.reverse("chunk_digests")).otherwise(F.col("chunk_digests")))
    assert tuple(snapshots.same_manifests(rows, other).first()) == (False, 1, 1)
    assert tuple(snapshots.same_manifests(rows.union(rows), rows).first()) == (False, 3, 0)
    assert tuple(snapshots.same_manifests(rows.limit(0), rows.limit(0)).first())[1:] == (0, 0)


def test_manifest_folder(spark, tmp_path):
    folder = str(tmp_path / "m")
    rows = snapshots.build_manifest(files_of(spark, {"b": F1[:5000], "a": b""}), KIB)
    both = rows.withColumn("snapshot_id", F.lit("20240101-000000")).unionByName(rows.withColumn("snapshot_id", F.lit("20240102-000000")))
    formats.save_manifests(both, folder)
    open(f"{folder}/notes.txt", "w").write("no manifest")
    assert sorted(os.listdir(folder))[:2] == ["20240101-000000.manifest", "20240102-000000.manifest"]
    got = formats.load_manifests(spark, folder)
    assert sorted((r["snapshot_id"], r["path"], r["chunk_digests"]) for r in got.collect()) == sorted((r["snapshot_id"], r["path"], r["chunk_digests"]) for r in both.collect())
    open(f"{folder}/x.manifest", "w").write("damaged")
    with pytest.raises(Exception, match="cut short"):
        formats.load_manifests(spark, folder).count()


def test_replayed_batches(spark, tmp_path):
    repo = Repository.create(spark, str(tmp_path / "r"), KIB)
    batch = materialize(files_of(spark, {"a": F1[:3000]}), "batch")
    for number in (0, 0, 1):
        store(batch, number, repo, "stream")
    assert sorted(r["label"] for r in repo.list_snapshots().collect()) == ["stream#0", "stream#1"]


def test_trees_of_many_files(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    for k in range(70):
        os.makedirs(f"{root}/d{k}/deep")
        open(f"{root}/d{k}/deep/f", "w").write(str(k))
    for k in range(600):
        open(f"{root}/n{k}", "w").close()
    os.mkfifo(f"{root}/pipe")
    os.symlink(f"{root}/nowhere", f"{root}/broken")
    files, errors = filetree.walk(root)
    got = [r["path"] for r in filetree.read_tree(spark, root).select("path").collect()]
    assert sorted(got) == sorted(files) and len(got) == 670
    assert sorted(map(tuple, filetree.read_errors(spark, root).collect())) == errors == [("broken", "not a regular file"), ("pipe", "not a regular file")]
    reader = filetree._Reader(root, False)
    parts = reader.partitions()
    assert len(parts) > 70
    os.remove(f"{root}/n5")
    with monkeypatch.context() as m:  # gone between listing and reading
        m.setattr(filetree, "_entries", lambda r, f: ([], [("n5", ""), ("n6", "")]))
        assert sum(len(b) for b in reader.read(filetree._Part(root, False))) == 1
    with monkeypatch.context() as m:
        m.setattr(os, "fstat", lambda _: (_ for _ in ()).throw(OSError()))
        assert filetree._stat(0) == (0, 0)
    assert filetree.read_tree(spark, str(tmp_path / "t/d0/deep")).count() == 1
