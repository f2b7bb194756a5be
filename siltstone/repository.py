"""A repository on Parquet: chunks, manifests and snapshots, committed in this order.

A snapshot exists once its row in ``snapshots`` does, which is written last; what an interrupted
backup leaves is never read as a snapshot, and its chunks are used by the next one. Two writers may
store the same chunk; readers take one of each digest, and one whose bytes are right. A snapshot's id
is reserved by a file that only one writer can create, so two writers never share one.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.columns import cut
from siltstone.functions.config import FIELDS, mismatches
from siltstone.functions.gear import GEAR_SEED
from siltstone.operators import chunking, dedup, snapshots
from siltstone.operators.chunking import ChunkConfig
from siltstone.storage import delete

CHUNKS = "digest string, length int, data binary, prefix string"
MANIFESTS = "path string, mode int, size long, mtime_unix long, file_digest string, chunk_digests array<string>, snapshot_id string"
SNAPSHOTS = "snapshot_id string, created_unix long, file_count long, label string"
_TRIES = 5
_FEW_PATHS = 100_000  # paths that may be broadcast


class RepositoryError(ValueError):
    """The repository can't do what is asked."""


class Repository:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        if not self._exists("repo.json"):
            raise RepositoryError(f"no repository at {path}")

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: ChunkConfig | None = None) -> Repository:
        """Open a repository, made first where there is none; a config that differs from its own is refused."""
        repo = cls.__new__(cls)
        repo.spark, repo.path = spark, path.rstrip("/")
        if not repo._exists("repo.json"):
            config = config or ChunkConfig()
            meta = {"min_size": config.min_size, "avg_size": config.avg_size, "max_size": config.max_size, "gear_seed": f"{GEAR_SEED:016x}", "strategy": config.strategy}
            repo._write("repo.json", json.dumps(meta))
        elif config:
            repo.require(config)
        return repo

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, fs = self._hadoop(name)
        return fs.exists(path)

    def _write(self, name: str, text: str) -> None:
        path, fs = self._hadoop(name)
        part, _ = self._hadoop(f"{name}.tmp")
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(part, path):
            raise RepositoryError(f"{name} can't be written")

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def config(self) -> ChunkConfig:
        meta = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/repo.json").collect()))
        return ChunkConfig(meta["min_size"], meta["avg_size"], meta["max_size"], meta["strategy"])

    def require(self, config: ChunkConfig) -> None:
        """Raise unless the repository's own configuration is this one."""
        own = self.config()
        asked = self.spark.range(1).select(*[F.lit(getattr(config, name)).alias(name) for name in FIELDS])
        wrong = asked.select(mismatches(own)).first()[0]
        if wrong:
            raise RepositoryError("the repository's chunking differs: " + ", ".join(f"{k} is {getattr(own, k)}, not {getattr(config, k)}" for k in wrong))

    def list_snapshots(self) -> DataFrame:
        return self._table("snapshots", SNAPSHOTS).orderBy("snapshot_id")

    def has_snapshot(self, snapshot_id: str) -> bool:
        return not self._table("snapshots", SNAPSHOTS).filter(F.col("snapshot_id") == snapshot_id).isEmpty()

    def has_label(self, label: str) -> bool:
        """Whether a committed snapshot was made under this label."""
        return not self._table("snapshots", SNAPSHOTS).filter(F.col("label") == label).isEmpty()

    def chunks(self) -> DataFrame:
        return self._table("chunks", CHUNKS)

    def index(self) -> DataFrame:
        """digest and length: the bytes aren't read."""
        return self.chunks().select("digest", "length").groupBy("digest").agg(F.min("length").alias("length"))

    def manifests(self, snapshot_id: str | None = None) -> DataFrame:
        """Manifests of committed snapshots; one snapshot's is a pruned read."""
        rows = self._table("manifests", MANIFESTS)
        if snapshot_id is not None:
            if not self.has_snapshot(snapshot_id):
                raise RepositoryError(f"no snapshot {snapshot_id}")
            return rows.filter(F.col("snapshot_id") == snapshot_id)
        return rows.join(self._table("snapshots", SNAPSHOTS).select("snapshot_id"), "snapshot_id", "left_semi")

    def _reserve(self, clock: Callable[[], float], sleep: Callable[[float], None]) -> tuple[str, int]:
        """A snapshot id that no other writer has or gets, and its time."""
        for k in range(_TRIES):
            if k:
                sleep(1.0)
            created = int(clock())
            snapshot = time.strftime("%Y%m%d-%H%M%S", time.gmtime(created))
            path, fs = self._hadoop(f"ids/{snapshot}")
            if not self.has_snapshot(snapshot) and fs.createNewFile(path):
                return snapshot, created
        raise RepositoryError("no free snapshot id")

    def backup(self, files: DataFrame, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep, label: str | None = None) -> str:
        """Store the chunks that aren't there yet, then the manifest, then the snapshot's row; returns its id.

        Files are chunked and hashed in one pass, whose result (no bytes) is written first. Bytes are read again only
        of files that have new chunks. Two rows of one path are refused. ``phases`` has the seconds of each step.
        """
        config = self.config()
        snapshot, created = self._reserve(clock, sleep)
        work = f"{self.path}/staging/{snapshot}"
        self.phases: dict[str, float] = {}
        began = time.perf_counter()

        def lap(name: str) -> None:
            nonlocal began
            now = time.perf_counter()
            self.phases[name], began = now - began, now

        try:
            chunking.recipes(files, config, keep=("mode", "mtime_unix")).write.parquet(f"{work}/recipes")
            found = self.spark.read.parquet(f"{work}/recipes")
            twice = snapshots.repeated_paths(found).head(3)
            if twice:
                raise RepositoryError("a path may occur once only: " + ", ".join(r["path"] for r in twice))
            lap("chunk")
            self._store(files, found, work)
            lap("store")
            manifest = snapshots.manifest_of(found).withColumn("snapshot_id", F.lit(snapshot))
            manifest.sortWithinPartitions("path").write.mode("append").partitionBy("snapshot_id").parquet(f"{self.path}/manifests")
            lap("manifest")
            row = found.agg(F.count(F.lit(1)).alias("file_count")).select(F.lit(snapshot).alias("snapshot_id"), F.lit(created).cast("long").alias("created_unix"), "file_count", F.lit(label).cast("string").alias("label"))
            row.coalesce(1).write.mode("append").parquet(f"{self.path}/snapshots")
            lap("commit")
        finally:
            delete(self.spark, work)
        return snapshot

    def _store(self, files: DataFrame, found: DataFrame, work: str) -> None:
        """Append the chunks that the index lacks; only files that have such are read and moved."""
        first = chunking.chunks_of(found).groupBy("digest").agg(F.min(F.struct("path", "offset", "length")).alias("f"))
        new = first.join(self.index(), "digest", "left_anti")
        new.groupBy("f.path").agg(F.collect_list(F.struct("digest", "f.offset", "f.length")).alias("wanted")).write.parquet(f"{work}/wanted")
        wanted = self.spark.read.parquet(f"{work}/wanted")
        rows = files.select("path", "content")
        if wanted.count() <= _FEW_PATHS:
            rows = rows.join(F.broadcast(wanted.select("path")), "path", "left_semi")
        rows = rows.join(wanted, "path").select("content", F.explode("wanted").alias("w"))
        data = rows.select("w.digest", "w.length", cut(F.col("content"), F.col("w.offset"), F.col("w.length")).alias("data"), F.substring("w.digest", 1, 1).alias("prefix"))
        data.write.mode("append").partitionBy("prefix").parquet(f"{self.path}/chunks")

    def _stored(self) -> DataFrame:
        return self.chunks().select("digest", "data")

    def restore_df(self, snapshot_id: str) -> DataFrame:
        return snapshots.restore(self.manifests(snapshot_id), snapshots.good_chunks(self._stored()))

    def restore(self, snapshot_id: str, target: str) -> int:
        """Write a snapshot's files; nothing is written unless every file has the manifest's digest."""
        from siltstone.sources.filetree import write_tree

        rows = self.restore_df(snapshot_id)
        bad = snapshots.check_restored(rows).filter(~F.col("ok")).select("path").head(3)
        if bad:
            raise RepositoryError(f"files can't be restored, such as {bad[0]['path']}")
        write_tree(rows, target)
        return rows.count()

    def verify(self) -> tuple[DataFrame, DataFrame]:
        """One row of counts, and a row for each bad reference."""
        manifests, status = self.manifests(), snapshots.chunk_status(self.manifests(), self._stored())
        return snapshots.verify_summary(manifests, status), snapshots.issues(manifests, status)

    def stats(self) -> DataFrame:
        return dedup.stats_report(self.manifests(), self.index())

    def collect_orphans(self) -> DataFrame:
        """digest of chunks that no committed snapshot refers to."""
        return self.index().join(snapshots.references(self.manifests()).select("digest"), "digest", "left_anti").select("digest")

    def bench(self, files: DataFrame) -> dict:
        """Back up once and report bytes, seconds in all and of each phase, and MiB a second (0 in no time)."""
        began = time.perf_counter()
        snapshot = self.backup(files)
        seconds = time.perf_counter() - began
        size = self.manifests(snapshot).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        phases = {f"{name}_seconds": round(s, 3) for name, s in self.phases.items()}
        return {"snapshot_id": snapshot, "logical_bytes": size, "seconds": seconds, **phases, "mib_per_second": size / 2**20 / seconds if seconds else 0.0}
