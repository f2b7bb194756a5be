"""Command line: init, backup, restore, verify, list, stats and bench, and the tools chunk-stats, chunk-identity and generate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from siltstone import analysis
from siltstone.operators.chunking import ChunkConfig
from siltstone.repository import Repository, RepositoryError
from siltstone.sources.filetree import read_errors, read_tree


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siltstone")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name in ("init", "backup", "restore", "verify", "list", "stats", "bench"):
        verb = verbs.add_parser(name)
        if name in ("backup", "bench"):
            verb.add_argument("source")
            verb.add_argument("--threads", type=int, help="partitions of the input")
            verb.add_argument("--avg-chunk-kb", type=int)
            verb.add_argument("--fixed-chunking", action="store_true")
        if name == "restore":
            verb.add_argument("snapshot")
            verb.add_argument("target")
        verb.add_argument(*(("repo",) if name == "init" else ("--repo",)), **({} if name == "init" else {"required": True}))
    for name in ("chunk-stats", "chunk-identity", "generate"):
        verb = verbs.add_parser(name)
        verb.add_argument("file")
        verb.add_argument("size", type=int, nargs="?", default=8, help="average chunk in KiB, or MiB to generate")
    args = parser.parse_args(argv)
    tools = {"chunk-stats": analysis.report_sizes, "chunk-identity": analysis.report_identity, "generate": analysis.generate}
    if args.verb in tools:
        try:
            if args.size <= 0:
                raise ValueError("the size must be positive")
            tools[args.verb](args.file, args.size)
        except (OSError, ValueError) as e:
            print(f"error: {e}", file=sys.stderr)
            return 1
        return 0
    spark = spark or SparkSession.builder.appName("siltstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.verb == "init":
            Repository.create(spark, args.repo)
            print(f"repository at {args.repo}")
        elif args.verb in ("backup", "bench"):
            if args.avg_chunk_kb is not None and args.avg_chunk_kb <= 0:
                raise RepositoryError("--avg-chunk-kb must be positive")
            for row in read_errors(spark, args.source).toLocalIterator():
                print(f"skipped {row['path']}: {row['reason']}", file=sys.stderr)
            config = ChunkConfig.of_kib(args.avg_chunk_kb or 8, args.fixed_chunking) if args.avg_chunk_kb is not None or args.fixed_chunking else None
            repo, files = Repository.create(spark, args.repo, config), read_tree(spark, args.source)
            files = files.repartition(args.threads) if args.threads else files
            if args.verb == "backup":
                snapshot = repo.backup(files)
                print(f"snapshot {snapshot}: {repo.manifests(snapshot).count()} files, {repo.index().count()} unique chunks in all")
            else:
                print(" ".join(f"{k}={v}" for k, v in repo.bench(files).items()))
        elif args.verb == "restore":
            print(f"{Repository(spark, args.repo).restore(args.snapshot, args.target)} files restored")
        elif args.verb == "verify":
            summary, issues = Repository(spark, args.repo).verify()
            for row in issues.toLocalIterator():
                print(f"{row['snapshot_id']} {row['path']}: chunk {row['digest']} is {row['status']}")
            row = summary.first()
            print(" ".join(f"{k}={v}" for k, v in row.asDict().items()))
            return int(row["issues"] > 0)
        elif args.verb == "list":
            for row in Repository(spark, args.repo).list_snapshots().toLocalIterator():
                print(row["snapshot_id"], row["file_count"])
        else:
            print("\n".join(f"{k}: {v}" for k, v in Repository(spark, args.repo).stats().first().asDict().items()))
    except (RepositoryError, FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
