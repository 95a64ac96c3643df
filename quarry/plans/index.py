"""Incremental index of a source tree.

A project is a folder of versions; each holds the chunk table and the file snapshot it was built from. A refresh reads
the newest version, rewrites what changed into the next, and publishes it by writing its marker last, so a reader
never sees half a version and no plan overwrites what it reads. One writer per project.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.chunkers import chunked
from quarry.functions.embedding import HashingProvider, Provider, embed_query, embedder
from quarry.functions.text import content_hash, embedding_text, point_id
from quarry.operators import duplicates, search, snapshots
from quarry.scratch import staged
from quarry.sources.tree import manifest, project_id, project_root

MARKER = "_READY"
HEADER = ["file_path", "language", "node_name", "node_type", "package_name", "imports", "signature", "receiver", "doc", "callees", "param_types", "return_types", "has_error_return", "content"]


@dataclass
class Report:
    added: int = 0
    modified: int = 0
    deleted: int = 0
    unchanged: int = 0
    failed: int = 0
    version: int = 0


class Index:
    """The index of one project below `store`."""

    def __init__(
        self, spark: SparkSession, root: str, store: str, provider: Callable[[], Provider] = HashingProvider, model: str = "hashing-64", source: Callable[[], DataFrame] | None = None
    ):
        """store is a folder on any file system Spark can write; source gives the manifest, by default of the tree at root."""
        self.spark, self.root, self.provider, self.model = spark, project_root(root), provider, model
        self.source = source or (lambda: manifest(spark, self.root))
        self.folder = f"{store.rstrip('/')}/{project_id(root)}"

    def _file(self, path: str):
        """Spark's file system for a path, and the path."""
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found

    def version(self) -> int:
        """The newest whole version, 0 for none."""
        files, folder = self._file(self.folder)
        if not files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return max((int(n[1:]) for n in names if n[:1] == "v" and files.exists(self._file(self._path(int(n[1:]), MARKER))[1])), default=0)

    def _path(self, version: int, table: str) -> str:
        return f"{self.folder}/v{version}/{table}"

    def _marker(self, version: int) -> dict:
        files, path = self._file(self._path(version, MARKER))
        stream = files.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _width(self) -> int:
        return len(embed_query("width", self.provider()))

    def chunks(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(self._path(v, "chunks")) if v else None

    def files(self) -> DataFrame:
        v = self.version()
        return self.spark.read.parquet(self._path(v, "files")) if v else self.spark.createDataFrame([], "file_path string, file_hash string")

    def refresh(self) -> Report:
        """Bring the index up to date: parse and embed new and changed files, drop the rows of deleted ones.

        Files that cannot be read or parsed keep their old rows and state, so the next refresh tries them again.
        """
        v = self.version()
        if v:
            built, width = self._marker(v), self._width()
            if (built["model"], built.get("width", width)) != (self.model, width):
                raise ValueError(f"the index was built with {built}, not {self.model} of width {width}; clear it first")
        now = staged(self.source(), "manifest")
        old = self.files()
        readable = now.where("error is null")
        broken = now.where("error is not null").select("file_path")
        todo = staged(snapshots.changed(old, readable.select("file_path", "language", "file_hash", "content")), "changed")
        parsed = staged(chunked(todo), "parsed")
        failed = staged(parsed.where("error is not null").select("file_path").distinct().unionByName(broken), "failed")
        status = {r[0]: r[1] for r in snapshots.diff(old, now.select("file_path", F.coalesce("file_hash", F.lit("")).alias("file_hash"))).groupBy("status").count().collect()}
        report = Report(**{k: status.get(k, 0) for k in ("added", "modified", "deleted", "unchanged")}, failed=failed.count(), version=v)
        gone = snapshots.deleted(old, now)
        if v and not (report.added or report.modified or report.deleted):
            return report
        done = todo.select("file_path", "file_hash").join(failed, "file_path", "left_anti")
        rows = self._finished(parsed.where("error is null").join(failed, "file_path", "left_anti"))
        if v:
            replaced = gone.select("file_path").unionByName(done.select("file_path"))
            rows = snapshots.without_keys(self.chunks(), replaced).unionByName(rows)
            done = snapshots.without_keys(old, replaced).unionByName(done)
        self._publish(v + 1, rows, done)
        report.version = v + 1
        return report

    def _finished(self, parsed: DataFrame) -> DataFrame:
        rows = parsed.drop("error").withColumn("code_hash", content_hash(F.col("content")))
        rows = rows.withColumn("point_id", point_id(F.col("code_hash")))
        text = embedding_text({c: F.col(c) for c in HEADER})
        return rows.withColumn("embedding", embedder(self.provider)(text))

    def _publish(self, version: int, chunks: DataFrame, files: DataFrame) -> None:
        for table, df in (("chunks", chunks), ("files", files)):
            df.write.mode("overwrite").parquet(self._path(version, table))
        files, path = self._file(self._path(version, MARKER))
        stream = files.create(path, True)
        try:
            stream.write(bytearray(json.dumps({"model": self.model, "width": self._width()}).encode()))
        finally:
            stream.close()

    def delete_files(self, paths: list[str]) -> int:
        """Drop the rows of the named files; gives the new version."""
        v = self.version()
        if not v:
            return 0
        gone = self.spark.createDataFrame([(p,) for p in paths], "file_path string")
        self._publish(v + 1, snapshots.without_keys(self.chunks(), gone), snapshots.without_keys(self.files(), gone))
        return v + 1

    def clear(self) -> None:
        """Remove the index; no harm if there is none."""
        files, folder = self._file(self.folder)
        files.delete(folder, True)

    def count(self) -> int:
        rows = self.chunks()
        return rows.count() if rows is not None else 0

    def search(self, query: str, k: int = search.DEFAULT_K) -> DataFrame:
        """The k best hits, one per file first; files that are gone are left out."""
        rows = self.chunks()
        if rows is None or k < 1:
            return self.spark.createDataFrame([], "file_path string, start_line int, end_line int, content string, score double")
        return search.search(rows, embed_query(query, self.provider()), k, self.source(), self.root)

    def duplicates(self, threshold: float, keep: Column | None = None) -> DataFrame | None:
        rows = self.chunks()
        return duplicates.find_duplicates(rows, threshold, keep) if rows is not None else None
