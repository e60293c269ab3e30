"""Versioned tables on plain files: atomic replacement, idempotent appends, compaction and clean-up.

Layout of a table: ``v=<n>/`` directories with Parquet files and ``_versions/<n>.json`` manifests. A manifest lists the
directories that make up version n. Writing a manifest is the commit; readers use the highest one. File access goes
through Hadoop's FileSystem, so local paths and object stores work alike.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


KNOWN_BATCHES = 1000  # batch ids a manifest remembers: a batch is repeated right after it failed, not a thousand batches later


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- files ---

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write_text(self, path, text: str, overwrite: bool) -> None:
        out = self._fs().create(path, overwrite)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read_text(self, path) -> str:
        stream = self._fs().open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _list(self, *parts: str) -> list:
        path = self._path(*parts)
        return list(self._fs().listStatus(path)) if self._fs().exists(path) else []

    # --- versions ---

    def versions(self, table: str) -> list[int]:
        names = [s.getPath().getName() for s in self._list(table, "_versions")]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def exists(self, table: str) -> bool:
        return bool(self.versions(table))

    def manifest(self, table: str, version: int | None = None) -> dict:
        known = self.versions(table)
        if not known:
            raise FileNotFoundError(f"no table {table} in {self.root}")
        return json.loads(self._read_text(self._path(table, "_versions", f"{version or known[-1]}.json")))

    def _commit(self, table: str, parts: list[str], batches: list[str]) -> int:
        version = (self.versions(table) or [0])[-1] + 1
        body = json.dumps({"version": version, "parts": parts, "batches": batches[-KNOWN_BATCHES:], "at": time.time()})
        # written aside, then renamed: a reader sees the whole manifest or none, and of two writers one fails
        aside = self._path(table, "_versions", f".{uuid.uuid4().hex}")
        self._write_text(aside, body, False)
        if not self._fs().rename(aside, self._path(table, "_versions", f"{version}.json")):
            self._fs().delete(aside, False)
            raise RuntimeError(f"version {version} of {table} was committed by another writer")
        return version

    def read(self, table: str, version: int | None = None) -> DataFrame:
        parts = self.manifest(table, version)["parts"]
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{table}/{p}" for p in parts])

    def _part(self, table: str, df: DataFrame, name: str | None = None) -> str:
        part = f"v={name or uuid.uuid4().hex[:12]}"
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/{part}")
        return part

    def overwrite(self, table: str, df: DataFrame) -> int:
        """Replace all rows and the schema. ``df`` may read the table itself: old files stay until ``vacuum``."""
        return self._commit(table, [self._part(table, df)], [])

    def append(self, table: str, df: DataFrame, batch_id: str | None = None) -> int:
        """Add rows; a batch id that was already added changes nothing."""
        old = self.manifest(table) if self.exists(table) else {"parts": [], "batches": []}
        if batch_id is not None and batch_id in old["batches"]:
            return old["version"]
        part = self._part(table, df, None if batch_id is None else f"batch-{batch_id}")
        return self._commit(table, [*old["parts"], part], [*old["batches"], *([batch_id] if batch_id is not None else [])])

    def merge_insert_only(self, table: str, updates: DataFrame, keys: list[str], batch_id: str | None = None, within: str | None = None) -> int:
        """Add the rows whose key is new. Keys compare null-safely; of equal keys in ``updates`` the caller keeps one.

        With ``within``, one of the keys, only the rows between the smallest and the largest of its values in ``updates``
        are read from the table (the filter reaches the scan), as for batches of a narrow span of time.
        """
        if not self.exists(table):
            return self.append(table, updates, batch_id)
        held = self.read(table)
        if within is not None:
            span = updates.agg(F.min(within).alias("a"), F.max(within).alias("b")).first()
            inside = F.col(within).isNull() if span["a"] is None else F.col(within).isNull() | F.col(within).between(F.lit(span["a"]), F.lit(span["b"]))
            held = held.where(inside)
        known = held.select(*[F.col(k).alias(f"k{i}_") for i, k in enumerate(keys)])
        same: Column = F.lit(True)
        for i, k in enumerate(keys):
            same = same & updates[k].eqNullSafe(known[f"k{i}_"])
        return self.append(table, updates.join(known, same, "left_anti"), batch_id)

    def publish(self, frame: str, tables: list[str]) -> dict[str, int]:
        """One consistent frame: the current versions of several tables under one name."""
        pinned = {t: self.versions(t)[-1] for t in tables}
        self._write_text(self._path("_frames", f"{frame}.json"), json.dumps(pinned), True)
        return pinned

    def frame(self, frame: str) -> dict[str, DataFrame]:
        pinned = json.loads(self._read_text(self._path("_frames", f"{frame}.json")))
        return {t: self.read(t, v) for t, v in pinned.items()}

    def view(self, name: str, table: str, version: int | None = None) -> None:
        """A name for a version of a table in the session's SQL; no data is copied."""
        self.read(table, version).createOrReplaceTempView(name)

    # --- maintenance ---

    def detail(self, table: str) -> dict:
        """Version, parts and number of data files."""
        m = self.manifest(table)
        files = [s for p in m["parts"] for s in self._list(table, p) if s.getPath().getName().endswith(".parquet")]
        return {"version": m["version"], "parts": len(m["parts"]), "files": len(files), "bytes": sum(s.getLen() for s in files)}

    def compact(self, table: str, files: int, order: list[str] = ()) -> int:
        """Rewrite the current rows as one part of ``files`` files, each sorted by ``order``."""
        rows = self.read(table).repartition(files)
        rows = rows.sortWithinPartitions(*order) if order else rows
        return self._commit(table, [self._part(table, rows)], self.manifest(table)["batches"])

    def retain(self, table: str, keep: Column) -> int:
        """Delete the rows for which ``keep`` does not hold."""
        return self._commit(table, [self._part(table, self.read(table).where(keep))], self.manifest(table)["batches"])

    def vacuum(self, table: str, older_than_s: float = 168 * 3600) -> int:
        """Delete versions older than that, except the current and framed ones, and parts no version uses."""
        known = self.versions(table)
        pinned = {json.loads(self._read_text(s.getPath())).get(table) for s in self._list("_frames")}
        current, limit = known[-1], time.time() - older_than_s
        manifests = {v: self.manifest(table, v) for v in known}
        gone = [v for v in known if v != current and v not in pinned and manifests[v]["at"] < limit]
        used = {p for v, m in manifests.items() if v not in gone for p in m["parts"]}
        for v in gone:
            self._fs().delete(self._path(table, "_versions", f"{v}.json"), False)
        removed = 0
        for s in self._list(table):
            name = s.getPath().getName()
            if name.startswith("v=") and name not in used and s.getModificationTime() / 1000 < limit:
                removed += bool(self._fs().delete(s.getPath(), True))
        return removed

    def drop(self, table: str) -> None:
        self._fs().delete(self._path(table), True)
