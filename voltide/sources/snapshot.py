"""Versioned snapshots: manifests decide which appended files count.

A sync writes new rows to a run folder, checks gates on old and new rows
together, and commits by writing the next manifest. Until then nothing that
readers see has changed; a failed run leaves an audit entry and no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from voltide.functions.canonical import canonical_json
from voltide.sources.tables import Files, insert_only_merge


class SnapshotStore:
    """One snapshot in a folder: tables/, manifests/ and failures/."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, T.StructType], keys: dict[str, Sequence[str]]):
        self.spark, self.folder, self.schemas, self.keys = spark, folder, schemas, keys
        self.files = Files(spark, folder)

    def manifest(self) -> dict:
        names = [n for n in self.files.names(f"{self.folder}/manifests") if n.endswith(".json")]
        if not names:
            return {"revision": 0, "status": "OPEN", "runs": [], "counts": {}}
        return json.loads(self.files.read_text(f"{self.folder}/manifests/{names[-1]}"))

    def _commit(self, manifest: dict) -> dict:
        """A revision is written once; of two writers one fails here."""
        self.files.write_text(f"{self.folder}/manifests/{manifest['revision']:08d}.json", canonical_json(manifest))
        return manifest

    def read(self, name: str) -> DataFrame:
        paths = [f"{self.folder}/tables/{run}/{name}" for run in self.manifest()["runs"]]
        paths = [p for p in paths if self.files.exists(p)]
        empty = self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*paths) if paths else empty

    def sync(self, incoming: dict[str, DataFrame], gates: Callable[[dict[str, DataFrame]], object] | None = None) -> dict:
        """Append what is new; returns the manifest, unchanged if nothing is."""
        before = self.manifest()
        if before["status"] == "FROZEN":
            raise ValueError("a frozen snapshot takes no rows")
        run = uuid.uuid4().hex[:12]
        counts, staged = dict(before["counts"]), {}
        try:
            for name, df in incoming.items():
                new, _ = insert_only_merge(self.read(name), df.select(*self.schemas[name].names), self.keys[name])
                path = f"{self.folder}/tables/{run}/{name}"
                new.write.parquet(path)
                staged[name] = self.spark.read.schema(self.schemas[name]).parquet(path)
                counts[name] = counts.get(name, 0) + staged[name].count()
            if counts == before["counts"] or all(counts[n] == before["counts"].get(n, 0) for n in counts):
                self.files.delete(f"{self.folder}/tables/{run}")
                return before
            if gates:
                gates({n: self.read(n).unionByName(staged[n]) if n in staged else self.read(n) for n in self.schemas})
            return self._commit({"revision": before["revision"] + 1, "status": "OPEN", "runs": [*before["runs"], run], "counts": counts})
        except Exception as e:
            self.files.delete(f"{self.folder}/tables/{run}")
            self.files.write_text(f"{self.folder}/failures/{run}.json", canonical_json({"run": run, "error": str(e)[:2000], "base_revision": before["revision"]}))
            raise

    def freeze(self) -> dict:
        now = self.manifest()
        if now["status"] == "FROZEN":
            return now
        return self._commit(now | {"revision": now["revision"] + 1, "status": "FROZEN"})

    def failures(self) -> list[dict]:
        at = f"{self.folder}/failures"
        return [json.loads(self.files.read_text(f"{at}/{n}")) for n in self.files.names(at) if n.endswith(".json")]
