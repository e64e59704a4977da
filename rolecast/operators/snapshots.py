"""A keyed table as snapshots: immutable files, and a manifest per commit that names those that are live.

Rows are dealt to buckets by the hash of their keys. A commit reads the buckets that it touches, keeps of each key the newest row
by its time stamp (late rows lose, whenever they come), writes these buckets anew and then its manifest; a reader holds the
files of the manifest it has read, so commits and compaction never take anything from under it. ``vacuum`` does, when told to.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .maintain import latest


class SnapshotTable:
    """The table at ``path``; a commit number is that of its manifest, from 1 on."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], ts: str = "updated_at", buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.ts, self.buckets = spark, path.rstrip("/"), keys, ts, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of all commits whose manifests are still there, in order."""
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "buckets": how many, "live": {bucket: folder}, "schema", "batch": the last one taken} of a commit, the last unless given."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "buckets": self.buckets, "live": {}, "schema": None, "batch": -1}
        stream = self._fs.open(self._path(f"{self.path}/manifests/{version or known[-1]:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Under a name of its own first, so that a manifest is whole or not there; another writer's of the same number isn't overwritten."""
        final = self._path(f"{self.path}/manifests/{manifest['version']:012d}.json")
        draft = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another commit has number {manifest['version']}; read the table again and repeat this one")

    def _read(self, manifest: dict, buckets: set[str] | None = None) -> DataFrame | None:
        folders = [f"{self.path}/data/{at}" for b, at in manifest["live"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(*folders) if folders else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows as of a commit; None if there is none yet. Files of that commit are read even if others follow."""
        return self._read(self.manifest(version))

    def _bucketed(self, rows: DataFrame, buckets: int) -> DataFrame:
        return rows.withColumn("__bucket", F.pmod(F.xxhash64(*self.keys), F.lit(buckets)))

    def _write(self, rows: DataFrame, manifest: dict, buckets: int, keep: dict, batch: int) -> int:
        """Rows of whole buckets as files; the next manifest has them and the folders in ``keep``."""
        version = manifest["version"] + 1
        folder = f"{version:012d}-{uuid.uuid4().hex[:8]}"
        self._bucketed(rows, buckets).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{folder}")
        made = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/data/{folder}"))]
        live = keep | {n.split("=")[1]: f"{folder}/{n}" for n in made if n.startswith("__bucket=")}
        self._publish({"version": version, "buckets": buckets, "live": live, "schema": json.loads(rows.schema.json()), "batch": batch})
        return version

    def commit(self, updates: DataFrame, batch: int | None = None, tie: list | None = None) -> int | None:
        """Upserts: of each key the newest row stays, of equals the later commit's, within one that first by ``tie``. Returns the commit's number.

        A ``batch`` number that isn't above the last one has been taken already (a stream's repeat after a failure) and changes nothing; nor does a
        commit without rows. Columns new to the table are null in its old rows; columns that updates lack are null in theirs.
        """
        now = self.manifest()
        if batch is not None and batch <= now["batch"]:
            return None
        new = latest(updates, self.keys, self.ts, tie)
        touched = {str(r[0]) for r in self._bucketed(new, now["buckets"]).select("__bucket").distinct().collect()}  # at most as many as buckets
        if not touched:
            return None
        old = self._read(now, touched)
        rows = new
        if old is not None:
            both = new.withColumn("__old", F.lit(0)).unionByName(old.withColumn("__old", F.lit(1)), allowMissingColumns=True)
            rows = latest(both, self.keys, self.ts, [F.col("__old")]).drop("__old")
            rows = rows.select(*old.columns, *[c for c in rows.columns if c not in old.columns])
        keep = {b: at for b, at in now["live"].items() if b not in touched}
        return self._write(rows, now, now["buckets"], keep, now["batch"] if batch is None else batch)

    def compact(self, buckets: int | None = None) -> int | None:
        """All rows in files of one commit, dealt to another number of buckets if given; older commits stay readable."""
        now = self.manifest()
        rows = self._read(now)
        return None if rows is None else self._write(rows, now, buckets or now["buckets"], {}, now["batch"])

    def vacuum(self, keep: int = 2) -> int:
        """Removes manifests but the last ``keep`` and the folders that none of these name; only when no reader holds older ones. Returns how many folders."""
        known = self.versions()
        live = {at.split("/")[0] for v in known[-keep:] for at in self.manifest(v)["live"].values()}
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifests/{v:012d}.json"), False)
        gone = [s.getPath() for s in self._fs.listStatus(self._path(f"{self.path}/data")) if s.getPath().getName() not in live] if known else []
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)
