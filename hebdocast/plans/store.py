"""Published stages of a folder: versions of data, and a manifest that says which one holds.

A stage is written to a version of its own and becomes the stage only when its manifest is renamed into place; until
then, and if a guard refuses it, readers see the former version. A manifest holds the fingerprint of what
the stage was made from, its observed metrics and sketches, and how its files are bucketed. The current and the former
version are kept. All files go through the session's file system, so any store that Spark writes to will do.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- files ---------------------------------------------------------------
    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def delete(self, path: str) -> None:
        p = self._path(path)
        self._fs(p).delete(p, True)

    def listed(self, path: str) -> list[str]:
        p = self._path(path)
        fs = self._fs(p)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def fingerprint(self, path: str) -> str:
        """Names, sizes and times of all files below a path."""
        p = self._path(path)
        found, seen = self._fs(p).listFiles(p, True), []
        while found.hasNext():
            s = found.next()
            seen.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
        return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()

    # -- stages --------------------------------------------------------------
    def staging(self, stage: str) -> str:
        """A new version's place."""
        return f"{self.folder}/{stage}/v-{uuid.uuid4().hex[:16]}"

    def manifest(self, stage: str) -> dict | None:
        """The manifest that holds: the last one in place."""
        names = [n for n in self.listed(f"{self.folder}/_manifest/{stage}") if n.endswith(".json")]
        if not names:
            return None
        text = self.spark.read.text(f"{self.folder}/_manifest/{stage}/{names[-1]}", wholetext=True).first()[0]
        return json.loads(text)

    def publish(self, stage: str, manifest: dict) -> None:
        """Make a version the stage; older ones than the former are deleted."""
        folder = f"{self.folder}/_manifest/{stage}"
        names = [n for n in self.listed(folder) if n.endswith(".json")]
        number = int(names[-1].split(".")[0]) + 1 if names else 1
        held, final = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{number:08d}.json")
        fs = self._fs(held)
        out = fs.create(held, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True), "utf-8"))
        out.close()
        if not fs.rename(held, final):
            raise OSError(f"manifest {final} is already there: another run has published {stage}")
        former = self.spark.read.text(f"{folder}/{names[-1]}", wholetext=True).first()[0] if names else "{}"
        kept = {manifest["path"], json.loads(former).get("path")}
        for n in names[:-1]:
            self.delete(f"{folder}/{n}")
        for v in self.listed(f"{self.folder}/{stage}"):
            if v.startswith("v-") and f"{self.folder}/{stage}/{v}" not in kept:
                self.delete(f"{self.folder}/{stage}/{v}")

    def write(self, df: DataFrame, path: str, buckets: int = 0, by: str = "ProductID", order: tuple[str, ...] = ()) -> dict:
        """Write a version; with ``buckets``, as files clustered by ``by`` and sorted, one a bucket. Returns its entry."""
        entry = {"path": path, "schema": df.schema.jsonValue(), "buckets": buckets, "by": by, "order": [by, *order]}
        if not buckets:
            df.write.parquet(path)
            return entry
        name = f"hebdocast_{uuid.uuid4().hex}"
        df.repartition(buckets, by).write.format("parquet").bucketBy(buckets, by).sortBy(by, *order).option("path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # external: the files stay
        return entry

    def read(self, stage_or_entry: str | dict) -> DataFrame:
        """A published stage, or a version by its entry. Bucketed files come as a table, so that plans by their key
        need no exchange."""
        from pyspark.sql import types as T
        entry = self.manifest(stage_or_entry) if isinstance(stage_or_entry, str) else stage_or_entry
        if entry is None:
            raise FileNotFoundError(f"{self.folder} has no published stage {stage_or_entry}")
        schema = T.StructType.fromJson(entry["schema"])
        if not entry["buckets"]:
            return self.spark.read.schema(schema).parquet(entry["path"])
        name = "hebdocast_" + entry["path"].rsplit("v-", 1)[-1]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{entry['by']}`) SORTED BY "
                       f"({', '.join(f'`{c}`' for c in entry['order'])}) INTO {entry['buckets']} BUCKETS LOCATION '{entry['path']}'")
        return self.spark.table(name)
