"""A keyed log of packs: appended in pieces, read last-wins, compacted while others read.

A pack is a folder of Parquet files below `data`. What counts is the newest manifest below `manifests`: a JSON text with
the packs, each with its sequence number and, if it came from a stream, its batch. A manifest is written under another
name and committed by a rename to the next number, which fails where someone else was first; then the change is made
again on theirs. So a writer that dies leaves a folder that no manifest names, a reader keeps the packs of the manifest
that it began with, and a pack is only removed by `vacuum`, once no manifest that is kept names it.

Paths go through Spark's own file systems; nothing but manifests passes through the driver.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Times that a commit is tried on a manifest of someone else's.
ATTEMPTS = 20
SEQUENCE, DELETED = "_sequence", "_deleted"


class Conflict(RuntimeError):
    """Others committed first, again and again."""


class Store:
    """The few file operations that a log needs, by Hadoop's file system of the path."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, name: str, text: str) -> bool:
        """Whether the text is now at a name that was free."""
        folder = name.rsplit("/", 1)[0]
        aside = f"{folder}/.{uuid.uuid4().hex}"
        self.fs.mkdirs(self._path(folder))
        stream = self.fs.create(self._path(aside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.exists(self._path(name)) and self.fs.rename(self._path(aside), self._path(name)):
            return True
        self.fs.delete(self._path(aside), False)
        return False

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


@dataclass(frozen=True)
class Pack:
    name: str
    sequence: int
    batch: str | None = None


class Log:
    """A log at a folder, of rows with a key."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], schema: StructType) -> None:
        self.spark, self.key, self.schema = spark, key, schema
        self.store = Store(spark, root)

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.store.names("manifests") if n.endswith(".json") and n[0] != ".")

    def packs(self, version: int | None = None) -> list[Pack]:
        """The packs of a version, the newest by default."""
        versions = self._versions()
        if not versions:
            return []
        return [Pack(**p) for p in json.loads(self.store.text(f"manifests/{versions[-1] if version is None else version:012d}.json"))]

    def _changed(self, change) -> int:
        """The version in which change(packs) is committed; None from it commits nothing."""
        for _ in range(ATTEMPTS):
            versions = self._versions()
            version = versions[-1] if versions else 0
            packs = change(self.packs(version) if versions else [])
            if packs is None:
                return version
            body = json.dumps([{"name": p.name, "sequence": p.sequence, "batch": p.batch} for p in packs])
            if self.store.commit(f"manifests/{version + 1:012d}.json", body):
                return version + 1
        raise Conflict(f"{ATTEMPTS} commits to {self.store.root} were overtaken")

    def append(self, rows: DataFrame, *, deletes: bool = False, batch: str | None = None) -> int:
        """Adds rows of the schema, which win over all before; deletes: their keys go. Of rows of one key within a pack one
        wins, so hand in one a key. A batch that is there already is not added again."""
        there = lambda packs: batch is not None and any(batch in (p.batch or "").split(",") for p in packs)
        if there(self.packs()):
            return self._versions()[-1]
        name = uuid.uuid4().hex
        rows.select(*self.schema.fieldNames()).withColumn(DELETED, F.lit(deletes)).write.parquet(f"{self.store.root}/data/{name}")

        def add(packs: list[Pack]) -> list[Pack] | None:
            if there(packs):
                return None
            return [*packs, Pack(name, max((p.sequence for p in packs), default=0) + 1, batch)]

        return self._changed(add)

    def _rows(self, packs: list[Pack]) -> DataFrame:
        whole = StructType(list(self.schema.fields)).add(DELETED, "boolean")
        if not packs:
            return self.spark.createDataFrame([], StructType(list(whole.fields)).add(SEQUENCE, "long"))
        folders = [f"{self.store.root}/data/{p.name}" for p in packs]
        read = self.spark.read.schema(whole).option("recursiveFileLookup", True).parquet(*folders)
        number = F.create_map(*[x for p in packs for x in (F.lit(p.name), F.lit(p.sequence).cast("long"))])
        return read.withColumn(SEQUENCE, number[F.regexp_extract(F.input_file_name(), r"/data/([0-9a-f]{32})/", 1)])

    def _latest(self, packs: list[Pack]) -> DataFrame:
        """The newest row of each key; partial sums find it, so a key of many rows is no hot task."""
        rest = [c for c in (*self.schema.fieldNames(), DELETED, SEQUENCE) if c not in self.key]
        best = self._rows(packs).groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.col(SEQUENCE)).alias("_row"))
        return best.select(*self.key, *[F.col("_row")[c].alias(c) for c in rest])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows that the log stands for."""
        return self._latest(self.packs(version)).filter(~F.col(DELETED)).select(*self.schema.fieldNames())

    def compact(self) -> int:
        """Puts the packs there are into one of their newest rows. Packs that others add meanwhile stay after it. The
        batches that went into it stay known, so that none is added again."""
        before = self.packs()
        if len(before) < 2:
            versions = self._versions()
            return versions[-1] if versions else 0
        name = uuid.uuid4().hex
        # nothing older is left that a deletion would have to hide
        self._latest(before).filter(~F.col(DELETED)).select(*self.schema.fieldNames(), DELETED).write.parquet(f"{self.store.root}/data/{name}")
        gone = {p.name for p in before}
        batches = ",".join(sorted(b for p in before if p.batch for b in p.batch.split(",")))

        def replace(packs: list[Pack]) -> list[Pack] | None:
            # someone else has compacted some of these: theirs stands
            if not gone <= {p.name for p in packs}:
                return None
            return [Pack(name, max(p.sequence for p in before), batches or None), *(p for p in packs if p.name not in gone)]

        return self._changed(replace)

    def vacuum(self, keep: int = 2) -> int:
        """Removes packs that none of the newest `keep` manifests names, and older manifests; how many packs went. Packs
        that are being written count as such: run it while nobody appends."""
        versions = self._versions()
        kept = {p.name for v in versions[-keep:] for p in self.packs(v)}
        gone = [n for n in self.store.names("data") if n not in kept]
        for n in gone:
            self.store.remove(f"data/{n}")
        for v in versions[:-keep]:
            self.store.remove(f"manifests/{v:012d}.json")
        return len(gone)


def hits(records: DataFrame, files: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """records of files that are still what they were: the same key and identity (size, time); others are stale."""
    same: Column = F.col(f"r.{key}") == F.col(f"f.{key}")
    for c in identity:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}"))
    return records.alias("r").join(files.alias("f"), same, "left_semi")
