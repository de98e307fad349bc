"""A versioned table in hash partitions: rows are upserted, merged or appended, and readers stay on the version they opened.

    <path>/data/v=<version>-<unique>/part=<n>/*.parquet     what one commit wrote
    <path>/log/<version>                                    a manifest: of each partition the commits that hold it

A commit writes the partitions that its rows touch, and nothing else, into a folder of its
own, and then its manifest. Without the manifest nothing has changed: what a failed job left
is not read, and `vacuum` removes it. A manifest is made under its number only if there is none, so of
two writers who started from one version the second fails and may try again. A batch that
has a name (`batch`) is taken once, however often a failed job repeats it.

The manifest has one entry a partition. Keys are spread by hash, so a partition is never
one wallet's; choose their number so that a partition is some hundred megabytes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType


class Conflict(RuntimeError):
    """Another writer has committed since this one read its version."""


@dataclass(frozen=True)
class Version:
    """One state of the table: the commits that hold each partition, and the batches taken so far."""

    number: int
    parts: dict[int, tuple[str, ...]]
    batches: dict[str, int]


class Store:
    """A table at a path, with `keys` that identify a row (of an upserted table) or a group of rows."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], *, partitions: int = 64, within: list[str] | None = None) -> None:
        """within: the columns whose hash gives the partition (the keys, unless rows of several keys are to stay together)."""
        self.spark, self.path, self.keys, self.partitions = spark, path.rstrip("/"), keys, partitions
        self.schema = StructType.fromDDL(schema)
        self.within = within or keys
        clash = {"v", "part"} & {f.name.lower() for f in self.schema.fields}
        if clash:
            raise ValueError(f"columns of the store's own: {sorted(clash)}")

    # What is there

    def _fs(self, at: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _manifest(self, number: int) -> Version:
        fs, p = self._fs(f"{self.path}/log/{number:020d}")
        stream = fs.open(p)
        try:
            doc = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(number, {int(k): tuple(x) for k, x in doc["parts"].items()}, doc["batches"])

    def versions(self) -> list[int]:
        """Numbers of the manifests, newest first."""
        return sorted((int(n) for n in self._names("log") if n.isdigit()), reverse=True)

    def version(self, number: int | None = None) -> Version:
        """The newest version, or an older one by its number; an empty table has version 0."""
        there = self.versions()
        if number and number not in there:
            raise LookupError(f"no version {number} of {self.path}")
        return self._manifest(number or there[0]) if there and number != 0 else Version(0, {}, {})

    def read(self, version: Version | int | None = None, parts: list[int] | None = None) -> DataFrame:
        """The rows of a version; with parts, of these partitions alone: no other file is listed."""
        at = version if isinstance(version, Version) else self.version(version)
        folders = [f"{self.path}/data/v={v}/part={p}" for p, held in sorted(at.parts.items()) if parts is None or p in parts for v in held]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        whole = StructType([*self.schema.fields]).add("v", StringType()).add("part", IntegerType())
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*folders).select(*self.schema.names)

    def part(self) -> Column:
        """The partition of a row."""
        return F.pmod(F.xxhash64(*self.within), F.lit(self.partitions)).cast("int")

    def parts_of(self, rows: DataFrame) -> list[int]:
        """The partitions that rows touch: at most `partitions` numbers."""
        return sorted(r[0] for r in rows.select(self.part()).distinct().collect())

    # Changes

    def _commit(self, start: Version, parts: dict[int, tuple[str, ...]], batch: tuple[str, int] | None) -> Version:
        """Write the next manifest under another name and give it its own, which fails if that is taken."""
        new = Version(start.number + 1, parts, start.batches | (dict([batch]) if batch else {}))
        fs, unfinished = self._fs(f"{self.path}/log/.{uuid.uuid4().hex}")
        _, final = self._fs(f"{self.path}/log/{new.number:020d}")
        out = fs.create(unfinished, False)
        out.write(json.dumps({"parts": {k: list(v) for k, v in parts.items()}, "batches": new.batches}).encode())
        out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        how = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # none: not over what is there
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(unfinished, final, how)
        except Py4JJavaError as e:
            fs.delete(unfinished, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {new.number} of {self.path} is taken") from None
            raise
        return new

    def _taken(self, at: Version, batch: tuple[str, int] | None) -> bool:
        return batch is not None and at.batches.get(batch[0], -1) >= batch[1]

    def _written(self, rows: DataFrame, number: int) -> str:
        """Write rows by partition into a folder of their own; its name."""
        name = f"{number}-{uuid.uuid4().hex}"
        rows.select(*self.schema.names).withColumn("part", self.part()).repartition("part").write.partitionBy("part").parquet(f"{self.path}/data/v={name}")
        return name

    def merge(self, rows: DataFrame, combine: Callable[[DataFrame], DataFrame], *, batch: tuple[str, int] | None = None) -> Version:
        """Put together the old rows of the touched partitions with new ones: combine gets their union and returns what stands there from now on.

        The union has the column `new` (0 of the store, 1 of the change). batch: (source, number);
        a source's numbers must rise, and one that has been taken is passed over.
        """
        at = self.version()
        if self._taken(at, batch):
            return at
        touched = self.parts_of(rows)
        if not touched:
            return self._commit(at, at.parts, batch) if batch else at
        union = self.read(at, touched).withColumn("new", F.lit(0)).unionByName(rows.withColumn("new", F.lit(1)), allowMissingColumns=True)
        name = self._written(combine(union), at.number + 1)
        there = {int(n.removeprefix("part=")) for n in self._names(f"data/v={name}") if n.startswith("part=")}
        parts = {p: held for p, held in at.parts.items() if p not in touched} | {p: (name,) for p in touched if p in there}
        return self._commit(at, parts, batch)

    def upsert(self, rows: DataFrame, *, order: str | None = None, batch: tuple[str, int] | None = None) -> Version:
        """Rows take the place of those with their keys; of several new ones with one key the last by `order` (a column that is not stored)."""
        last = Window.partitionBy(*self.keys).orderBy(F.desc("new"), *([F.desc(order)] if order else []))
        return self.merge(rows, lambda both: both.withColumn("__nth", F.row_number().over(last)).where("__nth = 1"), batch=batch)

    def append(self, rows: DataFrame, *, batch: tuple[str, int] | None = None) -> Version:
        """Add rows; no file that is there is read or written."""
        at = self.version()
        if self._taken(at, batch):
            return at
        name = self._written(rows, at.number + 1)
        there = [int(n.removeprefix("part=")) for n in self._names(f"data/v={name}") if n.startswith("part=")]
        return self._commit(at, at.parts | {p: (*at.parts.get(p, ()), name) for p in there}, batch)

    def compact(self, most: int = 8) -> Version:
        """Rewrite the partitions that more than `most` commits hold."""
        at = self.version()
        many = [p for p, held in at.parts.items() if len(held) > most]
        if not many:
            return at
        name = self._written(self.read(at, many), at.number + 1)
        return self._commit(at, at.parts | {p: (name,) for p in many}, None)

    def vacuum(self, keep: int = 2) -> int:
        """Delete what none of the newest `keep` versions holds, and older manifests; how many folders went. Not while a writer is at work."""
        numbers = self.versions()
        held = {v for n in numbers[:keep] for vs in self._manifest(n).parts.values() for v in vs}
        gone = 0
        for n in self._names("data"):
            if n.startswith("v=") and n[2:] not in held:
                fs, p = self._fs(f"{self.path}/data/{n}")
                gone += bool(fs.delete(p, True))
        for n in numbers[keep:]:
            fs, p = self._fs(f"{self.path}/log/{n:020d}")
            fs.delete(p, False)
        return gone
