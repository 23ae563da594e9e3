"""Stored state over changes: a table of layers behind an atomic pointer, instead of whole rewrites.

A change has a key, an order (its sequence columns) and values; it deletes its row or sets those of its values that
aren't null. A key's state is the greatest order seen, the greatest order of a deletion, and for each value the last
one that isn't null with its order. Such states merge by maxima, so they can be merged in any order, twice or in
parts, and always give what one pass over all changes by key and order gives: late changes don't overwrite newer ones
or bring back a row that was deleted after them, and a rerun changes nothing. Flags hold once any change of the key
met their condition, deletions notwithstanding: a row that was once forced to review stays there.

``merge`` aggregates a batch to states and writes them as a layer of their own, which costs as much as the batch. A
layer that isn't larger than twice all later ones together is merged with them, so there are few layers and a row is
rewritten a number of times that grows with the logarithm of the table. A version is a small file that lists the
layers and the last batch of each source; it is renamed into place, which fails if another writer was first, and
then the commit is tried again on top of theirs. Readers see one version or the next, never half of one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError


class Store:
    """A folder of versions and layers on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)
        self._fs.mkdirs(self._at("log"))

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        return sorted(int(f.getPath().getName()[:-5]) for f in self._fs.listStatus(self._at("log")) if f.getPath().getName().endswith(".json"))

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """A version (the last one) and what it says; version 0 is an empty table."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, {"layers": [], "batches": {}}
        stream = self._fs.open(self._at(f"log/{version:012d}.json"))
        try:
            return version, json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, told: dict) -> bool:
        """Put a version in place, unless there is one of its number."""
        draft = self._at(f"log/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(told).encode()))
        stream.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._at(f"log/{version:012d}.json")), none)
        except (Py4JJavaError, CapturedException) as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" not in str(error):
                raise
            return False
        return True

    def drop(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def layers(self) -> list[str]:
        at = self._at("layers")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []


class StateTable:
    """The state of changes by ``keys``. ``order``: columns whose greatest value is the latest change; ``values``: columns
    that changes set; ``op`` says ``deleted`` for deletions; ``flags``: names and conditions on a change, in SQL."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], values: Sequence[str], op: str = "op", deleted: str = "D", flags: Mapping[str, str] | None = None):
        self.store, self.spark = Store(spark, path), spark
        self.keys, self.order, self.values, self.op, self.deleted, self.flags = list(keys), list(order), list(values), op, deleted, dict(flags or {})

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One state a key; the states of a task are merged before the shuffle."""
        kept = [F.max(c).alias(c) for c in ("st_last", "st_gone", *[f"st_{v}" for v in self.values])]
        return rows.groupBy(*self.keys).agg(*kept, *[F.bool_or(f).alias(f) for f in self.flags])

    def states(self, changes: DataFrame) -> DataFrame:
        """The states of a batch of changes."""
        at = F.struct(*self.order)
        value = lambda v: F.when(F.col(v).isNotNull(), F.struct(at.alias("at"), F.col(v).alias("value"))).alias(f"st_{v}")
        gone = F.when(F.col(self.op) == self.deleted, at).alias("st_gone")
        flags = [F.coalesce(F.expr(condition), F.lit(False)).alias(name) for name, condition in self.flags.items()]
        return self._merged(changes.select(*self.keys, at.alias("st_last"), gone, *[value(v) for v in self.values], *flags))

    def _write(self, rows: DataFrame) -> dict:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.store.path}/layers/{name}")
        return {"name": name, "rows": self.spark.read.schema(rows.schema).parquet(f"{self.store.path}/layers/{name}").count(), "schema": rows.schema.json()}

    def _read(self, layers: Sequence[dict]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(layers[0]["schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self.store.path}/layers/{x['name']}" for x in layers])

    def merge(self, changes: DataFrame, source: str | None = None, batch: int | None = None) -> bool:
        """Add a batch. With ``source`` and ``batch`` it is skipped where a batch of that source with this number or a
        later one is in the table. Whether it was added."""
        done = lambda told: source is not None and told["batches"].get(source, -1) >= batch
        if done(self.store.read()[1]):
            return False
        layer = self._write(self.states(changes))
        while True:
            version, told = self.store.read()
            if done(told):
                self.store.drop(f"layers/{layer['name']}")
                return False
            batches = told["batches"] | ({source: batch} if source is not None else {})
            if self.store.commit(version + 1, {"layers": [*told["layers"], *([layer] if layer["rows"] else [])], "batches": batches}):
                break
        self.compact()
        return True

    def compact(self, factor: int = 2) -> bool:
        """Merge the last layers that are small beside each other. Whether any were."""
        _, told = self.store.read()
        layers, first, rows = told["layers"], len(told["layers"]) - 1, 0
        for k in range(len(layers) - 1, -1, -1):
            if k < len(layers) - 1 and layers[k]["rows"] > factor * rows:
                break
            first, rows = k, rows + layers[k]["rows"]
        old = layers[first:] if layers else []
        if len(old) < 2:
            return False
        layer, names = self._write(self._merged(self._read(old))), [x["name"] for x in old]
        while True:
            version, told = self.store.read()
            held = [x["name"] for x in told["layers"]]
            if not set(names) <= set(held):  # another writer has merged some of them
                self.store.drop(f"layers/{layer['name']}")
                return False
            rest = [x for x in told["layers"] if x["name"] not in names]
            if self.store.commit(version + 1, told | {"layers": sorted([*rest, layer], key=lambda x: -x["rows"])}):
                return True

    def vacuum(self) -> int:
        """Delete the layers that the last version doesn't list, and older versions. No reader or writer may be at work."""
        version, told = self.store.read()
        held = {x["name"] for x in told["layers"]}
        gone = [name for name in self.store.layers() if name not in held]
        for name in gone:
            self.store.drop(f"layers/{name}")
        for v in self.store.versions():
            if v < version:
                self.store.drop(f"log/{v:012d}.json")
        return len(gone)

    def current(self, version: int | None = None) -> DataFrame | None:
        """The rows that are there in a version (the last one): keys, values and flags. None before the first change."""
        _, told = self.store.read(version)
        if not told["layers"]:
            return None
        rows = self._read(told["layers"])
        rows = self._merged(rows) if len(told["layers"]) > 1 else rows
        live = F.col("st_gone").isNull() | (F.col("st_last") > F.col("st_gone"))
        later = lambda v: F.col("st_gone").isNull() | (F.col(f"st_{v}.at") > F.col("st_gone"))
        value: list[Column] = [F.when(later(v), F.col(f"st_{v}.value")).alias(v) for v in self.values]
        return rows.where(live).select(*self.keys, *value, *self.flags)
