"""A keyed table whose updates rewrite only the buckets that they touch.

Rows are dealt into a fixed number of buckets by the hash of their keys. A version is a manifest, a small JSON file that names the folder of each
bucket's rows and the batches that have been applied; versions share the folders of the buckets that did not change. Readers take the newest whole
manifest and so see all of an update or nothing. A manifest's name can be taken once: a writer that comes second starts again from
the version that came first. A batch that has been applied changes nothing when it comes again.

    path/manifests/7.json     {"version": 7, "keys": [...], "buckets": 16, "schema": ..., "folders": {"3": "data/ab12/_bucket=3"}, "batches": {...}}
    path/data/ab12/_bucket=3  the rows of a bucket as one update wrote them
"""

from __future__ import annotations

import json
import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from roadlake.operators.facts import first_of
from roadlake.scratch import path_of

BUCKET = "_bucket"
#: Seconds to wait for a manifest that is being written; one that stays half is of a writer that died, and its number is passed over.
WAIT = 20
#: Batches that a manifest remembers; a stream replays its last one only.
BATCHES = 1000


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16, keep: int = 8):
        self.spark, self.path, self.keys, self.buckets, self.keep = spark, path.rstrip("/"), keys, buckets, keep

    # ---- manifests

    def _text(self, name: str) -> str:
        p, system = path_of(self.spark, f"{self.path}/{name}")
        stream = system.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _names(self) -> list[int]:
        p, system = path_of(self.spark, f"{self.path}/manifests")
        if not system.exists(p):
            return []
        return sorted(int(n[:-5]) for s in system.listStatus(p) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int) -> dict | None:
        try:
            return json.loads(self._text(f"manifests/{version}.json"))
        except (ValueError, Py4JJavaError):  # half written, or gone
            return None

    def manifest(self, wait: bool = False) -> tuple[dict | None, int]:
        """The newest whole manifest and the next free number."""
        names = self._names()
        until = time.monotonic() + WAIT
        while wait and names and self._manifest(names[-1]) is None and time.monotonic() < until:
            time.sleep(0.2)
        whole = next((m for v in reversed(names) if (m := self._manifest(v))), None)
        return whole, (names[-1] + 1 if names else 0)

    def _commit(self, manifest: dict, number: int) -> bool:
        """Takes the number, or says that another writer has."""
        p, system = path_of(self.spark, f"{self.path}/manifests/{number}.json")
        try:
            stream = system.create(p, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        try:
            stream.write(bytearray(json.dumps(manifest | {"version": number}).encode()))
        finally:
            stream.close()
        return True

    # ---- reading

    def versions(self) -> list[int]:
        return [v for v in self._names() if self._manifest(v)]

    def read(self, version: int | None = None, only: list[str] | None = None) -> DataFrame | None:
        """The rows of a version, the newest if none is given; `only` some buckets' rows. None before the first update."""
        m = self.manifest()[0] if version is None else self._manifest(version)
        if m is None:
            return None
        schema = StructType.fromJson(json.loads(m["schema"]))
        folders = [f"{self.path}/{f}" for b, f in m["folders"].items() if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def lookup(self, wanted: DataFrame) -> DataFrame | None:
        """The rows with the keys of wanted; buckets without any are not read. wanted is small: its buckets are listed on the driver."""
        some = [str(r[0]) for r in wanted.select(self._bucket().alias(BUCKET)).distinct().collect()]  # `buckets` at most
        rows = self.read(only=some)
        return None if rows is None else rows.join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")

    def changes(self, since: int) -> DataFrame:
        """Rows that are new or other than in a version, with change = upsert, and the keys that are gone, with change = delete.

        Only buckets that have been written since are read: a reader with a snapshot of `since` follows by these.
        """
        now, old = self.manifest()[0], self._manifest(since)
        touched = [b for b in {**now["folders"], **old["folders"]} if now["folders"].get(b) != old["folders"].get(b)]
        after, before = self.read(now["version"], touched), self.read(since, touched)
        rest = [c for c in after.columns if c not in self.keys]
        packed = lambda df, name: df.select(*self.keys, F.struct(*rest, F.lit(1).alias("_there")).alias(name))
        both = packed(after, "_new").join(packed(before, "_old"), self.keys, "full")
        kinds = both.withColumn("change", F.when(F.col("_new").isNull(), "delete").otherwise("upsert")).where(~F.to_json("_new").eqNullSafe(F.to_json("_old")))
        return kinds.select(*self.keys, *[F.col(f"_new.{c}").alias(c) for c in rest], "change")

    # ---- writing

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame) -> dict[str, str]:
        """Rows with their bucket as a folder each; folders by bucket."""
        name = uuid.uuid4().hex
        df.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        p, system = path_of(self.spark, f"{self.path}/data/{name}")
        found = [s.getPath().getName() for s in system.listStatus(p)]
        return {f.split("=")[1]: f"data/{name}/{f}" for f in found if f.startswith(f"{BUCKET}=")}

    def _drop(self, folders: list[str]) -> None:
        for f in folders:
            p, system = path_of(self.spark, f"{self.path}/{f}")
            system.delete(p, True)

    def upsert(self, new: DataFrame, batch: str | None = None, order: list[str] | None = None, newest: list[str] | None = None) -> int | None:
        """Applies rows: they replace those of the same keys. The version, or None if nothing changed.

        Of equal keys inside new the one with the greatest order columns wins, then the greatest row. newest: columns by which a row has to be at
        least as great as the stored one to replace it (an older one is ignored). batch: a name that makes a repeated call change nothing.
        """
        ties = [F.desc(c) for c in [*(newest or []), *(order or []), *(c for c in new.columns if c not in self.keys and not {"map<", "variant"} & set(re.findall("map<|variant", new.schema[c].dataType.simpleString())))]]  # what has an order
        return self._apply(new, batch, lambda staged, old: self._merged(staged, old, ties, newest))

    def _merged(self, staged: DataFrame, old: DataFrame | None, ties: list, newest: list[str] | None) -> DataFrame:
        both = staged.withColumn("_new", F.lit(1))
        if old is not None:
            both = both.unionByName(old.withColumn("_new", F.lit(0)), allowMissingColumns=True)
        first = [F.desc(c) for c in newest or []]
        return first_of(both, self.keys, *first, F.desc("_new"), *ties).drop("_new")

    def delete(self, keys: DataFrame, batch: str | None = None) -> int | None:
        """Removes the rows with these keys."""
        if self.manifest()[0] is None:
            return None
        return self._apply(keys.select(*self.keys).distinct(), batch, lambda staged, old: old.join(staged, self.keys, "left_anti"))

    def _apply(self, new: DataFrame, batch: str | None, merge) -> int | None:
        m, number = self.manifest(wait=True)
        if m and batch is not None and batch in m["batches"]:
            return None
        staged = self._write(new.withColumn(BUCKET, self._bucket()))  # once, however often another writer comes first
        if not staged and m is not None:
            return None
        while True:
            base = m or {"folders": {}, "batches": {}, "keys": self.keys, "buckets": self.buckets}
            if m and (m["buckets"], m["keys"]) != (self.buckets, self.keys):
                raise ValueError("the table has other keys or another number of buckets")
            source = self.spark.read.schema(new.schema).parquet(*[f"{self.path}/{f}" for f in staged.values()]) if staged else new.limit(0)
            old = self.read(m["version"], list(staged)) if m else None
            rows = merge(source, old)
            written = self._write(rows.withColumn(BUCKET, self._bucket()))
            folders = {b: f for b, f in base["folders"].items() if b not in staged} | written
            batches = dict(list(base["batches"].items())[-BATCHES + 1 :]) | ({batch: number} if batch is not None else {})
            if self._commit(base | {"folders": folders, "batches": batches, "schema": rows.schema.json()}, number):
                break
            self._drop(list(written.values()))
            m, number = self.manifest(wait=True)
            if m and batch is not None and batch in m["batches"]:
                self._drop(list(staged.values()))
                return None
        self._drop(list(staged.values()))
        self._vacuum()
        return number

    def _vacuum(self) -> None:
        """Drops manifests older than the last `keep`, and the folders that none of the kept ones names."""
        own = [m for v in self._names() if (m := self._manifest(v))]
        kept, gone = own[-self.keep :], own[: -self.keep]
        used = {f for m in kept for f in m["folders"].values()}
        self._drop([f"manifests/{m['version']}.json" for m in gone] + sorted({f for m in gone for f in m["folders"].values()} - used))


def sink(table: KeyedTable, stream: str, newest: list[str] | None = None):
    """A foreachBatch function: every batch is applied once, also when the stream runs it again after a failure."""
    return lambda batch, number: table.upsert(batch, f"{stream}:{number}", newest=newest) and None
