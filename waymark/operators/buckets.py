"""Stored tables that are changed bucket by bucket.

Rows lie in folders by the hash of a key. A version is a small manifest that names the folders of
every bucket of every table; the newest manifest is the store's state. A change writes new folders
for the buckets that it touches, and then one manifest, which is created only if no other writer has
made that version meanwhile: a change is seen as a whole or not at all, files of other buckets stay as
they are, and older versions can be read until they are swept. An insert adds a folder to a bucket; a
delete or update rewrites only buckets that hold a hit, file by file, so a bucket with very many rows
of one key is still many tasks.

The manifest has tables x buckets entries whatever the rows, and is all that the driver holds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.operators.store import POLICIES, Refused, with_defaults

BUCKETS = 64


class Overtaken(Exception):
    """Another writer made the version first; read again and repeat the change."""


def bucket_of(keys: list[str], buckets: int) -> Column:
    """Bucket of a row; a null key is a key like any other."""
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


class Store:
    """Tables under a folder of a file system that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def versions(self) -> list[int]:
        if not self._files.exists(self._at("versions")):
            return []
        return sorted(int(s.getPath().getName()) for s in self._files.listStatus(self._at("versions")) if s.getPath().getName().isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{version, note, tables: {name: {keys, buckets, schema, folders: {bucket: [folder]}}}}."""
        known = self.versions() if version is None else [version]
        if not known:
            return {"version": 0, "note": None, "tables": {}}
        stream = self._files.open(self._at(f"versions/{known[-1]}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, before: dict, tables: dict, note=None) -> dict:
        """The next version; its file appears under its name only when it is whole, and only once."""
        now = {"version": before["version"] + 1, "note": note, "tables": {**before["tables"], **tables}}
        own = self._at(f"versions/.{uuid.uuid4().hex}")
        out = self._files.create(own, False)
        try:
            out.write(bytearray(json.dumps(now).encode()))
        finally:
            out.close()
        target = self._at(f"versions/{now['version']}")
        # shared file systems such as HDFS refuse to rename onto a name that is there, so of two writers
        # one fails; a local disk does not, and the look beforehand has to do
        if self._files.exists(target) or not self._files.rename(own, target):
            self._files.delete(own, False)
            raise Overtaken(f"version {now['version']}")
        return now

    def _write(self, rows: DataFrame, table: dict) -> dict[str, list[str]]:
        """Writes rows into new folders, one for each bucket that has any."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", bucket_of(table["keys"], table["buckets"])).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._files.listStatus(self._at(folder))]
        return {n.split("=")[1]: [f"{folder}/{n}"] for n in names if n.startswith("_bucket=")}

    def create(self, name: str, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> None:
        before = self.manifest()
        if name in before["tables"]:
            raise ValueError(f"{name} is there already")
        table = {"keys": keys, "buckets": buckets, "schema": rows.schema.json()}
        self._commit(before, {name: table | {"folders": self._write(rows, table)}})

    def read(self, name: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The table, or the rows of some buckets, in which case no other file is looked at."""
        return self._read(self.manifest(version)["tables"][name], buckets)

    def _read(self, table: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(table["schema"]))
        folders = [f"{self.path}/{f}" for b, fs in table["folders"].items() if buckets is None or int(b) in buckets for f in fs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def buckets_of(self, table: dict, rows: DataFrame) -> list[int]:
        """Buckets in which the keys of rows lie (at most as many as the table has)."""
        return sorted(r[0] for r in rows.select(bucket_of(table["keys"], table["buckets"])).distinct().collect())

    def change(self, steps: dict[str, Callable[[dict], dict[str, list[str]] | None]], note=None) -> dict:
        """One version in which the folders of some tables' buckets are others. Each step gets its
        table's entry and returns the new folders by bucket; none if nothing is to change."""
        before = self.manifest()
        tables = {}
        for name, step in steps.items():
            table = before["tables"][name]
            if (folders := step(table)) is not None:
                kept = {b: f for b, f in {**table["folders"], **folders}.items() if f}
                tables[name] = {**table, "folders": kept}
        return self._commit(before, tables, note) if tables or note is not None else before

    def add(self, name: str, rows: DataFrame) -> None:
        """Appends rows: their buckets get a folder more each and no file is rewritten."""

        def step(table: dict) -> dict:
            new = self._write(rows, table)
            return {b: table["folders"].get(b, []) + f for b, f in new.items()}

        self.change({name: step})

    def rewrite(self, table: dict, buckets: list[int], rows: DataFrame) -> dict[str, list[str]]:
        """Folders that replace these buckets by rows, which lie in them."""
        return {str(b): [] for b in buckets} | self._write(rows, table)

    def sweep(self, keep: int = 1) -> int:
        """Deletes versions but for the newest ones, and folders that none of these names.
        No writer may be at work. Returns how many folders went."""
        known = self.versions()
        for v in known[:-keep]:
            self._files.delete(self._at(f"versions/{v}"), False)
        live = {f for v in known[-keep:] for t in self.manifest(v)["tables"].values() for fs in t["folders"].values() for f in fs}
        gone = 0
        for run in self._files.listStatus(self._at("data")) if self._files.exists(self._at("data")) else []:
            for s in self._files.listStatus(run.getPath()):
                name = f"data/{run.getPath().getName()}/{s.getPath().getName()}"
                if s.isDirectory() and name not in live:
                    self._files.delete(s.getPath(), True)
                    gone += 1
        return gone


class Owned:
    """A stored table as one principal sees it: the verbs of its policy, on the principal's bucket alone.

    The table is bucketed by its owner column. What the principal may not see is neither counted nor
    changed, so a change of a row that is not there, or is another's, does nothing and is no error.
    """

    def __init__(self, store: Store, table: str, principal, policy: str | None = None):
        self.store, self.name, self.principal = store, table, principal
        self.owner, self.verbs = POLICIES[policy or table]

    def _entry(self, verb: str) -> tuple[dict, list[int], Column]:
        if verb not in self.verbs:
            raise Refused(f"{verb} on {self.name}")
        table = self.store.manifest()["tables"][self.name]
        if table["keys"] != [self.owner]:
            raise ValueError(f"{self.name} must be bucketed by {self.owner}")
        kind = T.StructType.fromJson(json.loads(table["schema"]))[self.owner].dataType
        me = F.lit(self.principal).cast(kind)
        one = self.store.spark.range(1).select(me.alias(self.owner))
        return table, self.store.buckets_of(table, one), F.col(self.owner) == me

    def select(self, *columns: str) -> DataFrame:
        table, own, mine = self._entry("select")
        rows = self.store._read(table, own).where(mine)
        return rows.select(*columns) if columns else rows

    def insert(self, rows: DataFrame) -> DataFrame:
        """Appends own rows; returns them as stored, with defaults filled in once."""
        table, _, _ = self._entry("insert")
        if not rows.where(~F.col(self.owner).eqNullSafe(F.lit(self.principal))).isEmpty():
            raise Refused(f"rows of another owner for {self.name}")
        schema = T.StructType.fromJson(json.loads(table["schema"]))
        new: dict = {}

        def step(entry: dict) -> dict:
            new.update(self.store._write(with_defaults(rows, schema), entry))
            return {b: entry["folders"].get(b, []) + f for b, f in new.items()}

        self.store.change({self.name: step})
        paths = [f"{self.store.path}/{f}" for fs in new.values() for f in fs]
        return self.store.spark.read.schema(schema).parquet(*paths) if paths else self.store.spark.createDataFrame([], schema)

    def _replace(self, verb: str, hit: Column, after: Callable[[DataFrame, Column], DataFrame]) -> int:
        """Rewrites the principal's bucket if it holds a hit; returns how many rows were hit."""
        table, own, mine = self._entry(verb)
        rows, hit = self.store._read(table, own), F.coalesce(mine & hit, F.lit(False))
        if n := rows.where(hit).count():
            self.store.change({self.name: lambda entry: self.store.rewrite(entry, own, after(rows, hit))})
        return n

    def delete(self, ids: list) -> int:
        return self._replace("delete", F.col("id").isin(ids), lambda rows, hit: rows.where(~hit))

    def update(self, row_id, **values) -> int:
        if values.get(self.owner, self.principal) != self.principal:
            raise Refused(f"change of {self.owner} on {self.name}")
        put = lambda rows, hit: rows.withColumns({k: F.when(hit, F.lit(v).cast(rows.schema[k].dataType)).otherwise(F.col(f"`{k}`")) for k, v in values.items()})
        return self._replace("update", F.col("id") == F.lit(row_id), put)
