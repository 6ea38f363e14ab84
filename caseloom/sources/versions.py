"""Tables that change together, in versions: IO08, and the sinks of streams.

A table lies in hash buckets of its key. A change writes the buckets it touches
anew, beside the old ones, and then one small file that names the folders of
all buckets of all tables: the version. The file appears by a rename, so a
reader sees the old version or the new one, and a crash before it leaves
folders that no version names. A version also holds a ledger, the last epoch
applied of each stream, so an epoch that comes again changes nothing.

    root/data/<id>/<table>/bucket=<k>/*.parquet
    root/versions/<number>.json

One writer at a time: a second one that finds its number taken is refused.
A bucket is one task's work when it is rewritten, so ``buckets`` should follow
the size of the tables; files do not grow in number with the changes made.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What becomes of the old rows of the touched buckets and the new rows.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer has made this version."""


class Versions:
    def __init__(self, spark: SparkSession, root: str, keys: dict[str, list[str]], buckets: int = 16):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json") and n[0].isdigit())

    def state(self, version: int | None = None) -> dict:
        """What a version names; the last one, or nothing before the first."""
        if version is None:
            version = max(self.numbers(), default=0)
            if not version:
                return {"version": 0, "buckets": self.buckets, "tables": {}, "ledger": {}}
        stream = self._fs.open(self._path(f"versions/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _read(self, table: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        folders = [f"{self.root}/{f}" for b, f in table["folders"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as of one version, whatever is written meanwhile; None where that version has no such table."""
        table = self.state(version)["tables"].get(name)
        return None if table is None else self._read(table)

    def _bucket(self, name: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys[name]), F.lit(buckets)).cast("int")

    def _write(self, df: DataFrame, name: str, buckets: int) -> dict[str, str]:
        """Folder of each bucket that has rows; one file a bucket."""
        folder = f"data/{uuid.uuid4().hex}/{name}"
        df.withColumn("bucket", self._bucket(name, buckets)).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        return {n.removeprefix("bucket="): f"{folder}/{n}" for n in self._names(folder) if n.startswith("bucket=")}

    def _announce(self, state: dict) -> int:
        """The version's file, under a name that no reader looks at."""
        state["version"] += 1
        out = self._fs.create(self._path(f"versions/{state['version']:012d}.pending"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        return state["version"]

    def _publish(self, number: int) -> None:
        final = self._path(f"versions/{number:012d}.json")
        if self._fs.exists(final) or not self._fs.rename(self._path(f"versions/{number:012d}.pending"), final):
            raise Conflict(f"version {number} is there")

    def due(self, state: dict, applied: tuple[str, int] | None) -> bool:
        return applied is None or state["ledger"].get(applied[0], -1) < applied[1]

    def _commit(self, state: dict, applied: tuple[str, int] | None) -> int:
        if applied is not None:
            state["ledger"][applied[0]] = applied[1]
        number = self._announce(state)
        self._publish(number)
        return number

    def replace(self, tables: dict[str, DataFrame], applied: tuple[str, int] | None = None) -> int | None:
        """All rows of ``tables`` anew, in one version; None where the epoch was applied before."""
        state = self.state()
        if not self.due(state, applied):
            return None
        for name, df in tables.items():
            state["tables"][name] = {"schema": df.schema.jsonValue(), "folders": self._write(df, name, state["buckets"])}
        return self._commit(state, applied)

    def upsert(self, changes: dict[str, DataFrame], applied: tuple[str, int] | None = None, merges: dict[str, Merge] | None = None, keys: DataFrame | None = None) -> int | None:
        """Rows of ``changes`` take the place of all rows with their keys, in one version.

        ``keys`` names the keys to be replaced where a table's new rows do not
        tell (a case that lost its options). ``merges`` says otherwise for a
        table: a function of the old rows of the touched buckets and the new.
        """
        state = self.state()
        if not self.due(state, applied):
            return None
        for name, rows in changes.items():
            staged = self._stage(rows, name, state["buckets"])
            schema = rows.schema
            delta = self._read({"schema": schema.jsonValue(), "folders": staged})
            touched = set(staged)
            merge = (merges or {}).get(name)
            gone = None
            if keys is not None and merge is None:
                gone = keys.select(*self.keys[name]).distinct()
                touched |= {str(r[0]) for r in gone.select(self._bucket(name, state["buckets"])).distinct().collect()}  # at most ``buckets`` rows
            table = state["tables"].setdefault(name, {"schema": schema.jsonValue(), "folders": {}})
            if not touched:
                continue
            old = self._read(table, sorted(touched))
            if merge is not None:
                merged = merge(old, delta)
            else:
                gone = delta.select(*self.keys[name]).distinct() if gone is None else gone.unionByName(delta.select(*self.keys[name])).distinct()
                merged = old.join(gone, self.keys[name], "left_anti").select(*old.columns).unionByName(delta.select(*old.columns))
            made = self._write(merged, name, state["buckets"])
            table["folders"] = {b: f for b, f in table["folders"].items() if b not in touched} | {b: f for b, f in made.items() if b in touched}
        return self._commit(state, applied)

    def _stage(self, rows: DataFrame, name: str, buckets: int) -> dict[str, str]:
        """New rows written once: they are counted by bucket and read again, and a stream's batch is computed once."""
        return self._write(rows, name, buckets)

    def clean(self, keep: int = 2) -> int:
        """Delete versions but the last ``keep`` and all folders that none of these names; readers pinned to older ones must be done."""
        kept = self.numbers()[-keep:]
        named = {f.split("/")[1] for v in kept for t in self.state(v)["tables"].values() for f in t["folders"].values()}
        gone = [n for n in self._names("data") if n not in named]
        for n in gone:
            self._fs.delete(self._path(f"data/{n}"), True)
        for v in self.numbers()[:-keep]:
            self._fs.delete(self._path(f"versions/{v:012d}.json"), False)
        return len(gone)
