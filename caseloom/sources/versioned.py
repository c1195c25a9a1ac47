"""A stored table with versions: deletes and truncation that rewrite touched files only, under legal
hold.

The table is a folder of Parquet files and a folder of version files, each of which lists the data
files and the holds of one version.  Data files carry min/max statistics of all columns and Bloom
filters of the key columns, so a delete opens the row groups that may hold a wanted row and no
others.  A change writes its new files first and then the next version's file under a name that
must be free: of several writers one commits, the others get an error, and readers see a whole
version before and after.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UnderHold(RuntimeError):
    """Rows that a hold protects would be deleted."""


class Conflict(RuntimeError):
    """Another writer has committed since the version that a change was made from."""


@dataclass(frozen=True)
class Version:
    number: int
    files: tuple[str, ...]
    #: Holds by name: a SQL condition of the rows that must stay.
    holds: dict[str, str]


class VersionedTable:
    """A table under root, any path that Spark's file systems reach.

    keys: columns that deletes are looked up by, which get Bloom filters.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: tuple[str, ...] = ()) -> None:
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, keys
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    # --- versions -----------------------------------------------------------------------

    def current(self, number: int | None = None) -> Version:
        """A version, by default the last; version 0 is the empty table."""
        folder, fs = self._path(f"{self.root}/versions"), self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        last = max((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)
        wanted = last if number is None else number
        if not wanted:
            return Version(0, (), {})
        stream = fs.open(self._path(f"{self.root}/versions/{wanted:010d}.json"))
        try:
            body = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(wanted, tuple(body["files"]), body["holds"])

    def _commit(self, before: Version, files: list[str], holds: dict[str, str] | None = None) -> int:
        fs, number = self._fs(), before.number + 1
        temporary, final = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}"), self._path(f"{self.root}/versions/{number:010d}.json")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps({"files": sorted(files), "holds": before.holds if holds is None else holds}).encode()))
        out.close()
        if fs.getUri().getScheme() == "file":  # rename replaces on local file systems, a link does not
            try:
                os.link(temporary.toUri().getPath(), final.toUri().getPath())
                made = True
            except FileExistsError:
                made = False
            fs.delete(temporary, False)
        else:
            made = not fs.exists(final) and fs.rename(temporary, final)
            if not made:
                fs.delete(temporary, False)
        if not made:
            raise Conflict(f"version {number} was committed by another writer")
        return number

    # --- rows ---------------------------------------------------------------------------

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, by default the last."""
        return self._rows(self.current(number).files)

    def _rows(self, files) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*files)

    def _written(self, df: DataFrame) -> list[str]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        writer = df.select(*[F.col(f"`{c}`") for c in self.schema.names]).write
        for key in self.keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.parquet(folder)
        names = (s.getPath() for s in self._fs().listStatus(self._path(folder)))
        return [p.toString() for p in names if p.getName().startswith("part-")]

    def append(self, df: DataFrame) -> int:
        """Add the rows of df; the number of the version."""
        before = self.current()
        return self._commit(before, [*before.files, *self._written(df)])

    def hold(self, name: str, condition: str) -> int:
        """Protect the rows that a SQL condition holds for, until release()."""
        before = self.current()
        self._rows(before.files).where(condition)  # raises if it cannot be resolved
        return self._commit(before, list(before.files), {**before.holds, name: condition})

    def release(self, name: str) -> int:
        before = self.current()
        return self._commit(before, list(before.files), {k: v for k, v in before.holds.items() if k != name})

    def touched(self, condition: Column | str) -> list[str]:
        """The files of the last version that hold a row of condition."""
        return self._touched(self.current(), condition)

    def _touched(self, version: Version, condition: Column | str) -> list[str]:
        rows = self._rows(version.files)
        if not version.files:
            return []
        rows = rows.where(condition)
        names = rows.select(rows.metadataColumn("_metadata").getField("file_path").alias("file")).distinct()
        found = {self._path(r["file"]).toUri().getPath() for r in names.collect()}  # a row a touched file
        return [f for f in version.files if self._path(f).toUri().getPath() in found]

    def delete(self, condition: Column | str) -> int:
        """Delete the rows of condition; how many they were.

        Rows for which it is null stay.  UnderHold, and nothing is changed, if a row of them is held;
        Conflict if another change, such as a new hold, was committed meanwhile.
        """
        before = self.current()
        files = self._touched(before, condition)
        if not files:
            return 0
        condition = F.expr(condition) if isinstance(condition, str) else condition
        old = self._rows(files)
        gone = old.where(condition)
        held = [F.sum(F.coalesce(F.expr(c), F.lit(False)).cast("long")).alias(n) for n, c in before.holds.items()]
        told = gone.agg(F.count(F.lit(1)).alias("_n"), *held).first()
        blocked = [n for n in before.holds if told[n]]
        if blocked:
            raise UnderHold(f"held by {', '.join(sorted(blocked))}")
        kept = self._written(old.where(~F.coalesce(condition, F.lit(False))))
        touched = set(files)
        self._commit(before, [*[f for f in before.files if f not in touched], *kept])
        return told["_n"]

    def truncate(self) -> int:
        """Delete all rows, under the same rules; how many they were."""
        return self.delete(F.lit(True))
