"""Shards of a growing table, in DataFrame operations only.

Method: size-tiered compaction.  Arrivals are appended as small immutable files; files whose
sizes fall into one tier are merged FAN_IN at a time until they reach the target size, and a file
above the target is split before it is committed, whatever the splits of the input; each step
commits a new version of a manifest, which tells the files that make up the table.

A version's file holds the files added and removed since the version before; every SNAPSHOT_EVERY
versions a file with all of them is written beside it, so that a commit costs what it changes.  A
version is written to a temporary file that gets the version's name only if that name is free: by
a hard link on local file systems, by rename on others.  HDFS and file systems with its rules
refuse to rename onto an existing file, so of several writers one commits and readers see whole
versions only; object stores that overwrite are safe for one writer at a time.  A failed step
leaves files that no manifest names, which vacuum() removes when they are old enough that no
writer can be about to commit them.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.runtime import scratch_path

MIB = 1 << 20
#: Arrivals in which a table is appended; one pass over it writes the files of all of them.
ARRIVALS = 8
SNAPSHOT_EVERY = 16
#: vacuum() keeps the files of so many versions, and files younger than so many seconds.
KEPT_VERSIONS, LEAST_AGE = 3, 24 * 3600.0


@dataclass(frozen=True)
class Shard:
    path: str
    size: int
    tier: int
    generation: int


@dataclass(frozen=True)
class Policy:
    """Tiers: tier t holds files of up to base * fan_in**t bytes; files of at least half the
    target are final."""

    base: int = 4 * MIB
    fan_in: int = 4
    target: int = 64 * MIB

    def tier(self, size: int) -> int:
        t, edge = 0, self.base
        while size > edge:
            t, edge = t + 1, edge * self.fan_in
        return t

    def merges(self, shards: list[Shard]) -> list[list[Shard]]:
        """Groups of similarly sized files to merge: at least fan_in of a tier, or as many as
        reach half the target; each group stays within the target."""
        groups: list[list[Shard]] = []
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.size < self.target // 2:
                tiers.setdefault(s.tier, []).append(s)
        for _, members in sorted(tiers.items()):
            run: list[Shard] = []
            for s in sorted(members, key=lambda s: (s.size, s.path)):
                if run and sum(r.size for r in run) + s.size > self.target:
                    groups.append(run)
                    run = []
                run.append(s)
            if len(run) >= self.fan_in or sum(r.size for r in run) >= self.target // 2:
                groups.append(run)
        return [g for g in groups if len(g) > 1]


class ShardedTable:
    """A table of shards under root, any path that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, policy: Policy | None = None) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.policy = policy or Policy()
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._known: dict[int, list[Shard]] = {}  # the version read or written last

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    # --- manifest -----------------------------------------------------------------------

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the versions (v) or snapshots (s) in the manifest's folder, ascending."""
        folder, fs = self._path(f"{self.root}/manifest"), self._fs()
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith(kind) and n.endswith(".json"))

    def _name(self, kind: str, number: int) -> str:
        return f"{self.root}/manifest/{kind}{number:010d}.json"

    def _load(self, kind: str, number: int) -> dict:
        stream = self._fs().open(self._path(self._name(kind, number)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, kind: str, number: int, body: dict) -> bool:
        """Write a file of the manifest; False if there is one of that name."""
        fs = self._fs()
        temporary = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        final = self._path(self._name(kind, number))
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        if fs.getUri().getScheme() == "file":
            try:
                os.link(temporary.toUri().getPath(), final.toUri().getPath())
                made = True
            except FileExistsError:
                made = False
            fs.delete(temporary, False)
            return made
        made = not fs.exists(final) and fs.rename(temporary, final)
        if not made:
            fs.delete(temporary, False)
        return made

    def version(self) -> int:
        """Number of the last committed version; 0 for a new table."""
        return max(self._numbers("v"), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if version in self._known:
            return list(self._known[version])
        start = max((n for n in self._numbers("s") if n <= version), default=0)
        listed = {s["path"]: Shard(**s) for s in self._load("s", start)["shards"]} if start else {}
        for n in range(start + 1, version + 1):
            change = self._load("v", n)
            for path in change["removed"]:
                del listed[path]
            listed |= {s["path"]: Shard(**s) for s in change["added"]}
        self._known = {version: list(listed.values())}
        return list(self._known[version])

    def commit(self, shards: list[Shard], read_version: int) -> int:
        """Make shards version read_version + 1; RuntimeError if another writer has made that."""
        before, number = {s.path for s in self.shards(read_version)}, read_version + 1
        after = {s.path for s in shards}
        change = {
            "version": number, "added": [asdict(s) for s in shards if s.path not in before], "removed": sorted(before - after),
        }
        if not self._publish("v", number, change):
            raise RuntimeError(f"version {number} was committed by another writer")
        self._known = {number: list(shards)}
        if number % SNAPSHOT_EVERY == 0:
            self._publish("s", number, {"version": number, "shards": [asdict(s) for s in shards]})
        return number

    # --- data ---------------------------------------------------------------------------

    def _write(self, df: DataFrame, generation: int, most_rows: int = 0) -> list[Shard]:
        """Write df's partitions as files of a new folder, each of at most most_rows rows if that
        is given and of at most the target size, and list them."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", most_rows).parquet(folder)
        return self._listed(folder, generation)

    def _listed(self, folder: str, generation: int) -> list[Shard]:
        """The files written into folder, those above the target split."""
        path = self._path(folder)
        found = [
            (s.getPath().toString(), s.getLen())
            for s in (self._fs().listStatus(path) if self._fs().exists(path) else [])
            if s.getPath().getName().startswith("part-")
        ]
        written = [Shard(p, n, self.policy.tier(n), generation) for p, n in sorted(found)]
        return [part for s in written for part in (self._split(s) if s.size > self.policy.target else [s])]

    def _split(self, shard: Shard) -> list[Shard]:
        """Files within the target with the rows of shard; a single row is never split."""
        rows = self.spark.read.schema(self.schema).parquet(shard.path)
        n = rows.count()
        if n < 2:
            return [shard]
        parts = max(2, -(-shard.size * 4 // (self.policy.target * 3)))
        return self._write(rows.coalesce(1), shard.generation, max(1, n // parts))

    def append(self, df: DataFrame, most_rows: int = 0) -> int:
        """Add the rows of df as small files, one or more for each of its partitions: most_rows
        is the most rows of a file, 0 for no bound but the target size."""
        at = self.version()
        return self.commit([*self.shards(at), *self._write(df, 0, most_rows)], at)

    def stage(self, df: DataFrame, arrival: Column, arrivals: int) -> list[str]:
        """Write df in one pass, each row to the folder of its arrival, a number from 0; the
        folders in order, for append_folder().  No manifest names their files yet."""
        root = f"{self.root}/data/{uuid.uuid4().hex}"
        name = f"arrival{uuid.uuid4().hex}"  # no column of df
        df.withColumn(name, arrival).write.partitionBy(name).parquet(root)
        return [f"{root}/{name}={k}" for k in range(arrivals)]

    def append_folder(self, folder: str) -> int:
        """Add the files of a staged folder, if any, as one version."""
        at = self.version()
        return self.commit([*self.shards(at), *self._listed(folder, 0)], at)

    def compact(self, threads: int = 4) -> int:
        """One round of merges, committed as one version; 0 if there is nothing to merge.

        A merge reads its files in one task and writes one file, without a shuffle.  Where that comes
        out above the target and is split into as many files as there were, they stay as they are:
        each committed merge leaves fewer files, so rounds come to an end.
        """
        at = self.version()
        now = self.shards(at)
        groups = self.policy.merges(now)
        if not groups:
            return 0

        def merge(group: list[Shard]) -> list[Shard]:
            rows = self.spark.read.schema(self.schema).parquet(*[s.path for s in group])
            return self._write(rows.coalesce(1), 1 + max(s.generation for s in group))

        with ThreadPoolExecutor(threads) as pool:
            done = [(g, out) for g, out in zip(groups, pool.map(merge, groups), strict=True) if len(out) < len(g)]
        if not done:
            return 0
        merged = [s for _, out in done for s in out]
        gone = {s.path for g, _ in done for s in g}
        return self.commit([*[s for s in now if s.path not in gone], *merged], at)

    def compact_fully(self) -> int:
        rounds = 0
        while self.compact():
            rounds += 1
        return rounds

    def vacuum(self, versions: int = KEPT_VERSIONS, least_age: float = LEAST_AGE) -> int:
        """Delete data files that none of the last `versions` versions names; the number deleted.

        Files younger than least_age seconds stay: a writer that has not committed yet may have
        written them.  least_age must exceed the longest write; 0 only where there is one writer.
        """
        last = self.version()
        kept = [v for v in self._numbers("v") if v > last - versions]
        keep = {s.path for v in kept for s in self.shards(v)}
        before = (time.time() - least_age) * 1000
        fs, gone = self._fs(), 0
        folders = [self._path(f"{self.root}/data")] if fs.exists(self._path(f"{self.root}/data")) else []
        while folders:
            for f in fs.listStatus(folders.pop()):
                if f.isDirectory():
                    folders.append(f.getPath())
                    continue
                old = f.getModificationTime() <= before
                if old and f.getPath().getName().startswith("part-") and f.getPath().toString() not in keep:
                    fs.delete(f.getPath(), False)
                    gone += 1
        # versions that can be read no more, up to the snapshot that the kept ones start from
        base = max((n for n in self._numbers("s") if kept and n <= kept[0]), default=0)
        for kind in ("v", "s"):
            for n in self._numbers(kind):
                if n < base:
                    fs.delete(self._path(self._name(kind, n)), False)
        return gone

    def read(self, version: int | None = None, shard: str = "_shard") -> DataFrame:
        """The rows of a version with, under the name of shard, the number of their file in the
        manifest; ValueError if the table has a column of that name."""
        if shard.lower() in {n.lower() for n in self.schema.names}:
            raise ValueError(f"the table has a column {shard}: give another name")
        listed = self.shards(version)
        if not listed:
            return self.spark.createDataFrame([], self.schema).withColumn(shard, F.lit(0))
        about = [(_name(s.path), i) for i, s in enumerate(listed)]
        return self._rows(listed, about, f"file string, `{shard}` int", self.schema.names)

    def _rows(self, listed: list[Shard], about: list[tuple], schema: str, columns: list[str]) -> DataFrame:
        """Columns of the rows of listed files, with what is said about each file."""
        rows = self.spark.read.schema(self.schema).parquet(*[s.path for s in listed])
        told = self.spark.createDataFrame(about, schema)
        extra = [told[c] for c in told.columns if c != "file"]
        # folder and name: a task gives the files of several arrivals one name; one row a shard,
        # broadcast by its measured size only
        file = F.regexp_extract(rows.metadataColumn("_metadata").getField("file_path"), "([^/]+/[^/]+)$", 1)
        return rows.join(told, file == told["file"]).select(*[rows[f"`{c}`"] for c in columns], *extra)


def _name(path: str) -> str:
    """The folder and the name of a file, which no other file shares."""
    return "/".join(path.rsplit("/", 2)[1:])


def shard_documents(docs: DataFrame, root: str | None = None, policy: Policy | None = None, arrivals: int = 1) -> DataFrame:
    """(doc_id, shard, tier, generation, shard_bytes, version) for each row of docs.

    One pass over docs writes its rows as so many arrivals; these are appended one by one,
    compacted after each, and the rows' files are read back from the last version.  Nulls, empty and long texts,
    repeated rows and other columns, whatever their names, are stored as they are; an empty table
    gives no row.  No shard is above the target, unless it is a single row: rows are never split.
    """
    spark = docs.sparkSession
    store = ShardedTable(spark, root or scratch_path(spark, "shards"), docs.schema, policy)
    for folder in store.stage(docs, F.pmod(F.xxhash64(docs["doc_id"]), F.lit(arrivals)), arrivals):
        store.append_folder(folder)
        store.compact_fully()
    store.vacuum(versions=1, least_age=0)  # this table has no other writer or reader
    version = store.version()
    listed = store.shards(version)
    about = [(_name(s.path), i, s.tier, s.generation, s.size, version) for i, s in enumerate(listed)]
    schema = "file string, shard int, tier int, generation int, shard_bytes long, version int"
    if not listed:
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema).fields[1:]]
        return docs.select(docs["doc_id"], *none).limit(0)
    return store._rows(listed, about, schema, ["doc_id"])
