"""Sharding by size-tiered compaction, with an atomically committed manifest.

A store is a folder: ``data/`` holds immutable shards (Parquet files that are
never rewritten), ``_manifest/v<k>.json`` lists the live shards of version k with
their bytes, rows and run.  An append writes its arrivals as small shards and
commits.  Compaction groups the live runs into tiers by the logarithm of their
size; a tier of FANOUT or more runs is rewritten as one run of target-sized
shards.  A new manifest is written under another name and renamed, and a rename
onto an existing version fails, so of two writers one loses; it reads the newer
version and commits its shards on top of that (an append always can, a merge if
the runs it merged are still live).  Readers open the shards a manifest names, so
they see a whole version; a lost executor costs only its tasks, since nothing
counts before the commit.  The rename must be one step that never replaces, as in
HDFS; on an object store without such a step keep the manifests on a file system
that has it.

Shards are Spark jobs: scan, coalesce to the number of target-sized files, and
write; nothing is shuffled.  The driver holds file metadata only.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.llm.common import fresh, shared_dir, table


@dataclass(frozen=True)
class Policy:
    """Bytes of a full shard; runs of similar size that are merged; the ratio that counts as similar; bytes of the lowest tier."""

    target: int = 128 << 20
    fanout: int = 4
    ratio: float = 4.0
    least: int = 1 << 20


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    run: str


class Conflict(RuntimeError):
    """Another writer was first."""


class Store:
    """A versioned set of immutable shards under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, policy: Policy = Policy()):
        self.spark, self.root, self.policy = spark, root.rstrip("/"), policy
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/_manifest"))

    def version(self) -> int:
        """The newest committed version; 0 before any."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/_manifest"))]
        return max((int(n[1:-5]) for n in names if n[0] == "v" and n.endswith(".json")), default=0)

    def _file(self, version: int) -> str:
        return f"{self.root}/_manifest/v{version}.json"

    def _stored(self, version: int | None) -> dict:
        v = self.version() if version is None else version
        if not v:
            return {}
        stream = self._fs.open(self._path(self._file(v)))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def manifest(self, version: int | None = None) -> list[Shard]:
        return [Shard(**x) for x in self._stored(version).get("shards", [])]

    def schema(self, version: int | None = None) -> StructType | None:
        """The rows' schema, which a version without shards has too; none before any version."""
        found = self._stored(version).get("schema")
        return found and StructType.fromJson(found)

    def commit(self, base: int, shards: list[Shard], schema: StructType | None = None) -> int:
        """Version base + 1, in one step; fails if another writer has it already.  The schema is the base's if not given."""
        if self.version() != base:
            raise Conflict(f"version {base} is no longer the newest")
        before = {s.run for s in self.manifest(base)}
        for run in sorted({s.run for s in shards} - before):
            if not self._fs.exists(self._path(f"{self.root}/data/{run}")):
                raise RuntimeError(f"the shards of {run} are gone")
        schema = schema or self.schema(base)
        draft = self._path(f"{self.root}/_manifest/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps({"version": base + 1, "schema": schema and schema.jsonValue(), "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        final = self._path(self._file(base + 1))
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {base + 1} was committed by another writer")
        return base + 1

    def _written(self, schema: StructType, where: str, depth: int) -> list[Shard]:
        """The shards in a folder of finished files; a run is a folder depth levels below data.  Rows come from the files' own footers, as Spark's metadata column tells them."""
        if not self._fs.exists(self._path(f"{self.root}/{where}")):
            return []
        files: dict[str, int] = {}
        found = self._fs.listFiles(self._path(f"{self.root}/{where}"), True)
        while found.hasNext():
            f = found.next()
            if f.getPath().getName().endswith(".parquet"):
                files["/".join(f.getPath().toString().split("/")[-depth - 1 :])] = f.getLen()
        if not files:
            return []
        name = F.expr(f"array_join(slice(split(_metadata.file_path, '/'), {-depth - 1}, {depth + 1}), '/')")
        lines = self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{x}" for x in sorted({n.rpartition("/")[0] for n in files})))
        rows = {r["name"]: r["n"] for r in lines.groupBy(name.alias("name")).agg(F.count("*").alias("n")).collect()}
        return [Shard(f"data/{n}", size, rows[n], n.rpartition("/")[0]) for n, size in sorted(files.items()) if rows.get(n)]

    def _write(self, df: DataFrame, run: str) -> list[Shard]:
        """df's partitions as the shards of a new run."""
        df.write.parquet(f"{self.root}/data/{run}")
        return self._written(df.schema, f"data/{run}", 1)

    def _add(self, shards: list[Shard], schema: StructType, tries: int = 100) -> int:
        """Commits shards on top of whatever version is the newest."""
        for _ in range(tries):
            base = self.version()
            try:
                return self.commit(base, self.manifest(base) + shards, schema)
            except Conflict:
                time.sleep(0.05)
        raise Conflict(f"{tries} other writers were first")

    def append(self, arrivals: DataFrame) -> int:
        """Arrivals as they are partitioned, one small shard a partition, in one commit."""
        return self._add(self._write(arrivals, f"a{uuid.uuid4().hex[:12]}"), arrivals.schema)

    def append_lots(self, arrivals: DataFrame, lot: Column, n: int) -> Iterator[int]:
        """Lots 0 to n - 1 (a whole number of each row) as one run each, from one scan; each step of the iterator commits the next lot."""
        (name,) = fresh(arrivals, "lot")
        setting, where = "spark.sql.maxConcurrentOutputFileWriters", f"l{uuid.uuid4().hex[:12]}"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, str(n))  # a file a lot is open in each task, so that rows aren't sorted by lot
        try:
            arrivals.withColumn(name, lot.cast("int")).write.partitionBy(name).parquet(f"{self.root}/data/{where}")
        finally:
            self.spark.conf.set(setting, before)
        shards = self._written(arrivals.schema, f"data/{where}", 2)
        for k in range(n):
            yield self._add([s for s in shards if s.run == f"{where}/{name}={k}"], arrivals.schema)

    def tiers(self, shards: list[Shard]) -> dict[int, list[str]]:
        """Runs by tier: how often their bytes hold the lowest tier's, as a power of the ratio."""
        sizes: dict[str, int] = {}
        for s in shards:
            sizes[s.run] = sizes.get(s.run, 0) + s.bytes
        out: dict[int, list[str]] = {}
        for run, size in sorted(sizes.items()):
            out.setdefault(max(0, math.floor(math.log(max(size, 1) / self.policy.least, self.policy.ratio))), []).append(run)
        return out

    def compact(self) -> int:
        """Merges tiers of fanout runs or more, lowest first, until there is none; each merge is one commit.  A merge whose runs another writer merged meanwhile is dropped."""
        while True:
            base = self.version()
            live = self.manifest(base)
            full = [(t, runs) for t, runs in sorted(self.tiers(live).items()) if len(runs) >= self.policy.fanout]
            if not full:
                return base
            gone = set(full[0][1])
            old = [s for s in live if s.run in gone]
            n = max(1, math.ceil(sum(s.bytes for s in old) / self.policy.target))
            merged = self._write(self._read(old, self.schema(base)).coalesce(n), f"m{uuid.uuid4().hex[:12]}")
            while set(old) <= set(live):
                try:
                    self.commit(base, [s for s in live if s.run not in gone] + merged)
                    break
                except Conflict:
                    base = self.version()
                    live = self.manifest(base)

    def vacuum(self, grace: float = 86_400.0) -> None:
        """Deletes, once no reader needs older versions, the shards and manifests of versions before the newest that the newest doesn't name.

        Files that no manifest names may belong to a writer at work; they go when
        they are older than grace seconds, longer than any write takes.
        """
        newest = self.version()
        live = {s.path for s in self.manifest(newest)}
        older = [v for v in range(1, newest) if self._fs.exists(self._path(self._file(v)))]
        dropped = {s.path for v in older for s in self.manifest(v)} - live
        for path in sorted(dropped):
            self._fs.delete(self._path(f"{self.root}/{path}"), False)
        for v in older:
            self._fs.delete(self._path(self._file(v)), False)
        if not self._fs.exists(self._path(f"{self.root}/data")):
            return
        found, late = self._fs.listFiles(self._path(f"{self.root}/data"), True), (time.time() - grace) * 1000
        while found.hasNext():
            f = found.next()
            name = f.getPath().toString().split("/data/")[-1]
            if f.getModificationTime() < late and f"data/{name}" not in live:
                self._fs.delete(f.getPath(), False)

    def _read(self, shards: list[Shard], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{s.path}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, from the shards that its manifest names; without any, no rows of its schema.  Nulls, repeated rows and whatever columns there are come back as they were."""
        shards, schema = self.manifest(version), self.schema(version)
        if schema is None:
            raise ValueError("the store has no version yet")
        return self._read(shards, schema) if shards else self.spark.createDataFrame([], schema)


def op3_sharding(spark: SparkSession, sf_dir: str, lots: int = 8) -> DataFrame:
    """Appends documents in lots by a hash of the id, as they would come in over time, compacts after each four, and reads the newest version back: each row's digest, from the committed shards."""
    store = Store(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", Policy(target=32 << 20))
    for k, _ in enumerate(store.append_lots(table(spark, sf_dir, "documents"), F.pmod(F.xxhash64("doc_id"), F.lit(lots)), lots)):
        if k % store.policy.fanout == store.policy.fanout - 1:
            store.compact()
            store.vacuum()
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", "lang", "source", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


OP3_SQL = """
SELECT doc_id, lang, source, length(coalesce(text, ''))::BIGINT AS n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents
"""
