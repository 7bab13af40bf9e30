"""The index as Parquet tables under one root, committed a repository at a time.

    data/<repository>/<version>/<table>   written once, never changed
    manifests/<repository>/<number>.json  which version of each table is current
    runs/<write>, repositories/<write>    rows are appended; reads reduce them by id

A manifest is created only if its number isn't taken, so of two writers one
comes first and the other commits on top of it; readers see the tables of one
manifest, whole. A write that stops before its commit leaves the index as it was.
Versions that neither of the last two manifests names are deleted after a commit.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import VECTOR_PARTS
from ..streaming.jobs import reduce_runs

TABLES = ("files", "symbols", "edges", "units", "embeddings", "postings", "grams", "adjacency", "touches", "branches")
PARTS = {"postings": ("bucket",), "grams": ("bucket",), "adjacency": ("way", "bucket"), "embeddings": ("part",)}
"""What a table is partitioned by within its version."""
RUN_SCHEMA = "id string, repository_id string, source string, status string, stage string, error string, started_at long, finished_at long"
REPOSITORY_SCHEMA = "id string, name string, url string, branch string, commit_sha string, created_at long, line_count long"
KEPT = 2
LEASE_SECONDS = 3600


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    # files of a few bytes, on whatever file system the root is on

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _create(self, path: str, text: str) -> bool:
        """Write a small file unless it is there: False if it is."""
        where, fs = self._fs(path)
        try:
            out = fs.create(where, False)
        except Py4JJavaError as problem:
            if fs.exists(where):
                return False
            raise problem
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _read(self, path: str) -> str | None:
        where, fs = self._fs(path)
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _names(self, path: str) -> list[str]:
        where, fs = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def _delete(self, path: str) -> None:
        where, fs = self._fs(path)
        fs.delete(where, True)

    # versions

    def _numbers(self, repository_id: str) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names(self.path("manifests", repository_id)) if n.endswith(".json"))

    def manifest(self, repository_id: str) -> dict[str, str]:
        """Table -> its folder below the root, of the newest manifest."""
        numbers = self._numbers(repository_id)
        text = self._read(self.path("manifests", repository_id, f"{numbers[-1]:08d}.json")) if numbers else None
        return json.loads(text) if text else {}

    def write(self, repository_id: str, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Write tables as a version that no reader sees yet."""
        version, made = uuid.uuid4().hex, {}
        for name, rows in tables.items():
            where = f"data/{repository_id}/{version}/{name}"
            writer = rows.withColumn("part", F.col("bucket") % VECTOR_PARTS) if name == "embeddings" else rows
            writer.write.partitionBy(*PARTS.get(name, ())).parquet(self.path(where))
            made[name] = where
        return made

    def commit(self, repository_id: str, made: dict[str, str]) -> int:
        """Make tables current, beside those of the manifest before: its number."""
        while True:
            numbers = self._numbers(repository_id)
            number = numbers[-1] + 1 if numbers else 1
            if self._create(self.path("manifests", repository_id, f"{number:08d}.json"), json.dumps({**self.manifest(repository_id), **made})):
                self._clear(repository_id)
                return number

    def _clear(self, repository_id: str) -> None:
        numbers = self._numbers(repository_id)
        kept = [json.loads(self._read(self.path("manifests", repository_id, f"{n:08d}.json")) or "{}") for n in numbers[-KEPT:]]
        used = {where.split("/")[2] for m in kept for where in m.values()}
        older = [json.loads(self._read(self.path("manifests", repository_id, f"{n:08d}.json")) or "{}") for n in numbers[:-KEPT]]
        # only what an older manifest named: a version without one may be another writer's, still under way
        for version in {where.split("/")[2] for m in older for where in m.values()} - used:
            self._delete(self.path("data", repository_id, version))
        for n in numbers[:-KEPT]:
            self._delete(self.path("manifests", repository_id, f"{n:08d}.json"))

    def save(self, table: str, rows: DataFrame, repository_id: str) -> None:
        """Replace one table of a repository."""
        self.commit(repository_id, self.write(repository_id, {table: rows}))

    def has(self, table: str, repository_id: str | None = None) -> bool:
        owners = self._names(self.path("manifests")) if repository_id is None else [repository_id]
        return any(table in self.manifest(r) for r in owners)

    def load(self, table: str, repository_id: str, parts: bool = False) -> DataFrame:
        """One repository's rows: the current version of it and nothing else; with ``parts`` the column that prunes embeddings stays."""
        where = self.manifest(repository_id).get(table)
        if where is None:
            raise LookupError(f"no table {table} of {repository_id}")
        rows = self.spark.read.parquet(self.path(where))
        return rows if parts else rows.drop("part")

    def everything(self, table: str) -> DataFrame:
        """The rows of all repositories, with repository_id."""
        out = None
        for owner in sorted(self._names(self.path("manifests"))):
            if table in self.manifest(owner):
                rows = self.load(table, owner).withColumn("repository_id", F.lit(owner))
                out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise LookupError(f"no table {table}")
        return out

    # rows by id: appended, so that no writer undoes another's

    def append(self, table: str, rows: DataFrame) -> None:
        # a folder for each write: writers to one folder would clear each other's temporary files
        now = time.time_ns()
        rows.withColumn("written_at", F.lit(now)).coalesce(1).write.parquet(self.path(table, f"{now:020d}-{uuid.uuid4().hex}"))

    def compact(self, table: str) -> None:
        """Put the folders of a table of appended rows into one; for times without readers."""
        folders = self._names(self.path(table))
        rows = self.spark.read.parquet(*[self.path(table, f) for f in folders])
        rows.coalesce(1).write.parquet(self.path(table, f"{time.time_ns():020d}-{uuid.uuid4().hex}"))
        for folder in folders:
            self._delete(self.path(table, folder))

    def latest(self, table: str, schema: str) -> DataFrame:
        try:
            rows = self.spark.read.schema(f"{schema}, written_at long").parquet(self.path(table, "*"))
        except AnalysisException:
            return self.spark.createDataFrame([], schema)
        if table == "runs":
            return reduce_runs(rows, "written_at")
        rest = [c for c in rows.columns if c not in ("id", "written_at")]
        last = rows.groupBy("id").agg(F.max_by(F.struct(*rest), "written_at").alias("last"))
        return last.select("id", "last.*")

    def save_run(self, rows: DataFrame) -> None:
        self.append("runs", rows)

    def save_repository(self, rows: DataFrame) -> None:
        self.append("repositories", rows)

    def repositories(self) -> DataFrame:
        return self.latest("repositories", REPOSITORY_SCHEMA)

    def by_url(self, url: str) -> DataFrame:
        """The latest repository of a URL."""
        return self.repositories().where(F.col("url") == url).orderBy(F.desc("created_at"), "id").limit(1)

    # claims: one run at a time for a source

    def claim(self, source: str, run_id: str, now: float | None = None) -> str:
        """The run that works on a source: ``run_id`` if it could take the claim, else the one that holds it.

        Claims are numbered files, each created only if absent. A new one may be taken when the newest was given
        back, or wasn't within ``LEASE_SECONDS``.
        """
        now = time.time() if now is None else now
        folder = self.path("claims", uuid.uuid5(uuid.NAMESPACE_URL, source).hex)
        while True:
            taken = sorted(n for n in self._names(folder) if n.endswith(".json"))
            if taken:
                newest = json.loads(self._read(f"{folder}/{taken[-1]}") or "{}")
                done = taken[-1].replace(".json", ".done") in self._names(folder)
                if newest and not done and now - newest["at"] < LEASE_SECONDS:
                    return newest["run_id"]
                if not newest and not done:
                    time.sleep(0.05)  # being written this moment
                    continue
            number = int(taken[-1].removesuffix(".json")) + 1 if taken else 1
            if self._create(f"{folder}/{number:08d}.json", json.dumps({"run_id": run_id, "at": now})):
                for old in taken[:-1]:
                    self._delete(f"{folder}/{old}")
                    self._delete(f"{folder}/{old.replace('.json', '.done')}")
                return run_id

    def release(self, source: str, run_id: str) -> None:
        folder = self.path("claims", uuid.uuid5(uuid.NAMESPACE_URL, source).hex)
        taken = sorted(n for n in self._names(folder) if n.endswith(".json"))
        if taken and json.loads(self._read(f"{folder}/{taken[-1]}") or "{}").get("run_id") == run_id:
            self._create(f"{folder}/{taken[-1].replace('.json', '.done')}", "")


def migrate(old: DataFrame, renamed: dict[str, str], added: dict[str, str]) -> DataFrame:
    """Rows of an older schema under the new one: columns renamed and added empty."""
    out = old.withColumnsRenamed({a: b for a, b in renamed.items() if a in old.columns})
    return out.withColumns({name: F.lit(None).cast(kind) for name, kind in added.items() if name not in out.columns})
