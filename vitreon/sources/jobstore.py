"""A job table on Parquet: every change commits a version, reads see the last one of each job."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..schemas import JOBS

STATUSES = ("pending", "running", "completed", "failed", "cancelled")
#: Structures inside results and exports.
ATOMS = "array<struct<element: string, x: double, y: double, z: double>>"


#: Commits after which a writer adds a snapshot.
SNAPSHOT_AFTER = 20


class Conflict(RuntimeError):
    """Other writers were faster too many times."""


class JobStore:
    """Jobs under a path that all executors reach, as a log of commits.

    A commit is a small file, numbered on, that names a folder of rows (new versions of jobs); whoever creates it first has made that
    commit, anyone else reads on and tries again with the next number. So two writers never give one version twice, and a writer
    that fails before its commit has changed nothing. Every so many commits the last version of every job is written as a
    snapshot; reads see the last snapshot and the commits after it.
    """

    def __init__(self, spark: SparkSession, path: str, snapshot_after: int = SNAPSHOT_AFTER, tries: int = 50):
        self.spark, self.path, self.snapshot_after, self.tries = spark, path.rstrip("/"), snapshot_after, tries
        self.schema = spark.createDataFrame([], JOBS).schema
        self.names = [f.name for f in self.schema]

    # --- the log ---

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        path, fs = self._fs()
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()) if fs.exists(path) else []

    def _entry(self, n: int) -> dict:
        path, fs = self._fs()
        stream = fs.open(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"{n:020d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, n: int, entry: dict) -> bool:
        """Create commit n; False if it is there already."""
        from py4j.protocol import Py4JJavaError

        path, fs = self._fs()
        jvm = self.spark.sparkContext._jvm
        mine = jvm.org.apache.hadoop.fs.Path(path, f"{n:020d}")
        try:
            out = fs.create(mine, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or fs.exists(mine):
                return False
            raise
        out.write(json.dumps(entry).encode())
        out.close()
        return True

    def _tail(self) -> tuple[int, list[dict]]:
        """The last commit's number, and the entries that reads need: the last snapshot and those after it."""
        have = self.commits()
        out: list[dict] = []
        for n in reversed(have):
            out.append(self._entry(n))
            if out[-1]["snapshot"]:
                break
        return (have[-1] if have else 0), out[::-1]

    def _rows(self, entries: list[dict]) -> DataFrame:
        paths = [e["data"] for e in entries if e["data"]]
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*paths).select(*self.names) if paths else self.spark.createDataFrame([], self.schema)

    def _stored(self, rows: DataFrame) -> str:
        path = f"{self.path}/data/rows={uuid.uuid4().hex}"
        rows.select(*self.names).withColumn("day", F.to_date("created_at")).write.partitionBy("day").parquet(path)
        return path

    def _commit(self, make: Callable[[DataFrame], DataFrame | None], note: dict | None = None) -> bool:
        """Commit the rows that make gives for the last versions of all jobs; False, without a commit, if it gives None."""
        for _ in range(self.tries):
            n, entries = self._tail()
            rows = make(self._latest(self._rows(entries)))
            if rows is None:
                return False
            if self._put(n + 1, {"data": self._stored(rows), "snapshot": False, **(note or {})}):
                if len(entries) >= self.snapshot_after:
                    self.compact()
                return True
        raise Conflict(f"no commit in {self.tries} tries")

    def compact(self) -> bool:
        """Add a snapshot of the last versions; False if another writer was faster."""
        n, entries = self._tail()
        return self._put(n + 1, {"data": self._stored(self._latest(self._rows(entries))), "snapshot": True})

    # --- jobs ---

    def _latest(self, versions: DataFrame) -> DataFrame:
        return J.latest(versions, ["job_id"], [F.col("version")]).select(*self.names)

    def versions(self) -> DataFrame:
        """The versions that the last snapshot and the commits after it hold."""
        return self._rows(self._tail()[1])

    def jobs(self) -> DataFrame:
        return self._latest(self.versions())

    def _new(self, jobs: DataFrame) -> DataFrame:
        have = dict(jobs.dtypes)
        cols = []
        for field in self.schema:
            c = F.col(field.name) if field.name in have else F.lit(None)
            if field.name == "version":
                c = F.lit(1)
            if field.name == "created_at":
                c = F.coalesce(c.cast("timestamp"), F.current_timestamp())
            cols.append(c.cast(field.dataType).alias(field.name))
        return jobs.select(*cols)

    def create(self, jobs: DataFrame) -> None:
        """New jobs; missing columns are null, the version is 1, created_at is now unless given. An id that exists raises."""

        def make(old: DataFrame) -> DataFrame:
            if not old.join(jobs.select("job_id"), "job_id", "left_semi").isEmpty():
                raise ValueError("a job of that id exists")
            return self._new(jobs)

        self._commit(make)

    def submit(self, requests: DataFrame, compositions: DataFrame, batch: str, force: bool = False) -> DataFrame:
        """plans.submit's rows; new jobs and changed tags are one commit, which names the batch and where its rows are kept.

        A batch that has been committed gives its rows again: whoever isn't sure that a submission went through repeats it.
        """
        from ..plans.submit import submit

        kept = f"{self.path}-batches/{batch}-{uuid.uuid4().hex}"

        def make(old: DataFrame) -> DataFrame | None:
            if self._batch(batch):
                return None
            submit(requests, compositions, old, batch, force).write.mode("overwrite").parquet(kept)
            out = self.spark.read.parquet(kept)
            request = F.to_json(F.struct("composition", "potential", "density", "settings"))
            new = out.where("error is null and not hit").select("job_id", "request_hash", "composition", "potential", "status", "tags", request.alias("request_data"))
            # several requests may hit one job
            more = out.where("hit").groupBy("job_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("_tags"))
            changed = old.join(more, "job_id").where(~F.col("_tags").eqNullSafe(J.merged_tags(F.col("tags"))))
            return self._new(new).unionByName(changed.withColumns({"tags": F.col("_tags"), "version": F.col("version") + 1}).select(*self.names))

        self._commit(make, {"batch": batch, "kept": kept})
        return self.spark.read.parquet(self._batch(batch))

    def _batch(self, batch: str) -> str | None:
        """Where the rows of a committed batch are kept; its commit may be older than the last snapshot."""
        return next((e["kept"] for e in map(self._entry, reversed(self.commits())) if e.get("batch") == batch), None)

    def get(self, job_id: str) -> DataFrame:
        return self._latest(self.versions().where(F.col("job_id") == job_id))

    def update(self, job_id: str, **fields: object) -> bool:
        """Append a version with these fields; nothing happens, and False is returned, if the job is unknown."""
        if (s := fields.get("status")) is not None and s not in STATUSES:
            raise ValueError(f"unknown status: {s}")
        return self._change(job_id, fields, F.lit(True))

    def _change(self, job_id: str, fields: dict, where: Column) -> bool:
        kinds = {f.name: f.dataType for f in self.schema}
        cols = {k: (v if isinstance(v, Column) else F.lit(v)).cast(kinds[k]) for k, v in fields.items()}

        def make(old: DataFrame) -> DataFrame | None:
            one = old.where((F.col("job_id") == job_id) & where)
            return None if one.isEmpty() else J.append(one, job_id, cols).select(*self.names)

        return self._commit(make)

    def cancel(self, job_id: str) -> bool:
        """Cancel a pending or running job; False for any other, also if it has ended meanwhile."""
        return self._change(job_id, {"status": "cancelled"}, F.col("status").isin("pending", "running"))

    def find_by_hash(self, request_hash: str) -> DataFrame:
        return self.jobs().where(F.col("request_hash") == request_hash).orderBy(F.desc("created_at"), "job_id")

    def find_completed_by_hash(self, request_hash: str) -> DataFrame:
        return self.find_by_hash(request_hash).where("status = 'completed' and result_data is not null").limit(1)

    def search_by_composition(self, composition: str, potential: str | None = None) -> DataFrame:
        return J.by_composition(self.jobs(), composition, potential)

    def list_compositions(self) -> DataFrame:
        return J.composition_counts(self.jobs())

    def completed_vectors(self, potential: str | None = None) -> DataFrame:
        df = self.jobs().where("status = 'completed' and elemental_vector is not null")
        df = df if potential is None else df.where(F.col("potential") == potential)
        return df.select("job_id", "elemental_vector", "composition", "potential", "result_data", "completed_at")

    def tags(self, ids: DataFrame) -> DataFrame:
        """job_id, tags (empty if none) of the ids that exist."""
        return self.jobs().join(ids.select("job_id").distinct(), "job_id", "left_semi").select("job_id", J.merged_tags(F.col("tags")).alias("tags"))

    def set_tags(self, job_id: str, tags: list[str]) -> None:
        self.update(job_id, tags=F.lit(sorted(set(tags))) if tags else F.array())

    def clear_results(self, request_hash: str) -> None:
        """Forget the results of a hash, so that the next request computes anew."""

        def make(old: DataFrame) -> DataFrame | None:
            last = old.where((F.col("request_hash") == request_hash) & F.col("result_data").isNotNull())
            return None if last.isEmpty() else last.withColumns({"result_data": F.lit(None).cast("string"), "version": F.col("version") + 1})

        self._commit(make)

    def lookup(self, composition: str, wanted: list[str]) -> DataFrame:
        """The newest completed job of a composition and the analyses that its results (a JSON object) lack."""
        last = self.search_by_composition(composition).limit(1)
        have = F.coalesce(F.json_object_keys("result_data"), F.array().cast("array<string>"))
        return last.select("job_id", "result_data", J.missing(have, wanted).alias("missing"))


def serialize(atoms: DataFrame) -> DataFrame:
    """structure_id, frame, atoms as JSON in order of atom_id."""
    item = F.struct("atom_id", "element", "x", "y", "z")
    one = atoms.groupBy("structure_id", "frame").agg(F.array_sort(F.collect_list(item)).alias("l"))
    return one.select("structure_id", "frame", F.to_json(F.transform("l", lambda a: F.struct(a["element"].alias("element"), a["x"].alias("x"), a["y"].alias("y"), a["z"].alias("z")))).alias("atoms"))


def deserialize(rows: DataFrame) -> DataFrame:
    """atoms of serialize()'s rows, numbered from 1; text that isn't such JSON gives no atoms."""
    one = rows.select("structure_id", "frame", F.posexplode(F.from_json("atoms", ATOMS)).alias("k", "a"))
    return one.select("structure_id", "frame", (F.col("k") + 1).cast("bigint").alias("atom_id"), "a.*")
