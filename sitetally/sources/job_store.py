"""A table of many jobs on shared storage, read and replaced job by job.

Rows lie in files clustered by job, a few jobs or a part of one in each, however many jobs there are. An index table says
which files hold a job's present rows. Writing a job again adds files and index rows and touches no others; its old rows
stay in files that the index no longer names for it, until ``compact`` drops them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a file, so that one job's rows are few of a file's or fill files of their own.
FILE_ROWS = 1 << 20
INDEX = "job_id bigint, version bigint, file string, n bigint"


class JobStore:
    """``path`` holds ``data`` (one folder a write) and ``index``; both are Parquet. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _index_rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(INDEX).parquet(f"{self.path}/index")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], INDEX)

    def index(self) -> DataFrame:
        """(job_id, version, file, n): the files of each job's last write; a deleted job has none."""
        last = Window.partitionBy("job_id").orderBy(F.desc("version"))
        ranked = self._index_rows().withColumn("_rank", F.rank().over(last))
        return ranked.where("_rank = 1 and file is not null").drop("_rank")

    def _next_version(self) -> int:
        return (self._index_rows().agg(F.max("version")).first()[0] or 0) + 1

    def _add_to_index(self, rows: DataFrame, mode: str = "append") -> None:
        rows.repartitionByRange("job_id").sortWithinPartitions("job_id").write.mode(mode).parquet(f"{self.path}/index")

    def write(self, table: DataFrame, order: tuple[str, ...] = (), replaced: DataFrame | None = None) -> None:
        """Make ``table`` the rows of its jobs. Jobs of ``replaced(job_id)`` without a row in table become empty.

        Ranges of (job, order) go to files of about FILE_ROWS rows; a job larger than that spreads over several.
        """
        version, folder = self._next_version(), f"{self.path}/data/{uuid.uuid4().hex}"
        files = max(1, -(-table.count() // FILE_ROWS))
        table.repartitionByRange(files, "job_id", *order).sortWithinPartitions("job_id", *order).write.parquet(folder)
        written = self.spark.read.schema(table.schema).parquet(folder)
        held = written.groupBy(F.col("job_id").cast("bigint").alias("job_id"), F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
        rows = held.select("job_id", F.lit(version).cast("bigint").alias("version"), "file", "n")
        if replaced is not None:
            gone = replaced.select(F.col("job_id").cast("bigint").alias("job_id")).distinct().join(rows.select("job_id").distinct(), "job_id", "left_anti")
            rows = rows.unionByName(gone.select("job_id", F.lit(version).cast("bigint").alias("version"), F.lit(None).cast("string").alias("file"), F.lit(0).cast("bigint").alias("n")))
        self._add_to_index(rows)

    def delete(self, jobs: DataFrame) -> None:
        """Leave the jobs of ``jobs(job_id)`` without rows; what they had stays unread in its files."""
        version = F.lit(self._next_version()).cast("bigint").alias("version")
        self._add_to_index(jobs.select(F.col("job_id").cast("bigint").alias("job_id")).distinct().select(
            "job_id", version, F.lit(None).cast("string").alias("file"), F.lit(0).cast("bigint").alias("n")))

    def _schema(self):
        first = self._index_rows().where("file is not null").select("file").first()
        return None if first is None else self.spark.read.parquet(first["file"]).schema

    def read(self) -> DataFrame | None:
        """The present rows of all jobs; None before the first write. Files keep rows of the jobs that the index names for them."""
        schema = self._schema()
        if schema is None:
            return None
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/data")
        named = self.index().select(F.col("job_id").alias("_job"), F.col("file").alias("_file"))
        present = (F.col("job_id").cast("bigint") == F.col("_job")) & (F.col("_from") == F.col("_file"))
        return rows.withColumn("_from", F.col("_metadata.file_path")).join(named, present, "left_semi").drop("_from")

    def read_job(self, job_id: int) -> DataFrame | None:
        """The present rows of one job, from its files only; row groups of other jobs are skipped by their bounds."""
        index = self._index_rows().where(F.col("job_id") == job_id)
        rows = index.where(F.col("version") == (index.agg(F.max("version")).first()[0] or 0)).where("file is not null").collect()
        schema = self._schema()
        if schema is None:
            return None
        if not rows:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(r["file"] for r in rows)).where(F.col("job_id") == job_id)

    def compact(self, order: tuple[str, ...] = ()) -> JobStore:
        """A store beside this one that holds the present rows only, clustered anew; readers change over when it is complete."""
        fresh = JobStore(self.spark, f"{self.path}-{uuid.uuid4().hex}")
        rows = self.read()
        if rows is not None:
            fresh.write(rows, order)
        return fresh
