"""Session helpers: checkpoints that survive lost executors, the package on every worker."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that spark.checkpoint.dir names, else one below the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{warehouse}/sitetally-checkpoints")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path on the storage that all machines share."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Spark removes a job's shuffle files when the job ends, else only when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Where "false", rows that are dealt by some keys of a join or group stay where they are; else both sides of a join are dealt anew by all of them.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def written(df: DataFrame, name: str, all_keys: bool = True) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back: a cut that also serves as a columnar copy.

    The shuffle files of the write go with it, nothing else reads them. With ``all_keys`` false, joins take rows as
    ``by_job`` has dealt them.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    wanted = {SHUFFLE_CLEANUP: "true"} if all_keys else {SHUFFLE_CLEANUP: "true", ALL_KEYS: "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one job that a task may take, however few rows the tasks have otherwise.
JOB_ROWS = 1 << 20


def jobs_fit(*tables: DataFrame) -> bool:
    """Whether no job holds more rows of a table than a task's share of it, or than JOB_ROWS; rows with a quantity count as many."""
    parts = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for table in tables:
        n = F.sum(F.coalesce("quantity", F.lit(1)) if "quantity" in table.columns else F.lit(1))
        most, total = table.groupBy("job_id").agg(n.alias("n")).agg(F.max("n"), F.sum("n")).first()
        if (most or 0) > max(JOB_ROWS, (total or 0) // parts):
            return False
    return True


def by_job(df: DataFrame, fit: bool) -> DataFrame:
    """Deal rows by job, once for all joins and groups by job and other keys; where a job is too large for that, each of them deals its rows itself."""
    return df.repartition("job_id") if fit else df


def semi_join(rows: DataFrame, keys: DataFrame, on: list[str], fit: bool) -> DataFrame:
    """Rows whose keys are among the distinct ``keys``, dealt by job where jobs fit."""
    if not fit:
        return rows.join(keys, on, "left_semi")
    # Spark takes a semi join below the dealing of rows, where they would be dealt once more, but not an inner one
    return by_job(rows, fit).join(by_job(keys, fit), on).select(*rows.columns)


def cut_lineage(df: DataFrame) -> DataFrame:
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package; Spark copies the archive to every executor."""
    context = spark.sparkContext
    if getattr(context, "_sitetally_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sitetally-package-")) / "sitetally.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._sitetally_shipped = True

