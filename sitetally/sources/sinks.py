"""Output tables: report, summary and the stored record of an analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_job(table: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite", order: tuple[str, ...] = ()) -> None:
    """One folder per job, rows of a file sorted by ``order``; a hot job spreads over several files.

    ``REBALANCE`` lets adaptive execution split the partitions of large jobs; a rank column tells the order over all files.
    """
    table.hint("rebalance", "job_id").sortWithinPartitions("job_id", *order).write.mode(mode).partitionBy("job_id").format(form).save(path)


def record_rows(sections: dict[str, DataFrame]) -> DataFrame:
    """The record of an analysis as rows (job_id, section, payload JSON).

    One row per entry instead of one document per job: a job of any size is
    stored by many tasks.
    """
    record = None
    for name, table in sections.items():
        fields = [c for c in table.columns if c != "job_id"]
        rows = table.select("job_id", F.lit(name).alias("section"), F.to_json(F.struct(*fields)).alias("payload"))
        record = rows if record is None else record.unionByName(rows)
    return record
