"""What the training-data operators share: table readers, Arrow batches of a bounded size, text as bytes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package, use_checkpoint_dir, written  # noqa: F401

#: Rows in one Arrow batch: texts may be long, so batches hold few; a batch ends at either bound.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20
#: A word: the characters between ASCII white space; bytes.split() cuts at just these.
WORD = "[^\\x20\\x09-\\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Shared folder, package on the workers, small Arrow batches."""
    use_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def code_points(data: bytes) -> int:
    return len(data.decode("utf-8", "replace"))
