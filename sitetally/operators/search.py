"""Search in the labels of options: posting lists of short letter runs, built once for any number of searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_token

#: Letters of the longest run; shorter runs serve shorter queries.
RUN = 3
#: Folders of the posting lists: a search reads those of its runs only.
BUCKETS = 256


def letter_runs(label: Column) -> Column:
    """Distinct runs of 1 to RUN letters."""
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(label) - (n - 1))
        return F.when(F.length(label) >= n, F.transform(starts, lambda i: F.substring(label, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*(of(n) for n in range(1, RUN + 1))))


class OptionIndex:
    """``path`` holds ``options`` (job_id, value, label, ord, plain) and ``postings`` (run, job_id, value), both Parquet."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, options: DataFrame, path: str) -> OptionIndex:
        """Index ``options(job_id, ord, value, label)``; blank values are left out, the first row of a value counts.

        A run that many labels hold has a long list; its rows lie in many tasks' files of one folder.
        """
        index = cls(options.sparkSession, path)
        distinct = options.where("value <> ''").groupBy("job_id", "value").agg(F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord"))
        distinct.withColumn("plain", norm_token("label")).write.parquet(f"{index.path}/options")
        postings = index.options().select(F.explode(letter_runs(F.col("plain"))).alias("run"), "job_id", "value")
        postings.withColumn("bucket", F.pmod(F.hash("run"), F.lit(BUCKETS))).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{index.path}/postings")
        return index

    def options(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/options")

    def search(self, query: str) -> DataFrame:
        """(job_id, value, label, ord) of the options whose normalised label holds the normalised query; a blank query finds all."""
        wanted = self.spark.range(1).select(norm_token(F.lit(query.strip())).alias("q")).first()["q"]
        every = self.options()
        if not wanted:
            return every.drop("plain")
        runs = sorted({wanted[i : i + RUN] for i in range(max(1, len(wanted) - RUN + 1))})
        buckets = [r[0] for r in self.spark.createDataFrame([(r,) for r in runs], "run string").select(F.pmod(F.hash("run"), F.lit(BUCKETS))).collect()]
        lists = self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(buckets) & F.col("run").isin(runs))
        holding_all = lists.groupBy("job_id", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(runs))
        return every.join(holding_all, ["job_id", "value"], "left_semi").where(F.contains(F.col("plain"), F.lit(wanted))).drop("plain")
