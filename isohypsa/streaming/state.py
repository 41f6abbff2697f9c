"""State of a stream as an ordinary table: a row per key, in folders by the hash of the key.

A micro-batch joins the rows of its own keys, and rewrites the folders that they are in by dynamic partition overwrite. Every row keeps the number of the batch
that changed it last and its value before that, so a repeated batch, also one that broke off between two folders, starts from the values that it
started from the first time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohypsa.staging import exists, stage


@dataclass(frozen=True)
class StateTable:
    """Rows (key and values, as in ``schema``) under ``root``. ``buckets``, the number of folders, belongs to the table: take one for each few million keys, so that a
    folder stays small while the table grows."""

    spark: SparkSession
    root: str
    key: str
    schema: T.StructType
    buckets: int = 64

    def _values(self) -> list[str]:
        return [f.name for f in self.schema.fields if f.name != self.key]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _rows(self) -> DataFrame:
        value = T.StructType([f for f in self.schema.fields if f.name != self.key])
        stored = T.StructType([self.schema[self.key], T.StructField("batch", T.LongType()), T.StructField("now", value), T.StructField("was", value), T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(stored).parquet(self.root) if exists(self.spark, self.root) else self.spark.createDataFrame([], stored)

    def _keys(self, batch: DataFrame) -> DataFrame:
        return batch.select(self.key).where(F.col(self.key).isNotNull()).distinct().withColumn("bucket", self._bucket())

    def _plain(self, rows: DataFrame, value: Column) -> DataFrame:
        return rows.withColumn("v", value).where("v IS NOT NULL").select(self.key, *[F.col(f"v.{c}").alias(c) for c in self._values()])

    def create(self, initial: DataFrame) -> None:
        """Start with rows, unless the table is there already."""
        if not exists(self.spark, self.root):
            value = F.struct(*self._values())
            rows = initial.select(self.key, F.lit(-1).cast("bigint").alias("batch"), value.alias("now"), F.when(F.lit(False), value).alias("was"), self._bucket().alias("bucket"))
            rows.repartition("bucket").write.partitionBy("bucket").parquet(self.root)

    def current(self) -> DataFrame:
        """The newest value of every key."""
        return self._plain(self._rows(), F.col("now"))

    def keys(self, batch: DataFrame) -> DataFrame:
        """The keys of a batch, written once: ``before`` and ``write`` both need them."""
        return stage(self._keys(batch), "state-keys")

    def before(self, n: int, batch: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        """The values that the keys of a batch had before it; only the folders of these keys are read."""
        mine = self._rows().join(self._keys(batch) if keys is None else keys, ["bucket", self.key], "left_semi")
        return self._plain(mine, F.when(F.col("batch") >= n, F.col("was")).otherwise(F.col("now")))

    def write(self, n: int, batch: DataFrame, after: DataFrame, keys: DataFrame | None = None) -> None:
        """Give the keys of batch n their values in ``after``; a key without a row there loses its value. ``keys`` are those of the batch, if they are at hand.

        The stored rows meet the new values once: a row without one stays as it is, one with it moves its value before the batch to ``was``."""
        keys = self.keys(batch) if keys is None else keys
        new = keys.join(after.select(self.key, F.struct(*self._values()).alias("new")), self.key, "left").withColumn("mine", F.lit(True))
        # a row that had lost its value before the batch is none for its key and need not be kept
        touched = F.broadcast(keys.select("bucket").distinct())  # no more than there are folders
        old = self._rows().join(touched, "bucket", "left_semi").where((F.col("batch") >= n) | F.col("now").isNotNull())
        mine = F.col("mine").isNotNull()
        rows = old.join(new, ["bucket", self.key], "full_outer").select(
            self.key, F.when(mine, F.lit(n).cast("bigint")).otherwise(F.col("batch")).alias("batch"), F.when(mine, F.col("new")).otherwise(F.col("now")).alias("now"),
            F.when(mine, F.when(F.col("batch") >= n, F.col("was")).otherwise(F.col("now"))).otherwise(F.col("was")).alias("was"), "bucket",
            mine.alias("mine")).where("now IS NOT NULL OR mine AND was IS NOT NULL").drop("mine")
        # written aside first: the folders are read until then
        rows = stage(rows, "state-rows")
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.root)
