"""Reference counts maintained from streams of deltas, and late-aware counts per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarmacade.operators.orphans import apply_deltas
from tarmacade.session import cut_lineage

#: Parts of a table of counts; a batch reads and writes only those that its keys fall into.
PARTS = 256
_COLUMNS = ("kind", "key", "refs", "exists", "first_arrival", "first_ref")


_SCHEMA = "kind string, key string, refs long, exists long, first_arrival timestamp_ntz, first_ref timestamp_ntz, applied long, part int"
#: A row of this kind stands in every part and tells the last batch the part has had.
_MARK = "#part"


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """The table of counts in a folder, or an empty one where nothing has been counted yet."""
    return _kept(spark, folder).where(F.col("kind") != _MARK).select(*_COLUMNS)


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(folder)


def maintain_counts(deltas: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Adds each batch of deltas to the table of counts in `folder`, part by part.

    The table is partitioned by the hash of the key. A batch replaces only the parts that it
    touches, so its cost follows its own keys and not the whole state; keys that nothing refers
    to, that don't exist and never arrived are dropped. Each part carries the number of the last
    batch it has had: a batch that is run again after a failure leaves alone the parts that
    already have it, so deltas count once. A folder belongs to one stream.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed = cut_lineage(batch.select(*_COLUMNS, F.pmod(F.xxhash64("kind", "key"), F.lit(PARTS)).cast("int").alias("part")))
        touched = [r["part"] for r in placed.select("part").distinct().collect()]  # at most PARTS numbers
        held = _kept(spark, folder).where(F.col("part").isin(touched))
        done = {r["part"] for r in held.where((F.col("kind") == _MARK) & (F.col("applied") >= number)).select("part").collect()}
        left = [p for p in touched if p not in done]
        if not left:
            return
        open_ = F.col("part").isin(left)
        added = apply_deltas(placed.where(open_).select(*_COLUMNS), held.where(open_ & (F.col("kind") != _MARK)).select(*_COLUMNS))
        kept = added.where("refs <> 0 or exists <> 0 or first_arrival is not null")
        out = kept.select(*_COLUMNS, F.lit(number).cast("long").alias("applied"), F.pmod(F.xxhash64("kind", "key"), F.lit(PARTS)).cast("int").alias("part"))
        marks = spark.createDataFrame([(_MARK, None, 0, 0, None, None, number, p) for p in left], _SCHEMA)
        # Written down before the parts it was read from are replaced.
        cut_lineage(out).unionByName(marks).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(folder)

    return deltas.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(rows: DataFrame, time: str, group: str, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """(start, group, n): rows per window, final once the watermark has passed."""
    counted = rows.withWatermark(time, lateness).groupBy(F.window(time, window), group).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), group, "n")
