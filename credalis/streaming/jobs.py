"""Two streams over an append-only log of answers.

The ingest keeps the newest entry of every key, however late a repeat comes, as the batch
ingest does. Its state holds one entry for each distinct key, in a state store on disk; each
batch writes the keys it changed, and the newest batch of a key counts. Windows are emitted
once, when the watermark has passed, and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from credalis.sources.call_log import parse_lines


def read_log_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Log lines of a growing folder; each trigger takes a bounded number of files."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def answered_calls(lines: DataFrame) -> DataFrame:
    """Well-formed log entries with their event time ``ts``."""
    good = parse_lines(lines).filter("ok").drop("ok", "value")
    return good.withColumn("ts", F.timestamp_seconds("timestamp"))


ON_DISK = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
"""Settings of a session whose streams remember many keys."""


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the start of a query, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def write_changes(latest: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the keys that each batch changed, and stop when the available input is processed.

    ``latest`` is a stream of one row a key, as ``call_log.last_per_key`` gives. A batch that
    runs again after a failure overwrites its own folder. A restart with the same checkpoint
    continues where the last run ended.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with settings(latest.sparkSession, ON_DISK):
        return (
            latest.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )


def current_rows(spark: SparkSession, out: str, schema: T.StructType, key: str = "key") -> DataFrame:
    """The newest row of each key from what ``write_changes`` wrote."""
    changes = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    rest = [c for c in schema.names if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(key, "_r.*")


def window_calibration(
    answers: DataFrame, time: str = "ts", confidence: str = "p_max", correct: str = "correct",
    width: str = "1 day", slide: str | None = None, delay: str = "1 hour", bins: int = 10, keys: tuple[str, ...] = (),
) -> DataFrame:
    """Per event-time window and confidence bin: count, confidence sum and correct count.

    Sums, not ratios, leave the stream, so the binned error is finished downstream
    without a second stateful step.
    """
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = answers.withWatermark(time, delay).groupBy(w.alias("w"), *keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(confidence).alias("s"), F.sum(F.col(correct).cast("double")).alias("k")
    )
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "bin", "n", "s", "k")


def finish_calibration(sums: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, mean confidence, gap and binned error per window from emitted sums."""
    return sums.groupBy("start", *keys).agg(
        F.sum("n").alias("n"), (F.sum("k") / F.sum("n")).alias("accuracy"), (F.sum("s") / F.sum("n")).alias("mean_confidence"),
        ((F.sum("s") - F.sum("k")) / F.sum("n")).alias("gap"), (F.sum(F.abs(F.col("k") - F.col("s"))) / F.sum("n")).alias("ece"),
    )


def write_stream(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet and stop when the available input is processed.

    A restart with the same checkpoint continues where the last run ended.
    """
    return (
        df.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
