"""Streaming queries, run over the events table until its input is used up, and SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalis.functions import sql as SQLF
from credalis.plans.catalog import query
from credalis.plans.q_rank import rnd
from credalis.plans.q_sources import LAST, event_log
from credalis.plans.views import Tables
from credalis.session import scratch_dir
from credalis.sources import call_log
from credalis.streaming import jobs


def event_stream(t: Tables) -> DataFrame:
    """The events table as a file stream."""
    reader = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet")
    return reader.parquet(t.sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def run(t: Tables, df: DataFrame) -> DataFrame:
    """Run a stream to its end and read what it wrote."""
    base = scratch_dir(t.spark)
    jobs.write_stream(df, f"{base}/out", f"{base}/state").awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{base}/out")


def run_latest(t: Tables, latest: DataFrame) -> DataFrame:
    """Run a stream of newest rows to its end and read the rows that count."""
    base = scratch_dir(t.spark)
    jobs.write_changes(latest, f"{base}/out", f"{base}/state").awaitTermination()
    return jobs.current_rows(t.spark, f"{base}/out", latest.schema)


@query("stream_ingest", "SELECT DISTINCT user_id || '-' || event_type AS key FROM events")
def stream_ingest(t: Tables) -> DataFrame:
    """One row per key leaves the stream."""
    e = event_stream(t).select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("ts").cast("double").alias("timestamp"),
        F.col("event_id").cast("string").alias("request_id"), F.lit("").alias("response"),
    )
    return run_latest(t, call_log.last_per_key(e)).select("key")


@query("stream_last_calls", f"SELECT key, event_id::DOUBLE AS timestamp, CAST(event_id AS VARCHAR) AS request_id, round(value / 10, 8) AS latency_s FROM ({LAST})")
def stream_last_calls(t: Tables) -> DataFrame:
    """The call log as a growing folder of many files, taken a few at a time: the newest entry of each key, as the batch ingest keeps."""
    folder = f"{scratch_dir(t.spark)}/log"
    event_log(t).repartition(12, "value").write.text(folder)
    calls = jobs.answered_calls(jobs.read_log_stream(t.spark, folder, max_files=5))
    done = run_latest(t, call_log.last_per_key(calls))
    return done.select("key", "timestamp", "request_id", F.round("latency_s", 8).alias("latency_s"))


@query(
    "stream_calibration",
    """WITH e AS (SELECT date_trunc('day', ts) AS start, 0.5 + value / 1000 AS p, event_type <> 'error' AS ok FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
       b AS (SELECT start, least(floor(p * 10), 9) AS bin, count(*) AS n, sum(p) AS s, sum(ok::INT) AS k FROM e GROUP BY 1, 2)
       SELECT strftime(start, '%Y-%m-%d') AS day, sum(n)::BIGINT AS n, round(sum(k) / sum(n), 8) AS accuracy, round(sum(s) / sum(n), 8) AS mean_confidence, round((sum(s) - sum(k)) / sum(n), 8) AS gap, round(sum(abs(k - s)) / sum(n), 8) AS ece FROM b GROUP BY 1""",
)
def stream_calibration(t: Tables) -> DataFrame:
    """Daily calibration; windows the watermark has not closed are not emitted."""
    e = event_stream(t).select("ts", (F.lit(0.5) + F.col("value") / 1000).alias("p_max"), (F.col("event_type") != "error").alias("correct"))
    done = jobs.finish_calibration(run(t, jobs.window_calibration(e)))
    return rnd(done.withColumn("day", F.date_format("start", "yyyy-MM-dd")).drop("start"))


@query(
    "sql_functions",
    """SELECT set_name, round(avg(-(pa*ln(pa) + pb*ln(pb) + pc*ln(pc) + pd*ln(pd))), 8) AS entropy, round(avg(pa*pa + pb*pb + pc*pc + pd*pd - 2 * CASE gold WHEN 'A' THEN pa WHEN 'B' THEN pb WHEN 'C' THEN pc ELSE pd END + 1), 8) AS brier,
       round(avg((4 * greatest(pa,pb,pc,pd) - 1) / 3), 8) AS confidence, round(avg(('0x' || substr(md5(unit), 1, 8))::BIGINT / 4294967296.0::DOUBLE), 8) AS u FROM answers GROUP BY 1""",
    "answers",
)
def sql_functions(t: Tables) -> DataFrame:
    """The scalar functions called from SQL text."""
    SQLF.register(t.spark)
    t.answers.createOrReplaceTempView("answers_view")
    return t.spark.sql(
        """SELECT set_name, round(avg(dist_entropy(dist)), 8) AS entropy, round(avg(brier_score(dist, gold)), 8) AS brier,
                  round(avg(choice_confidence(dist)), 8) AS confidence, round(avg(seeded_uniform(unit)), 8) AS u
           FROM answers_view GROUP BY set_name"""
    )
