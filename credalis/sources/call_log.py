"""Append-only call logs: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWER = (
    "struct<type:string,probabilities:map<string,double>,choice:string,confidence:double,"
    "noul:double,score:double>"
)
RESPONSE = (
    f"struct<model:string,usage:struct<input_tokens:bigint,output_tokens:bigint>,answers:map<string,{ANSWER}>>"
)
ENTRY = (
    "key string, model string, replicate int, state string, questions string, response string, "
    "request_id string, latency_s double, timestamp double"
)
# Answer types of the response format.
CHOICE, YES_NO, SCORE = "choice", "noul", "score"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as a splittable text scan with column ``value``."""
    return spark.read.text(path)


def log_keys(lines: DataFrame) -> DataFrame:
    """Distinct keys of a log; responses are never parsed."""
    key = F.get_json_object("value", "$.key")
    return lines.select(key.alias("key")).filter("key is not null").distinct()


def parse_lines(lines: DataFrame) -> DataFrame:
    """Entries with a flag ``ok``: a string key and an object as response."""
    parsed = F.from_json("value", ENTRY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    body = F.get_json_object("value", "$.response")
    df = lines.filter(F.length(F.trim("value")) > 0).select("value", parsed.alias("_e"), body.alias("_body"))
    ok = F.col("_e.key").isNotNull() & F.startswith(F.ltrim(F.col("_body")), F.lit("{"))
    return df.select("value", F.coalesce(ok, F.lit(False)).alias("ok"), "_e.*")


def ingest(lines: DataFrame) -> DataFrame:
    """Answered calls: malformed lines skipped, the last entry per key wins.

    ``max_by`` keeps one candidate per key and task, so a key repeated very often
    is not sorted in one place.
    """
    return last_per_key(parse_lines(lines).filter("ok").drop("ok", "value"))


def last_per_key(calls: DataFrame) -> DataFrame:
    """The newest entry of each key, of a table or a stream; equal times go by request and response."""
    order = F.struct(F.coalesce("timestamp", F.lit(float("-inf"))), F.coalesce("request_id", F.lit("")), F.coalesce("response", F.lit("")))
    cols = [c for c in calls.columns if c != "key"]
    last = calls.groupBy("key").agg(F.max_by(F.struct(*cols), order).alias("_e"))
    return last.select("key", "_e.*")


def malformed(lines: DataFrame) -> DataFrame:
    """Count of lines and of malformed ones."""
    return parse_lines(lines).agg(F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("ok")).alias("malformed"))


def parse_answers(calls: DataFrame, strict: bool = True) -> DataFrame:
    """Typed answers from the response text.

    Adds ``choices``, ``yes_no`` and ``scores`` maps, token counts and
    ``unknown_types``. Strict mode fails on an unknown type; otherwise the rows
    can be quarantined by that column.
    """
    df = calls.withColumn("_r", F.from_json("response", RESPONSE))
    answers = F.coalesce(F.col("_r.answers"), F.expr(f"cast(map() as map<string,{ANSWER}>)"))
    known = [CHOICE, YES_NO, SCORE]
    unknown = F.map_keys(F.map_filter(answers, lambda k, a: ~F.coalesce(a["type"].isin(known), F.lit(False))))
    if strict:
        failed = F.raise_error(F.concat(F.lit("unknown answer type for "), F.array_join(unknown, ", ")))
        unknown = F.when(F.size(unknown) > 0, failed.cast("array<string>")).otherwise(unknown)

    def of(kind: str):
        return F.map_filter(answers, lambda k, a: a["type"] == kind)

    return df.withColumns(
        {
            "unknown_types": unknown,
            "choices": F.transform_values(
                of(CHOICE),
                lambda k, a: F.struct(
                    a["probabilities"].alias("probabilities"), a["choice"].alias("choice"), a["confidence"].alias("confidence")
                ),
            ),
            "yes_no": F.transform_values(of(YES_NO), lambda k, a: a["noul"]),
            "scores": F.transform_values(
                of(SCORE), lambda k, a: F.struct(a["score"].alias("score"), a["probabilities"].alias("probabilities"))
            ),
            "answered_by": F.coalesce(F.col("_r.model"), F.lit("")),
            "input_tokens": F.coalesce(F.col("_r.usage.input_tokens"), F.lit(0)),
            "output_tokens": F.coalesce(F.col("_r.usage.output_tokens"), F.lit(0)),
        }
    ).drop("_r")
