"""Queries over sources: logs and rows as text derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalis.plans.catalog import query
from credalis.plans.views import Tables
from credalis.sources import call_log, export, rows

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def event_log(t: Tables) -> DataFrame:
    """A call log with repeated keys, malformed and truncated lines, from events."""
    key = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("event_type"))
    answers = F.create_map(
        F.lit("answer"), F.struct(
            F.lit("choice").alias("type"),
            F.create_map(F.lit("yes"), F.round(F.col("value") / 500, 6), F.lit("no"), F.round(1 - F.col("value") / 500, 6)).alias("probabilities"),
            F.lit("yes").alias("choice"), F.lit(None).cast("double").alias("noul"), F.lit(None).cast("double").alias("score"),
        ),
        F.lit("known"), F.struct(
            F.lit("noul").alias("type"), F.lit(None).cast("map<string,double>").alias("probabilities"),
            F.lit(None).cast("string").alias("choice"), F.round(F.col("value") / 1000, 6).alias("noul"), F.lit(None).cast("double").alias("score"),
        ),
        F.lit("chance"), F.struct(
            F.lit("score").alias("type"), F.lit(None).cast("map<string,double>").alias("probabilities"),
            F.lit(None).cast("string").alias("choice"), F.lit(None).cast("double").alias("noul"), F.round(F.col("value") / 100, 6).alias("score"),
        ),
    )
    response = F.struct(
        F.lit("m1").alias("model"), F.struct((F.col("event_id") % 100).alias("input_tokens")).alias("usage"), answers.alias("answers")
    )
    entry = F.to_json(F.struct(
        key.alias("key"), F.lit("m1").alias("model"), F.lit(0).alias("replicate"), F.struct(F.col("user_id").alias("u")).alias("state"),
        response.alias("response"), F.col("event_id").cast("string").alias("request_id"),
        F.col("event_id").cast("double").alias("timestamp"), (F.col("value") / 10).alias("latency_s"),
    ))
    line = F.when(F.col("event_id") % 50 == 7, F.lit('{"key": 5, "response"')).when(
        F.col("event_id") % 50 == 9, F.substring(entry, 1, 40)
    ).when(F.col("event_id") % 50 == 11, F.lit("")).otherwise(entry)
    return t.events.select(line.alias("value"))


GOOD = "SELECT *, user_id || '-' || event_type AS key FROM events WHERE event_id % 50 NOT IN (7, 9, 11)"
LAST = f"SELECT * FROM ({GOOD}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id DESC) = 1"


@query(
    "read_rows",
    """SELECT unit, month, round(p_max, 9) AS p_max, correct, NULL::VARCHAR AS gold, round(p_known, 9) AS p_known FROM rows""", "rows",
)
def read_rows(t: Tables) -> DataFrame:
    """Rows written as JSON text and read with the fixed schema; gold is missing."""
    lines = t.rows.select(F.to_json(F.struct("unit", "month", "p_max", "correct", "p_known")).alias("value"))
    r = rows.rows_from_lines(lines)
    return r.select("unit", "month", F.round("p_max", 9).alias("p_max"), "correct", "gold", F.round("p_known", 9).alias("p_known"))


@query("ingest_call_log", f"SELECT key, event_id::DOUBLE AS timestamp, CAST(event_id AS VARCHAR) AS request_id, round(value / 10, 8) AS latency_s FROM ({LAST})")
def ingest_call_log(t: Tables) -> DataFrame:
    calls = call_log.ingest(event_log(t))
    return calls.select("key", "timestamp", "request_id", F.round("latency_s", 8).alias("latency_s"))


@query(
    "malformed_lines",
    "SELECT count(*) FILTER (event_id % 50 <> 11) AS lines, count(*) FILTER (event_id % 50 IN (7, 9)) AS malformed FROM events",
)
def malformed_lines(t: Tables) -> DataFrame:
    return call_log.malformed(event_log(t))


@query(
    "parse_answers",
    f"""SELECT key, round(round(value / 500, 6), 8) AS p_yes, round(round(value / 1000, 6), 8) AS p_known, round(round(value / 100, 6), 8) AS s_chance,
        event_id % 100 AS input_tokens FROM ({LAST})""",
)
def parse_answers(t: Tables) -> DataFrame:
    a = call_log.parse_answers(call_log.ingest(event_log(t)))
    return a.select(
        "key", F.round(F.col("choices")["answer"]["probabilities"]["yes"], 8).alias("p_yes"),
        F.round(F.col("yes_no")["known"], 8).alias("p_known"), F.round(F.col("scores")["chance"]["score"], 8).alias("s_chance"), "input_tokens",
    )


@query("log_keys", f"SELECT DISTINCT key FROM ({GOOD})")
def log_keys(t: Tables) -> DataFrame:
    return call_log.log_keys(event_log(t))


@query(
    "write_rows",
    """SELECT event_id, CASE WHEN event_id % 7 NOT IN (0, 1) THEN value END AS value, CASE WHEN event_id % 7 <> 2 THEN value END AS deep FROM events""",
)
def write_rows(t: Tables) -> DataFrame:
    """Strict output: NaN and infinities become null, also inside arrays and structs."""
    nan, inf = F.lit(float("nan")), F.lit(float("-inf"))
    df = t.events.select(
        "event_id", F.when(F.col("event_id") % 7 == 0, nan).when(F.col("event_id") % 7 == 1, inf).otherwise(F.col("value")).alias("value"),
        F.struct(F.array(F.when(F.col("event_id") % 7 == 2, nan).otherwise(F.col("value"))).alias("xs")).alias("deep"),
    )
    return rows.strict(df).select("event_id", "value", F.col("deep.xs")[0].alias("deep"))


@query(
    "load_tables",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m') AS month, len([event_type, 'x']) AS n_labels FROM events""",
)
def load_tables(t: Tables) -> DataFrame:
    """A table with a JSON list column and a date, prepared as question tables are."""
    df = t.events.select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "ts",
        F.to_json(F.array("event_type", F.lit("x"))).alias("labels"),
    )
    return rows.prepare_table(df, ["labels"], "ts").select("event_id", "k", "month", F.size("labels").alias("n_labels"))


@query("file_manifest")
def file_manifest(t: Tables) -> DataFrame:
    """Bytes, digest and rows of every given table file."""
    files = rows.file_manifest(t.spark, t.sf_dir, "*.parquet")
    counts = None
    for name in TABLE_NAMES:
        c = rows.rows_per_file(getattr(t, name))
        counts = c if counts is None else counts.unionByName(c)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file"), "bytes", "sha256").join(counts.select(name.alias("file"), "rows"), "file")


@query(
    "leak_scan",
    """SELECT doc_id, 'text' AS text_field, length(text) > 100 AS long_string, CASE WHEN doc_id % 2 = 0 THEN 'info.text' END AS nested FROM documents""",
)
def leak_scan(t: Tables) -> DataFrame:
    """The text column is refused at the top level; nested, only when it holds a string."""
    top = export.leak_scan(t.documents).select("doc_id", "text_field", "long_string")
    nested = t.documents.select(
        "doc_id", F.struct(F.when(F.col("doc_id") % 2 == 0, F.lit("short")).alias("text"), F.lit(1).alias("n")).alias("info")
    )
    return top.join(export.leak_scan(nested).select("doc_id", F.col("text_field").alias("nested")), "doc_id")


@query(
    "leak_scan_json",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'a.question: text field' WHEN 'view' THEN 'a.b: long string' END AS problem FROM events""",
)
def leak_scan_json(t: Tables) -> DataFrame:
    """Free-form JSON: a nested text field, a long string, or a harmless probability."""
    doc = F.when(F.col("event_type") == "click", '{"a": {"question": ["why"]}}').when(
        F.col("event_type") == "view", F.concat(F.lit('{"a": {"b": "'), F.repeat(F.lit("x"), 101), F.lit('"}}'))
    ).otherwise(F.concat(F.lit('{"a": {"text": '), F.col("value").cast("string"), F.lit("}}")))
    return t.events.select("event_id", export.leak_in_json(doc).alias("problem"))


@query("strip_private", "SELECT event_id, event_type, value AS kept, 1 AS n_keys, 'event_id,event_type,info,m' AS columns FROM events")
def strip_private(t: Tables) -> DataFrame:
    df = t.events.select(
        "event_id", "event_type", F.struct(F.col("value").alias("kept"), F.col("value").alias("_draws")).alias("info"),
        F.create_map(F.lit("a"), F.lit(1), F.lit("_b"), F.lit(2)).alias("m"), F.col("user_id").alias("_private"),
    )
    s = export.strip_private(df)
    names = ",".join(s.columns)
    return s.select("event_id", "event_type", "info.kept", F.size("m").alias("n_keys"), F.lit(names).alias("columns"))
