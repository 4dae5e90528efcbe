"""Queries over text, dates and keys, on whole documents and derived questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalis.functions import statfn, text
from credalis.functions.seeded import uniform
from credalis.plans.catalog import query
from credalis.plans.views import Tables, spread

MONTH_LIST = "['January','February','March','April','May','June','July','August','September','October','November','December']"
@query(
    "normalise_answer",
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM documents""",
)
def normalise_answer(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.normalise_answer("text")).alias("h"))


@query(
    "parse_labels",
    r"""WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN '**Yes.' WHEN 'view' THEN ' no\n' WHEN 'error' THEN 'unsure' ELSE 'YES' END AS a,
          CASE event_type WHEN 'click' THEN ' b ' WHEN 'view' THEN '2' WHEN 'error' THEN 'B and C' ELSE 'D' END AS o,
          CASE event_type WHEN 'click' THEN 'single' WHEN 'view' THEN 'ambiguous' ELSE 'mixed' END AS kind FROM events)
       SELECT event_id, CASE WHEN lower(trim(replace(a, '\n', ' '), ' *.')) IN ('yes','no') THEN lower(trim(replace(a, '\n', ' '), ' *.')) END AS yes_no,
              CASE trim(o) WHEN 'b' THEN 1 WHEN '2' THEN 2 WHEN 'D' THEN 3 END AS opt, kind FROM e""",
)
def parse_labels(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    a = F.when(kind == "click", "**Yes.").when(kind == "view", " no\n").when(kind == "error", "unsure").otherwise("YES")
    o = F.when(kind == "click", " b ").when(kind == "view", "2").when(kind == "error", "B and C").otherwise("D")
    single, multi = F.lit("singleAnswer"), F.lit("multipleQAs")
    kinds = F.when(kind == "click", F.array(single, single)).when(kind == "view", F.array(multi)).otherwise(F.array(single, multi))
    return t.events.select(
        "event_id", text.parse_yes_no(a).alias("yes_no"), text.parse_option_index(o).alias("opt"),
        text.annotation_label(kinds).alias("kind"),
    )


@query(
    "display_case",
    r"""SELECT p_partkey, CASE WHEN a = upper(a) AND a <> lower(a) AND length(a) > 4
          THEN array_to_string(list_transform(regexp_extract_all(a, '\p{L}+|[^\p{L}]+'), lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2))), '') ELSE a END AS shown
       FROM (SELECT p_partkey, rtrim(CASE WHEN p_size % 2 = 0 THEN upper(p_name) || '-O''' || p_type ELSE p_name END || '.', '.') AS a FROM part)""",
)
def display_case(t: Tables) -> DataFrame:
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.upper("p_name"), F.lit("-O'"), F.col("p_type"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", text.display_case(F.concat(raw, F.lit("."))).alias("shown"))


@query(
    "mask_dates",
    r"""SELECT unit, trim(regexp_replace(regexp_replace(regexp_replace(
           replace(question, ' on ' || strftime(okey_date, '%B %-d, %Y'), ''), '\b(19|20)[0-9]{2}\b', '', 'g'), ' +', ' ', 'g'), ' [?]', '?')) AS masked
         FROM (SELECT q.unit, q.question, o.o_orderdate AS okey_date FROM questions q JOIN orders o ON q.okey = o.o_orderkey)""",
    "questions",
)
def mask_dates(t: Tables) -> DataFrame:
    return t.questions.select("unit", text.mask_dates("question").alias("masked"))


@query("mask_dates_documents")
def mask_dates_documents(t: Tables) -> DataFrame:
    """Whole document texts; checked against a reference regex engine in the tests."""
    m = text.mask_dates("text")
    return spread(t.documents, "doc_id").select("doc_id", F.md5(m).alias("h"), (F.length("text") - F.length(m)).alias("removed"))


@query(
    "latest_date",
    rf"""WITH w AS (SELECT unit, month, string_split(question, ' ') AS w FROM questions), x AS (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM w),
       y AS (SELECT unit, CASE WHEN w[k - 1] SIMILAR TO '[0-9]{{1,2}},?' THEN w[k - 2] ELSE w[k - 1] END AS before, w[k] SIMILAR TO '(19|20)[0-9][0-9].*' AS leads,
         regexp_extract_all(w[k], '(?:19|20)[0-9][0-9]') AS free, regexp_extract_all(w[k], '\b(?:19|20)[0-9][0-9]\b') AS bound FROM x),
       f AS (SELECT unit, max(year::DOUBLE + (coalesce(nullif(list_position({MONTH_LIST}, before), 0), 1) - 1) / 12.0::DOUBLE) AS latest FROM (SELECT unit, unnest(free) AS year, CASE WHEN leads AND generate_subscripts(free, 1) = 1 THEN before END AS before FROM y) GROUP BY 1),
       b AS (SELECT unit, max(year || '-' || lpad(coalesce(nullif(list_position({MONTH_LIST}, before), 0), 12)::VARCHAR, 2, '0')) AS last FROM (SELECT unit, unnest(bound) AS year, CASE WHEN leads AND generate_subscripts(bound, 1) = 1 THEN before END AS before FROM y) GROUP BY 1)
       SELECT unit, round(latest, 8) AS latest, greatest(month, last) AS settled FROM w LEFT JOIN f USING (unit) LEFT JOIN b USING (unit)""",
    "questions",
)
def latest_date(t: Tables) -> DataFrame:
    return t.questions.select(
        "unit", F.round(text.latest_date("question"), 8).alias("latest"),
        text.settled_by("question", "month").alias("settled"),
    )


@query(
    "month_math",
    """SELECT DISTINCT month, strftime(last_day(CAST(month || '-01' AS DATE) + INTERVAL 1 MONTH), '%Y-%m-%d') AS after_end,
         round(CAST(substr(month, 1, 4) AS INT) - 2020 + (CAST(substr(month, 6, 2) AS INT) - 1) / 12.0::DOUBLE, 8) AS years FROM rows""",
    "rows",
)
def month_math(t: Tables) -> DataFrame:
    months = t.rows.select("month").distinct()
    return months.select(
        "month", text.month_after_end("month").alias("after_end"), F.round(text.years_since("month"), 8).alias("years")
    )


@query(
    "word_count",
    r"""SELECT doc_id, len(list_filter(string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) + 2
              + len(list_filter(string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS words FROM documents""",
)
def word_count(t: Tables) -> DataFrame:
    """A nested state: the text twice (once in an array), a map value and a number."""
    state = F.struct(
        F.col("text").alias("question"), F.array("text").alias("paragraphs"),
        F.create_map(F.lit("note"), F.lit("two words")).alias("info"), F.col("n_chars").alias("n"),
    )
    df = t.documents.select("doc_id", state.alias("state"))
    return df.select("doc_id", text.word_count(F.col("state"), df.schema["state"].dataType).cast("long").alias("words"))


@query(
    "is_person_name",
    r"""SELECT p_partkey, regexp_full_match(name, '\p{Lu}[\p{L}-]*( \p{Lu}[\p{L}-]*){1,2}')
          AND NOT list_has_any(string_split(name, ' '), [""" + ",".join(f"'{w}'" for w in text.NAME_STOPWORDS) + r"""]) AS person
       FROM (SELECT p_partkey, upper(substr(p_name, 1, 1)) || split_part(substr(p_name, 2), ' ', 1) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1))
          || substr(split_part(p_name, ' ', 2), 2) || CASE p_size % 3 WHEN 0 THEN ' ' || p_brand WHEN 1 THEN ' Queen' ELSE '' END AS name FROM part)""",
)
def is_person_name(t: Tables) -> DataFrame:
    name = F.concat(
        F.initcap("p_name"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.col("p_brand"))).when(F.col("p_size") % 3 == 1, " Queen").otherwise(""),
    )
    return t.part.select("p_partkey", text.is_person_name(name).alias("person"))


@query("perturb_answers")
def perturb_answers(t: Tables) -> DataFrame:
    """Three distinct variants of a year or of an amount with decimals."""
    answer = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMMM yyyy")).otherwise(
        F.concat(F.lit("about "), F.format_number("o_totalprice", 2), F.lit(" in all"))
    )
    return t.orders.select("o_orderkey", answer.alias("answer"), F.array_join(text.perturb_answers(answer), " / ").alias("variants"))


@query(
    "unit_keys",
    r"""SELECT event_id, 'ev:' || CASE WHEN event_type = 'error' THEN 'oos' ELSE 'in' END || ':' || event_id AS key,
         'ev:s0:' || CASE WHEN event_type = 'error' THEN 'oos' ELSE 'in' END || ':' || event_id AS seeded,
         'ev:' || CASE WHEN event_type = 'error' THEN 'oos' ELSE 'in' END || ':' || event_id AS back,
         CASE WHEN event_type = 'error' THEN 'oos:' ELSE 'test:' END || event_id AS eval_id, 'q' || event_id AS base FROM events""",
)
def unit_keys(t: Tables) -> DataFrame:
    key = text.unit_key(F.lit("ev"), F.col("event_type") == "error", F.col("event_id"))
    seeded = text.seed_key(key, "s0")
    unit = F.concat(F.lit("cutoff:"), F.col("event_type"), F.lit(":q"), F.col("event_id").cast("string"))
    return t.events.select(
        "event_id", key.alias("key"), seeded.alias("seeded"), text.normalise_key(seeded, "s0").alias("back"),
        text.evaluation_id(key).alias("eval_id"), text.strip_condition(unit).alias("base"),
    )


@query(
    "seeded_uniform",
    """SELECT unit, ('0x' || substr(md5('u|' || unit || '|0'), 1, 8))::BIGINT / 4294967296.0 AS u FROM rows""",
    "rows",
)
def seeded_uniform(t: Tables) -> DataFrame:
    return t.rows.select("unit", uniform("u", "unit", F.lit(0)).alias("u"))


@query(
    "estimate_tokens",
    r"""SELECT lang, count(*) AS n, sum(CAST(ceil(length(j) / 1.5::DOUBLE) AS BIGINT)) AS tokens FROM (
         SELECT lang, regexp_replace(regexp_replace('{"s": ' || text || '}', '[\x{10000}-\x{10FFFF}]', '............', 'g'), '[^\x00-\x7F]', '......', 'g') AS j
         FROM documents) GROUP BY lang""",
)
def estimate_tokens(t: Tables) -> DataFrame:
    j = F.concat(F.lit('{"s": '), F.col("text"), F.lit("}"))
    return t.documents.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(text.estimate_tokens(j)).alias("tokens")
    )


@query(
    "request_fingerprint",
    """SELECT doc_id, sha256('{"model":"m1","questions":{"a":1,"q":"' || lang || '"},"replicate":' || doc_id % 3 || ',"state":{"n":' || n_chars || ',"source":"' || source || '"}}') AS key FROM documents""",
)
def request_fingerprint(t: Tables) -> DataFrame:
    state = F.to_json(F.struct("source", F.col("n_chars").alias("n")))
    questions = F.to_json(F.struct(F.col("lang").alias("q"), F.lit(1).alias("a")))
    return t.documents.select(
        "doc_id", statfn.request_fingerprint(F.lit("m1"), state, questions, F.col("doc_id") % 3).alias("key")
    )


@query(
    "sanitise_text",
    r"""SELECT doc_id, md5(trim(regexp_replace(""" + "replace(" * 10 + "text"
    + "".join(f", '{tok}', ' ')" for tok in text.RESERVED_TOKENS) + r""", '\s+', ' ', 'g'))) AS h FROM documents""",
)
def sanitise_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.sanitise_text("text")).alias("h"))
