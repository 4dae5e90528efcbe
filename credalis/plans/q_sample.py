"""Sampling, top-k, set and design queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalis.functions import text
from credalis.operators import ranking as R
from credalis.operators import sampling as SM
from credalis.plans.catalog import query
from credalis.plans.q_rank import rnd
from credalis.plans.views import CUTOFF, Tables


@query(
    "stratified_sample",
    "SELECT set_name, unit FROM rows QUALIFY row_number() OVER (PARTITION BY set_name ORDER BY md5('sample|' || unit)) <= 20", "rows",
)
def stratified_sample(t: Tables) -> DataFrame:
    return SM.stratified_sample(t.rows.select("set_name", "unit"), ["set_name"], ["unit"], 20)


@query(
    "nested_sample",
    """WITH s AS (SELECT set_name, month, unit, row_number() OVER (PARTITION BY set_name, month ORDER BY md5('sample|' || unit)) AS k FROM rows)
       SELECT set_name, month, min(unit) AS first_unit, count(*) AS n, count(*) FILTER (k <= 3) AS inside FROM s WHERE k <= 10 GROUP BY 1, 2""",
    "rows",
)
def nested_sample(t: Tables) -> DataFrame:
    """The first 3 of a sample of 10 are the sample of 3."""
    by = ["set_name", "month"]
    big = SM.stratified_sample(t.rows.select(*by, "unit"), by, ["unit"], 10)
    small = SM.stratified_sample(t.rows.select(*by, "unit"), by, ["unit"], 3).withColumn("small", F.lit(True))
    return big.join(small, [*by, "unit"], "left").groupBy(*by).agg(
        F.min("unit").alias("first_unit"), F.count(F.lit(1)).alias("n"), F.count("small").alias("inside")
    )


@query(
    "balanced_sample",
    """SELECT post, set_name, count(*) AS n, round(avg(p_max), 8) AS p_max FROM (SELECT *, row_number() OVER (PARTITION BY post ORDER BY md5('balance|' || unit)) AS k FROM rows) WHERE post OR k <= (SELECT count(*) FROM rows WHERE post) GROUP BY 1, 2""",
    "rows",
)
def balanced_sample(t: Tables) -> DataFrame:
    s = SM.balanced_sample(t.rows, "post", ["unit"])
    return rnd(s.groupBy("post", "set_name").agg(F.count(F.lit(1)).alias("n"), F.avg("p_max").alias("p_max")))


@query(
    "spread_sample",
    """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
       SELECT o_orderkey FROM o WHERE pos IN (SELECT (i * (SELECT count(*) FROM orders)) // 37 FROM (SELECT unnest(range(0, 37)) AS i))""",
)
def spread_sample(t: Tables) -> DataFrame:
    return SM.spread_sample(t.orders.select("o_orderkey"), "o_orderkey", 37)


@query(
    "heldout_labels",
    """WITH h AS (SELECT p_brand FROM (SELECT DISTINCT p_brand FROM part) ORDER BY md5('heldout|' || p_brand), p_brand LIMIT 5)
       SELECT p_brand IN (SELECT p_brand FROM h) AS out_of_scope, count(*) AS n, count(DISTINCT p_brand) AS labels FROM part GROUP BY 1""",
)
def heldout_labels(t: Tables) -> DataFrame:
    s = SM.heldout_labels(t.part, "p_brand", 5)
    return s.groupBy("out_of_scope").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("labels"))


NORM = r"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
U = "(('0x' || substr(md5('distractor|' || p_partkey || '|{i}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
SKIP = "list_reduce(list_prepend({r}, list_sort({t})), lambda a, e: CASE WHEN e <= a THEN a + 1 ELSE a END)"


def _draw_sql() -> str:
    steps, prev = [], "q"
    for i in range(3):
        r = f"floor((m - len(taken) - {i}) * {U.format(i=i)})::BIGINT"
        steps.append(f"d{i} AS (SELECT *, {SKIP.format(r=r, t=f't{i}')} AS p{i} FROM {prev}), e{i} AS (SELECT *, list_append(t{i}, p{i}) AS t{i + 1} FROM d{i})")
        prev = f"e{i}"
    return ", ".join(steps)


@query(
    "sample_distractors",
    f"""WITH one AS (SELECT p_type, {NORM.format(c='p_name')} AS norm, min(p_name) AS answer FROM part GROUP BY 1, 2),
       ix AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY md5('pool|' || p_type || '|' || norm)) - 1 AS pos, count(*) OVER (PARTITION BY p_type) AS m FROM one),
       b AS (SELECT p_partkey, list(DISTINCT pos) AS taken FROM part JOIN ix ON part.p_type = ix.p_type AND (ix.norm = {NORM.format(c='p_name')} OR ix.norm = 'red widget') GROUP BY 1),
       q AS (SELECT p_partkey, part.p_type, m, taken, taken AS t0 FROM part JOIN b USING (p_partkey) JOIN (SELECT DISTINCT p_type, m FROM ix) x ON x.p_type = part.p_type WHERE m - len(taken) >= 3),
       {_draw_sql()}
       SELECT part.p_partkey, a.answer || '/' || c.answer || '/' || d.answer AS distractors FROM part LEFT JOIN e2 USING (p_partkey) LEFT JOIN ix a ON a.p_type = e2.p_type AND a.pos = p0 LEFT JOIN ix c ON c.p_type = e2.p_type AND c.pos = p1 LEFT JOIN ix d ON d.p_type = e2.p_type AND d.pos = p2""",
)
def sample_distractors(t: Tables) -> DataFrame:
    """Three wrong part names of the same type; "red widget" is an alias of every part."""
    q = t.part.select("p_partkey", "p_type", "p_name", F.array(F.lit("Red  Widget")).alias("aliases"))
    pool = t.part.select("p_type", F.col("p_name").alias("answer"))
    s = SM.sample_distractors(q, pool, "p_type", "p_partkey", "p_name", "aliases")
    joined = F.when(F.col("distractors").isNotNull(), F.array_join("distractors", "/"))
    return s.select("p_partkey", joined.alias("distractors"))


@query(
    "shuffle_options",
    """WITH a AS (SELECT o_orderkey, ['one', 'two', 'three', 'four'] AS opts FROM orders),
       x AS (SELECT o_orderkey, unnest(opts) AS a, unnest(range(0, 4)) AS i FROM a),
       r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY md5('shuffle|' || o_orderkey || '|' || i)) AS k FROM x)
       SELECT o_orderkey, string_agg(a, ',' ORDER BY k) AS shown, substr('ABCD', CAST(max(k) FILTER (i = o_orderkey % 4) AS BIGINT), 1) AS gold FROM r GROUP BY 1""",
)
def shuffle_options(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderkey", F.array(*[F.lit(x) for x in ("one", "two", "three", "four")]).alias("answers"), (F.col("o_orderkey") % 4).alias("gi"))
    s = SM.shuffle_options(df, ["o_orderkey"], "answers", "gi")
    return s.select("o_orderkey", F.array_join("shown", ",").alias("shown"), "gold")


@query(
    "option_subsets",
    """WITH l AS (SELECT DISTINCT p_brand AS x FROM part), k AS (SELECT unnest([2, 5, 10]) AS K),
       c AS (SELECT p_partkey, p_brand, K, x, row_number() OVER (PARTITION BY p_partkey, K ORDER BY md5('options|pick|' || p_partkey || '|' || K || '|' || x)) AS r FROM part, k, l WHERE x <> p_brand),
       o AS (SELECT p_partkey, p_brand, K, x FROM c WHERE r < K UNION ALL SELECT p_partkey, p_brand, K, p_brand FROM part, k)
       SELECT p_partkey, p_brand, K AS "K", string_agg(x, ',' ORDER BY md5('options|order|' || p_partkey || '|' || K || '|' || x)) AS options FROM o GROUP BY 1, 2, 3""",
)
def option_subsets(t: Tables) -> DataFrame:
    s = SM.option_subsets(t.part.select("p_partkey", "p_brand"), ["p_partkey"], "p_brand", (2, 5, 10))
    return s.select("p_partkey", "p_brand", "K", F.array_join("options", ",").alias("options"))


@query(
    "common_template",
    """WITH t AS (SELECT relation, replace(question, subject::VARCHAR, '{}') AS template, count(*) AS n FROM (SELECT relation, subject, 'Did ' || subject || CASE WHEN okey % 3 = 0 THEN ' pay?' WHEN okey % 5 = 0 THEN ' order?' ELSE ' buy?' END AS question FROM questions) GROUP BY 1, 2)
       SELECT relation, template, n FROM t QUALIFY row_number() OVER (PARTITION BY relation ORDER BY n DESC, template) = 1""",
    "questions",
)
def common_template(t: Tables) -> DataFrame:
    verb = F.when(F.col("okey") % 3 == 0, " pay?").when(F.col("okey") % 5 == 0, " order?").otherwise(" buy?")
    df = t.questions.select("relation", "subject", F.concat(F.lit("Did "), F.col("subject").cast("string"), verb).alias("question"))
    return SM.common_template(df, "relation", "question", "subject")


@query("first_per_question", "SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def first_per_question(t: Tables) -> DataFrame:
    return SM.first_per_question(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id")


def people(t: Tables) -> DataFrame:
    """Names put together from part names."""
    return t.part.select(F.initcap(F.concat_ws(" ", "p_name", F.element_at(F.split("p_type", " "), 1))).alias("name"))


@query("recombine_names")
def recombine_names(t: Tables) -> DataFrame:
    """New names that no part of the smallest size has: 20, or all when fewer exist."""
    taken = t.part.filter("p_size = 1").select(F.initcap(F.concat_ws(" ", "p_name", F.element_at(F.split("p_type", " "), 1))).alias("name"))
    return SM.recombine_names(people(t), taken, 20, fewer=True)


@query(
    "derangement",
    """WITH r AS (SELECT p_brand, row_number() OVER (ORDER BY md5('derange|' || p_brand)) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT p_brand FROM part))
       SELECT a.p_brand, b.p_brand AS swapped FROM r a JOIN r b ON b.k = a.k % a.n + 1""",
)
def derangement(t: Tables) -> DataFrame:
    return SM.derangement(t.part, "p_brand")


@query(
    "evidence_cells",
    """WITH q AS (SELECT o_orderkey, ['t' || o_orderkey % 5, 't' || (o_orderkey % 5 + 1), 'x1', 'x2', 'x3'] AS titles, ['t' || o_orderkey % 5, 't' || (o_orderkey % 5 + 1)] AS sup FROM orders),
       p AS (SELECT *, list_transform(list_sort(list_transform(['x1', 'x2', 'x3'], lambda x: md5('evidence|' || o_orderkey || '|' || x) || x)), lambda h: h[33:]) AS pad,
             floor(2 * (('0x' || substr(md5('evidence|' || o_orderkey || '|first'), 1, 8))::BIGINT / 4294967296.0::DOUBLE))::INT + 1 AS i FROM q)
       SELECT o_orderkey, cell, array_to_string(CASE cell WHEN 'closed' THEN [] WHEN 'dose0' THEN pad[1:2] WHEN 'dose1' THEN [sup[i], pad[1]] ELSE sup END, ',') AS paragraphs FROM p, (SELECT unnest(['closed', 'dose0', 'dose1', 'dose2']) AS cell)""",
)
def evidence_cells(t: Tables) -> DataFrame:
    a = F.concat(F.lit("t"), (F.col("o_orderkey") % 5).cast("string"))
    b = F.concat(F.lit("t"), (F.col("o_orderkey") % 5 + 1).cast("string"))
    df = t.orders.select("o_orderkey", F.array(a, b, F.lit("x1"), F.lit("x2"), F.lit("x3")).alias("titles"), F.array(a, b).alias("support"))
    c = SM.evidence_cells(df, "o_orderkey", "titles", "support")
    return c.select("o_orderkey", "cell", F.array_join("paragraphs", ",").alias("paragraphs"))


@query(
    "plan_cells",
    """SELECT c_mktsegment, cond, style, replicate, count(*) AS n, sum(c_custkey)::BIGINT AS check_sum FROM customer, (SELECT unnest(['L0', 'L1', 'L8']) AS cond), (SELECT unnest(['opaque', 'named']) AS style), (SELECT unnest([0, 1, 2]) AS replicate) GROUP BY 1, 2, 3, 4""",
)
def plan_cells(t: Tables) -> DataFrame:
    p = SM.plan_cells(t.customer, {"cond": ["L0", "L1", "L8"], "style": ["opaque", "named"], "replicate": [0, 1, 2]})
    return p.groupBy("c_mktsegment", "cond", "style", "replicate").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("check_sum"))


@query(
    "union_rows",
    """SELECT part, count(*) AS n, count(price) AS priced, count(balance) AS balanced FROM (SELECT 'orders' AS part, o_totalprice AS price, NULL::DOUBLE AS balance FROM orders UNION ALL SELECT 'customer', NULL, c_acctbal FROM customer) GROUP BY 1""",
)
def union_rows(t: Tables) -> DataFrame:
    u = SM.union_rows({
        "orders": t.orders.select(F.col("o_orderkey").alias("unit"), F.col("o_totalprice").alias("price")),
        "customer": t.customer.select(F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("balance")),
    })
    return u.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("priced"), F.count("balance").alias("balanced"))


@query(
    "top_k", "SELECT o_orderpriority, o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 8",
)
def top_k(t: Tables) -> DataFrame:
    k = R.top_k(t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 8)
    return rnd(k, digits=6)


@query("filler_to_length")
def filler_to_length(t: Tables) -> DataFrame:
    """Long document texts drawn for every document up to its own length, which the pool reaches as it holds that text."""
    keys = t.documents.select("doc_id", F.col("n_chars").alias("target"))
    f = SM.filler_to_length(keys, "doc_id", "target", t.documents.filter(F.length("text") >= 1000), "text")
    return f.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("chars"), F.max("target").alias("target"))


@query(
    "question_sets",
    """SELECT 'part:' || p_type || ':' || p_partkey AS unit, 'ABCD'[p_size % 4 + 1] AS gold, p_type AS subject, CASE p_size % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'wrong answer' ELSE 'ambiguous' END AS error_type,
       CASE WHEN p_size % 3 = 1 THEN p_size % 4 END AS corrected FROM part""",
)
def question_sets(t: Tables) -> DataFrame:
    """Typed questions from a table: letters from an answer index, flaw labels, corrections."""
    letters = F.array(*[F.lit(c) for c in SM.LETTERS[:4]])
    raw = F.when(F.col("p_size") % 3 == 1, F.concat(F.lit(" "), F.element_at(letters, F.col("p_size") % 4 + 1))).otherwise("see note")
    return t.part.select(
        F.concat_ws(":", F.lit("part"), "p_type", F.col("p_partkey").cast("string")).alias("unit"), F.element_at(letters, F.col("p_size") % 4 + 1).alias("gold"),
        F.col("p_type").alias("subject"), F.when(F.col("p_size") % 3 == 0, "ok").when(F.col("p_size") % 3 == 1, "wrong answer").otherwise("ambiguous").alias("error_type"),
        text.parse_option_index(raw).alias("corrected"),
    )


@query(
    "verification_pairs",
    """SELECT 'q' || o_orderkey AS unit, truth, CASE WHEN truth THEN o_orderstatus WHEN o_orderstatus = 'F' THEN 'O' ELSE 'F' END AS proposed, 'verify:q' || o_orderkey || ':' || truth AS verify_unit FROM orders, (SELECT unnest([true, false]) AS truth)""",
)
def verification_pairs(t: Tables) -> DataFrame:
    df = t.orders.select(
        F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("unit"), F.array(F.lit("F"), F.lit("O"), F.lit("P")).alias("options"), F.col("o_orderstatus").alias("gold")
    )
    return SM.verification_pairs(df, "unit", "options", "gold")


@query(
    "ambiguous_candidates",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'single' ELSE 'ambiguous' END AS kind,
       CASE event_id % 4 WHEN 0 THEN event_type ELSE event_type || ',' || event_id || ',third' END || ',cannot tell' AS options FROM events WHERE event_id % 4 <> 2""",
)
def ambiguous_candidates(t: Tables) -> DataFrame:
    """Single readings, three readings, and readings that differ only in punctuation (dropped)."""
    a = F.col("event_type")
    m = F.col("event_id") % 4
    readings = F.when(m == 0, F.array(F.array(a), F.array(a, F.lit("x")))).when(m == 2, F.array(F.array(a), F.array(F.concat(a, F.lit("!"))))).otherwise(
        F.array(F.array(a), F.array(F.col("event_id").cast("string")), F.array(F.lit("third")))
    )
    c = SM.ambiguous_candidates(t.events.select("event_id", readings.alias("readings")), "event_id", "readings")
    return c.select("event_id", "kind", F.array_join("options", ",").alias("options"))


@query(
    "condition_variants",
    f"""SELECT 'cutoff:' || cond || ':' || unit AS variant_unit, cond, month >= '{CUTOFF}' AS post, CASE cond WHEN 'masked' THEN NULL WHEN 'date' THEN strftime(last_day(CAST(month || '-01' AS DATE) + INTERVAL 1 MONTH), '%Y-%m-%d') END AS today FROM questions, (SELECT unnest(['base', 'date', 'unknown', 'masked']) AS cond)""",
    "questions",
)
def condition_variants(t: Tables) -> DataFrame:
    v = SM.condition_variants(t.questions, "unit", ["base", "date", "unknown", "masked"])
    today = F.when(F.col("cond") == "date", text.month_after_end("month"))
    return v.select("variant_unit", "cond", (F.col("month") >= CUTOFF).alias("post"), today.alias("today"))
