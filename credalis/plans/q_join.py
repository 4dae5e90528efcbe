"""Join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalis.functions import dist as D
from credalis.functions import text
from credalis.operators import joins as J
from credalis.operators import replicates as RP
from credalis.operators import scoring as S
from credalis.operators import timesplit as TS
from credalis.plans.catalog import query
from credalis.plans.q_rank import rnd
from credalis.plans.q_score import TOP_CTE, scope
from credalis.plans.views import Tables


@query(
    "align_by_unit",
    """SELECT l_returnflag AS set_name, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def align_by_unit(t: Tables) -> DataFrame:
    items = t.lineitem.select(F.col("l_orderkey").alias("unit"), F.col("l_returnflag").alias("set_name"))
    first = t.orders.select(F.col("o_orderkey").alias("unit"), "o_orderstatus", "o_totalprice")
    j = J.align_by_unit(items, first)
    return rnd(j.groupBy("set_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")), digits=6)


PAIRS = "(SELECT unnest([0, 0, 1]) AS i, unnest([1, 2, 2]) AS j)"
"""Every pair of the three replicates."""


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First and second replicate of every pair, with the pair as ``pair``."""
    both = RP.every_pair(df, 3)
    return both.filter("side = 'a'"), both.filter("side = 'b'")


@query(
    "pair_conditions",
    f"""SELECT i || '-' || j AS pair, a.set_name, count(*) AS n, round(avg(a.known - b.known), 8) AS difference, round(avg((a.gold = b.gold)::INT), 8) AS same_gold
       FROM {PAIRS} JOIN answers a ON a.replicate = i JOIN answers b ON b.replicate = j AND a.unit = b.unit GROUP BY 1, 2""",
    "answers",
)
def pair_conditions(t: Tables) -> DataFrame:
    w = J.pair_conditions(RP.every_pair(t.answers, 3), ["pair", "set_name", "unit"], "side", "a", "b", ["known", "gold"])
    return rnd(w.groupBy("pair", "set_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("known_a") - F.col("known_b")).alias("difference"),
        F.avg((F.col("gold_a") == F.col("gold_b")).cast("double")).alias("same_gold"),
    ))


@query(
    "join_features",
    """WITH f AS (SELECT unit, max(pa) - min(pa) AS spread FROM answers GROUP BY 1)
       SELECT set_name, count(*) AS n, round(corr(spread, norm_entropy), 8) AS r FROM unit_mean JOIN f USING (unit) GROUP BY 1""",
    ("answers", "unit_mean"),
)
def join_features(t: Tables) -> DataFrame:
    """Cells beside replicate features on the cell keys."""
    k = ["set_name", "unit"]
    cells = S.distribution_of(S.replicate_mean(t.answers, k), k).withColumn("norm_entropy", D.norm_entropy("dist"))
    pa = D.prob("dist", F.lit("A"))
    feats = t.answers.groupBy(*k).agg((F.max(pa) - F.min(pa)).alias("spread"))
    j = cells.join(feats, k)
    return rnd(j.groupBy("set_name").agg(F.count(F.lit(1)).alias("n"), F.corr("spread", "norm_entropy").alias("r")))


@query(
    "model_agreement",
    f"""WITH {TOP_CTE}, j AS (SELECT i || '-' || j AS pair, a.set_name, a.known AS x, b.known AS y, a.top = a.gold AS ca, b.top = b.gold AS cb FROM {PAIRS} JOIN t a ON a.replicate = i JOIN t b ON b.replicate = j AND a.unit = b.unit),
       r AS (SELECT *, rank() OVER (PARTITION BY pair, set_name ORDER BY x) + (count(*) OVER (PARTITION BY pair, set_name, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY pair, set_name ORDER BY y) + (count(*) OVER (PARTITION BY pair, set_name, y) - 1) / 2.0 AS ry FROM j)
       SELECT pair, set_name, round(avg((ca = cb)::INT), 8) AS error_agreement, count(*) FILTER (NOT ca AND NOT cb) AS both_wrong, round(corr(rx, ry), 8) AS rho, count(*) AS n FROM r GROUP BY 1, 2""",
    "answers",
)
def model_agreement(t: Tables) -> DataFrame:
    a, b = sides(scope(t))
    return rnd(J.model_agreement(a, b, ["pair", "unit"], ["pair", "set_name"], "known"))


def _requests(t: Tables) -> DataFrame:
    """Planned requests: every question twice over, keyed; tokens from the request text."""
    q = t.questions.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return q.select(
        F.col("category").alias("experiment"), "unit", F.md5("question").alias("key"), text.estimate_tokens("question").alias("tokens"), "okey"
    )


def _log(t: Tables) -> DataFrame:
    """Logged keys: all orders but every seventh."""
    return t.questions.filter("okey % 7 <> 3").select(F.md5("question").alias("key"))


REQ = "r AS (SELECT category AS experiment, unit, md5(question) AS key, CAST(ceil(length(question) / 1.5::DOUBLE) AS BIGINT) AS tokens, okey % 7 <> 3 AS found FROM questions)"


@query(
    "log_coverage",
    f"""WITH {REQ}, m AS (SELECT experiment, unit, row_number() OVER (PARTITION BY experiment ORDER BY unit, copy) AS k FROM r, (SELECT unnest([0, 1]) AS copy) WHERE NOT found)
       SELECT experiment, 2 * count(*) AS requests, 2 * count(*) FILTER (found) AS found, 2 * count(*) FILTER (NOT found) AS missing,
       (SELECT string_agg(unit, ',' ORDER BY unit) FROM m WHERE m.experiment = r.experiment AND k <= 5) AS missing_units FROM r GROUP BY 1""",
    "questions",
)
def log_coverage(t: Tables) -> DataFrame:
    return J.log_coverage(_requests(t), _log(t), ["experiment"])


@query(
    "spend_estimate",
    f"""WITH {REQ} SELECT experiment, 2 * count(*) AS requests, count(*) FILTER (found) AS cached, count(*) FILTER (NOT found) AS new_requests, (sum(tokens) FILTER (NOT found))::BIGINT AS new_tokens FROM r GROUP BY 1""",
    "questions",
)
def spend_estimate(t: Tables) -> DataFrame:
    return J.spend_estimate(_requests(t), _log(t), ["experiment"])


def _edited(t: Tables) -> DataFrame:
    """A copy of orders with some rows missing, some added and some changed."""
    o = t.orders.filter("o_orderkey % 11 <> 0")
    price = F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    status = F.when(F.col("o_orderkey") % 17 == 0, F.lit(None)).otherwise(F.col("o_orderstatus"))
    same = o.select("o_orderkey", price.alias("o_totalprice"), status.alias("o_orderstatus"))
    extra = t.orders.filter("o_orderkey % 100 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), "o_totalprice", "o_orderstatus")
    return same.unionByName(extra)


@query(
    "compare_tables",
    """SELECT count(*) FILTER (k % 11 <> 0) AS shared, count(*) FILTER (k % 11 = 0) AS only_left, count(*) FILTER (k % 100 = 0) AS only_right,
       count(*) FILTER (k % 11 <> 0 AND (k % 13 = 0 OR k % 17 = 0)) AS differing, count(*) FILTER (k % 11 <> 0 AND k % 13 = 0) AS o_totalprice_differs,
       count(*) FILTER (k % 11 <> 0 AND k % 17 = 0) AS o_orderstatus_differs FROM (SELECT o_orderkey AS k FROM orders)""",
)
def compare_tables(t: Tables) -> DataFrame:
    return J.compare_tables(t.orders, _edited(t), "o_orderkey", ["o_totalprice", "o_orderstatus"])


@query(
    "differing_examples",
    "SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 0 AND (o_orderkey % 13 = 0 OR o_orderkey % 17 = 0) ORDER BY 1 LIMIT 5",
)
def differing_examples(t: Tables) -> DataFrame:
    return J.differing_examples(t.orders, _edited(t), "o_orderkey", ["o_totalprice", "o_orderstatus"])


@query(
    "nearest_distractors",
    """WITH e AS (SELECT vec_id, label, 'answer number ' || vec_id AS name, embedding::DOUBLE[] AS v FROM embeddings),
       s AS (SELECT g.vec_id AS id, p.vec_id AS other, p.name, list_dot_product(g.v, p.v) AS sim FROM e g, e p
             WHERE g.vec_id <> p.vec_id AND p.vec_id <> (g.vec_id + 1) % (SELECT count(*) FROM e)
               AND NOT contains(p.name, g.name) AND NOT contains(g.name, p.name)
               AND NOT contains(p.name, 'answer number ' || (g.vec_id + 1) % (SELECT count(*) FROM e)) AND NOT contains('answer number ' || (g.vec_id + 1) % (SELECT count(*) FROM e), p.name)),
       r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, name) AS k FROM s WHERE sim <= 0.92)
       SELECT id::VARCHAR AS id, string_agg(name, ',' ORDER BY k) AS distractors FROM r WHERE k <= 3 GROUP BY 1""",
)
def nearest_distractors(t: Tables) -> DataFrame:
    """Every vector is a gold and a pool answer; its successor counts as an alias."""
    n = t.embeddings.agg(F.count(F.lit(1)).alias("_n"))
    v = F.transform("embedding", lambda x: x.cast("double"))
    name = F.concat(F.lit("answer number "), F.col("vec_id").cast("string"))
    alias = F.concat(F.lit("Answer  number "), ((F.col("vec_id") + 1) % F.col("_n")).cast("string"))
    e = t.embeddings.join(F.broadcast(n), F.lit(True)).select(
        F.col("vec_id").cast("string").alias("id"), name.alias("name"), v.alias("vector"), F.array(alias).alias("aliases")
    )
    out = J.nearest_distractors(e, e.select("name", "vector"))
    return out.select("id", F.array_join("distractors", ",").alias("distractors"))


@query(
    "closest_length_pair",
    """WITH w AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS words, length(text) % 7 AS score FROM conversations),
       c AS (SELECT conv_id, arg_min(words, turn) AS cw, arg_min(score, turn) AS cs FROM w WHERE turn = 1 GROUP BY 1),
       n AS (SELECT conv_id, cs, abs(words - cw) AS gap, score, row_number() OVER (PARTITION BY conv_id ORDER BY abs(words - cw), turn) AS k FROM w JOIN c USING (conv_id) WHERE turn <> 1)
       SELECT conv_id, gap, CASE WHEN cs > score THEN 1 WHEN cs = score THEN 0.5 ELSE 0 END::DOUBLE AS win FROM n WHERE k = 1""",
)
def closest_length_pair(t: Tables) -> DataFrame:
    """The first reply plays the complete set of a conversation."""
    df = t.conversations.select(
        "conv_id", "turn", F.size(F.split("text", " ")).alias("words"), (F.length("text") % 7).alias("score"), (F.col("turn") == 1).alias("full")
    )
    return J.closest_length_pair(df, "conv_id", "full", "words", "score", "turn")


FINE_SQL = "least(floor(round((p_max - 0.5) / 0.025, 6)), 19)"


@query(
    "range_band_join",
    f"""WITH b AS (SELECT {FINE_SQL}::INT AS band, count(*) FILTER (NOT post) AS n0, count(*) FILTER (NOT post AND correct) AS k0, count(*) FILTER (post) AS n1, count(*) FILTER (post AND correct) AS k1 FROM rows GROUP BY 1),
       u AS (SELECT i.i, j.j, sum(n0) AS n_pre, sum(n1) AS n_post, sum(k0) AS k0, sum(k1) AS k1 FROM (SELECT unnest(range(0, 20)) AS i) i, (SELECT unnest(range(0, 20)) AS j) j, b WHERE i.i <= j.j AND band BETWEEN i.i AND j.j GROUP BY 1, 2)
       SELECT round(0.5 + 0.025 * i, 6)::DOUBLE AS "from", round(0.525 + 0.025 * j, 6)::DOUBLE AS "to", n_pre::DOUBLE AS n_pre, n_post::DOUBLE AS n_post, round(k0 / n_pre - k1 / n_post, 8) AS difference FROM u WHERE n_pre >= 30 AND n_post >= 30""",
    "rows",
)
def range_band_join(t: Tables) -> DataFrame:
    u = TS.range_band_join(t.rows).drop("k_pre", "k_post")
    return u.select(
        F.round("from", 6).alias("from"), F.round("to", 6).alias("to"), "n_pre", "n_post", F.round("difference", 8).alias("difference")
    )


@query(
    "confused_pair_overlap",
    f"""WITH {TOP_CTE}, c AS (SELECT replicate, set_name, month, gold, top, count(*) AS n FROM t WHERE top <> gold GROUP BY ALL),
       a AS (SELECT i || '-' || j AS pair, c.* FROM {PAIRS} JOIN c ON replicate = i), b AS (SELECT i || '-' || j AS pair, c.* FROM {PAIRS} JOIN c ON replicate = j)
       SELECT pair, set_name, month, count(a.n) AS pairs_a, count(b.n) AS pairs_b, count(*) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL) AS shared, round(sum(a.n) FILTER (b.n IS NOT NULL) / sum(a.n), 8) AS share_on_shared
       FROM a FULL JOIN b USING (pair, set_name, month, gold, top) GROUP BY 1, 2, 3""",
    "answers",
)
def confused_pair_overlap(t: Tables) -> DataFrame:
    a, b = sides(scope(t))
    return rnd(J.confused_pair_overlap(a, b, ["pair", "set_name", "month"]))


@query(
    "complete_units",
    """SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) = 60 + user_id % 10""",
)
def complete_units(t: Tables) -> DataFrame:
    answers = t.events.select(F.col("user_id").alias("unit"), "event_id")
    expected = t.events.select(F.col("user_id").alias("unit")).distinct().withColumn("replicates", 60 + F.col("unit") % 10)
    done = S.complete_units(answers, expected)
    return done.groupBy(F.col("unit").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))


@query("order_collisions", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def order_collisions(t: Tables) -> DataFrame:
    return J.order_collisions(t.events, "user_id", "event_type")


@query(
    "mismatch_count",
    """SELECT set_name, count(*) AS n, count(*) FILTER (okey % 7 = 0 OR okey % 5 = 0) AS mismatches FROM rows GROUP BY 1""", "rows",
)
def mismatch_count(t: Tables) -> DataFrame:
    """The saved copy lacks every seventh order and is off for every fifth."""
    saved = t.rows.filter("okey % 7 <> 0").select("unit", F.when(F.col("okey") % 5 == 0, F.col("p_max") + 1e-6).otherwise(F.col("p_max") + 1e-12).alias("p_max"))
    return J.mismatch_count(t.rows, saved, ["set_name"])
