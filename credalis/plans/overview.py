"""The flagship query: calibration and ranking of confidence per set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalis.operators import calibration as C
from credalis.operators import ranking as R
from credalis.plans.catalog import query
from credalis.plans.views import Tables


@query(
    "calibration_overview",
    """
    SELECT g.set_name, g.n, round(g.accuracy, 8) AS accuracy, round(g.mean_p_max, 8) AS mean_p_max,
           round(e.ece, 8) AS ece, round(a.auroc, 8) AS auroc
    FROM (SELECT set_name, count(*) AS n, avg(correct::INT) AS accuracy, avg(p_max) AS mean_p_max FROM rows GROUP BY 1) g
    JOIN (SELECT set_name, sum(abs(d)) / sum(n) AS ece FROM (
            SELECT set_name, least(floor(p_max * 10), 9) AS bin, count(*) AS n, sum(correct::INT - p_max) AS d
            FROM rows GROUP BY 1, 2) GROUP BY 1) e USING (set_name)
    JOIN (SELECT set_name, sum(pos * (before + neg / 2.0)) / (sum(pos) * sum(neg)) AS auroc FROM (
            SELECT *, coalesce(sum(neg) OVER (PARTITION BY set_name ORDER BY p_max
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
              SELECT set_name, p_max, count(*) FILTER (correct) AS pos, count(*) FILTER (NOT correct) AS neg
              FROM rows GROUP BY 1, 2)) GROUP BY 1) a USING (set_name)
    """,
    "rows",
)
def calibration_overview(t: Tables) -> DataFrame:
    rows = t.rows
    g = rows.groupBy("set_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg("p_max").alias("mean_p_max"),
    )
    out = g.join(C.ece(rows, ["set_name"], "p_max", "correct", 10), "set_name")
    out = out.join(R.auroc(rows, ["set_name"], "p_max", "correct").drop("n", "n_positive"), "set_name")
    return out.select(
        "set_name", "n", *[F.round(c, 8).alias(c) for c in ("accuracy", "mean_p_max", "ece", "auroc")]
    )
