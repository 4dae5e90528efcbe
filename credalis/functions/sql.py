"""The scalar functions for use inside SQL text, as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

DIST = "d MAP<STRING, DOUBLE>"
SQL_FUNCTIONS = {
    "dist_mass": (DIST, "DOUBLE", "aggregate(map_values(d), 0D, (a, p) -> a + p)"),
    "dist_entropy": (DIST, "DOUBLE", "aggregate(map_values(d), 0D, (a, p) -> a + CASE WHEN p > 0 THEN -p * ln(p) ELSE 0D END)"),
    "dist_norm_entropy": (DIST, "DOUBLE", "CASE WHEN size(d) >= 2 THEN aggregate(map_values(d), 0D, (a, p) -> a + CASE WHEN p > 0 THEN -p * ln(p) ELSE 0D END) / ln(size(d)) END"),
    "log_score": (f"{DIST}, gold STRING, floor DOUBLE", "DOUBLE", "-ln(greatest(coalesce(d[gold], 0D), floor))"),
    "brier_score": (f"{DIST}, gold STRING", "DOUBLE", "aggregate(map_entries(d), 0D, (a, e) -> a + pow(e.value - CASE WHEN e.key = gold THEN 1D ELSE 0D END, 2))"),
    "tv_distance": (f"{DIST}, q MAP<STRING, DOUBLE>", "DOUBLE", "0.5D * aggregate(map_values(map_zip_with(d, q, (k, a, b) -> abs(coalesce(a, 0D) - coalesce(b, 0D)))), 0D, (a, x) -> a + x)"),
    "choice_confidence": (DIST, "DOUBLE", "CASE WHEN size(d) >= 2 THEN least(1D, greatest(0D, (size(d) * array_max(map_values(d)) - 1) / (size(d) - 1))) END"),
    "clipped_logit": ("p DOUBLE, eps DOUBLE", "DOUBLE", "ln(least(greatest(p, eps), 1 - eps) / (1 - least(greatest(p, eps), 1 - eps)))"),
    "seeded_uniform": ("key STRING", "DOUBLE", "CAST(conv(substr(md5(key), 1, 8), 16, 10) AS DOUBLE) / 4294967296D"),
    "normalise_answer": ("s STRING", "STRING", r"trim(regexp_replace(regexp_replace(lower(s), r'(?U)[^\p{L}\p{N}_\s]', ' '), r'(?U)\s+', ' '))"),
}


def register(spark: SparkSession) -> None:
    """Create the functions in the session; Catalyst inlines them."""
    for name, (args, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
