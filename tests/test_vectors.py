"""Whole vectors as features."""

import __spark_entry__ as entry
import numpy as np


def test_last_coordinate_counts(spark, tmp_path):
    """Classes that only the last of twelve coordinates tells apart."""
    rng = np.random.default_rng(3)
    label = rng.integers(0, 10, 200)
    x = rng.normal(size=(200, 12))
    x[:, 11] += np.where(label < 5, 3.0, -3.0)
    rows = [(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x, strict=True))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert entry.queries()["stratified_oof_scores"](spark, str(tmp_path)).first()["auroc"] > 0.97
