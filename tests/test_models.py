"""Spark ML fits against closed forms."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from panelspark.operators import models as ML


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2))
    y = np.round(np.exp(0.4 + 0.3 * x[:, 0] - 0.2 * x[:, 1]) + rng.random(80))
    rows = [(float(a), float(b), float(t)) for (a, b), t in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    return x, y, VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


def test_ridge_equals_the_closed_form(design):
    x, y, df = design
    model = ML.fit(df, "ridge", "y", {"alpha": 2.0}, 1)
    xc, yc = x - x.mean(0), y - y.mean()
    expect = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(2), xc.T @ yc)
    assert list(model.coefficients) == pytest.approx(list(expect), abs=1e-8)


def test_poisson_solves_its_penalised_score_equations(design):
    x, y, df = design
    alpha = 0.5
    model = ML.fit(df, "poisson", "y", {"alpha": alpha}, 1)
    w = np.array(model.coefficients)
    mu = np.exp(model.intercept + x @ w)
    assert np.mean(mu - y) == pytest.approx(0.0, abs=1e-6)
    assert x.T @ (mu - y) / len(y) + alpha * w == pytest.approx([0.0, 0.0], abs=1e-5)


def test_scores_are_clipped(spark, design):
    _, _, df = design
    model = ML.fit(df.withColumn("y", F.col("a") * 10.0), "ridge", "y", {"alpha": 0.1}, 1)
    out = ML.score(model, "ridge", df)
    assert out.agg(F.min("prediction")).first()[0] == 0.0
    assert "features" not in out.columns


def test_search_draws_are_reproducible(spark):
    a = ML.sampled_params(spark, "random_forest", 3, 7)
    assert a == ML.sampled_params(spark, "random_forest", 3, 7) and len(a) == 3
    assert all(64 <= p["n_estimators"] <= 256 and 4 <= p["max_depth"] <= 10 for p in a)
