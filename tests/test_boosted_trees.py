"""Boosted trees run all rounds of the reference."""

import pytest

from quartz_panel.operators import models as M
from quartz_panel.plans import registry
from quartz_panel.plans import service_queries as Q


def test_the_query_fits_all_rounds(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 7, float(i % 5), float(i % 3), float(i % 5 > 2)) for i in range(240)], "date int, ticker_id int, a double, b double, r_3M double").coalesce(1)
    fits, fit = [], M.fit_trees
    monkeypatch.setattr(Q, "_prepared", lambda *a: rows)
    monkeypatch.setattr(Q, "_FEATURES", ["a", "b"])
    monkeypatch.setattr(Q.M, "fit_trees", lambda *a, **k: fits.append(fit(*a, **k)) or fits[-1])
    assert registry.QUERIES["m05_boosted_trees"](spark, "").count() == 240
    assert [m.getNumTrees for m in fits[0]] == [300, 300]
    assert all(m.treeWeights[-1] == pytest.approx(0.03) for m in fits[0])
