"""The registered controls and nulls make as many draws as the reference."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sitelens.catalog import ranking, statistics  # noqa: F401
from sitelens.catalog.registry import QUERIES

BASE = os.environ.get("SITELENS_TEST_TABLES", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not Path(BASE).exists(), reason="test tables are not here")


@pytest.mark.parametrize(
    "name, draws",
    [("matched_random_control", 100), ("pooled_random_control", 100), ("recall_permutations", 10_000), ("recall_excess_test", 10_000), ("cluster_draw_test", 10_000)],
)
def test_draws_behind_a_p_value(spark, name, draws):
    rows = QUERIES[name](spark, BASE).select("n_random").distinct().collect()
    assert [r["n_random"] for r in rows] == [draws]


@pytest.mark.parametrize("name, draws", [("random_global_means", 100), ("cluster_draw_null", 10_000)])
def test_draws_listed(spark, name, draws):
    assert QUERIES[name](spark, BASE).agg(F.countDistinct("iteration")).first()[0] == draws
