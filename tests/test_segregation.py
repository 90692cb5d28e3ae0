import pytest
from pyspark.sql import functions as F

from loomspan.operators import segregation as G


def test_expected_ratios():
    assert G.expected(2, 1, 1) == pytest.approx((0.25, 0.5, 0.25))
    assert G.expected(4, 1, 0) == pytest.approx((0.5, 0.5, 0, 0, 0))
    assert G.expected(4, 2, 0) == pytest.approx((1 / 6, 4 / 6, 1 / 6, 0, 0))
    assert G.expected(6, 1, 1) == pytest.approx((0.25, 0.5, 0.25, 0, 0, 0, 0))


def test_exact_p_values():
    assert G.multinomial_p([1, 1], (0.5, 0.5)) == pytest.approx(1.0)
    assert G.multinomial_p([4, 0], (0.5, 0.5)) == pytest.approx(2 / 16)
    assert G.multinomial_p([1, 0, 1], (0.5, 0.5, 0.0)) == 0.0
    many = G.multinomial_p([500, 1000, 500], (0.25, 0.5, 0.25))
    assert many > 0.5 and G.multinomial_p([700, 800, 500], (0.25, 0.5, 0.25)) < 0.01


def test_columns(spark):
    sites = spark.createDataFrame([([1, 2, 1], 1, 1)], "counts array<int>, dosage_a int, dosage_b int")
    assert G.segregation_test(sites, 2).first().p == pytest.approx(1.0)
    calls = spark.createDataFrame([(5, 0), (3, 3), (0, 6), (0, 0)], "r int, a int").select(G.genotype_text(G.called_dosage(F.col("r"), F.col("a"), 2), 2).alias("gt"))
    assert [r.gt for r in calls.collect()] == ["0/0", "0/1", "1/1", "./."]
