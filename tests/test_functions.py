import math

import pytest
from pyspark.sql import functions as F

from loomspan.functions import scalar as X
from loomspan.functions import sequences as S


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def lit(*xs):
    return F.array(*[F.lit(x) for x in xs])


@pytest.mark.parametrize(("column", "want"), [
    (lambda: X.kosambi(F.lit(0.01)), 0.0100013337), (lambda: X.kosambi(F.lit(0.1)), 0.1013662770), (lambda: X.kosambi(F.lit(0.4999999)), 4.0295238877),
    (lambda: X.haldane(F.lit(0.01)), 0.0101013537), (lambda: X.haldane(F.lit(0.1)), 0.1115717757),
    (lambda: X.inverse_kosambi(F.lit(0.3)), 0.2685247835), (lambda: X.inverse_kosambi(F.lit(0.5)), 0.3807970780), (lambda: X.inverse_haldane(F.lit(0.1)), 0.0906346235),
    (lambda: X.centimorgan(F.lit(0.1)), 10.1366277), (lambda: X.lod(F.lit(0.0), F.lit(100)), 30.1029252), (lambda: X.lod(F.lit(0.1), F.lit(100)), 15.9848254), (lambda: X.lod(F.lit(0.3), F.lit(50)), 1.7867500),
    (lambda: X.rf_from_lod(F.lit(15.9848254), F.lit(100)), 0.1), (lambda: X.log10_choose(F.lit(10), F.lit(3)), math.log10(120)), (lambda: X.log_sum_exp(lit(1000.0, 1000.0)), 1000 + math.log(2)),
    (lambda: X.log_binomial_pmf(F.lit(2), F.lit(5), F.lit(0.3)), math.log(10 * 0.09 * 0.343)), (lambda: X.log_poisson_pmf(F.lit(2), F.lit(3.0)), math.log(4.5 * math.exp(-3))),
])
def test_numbers(spark, column, want):
    assert value(spark, column()) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("ploidy", "ref", "alt", "want"), [
    (2, 3, 1, [8.089744, 0, 48.002448]), (2, 0, 4, [79.825408, 11.866608, 0]), (4, 6, 2, [20.722068, 0, 4.542580, 18.624644, 100.547476]),
])
def test_binomial_likelihoods(spark, ploidy, ref, alt, want):
    pl = X.binomial_pl(F.lit(float(ref)), F.lit(float(alt)), ploidy)
    assert value(spark, pl) == pytest.approx(want, abs=1e-5)
    assert value(spark, X.genotype_quality(pl)) == pytest.approx(sorted(want)[1], abs=1e-5)


def test_arrays(spark):
    assert value(spark, X.phred_to_likelihood(lit(0.0, 20.0, 40.0))) == pytest.approx([0.9900009900, 0.0099000099, 0.0000990001], abs=1e-9)
    assert value(spark, X.phred_to_likelihood(lit(0.0, 0.0))) == [0.0, 0.0]
    assert value(spark, X.normalise(lit(1.0, 3.0))) == [0.25, 0.75]
    assert value(spark, X.hamming(lit(1, 2, 3), lit(1, 5, 3))) == 1
    assert value(spark, X.transpose(F.array(lit(1, 2, 3), lit(4, 5, 6)))) == [[1, 4], [2, 5], [3, 6]]
    assert value(spark, X.arg_max(lit(1, 5, 5))) == 1 and value(spark, X.arg_min(lit(3, 1, 1))) == 1
    assert value(spark, X.positive_min(lit(-1, 3, 2))) == 2 and value(spark, X.positive_max(lit(-1, 3, 2))) == 3
    assert value(spark, X.hard_pl(F.lit(1), 2)) == [255, 0, 255] and value(spark, X.hard_pl(F.lit(None).cast("int"), 2)) == [0, 0, 0]
    assert value(spark, X.choose(F.lit(40).cast("long"), F.lit(20))) == math.comb(40, 20) and value(spark, X.choose(F.lit(4).cast("long"), F.lit(0))) == 1
    assert value(spark, X.paste(lit(1, 2), ":")) == "1:2" and value(spark, X.add(lit(1, 2), lit(3, 4))) == [4, 6]
    assert value(spark, X.gap_to_bp(lit(0.1, 0.2)))[0] == pytest.approx(11157177.57, abs=1) and value(spark, X.gap_to_bp(lit(5.0, 0.2))) == [5.0, 0.2]
    assert value(spark, X.all_negative_infinity(lit(float("-inf")))) is True
    assert [value(spark, X.well(F.lit(i))) for i in (0, 11, 12)] == ["A01", "A12", "B01"]
    assert value(spark, X.truncated_id(lit("a", "b"))) == "a____b" and value(spark, X.truncated_id(lit("a" * 100, "b" * 50))).endswith("____etc2")


@pytest.mark.parametrize("r", [1e-6, 0.01, 0.2, 0.4, 0.499])
def test_map_functions_invert(spark, r):
    assert value(spark, X.inverse_kosambi(X.kosambi(F.lit(r)))) == pytest.approx(r, abs=1e-9)
    assert value(spark, X.inverse_haldane(X.haldane(F.lit(r)))) == pytest.approx(r, abs=1e-9)


def test_sequences(spark):
    assert value(spark, S.reverse_complement(F.lit("ACGTNacgtn"))) == "nacgtNACGT"
    assert value(spark, S.reverse_complement(S.reverse_complement(F.lit("AACCGTn-x")))) == "AACCGTn-x"
    assert [len(x) for x in value(spark, S.wrap(F.lit("a" * 250), 100)).split("\n")] == [100, 100, 50]
    assert value(spark, S.wrap(F.lit("a" * 200), 100)) == "a" * 100 + "\n" + "a" * 100
    assert value(spark, S.clean_name(F.lit("ctg|2.1"))) == "ctg_2_1" and value(spark, S.sample_name(F.lit("F1:x"))) == "F1"
    assert value(spark, S.motif_sites(F.lit("aaGCAGCAGC"), "GCAGC")) == [3, 6]
