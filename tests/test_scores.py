"""Formulas at known points and boundaries."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import scores as S
from quarry.operators.gates import CONDITIONS, merge_verdict, quality_gate


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


L = F.lit


@pytest.mark.parametrize(("args", "want"), [((0, 0, 0), 0.0), ((10, 400, 1), 41.0), ((20, 0, 0), 50.0), ((40, 2000, 10), 100.0), ((0, 1000, 0), 30.0), ((0, 0, 5), 20.0)])
def test_churn(spark, args, want):
    assert value(spark, S.churn_score(*map(L, args))) == want


def test_hotspot_parts(spark):
    assert value(spark, S.complexity_risk(L(500), L(10), L(2))) == 48.0
    assert value(spark, S.centrality(L(5), L(5))) == 50.0
    assert value(spark, S.severity_burden(L(1), L(1), L(1), L(1))) == 77.0
    assert value(spark, S.hotspot_score(L(50.0), L(40.0), L(20.0))) == 39.0
    assert value(spark, S.defect_score(L(75.0), L(80.0), L(True))) == 77.0
    assert value(spark, S.defect_score(L(75.0), L(None).cast("double"), L(False))) == 75.0


@pytest.mark.parametrize(("score", "want"), [(95, "A+"), (94.9, "A"), (90, "A"), (80, "B"), (70, "C"), (60, "D"), (59.9, "F")])
def test_grades(spark, score, want):
    assert value(spark, S.grade(L(score))) == want


def test_duplication(spark):
    for ratio, blocks, want in ((0.0, 0, 100.0), (10.0, 6, 82.0), (90.0, 100, 0.0)):
        assert value(spark, S.duplication_score(L(ratio), L(blocks))) == want


def test_empty_runs_are_healthy(spark):
    z = L(0)
    assert value(spark, S.maintainability_score(L(0.0), z, z, z, z)) == 100.0
    assert value(spark, S.complexity_score(z, z, z, z, z, z)) == 100.0
    assert value(spark, S.architecture_score(L(1), z, z, z, z, z)) == 100.0


GOOD = {"overall_score": 80.0, "blocker_issues": 0, "circular_dependencies": 0, "critical_issues": 2, "average_maintainability": 55.0, "critical_functions": 3}


@pytest.mark.parametrize(("change", "status"), [({}, "PASSED"), ({"overall_score": 79.9}, "FAILED"), ({"blocker_issues": 1}, "FAILED"), ({"circular_dependencies": 1}, "FAILED"), ({"critical_issues": 3}, "WARNING"), ({"average_maintainability": 54.9}, "WARNING"), ({"critical_functions": 4}, "WARNING")])
def test_gate_boundaries(spark, change, status):
    r = quality_gate(spark.createDataFrame([GOOD | change])).first()
    assert r["status"] == status and r["passed"] == (status != "FAILED") and len(r["conditions"]) == len(CONDITIONS)


def test_gate_thresholds_can_be_given(spark):
    assert quality_gate(spark.createDataFrame([GOOD | {"blocker_issues": 1}]), {"blocker_issues": 1}).first()["status"] == "PASSED"
    with pytest.raises(ValueError, match="unknown"):
        quality_gate(spark.createDataFrame([GOOD]), {"nope": 1})


@pytest.mark.parametrize(("delta", "status"), [(-2.1, "FAILED"), (-2.0, "WARNING"), (-1.0, "WARNING"), (-0.1, "WARNING"), (0.0, "PASSED"), (1.5, "PASSED")])
def test_merge_verdict(spark, delta, status):
    row = spark.createDataFrame([(delta, 0, 0, 0)], "score_delta double, new_blockers int, new_criticals int, new_cycles int")
    assert merge_verdict(row).first()["status"] == status
