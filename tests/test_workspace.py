"""Reads of a workspace against expected rows, and what they refuse."""

import cases_golden
import cases_reads
import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.operators.workspace import Workspace
from tallyspark.plans import pipeline

CASES = cases_reads.QUERIES | cases_golden.QUERIES
EXPECTED = cases_reads.ORACLES | cases_golden.ORACLES


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    got = CASES[name](spark, "")
    rows = duckdb.connect().execute(EXPECTED[name])
    columns = [c[0] for c in rows.description]
    key = lambda r: tuple(map(str, r))
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v
    assert sorted(columns) == sorted(got.columns)
    assert sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=key) == sorted((tuple(map(plain, r)) for r in rows.fetchall()), key=key)


def test_reads_of_an_empty_workspace(spark):
    w = Workspace(3, cases_reads.tables(spark))
    assert w.done() == set()
    assert [r["n"] for r in w.summary().collect()] == [0] * 13
    for rows in (w.customers(), w.matches(), w.reconciliation(), w.review(), w.critic(), w.position(), w.changes(F.lit(0)), w.relationships()):
        assert rows.isEmpty()


def test_stages_run_after_those_that_are_done(spark, tmp_path):
    """Ingestion's own rows don't count as marks: workspace 2 has an entity without confidence and an unread contract."""
    tables = cases_reads.tables(spark)
    assert Workspace(2, tables).done() == {"revenue", "anomaly"}
    stages = {"publish": lambda t: {"versions": t["versions"]}, "review": lambda t: {"judgements": t["judgements"]}}
    _, log = pipeline.run(tables, stages, str(tmp_path / "a"), ["review"], Workspace(2, tables).done())
    assert log == [("review", "done")]
    _, log = pipeline.run(tables, stages, str(tmp_path / "b"), ["publish"], Workspace(2, tables).done())
    assert log == [("publish", "needs review")]
    with pytest.raises(pipeline.StageError):
        pipeline.run(tables, stages, str(tmp_path / "c"), ["nothing"])
    assert pipeline.affected({"reconciliation"}) == ["reconciliation", "revenue", "anomaly", "review", "publish"]


def test_limits_of_reads(spark):
    w = Workspace(1, cases_reads.tables(spark))
    for call in (lambda: w.matches(limit=501), lambda: w.evidence(limit=0), lambda: w.neighbourhood("x", 4), lambda: w.relationships(5), lambda: w.decide(1, "ACCEPTED", " ")):
        with pytest.raises(ValueError):
            call()
    before = w.tables["matches"].collect()
    assert w.decide(99, "ACCEPTED", "no such link")["matches"].collect() == before
