"""What the driver holds stays small: plans without tables in them, no round of contraction without need."""

import pytest

from terradelta.llm import components, quality, queries


def test_quality_weights_are_not_written_into_the_plan(spark, sf_dir):
    docs, labels = (queries.table(spark, sf_dir, name) for name in ("documents", "labels"))
    for made in (quality.judge(docs, labels), quality.keep_good(docs, labels)):
        plan = made._jdf.queryExecution().toString()
        assert len(plan) < 100_000  # as a literal the 16,384 weights alone were more than that, several times
        physical = made._jdf.queryExecution().executedPlan().toString()
        assert "_weights" not in physical  # the subquery stands where it is used: no row carries the weights


@pytest.mark.parametrize("edges, rounds", [([], 0), ([(5, 1), (6, 1), (9, 8), (9, 8)], 0), ([(5, 1), (5, 2)], 1), ([(3, 2), (2, 1)], 1)])
def test_stars_are_not_contracted_again(spark, monkeypatch, edges, rounds):
    done, plain = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda table: done.append(1) or plain(table))
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "hi long, lo long")).collect()}
    assert len(done) == rounds
    assert found == {n: 8 if n == 9 else 1 for pair in edges for n in pair if n not in (1, 8)}
