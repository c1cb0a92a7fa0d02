"""Importance resampling: the target model takes every labelled good text."""

import random

import pytest

from voxelweave.llm import importance


def test_target_is_every_labelled_good_text(spark):
    n = 20_500  # up to 20,000 were taken before
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality")
    assert importance.target_ids(labels).count() == n


def test_quantile_is_the_exact_percentile(spark):
    draw = random.Random(3)
    values = [round(draw.gauss(0, 5), 2) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for share in (0.0, 0.002, 0.25, 0.5, 1.0):
        assert importance.quantile(df, "v", share) == pytest.approx(df.selectExpr(f"percentile(v, {share})").first()[0], abs=1e-12)
    assert importance.quantile(df.limit(0), "v", 0.5) is None


def test_target_texts_do_not_follow_the_size_of_the_ids(spark, monkeypatch, capsys):
    monkeypatch.setattr(importance, "FILTER_BITS", 8)  # many ids share a bit: the join decides
    docs = spark.createDataFrame([(i if i % 50 else None, f"text {i}") for i in range(2000)], "doc_id long, text string")
    ids = spark.range(0, 3000, 7).selectExpr("id AS doc_id")
    found = importance.target_texts(docs, ids)
    got = sorted(tuple(r) for r in found.collect())
    assert got == [(i, f"text {i}") for i in range(2000) if i % 7 == 0 and i % 50]
    found.explain()
    plan = capsys.readouterr().out
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.index("ShuffledHashJoin") < plan.index("BroadcastHashJoin")  # the filter comes before the shuffle
