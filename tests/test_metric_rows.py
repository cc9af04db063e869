"""The blocks of the metric engine and the null rule read metrics that are stored, so a condition on a row does not write them all out."""

from collections import Counter

from conftest import canonical

from motionlake.plans import stroke_metrics as plans


def test_conditions_meet_stored_metrics(spark, small_dir, monkeypatch):
    rows = plans._rows(spark, small_dir)
    assert "array_compact" not in rows._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(plans, "_rows", lambda spark, d: rows)
    every = rows.toPandas()
    every["value"] = every["value"].round(6)
    for name, block in plans.BLOCKS.items():
        assert canonical(plans.QUERIES[name](spark, small_dir).toPandas()) == canonical(every[every.block == block].drop(columns="block"))
    beside = every[(every.flag == "not_detectable") & (every["value"].notna() | every.text.notna())]
    want = Counter(zip(beside.block, beside.metric))
    assert {(r.block, r.metric): r.n for r in plans.d_null_rule(spark, small_dir).collect()} == dict(want)
