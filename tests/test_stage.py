"""Intermediate tables go as soon as nothing reads them any more."""

import os

from codestrata.plans import diff
from codestrata.plans.bindings import snapshots
from codestrata.sources import stage as staging


def folders(spark):
    base = staging.shared_dir(spark).removeprefix("file://") + "/codestrata"
    return {f for f in os.listdir(base)} if os.path.isdir(base) else set()


def test_settled_tables_leave_nothing_else(spark):
    held = staging.stage(spark.range(5), "held")
    before = folders(spark)
    inner = []

    def make():
        inner.append(staging.stage(held.selectExpr("id * 2 AS id"), "inner"))
        return inner[0].where("id > 2")

    out = staging.settle(make, "out", instead=held)
    assert sorted(r.id for r in out.collect()) == [4, 6, 8]
    assert len(folders(spark)) == len(before) and not [f for f in folders(spark) - before if f.startswith("inner")]
    assert not any(path.rsplit("/", 1)[1].startswith(("held", "inner")) for _, path in staging._written if path.rsplit("/", 1)[1] not in before)


def test_a_comparison_keeps_its_result_only(spark, sf):
    before = folders(spark)
    details = diff.diff(*snapshots(spark, sf))
    assert len(folders(spark) - before) == 1
    rows = details.select("id", "kind", "lines", "primary").collect()
    assert len({r.id for r in rows}) == len(rows) > 0
    assert any(r.lines for r in rows if r.kind == "BodyChanged") and all(r.lines is None for r in rows if r.kind in ("Added", "Deleted", "Moved"))
