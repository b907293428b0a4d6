import os

import pytest
from pyspark.sql import functions as F

from strideline.functions import relevance as rl
from strideline.models.metrics import representative
from strideline.plans import runs
from strideline.sources import store
from workload.flows import quick, run_frames

SF = os.environ.get("STRIDELINE_SF", "/root/testdata/sf0.01")


def test_wide_imputation_equals_the_long_one(spark):
    nan, inf = float("nan"), float("inf")
    wide = spark.createDataFrame([(1, 1.0, nan, None), (2, None, 3.0, None), (3, inf, -inf, nan), (4, 5.0, 9.0, None)], "b int, `x__a` double, `x__b` double, `x__c` double")
    long = rl.melt_features(wide, ["b"])
    values = {r["feature"]: r.asDict() for r in rl.imputation_values(long).collect()}
    got = {(r.b, c): r[c] for r in rl.impute_wide(wide, {**values, "x__c": {}}).collect() for c in ("x__a", "x__b", "x__c")}
    want = {(r.b, r.feature): r.value for r in rl.impute(long).collect()}
    assert got == want
    assert got[2, "x__a"] == 3.0 and got[3, "x__a"] == 5.0 and got[3, "x__b"] == 3.0 and got[1, "x__c"] == 0.0


def test_gate_looks_at_city(spark, monkeypatch):
    """Bounds (0.1, 0.4) pass a share of 30 % city, and not one of 70 %."""
    seen = []
    monkeypatch.setattr(runs, "isolation_filter", lambda df, *a, **k: df)
    monkeypatch.setattr(runs, "random_search", lambda *a, **k: None)
    monkeypatch.setattr(runs, "score", lambda *a, **k: 1.0)
    for cities in (30, 70):
        rows = [(p, i, 0 if i < cities else 1, float(i)) for p in ("train", "test") for i in range(100)]
        table = spark.createDataFrame(rows, "part string, block_id int, label int, f double")
        _, gate, models = runs._search(0, table, ["f"], ["part", "block_id"], quick(models=["cart_tree"], class_bounds=(0.1, 0.4)))
        assert gate["train_share"] == cities / 100 and bool(models) == gate["distribution_ok"]
        seen.append(gate["distribution_ok"])
    assert seen == [True, False]
    assert representative(table.withColumn("combo", F.lit(0)), ["combo"], "part", "label", 0, 0.1, 0.8).first()["distribution_ok"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_training_and_inference(spark, tmp_path):
    readings, labels = run_frames(spark, SF)
    settings, root = quick(models=["cart_tree"]), f"{tmp_path}/run"
    summary = runs.train_run(spark, readings, labels, settings, root).collect()
    assert sum(r["chosen"] for r in summary) == 1 and all(0 <= r["score"] <= 1 for r in summary)
    notes = store.read_notes(spark, root, summary[0]["run_tag"])
    assert set(notes["imputation"]) == set(notes["selected"])
    valid = store.read_table(spark, root, "validation", summary[0]["run_tag"])
    right = valid.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    share = valid.agg(F.avg("label")).first()[0]
    assert right >= max(share, 1 - share) - 1e-9
    said = runs.inference_run(spark, readings, settings, root)
    assert {r[0] for r in said.select("prediction").distinct().collect()} <= {0.0, 1.0}
    assert said.count() == said.select("block_id").distinct().count()


def test_grid_computes_shared_stages_once(spark, tmp_path, monkeypatch):
    made = {"signal": 0, "features": 0}

    def count(name, result):
        def run(*args):
            made[name] += 1
            return result
        return run

    monkeypatch.setattr(runs, "prepare_training", count("signal", (None, {"mean": 0.0})))
    monkeypatch.setattr(runs, "statistical_tables", count("features", (None, [], None, {})))
    monkeypatch.setattr(runs, "train_run", lambda spark, r, y, s, root, stages: (stages.signal(s), stages.features(s), spark.createDataFrame([(runs.tag_of(s),)], "run_tag string"))[2])
    grid = [quick(block_rows=b, reduction=r, models=m) for b in (10, 15) for r in ("euclidean", "pca") for m in (["svc"], ["cart_tree"])]
    out = runs.experiment_grid(spark, None, None, grid, str(tmp_path))
    assert made == {"signal": 2, "features": 4} and out.distinct().count() == len(grid) == 8
    with pytest.raises(ValueError):
        runs.experiment_grid(spark, None, None, [grid[0], quick(block_rows=10, reduction="euclidean", models=["svc"])], str(tmp_path))
