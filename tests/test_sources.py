import pytest

from strideline.sources import store, text


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_order_rows_and_columns(spark, tmp_path):
    write(tmp_path / "a" / "Motion.txt", [f"{1000 + i} {i / 2} NaN {i}" for i in range(500)])
    path = str(tmp_path / "a" / "Motion.txt")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        all_rows = text.read_recording(spark, path, 4, ["time", "c", "b"], use_columns=[0, 3, 2]).orderBy("pos").collect()
        clipped = text.read_recording(spark, path, 4, use_rows=(10, 5)).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plan = text.read_recording(spark, path, 4, use_rows=(10, 5))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert [r["time"] for r in all_rows] == [1000 + i for i in range(500)]
    assert [r["pos"] for r in all_rows] == list(range(500)) and all_rows[3]["c"] == 3.0
    assert [r["_0"] for r in clipped] == [1010, 1011, 1012, 1013, 1014]
    with pytest.raises(ValueError):
        text.read_recording(spark, path, 4, ["one"], use_columns=[0, 1])
    with pytest.raises(ValueError):
        text.read_recording(spark, path, 4, use_columns=[9])


def test_trips_keep_the_order_of_the_list(spark, tmp_path):
    for name, n in (("0405", 3), ("0101", 2)):
        write(tmp_path / name / "Label.txt", [f"{i} 5 0 {i % 2} 9" for i in range(n)])
    df = text.read_trips(spark, str(tmp_path) + "/{}/Label.txt", ["0405", "0101"], 4, list(text.LABEL_COLUMNS.values()), [1, 2, 3])
    assert [(r["series_id"], r["pos"]) for r in df.orderBy("series_id", "pos").collect()] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]


def test_recordings_that_share_files(spark, tmp_path):
    sizes = {7: 40, -3: 1, 71: 25, 8: 300}
    rows = [(t, i, 1000 * i + t, float(i)) for t, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "trip bigint, pos bigint, time bigint, a double").repartition(5)
    root = str(tmp_path / "shared")
    text.write_shared_trips(df, "trip", ["pos"], ["time", "a"], root)
    assert len(list((tmp_path / "shared").glob("bundle=*"))) == 3  # 7 and 71 share a folder
    places = spark.createDataFrame([(t, i) for i, t in enumerate([71, 8, 7])], "trip bigint, series_id int")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        every = text.read_trips(spark, text.shared_folder_of(root), places, 2, ["time", "a"]).collect()
        one = text.read_recording(spark, text.shared_folder_of(root, 71), 2, ["a", "time"], use_columns=[1, 0], trip=71).collect()
        some = text.read_recording(spark, text.shared_folder_of(root, 8), 2, use_rows=(290, 50), trip=8).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(tuple(r) for r in every) == [(s, i, 1000 * i + t, float(i)) for s, t in enumerate([71, 8, 7]) for i in range(sizes[t])]
    assert sorted(tuple(r) for r in one) == [(i, float(i), 1000 * i + 71) for i in range(25)]
    assert sorted(r["pos"] for r in some) == list(range(290, 300))


def test_store(spark, tmp_path):
    root = str(tmp_path)
    store.write_table(spark.range(3).toDF("x"), root, "t", "tag")
    assert store.read_table(spark, root, "t", "tag").count() == 3
    store.write_notes(spark, {"a": [1, {"b": 2.5}]}, root, "tag")
    assert store.read_notes(spark, root, "tag") == {"a": [1, {"b": 2.5}]}
