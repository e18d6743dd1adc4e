import json

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

import __spark_entry__ as entry
from furrow.operators import plots as P
from furrow.operators import registry as R
from furrow.operators.spatial import max_overlap_join, pip_join
from furrow.operators.traits import plot_traits
from furrow.plans.storage import append_new, read_snapshot, stored_keys, write_snapshot
from furrow.sources import files, sensors
from furrow.streaming import jobs

BORDERS = "plot_index int, start_lat double, start_lon double, end_lat double, end_lon double, stitch_direction string"


def drive(spark, marks):
    return spark.createDataFrame(
        [(i, f"/top/{i}.jpg", p, "up" if p >= 0 else None, float(i), -float(i)) for i, p in enumerate(marks)],
        "row int, image string, plot_index int, stitch_direction string, lat double, lon double")


def column(df, name="plot_index"):
    return [r[name] for r in df.orderBy("row").collect()]


def test_marking_moves_a_plot_and_adds_its_border(spark):
    synced = drive(spark, [-1, 1, 1, -1, 2, 2, -1])
    none = spark.createDataFrame([], BORDERS)
    marked, borders = P.mark_plot(synced, none, 1, "/top/2.jpg", "/top/4.jpg", "row", "image", "down")
    assert column(marked) == [-1, -1, 1, 1, 1, 2, -1]
    assert column(marked, "stitch_direction") == [None, None, "down", "down", "down", "up", None]
    assert tuple(borders.first()) == (1, 2.0, -2.0, 4.0, -4.0, "down")
    _, again = P.mark_plot(synced, borders, 1, "/top/0.jpg", "/top/1.jpg", "row", "image")
    assert again.count() == 1 and again.first()["start_lat"] == 2.0
    assert column(P.delete_plot(marked, 1)) == [-1, -1, -1, -1, -1, 2, -1]


def test_shift_drops_rows_out_of_bounds_and_overwrites(spark):
    synced = drive(spark, [5, 3, 3, 6, 6, -1])
    assert column(P.shift_plots(synced, "row", 3, 2)) == [-1, 6, 6, -1, -1, -1]
    assert column(P.shift_plots(synced, "row", 3, -2)) == [-1, 3, 5, -1, -1, 6]


def test_shift_and_undo_is_identity(spark):
    synced = drive(spark, [-1, 1])
    moved = P.shift_gps(P.shift_gps(synced, 2.0, 2.0, 1.0, 1.5), 9.0, 9.0, 1.0, 1.0)
    assert column(moved, "lat") == [9.0, 10.0] and P.shift_status(moved).first()["shifted"]
    assert column(P.undo_shift(moved), "lat") == [0.0, 1.0]
    assert P.undo_shift(moved).columns == synced.columns and not P.shift_status(synced).first()["shifted"]


@pytest.mark.parametrize("n,middle", [(1, 0), (4, 2), (5, 2)])
def test_middle_row(spark, n, middle):
    df = spark.createDataFrame([("p", i) for i in range(n)], "plot string, t int")
    assert P.middle_per_group(df, ["plot"], ["t"]).first()["t"] == middle


def test_first_value_per_plot_skips_nulls(spark):
    df = spark.createDataFrame([(0, 1, None), (1, 1, "b"), (2, 0, "c"), (3, -1, "d")], "row int, plot_index int, v string")
    assert {r["plot_index"]: r["v"] for r in P.first_per_plot(df, "row", ["v"]).collect()} == {1: "b", 0: "c"}


def test_bands_with_equal_centres_and_the_middle_column(spark):
    df = spark.createDataFrame([("i", 10, 100), ("i", 20, 200), ("i", 30, 200), ("i", 50, 1), ("i", 80, 7)], "image string, cx int, cy int").withColumn("width", F.lit(100)).withColumn("height", F.lit(300))
    out = sorted((r["side"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in P.partition_bands(df).collect())
    assert out == [(1, 0, 0, 50, 150), (1, 0, 150, 50, 200), (1, 0, 200, 50, 300), (2, 50, 0, 100, 300)]


def test_padded_plots_count_one(spark):
    areas = spark.createDataFrame([(1, 1, "p", "a", "x"), (1, 2, "q", None, "x")], "Bed int, Tier int, plot string, accession string, population string")
    plants = spark.createDataFrame([(1, 1, 1, 10.25, 2.0, 3.0), (1, 1, 2, 10.25, 4.0, 4.0)], "Bed int, Tier int, id int, `Height (cm)` double, `Area (cm2)` double, `Pod Count` double")
    out = {r["Tier"]: r for r in plot_traits(plants, areas, "pod", "id").collect()}
    assert (out[1]["Stand Count"], out[1]["Average Height (cm)"], out[1]["Total Pod Count"]) == (2, 10.2, 7)
    assert (out[2]["Stand Count"], out[2]["Total Pod Count"], out[2]["accession"]) == (1, 0, "0")
    strict = {r["Tier"]: r["Stand Count"] for r in plot_traits(plants, areas, "pod", "id", count_padded=False).collect()}
    assert strict == {1: 2, 2: 0}


def test_points_upserted_and_deleted(spark):
    schema = "image string, pointX double, pointY double"
    old = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0)], schema)
    new = spark.createDataFrame([("a", 9.0, 9.0), ("b", None, 2.0), ("c", 3.0, 3.0), ("d", None, None)], schema)
    assert sorted(tuple(r) for r in P.upsert_gcp(old, new).collect()) == [("a", 9.0, 9.0), ("c", 3.0, 3.0)]


def test_best_run_first_of_equals(spark):
    metrics = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.801), ("b", 1, 0.8), ("c", 1, 0.1)], f"run_id string, epoch int, `{R.METRIC}` double")
    runs = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "run_id string, seen int")
    assert R.best_run(runs, metrics, "seen").first()["run_id"] == "b"
    assert R.best_run(runs.where("run_id = 'c'"), metrics, "seen").first()["run_id"] == "c"


def test_snapshots_and_idempotent_append(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert [write_snapshot(df, str(tmp_path / "s")), write_snapshot(df.limit(1), str(tmp_path / "s"))] == [0, 1]
    assert read_snapshot(spark, str(tmp_path / "s")).count() == 1 and read_snapshot(spark, str(tmp_path / "s"), 0).count() == 2
    for _ in range(2):
        append_new(str(tmp_path / "t"), df.unionByName(df), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_synced_csv_keeps_short_and_skips_long_lines(spark, tmp_path):
    (tmp_path / "m.csv").write_text(' id , name,v\n1,a,1.5\n2,b\n3,"x,y",2.5,extra\n4,"p,q",3.5\n')
    schema = StructType([StructField("id", LongType()), StructField("name", StringType()), StructField("v", DoubleType())])
    out = files.read_synced(spark, str(tmp_path / "m.csv"), schema)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", 1.5), (2, "b", None), (4, "p,q", 3.5)]
    assert out.select("v").where("id = 4").first()["v"] == 3.5


def test_feature_collection(spark, tmp_path):
    square = [[0, 0], [1, 0], [1, 1], [0, 0]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"plot": 7, "row": 2, "accession": "A"}, "geometry": {"type": "Polygon", "coordinates": [square]}},
        {"type": "Feature", "properties": {"Plot": "8", "Tier": 3}, "geometry": {"type": "Polygon", "coordinates": [square]}}]}
    (tmp_path / "b.geojson").write_text(json.dumps(doc, indent=1))
    out = files.normalize_props(files.read_boundaries(spark, str(tmp_path / "b.geojson"))).orderBy("ordinal").collect()
    assert [(r["Plot"], r["Tier"], r["Label"], len(r["ring"])) for r in out] == [("7", "2", "A", 4), ("8", "3", None, 4)]


def test_shapes_of_several_rings_round_trip(spark, tmp_path):
    ring = lambda x, y, side: [[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]
    shapes = {  # outer rings and holes in either direction
        "hole": ("Polygon", [ring(0, 0, 9)[::-1], ring(3, 3, 3)]),
        "two": ("MultiPolygon", [[ring(20, 0, 2)], [ring(30, 0, 9)[::-1], ring(31, 1, 2), ring(35, 5, 2)[::-1]]]),
        "plain": ("Polygon", [ring(50, 0, 1)]), "point": ("Point", [1, 2])}
    doc = {"type": "FeatureCollection", "features": [
        {"properties": {"id": k}, "type": "Feature", "geometry": {"coordinates": c, "type": t}} for k, (t, c) in shapes.items()]}
    (tmp_path / "in.geojson").write_text(json.dumps(doc, indent=2))
    read = files.read_boundaries(spark, str(tmp_path / "in.geojson")).where("rings IS NOT NULL")
    files.write_boundaries(read.drop("ordinal").repartition(2), str(tmp_path / "out"))
    for part in (tmp_path / "out").glob("part-*"):
        features = json.loads(part.read_text())["features"]
        assert {f["properties"]["id"]: f["geometry"]["type"] for f in features}.items() <= {"hole": "Polygon", "two": "MultiPolygon", "plain": "Polygon"}.items()
    key = lambda df: sorted((r["props"]["id"], r["rings"]) for r in df.collect())
    assert key(read) == key(files.read_boundaries(spark, str(tmp_path / "out"))) == key(files.read_feature_lines(spark, str(tmp_path / "out")))
    places = {(1, 1): "hole", (4, 4): None, (3, 4): None, (0, 5): None, (21, 1): "two", (25, 1): None, (32, 2): None, (34, 4): "two", (36, 6): None, (50.5, 0.5): "plain"}
    points = spark.createDataFrame([(float(x), float(y)) for x, y in places], "lon double, lat double")
    inside = pip_join(points, read.select(F.col("props")["id"].alias("id"), "rings"), ring="rings", base=1.0).collect()
    assert {(r["lon"], r["lat"]): r["id"] for r in inside} == {k: v for k, v in places.items() if v}
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 9.0), (2, 30.0, 0.0, 34.0, 4.0)], "image int, x0 double, y0 double, x1 double, y1 double")
    best = max_overlap_join(boxes, read.select(F.col("props")["id"].alias("id"), "rings"), ["image"], "id", ring="rings", base=1.0)
    assert {r["image"]: (r["id"], r["overlap"]) for r in best.collect()} == {1: ("hole", 72.0), 2: ("two", 12.0)}


def test_gcp_list_file_has_its_crs_line(spark, tmp_path):
    pts = spark.createDataFrame([(-121.5, 38.5, 1.5, 2.5, "a.jpg", "g1", 4000, 3000)], "gcp_lon double, gcp_lat double, pointX double, pointY double, image string, gcp_label string, naturalWidth int, naturalHeight int")
    files.write_gcp_list(pts, str(tmp_path / "g"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert text == ["EPSG:4326", "-121.5 38.5 0 1.5 2.5 a.jpg g1 4000 3000"]
    assert files.read_gcp_list(spark, str(tmp_path / "g")).collect() == pts.select(*files.read_gcp_list(spark, str(tmp_path / "g")).columns).collect()


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_long_lists_are_part_files_in_order(spark, tmp_path, n):
    images = spark.range(n).selectExpr("concat('x/', lpad(id, 6, '0')) AS image_path", "double(id) AS lon", "1D AS lat", "0D AS alt")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_geo(images, str(tmp_path / "geo"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = sorted((tmp_path / "geo").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines == ["EPSG:4326"] + [f"{i:06d} {float(i)} 1.0 0.0 0 0 0 0 0" for i in range(n)]
    assert n < 5000 or len(parts) > 1


def test_combined_logs_as_text_files(spark, tmp_path):
    logs = spark.createDataFrame([("g", f"d/{i:02d}.log", f"line {i}") for i in (3, 1, 2)] + [("h", "d/a.log", "x")], "group string, path string, text string")
    files.write_combined_logs(logs, str(tmp_path / "logs"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "logs" / "group=g").glob("part-*")))
    assert text == "=== 01.log ===\nline 1\n=== 02.log ===\nline 2\n=== 03.log ===\nline 3\n"
    assert files.combined_logs(logs).where("group = 'g'").first()["text"] + "\n" == text


def test_catalog_scan_reads_no_content(spark, tmp_path):
    base = tmp_path / "Raw/2024/exp/Davis/pop/2024-05-01/drone/RGB"
    for name in ("Images/a.jpg", "Images/.hidden", "temp/b.jpg"):
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text("x")
    listed = files.scan_catalog(spark, str(tmp_path))
    assert [(r["zone"], r["year"], r["sensor"], r["folder"], r["name"]) for r in listed.collect()] == [("Raw", "2024", "RGB", "Images", "a.jpg")]
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()


def test_gps_rows_conform(spark, collect):
    raw = spark.createDataFrame([("5", "True", "x"), ("5", "True", "x"), ("3", "False", "1.5")], "stamp string, rel_pos_valid string, accuracy_north string")
    out = sensors.conform_gps(raw, "relposned")
    assert out.columns == sensors.GPS_COLUMNS["relposned"]
    assert collect(out.select("stamp", "rel_pos_valid", "accuracy_north", "accuracy_east")) == [(3, 0.0, 1.5, None), (5, 1.0, None, None)]


def test_written_boundary_files_hold_a_bounded_number(spark, tmp_path, collect):
    path = str(tmp_path / "b")
    square = "array(struct(0D AS x, 0D AS y), struct(1D AS x, 0D AS y), struct(1D AS x, 1D AS y), struct(0D AS x, 0D AS y)) AS ring"
    rows = spark.range(0, 8, 1, 1).selectExpr("map('id', string(id)) AS props", square)
    files.write_boundaries(rows, path, features=3)
    found = [json.loads(p.read_text()) for p in sorted((tmp_path / "b").glob("part-*"))]
    assert [len(d["features"]) for d in found] == [3, 3, 2]
    for read in (files.read_boundaries, files.read_feature_lines):
        back = read(spark, path).selectExpr("props['id'] AS id", "ring")
        assert collect(back, "id") == collect(rows.selectExpr("props['id'] AS id", "ring"), "id")
    (tmp_path / "one.json").write_text("\ufeff" + json.dumps(found[1], indent=1), encoding="utf-8")
    assert files.read_boundaries(spark, str(tmp_path / "one.json")).count() == 3


def _with_oracle(tmp_path, spark, name, events):
    """Rows of a query on events (event_id, ts, user_id, event_type, value) and those of its SQL."""
    queries, sql = entry.queries()[name], entry.oracle_sql()[name]
    con = duckdb.connect()
    con.sql(f"CREATE TABLE events AS SELECT * FROM (VALUES {events}) t(event_id, ts, user_id, event_type, value)")
    con.sql(f"COPY (SELECT event_id::BIGINT AS event_id, ts::TIMESTAMP AS ts, user_id::BIGINT AS user_id, event_type, "
            f"value::DOUBLE AS value FROM events) TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE OR REPLACE TABLE events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = queries(spark, str(tmp_path))
    key = lambda row: tuple((v is not None, v) for v in row)
    return (sorted(map(tuple, got.collect()), key=key),
            sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall(), key=key))


def test_events_of_one_stamp_stay_apart(spark, tmp_path):
    got, want = _with_oracle(tmp_path, spark, "gps_topic_conformed",
                             "(1, '2024-01-01 00:00:01', 2, 'a', 1.5), (2, '2024-01-01 00:00:01', 2, 'a', 2.5), "
                             "(3, '2024-01-01 00:00:01', 2, 'a', 2.5), (4, '2024-01-01 00:00:02', 3, 'b', 0.5)")
    assert got == want and len(got) == 4


def test_telemetry_keeps_a_measured_zero(spark, tmp_path, collect):
    got, want = _with_oracle(tmp_path, spark, "telemetry_messages",
                             "(1, '2024-01-01', 1, 'a', 0.0), (2, '2024-01-01', 4, 'a', 0.0), (3, '2024-01-01', 5, 'b', 7.25)")
    assert got == want and len(got) == 3
    raw = spark.createDataFrame([(1, 0.0), (2, 3.5)], "timestamp long, Lat double")
    assert collect(sensors.telemetry_gps(raw).select("lat"), "lat") == [(None,), (3.5,)]


def test_progress_jobs_batch_equals_stream(spark, tmp_path, collect):
    lines = spark.createDataFrame([
        ("j", 1, "Running dataset stage"), ("j", 2, "Copied RGB.tif ok"), ("j", 3, "noise"), ("k", 1, "nothing"),
        ("s", 1, "Found 40 images"), ("s", 2, "Succesfully matched image 9 and 10"), ("t", 1, "Found 4 images"), ("t", 2, "Stitching batches"), ("u", 1, "Done")],
        "job string, n int, value string")
    lines.repartition(3).write.parquet(str(tmp_path / "in"))
    forms = {
        "log": lambda d: jobs.log_progress(d, ["job"], "n").select("job", "progress"),
        "stitch": lambda d: jobs.stitch_progress(d, ["job"], "n"),
        "done": lambda d: jobs.plots_done(d, ["job"])}
    for name, form in forms.items():
        source = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.start_snapshots(form(source), str(tmp_path / name), str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
        assert collect(read_snapshot(spark, str(tmp_path / name)), "job") == collect(form(lines), "job")
    assert dict(collect(forms["log"](lines))) == {"j": 81, "k": 0, "s": 0, "t": 0, "u": 0}
    assert dict(collect(forms["stitch"](lines))) == {"j": 0, "k": 0, "s": 22, "t": 94, "u": 100}
    assert jobs.plots_progress(forms["done"](lines)).first()["progress"] == 19


def test_upload_is_complete_with_all_parts(spark):
    parts = spark.createDataFrame([("a", 0, 2), ("a", 1, 2), ("a", 1, 2), ("b", 0, 2), ("b", 7, 2)], "file_identifier string, chunk_index int, total_chunks int")
    assert {r["file_identifier"]: r["complete"] for r in jobs.upload_status(parts).collect()} == {"a": True, "b": False}


def test_append_to_a_table_that_cannot_be_read_raises(spark, tmp_path):
    target = tmp_path / "t"
    target.mkdir()
    (target / "part-00000.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        append_new(str(target), spark.createDataFrame([(1, "a")], "k int, v string"), ["k"])
    assert [p.name for p in target.iterdir() if p.name.startswith("part")] == ["part-00000.parquet"]


def test_a_batch_reads_the_partitions_it_touches(spark, tmp_path):
    target = str(tmp_path / "t")
    day = lambda d, ids: spark.createDataFrame([(i, d, "x") for i in ids], "k int, day string, v string")
    for d in ("a", "b", None):
        append_new(target, day(d, range(4)), ["k", "day"], ["day"])
    append_new(target, day("b", range(2, 6)).unionByName(day(None, [3, 9])).unionByName(day("c", [1])), ["k", "day"], ["day"])
    got = spark.read.parquet(target).groupBy("day").count().collect()
    assert {r["day"]: r["count"] for r in got} == {"a": 4, "b": 6, None: 5, "c": 1}
    stored = stored_keys(target, day("b", [1]).unionByName(day(None, [1])), ["k", "day"], ["day"])
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((day" in plan and "ReadSchema: struct<k:int>" in plan
    assert {r["day"] for r in stored.collect()} == {"b", None}
    assert stored_keys(target, day("b", []), ["k", "day"], ["day"]).collect() == []


def test_folders_of_any_depth(spark):
    path = "/".join("abcdefghijkl") + "/x.jpg"
    rows = spark.createDataFrame([(path,)], "path string")
    assert R.tree(rows).count() == 12 and R.tree(rows, depth=9).count() == 9
