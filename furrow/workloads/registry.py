"""Catalogue and runs: orders as files of dated datasets, users as training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import registry as R
from furrow.workloads import Workload
from furrow.workloads.tables import table

work = Workload()

CATALOG_SQL = """
catalog AS (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Processed' ELSE 'Raw' END AS zone,
         CASE WHEN o_orderstatus = 'P' THEN 'y' ELSE '' END || year(o_orderdate) AS year, o_orderpriority AS experiment,
         o_orderstatus AS location, 'p' || o_custkey % 7 AS population, strftime(o_orderdate, '%Y-%m-%d') AS date,
         'drone' AS platform, 'RGB' AS sensor, 'Stitch_v' || o_custkey % 12 AS folder, o_orderkey || '.png' AS name
  FROM orders
), listed AS (SELECT *, concat_ws('/', zone, year, experiment, location, name) AS path FROM catalog)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("timestamp"))
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    rows = o.select(
        F.when(F.col("o_orderkey") % 3 == 0, "Processed").otherwise("Raw").alias("zone"),
        F.concat(F.when(F.col("o_orderstatus") == "P", "y").otherwise(""), text(F.year("d"))).alias("year"),
        F.col("o_orderpriority").alias("experiment"), F.col("o_orderstatus").alias("location"),
        F.concat(F.lit("p"), text(F.col("o_custkey") % 7)).alias("population"),
        F.date_format("d", "yyyy-MM-dd").alias("date"), F.lit("drone").alias("platform"), F.lit("RGB").alias("sensor"),
        F.concat(F.lit("Stitch_v"), text(F.col("o_custkey") % 12)).alias("folder"),
        F.concat(text("o_orderkey"), F.lit(".png")).alias("name"))
    return rows.withColumn("path", F.concat_ws("/", "zone", "year", "experiment", "location", "name"))


@work.query("catalog_years", f"WITH {CATALOG_SQL} SELECT DISTINCT year FROM catalog WHERE zone = 'Raw' AND regexp_matches(year, '^\\d+$')")
def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.facet(catalog(spark, sf_dir), "year")


@work.query("catalog_dates", f"""
WITH {CATALOG_SQL} SELECT DISTINCT date FROM catalog WHERE experiment = '2-HIGH' AND location = 'O' AND population = 'p3'
""")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.facet(catalog(spark, sf_dir), "date", experiment="2-HIGH", location="O", population="p3")


@work.query("catalog_children", f"""
WITH {CATALOG_SQL} SELECT DISTINCT location AS name, true AS is_directory FROM listed WHERE path LIKE 'Raw/1997/2-HIGH/%'
""")
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.children(catalog(spark, sf_dir), "Raw/1997/2-HIGH")


@work.query("catalog_tree", f"""
WITH {CATALOG_SQL}
SELECT array_to_string(parts[1:d], '/') AS folder, array_to_string(parts[1:d - 1], '/') AS parent, CAST(d AS INTEGER) AS depth, count(*) AS files
FROM (SELECT string_split(path, '/') AS parts FROM listed), range(1, 5) r(d) GROUP BY ALL
""")
def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tree(catalog(spark, sf_dir))


@work.query("catalog_key_renamed", f"""
WITH {CATALOG_SQL}
SELECT CASE WHEN location = 'F' AND experiment = '5-LOW' THEN 'Davis' ELSE location END AS location, count(*) AS files FROM catalog GROUP BY 1
""")
def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.rename_key(catalog(spark, sf_dir), "location", "F", "Davis", experiment="5-LOW")
    return out.groupBy("location").agg(F.count("*").alias("files"))


@work.query("catalog_key_deleted", f"""
WITH {CATALOG_SQL} SELECT experiment, count(*) AS files FROM catalog WHERE NOT (location = 'F' AND population = 'p1') GROUP BY 1
""")
def deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.delete_key(catalog(spark, sf_dir), location="F", population="p1")
    return out.groupBy("experiment").agg(F.count("*").alias("files"))


@work.query("images_set_removed", f"""
WITH {CATALOG_SQL}
SELECT CASE WHEN name IN (SELECT l_orderkey || '.png' FROM lineitem WHERE l_returnflag = 'R') THEN 'Removed' ELSE 'Images' END AS status, count(*) AS files
FROM catalog GROUP BY 1
""")
def set_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit(".png")).alias("name"))
    out = R.set_removed(catalog(spark, sf_dir).withColumn("status", F.lit("Images")), names, True)
    return out.groupBy("status").agg(F.count("*").alias("files"))


@work.query("output_versions", f"""
WITH {CATALOG_SQL} SELECT DISTINCT experiment, folder, CAST(replace(folder, 'Stitch_v', '') AS INTEGER) AS version FROM catalog
""")
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.versions(catalog(spark, sf_dir), "Stitch", ["experiment"])


@work.query("next_output_version", f"""
WITH {CATALOG_SQL} SELECT date, CAST(max(CAST(replace(folder, 'Stitch_v', '') AS INTEGER)) + 1 AS INTEGER) AS next_version FROM catalog GROUP BY 1
""")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.next_version(catalog(spark, sf_dir), "Stitch", ["date"])


@work.query("trait_sources", f"""
WITH {CATALOG_SQL}
SELECT date, CASE WHEN population = 'p1' THEN 'aerial' ELSE 'inference' END AS version_type,
       CASE WHEN population = 'p1' THEN 'main' ELSE folder END AS version FROM catalog WHERE population IN ('p1', 'p2')
""")
def trait_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    aerial = F.col("population") == "p1"
    head = F.concat("date", F.lit("-drone-RGB"))
    c = catalog(spark, sf_dir).withColumn("name", F.when(aerial, F.concat(head, F.lit("-Traits-WGS84.geojson"))).when(
        F.col("population") == "p2", F.concat(head, F.lit("-"), "folder", F.lit("-Traits-WGS84.geojson"))).otherwise(F.col("name")))
    return R.trait_sources(c.withColumn("folder", F.when(~aerial, F.col("folder")))).select("date", "version_type", "version")


@work.query("annotation_classes", "SELECT DISTINCT CAST(p_size AS VARCHAR) AS class FROM part")
def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.label_classes(table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("class")))


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    metrics = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("epoch"), (F.col("value") / 500).alias(R.METRIC))
    return metrics.select("run_id").distinct().withColumn("seen", F.col("run_id")), metrics


@work.query("last_epoch_metrics", """
SELECT user_id AS run_id, max(event_id) AS epoch, round(arg_max(value, event_id) / 500, 2) AS map FROM events GROUP BY 1
""")
def last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_metrics(runs(spark, sf_dir)[1])


@work.query("best_run", """
WITH l AS (SELECT user_id, round(arg_max(value, event_id) / 500, 2) AS map FROM events GROUP BY 1)
SELECT arg_min(user_id, (-map, user_id)) AS run_id FROM l
""")
def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_run(*runs(spark, sf_dir), "seen")


@work.query("run_details", """
WITH l AS (SELECT user_id, round(arg_max(value, event_id) / 500, 2) AS map FROM events GROUP BY 1),
s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey AS run_id, 'x' || c_custkey AS id, '2024-01-01, ' || c_mktsegment AS dates, 'rover' AS platform, 'RGB' AS sensor,
       c_nationkey AS epochs, map, coalesce(n, 0) AS stand_count
FROM customer LEFT JOIN l ON user_id = c_custkey LEFT JOIN s ON o_custkey = c_custkey
""")
def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    listed = c.select(
        F.col("c_custkey").alias("run_id"), F.array(F.lit("2024-01-01"), "c_mktsegment").alias("dates"),
        F.concat(F.lit("Training/rover/RGB Plant Detection/Plant-x"), F.col("c_custkey").cast("string")).alias("path"))
    args = c.select(F.col("c_custkey").alias("run_id"), F.col("c_nationkey").alias("epochs"), F.lit(8).alias("batch"), F.lit(640).alias("imgsz"))
    stands = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"))
    return R.run_details(listed, args, runs(spark, sf_dir)[1], stands).select(
        "run_id", "id", "dates", "platform", "sensor", "epochs", "map", "stand_count")


@work.query("run_files", """
SELECT CASE p_partkey % 3 WHEN 0 THEN 'plant_model' WHEN 1 THEN 'locate' ELSE 'trait_model' END AS kind, 'b' || p_partkey AS id FROM part
""")
def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 3
    path = F.when(kind == 0, F.concat(F.lit("T/RGB Plant Detection/Plant-b"), k, F.lit("/weights/last.pt"))).when(
        kind == 1, F.concat(F.lit("P/Locate-b"), k, F.lit("/locate.csv"))).otherwise(
        F.concat(F.lit("T/RGB Pod/Pod-b"), k, F.lit("/weights/best.pt")))
    return R.check_runs(table(spark, sf_dir, "part").select(path.alias("path"))).select("kind", "id")


@work.query("run_registry_upsert", """
SELECT c_custkey AS trait, CASE WHEN user_id IS NULL THEN c_name ELSE 'new' END AS model FROM customer LEFT JOIN (SELECT DISTINCT user_id FROM events) ON user_id = c_custkey
""")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("trait"), F.col("c_name").alias("model"))
    new = table(spark, sf_dir, "events").select(F.col("user_id").alias("trait"), F.lit("new").alias("model")).distinct()
    return R.upsert_run(old, new)
