"""Sources, sinks, set operations on files."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import contract
from pulsegrid.functions import cleaning
from pulsegrid.operators import regions
from pulsegrid.plans.checks import fixed, pct, with_clean, with_residents
from pulsegrid.plans.population_queries import suppressed_sql
from pulsegrid.plans.registry import query
from pulsegrid.session import shared_path
from pulsegrid.sources import files
from pulsegrid.sources.tables import residents

C = F.col
RESIDENT_COLUMNS = [field.name for field in contract.RESIDENT_SCHEMA.fields]
RESIDENT_SQL = with_residents(f"SELECT {', '.join(RESIDENT_COLUMNS)} FROM residents")


@query("s01_csv_scan", RESIDENT_SQL)
def csv_scan(spark, sf_dir):
    path = shared_path(spark, "csv")
    files.write_csv(residents(spark, sf_dir).select(*RESIDENT_COLUMNS), path)
    return files.read_csv(spark, path, contract.RESIDENT_SCHEMA)


@query("s01_reordered_headers", RESIDENT_SQL)
def reordered_headers(spark, sf_dir):
    """Files with their columns in another order, and with one more column, read as one table."""
    source, path = residents(spark, sf_dir).select(*RESIDENT_COLUMNS), shared_path(spark, "csv")
    young, old = C("age") < 50, C("age") >= 50
    files.write_csv(source.filter(young), f"{path}/a")
    files.write_csv(source.filter(old).select(*reversed(RESIDENT_COLUMNS), F.lit("x").alias("remark")), f"{path}/b")
    return files.read_csv(spark, [f"{path}/a", f"{path}/b"], contract.RESIDENT_SCHEMA)


@query("s02_csv_scan_encoding", with_residents(
    "SELECT resident_id, district || 'é' AS district, age, bmi FROM residents"))
def csv_scan_encoding(spark, sf_dir):
    """Semicolon CSV in a single-byte character set."""
    path = shared_path(spark, "csv-latin")
    source = residents(spark, sf_dir).select(
        "resident_id", F.concat("district", F.lit("é")).alias("district"), "age", "bmi")
    files.write_csv(source, path, separator=";", encoding="ISO-8859-1")
    return files.read_csv(spark, path, source.schema, separator=";", encoding="ISO-8859-1")


_LAYER_SQL = """
SELECT resident_id, region, district, age, round(bmi, 2) AS bmi, cholesterol, label_heart, label_stroke,
  1.0::DOUBLE AS sample_weight FROM clean"""


@query("s04_feature_layer", with_clean(_LAYER_SQL))
def feature_layer(spark, sf_dir):
    path = shared_path(spark, "features")
    files.write_layer(cleaning.feature_layer(cleaning.clean(residents(spark, sf_dir))), path)
    return files.read_layer(spark, path).select(
        "resident_id", "region", "district", "age", "bmi", "cholesterol", "label_heart", "label_stroke",
        "sample_weight")


@query("s05_partitioned_overwrite", with_clean("""
SELECT region, count(*) AS residents, CAST(sum(label_heart) AS BIGINT) AS heart FROM clean GROUP BY region"""))
def partitioned_overwrite(spark, sf_dir):
    """Write twice over the same path; the second write replaces the first."""
    path = shared_path(spark, "by-region")
    cleaned = cleaning.clean(residents(spark, sf_dir))
    files.write_layer(cleaned, path, ["region"])
    files.write_layer(cleaned, path, ["region"])
    return files.read_layer(spark, path).groupBy("region").agg(
        F.count(F.lit(1)).alias("residents"), F.sum("label_heart").alias("heart"))


@query("s06_external_tables", with_clean("""
SELECT o.district, count(*) AS residents, round(max(d.bmi), 2) AS highest_bmi
FROM residents o JOIN clean d ON o.resident_id = d.resident_id
GROUP BY o.district"""))
def external_tables(spark, sf_dir):
    root = shared_path(spark, "layers")
    source = residents(spark, sf_dir)

    def as_text(df):
        return df.withColumns({name: C(name).cast("string") for name in ("resident_id", "community_id")})

    ods = as_text(source).select(*[field.name for field in contract.ODS_SCHEMA.fields])
    dws = as_text(cleaning.clean(source)).select(*[field.name for field in contract.DWS_SCHEMA.fields])
    ads = regions.region_report(source, ["region"]).select(*[field.name for field in contract.ADS_SCHEMA.fields])
    files.write_csv(ods, f"{root}/ods")
    files.write_layer(dws, f"{root}/dws")
    files.write_csv(ads, f"{root}/ads")
    database = "layers_" + root.rsplit("-", 1)[-1]
    files.register_layers(spark, database, f"{root}/db", f"{root}/ods", f"{root}/dws", f"{root}/ads")
    return spark.sql(f"""
        SELECT o.district, count(*) AS residents, round(max(d.bmi), 2) AS highest_bmi
        FROM {database}.ods_resident_health o
        JOIN {database}.dws_cardio_features d ON o.resident_id = d.resident_id
        GROUP BY o.district""")


@query("s06_report_table", with_residents(suppressed_sql("residents", "region")))
def report_table(spark, sf_dir):
    """Report layer written as header CSV and read back through its schema."""
    path = shared_path(spark, "ads")
    report = regions.region_report(residents(spark, sf_dir), ["region"])
    files.write_csv(report.select(*[field.name for field in contract.ADS_SCHEMA.fields]), path)
    return files.read_csv(spark, path, contract.ADS_SCHEMA)


_BOTH = "sum(CASE WHEN label_heart = 1 AND label_stroke = 1 THEN 1 ELSE 0 END)"


@query("s07_population_summary", with_residents(f"""
SELECT t.*, r.region, r.residents, r.heart_rate, r.stroke_rate, r.comorbidity_rate AS region_comorbidity_rate,
  r.suppressed, 'labels' AS region_metric_source, FALSE AS totals_suppressed
FROM (SELECT 'ds-all' AS dataset_id, 'district' AS coverage_level, 'multiple' AS coverage_name,
    count(*) AS total_residents, {pct('sum(label_heart)', 'count(*)')} AS heart_risk_rate,
    {pct('sum(label_stroke)', 'count(*)')} AS stroke_risk_rate, {pct(_BOTH, 'count(*)')} AS comorbidity_rate,
    'labels' AS risk_metric_source FROM residents) t
CROSS JOIN ({suppressed_sql('(SELECT district AS region, label_heart, label_stroke FROM residents) z', 'region')}) r"""))
def population_summary(spark, sf_dir):
    """Summary written as JSON, read back and unfolded to one row per region."""
    path = shared_path(spark, "summary")
    summary = regions.population_summary(residents(spark, sf_dir), {"dataset_id": "ds-all"})
    files.write_summary(summary, path)
    back = spark.read.schema(summary.schema).json(path)
    return back.select(
        "dataset_id", "coverage_level", "coverage_name", "total_residents", "heart_risk_rate", "stroke_risk_rate",
        "comorbidity_rate", "risk_metric_source", "totals_suppressed", F.explode("region_analysis").alias("item"),
    ).select(
        "*", "item.region", "item.residents", "item.heart_rate", "item.stroke_rate",
        C("item.comorbidity_rate").alias("region_comorbidity_rate"), "item.suppressed",
        C("item.risk_metric_source").alias("region_metric_source"),
    ).drop("item")


def _share(test: str) -> str:
    return fixed(f"CAST(count(*) FILTER (WHERE {test}) AS DOUBLE) / count(*)", 6)


_TARGET = "CASE WHEN label_stroke = 1 THEN 2 WHEN label_heart = 1 THEN 1 ELSE 0 END"


_PROFILE = {
    "hypertension": "hypertension = 1", "diabetes": "diabetes = 1", "cholesterol_abnormal": "cholesterol >= 2",
    "current_smoker": "smoker = 2", "overweight": "bmi >= 25", "obesity": "bmi >= 30", "exercise": "exercise = 1",
    "alcohol": "alcohol = 1", "target_disease_0": f"{_TARGET} = 0", "target_disease_1": f"{_TARGET} = 1",
    "target_disease_2": f"{_TARGET} = 2",
}


@query("s08_profile", with_clean(" UNION ALL ".join(
    f"SELECT count(*) AS rows, 17 AS columns, '{name}' AS metric, {_share(test)} AS rate FROM clean"
    for name, test in _PROFILE.items())))
def profile(spark, sf_dir):
    cleaned = cleaning.clean(residents(spark, sf_dir))
    return files.profile(cleaned.withColumn(
        "target_disease", cleaning.legacy_target(C("label_heart"), C("label_stroke"))))


@query("s09_file_hashes")
def file_hashes(spark, sf_dir):
    return files.file_hashes(spark, f"{sf_dir}/*.parquet").drop("path")


@query("s09_written_file_hashes", """
SELECT CAST(sum(length(c_name) + 1) AS BIGINT) AS length, sha256(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS sha256
FROM customer GROUP BY c_nationkey""")
def written_file_hashes(spark, sf_dir):
    """Hashes of files as they were written: the customers of each nation, a name a line."""
    folder = shared_path(spark, "names")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey", "c_custkey", "c_name")
    ordered = customers.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    ordered.select("c_nationkey", "c_name").write.partitionBy("c_nationkey").text(folder)
    return files.file_hashes(spark, f"{folder}/*/*.txt").select("length", "sha256")


@query("s10_preview", with_residents(f"""
SELECT {', '.join(RESIDENT_COLUMNS)}, (SELECT count(*) FROM residents) AS table_rows, 16 AS table_columns
FROM residents ORDER BY resident_id LIMIT 5"""))
def preview(spark, sf_dir):
    return files.preview(residents(spark, sf_dir).select(*RESIDENT_COLUMNS), "resident_id", 5)


@query("u01_concatenated_chunks", RESIDENT_SQL)
def concatenated_chunks(spark, sf_dir):
    """Chunks written apart, one with its columns in another order, and read as one table."""
    source = residents(spark, sf_dir).select(*RESIDENT_COLUMNS)
    older, newer = shared_path(spark, "chunk"), shared_path(spark, "chunk")
    files.write_layer(source.filter(C("age") >= 60), older)
    files.write_layer(source.filter(C("age") < 60).select(*reversed(RESIDENT_COLUMNS)), newer)
    return files.merge_files(spark, [files.read_layer(spark, older), files.read_layer(spark, newer)])


