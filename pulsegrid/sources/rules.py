"""Advice rules: the document reader and a small demonstration set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

C = F.col

RULE_TYPE = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("factor", T.StringType()),
    T.StructField("auto_factors", T.ArrayType(T.StringType())),
    T.StructField("risk_levels", T.ArrayType(T.IntegerType())),
    T.StructField("advice", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("automation_safe", T.BooleanType()),
    T.StructField("rule_class", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("domain", T.StringType()),
    T.StructField("review_mode", T.StringType()),
    T.StructField("target_population", T.StringType()),
    T.StructField("boundary_notes", T.StringType()),
    T.StructField("contraindication", T.StringType()),
    T.StructField("source_doc", T.StringType()),
    T.StructField("source_section", T.StringType()),
    T.StructField("evidence_level", T.StringType()),
])
DOCUMENT_TYPE = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("rules", T.ArrayType(RULE_TYPE)),
])


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON document with their position in the file."""
    document = spark.read.schema(DOCUMENT_TYPE).option("multiLine", True).json(path)
    return document.select(
        C("version").alias("document_version"), F.posexplode("rules").alias("pos", "rule")
    ).select("pos", "document_version", "rule.*")


def rules_frame(spark: SparkSession, rules: list[dict], version: str) -> DataFrame:
    """The same table from rules given in memory."""
    names = [field.name for field in RULE_TYPE.fields]
    rows = [(pos, version, *[rule.get(name) for name in names]) for pos, rule in enumerate(rules)]
    schema = T.StructType([
        T.StructField("pos", T.IntegerType()), T.StructField("document_version", T.StringType()), *RULE_TYPE.fields])
    return spark.createDataFrame(rows, schema)


DEMO_VERSION = "demo-rules-1"
ALL_LEVELS = [1, 2, 3, 4, 5]

# Our own demonstration rules; texts are written for this repository.
DEMO_RULES = [
    {"rule_id": "pressure-home-log", "factor": "hypertension", "risk_levels": ALL_LEVELS, "priority": 5,
     "advice": "Keep a home blood-pressure log.", "source": "demo"},
    {"rule_id": "pressure-low-salt", "factor": "hypertension", "risk_levels": [2, 3, 4, 5], "priority": 8,
     "advice": "Cut salt step by step.", "source": "demo", "contraindication": "Not with kidney failure.",
     "source_doc": "demo-guide", "source_section": "2.1", "evidence_level": "B"},
    {"rule_id": "pressure-review", "factor": "hypertension", "risk_levels": [4, 5], "priority": 8,
     "advice": "Have the treatment reviewed.", "source": "demo"},
    {"rule_id": "smoke-quit-date", "factor": "smoker", "risk_levels": ALL_LEVELS, "priority": 6,
     "advice": "Set a date to quit.", "source": "demo", "version": "demo-2"},
    {"rule_id": "smoke-medicine", "factor": "smoker", "risk_levels": ALL_LEVELS, "priority": 9,
     "automation_safe": False, "advice": "Discuss medicines to quit.", "source": "demo"},
    {"rule_id": "sugar-log", "factor": "diabetes", "risk_levels": [1, 2, 3], "priority": 3,
     "advice": "Keep a glucose log.", "source": "demo"},
    {"rule_id": "sugar-clinic", "factor": "diabetes", "risk_levels": [3, 4, 5], "priority": 7,
     "advice": "Visit the diabetes clinic.", "source": "demo"},
    {"rule_id": "sugar-clinic", "factor": "diabetes", "risk_levels": [1, 2, 3, 4, 5], "priority": 10,
     "advice": "A second text under a used id.", "source": "demo"},
    {"rule_id": "lipid-diet", "factor": "cholesterol", "auto_factors": ["cholesterol", "bmi"],
     "risk_levels": ALL_LEVELS, "priority": 4, "advice": "Choose lean food.", "source": "demo"},
    {"rule_id": "lipid-test", "factor": "cholesterol", "risk_levels": [3, 4, 5], "priority": 2,
     "advice": "Repeat the lipid test."},
    {"rule_id": "weight-plan", "factor": "bmi", "risk_levels": [2, 3, 4], "priority": 4,
     "advice": "Agree on a weight plan.", "source": "demo"},
    {"rule_id": "walk-daily", "factor": "exercise", "risk_levels": [1, 2, 3], "priority": 1,
     "advice": "Walk every day.", "source": "demo"},
    {"rule_id": "walk-supervised", "factor": "exercise", "risk_levels": [4, 5], "priority": 1,
     "advice": "Exercise under supervision.", "source": "demo"},
    {"rule_id": "drink-less", "factor": "alcohol", "risk_levels": [1, 2, 4, 5],
     "advice": "Plan days without alcohol.", "source": "demo"},
    {"rule_id": "drink-old", "factor": "alcohol", "risk_levels": ALL_LEVELS, "enabled": False, "priority": 20,
     "advice": "A retired rule.", "source": "demo"},
    {"rule_id": "metabolic-bundle", "auto_factors": ["diabetes", "cholesterol", "hypertension"],
     "risk_levels": [5], "priority": 12, "advice": "See one clinic for all three.", "source": "demo"},
    {"rule_id": "habit-bundle", "auto_factors": ["smoker", "alcohol"], "risk_levels": [3], "priority": 6,
     "advice": "Change both habits together.", "source": "demo"},
    {"rule_id": "high-risk-visit", "factor": "risk_level", "risk_levels": [4, 5], "priority": 50,
     "rule_class": "follow_up", "advice": "Book a visit soon.", "source": "demo", "domain": "visit",
     "boundary_notes": "Emergencies go to the ward.", "contraindication": "none", "source_doc": "demo-guide"},
    {"rule_id": "pressure-visit", "factor": "hypertension", "risk_levels": [3, 4, 5], "priority": 40,
     "rule_class": "follow_up", "advice": "Book a pressure check.", "source": "demo"},
    {"rule_id": "yearly-visit", "factor": "bmi", "risk_levels": [1, 2], "priority": 1,
     "rule_class": "follow_up", "advice": "Come once a year.", "source": "demo"},
]
