"""SQL building blocks of the checks: the derived tables, written independently of Spark."""

RESIDENTS = """
place AS (
  SELECT o.o_orderkey AS k, o.o_orderdate AS d, c.c_nationkey AS nk, c.c_custkey AS ck, c.c_name AS name,
         n.n_name AS district, r.r_name AS region,
         (o.o_orderkey * 7919 + 13) % 10007 AS h1, (o.o_orderkey * 104729 + 31) % 10009 AS h2,
         (o.o_orderkey * 1299709 + 97) % 10037 AS h3, (o.o_orderkey * 15485863 + 7) % 10039 AS h4
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
), body AS (
  SELECT *,
    CAST(CASE WHEN h2 % 97 = 0 THEN -1 ELSE 18 + h1 % 78 END AS INTEGER) AS age,
    CAST(h2 % 2 AS INTEGER) AS gender,
    CASE WHEN h4 % 53 = 0 THEN NULL ELSE CAST(1600 + h3 % 2900 AS DOUBLE) / 100 END AS bmi,
    CAST(CASE WHEN h1 % 101 = 0 THEN 9 ELSE 1 + h4 % 3 END AS INTEGER) AS cholesterol,
    CASE WHEN h1 % 100 < 16 THEN 1 ELSE 0 END AS diabetes,
    CASE WHEN h2 % 100 < 34 THEN 1 ELSE 0 END AS hypertension,
    CAST(CASE WHEN h4 % 211 = 0 THEN 5 ELSE h3 % 3 END AS INTEGER) AS smoker,
    CASE WHEN h4 % 100 < 43 THEN 1 ELSE 0 END AS alcohol,
    CASE WHEN (h1 + h2) % 100 < 25 THEN 1 ELSE 0 END AS exercise
  FROM place
), residents AS (
  SELECT k + 510100000001 AS resident_id, region, district,
    CAST(nk * 1000 + ck % 100 AS BIGINT) AS community_id, d AS snapshot_date, name,
    '138' || lpad(CAST((h1 * 9973 + h2) % 100000000 AS VARCHAR), 8, '0') AS phone,
    age, gender, bmi, cholesterol, diabetes, hypertension, smoker, alcohol, exercise,
    CASE WHEN age BETWEEN 18 AND 39 THEN '18-39' WHEN age BETWEEN 40 AND 59 THEN '40-59'
         WHEN age BETWEEN 60 AND 74 THEN '60-74' WHEN age BETWEEN 75 AND 90 THEN '75-90' END AS age_group,
    CASE WHEN age + 20 * hypertension + 12 * diabetes + h3 % 40 >= 95 THEN 1 ELSE 0 END AS label_heart,
    CASE WHEN age + 25 * hypertension + h4 % 50 >= 110 THEN 1 ELSE 0 END AS label_stroke,
    CAST(90 + h3 % 100 AS DOUBLE) AS systolic_bp, CAST(50 + h2 % 70 AS DOUBLE) AS diastolic_bp,
    CAST(350 + h4 % 600 AS DOUBLE) / 100 AS fasting_glucose,
    CASE WHEN (h1 + h3) % 7 = 0 THEN 1 ELSE 0 END AS family_history,
    CAST(1450 + h2 % 500 AS DOUBLE) / 10 AS height_cm,
    strftime(d, '%Y-%m') AS data_period
  FROM body
)"""

CLEAN = """
clean AS (
  SELECT CASE WHEN age > 0 THEN age END AS age, CASE WHEN gender IN (0, 1) THEN gender END AS gender,
    CASE WHEN bmi > 0 THEN bmi END AS bmi,
    CASE WHEN cholesterol IN (1, 2, 3) THEN cholesterol END AS cholesterol,
    CASE WHEN diabetes IN (0, 1) THEN diabetes END AS diabetes,
    CASE WHEN hypertension IN (0, 1) THEN hypertension END AS hypertension,
    CASE WHEN smoker IN (0, 1, 2) THEN smoker END AS smoker,
    CASE WHEN alcohol IN (0, 1) THEN alcohol END AS alcohol,
    CASE WHEN exercise IN (0, 1) THEN exercise END AS exercise,
    label_heart, label_stroke, resident_id, region, district, community_id, age_group
  FROM residents
)"""

# Complete records: unknown values take fixed stand-ins before the fixed score is applied.
COMPLETE = """
complete AS (
  SELECT resident_id, region, district, community_id, age_group, data_period, snapshot_date,
    CASE WHEN age > 0 THEN age ELSE 57 END AS age, gender, coalesce(bmi, 25.0) AS bmi,
    CASE WHEN cholesterol IN (1, 2, 3) THEN cholesterol ELSE 1 END AS cholesterol,
    diabetes, hypertension, CASE WHEN smoker IN (0, 1, 2) THEN smoker ELSE 0 END AS smoker,
    alcohol, exercise, label_heart, label_stroke, systolic_bp, diastolic_bp, fasting_glucose, family_history
  FROM residents
)"""


def _margin(weights: dict[str, float], names: list[str]) -> str:
    terms = [repr(weights["intercept"]) + "::DOUBLE"]
    terms += [f"({weights[name]!r}::DOUBLE) * CAST({name} AS DOUBLE)" for name in names]
    return " + ".join(terms)


def scored_sql(weights: dict[str, dict[str, float]], names: list[str]) -> str:
    def probability(target: str) -> str:
        return f"floor(10000.0::DOUBLE / (1.0::DOUBLE + exp(-({_margin(weights[target], names)})))) / 10000.0::DOUBLE"

    return f"""
scored AS (
  SELECT *, {probability('heart')} AS heart_probability, {probability('stroke')} AS stroke_probability
  FROM complete
)"""


def with_residents(body: str) -> str:
    return f"WITH {RESIDENTS}\n{body}"


def with_clean(body: str) -> str:
    return f"WITH {RESIDENTS}, {CLEAN}\n{body}"


def with_parts(parts: list[str], body: str) -> str:
    return f"WITH {', '.join([RESIDENTS, *parts])}\n{body}"


def pct(part: str, whole: str) -> str:
    """Percentage with two decimals, rounded from the stored binary value."""
    return f"CAST(printf('%.2f', CAST({part} AS DOUBLE) / nullif({whole}, 0) * 100.0::DOUBLE) AS DOUBLE)"


def fixed(expression: str, digits: int) -> str:
    return f"CAST(printf('%.{digits}f', {expression}) AS DOUBLE)"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
