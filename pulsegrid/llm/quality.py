"""Quality rules: fixed base rules, then outlier fences per language and source.

The measures of a document are whole numbers. Their distribution in each
(language, source) is kept as counts by bucket, a quantile sketch whose buckets
grow with the value (relative width 1/64): sketches merge by adding counts, in
any order, and always give the same quantiles. A document is kept if it passes
the base rules and no measure lies beyond the fence of its group: the upper
quartile plus ``fence`` times the distance between the quartiles. A group with
few documents is judged by the merged sketch of its language, a language with
few by that of all documents.

Only built-in functions are used. Null language and source are groups of their
own; a null text has no words and fails; rows are judged one by one, so repeated
rows get the same verdict; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.common import BLANKS, whole_text
from pulsegrid.session import durable

# The base rules of the contract.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"

#: Measures judged by fences, in thousandths.
MEASURES = ["symbol_share", "dup_line_share", "repeat_share", "word_length"]


@dataclass(frozen=True)
class Settings:
    """fence: distances between the quartiles that a measure may lie beyond the upper one. least_spread: by measure, that
    distance counts as this much at least (thousandths), so that groups of like documents are not cut. least_group:
    documents a group needs to be judged by itself."""

    fence: int = 6
    least_spread: tuple[int, ...] = (8, 80, 60, 250)
    least_group: int = 200


def bucket(value: Column) -> Column:
    """Lower edge of the value's bucket: exact below 128, then its seven leading binary digits."""
    low = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Add ``n_repeat_words`` from ``_words``: words in three-word windows found twice or more.

    Each window becomes one long, its hash with its place in the low bits. Sorted, equal windows are neighbours; where the
    hashes agree the words themselves are compared.
    """
    bits = F.length(F.bin(F.size("_words").cast("long")))
    rows = rows.withColumn("_bits", bits)
    rows = rows.withColumn("_keys", F.expr(
        "if(size(_words) < 3, array(), sort_array(transform(sequence(0, size(_words) - 3), i -> "
        "shiftleft(shiftright(xxhash64(_words[i], _words[i + 1], _words[i + 2]), _bits), _bits) + i)))"
    ))
    same = (
        "shiftright(x, _bits) = shiftright(get(_keys, {k}), _bits)"
        " and _words[place(x)] = _words[place(get(_keys, {k}))] and _words[place(x) + 1] = _words[place(get(_keys, {k})) + 1]"
        " and _words[place(x) + 2] = _words[place(get(_keys, {k})) + 2]"
    )
    either = " or ".join(f"coalesce({_places(same.format(k=k))}, false)" for k in ("i - 1", "i + 1"))
    rows = rows.withColumn("_at", F.expr(
        f"sort_array(transform(filter(_keys, (x, i) -> {either}), x -> x & (shiftleft(1L, _bits) - 1)))"
    ))
    covered = F.expr("aggregate(transform(_at, (p, i) -> least(3L, coalesce(get(_at, i + 1) - p, 3L))), 0L, (a, n) -> a + n)")
    return rows.withColumn("n_repeat_words", covered).drop("_bits", "_keys", "_at")


def _places(condition: str) -> str:
    """``place(key)`` stands for the low bits of a window's key, as an index into the words."""
    for key in ("x", "get(_keys, i - 1)", "get(_keys, i + 1)"):
        condition = condition.replace(f"place({key})", f"cast({key} & (shiftleft(1L, _bits) - 1) as int)")
    return condition


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts, ``base_failed`` and the measures of every document."""
    text = whole_text()
    rows = documents.select(
        "doc_id", "lang", "source",
        F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), BLANKS + "+", -1).alias("_split"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda line: F.regexp_like(line, F.lit("[^" + BLANKS[1:]))).alias("_lines"),
    )
    rows = rows.withColumn("_words", F.when(F.get("_split", F.lit(0)) == "", F.array().cast("array<string>")).otherwise(F.col("_split")))
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    rows = _with_repeats(rows).drop("_split", "_words", "_lines")
    share = lambda part, whole: F.call_function("div", F.col(part) * 1000, F.greatest(F.col(whole), F.lit(1).cast("long")))
    rows = rows.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words"),
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT),
    })
    return rows.drop("n_lines")


def sketches(rows: DataFrame) -> DataFrame:
    """Documents by (lang, source, measure, bucket) among those that pass the base rules."""
    long = rows.filter(~F.col("base_failed")).select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])).alias("m"),
    ).select("lang", "source", "m.*")
    return long.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def fences(counts: DataFrame, keys: list[str], settings: Settings) -> DataFrame:
    """One row per group of ``keys``: its documents and the fence of each measure, from merged sketches."""
    merged = counts.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    placed = merged.select(
        *keys, "measure", "bucket", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("total"),
    )
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bucket")))
    quartiles = placed.groupBy(*keys, "measure").agg(quartile(1).alias("low"), quartile(3).alias("high"), F.first("total").alias("total"))
    least = F.element_at(F.create_map(*[F.lit(x) for pair in zip(MEASURES, settings.least_spread) for x in pair]), F.col("measure"))
    fence = F.col("high") + settings.fence * F.greatest(F.col("high") - F.col("low"), least)
    return quartiles.groupBy(*keys).agg(
        F.max("total").alias("docs"), *[F.max(F.when(F.col("measure") == m, fence)).alias(f"{m}_fence") for m in MEASURES],
    )


def judged(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``measured`` rows, stored, joined with the fences of their group; adds ``level`` of the fence used and ``kept``."""
    counts = durable(sketches(rows), "quality-sketch")
    out = rows
    for level, keys in (("source", ["lang", "source"]), ("lang", ["lang"])):
        found = fences(counts, keys, settings).filter(F.col("docs") >= settings.least_group)
        found = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*[f"{m}_fence" for m in MEASURES]).alias(f"_by_{level}"))
        match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        out = out.join(found, match, "left").drop(*[f"_{k}" for k in keys])
    overall = fences(counts, [], settings).select(F.struct(*[f"{m}_fence" for m in MEASURES]).alias("_by_all"))
    out = out.join(F.broadcast(overall), how="left")  # one row
    used = F.coalesce("_by_source", "_by_lang", "_by_all")
    level = F.when(F.col("_by_source").isNotNull(), "source").when(F.col("_by_lang").isNotNull(), "lang").otherwise("all")
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.coalesce(F.col(m) <= used[f"{m}_fence"], F.lit(True))
    return out.withColumns({"level": level, "kept": ~F.col("base_failed") & inside}).drop("_by_source", "_by_lang", "_by_all")


def report(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The contract's row per document, with the measures and the level of the fences used."""
    rows = durable(measured(documents), "quality-measures")
    return judged(rows, settings).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES, "level",
    )
