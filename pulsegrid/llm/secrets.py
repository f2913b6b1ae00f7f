"""Secret scans: plain patterns, and credentials whose parts are found together.

A key id, a random-looking string or a host is harmless alone. Inside one scope
(lines without a blank line between them) parts that complete each other are a
credential: intervals of parts are joined with the intervals of scopes, and a
weak part is reported only where its scope holds the parts it needs.

Everything is column expressions on the row; nothing is shuffled. A null text
is empty; repeated rows are scanned alike; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import let, whole_text

# The patterns of the contract, in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run is matched from its first fitting place to its end, so asking for the least length drops the same matches as filtering afterwards.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
LEAST_VALUE = 6

#: Weak parts: reported only with their complement.
IDENTIFIER = (
    r"""(?i)(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client_?id|key_?id|access_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}"""
)
MATERIAL = r"(?<![A-Za-z0-9+/])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = (
    r"""(?i)(?<![A-Za-z0-9])(?:(?:https?|ftps?|sftp|ssh|s3a?|gs|wss?|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb|amqps?)://[^\s"'<>]{4,}"""
    r"""|(?:host|endpoint|server|region)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{3,})"""
)
SCOPE_BREAK = r"\n[\x20\t\r]*\n\s*"

KINDS = ["assign", "access", "hex", "identifier", "material", "endpoint"]
BASE_KINDS = KINDS[:3]

_SPAN = "struct<start:int,kind:int,end:int>"


def found(text: Column, pattern: str, kind: int, value_group: bool = False) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end), in code points, end exclusive.

    The text between matches and the matches themselves alternate, so lengths added up give the places.
    """

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.length(piece["gap"])
        end = start + F.length(piece["match"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        good = F.length(piece["value"]) >= LEAST_VALUE if value_group else F.lit(True)
        return F.struct(
            end.alias("at"), F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), matches.alias("match"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if value_group else matches).alias("value"),
    )
    pieces = F.filter(pieces, lambda p: p["match"].isNotNull())  # the text after the last match has none
    none = F.array().cast(f"array<{_SPAN}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(pieces, start, step)["spans"]).otherwise(none)


def scope_starts(text: Column) -> Column:
    """Where each scope after the first begins."""
    breaks = found(text, SCOPE_BREAK, 0)
    return F.transform(breaks, lambda b: b["end"])


def linked(parts: Column, starts: Column) -> Column:
    """The parts to report: base spans, and weak parts whose scope holds what completes them."""

    def scope(part: Column) -> Column:
        return F.size(F.filter(starts, lambda s: s <= part["start"]))

    def scopes_of(placed: Column, *kinds: str) -> Column:
        wanted = [KINDS.index(k) for k in kinds]
        return F.array_distinct(F.transform(F.filter(placed, lambda p: p["part"]["kind"].isin(wanted)), lambda p: p["scope"]))

    def choose(placed: Column) -> Column:
        names = scopes_of(placed, "access", "identifier")
        keys = scopes_of(placed, "assign", "hex", "material")

        def reported(p: Column) -> Column:
            has_name, has_key = F.array_contains(names, p["scope"]), F.array_contains(keys, p["scope"])
            kind = p["part"]["kind"]
            return (
                (kind < len(BASE_KINDS))
                | ((kind == KINDS.index("identifier")) & has_key)
                | ((kind == KINDS.index("material")) & has_name)
                | ((kind == KINDS.index("endpoint")) & has_name & has_key)
            )

        return F.transform(F.filter(placed, reported), lambda p: p["part"])

    weak = F.exists(parts, lambda p: p["kind"] >= len(BASE_KINDS))
    placed = F.transform(parts, lambda p: F.struct(p.alias("part"), scope(p).alias("scope")))
    return F.when(weak, let(placed, choose)).otherwise(parts)


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def scan(documents: DataFrame) -> DataFrame:
    """Every row of ``documents`` with ``base_spans`` and ``spans``: sorted arrays of (start, kind, end).

    A pattern runs only where it can matter: after a cheap search for a character or word it needs, and, for weak
    parts, only where the row has the parts that could complete them.
    """
    text = whole_text()
    none = F.array().cast(f"array<{_SPAN}>")
    only = lambda needed, spans: F.when(needed, spans).otherwise(none)
    some = lambda *names: F.greatest(*[F.size(n) for n in names]) > 0
    sets = F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))
    rows = documents.withColumns({
        "_assign": only(sets, found(text, ASSIGN, 0, value_group=True)),
        "_access": only(F.contains(text, F.lit("AKIA")), found(text, ACCESS, 1)),
        "_hex": found(text, HEX, 2),
        "_identifier": only(sets, found(text, IDENTIFIER, 3)),
    })
    rows = rows.withColumn("_material", only(some("_access", "_identifier"), found(text, MATERIAL, 4)))
    named, keyed = some("_access", "_identifier"), some("_assign", "_hex", "_material")
    rows = rows.withColumn("_endpoint", only(named & keyed, found(text, ENDPOINT, 5)))
    weak = ["_identifier", "_material", "_endpoint"]
    rows = rows.withColumn("base_spans", F.sort_array(F.concat("_assign", "_access", "_hex")))
    rows = rows.withColumn("_parts", F.sort_array(F.concat("base_spans", *weak)))
    starts = F.when(some(*weak), scope_starts(text)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_starts", starts)
    rows = rows.withColumn("spans", linked(F.col("_parts"), F.col("_starts")))
    return rows.drop("_parts", "_starts", "_assign", "_access", "_hex", *weak)


def redact(scanned: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``text`` with every reported span replaced by ``mark``; overlapping spans are replaced together."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.coalesce(gap, F.lit(""))).alias("out"))

    def close(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))

    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, close)
    return scanned.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))


def report(documents: DataFrame) -> DataFrame:
    """The counts and digests of the contract, one row per document."""
    rows = scan(documents.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == BASE_KINDS.index(kind))).cast("long")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base_spans")).cast("long").alias("n_linked"),
    )
