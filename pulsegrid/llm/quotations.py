"""Chat formatting: quoted passages linked to what they quote, conversations in reply order without quotes.

A line's quote level is the number of ``>`` it begins with; a passage is a run of lines of one level. Its words,
lower-cased, are hashed in windows of ``WINDOW`` words, so that a quotation that was wrapped anew or takes only a part
still has windows in common with the original; a passage of fewer words is one window, and so is every line of fewer.

Windows of quoted passages are joined to the author's own windows of earlier messages in the conversation: for each
window its latest holder before the quoting message and its first one are candidates. A candidate's own words are then
compared with the passage: the best one holds the whole passage, then has most of its windows, then is the latest. Where
another message could be better, all holders of the passage's rarest windows are compared too, so none is missed. A message replies to what its passage of the lowest quote level quotes (of
several the longest, then the first one). Threads follow from the replies by pointer jumping.

Ordered by conversation, thread and place, every reply stands after what it replies to. Messages without conversation
or turn are kept, link to nothing and have null threads; a null text is empty; rows repeating a message are one in the
links and all kept; passages without letters or digits link nothing. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.common import let, whole_text
from pulsegrid.session import durable

#: One character class and no group, so that a run of any length is matched without recursion.
QUOTE = r"^[\x20\t>]*>[\x20\t]?"
WINDOW = 4
BLANK = " \t\n\x0b\x0c\r"
#: Turns of a thread that are numbered together.
NUMBERED = 4_096


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), "[^>]", ""))


def line_words(line: Column) -> Column:
    """Lower-case words of a line without its quote marks; none for a line without letters or digits."""
    plain = F.regexp_replace(line, QUOTE, "")
    found = F.filter(F.split(F.lower(plain), r"[\s]+", -1), lambda w: w != "")
    return F.when(F.regexp_like(plain, F.lit(r"[\p{L}\p{N}]")), found).otherwise(F.array().cast("array<string>"))


def windows(words: Column) -> Column:
    """Hashes of the word windows; fewer words are one window."""
    last = F.greatest(F.size(words) - WINDOW, F.lit(0))
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), last), lambda at: F.xxhash64(F.slice(words, at + 1, WINDOW)))).otherwise(
        F.array().cast("array<bigint>")
    )


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, passage, level, words, short) of every passage; short: the words of its lines below a window, as arrays."""
    rows = messages.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", whole_text().alias("text")).distinct()
    line = lambda s: F.struct(quote_level(s).alias("level"), line_words(s).alias("words"))
    rows = rows.select("conv_id", "turn", F.transform(F.split("text", r"\r?\n", -1), line).alias("lines"))
    # a line opens a passage where the level changes; lines without words stay in the one before
    opens = F.transform(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.when((i == 0) | (F.col("lines")[i]["level"] != F.col("lines")[F.greatest(i - 1, F.lit(0))]["level"]), i))
    begins = rows.select("*", F.array_compact(opens).alias("begins"))
    cut = let(F.col("begins"), lambda b: F.transform(b, lambda x, k: F.slice("lines", x + 1, F.coalesce(F.get(b, k + 1), F.size("lines")) - x)))
    parts = begins.select("conv_id", "turn", F.posexplode(cut).alias("passage", "part"))
    return parts.select(
        "conv_id", "turn", "passage", F.col("part")[0]["level"].alias("level"), F.flatten(F.col("part.words")).alias("words"),
        F.filter(F.col("part.words"), lambda w: (F.size(w) > 0) & (F.size(w) < WINDOW)).alias("short"),
    ).filter(F.size("words") > 0)


PASSAGE = ["conv_id", "turn", "passage"]


def _further(first: DataFrame, quoted: DataFrame, own: DataFrame, held: DataFrame, found: DataFrame, hashes: Column) -> DataFrame:
    """The best of all other candidates, for passages whose first choice may not be the best of all: rows like ``first``.

    A better message holds as many windows as the first choice, or all words of the passage. So it holds one of the rarest
    windows: of w windows it can miss all but n, and w - n + 1 of them are enough to meet it. A first choice that holds
    everything and is the latest holder of some window is the best already. Messages of the same words are one candidate, of
    which the latest before the quoting message counts.
    """
    latest = found.groupBy(*PASSAGE).agg(F.min("latest").alias("bound"))
    asked = quoted.join(first.select(*PASSAGE, "best"), PASSAGE).join(latest, PASSAGE, "left")
    open_ = asked.filter(~(F.col("best.whole") & (F.col("best.n") == F.size("windows")) & (F.col("best.parent") == F.col("bound"))))
    # a passage shorter than a window may stand whole where none of its windows does, but for one
    plain = F.when(F.col("n_words") < WINDOW, 1).otherwise(F.size(F.array_distinct(windows(F.split("said", " ")))))
    open_ = durable(open_.withColumn("met", F.size("windows") - F.least(F.col("best.n"), plain) + 1), "open-passages")
    spread = held.join(open_.select("conv_id", F.explode("windows").alias("hash")).distinct(), ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.count("*").alias("holders"))
    windows_of = open_.select(*PASSAGE, "met", F.explode("windows").alias("hash")).join(spread, ["conv_id", "hash"], "left").na.fill(0, ["holders"])
    rarest = Window.partitionBy(*PASSAGE).orderBy("holders", "hash")
    probes = windows_of.withColumn("place", F.row_number().over(rarest)).filter(F.col("place") <= F.col("met")).select(*PASSAGE, "hash")
    # messages of the same own passages
    spoken = own.join(open_.select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id", "turn").agg(
        F.array_sort(F.collect_set(F.array_join("words", " "))).alias("texts"), F.array_distinct(F.flatten(F.collect_list(hashes))).alias("held"))
    spoken = durable(spoken.withColumn("same", F.sha2(F.concat_ws("\n", "texts", F.array_sort("held").cast("array<string>")), 256)), "spoken")
    kinds = spoken.groupBy("conv_id", "same").agg(F.first("texts").alias("texts"), F.first("held").alias("held"))
    met = probes.join(kinds.select("conv_id", "same", F.explode("held").alias("hash")), ["conv_id", "hash"]).select(*PASSAGE, "same").distinct()
    none = F.lit(None).cast(own.schema["turn"].dataType)
    both = met.select("*", none.alias("holder")).unionByName(spoken.select("conv_id", "turn", F.lit(None).cast("int").alias("passage"), "same", F.col("turn").alias("holder")))
    order = Window.partitionBy("conv_id", "same").orderBy("turn", F.col("passage").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("parent", F.last("holder", True).over(order)).filter(F.col("passage").isNotNull() & F.col("parent").isNotNull())
    compared = placed.join(open_.select(*PASSAGE, "level", "n_words", "said", "windows"), PASSAGE).join(kinds, ["conv_id", "same"])
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    whole = F.exists("texts", lambda text: F.contains(padded(text), padded(F.col("said"))))
    n = F.size(F.array_intersect("windows", "held")).cast("long")
    return compared.groupBy(*PASSAGE, "level", "n_words").agg(F.max(F.struct(whole.alias("whole"), n.alias("n"), "parent")).alias("best"))


def replies(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent, n_linked (quoted passages that were found) of messages that quote something known."""
    # only conversations in which anything is quoted
    quoting = messages.filter(F.regexp_like("text", F.lit("(?m)" + QUOTE))).select("conv_id").distinct()
    stored = durable(passages(messages.join(quoting, "conv_id", "left_semi")), "passages")
    hashes = F.array_distinct(F.concat(windows(F.col("words")), F.transform("short", lambda w: F.xxhash64(w))))
    quoted = stored.filter(F.col("level") > 0).select(
        "conv_id", "turn", "passage", "level", F.size("words").alias("n_words"), F.array_join("words", " ").alias("said"), hashes.alias("windows"))
    asked = quoted.select("conv_id", "turn", "passage", F.explode("windows").alias("hash"))
    own = stored.filter(F.col("level") == 0)
    held = own.select("conv_id", "turn", F.explode(hashes).alias("hash")).distinct()
    held = held.join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    # the latest holder before a quoting message: the running last one in the order of turns, a message's own words after its quotes
    both = asked.select("conv_id", "hash", "turn", "passage", F.lit(None).cast(messages.schema["turn"].dataType).alias("holder")).unionByName(
        held.select("conv_id", "hash", "turn", F.lit(None).cast("int").alias("passage"), F.col("turn").alias("holder")))
    order = Window.partitionBy("conv_id", "hash").orderBy("turn", F.col("passage").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.select("*", F.last("holder", True).over(order).alias("latest"), F.first("holder", True).over(order).alias("earliest"))
    found = found.filter(F.col("passage").isNotNull() & F.col("latest").isNotNull())
    pairs = found.select("conv_id", "turn", "passage", F.explode(F.array_distinct(F.array("latest", "earliest"))).alias("parent"))
    named = pairs.distinct()
    votes = named.join(asked, PASSAGE).join(held.withColumnRenamed("turn", "parent"), ["conv_id", "parent", "hash"]).groupBy(*PASSAGE, "parent").agg(F.count("*").alias("n"))
    # compare with what the candidate really said
    candidates = own.join(votes.select("conv_id", F.col("parent").alias("turn")).distinct(), ["conv_id", "turn"], "left_semi")
    said = candidates.select("conv_id", F.col("turn").alias("parent"), F.array_join("words", " ").alias("own"))
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    judged = votes.join(quoted, ["conv_id", "turn", "passage"]).join(said, ["conv_id", "parent"])
    judged = judged.groupBy("conv_id", "turn", "passage", "level", "n_words", "parent").agg(
        F.max(F.contains(padded("own"), padded("said"))).alias("whole"), F.max("n").alias("n"))
    first = durable(judged.groupBy("conv_id", "turn", "passage", "level", "n_words").agg(
        F.max(F.struct("whole", "n", "parent")).alias("best")), "first-choice")
    rest = _further(first, quoted, own, held, found, hashes)
    best = first.unionByName(rest).groupBy("conv_id", "turn", "passage", "level", "n_words").agg(F.max("best")["parent"].alias("parent"))
    return best.groupBy("conv_id", "turn").agg(F.max_by("parent", F.struct(-F.col("level"), "n_words", -F.col("passage"))).alias("parent"), F.count("*").alias("n_linked"))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, thread: the first message that the replies lead back to; for messages with a parent."""
    reach = durable(links.select("conv_id", "turn", F.col("parent").alias("thread")), "threads")
    while True:
        further = reach.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("_next"))
        reach = durable(
            reach.join(further, ["conv_id", "thread"], "left").select(
                "conv_id", "turn", F.coalesce("_next", "thread").alias("thread"), F.col("_next").isNotNull().alias("moved"),
            ), "threads",
        )
        if reach.filter("moved").isEmpty():
            return reach.drop("moved")
        reach = reach.drop("moved")


def own_text(text: Column) -> Column:
    """The text without quoted lines, and without the blank lines these leave at either end."""
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~F.regexp_like(line, F.lit(QUOTE))), "\n")
    tidy = F.regexp_replace(F.rtrim(kept, F.lit(BLANK)), r"^\s*\n", "")
    return F.when(F.regexp_like(text, F.lit("(?m)" + QUOTE)), tidy).otherwise(text)


def places(rows: DataFrame) -> DataFrame:
    """``place``: the message's number in its thread, from 0. Turns are numbered in blocks, so that a long thread is no single group;
    rows that repeat a message have one place."""
    turns = rows.filter(F.col("thread").isNotNull()).select("conv_id", "thread", "turn").distinct().withColumn("block", F.floor(F.col("turn") / NUMBERED))
    counts = turns.groupBy("conv_id", "thread", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id", "thread").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("conv_id", "thread", "block", F.coalesce(before, F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "thread", "block").orderBy("turn"))
    placed = turns.withColumn("rank", rank).join(offsets, ["conv_id", "thread", "block"])
    return rows.join(placed.select("conv_id", "thread", "turn", (F.col("offset") + F.col("rank") - 1).alias("place")), ["conv_id", "thread", "turn"], "left")


def conversations(messages: DataFrame) -> DataFrame:
    """Every message, without quotes: conv_id, thread, place, turn, role, text, parent, n_linked. In order by the first three."""
    links = durable(replies(messages), "replies")
    known = links.join(threads(links), ["conv_id", "turn"])
    rows = messages.select("conv_id", "turn", "role", own_text(F.col("text")).alias("text")).join(known, ["conv_id", "turn"], "left")
    rows = rows.withColumn("thread", F.coalesce("thread", F.when(F.col("conv_id").isNotNull(), F.col("turn"))))
    return places(rows).select("conv_id", "thread", "place", "turn", "role", "text", "parent", F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
