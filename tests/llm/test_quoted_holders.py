"""Messages between the first and the latest holder of a passage's windows."""

from pulsegrid.llm import quotations


def _messages(spark, rows):
    return spark.createDataFrame([("c", turn, "user", text) for turn, text in enumerate(rows)], "conv_id string, turn int, role string, text string")


def test_the_best_holder_may_be_neither_the_first_nor_the_latest(spark):
    one, two = "alpha beta gamma delta epsilon", "zeta eta theta iota kappa"
    across = "gamma delta epsilon zeta eta theta"
    rows = [f"{one} first", f"{two} second", across, f"well {one} {two} then", across, f"{two} later", f"{one} last of them", f"> {one} {two}\nyes"]
    found = {r.turn: r.parent for r in quotations.replies(_messages(spark, rows)).collect()}
    assert found == {7: 3}


def test_most_windows_without_the_whole(spark):
    said = "a1 a2 a3 a4 a5 b1 b2 b3 b4 b5 c1 c2 c3 c4 c5"
    part = "a1 a2 a3 a4 a5 b1 b2 b3 b4 b5"
    ends = ["a1 a2 a3 a4 a5 b1", "b1 b2 b3 b4 b5", "a5 b1 b2 b3 b4", "a3 a4 a5 b1 b2 b3"]
    rows = [*ends, f"x {part} y", *[f"x {part} y"] * 2, *ends, f"> {said}\nno"]
    found = {r.turn: (r.parent, r.n_linked) for r in quotations.replies(_messages(spark, rows)).collect()}
    assert found == {len(rows) - 1: (6, 1)}
    # what comes after the quoting message is no candidate
    rows = [*ends, f"> {said}\nno", f"x {part} y"]
    assert {r.parent for r in quotations.replies(_messages(spark, rows)).collect()} <= set(range(4))
