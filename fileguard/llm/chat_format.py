"""Conversations as training windows within a token budget, with reversible marks and a loss mask.

Template of a turn: ``<role>``, a line feed, the text, ``<end>``, a line feed. Inside roles and texts ``\\``, ``<`` and ``>``
are written ``\\b``, ``\\l`` and ``\\g``, so the marks cannot occur in them and the original can be read back.

Prefix sums of the turns' tokens cut a conversation into spans. A span has room for the budget without the system turn and
without a quarter that is set aside for history. On the axis of the sums, cells of that room are laid out; the turns that end
in one cell form a span if they fit, else the first of them (it begins in an earlier cell) is a span and the rest another. A
window is the system turn, up to ``history`` turns before the span, and the span; the newest history comes first and ends where
the budget would be passed. What is repeated carries no loss; each assistant text is a target in one window only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 2

ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
END = "<end>\n"


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def turn_tokens(text: Column) -> Column:
    """The unit of the budget: runs of letters and digits, each other sign but blanks, and three for the marks of the turn. It
    is a count by pattern that native functions can make, not that of a vocabulary."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\x09-\x0D\x20\p{L}\p{N}]")).cast("long") + 3


def chat_windows(df: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of all conversations: conv_id, span (rising, with gaps), text, n_turns, n_repeated (leading turns without loss),
    n_tokens, over_budget and loss (array of start, end in code points of ``text``).

    Turns are ordered by turn, role and text, nulls first. Null roles and texts are empty. Rows with a null conv_id form one
    conversation. Repeated rows are turns of their own. Only the first turn of role ``system`` is retained in later windows.
    Tokens are counted by ``turn_tokens``. Turns are never cut: a window is over_budget only if its span is one turn that does
    not fit beside the system turn, and has no history then. An empty table gives an empty result; further columns are ignored.
    """
    role, said = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), said.alias("said"))
    head = F.concat(F.lit("<"), escaped(F.col("role")), F.lit(">\n"))
    rows = rows.withColumns({"tokens": turn_tokens(F.col("said")), "head": head})
    talk = Window.partitionBy("conv_id").orderBy("turn", "role", "said")
    before, all_ = talk.rowsBetween(Window.unboundedPreceding, -1), talk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("place", F.row_number().over(talk))
    rows = rows.withColumn("system_place", F.first(F.when(F.col("role") == "system", F.col("place")), ignorenulls=True).over(all_))
    part = F.struct(
        "place",
        F.concat("head", escaped(F.col("said")), F.lit(END)).alias("block"),
        F.length("head").alias("head"),
        (F.col("role") == "assistant").alias("target"),
        "tokens",
    )
    rows = rows.withColumn("part", part)
    system = F.when(F.col("place") == F.col("system_place"), F.col("part"))
    past = [F.lag(F.when(system.isNull(), F.col("part")), k).over(talk) for k in range(1, max(1, history) + 1)]
    rows = rows.select(
        "conv_id", "place", "tokens", "part", "system_place",
        F.first(system, ignorenulls=True).over(all_).alias("system"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("begin"),
        F.slice(F.array(*past), 1, history).alias("past"),
    )
    room = F.greatest(F.lit(1), budget - budget // 4 - F.coalesce("system.tokens", F.lit(0)))
    cell = F.floor((F.col("begin") + F.col("tokens") - 1) / room).cast("long")
    cells = rows.withColumns({"room": room, "cell": cell}).groupBy("conv_id", "cell").agg(
        F.array_sort(F.collect_list("part")).alias("own"),
        F.min_by("past", "place").alias("past"),
        F.first("system").alias("system"), F.first("room").alias("room"), F.first("system_place").alias("system_place"),
    )
    total = lambda parts: F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["tokens"])
    lead, rest = F.slice("own", 1, 1), F.slice("own", 2, F.size("own"))
    # What precedes the rest: its first turn and what precedes that. The system turn's place in the history stays empty.
    passed = F.transform(lead, lambda p: F.when(~F.coalesce(p["place"] == F.col("system_place"), F.lit(False)), p))
    nearest = F.slice(F.concat(passed, "past"), 1, history)
    span = lambda half, own, past: F.struct((2 * F.col("cell") + half).alias("span"), own.alias("own"), past.alias("past"))
    halves = F.when(
        (total("own") > F.col("room")) & (F.size("own") > 1),
        F.array(span(0, lead, F.col("past")), span(1, rest, nearest)),
    ).otherwise(F.array(span(0, F.col("own"), F.col("past"))))
    spans = cells.select("conv_id", "system", F.explode(halves).alias("x")).select("conv_id", "system", "x.span", "x.own", F.array_compact("x.past").alias("past"))
    kept = F.filter(F.array_compact(F.array("system")), lambda p: p["place"] < F.col("own")[0]["place"])
    spans = spans.withColumn("kept", kept)
    left = budget - total("own") - total("kept")
    none = F.struct(left.alias("left"), F.lit(0).alias("n"))
    fitting = F.aggregate(
        "past", none, lambda s, p: F.when(
            p["tokens"] <= s["left"], F.struct((s["left"] - p["tokens"]).alias("left"), (s["n"] + 1).alias("n"))
        ).otherwise(F.struct(F.lit(-1).cast("long").alias("left"), s["n"].alias("n"))), lambda s: s["n"],
    )
    ahead = F.array_sort(F.concat("kept", F.slice("past", F.lit(1), fitting)))
    spans = spans.select("conv_id", "span", "own", ahead.alias("ahead"))
    spans = spans.select("conv_id", "span", F.concat("ahead", "own").alias("parts"), F.size("ahead").alias("n_repeated"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def walk(state: Column, x: Column) -> Column:
        size = F.length(x["part"]["block"])
        target = F.struct(
            (state["at"] + x["part"]["head"]).alias("start"), (state["at"] + size - len(END)).alias("end")
        )
        loss = F.when(x["new"] & x["part"]["target"], F.concat(state["loss"], F.array(target))).otherwise(state["loss"])
        return F.struct((state["at"] + size).alias("at"), loss.alias("loss"))

    numbered = F.transform("parts", lambda p, i: F.struct(p.alias("part"), (i >= F.col("n_repeated")).alias("new")))
    return spans.select(
        "conv_id", "span",
        F.array_join(F.transform("parts", lambda p: p["block"]), "").alias("text"),
        F.size("parts").alias("n_turns"), "n_repeated",
        total("parts").alias("n_tokens"), (total("parts") > budget).alias("over_budget"),
        F.aggregate(numbered, start, walk, lambda s: s["loss"]).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, span, turns (array of role, text), loss_text and n_chars as the windows' own text and mask give them;
    repeated turns are left out of turns."""
    whole = F.split("text", END)
    own = F.slice(whole, F.col("n_repeated") + 1, F.size(whole) - 1 - F.col("n_repeated"))
    cut = lambda t: F.instr(t, ">\n")
    turn = lambda t: F.struct(
        unescaped(F.substring(t, F.lit(2), cut(t) - 2)).alias("role"),
        unescaped(F.substring(t, cut(t) + 2, F.length(t))).alias("text"),
    )
    masked = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return windows.select(
        "conv_id", "span", F.transform(own, turn).alias("turns"), F.array_join(masked, "").alias("loss_text"),
        F.length("text").alias("n_chars"),
    )
