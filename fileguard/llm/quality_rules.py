"""Quality rules over whole texts as one short-circuit cascade of DataFrame functions.

Measures are column expressions; a rule is a boolean expression over them that says "reject". What a rule costs and how often
it rejects is measured on a bounded sample, and the rules are then tried in the order of rejections per second, so that the
dear ones see only what the cheap ones let through (``passed``; ``quality_rules`` has to return every measure of every row). The
order never changes a verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileguard.llm.common import documents

#: Rows on which cost and selectivity of the rules are estimated. It bounds the estimate only, never the rows judged.
SAMPLE_ROWS = 2000

#: White space of the word definition: space and the characters 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text to go. It may use ``text`` and the columns of ``measures``."""

    name: str
    rejects: Column


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")


def given(df: DataFrame, keep: list[str], *found: Column | str) -> DataFrame:
    """``keep`` and ``found`` as columns that a filter does not get behind: it would be pushed below the projections with a copy of
    the expression for each use of an array, but it does not pass a generator."""
    return df.select(*keep, F.explode(F.array(F.struct(*found))).alias("_found")).select(*keep, "_found.*")


def measures(df: DataFrame) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of its column ``text``."""
    return repeated(counted(df))


def counted(df: DataFrame) -> DataFrame:
    """``df`` with the cheap measures of its column ``text``, and ``_hashes`` of its words for ``repeated``.

    A word is a run of characters other than space and 9 to 13. A line counts if it has a word.
    """
    keep = df.columns
    text = F.col("text")
    # Each step's arrays are read more than once by the next step, so the optimizer keeps them as columns of their own.
    df = df.withColumns({
        "_words": F.array_remove(F.split(text, BLANKS), ""),
        "_lines": F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    })
    return given(
        df,
        keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )


def repeated(df: DataFrame) -> DataFrame:
    """``df`` of ``counted`` with n_repeat_words: the words inside 5-word windows that occur at least twice in the text. Windows are
    compared by 64-bit hashes."""
    keep = [c for c in df.columns if c != "_hashes"]
    at = lambda i, k: F.get("_hashes", (i + k).cast("int"))
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_hashes") - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW)))
    )
    df = df.select(*keep, F.when(F.size("_hashes") > WINDOW, windows).alias("_windows"))
    # Most texts repeat no window; only the others are sorted.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select(*keep, F.when(repeats, placed).alias("_placed"))
    same = lambda x, j: F.coalesce(F.get("_placed", j)["h"] == x["h"], F.lit(False))
    twice = F.filter("_placed", lambda x, j: same(x, j - 1) | same(x, j + 1))
    df = df.select(*keep, F.array_sort(F.transform(twice, lambda x: x["i"])).alias("_starts"))
    # A window covers its five words, or up to where the next one starts.
    covered = F.transform(
        "_starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1) - s, F.lit(WINDOW)))
    )
    total = F.aggregate(covered, F.lit(0), lambda a, x: a + x)
    return given(df, keep, F.coalesce(total, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> list[Rule]:
    """The production rules. Bounds are wide: prose in any script that separates words passes."""
    n, text = F.col("n_words"), F.col("text")
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        Rule("letters", 10 * F.length(letters) < 6 * F.col("word_chars")),
        Rule("shouting", 2 * F.length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) > F.length(letters)),
        Rule("exclamations", 5 * (F.length(text) - F.length(F.translate(text, "!?", ""))) > n),
    ]


def base_rules() -> tuple[Rule, Rule]:
    """The two parts of the base. The second needs a measure of its own, the dearest of all."""
    return Rule("short", F.col("n_words") < 10), Rule("repeats", 100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ranked(df: DataFrame, tried: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejections per second on a sample of ``df`` (with ``text``). ``repeats`` is timed with its measure. A
    stopwatch decides, so two runs may try rules in another order; verdicts are the same."""
    sample = counted(df.limit(sample_rows)).persist()

    def took(rows: DataFrame, what: Column) -> tuple[float, int]:
        began = time.perf_counter()
        rejected = rows.agg(F.count_if(what)).first()[0]
        return time.perf_counter() - began, rejected

    try:
        took(sample, F.lit(False))
        idle = min(took(sample, F.lit(False))[0] for _ in range(2))
        seen = {r.name: took(repeated(sample) if r.name == "repeats" else sample, r.rejects) for r in tried}
    finally:
        sample.unpersist()
    worth = {name: rejected / max(seconds - idle, 1e-3) for name, (seconds, rejected) in seen.items()}
    return sorted(tried, key=lambda r: (-worth[r.name], r.name))


def passed(df: DataFrame, tried: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, order: bool = True) -> DataFrame:
    """The rows of ``df`` that ``quality_rules`` keeps, with their columns.

    Here the cascade covers the base as well: a text that a rule rejects is not measured for those after it, so repeats are
    counted only in texts that the rules in front of them have let through.
    """
    named = documents(df, F.struct(*(F.col(c) for c in df.columns)).alias("whole"))
    short, repeats = base_rules()
    cascade = [short, *(rules() if tried is None else tried), repeats]
    if order:
        cascade = ranked(named, cascade, sample_rows)
    left, at = counted(named), [r.name for r in cascade].index(repeats.name)

    def through(rows: DataFrame, part: list[Rule]) -> DataFrame:
        verdict = F.lit(False)
        for rule in reversed(part):
            verdict = F.when(rule.rejects, F.lit(True)).otherwise(verdict)
        return rows.where(~verdict)

    left = through(repeated(through(left, cascade[:at])), cascade[at:])
    return left.select("whole.*")


def quality_rules(
    df: DataFrame, tried: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, order: bool = True
) -> DataFrame:
    """``doc_id``, the measures, ``base_failed``, ``rejected_by`` (first rule that fired) and ``kept`` for every row.

    Null and empty texts have no words and fail the base; a null ``doc_id`` stays null; repeated rows are judged each by
    itself; an empty table gives an empty result; further columns are ignored, whatever their names. ``order=False`` keeps
    the rules as they stand and runs no job.
    """
    docs = documents(df)
    tried = rules() if tried is None else tried
    if order:
        tried = ranked(docs, tried, sample_rows)
    verdict = F.when(base_failed(), "base")
    for rule in tried:
        verdict = verdict.when(rule.rejects, rule.name)
    judged = measures(docs).withColumn("base_failed", base_failed()).withColumn("rejected_by", verdict)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("rejected_by").isNull().alias("kept"), "rejected_by",
    )
