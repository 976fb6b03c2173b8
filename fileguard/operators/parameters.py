"""Parameters as tables: versions that hold from a time on, and word lists that one automaton a task matches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fileguard.functions.time import with_event_time
from fileguard.operators.features import SCRIPT_SUFFIXES, SUSPICIOUS_WORDS, SYSTEM_SUFFIXES
from fileguard.params import EngineParams

#: Both tables are read into each task; larger ones are an error.
MOST_VERSIONS = 10_000
MOST_WORDS = 200_000

VERSIONS = (
    "valid_from_us long, velocity_threshold int, rename_threshold int, velocity_ratio double, rename_ratio double"
)
WORDS = "list string, field string, place string, word string, valid_from_us long, valid_to_us long"
TITLE, PATH, ANYWHERE, AT_END = "title", "path", "anywhere", "end"


def first_version(spark: SparkSession, params: EngineParams = EngineParams()) -> DataFrame:
    """One version with the engine's parameters, valid from the beginning of time."""
    row = (
        -(1 << 62), params.detector.velocity_threshold, params.detector.rename_threshold,
        params.fusion.ratios["high_velocity"], params.fusion.ratios["systematic_rename"],
    )
    return spark.createDataFrame([row], VERSIONS)


def default_words(spark: SparkSession) -> DataFrame:
    """The word lists of the features, valid always."""
    lists = [("suspicious_path", PATH, ANYWHERE, SUSPICIOUS_WORDS), ("process_related", TITLE, AT_END, SCRIPT_SUFFIXES), ("system_executable", TITLE, AT_END, SYSTEM_SUFFIXES)]
    return spark.createDataFrame([(name, field, place, w, None, None) for name, field, place, words in lists for w in words], WORDS)


def bounded(table: DataFrame, most: int) -> list:
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a parameter table may have {most} rows")
    return rows


def as_of(events: DataFrame, versions: DataFrame) -> DataFrame:
    """``events`` with ``version``: the newest row of ``versions`` with ``valid_from_us`` up to the event's time, NULL before the
    first. Of versions that begin together the one with the largest values counts. The table is small, so an event finds its
    version by binary search in an array of constants; nothing is shuffled."""
    names = [c for c in versions.columns if c != "valid_from_us"]
    rows = {r["valid_from_us"]: r for r in sorted(bounded(versions.select("valid_from_us", *names), MOST_VERSIONS), key=lambda r: tuple(x if x is not None else float("-inf") for x in r))}
    rows = [rows[k] for k in sorted(rows)]
    timed = with_event_time(events)
    types = {f.name: f.dataType for f in versions.schema.fields}
    if not rows:
        none = F.lit(None).cast(versions.select(F.struct(*names).alias("v")).schema["v"].dataType)
        return timed.withColumn("version", none)
    begins = F.array(*(F.lit(r["valid_from_us"]).cast("long") for r in rows))
    kept = F.array(*(F.struct(*(F.lit(r[n]).cast(types[n]).alias(n) for n in names)) for r in rows))
    half = 1
    while half < len(rows):
        half *= 2
    out = timed.withColumns({"_begins": begins, "_at": F.lit(0)})
    while half:
        # As many versions begin up to the event's time.
        fits = F.coalesce(F.get("_begins", F.col("_at") + (half - 1)) <= F.col("ts_us"), F.lit(False))
        out = out.withColumn("_at", F.col("_at") + F.when(fits, half).otherwise(0))
        half //= 2
    return out.withColumn("version", F.get(kept, F.col("_at") - 1)).drop("_begins", "_at")


def flags_as_of(measured: DataFrame, versions: DataFrame) -> DataFrame:
    """Window measures with both flags by the thresholds that held at the event's time, and ``evidence``, the product of the
    multipliers of the flags that are set. Before the first version no flag is set."""
    rated = as_of(measured, versions)
    v = lambda name: F.col(f"version.{name}")
    velocity = F.coalesce(F.col("recent_writes") > v("velocity_threshold"), F.lit(False))
    rename = F.coalesce((F.col("recent_renames") >= v("rename_threshold")) & (F.col("rename_extensions") == 1), F.lit(False))
    one = F.lit(1.0)
    evidence = F.when(velocity, v("velocity_ratio")).otherwise(one) * F.when(rename, v("rename_ratio")).otherwise(one)
    return rated.withColumns({"high_velocity": velocity, "systematic_rename": rename, "evidence": evidence}).drop("version")


def word_flags(events: DataFrame, words: DataFrame, names: list[str]) -> DataFrame:
    """``events`` with one 0/1 column for each of the lists ``names``: does the title or path hold a word of the list that is valid at
    the event's time, anywhere or at its end? Case does not count; NULL texts are empty; an empty word matches nothing.

    All words of a field are one automaton, built once a task, so the cost of a text does not grow with the lists; a text that
    occurs often is matched once a batch."""
    entries = [tuple(r) for r in bounded(words.select("list", "field", "place", "word", "valid_from_us", "valid_to_us"), MOST_WORDS) if r["word"]]
    schema = ", ".join(f"`{n}` int" for n in names)

    @F.pandas_udf(schema)
    def matched(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machines = {}
        for field in (TITLE, PATH):
            machine = ahocorasick.Automaton()
            held: dict[str, list] = {}
            for name, of, place, word, begins, ends in entries:
                if of == field and name in names:
                    held.setdefault(word.lower(), []).append((names.index(name), place == AT_END, begins, ends))
            for word, uses in held.items():
                machine.add_word(word, (len(word), uses))
            if held:
                machine.make_automaton()
                machines[field] = machine
        for title, path, ts in batches:
            out = {n: pd.Series(0, index=ts.index, dtype="int32") for n in names}
            for field, texts in ((TITLE, title), (PATH, path)):
                if field not in machines:
                    continue
                of, kinds = pd.factorize(texts.fillna(""))
                hits: dict[tuple, list[int]] = {}
                for i, text in enumerate(kinds):
                    low = text.lower()
                    seen = {
                        (which, begins, ends)
                        for at, (_, uses) in machines[field].iter(low)
                        for which, at_end, begins, ends in uses
                        if not at_end or at == len(low) - 1
                    }
                    for use in seen:
                        hits.setdefault(use, []).append(i)
                for (which, begins, ends), found in hits.items():
                    rows = pd.Series(of, index=ts.index).isin(found)
                    if begins is not None:
                        rows &= ts >= begins
                    if ends is not None:
                        rows &= ts < ends
                    out[names[which]] |= rows.astype("int32")
            yield pd.DataFrame(out)

    timed = with_event_time(events)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    found = timed.withColumn("_words", matched(text("local_title"), text("full_path"), F.col("ts_us")))
    columns: dict[str, Column] = {n: F.col(f"_words.{n}") for n in names}
    return found.withColumns(columns).drop("_words")
