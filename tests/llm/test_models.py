"""Language identification against plain dictionaries, and on held-out texts."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fileguard.llm import language_id as li
from tests.llm.cases import awkward, documents, empty


def kneser_ney(texts):
    """Interpolated Kneser-Ney by dictionaries, one discount for each order."""
    counts = Counter()
    for t in texts:
        s = "\0\0\0" + t.lower()
        counts.update(s[i - 3 : i + 1] for i in range(3, len(s)))
    levels = [None, None, None, counts]
    for n in (2, 1, 0):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    return levels


def test_probabilities_against_dictionaries():
    texts = {"aa": ["the cat sat on the mat", "a dog sat", "İx"], "bb": ["der hund saß auf der matte", "ein kater"]}
    counts = []
    for own in texts.values():
        points, _ = li.symbols(own)
        gram = li.grams(points)
        counts.append(np.unique(gram[li.low_order(gram, 1) > 0], return_counts=True))
    models = li.kneser_ney(list(texts), counts)
    levels = [kneser_ney(own) for own in texts.values()]
    alphabet = len({g for ls in levels for g in ls[0]}) + 1

    def p(ls, history, x):
        n = len(history)
        below = p(ls, history[1:], x) if n else 1 / alphabet
        level = ls[n]
        own = {g: c for g, c in level.items() if g[:-1] == history}
        if not own:
            return below
        once, twice = (sum(c == k for c in level.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        return max(level.get(history + x, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * below

    for text in ["the hund", "q!", "sat auf", "ß"]:
        got = li.cross_entropies(models, [text])[0]
        s = "\0\0\0" + text
        for j, ls in enumerate(levels):
            want = sum(-math.log(p(ls, s[i - 3 : i], s[i])) for i in range(3, len(s))) / len(text)
            assert got[j] == pytest.approx(want, rel=1e-6)
    # Each model is a distribution over the alphabet and one symbol for the unknown.
    for ls in levels:
        signs = [g for g in {g for m in levels for g in m[0]}] + ["￿"]
        assert sum(p(ls, "the", x) for x in signs) == pytest.approx(1)


def test_held_out_accuracy(spark):
    docs = documents(spark, "sf0.01")
    found = li.identify(docs, li.fit(li.training_rows(docs)))
    held = found.join(docs.select("doc_id", "lang"), "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    right, all_ = held.select(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / all_ > 0.97
    assert found.where("score < 0 or score > 1 or lang_pred is null").isEmpty()


def test_language_corners(spark):
    docs = documents(spark)
    models = li.fit(li.training_rows(docs))
    found = {(r["doc_id"], r["lang_pred"]) for r in li.identify(awkward(spark), models).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (11, "und")} <= found
    assert len([x for x in found if x[1] != "und"]) >= 8
    assert li.identify(empty(spark), models).count() == 0
    nothing = li.fit(li.training_rows(docs.where("false")))
    assert {r["lang_pred"] for r in li.identify(awkward(spark), nothing).collect()} == {"und"}
    nulls = spark.createDataFrame([(1, None, "en"), (2, "text", None), (None, "text", "en")], "doc_id long, text string, lang string")
    assert li.training_rows(nulls).count() == 0


def test_signs_that_are_no_letters(spark):
    """Superscripts, fractions, circled and Roman numerals are no letters."""
    items = [(2, "the cat sat on the mat and the dog ran", "en"), (3, "der Hund lief und die Katze schlief", "de")]
    models = li.fit(spark.createDataFrame(items, "doc_id long, text string, lang string"))
    texts = ["² ½ ①", "Ⅷ", "123 _ ...", "", None, "ª", "é", "漢", "1 b"]
    got = li.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), models).collect()
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert [found[i] for i in range(5)] == [("und", 0.0)] * 5
    assert all(found[i][0] in ("en", "de") for i in range(5, 9))


def test_no_language_is_lost(spark):
    """One document of a language is fitted on, even if it is long or the draw would have it calibrate."""
    for doc_id in range(12):
        items = [(doc_id, "el perro corre y la gata duerme " * 50, "es")] + [(100 + i, f"the cat sat on mat number {i} and ran", "en") for i in range(40)]
        models = li.fit(spark.createDataFrame(items, "doc_id long, text string, lang string"), fit_chars=200)
        assert models.langs == ["en", "es"]
