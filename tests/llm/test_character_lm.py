"""Character models in tables against plain dictionaries, and their growth with the corpus."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fileguard.llm import queries
from fileguard.llm.character_lm import character_difference
from tests.llm.cases import LONG, ROWS, awkward, documents, empty

ORDER = 5


def witten_bell(texts, size):
    """Probability of a character after a history of up to four, by the textbook recursion; None stands before a text."""
    counts = [defaultdict(Counter) for _ in range(ORDER)]
    for t in texts:
        s = [None] * (ORDER - 1) + list(t)
        for i in range(ORDER - 1, len(s)):
            for k in range(ORDER):
                counts[k][tuple(s[i - k : i])][s[i]] += 1

    def p(history, x):
        below = p(history[1:], x) if history else 1 / size
        seen = counts[len(history)].get(tuple(history))
        return below if not seen else (seen[x] + len(seen) * below) / (sum(seen.values()) + len(seen))

    return p


def expected(items, marked):
    texts = [(d, t or "") for d, t in items]
    size = len({c for _, t in texts for c in t})
    good = witten_bell([t for d, t in texts if d in marked], size)
    rest = witten_bell([t for d, t in texts if d not in marked], size)
    out = []
    for d, t in texts:
        s = [None] * (ORDER - 1) + list(t)
        out.append((d, len(t), *(
            sum(-math.log2(p(s[i - ORDER + 1 : i], s[i])) for i in range(ORDER - 1, len(s))) / len(t) if t else None
            for p in (good, rest)
        )))
    return out


@pytest.mark.parametrize("block_bytes", [64, 1 << 20])
def test_losses_against_the_recursion(spark, block_bytes):
    items = [(d, t) for d, t in ROWS if t != LONG and t != LONG + "and a bit more"]
    items += [(20, "the cat sat on the mat"), (21, "the cat sat on the hat"), (22, "7 of 9 BFGJKMPQ"), (23, "語" * 9 + "\0" * 7)]
    df = spark.createDataFrame(items, "doc_id long, text string").withColumn("block", F.lit("clash"))
    target = spark.createDataFrame([(1,), (20,), (20,), (None,), (99,)], "doc_id long")
    found = character_difference(df, target, block_bytes=block_bytes).collect()
    key = lambda r: (str(r[0]), r[1], r[2] or 0)
    for got, want in zip(sorted(map(tuple, found), key=key), sorted(expected(items, {1, 20}), key=key), strict=True):
        assert got[:2] == want[:2]
        if want[2] is None:
            assert got[2:] == (None, None, None)
        else:
            assert got[2:4] == pytest.approx(want[2:], rel=1e-5)
            assert got[4] == pytest.approx(want[2] - want[3], rel=1e-4, abs=1e-5)


def test_more_characters_than_fit_one_number(spark):
    rng = random.Random(3)
    items = [(i, "".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(4000))) for i in range(3)]
    found = character_difference(spark.createDataFrame(items, "doc_id long, text string"), spark.createDataFrame([(1,)], "doc_id long"))
    for got, want in zip(sorted(map(tuple, found.collect())), expected(items, {1}), strict=True):
        assert got[2:4] == pytest.approx(want[2:], rel=1e-5)


def test_query_tells_rare_characters_apart(spark, tmp_path):
    # Digits are the rarest characters here: a vocabulary of the commonest ones takes them for one symbol.
    common = "".join(chr(0x430 + i) + chr(0x3B1 + i % 24) for i in range(32)) * 20
    items = [(i, common + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" * 9) for i in range(4)]
    items += [(10, "111"), (11, "111"), (12, "222"), (13, "222")]
    spark.createDataFrame(items, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(10, 1, 0), (12, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    score = {r["doc_id"]: r["score"] for r in queries.op1_lm_scoring(spark, str(tmp_path)).collect()}
    assert score[11] < score[13] - 1


def test_scoring_corners(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert character_difference(empty(spark), spark.createDataFrame([(1,)], "doc_id long")).count() == 0
    found = character_difference(awkward(spark), none).collect()
    size = len({c for _, t in ROWS for c in t or ""})
    assert len(found) == len(ROWS)
    assert all(r["loss_target"] == pytest.approx(math.log2(size)) for r in found if r["n_tokens"])


def test_good_texts_score_lower(spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    scored = character_difference(documents(spark), labels.where("quality = 1 and toxic = 0"))
    by = {r["quality"]: r["s"] for r in scored.join(labels, "doc_id").groupBy("quality").agg(F.avg("score").alias("s")).collect()}
    assert by[1] < by[0]
