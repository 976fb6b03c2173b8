"""Packing by tokens of a tokenizer instead of blank-separated words."""

from fileguard.llm import queries
from fileguard.llm.token_counts import token_counts


def test_a_text_without_blanks_has_its_tokens(spark, tmp_path):
    items = [(1, "漢字" * 3000), (2, "x9Qz" * 20000), (3, "two words"), (4, None), (None, ""), (5, "same"), (5, "same")]
    df = spark.createDataFrame(items, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda x: (x[0] is not None, x)
    want = sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts(df).collect()), key=key)
    packed = queries.op5_packing(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in packed), key=key) == want
    assert min(n for d, n in want if d in (1, 2)) > 1000
    batches = {}
    for r in packed:
        assert r["n_tokens"] <= r["boundary"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["boundary"])
    assert all(len(b) == 1 or sum(b) <= 1 << 16 for b in batches.values())


def test_boundaries_of_very_long_texts_are_real_lengths(spark):
    """Above the exact bins: with no two lengths in a bin the plan is the best of all; else at most a bin's width above it."""
    import random

    from fileguard.llm.packing import EXACT, boundaries, pack

    rng = random.Random(6)
    for apart, worst in ((600, 0.0), (7, 1 / 128)):
        lengths = sorted(EXACT + 1 + apart * x for x in rng.sample(range(60), 40))
        items = [(i, "w " * n) for i, n in enumerate(lengths)]
        packed = pack(spark.createDataFrame(items, "doc_id long, text string"), n_buckets=4).collect()
        assert sorted(r["n_tokens"] for r in packed) == lengths
        ends = {r["boundary"] for r in packed}
        assert ends <= set(lengths) and len(ends) <= 4 and all(r["n_tokens"] <= r["boundary"] for r in packed)
        best = boundaries(lengths, [1] * len(lengths), 4)
        least = sum(min(e for e in best if e >= n) - n for n in lengths)
        got = sum(r["boundary"] - r["n_tokens"] for r in packed)
        assert least <= got <= least + worst * sum(lengths)
