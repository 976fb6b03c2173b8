"""Awkward tables and plain re-statements of the operators, shared by the tests of the text operators."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import pairwise

LONG = "Lorem ipsum dolor sit amet, consectetur adipiscing elit; " * 4000

#: Nulls in any column, empty and blank texts, repeated rows, one id with two texts, a very long text, NUL, other scripts.
ROWS = [
    (1, "A first line with ten words or more, as prose has them, in plain English.\nAnd one more."),
    (2, None),
    (3, ""),
    (4, " \t\r\n\x0b\x0c "),
    (None, "a text without an id"),
    (None, None),
    (5, "repeated row"),
    (5, "repeated row"),
    (6, "one id"),
    (6, "but two texts"),
    (7, LONG),
    (8, LONG + "and a bit more"),
    (9, "nul \x00 inside, ünïcödé, 漢字 and 😀 signs; İstanbul ΑΣ"),
    (10, "x" * 5000),
    (11, "###$$$ %%% <<>> | |"),
]

SCHEMA = "doc_id long, text string"
#: Names that the operators use inside.
CLASHING = ["row", "key", "kept", "n", "start", "runs", "words", "whole", "component", "bucket", "score", "lang", "_words", "digest"]


def awkward(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHING))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def documents(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")


def noisy_family(n: int, words: int, changed: float, seed: int = 1) -> list[str]:
    """``n`` copies of one text, each with some words changed."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    return [" ".join(f"c{rng.randrange(10**6)}" if rng.random() < changed else w for w in base) for _ in range(n)]


def distinct_documents(items):
    """Documents as the operators define them: distinct (doc_id, text), null ids first."""
    found = {(d, t or "") for d, t in items}
    return sorted(found, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))


def removed(items, length):
    """doc_id, bytes, removed, spans and digest of what stays, by a set of all windows seen so far."""
    seen, out = set(), []
    for doc_id, text in distinct_documents(items):
        raw = text.encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(b and not a for a, b in pairwise([False, *gone]))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def shingles(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def near(items, width, percent=80):
    """doc_id, shingles, component and kept, by comparing all pairs."""
    docs = distinct_documents(items)
    sets = [shingles(t, width) for _, t in docs]
    lead = list(range(len(docs)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                lead[max(x, y)] = min(x, y)
    return sorted(((d, len(s), docs[find(i)][0], find(i) == i) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=repr)
