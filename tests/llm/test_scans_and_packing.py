import itertools
import random

from pyspark.sql import functions as F

from fileguard.llm.decontamination import clean, cut, decontaminate, myers
from fileguard.llm.license_scan import NOTICES, license_scan
from fileguard.llm.packing import boundaries, pack
from tests.llm.cases import awkward, documents, empty, rows


def least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_bit_vectors_against_the_table():
    rng = random.Random(2)
    for _ in range(300):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        masks = {}
        for i, ch in enumerate(pattern):
            masks[ch] = masks.get(ch, 0) | 1 << i
        assert myers(masks, len(pattern), text)[0] == least_edits(pattern, text)
        assert "".join(p for _, p in cut(pattern, 3)) == pattern


def test_passages_within_the_budget(spark):
    rng = random.Random(4)
    letters = "abcdefghij "
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(30, 120))).strip() + "x") for i in range(12)]
    items += [(50, None), (51, "  "), (52, "ab"), (0, items[0][1])]

    def edited(text, n):
        text = list(text)
        for _ in range(n):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choice(letters)
        return "".join(text)

    docs = []
    for d in range(120):
        filler = "".join(rng.choice(letters) for _ in range(80))
        item = items[d % 12][1]
        docs.append((d, filler.upper() + edited(item, d % 14) + "\n\n" + filler))
    normal = lambda t: " ".join((t or "").lower().split())
    expected = []
    for d, t in docs:
        hit = sorted({i for i, x in items if normal(x) and least_edits(normal(x), normal(t)) <= int(len(normal(x)) * 0.08)})
        expected.append((d, hit))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("distance", F.lit("clash"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (1 << 20, 100):
        found = decontaminate(df, bench, block_chars=block)
        assert sorted((r["doc_id"], list(r["items"])) for r in found.collect()) == expected
    left = clean(df, bench, block_chars=100)
    assert sorted(r["doc_id"] for r in left.collect()) == [d for d, hit in expected if not hit]


def test_decontamination_corners(spark):
    bench = spark.createDataFrame([(1, "repeated row"), (None, "x")], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate(awkward(spark), bench).collect()}
    assert found[5]["contaminated"] and not found[6]["contaminated"] and not found[None]["contaminated"] and len(found) == 12
    assert clean(awkward(spark), bench).count() == awkward(spark).count() - 2
    assert decontaminate(empty(spark), bench).count() == 0
    assert decontaminate(awkward(spark), bench.where("false")).where("contaminated").isEmpty()


def test_licences(spark):
    mit = next(t for i, t in NOTICES if i == "MIT" and len(t) > 500)
    items = [
        (1, f"Copyright (c) 2020 A. Holder\n\n{mit}"),
        (2, mit.upper().replace(",", " ,").replace(" ", "\n ")),
        (3, "Some text.\n  LICENCED under the apache licence version 2.0!\nAll rights reserved"),
        (4, mit + " and more"),
        (5, None),
        (6, "© 1999 x\nreleased under the MIT license"),
    ]
    df = spark.createDataFrame(items, "doc_id long, text string").withColumn("digest", F.lit("clash"))
    found = rows(license_scan(df), "doc_id", "license_id", "n_license_lines", "line_licenses")
    assert found == [(1, "MIT", 1, "MIT"), (2, "MIT", 0, ""), (3, None, 2, "Apache-2.0,Proprietary"), (4, None, 0, ""), (5, None, 0, ""), (6, "MIT", 1, "MIT")]
    assert license_scan(awkward(spark)).count() == 12
    assert license_scan(empty(spark)).count() == 0
    own = spark.createDataFrame([("A", "x y"), ("B", "X, y."), ("C", None), ("D", "...")], "license_id string, text string")
    assert rows(license_scan(spark.createDataFrame([(1, "X-Y")], "doc_id long, text string"), own), "license_id") == [("A",)]


def padding(ends, lengths, counts):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))


def test_boundaries_against_all_choices():
    rng = random.Random(6)
    for _ in range(150):
        lengths = sorted(rng.sample(range(0, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 20) for _ in lengths]
        for k in (1, 2, 3, 12):
            best = min(
                padding([*c, lengths[-1]], lengths, counts)
                for n in range(min(k, len(lengths)))
                for c in itertools.combinations(lengths[:-1], n)
            )
            ends = boundaries(lengths, counts, k)
            assert len(ends) <= k and padding(ends, lengths, counts) == best


def test_packing(spark):
    docs = documents(spark, "sf0.01")
    packed = pack(docs, n_buckets=6, budget=5000, rows_per_chunk=17).collect()
    assert len(packed) == docs.count()
    words = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
    batches = {}
    for r in packed:
        assert r["n_tokens"] == words[r["doc_id"]] <= r["boundary"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    last = {}
    for (bucket, batch), held in batches.items():
        size = max(1, 5000 // max(1, held[0]["boundary"]))
        assert sorted(r["slot"] for r in held) == list(range(len(held))) and len(held) <= size
        last.setdefault(bucket, []).append((batch, len(held), size))
    for found in last.values():  # only the last batch of a bucket is not full
        assert all(n == size for _, n, size in sorted(found)[:-1])


def test_packing_corners(spark):
    assert pack(empty(spark)).count() == 0
    packed = pack(awkward(spark), n_buckets=3, budget=100).collect()
    assert len(packed) == awkward(spark).count() and min(r["n_tokens"] for r in packed) == 0
