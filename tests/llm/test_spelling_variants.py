"""Spelling variants against deletion neighbourhoods in plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fileguard.llm import spelling_variants as sv
from tests.llm.cases import awkward, documents, empty, rows


def counted(items, least_count=2, errors=31):
    n = Counter()
    for doc_id, text in items:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if mark % errors == 0:
                word = word[: mark % len(word)] + word[mark % len(word) + 1 :]
            n[word] += len(word) >= 7
    return {w: c for w, c in n.items() if c >= least_count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def neighbours(words):
    """Near words of each, by what stays when one place is taken out."""
    by = {}
    for w in words:
        for i in range(len(w)):
            by.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= by[w[:i], w[i + 1 :]] - {w}
            if (short := w[:i] + w[i + 1 :]) in near:
                near[w].add(short)
                near[short].add(w)
    return near


def expected(items, **how):
    n = counted(items, **how)
    near = neighbours(n)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_whole_table_against_deletion_neighbourhoods(spark):
    items = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    got = rows(sv.spelling_variants(documents(spark)), *COLUMNS)
    assert got == expected(items)
    assert any(r[4] for r in got)


def test_chains_of_forms_and_ties(spark):
    words = [("separate", 1000), ("seperate", 100), ("seperrate", 10), ("seperrat", 1), ("aaaaaaa", 20), ("aaaaaaaa", 20), ("aaaaaab", 2), ("ÀÉéüöäß", 30), ("ÀÉéüöäs", 3)]
    items = [(None, (w + " ") * n) for w, n in words]
    got = rows(sv.spelling_variants(spark.createDataFrame(items, "doc_id long, text string"), least_count=1), *COLUMNS)
    assert got == expected(items, least_count=1)
    found = {r[0]: r[2] for r in got}
    assert sum(v == "separate" for v in found.values()) >= 3


def test_awkward_and_long_words(spark):
    rng = random.Random(3)
    long_word = "".join(rng.choice("abcdefgh") for _ in range(3000))
    items = [(1, long_word), (2, long_word[:1500] + "z" + long_word[1501:]), (3, long_word[:-1]), (4, "x" + long_word), (5, None), (None, ""), (6, "y" * 100_000)]
    df = spark.createDataFrame(items, "doc_id long, text string")
    assert rows(sv.spelling_variants(df, least_count=1), *COLUMNS) == expected(items, least_count=1)
    assert rows(sv.spelling_variants(empty(spark))) == []
    from tests.llm.cases import ROWS

    assert rows(sv.spelling_variants(awkward(spark)), *COLUMNS) == expected(ROWS)


@pytest.mark.parametrize("tile", [4, 128])
def test_tiles_find_every_single_edit(tile, monkeypatch):
    """Blocks far larger than a tile, words that differ in a narrow zone only."""
    monkeypatch.setattr(sv, "TILE", tile)
    monkeypatch.setattr(sv.tiles, "__defaults__", (tile,))
    rng = random.Random(tile)
    words = sorted({"pre" + "".join(rng.choice("abÿ") for _ in range(rng.choice([2, 3, 4]))) + "post" for _ in range(200)})
    near = neighbours(words)
    assert all(near[a] == {b for b in words if one_edit(a, b)} for a in words)
    for size in range(9, 13):
        k = int(sv.zones(size))
        members = [w for w in words if len(w) in (size, size - 1)]
        table = []
        for zone in range(k):
            start, after = zone * size // k, size - (zone + 1) * size // k
            groups = {}
            for w in members:
                groups.setdefault((w[:start], w[len(w) - after :]), []).append(w)
            table += [(hash(key), size, zone, w, words.index(w) + 1) for key, ws in groups.items() for w in sorted(ws)]
        got = Counter()
        names = ["block", "size", "zone", "word", "n"]
        out = sv.compared(pa.Table.from_arrays([pa.array(c) for c in zip(*sorted(table), strict=True)], names=names))
        for w, n, form_n, form in zip(*(out.column(c).to_pylist() for c in out.schema.names), strict=True):
            got[w] += n
            assert form in near[w] and form_n == words.index(form) + 1
        want = {w: len([x for x in near[w] if max(len(x), len(w)) == size]) for w in members}
        assert got == {w: n for w, n in want.items() if n}


def test_codes_are_code_points():
    words = ["abc", "", "ÀÿÉ", "a×z÷"]
    points, offsets = sv.codes(pa.array(words))
    assert ["".join(map(chr, points[a:b])) for a, b in zip(offsets, offsets[1:], strict=False)] == words
    left, right = sv.matrices(points, offsets, 5)
    assert left[2].tolist() == [0xC0, 0xFF, 0xC9, 0, 0] and np.array_equal(right[0], [0, 0, 97, 98, 99])
