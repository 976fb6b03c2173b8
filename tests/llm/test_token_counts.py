import random

import public_tokenizers
from tokenizers import Tokenizer

from fileguard.llm.token_counts import Counter, count_huge, splice, token_counts
from tests.llm.cases import ROWS, awkward, empty, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(texts):
    encoded = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    return [len(e) for e in encoded]


def test_every_row_is_counted_as_the_library_does(spark):
    texts = [t or "" for _, t in ROWS]
    expected = sorted(((d, len((t or "").encode()), n) for (d, t), n in zip(ROWS, whole(texts), strict=True)), key=repr)
    assert rows(token_counts(awkward(spark)), "doc_id", "n_bytes", "n_tokens") == expected
    # Small chunks and a word table that overflows change nothing.
    small = token_counts(awkward(spark), chunk=200, overlap=16, remembered=3)
    assert rows(small, "doc_id", "n_bytes", "n_tokens") == expected
    assert small.where("doc_id = 7").first()["n_chunks"] > 100


def test_spliced_counts():
    counter = Counter(PATH, 100, 10, 1000)
    rng = random.Random(5)
    texts = ["x" * 3000, " " * 3000, "é" * 999 + " b", "<|endoftext|>" * 200, "don't we'll " * 200, "1 2 3 " * 300]
    texts += ["".join(rng.choice(["a", "é", " ", "\n", "'s", "12", "!!", "<|startoftext|>", "漢", "́"]) for _ in range(2000)) for _ in range(20)]
    for text, n in zip(texts, whole(texts), strict=True):
        assert count_huge(text, counter.offsets, 100, 10)[0] == n


def test_splice_needs_a_blank():
    assert splice("abcdef", [0, 2, 4], [2, 4], 2, 6) is None
    assert splice("ab cd ef", [0, 3, 6], [3, 6], 2, 8) == 3
    assert splice("ab cd ef", [0, 3, 4, 6], [3, 6], 2, 8) is None


def test_empty(spark):
    assert token_counts(empty(spark)).count() == 0


def test_words_are_cut_and_lowered_without_another_count():
    counter = Counter(PATH, 1 << 16, 1 << 10, 50)
    rng = random.Random(9)
    signs = ["a", "B", "Hello", "WORLD", "İ", "Σ", "ß", "é", "é", ".́", ".", ",", ";:", "!?)", "'s", "'S", "'RE", "1", "42", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "<", "漢", "😀", " ", " ", "\n", " ", " ", "\x00", "-", "(", "\"", "ﬁ", "ͅ"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(6000)] + ["", " ", "."]
    import pyarrow as pa

    tokens, chunks = counter.count(pa.array(texts))
    assert tokens.tolist() == whole(texts) and set(chunks.tolist()) == {1}
