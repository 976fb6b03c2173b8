"""Token counts of whole texts under a public tokenizer, long texts by overlapping chunks that are spliced again.

A *stable boundary* is a place where an ASCII blank meets another character. The tokenizer drops white space and no rule of
its normaliser, its splitting pattern or its added tokens reaches across a blank, so tokens before and after such a place
never depend on each other. Hence

* a text of usual length is the sum of its blank-separated words. Signs that close a word after an ASCII letter or digit are
  counted by themselves, since the splitting pattern keeps the two apart. Each task encodes a word once, many words in one
  call, and remembers its count in a table of bounded size;
* a huge text is encoded in chunks that overlap. The token starts that both neighbours report in the overlap are compared;
  the chunks are spliced at the first stable boundary at which both report a token and agree from there on. If there is
  none, the overlap is doubled, at last up to the whole text, so the count is always that of the whole text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from fileguard.llm.common import buffer, documents, lowered, pieces, record, words

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10
REMEMBERED_WORDS = 1 << 20
#: Bytes of text whose words are told apart at once.
PIECE = 1 << 22
#: Words encoded by one call.
TOGETHER = 64

#: Bytes that close a word, and bytes after which they are cut off.
CLOSING = np.isin(np.arange(256), [ord(c) for c in ",.;:!?)"])
PLAIN = np.array([chr(b).isalnum() and b < 128 for b in range(256)])

BLANKS = " \t\n\r\x0b\x0c"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, n_chunks int"

#: Encodes a text to the character offsets (start, end) of its tokens.
Encode = Callable[[str], list[tuple[int, int]]]


def stable_boundary(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at - 1] in BLANKS and text[at] not in BLANKS


def splice(text: str, left: list[int], right: list[int], start: int, end: int) -> int | None:
    """The place in [start, end) to cut at, or None: a stable boundary that is a token start of both, after which the token
    starts of both agree up to the last stable boundary of the overlap."""
    a, b = [x for x in left if start <= x < end], [x for x in right if start <= x < end]
    common = [x for x in set(a) & set(b) if stable_boundary(text, x)]
    if not common:
        return None
    cut, last = min(common), max(common)
    same = [x for x in a if cut <= x <= last] == [x for x in b if cut <= x <= last]
    return cut if same else None


def count_huge(text: str, encode: Encode, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[int, int]:
    """Tokens of ``text`` and chunks used. Only the token starts of two neighbouring chunks are held at a time."""

    def starts(a: int, b: int) -> list[int]:
        return [a + s for s, _ in encode(text[a:b])]

    if len(text) <= chunk + overlap:
        return len(encode(text)), 1
    total, used, begin = 0, 1, 0
    left_end = min(len(text), chunk + overlap)
    left = starts(0, left_end)
    while left_end < len(text):
        wide = overlap
        while True:
            # The next chunk begins before the end of this one by the overlap.
            right_begin = max(begin, left_end - wide)
            right_end = min(len(text), right_begin + chunk + 2 * wide)
            right = starts(right_begin, right_end)
            cut = splice(text, left, right, right_begin, left_end)
            if cut is not None and cut > begin:
                break
            if right_begin == begin:
                # The whole of this chunk overlaps already: take both as one chunk.
                left_end = right_end
                left, cut = right, None
                break
            wide *= 2
        if cut is None:
            if left_end == len(text):
                break
            chunk *= 2
            continue
        total += sum(begin <= x < cut for x in left)
        used += 1
        begin, left, left_end = cut, right, right_end
    return total + sum(x >= begin for x in left), used


class Counter:
    """Counts tokens with one library tokenizer; kept by a task between batches."""

    def __init__(self, path: str, chunk: int, overlap: int, remembered: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.chunk, self.overlap, self.remembered = Tokenizer.from_file(path), chunk, overlap, remembered
        self.lowers = '"Lowercase"' in json.dumps(json.loads(self.tokenizer.to_str())["normalizer"])
        self.known: dict[str, int] = {}

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return self.tokenizer.encode(text, add_special_tokens=False).offsets

    def learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > self.remembered:
            self.known = {}
        groups = [new[i : i + TOGETHER] for i in range(0, len(new), TOGETHER)]
        codes = self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
        for group, code in zip(groups, codes, strict=True):
            begin = np.cumsum([0, *(len(w) + 1 for w in group[:-1])])
            place = np.searchsorted(begin, [s for s, _ in code.offsets], side="right") - 1
            self.known.update(zip(group, np.bincount(place, minlength=len(group)).tolist(), strict=True))

    def codes(self, distinct: list[str]) -> np.ndarray:
        """Tokens of each of some distinct words."""
        if new := [w for w in distinct if w not in self.known]:
            self.learn(new)
            if len(self.known) < len(distinct):  # the table was emptied: words of this piece are needed once more
                self.learn([w for w in distinct if w not in self.known])
        return np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))

    def summed(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text as the sum over its blank-separated words. Words are told apart as Arrow strings, so Python sees
        a word once a piece."""
        raw, offsets = buffer(column)
        starts, ends, _ = words(raw, offsets)
        if not len(starts):
            return np.zeros(len(column), np.int64)
        closing = CLOSING[raw]
        last = np.maximum.accumulate(np.where(closing, -1, np.arange(len(raw))))[ends - 1] + 1
        split = last[(last > starts) & (last < ends) & PLAIN[raw[np.maximum(last, 1) - 1]]]
        starts = np.sort(np.r_[starts, split])
        first = np.searchsorted(starts, offsets)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        held = raw[~blank]
        places = np.r_[np.r_[0, np.cumsum(~blank)][starts], len(held)].astype(np.int64)
        if self.lowers:
            # A lowered word has the tokens of the word, unless it holds a special token's string.
            low = lowered(held)
            for w in np.unique(np.searchsorted(places, np.flatnonzero(held == ord("<")), side="right") - 1):
                low[places[w] : places[w + 1]] = held[places[w] : places[w + 1]]
            held = low
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(held)).dictionary_encode()
        sums = np.r_[0, np.cumsum(self.codes(found.dictionary.to_pylist())[found.indices.to_numpy()])]
        return sums[first[1:]] - sums[first[:-1]]

    def count(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and chunks of each text of a column."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        limit = self.chunk + self.overlap
        huge = np.asarray(pa.compute.greater(pa.compute.utf8_length(column), limit))
        tokens, chunks = np.zeros(len(column), np.int64), np.ones(len(column), np.int64)
        tokens[~huge] = self.summed(column.filter(pa.array(~huge)))
        for i in np.flatnonzero(huge):
            tokens[i], chunks[i] = count_huge(column[i].as_py(), self.offsets, self.chunk, self.overlap)
        return tokens, chunks


def token_counts(
    df: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    remembered: int = REMEMBERED_WORDS,
) -> DataFrame:
    """Bytes and tokens of every text, one row for each row of ``df``.

    ``tokenizer`` names a vocabulary file of the library ``tokenizers`` whose pattern drops white space and keeps letters and
    closing signs apart; it is looked up by name on each executor. ``chunk`` and ``overlap`` count characters, ``remembered`` words of a worker's table.
    Null and empty texts have no byte and no token; a null ``doc_id`` stays null; repeated rows are counted each by itself;
    an empty table gives an empty result; further columns are ignored.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers

        counter = Counter(public_tokenizers.path(tokenizer), chunk, overlap, remembered)
        for batch in batches:
            for piece in pieces(batch, size=PIECE):
                text = piece.column("text")
                tokens, chunks = counter.count(text)
                yield record(
                    SCHEMA,
                    doc_id=piece.column("doc_id"),
                    n_bytes=pa.array(np.diff(buffer(text)[1]), pa.int64()),
                    n_tokens=pa.array(tokens, pa.int64()),
                    n_chunks=pa.array(chunks, pa.int32()),
                )

    return documents(df).mapInArrow(counted, SCHEMA)
