"""Benchmark passages in documents within a number of edits, by pieces that must stand unchanged and Myers' bit vectors.

A passage of m characters may differ by k = floor(m * rate) edits. Cut into k + 1 pieces, at least one piece of any match is
untouched, so the exact hits of the pieces name every place that can match. Hits come from one automaton over all pieces; the
text around them is verified by bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileguard.llm.common import documents, pieces, record

ERROR_RATE = 0.08
#: Characters of benchmark text that one automaton holds; a larger benchmark is worked off in several blocks.
BLOCK_CHARS = 1 << 20
SCHEMA = "doc_id long, item_id long, distance int, at long"


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def cut(text: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of nearly the same length, with their places. None is empty while k is less than the length."""
    n = k + 1
    edges = [len(text) * i // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance between the pattern of ``masks`` (length m) and a part of ``text``, and where it first ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, at = full, 0, m, m, 0
    for i, ch in enumerate(text):
        eq = masks.get(ch, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (~(xh | up) & full), up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up, down = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, at = score, i + 1
    return best, at


class Searcher:
    """Finds the passages of one block in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, self.automaton = [], ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            k = min(int(len(text) * rate), len(text) - 1)
            masks: dict[str, int] = {}
            for i, ch in enumerate(text):
                masks[ch] = masks.get(ch, 0) | 1 << i
            for at, piece in cut(text, k):
                owners.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, len(text), k, masks))
        for piece, places in owners.items():
            self.automaton.add_word(piece, (len(piece), places))
        if owners:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item_id, distance, where the match ends) for each passage in ``text``, its best match only."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for number, at in places:
                _, m, k, _ = self.items[number]
                begin = last + 1 - size - at
                windows.setdefault(number, []).append((max(0, begin - k), min(len(text), begin + m + k)))
        for number, spans in windows.items():
            item_id, m, k, masks = self.items[number]
            best, where, reach = m + 1, 0, -1
            for a, b in [*merged(spans)]:
                score, at = myers(masks, m, text[a:b])
                if score < best:
                    best, where = score, a + at
                reach = max(reach, b)
            if best <= k:
                yield item_id, best, where


def merged(spans: list[tuple[int, int]]) -> Iterable[tuple[int, int]]:
    """Spans that touch become one, so no character is verified twice for the same passage."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, size: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in blocks of about ``size`` characters, one block at a time on the driver; those without a
    character other than white space match nothing and are left out."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    block, held = [], 0
    for row in rows.distinct().orderBy("item_id", "text").toLocalIterator():
        if text := normalised(row["text"]):
            if block and held + len(text) > size:
                yield block
                block, held = [], 0
            block.append((row["item_id"], text))
            held += len(text)
    if block:
        yield block


def passages(df: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row (doc_id, item_id, distance, at) for each row of ``df`` (doc_id, text) and each benchmark item found in it. Case
    and runs of white space don't count; ``at`` is where the match ends in the normalised text."""
    found = None
    spark = df.sparkSession
    for block in blocks(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shared.value, rate)
            for batch in batches:
                for piece in pieces(batch):
                    ids = piece.column("doc_id").to_pylist()
                    hits = [
                        (ids[i], *hit)
                        for i, text in enumerate(piece.column("text").to_pylist())
                        for hit in searcher.find(normalised(text))
                    ]
                    if hits:
                        doc, item, distance, at = zip(*hits, strict=True)
                        yield record(
                            SCHEMA, doc_id=pa.array(doc, pa.int64()), item_id=pa.array(item, pa.int64()),
                            distance=pa.array(distance, pa.int32()), at=pa.array(at, pa.int64()),
                        )

        part = df.mapInArrow(searched, SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], SCHEMA)


def clean(df: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``df``, with all columns, in whose text no benchmark item stands. Each row is judged by itself, in place."""
    for block in blocks(benchmark, block_chars):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def kept(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shared.value, rate)
            for batch in batches:
                for piece in pieces(batch):
                    texts = piece.column("text").to_pylist()
                    yield piece.filter(pa.array([next(searcher.find(normalised(t or "")), None) is None for t in texts], pa.bool_()))

        df = df.mapInArrow(kept, df.schema)
    return df


def decontaminate(
    df: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row for each distinct doc_id: doc_id, n_items (benchmark items found), items (their ids, rising), item_id and
    distance of the closest one (ties: smallest id) and ``contaminated``.

    Null and empty texts and null or blank items match nothing; rows that share a doc_id are one document, with the items of
    all its rows; documents with a null doc_id are one group; an empty table gives an empty result and an empty benchmark
    leaves all documents clean. Further columns are ignored.
    """
    docs = documents(df)
    hits = passages(docs, benchmark, rate, block_chars)
    per_item = hits.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))
    every = docs.select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("int").alias("distance"))
    per_doc = every.unionByName(per_item.select("doc_id", "item_id", "distance")).groupBy("doc_id").agg(
        F.count("item_id").alias("n_items"),
        F.array_sort(F.collect_list("item_id")).alias("items"),
        F.min(F.when(F.col("item_id").isNotNull(), F.struct("distance", "item_id"))).alias("best"),
    )
    return per_doc.select(
        "doc_id", "n_items", "items", F.col("best.item_id").alias("item_id"), F.col("best.distance").alias("distance"),
        (F.col("n_items") > 0).alias("contaminated"),
    )

