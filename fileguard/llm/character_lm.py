"""Cross-entropy difference of two character n-gram models that grow with the corpus and stay Spark tables.

Tokens are characters (code points) as they are; the vocabulary is every character of the corpus and serves both models. An
n-gram is kept as its characters, three bytes each, so nothing is hashed, cut off or merged. Both models are smoothed alike
(Witten-Bell, interpolated down to the uniform distribution over the vocabulary). Counts, totals and losses of n-grams are
tables that are joined; none goes to the driver and none is broadcast as a whole.

Documents are dealt into blocks of bounded size. A block asks once for each of its distinct n-grams, however many of its
documents hold it, so a very common n-gram has one row for each block; the losses are dealt back to the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fileguard.llm.common import buffer, documents, forget, pieces, record, stored

ORDER = 5
#: Bytes of text in a block. A longer document is cut into slices of a block each, at most.
BLOCK_BYTES = 8 << 20
#: Stands before each text; no character has this number.
BEFORE = 0x110000
#: Bytes of a character inside an n-gram.
WIDTH = 3

SCORES = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"
SUMS = "row long, doc_id long, n_tokens long, target double, background double"
BLOCKS = "block long, row long, doc_id long, lead string, text string, marked boolean"
COUNTS = "gram binary, target long, background long"
ASKED = "block long, gram binary"


def characters(texts: list[str], leads: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts, the places of the texts' own ones, and lengths of texts. Ahead of each text stand the order - 1
    characters of ``leads`` for a slice that goes on, or else so many BEFORE."""
    gap = "\0" * (order - 1)
    points = np.frombuffer("".join(x for lead, t in zip(leads, texts, strict=True) for x in (lead or gap, t)).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    kind = np.int32 if len(points) < 1 << 31 else np.int64
    ends = np.arange(sizes.sum(), dtype=kind) + np.repeat(np.arange(1, len(texts) + 1, dtype=kind) * kind(len(gap)), sizes)
    out = np.full(len(points), BEFORE, np.uint32)
    out[ends] = points[ends]
    begins = np.r_[0, np.cumsum(sizes + len(gap))][:-1]
    for i in np.flatnonzero([bool(x) for x in leads]):
        out[begins[i] : begins[i] + len(gap)] = points[begins[i] : begins[i] + len(gap)]
    return out, ends, sizes


def distinct(points: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the number of its n-gram, and the distinct n-grams (n-grams x bytes)."""
    own = pd.factorize(points)[0].astype(np.int32)
    bits = max(1, int(own.max(initial=0)).bit_length())
    code, used = own[ends].astype(np.int64), bits
    for back in range(1, order):
        if used + bits > 62:
            code = pd.factorize(code)[0].astype(np.int64)
            used = len(code).bit_length()
        earlier = own[ends - back].astype(np.int64)
        earlier <<= used
        code |= earlier
        used += bits
    earlier = own = None
    of, kinds = pd.factorize(code)
    place = np.empty(len(kinds), np.int64)
    place[of] = ends
    grams = points[place[:, None] - np.arange(order - 1, -1, -1)].astype(">u4")
    return of, np.ascontiguousarray(grams.view(np.uint8).reshape(len(kinds), order, 4)[:, :, 4 - WIDTH :]).reshape(len(kinds), order * WIDTH)


def binary(grams: np.ndarray) -> pa.Array:
    n, width = grams.shape
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(grams)])


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that follow each other with one block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            if held and held[0].column("block")[0].as_py() != block[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def dealt(docs: DataFrame, block_bytes: int, order: int) -> DataFrame:
    """``docs`` (doc_id, text, marked) with ``row`` (one for each document), ``block`` and ``lead``. A document above a block is cut
    into slices; each begins with the last order - 1 characters before it as its lead."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        block, held = row, 0

        def rows(of: pa.RecordBatch, ids: np.ndarray, lead: list[str], text: pa.Array) -> pa.RecordBatch:
            return record(
                BLOCKS, block=pa.array(np.full(of.num_rows, block)), row=pa.array(ids), doc_id=of.column("doc_id"),
                lead=pa.array(lead, pa.string()), text=text, marked=of.column("marked"),
            )

        for batch in batches:
            for piece in pieces(batch, size=min(block_bytes, 1 << 20)):
                size = len(buffer(piece.column("text"))[0])
                if size > block_bytes and piece.num_rows == 1:
                    text, step = piece.column("text")[0].as_py(), max(order, block_bytes // 4)
                    for at in range(0, len(text), step):
                        block, held = block + 1, block_bytes
                        yield rows(piece, np.array([row]), [text[at - order + 1 : at] if at else ""], pa.array([text[at : at + step]]))
                    row += 1
                    continue
                if held and held + size > block_bytes:
                    block, held = block + 1, 0
                held += size
                yield rows(piece, np.arange(row, row + piece.num_rows), [""] * piece.num_rows, piece.column("text"))
                row += piece.num_rows

    return docs.mapInArrow(numbers, BLOCKS)


def losses(counts: DataFrame, order: int) -> DataFrame:
    """(gram, target, background): -log2 of the interpolated probability of the last character of each n-gram of ``counts``
    (gram, target, background) after the others, under either model."""
    models = ("target", "background")
    levels = [counts]
    for n in range(order - 1, 0, -1):
        last = F.substring("gram", 1 + WIDTH, WIDTH * n)
        levels.insert(0, levels[0].groupBy(last.alias("gram")).agg(*(F.sum(m).alias(m) for m in models)))
        levels[0] = stored(levels[0], f"lm-counts-{n}", "zstd")
    below = levels[0].select(
        F.col("gram").alias("lower"), *(F.lit(1.0 / max(1, levels[0].count())).alias(f"p_{m}") for m in models)
    )
    for n, level in enumerate(levels, 1):
        sums = [f(m) for m in models for f in (
            lambda m: F.sum(m).alias(f"total_{m}"), lambda m: F.count_if(F.col(m) > 0).alias(f"kinds_{m}"))]
        history = F.substring("gram", 1, WIDTH * (n - 1))
        if n == 1:
            level = level.withColumn("lower", F.col("gram")).crossJoin(level.agg(*sums))
        else:
            level = level.withColumns({"history": history, "lower": F.substring("gram", 1 + WIDTH, WIDTH * (n - 1))})
            along = Window.partitionBy("history")
            level = level.withColumns({
                f"total_{m}": F.sum(m).over(along) for m in models
            } | {f"kinds_{m}": F.sum((F.col(m) > 0).cast("long")).over(along) for m in models})
        level = level.join(below, "lower")

        def here(m: str):
            total, kinds, p = F.col(f"total_{m}"), F.col(f"kinds_{m}"), F.col(f"p_{m}")
            return F.when(total > 0, (F.col(m) + kinds * p) / (total + kinds)).otherwise(p)

        name = "gram" if n == order else "lower"
        below = stored(level.select(F.col("gram").alias(name), *(here(m).alias(f"p_{m}") for m in models)), f"lm-model-{n}", "zstd")
    return below.select("gram", *((-F.log2(f"p_{m}")).cast("float").alias(m) for m in models))


def character_difference(df: DataFrame, target: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens (characters), loss_target, loss_background (mean bits a token) and score for every row of ``df``.

    ``target`` has the doc_id of the texts that the target model is counted over, the background is counted over all others;
    ids that repeat, are null or have no text change nothing. Null and empty texts have no token and null losses; rows that
    share a doc_id are scored each by itself; a null doc_id stays null and is never target; an empty table gives an empty
    result; without target texts that model is uniform. Further columns are ignored. To the driver goes the number of
    different characters.
    """
    if order < 2:
        raise ValueError("order must be 2 at least")
    spark = df.sparkSession
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    # The ids grow with the corpus, so they are never broadcast.
    marked = documents(df).join(ids.withColumn("marked", F.lit(True)).hint("merge"), "doc_id", "left").select(
        "doc_id", "text", F.coalesce("marked", F.lit(False)).alias("marked")
    )
    blocks = stored(dealt(marked, block_bytes, order), "lm-blocks", "zstd")
    forget(spark)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_blocks(batches):
            points, ends, sizes = characters(block.column("text").to_pylist(), block.column("lead").to_pylist(), order)
            of, grams = distinct(points, ends, order)
            good = np.repeat(block.column("marked").to_numpy().astype(bool), sizes)
            n = np.bincount(of, minlength=len(grams))
            some = np.bincount(of[good], minlength=len(grams))
            yield record(COUNTS, gram=binary(grams), target=pa.array(some), background=pa.array(n - some))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_blocks(batches):
            points, ends, _ = characters(block.column("text").to_pylist(), block.column("lead").to_pylist(), order)
            # Neighbours in order share their first characters, so the shuffle files are smaller.
            grams = np.sort(distinct(points, ends, order)[1].view(f"S{order * WIDTH}").ravel())
            grams = grams.view(np.uint8).reshape(len(grams), order * WIDTH)
            yield record(ASKED, block=pa.array(np.full(len(grams), block.column("block")[0].as_py(), np.int64)), gram=binary(grams))

    def scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
        points, ends, sizes = characters(docs.column("text").to_pylist(), docs.column("lead").to_pylist(), order)
        of, grams = distinct(points, ends, order)
        kind = f"S{order * WIDTH}"
        known = buffer(answers.column("gram"))[0].view(kind)
        by = np.argsort(known)
        at = np.searchsorted(known, grams.view(kind).ravel(), sorter=by) if len(known) else np.zeros(len(grams), np.int64)
        at = by[np.minimum(at, len(by) - 1)] if len(grams) else at
        if len(grams) and (known[at] != grams.view(kind).ravel()).any():
            raise ValueError("an n-gram of a block has no loss")
        some, first = sizes > 0, np.r_[0, np.cumsum(sizes)[:-1]]
        sums = []
        for model in ("target", "background"):
            loss = answers.column(model).to_numpy().astype(np.float64)[at][of]
            total = np.zeros(len(sizes))
            if len(loss):
                total[some] = np.add.reduceat(loss, first[some])
            sums.append(total)
        return pa.Table.from_batches([record(
            SUMS, row=docs.column("row").combine_chunks(), doc_id=docs.column("doc_id").combine_chunks(), n_tokens=pa.array(sizes),
            target=pa.array(sums[0]), background=pa.array(sums[1]),
        )])

    texts = blocks.select("block", "lead", "text", "marked")
    counts = texts.mapInArrow(counted, COUNTS).groupBy("gram").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    table = losses(stored(counts, f"lm-counts-{order}", "zstd"), order)
    forget(spark)
    answers = texts.mapInArrow(asked, ASKED).join(table.hint("merge"), "gram").select("block", "gram", "target", "background")
    parts = blocks.select("block", "row", "doc_id", "lead", "text").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, SUMS)
    # Slices of one document are added up; all others are a row already.
    sums = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "target", "background")))
    mean = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens"))
    return sums.select(
        "doc_id", "n_tokens", mean("target").alias("loss_target"), mean("background").alias("loss_background"),
        (mean("target") - mean("background")).alias("score"),
    )
