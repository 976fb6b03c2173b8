"""Words that differ by one edit, grouped around their commonest spelling, by dense prefix-suffix tiles.

Two words are near if one code point is inserted, deleted or replaced: common prefix plus common suffix is at least the longer
length minus one. The place of the edit lies in one of the zones that the longer length is cut into; what stands before and
after that zone is equal in both. So each word asks in one block for every zone (length, zone, text before, text after), and
near words meet in the block of the zone their edit lies in. Inside a block words are rows of padded code-point matrices, one
flushed left and one flushed right, and whole tiles of rows are compared at once, column by column.

A zone is two code points wide up to words of 64, so a block holds no more words than two code points have values. What leaves
a tile is one row for each word with a near one, already counted, so no pair is ever written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileguard.llm.common import buffer, documents, stored

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form is at least so many times as common as the word it stands for.
TIMES = 10
WIDTH = 2
MOST_ZONES = 32
#: One in so many (document, word) pairs gets a planted typing error.
ERRORS = 31
#: Rows of a tile; rows of a task's buffer.
TILE = 128
BUFFER_ROWS = 1 << 16
#: Cells of the tiles compared at once, and code points of a buffer's matrices.
CELLS = 1 << 21
BUFFER_CODES = 1 << 24

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TILED = "word string, n_near long, form_n long, form string"


def with_errors(doc_id: Column, word: Column, errors: int = ERRORS) -> Column:
    """The word without the code point that the checksum of document and word names, for one pair in ``errors``."""
    mark = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (mark % F.length(word)).cast("int")
    return F.when(mark % errors == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def word_counts(df: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, errors: int = ERRORS) -> DataFrame:
    """word and n: runs of Latin letters of at least ``least_length`` code points, A-Z lowered, counted over all texts.

    A run that is too short before an error is planted is too short after it as well, so only long runs are taken out.
    """
    runs = F.regexp_extract_all("text", F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{least_length},}})"), F.lit(1))
    taken = documents(df).select("doc_id", F.explode(runs).alias("run"))
    # translate() walks a map; a run of ASCII letters alone is lowered at once.
    low = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    words = taken.select("doc_id", low.alias("run")).select(with_errors(F.col("doc_id"), F.col("run"), errors).alias("word"))
    counts = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


def zones(n: int | np.ndarray) -> int | np.ndarray:
    """How many zones a word of ``n`` code points is cut into; zone z begins at z * n // zones."""
    return np.clip(-(-n // WIDTH), 1, MOST_ZONES)


def asked(words: DataFrame) -> DataFrame:
    """block, size (longer length), zone, word and n: a row for each block that a word asks in, as the longer or the shorter."""
    length = F.length("word")
    sized = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("size"))
    k = F.least(F.lit(MOST_ZONES), F.ceil(F.col("size") / F.lit(WIDTH))).cast("int")
    cut = sized.withColumn("k", k).select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("zone"))
    start = F.floor(F.col("zone") * F.col("size") / F.col("k")).cast("int")
    after = F.col("size") - F.floor((F.col("zone") + 1) * F.col("size") / F.col("k")).cast("int")
    # A suffix of no code points would be the whole word in substring().
    tail = F.when(after > 0, F.substring("word", length - after + 1, after)).otherwise("")
    key = F.xxhash64("size", "zone", F.substring("word", F.lit(1), start), F.lit("\0"), tail)
    return cut.select(key.alias("block"), "size", "zone", "word", "n")


def codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (all below 256) of the words one after the other, and the offsets (n + 1) of the words."""
    raw, offsets = buffer(column)
    lead = raw == 0xC3
    out = raw.copy()
    out[1:][lead[:-1]] += 0x40
    kept = np.r_[0, np.cumsum(~lead)]
    return out[~lead], kept[offsets]


def matrices(points: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The words as rows of ``width`` code points, flushed left and flushed right, 0 elsewhere."""
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(points)) - np.repeat(offsets[:-1], lengths)
    left = np.zeros((len(lengths), width), np.uint8)
    right = np.zeros((len(lengths), width), np.uint8)
    left[row, place] = points
    right[row, place + width - np.repeat(lengths, lengths)] = points
    return left, right


def common(matrix: np.ndarray, a: np.ndarray, b: np.ndarray, columns: Iterator[int]) -> np.ndarray:
    """Equal columns, in the order given, until the first that differs: for all rows of tiles ``a`` (g, s) against ``b`` (g, t).
    Row -1 is the last one and equals nothing that is asked for later."""
    going = np.ones((len(a), a.shape[1], b.shape[1]), bool)
    total = np.zeros(going.shape, np.int32 if matrix.shape[1] > 255 else np.uint8)
    for c in columns:
        column = matrix[:, c]
        # Padding of both sides counts as equal; the lengths correct it.
        going &= column[a][:, :, None] == column[b][:, None, :]
        total += going
        if not going.any():
            break
    return total


def near_cells(left: np.ndarray, right: np.ndarray, length: np.ndarray, size: np.ndarray, zone: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which cells (row of ``a``, row of ``b``) of each tile are near words whose edit lies in the tile's zone.

    ``size`` and ``zone`` (g) are those of the tiles; index -1 stands for no row. Equal rows are no pair.
    """
    width = left.shape[1]
    n = size[:, None, None].astype(np.int32)
    prefix = common(left, a, b, range(width)).astype(np.int32)
    suffix = common(right, a, b, range(width - 1, -1, -1)).astype(np.int32)
    la, lb = length[a][:, :, None], length[b][:, None, :]
    there = (a >= 0)[:, :, None] & (b >= 0)[:, None, :] & (np.maximum(la, lb) == n)
    # Both flushed left: padding follows the shorter word, so a common prefix never passes the shorter length unless both end.
    short = np.minimum(la, lb)
    prefix, suffix = np.minimum(prefix, short), np.minimum(suffix, short)
    at = np.minimum(prefix, n - 1)
    k = zones(n)
    z = zone[:, None, None]
    inside = (at >= z * n // k) & (at < (z + 1) * n // k)
    equal = (la == lb) & (prefix == la)
    return there & inside & ~equal & (prefix + suffix >= n - 1)


def tiles(first: np.ndarray, count: np.ndarray, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(block number, rows of side a, rows of side b) of tiles: blocks of up to ``tile`` rows against themselves, many of about
    the same size at once; a larger block as all pairs of its parts of ``tile`` rows. Missing rows are -1."""
    size = 2
    while size <= tile:
        picked = np.flatnonzero((count > size // 2) & (count <= size) & (count > 1))
        step = max(1, CELLS // (size * size))
        for at in range(0, len(picked), step):
            some = picked[at : at + step]
            rows = first[some][:, None] + np.arange(size)
            rows[np.arange(size) >= count[some][:, None]] = -1
            yield some, rows, rows
        size *= 2
    for block in np.flatnonzero(count > tile):
        parts = [np.arange(s, min(s + tile, count[block])) + first[block] for s in range(0, count[block], tile)]
        for i, a in enumerate(parts):
            for b in parts[i:]:
                yield np.array([block]), a[None], b[None]


class Best:
    """Number of near words of each row, and the row of the commonest of them (the first of equals: rows rise with the word)."""

    def __init__(self, n: np.ndarray):
        self.n, self.near, self.count, self.row = n, np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)

    def add(self, rows: np.ndarray, others: np.ndarray, near: np.ndarray) -> None:
        hits = near.sum(axis=2)
        found = hits > 0
        if not found.any():
            return
        g, r = np.nonzero(found)
        mask = near[g, r]
        counts = np.where(mask, self.n[others[g]], -1)
        pick = counts.argmax(axis=1)
        most, row, other = counts[np.arange(len(g)), pick], rows[g, r], others[g, pick]
        self.near[row] += hits[g, r]
        better = (most > self.count[row]) | ((most == self.count[row]) & (other < self.row[row]))
        self.count[row[better]], self.row[row[better]] = most[better], other[better]


def blocks(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of each run of equal (block, size, zone)."""
    names = [table.column(c).to_numpy() for c in ("block", "size", "zone")]
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for c in names:
        change[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(change)
    return first, np.diff(np.r_[first, table.num_rows])


def compared(table: pa.Table) -> pa.RecordBatch:
    """Near words inside the blocks of a sorted table, counted by word and block."""
    first, count = blocks(table)
    size = table.column("size").to_numpy()[first]
    zone = table.column("zone").to_numpy()[first]
    n = table.column("n").to_numpy()
    best = Best(n)
    points, offsets = codes(table.column("word").combine_chunks())
    length = np.diff(offsets).astype(np.int32)
    # Blocks of like length share a matrix; a block alone never needs more than its own rows.
    width_class = np.maximum(4, np.ceil(np.log2(np.maximum(size, 2)))).astype(int)
    for c in np.unique(width_class[count > 1]):
        members = np.flatnonzero((width_class == c) & (count > 1))
        rows = np.concatenate([np.arange(first[m], first[m] + count[m]) for m in members]) if len(members) else np.zeros(0, np.int64)
        starts = np.r_[0, np.cumsum(count[members])][:-1]
        width = int(size[members].max())
        cut = np.r_[0, np.cumsum(length[rows])]
        taken = np.repeat(offsets[rows] - cut[:-1], length[rows]) + np.arange(cut[-1])
        left, right = matrices(points[taken], cut, width)
        for which, a, b in tiles(starts, count[members]):
            near = near_cells(left, right, length[rows], size[members[which]], zone[members[which]], a, b)
            best.add(np.where(a >= 0, rows[a], -1), np.where(b >= 0, rows[b], -1), near)
            if a is not b and not np.array_equal(a, b):
                best.add(rows[b], rows[a], near.transpose(0, 2, 1))
    hit = np.flatnonzero(best.near)
    word = table.column("word").combine_chunks()
    return pa.RecordBatch.from_arrays(
        [word.take(pa.array(hit)), pa.array(best.near[hit]), pa.array(best.count[hit]), word.take(pa.array(best.row[hit]))],
        names=["word", "n_near", "form_n", "form"],
    )


def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles over the sorted rows of a partition; a buffer ends where a block ends."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        size += batch.column("word").nbytes
        if rows < BUFFER_ROWS and size < BUFFER_CODES:
            continue
        table = pa.Table.from_batches(held)
        first, _ = blocks(table)
        if len(first) > 1:
            yield compared(table.slice(0, first[-1]))
            held = table.slice(first[-1]).to_batches()
            rows, size = sum(b.num_rows for b in held), sum(b.column("word").nbytes for b in held)
    if rows:
        yield compared(pa.Table.from_batches(held))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form_n and form (the commonest near word, the smallest of equals) for words (word, n) with a near one."""
    found = asked(words).repartition("block").sortWithinPartitions("block", "size", "zone", "word").mapInArrow(tiled, TILED)
    # Struct order: most common first, then the smallest word.
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(links: DataFrame, most: int, times: int = TIMES) -> DataFrame:
    """word and root for links (word, form): forms followed to the last by doubling the step.

    Counts rise at least ``times`` fold with each link, so a chain has at most log(most) links and the number of rounds is known.
    """
    reach = 1
    steps = links.select("word", F.col("form").alias("root"))
    longest = 0
    while times ** (longest + 1) <= max(most, 1):
        longest += 1
    while reach < longest:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("farther"))
        steps = stored(steps.join(on, "root", "left").select("word", F.coalesce("farther", "root").alias("root")), "spelling-steps")
        reach *= 2
    return steps


def spelling_variants(
    df: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, errors: int = ERRORS
) -> DataFrame:
    """word, form, root, n, n_near and form_n for every counted word of a table of documents.

    Words, their planted errors and nearness are defined above. ``form`` is the commonest near word (ties: the smallest) if it
    is at least ``times`` times as common, else null, and ``form_n`` its count; ``root`` is where the forms lead, the word itself
    without one. Null and empty texts have no word; a null ``doc_id`` counts as an empty one in the checksum; repeated rows count
    again; a text or a word may have any length (a word beyond 64 code points is cut into 32 zones; its block is worked off
    tile by tile); an empty table gives an empty result; further columns are ignored.
    """
    words = stored(word_counts(df, least_length, least_count, errors), "spelling-words")
    near = near_words(words)
    joined = words.join(near, "word", "left").withColumn("has", F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False)))
    joined = stored(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("has"), F.col("form")).alias("form"), F.when(F.col("has"), F.col("form_n")).alias("form_n"),
        ),
        "spelling-near",
    )
    most = words.agg(F.max("n")).first()[0] or 0
    ends = roots(joined.where("form is not null"), most, times)
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
