"""Removal of every byte string of a minimum length that stands earlier in the corpus, by bounded Burrows-Wheeler search.

Windows of ``length`` bytes are dealt out by content: each belongs to the least k-gram in it (a *minimizer*), so equal windows
share it, and neighbouring windows with one minimizer form a *segment*. Steps, all linear in the input:

1. Minimizers that occur once cannot lie in a repeated window; their segments go no further.
2. Equal segments become one class; all but its first member are repeats from end to end.
3. Segments of different text with one minimizer meet in one task. There a Burrows-Wheeler transform is searched breadth
   first: intervals of one more character to the left give the common prefixes by rising value, and the search stops at
   the minimum length. Suffixes that are still undivided begin with equal windows; all but the first are repeats.
4. A minimizer with very many different segments would fill a task. Its windows are compared one by one, by 128-bit hashes
   that Spark groups with partial aggregation.
5. The removed runs go back to their documents by a join on the document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileguard.llm.common import BASES, buffer, documents, forget, numbered, pieces, record, span_hashes, stored

LENGTH = 100
#: Bytes of a minimizer, at least eight less than the window.
GRAM = 32
#: Different segments of one minimizer that one task compares by suffix order (2.7 MB of them); beyond, windows go one by one.
GROUP = 1 << 14
#: Bytes of segments that are ordered together.
ORDERED_BYTES = 1 << 20
#: Bytes of one document that are looked at at once; slices overlap by a window.
SLICE_BYTES = 1 << 23
PLACE_BITS = 24
SEPARATOR = 255  # does not occur in UTF-8

SEGMENTS = "key long, content long, row long, start int, windows int"
RUNS = "row long, start int, end int"


def minimizer_runs(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(keys, first window, end of windows) of the segments of the rows in ``raw``; no window reaches into another row."""
    n = len(raw) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none, none
    at = np.arange(len(raw) - gram + 1)
    hashes = span_hashes(raw, at, at + gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (hashes & ~low) | at.astype(np.uint64)
    width, step = length - gram + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[:n], least[width - step : width - step + n])
    place = (least & low).astype(np.int64)
    valid = np.ones(n + 1, bool)
    for edge in np.unique(offsets[1:-1]):
        valid[max(0, edge - length + 1) : edge] = False
    valid[n] = False
    change = np.r_[True, place[1:] != place[:-1]] | np.r_[True, valid[1:n] != valid[: n - 1]]
    # A window that begins a row begins a segment.
    inner = offsets[1:-1]
    change[inner[inner < n]] = True
    first = np.flatnonzero(change)
    end = np.r_[first[1:], n]
    good = valid[first]
    first, end = first[good], end[good]
    return hashes[place[first]], first, end


def slices(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row ids, places of the first byte in the row) of parts of a batch."""
    for piece in pieces(batch):
        raw, offsets = buffer(piece.column("text"))
        rows = piece.column("row").to_numpy(zero_copy_only=False)
        if len(raw) <= SLICE_BYTES:
            yield raw, offsets, rows, np.zeros(len(rows), np.int64)
            continue
        for i, row in enumerate(rows):  # one long text, perhaps with short ones
            for a in range(offsets[i], max(offsets[i] + 1, offsets[i + 1] - length + 1), SLICE_BYTES):
                b = min(a + SLICE_BYTES + length - 1, offsets[i + 1])
                yield raw[a:b], np.array([0, b - a]), np.array([row]), np.array([a - offsets[i]])


def segments(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(keys, contents, rows, starts, windows, again); ``again`` marks a segment that its own slice has had before."""
    for raw, offsets, rows, places in slices(batch, length):
        keys, first, end = minimizer_runs(raw, offsets, length, gram)
        contents = span_hashes(raw, first, end + length - 1, BASES[1])
        owner = np.searchsorted(offsets, first, side="right") - 1
        again = np.ones(len(keys), bool)
        if len(keys):
            order = np.lexsort((first, contents, keys, owner))
            new = np.ones(len(keys), bool)
            k, c, o = keys[order], contents[order], owner[order]
            new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (o[1:] != o[:-1])
            again[order[new]] = False
        yield keys, contents, rows[owner], first - offsets[owner] + places[owner], end - first, again


def bounded_order(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` ordered by at least ``length`` + 1 first bytes, and the keys of their first eight bytes in order."""
    n = len(text)
    padded = np.r_[text, np.full(8, SEPARATOR, np.uint8)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(key)
    heads = key[order]
    depth, key = 8, None
    new = np.r_[True, heads[1:] != heads[:-1]]
    while True:
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        if depth > length or new.all():
            return order, heads
        later = np.zeros(n, np.uint64)
        later[: max(0, n - depth)] = rank[depth:]
        key = (rank << np.uint64(32)) | later
        order = np.argsort(key)
        sorted_keys = key[order]
        new = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
        depth *= 2


def common_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The bounded suffix order and, for each place in it, the common prefix with the one before if below ``length``, else -1.

    Breadth-first backward extension: an interval holds the suffixes with one prefix w; the characters before them split it
    into the intervals of cw. If the place after such an interval has no value yet, its value is the length of w. Values up
    to seven come from the first eight bytes, which the order has compared already.
    """
    n = len(text)
    order, heads = bounded_order(text, length)
    value = np.full(n + 1, -1, np.int32)
    value[0] = value[n] = 0
    differ = heads[1:] ^ heads[:-1]
    at = np.flatnonzero(differ) + 1
    # Equal leading bytes: the exponent of a double tells the highest bit, the top half alone where it is not zero.
    high, low = (differ[at - 1] >> np.uint64(32)).astype(np.float64), (differ[at - 1] & np.uint64(0xFFFFFFFF)).astype(np.float64)
    bits = np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])
    value[at] = (64 - bits) // 8
    before = text[order - 1]
    step = np.empty(n, np.int64)
    step[np.argsort(before, kind="stable")] = np.arange(n)
    edges = np.r_[0, at, n]
    left, right = edges[:-1], edges[1:] - 1
    due = (value[right + 1] == 7) & (right + 1 < n)
    left, right = left[due], right[due]
    depth = 8
    while len(left) and depth < length:
        sizes = right - left + 1
        owner = np.repeat(np.arange(len(left)), sizes)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + left[owner]
        to, char = step[inside], before[inside]
        by = np.argsort(to)
        to, char, owner = to[by], char[by], owner[by]
        head = np.r_[True, (to[1:] != to[:-1] + 1) | (char[1:] != char[:-1]) | (owner[1:] != owner[:-1])]
        begins = np.flatnonzero(head)
        left, right = to[begins], to[np.r_[begins[1:], len(to)] - 1]
        fresh = value[right + 1] == -1
        left, right = left[fresh], right[fresh]
        value[right + 1] = depth
        depth += 1
    return order, value[:n]


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, ordered from early to late, which of its windows stand earlier, in the part or one before."""
    lengths = np.array([len(p) for p in parts])
    text = np.frombuffer(bytes([SEPARATOR]).join(parts) + bytes([SEPARATOR]), np.uint8)
    begins = np.cumsum(lengths + 1) - lengths - 1
    order, value = common_prefixes(text, length)
    window = np.zeros(len(text), bool)
    for b, n in zip(begins, lengths, strict=True):
        window[b : b + n - length + 1] = True
    held = window[order]
    group = np.cumsum(value >= 0)[held]
    place = order[held]
    later = np.zeros(len(text), bool)
    if len(place):
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        firsts = np.minimum.reduceat(place, heads)
        later[place] = place != np.repeat(firsts, np.diff(np.r_[heads, len(place)]))
    return [later[b : b + n - length + 1] for b, n in zip(begins, lengths, strict=True)]


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def run_batch(rows: list | np.ndarray, starts: list | np.ndarray, ends: list | np.ndarray) -> pa.RecordBatch:
    return record(
        RUNS, row=pa.array(np.asarray(rows, np.int64)), start=pa.array(np.asarray(starts, np.int32)),
        end=pa.array(np.asarray(ends, np.int32)),
    )


def compared(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, row, start, segment) in the order of their keys, to runs of bytes that stand earlier."""
    held: list[tuple[int, int, bytes]] = []
    size, last = 0, None

    def settle() -> pa.RecordBatch:
        held.sort(key=lambda x: x[:2])
        rows, starts, ends = [], [], []
        for (row, start, _), flags in zip(held, repeated_windows([x[2] for x in held], length), strict=True):
            for a, b in zip(*runs_of(flags), strict=True):
                rows.append(row)
                starts.append(start + a)
                ends.append(start + b - 1 + length)
        held.clear()
        return run_batch(rows, starts, ends)

    for batch in batches:
        keys, rows, starts = (batch.column(c).to_pylist() for c in ("key", "row", "start"))
        for key, row, start, part in zip(keys, rows, starts, batch.column("segment").to_pylist(), strict=True):
            if key != last and size >= ORDERED_BYTES:
                yield settle()
                size = 0
            held.append((row, start, part))
            size, last = size + len(part), key
    if held:
        yield settle()


def removed_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Runs (row, start, end) of bytes of ``docs`` (row, text) that a window covers which stands earlier; runs may overlap."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, *_, again in segments(batch, length, gram):
                found, n = np.unique(key[~again], return_counts=True)
                yield record("key long, n long", key=pa.array(found.view(np.int64)), n=pa.array(n.astype(np.int64)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content, row, start, windows, again in segments(batch, length, gram):
                # What a slice repeats of itself is settled: joined to runs and marked by a negative number of windows.
                a, b = start[again], start[again] + windows[again]
                heads = np.flatnonzero(np.r_[True, (a[1:] != b[:-1]) | (row[again][1:] != row[again][:-1])]) if len(a) else np.zeros(0, int)
                tails = np.r_[heads[1:], len(a)] - 1 if len(a) else heads
                own = row[again][heads] if len(a) else np.zeros(0, np.int64)
                spread = (own.astype(np.uint64) * np.uint64(BASES[0]) + a[heads].astype(np.uint64) * np.uint64(BASES[1])) if len(a) else own.astype(np.uint64)
                yield record(
                    SEGMENTS,
                    key=pa.array(np.r_[key[~again], spread].view(np.int64)),
                    content=pa.array(np.r_[content[~again], np.zeros(len(heads), np.uint64)].view(np.int64)),
                    row=pa.array(np.r_[row[~again], own].astype(np.int64)),
                    start=pa.array(np.r_[start[~again], a[heads]].astype(np.int32)),
                    windows=pa.array(np.r_[windows[~again], a[heads] - b[tails]].astype(np.int32)),
                )

    spark = docs.sparkSession
    texts = docs.select("row", "text")
    repeated = texts.mapInArrow(keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    found = texts.mapInArrow(cut, SEGMENTS).join(repeated.select("key", F.lit(True).alias("hit")), "key", "left")
    found = stored(found.where("hit or windows < 0").drop("hit"), "substrings-segments")
    forget(spark)

    several = found.where("windows > 0")
    first = F.min(F.struct("row", "start")).alias("first")
    classes = several.groupBy("key", "content").agg(first, F.count("*").alias("n"), F.first("windows").alias("windows"))
    classes = stored(classes, "substrings-classes")
    forget(spark)

    contents = classes.groupBy("key").agg(F.count("*").alias("contents")).where("contents > 1")
    wanted = classes.join(contents, "key").select("key", "first.row", "first.start", "windows", "contents")
    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct("key", "start", "windows", "contents")).alias("wanted"))

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                for row, text, asked in zip(*(piece.column(c).to_pylist() for c in ("row", "text", "wanted")), strict=True):
                    raw = text.encode()
                    spans = [raw[w["start"] : w["start"] + w["windows"] + length - 1] for w in asked]
                    yield record(
                        "key long, row long, start int, contents long, segment binary",
                        key=pa.array([w["key"] for w in asked], pa.int64()), row=pa.array([row] * len(asked), pa.int64()),
                        start=pa.array([w["start"] for w in asked], pa.int32()),
                        contents=pa.array([w["contents"] for w in asked], pa.int64()), segment=pa.array(spans, pa.binary()),
                    )

    schema = "key long, row long, start int, contents long, segment binary"
    met = stored(texts.join(by_row, "row").mapInArrow(fetched, schema), "substrings-texts")
    forget(spark)

    few = met.where(F.col("contents") <= group).select("key", "row", "start", "segment")
    runs = few.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: compared(b, length), RUNS)

    # Minimizers with too many segments: window by window.
    singles = "h1 long, h2 long, row long, start int"

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffer(batch.column("segment"))
            counts = np.diff(offsets) - length + 1
            owner = np.repeat(np.arange(len(counts)), counts)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = offsets[:-1][owner] + inner
            rows, starts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "start"))
            h1, h2 = (span_hashes(raw, at, at + length, base).view(np.int64) for base in BASES)
            yield record(
                singles, h1=pa.array(h1), h2=pa.array(h2), row=pa.array(rows[owner]),
                start=pa.array((starts[owner] + inner).astype(np.int32)),
            )

    many = met.where(F.col("contents") > group).select("row", "start", "segment").mapInArrow(single, singles)
    earliest = many.groupBy("h1", "h2").agg(first, F.count("*").alias("n")).where("n > 1").drop("n")
    late = F.struct("row", "start") != F.col("first")
    windowed = many.join(earliest, ["h1", "h2"]).where(late)
    runs = runs.unionByName(windowed.select("row", "start", (F.col("start") + length).alias("end")))

    copies = several.join(classes.where("n > 1").select("key", "content", "first"), ["key", "content"]).where(late)
    runs = runs.unionByName(copies.select("row", "start", (F.col("start") + F.col("windows") + length - 1).alias("end")))
    own = found.where("windows < 0")
    return runs.unionByName(own.select("row", "start", (F.col("start") - F.col("windows") + length - 1).alias("end")))


def remove_repeats(
    df: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, carried: tuple[str, ...] | None = None
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document; with ``carried``, also those columns of ``df`` and
    ``kept``, the text that stays. (A run can end inside a character; ``kept`` leaves such a character out.)

    A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a smaller doc_id or earlier in the same
    document. Null and empty texts have no byte; rows with equal doc_id and text are one document; different texts under
    one doc_id, or under a null one (which counts as smallest), are documents of their own in the order of their texts; an
    empty table gives an empty result; further columns are ignored.
    """
    if gram + 8 > length:
        raise ValueError("gram must leave at least eight bytes of the window")
    more = tuple(c for c in carried or () if c not in ("doc_id", "text"))
    docs = numbered(documents(df, *more))
    runs = removed_runs(docs, length, gram, group)
    by_row = stored(runs.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("runs")), "substrings-runs")
    forget(df.sparkSession)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    full = T.StructType.fromDDL(schema + ", kept string" * (carried is not None))
    for name in more:
        full = full.add(docs.schema[name])

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                raw, offsets = buffer(piece.column("text"))
                lists = piece.column("runs")
                flat = lists.flatten()
                owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
                change = np.zeros(len(raw) + 1, np.int64)
                np.add.at(change, offsets[owner] + flat.field(0).to_numpy(), 1)
                np.add.at(change, offsets[owner] + flat.field(1).to_numpy(), -1)
                gone = np.cumsum(change)[:-1] > 0
                total = np.r_[0, np.cumsum(gone)]
                # A run begins where a byte goes and the one before stays, or where a row begins.
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                rows = offsets[:-1][offsets[:-1] < len(raw)]
                begins[rows] = gone[rows]
                spans = np.r_[0, np.cumsum(begins)]
                kept = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
                made = record(
                    schema,
                    doc_id=piece.column("doc_id"), n_bytes=pa.array(np.diff(offsets)),
                    n_removed=pa.array(total[offsets[1:]] - total[offsets[:-1]]),
                    n_spans=pa.array(spans[offsets[1:]] - spans[offsets[:-1]]),
                    kept_sha256=pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                )
                if carried is not None:
                    made = made.append_column("kept", pa.array([k.decode("utf-8", "ignore") for k in kept]))
                for name in more:
                    made = made.append_column(name, piece.column(name))
                yield made

    return docs.join(by_row, "row", "left").select("doc_id", "text", "runs", *more).mapInArrow(applied, full)
