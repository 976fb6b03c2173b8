"""Near-duplicate texts: universal hash minima in bands, checked by signature, confirmed on full shingle sets, and joined to
components.

* Texts with the same shingle set form a class, whose smallest row stands for it.
* Rows that share a band are first linked to the smallest and the largest row of the band: two candidates a row and band.
* Components of the confirmed links are built. In a band whose rows still lie in several components, all pairs across
  components are compared by signature, in blocks of bounded size. What leaves a block is not the pairs but questions: "has
  this component a row that is linked to me?", from a row of the smaller component to the larger one.
* A question goes to every block of the component, meets the full sets there, and comes back with one link at most. So no link
  between different texts is lost to the choice of the first centres, and no group is written out as pairs.
* With 40 bands of 5 minima a pair of similarity 0.8 shares no band with probability 1.3e-7, and the signature bound lies
  more than five standard deviations below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileguard.llm.common import buffer, documents, forget, lowered, mixed, numbered, pieces, record, span_hashes, stored, words
from fileguard.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 40
MINIMA = 5
#: Rows of a band whose signatures (one byte a minimum) are compared with one another in one block.
BLOCK_ROWS = 2048
#: Rows of a component whose full sets are held together to answer questions.
ANSWER_ROWS = 512

SKETCH = "row long, n_shingles long, set1 long, set2 long, signature binary, bands array<long>"
PAIRS = "a long, b long"


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The distinct ``width``-word shingles of each row as sorted 64-bit hashes. A row of fewer words is one shingle."""
    raw = lowered(raw)
    starts, ends, first = words(raw, offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    word = span_hashes(raw, starts, ends)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
    stop = first[row + 1]
    hashes = np.zeros(len(row), np.uint64)
    for k in range(width):
        inside = at + k < stop
        joined = mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + word[np.minimum(at + k, len(word) - 1)])
        hashes = np.where(inside, joined, hashes)
    cuts = np.cumsum(count)[:-1]
    return [np.unique(part) for part in np.split(hashes, cuts)]


def multipliers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` members of the multiply-add-shift family, which is universal for 64-bit keys and 32-bit values."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a, b = rng.integers(0, 1 << 64, size=(2, n), dtype=np.uint64, endpoint=False)
    return a | np.uint64(1), b


def sketches(sets: list[np.ndarray], bands: int, minima: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (one byte of each minimum) and band keys of non-empty sets."""
    values = np.concatenate(sets)
    cuts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    a, b = multipliers(bands * minima, seed)
    least = np.empty((len(sets), bands * minima), np.uint64)
    for i in range(bands * minima):
        least[:, i] = np.minimum.reduceat((values * a[i] + b[i]) >> np.uint64(32), cuts)
    keys = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band + 1, np.uint64)
        for i in range(band * minima, (band + 1) * minima):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[:, i])
        keys[:, band] = key
    return (least & np.uint64(255)).astype(np.uint8), keys


def fewest_equal(n: int, similarity: float) -> int:
    """Equal signature bytes of a pair at the threshold, less five standard deviations."""
    p = similarity + (1 - similarity) / 256
    return int(np.floor(n * p - 5 * np.sqrt(n * p * (1 - p))))


def bytes_matrix(column: pa.Array) -> np.ndarray:
    raw, offsets = buffer(column)
    return raw.reshape(len(offsets) - 1, -1) if len(offsets) > 1 else raw.reshape(0, 0)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, held: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those ``pairs`` (a, b) whose full shingle sets reach the similarity; ``held`` has the texts (row, text)."""
    percent = round(100 * similarity)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "x"):
                x, y = (shingle_sets(*buffer(piece.column(c)), width) for c in ("x", "y"))
                good = pa.array([linked(*sets, percent) for sets in zip(x, y, strict=True)], pa.bool_())
                yield piece.select(["a", "b"]).filter(good)

    one = held.select(F.col("row").alias("a"), F.col("text").alias("x"))
    other = held.select(F.col("row").alias("b"), F.col("text").alias("y"))
    return pairs.join(one, "a").join(other, "b").mapInArrow(checked, PAIRS)


def answered(questions: DataFrame, named: DataFrame, held: DataFrame, width: int, similarity: float, block_rows: int) -> DataFrame:
    """One link (a, b) at most for each question (row, asked) and block of the asked component's rows."""
    percent = round(100 * similarity)
    asked = questions.groupBy(F.col("asked").alias("component")).agg(F.count("*").alias("_")).drop("_")
    sizes = named.groupBy("component").agg(F.count("*").alias("n")).join(asked, "component")
    sizes = sizes.select("component", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    targets = named.join(sizes, "component").select("row", "component", block.alias("block"), F.lit(False).alias("asks"))
    asking = questions.withColumnRenamed("asked", "component").join(sizes, "component").select(
        "row", "component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks")
    )
    # A component that many ask is asked in several groups as well; its rows are copied to each.
    load = asking.groupBy("component", "block").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    asking = asking.join(load, ["component", "block"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    targets = targets.join(load, ["component", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = asking.unionByName(targets).join(held, "row").select("component", "block", "part", "row", "asks", "text")

    def compared(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rows, asks = (group.column(c).to_numpy(zero_copy_only=False) for c in ("row", "asks"))
        asks = asks.astype(bool)
        sets = shingle_sets(*buffer(group.column("text")), width)
        sizes = np.array([len(s) for s in sets])
        found = []
        targets = np.flatnonzero(~asks)
        for i in np.flatnonzero(asks):
            # Sizes alone rule out most; the nearest sizes are tried first.
            near = targets[np.minimum(sizes[targets], sizes[i]) * 100 >= percent * np.maximum(sizes[targets], sizes[i])]
            for j in near[np.argsort(np.abs(sizes[near] - sizes[i]), kind="stable")]:
                if linked(sets[i], sets[j], percent):
                    found.append((min(rows[i], rows[j]), max(rows[i], rows[j])))
                    break
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.groupBy("component", "block", "part").applyInArrow(compared, PAIRS)


def alike(pairs: DataFrame, sketched: DataFrame, least: int) -> DataFrame:
    """Those ``pairs`` whose signatures have at least ``least`` equal bytes."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (bytes_matrix(batch.column("x")) == bytes_matrix(batch.column("y"))).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(same >= least))

    one = sketched.select(F.col("row").alias("a"), F.col("signature").alias("x"))
    other = sketched.select(F.col("row").alias("b"), F.col("signature").alias("y"))
    return pairs.join(one, "a").join(other, "b").mapInArrow(checked, PAIRS)


def across(members: DataFrame, sketched: DataFrame, least: int, block_rows: int) -> DataFrame:
    """Questions (row, asked) between ``members`` (key, row, component, size, n) of one key: a row and a component at least as
    large, one of whose rows in the key has a signature alike.

    The rows of a key are dealt to ceil(n / block_rows) blocks by hash; each pair of blocks is a group of its own.
    """
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    mine = F.pmod(F.xxhash64("row"), blocks).cast("int")
    met = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least("mine", o).alias("low"), F.greatest("mine", o).alias("high")),
    )
    keep = ["key", "row", "component", "size", "mine"]
    dealt = members.withColumns({"blocks": blocks, "mine": mine}).select(*keep, F.explode(met).alias("met"))
    dealt = dealt.join(sketched.select("row", "signature"), "row").select(*keep, "met.low", "met.high", "signature")

    def compared(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rows, comps, sizes, mine = (group.column(c).to_numpy() for c in ("row", "component", "size", "mine"))
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        sig = bytes_matrix(group.column("signature"))
        left, right = np.flatnonzero(mine == low), np.flatnonzero(mine == high)
        found: set[tuple[int, int]] = set()
        for i in left:
            others = right[comps[right] != comps[i]]
            if len(others):
                good = others[(sig[others] == sig[i]).sum(axis=1) >= least]
                smaller = (sizes[good] > sizes[i]) | ((sizes[good] == sizes[i]) & (comps[good] < comps[i]))
                found.update((int(rows[i]), int(c)) for c in np.unique(comps[good[smaller]]))
                found.update((int(r), int(comps[i])) for r in rows[good[~smaller]])
        row, asked = zip(*found, strict=True) if found else ((), ())
        return pa.table({"row": pa.array(row, pa.int64()), "asked": pa.array(asked, pa.int64())})

    return dealt.groupBy("key", "low", "high").applyInArrow(compared, "row long, asked long").distinct()


def near_duplicates(
    df: DataFrame,
    width: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    minima: int = MINIMA,
    block_rows: int = BLOCK_ROWS,
    seed: int = 1,
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document, and the columns of ``df`` named in ``carried``.

    A-Z count as a-z; words are runs of characters other than space and 9 to 13. Documents are linked if the similarity of
    their sets of distinct shingles reaches ``similarity`` (in whole percents); component_id is the smallest doc_id that
    links lead to, and the first document of a component is kept.

    Null and empty texts have no shingle and no link. Rows with equal doc_id and text are one document; different texts under
    one doc_id, or under a null one (which counts as smallest), are documents of their own, ordered by text, the first of
    which can be kept. An empty table gives an empty result; further columns are ignored.
    """
    spark = df.sparkSession
    docs = numbered(documents(df, *(c for c in carried if c != "text")))
    texts = docs.select("row", "text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                sets = shingle_sets(*buffer(piece.column("text")), width)
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                signature: list[bytes | None] = [None] * len(sets)
                keys: list[np.ndarray | None] = [None] * len(sets)
                if len(some):
                    sig, band = sketches([sets[i] for i in some], bands, minima, seed)
                    for k, i in enumerate(some):
                        signature[i], keys[i] = sig[k].tobytes(), band[k].view(np.int64)
                one = [int(mixed(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
                two = [int(mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
                yield record(
                    SKETCH, row=piece.column("row"), n_shingles=pa.array(sizes), set1=pa.array(one, pa.int64()),
                    set2=pa.array(two, pa.int64()), signature=pa.array(signature, pa.binary()),
                    bands=pa.array(keys, pa.list_(pa.int64())),
                )

    every = stored(texts.mapInArrow(sketch, SKETCH), "near-sketches")
    same = ["n_shingles", "set1", "set2"]
    classes = every.where("n_shingles > 0").groupBy(*same).agg(F.min("row").alias("row"))
    sketched = stored(every.join(classes.select("row"), "row", "left_semi").select("row", "signature", "bands"), "near-classes")
    forget(spark)

    members = sketched.select("row", F.explode("bands").alias("key"))
    ends = members.groupBy("key").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high")
    tied = members.join(ends, "key").select("row", F.explode(F.array("low", "high")).alias("other")).where("row <> other")
    tied = tied.select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b")).distinct()
    tied = stored(tied, "near-tied")
    ends = tied.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    # Both sides grow with the corpus, so neither is ever broadcast.
    held = stored(texts.join(ends.hint("merge"), "row").select("row", "text"), "near-texts")
    forget(spark)
    least = fewest_equal(bands * minima, similarity)
    pairs = stored(alike(tied, sketched, least), "near-pairs")
    links = stored(confirmed(pairs, held, width, similarity), "near-links")
    forget(spark)

    joined = components(links)
    own = sketched.select("row").join(joined, F.col("row") == F.col("node"), "left").select(
        "row", F.coalesce("component", "row").alias("component")
    )
    sizes = own.groupBy("component").agg(F.count("*").alias("size"))
    own = stored(own.join(sizes, "component"), "near-components")
    named = members.join(own, "row")
    split = named.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")
    ).where("low < high")
    unsettled = named.join(split.select("key", "n"), "key")
    questions = stored(across(unsettled, sketched, least, block_rows), "near-questions")
    forget(spark)
    if not questions.isEmpty():
        more = answered(questions, own.select("row", "component"), held, width, similarity, min(block_rows, ANSWER_ROWS))
        links = stored(links.unionByName(more), "near-all-links")
        forget(spark)
        joined = components(links)

    leads = classes.withColumnRenamed("row", "lead").join(joined, F.col("lead") == F.col("node"), "left").select(
        *same, F.coalesce("component", "lead").alias("component")
    )
    found = every.select("row", *same).join(leads, same, "left").select(
        "row", "n_shingles", F.coalesce("component", "row").alias("component")
    )
    heads = docs.select(F.col("row").alias("component"), F.col("doc_id").alias("component_id"))
    named = found.join(heads, "component")
    return docs.select("row", "doc_id", *carried).join(named, "row").select(
        "doc_id", "n_shingles", "component_id", (F.col("row") == F.col("component")).alias("kept"), *carried
    )
