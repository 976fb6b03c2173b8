"""Length buckets with the least padding, and token-budget batches inside each bucket.

The global histogram of lengths decides: dynamic programming over its bins finds the boundaries for which the sum of
(boundary of the bucket - length) over all rows is smallest. Rows are numbered inside their bucket by chunks of bounded size,
so no bucket is ordered in one task, and ``budget // boundary`` rows form a batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fileguard.llm.common import documents, stored
from fileguard.llm.token_counts import token_counts

N_BUCKETS = 16
BUDGET = 1 << 16
#: Lengths up to this have a bin each; beyond, 128 bins for every doubling, so the histogram has at most some 40,000 bins. A bin
#: knows its longest row and the sum of its lengths, so a boundary is always a real length; only where it lies inside a bin is
#: not tried, which costs less than 1/128 of a row's length.
EXACT = 1 << 15
ROWS_PER_CHUNK = 4096


def word_count(text: Column) -> Column:
    """Runs of characters other than space and 9 to 13."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def binned(n: Column) -> Column:
    """The upper end of the bin of a length."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double"))) - 7).cast("long")
    return F.when(n <= EXACT, n).otherwise(F.ceil(n / step).cast("long") * step)


def boundaries(lengths: list[int], counts: list[int], k: int, sums: list[int] | None = None) -> list[int]:
    """At most ``k`` boundaries out of the rising ``lengths`` with the least padding; the last length is one of them. ``sums`` gives
    the sum of the rows' own lengths where a bin holds several.

    For a bucket that ends with bin j and follows bin i, padding is L[j] * (C[j] - C[i]) - (S[j] - S[i]), where C sums
    counts and S sums lengths of rows. For each j the best i minimises a line in L[j]; both slopes and L are monotone, so
    each bucket more costs one pass over a lower hull.
    """
    n = len(lengths)
    if n == 0:
        return []
    k = min(k, n)
    c = [0, *np.cumsum(np.asarray(counts, object))]
    own = np.asarray(counts, object) * np.asarray(lengths, object) if sums is None else np.asarray(sums, object)
    s = [0, *np.cumsum(own)]
    best: list[int | None] = [0] + [None] * n
    cuts: list[list[int]] = []
    for _ in range(k):
        hull: list[tuple[int, int, int]] = []  # slope -C[i], value at 0, i
        head, new, cut = 0, [None] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                m, b = -c[j - 1], best[j - 1] + s[j - 1]
                while len(hull) - head >= 2 and (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, b, j - 1))
            length = lengths[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * length + hull[head + 1][1] <= hull[head][0] * length + hull[head][1]:
                head += 1
            if len(hull) > head:
                m, b, i = hull[head]
                new[j], cut[j] = m * length + b + length * c[j] - s[j], i
        cuts.append(cut)
        best = new
    # Exactly k buckets are never worse than fewer, since k is at most the number of bins.
    ends, j = [], n
    for cut in reversed(cuts):
        ends.append(lengths[j - 1])
        j = cut[j]
    return ends[::-1]


def pack(
    df: DataFrame, n_buckets: int = N_BUCKETS, budget: int = BUDGET, rows_per_chunk: int = ROWS_PER_CHUNK, tokenizer: str | None = None
) -> DataFrame:
    """doc_id, n_tokens, bucket, boundary (padded length), batch (number inside the bucket) and slot for every row.

    Lengths and budget are tokens of ``tokenizer`` (a vocabulary file, see ``token_counts``); without one they are words.
    Null and empty texts have length 0 and go to the first bucket; a null ``doc_id`` stays null; repeated rows are packed
    each by itself; an empty table gives an empty result; further columns are ignored. A row longer than the budget is a
    batch by itself. To the driver go the histogram (at most some 40,000 bins) and one count for each bucket.
    """
    if tokenizer is None:
        sized = documents(df).select("doc_id", word_count(F.col("text")).alias("n_tokens"))
    else:
        sized = token_counts(df, tokenizer).select("doc_id", "n_tokens")
    sized = stored(sized, "packing-lengths")
    bins = sized.groupBy(binned(F.col("n_tokens")).alias("bin")).agg(
        F.count("*").alias("n"), F.max("n_tokens").alias("longest"), F.sum("n_tokens").alias("sum")
    ).orderBy("bin").collect()
    ends = boundaries([r["longest"] for r in bins], [r["n"] for r in bins], n_buckets, [r["sum"] for r in bins])
    if not ends:
        ends = [0]
    held = [sum(r["n"] for r in bins if low < r["longest"] <= high) for low, high in zip([-1, *ends], ends, strict=False)]
    chunks = F.array(*(F.lit(max(1, -(-n // rows_per_chunk))) for n in held))
    bounds = F.array(*(F.lit(e).cast("long") for e in ends))
    bucket = F.size(F.filter(bounds, lambda b: b < F.col("n_tokens")))
    placed = sized.withColumn("bucket", bucket).withColumns({
        "boundary": F.get(bounds, F.col("bucket")),
        "chunk": F.pmod(F.xxhash64("doc_id", "n_tokens"), F.get(chunks, F.col("bucket"))).cast("int"),
    })
    in_chunk = Window.partitionBy("bucket", "chunk").orderBy("doc_id", "n_tokens")
    ranked = placed.withColumn("rank", F.row_number().over(in_chunk) - 1)
    sums = placed.groupBy("bucket", "chunk").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("bucket", "chunk", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("boundary")))).cast("long")
    place = F.col("rank") + F.col("before")
    return ranked.join(sums, ["bucket", "chunk"]).select(
        "doc_id", "n_tokens", "bucket", "boundary",
        F.floor(place / size).cast("long").alias("batch"), (place % size).cast("long").alias("slot"),
    )
