"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

One model of order four for each language; symbols are lower-case UTF-16 code points (characters beyond it are one symbol),
so an n-gram is an exact 64-bit number whose mix is its hash. For each order one sorted array holds the hashes of all
languages' n-grams, beside it a column of probabilities for each language, so a text is looked up once for all languages.
The language with the lowest cross-entropy a character wins. A slope turns the distances into a confidence and a bound
rejects texts that fit no model; both are fitted on texts that the models have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileguard.llm.common import documents, mixed, pieces, record

ORDER = 4
#: Characters of each language that models are fitted on, about: documents are drawn by hash until then. It bounds the models,
#: never the texts that are identified.
FIT_CHARS = 4_000_000
#: One in so many of the drawn documents calibrates instead.
CALIBRATION = 8
#: Share of calibration texts of known language that the bound may reject.
REJECTED = 0.001
#: Weight that calibration gives to the other languages of a labelled text.
SOFT = 0.02
UNKNOWN = "und"

COUNTS = "lang string, gram long, n long"
LABELS = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"


def has_letter(text: str) -> bool:
    """Is any character a letter of Unicode? Signs that only count or number, such as superscripts and Roman numerals, are not."""
    return any(map(str.isalpha, text))


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ORDER - 1 zeros, and where each text begins (n + 1 numbers)."""
    gap = "\0" * (ORDER - 1)
    low = [t.lower() for t in texts]
    points = np.frombuffer((gap + gap.join(low)).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.minimum(points, 0xFFFF).astype(np.uint64)
    sizes = np.array([len(t) for t in low], np.int64) + len(gap)
    return points, np.r_[0, np.cumsum(sizes)] + len(gap)


def grams(points: np.ndarray) -> np.ndarray:
    """The n-gram of ORDER symbols that ends at each place from ORDER - 1 on."""
    out = np.zeros(len(points) - ORDER + 1, np.uint64)
    for back in range(ORDER):
        out |= points[ORDER - 1 - back : len(points) - back] << np.uint64(16 * back)
    return out


def low_order(gram: np.ndarray, n: int) -> np.ndarray:
    """The last n symbols; the order is part of the number's hash, not of the number."""
    return gram & np.uint64((1 << (16 * n)) - 1)


def hashed(gram: np.ndarray, n: int) -> np.ndarray:
    return mixed(gram ^ np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


@dataclass
class Models:
    """For each order: sorted hashes, natural log probabilities (n-grams x languages) and log back-off weights of histories."""

    langs: list[str]
    hashes: list[np.ndarray]
    values: list[np.ndarray]
    histories: list[np.ndarray]
    weights: list[np.ndarray]
    floor: np.ndarray
    slope: float = 1.0
    bound: float = np.inf

    def losses(self, gram: np.ndarray) -> np.ndarray:
        """-ln p of the last symbol of each n-gram under each language."""
        total = np.zeros((len(gram), len(self.langs)), np.float64)
        open_ = np.arange(len(gram))
        for n in range(ORDER, 0, -1):
            at, hit = found(self.hashes[n - 1], hashed(low_order(gram[open_], n), n))
            total[open_[hit]] += self.values[n - 1][at[hit]]
            open_ = open_[~hit]
            if n > 1 and len(open_):
                history = low_order(gram[open_], n) >> np.uint64(16)
                at, hit = found(self.histories[n - 1], hashed(history, n))
                total[open_[hit]] += self.weights[n - 1][at[hit]]
        total[open_] += self.floor
        return -total


def found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def kneser_ney(langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> Models:
    """Models from the distinct n-grams of highest order and their counts, for each language.

    The highest order uses counts; lower orders use the number of different symbols before. One discount for each order,
    n1 / (n1 + 2 n2).
    """
    tables: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by language, by order: grams, counts
    for gram, n in counts:
        levels = [(gram, n.astype(np.float64))]
        for order in range(ORDER - 1, 0, -1):
            low, kinds = np.unique(low_order(levels[0][0], order), return_counts=True)
            levels.insert(0, (low, kinds.astype(np.float64)))
        tables.append(levels)
    union = [np.unique(np.concatenate([t[k][0] for t in tables])) for k in range(ORDER)]
    alphabet = len(union[0]) + 1
    floor = np.full(len(langs), -np.log(alphabet))
    below = np.full((len(union[0]), len(langs)), 1.0 / alphabet)
    models = Models(langs, [], [], [], [], floor)
    for k in range(ORDER):
        n = k + 1
        past = union[k] >> np.uint64(16) if k else np.zeros(len(union[k]), np.uint64)
        history, of = np.unique(past, return_inverse=True)
        value, weight = np.empty((len(union[k]), len(langs))), np.zeros((len(history), len(langs)))
        for j, levels in enumerate(tables):
            seen = np.zeros(len(union[k]))
            seen[np.searchsorted(union[k], levels[k][0])] = levels[k][1]
            once, twice = (seen == 1).sum(), (seen == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total = np.bincount(of, weights=seen, minlength=len(history))
            kinds = np.bincount(of, weights=seen > 0, minlength=len(history))
            left = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            value[:, j] = np.maximum(seen - discount, 0) / np.maximum(total[of], 1) + left[of] * below[:, j]
            weight[:, j] = np.log(left)
        for keys, rows, held, kept in (
            (hashed(union[k], n), np.log(value), models.hashes, models.values),
            (hashed(history, n), weight, models.histories, models.weights),
        ):
            order = np.argsort(keys)
            held.append(keys[order])
            kept.append(rows[order])
        if n < ORDER:
            # Probability of the shorter n-gram, for each n-gram of the next order.
            below = value[np.searchsorted(union[k], low_order(union[k + 1], n))]
    # The unigram level is mixed with the uniform distribution, which a symbol never seen gets in full.
    models.floor = floor + models.weights[0][0] if len(models.weights[0]) else floor
    return models


def cross_entropies(models: Models, texts: list[str]) -> np.ndarray:
    """Mean -ln p a character, texts x languages; NaN for texts without characters."""
    points, begins = symbols(texts)
    gram = grams(points) if len(points) >= ORDER else np.zeros(0, np.uint64)
    kinds, of = np.unique(gram, return_inverse=True)
    loss = models.losses(kinds)
    lengths = np.diff(begins) - (ORDER - 1)
    out = np.full((len(texts), len(models.langs)), np.nan)
    some = np.flatnonzero(lengths > 0)
    if len(some):
        first = begins[:-1][some] - (ORDER - 1)
        cuts = np.c_[first, first + lengths[some]].ravel()
        for j in range(len(models.langs)):
            sums = np.add.reduceat(np.r_[loss[of, j], 0.0], cuts)[::2]
            out[some, j] = sums / lengths[some]
    return out


def calibrated(models: Models, values: np.ndarray, langs: list[str]) -> Models:
    """Slope of the confidence with the highest likelihood on a grid, and the bound of the cross-entropy, from the
    cross-entropies (texts x languages) of texts of known language."""
    if langs:
        right = np.array([models.langs.index(x) for x in langs])
        gaps = values - values[np.arange(len(langs)), right][:, None]
        grid = 2.0 ** np.arange(-2, 10)
        # Soft labels, since even a text of one language holds some words of another; they keep the slope finite.
        wrong = gaps.sum(axis=1) * SOFT / max(1, gaps.shape[1] - 1)
        likelihood = [(-np.log(np.exp(np.clip(-s * gaps, -700, 700)).sum(axis=1)) - s * wrong).sum() for s in grid]
        models.slope = float(grid[int(np.argmax(likelihood))])
        models.bound = float(np.quantile(values.min(axis=1), 1 - REJECTED))
    return models


def training_rows(df: DataFrame) -> DataFrame:
    """Rows with a text and a language whose crc32(doc_id as text) mod 3 is not 1."""
    kept = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(False))
    return df.select(F.col("doc_id").cast("long"), "text", "lang").where(kept & F.col("text").isNotNull() & F.col("lang").isNotNull())


def fit(df: DataFrame, fit_chars: int = FIT_CHARS) -> Models:
    """Models of the languages in ``df`` (doc_id, text, lang), fitted on about ``fit_chars`` characters of each.

    Of each language the document with the smallest hash is fitted on whatever its length, so no language is lost; of the
    others drawn, one in ``CALIBRATION`` calibrates. Calibration texts are judged where they are; only numbers are collected.
    """
    place = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    placed = df.where("text != ''").withColumn("place", place)
    first = F.min(F.struct("place", "doc_id", F.xxhash64("text").alias("mark")))
    sizes = placed.groupBy("lang").agg(F.sum(F.length("text")).alias("n"), first.alias("first"))
    leads = F.struct("place", "doc_id", F.xxhash64("text").alias("mark")) == F.col("first")
    held = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(CALIBRATION)) == 0
    drawn = placed.join(F.broadcast(sizes), "lang").withColumn("leads", leads)
    drawn = drawn.where(F.col("leads") | (F.col("place") < F.lit(float(fit_chars)) / F.col("n"))).withColumn("calibrates", held & ~F.col("leads"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            texts = batch.column("text").to_pylist()
            for lang in np.unique(langs):
                points, _ = symbols([texts[i] for i in np.flatnonzero(langs == lang)])
                gram = grams(points)
                gram, n = np.unique(gram[low_order(gram, 1) > 0], return_counts=True)
                yield record(COUNTS, lang=pa.array([str(lang)] * len(gram)), gram=pa.array(gram.view(np.int64)), n=pa.array(n))

    rows = drawn.where("not calibrates").select("lang", "text").mapInArrow(counted, COUNTS)
    table = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(table["lang"].unique())
    counts = []
    for lang in langs:
        own = table[table["lang"] == lang]
        gram, n = own["gram"].to_numpy().view(np.uint64), own["n"].to_numpy()
        order = np.argsort(gram)
        counts.append((gram[order], n[order]))
    models = kneser_ney(langs, counts) if langs else Models([], [], [], [], [], np.zeros(0))
    if not langs:
        return models

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                values = cross_entropies(models, piece.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("lang"), pa.array(values.tolist(), pa.list_(pa.float64()))], names=["lang", "loss"])

    tests = drawn.where("calibrates").select("lang", "text").mapInArrow(judged, "lang string, loss array<double>").collect()
    tests.sort(key=lambda r: (r["lang"], r["loss"]))
    return calibrated(models, np.array([r["loss"] for r in tests]), [r["lang"] for r in tests])


def identify(df: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score (confidence, 0 to 1), cross_entropy (nats a character, of the best) and rejected, for each row.

    Texts that are null, empty or without a letter are ``und`` with score 0 and rejected; so are all if there is no model.
    Other texts get a language even if rejected. Ties go to the language that sorts first. Rows are judged each by itself,
    a null doc_id stays null, an empty table gives an empty result, further columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(vars(models))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Models(**shared.value)
        for batch in batches:
            for piece in pieces(batch):
                texts = piece.column("text").to_pylist()
                known = np.array([bool(model.langs) and has_letter(t) for t in texts], bool)
                values = cross_entropies(model, texts) if model.langs else np.zeros((len(texts), 1))
                values = np.where(known[:, None], values, 0.0)
                best = values.argmin(axis=1)
                least = values[np.arange(len(texts)), best]
                sure = 1.0 / np.exp(-np.clip(model.slope * (values - least[:, None]), 0, 700)).sum(axis=1)
                yield record(
                    LABELS,
                    doc_id=piece.column("doc_id"),
                    lang_pred=pa.array([model.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]),
                    score=pa.array(np.where(known, sure, 0.0)),
                    cross_entropy=pa.array(np.where(known, least, np.nan), from_pandas=True),
                    rejected=pa.array(~known | (least > model.bound)),
                )

    return documents(df).mapInArrow(labelled, LABELS)
