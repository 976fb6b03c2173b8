"""Personal data in whole texts: four kinds by pattern, and disguised ones by a character tagger trained on the patterns' spans.

The patterns' spans (the base) always stay. The tagger, a bidirectional LSTM with CRF transitions, learns from them: windows
around spans of a bounded sample of documents, and the same windows with the span written in other ways (``disguised``), next
to another one, or replaced by a harmless number. It decodes overlapping windows; what they find is reconciled over the whole
text: pieces that a window's edge cut are joined, spans that contradict a base span go, and of the rest the set of disjoint
spans with the largest sum of scores stays. A span is added only if its plain form is one (checksum, number of digits,
domain), so a wrong guess of the tagger about shape alone adds nothing.

A window without a digit, an @ or a spelled-out one holds no span of these kinds; such windows are not decoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fileguard.llm.character_tagger import Span, Tagger, classes, spans_of, train
from fileguard.llm.common import documents, pieces, record

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, of a training window, and from one window to the next: a span of up to WINDOW - STRIDE characters is
#: whole in some window.
WINDOW, TRAINING, STRIDE = 128, 64, 64
#: Documents whose spans the tagger is trained on, drawn by hash of their id, and training windows of each sort.
FIT_DOCUMENTS = 8192
FIT_WINDOWS = 120
SHAPES = 6
BATCH_WINDOWS = 512
#: Windows held at a time while a long text is worked off.
HELD_WINDOWS = 4096

RESULT = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
)

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[({<]\s?at\s?[\])}>]|\bdot\b", re.IGNORECASE)

AT = re.compile(r"\s*(?:[\[({<]\s?(?:at|@)\s?[\])}>]|@)\s*|\s+at\s+", re.IGNORECASE)
DOT = re.compile(r"\s*[\[({<]\s?(?:dot|\.)\s?[\])}>]\s*|\s+dot\s+|\s*\.\s*", re.IGNORECASE)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}")
CARD_SIGNS = re.compile(r"[0-9](?:[ \-./_ ]{0,3}[0-9])+")
PHONE_SIGNS = re.compile(r"[+(]?[0-9](?:[ \-./() ]{0,3}[0-9])+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) << (i & 1)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small_parts(address: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in address.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from one @ to the next: the local part reaches back to a sign it cannot hold or to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_SIGNS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def shapes(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, valid) of all matches of the patterns."""
    out = [("email", s, e, True) for s, e in emails(text)]
    if any(c in text for c in "0123456789"):
        out += [("ip", m.start(), m.end(), small_parts(m[0])) for m in IP.finditer(text)]
        for m in CARD.finditer(text):
            digits = only_digits(m[0])
            out.append(("card", m.start(), m.end(), 14 <= len(digits) <= 19 and luhn(digits)))
        if "+" in text:
            out += [("phone", m.start(), m.end(), 10 <= len(only_digits(m[0])) <= 15) for m in PHONE.finditer(text)]
    return out


def base(text: str) -> list[Span]:
    """Valid matches by start, then kind as listed."""
    return sorted(((k, s, e) for k, s, e, valid in shapes(text) if valid), key=lambda x: (x[1], KINDS.index(x[0])))


def holds(kind: str, text: str) -> bool:
    """Is the text, rid of its disguise, a value of the kind?"""
    if kind == "email":
        spaced = re.search(r"\s+at\s", text, re.IGNORECASE) is not None
        if spaced and not re.search(r"\bdot\b", text, re.IGNORECASE):
            return False
        plain = AT.sub("@", text, count=1)
        return EMAIL.fullmatch(DOT.sub(".", plain)) is not None
    if kind == "ip":
        plain = re.sub(r"\s*[\[({]\.[\])}]\s*|\s*\.\s*", ".", text)
        return re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", plain) is not None and small_parts(plain)
    digits = only_digits(text)
    if kind == "card":
        return CARD_SIGNS.fullmatch(text) is not None and 14 <= len(digits) <= 19 and luhn(digits)
    return PHONE_SIGNS.fullmatch(text) is not None and 10 <= len(digits) <= 15 and (text[0] in "+(" or bool(re.search(r"[0-9][ \-./() ]+[0-9]", text)))


# ---- training windows


def rolled(text: str, rng: np.random.Generator) -> str:
    """Other digits in the same places."""
    return "".join(str(rng.integers(10)) if "0" <= c <= "9" else c for c in text)


def disguised(kind: str, text: str, rng: np.random.Generator, words: list[str]) -> str:
    """The value of a span, with other digits and names, written in one of several ways."""
    pick = lambda *options: options[rng.integers(len(options))]
    name = lambda: (words[rng.integers(len(words))] if words else "name").lower()
    if kind == "email":
        local = pick(name(), name() + "." + name(), name()[:1] + "." + name(), name() + str(rng.integers(1, 99)), name() + "_" + name(), text.split("@")[0])
        host = pick(name(), "mail" + str(rng.integers(1, 9)) + "." + name(), name() + "-" + name())
        end = pick("com", "org", "net", "de", "fr", "es", "io", "co.uk", "info", "edu")
        style = rng.integers(6)
        if style <= 1:
            return f"{local}@{host}.{end}"
        at, dot = (("[at]", "[dot]"), ("(at)", "."), (" [at] ", " [dot] "), (" at ", " dot "), (" @ ", " . "), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("<at>", "."))[rng.integers(8)]
        return local + at + dot.join(f"{host}.{end}".split("."))
    if kind == "ip":
        parts = [str(rng.integers(256)) for _ in range(4)]
        return pick(".", ".", "[.]", " . ", "(.)").join(parts)
    digits = "".join(str(rng.integers(10)) for _ in range(16))
    if kind == "card":
        sep = pick("", " ", "-", ".", "/", "_", " ", "  ", " - ")
        if rng.integers(4) == 0:
            return sep.join([digits[:4], digits[4:10], digits[10:15]])
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))
    area, middle, last = digits[:3], digits[3:6], digits[6:10]
    return pick(
        f"+1 ({area}) {middle}-{last}", f"({area}) {middle}-{last}", f"{area}-{middle}-{last}", f"{area}.{middle}.{last}",
        f"00{digits[10:12]} {area} {middle}{last}", f"+{digits[10:12]} {area} {middle} {last}", f"+{digits[10:12]}/{area}/{middle}{last}",
        f"1-{area}-{middle}-{last}", f"0{area}/{middle}{last}", f"+{digits[10:12]} {area} {middle}{last}", f"({area}){middle}{last}",
    )


def harmless(rng: np.random.Generator) -> str:
    """A number or sign that is no personal data."""
    d = lambda n: "".join(str(rng.integers(10)) for _ in range(n))
    options = (
        d(1), d(2), d(3), d(4), d(5), d(6), d(8), f"{d(2)}.{d(2)}.{d(4)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(4)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}",
        f"{d(1)}.{d(2)}", f"{d(3)},{d(3)}.{d(2)}", f"v{d(1)}.{d(2)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}", f"{d(2)}:{d(2)}", f"{d(3)}-{d(4)}", f"{d(2)}-{d(2)}", f"#{d(5)}",
        f"{d(2)} % of {d(4)}", f'token = "{rng.bytes(20).hex()}"', rng.bytes(8).hex(), f"@{d(2)}", f"{d(4)}/{d(2)}", f"{d(3)} x {d(3)}", f"{d(1)}, {d(2)} and {d(2)}", f"{d(4)}, {d(4)}", f"{d(3)} {d(3)}",
        "@home", "look at it (at last)", "a dot of ink", "dot by dot",
    )
    return options[rng.integers(len(options))]


def examples(windows: list[tuple[str, str, int, int]], plain: list[str], seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Training windows (text, spans) made of ``windows`` (text, kind, start, end) and of windows without any span.

    Each span's window stands once as it is and ``SHAPES`` times rewritten; some have two spans side by side.
    """
    rng = np.random.default_rng(seed)
    words = sorted({w for t, _, _, _ in windows for w in re.findall(r"[a-zA-Z]{3,9}", t)})
    kinds = [k for k in KINDS if any(w[1] == k for w in windows)]

    def placed(before: str, parts: list[tuple[str | None, str]], after: str) -> tuple[str, list[Span]]:
        # The text around is cut so that the window's place varies.
        room = max(0, TRAINING - sum(len(p) for _, p in parts))
        lead = min(len(before), int(rng.integers(room + 1)))
        text, spans = before[len(before) - lead :], []
        for kind, part in parts:
            if kind:
                spans.append((kind, len(text), len(text) + len(part)))
            text += part
        return (text + after)[:TRAINING], [(k, s, min(e, TRAINING)) for k, s, e in spans if s < TRAINING]

    out = []
    for text, kind, start, end in windows:
        before, value, after = text[:start], text[start:end], text[end:]
        out.append(placed(before, [(kind, value)], after))
        for _ in range(SHAPES):
            shown = disguised(kind, rolled(value, rng), rng, words)
            parts: list[tuple[str | None, str]] = [(kind, shown)]
            if rng.integers(3) == 0:
                other = kinds[rng.integers(len(kinds))]
                parts += [(None, (" ", " ", ", ", " / ", "; ")[rng.integers(5)]), (other, disguised(other, "", rng, words) if other != "email" else disguised(other, "x@y.z", rng, words))]
            elif rng.integers(4) == 0:
                parts += [(None, " " + harmless(rng))]
            if rng.integers(3) == 0 and before[-1:].strip():
                parts.insert(0, (None, (" ", ": ", " (", '"', "=")[rng.integers(5)]))
            out.append(placed(before, parts, after))
        out.append(placed(before, [(None, harmless(rng))], after))
    out += [(t[:TRAINING], []) for t in plain]
    return out


FIT = "sort string, text string, kind string, start int, stop int, mark long"


def training_windows(df: DataFrame, fit_documents: int = FIT_DOCUMENTS, fit_windows: int = FIT_WINDOWS) -> list[tuple[str, list[Span]]]:
    """Training windows from the spans of at most ``fit_documents`` documents, those with the smallest hash of their id, and at
    most ``fit_windows`` windows of each kind and as many without a span."""
    docs = documents(df).where("doc_id is not null")
    mark = F.xxhash64("doc_id")
    last = docs.select(mark.alias("mark")).distinct().orderBy("mark").limit(fit_documents).agg(F.max("mark")).first()[0]
    if last is None:
        return []

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, mark in zip(batch.column("text").to_pylist(), batch.column("mark").to_pylist(), strict=True):
                found = shapes(text)
                fine = lambda x: x[3] or x[0] == "ip" or (x[0] == "card" and 14 <= len(only_digits(text[x[1] : x[2]])) <= 19)
                # Matches that fail by their length are neither one thing nor the other: nothing is learned near them.
                unsure = [(s, e) for k, s, e, v in found if not fine((k, s, e, v)) and len(only_digits(text[s:e])) >= 9]
                known = [x for x in found if fine(x)]
                for kind, s, e, _ in known:
                    a, b = max(0, s - TRAINING), min(len(text), e + TRAINING)
                    if e - s <= TRAINING and not any(x < b and y > a for x, y in unsure) and sum(x[1] < b and x[2] > a for x in known) == 1:
                        rows.append(("span " + kind, text[a:b], kind, s - a, e - a, mark))
                for m in TRIGGER.finditer(text):
                    a = max(0, m.start() - TRAINING // 2)
                    if not any(x[1] < a + TRAINING and x[2] > a for x in known) and not any(x < a + TRAINING and y > a for x, y in unsure):
                        rows.append(("plain", text[a : a + TRAINING], None, 0, 0, mark))
                        break
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["sort", "text", "kind", "start", "stop", "mark"])

    drawn = docs.withColumn("mark", mark).where(F.col("mark") <= last).select("text", "mark").mapInArrow(windows, FIT)
    order = Window.partitionBy("sort").orderBy("mark", "start", "text")
    kept = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= fit_windows)
    rows = kept.orderBy("sort", "place").collect()
    spans = [(r["text"], r["kind"], r["start"], r["stop"]) for r in rows if r["kind"]]
    return examples(spans, [r["text"] for r in rows if not r["kind"]]) if spans else []


def fitted(df: DataFrame, fit_documents: int = FIT_DOCUMENTS, fit_windows: int = FIT_WINDOWS) -> Tagger | None:
    """The tagger of a table; None if the drawn documents hold no span."""
    windows = training_windows(df, fit_documents, fit_windows)
    return train(windows, KINDS, TRAINING) if windows else None


# ---- decoding


def window_starts(text: str) -> list[int]:
    """Starts of the windows, multiples of the stride, that hold a trigger."""
    out, last = [], -1
    for m in TRIGGER.finditer(text):
        low = max(last + 1, -(-max(0, m.start() - WINDOW + 1) // STRIDE))
        for k in range(low, m.start() // STRIDE + 1):
            out.append(k * STRIDE)
            last = k
    return out


Found = tuple[str, int, int, float, bool, bool]


def decoded(tagger: Tagger, jobs: list[tuple[int, str, int]]) -> Iterator[tuple[int, Found]]:
    """Spans (kind, start, end, score, open at the left, open at the right) of windows (row, text of the window, its start)."""
    for at in range(0, len(jobs), BATCH_WINDOWS):
        some = jobs[at : at + BATCH_WINDOWS]
        paths, above = tagger.decoded(np.stack([classes(t, WINDOW) for _, t, _ in some]))
        for i in np.flatnonzero(paths.any(axis=1)):
            row, text, start = some[i]
            for kind, s, e in spans_of(paths[i], tagger.kinds):
                e = min(e, len(text))
                if s < e:
                    yield row, (kind, start + s, start + e, float(above[i, s:e].sum()), s == 0 and start > 0, e == WINDOW)


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in " \t\n\r,;:\"'":
        start += 1
    while end > start and text[end - 1] in " \t\n\r,;:\"'.":
        end -= 1
    return start, end


def reconciled(text: str, known: list[Span], found: list[Found]) -> list[Span]:
    """The spans to add to ``known``: cut pieces joined, checked, disjoint from known ones, with the largest sum of scores."""
    found = sorted(set(found), key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    joined: list[list] = []
    for kind, s, e, score, left, right in found:
        last = joined[-1] if joined else None
        if last and last[0] == kind and s <= last[2] and (left or last[5]):
            # The same span seen from two windows, cut by the edge of one of them.
            whole = last[5] and not right if e >= last[2] else False
            last[2], last[3], last[5] = max(e, last[2]), max(score, last[3]), (right if e >= last[2] or whole else last[5])
        else:
            joined.append([kind, s, e, score, left, right])
    options: dict[Span, float] = {}
    for kind, s, e, score, _, _ in joined:
        s, e = trimmed(text, s, e)
        digit = lambda i: 0 <= i < len(text) and "0" <= text[i] <= "9"
        if s >= e or any(s < y and x < e for _, x, y in known) or not holds(kind, text[s:e]):
            continue
        # A value does not begin or end inside a number.
        if (digit(s) and digit(s - 1)) or (digit(e - 1) and digit(e)):
            continue
        options[kind, s, e] = max(score, options.get((kind, s, e), 0.0))
    # Disjoint spans with the largest sum: by end, the best sum up to each.
    spans = sorted(options, key=lambda x: (x[2], x[1], KINDS.index(x[0])))
    ends = [x[2] for x in spans]
    best, came = [0.0], []
    for i, x in enumerate(spans):
        before = int(np.searchsorted(ends[:i], x[1], side="right"))
        took = best[before] + max(options[x], 1e-6)
        came.append((took > best[-1], before))
        best.append(max(best[-1], took))
    out, i = [], len(spans)
    while i:
        took, before = came[i - 1]
        if took:
            out.append(spans[i - 1])
        i = before if took else i - 1
    return out[::-1]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def all_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """(base, added) of each text."""
    known = [base(t) for t in texts]
    found: list[list[Found]] = [[] for _ in texts]
    if tagger is not None:
        jobs: list[tuple[int, str, int]] = []
        for row, text in enumerate(texts):
            for start in window_starts(text):
                jobs.append((row, text[start : start + WINDOW], start))
                if len(jobs) == HELD_WINDOWS:
                    for at, span in decoded(tagger, jobs):
                        found[at].append(span)
                    jobs = []
        for at, span in decoded(tagger, jobs):
            found[at].append(span)
    return [(k, reconciled(t, k, f) if f else []) for t, k, f in zip(texts, known, found, strict=True)]


def personal_data(df: DataFrame, tagger: Tagger | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, ``spans`` (base and added), n_added; one row for
    each row of ``df``.

    Positions are code points, ends exclusive. Null and empty texts have no span; a null ``doc_id`` stays null; repeated rows are
    worked off each by itself; an empty table gives an empty result; further columns are ignored. Without a tagger nothing is
    added. A text of any length is read whole; its windows are decoded ``HELD_WINDOWS`` at a time.
    """
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                found = all_spans(piece.column("text").to_pylist(), tagger)
                counted = {f"n_{k}": pa.array([sum(x[0] == k for x in known) for known, _ in found], pa.int64()) for k in KINDS}
                yield record(
                    RESULT,
                    doc_id=piece.column("doc_id"),
                    **counted,
                    base_sha256=[hashlib.sha256(written(known).encode()).hexdigest() for known, _ in found],
                    spans=pa.array([written(known + more) for known, more in found], pa.string()),
                    n_added=pa.array([len(more) for _, more in found], pa.int64()),
                )

    return documents(df).mapInArrow(spans, RESULT)
