import os
import subprocess
import sys

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from fileguard.llm.decontamination import normalised
from fileguard.llm.packing import boundaries
from tests.llm.cases import documents, near, rows
from tests.llm.test_rules_and_chat import measured
from tests.llm.test_scans_and_packing import least_edits, padding

SF = "/root/testdata/sf0.001"


def without_repeats(items, length=100):
    seen, out = set(), []
    for doc_id, text in sorted(items):
        raw = text.encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        if kept or not raw:
            out.append((doc_id, kept.decode("utf-8", "ignore")))
    return out


def test_run_against_brute_force(spark):
    items = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    kept = corpus_pipeline.quality(spark, documents(spark), SF)
    first = {r["doc_id"] for r in kept.collect()}
    assert first <= {d for d, t in items if not measured(t)[-1]}
    items = [(d, t) for d, t in items if d in first]
    lead = {d for d, _, _, kept in near(items, 5) if kept}
    items = [(d, t) for d, t in items if d in lead]
    items = without_repeats(items)
    bench = [normalised(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def holds(text, item):
        # Some piece stands unchanged in the text, or the item cannot be in it.
        k = int(len(item) * 0.08)
        pieces = [item[len(item) * i // (k + 1) : len(item) * (i + 1) // (k + 1)] for i in range(k + 1)]
        return any(p in text for p in pieces) and least_edits(item, text) <= k

    items = [(d, t) for d, t in items if not any(holds(normalised(t), b) for b in bench)]
    found = corpus_pipeline.run(spark, SF).collect()
    codes = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch([t for _, t in items], add_special_tokens=False)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in found) == sorted((d, len(c)) for (d, _), c in zip(items, codes, strict=True))
    lengths = sorted({r["n_tokens"] for r in found})
    counts = [sum(r["n_tokens"] == n for r in found) for n in lengths]
    assert sum(r["boundary"] - r["n_tokens"] for r in found) == padding(boundaries(lengths, counts, 16), lengths, counts)


def test_stages_keep_the_columns(spark):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert rows(corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), SF)) == []


def test_entry_works_without_the_text_operators(tmp_path):
    """The registry imports, and registers the rest, when llm/ and corpus_pipeline.py are gone."""
    top = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('fileguard.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        f"sys.path.insert(0, {top!r})\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert len(q) > 60 and not any(n.startswith('op') or n == 'pipeline' for n in q), q\n"
        "assert set(e.oracle_sql()) <= set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
