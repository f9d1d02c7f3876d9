"""The pipeline against a plain version of each stage."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import bpe, quality

from .test_exact import PII, plain_targets, spans_of, true_classes

SF = "/root/testdata/sf0.01"


def kept_by_rules(text):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper_words")
    found = dict(zip(names, quality.measure(text.encode())))
    return not any(eval(rule, {}, found) for _, rule in quality.RULES)  # noqa: S307  the rules are arithmetic


def plain_redacted(text):
    out, at = "", 0
    for a, b in sorted(s for spans in spans_of(text, PII) for s in spans):
        if a >= at:
            out += text[at:a] + "[redacted]"
        at = max(at, b)
    return out + text[at:]


def test_pipeline(spark):
    from tokenizers import Tokenizer

    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()
    good = [(i, t) for i, t, _ in rows if kept_by_rules(t)]
    firsts = {min(c) for c in true_classes(good)}
    texts = {i: plain_redacted(t) for i, t in good if i in firsts}
    got = corpus_pipeline.run(spark, SF).collect()
    copies = Counter(r.doc_id for r in got)
    assert set(copies) <= set(texts) and max(copies.values()) <= 2
    assert all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in got)
    source, sizes, taken = {i: s for i, _, s in rows}, defaultdict(int), defaultdict(int)
    for i, t in texts.items():
        sizes[source[i]] += len(t.encode().split())
        taken[source[i]] += copies[i] * len(t.encode().split())
    goal = plain_targets(sizes)
    assert all(abs(taken[s] - goal[s]) <= 0.03 * goal[s] + 30 for s in sizes)
    library = Tokenizer.from_file(bpe.default_vocabulary())
    for r in got:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_stages_are_named_and_lazy(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "minhash near-dedup", "pii", "mixing sources to target weights", "bpe encoding and decoding"]
    docs = spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert corpus_pipeline.STAGES[0][1](spark, docs, SF).where(F.lit(True)).count() == 0
