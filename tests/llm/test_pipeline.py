"""Each stage on what the one before kept, against plain versions."""

from __future__ import annotations

import os
import zlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_text_ops import edit, groups
from tokentally.llm import pii, quality
from tokentally.llm.queries import PII_KEY, tokenizer_file
from tokentally.llm.shared import lower_ascii, split_words
from tokentally.llm.tokens import PieceEncoder

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pseudonyms", "packing"]
    model = quality.train_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = {r.doc_id: r for r in docs.collect()}
    want = {d: r for d, r in rows.items() if model.score([r.text])[0] >= 0.3}
    steps = [want]
    at = groups([(d, r.text) for d, r in want.items()])
    steps.append({d: r for d, r in want.items() if at[d][1] == d})
    items = [split_words(lower_ascii(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]

    def leaks(t):
        w = split_words(lower_ascii(t))
        have = set(w)
        return any(sum(x in have for x in i) >= len(i) - len(i) // 4 and edit(i, w) <= len(i) // 4 for i in items)

    steps.append({d: r for d, r in steps[-1].items() if not leaks(r.text)})
    f = pii.Feistel(PII_KEY)
    now = docs
    for (name, stage), kept in zip(corpus_pipeline.STAGES[:3], steps, strict=True):
        now = stage(spark, now, DATA).cache()
        assert now.columns == docs.columns and {r.doc_id: r for r in now.collect()} == kept and now.count() == len(kept), name
    assert len(rows) > len(steps[0]) > len(steps[1]) > len(steps[2]) > 0
    now = corpus_pipeline.pseudonyms(spark, now, DATA).cache()
    texts = {d: pii.pseudonymise_text(r.text, f)[0] for d, r in steps[2].items()}
    assert now.columns == docs.columns and {r.doc_id: r.text for r in now.collect()} == texts
    packed = corpus_pipeline.packing(spark, now, DATA).collect()
    enc = PieceEncoder(tokenizer_file("word_bpe_49k.json"))
    want = {}
    for d, t in texts.items():
        data = enc.encode([t])[0] + b"\0\0\0\0"
        want |= {(d, i // 8192): (i // 4, len(data[i : i + 8192]) // 4, zlib.crc32(data[i : i + 8192])) for i in range(0, len(data), 8192)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed} == want and len(packed) == len(want)
    fill = {}
    for r in sorted(packed, key=lambda r: r.offset):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1
    assert entry.queries()["pipeline"](spark, DATA).count() == len(want)
