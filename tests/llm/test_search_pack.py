from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pytest

from tokentally.llm import binpack, packing, tokens, vptree
from tokentally.llm.queries import tokenizer_file

ODD = ["", " ", "a  b", " x y ", "a\n b", "x\n\ny", "foo\n", "\nfoo bar. baz,\nqux! a", "x<|endoftext|> y", "don't, y'all're. 5, a5.", "é ́a \t q", "A\x1cb c\x85d e f", "日本 語", "q "]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_encode_exactly(name, words):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choices(words, k=rng.randrange(0, 300))) for _ in range(40)] + ["word " * 30_000]
    enc = tokens.PieceEncoder(tokenizer_file(name), limit=300)
    want = [np.asarray(e.ids, dtype="<u4").tobytes() for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts[:20]) + enc.encode(texts[20:]) == want and enc.encode([None]) == [b""]


def test_bit_packing_round_trip():
    rng = np.random.default_rng(1)
    for bits in (1, 3, 7, 8, 13, 16, 17, 31, 32):
        ids = rng.integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
        f = binpack.PackedFile(binpack.write_file(ids, [5, None, 7], [10, 0, 990], bits, block_ids=37))
        assert (f.all() == ids).all() and (f.document(0) == ids[:10]).all() and len(f.document(1)) == 0
        assert all((f.ids(a, n) == ids[a : a + n]).all() for a, n in ((0, 1), (36, 2), (500, 300), (999, 50)))
    assert len(binpack.PackedFile(binpack.write_file(np.zeros(0, np.uint32), [], [], 5)).all()) == 0


def test_token_files(spark, documents, words):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(60)] + [(70, None), (71, ""), (5, "again"), (5, "again"), (None, "no id"), (80, "long " * 20_000)]
    rng.shuffle(rows)
    got = binpack.token_files(documents(rows), tokenizer_file("byte_bpe_50k.json"), 2, with_ids=True).collect()
    enc, at = tokens.PieceEncoder(tokenizer_file("byte_bpe_50k.json")), 0
    want = []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        data = enc.encode([t])[0] + b"\2\0\0\0"
        want.append((d, at, len(data) // 4, zlib.crc32(data), data))
        at += len(data) // 4
    assert sorted(map(repr, [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got])) == sorted(map(repr, want))
    assert binpack.token_files(documents([]), tokenizer_file("byte_bpe_50k.json"), 2).count() == 0


def test_token_files_of_odd_width(spark, documents, words, tmp_path):
    """17 bits an id: the packer itself, in files of a few documents; equal and null ids in any number."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for i in range(40)] + [(None, None)] * 30 + [(3, "same")] * 30 + [(50, "long " * 30_000)]
    rng.shuffle(rows)
    files = binpack.write_packed(documents(rows), f"file://{tmp_path}/files", tokenizer_file("byte_bpe_50k.json"), 70_000, file_ids=200, block_ids=37).collect()
    assert len(files) > 5
    before, listed = 0, []
    for f in sorted(files, key=lambda f: (f.part, f.seq)):
        listed.append((f.file, before))
        before += f.n_ids
    assert binpack.PackedFile(open(files[0].file.removeprefix("file://"), "rb").read()).bits == 17
    got = sorted(binpack.read_packed(spark, listed).collect(), key=lambda r: r.start)
    enc = tokens.PieceEncoder(tokenizer_file("byte_bpe_50k.json"))
    code = lambda t: enc.encode([t])[0] + np.array([70_000], "<u4").tobytes()
    assert [r.doc_id for r in got] == sorted([d for d, _ in rows], key=lambda d: (d is not None, d)) and before == sum(r.n_tokens for r in got)
    assert sorted((repr(r.doc_id), bytes(r.ids)) for r in got) == sorted((repr(d), code(t)) for d, t in rows) and all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)


def test_fullest_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(0, 6))}
        room = rng.randrange(0, 60)
        used = packing.fullest(counts, room)
        reach = {0}
        for k, n in counts.items():
            reach = {r + k * i for r in reach for i in range(n + 1) if r + k * i <= room}
        assert sum(k * n for k, n in used.items()) == max(reach) and all(n <= counts[k] for k, n in used.items())


def test_packing(spark, documents, words):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([3, 20, 20, 90, 400])))) for i in range(150)] + [(200, None), (201, ""), (7, "twice"), (7, "twice"), (None, "none"), (300, "word " * 40_000)]
    got = packing.pack_documents(documents(rows), tokenizer_file("word_bpe_49k.json"), 256, 0, keep_ids=True).toPandas()
    enc = tokens.PieceEncoder(tokenizer_file("word_bpe_49k.json"))
    want = sorted((repr(d), enc.encode([t])[0] + b"\0\0\0\0") for d, t in rows)
    whole = [(repr(None if pd.isna(d) else int(d)), s) for d, s in zip(got.doc_id, got.start, strict=True)]
    by = {}
    for (d, s), r in zip(whole, got.itertuples(), strict=True):
        by.setdefault((d, len(by) if d in ("7",) else 0), []).append((s, bytes(r.ids)))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    texts = sorted((d, b"".join(x for _, x in sorted(p))) for (d, _), p in by.items())
    assert texts == want
    total = 0
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256
        total += 1
    assert total <= 1.02 * -(-got.length.sum() // 256) + 1
    assert packing.pack_documents(documents([]), tokenizer_file("word_bpe_49k.json")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def brute(rows, every, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = set()
    for i, v in ok:
        if i % every == 0:
            d = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in ok if j != i and len(w) == len(v))
            out |= {(i, r, j) for r, (_, j) in enumerate(d[:k], 1)}
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), "s") for i in range(900)] + [(1000 + i, [1.0] * 8, "s") for i in range(300)]
    rows += [(2000, None, "s"), (2010, [0.0] * 8, "s"), (2020, [float("nan")] * 8, "s"), (2030, [None] * 8, "s"), (None, [1.0] * 8, "s"), (2040, [1.0, 2.0], "s"), (2050, [2.0, 2.0], "s"), (2060, [], "s")]
    index = vptree.build_index(vectors(spark, rows), shard_rows=200).cache()
    q = vectors(spark, rows).where("vec_id % 10 = 0")
    exact = vptree.search_index(index, q, 10, block_queries=40).toPandas()
    assert set(zip(exact.query_id, exact["rank"], exact.vec_id, strict=True)) == brute(rows, 10, 10)
    by_id = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and i < 2000}
    assert all(r.score == np.sqrt(((by_id[r.query_id] - by_id[r.vec_id]) ** 2).sum()) or abs(r.score - np.sqrt(((by_id[r.query_id] - by_id[r.vec_id]) ** 2).sum())) < 1e-12 for r in exact.itertuples() if r.query_id < 2000)
    loose = vptree.search_index(index, q, 10, factor=2.0).toPandas()
    assert 0.9 <= vptree.recall(loose, exact) <= 1
    assert vptree.nearest(vectors(spark, [])).count() == 0


def test_repeated_ids_have_scores_of_their_own(spark):
    rows = [(0, [0.0, 1.0], "s"), (5, [0.0, 2.0], "s"), (5, [5.0, 5.0], "s"), (5, [0.0, 2.0], "s"), (7, [1.0, 1.0], "s"), (0, [9.0, 9.0], "s")]
    got = vptree.nearest(vectors(spark, rows)).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in got] == [(0, 1, 5, 1.0), (0, 2, 5, 1.0), (0, 3, 7, 1.0), (0, 4, 5, round(41**0.5, 6))]


def test_pruning_visits_less():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(4000, 3))
    tree = vptree.Tree.load(vptree.Tree.build(np.arange(4000), points).dump())
    seen = [tree.search(np.arange(50), points[:50], 5, f)[2] for f in (1, 2, 4)]
    assert seen[0] < 0.5 * 50 * 4000 and seen[0] > seen[1] > seen[2]


def test_permuted_vectors_are_ranked_by_their_scores(spark):
    """Vectors at the same distance but for rounding: the ten returned are the ten smallest scores, in every trial."""
    rng = np.random.default_rng(7)
    for trial in range(50):
        base = rng.normal(size=24)
        points = np.array([rng.permutation(base) for _ in range(150)]).astype(np.float32).astype(np.float64)
        query = np.zeros((1, 24))
        tree = vptree.Tree.build(np.arange(150), points, seed=trial)
        best, who, _ = tree.search(np.array([-1]), query, 10)
        want = sorted((float(vptree.scores_between(query, points[i : i + 1])[0, 0]), i) for i in range(150))[:10]
        assert list(zip(best[0].tolist(), tree.ids[who[0]].tolist(), strict=True)) == want


def test_lanes(spark, monkeypatch):
    """Several blocks, lanes and shards give what one of each gives."""
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(300)], "vec_id long, embedding array<double>")
    one = vptree.search_index(vptree.build_index(vectors), vectors, 5).collect()
    monkeypatch.setattr(vptree, "LANE", 2)
    assert sorted(vptree.search_index(vptree.build_index(vectors, 50), vectors, 5, block_queries=40).collect()) == sorted(one)
    few = vectors.where("vec_id < 9")  # more shards than rows: some are empty
    assert sorted(vptree.search_index(vptree.build_index(few, 1), few, 20, block_queries=2).collect()) == sorted(vptree.search_index(vptree.build_index(few), few, 20).collect())
