"""Phrases against plain counting, for several depths, small shards and blocks, and a bitmap that lets all pass."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from callgrove.llm import phrases
from tests.llm import data


def plain(docs, longest=3, least=10, share=50, top=2000):
    n, f = Counter(), Counter()
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
    f = {p: c for p, c in f.items() if c >= least}
    found = {}
    for (lang, p), a in f.items():
        inside = [c for (other, q), c in f.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))] if len(p) > 1 else []
        if len(p) > 1 and not any(100 * c >= share * a for c in inside):
            cuts = [(int(Fraction(1_000_000 * a * a, f[lang, p[:k]] * f[lang, p[k:]]) // 1), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, own in found.items() for rank, (score, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def corpus(seed, n=150):
    r = random.Random(seed)
    common = ["the", "of", "New", "York", "new", "city", "é", "É", "一", "x\x00y"]
    text = lambda: "".join(r.choice(common) + r.choice([" "] * 12 + [", ", ".", "\n", "\t", "  ", "\x0b"]) for _ in range(r.randrange(0, 120)))
    return [(r.choice(["en", "en", "en", "fr", None]), text() if r.random() < 0.95 else r.choice([None, "", " ", "...", "ab " * 400])) for _ in range(n)]


@pytest.mark.parametrize(("longest", "least", "top", "shard"), [(3, 10, 2000, 1 << 21), (3, 2, 7, 300), (4, 3, 50, 500), (2, 10, 2000, 100)])
def test_mine(spark, longest, least, top, shard):
    docs = corpus(longest * 10 + least)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3).selectExpr("*", "1 AS a", "2 AS phrase", "3 AS k")
    got = phrases.mine(df, longest, least, 50, top, shard).collect()
    assert sorted(map(tuple, got)) == plain(docs, longest, least, 50, top)
    assert not df.limit(0).count() and phrases.mine(df.limit(0), longest, least, 50, top).count() == 0


def test_full_bitmap_gives_the_same(spark):
    df = spark.createDataFrame(corpus(1), "lang string, text string").repartition(2)
    bitmap = phrases.frequent_buckets(phrases.count_buckets(df), 10)
    few = phrases.phrase_counts(df, bitmap, 3, 10, 500)
    full = phrases.phrase_counts(df, np.full_like(bitmap, 255), 3, 10, 500)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, full.collect()))
    assert 0 < np.unpackbits(bitmap).sum() < 2000


def test_clashes_and_common_texts(spark):
    docs = [(t, "en") for t in data.texts().values()] * 3
    got = phrases.mine(spark.createDataFrame(docs, "text string, lang string"), top=50).collect()
    assert sorted(map(tuple, got)) == plain([(lang, t) for t, lang in docs], top=50)


def test_blocks_keep_pieces_whole():
    texts = ["a b. c d", None, "e " * 40 + ". f", "g h" * 30, "", ". . i j"]
    batch = pa.RecordBatch.from_arrays([pa.array(["x", None, "y", "y", "x", "x"]), pa.array(texts)], names=["lang", "text"]).slice(0)
    want = [(lang or "und", tuple(p.split())) for lang, t in zip(["x", None, "y", "y", "x", "x"], texts) for p in (t or "").split(".") if p.split()]
    for size in (1, 7, 30, 1000):
        got = []
        for block, langs, names in phrases.blocks(batch, size):
            words = [w.decode() for w in block.words.to_pylist()]
            for w, t, new in zip(words, block.text, block.new_piece, strict=True):
                if new:
                    got.append((names[langs[t]], []))
                got[-1][1].append(w)
        assert [(lang, tuple(p)) for lang, p in got] == want


def test_index_steps():
    r = random.Random(4)
    symbols = np.array([0, *[r.randrange(0, 4) for _ in range(300)], 0], np.int32)
    index = phrases.BidirectionalIndex(symbols, 4)
    text = symbols.tolist()
    word, ahead, behind, counts = index.words()
    state = [((int(w),), a, b, c) for w, a, b, c in zip(word, ahead, behind, counts)]
    for side in "lrlr"[:3]:
        own, other = ([s[1] for s in state], [s[2] for s in state])
        if side == "l":
            owner, symbol, ahead, behind, counts = index.extended(index.forward, np.array(own), np.array(other), np.array([s[3] for s in state]))
        else:
            owner, symbol, behind, ahead, counts = index.extended(index.back, np.array(other), np.array(own), np.array([s[3] for s in state]))
        state = [((int(x), *state[o][0]) if side == "l" else (*state[o][0], int(x)), a, b, c) for o, x, a, b, c in zip(owner, symbol, ahead, behind, counts)]
        n = len(state[0][0])
        want = Counter(tuple(text[i : i + n]) for i in range(len(text) - n + 1) if 0 not in text[i : i + n])
        assert {s[0]: int(s[3]) for s in state} == want
