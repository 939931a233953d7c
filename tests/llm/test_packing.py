"""Packing: pieces against the library, placement against a plain version of the rule and the bound."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from callgrove.llm import packing
from tests.llm import data

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHITE = " \t\n\x0b\x0c\r\x1c\x85\xa0  　"


def library(texts):
    return [x.ids for x in Tokenizer.from_file(PATH).encode_batch_fast(texts, add_special_tokens=False)]


def test_chunks_equal_the_library():
    r = random.Random(5)
    parts = ["a", "Word", "don't", "'s", "é", "一二", "😀", "12", "...", "<|endoftext|>", " ", " ", " ", *WHITE, "́", "_", "\x00", "Ġ", "x" * 50]
    texts = ["", " ", "  ", " a", "a ", "a  b", "a \n b", "a\n b", "a \nb", "a\xa0 b", "<|endoftext|> <|endoftext|>"] + ["".join(r.choice(parts) for _ in range(r.randrange(1, 30))) for _ in range(3000)]
    tokenizer = packing.SpaceTokenizer(PATH)
    for _ in range(2):  # the second time from what is kept
        got = tokenizer.pack(pa.array(texts, pa.large_string()))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == library(texts)
        got = [tokenizer.pack(pa.array([t], pa.large_string()))[0] for t in texts[:200]]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == library(texts[:200])


def test_memo_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 10_000)
    tokenizer, r = packing.SpaceTokenizer(PATH), random.Random(1)
    for _ in range(30):
        texts = [" ".join(str(r.random()) for _ in range(20)) + " " + "y" * 5000]
        assert np.frombuffer(tokenizer.pack(pa.array(texts, pa.large_string()))[0], "<u4").tolist() == library(texts)[0]
        assert tokenizer.held <= 10_000 and all(len(x) <= packing.LONGEST for x in tokenizer.kept.values())


def plain_rule(lengths, limit):
    """All choices are tried on the whole histogram."""
    gaps, out = [], []
    for i, n in enumerate(lengths):
        best = None
        for gap, own in [*{g: k for k, (g, _) in enumerate(gaps) if g >= n}.items(), (limit, None)]:
            after = [g for k, (g, _) in enumerate(gaps) if k != own] + [gap - n]
            cost = sum(v * v for g, v in Counter(after).items() if 0 < g < limit)
            if best is None or (cost, gap) < best[:2]:
                best = (cost, gap, own)
        _, gap, own = best
        own_id = i if own is None else gaps[own][1]
        out.append((own_id, limit - gap))
        if own is not None:
            del gaps[own]
        if gap > n:
            gaps.append((gap - n, own_id))
    return out


def test_rule():
    r = random.Random(2)
    for limit, n in ((10, 60), (37, 80), (8, 40)):
        for _ in range(15):
            lengths = [r.randrange(1, limit + 1) for _ in range(n)]
            assert packing.sum_of_squares(lengths, limit) == plain_rule(lengths, limit)


def whole(rows, limit, count):
    """Documents come back from their pieces, sequences are gapless; returns how many there are."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.piece, r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    assert sum(map(len, docs.values())) == len(rows) and len(docs) == count
    return len(sequences)


def test_documents(spark):
    docs = data.texts() | {80: "two  spaces", 81: " lead", 82: "word " * 9000}
    rows = [(k, v, "x", 1, 2) for k, v in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, length long, sequence_id long").repartition(3)
    got = packing.pack_documents(df, PATH, 0, 2048, with_ids=True).collect()
    n = whole(got, 2048, len(docs))
    ids = dict(zip(docs, library([t or "" for t in docs.values()]), strict=True))
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.piece):
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == len(by[r.doc_id]) and r.length == len(own) and r.ids_crc32 == zlib.crc32(r.ids) and (r.piece == 0 or r.length == 2048)
        by[r.doc_id] += own
    assert by == {k: [*v, 0] for k, v in ids.items()}
    assert n <= -(-sum(len(v) for v in by.values()) // 2048) + 2


def test_groups_and_repeats(spark):
    r = random.Random(3)
    rows = [(None if k % 7 == 0 else 5, "w " * r.randrange(0, 90)) for k in range(400)]
    cut = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pieces = packing.written(packing.pieces(cut, PATH, 0, 64), "pieces")
    got = packing.packed(pieces, 64, group=50).collect()
    assert len({x.key for x in got}) == len(got) == pieces.count()
    total, sequences = sum(x.length for x in got), defaultdict(list)
    for x in got:
        sequences[x.sequence_id].append((x.offset, x.length))
    for own in sequences.values():
        assert sum(n for _, n in own) <= 64 and [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))]
    assert len(sequences) <= total / 64 * 1.1 + 10
    assert packing.pack_documents(data.empty(spark), PATH, 0, 2048).count() == 0
