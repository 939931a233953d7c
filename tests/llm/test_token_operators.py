"""Operators 1, 5 and 6 against their libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from callgrove.llm import bpe, token_counts, token_store
from tests.llm.data import empty, table, texts

RANKS = P.path("byte_bpe_50k.tiktoken")


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_round_trip(spark):
    docs, library = texts(), tiktoken_encoding()
    got = {r.doc_id: r for r in bpe.token_digests(table(spark, docs), RANKS, P.PATTERN).collect()}
    assert len(got) == len(docs)
    for k, text in docs.items():
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_lower_rank_comes_up():
    """A vocabulary whose merges bring up pairs of lower rank still merges the lowest first, from the left."""
    ranks = {bytes([b]): 50 + b for b in range(256)} | {b"ab": 9, b"abc": 2, b"ca": 5, b"aa": 3}
    queue = bpe.RankQueueEncoder(ranks)

    def plain(piece: bytes) -> list[int]:
        parts = [bytes([b]) for b in piece]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    pieces = [b"abcabc", b"aaaa", b"cababca", b"abab", b"a", b"caab" * 50]
    assert queue.encode(pieces) == [plain(p) for p in pieces]


def test_bpe_merges_wide_buckets_at_once(monkeypatch):
    """Buckets merged at once or place by place give the same ids, also where pieces repeat a pair or bring up lower ranks."""
    import random

    r = random.Random(11)
    small = {bytes([b]): 50 + b for b in range(256)} | {b"ab": 9, b"abc": 2, b"ca": 5, b"aa": 3, b"aab": 1, b"caab": 0, b"abca": 12}
    for ranks in (small, bpe.load_ranks(RANKS)):
        queue = bpe.RankQueueEncoder(ranks)

        def plain(piece: bytes) -> list[int]:
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
                i = min(pairs)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            return [ranks[p] for p in parts]

        pieces = ["".join(r.choice(letters) for _ in range(r.randrange(14))).encode() for letters in ("abc", "aab", " theanr", "éß日a") for _ in range(300)]
        for wide in (1, 8, 1 << 30):
            monkeypatch.setattr(bpe, "WIDE", wide)
            assert queue.encode([*pieces, b"ab" * 300]) == [plain(p) for p in [*pieces, b"ab" * 300]]
        assert not queue.top and not any(queue.buckets)
    with pytest.raises(KeyError):
        bpe.RankQueueEncoder({b"a": 0, b"b": 1, b"ab": 2}).encode([b"abc"])


def test_bpe_keeps_what_comes_often(monkeypatch):
    """A full memo keeps the words that come up most, so they are not encoded again; before, it forgot all."""
    encoder = bpe.TextEncoder(RANKS, P.PATTERN)
    monkeypatch.setattr(bpe, "KEPT_BYTES", 20_000)
    often, seen, plain = [f" often{chr(97 + i)}" for i in range(20)], [], encoder.queue.pack
    monkeypatch.setattr(encoder.queue, "pack", lambda pieces: seen.extend(pieces) or plain(pieces))
    library = tiktoken_encoding()
    for turn in range(40):
        text = "".join(often) * 5 + "".join(f" w{chr(97 + turn % 26)}{chr(97 + turn // 26)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
        assert np.frombuffer(encoder.pack([text])[0], "<u4").tolist() == library.encode_ordinary(text)
    assert all(seen.count(w.encode()) == 1 for w in often)
    assert encoder.kept <= bpe.KEPT_BYTES and len(encoder.memo) == len(encoder.ids) == len(encoder.used) < 200


def test_bpe_holds_little_at_once(spark, monkeypatch):
    """A worker has no more than a small slice of a large batch in hand, and texts that are not asked for stay there; before, it took four times that."""
    import random
    import tracemalloc

    import pyarrow as pa

    r = random.Random(5)
    words = [" " + "".join(r.choice("aeioulnrst") for _ in range(9)) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2048)), pa.array(["".join(r.choices(words, k=300)) for _ in range(2048)])], names=["doc_id", "text"])
    df = spark.createDataFrame([], "doc_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, work, schema: work)
        work = bpe.encode(df, RANKS, P.PATTERN, keep_text=False)
    bpe.text_encoder(RANKS, P.PATTERN).pack(["".join(words)])
    tracemalloc.start()
    n = 0
    for got in work(iter([batch])):
        assert got.schema.names == ["doc_id", "ids"]
        n += got.num_rows
        del got
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2048 and peak < 12 << 20


def test_bpe_in_arrays_and_parts(monkeypatch):
    """Long pre-tokens: numbers in arrays and first pairs found part by part give what lists give; they are not kept."""
    import random

    r = random.Random(7)
    pieces = ["".join(r.choice("abcdefgh") for _ in range(n)).encode() for n in (5000, 1, 700, 3000)]
    queue = bpe.RankQueueEncoder(bpe.load_ranks(RANKS))
    want = queue.encode(pieces)
    monkeypatch.setattr(bpe, "FILLED", 97)
    assert queue.encode(pieces) == want
    monkeypatch.setattr(bpe, "LARGE", 10)
    assert [list(x) for x in queue.encode(pieces)] == want
    library, text = tiktoken_encoding(), pieces[0].decode() + " so " + "x" * 1000 + " on"
    assert want == [library.encode_ordinary(p.decode()) for p in pieces]
    encoder = bpe.TextEncoder(RANKS, P.PATTERN)
    monkeypatch.setattr(bpe, "KEPT_BYTES", 300)
    for _ in range(3):
        assert np.frombuffer(encoder.pack([text, None, "one two"])[0], "<u4").tolist() == library.encode_ordinary(text)
        assert not encoder.long and max(map(len, encoder.memo)) <= bpe.LONGEST and len(encoder.memo) < 20


def test_bpe_pre_token_of_a_megabyte():
    text = "ab" * 700_000
    assert bpe.LARGE < len(text)
    got = np.frombuffer(bpe.TextEncoder(RANKS, P.PATTERN).pack([text])[0], "<u4")
    words = {rank: word for word, rank in bpe.load_ranks(RANKS).items()}
    assert b"".join(words[i] for i in got.tolist()).decode() == text


def test_bpe_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "ab cd", b"x", None)], "doc_id long, text string, ids binary, decoded string")
    got = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS).first()
    assert bytes(got.decoded) == b"ab cd" and got.doc_id == 1 and len(got) == 4
    assert bpe.encode(empty(spark), RANKS, P.PATTERN).count() == 0
    with pytest.raises(Exception, match="list index|IndexError"):
        bpe.decode(spark.createDataFrame([(b"\xff\xff\xff\x00",)], "ids binary"), RANKS).collect()


def test_token_store(spark):
    from tokenizers import Tokenizer

    docs, path = texts(), P.path("word_bpe_49k.json")
    folder = token_store.write_store(table(spark, docs), path, 2, 3)
    got = sorted(token_store.read_store(spark, folder).collect(), key=lambda r: r.doc_id)
    library, start = Tokenizer.from_file(path), 0
    for row, (k, text) in zip(got, sorted(docs.items()), strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (k, start, len(ids), zlib.crc32(ids.tobytes()))
        assert bytes(row.ids) == ids.tobytes()
        start += len(ids)
    some = token_store.read_store(spark, folder, wanted=[3, 71]).collect()
    assert sorted(r.doc_id for r in some) == [3, 71]
    assert token_store.read_store(spark, token_store.write_store(empty(spark), path, 2, 2)).count() == 0


def test_store_keeps_no_long_chunks():
    """Text without spaces is one chunk, and letters may be long; neither stays in the memos."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    own, library = token_store.ChunkTokenizer(path), Tokenizer.from_file(path)
    some = ["一二三" * 200 + "x1y2" * 300, "q" * 500 + "!", "short words, " * 3, "q" * 500]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.pack(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]
        assert max(map(len, own.chunks)) <= token_store.LONGEST and max(map(len, own.cores)) <= token_store.LONGEST


def test_store_ids_equal_the_library():
    """Odd and random texts, with the memos emptied in between, against the library on whole texts."""
    import random

    from tokenizers import Tokenizer

    path, r = P.path("word_bpe_49k.json"), random.Random(3)
    library, own = Tokenizer.from_file(path), token_store.ChunkTokenizer(path)
    odd = ["a\x00b", " \x00 x", "It's 5 o'clock <|endoftext|> x<|startoftext|>y", "É\u0301 e\u0301 İ ΑΣ\u00a0x\u2028y ß ªº µ", "'s 't", "", None, "x\x1cy\x85z", "ÀÉ..,ab ab,,cd", "ﬁ Ⅷ ² ½", "a" * 3000, *texts().values()]
    odd += ["".join(r.choice("aAbéÉ'. ,!1\u0301\x00ßΣ\u00a0\n\t\x1c日") for _ in range(r.randrange(60))) for _ in range(2000)]
    for at in range(0, len(odd), 300):
        got = own.pack(odd[at : at + 300])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t or "", add_special_tokens=False).ids for t in odd[at : at + 300]]
        own.chunks.clear()
    assert own.fits(path) and not own.fits(P.path("byte_bpe_50k.json"))
    other = token_store.WholeTokenizer(P.path("byte_bpe_50k.json"))
    assert np.frombuffer(other.pack(["It's 5"])[0], "<u4").tolist() == other.tokenizer.encode("It's 5", add_special_tokens=False).ids


def test_store_parts_marks_from_letters(monkeypatch):
    """Marks after a letter are taken off before chunks are looked up, so a word with other marks is no new chunk; ids stay the library's."""
    import random

    from tokenizers import Tokenizer

    path, r = P.path("word_bpe_49k.json"), random.Random(5)
    library, own = Tokenizer.from_file(path), token_store.ChunkTokenizer(path)
    some = ["so, so. so! so?! so... so.... SO: so;", None, ""]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.pack(some)] == [library.encode(t or "", add_special_tokens=False).ids for t in some]
    assert sorted(own.chunks) == sorted([b"so", b"SO", b"so....", b",", b".", b"!", b"?!", b"...", b":", b";"])
    assert own.pack([None, ""]) == [b"", b""] and own.pack([]) == []
    odd = ["<|endoftext|>.", "x<|endoftext|>,", "É. É\u0301. h\u0331. Σ. ΑΣ.ΑΣ: aΣ.b, ª. º, ×. ÷! ÿ. x1. 1a, a1.. a'.s a's. ,. .a .,;:!? a.,;:!?", "\x00. a\x00. a.\x00 a..\x00"]
    odd += ["".join(r.choice("aZéÿ×ªΣ1'. ,,!?:;..\u0301\u0338\x00 日") for _ in range(r.randrange(50))) for _ in range(3000)]
    monkeypatch.setattr(token_store, "MEMO", 500)
    monkeypatch.setattr(token_store, "CORES", 700)
    for at in range(0, len(odd), 100):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.pack(odd[at : at + 100])] == [library.encode(t, add_special_tokens=False).ids for t in odd[at : at + 100]]


def test_token_store_finds_damage(tmp_path):
    import io

    raw = io.BytesIO()
    store = token_store.StoreWriter(raw)
    store.add(5, np.arange(200_000, dtype="<u4").tobytes())
    store.add(None, b"\x01\x00\x00\x00")
    store.close()
    data = bytearray(raw.getvalue())
    reader = token_store.StoreReader(io.BytesIO(bytes(data)), len(data))
    assert b"".join(reader.parts(reader.index[0])) == np.arange(200_000, dtype="<u4").tobytes()
    assert reader.index["known"].tolist() == [1, 0] and len(reader.table) > 1
    data[40] ^= 0xFF
    with pytest.raises(Exception):
        broken = token_store.StoreReader(io.BytesIO(bytes(data)), len(data))
        b"".join(broken.parts(broken.index[0]))


def test_token_counts(spark):
    import random

    model = P.path("piece_bpe_32k.model")
    docs = texts()
    small = token_counts.PieceCounter(model, huge=200, chunk=150, overlap=8)
    r = random.Random(2)
    odd = [*docs.values(), *["".join(r.choice("ab 一二▁é\n 😀") for _ in range(1500)) for _ in range(10)], "a" * 1500, " " * 1500, "th" * 700]
    want = [len(small.model.encode(t)) if t else 0 for t in odd]
    assert small.counts(odd) == want
    got = {r.doc_id: r for r in token_counts.count_tokens(table(spark, docs), model).collect()}
    for (k, text), n in zip(docs.items(), want):
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((text or "").encode()), n > 4096)
    assert token_counts.count_tokens(empty(spark), model).count() == 0


def test_token_counts_widen():
    """Texts without a stable boundary in the first overlap, or in none."""
    small = token_counts.PieceCounter(P.path("piece_bpe_32k.model"), huge=200, chunk=150, overlap=8)
    for text, widens in (("the " * 100 + "一" * 3 + "th" * 60 + " 二 " + "a" * 400 + "三" + "b c" * 300, True), ("a" * 3000, True), ("一二三四五六七八九十" * 90, False)):
        before = small.widened
        assert small.counts([text]) == [len(small.model.encode(text))]
        assert (small.widened > before) == widens, text[:20]
