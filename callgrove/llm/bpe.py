"""Operator 1: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of byte positions. A bucket per merge rank holds the positions whose pair has that rank;
three levels of 64-bit words mark the ranks that have a bucket, so that find-first-set gives the lowest rank in three
steps. Merging leaves old entries in their buckets; an entry is stale when its position now has another pair.
The work is linear in the pre-token, which keeps pre-tokens of megabytes usable.

Defined results: a null text counts as the empty text; the empty text has no ids and decodes to no bytes; ids outside the
vocabulary make decoding fail; repeated rows are encoded alike; an input column named like an output column is replaced; an empty table gives
no rows. A long text comes in blocks of pre-tokens; a pre-token of megabytes takes some 60 bytes a byte.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgrove.llm.common import add_columns

#: Pre-tokens of a long text that are split off at once, new ones that go through the rank queue together, and numbers of any that are held.
BLOCK, QUEUED, HELD = 100_000, 20_000, 500_000
#: Bytes of pre-tokens and ids that a process keeps, and letters of the longest one that is kept.
KEPT_BYTES, LONGEST = 24 << 20, 200
#: Bytes of pre-tokens from which on numbers are held in arrays, and bytes whose first pairs are found at once.
LARGE, FILLED = 1 << 20, 1 << 22
#: Rows that are encoded together where they are short: their texts, ids and new pre-tokens are what a worker holds beside its memo.
ROWS = 512
#: Places of a bucket from which on they are merged at once.
WIDE = 32


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class RankQueueEncoder:
    """Encodes pre-tokens by merge ranks, all pre-tokens of a batch in one queue: byte 0xFF, which UTF-8 never has, parts them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.most = max(ranks.values(), default=0)
        self.edge = self.most + 1  # stands for byte 0xFF; bytes without a rank have numbers beyond it
        known = {bytes([b]): self.edge + 1 + b for b in range(255)} | ranks
        self.singles = np.array([*(known[bytes([b])] for b in range(255)), self.edge], np.int32)
        self.merges = {t: r for t, r in ranks.items() if len(t) > 1 and b"\xff" not in t}
        self.pairs = np.full(1 << 16, -1, np.int32)
        self.base = self.edge + 256
        joins = {}
        for token, rank in self.merges.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
            for k in range(1, len(token)):
                left, right = known.get(token[:k]), known.get(token[k:])
                if left is not None and right is not None:
                    joins[left * self.base + right] = rank
        self.keys = np.array([*sorted(joins), np.iinfo(np.int64).max], np.int64)
        self.joined = np.array([*map(joins.__getitem__, self.keys[:-1].tolist()), -1], np.int32)
        self.buckets: list[list[int]] = [[] for _ in range(self.most + 1)]
        self.low = [0] * ((self.most >> 6) + 1)
        self.mid = [0] * ((self.most >> 12) + 1)
        self.top = 0

    def mark(self, r: int) -> None:
        self.low[r >> 6] |= 1 << (r & 63)
        self.mid[r >> 12] |= 1 << (r >> 6 & 63)
        self.top |= 1 << (r >> 12)

    def first(self) -> int:
        """The lowest rank that has a bucket; its mark is taken away."""
        low, mid = self.low, self.mid
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | ((mid[a] & -mid[a]).bit_length() - 1)
        rank = b << 6 | ((low[b] & -low[b]).bit_length() - 1)
        low[b] &= low[b] - 1
        if not low[b]:
            mid[a] &= mid[a] - 1
            if not mid[a]:
                self.top &= self.top - 1
        return rank

    def fill(self, data: bytes, make: Callable[[], list | array]) -> array:
        """The rank of the pair that starts at each place, which goes into the bucket of its rank; a part of a long text at a time."""
        pair, buckets = array("i"), self.buckets
        for at in range(0, len(data), FILLED):
            codes = np.frombuffer(data[at : at + FILLED + 1], np.uint8).astype(np.uint16)
            first = self.pairs[codes[:-1] << 8 | codes[1:]] if len(codes) > 1 else np.zeros(0, np.int32)
            places = np.flatnonzero(first >= 0).astype(np.int32)
            places = places[np.argsort(first[places], kind="stable")]
            starts = np.flatnonzero(np.diff(first[places], prepend=-1)).tolist()
            for x, y in zip(starts, [*starts[1:], len(places)]):
                rank = int(first[places[x]])
                if not buckets[rank]:
                    self.mark(rank)
                    buckets[rank] = make()
                buckets[rank].extend((places[x:y] + at).tolist())
            pair.frombytes(first.tobytes())
        pair.extend([-1] * (len(data) + 1 - len(pair)))
        return pair

    def push(self, places: np.ndarray, ranks: np.ndarray) -> None:
        buckets, found = self.buckets, ranks >= 0
        for i, r in zip(places[found].tolist(), ranks[found].tolist()):
            if not buckets[r]:
                self.mark(r)
            buckets[r].append(i)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        return [np.frombuffer(x, "<u4").tolist() for x in self.pack(pieces)]

    def pack(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers.

        A bucket of WIDE places or more is merged at once, the first live place of each piece, and the others go back into the
        bucket; a smaller one, or one whose pieces have it often, is merged place by place.
        """
        data = b"\xff" + b"\xff".join(pieces) + b"\xff\xff"
        n = len(data)
        make = (lambda: array("i")) if n > LARGE else list  # numbers of four bytes where there are many, else the faster lists
        get, buckets = self.merges.get, self.buckets
        codes = np.frombuffer(data, np.uint8)
        after, before, token = (array("i", bytes(4 * (n + 1))) for _ in range(3))
        pair = self.fill(data, make)
        # the same numbers for numpy
        ends, starts, tokens, ranks = (np.frombuffer(x, np.int32) for x in (after, before, token, pair))
        ends[:], starts[:] = np.arange(1, n + 2), np.arange(-1, n)  # where the token that starts here ends; where the token before it starts
        tokens[:-1], tokens[-1] = self.singles[codes], self.edge
        piece = np.cumsum(codes == 0xFF, dtype=np.int32)
        while self.top:
            rank = self.first()
            bucket, buckets[rank] = buckets[rank], make()
            if len(bucket) >= WIDE:
                at = np.array(bucket, np.int32)
                at = np.sort(at[ranks[at] == rank])
                own = piece[at]
                leads = np.concatenate([[True], own[1:] != own[:-1]]) if len(at) else np.zeros(0, bool)
                many = int(np.count_nonzero(leads))
                if 2 * many >= len(at):
                    if many < len(at):
                        self.mark(rank)
                        buckets[rank].extend(at[~leads].tolist())
                        at = at[leads]
                    inner = ends[at]
                    end = ends[inner]
                    ends[at], starts[end], ranks[inner], tokens[inner], tokens[at] = end, at, -1, -1, rank
                    both = np.concatenate([at, starts[at]])
                    keys = np.concatenate([tokens[end] + np.int64(rank * self.base), tokens[starts[at]] * np.int64(self.base) + rank])
                    slot = np.searchsorted(self.keys, keys)
                    found = np.where(self.keys[slot] == keys, self.joined[slot], np.int32(-1))
                    ranks[both] = found
                    self.push(both, found)
                    continue
                bucket = at.tolist()
            elif len(bucket) > 1:
                bucket = sorted(bucket)  # equal ranks merge from the left
            for k, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale
                j = after[i]
                end = after[i] = after[j]
                before[end] = i
                pair[j] = token[j] = -1
                token[i] = rank
                r = pair[i] = get(data[i : after[end]], -1)
                lower = False
                if r >= 0:
                    lower = r < rank
                    if not buckets[r]:
                        self.mark(r)
                    buckets[r].append(i)
                h = before[i]
                r = pair[h] = get(data[h:end], -1)
                if r >= 0:
                    lower |= r < rank
                    if not buckets[r]:
                        self.mark(r)
                    buckets[r].append(h)
                if lower and k + 1 < len(bucket):  # a lower rank has come up: it goes first
                    if not buckets[rank]:
                        self.mark(rank)
                    buckets[rank].extend(bucket[k + 1 :])
                    break
        live = np.flatnonzero((tokens[:n] >= 0) & (codes != 0xFF))
        ids = tokens[live].astype("<u4")
        if len(ids) and int(ids.max()) > self.most:
            raise KeyError("a byte has no rank")
        cuts = [0, *(4 * np.cumsum(np.bincount(piece[live] - 1, minlength=len(pieces)))).tolist()]
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]


class Numbers(dict):
    """Numbers of pre-tokens, in the order in which they first came; long ones, which are not kept, have -1, -2 and so on."""

    def __init__(self, *given):
        super().__init__(*given)
        self.long: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        if len(word) > LONGEST:
            return self.long.setdefault(word, -1 - len(self.long))
        self[word] = n = len(self)
        return n


class TextEncoder:
    """Splits texts, and encodes each pre-token that its bounded memo lacks."""

    def __init__(self, path: str, pattern: str):
        self.split = regex.compile(pattern)
        self.queue = RankQueueEncoder(load_ranks(path))
        self.memo, self.ids, self.kept = Numbers(), [], 0  # ids[memo[word]]: the packed ids of a word
        self.used = np.zeros(0, np.int64)

    @property
    def long(self) -> dict[str, int]:
        return self.memo.long

    def learn(self) -> list[bytes]:
        """Finds the ids of all words that have a number and no ids yet; returns those of the long ones."""
        new = list(islice(reversed(self.memo), len(self.memo) - len(self.ids)))[::-1]
        for at in range(0, len(new), QUEUED):
            part = [w.encode() for w in new[at : at + QUEUED]]
            packed = self.queue.pack(part)
            self.ids += packed
            self.kept += 160 * len(part) + sum(map(len, part)) + sum(map(len, packed))
        return [self.queue.pack([w.encode()])[0] for w in self.long]

    def forget(self) -> None:
        """Beyond KEPT_BYTES the half of the words that came up most often stays, and what it counted weighs half."""
        if self.kept > KEPT_BYTES:
            stay = np.sort(np.argsort(-self.used, kind="stable")[: len(self.ids) // 2])
            words = list(self.memo)
            self.memo = Numbers((words[i], n) for n, i in enumerate(stay.tolist()))
            self.ids = [self.ids[i] for i in stay.tolist()]
            self.used = self.used[stay] // 2
            self.kept = 160 * len(self.ids) + sum(len(w.encode()) for w in self.memo) + sum(map(len, self.ids))

    def blocks(self, texts: list):
        """(place, pre-tokens) of all texts; a long text comes in several blocks."""
        for k, text in enumerate(texts):
            if text and len(text) < BLOCK:
                yield k, self.split.findall(text)
            elif text:
                found = self.split.finditer(text)
                while part := [m.group() for m in islice(found, BLOCK)]:
                    yield k, part

    def pack(self, texts: list) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; none for null."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, array]] = []

        def flush() -> None:
            long = self.learn()
            self.used = np.concatenate([self.used, np.zeros(len(self.ids) - len(self.used), np.int64)])
            for k, numbers in held:
                out[k].append(b"".join([self.ids[n] if n >= 0 else long[~n] for n in numbers] if long else map(self.ids.__getitem__, numbers)))
            if held:
                met = np.concatenate([np.frombuffer(numbers, np.int32) for _, numbers in held])
                self.used += np.bincount(met[met >= 0], minlength=len(self.used))
            held.clear()
            self.long.clear()
            self.forget()

        n = 0
        for k, part in self.blocks(texts):
            held.append((k, array("i", map(self.memo.__getitem__, part))))
            n += len(part)
            if n >= HELD or self.long or len(self.memo) - len(self.ids) >= QUEUED:
                flush()
                n = 0
        flush()
        return [b"".join(x) for x in out]


_loaded: dict = {}


def text_encoder(path: str, pattern: str) -> TextEncoder:
    """One for each process, so that tasks that follow each other share the memo."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = TextEncoder(path, pattern)
    return _loaded[path, pattern]


def binaries(values: list[bytes]) -> pa.Array:
    """A binary column from one buffer; a builder would grow to twice its size."""
    ends = np.cumsum([0, *map(len, values)])
    if ends[-1] > np.iinfo(np.int32).max:
        raise OverflowError("ids of a slice pass 2 GiB")
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(values))])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """df with the ids of each text, packed as little-endian unsigned 32-bit integers in a binary column; without keep_text the text goes."""

    def make():
        encoder = text_encoder(ranks_path, pattern)
        return lambda batch: [binaries(encoder.pack(batch.column(0).to_pylist()))]

    return add_columns(df, [(ids, T.BinaryType())], make, [text], ROWS, () if keep_text else (text,))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes that the packed ids stand for; null ids count as none."""

    def make():
        ranks = load_ranks(ranks_path)
        words: list = [None] * (max(ranks.values(), default=-1) + 1)
        for word, rank in ranks.items():
            words[rank] = word
        vocabulary = pa.array(words, pa.binary())

        def some(packed: pa.Buffer) -> bytes:
            taken = vocabulary.take(pa.Array.from_buffers(pa.uint32(), packed.size // 4, [None, packed]))
            if taken.null_count:
                raise IndexError("an id has no bytes")
            return taken.buffers()[2].to_pybytes()

        def plain(packed: bytes | None) -> bytes:
            whole = pa.py_buffer(packed or b"")
            return b"".join([some(whole.slice(at, min(4 * BLOCK, len(packed) - at))) for at in range(0, whole.size // 4 * 4, 4 * BLOCK)])

        return lambda batch: [[plain(x.as_py()) for x in batch.column(0)]]

    return add_columns(df, [(decoded, T.BinaryType())], make, [ids])


def token_digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of documents, encoded and decoded again."""
    got = decode(encode(df.select("doc_id", "text"), ranks_path, pattern, keep_text=False), ranks_path)
    return got.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
