"""Operator 12: documents packed into sequences of bounded length by the sum-of-squares rule.

Texts are encoded once and leave as pieces; the pieces' lengths alone are dealt to groups and packed. In a group the rule keeps
N(g), the number of open sequences with g free places, and puts a piece where the sum of the squares of all N(g) becomes smallest: taking a
sequence from gap g to gap h changes it by 2 * (N(h) - N(g) + 1), filling one up by 1 - 2 * N(g), and opening one by 1 + 2 * N(h);
full and untouched sequences do not count. All gaps are compared at once. The rule is for pieces in any order; here
those of a fifth of the limit and more come by falling length and the shorter ones after them in hashed order, which leaves
a tenth of a percent of sequences over the bound (README). Groups hold a bounded number of pieces whatever the input, by a hash of their row.

Defined results: a null or empty text is the end id alone; a document longer than the limit is cut so that only its first piece is shorter;
equal rows are packed each for itself; ties between gaps go to the smallest gap, then to a new sequence, then to the sequence
opened or changed last; rows of null or equal doc_id are rows like all others; an empty table gives no rows; other columns, whatever their names, do
not count. Very long texts are encoded whole, and a task holds one at a time.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrove.llm.common import written

#: Pieces of a group; the share of the limit from which on pieces come by falling length.
GROUP, LARGE = 1 << 15, 5
#: Rows and bytes of text that a task encodes at once; bytes of a kept chunk and of all that are kept.
SLICE_ROWS, SLICE_BYTES, LONGEST, KEPT = 4096, 12 << 20, 64, 160 << 20
#: A word of plain letters with a few marks after it: two pre-tokens.
MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]{1,3})").fullmatch
#: A space after white space (more of it than any library's class holds): chunks can't be told apart there.
ODD = r"[\s\x{1C}-\x{1F}\x0B\x{85}\p{Z}] "


class SpaceTokenizer:
    """Ids by the tokenizers library for byte-level vocabularies: a chunk begins at each space that follows no white space.

    The library's pre-tokens begin there too, so chunks are encoded apart and kept. Many new chunks go to the library as one
    text: a token that begins with a space begins a chunk. Marks after plain letters are encoded apart from them. Texts with a space after white space go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.kept, self.held, self.marks = Tokenizer.from_file(path), {}, 0, {}
        config = json.loads(self.tokenizer.to_str())
        split = config["pre_tokenizer"] or {}
        plain = not config["normalizer"] and (config["truncation"], config["padding"]) == (None, None) and not any(x["lstrip"] or x["rstrip"] or " " in x["content"] for x in config["added_tokens"])
        if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
            raise ValueError("the vocabulary is not byte-level without a normaliser")
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def chunks(self, words: list[str]) -> list[bytes]:
        """Packed ids of words with a space before them."""
        alone = {w for w in words if not w or w[-1].isspace()}
        others = [w for w in words if w not in alone]
        out = dict(zip(alone, self.ids([f" {w}" for w in alone]), strict=True))
        for at in range(0, len(others), 4096):
            some = others[at : at + 4096]
            (packed,) = self.ids(["".join([f" {w}" for w in some])])
            cuts = (4 * np.flatnonzero(self.begins[np.frombuffer(packed, "<u4")])).tolist()
            out.update(zip(some, [packed[a:b] for a, b in zip(cuts, [*cuts[1:], len(packed)])], strict=True))
        return [out[w] for w in words]

    def known(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct words; short ones without marks are kept up to a bound in bytes, marks after letters are encoded apart."""
        got = list(map(self.kept.get, words))
        missing = [(i, words[i], MARKED(words[i])) for i, x in enumerate(got) if x is None]
        wanted = dict.fromkeys(m[1] if m else w for _, w, m in missing)
        new = [w for w in wanted if w not in self.kept]
        fresh = dict(zip(new, self.chunks(new), strict=True))
        for i, w, m in missing:
            core = m[1] if m else w
            ids = fresh.get(core) or self.kept[core]
            if m and m[2] not in self.marks:
                (self.marks[m[2]],) = self.ids([m[2]])
            got[i] = ids + self.marks[m[2]] if m else ids
        short = {w: x for w, x in fresh.items() if len(x) <= LONGEST}
        size = sum(map(len, short.values())) + 150 * len(short)
        if self.held + size > KEPT:
            self.kept, self.held = {}, 0
        self.kept.update(short)
        self.held += size
        return got

    def pack(self, texts: pa.Array) -> list[memoryview]:
        """Packed ids of each text (none is null)."""
        is_odd = pc.match_substring_regex(texts, ODD)
        split = pc.split_pattern(pc.if_else(is_odd, pa.scalar("", texts.type), texts), " ")
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        flat = split.flatten()
        coded = flat.dictionary_encode()
        firsts, place = np.unique(coded.indices.to_numpy()[offsets[:-1]], return_inverse=True)
        words = coded.dictionary.to_pylist()
        values = [*self.known(words), *self.ids([words[i] for i in firsts])]
        codes = coded.indices.to_numpy().astype(np.int64)
        codes[offsets[:-1]] = len(words) + place
        taken = pa.array(values, pa.large_binary()).take(pa.array(codes))
        ends = np.frombuffer(taken.buffers()[1], "<i8", len(taken) + 1)[offsets].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        out = [data[a:b] for a, b in zip(ends, ends[1:])]
        for i in np.flatnonzero(is_odd.to_numpy(zero_copy_only=False)):
            out[i] = memoryview(self.ids([texts[int(i)].as_py()])[0])
        return out


_loaded: dict[str, SpaceTokenizer] = {}


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts within SLICE_ROWS and SLICE_BYTES; a longer text is a run of its own."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > start and (held + n > SLICE_BYTES or i - start == SLICE_ROWS):
            yield start, i
            start, held = i, 0
        held += n
    if len(texts):
        yield start, len(texts)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, limit: int, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) as pieces: key (a number of the row's own), doc_id, piece, start, length, ids_crc32 and, if asked for, the packed ids."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["key", "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if tokenizer_path not in _loaded:
            _loaded[tokenizer_path] = SpaceTokenizer(tokenizer_path)
        tokenizer, key = _loaded[tokenizer_path], TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = pc.cast(pc.fill_null(batch.column(1), ""), pa.large_string())
            for low, high in slices(texts):
                rows = []
                for doc_id, ids in zip(batch.column(0)[low:high].to_pylist(), tokenizer.pack(texts[low:high]), strict=True):
                    n = len(ids) // 4 + 1
                    first = n - limit * (-(-n // limit) - 1)
                    stops = range(first, n + 1, limit)
                    for k, stop in enumerate(stops):
                        start = max(0, stop - limit) if k else 0
                        part, last = ids[4 * start : 4 * stop], stop == n  # the end id lies past the ids
                        crc = zlib.crc32(end, zlib.crc32(part)) if last else zlib.crc32(part)
                        rows.append((key, doc_id, k, start, stop - start, crc, *[bytes(part) + end * last] * with_ids))
                        key += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    schema = "key long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def sum_of_squares(lengths: list[int], limit: int) -> list[tuple[int, int]]:
    """For each length, in the order given, the number of the piece that opened its sequence, and its offset there."""
    count, open_at, out = np.zeros(limit + 1, np.int64), [[] for _ in range(limit + 1)], []
    for i, n in enumerate(lengths):
        new = 1 + 2 * count[limit - n] if n < limit else 0
        gap = limit
        if n < limit:
            change = 2 * (count[: limit - n] - count[n:limit] + 1)
            change[0] = 1 - 2 * count[n]
            change[count[n:limit] == 0] = new + 1
            if change[best := int(change.argmin())] <= new:
                gap = best + n
        own = i
        if gap < limit:
            own = open_at[gap].pop()
            count[gap] -= 1
        if gap > n:
            open_at[gap - n].append(own)
            count[gap - n] += 1
        out.append((own, limit - gap))
    return out


def packed(cut: DataFrame, limit: int, group: int = GROUP) -> DataFrame:
    """Pieces (key, length and more; a table that can be read twice) with sequence_id and offset. Whole pieces are sequences by themselves."""
    groups = -(-cut.where(F.col("length") < limit).count() // group) or 1
    of_group = F.pmod(F.xxhash64("key"), F.lit(groups))

    def place(table: pa.Table) -> pa.Table:
        keys, lengths = table["key"].to_numpy(), table["length"].to_numpy()
        mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)  # an order of its own, the same on each run
        large = lengths * LARGE >= limit
        order = np.lexsort((keys, mixed, np.where(large, -lengths, 0), ~large))
        got = np.array(sum_of_squares(lengths[order].tolist(), limit), np.int64).reshape(-1, 2)
        return pa.table({"k": keys[order], "sequence_id": keys[order][got[:, 0]], "offset": got[:, 1]})

    small = cut.where(F.col("length") < limit).select("key", "length").groupBy(of_group.alias("g")).applyInArrow(lambda t: place(t), "k long, sequence_id long, offset long")
    met = cut.join(small, F.col("key") == F.col("k"), "left")
    return met.withColumn("sequence_id", F.coalesce("sequence_id", "key")).withColumn("offset", F.coalesce("offset", F.lit(0).cast("long"))).drop("k")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, limit: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, the packed ids of each piece."""
    return packed(written(pieces(docs, tokenizer_path, end_id, limit, with_ids), "pieces"), limit).drop("key")
