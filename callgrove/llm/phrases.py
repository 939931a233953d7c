"""Operator 13: phrase collocations from FM-indexes over word ids, a pair of indexes (forward and reversed) for each shard.

A task cuts its texts into shards of some million words, at the ends of pieces. A shard's words become symbols, with symbol 0 between
pieces, and its two Burrows-Wheeler transforms are sorted as deep as phrases are long less one word, which is all that
intervals of shorter phrases need. From the intervals of single words a step to the left gives all pairs with their counts, and steps to the
right from there the longer phrases; each step keeps the intervals of both indexes in step, and is done for all intervals at
once. Counts are summed across shards by Spark.

Before, one pass counts words and pairs in 2^25 buckets (PCY), and triples in as many: a bucket below the least count holds nothing frequent, so
the indexes leave out what can't be a candidate or a part of one. Buckets only spare work: what they let pass is counted exactly,
and a table so full that all passes gives the same rows. Their bitmap has 8 MB whatever the input and is the only thing that is broadcast.

Defined results: null texts are empty, null languages are `und`; case is lowered for A-Z alone; texts without a word count for
nothing; equal rows count each; ties in a rank go to the larger count, then to the phrase that is first by its bytes; an empty
table gives no rows; other columns, whatever their names, do not count. Very long texts are read in blocks that end at a piece, so memory
grows with the longest piece (text without any mark or line end) alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrove.llm.common import written

#: Words of a shard; bytes of text read at once; buckets by bits, and the ranges in which they are summed.
SHARD_WORDS, BLOCK, BITS, RANGES = 1 << 20, 4 << 20, 25, 512
SALTS = 64
#: Kinds of bytes: 0 of words, 1 between words, 2 between pieces. And A-Z in lower case.
KIND, LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
KIND[[9, 32]], KIND[[10, 11, 12, 13, *b".,;:!?"]] = 1, 2
LOWER[65:91] += 32


class Words:
    """Words of a block of texts: their letters, the text of each, and whether it begins a piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind = KIND[data]
        inside = kind == 0
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        starts = offsets[:-1][offsets[:-1] < len(data)]
        begin[starts] = inside[starts]
        at = np.flatnonzero(begin)
        self.text = np.searchsorted(offsets, at, "right") - 1
        stops = np.cumsum(kind == 2, dtype=np.int32)[at]
        self.new_piece = np.ones(len(at), bool)
        self.new_piece[1:] = (stops[1:] != stops[:-1]) | (self.text[1:] != self.text[:-1])
        letters = LOWER[data[inside]]
        ends = np.append((np.cumsum(inside, dtype=np.int64) - 1)[at], len(letters)).astype("<i8")
        self.words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(letters)])


def blocks(batch: pa.RecordBatch, size: int = BLOCK) -> Iterator[tuple[Words, np.ndarray, list[str]]]:
    """Words, the language of each text by its number, and the languages; blocks of about `size` bytes end at a piece."""
    coded = pc.fill_null(batch.column(0), "und").dictionary_encode()
    langs, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    texts = pc.cast(pc.cast(pc.fill_null(batch.column(1), ""), pa.large_string()), pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    low, first = int(offsets[0]), 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, low + size, "right")) - 1
        if last > first:
            high, after = int(offsets[last]), last
            own = np.concatenate([[low], offsets[first + 1 : last + 1]])
        else:  # a long text: up to the last end of a piece in so many bytes, or in twice as many
            high, after, reach = int(offsets[first + 1]), first + 1, size
            while low + reach < int(offsets[first + 1]):
                cuts = np.flatnonzero(KIND[data[low : low + reach]] == 2)
                if len(cuts):
                    high, after = low + int(cuts[-1]) + 1, first
                    break
                reach *= 2
            own = np.array([low, high])
        yield Words(data[low:high], own - low), langs[first : first + len(own) - 1], names
        low, first = high, after


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def buckets(*hashed: np.ndarray) -> np.ndarray:
    """Buckets by the hashes of one, two or three words; those of three have a half of the table to themselves."""
    h = hashed[0]
    for other in hashed[1:]:
        h = mixed(h) * np.uint64(3) + other
    return (mixed(h) >> np.uint64(64 - BITS)).astype(np.int64) + (len(hashed) == 3) * (1 << BITS)


def hashes(words: list[bytes], langs: np.ndarray, names: list[str]) -> np.ndarray:
    of_word = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    of_lang = np.array([xxhash.xxh64_intdigest(n) | 1 for n in names], np.uint64)
    return of_word * of_lang[langs] + of_lang[langs]


def count_buckets(docs: DataFrame) -> DataFrame:
    """(range, counts): counts of a range of buckets, 255 at most, as a zstandard frame; a task gives one for each range that it meets."""
    width = (2 << BITS) // RANGES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 << BITS, np.uint8)
        for batch in batches:
            for block, langs, names in blocks(batch):
                coded = block.words.dictionary_encode()
                word_lang = langs[block.text]
                pair, back = np.unique(coded.indices.to_numpy().astype(np.int64) * len(names) + word_lang, return_inverse=True)
                known = coded.dictionary.to_pylist()
                h = hashes([known[i] for i in pair // len(names)], pair % len(names), names)
                joined = np.flatnonzero(~block.new_piece)
                third = joined[~block.new_piece[joined - 1]]
                single, own = np.bincount(back, minlength=len(pair)), h[back]
                pairs, triples = buckets(own[joined - 1], own[joined]), buckets(own[third - 2], own[third - 1], own[third])
                for found, times in ((buckets(h), single), np.unique(pairs, return_counts=True), np.unique(triples, return_counts=True)):
                    order = np.argsort(found)  # several words may share a bucket
                    found, times = found[order], times[order]
                    first = np.flatnonzero(np.diff(found, prepend=-1))
                    if len(first):
                        found, times = found[first], np.add.reduceat(times, first)
                        table[found] = np.minimum(table[found] + times, 255)
        zip_ = zstandard.ZstdCompressor(level=3)
        parts = table.reshape(RANGES, width)
        ranges = np.flatnonzero(parts.any(axis=1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array([zip_.compress(parts[k].tobytes()) for k in ranges], pa.binary())], names=["range", "counts"])

    return docs.select("lang", "text").mapInArrow(count, "range int, counts binary")


def frequent_buckets(counted: DataFrame, least: int) -> np.ndarray:
    """One bit for each bucket of at least so many: a bitmap of fixed size, its ranges summed by Spark."""
    width = (2 << BITS) // RANGES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, at, sums = zstandard.ZstdDecompressor(), None, np.zeros(width, np.uint16)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], names=["range", "bits"])

        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != at:
                    if at is not None:
                        yield done()
                    at, sums = k, np.zeros(width, np.uint16)
                sums = np.minimum(sums + np.frombuffer(unzip.decompress(blob), np.uint8), 255)
        if at is not None:
            yield done()

    parts = counted.repartition("range").sortWithinPartitions("range").mapInArrow(add, "range int, bits binary")
    bitmap = np.zeros((RANGES, width // 8), np.uint8)
    for k, bits in parts.collect():  # at most RANGES rows, twice 2^BITS bits
        bitmap[k] = np.frombuffer(bits, np.uint8)
    return bitmap.ravel()


class Side:
    """One of the two indexes: its transform and the step from a row to the row of the suffix that is one symbol longer."""

    def __init__(self, symbols: np.ndarray, depth: int):
        bits = max(1, int(symbols.max()).bit_length())
        padded = np.append(symbols, np.zeros(depth, symbols.dtype)).astype(np.int64)
        n = len(symbols)
        if bits * depth <= 63:
            key = np.zeros(n, np.int64)
            for k in range(depth):
                key = key << bits | padded[k : k + n]
            order = np.argsort(key)
        else:
            order = np.lexsort([padded[k : k + n] for k in reversed(range(depth))])
        self.bwt = symbols[order - 1]  # before the first stands the last, symbol 0
        by_symbol = np.argsort(self.bwt, kind="stable")
        self.step = np.empty(n, np.int64)
        self.step[by_symbol] = np.arange(n)


class BidirectionalIndex:
    """Intervals of phrases of up to `depth` words in the indexes of a text and of its reverse; the text begins and ends with symbol 0."""

    def __init__(self, symbols: np.ndarray, depth: int):
        counts = np.bincount(symbols)
        self.first, self.counts = np.cumsum(counts) - counts, counts
        self.forward = Side(symbols, max(1, depth - 1))
        self.back = Side(symbols[::-1], max(1, depth - 1))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols but 0, their intervals' starts in both indexes, and their counts."""
        found = np.flatnonzero(self.counts[1:]) + 1
        return found, self.first[found], self.first[found], self.counts[found]

    def extended(self, side: Side, own: np.ndarray, other: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """All phrases longer by one symbol on that side: the number of the phrase before, the symbol, both starts and the count.

        own and other are the starts of the intervals in that side's index and in the other one.
        """
        before = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(own)), counts)
        rows = np.arange(len(owner)) - (before - own)[owner]
        key = owner * len(self.counts) + side.bwt[rows]
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.diff(key, prepend=-1))
        owner, symbol = np.divmod(key[start], len(self.counts))
        longer = np.diff(start, append=len(key))
        # rows of an interval, by the symbol before them, are as many as the smaller symbols take in the other index
        new = (owner, symbol, side.step[rows[order[start]]], other[owner] + start - before[owner], longer)
        real = symbol > 0
        return tuple(x[real] for x in new)


def shard_phrases(words: pa.Array, langs: np.ndarray, names: list[str], new_piece: np.ndarray, bitmap: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f): counts in a shard of all words and phrases that the bitmap lets pass; the empty phrase counts all words."""
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([""] * len(names), pa.string()), pa.array(np.bincount(langs, minlength=len(names)), pa.int64())], names=["lang", "phrase", "f"])
    coded = words.dictionary_encode()
    pair, back = np.unique(coded.indices.to_numpy().astype(np.int64) * len(names) + langs, return_inverse=True)
    known = coded.dictionary.to_pylist()
    h = hashes([known[i] for i in pair // len(names)], pair % len(names), names)
    passes = lambda at: (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    frequent = passes(buckets(h))
    if not frequent.any():
        return
    rank = np.where(frequent, np.cumsum(frequent), 0)  # others part pieces like symbol 0
    h, pair = np.append(np.uint64(0), h[frequent]), np.append(0, pair[frequent])
    places = np.arange(len(back)) + np.cumsum(new_piece)
    symbols = np.zeros(int(places[-1]) + 2, np.int32)
    symbols[places] = rank[back]
    spoken = pc.cast(coded.dictionary, pa.large_string()).take(pa.array(pair // len(names)))
    lang_of, all_names = pair % len(names), pa.array(names, pa.string())

    def said(columns: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(counts), 100_000):
            parts = [spoken.take(pa.array(c[at : at + 100_000])) for c in columns]
            phrase = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
            yield pa.RecordBatch.from_arrays([all_names.take(pa.array(lang_of[columns[0][at : at + 100_000]])), pc.cast(phrase, pa.string()), pa.array(counts[at : at + 100_000], pa.int64())], names=["lang", "phrase", "f"])

    index = BidirectionalIndex(symbols, longest)
    word, ahead, behind, counts = index.words()
    yield from said([word], counts)
    if longest < 2:
        return
    owner, left, ahead, behind, counts = index.extended(index.forward, ahead, behind, counts)
    keep = passes(buckets(h[left], h[word[owner]]))
    columns = [left[keep], word[owner[keep]]]
    ahead, behind, counts = ahead[keep], behind[keep], counts[keep]
    yield from said(columns, counts)
    for _ in range(longest - 2):
        owner, right, behind, ahead, counts = index.extended(index.back, behind, ahead, counts)
        last = h[columns[-1][owner]]
        keep = passes(buckets(last, h[right])) & passes(buckets(h[columns[-2][owner]], last, h[right]))
        columns = [*(c[owner[keep]] for c in columns), right[keep]]
        ahead, behind, counts = ahead[keep], behind[keep], counts[keep]
        yield from said(columns, counts)


def phrase_counts(docs: DataFrame, bitmap: np.ndarray, longest: int, least: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, phrase, f) of all words and phrases of at least that count; f of the empty phrase is the number of all words."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def enumerate_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, size = [], {}, 0

        def shard() -> Iterator[pa.RecordBatch]:
            words = pa.concat_arrays([b.words for b, _ in held])
            return shard_phrases(words, np.concatenate([x for _, x in held]), list(names), np.concatenate([b.new_piece for b, _ in held]), sent.value, longest)

        for batch in batches:
            for block, langs, own_names in blocks(batch):
                codes = np.array([names.setdefault(n, len(names)) for n in own_names], np.int64)
                held.append((block, codes[langs[block.text]]))
                size += len(block.words)
                if size >= shard_words:
                    yield from shard()
                    held, names, size = [], {}, 0
        if size:
            yield from shard()

    found = docs.select("lang", "text").mapInArrow(enumerate_, "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def collocations(counts: DataFrame, share: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases that no longer phrase of at least `share` percent of their count holds.

    counts has (lang, phrase, f) of all frequent words and phrases, each part of a phrase among them.
    """
    words, size = F.split("phrase", " "), F.size(F.split("phrase", " "))
    part = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    phrases = counts.where(size > 1).withColumnRenamed("f", "a")
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: part(i, n)))))
    longer = phrases.where(size > 2).select("lang", inner.alias("phrase"), F.lit(None).cast("long").alias("a"), F.col("a").alias("longest"))
    both = phrases.withColumn("longest", F.lit(None).cast("long")).unionByName(longer).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longest").alias("longest"))
    kept = both.where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a"))).drop("longest")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    # the parts are keys of the joins and no columns, so that only phrases are shuffled
    of = lambda p, n: counts.select(F.col("lang").alias(f"{n}_lang"), F.col("phrase").alias(p), F.col("f").alias(n))
    met = cuts.join(of("left", "l"), (F.col("lang") == F.col("l_lang")) & (part(F.lit(1), F.col("k")) == F.col("left"))).drop("left", "l_lang")
    met = met.join(of("right", "r"), (F.col("lang") == F.col("r_lang")) & (part(F.col("k") + 1, size - F.col("k")) == F.col("right"))).drop("right", "r_lang")
    whole = lambda c: f"cast({c} as decimal(19, 0))"
    scored = met.withColumn("score", F.expr(f"({whole('a')} * {whole('a')} * cast(1000000 as decimal(7, 0))) div ({whole('l')} * {whole('r')})"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language with their rank: of each language's shares first, so that no task orders a whole one."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    few = found.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def mine(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    docs = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    bitmap = frequent_buckets(count_buckets(docs), min(least, 255))
    counts = written(phrase_counts(docs, bitmap, longest, least, shard_words), "phrase-counts")
    totals = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked(collocations(counts.where("phrase <> ''"), share), top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
