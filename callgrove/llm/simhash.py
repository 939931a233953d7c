"""Operator 3: SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has one bit per hash bit: the majority over the XXH64 of the text's word shingles. Equal fingerprints are one
class, so copies collapse before anything is paired. The index posts each distinct fingerprint under (positions, bytes at
them). Two fingerprints of 8 bytes that differ in at most 4 bits agree in at least 4 bytes; postings of single bytes would
hold a 256th of all rows each, so a posting takes three positions, from a set of 20 triples of which every 4 positions
hold one: no link is lost and a posting has 2**24 values. Members of a posting are paired, the bytes that a pair shares by
position are tallied, pairs under the guaranteed minimum fall, and the rest are verified by their differing bits.

Pairs don't leave a posting: it is cut into blocks, each two blocks meet in one group of bounded size, and the group
returns a spanning forest of its links instead of all pairs. Components are found by alternating stars on the links of
distinct fingerprints, each round written to the shared folder.

The pipeline's stage (5-word shingles, similarity 0.8 of the distinct shingles) takes fingerprints of the distinct shingles through the
same index, and its links are candidates that are verified on the sets themselves. At 0.8 a pair differs in some ten of 64 bits, which no
index of bytes reaches, so least hashes of the sets (BANDS postings of BAND_ROWS hashes) add the candidates that are further apart in
bits; see near_duplicates().

Defined results: null, empty and word-less texts have fingerprint zero and are linked like others (in the stage they are one class); a text of fewer words
than a shingle is one shingle; repeated rows share a class; a null doc_id never names a component unless all of its
component's are null; an empty table gives no rows; other columns are dropped but by first_of_each(), which keeps them
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgrove.llm.common import add_columns, free_name, sized, written

SEED = 42
#: Members of a block of a posting.
BLOCK = 1024
#: Shingles of a block of a posting of shingle sets, about: 8 bytes each.
BLOCK_SHINGLES = 1 << 21
#: Postings of a shingle set, least hashes in each, and how many of all must agree for a pair to be verified: at similarity 0.8
#: a pair shares a posting but for 3 in a million, and agrees in fewer hashes once in 10**8.
BANDS, BAND_ROWS, AGREE = 24, 4, 54

#: For each byte its bits as bytes of one number, so that 255 can be added without a carry.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each space-joined shingle, repeats included; a shorter text is one shingle."""
    if not words:
        return np.empty(0, "<u8")
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(whole, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - size].tolist()]
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())), "<u8", len(starts))


def widened(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits that stand for a hash; the first are the hash."""
    if not k:
        return hashes
    h = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, lowest first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):
        lanes = _SPREAD[hashes[at : at + 255].view(np.uint8).reshape(-1, 8)].sum(0, dtype=np.uint64)
        total += lanes.view(np.uint8)
    return total


def fingerprint(text: str | None, size: int, bits: int = 64) -> bytes:
    """Little-endian fingerprint: a bit is set if it is in over half of the hashes."""
    words = text.encode().lower().split() if text else []
    hashes = shingle_hashes(words, size)
    if not len(hashes):
        return bytes(bits // 8)
    return b"".join(np.packbits(2 * bit_counts(widened(hashes, k)) > len(hashes), bitorder="little").tobytes() for k in range(bits // 64))


def fingerprints(df: DataFrame, size: int = 4, bits: int = 64, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of each text as a binary column, lowest bits first."""

    def make():
        return lambda batch: [[fingerprint(x.as_py(), size, bits) for x in batch.column(0)]]

    return add_columns(df, [(out, T.BinaryType())], make, [text])


def covering_triples(positions: int = 8) -> list[tuple[int, ...]]:
    """Triples of which every 4 positions hold one: positions in three groups, triples inside a group or two in one and one in the next."""
    group = [p * 3 // positions for p in range(positions)]

    def taken(triple: tuple[int, ...]) -> bool:
        a = [group[p] for p in triple]
        double = [g for g in set(a) if a.count(g) == 2]
        return len(set(a)) == 1 or bool(double) and any(x == (double[0] + 1) % 3 for x in a)

    return [t for t in combinations(range(positions), 3) if taken(t)]


def postings(prints: DataFrame, triples: list[tuple[int, ...]]) -> DataFrame:
    """key and fp_id of each distinct fingerprint (fp_id, fingerprint) under each triple of positions."""
    places = np.array(triples)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                b = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)[:, places].astype(np.int64)
                keys = (np.arange(len(places)) << 24) + (b[:, :, 0] << 16) + (b[:, :, 1] << 8) + b[:, :, 2]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), len(places))), pa.array(keys.ravel())], names=["fp_id", "key"])

    return prints.select("fp_id", "fingerprint").mapInArrow(post, "fp_id long, key long")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Zero bytes in each row of 64-bit differences."""
    for step in (4, 2, 1):
        x = x | (x >> np.uint64(step))
    return x.shape[-1] * 8 - np.bitwise_count(x & np.uint64(0x0101010101010101)).sum(-1, dtype=np.int32)


def forest(ids: np.ndarray, prints: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs within reach connect, at most one for each member: breadth first, a row of pairs at a time."""
    left, a, b = np.arange(len(ids)), [], []
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            apart = prints[left] ^ prints[queue.pop()]
            near = shared_bytes(apart) >= least
            near &= np.bitwise_count(apart).sum(-1, dtype=np.int32) <= most
            found = left[near]
            queue += found.tolist()
            a.append(np.full(len(found), ids[root]))
            b.append(ids[found])
            left = left[~near]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def forests(batches: Iterator[pa.RecordBatch], least: int, most: int) -> Iterator[pa.RecordBatch]:
    """Links of the groups (key, i, j) in batches of (key, i, j, fp_id, fingerprint) sorted by these; a group may cross batches."""

    def out(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        none = np.empty(0, np.int64)
        a, b = (np.concatenate([none, *[x[k] for x in parts]]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def linked(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        ids = table["fp_id"].to_numpy()
        prints = np.frombuffer(b"".join(table["fingerprint"].to_pylist()), "<u8").reshape(len(ids), -1)
        starts = np.concatenate([[0], np.flatnonzero(changes(table)) + 1, [len(ids)]])
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        apart = prints[two] ^ prints[two + 1]
        near = (shared_bytes(apart) >= least) & (np.bitwise_count(apart).sum(-1, dtype=np.int32) <= most)
        parts = [(ids[two[near]], ids[two[near] + 1])]
        return parts + [forest(ids[x:y], prints[x:y], least, most) for x, y in zip(starts[:-1][sizes > 2].tolist(), starts[1:][sizes > 2].tolist())]

    def changes(table: pa.Table) -> np.ndarray:
        keys = [table[c].to_numpy() for c in ("key", "i", "j")]
        return np.any([k[1:] != k[:-1] for k in keys], axis=0) if len(table) > 1 else np.empty(0, bool)

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        given = pa.Table.from_batches([batch])
        table = given if held is None else pa.concat_tables([held, given])
        ends = np.flatnonzero(changes(table))
        cut = int(ends[-1]) + 1 if len(ends) else 0  # the last group may go on
        held = table.slice(cut).combine_chunks()
        if cut:
            yield out(linked(table.slice(0, cut).combine_chunks()))
    yield out(linked(held) if held is not None else [])


def links(prints: DataFrame, triples: list[tuple[int, ...]], least: int, most: int) -> DataFrame:
    """a, b: links that connect every two fingerprints (fp_id, fingerprint) that share a posting, `least` bytes and all but `most` bits."""
    posts = postings(prints, triples)
    counts = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = posts.join(counts, "key").join(prints, "fp_id")
    placed = shared.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp_id"), "blocks").cast("int"))
    met = placed.select("key", "fp_id", "fingerprint", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp_id", "fingerprint")
    dealt = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp_id")
    return dealt.mapInArrow(lambda batches: forests(batches, least, most), "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) of every node in edges (a, b), by alternating large and small stars."""
    spark = edges.sparkSession
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        mark = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if mark == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = mark
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # written, so that the join below deals both sides anew and a star with many ends can be split
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-heads")
        large = both.where("v > u").join(sized(least), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a")
        stars = small.select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(small.select(F.col("a").alias("x"), F.col("m").alias("y")))
        edges = written(stars.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds of {spark.sparkContext.appName}")


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes in ascending order."""
    return np.unique(shingle_hashes(text.encode().lower().split() if text else [], size))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """Sixteen bits of the least of the hashes under each of BANDS * BAND_ROWS orders; zeros for no hashes."""
    orders = widened(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64), 1) | np.uint64(1)
    if not len(hashes):
        return np.zeros(len(orders), "<u2")
    least = np.min([np.multiply.outer(orders, hashes[at : at + 512]).min(1) for at in range(0, len(hashes), 512)], axis=0)
    return (least >> np.uint64(16)).astype("<u2")


def set_prints(df: DataFrame, size: int, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with a binary column that names the shingle set of each text: number of shingles, 128-bit hash of all, least hashes, SimHash."""

    def one(value: str | None) -> bytes:
        hashes = shingle_set(value, size)
        return len(hashes).to_bytes(8, "little") + xxhash.xxh3_128_digest(hashes.tobytes()) + least_hashes(hashes).tobytes() + np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").tobytes()

    return add_columns(df, [(out, T.BinaryType())], lambda: lambda batch: [[one(x.as_py()) for x in batch.column(0)]], [text])


def set_postings(prints: DataFrame) -> DataFrame:
    """key, fp_id and number of shingles of each shingle set (fp_id, fingerprint) under each of its bands; empty sets have none."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                b = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                some = b[:, :8].any(1)
                bands = np.ascontiguousarray(b[some, 24:-8]).view("<u8")
                keys = np.stack([widened(bands[:, k], k + 1) for k in range(BANDS)], axis=1).view(np.int64)
                named = batch.column(0).take(pa.array(np.repeat(np.flatnonzero(some), BANDS)))
                sizes = np.repeat(np.ascontiguousarray(b[some, :8]).view("<i8").ravel(), BANDS)
                yield pa.RecordBatch.from_arrays([named, pa.array(keys.ravel()), pa.array(sizes)], names=["fp_id", "key", "size"])

    return prints.select("fp_id", "fingerprint").mapInArrow(post, "fp_id binary, key long, size long")


def simhash_candidates(classes: DataFrame) -> DataFrame:
    """fp_id, key and size of the members of pairs of shingle sets (fp_id, fingerprint) whose SimHash differs in 4 bits at most; a key is a pair.

    Sets of one SimHash are paired with the least of them, and these by the links of the index.
    """
    print_ = F.substring("fingerprint", 25 + 2 * BANDS * BAND_ROWS, 8)
    size = F.conv(hex_digits(F.substring("fingerprint", 1, 8)), 16, -10).cast("long")
    one = classes.select(F.struct("fp_id", size.alias("size")).alias("row"), print_.alias("print"), F.conv(F.hex(print_), 16, -10).cast("long").alias("number"))
    one = written(one.where("row.size > 0"), "simhashes")
    heads = written(one.groupBy("number", "print").agg(F.min("row").alias("head")), "simhash-heads")
    near = links(heads.select(F.col("number").alias("fp_id"), F.col("print").alias("fingerprint")), covering_triples(8), 4, 4)
    a, b = (heads.select(F.col("number").alias(c), F.col("head").alias(f"row_{c}")) for c in ("a", "b"))
    pairs = near.join(a, "a").join(b, "b").select("row_a", "row_b")
    same = one.join(heads.select("number", "head"), "number").where(F.col("row.fp_id") != F.col("head.fp_id")).select(F.col("head").alias("row_a"), F.col("row").alias("row_b"))
    rows = pairs.unionByName(same).select(F.xxhash64("row_a.fp_id", "row_b.fp_id").alias("key"), F.explode(F.array("row_a", "row_b")).alias("row"))
    return rows.select("row.fp_id", "key", "row.size")


def similar(sets: list[np.ndarray], lengths: np.ndarray, least: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
    """Which of the others have a set whose similarity with that of x (shared of the union) is 0.8 or more."""
    sizes = lengths[others]
    both = 4 * (sizes + len(sets[x]))
    maybe = 9 * np.minimum(sizes, len(sets[x])) >= both
    maybe[maybe] = (least[others[maybe]] == least[x]).sum(1) >= AGREE
    found = np.zeros(len(others), bool)
    if maybe.any():
        flat = np.concatenate([sets[y] for y in others[maybe].tolist()])
        place = np.searchsorted(sets[x], flat)
        hits = sets[x][np.minimum(place, len(sets[x]) - 1)] == flat
        shared = np.add.reduceat(hits, np.cumsum([0, *sizes[maybe][:-1]]), dtype=np.int64)
        found[maybe] = 9 * shared >= both[maybe]
    return found


def set_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the groups (key, i, j) in batches of (key, i, j, fp_id, fingerprint, shingles) sorted by these: a spanning forest of the similar pairs."""

    def linked(rows: list[tuple[bytes, bytes, bytes]]) -> tuple[list[bytes], list[bytes]]:
        if not rows:
            return [], []
        ids = [r[0] for r in rows]
        sets = [np.frombuffer(r[2], "<u8") for r in rows]
        least = np.stack([np.frombuffer(r[1], "<u2", BANDS * BAND_ROWS, 24) for r in rows])
        lengths = np.array([len(x) for x in sets])
        left, a, b = np.arange(len(rows)), [], []
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = similar(sets, lengths, least, x, left)
                for y in left[near].tolist():
                    queue.append(y)
                    a.append(ids[x])
                    b.append(ids[y])
                left = left[~near]
        return a, b

    def out(found: list[tuple[list[bytes], list[bytes]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for pair in found for x in pair[k]], pa.binary()) for k in (0, 1)], names=["a", "b"])

    group, rows = None, []
    for batch in batches:
        found = []
        columns = [batch.column(c) for c in range(6)]
        for r in range(batch.num_rows):
            own = tuple(c[r].as_py() for c in columns[:3])
            if own != group:
                found.append(linked(rows))
                group, rows = own, []
            rows.append(tuple(c[r].as_py() for c in columns[3:]))
        yield out(found)
    yield out([linked(rows)])


def set_links(classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """a, b: links that connect every two shingle sets (fp_id, fingerprint, first) that the index of SimHashes links or that share a posting
    of least hashes, and that have similarity 0.8 or more.

    Postings of the same members are one (by number and XOR of their hashes). Sets are made again from the texts of members.
    """
    posts = set_postings(classes).unionByName(written(simhash_candidates(classes), "simhash-pairs"))
    groups = posts.groupBy("key").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(fp_id))").alias("who"), F.sum("size").alias("shingles")).where("n > 1")
    groups = groups.groupBy("n", "who").agg(F.min_by(F.struct("key", "shingles"), "key").alias("g")).select("n", "g.key", "g.shingles")
    shared = written(posts.join(groups, "key").select("key", "n", "shingles", "fp_id"), "postings")
    wanted = written(classes.join(shared.select("fp_id").distinct(), "fp_id", "left_semi").select("fp_id", "fingerprint", F.col("first.doc_id").alias("named"), F.col("first.text_key").alias("text_key")), "members")
    texts = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"), "text")
    members = texts.join(sized(wanted), "text_key").where(F.col("doc_id").eqNullSafe(F.col("named"))).dropDuplicates(["fp_id"]).select("fp_id", "fingerprint", "text")

    def make():
        return lambda batch: [[shingle_set(x.as_py(), size).tobytes() for x in batch.column(0)]]

    sets = add_columns(members, [("shingles", T.BinaryType())], make, ["text"]).drop("text")
    # two blocks meet in a group, and neither their members nor their shingles pass a bound
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    placed = shared.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp_id"), "blocks").cast("int"))
    met = placed.select("key", "fp_id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp_id").join(sets, "fp_id")
    dealt = met.select("key", "i", "j", "fp_id", "fingerprint", "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp_id")
    return dealt.mapInArrow(set_forests, "a binary, b binary").distinct()


def labelled(docs: DataFrame, prints: Callable[[DataFrame], DataFrame], links: Callable[[DataFrame], DataFrame], fp_id: Column) -> DataFrame:
    """doc_id, text_key, fingerprint and, as first, the (doc_id, text_key) that stands for the component of each row of docs."""
    made = written(prints(docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"), "text")).drop("text"), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    classes = written(made.groupBy("fingerprint").agg(F.min(row).alias("first")).withColumn("fp_id", fp_id), "classes")
    roots = components(links(classes))
    placed = classes.join(roots, F.col("fp_id") == F.col("node"), "left").select("fingerprint", "first", F.coalesce("root", "fp_id").alias("root"))
    named = written(placed.groupBy("root").agg(F.min("first").alias("first")), "roots")
    return made.join(placed.drop("first").join(sized(named), "root").select("fingerprint", "first"), "fingerprint").select("doc_id", "text_key", "fingerprint", "first")


def hex_digits(print_: Column) -> Column:
    """The fingerprint as a number in 16 hex digits, highest first."""
    digits = F.hex(print_)
    return F.lower(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(7, -1, -1)]))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: 4-word shingles, links at 4 or fewer differing bits."""
    number = F.conv(F.hex("fingerprint"), 16, -10).cast("long")
    got = labelled(docs, lambda rows: fingerprints(rows, 4), lambda classes: links(classes.select("fp_id", "fingerprint"), covering_triples(8), 4, 4), number)
    return got.select("doc_id", hex_digits(F.col("fingerprint")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and first, the row that stands for its component: 5-word shingles, similarity 0.8 or more.

    The SimHash index gives candidates of few differing bits, the least hashes the rest.
    Similarity is the share of common shingles in the distinct shingles of both texts, whatever their length. Its candidates share
    BAND_ROWS least hashes, which a pair of similarity s does in a band with probability s ** 4: at 0.8 one of the 24 bands
    fails to show it in 3 pairs of a million, above it less. Links are exact (up to equal 64-bit hashes of shingles).
    """
    return labelled(docs, lambda rows: set_prints(rows, 5), lambda classes: set_links(classes, docs, 5), F.substring("fingerprint", 9, 16)).drop("fingerprint")


def first_of_each(docs: DataFrame) -> DataFrame:
    """docs without the near-duplicates, with all their columns: of each component one row stays.

    It is that of the smallest doc_id (null last), then of the smallest hash of its text, then of the smallest hash of all columns.
    """
    named = near_duplicates(docs)
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    marked = written(named.select("doc_id", "text_key", same.alias("stays")), "marked")
    other_id, other_key = free_name(docs, "other_id"), free_name(docs, "other_key")
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))

    def joined(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        there = sized(keys.select(F.col("doc_id").alias(other_id), F.col("text_key").alias(other_key)).distinct())
        return rows.join(there, F.col("doc_id").eqNullSafe(F.col(other_id)) & (key == F.col(other_key)), how)

    kept = joined(docs, marked.where(~F.col("stays")), "left_anti")
    again = written(marked.where("stays").groupBy("doc_id", "text_key").count().where("count > 1"), "repeated")
    if again.isEmpty():
        return kept
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = joined(kept, again, "left_semi").groupBy(F.col("doc_id"), key).agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias("row"))
    return joined(kept, again, "left_anti").unionByName(repeated.select("row.*"))
