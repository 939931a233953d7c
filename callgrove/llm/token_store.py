"""Operator 5: token ids of documents in binary files of independent zstandard frames.

File: zstandard frames of ids (little-endian unsigned 32-bit integers), a skippable frame with the document index, and
the seek table of the seekable zstandard format: for each frame its two sizes and a checksum (low half of XXH64 of the
plain bytes). A reader takes the table from the end of the file and decompresses only the frames of the wanted documents.

Documents are dealt to files by ranges of (doc_id, hash of text, place in the input), so files in order hold ascending doc_id, and
rows that share a doc_id, or are equal, spread over files. A manifest table keeps each file's path and number of ids.

Defined results: a null text counts as empty and is the end id alone; rows with a null doc_id come first; rows with equal
doc_id lie next to each other, each with its own start; an empty table gives no file and no rows; columns but doc_id and text are not
written.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgrove.llm.common import make_folder, new_folder, opened, put_file

#: Plain bytes of a frame, and ids of one file, at which the next begins.
FRAME, FILE_IDS = 1 << 18, 1 << 27
#: Fixed values of the seekable format: skippable frames, and the magic number at the end.
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
INDEX = np.dtype([("doc_id", "<i8"), ("known", "<u1"), ("start", "<u8"), ("n", "<u8")])
#: Documents encoded at once, and bytes of them; chunks of text, and letters of words, whose ids a process keeps, and the longest of them: some 300 MB at most.
SLICE, SLICE_BYTES, MEMO, CORES, LONGEST = 4096, 16 << 20, 900_000, 1_200_000, 64
#: Letters of one byte in Latin-1, which are in composed form and have simple lower case; marks after them, and how many are told apart.
LETTERS, MARKS, TAIL = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", ".,;:!?", 3
#: A character that is a token of its own between white space, and no letter or digit.
MARK = "\x00"


class StoreWriter:
    """Writes one file to an output stream."""

    def __init__(self, out, level: int = 1):
        self.out, self.zip = out, zstandard.ZstdCompressor(level=level)
        self.buffer, self.held, self.frames, self.docs, self.ids = [], 0, [], [], 0

    def add(self, doc_id: int | None, packed: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, self.ids, len(packed) // 4))
        self.ids += len(packed) // 4
        for at in range(0, len(packed), FRAME):  # a long document has several frames
            part = packed[at : at + FRAME]
            if self.held and self.held + len(part) > FRAME:
                self.flush()
            self.buffer.append(part)
            self.held += len(part)

    def flush(self) -> None:
        if self.held:
            plain = b"".join(self.buffer)
            frame = self.zip.compress(plain)
            self.out.write(frame)
            self.frames.append((len(frame), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.buffer, self.held = [], 0

    def close(self) -> None:
        self.flush()
        index = self.zip.compress(np.array(self.docs, INDEX).tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        frames = [*self.frames, (len(index) + 8, 0, 0)]
        table = b"".join(struct.pack("<III", *x) for x in frames) + struct.pack("<IBI", len(frames), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)


class StoreReader:
    """Reads documents of one file; holds a frame at a time."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 9)
        n, kind, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or kind != 0x80:
            raise ValueError("the file has no seek table with checksums")
        file.seek(size - 9 - 12 * n)
        table = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.table, self.at = table[:-1], np.concatenate([[0], np.cumsum(table[:-1, 0])])
        self.plain = np.concatenate([[0], np.cumsum(self.table[:, 1])])
        file.seek(int(self.at[-1]) + 8)
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(file.read(int(table[-1, 0]) - 8)), INDEX)
        self.cached: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.cached[0] != k:
            self.file.seek(int(self.at[k]))
            plain = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
            if len(plain) != self.table[k, 1] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} fails its checksum")
            self.cached = (k, plain)
        return self.cached[1]

    def parts(self, doc: np.void) -> Iterator[bytes]:
        """Packed ids of a document, frame by frame."""
        low, high = 4 * int(doc["start"]), 4 * int(doc["start"] + doc["n"])
        k = int(np.searchsorted(self.plain, low, "right")) - 1
        while low < high:
            plain, base = self.frame(k), int(self.plain[k])
            yield plain[low - base : high - base]
            low, k = base + len(plain), k + 1


class WholeTokenizer:
    """Ids by the tokenizers library, a text at a time: for vocabularies whose words can't be told apart beforehand."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def pack(self, texts: list) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in got]


class ChunkTokenizer:
    """Ids by the tokenizers library, with two bounded memos, for lower-case vocabularies with word ends.

    White space parts tokens in these vocabularies, so a chunk between it is encoded alone, and so are marks after its last
    letter. Of a chunk of plain letters case does not matter, so they are looked up in lower case. Letters
    go to the library's model without its normaliser, which would leave them as they are, and their ids part where a token
    ends a word; other chunks go to the whole tokenizer with a mark between them that is a token of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.chunks, self.cores = Tokenizer.from_file(path), {}, {}
        config = json.loads(self.tokenizer.to_str())
        suffix, level = config["model"]["end_of_word_suffix"], {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.letters = Tokenizer.from_str(json.dumps(config | {"normalizer": None, "post_processor": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, level]}}))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        if len(self.mark) != 1:
            raise ValueError("the vocabulary has no token of its own for the mark")

    @staticmethod
    def fits(path: str) -> bool:
        """Whether a tokenizer file lowers case, drops white space and marks the ends of words."""
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        steps = [x["type"] for x in (config["normalizer"] or {}).get("normalizers", [])]
        split = ((config["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        return config["model"].get("end_of_word_suffix") == "</w>" and steps == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and r"[\p{L}]+" in (split.get("pattern") or {}).get("Regex", "")

    def ids(self, tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def encode_letters(self, words: list[str]) -> list[bytes]:
        """Packed ids of lower-case words of plain letters; many go to the library as one text."""
        out = []
        for at in range(0, len(words), 4096):
            ids = self.ids(self.letters, " ".join(words[at : at + 4096]))
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            packed = ids.tobytes()
            out += [packed[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of any chunks without white space; those with the mark in them go alone."""
        out, apart = {}, [c for c in chunks if MARK in c]
        for c in apart:
            out[c] = self.ids(self.tokenizer, c).tobytes()
        others = [c for c in chunks if c not in out]
        for at in range(0, len(others), 1024):
            some = others[at : at + 1024]
            ids = self.ids(self.tokenizer, f" {MARK} ".join(some))
            stops = np.flatnonzero(ids == self.mark[0])
            starts, packed = [0, *(4 * (stops + 1)).tolist()], ids.tobytes()
            out.update(zip(some, [packed[a:b] for a, b in zip(starts, [*(4 * stops).tolist(), len(packed)])], strict=True))
        return [out[c] for c in chunks]

    def learn(self, new: list[bytes]) -> list[bytes]:
        """Packed ids of chunks, which are kept."""
        given = pc.cast(pa.array(new, pa.large_binary()), pa.large_string())
        plain = pc.match_substring_regex(given, LETTERS)
        letters, words = plain.to_numpy(zero_copy_only=False).tolist(), pc.if_else(plain, pc.utf8_lower(given), given).to_numpy(zero_copy_only=False).tolist()
        if len(self.cores) + len(words) > CORES:
            self.cores.clear()
        known = self.cores
        for kind, encode in ((True, self.encode_letters), (False, self.encode_chunks)):
            missing = list(dict.fromkeys([w for w, x in zip(words, letters) if x is kind and w not in known]))
            known.update(zip(missing, encode(missing), strict=True))
        got = [known[w] for w in words]
        for w in {w for w in words if len(w) > LONGEST}:
            del known[w]
        self.chunks.update([(w, x) for w, x in zip(new, got, strict=True) if len(w) <= LONGEST])
        return got

    def known(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of distinct chunks; new ones are learned."""
        ids = list(map(self.chunks.get, words))
        new = [w for w, x in zip(words, ids) if x is None and w]
        if len(self.chunks) + len(new) > MEMO:
            self.chunks.clear()
        if not new:
            return [x or b"" for x in ids]
        fresh = iter(self.learn(new))
        return [x if x is not None else next(fresh) if w else b"" for w, x in zip(words, ids)]

    @staticmethod
    def without_marks(chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Chunks without the marks after their last letter, and these (TAIL at most, else none) as a number of their bytes.

        A token never goes on from a plain letter to a mark after it, so the ids of both follow each other.
        """
        short = pc.ascii_rtrim(chunks, MARKS)
        n = pc.binary_length(short).to_numpy()
        tail = pc.binary_length(chunks).to_numpy() - n
        data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
        stop = np.frombuffer(chunks.buffers()[1], "<i8", len(chunks), 8 * chunks.offset) + n  # where the marks begin
        key = np.zeros(len(chunks), np.int64)
        at = np.flatnonzero((tail > 0) & (tail <= TAIL) & (n > 0))
        last, before = data[stop[at] - 1], data[np.maximum(stop[at] - 2, 0)]
        two = (n[at] > 1) & (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
        at = at[two | ((last | 0x20) >= 0x61) & ((last | 0x20) <= 0x7A)]
        for k in range(TAIL):
            more = at[tail[at] > k]
            key[more] |= data[stop[more] + k].astype(np.int64) << (8 * k)
        return pc.if_else(pa.array(key > 0), short, chunks), key

    def pack(self, texts: list | pa.Array) -> list[bytes]:
        """Packed ids of each text: its chunks become numbers of distinct chunks, whose ids are taken in order."""
        split = pc.ascii_split_whitespace(pc.fill_null(pc.cast(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), pa.large_string()), ""))
        coded = split.flatten().dictionary_encode()
        heads, marks = self.without_marks(coded.dictionary)
        heads = heads.dictionary_encode()
        tails, place = np.unique(marks, return_inverse=True)
        parts = [
            pa.array(self.known(words), pa.large_binary()).take(where)
            for words, where in (
                (pc.cast(heads.dictionary, pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), heads.indices),
                ([int(x).to_bytes(TAIL, "little").rstrip(b"\0") for x in tails], pa.array(place)),
            )
        ]
        taken = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary())).take(coded.indices)
        taken = taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken
        ends = np.frombuffer(taken.buffers()[1], "<i8", len(taken) + 1, 8 * taken.offset)[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        data = taken.buffers()[2]
        return [data[a:b].to_pybytes() if data is not None else b"" for a, b in zip(ends, ends[1:])]


_loaded: dict = {}


def write_store(df: DataFrame, tokenizer_path: str, end_id: int, partitions: int, folder: str | None = None) -> str:
    """Encodes df (doc_id, text), writes the files and their manifest; returns the folder."""
    spark = df.sparkSession
    folder = folder or new_folder(spark, "token-store")
    keyed = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("spread"), F.monotonically_increasing_id().alias("place"))
    sorted_docs = keyed.repartitionByRange(partitions, "doc_id", "spread", "place").sortWithinPartitions("doc_id", "spread", "place").drop("spread", "place")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if tokenizer_path not in _loaded:
            _loaded[tokenizer_path] = (ChunkTokenizer if ChunkTokenizer.fits(tokenizer_path) else WholeTokenizer)(tokenizer_path)
        tokenizer, part = _loaded[tokenizer_path], TaskContext.get().partitionId()
        number, done = 0, []
        raw: io.BytesIO | None = None
        store: StoreWriter | None = None

        def close() -> None:
            nonlocal raw, store, number
            if store is not None:
                store.close()
                uri = f"{folder}/part-{part:06d}-{number:04d}.ids.zst"
                put_file(uri, lambda out, data=raw: out.write(data.getbuffer()))
                done.append((uri, part, number, store.ids, len(store.docs)))
                raw, store, number = None, None, number + 1

        for whole in batches:
            step = max(1, min(SLICE, SLICE_BYTES * whole.num_rows // max(1, whole.nbytes)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                for doc_id, packed in zip(batch.column(0).to_pylist(), tokenizer.pack(batch.column(1).to_pylist()), strict=True):
                    if store is None:
                        raw = io.BytesIO()
                        store = StoreWriter(raw)
                    store.add(doc_id, packed + end)
                    if raw.tell() + store.held >= FILE_IDS or store.ids >= FILE_IDS:
                        close()
        close()
        names = ["uri", "part", "number", "n_ids", "n_docs"]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate([pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()])], names=names)

    make_folder(folder)
    sorted_docs.mapInArrow(write, "uri string, part int, number int, n_ids long, n_docs long").write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file, with the ids of all files before it."""
    files = spark.read.schema("uri string, part int, number int, n_ids long, n_docs long").parquet(f"{folder}/manifest")
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read_store(spark: SparkSession, folder: str, wanted: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, the packed ids."""
    files = manifest(spark, folder)
    files = files.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "uri")
    fields = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = opened(uri)
                with fs.open_input_file(path) as file:
                    store = StoreReader(file, file.size())
                    index = store.index if wanted is None else store.index[np.isin(store.index["doc_id"], wanted) & (store.index["known"] == 1)]
                    for at in range(0, len(index), 256):
                        rows = []
                        for doc in index[at : at + 256]:
                            crc, kept = 0, []
                            for part in store.parts(doc):
                                crc = zlib.crc32(part, crc)
                                kept += [part] * with_ids
                            rows.append((int(doc["doc_id"]) if doc["known"] else None, base + int(doc["start"]), int(doc["n"]), crc, *[b"".join(kept)] * with_ids))
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(fields)], names=names)

    return files.select("uri", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
