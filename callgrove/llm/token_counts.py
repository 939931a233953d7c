"""Operator 6: token counts of whole texts; huge texts by overlapping chunks that are spliced at stable boundaries.

A huge text is encoded in chunks that overlap, with offsets. Two neighbours are spliced where both encodings have a token
boundary in their overlap, at a boundary that is proven stable: no piece of the vocabulary holds the characters on its two
sides next to each other, and a merge across it would make such a piece, so the merges on either side are those of the
whole text. Where the encodings don't align so, the overlap is widened: doubled to the left, down to what is counted
already, then to the right, up to the rest of the text, which is encoded as a whole in the end.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted alike; an input column named
like an output column is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from callgrove.llm.common import add_columns

#: UTF-8 bytes above which a text is cut, of a chunk, and that neighbours share at first.
HUGE, CHUNK, OVERLAP = 1 << 18, 1 << 17, 1 << 9
SPACE = "▁"


class PieceCounter:
    def __init__(self, path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.huge, self.chunk, self.overlap = huge, chunk, overlap
        self.widened = 0
        self.inside = set()
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if not (self.model.is_byte(i) or self.model.is_control(i)):
                self.inside.update(zip(piece, piece[1:]))

    def counts(self, texts: list) -> list[int]:
        whole = [k for k, t in enumerate(texts) if t and len(t) * 4 <= self.huge or t and len(t.encode()) <= self.huge]
        out = [0] * len(texts)
        for k, ids in zip(whole, self.model.encode([texts[k] for k in whole], num_threads=1), strict=True):
            out[k] = len(ids)
        for k in {k for k, t in enumerate(texts) if t}.difference(whole):
            out[k] = self.spliced(texts[k].encode())
        return out

    def starts(self, data: bytes) -> np.ndarray:
        """Where the tokens of data start."""
        return np.fromiter((p.begin for p in self.model.encode(data.decode(), return_type="proto").pieces), np.int64)

    def stable(self, data: bytes, at: int) -> bool:
        """Whether no piece holds the characters before and after this place next to each other."""
        before = at - 1
        while data[before] & 0xC0 == 0x80:
            before -= 1
        after = at + 1
        while after < len(data) and data[after] & 0xC0 == 0x80:
            after += 1
        x, y = (c.decode().replace(" ", SPACE) for c in (data[before:at], data[at:after]))
        return (x, y) not in self.inside

    def aligned(self, data: bytes, own: np.ndarray, other: np.ndarray, low: int, high: int) -> int | None:
        """The first stable boundary between low and high where tokens of both encodings start."""
        common = np.intersect1d(own, other)
        return next((at for at in common[(common > low) & (common < high)].tolist() if self.stable(data, at)), None)

    def spliced(self, data: bytes) -> int:
        """Tokens of a huge text, in the same number as if it were encoded as a whole."""

        def edge(at: int) -> int:
            while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
                at -= 1
            return min(at, len(data))

        total = begin = counted = 0  # begin: of the chunk; counted: up to here the tokens are in total
        end = edge(self.chunk)
        own = self.starts(data[begin:end]) + begin
        while end < len(data):
            overlap, cut = self.overlap, None
            while cut is None:
                start = max(edge(end - overlap), counted)
                stop = edge(start + max(self.chunk, 2 * (end - start)))
                other = self.starts(data[start:stop]) + start
                cut = self.aligned(data, own, other, start, end)
                if cut is None:
                    self.widened += 1
                    overlap *= 2
                    if start == counted:  # nothing is left to share: the chunk itself grows
                        end = edge(end + max(self.chunk, end - begin))
                        own = self.starts(data[begin:end]) + begin
                        if end >= len(data):
                            return total + int((own >= counted).sum())
            total += int(((own >= counted) & (own < cut)).sum())
            begin, counted, end, own = start, cut, stop, other
        return total + int((own >= counted).sum())


_loaded: dict = {}


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""

    def make():
        if model_path not in _loaded:
            _loaded[model_path] = PieceCounter(model_path)
        counter = _loaded[model_path]

        def work(batch):
            texts = batch.column(0).to_pylist()
            counts = counter.counts(texts)
            return [[len(t.encode()) if t else 0 for t in texts], counts, [n > limit for n in counts]]

        return work

    return add_columns(df, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())], make, [text])
