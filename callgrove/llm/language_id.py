"""Operator 9: language identification by a byte convolutional network.

Bytes are embedded; filters of widths 2, 3 and 4 run over fixed-length windows; each filter's maximum over a window feeds
a softmax. The network is trained in numpy by Adam on windows of a bounded sample of the learning rows: of every language
that occurs in them, SAMPLE_DOCS shared evenly, by a hash, WINDOWS_PER_DOC each. Whole texts are cut into windows that
overlap by the widest filter less one, and the mean of the windows' log-probabilities decides, weighted by the bytes of
each window that can belong to letters (ASCII letters and all bytes beyond ASCII). All filters are one matrix product.

A letter is a character of Unicode's class L, so that digits, fractions, circled and Roman numerals are none.

Defined results: texts that are null or hold no letter are `und` with score 0; a null doc_id is not held out and teaches
nothing; without learning rows all texts are `und`; with one language all texts with a letter get it; repeated rows get
equal results; of equal probabilities the language that is first by name wins. Null languages teach nothing. predict()
keeps other columns and replaces those named like its own.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgrove.llm.common import add_columns

#: Bytes of a window, of an embedding, filters of each width, widths, and the sample that the network learns from.
WINDOW, EMBED, FILTERS, WIDTHS = 256, 8, 12, (2, 3, 4)
SAMPLE_DOCS, WINDOWS_PER_DOC, STEPS, BATCH = 6000, 3, 700, 96
WIDEST = max(WIDTHS)
LETTER = regex.compile(r"\p{L}")
#: Bytes that can belong to letters.
WEIGHED = np.zeros(256, np.float64)
WEIGHED[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text, the last filled with zeros."""
    hop = WINDOW - WIDEST + 1
    n = max(1, -(-(len(data) - WIDEST + 1) // hop))
    filled = np.zeros((n - 1) * hop + WINDOW, np.uint8)
    filled[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(filled, (n, WINDOW), (hop, 1))


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages, total = languages, FILTERS * len(WIDTHS)
        self.mask = np.zeros((WIDEST, EMBED, total), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)), "kernel": r.normal(0, 0.3, (WIDEST, EMBED, total)) * self.mask, "bias": np.zeros(total),
            "out": r.normal(0, 0.3, (total, len(languages))), "out_bias": np.zeros(len(languages)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """Rows of WIDEST embeddings side by side, one for each place of each window."""
        x = self.p["embed"][windows].reshape(len(windows), WINDOW * EMBED)
        places = WINDOW - WIDEST + 1
        view = np.lib.stride_tricks.as_strided(x, (len(windows), places, WIDEST * EMBED), (x.strides[0], 4 * EMBED, 4))
        return view.reshape(len(windows) * places, WIDEST * EMBED)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = self.columns(windows) @ self.p["kernel"].reshape(WIDEST * EMBED, -1)
        return y.reshape(len(windows), WINDOW - WIDEST + 1, -1), self.p["bias"]

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        y, bias = self.pooled(windows)
        z = np.maximum(y.max(1) + bias, 0) @ self.p["out"] + self.p["out_bias"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def train(self, windows: np.ndarray, labels: np.ndarray, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, STEPS + 1):
            pick = r.integers(0, len(windows), BATCH)
            x, want = windows[pick], labels[pick]
            cols = self.columns(x)
            y = (cols @ self.p["kernel"].reshape(WIDEST * EMBED, -1)).reshape(BATCH, WINDOW - WIDEST + 1, -1)
            where = y.argmax(1)
            top = np.take_along_axis(y, where[:, None, :], 1)[:, 0] + self.p["bias"]
            h = np.maximum(top, 0)
            z = h @ self.p["out"] + self.p["out_bias"]
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(BATCH), want] -= 1
            q /= BATCH
            g = {"out": h.T @ q, "out_bias": q.sum(0)}
            d = (q @ self.p["out"].T) * (top > 0)
            g["bias"] = d.sum(0)
            rows = (np.arange(BATCH)[:, None] * (WINDOW - WIDEST + 1) + where).ravel()  # only the largest place of a filter learns
            taken = cols[rows].reshape(BATCH, d.shape[1], WIDEST, EMBED)
            g["kernel"] = np.einsum("bf,bfwe->wef", d, taken, optimize=True) * self.mask
            back = np.einsum("bf,wef->bfwe", d, self.p["kernel"], optimize=True)
            g["embed"] = np.zeros_like(self.p["embed"])
            at = where[:, :, None] + np.arange(WIDEST)
            np.add.at(g["embed"], x[np.arange(BATCH)[:, None, None], at], back)
            for k in self.p:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.01 * (g[k] ** 2 - s[k])
                self.p[k] -= (0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def predict(self, texts: list, block: int = 256) -> tuple[list[str], list[float]]:
        """Language and probability of each text; its windows go through the network in blocks of bounded size."""
        known = [k for k, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        sums = np.zeros((len(texts), len(self.languages)))
        counts = np.zeros(len(texts))
        held: list[np.ndarray] = []
        owners: list[int] = []

        def flush() -> None:
            if owners:
                windows = np.concatenate(held)
                weights = WEIGHED[windows].sum(1)
                np.add.at(sums, owners, self.log_probabilities(windows) * weights[:, None])
                np.add.at(counts, owners, weights)
                held.clear()
                owners.clear()

        for k in known:
            windows = windows_of(texts[k].encode())
            for at in range(0, len(windows), block):
                part = windows[at : at + block]
                if len(owners) + len(part) > block:
                    flush()
                held.append(part)
                owners.extend([k] * len(part))
        flush()
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        for k in known:
            p = np.exp(sums[k] / counts[k])
            best = int(p.argmax())
            names[k], scores[k] = self.languages[best], float(p[best] / p.sum())
        return names, scores


def fit(docs: DataFrame, learn: Column) -> Network:
    """A network from a bounded sample of the rows that may teach: about SAMPLE_DOCS, evenly from all languages, chosen by a hash."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(totals)
    if not languages:
        return Network([])
    each = max(1, SAMPLE_DOCS // len(languages))
    shares = docs.sparkSession.createDataFrame([(x, max(1, min(1 << 20, int(each / totals[x] * (1 << 20))))) for x in languages], "lang string, least int")
    spread = F.pmod(F.xxhash64("doc_id", F.lit("network")), F.lit(1 << 20)) < F.col("least")
    cut = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_PER_DOC - 1)), lambda i: F.substring("text", (F.pmod(F.xxhash64("doc_id", i), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1).cast("int"), WINDOW))
    got = rows.join(F.broadcast(shares), "lang").where(spread).select("lang", cut.alias("parts")).collect()
    network = Network(languages)
    data = [(p.encode()[:WINDOW], languages.index(r.lang)) for r in got for p in r.parts if LETTER.search(p)]
    if len(languages) > 1 and data:
        network.train(np.concatenate([windows_of(p)[:1] for p, _ in data]), np.array([y for _, y in data]))
    return network


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """docs with lang_pred and score."""

    def make():
        return lambda batch: list(network.predict(batch.column(0).to_pylist()))

    return add_columns(docs, [("lang_pred", T.StringType()), ("score", T.DoubleType())], make, ["text"])


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns from the rows that aren't held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    network = fit(docs.select("doc_id", "lang", "text"), ~held)
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), network).drop("text")
