"""Operator 2: toxicity by class-conditional Kneser-Ney models of letters, compared on length-normalised log-likelihoods.

A text is a stream of lower-case letters, each run of other characters one space, so contexts cross spaces. One 4-letter
model per class (toxic, ordinary) with absolute discounting; both back off to one shared model of shorter contexts, whose
counts are the distinct letters met before an ending in either class. A rare expression thus has the same backoff under
both classes, and only the discounts of its context tell them apart. Counts are Spark aggregates over all learning rows.

Texts are compared by the difference of the two log-likelihoods per letter: over the whole text, over its strongest runs of
RUNS letters, and over its STRONGEST separate runs of RUN letters (a shorter text counts as filled up with letters of no
evidence). A logistic curve of these and of the log of the length is the score. It is fitted on a
bounded sample of a quarter of the learning rows (CURVE_ROWS of each class, weighted by their share), against counts of
the other three quarters; texts are scored with counts of all learning rows. A sample without one of the classes is
replaced by a sample of all learning rows.

Tables of differences keep each run of letters under its 64-bit hash. They are broadcast in blocks of TABLE_ROWS rows at
most (by context), one pass over the texts for each, so a larger corpus means more passes and not more memory.

Defined results: null, empty and letter-less texts get the score of zero evidence; a null doc_id is not held out and
teaches nothing; without any label, or with one class only, the score is the share of toxic labels (0 without labels);
repeated rows get equal scores and repeated labels count once each; rows of labels that contradict each other both teach;
other columns are kept by score() and without_toxic(), which replace or add nothing but the columns they are asked for.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgrove.llm.common import add_columns, free_name, sized, written

#: Labels that may be broadcast, and rows of a class that the curve is fitted on.
BROADCAST_LABELS, CURVE_ROWS = 4_000_000, 20_000
#: Rows of the two tables in one broadcast (about 20 bytes each), and letters that a task counts or compares at once.
TABLE_ROWS, COUNTED, COMPARED = 8_000_000, 500_000, 250_000
SPACE = 32


@dataclass(frozen=True)
class Shape:
    """Letters of a gram, letters of the short runs and how many of them are averaged, and letters of the longer runs."""

    order: int
    run: int
    strongest: tuple[int, ...]
    runs: tuple[int, ...]

    @property
    def features(self) -> int:
        return len(self.strongest) + len(self.runs) + 2


#: Taken by choose() on folds of the learning rows of sf0.1 (README).
SHAPE = Shape(4, 6, (1, 2, 4, 8), (12, 24, 96))


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string")) % parts


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters, or marks on them."""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def streams(texts: list, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts side by side, and where each one's start: order - 1 spaces, letters with single spaces, a space."""
    pad = " " * (order - 1)
    parts = [f"{pad}{t.lower()} " if t else pad for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
    starts = np.cumsum([0, *map(len, parts)])
    letter = letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a space after a letter
    keep[(starts[:-1, None] + np.arange(order - 1)).ravel()] = True
    codes = np.where(letter, codes, SPACE)[keep].astype(np.uint64)
    return codes, np.concatenate([[0], np.cumsum(keep)])[starts]


def hashes(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the context before each place from order - 1 on, and of the gram that ends there."""
    n = max(0, len(codes) - order + 1)
    h = np.zeros(n, np.uint64)

    def taken(h: np.ndarray, k: int) -> np.ndarray:
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : n + k]
        return h ^ (h >> np.uint64(29))

    for k in range(order - 1):
        h = taken(h, k)
    context, gram = h * np.uint64(0xBF58476D1CE4E5B9), taken(h, order - 1) * np.uint64(0x94D049BB133111EB)
    return context ^ (context >> np.uint64(32)), gram ^ (gram >> np.uint64(32))


def own_places(starts: np.ndarray, order: int) -> np.ndarray:
    """Of the places that hashes() covers those that lie in a text, not in the spaces before one."""
    own = np.ones(max(0, int(starts[-1]) - order + 1), bool)
    if len(starts) > 2:
        own[(starts[1:-1, None] - (order - 1) + np.arange(order - 1)).ravel()] = False
    return own


def gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """gram with its toxic and ordinary counts over rows of (text, toxic, apart): in all rows, and as toxic_near, ordinary_near in those not apart."""
    names = ["toxic", "ordinary", "toxic_near", "ordinary_near"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, sides, size = [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal texts, sides, size
            codes, starts = streams(texts, order)
            own = own_places(starts, order)
            _, first, which = np.unique(hashes(codes, order)[1][own], return_index=True, return_inverse=True)
            places = np.flatnonzero(own)[first]
            side = np.repeat(np.array(sides, np.int64), np.diff(starts) - (order - 1))
            tally = np.bincount(which * 4 + side, minlength=4 * len(first)).reshape(-1, 4) if len(first) else np.zeros((0, 4), np.int64)
            stream = codes.astype("<u4").tobytes().decode("utf-32-le")
            grams = pa.array([stream[i : i + order] for i in places.tolist()], pa.string())
            toxic, ordinary = tally[:, 0] + tally[:, 2], tally[:, 1] + tally[:, 3]
            texts, sides, size = [], [], 0
            return pa.RecordBatch.from_arrays([grams, *[pa.array(x) for x in (toxic, ordinary, tally[:, 0], tally[:, 1])]], names=["gram", *names])

        for batch in batches:
            for text, toxic, apart in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for at in range(0, len(text or ""), COUNTED) or [0]:  # a huge text is counted in parts, which share the context
                    texts.append(text[max(0, at - order + 1) : at + COUNTED] if text else None)
                    sides.append((0 if toxic else 1) + (2 if apart else 0))
                    size += len(texts[-1] or "")
                    if size >= COUNTED:
                        yield out()
        yield out()

    counted = rows.select("text", "toxic", "apart").mapInArrow(count, "gram string, " + ", ".join(f"{n} long" for n in names))
    return counted.groupBy("gram").agg(*[F.sum(n).alias(n) for n in names])


def discount(table: DataFrame, column: str) -> float:
    ones, twos = table.agg(F.count_if(F.col(column) == 1), F.count_if(F.col(column) == 2)).first()
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


def backoff(grams: DataFrame, order: int) -> DataFrame:
    """tail (a gram without its first letter) and its shared probability, from continuation counts of all shorter orders."""
    kinds = grams.select("gram")
    levels = []
    for size in range(order - 1, 0, -1):
        kinds = kinds.select(F.expr(f"substring(gram, 2, {size})").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
        levels.append((size, kinds))
    below: DataFrame | None = None
    for size, kinds in reversed(levels):
        d = discount(kinds, "n")
        if below is None:
            total = kinds.agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
            share = (F.col("n") - d + d * F.col("kinds") / (F.col("kinds") + 1)) / F.col("all")
            below = kinds.crossJoin(F.broadcast(total)).select("gram", share.alias("p"))  # one row of totals
            continue
        context = F.expr(f"substring(gram, 1, {size - 1})")
        totals = kinds.groupBy(context.alias("context")).agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        shorter = below.select(F.col("gram").alias("shorter"), F.col("p").alias("q"))
        joined = kinds.withColumn("context", context).join(totals, "context").withColumn("shorter", F.expr(f"substring(gram, 2, {size - 1})")).join(shorter, "shorter")
        below = joined.select("gram", ((F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("kinds") * F.col("q")) / F.col("all")).alias("p"))
    return below.select(F.col("gram").alias("tail"), "p")


def differences(grams: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """(gram, difference of log-likelihoods) of seen grams, and (context, difference) for what was never seen after it."""
    rates = {c: discount(grams, c) for c in ("toxic", "ordinary")}
    context, tail = F.expr(f"substring(gram, 1, {order - 1})"), F.expr(f"substring(gram, 2, {order - 1})")
    sides = [x for c in rates for x in (F.sum(c).alias(f"{c}_all"), F.count_if(F.col(c) > 0).alias(f"{c}_kinds"))]
    contexts = written(grams.groupBy(context.alias("context")).agg(*sides), "kn-contexts")
    left = {c: F.when(F.col(f"{c}_all") > 0, rates[c] * F.col(f"{c}_kinds") / F.col(f"{c}_all")).otherwise(1.0) for c in rates}
    unseen = contexts.select("context", (F.log(left["toxic"]) - F.log(left["ordinary"])).alias("d"))
    joined = grams.withColumn("context", context).withColumn("tail", tail).join(contexts, "context").join(backoff(grams, order), "tail")
    p = {c: F.when(F.col(f"{c}_all") > 0, F.greatest(F.col(c) - rates[c], F.lit(0.0)) / F.col(f"{c}_all")).otherwise(0.0) + left[c] * F.col("p") for c in rates}
    seen = joined.select("gram", (F.log(p["toxic"]) - F.log(p["ordinary"])).alias("d"))
    return seen, unseen


def hashed(rows: DataFrame, key: str, order: int) -> DataFrame:
    """block (of the context), key (hash) and d of rows of the two tables."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size = batch.column(0).to_pylist(), order if key == "gram" else order - 1
            codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").reshape(-1, size)
            wide = np.zeros((len(codes), order), np.uint64)
            wide[:, :size] = codes
            context, gram = hashes(wide.ravel(), order)
            yield pa.RecordBatch.from_arrays([pa.array(context[::order].view(np.int64)), pa.array((gram if key == "gram" else context)[::order].view(np.int64)), batch.column(1)], names=["context", "key", "d"])

    return rows.select(key, "d").mapInArrow(work, "context long, key long, d double").withColumn("kind", F.lit(key))


class Table:
    """Differences by 64-bit key: keys in order, and where those of each head (highest bits) start."""

    def __init__(self, keys: np.ndarray, d: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.d = keys[order], d[order].astype(np.float32)
        self.bits = max(1, int(len(keys)).bit_length())
        heads = (self.keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.starts = np.searchsorted(heads, np.arange((1 << self.bits) + 1)).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The difference of each key, and whether it has one."""
        out, known = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        head = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[head], self.starts[head + 1]
        left = np.flatnonzero(at < end)
        at, end, keys = at[left], end[left], keys[left]
        while len(left):
            hit = self.keys[at] == keys
            out[left[hit]], known[left[hit]] = self.d[at[hit]], True
            at = at + 1
            more = ~hit & (at < end)
            left, at, end, keys = left[more], at[more], end[more], keys[more]
        return out, known


class Block:
    """Both tables of the contexts whose hash is `number` modulo `blocks`."""

    def __init__(self, seen: Table, unseen: Table, number: int, blocks: int, order: int):
        self.seen, self.unseen, self.number, self.blocks, self.order = seen, unseen, number, blocks, order

    def differences(self, codes: np.ndarray) -> np.ndarray:
        """Difference of log-likelihoods at each place from order - 1 on; 0 at those of other blocks."""
        context, gram = hashes(codes, self.order)
        d, known = self.seen.find(gram)
        rest = np.flatnonzero(~known)
        d[rest] = self.unseen.find(context[rest])[0]
        if self.blocks > 1:
            d[context % np.uint64(self.blocks) != self.number] = 0
        return d


def features_of(d: np.ndarray, shape: Shape) -> list[float]:
    """Differences per letter in the strongest separate runs of shape.run letters (means of so many), in the strongest longer runs, in the whole text, and its log length."""
    sums = np.concatenate([[0.0], np.cumsum(d, dtype=np.float64)])

    def runs(size: int) -> np.ndarray:
        return sums[size:] - sums[:-size] if len(d) > size else sums[-1:]

    own, found = runs(shape.run).copy(), []
    while len(found) < max(shape.strongest):
        k = int(own.argmax())
        if own[k] <= 0:
            break
        found.append(float(own[k]))
        own[max(0, k - shape.run + 1) : k + shape.run] = -np.inf
    return [sum(found[:n]) / (shape.run * n) for n in shape.strongest] + [float(runs(size).max()) / size for size in shape.runs] + [float(sums[-1]) / max(1, len(d)), math.log(len(d) + 10)]


def groups(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about COMPARED characters."""
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= COMPARED:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def curve(features: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and scale of a logistic curve, by Newton steps with a small ridge; shares: how many rows each one stands for."""
    scale = np.stack([features.mean(0), features.std(0) + 1e-6])
    x = np.hstack([(features - scale[0]) / scale[1], np.ones((len(features), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = np.diag([*[0.05] * features.shape[1], 1e-4])
    shares = shares * len(shares) / shares.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (shares * p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(len(w)), x.T @ (shares * (p - labels)) + ridge @ w)
    return w, scale


class Model:
    """A fitted model: broadcast blocks of tables, and the curve; without tables the score is the share."""

    def __init__(self, blocks: list, weights, scale, share: float, shape: Shape = SHAPE):
        self.blocks, self.weights, self.scale, self.share, self.shape = blocks, weights, scale, share, shape

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.share)
        x = np.hstack([(features - self.scale[0]) / self.scale[1], np.ones((len(features), 1))])
        return 1 / (1 + np.exp(-np.clip((x * self.weights).sum(1), -30, 30)))  # row by row, so that equal rows get equal scores


def with_evidence(docs: DataFrame, blocks: list, last, outputs: list, shape: Shape) -> DataFrame:
    """docs with outputs made by last(features of texts); every block but the last adds its differences to a column that is dropped."""
    evidence, df, order = free_name(docs, "evidence"), docs, shape.order

    def differences(block, batch, held: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        texts = batch.column(0).to_pylist()
        for a, b in groups(texts):
            codes, starts = streams(texts[a:b], order)
            d = block.value.differences(codes) if block else np.zeros(max(0, len(codes) - order + 1), np.float32)
            if held:
                d = d + np.frombuffer(b"".join(x + bytes(4 * (order - 1)) for x in batch.column(1)[a:b].to_pylist())[: 4 * len(d)], "<f4")
            for x, y in zip(starts.tolist(), starts[1:].tolist()):
                yield d[x : max(x, y - order + 1)]

    for k, block in enumerate(blocks[:-1]):
        needs = ["text", evidence] if k else ["text"]
        df = add_columns(df, [(evidence, T.BinaryType())], lambda block=block, held=k > 0: lambda batch: [[x.tobytes() for x in differences(block, batch, held)]], needs)
    held, block = len(blocks) > 1, blocks[-1] if blocks else None
    made = add_columns(df, outputs, lambda: lambda batch: last(np.array([features_of(x, shape) for x in differences(block, batch, held)]).reshape(-1, shape.features)), ["text", evidence] if held else ["text"])
    return made.drop(evidence)


def tables(grams: DataFrame, order: int) -> list:
    """Broadcast blocks of the differences of grams (gram, toxic, ordinary)."""
    spark = grams.sparkSession
    seen, unseen = differences(grams, order)
    rows = written(hashed(seen, "gram", order).unionByName(hashed(unseen, "context", order)), "kn-differences")
    blocks = max(1, -(-rows.count() // TABLE_ROWS))
    out = []
    for b in range(blocks):
        # modulo of an unsigned number, from its upper and lower half
        upper, lower = F.shiftrightunsigned("context", 32), F.col("context").bitwiseAND(0xFFFFFFFF)
        own = rows if blocks == 1 else rows.where(((upper % blocks) * ((1 << 32) % blocks) + lower) % blocks == b)
        got = own.select("key", F.col("d").cast("float").alias("d"), (F.col("kind") == "gram").alias("seen")).toArrow()
        kind = got["seen"].to_numpy().astype(bool)
        keys, d = got["key"].to_numpy().view(np.uint64), got["d"].to_numpy()
        out.append(spark.sparkContext.broadcast(Block(Table(keys[kind], d[kind]), Table(keys[~kind], d[~kind]), b, blocks, order)))
    return out


def curve_sample(rows: DataFrame) -> DataFrame:
    """CURVE_ROWS rows of each class at most, by a hash, with the rows that each stands for as weight."""
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    spread, out = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(1 << 20)), None
    for kind, n in totals.items():
        least = max(1, min(1 << 20, int(CURVE_ROWS / n * (1 << 20))))
        part = rows.where((F.col("toxic") == kind) & (spread < least)).select("text", "toxic", F.lit((1 << 20) / least).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out if len(totals) > 1 else None


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, shape: Shape = SHAPE) -> Model:
    """A model from labelled documents; learn tells which doc_id may teach (all by default)."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") != 0).cast("int").alias("toxic")).distinct()
    known = written(known.where(learn) if learn is not None else known, "toxicity-labels")
    apart = (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("apart")
    rows = docs.select("doc_id", "text").join(sized(known, BROADCAST_LABELS), "doc_id").select("doc_id", "text", "toxic", apart)
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or toxic in (0, n):
        return Model([], None, None, toxic / n if n else 0.0, shape)
    grams = written(gram_counts(rows, shape.order), "kn-grams")
    near = grams.where("toxic_near + ordinary_near > 0").select("gram", F.col("toxic_near").alias("toxic"), F.col("ordinary_near").alias("ordinary"))
    blocks = tables(near, shape.order)
    sample = curve_sample(rows.where("apart"))
    outputs = [(f"f{i}", T.DoubleType()) for i in range(shape.features)]
    got = with_evidence(sample if sample is not None else curve_sample(rows), blocks, lambda x: list(x.T), outputs, shape).drop("text").toPandas()
    for block in blocks:
        block.unpersist()
    weights, scale = curve(got[[f"f{i}" for i in range(shape.features)]].to_numpy(), got["toxic"].to_numpy(float), got["weight"].to_numpy(float))
    return Model(tables(grams.select("gram", "toxic", "ordinary"), shape.order), weights, scale, toxic / n, shape)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with the score and the prediction (1 from the threshold on) under the given names."""
    blocks = model.blocks
    curve_only = Model([], model.weights, model.scale, model.share)

    def last(features: np.ndarray) -> list:
        p = curve_only.score(features)
        return [p.tolist(), (p >= threshold).astype(int).tolist()]

    return with_evidence(docs, blocks, last, [(names[0], T.DoubleType()), (names[1], T.IntegerType())], model.shape)


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted; learns from the rows that aren't held out."""
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit(docs, labels, ~held)
    return score(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def area(scored: DataFrame) -> float:
    """Area under the curve of (score, toxic): the share of pairs of a toxic and another row in which the toxic one has the higher score.

    Rows are counted by their score to six digits first, so a running sum over these values gives it.
    """
    counts = scored.groupBy(F.round("score", 6).alias("score")).agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o")).toPandas().sort_values("score")
    below = counts["o"].cumsum() - counts["o"]
    return float((counts["t"] * (below + counts["o"] / 2)).sum() / (counts["t"].sum() * counts["o"].sum()))


def choose(docs: DataFrame, labels: DataFrame, shapes: list[Shape], learn: Column, folds: Column, numbers: list[int]) -> list[tuple[float, Shape]]:
    """(mean area under the curve, shape), best first: each fold of the learning rows is scored by models of the other folds.

    Rows that may not teach take no part.
    """
    known = labels.where(learn & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") != 0).cast("int").alias("toxic")).distinct()
    known = written(known, "choice-labels")
    found = []
    for shape in shapes:
        areas = []
        for k in numbers:
            model = fit(docs, known, folds != k, shape)
            areas.append(area(score(docs.select("doc_id", "text").join(known.where(folds == k), "doc_id"), model).select("score", "toxic")))
        found.append((sum(areas) / len(areas), shape))
    return sorted(found, key=lambda x: -x[0])


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that are not predicted toxic, with all their columns; all labels teach."""
    names = free_name(docs, "score"), free_name(docs, "predicted")
    scored = score(docs, fit(docs, labels), names=names)
    return scored.where(F.col(names[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
