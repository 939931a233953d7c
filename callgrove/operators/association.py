"""Per-variant logistic regression of case status, and views of its results."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callgrove.operators import tiles
from callgrove.shared import sized, written

VALUES = ["beta", "se", "odds_ratio", "ci_low", "ci_high", "z", "p"]

#: Newton steps, the largest change that ends them, and the largest coefficient and error of a fit that has settled.
STEPS, TOLERANCE, LARGEST, LARGEST_SE = 25, 1e-8, 30.0, 1e3
OPEN, DONE, FAILED = 0.0, 1.0, 2.0

#: Calls of a variant up to which a task fits it whole, and calls of the variants that are fitted together.
LIGHT, TOGETHER = 1 << 18, 1 << 18


def person_blocks(people: DataFrame, samples: DataFrame, names: list[str]) -> DataFrame:
    """(block, data): a row for each sample of the block: 1, the covariates less their mean over their spread, and case status.

    Covariates that do not vary are left out. Case status is the last column.
    """
    who, used = standardised(people, names)
    row = F.array(F.lit(1.0), *used, "__y")
    placed = samples.join(who.select("sample_id", row.alias("row")), "sample_id").select("block", "at", "row")

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        data = group["row"].combine_chunks().flatten().to_numpy()
        return pa.Table.from_batches([tiles.as_table([(group["block"][0].as_py(), data)])])

    return written(placed.groupBy("block").applyInArrow(pack, "block long, data binary").withColumn("width", F.lit(len(used) + 2)), "people")


def normal_equations(cells: DataFrame, people: DataFrame, state: DataFrame, width: int) -> DataFrame:
    """(block, data): for each variant of a block the gradient and the matrix of second derivatives, summed over all blocks of samples."""
    met = cells.join(people.select(F.col("block").alias("sb"), F.col("data").alias("who")), "sb").join(state.select(F.col("block").alias("vb"), F.col("data").alias("fit")), "vb")

    def product(vb: int, i: bytes, j: bytes, x: bytes, who: bytes, fit: bytes) -> tuple[int, np.ndarray]:
        own, fits = tiles.matrix(who, width), tiles.matrix(fit, width + 1)
        c, y, beta = own[:, :-1], own[:, -1], fits[:, :-1]
        g, there = tiles.dense(i, j, x, len(fits), len(own))
        p = 1 / (1 + np.exp(-np.clip(beta[:, :1] * g + beta[:, 1:] @ c.T, -35, 35)))
        rest, w = (y - p) * there, p * (1 - p) * there
        gradient = np.column_stack([(rest * g).sum(1), rest @ c])
        second = np.empty((len(fits), width, width))
        second[:, 0, 0] = (w * g * g).sum(1)
        second[:, 0, 1:] = second[:, 1:, 0] = (w * g) @ c
        second[:, 1:, 1:] = (w @ (c[:, :, None] * c[:, None, :]).reshape(len(c), -1)).reshape(len(fits), width - 1, width - 1)
        return vb, np.column_stack([gradient, second.reshape(len(fits), -1)]).ravel()

    return tiles.summed_products(met.select("vb", "i", "j", "x", "who", "fit"), product)


def newton_step(fits: np.ndarray, sums: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The next coefficients and state of each variant, and the standard error of the dosage."""
    width = fits.shape[1] - 1
    beta, state, se = fits[:, :-1].copy(), fits[:, -1].copy(), np.full(len(fits), np.nan)
    at = np.flatnonzero(state == OPEN)
    gradient, second = sums[at, :width], sums[at, width:].reshape(-1, width, width)
    whole = np.isfinite(second).all((1, 2))
    at, gradient, second, broken = at[whole], gradient[whole], second[whole], at[~whole]
    state[broken] = FAILED
    # a covariate that does not vary among the samples of a variant depends on the constant: the pseudo-inverse shares their weight
    inverse = np.linalg.pinv(second, rcond=1e-12, hermitian=True)
    move = np.einsum("kij,kj->ki", inverse, gradient)
    beta[at] += move
    variance = inverse[:, 0, 0]
    se[at] = np.sqrt(np.where(variance > 0, variance, np.nan))
    lost = ~np.isfinite(beta[at]).all(1) | (np.abs(beta[at]).max(1) > LARGEST)
    settled = ~lost & (np.abs(move).max(1) < tolerance)
    state[at[lost | settled & ~(se[at] < LARGEST_SE)]] = FAILED
    state[at[settled & (se[at] < LARGEST_SE)]] = DONE
    beta[state == FAILED] = 0
    return np.column_stack([beta, state]), se


def newton(cells: DataFrame, people: DataFrame, variants: DataFrame, width: int, steps: int, tolerance: float) -> DataFrame:
    """(block, data): coefficients (the dosage's first), state and standard error of each variant of a block.

    Each step is one pass over the tiles; a written table of the coefficients is all that goes from one to the next.
    """
    sizes = variants.groupBy("block").agg(F.count("*").alias("m"))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield tiles.as_table([(b, np.zeros((m, width + 1)))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, fit, error, sums in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fits = tiles.matrix(fit, width + 1)
                new, se = newton_step(fits, tiles.matrix(sums, width + width * width), tolerance)
                old = np.frombuffer(error, "<f8") if error else np.full(len(fits), np.nan)
                se = np.where(np.isnan(se), old, se)
                names = ["block", "data", "error", "open"]
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([new.tobytes()]), pa.array([se.tobytes()]), pa.array([int((new[:, -1] == OPEN).sum())])], names=names)

    state = sizes.mapInArrow(begin, "block long, data binary").withColumn("error", F.lit(None).cast("binary")).withColumn("open", F.lit(1).cast("long"))
    for _ in range(steps):
        active = state.where("open > 0")
        sums = normal_equations(cells, people, active, width).select(F.col("block").alias("b"), F.col("data").alias("sums"))
        moved = active.join(sums, F.col("block") == F.col("b")).select("block", "data", "error", "sums").mapInArrow(step, "block long, data binary, error binary, open long")
        state = written(moved.unionByName(state.where("open = 0")), "newton")
        if not state.where("open > 0").head(1):
            break
    return state.select("block", "data", "error")


def standardised(people: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """people with covariates less their mean over their spread, and the names of those that vary."""
    spread = people.agg(*[F.struct(F.avg(n).alias("m"), F.stddev_pop(n).alias("s")).alias(n) for n in names]).first() if names else {}
    used = [n for n in names if spread[n]["s"]]
    return people.select("sample_id", "__y", *[((F.col(n) - spread[n]["m"]) / spread[n]["s"]).alias(n) for n in used]), used


def values_of(beta: np.ndarray, se: np.ndarray, done: np.ndarray, quantile: float) -> list[pa.Array]:
    """VALUES and the code of fits; NULLs where they are not done."""
    beta, se = np.where(done, beta, 0.0), np.where(done, se, 1.0)
    z = beta / se
    tail = np.fromiter(map(math.erfc, np.abs(z) / math.sqrt(2)), float, len(z))
    values = (beta, se, np.exp(beta), np.exp(beta - quantile * se), np.exp(beta + quantile * se), z, tail)
    return [*[pa.array(v, mask=~done) for v in values], pa.array(np.where(done, ".", "UNFINISHED").tolist(), pa.string())]


def light_fits(usable: DataFrame, people: DataFrame, names: list[str], steps: int, tolerance: float, unsettled: bool, quantile: float) -> DataFrame:
    """(v, VALUES, code) of variants whose calls fit into a task: each call takes its sample's covariates once, all steps run there."""
    who, used = standardised(people, names)
    rows = usable.join(sized(who.drop("__y").withColumnsRenamed({n: f"__c{k}" for k, n in enumerate(used)})), "sample_id")
    columns = [f"__c{k}" for k in range(len(used))]
    width = len(used) + 2
    upper = [(a, b) for a in range(width) for b in range(a, width)]

    def sums(x: list[np.ndarray], y: np.ndarray, starts: np.ndarray, lengths: np.ndarray, beta: np.ndarray) -> np.ndarray:
        line = sum(np.repeat(beta[:, k], lengths) * c for k, c in enumerate(x))
        p = 1 / (1 + np.exp(-np.clip(line, -35, 35)))
        rest, w = y - p, p * (1 - p)
        out = np.empty((len(starts), width + width * width))
        for k, c in enumerate(x):
            out[:, k] = np.add.reduceat(rest * c, starts)
        for a, b in upper:
            out[:, width + a * width + b] = out[:, width + b * width + a] = np.add.reduceat(w * x[a] * x[b], starts)
        return out

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tiles.whole_groups(batches, "variant_id", TOGETHER):
            variant = table["variant_id"].to_numpy()
            starts = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
            lengths = np.diff(np.r_[starts, len(variant)])
            g, y = table["gt"].to_numpy().astype(float), table["__y"].to_numpy()
            x = [g, np.ones(len(g)), *[table[c].to_numpy() for c in columns]]
            fits, errors = np.zeros((len(starts), width + 1)), np.full(len(starts), np.nan)
            for _ in range(steps):
                at = np.flatnonzero(fits[:, -1] == OPEN)
                if not len(at):
                    break
                mine = np.repeat(fits[:, -1] == OPEN, lengths)
                many = lengths[at]
                new, se = newton_step(fits[at], sums([c[mine] for c in x], y[mine], np.cumsum(many) - many, many, fits[at, :-1]), tolerance)
                fits[at], errors[at] = new, np.where(np.isnan(se), errors[at], se)
            done = (fits[:, -1] == DONE) | (unsettled & (fits[:, -1] == OPEN) & np.isfinite(errors))
            yield pa.RecordBatch.from_arrays([pa.array(variant[starts]), *values_of(fits[:, 0], errors, done, quantile)], names=["v", *VALUES, "code"])

    kind = usable.schema["variant_id"].dataType.simpleString()
    together = rows.select("variant_id", "gt", "__y", *columns).repartition("variant_id").sortWithinPartitions("variant_id")
    return together.mapInArrow(fitted, f"v {kind}, " + ", ".join(f"{v} double" for v in VALUES) + ", code string")


def heavy_fits(usable: DataFrame, people: DataFrame, names: list[str], steps: int, tolerance: float, unsettled: bool, quantile: float) -> DataFrame:
    """(v, VALUES, code) by tiles: all variants of a block share the matrix of covariates of a block of samples, and a step of
    Newton's method adds up the normal equations over these blocks, so no group grows with the cohort."""
    samples, variants = tiles.blocks_of(people, "sample_id"), tiles.blocks_of(usable, "variant_id")
    who = person_blocks(people, samples, names)
    width = who.select("width").head(1)[0][0] if who.head(1) else 2
    fits = newton(tiles.tiled(usable, "gt", variants, samples), who, variants, width, steps, tolerance)

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, fit, error in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own, se = tiles.matrix(fit, width + 1), np.frombuffer(error, "<f8")
                done = (own[:, -1] == DONE) | (unsettled & (own[:, -1] == OPEN) & np.isfinite(se))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), b)), pa.array(np.arange(len(own), dtype=np.int32)), *values_of(own[:, 0], se, done, quantile)], names=["b", "place", *VALUES, "code"])

    found = fits.mapInArrow(said, "b long, place int, " + ", ".join(f"{v} double" for v in VALUES) + ", code string")
    return variants.join(found, (F.col("block") == F.col("b")) & (F.col("at") == F.col("place"))).select(F.col("variant_id").alias("v"), *VALUES, "code")


def logistic_scan(calls: DataFrame, pheno: DataFrame, covars: DataFrame, names: list[str], ci: float = 0.95, steps: int = STEPS, tolerance: float = TOLERANCE, unsettled: bool = False) -> DataFrame:
    """Odds ratio, standard error, interval, z and p of the dosage for each variant, with covariates (sample_id, names).

    pheno is 1 (control) or 2 (case). Variants of LIGHT calls at most are fitted in the task that has their calls; those of more go by tiles.
    A fit that fails has NULLs and an error code; `unsettled` keeps coefficients that are still moving after the last step.
    """
    people = written(pheno.join(covars, "sample_id").select("sample_id", (F.col("pheno") == 2).cast("double").alias("__y"), *names).dropna(subset=["__y", *names]), "people-rows")
    rows = calls.where("gt IS NOT NULL").select("variant_id", "sample_id", "gt").join(sized(people.select("sample_id", "__y")), "sample_id")
    rows = written(rows, "scan-calls")
    counts = rows.groupBy("variant_id").agg(F.count("*").alias("n"), (F.min("__y") == F.max("__y")).alias("one_class"), (F.min("gt") == F.max("gt")).alias("one_dosage"))
    counts = written(counts, "scan-counts")
    quantile = 1.959963984540054 if ci == 0.95 else float(np.sqrt(2) * _erfinv(ci))
    fit = counts.where("NOT one_class AND NOT one_dosage")
    light, heavy = fit.where(F.col("n") <= LIGHT).select("variant_id"), fit.where(F.col("n") > LIGHT).select("variant_id")
    asked = (people, names, steps, tolerance, unsettled, quantile)
    placed = light_fits(rows.join(light, "variant_id", "left_semi"), *asked)
    if heavy.head(1):
        placed = placed.unionByName(heavy_fits(rows.join(heavy, "variant_id", "left_semi"), *asked))
    code = F.when(F.col("one_class"), "NO_CONTRAST").when(F.col("one_dosage"), "CONST_ALLELE").otherwise(F.coalesce("code", F.lit("UNFINISHED")))
    return counts.join(placed, F.col("variant_id") == F.col("v"), "left").select("variant_id", "n", *VALUES, code.alias("errcode"))


def _erfinv(p: float) -> float:
    low, high = 0.0, 6.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid) < p else (low, mid)
    return low


def assoc_view(results: DataFrame, variants: DataFrame, lead: float = 5e-8, span: int = 500_000) -> DataFrame:
    """Results with place, -log10 p, the expected value by rank, and is_lead: the least p of its stretch of the chromosome.

    Ranks come from counts per (chrom, stretch) and a window inside the stretch ordered by p over the whole: p values are
    bucketed by magnitude first, so the running count over buckets is small and no window spans all rows.
    """
    placed = results.where("p IS NOT NULL").join(variants.select("variant_id", "chrom", "pos"), "variant_id").withColumn("neg_log10_p", -F.log10("p"))
    placed = written(placed.withColumn("bucket", F.floor(F.col("p") * 4096).cast("int")), "assoc")
    counts = placed.groupBy("bucket").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most 4,097 rows
    base = counts.select("bucket", before.alias("before"), F.sum("k").over(Window.partitionBy(F.lit(1))).alias("total"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("p", "variant_id"))
    ranked = placed.join(F.broadcast(base), "bucket").withColumn("expected", -F.log10((rank - 0.5) / F.col("total")))
    stretch = Window.partitionBy("chrom", F.floor(F.col("pos") / span))
    best = F.min(F.struct("p", "variant_id")).over(stretch)
    return ranked.withColumn("is_lead", (F.col("p") < lead) & (best["variant_id"] == F.col("variant_id"))).drop("bucket", "before", "total")


def covariates(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """Sex and components of each sample; samples without scores keep NULLs."""
    pcs = [c for c in scores.columns if c.startswith("pc")]
    return samples.select("sample_id", "sex").join(scores.select("sample_id", *pcs), "sample_id", "left")


def assemble(samples: DataFrame, kept: DataFrame, removed: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Final sample list, phenotypes and covariates: listed samples less the removed ones."""
    final = samples.join(kept.select("sample_id"), "sample_id", "left_semi").join(removed.select("sample_id"), "sample_id", "left_anti")
    return final.select("sample_id", "iid"), final.select("sample_id", "iid", "pheno"), covariates(final, scores)
