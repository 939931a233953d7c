"""Calls as tiles, blocks of variants by blocks of samples, and sums of products over them by Arrow batches.

Both kinds of keys are dealt to blocks of SIDE in their order, with a place in the block. A tile holds the cells of one block of variants
and one of samples, so its size does not grow with either, and tiles without a cell are not there: neighbours that share samples share tiles. Matrices that belong to one side are tables of (block, data).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrove.operators.selection import placed
from callgrove.shared import sized, written

#: Keys of a block; bytes of sums that a task holds before it sends them on.
SIDE, HELD = 1024, 64 << 20


def blocks_of(keys: DataFrame, column: str, side: int = SIDE) -> DataFrame:
    """(column, block, at): distinct keys with their block and their place in it, a written table."""
    ranked = placed(keys.select(column).distinct(), [F.col(column)])
    return written(ranked.select(column, F.floor((F.col("place") - 1) / side).alias("block"), F.pmod(F.col("place") - 1, F.lit(side)).cast("int").alias("at")), "blocks")


def tiled(cells: DataFrame, value: str, variants: DataFrame, samples: DataFrame) -> DataFrame:
    """(vb, sb, i, j, x): the cells (variant_id, sample_id, value) of each tile with their places, a written table."""
    v = variants.select("variant_id", F.col("block").alias("vb"), F.col("at").alias("i"))
    s = samples.select("sample_id", F.col("block").alias("sb"), F.col("at").alias("j"))
    met = cells.select("variant_id", "sample_id", F.col(value).cast("double").alias("x")).join(sized(s), "sample_id").join(sized(v), "variant_id")

    def pack(group: pa.Table) -> pa.Table:
        sides = [pa.array([group[c].combine_chunks().to_numpy().astype(t).tobytes()], pa.binary()) for c, t in (("i", "<i2"), ("j", "<i2"), ("x", "<f8"))]
        return pa.table([group["vb"][:1], group["sb"][:1], *sides], names=["vb", "sb", "i", "j", "x"])

    return written(met.select("vb", "sb", "i", "j", "x").groupBy("vb", "sb").applyInArrow(pack, "vb long, sb long, i binary, j binary, x binary"), "tiles")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows of batches that are sorted by a key, with all rows of each of their keys."""
    held, many = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        many += batch.num_rows
        if many < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table[key].combine_chunks()
        if keys[0].equals(keys[-1]):
            continue
        cut = pc.index(keys, keys[-1]).as_py()
        yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        many = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def dense(i: bytes, j: bytes, x: bytes, rows: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The tile as a matrix with 0 where there is no cell, and where there is one."""
    at = np.frombuffer(i, "<i2"), np.frombuffer(j, "<i2")
    out, there = np.zeros((rows, columns)), np.zeros((rows, columns))
    out[at], there[at] = np.frombuffer(x, "<f8"), 1.0
    return out, there


def times(i: bytes, j: bytes, x: bytes, rows: int, columns: int, other: np.ndarray) -> np.ndarray:
    """The tile, rows by columns, times a matrix with a row for each column; a tile of few cells is not made dense."""
    at, by, cells = np.frombuffer(i, "<i2"), np.frombuffer(j, "<i2"), np.frombuffer(x, "<f8")
    if 8 * len(cells) > rows * columns:
        full = np.zeros((rows, columns))
        full[at, by] = cells
        return full @ other
    out = np.zeros((rows, other.shape[1]))
    if len(cells):
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
        out[at[order][starts]] = np.add.reduceat(cells[order, None] * other[by[order]], starts)
    return out


def matrix(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, columns)


def as_table(parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([np.ascontiguousarray(m, "<f8").tobytes() for _, m in parts], pa.binary())], names=["block", "data"])


def mapped(blocks: DataFrame, change: Callable[[np.ndarray], np.ndarray], columns: int) -> DataFrame:
    """Each block's matrix changed on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield as_table([(k, change(matrix(data, columns)))])

    return blocks.select("block", "data").mapInArrow(run, "block long, data binary")


def summed_products(rows: DataFrame, product: Callable[..., tuple[int, np.ndarray]]) -> DataFrame:
    """(block, data): sums by block of product(*row), which gives a block's number and a matrix of one shape for each block.

    A task adds up what it has of a block, up to HELD bytes of blocks, then the parts of a block meet and are added as they come.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                k, m = product(*row)
                held[k] = held[k] + m if k in held else m
                if sum(x.nbytes for x in held.values()) > HELD:
                    yield as_table(list(held.items()))
                    held = {}
        if held:
            yield as_table(list(held.items()))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = None, np.zeros(0)
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data, "<f8")
                if k != own:
                    if own is not None:
                        yield as_table([(own, total)])
                    own, total = k, np.zeros(len(part))
                total = total + part
        if own is not None:
            yield as_table([(own, total)])

    parts = rows.mapInArrow(add, "block long, data binary")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(meet, "block long, data binary")
