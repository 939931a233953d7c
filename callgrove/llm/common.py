"""Small helpers that the operators share: shared folders, Arrow maps, reading tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from callgrove.shared import new_folder, shared_dir, sized, written  # noqa: F401

#: Rows of one Arrow batch that a Python task holds at once, and bytes of them up to which an operator may ask for more rows.
SLICE_ROWS, SLICE_BYTES = 256, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until df has no column of that name (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    fs, path = opened(uri)
    fs.create_dir(path, recursive=True)


def put_file(uri: str, write: Callable[[object], None]) -> None:
    """Writes beside the target and moves into place, so that a lost or repeated task leaves no half file."""
    fs, path = opened(uri)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(own) as out:
        write(out)
    fs.move(own, path)


def add_columns(df: DataFrame, outputs: list[tuple[str, T.DataType]], make: Callable[[], Callable[[pa.RecordBatch], list]], needs: list[str], rows: int = SLICE_ROWS, without: tuple[str, ...] = ()) -> DataFrame:
    """df with columns computed by Python on Arrow batches.

    make() runs once per task and returns a function from a batch (columns `needs`, renamed to their place: "0", "1", ...)
    to one list of values per output. An input column named like an output is replaced by it, and those of `without` do not
    come back from Python. A batch has SLICE_ROWS rows, or up to `rows` where they are short.
    """
    names = {n for n, _ in outputs}
    kept = [f for f in df.schema.fields if f.name not in names and f.name not in without]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in outputs])
    place = {f.name: i for i, f in enumerate(kept)}
    apart = [c for c in dict.fromkeys(needs) if c not in place]  # a needed column that is kept travels once
    place |= {c: len(kept) + i for i, c in enumerate(apart)}
    carried = df.select(*[df[f"`{f.name}`"] for f in kept], *[df[f"`{c}`"].alias(f"__need{i}") for i, c in enumerate(apart)])
    n_kept, where = len(kept), [place[c] for c in needs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        types = None
        for whole in batches:
            step = max(SLICE_ROWS, min(rows, SLICE_BYTES * whole.num_rows // max(1, whole.nbytes)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                given = pa.RecordBatch.from_arrays([batch.column(i) for i in where], names=[str(i) for i in range(len(needs))])
                types = types or [_arrow(t) for _, t in outputs]
                made = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(work(given), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *made], names=schema.names)

    return carried.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    }[kind.simpleString()]
