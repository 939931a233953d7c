"""Fields of lines that are parted by tabs, whole Arrow columns at once, without those that say nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of lines that are looked at together.
TEXT = 4 << 20


def parts_of(lines: pa.Array) -> Iterator[pa.Array]:
    """The lines a few at a time: as many as have TEXT bytes together, one at least."""
    ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    at = 0
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + TEXT, "right")) - 1)
        yield lines.slice(at, to - at)
        at = to


def telling(lines: pa.Array, dots: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(line, place, text) of the fields of large_string lines that are not empty or, with dots, not a dot or two of them with / or | between."""
    ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    tabs = np.flatnonzero(data == 9)
    # a field begins with its line or after a tab; two sorted runs each, which a stable sort merges
    start, stop = np.sort(np.concatenate([ends[:-1], tabs + 1]), kind="stable"), np.sort(np.concatenate([tabs, ends[1:]]), kind="stable")
    size = stop - start
    said = size > 0
    if dots:
        said[(size == 1) & (data[np.minimum(start, len(data) - 1)] == 46)] = False
        three = np.flatnonzero(size == 3)
        a, b, c = (data[start[three] + k] for k in range(3))
        said[three[(a == 46) & (c == 46) & ((b == 47) | (b == 124))]] = False
    field = np.flatnonzero(said)
    first = np.arange(len(lines)) + np.searchsorted(tabs, ends[:-1])
    line = np.searchsorted(first, field, "right") - 1
    size = size[field]
    to = np.concatenate([[0], np.cumsum(size)])
    taken = data[np.repeat(start[field] - to[:-1], size) + np.arange(to[-1])]
    return line, field - first[line], pa.StringArray.from_buffers(len(field), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(taken))
