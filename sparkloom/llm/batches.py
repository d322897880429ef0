"""Bounded blocks of an Arrow text column."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def text_blocks(column: pa.Array, rows: int = 500, chars: int = 1 << 22) -> Iterator[tuple[int, list]]:
    """(first row, values) of consecutive blocks of at most ``rows`` rows and about ``chars`` characters."""
    first, block, size = 0, [], 0
    for value in column:
        text = value.as_py()
        block.append(text)
        size += len(text) if text is not None else 0
        if len(block) == rows or size >= chars:
            yield first, block
            first, block, size = first + len(block), [], 0
    if block:
        yield first, block
