"""Results as a stream of column-major chunks of bounded weight."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

Row = TypeVar("Row")

#: Most bytes of a chunk, unless one row alone is heavier.
CHUNK_BYTES = 32_000_000


def groups(rows: Iterable[Row], weight: Callable[[Row], int], most: int) -> Iterator[list[Row]]:
    """Rows in order in groups whose weights sum up to at most ``most``; a group has at least one row."""
    held: list[Row] = []
    total = 0
    for row in rows:
        w = weight(row)
        if held and total + w > most:
            yield held
            held, total = [], 0
        held.append(row)
        total += w
    if held:
        yield held


def row_weight(row: tuple) -> int:
    """8 for an integer, and a text's length in bytes."""
    return sum(8 if isinstance(v, int) else len(v.encode()) for v in row)


def chunks(rows: Iterable[tuple], most: int = CHUNK_BYTES) -> Iterator[dict]:
    for group in groups(rows, row_weight, most):
        yield {"rowCount": len(group), "columns": [list(c) for c in zip(*group)]}


def json_stream(parts: Iterable[dict]) -> Iterator[str]:
    """The chunks as the text of a JSON array; no chunk gives an empty one."""
    yield "["
    for i, part in enumerate(parts):
        yield ("," if i else "") + json.dumps(part, ensure_ascii=False)
    yield "]"
