"""Split long messages into chunks. Each cut depends on the one before it, hence Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Message limits of the two alert channels.
HEADED_LIMIT = 2000
PLAIN_LIMIT = 4096


def _pieces(text: str, sizes):
    """Yield pieces of at most next(sizes) characters, cut at the last newline where there is one."""
    start, end = 0, len(text)
    while start < end:
        size = next(sizes)
        if end - start <= size:
            yield text[start:]
            return
        cut = text.rfind("\n", start, start + size)
        if cut <= start:
            cut = start + size
        yield text[start:cut]
        start = cut
        while start < end and text[start] == "\n":
            start += 1


#: Rows that are Python strings at one time; Arrow holds the rest of a batch.
ROWS = 256


def _in_slices(split: Callable, *columns: pa.Array) -> pa.Array:
    """The chunks of each row, null where a value is null."""
    kind, out = pa.list_(pa.string()), []
    for low in range(0, len(columns[0]), ROWS):
        rows = zip(*(c.slice(low, ROWS).to_pylist() for c in columns))
        out.append(pa.array([None if None in row else split(*row) for row in rows], kind))
    return pa.concat_arrays(out) if out else pa.array([], kind)


def chunk_text(text: Column, limit: int = PLAIN_LIMIT) -> Column:
    """Chunks of at most `limit` characters, as an array."""

    def split(text: str) -> list[str]:
        if len(text) <= limit:
            return [text]
        return list(_pieces(text, iter(lambda: limit, None)))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def chunks(texts: pa.Array) -> pa.Array:
        return _in_slices(split, texts)

    return chunks(text)


def chunk_text_header(header: Column, body: Column, limit: int = HEADED_LIMIT) -> Column:
    """Chunks of at most `limit` characters that each start with the header."""

    def split(header: str, body: str) -> list[str]:
        first, later = f"{header}\n\n", f"{header} (cont.)\n\n"
        if len(first) + len(body) <= limit:
            return [first + body]
        if len(later) >= limit:
            raise ValueError(f"header of {len(header)} characters leaves no room in chunks of {limit}")

        def sizes():
            yield limit - len(first)
            while True:
                yield limit - len(later)

        return [(later if i else first) + piece for i, piece in enumerate(_pieces(body, sizes()))]

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def chunks(headers: pa.Array, bodies: pa.Array) -> pa.Array:
        return _in_slices(split, headers, bodies)

    return chunks(header, body)
