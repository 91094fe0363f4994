"""Words of whole texts, a bounded piece at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

PIECE_BYTES = 1 << 20
SPACE = b" \t\n\x0b\x0c\r"


def word_pieces(data: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """Lists of the words of ``data``, about ``size`` bytes at a time.

    ``bytes.split`` cuts at runs of 0x20 and 0x09-0x0D; a piece ends at white
    space, so no word is cut."""
    if len(data) <= size:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] not in SPACE:
            end += 1
        yield data[at:end].split()
        at = end


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a bounded number of rows, so that what is made of a
    part goes on before the next is begun."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
