"""Token counts of sections from one encoding of the whole document.

A document is encoded once; the ids' lengths give every token's span.  Sections
cover the text without gaps (sentences, or what ``section_end`` ends), and an
interval join of token spans with sections, a search in the sections' ends, gives
each token to one section.  A token that crosses a boundary is counted by rule:
``start`` gives it to the section of its first byte, ``end`` to that of its last,
``most`` to the section that holds most of its bytes (the earlier if equal).

Spans are kept in bytes, where sections begin between characters; section bounds
are given in characters.

Defined cases: a null or empty text is one empty section without tokens; a text
that ends with the end of a section has no further section behind it; null ids and repeated
rows are kept as they are; an empty table gives no rows; other columns are
ignored; the strings of special tokens are ordinary text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeledger.llm.bpe import pieces_by_id, read_ranks
from rangeledger.llm.common import add_columns, in_small_batches

RULES = ("start", "end", "most")
#: A sentence ends with its mark and the white space behind it, which the next word's token also holds.
SENTENCE_END = r"[.!?]\s"


def attribute(lengths: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens counted for each section, and how many of these cross a boundary.

    ``lengths`` are the tokens' bytes in order, ``section_ends`` ascending."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, ends - 1, side="right")
    crossing = first != last
    owner = first if rule == "start" else last
    if rule == "most":
        owner = first.copy()
        two = np.flatnonzero(last == first + 1)
        inner = section_ends[first[two]]
        owner[two] += ends[two] - inner > inner - starts[two]
        for t in np.flatnonzero(last > first + 1):  # a token over whole sections
            held = np.diff([starts[t], *section_ends[first[t] : last[t]], ends[t]])
            owner[t] = first[t] + int(np.argmax(held))
    n = len(section_ends)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def sections_of(text: str, end: re.Pattern) -> list[str]:
    """The parts of a text, each up to and with a match of ``end``; one empty part for none."""
    at, out = 0, []
    for found in end.finditer(text):
        out.append(text[at : found.end()])
        at = found.end()
    return [*out, text[at:]] if at < len(text) or not out else out


def section_token_counts(docs: DataFrame, rank_file: str, pattern: str, rule: str = "most", section_end: str = SENTENCE_END) -> DataFrame:
    """Per section of a document: doc_id, section, char_start, char_end, n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    light = in_small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = read_ranks(rank_file)
        encoding = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = np.array([len(p) for p in pieces_by_id(ranks)], dtype=np.int64)
        for batch in batches:
            row, columns = [], []
            for n, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                sections = sections_of(text, re.compile(section_end))
                chars = np.cumsum([len(s) for s in sections])
                ends = chars if text.isascii() else np.cumsum([len(s.encode()) for s in sections])
                counted, crossing = attribute(size[np.array(encoding.encode_ordinary(text), dtype=np.int64)], ends, rule)
                row.append(np.full(len(sections), n))
                columns.append((np.arange(len(sections)), np.concatenate([[0], chars[:-1]]), chars, counted, crossing))
            if row:
                whole = [np.concatenate(c).astype(np.int64) for c in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(row))), *map(pa.array, whole)], names=schema.fieldNames())

    long = T.LongType()
    schema = add_columns(T.StructType([light.schema["doc_id"]]), ("section", long), ("char_start", long), ("char_end", long), ("n_tokens", long), ("n_crossing", long))
    return light.mapInArrow(run, schema)
