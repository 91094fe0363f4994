"""Byte-level BPE: ranked merges folded over distinct words, and decoding.

All texts are split by the vocabulary's pattern and their distinct words counted.
The most frequent, up to ``dictionary_words``, are encoded by a Spark expression:
a word's bytes become an array of pieces, and ``aggregate`` folds over it, each
step merging the first adjacent pair of lowest rank found in a literal rank map
(hex pieces in hashed buckets).  The result is a dictionary of bounded size, given
to every task.  On the main path Python workers look up the words of their texts;
words outside the dictionary (met once, longer than ``FOLD_BYTES``, or beyond
``dictionary_words``) are merged by the same rule by a small helper there and
remembered up to a bound, so every text is encoded whole.  Decoding concatenates the ids' pieces.

Defined cases: a null text is an empty one and has no ids; words of any length
are merged exactly; the strings of special tokens are ordinary text; null ids and
repeated rows are kept as they are; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import io
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeledger.llm.common import add_columns, cut, cut_small, in_small_batches, lean
from rangeledger.llm.text import slices

RANK_BUCKETS = 1 << 15
#: Longest word (bytes) that the expression encodes; its steps grow with the square.
FOLD_BYTES = 48
_KEPT_WORDS, _KEPT_PARTS = 100_000, 200_000


@functools.lru_cache(maxsize=4)
def read_ranks(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def pieces_by_id(ranks: dict[bytes, int]) -> list[bytes]:
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def merge_ranked(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the leftmost pair of lowest rank is merged until none is left."""
    if word in ranks:
        return [ranks[word]]
    ends = list(range(1, len(word) + 1))  # of the piece that starts at each place
    before, gone = list(range(-1, len(word) - 1)), bytearray(len(word))
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(len(word) - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if gone[i] or ends[i] >= len(word) or ends[ends[i]] != end:
            continue
        gone[ends[i]] = 1
        ends[i] = end
        if end < len(word):
            before[end] = i
            pair = word[i : ends[end]]
            if pair in ranks:
                heapq.heappush(heap, (ranks[pair], i, ends[end]))
        if i:
            j = before[i]
            pair = word[j:end]
            if pair in ranks:
                heapq.heappush(heap, (ranks[pair], j, end))
    ids, i = [], 0
    while i < len(word):
        ids.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return ids


def fold_merges(word: str, ranks: dict[bytes, int]) -> Column:
    """Pieces (hex) of a string column ``word`` of at least one byte."""
    buckets: list[dict[str, int]] = [{} for _ in range(RANK_BUCKETS)]
    for piece, rank in ranks.items():
        name = piece.hex().upper()
        buckets[zlib.crc32(name.encode()) % RANK_BUCKETS][name] = rank
    literal = json.dumps(buckets, separators=(",", ":"))
    pair, none = "p[j - 1] || p[j]", 2**31 - 1
    rank = f"coalesce(try_element_at(element_at(x.ranks, int(pmod(crc32({pair}), {RANK_BUCKETS})) + 1), {pair}), {none})"
    least = f"array_min(transform(sequence(1, size(p) - 1), j -> named_struct('rank', {rank}, 'at', j)))"
    merged = "concat(slice(p, 1, b.at - 1), array(p[b.at - 1] || p[b.at]), slice(p, b.at + 2, size(p)))"
    step = f"if(size(p) < 2, p, element_at(transform(array({least}), b -> if(b.rank = {none}, p, {merged})), 1))"
    start = "transform(sequence(0, length(x.bytes) div 2 - 1), j -> substr(x.bytes, 2 * j + 1, 2))"
    fold = f"aggregate(sequence(1, greatest(length(x.bytes) div 2 - 1, 1)), {start}, (p, i) -> {step})"
    held = f"named_struct('bytes', hex(encode({word}, 'UTF-8')), 'ranks', from_json('{literal}', 'array<map<string,int>>'))"
    return F.expr(f"element_at(transform(array({held}), x -> {fold}), 1)")


def count_words(docs: DataFrame, pattern: str) -> DataFrame:
    """word and n over whole texts; words are dealt by themselves after partial counts."""
    words = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def word_dictionary(docs: DataFrame, ranks: dict[bytes, int], pattern: str, dictionary_words: int) -> bytes:
    """The most frequent words, at most ``dictionary_words``, with their ids (four
    bytes each), packed as an Arrow stream that every task unpacks."""
    counted = cut(count_words(docs, pattern).where((F.col("n") > 1) & (F.octet_length("word") <= FOLD_BYTES) & (F.octet_length("word") > 0)))
    # Counts in steps of a sixteenth of a doubling: some hundred rows at any size.
    step = F.floor(F.log2("n") * 16).cast("int")
    held, least = 0, None
    for row in counted.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.col("step").desc()).collect():
        held += row["words"]
        if held > dictionary_words:
            break
        least = row["step"]
    if least is None:
        return b""
    # Written first: the plan that holds the literal is then one scan and one projection.
    frequent = cut_small(counted.where(step >= least).select("word").repartition(2 * docs.sparkSession.sparkContext.defaultParallelism, "word"))
    by_piece = {piece.hex().upper(): rank for piece, rank in ranks.items()}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array([by_piece[p] for p in row], dtype="<u4").tobytes() for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), pa.array(ids, pa.binary())], names=["word", "ids"])

    folded = frequent.select("word", fold_merges("word", ranks).alias("pieces")).mapInArrow(lean(packed), "word binary, ids binary")
    out = io.BytesIO()
    table = folded.toArrow()  # bounded by dictionary_words
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue()


def unpacked(dictionary: bytes) -> dict[bytes, bytes]:
    if not dictionary:
        return {}
    table = pa.ipc.open_stream(dictionary).read_all()
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))


#: A space before white space or the end, where a word's leading space is not certain.
_LOOSE = re.compile(r" (?:\s|$)")
_STARTS = re.compile(r"(?= [^\s])")


class Encoder:
    """Encodes texts a task at a time, remembering what it has merged (up to a bound)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, dictionary: dict[bytes, bytes]) -> None:
        self.ranks, self.dictionary, self.split = ranks, dictionary, regex.compile(pattern)
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _word(self, word: bytes) -> bytes:
        found = self.dictionary.get(word) or self.words.get(word)
        if found is None:
            if len(self.words) > _KEPT_WORDS:
                self.words.clear()
            found = np.array(merge_ranked(word, self.ranks), dtype="<u4").tobytes()
            if len(word) <= 64:
                self.words[word] = found
        return found

    def _segment(self, segment: str) -> bytes:
        return b"".join([self._word(w.encode()) for w in self.split.findall(segment)])

    def _part(self, part: str) -> bytes:
        """Ids of a space and the part behind it, which does not start with white space."""
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) > _KEPT_PARTS:
                self.parts.clear()
            found = self._segment(" " + part)
            if len(part) <= 64:
                self.parts[part] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids as four little-endian bytes each.

        Every match of the pattern that reaches a space followed by a character
        other than white space starts there, so texts are cut at such spaces."""
        if not text:
            return b""
        if _LOOSE.search(text):
            first, *rest = _STARTS.split(text)
            if not first.startswith(" ") or first[1:2].isspace() or len(first) < 2:
                return self._segment(first) + b"".join([self._part(s[1:]) for s in rest])
            return b"".join([self._part(s[1:]) for s in (first, *rest)])
        first, *rest = text.split(" ")
        get = self.parts.get
        return self._segment(first) + b"".join([get(p) or self._part(p) for p in rest])


def decode_ids(ids: bytes, pieces: list[bytes]) -> bytes:
    """The pieces of ids (four bytes each), one after the other."""
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _given(docs: DataFrame, rank_file: str, pattern: str, dictionary_words: int) -> tuple[DataFrame, Broadcast]:
    """id and text, and what every task needs: the ranks and the dictionary."""
    light = in_small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    ranks = read_ranks(rank_file)
    return light, docs.sparkSession.sparkContext.broadcast((ranks, word_dictionary(light, ranks, pattern, dictionary_words)))


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, dictionary_words: int = 1 << 18) -> DataFrame:
    """Per document: doc_id and ids (binary, four little-endian bytes each)."""
    light, given = _given(docs, rank_file, pattern, dictionary_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(given.value[0], pattern, unpacked(given.value[1]))
        for part in slices(batches):
            ids = [encoder.encode(t.as_py()) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return light.mapInArrow(lean(run), add_columns(T.StructType([light.schema["doc_id"]]), ("ids", T.BinaryType())))


def decode_documents(encoded: DataFrame, rank_file: str) -> DataFrame:
    """Per document: doc_id and the bytes (binary) of its ids."""
    pieces = pieces_by_id(read_ranks(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [decode_ids(x.as_py() or b"", pieces) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], names=["doc_id", "decoded"])

    light = encoded.select("doc_id", "ids")
    return light.mapInArrow(lean(run), add_columns(T.StructType([light.schema["doc_id"]]), ("decoded", T.BinaryType())))


def bpe_round_trip(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = False, dictionary_words: int = 1 << 18) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids).

    A task encodes a text and decodes the ids, so neither goes back to the JVM
    only to be digested."""
    light, given = _given(docs, rank_file, pattern, dictionary_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = Encoder(given.value[0], pattern, unpacked(given.value[1])), pieces_by_id(given.value[0])
        for part in slices(batches):
            kept, count, encoded, decoded = [], [], [], []
            for text in part.column(1):
                ids = encoder.encode(text.as_py())
                count.append(len(ids) // 4)
                encoded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(decode_ids(ids, pieces)).hexdigest())
                kept.append(ids if keep_ids else b"")
            columns = [pa.array(count, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns, *([pa.array(kept, pa.binary())] if keep_ids else [])], names=schema.fieldNames())

    schema = add_columns(T.StructType([light.schema["doc_id"]]), ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))
    schema = add_columns(schema, ("ids", T.BinaryType())) if keep_ids else schema
    return light.mapInArrow(lean(run), schema)
