"""SimHash near-duplicates: fingerprints and a binary-trie self-join.

Every bit of a fingerprint is the majority of that bit over the XXH64 (seed 42)
of the text's word shingles.  Equal fingerprints are merged first, so copies
never meet in pairs.  Distinct fingerprints within the bit budget agree on one
of ``budget + 1`` segments, whose values deal them into groups; groups above
``group_rows`` are dealt again by segments of their other bits, and what is
still above that by tiles of two hashed chunks.  Within a group a binary trie is
joined with itself: pairs of nodes go down together, differing bits add up, and
a pair above the budget is dropped.  A group gives a spanning forest of its
links, as the links matter only for the components they connect.

``near_duplicates`` links by fingerprints alone.  ``similar_texts`` finds all texts
whose shingle sets have a Jaccard similarity of 0.8 or more.  Such fingerprints
differ in 9.7 bits of 64 on average (the angle of the sets), five deviations more
make a budget of 26 bits, and segments of 64 / 27 bits deal nothing.  So groups
are dealt by min-wise keys of the shingle sets instead: of ``keys`` keys of
``minima`` minima each a pair at similarity s shares none with probability
``(1 - s ** minima) ** keys``, 3e-6 at 0.8.  In a group the same trie join
proposes pairs within the budget, and every pair is confirmed on the whole sets.
Groups above ``group_rows`` are compared with one member first.  Members that this
leaves outside their group's largest component meet the others in tiles, where the
walk drops node pairs that hold one and the same component and pairs are confirmed
in the tile: no pair leaves it but links.

Defined cases: a null or empty text has fingerprint zero, which is linked like
any other (and is similar to texts without words only); fewer words than a shingle make one shingle; rows with a null id are
listed and never name a component unless no other id is in it (then null);
repeated rows share a fingerprint; an empty table gives no rows; columns other
than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeledger.llm.common import cut, cut_small, in_small_batches, join_bounded, lean
from rangeledger.llm.components import components, forest
from rangeledger.llm.text import slices, word_pieces

BITS = 64


def _bit_counts(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of the words of ``text``, A-Z lowered; zero without words."""
    digest = xxhash.xxh64_intdigest
    ones, total, tail, words = np.zeros(BITS, dtype=np.int64), 0, [], []
    for piece in word_pieces((text or "").encode().lower()):
        words = tail + piece
        hashes = [digest(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]
        if hashes:
            ones += _bit_counts(hashes)
            total += len(hashes)
        tail = words[max(0, len(words) - shingle + 1) :] if shingle > 1 else []
    if not total and words:
        ones, total = _bit_counts([digest(b" ".join(words), 42)]), 1
    return int((1 << np.flatnonzero(2 * ones > total).astype(object)).sum()) if total else 0


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    light = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([light.schema["doc_id"], T.StructField("fp", T.LongType())])
    return light.mapInArrow(lean(run), schema)


def trie_pairs(group: np.ndarray, fp: np.ndarray, budget: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) within a group whose fp differ in at most ``budget`` bits.

    ``fp`` (uint64) must be sorted within sorted ``group``.  All groups' tries are
    walked at once, one level of bits after the other; a pair of nodes that hold
    one fingerprint each is settled by all its bits.  With ``label`` only pairs of
    two labels are wanted, and node pairs that hold one label are dropped."""
    if not len(fp):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    node = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])]).astype(np.int64)
    a = b = np.arange(node[-1] + 1)
    spent = np.zeros(len(a), dtype=np.int8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(BITS - 1, -2, -1):
        size = np.bincount(node)
        start = np.cumsum(size) - size
        if label is not None:
            low, high = np.minimum.reduceat(label, start), np.maximum.reduceat(label, start)
            wanted = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
            a, b, spent = a[wanted], b[wanted], spent[wanted]
        single = (size[a] == 1) & (size[b] == 1)
        i, j = start[a[single]], start[b[single]]
        near = (i != j) & (np.bitwise_count(fp[i] ^ fp[j]) <= budget)
        found.append((np.minimum(i, j)[near], np.maximum(i, j)[near]))
        a, b, spent = a[~single], b[~single], spent[~single]
        if not len(a):
            break
        if level < 0:  # several entries of one fingerprint
            n = size[a] * size[b]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = np.repeat(start[a], n) + k // np.repeat(size[b], n), np.repeat(start[b], n) + k % np.repeat(size[b], n)
            fits = np.where(np.repeat(a == b, n), i < j, True)
            if label is not None:
                fits &= label[i] != label[j]
            found.append((np.minimum(i, j)[fits], np.maximum(i, j)[fits]))
            break
        bit = ((fp >> np.uint64(level)) & np.uint64(1)).astype(np.int64)
        key = node * 2 + bit
        new = np.concatenate([[True], key[1:] != key[:-1]])
        child = np.full((len(size), 2), -1, dtype=np.int64)
        below = np.cumsum(new) - 1
        child[node[new], bit[new]] = below[new]
        node, twin = below, a == b
        sides = [(child[a, 0], child[b, 0], spent), (child[a, 1], child[b, 1], spent), (child[a, 0], child[b, 1], spent + 1)]
        sides.append((child[a[~twin], 1], child[b[~twin], 0], spent[~twin] + 1))
        a, b, spent = (np.concatenate(x) for x in zip(*sides, strict=True))
        keep = (a >= 0) & (b >= 0) & (spent <= budget)
        a, b, spent = a[keep], b[keep], spent[keep]
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _linked_groups(groups: DataFrame, budget: int) -> DataFrame:
    """Edges (a, b) from rows that each hold one group's array of fps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            fp = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            # A batch is walked in stretches of a bounded number of fingerprints.
            ends, at = np.cumsum(sizes), 0
            while at < len(sizes):
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + 8192, side="right")))
                group, part = np.repeat(np.arange(at, to), sizes[at:to]), fp[base : ends[to - 1]]
                order = np.lexsort((part, group))
                group, part = group[order], part[order]
                a, b = forest(*trie_pairs(group, part, budget), len(part))
                part = part.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part[a]), pa.array(part[b])], names=["a", "b"])
                at = to

    return groups.select("fps").mapInArrow(lean(run), "a long, b long")


def _segments(free: list[int], parts: int) -> list[list[int]]:
    return [free[len(free) * k // parts : len(free) * (k + 1) // parts] for k in range(parts)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprint_links(fps: DataFrame, budget: int, group_rows: int = 2048) -> DataFrame:
    """From distinct fps: edges (a, b) connecting all within ``budget`` bits."""
    first = _segments(list(range(BITS)), budget + 1)
    second = [_segments([b for b in range(BITS) if b not in s], budget + 1) for s in first]
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_mask(s))) for s in first))).alias("s1", "v1"))

    def split(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        """Groups of two or more up to the bound, and the rows of those above."""
        large = cut_small(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > group_rows))
        small = join_bounded(rows, large.drop("n"), keys, "left_anti").groupBy(*keys).agg(F.collect_list("fp").alias("fps"))
        return small.where(F.size("fps") > 1), join_bounded(rows, large, keys)

    small, large = split(keyed, ["s1", "v1"])
    masks = F.array(*(F.array(*(F.lit(_mask(m)) for m in segs)) for segs in second))
    deeper = large.drop("n").select("fp", "s1", "v1", F.posexplode(F.transform(F.element_at(masks, F.col("s1") + 1), lambda m: F.col("fp").bitwiseAND(m))).alias("s2", "v2"))
    small2, large2 = split(deeper, ["s1", "v1", "s2", "v2"])
    chunks = F.ceil(F.col("n") * 2 / F.lit(group_rows)).cast("int")
    tiles = large2.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = tiles.groupBy("s1", "v1", "s2", "v2", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).agg(F.collect_list("fp").alias("fps"))
    return _linked_groups(small.select("fps").unionByName(small2.select("fps")).unionByName(tiles.select("fps")), budget)


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fp, fingerprint (hex) and component_id, the smallest
    doc_id among the documents its fingerprint reaches."""
    marked = cut(fingerprints(in_small_batches(docs), shingle, id_col, text_col))
    classes = cut_small(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(fingerprint_links(classes.select("fp"), budget))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = cut_small(rooted)
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = cut_small(rooted.join(named, "root").select("fp", "component_id"))
    out = join_bounded(marked, by_fp, "fp")
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of the word shingles of the whole text, A-Z lowered."""
    digest = xxhash.xxh64_intdigest
    parts, tail, words = [], [], []
    for piece in word_pieces((text or "").encode().lower()):
        words = tail + piece
        parts.append(np.array([digest(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(shingle)), strict=False)], dtype=np.uint64))
        tail = words[max(0, len(words) - shingle + 1) :] if shingle > 1 else []
    found = np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)
    return found if len(found) or not words else np.array([digest(b" ".join(words), 42)], dtype=np.uint64)


def set_fingerprint(hashes: np.ndarray) -> int:
    """Majority bits over the distinct shingles of a text."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def min_keys(hashes: np.ndarray, keys: int, minima: int) -> np.ndarray:
    """``keys`` keys of a shingle set, of ``minima`` minima each; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    rnd = np.random.default_rng(42)
    flip, odd, mix = (rnd.integers(0, 1 << 63, keys * minima, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))
    least = np.full(keys * minima, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[at : at + 1024] ^ flip[:, None]) * odd[:, None]).min(axis=1))
    return ((least ^ (least >> np.uint64(29))) * mix).reshape(keys, minima).sum(axis=1, dtype=np.uint64)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Tells rows apart by id and text."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("|"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))


def shingle_sets(rows: DataFrame, shingle: int, keys: int, minima: int) -> DataFrame:
    """From doc_id, row_key and text: doc_id, row_key, set_id, fp, size and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 250):
            sets = [shingle_hashes(t.as_py(), shingle) for t in batch.column(2)]
            ids = np.array([xxhash.xxh64_intdigest(h.tobytes(), 7) for h in sets], dtype=np.uint64).view(np.int64)
            fps = np.array([set_fingerprint(h) for h in sets], dtype=np.uint64).view(np.int64)
            found = [min_keys(h, keys, minima).view(np.int64) for h in sets]
            columns = [batch.column(0), batch.column(1), pa.array(ids), pa.array(fps), pa.array([len(h) for h in sets], pa.int32()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    light = rows.select("doc_id", "row_key", F.col("text").cast("string").alias("text"))
    long = T.LongType()
    schema = T.StructType([light.schema["doc_id"], light.schema["row_key"], T.StructField("set_id", long), T.StructField("fp", long), T.StructField("size", T.IntegerType()), T.StructField("keys", T.ArrayType(long))])
    return light.mapInArrow(lean(run), schema)


def _proposed(groups: DataFrame, budget: int, similarity: float) -> DataFrame:
    """Set pairs (a, b) of two roots and fitting sizes within the budget, from rows
    with one group's ``members``: structs of set_id, fp, size and root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            lists = batch.column(0)
            group = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            ids, fp, size, root = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            fp = fp.view(np.uint64)
            order = np.lexsort((ids, fp, group))
            group, ids, fp, size, root = group[order], ids[order], fp[order], size[order], root[order]
            once = np.concatenate([[True], (group[1:] != group[:-1]) | (ids[1:] != ids[:-1])]) if len(ids) else np.zeros(0, dtype=bool)
            group, ids, fp, size, root = group[once], ids[once], fp[once], size[once], root[once]
            a, b = trie_pairs(group, fp, budget, root)
            fits = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])
            a, b = ids[a[fits]], ids[b[fits]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return groups.select("members").mapInArrow(lean(run), "a long, b long")


def _with_roots(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("set_id"))
    return join_bounded(members, roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))


def _compared_with_one(members: DataFrame, budget: int, similarity: float) -> DataFrame:
    """Pairs of each key's members with one of them, chosen by hash."""
    chosen = members.groupBy("key").agg(F.min_by(F.struct("set_id", "fp", "size", "root"), F.xxhash64("set_id")).alias("c"))
    met = members.join(chosen, "key").where("root <> c.root")
    fits = F.least("size", "c.size") >= F.lit(similarity) * F.greatest("size", "c.size")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("c.fp"))) <= budget
    return met.where(fits & near).select(F.least("set_id", "c.set_id").alias("a"), F.greatest("set_id", "c.set_id").alias("b"))


def common_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``left`` has in common with each of ``right``:
    a product of 0/1 matrices, some columns at a time."""
    owner = np.repeat(np.arange(len(left) + len(right)), [len(h) for h in (*left, *right)])
    _, column, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    shared = count > 1
    column, owner = (np.cumsum(shared) - 1)[column[shared[column]]], owner[shared[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    for low in range(0, int(shared.sum()), 4096):
        at = slice(*np.searchsorted(column, [low, low + 4096]))
        block = np.zeros((len(left) + len(right), 4096), dtype=np.float32)
        block[owner[at], column[at] - low] = 1
        total += block[: len(left)] @ block[len(left) :].T
    return total


def _tile_pairs(tile: pa.Table, budget: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a tile, once per set, and index pairs into them: of two components,
    one of them aside, of fitting sizes, within the budget, and with the tile's key
    as the first key they have in common."""
    ids, fp, size, root = (tile.column(c).to_numpy() for c in ("set_id", "fp", "size", "root"))
    flag = tile.column("aside").to_numpy(zero_copy_only=False)
    order = np.lexsort((~flag, ids, fp.view(np.uint64)))
    order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]  # aside before the same as a member
    size, flag = size[order], flag[order]
    a, b = trie_pairs(np.zeros(len(order), dtype=np.int64), fp[order].view(np.uint64), budget, root[order])
    near = (flag[a] | flag[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]))
    a, b = a[near], b[near]
    keys, own = np.array(tile.column("keys").to_pylist(), dtype=np.int64)[order], tile.column("key")[0].as_py()
    kept = np.zeros(len(a), dtype=bool)
    for low in range(0, len(a), 1 << 16):
        x, y = keys[a[low : low + (1 << 16)]], keys[b[low : low + (1 << 16)]]
        kept[low : low + (1 << 16)] = x[np.arange(len(x)), (x == y).argmax(axis=1)] == own
    return order, a[kept], b[kept]


def _linked_tiles(large: DataFrame, keyed: DataFrame, whole_sets: Callable[[DataFrame], DataFrame], budget: int, similarity: float, tile_rows: int) -> DataFrame:
    """Links of large groups, as edges (a, b): each member outside its key's largest
    component meets every member, in tiles of chunks of the former and of all.

    A tile's pairs come from the trie join without pairs of one component; a pair
    counts under the first key the two have in common.  Only sets of such pairs come
    back with their shingles, and the tile confirms the pairs on them.  What leaves
    it is a spanning forest of the links.

    large: key, set_id, fp, size, root; keyed: set_id and all its keys."""
    largest = large.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", "n").alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most"))
    chunks = largest.select("key", "largest", F.ceil(F.col("n") / tile_rows).cast("int").alias("all_chunks"), F.ceil((F.col("n") - F.col("most")) / tile_rows).cast("int").alias("chunks"))
    met = large.join(chunks, "key").join(keyed, "set_id")
    own = lambda n: F.pmod(F.xxhash64("set_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = ["key", "set_id", "fp", "size", "root", "keys"]
    aside = met.where("root <> largest").select(*fields, F.lit(True).alias("aside"), own("chunks").alias("i"), every("all_chunks").alias("j"))
    whole = met.select(*fields, F.lit(False).alias("aside"), every("chunks").alias("i"), own("all_chunks").alias("j"))
    tiles = aside.unionByName(whole)

    def involved(tile: pa.Table) -> pa.Table:
        order, a, b = _tile_pairs(tile, budget, similarity)
        return tile.take(pa.array(order[np.unique(np.concatenate([a, b]))]))

    def linked(tile: pa.Table) -> pa.Table:
        order, a, b = _tile_pairs(tile, budget, similarity)
        ids, size = tile.column("set_id").to_numpy()[order], tile.column("size").to_numpy()[order]
        hashes = tile.column("hashes").combine_chunks()
        found = [hashes[int(k)].values.to_numpy() for k in order]
        links = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        for low in range(0, len(found), 512):
            some = (a >= low) & (a < low + 512)
            if some.any():
                x, y = a[some], b[some]
                common = common_shingles(found[low : low + 512], found)[x - low, y]
                near = common >= similarity * (size[x] + size[y] - common)
                links.append((x[near], y[near]))
        i, j = (np.concatenate(x) for x in zip(*links, strict=True))
        node, to = forest(i, j, len(ids))
        return pa.table({"a": ids[node], "b": ids[to]})

    wanted = cut_small(tiles.groupBy("key", "i", "j").applyInArrow(lean(involved), tiles.schema))
    full = wanted.join(whole_sets(wanted.select("set_id").distinct()), "set_id")
    return full.groupBy("key", "i", "j").applyInArrow(lean(linked), "a long, b long")


def _whole_sets(wanted: DataFrame, rows: DataFrame, stands: DataFrame, shingle: int) -> DataFrame:
    """set_id and hashes of the wanted sets; one row's text stands for each."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 250):
            hashes = [shingle_hashes(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.list_(pa.int64()))], names=["set_id", "hashes"])

    one = cut_small(stands.join(wanted, "set_id").select("set_id", "row_key"))
    found = join_bounded(rows.select("row_key", F.col("text").cast("string").alias("text")).where(F.octet_length("text") > 0), one, "row_key")
    sets = found.select("set_id", "text").mapInArrow(lean(texts), "set_id long, hashes array<long>")
    return cut_small(sets.groupBy("set_id").agg(F.first("hashes").alias("hashes")))


def _confirmed(pairs: DataFrame, rows: DataFrame, stands: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of set pairs (a, b), those whose whole shingle sets have the similarity."""
    wanted = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    sets = _whole_sets(wanted, rows, stands, shingle)
    left, right = (sets.select(F.col("set_id").alias(n), F.col("hashes").alias(f"h_{n}")) for n in "ab")
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("h_a", "h_b"))
    return both.where(common / (F.size("h_a") + F.size("h_b") - common) >= similarity).select("a", "b")


def similar_texts(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, budget: int = 26, keys: int = 24, minima: int = 4, group_rows: int = 64, tile_rows: int = 256,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, row_key and root, equal for the rows of a component of
    texts linked by a Jaccard similarity of their shingle sets."""
    rows = in_small_batches(docs).select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    marked = cut(shingle_sets(rows, shingle, keys, minima))
    stands = marked.groupBy("set_id").agg(F.min("row_key").alias("row_key"))
    # Copies meet as one set.
    sets = marked.select("set_id", "fp", "size", "keys").distinct().select("set_id", "fp", "size", F.explode("keys").alias("key"))
    shared = cut_small(sets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = cut_small(join_bounded(sets, shared, "key"))
    large = met.where(F.col("n") > group_rows).drop("n")
    member = F.struct("set_id", "fp", "size", F.col("set_id").alias("root"))
    groups = met.where(F.col("n") <= group_rows).groupBy("key").agg(F.collect_list(member).alias("members"))
    pairs = _proposed(groups, budget, similarity).unionByName(_compared_with_one(_with_roots(large, None), budget, similarity)).distinct()
    pairs = cut_small(pairs)
    roots = None
    if not pairs.isEmpty():
        roots = components(_confirmed(pairs, rows, stands, shingle, similarity)).withColumnRenamed("node", "set_id")
    rooted = _with_roots(large, roots)
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    left = cut_small(rooted.join(apart, "key", "left_semi"))
    if not left.isEmpty():
        keyed = marked.select("set_id", "keys").join(left.select("set_id").distinct(), "set_id", "left_semi").distinct()
        links = _linked_tiles(left, keyed, lambda wanted: _whole_sets(wanted, rows, stands, shingle), budget, similarity, tile_rows)
        old = [] if roots is None else [roots.select(F.col("set_id").alias("a"), F.col("root").alias("b"))]
        roots = components(reduce(DataFrame.unionByName, old, links)).withColumnRenamed("node", "set_id")
    out = marked.select("doc_id", "row_key", "set_id")
    return _with_roots(out, roots).select("doc_id", "row_key", "root")
