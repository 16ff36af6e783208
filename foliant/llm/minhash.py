"""Near duplicates by min-max hashing.

A document is the set of its distinct shingles. Under each of HASHES permutations both the smallest and the
largest value of the set are kept: either agrees between two sets with the probability of their Jaccard
similarity, so one evaluation gives two signature values, and bands of ROWS values are formed of both kinds.

Documents with one set are one node. Nodes that share a band are candidates; their closure under sharing
are clusters, found from star edges, one per node and band. Inside a cluster links are confirmed on full sets:
nodes are dealt into slices of about SLICE, each slice compared within itself and with the cluster's hub, the
node that meets most others; then only what isn't linked to the hub yet is compared with the other slices. A slice
is compared by a product of its 0/1 incidence matrix, and returns a forest: an edge or two for each node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, pieces
from .graph import components

HASHES, ROWS = 40, 4  # 20 bands: a pair at 0.85 shares none with probability (1 - 0.85 ** 4) ** 20, under 10 ** -6
SLICE, SLICE_SHINGLES = 512, 1 << 22  # nodes and shingles of a slice, about
_SEED = 20_240_607
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class Shingler:
    """Hashes of distinct shingles of `width` words; words are remembered by a worker up to a bound."""

    def __init__(self, width: int = 3, known: int = 150_000):
        self.width, self.most, self.known = width, known, {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes; of a text with fewer words than the width, one of all its words."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z alone
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.most:
            self.known.clear()
        known, hashes = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = _word_hash(w)
            hashes.append(h)
        h = np.array(hashes, np.uint64)
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, np.uint64(width * int(_MIX) & 0xFFFFFFFFFFFFFFFF))
        for k in range(width):
            out = (out ^ h[k : len(h) - width + 1 + k]) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def coefficients(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, hashes, np.uint64)


def signatures(shingles: np.ndarray, starts: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """2 * hashes values for each set: minima, then maxima. starts: where each (non-empty) set begins."""
    a, b = coefficients(hashes)
    out = np.empty((len(starts), 2 * hashes), np.uint32)
    for k in range(hashes):
        v = ((shingles * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(v, starts)
        out[:, hashes + k] = np.maximum.reduceat(v, starts)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of `rows` values; minima and maxima alternate within a band."""
    hashes = signature.shape[1] // 2
    order = np.arange(2 * hashes).reshape(2, hashes).T.ravel()
    part = signature[:, order].reshape(len(signature), -1, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(part.shape[1], dtype=np.uint64) * _MIX, part.shape[:2]).copy()
    for k in range(rows):
        key = (key ^ part[:, :, k]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    return key


def links_within(sets: list[np.ndarray], left: np.ndarray, percent: int) -> np.ndarray:
    """A boolean matrix, left x sets: 100 * |A and B| >= percent * |A or B|.

    Shingles in one set only can't be shared; the rest are columns, taken a thousand at a time.
    """
    sizes = np.array([len(s) for s in sets], np.int32)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    shared = count[column] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    columns = int(column[-1]) + 1 if len(column) else 0
    wide = min(1024, max(columns, 1))
    cuts = np.searchsorted(column, np.arange(0, columns + wide, wide))
    common = np.zeros((len(left), len(sets)), np.float32)
    for c, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        grid = np.zeros((len(sets), wide), np.float32)
        grid[row[a:b], column[a:b] - c * wide] = 1
        common += grid[left] @ grid.T
    inter = np.rint(common).astype(np.int32)
    return 100 * inter.astype(np.int64) >= percent * (sizes[left][:, None] + sizes - inter).astype(np.int64)


def forest(sets: list[np.ndarray], left: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that connect what the links of `left` with all sets connect, one less than nodes at most."""
    linked = links_within(sets, left, percent)
    place = np.full(len(sets), -1)
    place[left] = np.arange(len(left))
    fresh, out = np.ones(len(sets), bool), []
    for start in left.tolist():
        if not fresh[start]:
            continue
        fresh[start], reached = False, [start]
        while reached:
            x = reached.pop()
            near = np.zeros(len(sets), bool)
            near[left] = linked[:, x]
            if place[x] >= 0:
                near |= linked[place[x]]
            found = np.flatnonzero(near & fresh)
            fresh[found] = False
            reached += found.tolist()
            out += [(x, y) for y in found.tolist()]
    return out


def _compare(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Columns: node, shingles, role: 0 in the slice, 1 the hub or one to be compared with the slice."""
        names, roles = group.column("node").to_pylist(), np.array(group.column("role").to_pylist())
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        every, guests = np.arange(len(sets)), np.flatnonzero(roles == 1)
        edges = forest(sets, every if group.column("inner")[0].as_py() else guests, percent)
        return pa.table({"a": pa.array([names[i] for i, _ in edges], pa.binary()), "b": pa.array([names[j] for _, j in edges], pa.binary())})

    return run


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, hashes: int = HASHES, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row.

    Documents link at a similarity of `percent` or more of their sets of `width`-word shingles. component_id is
    the smallest doc_id that a document reaches. A text that is null or has no words has an empty set and links
    with nothing; so does a row with a null id, whose component is null and which is kept. Rows alike are linked;
    rows of one id with unlike texts are nodes of their own. An empty table gives no rows.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for first, found in pieces(batch, "text", 1 << 20):
                sets = [shingler.shingles(t) for t in found]
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                keys: list = [None] * len(sets)
                if len(full):
                    starts = np.cumsum(sizes[full]) - sizes[full]
                    for i, key in zip(full.tolist(), band_keys(signatures(np.concatenate([sets[i] for i in full]), starts, hashes), rows), strict=True):
                        keys[i] = key.tobytes()
                nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(found)), pa.array(sizes), pa.array(nodes, pa.binary()), pa.array(keys, pa.binary())], ["doc_id", "n_shingles", "node", "bands"])

    signed = cut(texts.mapInArrow(sign, "doc_id long, n_shingles long, node binary, bands binary"))
    n_bands = 2 * hashes // rows
    # rows without an id link with nothing: a node of such rows only is in no cluster, and is nobody's hub
    nodes = signed.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"), F.first("n_shingles").alias("size"))
    band = F.expr(f"explode(transform(sequence(0, {n_bands - 1}), i -> substring(bands, 8 * i + 1, 8)))")
    banded = nodes.select("node", "size", band.alias("key"))
    # a bucket's smallest node stands for it; counting and taking the least are done before the shuffle
    buckets = banded.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = cut(banded.join(buckets, "key").select("node", "first", "n", "size"))
    clusters = components(met.select(F.col("node").alias("a"), F.col("first").alias("b")))
    weight = met.groupBy("node").agg(F.sum("n").alias("met"), F.first("size").alias("size"))
    clusters = cut(clusters.join(weight, "node"))

    per = clusters.groupBy("root").agg(F.count("*").alias("members"), F.sum("size").alias("shingled"), F.max_by("node", F.struct("met", "node")).alias("hub"))
    per = per.withColumn("slices", F.greatest(F.ceil(F.col("members") / SLICE), F.ceil(F.col("shingled") / SLICE_SHINGLES))).drop("shingled", "met", "size")
    members = clusters.select("node", "root").join(per, "root").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")))
    # one text of each node that is in a cluster, as its set
    one = signed.join(members.select("node"), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    shingled = _sets(texts, one, width)
    members = cut(members.join(shingled, "node").select("root", "slice", "slices", "node", "shingles", (F.col("node") == F.col("hub")).alias("is_hub")))
    every_slice = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    hubs = members.where("is_hub AND slices > 1").withColumn("home", F.col("slice")).withColumn("slice", every_slice).where("slice <> home")
    inner = members.select("root", "slice", "node", "shingles", F.lit(0).alias("role")).unionByName(hubs.select("root", "slice", "node", "shingles", F.lit(1).alias("role")))
    links = cut(_grouped(inner, True, percent))
    large = members.where("slices > 1")
    if not large.isEmpty():
        # what is connected with its hub by now needs no comparison among itself
        joined = components(links)
        placed = large.join(joined.select("node", F.col("root").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))
        hub_part = placed.where("is_hub").select("root", F.col("part").alias("hub_part"))
        placed = placed.join(hub_part, "root")
        loose = placed.where("part <> hub_part")
        block = loose.groupBy("root").agg(F.ceil(F.count("*") / (SLICE // 2)).cast("long").alias("blocks"))
        guests = loose.join(block, "root").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")))
        guests = guests.withColumn("home", F.col("slice")).withColumn("slice", every_slice)
        hosts = placed.join(block, "root").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        both = hosts.select("root", "slice", "block", "node", "shingles", F.lit(0).alias("role")).unionByName(guests.where("slice <> home").select("root", "slice", "block", "node", "shingles", F.lit(1).alias("role")))
        links = cut(links.unionByName(_grouped(both, False, percent)))
    parts = components(links)
    lowest = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    lowest = lowest.join(parts, "node", "left").withColumn("part", F.coalesce("root", "node"))
    of_part = lowest.groupBy("part").agg(F.min("least").alias("component_id"))
    of_node = lowest.join(of_part, "part").select("node", "component_id")
    out = signed.join(of_node, "node", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _sets(texts: DataFrame, one: DataFrame, width: int) -> DataFrame:
    """node, shingles: the set of one document of each node. Only texts in clusters travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for _, found in pieces(batch, "text", 1 << 20):
                sets = [shingler.shingles(t).tobytes() for t in found]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["node", "shingles"])

    chosen = texts.join(one.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    sets = chosen.mapInArrow(run, "node binary, shingles binary")
    return sets.join(one.select("node"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _grouped(rows: DataFrame, inner: bool, percent: int) -> DataFrame:
    keys = ["root", "slice"] if inner else ["root", "slice", "block"]
    return rows.withColumn("inner", F.lit(inner)).groupBy(*keys).applyInArrow(_compare(percent), "a binary, b binary")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, hashes: int = 60, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, less those that are near a document with a smaller id.

    Rows that share an id stay or go together; rows without an id, and rows without words, stay. An empty table
    gives no rows; columns may have any names.
    """
    name = free_name(docs.columns, "_gone")
    gone = near_duplicates(docs, width, percent, hashes, id_col=id_col).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone[name], "left_anti")
