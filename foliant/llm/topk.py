"""Exact top-k inner products by norm-bucketed retrieval (LEMP: Teflioudi et al., 2015).

Vectors are grouped by length: a class is an eighth of a doubling, and large classes are dealt into slabs of
about SLAB vectors. Slabs from the longest on are put together to rings of about RING_BYTES, so that a ring holds
vectors of neighbouring lengths. Every query first meets the slabs of the longest vectors of its dimension (the seeds, which together have SLAB
vectors or one slab more), whose k-th best product t is a lower bound. A vector shorter than t / |q| can't come near, so queries are dealt into blocks
by that need, and a block is sent only to the rings that have vectors of its least need; the others are never
shuffled to it. For a query q whose k-th best is t, a slab of greatest length m can only add vectors whose cosine
with q is at least t / (|q| m), the local threshold:

* over 1: the slab is passed over;
* high: by coordinates. With unit vectors at cosine c or more, a coordinate p_f is within
  q_f c +- sqrt((1 - q_f ** 2)(1 - c ** 2)); the largest coordinates of q give the narrowest ranges;
* low: by length. Vectors are sorted by length, and those of at least t / |q| remain.

What remains is verified by whole products. All bounds are loosened by far more than rounding errs, and
products are exact: in floating point where all sums stay under 2 ** 53, else in 64-bit integers. Vectors travel in the
narrowest integers that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SLAB, BLOCK = 4096, 8192  # vectors of a slab and queries of a block, at most
SLAB_BYTES, BLOCK_BYTES, RING_BYTES = 4 << 20, 8 << 20, 16 << 20  # of 64-bit components: of a slab and of a block, at most; of a ring, about
COORDINATES, HIGH = 3, 0.5  # coordinates looked at, and the local threshold from which they are
_LOOSE = 1e-9
LOWEST = -(1 << 20)  # under every class


def packed(vectors: np.ndarray) -> bytes:
    """Integers in the narrowest type that holds them all, whose width in bytes comes first."""
    most = int(np.abs(vectors).max(initial=0)) if vectors.size else 0
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + vectors.astype(kind).tobytes()


def unpacked(ids: bytes, body: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(body, np.dtype(f"i{body[0]}"), len(ids) * dim, 1).reshape(len(ids), dim).astype(np.int64)


class Slab:
    """ids and integer vectors, longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        floats = vectors.astype(np.float64)
        length = np.sqrt((floats * floats).sum(1))
        order = np.lexsort((ids, -length))
        self.ids, self.vectors, self.floats, self.length = ids[order], vectors[order], floats[order], length[order]
        self.most = float(np.abs(floats).max()) if floats.size else 0.0
        self._unit: np.ndarray | None = None

    @classmethod
    def read(cls, ids: bytes, body: bytes, dim: int) -> Slab:
        return cls(*unpacked(ids, body, dim))

    @property
    def columns(self) -> np.ndarray:
        """Unit vectors by coordinate."""
        if self._unit is None:
            self._unit = np.ascontiguousarray((self.floats / np.where(self.length > 0, self.length, 1)[:, None]).T)
        return self._unit

    def products(self, rows: np.ndarray | slice, query: np.ndarray) -> np.ndarray:
        if self.most * float(np.abs(query).max(initial=0)) * max(len(query), 1) < 2.0**53:
            return (self.floats[rows] @ query.astype(np.float64)).astype(np.int64)
        return (self.vectors[rows] * query).sum(1)

    def candidates(self, unit: np.ndarray, size: float, least: float) -> np.ndarray | slice:
        """Rows that may have a product of `least` or more with a query of that direction and length."""
        if not len(self.ids) or least <= 0 or size == 0:
            return slice(0, len(self.ids))
        local = least / (size * self.length[0]) - _LOOSE if self.length[0] > 0 else 2.0
        if local > 1:
            return slice(0, 0)
        if local < HIGH:
            return slice(0, int(np.searchsorted(-self.length, -(least / size) * (1 - _LOOSE), "right")))
        keep = np.ones(len(self.ids), bool)
        for f in np.argsort(-np.abs(unit))[:COORDINATES]:
            q = float(unit[f])
            half = np.sqrt(max(0.0, 1 - q * q) * (1 - local * local)) + _LOOSE
            keep &= (self.columns[f] >= q * local - half) if q >= 0 else (self.columns[f] <= q * local + half)
            if abs(q) > local:  # else the range's other end is where the cosine still grows
                continue
            keep &= (self.columns[f] <= q * local + half) if q >= 0 else (self.columns[f] >= q * local - half)
        return np.flatnonzero(keep)


def kth_best(seed: Slab, own: int, query: np.ndarray, k: int) -> int:
    """The k-th highest product of a query with the seed's other vectors; the least long if there are fewer."""
    s = seed.products(slice(None), query)[seed.ids != own]
    return int(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else -(1 << 63)


def search(ids: np.ndarray, queries: np.ndarray, least: list[int], slabs: list[Slab], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, vector ids, scores) of each query's k best in the slabs, of those that have its `least` or more."""
    slabs = sorted(slabs, key=lambda s: -(s.length[0] if len(s.length) else 0))
    for own, query, bound in zip(ids.tolist(), queries, least, strict=True):
        size = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        unit = query / size if size else query.astype(np.float64)
        best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for slab in slabs:
            rows = slab.candidates(unit, size, bound)
            s, n = slab.products(rows, query), slab.ids[rows]
            good = (s >= bound) & (n != own)
            best, best_id = np.concatenate([best, s[good]]), np.concatenate([best_id, n[good]])
            if len(best) > k:
                order = np.lexsort((best_id, -best))[:k]
                best, best_id = best[order], best_id[order]
                bound = max(bound, int(best[-1]))
        if len(best):
            yield own, best_id, best


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k highest inner products of floor(scale * x) vectors.

    Queries are the rows whose id is divisible by `every`, candidates all rows with another id; ties go to the
    smaller id. Vectors that are null or hold null or non-finite components, and rows without an id, take no
    part; vectors of unlike dimensions are not compared; repeated rows are candidates each. Products must fit a
    long. An empty table gives no rows; further columns are not read.
    """
    v = F.col(vector_col)
    finite = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.select("vec_id", "v", F.size("v").alias("dim"), F.when(square > 0, F.floor(4 * F.log2(square))).otherwise(-1).cast("int").alias("class"))

    def grouped(df: DataFrame, keys: list[str], more: list[str] | None = None) -> DataFrame:
        """One row of packed vectors for each value of the keys."""
        more = more or []

        def run(group: pa.Table) -> pa.Table:
            flat = group.column("v").combine_chunks()
            flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
            ids = np.array(group.column("vec_id").to_pylist(), np.int64)
            cols = {c: pa.array([group.column(c)[0].as_py()], group.schema.field(c).type) for c in keys}
            cols |= {"n": pa.array([len(ids)], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "body": pa.array([packed(np.asarray(flat.to_numpy(zero_copy_only=False), np.int64))], pa.binary())}
            return pa.table(cols | {c: pa.array([group.column(c).to_numpy().tobytes()], pa.binary()) for c in more})

        ddl = ", ".join(f"{c} {t}" for c, t in df.dtypes if c in keys)
        order = [c for c, _ in df.dtypes if c in keys]
        assert order == keys
        return df.select(*keys, "vec_id", "v", *more).groupBy(*keys).applyInArrow(run, f"{ddl}, n long, ids binary, body binary" + "".join(f", {c} binary" for c in more))

    def dealt(df: DataFrame, by: list[str], most: int, most_bytes: int, salt: int) -> DataFrame:
        """Columns `deal`, below `parts`, so that the rows of (by, deal) are about `most`, or as many as have the bytes."""
        room = F.greatest(F.least(F.lit(most), F.floor(most_bytes / (8 * F.greatest(F.col("dim"), F.lit(1))))), F.lit(1))
        count = df.groupBy(*by).agg(F.ceil(F.count("*") / F.first(room)).alias("parts"))
        return df.join(count, by).withColumn("deal", F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.col("parts")))

    of_class = rows.groupBy("dim", "class").agg(F.count("*").alias("_n"))
    longer = Window.partitionBy("dim").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    of_class = of_class.select("dim", "class", F.coalesce(F.sum("_n").over(longer), F.lit(0)).alias("before"))  # a row for each class: few
    slabs = grouped(dealt(rows, ["dim", "class"], SLAB, SLAB_BYTES, 1).select("dim", "class", "deal", "vec_id", "v"), ["dim", "class", "deal"])
    slabs = slabs.join(F.broadcast(of_class), ["dim", "class"])
    row_bytes = 8 * F.greatest(F.col("dim"), F.lit(1))
    slab_rows = F.greatest(F.least(F.lit(SLAB), F.floor(SLAB_BYTES / row_bytes)), F.lit(1))
    slabs = cut(slabs.withColumn("before", F.col("before") + F.col("deal") * slab_rows).withColumn("ring", F.floor(F.col("before") * row_bytes / RING_BYTES)))

    # each block of queries meets the slabs of the longest vectors of its dimension
    asked = dealt(rows.where(F.col("vec_id") % every == 0).select("dim", "vec_id", "v"), ["dim"], BLOCK, BLOCK_BYTES, 2)
    first = grouped(asked.select("dim", "deal", "vec_id", "v"), ["dim", "deal"])
    parts = asked.groupBy("dim").agg(F.max("parts").alias("parts"))
    seed = slabs.where(F.col("before") < slab_rows).join(parts, "dim")
    seed = seed.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("deal"), "ids", "body")

    def bounds(queries: pa.Table, longest: pa.Table) -> pa.Table:
        out: list = [[], [], [], [], []]
        if queries.num_rows:
            dim = queries.column("dim")[0].as_py()
            found = [unpacked(i, b, dim) for i, b in zip(longest.column("ids").to_pylist(), longest.column("body").to_pylist(), strict=True)]
            slab = Slab(np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]))
            for ids, body in zip(queries.column("ids").to_pylist(), queries.column("body").to_pylist(), strict=True):
                for own, q in zip(*unpacked(ids, body, dim), strict=True):
                    least, square = kth_best(slab, int(own), q, k), float((q.astype(np.float64) ** 2).sum())
                    # the class of the shortest vector that may matter, one lower for safety; all, if the bound tells nothing
                    need = int(np.floor(4 * np.log2(least * float(least) / square))) - 1 if least > 0 and square else LOWEST
                    for column, x in zip(out, (dim, need, own, q, least), strict=True):
                        column.append(x)
        return pa.table({"dim": pa.array(out[0], pa.int32()), "need": pa.array(out[1], pa.int32()), "vec_id": pa.array(out[2], pa.int64()), "v": pa.array(out[3], pa.list_(pa.int64())), "least": pa.array(out[4], pa.int64())})

    bounded = cut(first.groupBy("dim", "deal").cogroup(seed.groupBy("dim", "deal")).applyInArrow(bounds, "dim int, need int, vec_id long, v array<long>, least long"))
    blocks = dealt(bounded, ["dim", "need"], BLOCK, BLOCK_BYTES, 3)
    needs = blocks.groupBy("dim", "need").agg(F.max("parts").alias("parts"))
    # the last ring that a need reaches; needs, like classes, are eighths of doublings: few rows, whatever the vectors
    reach = slabs.groupBy("dim", "class").agg(F.max("ring").alias("ring")).withColumnRenamed("dim", "d").join(F.broadcast(needs), (F.col("d") == F.col("dim")) & (F.col("class") >= F.col("need")))
    reach = cut(reach.groupBy("dim", "need", "parts").agg(F.max("ring").alias("last")))
    packed_blocks = grouped(blocks.select("dim", "need", "deal", "vec_id", "v", "least"), ["dim", "need", "deal"], ["least"])
    keys = ["dim", "ring", "need", "part"]
    left = packed_blocks.join(F.broadcast(reach.select("dim", "need", "last")), ["dim", "need"])
    left = left.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("ring"), "need", F.col("deal").alias("part"), "ids", "body", "least")
    right = slabs_sent(slabs, reach)

    def meet(queries: pa.Table, others: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if queries.num_rows and others.num_rows:
            dim = queries.column("dim")[0].as_py()
            here = [Slab.read(i, b, dim) for i, b in zip(others.column("ids").to_pylist(), others.column("body").to_pylist(), strict=True)]
            for ids, body, least in zip(*(queries.column(c).to_pylist() for c in ("ids", "body", "least")), strict=True):
                for q, n, s in search(*unpacked(ids, body, dim), np.frombuffer(least, np.int64).tolist(), here, k):
                    for column, x in zip(out, (np.full(len(n), q), n, s), strict=True):
                        column.append(x)
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def slabs_sent(slabs: DataFrame, reach: DataFrame) -> DataFrame:
    """Each slab once for each block of queries whose need reaches its ring; reach: dim, need, parts (blocks), last (ring)."""
    met = slabs.join(F.broadcast(reach.withColumnRenamed("dim", "d")), (F.col("d") == F.col("dim")) & (F.col("ring") <= F.col("last")))
    return met.select("dim", "ring", "need", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "ids", "body")
