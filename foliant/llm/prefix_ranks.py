"""Removal of long byte strings that an earlier document has, by distributed prefix doubling.

Every byte position starts with the rank of its first eight bytes, which is their value. In each round Spark
joins a position with the one a growing offset behind it, sorts the pairs of their ranks, gives each
distinct pair its place in the order as new rank, and drops the positions whose pair no two documents share.
Offsets double until the strings have the threshold's length, the last offset being what is left to it.

This is exact, with no hash, but each position travels as a row in each round: see the README for what that takes.
`suffix_dedup` gives the same results with packed fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .suffix_dedup import CHUNK, LENGTH

WIDE, AT_ONCE = 8, 1 << 16  # bytes of the first rank, positions of a batch


def first_ranks(text: bytes) -> np.ndarray:
    """The value of the eight bytes from each position on."""
    raw = np.frombuffer(text, np.uint8)
    n = max(len(raw) - WIDE + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(WIDE):
        out = out << np.uint64(8) | raw[k : k + n]
    return out.view(np.int64)


def shared_positions(texts: DataFrame, length: int) -> DataFrame:
    """t, p of the positions whose `length` bytes a document with a smaller id has too; texts: t, doc_id, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, doc, body in zip(*(batch.column(c) for c in ("t", "doc_id", "body")), strict=True):
                ranks = first_ranks(body.as_py())
                for a in range(0, len(ranks), AT_ONCE):
                    some = ranks[a : a + AT_ONCE]
                    yield pa.RecordBatch.from_arrays([pa.repeat(t, len(some)), pa.repeat(doc, len(some)), pa.array(np.arange(a, a + len(some))), pa.array(some)], ["t", "doc", "p", "rank"])

    rows = texts.where(F.col("doc_id").isNotNull() & (F.octet_length("body") >= length)).mapInArrow(run, "t long, doc long, p long, rank long")
    reach = WIDE
    while reach < length:
        offset = min(reach, length - reach)
        behind = Window.partitionBy("t").orderBy("p").rangeBetween(offset, offset)
        pairs = rows.select("t", "doc", "p", "rank", F.first("rank").over(behind).alias("next")).where("next IS NOT NULL")
        shared = pairs.groupBy("rank", "next").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
        ranked = cut(shared.select("rank", "next", "least").orderBy("rank", "next").withColumn("place", F.monotonically_increasing_id()))
        rows = cut(pairs.join(ranked, ["rank", "next"]).select("t", "doc", "p", F.col("place").alias("rank"), "least"))
        reach += offset
    return rows.where("least < doc").select("t", "p")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, as suffix_dedup.remove_repeats() gives them.

    A null text is empty. A row without an id loses nothing and takes nothing from others; rows that share an id
    take nothing from each other. An empty table gives no rows; further columns are not read; length is over 8.
    """
    body = F.encode(F.coalesce(docs[text_col].cast("string"), F.lit("")), "UTF-8")
    identity = docs[id_col].cast("long")
    texts = docs.select(F.xxhash64(identity, body).alias("t"), identity.alias("doc_id"), body.alias("body"))
    total = docs.select(F.sum(F.octet_length(body).cast("long"))).first()[0] or 0
    part = F.pmod("t", F.lit(max(1, -(-total // CHUNK)))).alias("part")

    def strike(group: pa.Table, found: pa.Table) -> pa.Table:
        at = {}
        if found.num_rows:
            t, p = found.column("t").to_numpy(), found.column("p").to_numpy()
            order = np.lexsort((p, t))
            t, p = t[order], p[order]
            cuts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            at = {int(t[a]): p[a:b] for a, b in zip(cuts, np.append(cuts[1:], len(t)), strict=True)}
        out: list = [[], [], [], [], []]
        for k, doc, text in zip(*(group.column(c).to_pylist() for c in ("t", "doc_id", "body")), strict=True):
            change = np.zeros(len(text) + 1, np.int64)
            starts = np.unique(at.get(k, np.zeros(0, np.int64)))
            change[starts] += 1
            change[starts + length] -= 1
            gone = np.cumsum(change[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
            for column, x in zip(out, (doc, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(x)
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), out, [pa.int64()] * 4 + [pa.string()], strict=True)})

    both = texts.select("*", part).groupBy("part").cogroup(shared_positions(texts, length).select("t", "p", part).groupBy("part"))
    return both.applyInArrow(strike, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
