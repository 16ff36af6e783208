"""Mixing sources to target weights by pivotal dependent rounding.

A source of target t and size s is to be taken t / s times over, so each of its documents gets the whole
part of that as copies and the rest as a probability of one more. Pivotal rounding settles these in words: of two
documents of a and b words with open probabilities p and q, either p rises by x and q falls by x a / b, or p falls by y
and q rises by y a / b, as far as both stay probabilities; the first with probability y / (x + y). Both expectations
and the words of the two together stay what they are, and at least one is settled. What stays open is one residual.

The rounding is a reduction tree of fan-in FAN: leaves hold about FAN documents of one source, their residuals
meet FAN by FAN, and so on to one residual of each source, which is rounded to the nearer side. Its words are all
that a source can miss its target by; documents are settled from the largest down, and the largest against all the
others at once, so that it is a small one, unless the others together are too small for that.

Rows alike in id, source and size are one unit with a count, so that no number of repeated rows meets in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name

WEIGHTS = (5, 2, 1)
FAN = 4096  # documents of a leaf, and residuals that meet
MOST = 3.0  # times a source's size, and copies of a document
LARGEST = 64  # documents of a group that are settled against all others
CELLS = 512  # of a source, which bring its rows its totals
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Number of runs other than of the six ASCII white-space characters; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS) -> DataFrame:
    """_s, source_size, target for each source key of (_s, source, size): weights by code-point order, null last."""
    per = sized.groupBy("_s").agg(F.first("source").alias("_source"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("_source").isNull(), F.encode("_source", "UTF-8"))
    k = F.row_number().over(order) - 1
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k % len(weights) + 1).cast("int")))
    # a source is at its cap if, with all that fill up sooner at theirs, its share would be over its own
    cap, fills = MOST * F.col("source_size"), Window.orderBy("_fill", "_s")
    per = per.withColumn("_cap", cap).withColumn("_fill", cap / F.col("_w"))
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumn("_all", F.sum("source_size").over(everything).cast("double")).withColumn("_weight", F.sum("_w").over(everything))
    left = F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.col("_weight") - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    per = per.withColumn("_full", F.col("_fill") * weight <= left)
    open_left = F.first("_all").over(everything) - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(everything)
    share = open_left * F.col("_w") / F.when(open_weight > 0, open_weight)
    per = per.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(share, F.col("_cap"))))
    return per.select("_s", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))


def pivot(size: np.ndarray, open_: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one more or not, open probability) of each document, in the order given; at most one stays open."""
    a, p, extra = size.tolist(), open_.tolist(), [0] * len(size)
    last = -1
    for i, u in enumerate(draws.tolist()):
        if p[i] <= 1e-9 or p[i] >= 1 - 1e-9:
            extra[i], p[i] = int(p[i] > 0.5), 0.0
            continue
        if last >= 0:
            ratio = a[last] / a[i]  # what `last` gives, `i` takes so many times
            up, down = min(1 - p[last], p[i] / ratio), min(p[last], (1 - p[i]) / ratio)
            move = up if u * (up + down) < down else -down
            p[last] += move
            p[i] -= move * ratio
            for k in (last, i):
                if p[k] <= 1e-9 or p[k] >= 1 - 1e-9:
                    extra[k], p[k] = int(p[k] > 0.5), 0.0
            if p[last] > 0:
                continue
        last = i if p[i] > 0 else -1
    return np.array(extra, np.int64), np.array(p)


def against_the_rest(size: np.ndarray, open_: np.ndarray, extra: np.ndarray, draws: np.ndarray) -> None:
    """Settles the largest documents, each against all smaller ones at once where these can bear it: with its own
    probability it is taken, else left, and what that takes or leaves in words moves the others by p (1 - p) each.
    Else a large document, which pairs move little, could stay open to the end."""
    for i, u in enumerate(draws.tolist()):
        a, p, q = float(size[i]), float(open_[i]), open_[i + 1 :]
        share = q * (1 - q)
        bear = float(share @ size[i + 1 :])
        if not 1e-9 < p < 1 - 1e-9 or bear <= 0 or (1 - p) * a * float((1 - q[share > 0]).max()) > bear or p * a * float(q[share > 0].max()) > bear:
            continue
        extra[i], open_[i] = int(u < p), 0.0
        q += (p - extra[i]) * a / bear * share


def _settle(seed: int, level: int):
    def run(group: pa.Table) -> pa.Table:
        """One group of the tree, largest documents first; a source without words has nothing open."""
        order = group.sort_by([("size", "descending"), ("_tie", "ascending")])
        where = [seed, level, int(order.column("_lot")[0].as_py()) & 0xFFFFFFFF, order.num_rows]
        rng, size, left = np.random.default_rng(where), order.column("size").to_numpy().astype(float), order.column("_open").to_numpy().copy()
        done = order.column("_extra").to_numpy().copy()
        against_the_rest(size, left, done_now := np.zeros(len(size), np.int64), rng.random(min(LARGEST, len(size) - 1)))
        more, left = pivot(size, left, rng.random(len(size)))
        done += more + done_now
        return order.set_column(order.column_names.index("_open"), "_open", pa.array(left)).set_column(order.column_names.index("_extra"), "_extra", pa.array(done))

    return run


def settled(units: DataFrame, seed: int = 11, weights=WEIGHTS) -> DataFrame:
    """The columns of units (doc_id, source, size, rows), source_size, target, and how the copies fall: each of the
    `rows` documents alike has _whole, and _extra of them one more. The draws follow from seed, ids and sizes."""
    rows = units.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    rows = cut(rows)  # the texts are read once
    words = rows.select("_s", "source", (F.col("size") * F.col("rows")).alias("size"))
    # what a unit needs to know of its source comes by way of its leaf, so that rows never meet by source alone
    rows = rows.withColumn("_lot", F.xxhash64(F.lit(seed), "doc_id", "size"))
    cells = rows.withColumn("_cell", F.pmod("_lot", F.lit(CELLS))).groupBy("_s", "_cell").agg(F.count("*").alias("_n"))
    total = cells.groupBy("_s").agg(F.ceil(F.sum("_n") / FAN).alias("_leaves")).join(targets(words, weights), "_s")
    rows = rows.withColumn("_cell", F.pmod("_lot", F.lit(CELLS))).join(cells.join(total, "_s").drop("_n"), ["_s", "_cell"]).drop("_cell")
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(MOST))).otherwise(F.lit(0.0))
    rows = rows.withColumn("_copies", copies).withColumn("_whole", F.floor("_copies"))
    mass = F.when(F.col("size") > 0, (F.col("_copies") - F.col("_whole")) * F.col("rows")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_mass", mass).withColumn("_extra", F.floor("_mass").cast("long")).withColumn("_open", F.col("_mass") - F.col("_extra"))
    rows = rows.withColumn("_leaf", F.pmod(F.xxhash64("_lot"), "_leaves")).withColumn("_tie", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    rows = rows.drop("_copies", "_mass")
    most = rows.agg(F.max("_leaves")).first()[0] or 1

    level, done = 0, None
    while True:
        now = cut(rows.groupBy("_s", "_leaf").applyInArrow(_settle(seed, level), rows.schema))
        closed = now.where("_open = 0")
        done = closed if done is None else done.unionByName(closed)
        rows = now.where("_open > 0")
        if most <= 1:
            break
        level, most = level + 1, -(-most // FAN)
        rows = rows.withColumn("_leaf", F.expr(f"_leaf div {FAN}"))
    last = rows.withColumn("_extra", F.col("_extra") + F.when(F.col("_open") >= 0.5, 1).otherwise(0))
    return done.unionByName(last).drop("_s", "_leaf", "_leaves", "_lot", "_tie", "_open")


def mix(docs: DataFrame, seed: int = 11, weights=WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of each row; taken = copies * size.

    Null texts have no words; a null source is a source, ordered last; a source without words has the
    target 0. Documents without words get the whole part of their copies. Repeated rows are documents each. An
    empty table gives no rows; further columns of docs are not read. Reruns agree.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    units = settled(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), seed, weights)
    each = units.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = (F.col("_whole") + F.when(F.col("_k") <= F.col("_extra"), 1).otherwise(0)).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mix_rows(docs: DataFrame, seed: int = 11, weights=WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it.

    Rows are told apart by id, source and words; of rows alike in these that are not given the same copies, the first
    by text and then by their other columns get more. Whatever their columns are called or hold, no row is taken for
    another. Further as in mix().
    """
    name = {k: free_name(docs.columns, f"_{k}") for k in ("id", "of", "words", "rows", "whole", "extra", "place", "copy")}
    same = [name["id"], name["of"], name["words"]]
    key = [F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")), word_count(F.col(text_col))]
    keyed = docs.select("*", *[k.alias(n) for k, n in zip(key, same, strict=True)])
    units = keyed.groupBy(*same).agg(F.count("*").alias("rows"), F.min(F.col(source_col).cast("string")).alias("source")).withColumnsRenamed({same[0]: "doc_id", same[2]: "size"})
    units = settled(units, seed, weights).where("_whole + _extra > 0")
    units = units.select(F.col("doc_id").alias(same[0]), F.col(same[1]), F.col("size").alias(same[2]), F.col("rows").alias(name["rows"]), F.col("_whole").alias(name["whole"]), F.col("_extra").alias(name["extra"]))
    # the join leaves the rows of a unit together, in their order: numbering them moves no text again
    orderable = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != text_col and f.dataType.typeName() in ("long", "integer", "string", "double", "boolean", "timestamp", "date")]
    met = keyed.join(units, same).withColumn(name["place"], F.row_number().over(Window.partitionBy(*same).orderBy(F.col(text_col), *orderable)))
    times = F.col(name["whole"]) + F.when(F.col(name["place"]) <= F.col(name["extra"]), 1).otherwise(0)
    return met.withColumn(name["copy"], F.explode(F.array_repeat(F.lit(True), times.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
