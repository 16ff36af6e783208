"""Quality rules as a ledger: each rule is measured once, its failures are bits, and policies read the bits.

A row of the ledger has the measurements and `failed`, with bit k set where rule k fails. A policy is a
version's mask: it drops a document with a failed bit in the mask. Other versions, and what each rule alone
costs (ablations), follow from the bits by bitwise aggregation, without another look at a text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rule k: a name and its failure over the measurements.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("repeated_lines", "n_lines >= 5 AND 2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 40 * n_words"),
    ("short_words", "n_words >= 50 AND word_chars < 2 * n_words"),
    ("many_lines", "n_words >= 50 AND 2 * n_lines > n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: A version of the policy: the rules that drop a document.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": BIT["few_words"] | BIT["repeated_words"] | BIT["symbols"] | BIT["repeated_lines"] | BIT["long_words"],
    "v2": sum(BIT.values()),
}
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """The measurements of a text in the order of _FIELDS. Words end at the six ASCII white-space characters."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(seen := Counter(windows)) < len(windows):
            until = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 3 - max(i, until)
                    until = i + 3
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and the bit mask `failed` of each row, in one pass without a shuffle.

    A null text counts as one without words; repeated rows are measured each; further columns are not
    read; an empty table gives no rows.
    """
    ddl = "doc_id long, " + ", ".join(f"{f} long" for f in _FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch, "text"):
                rows = [measure(t or "") for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["doc_id", *_FIELDS])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, ddl)
    return rows.withColumn("failed", F.expr(" | ".join(f"IF({rule}, {1 << k}, 0)" for k, (_, rule) in enumerate(RULES))))


def keeps(policy: str):
    """A column over a ledger: whether that version keeps the document."""
    return F.col("failed").bitwiseAND(POLICIES[policy]) == 0


def ablations(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """rule, n_failed, n_only (dropped by this rule alone: kept again without it), n_together, for each rule of
    the policy. The ledger is first counted by its masks, of which there are 2 ** len(RULES) at most."""
    mask = POLICIES[policy]
    masks = rows.select(F.col("failed").bitwiseAND(mask).alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    each = masks.select("m", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(b).alias("bit")) for k, b in BIT.items() if b & mask])).alias("r"))
    hit = F.col("m").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        F.coalesce(F.sum(F.when(hit & (F.col("m") != F.col("r.bit")), F.col("n"))), F.lit(0)).alias("n_together"),
    )


def judge(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with base_failed, kept (not failed by the base rules, nor by the policy) and ablated: the bit of the
    one rule of the policy without which the document would be kept, else 0. Nulls and the rest are as in ledger()."""
    rows = ledger(docs)
    mask = F.col("failed").bitwiseAND(POLICIES[policy])
    alone = F.when(F.bit_count(mask) == 1, mask).otherwise(0)
    return rows.withColumn("base_failed", ~keeps("base")).withColumn("kept", keeps("base") & keeps(policy)).withColumn("ablated", alone)
