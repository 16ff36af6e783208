"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded; filters of several widths slide over a window of WINDOW bytes; each filter keeps its
maximum over the window; a linear layer and softmax follow. A text is cut into windows of that length, all
of which are classified, in batches; its probabilities are the windows' means, weighted by their bytes.

The network learns every label from a bounded sample: at most PER_LANG documents of each, chosen by a hash of
the id, and SPOTS windows of each document. Everything is predicted with all windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, pieces

WINDOW, EMBED, WIDTHS, FILTERS = 256, 6, (2, 3, 4), 8
PER_LANG, SPOTS = 400, 4
UNKNOWN = "und"


@dataclass
class ByteConvNet:
    """embed: 256 x EMBED, row 0 (also padding) zero; filters: widest * EMBED x all filters, zero beyond a filter's width."""

    langs: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], rng: np.random.Generator) -> ByteConvNet:
        widest, many = max(WIDTHS), FILTERS * len(WIDTHS)
        embed = rng.normal(0, 0.5, (256, EMBED))
        embed[0] = 0
        net = cls(langs, embed, rng.normal(0, 0.4, (widest * EMBED, many)), np.zeros(many), rng.normal(0, 0.3, (many, len(langs))), np.zeros(len(langs)))
        net.filters *= net.mask()
        return net

    @staticmethod
    def mask() -> np.ndarray:
        return np.concatenate([np.repeat((np.arange(max(WIDTHS)) < w).astype(float), EMBED)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1)

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.dense, self.dense_bias]

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of the filters over each window (before the bias), and the patches they were taken over."""
        widest = max(WIDTHS)
        x = np.zeros((len(windows), windows.shape[1] + widest - 1, EMBED), self.embed.dtype)
        x[:, : windows.shape[1]] = self.embed[windows]
        view = np.lib.stride_tricks.as_strided(x, (len(x), windows.shape[1], widest * EMBED), x.strides[:2] + x.strides[2:])
        patches = np.ascontiguousarray(view).reshape(-1, widest * EMBED)
        return (patches @ self.filters).reshape(len(x), windows.shape[1], -1), patches

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out, _ = self.pooled(windows)
        return self._softmax(np.maximum(out.max(1) + self.bias, 0) @ self.dense + self.dense_bias)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        n, length, many = len(windows), windows.shape[1], self.filters.shape[1]
        out, patches = self.pooled(windows)
        best = out.argmax(1)
        pre = np.take_along_axis(out, best[:, None], 1)[:, 0] + self.bias
        act = np.maximum(pre, 0)
        d = self._softmax(act @ self.dense + self.dense_bias)
        d[np.arange(n), labels] -= 1
        d /= n
        back = (d @ self.dense.T) * (pre > 0)
        where = patches.reshape(n, length, -1)[np.arange(n)[:, None], best]  # n x filters x patch
        d_filters = np.einsum("nfp,nf->pf", where, back) * self.mask()
        d_patch = back[..., None] * self.filters.T
        spots = np.minimum(best[..., None] + np.arange(max(WIDTHS)), length - 1)
        inside = best[..., None] + np.arange(max(WIDTHS)) < length
        d_embed = np.zeros_like(self.embed)
        read = windows[np.arange(n)[:, None, None], spots]
        np.add.at(d_embed, read, d_patch.reshape(n, many, max(WIDTHS), EMBED) * inside[..., None])
        d_embed[0] = 0
        return [d_embed, d_filters, back.sum(0), act.T @ d, d.sum(0)]

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int, rng: np.random.Generator, batch: int = 64, rate: float = 0.01) -> None:
        """Adam over shuffled batches."""
        m, v, t = [np.zeros_like(p) for p in self.params()], [np.zeros_like(p) for p in self.params()], 0
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for a in range(0, len(order), batch):
                t += 1
                step = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for p, g, mi, vi in zip(self.params(), self.gradients(windows[order[a : a + batch]], labels[order[a : a + batch]]), m, v, strict=True):
                    mi += 0.1 * (g - mi)
                    vi += 0.001 * (g * g - vi)
                    p -= step * mi / (np.sqrt(vi) + 1e-8)

    def as_single(self) -> ByteConvNet:
        return ByteConvNet(self.langs, *(p.astype(np.float32) for p in self.params()))

    def classify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability) of whole texts; UNKNOWN, 0 for null and for texts without a letter."""
        read = [i for i, t in enumerate(texts) if self.langs and t and any(map(str.isalpha, t))]
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not read:
            return out
        raw = [texts[i].encode("utf-8", "surrogatepass") for i in read]
        sizes = np.array([len(b) for b in raw])
        counts = -(-sizes // WINDOW)
        windows = np.frombuffer(b"".join([b.ljust(c * WINDOW, b"\0") for b, c in zip(raw, counts.tolist(), strict=True)]), np.uint8).reshape(-1, WINDOW)
        probs = np.concatenate([self.probabilities(windows[a : a + 32]) for a in range(0, len(windows), 32)]).astype(np.float64)
        starts = np.cumsum(counts) - counts
        weight = np.full(len(windows), float(WINDOW))
        weight[starts + counts - 1] = sizes - (counts - 1) * WINDOW
        means = np.add.reduceat(probs * weight[:, None], starts) / sizes[:, None]
        for i, best, p in zip(read, means.argmax(1), means.max(1), strict=True):
            out[i] = (self.langs[best], float(min(max(p, 0.0), 1.0)))
        return out


def train(docs: DataFrame, seed: int = 3, epochs: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteConvNet:
    """A network fitted to a bounded sample of the rows outside the held-out fold that have text and lang.

    The labels are counted over all rows. Without such rows the network knows no language.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    net = ByteConvNet.fresh(langs, rng := np.random.default_rng(seed))
    if not langs:
        return net
    # a hash keeps about one and a half times PER_LANG rows of each language, of which the first are taken
    part = docs.sparkSession.createDataFrame([(k, min(1.0, 1.5 * PER_LANG / n + 1e-9)) for k, n in counts.items()], "lang string, part double")
    hashed = rows.withColumn("h", F.pmod(F.xxhash64(F.lit(seed), F.col("i").cast("string")), F.lit(1 << 40)))
    some = hashed.join(F.broadcast(part), "lang").where(F.col("h") < F.col("part") * float(1 << 40))
    body = F.encode("text", "UTF-8")
    spot = [F.substring(body, F.floor(F.greatest(F.length(body) - WINDOW, F.lit(0)) * (k / max(SPOTS - 1, 1))).cast("int") + 1, F.lit(WINDOW)) for k in range(SPOTS)]
    some = some.select("lang", "h", "i", F.array_distinct(F.array(*spot)).alias("spots"))
    first = Window.partitionBy("lang").orderBy("h", "i", F.col("spots").cast("string"))
    got = some.withColumn("r", F.row_number().over(first)).where(F.col("r") <= PER_LANG).orderBy("lang", "r").select("lang", "spots").collect()
    found = [(bytes(w), langs.index(r.lang)) for r in got for w in r.spots if w]
    if found:
        windows = np.frombuffer(b"".join([w.ljust(WINDOW, b"\0") for w, _ in found]), np.uint8).reshape(-1, WINDOW)
        net.fit(windows, np.array([k for _, k in found]), epochs, rng)
    return net.as_single()


def identify(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row, in one pass without a shuffle.

    A null text and one without letters give `und` and 0; repeated rows are classified each; an empty table
    gives no rows; only id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch, "text", 1 << 20):
                got = net.classify(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, len(texts)) for c in ("doc_id", "held_out")), pa.array([k for k, _ in got], pa.string()), pa.array([p for _, p in got], pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: ByteConvNet, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with a score of `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch, text_col, 1 << 20):
                keep = [k != UNKNOWN and p >= least for k, p in net.classify(texts)]
                yield batch.slice(first, len(texts)).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
