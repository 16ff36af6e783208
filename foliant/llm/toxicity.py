"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with a block-max inverted index.

Terms are words and the five-letter beginnings of longer ones, all of them; texts are vectors of tf-idf weights.
Terms whose document frequency differs between the labels by far more than chance weigh TELLING times as much;
no term is left out. Examples are sorted so that like ones share blocks. Terms of few examples have postings,
which are summed up for every example; of the terms that many examples have, the index keeps the largest weight
in each block. Both give a bound of each block's cosines: a query visits the blocks of the highest bounds first,
then those whose bound reaches its NEAREST-th best so far. What comes near that is computed anew in double
precision: the neighbours are exact.

The neighbours' labels are weighed by closeness and by how far the sample of each label was thinned out,
so the score estimates a probability at the label rates of the whole fold. The neighbours are the evidence.

The examples are a bounded sample, at most PER_LABEL documents of each label; the label counts are over all, and
document frequencies are over all documents outside the held-out fold, labelled or not.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, held_out, pieces

PER_LABEL = 3000
NEAREST = 15
BLOCK = 64
FIRST_BLOCKS = 4  # visited before the others' bounds are looked at
MANY = 1 / 16  # of the examples have a term: it is kept by block
AT_ONCE = 256  # queries
SLACK = 1e-5  # more than the error of single precision
LEAST_Z, LEAST_LIFT = 6.0, 10.0  # of a telling term: deviations from chance (of hundreds of thousands of terms), and the ratio of its rates under the labels
TELLING = 6.0  # times the weight of another term of its frequency
STEM = 5
CUTOFF = 0.3
KNOWN, NO_STEM = 300_000, (1 << 32) - 1  # words that a worker remembers; no beginning
_WORD = re.compile(r"\w+")
_POSTING = np.dtype([("at", np.int32), ("held", np.float32)])


def terms(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    return words + [w[:STEM] + "-" for w in words if len(w) > STEM]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers from each start up to its end, one range after the other."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Lexicon(dict):
    """The numbers of a word and of its beginning, word << 32 | beginning, remembered for up to KNOWN words.

    numbers: of the terms that examples have. All other words share the number len(numbers); a beginning that no
    example has gets a number of its own above that, so that it can be counted, and none is NO_STEM.
    """

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers, self.others = numbers, {}

    def __reduce__(self):
        return Lexicon, (self.numbers,)

    def __missing__(self, word: str) -> int:
        stem, none = NO_STEM, len(self.numbers)
        if len(word) > STEM:
            begin = word[:STEM] + "-"
            stem = self.numbers.get(begin)
            if stem is None:
                stem = self.others.setdefault(begin, none + 1 + len(self.others))
        code = self[word] = self.numbers.get(word, none) << 32 | stem
        return code

    def forget(self) -> None:
        if len(self) > KNOWN:
            self.clear()
            self.others.clear()

    def read(self, words: Collection[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of words and of their beginnings."""
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return codes >> 32, codes & NO_STEM


@dataclass
class BlockMaxIndex:
    """The vector of example n is (term, weight)[start[n]:start[n + 1]]; the inverted index is made of these where it is used."""

    idf: dict[str, float]
    ids: list[int]
    labels: list[int]
    weight_of: tuple[float, float]
    empty_score: float
    prior: float
    unseen: float = 1.0  # weight of a term that no example has
    term: np.ndarray | None = None
    weight: np.ndarray | None = None
    start: np.ndarray | None = None
    seen: dict = field(default_factory=dict)
    ready: bool = False

    @classmethod
    def build(cls, idf: dict[str, float], examples: list[tuple[int, int, dict[str, int]]], weight_of: tuple[float, float], unseen: float = 1.0) -> BlockMaxIndex:
        """examples: (id, label, term frequencies); weight_of: documents of the fold behind an example, by label."""
        empty = [sum(weight_of[k] for _, k, tf in examples if not tf and k == label) for label in (0, 1)]
        full = [sum(weight_of[k] for _, k, _ in examples if k == label) for label in (0, 1)]
        prior = full[1] / sum(full) if sum(full) else 0.0
        blank = (empty[1] + prior) / (sum(empty) + 1)
        number, vectors = {t: n for n, t in enumerate(idf)}, []
        for i, k, tf in examples:
            if tf:
                unit = cls._unit(tf, idf)
                lead = max(unit.items(), key=lambda t: (t[1], t[0]))
                vectors.append((lead, i, k, np.array([number[t] for t in unit], np.int32), np.array(list(unit.values()))))
        vectors.sort(key=lambda x: (x[0], x[1]))
        index = cls(idf, [v[1] for v in vectors], [v[2] for v in vectors], weight_of, blank, prior, unseen)
        if vectors:
            index.term, index.weight = np.concatenate([v[3] for v in vectors]), np.concatenate([v[4] for v in vectors])
            index.start = np.cumsum([0] + [len(v[3]) for v in vectors])
        return index

    @staticmethod
    def _unit(tf: dict[str, int], idf: dict[str, float]) -> dict[str, float]:
        raw = {t: (1 + log(n)) * idf[t] for t, n in sorted(tf.items())}
        norm = sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}

    def _prepare(self) -> None:
        """Postings (at, held) of the terms of few examples, and by block the weights of the others (grid) and their largest (most)."""
        self.number, self.value = {t: n for n, t in enumerate(self.idf)}, np.array([*self.idf.values(), self.unseen])
        self.lexicon = Lexicon(self.number)
        self.blocks, self.ready, self.number_of = -(-len(self.ids) // BLOCK), True, np.array(self.ids, np.int64)
        if not self.ids:
            return
        at = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.start))
        df = np.bincount(self.term, minlength=len(self.idf))
        common = df >= max(MANY * len(self.ids), 2)
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        here = common[self.term]
        self.grid = np.zeros((self.blocks, max(int(common.sum()), 1), BLOCK), np.float32)
        self.grid[at[here] // BLOCK, self.column[self.term[here]], at[here] % BLOCK] = self.weight[here]
        self.most = np.ascontiguousarray(self.grid.max(2).T)
        rest = np.flatnonzero(~here)
        rest = rest[np.argsort(self.term[rest], kind="stable")]
        self.postings = np.empty(len(rest), _POSTING)
        self.postings["at"], self.postings["held"] = at[rest], self.weight[rest]
        self.postings = self.postings.view(np.int64)  # which are gathered in one go
        self.first = np.searchsorted(self.term[rest], np.arange(len(self.idf) + 1))

    def nearest(self, vector: dict[str, float], k: int = NEAREST) -> list[tuple[float, int]]:
        """(cosine, example) of the k highest cosines over 0, exactly; of equal ones, the example of the smaller id."""
        if not self.ready:
            self._prepare()
        known = [(self.number[t], w) for t, w in vector.items() if t in self.number]
        return self._search([(np.array([n for n, _ in known], np.int64), np.array([w for _, w in known], float))], k)[0]

    def _search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEAREST) -> list[list[tuple[float, int]]]:
        """nearest() of each query (term numbers, weights)."""
        if not self.ids or not queries:
            return [[] for _ in queries]
        scores = np.zeros((len(queries), self.blocks * BLOCK), np.float32)
        wide = np.zeros((len(queries), self.grid.shape[1]), np.float32)
        for n, (term, w) in enumerate(queries):
            column = self.column[term]
            wide[n, column[column >= 0]] = w[column >= 0]
            term, w = term[column < 0], w[column < 0]
            lo, hi = self.first[term], self.first[term + 1]
            found = self.postings[_ranges(lo, hi)].view(_POSTING)
            scores[n] = np.bincount(found["at"], np.repeat(w.astype(np.float32), hi - lo) * found["held"], scores.shape[1])
        by_block = scores.reshape(len(queries), self.blocks, BLOCK)
        bound = by_block.max(2) + wide @ self.most + SLACK
        to_visit = np.zeros(bound.shape, bool)
        np.put_along_axis(to_visit, np.argsort(-bound, 1, "stable")[:, :FIRST_BLOCKS], True, 1)
        k_th = max(scores.shape[1] - k, 0)
        for last in (False, True):
            for b in np.flatnonzero(to_visit.any(0)):
                rows = np.flatnonzero(to_visit[:, b])
                by_block[rows, b] += wide[rows] @ self.grid[b] if 2 * len(rows) < len(wide) else (wide @ self.grid[b])[rows]
            least = np.partition(scores, k_th, 1)[:, k_th]  # what isn't visited counts with a part of its cosine: no more than the whole
            if not last:
                to_visit = (bound >= least[:, None]) & ~to_visit
        out, dense = [], np.zeros(len(self.idf))
        for n, (term, w) in enumerate(queries):
            some = np.flatnonzero((scores[n] >= least[n] - SLACK) & (scores[n] > 0))
            if not len(some):
                out.append([])
                continue
            dense[term] = w
            ranges = zip(self.start[some].tolist(), self.start[some + 1].tolist(), strict=True)
            exact = np.array([dense[self.term[a:b]] @ self.weight[a:b] for a, b in ranges])
            dense[term] = 0
            order = np.lexsort((self.number_of[some], -exact))[:k]
            out.append(list(zip(exact[order].tolist(), some[order].tolist(), strict=True)))
        return out

    def scores(self, texts: list[str | None]) -> list[tuple[float, str]]:
        """(probability of label 1, evidence as example:label:cosine of the five nearest) of each text."""
        if not self.ready:
            self._prepare()
        if len(self.seen) > 50_000:
            self.seen.clear()
        keys = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() if t else b"" for t in texts]
        self.seen[b""] = (self.empty_score, "")
        fresh, last = list({key: t for key, t in zip(keys, texts, strict=True) if key not in self.seen}.items()), len(self.number)
        self.lexicon.forget()
        for first in range(0, len(fresh), AT_ONCE):
            queries, some = [], []
            for key, text in fresh[first : first + AT_ONCE]:
                words = Counter(_WORD.findall(text.lower()))
                if not words:
                    self.seen[key] = self.seen[b""]
                    continue
                word, stem = self.lexicon.read(words)
                n = np.fromiter(words.values(), float, len(words))
                long = stem != NO_STEM
                stem, which = np.unique(stem[long], return_inverse=True)
                term = np.concatenate([word, stem])
                w = (1 + np.log(np.concatenate([n, np.bincount(which, n[long])]))) * self.value[np.minimum(term, last)]
                w /= sqrt(w @ w)
                known = term < last
                queries.append((term[known], w[known]))
                some.append(key)
            for key, near in zip(some, self._search(queries), strict=True):
                self.seen[key] = self._vote(near)
        return [self.seen[key] for key in keys]

    def score(self, text: str | None) -> tuple[float, str]:
        return self.scores([text])[0]

    def _vote(self, near: list[tuple[float, int]]) -> tuple[float, str]:
        votes = [self.prior * 0.1, 0.1]  # a tenth of a vote for the rate of the fold
        each = [(1 / (1.05 - min(c, 1.0)), n) for c, n in near]
        scale = sum(w for w, _ in each) or 1.0
        for w, n in each:
            weight = len(each) * w / scale * self.weight_of[self.labels[n]] / max(self.weight_of)
            votes[0] += weight * self.labels[n]
            votes[1] += weight
        return min(max(votes[0] / votes[1], 0.0), 1.0), ",".join(f"{self.ids[n]}:{self.labels[n]}:{c:.3f}" for c, n in near[:5])


def fit(docs: DataFrame, labels: DataFrame, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> BlockMaxIndex:
    """An index over a bounded sample of the labelled documents outside the held-out fold.

    Null labels and ids teach nothing; of an id with both labels, 1 counts. Without examples every text has score 0.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    marked = marked.groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("k"))
    count = {r.k: r["count"] for r in marked.groupBy("k").count().collect()}
    part = F.when(F.col("k") == 1, 1.5 * PER_LABEL / max(count.get(1, 0), 1)).otherwise(1.5 * PER_LABEL / max(count.get(0, 0), 1))
    marked = marked.withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(1 << 40))).where(F.col("h") < part * float(1 << 40))
    marked = marked.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("h", "i"))).where(F.col("r") <= PER_LABEL)
    # at most 2 * PER_LABEL ids, so they may be sent to all; they come by way of the driver, which holds the bound
    chosen = docs.sparkSession.createDataFrame([(r.i, r.k) for r in marked.select("i", "k").collect()], "i long, k int")
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "i")
    # copies are one example: else the words of a text that was copied often would pass for telling ones
    texts = cut(texts.groupBy("text", "k").agg(F.min("i").alias("i")).select("i", "text", "k"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, found in pieces(batch, "text"):
                tfs = [Counter(terms(text)) for text in found]
                some = batch.slice(first, len(found))
                yield pa.RecordBatch.from_arrays([some.column("i"), some.column("k"), pa.array([list(tf) for tf in tfs], pa.list_(pa.string())), pa.array([list(tf.values()) for tf in tfs], pa.list_(pa.int32()))], ["i", "k", "terms", "tfs"])

    examples = []
    for batch in texts.mapInArrow(words, "i long, k int, terms array<string>, tfs array<int>").toArrow().to_batches():
        for i, k, found, tfs in zip(*(batch.column(c) for c in range(4)), strict=True):
            examples.append((i.as_py(), k.as_py(), dict(zip(map(sys.intern, found.as_py()), tfs.as_py(), strict=True))))
    examples.sort(key=lambda x: x[:2])
    sizes = Counter(k for _, k, _ in examples)
    n0, n1 = sizes[0], sizes[1]
    if not n0 + n1:
        return BlockMaxIndex({}, [], [], (1.0, 1.0), 0.0, 0.0)
    under = [Counter(t for _, k, tf in examples if k == label for t in tf) for label in (0, 1)]
    vocabulary = sorted(under[0].keys() | under[1].keys())
    shared = docs.sparkSession.sparkContext.broadcast(Lexicon({t: n for n, t in enumerate(vocabulary)}))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many texts of a partition have each term of the examples; the term null counts texts."""
        lexicon, n = shared.value, 0
        last = len(lexicon.numbers)
        df = np.zeros(last + 1, np.int64)  # the last: of words that no example has
        for batch in batches:
            for _, found in pieces(batch, "text"):
                n, at = n + len(found), [np.zeros(0, np.int64)]
                lexicon.forget()
                for text in found:
                    word, stem = lexicon.read(set(_WORD.findall(text.lower())))
                    at += [word, np.unique(stem[stem < last])]
                df += np.bincount(np.concatenate(at), minlength=last + 1)
        held = np.flatnonzero(df[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([*held.tolist(), None], pa.int64()), pa.array([*df[held].tolist(), n], pa.int64())], ["term", "n"])

    every = docs.where(F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(text_col).cast("string").alias("text"))
    counted = every.mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = dict(zip(counted.column("term").to_pylist(), counted.column("n").to_pylist(), strict=True))
    n = df.pop(None, 0)
    shared.unpersist()
    df = {vocabulary[k]: c for k, c in df.items()}
    idf = {t: (log((1 + n) / (1 + c)) + 1e-6) * (TELLING if _telling(under[0][t], under[1][t], n0, n1) else 1.0) for t, c in sorted(df.items())}
    weight = tuple(count.get(k, 0) / max(sizes[k], 1) for k in (0, 1))
    return BlockMaxIndex.build(idf, examples, weight, log(1 + n) + 1e-6)


def _telling(b: int, a: int, n0: int, n1: int) -> bool:
    """Whether a term of b of n0 examples with label 0 and of a of n1 with label 1 tells them apart."""
    q, p, m = b / max(n0, 1), a / max(n1, 1), (a + b) / (n0 + n1)
    z = abs(p - q) / sqrt(max(m * (1 - m), 1e-9) * (1 / max(n0, 1) + 1 / max(n1, 1)))
    return z >= LEAST_Z and (max(p, q) + 1e-9) / (min(p, q) + 0.5 / (n0 + n1)) >= LEAST_LIFT


def score_documents(docs: DataFrame, index: BlockMaxIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of each row, in one pass without a shuffle.

    Texts that are null or have no word score the rate of label 1 among such examples; of equally near
    examples those of the smaller ids vote; a text that shares no term with any example has the rate of the fold
    and no evidence; repeated rows are scored each; an empty table gives no rows; only id and text are read.
    """

    shared = docs.sparkSession.sparkContext.broadcast(index)  # a worker makes the inverted index once for all its tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch, "text"):
                got = shared.value.scores(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, len(texts)) for c in ("doc_id", "held_out")), pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= CUTOFF) for s, _ in got], pa.int32()), pa.array([e for _, e in got], pa.string())],
                    ["doc_id", "held_out", "score", "predicted", "evidence"],
                )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence string")
