"""Removal of long byte strings that an earlier document has, by fingerprints of minimizer contexts.

This stands in the place of prefix doubling (prefix_ranks), which ranks every position by pairs of earlier ranks: nothing
is ranked here. Each round hashes strings of a growing length anew from the text, deals the hashes into
buckets, sorts each bucket, and tells the positions whose hash is shared, which alone go on: strings of a third
of the threshold, then of two thirds, then of the whole.

Two things keep the rounds small. (1) Positions are represented by anchors: the leftmost smallest hash of
the short strings inside a window of threshold length. Windows alike have the same anchor at the same place,
so asking about anchors asks about every window; about one position in 17 is one. (2) A window range with one anchor is
first asked about as one string (its context): what lies inside a longer repeat is settled at once.

Positions travel packed: documents are dealt into chunks, each chunk asks a bucket about a string once,
however often it has it, and is answered with a bit for each string it asked about. So a string that is
everywhere costs a bucket one key for each chunk, and no group of copies meets anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 50
CHUNK, BUCKET, SEGMENT = 4 << 20, 8 << 20, 1 << 17  # bytes of text: of a chunk, behind a bucket, hashed at once
_ROW = "bucket long, chunk long, kind int, payload binary"
ASK, STATE = 0, 1
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of byte ranges by prefix sums of a polynomial modulo 2 ** 64, whose odd base has an inverse."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        base = int(rng.integers(1 << 60)) * 8 + 5
        self.value = rng.integers(0, 1 << 63, 256, np.uint64)
        self.power, self.inverse = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(x))])) for x in (base, pow(base, -1, 1 << 64)))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.value[raw] * self.power[: len(raw)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[first]) * self.inverse[first]


_rolling: list[Rolling] = []


def rolling() -> list[Rolling]:
    if not _rolling:
        _rolling.extend(Rolling(seed, SEGMENT + 4096) for seed in (101, 202))
    return _rolling


class Segment:
    """The windows that start in one stretch of a chunk's bytes, by anchor: window starts low to high share `anchor`."""

    def __init__(self, raw: np.ndarray, base: int, ends: np.ndarray, docs: np.ndarray, length: int):
        gram = max(1, length // 3)
        width = length - gram + 1
        self.raw, self.base, self.length = raw, base, length
        one = rolling()[0]
        self.sums = one.sums(raw)
        self._second = None
        n = len(raw) - gram + 1
        h = _mix((self.sums[gram:] - self.sums[:-gram]) * one.inverse[:n])
        least, span = h, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        windows = len(least)
        anchor = np.zeros(windows, np.int32)
        anchor[1:] = np.where(least[1:] < least[:-1], np.arange(width, windows + width - 1, dtype=np.int32), 0)
        left = np.concatenate([[0], np.flatnonzero(h[: windows - 1] == least[:-1]) + 1])  # where the anchor dropped out
        anchor[left] = 0
        for k in range(width):
            hit = h[left + k] == least[left]
            anchor[left[hit]] = left[hit] + k
            left = left[~hit]
            if not len(left):
                break
        np.maximum.accumulate(anchor, out=anchor)
        valid = np.ones(windows, bool)
        for e in ends.tolist():  # ends of documents: no window goes over one
            valid[max(0, e - length + 1) : e] = False
        at = np.flatnonzero(valid)
        a = anchor[at]
        new = np.ones(len(at), bool)
        new[1:] = (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)
        starts = np.flatnonzero(new)
        self.low = at[starts]
        self.high = at[np.append(starts[1:], len(at)) - 1] if len(at) else at
        self.anchor = a[starts].astype(np.int64)
        self.doc = docs[np.searchsorted(ends, self.low, "right")]
        self.gram = h[self.anchor]

    def second(self) -> np.ndarray:
        if self._second is None:
            self._second = rolling()[1].sums(self.raw)
        return self._second

    def weak(self, first: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        return _mix(rolling()[0].ranges(self.sums, first, end), salt)

    def strong(self, first: np.ndarray, end: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes: the key, and what deals it to a bucket."""
        one, two = self.weak(first, end, salt), _mix(rolling()[1].ranges(self.second(), first, end), salt)
        size = (end - first).astype(np.uint64)
        return _mix(one ^ (two >> np.uint64(17)) ^ size, salt), _mix(two + size, salt)


class Asked:
    """Strings that a chunk asks about: sorted by bucket and key, each once, with the smallest id that has it."""

    def __init__(self, bucket: np.ndarray, key: np.ndarray, doc: np.ndarray):
        self.doc = doc
        order = np.lexsort((key, bucket))
        b, k = bucket[order], key[order]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
        starts = np.flatnonzero(new)
        self.group = np.empty(len(b), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.bucket, self.key = b[starts], k[starts]
        self.least = np.minimum.reduceat(doc[order], starts) if len(b) else doc
        self.most = np.maximum.reduceat(doc[order], starts) if len(b) else doc
        self.cuts = np.append(np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1])), len(self.bucket)) if len(b) else np.zeros(1, np.int64)

    def rows(self, chunk: int, decides: bool) -> Iterator[tuple[int, int, int, bytes]]:
        for a, b in zip(self.cuts.tolist(), self.cuts[1:].tolist(), strict=False):
            if decides:
                base = int(self.least[a:b].min())
                off = self.least[a:b] - base
                small = int(off.max()) < 1 << 32
                body = bytes([small]) + base.to_bytes(8, "little", signed=True) + self.key[a:b].tobytes() + (off.astype(np.uint32) if small else off).tobytes()
            else:
                body = (self.key[a:b].astype(np.uint32) << np.uint32(1) | (self.most[a:b] != self.least[a:b]).astype(np.uint32)).tobytes()
            yield int(self.bucket[a]), chunk, ASK, body

    def answers(self, rows: list[tuple[int, bytes]], decides: bool) -> np.ndarray:
        """For each string as asked for: that another document has it, or (deciding) that one with a smaller id has it."""
        sizes = np.diff(self.cuts)
        if [b for b, _ in rows] != self.bucket[self.cuts[:-1]].tolist():
            raise RuntimeError("the answers are not to what this chunk asked")
        bits = [np.unpackbits(np.frombuffer(p, np.uint8), count=int(n)) for (_, p), n in zip(rows, sizes, strict=True)]
        flag = np.concatenate(bits).astype(bool)[self.group] if bits else np.zeros(0, bool)
        return flag | (self.doc > self.least[self.group]) if decides and len(self.group) else flag


def answer(decides: bool) -> Callable[[pa.Table], pa.Table]:
    """The work of a bucket: sort the keys of all chunks and tell each chunk which are shared."""

    def run(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group.column(c).to_pylist() for c in ("bucket", "chunk", "kind", "payload")), strict=True))
        out = [r for r in rows if r[2] == STATE]
        asked = [r for r in rows if r[2] == ASK]
        if asked:
            keys, more = [], []
            for _, _, _, p in asked:
                if decides:
                    n = (len(p) - 9) // (12 if p[0] else 16)
                    keys.append(np.frombuffer(p, np.uint64, n, 9))
                    more.append(np.frombuffer(p, np.uint32 if p[0] else np.int64, n, 9 + 8 * n).astype(np.int64) + int.from_bytes(p[1:9], "little", signed=True))
                else:
                    k = np.frombuffer(p, np.uint32)
                    keys.append(k >> np.uint32(1))
                    more.append(k & np.uint32(1))
            sizes = [len(k) for k in keys]
            key, extra = np.concatenate(keys), np.concatenate(more)
            order = np.argsort(key, kind="stable")
            k = key[order]
            starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            count = np.diff(np.append(starts, len(k)))
            flag = np.empty(len(k), bool)
            if decides:
                flag[order] = extra[order] > np.repeat(np.minimum.reduceat(extra[order], starts), count)
            else:
                flag[order] = np.repeat((count > 1) | (np.maximum.reduceat(extra[order], starts) > 0), count)
            ends = np.cumsum(sizes)
            out += [(b, c, ASK, np.packbits(flag[e - n : e]).tobytes()) for (b, c, _, _), n, e in zip(asked, sizes, ends.tolist(), strict=True)]
        return _table(out)

    return run


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    b, c, k, p = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"bucket": pa.array(b, pa.int64()), "chunk": pa.array(c, pa.int64()), "kind": pa.array(k, pa.int32()), "payload": pa.array(p, pa.binary())})


class Chunk:
    """The documents of a chunk and what is known of their window ranges ("entries") after the rounds so far.

    done: some smaller document has the whole context. left, right: windows that start `half` or more before the
    anchor, or later than that, are still open.
    """

    def __init__(self, docs: pa.Table, length: int, buckets: int):
        rows = sorted(zip(docs.column("doc_id").to_pylist(), docs.column("body").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.ids, self.texts = [r[0] for r in rows], [r[1] for r in rows]
        self.length, self.buckets, self.half = length, buckets, (length - length // 3) // 2
        self.number = docs.column("chunk")[0].as_py()
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.held = list(self._cut()) if self.sizes.sum() <= 4 * CHUNK else None
        self.count = sum(len(s.low) for s in self.segments())
        self.done, self.left, self.right = (np.zeros(self.count, bool) for _ in range(3))

    def _cut(self) -> Iterator[Segment]:
        """Short documents share a segment; a long one is cut at multiples of SEGMENT from its start, as its copies are."""
        length, some, size = self.length, [], 0

        def made() -> Segment:
            ends = np.cumsum(self.sizes[some])
            raw = np.frombuffer(b"".join([self.texts[i] for i in some]), np.uint8)
            return Segment(raw, int(self.firsts[some[0]]), ends, np.array([self.ids[i] for i in some] + [0], np.int64), length)

        for i, n in enumerate(self.sizes.tolist()):
            long = n > SEGMENT
            if some and (long or size + n > SEGMENT or self.ids[i] is None or i != some[-1] + 1):
                if size >= length:
                    yield made()
                some, size = [], 0
            if self.ids[i] is None or n < length:
                continue
            if not long:
                some.append(i)
                size += n
                continue
            for a in range(0, n - length + 1, SEGMENT):
                raw = np.frombuffer(self.texts[i], np.uint8)[a : min(n, a + SEGMENT + length - 1)]
                yield Segment(raw, int(self.firsts[i]) + a, np.array([len(raw)]), np.array([self.ids[i], 0], np.int64), length)
        if some and size >= length:
            yield made()

    def segments(self) -> Iterator[Segment]:
        return iter(self.held) if self.held is not None else self._cut()

    def _each(self) -> Iterator[tuple[Segment, slice]]:
        at = 0
        for s in self.segments():
            yield s, slice(at, at + len(s.low))
            at += len(s.low)

    def _weak(self, hashes: list[np.ndarray], docs: list[np.ndarray]) -> Asked:
        h, d = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (docs, np.int64)))
        return Asked(((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64), h & np.uint64(0x7FFFFFFF), d)

    def _strong(self, keys: list[tuple[np.ndarray, np.ndarray]], docs: list[np.ndarray]) -> Asked:
        if not keys:
            return Asked(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        key, deal = (np.concatenate([k[x] for k in keys]) for x in (0, 1))
        return Asked((deal % np.uint64(self.buckets)).astype(np.int64), key, np.concatenate(docs))

    def grams(self) -> Asked:
        each = [(s.gram, s.doc) for s in self.segments()]
        return self._weak([g for g, _ in each], [d for _, d in each])

    def contexts(self) -> Asked:
        keys, docs = [], []
        for s, at in self._each():
            on = self.left[at]
            keys.append(s.strong(s.low[on], s.high[on] + self.length, 1))
            docs.append(s.doc[on])
        return self._strong(keys, docs)

    def _sides(self, s: Segment, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Entries whose open windows all hold the string to the left of the anchor, and those to its right."""
        return self.left[at] & (s.low <= s.anchor - self.half), self.right[at] & (s.high > s.anchor - self.half)

    def sides(self) -> Asked:
        hashes, docs, gram = [], [], max(1, self.length // 3)
        for s, at in self._each():
            a, b = self._sides(s, at)
            hashes += [s.weak(s.anchor[a] - self.half, s.anchor[a] + gram, 2), s.weak(s.anchor[b], s.anchor[b] + self.length - self.half + 1, 3)]
            docs += [s.doc[a], s.doc[b]]
        return self._weak(hashes, docs)

    def _open(self, s: Segment, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Entry and start of each open window."""
        a, b = self._sides(s, at)
        first = np.where(a, s.low, np.maximum(s.low, s.anchor - self.half + 1))
        last = np.where(b, s.high, np.minimum(s.high, s.anchor - self.half))
        many = np.where(a | b, last - first + 1, 0)
        entry = np.repeat(np.arange(len(many)), many)
        return entry, np.repeat(first, many) + np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)

    def windows(self) -> Asked:
        keys, docs = [], []
        for s, at in self._each():
            entry, start = self._open(s, at)
            keys.append(s.strong(start, start + self.length, 4))
            docs.append(s.doc[entry])
        return self._strong(keys, docs)

    # what the answers of each round tell

    def learn_grams(self, shared: np.ndarray) -> None:
        self.left, self.right = shared.copy(), shared.copy()

    def learn_contexts(self, earlier: np.ndarray) -> None:
        on = np.flatnonzero(self.left)
        self.done[on[earlier]] = True
        self.left, self.right = self.left & ~self.done, self.right & ~self.done

    def learn_sides(self, shared: np.ndarray) -> None:
        left, right, at = np.zeros(self.count, bool), np.zeros(self.count, bool), 0
        for s, here in self._each():
            for side, to in zip(self._sides(s, here), (left, right), strict=True):
                n = int(side.sum())
                to[here.start + np.flatnonzero(side)] = shared[at : at + n]
                at += n
        self.left, self.right = left, right

    def covered(self, earlier: np.ndarray) -> np.ndarray:
        """The chunk's bytes that go; earlier: of each open window."""
        change, at = np.zeros(int(self.sizes.sum()) + 1, np.int32), 0
        for s, here in self._each():
            done = self.done[here]
            entry, start = self._open(s, here)
            start = start[earlier[at : at + len(start)]]
            at += len(entry)
            np.add.at(change, s.base + np.concatenate([s.low[done], start]), 1)
            np.add.at(change, s.base + np.concatenate([s.high[done], start]) + self.length, -1)
        return np.cumsum(change[:-1]) > 0

    def state(self) -> Iterator[tuple[int, int, int, bytes]]:
        yield self.number % self.buckets, self.number, STATE, b"".join(np.packbits(x).tobytes() for x in (self.done, self.left, self.right))

    def recall(self, payload: bytes) -> None:
        n = -(-self.count // 8)
        self.done, self.left, self.right = (np.unpackbits(np.frombuffer(payload, np.uint8, n, n * k), count=self.count).astype(bool) for k in range(3))


#: The rounds: what is asked, whether the answer decides, what is learnt.
ROUNDS = ((Chunk.grams, False, Chunk.learn_grams), (Chunk.contexts, True, Chunk.learn_contexts), (Chunk.sides, False, Chunk.learn_sides), (Chunk.windows, True, None))


def _told(chunk: Chunk, answers: pa.Table, number: int) -> np.ndarray:
    """Recall the state before a round, ask again, and read the answers."""
    rows = list(zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", "payload")), strict=True))
    for _, kind, payload in rows:
        if kind == STATE:
            chunk.recall(payload)
    ask, decides, _ = ROUNDS[number]
    return ask(chunk).answers(sorted((b, p) for b, kind, p in rows if kind == ASK), decides)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of each row.

    A byte goes if a `length`-byte string over it also starts in a document with a smaller id; matches never
    cross documents, and are looked for in the texts as given. A null text is empty. A row without an id loses
    nothing and takes nothing from others; rows that share an id take nothing from each other. An empty table
    gives no rows; further columns are not read. length must be 3 or more.
    """
    body = F.encode(F.coalesce(docs[text_col].cast("string"), F.lit("")), "UTF-8")
    total = docs.select(F.sum(F.octet_length(body).cast("long"))).first()[0] or 0
    chunks, buckets = max(1, -(-total // CHUNK)), max(64, -(-total // BUCKET))
    identity = docs[id_col].cast("long")
    deal = F.pmod(F.xxhash64(identity, body), F.lit(chunks))  # by the text too: rows without an id, or of one id, spread
    texts = docs.select(identity.alias("doc_id"), body.alias("body"), deal.alias("chunk"))

    def first(group: pa.Table) -> pa.Table:
        chunk = Chunk(group, length, buckets)
        return _table(list(chunk.grams().rows(chunk.number, False)))

    def later(number: int):
        def run(group: pa.Table, answers: pa.Table) -> pa.Table:
            if not group.num_rows:
                return _table([])
            chunk = Chunk(group, length, buckets)
            ROUNDS[number - 1][2](chunk, _told(chunk, answers, number - 1))
            ask, decides, _ = ROUNDS[number]
            return _table([*ask(chunk).rows(chunk.number, decides), *chunk.state()])

        return run

    def last(group: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(group, length, buckets)
        gone = chunk.covered(_told(chunk, answers, len(ROUNDS) - 1))
        out = []
        for i, text, a, n in zip(chunk.ids, chunk.texts, chunk.firsts.tolist(), chunk.sizes.tolist(), strict=True):
            g = gone[a : a + n]
            spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(n > 0 and g[0])
            kept = np.frombuffer(text, np.uint8)[~g].tobytes() if spans else text
            out.append((i, n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_kept]
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(names, cols, types, strict=False)})

    by_chunk = texts.groupBy("chunk")
    answers = by_chunk.applyInArrow(first, _ROW).groupBy("bucket").applyInArrow(answer(False), _ROW)
    for number in range(1, len(ROUNDS)):
        asked = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(later(number), _ROW)
        answers = asked.groupBy("bucket").applyInArrow(answer(ROUNDS[number][1]), _ROW)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(last, ddl)
