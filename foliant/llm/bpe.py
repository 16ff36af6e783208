"""Byte-level BPE by a segment tree over byte positions.

A leaf holds, for the live token that starts at its byte, the rank of the pair of that token and the next
live one; an inner node holds the smallest (rank, position) below it, so the root names the leftmost pair
of the lowest rank. A merge kills one leaf and changes its two live neighbours: three updates, each of
logarithmic cost. Pieces of up to 64 bytes go through the same trees side by side, as rows of numpy arrays.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pieces

WIDEST = 64  # bytes of the widest piece that is encoded side by side with others
KNOWN = 150_000  # pieces that a worker remembers; beyond that it forgets those that it has not met since the last time
NONE = np.int64(1) << 62
MOST_RANK_BYTES = 64 << 20


class ByteBpe:
    def __init__(self, rank_lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_lines.splitlines())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}  # the ids of pieces met before; of old ones, those met again are kept
        self.old: dict[str, tuple[int, ...]] = {}
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self._own = list(range(len(self.bytes_of))).__getitem__  # one number object for each id, whoever remembers it
        self._single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self._of_bytes = np.array([self.ranks.get(bytes([a, b]), NONE) for a in range(256) for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self._pairs = np.array(sorted(pairs), np.int64)
        self._merged = np.array([pairs[k] for k in self._pairs.tolist()], np.int64)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern, of any length."""
        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        if n < 2:
            return [ranks[piece]] if n else []
        leaves = 1 << (n - 2).bit_length() if n > 2 else 1
        none = (len(ranks) + 1) * n + n * n
        tree = [none] * (2 * leaves)
        after, before = list(range(1, n + 1)), list(range(-1, n))

        def pair(i: int) -> int:
            j = after[i]
            if j >= n:
                return none
            rank = ranks.get(piece[i : after[j]])
            return none if rank is None else rank * n + i

        for i in range(n - 1):
            tree[leaves + i] = pair(i)
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = leaves + i
            tree[k] = value
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least

        while tree[1] != none:
            i = tree[1] % n
            j = after[i]
            k = after[j]
            after[i] = k
            before[k if k < n else n] = i
            if j < n - 1:
                put(j, none)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of token ids; NONE where they don't merge."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self._pairs, keys), len(self._pairs) - 1)
        return np.where(self._pairs[at] == keys, self._merged[at], NONE)

    def encode_short(self, found: list[bytes]) -> list[list[int]]:
        """Ids of pieces of 2 to WIDEST bytes, all of which share one tree width."""
        count, lengths = len(found), np.array([len(p) for p in found], np.int64)
        width = 1 << int(lengths.max() - 1).bit_length()
        bits = width.bit_length() - 1
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in found]), np.uint8).reshape(count, width)
        spot = np.arange(width)
        live = spot < lengths[:, None]
        tree = np.full((count, 2 * width), NONE)
        rank = self._of_bytes[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]]
        tree[:, width:-1] = np.where((rank < NONE) & live[:, 1:], rank << bits | spot[:-1], NONE)
        k = width
        while k > 1:
            np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2], out=tree[:, k // 2 : k])
            k //= 2
        # flat from here: row r has its tokens from r * width, its tree from r * width * 2
        token = self._single[raw].ravel()
        after = np.tile(spot + 1, count)
        before = np.tile(spot - 1, count)
        live, root = live.ravel(), np.arange(count) * (2 * width) + 1
        rows = np.flatnonzero(tree[:, 1] < NONE)
        tree = tree.ravel()

        def put(at: np.ndarray, i: np.ndarray, value: np.ndarray | np.int64) -> None:
            base = at * (2 * width)
            k = i + width
            tree[base + k] = value
            for _ in range(bits):
                pair = base + (k & ~1)
                k = k >> 1
                tree[base + k] = np.minimum(tree.take(pair), tree.take(pair + 1))

        def leaf(base: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            rank = self._lookup(token.take(base + i), token.take(base + j))
            return np.where(rank < NONE, rank << bits | i, NONE)

        while len(rows):
            top, base = tree.take(root.take(rows)), rows * width
            i = top & (width - 1)
            j = after.take(base + i)
            k = after.take(base + j)
            token[base + i] = top >> bits
            live[base + j] = False
            after[base + i] = k
            put(rows, j, NONE)
            more = k < lengths.take(rows)
            before[(base + k)[more]] = i[more]
            put(rows, i, np.where(more, leaf(base, i, np.where(more, k, i)), NONE))
            prior = before.take(base + i)
            less = prior >= 0
            r, a = rows[less], prior[less]
            put(r, a, leaf(r * width, a, i[less]))
            rows = rows[tree.take(root.take(rows)) < NONE]
        flat, ends = token[live].tolist(), np.cumsum(live.reshape(count, width).sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, found: Iterable[str]) -> None:
        """Remember the ids of pieces not met before."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in found:
            if p in self.known:
                continue
            if p in self.old:
                self.known[p] = self.old[p]
                continue
            b = p.encode("utf-8", "surrogatepass")
            if b in self.ranks:
                self.known[p] = (self._own(self.ranks[b]),)
            elif len(b) > WIDEST:
                self.known[p] = tuple(map(self._own, self.encode_piece(b)))
            else:
                by_width.setdefault((len(b) - 1).bit_length(), []).append((p, b))
        for group in by_width.values():
            for (p, _), ids in zip(group, self.encode_short([b for _, b in group]), strict=True):
                self.known[p] = tuple(map(self._own, ids))

    def encode_batch(self, texts: list[str]) -> list[tuple[str, list[int]]]:
        """(ids as decimals joined by a space, ids) of each text."""
        if len(self.known) > KNOWN:
            self.known, self.old = {}, self.known
        # a text's pieces are looked up at once and dropped, but for the unknown ones: millions of strings at a time leave no cache warm
        held, gaps, new = [], [], set()
        for text in texts:
            found = self.split(text)
            got, here, at = list(map(self.known.get, found)), [], -1
            for _ in range(got.count(None)):
                at = got.index(None, at + 1)
                here.append((at, found[at]))
            new.update([p for _, p in here])
            held.append(got)
            gaps.append(here)
        self.learn(new)
        out = []
        for got, here in zip(held, gaps, strict=True):
            for at, p in here:
                got[at] = self.known[p]
            ids = list(chain.from_iterable(got))
            out.append((" ".join(map(self.decimal.__getitem__, ids)), ids))
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0][1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(rank_lines: bytes, pattern: str) -> ByteBpe:
    """One codec for each worker process; its size is that of the vocabulary."""
    return ByteBpe(rank_lines, pattern)


def read_ranks(rank_file: str) -> bytes:
    """The lines of a rank file, which the driver reads; executors need not see the file."""
    with open(rank_file, "rb") as f:
        return f.read()


def encode_documents(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of each row, in one pass without a shuffle.

    A null text counts as empty and has no tokens; repeated rows are encoded each; further columns are not
    read; an empty table gives no rows. A text is encoded whole, and so is a match of the pattern of any length.
    """
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [pa.field("ids", pa.list_(pa.int32()))] * with_ids)
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    lines = read_ranks(rank_file)
    if len(lines) > MOST_RANK_BYTES:
        raise ValueError(f"{rank_file} is too large to be sent to every worker")
    shared = docs.sparkSession.sparkContext.broadcast(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collecting = gc.isenabled()
        gc.disable()  # millions of small tuples and no cycles: looking for cycles took a third of the time
        try:
            yield from encoded(batches)
        finally:
            if collecting:  # the worker goes on to other stages
                gc.enable()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = codec(shared.value, pattern), hashlib.sha256
        for batch in batches:
            for first, texts in pieces(batch, "text", 1 << 18):
                got = bpe.encode_batch([t or "" for t in texts])
                columns = [
                    batch.column("doc_id").slice(first, len(texts)),
                    pa.array([len(ids) for _, ids in got], pa.int64()),
                    pa.array([sha(s.encode()).hexdigest() for s, _ in got]),
                    pa.array([sha(bpe.decode(ids)).hexdigest() for _, ids in got]),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([ids for _, ids in got], pa.list_(pa.int32()))] * with_ids, schema=schema)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, ddl)
