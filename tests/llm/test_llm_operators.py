"""Each operator against a plainer form of it, and on nulls, empty and very long texts, ties, repeated rows, empty
tables and further columns with clashing names."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from foliant.llm import bpe, common, graph, langid, minhash, mixing, prefix_ranks, quality, secret_scan, sharding, suffix_dedup, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and a to in is that it for was on are as with his they at be this have from or had by word but what some we can out other were all".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(("", "s", "er", "ing", str(rnd.randrange(50)))) for _ in range(n))


def corpus():
    """Prose, copies, near copies, a passage that many share, and every odd row there is."""
    rnd = random.Random(7)
    base, passage = prose(rnd, 120), "A passage of more than fifty bytes that many documents share, é日🙂, word for word."
    rows = [(i, prose(rnd, rnd.randrange(5, 150))) for i in range(60)]
    rows += [(100 + i, base) for i in range(8)]
    for i in range(25):
        words = base.split()
        for _ in range(rnd.randrange(1, 9)):
            words[rnd.randrange(len(words))] = "changed" + str(rnd.randrange(99))
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, prose(rnd, 20) + "\n" + passage + "\n" + prose(rnd, 20)) for i in range(10)]
    rows += [(400, None), (401, ""), (402, "   \n\t"), (403, "one"), (404, "two words"), (405, " x y z"), (406, "a" * 70), (407, "a" * 200), (408, "ab" * 90)]
    rows += [(500, prose(rnd, 9000)), (501, "x" * 60_000), (502, " ".join(["again"] * 3000))]
    rows += [(510, "Same Row, twice"), (510, "Same Row, twice"), (None, base), (None, None)]
    langs, sources = ("en", "de", None), ("s1", "s1", "s1", "s2", None)
    return [(i, t, langs[k % 3], sources[k % 5], len(t or "")) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns whose names the operators use inside
    clashing = ("size", "shard", "chunk", "node", "score", "bucket", "_s", "body", "kept", "hash", "copies", "root")
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).withColumns({c: F.lit("extra") for c in clashing})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards(docs, empty):
    rows = sharding.interleaved_shards(docs, 7).collect()
    assert len(rows) == len(corpus())
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert sorted(by) == list(range(7))
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    for source in ("s1", "s2", None):
        counts = [sum(r.source == source for r in v) for v in by.values()]
        assert max(counts) - min(counts) <= 2
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    key = lambda rs: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in rs)
    assert key(sharding.interleaved_shards(docs.repartition(3), 7).collect()) == key(rows)
    assert sharding.interleaved_shards(empty).count() == 0
    few = sharding.interleaved_shards(docs.limit(2), 16).collect()
    assert sorted(r.slot for r in few) == [0, 0] and len({r.shard for r in few}) == 2


@pytest.fixture(scope="module")
def codec():
    return bpe.ByteBpe(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_bpe_pieces(codec, reference):
    rnd = random.Random(1)
    alphabet = "abcdehtion AEé日🙂 \n\t\r01,.'’\x00 　_ßΩ"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(120))) for _ in range(1500)]
    texts += ["it's we'll", "a" * 5000, "  \n\n  x", "zq" * 40, "zq" * 400, "<|endoftext|>"]
    for text, (joined, ids) in zip(texts, codec.encode_batch(texts), strict=True):
        assert ids == reference(text) and joined == " ".join(map(str, ids)) and codec.decode(ids) == text.encode()
    for _ in range(300):  # one tree at a time, and side by side
        piece = "".join(rnd.choice("abcdehtionrsé") for _ in range(rnd.randrange(2, 60)))
        b = piece.encode()
        assert codec.encode_piece(b) == reference(piece)
        assert b in codec.ranks or codec.encode_short([b])[0] == codec.encode_piece(b)


def test_bpe_documents(docs, empty, reference):
    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = collections.Counter()
    for i, t, *_ in corpus():
        ids = reference(t or "")
        want[i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    assert collections.Counter(map(tuple, bpe.encode_documents(docs, *args).collect())) == want
    assert bpe.encode_documents(empty, *args).count() == 0


SECRETS = [
    'password = "hunter22"', "TOKEN: abc", "token:token:abcdefgh", "api_key='a1b2c3d4e5' and apikey=zzzzzz", "secret==abcde", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIAAKIA" + "B7" * 9,
    "f" * 23, "f" * 24, "deadbeef" * 5 + "g", "é🙂 passwd:\x20\x20= abcdef", "passwd : abcdef", "paſſword=abcdefg", "toKen=abcdefg", "Zx9Kq2Lm7Vb4Nc8Rt1Yp", "thisisjustaverylongwordindeed",
    "some/path/of/ordinary/words/only", "123e4567-e89b-12d3-a456-426614174000", "0123456789" * 3,
]


def plain_base(text):
    kinds = {
        "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    return [(m.start(), m.end(), k) for k, (p, good) in kinds.items() for m in re.finditer(p, text) if good(m)]


def test_secrets(spark, docs, empty):
    for text in SECRETS + ["\n".join(SECRETS)]:
        base, more = secret_scan.scan(text)
        assert sorted(base) == sorted(plain_base(text)), text
        assert all(0 <= a < b <= len(text) for a, b, _ in more)
    found = {t: [text for a, b, _ in secret_scan.scan(t)[1] for text in [t[a:b]]] for t in SECRETS}
    assert found["Zx9Kq2Lm7Vb4Nc8Rt1Yp"] == ["Zx9Kq2Lm7Vb4Nc8Rt1Yp"]
    for harmless in SECRETS[-4:]:
        assert found[harmless] == []
    rows = secret_scan.scan_documents(docs, with_clean=True).collect()
    assert len(rows) == len(corpus()) and all(r.clean_text is None for r in rows if r.doc_id == 400)
    df = spark.createDataFrame([(1, "\n".join(SECRETS)), (2, None)], "doc_id long, text string")
    one, two = secret_scan.scan_documents(df, with_clean=True).orderBy("doc_id").collect()
    assert (one.n_assign, one.n_access, one.n_hex) == tuple(sum(k == kind for *_, k in plain_base("\n".join(SECRETS))) for kind in ("assign", "access", "hex"))
    assert "hunter22" not in one.clean_text and "ordinary" in one.clean_text and not plain_base(one.clean_text)
    assert two.base_sha256 == hashlib.sha256(b"").hexdigest() and two.spans == ""
    assert secret_scan.scan_documents(empty).count() == 0


def plain_entropy_kind(run):
    """The kind of the first window that counts, from each window's characters anew, or None."""
    from math import log2

    usual = {x + y for x, more in secret_scan._FOLLOW.items() for y in more}
    if re.fullmatch(r"[0-9]+|(.)\1*|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", run):
        return None
    for a in range(len(run) - 19):
        w = run[a : a + 20]
        digit, lower, upper = any(map(str.isdigit, w)), any(map(str.islower, w)), any(map(str.isupper, w))
        if not lower and not upper:
            continue
        if digit:
            kind = "hex" if set(w) <= set("0123456789abcdefABCDEF") else "mixed" if lower and upper else "lower" if lower else "upper"
        else:
            kind = "case" if lower and upper else "letters"
        h = -sum(c / 20 * log2(c / 20) for c in collections.Counter(w).values())
        pairs = [x + y for x, y in zip(w, w[1:], strict=False)]
        letters = [p for p in pairs if p.isalpha()]
        known = sum(p.lower() in usual for p in letters)
        turns = sum(p[0].isdigit() and p[1].isalpha() or p[0].isalpha() and p[1].isdigit() for p in pairs)
        if h < secret_scan.THRESHOLD["entropy_" + kind] - 1e-9:
            continue
        if not digit and (len(letters) < 8 or known > 0.7 * len(letters)):
            continue
        if kind in ("mixed", "lower", "upper") and h < 3.8 and turns <= 3 and len(letters) >= 5 and known >= 0.75 * len(letters):
            continue
        return "entropy_" + kind
    return None


def test_incremental_entropy_equals_the_plain_one():
    rnd = random.Random(3)
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = (low + digits, up + digits, low + up + digits + "+/=_-", "0123456789abcdef", low, up, low + up, "abc123", "ab", digits, "0123456789ABCDEFabcdef-")
    kinds = collections.Counter()
    for alphabet in alphabets:
        for _ in range(150):
            run = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(20, 60)))
            if rnd.random() < 0.5:  # words with a random stretch in them
                run = "".join(rnd.choice(WORDS) for _ in range(8)) + run[: rnd.randrange(1, 30)] + "".join(rnd.choice(WORDS) for _ in range(4))
            want = plain_entropy_kind(run)
            assert secret_scan.entropy_spans(run) == ([(want, 0, len(run))] if want else []), run
            kinds[want] += 1
    assert len(kinds) >= 6 and kinds[None] > 100


def test_random_strings_of_every_alphabet_are_found_whole():
    rnd = random.Random(9)
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    for alphabet in (low + digits, up + digits, up + "234567", low + up + digits, low + up + digits + "+/", "0123456789abcdef", "0123456789ABCDEF", low, up, low + up):
        for length in (20, 24, 32, 40, 64):
            runs = ["".join(rnd.choice(alphabet) for _ in range(length)) for _ in range(200)]
            found = [secret_scan.entropy_spans(run) for run in runs]
            assert all([(0, length)] == [(a, b) for _, a, b in f] for f in found if f)
            assert sum(map(bool, found)) >= 194, (alphabet, length)
    text = "key " + "".join(rnd.choice(low + digits) for _ in range(32)) + " end"
    base, more = secret_scan.scan(text)
    assert secret_scan.redact(text, base + more) == "key [SECRET] end"
    for words in ("internationalizationconfiguration", "Donaudampfschifffahrtsgesellschaft", "getUserAccountSettingsFromRequest", "docs/reports/monthly-summary-2024", "anticonstitutionnellement", "MAXIMUM_CONNECTION_TIMEOUT"):
        assert secret_scan.entropy_spans(words) == [], words


def plain_removal(rows, length=50):
    holders = collections.defaultdict(set)
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - length + 1):
                holders[b[p : p + length]].add(i)
    out = collections.Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        if i is not None:
            for p in range(len(b) - length + 1):
                if min(holders[b[p : p + length]]) < i:
                    gone[p] += 1
                    gone[p + length] -= 1
        mask = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~mask])
        spans = int((mask[1:] & ~mask[:-1]).sum()) + int(len(b) > 0 and mask[0])
        out[i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats(spark, docs, empty):
    rows = [(i, t) for i, t, *_ in corpus()]
    want = plain_removal(rows)
    assert collections.Counter(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == want
    assert sum(r[2] for r in want) > 10_000
    assert suffix_dedup.remove_repeats(empty).count() == 0
    rnd = random.Random(5)  # few letters: very many repeats, and a shorter threshold
    rows = [(i // 2, "".join(rnd.choice("ab") for _ in range(rnd.randrange(60)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collections.Counter(map(tuple, suffix_dedup.remove_repeats(df, 9).collect())) == plain_removal(rows, 9)


def test_repeats_by_ranks(spark, docs, empty):
    rows = [(i, t) for i, t, *_ in corpus()]
    assert collections.Counter(map(tuple, prefix_ranks.remove_repeats(docs).collect())) == plain_removal(rows)
    assert prefix_ranks.remove_repeats(empty).count() == 0
    rnd = random.Random(5)
    rows = [(i // 2, "".join(rnd.choice("ab") for _ in range(rnd.randrange(60)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collections.Counter(map(tuple, prefix_ranks.remove_repeats(df, 9).collect())) == plain_removal(rows, 9)


def test_repeats_over_chunks_and_segments(monkeypatch):
    """The rounds by hand, with small chunks, and a text longer than a segment."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    rnd = random.Random(8)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(5000))
    rows = [(9, long), (3, long[100:2300]), (5, "zz" + long[1500:1600]), (7, long[:60] + "q" + long[61:]), (1, long[4000:4060])]
    chunks = [rows[:2], rows[2:4], rows[4:]]
    table = lambda k, c: pa.table({"doc_id": [r[0] for r in c], "body": [r[1].encode() for r in c], "chunk": [k] * len(c)})
    made = [suffix_dedup.Chunk(table(k, c), 50, 4) for k, c in enumerate(chunks)]
    for ask, decides, learn in suffix_dedup.ROUNDS:
        asked = [ask(c) for c in made]
        by_bucket = collections.defaultdict(list)
        for c, a in zip(made, asked, strict=True):
            for row in a.rows(c.number, decides):
                by_bucket[row[0]].append(row)
        told = collections.defaultdict(list)
        for group in by_bucket.values():
            out = suffix_dedup.answer(decides)(suffix_dedup._table(group))
            for b, c, p in zip(*(out.column(n).to_pylist() for n in ("bucket", "chunk", "payload")), strict=True):
                told[c].append((b, p))
        answers = [a.answers(sorted(told[c.number]), decides) for c, a in zip(made, asked, strict=True)]
        if learn:
            for c, a in zip(made, answers, strict=True):
                learn(c, a)
                other = suffix_dedup.Chunk.__new__(suffix_dedup.Chunk)
                other.count = c.count
                other.recall(next(iter([r[3] for r in c.state()])))
                assert (other.done == c.done).all() and (other.left == c.left).all() and (other.right == c.right).all()
    got = collections.Counter()
    for c, a in zip(made, answers, strict=True):
        gone = c.covered(a)
        for i, t, first in zip(c.ids, c.texts, c.firsts.tolist(), strict=True):
            g = gone[first : first + len(t)]
            kept = bytes(np.frombuffer(t, np.uint8)[~g])
            got[i, len(t), len(t) - len(kept), int((g[1:] & ~g[:-1]).sum()) + int(g[0]), hashlib.sha256(kept).hexdigest()] += 1
    assert got == plain_removal(rows)


def test_top_k(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.normal(0, 10 ** rnd.uniform(-1, 1.5), 6)]) for i in range(400)]
    rows += [(400 + i, rows[40][1]) for i in range(60)] + [(500, [0.0] * 6), (501, [1.0, float("nan"), 0.0]), (502, None), (503, [1.0, None, 0.0]), (520, [1.0, float("inf"), 0.0]), (None, rows[0][1]), (540, [1.0, 2.0]), (541, [3.0, 4.0]), (560, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("extra")).repartition(4)
    good = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, v in good:
        if q % 20 == 0:
            s = sorted((-int((v * w).sum()), n) for n, w in good if n != q and len(w) == len(v))[:20]
            want += [(q, k + 1, n, -score) for k, (score, n) in enumerate(s)]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_only_rings_that_matter_are_sent(spark, monkeypatch):
    """With lengths that differ, most pairs of slab and block are never made; results equal brute force."""
    monkeypatch.setattr(topk, "SLAB", 16)
    monkeypatch.setattr(topk, "RING_BYTES", 16 * 6 * 8)
    monkeypatch.setattr(topk, "BLOCK", 4)
    sent = {}
    original = topk.slabs_sent

    def counted(slabs, reach):
        out = original(slabs, reach)
        sent.update(slabs=slabs.count(), blocks=reach.agg(F.sum("parts")).first()[0], copies=out.count())
        return out

    monkeypatch.setattr(topk, "slabs_sent", counted)
    rnd = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rnd.normal(0, 1, 6) * 2 ** rnd.uniform(-3, 4)]) for i in range(1200)]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), k=5).collect()))
    good = [(i, np.floor(64 * np.array(v)).astype(np.int64)) for i, v in rows]
    want = []
    for q, v in good:
        if q % 20 == 0:
            s = sorted((-int((v * w).sum()), n) for n, w in good if n != q)[:5]
            want += [(q, k + 1, n, -score) for k, (score, n) in enumerate(s)]
    assert got == sorted(want)
    assert sent["blocks"] >= 10 and sent["slabs"] >= 60 and sent["copies"] < 0.5 * sent["blocks"] * sent["slabs"]


def test_vectors_travel_in_narrow_integers():
    for most, width in ((100, 1), (1000, 2), (100_000, 4), (1 << 40, 8)):
        v = np.array([[most, -most], [0, 1]], np.int64)
        body = topk.packed(v)
        ids, back = topk.unpacked(np.array([5, 6]).tobytes(), body, 2)
        assert len(body) == 1 + 4 * width and (back == v).all() and ids.tolist() == [5, 6]
    assert topk.unpacked(b"", topk.packed(np.zeros((0, 3), np.int64)), 3)[1].shape == (0, 3)


def test_pruning_loses_nothing():
    rnd = np.random.default_rng(4)
    kinds = collections.Counter()
    for _ in range(60):
        v = np.floor(rnd.normal(0, 20, (300, 5))).astype(np.int64)
        slab = topk.Slab(np.arange(300), v)
        q = np.floor(rnd.normal(0, 20, 5)).astype(np.int64)
        s = slab.products(slice(None), q)
        size = float(np.sqrt((q.astype(float) ** 2).sum()))
        for least in (int(s.max()), int(np.sort(s)[-20]), int(np.median(s)), int(s.max() * 3)):
            rows = slab.candidates(q / size, size, least)
            kinds[type(rows)] += 1
            left = set(slab.ids[rows].tolist())
            assert set(slab.ids[s >= least].tolist()) <= left
    assert len(kinds) == 2


def test_language(spark, empty):
    rnd = random.Random(6)
    sounds = {"aa": ["ba", "lo", "mi"], "bb": ["sch", "ung", "ver"], "cc": ["que", "ç", "é"]}
    word = lambda k: "".join(rnd.choice(sounds[k]) for _ in range(3))
    rows = [(i, " ".join(word(k) for _ in range(rnd.randrange(10, 200))), k) for i, k in enumerate(list(sounds) * 60)]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 34 ...", "bb"), (903, "é" * 70_000, "cc"), (904, "baloba", None), (904, "baloba", None), (None, "lomi balo", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    net = langid.train(df, epochs=10)
    out = langid.identify(df, net).collect()
    assert len(out) == len(rows) and net.langs == ["aa", "bb", "cc"]
    truth = {i: k for i, _, k in rows if i is not None and i < 900}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id or "").encode()) % 4 == 2) for r in out)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out) and {r.lang_pred for r in out if r.doc_id in (900, 901, 902)} == {"und"}
    assert {r.doc_id for r in langid.keep_identified(df, net).collect()}.isdisjoint({900, 901, 902})
    none = langid.train(empty)
    assert langid.identify(empty, none).count() == 0 and langid.identify(df, none).first().lang_pred == "und"


def test_every_label_is_learned(spark):
    rows = [(i, f"label {i % 230} text", f"l{i % 230}") for i in range(920)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = {k for i, _, k in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(taught) > 200 and set(langid.train(df, epochs=1).langs) == taught


def test_network_equals_plain_loops():
    rng = np.random.default_rng(1)
    net = langid.ByteConvNet.fresh(["a", "b"], rng)
    net.bias[:] = rng.normal(0, 0.2, len(net.bias))
    windows = rng.integers(0, 256, (3, 24)).astype(np.uint8)
    for window, got in zip(windows, net.probabilities(windows), strict=True):
        x = [net.embed[c] for c in window] + [np.zeros(langid.EMBED)] * (max(langid.WIDTHS) - 1)
        pooled = []
        for f in range(net.filters.shape[1]):
            width = langid.WIDTHS[f // langid.FILTERS]
            sums = [sum(float(x[at + k] @ net.filters[k * langid.EMBED : (k + 1) * langid.EMBED, f]) for k in range(width)) for at in range(len(window))]
            pooled.append(max(max(sums) + net.bias[f], 0.0))
        z = np.array(pooled) @ net.dense + net.dense_bias
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(got, want, atol=1e-9)


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = langid.ByteConvNet.fresh(["a", "b", "c"], rng)
    x, y = rng.integers(1, 256, (4, 32)).astype(np.uint8), np.array([0, 1, 2, 1])
    loss = lambda: -np.log(net.probabilities(x)[np.arange(4), y]).mean()
    grads = net.gradients(x, y)
    for p, g in zip(net.params(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[at] += 1e-6
        up = loss()
        p[at] -= 2e-6
        assert abs((up - loss()) / 2e-6 - g[at]) < 1e-4
        p[at] += 1e-6


def test_toxicity(spark, empty):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = prose(rnd, rnd.randrange(20, 120)).split()
        if bad:
            words[rnd.randrange(len(words))] = rnd.choice(("vile", "nasty", "awful", "horrid"))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, ""), (902, "vile " * 20_000), (903, "vile"), (903, "vile"), (None, "nasty")]
    labels += [(None, 1, 1), (3, 1, None), (950, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    index = toxicity.fit(docs, marks)
    assert set(index.idf) >= {"vile", "nasty", "awful", "horrid"}
    out = toxicity.score_documents(docs, index).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and all(r.predicted == (r.doc_id % 5 == 0) for r in held)
    by = {r.doc_id: r for r in out}
    assert by[902].predicted and by[903].predicted and not by[900].predicted and not by[901].predicted
    nothing = toxicity.fit(empty.select("doc_id", "text"), marks)
    assert toxicity.score_documents(docs, nothing).agg(F.max("score")).first()[0] == 0
    assert toxicity.score_documents(empty, index).count() == 0


def test_nearest_are_exact():
    rng = np.random.default_rng(1)
    idf = {f"t{k}": float(1 + k % 7) for k in range(40)}
    some = lambda: {f"t{k}": int(rng.integers(1, 4)) for k in rng.choice(40, rng.integers(1, 6), False)}
    examples = [(i, int(i % 3 == 0), some()) for i in range(700)]
    index = toxicity.BlockMaxIndex.build(idf, examples, (1.0, 1.0))
    tfs = {i: tf for i, _, tf in examples}
    for _ in range(80):
        q = index._unit(some(), idf)
        cosines = sorted((sum(w * index._unit(tfs[i], idf).get(t, 0) for t, w in q.items()) for i in tfs), reverse=True)
        want = [c for c in cosines if c > 0][: toxicity.NEAREST]
        assert np.allclose([c for c, _ in index.nearest(q)], want)


def test_every_term_and_example_is_compared(spark):
    """A copy of an example is found though it has no word that tells the labels apart, and so is what is like it in part."""
    rnd = random.Random(4)
    rows = [(i, prose(rnd, 30)) for i in range(300)]
    marks = [(i, 1, int(i % 7 == 0)) for i in range(300)]
    fit_ids = [i for i, _, k in marks if k and zlib.crc32(str(i).encode()) % 4 != 2]
    new = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 4 == 2][: len(fit_ids)]
    rows += [(n, rows[i][1]) for n, i in zip(new, fit_ids, strict=False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    taught = [i for i, _, _ in marks if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(index.ids) == taught and set(index.idf) == {t for i in taught for t in toxicity.terms(rows[i][1])}
    by = {r.doc_id: r for r in toxicity.score_documents(docs, index).collect()}
    for n, i in zip(new, fit_ids, strict=False):
        assert by[n].evidence.startswith(f"{i}:1:1.000,") and by[n].predicted
    assert all(r.evidence.count(",") == 4 for r in by.values())


def test_nearest_are_exact_among_rare_and_common_terms():
    rng = np.random.default_rng(5)
    idf = {f"t{k}": float(rng.uniform(0.2, 6)) for k in range(3000)}
    some = lambda: {f"t{k}": int(rng.integers(1, 4)) for k in np.minimum(rng.zipf(1.3, 40), 2999)}
    examples = [(i, i % 2, some()) for i in range(900)]
    index = toxicity.BlockMaxIndex.build(idf, examples, (1.0, 1.0))
    units = {i: index._unit(tf, idf) for i, _, tf in examples}
    for _ in range(60):
        q = index._unit(some(), idf)
        cosines = {i: sum(w * units[i].get(t, 0) for t, w in q.items()) for i in units}
        near = index.nearest(q)
        assert np.allclose([c for c, _ in near], sorted(cosines.values(), reverse=True)[: toxicity.NEAREST], rtol=1e-12)
        assert np.allclose([cosines[index.ids[n]] for _, n in near], [c for c, _ in near], rtol=1e-12)


def test_scores_equal_a_plain_vote():
    """Term weights, cosines, ties and votes, by loops over dictionaries."""
    rnd = random.Random(8)
    texts = [prose(rnd, rnd.randrange(3, 40)) for _ in range(150)]
    examples = [(1000 - i, int(i % 4 == 0), t) for i, t in enumerate(texts + texts[:20])]  # copies: equal cosines
    df = collections.Counter(t for _, _, x in examples for t in set(toxicity.terms(x)))
    idf = {t: float(np.log(400 / (1 + n)) + 1e-6) for t, n in sorted(df.items())}
    thinned, unseen = (2.0, 0.5), 5.5
    index = toxicity.BlockMaxIndex.build(idf, [(i, k, collections.Counter(toxicity.terms(x))) for i, k, x in examples], thinned, unseen)

    def unit(x):
        raw = {t: (1 + np.log(n)) * idf.get(t, unseen) for t, n in collections.Counter(toxicity.terms(x)).items()}
        size = sum(w * w for w in raw.values()) ** 0.5
        return {t: w / size for t, w in raw.items()}

    units = [(i, k, unit(x)) for i, k, x in examples]
    weights = [thinned[k] for _, k, _ in examples]
    prior = sum(w for (_, k, _), w in zip(examples, weights, strict=True) if k) / sum(weights)
    queries = [prose(rnd, 25) + rnd.choice(("", " unheard unheardof unheardofs word")) for _ in range(60)] + texts[:10] + ["zzzz qqqq", "words1 " * 300]
    for q in queries:
        u = unit(q)
        near = sorted((-round(sum(w * v.get(t, 0) for t, w in u.items()), 12), i, k) for i, k, v in units)
        near = [(-c, i, k) for c, i, k in near if c < 0][: toxicity.NEAREST]
        closeness = [1 / (1.05 - min(c, 1.0)) for c, *_ in near]
        vote = [len(near) * w / sum(closeness) * thinned[k] / max(thinned) for w, (_, _, k) in zip(closeness, near, strict=True)]
        want = (prior * 0.1 + sum(v for v, (_, _, k) in zip(vote, near, strict=True) if k)) / (0.1 + sum(vote))
        score, evidence = index.score(q)
        assert abs(score - want) < 1e-9 and evidence == ",".join(f"{i}:{k}:{c:.3f}" for c, i, k in near[:5])


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    inside = set()
    for i in range(len(words) - 2):
        if windows[words[i], words[i + 1], words[i + 2]] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(inside)


def test_quality(spark, docs, empty):
    rnd = random.Random(3)
    texts = ["\n".join(" ".join(rnd.choice("a b c #   \x1c é".split(" ")) for _ in range(rnd.randrange(9))) for _ in range(rnd.randrange(9))) for _ in range(300)]
    for t in texts + ["a b c a b c", "a b c b c a b c", "", " \n\x0b", "x\ny\nx\n\nx "]:
        assert quality.measure(t) == plain_quality(t), t
    rows = quality.judge(docs).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert all(r.kept for r in rows if r.doc_id is not None and r.doc_id < 60 and r.n_words >= 50)
    ledger = quality.ledger(docs)
    for policy in quality.POLICIES:
        got = {r.rule: (r.n_failed, r.n_only, r.n_together) for r in quality.ablations(ledger, policy).collect()}
        masks = [r.failed & quality.POLICIES[policy] for r in ledger.collect()]
        bits = {rule: bit for rule, bit in quality.BIT.items() if bit & quality.POLICIES[policy]}
        assert set(got) == set(bits)
        for rule, bit in bits.items():
            assert got[rule] == (sum(bool(m & bit) for m in masks), sum(m == bit for m in masks), sum(bool(m & bit) and m != bit for m in masks))
    alone = {r.rule: r.n_only for r in quality.ablations(ledger).collect()}
    assert {rule: sum(r.ablated == bit for r in rows) for rule, bit in quality.BIT.items()} == alone
    odd = spark.createDataFrame([(1, "a b " * 40), (2, "\n".join(["word"] * 30 + ["other more"] * 20)), (3, "x" * 3000 + " y" * 60)], "doc_id long, text string")
    marks = {r.doc_id: r.failed for r in quality.ledger(odd).collect()}
    assert marks[1] & quality.BIT["short_words"] and marks[2] & quality.BIT["many_lines"] and marks[3] & quality.BIT["long_words"]
    assert quality.judge(empty).count() == 0


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        t = {s: 3 * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if t[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return t
        full |= over


def test_mixing(spark, docs, empty):
    rnd = random.Random(1)
    rows = [(i, prose(rnd, rnd.randrange(1, 80)), rnd.choice(["big"] * 8 + ["a", "c", "Ω", None])) for i in range(1500)] + [(2000, None, "void"), (2001, " ", "void")] + [(2002, "same text", "c")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("size", "target", "_leaf")}).repartition(4)
    out = mixing.mix(df).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    want, source = plain_targets(sizes), {i: s for i, _, s in rows}
    assert len(out) == len(rows)
    taken = collections.Counter()
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        assert abs(r.copies - (r.target / r.source_size if r.source_size else 0)) < 1
        taken[s] += r.taken
    largest = {s: max(len((t or "").split()) for _, t, x in rows if x == s) for s in sizes}
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5 * largest[s], (s, taken[s], t)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs).count() == len(corpus())


def test_pivots_keep_words_and_expectations():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        size, p = np.sort(rng.integers(1, 500, n))[::-1].astype(float), rng.random(n)
        extra, left = mixing.pivot(size, p, rng.random(n))
        assert (left > 0).sum() <= 1 and set(extra.tolist()) <= {0, 1} and abs(size @ (extra + left) - size @ p) < 1e-4
        left, extra = p.copy(), np.zeros(n, np.int64)
        mixing.against_the_rest(size, left, extra, rng.random(min(9, n - 1)))
        assert abs(size @ (extra + left) - size @ p) < 1e-4 and left.min() > -1e-9 and left.max() < 1 + 1e-9
    size, p = np.array([90.0, 50, 20, 9, 8, 7, 3, 1, 1]), np.array([0.3, 0.7, 0.3, 0.5, 0.3, 0.9, 0.3, 0.2, 0.3])
    total = np.zeros(len(size))
    for _ in range(4000):
        left, extra = p.copy(), np.zeros(len(size), np.int64)
        mixing.against_the_rest(size, left, extra, rng.random(3))
        more, left = mixing.pivot(size, left, rng.random(len(size)))
        total += extra + more + left
    assert np.abs(total / 4000 - p).max() < 0.04


def test_a_source_of_one_giant_is_rounded_to_the_nearer_side(spark):
    """What a source misses its target by is at most half of its largest document: of one document, no other rounding is nearer."""
    df = spark.createDataFrame([(1, "w " * 1000, "a")] + [(2 + i, "w " * 10, "b") for i in range(300)], "doc_id long, text string, source string")
    for r in mixing.mix(df).where("doc_id = 1").collect():
        assert abs(r.taken - r.target) <= 500 and r.copies in (2, 3)
    many = mixing.mix(df).where("doc_id > 1").groupBy("target").agg(F.sum("taken").alias("taken")).first()
    assert abs(many.taken - many.target) <= 5


def test_the_tree_has_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 8)
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randrange(1, 60), rnd.choice("aaab")) for i in range(1200)] + [(None, "same", "a")] * 70
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = mixing.mix(df)
    per = out.join(df.select("doc_id", "source").distinct(), "doc_id").groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("w"), F.max("size").alias("m")).collect()
    assert out.count() == len(rows) and all(abs(r.w - r.t) <= r.m + 70 * 3 for r in per)
    assert sorted(map(str, mixing.mix(df.repartition(3)).collect())) == sorted(map(str, out.collect()))


def test_components(spark):
    rnd = random.Random(0)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)] + [(2000, 2001 + i) for i in range(50)]
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: r for x, r in root.items() if x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_components(rows, width=3, percent=85):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for b in range(a):
            j, t = sets[b]
            if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                parent[find(a)] = find(b)
    lowest = {}
    for a, (i, s) in enumerate(sets):
        if i is not None:
            lowest[find(a)] = min(i, lowest.get(find(a), i))
    return collections.Counter((i, len(s), lowest.get(find(a)), i is None or lowest[find(a)] == i) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize("part", [512, 4])
def test_near_duplicates(docs, empty, monkeypatch, part):
    monkeypatch.setattr(minhash, "SLICE", part)  # 4: clusters are cut in slices, and what the hub doesn't reach meets the others
    got = minhash.near_duplicates(docs).collect()
    assert collections.Counter(map(tuple, got)) == plain_components([(i, t) for i, t, *_ in corpus()])
    if part == 512:
        assert minhash.near_duplicates(empty).count() == 0
        left = minhash.keep_one(docs).collect()
        gone = {i for i, *_ in corpus()} - {r.doc_id for r in left}
        assert set(range(101, 108)) <= gone and gone <= set(range(101, 225)) and "extra" in set(left[0])


def test_a_hub_without_an_id(spark, monkeypatch):
    """The most-met node of a group cut into slices has rows without an id only: the others still are one component."""
    monkeypatch.setattr(minhash, "SLICE", 8)
    words = prose(random.Random(12), 400).split()
    near = [" ".join(words[:k] + [f"other{k}"] + words[k + 1 :]) for k in range(5, 395, 8)]
    for start in range(2):  # whichever node is the hub, in one of the two it has no id
        rows = [(k if k % 2 == start else None, t) for k, t in enumerate(near)] + [(None, " ".join(words))]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = minhash.near_duplicates(df, percent=85).collect()
        assert {r.component_id for r in got if r.doc_id is not None} == {start} and sum(r.doc_id is not None for r in got) == sum(i is not None for i, _ in rows)
        assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)


def test_min_max_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    one, two = np.unique(a[:3000]), np.unique(a[1000:])
    s = minhash.signatures(np.concatenate([one, two]), np.array([0, len(one)]), 400)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.06


def test_held_out_fold(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    assert {r.doc_id for r in df.where(common.held_out(F.col("doc_id"))).collect()} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_names_that_are_free():
    assert common.free_name(["a", "_Gone", "_gone_"], "_gone") == "_gone__" and common.free_name([], "_x") == "_x"
