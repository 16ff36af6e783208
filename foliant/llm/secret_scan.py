"""Secrets in texts: three fixed patterns, and windows of high Shannon entropy in candidate strings.

A candidate is a run of 20 or more characters of the base-64 alphabet. A window of WINDOW characters slides
over it; the counts of the characters in the window are kept up to date as it moves, and with them the sum of
c log2 c, so that the entropy of each window costs two updates. A window has the class of the characters that
are in it, and each class a threshold under what a window of random characters of the class has. Words reach
these thresholds too: windows of letters alone count only if many of their pairs of letters are none that
words are made of, and windows under WORDLIKE bits don't count if they look like words with numbers. A candidate
with a window that counts is a span as a whole. Candidates that the allow-list knows as harmless are none; the
spans of the fixed patterns are never suppressed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed", "entropy_lower", "entropy_upper", "entropy_letters", "entropy_case")

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of 20 characters or more; a shorter one holds no longer one
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones need not be matched to be dropped
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: The same for RE2, which passes over most texts: whatever one of the patterns above finds, this one finds.
ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[A-Za-z0-9+/_=-]{20}"""

WINDOW = 20
#: Bits a character. Of 20000 random windows of an alphabet a thousandth has less than: hex digits 2.71; base 64 3.48; base 36 3.20
#: and base 32 3.15 (one case with digits); letters of one case 3.04, of both 3.40.
THRESHOLD = {"entropy_hex": 2.7, "entropy_mixed": 3.45, "entropy_lower": 3.1, "entropy_upper": 3.1, "entropy_letters": 3.0, "entropy_case": 3.35}
WORDLIKE = 3.8
ALLOWED = (
    re.compile(r"[0-9]+"),  # a long number
    re.compile(r"(.)\1*"),  # a rule of one character
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # a UUID
)
_HEX = frozenset("0123456789abcdefABCDEF")
#: Pairs of letters that words are made of: for each letter those that often follow it, in English, German, French or Spanish.
_FOLLOW = {
    "a": "bcdgilmnprstuvy", "b": "aeiloru", "c": "aehiklortu", "d": "aeiorsu", "e": "abcdeghilmnprstuvxz", "f": "aefilortu", "g": "aehilnorstu",
    "h": "aeilmnortu", "i": "abcdefgklmnorstv", "j": "aeou", "k": "eilnot", "l": "adeilostuy", "m": "abeimopu", "n": "acdegiknostu", "o": "bcdflmnoprstuvw",
    "p": "aefhiloprtu", "q": "u", "r": "abcdeghiklmnorstuvy", "s": "acehiopstu", "t": "aehilorstuwyz", "u": "abcdefgilmnprst", "v": "aeio", "w": "aehior",
    "x": "aipt", "z": "etu",
}
_USUAL = frozenset(a + b for a, more in _FOLLOW.items() for b in more)
_CLOGC = [0.0] + [c * log2(c) for c in range(1, WINDOW + 1)]


def entropy_spans(run: str) -> list[tuple[str, int, int]]:
    """[(kind, start, end)] of a candidate string, all of it, if one of its windows counts as random; kind is the first such window's."""
    if any(p.fullmatch(run) for p in ALLOWED):
        return []
    counts: dict[str, int] = {}
    total = 0.0  # sum of c log2 c
    n = dict.fromkeys(("digit", "lower", "upper", "alien", "pair", "usual", "turn"), 0)  # in the window; alien: no hex digit; turn: a digit beside a letter

    def move(at: int, by: int) -> None:
        c = run[at]
        n["digit"] += by * c.isdigit()
        n["lower"] += by * c.islower()
        n["upper"] += by * c.isupper()
        n["alien"] += by * (c not in _HEX)

    def move_pair(at: int, by: int) -> None:
        a, b = run[at], run[at + 1]
        if a.isalpha() and b.isalpha():
            n["pair"] += by
            n["usual"] += by * ((a + b).lower() in _USUAL)
        n["turn"] += by * (a.isdigit() and b.isalpha() or a.isalpha() and b.isdigit())

    for at, c in enumerate(run):
        k = counts.get(c, 0)
        total += _CLOGC[k + 1] - _CLOGC[k]
        counts[c] = k + 1
        move(at, 1)
        if at:
            move_pair(at - 1, 1)
        first = at - WINDOW + 1
        if first > 0:
            c = run[first - 1]
            k = counts[c]
            total += _CLOGC[k - 1] - _CLOGC[k]
            counts[c] = k - 1
            move(first - 1, -1)
            move_pair(first - 1, -1)
        letters = n["lower"] + n["upper"]
        if first < 0 or not letters:
            continue
        if n["digit"]:
            kind = "entropy_hex" if not n["alien"] else "entropy_mixed" if n["lower"] and n["upper"] else "entropy_lower" if n["lower"] else "entropy_upper"
        else:
            kind = "entropy_case" if n["lower"] and n["upper"] else "entropy_letters"
        entropy = log2(WINDOW) - total / WINDOW
        if entropy < THRESHOLD[kind] - 1e-12:
            continue
        if not n["digit"] and (n["pair"] < 8 or n["usual"] > 0.7 * n["pair"]):
            continue
        if kind in ("entropy_mixed", "entropy_lower", "entropy_upper") and entropy < WORDLIKE and n["turn"] <= 3 and n["pair"] >= 5 and n["usual"] >= 0.75 * n["pair"]:
            continue
        return [(kind, 0, len(run))]
    return []


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(start, end, kind) of the fixed patterns' spans and of the entropy spans, in code points."""
    base = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    more = [(m.start() + a, m.start() + b, kind) for m in CANDIDATE.finditer(text) for kind, a, b in entropy_spans(m[0])]
    return base, more


def told(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as listed."""
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by one mark."""
    out, at, until = [], 0, -1
    for a, b, _ in sorted(spans):
        if a >= until:
            out += [text[at:a], mark] if a >= at else []
        at = until = max(until, b)
    return "".join(out) + text[at:] if out else text


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_clean: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (and clean_text, with the spans replaced) of each row.

    One pass without a shuffle. A null text counts as empty and has no spans (its clean text stays null);
    repeated rows are scanned each; further columns are not read; an empty table gives no rows.
    """
    ddl = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", clean_text string" * with_clean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch, "text"):
                here = batch.column("text").slice(first, len(texts))
                some = pc.fill_null(pc.match_substring_regex(here, ANY), False).to_pylist()
                found = [scan(t) if s else ([], []) for t, s in zip(texts, some, strict=True)]
                counts = [[sum(k == kind for _, _, k in base) for base, _ in found] for kind in KINDS[:3]]
                columns = [batch.column("doc_id").slice(first, len(texts)), *(pa.array(c, pa.int64()) for c in counts)]
                columns.append(pa.array([hashlib.sha256(told(base).encode()).hexdigest() for base, _ in found]))
                columns.append(pa.array([told(base + more) for base, more in found], pa.string()))
                if with_clean:
                    columns.append(pa.array([t if not b + m else redact(t, b + m) for t, (b, m) in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"] + ["clean_text"] * with_clean)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, ddl)


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of docs, with all their columns, their secrets replaced, and their lengths too if they have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch, text_col):
                part = batch.slice(first, len(texts))
                some = pc.fill_null(pc.match_substring_regex(part.column(text_col), ANY), False).to_pylist()
                for i, hit in enumerate(some):
                    if hit:
                        base, more = scan(texts[i])
                        texts[i] = redact(texts[i], base + more)
                at = part.schema.get_field_index(text_col)
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out
