"""The pipeline's stages on a small corpus, each against a plainer form of it."""

import base64
import collections
import hashlib
import random

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from foliant.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd, k):
    sounds = {"aa": ["ba", "lo", "mi", "te"], "bb": ["sch", "ung", "ver", "ein"]}[k]
    return " ".join("".join(rnd.choice(sounds) for _ in range(rnd.randrange(2, 5))) for _ in range(rnd.randrange(30, 90)))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    rows = [(i, prose(rnd, k), k, rnd.choice(("s1", "s2", "s3", None))) for i, k in enumerate(["aa", "bb"] * 60)]
    rows += [(200 + i, rows[3][1] + (" more" if i % 2 else ""), "bb", "s1") for i in range(6)]
    rows += [(300, rows[8][1] + " password=hunter22", "aa", "s2"), (301, "123 456", "aa", "s1"), (302, None, None, None), (303, "", "bb", "s2"), (304, prose(rnd, "aa") + " token: abcdef12", "aa", "s1")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).repartition(3)


def test_stages(spark, docs, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "secrets", "mixing", "encoding"]
    kept, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, "").write.parquet(str(tmp_path / name))
        at = kept[name] = spark.read.parquet(str(tmp_path / name))
        if name != "encoding":
            assert at.columns == docs.columns
    ids = {n: collections.Counter(r.doc_id for r in df.select("doc_id").collect()) for n, df in kept.items()}
    assert set(r.doc_id for r in docs.collect()) - set(ids["language"]) == {301, 302, 303}
    assert set(ids["language"]) - set(ids["near_duplicates"]) == {*range(200, 206), 300}
    assert ids["secrets"] == ids["near_duplicates"]
    r = kept["secrets"].where("doc_id = 304").first()
    assert r.text.endswith("[SECRET]") and r.n_chars == len(r.text)
    before = {r.doc_id: r.text for r in kept["secrets"].collect()}
    assert set(ids["mixing"]) <= set(before) and max(ids["mixing"].values()) <= 3
    words = collections.Counter()
    for r in kept["mixing"].collect():
        assert r.text == before[r.doc_id]
        words[r.source] += len(r.text.split())
    total = sum(len(t.split()) for t in before.values())
    assert abs(sum(words.values()) - total) <= 0.1 * total
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    for r in kept["encoding"].collect():
        text = before[r.doc_id]
        assert r.ids == encode(text) and r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert ids["encoding"] == ids["mixing"]


def test_least_score_follows_the_number_of_labels():
    assert [corpus_pipeline.least_score(n) for n in (0, 1, 2, 4)] == [0.35] * 4
    assert all(1 / n < corpus_pipeline.least_score(n) < 1.5 / n for n in (5, 50, 500))


def test_run_and_empty(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 60
    empty, again = spark.createDataFrame([], SCHEMA), tmp_path / "none"
    empty.write.parquet(str(again / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(again)).count() == 0
    assert langid.train(empty).langs == []


def test_repeated_rows_are_mixed_each(spark):
    rows = [(1, "some words here", "aa", "s", 15)] * 3 + [(1, "other words", "aa", "s", 11), (None, "no id at all", "aa", "s", 12)] * 2
    out = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(map(str, out)) == sorted(map(str, spark.createDataFrame(rows, SCHEMA).collect()))  # one source: each once


def test_mixing_keeps_rows_whatever_their_columns(spark):
    """Columns with the names that the mixing uses, a map, and rows alike but for one column."""
    rows = [(1 + i % 40, f"some words number {i % 40}", "aa", "s" if i % 3 else None, 0, {"k": i}, "mine", i, "x", -i) for i in range(160)] + [(None, None, None, None, 0, None, "mine", 7, "x", 0)] * 5
    schema = SCHEMA + ", extra map<string, int>, _row string, _id int, _words string, _copies int"
    df = spark.createDataFrame(rows, schema).repartition(4)
    out = corpus_pipeline.mix_sources(spark, df, "")
    assert out.columns == df.columns
    got = collections.Counter(str(r) for r in out.collect())
    before = collections.Counter(str(r) for r in df.collect())
    assert set(got) <= set(before) and max(got[k] / before[k] for k in got) <= 3
    again = corpus_pipeline.mix_sources(spark, df.repartition(2), "")
    assert collections.Counter(str(r) for r in again.collect()) == got


def test_near_duplicates_beside_clashing_columns(spark):
    rows = [(i, "one two three four five six seven" + (" eight" if i == 3 else ""), "aa", "s", 0, "mine", "node") for i in range(4)] + [(None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", _gone string, kept string")
    left = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert {r.doc_id for r in left} == {0, 3, None} and all(r._gone == "mine" for r in left if r.doc_id is not None)
