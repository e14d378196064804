"""Stored segment trees under edits against full encodings."""

import random

import pytest

from textscreen.llm import bpe, counts, queries as registered
from textscreen.session import materialise

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

SF = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path(registered.VOCABULARY), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def coder():
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return counts.Counter(bpe.read_ranks(PATH), PATTERN)


def tree(text, counter):
    pieces = counter.split.findall(text)
    return counts.Tree(text, [len(p) for p in pieces], counter.of(pieces), counter)


def test_many_edits_in_a_row(counter, coder):
    rng = random.Random(5)
    parts = ["a", " ", "  ", "\n", "\n\n ", "don't", "'s", "1234567", " the", "é", "日本", "!?", " ...", "\t", "x" * 30, "😀", "'LL", "\r\n"]
    for _ in range(300):
        own = tree("".join(rng.choices(parts, k=rng.randint(0, 60))), counter)
        for _ in range(rng.randint(1, 25)):
            a, b = sorted(rng.randint(0, len(own.text)) for _ in range(2))
            b = min(b, a + 12) if rng.random() < 0.8 else b
            want = own.text[:a] + (new := "".join(rng.choices(parts, k=rng.choice([0, 1, 3, 40])))) + own.text[b:]
            own.edit(a, b, new)
            assert own.text == want
            pieces = counter.split.findall(want)
            assert own.leaves() == ([len(p) for p in pieces], counter.of(pieces))
            assert own.total() == sum(len(coder.encode_ordinary(p)) for p in pieces) and own.chars[1] == len(want)


def test_an_edit_encodes_little(counter):
    own = tree("alpha beta gamma delta epsilon " * 20_000, counter)
    own.edit(1_000_000 // 2, 1_000_000 // 2 + 3, "Z z")
    assert own.reencoded < 12 and own.total() == sum(counter.of(counter.split.findall(own.text)))


def test_edits_that_apply():
    assert counts.ordered([(5, 3, "x"), None, (None, 2, "y"), (8, 99, None), (0, 2, "a"), (1, 3, "b"), (2, 2, "c"), (-4, 0, "d")], 10) == [(0, 0, "d"), (0, 2, "a"), (2, 2, "c"), (8, 10, "")]


def test_stored_rows(spark, coder):
    rows = [(1, "One short text", [(0, 3, "Two"), (4, 4, "very ")]), (1, "One short text", None), (2, None, [(0, 0, "new")]), (3, "", []), (4, "keep", [None]), (None, "x" * 5000, [(0, 4999, None)])]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, edits array<struct<start:int,stop:int,put:string>>, counts int, pieces int")
    stored = materialise(counts.build(df, PATH, PATTERN), "trees")
    once = materialise(counts.apply_edits(stored, PATH, PATTERN, "edits"), "edited")
    assert once.columns == ["doc_id", "text", "edits", "pieces", "tree", "counts"] and once.count() == len(rows)
    want = {"Two very short text", "One short text", "new", "", "keep", "x"}
    assert {r["text"] or "" for r in once.collect()} == want
    for r in once.collect():
        n = len(coder.encode_ordinary(r["text"] or ""))
        assert r["counts"]["n_tokens_after"] == n == sum(x & 0xFFFFFFFF for x in r["tree"]["leaves"]) and sum(x >> 32 for x in r["tree"]["leaves"]) == len(r["text"] or "")
        assert r["counts"]["n_pieces"] == len(r["tree"]["leaves"])
    assert {r["counts"]["n_edits"] for r in once.filter("doc_id = 1").collect()} == {0, 2}
    # What came out is edited again, by a function of the text.
    again = counts.apply_edits(once, PATH, PATTERN, lambda t: [(len(t), len(t), " end")], keep=False)
    assert "text" not in again.columns
    assert sorted(r["counts"]["n_tokens_after"] for r in again.collect()) == sorted(len(coder.encode_ordinary((r["text"] or "") + " end")) for r in once.collect())
    assert counts.apply_edits(counts.build(df.limit(0), PATH, PATTERN), PATH, PATTERN, "edits").count() == 0


def test_query_equals_full_counts(spark, coder):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registered.QUERIES["op10_edit_aware_counts"](spark, SF).collect()
    assert len(rows) == len(docs) and sum(r["n_edits"] for r in rows) > 0
    for r in rows:
        text = new = docs[r["doc_id"]]
        for a, b, put in reversed(counts.ordered(counts.redactions(text), len(text))):
            new = new[:a] + put + new[b:]
        assert (r["n_tokens_before"], r["n_tokens_after"]) == (len(coder.encode_ordinary(text)), len(coder.encode_ordinary(new)))
        assert r["n_reencoded"] == 0 if not r["n_edits"] else r["n_reencoded"] <= 30 * r["n_edits"]
