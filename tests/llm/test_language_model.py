"""The language model: seats drawn rightly, probabilities that sum to one, better than its base."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textscreen.llm import pitman_yor, queries as registered

SF = "/root/testdata/sf0.001"


def exact_tables(c, strength, discount):
    """Chances of 1..c tables for c customers of one dish whose new tables weigh ``strength`` each: the target of the sampler."""
    # Sum over seatings of the products of weights, by size of the part seated so far.
    stirling = np.zeros((c + 1, c + 1))
    stirling[0, 0] = 1
    for n in range(c):
        for t in range(n + 1):
            stirling[n + 1, t] += stirling[n, t] * (n - discount * t) if t else 0
            stirling[n + 1, t + 1] += stirling[n, t]
    weights = np.array([stirling[c, t] * strength**t for t in range(1, c + 1)])
    return weights / weights.sum()


@pytest.mark.parametrize("c,strength,discount", [(2, 0.3, 0.5), (3, 1.0, 0.8), (6, 0.5, 0.3), (10, 2.0, 0.7)])
def test_sweeps_draw_seats_by_their_chances(c, strength, discount):
    draw, copies = np.random.default_rng(3), 40_000
    counts, fresh = np.full(copies, c), np.full(copies, strength)
    sizes, tables = pitman_yor.seat(counts, fresh, discount, draw)
    for _ in range(25):
        sizes, tables = pitman_yor.reseat(sizes, tables, counts, counts, fresh, discount, draw)
    assert sizes.sum() == c * copies and (sizes > 0).all() and tables.sum() == len(sizes)
    want = exact_tables(c, strength, discount)
    got = np.bincount(tables, minlength=c + 1)[1:] / copies
    assert np.abs(got - want).max() < 0.015


@pytest.mark.parametrize("c,strength,discount", [(80, 0.4, 0.5), (100, 6.0, 0.8), (70, 60.0, 0.6)])
def test_sweeps_in_groups_keep_the_law(c, strength, discount):
    assert c > pitman_yor.JOINT
    draw, copies = np.random.default_rng(4), 12_000
    counts, fresh = np.full(copies, c), np.full(copies, strength)
    sizes, tables = pitman_yor.jointly(counts, fresh, discount, draw)
    want = exact_tables(c, strength, discount)
    single = (sizes == 1).sum() / copies
    for sweeps in (0, 5):
        for _ in range(sweeps):
            sizes, tables = pitman_yor.reseat(sizes, tables, counts, counts, fresh, discount, draw)
        assert sizes.sum() == c * copies and (sizes > 0).all() and tables.sum() == len(sizes)
        assert np.abs(np.bincount(tables, minlength=c + 1)[1:] / copies - want).max() < 0.015
        assert (sizes == 1).sum() / copies == pytest.approx(single, rel=0.03)


@pytest.mark.parametrize("c", [2, 40, 64, 65, 3000, 20_000])
def test_a_sweep_moves_every_customer(c):
    """Where a new table weighs so much more than all customers, everyone ends up alone."""
    draw, counts = np.random.default_rng(2), np.array([c, 1, c])
    sizes, tables = pitman_yor.reseat(np.array([c, 1, c]), np.ones(3, np.int64), counts, counts, np.array([1e13, 1.0, 1e-9]), 0.5, draw)
    assert tables.tolist() == [c, 1, 1] and sizes.tolist() == [1] * c + [1, c]
    # Those gone leave and new ones come, before or after.
    for now in (counts // 2 + 1, counts + 20):
        after, held = pitman_yor.reseat(sizes, tables, counts, now, np.array([1e13, 1.0, 1e-9]), 0.5, draw)
        assert held[0] == now[0] and after.sum() == now.sum()


def test_walk_keeps_every_dish_by_itself():
    draw = np.random.default_rng(1)
    counts = draw.integers(0, 90, 400)
    fresh = draw.uniform(0.01, 3, 400)
    sizes, tables = pitman_yor.seat(counts, fresh, 0.6, draw)
    for _ in range(20):
        now = np.maximum(0, counts + draw.integers(-5, 6, 400))
        sizes, tables = pitman_yor.reseat(sizes, tables, counts, now, fresh, 0.6, draw)
        ends = np.cumsum(tables)
        per = np.array([sizes[e - t : e].sum() for e, t in zip(ends, tables)])
        assert (per == now).all() and ((tables > 0) == (now > 0)).all() and (sizes > 0).all()
        counts = now


def plain(docs):
    words = {k: [w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w] + ["\0end"] for k, t in docs}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in docs}
    counts = Counter(w for k, _ in docs if not held[k] for w in words[k])
    n, v = sum(counts.values()), len(counts)
    return {k: (held[k], len(words[k]), sum(counts[w] > 0 for w in words[k]), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words[k])) for k, _ in docs}


@pytest.fixture(scope="module")
def scored(spark):
    return registered.QUERIES["op1_pitman_yor"](spark, SF).cache()


def test_contract_columns(spark, scored):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want, rows = plain(docs), scored.collect()
    assert len(rows) == len(docs)
    for r in rows:
        held, n_tokens, n_known, n, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n_tokens, n_known, n)
        assert r["base_score"] == pytest.approx(base) and math.isfinite(r["score"]) and r["score"] < 0


def test_beats_its_base_on_held_out_texts(scored):
    own = {r["held_out"]: r["perplexity"] for r in pitman_yor.perplexity(scored).collect()}
    base = {r["held_out"]: r["perplexity"] for r in pitman_yor.perplexity(scored, "base_score").collect()}
    assert own[True] < 0.9 * base[True] and own[False] < 0.3 * base[False]


def test_next_words_sum_to_one(spark):
    """Every next word after a context: held-out texts that end in it, over vocabulary, end and a new word."""
    train = ["a b a c", "a b b", "c a b a", "b", "", "a b a c a b"]
    # P(f x end) / P(f x' end) alone mixes in the end; so ask with a long tail of its own for each x and divide it out.
    texts = {"": "", **{x: x for x in "abcz"}, **{f + x: f"{f} {x}" for f in "abcz" for x in "abcz"}}
    docs = [(i, t, False) for i, t in enumerate(train)] + [(100 + i, t, True) for i, t in enumerate(texts.values())]
    df = spark.createDataFrame(docs, "doc_id long, text string, held boolean")
    rows = {r["doc_id"]: 10 ** r["score"] for r in pitman_yor.score(df, F.col("held")).collect()}
    p = {name: rows[100 + i] for i, name in enumerate(texts)}
    # With s(x) = P(x | start), e(x) = P(end | x): P(x) = s(x) e(x), P(f x) = s(f) P(x | f) e(x), and after f all next words and the end sum to one:
    # sum over x of P(f x) / (s(f) e(x)) + e(f) = 1. Put s(x) = P(x) / e(x), which leaves four equations and the start's for the four e.
    e = np.full(4, 0.3)

    def gaps(e):
        s = np.array([p[x] for x in "abcz"]) / e
        return [sum(p[f + x] / (s[i] * e[j]) for j, x in enumerate("abcz")) + e[i] - 1 for i, f in enumerate("abcz")]

    for _ in range(200):  # Newton steps
        g = np.array(gaps(e))
        jacobian = np.array([(np.array(gaps(e + np.eye(4)[k] * 1e-7)) - g) / 1e-7 for k in range(4)]).T
        e = np.clip(e - 0.5 * np.linalg.solve(jacobian, g), 1e-4, 0.999)
    assert np.abs(gaps(e)).max() < 1e-6
    # The start's sum then holds by itself if the model is one.
    assert p[""] + sum(p[x] / e[i] for i, x in enumerate("abcz")) == pytest.approx(1, abs=1e-4)


def test_odd_rows(spark):
    rows = [(1, ""), (1, ""), (2, None), (3, " \n\t "), (4, "Word word WORD"), (5, "word " * 60_000), (None, "word"), (7, "ß é 日本 \x0b x")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, words int, bucket int, block int")
    got = pitman_yor.score(df, F.col("doc_id") == 4).collect()
    assert len(got) == len(rows) and all(math.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert [r["n_known"] for r in got if r["doc_id"] == 4] == [4]
    assert pitman_yor.score(df.limit(0), F.lit(False)).count() == 0
    every = pitman_yor.score(df, F.lit(True)).collect()
    assert {r["train_tokens"] for r in every} == {0} and all(math.isfinite(r["score"]) for r in every)
    with pytest.raises(TypeError, match="must be whole numbers|must be a whole number"):
        pitman_yor.score(df.withColumn("doc_id", F.lit("a")), F.lit(False))


def test_numbers_come_back_as_they_were():
    draw = np.random.default_rng(5)
    for n in (0, 1, 2, 3000):
        words = draw.zipf(1.3, n).astype(np.uint64)
        h = pitman_yor.mix(words)
        distinct, tokens = pitman_yor._distinct(h)
        assert (distinct[tokens] == h).all() and len(distinct) == len(set(h.tolist()))
        packed = pitman_yor._tokens(tokens, len(distinct))
        assert (pitman_yor._untokens(packed, len(distinct)) == tokens).all()
        # Ascending in two parts, as contexts are that lie by their owner.
        parts = np.concatenate([np.sort(h[: n // 2]), np.sort(h[n // 2 :])])
        assert (pitman_yor._unhashes(pitman_yor._hashes(parts)) == parts).all()
        for kind in (np.int32, np.int64):
            x = draw.integers(np.iinfo(kind).min, np.iinfo(kind).max, n, kind)
            assert (pitman_yor._unsigned(pitman_yor._signed(x), kind) == x).all()
        x = draw.integers(0, 1 << 30, n)
        assert (pitman_yor._unjumps(pitman_yor._jumps(x)) == x).all()


def test_stored_tables_stay_small(spark, tmp_path, monkeypatch):
    """What is kept on disk, for as many bytes of text; each step's table holds only what later ones read."""
    draw, at = np.random.default_rng(9), iter(range(1000))
    monkeypatch.setattr("textscreen.session.shared_dir", lambda spark, name: str(tmp_path / f"{next(at)}-{name}"))
    texts = [" ".join(f"word{w}" for w in draw.zipf(1.2, 1500) % 50_000) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert pitman_yor.score(df, F.col("doc_id") % 7 == 2).count() == len(texts)
    stored = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert stored < 1.4 * sum(map(len, texts))
