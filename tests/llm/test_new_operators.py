"""Whitening, bottom-k fingerprints and counted infill against brute force, and their edge cases."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textscreen.llm import infill, queries as registered, sketches, whitening

SF = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta epsilon zeta " * 30_000
TEXTS = ["", None, " \t\n ", "One short text", "One short text", LONG, "é ß 日本語 😀 don't\r\n  x " * 3, "has <P> in it", "$1 \\ $2 a\\b " * 9]
CLASH = "_key int, _text int, _next int, _sketch int, _range int, _copy int, _tie int, _bucket int, n int, form int, infill int, edited int, key int, x int, body int"


def odd(spark, rows=None):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (3, "another"), (None, "no key"), (None, None)] if rows is None else rows
    n = CLASH.count(",") + 1
    return spark.createDataFrame([(*r, *range(n)) for r in rows], f"doc_id long, text string, {CLASH}")


def own_sketch(text, k=sketches.K, size=sketches.SHINGLE):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    hashed = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    made = set()
    for i in range(max(1, len(words) - size + 1)) if words else []:
        h = 42
        for w in hashed[i : i + size]:
            h = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), h)
        made.add(h - (1 << 64) if h >> 63 else h)
    return sorted(made)[:k], len(made)


def alike(a, b, k=sketches.K):
    union = sorted({*a, *b})[:k]
    return sum(h in a and h in b for h in union) / len(union) if union else 1.0


def own_fingerprints(docs):
    docs = sorted(((k, t or "") for k, t in docs), key=lambda r: r[0])
    out = {}
    for i, (k, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        a, b, c = (own_sketch(x)[0] for x in (t, changed, after))
        out[k] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, alike(a, b), alike(a, c))
    return out


def test_fingerprints_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = own_fingerprints(docs)
    hexed = lambda s: "".join(f"{h & (1 << 64) - 1:016X}" for h in s)
    rows = registered.QUERIES["op12_bottom_k"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, sha, a, b, near, after = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (n, sha, hexed(a), hexed(b))
        assert r["near_edited"] == pytest.approx(near) and r["near_next"] == pytest.approx(after)


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_next_document_on_odd_rows(spark, parts):
    df = odd(spark)
    rows = sketches.fingerprints(df, parts=parts).collect()
    assert len(rows) == df.count()
    # Null keys first, repeated keys in a row: each row's next one is found once.
    known = {(r["doc_id"], r["text"]): r for r in rows}
    assert known[(8, TEXTS[8])]["next_sketch"] in (own_sketch("no key")[0], [])
    assert known[(7, TEXTS[7])]["next_sketch"] == own_sketch(TEXTS[8])[0]
    assert known[(0, "")]["edited"] == "" and known[(0, "")]["sketch"] == []
    assert known[(5, LONG)]["edited"] == LONG[: len(LONG) // 2] + TEXTS[6]
    starts = sorted(tuple(r["next_sketch"]) for r in rows)
    assert starts == sorted(tuple(r["sketch"]) for r in rows)
    assert sketches.fingerprints(df.limit(0)).count() == 0
    one = sketches.fingerprints(odd(spark, [(1, "a b c d e f")])).first()
    assert one["edited"] == "a b c a b c"[:11] and one["next_sketch"] == one["sketch"]


def test_a_hot_key_is_cut_into_ranges(spark):
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("k"), F.col("id").cast("string").alias("v")).union(spark.range(3000).select(F.col("id") + 100, F.lit("x")))
    got = sketches.with_next(rows, "k", ["k", "v"], parts=16)
    rows = got.collect()
    assert len(rows) == 6000
    # Following the next row goes round through every row once.
    assert Counter((r["_next"]["k"], r["_next"]["v"]) for r in rows) == Counter((r["k"], r["v"]) for r in rows)


def test_estimates_and_merging(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40_000)]
    left = " ".join(rng.choice(words, 12_000))
    right = " ".join(left.split()[:8_000] + list(rng.choice(words, 4_000)))
    df = spark.createDataFrame([(left, right)], "a string, b string").select(sketches.sketch(F.col("a"), 1024).alias("a"), sketches.sketch(F.col("b"), 1024).alias("b"))
    row = df.select(
        sketches.resemblance(F.col("a"), F.col("b"), 1024).alias("r"), sketches.containment(F.col("a"), F.col("b"), 1024).alias("c"),
        sketches.distinct_count(F.col("a"), 1024).alias("n"), sketches.merge(F.col("a"), F.col("b"), 1024).alias("m"),
    ).first()
    assert row["r"] == pytest.approx(0.5, abs=0.05) and row["c"] == pytest.approx(0.667, abs=0.06)
    assert row["n"] == pytest.approx(own_sketch(left)[1], rel=0.1)
    assert row["m"] == sorted({*own_sketch(left, 1024)[0], *own_sketch(right, 1024)[0]})[:1024]
    docs = [(i % 3 if i % 5 else None, t) for i, t in enumerate([left, right, "", None, "a b c", "a b c", "x y z u v w"])]
    parts = spark.createDataFrame(docs, "g int, text string").select("g", sketches.sketch(F.col("text")).alias("sketch"))
    got = {r["g"]: r["sketch"] for r in sketches.merged(parts, ["g"]).collect()}
    for g in {g for g, _ in docs}:
        assert got[g] == sorted({h for d, t in docs if d == g for h in own_sketch(t)[0]})[: sketches.K]
    assert sketches.merged(parts.limit(0), ["g"]).count() == 0


def own_infill(key, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or any(m in t for m in infill.MARKS) or h[2] % 100 >= 90:
        return len(t), "plain", None, None, t
    if h[3] % 100 < 20:
        return len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_infill_brute_force(spark):
    rows = [(i, t) for i in range(300) for t in (TEXTS[i % len(TEXTS)],) if i % len(TEXTS) != 5 or i < 9]
    rows += [(3, TEXTS[3]), (None, "no key at all"), (None, None), (10**6, LONG * 3), (10**6 + 1, "<" * 5000), (10**6 + 2, "S><P" * 999)]
    df = odd(spark, rows)
    made = infill.transform(df, out="INFILL")
    assert [c.lower() for c in made.columns].count("infill") == 1 and "body" in made.columns
    got = made.select("doc_id", "text", "INFILL.*", infill.restore(F.col("INFILL.output"), F.col("INFILL.form")).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"]) == own_infill(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert infill.transform(df.limit(0)).count() == 0
    assert [r[0] for r in spark.createDataFrame([("a", "psm"), (None, "spm"), ("a", None)], "o string, f string").select(infill.restore(F.col("o"), F.col("f"))).collect()] == [None] * 3


def test_infill_by_words(spark):
    unit = r"\S+\s*|\s+"
    df = spark.createDataFrame([(str(i), "one two  three\nfour five six " * 400) for i in range(20)], "doc_id string, text string")
    rows = infill.transform(df, rate=100, marks=("$pre$", "\\suf", "(mid)"), unit=unit).select("infill.*", "text", infill.restore(F.col("infill.output"), F.col("infill.form"), ("$pre$", "\\suf", "(mid)")).alias("back")).collect()
    assert all(r["n"] == 2400 and r["back"] == r["text"] for r in rows)
    assert all(len(r["output"]) == len(r["text"]) + 14 for r in rows)


def own_whitening(vectors):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s).astype(float) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)
    return n, [int(sum((n * a - b) ** 2 for a, b in zip(row, s))) for row in x], e[order], u[:, order], centred, np.trace(v)


def test_whitening_brute_force(spark):
    source = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = sorted((r["vec_id"], list(r["embedding"])) for r in source)
    width, top = len(rows[0][1]), rows[-1][0]
    bad = [None, [], [None] * width, [float("nan")] * width, [float("inf")] + [0.0] * (width - 1), [1.0] * (width + 1)]
    more = [(top + 20, [0.0] * width), (rows[0][0], rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows + more + [(top + 1 + i, v) for i, v in enumerate(bad)])], "vec_id long, embedding array<float>, component int")
    good = [np.float32(v).astype(float) for _, v in rows + more]
    n, deviation, e, u, centred, trace = own_whitening(good)
    got = whitening.whiten(df).collect()
    assert len(got) == 8 * len(good) and {r["n"] for r in got} == {n}
    assert {r["identity_error"] for r in got}.pop() < 1e-9
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    for (k, _), d, c in list(zip(rows + more, deviation, centred))[1:60]:
        for i in range(8):
            r = by[k][i + 1][0]
            assert r["deviation"] == d and r["explained"] == pytest.approx(e[i] / trace, rel=1e-9)
            assert abs(r["whitened"]) == pytest.approx(abs(c @ u[:, i]) / math.sqrt(e[i]), abs=1e-6)
    assert not set(by) & set(range(top + 1, top + 7))


def test_whitening_of_degenerate_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([("a", None), ("b", [])])).count() == 0
    assert whitening.whiten(make([("a", [1.0, 2.0]), ("b", [1.0, 2.0])])).count() == 0
    flat = whitening.whiten(make([(str(i), [float(i), 2.0 * i, 5.0]) for i in range(9)])).collect()
    assert len(flat) == 9 and {r["component"] for r in flat} == {1}
    assert flat[0]["explained"] == pytest.approx(1.0) and flat[0]["identity_error"] < 1e-9
    huge = whitening.whiten(make([("a", [1e300, 1.0]), ("b", [-1e300, 2.0]), ("c", [0.5, -1e-300])])).collect()
    assert len(huge) == 3 and all(np.isfinite(r["whitened"]) for r in huge)


def test_factors(spark):
    rng = np.random.default_rng(0)
    for d, r in ((1, 1), (5, 5), (12, 4), (64, 64)):
        b = rng.normal(size=(d, r)) * np.logspace(0, -5, r)
        a = b @ b.T
        l, order = whitening.pivoted_cholesky(a)
        assert l.shape[1] == r and np.allclose(np.triu(l, 1), 0)
        np.testing.assert_allclose(l @ l.T, a[np.ix_(order, order)], atol=1e-12 * a.max())
        u = whitening.jacobi_columns(l)
        norms = (u * u).sum(axis=0)
        np.testing.assert_allclose(norms, np.linalg.eigvalsh(a)[::-1][:r], rtol=1e-6)
        gram = (u / np.sqrt(norms)).T @ (u / np.sqrt(norms))
        np.testing.assert_allclose(gram, np.eye(r), atol=1e-12)
