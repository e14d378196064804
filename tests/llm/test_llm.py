"""The corpus operators against brute force, and their edge cases."""

import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

import __spark_entry__ as driver
import corpus_pipeline
import oracle
from textscreen.llm import bpe, extract, licences, lines, packing, quality, simhash, vectors
from textscreen.llm import queries as registered

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

SF = "/root/testdata/sf0.001"
SPACES = re.compile("[\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "alpha beta gamma delta epsilon " * 20_000
TEXTS = ["", None, " \t\n ", "One short text", "One short text", LONG, "é ß 日本語 don't\r\n  x " * 3, "shared line of words\nown a\n\nshared line of words"]
SCHEMA = "doc_id long, text string, n_words string, `key` int, bits int, _lines int, ledger int, counts int, component_id int"
CLASH = ("x", 1, 2, 3, 4, 5, 6)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, *CLASH) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], *CLASH), (None, "One short text", *CLASH), (None, None, *([None] * 7))]
    return spark.createDataFrame(rows, SCHEMA).cache()


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def roots(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(text, shingle=3):
    w = words((text or "").translate(LOWER))
    parts = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    made = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in made) > len(made))


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_equals_sql(spark, name):
    assert not oracle.difference(registered.QUERIES[name](spark, SF), oracle.connect(SF), registered.SQL[name])


def test_ledger_and_ablation(spark, odd):
    rows = quality.ledger(odd).select("doc_id", "ledger.*").collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_words"] == 0 and by[0]["fail_bits"] & 1
    assert by[5]["n_words"] == 100_000 and by[5]["n_repeat_words"] == 100_000
    kept = quality.accepted(odd, "strict-1")
    assert kept.columns == odd.columns
    out = {r["rule"]: r for r in quality.ablation(quality.ledger(odd).select("ledger.fail_bits"), "base-1").collect()}
    few = sum(r["fail_bits"] & 1 for r in rows)
    assert out["few_words"]["n_failed"] == few and out["few_words"]["n_failed_alone"] == sum(r["fail_bits"] & 3 == 1 for r in rows)
    assert quality.ledger(odd.limit(0)).count() == 0


def test_simhash_brute_force(spark, odd):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["bits"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    docs.sort()
    made = [fingerprint(t) for _, t in docs]
    group = roots(len(docs), [(i, j) for i, j in combinations(range(len(docs)), 2) if (made[i] ^ made[j]).bit_count() <= 2])
    assert got == {k: (f, docs[g][0]) for (k, _), f, g in zip(docs, made, group)}
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r["component_id"] for r in rows if r["bits"] == 0} == {0}
    assert {r["component_id"] for r in rows if r["doc_id"] in (3, 4)} == {3}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [0, 2, 3])
def test_pivot_links_are_all_pairs(spark, bits):
    draw = np.random.default_rng(bits)
    base = draw.integers(0, 1 << 62, 40)
    near = [int(b) ^ sum(1 << int(x) for x in draw.choice(63, n, replace=False)) for b in base for n in range(5)]
    made = sorted({*map(int, base), *near})
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(x,) for x in made], "bits long"), bits).collect()}
    assert got == {(a, b) for a, b in combinations(made, 2) if (a ^ b).bit_count() <= bits}


@pytest.mark.parametrize("batches,fan_in", [(1, 2), (4, 2), (7, 3)])
def test_line_runs(spark, odd, batches, fan_in):
    rows = lines.dedup(odd, batches=batches, fan_in=fan_in).collect()
    assert len(rows) == odd.count()
    texts = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect() if r["doc_id"] is not None), key=lambda r: r[0])
    first = {}
    for k, t in texts:
        for line in t.split("\n"):
            first.setdefault(line.strip(lines.SPACE).translate(LOWER), k)
    want = {}
    for k, t in texts:
        keys = [(line, line.strip(lines.SPACE).translate(LOWER)) for line in t.split("\n")]
        want[k] = "\n".join(line for line, key in keys if len(key) < 10 or first[key] == k)
    assert {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None} == want
    assert lines.dedup(odd.limit(0)).count() == 0


def test_packing_round_trip(spark, odd):
    sizes = {8: 9, 16: 17, 64: 65}
    rows = packing.pack(odd, capacities=sizes).collect()
    assert sum(r["n_words"] for r in rows) == sum(len(words(r["text"])) for r in odd.collect())
    assert all((r["bin_id"] is None) == (r["n_words"] == 0) for r in rows)
    held = {}
    for r in rows:
        if r["bin_id"] is not None:
            held.setdefault((r["bin_id"], r["capacity"]), []).append((r["bin_offset"], r["n_words"]))
    assert len({b for b, _ in held}) == len(held)
    for (_, capacity), parts in held.items():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0
        used = sum(n for _, n in parts)
        assert used <= capacity and not any(used <= s < capacity for s in sizes)
    assert packing.pack(odd.limit(0)).count() == 0


def test_page_text(spark):
    body = "".join(f"<p>Sentence {i} of the article &amp; it is long enough to be text of its own, surely.</p>" for i in range(5))
    page = f"<html><head><style>p {{}}</style></head><nav><a href=x>Home</a></nav><article><h1>A  title</h1>{body}</article><footer>Imprint</footer>"
    table = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<script>x</script>"), (1, page)], "page_id long, html string")
    rows = extract.extract(table).select("page_id", "main.*").collect()
    want = "\n".join(["A title", *[f"Sentence {i} of the article & it is long enough to be text of its own, surely." for i in range(5)]])
    assert [r["text"] for r in rows if r["page_id"] == 1] == [want] * 2
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in rows if r["page_id"] != 1)
    assert extract.extract(table.limit(0)).count() == 0


def test_embeddings_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    width, top = len(rows[0][1]), max(r[0] for r in rows)
    odd = [None, [0.0] * width, [float("nan")] * width, [None] * width, [], list(rows[0][1]), list(rows[0][1])]
    rows += [(top + 1 + i, v, rows[0][2]) for i, v in enumerate(odd)] + [(top + 9, rows[0][1], None)]
    rows.sort(key=lambda r: r[0])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long")).collect()}
    good = [i for i, (_, v, label) in enumerate(rows) if v and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: np.float32(rows[i][1]).astype(float) / np.linalg.norm(np.float32(rows[i][1]).astype(float)) for i in good}
    links = [(i, j) for i, j in combinations(good, 2) if rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.93]
    group = roots(len(rows), links)
    n = np.bincount(np.array(links, int).ravel(), minlength=len(rows))
    assert got == {r[0]: (n[i], rows[group[i]][0], group[i] == i) for i, r in enumerate(rows)}


def test_bpe(spark, odd):
    path = public_tokenizers.path(registered.VOCABULARY)
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = bpe.encode(odd, path, public_tokenizers.PATTERN).collect()
    assert len(rows) == odd.count()
    text = dict(enumerate(TEXTS))
    for r in rows:
        if r["doc_id"] is not None:
            assert list(r["ids"]) == coder.encode_ordinary(text[r["doc_id"]] or "") and bytes(r["decoded"]) == (text[r["doc_id"]] or "").encode()

    assert bpe.encode(odd.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_licences(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    top = max(k for k, _ in docs)
    docs += [(top + 1, "Some prose.\nReleased under the MIT License."), (top + 2, None), (top + 3, "")]
    found = licences.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r["paragraph"], r["family"], r["confirmed"]) for r in found if r["doc_id"] == top + 1} == {(1, "MIT", True)}
    assert not [r for r in found if r["doc_id"] in (top + 2, top + 3)]


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "best-fit packing"]
    source = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in registered.QUERIES["op2_quality_rules"](spark, SF).where("kept").collect()}
    docs = {r["doc_id"]: r["text"] or "" for r in source.collect() if r["doc_id"] in kept}
    seen, left = set(), {}
    for k in sorted(docs):
        own = [(x, x.strip(lines.SPACE).translate(LOWER)) for x in docs[k].split("\n")]
        left[k] = "\n".join(x for x, key in own if len(key) < 10 or key not in seen)
        seen |= {key for _, key in own}
    ids = sorted(left)
    made = [fingerprint(left[k]) for k in ids]
    group = roots(len(ids), [(i, j) for i, j in combinations(range(len(ids)), 2) if (made[i] ^ made[j]).bit_count() <= 2])
    want = {k: len(words(left[k])) for i, k in enumerate(ids) if group[i] == i}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_words"]
    assert got == want
    assert "pipeline" in driver.queries()
