"""Best-fit packing against a naive packer that looks at every open bin."""

import random
from collections import defaultdict

import pytest

from textscreen.llm import packing, queries as registered

SF = "/root/testdata/sf0.001"


def naive(lengths, capacities):
    """Longest first into the open bin with least room, the latest of equals; bins opened at the length of least expected cost."""
    unit = min(cost / size for size, cost in capacities.items())
    bins, placed, rest = [], [], sum(lengths)
    for length in lengths:
        rest -= length
        fitting = [b for b in range(len(bins)) if bins[b]["room"] >= length]
        if fitting:
            least = min(bins[b]["room"] for b in fitting)
            at = max((b for b in fitting if bins[b]["room"] == least), key=lambda b: bins[b]["since"])
        else:
            size = min((c for c in capacities if c >= length), key=lambda c: (capacities[c] - unit * min(c - length, rest), c))
            at = len(bins)
            bins.append({"room": size, "used": 0})
        placed.append((at, bins[at]["used"]))
        bins[at]["used"] += length
        bins[at]["room"] -= length
        bins[at]["since"] = len(placed)
    final = [min(c for c in capacities if c >= b["used"]) for b in bins]
    return [(at, offset, final[at]) for at, offset in placed]


@pytest.mark.parametrize("seed", range(60))
def test_equals_the_naive_packer(seed):
    rng = random.Random(seed)
    capacities = {c: c + rng.choice([0, 3, 32]) for c in rng.sample([8, 16, 17, 32, 64, 100, 128], rng.randint(1, 4))}
    lengths = sorted((rng.randint(1, max(capacities)) if rng.random() < 0.7 else rng.choice([1, max(capacities), min(capacities)]) for _ in range(rng.randint(0, 300))), reverse=True)
    assert packing.best_fit(lengths, capacities) == naive(lengths, capacities)


def cost(found, capacities):
    return sum(capacities[c] for c in {at: c for at, _, c in found}.values())


@pytest.mark.parametrize("seed", range(10))
def test_several_lengths_cost_no_more_than_the_best_single_one(seed):
    rng = random.Random(seed)
    lengths = sorted((min(4096, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(5_000)), reverse=True)
    every = packing.CAPACITIES
    assert cost(packing.best_fit(lengths, every), every) <= cost(packing.best_fit(lengths, {4096: every[4096]}), every)


def test_query_rebuilt_by_the_naive_packer(spark):
    rows = registered.QUERIES["op4_best_fit_packing"](spark, SF).collect()
    words = {r["doc_id"]: len([w for w in __import__("re").split("[\x20\x09-\x0d]+", r["text"] or "") if w]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = defaultdict(list)
    for r in rows:
        held[r["doc_id"]].append((r["first_word"], r["n_words"]))
    for key, pieces in held.items():
        pieces.sort()
        assert sum(n for _, n in pieces) == words[key] and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
    groups = defaultdict(list)
    for r in rows:
        if r["bin_id"] is not None:
            groups[r["bin_id"] >> 32].append(r)
    for own in groups.values():
        own.sort(key=lambda r: (-r["n_words"], r["doc_id"], r["piece"]))
        want = naive([r["n_words"] for r in own], packing.CAPACITIES)
        assert [(r["bin_id"] & (1 << 32) - 1, r["bin_offset"], r["capacity"]) for r in own] == want


def test_a_key_that_repeats_is_dealt_to_many_groups(spark):
    df = spark.range(4_000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "repeat('word ', cast(1 + id % 50 AS int)) AS text", "'x' AS row", "1 AS part", "2 AS piece")
    rows = packing.pack(df, group=200).collect()
    assert len(rows) == 4_000 and sum(r["n_words"] for r in rows) == sum(1 + i % 50 for i in range(4_000))
    own = defaultdict(int)
    for r in rows:
        own[r["bin_id"] >> 32] += r["doc_id"] == 7
    assert len(own) == 20 and max(own.values()) < 200
