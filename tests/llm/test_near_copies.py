"""The near-copy stage's SimHash search and the exact way for the rest, against brute force."""

import random

import numpy as np
import pytest

from quern.llm import near_copies, simhash
from quern.llm.near_copies import apart, shingle_set, sketch
from quern.llm.simhash import SEARCH, near_groups, set_fingerprint


def variants(seed, groups, changes):
    """Random texts, each with three copies in which some words are changed."""
    r, rows = random.Random(seed), []
    for g in range(groups):
        words = [f"{r.choice('abcdefg')}{r.randint(0, 3000)}" for _ in range(r.choice((40, 150, 400)))]
        rows.append((10 * g, " ".join(words)))
        for k in range(1, 4):
            copy = list(words)
            for _ in range(max(1, int(len(words) * r.choice(changes)))):
                copy[r.randrange(len(copy))] = f"new{r.randint(0, 3000)}"
            rows.append((10 * g + k, " ".join(copy)))
    return rows


def meets(x, y):
    """Whether two fingerprints share a segment and differ in few enough bits of the first word."""
    u, v = (np.unpackbits(np.frombuffer(p, np.uint8)) for p in (x, y))
    n = SEARCH.segments * SEARCH.bits
    return (u[:n] == v[:n]).reshape(-1, SEARCH.bits).all(axis=1).any() and (u[:64] != v[:64]).sum() <= SEARCH.distance


def naive_print(text):
    """Majority of each bit over the mixed hashes of the different five-word shingles."""
    s = [int(h) for h in shingle_set(text, 5)]
    mask, out = (1 << 64) - 1, 0
    for k in range(SEARCH.search_words):
        ones = [0] * 64
        for h in s:
            x = h + k * 0x9E3779B97F4A7C15 & mask
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
            x ^= x >> 31
            ones = [n + (x >> 63 - b & 1) for b, n in enumerate(ones)]
        out = out << 64 | int("".join(str(int(2 * n > len(s))) for n in ones), 2)
    return out.to_bytes(8 * SEARCH.search_words, "big")


@pytest.mark.parametrize("block", [4096, 2])
def test_search_finds_what_meets(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = variants(1, 25, (0.005, 0.02))
    prints = {i: set_fingerprint(shingle_set(t, 5)) for i, t in rows}
    nodes = spark.createDataFrame([(bytearray(p), bytearray(p[:8]), i) for i, p in prints.items()], "search binary, verify binary, node long")
    got = {tuple(sorted(x)) for x in simhash.search(nodes, SEARCH).collect()}
    want = {(i, j) for i, x in prints.items() for j, y in prints.items() if i < j and meets(x, y)}
    assert len(want) >= 25 and got <= want
    for i in prints:  # the least lower and the least higher neighbour of each
        assert (min((a for a, b in want if b == i), default=None) is None) == (not any(b == i for _, b in got))
        assert min((x for x in want if x[1] == i), default=None) == min((x for x in got if x[1] == i), default=None)
        assert min((x for x in want if x[0] == i), default=None) == min((x for x in got if x[0] == i), default=None)


def test_near_copies_come_from_simhash_fingerprints(spark, monkeypatch):
    rows = variants(2, 20, (0.002, 0.01)) + [(900, None), (901, ""), (902, "few words")]
    prints = {i: naive_print(t or "") for i, t in rows}
    assert all(set_fingerprint(shingle_set(t or "", 5)) == prints[i] for i, t in rows)
    rounds, linked = [], near_copies._linked

    def watched(pairs, docs, *more):
        rounds.append({tuple(x) for x in pairs.collect()})
        return linked(pairs, docs, *more)

    monkeypatch.setattr(near_copies, "_linked", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_groups(docs, simhash.NEAR).collect()
    assert {x["doc_id"]: x["fingerprint"] for x in found} == {i: p[:8].hex() for i, p in prints.items()}
    got = {x["doc_id"]: x["component_id"] for x in found}
    assert rounds[0] and all(meets(prints[a], prints[b]) for a, b in rounds[0])
    assert sum(any(b == i or a == i for a, b in rounds[0]) for i, c in got.items() if c != i and c < 900) >= 0.8 * sum(c != i and c < 900 for i, c in got.items())
    monkeypatch.setattr(simhash, "search", lambda nodes, form: spark.createDataFrame([], "a long, b long"))
    assert {x["doc_id"]: x["component_id"] for x in near_groups(docs, simhash.NEAR).collect()} == got  # the exact way alone
    assert got[901] == 900 and got[902] == 902


def test_sketches_never_rule_out_too_much():
    r = np.random.default_rng(3)
    for n in [0, 1, 2, 63, 64, 65, 127, 129, 500, 1025] * 6:
        x = np.unique(r.integers(0, 1 << 63, n, np.uint64))
        y = np.union1d(x[: int(len(x) * r.random())], r.integers(0, 1 << 63, int(r.integers(0, 40)), np.uint64))
        assert apart(sketch(x), sketch(y)) == apart(sketch(y), sketch(x)) <= len(np.setxor1d(x, y))
        assert apart(sketch(x), sketch(x)) == 0
    a, b = (np.unique(r.integers(0, 1 << 63, 400, np.uint64)) for _ in "ab")
    assert apart(sketch(a), sketch(b)) > 180


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_texts_that_take_part_are_told(spark, monkeypatch, bits):
    monkeypatch.setattr(near_copies, "BITS", bits)
    ids = [-(1 << 63), -5, 0, 7, 12345678901]
    rows = spark.createDataFrame([(i, "t") for i in [*ids, *range(100, 600)]], "id long, text string")
    got = {x["id"] for x in near_copies._among(rows, spark.createDataFrame([(i,) for i in ids], "id long"), len(ids)).collect()}
    assert set(ids) <= got and len(got) < 250
    assert near_copies._among(rows, spark.createDataFrame([], "id long"), 0).count() == 0
