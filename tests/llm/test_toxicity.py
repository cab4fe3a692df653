"""The parts of the toxicity operator against brute force, and its accuracy on running text."""

import random
from collections import defaultdict

import numpy as np
import zstandard

from quern.llm import toxicity

R = random.Random(4)
PARTS = ["tha", "on", "er", "inn", "re", "st", "ion", "ble", "ly", "an", "wen"]
FOUL = ["idiot", "worthless", "pathetic", "disgusting", "scum", "moron"]


def prose(words, foul=0):
    out = ["".join(R.choice(PARTS) for _ in range(R.randint(1, 4))) for _ in range(words)]
    for w in R.choices(FOUL, k=foul):
        out.insert(R.randrange(words), w)
    return " ".join(out)


def test_windows_hold_the_whole_text():
    for text in ["", "  ", "a" * 1000, "é" * 300, "Some WORDS\n" * 90, prose(400)]:
        raw = text.lower().encode()
        windows = toxicity.cut_windows(text)
        assert all(len(w) <= toxicity.WINDOW for w in windows)
        assert raw.strip() in b"".join(windows) and len(b"".join(windows)) <= 2 * len(raw)
        for w in windows:
            assert w in raw


def test_lengths_are_those_of_compression_after_the_dictionaries():
    made = toxicity.Dictionaries(prose(2000).encode(), " ".join(FOUL).encode())
    windows = toxicity.Windows(made)
    text = prose(300, 10)
    want = []
    for w in toxicity.cut_windows(text):
        sizes = []
        for content in (b" " * len(made.toxic) + made.ordinary, made.toxic + made.ordinary):
            how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, window_log=18, chain_log=17, hash_log=17, search_log=5, min_match=4, target_length=16, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
            fresh = zstandard.ZstdCompressionDict(content + b" " * 16, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append(len(zstandard.ZstdCompressor(dict_data=fresh, compression_params=how).compress(w)))
        assert windows.lengths(w) == tuple(sizes)
        want.append(sizes[0] - sizes[1])
    assert windows.gains(text).tolist() == want and max(want) > 2


def test_unexplained_runs_by_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_PART", 0.05)
    toxic, plain = [prose(30, 4).encode() for _ in range(60)], [prose(30).encode() for _ in range(60)]
    n = toxicity.GRAM
    where, known = defaultdict(set), defaultdict(int)
    for t in toxic:
        padded = b"    " + t + b"    "
        for i in range(len(t) - n + 1):
            where[t[i : i + n]].add((padded[i : i + 4], padded[i + 4 + n : i + 8 + n]))
    pieces = [p[i : i + n] for p in plain for i in range(len(p) - n + 1)]
    for s in pieces:
        known[s] += 1
    all_toxic, all_plain = sum(max(0, len(t) - n + 1) for t in toxic), len(pieces)
    share, good = all_toxic / (all_toxic + all_plain), set()
    for s, found in where.items():
        a, both = len(found), len(found) + known[s]
        if a >= 6 and a >= 0.9 * both and a - share * both >= 3.5 * (both * share * (1 - share)) ** 0.5:
            good.add(s)
    want = []
    for t in toxic:
        at = [i for i in range(len(t) - n + 1) if t[i : i + n] in good]
        for k, i in enumerate(at):
            if k and i - at[k - 1] <= n:
                want[-1] += t[i + n - (i - at[k - 1]) : i + n]
            else:
                want.append(t[i : i + n])
    assert toxicity.unexplained(toxic, plain) == want
    assert any(b"idiot" in r for r in want)
    assert toxicity.unexplained([], plain) == [] and toxicity.unexplained([b"", b"ab"], []) == []


def test_fitted_scores_and_words_not_met_in_training(spark):
    """Held-out texts are told apart, and verdicts are not those of a list of the training words."""
    rows = [(i, prose(120, 6 if i % 3 == 0 else 0), int(i % 3 == 0)) for i in range(900)]
    rows += [(1000 + i, prose(120) + " " + " ".join(w + R.choice(["s", "ly", "ing"]) for w in R.choices(FOUL, k=8)), 1) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id int, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4 and i < 1000], "doc_id int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [(i, y) for i, _, y in rows if i % 4 == 0 and i < 1000]
    called = [(got[i]["score"] >= 0.7) == bool(y) for i, y in held]
    assert sum(called) >= 0.95 * len(called)
    assert sum(got[1000 + i]["score"] >= 0.7 for i in range(60)) >= 54  # forms that no word list of the training texts holds
    assert all(got[i]["windows"] == len(toxicity.cut_windows(t)) for i, t, _ in rows)


def test_curve_and_measures():
    gains = [np.array([0, 3, -1]), np.array([0])]
    n, gain, most, over = toxicity.measures(gains)
    assert (n.tolist(), gain.tolist(), most.tolist()) == ([3, 1], [2, 0], [3, 0])
    assert over.tolist() == [[1, 1, 1, 0, 0, 0, 0], [0] * 7]
    assert np.allclose(toxicity.constant(0.25).scores(gains), 0.25)
