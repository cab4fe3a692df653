import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quern.llm.token_files import WaveletMatrix, WordEncoder, count_token, find_token, read_token_files, write_token_files


@pytest.fixture(scope="module")
def words():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        return WordEncoder(f.read(), 2)


def test_wavelet_matrix_answers_like_a_list():
    r = random.Random(3)
    for n, top in ((0, 5), (1, 0), (700, 3), (3000, 49407), (513, 70000)):
        seq = [r.randint(0, top) if r.random() < 0.5 else min(7, top) for _ in range(n)]
        m = WaveletMatrix.from_bytes(WaveletMatrix.build(np.array(seq, np.int64), np.array([4]), np.array([n])).to_bytes())
        assert m.tokens().tolist() == seq
        for i in r.sample(range(n), min(n, 40)):
            assert m.access(i) == seq[i]
            assert m.rank(seq[i], i) == seq[:i].count(seq[i])
            assert seq[m.select(seq[i], seq[:i].count(seq[i]))] == seq[i]
        t = seq[0] if seq else 3
        assert m.occurrences(t) == [i for i, x in enumerate(seq) if x == t]
        assert m.rank(1 << 20, n) == 0
        with pytest.raises(IndexError):
            m.select(t, n + 1)


def test_words_encode_as_whole_texts(words):
    r = random.Random(5)
    alphabet = "abcXYZ É's|~. ,!9²ªß\n\t\x1c\x85\xa0 <|endoftext|> ΣσЖ日́'re'LL"
    texts = ["", " ", "it's O'Re'ady .'s 'S 'twas", "a|b | c~", "ΟΔΟΣ", "É É", "<|endoftext|>x", "x" * 300, "İstanbul ıI"]
    latin = [chr(c) for c in range(0x20, 0x250)]
    texts += ["".join(r.choice(latin) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(r.choice("aeé ñüßçèöÀÉ.,") for _ in range(r.randint(0, 60))) for _ in range(500)]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    want = [e.ids + [2] for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids, sizes = words.encode(pa.array(["front", *texts, None]).slice(1, len(texts)))
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    bad = [(t, a, b) for t, a, b in zip(texts, want, got, strict=True) if a != b]
    assert not bad, bad[:3]


def test_long_words_and_other_files(words):
    r = random.Random(8)
    long = "".join(r.choice("abcdéñ") for _ in range(400_000))
    ids, sizes = words.encode(pa.array([long, None, "a " * 100_000]))
    assert sizes.tolist()[1:] == [1, 100_001] and ids[-1] == 2
    assert ids[: sizes[0]].tolist() == [*words.tokenizer.encode(long, add_special_tokens=False).ids, 2]
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        other = WordEncoder(f.read(), 70_000)
    ids, sizes = other.encode(pa.array(["Some text.", ""]))
    assert other.core is None and ids.tolist() == [*other.tokenizer.encode("Some text.").ids, 70_000, 70_000] and sizes[1] == 1


def test_files_round_trip(spark, words):
    import zlib

    rows = [(5, "five it's"), (1, None), (9, ""), (3, "three | bars " * 50), (-2, "minus"), (7, "long" * 900), (None, "no id"), (4, "twice"), (4, "twice more")]
    for kind, part_bytes, shard_tokens in (("long", 500, 40), ("int", 1 << 30, 1 << 30), ("int", 1, 1)):
        docs = spark.createDataFrame([(i, t, 1) for i, t in rows], f"doc_id {kind}, text string, start int")
        files = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), part_bytes=part_bytes, shard_tokens=shard_tokens)
        assert (files.count() > 1) == (part_bytes < 1 << 30)
        got = sorted(read_token_files(files).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
        start, held, seen = 0, [], []
        for r in got:
            t = [t for i, t in rows if i == r["doc_id"]]
            encoded = [[*words.tokenizer.encode(x or "", add_special_tokens=False).ids, 2] for x in t]
            ids = next(e for e in encoded if zlib.crc32(np.array(e, "<u4").tobytes()) == r["ids_crc32"])
            assert (r["start"], r["n_tokens"]) == (start, len(ids))
            start += len(ids)
            held += ids
            seen += [r["doc_id"]] * len(ids)
        token = held[3]
        assert count_token(files, token).groupBy().sum("occurrences").first()[0] == held.count(token)
        found = [(r["doc_id"], r["position"]) for r in find_token(files, token).collect()]
        assert sorted(found, key=lambda x: x[1]) == [(seen[i], i) for i, x in enumerate(held) if x == token]
    empty = write_token_files(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"))
    assert read_token_files(empty).count() == 0 and find_token(empty, 5).count() == 0
