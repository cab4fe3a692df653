"""Operators on small tables against brute force, with nulls, empty, long and repeated texts and clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash

from quern.llm import decontaminate, line_dedup, near_copies, simhash
from quern.llm.exact_dedup import dedup_exact
from quern.llm.line_dedup import dedup_lines
from quern.llm.pieces import PieceCodec, digest_pieces, encode_pieces
from quern.llm.quality import DIAGONAL, NAMES, POOL, Discriminant, features, fit_quality, keep_good, score_quality, statistics
from quern.llm.sharding import shard_documents
from quern.llm.simhash import near_groups
from quern.llm.token_counts import count_tokens
from quern.llm.toxicity import score_toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, score double, size long, shard int, component_id long, n_tokens long, keep_id long, n_lines long, tiles long"
LONG = "The quick brown fox jumps over the lazy dog again and again.\n" * 800 + "x" * 5000


def table(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 7, 7, 7, 7, 7, 7, 7) for i, t in rows], SCHEMA)


ROWS = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one two three four five"),
    (5, "one two  three\tfour five"),
    (5, "one two  three\tfour five"),
    (6, "One two three four five"),
    (7, LONG),
    (8, LONG + " "),
    (9, "é日本語🙂 ▁ <s> <0x0A> a  b "),
    (None, "no id at all"),
    (-3, "one two three four five"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS)


def by_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_token_counts(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for i, t in ROWS:
        n = len(sp.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 4096))
    assert by_rows(count_tokens(docs, MODEL), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert count_tokens(docs.limit(0), MODEL).count() == 0


def test_piece_codec_is_the_library(spark):
    with open(MODEL, "rb") as f:
        raw = f.read()
    sp, codec, r = sentencepiece.SentencePieceProcessor(model_proto=raw), PieceCodec(raw), random.Random(7)
    pieces = [p for p in codec.ids]
    texts = ["".join(r.choice("abeinrst  ▁\n\té日本のa1🙂.,-_xX<0>=═") for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(r.choice("▁ ab") for _ in range(r.randint(0, 60))) for _ in range(500)]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(1, 10))) for _ in range(1500)]
    for t in texts:
        ids = sp.encode(t)
        assert codec.encode(t) == ids, t
        assert codec.decode(ids) == sp.decode(ids), t


def test_pieces(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in ROWS:
        ids = sp.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert by_rows(digest_pieces(docs, MODEL), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    got = [(r["doc_id"], len(r["ids"]), sha(",".join(map(str, r["ids"]))), sha(r["decoded"])) for r in encode_pieces(docs, MODEL).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert digest_pieces(docs.limit(0), MODEL).count() == 0


def test_sharding(spark, docs):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("ab ") for _ in range(r.randint(0, 200)))) for i in range(300)] + [(1000 + i, "copy " * 30) for i in range(250)] + ROWS
    out = shard_documents(table(spark, rows).withColumnRenamed("tiles", "slot"), shards=4).collect()
    assert len(out) == len(rows)
    sizes, slots = defaultdict(int), defaultdict(list)
    for x in out:
        assert x["size"] == len((x["text"] or "").encode()) + 1
        sizes[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    whole = shard_documents(table(spark, rows[:550]), shards=4).groupBy("shard").sum("size").collect()
    assert len(whole) == 4 and max(s[1] for s in whole) < 1.05 * min(s[1] for s in whole)
    assert shard_documents(docs.limit(0), shards=4).count() == 0


def exact_want(rows):
    groups = defaultdict(list)
    for i, t in rows:
        t = t or ""
        groups["".join(c for c in t if c not in " \t\n\x0b\x0c\r")].append((-len(t), i is None, i))
    out = []
    for i, t in rows:
        body = "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
        keep = min(groups[body], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((i, keep, len(groups[body]), i == keep, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup(spark, docs):
    r = random.Random(2)
    stem = "".join(r.choice("abcdefgh") for _ in range(6000))
    rows = ROWS + [(100 + i, stem[: r.choice((63, 64, 65, 575, 576, 577, 4672, 4673, 5999, 6000))] + r.choice(("", " ", "z"))) for i in range(120)]
    rows += [(500 + i, "same text") for i in range(200)]
    assert by_rows(dedup_exact(table(spark, rows)), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == exact_want(rows)
    assert dedup_exact(docs.limit(0)).count() == 0


def lines_want(rows):
    white, lower = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(white).translate(lower)
    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(-(1 << 63) if i is None else i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        own = -(1 << 63) if i is None else i
        kept = [x for x in parts if gone.get(key(x), own) == own]
        out.append((i, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("probe_bytes", "hot_lines"), [(1 << 30, 100), (0, 100), (0, 10_000), (0, 1)])
def test_line_dedup(spark, docs, probe_bytes, hot_lines, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    r = random.Random(4)
    pool = [f"this is the repeated line number {k}" + " É" * (k % 3) for k in range(80)] + ["short", "", "exactly twenty chars"]
    rows = ROWS + [(1000 + i, "\n".join(r.choice((str.upper, str, lambda s: f" \t{s}\r"))(r.choice(pool)) for _ in range(r.randint(0, 9)))) for i in range(90)]
    out = dedup_lines(table(spark, rows), probe_bytes=probe_bytes, hot_lines=hot_lines)
    assert by_rows(out, "doc_id", "text", "n_lines", "n_dropped") == lines_want(rows)
    assert set(out.columns) == {*table(spark, []).columns, "n_dropped"}
    assert dedup_lines(docs.limit(0), probe_bytes=probe_bytes).count() == 0


class Sent:
    """A broadcast whose place in memory is used again for the next one."""

    value = None


def text_batch(rows):
    return pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})


def test_line_dedup_after_an_index_at_the_same_address():
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
    sent = Sent()
    for line in ("a line that many documents hold", "another line that many documents hold"):
        rows = [(i, f"{line}\nown line {i}") for i in range(4)]
        (keys,) = line_dedup._line_keys(20)([text_batch(rows)])
        index = line_dedup.LineIndex.build(np.asarray(keys.column("h1"))[:1], np.asarray(keys.column("h2"))[:1], np.array([4]), np.array([3]))
        sent.value = [(0, index.to_bytes())]
        (got,) = line_dedup._rewrite(sent, 1, 20, out)([text_batch(rows)])
        assert [tuple(x.values()) for x in got.to_pylist()] == lines_want(rows)


def near_want(rows, n, distance):
    prints = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        parts = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    ids = [-(1 << 63) if i is None else i for i, _ in rows]
    label = dict.fromkeys(ids)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= distance and label[ids[b]] < label[ids[a]]:
                    label[ids[a]] = label[ids[b]]
                    changed = True
    return sorted(((i, f"{p:016x}", label[k]) for (i, _), p, k in zip(rows, prints, ids, strict=True)), key=repr)


@pytest.mark.parametrize("block", [4096, 3])
def test_simhash_groups(spark, docs, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(5)
    base = [f"w{k}" for k in range(900)]
    rows = list(ROWS)
    for i in range(60):
        words = list(base)
        for _ in range(r.randint(0, 3)):
            words[r.randrange(900)] = "changed" + str(r.randint(0, 5))
        rows.append((2000 + i, " ".join(words)))
    assert by_rows(near_groups(table(spark, rows)), "doc_id", "fingerprint", "component_id") == near_want(rows, 3, 2)
    assert near_groups(docs.limit(0)).count() == 0


def test_near_copies_by_five_word_shingles(spark):
    r = random.Random(6)
    make = lambda: [f"{r.choice('abcdefg')}{r.randint(0, 3000)}" for _ in range(300)]
    rows, group = [], {}
    for g in range(25):
        words = make()
        for k in range(3):
            copy = list(words)
            for _ in range(3 * (k > 0)):
                copy[r.randrange(300)] = "other"
            rows.append((g * 10 + k, " ".join(copy)))
            group[g * 10 + k] = g * 10
    rows += [(900 + k, " ".join(make())) for k in range(25)]
    got = {x["doc_id"]: x["component_id"] for x in near_groups(table(spark, rows), simhash.NEAR).collect()}
    assert all(got[i] == i for i in range(900, 925))
    assert sum(got[i] == g for i, g in group.items()) >= 0.95 * len(group)


def blocks_changed(seed, shares):
    """Random texts and copies with one contiguous block appended, cut off or replaced."""
    r, rows = random.Random(seed), []
    make = lambda n: [f"{r.choice('abcdefg')}{r.randint(0, 3000)}" for _ in range(n)]
    for g in range(60):
        n = r.choice((30, 120, 300))
        words, k = make(n), int(n * r.uniform(*shares))
        at = r.randrange(n - k)
        copy = (words + make(k), words[:-k], words[:at] + make(k // 2) + words[at + k // 2 :])[g % 3]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(copy))]
    return rows


def jaccard(x, y):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.lower().split(), y.lower().split()))
    return len(a & b) / len(a | b)


def jaccard_want(rows):
    """Least doc_id reachable over links of a similarity of 0.8, looking at every pair."""
    label = {i: i for i, _ in rows}
    links = [(i, j) for i, x in rows for j, y in rows if i < j and jaccard(x, y) >= 0.8]
    for _ in rows:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_near_copies_with_a_block_changed(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "PAIRS", 50)
    rows = [x for g in range(3) for x in [(1000 * g + i, t) for i, t in blocks_changed(20 + g, (0.1, 0.25))]]
    similar = [jaccard(rows[k][1], rows[k + 1][1]) for k in range(0, len(rows), 2)]
    assert sum(0.8 <= x < 0.85 for x in similar) >= 20
    got = {x["doc_id"]: x["component_id"] for x in near_groups(table(spark, rows), simhash.NEAR).collect()}
    assert got == {i: i - i % 2 * (similar[k // 2] >= 0.8) for k, (i, _) in enumerate(rows)}


def test_links_of_near_copies_are_confirmed(spark):
    rows = [x for g in range(2) for x in [(1000 * g + i, t) for i, t in blocks_changed(30 + g, (0.22, 0.45))]]
    words = [f"chain{k}" for k in range(400)]
    rows += [(5000 + k, " ".join(words[25 * k : 25 * k + 200])) for k in range(8)]  # each like the next, not like the one after
    rows += [(6000 + k, " ".join(words[9 * k : 9 * k + 100])) for k in range(8)] + [(7000, None), (7001, " "), (7002, "few words"), (7003, "Few  words")]
    similar = [jaccard(x, y) for (_, x), (_, y) in zip(rows[:-20:2], rows[1:-20:2], strict=True)]
    assert sum(0.6 <= x < 0.8 for x in similar) >= 50
    got = {x["doc_id"]: x["component_id"] for x in near_groups(table(spark, rows), simhash.NEAR).collect()}
    assert got == jaccard_want([(i, t or "") for i, t in rows])


def tile_want(doc, item, least):
    """Tiles by looking at every pair of places again for each tile."""
    free_d, free_i, total = set(range(len(doc))), set(range(len(item))), 0
    while True:
        best = 0
        for d in range(len(doc)):
            for i in range(len(item)):
                k = 0
                while d + k in free_d and i + k in free_i and doc[d + k] == item[i + k]:
                    k += 1
                if k > best:
                    best, at = k, (d, i)
        if best < least:
            return total
        total += best
        free_d -= set(range(at[0], at[0] + best))
        free_i -= set(range(at[1], at[1] + best))


def test_greedy_string_tiling():
    r = random.Random(8)
    for _ in range(60):
        item = [r.choice("abcdefghijklmnop") for _ in range(r.randint(5, 40))]
        cut = r.randint(0, len(item))
        doc = [r.choice("xyz") for _ in range(r.randint(0, 20))] + item[cut:] + ["q"] + item[:cut]
        block = decontaminate.ItemBlock([(1, " ".join(item))], 0.0)
        found = [sum(t[2] for t in tiles) for _, _, tiles in block.search([" ".join(doc)])]
        assert (found or [0]) == [tile_want(doc, item, min(5, len(item)))]


def test_decontamination(spark, docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    words = item.split()
    moved = "noise here " + " ".join(words[10:]) + " between. " + " ".join(words[:10]) + " end"
    rows = ROWS + [(20, "Before, " + item.upper() + "! After"), (21, moved), (22, " ".join(words[:12])), (23, " ".join(reversed(words)))]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two three four five"), (5, "unseen words only here now")], "item_id long, text string")
    for block_bytes in (1 << 20, 40):
        got = decontaminate.find_contaminated(table(spark, rows), bench, block_bytes=block_bytes)
        assert sorted({(r["doc_id"], r["item_id"]) for r in got.collect()}) == [(-3, 4), (4, 4), (5, 4), (6, 4), (20, 1), (21, 1)]
    kept = decontaminate.drop_contaminated(table(spark, rows), bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((i for i, _ in rows if i not in (-3, 4, 5, 6, 20, 21)), key=repr)
    assert decontaminate.find_contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.find_contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_of_short_sentences_moved(spark):
    sentences = ["Who came first", "Nobody knew it then", "The old miller told us", "We all laughed", "Rain fell all night", "Bread was dear"]
    r = random.Random(12)
    moved = [r.sample(sentences, len(sentences)) for _ in range(8)] + [sentences[::-1]]
    rows = [(i, "Some words before. " + ". Now. ".join(x) + ". And after") for i, x in enumerate(moved)]
    rows += [(50, ". ".join(sentences[:4])), (51, " ".join(" ".join(x.split()[::-1]) for x in sentences))]
    bench = spark.createDataFrame([(1, ". ".join(sentences))], "item_id long, text string")
    got = {x["doc_id"]: x for x in decontaminate.find_contaminated(table(spark, rows), bench).collect()}
    assert sorted(got) == list(range(9))
    assert all(x["covered_words"] == x["item_words"] == 22 and x["coverage"] == 1.0 for x in got.values())
    assert sorted(x["doc_id"] for x in decontaminate.drop_contaminated(table(spark, rows), bench).collect()) == [50, 51]


def test_decontamination_after_a_block_at_the_same_address():
    sent, items = Sent(), []
    sent.value = (0.8, items)
    rows = [(i, f"text {i} holds passage number {i} of the benchmark here") for i in range(3)]
    for i in range(3):
        items[:] = [(i, f"passage number {i} of the benchmark")]
        (got,) = decontaminate._finding(sent)([text_batch(rows)])
        assert got.column("doc_id").to_pylist() == got.column("item_id").to_pylist() == [i]
        (kept,) = decontaminate._dropping(sent)([text_batch(rows)])
        assert kept.column("doc_id").to_pylist() == [k for k in range(3) if k != i]


def labelled(spark, value, n=400):
    """Half the texts carry marks of toxicity and of poor quality; labels for all."""
    r = random.Random(9)
    rows, labels = [], []
    plain = [f"{a}{b}{c}" for a in ("tha", "on", "er", "inn") for b in ("re", "st", "ion") for c in ("ble", "ly", "an", "")]
    for i in range(n):
        words = [r.choice(plain) for _ in range(60)]
        bad = i % 2 == 0
        if bad and value == "toxic":
            for w in r.sample(["idiot", "worthless", "pathetic", "disgusting"], 2):
                words.insert(r.randrange(60), w)
        if bad and value == "quality":
            words = [w + r.choice(("%%%", "###", "&&&")) for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad) if value == "toxic" else int(not bad)))
    return table(spark, rows), spark.createDataFrame(labels, f"doc_id long, {value} int")


@pytest.mark.parametrize("value", ["toxic", "quality"])
def test_classifiers(spark, docs, value):
    f = score_toxicity if value == "toxic" else score_quality
    texts, labels = labelled(spark, value)
    held = labels.filter(labels.doc_id % 4 == 3).unionAll(labels.filter(labels.doc_id % 8 == 4))
    want = {r["doc_id"]: r[value] for r in held.collect()}
    got = {r["doc_id"]: r["score"] for r in f(texts, labels.join(held, "doc_id", "left_anti")).collect()}
    assert len(got) == 400
    assert sum((got[i] >= 0.7) == bool(y) for i, y in want.items()) >= 0.95 * len(want)
    odd = f(docs.unionByName(texts), labels).collect()
    assert len(odd) == 400 + len(ROWS) and all(0 <= r["score"] <= 1 for r in odd)
    assert f(docs.limit(0), labels).count() == 0
    assert all(0 <= r["score"] <= 1 for r in f(docs, labels.limit(0)).collect())


def test_query_digests(spark, tmp_path):
    """The registered queries over a small table, held against the operators' contracts."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from quern.llm.queries import QUERIES

    r = random.Random(11)
    rows = ROWS[:9] + [(50 + i, " ".join(r.choice(("stupid", "fine", "word", "text")) for _ in range(40))) for i in range(30)]
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows], "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": pa.array([len(t or "") for _, t in rows], pa.int64())}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([50 + i for i in range(30)], pa.int64()), "quality": pa.array([i % 2 for i in range(30)], pa.int32()), "toxic": pa.array([int(i % 3 == 0) for i in range(30)], pa.int32())}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": ["one two three four five"]}), tmp_path / "benchmark.parquet")
    for name, q in QUERIES.items():
        out = q(spark, str(tmp_path))
        got = out.collect()
        if name == "op9_decontaminate":
            assert {x["doc_id"] for x in got} == {4, 5, 6}
        else:
            assert len(got) == len(rows), name
        if name == "op5_sharding":
            assert all(x["text_crc32"] == zlib.crc32((dict(rows)[x["doc_id"]] or "").encode()) and x["law"] == "bytes" and x["grown_shard"] is None for x in got)


def test_operators_take_int_ids(spark):
    rows = [(1, "one line of more than twenty letters"), (2, "one line of more than twenty letters"), (None, "one line of more than twenty letters\nand more"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    bench = spark.createDataFrame([(7, "one line of more than twenty letters")], "item_id int, text string")
    for probe_bytes in (1 << 30, 0):
        out = dedup_lines(docs, probe_bytes=probe_bytes)
        assert out.schema["doc_id"].dataType.typeName() == "integer"
        assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in out.collect()) == [(0, 1), (1, 1), (2, 0), (2, 0)]
    assert near_groups(docs).count() == near_groups(docs, simhash.NEAR).count() == 4
    assert decontaminate.find_contaminated(docs, bench).count() == 3
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()] == [2]
    assert decontaminate.find_contaminated(docs, bench, least_words=8).count() == 0
    assert shard_documents(docs, 2).count() == dedup_exact(docs).count() == 4


def test_quality_is_the_discriminant_computed_naively(spark):
    texts, labels = labelled(spark, "quality", 200)
    rows = {r["doc_id"]: np.array(statistics(r["text"])) for r in texts.collect()}
    want = defaultdict(list)
    for r in labels.collect():
        want[r["quality"]].append(rows[r["doc_id"]])
    model = fit_quality(features(texts), labels)
    n = {y: len(v) for y, v in want.items()}
    cov = {y: np.cov(np.array(v).T, bias=True) for y, v in want.items()}
    x = np.array(list(rows.values()))
    plain = Discriminant.fit([float(n[y]) for y in (0, 1)], [np.sum(want[y], axis=0) for y in (0, 1)], [np.array(want[y]).T @ np.array(want[y]) for y in (0, 1)])
    assert np.allclose(model.log_ratio(x), plain.log_ratio(x), atol=1e-5)
    for y in (0, 1):
        assert np.allclose(model.means[y], np.mean(want[y], axis=0))
        assert cov[y].shape == (len(NAMES), len(NAMES)) and 0 < POOL < 1 and 0 < DIAGONAL < 1
    good = {r["doc_id"] for r in keep_good(texts, labels, 0.5).collect()}
    scored = {r["doc_id"]: r["score"] for r in score_quality(texts, labels).collect()}
    assert good == {i for i, s in scored.items() if s >= 0.5} and 80 <= len(good) <= 120


def test_shards_keep_equal_texts_together_within_the_tolerance(spark):
    r = random.Random(2)
    rows = [(i, "x" * r.randint(0, 60) + str(r.randint(0, 40))) for i in range(3000)] + [(5000 + i, "a hot text of a third of all rows") for i in range(1500)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    total = sum(x["size"] for x in got)
    size, shards, slots = defaultdict(int), defaultdict(set), defaultdict(list)
    for x in got:
        size[x["shard"]] += x["size"]
        shards[x["text"]].add(x["shard"])
        slots[x["shard"]].append(x["slot"])
    assert all(abs(v - total / 8) <= 0.02 * total / 8 + 100 for v in size.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    torn = [t for t, s in shards.items() if len(s) > 1]
    assert all(sum(len(x["text"]) + 1 for x in got if x["text"] == t) > 0.01 * total / 8 for t in torn)
