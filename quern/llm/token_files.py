"""Token-id output: one wavelet matrix per shard, read back by rank and select.

A shard holds the ids of consecutive documents.  Its file is one block of bytes::

    magic "QWM1" | u32 levels | u64 tokens | u64 documents        (little endian)
    i64 doc_id x documents | u32 tokens of each document x documents
    for each level, most significant bit of the ids first:
        u64 zeros | packed bits (little bit order, padded to 64) | u64 ones before each 512 bits

A level's bits are those of the ids in the order that the levels above have put them in:
all with a 0 first, then all with a 1, otherwise in place.  Access, rank (count of an id
before a position) and select (position of its k-th occurrence) need one step a level.

Documents go to parts by doc_id, at keys that the histogram splitter of
:mod:`quern.llm.sharding` finds; there are at most ``MOST_PARTS`` of them, so what the driver
holds does not grow with the input.  Encoding happens before the one exchange, which moves
ids only; each part is sorted and cut into shards of ``SHARD_TOKENS`` as it streams by.
Files are rows of a table in the shared folder (part, shard, start, tokens, file), where
``start`` counts the part's ids before the shard: the commit of the table makes lost or
repeated tasks harmless, and reading needs no exchange.

Cases: null and empty texts have only the end id; documents with the same id stand in the
order of a hash of their texts; a null doc_id comes first; a document longer than a shard
is a shard of its own; an empty table gives no shard; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import emit, slices, spark_ddl
from quern.llm.sharding import LEAST, Splitters
from quern.plans.staging import cut

MAGIC = b"QWM1"
BLOCK = 512
#: Text bytes of the documents in one part, about, and the most parts there are.
PART_BYTES, MOST_PARTS = 16_000_000, 16_384
#: Ids of one shard, about.
SHARD_TOKENS = 1_500_000
#: Text bytes whose different words are encoded together.
SLICE_BYTES = 8_000_000

#: What the library's pre-tokenizer cuts a text into, besides runs of letters.
CUTS = r"'(?:s|t|re|ve|m|ll|d)|\p{N}|[^\s\p{L}\p{N}]+"
#: The pre-tokenizer and normaliser that words are cut and lower-cased for here; other files go to the library whole.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]

ENCODED = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("b", pa.int64()), ("ids", pa.binary())])
FILES = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("start", pa.int64()), ("tokens", pa.int64()), ("file", pa.binary())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("position", pa.int64())])

_encoders: dict[int, WordEncoder] = {}


class WaveletMatrix:
    """Succinct sequence of small integers over bit planes with rank and select."""

    def __init__(self, n: int, planes: list[tuple[int, np.ndarray, np.ndarray]], docs: np.ndarray, sizes: np.ndarray) -> None:
        self.n, self.planes, self.docs, self.sizes = n, planes, docs, sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    @classmethod
    def build(cls, ids: np.ndarray, docs: np.ndarray, sizes: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        planes, seq = [], ids.astype(np.uint16 if levels <= 16 else np.uint32)
        for level in range(levels - 1, -1, -1):
            bits = (seq & seq.dtype.type(1 << level)) != 0
            zeros = seq[~bits]
            seq = np.concatenate([zeros, seq[bits]])
            planes.append((len(zeros), *cls._packed(bits)))
        return cls(len(ids), planes, docs, sizes)

    @staticmethod
    def _packed(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 64, np.uint8)])
        ones = np.bitwise_count(packed.view("<u8")).reshape(-1, 8).sum(axis=1, dtype=np.int64)
        return packed, np.concatenate([[0], np.cumsum(ones)]).astype("<u8")

    def to_bytes(self) -> bytes:
        out = [struct.pack("<4sIQQ", MAGIC, len(self.planes), self.n, len(self.docs)), self.docs.astype("<i8").tobytes(), self.sizes.astype("<u4").tobytes()]
        for zeros, packed, ranks in self.planes:
            out += [struct.pack("<Q", zeros), packed.tobytes(), ranks.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        magic, levels, n, d = struct.unpack_from("<4sIQQ", raw)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = 24
        docs = np.frombuffer(raw, "<i8", d, at)
        sizes = np.frombuffer(raw, "<u4", d, at + 8 * d)
        at += 12 * d
        blocks = -(-n // BLOCK)
        planes = []
        for _ in range(levels):
            (zeros,) = struct.unpack_from("<Q", raw, at)
            planes.append((zeros, np.frombuffer(raw, np.uint8, blocks * 64, at + 8), np.frombuffer(raw, "<u8", blocks + 1, at + 8 + blocks * 64)))
            at += 8 + blocks * 64 + 8 * (blocks + 1)
        return cls(n, planes, docs, sizes)

    def _ones(self, level: int, i: int) -> int:
        """Set bits of a level before position ``i``."""
        _, packed, ranks = self.planes[level]
        block, rest = divmod(i, BLOCK)
        out = int(ranks[block])
        if rest:
            part = packed[block * 64 : block * 64 + (rest + 7) // 8]
            out += int(np.bitwise_count(part[: rest // 8]).sum(dtype=np.int64))
            if rest % 8:
                out += (int(part[rest // 8]) & ((1 << rest % 8) - 1)).bit_count()
        return out

    def _place(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) zero or one of a level."""
        _, packed, ranks = self.planes[level]
        before = ranks.astype(np.int64) if bit else np.arange(len(ranks)) * BLOCK - ranks.astype(np.int64)
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(packed[block * 64 : block * 64 + 64], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        out = 0
        for level, (zeros, packed, _) in enumerate(self.planes):
            bit = int(packed[i >> 3]) >> (i & 7) & 1
            ones = self._ones(level, i)
            i = zeros + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` stands before position ``i``."""
        lo, hi = self._range(token, i)
        return hi - lo

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        if token >> len(self.planes):
            return 0, 0
        for level, (zeros, _, _) in enumerate(self.planes):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (zeros + a, zeros + b) if token >> (len(self.planes) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``token``."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(f"token {token} occurs {hi - lo} times")
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            i = self._place(level, bit, i - self.planes[level][0] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        lo, hi = self._range(token, self.n)
        return [self.select(token, k) for k in range(hi - lo)]

    def tokens(self) -> np.ndarray:
        """All ids in order: the levels' rearrangements undone from the last one up."""
        levels = len(self.planes)
        kind = np.uint16 if levels <= 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for level in range(levels - 1, -1, -1):
            zeros, packed, _ = self.planes[level]
            bits = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            back = np.empty(self.n, kind)
            back[~bits] = seq[:zeros]
            back[bits] = seq[zeros:] | kind(1 << (levels - 1 - level))
            seq = back
        return seq

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the shard."""
        return np.array([self.access(i) for i in range(int(self.starts[k]), int(self.starts[k + 1]))], dtype=np.int64)


class WordEncoder:
    """The tokenizers library's ids of texts, made word by word.

    White space ends every token of a model with word ends, so words are independent: a batch
    of texts is lower-cased and cut into words in Arrow, each different word of the batch is
    encoded once, and the ids are put back in the words' places.  The words themselves go
    through a merger made of the file's merges, with a space as the word's end.  Texts that
    the library may normalise or cut in another way go to it whole, as do all texts where
    the file is of another kind.
    """

    def __init__(self, raw: bytes, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.end = end_id
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 and end_id < 65536 else "<u4")
        self.core = None
        form = json.loads(raw)
        if self._of_words(form):
            self._merger(form["model"])

    @staticmethod
    def _of_words(form: dict) -> bool:
        model, cuts, normal = form["model"], form.get("pre_tokenizer") or {}, form.get("normalizer") or {}
        split = [c.get("pattern", {}).get("Regex") for c in cuts.get("pretokenizers", [])]
        steps = [n["type"] for n in normal.get("normalizers", [])]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
        return model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and plain and split == [SPLIT, None] and steps == NORMALIZERS

    def _merger(self, model: dict) -> None:
        """Bytes, bytes that end a word, and then the merges, each ranked as the file has them."""
        printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printed)}
        vocab = model["vocab"]
        single = [t for t in vocab if len(t.removesuffix("</w>")) == 1]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks, ids = {}, []
        for token in [*sorted(single, key=lambda t: t.endswith("</w>")), *(a + b for a, b in merges)]:
            spelt = bytes(byte_of[c] for c in token.removesuffix("</w>"))
            if b" " not in spelt:
                ranks.setdefault(spelt + b" " * token.endswith("</w>"), len(ids))
                ids.append(vocab[token])
        self.ids = np.array(ids, self.kind)
        self.ends = np.zeros(len(ids), bool)
        self.ends[[k for spelt, k in ranks.items() if spelt.endswith(b" ")]] = True
        self.core = tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _odd(texts: pa.Array) -> np.ndarray:
        """Which texts hold more than Latin letters, odd white space, a capital that is two letters in lower case, or a special token."""
        ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8, ends[-1])[ends[0] :]
        bad = (raw > 0xC9) | ((raw >= 0x1C) & (raw < 0x20))
        pair, then = raw[:-1], raw[1:]
        bad[:-1] |= (pair == 0xC9) & (then >= 0x90) | (pair == 0xC2) & ((then == 0x85) | (then == 0xA0)) | (pair == 0xC4) & (then == 0xB0) | (pair == ord("<")) & (then == ord("|"))
        out = np.zeros(len(texts), bool)
        out[np.searchsorted(ends - ends[0], np.flatnonzero(bad), "right") - 1] = True
        return out

    def _of_different(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the words, and where those of each start and how many there are."""
        full = np.asarray(pc.binary_length(words)) > 0
        joined = pc.binary_join_element_wise(words.filter(pa.array(full)), "", " ")
        ends = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1, joined.offset * 4) if len(joined) else [0, 0]
        ranks = self.core.encode_to_numpy(joined.buffers()[2].to_pybytes()[ends[0] : ends[-1]].decode(), disallowed_special=()) if ends[-1] else np.zeros(0, np.uint32)
        stop = np.flatnonzero(self.ends[ranks]) + 1
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[full], sizes[full] = np.append(0, stop[:-1])[: len(stop)], np.diff(stop, prepend=0)
        return self.ids[ranks], starts, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the end id, and how many each has."""
        texts = pc.fill_null(texts, "")
        odd = self._odd(texts) if self.core else np.ones(len(texts), bool)
        alone = {int(k): self.tokenizer.encode(texts[int(k)].as_py(), add_special_tokens=False).ids for k in np.flatnonzero(odd)}
        if len(alone) == len(texts):
            ids, sizes = np.zeros(0, self.kind), np.zeros(len(texts), np.int64)
        else:
            plain = pc.if_else(pa.array(odd), "", texts) if alone else texts
            lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), CUTS, r" \0 "))
            coded = lists.flatten().dictionary_encode()
            pool, starts, counts = self._of_different(coded.dictionary)
            code = np.asarray(coded.indices)
            n, first = counts[code], starts[code]
            upto = np.cumsum(n)
            ids = pool[np.repeat(first - upto + n, n) + np.arange(upto[-1] if len(n) else 0)]
            bounds = np.append(0, upto)[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
            sizes = np.diff(bounds)
        stop = np.cumsum(sizes)
        if alone:
            parts = np.split(ids, stop)[:-1]
            for k, found in alone.items():
                parts[k] = np.array(found, self.kind)
            ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
            stop = np.cumsum(sizes)
        return np.insert(ids, stop, self.kind.type(self.end)), sizes + 1


def encoder(raw: bytes, end_id: int) -> WordEncoder:
    key = hash((raw, end_id))
    return _encoders.get(key) or _encoders.setdefault(key, WordEncoder(raw, end_id))


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, part_bytes: int = PART_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards of ``docs(doc_id, text)``; the table of files (part, shard, start, tokens, file)."""
    with open(tokenizer_path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text).alias("b"))
    sizes = docs.select(F.coalesce("doc_id", F.lit(LEAST)).alias("a"), "b", (F.octet_length(text) + 1).cast("long").alias("size"))
    splitters = Splitters.by_size(sizes, part_bytes, MOST_PARTS)
    encoded = docs.mapInArrow(_encoding(raw, end_id, splitters), spark_ddl(ENCODED))
    dealt = encoded.repartitionById(splitters.parts, F.col("part")).sortWithinPartitions("part", "doc_id", "b")
    return cut(dealt.mapInArrow(_writing(raw, end_id, shard_tokens), spark_ddl(FILES)), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files."""
    return files.select(*FILES.names).mapInArrow(_reading(_bases(files)), spark_ddl(READ))


def count_token(files: DataFrame, token: int) -> DataFrame:
    """How often ``token`` stands in each shard (part, shard, occurrences), by rank."""
    return files.select("part", "shard", "file").mapInArrow(_ranking(token), "part int, shard long, occurrences long")


def find_token(files: DataFrame, token: int) -> DataFrame:
    """doc_id and position (over all ids, in order) of every occurrence of ``token``, by select."""
    return files.select(*FILES.names).mapInArrow(_selecting(token, _bases(files)), spark_ddl(FOUND))


def _bases(files: DataFrame) -> dict[int, int]:
    """Ids before each part; there are at most ``MOST_PARTS``."""
    total = dict(files.groupBy("part").agg(F.sum("tokens")).collect())
    out, at = {}, 0
    for part in sorted(total):
        out[part], at = at, at + total[part]
    return out


def _encoding(raw, end_id: int, splitters: Splitters) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(raw.value, end_id)
        for part in slices(batches, limit=SLICE_BYTES):
            docs, b = part.column("doc_id"), part.column("b")
            ids, sizes = coder.encode(part.column("text"))
            offsets = np.append(0, np.cumsum(sizes * coder.kind.itemsize)).astype(np.int32)
            cells = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            where = splitters.locate(np.asarray(docs.fill_null(LEAST)), np.asarray(b)).astype(np.int32)
            yield emit({"part": where, "doc_id": docs, "b": b, "ids": cells}, ENCODED)

    return run


def _writing(raw, end_id: int, shard_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cut rows sorted by part and key into files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(raw.value, end_id).kind
        part, shard, start, held, size = None, 0, 0, [], 0

        def file() -> pa.RecordBatch:
            docs, sizes, ids = (np.concatenate(x) for x in zip(*held))
            raw_file = WaveletMatrix.build(ids, docs, sizes).to_bytes()
            return emit({"part": [part], "shard": [shard], "start": [start], "tokens": [len(ids)], "file": [raw_file]}, FILES)

        for batch in batches:
            parts = np.asarray(batch.column("part"))
            docs = np.asarray(batch.column("doc_id").fill_null(LEAST))
            cells = batch.column("ids")
            ends = np.frombuffer(cells.buffers()[1], np.int32, len(cells) + 1, cells.offset * 4) // kind.itemsize
            ids = np.frombuffer(cells.buffers()[2] or b"", kind, ends[-1])
            at = 0
            while at < len(docs):
                if part != parts[at]:
                    if held:
                        yield file()
                    part, shard, start, held, size = int(parts[at]), 0, 0, [], 0
                to = min(int(np.searchsorted(ends, ends[at] + shard_tokens - size, "left")), int(np.searchsorted(parts, part, "right")))
                to = max(at + 1, to)
                held.append((docs[at:to], np.diff(ends[at : to + 1]), ids[ends[at] : ends[to]].copy()))
                size += int(ends[to] - ends[at])
                at = to
                if size >= shard_tokens:
                    yield file()
                    shard, start, held, size = shard + 1, start + size, [], 0
        if held:
            yield file()

    return run


def _doc_ids(docs: np.ndarray) -> pa.Array:
    return pa.array(docs, mask=docs == LEAST)


def _reading(bases: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, start, file in _rows(batches, "part", "start", "file"):
            matrix = WaveletMatrix.from_bytes(file)
            ids, s = matrix.tokens().astype("<u4"), matrix.starts
            crc = [zlib.crc32(ids[a:b].data) for a, b in zip(s[:-1].tolist(), s[1:].tolist(), strict=True)]
            yield emit({"doc_id": _doc_ids(matrix.docs), "start": s[:-1] + (bases[part] + start), "n_tokens": np.diff(s), "ids_crc32": crc}, READ)

    return run


def _ranking(token: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shard, file in _rows(batches, "part", "shard", "file"):
            matrix = WaveletMatrix.from_bytes(file)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": [shard], "occurrences": [matrix.rank(token, matrix.n)]})

    return run


def _selecting(token: int, bases: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, start, file in _rows(batches, "part", "start", "file"):
            matrix = WaveletMatrix.from_bytes(file)
            at = np.array(matrix.occurrences(token), np.int64)
            docs = matrix.docs[np.searchsorted(matrix.starts, at, "right") - 1]
            yield emit({"doc_id": _doc_ids(docs), "position": at + (bases[part] + start)}, FOUND)

    return run


def _rows(batches: Iterator[pa.RecordBatch], first: str, second: str, file: str) -> Iterator[tuple[int, int, pa.Buffer]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column(first)[k].as_py(), batch.column(second)[k].as_py(), batch.column(file)[k].as_buffer()
