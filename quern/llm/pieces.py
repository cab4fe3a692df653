"""SentencePiece encoding and decoding of merge-type (BPE) models, without the encoder of the library.

A sequence of pieces is what merging would have produced if and only if every two
neighbours are: re-merging the two together gives the two back.  So a text is encoded
from left to right by backtracking: take the longest piece that starts here (found with
an Aho-Corasick automaton over the vocabulary), fall back to ever shorter ones until the
piece agrees with its left neighbour, and give the position up when none does.  A
field of flags remembers the positions given up, so every position fails at most once.

Cases: null and empty texts have no ids and decode to the empty text; characters outside
the vocabulary become byte pieces; control pieces written out in a text are ordinary
text; ids that are no valid UTF-8 when decoded give U+FFFD; repeated rows are encoded row
by row; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from quern.llm.arrow import emit, slices, spark_ddl, texts

SPACE = "▁"
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
#: Segments in the younger half of a worker's memory; when it is full, it becomes the older half.
MEMO_ENTRIES = 250_000
MEMO_CHARS = 64
#: Pairs of pieces whose compatibility a worker remembers.
PAIR_ENTRIES = 400_000

_codecs: dict[int, PieceCodec] = {}


class PieceCodec:
    """Encoder and decoder for one SentencePiece BPE model."""

    def __init__(self, model: bytes) -> None:
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        scores = sorted({library.get_score(i) for i in normal}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        #: 0 merges first; equal scores have equal ranks and merge from the left.
        self.rank = {self.pieces[i]: place[library.get_score(i)] for i in normal}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if library.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = library.unk_id()
        self.silent = {i for i in range(size) if library.is_control(i)} | {self.unknown}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.known = set(self.ids)
        self.segment = self._cuts()
        self.shorter: dict[str, str] = {}
        self.spines: dict[str, tuple[list, list]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}

    def _cuts(self) -> re.Pattern:
        """Segments that no piece reaches over: spaces, then characters of one class.

        Two characters are of one class if some piece has them side by side, directly or
        through others; characters of no class stand alone.
        """
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return re.compile(r"(?s).+")
        leader: dict[str, str] = {}

        def find(c: str) -> str:
            while leader.setdefault(c, c) != c:
                c = leader[c]
            return c

        for p in self.ids:
            p = p.lstrip(SPACE)
            for x, y in zip(p, p[1:]):
                leader[find(x)] = find(y)
        classes: dict[str, list[str]] = {}
        for c in leader:
            classes.setdefault(find(c), []).append(c)
        runs = [f"[{re.escape(''.join(sorted(v)))}]+" for v in sorted(classes.values(), key=len, reverse=True)]
        return re.compile(rf"(?s) *(?:{'|'.join([*runs, '[^ ]'])})| +")

    # Merging, for single pieces and for pairs.

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: the best-ranked neighbours first, from the left."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def spine(self, piece: str) -> tuple[list, list]:
        """The symbols at the piece's right and left edge while it is merged.

        Each is (symbol, rank of the merge that made it, rank of the merge that took it).
        """
        if (known := self.spines.get(piece)) is not None:
            return known
        never = len(self.rank) + 1
        parts, right, left = list(piece), [], []
        born_r = born_l = -1
        while len(parts) > 1:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            at, i = best
            if i == len(parts) - 2:
                right.append((parts[-1], born_r, at))
                born_r = at
            if i == 0:
                left.append((parts[0], born_l, at))
                born_l = at
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        right.append((parts[-1], born_r, never))
        left.append((parts[0], born_l, never))
        self.spines[piece] = right, left
        return right, left

    def compatible(self, a: str, b: str) -> bool:
        """True if re-merging ``a`` and ``b`` together gives ``a`` and ``b`` back."""
        if (known := self.pairs.get((a, b))) is not None:
            return known
        if a[-1] == SPACE or (a[0] == SPACE and a[1:2] == SPACE):
            good = self.merged(a + b) == [a, b]  # pieces of spaces share one rank
        else:
            good = self._stay_apart(a, b)
        if len(self.pairs) > PAIR_ENTRIES:
            self.pairs.clear()
        self.pairs[a, b] = good
        return good

    def _stay_apart(self, a: str, b: str) -> bool:
        rank = self.rank
        lefts = self.spine(b)[1]
        for x, x_born, x_gone in self.spine(a)[0]:
            for y, y_born, y_gone in lefts:
                if x_born >= y_gone or y_born >= x_gone:
                    continue  # never side by side
                r = rank.get(x + y)
                if r is not None and r < x_gone and r <= y_gone:
                    return False
        return True

    # Encoding.

    def _backtrack(self, text: str) -> list[str]:
        n = len(text)
        longest = [0] * n
        for end, length in self.automaton.iter(text):
            at = end - length + 1
            if length > longest[at]:
                longest[at] = length
        pairs = self.pairs
        alive = bytearray(b"\1") * (n + 1)
        out: list[str] = []
        pos, last = 0, ""
        piece = text[: longest[0]]
        while True:
            end = pos + len(piece)
            if alive[end]:
                fits = not last or pairs.get((last, piece))
                if fits is None:
                    fits = self.compatible(last, piece)
                if fits:
                    out.append(piece)
                    if end == n:
                        return out
                    pos, last = end, piece
                    piece = text[pos : pos + longest[pos]]
                    continue
            piece = self.shorter.get(piece)
            if piece is None:
                piece = self._shorter(text[pos:end])
            if not piece:
                alive[pos] = 0
                piece = out.pop()
                pos -= len(piece)
                last = out[-1] if out else ""

    def _shorter(self, piece: str) -> str:
        """The longest piece that is a proper prefix of this one, or nothing."""
        if (known := self.shorter.get(piece)) is not None:
            return known
        found = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.ids), "")
        self.shorter[piece] = found
        return found

    def encode_segment(self, text: str) -> list[int]:
        """Ids of a text without the cut into segments; unknown characters become bytes."""
        ids = self.ids
        if self.known.issuperset(text):
            return [ids[p] for p in self._backtrack(text)] if text else []
        out: list[int] = []
        start = 0
        for i, c in enumerate(text):
            if c not in ids:
                if start < i:
                    out += [ids[p] for p in self._backtrack(text[start:i])]
                out += [self.bytes[b] for b in c.encode("utf-8", "replace")] if self.bytes else [self.unknown]
                start = i + 1
        if start < len(text):
            out += [ids[p] for p in self._backtrack(text[start:])]
        return out

    def decode_segment(self, ids: list[int]) -> str:
        """Text of ids, with the space that stands for the front of the text still there."""
        if self.silent.isdisjoint(ids) and self.byte_of.keys().isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def segments(self, text: str) -> list[str]:
        return self.segment.findall(" " + text.replace(SPACE, " ")) if text else []

    def entry(self, segment: str) -> tuple[str, int, str]:
        """Decimal ids joined by commas, their count and their text."""
        if (known := self.memo.get(segment)) is not None:
            return known
        made = self.older.get(segment)
        if made is None:
            ids = self.encode_segment(segment.replace(" ", SPACE))
            decoded = self.decode_segment(ids)
            made = (",".join(map(str, ids)), len(ids), segment if decoded == segment else decoded)
        if len(segment) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.older, self.memo = self.memo, {}
            self.memo[segment] = made
        return made

    def encode(self, text: str) -> list[int]:
        return [int(i) for s in self.segments(text) for i in self.entry(s)[0].split(",")]

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: without the one space in front that encoding puts there."""
        text = self.decode_segment(ids)
        return text[1:] if text.startswith(" ") else text

    def round_trip(self, text: str) -> tuple[str, int, str]:
        """Decimal ids joined by commas, their count, and the text decoded from them.

        Byte pieces of one character never reach over a segment's end, so the segments'
        texts joined are the decoded text.
        """
        memo = self.memo
        parts = [memo.get(s) or self.entry(s) for s in self.segments(text)]
        decoded = "".join([p[2] for p in parts])
        return ",".join([p[0] for p in parts]), sum([p[1] for p in parts]), decoded[1:] if decoded.startswith(" ") else decoded


def codec(model: bytes) -> PieceCodec:
    """The worker's codec for a model."""
    key = hash(model)
    return _codecs.get(key) or _codecs.setdefault(key, PieceCodec(model))


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids and decoded text of every row of ``docs(doc_id, text)``."""
    return docs.select("doc_id", "text").mapInArrow(_mapped(_model(docs, model_path), _whole, ENCODED), spark_ddl(ENCODED))


def digest_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """As :func:`encode_pieces`, with digests made where the ids are, instead of ids and texts."""
    return docs.select("doc_id", "text").mapInArrow(_mapped(_model(docs, model_path), _hashed, DIGEST), spark_ddl(DIGEST))


def _model(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _whole(coder: PieceCodec, batch: list[str]) -> dict[str, list]:
    trips = [coder.round_trip(t) for t in batch]
    return {"ids": [[int(i) for i in t[0].split(",")] if t[1] else [] for t in trips], "decoded": [t[2] for t in trips]}


def _hashed(coder: PieceCodec, batch: list[str]) -> dict[str, list]:
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
    out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    for t in batch:
        ids, n, decoded = coder.round_trip(t)
        out["n_tokens"].append(n)
        out["ids_sha256"].append(sha(ids))
        out["decoded_sha256"].append(sha(decoded))
    return out


def _mapped(model, make: Callable, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model.value)
        for part in slices(batches):
            yield emit({"doc_id": part.column("doc_id"), **make(coder, texts(part))}, schema)

    return run
