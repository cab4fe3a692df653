"""Token counts: batch encoding in Arrow functions that return lengths only.

The library's model is sent to the workers as bytes.  Each Arrow batch is re-cut into
slices of about equal bytes, texts are cut at boundaries that no piece of the
vocabulary spans, the distinct segments of a slice that were not met before are encoded
by the library in batches of equal bytes, and only their lengths are kept and summed.

Cases: a null or empty text has 0 bytes and 0 tokens; repeated rows and repeated ids are
counted row by row; a text of one endless word is one segment; an empty table gives an
empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from quern.llm.arrow import emit, slices, spark_ddl, texts

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
#: Segments a worker remembers; beyond that it forgets them all and starts again.
MEMO_ENTRIES = 500_000
#: Segments over this many characters are encoded each time.
MEMO_CHARS = 80
#: Bytes of segments that one library call encodes.
CALL_BYTES = 250_000
#: A run of spaces with the non-spaces after it, or the spaces that end the text.
SEGMENT = re.compile(r" *[^ ]+| +\Z")

_counters: dict[int, SegmentCounter] = {}


def spans_no_space(processor: sentencepiece.SentencePieceProcessor) -> bool:
    """True if every piece has its spaces in front, so that a cut before a space is safe."""
    return all("▁" not in processor.id_to_piece(i).lstrip("▁") for i in range(processor.get_piece_size()))


class SegmentCounter:
    """Counts tokens of texts with one library model, remembering short segments."""

    def __init__(self, model: bytes) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.safe = spans_no_space(self.processor)
        self.opens = np.array([self.processor.id_to_piece(i).startswith("▁") for i in range(self.processor.get_piece_size())])
        self.memo: dict[str, int] = {}

    def segments(self, text: str) -> list[str]:
        """Pieces of the text, each to be encoded with the library's own leading space.

        A segment stands without its first space, which the library adds again.  Spaces
        that end the text stay with the last word, as a lone space would be lost.
        """
        if not text or not self.safe:
            return [text] if text else []
        text = text.replace("▁", " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            found = SEGMENT.findall(" " + text)
            if found[-1].isspace() and len(found) > 1:
                found[-2:] = [found[-2] + found[-1]]
            return [s[1:] for s in found]
        return text.split(" ")

    def _encoded(self, part: list[str]) -> list[int]:
        """Lengths of segments.  Words are encoded as one text and told apart by their spaces."""
        if self.safe and not any(" " in s or not s for s in part):
            ids = np.array(self.processor.encode(" ".join(part)), dtype=np.int64)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(part):
                return np.diff(starts, append=len(ids)).tolist()
        return [len(ids) for ids in self.processor.encode(part, num_threads=1)]

    def lengths(self, batch: list[str]) -> list[int]:
        cut = [self.segments(t) for t in batch]
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        fresh = {s for segments in cut for s in segments}
        fresh = sorted((s for s in fresh if s not in memo), key=lambda s: (" " in s or not s))  # odd ones last
        long: dict[str, int] = {}
        start = held = 0
        for i, s in enumerate(fresh):
            held += len(s)
            if held >= CALL_BYTES or i + 1 == len(fresh):
                part = fresh[start : i + 1]
                for x, n in zip(part, self._encoded(part), strict=True):
                    (memo if len(x) <= MEMO_CHARS else long)[x] = n
                start, held = i + 1, 0
        known = _Both(memo, long) if long else memo
        return [sum(map(known.__getitem__, segments)) for segments in cut]


class _Both(dict):
    """Looks a segment up among the long ones and then in the memo."""

    def __init__(self, memo: dict[str, int], long: dict[str, int]) -> None:
        super().__init__(long)
        self.memo = memo

    def __missing__(self, key: str) -> int:
        return self.memo[key]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs(doc_id, text)``."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select("doc_id", "text").mapInArrow(_counting(model, limit), spark_ddl(SCHEMA))


def _counting(model, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(model.value)
        counter = _counters.get(key) or _counters.setdefault(key, SegmentCounter(model.value))
        for part in slices(batches):
            n = counter.lengths(texts(part))
            size = pa.compute.fill_null(pa.compute.binary_length(part.column("text")), 0)
            yield emit({"doc_id": part.column("doc_id"), "n_bytes": size.cast(pa.int64()), "n_tokens": n, "over_limit": [x > limit for x in n]}, SCHEMA)

    return run
