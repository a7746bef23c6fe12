"""Packing tokenised documents into sequences by bounded-space online best-fit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

CAPACITY = 2048
OPEN_BINS = 256
#: Distinct words whose ids a worker remembers.
CACHE_WORDS = 1_000_000
#: Sequence numbers are the task's partition times this, plus a count.
PER_TASK = 1 << 40

_caches: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of texts, from the ids of their words, as bytes of little-endian unsigned 32-bit numbers.

    The vocabulary's rules treat what stands between spaces, tabs and line ends
    apart, so the ids of a text are those of such words one after another.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {"": b""}

    def learn(self, words: set[str]) -> None:
        import numpy as np

        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = {"": b""}
            new = list(words)
        # a stop or comma after what is a letter or digit in lower case too is a token of its own
        ended = [w for w in new if w[-1:] in (".", ",") and w[-2:-1].lower().isalnum()]
        own = set(new).difference(ended)
        own.update(x for w in ended for x in (w[:-1], w[-1]))
        own = [w for w in own if w not in self.known]
        for i in range(0, len(own), 10_000):
            part = own[i : i + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[w] = np.array(e.ids, dtype="<u4").tobytes()
        for w in ended:
            self.known[w] = self.known[w[:-1]] + self.known[w[-1]]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        self.learn({""}.union(*split))
        for words in split:
            yield b"".join(map(self.known.__getitem__, words))


def encoder(path: str) -> WordEncoder:
    if path not in _caches:
        _caches[path] = WordEncoder(path)
    return _caches[path]


class BestFit:
    """Online best-fit with at most `space` open bins.

    Open bins are lists by free space, and a bitset has a bit for each free space
    that some bin has: the tightest bin for an item is the lowest set bit from its
    length on. When a bin more than allowed is open, the fullest closes.
    """

    def __init__(self, capacity: int, space: int):
        self.capacity, self.space = capacity, space
        self.bits, self.open, self.count, self.made = 0, [[] for _ in range(capacity + 1)], 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of an item of 1 to capacity tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            bin_, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.open[left].append(bin_)
            self.bits |= 1 << left
            self.count += 1
            if self.count > self.space:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return bin_, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.open[free]
        bin_ = bins.pop()
        self.count -= 1
        if not bins:
            self.bits &= ~(1 << free)
        return bin_


PACKED = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = 0) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most capacity tokens.

    A document is the token ids of its text (null: empty) and then end_id, so none
    is without a token; only those of more than capacity tokens are cut, into
    pieces of capacity with a shorter last one. ids holds a piece's tokens as
    little-endian unsigned 32-bit numbers, in the order of start; offset is its
    place in the sequence, gapless from 0. Each task packs the documents it reads,
    in the order it reads them, with no shuffle; an attempt after a lost executor
    reads and packs the same. Repeated rows and equal doc_ids are packed row by
    row, a null doc_id stays null, other columns are not read, and no rows give no
    rows. vocabulary is a path that every worker can read.
    """
    ship(docs.sparkSession)
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base, words = BestFit(capacity, open_bins), TaskContext.get().partitionId() * PER_TASK, encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), words.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += tail
                    total = len(ids) // 4
                    for piece, start in enumerate(range(0, total, capacity)):
                        length = min(capacity, total - start)
                        sequence, offset = bins.place(length)
                        rows.append((doc_id, piece, start, length, ids[4 * start : 4 * (start + length)], base + sequence, offset))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PACKED)
