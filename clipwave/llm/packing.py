"""Packing documents into token windows by the sum-of-squares rule.

A document's tokens, with an end token behind them, are cut into whole windows first, which
need no packing. What is left, a *rest* shorter than a window, is placed online: of all
levels that open windows are filled to, and a new window, it goes where the sum over the
levels of (number of open windows at that level) squared ends up smallest. The numbers are
held in an array with an entry for each level, so a placement is two array operations.

Every Spark task packs the rows of its own partition while it encodes them, so tokens are
never shuffled or stored. When its rows are at an end, the windows that are still open are
settled: the emptiest ones are taken apart to fill the fullest, cutting documents where a gap
ends, and the one that is left over is dealt out into sequences whose lengths are powers of
two, which need no padding. So no sequence is padded at all, at any number of partitions,
and a task cuts at most about as many documents as it had windows open.

A task holds the tokens of its open windows only. If there are more than ``MOST_OPEN`` of
them, they are settled at once and packing goes on. A task that is run anew reads the same
rows in the same order and gives the same sequences; their numbers begin with the task's.

Edge cases: a null text has the end token alone, as an empty one; texts of any length are cut
into windows; rows that repeat are packed each, with the same ``doc_id``; null ids stay null;
an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import default_path
from .common import ARROW_ROWS, begin, finish, slices
from .wordmerges import merges

#: Open windows of a task before it settles them: at 4096 tokens of 4 bytes, 64 MB at most.
MOST_OPEN = 4096
#: Sequences of a task are numbered from its number times this.
SEQUENCES = 1 << 33


class Packer:
    """Open windows of one task. A piece is (document, start, ids), a window a list of pieces."""

    def __init__(self, window: int) -> None:
        self.window = window
        #: How many windows are open at each level; and the same with "none" as a very negative number.
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.offered = np.full(window + 1, -(1 << 40), dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """The level where a rest of ``size`` makes the sum of squares smallest (0: a new window); ties: the fullest."""
        to = self.window - size
        best, gain = 0, 2 * self.levels[size] + 1
        if to > 1:
            # From level h to h + size: 2 (N(h + size) - N(h)) + 2.
            grown = 2 * (self.levels[self.window - 1 : size : -1] - self.offered[to - 1 : 0 : -1]) + 2
            at = int(grown.argmin())
            if grown[at] <= gain:
                best, gain = to - 1 - at, grown[at]
        if self.levels[to] and 1 - 2 * self.levels[to] <= gain:  # a full window leaves the sum
            best = to
        return best

    def put(self, level: int, pieces: list) -> None:
        self.levels[level] += 1
        self.offered[level] = self.levels[level]
        self.open.setdefault(level, []).append(pieces)
        self.n_open += 1

    def take(self, level: int) -> list:
        pieces = self.open[level].pop()
        self.levels[level] -= 1
        self.n_open -= 1
        self.offered[level] = self.levels[level] or -(1 << 40)
        if not self.levels[level]:
            del self.open[level]
        return pieces

    def place(self, piece: tuple) -> list | None:
        """Put a rest into a window; the window, if that fills it."""
        size = len(piece[2])
        level = self.level_for(size)
        pieces = self.take(level) if level else []
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.put(level + size, pieces)
        return None

    def add(self, document: object, ids: np.ndarray) -> Iterator[list]:
        """A document's tokens; gives the windows that they fill."""
        whole = len(ids) - len(ids) % self.window
        for at in range(0, whole, self.window):
            yield [(document, at, ids[at : at + self.window])]
        if whole < len(ids):
            full = self.place((document, whole, ids[whole:].copy()))
            if full:
                yield full
        if self.n_open > MOST_OPEN:
            yield from self.settle()

    def settle(self) -> Iterator[list]:
        """Fill the fullest windows with what the emptiest hold, until one is left open at most."""
        windows = deque((level, pieces) for level in sorted(self.open) for pieces in self.open[level])
        self.levels[:], self.offered[:], self.open, self.n_open = 0, -(1 << 40), {}, 0
        level, giving = windows.popleft() if windows else (0, [])
        while windows:
            filled, pieces = windows.pop()
            while filled < self.window and (giving or windows):
                if not giving:
                    level, giving = windows.popleft()
                document, start, ids = giving.pop()
                keep = max(0, len(ids) - (self.window - filled))
                pieces.append((document, start + keep, ids[keep:]))
                filled, level = filled + len(ids) - keep, level - (len(ids) - keep)
                if keep:
                    giving.append((document, start, ids[:keep]))
            if filled == self.window:
                yield pieces
            else:  # all others are used up: this is the one that is left
                level, giving = filled, pieces
        if giving:
            self.put(level, giving)

    def finish(self) -> Iterator[list]:
        """Settle, and deal out what is left into sequences of a power of two."""
        yield from self.settle()
        left = [p for windows in self.open.values() for pieces in windows for p in pieces]
        self.__init__(self.window)
        total = sum(len(p[2]) for p in left)
        for bit in range(total.bit_length() - 1, -1, -1):
            if total >> bit & 1:
                want, out = 1 << bit, []
                while want:
                    document, start, ids = left.pop(0)
                    out.append((document, start, ids[:want]))
                    if len(ids) > want:
                        left.insert(0, (document, start + want, ids[want:]))
                    want -= len(out[-1][2])
                yield out


def pack(docs: DataFrame, window: int = 4096, end: int = 2, path: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """The pieces of all documents: ``key``, ``start`` and ``length`` in its document's tokens, ``doc_tokens``, ``sequence_id``, ``offset`` there, ``ids_crc32`` and, unless turned off, ``ids``."""
    path = path or default_path()
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe")
        words, packer = merges(path), Packer(window)
        number = TaskContext.get().partitionId() * SEQUENCES
        held: list[tuple] = []
        names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
        key_type = None

        def keep(pieces: list) -> None:
            nonlocal number
            offset = 0
            for (doc, tokens), start, ids in pieces:
                held.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, number, offset, *([ids] if with_ids else [])))
                offset += len(ids)
            number += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            held.clear()
            kinds = [key_type, *[pa.int64()] * 6, *([pa.list_(pa.int32())] if with_ids else [])]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for part in slices(batches, text):
            key_type = part.column(key).type
            for doc, encoded in zip(part.column(key).to_pylist(), words.encode_texts(part.column(text).to_pylist()), strict=True):
                ids = np.append(encoded, np.int32(end))
                for full in packer.add((doc, len(ids)), ids):
                    keep(full)
                    if len(held) >= ARROW_ROWS:
                        yield out()
        for full in packer.finish():
            keep(full)
        if held:
            yield out()
        finish("bpe")

    df = docs.select(key, text)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return df.mapInArrow(run, schema)
