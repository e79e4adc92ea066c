"""Counts that describe a whole text; quality rules and the quality classifier read them.

Words are maximal runs of anything but space and the characters 9 to 13. A null text
counts as an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices

#: Fixed values of the rules: the characters that count as symbols, and white space.
SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
WHITE = np.array([0x20, *range(0x09, 0x0E)], dtype=np.uint8)

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_bytes", "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_exclaim", "n_stops")


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """How many words lie in a 3-word window that occurs twice or more, and how many words differ."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if len(ids) < 4:
        return 0, len(number)
    if len(number) < 1 << 21:
        keys = (ids[:-2] * len(number) + ids[1:-1]) * len(number) + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * len(number) + ids[2:]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    if len(counts) == len(keys):
        return 0, len(number)
    again = counts[inverse] > 1
    inside = np.zeros(len(ids), dtype=bool)
    inside[:-2] |= again
    inside[1:-1] |= again
    inside[2:] |= again
    return int(inside.sum()), len(number)


def measure(text: str | None) -> tuple[int, ...]:
    """The values of FIELDS for one text."""
    if not text:
        return (0,) * len(FIELDS)
    raw = text.encode("utf-8", "replace")
    of = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    repeat, distinct = repeated_words(words)
    lines = text.split("\n")
    seen: set[str] = set()
    again = 0
    for line in lines:
        if line in seen:
            again += bool(line.encode("utf-8", "replace").split())
        else:
            seen.add(line)
    return (len(words), len(text) - int(of[WHITE].sum()), int(of[SYMBOLS].sum()), again, repeat, len(text), len(raw), len(lines), distinct, int(of[65:91].sum()), int(of[48:58].sum()), int(of[33]), int(of[46]))


def measure_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``also``, and one long column for each of FIELDS."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *also)), *(f"{f} long" for f in FIELDS)])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([measure(t) for t in part.column(text).to_pylist()], dtype=np.int64).reshape(-1, len(FIELDS))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in (key, *also)), *(pa.array(v) for v in values.T)], names=[key, *also, *FIELDS])

    return map_slices(docs.select(key, text, *also), work, schema, text, "textstats")
