"""Byte-pair encoding by backtracking over Aho-Corasick matches, and decoding by offsets.

The tokenizer file is one of the ``tokenizers`` library: BPE with an end-of-word suffix,
a byte-level alphabet and a lower-casing normaliser. A word's tokens are found without
replaying merges:

* an Aho-Corasick automaton over the vocabulary reports, in one pass over the word, every
  token that occurs in it; the longest that starts at each place is the first choice there;
* a token may follow its predecessor only if the pair is *compatible*: re-encoding the
  two side by side gives the same two tokens. Pairs that were looked at are kept in a
  table, so the test is one look-up for all but new pairs;
* where the choice is incompatible the encoder takes the next shorter prefix of it, and
  where none is left it goes back one token. Places that were left behind are marked and
  never entered again, so a word costs time linear in its length.

Words are cut by the file's pattern after its normalisation. Letters, digits and pairs of
cases are those of the Unicode data of Python and ``regex``, which agree with the library for
every code point that Python's version has assigned. A text with any other code point, or
with a mark that came after version 3.2, is normalised and cut by the library's own two parts
for that, which know another version.

This gives exactly the merges of the reference algorithm, as merge ranks are token ids here
(checked when the file is loaded).

Decoding concatenates token strings, one space between, by slices of one byte string that
an offset table points into (the file names no decoder, and this is what the library does
then).

Edge cases: a null text is encoded as an empty one (no tokens, decoded to the empty text);
the strings of special tokens inside a text become those tokens; texts of any length are
handled word by word; repeated rows give repeated results; input columns whose names clash
with result columns are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import begin, map_slices, tables_of

#: Words whose tokens a worker remembers at most twice over: a full table becomes the
#: older one, which is looked up after the new one and then let go.
REMEMBERED = 150_000
#: Stands for the end-of-word suffix inside the automaton: no byte-level letter is NUL.
END = "\0"
#: From this code point on a text isn't plain Latin. All under it are assigned.
LATIN = 0x250
BEYOND_LATIN = re.compile(f"[^\0-{chr(LATIN - 1)}]")
#: Fixed value: the pattern of words for which there is a faster one for Latin.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def latin_words() -> str:
    """WORDS for the standard library, with letters, digits and blanks under ``LATIN`` spelled out."""
    group = {k: "".join(re.escape(chr(c)) for c in range(LATIN) if regex.match(k, chr(c))) for k in (r"\p{L}", r"\p{N}", r"\s")}
    inside = lambda m: "".join(group.get(part, part) for part in re.split(r"(\\p\{[LN]\}|\\s)", m[0]))
    return re.sub(r"\[[^]]*\]", inside, WORDS)


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others
    for the code points from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


#: Under this code point all are assigned.
ALL_ASSIGNED = 0x378


@lru_cache(maxsize=1)
def unassigned() -> np.ndarray:
    """For each code point whether Python's Unicode version hasn't assigned it, or whether versions disagree how it is composed (as marks that came after version 3.2, which normalisers of another version may not reorder)."""
    old = unicodedata.ucd_3_2_0
    chars = map(chr, range(0x110000))
    return np.array([unicodedata.category(c) == "Cn" or unicodedata.combining(c) != old.combining(c) or unicodedata.decomposition(c) != old.decomposition(c) for c in chars])


def holds_unassigned(text: str) -> bool:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return bool(codes.max() >= ALL_ASSIGNED and unassigned()[codes].any())


class Words(dict):
    """Token ids of words, as int32 bytes; what isn't there is encoded when it is looked up."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= 64:
            self[word] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.older = {}


@dataclass(eq=False)
class Bpe:
    """Tables of one tokenizer file."""

    path: str

    def __post_init__(self) -> None:
        self.words = Words(self.encode_word)
        spec = json.load(open(self.path, encoding="utf-8"))
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        inside = lambda t: t[: -len(suffix)] + END if suffix and t.endswith(suffix) and len(t) > len(suffix) else t
        self.ids = {inside(t): i for t, i in vocab.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        last = -1
        for a, b in merges:
            i = vocab[a + b]
            if i <= last:
                raise ValueError("token ids don't follow the order of merges")
            last = i
            self.parts[i] = (vocab[a], vocab[b])
            self.merged[vocab[a], vocab[b]] = i
        #: The next shorter token that begins a token, or -1.
        self.shorter = [-1] * size
        self.length = [0] * size
        for t, i in self.ids.items():
            self.length[i] = len(t)
            for n in range(len(t) - 1, 0, -1):
                if (j := self.ids.get(t[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        #: The same for the parts of a merge: at most one entry for each token.
        self.within: dict[tuple[int, int], bool] = {}
        self.letters = byte_letters()
        self.pieces = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        #: The same for texts without code points from ``LATIN`` on; None for another pattern.
        self.latin_pieces = re.compile(latin_words()) if self.pieces.pattern == WORDS else None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        text = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            text[i] = t
        self.strings = OffsetTable(text)
        self.numbers = OffsetTable([str(i) for i in range(size)])

    def pair_holds(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay apart when their text is encoded anew.

        Undo the latest merge on either side of the boundary, again and again, and ask each
        time whether the two tokens that meet there had been merged earlier than the
        merge just undone: if so, encoding would have joined them."""
        known = self.compatible.get((left, right))
        if known is not None:
            return known
        a, b, before, holds = left, right, len(self.parts), True
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < before:
                holds = False
                break
            pa_, pb = self.parts[a], self.parts[b]
            if pa_ is None and pb is None:
                break
            # On equal tokens the left one was built first, so the right one is undone first.
            if pb is None or pa_ is not None and a > b:
                before, a = a, pa_[1]
            else:
                before, b = b + 1, pb[0]
        if len(self.compatible) > 200_000:
            self.compatible.clear()
        self.compatible[left, right] = holds
        return holds

    def encode_word(self, word: str) -> bytes:
        """Token ids of one pre-tokenised word, as int32 bytes."""
        s = (word if word.isascii() and word.isprintable() and " " not in word else "".join([self.letters[b] for b in word.encode()])) + END
        whole = self.ids.get(s)
        if whole is not None and self.alone(whole):
            return np.int32(whole).tobytes()
        n, length, shorter, compatible = len(s), self.length, self.shorter, self.compatible
        # Matches come by where they end, so of those that start at one place the longest comes last.
        longest = {end - length[i]: i for end, i in self.automaton.iter(s)}  # by the place before
        out: list[int] = []
        place, left_behind, choice = 0, set(), longest.get(-1, -1)
        while place < n:
            while choice >= 0:
                after = place + length[choice]
                if (after >= n or after - 1 in longest) and after not in left_behind:
                    if not out:
                        break
                    holds = compatible.get((out[-1], choice))
                    if self.pair_holds(out[-1], choice) if holds is None else holds:
                        break
                choice = shorter[choice]
            if choice >= 0:
                out.append(choice)
                place += length[choice]
                choice = longest.get(place - 1, -1)
            else:
                if not out:
                    raise ValueError("the vocabulary can't spell this word")
                left_behind.add(place)
                choice = out.pop()
                place -= length[choice]
                choice = shorter[choice]
        return array("i", out).tobytes()

    def alone(self, token: int) -> bool:
        """Whether the token's own text is encoded as the token: it is what its merge parts give."""
        parts = self.parts[token]
        return parts is None or (self.pair_holds_within(parts) and self.alone(parts[0]) and self.alone(parts[1]))

    def pair_holds_within(self, parts: tuple[int, int]) -> bool:
        """Whether the two parts of a merge meet as such: no earlier merge bridges them."""
        holds = self.within.get(parts)
        if holds is None:
            holds = self.within[parts] = self._meets(parts)
        return holds

    def _meets(self, parts: tuple[int, int]) -> bool:
        a, b = parts
        limit = self.merged[parts]
        before = len(self.parts)
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < before and joined != limit:
                return False
            pa_, pb = self.parts[a], self.parts[b]
            if pa_ is None and pb is None:
                return True
            if pb is None or pa_ is not None and a > b:
                before, a = a, pa_[1]
            else:
                before, b = b + 1, pb[0]

    def split(self, text: str) -> list[str]:
        """Normalise and pre-tokenise a text that holds no special token."""
        if not text.isascii():
            if BEYOND_LATIN.search(text) and holds_unassigned(text):
                return self.split_by_library(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-casing looks at one letter at a time
        text = text.lower()
        if self.latin_pieces and not BEYOND_LATIN.search(text):
            return self.latin_pieces.findall(text)
        return self.pieces.findall(text)

    @cached_property
    def library_parts(self):  # noqa: ANN201
        """Normaliser and pre-tokeniser of the file, without its vocabulary; and bytes by letter."""
        from tokenizers import Tokenizer

        spec = json.load(open(self.path, encoding="utf-8"))
        spec |= {"model": spec["model"] | {"vocab": {}, "merges": []}, "added_tokens": []}
        parts = Tokenizer.from_str(json.dumps(spec))
        return parts.normalizer, parts.pre_tokenizer, {c: b for b, c in enumerate(self.letters)}

    def split_by_library(self, text: str) -> list[str]:
        normal, cut, byte = self.library_parts
        return [bytes(byte[c] for c in piece).decode() for piece, _ in cut.pre_tokenize_str(normal.normalize_str(text))]

    def encode_plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids (int32) of a text; null is empty."""
        if not text:
            return np.empty(0, dtype=np.int32)
        if self.at_special is None or "<|" not in text:
            return np.frombuffer(self.encode_plain(text), dtype=np.int32)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += [self.encode_plain(text[at : m.start()]), np.int32(self.special[m[0]]).tobytes()]
            at = m.end()
        out.append(self.encode_plain(text[at:]))
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the token strings, one space between."""
        return self.strings.joined(ids)


class OffsetTable:
    """Strings end to end in one byte string, each with a space behind it, and where each begins."""

    def __init__(self, strings: list[str]) -> None:
        raw = [s.encode() + b" " for s in strings]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        """The strings of ``ids`` with one space between; in blocks, so that the index stays small."""
        out = []
        for at in range(0, len(ids), 1 << 16):
            part = ids[at : at + (1 << 16)]
            start, size = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            ends = np.cumsum(size)
            index = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
            out.append(self.data[index].tobytes())
        return b"".join(out)[:-1]


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """Tables of a file, once for each Python worker."""
    _loaded().append(b := Bpe(path))
    return b


@lru_cache(maxsize=1)
def _loaded() -> list[Bpe]:
    return []


def _forget_words() -> None:
    """An idle worker keeps the vocabulary's tables, not the words of its last task."""
    for b in _loaded():
        b.words.forget()
        b.compatible.clear()


def _clear_all() -> None:
    _loaded().clear()
    load.cache_clear()


tables_of("bpe", _clear_all, _forget_words)


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``n_tokens`` (long); other columns stay."""
    path = path or default_path()
    keep = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    docs = docs.select(*[docs[c] for c in keep])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "ids array<int>", "n_tokens long"])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        ids = [bpe.encode(t) for t in part.column(text).to_pylist()]
        ends = np.cumsum([0, *map(len, ids)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
        return pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(np.diff(ends), pa.int64())], names=[*part.schema.names, "ids", "n_tokens"])

    return map_slices(docs, work, schema, text, "bpe")


def decode_documents(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (string) from its column of token ids; null ids decode to the empty text."""
    path = path or default_path()
    encoded = encoded.drop("decoded")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), "decoded string"])

    def run(batches):
        begin("bpe")
        bpe = load(path)
        for part in batches:
            out = [bpe.decode(np.array(x or [], dtype=np.int32)).decode() for x in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def digests(bpe: Bpe, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
    """Tokens of each text, and digests of its ids and of what they decode to. Equal texts, which mixing puts side by side, are encoded once."""
    done: dict[str | None, tuple[int, str, str]] = {}
    for t in texts:
        if t not in done:
            ids = bpe.encode(t)
            done[t] = (len(ids), hashlib.sha256(bpe.numbers.joined(ids)).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest())
        yield done[t]


def round_trip(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text, decode its ids, and return counts and digests of both, in one pass."""
    path = path or default_path()
    kind = docs.schema[key].dataType.simpleString()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        found = list(digests(bpe, part.column(text).to_pylist()))
        counts, of_ids, of_text = zip(*found, strict=True) if found else ([], [], [])
        return pa.RecordBatch.from_arrays([part.column(key), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_slices(docs.select(key, text), work, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", text, "bpe")
