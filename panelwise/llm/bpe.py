"""Byte-pair encoding and decoding with a fixed public vocabulary, by backtracking over longest token matches.

A pre-token is encoded in time linear in its length and without a queue of
merges: an Aho-Corasick automaton finds every token that occurs in it, the
encoder takes the longest token at each place and goes back to a shorter one
where two neighbours are not compatible. Two tokens are compatible if merging
their joined bytes from scratch gives the same two tokens; a sequence in which
all neighbours are compatible is the one that exact merging gives. Answers
are kept in a pair table. Decoding gathers bytes by an offset table.

The vocabulary is a ``tokenizers`` JSON file of a byte-level BPE, named by its
path and read on the driver; tables of its fixed size go to the tasks. Nothing
is trained.

Defined results: null and empty texts have no ids; the text of an added
(special) token becomes its id, as in the library; a text is cut only between
a non-space and a space, where no pre-token can span, so very long texts are
encoded whole in bounded pieces; ids that are null or not in the vocabulary
decode to nothing, null lists to null; bytes that are no UTF-8 become U+FFFD.
Other columns, whatever their names, are kept.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.llm import words
from panelwise.llm.common import small_batches

#: Pre-tokens and token pairs whose answers a worker remembers at a time.
REMEMBERED = 1 << 18
#: Characters of a text that are split into pre-tokens at a time.
PIECE = 1 << 20


def byte_characters() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file: themselves where printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in sorted(plain)} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.cache
def character_ranges() -> tuple[str, str]:
    """Letters and numbers as regular-expression ranges, in the Unicode version of the tokenizer library.

    The standard library and ``regex`` know other versions; where these two
    agree all three do, and the library is asked about the rest.
    """
    from tokenizers import pre_tokenizers

    splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)
    newer = {"L": regex.compile(r"\p{L}"), "N": regex.compile(r"\p{N}")}
    found: dict[str, list[list[int]]] = {"L": [], "N": []}
    for code in (*range(0xD800), *range(0xE000, 0x110000)):
        char = chr(code)
        kind = unicodedata.category(char)[0]
        if kind == "C" and unicodedata.category(char) == "Cn":
            kind = next((k for k, p in newer.items() if p.match(char) and len(splitter.pre_tokenize_str({"L": "a", "N": "1"}[k] + char)) == 1), "C")
        if kind in found:
            spans = found[kind]
            if spans and spans[-1][1] == code - 1:
                spans[-1][1] = code
            else:
                spans.append([code, code])
    return tuple("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found[k]) for k in "LN")  # type: ignore[return-value]


#: White space of the pattern: fixed values.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _pattern(letters: str, numbers: str, space: str) -> str:
    """The split of byte-level BPE: contractions, words, numbers and signs with one space before them, runs of space."""
    return rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"


def _below(ranges: str, limit: int) -> str:
    """The part of ``character_ranges`` below a code point."""
    pairs = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\U(\w{8})-\\U(\w{8})", ranges)]
    return "".join(f"\\U{a:08x}-\\U{min(b, limit - 1):08x}" for a, b in pairs if a < limit)


@dataclass(frozen=True)
class Vocabulary:
    """Bytes of every id, what each token was merged from, added tokens, and the ranges of the split; sent to the tasks."""

    tokens: tuple[bytes | None, ...]  # by id
    merges: tuple[tuple[int, int, int], ...]  # (left, right, result), by rank
    added: tuple[tuple[str, int], ...]
    letters: str
    numbers: str
    key: str = field(default="", compare=False)


def load(path: str) -> Vocabulary:
    """Read a byte-level BPE of the ``tokenizers`` JSON format; other kinds raise ValueError."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if model.get("type") != "BPE" or not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError(f"{path} is no plain byte-level BPE")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} has added tokens that take white space")
    chars = byte_characters()
    raw = {text: bytes(chars[c] for c in text) for text in model["vocab"]}
    added = tuple((t["content"], t["id"]) for t in spec["added_tokens"])
    tokens: list[bytes | None] = [None] * (1 + max([*model["vocab"].values(), *(i for _, i in added)]))
    for text, i in model["vocab"].items():
        tokens[i] = raw[text]
    for text, i in added:
        tokens[i] = text.encode()
    ids = model["vocab"]
    merges = []
    seen = {i for t, i in ids.items() if len(raw[t]) == 1}
    for pair in model["merges"]:
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        made = ids[left + right]
        if ids[left] not in seen or ids[right] not in seen or made in seen:
            raise ValueError(f"{path}: a token is made twice or before its parts")
        seen.add(made)
        merges.append((ids[left], ids[right], made))
    return Vocabulary(tuple(tokens), tuple(merges), added, *character_ranges(), key=f"{path}:{len(tokens)}")


class Encoder:
    """Tables of one vocabulary inside a task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.rank = {(a, b): k for k, (a, b, _) in enumerate(vocabulary.merges)}
        self.parts = {made: (a, b, k) for k, (a, b, made) in enumerate(vocabulary.merges)}
        by_bytes = {vocabulary.tokens[i].decode("latin-1"): i for i in self.parts}  # type: ignore[union-attr]
        merged = {i for i in self.parts}
        special = {i for _, i in vocabulary.added}
        by_bytes |= {t.decode("latin-1"): i for i, t in enumerate(vocabulary.tokens) if t is not None and len(t) == 1 and i not in merged | special}
        self.by_bytes, self.length = by_bytes, {i: len(t) for t, i in by_bytes.items()}
        self.automaton = ahocorasick.Automaton()
        for text, i in by_bytes.items():
            self.automaton.add_word(text, (i, len(text) - 1))
        self.automaton.make_automaton()
        #: The longest token that is a proper prefix of a token; -1: none.
        self.shorter = {i: next((by_bytes[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_bytes), -1) for t, i in by_bytes.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        letters, numbers = vocabulary.letters, vocabulary.numbers
        # the same split for all characters, for those up to U+00FF and for ASCII alone: small classes are bitmaps
        self.split = re.compile(_pattern(letters, numbers, _SPACE)).findall
        self.split_latin = re.compile(_pattern(_below(letters, 0x100), _below(numbers, 0x100), r"\t-\r \x85\xa0")).findall
        self.split_ascii = re.compile(_pattern(_below(letters, 0x80), _below(numbers, 0x80), r"\t-\r ")).findall
        self.added = dict(vocabulary.added)
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.known = _Known(self)

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge reaches across the border of two tokens that stand side by side.

        The symbols at the border grow as the two tokens are put together in
        order of rank. A pair of them would merge if its rank comes before the
        merges that use up the left one (which wins ties, standing further left) and the right one.
        """
        never = len(self.rank)
        a, b = self._edge(left, 1, never), self._edge(right, 0, never)
        i = j = 0
        good = True
        while True:
            (x, x_used), (y, y_used) = a[i], b[j]
            rank = self.rank.get((x, y), never)
            if rank < x_used and rank <= y_used and rank < never:
                good = False
                break
            if x_used == never and y_used == never:
                break
            if x_used <= y_used:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        self.pairs[left, right] = good
        return good

    def _edge(self, token: int, side: int, never: int) -> list[tuple[int, int]]:
        """The symbols at one edge of a token while it is merged, each with the rank of the merge that uses it up."""
        seen = self.edges.get((token, side))
        if seen is None:
            seen, part = [(token, never)], self.parts.get(token)
            while part:
                seen.append((part[side], part[2]))
                part = self.parts.get(part[side])
            self.edges[token, side] = seen = seen[::-1]
        return seen

    def encode(self, text: str) -> list[int]:
        """Ids of one pre-token, its bytes given as Latin-1 characters."""
        whole = self.by_bytes.get(text)
        if whole is not None:
            return [whole]
        n, length, shorter, pairs = len(text), self.length, self.shorter, self.pairs
        longest = [-1] * n
        for end, (token, back) in self.automaton.iter(text):
            longest[end - back] = token  # ends only rise, so the last token from a start is the longest
        out: list[int] = []
        last = -1  # the start of the text, which goes with every token
        open_at = bytearray(b"\1") * (n + 1)  # ends that have not been found to lead nowhere
        at, token = 0, longest[0]
        while True:
            while token >= 0:
                if open_at[at + length[token]]:
                    good = pairs.get((last, token))
                    if good or good is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token < 0:
                if not out:
                    raise ValueError("a byte is missing from the vocabulary")
                open_at[at] = 0
                token = out.pop()
                last = out[-1] if out else -1
                at -= length[token]
                token = shorter[token]
                continue
            out.append(token)
            last = token
            at += length[token]
            if at == n:
                return out
            token = longest[at]

    def ids(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at:m.start()]), self.added[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        return b"".join(b"".join(map(self.known.__getitem__, self.pre_tokens(piece))) for piece in _pieces(text))

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii():
            return self.split_ascii(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split(text)
        return self.split_latin(text)


class _Known(dict):
    """Ids of pre-tokens as bytes, made when first asked for. When it is full it becomes the older generation, from which words in use come back."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            found = self.encoder.encode(word if word.isascii() else word.encode().decode("latin-1"))
            ids = pack("<%dI" % len(found), *found)
            if len(word) > 64:
                return ids
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


#: A space after anything else: pre-tokens end here.
_BREAK = re.compile(r"(?<=[^\s\x1c-\x1f])(?= )")


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about ``PIECE`` characters, cut where a pre-token ends in any case."""
    at = 0
    while len(text) - at > PIECE:
        cut = _BREAK.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if vocabulary.key not in _encoders:
        _encoders.clear()
        _encoders[vocabulary.key] = Encoder(vocabulary)
    return _encoders[vocabulary.key]


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``, the array of token ids of every whole text."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)  # of the vocabulary's size, whatever the input

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def ids_of(texts: pa.Array) -> pa.Array:
        encoder = _encoder(sent.value)
        found = [encoder.ids(t) if t else b"" for t in texts.to_pylist()]
        return _lists(found)

    return df.withColumn(out, ids_of(F.col(text)))


def _lists(found: list[bytes]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
    values = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def offset_table(vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens in a row and where each id begins (one more than ids)."""
    tokens = [t or b"" for t in vocabulary.tokens]
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)


def decode_ids(ids: np.ndarray, blob: np.ndarray, begins: np.ndarray) -> bytes:
    """The bytes of a sequence of ids: one gather over the offset table."""
    ids = ids[(ids >= 0) & (ids < len(begins) - 1)]
    sizes = begins[ids + 1] - begins[ids]
    ends = np.cumsum(sizes)
    return blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[ids] - (ends - sizes), sizes)].tobytes()


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the text of every array of ids, special tokens included."""
    small_batches(df.sparkSession)
    table = offset_table(vocabulary)
    sent = df.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf(T.StringType())
    def text_of(lists: pa.Array) -> pa.Array:
        blob, begins = sent.value
        return pa.array([None if x is None else decode_ids(x, blob, begins).decode("utf-8", "replace") for x in _rows(lists)], pa.string())

    return df.withColumn(out, text_of(F.col(ids)))


def _rows(lists: pa.Array) -> Iterator[np.ndarray | None]:
    """The id lists of an Arrow array without one Python object per id."""
    values = np.asarray(lists.values.fill_null(-1), np.int64)
    ends = np.asarray(lists.offsets)
    for i, there in enumerate(lists.is_valid().to_pylist()):
        yield values[ends[i]:ends[i + 1]] if there else None


def ids_digest(ids: Column) -> Column:
    """Lower-case hex SHA-256 of an array of ids as little-endian unsigned 32-bit integers."""
    @F.arrow_udf(T.BinaryType())
    def packed(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else x.astype("<u4").tobytes() for x in _rows(lists)], pa.binary())

    return F.sha2(packed(ids), 256)
