"""Byte-pair encoding and decoding as a streaming transducer with bounded lookahead.

The vocabulary is a file of a public tokenizer: lower-cased text, white space dropped, pieces
by a pattern, bytes as letters, merges by rank, a mark on the last letter of each piece.

How far can text to the right change a token? A merge (a, b) of rank r can only be changed by
an earlier merge that takes, or makes, the b on its right. So a change moves left along merges
of rising rank, each step by the length of its left part. ``lookahead`` is the longest such
chain, computed once from the merge list. A token that ends at least that far before the end
of what has been read is final: it is emitted and its letters are forgotten. A piece of any
length is thus encoded in constant memory, and pieces, which merges never cross, one by one.

Decoding feeds token bytes to a state machine that holds at most the three bytes of an
unfinished character; bytes that are no UTF-8 become U+FFFD.

Defined cases: null or empty text gives no tokens and decodes to empty text; repeated rows
and ids stay as they are; further columns are kept by ``encode`` and must not be named like
those it adds.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waymark.llm.common import batches, tidy

#: Fixed value: the pieces that the vocabulary was made for.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same where NEW stands for signs that are neither letters nor numbers.
PIECES_BESIDE = r"'s|'t|'re|'ve|'m|'ll|'d|(?:(?!NEW)\p{L})+|(?!NEW)\p{N}|(?:NEW|[^\s\p{L}\p{N}])+"
#: Letters and numbers that Unicode 16.0 added, which the vocabulary's pieces know though
#: this Python's table may not; what was added later is neither. And its capitals beyond that table:
#: first and last, and the small letter of the first.
ADDED = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10EC4), (0x11380, 0x113D3), (0x116D0, 0x116E3),
    (0x11BC0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x16139), (0x16D40, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FA),
)
CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
END = "</w>"
#: Letters read beyond the lookahead before tokens are emitted.
CHUNK = 256
#: Pieces whose ids a worker keeps, half of them those last used, and the longest that it keeps.
CACHE_PIECES, CACHE_CHARS = 100_000, 40
#: Signs that mostly follow a word.
MARKS = ".,;:!?"
#: Letters of a text, and pieces of a word, whose ids are handed on together.
LETTERS_EACH, PIECES_EACH = 1 << 15, 4096


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def unassigned() -> frozenset[str]:
    """What the pattern library counts as letters and numbers though the vocabulary's character
    table does not know it."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    new = (c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")
    return frozenset(c for c in new if not any(a <= ord(c) <= b for a, b in ADDED))


def lookahead(merges: list[tuple[str, str]]) -> int:
    """Letters by which text to the right of a place can still change tokens before it."""
    reach: dict[str, int] = {}
    most = 0
    for a, b in merges:
        here = len(a.removesuffix(END)) + reach.get(b, 0)
        most = max(most, here)
        for t in (a, a + b):
            if reach.get(t, 0) < here:
                reach[t] = here
    # the last letter is read as marked or not once it is known whether another follows
    return most + max((len(a + b) for a, b in merges), default=0) + 1


class Vocabulary:
    """Merge ranks, ids and token bytes of a vocabulary file; made once per Python worker."""

    _loaded: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        ids: dict[str, int] = model["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        letters = byte_letters()
        # by byte: the id of its letter, and of the letter with the mark
        self.letters, self.marked = [ids[c] for c in letters], [ids[c + END] for c in letters]
        self.shift = max(ids.values()).bit_length()
        self.ranks = {ids[a] << self.shift | ids[b]: i for i, (a, b) in enumerate(merges)}
        self.made = [ids[a + b] for a, b in merges]
        self.sizes = {i: len(t.removesuffix(END)) for t, i in ids.items()}
        self.lookahead = lookahead(merges)
        self.new = unassigned()
        new = "[" + "".join(map(regex.escape, sorted(self.new))) + "]" if self.new else "(?!)"
        self.pieces = regex.compile(PIECES).finditer
        self.small = {a + i: small + i for a, b, small in CAPITALS for i in range(b - a + 1)}
        self.rare = self.new | set(map(chr, self.small))
        self.odd_pieces = regex.compile(PIECES_BESIDE.replace("NEW", new)).finditer
        # without a decoder in the file, tokens are joined by blanks, letter by letter
        self.special = [(t["content"], t["id"]) for t in model.get("added_tokens") or []]
        self.special_split = regex.compile("(" + "|".join(regex.escape(t) for t, _ in self.special) + ")").split if self.special else None
        self.special_ids = dict(self.special)
        self.text = {i: t.encode() for t, i in [*ids.items(), *self.special]}
        self.packed: dict[str, bytes] = {}
        self.packed_before: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def merge(self, parts: list[int]) -> list[int]:
        """Merges of a bounded window of ids, lowest rank first and leftmost among equals."""
        rank, made, shift, none = self.ranks.get, self.made, self.shift, 1 << 30
        pairs = [rank(a << shift | b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            new = parts[i] = made[best]
            del parts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] << shift | new, none)
            if i < len(pairs):
                pairs[i] = rank(new << shift | parts[i + 1], none)
        return parts

    def stream(self, data: bytes) -> Iterator[list[int]]:
        """Ids of the bytes of one piece, each as soon as it is final."""
        letters, sizes, window, at = self.letters, self.sizes, [], 0
        last = len(data) - 1
        while True:
            end = min(last, at + self.lookahead + CHUNK - len(window))
            window += [letters[b] for b in data[at:end]]
            at = end
            if at == last:
                yield self.merge([*window, self.marked[data[last]]])
                return
            tokens, used, n = self.merge(list(window)), 0, 0
            for t in tokens:
                if used + sizes[t] > len(window) - self.lookahead:
                    break
                used += sizes[t]
                n += 1
            yield tokens[:n]
            del window[:used]

    def pack(self, piece: str) -> bytes:
        """Ids of a piece as little-endian 32-bit numbers; known if it came lately."""
        if (packed := self.packed_before.get(piece)) is None:
            data = piece.encode()
            if len(data) <= CHUNK:
                ids = [self.letters[b] for b in data]
                ids[-1] = self.marked[data[-1]]
                packed = array("I", self.merge(ids)).tobytes()
            else:
                packed = b"".join(array("I", ids).tobytes() for ids in self.stream(data))
            if len(piece) > CACHE_CHARS:
                return packed
        if 2 * len(self.packed) >= CACHE_PIECES:
            self.packed_before, self.packed = self.packed, {}
        self.packed[piece] = packed
        return packed

    def normal(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # each letter by itself: a final sigma is not told apart
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text, some pieces at a time."""
        if self.special_split and "<|" in text:
            for i, p in enumerate(self.special_split(text)):
                if i % 2:
                    yield struct.pack("<I", self.special_ids[p])
                else:
                    yield from self._encode(p)
        else:
            yield from self._encode(text)

    def _encode(self, text: str) -> Iterator[bytes]:
        """No piece holds a blank and no normal form looks across one, so a text is cut at blanks,
        and a word that is a piece is looked up as it stands."""
        text, at = text.replace("\n", " "), 0
        while at < len(text):
            end = text.find(" ", at + LETTERS_EACH)
            end = len(text) if end < 0 else end
            out = []
            for w in self.normal(text[at:end]).split(" "):
                if (ids := self.packed.get(w)) is not None:
                    out.append(ids)
                    continue
                body = w.rstrip(MARKS)
                if body.isalpha() and (body.isascii() or self.rare.isdisjoint(body)):
                    # letters alone are a piece, and so are the marks behind them
                    out.append(self.packed.get(body) or self.pack(body))
                    if tail := w[len(body) :]:
                        out.append(self.packed.get(tail) or self.pack(tail))
                elif w:
                    for p in self.cut(w):
                        out.append(self.packed.get(p) or self.pack(p))
                        if len(out) >= PIECES_EACH:
                            yield b"".join(out)
                            out.clear()
            yield b"".join(out)
            at = end + 1

    def cut(self, word: str) -> Iterator[str]:
        """Pieces of a normal word."""
        odd = not word.isascii() and not self.rare.isdisjoint(word)
        return (m.group() for m in (self.odd_pieces(word.translate(self.small)) if odd else self.pieces(word)))


class Decoder:
    """Incremental text of token ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.name = vocabulary.text.__getitem__
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True

    def feed(self, ids: Iterable[int]) -> str:
        tokens = b" ".join(map(self.name, ids))
        if not tokens:
            return ""
        text = self.bytes.decode(tokens if self.first else b" " + tokens)
        self.first = False
        return text

    def end(self) -> str:
        return self.bytes.decode(b"", True)


def decode(vocabulary: Vocabulary, packed: Iterable[bytes]) -> Iterator[str]:
    """Text of packed ids, chunk by chunk."""
    d = Decoder(vocabulary)
    for p in packed:
        yield d.feed(memoryview(p).cast("I"))
    yield d.end()


def id_lists(n: list[int], packed: bytearray) -> pa.ListArray:
    """Lists of so many ids each from packed ids; numbers of Python would take ten times the room."""
    values = np.frombuffer(packed, dtype="<u4").astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(values))


def encode(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 and, unless ids is False, the ids themselves.

    path is the vocabulary file, which every machine must have. Nothing is shuffled: a text is
    encoded where it is read.
    """
    kept = [f for f in docs.schema.fields if ids or f.name != "text"]
    extra = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())] + [pa.field("ids", pa.list_(pa.int64()))] * ids

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(path)
        for b in batches(it):
            n, sha, back, lists = [], [], [], bytearray()
            for text in b.column(b.schema.get_field_index("text")).to_pylist():
                # a chunk is hashed, decoded and let go before the next is made
                size, of_ids, of_text, d = 0, hashlib.sha256(), hashlib.sha256(), Decoder(v)
                for packed in v.encode(text or ""):
                    size += len(packed) // 4
                    of_ids.update(packed)
                    of_text.update(d.feed(memoryview(packed).cast("I")).encode())
                    if ids:
                        lists += packed
                of_text.update(d.end().encode())
                n.append(size)
                sha.append(of_ids.hexdigest())
                back.append(of_text.hexdigest())
            cols = [b.column(b.schema.get_field_index(f.name)) for f in kept]
            made = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())] + ([id_lists(n, lists)] if ids else [])
            yield pa.RecordBatch.from_arrays(cols + made, schema=pa.schema([b.schema.field(b.schema.get_field_index(f.name)) for f in kept] + extra))

    made = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] + [T.StructField("ids", T.ArrayType(T.LongType()))] * ids)
    return docs.mapInArrow(run, T.StructType(kept + made.fields))
