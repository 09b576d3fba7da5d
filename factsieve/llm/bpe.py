"""Byte-pair encoding as a streaming transducer with bounded lookahead, and the way back.

Merges are applied by rank inside pre-tokens (words). Whether a boundary between two symbols survives can only
depend on symbols to its right through a chain of merges of falling rank: a merge ``(x, y)`` across the boundary fails
if, before its rank, ``y`` loses its right end, or an inner boundary of ``y``, to a merge ``(u, v)`` of lower rank whose
``v`` reaches beyond ``y``, and so on. :func:`lookahead` takes the longest such chain over the whole merge list, as
one pass in rank order. A boundary with that many known symbols behind it is settled, so tokens before it are emitted
and forgotten: memory is the lookahead and a block of symbols, however long a word is.

Texts are read in pieces that end after white space, where no match of the word pattern, no composition of characters
and no special token crosses; without white space, in pieces that end before a character that composes with
nothing, and the word at hand is carried over. Words met before come from a table of bounded size.

The vocabulary file (``tokenizers`` JSON: BPE, lower-cased NFC text, words by pattern, byte alphabet, a suffix at word
ends) is read by each Python worker from ``path``, so it has to be installed on every executor. It decides what is
merged; the merging itself is done here. Characters newer than Python's Unicode tables are classed as the library
classes them.

One scan, no shuffle. Defined results: null reads as empty and gives no ids; special tokens written in a text become their ids;
repeated rows are repeated; input columns named like an output are replaced; a null list of ids decodes to an empty text.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factsieve.llm.common import col, map_batches, slices

#: Bytes of text read at a time, symbols of a long word merged at a time, words remembered.
PIECE, BLOCK, REMEMBERED = 1 << 16, 4096, 1 << 18
#: The rank of a pair that no rule merges.
NONE = 1 << 30
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable stand-in of every byte: itself where printable, else the next code point from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    """A merge list over ids of pieces: ``ranks[left << 20 | right]``, what each rank makes, and the sufficient lookahead."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], known_lookahead: int = 0):
        self.ranks: dict[int, int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, out = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if out in made or any(x in made and made[x][0] >= rank for x in (left, right)):
                raise ValueError(f"merge {rank} is not in proper order")
            self.ranks[left << 20 | right] = rank
            made[out] = (rank, left, right)
        for rank, left, right in made.values():
            if any(made.get(x, (-1,))[0] >= rank for x in (left, right)):
                raise ValueError(f"merge {rank} uses a piece that is made later")
        self.made = list(made)
        self.lookahead = known_lookahead or lookahead(list(made.values()), list(made))

    def apply(self, symbols: list[int]) -> list[int]:
        """The pieces that are left when no rule applies: lowest rank first, leftmost among equals."""
        if len(symbols) > 48:
            return self._apply_long(symbols)
        rank, made, out = self.ranks.get, self.made, symbols[:]
        ranks = [rank(a << 20 | b, NONE) for a, b in zip(symbols, symbols[1:])]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            out[i : i + 2] = [made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(out[i - 1] << 20 | out[i], NONE)
            if i < len(ranks):
                ranks[i] = rank(out[i] << 20 | out[i + 1], NONE)
        return out

    def _apply_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap over a linked list."""
        ranks, out, n = self.ranks, symbols[:], len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[k], i, k) for i in range(n - 1) if (k := out[i] << 20 | out[i + 1]) in ranks]
        heapq.heapify(heap)
        while heap:
            least, i, key = heapq.heappop(heap)
            j = after[i]
            if j >= n or out[i] < 0 or out[i] << 20 | out[j] != key:
                continue
            out[i], out[j] = self.made[least], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (k := out[a] << 20 | out[b]) in ranks:
                    heapq.heappush(heap, (ranks[k], a, k))
        return [x for x in out if x >= 0]


def lookahead(rules: list[tuple[int, int, int]], made: list[int]) -> int:
    """Symbols to the right of a boundary that decide whether it stays; ``rules`` are ``(rank, left, right)`` in rank order.

    ``reach[u][n]``: how far right of the end of ``u`` the fate of a merge ``(u, v)`` seen so far, ``v`` of ``n`` symbols, may
    depend. The merge at hand, ``(x, y)``, depends on ``y`` and on every earlier merge whose left part ends inside ``y``
    or with it and whose right part ends beyond it.
    """
    size: dict[int, int] = {}
    ends: dict[int, list[tuple[int, int]]] = {}  # parts of a piece and how far before its end they end
    reach: dict[int, dict[int, int]] = {}
    most = 1
    for (_, left, right), out in zip(rules, made, strict=True):
        a, b = size.setdefault(left, 1), size.setdefault(right, 1)
        size[out] = a + b
        ends[out] = [(out, 0), *((p, e + b) for p, e in ends.get(left, [(left, 0)])), *ends.get(right, [(right, 0)])]
        far = b
        for part, e in ends.get(right, [(right, 0)]):
            for n, f in reach.get(part, {}).items():
                if n > e:
                    far = max(far, b + f - e)
        own = reach.setdefault(left, {})
        own[b] = max(own.get(b, 0), far)
        most = max(most, far)
    return most


class Vocabulary:
    """What the file says, and tables made from it."""

    def __init__(self, path: str, known_lookahead: int = 0):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, (split, bytes_step) = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if (model["type"], kinds, split["type"], bytes_step["type"], spec["decoder"]) != ("BPE", ["NFC", "Replace", "Lowercase"], "Split", "ByteLevel", None):
            raise ValueError(f"{path} describes steps this encoder does not have")
        self.end = model["end_of_word_suffix"] or ""
        self.merges = Merges(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], known_lookahead)
        alphabet = byte_alphabet()
        self.inner = [model["vocab"][c] for c in alphabet]
        self.last = [model["vocab"][c + self.end] for c in alphabet]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {**model["vocab"], **self.special}
        self.pieces = [""] * (max(ids.values()) + 1)
        for piece, i in ids.items():
            self.pieces[i] = piece
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.longest_special = max(map(len, self.special), default=0)
        self.library = Tokenizer.from_file(path)
        self.words = regex.compile(split["pattern"]["Regex"])
        self.runs = (regex.compile(r"\p{L}+"), regex.compile(r"[^\s\p{L}\p{N}]+"))
        self.usual: set[str] = set()  # characters met that Python's tables know
        self.new_words, self.new_runs = self._new_characters(split["pattern"]["Regex"])

    def _new_characters(self, pattern: str) -> tuple[regex.Pattern, tuple[regex.Pattern, ...]]:
        """Patterns for texts with characters the pattern module counts as letters or digits but Python does not know: the library classes them."""
        every = "".join(map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))))
        new = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
        glued = self.library.pre_tokenizer.pre_tokenize_str("\n".join(f"a{c}a" for c in new))
        starts = {at for _, (at, _) in glued}
        letters = {c for i, c in enumerate(new) if 4 * i + 1 not in starts}
        doubled = self.library.pre_tokenizer.pre_tokenize_str("\n".join(c * 2 for c in new))
        starts = {at for _, (at, _) in doubled}
        digits = {c for i, c in enumerate(new) if 3 * i + 1 in starts} - letters
        not_letters = "".join(c for c in new if c not in letters)
        not_digits = "".join(c for c in new if c not in digits)
        letter = rf"[\p{{L}}--[{not_letters}͸]]"
        digit = rf"[\p{{N}}--[{not_digits}͸]]"
        flags = regex.V1
        other = rf"(?:(?!{letter}|{digit})\S)+"
        exact = pattern.replace(r"[^\s\p{L}\p{N}]+", other).replace(r"[\p{L}]", letter).replace(r"[\p{N}]", digit)
        return regex.compile(exact, flags), (regex.compile(letter + "+", flags), regex.compile(other, flags))


    def are_usual(self, characters: set[str]) -> bool:
        known = {c for c in characters if unicodedata.category(c) != "Cn"}
        self.usual |= known
        return len(known) == len(characters)


@lru_cache(maxsize=2)
def vocabulary(path: str, known_lookahead: int = 0) -> Vocabulary:
    """The vocabulary of a file, read once in a process; tasks get the lookahead from the driver."""
    return Vocabulary(path, known_lookahead)


class Known(dict):
    """The ids of words, as little-endian 32-bit integers; forgotten all at once when there are too many."""

    def __init__(self, words: Vocabulary):
        super().__init__()
        self.words = words

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        if len(data) > BLOCK:
            stream = Word(self.words)
            return stream.feed(data) + stream.finish()
        symbols = [self.words.inner[b] for b in data]
        symbols[-1] = self.words.last[data[-1]]
        out = np.array(self.words.merges.apply(symbols), "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out
        return out


class Word:
    """One word of any length: bytes in, settled ids out."""

    def __init__(self, words: Vocabulary):
        self.words, self.symbols, self.final = words, [], 0
        self.lengths: dict[int, int] = {}

    def _size(self, piece: int) -> int:
        text = self.words.pieces[piece]
        return len(text) - (len(self.words.end) if self.words.end and text.endswith(self.words.end) else 0)

    def feed(self, data: bytes) -> bytes:
        out = []
        ahead = self.words.merges.lookahead
        for at in range(0, len(data), BLOCK):
            part = data[at : at + BLOCK]
            self.symbols += [self.words.inner[b] for b in part]
            self.final = part[-1]
            settled, taken = len(self.symbols) - ahead, 0
            if settled < BLOCK // 2:
                continue
            for piece in self.words.merges.apply(self.symbols):
                if taken + self._size(piece) > settled:
                    break
                taken += self._size(piece)
                out.append(piece)
            del self.symbols[:taken]
        return np.array(out, "<u4").tobytes()

    def finish(self) -> bytes:
        if not self.symbols:
            return b""
        self.symbols[-1] = self.words.last[self.final]
        out, self.symbols = self.words.merges.apply(self.symbols), []
        return np.array(out, "<u4").tobytes()


class Encoder:
    """Text in pieces, ids out. ``feed(piece, closed)``: closed pieces end after white space or with the text."""

    def __init__(self, words: Vocabulary, known: Known):
        self.words, self.known = words, known
        self.tail, self.run, self.word = "", None, None
        self.new = False  # whether what is carried over has new characters

    def feed(self, text: str, closed: bool) -> bytes:
        if self.words.special_pattern is None or not any(s in text for s in self.words.special):
            return self._section(text, closed)
        out = []
        parts = self.words.special_pattern.split(text)
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.words.special[part].to_bytes(4, "little"))
            else:
                out.append(self._section(part, closed or i < len(parts) - 1))
        return b"".join(out)

    def _normal(self, text: str) -> tuple[str, bool]:
        """The text in lower case, composed, and whether it has characters newer than Python's tables."""
        if text.isascii():
            return text.lower(), False
        if not (strange := set(text) - self.words.usual) or self.words.are_usual(strange):
            return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower(), False
        return self.words.library.normalizer.normalize_str(text), True

    def _section(self, text: str, closed: bool) -> bytes:
        text, new = self._normal(text)
        self.new = new = new or (self.new and (self.run is not None or bool(self.tail)))
        pattern = self.words.new_words if new else self.words.words
        if closed and self.run is None and not self.tail:
            return b"".join(map(self.known.__getitem__, pattern.findall(text)))
        runs = self.words.new_runs if new else self.words.runs
        text, self.tail, out = self.tail + text, "", []
        if self.run is not None:
            more = runs[self.run].match(text)
            stop = more.end() if more else 0
            if stop:
                out.append(self.word.feed(text[:stop].encode()))
            if stop == len(text) and not closed:
                return b"".join(out)
            out.append(self.word.finish())
            self.run, text = None, text[stop:]
        for found in pattern.finditer(text):
            start, stop = found.span()
            if closed or (stop < len(text) and start + 3 <= len(text)):
                out.append(self.known[found.group()])
                continue
            self.tail = text[start:]
            if stop == len(text) and stop - start > 3:
                for k, run in enumerate(runs):
                    if run.fullmatch(text, start):
                        self.run, self.word, self.tail = k, Word(self.words), ""
                        out.append(self.word.feed(text[start:].encode()))
            break
        return b"".join(out)


def pieces(data: bytes | memoryview, special: tuple[str, ...]) -> Iterator[tuple[str, bool]]:
    """A text in parts of about ``PIECE`` bytes with whether they end after white space or with the text."""
    at, size = 0, PIECE
    reach = max(map(len, special), default=1)
    while len(data) - at > size:
        window = bytes(data[at : at + size])
        stop = max(window.rfind(b" "), window.rfind(b"\n")) + 1
        if stop:
            yield window[:stop].decode(), True
        else:
            text = window.decode("utf-8", "ignore")
            i = len(text) - reach
            while i > 0 and not _apart(text, i, special):
                i -= 1
            if i <= 0:  # nothing but marks or one special token: a longer look
                size *= 2
                continue
            yield text[:i], False
            stop = len(text[:i].encode())
        at, size = at + stop, PIECE
    yield bytes(data[at:]).decode(), True


def _apart(text: str, i: int, special: tuple[str, ...]) -> bool:
    """Whether no character composition and no special token crosses the place before ``text[i]``."""
    c = text[i]
    if unicodedata.category(c)[0] == "M" or unicodedata.category(c) == "Cn" or 0x1100 <= ord(c) < 0x1200:
        return False
    return not any(s in text[max(0, i - len(s) + 1) : i + len(s) - 1] for s in special)


class Pieces:
    """Ids in, text out, as the library decodes without a decoder: pieces in the byte alphabet, one space between."""

    def __init__(self, words: Vocabulary):
        self.words, self.begun = words, False

    def feed(self, ids: bytes) -> str:
        read = np.frombuffer(ids, "<u4").tolist()
        if not read:
            return ""
        out = " ".join(map(self.words.pieces.__getitem__, read))
        out, self.begun = " " + out if self.begun else out, True
        return out

    def finish(self) -> str:
        return ""


class Plain:
    """Ids in, readable text out: bytes of the pieces through an incremental UTF-8 reader, a space for every word end.

    A character cut by the end of a part waits for its other bytes; bytes that never make a character read as U+FFFD.
    """

    def __init__(self, words: Vocabulary):
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        special = set(words.special)
        self.bytes = [p.encode() if p in special else bytes(byte[c] for c in p.removesuffix(words.end)) + (b" " if words.end and p.endswith(words.end) else b"") for p in words.pieces]
        self.reader = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        return self.reader.decode(b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())))

    def finish(self) -> str:
        return self.reader.decode(b"", True)


def _texts(column: pa.Array) -> Iterator[memoryview]:
    """The bytes of every value, not copied."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    for value in column.cast(kind):
        yield memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")


def encoded_parts(words: Vocabulary, known: Known, text: memoryview) -> Iterator[bytes]:
    """The ids of one text, part by part."""
    encoder = Encoder(words, known)
    for piece, closed in pieces(text, tuple(words.special)):
        yield encoder.feed(piece, closed)


def _with(frame: DataFrame, made: list[tuple[str, T.DataType]]) -> tuple[DataFrame, T.StructType]:
    """The input columns that are no output, and the schema with the outputs."""
    names = {n for n, _ in made}
    others = frame.select(*[col(c) for c in dict.fromkeys(frame.columns) if c not in names])
    return others, T.StructType([*others.schema.fields, *(T.StructField(n, t) for n, t in made)])


def encode(documents: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``documents`` with ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``."""
    path = path or vocabulary_path()
    ahead = vocabulary(path).merges.lookahead
    others, schema = _with(documents, [("ids", T.BinaryType()), ("n_tokens", T.LongType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, ahead)
        known = Known(words)
        for batch in slices(batches, 500):
            ids = [b"".join(encoded_parts(words, known, t)) for t in _texts(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=schema.names)

    return map_batches(documents.select(*[col(c) for c in others.columns], col(text)), step, schema)


def decode(encoded: DataFrame, ids: str = "ids", plain: bool = False, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``: as the library joins the pieces, or readable text with ``plain``."""
    path = path or vocabulary_path()
    ahead = vocabulary(path).merges.lookahead
    others, schema = _with(encoded, [("decoded", T.StringType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, ahead)
        for batch in slices(batches, 500):
            out = []
            for data in _texts(batch.column(batch.num_columns - 1)):
                reader = Plain(words) if plain else Pieces(words)
                out.append("".join([*(reader.feed(data[at : at + PIECE]) for at in range(0, len(data), PIECE)), reader.finish()]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=schema.names)

    return map_batches(encoded.select(*[col(c) for c in others.columns], col(ids)), step, schema)


def digest(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: encoded and decoded part by part, nothing kept."""
    path = path or vocabulary_path()
    ahead = vocabulary(path).merges.lookahead
    schema = documents.select("doc_id").schema.add("n_tokens", T.LongType()).add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, ahead)
        known = Known(words)
        for batch in slices(batches, 500):
            counts, hashes, back = [], [], []
            for text in _texts(batch.column(1)):
                n, ids, decoded, reader = 0, hashlib.sha256(), hashlib.sha256(), Pieces(words)
                for part in encoded_parts(words, known, text):
                    n += len(part) // 4
                    ids.update(part)
                    decoded.update(reader.feed(part).encode())
                decoded.update(reader.finish().encode())
                counts.append(n)
                hashes.append(ids.hexdigest())
                back.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())], names=schema.names)

    return map_batches(documents.select("doc_id", "text"), step, schema)
