"""Operator 10: BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A text's tokens depend only on its white-space separated chunks: the normaliser maps white space to
white space, no pattern of the pre-tokeniser crosses it and no special token holds any. So each
task encodes a distinct chunk once and looks the rest up in a cache of bounded bytes.

Within a piece, leaf i of the tree holds rank * n + i for the pair that starts at symbol i; the
root therefore yields the leftmost pair of the lowest rank. A merge changes three leaves, each in
O(log n). The work for a piece of n symbols is O(n log n), however long it is, and every piece of two
symbols or more goes through a tree. Trees of one size are rows of an array: each step takes one merge of
every piece that still has one, with the same three updates and their paths to the root for all.

Defined results: a null or empty text has no tokens (0, and the digests of an empty string);
repeated rows give repeated results; a null id is carried; other columns of the input are ignored; no rows
give no rows. A very long text is held whole, with its chunks and their ids, and nothing else grows with it.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vacancia.llm.common import map_arrow, per_worker, texts

# Fixed values of the tokenizer's published pattern and of Unicode's White_Space property.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of keys and values that a generation of a worker's caches of chunks and of pieces may hold.
CHUNK_BYTES, PIECE_BYTES = 80 << 20, 40 << 20
#: Of an integer in a list.
INTEGER_BYTES = 32
#: That a value takes at most for a character of its key.
MOST_BYTES_A_CHARACTER = 256

#: Characters of texts whose new chunks are encoded together.
GROUP_CHARACTERS = 1 << 21
#: Leaves of the largest trees that are built as rows of an array; larger ones are built one by one.
MOST_LEAVES = 32

_SEPARATORS = re.compile(r"[\x1c-\x1f]")  # str.split() takes these for white space, Unicode doesn't
_SPLIT = re.compile(f"[{WHITE_SPACE}]+")
_RUN = re.compile("L+|N|O+")
_ids, _decoded = itemgetter(0), itemgetter(1)
_ASCII = re.compile("|".join(CONTRACTIONS) + r"|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")


def chunks(text: str) -> list[str]:
    """The maximal runs of characters that are not white space."""
    if _SEPARATORS.search(text):
        return [x for x in _SPLIT.split(text) if x]
    return text.split()


class _Classes(dict):
    """Letter, number, other (white space splits before), or unassigned."""

    def __missing__(self, ch: str) -> str:
        kind = unicodedata.category(ch)
        out = self[ch] = {"L": "L", "N": "N"}.get(kind[0], "U" if kind == "Cn" else "O")
        return out


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use: printable Latin-1 stands for itself, the rest follow from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class SegmentTree:
    """The least of a row of integers under point updates, each in logarithmic time: a binary tree in one list, node i over nodes 2i and 2i + 1."""

    __slots__ = ("nodes", "size")

    def __init__(self, leaves: list[int], beyond: int):
        """``beyond`` fills the tree up; no leaf may exceed it."""
        self.size = size = 1 << (len(leaves) - 1).bit_length()
        level = leaves + [beyond] * (size - len(leaves))
        levels = [level]
        while len(level) > 1:
            level = list(map(min, level[::2], level[1::2]))
            levels.append(level)
        nodes = [0]
        for level in reversed(levels):
            nodes += level
        self.nodes = nodes

    def least(self) -> int:
        return self.nodes[1]

    def put(self, i: int, value: int) -> None:
        nodes = self.nodes
        i += self.size
        nodes[i] = value
        while i > 1:
            other = nodes[i ^ 1]
            if other < value:
                value = other
            i >>= 1
            if nodes[i] == value:
                return
            nodes[i] = value


class SegmentTreeBpe:
    """Encoder and decoder for a tokenizers JSON file with the word-end suffix."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        suffix = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self._inner = [self.vocab[s] for s in symbols]
        self._last = [self.vocab[s + suffix] for s in symbols]
        self._pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._pairs.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        keys = {(a << 20) + b: found for (a, b), found in self._pairs.items()}
        self._keys = np.array(sorted(keys), np.int64)
        self._rank_of, self._made = (np.array([keys[k][x] for k in sorted(keys)], np.int64) for x in (0, 1))
        self._made = self._made[np.argsort(self._rank_of, kind="stable")]
        self._ranks = np.sort(self._rank_of)
        self.trees = 0  # that were built
        self._special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self._first_of_special = min((s[:2] for s in self.specials), default="") if len({s[:2] for s in self.specials}) == 1 else ""
        self._classes = _Classes()
        self._content, self._library = content, None
        self._by_piece, self._told_of_piece = Cache(PIECE_BYTES), Cache(PIECE_BYTES)
        self._names = {i: str(i) for i in self.tokens}

    def merge(self, symbols: list[int]) -> list[int]:
        """Symbols after all merges: again and again the leftmost pair of the lowest rank, which the tree's root yields."""
        n, get = len(symbols), self._pairs.get
        if n == 1:
            return symbols
        none = len(self._pairs) * n + n
        found = list(map(get, zip(symbols, symbols[1:])))
        tree = SegmentTree([f[0] * n + i if f else none for i, f in enumerate(found)], none)
        self.trees += 1
        nodes, put = tree.nodes, tree.put
        if nodes[1] == none:
            return symbols
        symbols, merged = list(symbols), [f and f[1] for f in found]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (least := nodes[1]) != none:
            i = least % n
            j = after[i]
            new = symbols[i] = merged[i]
            k = after[i] = after[j]
            symbols[j] = -1
            value = none
            if k < n:
                put(j, none)
                before[k] = i
                if f := get((new, symbols[k])):
                    merged[i] = f[1]
                    value = f[0] * n + i
            put(i, value)
            h = before[i]
            if h >= 0:
                value = none
                if f := get((symbols[h], new)):
                    merged[h] = f[1]
                    value = f[0] * n + h
                put(h, value)
        return [s for s in symbols if s >= 0]

    def merge_many(self, many: list[list[int]]) -> list[list[int]]:
        """merge() of many symbols, trees of one size together."""
        out: list[list[int]] = list(many)
        by_size: dict[int, list[int]] = {}
        for at, symbols in enumerate(many):
            if len(symbols) > 1:
                by_size.setdefault(1 << (len(symbols) - 2).bit_length(), []).append(at)
        for size, places in by_size.items():
            if size > MOST_LEAVES:
                for at in places:
                    out[at] = self.merge(many[at])
            else:
                for at, ids in zip(places, self._merge_rows([many[at] for at in places], size)):
                    out[at] = ids
        return out

    def _leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, wide: int) -> np.ndarray:
        """Leaves of pairs of symbols: rank * wide + place, or what comes after every rank."""
        keys = (left << 20) + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where((self._keys[at] == keys) & (left >= 0) & (right >= 0), self._rank_of[at] * wide + place, (self._ranks[-1] + 1) * wide)

    def _merge_rows(self, many: list[list[int]], size: int) -> list[list[int]]:
        """merge() of symbols whose trees have ``size`` leaves; column ``wide`` stands for what is beyond a piece."""
        n, wide = len(many), size + 1
        self.trees += n
        none = (self._ranks[-1] + 1) * wide
        lengths = np.array(list(map(len, many)))
        symbols = np.full((n, wide + 1), -1, np.int64)
        symbols[np.arange(wide + 1) < lengths[:, None]] = np.concatenate(many)
        after = np.tile(np.arange(1, wide + 2), (n, 1))
        after[np.arange(n), lengths - 1] = wide
        before = np.tile(np.arange(-1, wide), (n, 1))
        before[:, 0] = wide
        nodes = np.empty((n, 2 * size), np.int64)
        nodes[:, size:] = self._leaves(symbols[:, :size], symbols[:, 1:wide], np.arange(size), wide)
        level = size
        while level > 1:
            nodes[:, level // 2 : level] = np.minimum(nodes[:, level : 2 * level : 2], nodes[:, level + 1 : 2 * level : 2])
            level //= 2
        open_ = np.flatnonzero(nodes[:, 1] < none)
        while len(open_):
            rank, i = np.divmod(nodes[open_, 1], wide)
            j = after[open_, i]
            k = after[open_, j]
            h = before[open_, i]
            new = self._made[np.searchsorted(self._ranks, rank)]
            symbols[open_, i], symbols[open_, j] = new, -1
            after[open_, i], before[open_, k] = k, i
            own = self._leaves(new, symbols[open_, k], i, wide)
            first = h == wide
            h = np.where(first, i, h)
            last = j >= size  # the last symbol has no leaf
            nodes[open_, size + np.where(last, i, j)] = none
            nodes[open_, size + h] = self._leaves(symbols[open_, h], new, h, wide)
            nodes[open_, size + i] = own
            paths = size + np.stack([np.where(last, i, j), h, i])
            for _ in range(size.bit_length() - 1):
                paths >>= 1
                nodes[open_, paths] = np.minimum(nodes[open_, 2 * paths], nodes[open_, 2 * paths + 1])
            open_ = open_[nodes[open_, 1] < none]
        kept = symbols >= 0
        flat, ends = symbols[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def pieces(self, text: str) -> list[str]:
        """Normalised pieces of a chunk, or of any text."""
        if text.isascii():
            return [text.lower()] if text.isalpha() else _ASCII.findall(text.lower())
        if text.isalpha() and "Σ" not in text and (low := unicodedata.normalize("NFC", text).lower()).isalpha():
            return [low]
        kinds = "".join(map(self._classes.__getitem__, text))
        if "U" in kinds:  # assigned by a later Unicode version than Python's, maybe: the library's own tables decide
            return self._by_library(text)
        text = _SPLIT.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()
        kinds = "".join(map(self._classes.__getitem__, text))
        out, at = [], 0
        while at < len(text):
            if text[at] == "'":
                if word := next((c for c in CONTRACTIONS if text.startswith(c, at)), None):
                    out.append(word)
                    at += len(word)
                    continue
            elif text[at] == " ":
                at += 1
                continue
            end = _RUN.match(kinds, at).end()
            piece = text[at:end]
            if " " in piece:
                end = at + piece.index(" ")
                piece = text[at:end]
            out.append(piece)
            at = end
        return out

    def _by_library(self, text: str) -> list[str]:
        from tokenizers import Tokenizer

        if self._library is None:
            self._library = Tokenizer.from_str(self._content)
        text = self._library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def encode_many(self, many: list[str]) -> list[list[int]]:
        """Ids of each text; the pieces that the cache lacks are merged together."""
        split = [self._split(text) for text in many]
        wanted = set(chain.from_iterable(split))
        found = self._by_piece.look(wanted)
        fresh = list(wanted.difference(found))
        new = dict(zip(fresh, self._merged(fresh)))
        self._by_piece.put_many(new)
        found |= new
        return [[i for piece in pieces for i in found[piece]] for pieces in split]

    def tell_many(self, many: list[str]) -> list[tuple[str, str]]:
        """(decimal ids, decoded text) of each text, put together from those of its pieces; most texts are one piece and share what that has."""
        split = [self._split(text) for text in many]
        wanted = set(chain.from_iterable(split))
        found = self._told_of_piece.look(wanted)
        fresh = list(wanted.difference(found))
        name, token = self._names.__getitem__, self.tokens.__getitem__
        new = {piece: (" ".join(map(name, ids)), " ".join(map(token, ids))) for piece, ids in zip(fresh, self._merged(fresh))}
        self._told_of_piece.put_many(new)
        found |= new
        return [found[pieces[0]] if len(pieces) == 1 else tuple(map(" ".join, zip(*map(found.__getitem__, pieces)))) if pieces else ("", "") for pieces in split]

    def _merged(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces and special tokens."""
        inner, last = self._inner, self._last
        raw = [piece.encode() for piece in pieces]
        ids = self.merge_many([[*map(inner.__getitem__, r[:-1]), last[r[-1]]] for r in raw])
        return [[self.specials[p]] if p in self.specials else i for p, i in zip(pieces, ids)] if not self.specials.keys().isdisjoint(pieces) else ids  # no other text holds a whole special token

    def _split(self, text: str) -> list[str]:
        """Pieces and special tokens."""
        if not (self._special and self._first_of_special in text):
            return self.pieces(text)
        out: list[str] = []
        for part in self._special.split(text):
            out += [part] if part in self.specials else self.pieces(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library does for a file without a decoder: the tokens, special ones too, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))


def held_bytes(value: object) -> int:
    """What a value of a cache takes: a text, bytes, a list of integers, or a tuple of such."""
    size = sys.getsizeof(value)
    if isinstance(value, tuple):
        return size + sum(map(held_bytes, value))
    return size + INTEGER_BYTES * len(value) if isinstance(value, list) else size


def held_bytes_of(values: list) -> int:
    """held_bytes() of all values, which are of one kind and hold nothing that holds more."""
    size = sum(map(sys.getsizeof, values))
    if isinstance(values[0], tuple):
        return size + sum(map(sys.getsizeof, chain.from_iterable(values)))
    return size + INTEGER_BYTES * sum(map(len, values)) if isinstance(values[0], list) else size


class Cache:
    """Values by text in two generations of at most ``most_bytes`` each: the older one goes when the younger is full. What alone takes an eighth is not kept."""

    ENTRY_BYTES = 100  # of a dictionary's slot

    def __init__(self, most_bytes: int = CHUNK_BYTES):
        self._most, self._used, self._young, self._older = most_bytes, 0, {}, {}

    def look(self, wanted: set[str]) -> dict[str, object]:
        """What is held of the wanted keys."""
        young, older = self._young, self._older
        found = {k: young[k] for k in wanted.intersection(young)}
        if again := {k: older[k] for k in wanted.intersection(older).difference(found)}:
            found |= again
            self.put_many(again)
        return found

    def put_many(self, entries: dict[str, object]) -> None:
        """put() of values of one kind, sized together; one at a time where they may not fit as a whole or one may be too large."""
        if not entries:
            return
        size = sum(map(sys.getsizeof, entries)) + held_bytes_of(list(entries.values())) + self.ENTRY_BYTES * len(entries)
        if size > self._most or 8 * MOST_BYTES_A_CHARACTER * max(map(len, entries)) > self._most:
            for key, value in entries.items():
                self.put(key, value)
            return
        if self._used + size > self._most:
            self._older, self._young, self._used = self._young, {}, 0
        self._used += size
        self._young.update(entries)

    def put(self, key: str, value: object) -> None:
        size = sys.getsizeof(key) + held_bytes(value) + self.ENTRY_BYTES
        if 8 * size > self._most:
            return
        if self._used + size > self._most:
            self._older, self._young, self._used = self._young, {}, 0
        self._used += size
        self._young[key] = value


def groups_of(many: Iterator[str], characters: int) -> Iterator[list[str]]:
    """Texts in order, in groups of so many characters and one text's more."""
    group, size = [], 0
    for text in many:
        group.append(text)
        size += len(text)
        if size >= characters:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_documents(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 of the decimal ids, decoded_sha256 of the decoded text.

    The tokenizer file is of fixed size and is shipped with the task closure through a broadcast.
    """
    content = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())

    def make():
        bpe, cache = per_worker("encode" + content.value, lambda: (SegmentTreeBpe(content.value), Cache()))

        def entries(wanted: set[str]) -> dict[str, tuple[str, str]]:
            """(decimal ids, decoded text) of each chunk."""
            found = cache.look(wanted)
            fresh = list(wanted.difference(found))
            new = dict(zip(fresh, bpe.tell_many(fresh)))
            cache.put_many(new)
            return found | new

        def step(batch: pa.RecordBatch):
            counts, digests, decoded = [], [], []
            for group in groups_of(texts(batch.column(1)), GROUP_CHARACTERS):
                split = list(map(chunks, group))
                found = entries(set(chain.from_iterable(split)))
                for parts in split:
                    told = list(map(found.__getitem__, parts))
                    ids = " ".join(map(_ids, told))
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    digests.append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded.append(hashlib.sha256(" ".join(map(_decoded, told)).encode()).hexdigest())
            return [batch.column(0), counts, digests, decoded]

        return step

    return map_arrow(docs.select(id_column, text_column), make, f"{id_column} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
