"""Operator 11: byte-level BPE encoding and decoding in length-bucketed, padded matrices.

Texts are cut into pieces by the published pattern; a distinct piece is encoded once a task and looked up in a cache of
bounded bytes afterwards. Pieces that the cache lacks are bucketed by their length (powers of two) and become rows of padded matrices of
symbols. Each round, every row merges its pair of the lowest rank at the leftmost place; pairs are found in an open-addressing
hash table of arrays. Symbols that were merged away are squeezed out of the rows, and rows without a pair out of the matrix.

A pair that stands in a row more than once is merged at all its places in the round, from the left, as far as no merge makes a
pair of a lower rank: that one would come first, so the round ends there for this row. The result is that of one merge a round, and
rounds follow the ranks that occur in a row, not its length.

A long text is cut into segments where white space follows another character, which no piece spans, so beside a
text and its ids only a segment's pieces are held.

Defined results: a null or empty text has no ids (0 tokens, empty bytes); repeated rows give repeated results; a null id is
carried; other columns of the input are ignored; no rows give no rows. Two pairs of one rank: the leftmost goes first.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.bpe import Cache, groups_of
from vacancia.llm.common import drop_unused, per_worker, texts

#: Characters of a segment of a long text, and of segments whose new pieces are encoded together.
SEGMENT_CHARACTERS, GROUP_CHARACTERS = 1 << 20, 1 << 21
#: Symbols of a matrix; a longer piece has a matrix of its own.
CELLS = 1 << 17
#: Stands for the rank of a pair that isn't merged.
NONE = np.int32((1 << 31) - 1)

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64((1 << 64) - 1)
_BOUNDARY = regex.compile(r"(?<=\S)\s")
OTHER = "\ue000"  # private use: neither letter, number nor white space


class PairTable:
    """Ranks of pairs of symbols in a hash table with linear probing: arrays of keys and of ranks."""

    def __init__(self, left: np.ndarray, right: np.ndarray, ranks: np.ndarray):
        bits = max(4, int(4 * len(ranks)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self._keys = np.full(1 << bits, _EMPTY, np.uint64)
        self._ranks = np.full(1 << bits, NONE, np.int32)
        keys = self._key(left, right)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self._keys[at[todo]] == _EMPTY
            self._keys[at[todo[free]]] = keys[todo[free]]  # of several for a slot one gets in
            held = self._keys[at[todo]] == keys[todo]
            self._ranks[at[todo[held]]] = ranks[todo[held]]
            todo = todo[~held]
            at[todo] = (at[todo] + np.uint64(1)) & self._mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MULTIPLIER) >> self._shift

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE for no pair or where a symbol is missing (negative)."""
        out = np.full(len(left), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self._key(left[todo], right[todo])
        at = self._slot(keys)
        while len(todo):
            there = self._keys[at]
            hit = there == keys
            out[todo[hit]] = self._ranks[at[hit]]
            on = ~hit & (there != _EMPTY)
            todo, keys, at = todo[on], keys[on], (at[on] + np.uint64(1)) & self._mask
        return out


def library_exceptions() -> str:
    """Characters that the pattern's engine in Python takes for letters or numbers but the library's doesn't, as it knows an earlier Unicode version.

    Only characters that are new to Python's own tables can differ; the library is asked about these.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    new = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    known = tiktoken.Encoding("classes", pat_str=r"[\p{L}\p{N}]", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return "".join(c for c in new if not known.encode_ordinary(c))


def class_of(characters: str) -> str:
    """A character class's inside for characters in ascending order, as ranges."""
    codes = np.array(list(map(ord, characters)))
    ends = np.flatnonzero(np.diff(codes) > 1)
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(codes[[0, *(ends + 1)]], codes[[*ends, -1]]))


class MatrixBpe:
    """Encoder and decoder for a file of ranks (a base64 token and its rank a line) and a pattern."""

    def __init__(self, content: bytes, pattern: str, exceptions: str = ""):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self._byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        get = self.ranks.get
        pairs = [(a, b, rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None]
        self._pairs = PairTable(*np.array(pairs, np.int32).T)
        self._pattern = regex.compile(pattern)
        self._odd = re.compile(f"[{class_of(exceptions)}]") if exceptions else None
        self._plain = dict.fromkeys(map(ord, exceptions), OTHER)

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches in order, as the library's engine finds them."""
        if text.isascii() or not self._odd or not self._odd.search(text):
            return self._pattern.findall(text)
        return [text[m.start() : m.end()] for m in self._pattern.finditer(text.translate(self._plain))]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers: a piece that is a token has its id alone."""
        raw = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        buckets: dict[int, list[int]] = {}
        for at, r in enumerate(raw):
            rank = self.ranks.get(r)
            if rank is None:
                buckets.setdefault((len(r) - 1).bit_length(), []).append(at)
            else:
                out[at] = rank.to_bytes(4, "little")
        for bits, places in sorted(buckets.items()):
            rows = max(1, CELLS >> bits)
            for i in range(0, len(places), rows):
                self._merge([raw[at] for at in places[i : i + rows]], places[i : i + rows], out)
        return out

    def _merge(self, raw: list[bytes], places: list[int], out: list[bytes]) -> None:
        """Merges the rows of a matrix, one symbol a byte to begin with, and puts the ids of each at its place of ``out``."""
        lengths = np.array(list(map(len, raw)))
        columns = np.arange(lengths.max())
        symbols = np.full((len(raw), len(columns)), -1, np.int32)
        symbols[columns < lengths[:, None]] = self._byte[np.frombuffer(b"".join(raw), np.uint8)]
        ranks = np.full(symbols.shape, NONE, np.int32)
        ranks[:, :-1] = self._pairs.find(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(raw), -1)
        place = np.array(places)
        while True:
            least = ranks.min(1)
            closed = least == NONE
            if closed.any():
                kept = symbols[closed]
                alive = kept >= 0
                ids, ends = kept[alive].astype("<u4").tobytes(), 4 * np.cumsum(alive.sum(1))
                for at, a, b in zip(place[closed].tolist(), [0, *ends.tolist()], ends.tolist()):
                    out[at] = ids[a:b]
                symbols, ranks, least, place = symbols[~closed], ranks[~closed], least[~closed], place[~closed]
                if not len(place):
                    return
            symbols, ranks = self._round(symbols, ranks, least)

    def _round(self, symbols: np.ndarray, ranks: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the lowest pair of every row; ``ranks`` has the rank of the pair that starts at each symbol. A merged symbol's id is its pair's rank."""
        n, width = symbols.shape
        take = ranks == least[:, None]
        beside = take[:, 1:] & take[:, :-1]
        if beside.any():  # of a run of one symbol, pairs from the left
            at = np.broadcast_to(np.arange(width), take.shape)
            first = take.copy()
            first[:, 1:] &= ~take[:, :-1]
            take &= (at - np.maximum.accumulate(np.where(first, at, 0), axis=1)) % 2 == 0
        r, c = np.nonzero(take)
        new = least[r]
        joined = (c >= 2) & take[r, c - 2]  # the left neighbour is itself merged in this round
        left = np.where(joined, new, np.where(c >= 1, symbols[r, c - 1], -1))
        right = np.where(c + 2 < width, symbols[r, np.minimum(c + 2, width - 1)], -1)
        found = self._pairs.find(np.concatenate([left, new]), np.concatenate([new, right]))
        before, after = found[: len(r)], found[len(r) :]
        lower = (before < new) | (after < new)
        if lower.any():
            last = np.full(n, width)
            np.minimum.at(last, r[lower], c[lower])
            stay = c <= last[r]
            r, c, new, joined, before, after = (x[stay] for x in (r, c, new, joined, before, after))
        ranks[r, c] = after
        inner = c >= 1
        ranks[r[inner], (c - 1 - joined)[inner]] = before[inner]
        symbols[r, c] = new
        symbols[r, c + 1] = -1
        alive = symbols >= 0
        counts = alive.sum(1)
        filled = np.arange(counts.max()) < counts[:, None]
        squeezed, own = np.full(filled.shape, -1, np.int32), np.full(filled.shape, NONE, np.int32)
        squeezed[filled], own[filled] = symbols[alive], ranks[alive]
        return squeezed, own

    def decode(self, ids: bytes) -> bytes:
        """The bytes of little-endian unsigned 32-bit ids."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def segments(text: str) -> Iterator[str]:
    """The text in parts of SEGMENT_CHARACTERS and up to the next white space that follows another character; an empty text has none."""
    at = 0
    while at < len(text):
        cut = _BOUNDARY.search(text, at + SEGMENT_CHARACTERS) if len(text) - at > SEGMENT_CHARACTERS else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids (binary: little-endian unsigned 32-bit integers), decoded (binary: the bytes of these ids).

    The file of ranks is of fixed size and goes to the tasks as a broadcast.
    """
    content = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())
    exceptions = library_exceptions()
    schema = pa.schema([(id_column, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = per_worker("byte level" + pattern + str(hash(content.value)), lambda: (MatrixBpe(content.value, pattern, exceptions), Cache()))
        drop_unused()

        def entries(wanted: set[str]) -> dict[str, tuple[bytes, bytes]]:
            """(ids, decoded bytes) of each piece."""
            found = cache.look(wanted)
            fresh = list(wanted.difference(found))
            new = {piece: (ids, bpe.decode(ids)) for piece, ids in zip(fresh, bpe.encode_pieces(fresh))}
            cache.put_many(new)
            return found | new

        def encoded(group: list[str]) -> Iterator[tuple[bytes, bytes]]:
            split = [bpe.pieces(part) for part in group]
            found = entries(set().union(*split))
            for pieces in split:
                ids, decoded = zip(*map(found.__getitem__, pieces))  # a segment has a piece
                yield b"".join(ids), b"".join(decoded)

        for batch in batches:
            at = 0
            for group in groups_of(texts(batch.column(1)), GROUP_CHARACTERS):
                parts = [list(segments(text)) for text in group]
                results = (found for some in groups_of((s for p in parts for s in p), GROUP_CHARACTERS) for found in encoded(some))
                ids, decoded = [], []
                for p in parts:
                    own = [next(results) for _ in p]
                    ids.append(b"".join([x[0] for x in own]))
                    decoded.append(b"".join([x[1] for x in own]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)).cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], schema=schema)
                at += len(group)

    return docs.select(F.col(id_column).cast("long").alias(id_column), text_column).mapInArrow(run, f"{id_column} long, n_tokens long, ids binary, decoded binary")


def digests(encoded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row of encode(): id, n_tokens, ids_sha256 and decoded_sha256."""
    return encoded.select(id_column, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
