"""Operator 2: bounded-space online packing of token ids into sequences.

Each partition keeps at most OPEN_WINDOWS windows open. A piece goes into the open window that it
fits best; a window that becomes full leaves. Where none fits and no more may be opened, the
fullest window is topped up with the head of the piece, leaves without padding, and the rest of
the piece is placed anew. At the end of a partition its open windows are poured together, so at
most one partial window is left over; leftovers of MERGE_PARTITIONS partitions at a time are then
merged whole, first fit by decreasing size. Padding is thus a few windows for each
MERGE_PARTITIONS partitions, whatever the size of the corpus.

Memory in a task: OPEN_WINDOWS windows and one document. Only the leftovers are shuffled.

Defined results: a null or empty text is the end-of-document id alone; repeated rows are packed
each; a null doc_id is carried; other columns of the input are ignored; no rows give no pieces.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from sys import getsizeof

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vacancia.llm.bpe import GROUP_CHARACTERS, SegmentTreeBpe, byte_symbols, chunks, groups_of
from vacancia.llm.common import checkpoint, drop_unused, per_worker, texts

SEQUENCE_TOKENS = 4096
OPEN_WINDOWS = 32
MERGE_PARTITIONS = 128
END_OF_DOCUMENT = 2
ID_BYTES = 4
#: Of chunks and their ids that a generation of a worker's caches may hold.
CACHE_BYTES = 80 << 20

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, offset bigint"
WINDOWS = f"sequence_id bigint, partition bigint, total bigint, leftover boolean, pieces array<struct<{', '.join(':'.join(x.split()) for x in PIECE.split(', '))}>>"
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass
class Piece:
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: bytes

    def cut(self, tokens: int) -> tuple[Piece, Piece]:
        at = tokens * ID_BYTES
        return Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:at]), Piece(self.doc_id, self.start + tokens, self.doc_tokens, self.ids[at:])

    def __len__(self) -> int:
        return len(self.ids) // ID_BYTES


@dataclass
class Window:
    number: int
    pieces: list[Piece] = field(default_factory=list)
    total: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.total += len(piece)

    def rows(self) -> list[dict]:
        out, at = [], 0
        for p in self.pieces:
            out.append({"doc_id": p.doc_id, "start": p.start, "length": len(p), "ids_crc32": zlib.crc32(p.ids), "doc_tokens": p.doc_tokens, "offset": at})
            at += len(p)
        return out


class Packer:
    """Packs a stream of documents; add() and close() return the windows that leave."""

    def __init__(self, capacity: int = SEQUENCE_TOKENS, open_windows: int = OPEN_WINDOWS):
        self.capacity, self.open_windows = capacity, open_windows
        self.number = 0
        self.free: list[tuple[int, int]] = []  # (room, number) of the open windows, by room
        self.open: dict[int, Window] = {}

    def _new(self) -> Window:
        self.number += 1
        return Window(self.number)

    def add(self, doc_id: int | None, ids: bytes) -> list[Window]:
        out, n = [], len(ids) // ID_BYTES
        piece = Piece(doc_id, 0, n, ids)
        while len(piece) >= self.capacity:
            head, piece = piece.cut(self.capacity)
            (window := self._new()).add(head)
            out.append(window)
        while len(piece):
            at = bisect_left(self.free, (len(piece), 0))
            if at < len(self.free):
                room, number = self.free.pop(at)
                window = self.open.pop(number)
                piece = self._put(window, piece, room, out)
            elif len(self.open) < self.open_windows:
                piece = self._put(self._new(), piece, self.capacity, out)
            else:
                room, number = self.free.pop(0)
                piece = self._put(self.open.pop(number), piece, room, out)
        return out

    def _put(self, window: Window, piece: Piece, room: int, out: list[Window]) -> Piece:
        """Puts what there is room for; returns the rest."""
        head, rest = piece.cut(min(room, len(piece)))
        window.add(head)
        if len(head) == room:
            out.append(window)
        else:
            self.open[window.number] = window
            insort(self.free, (room - len(head), window.number))
        return rest

    def close(self) -> tuple[list[Window], Window | None]:
        """Pours the emptiest windows into the fullest: full windows, and the one that is left over."""
        windows, full = sorted(self.open.values(), key=lambda w: (-w.total, w.number)), []
        self.open, self.free = {}, []
        while len(windows) > 1:
            into, source = windows[0], windows[-1]
            piece = source.pieces.pop()
            source.total -= len(piece)
            head, rest = piece.cut(min(self.capacity - into.total, len(piece)))
            into.add(head)
            if len(rest):
                source.add(rest)
            if into.total == self.capacity:
                full.append(windows.pop(0))
            if windows and windows[-1] is source and not source.total:
                windows.pop()
        return full, windows[0] if windows else None


def merge_leftovers(windows: pd.DataFrame, capacity: int = SEQUENCE_TOKENS) -> pd.DataFrame:
    """First fit by decreasing size of whole leftover windows; a bin takes the id of its first window."""
    bins: list[list] = []  # room, id, rows
    for w in windows.sort_values(["total", "sequence_id"], ascending=[False, True]).itertuples():
        target = next((b for b in bins if b[0] >= w.total), None)
        if target is None:
            bins.append(target := [capacity, w.sequence_id, []])
        base = capacity - target[0]
        target[2] += [(p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"], target[1], p["offset"] + base) for p in w.pieces]
        target[0] -= w.total
    out = pd.DataFrame([r for b in bins for r in b[2]], columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return out.astype({c: "Int64" for c in out.columns})


class Kept(dict):
    """Bytes by text, made when they are first asked for, in two generations of at most ``most_bytes`` each: the older one goes when the younger is full. What alone takes an eighth is not kept."""

    ENTRY_BYTES = 100  # of a dictionary's slot

    def __init__(self, make: Callable[[str], bytes], most_bytes: int):
        super().__init__()
        self._make, self._most, self._used, self._older = make, most_bytes, 0, {}

    def __missing__(self, key: str) -> bytes:
        value = self._older.get(key)
        if value is None:
            value = self._make(key)
        size = getsizeof(key) + getsizeof(value) + self.ENTRY_BYTES
        if 8 * size <= self._most:
            self._used += size
            if self._used > self._most:
                self._older, self._used = dict(self), size
                self.clear()
            self[key] = value
        return value


def chunk_ids(content: str, end: bytes, cache_bytes: int = CACHE_BYTES) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to the little-endian ids of each and the end id; what is kept of chunks and, in a third of the bytes, of their pieces isn't encoded again."""
    from tokenizers import Tokenizer

    bpe, model = SegmentTreeBpe(content), Tokenizer.from_str(content).model
    printable = str.maketrans(dict(enumerate(byte_symbols())))

    def packed(found: list[int]) -> bytes:
        return struct.pack(f"<{len(found)}I", *found)

    def of_piece(piece: str) -> bytes:
        """The library's model on a normalised piece."""
        return packed([t.id for t in model.tokenize(piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(printable))])

    pieces = Kept(of_piece, cache_bytes // 3)

    def of_chunk(chunk: str) -> bytes:
        """The pieces of a chunk; a special token's text by the whole encoder."""
        if chunk.isascii() and chunk.isalpha():  # one piece
            return pieces[chunk.lower()]
        return packed(bpe.encode(chunk)) if "<|" in chunk else b"".join(map(pieces.__getitem__, bpe.pieces(chunk)))

    kept = Kept(of_chunk, cache_bytes - cache_bytes // 3)
    return lambda many: [b"".join(map(kept.__getitem__, chunks(text))) + end for text in many]


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE_TOKENS, open_windows: int = OPEN_WINDOWS, merge_partitions: int = MERGE_PARTITIONS, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    content = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    schema = to_arrow_schema(StructType.fromDDL(WINDOWS))
    end = END_OF_DOCUMENT.to_bytes(ID_BYTES, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = per_worker("pack" + content.value, lambda: chunk_ids(content.value, end, cache_bytes))
        drop_unused()
        partition = TaskContext.get().partitionId()
        packer = Packer(capacity, open_windows)

        def rows(windows: list[Window], leftover: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"sequence_id": (partition << 32) | w.number, "partition": partition, "total": w.total, "leftover": leftover, "pieces": w.rows()} for w in windows], schema=schema)

        for batch in batches:
            out, doc_ids = [], iter(batch.column(0).to_pylist())
            for group in groups_of(texts(batch.column(1)), GROUP_CHARACTERS):
                for doc_id, own in zip(doc_ids, ids(group)):
                    out += packer.add(doc_id, own)
                    if len(out) >= 256:
                        yield rows(out, False)
                        out = []
            if out:
                yield rows(out, False)
        full, left = packer.close()
        if full:
            yield rows(full, False)
        if left:
            yield rows([left], True)

    windows = checkpoint(docs.select("doc_id", "text").mapInArrow(run, WINDOWS))
    full = windows.where("not leftover").select("sequence_id", F.inline("pieces"))
    group = F.floor(F.col("partition") / merge_partitions)
    merged = windows.where("leftover").groupBy(group).applyInPandas(lambda w: merge_leftovers(w, capacity), OUT)
    columns = [c.split()[0] for c in OUT.split(", ")]
    return full.select(columns).union(merged.select(columns))
