"""Operator 6: SimHash near-duplicates by tiled exact comparison of fingerprints.

Fingerprints: 64-bit majority of the XXH64 values (seed 42) of the 4-word shingles of a text.
Distinct fingerprints alone are compared, so a group of copies of any size is one entry. Of r + 2 bands of
the 64 bits, two fingerprints within the radius r agree wholly on at least two, so the values of each two bands
(15 keys of about 21 bits at r = 4) are blocks, and only fingerprints of a block are compared: all of them, as tiles of
numpy arrays under exclusive-or and bit counts, sorted by population count, a pair of tiles being
skipped when their population counts differ by more than r. Blocks of one row go before they are dealt out, and a task takes
its blocks in one pass. A block over BLOCK_ROWS is dealt out by pairs of its parts, so no task holds more than two parts at once.

A block emits a star for each set of linked fingerprints, never all pairs; components follow from
alternating star contraction on Spark. Nodes are (smallest doc_id, fingerprint), so the smallest node names its component.

Defined results: null, empty and blank texts have fingerprint zero and link like any other;
repeated rows give repeated results; rows with a null doc_id get a component but are never its
name; other columns are ignored; no rows give no rows. A very long text is hashed whole, its bits are counted a part at a time.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import checkpoint, connected_components, map_arrow, map_groups, texts

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
TILE_ROWS = 2048
BLOCK_ROWS = 65_536
NAMELESS = (1 << 63) - 1  # stands for the doc_id of fingerprints that have none


def shingle_hashes(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of the space-joined shingles of a text, repeats included; of all words together where there are fewer."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone splits
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(found) - words + 1, 1)
    stops = ends[min(words, len(found)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), stops.tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):  # bounds what the unpacked bits take
        part = np.unpackbits(hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp long) of each row."""

    def make():
        return lambda batch: [batch.column(0), pa.array([fingerprint(shingle_hashes(t, words)) for t in texts(batch.column(1))], pa.int64())]

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, fp long")


def bands(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 2 bands that cover 64 bits."""
    cuts = [round(64 * k / (radius + 2)) for k in range(radius + 3)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def block_keys(fp: Column, radius: int) -> Column:
    """An array of the keys of the blocks of a fingerprint: the number of two bands, and their values."""
    keys = []
    for number, ((a, n), (b, m)) in enumerate(combinations(bands(radius), 2)):
        low, high = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << n) - 1)), F.shiftrightunsigned(fp, b).bitwiseAND(F.lit((1 << m) - 1))
        keys.append(F.lit(number << 48) + F.shiftleft(high, n) + low)
    return F.array(*keys)


def linked_stars(values: np.ndarray, part: np.ndarray | None = None, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(value, least value linked to it through others here) of the distinct unsigned values with a link.

    With ``part`` (0 or 1 for each value), only values of different parts are compared.
    """
    population = np.bitwise_count(values)
    order = np.lexsort((values, population))
    values, population = values[order], population[order].astype(np.int64)
    part = None if part is None else part[order]
    parent = np.arange(len(values))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tiles = range(0, len(values), tile_rows)
    for a in tiles:
        left, high = values[a : a + tile_rows], population[min(a + tile_rows, len(values)) - 1]
        for b in range(a, len(values), tile_rows):
            if population[b] - high > radius:
                break  # tiles are in order of population count: so do all later ones
            right = values[b : b + tile_rows]
            for i0 in range(0, len(left), 256):
                near = np.bitwise_count(left[i0 : i0 + 256, None] ^ right[None, :]) <= radius
                if part is not None:
                    near &= part[a + i0 : a + i0 + 256, None][: near.shape[0]] != part[None, b : b + len(right)]
                for i in np.flatnonzero(near.sum(1) > (a == b and part is None)):
                    own = root(a + i0 + i)
                    partners = b + np.flatnonzero(near[i])
                    for j in np.unique(parent[partners]).tolist():
                        if (other := root(j)) != own:
                            low, up = min(own, other), max(own, other)
                            parent[up] = own = low
                    parent[partners] = own
    roots = np.array([root(i) for i in range(len(values))], np.int64)
    sizes = np.bincount(roots, minlength=len(values))
    linked = sizes[roots] > 1
    return values[linked], values[roots[linked]]


def near_edges(fps: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b) edges between rows of distinct (fp long, least long), as structs of both, that span the same components as all links within the radius."""
    banded = fps.select("fp", "least", F.explode(block_keys(F.col("fp"), radius)).alias("block"))
    parts = F.ceil(F.col("count") / block_rows).cast("int")
    several = banded.groupBy("block").count().where("count > 1").select(F.col("block").alias("of"), parts.alias("parts"))
    dealt = banded.join(several, F.col("block") == F.col("of")).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # a part meets itself and each other part: (i, i) and (i, j), i < j
    dealt = dealt.select("fp", "least", "block", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("fp", "least", "block", "part", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"))

    def compare(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...] | None:
        values = rows["fp"].view(np.uint64)
        second = int(rows["second"][0])
        a, b = linked_stars(values, None if int(rows["first"][0]) == second else rows["part"] == second, radius)
        apart = a != b
        if not apart.any():
            return None
        a, b = a[apart], b[apart]
        order = np.argsort(values)
        least = lambda found: rows["least"][order[np.searchsorted(values, found, sorter=order)]]
        return a.view(np.int64), least(a), b.view(np.int64), least(b)

    found = map_groups(dealt, ["block", "first", "second"], compare, "fp long, least long, to_fp long, to_least long")
    return found.select(F.struct("least", "fp").alias("a"), F.struct(F.col("to_least").alias("least"), F.col("to_fp").alias("fp")).alias("b"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row."""
    own = checkpoint(fingerprints(docs, words))
    by_fp = own.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NAMELESS)).alias("least"))
    found = connected_components(near_edges(by_fp, radius)).select(F.col("node.fp").alias("node"), F.col("component.least").alias("component"))
    by_fp = by_fp.join(found, by_fp.fp == found.node, "left").select(F.col("fp").alias("of"), F.nullif(F.coalesce("component", "least"), F.lit(NAMELESS)).alias("component_id"))
    joined = own.join(by_fp, own.fp == by_fp.of)
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple[int, str | None]], radius: int = RADIUS) -> list[tuple[int, str, int]]:
    """near_duplicates() by comparing every pair, for small tables."""
    fps = [fingerprint(shingle_hashes(t or "")) & (1 << 64) - 1 for _, t in rows]
    component = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius and component[i] != component[j]:
            old, new = component[i], component[j]
            component = [new if c == old else c for c in component]
    names = {c: min(r[0] for r, d in zip(rows, component) if d == c) for c in set(component)}
    return [(r[0], f"{f:016x}", names[c]) for r, f, c in zip(rows, fps, component)]
