"""The pipeline's near copies: SimHash groups first, then all texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Operator 6 compares the fingerprints of five-word shingles in its tiles and gives stars of close ones. What it can't see, as a pair at 0.8
differs by about ten of 64 bits, comes from 32 bands of four minhashes: a pair at 0.8 shares none in 5 of 10^8 cases, a nearer one more
rarely. Every link, of either kind, is verified on the two whole shingle sets, so no unlike pair that fingerprints confuse is joined.

A bucket whose texts are of one component already needs no further pairs, so crowds of near copies are first joined by SimHash and by
a star of each bucket; then all pairs of different components of a bucket are compared, none left out, each in the first band that
it shares: by the minhashes' bytes, of which a pair at 0.8 agrees on fewer than LEAST_EQUAL in 1 of 10^8 cases, and those
that agree on more by their sets. First only minhashes go to the buckets; the rows that have a like one there come again with their sets, so sets are made of
these texts and of no others, and pairs are never listed before they are compared. Texts pass a bitmap of the wanted ones before they are shuffled.

Defined results: of each component the smallest doc_id stays, whole rows of it once; rows that share an id but
hold different texts are texts of their own; texts without words, null ones too, are copies of one another; fewer than five words
are one shingle; rows without an id stay; other columns pass, whatever their names; no rows give no rows. A very long text is hashed whole.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import checkpoint, connected_components, map_arrow, map_groups, texts
from vacancia.llm.simhash import fingerprint, near_edges, shingle_hashes

SHINGLE_WORDS = 5
BANDS, BAND_ROWS = 32, 4
LEAST_EQUAL = 74  # of 128 bytes
BLOCK_ROWS = 16_384
#: Shingles of a part of a bucket that is dealt out.
MOST_HELD = 4_000_000
#: Bits of the filter through which texts go before they are joined with those that are wanted: a megabyte.
FILTER_BITS = 1 << 23

_R = np.random.default_rng(42)
_FACTORS = _R.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_SHIFTS = _R.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(shingle_hashes(text, SHINGLE_WORDS))


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have a Jaccard similarity of 0.8 or more."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    shared = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


def buckets(found: np.ndarray) -> tuple[list[int], bytes]:
    """A hash of each band of minhashes, and a byte of each minhash; none of no shingles."""
    if not len(found):
        return [], b""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 512):  # bounds what the products take
        least = np.minimum(least, (found[at : at + 512, None] * _FACTORS + _SHIFTS).min(0))
    return [xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(least.reshape(BANDS, BAND_ROWS))], (least >> np.uint64(24)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, own, key, n, fp, buckets, minhashes) of each row: a hash of the text, one of its shingle set, the set's size, the SimHash."""

    def make():
        def step(batch: pa.RecordBatch):
            out = []
            for text in texts(batch.column(2)):
                hashes = shingle_hashes(text, SHINGLE_WORDS)
                found = np.unique(hashes)
                out.append((xxhash.xxh64_intdigest(found.tobytes(), 1) - (1 << 63), len(found), fingerprint(hashes), *buckets(found)))
            return [batch.column(0), batch.column(1), *map(list, zip(*out))] if out else None

        return step

    return map_arrow(docs.select("doc_id", F.xxhash64("text").alias("own"), "text"), make, "doc_id long, own long, key long, n int, fp long, buckets array<long>, minhashes binary")


def shingle_sets(wanted: DataFrame, sets: DataFrame, named: DataFrame) -> DataFrame:
    """(key, shingles) of the wanted keys, from one text of each."""
    at = sets.join(wanted, "key", "left_semi").select("key", F.col("first.doc_id").alias("doc_id"), F.col("first.own").alias("own"))
    own = F.xxhash64("doc_id", "own")
    held = maybe_among(named, own, at, own).join(at, ["doc_id", "own"]).dropDuplicates(["doc_id", "own"]).select("key", "text")
    return map_arrow(held, lambda: lambda batch: [batch.column(0), [shingles(t).tobytes() for t in texts(batch.column(1))]], "key long, shingles binary")


def pairs_that(keep: Callable[[np.ndarray, np.ndarray], bool], pairs: DataFrame, of: DataFrame, column: str, dtype: type) -> DataFrame:
    """The (a, b) pairs of keys for whose binary ``column`` of (key, column), as arrays, ``keep`` says so."""
    both = pairs.join(of.select(F.col("key").alias("b"), F.col(column).alias("of_b")), "b").join(of.select(F.col("key").alias("a"), F.col(column).alias("of_a")), "a")

    def make():
        def step(batch: pa.RecordBatch):
            sides = ([np.frombuffer(x.as_buffer(), dtype) for x in batch.column(k)] for k in (2, 3))
            kept = pa.array([keep(one, other) for one, other in zip(*sides)], pa.bool_())
            return [batch.column(0).filter(kept), batch.column(1).filter(kept)]

        return step

    return map_arrow(both.select("a", "b", "of_a", "of_b"), make, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, named: DataFrame) -> DataFrame:
    """The (a, b) pairs of keys that are near copies."""
    likely = checkpoint(pairs_that(lambda a, b: len(a) == len(b) and np.count_nonzero(a == b) >= min(LEAST_EQUAL, len(a)), pairs, sets, "minhashes", np.uint8))
    return pairs_that(near, likely, shingle_sets(likely.select(F.col("a").alias("key")).union(likely.select("b")).distinct(), sets, named), "shingles", np.uint64)


def linked(rows: DataFrame, sets: DataFrame, named: DataFrame) -> DataFrame:
    """(a, b) edges that join the components within each bucket as all near copies of it do, by comparing all pairs."""
    parts = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / MOST_HELD)).cast("int")
    big = rows.groupBy("bucket").agg(parts.alias("parts")).where("parts > 1")
    dealt = rows.join(big, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    # a part meets itself and each other part: (i, i) and (i, j), i < j
    dealt = dealt.select("key", "n", "of", "band", "bucket", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("other")
    groups = ["bucket", "low", "high"]

    def opened(group: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
        """Rows in order of size, their keys, components and minhashes, whether they are of one part; and where each row's others of a size that allows 0.8 end."""
        order = np.argsort(group["n"], kind="stable")
        of = np.unique(group["of"][order], return_inverse=True)[1]
        minhashes = np.frombuffer(b"".join(group["minhashes"][order]), np.uint8).reshape(len(order), -1)
        n = group["n"][order]
        return order, of, minhashes, np.searchsorted(n, n * 5 // 4, "right"), group["low"][0] == group["high"][0]

    def others(i: int, stop: int, of: np.ndarray, minhashes: np.ndarray, part: np.ndarray, within: bool) -> np.ndarray:
        """Later rows of other components, and of the other part, whose minhashes' bytes are like those of row i."""
        j = i + 1 + np.flatnonzero((of[i + 1 : stop] != of[i]) & (within | (part[i + 1 : stop] != part[i])))
        return j[np.count_nonzero(minhashes[j] == minhashes[i], axis=1) >= LEAST_EQUAL]

    def likely(group: dict[str, np.ndarray]) -> tuple[np.ndarray, ...] | None:
        """The rows with a like one in the group that they haven't shared an earlier band with."""
        order, of, minhashes, stops, within = opened(group)
        part, bands, band = group["part"][order], np.stack(group["buckets"][order]), int(group["band"][0])
        found = np.zeros(len(order), bool)
        for i in range(len(order) - 1):
            j = others(i, stops[i], of, minhashes, part, within)
            j = j[~(bands[j, :band] == bands[i, :band]).any(1)]
            found[j] = True
            found[i] |= len(j) > 0
        kept = order[found]
        return tuple(group[c][kept] for c in ("key", "n", "of", "part", *groups)) if len(kept) else None

    def compare(group: dict[str, np.ndarray]) -> tuple[np.ndarray, ...] | None:
        order, of, minhashes, stops, within = opened(group)
        key, part = group["key"][order], group["part"][order]
        found = [np.frombuffer(x, np.uint64) for x in group["shingles"][order]]
        edges = []
        for i in range(len(key) - 1):
            for other in others(i, stops[i], of, minhashes, part, within).tolist():
                if of[other] != of[i] and near(found[i], found[other]):
                    edges.append((key[i], key[other]))
                    of[of == of[other]] = of[i]
        return tuple(np.array(edges, np.int64).T) if edges else None

    sketches = sets.select("key", "minhashes")
    open_ = checkpoint(map_groups(dealt.join(sets.select("key", "minhashes", "buckets"), "key"), groups, likely, "key long, n int, of long, part int, bucket long, low int, high int"))
    whole = shingle_sets(open_.select("key").distinct(), sets, named)
    return map_groups(open_.join(sketches, "key").join(whole, "key"), groups, compare, "a long, b long").distinct()


def simhash_pairs(sets: DataFrame) -> DataFrame:
    """(a, b) pairs of keys, stars of the groups that operator 6 makes of their fingerprints."""
    by_fp = sets.groupBy("fp").agg(F.min("key").alias("least"))
    same = sets.select("key", F.col("fp").alias("of")).join(by_fp, F.col("of") == F.col("fp")).where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    return same.union(near_edges(by_fp).select(F.col("a.least").alias("a"), F.col("b.least").alias("b")).distinct())


def components(sets: DataFrame, named: DataFrame) -> DataFrame:
    """(node, component) of the linked keys among distinct (key, n, fp, buckets, minhashes, first), with the texts of (doc_id, own, text)."""
    rows = sets.select("key", "n", F.posexplode("buckets").alias("band", "bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("count"), F.min(F.struct(F.xxhash64("key").alias("rank"), "key", "n")).alias("first")).where("count > 1")
    rows = checkpoint(rows.join(shared.select("bucket", "first"), "bucket"))
    fits = F.least("n", "first.n") * 5 >= F.greatest("n", "first.n") * 4
    star = rows.where((F.col("key") != F.col("first.key")) & fits).groupBy(F.col("key").alias("b")).agg(F.min("first").alias("first")).select(F.col("first.key").alias("a"), "b")
    edges = checkpoint(verified(simhash_pairs(sets).union(star).distinct(), sets, named))
    found = checkpoint(connected_components(edges))
    of = rows.join(found, rows.key == found.node, "left").select("key", "n", "band", "bucket", F.coalesce("component", "key").alias("of"))
    mixed = of.groupBy("bucket").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high").select("bucket")
    rest = checkpoint(of.join(mixed, "bucket", "left_semi"))
    return connected_components(edges.union(linked(rest, sets, named)))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with all columns; rows without an id stay."""
    named = docs.where("doc_id is not null")
    own = signatures(named)
    sets = checkpoint(own.groupBy("key").agg(F.min(F.struct("doc_id", "own")).alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "buckets", "minhashes")]))
    found = components(sets, named.select("doc_id", F.xxhash64("text").alias("own"), "text"))
    stay = sets.join(found, sets.key == found.node, "left").groupBy(F.coalesce("component", "key").alias("of")).agg(F.min("first").alias("first"))
    stay = stay.select(F.col("first.doc_id").alias("id that stays"), F.col("first.own").alias("text that stays"))
    own_row = (F.col("doc_id") == F.col("id that stays")) & (F.xxhash64("text") == F.col("text that stays"))
    kept = named.join(stay, own_row)
    return kept.dropDuplicates(["id that stays", "text that stays"]).select(*[named[c] for c in docs.columns]).union(docs.where("doc_id is null"))


def brute_force(rows: list[tuple[int, str | None]]) -> list[int]:
    """The ids that keep_one_of_each() keeps, by comparing every pair, for small tables."""
    sets = [shingles(t or "") for _, t in rows]
    component = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if component[i] != component[j] and near(sets[i], sets[j]):
            component = [component[i] if c == component[j] else c for c in component]
    return sorted(min(r[0] for r, d in zip(rows, component) if d == c) for c in set(component))


def maybe_among(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """The rows whose key (a hash) is among the wanted ones, and few others while these are few beside FILTER_BITS: a bitmap of that many bits is all that is broadcast."""
    place = lambda k: F.pmod(k, F.lit(FILTER_BITS)) + 1
    held = wanted.select(place(wanted_key).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("of bits")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    joined = rows.join(F.broadcast(held), F.bitmap_bucket_number(place(key)) == F.col("of bits"))
    return joined.where(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1).drop("of bits", "bits")
