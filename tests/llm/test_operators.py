"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd tables."""

import hashlib
import os
import random
import sys
import zlib
from itertools import pairwise

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import rows
from vacancia.llm import avi, bpe, common, covertree, extract, langid, licenses, nearcopies, packing, queries, quotes, simhash, toxicity
from vacancia.llm.common import connected_components

TOKENIZER = public_tokenizers.path(queries.TOKENIZER)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int, fp string, lang_pred string, component_id int"
LABELS = "doc_id long, quality int, toxic int"
WORDS = {"en": "the and of thing erly shan tion where", "de": "der und nicht einsch über keit ung schau", "fr": "le est des eaux étion oire quelle aux"}


def texts():
    r = random.Random(5)
    out = [None, "", "   ", "a", "!!! ???", "İ ΑΣ ſ ½ 一二 \U0001f600 é", "<|endoftext|>x y", "x" * 20_000, "word " * 6000, "it's a dog's life\x1c\x1d end"]
    for lang in WORDS:
        out += [" ".join(r.choices(WORDS[lang].split(), k=r.randint(5, 200))) for _ in range(12)]
    base = " ".join(r.choices(WORDS["en"].split(), k=400))
    out += [base, base, base + " thing", base.upper()]
    return out


@pytest.fixture(scope="module")
def table():
    return [(i if i != 7 else None, t, "en", "s", 1, 1, "x", "y", 2) for i, t in enumerate(texts())] * 1


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def test_bpe_equals_library(spark, docs, table, empty, library):
    want = []
    for row in table:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((row[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert rows(bpe.encode_documents(docs, TOKENIZER)) == sorted(want, key=repr)
    assert rows(bpe.encode_documents(empty, TOKENIZER)) == []


def test_bpe_on_random_texts(library):
    own, r = bpe.SegmentTreeBpe(open(TOKENIZER).read()), random.Random(1)
    alphabet = ["a", "'", "s", "re", " ", "\x1c", "é", "ſ", "Σ", "½", "<|endoftext|>", "<|", "一", " ", "́", "ᄀ", "ᅡ", "_", "͸"]
    for k in (3, 16, 17, 18, 60, 400):
        for _ in range(200):
            text = "".join(r.choices(alphabet if k < 20 else "abethinr", k=k))
            ids = [i for c in bpe.chunks(text) for i in own.encode(c)]
            assert ids == library.encode(text, add_special_tokens=False).ids
            assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 700])
def test_segment_tree(n):
    r = random.Random(2)
    values = [r.randrange(1000) for _ in range(n)]
    tree = bpe.SegmentTree(list(values), 1000)
    for _ in range(500):
        i, v = r.randrange(n), r.randrange(1000)
        values[i] = v
        tree.put(i, v)
        assert tree.least() == min(values)


def test_every_piece_of_two_symbols_goes_through_a_tree(table):
    own, several = bpe.SegmentTreeBpe(open(TOKENIZER).read()), []
    merge_many = own.merge_many
    own.merge_many = lambda many: several.extend(len(x) > 1 for x in many) or merge_many(many)
    for row in table:
        own.encode_many(bpe.chunks(row[1] or ""))
    assert own.trees == sum(several) > 30


def test_trees_in_rows_equal_single_trees():
    own, r = bpe.SegmentTreeBpe(open(TOKENIZER).read()), random.Random(4)
    pieces = ["".join(r.choices("abethinrsou", k=k)) for k in (2, 3, 4, 5, 8, 9, 16, 17, 32, 33, 34, 70) for _ in range(60)]
    many = [[*map(own._inner.__getitem__, p.encode()[:-1]), own._last[p.encode()[-1]]] for p in pieces]
    assert own.merge_many(many) == [own.merge(list(x)) for x in many]


def test_cache_is_bounded_in_bytes():
    cache = bpe.Cache(20_000)
    for i in range(3000):
        cache.put(str(i), (1, str(i) * 2))
        assert cache.look({str(i), "-"}) == {str(i): (1, str(i) * 2)}
    held = {**cache._older, **cache._young}
    assert sum(bpe.sys.getsizeof(k) + bpe.held_bytes(v) for k, v in held.items()) < 40_000 and len(held) > 20
    cache.put("x" * 9000, 1)
    assert not cache.look({"x" * 9000})


@pytest.mark.parametrize("kind", [lambda s: s.encode(), lambda s: (1, s, s * 2), lambda s: [1000] * len(s)])
def test_many_entries_are_bounded_like_single_ones(kind):
    cache = bpe.Cache(30_000)
    for i in range(0, 3000, 30):
        new = {str(k): kind(str(k)) for k in range(i, i + 30)}
        cache.put_many(new)
        assert cache.look({*new, "-"}) == new
    held = {**cache._older, **cache._young}
    assert sum(bpe.sys.getsizeof(k) + bpe.held_bytes(v) for k, v in held.items()) < 60_000 and len(held) > 60
    cache.put_many({"x" * 9000: kind("x" * 9000), "y": kind("y")})
    assert set(cache.look({"x" * 9000, "y"})) == {"y"}
    cache.put_many({str(k): kind(str(k)) for k in range(10_000, 12_000)})
    assert cache._used <= 30_000


def check_packing(found, table, library, capacity):
    want = {}
    for row in table:
        want.setdefault(row[0], []).append([*library.encode(row[1] or "", add_special_tokens=False).ids, 2])
    sequences, seen = {}, {}
    for p in found:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        seen.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]))
    for places in sequences.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(places)) and sum(n for _, n in places) <= capacity
    assert set(seen) == set(want)
    for key, pieces in seen.items():
        copies = len(want[key])
        ids = np.array(want[key][0], "<u4")
        cover = np.zeros(len(ids), int)
        for start, length, crc, total in pieces:
            assert total == len(ids) and length > 0 and crc == zlib.crc32(ids[start : start + length].tobytes())
            cover[start : start + length] += 1
        assert (cover == copies).all()
    return sequences


def test_packing(docs, table, empty, library):
    found = [r.asDict() for r in packing.pack_documents(docs, TOKENIZER).collect()]
    sequences = check_packing(found, table, library, 4096)
    padding = sum(4096 - sum(n for _, n in places) for places in sequences.values())
    assert padding < 4096
    assert packing.pack_documents(empty, TOKENIZER).collect() == []


def test_packing_of_repeated_rows_in_small_windows(spark, docs, table, library):
    twice = docs.union(docs)
    found = [r.asDict() for r in packing.pack_documents(twice, TOKENIZER, capacity=64, open_windows=4, merge_partitions=2).collect()]
    check_packing(found, table * 2, library, 64)


def test_packer_keeps_few_windows_open():
    packer, r = packing.Packer(100, 5), random.Random(3)
    out = []
    for i in range(500):
        out += packer.add(i, b"\1\0\0\0" * r.randint(1, 90))
        assert len(packer.open) <= 5
    assert all(w.total == 100 for w in out)
    full, left = packer.close()
    assert all(w.total == 100 for w in full) and (left is None or left.total < 100)


def test_avi_round_trip(docs, table, empty):
    stored = avi.store(docs)
    found = {r["doc_id"]: r for r in avi.digest(stored).collect()}
    for row in table:
        payload, n = avi.payload_of(row[1] or "")
        got = found[row[0]]
        assert (got["n_bytes"], got["payload_bytes"], got["payload_sha256"], got["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert rows(avi.digest(avi.store(empty))) == []
    clips = avi.clip_rows(stored).where("doc_id = 8").collect()
    assert clips[0]["first_frame"] == 0 and all(a["first_frame"] + a["frames"] == b["first_frame"] for a, b in pairwise(sorted(clips, key=lambda c: c["clip"])))


@pytest.mark.parametrize("size", [64, 1024, 1088, 300 * 1024])
def test_avi_of_random_bytes(size):
    payload = os.urandom(size)
    assert avi.clips(avi.write_avi(payload))[0] == payload
    extreme = (b"\xff" * 7 + b"\x00" * 9) * (size // 16)
    assert avi.clips(avi.write_avi(extreme))[0] == extreme


def test_avi_of_null_media_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a text", b"x"), (1, "a text", b"x"), (None, None, None), (2, "word " * 200_000, None)], "doc_id long, text string, media binary")
    found = rows(avi.digest(avi.store(docs).union(spark.createDataFrame([(3, 5, None)], "doc_id long, n_bytes long, media binary"))))
    assert found[0] == found[1] and found[2][:3] == (2, 1_000_000, 1_000_000) and found[3] == (3, 5, *[None] * 6) and found[4][:3] == (None, 0, 64)
    assert avi.clip_rows(spark.createDataFrame([(3, None)], "doc_id long, media binary")).collect() == []


def test_avi_shots():
    payload = b"a" * 20 * avi.FRAME + b"\xf0" * 20 * avi.FRAME
    found = avi.clips(avi.write_avi(payload))[1]
    assert [(a, n) for a, n, _, _ in found] == [(0, 20), (20, 20)] and found[1][2] == pytest.approx(20 / avi.FRAMES_A_SECOND)
    with pytest.raises(ValueError):
        avi.read_avi(b"RIFFxxxxWAVE")


def oracle(spark, tmp_path, df, sql):
    path = str(tmp_path / "documents.parquet")
    df.coalesce(1).write.mode("overwrite").parquet(path)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{path}/*.parquet'")
    got = c.sql(sql)
    return got.columns, got.fetchall()


LICENCES = [
    "Licensed under the Apache License, Version 2.0. apache license", "x GNU General Public License, version 3 gnu general  public-license", "cc by cc-by 4.0 CC BY-NC 4.0", "the mit license", "mit licence",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Permission is hereby granted for free of charge to any person obtaining a copy of this software",
    "redistribution and use in source and binary forms with or without changes are permitted", "gnu lesser general public license", "É MIT LICENSE K", "license " * 50, "by cc gnu mit",
]


def test_licences_equal_sql(spark, docs, tmp_path):
    own = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(LICENCES)], "doc_id long, text string").union(docs.select("doc_id", "text"))
    found = licenses.scan(own)
    columns, want = oracle(spark, tmp_path, own, licenses.ORACLE_SQL)
    assert columns == found.columns
    assert rows(found) == sorted(map(tuple, want), key=repr)
    by = {r["doc_id"]: r for r in found.collect()}
    assert by[1000]["n_base"] == 2 and by[1000]["base_labels"] == "apache" and by[1000]["labels"] == "apache,apache-2.0" and by[1000]["score"] == 1.0
    assert by[1001]["n_base"] == 2 and "gpl-3.0" not in by[1001]["labels"] and by[1004]["n_base"] == 0 and by[1003]["labels"] == "mit"
    assert not any("k" in w for t in licenses.TEMPLATES for w in t.words)


def test_licences_of_a_text_full_of_them(spark):
    df = spark.createDataFrame([(1, "GNU General Public License, " * 25_000)], "doc_id long, text string")
    assert rows(licenses.scan(df)) == [(1, 100_000, 25_000, 0, 99_996, "gpl", "gpl", 1.0)]


def test_licences_of_no_rows(empty):
    assert licenses.scan(empty).collect() == []


def test_licences_plan_is_native(docs):
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_simhash_equals_brute_force(docs, table, empty):
    pairs = [(r[0], r[1]) for r in table if r[0] is not None]
    found = [t for t in rows(simhash.near_duplicates(docs)) if t[0] is not None]
    assert found == sorted(simhash.brute_force(pairs), key=repr)
    assert simhash.near_duplicates(empty).collect() == []


def test_simhash_blocks_dealt_in_parts(spark):
    r = np.random.default_rng(0)
    base = r.integers(0, 2**64, 30, dtype=np.uint64)
    values = np.unique(np.concatenate([base, base ^ (np.uint64(1) << r.integers(0, 64, 30).astype(np.uint64)), base ^ np.uint64(0b1111), base ^ np.uint64(0x8000_0100_0020_0004)]))
    df = spark.createDataFrame([(int(v), i) for i, v in enumerate(values.view(np.int64))], "fp long, least long")
    whole = {r["node"]["fp"]: r["component"]["least"] for r in connected_components(simhash.near_edges(df)).collect()}
    near = np.bitwise_count(values[:, None] ^ values[None]) <= 4
    label = np.arange(len(values))
    for _ in range(len(values)):
        label = np.where(near, label[None, :], len(values)).min(1)
    sizes = np.bincount(label)
    assert whole == {int(v): int(k) for v, k in zip(values.view(np.int64), label) if sizes[k] > 1} and whole
    assert {r["node"]["fp"]: r["component"]["least"] for r in connected_components(simhash.near_edges(df, block_rows=3)).collect()} == whole


def test_every_pair_within_the_radius_shares_a_block(spark):
    r = np.random.default_rng(2)
    values = r.integers(0, 2**64, 200, dtype=np.uint64)
    others = values.copy()
    for _ in range(4):
        others ^= np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(values.view(np.int64), others.view(np.int64))], "a long, b long")
    assert df.where(F.arrays_overlap(simhash.block_keys(F.col("a"), 4), simhash.block_keys(F.col("b"), 4))).count() == 200


@pytest.mark.parametrize("batch", [1, 2, 3, 7, 1000])
def test_groups_across_batches(spark, batch):
    from vacancia.llm.common import map_groups

    r = random.Random(batch)
    data = [(k, j, r.randrange(100)) for k in range(12) for j in range(2) for _ in range(r.choice([0, 1, 1, 2, 9]))]
    df = spark.createDataFrame(data, "k long, j int, v long")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = rows(map_groups(df, ["k", "j"], lambda c: None if c["k"][0] == 3 else (c["k"][:1], np.array([len(c["v"])]), np.array([c["v"].sum()])), "k long, n long, total long"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = [(k, len(v), sum(v)) for k in range(12) for j in range(2) for v in [[x for a, b, x in data if (a, b) == (k, j)]] if len(v) > 1 and k != 3]
    assert found == sorted(want, key=repr)


def test_tiles_equal_all_pairs():
    r = np.random.default_rng(1)
    values = np.unique(r.integers(0, 2**64, 50, dtype=np.uint64)[r.integers(0, 50, 400)] ^ (np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64)))
    a, b = simhash.linked_stars(values, tile_rows=16)
    near = np.bitwise_count(values[:, None] ^ values[None]) <= 4
    label = np.arange(len(values))
    for _ in range(len(values)):
        label = np.where(near, label[None, :], len(values)).min(1)
    groups = lambda keys, of: {frozenset(np.asarray(keys)[np.asarray(of) == o].tolist()) for o in set(np.asarray(of).tolist())}
    assert groups(a, b) == {g for g in groups(values, label) if len(g) > 1}


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5)]
    found = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert all(found[i] == 0 for i in range(61)) and all(found[1000 + i] == 1000 for i in range(80))
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("local", [common.LOCAL_EDGES, 30])
def test_components_of_few_edges_take_no_rounds(spark, monkeypatch, local):
    """A long way took a checkpoint and some shuffles a round, each with a file or more for every partition."""
    monkeypatch.setattr(common, "LOCAL_EDGES", local)
    made, stored = [], common.checkpoint
    monkeypatch.setattr(common, "checkpoint", lambda df: made.append(1) or stored(df))
    way = [((i, None if i % 2 else i), (i + 1, None if (i + 1) % 2 else i + 1)) for i in range(100, 180)]
    edges = spark.createDataFrame(way, "a struct<x:long,y:long>, b struct<x:long,y:long>").repartition(5)
    found = {tuple(r["node"]): tuple(r["component"]) for r in connected_components(edges).collect()}
    assert found == {x: (100, 100) for pair in way for x in pair}
    assert len(made) == 2 or local < 100


def vectors():
    r = np.random.default_rng(3)
    out = []
    centers = r.standard_normal((40, 8))
    for i in range(300):
        v = centers[i % 40] + r.standard_normal(8) * 0.05 * (i % 5)
        out.append((i, v.tolist(), i % 3 if i % 40 else 0))
    out += [(400, out[0][1], 0), (401, out[0][1], 0), (401, out[0][1], 0), (402, None, 0), (403, [], 0), (404, [0.0] * 8, 0), (405, [1.0, None], 0), (406, [float("nan")] * 8, 0), (407, [float("inf")] * 8, 0), (408, out[0][1], None)]
    return out


@pytest.mark.parametrize("part", [4096, 40])
def test_vectors_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(covertree, "PART_ROWS", part)
    monkeypatch.setattr(covertree, "LEAF_ROWS", 4)
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int")
    assert rows(covertree.near_vectors(df)) == sorted(covertree.brute_force(vectors()), key=repr)


@pytest.mark.parametrize(("dimensions", "centers", "spread", "settled"), [(64, 40, 0.02, 0.95), (64, 40, 0.3, 0.95), (64, 600, 1.0, 0.85), (3, 600, 1.0, 0.6), (8, 1, 0.1, 0.05)])
def test_bounds_settle_pairs_and_links_are_exact(dimensions, centers, spread, settled):
    r = np.random.default_rng(0)
    v = r.standard_normal((centers, dimensions))[r.integers(0, centers, 600)] + r.standard_normal((600, dimensions)) * spread
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    home = r.random(600) < 0.8
    links = covertree.Links(v, r.integers(1, 4, 600), home, 0.98)
    tree = covertree.cover_tree(v, np.arange(600))
    covertree.dual_traversal(links, tree, tree, float(np.sqrt(0.04)))
    near = (v @ v.T >= 0.98) & (home[:, None] | home[None, :]) & ~np.eye(600, dtype=bool)
    assert (links.counts == near @ links.weights).all()
    assert links.pruned + links.linked_whole + links.multiplied == 600 * 599 // 2
    assert links.pruned + links.linked_whole >= settled * 600 * 599 // 2
    label = np.arange(600)
    for _ in range(30):
        label = np.minimum(label, np.where(near, label[None, :], 600).min(1))
    assert {(a, links.root(a) == links.root(b)) for a, b in zip(range(600), label)} == {(a, True) for a in range(600)}
    assert len({links.root(i) for i in range(600)}) == len(set(label.tolist()))


def test_packing_keeps_what_fits_and_makes_a_piece_once():
    """Pieces that chunks share were encoded for each chunk anew."""
    made = []
    kept = packing.Kept(lambda key: made.append(key) or key.encode(), 30_000)
    assert all(kept[f"k{i}"] == f"k{i}".encode() for i in range(2000)) and len(made) == 2000
    assert sum(map(sys.getsizeof, [*kept, *kept.values()])) + 100 * len(kept) <= 30_000 and len(kept) + len(kept._older) > 100
    assert kept["k1999"] == b"k1999" and kept[next(iter(kept._older))] and len(made) == 2000
    assert kept["x" * 9000] == b"x" * 9000 == kept["x" * 9000] and len(made) == 2002
    content = open(TOKENIZER, encoding="utf-8").read()
    plain = packing.SegmentTreeBpe(content)
    texts_ = ["word word, word. (word) Word! Été, été. <|endoftext|>x", "", "it's 12 12,", *["a" * k + "!" for k in range(60)]]
    for cache_bytes in (80 << 20, 3000):
        assert packing.chunk_ids(content, b"\2\0\0\0", cache_bytes)(texts_) == [np.array([*plain.encode(t), 2], "<u4").tobytes() for t in texts_]


@pytest.mark.parametrize(("dimensions", "centers", "spread"), [(64, 600, 1.0), (8, 40, 0.2), (3, 600, 1.0)])
def test_two_sides_open_a_node_for_all_that_wait_for_it(monkeypatch, dimensions, centers, spread):
    """A flat tree was opened anew for each child of the other side's."""
    r = np.random.default_rng(1)
    v = r.standard_normal((centers, dimensions))[r.integers(0, centers, 1200)] + r.standard_normal((1200, dimensions)) * spread * 0.1
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    right, weights, compared, gaps = r.random(1200) < 0.5, r.integers(1, 4, 1200), [], covertree.gaps
    trees = [covertree.cover_tree(v, np.flatnonzero(side)) for side in (~right, right)]
    links = covertree.Links(v, weights, np.ones(1200, bool), 0.98)
    monkeypatch.setattr(covertree, "gaps", lambda *a: compared.append(1) or gaps(*a))
    covertree.dual_traversal(links, *trees, float(np.sqrt(0.04)))
    near = (v @ v.T >= 0.98) & (right[:, None] != right[None, :])
    assert (links.counts == near @ weights).all()
    assert links.pruned + links.linked_whole + links.multiplied == int(right.sum()) * int((~right).sum())
    assert len(compared) < 100 or dimensions < 64


def test_vectors_of_no_rows(spark):
    assert covertree.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int, v int")).collect() == []


def language_rows(n=400):
    r = random.Random(9)
    return [(i, " ".join(r.choices(WORDS[lang].split(), k=r.randint(3, 60))), lang) for i in range(n) for lang in [r.choice(list(WORDS))]]


def test_languages_of_held_out_documents(spark):
    df = spark.createDataFrame([*language_rows(), (9001, None, "en"), (9002, "", "de"), (9003, "12 !?", "fr"), (None, "the and of", None)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in langid.identify(df).collect()}
    truth = {i: lang for i, _, lang in language_rows()}
    own = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i]["held_out"] for i in own) and np.mean([found[i]["lang_pred"] == truth[i] for i in own]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert [found[i]["lang_pred"] for i in (9001, 9002, 9003)] == ["und"] * 3 and found[None]["lang_pred"] == "en"


def test_languages_without_labels(spark, empty):
    assert langid.identify(empty).collect() == []
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert rows(langid.identify(df))[0][2:] == ("und", 0.0)


def test_ngram_counts_ignore_block_bounds(monkeypatch):
    text = "Über die Straße, und dann! nicht mehr" * 20
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert (langid.counts(text) == whole).all()


def toxic_rows(n=600):
    r = random.Random(11)
    bad = [a + b for a in ("moron", "scum", "veju") for b in ("", "ta", "en")]
    out = []
    for i in range(n):
        words = r.choices((WORDS["en"] + " " + WORDS["fr"]).split(), k=r.randint(5, 150))
        label = int(r.random() < 0.3)
        if label:
            for _ in range(r.randint(1, 3)):
                words[r.randrange(len(words))] = r.choice(bad)
        out.append((i, " ".join(words), label))
    return out


def test_toxicity_of_held_out_documents(spark):
    data = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(9001, None), (9002, "  ")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data] + [(None, 1, 1), (5, 0, None)], LABELS)
    found = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    own = [(found[i]["predicted"], y) for i, _, y in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([p == y for p, y in own]) > 0.95
    assert found[9001]["score"] == found[9002]["score"] == 0 and all(r["predicted"] == (r["score"] >= 0.3) for r in found.values())


def test_toxicity_gradient():
    r = np.random.default_rng(0)
    net = toxicity.Network({})
    projected = r.standard_normal((5, 3, 2, 3 * toxicity.HIDDEN)).astype(np.float32)
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], np.float32)
    d = np.array([1.0, -0.5, 0.25], np.float32)
    _, saved = net.forward(projected, mask, keep=True)
    g, dproj = net.backward(saved, mask, d)
    for name in ("uh", "wa", "va", "wo"):
        at = tuple(r.integers(0, s) for s in net.p[name].shape)
        old = net.p[name][at]
        values = []
        for step in (1e-2, -1e-2):
            net.p[name][at] = old + step
            values.append(float(net.forward(projected, mask) @ d))
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((values[0] - values[1]) / 2e-2, abs=2e-3)
    assert dproj.shape == projected.shape


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(empty, none).collect() == []


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        spans = toxicity.windows_of(n)
        assert sorted({i for a, b in spans for i in range(a, b)}) == list(range(n)) and all(b - a <= toxicity.WINDOW for a, b in spans)


PAGES = [
    ("<html><head><title>t<body><nav><a href=x>menu</a></nav><article><h1>Head &amp; more</h1><p>One   long paragraph<br>of text here.<p>Short.</article><footer>&copy; me</footer>", "Head & more\n\nOne long paragraph of text here.\n\nShort."),
    ('<div class="cookie-notice">We use cookies</div><div id="content"><p>First paragraph of the text, long enough.</p><p>Second one, also quite long indeed.</p></div><div class="sidebar"><ul><li><a href=a>a link</a></ul></div><form><input>Name</form>', "First paragraph of the text, long enough.\n\nSecond one, also quite long indeed."),
    ("<article><p>Text one is here.</p><script>var a='</p>';</script><div class=ad>Buy</div><p>Two.</p><div class='comments'><p>First!</p></div></article>", "Text one is here.\n\nTwo."),
    ("plain text only", "plain text only"), (None, ""), ("", ""), ("<nav>menu</nav>", ""), ("<p>a&nbsp;b\n\t c</p>", "a b c"),
]


def test_extraction(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    assert rows(extract.extract(df)) == [(i, f"u{i}", want, len(want)) for i, (_, want) in enumerate(PAGES)]
    assert extract.extract(df.where("false")).collect() == []


CONVERSATION = [
    (1, 0, "user", "Hello there, this is my question.\nSecond line of it, quite long."), (1, 1, "assistant", "On Monday X wrote:\n> Hello there, this  is my question.\n\nMy long answer to that."),
    (1, 2, "user", "> > Hello there, this is my question.\n> My long answer to that.\nThanks a lot, that helps me."), (1, 3, "user", "Something else without quotes"),
    (1, 4, "assistant", "> second line of it, quite long.\nok"), (1, 4, "assistant", "> second line of it, quite long.\nok"), (1, 5, "user", "> ok\nshort quote"), (2, 0, "user", None), (2, 1, None, "> Hello there, this is my question.\nx"), (None, None, None, "> quoted from nowhere\ny"),
]


def test_quotes(spark):
    df = spark.createDataFrame(CONVERSATION, "conv_id long, turn long, role string, text string")
    found = [(r["conv_id"], r["thread"], r["turn"], r["text"], r["reply_to"], r["n_quotes"], r["levels"]) for r in quotes.conversations(df).collect()]
    assert found == [
        (None, None, None, "y", None, 1, 1), (1, 0, 0, CONVERSATION[0][3], None, 0, 0), (1, 0, 1, "My long answer to that.", 0, 1, 1), (1, 0, 2, "Thanks a lot, that helps me.", 1, 2, 2),
        (1, 0, 4, "ok", 0, 1, 1), (1, 0, 4, "ok", 0, 1, 1), (1, 0, 5, "short quote", 4, 1, 1), (1, 3, 3, CONVERSATION[3][3], None, 0, 0), (2, 0, 0, "", None, 0, 0), (2, 1, 1, "x", None, 1, 1),
    ]
    assert quotes.conversations(df.where("false")).collect() == []


def test_quotes_equal_brute_force(spark):
    r = random.Random(4)
    said = [f"sentence number {k} of the common stock" for k in range(12)]
    data = []
    for conv in range(4):
        for turn in range(12):
            text = r.choice(said)
            if turn and r.random() < 0.6:
                text = "> " + r.choice(said) + "\n" + text
            data.append((conv, turn, "user", text))
    want = {}
    for conv, turn, _, text in data:
        quoted = text.split("\n")[0][2:] if text.startswith(">") else None
        earlier = [t for c, t, _, other in data if c == conv and t < turn and other.split("\n")[-1] == quoted]
        up = min(earlier) if earlier else None
        want[conv, turn] = (up, want[conv, up][1] if up is not None else turn)
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    assert {(x["conv_id"], x["turn"]): (x["reply_to"], x["thread"]) for x in quotes.conversations(df).collect()} == want


def test_nested_quotes_of_several_lines_equal_brute_force(spark):
    """Messages of one to three lines that quote the whole of an earlier one, with the quotes that one holds."""
    r = random.Random(12)
    data, want = [], {}
    for conv in range(6):
        whole, own = [], []
        for turn in range(10):
            up = r.randrange(turn) if turn and r.random() < 0.7 else None
            words = [f"{conv} says {turn} in line {k}" if r.random() < 0.7 else f"l{conv}.{turn}.{k}" for k in range(r.randint(1, 3))]
            quoted = [] if up is None else ["> " + line if not line.startswith(">") else ">" + line for line in whole[up]]
            whole.append([*quoted, *words])
            own.append(words)
            data.append((conv, turn, "user", "\n".join(whole[-1])))
            want[conv, turn] = (up, turn if up is None else want[conv, up][1], "\n".join(words))
    df = spark.createDataFrame([(*x, 1, "c") for x in data], "conv_id long, turn long, role string, text string, hash int, c string")
    found = quotes.conversations(df).collect()
    assert {(x["conv_id"], x["turn"]): (x["reply_to"], x["thread"], x["text"]) for x in found} == want
    assert [(x["conv_id"], x["thread"], x["turn"]) for x in found] == sorted((c, t, n) for (c, n), (_, t, _) in want.items())


def test_stages_keep_columns(spark):
    import corpus_pipeline

    r = random.Random(6)
    data = [(i, t, lang, "s", len(t), 5, "f", "p", 3) for i, t, lang in language_rows(300)]
    long = [" ".join(r.choices(WORDS["en"].split(), k=300)) for _ in range(10)]
    data += [(5000 + i, t, "en", "s", 1, 5, "f", "p", 3) for i, t in enumerate([*long, *long, None, "", "42"])]
    docs = spark.createDataFrame(data, DOCS)
    kept = langid.keep_identified(docs)
    assert kept.schema == docs.schema and kept.where("doc_id >= 5020").count() == 0 and kept.count() >= 310
    one = nearcopies.keep_one_of_each(docs.where("doc_id between 5000 and 5019").union(docs.where("doc_id = 5003")))
    assert one.schema == docs.schema and sorted(x["doc_id"] for x in one.collect()) == list(range(5000, 5010))
    labels = spark.createDataFrame([], LABELS)
    assert toxicity.keep_clean(docs, labels).count() == docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near copies", "packing"]


def test_pipeline_equals_brute_force(spark, tmp_path, library):
    import corpus_pipeline

    r = random.Random(13)
    data = [(i, t, lang, "s", len(t)) for i, t, lang in language_rows(120)]
    base = [r.choices(WORDS["en"].split(), k=250) for _ in range(6)]
    data += [(1000 + 10 * k + c, " ".join(w if r.random() > 0.004 * c else "erly" for w in words), "en", "s", 1) for k, words in enumerate(base) for c in range(5)]
    data += [(2000, None, "en", "s", 0), (2001, "42 !?", None, None, 5), (2002, data[3][1], "en", "s", 1), (None, "the and of thing erly", "en", "s", 1)] + [data[125]]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    found = [x.asDict() for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    model = langid.fit(docs)
    known = [(i, t) for i, t, *_ in data if t and model.predict(t)[0] != "und" and model.predict(t)[1] >= langid.MIN_SCORE]
    kept = set(nearcopies.brute_force([x for x in known if x[0] is not None]))
    assert len(kept) < len({i for i, _ in known}) and {2000, 2001}.isdisjoint(kept)
    table = [(i, t) for i, t in dict.fromkeys(known) if i is None or i in kept]
    check_packing(found, table, library, 4096)


def test_sample_is_bounded(spark):
    from vacancia.llm.common import bounded_sample

    df = spark.range(5000).select(F.col("id").alias("row"), F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("g"))
    df = df.union(df.where("row = 77").crossJoin(spark.range(3000)).select("row", "g"))
    found = bounded_sample(df, "g", F.lit(60))
    assert {r["g"]: r["count"] for r in found.groupBy("g").count().collect()} == {"a": 60, "b": 60} and found.distinct().count() == 120


def test_words_of_texts_without_spaces():
    assert toxicity.words("Its_dog's end.of,LINE") == ["its", "dog", "s", "end", "of", "line"]
    assert toxicity.words("x" * 20) == ["x" * 20] and toxicity.words("-- ! \u3002") == []
    text = "\u6211\u4eec\u660e\u5929\u53bb" * 2000
    found = toxicity.words(text)
    assert all(len(w) <= toxicity.PIECE for w in found) and len(found) > 2000 and found[-1].endswith(text[-1])


def test_toxic_passages_in_texts_without_spaces(spark):
    data = toxic_rows()
    clean = [t.replace(" ", "_") for _, t, y in data if not y and len(t) > 300][:20]
    bad = [t[:150] + "_scumta,moronen." + t[150:] for t in clean]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(5000 + i, t) for i, t in enumerate([*clean, *bad, "thing and of " * 30_000 + "scumta moronen" + " where shan" * 500])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data], LABELS)
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs.union(docs.where("doc_id = 5000")), labels).collect()}
    assert np.mean([found[5000 + i] for i in range(20)]) <= 0.1 and np.mean([found[5020 + i] for i in range(20)]) >= 0.9 and found[5040] == 1


def test_document_frequencies_cover_all_rows(spark):
    df = spark.createDataFrame([(t,) for _, t, _ in language_rows(60)] + [("the the",)], "text string").repartition(5)
    seen, n = langid.document_frequencies(df)
    assert n == 61 and (seen == sum((langid.counts(r["text"]) > 0).astype(int) for r in df.collect())).all()


def test_all_languages_are_learned(spark):
    many = [(k * 10 + j, f"{chr(0x4E00 + k)}{chr(0x4E00 + k)} " * 9, f"l{k}") for k in range(230) for j in range(10)]
    df = spark.createDataFrame(many * 2, "doc_id long, text string, lang string")
    found = langid.identify(df).where("held_out").collect()
    truth = {i: lang for i, _, lang in many}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in found]) > 0.9


def test_near_copies_at_five_words_equal_brute_force(spark):
    r = random.Random(8)
    data = []
    for k in range(12):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randint(60, 200))]
        data.append((len(data), " ".join(base)))
        for _ in range(r.randint(1, 8)):
            other = list(base)
            for _ in range(r.randint(1, 5)):  # a changed word alters five shingles
                other[r.randrange(len(other))] = "changed"
            data.append((len(data), " ".join(other)))
    data += [(900, None), (901, " "), (902, "two words"), (903, "two  WORDS"), (904, "x" * 5000)]
    df = spark.createDataFrame([(*x, "en") for x in data], "doc_id long, text string, lang string").repartition(3)
    want = nearcopies.brute_force(data)
    assert sorted(x["doc_id"] for x in nearcopies.keep_one_of_each(df).collect()) == want
    # the query's rule leaves near copies of 0.8 and more
    assert len({x["component_id"] for x in simhash.near_duplicates(df).collect()}) > len(want)
    assert nearcopies.keep_one_of_each(df.where("false")).collect() == []


def test_rows_of_one_id_with_different_texts_stay(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (1, "q r s t u v w x"), (1, "a b c d e f g h"), (None, "a b c d e f g h")], "doc_id long, text string")
    assert rows(nearcopies.keep_one_of_each(df)) == sorted([(1, "a b c d e f g h"), (1, "q r s t u v w x"), (None, "a b c d e f g h")], key=repr)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div class='layout has-sidebar'><p>A long paragraph of the text here.</p></div>", "A long paragraph of the text here."),
        ("<div id='page-with-header'><article><p>A long paragraph of the text here.</p></article></div>", "A long paragraph of the text here."),
        ("<article><div class='post-header'><h1>The head of it</h1></div><p>A long paragraph of the text here.</p><div class='related-work'><p>Others did it before us.</p></div></article>", "The head of it\n\nA long paragraph of the text here.\n\nOthers did it before us."),
        ("<div class=widget><main><p>A long paragraph of the text here.</p></main></div>", "A long paragraph of the text here."),
        ("<div class=banner><p>A long paragraph of the text here.</p></div>", "A long paragraph of the text here."),
        ("<article><p>A long paragraph of the text here.</p></article><div id=comments><article><p>I say so too.</p></article></div>", "A long paragraph of the text here."),
    ],
)
def test_layout_classes_are_no_furniture(html, want):
    assert extract.main_text(html) == want


LONG = "A paragraph of the article that goes on for long enough to be one. " * 3


@pytest.mark.parametrize(
    "html",
    [
        "<div class='content'><p>{}</p></div><section class='comments'><article><p>{c}</p></article><article><p>{c}</p></article></section>",
        "<article><p>{}</p></article><section class='comments'><p>{c}</p><p>{c}</p><p>{c}</p></section>",
        "<article><p>{}</p><div class='comment-thread'><p>{c}</p></div></article>",
        "<article><p>{}</p><article class='comment'><p>{c}</p></article></article>",
        "<article class='post comments-open'><p>{}</p></article><ol class=commentlist><li class='comment odd'><p>{c}</p></ol>",
        "<article><p>{}</p><ul><li class=comment><p>{c}</p><li class=comment>{c}</ul></article>",
        "<article><p>{}<span class='ad'>{c}</span></p><p class=advert>{c}</p><div id='newsletter-form'>{c}</div></article>",
        "<main class=comments><p>{}</p></main><div class='modal overlay'><article>{c}</article></div>",
        "<body class='has-comments'><div><p class=ad>{c}<p>{}</div>",
        "<div id=post-comments-section><article>{c}</article></div><div><h2></h2><p>{}</p></div>",
    ],
)
def test_comments_and_inserts_go_at_any_size_and_on_any_element(html):
    assert extract.main_text(html.format(LONG, c="What a reader said about it at some length, too. " * 20)) == LONG.strip()


def test_text_beside_articles_stays():
    assert extract.main_text(f"<article><p>{LONG}</p></article><div><p>Beside. {LONG}</p></div>") == f"{LONG}\n\nBeside. {LONG}".replace(" \n", "\n").strip()


def test_pages_made_of_known_parts():
    """Pages are put together from parts; what should come out is known from how."""
    r = random.Random(8)
    for _ in range(300):
        words = lambda n: " ".join(r.choices("alpha beta gamma delta rho tau".split(), k=n))
        furniture = [
            lambda: f"<nav><ul><li><a href=x>{words(3)}</a></ul></nav>", lambda: f"<div class='{r.choice(['ad', 'ad-slot', 'cookie-notice', 'comments', 'comment-list', 'promo', 'login-form'])}'><p>{words(60)}</p><p>{words(9)}</p></div>",
            lambda: f"<form><p>{words(20)}</p><input></form>", lambda: f"<script>{words(9)}<p></script>", lambda: f"<aside><p>{words(40)}</p></aside>", lambda: f"<p class=ad>{words(30)}</p>", lambda: f"<section id=comments><article><p>{words(50)}</p></article></section>", lambda: f"<div role=alert>{words(8)}</div>",
        ]
        want, body = [], []
        for _ in range(r.randint(1, 8)):
            text = words(r.randint(25, 90))
            want.append(text)
            body.append(f"<p>{text.replace(' ', r.choice([' ', '  ', chr(10)]))}</p>")
            if r.random() < 0.4:
                body.append(r.choice(furniture)())
        outer = r.choice(["article", "main", "div class=content", "div"])
        page = f"<html><body>{r.choice(furniture)()}<{outer}>{''.join(body)}</{outer.split()[0]}>{r.choice(furniture)()}<footer><p>{words(30)}</p></footer>"
        assert extract.main_text(page) == "\n\n".join(want)


def test_long_and_repeated_pages(spark):
    text = [f"Paragraph {i} of a very long page, with words enough in it." for i in range(80_000)]
    page = "<article>" + "".join(f"<p>{x}" for x in text) + "</article>"
    assert len(page) > 5_000_000
    df = spark.createDataFrame([(1, "u", page), (2, "v", "<p>short page of one line"), (1, "u", page), (None, None, None)], "page_id long, url string, html string")
    found = extract.extract(df).collect()
    assert [(r["page_id"], r["n_chars"]) for r in found] == [(1, len("\n\n".join(text))), (2, 22), (1, len("\n\n".join(text))), (None, 0)]
    assert found[0]["text"] == found[2]["text"] == "\n\n".join(text)


def test_short_messages_are_linked(spark):
    chinese = "我们明天一起去看电影"
    data = [
        (1, 0, "user", "Do you want the longer answer?"), (1, 1, "user", "> Do you want the longer answer?\n\nYes, please"), (1, 2, "user", "> > Do you want the longer answer?\n>\n> Yes, please\n\nHere it is."),
        (2, 0, "user", "No"), (2, 1, "user", "> no\nWhy?"), (3, 0, "user", chinese), (3, 1, "user", f"> {chinese}\n\u597d"), (4, 0, "user", "Fine.\n\nAnother paragraph, quite long."), (4, 1, "user", "> Fine.\nThanks"),
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    found = {(x["conv_id"], x["turn"]): x["reply_to"] for x in quotes.conversations(df).collect()}
    assert found == {(1, 0): None, (1, 1): 0, (1, 2): 1, (2, 0): None, (2, 1): 0, (3, 0): None, (3, 1): 0, (4, 0): None, (4, 1): 0}


def test_the_filter_of_wanted_keys_loses_none(spark, monkeypatch):
    rows_ = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    wanted = rows_.where("id % 50 = 3")
    for bits, most in ((1 << 23, 450), (1 << 10, 20_000)):
        monkeypatch.setattr(nearcopies, "FILTER_BITS", bits)
        found = {r["id"] for r in nearcopies.maybe_among(rows_, F.col("h"), wanted, F.col("h")).collect()}
        assert {r["id"] for r in wanted.collect()} <= found and len(found) <= most
    assert nearcopies.maybe_among(rows_, F.col("h"), wanted.where("false"), F.col("h")).count() == 0


@pytest.mark.parametrize("block", [16_384, 40])
def test_near_copies_of_crowds_equal_brute_force(spark, monkeypatch, block):
    """Families of texts around the threshold, so that buckets hold several components and are dealt in parts."""
    monkeypatch.setattr(nearcopies, "BLOCK_ROWS", block)
    r = random.Random(12)
    data = []
    for family in range(4):
        base = [f"w{r.randrange(3000)}" for _ in range(150)]
        for _ in range(45):
            words = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
                words[r.randrange(150)] = f"x{r.randrange(9999)}"
            data.append((len(data), " ".join(words)))
    r.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert sorted(x["doc_id"] for x in nearcopies.keep_one_of_each(df).collect()) == nearcopies.brute_force(data)


def test_a_worker_keeps_what_its_operator_uses_alone():
    from vacancia.llm import common

    common.drop_unused()
    first = common.per_worker("a", lambda: ["a"])
    common.drop_unused()
    assert common.per_worker("a", list) is first
    common.drop_unused()
    common.per_worker("b", list)
    common.drop_unused()
    assert common.per_worker("a", list) is not first
    assert bpe.held_bytes(list(range(1000, 2000))) > 1000 * 36


def test_bpe_tells_what_its_ids_say_and_pieces_share_it():
    own = bpe.SegmentTreeBpe(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    many = ["Word", "word", "word,", "l'été", "don't", "a1b2", "<|endoftext|>", "x<|endoftext|>y", "Straße!", "日本語", "word"]
    told = own.tell_many(many)
    assert told == [(" ".join(map(str, ids)), own.decode(ids)) for ids in own.encode_many(many)]
    assert own.tell_many(["WORD"])[0] is own.tell_many(["word"])[0]
