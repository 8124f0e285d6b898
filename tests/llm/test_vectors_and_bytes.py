"""Byte-level BPE against the library, ball k-means and whitening against brute force, and all on odd tables."""

import base64
import hashlib
import random
import struct

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.conftest import rows
from vacancia.llm import ballkmeans, bytebpe, queries, whitening

RANKS = public_tokenizers.path(queries.RANKS)
DOCS = "doc_id long, text string, ids string, decoded string, n_tokens int"
VECTORS = "vec_id long, embedding array<float>, label int, cluster string, x int, n int, deviation string"


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def matrix():
    return bytebpe.MatrixBpe(open(RANKS, "rb").read(), public_tokenizers.PATTERN, bytebpe.library_exceptions())


def ids_of(matrix, text):
    return [i for s in bytebpe.segments(text) for x in matrix.encode_pieces(matrix.pieces(s)) for i in struct.unpack(f"<{len(x) // 4}I", x)]


def test_documents_equal_library(spark, library):
    texts = [None, "", " ", "a", "it's a dog's life\x1c\x1d  \n\n end", "<|endoftext|> x", "x" * 30_000, "ab" * 3000, "word " * 5000, "İ ΑΣ ſ ½ 一二 \U0001f600 é \x88f \U000323b0", "\n" * 5000 + "x", "word "] * 2
    data = [(None if i == 5 else i, t, "x", "y", 1) for i, t in enumerate(texts)]
    want = []
    for i, t, *_ in data:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    encode = lambda df: bytebpe.digests(bytebpe.encode(df, RANKS, public_tokenizers.PATTERN))
    found = encode(spark.createDataFrame(data, DOCS).repartition(3))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows(found) == sorted(want, key=repr)
    assert not rows(encode(spark.createDataFrame([], DOCS)))


def test_random_texts_equal_library(matrix, library):
    r = random.Random(3)
    new = bytebpe.library_exceptions()[:40]
    for _ in range(1500):
        some = r.choice(["abcdefghij  \n\t' ABC 012 .,!?-_ éüßσΣ一二\U0001f600́\x1c\x85\xa0" + new, "ab ", "a", "the and ing ", "'stre ll", "  \n x"])
        text = "".join(r.choices(some, k=r.choice([1, 3, 10, 50, 300])))
        assert ids_of(matrix, text) == library.encode_ordinary(text)


def test_every_character_is_classed_as_the_library_does(matrix, library):
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    for at in range(0, len(every), 1 << 16):
        text = "a".join(every[at : at + (1 << 16)])
        assert ids_of(matrix, text) == library.encode_ordinary(text)


@pytest.mark.parametrize("tokens", [[b"ab", b"bc", b"abc", b"aa", b"aaa", b"cab"], [b"bca", b"bc", b"ab", b"abab", b"aab"]])
def test_merges_that_come_before_others_of_their_round(tokens):
    """A merge may make a pair of a lower rank, which then goes first: one merge at a time gives the same."""
    own = {bytes([b]): b + 10 for b in range(256)} | {t: k for k, t in enumerate(tokens)}
    content = b"\n".join(base64.b64encode(t) + b" " + str(k).encode() for t, k in own.items())
    m = bytebpe.MatrixBpe(content, r".+")
    r = random.Random(4)
    for _ in range(500):
        piece = "".join(r.choices("abc", k=r.randint(1, 30)))
        parts = [bytes([b]) for b in piece.encode()]
        while piece.encode() not in own:
            found = [(own[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in own]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want = [own[piece.encode()]] if piece.encode() in own else [own[p] for p in parts]
        assert ids_of(m, piece) == want


def test_long_texts_are_cut_between_pieces(matrix, library, monkeypatch):
    monkeypatch.setattr(bytebpe, "SEGMENT_CHARACTERS", 7)
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choices("ab  \n'st1.é", k=200))
        assert "".join(bytebpe.segments(text)) == text and ids_of(matrix, text) == library.encode_ordinary(text)


def embeddings(count=400, d=64):
    r = np.random.default_rng(2)
    centers = r.normal(size=(12, d))
    x = (centers[r.integers(0, 12, count)] + r.normal(size=(count, d)) * r.choice([0.05, 0.6], (count, 1))).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [data[3], (3, data[9][1]), (None, data[5][1]), (9001, None), (9002, [1.0]), (9003, [float("nan"), *[0.0] * (d - 1)]), (9004, [None, *[0.0] * (d - 1)]), (9005, [float("inf")] * d), (9006, [])]
    data += [(9100 + i, [0.5] * d) for i in range(30)]
    return [(i, v, 1, "c", 2, 3, "d") for i, v in data]


def kept(data, d=64):
    return [(i, v) for i, v, *_ in data if v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]


def test_clusters_equal_brute_force(spark):
    data = embeddings()
    own = kept(data)
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v in own], np.int64)
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x[k].tolist()) for k, (i, _) in enumerate(own) if i is not None)[:40]
    centroids = np.array([v for _, v in order], np.int64)
    nearest = lambda: ((x[:, None] - centroids[None]) ** 2).sum(2)
    for _ in range(5):
        labels = nearest().argmin(1)
        centroids = np.array([[s // (labels == k).sum() for s in x[labels == k].sum(0).tolist()] if (labels == k).any() else centroids[k] for k in range(len(centroids))], np.int64)
    gaps = nearest()
    labels, distance = gaps.argmin(1), gaps.min(1)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    want = [(own[k][0], int(labels[k]), int(distance[k]), int(distance[labels == labels[k]].sum()), int(distance.sum()), digest[labels[k]]) for k in range(len(own))]
    vectors = ballkmeans.integer_vectors(spark.createDataFrame(data, VECTORS).repartition(5))
    found = ballkmeans.digests(*ballkmeans.cluster(vectors, ballkmeans.starts(vectors)))
    assert rows(found) == sorted(want, key=repr)
    carried = ballkmeans.digests(*ballkmeans.cluster(vectors, ballkmeans.starts(vectors), carry=2))
    assert rows(carried) == rows(found)


@pytest.mark.parametrize("size", [20, 1 << 27])
def test_balls_settle_members_and_keep_ties(size):
    r = np.random.default_rng(1)
    x = r.integers(-size, size + 1, (500, 64 if size > 20 else 2))
    centroids = np.concatenate([x[:20], x[:5]])
    gaps = ((x[:, None] - centroids[None]).astype(object) ** 2).sum(2)
    balls = ballkmeans.Balls(centroids)
    labels, distance = balls.move(x, r.integers(0, 25, 500))
    want = np.array([min(range(25), key=lambda k: (row[k], k)) for row in gaps])
    assert (labels == want).all() and distance.tolist() == [gaps[i, k] for i, k in enumerate(want)]
    before = balls.compared
    balls.move(x, labels)
    assert balls.compared - before < (500 * 24 if size > 20 else 500 * 12)


def test_clusters_of_few_and_no_vectors(spark):
    run = lambda data: (lambda v: rows(ballkmeans.digests(*ballkmeans.cluster(v, ballkmeans.starts(v)))))(ballkmeans.integer_vectors(spark.createDataFrame(data, VECTORS)))
    assert run([]) == []
    assert [r[:5] for r in run([(1, [0.0] * 64, 1, "c", 2, 3, "d")] * 2)] == [(1, 0, 0, 0, 0)] * 2


def test_clusters_equal_sql(spark, tmp_path):
    spark.createDataFrame(embeddings(150), VECTORS).repartition(2).write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    found = queries.op12_ballkmeans(spark, str(tmp_path))
    want = c.sql(queries.ORACLES["op12_ballkmeans"])
    assert found.columns == want.columns and rows(found) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("factor", [1.0, 1e4, 1e14])
def test_whitening_equals_brute_force(spark, factor):
    data = [(i, v and [c if c is None else c * factor for c in v], *rest) for i, v, *rest in embeddings()]
    own = kept(data)
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in own], object)
    n, s = len(x), x.sum(0)
    gap = n * x - s
    covariance = np.array((gap.T @ gap).tolist(), object) / (n * n * n)
    covariance = covariance.astype(float)
    values = np.linalg.eigvalsh(covariance)[::-1]
    found = whitening.whitened_rows(spark.createDataFrame(data, VECTORS).repartition(4)).collect()
    assert len(found) == 32 * n and {r["n"] for r in found} == {n}
    exact = sorted(((own[k][0], int((gap[k] ** 2).sum())) for k in range(n)), key=repr)
    assert sorted(((r["vec_id"], r["deviation"]) for r in found if r["component"] == 1), key=repr) == [(i, v if v < 1 << 63 else None) for i, v in exact]
    for r in found:
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-4 * r["explained"] and r["identity_error"] < 1e-4
    by_id = {}
    for r in found:
        if r["vec_id"] not in (3, None):
            by_id.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    ids = [i for i, _ in own if i not in (3, None)]
    white = np.array([[by_id[i][c + 1] for c in range(32)] for i in ids])
    centred = (gap.astype(float) / n)[[k for k, (i, _) in enumerate(own) if i not in (3, None)]]
    vectors = np.linalg.eigh(covariance)[1][:, ::-1][:, :32] / np.sqrt(values[:32])
    assert np.abs(np.abs(centred @ vectors) - np.abs(white)).max() < 1e-6


def test_scatter_is_exact(spark):
    r = random.Random(3)
    for size in (3, 1 << 20, 1 << 40, 1 << 61):
        x = [[r.randint(-size, size) for _ in range(5)] for _ in range(300)]
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, x array<long>").repartition(3)
        n, sums, cross = whitening.scatter(df, 7)
        y = np.array([[c - 7 for c in v] for v in x], object)
        assert n == 300 and sums == y.sum(0).tolist() and cross == (y.T @ y).tolist()


def test_whitening_of_few_vectors(spark):
    run = lambda vectors: rows(whitening.whitened_rows(spark.createDataFrame([(i, v, 1, "c", 2, 3, "d") for i, v in enumerate(vectors)], VECTORS)))
    assert run([]) == run([None]) == run([[1.0, 2.0]]) == run([[1.0, 2.0]] * 3) == []
    found = run([[0.0, 1.0], [1.0, 0.0], [5.0] * 3])  # one component, vectors of another length left out
    assert [(r[0], r[1], r[2], abs(round(r[4], 9)), r[5]) for r in found] == [(0, 1, 2, 1.0, 1.0), (1, 1, 2, 1.0, 1.0)]
