"""Operator 5: toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own embedding and the mean of the embeddings of its hashed letter n-grams.
Both go through the input projection once for each distinct word, so what a task keeps for a word
is its projected row. The network reads windows of WINDOW words that overlap by a quarter, all of
a text's windows; attention pools the states of a window, and a text's score is its highest
window's. Training is by multiple instances: of a document's windows the highest scored one
carries the label (in the first epochs all carry it), which is how documents are scored.

Words are runs without white space or punctuation. One of over LONGEST characters (long tokens, scripts without spaces) counts as
overlapping pieces of PIECE characters, so that a passage within it has windows of its own.

Trained on all windows of at most SAMPLE_PER_LABEL toxic and NEGATIVES times as many other labelled documents, those of the least hash, whose
crc32(doc_id as text) mod 4 is not 2, of up to SAMPLE_CHARACTERS each and TOTAL_CHARACTERS for a label; texts and `labels.toxic` alone are read.

Defined results: null texts and texts without words score 0; repeated rows give repeated results; a
document with several label rows counts as toxic if any says so, one with several texts teaches its first in order; null labels and ids teach
nothing; with fewer than two labels the score is 0; other columns pass the stage and are ignored by the query; no rows give no rows.
All windows of a very long text are scored; what a task holds of it are its words and BATCH_WINDOWS windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacancia.llm.common import bounded_sample, filter_rows, map_arrow, texts
from vacancia.llm.langid import held_out

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_SIZE, CHAR_SIZE = 8, 8, 16
CHAR_BUCKETS = 1 << 14
NGRAM = 4
MOST_WORDS = 8000
SAMPLE_PER_LABEL = 900
#: Bounds of the sample in characters: of a document, and of all those of a label.
SAMPLE_CHARACTERS, TOTAL_CHARACTERS = 200_000, 8_000_000
LONGEST, PIECE, STEP = 20, 8, 4
WARM_EPOCHS, EPOCHS, BATCH, RATE = 2, 8, 128, 0.01
THRESHOLD = 0.3
BATCH_WINDOWS = 1024
#: Words of distinct texts whose new rows are made together.
WORDS_AT_A_TIME = 30_000
MOST_CACHED = 200_000
#: Negative documents for each positive one in the sample.
NEGATIVES = 2
#: Windows of one repeated word that are made of each of these.
REPEATS = 12

# Unicode's blocks of punctuation and ASCII's and Latin-1's marks stand between words, as white space does.
_WORD = re.compile("[^\\s!-/:-@\\[-`{-~\u00a1-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u2e00-\u2e7f\u3000-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")


def words(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [piece for word in found for piece in ([word] if len(word) <= LONGEST else [word[a : a + PIECE] for a in range(0, len(word) - STEP, STEP)])]


def ngram_buckets(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of NGRAM characters of words with their edges, at least one for each: all buckets, and where each word's begin."""
    marked = [f"<{w}>".ljust(NGRAM, ">") for w in many]
    lengths = np.array(list(map(len, marked)), np.int64)
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(max(len(points) - NGRAM + 1, 0), np.uint32)
    for k in range(NGRAM):
        h = (h ^ points[k : k + len(h)]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    ends = np.cumsum(lengths)
    inside = np.ones(len(points), bool)
    for k in range(1, NGRAM):
        inside[ends - k] = False  # grams that would run into the next word
    n = lengths - NGRAM + 1
    return (h[inside[: len(h)]] % np.uint32(CHAR_BUCKETS)).astype(np.int64), np.cumsum(n) - n


def mean_of(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Means of the runs of rows that begin at ``starts``."""
    lengths = np.diff(np.append(starts, len(rows)))
    return np.add.reduceat(rows, starts, axis=0) / lengths[:, None].astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, forward and backward passes. Directions are the first axis of recurrent parameters: 0 forward, 1 backward."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 0):
        r = np.random.default_rng(seed)
        size = WORD_SIZE + CHAR_SIZE
        init = lambda *shape, scale=1.0: (r.standard_normal(shape) * scale).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {
            "word": init(len(vocabulary) + 1, WORD_SIZE, scale=0.1), "char": init(CHAR_BUCKETS, CHAR_SIZE, scale=0.3),
            "wx": init(2, size, 3 * HIDDEN, scale=size**-0.5), "bx": np.zeros((2, 3 * HIDDEN), np.float32),
            "uh": init(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
            "wa": init(2 * HIDDEN, HIDDEN, scale=0.3), "ba": np.zeros(HIDDEN, np.float32), "va": init(HIDDEN, scale=0.3),
            "wo": init(2 * HIDDEN, scale=0.3), "bo": np.zeros(1, np.float32),
        }
        self.p["word"][0] = 0  # of all words that training has not seen

    def number(self, word: str) -> int:
        return self.vocabulary.get(word, 0)

    def inputs(self, word_ids: np.ndarray, grams: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        chars = mean_of(self.p["char"][grams[0]], grams[1]) if len(word_ids) else np.zeros((0, CHAR_SIZE), np.float32)
        return np.concatenate([self.p["word"][word_ids], chars], 1)

    def project_words(self, word_ids: np.ndarray, grams: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Projected inputs of many words, a part at a time: the rows of their n-grams take several times the result."""
        out = np.zeros((len(word_ids), 2, 3 * HIDDEN), np.float32)
        ends = np.append(grams[1][1:], len(grams[0]))
        for a in range(0, len(word_ids), WORDS_AT_A_TIME):
            b = min(a + WORDS_AT_A_TIME, len(word_ids))
            first = grams[1][a]
            out[a:b] = self.project(self.inputs(word_ids[a:b], (grams[0][first : ends[b - 1]], grams[1][a:b] - first)))
        return out

    def project(self, x: np.ndarray) -> np.ndarray:
        """(rows, 2, 3 HIDDEN) of inputs."""
        return np.stack([x @ self.p["wx"][d] + self.p["bx"][d] for d in (0, 1)], 1)

    def forward(self, projected: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; projected is (steps, windows, 2, 3 HIDDEN), mask (steps, windows)."""
        steps, n = mask.shape
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        kept, uh = [], self.p["uh"]
        for t in range(steps):
            back = steps - 1 - t
            x = np.stack([projected[t, :, 0], projected[back, :, 1]])
            m = np.stack([mask[t], mask[back]])[:, :, None]
            u = h @ uh
            rz = 1 / (1 + np.exp(-(x[:, :, : 2 * HIDDEN] + u[:, :, : 2 * HIDDEN])))
            r, z = rz[:, :, :HIDDEN], rz[:, :, HIDDEN:]
            un = u[:, :, 2 * HIDDEN :]
            c = np.tanh(x[:, :, 2 * HIDDEN :] + r * un)
            new = h + m * (1 - z) * (c - h)
            if keep:
                kept.append((h, r, z, un, c, m))
            h = new
            states[t, :, :HIDDEN], states[back, :, HIDDEN:] = h[0], h[1]
        a = np.tanh(states @ self.p["wa"] + self.p["ba"])
        e = np.where(mask > 0, a @ self.p["va"], -30)
        e = np.exp(e - e.max(0))
        weight = e / e.sum(0)
        pooled = (weight[:, :, None] * states).sum(0)
        logits = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logits, (kept, states, a, weight, pooled)) if keep else logits

    def backward(self, saved, mask: np.ndarray, dlogits: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters above the projection, and of the projected input."""
        kept, states, a, weight, pooled = saved
        steps, n = mask.shape
        g = {"wo": pooled.T @ dlogits, "bo": np.array([dlogits.sum()])}
        dpooled = dlogits[:, None] * self.p["wo"]
        dstates = weight[:, :, None] * dpooled[None]
        dweight = (states * dpooled[None]).sum(2)
        de = weight * (dweight - (weight * dweight).sum(0))
        de = np.where(mask > 0, de, 0)
        da = de[:, :, None] * self.p["va"] * (1 - a * a)
        g["va"] = np.einsum("tnk,tn->k", a, de)
        g["wa"] = np.einsum("tnk,tnj->kj", states, da)
        g["ba"] = da.sum((0, 1))
        dstates = dstates + da @ self.p["wa"].T
        dproj = np.zeros((steps, n, 2, 3 * HIDDEN), np.float32)
        dh = np.zeros((2, n, HIDDEN), np.float32)
        g["uh"] = np.zeros_like(self.p["uh"])
        for t in range(steps - 1, -1, -1):
            back = steps - 1 - t
            h, r, z, un, c, m = kept[t]
            dh = dh + np.stack([dstates[t, :, :HIDDEN], dstates[back, :, HIDDEN:]])
            dc = dh * m * (1 - z) * (1 - c * c)
            dz = -dh * m * (c - h) * z * (1 - z)
            dr = dc * un * r * (1 - r)
            du = np.concatenate([dr, dz, dc * r], 2)
            dx = np.concatenate([dr, dz, dc], 2)
            dproj[t, :, 0], dproj[back, :, 1] = dx[0], dx[1]
            g["uh"] += h.transpose(0, 2, 1) @ du
            dh = dh * (1 - m * (1 - z)) + du @ self.p["uh"].transpose(0, 2, 1)
        return g, dproj


def windows_of(n: int) -> list[tuple[int, int]]:
    """(start, stop) of all windows over n words: each STRIDE after the one before, the last one ending with the text."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def grid_of(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, windows) rows, and the mask, of windows of at most WINDOW row numbers."""
    lengths = np.array(list(map(len, sequences)))
    mask = np.arange(WINDOW)[:, None] < lengths[None, :]
    at = np.zeros((len(sequences), WINDOW), np.int64)
    at[mask.T] = np.concatenate(sequences)
    return at.T, mask.astype(np.float32)


def train(rows: list[tuple[str, int]]) -> Network | None:
    """A network from (text, label) of each document, in a fixed order."""
    rows = [r for r in rows if words(r[0])]
    if len({y for _, y in rows}) < 2:
        return None
    seen: dict[str, int] = {}
    table: dict[str, int] = {}
    numbered = []
    for text, _ in rows:
        doc = words(text)
        for w in set(doc):
            seen[w] = seen.get(w, 0) + 1
        numbered.append(np.array([table.setdefault(w, len(table)) for w in doc], np.int32))
    frequent = sorted((w for w, n in seen.items() if n >= 3), key=lambda w: (-seen[w], w))[:MOST_WORDS]
    net = Network({w: i + 1 for i, w in enumerate(frequent)})
    word_ids = np.array([net.number(w) for w in table], np.int64)
    grams = ngram_buckets(list(table))
    table.clear()
    owned: list[list[np.ndarray]] = []
    for doc in numbered:
        owned.append([doc[a:b] for a, b in windows_of(len(doc))])
    labels = np.array([y for _, y in rows], np.float32)
    r = np.random.default_rng(0)
    for d, doc in enumerate(numbered):
        if len(doc) and not labels[d]:  # no word of a clean text is toxic, however often it is said
            owned[d] += [np.repeat(w, r.integers(1, WINDOW + 1)) for w in r.choice(doc, REPEATS)]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(WARM_EPOCHS + EPOCHS):
        if epoch < WARM_EPOCHS:
            chosen = [(d, w) for d, ws in enumerate(owned) for w in (ws if len(ws) <= 4 else [ws[i] for i in r.choice(len(ws), 4, replace=False)])]
        else:
            projected = net.project_words(word_ids, grams)
            flat = [(d, w) for d, ws in enumerate(owned) for w in ws]
            logits = np.concatenate([_score(net, projected, [w for _, w in flat[i : i + BATCH_WINDOWS]]) for i in range(0, len(flat), BATCH_WINDOWS)])
            best: dict[int, int] = {}
            for i, (d, _) in enumerate(flat):
                if d not in best or logits[i] > logits[best[d]]:
                    best[d] = i
            chosen = [flat[i] for i in best.values()]
        order = r.permutation(len(chosen))
        for k in range(0, len(order), BATCH):
            part = [chosen[i] for i in order[k : k + BATCH]]
            step += 1
            _update(net, moments, step, part, labels, word_ids, grams, 0.3 if epoch < WARM_EPOCHS else 1.0)
    return net


def _score(net: Network, projected: np.ndarray, sequences: list[np.ndarray]) -> np.ndarray:
    at, mask = grid_of(sequences)
    return net.forward(projected[at] if len(projected) else np.zeros((*at.shape, 2, 3 * HIDDEN), np.float32), mask)


def _update(net: Network, moments: dict, step: int, part: list, labels: np.ndarray, word_ids: np.ndarray, grams: tuple[np.ndarray, np.ndarray], positive_weight: float) -> None:
    """One step of Adam on a batch of windows."""
    at, mask = grid_of([w for _, w in part])
    used, inverse = np.unique(at, return_inverse=True)
    if not len(word_ids):
        return
    ends = np.append(grams[1][1:], len(grams[0]))
    lengths = (ends - grams[1])[used]
    starts = np.cumsum(lengths) - lengths
    own = grams[0][np.repeat(grams[1][used] - starts, lengths) + np.arange(lengths.sum())], starts
    x = net.inputs(word_ids[used], own)
    projected = net.project(x)
    logits, saved = net.forward(projected[inverse.reshape(at.shape)], mask, keep=True)
    y = labels[[d for d, _ in part]]
    d = (sigmoid(logits) - y) * np.where(y > 0, positive_weight, 1.0) / len(part)
    g, dproj = net.backward(saved, mask, d.astype(np.float32))
    flat = dproj.reshape(-1, 6 * HIDDEN)
    by_word = np.zeros((len(used), 6 * HIDDEN), np.float32)
    np.add.at(by_word, inverse.ravel(), flat)
    by_word = by_word.reshape(len(used), 2, 3 * HIDDEN)
    g["wx"] = np.einsum("ni,ndk->dik", x, by_word)
    g["bx"] = by_word.sum(0)
    dx = np.einsum("ndk,dik->ni", by_word, net.p["wx"])
    g["word"] = np.zeros_like(net.p["word"])
    np.add.at(g["word"], word_ids[used], dx[:, :WORD_SIZE])
    g["word"][0] = 0
    g["char"] = np.zeros_like(net.p["char"])
    np.add.at(g["char"], own[0], np.repeat(dx[:, WORD_SIZE:] / lengths[:, None], lengths, 0))
    for k, v in g.items():
        m, s = moments[k]
        m += 0.1 * (v - m)
        s += 0.001 * (v * v - s)
        net.p[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


class Scorer:
    """Scores of texts, with the projected rows of distinct words kept while there are fewer than MOST_CACHED."""

    def __init__(self, net: Network):
        self.net = net
        self.rows = np.zeros((1024, 6 * HIDDEN), np.float32)
        self.at: dict[str, int] = {}

    def _make_rows(self, found: set[str]) -> None:
        """Makes the rows of words that have none yet, all together."""
        fresh = list(found.difference(self.at))
        if fresh:
            before = len(self.at)
            self.at.update(zip(fresh, range(before, before + len(fresh))))
            while len(self.at) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[before : len(self.at)] = self.net.project(self._inputs(fresh)).reshape(len(fresh), -1)

    def _inputs(self, fresh: list[str]) -> np.ndarray:
        return self.net.inputs(np.array([self.net.number(w) for w in fresh], np.int64), ngram_buckets(fresh)).astype(np.float32)

    def scores(self, many: Iterator[str]) -> list[float]:
        """The highest window's score of each text."""
        best: list[float] = []
        pending: list[np.ndarray] = []
        owner: list[int] = []

        def flush() -> None:
            if not pending:
                return
            at, mask = grid_of(pending)
            logits = self.net.forward(self.rows[at].reshape(*at.shape, 2, 3 * HIDDEN), mask)
            for d, s in zip(owner, sigmoid(logits).tolist()):
                best[d] = max(best[d], s)
            pending.clear()
            owner.clear()

        def take(documents: list[list[str]]) -> None:
            if len(self.at) > MOST_CACHED:
                flush()
                self.at = {}
            self._make_rows(set().union(*documents))
            for found in documents:
                best.append(0.0)
                ids = np.fromiter(map(self.at.__getitem__, found), np.int64, len(found))
                for a, b in windows_of(len(ids)):
                    pending.append(ids[a:b])
                    owner.append(len(best) - 1)
                    if len(pending) >= BATCH_WINDOWS:
                        flush()

        held: list[list[str]] = []
        n = 0
        for text in many:
            held.append(found := words(text))
            n += len(found) + 1
            if n >= WORDS_AT_A_TIME:
                take(held)
                held, n = [], 0
        if held:
            take(held)
        flush()
        return best


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Network | None:
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    sizes = docs.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("size"))
    known = known.join(sizes.where(F.col("size") <= SAMPLE_CHARACTERS), "doc_id", "left_semi")
    chosen = bounded_sample(known.select(F.col("doc_id").alias("row"), "toxic"), "toxic", F.when(F.col("toxic") > 0, per_label).otherwise(NEGATIVES * per_label))
    chosen = F.broadcast(chosen.select(F.col("row").alias("doc_id"), "toxic"))  # at most (1 + NEGATIVES) x per_label rows
    found = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    upto = F.sum(F.length("text")).over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = found.withColumn("upto", upto).where(F.col("text").isNotNull() & (F.col("upto") <= TOTAL_CHARACTERS)).select("doc_id", "text", "toxic").collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    mixed = np.random.default_rng(2).permutation(len(rows))
    return train([(rows[i]["text"], rows[i]["toxic"]) for i in mixed])


def _scorer(docs: DataFrame, net: Network | None):
    shipped = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size
    return lambda: Scorer(shipped.value).scores if shipped.value is not None else lambda many: [0.0 for _ in many]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    scorer = _scorer(docs, fit(docs, labels))

    def make():
        scores = scorer()

        def step(batch: pa.RecordBatch):
            found = scores(texts(batch.column(2)))
            return [batch.column(0), batch.column(1), found, [int(s >= THRESHOLD) for s in found]]

        return step

    return map_arrow(docs.select("doc_id", held_out().alias("held_out"), "text"), make, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below ``threshold``, with all columns."""
    scorer = _scorer(docs, fit(docs, labels))
    at = docs.columns.index("text")

    def make():
        scores = scorer()
        return lambda batch: [s < threshold for s in scores(texts(batch.column(at)))]

    return filter_rows(docs, make)
