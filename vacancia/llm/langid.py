"""Operator 7: language identification by sparse multinomial logistic regression.

Features: TF-IDF of hashed letter n-grams (1 to 3 letters, word edges included) of the whole text,
sublinear counts, unit length. Training: follow-the-regularised-leader with an elastic net, whose
L1 part leaves most weights zero; then one temperature, fitted on labelled texts that training has
not seen, calibrates the probabilities. The model is of fixed size (FEATURES x languages).

Document frequencies count the n-grams of all rows that may be learned from. The classifier is fitted on a bounded sample: of each
language, however many there are, the SAMPLE_PER_LANGUAGE distinct rows of the least hash; a language takes 0.5 MB of the driver's memory.
It learns from text and lang of documents whose crc32(doc_id as text) mod 4 is not 2, only.

Defined results: a null text or one without a letter is `und` with score 0; repeated rows give
repeated results and teach once; a null doc_id is held out of training; of languages with one probability the first in order of names
is predicted; with nothing to learn from, every text is `und`; other columns pass the stage and are ignored by the query; no rows
give no rows. A very long text is counted whole, a block of characters at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import bounded_sample, drop_unused, filter_rows, map_arrow, texts

FEATURES = 1 << 15
SAMPLE_PER_LANGUAGE = 800
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
UNKNOWN = "und"
MIN_SCORE = 0.5
#: Characters of a text that are turned into n-grams at a time.
BLOCK = 1 << 20

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """The lower-case letter of each code point, 0 for all that are no letters."""
    global _letters
    if _letters is None:
        table = np.zeros(sys.maxunicode + 1, np.uint32)
        for cp in range(sys.maxunicode + 1):
            ch = chr(cp)
            if ch.isalpha():
                low = ch.lower()
                table[cp] = ord(low[0]) if low else cp
        _letters = table
    return _letters


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the whole text."""
    total = np.zeros(FEATURES, np.int64)
    table = letter_table()
    tail = np.zeros(2, np.uint32)
    for at in range(0, len(text), BLOCK):
        points = table[np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        letters = points > 0
        keep = letters.copy()
        keep[1:] |= letters[:-1]  # the first character after a word stands for its edge
        keep[0] |= tail[1] > 0
        run = np.concatenate([tail, points[keep]])
        tail = run[-2:]
        c0, c1, c2 = run[:-2], run[1:-1], run[2:]
        h1 = c2 * np.uint32(0x9E3779B1)
        h2 = (c1 * np.uint32(0x85EBCA77) + h1) ^ np.uint32(0x27D4EB2F)
        h3 = (c0 * np.uint32(0xC2B2AE3D) + h2) ^ np.uint32(0x165667B1)
        total += np.bincount(h1[c2 > 0] >> np.uint32(17), minlength=FEATURES)
        total += np.bincount(h2[(c1 > 0) | (c2 > 0)] >> np.uint32(17), minlength=FEATURES)
        total += np.bincount(h3[((c0 > 0) | (c2 > 0)) & (c1 > 0)] >> np.uint32(17), minlength=FEATURES)
    return total


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # float64[FEATURES]
    weights: np.ndarray  # float64[FEATURES + 1, languages], the last row the bias
    temperature: float

    def vector(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(count)
        values = (1 + np.log(count[at])) * self.idf[at]
        return at, values / max(np.sqrt(values @ values), 1e-12)

    def scores(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[at] + self.weights[-1]

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        z = self.scores(*self.vector(counts(text))) / self.temperature
        p = np.exp(z - z.max())
        return self.languages[int(p.argmax())], float(p.max() / p.sum())


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seen: np.ndarray, documents: int) -> Model:
    """A model from (language, features, counts) of each document, in a fixed order, and how many of all documents hold each feature."""
    languages = sorted({r[0] for r in rows})
    number = {x: i for i, x in enumerate(languages)}
    model = Model(languages, np.log((1 + documents) / (1 + seen)) + 1, np.zeros((FEATURES + 1, max(len(languages), 1))), 1.0)
    data = []
    for language, at, n in rows:
        values = (1 + np.log(n)) * model.idf[at]
        data.append((np.append(at, FEATURES).astype(np.int32), np.append(values / max(np.sqrt(values @ values), 1e-12), 1.0).astype(np.float32), number[language]))
    calibration = data[::5] if len(data) >= 10 else data
    fitted = [d for i, d in enumerate(data) if i % 5] if len(data) >= 10 else data
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for k in order.permutation(len(fitted)):
            at, values, y = fitted[k]
            w = _leader(z[at], n[at])
            logits = values @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = values[:, None] * p[None, :]
            squares = n[at] + g * g
            z[at] += g - (np.sqrt(squares) - np.sqrt(n[at])) / ALPHA * w
            n[at] = squares
    model.weights = _leader(z, n)
    if len(languages) > 1:
        logits = np.array([values @ model.weights[at] for at, values, _ in calibration])
        truth = np.array([y for _, _, y in calibration])

        def loss(t: float) -> float:
            s = logits / t
            top = s.max(1)
            return float((top + np.log(np.exp(s - top[:, None]).sum(1)) - s[np.arange(len(s)), truth]).mean())

        grid = np.exp(np.linspace(np.log(0.05), np.log(10), 107))
        model.temperature = float(min(grid, key=loss))
    return model


def _leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the regularised leader: zero where |z| is within L1."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold each feature, and how many texts there are: each task adds its own up before they are dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_unused()
        total = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for text in texts(batch.column(0)):
                total[:-1] += counts(text) > 0
                total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["feature", "n"])

    seen = np.zeros(FEATURES + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # FEATURES + 1 rows at most
        seen[r["feature"]] = r["n"]
    return seen[:-1], int(seen[-1])


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("row"))
    chosen = bounded_sample(known.select("row", "lang"), "lang", F.lit(per_language))

    def make():
        def step(batch: pa.RecordBatch):
            at, n = [], []
            for text in texts(batch.column(2)):
                count = counts(text)
                found = np.flatnonzero(count)
                at.append(found.astype(np.uint16).tobytes())
                n.append(count[found].astype(np.uint32).tobytes())
            return [batch.column(0), batch.column(1), at, n]

        return step

    labelled = known.join(chosen, ["row", "lang"]).dropDuplicates(["row", "lang"]).select("row", "lang", "text")
    rows = map_arrow(labelled, make, "row long, lang string, at binary, n binary").collect()  # at most per_language rows of each language
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    used = [(r["lang"], np.frombuffer(r["at"], np.uint16), np.frombuffer(r["n"], np.uint32)) for r in rows if r["at"]]
    mixed = np.random.default_rng(1).permutation(len(used))
    return train([used[i] for i in mixed], *document_frequencies(known))


def _shipped(docs: DataFrame, model: Model):
    """The model, of fixed size, in single precision, as a broadcast."""
    return docs.sparkSession.sparkContext.broadcast(Model(model.languages, model.idf.astype(np.float32), model.weights.astype(np.float32), model.temperature))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row; fits a model on the table itself unless one is given."""
    shipped = _shipped(docs, model or fit(docs))

    def make():
        def step(batch: pa.RecordBatch):
            found = [shipped.value.predict(t) for t in texts(batch.column(2))]
            return [batch.column(0), batch.column(1), [f[0] for f in found], [f[1] for f in found]]

        return step

    return map_arrow(docs.select("doc_id", held_out().alias("held_out"), "text"), make, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose language is identified with a score of at least ``min_score``, with all columns."""
    shipped = _shipped(docs, fit(docs))
    at = docs.columns.index("text")

    def make():
        def step(batch: pa.RecordBatch) -> list[bool]:
            found = [shipped.value.predict(t) for t in texts(batch.column(at))]
            return [language != UNKNOWN and score >= min_score for language, score in found]

        return step

    return filter_rows(docs, make)
