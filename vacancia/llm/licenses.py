"""Operator 4: licence scan through a positional index of rare words, in DataFrame functions alone.

Templates are sequences of words. Document frequencies of their words over the whole table give
IDF; a template posts the rarer half of its words with their positions. In a file, each posted
word that occurs looks its postings up: place minus position is where the template would
begin. At each such begin, the IDF share of the template's posted words that stand where they
should is the coverage, and a template is found there if the coverage is at least COVERAGE and its
mandatory key phrases stand word for word at their positions. Base templates are their own key phrase.

Two passes over the texts: one counts document frequencies (an aggregate of as many rows as the
templates have words), one is a projection. No text is shuffled, so neither a hot source nor a very
long text meets others in a task.

Defined results: null and empty texts have no words (0, null places, empty labels, score 0); repeated
rows give repeated results; overlapping places all count; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COVERAGE = 0.75


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def key_places(self) -> list[tuple[int, list[str]]]:
        found = []
        for key in self.keys or (self.text,):
            k = key.split()
            found.append((next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k), k))
        return found


# Phrases of well-known licences. No word may hold a k: lower() maps one letter outside ASCII to it.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2.0", "mozilla public license version 2 0"),
    Template("cc-by-4.0", "cc by 4 0"),
    Template("cc-by-nc-4.0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "cc by sa 4 0"),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted",)),
    Template("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
)


def words(text: Column) -> Column:
    """The words of a whole text in order. lower() serves: of its changes outside A-Z none makes a word of a template."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def idf_of(df: dict[str, int], n: int) -> dict[str, float]:
    return {w: math.log((n + 1) / (k + 1)) + 1 for w, k in df.items()}


def posted(template: Template, df: dict[str, int]) -> list[tuple[int, str]]:
    """(position, word) of the rarer half of the words, those of the lowest document frequency, earlier ones first among equals."""
    order = sorted(range(len(template.words)), key=lambda i: (df[template.words[i]], i))
    return sorted((i, template.words[i]) for i in order[: math.ceil(len(template.words) / 2)])


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """Documents that hold each word of a template, and all documents."""
    vocabulary = sorted({w for t in TEMPLATES for w in t.words})
    held = docs.select(F.explode(F.array_append(F.array_intersect(words(F.col("text")), F.array(*map(F.lit, vocabulary))), F.lit(""))).alias("word"))
    found = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}  # a row per word of the vocabulary, and one for all
    return {w: found.get(w, 0) for w in vocabulary}, found.get("", 0)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    df, n = document_frequencies(docs)
    idf = idf_of(df, n)
    postings, templates = [], []
    for number, t in enumerate(TEMPLATES):
        rare = posted(t, df)
        total = sum(idf[w] for _, w in rare)
        postings += [F.struct(F.lit(w).alias("word"), F.lit(number).cast("long").alias("template"), F.lit(i).alias("position")) for i, w in rare]
        templates.append(
            F.struct(
                F.lit(t.label).alias("label"),
                F.lit(t.base).alias("base"),
                F.array(*[F.struct(F.lit(i).alias("position"), F.lit(w).alias("word"), F.lit(idf[w] / total).alias("share")) for i, w in rare]).alias("posted"),
                F.array(*[F.struct(F.lit(i).alias("position"), F.array(*map(F.lit, k)).alias("words")) for i, k in t.key_places()]).alias("keys"),
            )
        )
    index, forms = F.array(*postings), F.array(*templates)
    rare_words = sorted({w for t in TEMPLATES for _, w in posted(t, df)})

    read = docs.select("doc_id", words(F.col("text")).alias("w"))
    hits = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("at"), x.alias("word"))), lambda h: h["word"].isin(rare_words))
    # a begin is one long, template and place, as distinct longs are found by hashing and distinct structs are not
    begins = F.flatten(F.transform(hits, lambda h: F.transform(F.filter(index, lambda p: (p["word"] == h["word"]) & (p["position"] <= h["at"])), lambda p: F.shiftleft(p["template"], 32) + (h["at"] - p["position"]))))
    begins = F.transform(F.array_distinct(begins), lambda b: F.struct(F.shiftright(b, 32).cast("int").alias("template"), b.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at")))

    def judge(b: Column) -> Column:
        form = F.get(forms, b["template"])
        standing = F.filter(form["posted"], lambda q: F.coalesce(F.get("w", b["at"] + q["position"]) == q["word"], F.lit(False)))
        coverage = F.aggregate(standing, F.lit(0.0), lambda s, q: s + q["share"])
        keys = F.forall(form["keys"], lambda k: F.slice("w", b["at"] + k["position"] + 1, F.size(k["words"])) == k["words"])
        return F.struct(form["label"].alias("label"), form["base"].alias("base"), b["at"].alias("at"), coverage.alias("coverage"), keys.alias("keys"))

    found = F.filter(F.transform(begins, judge), lambda j: j["keys"] & (j["base"] | (j["coverage"] >= COVERAGE)))
    none = F.lit(None).cast("array<struct<label:string,base:boolean,at:int,coverage:double,keys:boolean>>")
    read = read.select("doc_id", F.size("w").cast("long").alias("n_words"), F.when(F.arrays_overlap("w", F.array(*map(F.lit, rare_words))), found).otherwise(none).alias("found"))
    read = read.withColumn("found", F.coalesce("found", F.array().cast("array<struct<label:string,base:boolean,at:int,coverage:double,keys:boolean>>")))
    places = F.filter("found", lambda j: j["base"])
    names = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda j: j["label"]))), ",")
    starts = F.transform(places, lambda j: j["at"].cast("long"))
    return read.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(places).alias("base_labels"), names(F.col("found")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda j: F.least(j["coverage"], F.lit(1.0)))), F.lit(0.0)), 6).alias("score"),
    )


def _oracle() -> str:
    values = ", ".join(f"({n}, '{t.label}', {str(t.base).lower()}, {i}, '{w}', {len(t.words)})" for n, t in enumerate(TEMPLATES) for i, w in enumerate(t.words))
    keys = ", ".join(f"({n}, {i}, {len(k)}, '{' '.join(k)}')" for n, t in enumerate(TEMPLATES) for i, k in t.key_places())
    return f"""
WITH t(template, label, base, position, word, size) AS (VALUES {values}),
k(template, position, size, phrase) AS (VALUES {keys}),
d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
x AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM d),
v AS (SELECT * FROM x WHERE word IN (SELECT word FROM t)),
df AS (SELECT word, count(DISTINCT r) AS n FROM v GROUP BY word),
idf AS (SELECT DISTINCT t.word, coalesce(n, 0) AS n, ln(((SELECT count(*) FROM d) + 1) / (coalesce(n, 0) + 1)) + 1 AS idf FROM t LEFT JOIN df USING (word)),
ranked AS (SELECT t.*, idf, row_number() OVER (PARTITION BY template ORDER BY n, position) AS rank FROM t JOIN idf USING (word)),
posted AS (SELECT * FROM ranked WHERE rank <= ceil(size / 2.0)),
total AS (SELECT template, sum(idf) AS total FROM posted GROUP BY template),
hit AS (SELECT v.r, template, label, base, place - position AS start, sum(idf) AS idf FROM v JOIN posted USING (word) WHERE place >= position GROUP BY ALL),
ok AS (SELECT hit.*, idf / total AS coverage FROM hit JOIN total USING (template) JOIN d USING (r) WHERE (base OR idf / total >= {COVERAGE} - 1e-12)
  AND NOT EXISTS (SELECT 1 FROM k WHERE k.template = hit.template AND array_to_string(d.w[hit.start + k.position + 1 : hit.start + k.position + k.size], ' ') <> phrase)),
found AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, round(least(max(coverage), 1.0), 6) AS score FROM ok GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN found USING (r)"""


ORACLE_SQL = _oracle()
