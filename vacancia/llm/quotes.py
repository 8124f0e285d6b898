"""Operator 1: quotation linking in conversations.

A message's lines carry a quote level (leading `>` marks). Runs of one level are passages; a passage, its
paragraphs and its lines are normalised (case, white space, marks) and hashed. Of all messages'
own words, the same units are hashed, and for each (conversation, hash) the first turn that holds
it is the original: one row a key, however common a line is, so the join cannot multiply.
A reply's longest unit that an earlier turn holds says what it answers; level 1 counts before
deeper ones. Threads follow by pointer doubling over the links alone. Rows come back in reply order
(conversation, thread, turn), ordered by ranges, so a conversation of any size is never one group.

Passages, paragraphs and lines link at any length: "> No" answers the first earlier message of the conversation that says "No" as a
message, paragraph or line of its own.

Defined results: without quotes a text is unchanged; null texts are empty; quotes that no earlier turn of the
conversation holds link to nothing; a null conv_id or turn links to nothing; of repeated (conv_id, turn) rows
each is returned and all share one answer; of units of one length at one level the latest original counts; other columns are
ignored, whatever their names; no rows give no rows; a very long text is parsed whole in its task, and its units are dealt out by hash.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import checkpoint, map_arrow

_MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_SPACE = re.compile(r"\s+")
# How mail programs introduce a quotation.
_INTRODUCTION = re.compile(r"^\s*(On\b.*\bwrote|.*\bwrites?|Le\b.*\ba écrit|Am\b.*\bschrieb.*|El\b.*\bescribió)\s*:\s*$", re.IGNORECASE)


def lines(text: str) -> list[tuple[int, str]]:
    """(quote level, content) of each line."""
    out = []
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        out.append((marks[1].count(">"), line[marks.end() :].rstrip("\r")) if marks else (0, line))
    return out


def normal(text: str) -> str:
    return _SPACE.sub(" ", text).strip().casefold()


def units(content: list[str]) -> dict[str, int]:
    """Hash and length of a passage, its paragraphs and its lines."""
    paragraphs: list[list[str]] = [[]]
    for line in content:
        if line.strip():
            paragraphs[-1].append(line)
        elif paragraphs[-1]:
            paragraphs.append([])
    found = {normal("\n".join(content)), *(normal("\n".join(p)) for p in paragraphs), *map(normal, content)} - {""}
    return {hashlib.sha256(u.encode("utf-8", "surrogatepass")).hexdigest()[:32]: len(u) for u in found}


def passages(parsed: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """Runs of quoted lines of one level."""
    out: list[tuple[int, list[str]]] = []
    last = 0
    for level, content in parsed:
        if level:
            if level != last:
                out.append((level, []))
            out[-1][1].append(content)
        last = level
    return out


def own_text(text: str, parsed: list[tuple[int, str]]) -> str:
    """The text without quotes and what introduces them; unchanged where there are none."""
    if not any(level for level, _ in parsed):
        return text
    kept: list[str] = []
    for i, (level, content) in enumerate(parsed):
        if level or i + 1 < len(parsed) and parsed[i + 1][0] and _INTRODUCTION.match(content):
            continue
        if content.strip() or kept and kept[-1].strip():
            kept.append(content)
    return "\n".join(kept).strip()


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, n_quotes, levels, and the hashed units of own words and of quotes."""
    unit = "array<struct<hash string, length int, level int>>"

    def make():
        def step(batch: pa.RecordBatch):
            texts, counts, levels, own, quoted = [], [], [], [], []
            for value in batch.column(3):
                text = value.as_py() or ""
                parsed = lines(text)
                found = passages(parsed)
                texts.append(own_text(text, parsed))
                counts.append(len(found))
                levels.append(max((level for level, _ in found), default=0))
                own.append([{"hash": h, "length": n, "level": 0} for h, n in units(texts[-1].split("\n")).items()])
                quoted.append([{"hash": h, "length": n, "level": level} for level, content in found for h, n in units(content).items()])
            return [batch.column(0), batch.column(1), batch.column(2), texts, counts, levels, own, quoted]

        return step

    return map_arrow(messages.select("conv_id", "turn", "role", "text"), make, f"conv_id long, turn long, role string, text string, n_quotes int, levels int, own {unit}, quoted {unit}")


def link(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked) of the messages that quote an earlier one."""
    quoted = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.inline("quoted"))
    wanted = quoted.select("conv_id", "hash").distinct()
    own = parsed.where("turn is not null").select("conv_id", "turn", F.inline("own")).select(F.col("conv_id").alias("c"), F.col("hash").alias("h"), F.col("turn").alias("original"))
    # hashes that nobody quotes go before they are dealt out
    own = own.join(wanted.select(F.col("conv_id").alias("c"), F.col("hash").alias("h")), ["c", "h"], "left_semi")
    first = own.groupBy("c", "h").agg(F.min("original").alias("original"))
    met = quoted.join(first, (quoted.conv_id == first.c) & (quoted.hash == first.h)).where("original < turn")
    best = F.max_by("original", F.struct(-F.col("level"), "length", "original"))
    return met.groupBy("conv_id", "turn").agg(best.alias("reply_to"), F.countDistinct("original").cast("int").alias("n_linked"))


def threads(links: DataFrame) -> DataFrame:
    """Adds the first turn of each linked message's thread, by pointer doubling."""
    current = checkpoint(links.withColumn("thread", F.col("reply_to")))
    while True:
        further = current.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("up"))
        step = checkpoint(current.join(further, (current.conv_id == further.c) & (current.thread == further.t), "left").select(*links.columns, F.coalesce("up", "thread").alias("thread"), F.col("up").isNotNull().alias("moved")))
        current = step.drop("moved")
        if step.where("moved").isEmpty():
            return current


def conversations(messages: DataFrame) -> DataFrame:
    """A row per message in reply order: conv_id, thread, turn, role, text, reply_to, n_quotes, levels, n_linked, formatted."""
    parsed = checkpoint(parse(messages))
    linked = threads(link(parsed))
    linked = linked.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "reply_to", "n_linked", "thread")
    rows = parsed.join(linked, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))
    rows = rows.select("conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", "role", "text", "reply_to", "n_quotes", "levels", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), formatted.alias("formatted"))
    return rows.orderBy("conv_id", "thread", "turn", "role", "text")
