"""Adaptive splitting of a feed into parts that a source answers whole.

A source shows at most so many items of a feed, so a feed that reaches that many is split by its next filter: first by
the categories that its items name, then by fixed lists of values. A category filter can't show items without a
category, so a feed that holds some is split by the next filter as well, whatever the category ("any").

All possible parts are counted in one pass of grouping sets; a frontier of parts then moves down a level at a time and takes only
those whose parent is full. What remains are leaves, full parts that can't be split, and the rows that no leaf holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.operators.lineage import stored

# Fixed values of the sources' filters: items that fill a feed, and categories above which it isn't split by them.
FULL, MOST_CATEGORIES = 100, 250
EXPERIENCE = ("no_exp", *(f"{years}y" for years in range(1, 11)))
ENGLISH = ("no_english", "basic", "pre", "intermediate", "upper", "fluent", "proficient", "native")
FILTERS = {"experience": EXPERIENCE, "english": ENGLISH}
#: What the category of a part says: all items whatever their category, items without one (counted, but no part of its own), or a name.
ANY, NONE, NAMED = 0, 1, 2


def part_counts(items: DataFrame, filters: Sequence[str]) -> DataFrame:
    """Items of each possible part: level (how many filters are set beyond the category), scope, category and the filters, null where not set.

    Items have a unique id, categories (an array, maybe null) and the filters' columns; a value that is null itself counts for no part below.
    """
    named = F.array_distinct(F.filter(F.coalesce("categories", F.array().cast("array<string>")), lambda c: F.trim(c) != ""))
    names = F.transform(named, lambda c: F.struct(F.lit(NAMED).alias("scope"), c.alias("category")))
    scopes = F.concat(F.array(F.struct(F.lit(ANY).alias("scope"), F.lit(None).cast("string").alias("category"))), F.when(F.size(named) > 0, names).otherwise(F.array(F.struct(F.lit(NONE).alias("scope"), F.lit(None).cast("string").alias("category")))))
    rows = items.select(F.explode(scopes).alias("s"), *filters).select("s.scope", "s.category", *filters)
    sets = [["scope", "category", *filters[:k]] for k in range(len(filters) + 1)]
    level = reduce(lambda a, b: a + b, [1 - F.grouping(f) for f in filters]).cast("int")
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in ("scope", "category", *filters))).agg(level.alias("level"), F.count("*").alias("n"))


def split(items: DataFrame, filters: dict[str, Sequence[str]] | None = None, full: int = FULL, most_categories: int = MOST_CATEGORIES) -> DataFrame:
    """(category, filters, by_category, n, state, uncovered) of every part that is asked for and holds items, in no order.

    state is leaf, split, or overflow (full, and nothing left to split by); a null filter isn't set. ``by_category`` is false of parts
    beside the categories. ``uncovered`` counts the items of a split part that none of its parts holds.
    """
    filters = FILTERS if filters is None else filters
    names = list(filters)
    counts = stored(part_counts(items, names))
    listed = reduce(lambda a, b: a & b, [F.col(f).isNull() | F.col(f).isin(*values) for f, values in filters.items()])
    # a row of grouping sets whose own value is null is of a level but has no value for it
    whole = reduce(lambda a, b: a & b, [(F.col("level") <= k) | F.col(f).isNotNull() for k, f in enumerate(names)])
    parts = counts.where(listed & whole)
    root = parts.where((F.col("level") == 0) & (F.col("scope") == ANY))
    catalog = parts.where((F.col("level") == 0) & (F.col("scope") == NAMED)).agg(F.count("*").alias("categories"))
    bare = parts.where((F.col("level") == 0) & (F.col("scope") == NONE)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bare"))
    # one row each: how many categories there are, and how many items have none
    facts = catalog.join(bare, F.lit(True)).withColumns({"splittable": F.col("categories") <= most_categories})
    first = root.join(F.broadcast(facts), F.lit(True))
    by_name, beside = (F.col("n") >= full) & F.col("splittable") & (F.col("categories") > 0), (F.col("n") >= full) & F.col("splittable") & ((F.col("bare") > 0) | (F.col("categories") == 0))
    open_root = first.select("n", by_name.alias("by_name"), beside.alias("beside"))

    below = lambda rows, level: rows.where(F.col("level") == level)
    named = below(parts, 0).where(F.col("scope") == NAMED).join(F.broadcast(open_root.where("by_name").select(F.lit(True).alias("_"))), F.lit(True), "left_semi")
    loose = below(parts, 1).where(F.col("scope") == ANY).join(F.broadcast(open_root.where("beside").select(F.lit(True).alias("_"))), F.lit(True), "left_semi") if names else root.where("false")
    asked = [root, named.unionByName(loose)]
    frontier = [named, loose]  # of levels 0 and 1
    for level in range(len(names)):
        full_parts = frontier[0].where(F.col("n") >= full)
        keys = ["scope", "category", *names[:level]]
        children = below(parts, level + 1).alias("c")
        same = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys])
        found = children.join(full_parts.select(*keys).alias("p"), same, "left_semi")
        asked.append(found)
        frontier = [found.unionByName(frontier[1]), root.where("false")]
    every = reduce(DataFrame.unionByName, asked)

    # what the parts of a full part hold together: a filter's values are exclusive, categories are not
    parent = [F.when(F.col("level") - 1 > k, F.col(f)).alias(f) for k, f in enumerate(names)]
    held = every.where("level > 0").select("scope", "category", (F.col("level") - 1).alias("level"), *parent, "n").groupBy("scope", "category", "level", *names).agg(F.sum("n").alias("held"))
    loose_held = parts.where((F.col("level") == 1) & (F.col("scope") == NONE)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("held_bare"))
    e, h = every.alias("e"), held.alias("h")
    same = reduce(lambda a, b: a & b, [F.col(f"e.{k}").eqNullSafe(F.col(f"h.{k}")) for k in ("scope", "category", "level", *names)])
    joined = e.join(h, same, "left").select("e.*", "h.held").join(F.broadcast(first.select("splittable", "categories", "bare").join(loose_held, F.lit(True))), F.lit(True))
    is_root = (F.col("scope") == ANY) & (F.col("level") == 0)
    can = F.when(is_root, F.col("splittable") & ((F.col("categories") > 0) | F.lit(bool(names)))).otherwise(F.col("level") < len(names))
    state = F.when(F.col("n") < full, "leaf").when(can, "split").otherwise("overflow")
    gap = F.when(is_root, F.col("bare") - F.col("held_bare")).otherwise(F.col("n") - F.coalesce("held", F.lit(0)))
    return joined.select("category", *names, (is_root | (F.col("scope") == NAMED)).alias("by_category"), "n", state.alias("state"), F.when(state == "split", gap).otherwise(0).cast("long").alias("uncovered"))
