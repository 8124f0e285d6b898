"""Operator 9: exact near-duplicate vectors by dual traversal of cover trees.

Vectors are scaled to unit length, where cosine >= c is a distance of at most sqrt(2 - 2c). Equal
vectors of a label are one entry with a count. Entries of a label are dealt to the cells of up to
MOST_PIVOTS pivots: an entry's home is its nearest pivot p, and it is a guest of every cell whose
pivot q has d(x, q) <= d(x, p) + 2 eps, which holds for every neighbour's home. A cell of more than
PART_ROWS members is dealt out by pairs of its parts, so a hot label or a crowd of near copies never
meets in one task. Each group builds a cover tree (nested levels, radii halving) for each of its
parts and walks both at once: a pair of nodes farther apart than their covering radii and eps
is pruned, a pair wholly within eps is linked whole, the node of the larger radius of any other pair is
opened, and two leaves are multiplied. Links are counted, and a star is emitted for each linked set.

Vectors without near ones in many dimensions make a flat tree: all are children of the root, so bounds compare all pairs of
centres. No metric bound settles them higher up; the work on such a label grows with its square.

Defined results: vectors that are null, empty, or zero, hold a null or a
non-finite component, or have a null label have no links and are their own component; repeated
rows are vectors of their own; vectors of unequal lengths have no link; a null vec_id is never a component's name; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacancia.llm.common import checkpoint, connected_components

COSINE = 0.98
MOST_PIVOTS = 64
PART_ROWS = 4096
LEAF_ROWS = 32
NAMELESS = (1 << 63) - 1  # stands for the vec_id of vectors that have none
#: Distances below it are lost in the rounding of a product: two vectors of one direction may seem 2e-8 apart.
SLACK = 1e-6


class Node:
    """Points within ``radius`` of their centre, and children that cover them with at most half the level's radius, the first about the same centre."""

    __slots__ = ("center", "points", "radius", "children")

    def __init__(self, center: int, points: np.ndarray, radius: float):
        self.center, self.points, self.radius, self.children = center, points, radius, []


def gaps(vectors: np.ndarray, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (vectors[rows] @ vectors[others].T), 0))


def cover_tree(vectors: np.ndarray, points: np.ndarray) -> Node:
    """Tree over rows ``points`` of unit vectors; levels have radii 1, 1/2, 1/4 and so on.

    A level's centres are chosen in order: a point that no centre before it covers is one. Candidates are compared with all points left in blocks.
    """
    first = int(points[0])
    root = Node(first, points, float(gaps(vectors, points, points[:1]).max()))
    todo = [(root, 1.0)]
    while todo:
        node, level = todo.pop()
        if len(node.points) <= LEAF_ROWS or node.radius <= SLACK:
            continue
        while level >= node.radius:
            level /= 2
        rest = np.append(node.center, node.points[node.points != node.center])
        while len(rest):
            candidates = rest[:64]
            away = gaps(vectors, candidates, rest)
            free = np.ones(len(rest), bool)
            for k in range(len(candidates)):
                if free[k]:
                    own = free & (away[k] <= level)
                    own[k] = True
                    child = Node(int(candidates[k]), rest[own], float(away[k][own].max()))
                    node.children.append(child)
                    todo.append((child, level / 2))
                    free &= ~own
            rest = rest[free]
    return root


class Links:
    """Weighted link counts of rows, the sets that links span, and how many pairs were settled in which way."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, home: np.ndarray, cosine: float):
        self.vectors, self.weights, self.home, self.cosine = vectors, weights, home, cosine
        self.counts = np.zeros(len(vectors), np.int64)
        self.parent = np.arange(len(vectors))
        self.pruned = self.linked_whole = self.multiplied = 0  # pairs of points

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(self, i: int, others: np.ndarray) -> None:
        own = self.root(i)
        up = self.parent[others]
        if (up == own).all():
            return
        for j in np.unique(up).tolist():
            other = self.root(j)
            if other != own:
                low, up = min(own, other), max(own, other)
                self.parent[up] = own = low
        self.parent[others] = own

    def block(self, left: np.ndarray, right: np.ndarray, same: bool) -> None:
        """Compares rows of one side with rows of the other, two guests never; within one side, each pair once."""
        self.multiplied += len(left) * (len(left) - 1) // 2 if same else len(left) * len(right)
        for i0 in range(0, len(left), 512):
            rows = left[i0 : i0 + 512]
            for j0 in range(i0 if same else 0, len(right), 2048):
                cols = right[j0 : j0 + 2048]
                near = self.vectors[rows] @ self.vectors[cols].T >= self.cosine
                if not near.any():
                    continue
                near &= self.home[rows][:, None] | self.home[cols][None, :]
                if same:
                    near &= (i0 + np.arange(len(rows)))[:, None] < (j0 + np.arange(len(cols)))[None, :]
                self.counts[rows] += near @ self.weights[cols]
                self.counts[cols] += self.weights[rows] @ near
                for i in np.flatnonzero(near.any(1)):
                    self.union(int(rows[i]), cols[near[i]])

    def whole(self, left: np.ndarray, right: np.ndarray, same: bool) -> None:
        """Links all pairs of two sides, or within one, but two guests."""
        self.linked_whole += len(left) * (len(left) - 1) // 2 if same else len(left) * len(right)
        homes = [side[self.home[side]] for side in (left, right)]
        for rows, others, own in ((left, right, homes[1]),) if same else ((left, right, homes[1]), (right, left, homes[0])):
            self.counts[rows] += np.where(self.home[rows], self.weights[others].sum(), self.weights[own].sum())
            if same:
                self.counts[own] -= self.weights[own]
        for own, others in zip(homes, (right, left)):
            if len(own) and len(others):
                self.union(int(own[0]), np.concatenate([own, others]) if len(own) > 1 and not same else others)


def dual_traversal(links: Links, a: Node, b: Node, eps: float) -> None:
    """Adds all links between the points of two nodes, or within one where they are the same.

    Of two nodes the one of the larger radius is opened (a node and itself: both), and its children meet the other's side all at once:
    pairs that the bounds settle end there, pairs of leaves are multiplied, a leaf's all together, and the rest is opened further.
    """
    todo = [(a, [b])]
    while todo:
        x, others = todo.pop()
        if len(others) == 1 and others[0] is x:
            if 2 * x.radius <= eps - SLACK:
                links.whole(x.points, x.points, True)
                continue
            if not x.children:
                links.block(x.points, x.points, True)
                continue
            rows = others = x.children
        else:
            rows = x.children or [x]
        same = others is rows
        radii, sizes, centers = (np.array([f(n) for n in others]) for f in (lambda n: n.radius, lambda n: len(n.points), lambda n: n.center))
        wide = np.array([bool(n.children) for n in others])
        points = np.concatenate([n.points for n in others])
        if same:
            todo += [(n, [n]) for n in rows if len(n.points) > 1]
        for i0 in range(0, len(rows), 256):
            some = rows[i0 : i0 + 256]
            gap = gaps(links.vectors, np.array([n.center for n in some]), centers)
            reach = np.array([n.radius for n in some])[:, None] + radii
            meet = np.arange(len(others)) > (i0 + np.arange(len(some)))[:, None] if same else np.ones(gap.shape, bool)
            far = gap > reach + eps + SLACK
            links.pruned += int(np.array([len(n.points) for n in some]) @ ((far & meet) @ sizes))
            meet &= ~far
            near = meet & (gap + reach <= eps - SLACK)
            wider: dict[int, list[Node]] = {}  # nodes that wait for another one to be opened, which is opened for all of them at once
            for k in np.flatnonzero(meet.any(1)).tolist():
                n = some[k]
                if near[k].any():
                    links.whole(n.points, points[np.repeat(near[k], sizes)], False)
                rest = np.flatnonzero(meet[k] & ~near[k])
                if not n.children:
                    leaves = meet[k] & ~near[k] & ~wide
                    if leaves.any():
                        links.block(n.points, points[np.repeat(leaves, sizes)], False)
                    for j in rest[wide[rest]].tolist():
                        wider.setdefault(j, []).append(n)
                    continue
                mine = ~wide[rest] | (radii[rest] <= n.radius)
                if mine.any():
                    todo.append((n, [others[j] for j in rest[mine]]))
                for j in rest[~mine].tolist():
                    wider.setdefault(j, []).append(n)
            todo += [(others[j], nodes) for j, nodes in wider.items()]


def link_group(ids: np.ndarray, vectors: np.ndarray, weights: np.ndarray, home: np.ndarray, right: np.ndarray | None, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, weighted links, place of the least linked id) of the entries with a link, among all of them or between those with ``right`` and the others."""
    order = np.argsort(ids, kind="stable")
    links = Links(vectors[order], weights[order], home[order], cosine)
    eps = float(np.sqrt(max(2 - 2 * cosine, 0)))
    sides = [np.arange(len(ids))] if right is None else [np.flatnonzero(~right[order]), np.flatnonzero(right[order])]
    if all(len(s) for s in sides):
        trees = [cover_tree(links.vectors, s) for s in sides]
        dual_traversal(links, trees[0], trees[-1], eps)
    found = np.flatnonzero(links.counts)
    return order[found], links.counts[found], order[[links.root(i) for i in found.tolist()]] if len(found) else order[:0]


def unit(rows: pd.Series) -> np.ndarray:
    v = np.stack(rows.to_numpy()).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of (vec_id, embedding, label)."""
    eps = float(np.sqrt(max(2 - 2 * cosine, 0)))
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select("vec_id", F.col("embedding").alias("v"), F.col("label").cast("string").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    written = F.transform("v", lambda x: (x + F.lit(0.0).cast(kind[6:-1])).cast("string"))  # a negative zero is a zero
    rows = rows.withColumn("entry", F.when(valid, F.md5(F.concat_ws(" ", "label", F.concat_ws(",", written)))))
    entries = rows.where("entry is not null").groupBy("entry").agg(F.coalesce(F.min("vec_id"), F.lit(NAMELESS)).alias("vec"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    entries = checkpoint(entries.withColumn("dim", F.size("v")))

    sizes = entries.groupBy("label", "dim").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / PART_ROWS)
    sized = entries.join(sizes, ["label", "dim"]).select("label", "dim", "entry", "vec", "n", "v", parts.alias("parts"))
    rank = F.row_number().over(Window.partitionBy("label", "dim").orderBy("entry"))
    pivots = sized.select("label", "dim", "parts", "v", rank.cast("long").alias("cell")).where(F.col("cell") <= MOST_PIVOTS).where(F.col("cell") <= F.col("parts"))
    # an entry meets its label's pivots in a group of its own share of the label
    shares = sized.withColumn("share", F.pmod(F.hash("entry"), F.col("parts")).cast("long"))
    pivots = pivots.select(F.col("label").alias("p_label"), F.col("dim").alias("p_dim"), F.col("v").alias("p_v"), "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p_share"))

    def assign(own: pd.DataFrame, centers: pd.DataFrame) -> pd.DataFrame:
        if own.empty or centers.empty:
            return pd.DataFrame({c: [] for c in ("label", "dim", "entry", "vec", "n", "v", "cell", "home")})
        away = np.sqrt(np.maximum(2 - 2 * unit(own["v"]) @ unit(centers["p_v"]).T, 0))
        cells = centers["cell"].to_numpy()
        home = cells[away.argmin(1)]
        # of two homes, the pair is met in that of the lower number alone
        member = (cells[None, :] == home[:, None]) | (away <= away.min(1, keepdims=True) + 2 * eps + SLACK) & (cells[None, :] < home[:, None])
        i, j = np.nonzero(member)
        return own.iloc[i][["label", "dim", "entry", "vec", "n", "v"]].reset_index(drop=True).assign(cell=cells[j], home=home[i] == cells[j])

    members = shares.groupBy("label", "dim", "share").cogroup(pivots.groupBy("p_label", "p_dim", "p_share")).applyInPandas(assign, f"label string, dim int, entry string, vec long, n long, v {kind}, cell long, home boolean")
    members = checkpoint(members)
    crowd = members.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    dealt = members.join(crowd, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.hash("entry", "cell"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("label", "dim", "cell", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "entry", "vec", "n", "v", "home")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        right = None if key[3] == key[4] else (group["part"] == key[4]).to_numpy()
        at, links, least = link_group(group["entry"].to_numpy(), unit(group["v"]), group["n"].to_numpy(np.int64), group["home"].to_numpy(bool), right, cosine)
        entry, vec = group["entry"].to_numpy(), group["vec"].to_numpy()
        return pd.DataFrame({"entry": entry[at], "vec": vec[at], "links": links, "to_entry": entry[least], "to_vec": vec[least]})

    found = checkpoint(dealt.groupBy("label", "dim", "cell", "low", "high").applyInPandas(compare, "entry string, vec long, links long, to_entry string, to_vec long"))
    # nodes are named by their smallest vec_id, so the smallest node names the component
    components = connected_components(found.select(F.struct("vec", "entry").alias("a"), F.struct(F.col("to_vec").alias("vec"), F.col("to_entry").alias("entry")).alias("b")))
    components = components.select(F.col("node.entry").alias("node"), F.col("component.vec").alias("component"))
    links = found.groupBy("entry").agg(F.sum("links").alias("links")).withColumnRenamed("entry", "linked")
    each = entries.join(links, entries.entry == links.linked, "left").join(components, F.col("entry") == F.col("node"), "left")
    each = each.select(F.col("entry").alias("of"), F.nullif(F.coalesce("component", "vec"), F.lit(NAMELESS)).alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    linked = rows.where("entry is not null").join(each, F.col("entry") == F.col("of")).select("vec_id", "n_links", "component_id")
    alone = rows.where("entry is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return linked.union(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", kept.alias("kept"))


def brute_force(rows: list[tuple], cosine: float = COSINE) -> list[tuple]:
    """near_vectors() by comparing every pair, for small tables of (vec_id, embedding, label)."""
    def good(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, links = len(rows), [0] * len(rows)
    component = list(range(n))
    scaled = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good(v, label) else None for _, v, label in rows]
    for i in range(n):
        for j in range(i):
            if scaled[i] is not None and scaled[j] is not None and rows[i][2] == rows[j][2] and len(scaled[i]) == len(scaled[j]) and scaled[i] @ scaled[j] >= cosine:
                links[i], links[j] = links[i] + 1, links[j] + 1
                old, new = component[i], component[j]
                component = [new if c == old else c for c in component]
    names = {c: min((r[0] for r, d in zip(rows, component) if d == c and r[0] is not None), default=None) for c in set(component)}
    return [(r[0], k, names[c], r[0] is not None and r[0] == names[c]) for r, k, c in zip(rows, links, component)]
