"""Embedding near-dedup: exact threshold pairs by cover-tree dual traversal.

Unit vectors u, v have cosine >= t iff |u - v| <= eps = sqrt(2 - 2 t).

1. Cells: every vector goes to its nearest of P pivots, P growing with the table
   as long as the pivots stay under PIVOT_BYTES. Cells lie side by side in
   groups of about GROUP_BYTES, one task each. A cell's count and covering
   radius are one small aggregate.
2. Visits: a vector v of cell A can have a partner in cell B only if
   |v - pB| <= min(rB + eps, |v - pA| + 2 eps). It is sent to the groups of
   such cells, once a group, and of two groups only one sends to the other. No
   pair of cells or groups is ever enumerated.
3. In a group one cover tree per cell: level k has radius RADIUS / 2**k, the
   members of a node are covered by children within that radius, the node's own
   centre is its first child (nesting), siblings are more than the radius apart,
   down to LEAF members or radii below eps / 2. A node whose children would hold
   fewer than SPREAD members on average stays a leaf: there bounds prune less
   than a matrix product costs. Every node keeps its true covering radius.
   Visitors come in batches, each with a tree of its own.
4. Dual traversal of two trees, depth first in blocks: node pairs go on only
   while |c1 - c2| <= r1 + r2 + eps; the members of surviving leaf pairs are
   compared, large leaves by blocks of float32 products first. The bounds are
   exact, so every pair is found; nothing is capped, and a task holds one group,
   one batch and one block of candidates a level.
5. The query returns one row a vector: the least vector of its connected
   component and the number of its partners. near_pairs lists the pairs.

Vectors travel in their own type. Bounds and the first look at a block are taken
in float32 and carry a slack for it; the cosine of a pair is taken in float64 from the original values, up to
TIE, which stands for the rounding of float64 itself.

Defined results for odd input:

* null embedding, null or non-finite element, zero vector: in no pair, a class of its own with no links;
* null vec_id: in no pair and no row;
* vectors of another length than the most frequent (least on ties): like null embeddings;
* repeated rows (equal vec_id): one vector, never paired with itself, other pairs appear once;
* equal vectors: distance 0, all their pairs appear; a cell of more than CELL_ROWS
  of them is cut by a hash of the id into cells of one centre;
* ties at the threshold: a pair;
* empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifold.llm.common import stash, table
from tarifold.llm.hamming_join import components

COSINE = 0.95
RADIUS = 1.0
#: Rows aimed at per cell and held at most by one; bytes of all pivots at most; bytes of vectors aimed at per group.
CELL, CELL_ROWS, PIVOT_BYTES, GROUP_BYTES = 4096, 8192, 64 << 20, 32 << 20
#: Rows of a distance block, node pairs looked at together, entries of a block of distances to pivots.
BLOCK, COMBINATIONS, ENTRIES = 512, 1 << 16, 1 << 22
#: Members at which a tree stops; members a child holds at least on average, else a node is not split.
LEAF, SPREAD = 256, 16
#: Slack of the bounds for float32; of a cosine in float32; of the cosine for float64.
SLACK, LOOSE, TIE = 2e-3, 1e-4, 1e-12


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """id and the vector (array<float> as it came, other numbers as array<double>), valid rows only."""
    kind = embeddings.schema["embedding"].dataType.simpleString()
    own = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    own = own.filter("id is not null and v is not null and size(v) > 0").filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    length = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return own.filter(F.size("v") == (length["d"] if length else 0))


def _packer(dtype: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "raw": [np.asarray(v, dtype).tobytes() for v in b["v"]]})

    return run


def units(raw: list[bytes], dtype: str, dim: int) -> np.ndarray:
    """Float64 unit vectors of raw vectors."""
    x = np.frombuffer(b"".join(raw), dtype).reshape(-1, dim).astype(np.float64)
    if len(x):
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
    return x


def _to(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(1))


def build_tree(x: np.ndarray, eps: float, radius: float = RADIUS, leaf: int = 1, spread: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, nodes) of one cover tree; nodes of at most leaf members, or with less than spread a child, are not split.

    nodes: level, centre row, first and end position in the order, first and
    end child node, covering radius. Members of a node are contiguous.
    """
    order = np.arange(len(x))
    centre = 0
    nodes = [[0, centre, 0, len(x), 0, 0, float(_to(x, x[centre]).max())]]
    level, frontier = 0, [0]
    while frontier:
        level, after = level + 1, []
        for at in frontier:
            _, centre, lo, hi, _, _, covering = nodes[at]
            if hi - lo <= leaf or covering <= eps / 2:
                continue
            rows = before = order[lo:hi].copy()
            own, alive = x[rows], np.ones(hi - lo, bool)
            first_child, position, c = len(nodes), lo, int(centre)
            while True:
                squares = 2 - 2 * (own @ x[c])
                near = (squares <= radius * radius) & alive
                near[rows == c] = True  # rounding must not lose the centre itself
                members = rows[near]
                order[position : position + len(members)] = members
                nodes.append([level, c, position, position + len(members), 0, 0, math.sqrt(max(0.0, float(squares[near].max())))])
                after.append(len(nodes) - 1)
                position += len(members)
                if position == hi:
                    break
                if (len(nodes) - first_child) * spread >= hi - lo and spread > 1:  # one child more would be too many
                    order[lo:hi] = before
                    del after[len(after) - (len(nodes) - first_child) :], nodes[first_child:]
                    break
                alive &= ~near
                if (hi - position) * 2 < len(rows):
                    rows, own = rows[alive], own[alive]
                    alive = np.ones(len(rows), bool)
                c = int(rows[int(alive.argmax())])
            if len(nodes) > first_child:
                nodes[at][4:6] = [first_child, len(nodes)]
        frontier, radius = after, radius / 2
    return order, np.array(nodes, np.float64).reshape(-1, 7)


def _products(lo_a: np.ndarray, n_a: np.ndarray, lo_b: np.ndarray, n_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All combinations of the ranges [lo_a, lo_a + n_a) and [lo_b, lo_b + n_b), pair by pair, in blocks."""
    n = n_a * n_b
    ends = np.cumsum(n)
    total, at = int(ends[-1]) if len(ends) else 0, 0
    while at < total:
        flat = np.arange(at, min(total, at + COMBINATIONS))
        which = np.searchsorted(ends, flat, "right")
        step = flat - (ends[which] - n[which])
        yield lo_a[which] + step // n_b[which], lo_b[which] + step % n_b[which]
        at += COMBINATIONS


def _below(nodes: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First child and number of children; a node without children stands for itself."""
    lo, n = nodes[pick, 4].astype(np.int64), (nodes[pick, 5] - nodes[pick, 4]).astype(np.int64)
    return np.where(n > 0, lo, pick), np.maximum(n, 1)


@dataclass(frozen=True)
class Tree:
    """A cover tree with its vectors, in the tree's order."""

    ids: np.ndarray
    exact: np.ndarray
    x: np.ndarray
    nodes: np.ndarray
    centre: np.ndarray
    radius: np.ndarray


def make_tree(ids: np.ndarray, exact: np.ndarray, eps: float) -> Tree:
    x = exact.astype(np.float32)
    order, nodes = build_tree(x, eps, leaf=LEAF, spread=SPREAD)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Tree(ids[order], exact[order], x[order], nodes, place[nodes[:, 1].astype(np.int64)], nodes[:, 6].astype(np.float32))


def traverse(a: Tree, b: Tree, eps: float, pairs_a: np.ndarray | None = None, pairs_b: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf node pairs of two trees that the bounds leave, block by block, depth first."""
    if pairs_a is None:
        pairs_a, pairs_b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        if _to(a.x[a.centre[:1]], b.x[b.centre[:1]])[0] > a.radius[0] + b.radius[0] + eps + SLACK:
            return
    nx, ny = a.nodes, b.nodes
    if not ((nx[pairs_a, 5] > nx[pairs_a, 4]) | (ny[pairs_b, 5] > ny[pairs_b, 4])).any():
        yield pairs_a, pairs_b
        return
    (lo_a, n_a), (lo_b, n_b) = _below(nx, pairs_a), _below(ny, pairs_b)
    if len(pairs_a) == 1:  # all children against all children: one matrix product, in blocks
        cb = np.arange(lo_b[0], lo_b[0] + n_b[0])
        yb = b.x[b.centre[cb]]
        for at in range(lo_a[0], lo_a[0] + n_a[0], BLOCK):
            ca = np.arange(at, min(at + BLOCK, lo_a[0] + n_a[0]))
            limit = a.radius[ca][:, None] + b.radius[cb][None, :] + np.float32(eps + SLACK)
            i, j = np.nonzero(2 - 2 * (a.x[a.centre[ca]] @ yb.T) <= limit * limit)
            for k in range(0, len(i), COMBINATIONS):
                yield from traverse(a, b, eps, ca[i[k : k + COMBINATIONS]], cb[j[k : k + COMBINATIONS]])
    else:
        for ca, cb in _products(lo_a, n_a, lo_b, n_b):
            limit = a.radius[ca] + b.radius[cb] + np.float32(eps + SLACK)
            ok = 2 - 2 * np.einsum("ij,ij->i", a.x[a.centre[ca]], b.x[b.centre[cb]]) <= limit * limit
            if ok.any():
                yield from traverse(a, b, eps, ca[ok], cb[ok])


def _members(a: Tree, b: Tree, pairs_a: np.ndarray, pairs_b: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i of a, j of b) of the members of leaf node pairs whose cosine reaches the threshold."""
    lo_a, hi_a, lo_b, hi_b = (t[p, k].astype(np.int64) for t, p in ((a.nodes, pairs_a), (b.nodes, pairs_b)) for k in (2, 3))
    large = (hi_a - lo_a) * (hi_b - lo_b) > BLOCK
    for k in np.flatnonzero(large):
        for at in range(lo_a[k], hi_a[k], BLOCK):
            for to in range(lo_b[k], hi_b[k], BLOCK):
                end_a, end_b = min(at + BLOCK, hi_a[k]), min(to + BLOCK, hi_b[k])
                if a is b and end_b - 1 <= at:  # no i < j
                    continue
                rough = a.x[at:end_a] @ b.x[to:end_b].T
                if rough.max() < cosine - LOOSE:
                    continue
                i, j = np.nonzero(rough >= cosine - LOOSE)
                if len(i) > 4 * BLOCK:
                    i, j = np.nonzero(a.exact[at:end_a] @ b.exact[to:end_b].T >= cosine - TIE)
                else:
                    ok = np.einsum("ij,ij->i", a.exact[i + at], b.exact[j + to]) >= cosine - TIE
                    i, j = i[ok], j[ok]
                yield i + at, j + to
    few = ~large
    for i, j in _products(lo_a[few], (hi_a - lo_a)[few], lo_b[few], (hi_b - lo_b)[few]):
        ok = np.einsum("ij,ij->i", a.exact[i], b.exact[j]) >= cosine - TIE
        yield i[ok], j[ok]


def tree_pairs(a: Tree, b: Tree, cosine: float) -> Iterator[pd.DataFrame]:
    """The near pairs of two trees, or of one with itself."""
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    for pairs_a, pairs_b in traverse(a, b, eps):
        for i, j in _members(a, b, pairs_a, pairs_b, cosine):
            if a is b:
                i, j = i[i < j], j[i < j]
            p, q = a.ids[i], b.ids[j]
            ok = p != q
            if ok.any():
                yield pd.DataFrame({"vec_a": np.minimum(p[ok], q[ok]), "vec_b": np.maximum(p[ok], q[ok])})


@dataclass(frozen=True)
class Layout:
    """Cells by pivot (first cell of a pivot, number of its cells), the group of each cell, radii of pivots."""

    first: np.ndarray
    cells: np.ndarray
    group: np.ndarray
    radius: np.ndarray
    groups: int

    def home(self, pivot: np.ndarray, ids: np.ndarray) -> np.ndarray:
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[pivot] + (mixed % self.cells[pivot].astype(np.uint64)).astype(np.int64)


def lay_out(centres: np.ndarray, counts: np.ndarray, radius: np.ndarray, parallelism: int, row_bytes: int) -> Layout:
    """Cells in groups of like size whose pivots lie near each other."""
    total = int(counts.sum())
    cells = np.maximum(1, -(-counts // CELL_ROWS))
    first = np.cumsum(cells) - cells
    heads = centres[: max(1, math.isqrt(len(centres)))]
    near = centres @ heads.T
    order = np.lexsort((-near.max(1), near.argmax(1)))
    pivot_of = np.repeat(order, cells[order])
    size = (counts / cells)[pivot_of]
    wanted = max(2 * parallelism, -(-total * row_bytes // GROUP_BYTES))
    number = np.floor((np.cumsum(size) - size) / max(total / wanted, 1.0)).astype(np.int64)
    _, number = np.unique(number, return_inverse=True)
    group = np.empty(int(cells.sum()), np.int64)
    nth = np.arange(len(pivot_of)) - np.repeat(np.cumsum(cells[order]) - cells[order], cells[order])
    group[first[pivot_of] + nth] = number
    return Layout(first, cells, group, radius, int(number.max()) + 1 if len(number) else 1)


def _blocks(b: pd.DataFrame, pivots: int) -> Iterator[pd.DataFrame]:
    step = max(1, ENTRIES // pivots)
    for at in range(0, len(b), step):
        yield b.iloc[at : at + step]


def near_pairs(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_a < vec_b of all pairs whose cosine is at least the threshold."""
    spark = embeddings.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    valid = valid_vectors(embeddings)
    dtype = "<f4" if valid.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    vectors = stash(valid.mapInPandas(_packer(dtype), "id long, raw binary"), "vectors")
    total, one = vectors.count(), vectors.first()
    if total < 2:
        return spark.createDataFrame([], "vec_a long, vec_b long")
    dim = len(one["raw"]) // np.dtype(dtype).itemsize
    pivots = max(1, min(PIVOT_BYTES // (4 * dim), -(-total // CELL)))
    chosen = [bytes(r["raw"]) for r in vectors.orderBy(F.xxhash64("id"), "id").limit(pivots).select("raw").collect()]  # at most PIVOT_BYTES of float32
    centres = units(chosen, dtype, dim).astype(np.float32)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in _blocks(batch, len(centres)):
                x = units(list(b["raw"]), dtype, dim).astype(np.float32)
                pivot = (x @ centres.T).argmax(1)
                yield b.assign(pivot=pivot, away=_to(x, centres[pivot]).astype(np.float64))

    placed = stash(vectors.mapInPandas(nearest, "id long, raw binary, pivot long, away double"), "placed")
    counts, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.float32)
    for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():  # a row a pivot
        counts[r["pivot"]], radius[r["pivot"]] = r["n"], r["r"]
    layout = lay_out(centres, counts, radius, max(1, spark.sparkContext.defaultParallelism // 2), len(one["raw"]))  # a group a core
    groups_of = [np.unique(layout.group[f : f + c]) for f, c in zip(layout.first, layout.cells)]
    n_groups = np.array([len(g) for g in groups_of])
    flat_groups, group_starts = np.concatenate(groups_of), np.cumsum(n_groups) - n_groups

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in _blocks(batch, len(centres)):
                x = units(list(b["raw"]), dtype, dim).astype(np.float32)
                pivot, ids = b["pivot"].to_numpy(), b["id"].to_numpy()
                cell = layout.home(pivot, ids)
                own = layout.group[cell]
                yield pd.DataFrame({"part": own.astype(np.int32), "visitor": False, "cell": cell, "id": ids, "raw": b["raw"].to_numpy()})
                away = np.sqrt(np.maximum(0, 2 - 2 * (x @ centres.T)))
                reach = np.minimum(b["away"].to_numpy(np.float32)[:, None] + np.float32(2 * eps), layout.radius[None, :] + np.float32(eps)) + np.float32(SLACK)
                i, p = np.nonzero((away <= reach) & (counts > 0)[None, :])
                i, p = np.repeat(i, n_groups[p]), np.concatenate([flat_groups[:0], *(flat_groups[s : s + n] for s, n in zip(group_starts[p], n_groups[p]))]) if (n_groups > 1).any() else flat_groups[group_starts[p]]
                mine = own[i]
                i, p = np.divmod(np.unique((i * layout.groups + p)[np.where((mine + p) % 2 == 0, mine < p, mine > p)]), layout.groups)
                for k in range(0, len(i), 1 << 15):
                    at = i[k : k + (1 << 15)]
                    yield pd.DataFrame({"part": p[k : k + (1 << 15)].astype(np.int32), "visitor": True, "cell": cell[at], "id": ids[at], "raw": b["raw"].to_numpy()[at]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        trees: list[Tree] | None = None

        def grow() -> list[Tree]:
            rows = pd.concat(held) if held else pd.DataFrame({"cell": [], "id": [], "raw": []})
            held.clear()
            return [make_tree(g["id"].to_numpy(np.int64), units(list(g["raw"]), dtype, dim), eps) for _, g in rows.groupby("cell", sort=True)]

        for batch in batches:
            guest = batch["visitor"].to_numpy(bool)
            if not guest.all():
                held.append(batch[~guest])
            if guest.any():
                if trees is None:
                    trees = grow()
                    yield from inside(trees)
                b = batch[guest]
                guests = make_tree(b["id"].to_numpy(np.int64), units(list(b["raw"]), dtype, dim), eps)
                for tree in trees:
                    yield from tree_pairs(tree, guests, cosine)
        if trees is None:
            yield from inside(grow())

    def inside(trees: list[Tree]) -> Iterator[pd.DataFrame]:
        for k, a in enumerate(trees):
            for b in trees[: k + 1]:
                yield from tree_pairs(a, b, cosine)

    sent = placed.mapInPandas(send, "part int, visitor boolean, cell long, id long, raw binary")
    found = sent.repartitionById(layout.groups, F.col("part")).sortWithinPartitions("visitor", "cell").mapInPandas(meet, "vec_a long, vec_b long")
    # only an id with several vectors or rows can give a pair twice
    return found if vectors.groupBy("id").count().filter("count > 1").isEmpty() else found.distinct()


def classes(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, class_id and links of each vector: the least vector it is connected with, and its number of partners."""
    pairs = stash(near_pairs(embeddings, cosine), "pairs")
    links = pairs.select(F.explode(F.array("vec_a", "vec_b")).alias("vec_id")).groupBy("vec_id").agg(F.count("*").alias("links"))
    roots = components(pairs, "vec_a", "vec_b").toDF("vec_id", "class_id")
    ids = embeddings.select(F.col("vec_id").cast("long").alias("vec_id")).filter("vec_id is not null").distinct()
    found = ids.join(links, "vec_id", "left").join(roots, "vec_id", "left")
    return found.select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: class and number of near duplicates of every vector of the embeddings table."""
    return classes(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """The same by comparing all pairs and following links."""
    return f"""with recursive e as (select vec_id, embedding::double[] as v from embeddings where vec_id is not null),
near as (select a.vec_id as vec_a, b.vec_id as vec_b from e a join e b on a.vec_id < b.vec_id where list_cosine_similarity(a.v, b.v) >= {COSINE}),
link as (select vec_a as one, vec_b as other from near union select vec_b, vec_a from near),
reach(vec_id, root) as (select vec_id, vec_id from e union select l.other, r.root from reach r join link l on l.one = r.vec_id),
classes as (select vec_id, min(root) as class_id from reach group by vec_id),
counts as (select one, count(*) as links from link group by one)
select c.vec_id, c.class_id, coalesce(n.links, 0) as links from classes c left join counts n on n.one = c.vec_id"""
