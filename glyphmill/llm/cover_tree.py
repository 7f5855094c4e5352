"""Exact threshold links between embeddings by dual traversal of cover trees.

Vectors are compared as unit vectors: cosine >= s is distance <= sqrt(2 - 2 s), a metric with a triangle inequality.

1. Equal vectors of one label are one class with a count; only classes are compared.
2. A label's root node is split level by level while it is large and in doubt: pivots are picked farthest first from a
   hashed handful until they cover it at half its radius, each vector goes to the nearest, and nodes keep their covering
   radius. Pairs of nodes are settled by bounds: balls too far apart hold no link, balls within the threshold of each
   other are linked throughout, which adds counts and joins both nodes without looking at their vectors. Only pairs in
   doubt go on, and only nodes in such pairs are split.
3. Each pair of small nodes in doubt is one task: both sides get a cover tree, nested levels with halving radii, and a
   dual traversal settles pairs of its nodes by the same two bounds, down to single vectors. A vector goes to a task only
   if the other node's ball can hold a partner.

Tasks return the number of links of each vector and a spanning forest, never all pairs. Splitting has no last level: a
node shrinks at every step, as equally near pivots share its vectors by hash. Where no bound helps (vectors of one label
that are spread evenly over many dimensions) the nodes' pairs, hence the work, grow with the square of the label's rows.

Rows: vectors that are null, empty, zero or hold nulls or non-finite numbers, and vectors without a label, link with
nothing and form their own component; vectors of different lengths never link; repeated rows are vectors each, and so
are rows of one id; proportional vectors, 0.0 and -0.0, link as their cosine says. Other columns are not read. An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from glyphmill.llm.common import Scratch, components

COSINE = 0.93
#: Numbers (rows by dimensions) that a task compares, fewest rows of such a node, children of a node, rows of a salted part.
LEAF_NUMBERS, LEAST_ROWS, FAN, SALT_ROWS = 1 << 19, 64, 64, 20_000
#: Distances are worked out to within SLACK; vectors closer than POINT are compared directly.
SLACK, POINT = 1e-7, 1e-6
#: Rows of a node of the trees in tasks that are compared directly; pairs that are looked at together, in matrices, and before they are joined.
BUCKET, PAIRS, DENSE, HELD = 8, 20_000, 1_000_000, 300_000
#: A level divides a node's vectors, so this many are never needed; it is an error, not a cut, if they are.
BROADCAST_ROWS, MOST_LEVELS = 10_000, 200


def unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distances(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosines))


class CoverTree:
    """Nodes in lists: centre (a row), covering radius, the stretch of ``order`` with the node's rows, and its children's
    numbers. Each level's radius is half of the one above; where that would leave most rows single, levels are passed
    over down to ``finest``."""

    def __init__(self, x: np.ndarray, finest: float):
        self.x, self.order = x, np.arange(len(x))
        self.centre, self.radius, self.start, self.stop, self.first, self.kids = [], [], [], [], [], []
        todo = [(self._node(0, 0, len(x)), 2.0)] if len(x) else []
        while todo:
            node, reach = todo.pop()
            lo, hi = self.start[node], self.stop[node]
            if hi - lo == 1:
                continue
            far = distances(x[self.order[lo:hi]] @ x[self.centre[node]])
            self.radius[node] = float(far.max()) + SLACK
            if hi - lo <= BUCKET or self.radius[node] <= POINT:
                continue
            while reach / 2 >= self.radius[node]:
                reach /= 2
            reach /= 2
            centres, member = self._cover(self.order[lo:hi], reach)
            if len(centres) * 4 > hi - lo and reach > finest:
                reach = finest
                centres, member = self._cover(self.order[lo:hi], reach)
            self.order[lo:hi] = self.order[lo:hi][np.argsort(member, kind="stable")]
            sizes = np.bincount(member)
            self.first[node], self.kids[node] = len(self.centre), len(centres)
            for c, m in zip(centres, sizes.tolist()):
                todo.append((self._node(c, lo, lo + m), reach))
                lo += m

    def _node(self, centre: int, start: int, stop: int) -> int:
        for name, value in (("centre", centre), ("radius", 0.0), ("start", start), ("stop", stop), ("first", -1), ("kids", 0)):
            getattr(self, name).append(value)
        return len(self.centre) - 1

    def _cover(self, rows: np.ndarray, reach: float) -> tuple[list[int], np.ndarray]:
        """Centres further apart than ``reach``, and for each row the centre within ``reach`` that came first."""
        member, centres, least = np.full(len(rows), -1), [], 1 - reach * reach / 2
        left = np.arange(len(rows))
        while len(left):
            near = self.x[rows[left[:128]]] @ self.x[rows[left]].T >= least
            open_ = np.ones(len(left), bool)
            for k in range(len(near)):
                if open_[k]:
                    hit = near[k] & open_
                    hit[k] = True
                    member[left[hit]] = len(centres)
                    open_ &= ~hit
                    centres.append(int(rows[left[k]]))
            left = left[open_]
        return centres, member


class Forest:
    """Joins rows by pairs and keeps the pairs that joined something."""

    def __init__(self, n: int):
        self.up, self.edges, self.waiting, self.held = np.arange(n), [], [], 0

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        self.waiting.append((p, q))
        self.held += len(p)
        if self.held > HELD:
            self.join()

    def join(self) -> None:
        if not self.waiting:
            return
        p, q = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.held = [], 0
        while True:
            a, b = self.up[p], self.up[q]
            apart = a != b
            if not apart.any():
                break
            p, q, a, b = p[apart], q[apart], a[apart], b[apart]
            # each root that has a link to a smaller one hangs on to it
            high, at = np.unique(np.maximum(a, b), return_index=True)
            self.up[high] = np.minimum(a, b)[at]
            self.edges.append((p[at], q[at]))
            while (self.up != (higher := self.up[self.up])).any():
                self.up = higher


def expand(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of a[i] .. a[i] + m[i] - 1 and b[i] .. b[i] + n[i] - 1 with their i, about PAIRS at a time."""
    size = m * n
    ends, lo = np.cumsum(size), 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        each = size[lo:hi]
        i = np.repeat(np.arange(lo, hi), each)
        at = np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)
        yield a[i] + at // n[i], b[i] + at % n[i], i
        lo = hi


class Traversal:
    """Links of the rows of ``x`` by cosine: within one tree, or between the trees of its first ``cut`` rows and the rest.

    ``total`` has for each row the summed weight of the rows it links with, ``forest`` joins what the links join.
    """

    def __init__(self, x: np.ndarray, weight: np.ndarray, cosine: float, cut: int | None = None):
        self.x, self.cosine, self.reach = x, cosine, float(np.sqrt(max(0.0, 2 - 2 * cosine)))
        trees, rows, nodes = [CoverTree(part, max(self.reach / 4, POINT)) for part in ([x] if cut is None else [x[:cut], x[cut:]])], 0, 0
        of = {name: [] for name in ("centre", "start", "stop", "first", "kids", "radius", "order")}
        for t in trees:
            for name, found in of.items():
                found.append(np.array(getattr(t, name)) + (rows if name in ("centre", "start", "stop", "order") else nodes if name == "first" else 0))
            rows, nodes = rows + len(t.x), nodes + len(t.centre)
        self.centre, self.start, self.stop, first, kids, self.radius, self.order = (np.concatenate(v) for v in of.values())
        self.leaf, self.size = kids == 0, self.stop - self.start
        self.below, self.width = np.where(self.leaf, np.arange(nodes), first), np.where(self.leaf, 1, kids)  # a leaf stands for itself
        self.weight, self.upto = weight, np.concatenate([[0], np.cumsum(weight[self.order])])
        self.steps, self.own, self.direct = np.zeros(rows + 1, np.int64), np.zeros(rows + 1, np.int64), np.zeros(rows, np.int64)
        self.forest, self.joined = Forest(rows), np.zeros(nodes, bool)
        roots = [0] if cut is None else [0, len(trees[0].centre)]
        if all(t.centre for t in trees):
            self._run(np.array(roots[:1]), np.array(roots[-1:]))
        self.forest.join()
        self.total = self.direct
        self.total[self.order] += np.cumsum(self.steps)[:-1] - np.cumsum(self.own)[:-1] * weight[self.order]

    def _run(self, i: np.ndarray, j: np.ndarray) -> None:
        todo = [(i, j)]
        while todo:
            i, j = todo.pop()
            both = self.leaf[i] & self.leaf[j]
            self._compare(i[both], j[both])
            i, j = i[~both], j[~both]
            wide = self.width[i] * self.width[j] > PAIRS
            for u, v in zip(i[wide].tolist(), j[wide].tolist()):
                todo += self._blocks(u, v)
            i, j = i[~wide], j[~wide]
            for u, v, at in expand(self.below[i], self.width[i], self.below[j], self.width[j]):
                keep = (i[at] != j[at]) | (u <= v)
                u, v = u[keep], v[keep]
                cos = np.einsum("ij,ij->i", self.x[self.centre[u]], self.x[self.centre[v]])
                todo += self._settle(u, v, cos)

    def _blocks(self, i: int, j: int):
        """The same for a pair with many children, by products of matrices."""
        cols = np.arange(self.below[j], self.below[j] + self.width[j])
        step = max(1, DENSE // len(cols))
        for lo in range(self.below[i], self.below[i] + self.width[i], step):
            rows = np.arange(lo, min(lo + step, self.below[i] + self.width[i]))
            cos = self.x[self.centre[rows]] @ self.x[self.centre[cols]].T
            # a chord's square is 2 - 2 cos
            far = self.reach + SLACK + self.radius[rows][:, None] + self.radius[cols][None]
            p, q = np.nonzero(2 - 2 * cos <= far * far)
            u, v, c = rows[p], cols[q], cos[p, q]
            keep = (u <= v) if i == j else slice(None)
            for at in range(0, len(u), DENSE):
                part = slice(at, at + DENSE)
                yield from self._settle(u[part][keep[part]] if i == j else u[part], v[part][keep[part]] if i == j else v[part], c[part][keep[part]] if i == j else c[part])

    def _settle(self, u: np.ndarray, v: np.ndarray, cos: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Drops pairs of nodes without links, counts those that link throughout, returns the others."""
        d, wide = distances(cos), self.radius[u] + self.radius[v]
        d[u == v] = 0
        inside = d + wide <= self.reach - 2 * SLACK
        doubt = ~inside & (d <= self.reach + wide + SLACK)
        self._count(u[inside], v[inside])
        return [(u[doubt], v[doubt])] if doubt.any() else []

    def _count(self, u: np.ndarray, v: np.ndarray) -> None:
        keep = (u != v) | (self.size[u] > 1)
        u, v = u[keep], v[keep]
        other = u != v
        for mine, theirs in ((u, v), (v[other], u[other])):
            gain = self.upto[self.stop[theirs]] - self.upto[self.start[theirs]]
            np.add.at(self.steps, self.start[mine], gain)
            np.add.at(self.steps, self.stop[mine], -gain)
            # all rows of a node are joined by the other's centre, once
            some, at = np.unique(mine, return_index=True)
            new = (self.size[some] > 1) & ~self.joined[some]
            some, partner = some[new], self.centre[theirs[at[new]]]
            self.joined[some] = True
            for k, p, _ in expand(self.start[some], self.size[some], partner, np.ones_like(partner)):
                self.forest.add(self.order[k], p)
        np.add.at(self.own, self.start[u[~other]], 1)
        np.add.at(self.own, self.stop[u[~other]], -1)
        self.forest.add(self.centre[u[other]], self.centre[v[other]])

    def _compare(self, i: np.ndarray, j: np.ndarray) -> None:
        """Row by row."""
        for u, v, at in expand(self.start[i], self.size[i], self.start[j], self.size[j]):
            keep = (i[at] != j[at]) | (u < v)
            p, q = self.order[u[keep]], self.order[v[keep]]
            hit = np.einsum("ij,ij->i", self.x[p], self.x[q]) >= self.cosine
            p, q = p[hit], q[hit]
            np.add.at(self.direct, p, self.weight[q])
            np.add.at(self.direct, q, self.weight[p])
            self.forest.add(p, q)


def compare_nodes(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf.a.iat[0], pdf.b.iat[0]
        pdf = pdf.iloc[np.argsort((pdf.node == b).to_numpy(), kind="stable")] if a != b else pdf
        uid, n = pdf.uid.to_numpy(), pdf.n.to_numpy()
        found = Traversal(unit(pdf.vector), n, cosine, int((pdf.node == a).sum()) if a != b else None)
        at = np.flatnonzero(found.total)
        counts = [pd.DataFrame({"a": uid[at], "b": uid[at], "links": found.total[at]})]
        return pd.concat(counts + [pd.DataFrame({"a": uid[p], "b": uid[q], "links": 0}) for p, q in found.forest.edges]).astype("int64")

    return run


@F.pandas_udf(DoubleType())
def apart(x: pd.Series, y: pd.Series) -> pd.Series:
    out, size = np.zeros(len(x)), x.map(len).to_numpy()
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        out[at] = distances(np.einsum("ij,ij->i", unit(x.iloc[at]), unit(y.iloc[at])))
    return pd.Series(out)


def pick_pivots(handful: list, radius: float, wanted: int) -> np.ndarray:
    """Farthest first from the first of the handful: ``wanted`` at least, more while they don't cover it at half the radius."""
    x = unit(handful)
    chosen, near = [0], distances(x @ x[0])
    while len(chosen) < min(FAN, len(x)) and (len(chosen) < max(2, wanted) or near.max() > radius / 2):
        far = int(near.argmax())
        if near[far] <= POINT:  # as near as rounding tells: any of them
            far = len(chosen)
        chosen.append(far)
        near = np.minimum(near, distances(x @ x[far]))
    return np.array(chosen)


VECTORS = "uid long, node string, parent string, vector array<double>, n long, d double"


def split_nodes(vectors: DataFrame, big: DataFrame, level: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``vectors`` (uid, node, vector, n) with the nodes of ``big`` split, as VECTORS, and (node, centre) of the new nodes.

    Pivots come from a node's centre, its farthest vector and a hashed handful of the others, 4 FAN of any node; the
    assignment runs on salted parts of each node.
    """
    count = big.count()
    big = big.withColumn("salts", F.ceil(F.col("size") / SALT_ROWS).cast("int"))
    small = F.broadcast if count <= BROADCAST_ROWS else lambda df: df
    hashed = vectors.join(small(big.select("node", "size", "salts")), "node").withColumn("hash", F.xxhash64("uid", F.lit(level)))
    share = F.col("hash").cast("double") + 2.0**63 < 2.0**64 * 4 * FAN / F.col("size")
    handful = hashed.where(share).groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("hash", "vector"))), 1, 4 * FAN).alias("p"))
    handful = big.join(handful, "node", "left").select(
        "node", "salts", "size", "radius", F.concat(F.array("centre", "far"), F.coalesce(F.transform("p", lambda p: p["vector"]), F.array().cast("array<array<double>>"))).alias("handful")
    )

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                of = [v for v in r.handful if v is not None]
                at = pick_pivots(of, r.radius, -(-2 * r.size // leaf_rows(len(of[0]))))
                rows.append((r.node, r.salts, [of[k] for k in at]))
            yield pd.DataFrame(rows, columns=["node", "salts", "pivots"])

    picked = scratch.save(handful.mapInPandas(choose, "node string, salts int, pivots array<array<double>>"), f"pivots{level}")
    parts = picked.select("node", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "pivots")

    def assign(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"uid": [], "node": [], "parent": [], "vector": [], "n": [], "d": []})
        cos = unit(rows.vector) @ unit(pivots.pivots.iat[0]).T
        best = cos >= cos.max(1, keepdims=True) - 1e-12
        turn = (rows["hash"].to_numpy() // 64) % best.sum(1)  # equally near pivots share
        k = (best.cumsum(1) > turn[:, None]).argmax(1)
        d = distances(cos[np.arange(len(k)), k])
        return pd.DataFrame({"uid": rows.uid, "node": [f"{p}.{i}" for p, i in zip(rows.node, k)], "parent": rows.node, "vector": rows.vector, "n": rows.n, "d": d})

    salted = hashed.withColumn("salt", F.pmod("hash", "salts").cast("int")).select("uid", "node", "vector", "n", "salt", "hash")
    new = salted.groupBy("node", "salt").cogroup(parts.groupBy("node", "salt")).applyInPandas(assign, VECTORS)
    centres = picked.select(F.posexplode("pivots").alias("k", "centre"), F.col("node").alias("parent")).select(F.concat_ws(".", "parent", "k").alias("node"), "centre")
    return new, centres


def leaf_rows(dimensions: int) -> int:
    return max(LEAST_ROWS, LEAF_NUMBERS // dimensions)


KID = "struct<node:string,centre:array<double>,radius:double,total:long,rep:long>"
PAIRS_OUT = "a string, b string, inside boolean, total_a long, total_b long, rep_a long, rep_b long"


def settle_pairs(pairs: DataFrame, kids: DataFrame, reach: float) -> DataFrame:
    """Pairs (a, b) of children of each pair of parents, as PAIRS_OUT: those that link throughout and those in doubt.

    A node has at most FAN children, which come as one array.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for a, b, left, right in zip(f.a, f.b, f.left, f.right):
                d = distances(unit([k["centre"] for k in left]) @ unit([k["centre"] for k in right]).T)
                wide = np.array([k["radius"] for k in left])[:, None] + np.array([k["radius"] for k in right])[None]
                keep = d <= reach + wide + SLACK
                if a == b:
                    np.fill_diagonal(d, 0)
                    keep = np.triu(keep | np.eye(len(d), dtype=bool))
                inside = d + wide <= reach - 2 * SLACK
                for p, q in zip(*(x.tolist() for x in np.nonzero(keep))):
                    x, y = left[p], right[q]
                    out.append((x["node"], y["node"], bool(inside[p, q]), x["total"], y["total"], x["rep"], y["rep"]))
            yield pd.DataFrame(out, columns=["a", "b", "inside", "total_a", "total_b", "rep_a", "rep_b"])

    both = pairs.join(kids.select(F.col("parent").alias("a"), F.col("kids").alias("left")), "a").join(kids.select(F.col("parent").alias("b"), F.col("kids").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInPandas(run, PAIRS_OUT)


def linked_throughout(settled: DataFrame, vectors: DataFrame) -> DataFrame:
    """FOUND rows of the pairs of nodes that link throughout: a count for each vector, and edges that join all of them."""
    inside = settled.where("inside")
    sides = inside.select(F.col("a").alias("node"), F.col("total_b").alias("gain"), F.col("rep_b").alias("partner"), (F.col("a") == F.col("b")).cast("int").alias("own"))
    sides = sides.union(inside.where("a <> b").select("b", "total_a", "rep_a", F.lit(0)))
    sides = sides.groupBy("node").agg(F.sum("gain").alias("gain"), F.min("partner").alias("partner"), F.max("own").alias("own"))
    each = vectors.join(sides, "node").select("uid", "partner", (F.col("gain") - F.col("own") * F.col("n")).alias("links"))
    return (
        each.select(F.col("uid").alias("a"), F.col("uid").alias("b"), "links").union(each.select("uid", "partner", F.lit(0).cast("long")).where("uid <> partner"))
        .union(inside.where("a <> b").select("rep_a", "rep_b", F.lit(0).cast("long")))
    )


def leaf_pairs(vectors: DataFrame, cosine: float, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """Vectors by their last node, nodes, the pairs of small nodes in doubt, and FOUND rows of what bounds have settled."""
    reach, found, level = float(np.sqrt(max(0.0, 2 - 2 * cosine))), [], 0
    about = (F.count("*").alias("size"), F.sum("n").alias("total"), F.min("uid").alias("rep"))
    nodes = vectors.groupBy("node").agg(*about, F.max_by("vector", "uid").alias("centre")).withColumns({"far": F.lit(None).cast("array<double>"), "radius": F.lit(2.0)})
    nodes = scratch.save(nodes, "nodes0")
    pairs = scratch.save(nodes.select(F.col("node").alias("a"), F.col("node").alias("b")), "pairs0")
    large = F.col("size") > F.greatest(F.lit(LEAST_ROWS), F.floor(F.lit(LEAF_NUMBERS) / F.size("centre")))
    while True:
        doubted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        big = scratch.save(nodes.where(large).join(doubted, "node", "left_semi"), f"big{level}")
        if big.isEmpty():
            return vectors, nodes, pairs, found
        level += 1
        if level > MOST_LEVELS:
            raise RuntimeError(f"nodes are still large after {MOST_LEVELS} levels")
        new, centres = split_nodes(vectors, big.select("node", "size", "radius", "centre", "far"), level, scratch)
        new = scratch.save(new, f"split{level}")
        rest = vectors.join(F.broadcast(big.select("node")) if big.count() <= BROADCAST_ROWS else big.select("node"), "node", "left_anti")
        vectors = scratch.save(new.select("uid", "node", "vector", "n").union(rest.select("uid", "node", "vector", "n")), f"vectors{level}")
        made = new.groupBy("node").agg(F.first("parent").alias("parent"), *about, F.max_by("vector", "d").alias("far"), (F.max("d") + SLACK).alias("radius")).join(centres, "node")
        kept = nodes.join(big.select("node"), "node", "left_anti").withColumn("parent", F.col("node"))
        cols = ("node", "parent", "size", "total", "rep", "centre", "far", "radius")
        nodes = scratch.save(made.select(*cols).union(kept.select(*cols)), f"nodes{level}")
        kids = nodes.groupBy("parent").agg(F.collect_list(F.struct("node", "centre", "radius", "total", "rep").cast(KID)).alias("kids"))
        settled = scratch.save(settle_pairs(pairs, kids, reach), f"settled{level}")
        found.append(linked_throughout(settled, vectors))
        pairs = scratch.save(settled.where("NOT inside").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), f"pairs{level}")


def link(embeddings: DataFrame, cosine: float = COSINE, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept from (vec_id, embedding, label)."""
    scratch = scratch or Scratch(embeddings.sparkSession, "cover-tree")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("valid", F.coalesce(F.col("label").isNotNull() & finite, F.lit(False)))
    rows = rows.withColumns({"k1": F.xxhash64(F.lit(1), "label", "vector"), "k2": F.xxhash64(F.lit(2), "label", "vector")})
    classes = rows.where("valid").groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("label").alias("label"), F.max("vector").alias("vector"))
    classes = scratch.save(classes.withColumn("uid", F.monotonically_increasing_id()), "classes")
    # unlike lengths are unlike roots
    vectors = classes.select("uid", F.concat_ws("/", F.size("vector"), "label").alias("node"), "vector", "n")
    vectors, nodes, pairs, settled = leaf_pairs(vectors, cosine, scratch)

    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    own = vectors.join(pairs.where("a = b").select(F.col("a").alias("node"), "a", "b"), "node").select("a", "b", "node", "uid", "vector", "n")
    cross = pairs.where("a <> b")
    sides = cross.select(F.col("a").alias("node"), "a", "b", F.col("b").alias("o")).union(cross.select(F.col("b").alias("node"), "a", "b", F.col("a").alias("o")))
    sides = sides.join(nodes.select(F.col("node").alias("o"), "centre", "radius"), "o")
    near = vectors.join(sides, "node").where(apart("vector", "centre") <= reach + F.col("radius"))
    work = near.select("a", "b", "node", "uid", "vector", "n").union(own)
    found = work.groupBy("a", "b").applyInPandas(compare_nodes(cosine), "a long, b long, links long")
    for more in settled:
        found = found.union(more)
    found = scratch.save(found, "found")

    per = found.where("a = b").groupBy(F.col("a").alias("uid")).agg(F.sum("links").alias("others"))
    comp = components(scratch, found.where("a <> b").select("a", "b"))
    each = classes.join(per, "uid", "left").join(comp, classes["uid"] == comp["node"], "left")
    each = each.select("k1", "k2", "n", "first", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "uid").alias("comp"))
    least = each.groupBy("comp").agg(F.min("first").alias("component_id"))
    each = each.join(least, "comp").select("k1", "k2", (F.col("n") - 1 + F.col("others")).alias("n_links"), "component_id", F.lit(True).alias("ok"))
    out = rows.select("vec_id", "valid", "k1", "k2").join(each, ["k1", "k2"], "left")
    ok = F.col("valid") & F.col("ok")
    out = out.select("vec_id", F.when(ok, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(ok, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
