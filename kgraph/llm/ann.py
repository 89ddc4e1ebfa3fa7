"""Approximate nearest neighbours over learned partitions.

On a bounded sample, a neighbour graph is built and cut into balanced parts, whose number grows with the square root of the
rows; a small classifier learns, from a vector, how its neighbours spread over the parts.  Every row is indexed under its
likeliest part; a query goes to its likeliest parts, until they hold as much of its probability as the sample needs for the
wanted recall, and all rows there are reranked by exact distance.  So a query that the classifier is sure of visits few
parts, and one in data without structure many.  Vectors of another length have an index of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class AnnParams:
    #: Nearest rows per query.
    k: int = 10
    #: The partitions are learned on at most so many rows, those with the smallest hash of vec_id.
    max_sample: int = 32768
    #: Parts: the square root of the number of rows, but at most one for every part_rows rows of the sample.
    part_rows: int = 32
    #: Neighbours in the graph.
    neighbours: int = 10
    hidden: int = 128
    epochs: int = 40
    batch: int = 128
    rate: float = 3e-3
    #: Recall that the probed parts must reach on held-back rows of the sample.
    recall: float = 0.95
    #: Rows of a part that one task holds against queries.
    block: int = 8192
    seed: int = 5


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k nearest other rows, for each row."""
    square = (x * x).sum(axis=1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        d = square - 2 * x[at : at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Part of each node; sizes differ by at most one per cut.  Recursive bisection: a smooth function on the graph is cut
    at its quantile, then pairs of nodes swap sides while that removes edges."""
    n, k = graph.shape
    rows, cols = np.repeat(np.arange(n), k), graph.ravel()
    u, v = np.concatenate([rows, cols]), np.concatenate([cols, rows])
    part = np.zeros(n, np.int64)

    def cut(nodes: np.ndarray, first: int, count: int) -> None:
        if count == 1 or len(nodes) < 2:
            part[nodes] = first
            return
        local = np.full(n, -1)
        local[nodes] = np.arange(len(nodes))
        inside = (local[u] >= 0) & (local[v] >= 0)
        a, b = local[u[inside]], local[v[inside]]
        degree = np.bincount(a, minlength=len(nodes)) + 1.0
        f = rng.standard_normal(len(nodes))
        for _ in range(60):
            f = (f + np.bincount(a, weights=f[b], minlength=len(nodes))) / degree
            f -= (f * degree).sum() / degree.sum()
            f /= np.abs(f).max() + 1e-12
        low = count // 2
        size = round(len(nodes) * low / count)
        side = np.ones(len(nodes), bool)
        side[np.argsort(f, kind="stable")[:size]] = False
        for _ in range(20):
            # edges gained by changing sides
            cross = side[a] != side[b]
            gain = np.bincount(a, weights=np.where(cross, 1.0, -1.0), minlength=len(nodes))
            ones, zeros = np.flatnonzero(side), np.flatnonzero(~side)
            ones, zeros = ones[np.argsort(-gain[ones], kind="stable")], zeros[np.argsort(-gain[zeros], kind="stable")]
            m = min(len(ones), len(zeros), max(1, len(nodes) // 50))
            good = gain[ones[:m]] + gain[zeros[:m]] > 0
            if not good.any():
                break
            before, old = cross.sum(), side.copy()
            side[ones[:m][good]], side[zeros[:m][good]] = False, True
            if (side[a] != side[b]).sum() >= before:
                side = old
                break
        cut(nodes[~side], first, low)
        cut(nodes[side], first + low, count - low)

    cut(np.arange(n), 0, parts)
    return part


class Router:
    """Two layers: probabilities of the parts, given a vector."""

    def __init__(self, x: np.ndarray, target: np.ndarray, params: AnnParams):
        rng = np.random.default_rng(params.seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        sizes = [x.shape[1], params.hidden, target.shape[1]]
        self.w = [rng.standard_normal((a, b)) * np.sqrt(2 / a) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]
        moments = [[np.zeros_like(t), np.zeros_like(t)] for t in self.w + self.b]
        z, step = (x - self.mean) / self.scale, 0
        total = params.epochs * -(-len(x) // params.batch)
        for _ in range(params.epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), params.batch):
                pick = order[at : at + params.batch]
                h = np.maximum(z[pick] @ self.w[0] + self.b[0], 0)
                d = (self._softmax(h @ self.w[1] + self.b[1]) - target[pick]) / len(pick)
                dh = (d @ self.w[1].T) * (h > 0)
                grads = [z[pick].T @ dh, h.T @ d, dh.sum(axis=0), d.sum(axis=0)]
                step += 1
                rate = params.rate * (1 - (step - 1) / total)
                for t, g, m in zip(self.w + self.b, grads, moments):
                    m[0] += 0.1 * (g - m[0])
                    m[1] += 0.001 * (g * g - m[1])
                    t -= rate * (m[0] / (1 - 0.9**step) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8) + 1e-4 * t)

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts by falling probability, and what the parts before each have together.  Rounded, so that equal vectors rank
        alike whatever they are computed with."""
        h = np.maximum(np.clip((x - self.mean) / self.scale, -50, 50) @ self.w[0] + self.b[0], 0)
        p = np.round(self._softmax(h @ self.w[1] + self.b[1]), 9)
        order = np.argsort(-p, axis=1, kind="stable")
        p = np.take_along_axis(p, order, axis=1)
        return order, np.round(np.cumsum(p, axis=1) - p, 9)


@dataclass
class Index:
    """Of the vectors of one length.  unit: what components are divided by before they are routed."""

    router: Router | None = None
    parts: int = 1
    mass: float = 1.0
    unit: float = 1.0

    def home(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x), np.int64) if self.router is None else self.router.ranked(x / self.unit)[0][:, 0]

    def probed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and the parts that each visits: those before which less than mass lies."""
        if self.router is None:
            return np.arange(len(x)), np.zeros(len(x), np.int64)
        order, before = self.router.ranked(x / self.unit)
        row, place = np.nonzero(before < self.mass)
        return row, order[row, place]


def learn(x: np.ndarray, rows: int, params: AnnParams = AnnParams()) -> Index:
    """x: the sample's vectors, of one length.  rows: how many vectors the index is for."""
    n = len(x)
    parts = min(round(max(rows, n) ** 0.5), n // params.part_rows)
    if parts < 2:
        return Index()
    size = float(np.abs(x).max())
    unit = 1.0 if 1e-100 < size < 1e100 else size
    x = x / unit
    rng = np.random.default_rng(params.seed)
    graph = nearest(x, min(params.neighbours, n - 1))
    part = balanced_parts(graph, parts, rng)
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1.0)
    target[np.arange(n), part] += 1
    target /= target.sum(axis=1, keepdims=True)
    # the mass to probe is chosen on rows that the router was not trained on
    test = rng.permutation(n)[: max(32, n // 5)]
    train = np.setdiff1d(np.arange(n), test)
    trial = Router(x[train], target[train], params)
    home = np.concatenate([trial.ranked(x[at : at + 4096])[0][:, 0] for at in range(0, n, 4096)])
    need = []
    for at in range(0, len(test), 4096):
        some = test[at : at + 4096]
        order, before = trial.ranked(x[some])
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(parts)[None, :], axis=1)
        need.append(np.take_along_axis(before, np.take_along_axis(place, home[graph[some]], axis=1), axis=1).ravel())
    mass = float(np.quantile(np.concatenate(need), params.recall, method="higher")) + 1e-9
    return Index(Router(x, target, params), parts, mass, unit)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and vec (doubles) of the rows whose vector is there, finite and not zero."""
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists("vec", lambda v: v != 0)
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    return kept.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(some, F.lit(False)))


FOUND = "query_id long, vec_id long, score double"


#: Components beyond this have squares that may not fit.
WIDE = 1e100


def _distances(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances; differences whose squares do not fit are scaled first."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        d = c - q
        out = np.sqrt((d * d).sum(axis=1))
        most = np.abs(d).max(axis=1)
        for j in np.flatnonzero((most > 1e150) | ((most < 1e-150) & (most > 0))):
            m = np.abs(c[j] / 2 - q / 2).max()
            h = (c[j] / 2 - q / 2) / m if m > 0 else d[j] / most[j]
            out[j] = np.sqrt((h * h).sum()) * m * 2 if m > 0 else np.sqrt((h * h).sum()) * most[j]
    return out


def _rerank(k: int):
    def work(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(queries) and len(rows):
            q, c = np.stack(queries["vec"]), np.stack(rows["vec"])
            ids, own = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy()
            # rows too wide, or too small, for squares are held against every query in full
            wild = lambda x: (np.abs(x).max(axis=1) > WIDE) | (np.abs(x).max(axis=1) < 1 / WIDE)
            odd, odd_query = wild(c), wild(q)
            tame = np.where(odd[:, None], 0.0, c)
            square = (tame * tame).sum(axis=1)
            for at in range(0, len(q), 256):
                part = np.where(odd_query[at : at + 256, None], 0.0, q[at : at + 256])
                rough = square - 2 * part @ tame.T + (part * part).sum(axis=1)[:, None]
                rough[:, odd] = np.inf
                other = own[at : at + 256, None] != ids[None, :]
                rough[~other] = np.inf
                kth = np.partition(rough, min(k, len(c)) - 1, axis=1)[:, min(k, len(c)) - 1]
                # rounding may misplace rows by far less than this
                reach = kth + 1e-9 * (1 + np.abs(kth) + square.max())
                for j in range(len(part)):
                    if odd_query[at + j] or not np.isfinite(reach[j]):
                        near = np.flatnonzero(other[j])
                    else:
                        near = np.flatnonzero(other[j] & ((rough[j] <= reach[j]) | odd))
                    exact = _distances(c[near], q[at + j])
                    best = np.lexsort((ids[near], exact))[:k]
                    out.append(pd.DataFrame({"query_id": own[at + j], "vec_id": ids[near[best]], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return work


#: Numbers of parts of one length; parts of different lengths never share one.
PARTS = 1 << 20


def learned(rows: DataFrame, params: AnnParams = AnnParams()) -> dict[int, Index]:
    """rows: vec_id, vec.  An index for each length of vectors that the sample holds."""
    n = rows.count()
    most = min(params.max_sample, params.part_rows * max(2, round(n**0.5)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(most).toPandas()
    lengths = sample["vec"].map(len).to_numpy()
    return {int(k): learn(np.stack(sample["vec"][lengths == k]), round(n * float((lengths == k).mean())), params) for k in np.unique(lengths)}


def _route(index: dict[int, Index], probe: bool):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["vec"].map(len).to_numpy()
            for k in np.unique(lengths):
                some = batch[lengths == k]
                for at in range(0, len(some), 4096):
                    few = some.iloc[at : at + 4096]
                    x, own = np.stack(few["vec"]), index.get(int(k), Index())
                    row, part = own.probed(x) if probe else (np.arange(len(x)), own.home(x))
                    yield few.iloc[row].assign(part=int(k) * PARTS + part)

    return work


def search(rows: DataFrame, queries: DataFrame, params: AnnParams = AnnParams()) -> DataFrame:
    """rows, queries: vec_id, embedding.  Returns query_id, rank (from 1), vec_id, score: each query's k nearest rows found
    but rows of its own vec_id, by Euclidean distance in double precision, ties to the smaller vec_id.

    Vectors that are null, zero or hold null or non-finite components take no part; vectors of unlike length have no
    distance.  A query with fewer than k rows in its parts is held against all rows of its length, in blocks.  Queries that
    share a vec_id are one, that of the smallest vector; rows that repeat count each.  Empty tables give an empty result.
    Other columns are ignored.

    A part's rows are dealt into blocks by the hash of vec_id and vector, so that a part of any size, one of many equal
    vectors, say, is never in one task; a query visits every block of its parts.
    """
    spark = rows.sparkSession
    every = usable(rows)
    wanted = usable(queries).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    index = learned(every, params)
    indexed = every.mapInPandas(_route(index, False), "vec_id long, vec array<double>, part long")
    asked = wanted.mapInPandas(_route(index, True), "vec_id long, vec array<double>, part long")
    sizes = indexed.groupBy("part").agg(F.ceil(F.count("*") / params.block).cast("int").alias("blocks"), F.count("*").alias("rows")).collect()
    plan = F.broadcast(spark.createDataFrame([(r.part, r.blocks) for r in sizes], "part long, blocks int"))  # a row per part
    deal = lambda blocks: F.pmod(F.xxhash64("vec_id", "vec"), blocks).cast("int").alias("block")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")
    left = asked.join(plan, "part").select(F.col("vec_id").alias("query_id"), "vec", "part", each(F.col("blocks")))
    right = indexed.join(plan, "part").select("vec_id", "vec", "part", deal(F.col("blocks")))
    near = lambda left, right: left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(_rerank(params.k), FOUND)
    found = materialize(near(left, right), "found")
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    ids = wanted.select(F.col("vec_id").alias("query_id"))
    short = materialize(ids.join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < params.k).select("query_id"), "short")
    if not short.isEmpty():
        blocks = F.lit(max(1, -(-sum(r.rows for r in sizes) // params.block)))
        length = F.size("vec").cast("long").alias("part")
        left = wanted.select(F.col("vec_id").alias("query_id"), "vec").join(short, "query_id", "left_semi").select("query_id", "vec", length, each(blocks))
        right = every.select("vec_id", "vec", length, deal(blocks))
        found = found.join(short, "query_id", "left_anti").unionByName(near(left, right))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= params.k).select("query_id", "rank", "vec_id", "score")


def visited(rows: DataFrame, queries: DataFrame, params: AnnParams = AnnParams()) -> float:
    """The share of all rows that a query is held against, on average."""
    every, asked = usable(rows), usable(queries)
    index = learned(every, params)
    sizes = every.mapInPandas(_route(index, False), "vec_id long, vec array<double>, part long").groupBy("part").agg(F.count("*").alias("n"))
    probed = asked.mapInPandas(_route(index, True), "vec_id long, vec array<double>, part long").groupBy("part").agg(F.count("*").alias("q"))
    held = sizes.join(probed, "part").agg(F.sum(F.col("n") * F.col("q"))).first()[0] or 0
    return held / max(1, every.count() * asked.count())
