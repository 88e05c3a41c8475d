"""Near duplicates among vectors: robust-pruned flat graphs on overlapping shards, range search, verification.

Vectors are linked if their labels are equal and their cosine, in double precision, is at least 0.93.

1. *Copies* (equal label and components) become one point with a weight.
2. *Shards.* Centroids of each label are fitted on a bounded sample, one for each `SHARD` points; every point joins the nearest one (its home) and all
   others that are within `MARGIN` of it in cosine, so shards overlap. A shard of more than `SLICE` points is cut into slices by hash, each with a graph of
   its own, and its queries go to all of its slices, in blocks: no task holds more than two slices, whatever the data.
3. *Graph.* In each slice the candidates of a point are its nearest ones and some drawn by hash; robust pruning drops a candidate that is nearer to a chosen
   neighbour than to the point, by a factor `ALPHA`. Reverse edges are added.
4. *Union.* Adjacency lists of a point from all shards are put together, and a slice's graph has all those edges between its points.
5. *Search.* For every point of the home shard, greedy search from the slice's medoid with a beam; once it settles, every point in range is expanded in turn,
   until nothing in range is left to expand. Points in range are counted; only a spanning forest of them leaves the task, so groups of near copies cost rows in
   proportion to their size. Distances are exact cosines of the vectors as stored, so nothing below the threshold is ever linked. A link
   counts on both sides: between two queries of a task it is made mutual, and a point that is found where it isn't at home, by a query that its own home
   shard doesn't hold, gets the link added there, as its own search can't find it. A point that any link was found for has one at least.
6. *Audit.* Links of a bounded sample of points are counted by brute force over all rows, in blocks: `AUDIT` points each of those that have no, few or many links by
   the search. If the least recall of the three is below `RECALL`, all is done again with a wider margin and beam; after `TRIES` that is an error.

Defined cases: vectors null, empty, zero, or with null or non-finite components, and those with a null label, link with nothing; neither do vectors of different lengths.
Rows with one id are vectors of their own with the same id: they count as links and share the id's component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, stored
from .text_arrays import U64, mix

THRESHOLD = 0.93
SHARD, SLICE, BLOCK = 1024, 4096, 2048
MARGIN, BEAM, DEGREE, CANDIDATES, ALPHA = 0.1, 24, 24, 64, 1.2
AT_ONCE = 4  # points that a search expands in one step
SAMPLE, MOST_CENTROIDS, LLOYD = 20_000, 4096, 6
AUDIT, FEW, RECALL, TRIES = 64, 10, 0.9, 3


def unit(rows: list) -> np.ndarray:
    v = np.array(rows, np.float64)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def points_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, dim, k1, k2, v): comparable vectors have v, others null."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(label_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    scale = F.array_max(F.transform(v, F.abs))  # so that squares neither vanish nor overflow
    scaled = F.when(F.coalesce(fine, F.lit(False)), F.transform(v, lambda x: x / scale))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), scaled.alias("v"))
    return rows.select("vec_id", "label", F.size("v").alias("dim"), F.xxhash64("label", "v").alias("k1"), F.xxhash64(F.lit(1), "v", "label").alias("k2"), "v")


def centroids_of(points: DataFrame, shard: int) -> dict[tuple[str, int], np.ndarray]:
    """Centroids of each (label, length), fitted on a sample of at most about `SAMPLE` points; `MOST_CENTROIDS` in all."""
    counts = {(r.label, r.dim): r.n for r in points.groupBy("label", "dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(MOST_CENTROIDS).collect()}
    total = sum(counts.values())
    share = min(1.0, SAMPLE / max(1, total))
    low = F.lit((1 << 63) - 1 if share == 1 else int(-(1 << 63) + share * ((1 << 64) - 1)))
    grouped: dict[tuple[str, int], list] = {}
    for r in points.filter(F.xxhash64("rep", F.lit(11)) <= low).orderBy(F.xxhash64("rep")).select("label", "dim", "v").limit(2 * SAMPLE).collect():
        grouped.setdefault((r.label, r.dim), []).append(r.v)
    out = {}
    for key, n in counts.items():
        if key not in grouped:
            continue
        sample = unit(grouped[key])
        k = max(1, min(len(sample), -(-n // max(shard, -(-total // MOST_CENTROIDS)))))
        centres = sample[:k].copy()
        for _ in range(LLOYD if k > 1 else 0):
            nearest = (sample @ centres.T).argmax(1)
            for j in range(k):
                if (own := sample[nearest == j]).size:
                    centres[j] = own.mean(0)
            centres /= np.maximum(np.sqrt((centres * centres).sum(1, keepdims=True)), 1e-12)
        out[key] = centres
    return out


MEMBER = "shard string, home boolean, rep long, weight long, v array<double>, at int, also array<int>"
FIELDS = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.list_(pa.int32())]


def assigned(centroids, margin: float):
    """Each point in its home shard and in those whose centroid is nearly as near; `at` is its home's number, `also` are those of all its shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = centroids.value
        for batch in batches:
            rep, weight, label, dim, v = (batch.column(i).to_pylist() for i in range(5))
            out: list[list] = [[] for _ in FIELDS]
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(label, dim, strict=True)):
                groups.setdefault(key, []).append(i)
            for key, rows in groups.items():
                # a label without centroids has few points, none of them in the sample: one shard
                near = unit([v[i] for i in rows]) @ tables[key].T if key in tables else np.zeros((len(rows), 1))
                best = near.argmax(1)
                inside = near >= near.max(1, keepdims=True) - margin
                also = [np.flatnonzero(row).tolist() for row in inside]
                for r, s in zip(*np.nonzero(inside), strict=True):
                    for column, value in zip(out, (f"{int(s)}|{key[1]}|{key[0]}", bool(s == best[r]), rep[rows[r]], weight[rows[r]], v[rows[r]], int(best[r]), also[r]), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, FIELDS, strict=True)], [x.split()[0] for x in MEMBER.split(", ")])

    return run


def pruned(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of many points at once: (n, degree) neighbours, -1 where there are fewer. candidates: (n, c), -1 for none."""
    n, c = candidates.shape
    vectors = x[candidates]
    near = np.where(candidates >= 0, np.matmul(vectors, points[:, :, None])[:, :, 0], -np.inf)
    away = 2 - 2 * near  # squared distance
    between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    out, alive, rows = np.full((n, degree), -1), np.isfinite(near), np.arange(n)
    for k in range(min(degree, c)):
        pick = np.where(alive, near, -np.inf).argmax(1)
        some = alive[rows, pick]
        if not some.any():
            break
        out[:, k] = np.where(some, candidates[rows, pick], -1)
        alive &= (alpha * alpha * between[rows, pick] > away) & some[:, None]
        alive[rows, pick] = False
    return out


def built(frame: pd.DataFrame) -> pd.DataFrame:
    """The pruned graph of one slice, with reverse edges: (rep, neighbours)."""
    ids = frame.rep.to_numpy(np.int64)
    x = unit(frame.v.tolist())
    n = len(ids)
    if n == 1:
        return pd.DataFrame({"rep": ids, "neighbours": [[]]})
    near = min(CANDIDATES, n - 1)
    drawn = (mix(ids.view(U64)[:, None] * U64(31) + np.arange(16, dtype=U64)) % U64(n)).astype(np.int64)
    out, step = [], max(8, 2_000_000 // (80 * (80 + x.shape[1])))
    for a in range(0, n, step):
        own = np.arange(a, min(n, a + step))
        dots = x[own] @ x.T
        dots[np.arange(len(own)), own] = -np.inf
        candidates = np.hstack([np.argpartition(-dots, near - 1, axis=1)[:, :near], np.where(drawn[own] == own[:, None], -1, drawn[own])])
        out.append(pruned(x, x[own], candidates))
    chosen = np.concatenate(out)
    src, k = np.nonzero(chosen >= 0)
    dst = chosen[src, k]
    both = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    cuts = np.searchsorted(both // n, np.arange(n + 1))
    return pd.DataFrame({"rep": ids, "neighbours": [ids[both[a:b] % n].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]})


def adjacency_matrix(ids: np.ndarray, lists: list) -> np.ndarray:
    """Neighbours as rows of positions, -1 for none; ids must be sorted."""
    flat = np.array([b for row in lists for b in row], np.int64)
    src = np.repeat(np.arange(len(ids)), [len(row) for row in lists])
    at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
    inside = ids[at] == flat
    src, at = src[inside], at[inside]
    count = np.bincount(src, minlength=len(ids))
    out = np.full((len(ids), max(1, count.max(initial=0))), -1)
    out[src, np.arange(len(src)) - np.repeat(np.cumsum(count) - count, count)] = at
    return out


def range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, threshold: float, beam: int) -> np.ndarray:
    """For each query, whether each point is in range: beam search from the medoid, then every point in range is expanded."""
    n, q = len(x), len(queries)
    medoid = int((x @ x.mean(0)).argmax())
    sims = np.full((q, n), -np.inf)  # of the points met so far
    expanded = np.zeros((q, n), bool)
    sims[:, medoid] = queries @ x[medoid]
    active = np.arange(q)
    some, width = min(AT_ONCE, n), min(beam, n) - 1
    while len(active):
        met = sims[active]
        # the beam: a point counts while it is among the `beam` nearest met so far, or in range
        edge = np.minimum(-np.partition(-met, width, axis=1)[:, width], threshold)
        met[expanded[active]] = -np.inf
        pick = np.argpartition(-met, some - 1, axis=1)[:, :some]
        value = np.take_along_axis(met, pick, 1)
        row, k = np.nonzero(np.isfinite(value) & (value >= edge[:, None]))
        point, who = pick[row, k], active[row]
        expanded[who, point] = True
        active = active[np.unique(row)]
        around = graph[point]
        row, k = np.nonzero(around >= 0)
        pairs = np.unique(who[row] * n + around[row, k])
        who, point = pairs // n, pairs % n
        new = np.isneginf(sims[who, point])
        who, point = who[new], point[new]
        sims[who, point] = np.einsum("ij,ij->i", queries[who], x[point])
    return sims >= threshold


def forest(links: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each point the smallest position it is connected with; links: query by point, own: the position of each query."""
    root = np.arange(links.shape[1])
    q, p = np.nonzero(links)
    a = own[q]
    while True:
        low = np.minimum(root[a], root[p])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, p, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


FOUND = "rep long, n long, other long"


def searched(threshold: float, beam: int):
    """For one slice and block of queries: (rep, weight of points in range, null), parts that add up, and forest edges (rep, null, other)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep")
        index = frame[~frame["query"]].drop_duplicates("rep")
        asked = frame[frame["query"]]
        if index.empty or asked.empty:
            return pd.DataFrame({"rep": [], "n": [], "other": []}).astype({"rep": "int64", "n": "Int64", "other": "Int64"})
        ids, weight = index.rep.to_numpy(np.int64), index.weight.to_numpy(np.int64)
        x, graph = unit(index.v.tolist()), adjacency_matrix(ids, index.neighbours.tolist())
        rows, who = unit(asked.v.tolist()), asked.rep.to_numpy(np.int64)
        in_range = np.concatenate([range_search(x, graph, rows[a : a + 256], threshold, beam) for a in range(0, len(rows), 256)])
        in_range &= ids[None, :] != who[:, None]
        # the queries stand behind the points, so that the forest joins both
        own = np.minimum(np.searchsorted(ids, who), len(ids) - 1)
        present = ids[own] == who
        mutual = np.flatnonzero(present)
        square = in_range[np.ix_(mutual, own[mutual])]
        in_range[np.ix_(mutual, own[mutual])] = square | square.T
        # for a point that is at home elsewhere, the queries that its home shard doesn't hold
        home = index["at"].to_numpy(np.int64)
        there = np.zeros((len(who), int(home.max()) + 1), bool)
        for i, shards in enumerate(asked.also):
            there[i, [k for k in shards if k < there.shape[1]]] = True
        unseen = in_range & ~there[:, home]
        extra = unseen.T @ asked.weight.to_numpy(np.int64)
        more = np.flatnonzero(extra)
        met = np.flatnonzero(in_range.any(0))
        own = np.where(present, own, len(ids) + np.arange(len(who)))
        every = np.concatenate([ids, who])
        root = forest(np.hstack([in_range, np.zeros((len(who), len(who)), bool)]), own)
        tree = np.flatnonzero(root != np.arange(len(root)))
        n = (in_range * weight).sum(1)
        # a point that was met has a link, whether its own search finds it or not: parts of 0 say so
        return pd.DataFrame(
            {
                "rep": np.concatenate([who, ids[more], ids[met], every[tree]]),
                "n": pd.array([*n.tolist(), *extra[more].tolist(), *[0] * len(met), *[None] * len(tree)], "Int64"),
                "other": pd.array([*[None] * (len(who) + len(more)), *ids[met].tolist(), *every[root[tree]].tolist()], "Int64"),
            }
        )

    return run


def searched_links(points: DataFrame, threshold: float, margin: float, beam: int) -> DataFrame:
    """(rep, n, other) as `searched` gives it, of points (rep, weight, label, dim, v)."""
    spark = points.sparkSession
    held = spark.sparkContext.broadcast(centroids_of(points, SHARD))
    members = stored(points.select("rep", "weight", "label", "dim", "v").mapInArrow(assigned(held, margin), MEMBER))
    slices = members.groupBy("shard").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"), F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).cast("int").alias("blocks"))
    cut = members.join(slices, "shard").withColumn("slice", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int"))
    cut = stored(cut)
    lists = cut.select("shard", "slice", "rep", "v").groupBy("shard", "slice").applyInPandas(built, "rep long, neighbours array<long>")
    union = stored(lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours")))  # a point is in a few shards, a list is short
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1))
    none = F.array().cast("array<long>")
    columns = ["rep", "weight", "v", "at", "also"]
    index = cut.join(union, "rep").withColumn("block", blocks("blocks")).select("shard", "slice", "block", F.lit(False).alias("query"), *columns, "neighbours")
    asked = cut.filter("home").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int")).drop("slice").withColumn("slice", blocks("slices"))
    asked = asked.select("shard", "slice", "block", F.lit(True).alias("query"), *columns, none.alias("neighbours"))
    return index.unionByName(asked).groupBy("shard", "slice", "block").applyInPandas(searched(threshold, beam), FOUND)


def counted(found: DataFrame) -> DataFrame:
    """(rep, n): the parts of each point's links added up; a point that was met has one at least."""
    parts = found.filter("n is not null").groupBy("rep").agg(F.sum("n").alias("n"), F.max(F.col("other").isNotNull().cast("int")).alias("met"))
    return parts.select("rep", F.greatest("n", "met").cast("long").alias("n"))


def audited(points: DataFrame, counts: DataFrame, threshold: float, size: int = AUDIT) -> float:
    """The share of links that `counts` (rep, n) has of those counted by brute force over all points in blocks: the least of three
    samples of at most `size` points each, with no, fewer than `FEW` and more links by `counts`."""
    level = F.when(F.col("n") == 0, 0).when(F.col("n") < FEW, 1).otherwise(2)
    known = points.select("rep", "label", "v").join(counts, "rep", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = [r for k in range(3) for r in known.filter(level == k).orderBy(F.xxhash64("rep", F.lit(3))).limit(size).collect()]
    if not rows:
        return 1.0
    sample = points.sparkSession.sparkContext.broadcast([(r.rep, r.label, r.v) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            rep, weight, label, v = (batch.column(i).to_pylist() for i in range(4))
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(label, map(len, v), strict=True)):
                groups.setdefault(key, []).append(i)
            for a, l, w in sample.value:
                if (l, len(w)) in groups:
                    at = [i for i in groups[l, len(w)] if rep[i] != a]
                    if at:
                        total[a] = total.get(a, 0) + int((np.array([weight[i] for i in at]) * (unit([v[i] for i in at]) @ unit([w])[0] >= threshold)).sum())
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["rep", "n"])

    exact = {r.rep: r.n for r in points.select("rep", "weight", "label", "v").mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n")).collect()}
    found = {r.rep: r.n for r in rows}
    shares = []
    for of_level in ((lambda n: n == 0), (lambda n: 0 < n < FEW), (lambda n: n >= FEW)):
        own = {rep: n for rep, n in found.items() if of_level(n)}
        wanted = sum(exact.get(rep, 0) for rep in own)
        # points without links by the search are judged with the few that should have some
        if wanted:
            shares.append(sum(min(n, exact.get(rep, 0)) for rep, n in own.items()) / wanted if any(own.values()) else 1 - sum(exact.get(rep, 0) > 0 for rep in own) / len(own))
    return min(shares, default=1.0)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    rows = stored(points_of(vectors, id_col, vector_col, label_col))
    good = rows.filter("v is not null")
    # null ids can't be told apart from each other, so points are named by their content, and by their smallest id in the end
    points = stored(good.groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("v").alias("v")).withColumn("rep", F.col("k1")))
    margin, beam = MARGIN, BEAM
    for turn in range(TRIES):
        found = stored(searched_links(points, threshold, margin, beam))
        counts = stored(counted(found))
        if audited(points, counts, threshold) >= RECALL:
            break
        margin, beam = 3 * margin, 2 * beam
        if turn == TRIES - 1:
            raise RuntimeError(f"recall stays below {RECALL}")
    names = points.select(F.col("rep").alias("r"), "vec_id")
    edges = found.filter("n is null").select("rep", "other").distinct()
    named = edges.join(names, edges.rep == names.r).select(F.col("vec_id").alias("a"), "other").join(names, F.col("other") == F.col("r")).select("a", F.col("vec_id").alias("b"))
    copies = good.join(points.select("k1", "k2", F.col("vec_id").alias("b")), ["k1", "k2"]).select(F.col("vec_id").alias("a"), "b")
    roots = components(named.unionByName(copies))
    linked = points.join(counts, "rep", "left").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.join(linked, (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")) & F.col("v").isNotNull(), "left").join(roots, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
