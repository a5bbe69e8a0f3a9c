"""Embedding, reduction and density clustering of distinct sentences, with summaries and sweeps.

The models are stand-ins that need no download: hashed words for the embedding, principal components smoothed over
nearest neighbours for the reduction, and hierarchical density clustering. Each can be replaced by a function.

Density clustering is exact and takes any number of points: they are numbered and cut into blocks, each pair of
blocks is one task that finds nearest neighbours, then a spanning tree. The union of the pairs' trees holds the tree of all
points; it is thinned in rounds, so that a task never holds more than a few trees. Only the last step, from the one tree
of n - 1 edges (24 bytes each) to clusters, runs in one task a group. Distances are counted between all points, so the
work grows with their square.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tiesmith.functions.claims import run_id
from tiesmith.session import durable, parallelism

#: Points in one block; a task compares two of them. Trees that are thinned together.
BLOCK_POINTS, TREES = 4096, 8
DIMS = 128


def hashed_words(text: str, dims: int = DIMS) -> np.ndarray:
    """A unit vector of signed hashed words."""
    out = np.zeros(dims, np.float32)
    for w in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        out[h % dims] += 1 if h >> 63 else -1
    n = np.linalg.norm(out)
    return out / n if n else out


def hashed_batch(texts: Sequence[str], dims: int = DIMS) -> list[np.ndarray]:
    """`hashed_words` of each text; a word is hashed once a batch."""
    known: dict[str, tuple[int, int]] = {}
    out = np.zeros((len(texts), dims), np.float32)
    for row, text in enumerate(texts):
        for w in re.findall(r"\w+", text.lower()):
            if w not in known:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                known[w] = h % dims, 1 if h >> 63 else -1
            at, sign = known[w]
            out[row, at] += sign
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return list(out / np.where(norms > 0, norms, 1))


def embed(texts: Column, embedder: Callable[[str], np.ndarray] | None = None, batched: Callable[[Sequence[str]], Sequence[np.ndarray]] = hashed_batch) -> Column:
    """array<float> of each text by a function of a batch of texts, or by one of a single text."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            given = [t or "" for t in part]
            yield pd.Series([embedder(t) for t in given] if embedder else list(batched(given)))

    return run(texts)


def principal(vectors: DataFrame, column: str, components: int) -> DataFrame:
    """`vectors` with `reduced`: coordinates on the first principal components, at most as many as there are dimensions and rows less one."""
    n = vectors.count()
    dims = len(vectors.select(column).first()[0]) if n else 0
    k = max(1, min(components, dims, max(n - 1, 1)))

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, square = np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            x = np.array(batch[column].tolist(), np.float64).reshape(-1, dims)
            total += x.sum(0)
            square += x.T @ x
        yield pd.DataFrame({"row": range(dims + 1), "values": [total.tolist(), *square.tolist()]})

    if not n:
        return vectors.withColumn("reduced", F.col(column).cast("array<double>"))
    # dims + 1 rows a partition, whatever its size.
    sums = vectors.select(column).mapInPandas(moments, "row int, values array<double>").groupBy("row").agg(*[F.sum(F.col("values")[i]).alias(f"v{i}") for i in range(dims)]).orderBy("row").toPandas().drop(columns="row").to_numpy()
    mean = sums[0] / n
    values, axes = np.linalg.eigh(sums[1:] / n - np.outer(mean, mean))
    axes = axes[:, np.argsort(-values)[:k]]
    axes *= np.where(axes[np.abs(axes).argmax(0), range(k)] < 0, -1, 1)

    @F.pandas_udf("array<double>")
    def project(xs: pd.Series) -> pd.Series:
        return pd.Series(list((np.array(xs.tolist()) - mean) @ axes))

    return vectors.withColumn("reduced", project(F.col(column)))


def _spanning(points: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Edges (weight, a, b) of a minimum spanning tree over mutual reachability."""
    n = len(points)
    best, near, left = np.full(n, np.inf), np.zeros(n, int), np.arange(1, n)
    at, edges = 0, np.zeros((max(n - 1, 0), 3))
    for k in range(n - 1):
        d = np.maximum(np.maximum(np.sqrt(((points[left] - points[at]) ** 2).sum(1)), core[left]), core[at])
        closer = d < best[left]
        best[left[closer]], near[left[closer]] = d[closer], at
        i = int(best[left].argmin())
        at = int(left[i])
        edges[k] = best[at], near[at], at
        left = np.delete(left, i)
    return edges


def _thinned(edges: np.ndarray) -> np.ndarray:
    """The edges (weight, a, b) of a minimum spanning forest of those given, by rising weight."""
    edges = edges[np.lexsort((edges[:, 2], edges[:, 1], edges[:, 0]))]
    ids, ends = np.unique(edges[:, 1:], return_inverse=True)
    parent = list(range(len(ids)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (a, b) in enumerate(ends.reshape(-1, 2).tolist()):
        a, b = top(a), top(b)
        if a != b:
            parent[a] = b
            kept.append(k)
    return edges[kept]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))


def _tree_labels(n: int, edges: np.ndarray, least_size: int, method: str) -> tuple[np.ndarray, np.ndarray]:
    """(labels, strengths) of n points from the edges of their spanning tree, by rising weight.

    Edges of equal weight join at once, so the answer doesn't depend on which of several trees was found.
    """
    labels, strength = np.full(n, -1), np.zeros(n)
    parent, sizes, least, children, level = list(range(n)), [1] * n, list(range(n)), {}, {}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    cuts = np.flatnonzero(np.diff(edges[:, 0])) + 1
    for same in np.split(edges, cuts) if len(edges) else []:
        ends = [(top(int(a)), top(int(b))) for a, b in same[:, 1:]]
        joined: dict[int, list[int]] = {}
        link = {x: x for pair in ends for x in pair}

        def root(x: int, link=link) -> int:
            while link[x] != x:
                link[x] = link[link[x]]
                x = link[x]
            return x

        for a, b in ends:
            link[root(a)] = root(b)
        for x in link:
            joined.setdefault(root(x), []).append(x)
        for parts in joined.values():
            node = len(parent)
            parts.sort(key=lambda x: least[x])
            parent.append(node)
            sizes.append(sum(sizes[x] for x in parts))
            least.append(least[parts[0]])
            for x in parts:
                parent[x] = node
            children[node], level[node] = parts, float(same[0, 0])

    def leaves(x: int) -> list[int]:
        out, stack = [], [x]
        while stack:
            y = stack.pop()
            stack.extend(children[y]) if y in children else out.append(y)
        return out

    # Condensed tree: a cluster goes on while only one side is large enough, and ends where several are.
    born, left, below, mass, stack = {0: 0.0}, {}, {0: []}, {0: 0.0}, [(len(parent) - 1, 0)]
    while stack:
        node, cluster = stack.pop()
        if node not in children:
            continue
        density = 1 / max(level[node], 1e-12)
        large = [c for c in children[node] if sizes[c] >= least_size]
        for c in children[node]:
            if sizes[c] < least_size:
                for x in leaves(c):
                    left[x] = (cluster, density)
                    mass[cluster] += density - born[cluster]
            elif len(large) == 1:
                stack.append((c, cluster))
            else:
                new = len(born)
                born[new], below[new], mass[new] = density, [], 0.0
                below[cluster].append(new)
                mass[cluster] += sizes[c] * (density - born[cluster])
                stack.append((c, new))
    chosen: set[int] = set()
    if method == "leaf":
        chosen = {c for c in born if not below[c] and c} or ({0} if not below[0] else set())
    else:
        best = {}
        for c in sorted(born, reverse=True):
            inner = sum(best[b] for b in below[c])
            best[c] = max(mass[c], inner) if c else inner
            if c and mass[c] >= inner:
                chosen.add(c)
        for c in sorted(chosen):
            drop = list(below[c])
            while drop:
                b = drop.pop()
                chosen.discard(b)
                drop.extend(below[b])
    above = {b: c for c in below for b in below[c]}
    number = {c: k for k, c in enumerate(sorted(chosen))}
    highest: dict[int, float] = {}
    home = {}
    for x, (c, d) in left.items():
        at = c
        while at not in chosen and at in above:
            at = above[at]
        if at in chosen:
            home[x] = at
            highest[at] = max(highest.get(at, 0.0), d)
    for x, c in home.items():
        labels[x], strength[x] = number[c], min(left[x][1], highest[c]) / highest[c]
    return labels, strength


def density_labels(points: np.ndarray, least_size: int = 5, method: str = "eom") -> tuple[np.ndarray, np.ndarray]:
    """(labels, strengths): hierarchical density clusters of points in memory, -1 for noise; `method` is eom (excess of mass) or leaf."""
    n = len(points)
    least_size = max(2, min(least_size, max(n, 2)))
    if n < least_size:
        return np.full(n, -1), np.zeros(n)
    at = min(least_size, n - 1)
    core = np.array([np.partition(np.sqrt(((points - p) ** 2).sum(1)), at)[at] for p in points])
    return _tree_labels(n, _thinned(_spanning(points, core)), least_size, method)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _blocked(vectors: DataFrame, key: str, column: str, group: list[str], block: int) -> tuple[DataFrame, int]:
    """(group..., key, x, n, total, block, blocks): points numbered from 0 in each group by their key, and the most blocks of a group.

    Parts are written once, so that a lost one can't change numbers; only one count a part and group comes to the driver.
    """
    spark = vectors.sparkSession
    held = vectors.where(F.col(column).isNotNull()).select(*group, key, F.transform(column, lambda v: v.cast("double")).alias("x"))
    ranged = held.repartitionByRange(parallelism(spark), *group, key).sortWithinPartitions(*group, key)
    kept = durable(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    parts = kept.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_c"), F.min("_row").alias("_first"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.withColumn("_base", F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")).withColumn("total", F.sum("_c").over(W.partitionBy(*group)))
    joined = kept.join(starts.drop("_c", "_first"), ["_part", *group]).withColumn("n", F.col("_row") + F.col("_base"))
    numbered = durable(joined.select(*group, key, "x", "n", "total", F.floor(F.col("n") / block).cast("int").alias("block"), F.ceil(F.col("total") / block).cast("int").alias("blocks")))
    return numbered, numbered.agg(F.coalesce(F.max("blocks"), F.lit(0))).first()[0]


def _cells(points: DataFrame, whole: bool) -> DataFrame:
    """Points with each pair (i, j), i <= j, of blocks that theirs belongs to; `whole` pairs blocks with themselves even where there are others."""
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    kept = others if whole else F.filter(others, lambda c: (c["i"] < c["j"]) | (F.col("blocks") == 1))
    return points.withColumn("_cell", F.explode(kept)).withColumn("i", F.col("_cell.i")).withColumn("j", F.col("_cell.j")).drop("_cell")


def _kinds(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def _nearest(points: DataFrame, group: list[str], k: int) -> DataFrame:
    """(group..., n, near): the `k` nearest other points of each as array<struct<d,m>>, the nearest first."""

    def meet(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        n, mine = cell["n"].to_numpy(), cell["block"].to_numpy()
        x = cell["x"].chunk(0).flatten().to_numpy().reshape(len(n), -1)
        i, j = cell["i"][0].as_py(), cell["j"][0].as_py()
        rows, near, far = [], [], []
        for own, other in {(i, j), (j, i)}:
            a, b = np.flatnonzero(mine == own), np.flatnonzero(mine == other)
            for start in range(0, len(a), 32):
                some = a[start : start + 32]
                d = _distances(x[some], x[b])
                if own == other:
                    d[np.arange(len(some)), np.searchsorted(b, some)] = np.inf
                took = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
                away = np.take_along_axis(d, took, 1)
                rows.append(np.repeat(n[some], took.shape[1])[np.isfinite(away).ravel()])
                near.append(n[b[took]][np.isfinite(away)])
                far.append(away[np.isfinite(away)])
        given = {g: pa.array([cell[g][0].as_py()], cell.schema.field(g).type) for g in group}
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        names = np.unique(n)  # a point without neighbours keeps its row
        first = np.searchsorted(row[order], names)
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(far)[order]), pa.array(np.concatenate(near)[order])], ["d", "m"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pairs)
        repeated = pa.array(np.zeros(len(names), np.int64))
        return pa.table({g: v.take(repeated) for g, v in given.items()} | {"n": pa.array(names), "near": lists})

    schema = _kinds(points, group) + "n bigint, near array<struct<d:double,m:bigint>>"
    met = _cells(points.select(*group, "n", "x", "block", "blocks"), True).repartition(4 * parallelism(points.sparkSession), *group, "i", "j").groupBy(*group, "i", "j").applyInArrow(meet, schema)
    return met.groupBy(*group, "n").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def density_clusters(vectors: DataFrame, key: str, column: str, group: list[str] | None = None, least_size: int = 5, method: str = "eom", most_points: int | None = None, block: int | None = None) -> DataFrame:
    """(group..., key, cluster_id, cluster_prob) of the points with a vector, -1 for noise.

    `least_size` and `method` may be columns of the group. With `most_points`, a larger group is an error. Two blocks of
    `block` points are one task; the answer doesn't depend on it.
    """
    named = group or []
    group = named or ["_all"]
    rows = vectors if named else vectors.withColumn("_all", F.lit(0))
    points, blocks = _blocked(rows, key, column, group, block or BLOCK_POINTS)
    spark = vectors.sparkSession
    if most_points is not None and (n := points.agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]) > most_points:
        raise ValueError(f"{n} points in a group; at most {most_points} are wanted")
    wanted = F.col("least_size") if "least_size" in group else F.lit(least_size)
    size = F.greatest(F.lit(2), F.least(wanted, F.greatest(F.col("total"), F.lit(2)))).cast("int")
    how = F.col("method") if "method" in group else F.lit(method)
    settled = points.withColumn("_size", size).withColumn("_how", how)
    most = settled.agg(F.coalesce(F.max("_size"), F.lit(2))).first()[0]
    near = _nearest(points, group, most)
    core = settled.join(near, [*group, "n"], "left").withColumn("core", F.coalesce(F.get(F.col("near"), F.least(F.col("_size"), F.col("total").cast("int") - 1) - 1)["d"], F.lit(0.0)))
    ready = durable(core.select(*group, key, "n", "x", "total", "block", "blocks", "_size", "_how", "core"))
    schema = _kinds(ready, group) + "cell int, w double, a bigint, b bigint"

    def framed(edges: np.ndarray, given: pd.DataFrame, cell: int) -> pd.DataFrame:
        out = pd.DataFrame({"cell": np.full(len(edges), cell, np.int32), "w": edges[:, 0], "a": edges[:, 1].astype(np.int64), "b": edges[:, 2].astype(np.int64)})
        for g in group:
            out[g] = given[g].iloc[0]
        return out[[*group, "cell", "w", "a", "b"]]

    def span(cell: pd.DataFrame) -> pd.DataFrame:
        edges = _spanning(_matrix(cell["x"]), cell["core"].to_numpy())
        names = cell["n"].to_numpy()
        edges[:, 1:] = np.sort(names[edges[:, 1:].astype(int)], axis=1) if len(edges) else edges[:, 1:]
        i, j = int(cell["i"].iloc[0]), int(cell["j"].iloc[0])
        return framed(edges, cell, j * (j + 1) // 2 + i)

    def thin(part: pd.DataFrame) -> pd.DataFrame:
        return framed(_thinned(part[["w", "a", "b"]].to_numpy(np.float64)), part, int(part["_chunk"].iloc[0]))

    pairs = _cells(ready.select(*group, "n", "x", "core", "block", "blocks"), False)
    trees = durable(pairs.repartition(4 * parallelism(spark), *group, "i", "j").groupBy(*group, "i", "j").applyInPandas(span, schema))
    left = max(1, blocks * (blocks + 1) // 2)
    while left > 1:
        left = -(-left // TREES)
        trees = durable(trees.withColumn("_chunk", F.pmod("cell", F.lit(left))).groupBy(*group, "_chunk").applyInPandas(thin, schema))

    def label(part: pd.DataFrame) -> pd.DataFrame:
        n, size = int(part["total"].iloc[0]), int(part["_size"].iloc[0])
        labels, strength = np.full(n, -1), np.zeros(n)
        if n >= size:
            edges = part.loc[part["w"].notna(), ["w", "a", "b"]].to_numpy(np.float64)
            labels, strength = _tree_labels(n, _thinned(edges), size, part["_how"].iloc[0])
        out = pd.DataFrame({"n": np.arange(n), "cluster_id": labels.astype("int32"), "cluster_prob": strength})
        for g in group:
            out[g] = part[g].iloc[0]
        return out[[*group, "n", "cluster_id", "cluster_prob"]]

    heads = ready.groupBy(*group).agg(F.max("total").alias("total"), F.max("_size").alias("_size"), F.max("_how").alias("_how"))
    labelled = heads.join(trees, group, "left").groupBy(*group).applyInPandas(label, _kinds(ready, group) + "n bigint, cluster_id int, cluster_prob double")
    return ready.select(*group, key, "n").join(labelled, [*group, "n"]).select(*named, key, "cluster_id", "cluster_prob")


def reduce(vectors: DataFrame, key: str, column: str, components: int = 15, neighbours: int = 15, metric: str = "cosine") -> DataFrame:
    """`vectors` with `reduced`: principal components, each point then moved to the middle of itself and its nearest neighbours.

    `metric` is cosine, which compares directions, or euclidean. The neighbours draw like points together, so that
    density can tell groups apart; with fewer than 2 of them the components stay as they are.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric: {metric}")
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    direction = F.when(norm > 0, F.transform(column, lambda v: v.cast("double") / norm)).otherwise(F.transform(column, lambda v: v.cast("double")))
    flat = principal(vectors.withColumn("_d", direction if metric == "cosine" else F.col(column)), "_d", components).drop("_d")
    if neighbours < 2:
        return flat
    flat = durable(flat)
    points, _ = _blocked(flat.withColumn("_all", F.lit(0)), key, "reduced", ["_all"], BLOCK_POINTS)
    near = _nearest(points, ["_all"], neighbours - 1).select("n", F.explode(F.concat(F.transform("near", lambda e: e["m"]), F.array("n"))).alias("m"))
    dims = points.agg(F.coalesce(F.max(F.size("x")), F.lit(1))).first()[0]
    moved = near.join(points.select(F.col("n").alias("m"), "x"), "m").groupBy("n")
    middle = moved.agg(F.array(*[F.avg(F.get("x", F.lit(d))) for d in range(dims)]).alias("reduced"))
    return flat.drop("reduced").join(points.select(F.col(key).alias("_key"), "n").join(middle, "n"), F.col(key) == F.col("_key")).drop("_key", "n")


def centroids(vectors: DataFrame, cluster: str, column: str) -> DataFrame:
    """(cluster, centroid): mean vectors, added up in part before the exchange."""
    flat = vectors.select(cluster, F.posexplode(column).alias("d", "v"))
    means = flat.groupBy(cluster, "d").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("centroid"))


def exemplars(vectors: DataFrame, key: str, cluster: str, column: str, n: int = 5) -> DataFrame:
    """(cluster, rank, key, distance): the members nearest to their centroid; ties go to the lesser key."""
    near = vectors.join(centroids(vectors, cluster, column), cluster)
    squares = F.zip_with(F.col(column), F.col("centroid"), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    held = near.withColumn("distance", F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)), 6))
    order = W.partitionBy(cluster).orderBy("distance", key)
    return held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(cluster, "rank", key, "distance")


def summary(labelled: DataFrame, key: str, text: str, column: str, config: dict, n_exemplars: int = 5, n_samples: int = 5, seed: int = 42) -> DataFrame:
    """One row a cluster, noise left out: size, typical and drawn sentences, and empty fields for a reviewer."""
    real = labelled.where("cluster_id <> -1")
    near = exemplars(real, key, "cluster_id", column, n_exemplars).join(real.select(key, text), key)
    typical = near.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", text))), lambda x: x[text]).alias("exemplar_sentences"))
    order = W.partitionBy("cluster_id").orderBy("_draw", key)
    drawn = real.withColumn("_draw", F.xxhash64(F.lit(seed), key)).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n_samples)
    samples = drawn.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", text))), lambda x: x[text]).alias("sample_sentences"))
    sizes = real.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    null = lambda kind: F.lit(None).cast(kind)
    return sizes.join(typical, "cluster_id").join(samples, "cluster_id").select(
        "cluster_id", F.lit(run_id(config)).alias("clustering_run_id"), "size", "exemplar_sentences", "sample_sentences",
        F.array().cast("array<string>").alias("coherence_reviewed_by"), null("string").alias("coherence_verdict"), null("string").alias("human_label"),
    )


def sweep_summary(labelled: DataFrame, by: list[str]) -> DataFrame:
    """One row a setting: sentences, clusters, noise, the largest sizes; the most even setting first."""
    sizes = labelled.groupBy(*by, "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    real = F.col("cluster_id") != -1
    largest = F.coalesce(F.max(F.when(real, F.col("n"))), F.lit(0))
    total = F.sum("n")
    out = sizes.groupBy(*by).agg(
        total.alias("n_sentences"), F.count_if(real).alias("n_clusters"), F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("n_noise"),
        F.round(F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)) / total, 4).alias("noise_fraction"), largest.alias("largest_cluster_size"),
        F.round(largest / total, 4).alias("largest_cluster_fraction"), F.slice(F.sort_array(F.collect_list(F.when(real, F.col("n"))), asc=False), 1, 5).alias("top_cluster_sizes"),
    )
    return out.orderBy("largest_cluster_fraction", *by)


#: Settings that are tried by default: six reductions and eight clusterings of each.
NEIGHBOURS, COMPONENTS, GRID = (15, 30), (5, 15, 30), tuple((size, method) for size in (5, 10, 20, 40) for method in ("eom", "leaf"))
SETTING = ["n_neighbors", "n_components", "least_size", "method"]


def reductions(vectors: DataFrame, key: str, column: str, components: Sequence[int] = COMPONENTS, neighbours: Sequence[int] = NEIGHBOURS, metric: str = "cosine") -> DataFrame:
    """(key, reduced, n_neighbors, n_components): each reduction once."""
    parts = [reduce(vectors.select(key, column), key, column, k, n, metric).select(key, "reduced", F.lit(n).alias("n_neighbors"), F.lit(k).alias("n_components")) for n in neighbours for k in components]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return durable(out)


def settings_labels(reduced: DataFrame, key: str, grid: Sequence[tuple[int, str]] = GRID) -> DataFrame:
    """(setting..., key, cluster_id, cluster_prob) of every reduction under every setting of the clustering, side by side."""
    settings = reduced.sparkSession.createDataFrame(list(grid), "least_size int, method string")
    each = reduced.crossJoin(F.broadcast(settings))  # the settings are a short list of parameters
    return density_clusters(each, key, "reduced", SETTING)


def sweep(vectors: DataFrame, key: str, column: str, components: Sequence[int] = COMPONENTS, grid: Sequence[tuple[int, str]] = GRID, neighbours: Sequence[int] = (0,), metric: str = "euclidean") -> DataFrame:
    """Labels under every setting; without neighbours the reductions are plain principal components."""
    return settings_labels(reductions(vectors, key, column, components, neighbours, metric), key, grid)


def best_exemplars(reduced: DataFrame, labels: DataFrame, results: DataFrame, key: str, best: int = 3, most_clusters: int = 5, n: int = 5) -> DataFrame:
    """(setting..., cluster_id, size, rank, key, distance): typical members of the largest clusters under the `best` most even settings."""
    top = results.orderBy("largest_cluster_fraction", *SETTING).limit(best).select(*SETTING)
    held = labels.where("cluster_id <> -1").join(F.broadcast(top), SETTING)  # at most `best` rows
    sizes = held.groupBy(*SETTING, "cluster_id").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.withColumn("_r", F.row_number().over(W.partitionBy(*SETTING).orderBy(F.desc("size"), "cluster_id"))).where(F.col("_r") <= most_clusters).drop("_r")
    members = held.join(F.broadcast(largest), [*SETTING, "cluster_id"]).join(reduced, [key, "n_neighbors", "n_components"])
    named = members.withColumn("_c", F.concat_ws(":", *SETTING, "cluster_id"))
    near = exemplars(named, key, "_c", "reduced", n)
    return near.join(F.broadcast(largest.withColumn("_c", F.concat_ws(":", *SETTING, "cluster_id"))), "_c").select(*SETTING, "cluster_id", "size", "rank", key, "distance")
