"""Records grouped into clusters of like wording (problem 1).

1. Records with the same set of distinct words are one point; copies come back at the end.
2. A point's words are hashed, with signs, into `dims` features weighted by inverse frequency.
3. k-means|| seeds: in each round every task draws points with a chance in proportion to their
   squared distance; the drawn points, a bounded number, are weighted by the points nearest to them
   and reduced to k. Lloyd rounds over all points follow until the cost falls by less than `SETTLED` of itself.
4. Each point belongs to its nearest centroid. `similar_points` compares the points of clusters
   exactly; clusters of more than `block` points are compared in blocks, so no task holds a
   whole hot cluster.
5. `similar_pairs` doesn't depend on clusters: similar sets have a word in common among the rarest
   of both, meet there and are counted exactly. No pair is lost.

k is twice the square root of the number of points up to `MOST_CLUSTERS`. Clusters of more than
`SPLIT` points are compared by the rare words that similar sets have in common, which loses no pair. A word is known by 32 bits of its hash, a set of words by 64: two words of a pair
fall together once in ten million pairs, which can add a pair at the threshold but never lose one. Defined cases: null texts belong to no
cluster; texts without words are one point of their own and similar to each other; repeated rows
count once, and of several texts with one key the one of the least point; equal distances go to the lower number; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tiesmith.session import durable, parallelism

DIMS, WEIGHT_BITS, NEAREST, BLOCK = 1024, 16, 4, 4096
MOST_CLUSTERS = 4096
SETTLED = 1e-3
#: Points of a cluster before its pairs are sought by rare words, and points with one rare word in a block then.
SPLIT, PART = 100_000, 50_000
#: Keys of one point before they meet in blocks.
COPIES = 1024
_PRODUCTS = 2048
#: Rows of whole groups that are taken together, candidates at a time, rows of a run that are just compared, words a run shares at most.
_MEETING, _PAIRS, _LONG_RUN, _DEPTH = 32_768, 1_000_000, 32, 6
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_sets(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, point, words): 32-bit hashes of a text's distinct words, and 64 bits for the whole set."""
    import hashlib

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        find = re.compile(r"[^\W_]+").findall
        for batch in batches:
            joined, sizes = [], []
            for t in batch.column(1).to_pylist():
                if not t.isascii():
                    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
                parts = []
                for w in set(find(t.casefold())):
                    if (h := known.get(w)) is None:
                        h = hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                        if len(known) < 500_000:
                            known[w] = h
                    parts.append(h)
                parts.sort()
                joined.append(b"".join(parts))
                sizes.append(len(parts))
            flat = np.frombuffer(b"".join(joined), np.int64).view(np.int32)[::2].copy()
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            points = np.frombuffer(b"".join(hashlib.blake2b(j, digest_size=8).digest() for j in joined), np.int64)
            yield pa.record_batch([batch.column(0), pa.array(points), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["key", "point", "words"])

    return rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL").mapInArrow(scan, "key string, point bigint, words array<int>")


def _spread(words: np.ndarray) -> np.ndarray:
    return (words.view(np.uint32).astype(np.uint64) + np.uint64(1)) * _MIX


def _buckets(words: np.ndarray) -> np.ndarray:
    return (_spread(words) >> np.uint64(64 - WEIGHT_BITS)).astype(np.int64)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).ravel(), kind))


class Vectors:
    """Unit vectors of signed hashed features, kept sparse: a short text has few of the `dims` features."""

    def __init__(self, lists: pa.ListArray, weights: np.ndarray, dims: int) -> None:
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(lists.offsets.to_numpy())
        self.n, self.dims = len(sizes), dims
        mixed = _spread(flat)
        column = ((mixed >> np.uint64(24)) % np.uint64(dims)).astype(np.int64)
        signed = weights[_buckets(flat)] * np.where(mixed & np.uint64(1 << 20), 1.0, -1.0)
        # A vector without words has one feature of no weight, so that each has a stretch of its own.
        bare = np.flatnonzero(sizes == 0)
        at = np.r_[np.repeat(np.arange(self.n, dtype=np.int64), sizes) * dims + column, bare * dims]
        at, inverse = np.unique(at, return_inverse=True)
        value = np.bincount(inverse, np.r_[signed, np.zeros(len(bare))], len(at))
        self.row, self.column = at // dims, at % dims
        norm = np.sqrt(np.bincount(self.row, value**2, self.n))
        self.value = (value / np.where(norm > 0, norm, 1)[self.row]).astype(np.float32)
        self.starts = np.searchsorted(self.row, np.arange(self.n + 1))

    def __len__(self) -> int:
        return self.n

    def dot(self, turned: np.ndarray) -> np.ndarray:
        """Products with the columns of a (dims, k) matrix, of which each vector needs a few rows."""
        out = np.empty((self.n, turned.shape[1]), np.float32)
        for k, (low, high) in enumerate(zip(self.starts[:-1].tolist(), self.starts[1:].tolist())):
            np.dot(self.value[low:high], turned[self.column[low:high]], out=out[k])
        return out

    def dense(self, which: np.ndarray) -> np.ndarray:
        """The chosen vectors as rows of a matrix."""
        out = np.zeros((len(which), self.dims), np.float32)
        for row, k in enumerate(which):
            part = slice(self.starts[k], self.starts[k + 1])
            out[row, self.column[part]] = self.value[part]
        return out


def _matrix(lists: pa.ListArray, weights: np.ndarray, dims: int) -> np.ndarray:
    """All vectors as rows."""
    return Vectors(lists, weights, dims).dense(np.arange(len(lists)))


def _bucket_counts(points: DataFrame) -> np.ndarray:
    """Points with each of the fixed number of word buckets, counted over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << WEIGHT_BITS, np.int64)
        for batch in batches:
            held += np.bincount(_buckets(batch.column(0).flatten().to_numpy(zero_copy_only=False)), minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.record_batch([pa.array(at), pa.array(held[at])], ["bucket", "n"])

    sums = points.select("words").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(1 << WEIGHT_BITS, np.int64)
    held[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return held


class KMeans:
    """Spherical k-means over (point, words) rows that are stored and cheap to read again."""

    def __init__(self, points: DataFrame, n: int, k: int, rounds: int = 2, settled: float = SETTLED, dims: int = DIMS, seed: int = 7) -> None:
        self.points, self.n, self.k, self.dims, self.seed = points, n, max(1, min(k, n)), dims, seed
        self.context = points.sparkSession.sparkContext
        self.weights = self._inverse_frequencies()
        self.centroids = self._seeds(rounds)
        self.costs: list[float] = []
        while len(self.costs) < 2 or self.costs[-2] - self.costs[-1] > settled * self.costs[-2]:
            self.costs.append(self._lloyd())

    def _inverse_frequencies(self) -> np.ndarray:
        """log(1 + n / records) of each of the fixed number of word buckets, over all points."""
        return np.log1p(self.n / np.maximum(_bucket_counts(self.points), 1)).astype(np.float32)

    def _each(self, columns: list[str], work, schema: str) -> DataFrame:
        shared, dims = self.context.broadcast(self.weights), self.dims

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, _PRODUCTS):
                    part = batch.slice(start, _PRODUCTS)
                    yield from work(part, Vectors(part.column(part.schema.get_field_index("words")), shared.value, dims))

        return self.points.select(*columns).mapInArrow(scan, schema)

    def _gather(self, work, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors that `work` picks, with a number each, in the order of their points."""
        rows = self._each(columns, work, "point bigint, number double, vector array<float>").toArrow().sort_by("point")
        flat = rows["vector"].combine_chunks().flatten().to_numpy() if rows.num_rows else np.zeros(0, np.float32)
        return flat.reshape(-1, self.dims), rows["number"].to_numpy()

    def _seeds(self, rounds: int) -> np.ndarray:
        most, seed, dims, n = 2 * self.k, self.seed, self.dims, self.n
        chosen = np.zeros((0, dims), np.float32)
        for turn in range(rounds + 1):
            want = max(1, self.k // 4) if not turn else most / rounds
            near = self._nearest(chosen) if turn else None
            cost = self._cost(chosen) if turn else float(n)

            def draw(part: pa.RecordBatch, x: Vectors, turn=turn, want=want, near=near, cost=cost) -> Iterator[pa.RecordBatch]:
                """Points of chance want * distance / the cost over all points."""
                far = 1 - near(x).max(1).clip(max=1) if near else np.ones(len(x))
                ids = part.column(0).to_numpy().view(np.uint64)
                chance = (((ids + np.uint64(seed * 1000 + turn)) * _MIX ^ (ids >> np.uint64(29))) * _MIX >> np.uint64(11)).astype(np.float64) / float(1 << 53)
                at = np.flatnonzero(chance * max(cost, 1e-9) < want * far)
                yield pa.record_batch([part.column(0).take(pa.array(at)), pa.array(far[at].astype(np.float64)), _lists(x.dense(at), pa.float32())], ["point", "number", "vector"])

            picked, _ = self._gather(draw, ["point", "words"])
            chosen = np.concatenate([chosen, picked])
        if len(chosen) <= self.k:
            return chosen if len(chosen) else np.zeros((1, dims), np.float32)
        return self._reduced(chosen, self._mass(chosen))

    def _cost(self, centroids: np.ndarray) -> float:
        """Sum of the distances of all points from the nearest centroid."""
        near = self._nearest(centroids)

        def far(part: pa.RecordBatch, x: Vectors) -> Iterator[pa.RecordBatch]:
            yield pa.record_batch([pa.array([float((1 - near(x).max(1).clip(max=1)).sum(dtype=np.float64))])], ["far"])

        return self._each(["words"], far, "far double").agg(F.sum("far")).head()[0] or 0.0

    def _nearest(self, centroids: np.ndarray) -> Callable[[Vectors], np.ndarray]:
        shared = self.context.broadcast(np.ascontiguousarray(centroids.T))
        return lambda x: x.dot(shared.value)

    def _mass(self, centroids: np.ndarray) -> np.ndarray:
        near, size = self._nearest(centroids), len(centroids)

        def count(part: pa.RecordBatch, x: Vectors) -> Iterator[pa.RecordBatch]:
            n = np.bincount(near(x).argmax(1), minlength=size)
            yield pa.record_batch([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["at", "n"])

        sums = self._each(["words"], count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(size)
        out[sums["at"].to_numpy()] = sums["n"].to_numpy()
        return out

    def _reduced(self, chosen: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """Weighted k-means++ over the drawn points, whose number is bounded by a few k."""
        random, picks = np.random.default_rng(self.seed), []
        far = np.ones(len(chosen))
        for _ in range(self.k):
            chance = mass * far
            if chance.sum() <= 0:
                break
            picks.append(int(random.choice(len(chosen), p=chance / chance.sum())))
            far = np.minimum(far, 1 - (chosen @ chosen[picks[-1]]).clip(max=1))
            far[picks[-1]] = 0
        return chosen[picks]

    def _lloyd(self) -> float:
        """Move the centroids to the middle of their points; the cost is that before the move."""
        near, size, dims = self._nearest(self.centroids), len(self.centroids), self.dims
        weights, points = self.context.broadcast(self.weights), self.points

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, cost = np.zeros((size, dims), np.float32), 0.0
            for batch in batches:
                for start in range(0, batch.num_rows, _PRODUCTS):
                    x = Vectors(batch.column(0).slice(start, _PRODUCTS), weights.value, dims)
                    close = near(x)
                    home = close.argmax(1)
                    cost += float((1 - close.max(1).clip(max=1)).sum(dtype=np.float64))
                    np.add.at(held.ravel(), home[x.row] * dims + x.column, x.value)
            # Only what isn't zero is sent: a task's few points touch few features of most clusters.
            used = np.flatnonzero(np.any(held, axis=1))
            for start in range(0, max(len(used), 1), 256):
                some = used[start : start + 256]
                row, column = np.nonzero(held[some])
                cuts = pa.array(np.searchsorted(row, np.arange(len(some) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(column.astype(np.int16))), pa.ListArray.from_arrays(cuts, pa.array(held[some][row, column]))]
                yield pa.record_batch([pa.array(some), *lists], ["at", "features", "sums"])
            yield pa.record_batch([pa.array([-1]), pa.array([[]], pa.list_(pa.int16())), pa.array([[cost]], pa.list_(pa.float32()))], ["at", "features", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            cost = 0.0
            for batch in batches:
                for at, features, values in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    if at < 0:
                        cost += float(values.values.to_numpy().sum(dtype=np.float64))
                        continue
                    if at not in held:
                        held[at] = np.zeros(dims, np.float32)
                    held[at][features.values.to_numpy()] += values.values.to_numpy()
            yield pa.record_batch([pa.array([*held, -1], pa.int64()), pa.array([*held.values(), np.zeros(dims, np.float32)], pa.list_(pa.float32())), pa.array([0.0] * len(held) + [cost], pa.float64())], ["at", "vector", "cost"])

        sparse = points.select("words").mapInArrow(sums, "at bigint, features array<smallint>, sums array<float>")
        rows = sparse.repartition("at").mapInArrow(add, "at bigint, vector array<float>, cost double").toArrow()
        moved = self.centroids.copy()
        real = np.flatnonzero(rows["at"].to_numpy() >= 0)
        if len(real):
            vectors = rows["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dims)[real]
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            moved[rows["at"].to_numpy()[real]] = vectors / np.where(norms > 0, norms, 1)
        self.centroids = moved
        return float(rows["cost"].to_numpy().sum())

    def assign(self, nearest: int = 1) -> DataFrame:
        """(point, words, clusters, closeness): each point's nearest centroids, the nearest first."""
        near, m = self._nearest(self.centroids), min(nearest, len(self.centroids))

        def label(part: pa.RecordBatch, x: Vectors) -> Iterator[pa.RecordBatch]:
            close = near(x)
            top = np.argpartition(-close, m - 1, axis=1)[:, :m] if m < close.shape[1] else np.tile(np.arange(m), (len(x), 1))
            mine = np.take_along_axis(close, top, 1)
            order = np.lexsort((top, -mine), axis=1)
            top, mine = np.take_along_axis(top, order, 1), np.take_along_axis(mine, order, 1)
            yield pa.record_batch([part.column(0), part.column(1), _lists(top.astype(np.int32), pa.int32()), pa.array(mine[:, 0].astype(np.float64))], ["point", "words", "clusters", "closeness"])

        return self._each(["point", "words"], label, "point bigint, words array<int>, clusters array<int>, closeness double")


def distinct_points(sets: DataFrame) -> DataFrame:
    """The distinct points of `word_sets`, stored once."""
    parts = parallelism(sets.sparkSession)
    return durable(sets.select("point", "words").repartition(parts, "point").groupBy("point").agg(F.first("words").alias("words")))


def fit(sets: DataFrame, k: int | None = None) -> KMeans:
    """k-means over the distinct points of `word_sets`."""
    points = distinct_points(sets)
    n = points.count()
    return KMeans(points, n, k or min(MOST_CLUSTERS, max(1, round(2 * n**0.5))))


#: Columns that words are hashed to where pairs are sought; words that fall together only raise a bound.
_COLUMNS = 256


def _compare(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of numbers, from a and from b, of word sets whose common words are at least `share` of all their words.

    Products of hashed sets bound the number of common words from above; what passes is counted exactly.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int32)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rough = np.bincount(owner * _COLUMNS + inverse % _COLUMNS, minlength=len(sets) * _COLUMNS).astype(np.float32).reshape(-1, _COLUMNS)
    # A word of one set only is in no intersection; it counts through the sizes.
    number, shared = np.cumsum(counts > 1) - 1, counts[inverse] > 1
    bit, owner = number[inverse[shared]], owner[shared]
    bits = np.zeros((len(sets), (int(number[-1]) + 1 if len(number) else 0) // 8 + 1), np.uint8)
    np.bitwise_or.at(bits, (owner, bit >> 3), np.left_shift(1, bit & 7).astype(np.uint8))
    same, rows, columns = a is b, [], []
    # Two more columns take the least number of common words off the product itself.
    least = (-share / (1 + share) * sizes).astype(np.float32)[:, None]
    ones = np.ones_like(least)
    left_side, right_side = np.hstack([rough, least, ones]), np.ascontiguousarray(np.hstack([rough, ones, least])[b].T)
    for start in range(0, len(a), 512):
        left = a[start : start + 512]
        first = start if same else 0
        products = left_side[left] @ right_side[:, first:]
        i, j = np.divmod(np.flatnonzero(products.ravel() >= -1e-3), products.shape[1])
        x, y = left[i], b[first + j]
        if same:
            x, y = x[x < y], y[x < y]
        for some in range(0, len(x), 8192):
            p, q = x[some : some + 8192], y[some : some + 8192]
            common = np.bitwise_count(bits[p] & bits[q]).sum(1, dtype=np.int64)
            keep = common >= share * (sizes[p] + sizes[q] - common) - 1e-9
            rows.append(p[keep])
            columns.append(q[keep])
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (none, none)


def _ranked(lists: pa.ListArray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, owner, place, sizes): the words of each set in one order for all sets, those of rare buckets first."""
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rank = (np.minimum(counts[_buckets(flat)], (1 << 32) - 1).astype(np.uint64) << np.uint64(32)) | flat.view(np.uint32).astype(np.uint64)
    return flat[np.lexsort((rank, owner))], owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes


def _least(sizes: np.ndarray, share: float) -> np.ndarray:
    """Words that a set of each size has in common with any similar set, at least."""
    return np.ceil(share * sizes - 1e-9).astype(np.int64)


def _prefix_figures(points: DataFrame, counts: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket of words, the rows that prefixes give and the size of the least set with one in its head.

    The head is what a set needs against sets that aren't smaller; the rest of a prefix only meets heads of smaller sets.
    """
    shared, none = points.sparkSession.sparkContext.broadcast(counts), np.iinfo(np.int64).max

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = np.zeros(1 << WEIGHT_BITS, np.int64), np.full(1 << WEIGHT_BITS, none)
        for batch in batches:
            words, owner, place, sizes = _ranked(batch.column(0), shared.value)
            at = _buckets(words)
            rows += np.bincount(at[place <= (sizes - _least(sizes, share))[owner]], minlength=len(rows))
            head = place <= (sizes - _least(sizes, 2 * share / (1 + share)))[owner]
            np.minimum.at(size, at[head], sizes[owner[head]])
        at = np.flatnonzero(rows)
        yield pa.record_batch([pa.array(at), pa.array(rows[at]), pa.array(size[at])], ["bucket", "n", "size"])

    sums = points.select("words").mapInArrow(scan, "bucket bigint, n bigint, size bigint").groupBy("bucket").agg(F.sum("n").alias("n"), F.min("size").alias("size")).toArrow()
    rows, size = np.zeros(1 << WEIGHT_BITS, np.int64), np.full(1 << WEIGHT_BITS, none)
    rows[sums["bucket"].to_numpy()], size[sums["bucket"].to_numpy()] = sums["n"].to_numpy(), sums["size"].to_numpy()
    return rows, size


def _joined(group: np.ndarray, place: np.ndarray, apart: np.ndarray, mine: np.ndarray, lists: pa.ListArray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the similar pairs of each group whose first common word is the group's, which stands at `place`.

    Long runs are taken on to the next word that a similar pair has in common, so that what is compared one with
    another shares several words. The bounds only rule out what can't be similar; what passes is counted exactly.
    Rows of a group that is `apart` meet only rows of the other block.
    """
    n, flat, offsets = len(group), lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
    sizes, first = np.diff(offsets), offsets[:-1] - offsets[0]
    owner = np.repeat(np.arange(n), sizes)
    known, code = np.unique(flat, return_inverse=True)
    order = np.sort(owner * len(known) + code)
    mark = (_spread(flat) >> np.uint64(56)).astype(np.int64)
    marks = np.zeros((n, 4), np.uint64)
    np.bitwise_or.at(marks, (owner, mark >> 6), np.left_shift(np.uint64(1), (mark & 63).astype(np.uint64)))
    lost = sizes - np.bitwise_count(marks).sum(1, dtype=np.int64)
    least, part, passed = _least(sizes, share), share / (1 + share), []
    run, member, at, depth = group, np.arange(n), place, 1
    while len(run):
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        lengths = np.diff(np.r_[starts, len(run)])
        further = (lengths > _LONG_RUN) & (np.minimum.reduceat(least[member], starts) > depth) if depth < _DEPTH else np.zeros(len(starts), bool)
        left = np.repeat(starts + lengths, lengths) - np.arange(len(run)) - 1
        left[np.repeat(further, lengths)] = 0
        rest = depth + sizes[member] - at - 1
        total = np.cumsum(left)
        begin = 0
        while begin < len(left):
            stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + _PAIRS, "right")))
            some = left[begin:stop]
            one = np.repeat(np.arange(begin, stop), some)
            two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(some) - some, some)
            begin = stop
            x, y = member[one], member[two]
            need = part * (sizes[x] + sizes[y]) - 1e-9
            keep = (np.minimum(rest[one], rest[two]) >= need) & ~(apart[x] & (mine[x] == mine[y]))
            x, y, need = x[keep], y[keep], need[keep]
            most = np.bitwise_count(marks[x] & marks[y]).sum(1, dtype=np.int64) + np.minimum(lost[x], lost[y])
            keep = most >= need
            passed.append(np.unique(np.minimum(x, y)[keep] * n + np.maximum(x, y)[keep]))
        rows = np.flatnonzero(np.repeat(further, lengths))
        held, number = member[rows], np.repeat(np.arange(len(starts)), lengths)[rows]
        # With `depth` words matched, the next common word leaves room for the least number of them.
        following = np.minimum(sizes[held] - least[held] + depth, sizes[held] - 1) - at[rows]
        following = np.maximum(following, 0)
        again = np.repeat(np.arange(len(rows)), following)
        at = at[rows][again] + 1 + np.arange(len(again)) - np.repeat(np.cumsum(following) - following, following)
        member = held[again]
        run = number[again] * len(known) + code[first[member] + at]
        by = np.argsort(run, kind="stable")
        run, member, at, depth = run[by], member[by], at[by], depth + 1
    pairs = np.unique(np.concatenate(passed)) if passed else np.zeros(0, np.int64)
    a, b = [], []
    for start in range(0, len(pairs), 65_536):
        x, y = np.divmod(pairs[start : start + 65_536], n)
        pair = np.repeat(np.arange(len(x)), sizes[x])
        place_x = np.arange(len(pair)) - np.repeat(np.cumsum(sizes[x]) - sizes[x], sizes[x])
        sought = y[pair] * len(known) + code[first[x][pair] + place_x]
        hit = order[np.minimum(np.searchsorted(order, sought), len(order) - 1)] == sought
        common = np.bincount(pair[hit], minlength=len(x))
        earliest = np.full(len(x), np.iinfo(np.int64).max)
        np.minimum.at(earliest, pair[hit], place_x[hit])
        keep = (common >= share * (sizes[x] + sizes[y] - common) - 1e-9) & (earliest == place[x])
        a.append(x[keep])
        b.append(y[keep])
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _by_rare_words(rows: DataFrame, counts: np.ndarray, share: float, part: int) -> DataFrame:
    """(a, b): all similar pairs of the (scope, point, words) rows of one scope, once for each scope.

    Two similar sets have a word in common among the rarest of both, in any one order of all words: a set of n words
    gives its n - ceil(share * n) + 1 rarest. Sets meet at the first word in common. Words that more than `part`
    sets give are met in blocks.
    """
    figures = _prefix_figures(rows, counts, share)
    shared = rows.sparkSession.sparkContext.broadcast((counts, *figures))

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, given, smallest = shared.value
        for batch in batches:
            words, owner, place, sizes = _ranked(batch.column(2), counts)
            at = _buckets(words)
            kept = place <= (sizes - _least(sizes, share))[owner]
            head = place <= (sizes - _least(sizes, 2 * share / (1 + share)))[owner]
            rest = (sizes[owner] - place) * (1 + share) / share - sizes[owner] + 1e-6
            kept &= head | (smallest[at] <= rest)
            rows = np.flatnonzero(kept)
            blocks = np.maximum(-(-given[at[rows]] // part), 1)
            rows, blocks = np.repeat(rows, blocks), np.repeat(blocks, blocks)
            other = np.arange(len(rows)) - np.searchsorted(rows, rows)
            points = batch.column(1).to_numpy()
            mine = ((points.view(np.uint64) >> np.uint64(7))[owner[rows]] % blocks.astype(np.uint64)).astype(np.int64)
            i, j = np.minimum(mine, other), np.maximum(mine, other)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(words))
            for start in range(0, len(rows), 10_000):
                some = rows[start : start + 10_000]
                cut = slice(start, start + 10_000)
                columns = [batch.column(0).take(pa.array(owner[some])), pa.array(words[some]), pa.array(i[cut].astype(np.int32)), pa.array(j[cut].astype(np.int32)), pa.array(mine[cut].astype(np.int32)), pa.array(place[some].astype(np.int32)), pa.array(points[owner[some]]), lists.take(pa.array(owner[some]))]
                yield pa.record_batch(columns, ["scope", "word", "i", "j", "mine", "place", "point", "words"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def work() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            scope, word, i, j, mine, place, points = (table.column(k).to_numpy() for k in range(7))
            group = np.cumsum(np.r_[False, (np.diff(scope) != 0) | (word[1:] != word[:-1]) | (np.diff(i) != 0) | (np.diff(j) != 0)])
            x, y = _joined(group, place.astype(np.int64), i != j, mine, table.column(7).chunk(0), share)
            return pa.record_batch([pa.array(np.minimum(points[x], points[y])), pa.array(np.maximum(points[x], points[y]))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k).to_numpy() for k in range(4)]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], 0)) + 1
            begins = tuple(k[0] for k in keys) != last
            if sum(b.num_rows for b in held) + batch.num_rows > _MEETING and (begins and held or len(cuts)):
                cut = int(cuts[-1]) if len(cuts) else 0
                if cut:
                    held.append(batch.slice(0, cut))
                yield work()
                held.clear()
                batch = batch.slice(cut)
            held.append(batch)
            last = tuple(k[-1] for k in keys)
        if held:
            yield work()

    keys = ["scope", "word", "i", "j"]
    given = rows.select("scope", "point", "words").mapInArrow(give, "scope int, word int, i int, j int, mine int, place int, point bigint, words array<int>")
    return given.repartition(4 * parallelism(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(meet, "a bigint, b bigint")


def similar_points(assigned: DataFrame, share: float = 0.6, block: int = BLOCK, model: KMeans | None = None, split: int = SPLIT) -> DataFrame:
    """(a, b) of the points that a cluster holds both and whose word sets are similar enough, once each.

    A cluster of more than `split` points is compared by the rare words of its points, which loses no pair.
    """
    spread = assigned.select("point", "words", "clusters", F.explode("clusters").alias("cluster"))
    counts = durable(spread.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")))  # at most MOST_CLUSTERS rows
    big = counts.where(F.col("size") > split)
    divided = not big.isEmpty()
    rows = spread.join(F.broadcast(big.select("cluster")), "cluster", "left_anti") if divided else spread
    blocks = F.ceil(F.col("size") / block).cast("int").alias("blocks")
    cells = rows.join(F.broadcast(counts.select("cluster", blocks)), "cluster")
    mine = F.pmod(F.hash("point"), "blocks")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j")))
    cells = cells.select("cluster", F.explode(others).alias("cell"), mine.alias("mine"), "point", "words", "clusters")

    def inside(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        points, lists, near = (group[c].chunk(0) for c in ("point", "words", "clusters"))
        flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        sets = [flat[s:e] for s, e in zip(offsets[:-1], offsets[1:])]
        mine, i, j, cluster = group["mine"].to_numpy(), group["i"][0].as_py(), group["j"][0].as_py(), group["cluster"][0].as_py()
        a = b = np.arange(len(sets))
        if i != j:
            a, b = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        x, y = _compare(sets, a, b, share)
        if not divided and len(x):
            # The least cluster that both belong to gives the pair.
            tops = near.flatten().to_numpy().reshape(len(sets), -1)
            p, q = tops[x][:, :, None], tops[y][:, None, :]
            first = np.where(p == q, p, np.iinfo(np.int32).max).min((1, 2))
            x, y = x[first == cluster], y[first == cluster]
        ids = points.to_numpy()
        return pa.table({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y])})

    flat = cells.select("cluster", "mine", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "point", "words", "clusters")
    found = flat.repartition(4 * parallelism(flat.sparkSession), "cluster", "i", "j").groupBy("cluster", "i", "j").applyInArrow(inside, "a bigint, b bigint")
    if not divided:
        return found
    hot = spread.join(F.broadcast(big.select("cluster")), "cluster").select(F.col("cluster").alias("scope"), "point", "words")
    return found.unionByName(_by_rare_words(hot, _bucket_counts(assigned), share, PART)).distinct()


def similar_pairs(rows: DataFrame, key: str, text: str, share: float = 0.6, k: int | None = None) -> DataFrame:
    """(key_a, key_b), key_a < key_b, of records whose common words are at least `share` of all words of the two.

    All such pairs are found, whatever the clusters: word sets meet at their rare words. `k` is without effect.
    """
    sets = durable(word_sets(rows, key, text))
    points = distinct_points(sets).withColumn("scope", F.lit(0))
    pairs = _by_rare_words(points, _bucket_counts(points), share, PART)
    members = sets.groupBy("key").agg(F.min("point").alias("point"))
    one, two = members.selectExpr("key AS one", "point AS a"), members.selectExpr("key AS two", "point AS b")
    across = pairs.join(one, "a").join(two, "b").select("one", "two")
    return across.unionByName(_copies(members)).select(F.least("one", "two").alias("key_a"), F.greatest("one", "two").alias("key_b"))


def _copies(members: DataFrame) -> DataFrame:
    """(one, two), one < two: the pairs of keys of one point. Those of a point with many meet in blocks of about `COPIES`."""
    sizes = members.groupBy("point").agg(F.count(F.lit(1)).alias("n"))
    hot = durable(sizes.where(F.col("n") > COPIES))  # at most one point in COPIES rows
    plain = members if hot.isEmpty() else members.join(hot, "point", "left_anti")
    one, two = plain.selectExpr("key AS one", "point AS a"), plain.selectExpr("key AS two", "point AS b")
    pairs = one.join(two, F.col("a") == F.col("b")).where("one < two").select("one", "two")
    if hot.isEmpty():
        return pairs
    blocks = F.ceil(F.col("n") / COPIES).cast("int")
    mine, other = F.pmod(F.hash("key"), blocks), F.explode(F.sequence(F.lit(0), blocks - 1))
    cells = members.join(hot, "point").select("point", "key", mine.alias("mine"), other.alias("other")).select("point", "key", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    left, right = cells.where("mine = i").select("point", "i", "j", F.col("key").alias("x")), cells.where("mine = j").select("point", "i", "j", F.col("key").alias("y"))
    met = left.join(right, ["point", "i", "j"]).where("i < j OR x < y")
    return pairs.unionByName(met.select(F.least("x", "y").alias("one"), F.greatest("x", "y").alias("two")))


def cluster_members(rows: DataFrame, key: str, text: str, k: int | None = None) -> DataFrame:
    """(key, cluster_id, closeness): the cluster of each record with a text; closeness is the cosine to its centroid."""
    sets = durable(word_sets(rows, key, text))
    home = fit(sets, k).assign(1).select("point", F.col("clusters")[0].alias("cluster_id"), "closeness")
    return sets.groupBy("key").agg(F.min("point").alias("point")).join(home, "point").select("key", "cluster_id", F.round("closeness", 6).alias("closeness"))


def cluster_summary(members: DataFrame, rows: DataFrame, key: str, text: str, typical: int = 5) -> DataFrame:
    """(cluster_id, size, rank, key, text, closeness): each cluster's size and the members nearest to its centroid.

    `members` has one row a key, as `cluster_members` gives them. Each task keeps its nearest few of a cluster before
    the exchange, so a hot cluster isn't gathered, and only the texts of the nearest are looked up: at most
    `typical` for each of `MOST_CLUSTERS` clusters, which is what is broadcast.
    """
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    salted = W.partitionBy("cluster_id", F.pmod(F.hash("key"), F.lit(64))).orderBy(F.desc("closeness"), "key")
    final = W.partitionBy("cluster_id").orderBy(F.desc("closeness"), "key")
    first = members.select("cluster_id", "key", "closeness").withColumn("r", F.row_number().over(salted)).where(F.col("r") <= typical)
    top = durable(first.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= typical).join(sizes, "cluster_id"))
    named = rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).join(F.broadcast(top.select("key")), "key", "left_semi")
    return top.join(named.groupBy("key").agg(F.min("text").alias("text")), "key").select("cluster_id", "size", "rank", "key", "text", "closeness")
