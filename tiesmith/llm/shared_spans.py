"""Long verbatim spans shared between records (problem 9).

The FM-index per shard that the problem names streams every document against every shard,
so its work grows with the square of the corpus; the README has figures. Here instead:

1. Records with the same text are one representative; copies come back at the end.
2. Winnowing: in each window of `span - gram + 1` consecutive grams of `gram` code points, the
   gram with the least hash is an anchor. A shared run of `span` code points contains a whole
   window, so both records keep the same anchor: no run can be lost.
3. Records that share an anchor are candidates. An anchor that more than `HOT` texts share gives
   way to longer ones: what a run has beyond the anchor reaches at least half way to one side, so
   each place is anchored anew with that half to the left and to the right, until the anchors are rare or `span`
   code points long. Stock phrases shorter than `span` thus never pair the texts that hold them.
4. Every candidate pair is decided exactly: all grams of `span` code points of both texts are
   hashed and compared, and a hit is confirmed on the texts themselves.
5. How much of a text stands elsewhere needs no pairs. Around each shared anchor a text gives one hash of all
   that a run through it can hold; where another text gives the same, all runs through it are shared. Only at
   anchors where some text has no such match, near the ends of shared runs, is each gram of `span` code points asked for.

Defined cases: null texts and texts under `span` code points share nothing; rows repeated with
the same id and text are one record; rows of one id with other texts are parts of one record and
give no pair with themselves; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tiesmith.session import durable

_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 4_000_000


def _inverse(value: int) -> int:
    return pow(value, -1, 1 << 64)


class Rolling:
    """Hashes of all grams of one length, mod 2^64, then mixed."""

    def __init__(self, gram: int) -> None:
        self.gram, self.powers, self.inverses = gram, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = 1 << (n - 1).bit_length()
            base = np.full(size, _STEP, np.uint64)
            base[0] = 1
            self.powers = np.multiply.accumulate(base)
            base[1:] = np.uint64(_inverse(int(_STEP)))
            self.inverses = np.multiply.accumulate(base)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes)
        if n < self.gram:
            return np.zeros(0, np.uint64)
        self._grow(n + 1)
        x = codes.astype(np.uint64) + np.uint64(1)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x *= self.powers[:n]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x, out=sums[1:])
        out = sums[self.gram :] - sums[: -self.gram]
        out *= self.inverses[: len(out)]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(29)
        return out


def codes(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_least(values: np.ndarray, window: int) -> np.ndarray:
    """Least value of each `window` consecutive ones: block prefixes and suffixes, two passes."""
    n = len(values)
    if n <= window:
        return values.min(keepdims=True)
    padded = np.full(-(-n // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, window)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - window + 1], before[window - 1 : n])


def anchors(text: str, span: int, gram: int, rolling: Rolling) -> np.ndarray:
    """The distinct anchor hashes of a text, however long; none if it is shorter than `span`."""
    if len(text) < span:
        return np.zeros(0, np.int64)
    window, kept = span - gram + 1, []
    for start in range(0, max(1, len(text) - span + 1), _CHUNK):
        least = window_least(rolling(codes(text[start : start + _CHUNK + span - 1])), window)
        kept.append(np.unique(least[np.r_[True, least[1:] != least[:-1]]]))
    return np.unique(np.concatenate(kept)).view(np.int64)


def common(a: str, b: str, span: int, grams_a: tuple[np.ndarray, np.ndarray], grams_b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts in a, and in b, of grams of `span` code points that stand in the other text too."""
    none = np.zeros(0, np.int64)

    def held(these: np.ndarray, those: np.ndarray) -> np.ndarray:
        return those[np.minimum(np.searchsorted(those, these), len(those) - 1)] == these

    (hash_a, at_a), (hash_b, at_b) = grams_a, grams_b
    small, large = (hash_a, hash_b) if len(hash_a) <= len(hash_b) else (hash_b, hash_a)
    if not held(small, large).any():
        return none, none
    at_a, at_b = np.sort(at_a[held(hash_a, hash_b)]), np.sort(at_b[held(hash_b, hash_a)])
    p = int(at_a[0])
    if a[p : p + span] not in b:  # a chance collision of 64 bits: compare the texts themselves
        at_a = np.array([i for i in at_a if a[i : i + span] in b], np.int64)
        at_b = np.array([i for i in at_b if b[i : i + span] in a], np.int64)
    return at_a, at_b


def covered(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    """The intervals that grams of `span` code points at sorted starts cover."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > span) + 1
    return [(int(p[0]), int(p[-1]) + span) for p in np.split(starts, cuts)]


def _grams(text: str, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    hashes = rolling(codes(text))
    order = np.argsort(hashes, kind="stable")
    return hashes[order], order


def _representatives(documents: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, rep; texts: rep, text) of the texts that are long enough to share anything."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.length("text") >= span)
    keyed = rows.withColumn("copy", F.unhex(F.md5("text")))
    members = keyed.select("doc_id", "copy").distinct()
    firsts = members.groupBy("copy").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return members, firsts


#: Rows of a key table that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Code points of texts whose grams a task keeps, 16 bytes each, besides those of the pair at hand.
HELD_POINTS = 4_000_000
#: Texts that share an anchor before it gives way to longer ones.
HOT = 256


def _checked(keys: DataFrame) -> DataFrame:
    """Keys, to be broadcast if they are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _keyed(documents: DataFrame, span: int) -> DataFrame:
    return documents.select("text").where(F.length("text") >= span).select(F.xxhash64("text").alias("key"), "text")


def _emit(keys: pa.Array, hashes: list[np.ndarray]) -> pa.RecordBatch:
    owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    return pa.record_batch([pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64)), keys.take(pa.array(owner))], ["anchor", "key"])


def _several(found: DataFrame, by: str) -> DataFrame:
    """Distinct (by, key, ...) rows whose `by` several texts hold.

    Least and greatest key tell what is shared from what stands in one text and its copies, and are added up in each task.
    """
    several = durable(found.groupBy(by).agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select(by))
    return durable(found.join(_checked(several), by, "left_semi").distinct())


def _shared(found: DataFrame) -> DataFrame:
    """Distinct (anchor, key, texts) of the anchors that several texts hold; `texts` counts them."""
    rows = _several(found, "anchor")
    return rows.join(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("texts")), "anchor")


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs of the texts of each anchor; the texts of a hot one meet in blocks of about `HOT`."""
    blocks = F.ceil(F.col("texts") / HOT).cast("int")
    mine, other = F.pmod(F.hash("key"), blocks), F.explode(F.sequence(F.lit(0), blocks - 1))
    cells = rows.select("anchor", "key", mine.alias("mine"), other.alias("other")).select("anchor", "key", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    one, two = cells.where("mine = i").select("anchor", "i", "j", F.col("key").alias("one")), cells.where("mine = j").select("anchor", "i", "j", F.col("key").alias("two"))
    return one.join(two, ["anchor", "i", "j"]).where("i < j OR one < two").select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))


def _longer(documents: DataFrame, hot: DataFrame, span: int, gram: int, reach: int) -> DataFrame:
    """(anchor, key): the places of hot anchors, anchored anew with `reach` more code points to the left and to the right."""
    texts = _keyed(documents, span).join(_checked(hot.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"])
    held = texts.join(hot.groupBy("key").agg(F.collect_set("anchor").alias("anchors")), "key")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, long = Rolling(gram), Rolling(gram + reach)
        for batch in batches:
            out = []
            for text, given in zip(batch.column(1), batch.column(2)):
                points = codes(text.as_py())
                at = np.flatnonzero(np.isin(short(points).view(np.int64), given.values.to_numpy()))
                grown = long(points).view(np.int64)
                starts = np.concatenate([at, at - reach])
                out.append(np.unique(grown[starts[(starts >= 0) & (starts < len(grown))]]))
            yield _emit(batch.column(0), out)

    return held.select("key", "text", "anchors").mapInArrow(scan, "anchor bigint, key bigint")


def _anchored(documents: DataFrame, span: int, gram: int) -> DataFrame:
    """(anchor, key) of each text that is long enough, stored once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(gram)
        for batch in batches:
            yield _emit(batch.column(0), [anchors(t.as_py(), span, gram, rolling) for t in batch.column(1)])

    return durable(_keyed(documents, span).mapInArrow(scan, "anchor bigint, key bigint"))


def _candidates(documents: DataFrame, span: int, gram: int) -> DataFrame:
    """Distinct pairs (a < b) of 64-bit text keys that share an anchor no text is too many for."""
    rows = durable(_shared(_anchored(documents, span, gram)))
    out = []
    while gram < span:
        hot = rows.where(F.col("texts") > HOT)
        if hot.isEmpty():
            break
        out.append(_pairs(rows.where(F.col("texts") <= HOT)))
        reach = -(-(span - gram) // 2)
        rows = durable(_shared(_longer(documents, hot, span, gram, reach)))
        gram += reach
    out.append(_pairs(rows))
    pairs = out[0]
    for more in out[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def shared_runs(documents: DataFrame, span: int = 200, gram: int = 130) -> DataFrame:
    """(a, b, in_a, in_b): MD5 sums of texts with a common run and the intervals of each that the other holds."""
    pairs = durable(_candidates(documents, span, gram))
    needed = _checked(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
    texts = _keyed(documents, span).join(needed, "key", "left_semi").select("key", F.unhex(F.md5("text")).alias("copy"), "text").dropDuplicates(["copy"])
    one, two = (texts.select(F.col("key").alias(k), F.col("copy").alias(f"copy_{k}"), F.col("text").alias(f"text_{k}")) for k in "ab")
    sides = pairs.join(one, "a").join(two, "b")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, held, size = Rolling(span), {}, 0
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

        def grams(copy: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
            nonlocal size
            if copy not in held:
                size += len(text)
                while held and size > HELD_POINTS:
                    size -= len(held.pop(next(iter(held)))[0]) + span - 1
                held[copy] = _grams(text, rolling)
            return held[copy]

        for batch in batches:
            keep, ins = [], ([], [])
            for row, (a, b, text_a, text_b) in enumerate(zip(*batch.columns)):
                text_a, text_b = text_a.as_py(), text_b.as_py()
                at = common(text_a, text_b, span, grams(a.as_py(), text_a), grams(b.as_py(), text_b))
                if len(at[0]):
                    keep.append(row)
                    for side, starts in zip(ins, at):
                        side.append([{"start": s, "stop": e} for s, e in covered(starts, span)])
            took = pa.array(keep, pa.int32())
            yield pa.record_batch([batch.column(0).take(took), batch.column(1).take(took), *(pa.array(s, kind) for s in ins)], ["a", "b", "in_a", "in_b"])

    kind = "array<struct<start:int,stop:int>>"
    return sides.select("copy_a", "copy_b", "text_a", "text_b").mapInArrow(decide, f"a binary, b binary, in_a {kind}, in_b {kind}")


def shared_pairs(documents: DataFrame, span: int = 200, gram: int = 130) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: all pairs of records that share a verbatim run of `span` code points."""
    members, _ = _representatives(documents, span)
    runs = durable(shared_runs(documents, span, gram).select("a", "b"))
    a, b = members.selectExpr("copy AS a", "doc_id AS one"), members.selectExpr("copy AS b", "doc_id AS two")
    across = runs.join(a, "a").join(b, "b").select("one", "two")
    copies = a.join(b, F.col("a") == F.col("b")).select("one", "two")
    ordered = across.unionByName(copies).where("one <> two")
    return ordered.select(F.least("one", "two").alias("doc_id_a"), F.greatest("one", "two").alias("doc_id_b")).distinct()


def _runs_of(places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the unions of [p, p + length) over sorted places."""
    if not len(places):
        return places, places
    cuts = np.flatnonzero(np.diff(places) > length)
    return places[np.r_[0, cuts + 1]], places[np.r_[cuts, len(places) - 1]] + length


def _marked(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of n places lie in any [start, stop)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.clip(starts, 0, n), 1)
    np.add.at(steps, np.clip(stops, 0, n), -1)
    return np.cumsum(steps[:n]) > 0


def _shared_intervals(documents: DataFrame, span: int, gram: int) -> DataFrame:
    """(key, start, stop): stretches of texts, by 64-bit key, that other texts hold in runs of `span` code points or more."""
    reach = span - gram
    lists = durable(_several(_anchored(documents, span, gram), "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors")))
    texts = _keyed(documents, span).join(_checked(lists.select("key")), "key", "left_semi").dropDuplicates(["key"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shared anchors with the hash of the `reach` code points before, themselves and the `reach` after; null where a text ends before."""
        short, long = Rolling(gram), Rolling(gram + 2 * reach)
        for batch in batches:
            for key, text, given in zip(*batch.columns):
                points = codes(text.as_py())
                small, large = short(points).view(np.int64), long(points).view(np.int64)
                at = np.flatnonzero(np.isin(small, given.values.to_numpy()))
                cut = (at < reach) | (at - reach >= len(large))
                whole = np.zeros(len(at), np.int64)
                whole[~cut] = large[at[~cut] - reach]
                yield pa.record_batch([pa.array(np.full(len(at), key.as_py())), pa.array(small[at]), pa.array(whole, mask=cut)], ["key", "anchor", "whole"])

    rows = durable(texts.join(lists, "key").select("key", "text", "anchors").mapInArrow(around, "key bigint, anchor bigint, whole bigint").distinct())
    sure = durable(rows.where("whole IS NOT NULL").groupBy("whole").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("whole", F.lit(True).alias("sure")))
    judged = durable(rows.join(sure, "whole", "left"))
    # An anchor that is not sure somewhere is asked for by all that hold it, or no one would answer.
    doubtful = judged.join(_checked(judged.where("sure IS NULL").select("anchor").distinct()), "anchor", "left_semi")
    known = judged.where("sure").groupBy("key").agg(F.collect_set("whole").alias("wholes"))
    asking = doubtful.groupBy("key").agg(F.collect_set("anchor").alias("doubts"))
    held = durable(known.join(asking, "key", "full_outer"))

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches that are known to be shared (stop is set), and the grams to ask for (hash is set)."""
        short, long, full = Rolling(gram), Rolling(gram + 2 * reach), Rolling(span)
        none = np.zeros(0, np.int64)
        for batch in batches:
            for key, text, wholes, doubts in zip(*batch.columns):
                points = codes(text.as_py())
                sure = np.flatnonzero(np.isin(long(points).view(np.int64), wholes.values.to_numpy())) if wholes.is_valid else none
                starts, stops = _runs_of(sure, gram + 2 * reach)
                grams, ask = full(points).view(np.int64), none
                if doubts.is_valid:
                    small, given = short(points), doubts.values.to_numpy()
                    at = np.flatnonzero(np.isin(small.view(np.int64), given))
                    ask = np.flatnonzero(np.isin(window_least(small, reach + 1).view(np.int64), given) & _marked(len(grams), at - reach, at + 1))
                n, m = len(starts), len(ask)
                known = np.r_[np.ones(n, bool), np.zeros(m, bool)]
                columns = [pa.array(np.full(n + m, key.as_py())), pa.array(np.r_[starts, ask].astype(np.int32)), pa.array(np.r_[stops, ask].astype(np.int32), mask=~known), pa.array(np.r_[np.zeros(n, np.int64), grams[ask]], mask=known)]
                yield pa.record_batch(columns, ["key", "start", "stop", "hash"])

    schema = "key bigint, start int, stop int, hash bigint"
    found = durable(texts.join(held, "key").select("key", "text", "wholes", "doubts").mapInArrow(apart, schema))
    asked = _several(found.where("hash IS NOT NULL").select("hash", "key", "start"), "hash")
    return found.where("stop IS NOT NULL").select("key", "start", "stop").unionByName(asked.select("key", "start", (F.col("start") + span).alias("stop")))


def shared_share(documents: DataFrame, span: int = 200, gram: int = 130) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_ratio) of each distinct record with a text that isn't null.

    `shared_chars` counts the code points that lie in a run of `span` or more which another record
    also holds; a text with a copy under another id is shared wholly. No pairs are made, so a passage of
    any number of records costs as much as so many different ones; `shared_pairs` has the partners.
    Equal hashes of 64 bits are taken for equal runs.
    """
    before = W.partitionBy("key").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.lit(0)))
    chars = _shared_intervals(documents, span, gram).withColumn("fresh", F.greatest(F.lit(0), fresh)).groupBy("key").agg(F.sum("fresh").alias("chars"))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL")
    rows = rows.select("doc_id", F.xxhash64("text").alias("key"), F.length("text").cast("bigint").alias("n_chars")).distinct()
    copies = rows.where(F.col("n_chars") >= span).groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key", F.lit(True).alias("copied"))
    joined = rows.join(copies, "key", "left").join(chars, "key", "left")
    shared = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("chars", F.lit(0))).cast("bigint")
    return joined.select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(0.0).alias("shared_ratio"))
