"""Items packed into containers of fixed capacity (problem 7).

Each text is measured in tokens of a public tokenizer; one longer than a container is split into
pieces of `capacity` tokens and a rest, and nothing else is split. Pieces fall into random groups by a
hash; each group is packed by first fit decreasing, where a tournament tree over the free space of the
bins gives the first bin that fits. Pieces stream into the packing sorted by group and size, and a
group that outgrows `most_items` is closed and another begun, so a task never holds more than that.

Defined cases: null and empty texts have no tokens and get no container; repeated rows are items of
their own only if `number` differs, so give rows an own id; equal sizes go in the order of their ids;
other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, MOST_ITEMS, GROUP_ITEMS = 2048, 50_000, 4096
#: Code points of a text that are encoded at a time; the cut falls before a blank, where tokens start.
STRETCH = 200_000


def encoder(path: str, pattern: str):
    """A tiktoken encoding from a file of ranks; special tokens in texts are ordinary text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(encoding, text: str) -> int:
    """Tokens of a text; long ones go stretch by stretch, as the splitter slows on endless words."""
    total = 0
    while len(text) > STRETCH:
        cut = max(text.rfind(" ", 1, STRETCH), text.rfind("\n", 1, STRETCH))
        cut = cut if cut > 0 else STRETCH
        total += len(encoding.encode_ordinary(text[:cut]))
        text = text[cut:]
    return total + len(encoding.encode_ordinary(text))


def measure(documents: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) of each row; null texts have 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(path, pattern)
        for batch in batches:
            sizes = [token_count(encoding, t.as_py()) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], ["item", "n_tokens"])

    return documents.select(F.col(key).cast("bigint").alias("item"), F.col(text).cast("string").alias("text")).mapInArrow(scan, "item bigint, n_tokens bigint")


class Tournament:
    """Bins by number, each node holding the most free space below it."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.leaves, self.tree, self.used = capacity, 1, [0, capacity], 0

    def place(self, size: int) -> int:
        """The first bin with room for `size`, which then has that much less."""
        if self.tree[1] < size:
            self._double()
        node, tree = 1, self.tree
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        tree[node] -= size
        number = node - self.leaves
        self.used = max(self.used, number + 1)
        while node > 1:
            node //= 2
            left, right = tree[2 * node], tree[2 * node + 1]
            most = left if left > right else right
            if tree[node] == most:
                break
            tree[node] = most
        return number

    def _double(self) -> None:
        old, n = self.tree, self.leaves
        self.leaves = 2 * n
        self.tree = [self.capacity] * (4 * n)
        level, width = 1, 1
        while width <= n:
            self.tree[2 * level : 2 * level + width] = old[level : level + width]
            level, width = 2 * level, 2 * width
        self.tree[0] = 0


def pack(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, most_items: int = MOST_ITEMS, seed: int = 11) -> DataFrame:
    """(item, piece, start_token, n_tokens, container_id, place) for rows (item, n_tokens).

    `container_id` is group:part:bin; `place` is the order within the container.
    """
    rest = F.col("n_tokens") % capacity
    whole = F.floor(F.col("n_tokens") / capacity).cast("int")
    count = whole + F.when(rest > 0, 1).otherwise(0)
    pieces = items.where("item IS NOT NULL AND n_tokens > 0").select("item", "n_tokens", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    pieces = pieces.select("item", "piece", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("size"))
    n = items.where("n_tokens > 0").count()
    groups = max(1, -(-n // group_items))
    grouped = pieces.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "item", "piece", "size"), F.lit(groups)).cast("int"))
    parts = max(1, min(groups, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ordered = grouped.repartition(parts, "group").sortWithinPartitions("group", F.desc("size"), "item", "piece").select("group", "item", "piece", "size")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, part, held, tree, places = None, 0, 0, None, {}
        for batch in batches:
            names, order = [], []
            for g, size in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if g != group:
                    group, part, held, tree, places = g, 0, 0, Tournament(capacity), {}
                elif held >= most_items:
                    part, held, tree, places = part + 1, 0, Tournament(capacity), {}
                held += 1
                b = tree.place(size)
                places[b] = places.get(b, -1) + 1
                names.append(f"{g}:{part}:{b}")
                order.append(places[b])
            starts = [p * capacity for p in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array(starts, pa.int64()), batch.column(3), pa.array(names, pa.string()), pa.array(order, pa.int32())], ["item", "piece", "start_token", "n_tokens", "container_id", "place"])

    return ordered.mapInArrow(fill, "item bigint, piece int, start_token bigint, n_tokens int, container_id string, place int")


def filling(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, pieces, tokens, unused, filled, least_containers) of the rows of `pack`: one row.

    `filled` is the share of the capacity in use, null without containers; no packing needs fewer than `least_containers`.
    """
    each = packed.groupBy("container_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    whole = each.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    room = F.col("containers") * capacity
    return whole.select("containers", "pieces", "tokens", (room - F.col("tokens")).alias("unused"), F.round(F.col("tokens") / F.nullif(room, F.lit(0)), 6).alias("filled"), F.ceil(F.col("tokens") / capacity).alias("least_containers"))
