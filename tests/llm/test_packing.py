import os
import random
from collections import defaultdict

import pytest

from tiesmith.llm import packing as p

TOKENIZERS = os.environ.get("TIESMITH_TOKENIZERS", "/opt/tokenizers")


def test_tournament_against_first_fit():
    rng = random.Random(1)
    tree, free = p.Tournament(100), []
    for _ in range(500):
        size = rng.randrange(1, 101)
        at = next((k for k, f in enumerate(free) if f >= size), len(free))
        if at == len(free):
            free.append(100)
        free[at] -= size
        assert tree.place(size) == at
    assert tree.used == len(free)


def test_containers(spark):
    rng = random.Random(2)
    sizes = {k: rng.choice([0, 1, 5, 2048, 2049, 5000, rng.randrange(1, 2000)]) for k in range(400)}
    df = spark.createDataFrame([(k, n, "x") for k, n in sizes.items()] + [(None, 5, "x"), (900, None, "x")], "item bigint, n_tokens bigint, piece string")
    rows = p.pack(df, group_items=100).collect()
    held, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        held[r.container_id].append(r.n_tokens)
        pieces[r.item].append((r.start_token, r.n_tokens))
    assert all(sum(v) <= 2048 for v in held.values())
    assert set(pieces) == {k for k, n in sizes.items() if n}
    for k, parts in pieces.items():
        parts.sort()
        assert sum(n for _, n in parts) == sizes[k] and all(n == 2048 for _, n in parts[:-1]) and (len(parts) == 1 or sizes[k] > 2048)
        assert [s for s, _ in parts] == [2048 * j for j in range(len(parts))]
    assert sum(map(sum, held.values())) >= 0.9 * 2048 * (len(held) - 8)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, p.pack(df, group_items=100).collect()))


def test_large_groups_are_closed(spark):
    df = spark.createDataFrame([(7, 300)] * 100, "item bigint, n_tokens bigint")
    rows = p.pack(df, most_items=10).collect()
    assert len(rows) == 100 and len({r.container_id.rsplit(":", 1)[0] for r in rows}) >= 10


def test_filling(spark):
    packed = p.pack(spark.createDataFrame([(k, n) for k, n in enumerate([2048, 1500, 500, 2000, 5000])], "item bigint, n_tokens bigint"))
    row = p.filling(packed).head()
    assert (row.containers, row.pieces, row.tokens, row.unused, row.filled, row.least_containers) == (6, 7, 11048, 6 * 2048 - 11048, round(11048 / 12288, 6), 6)
    none = p.filling(packed.limit(0)).head()
    assert (none.containers, none.unused, none.filled) == (0, 0, None)


def test_nothing(spark):
    assert p.pack(spark.createDataFrame([], "item bigint, n_tokens bigint")).count() == 0


@pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no tokenizer files")
def test_measure(spark):
    import public_tokenizers

    path = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    encoding = p.encoder(path, public_tokenizers.PATTERN)
    texts = ["Hello world", "", None, "<|endoftext|>", "word " * 100_000, "x" * 300_000, "日本語 ünï"]
    got = {r.item: r.n_tokens for r in p.measure(spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, item string"), path, public_tokenizers.PATTERN).collect()}
    assert got[1] == got[2] == 0 and got[3] > 1
    for k in (0, 3, 4, 6):
        assert got[k] == len(encoding.encode_ordinary(texts[k]))
    assert got[5] > 0
