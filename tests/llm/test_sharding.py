import zlib

import numpy as np
import pytest

from weftline.llm import queries, sharding


def check(rows, got, shards=8):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert {r.law for r in got} <= {"bytes"} and {r.grown_shard for r in got} <= {None}
    slots, size = {}, [0] * shards
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return size


def test_balance_and_groups(clashing):
    rows = [(i, f"text {i % 150} " + "word " * (i % 150 * 7 % 90)) for i in range(600)]
    got = sharding.shard(clashing(rows)).collect()
    size = check(rows, got)
    assert max(size) <= 1.05 * sum(size) / 8
    where = {}
    text = dict(rows)
    for r in got:
        where.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_a_text_too_frequent_for_a_shard(docs):
    rows = [(i, "the same text " * 9) for i in range(300)] + [(1000 + i, f"own {i} " * 20) for i in range(600)]
    got = sharding.shard(docs(rows)).collect()
    size = check(rows, got)
    assert max(size) <= 1.06 * sum(size) / 8


@pytest.mark.parametrize("hot", [7, None])
def test_a_cut_group_of_one_id(docs, hot):
    rows = [(hot, "the same text " * 9)] * 3000 + [(1000 + i, f"own {i} " * 20) for i in range(6000)]
    size = check(rows, sharding.shard(docs(rows)).collect())
    assert max(size) <= 1.05 * sum(size) / 8


def plain_place(sizes, shards):
    """Largest first, each to the shard of the highest dot product with what is free."""
    cap = [sum(s[m] for s in sizes) / shards or 1.0 for m in range(3)]
    load, out = [[0.0] * 3 for _ in range(shards)], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-max(sizes[i][m] / cap[m] for m in range(3)), i)):
        dots = [sum(sharding.WEIGHTS[m] * sizes[i][m] / cap[m] * (1 - load[k][m] / cap[m]) for m in range(3)) for k in range(shards)]
        out[i] = k = max(range(shards), key=lambda k: (dots[k], -k))
        for m in range(3):
            load[k][m] += sizes[i][m]
    return [out[i] for i in range(len(sizes))]


def test_placement_against_a_plain_version():
    rng = np.random.default_rng(5)
    for n, shards in ((1, 8), (40, 3), (200, 8)):
        sizes = rng.integers(1, 10_000, (n, 3)).astype(float)
        cap = sizes.sum(axis=0) / shards
        assert sharding.place(sizes, np.zeros((shards, 3)), cap).tolist() == plain_place(sizes.tolist(), shards)


def test_edge_cases(docs):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b"), (4, "x" * 300_000)]
    check(rows, sharding.shard(docs(rows)).collect())
    assert sharding.shard(docs([])).collect() == []


def test_query_on_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, sf).collect()]
    size = check(rows, queries.op6_sharding(spark, sf).collect())
    assert max(size) <= 1.05 * sum(size) / 8
