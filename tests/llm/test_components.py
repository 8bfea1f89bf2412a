"""Connected components and SimHash classes against plain versions."""

import collections
import random

import numpy as np
import pandas as pd
import pytest

from tracewell.llm import graph, simhash


def naive_components(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize("order", ["random", "comb"])
def test_long_chains(spark, order):
    n = 500
    ids = list(range(n))
    if order == "random":
        random.Random(4).shuffle(ids)
    else:  # large and small ids in turn
        ids = [i // 2 if i % 2 else n - 1 - i // 2 for i in range(n)]
    edges = list(zip(ids[:-1], ids[1:])) + [(n, n + 1), (n + 2, n + 2)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(ids, 0), n: n, n + 1: n}


def test_hubs_and_repeated_edges(spark):
    rng = np.random.default_rng(5)
    edges = [(7, int(i)) for i in rng.integers(0, 200, 150)] + [(int(a), int(b)) for a, b in rng.integers(200, 400, (120, 2))]
    want = naive_components(400, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges * 2, "a long, b long")).collect()}
    assert got == {x: want[x] for x in linked}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("part", [4096, 64, 4])
def test_links_of_hot_shards(spark, monkeypatch, part):
    """Shards whole, cut by the other bits, and dealt into parts give the same components."""
    rng = np.random.default_rng(6)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    flips = [seeds[int(s)] ^ np.uint64(1 << int(a) | 1 << int(b) | 1 << int(c)) for s, a, b, c in np.column_stack([rng.integers(0, 3, 300), rng.integers(0, 64, (300, 3))])]
    values = np.unique(np.concatenate([seeds, np.array(flips, np.uint64)]))
    monkeypatch.setattr(simhash, "PART", part)
    df = spark.createDataFrame(pd.DataFrame({"print": values.view(np.int64)}))
    got = {r.node: r.component for r in graph.connected_components(simhash.links(df)).collect()}
    near = [(i, int(j)) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3)]
    groups = collections.defaultdict(set)
    for i, c in naive_components(len(values), near).items():
        groups[c].add(int(values.view(np.int64)[i]))
    for g in groups.values():
        assert {got.get(v, v) for v in g} == {min(g)}


def test_component_of_every_document(spark):
    """component_id of all documents of a table against all pairs of fingerprints."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = simhash.near_duplicates(docs).collect()
    prints = np.array([int(r.fingerprint, 16) for r in rows], np.uint64)
    near = [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3)]
    least = {}
    for i, c in naive_components(len(rows), near).items():
        least[c] = min(least.get(c, rows[i].doc_id), rows[i].doc_id)
    assert [r.component_id for r in rows] == [least[c] for c in naive_components(len(rows), near).values()]
