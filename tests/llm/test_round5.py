import numpy as np
import pandas as pd

from attestra.llm import near_vectors
from attestra.llm.hnsw import Graph


def _crowd(n: int, group: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 24))
    x[:group] = x[0] + rng.normal(scale=0.05, size=(group, 24))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_a_beam_of_links_alone_is_not_widened(monkeypatch):
    graph, _ = Graph.build(_crowd(1500, 400))
    widths, search = [], Graph.search
    monkeypatch.setattr(Graph, "search", lambda self, q, ef: widths.append(ef) or search(self, q, ef))
    a, b, sims = near_vectors.links_of(graph, graph.x, 0.95, 16)
    want = graph.x @ graph.x.T >= 0.95
    assert len(a) == want.sum() and want[a, b].all() and want.sum() > 400 * 100
    assert [len(v) for v in near_vectors.links_of(graph, graph.x[:0], 0.95, 16)] == [0, 0, 0]
    assert widths == [16] and np.allclose(sims, (graph.x[a] * graph.x[b]).sum(1), atol=1e-5)


def test_the_audit_tries_one_beam_at_a_time(spark, monkeypatch):
    x = _crowd(600, 60)
    ids = np.arange(600, dtype=np.int64)
    graphs = near_vectors._graphs("<f4")(pd.DataFrame({"id": ids, "v": list(x), "copies": 1, "dim": 24, "shard": 0}))
    sample = spark.sparkContext.broadcast({24: (ids, x)})
    assert len(next(near_vectors._audit(sample, 0.95, 2)([graphs]))) == 1
    tried, audit = [], near_vectors._audit
    monkeypatch.setattr(near_vectors, "_audit", lambda s, least, ef: tried.append(ef) or audit(s, least, ef))
    classes = spark.createDataFrame([(int(i), v.tolist(), 24) for i, v in zip(ids, x, strict=True)], "id long, v array<float>, dim int")
    shards = spark.createDataFrame(graphs, "dim int, shard long, graph binary")
    beam, links, recall = near_vectors.choose_beam(classes, shards, 600, 0.95, 48, 0.99)
    assert links > 100 and recall >= 0.99 and tried == [48 << k for k in range(len(tried))] and tried[-1] == beam


def test_pairs_that_unite(spark):
    rng = np.random.default_rng(2)
    for n in (1, 30, 300):
        src, dst = rng.integers(0, 100, n), rng.integers(0, 100, n)
        label = np.arange(100)
        for _ in range(100):
            for a, b in zip(src, dst, strict=True):
                label[a] = label[b] = min(label[a], label[b])
        got = near_vectors._union(src, dst)
        used = np.unique(np.concatenate([src, dst]))
        assert sorted(map(tuple, got.tolist())) == sorted((int(v), int(label[v])) for v in used if label[v] != v)
    assert near_vectors._union(np.empty(0, np.int64), np.empty(0, np.int64)).shape == (0, 2)
