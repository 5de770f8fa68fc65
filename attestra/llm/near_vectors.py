"""Embedding near-dedup over sharded HNSW graphs.

Equal vectors are one class. Classes are dealt to shards by a hash and each shard gets a graph. An audit searches a
sample of classes in every shard and by brute force, and doubles the beam until the wanted share of the sample's true
links is found; the sample itself grows until it holds a stated number of them. Then all classes, in blocks, query
every shard: a task loads a graph once and blocks stream past it. A query whose beam holds links alone is multiplied
with the whole shard. What is found counts by cosine in double precision on the original vectors; a task sends each
query's number of links and only pairs that join components, which are united across tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.hnsw import Graph
from attestra.llm.vectors import cosines, kind_of, matrix, pick, typed, unit, valid
from attestra.operators.graph import connected_components
from attestra.runtime import discard, materialise, small_batches

#: Shards at least, and the bytes of a shard's vectors and neighbour lists on average.
MIN_SHARDS = 4
SHARD_BYTES = 64 << 20
#: Classes of a query block, blocks that one load of a graph serves at most, and tasks to aim at where there is less.
QUERY_BLOCK = 2048
CHUNK_BLOCKS = 256
TASKS = 64
#: Classes audited at first and at most, and the true links that an audit must see unless it holds all it may.
AUDIT_ROWS, AUDIT_MOST, AUDIT_LINKS = 512, 8192, 100
#: Single precision may be off by so much; candidates as near to the threshold are verified in double precision.
SLACK = 1e-4
#: Similarities that a product with a whole shard holds at once (16 MB).
PRODUCT_CELLS = 4_000_000
#: A class of more copies than this share of all rows gets its result by a broadcast, so there are at most 1000 of them.
HOT_SHARE = 0.001


def _graphs(kind: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = matrix(pdf["v"])
        g, order = Graph.build(unit(x).astype(np.float32))
        small = [near.astype(np.int32) for near in g.layers]
        blob = pickle.dumps((pdf["id"].to_numpy()[order], pdf["copies"].to_numpy()[order], x[order].astype(kind), small))
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "graph": [blob]})

    return run


def _load(blob: bytes) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """The graph, ids, copies and original vectors of its nodes."""
    ids, copies, x, layers = pickle.loads(blob)
    return Graph(unit(x.astype(np.float64)).astype(np.float32), [near.astype(np.int64) for near in layers]), ids, copies, x


def _union(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Pairs (id, smallest id of its component) that join what the given pairs join; smallest ids themselves have none."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    s, d = at[: len(src)], at[len(src) :]
    boss = np.arange(len(nodes))
    while len(s):
        u, v = boss[s], boss[d]
        apart = u != v
        s, d, u, v = s[apart], d[apart], u[apart], v[apart]
        np.minimum.at(boss, np.maximum(u, v), np.minimum(u, v))
        while (boss[boss] != boss).any():
            boss = boss[boss]
    under = np.flatnonzero(boss != np.arange(len(nodes)))
    return np.stack([nodes[under], nodes[boss[under]]], 1)


def _whole(graph: Graph, q: np.ndarray, rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, similarity) of all links of some queries of a block, from products with the whole shard."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
    step = max(1, PRODUCT_CELLS // len(graph.x))
    for i in range(0, len(rows), step):
        sims = q[rows[i : i + step]] @ graph.x.T
        r, c = np.nonzero(sims >= least)
        out.append((rows[i + r], c, sims[r, c]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def links_of(graph: Graph, q: np.ndarray, least: float, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, similarity) at ``least`` or more as far as found; a query whose beam holds links alone may have any
    number of them and is multiplied with the whole shard, as a beam wide enough would cost the square of that number."""
    if not len(q):
        return _whole(graph, q, np.arange(0), least)
    width = min(ef, len(graph.x))
    ids, sims = graph.search(q, width)
    hit = sims >= least
    full = hit.all(1) if width < len(graph.x) else np.zeros(len(q), bool)
    r, c = np.nonzero(hit & ~full[:, None])
    more = _whole(graph, q, np.flatnonzero(full), least)
    return tuple(np.concatenate(v) for v in zip((r, ids[r, c], sims[r, c]), more, strict=True))


def _audit(sample, least: float, ef: int):
    """(links, found) of a shard for a beam; a vector's match with itself doesn't count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob, dim in zip(pdf["graph"], pdf["dim"], strict=True):
                graph, ids, _, _ = _load(blob)
                qids, q = sample.value.get(int(dim), (np.empty(0, np.int64), np.empty((0, int(dim)), np.float32)))
                n = len(graph.x)
                other = lambda keys: keys[qids[keys // n] != ids[keys % n]]  # noqa: B023, E731
                a, b, _ = _whole(graph, q, np.arange(len(q)), least)
                truth = other(a * n + b)
                a, b, _ = links_of(graph, q, least, ef)
                yield pd.DataFrame({"links": [len(truth)], "found": [int(np.isin(truth, a * n + b).sum())]})

    return run


def choose_beam(classes: DataFrame, graphs: DataFrame, n: int, threshold: float, ef: int, recall: float) -> tuple[int, int, float]:
    """The least beam of ef, 2 ef, 4 ef ... that finds ``recall`` of the sample's true links; those links; the recall.

    The sample are the classes with the smallest hashes, AUDIT_MOST at most, whatever the table's size; the driver
    holds it and it is broadcast. A beam is tried only where all shards together miss too many links of the one before,
    as a search costs about the square of its beam. Without any true link the smallest beam is taken and the recall is 1.
    """
    spark = classes.sparkSession
    rows = AUDIT_ROWS
    while True:
        got = classes.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(rows).select("id", "v", "dim").toPandas()
        sample = {int(d): (p["id"].to_numpy(np.int64), unit(matrix(p["v"])).astype(np.float32)) for d, p in got.groupby("dim")}
        shared = spark.sparkContext.broadcast(sample)

        def seen(width: int) -> tuple[int, int]:
            met = graphs.mapInPandas(_audit(shared, threshold - SLACK, width), "links long, found long")  # noqa: B023
            return tuple(met.agg(F.coalesce(F.sum("links"), F.lit(0)), F.coalesce(F.sum("found"), F.lit(0))).first())

        links, found = seen(ef)
        if links >= AUDIT_LINKS or rows >= min(n, AUDIT_MOST):
            break
        rows *= 4
    for _ in range(11):
        if found >= recall * links:
            break
        ef *= 2
        links, found = seen(ef)
    return ef, links, found / links if links else 1.0


def _search(threshold: float, ef: int, kind: str):
    """Graph rows (kind 0) come ahead of the query blocks (kind 1) that meet them; a task holds one graph at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            for is_query, graph, qids, qv in zip(pdf["kind"], pdf["graph"], pdf["ids"], pdf["vs"], strict=True):
                if not is_query:
                    held = None
                    held = _load(graph)
                    continue
                g, ids, copies, x = held
                qids = np.frombuffer(qids, np.int64)
                q = np.frombuffer(qv, kind).reshape(len(qids), -1).astype(np.float64)
                a, b, sims = links_of(g, unit(q).astype(np.float32), threshold - SLACK, ef)
                keep, ok = sims >= threshold + SLACK, qids[a] != ids[b]
                doubt = np.flatnonzero(ok & ~keep)
                for i in range(0, len(doubt), 50_000):
                    k = doubt[i : i + 50_000]
                    keep[k] = cosines(q[a[k]], x[b[k]].astype(np.float64)) >= threshold
                a, b = a[keep & ok], b[keep & ok]
                others = np.bincount(a, copies[b], len(qids)).astype(np.int64)
                linked = np.flatnonzero(others)
                pairs = _union(qids[a], ids[b])
                yield pd.DataFrame(
                    {"src": np.concatenate([qids[linked], pairs[:, 0]]), "dst": np.concatenate([np.full(len(linked), -1), pairs[:, 1]]),
                     "others": np.concatenate([others[linked], np.zeros(len(pairs), np.int64)])}
                )

    return run


def _blocks(kind: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame(
            {
                "dim": [int(pdf["dim"].iloc[0])], "block": [int(pdf["block"].iloc[0])],
                "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "vs": [matrix(pdf["v"]).astype(kind).tobytes()],
            }
        )

    return run


def _met(graphs: DataFrame, asked: DataFrame, shards: int, chunks: int) -> DataFrame:
    """Graphs and query blocks dealt to (dim, shard, chunk), a graph once a chunk and ahead of its blocks."""
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    nothing = F.lit(None).cast("binary")
    here = asked.select("dim").distinct()
    left = graphs.join(F.broadcast(here), "dim", "left_semi").withColumn("chunk", every(chunks))
    left = left.select("dim", "shard", "chunk", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("block"), "graph", nothing.alias("ids"), nothing.alias("vs"))
    right = asked.withColumn("chunk", F.pmod("block", F.lit(chunks)).cast("long"))
    # a shard without vectors of this length has no graph to meet
    right = right.join(F.broadcast(graphs.select("dim", "shard")), "dim")
    right = right.select("dim", "shard", "chunk", F.lit(1).alias("kind"), "block", nothing.alias("graph"), "ids", "vs")
    keys = ["dim", "shard", "chunk"]
    return left.unionByName(right).repartition(shards * chunks, *keys).sortWithinPartitions(*keys, "kind", "block").select("kind", "graph", "ids", "vs")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, ef: int = 48, recall: float = 0.99
) -> DataFrame:
    """One row a vector: ``id``, ``n_links`` (other vectors at ``threshold`` or nearer), ``component_id``, ``kept``.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with nothing
    and are kept. Vectors of different lengths never link. Rows that repeat an id count as vectors of their own with
    that id. Labels and other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = "<f4" if kind_of(vectors, vector_col) == "array<float>" else "<f8"
    paths = []

    def write(df: DataFrame, label: str) -> DataFrame:
        out, path = materialise(df, label, "zstd")
        paths.append(path)
        return out

    # the smallest id stands for a class; where ids repeat, several classes may have the same one, so a class is numbered
    rows = write(pick(vectors, id_col, vector_col), "vectors")
    classes = rows.groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("copies")).withColumn("dim", F.size("v"))
    classes = write(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    n, widest = classes.agg(F.count("*"), F.max("dim")).first()
    if n:
        shards = max(MIN_SHARDS, -(-n * (int(kind[-1]) * widest + 128) // SHARD_BYTES))
        blocks = max(1, -(-n // QUERY_BLOCK))
        chunks = max(-(-blocks // CHUNK_BLOCKS), min(blocks, -(-TASKS // shards)))
        dealt = classes.select("id", "v", "dim", "copies", F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard"))
        graphs = write(dealt.groupBy("dim", "shard").applyInPandas(_graphs(kind), "dim int, shard long, graph binary"), "graphs")
        asked = classes.select("id", "v", "dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
        asked = write(asked.groupBy("dim", "block").applyInPandas(_blocks(kind), "dim int, block long, ids binary, vs binary"), "blocks")
        with small_batches(spark, 2):
            beam, _, _ = choose_beam(classes, graphs, n, threshold, ef, recall)
            met = _met(graphs, asked, shards, chunks).mapInPandas(_search(threshold, beam, kind), "src long, dst long, others long")
            found = write(met, "found")
        comps = connected_components(found.where("dst >= 0"))
        counts = found.where("dst < 0").groupBy(F.col("src").alias("id")).agg(F.sum("others").alias("others"))
        per = classes.join(comps, "id", "left").join(counts, "id", "left")
        per = per.select("v", "first", "copies", F.coalesce("component", "id").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        smallest = per.groupBy("component").agg(F.min("first").alias("component_id"))
        per = write(per.join(smallest, "component").select("v", "copies", "n_links", "component_id"), "per")
        # a vector of very many copies would fill one task of the join: those, at most 1000, are broadcast
        total = rows.count()
        hot = F.col("copies") > max(1000, int(total * HOT_SHARE))
        often = F.broadcast(per.where(hot).drop("copies"))
        known = rows.join(often, "v").unionByName(rows.join(F.broadcast(per.where(hot).select("v")), "v", "left_anti").join(per.where(~hot).drop("copies"), "v"))
        known = known.select("id", "n_links", "component_id")
    else:
        known = rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = typed(vectors, id_col, vector_col)
    rest = out.where(~(F.col("id").isNotNull() & valid(F.col("v")))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    done, _ = materialise(known.unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))), "near")
    for path in paths:
        discard(spark, path)
    return done
