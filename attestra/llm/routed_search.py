"""Approximate nearest neighbours through learned partitions.

On a bounded sample the neighbour graph is cut into parts of equal size, and a small network learns to name a vector's
part. The network assigns every row to one part and sends each query to its most probable parts, as many as an audit on
the sample needs for the wanted recall; there the query meets all rows and the nearest are reranked by exact cosine.
Parts grow with the square root of the table up to MOST_PARTS, so that a query's cost grows slower than the table.
Queries whose parts held too few candidates go on to the other parts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.llm.vectors import cosines, kind_of, matrix, pick, unit
from attestra.runtime import discard, materialise

#: Rows and queries that one task compares at most, on average.
ROW_BLOCK = 8192
QUERY_BLOCK = 2048
#: Parts at least, where the sample can fill them, and at most; sample rows that a part should have.
LEAST_PARTS, MOST_PARTS = 16, 256
PART_ROWS = 128
#: Sample rows that a part must have for the router to learn it.
LEARN_ROWS = 24


@dataclass(frozen=True)
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest other rows of each row of unit vectors."""
    out = []
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def partition(x: np.ndarray, near: np.ndarray, parts: int, turns: int = 12, slack: float = 1.05) -> np.ndarray:
    """Balanced parts of the neighbour graph: halves along main directions first, then vertices move to the part that
    holds most of their neighbours as long as its size allows."""
    n = len(x)
    part = np.zeros(n, np.int64)
    count = 1
    while count < parts:
        new = part * 2
        for p in range(count):
            rows = np.flatnonzero(part == p)
            c = x[rows] - x[rows].mean(0)
            v = np.random.default_rng(p).normal(size=x.shape[1])
            for _ in range(20):
                v = c.T @ (c @ v)
                v /= np.linalg.norm(v) + 1e-12
            order = np.argsort(c @ v, kind="stable")
            new[rows[order[len(rows) // 2 :]]] += 1
        part, count = new, count * 2
    most = int(slack * n / count) + 1
    src = np.repeat(np.arange(n), near.shape[1])
    for _ in range(turns):
        votes = np.zeros((n, count))
        np.add.at(votes, (src, part[near.ravel()]), 1)
        np.add.at(votes, (near.ravel(), part[src]), 1)
        want = votes.argmax(1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), part]
        size = np.bincount(part, minlength=count)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < most:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if moved < n // 200:
            break
    return part


def train(x: np.ndarray, soft: np.ndarray, hidden: int = 128, epochs: int = 40, rate: float = 2e-3) -> tuple[np.ndarray, ...]:
    """A network of one hidden layer on soft labels, by Adam."""
    rng = np.random.default_rng(5)
    w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(2 / hidden), (hidden, soft.shape[1])), np.zeros(soft.shape[1])]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            b = order[i : i + 256]
            h = np.maximum(x[b] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - soft[b]) / len(b)
            e = (d @ w[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((x[b].T @ e, e.sum(0), h.T @ d, d.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(w)


def parts_for(n: int) -> int:
    """Parts of a table of n rows: the power of two next to a fourteenth of its root, within the bounds."""
    return int(min(MOST_PARTS, max(LEAST_PARTS, 2 ** round(np.log2(max(n, 1) ** 0.5 / 14)))))


def fit(x: np.ndarray, k: int = 5, parts: int = 16, recall: float = 0.97, degree: int = 10) -> Router:
    """Learn parts and router from sample vectors; ``probes`` is the least number that reaches ``recall`` on the audit rows.

    The parts are halved until each has LEARN_ROWS rows of the sample; one part needs no router.
    """
    x = unit(x)
    while parts > 1 and len(x) < LEARN_ROWS * parts:
        parts //= 2
    if parts == 1:
        d = x.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    near = neighbours(x, degree)
    part = partition(x, near, parts)
    parts = int(part.max()) + 1
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.repeat(np.arange(len(x)), degree), part[near.ravel()]), 0.5 / degree)
    soft[np.arange(len(x)), part] += 0.5
    audit = np.arange(len(x)) % 8 == 0  # neither trained on nor routed by its own row
    router = Router(*train(x[~audit], soft[~audit]), parts)
    z = router.logits(x)
    home, order = z.argmax(1), np.argsort(-z[audit], axis=1)
    truth = home[neighbours(x, k)[audit]]
    place = np.argsort(order, axis=1)
    rank = np.take_along_axis(place, truth, 1)
    share = [(rank < p).mean() for p in range(1, parts + 1)]
    probes = next((p for p, s in enumerate(share, 1) if s >= recall), parts)
    return Router(router.w1, router.b1, router.w2, router.b2, probes)


def _route(router, queries: bool, rest: bool = False):
    """A row's own part, or a query's most probable parts; with ``rest`` all its other parts."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            r = router.value
            z = r.logits(matrix(pdf["v"]))
            if queries:
                top = np.argsort(-z, axis=1, kind="stable")[:, r.probes if rest else 0 : None if rest else r.probes]
                yield pdf.iloc[np.repeat(np.arange(len(pdf)), top.shape[1])].assign(part=top.ravel())[["id", "v", "part"]]
            else:
                yield pdf.assign(part=z.argmax(1))[["id", "v", "part"]]

    return run


def nearest(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, cosine) of the k nearest other rows of each query, ties to the smaller id; exact in double precision."""
    order = np.lexsort((xid,))
    x, xid = x[order], xid[order]
    # of equal vectors only the k + 1 smallest ids can be among any query's k nearest others
    _, group = np.unique(x, axis=0, return_inverse=True)
    group = group.ravel()
    by = np.argsort(group, kind="stable")
    first = np.r_[0, np.flatnonzero(np.diff(group[by])) + 1]
    place = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
    keep = np.sort(by[place <= k])
    x, xid = x[keep], xid[keep]
    s = unit(q) @ unit(x).T
    s[qid[:, None] == xid[None, :]] = -np.inf
    ids, begin = np.unique(xid, return_index=True)
    best = s if len(ids) == len(xid) else np.maximum.reduceat(s, begin, axis=1)  # an id counts once, as its nearest vector
    m = min(k, best.shape[1])
    bar = -np.partition(-best, m - 1, axis=1)[:, m - 1 : m] - 1e-9
    i, j = np.nonzero((s >= bar) & np.isfinite(s))
    exact = cosines(q[i], x[j]) if len(i) else np.empty(0)
    o = np.lexsort((xid[j], -exact, i))
    i, j, exact = i[o], j[o], exact[o]
    if len(ids) < len(xid) and len(i):
        _, once = np.unique(np.stack([i, xid[j]]), axis=1, return_index=True)
        once = np.sort(once)
        i, j, exact = i[once], j[once], exact[once]
    start = np.r_[0, np.flatnonzero(np.diff(i)) + 1] if len(i) else np.empty(0, np.int64)
    place = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
    ok = place < k
    return i[ok], xid[j[ok]], exact[ok]


def _compare(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        qid = queries["id"].to_numpy(np.int64)
        i, ids, s = nearest(matrix(queries["v"]), qid, matrix(rows["v"]), rows["id"].to_numpy(np.int64), k)
        return pd.DataFrame({"query_id": qid[i], "vec_id": ids, "score": s})

    return run


def _meet(placed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k best of every block of rows in its parts."""
    size = placed.groupBy("part").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("rows"))
    ask = asked.groupBy("part").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("asks"))
    shape = size.join(ask, "part")  # a row a part
    deal = lambda df, mine, other, a, b: df.join(F.broadcast(shape), "part").select(
        "part", F.pmod(F.xxhash64("id", "v"), mine).cast("int").alias(a), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(b), "id", "v"
    )
    keys = ["part", "salt", "block"]
    left, right = deal(placed, "rows", "asks", "salt", "block").groupBy(*keys), deal(asked, "asks", "rows", "block", "salt").groupBy(*keys)
    return left.cogroup(right).applyInPandas(_compare(k), "query_id long, vec_id long, score double")


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    sample_rows: int | None = None, parts: int | None = None, recall: float = 0.97,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``is_query`` (over column ``id``) holds.

    Score is the cosine of the original vectors in double precision; a row is never its own neighbour, ties go to the
    smaller id, and fewer candidates than k are all returned. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without an id, take no part; vectors of different lengths never meet. Rows that
    repeat an id are one candidate, as near as the nearest of its vectors, and one query, which asks with all of them.
    An empty table gives no rows. The model is fit on the ``sample_rows`` rows whose ids have the smallest hashes (128 a
    part, 4096 to 32768); all rows are indexed.
    """
    spark = vectors.sparkSession
    kind = kind_of(vectors, vector_col)
    paths = []

    def write(df: DataFrame, label: str) -> DataFrame:
        out, path = materialise(df, label, "zstd")
        paths.append(path)
        return out

    rows = write(pick(vectors, id_col, vector_col).dropDuplicates(["id", "v"]).withColumn("dim", F.size("v")), "vectors")
    best = []
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda found: (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    )
    for dim, n in rows.groupBy("dim").count().collect():  # lengths of vectors, one in practice
        mine = rows.where(F.col("dim") == dim).select("id", "v")
        wanted = parts or parts_for(n)
        sample = mine.orderBy(F.xxhash64("id"), "id").limit(sample_rows or max(4096, PART_ROWS * wanted)).toPandas()
        shared = spark.sparkContext.broadcast(fit(matrix(sample["v"]), k, wanted, recall))
        placed = write(mine.mapInPandas(_route(shared, False), f"id long, v {kind}, part long"), "placed")
        asked = write(mine.where(is_query).mapInPandas(_route(shared, True), f"id long, v {kind}, part long"), "asked")
        first = write(top(_meet(placed, asked, k)), "first")
        short = asked.select(F.col("id").alias("query_id")).distinct().join(first.groupBy("query_id").count(), "query_id", "left")
        short = write(short.where(F.coalesce("count", F.lit(0)) < min(k, n - 1)).select(F.col("query_id").alias("id")), "short")
        if shared.value.probes < shared.value.parts and short.head(1):  # parts with too few rows: the other parts as well
            again = write(mine.join(short, "id").mapInPandas(_route(shared, True, True), f"id long, v {kind}, part long"), "again")
            first = write(top(first.select("query_id", "vec_id", "score").unionByName(_meet(placed, again, k))), "all")
        best.append(first)
    if not best:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = best[0]
    for more in best[1:]:
        found = top(found.unionByName(more).select("query_id", "vec_id", "score"))
    done, _ = materialise(found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest")
    for path in paths:
        discard(spark, path)
    return done
