"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by an extreme-value law.

Learning: a token is judged by the signed root of the likelihood ratio of its counts in toxic and other labelled
documents, against the bound that the largest of as many chance values would reach, so the rule is the same at every
size. Documents are counted first; for the candidates that leaves, different left neighbours are counted, so that
copies of a text count once. A token's weight is its log-odds under a Dirichlet prior; every other token costs a
constant, so that a random text drifts down. One linear scan finds all maximal segments. The best score among n tokens
of clean text follows a Gumbel law whose location grows with log n; it turns a score into the log of its tail
probability, and a logistic curve over that into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.labelled import sample
from attestra.runtime import bound_batches, discard, materialise, small_batches

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    """weights: token -> log-odds. cost: of any other token. scale, place: of the Gumbel law. slope, level: of the logistic curve."""

    weights: dict[str, float]
    cost: float
    scale: float
    place: float
    slope: float
    level: float
    significant: float


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def segments(positions: list[int], scores: list[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximal segments (first token, last token, score) of a text whose tokens at ``positions`` have ``scores``, all others -cost.

    Linear in the number of scored tokens: a stack of candidates (left, right, total before, total after, the nearest
    candidate below with a smaller total before). Below a candidate only those named can be joined to it, so a search
    follows them; where none begins lower than a new candidate, all on the stack are final and leave it.
    """
    done: list[tuple[int, int, float]] = []
    stack: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for p, s in zip(positions, scores, strict=True):
        total -= cost * (p - last - 1)
        before, total, last = total, total + s, p
        if s <= 0:
            continue
        left, k = p, len(stack) - 1
        while True:
            while k >= 0 and stack[k][2] >= before:
                k = stack[k][4]
            if k < 0:
                done += [(a, b, after - ahead) for a, b, ahead, after, _ in stack]
                stack = [(left, p, before, total, -1)]
                break
            if stack[k][3] >= total:
                stack.append((left, p, before, total, k))
                break
            left, before, down = stack[k][0], stack[k][2], stack[k][4]
            del stack[k:]
            k = down
    return done + [(a, b, after - ahead) for a, b, ahead, after, _ in stack]


def passages(words: list[str], model: Model) -> list[tuple[int, int, float]]:
    get = model.weights.get
    hits = [(i, w) for i, t in enumerate(words) if (w := get(t)) is not None]
    return segments([i for i, _ in hits], [w for _, w in hits], model.cost) if hits else []


def surprise(best: float, n: int, model: Model) -> float:
    """-log of the chance that clean text of n tokens has a segment of this score."""
    z = (best - model.place) / model.scale - math.log(max(n, 1))
    if z > 30:
        return z
    return -math.log(max(-math.expm1(-math.exp(-z)), 1e-300)) if z > -6 else 0.0


def probability(best: float, n: int, model: Model) -> float:
    x = model.slope * surprise(best, n, model) + model.level
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold a token, added up a task at a time."""
    for b in batches:
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for text, y in zip(b.column("text"), b.column("y").to_pylist(), strict=True):
            n[y].update(set(tokens(text.as_py())))
        words = list(n[0] | n[1])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([n[1][w] for w in words], pa.int64()), pa.array([n[0][w] for w in words], pa.int64())], ["token", "n1", "n0"])


def _best(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text"):
                words = tokens(text.as_py())
                out.append((len(words), max((s for _, _, s in passages(words, model)), default=0.0)))
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([n for n, _ in out], pa.int64()), pa.array([s for _, s in out], pa.float64())], ["y", "n", "best"])

    return run


def _contexts(wanted):
    """(token, y, left neighbour) of the wanted tokens, each once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = set()
            for text, y in zip(b.column("text"), b.column("y").to_pylist(), strict=True):
                words = tokens(text.as_py())
                seen.update((w, y, left) for left, w in zip(["", *words], words, strict=False) if w in wanted.value)
            rows = sorted(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["token", "y", "left"])

    return run


def significance(n1: float, n0: float, share: float) -> float:
    """Signed root of the likelihood ratio of counts n1 and n0 whose expected shares are ``share`` and the rest."""
    e1, e0 = (n1 + n0) * share, (n1 + n0) * (1 - share)
    g = 2 * ((n1 * math.log(n1 / e1) if n1 else 0.0) + (n0 * math.log(n0 / e0) if n0 else 0.0))
    return math.copysign(math.sqrt(max(g, 0.0)), n1 - e1)


def log_odds(n1: float, n0: float, share: float, prior: float) -> float:
    """Log-odds of label 1 beyond those of ``share``, under a Dirichlet prior of weight ``prior`` that follows ``share``."""
    return math.log((n1 + prior * share) / (n0 + prior * (1 - share))) - math.log(share / (1 - share))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    use: Column,
    label: str = "toxic",
    max_rows: int = 20_000,
    min_odds: float = 1.0,
    against: float = 1.0,
    prior: float = 1.0,
    cost: float = 0.05,
    significant: float = 4.0,
) -> Model:
    """Learn from at most ``max_rows`` labelled documents for which ``use`` holds.

    The model is sparse: of the significant tokens those that stay significant by their contexts, in favour with odds of
    ``min_odds`` nats; its size is bounded by the sample's. A token weighs no more than ``against`` against. With no labelled row of
    one of the labels nothing is significant and every text scores the share of label 1.
    """
    spark = docs.sparkSession
    with small_batches(spark, 500):
        rows, rows_path = materialise(sample(docs, labels, label, use, max_rows).where("text is not null"), "labelled", "zstd")
        model = _learn(rows, min_odds, against, prior, cost, significant)
    discard(spark, rows_path)
    return model


def _learn(rows: DataFrame, min_odds: float, against: float, prior: float, cost: float, significant: float) -> Model:
    spark = rows.sparkSession
    by = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    docs1, docs0 = float(by.get(1, 0)), float(by.get(0, 0))
    base = (docs1 + 1) / (docs1 + docs0 + 20)
    if not docs1 or not docs0:
        return Model({}, cost, 1.0, 1.0, 1.0, math.log(base / (1 - base)), significant)
    share = docs1 / (docs1 + docs0)
    seen = rows.mapInArrow(_count, "token string, n1 long, n0 long").groupBy("token").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    seen, seen_path = materialise(seen, "tokens", "zstd")
    bound = math.sqrt(2 * math.log(max(seen.count(), 2)))
    n1, n0 = F.col("n1"), F.col("n0")
    part = lambda n, q: F.when(n > 0, n * F.log(n / ((n1 + n0) * q))).otherwise(0.0)
    g = F.sqrt(F.greatest(F.lit(0.0), 2 * (part(n1, F.lit(share)) + part(n0, F.lit(1 - share)))))
    likely = seen.select("token", g.alias("g")).where(F.col("g") >= bound)
    wanted = spark.sparkContext.broadcast({r["token"] for r in likely.collect()})  # of the bounded sample's words at most
    contexts = rows.mapInArrow(_contexts(wanted), "token string, y int, left string").groupBy("token", "y").agg(F.count_distinct("left").alias("n"))
    held: dict[str, list[int]] = {}
    for r in contexts.collect():  # at most two rows a wanted token
        held.setdefault(r["token"], [0, 0])[r["y"]] = r["n"]
    discard(spark, seen_path)
    weights = {}
    for token, (n, m) in sorted(held.items()):
        z, d = significance(m, n, share), log_odds(m, n, share, prior)
        if z >= bound and d >= min_odds or z <= -bound:
            weights[token] = max(d, -against)
    model = Model(weights, cost, 1.0, 1.0, 1.0, 0.0, significant)
    got = rows.mapInArrow(_best(model), "y int, n long, best double").toPandas()  # at most max_rows rows of numbers
    clean = got[(got["y"] == 0) & (got["n"] > 0)]
    # moments of best - scale * log n, which has the same Gumbel law at every length
    scale = 0.5
    for _ in range(20):
        rest = clean["best"] - scale * np.log(clean["n"])
        scale = float(min(max(rest.std() * math.sqrt(6) / math.pi, 0.25), 2.0)) if len(rest) > 1 else 0.5
    place = float(max((clean["best"] - scale * np.log(clean["n"])).mean() - 0.5772 * scale, -20.0)) if len(clean) else 0.0
    model = Model(model.weights, cost, scale, place, 1.0, 0.0, significant)
    x = np.array([surprise(b, n, model) for b, n in zip(got["best"], got["n"], strict=True)])
    x, y = np.minimum(x, 40.0), got["y"].to_numpy(float)
    slope, level = 0.5, -2.0
    for _ in range(60):  # Newton's method, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(slope * x + level, -50, 50)))
        g = np.array([((p - y) * x).sum() + 0.1 * slope, (p - y).sum() + 0.01 * level])
        v = p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        slope, level = slope - float(np.clip(step[0], -1, 1)), level - float(np.clip(step[1], -2, 2))
    return Model(model.weights, cost, scale, place, slope, level, significant)


_SCORED = "doc_id long, n_tokens long, score double, passages array<struct<first:long,last:long,score:double>>"


def _score(model: Model):
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, scores, spans = [], [], []
            for text in b.column("text"):
                words = tokens(text.as_py())
                found = passages(words, model)
                ns.append(len(words))
                scores.append(probability(max((s for _, _, s in found), default=0.0), len(words), model))
                spans.append([{"first": i, "last": j, "score": s} for i, j, s in found if surprise(s, len(words), model) >= model.significant])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ns, pa.int64()), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "n_tokens", "score", "passages"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: ``doc_id``, ``n_tokens``, ``score`` and its significant ``passages`` (token spans).

    Whole texts are scanned once. Null, empty and wordless texts have no passage and score as clean text; repeated rows
    are scored each; a null id stays null. Only the id and the text are read.
    """
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), _SCORED)


def is_clean(text: Column, model: Model, limit: float = 0.7) -> Column:
    """Whether a text's score is below ``limit``; only the text travels to Python. Null and wordless texts have no passage."""

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            words = tokens(text.as_py())
            out.append(probability(max((s for _, _, s in passages(words, model)), default=0.0), len(words), model) < limit)
        return pa.array(out, pa.bool_())

    return clean(text)


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """The rows, with all their columns, whose score is below ``limit``; one pass, no join.

    Repeated rows are decided alike; an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    return docs.where(is_clean(F.col("text"), model, limit))
