"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark expressions.

Statistics are DataFrame expressions over the whole text. Small boosted trees are grown on a bounded labelled sample;
each path from a root to a node is a rule, a conjunction of bounds on statistics; a lasso logistic regression keeps few
of them. What remains is a sum of weights of conditions, evaluated by Spark over every row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.labelled import sample

#: A condition (statistic, is it above, bound) and a rule: conditions and weight.
Condition = tuple[str, bool, float]


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def expression(self, prefix: str = "s_") -> Column:
        """Probability of label 1 over columns named like the statistics, behind ``prefix``."""
        x = F.lit(float(self.intercept))
        for conditions, weight in self.rules:
            x = x + F.when(_all(conditions, prefix), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-x))

    def sql(self) -> str:
        """The same as SQL text."""
        terms = [repr(float(self.intercept))]
        for conditions, weight in self.rules:
            test = " and ".join(f"s_{s} {'>' if above else '<='} {bound!r}" for s, above, bound in conditions)
            terms.append(f"case when {test} then {float(weight)!r} else 0.0 end")
        return f"1 / (1 + exp(-({' + '.join(terms)})))"


def _all(conditions: tuple[Condition, ...], prefix: str) -> Column:
    out = F.lit(True)
    for s, above, bound in conditions:
        value = F.col(prefix + s)
        out = out & (value > bound if above else value <= bound)
    return out


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


#: Characters that statistics count.
SYMBOLS = "#$%&*+<=>@^_~\\/"
MARKS = ".,;:"


#: Names of the statistics, behind a prefix.
STATISTICS = ("length", "word", "fresh", "rich", "symbols", "shouts", "asks", "bars", "marks", "digits", "upper", "breaks", "again")


def free_prefix(columns: list[str], prefix: str = "s_") -> str:
    """``prefix``, lengthened until no column's name starts with it."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "x" + prefix
    return prefix


def statistics(df: DataFrame, text_col: str = "text", prefix: str = "s_") -> DataFrame:
    """The table with STATISTICS of each whole text behind ``prefix``, which no column may start with; null counts as empty."""
    at = lambda name: F.col(prefix + name)
    put = lambda d: {prefix + k: v for k, v in d.items()}
    base = df.withColumn(f"{prefix}0text", F.coalesce(F.col(text_col), F.lit("")))
    t = at("0text")
    base = base.withColumn(f"{prefix}0words", F.filter(F.split(t, "[ \\t\\n\\r]+"), lambda x: x != ""))
    words = at("0words")
    base = base.withColumns(
        put(
            {
                "0n": F.greatest(F.size(words), F.lit(1)).cast("double"),
                "0len": F.greatest(F.length(t), F.lit(1)).cast("double"),
                "0kinds": F.size(F.array_distinct(words)).cast("double"),
                "0lines": F.split(t, "\n"),
            }
        )
    )
    n, size, kinds, lines = at("0n"), at("0len"), at("0kinds"), at("0lines")
    upper = F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}+", ""))
    stats = (
        F.log1p(size), size / n, kinds / n, kinds / F.sqrt(n), _without(t, SYMBOLS) / size, _without(t, "!") / size, _without(t, "?") / size,
        _without(t, "|") / size, _without(t, MARKS) / n, _without(t, "0123456789") / size, upper / size, F.size(lines) / n,
        1 - F.size(F.array_distinct(lines)) / F.size(lines),
    )
    out = base.withColumns(put(dict(zip(STATISTICS, stats, strict=True))))
    return out.drop(*[f"{prefix}0{c}" for c in ("text", "words", "n", "len", "kinds", "lines")])


def grow(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, bins: int = 48, rate: float = 0.3, least: int = 15) -> list[tuple[tuple[int, bool, float], ...]]:
    """Paths of small trees boosted on the logistic loss: conjunctions of (column, is it above, bound)."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    f = np.full(n, math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    paths: list[tuple[tuple[int, bool, float], ...]] = []
    rng = np.random.default_rng(17)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        use = rng.random(n) < 0.7
        todo: list[tuple[np.ndarray, tuple]] = [(np.arange(n), ())]
        while todo:
            rows, path = todo.pop()
            inner = rows[use[rows]]
            best = (1e-6, None)
            if len(path) < depth and len(inner) >= 2 * least:
                gs, hs = g[inner].sum(), h[inner].sum()
                for j in range(m):
                    if not len(cuts[j]):
                        continue
                    k = len(cuts[j]) + 1
                    cg = np.cumsum(np.bincount(code[inner, j], g[inner], k))[:-1]
                    ch = np.cumsum(np.bincount(code[inner, j], h[inner], k))[:-1]
                    cn = np.cumsum(np.bincount(code[inner, j], minlength=k))[:-1]
                    gain = cg**2 / (ch + 1) + (gs - cg) ** 2 / (hs - ch + 1) - gs**2 / (hs + 1)
                    gain[(cn < least) | (len(inner) - cn < least)] = -1
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], (j, i))
            if best[1] is None:
                if len(rows):
                    f[rows] += rate * g[inner].sum() / (h[inner].sum() + 1)
                continue
            j, i = best[1]
            low = code[rows, j] <= i
            for above, part in ((False, rows[low]), (True, rows[~low])):
                step = (*path, (j, above, float(cuts[j][i])))
                paths.append(step)
                todo.append((part, step))
    return paths


def _tidy(path) -> tuple[tuple[int, bool, float], ...]:
    """A path without bounds that a later one of the same column makes void, in a fixed order."""
    kept: dict[tuple[int, bool], float] = {}
    for j, above, bound in path:
        old = kept.get((j, above))
        kept[j, above] = bound if old is None else max(old, bound) if above else min(old, bound)
    return tuple(sorted((j, above, b) for (j, above), b in kept.items()))


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights of 0/1 columns under an L1 penalty, by accelerated proximal gradient."""
    n, m = r.shape
    center = r.mean(0)
    c = r - center
    v = np.ones(m)
    for _ in range(30):
        v = c.T @ (c @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (0.25 * np.linalg.norm(c @ v) ** 2 / n + 0.25)
    w, z, b, zb, t = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(c @ z + zb, -50, 50)))
        u = z - rate * (c.T @ (p - y) / n)
        new = np.sign(u) * np.maximum(np.abs(u) - rate * penalty, 0)
        nb = zb - rate * (p - y).mean()
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / s * (new - w), nb + (t - 1) / s * (nb - b)
        w, b, t = new, nb, s
    return b - float(center @ w), w


def fit(docs: DataFrame, labels: DataFrame, use: Column, label: str = "quality", max_rows: int = 20_000, penalty: float = 5e-4) -> Ensemble:
    """Learn from at most ``max_rows`` labelled documents for which ``use`` holds.

    With no labelled row of one of the labels there is no rule and every text scores the share of label 1.
    """
    names = list(STATISTICS)
    stats = statistics(sample(docs, labels, label, use, max_rows))
    got = stats.select("y", *[F.col(f"s_{c}").alias(c) for c in names]).toPandas()  # at most max_rows rows of numbers
    y = got["y"].to_numpy(float)
    share = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        return Ensemble(math.log(share / (1 - share)), ())
    x = got[names].to_numpy(float)
    order = np.lexsort(x.T)  # the sample's order must not matter
    x, y = x[order], y[order]
    rules = sorted({_tidy(p) for p in grow(x, y)})
    r = np.ones((len(y), len(rules)))
    for k, rule in enumerate(rules):
        for j, above, bound in rule:
            r[:, k] *= x[:, j] > bound if above else x[:, j] <= bound
    b, w = lasso(r, y, penalty)
    kept = [(tuple((names[j], above, bound) for j, above, bound in rules[k]), float(w[k])) for k in np.flatnonzero(np.abs(w) > 1e-6)]
    return Ensemble(float(b), tuple(kept))


def score(docs: DataFrame, model: Ensemble, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The table with a column ``score_col``: probability of label 1, from whole texts.

    Null and empty texts have the statistics of an empty text; repeated rows are scored each; an empty table stays empty.
    All other columns stay as they are, whatever their names; a column that is already named ``score_col`` is replaced.
    """
    prefix = free_prefix([*docs.columns, score_col])
    scored = statistics(docs, text_col, prefix).withColumn(score_col, model.expression(prefix))
    return scored.drop(*[prefix + c for c in STATISTICS])


def keep_good(docs: DataFrame, model: Ensemble, limit: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose probability is at least ``limit``."""
    name = free_prefix(docs.columns, "rating")
    return score(docs, model, text_col, name).where(F.col(name) >= limit).drop(name)
