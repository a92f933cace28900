"""Quality classifier: a sparse rule ensemble compiled to column expressions.

Statistics of a text are column expressions. Small trees are grown on bootstrap
samples of labelled statistics; every path from a root, whole or cut short, is a
conjunctive rule. A logistic model with an L1 penalty on the rules' weights keeps
few of them, and those become one arithmetic column: scoring is a single pass
without Python, shuffle or join.

Learning takes a bounded sample: of each label at most ``per_class`` rows, those
with the least hash of their id; only their statistics reach the driver. Label,
language, source and id are never inputs of a score.

Defined results: a null text is empty (all statistics zero) and gets the score of
that; without learnable rows of both labels every score is the share of label 1.
Repeated rows are each scored, alike, and count once in learning; of rows with the
same hash the lesser id is learned first; a long text is taken whole; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import pick, split_words
from quillgrid.llm.toxicity import held_out

BLANKS = r"\x20\x09-\x0D"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` as (_id, the statistics), and their names."""
    t, n = F.col("_text"), F.col("_n")
    df = pick(docs, id_col, text_col).withColumns({"_words": split_words(t, BLANKS), "_n": F.char_length(t).cast("double"), "_lines": F.array_remove(F.split(t, "\n"), "")})
    over = lambda x, y: x / F.greatest(y, F.lit(1.0))
    share = lambda cls: over(n - F.char_length(F.regexp_replace(t, f"[{cls}]+", "")), n)
    words, lines = F.size("_words").cast("double"), F.size("_lines").cast("double")
    stats = {
        "n_words": words,
        "chars_per_word": over(n, words),
        "upper": share("A-Z"),
        "digit": share("0-9"),
        "symbol": share(r"#*$%&<>@^_~+=/\x5C\[\]{}`"),
        "bar": share("|"),
        "shout": share("!?"),
        "point": share(r".,;:'\x22()\-"),
        "wide": over(F.octet_length(t) - n, n),
        "new_words": over(F.size(F.array_distinct("_words")).cast("double"), words),
        "new_lines": over(F.size(F.array_distinct("_lines")).cast("double"), lines),
        "words_per_line": over(words, lines),
    }
    return df.select("_id", *(v.alias(k) for k, v in stats.items())), list(stats)


#: A condition is (statistic, threshold, above); a rule is a set of conditions.
Rule = frozenset


@dataclass(frozen=True)
class Ensemble:
    names: tuple[str, ...]
    rules: tuple[tuple[Rule, float], ...]
    bias: float

    def column(self) -> Column:
        """The score as one expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            hold = F.lit(True)
            for j, cut, above in sorted(rule):
                hold = hold & ((F.col(self.names[j]) > cut) if above else (F.col(self.names[j]) <= cut))
            total = total + F.when(hold, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], depth: int, rng: np.random.Generator, path: Rule, out: set[Rule], least: int) -> None:
    """One tree by Gini gain over a random half of the statistics; adds each path to ``out``."""
    if path:
        out.add(path)
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return
    best = (1e-9, -1, 0.0)
    whole = y.mean() * (1 - y.mean())
    for j in rng.permutation(x.shape[1])[: max(2, x.shape[1] // 2)]:
        above = x[:, j][:, None] > cuts[j][None, :]
        n1 = above.sum(axis=0)
        p1 = (above * y[:, None]).sum(axis=0) / np.maximum(n1, 1)
        n0 = len(y) - n1
        p0 = (y.sum() - p1 * n1) / np.maximum(n0, 1)
        gain = np.where((n1 >= least) & (n0 >= least), whole - (n1 * p1 * (1 - p1) + n0 * p0 * (1 - p0)) / len(y), 0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), int(j), float(cuts[j][k]))
    if best[1] < 0:
        return
    _, j, cut = best
    for side in (True, False):
        rows = (x[:, j] > cut) == side
        grow(x[rows], y[rows], cuts, depth - 1, rng, path | {(j, cut, side)}, out, least)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradient; the bias is free."""
    n = len(y)
    step = 4 * n / (np.linalg.norm(z, 2) ** 2 + n)
    w, b = np.zeros(z.shape[1]), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    u, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = (1 / (1 + np.exp(-np.clip(z @ u + c, -30, 30))) - y) / n
        w1, b1 = u - step * (z.T @ r), c - step * r.sum()
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - step * penalty, 0)
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return w, b


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> Ensemble:
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Ensemble(tuple(names), (), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 33))) for j in range(x.shape[1])]
    found: set[Rule] = set()
    for _ in range(trees):
        rows = rng.integers(0, len(y), min(len(y), 3000))
        grow(x[rows], y[rows], cuts, depth, rng, Rule(), found, max(3, len(rows) // 200))
    rules = sorted(found, key=sorted)
    z = np.empty((len(y), len(rules)))
    for k, rule in enumerate(rules):
        z[:, k] = np.all([(x[:, j] > cut) == above for j, cut, above in rule], axis=0)
    w, b = lasso(z, y, penalty)
    kept = tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6)
    return Ensemble(tuple(names), kept, b)


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    modulus: int = 3, remainder: int = 1, per_class: int = 4000,
) -> Ensemble:
    """Fits on a bounded sample of the rows that aren't held out."""
    named = labels.select(F.col(f"`{id_col}`").alias("_lid"), F.col(f"`{label_col}`").cast("int").alias("_y")).filter(
        F.col("_lid").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_lid"), modulus, remainder)
    )
    order = (F.xxhash64("_lid"), F.col("_lid"))
    chosen = named.filter("_y = 1").orderBy(*order).limit(per_class).unionByName(named.filter("_y = 0").orderBy(*order).limit(per_class)).distinct()
    texts = pick(docs, id_col, text_col).join(F.broadcast(chosen), F.col("_id") == F.col("_lid")).select("_lid", F.col("_text").alias("_t"), "_y")
    stats, names = statistics(texts.select(F.struct("_lid", "_y").alias("_key"), "_t"), "_key", "_t")
    rows = stats.select("_id.*", *names).distinct().orderBy("_lid", "_y", *names).limit(4 * per_class).collect()
    x = np.array([[r[n] for n in names] for r in rows], dtype=float).reshape(-1, len(names))
    return fit(x, np.array([r["_y"] for r in rows], dtype=float), names)


def score(docs: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs``: the id, ``score`` and ``predicted``."""
    stats, _ = statistics(docs, id_col, text_col)
    return stats.withColumn("score", model.column()).select(F.col("_id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
