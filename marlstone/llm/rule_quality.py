"""Quality classifier: a sparse ensemble of rules.

Statistics of a text are Spark columns. On a bounded sample of labelled rows, boosted trees are grown over the
statistics; each path from a root to a node is a conjunctive rule. A logistic regression with an L1 penalty keeps few
of them. The rules that are kept are compiled back into Spark columns, so scoring runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import few_by_hash, held_out, word_array

#: Statistics by name, as SQL over the counts of text_counts.
STATISTICS: dict[str, str] = {
    "words": "ln(1 + n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
    "repeats_next": "n_next / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(word_chars, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "distinct_lines": "n_distinct_lines / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Settings:
    """Production parameters."""

    #: The training sample: at most so many labelled documents.
    most_rows: int = 20000
    trees: int = 24
    depth: int = 3
    share: float = 0.6  # of the sample that each tree sees
    shrinkage: float = 0.3
    least_leaf: int = 8
    cuts: int = 32  # thresholds tried for each statistic
    penalty: float = 0.002
    rounds: int = 1500
    threshold: float = 0.3
    seed: int = 11


#: A condition: number of the statistic, threshold, and whether the value is above it. A rule: conditions that all hold.
Condition = tuple[int, float, bool]
Rule = tuple[Condition, ...]


@dataclass
class Model:
    rules: list[Rule]
    weights: list[float]
    bias: float


def text_statistics(docs: DataFrame, keep: Sequence[Column | str], text_col: str = "text") -> DataFrame:
    """``keep`` and the statistics, all finite; null counts as empty."""
    text = f"coalesce(`{text_col}`, '')"
    of_words = (
        "named_struct('n', size(ws), 'chars', char_length(concat_ws('', ws)), 'distinct', size(array_distinct(ws)), "
        "'next', size(filter(ws, (w, i) -> i > 0 and w = get(ws, i - 1))))"
    )
    counts = docs.select(
        *keep,
        F.expr(f"transform(array({word_array(f'`{text_col}`')}), ws -> {of_words})[0]").alias("__w"),
        F.expr(rf"transform(array(split({text}, '\n')), ls -> named_struct('n', size(ls), 'distinct', size(array_distinct(ls))))[0]").alias("__l"),
        *[
            F.expr(f"octet_length(regexp_replace({text}, '{pattern}', ''))").alias(name)
            for name, pattern in (("n_symbols", "[^#*$%&|<>]+"), ("n_capitals", "[^A-Z]+"), ("n_digits", "[^0-9]+"), ("n_marks", "[^!?.,;:]+"))
        ],
    )
    names = {"n_words": "__w.n", "word_chars": "__w.chars", "n_distinct": "__w.distinct", "n_next": "__w.next", "n_lines": "__l.n", "n_distinct_lines": "__l.distinct"}
    flat = counts.withColumns({a: F.col(c) for a, c in names.items()})
    kept = [c for c in counts.columns if c[:2] not in ("__", "n_")]
    return flat.select(*kept, *[F.expr(sql).cast("double").alias(name) for name, sql in STATISTICS.items()])


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for column, threshold, above in rule:
        out &= (x[:, column] > threshold) == above
    return out


def _grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, path: Rule, found: list[tuple[Rule, float]]) -> None:
    """Split on the largest gain of a Newton step; every path goes to ``found`` with its leaf value, where it ends."""
    best, total, heft = None, residual.sum(), weight.sum() + 1.0
    if depth and len(x) >= 2 * least:
        for column, values in enumerate(cuts):
            if not len(values):
                continue
            place = np.searchsorted(values, x[:, column], side="left")
            low_r = np.cumsum(np.bincount(place, weights=residual, minlength=len(values) + 1))[:-1]
            low_w = np.cumsum(np.bincount(place, weights=weight, minlength=len(values) + 1))[:-1]
            low_n = np.cumsum(np.bincount(place, minlength=len(values) + 1))[:-1]
            gain = low_r**2 / (low_w + 1.0) + (total - low_r) ** 2 / (heft - low_w) - total**2 / heft
            gain[(low_n < least) | (len(x) - low_n < least)] = -1
            at = int(gain.argmax())
            if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
                best = (gain[at], column, float(values[at]))
    if best is None:
        found.append((path, total / heft))
        return
    _, column, threshold = best
    above = x[:, column] > threshold
    for side in (False, True):
        rows = above == side
        longer = (*path, (column, threshold, side))
        if depth > 1:
            found.append((longer, float("nan")))
        _grow(x[rows], residual[rows], weight[rows], cuts, depth - 1, least, longer, found)


def extract_rules(x: np.ndarray, y: np.ndarray, settings: Settings) -> list[Rule]:
    """Paths of boosted trees, each once."""
    random = np.random.default_rng(settings.seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, settings.cuts + 2)[1:-1])) for c in x.T]
    # Rare values tell low quality apart, so the tails get thresholds of their own.
    tails = np.array([0.001, 0.005, 0.01, 0.02, 0.98, 0.99, 0.995, 0.999])
    cuts = [np.unique(np.concatenate([a, np.quantile(c, tails)])) for a, c in zip(cuts, x.T)]
    margin, rules = np.zeros(len(y)), {}
    for _ in range(settings.trees):
        p = 1 / (1 + np.exp(-margin))
        rows = random.random(len(y)) < settings.share
        found: list[tuple[Rule, float]] = []
        _grow(x[rows], (y - p)[rows], (p * (1 - p))[rows], cuts, settings.depth, settings.least_leaf, (), found)
        for rule, value in found:
            if rule:
                rules[tuple(sorted(rule))] = None
            if value == value:
                margin[_holds(rule, x)] += settings.shrinkage * value
    return list(rules)


def fit_lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient steps; the bias is free."""
    centre, scale = z.mean(axis=0), np.maximum(z.std(axis=0), 1e-6)
    x = (z - centre) / scale
    step = 4.0 / (np.linalg.norm(x, 2) ** 2 / len(y) + 1.0)
    w, b, vw, vb, t = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(x.shape[1]), 0.0, 1.0
    vb = b
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30))) - y
        nw = vw - step * (x.T @ error / len(y))
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * error.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w / scale, b - float((w * centre / scale).sum())


def train(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Model:
    """Rules and weights; without both labels, none and the log-odds of the share of label 1, kept off 0 and 1."""
    if len(y) < 2 * settings.least_leaf or len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Model([], [], float(np.log(share / (1 - share))))
    rules = extract_rules(x, y, settings)
    z = np.column_stack([_holds(r, x) for r in rules]).astype(float) if rules else np.zeros((len(y), 0))
    # Rules that hold on the same rows of the sample are one; the shortest stays.
    kept: dict[bytes, int] = {}
    for i in sorted(range(len(rules)), key=lambda i: len(rules[i])):
        if 0 < z[:, i].sum() < len(y):
            kept.setdefault(z[:, i].tobytes(), i)
    chosen = sorted(kept.values())
    if not chosen:
        return Model([], [], float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))))
    weights, bias = fit_lasso(z[:, chosen], y.astype(float), settings.penalty, settings.rounds)
    used = [k for k in range(len(chosen)) if abs(weights[k]) > 1e-6]
    return Model([rules[chosen[k]] for k in used], [float(weights[k]) for k in used], bias)


def compiled(model: Model) -> Column:
    """The score from 0 to 1 as a column over the statistics."""
    names = list(STATISTICS)
    margin = F.lit(float(model.bias))
    for rule, weight in zip(model.rules, model.weights):
        holds = F.lit(True)
        for column, threshold, above in rule:
            value = F.col(names[column])
            holds = holds & ((value > threshold) if above else (value <= threshold))
        margin = margin + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), margin))))


def predicted(model: Model, x: np.ndarray) -> np.ndarray:
    """The same scores with numpy."""
    margin = np.full(len(x), model.bias)
    for rule, weight in zip(model.rules, model.weights):
        margin += weight * _holds(rule, x)
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The bounded sample: labelled documents outside the held-out fold, by a hash of their id; labels of one id are averaged."""
    marked = labels.where(~held_out("doc_id") & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    few = few_by_hash(marked, settings.most_rows)
    # At most most_rows ids: a proven bound.
    wanted = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    stats = text_statistics(wanted, ["doc_id", "y"]).groupBy("doc_id").agg(F.min(F.struct("y", *STATISTICS)).alias("s"))
    rows = stats.select("doc_id", "s.*").orderBy("doc_id").toPandas()
    return rows[list(STATISTICS)].to_numpy(dtype=float), rows["y"].to_numpy(dtype=float)


def score_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (higher: label 1 likelier), predicted (1 from ``threshold`` on).

    Null and empty texts have the statistics of no words, and a score like any others; very long texts are read
    whole. Null labels are not
    learned from; of several texts under one labelled id the one with the least statistics is. A null id counts
    as held out. Repeated rows get repeated results. Without labels every score is 0.5. Other columns are
    ignored; an empty table gives no rows.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = train(*training_rows(named, labels, settings), settings)
    scored = text_statistics(named, ["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), compiled(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= settings.threshold).cast("int"))
