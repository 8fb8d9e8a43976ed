"""Quality rules: fixed base rules, then robust multivariate outliers.

Text statistics become short vectors of fixed-point numbers. For each (language, source) a
minimum-covariance-determinant estimate is fitted on the rows that pass the base rules, and rows whose
squared Mahalanobis distance passes a cutoff are rejected. Groups too small for an estimate are judged by that of
all rows of their language, or of all rows.

All of it is DataFrame operations. A concentration step is one aggregation: rows are counted, with the exact
integer sums and cross products of their vectors, in buckets of their distance to the present estimate; the
buckets nearest to the centre that hold the wanted share of a group's rows give the next estimate. Integer sums
do not depend on the order of rows, so reruns agree. Map-side combining leaves a few hundred rows a group
and task, whatever share of the table one source has. The estimates (a row for each group) meet the vectors
in a join that Spark broadcasts only below its size threshold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import SPACE_SQL, whole_row, word_array, written

#: Fixed-point units in 1.0 of a transformed statistic.
UNIT = 1024
#: Vectors' histogram cells for median and spread, in units.
CELL = 4
#: Words of an average text that every ratio is drawn towards, so that short texts vary no more than long ones.
DAMP = 50


@dataclass(frozen=True)
class Statistic:
    """A transformed statistic: SQL over the columns of text_statistics, and the difference that never matters."""

    name: str
    sql: str
    tolerance: float


STATISTICS: tuple[Statistic, ...] = (
    Statistic("word_length", f"ln((word_chars + {5 * DAMP}) / (n_words + {DAMP}))", 0.06),
    Statistic("symbols", f"ln(1 + 10 * n_symbols / (n_words + {DAMP}))", 0.10),
    Statistic("repeated_words", f"n_repeat_words / (n_words + {DAMP})", 0.05),
    Statistic("repeated_lines", "n_dup_lines / (n_lines + 10)", 0.05),
    Statistic("capitals", f"sqrt(n_capitals / (word_chars + {5 * DAMP}))", 0.06),
)


@dataclass(frozen=True)
class Rules:
    """Production parameters."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    statistics: tuple[Statistic, ...] = STATISTICS
    support: float = 0.6  # share of a group's rows that the estimate rests on
    steps: int = 3  # concentration steps
    min_group: int = 16  # rows that an estimate needs
    reweight: float = 0.975  # chi-squared quantile of the rows that the final estimate rests on
    #: Share of normal rows beyond the distance from which a row is rejected. Statistics of prose have longer tails
    #: than normal ones, so it is tiny; the squared distance is 60 for five statistics.
    beyond: float = 1.1e-11
    pooled: bool = False  # whether smaller groups are judged by their language's estimate, or that of all rows

    @property
    def cutoff(self) -> float:
        """Squared distance beyond which a row is rejected."""
        return chi2_quantile(1 - self.beyond, len(self.statistics))


#: What the registered query and the pipeline use.
POOLED = Rules(pooled=True)


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and names it in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeated_words_sql(words: str, window: int) -> str:
    """Words that lie in windows of so many words found twice or more in the array, first ones included."""
    hashed = f"transform(sequence(0, size({words}) - {window}), i -> xxhash64({', '.join(f'{words}[i + {k}]' for k in range(window))}))"
    tagged = "sort_array(transform(hs, (h, i) -> named_struct('h', h, 'i', i)))"
    twice = "filter(st, (s, j) -> coalesce(s.h = get(st, j - 1).h, false) or coalesce(s.h = get(st, j + 1).h, false))"
    covered = f"aggregate(transform(ps, (p, j) -> least({window}, coalesce(get(ps, j + 1) - p, {window}))), 0, (a, x) -> a + x)"
    spans = _let(tagged, "st", _let(f"sort_array(transform({twice}, s -> s.i))", "ps", covered))
    return f"if(size({words}) < {window}, 0, " + _let(hashed, "hs", f"if(size(array_distinct(hs)) = size(hs), 0, {spans})") + ")"


def text_statistics(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", keep: Sequence[str] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` and the statistics of each text; null texts have no words and no lines."""
    text = f"coalesce(`{text_col}`, '')"
    of_words = f"named_struct('n', size(ws), 'chars', char_length(concat_ws('', ws)), 'repeat', {repeated_words_sql('ws', rules.window)})"
    of_lines = "named_struct('n', size(ls), 'dup', size(ls) - size(array_distinct(ls)))"
    lines = rf"filter(split({text}, '\n'), l -> trim(BOTH {SPACE_SQL} FROM l) <> '')"
    parts = docs.select(
        *keep,
        F.expr(_let(word_array(f"`{text_col}`"), "ws", of_words)).alias("__w"),
        F.expr(_let(lines, "ls", of_lines)).alias("__l"),
        F.expr(f"octet_length(regexp_replace({text}, '[^#*$%&|<>]+', ''))").alias("n_symbols"),
        F.expr(f"octet_length(regexp_replace({text}, '[^A-Z]+', ''))").alias("n_capitals"),
    )
    counted = parts.select(
        *keep,
        *[
            F.col(c).cast("bigint").alias(a)
            for c, a in (
                ("__w.n", "n_words"),
                ("__w.chars", "word_chars"),
                ("n_symbols", "n_symbols"),
                ("__l.dup", "n_dup_lines"),
                ("__w.repeat", "n_repeat_words"),
                ("__l.n", "n_lines"),
                ("n_capitals", "n_capitals"),
            )
        ],
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def chi2_cdf(x: float, p: int) -> float:
    """Chi-squared distribution function, by the series of the lower incomplete gamma function."""
    a, x = p / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= x / (a + n)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return (low + high) / 2


def consistency(share: float, p: int) -> float:
    """What makes the covariance of the central share of a normal sample that of the whole."""
    return share / chi2_cdf(chi2_quantile(share, p), p + 2)


_GROUP = ("lang", "source")
#: What estimates are fitted for: of level 0 a language and source, of level 1 a language, of level 2 all rows.
_POOL = ("level", *_GROUP)


def _with_groups(rows: DataFrame, per_group: DataFrame) -> DataFrame:
    """Join on the group, where nulls are a language or source like others."""
    right = per_group.withColumnsRenamed({g: f"__{g}" for g in _POOL})
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in _POOL]
    return rows.join(right, same[0] & same[1] & same[2]).drop(*[f"__{g}" for g in _POOL])


def _z(p: int) -> list[str]:
    return [f"z{i}" for i in range(p)]


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def _moments(p: int) -> list[Column]:
    """n, sums and cross products of the vectors, as exact integers."""
    sums = [F.sum(f"z{i}").alias(f"s{i}") for i in range(p)]
    return [F.count(F.lit(1)).alias("n"), *sums, *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{i}_{j}") for i, j in _pairs(p)]]


def _estimate(moments: DataFrame, keep: Sequence[str], tolerances: Sequence[float], factor: float) -> DataFrame:
    """Centre m, Cholesky factor l and log determinant of each row's moments; tolerances keep it regular."""
    p = len(tolerances)
    out = moments.select(*keep, *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(p)], "n", *[f"s{i}_{j}" for i, j in _pairs(p)])
    cov = {(i, j): (F.col(f"s{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * factor + (tolerances[i] * UNIT) ** 2 * (i == j) for i, j in _pairs(p)}
    for i, j in _pairs(p):
        left = cov[i, j]
        for k in range(j):
            left = left - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(left, F.lit(1e-9))) if i == j else left / F.col(f"l{j}_{j}"))
    det = sum((F.log(F.col(f"l{i}_{i}")) for i in range(p)), F.lit(0.0))
    return out.select(*keep, *[f"m{i}" for i in range(p)], *[f"l{i}_{j}" for i, j in _pairs(p)], det.alias("log_det"))


def _distance(rows: DataFrame, p: int, keep: Sequence[str]) -> DataFrame:
    """rows(z, m, l) with d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(p):
        left = F.col(f"z{i}") - F.col(f"m{i}")
        for j in range(i):
            left = left - F.col(f"l{i}_{j}") * F.col(f"y{j}")
        rows = rows.withColumn(f"y{i}", left / F.col(f"l{i}_{i}"))
    return rows.select(*keep, sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(p)), F.lit(0.0)).alias("d2"))


def _concentrate(measured: DataFrame, p: int, support: float) -> DataFrame:
    """Moments, for each group and start, of the nearest buckets that hold the wanted share of the rows."""
    bucket = F.floor(16 * F.log2(1 + F.col("d2"))).cast("int")
    cells = measured.groupBy(*_POOL, "start", bucket.alias("bucket")).agg(*_moments(p))
    sums = [c for c in cells.columns if c not in (*_POOL, "start", "bucket")]
    inside = Window.partitionBy(*_POOL, "start")
    nearer = inside.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__all", F.sum("n").over(inside)).withColumn("__nearer", F.coalesce(F.sum("n").over(nearer), F.lit(0)))
    return cells.where(F.col("__nearer") < support * F.col("__all")).groupBy(*_POOL, "start").agg(*[F.sum(c).alias(c) for c in sums])


def _first_distances(vectors: DataFrame, p: int, tolerances: Sequence[float]) -> DataFrame:
    """Two starts: Euclidean and largest distance from the medians, in units of the median deviations."""
    each = vectors.select(*_POOL, F.posexplode(F.array(*[F.floor(F.col(z) / CELL) for z in _z(p)])).alias("dim", "cell"))
    cells = each.groupBy(*_POOL, "dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy(*_POOL, "dim")

    def median(rows: DataFrame, value: str, name: str) -> DataFrame:
        upto = inside.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
        reached = F.sum("n").over(upto) * 2 >= F.sum("n").over(inside)
        return rows.withColumn("__reached", reached).withColumn(name, F.min(F.when(F.col("__reached"), F.col(value))).over(inside)).drop("__reached")

    cells = median(cells, "cell", "med").withColumn("off", F.abs(F.col("cell") - F.col("med")))
    spread = median(cells, "off", "mad").groupBy(*_POOL, "dim").agg(F.min("med").alias("med"), F.min("mad").alias("mad"))
    wide = spread.groupBy(*_POOL).agg(
        *[F.max(F.when(F.col("dim") == i, (F.col("med") + 0.5) * CELL)).alias(f"m{i}") for i in range(p)],
        *[F.max(F.when(F.col("dim") == i, F.pow(1.4826 * CELL * F.col("mad"), F.lit(2)) + (tolerances[i] * UNIT) ** 2)).alias(f"v{i}") for i in range(p)],
    )
    wide, _ = written(wide, "mcd-medians")
    off = [F.pow(F.col(f"z{i}") - F.col(f"m{i}"), F.lit(2)) / F.col(f"v{i}") for i in range(p)]
    starts = F.explode(F.array(F.struct(F.lit(0).alias("start"), sum(off, F.lit(0.0)).alias("d2")), F.struct(F.lit(1).alias("start"), F.greatest(*off).alias("d2"))))
    return _with_groups(vectors, wide).select(*_POOL, *_z(p), starts.alias("__s")).select(*_POOL, *_z(p), "__s.start", "__s.d2")


def covariance_estimates(vectors: DataFrame, rules: Rules) -> DataFrame:
    """One row for each group of vectors(level, lang, source, z...) with rows enough: centre and Cholesky factor."""
    p = len(rules.statistics)
    tolerances = [s.tolerance for s in rules.statistics]
    sizes = vectors.groupBy(*_POOL).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rules.min_group).drop("n")
    fitted = _with_groups(vectors, sizes)
    keep, factor = [*_POOL, "start"], consistency(rules.support, p)
    measured = _first_distances(fitted, p, tolerances)
    for step in range(rules.steps + 1):
        estimates, _ = written(_estimate(_concentrate(measured, p, rules.support), keep, tolerances, factor), f"mcd-{step}")
        if step < rules.steps:
            measured = _distance(_with_groups(fitted, estimates), p, [*keep, *_z(p)])
    best = Window.partitionBy(*_POOL).orderBy("log_det", "start")
    raw = estimates.withColumn("__nth", F.row_number().over(best)).where("__nth = 1").drop("__nth", "start", "log_det")
    near = _distance(_with_groups(fitted, raw), p, [*_POOL, *_z(p)]).where(F.col("d2") <= chi2_quantile(rules.reweight, p))
    final = _estimate(near.groupBy(*_POOL).agg(*_moments(p)), _POOL, tolerances, consistency(rules.reweight, p))
    return written(final, "mcd-final")[0]


def with_vectors(stats: DataFrame, rules: Rules) -> DataFrame:
    return stats.withColumns({f"z{i}": F.round(F.expr(s.sql) * UNIT).cast("bigint") for i, s in enumerate(rules.statistics)})


def _judged(stats: DataFrame, estimates: DataFrame, rules: Rules, keep: Sequence[str]) -> DataFrame:
    """stats(lang, source, ...) with distance2 (null without an estimate or after the base rules) and kept."""
    p = len(rules.statistics)
    right = estimates.withColumnsRenamed({g: f"__{g}" for g in _GROUP})
    joined = with_vectors(stats, rules).join(right, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    measured = _distance(joined, p, [*keep, "base_failed", "m0"])
    distance = F.when(~F.col("base_failed") & F.col("m0").isNotNull(), F.col("d2"))
    # One comparison, not a conjunction: a part of it pushed below the join would compute the statistics again.
    rank = F.when(F.col("base_failed"), F.lit(float("inf"))).when(F.col("m0").isNull(), F.lit(0.0)).otherwise(F.col("d2"))
    return measured.select(*keep, "base_failed", distance.alias("distance2"), (rank <= rules.cutoff).alias("kept"))


def _fit(stats: DataFrame, rules: Rules) -> DataFrame:
    """One row for each (lang, source) that can be judged: the estimate of its own rows, else of its language's, else of all."""
    z = _z(len(rules.statistics))
    vectors, _ = written(with_vectors(stats.where(~F.col("base_failed")), rules).select(*_GROUP, *z), "mcd-vectors")
    if not rules.pooled:
        return covariance_estimates(vectors.select(F.lit(0).alias("level"), *_GROUP, *z), rules).drop("level")
    sizes, _ = written(vectors.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n")), "quality-sizes")
    languages = sizes.groupBy("lang").agg(F.sum("n").alias("of_lang"), F.min("n").alias("least")).where(F.col("least") < rules.min_group)
    languages, _ = written(languages.select(F.col("lang").alias("__lang"), F.when(F.col("of_lang") >= rules.min_group, 1).otherwise(2).alias("level")), "quality-languages")
    pools = [vectors.select(F.lit(0).alias("level"), *_GROUP, *z)]
    levels = {r["level"] for r in languages.select("level").distinct().collect()}
    same = F.col("lang").eqNullSafe(F.col("__lang"))
    if 1 in levels:
        own = vectors.join(languages.where("level = 1"), same, "left_semi")
        pools.append(own.select(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), *z))
    if 2 in levels:
        pools.append(vectors.select(F.lit(2).alias("level"), *[F.lit(None).cast("string").alias(g) for g in _GROUP], *z))
    fits = covariance_estimates(reduce(DataFrame.unionByName, pools), rules)
    out = fits.where("level = 0").drop("level")
    if not levels:
        return out
    small = sizes.where(F.col("n") < rules.min_group).join(languages, same).select(*_GROUP, "level")
    pooled = fits.where("level > 0").drop("source").withColumnsRenamed({"lang": "__lang", "level": "__level"})
    fitting = (F.col("level") == F.col("__level")) & ((F.col("level") == 2) | F.col("lang").eqNullSafe(F.col("__lang")))
    return out.unionByName(small.join(pooled, fitting).drop("level", "__level", "__lang"))


def quality_rules(docs: DataFrame, rules: Rules = POOLED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    distance2 and kept.

    Null texts count as empty and so fail the base rules; very long texts are read whole. A null language or source
    is a group of its own. Repeated rows and ids are judged each for itself. A distance at the cutoff stays. A group with fewer than ``min_group`` rows that pass the
    base rules is judged by the estimate of its language's rows, or of all where these are fewer too; where all are,
    distances are null and the rows kept, as in every small group of rules that are not ``pooled``. Other columns are ignored; an empty table gives no rows.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    stats, _ = written(text_statistics(named, rules), "quality-statistics")
    return _judged(stats, _fit(stats, rules), rules, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def drop_low_quality(docs: DataFrame, rules: Rules = POOLED) -> DataFrame:
    """docs(doc_id, text, lang, source, ...) without the rows that the rules reject; every column as it was.

    The verdicts are those of quality_rules: null, empty and short texts go, as do those that repeat themselves; rows
    with null ids, and repeated rows, are judged each for itself; very long texts are read whole; an empty table
    gives no rows. The rows are written with their statistics once, which the estimates read and the filter
    reads again, so no text is shuffled and none is counted twice.
    """
    rows = docs.select("text", *_GROUP, whole_row(docs).alias("__row"))
    stats, _ = written(text_statistics(rows, rules, keep=(*_GROUP, "__row")), "quality-statistics", "zstd")
    return _judged(stats, _fit(stats.drop("__row"), rules), rules, ["__row"]).where("kept").select("__row.*")
