"""Quality rules and robust multivariate outliers, in DataFrame operations only.

``text_statistics`` counts, within one row each, what the base rules and the outlier test need. ``outliers`` estimates centre
and scatter of the transformed statistics for every language and source by the minimum covariance determinant: from several
starts (coordinate medians, each coordinate alone, small random samples), concentration steps refit mean and covariance on the
half of the documents that has the least Mahalanobis distance. The starts of least determinant go on until their bounds
settle, the fit of least determinant is kept for each group, and a last fit rests on all documents that are near it. All
estimates are pre-aggregated sums, and medians and subsets come from histograms of fine steps, so a source that holds a third
of all documents is never gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, let, salted_join, text_of, written

SYMBOLS, WINDOW = "#*$%&|<>", 8
#: Base rules: fewer words than this fail, and more than this percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Part of a group that the estimates rest on, documents that a group needs to be judged.
SUBSET, LEAST_GROUP = 0.5, 40
#: Random starts and the documents of each, steps that every start takes, starts that go on, steps at most from there.
SAMPLES, SAMPLE, FIRST_STEPS, GO_ON, MOST_STEPS = 3, 12, 2, 2, 20
#: The covariance of that part of a normal cloud in five dimensions, times this, is that of the whole; the squared distance up
#: to which documents have a part in the last fit (39 of 40 normal vectors are as near), and its factor. A document goes if its
#: squared distance is beyond the cutoff (a normal vector is, once in ten thousand).
CONSISTENT, NEAR, NEAR_CONSISTENT, CUTOFF = 1.91, 12.83, 1.05, 25.74
#: Least standard deviation of each statistic: a group in which nearly all values are equal is not a reason to reject. Those of x3
#: and x4 are small enough that a quarter of repeated lines, or of repeated words, can reach the cutoff alone.
FLOORS = {"x0": 0.5, "x1": 0.12, "x2": 0.06, "x3": 0.1, "x4": 0.1}
STEPS_A_UNIT = 256
#: Up to so many groups (some 2 KB each) their estimates are broadcast.
FEW_GROUPS = 10_000


def _repeated(words: Column, n: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more."""

    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = lambda e, j: (F.get(s, j - 1)["g"] == e["g"]) | (F.get(s, j + 1)["g"] == e["g"])
            return F.sort_array(F.array_compact(F.transform(s, lambda e, j: F.when(same(e, j), e["i"]))))

        gap = lambda at: F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
        return let(let(placed, marked), gap)

    def of(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), covered(grams)).otherwise(0)

    one = F.transform(words, lambda w: F.xxhash64(w))
    two = let(one, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1))))
    eight = let(two, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(2, WINDOW, 2)])))
    return F.when(n > WINDOW, let(F.slice(eight, 1, n - (WINDOW - 1)), of)).otherwise(0)


def text_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """(keep..., n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every row; a null text has none.

    n_lines counts the lines with a word. Other columns are left out.
    """
    text = text_of(docs)
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    chars = lambda w: F.length(F.array_join(w, "")).cast("long")
    stats = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), chars(w).alias("word_chars"), _repeated(w, F.size(w)).cast("long").alias("n_repeat_words")))
    line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long")
    rows = docs.select(*keep, stats.alias("_w"), line.alias("_l"), symbols.alias("n_symbols"))
    return rows.select(*keep, "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines", "_w.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def vector() -> dict[str, Column]:
    """The transformed statistics: length, word length, and the roots of symbol, repeated line and repeated word shares."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    return {
        "x0": F.log(n), "x1": F.log(chars / n), "x2": F.sqrt(F.col("n_symbols") / chars),
        "x3": F.sqrt(F.col("n_dup_lines") / lines), "x4": F.sqrt(F.col("n_repeat_words") / n),
    }


def _quantile(rows: DataFrame, keys: list[str], step: str, part: float, name: str) -> DataFrame:
    """(keys..., name): the step of a histogram below or at which at least ``part`` of the group's rows are."""
    counts = rows.groupBy(*keys, step).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys)
    run = group.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    at = counts.withColumn("sum", F.sum("n").over(run)).withColumn("all", F.sum("n").over(group))
    return at.filter(F.col("sum") >= F.col("all") * part).groupBy(*keys).agg(F.min(step).alias(name))


def _fit(subset: DataFrame, names: list[str], keys: tuple[str, ...] = ("gkey",), factor: float = CONSISTENT) -> DataFrame:
    """(keys..., m0.., a00.., det): means and the inverse of the Cholesky factor of the covariance of each group, and the log of
    its determinant."""
    d = range(len(names))
    below = [(i, j) for i in d for j in range(i + 1)]
    total = lambda parts: " + ".join(["0D", *parts])
    means = [f"avg({x}) AS m{i}" for i, x in enumerate(names)]
    products = [f"avg({names[i]} * {names[j]}) AS p{i}{j}" for i, j in below]
    floor = lambda i, j: (FLOORS[names[i]] ** 2 if names[i] in FLOORS else 1e-6) if i == j else 0
    cov = [f"(p{i}{j} - m{i} * m{j}) * {factor}D + {floor(i, j)!r}D AS s{i}{j}" for i, j in below]
    factors, inverse = [], []  # each is made of those before it
    for j in d:
        for i in d[j:]:
            rest = f"s{i}{j} - ({total(f'l{i}{k} * l{j}{k}' for k in range(j))})"
            factors.append(f"sqrt(greatest({rest}, 1e-9D)) AS l{j}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
            row = f"1D / l{i}{i}" if i == j else f"-({total(f'l{i}{k} * a{k}{j}' for k in range(j, i))}) / l{i}{i}"
            inverse.append(f"{row} AS a{i}{j}")
    det = f"{total(f'ln(l{i}{i})' for i in d)} AS det"
    est = subset.groupBy(*keys).agg(*map(F.expr, [*means, *products]))
    est = est.selectExpr(*keys, *[f"m{i}" for i in d], *cov).selectExpr("*", *factors)
    return est.selectExpr("*", *inverse, det).select(*keys, *_parameters(len(names)), "det")


def _parameters(d: int) -> list[str]:
    return [*[f"m{i}" for i in range(d)], *[f"a{i}{j}" for i in range(d) for j in range(i + 1)]]


def _distance(names: list[str]) -> Column:
    parts = [" + ".join(f"a{i}{j} * ({names[j]} - m{j})" for j in range(i + 1)) for i in range(len(names))]
    return F.expr(" + ".join(f"({y}) * ({y})" for y in parts))


def _log_step(x: Column) -> Column:
    return F.round(F.log(x + 1e-6) * STEPS_A_UNIT).cast("int")


def outliers(rows: DataFrame, names: list[str]) -> DataFrame:
    """(gkey, id..., distance) of ``rows`` (gkey, columns ``names``, any others, all kept): the squared Mahalanobis distance
    from the group's estimates. Groups of fewer than LEAST_GROUP rows are left out.

    ``rows`` should be a written table: every step reads it once or twice.
    """
    groups = rows.groupBy("gkey").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_GROUP)
    sizes = written(groups, "sizes")
    few = sizes.count() <= FEW_GROUPS
    rows = _with_group(rows, sizes.select("gkey"), few)
    long = rows.select("gkey", F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.col(x).alias("x")) for x in names])).alias("v")).select("gkey", "v.*")
    step = F.round(F.col("x") * STEPS_A_UNIT).cast("long")
    middles = written(_quantile(long.withColumn("step", step), ["gkey", "name"], "step", 0.5, "middle"), "middles")
    wide = middles.groupBy("gkey").agg(F.map_from_entries(F.collect_list(F.struct("name", "middle"))).alias("middles"))
    spread = _with_group(long, wide, few).withColumn("middle", F.element_at("middles", F.col("name"))).drop("middles")
    spread = spread.withColumn("step", F.abs(step - F.col("middle")))
    spreads = _quantile(spread, ["gkey", "name"], "step", 0.5, "spread")
    d = len(names)
    start = middles.join(spreads, ["gkey", "name"]).groupBy("gkey")
    at = lambda x, c: F.max(F.when(F.col("name") == x, F.col(c))) / STEPS_A_UNIT
    scale = lambda i: F.greatest(at(names[i], "spread") * 1.4826, F.lit(FLOORS.get(names[i], 1e-3)))
    start = start.agg(*[at(x, "middle").alias(f"m{i}") for i, x in enumerate(names)], *[(1 / scale(i)).alias(f"d{i}") for i in range(d)])
    part = lambda s, i, j: F.col(f"d{i}") if i == j and s in (0, i + 1) else F.lit(0.0)
    one = lambda s: F.struct(F.lit(s).alias("s"), *[F.col(f"m{i}") for i in range(d)], *[part(s, i, j).alias(f"a{i}{j}") for i in range(d) for j in range(i + 1)], F.lit(0.0).alias("det"), F.lit(None).cast("int").alias("bound"))
    fits = start.select("gkey", F.inline(F.array(*[one(s) for s in range(d + 1)])))
    slim = written(rows.select("gkey", *names, F.xxhash64(*rows.columns).alias("h")), "vectors")
    drawn = _with_group(slim, sizes, few).withColumn("s", F.explode(F.sequence(F.lit(d + 1), F.lit(d + SAMPLES))))
    drawn = drawn.filter(F.pmod(F.xxhash64("h", "s"), F.ceil(F.col("n") / SAMPLE)) == 0)
    fits = written(fits.unionByName(_fit(drawn, names, ("gkey", "s")), allowMissingColumns=True), "scatter")
    slim = slim.select("gkey", *names)
    for _ in range(FIRST_STEPS):
        fits = _concentrated(slim, fits, names, few)
    best = F.row_number().over(Window.partitionBy("gkey").orderBy("det", "s"))
    fits = written(fits.withColumn("_nth", best).filter(F.col("_nth") <= GO_ON).drop("_nth"), "scatter")
    for _ in range(MOST_STEPS):
        fits = _concentrated(slim, fits, names, few)
        if fits.filter("abs(bound - was) > 1").isEmpty():
            break
    kept = [*_parameters(d), "det"]
    fits = fits.groupBy("gkey").agg(F.min_by(F.struct(*kept), F.struct("det", "s")).alias("f")).select("gkey", "f.*")
    near = _with_group(slim, written(fits, "scatter"), few).filter(_distance(names) <= NEAR)
    fits = written(_fit(near, names, factor=NEAR_CONSISTENT), "scatter")
    return _with_group(rows, fits, few).select(*rows.columns, _distance(names).alias("distance"))


def _with_group(rows: DataFrame, small: DataFrame, few: bool, on: tuple[str, ...] = ("gkey",)) -> DataFrame:
    """``rows`` joined with ``small``, a row or a few for each group: broadcast if the groups are few, else by salted keys."""
    return rows.join(F.broadcast(small), list(on)) if few else salted_join(rows, small, on)


def _concentrated(rows: DataFrame, fits: DataFrame, names: list[str], few: bool) -> DataFrame:
    """The fits (gkey, s, parameters, det, bound, was) after a concentration step of each start: ``bound`` is that of the subset
    they rest on, ``was`` the one before. One job, which reads ``rows`` twice and shuffles histograms and sums only."""
    start = fits.select("gkey", "s", *_parameters(len(names)), F.col("bound").alias("was"))
    measured = _with_group(rows, start, few).select("gkey", "s", "was", *names, _log_step(_distance(names)).alias("step"))
    bounds = _quantile(measured.select("gkey", "s", "step"), ["gkey", "s"], "step", SUBSET, "bound")
    subset = _with_group(measured, bounds, few, ("gkey", "s")).filter("step <= bound")
    return written(_fit(subset, names, ("gkey", "s", "bound", "was")), "scatter")


def with_groups(rows: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    """``rows`` (lang, source, ...) with gkey: language and source; of those with fewer than ``least`` rows the language
    alone, and if these are fewer still, one key for all. Nulls are a value."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    both, lang = F.concat(part("lang"), part("source")), F.concat(part("lang"), F.lit("*"))
    fine = rows.groupBy(both.alias("_fine"), lang.alias("_lang")).agg(F.count("*").alias("n"))
    pooled = fine.withColumn("gkey", F.when(F.col("n") >= least, F.col("_fine")).otherwise(F.col("_lang")))
    total = F.sum("n").over(Window.partitionBy("gkey"))
    keys = pooled.withColumn("gkey", F.when(total >= least, F.col("gkey")).otherwise(F.lit("*"))).select("_fine", "gkey")
    return salted_join(rows.withColumn("_fine", both), keys, "_fine").drop("_fine")


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One row a document: doc_id, the statistics, base_failed, distance, kept.

    Documents that fail the base rules are not kept and have no part in the estimates. Others are kept unless they are
    outliers of their language and source; small groups are judged together, and kept if they are too few even so. A null
    text fails.
    """
    stats = written(text_statistics(docs).withColumn("base_failed", base_failed()), "quality")
    names = list(FLOORS)
    good = written(with_groups(stats.filter("not base_failed")).select("*", *[c.alias(x) for x, c in vector().items()]), "quality-vectors")
    far = outliers(good, names)
    small = salted_join(good, far.select("gkey").distinct(), "gkey", "left_anti").withColumn("distance", F.lit(None).cast("double"))
    failed = stats.filter("base_failed").withColumn("distance", F.lit(None).cast("double"))
    cols = [*stats.columns, "distance"]
    rows = far.select(*cols).unionByName(small.select(*cols)).unionByName(failed.select(*cols))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return rows.withColumn("kept", kept)
