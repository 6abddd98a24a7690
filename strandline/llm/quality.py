"""Quality rules: text statistics and robust multivariate outliers; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, staged, staged_small

#: Transformed statistics and the least standard deviation that each is given.
FEATURES = {
    "x0": ("ln(n_words)", 0.5),
    "x1": ("ln((word_chars + 1) / (n_words + 1))", 0.1),
    "x2": ("ln(1 + 10 * n_symbols / greatest(n_words, 1))", 0.1),
    "x3": ("n_repeat_words / greatest(n_words, 1)", 0.1),
    "x4": ("n_dup_lines / greatest(n_lines, 1)", 0.1),
}
_D = len(FEATURES)
_BITS = 26  # of a word's position, when packed with the head of a window's hash
_BIN = 0.01


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long); input columns of these names are replaced.

    Null texts count as empty. Repeated windows are found in n log n steps a row: each window's
    hash head is packed with its position in one long and sorted; if two different hashes share
    a head (or a text has 2^26 words), pairs of full hash and position are sorted instead.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    space, pos = r"[\\x20\\x09-\\x0D]+", (1 << _BITS) - 1
    d = df.drop(*new).withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn("_w", F.expr(f"filter(split(_t, '{space}', -1), w -> w <> '')"))
    d = d.withColumn("_g", F.expr("case when size(_w) >= 3 then transform(sequence(0, size(_w) - 3), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))) else cast(array() as array<bigint>) end"))
    d = d.withColumn("_v", F.expr(f"sort_array(transform(_g, (h, i) -> (h & {~pos}L) | cast(i as bigint)))"))
    same = f"shiftright(x, {_BITS}) = shiftright(get(_v, %s), {_BITS})"
    d = d.withColumn("_r", F.expr(f"filter(_v, (x, j) -> (j > 0 and {same % 'j - 1'}) or (j < size(_v) - 1 and {same % 'j + 1'}))"))
    clash = f"shiftright(x, {_BITS}) = shiftright(get(_r, j + 1), {_BITS}) and get(_g, cast(x & {pos}L as int)) <> get(_g, cast(get(_r, j + 1) & {pos}L as int))"
    pairs = "array_sort(transform(_g, (h, i) -> struct(h as h, cast(i as bigint) as i)))"
    slow = f"transform(array({pairs}), p -> transform(filter(transform(p, (x, j) -> struct(x.i as i, coalesce(get(p, j - 1).h = x.h, false) or coalesce(get(p, j + 1).h = x.h, false) as twice)), x -> x.twice), x -> x.i))[0]"
    at = f"case when size(_g) > {pos} or array_contains(transform(_r, (x, j) -> coalesce(j < size(_r) - 1 and {clash}, false)), true) then {slow} else transform(_r, x -> x & {pos}L) end"
    d = d.withColumn("_at", F.expr(f"sort_array({at})"))
    d = d.withColumn("_lines", F.expr(f"filter(split(_t, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    return d.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in new],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(transform(_at, (x, j) -> least(3L, coalesce(get(_at, j + 1) - x, 3L))), 0L, (a, b) -> a + b)").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def chi_square_cdf(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom <= x), by the series of the incomplete gamma function."""
    a, half = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= half / n
        total += term
    return total * math.exp(a * math.log(half) - half - math.lgamma(a)) if x > 0 else 0.0


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, k) < p else (low, mid)
    return high


def _with_distance(rows: DataFrame) -> DataFrame:
    """Adds _d2, the squared distance from center c* by Cholesky factor l** (forward substitution), and its bin."""
    z = [f"(x{i} - c{i}" + "".join(f" - l{i}{j} * z{j}" for j in range(i)) + f") / l{i}{i} as z{i}" for i in range(_D)]
    d2 = " + ".join(f"z{i} * z{i}" for i in range(_D))
    return rows.selectExpr("*", *z, f"{d2} as _d2", "floor(ln(_d2 + 1e-9D) * 32) as _bin")


#: The group of all rows, whose estimate stands behind those of small groups; no key looks like it.
_ALL = "*"
_PAIRS = [(i, j) for i in range(_D) for j in range(i + 1)]
_MODEL = [f"c{i}" for i in range(_D)] + [f"s{i}{j}" for i, j in _PAIRS]


def _moments(rows: DataFrame, weight: str, scale: float, *by: str) -> DataFrame:
    """Weighted centers c* and covariances s** (times ``scale``) of the vectors x* of each group."""
    sums = rows.withColumn("_w", F.expr(weight)).groupBy(*by).agg(
        F.sum("_w").alias("w"), *[F.expr(f"sum(_w * x{i}) as m{i}") for i in range(_D)], *[F.expr(f"sum(_w * x{i} * x{j}) as m{i}{j}") for i, j in _PAIRS]
    ).filter("w > 0")
    cov = {(i, j): f"{scale}D * (m{i}{j} / w - c{i} * c{j})" for i, j in _PAIRS}
    cov = [f"{f'greatest({v}, 0D)' if i == j else v} as s{i}{j}" for (i, j), v in cov.items()]
    return sums.selectExpr(*by, "w", *[f"m{i}{j}" for i, j in _PAIRS], *[f"m{i} / w as c{i}" for i in range(_D)], *cov).select(*by, *_MODEL)


def _factor(model: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l** of the covariance, each variance with its floor, and logdet."""
    floors = [f for _, f in FEATURES.values()]
    factor = []
    for i, j in _PAIRS:
        a = f"s{i}{j}" + f" + {floors[i] ** 2}D" * (i == j) + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        factor.append((f"sqrt(greatest({a}, {floors[i] ** 2 / 4}D))" if i == j else f"({a}) / l{j}{j}") + f" as l{i}{j}")
    return model.selectExpr("*", *factor, " + ".join(f"2 * ln(l{i}{i})" for i in range(_D)) + " as logdet")


def _starts(ok: DataFrame) -> DataFrame:
    """Five first estimates a group, by start: medians and quartile spreads; moments under weights
    that fall with the standardised distance, and under unit directions; two random eighths."""
    bins = ok.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.round(F.col(f"x{i}") / _BIN).cast("long").alias("b")) for i in range(_D)])).alias("e"))
    bins = staged_small(bins.groupBy("g", "e.f", "e.b").count(), "quality-bins")  # counted first: windows get a row a bin
    gf = Window.partitionBy("g", "f")
    bins = bins.withColumn("upto", F.sum("count").over(gf.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("count").over(gf))
    quart = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("b"))) * _BIN
    each = bins.groupBy("g", "f").agg(quart(0.5).alias("c"), ((quart(0.75) - quart(0.25)) / 1.349).alias("s"), F.max("all").alias("n"))
    first = each.groupBy("g").agg(
        F.max("n").alias("n"), *[F.expr(f"max(case when f = {i} then c end) as c{i}") for i in range(_D)],
        *[F.expr(f"max(case when f = {i} then s * s end) as s{i}{j}" if i == j else f"0D as s{i}{j}") for i, j in _PAIRS],
    )
    first = staged_small(_factor(first), "quality-first")
    z2 = F.col("_d2")
    ways = F.array(
        F.struct(F.lit(1).alias("start"), F.pow(1 + z2 / _D, F.lit(-2.0)).alias("weight")),
        F.struct(F.lit(2).alias("start"), (1 / F.sqrt(F.greatest(z2, F.lit(0.01)))).alias("weight")),
        F.struct((F.col("_eighth") + 3).cast("int").alias("start"), (F.col("_eighth") < 2).cast("double").alias("weight")),
    )
    eighth = F.pmod(F.xxhash64(*FEATURES), F.lit(8)).alias("_eighth")
    near = _with_distance(ok.select("g", *FEATURES, eighth).join(first.drop("n", "logdet"), "g"))
    near = near.select("g", *FEATURES, F.explode(ways).alias("e")).select("g", *FEATURES, "e.start", "e.weight").filter("weight > 0")
    more = _moments(near, "weight", 1.0, "g", "start").join(first.select("g", "n"), "g")
    return first.select("g", F.lit(0).alias("start"), "n", *_MODEL).unionByName(more)


def _least(model: DataFrame) -> DataFrame:
    """Of each group the estimate with the least determinant, the earlier start's among equals."""
    rest = [c for c in model.columns if c not in ("g", "logdet", "start")]
    return model.groupBy("g").agg(F.min(F.struct("logdet", "start", *rest)).alias("b")).select("g", *[f"b.{c}" for c in ("logdet", "start", *rest)]).select(*model.columns)


def robust_outliers(
    df: DataFrame, groups: tuple[str, ...] = ("lang", "source"), text: str = "text", h: float = 0.75, steps: int = 8,
    tail: float = 1e-10, prior: float = 50.0, carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """Columns ``carry`` (all but the text if None), text_hash, the statistics, base_failed, distance2 and kept.

    Rows that pass the base rules give the vectors of FEATURES. In each group of ``groups`` the
    minimum covariance determinant is sought from the five starts of _starts() by concentration
    steps: the share ``h`` of rows nearest by Mahalanobis distance gives the next center and
    covariance (scaled for consistency, with a floor on its diagonal). After two steps the start
    with the least determinant goes on, until no log determinant falls by 0.05 (``steps`` steps
    at most). All rows
    together are a group as well, and its estimate counts as ``prior`` rows in that of each group,
    so a small group is judged mostly as a part of the whole and a large one by itself, at every
    size by one formula. A row is kept if it passes the base rules and its squared distance is at
    most the chi-square quantile at 1 - ``tail`` (text statistics have heavier tails than a normal
    law). Quantiles come from fixed bins, so they need counts only, and every figure covers all
    rows; equal determinants fall to the earlier start.

    Null groups are groups, null and empty texts fail, texts of any length are read whole,
    repeated rows count each and share their verdict, an empty table gives an empty result,
    columns of the result's names are replaced. Per-group sums are partial sums before any
    exchange, so a group with a third of the rows costs no more than another. The rows are
    written once with what is carried, and are not shuffled.
    """
    new = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", "kept", "text_hash"}
    rest = [c for c in (carry or [c for c in df.columns if c != text]) if c not in new]
    src = df.select(
        F.struct(*[F.col(f"`{c}`") for c in rest], F.xxhash64(F.col(text)).alias("text_hash")).alias("_row"),
        F.to_json(F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(groups)])).alias("g"), F.col(text).alias("_text"),
    )
    rows = text_statistics(src, "_text").drop("_text").withColumn("base_failed", base_failed())
    rows = staged(rows.withColumns({k: F.expr(e) for k, (e, _) in FEATURES.items()}), "quality-rows")
    fit = ~F.col("base_failed")
    ok = rows.filter(fit).select(F.explode(F.array("g", F.lit(_ALL))).alias("g"), *FEATURES)
    limit = chi_square_quantile(1 - tail, _D)
    scale = h / chi_square_cdf(chi_square_quantile(h, _D), _D + 2)
    model = staged_small(_factor(_starts(ok)), "quality-starts")
    for step in range(steps):
        seen = _with_distance(ok.join(model.select("g", "start", *_MODEL, *[f"l{i}{j}" for i, j in _PAIRS]), "g"))
        counted = seen.groupBy("g", "start", "_bin").count()
        by = Window.partitionBy("g", "start")
        counted = counted.withColumn("upto", F.sum("count").over(by.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("count").over(by))
        edge = counted.groupBy("g", "start").agg(F.min(F.when(F.col("upto") >= F.col("all") * h, F.col("_bin"))).alias("_edge"))
        edge = staged_small(edge, f"quality-edge{step}")  # a few rows: written, Spark knows that
        near = seen.select("g", "start", *FEATURES, "_bin").join(edge, ["g", "start"]).filter(F.col("_bin") <= F.col("_edge"))
        was = model.select("g", "start", "n", F.col("logdet").alias("_was"))
        found = _factor(_moments(near, "1D", scale, "g", "start")).join(was, ["g", "start"])
        if step == 1:
            found = _least(found)
        found = staged_small(found, f"quality-step{step}")
        release(edge, model)
        model = found
        if model.filter(F.col("_was") - F.col("logdet") > 0.05).isEmpty():
            break
    best = staged_small(_least(model).select("g", "n", *_MODEL), "quality-best")
    whole = best.filter(F.col("g") == _ALL).first()
    if whole:
        own, all_ = f"(n / (n + {prior}D))", {c: f"{whole[c]!r}D" for c in _MODEL}
        blend = [f"{own} * {c} + (1 - {own}) * {all_[c]}" + (f" + {own} * (1 - {own}) * (c{c[1]} - {all_[f'c{c[1]}']}) * (c{c[2]} - {all_[f'c{c[2]}']})" if c[0] == "s" else "") + f" as {c}" for c in _MODEL]
        best = staged_small(_factor(best.selectExpr("g", *[x.replace(" as ", " as _b") for x in blend]).toDF("g", *_MODEL)).drop("logdet"), "quality-final")
    else:
        best = _factor(best.select("g", *_MODEL)).drop("logdet")
    judged = _with_distance(rows.join(best, "g", "left"))
    return judged.select(
        "_row.*", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(fit, F.col("_d2")).alias("distance2"), (fit & F.coalesce(F.col("_d2") <= limit, F.lit(False))).alias("kept"),
    )
