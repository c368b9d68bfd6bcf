"""Quality rules and robust outliers of document statistics, in DataFrame functions only.

Five statistics of each text are transformed and, for every language and source, a minimum covariance
determinant estimate is made: the mean and covariance of the three quarters of rows that make the determinant
smallest. From two robust starts, concentration steps keep the nearest rows and estimate again until
no determinant falls any more. Rows beyond a quantile of Mahalanobis distance are outliers.

Each step is one aggregate of counts, sums and products by group, so groups of any size are summed
within tasks first; matrices are factorised in column expressions on the table of groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.shared import staged

VECTOR = ("x0", "x1", "x2", "x3", "x4")
_P = len(VECTOR)
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]


@dataclass(frozen=True)
class Spec:
    """`least` rows make a group; `floor` times its part in `floors` is added to the variance of each statistic.

    Floors keep the estimate regular, as most texts have no symbols at all; a spread of 5 % in mean word length and
    of 3 % in the share of repeated words counts as noise. `cut` is the 99.99 % quantile of chi-square with five
    degrees of freedom, `scale` the consistency factor at five dimensions: `share` over the probability that
    chi-square with seven degrees lies below the `share` quantile of chi-square with five.
    """

    share: float = 0.75
    least: int = 100
    floor: float = 0.05
    floors: tuple[float, ...] = (1.0, 0.05, 1.0, 1.0, 0.5)
    cut: float = 25.745
    scale: float = 1.412
    steps: int = 12
    accuracy: int = 2000


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ", -1), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more, each word once."""
    last = F.size(words) - 5

    def covered(ordered: Column) -> Column:
        again = F.filter(F.transform(ordered, lambda s, k: F.when(
            (F.get(ordered, k - 1)["h"] == s["h"]) | (F.get(ordered, k + 1)["h"] == s["h"]), s["i"])),
            lambda i: i.isNotNull())
        return F.aggregate(F.sort_array(again), F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
                           lambda done, i: F.struct((done["n"] + i + 5 - F.greatest(i, done["reach"])).alias("n"),
                                                    (i + 5).alias("reach")), lambda done: done["n"])

    def repeated(hashes: Column) -> Column:
        ordered = F.sort_array(F.zip_with(hashes, F.sequence(F.lit(0), last),
                                          lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(ordered, covered))

    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))
    return F.when(last < 1, F.lit(0)).otherwise(_let(hashes, repeated))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               source_col: str = "source") -> DataFrame:
    """Per row: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Null and empty texts have no words. Null languages and sources are groups of their own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.translate(text, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    counted = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        F.length(plain).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"),
                                              _repeat_words(w).cast("long").alias("again"))).alias("words"))
    n, again = F.col("words.n"), F.col("words.again")
    return counted.select("doc_id", "lang", "source", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                          again.alias("n_repeat_words"), ((n < 10) | (again * 100 > n * 20)).alias("base_failed"))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log1p(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log1p(100 * F.col("n_symbols") / n),
            F.log1p(F.col("n_dup_lines")), 5 * F.col("n_repeat_words") / n]


def _solve(groups: DataFrame, spec: Spec) -> DataFrame:
    """Mean m, inverse Cholesky diagonal and lower factor of each group's floored covariance, and its log determinant."""
    out = groups
    for i in range(_P):
        out = out.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n"))
    for i, j in _PAIRS:
        value = F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
        out = out.withColumn(f"c{i}{j}", F.greatest(value, F.lit(0.0)) + spec.floor * spec.floors[i] if i == j else value)
    for j in range(_P):
        for i in range(j, _P):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    det = sum(2 * F.log(F.col(f"l{i}{i}")) for i in range(_P))
    return out.select(*[c for c in groups.columns if c[0] != "s" or c in ("start", "source")], det.alias("det"),
                      *[f"m{i}" for i in range(_P)], *[f"l{i}{j}" for i, j in _PAIRS])


def _distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance by forward substitution, from columns x, m and l."""
    def forward(i: int, solved: list[Column]) -> list[Column]:
        if i == _P:
            return solved
        rest = F.col(VECTOR[i]) - F.col(f"m{i}")
        for k, y in enumerate(solved):
            rest = rest - F.col(f"l{i}{k}") * y
        return forward(i + 1, [*solved, rest / F.col(f"l{i}{i}")])

    # the inverse of the factor, so that no solved entry is written out twice
    return sum(y * y for y in forward(0, []))


def _moments(rows: DataFrame, keys: list[str], vector=VECTOR) -> DataFrame:
    return rows.groupBy(keys).agg(
        F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(vector)],
        *[F.sum(F.col(vector[i]) * F.col(vector[j])).alias(f"s{i}{j}") for i, j in _PAIRS])


def estimates(rows: DataFrame, spec: Spec) -> DataFrame:
    """The estimate of each group `g` of rows (g, x0..x4) with enough rows: g, m*, l*, det."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("size"), *[
        F.percentile_approx(x, F.lit([0.25, 0.5, 0.75]), spec.accuracy).alias(f"q{i}")
        for i, x in enumerate(VECTOR)]).where(F.col("size") >= spec.least)
    scales = staged(sizes.select("g", "size", *[F.col(f"q{i}")[1].alias(f"mid{i}") for i in range(_P)], *[
        F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit((spec.floor * spec.floors[i]) ** 0.5)).alias(f"mad{i}")
        for i in range(_P)]), "scales")
    z = [(F.col(x) - F.col(f"mid{i}")) / F.col(f"mad{i}") for i, x in enumerate(VECTOR)]
    # start 0: median and quartiles by coordinate; start 1: correlations of squashed coordinates
    tanh = rows.join(scales, "g").select("g", *[F.tanh(v).alias(f"t{i}") for i, v in enumerate(z)])
    squashed = _moments(tanh, ["g"], tuple(f"t{i}" for i in range(_P))).join(scales.drop("size"), "g")
    firsts = [scales.select("g", F.lit(0).alias("start"), F.col("size").alias("n"), *[
        (F.col(f"mid{i}") * F.col("size")).alias(f"s{i}") for i in range(_P)], *[
        ((F.col(f"mid{i}") * F.col(f"mid{j}") + (F.col(f"mad{i}") ** 2 if i == j else F.lit(0.0))) * F.col("size"))
        .alias(f"s{i}{j}") for i, j in _PAIRS])]
    cov = {(i, j): (F.col(f"s{i}{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") ** 2)
           * 2 * F.col(f"mad{i}") * F.col(f"mad{j}") for i, j in _PAIRS}
    firsts.append(squashed.select("g", F.lit(1).alias("start"), "n", *[
        (F.col(f"mid{i}") * F.col("n")).alias(f"s{i}") for i in range(_P)], *[
        ((F.col(f"mid{i}") * F.col(f"mid{j}") + cov[i, j]) * F.col("n")).alias(f"s{i}{j}") for i, j in _PAIRS]))
    known = staged(_solve(firsts[0].unionByName(firsts[1]), spec), "estimates")
    for _ in range(spec.steps):
        at = rows.join(known.drop("n"), "g").select("g", "start", *VECTOR, _distance().alias("d"))
        near = at.groupBy("g", "start").agg(F.percentile_approx("d", spec.share, spec.accuracy).alias("cut"))
        kept = at.join(near, ["g", "start"]).where("d <= cut")
        after = staged(_solve(_moments(kept, ["g", "start"]), spec), "estimates")
        falls = (after.join(known.select("g", "start", F.col("det").alias("before")), ["g", "start"])
                 .where("det < before - 1e-3").limit(1).count())
        known = after
        if not falls:
            break
    best = known.groupBy("g").agg(F.min("det").alias("least"))
    first = known.join(best, "g").where("det <= least").groupBy("g").agg(F.min("start").alias("start"))
    return known.join(first, ["g", "start"]).drop("start", "n")


def verdicts(docs: DataFrame, spec: Spec = Spec(), **columns) -> DataFrame:
    """`statistics` of every row with distance and kept.

    Estimates are made from rows that pass the base rules. A group with fewer than spec.least of them is judged by
    its language, then by all rows together; where even those are too few, no row is an outlier.
    kept is false for a row that fails the base rules or lies beyond the cut.
    """
    rows = staged(statistics(docs, **columns), "statistics")
    x = rows.select("*", *[v.alias(name) for v, name in zip(_vector(), VECTOR, strict=True)])
    level = [F.to_json(F.struct(F.lit(0).alias("k"), "lang", "source")), F.to_json(F.struct(F.lit(1).alias("k"), "lang")),
             F.lit("{}")]
    spread = (x.where("not base_failed").select(F.explode(F.array(*level)).alias("g"), *VECTOR))
    found = staged(estimates(spread, spec), "groups")
    sizes = found.select("g")
    named = x.select("*", *[v.alias(f"g{i}") for i, v in enumerate(level)])
    pairs = named.select("lang", "source", "g0", "g1", "g2").distinct()
    for i in range(3):
        pairs = pairs.join(sizes.select(F.col("g").alias(f"has{i}")), F.col(f"g{i}") == F.col(f"has{i}"), "left")
    chosen = pairs.select("g0", F.coalesce("has0", "has1", "has2").alias("g")).join(found, "g", "left").drop("g")
    judged = named.join(chosen.withColumnRenamed("g0", "own"), F.col("g0") == F.col("own"), "left")
    d = _distance()
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         d.alias("distance"),
                         (~F.col("base_failed") & ~F.coalesce(d > spec.cut * spec.scale, F.lit(False))).alias("kept"))
