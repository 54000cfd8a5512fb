"""Quality rules: fixed limits, then robust multivariate outliers by language and source.

Every text becomes a few counts, and these a vector of whole numbers: logarithms of lengths and shares in
units of 1 / 256. For every group of language and source, the minimum covariance determinant looks for the
``share`` of rows whose covariance has the smallest determinant. Two starts rank the rows by their distance
from the medians, in median deviations (sum of squares, and largest); each then takes concentration steps: mean
and covariance of the rows in the subset, distances of all rows, the rows with the smallest ones as the next
subset. The start that ends with the smaller determinant gives the estimate, corrected for the rows left out;
rows beyond a quantile of the chi-square distribution are rejected.

No group meets in one task: sums and counts are combined before they move, and the border of a subset comes
from counts of rows by distance, in steps finer than two per cent. Sums are of whole numbers, so nothing depends on the
order of rows; a border takes all its ties. All of it is columns of Spark; there is no Python on the data path.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from movewell.llm.common import let, stored, texts_of

GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"

UNIT = 256
#: The vector, as SQL over the counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), all doubles.
STATISTICS = ("ln(1.0e0 + n_words)", "ln((1.0e0 + word_chars) / (1.0e0 + n_words))",
              "ln(1.0e0 + 100.0e0 * n_symbols / (1.0e0 + word_chars))", "ln(1.0e0 + 100.0e0 * n_dup_lines / (1.0e0 + n_words))",
              "n_repeat_words / (1.0e0 + n_words)")
SIZE = len(STATISTICS)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STARTS = ("squares", "largest")


@dataclass(frozen=True)
class Settings:
    """least_words, repeat_percent: the fixed limits. share: of a group's rows that the estimate rests on.
    rounds: concentration steps. tail: chi-square share beyond which a row is rejected. spread: least standard
    deviation of a statistic, in its own unit (a logarithm or a share), by which estimates are rounded up.
    prior: rows that this least spread counts for in every group."""

    least_words: int = 50
    repeat_percent: int = 50
    share: float = 0.75
    rounds: int = 4
    tail: float = 1e-9
    spread: float = 0.15
    prior: int = 20


def chi_square_below(x: float, size: int) -> float:
    """The chi-square distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    half, x = size / 2, x / 2
    term = total = 1 / half
    at = half
    while term > total * 1e-16:
        at += 1
        term *= x / at
        total += term
    return min(1.0, total * exp(half * log(x) - x - lgamma(half)))


def chi_square_quantile(share: float, size: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_below(high, size) < share and high < 1e4:
        high *= 2
    for _ in range(200):
        low, high = ((low + high) / 2, high) if chi_square_below((low + high) / 2, size) < share else (low, (low + high) / 2)
    return high


def consistency(share: float, size: int) -> float:
    """By how much the covariance of the innermost share of a normal distribution falls short of the whole."""
    return share / chi_square_below(chi_square_quantile(share, size), size + 2)


# --- counts of a text ---------------------------------------------------------------------


def _repeated(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more.

    Windows with a hash of their own are out at once; what is left is compared as text, in order of the window.
    """
    size = F.size(words)

    def found(hashes: Column) -> Column:
        def again(order: Column) -> Column:
            twice = F.filter(F.transform(order, lambda x, k: F.struct(x["at"].alias("at"), (
                F.coalesce(F.get(order, k - 1)["hash"] == x["hash"], F.lit(False))
                | F.coalesce(F.get(order, k + 1)["hash"] == x["hash"], F.lit(False))).alias("same"))), lambda x: x["same"])
            return F.transform(twice, lambda x: F.struct(
                F.concat_ws(" ", F.get(words, x["at"]), F.get(words, x["at"] + 1), F.get(words, x["at"] + 2)).alias("window"),
                x["at"].alias("at")))

        ordered = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("hash"), k.alias("at"))))
        return let(ordered, again)

    def places(alike: Column) -> Column:
        same = F.transform(alike, lambda x, k: F.struct(x["at"].alias("at"), (
            F.coalesce(F.get(alike, k - 1)["window"] == x["window"], F.lit(False))
            | F.coalesce(F.get(alike, k + 1)["window"] == x["window"], F.lit(False))).alias("same")))
        return F.array_sort(F.transform(F.filter(same, lambda x: x["same"]), lambda x: x["at"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))),
                           F.lit(0), lambda total, x: total + x)

    def positions(_: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), size - 3), lambda k: F.xxhash64(F.get(words, k), F.get(words, k + 1), F.get(words, k + 2)))
        return let(let(F.array_sort(found(hashes)), places), covered)

    return F.when(size >= 4, positions(words)).otherwise(F.lit(0))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five counts of every row; a null or wordless text has none of anything."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[
        (F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")], text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.translate(line, BLANKS, "") != "")
    words = F.filter(F.split("text", GAP), lambda word: word != "")
    word_counts = let(words, lambda w: F.struct(F.size(w).alias("n_words"), _repeated(w).alias("n_repeat_words")))
    parts = named.select(
        "doc_id", "lang", "source", word_counts.alias("of_words"),
        F.char_length(F.translate("text", BLANKS, "")).alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    return parts.select("doc_id", "lang", "source", *[
        (F.col(f"of_words.{c}") if c in ("n_words", "n_repeat_words") else F.col(c)).cast("long").alias(c) for c in COUNTS])


def base_failed(settings: Settings) -> Column:
    return (F.col("n_words") < settings.least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * settings.repeat_percent)


# --- the estimate -------------------------------------------------------------------------

GROUP = ["lang", "source"]
PAIRS = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
PLACE = "CAST(floor(ln(greatest({}, 1.0e-3)) * 64.0e0) AS BIGINT)"


def _floor(settings: Settings) -> float:
    """The least variance, in squared units."""
    return float(round((UNIT * settings.spread) ** 2))


def vector() -> list[Column]:
    return [F.expr(f"CAST(floor({UNIT}.0e0 * {s} + 0.5e0) AS BIGINT)").alias(f"z{i}") for i, s in enumerate(STATISTICS)]


def factor_steps(floor: float, prior: int) -> list[tuple[str, str]]:
    """(name, SQL) of the steps from sums (n, s<i>, t<i>_<j>) to means m<i> and the factor c<i>_<j> of the covariance.

    The covariance is that of the subset, with ``prior`` rows more that have the least variance, and at least
    this variance on its diagonal. Each step may use the names of steps before it.
    """
    steps = [(f"m{i}", f"s{i} / CAST(n AS DOUBLE)") for i in range(SIZE)]
    for i, j in PAIRS:
        spread = f"(t{i}_{j} - s{i} / CAST(n AS DOUBLE) * s{j})"
        own = f"({spread} + {floor!r} * {prior}) / (n + {prior}) + {floor!r}" if i == j else f"{spread} / (n + {prior})"
        steps.append((f"v{i}_{j}", own))
    for j in range(SIZE):
        inner = "".join(f" - c{j}_{k} * c{j}_{k}" for k in range(j))
        steps.append((f"c{j}_{j}", f"sqrt(greatest(v{j}_{j}{inner}, {floor!r}))"))
        for i in range(j + 1, SIZE):
            inner = "".join(f" - c{i}_{k} * c{j}_{k}" for k in range(j))
            steps.append((f"c{i}_{j}", f"(v{j}_{i}{inner}) / c{j}_{j}"))
    return steps


def distance_steps() -> list[tuple[str, str]]:
    """(name, SQL) of the steps from z, m and c to d2, the squared distance."""
    steps = []
    for i in range(SIZE):
        inner = "".join(f" - c{i}_{k} * y{k}" for k in range(i))
        steps.append((f"y{i}", f"(z{i} - m{i}{inner}) / c{i}_{i}"))
    return [*steps, ("d2", " + ".join(f"y{i} * y{i}" for i in range(SIZE)))]


def _with(frame: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    for name, sql in steps:
        frame = frame.withColumn(name, F.expr(sql))
    return frame


FACTOR = [f"m{i}" for i in range(SIZE)] + [f"c{i}_{j}" for i in range(SIZE) for j in range(i + 1)]


def _quantiles(counts: DataFrame, key: list[str], value: str, share: float) -> DataFrame:
    """key and the least value at which the running count reaches the share; counts: key, value, n."""
    ordered = Window.partitionBy(*key).orderBy(value)
    running = counts.select(*key, value, F.sum("n").over(ordered).alias("upto"), F.sum("n").over(Window.partitionBy(*key)).alias("all"))
    return running.where(F.col("upto") >= F.ceil(F.col("all") * F.lit(share))).groupBy(*key).agg(F.min(value).alias(value))


def _medians(vectors: DataFrame) -> DataFrame:
    """lang, source and of each statistic the median a<i> and the median deviation b<i>."""
    long = vectors.select(*GROUP, F.posexplode(F.array(*[f"z{i}" for i in range(SIZE)])).alias("at", "z"))
    counts = stored(long.groupBy(*GROUP, "at", "z").agg(F.count(F.lit(1)).alias("n")), "outliers-counts")
    key = [*GROUP, "at"]
    middle = _quantiles(counts, key, "z", 0.5).withColumnRenamed("z", "a")
    off = counts.join(middle, key).select(*key, F.abs(F.col("z") - F.col("a")).alias("b"), "n")
    wide = _quantiles(off.groupBy(*key, "b").agg(F.sum("n").alias("n")), key, "b", 0.5)
    both = middle.join(wide, key)
    return both.groupBy(*GROUP).agg(*[F.max(F.when(F.col("at") == i, F.col(c))).alias(f"{c}{i}") for i in range(SIZE) for c in "ab"])


def _borders(placed: DataFrame, settings: Settings) -> DataFrame:
    """lang, source, start and the last place that belongs to the subset; placed: rows with a place for each start."""
    counts = placed.groupBy(*GROUP, "start", "place").agg(F.count(F.lit(1)).alias("n"))
    return _quantiles(counts, [*GROUP, "start"], "place", settings.share).withColumnRenamed("place", "border")


def _sums(inside: DataFrame) -> DataFrame:
    return inside.groupBy(*GROUP, "start").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"z{i}").alias(f"s{i}") for i in range(SIZE)],
        *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"t{i}_{j}") for i, j in PAIRS])


def estimate(vectors: DataFrame, settings: Settings) -> DataFrame:
    """lang, source and the means and factor of the estimate; vectors: lang, source (never null) and z<i>.

    Each start is a copy of the narrow rows for as long as a step takes; only sums, counts and estimates move.
    """
    floor = _floor(settings)
    least = UNIT * settings.spread
    medians = stored(_medians(vectors), "outliers-medians")
    off = [f"(z{i} - a{i}) / (b{i} + {least!r})" for i in range(SIZE)]
    first = {"squares": " + ".join(f"{o} * {o}" for o in off), "largest": f"greatest({', '.join(f'{o} * {o}' for o in off)})"}
    placed = vectors.join(medians, GROUP).withColumn("made", F.explode(F.array(*[
        F.struct(F.lit(start).alias("start"), F.expr(PLACE.format(first[start])).alias("place")) for start in STARTS])))
    placed = placed.select(*GROUP, *[f"z{i}" for i in range(SIZE)], "made.start", "made.place")
    for step in range(settings.rounds):
        borders = stored(_borders(placed, settings), "outliers-borders")
        inside = placed.join(borders, [*GROUP, "start"]).where("place <= border")
        known = stored(_with(_sums(inside), factor_steps(floor, settings.prior)).select(*GROUP, "start", "n", *FACTOR), "outliers-estimates")
        if step + 1 < settings.rounds:
            far = _with(vectors.join(known, GROUP), distance_steps())
            placed = far.select(*GROUP, *[f"z{i}" for i in range(SIZE)], "start", F.expr(PLACE.format("d2")).alias("place"))
    determinant = F.expr(" * ".join(f"c{i}_{i}" for i in range(SIZE)))
    best = Window.partitionBy(*GROUP).orderBy(determinant, F.desc("start"))
    return known.withColumn("rank", F.row_number().over(best)).where("rank = 1").select(*GROUP, *FACTOR)


def judged(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, lang, source, the five counts, base_failed, distance and kept of every input row, one row for each.

    distance is the corrected squared Mahalanobis distance from the estimate of the row's language and source;
    it is null where the fixed limits fail, and such rows take no part in any estimate. Null languages and
    sources are groups of their own. A null text has no words and fails. Repeated rows, null ids and equal
    statistics count as often as they occur. Other columns change nothing.
    """
    known = stored(counted(docs).withColumn("base_failed", base_failed(settings)), "outliers-counted")
    named = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(c) for c in GROUP]  # "" stands for null
    sound = known.where(~F.col("base_failed")).select(*named, *vector())
    # written, so that Spark knows their size before it decides how to join them
    estimates = stored(estimate(stored(sound, "outliers-vectors"), settings), "outliers-estimates")
    cut = chi_square_quantile(1 - settings.tail, SIZE)
    keyed = known.select("*", *[n.alias(f"_{c}") for c, n in zip(GROUP, named)], *vector())
    joined = keyed.join(estimates.select(*[F.col(c).alias(f"_{c}") for c in GROUP], *FACTOR), [f"_{c}" for c in GROUP], "left")
    scored = _with(joined, distance_steps())
    distance = F.when(~F.col("base_failed"), F.col("d2") / F.lit(consistency(settings.share, SIZE)))
    return scored.select("doc_id", "lang", "source", *COUNTS, "base_failed", distance.alias("distance"),
                         (~F.col("base_failed") & (distance <= F.lit(cut))).alias("kept"))
