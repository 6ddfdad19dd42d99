"""Quality rules: base counts and robust multivariate outliers by language and source, in SQL expressions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, let, materialise, words

SYMBOLS = "[#*$%&|<>]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
#: The part of a group's rows that an estimate is taken from, concentration steps that all starts make, steps at most, and the change of the log determinant at which they end.
SUPPORT, TRIED, STEPS, SETTLED = 0.75, 3, 30, 1e-2
#: Rows that a group needs for an estimate of its own; smaller ones take their language's, then everyone's.
MIN_ROWS = 200
#: The least variance of a statistic, for numerical rank.
RANK = 1e-6
#: A document is rejected beyond this quantile of the chi-square distribution.
TAIL = 1e-6
#: Places a unit in which quantiles of statistics are counted, and places an octave in which those of distances are.
PLACES, OCTAVE = 1024, 64
#: Estimates (under 1 kB each) that a broadcast may hold; beyond it rows are dealt by group and one of so many salts.
BROADCAST_CELLS, SALTS = 20_000, 64
#: Transformed statistics, and the sampling variance of each from the counts that it is made of: Anscombe's 1 / 4n for the root of a share, where repeated words come in
#: sixes at least; a mean word length has a coefficient of variation of about a half by word, here times the transform's slope. No estimate has a smaller variance than sampling gives, as
#: a statistic that is the same in all central rows (a share of 0) has none of its own. Length is no statistic: a long text is no outlier by that.
STATS = ["x_word", "x_symbol", "x_dup", "x_repeat", "x_upper", "x_mark"]
SAMPLING = {"x_word": (0.72, "words"), "x_symbol": (0.25, "words"), "x_dup": (0.25, "lines"), "x_repeat": (1.5, "words"), "x_upper": (0.25, "chars"), "x_mark": (0.25, "words")}
#: What the counts are called in a table of rows, and their logarithms in one of statistics.
COUNTS = {"words": "n_words", "lines": "__lines", "chars": "word_chars"}
SIZES = {"words": "y_words", "lines": "y_lines", "chars": "y_chars"}


def chi_square_cdf(p: int, x: float) -> float:
    """The distribution function, by the series of the incomplete gamma function."""
    s, half = p / 2, x / 2
    if half <= 0:
        return 0.0
    term = total = 1 / s
    n = 1
    while term > total * 1e-17:
        term *= half / (s + n)
        total += term
        n += 1
    return min(1.0, total * math.exp(s * math.log(half) - half - math.lgamma(s)))


def chi_square_quantile(p: int, tail: float) -> float:
    """The value that is exceeded with a chance of `tail`, by bisection."""
    low, high = 0.0, 10.0 * p + 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - chi_square_cdf(p, middle) > tail else (low, middle)
    return high


def consistency(p: int, support: float) -> float:
    """What makes the covariance of a normal sample's central part that of the whole."""
    return support / chi_square_cdf(p + 2, chi_square_quantile(p, 1 - support))


#: Up to so many different repeated windows are looked up in a list; beyond it windows are sorted with their positions.
LISTED = 48


def _covered(positions: Column) -> Column:
    return F.size(F.array_distinct(F.flatten(F.transform(positions, lambda i: F.array(i, i + 1, i + 2)))))


def _repeated(w: Column) -> Column:
    """Words inside three-word windows that are found twice or more."""

    def by_sorting(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            found = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return _covered(F.transform(found, lambda x: x["i"]))

        return let(ordered, twice)

    def by_list(h: Column, d: Column) -> Column:
        at = F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i).otherwise(F.lit(-1)))
        return _covered(F.filter(at, lambda i: i >= 0))

    def counted(h: Column) -> Column:
        def chosen(d: Column) -> Column:
            return F.when(F.size(d) == 0, F.lit(0)).when(F.size(d) <= LISTED, by_list(h, d)).otherwise(by_sorting(h))

        again = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
        return let(again, chosen)

    windows = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows, counted))


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper and n_marks (long).

    n_upper: capital letters (category Lu); n_marks: characters of [!?|]. Null and empty text: all 0.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), _repeated(w).alias("r")))
    footed = lambda x: (F.size(x) > 1) & (F.get(x, F.lit(0)) == F.get(x, F.size(x) - 1))
    head = lambda x: F.when(footed(x), F.size(words(F.get(x, F.lit(0))))).otherwise(F.lit(0))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"), head(x).alias("h")))
    out = docs.withColumns({"__w": by_words, "__l": by_lines, "n_symbols": F.regexp_count(value, F.lit(SYMBOLS)), "n_upper": F.regexp_count(value, F.lit(r"\p{Lu}")), "n_marks": F.regexp_count(value, F.lit("[!?|]"))})
    named = {"n_words": "__w.n", "word_chars": "__w.c", "n_repeat_words": "__w.r", "n_dup_lines": "__l.d", "n_symbols": "n_symbols", "n_upper": "n_upper", "n_marks": "n_marks", "__lines": "__l.n", "__head": "__l.h"}
    return out.withColumns({k: F.col(v).cast("long") for k, v in named.items()}).drop("__w", "__l")


def _transformed(df: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    # a header that comes again as the footer is no repetition: its second line isn't counted, nor the words of the two
    dup = F.col("n_dup_lines") - F.when(F.col("__head") > 0, F.lit(1)).otherwise(F.lit(0))
    repeat = F.greatest(F.col("n_repeat_words") - F.when(F.col("__head") > 2, 2 * F.col("__head")).otherwise(F.lit(0)), F.lit(0))
    return df.withColumns(
        {
            "x_word": F.log1p(F.col("word_chars") / n) * 2,
            "x_symbol": F.sqrt(F.col("n_symbols") / n),
            "x_dup": F.sqrt(dup / F.greatest(F.col("__lines"), F.lit(1))),
            "x_repeat": F.sqrt(repeat / n),
            "x_upper": F.sqrt(F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))),
            "x_mark": F.sqrt(F.col("n_marks") / n),
        }
    )


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


#: Linear algebra on lower triangles kept row by row in an array: row i begins at i (i + 1) / 2. The Cholesky factor l of c, and its inverse w.
FACTOR = f"""aggregate(sequence(0, {len(STATS) - 1}), cast(array() AS array<double>), (l, i) -> concat(l, aggregate(sequence(0, i), cast(array() AS array<double>), (r, j) -> concat(r, transform(
 array(c[shiftright(i * (i + 1), 1) + j] - aggregate(zip_with(r, CASE WHEN i = j THEN r ELSE slice(l, shiftright(j * (j + 1), 1) + 1, j) END, (a, b) -> a * b), 0D, (x, y) -> x + y)),
 v -> CASE WHEN i = j THEN sqrt(greatest(v, {RANK * 1e-3}D)) ELSE v / l[shiftright(j * (j + 1), 1) + j] END)))))"""
INVERSE = f"""aggregate(sequence(0, {len(STATS) - 1}), cast(array() AS array<double>), (w, i) -> concat(w, transform(sequence(0, i), j -> (CASE WHEN i = j THEN 1D
 ELSE -aggregate(sequence(j, greatest(j, i - 1)), 0D, (x, k) -> x + l[shiftright(i * (i + 1), 1) + k] * w[shiftright(k * (k + 1), 1) + j]) END) / l[shiftright(i * (i + 1), 1) + i])))"""


def _row_distance() -> str:
    """The squared distance of a row from m under c with what its own counts add to sampling. One expression with inner names: a filter on it, which takes columns for what they stand for, computes each part once."""
    more = {i * (i + 3) // 2: f"greatest({SAMPLING[x][0]}D / greatest({COUNTS[SAMPLING[x][1]]}, 1) - u[{i}], 0D)" for i, x in enumerate(STATS)}
    own = "array(" + ", ".join(f"c[{k}] + {more[k]}" if k in more else f"c[{k}]" for k in range(len(_pairs()))) + ")"
    z = ["(" + " + ".join(f"w[{i * (i + 1) // 2 + j}] * ({STATS[j]} - m[{j}])" for j in range(i + 1)) + ")" for i in range(len(STATS))]
    length = f"aggregate(array({', '.join(z)}), 0D, (s, v) -> s + v * v)"
    return f"transform(array({own}), c -> transform(array({FACTOR}), l -> transform(array({INVERSE}), w -> {length})[0])[0])[0]"


ROW_DISTANCE = _row_distance()


def _whitened(df: DataFrame) -> DataFrame:
    """df with l, the Cholesky factor of c, and w, its inverse."""
    return df.withColumn("l", F.expr(FACTOR)).withColumn("w", F.expr(INVERSE))


def _distance(w: Column, m: Column) -> Column:
    """The squared length of w (x - m)."""
    z = [_total([w[i * (i + 1) // 2 + j] * (F.col(STATS[j]) - m[j]) for j in range(i + 1)]) for i in range(len(STATS))]
    return _total([x * x for x in z])


def _on(rows: DataFrame, table: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """rows joined with a table by groups or cells: broadcast where these are few, else both dealt by key and salt, so that a hot group has many tasks."""
    if few:
        return rows.join(F.broadcast(table), keys, how)
    left = rows.withColumn("salt", F.pmod(F.xxhash64(*STATS), F.lit(SALTS)).cast("int"))
    return left.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "salt"], how).drop("salt")


def _cells(stats: DataFrame, scratch: Scratch) -> DataFrame:
    """(g_lang, g_source, judge, gives): the cell that a group is judged by, and those that its rows give to. A cell is a group, a language or everything."""
    groups = scratch.keep(stats.groupBy("g_lang", "g_source").agg(F.count("*").alias("n")), "mcd-groups")
    level = F.when(F.col("n") >= MIN_ROWS, F.lit(0)).when(F.col("in_lang") >= MIN_ROWS, F.lit(1)).otherwise(F.lit(2))
    out = groups.withColumn("in_lang", F.sum("n").over(Window.partitionBy("g_lang"))).withColumn("level", level)
    anywhere = not out.filter("level = 2").isEmpty()
    out = out.withColumn("pooled", F.max(F.col("level") == 1).over(Window.partitionBy("g_lang")))
    own, lang, every = F.xxhash64(F.lit(0), "g_lang", "g_source"), F.xxhash64(F.lit(1), "g_lang"), F.xxhash64(F.lit(2))
    judge = F.when(F.col("level") == 0, own).when(F.col("level") == 1, lang).otherwise(every)
    gives = F.filter(F.array(F.when(F.col("level") == 0, own), F.when(F.col("pooled"), lang), *([every] if anywhere else [])), lambda x: x.isNotNull())
    return scratch.keep(out.select("g_lang", "g_source", judge.alias("judge"), gives.alias("gives")), "mcd-cells")


def _quantiles(rows: DataFrame, by: list[str], place: Column, parts: list[float]) -> DataFrame:
    """(by, n, q0, q1, ...): for each part the first place up to which the rows are that part or more. Counted by place, so partitioning can't change them."""
    counts = rows.groupBy(*by, place.alias("place")).agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy(*by).orderBy("place"))
    counts = counts.withColumns({"upto": upto, "n": F.sum("rows").over(Window.partitionBy(*by))})
    return counts.groupBy(*by).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") >= F.lit(x) * F.col("n"), F.col("place"))).alias(f"q{k}") for k, x in enumerate(parts)])


def _array(values: list[Column]) -> Column:
    return F.array(*values)


def _starts(rows: DataFrame, few: bool, scratch: Scratch) -> DataFrame:
    """(cell, start, f, u, m, c): medians with three scatters to start from, the least and the usual variances. The scatters, all of rows standardised by medians and quartiles: none but the
    spreads themselves, the covariance of their hyperbolic tangents, and that of their directions."""
    p = len(STATS)
    listed = [*STATS, *SIZES.values()]
    tall = rows.select("cell", F.posexplode(F.array(*listed)).alias("i", "x"))
    q = _quantiles(tall, ["cell", "i"], F.round(F.col("x") * PLACES).cast("long"), [0.25, 0.5, 0.75])
    # one row a cell: quartiles of each statistic in turn
    wide = q.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("i", "q0", "q1", "q2"))).alias("q"))
    at = lambda x, k: F.col("q")[listed.index(x)][f"q{k}"] / PLACES
    typical = {k: F.greatest(F.expm1(at(v, 1)), F.lit(1.0)) for k, v in SIZES.items()}
    usual = [F.lit(SAMPLING[x][0]) / typical[SAMPLING[x][1]] for x in STATS]
    least = [F.greatest(v, F.lit(RANK)) for v in usual]
    base = wide.select("cell", _array([at(x, 1) for x in STATS]).alias("m"), _array([(at(x, 2) - at(x, 0)) / 1.349 for x in STATS]).alias("s"), _array(least).alias("f"), _array(usual).alias("u"))
    base = scratch.keep(base.withColumn("s", F.zip_with("s", "f", lambda s, f: F.greatest(s, F.sqrt(f)))), "mcd-base")
    z = [(F.col(x) - F.col("m")[i]) / F.col("s")[i] for i, x in enumerate(STATS)]
    held = _on(rows, base.select("cell", "m", "s"), ["cell"], few).select("cell", *[x.alias(f"z{i}") for i, x in enumerate(z)])
    size = F.greatest(F.sqrt(_total([F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)])), F.lit(1e-9))
    held = held.select("cell", *[F.tanh(f"z{i}").alias(f"t{i}") for i in range(p)], *[(F.col(f"z{i}") / size).alias(f"d{i}") for i in range(p)])
    sums = held.groupBy("cell").agg(F.count("*").alias("n"), *[F.sum(f"{x}{i}").alias(f"{x}{i}") for x in "td" for i in range(p)], *[F.sum(F.col(f"{x}{i}") * F.col(f"{x}{j}")).alias(f"{x}{i}_{j}") for x in "td" for i, j in _pairs()])
    n = F.col("n")

    def scatter(x: str, factor: float) -> Column:
        return _array([F.lit(factor) * F.col("s")[i] * F.col("s")[j] * (F.col(f"{x}{i}_{j}") / n - F.col(f"{x}{i}") / n * F.col(f"{x}{j}") / n) for i, j in _pairs()])

    plain = _array([F.col("s")[i] * F.col("s")[i] if i == j else F.lit(0.0) for i, j in _pairs()])
    starts = F.array(*[F.struct(F.lit(k).alias("start"), c.alias("c")) for k, c in enumerate((plain, scatter("t", 1.0), scatter("d", float(p))))])
    out = sums.join(base, "cell").select("cell", "f", "u", "m", F.explode(starts).alias("e")).select("cell", "e.start", "f", "u", "m", "e.c")
    return scratch.keep(_whitened(_ranked(out)), "mcd-starts")


def _ranked(df: DataFrame) -> DataFrame:
    """df with variances of c raised to the least ones."""
    return df.withColumn("c", F.expr("transform(c, (v, k) -> CASE " + " ".join(f"WHEN k = {i * (i + 3) // 2} THEN greatest(v, f[{i}])" for i in range(len(STATS))) + " ELSE v END)"))


def mcd_estimates(rows: DataFrame, few: bool, scratch: Scratch) -> DataFrame:
    """(cell, m, c, u) for each cell of rows (cell, STATS, sizes): centre and covariance of the SUPPORT part of its rows whose covariance has the least
    determinant found, made consistent, and the usual sampling variances.

    Each start makes TRIED concentration steps (the nearest SUPPORT part of the rows gives the next estimate); the one with the least determinant goes on until that settles.
    A step counts distances by place (OCTAVE to an octave) for the cut and sums products on this side of it: two passes over the statistics, with partial sums by cell. All cells
    make a step together, and those that have settled make no more.
    """
    p = len(STATS)
    now = _starts(rows, few, scratch).withColumn("det", F.lit(float("inf")))
    place = F.floor(F.log2(F.greatest(_distance(F.col("w"), F.col("m")), F.lit(1e-9))) * OCTAVE).cast("int")
    sums = [F.count("*").alias("h"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(STATS)], *[F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"p{i}_{j}") for i, j in _pairs()]]
    mean = F.expr("array(" + ", ".join(f"s{i} / h" for i in range(p)) + ") AS m")
    covariance = F.expr("array(" + ", ".join(f"p{i}_{j} / h - s{i} / h * s{j} / h" for i, j in _pairs()) + ") AS c")
    det = F.expr("2 * (" + " + ".join(f"ln(l[{i * (i + 3) // 2}])" for i in range(p)) + ")")
    done = None
    for step in range(STEPS):
        near = _on(rows, now.select("cell", "start", "m", "w"), ["cell"], few).select("cell", "start", place.alias("place"))
        cut = scratch.keep(_quantiles(near, ["cell", "start"], F.col("place"), [SUPPORT]).select("cell", "start", F.col("q0").alias("cut")), "mcd-cut")
        held = _on(rows, now.select("cell", "start", "m", "w").join(F.broadcast(cut) if few else cut, ["cell", "start"]), ["cell"], few).filter(place <= F.col("cut"))
        new = held.groupBy("cell", "start").agg(*sums).select("cell", "start", mean, covariance)
        new = _whitened(_ranked(new.join(now.select("cell", "start", "f", "u", F.col("det").alias("before")), ["cell", "start"]))).withColumn("det", det)
        if step == TRIED - 1:
            first = new.groupBy("cell").agg(F.min_by("start", F.struct("det", "start")).alias("start"))
            new = new.join(first, ["cell", "start"])
        settled = ((F.abs(F.col("det") - F.col("before")) <= SETTLED) & F.lit(step >= TRIED - 1)) | F.lit(step == STEPS - 1)
        new = scratch.keep(new.withColumn("settled", settled).drop("before"), "mcd-step")
        ended = new.filter("settled").select("cell", "start", "det", "m", "c", "u")
        done = ended if done is None else done.union(ended)
        now = new.filter("not settled")
        if step >= TRIED - 1 and now.isEmpty():
            break
    best = done.groupBy("cell").agg(F.min_by(F.struct("m", "c", "u"), F.struct("det", "start")).alias("e")).select("cell", "e.*")
    return best.withColumn("c", F.transform("c", lambda x: x * consistency(p, SUPPORT)))


def _grouped(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    null = F.lit("\0null")
    return docs.withColumns({"g_lang": F.coalesce(F.col(lang).cast("string"), null), "g_source": F.coalesce(F.col(source).cast("string"), null)})


def _judged(stats: DataFrame, tail: float) -> DataFrame:
    """stats, a table of _transformed rows with base_failed, with d2 and kept. A row's covariance is its cell's and, where its own counts are smaller than usual there, what its statistics vary more by sampling."""
    scratch, group = Scratch(), ["g_lang", "g_source"]
    good = stats.filter(~F.col("base_failed"))
    cells = _cells(good, scratch)
    few = 3 * cells.count() <= BROADCAST_CELLS
    slim = good.select(*group, *STATS, *[F.log1p(F.greatest(COUNTS[k], F.lit(1))).alias(y) for k, y in SIZES.items()])
    rows = scratch.keep(_on(slim, cells, group, few).select(F.explode("gives").alias("cell"), *STATS, *SIZES.values()), "mcd-rows")
    best = mcd_estimates(rows, few, scratch)
    known = materialise(cells.select(*group, "judge").join(best.withColumnRenamed("cell", "judge"), "judge").drop("judge"), "mcd-known")
    scratch.clear()
    joined = _on(stats, known, group, few, "left")
    out = joined.withColumn("d2", F.expr(ROW_DISTANCE)).select(*stats.columns, "d2")
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= chi_square_quantile(len(STATS), tail)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", tail: float = TAIL) -> DataFrame:
    """docs without the rows that quality_rules() rejects, with all their columns, whatever these are named. The judged rows are written once with their texts."""
    out = list(docs.columns)
    rows = _transformed(base_statistics(_grouped(docs.toDF(*[f"c{k}" for k in range(len(out))]), f"c{out.index(text)}", f"c{out.index(lang)}", f"c{out.index(source)}"), f"c{out.index(text)}"))
    rows = materialise(rows.withColumn("base_failed", base_failed()), "quality-rows")
    return _judged(rows, tail).filter("kept").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(out)])


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", doc_id: str = "doc_id", tail: float = TAIL) -> DataFrame:
    """One row a document: doc_id, the base counts, base_failed, distance (squared Mahalanobis) and kept.

    A document fails the base rules with under MIN_WORDS words or with more than half of its words in repeated
    three-word windows. The others are held against the minimum-covariance-determinant estimate of their language and source (in groups under MIN_ROWS rows: of their language, then of all) and rejected beyond
    the chi-square quantile. Statistics are shares and the mean word length; length itself is none. A short text's statistics vary more by chance alone; that variance is added to the covariance that it is held against. A first line that is also the last isn't counted as
    repeated in the distance.

    Null or empty text fails the base rules and gives no statistic to an estimate. Null languages and sources are groups of their own. Repeated rows are judged alike, null ids stay. Texts of any length count whole. An
    empty table gives no rows. Other columns, whatever their names, are ignored. Counts of places and sums decide, so partitioning changes nothing but the last digits of sums.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    stats = _transformed(base_statistics(_grouped(rows, "text", "lang", "source"))).drop("text", "lang", "source", "__head")
    judged = _judged(materialise(stats.withColumn("base_failed", base_failed()), "quality-stats"), tail)
    return judged.select("doc_id", *BASE, "base_failed", "kept", F.col("d2").alias("distance"))
