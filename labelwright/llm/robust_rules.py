"""Robust multivariate quality rules: minimum covariance determinant per language and source.

Every text gets a vector of transformed statistics. For each (language, source) the location and
scatter of the tightest half of the documents are found by concentration steps; documents whose
Mahalanobis distance from them is too large are rejected. Everything is aggregates and column
expressions; nothing of a group is gathered.

Defined cases: a null or empty text has no words and fails the base rule; a null language or source
is a group of its own; groups of fewer than ``MIN_GROUP`` documents use the estimate of their
language, small languages the one of all documents; repeated rows are judged alike, and columns of
the input may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.llm.store import drop, save
from labelwright.llm.words import WHITE, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A group's own estimate needs so many documents.
MIN_GROUP = 100
STEPS = 4
#: Quantiles of chi-square with 4 degrees of freedom: 0.975 for reweighting, 1 - 1e-5 for rejection.
CHI_REWEIGHT = 11.143
CUTOFF = 28.5
#: Least standard deviation of each statistic: shares that are zero in nearly all clean texts would
#: otherwise have no scatter at all and any other value would be infinitely far away. The root of a
#: share of n independent things has the binomial error 1 / (2 sqrt(n)); here n is that of the
#: shortest clean text: 12 lines, and ``MIN_WORDS`` words of which three go together.
FLOORS = {"x_length": 0.08, "x_symbols": 0.05, "x_lines": 0.5 / 12**0.5, "x_repeats": 0.5 / (MIN_WORDS / 3) ** 0.5}
VECTOR = list(FLOORS)
PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i + 1)]


def _windows(word: Column) -> Column:
    """Hashes (64 bits) of the three-word windows, in order."""
    n = F.size(word)
    return F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(word, i), F.get(word, i + 1), F.get(word, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words covered by windows that occur at least twice.

    The windows sorted by (hash, place) stand beside their equals; the places found, sorted,
    cover min(3, distance to the place before) words each.
    """
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twins(a: Column) -> Column:
        return F.filter(
            a,
            lambda x, k: ((k > 0) & (F.get(a, k - 1)["h"] == x["h"])) | ((k < F.size(a) - 1) & (F.get(a, k + 1)["h"] == x["h"])),
        )

    def spans(a: Column) -> Column:
        places = F.array_sort(F.transform(twins(a), lambda x: x["i"]))
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")),
            lambda s: s["n"],
        )

    # a one-element array carries the sorted windows through, so that they are sorted once
    return F.transform(F.array(placed), spans)[0].cast("long")


def statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``row`` (the carried columns) with the base statistics and the vector of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    full = lambda x: F.length(F.translate(x, WHITE, "")) > 0
    read = docs.select(
        F.struct(*carry).alias("row"),
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), full).alias("lines"),
        words(F.col("text")).alias("word"),
    )
    read = read.select(
        "row", "lang", "source", "word_chars", "n_symbols",
        F.size("word").cast("long").alias("n_words"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _windows(F.col("word")).alias("windows"),
    )
    same = F.size(F.array_distinct("windows")) == F.size("windows")
    read = read.withColumn("n_repeat_words", F.when(same, F.lit(0).cast("long")).otherwise(_covered(F.col("windows")))).drop("windows")
    share = lambda part, whole: F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    return read.select(
        "*",
        F.log(F.lit(1.0) + F.col("word_chars") / F.greatest("n_words", F.lit(1))).alias("x_length"),
        share("n_symbols", "word_chars").alias("x_symbols"),
        share("n_dup_lines", "n_lines").alias("x_lines"),
        share("n_repeat_words", "n_words").alias("x_repeats"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )


def grouped(read: DataFrame) -> DataFrame:
    """Adds the group whose estimate a document uses."""
    sizes = read.groupBy("lang", "source").agg(F.count("*").alias("n"))
    per_lang = sizes.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    key = (
        F.when(F.col("n") >= MIN_GROUP, F.to_json(F.array("lang", "source")))
        .when(F.col("n_lang") >= MIN_GROUP, F.to_json(F.array("lang")))
        .otherwise(F.lit(""))
    )
    keys = save(sizes.join(per_lang, "lang").select("lang", "source", key.alias("group")), "groups")
    # a row per language and source, written: Spark knows its size and leaves the documents in place if it is small
    return read.join(keys, ["lang", "source"])


def _cholesky(groups: DataFrame) -> DataFrame:
    """Adds the lower factor l_i_j of the scatter s_i_j of each group."""
    for i, j in PAIRS:
        inner = F.lit(0.0)
        for k in range(j):
            inner = inner + F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        left = F.col(f"s_{i}_{j}") - inner
        groups = groups.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(left, F.lit(FLOORS[VECTOR[i]] ** 2 / 100))) if i == j else left / F.col(f"l_{j}_{j}"))
    return groups.select("group", *[f"m_{i}" for i in range(len(VECTOR))], *[f"l_{i}_{j}" for i, j in PAIRS])


def distances(read: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance from the document's group."""
    out = read.join(_cholesky(groups), "group")
    for i, name in enumerate(VECTOR):
        rest = F.col(name) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        out = out.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    square = sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, len(VECTOR))), F.col("y_0") * F.col("y_0"))
    return out.select(*read.columns, square.alias("d2"))


def _moments(kept: DataFrame, scale: Column) -> DataFrame:
    """Location and scatter of each group's kept documents, the diagonal no less than the floors."""
    sums = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(VECTOR)]
    sums += [F.avg(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"q_{i}_{j}") for i, j in PAIRS]
    got = kept.groupBy("group").agg(*sums, scale.alias("scale"))
    scatter = []
    for i, j in PAIRS:
        s = (F.col(f"q_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")) * F.col("scale")
        scatter.append((F.greatest(s, F.lit(0.0)) + FLOORS[VECTOR[i]] ** 2 if i == j else s).alias(f"s_{i}_{j}"))
    return got.select("group", *[f"m_{i}" for i in range(len(VECTOR))], *scatter)


def estimates(read: DataFrame) -> DataFrame:
    """Per group: location m_i and scatter s_i_j by minimum covariance determinant.

    Start: medians and median absolute deviations. A concentration step keeps the half of each
    group nearest to the present estimate (its median distance comes from a mergeable quantile
    sketch) and takes mean and covariance of that half; such a step never raises the determinant.
    The last half is scaled to be consistent under normality and reweighted once.
    """
    # a row per group, written as all tables of groups are: their size is known before a join is planned,
    # so that documents are not dealt by group, of which one may hold a third of them
    middle = save(read.groupBy("group").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"m_{i}") for i, x in enumerate(VECTOR)]), "mcd")
    spread = (
        read.join(middle, "group")
        .groupBy("group")
        .agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5, 1000).alias(f"d_{i}") for i, x in enumerate(VECTOR)])
    )
    zero = F.lit(0.0)
    scatter = [(F.pow(F.col(f"d_{i}") * 1.4826, 2) + FLOORS[VECTOR[i]] ** 2 if i == j else zero).alias(f"s_{i}_{j}") for i, j in PAIRS]
    groups = save(middle.join(spread, "group").select("group", *[f"m_{i}" for i in range(len(VECTOR))], *scatter), "mcd")
    for step in range(STEPS + 1):
        far = distances(read, groups)
        if step < STEPS:
            bound = save(far.groupBy("group").agg(F.percentile_approx("d2", 0.5, 1000).alias("bound")), "mcd")
            kept = far.join(bound, "group").where("d2 <= bound")
            # a half of a normal sample has too small a scatter; the factor makes it consistent
            after = save(_moments(kept, F.first(F.lit(1.0 if step < STEPS - 1 else 2.4))), "mcd")
            drop(bound)
        else:
            after = save(_moments(far.where(F.col("d2") <= CHI_REWEIGHT), F.first(F.lit(1.0))), "mcd")
        drop(groups)
        groups = after
    drop(middle)
    return groups


def screen(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns as ``row`` with statistics, distance ``d2``, ``base_failed`` and ``kept`` of every document."""
    first = save(statistics(docs, carry), "statistics")
    read = save(grouped(first), "grouped")
    drop(first)
    # the estimates are of texts that pass the base rule: shorter ones have no stable shares
    solid = read.where(~F.col("base_failed"))
    groups = estimates(solid)
    far = distances(solid, groups).select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", (F.col("d2") <= CUTOFF).alias("kept"))
    failed = read.where("base_failed").select(*[c for c in far.columns if c not in ("d2", "kept")], F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"))
    return far.unionByName(failed)


def rejected_removed(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return screen(docs, docs.columns).where("kept").select("row.*")
