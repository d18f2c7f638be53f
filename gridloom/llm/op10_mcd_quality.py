"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Texts that pass two plain rules are held against others of their language and source.
Four transformed statistics make a vector; a minimum-covariance-determinant estimate
(mean and covariance of the `SUBSET` share of vectors whose covariance has the least
determinant, approached by concentration steps from medians and median deviations;
of a group's steps the one of least determinant counts, and steps end when no group's
determinant falls any more) describes the group, and vectors of too large a Mahalanobis distance are rejected.

Each step sends partial sums only: medians come from mergeable sketches, and the
distance that holds a share of a group is read from a histogram of its distances. What
is known of groups is sent to all tasks while there are at most 50,000 of them, so that
rows stay where they are, however many a group has.
Groups under `LEAST_GROUP` rows are pooled by language, and those still under it all
together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import common

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
SUBSET = 0.75
#: Fixed value: SUBSET over the chance that a chi-square with 6 degrees of freedom is below the SUBSET quantile of one with 4.
CONSISTENCY = 1.4866
#: Variance added to each statistic: most texts have no symbol or repeated line at all, and a group of such has no spread.
FLOOR = (0.04, 0.25, 0.25, 0.25)
#: Fixed value: the 0.999 quantile of chi-square with 4 degrees of freedom, where exp(-x / 2) * (1 + x / 2) is 0.001.
CUTOFF = 18.4668
LEAST_GROUP, STEPS, BINS = 60, 10, 64
#: A determinant that falls by less than this share has settled.
SETTLED = 0.01
X = ("x1", "x2", "x3", "x4")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda's variable isn't computed again."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that is found twice or more.

    Windows are compared by the 64-bit hash of their three words. Where no hash is met
    twice the answer is 0; else hashes are sorted with their places, and equal neighbours
    give the places of the windows.
    """

    def count(h: Column) -> Column:
        def covered(s: Column) -> Column:
            same = lambda x, k, d: F.get(s, k + d)["h"].eqNullSafe(x["h"])
            found = F.filter(s, lambda x, k: same(x, k, -1) | same(x, k, 1))
            return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        ranked = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(ranked, covered))

    def hashes(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    return _let(words, lambda w: _let(hashes(w), count))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of whole texts; null: none of all."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), F.col(lang).alias("lang"), F.col(source).alias("source"), t.alias("_t"))
    t = F.col("_t")
    words = F.array_remove(F.split(t, common.SPACE), "")
    stats = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    return rows.select(
        key, "lang", "source", stats.alias("_s"),
        F.length(F.regexp_replace(t, common.SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(F.filter(F.split(t, "\n"), lambda x: x.rlike(common.WORD)), lambda n: F.size(n) - F.size(F.array_distinct(n))).cast("long").alias("n_dup_lines"),
    ).select(key, "lang", "source", "_s.n_words", "word_chars", "n_symbols", "n_dup_lines", "_s.n_repeat_words")


def vectors(stats: DataFrame) -> DataFrame:
    n = F.col("n_words").cast("double")
    shares = [F.log(F.col("word_chars") / n) * 4, *(F.log1p(100 * F.col(c) / n) for c in ("n_symbols", "n_dup_lines", "n_repeat_words"))]
    return stats.withColumns(dict(zip(X, shares, strict=True)))


def groups(rows: DataFrame) -> DataFrame:
    """(lang, source, group): small groups are pooled."""
    n = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    name = lambda *c: F.concat_ws("/", *(F.coalesce(F.concat(F.lit("="), x), F.lit("?")) for x in c))
    n = n.withColumn("group", F.when(F.col("n") >= LEAST_GROUP, F.concat(F.lit("1/"), name("lang", "source"))).otherwise(F.concat(F.lit("2/"), name("lang"))))
    pooled = F.sum("n").over(Window.partitionBy("group"))
    return n.select("lang", "source", F.when(pooled >= LEAST_GROUP, F.col("group")).otherwise(F.lit("3")).alias("group"))


def _pairs():
    return [(i, j) for i in range(len(X)) for j in range(i + 1)]


def _factor(est: DataFrame, scale: float) -> DataFrame:
    """Adds the Cholesky factor f_i_j of scale * covariance + FLOOR."""
    f: dict[tuple[int, int], Column] = {}
    for i, j in _pairs():
        rest = scale * F.col(f"s_{i}_{j}") + (FLOOR[i] if i == j else 0.0)
        for k in range(j):
            rest = rest - F.col(f"f_{i}_{k}") * F.col(f"f_{j}_{k}")
        f[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"f_{j}_{j}")
        est = est.withColumn(f"f_{i}_{j}", f[i, j])
    det = reduce(Column.__mul__, (F.col(f"f_{i}_{i}") * F.col(f"f_{i}_{i}") for i in range(len(X))))
    return est.select("group", *(f"m_{i}" for i in range(len(X))), *(f"f_{i}_{j}" for i, j in _pairs()), det.alias("det"))


def _distance(rows: DataFrame, est: DataFrame) -> DataFrame:
    """Adds the squared Mahalanobis distance d2 under the group's estimate."""
    rows = rows.join(est, "group")
    for i, x in enumerate(X):
        z = F.col(x) - F.col(f"m_{i}")
        for k in range(i):
            z = z - F.col(f"f_{i}_{k}") * F.col(f"z_{k}")
        rows = rows.withColumn(f"z_{i}", z / F.col(f"f_{i}_{i}"))
    d2 = reduce(Column.__add__, (F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(len(X))))
    return rows.withColumn("d2", d2).drop(*(c for c in est.columns if c != "group"), *(f"z_{i}" for i in range(len(X))))


def _concentrate(rows: DataFrame, est: DataFrame) -> DataFrame:
    """Mean and covariance of the SUBSET share of each group with the least distances."""
    near = _distance(rows, est).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * BINS))
    bins = near.groupBy("group", "bin").agg(F.count("*").alias("n"))
    up = Window.partitionBy("group").orderBy("bin")
    bins = bins.withColumn("below", F.sum("n").over(up) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("group")))
    reach = bins.where(F.col("below") < SUBSET * F.col("all")).groupBy("group").agg(F.max("bin").alias("reach"))
    inside = near.join(common.small(reach, "mcd-reach"), "group").where("bin <= reach")
    sums = inside.groupBy("group").agg(*(F.avg(x).alias(f"m_{i}") for i, x in enumerate(X)), *(F.covar_pop(X[i], X[j]).alias(f"s_{i}_{j}") for i, j in _pairs()))
    return _factor(sums, CONSISTENCY)


def estimates(rows: DataFrame) -> DataFrame:
    """A robust mean and a factored covariance for each group of rows (group, x1..x4)."""
    mid = common.small(rows.groupBy("group").agg(*(F.percentile_approx(x, 0.5, 2000).alias(f"m_{i}") for i, x in enumerate(X))), "mcd-medians")
    off = rows.join(mid, "group").groupBy("group", *(f"m_{i}" for i in range(len(X)))).agg(*(F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5, 2000).alias(f"a_{i}") for i, x in enumerate(X)))
    spread = [(1.4826 * F.col(f"a_{i}")) ** 2 if i == j else F.lit(0.0) for i, j in _pairs()]
    est = common.small(_factor(off.withColumns({f"s_{i}_{j}": s for (i, j), s in zip(_pairs(), spread, strict=True)}), 1.0), "mcd-start")
    for k in range(STEPS):
        new = _concentrate(rows, est).select("group", F.struct("*").alias("new"))
        old = est.select("group", F.struct("*").alias("old"))
        falls = F.lit(k == 0) | (F.col("new.det") < F.col("old.det"))  # the start is no estimate of a share of the rows
        both = old.join(new, "group").select(F.when(falls, F.col("new")).otherwise(F.col("old")).alias("e"), (F.lit(k == 0) | (F.col("new.det") < (1 - SETTLED) * F.col("old.det"))).alias("fell"))
        both = common.small(both.select("e.*", "fell"), f"mcd-{k}")
        est = both.drop("fell")
        if not both.where("fell").take(1):
            break
    return est


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """Rows (key, statistics, base_failed, d2, kept), one for each row of docs.

    base_failed: under LEAST_WORDS words, or over MOST_REPEATED % of them in repeated
    windows. d2: squared distance, null where base_failed. kept: neither failed nor
    farther than cutoff. Null languages and sources are values of their own; null texts
    have no words. Repeated rows count each; other columns of docs are ignored; an empty
    table gives an empty one.
    """
    stats = common.spool(statistics(docs, key, text, lang, source).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))), "quality")
    good = vectors(stats.where(~F.col("base_failed")))
    named = common.small(groups(good), "mcd-groups")
    same = good["lang"].eqNullSafe(named["lang"]) & good["source"].eqNullSafe(named["source"])
    rows = good.join(named, same).drop(named["lang"]).drop(named["source"])
    far = _distance(rows, estimates(rows.select("group", *X))).withColumn("kept", F.col("d2") <= cutoff)
    columns = [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    failed = stats.where("base_failed").select(*columns, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"))
    return far.select(*columns, "d2", "kept").unionByName(failed)


def op10_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


QUERIES = {"op10_mcd_quality": op10_mcd_quality}
ORACLES: dict[str, str] = {}
