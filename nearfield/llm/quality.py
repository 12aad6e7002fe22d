"""Quality rules: base counts, and robust multivariate outliers per language and source.

Each text gives counts and, from them, a vector of four transformed statistics.  For each (language, source), each
language and the whole table, the minimum covariance determinant is searched by concentration steps from three starts:
the half of the texts nearest in Mahalanobis distance gives the next mean and covariance, until the determinant has
settled, and the start that ends with the smallest determinant gives the estimate.  The half comes from histograms of
distances, so that a step is one aggregate over a narrow table with partial sums, however large a group is.  A text is
rejected if its squared distance under the most specific estimate that has MIN_ROWS texts is above CUT.  JVM expressions
only.

Words are runs of other characters than space and 9 to 13.  Base: n_words, word_chars (code points in words),
n_symbols (``#*$%&|<>``), n_dup_lines (\\n-lines with a word that equal an earlier line), n_repeat_words (words in
three-word windows found twice or more).  Rejected outright: under 50 words, or more than half of the words in
repeated windows; such texts take no part in the estimates.

Edge cases: NULL and empty texts have no words and are rejected; a NULL language or source is a group of its own;
rows that repeat are judged alike and count each; ids are not looked at; a very long text is counted whole, in one row;
a group of fewer than MIN_ROWS usable texts takes its language's estimate or the whole table's, and a table of fewer has
none (four statistics of under 20 texts have no covariance to speak of) and keeps what passes the base rules; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import BROADCAST_KEYS, documents, durable, joinable, keyed, small, unkeyed, word_array

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MIN_ROWS, STEPS, CUT = 50, 20, 12, 40.0
#: Change of a determinant's logarithm at which a concentration has settled (a bin of distances is 1/64).
SETTLED = 1e-3
#: MIN_ROWS: half of 20 texts are ten for the covariance of four statistics, which FLOOR keeps regular.
#: Least spread of each statistic, in its own unit: a group that never repeats a line must not reject one that does.
#: CUT is the 4e-8 tail of chi-square with four degrees, as clean texts are not quite Gaussian.
FLOOR = (0.05, 0.04, 0.12, 0.14)
NAMES = ("x0", "x1", "x2", "x3")
#: Histogram bins for each factor e of a squared distance (from e**-4 to e**6, all beyond being in the end bins) and, four
#: times as many, for each unit of a statistic.
_BINS = 64


def with_counts(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep, and the base counts of every whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lost = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0)
    step = df.select(*keep, word_array(text).alias("_w"), (F.length(text) - lost(" \t\n\x0b\x0c\r")).cast("bigint").alias("word_chars"), lost(SYMBOLS).cast("bigint").alias("n_symbols"), lines.alias("_l"))
    step = step.select(*keep, "word_chars", "n_symbols", F.size("_w").cast("bigint").alias("n_words"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"), "_w", F.when(F.size("_w") >= 3, F.sequence(F.lit(0), F.size("_w") - 3)).otherwise(F.array().cast("array<int>")).alias("_i"))
    # (hash of the window, its place) in order: a window found twice stands next to its like
    triples = F.sort_array(F.transform("_i", lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i"))))
    step = step.withColumn("_t", triples)
    again = F.filter("_t", lambda x, j: (x["h"] == F.get("_t", j - 1)["h"]) | (x["h"] == F.get("_t", j + 1)["h"]))
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    step = step.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.size("_t") > 1, places).otherwise(F.array().cast("array<int>")).alias("_p"))
    # a window covers three words, less those of the repeated window before it
    covered = F.aggregate("_p", F.struct(F.lit(-9).alias("last"), F.lit(0).cast("bigint").alias("n")), lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")), lambda s: s["n"])
    # _bar, which base_failed() reads, keeps filters above this projection: pushed through, they would copy the arrays'
    # expressions into every lambda that names them
    return step.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), F.monotonically_increasing_id().alias("_bar"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")) | (F.col("_bar") < 0)


def vector() -> list[Column]:
    """Transformed statistics: log of the mean word length, and roots of the shares of symbols, of repeated lines (a
    line counts as ten words) and of words in repeated windows."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.sqrt(F.least(F.lit(1.0), F.col("n_symbols") / F.greatest("word_chars", F.lit(1)))), F.sqrt(F.least(F.lit(1.0), 10 * F.col("n_dup_lines") / n)), F.sqrt(F.least(F.lit(1.0), F.col("n_repeat_words") / n))]


def _leading(df: DataFrame, by: list[str], bin_col: str, share: float, sums: list[Column]) -> DataFrame:
    """by, bin_col, _n and sums of each bin up to the one in which the share of a group's rows is reached.  Rows meet by
    group and bin first, so that a group of any size is added up in many tasks; only its bins meet in one."""
    keys = [*by, bin_col]
    bins = df.groupBy(*keys).agg(F.count("*").alias("_n"), *sums).repartition(*keys)
    w = Window.partitionBy(*by)
    placed = bins.withColumn("_c", F.sum("_n").over(w.orderBy(bin_col))).withColumn("_all", F.sum("_n").over(w))
    return placed.filter(F.col("_c") - F.col("_n") < share * F.col("_all"))


def _quantile(df: DataFrame, by: list[str], bin_col: str, share: float, out: str) -> DataFrame:
    """The bin in which the share of each group's rows is reached."""
    return _leading(df, by, bin_col, share, []).groupBy(*by).agg(F.max(bin_col).alias(out))


def _inverse(p: int = 4) -> tuple[list[tuple[str, Column]], list[str]]:
    """Columns of the Cholesky factor of the covariance v_ij, one after another."""
    steps = []
    for i in range(p):
        for j in range(i + 1):
            s = F.col(f"v{i}{j}")
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            steps.append((f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(1e-12))) if i == j else s / F.col(f"l{j}{j}")))
    return steps, [n for n, _ in steps]


def _distance(p: int = 4) -> Column:
    """Squared Mahalanobis distance by forward substitution: columns x_i, m_i and l_ij."""
    z: list[Column] = []
    for i in range(p):
        s = F.col(NAMES[i]) - F.col(f"m{i}")
        for k in range(i):
            s = s - F.col(f"l{i}{k}") * z[k]
        z.append(s / F.col(f"l{i}{i}"))
    return sum((a * a for a in z[1:]), z[0] * z[0])


def _group(level: int) -> Column:
    """The key of a row's group at a level (0: all, 1: language, 2: language and source), NULLs told from texts."""
    return F.to_json(F.struct(F.lit(level).alias("level"), *[F.col(c).alias(c) for c in ("_lang", "_source")[:level]]))


def estimates(stats: DataFrame) -> DataFrame:
    """(g, level, n, logdet, start, m_i, l_ij) of each group of stats(_lang, _source, x0..x3): of the concentrations from
    several starts the one with the smallest determinant."""
    rows = durable(stats.select(F.explode(F.array(*[F.struct(_group(k).alias("g"), F.lit(k).alias("level")) for k in range(3)])).alias("k"), *NAMES).select("k.*", *NAMES))
    moving, done = durable(_starts(rows)), None
    for _ in range(STEPS):
        now = durable(_concentrate(rows, moving))
        still = F.abs(F.col("logdet") - F.col("_was")) > SETTLED
        done = now.filter(~still) if done is None else done.unionByName(now.filter(~still))
        moving = now.filter(still)
        if moving.isEmpty():
            break
    every = done.unionByName(moving)
    first = ["logdet", "start"]
    rest = [c for c in every.columns if c not in ("g", "_was", *first)]
    best = every.groupBy("g").agg(F.min(F.struct(*first, *rest)).alias("_e"))
    return durable(best.select("g", "_e.*"))


def _starts(rows: DataFrame) -> DataFrame:
    """(g, level, n, start, logdet, m_i, l_ij): from medians with absolute deviations, from medians with the least spreads,
    and from mean and covariance."""
    # medians, then medians of the absolute deviations, of each coordinate
    scale = _BINS * 4
    long = rows.select("g", F.posexplode(F.array(*NAMES)).alias("i", "x"))
    med = durable(_quantile(long.withColumn("_b", F.floor(F.col("x") * scale).cast("bigint")), ["g", "i"], "_b", 0.5, "_m").select("g", "i", ((F.col("_m") + 0.5) / scale).alias("m")))
    dev = long.join(small(med), ["g", "i"]).withColumn("_b", F.floor(F.abs(F.col("x") - F.col("m")) * scale).cast("bigint"))
    mad = _quantile(dev, ["g", "i"], "_b", 0.5, "_s").select("g", "i", (1.4826 * (F.col("_s") + 0.5) / scale).alias("s"))
    pick = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    mids = med.join(mad, ["g", "i"]).groupBy("g").agg(*[pick(i, "m").alias(f"m{i}") for i in range(4)], *[pick(i, "s").alias(f"s{i}") for i in range(4)])
    whole = rows.groupBy("g").agg(F.max("level").alias("level"), F.count("*").alias("_n"), *_moments()).withColumn("n", F.col("_n"))
    classic = _shaped(whole).withColumn("start", F.lit(2))
    spread = lambda k: [(F.greatest(F.col(f"s{i}"), F.lit(FLOOR[i])) if k == 0 else F.lit(FLOOR[i])).alias(f"l{i}{i}") for i in range(4)]
    zero = [F.lit(0.0).alias(f"l{i}{j}") for i in range(4) for j in range(i)]
    out = classic
    for k in (0, 1):
        own = mids.join(whole.select("g", "level", "n"), "g").select("g", "level", "n", F.lit(k).alias("start"), F.lit(1e9).alias("logdet"), *[f"m{i}" for i in range(4)], *spread(k), *zero)
        out = out.unionByName(own)
    return out.withColumn("logdet", F.lit(1e9))


def _moments() -> list[Column]:
    one = [F.sum(x).alias(f"_s{i}") for i, x in enumerate(NAMES)]
    return one + [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"_s{i}{j}") for i in range(4) for j in range(i + 1)]


def _concentrate(rows: DataFrame, est: DataFrame) -> DataFrame:
    """One step: mean and covariance of the nearest half of each group, under each of its estimates.  A bin of distances
    brings its rows' moments along, so that a step is one aggregate over the rows."""
    params = [c for c in est.columns if c not in ("g", "n", "level", "logdet", "_was")]
    near = rows.drop("level").join(small(est.select("g", *params)), "g").select("g", "start", *NAMES, F.floor(F.greatest(F.lit(-4.0), F.least(F.lit(6.0), F.log(_distance() + 1e-6))) * _BINS).cast("bigint").alias("_b"))
    bins = _leading(near, ["g", "start"], "_b", 0.5, _moments())
    sums = [F.sum(c).alias(c) for c in ["_n", *[f"_s{i}" for i in range(4)], *[f"_s{i}{j}" for i in range(4) for j in range(i + 1)]]]
    half = bins.groupBy("g", "start").agg(*sums)
    # the nearest half is narrower than the whole: chi-square consistency factor for four statistics and one half
    return _shaped(half.join(est.select("g", "start", "level", "n", F.col("logdet").alias("_was")), ["g", "start"]), CONSISTENCY, ["start", "_was"])


def _shaped(sums: DataFrame, factor: float = 1.0, keep: Sequence[str] = ()) -> DataFrame:
    """g, level, n, keep, the logarithm of the determinant, mean and Cholesky factor, from moments."""
    mean = sums.withColumns({f"m{i}": F.col(f"_s{i}") / F.col("_n") for i in range(4)})
    cov = mean.withColumns({f"v{i}{j}": (F.col(f"_s{i}{j}") / F.col("_n") - F.col(f"m{i}") * F.col(f"m{j}")) * factor + (FLOOR[i] ** 2 if i == j else 0.0) for i in range(4) for j in range(i + 1)})
    steps, names = _inverse()
    for name, c in steps:
        cov = cov.withColumn(name, c)
    det = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(1, 4)), 2 * F.log(F.col("l00")))
    return cov.select("g", "level", "n", *keep, det.alias("logdet"), *[f"m{i}" for i in range(4)], *names)


#: 0.5 / P(chi2 with 6 degrees <= median of chi2 with 4).
CONSISTENCY = 0.5 / 0.2386


def _statistics(docs: DataFrame, keep: list[str], text_col: str, lang_col: str, source_col: str) -> DataFrame:
    named = docs.select(*keep, F.col(lang_col).cast("string").alias("_lang"), F.col(source_col).cast("string").alias("_source"), F.col(text_col).alias("_text"))
    return with_counts(named, "_text", [*keep, "_lang", "_source"]).withColumn("base_failed", base_failed()).withColumns(dict(zip(NAMES, vector(), strict=True)))


def _verdicts(stats: DataFrame, est: DataFrame) -> DataFrame:
    """stats with the distance under the most specific estimate of its language and source, and kept."""
    est = est.filter(F.col("n") >= MIN_ROWS)
    params = [c for c in est.columns if c not in ("g", "n", "level", "logdet", "start")]
    held = est.select("g", F.struct("level", *params).alias("_e"))
    out = stats
    for k in range(3):
        own = small(held.filter(F.col("_e.level") == k).select(F.col("g").alias("_key"), F.col("_e").alias(f"_e{k}")))
        out = out.join(own, _group(k) == F.col("_key"), "left").drop("_key")
    out = out.withColumn("_e", F.coalesce("_e2", "_e1", "_e0")).select(*stats.columns, "_e.*").withColumn("distance", _distance())
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT))


def judge(docs: DataFrame, id_cols: list[str], text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id_cols, base counts, base_failed, distance (NULL without an estimate) and kept, for each row."""
    stats = durable(_statistics(docs, id_cols, text_col, lang_col, source_col))
    out = _verdicts(stats, estimates(stats.filter(~F.col("base_failed"))))
    return out.select(*id_cols, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def kept_rows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows that the rules keep, in docs' columns.  Texts are counted once, into a narrow table; rows go whose text,
    language and source were rejected, by a 128-bit key of these (ids are not looked at), so that texts are written nowhere
    and travel only where the rejected keys are too many to be sent to every task."""
    rows = keyed(docs, [text_col, lang_col, source_col])
    names = {"_c0": text_col, "_c1": lang_col, "_c2": source_col}
    stats = durable(_statistics(rows.select("_k1", "_k2", *[F.col("_row")[c].alias(n) for n, c in names.items()]), ["_k1", "_k2"], "_c0", "_c1", "_c2"))
    judged = _verdicts(stats, estimates(stats.filter(~F.col("base_failed"))))
    rejected = joinable(judged.filter(~F.col("kept")).select("_k1", "_k2").distinct(), BROADCAST_KEYS)
    return unkeyed(rows.join(rejected, ["_k1", "_k2"], "left_anti"), docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), ["doc_id"])
