"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Every text gives a vector of transformed statistics. For each language and source, each language, and all rows, a
minimum-covariance-determinant estimate is found as FAST-MCD and its deterministic form do: concentration steps, which
keep the share CORE of rows nearest to the last estimate and take their mean and covariance, run from three robust
starts (medians with absolute deviations, and with the correlations of squashed values and of spatial signs) and from
RANDOM small sets of rows, chosen by their fingerprints; after TRIAL steps the start with the least determinant goes on until no determinant falls any more. The covariances are
regularised by a fixed diagonal (FLOOR), as ratios that are zero in nearly all rows have no spread of their own.

Cube roots of the squared distances are nearly normal (Wilson and Hilferty). Their median and upper quartile in the
group set the scale of clean rows, so heavy tails widen it, and a row beyond the deviate CUT of it is rejected. A group
of fewer than LEAST rows, five to a dimension, has no covariance of its own and leaves the judgement to its language,
and a language to all rows.

Quantiles are taken from counts by group and rounded value, and means and covariances are summed up before the shuffle,
so a source that holds a third of all rows is no hot task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import Scratch

SPACE = r"[\x20\x09-\x0D]+"
WORDY = r"[^\x20\x09-\x0D]"
FEATURES = ("x_word_length", "x_symbols", "x_dup_lines", "x_repeats", "x_upper")
#: Smallest standard deviation that an estimate may have: ratios that are zero in nearly all rows would have none.
FLOOR = {"x_word_length": 0.08, "x_symbols": 0.35, "x_dup_lines": 0.8, "x_repeats": 0.6, "x_upper": 0.35}
RANDOM, FEW = 5, len(FEATURES) + 1
SHRINK = {"n_lines": 10, "n_words": 100, "word_chars": 500}
CORE, TRIAL, MOST, LEAST = 0.6, 2, 25, 5 * len(FEATURES)
CUT = 4.7534  # the normal deviate that one clean row in a million exceeds
QUARTILE = 0.67449  # that of the upper quartile


def let(df: DataFrame, **named: Column) -> DataFrame:
    """Add columns behind a generator, so that the optimiser can't copy their expressions into lambdas that use them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in named.items())))))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs but the text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_upper.

    A null text has no words. Rows are independent; columns named as the results or beginning with q_ must not be there.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = let(docs, q_body=body, q_trim=F.expr(f"trim(BOTH ' \\t\\n\\u000B\\u000C\\r' FROM coalesce(`{text}`, ''))"))
    df = let(df, q_w=F.when(F.col("q_trim") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("q_trim", SPACE)))
    df = let(df, q_n=F.size("q_w"), q_lines=F.filter(F.split("q_body", "\n"), lambda x: x.rlike(WORDY)))
    # fingerprints of the three-word windows
    df = let(df, q_k=F.expr("if(q_n < 3, cast(array() as array<bigint>), transform(sequence(0, q_n - 3), i -> xxhash64(q_w[i], q_w[i + 1], q_w[i + 2])))"))
    df = let(df, q_sorted=F.expr("if(size(array_distinct(q_k)) < size(q_k), sort_array(q_k), cast(array() as array<bigint>))"))
    df = let(df, q_twice=F.expr("if(size(q_sorted) < 2, cast(array() as array<bigint>), array_distinct(array_compact(transform(sequence(1, size(q_sorted) - 1), i -> if(q_sorted[i] = q_sorted[i - 1], q_sorted[i], cast(null as bigint))))))"))
    # where the repeated windows begin: a few are looked up window by window, many are found by sorting windows with their places
    few = "filter(sequence(0, q_n - 3), i -> array_contains(q_twice, q_k[i]))"
    df = let(df, q_placed=F.expr("if(size(q_twice) <= 64, cast(array() as array<struct<k: bigint, i: int>>), array_sort(transform(q_k, (k, i) -> struct(k, i))))"))
    many = "array_compact(transform(sequence(0, size(q_placed) - 1), j -> if(q_placed[j].k = coalesce(get(q_placed, j - 1).k, q_placed[j].k - 1) or q_placed[j].k = coalesce(get(q_placed, j + 1).k, q_placed[j].k - 1), q_placed[j].i, cast(null as int))))".replace("q_placed[j].k - 1", "~q_placed[j].k")
    df = let(df, q_at=F.expr(f"case when size(q_twice) = 0 then cast(array() as array<int>) when size(q_placed) = 0 then {few} else {many} end"))
    upper = F.regexp_count("q_body", F.lit(r"\p{Lu}"))
    out = {
        "n_words": F.col("q_n"),
        "word_chars": F.length(F.array_join("q_w", "")),
        "n_symbols": F.regexp_count("q_body", F.lit(r"[#*$%&|<>]")),
        "n_lines": F.size("q_lines"),
        "n_dup_lines": F.size("q_lines") - F.size(F.array_distinct("q_lines")),
        "n_repeat_words": F.size(F.array_distinct(F.flatten(F.transform("q_at", lambda p: F.array(p, p + 1, p + 2))))),
        "n_upper": upper,
    }
    return df.select(*(docs[c] for c in docs.columns if c != text), *(c.cast("long").alias(n) for n, c in out.items()))


def vectors(stats: DataFrame) -> DataFrame:
    """Adds base_failed and the transformed features to rows with statistics().

    Shares are shrunk by a few clean lines, words or characters, so that one repeated line of a short text says little.
    """
    share = lambda part, whole: F.log1p(100.0 * F.col(part) / (F.col(whole) + SHRINK[whole]))
    return stats.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "x_word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
            "x_symbols": share("n_symbols", "word_chars"),
            "x_dup_lines": share("n_dup_lines", "n_lines"),
            "x_repeats": share("n_repeat_words", "n_words"),
            "x_upper": share("n_upper", "word_chars"),
        }
    )


def _levels() -> Column:
    """The groups that a row counts for: language and source, language, all."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("lang", "source"))
    return F.array(F.concat_ws("\x01", F.lit("s"), lang, source), F.concat_ws("\x01", F.lit("l"), lang), F.lit("a"))


def _quantiles(rows: DataFrame, by: list[str], columns: dict[str, Column], at: dict[str, float]) -> DataFrame:
    """(*by, a column for each of `at`): quantiles, each of the column that its name begins with up to a colon, rounded to 0.001.

    Counted by group and value, so that a large group is dealt over all tasks; a group's values are on a bounded grid.
    """
    values = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(n).alias("which"), F.round(c, 3).alias("value")) for n, c in columns.items()))).alias("x"))
    counts = values.select(*by, "x.which", "x.value").groupBy(*by, "which", "value").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by, "which")
    summed = counts.select(*by, "which", "value", F.sum("n").over(group.orderBy("value")).alias("upto"), F.sum("n").over(group).alias("total"))
    found = [F.min(F.when((F.col("which") == n.split(":")[0]) & (F.col("upto") >= q * F.col("total")), F.col("value"))).alias(n.replace(":", "_")) for n, q in at.items()]
    return summed.groupBy(by).agg(*found, F.max("total").alias("n"))


def _distance() -> Column:
    """Squared Mahalanobis distance: the length of the row's offset times the inverse Cholesky factor in w_i_j."""
    total = F.lit(0.0)
    for i in range(len(FEATURES)):
        z = sum((F.col(f"w_{i}_{j}") * (F.col(FEATURES[j]) - F.col(f"m_{j}")) for j in range(1, i + 1)), F.col(f"w_{i}_0") * (F.col(FEATURES[0]) - F.col("m_0")))
        total = total + F.pow(z, F.lit(2.0))
    return total


def _factor(moments: DataFrame) -> DataFrame:
    """(.., m_i, l_i_j, w_i_j) from (.., m_i, c_i_j): the covariance with its floor, factored column by column, and the factor's inverse."""
    d = len(FEATURES)
    df = moments
    for j in range(d):
        diagonal = F.col(f"c_{j}_{j}") + F.lit(FLOOR[FEATURES[j]] ** 2)
        for k in range(j):
            diagonal = diagonal - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        df = df.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(diagonal, F.lit(1e-9))))
        for i in range(j + 1, d):
            v = F.col(f"c_{i}_{j}")
            for k in range(j):
                v = v - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            df = df.withColumn(f"l_{i}_{j}", v / F.col(f"l_{j}_{j}"))
    rest = [c for c in moments.columns if c[:2] not in ("m_", "c_")]
    df = let(df.select(*rest, *(f"m_{i}" for i in range(d)), *(f"l_{i}_{j}" for i in range(d) for j in range(i + 1))), ready=F.lit(True)).drop("ready")
    inverse: dict[tuple[int, int], Column] = {}
    for j in range(d):
        inverse[j, j] = 1 / F.col(f"l_{j}_{j}")
        for i in range(j + 1, d):
            inverse[i, j] = -sum((F.col(f"l_{i}_{k}") * inverse[k, j] for k in range(j + 1, i)), F.col(f"l_{i}_{j}") * inverse[j, j]) / F.col(f"l_{i}_{i}")
    return df.select("*", *(c.alias(f"w_{i}_{j}") for (i, j), c in inverse.items()))


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """(*by, m_i, c_i_j): means and covariances of the features, from plain sums (values are small, so little cancels)."""
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
    sums = rows.groupBy(by).agg(
        F.count("*").alias("n"), *(F.sum(x).alias(f"s_{i}") for i, x in enumerate(FEATURES)),
        *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s_{i}_{j}") for i, j in pairs),
    )
    means = [(F.col(f"s_{i}") / F.col("n")).alias(f"m_{i}") for i in range(len(FEATURES))]
    return sums.select(*by, *means, *((F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("n") / F.col("n")).alias(f"c_{i}_{j}") for i, j in pairs))


def _starts(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(grp, start, m_i, l_i_j): the starts of every group, three robust ones and RANDOM of a few random rows each."""
    d = range(len(FEATURES))
    middle = scratch.save(_quantiles(rows, ["grp"], {x: F.col(x) for x in FEATURES}, dict.fromkeys(FEATURES, 0.5)), "medians")
    sizes = middle.select("grp", "n")
    middle = middle.select("grp", *(F.col(x).alias(f"m_{i}") for i, x in enumerate(FEATURES)))
    off = rows.join(middle, "grp")
    spread = _quantiles(off, ["grp"], {x: F.abs(F.col(x) - F.col(f"m_{i}")) for i, x in enumerate(FEATURES)}, dict.fromkeys(FEATURES, 0.5))
    # standard deviations with their floor, so that values are comparable
    spread = scratch.save(spread.select("grp", *(F.sqrt(F.pow(1.4826 * F.col(x), 2) + FLOOR[x] ** 2).alias(f"s_{i}") for i, x in enumerate(FEATURES))), "spreads")
    z = off.join(spread, "grp").select("grp", *((F.col(x) - F.col(f"m_{i}")) / F.col(f"s_{i}") for i, x in enumerate(FEATURES)))
    z = z.toDF("grp", *(f"z_{i}" for i in d))
    norm = F.greatest(sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in d), F.lit(0.0)), F.lit(1e-9))
    pairs = [(i, j) for i in d for j in range(i + 1)]
    squashed = [F.avg(F.tanh(f"z_{i}") * F.tanh(f"z_{j}")).alias(f"t_{i}_{j}") for i, j in pairs]
    signs = [F.avg(F.col(f"z_{i}") * F.col(f"z_{j}") / F.col("norm")).alias(f"g_{i}_{j}") for i, j in pairs]
    moments = z.withColumn("norm", norm).groupBy("grp").agg(*squashed, *signs).join(middle, "grp").join(spread, "grp")

    def start(k: int, correlation) -> DataFrame:
        return moments.select("grp", F.lit(k).alias("start"), *(f"m_{i}" for i in d), *((correlation(i, j) * F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"c_{i}_{j}") for i, j in pairs))

    def scaled(x: str):
        return lambda i, j: F.lit(1.0) if i == j else F.coalesce(F.col(f"{x}_{i}_{j}") / F.sqrt(F.greatest(F.col(f"{x}_{i}_{i}") * F.col(f"{x}_{j}_{j}"), F.lit(1e-12))), F.lit(0.0)) * 0.99

    moments = scratch.save(moments, "moments")
    # a row is in a random start if its fingerprint is among the FEW smallest of so many, one in expectation each
    few = rows.join(sizes, "grp").select("grp", *FEATURES, "n", F.posexplode(F.array(*(F.xxhash64(F.lit(k), *FEATURES) for k in range(RANDOM)))).alias("k", "h"))
    few = _moments(few.where(F.pmod(F.shiftright("h", 8), "n") < FEW), ["grp", "k"])
    made = start(0, lambda i, j: F.lit(float(i == j))).union(start(1, scaled("t"))).union(start(2, scaled("g")))
    return scratch.save(_factor(made.union(few.withColumn("k", F.col("k") + 3).toDF(*made.columns))), "starts")


def _concentrate(rows: DataFrame, fit: DataFrame, scratch: Scratch) -> DataFrame:
    """One concentration step of every fit(grp, start, m_i, l_i_j) over the rows of its group, written."""
    near = rows.join(fit, "grp").select("grp", "start", *FEATURES, F.round(F.log1p(_distance()), 3).alias("far"))
    edge = scratch.save(_quantiles(near, ["grp", "start"], {"far": F.col("far")}, {"far": CORE}).select("grp", "start", F.col("far").alias("edge")), "edge")
    core = near.join(edge, ["grp", "start"]).where("far <= edge")
    return scratch.save(_factor(_moments(core, ["grp", "start"])), "fit")


def _log_det() -> Column:
    return sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, len(FEATURES))), F.log(F.col("l_0_0")))


def estimates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(grp, n, m_i, l_i_j, centre, spread): location, Cholesky factor and law of the distances of every group.

    Groups are those of the rows that passed the base rules. centre and spread are those of the distances' cube roots.
    """
    rows = scratch.save(rows.where("not base_failed").select(F.explode(_levels()).alias("grp"), *FEATURES), "levels")
    # groups below LEAST have no say, so they need no estimate
    large = scratch.save(rows.groupBy("grp").count().where((F.col("count") >= LEAST) | (F.col("grp") == "a")).select("grp"), "groups")
    rows = rows.join(large, "grp", "left_semi")
    fit = _starts(rows, scratch)
    for _ in range(TRIAL):
        fit = _concentrate(rows, fit, scratch)
    fit = fit.select("*", F.row_number().over(Window.partitionBy("grp").orderBy(_log_det(), "start")).alias("rank")).where("rank = 1").drop("rank")
    fit = scratch.save(fit, "best")
    for _ in range(MOST):
        was = fit.select("grp", _log_det().alias("was"))
        # groups whose determinant still falls go on
        after = _concentrate(rows, fit, scratch)
        better = after.join(was, "grp").where(_log_det() < F.col("was") - 1e-3).drop("was")
        better = scratch.save(better, "better")
        if not better.limit(1).count():
            break
        fit = scratch.save(fit.join(better, "grp", "left_anti").union(better.select(*fit.columns)), "fit")
    roots = rows.join(fit, "grp").select("grp", F.cbrt(_distance()).alias("root"))
    law = _quantiles(roots, ["grp"], {"root": F.col("root")}, {"root:half": 0.5, "root:upper": 0.75})
    law = law.select("grp", "n", F.col("root_half").alias("centre"), F.greatest((F.col("root_upper") - F.col("root_half")) / QUARTILE, F.lit(math.sqrt(2 / (9 * len(FEATURES))))).alias("spread"))
    return scratch.save(fit.drop("start").join(law, "grp"), "estimates")


def _judged(rows: DataFrame, fit: DataFrame, least: int) -> DataFrame:
    """rows of vectors() with grp, distance (as a normal deviate) and kept; fit is the small table of estimates."""
    sizes = fit.select(F.col("grp"), F.col("n"))
    levels = _levels()
    out = rows.withColumns({"g_s": levels[0], "g_l": levels[1]})
    for g in ("g_s", "g_l"):
        out = out.join(sizes.select(F.col("grp").alias(g), F.col("n").alias(f"{g}_n")), g, "left")
    group = F.when(F.col("g_s_n") >= least, F.col("g_s")).when(F.col("g_l_n") >= least, F.col("g_l")).otherwise(F.lit("a"))
    out = out.withColumn("grp", group).join(fit.drop("n"), "grp", "left").withColumn("distance", (F.cbrt(_distance()) - F.col("centre")) / F.col("spread"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True)))


def judge(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per row of docs(doc_id, text, lang, source): statistics, base_failed, group, distance, kept.

    distance is the normal deviate of the row's robust distance among those of its group; kept is false if the base
    rules fail, else whether that is within the cut. A null text has
    no words and fails; a null lang or source is a group of its own; equal rows get equal verdicts; a corpus with no
    row that passes the base rules has no estimate and keeps none; an empty table gives an empty result. Further
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.save(vectors(statistics(docs.select("doc_id", "text", "lang", "source"))), "statistics")
    out = _judged(rows, estimates(rows, scratch), least)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select("doc_id", *names, F.round("distance", 3).alias("distance"), F.translate("grp", "\x01\0", "/").alias("grp"), "kept")


def filter_documents(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever these are named.

    Null and wordless texts fail the base rules and go; null languages and sources are groups of their own; repeated
    rows get equal verdicts; an empty table gives an empty result. Statistics are taken once and written beside the
    rows; texts are not shuffled.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    whole = docs.select(F.struct(*docs.columns).alias("whole"), "text", "lang", "source")
    rows = scratch.save(vectors(statistics(whole)), "statistics")
    return _judged(rows, estimates(rows, scratch), least).where("kept").select("whole.*")
