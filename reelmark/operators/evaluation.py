"""Evaluation of scores and tags against labels and against each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import FAILURE, SPLIT, SUCCESS
from ..functions import tag_from
from .ranges import cut_points, running_sums


def accuracy(df: DataFrame, keys: Sequence[str], predicted: str, actual: str) -> DataFrame:
    """(keys, n, accuracy) over rows that have both."""
    both = df.filter(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias("accuracy"))


def auroc(df: DataFrame, keys: Sequence[str], score: str, positive: str) -> DataFrame:
    """(keys, n_pos, n_neg, auroc): the share of positive-negative pairs ranked right, ties half; null without pairs.

    Rows are first summed by score, so running sums walk distinct scores, not rows, range by range, and no pair is ever
    made. Sums are whole numbers until the last division. Scores are numbers.
    """
    pos = F.col(positive).cast("boolean")
    rows = df.filter(F.col(score).isNotNull() & F.col(positive).isNotNull())
    by = rows.groupBy(*keys, score).agg(F.count_if(pos).alias("_p"), F.count_if(~pos).alias("_n"))
    ranked = running_sums(by, keys, score, {"_below": "_n"}, own=False, cuts=cut_points(rows, score))
    wins = F.sum(F.col("_p").cast("decimal(38,0)") * (2 * F.col("_below") + F.col("_n")))
    out = ranked.groupBy(*keys).agg(F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"), wins.cast("double").alias("_w"))
    pairs = 2.0 * F.col("n_pos") * F.col("n_neg")
    return out.select(*keys, "n_pos", "n_neg", (F.col("_w") / F.nullif(pairs, F.lit(0.0))).alias("auroc"))


def roc_points(df: DataFrame, keys: Sequence[str], score: str, positive: str, tie: str) -> DataFrame:
    """(keys, point, fpr, tpr): a point per row from the highest score down, ties by `tie`, after a first one at (0, 0).
    Scores and ties are numbers or times; groups are walked range by range."""
    pos = F.col(positive).cast("int")
    rows = df.filter(F.col(score).isNotNull() & F.col(positive).isNotNull()).select(*keys, score, tie, F.lit(1).alias("_one"), pos.alias("_p"), (1 - pos).alias("_n"))
    walked = running_sums(rows, keys, score, {"_point": "_one", "_tp": "_p", "_fp": "_n"}, tie=tie, descending=True)
    pts = walked.select(*keys, F.col("_point").alias("point"), *((F.col(x) / F.greatest(F.col(x + "_all"), F.lit(1))).alias(name) for x, name in (("_fp", "fpr"), ("_tp", "tpr"))))
    zero = rows.select(*keys).distinct().select(*keys, F.lit(0).cast("bigint").alias("point"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return zero.unionByName(pts)


def prevalence(df: DataFrame, keys: Sequence[str], tag: str) -> DataFrame:
    """(keys, n, n_success, n_failure, failure_share) over tagged rows."""
    n, bad = F.count("*"), F.count_if(F.col(tag) == FAILURE)
    return df.filter(F.col(tag).isNotNull()).groupBy(*keys).agg(n.alias("n"), (n - bad).alias("n_success"), bad.alias("n_failure"), (bad / n).alias("failure_share"))


def seg_only_prevalence(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """prevalence() of the tags by the box score alone, over rows that have one."""
    return prevalence(df.withColumn("_tag", tag_from(score)), keys, "_tag")


def headline(verdicts: DataFrame) -> DataFrame:
    """One row of fusion.verdicts(): episodes, with_models, n_success, n_failure, failure_share, and of the episodes with
    both signals full_n, full_success, full_failure. Without a tag an episode is neither."""
    ok, bad = F.col("tag") == SUCCESS, F.col("tag") == FAILURE
    both = (F.col("n_models") > 0) & F.col("seg_score").isNotNull()
    ns, nf = F.count_if(ok), F.count_if(bad)
    return verdicts.agg(
        F.count("*").alias("episodes"), F.count_if(F.col("n_models") > 0).alias("with_models"), ns.alias("n_success"), nf.alias("n_failure"), (nf / F.greatest(ns + nf, F.lit(1))).alias("failure_share"),
        F.count_if(both).alias("full_n"), F.count_if(both & ok).alias("full_success"), F.count_if(both & bad).alias("full_failure"),
    )


def scores_by_label(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """(keys, label, n, mean, least, most): what a chart of scores under each label shows, over rows that have both."""
    rows = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    return rows.groupBy(*keys, label).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.min(score).alias("least"), F.max(score).alias("most"))


def prevalence_bars(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, tag, n, share): the bars of summary() rows, one for each tag."""
    total = F.nullif(F.col("n_success") + F.col("n_failure"), F.lit(0))
    bars = F.array(*[F.struct(F.lit(t).alias("tag"), F.col(c).alias("n"), (F.col(c) / total).alias("share")) for t, c in ((SUCCESS, "n_success"), (FAILURE, "n_failure"))])
    return summaries.select(*keys, F.explode(bars).alias("b")).select(*keys, "b.*")


def distinct_values(df: DataFrame, keys: Sequence[str], value: str, *, first: int | None = None) -> DataFrame:
    """(keys, n, values): how many distinct values a group has, and the `first` smallest of them (all without it), sorted.

    Repeats go before anything is gathered, in two steps: by (keys, value), whatever share of the rows a group has, and then the
    values left are counted. With `first` no more than so many of a group meet in one place. Nulls are no values.
    """
    once = df.filter(F.col(value).isNotNull()).select(*keys, value).distinct()
    counted = once.groupBy(*keys).agg(F.count("*").alias("n"))
    if first is not None:
        # A few rows of a group by each task: ranks within a slice of its values, then among what the slices leave.
        sliced = once.withColumn("_slice", F.pmod(F.xxhash64(value), F.lit(64)))
        once = sliced.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(value))).filter(F.col("_r") <= first)
        once = once.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).filter(F.col("_r") <= first)
    both = counted.select(*keys, "n", F.lit(None).cast(df.schema[value].dataType).alias("_v")).unionByName(once.select(*keys, F.lit(0).cast("bigint").alias("n"), F.col(value).alias("_v")))
    return both.groupBy(*keys).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("_v")).alias("values"))


def in_use(df: DataFrame, keys: Sequence[str], mode: str, tracks: str) -> DataFrame:
    """(keys, modes, n_tracks): the distinct modes, sorted, and how many distinct ids the arrays of ids hold. Ids are made
    distinct in their row and then by (keys, id), so that no group's arrays meet in one place; the modes are few."""
    ids = df.select(*keys, F.lit(None).cast("string").alias("_mode"), F.explode(F.array_distinct(tracks)).alias("_id"))
    modes = df.select(*keys, F.col(mode).cast("string").alias("_mode"), F.lit(None).cast(ids.schema["_id"].dataType).alias("_id"))
    once = ids.unionByName(modes).distinct()
    return once.groupBy(*keys).agg(F.array_sort(F.collect_list("_mode")).alias("modes"), F.count("_id").alias("n_tracks"))


def summary(df: DataFrame, keys: Sequence[str], *, tag: str, late_tag: str, max_tag: str, label: str, score: str) -> DataFrame:
    """Per group: n, tags, failure share, successes by either statistic, accuracy and AUROC over the labelled rows."""
    right = F.when(F.col(label).isNotNull(), (F.col(tag) == F.col(label)).cast("double"))
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col(tag) == SUCCESS).alias("n_success"), F.count_if(F.col(tag) == FAILURE).alias("n_failure"),
        F.avg((F.col(tag) == FAILURE).cast("double")).alias("failure_share"), F.count_if(F.col(late_tag) == SUCCESS).alias("success_late"),
        F.count_if(F.col(max_tag) == SUCCESS).alias("success_max"), F.avg(right).alias("accuracy"),
    )
    curve = auroc(df.withColumn("_pos", F.col(label) == SUCCESS), keys, score, "_pos").select(*keys, "auroc")
    return counts.join(curve, list(keys), "left")


def consensus(n_success: Column, n: Column) -> Column:
    """The majority's tag; split if it is even."""
    return F.when(2 * n_success > n, SUCCESS).when(2 * n_success < n, FAILURE).when(n > 0, SPLIT)


def votes(n_success: Column, n: Column) -> Column:
    """k/n as text; null without votes."""
    return F.when(n > 0, F.concat(n_success.cast("string"), F.lit("/"), n.cast("string")))


def pivot_cells(df: DataFrame, episode: str, model: str, models: Sequence[str], value: str) -> DataFrame:
    """A row per episode, a column per model; null where the episode has no such model. The models are given, so no
    pass looks for them."""
    return df.groupBy(episode).agg(*[F.max(F.when(F.col(model) == m, F.col(value))).alias(m) for m in models])


def agreement(df: DataFrame, episode: str, model: str, tag: str, models: Sequence[str]) -> DataFrame:
    """(model_a, model_b, n_common, agreement) for every pair of the given models, over episodes that both tag.

    An episode's tags are gathered in one row, so pairs are made of the few models, never by joining episodes.
    """
    wide = pivot_cells(df.filter(F.col(tag).isNotNull()), episode, model, models, tag)
    pairs = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for a in models for b in models])
    rows = wide.select(F.explode(pairs).alias("p")).select("p.*")
    same = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), (F.col("x") == F.col("y")).cast("double"))
    return rows.groupBy("model_a", "model_b").agg(F.count(same).alias("n_common"), F.avg(same).alias("agreement"))


def separation(df: DataFrame, label: str, features: Sequence[str], *, least_rows: int = 4, top: int = 12) -> DataFrame:
    """(feature, gap, success_mean, failure_mean): the `top` features of largest |gap|, the difference of the class
    means in standard deviations of all labelled rows; ties by the larger gap, then the later name.

    A feature that a labelled row lacks, that hardly varies, or that a class lacks is left out; under least_rows
    labelled rows nothing is returned.
    """
    labelled = df.filter(F.col(label).isin(SUCCESS, FAILURE)).select(label, *[F.col(f).cast("double").alias(f) for f in features])
    long = labelled.unpivot([label], list(features), "feature", "value")
    s, f = (F.avg(F.when(F.col(label) == x, F.col("value"))) for x in (SUCCESS, FAILURE))
    per = long.groupBy("feature").agg(F.count("*").alias("_rows"), F.count("value").alias("_known"), s.alias("success_mean"), f.alias("failure_mean"), F.stddev_pop("value").alias("_sd"))
    fine = per.filter((F.col("_rows") >= least_rows) & (F.col("_rows") == F.col("_known")) & (F.col("_sd") >= 1e-12) & F.col("success_mean").isNotNull() & F.col("failure_mean").isNotNull())
    out = fine.select("feature", ((F.col("success_mean") - F.col("failure_mean")) / F.nullif("_sd", F.lit(0.0))).alias("gap"), "success_mean", "failure_mean")
    return out.orderBy(F.desc(F.abs("gap")), F.desc("gap"), F.desc("feature")).limit(top)
