"""Classification and latency metrics as plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowframe.sources.staging import staged


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``actual, predicted, n, row_share`` for every pair of labels, zeros too; shares of an unseen label are 0."""
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    words = counts.select(F.explode(F.array("actual", "predicted")).alias("w")).distinct()
    every = words.select(F.col("w").alias("actual")).crossJoin(F.broadcast(words.select(F.col("w").alias("predicted"))))  # labels squared
    full = every.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))
    row = F.sum("n").over(Window.partitionBy("actual"))
    return full.withColumn("row_share", F.round(F.col("n") / F.greatest(row, F.lit(1)), 9))


def per_class(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``label, support, n_predicted, n_right, precision_score, recall_score, f1`` of every label; nothing over nothing is 0."""
    counts = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    each = counts.select(F.explode(F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("r")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("r")),
    )).alias("x")).groupBy("x.label").agg(F.sum("x.s").alias("support"), F.sum("x.p").alias("n_predicted"), F.sum("x.r").alias("n_right"))
    p, r = F.col("n_right") / F.greatest("n_predicted", F.lit(1)), F.col("n_right") / F.greatest("support", F.lit(1))
    return each.select("label", "support", "n_predicted", "n_right", F.round(p, 9).alias("precision_score"), F.round(r, 9).alias("recall_score"), F.round(2 * p * r / F.greatest(p + r, F.lit(1e-12)), 9).alias("f1"))


def overall(classes: DataFrame) -> DataFrame:
    """Accuracy, and macro and support-weighted means over the labels in truth or prediction."""
    w = F.col("support") / F.sum("support").over(Window.partitionBy())  # one row a label
    weighted = classes.withColumn("w", w)
    return weighted.agg(
        F.round(F.sum("n_right") / F.sum("support"), 9).alias("accuracy"),
        *[F.round(F.avg(c), 6).alias(f"macro_{n}") for n, c in (("precision", "precision_score"), ("recall", "recall_score"), ("f1", "f1"))],
        *[F.round(F.sum(F.col("w") * F.col(c)), 6).alias(f"weighted_{n}") for n, c in (("precision", "precision_score"), ("recall", "recall_score"), ("f1", "f1"))],
    )


#: Ranges of the ordering value that running sums are counted in, for each key.
RANGES = 64


def _dealt(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``df`` with ``range``: between which approximate quantiles of the key the row's ``order`` value lies."""
    cuts = df.groupBy(*keys).agg(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 1000).alias("cuts"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.alias("d").join(cuts.alias("c"), on).select("d.*", F.size(F.filter("cuts", lambda c: c < F.col(f"d.{order}"))).alias("range"))


def with_next_lower(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """``df`` with ``next_<column>`` of the key's row with the next lower ``order`` value, which is distinct in a key.

    Neighbours are found within ranges; a range's lowest row takes the highest of the range below.
    """
    dealt = _dealt(df, keys, order)
    values = F.struct(*columns)
    inside = Window.partitionBy(*keys, "range").orderBy(F.desc(order))
    highest = dealt.groupBy(*keys, "range").agg(F.max_by(values, order).alias("values"))
    below = F.lag("values").over(Window.partitionBy(*keys).orderBy("range"))  # RANGES rows a key
    heads = highest.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col("range").alias("k_range"), below.alias("below"))
    placed = dealt.withColumn("after", F.lead(values).over(inside))
    on = placed["range"] == heads["k_range"]
    for k in keys:
        on = on & placed[k].eqNullSafe(heads[f"k_{k}"])
    found = placed.join(heads, on).withColumn("after", F.coalesce("after", "below"))
    return found.select(*df.columns, *[F.col(f"after.{c}").alias(f"next_{c}") for c in columns])


def running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, str]) -> DataFrame:
    """``df`` with the sums (new name: column) of all rows of the key up to and with the row's ``order`` value, which is distinct in a key.

    Rows are dealt into ranges between approximate quantiles of the key; sums run within a range and over the ranges'
    totals, so no task orders all rows of a key.
    """
    dealt = _dealt(df, keys, order)
    inside = Window.partitionBy(*keys, "range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a key
    totals = dealt.groupBy(*keys, "range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    starts = totals.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col("range").alias("k_range"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"start_{n}") for n in sums])
    summed = dealt.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    on = summed["range"] == starts["k_range"]
    for k in keys:
        on = on & summed[k].eqNullSafe(starts[f"k_{k}"])
    return summed.join(starts, on).select(*df.columns, *[(F.col(n) + F.col(f"start_{n}")).alias(n) for n in sums])


def _by_score(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Rows by key and score, staged, since they are read for cuts, sums and totals."""
    return staged(df.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(positive.cast("long")).alias("pos"), F.sum((~positive).cast("long")).alias("neg")), "by_score")


def auc(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve by ``keys``: pairs ranked right, ties half; null where a side is empty.

    Rows are first counted by score.
    """
    ranked = running_sums(_by_score(df, keys, score, positive), keys, "score", {"upto": "neg"})
    won = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2.0))
    return ranked.groupBy(*keys).agg(F.round(won / F.nullif((F.sum("pos") * F.sum("neg")).cast("double"), F.lit(0.0)), 9).alias("auc"))


def macro_auc(areas: DataFrame) -> DataFrame:
    """``macro_auc``: the mean of the labels' areas; null unless every label has one."""
    return areas.agg(F.when(F.count("*") == F.count("auc"), F.round(F.avg("auc"), 9)).alias("macro_auc"))


def evaluation(predictions: DataFrame, actual: str, predicted: str, by_class: DataFrame, score: str, positive: Column) -> DataFrame:
    """Accuracy, macro and weighted means, and the macro area, as one row. ``by_class`` has label and a score for each."""
    return overall(per_class(predictions, actual, predicted)).crossJoin(macro_auc(auc(by_class, ["label"], score, positive)))  # one row each


def curves(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Points by descending score: ``score, tp, fp, tpr, fpr, precision_at``, and ``gain``, the step of tpr. Keys whose rows are all alike give none."""
    counts = _by_score(df, keys, score, positive)
    totals = counts.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys]).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).where("p > 0 and n > 0")
    ranked = running_sums(counts, keys, "score", {"below_pos": "pos", "below_neg": "neg"})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    tp, fp = F.col("p") - F.col("below_pos") + F.col("pos"), F.col("n") - F.col("below_neg") + F.col("neg")
    points = ranked.join(totals, on).select(*keys, "score", tp.alias("tp"), fp.alias("fp"), "p", "n", (F.col("pos") / F.col("p")).alias("gain"))
    return points.select(*keys, "score", "tp", "fp", F.round(F.col("tp") / F.col("p"), 9).alias("tpr"), F.round(F.col("fp") / F.col("n"), 9).alias("fpr"), F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 9).alias("precision_at"), "gain")


def roc_corners(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """``keys, score, tp, fp, tpr, fpr`` of the ROC points at which the curve may bend; the area under them is the same.

    A point with an earlier and a later one goes if both steps add the same counts: the second differences are nought.
    """
    counts = _by_score(df, keys, score, positive)
    first = counts.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys]).agg(F.max("score").alias("top"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).where("p > 0 and n > 0")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    ranked = running_sums(counts, keys, "score", {"below_pos": "pos", "below_neg": "neg"})
    bent = with_next_lower(ranked, keys, "score", ["pos", "neg"]).join(first, on)
    kept = bent.where("next_pos is null or score = top or pos <> next_pos or neg <> next_neg")
    tp, fp = F.col("p") - F.col("below_pos") + F.col("pos"), F.col("n") - F.col("below_neg") + F.col("neg")
    return kept.select(*keys, "score", tp.alias("tp"), fp.alias("fp"), F.round(tp / F.col("p"), 9).alias("tpr"), F.round(fp / F.col("n"), 9).alias("fpr"))


def average_precision(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.round(F.sum(F.col("gain") * F.col("precision_at")), 6).alias("average_precision"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``label, n, weight``: rows over labels times the label's rows."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # one row a label
    return counts.select("label", "n", F.round(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")), 9).alias("weight"))


def class_distribution(rows: DataFrame, label: str, splits: tuple[str, ...]) -> DataFrame:
    """``split, label, n`` for every split and label, zeros too."""
    counts = rows.groupBy("split", F.col(label).alias("label")).agg(F.count("*").alias("n"))
    every = counts.select("label").distinct().withColumn("split", F.explode(F.array(*[F.lit(s) for s in splits])))
    return every.join(counts, ["split", "label"], "left").select("split", "label", F.coalesce("n", F.lit(0)).alias("n"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Percentiles that are values of the table: the one at half-even round(share x (n - 1)); and the mean.

    Values are counted first.
    """
    counts = staged(df.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c")), "by_value")
    totals = counts.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys]).agg(F.sum("c").alias("n"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    placed = running_sums(counts, keys, "v", {"upto": "c"}).join(totals, on)
    at = {s: F.bround(F.lit(s) * (F.col("n") - 1), 0) for s in shares}
    name = lambda s: f"p{round(s * 100)}"
    picked = [F.max(F.when((F.col("upto") > at[s]) & (F.col("upto") - F.col("c") <= at[s]), F.col("v"))).alias(name(s)) for s in shares]
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *picked, F.round(F.sum(F.col("v").cast("decimal(18,2)") * F.col("c")).cast("double") / F.max("n"), 6).alias("mean"))


def exact_percentile(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """``keys, percentile``: exact, weighted between the two nearest values; keys without a value give no row.

    Values are counted first, and the counts staged, so no task holds all values of a key.
    """
    counts = staged(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")), "counts")
    totals = counts.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys]).agg(F.sum("c").alias("n"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    placed = running_sums(counts, keys, "v", {"upto": "c"}).join(totals, on)
    at = (F.col("n") - 1) * F.lit(share)
    picked = [F.max(F.when((F.col("upto") > r) & (F.col("upto") - F.col("c") <= r), F.col("v"))).alias(name) for name, r in (("low", F.floor(at)), ("high", F.ceil(at)))]
    part = F.max(at - F.floor(at)).alias("part")
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high"))
    return placed.groupBy(*keys).agg(*picked, part).select(*keys, between.alias("percentile"))


def running_best(df: DataFrame, order: str, value: str) -> DataFrame:
    """Adds ``best_before`` and ``improved`` (strictly more than all before) to a history of one row a step."""
    earlier = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = df.withColumn("best_before", F.max(value).over(earlier))
    return best.withColumn("improved", F.col("best_before").isNull() | (F.col(value) > F.col("best_before")))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Sum of value times weight over the sum of weights, 1 at least."""
    return df.groupBy(*keys).agg(F.round(F.sum((F.col(value) * F.col(weight)).cast("decimal(28,4)")).cast("double") / F.greatest(F.sum(weight).cast("double"), F.lit(1.0)), 6).alias("weighted_mean"))


def cosine_rates(history: DataFrame, epoch: str, high: float, low: float) -> DataFrame:
    """``history`` with ``rate``: cosine decay from ``high`` towards ``low`` over its epochs, numbered from 0 and distinct."""
    epochs = F.count("*").over(Window.partitionBy())  # one row an epoch
    return history.withColumn("rate", F.round(F.lit(low) + (F.lit(high - low)) * (1 + F.cos(F.lit(3.141592653589793) * F.col(epoch) / epochs)) / 2, 12))
