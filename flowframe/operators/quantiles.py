"""Exact quantiles of many columns by selection: a sketch brackets each rank, one scan counts around the bracket.

The sketch's values just below and above the rank hold it between them. The second scan counts, for every column at once,
the values below and at both ends, and keeps those strictly between, which are a few in ten thousand; only these are
ordered. No row is made longer, and no value is shuffled but the few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowframe.operators.metrics import running_sums
from flowframe.sources.staging import staged

#: The sketch's ranks are wrong by one in so many at most.
ACCURACY = 10_000
#: Values of a column up to which all are kept: its bracket is the whole column.
FEW = 100_000


def brackets(df: DataFrame, columns: list[str], share: float) -> dict[str, tuple[int, float, float]]:
    """For each column that has values: how many, and two of them with the rank of ``share`` between or on them."""
    slack = 2.0 / ACCURACY
    around = F.array(F.lit(max(0.0, share - slack)), F.lit(min(1.0, share + slack)))
    found = df.agg(*[F.struct(
        F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high"), F.percentile_approx(c, around, F.lit(ACCURACY)).alias("near"),
    ).alias(f"x{i}") for i, c in enumerate(columns)]).first()
    out = {}
    for i, c in enumerate(columns):
        n, low, high, near = found[f"x{i}"]
        if n:
            out[c] = (n, low, high) if n <= FEW else (n, near[0], near[1])
    return out


def exact_quantiles(df: DataFrame, columns: list[str], share: float) -> DataFrame:
    """``column_name, quantile``: between the two nearest values where the rank is no whole number; null without values.

    Columns are doubles without NaN; nulls do not count.
    """
    spark = df.sparkSession
    schema = "column_name string, n long, below long, at_low long, at_high long, low double, high double"
    around = brackets(df, columns, share) if columns else {}
    if not around:
        return spark.createDataFrame([(c, None) for c in columns], "column_name string, quantile double")
    counted = [F.struct(
        F.sum((F.col(c) < low).cast("long")).alias("below"), F.sum((F.col(c) == low).cast("long")).alias("at_low"),
        F.sum(((F.col(c) == high) & F.lit(high > low)).cast("long")).alias("at_high"),
        F.collect_list(F.when((F.col(c) > low) & (F.col(c) < high), F.col(c))).alias("between"),
    ).alias(f"x{i}") for i, (c, (_, low, high)) in enumerate(around.items())]
    tasks = staged(df.groupBy(F.spark_partition_id().alias("task")).agg(*counted), "around")
    total = tasks.agg(*[F.sum(f"x{i}.{k}").alias(f"{k}{i}") for i in range(len(around)) for k in ("below", "at_low", "at_high")]).first()
    ends = [(c, n, total[f"below{i}"] or 0, total[f"at_low{i}"] or 0, total[f"at_high{i}"] or 0, float(low), float(high)) for i, (c, (n, low, high)) in enumerate(around.items())]
    known = spark.createDataFrame(ends, schema)  # one row a column
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"x{i}.between").alias("v")) for i, c in enumerate(around)]))
    inside = tasks.select(each.alias("e")).select("e.column_name", F.explode("e.v").alias("v")).groupBy("column_name", "v").agg(F.count("*").alias("c"))
    outer = [known.select("column_name", F.col(v).alias("v"), F.col(c).alias("c")) for v, c in (("low", "at_low"), ("high", "at_high"))]
    counts = staged(inside.unionByName(outer[0]).unionByName(outer[1]).where("c > 0"), "inside")
    placed = running_sums(counts, ["column_name"], "v", {"upto": "c"}).join(F.broadcast(known.select("column_name", "n", "below")), "column_name")
    rank, upto = (F.col("n") - 1) * F.lit(share), F.col("upto") + F.col("below")
    picked = [F.max(F.when((upto > r) & (upto - F.col("c") <= r), F.col("v"))).alias(name) for name, r in (("a", F.floor(rank)), ("b", F.ceil(rank)))]
    found = placed.groupBy("column_name").agg(*picked, F.max(rank - F.floor(rank)).alias("part"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b"))
    names = spark.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(found.select("column_name", value.alias("quantile")), "column_name", "left")
