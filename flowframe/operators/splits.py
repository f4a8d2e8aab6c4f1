"""Group-integrity splits: seeded greedy selection, a search over attempts, assignment and leakage checks.

Works on one row per group, never on the rows themselves until the chosen split is joined to them. The greedy selection
takes, in the order of a seeded hash, every group that brings the number of rows closer to the target. For all attempts at
once, one aggregation counts rows by attempt and range of the hash. A range is taken whole while the target is not
reached; one whose smallest group does not help is passed over; only the others, about one an attempt, are opened and
walked group by group. What an attempt takes is a few stretches of its order, so groups times attempts exist as rows in
flight only, and nothing of that size is shuffled or stored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowframe.functions.hashing import SPLITS, VALIDATION_SHARE
from flowframe.sources.staging import staged

#: Distance of the attempts' seeds, and weights of the score.
SEED_STEP = 104729
FRACTION_WEIGHT, MISSING_WEIGHT = 4.0, 0.25
#: Groups of all attempts that are walked at once, about, and hex digits of a range at most.
OPENED, MOST_DIGITS = 1 << 18, 3
#: Ranges of an attempt that are opened in one round.
ROUND = 16

_STRETCH = "attempt int, first string, last string, n_rows long, n_groups long, n_refused long"


def helps(at: int, n: int, target: float) -> bool:
    """Whether ``n`` more rows bring ``at`` closer to the target; the first group always does."""
    return at == 0 or abs(at - target) > abs(at + n - target)


@dataclass
class Walk:
    """An attempt's way through the ranges of its order: ``ranges`` has (range, rows, rows of the smallest group, groups)."""

    ranges: list[tuple[int, int, int, int]]
    at: int = 0
    place: int = 0
    refused: int = 0
    stretches: list[tuple[str, str]] = field(default_factory=list)

    def wanted(self, target: float, digits: int) -> list[int]:
        """Takes and passes over what can be decided by whole ranges; the places of the ranges to open next."""
        several = sum(r[3] for r in self.ranges) > 1
        while self.place < len(self.ranges):
            number, n, least, groups = self.ranges[self.place]
            last = several and not self.refused and self.place == len(self.ranges) - 1  # if all is taken, one group is not
            if self.at and self.at + n <= target and not last:
                prefix = f"{number:0{digits}x}"
                self.stretches.append((prefix, prefix + "g"))
                self.at += n
            elif helps(self.at, least, target) or last:
                later = [k for k in range(self.place + 1, len(self.ranges)) if helps(self.at, self.ranges[k][2], target)]
                return [self.place, *later[: ROUND - 1]]
            else:
                self.refused += groups
            self.place += 1
        return []

    def opened(self, places: list[int], found: list) -> None:
        """Goes on behind ranges that were walked group by group."""
        for r in found:
            self.refused += r["n_refused"]
            self.at += r["n_rows"]
            if r["first"] is not None:
                self.stretches.append((r["first"], r["last"]))
        self.refused += sum(self.ranges[k][3] for k in range(self.place, places[-1]) if k not in places)
        self.place = places[-1] + 1


def _walked(target: float):
    """Walks the groups of an attempt in order: the stretches taken, and a row for what was refused."""
    def run(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values("h", kind="stable")
        at, several, out, taken = int(groups["at"].iloc[0]), bool(groups["several"].iloc[0]), [], []
        attempt, refused, open_ = int(groups["attempt"].iloc[0]), 0, None
        for h, n, number in zip(groups["h"].tolist(), groups["n_rows"].tolist(), groups["range"].tolist(), strict=True):
            if helps(at, n, target):
                at += n
                taken.append((h, n))
                if open_ == number:  # ranges between two that are opened may hold groups that were passed over
                    out[-1][2], out[-1][3], out[-1][4] = h, out[-1][3] + n, out[-1][4] + 1
                else:
                    out.append([attempt, h, h, n, 1, 0])
                open_ = number
            else:
                refused, open_ = refused + 1, None
        if several and not refused and taken:  # all groups of the attempt would be taken
            if out[-1][4] == 1:
                out.pop()
            else:
                out[-1][2], out[-1][3], out[-1][4] = taken[-2][0], out[-1][3] - taken[-1][1], out[-1][4] - 1
            refused = 1
        out.append([attempt, None, None, 0, 0, refused])
        return pd.DataFrame(out, columns=["attempt", "first", "last", "n_rows", "n_groups", "n_refused"])

    return run


def _range(h: Column, digits: int) -> Column:
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int") if digits else F.lit(0)


def _digits(groups: int) -> int:
    """Hex digits of a range, so that one range of all attempts has about OPENED groups."""
    return next((d for d in range(MOST_DIGITS) if groups <= OPENED * 16**d), MOST_DIGITS)


def stretches(pool: DataFrame, target: float, digits: int | None = None) -> dict[int, list[tuple[str, str]]]:
    """For each attempt the stretches of its order, from hash to hash, that the greedy selection takes.

    ``pool`` has attempt, n_rows (1 at least) and h, the hash that orders an attempt's groups. A walk has as many
    stretches as it meets refused groups between taken ones: at most the root of half its rows, in practice a few.
    """
    spark = pool.sparkSession
    digits = _digits(pool.count()) if digits is None else digits
    dealt = pool.select("attempt", "h", "n_rows", _range(F.col("h"), digits).alias("range"))
    cells = dealt.groupBy("attempt", "range").agg(F.sum("n_rows").alias("n"), F.min("n_rows").alias("least"), F.count("*").alias("groups"))
    walks: dict[int, Walk] = {}
    for r in sorted(cells.collect(), key=lambda r: (r["attempt"], r["range"])):  # attempts x 16**digits rows at most
        walks.setdefault(r["attempt"], Walk([])).ranges.append((r["range"], r["n"], r["least"], r["groups"]))
    while asked := {a: places for a, w in walks.items() if (places := w.wanted(target, digits))}:
        rows = []
        for a, places in asked.items():
            w = walks[a]
            rest = list(range(w.place, len(w.ranges)))
            several = not w.refused and places == rest and sum(r[3] for r in w.ranges) > 1
            rows += [(a, w.ranges[k][0], w.at, several) for k in places]
        few = dealt.join(F.broadcast(spark.createDataFrame(rows, "attempt int, range int, at long, several boolean")), ["attempt", "range"])  # ROUND rows an attempt
        found: dict[int, list] = {a: [] for a in asked}
        for r in few.groupBy("attempt").applyInPandas(_walked(target), _STRETCH).collect():  # stretches
            found[r["attempt"]].append(r)
        for a, places in asked.items():
            walks[a].opened(places, found[a])
    return {a: w.stretches for a, w in walks.items()}


def _taken(pool: DataFrame, chosen: dict[int, list[tuple[str, str]]], name: str) -> DataFrame:
    """``pool`` with a column that says whether the attempt takes the group."""
    rows = [(a, [(x, y) for x, y in runs]) for a, runs in chosen.items()]
    table = pool.sparkSession.createDataFrame(rows, f"attempt int, {name} array<struct<first:string,last:string>>")
    marked = pool.join(F.broadcast(table), "attempt", "left")  # a row an attempt
    return marked.withColumn(name, F.coalesce(F.exists(name, lambda s: (F.col("h") >= s["first"]) & (F.col("h") <= s["last"])), F.lit(False)))


def greedy(pool: DataFrame, target: float, digits: int | None = None) -> DataFrame:
    """``attempt, group_id, n_rows, h`` of the groups taken: each that brings the attempt's rows closer to ``target``.

    The first group is always taken; where all would be, the last of several is not.
    """
    return _taken(pool, stretches(pool, target, digits), "taken").where("taken").select("attempt", "group_id", "n_rows", "h")


def group_table(grouped: DataFrame) -> DataFrame:
    """``group_id, n_rows, cells``: a row for each group, with the rows of each label (null ones too)."""
    cells = grouped.groupBy("group_id", "label").agg(F.count("*").alias("n"))
    return cells.groupBy("group_id").agg(F.sum("n").alias("n_rows"), F.collect_list(F.struct("label", "n")).alias("cells"))


def assigned_groups(table: DataFrame, attempts: int, seed: int, outer: float, validation_share: float = VALIDATION_SHARE, digits: int | None = None) -> DataFrame:
    """Every group of ``table`` for every attempt with its ``split`` and the hash ``h`` that decided it.

    ``table`` has group_id and n_rows; groups without rows are left out. The result is made anew from the groups each
    time it is read.
    """
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small table, of which every pass makes attempts times as many rows; dealt by group_id alone it would be coalesced
    table = staged(table.where("n_rows > 0").withColumn("n_rows", F.col("n_rows").cast("long")).repartition(parts, F.xxhash64("group_id")), "groups")
    total, groups = table.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.count("*")).first()
    digits = _digits(groups * attempts) if digits is None else digits
    each = table.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    own = F.lit(seed) + F.col("attempt") * SEED_STEP
    drawn = lambda rows, seed: rows.withColumn("h", F.sha2(F.concat_ws(":", seed.cast("string"), "group_id"), 256))
    pool = drawn(each, own)
    test = _taken(pool, stretches(pool, total * (1.0 - outer), digits), "in_test").withColumn("test_h", F.col("h"))
    rest = drawn(test, own + 1)
    validation = stretches(rest.where("not in_test"), total * (outer * validation_share), digits)
    both = _taken(rest, validation, "in_validation")
    split = F.when(F.col("in_test"), "test").when(F.col("in_validation"), "validation").otherwise("train")
    return both.withColumns({"split": split, "h": F.when(F.col("in_test"), F.col("test_h")).otherwise(F.col("h"))}).drop("in_test", "in_validation", "test_h")


def attempts_table(sizes: DataFrame, attempts: int, seed: int, outer: float, validation_share: float = VALIDATION_SHARE, digits: int | None = None) -> DataFrame:
    """``attempt, group_id, n_rows, h, split``: the groups that each attempt takes for test and for validation."""
    every = assigned_groups(sizes.select("group_id", "n_rows"), attempts, seed, outer, validation_share, digits)
    return every.where("split <> 'train'").select("attempt", "group_id", "n_rows", "h", "split")


def attempt_groups(chosen: DataFrame, sizes: DataFrame, attempts: int) -> DataFrame:
    """``attempt, group_id, split`` for every group."""
    every = sizes.select("group_id").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    taken = chosen.select("attempt", "group_id", "split")
    return every.join(taken, ["attempt", "group_id"], "left").select("attempt", "group_id", F.coalesce("split", F.lit("train")).alias("split"))


def in_two_splits(rows: DataFrame) -> DataFrame:
    """``group_id, n_splits`` of groups whose rows are not all in one split."""
    return rows.groupBy("group_id").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def scores(grouped: DataFrame, assigned: DataFrame, outer: float, validation_share: float = VALIDATION_SHARE) -> DataFrame:
    """``attempt, score``: distance from the target fractions and from the overall label distribution; less is better.

    ``grouped`` has group_id and label; null labels count as rows, not as labels. Where ``assigned`` has the ``cells`` of
    its groups, labels are summed by attempt without a join.
    """
    cells = grouped.groupBy("group_id", "label").agg(F.count("*").alias("n"))
    if "cells" in assigned.columns:
        each = assigned.select("attempt", "split", F.inline("cells"))
        cells = grouped.groupBy("label").agg(F.count("*").alias("n"))
    else:
        each = assigned.join(cells, "group_id")
    counts = staged(each.groupBy("attempt", "split", "label").agg(F.sum("n").alias("n")), "label_counts")  # attempts x splits x labels
    overall = cells.where("label is not null").groupBy("label").agg(F.sum("n").alias("all_n"))
    whole = overall.agg(F.sum("all_n").alias("labelled")).crossJoin(cells.agg(F.sum("n").alias("total")))  # one row each
    share = F.create_map(*[x for s, v in zip(SPLITS, (outer * (1 - validation_share), outer * validation_share, 1.0 - outer), strict=True) for x in (F.lit(s), F.lit(v))])
    per_split = counts.groupBy("attempt", "split").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("label").isNotNull(), F.col("n"))).alias("known"))
    names = counts.select("attempt").distinct().withColumn("split", F.explode(F.array(*[F.lit(s) for s in SPLITS])))
    frame = names.join(per_split, ["attempt", "split"], "left").crossJoin(F.broadcast(whole))
    fraction = FRACTION_WEIGHT * F.abs(F.coalesce("rows", F.lit(0)) / F.col("total") - share[F.col("split")])
    labels = frame.crossJoin(F.broadcast(overall)).join(counts, ["attempt", "split", "label"], "left")  # labels x splits x attempts
    off = F.abs(F.col("all_n") / F.col("labelled") - F.coalesce(F.col("n") / F.col("known"), F.lit(0.0)))
    by_label = labels.groupBy("attempt", "split").agg((F.avg(off) + MISSING_WEIGHT * F.sum(F.col("n").isNull().cast("int"))).alias("label_part"), F.first(fraction).alias("fraction_part"))
    return by_label.groupBy("attempt").agg(F.round(F.sum(F.col("label_part") + F.col("fraction_part")), 9).alias("score"))


def best_attempt(score_table: DataFrame) -> DataFrame:
    """The attempt with the lowest score, the first of equal ones."""
    return score_table.agg(F.min(F.struct("score", "attempt")).alias("best")).select("best.attempt", "best.score")


def assign(rows: DataFrame, assigned: DataFrame, best: DataFrame) -> DataFrame:
    """The rows with the split of their group in the best attempt."""
    return rows.join(assigned.join(F.broadcast(best.select("attempt")), "attempt").drop("attempt"), "group_id")


def leakage(rows: DataFrame, key: str) -> DataFrame:
    """``pair, shared``: keys that two splits share, for each pair of splits."""
    held = rows.groupBy(key).agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS])
    pairs = [("train_validation", "train", "validation"), ("train_test", "train", "test"), ("validation_test", "validation", "test")]
    counted = held.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(p) for p, a, b in pairs])
    return counted.select(F.explode(F.create_map(*[x for p, _, _ in pairs for x in (F.lit(p), F.col(p))])).alias("pair", "shared"))
