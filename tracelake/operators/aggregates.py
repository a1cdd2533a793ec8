"""Aggregates: exact order statistics, distributions, consensus, paired outcomes and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_statistics(df: DataFrame, group: list[str], value: str, indexes: dict[str, str]) -> DataFrame:
    """Exact values at 0-based sorted positions, given as SQL over ``n`` (the group's row count).

    Works on the counts of distinct values, so that a group's rows are never gathered in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*group).orderBy(value)
    cum = counts.withColumn("_upto", F.sum("_c").over(w)).withColumn("n", F.sum("_c").over(Window.partitionBy(*group)))
    picks = [F.min(F.when(F.col("_upto") > F.expr(e), F.col(value))).alias(name) for name, e in indexes.items()]
    return cum.groupBy(*group).agg(F.max("n").alias("n"), *picks, F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.sum(F.col(value) * F.col("_c")).alias("total"))


def quantiles_upper(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Upper index: sorted[min(n - 1, int(n * p / 100))]."""
    return order_statistics(df, group, value, {f"p{p}": f"least(n - 1, n * {p} div 100)" for p in (50, 90, 99)})


def quantiles_lower(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Lower index: sorted[(n - 1) * p // 100]."""
    return order_statistics(df, group, value, {f"p{p}": f"(n - 1) * {p} div 100" for p in (50, 90, 99)})


def quantiles_linear(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Linear interpolation, exact."""
    return df.groupBy(*group).agg(*[F.percentile(value, p / 100).alias(f"p{p}") for p in (50, 90, 99)], F.count(value).alias("n"))


def distribution(df: DataFrame, col: str, total: Column | None = None) -> DataFrame:
    """Count and percentage of each value, against all rows or a given denominator."""
    c = df.groupBy(col).agg(F.count("*").alias("n"))
    if total is None:
        t = df.agg(F.count("*").alias("_t"))
        return c.crossJoin(t).select(col, "n", F.round(100 * F.col("n") / F.col("_t"), 6).alias("pct"))  # one row
    return c.select(col, "n", F.round(100 * F.col("n") / total, 6).alias("pct"))


def multilabel_distribution(df: DataFrame, entity: str, labels: str) -> DataFrame:
    """Entities per label, each once however often it has the label; percentages sum to over 100."""
    t = df.agg(F.count_distinct(entity).alias("_t"))
    e = df.select(entity, F.explode(F.array_distinct(labels)).alias("label")).distinct()
    return e.groupBy("label").agg(F.count("*").alias("n")).crossJoin(t).select("label", "n", F.round(100 * F.col("n") / F.col("_t"), 6).alias("pct"))


def coverage(records: DataFrame, dim: DataFrame, record: str, item: str) -> DataFrame:
    """Per dimension member: records that hold it, their share and all occurrences; absent members with 0."""
    t = records.agg(F.count_distinct(record).alias("_t"))
    c = records.groupBy(item).agg(F.count_distinct(record).alias("n_records"), F.count("*").alias("n_calls"))
    return (
        dim.join(c, item, "left").crossJoin(t)
        .select(item, F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.round(100 * F.coalesce("n_records", F.lit(0)) / F.col("_t"), 4).alias("pct"))
    )


def binned(value: Column, edges: list[int]) -> Column:
    """Labels of closed bins: 0, 1-5, 6-10, ..., last+ (edges are the upper ends)."""
    out, lo = None, 0
    for hi in edges:
        label = str(hi) if lo == hi else f"{lo}-{hi}"
        out = F.when(value <= hi, label) if out is None else out.when(value <= hi, label)
        lo = hi + 1
    return out.otherwise(f"{lo}+")


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p of b against c discordant pairs; 1 without any.

    Runs over log-binomials inside the JVM: the number of steps is min(b, c) + 1.
    """
    n, k = b + c, F.least(b, c)
    steps = F.transform(F.sequence(F.lit(0), k.cast("int")), lambda i: i.cast("double"))
    # log C(n, i) accumulates from the one before, then tail = sum exp(logC - n log 2)
    acc = F.aggregate(
        steps,
        F.struct(F.lit(0.0).alias("lc"), F.lit(0.0).alias("tail")),
        lambda a, i: F.struct(
            (a["lc"] + F.when(i > 0, F.log(n - i + 1) - F.log(i)).otherwise(0.0)).alias("lc"),
            (a["tail"] + F.exp(a["lc"] + F.when(i > 0, F.log(n - i + 1) - F.log(i)).otherwise(0.0) - n * F.log(F.lit(2.0)))).alias("tail"),
        ),
        lambda a: a["tail"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * acc))


def holm(df: DataFrame, family: list[str], p: str, tie: str) -> DataFrame:
    """Holm step-down: running maximum of min(1, (m - i) p) in ascending order of p.

    One row a test, so a family is as small as the number of comparisons made.
    """
    w = Window.partitionBy(*family).orderBy(p, tie) if family else Window.orderBy(p, tie)
    m = F.count("*").over(Window.partitionBy(*family) if family else Window.partitionBy())
    scaled = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("_s", scaled).withColumn("p_holm", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def paired_outcomes(df: DataFrame, group: list[str], before: str, after: str) -> DataFrame:
    """2x2 table of two verdicts per item; items with only one verdict do not count."""
    d = df.where(F.col(before).isNotNull() & F.col(after).isNotNull())
    return d.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(before)).alias("passes_before"),
        F.count_if(F.col(after)).alias("passes_after"),
        F.count_if(~F.col(before) & F.col(after)).alias("gains"),
        F.count_if(F.col(before) & ~F.col(after)).alias("losses"),
    )


def vote_consensus(votes: DataFrame, item: list[str], voter: str, state: str, position: str) -> DataFrame:
    """States with a majority (at least n // 2 + 1 of the item's voters) at their upper median position."""
    n = votes.groupBy(*item).agg(F.count_distinct(voter).alias("n_voters"))
    per = votes.groupBy(*item, state, voter).agg(F.min(position).alias("_p"))
    stats = order_statistics(per, [*item, state], "_p", {"position": "n div 2"}).withColumnRenamed("n", "n_votes")
    return stats.join(n, item).where("n_votes >= n_voters div 2 + 1").select(*item, state, "n_votes", "n_voters", "position")


def label_consensus(votes: DataFrame, item: list[str], label: str, severity: dict[str, int]) -> DataFrame:
    """Most frequent label; ties go to the more severe one."""
    sev = F.create_map(*[F.lit(x) for kv in severity.items() for x in kv])
    c = votes.where(F.col(label).isNotNull()).groupBy(*item, label).agg(F.count("*").alias("_n"))
    best = F.max_by(label, F.struct("_n", F.coalesce(sev[F.col(label)], F.lit(-1)), label))
    return c.groupBy(*item).agg(best.alias("consensus"), F.max("_n").alias("n_for"), F.sum("_n").alias("n_votes"))


def precision_recall(df: DataFrame, sets: list[list[str]], truth: str, predicted: str) -> DataFrame:
    """Micro precision and recall per grouping set; an empty denominator gives 1."""
    cols = sorted({c for s in sets for c in s})
    out = None
    base = df.groupBy(*cols).agg(
        F.count_if(F.col(truth) & F.col(predicted)).alias("tp"), F.count_if(~F.col(truth) & F.col(predicted)).alias("fp"), F.count_if(F.col(truth) & ~F.col(predicted)).alias("fn")
    )
    for s in sets:  # over the small aggregate, so the rows are read once
        g = base.groupBy(*s).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
        g = g.select(*[(F.col(c) if c in s else F.lit(None).cast(dict(df.dtypes)[c])).alias(c) for c in cols], F.lit(",".join(s)).alias("level"), "tp", "fp", "fn")
        out = g if out is None else out.unionByName(g)
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(1.0)), 6)
    return out.withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))


def cofire(df: DataFrame, unit: list[str], state: str, edges: DataFrame | None = None) -> DataFrame:
    """Pairs of states that hold in the same unit, and whether one depends on the other.

    The pairs come from the distinct states of a unit, of which there are as many as the graph has.
    """
    s = df.select(*unit, state).distinct().groupBy(*unit).agg(F.array_sort(F.collect_set(state)).alias("_s")).where(F.size("_s") >= 2)
    pair = F.explode(F.flatten(F.transform("_s", lambda a, i: F.transform(F.slice("_s", i + 2, F.size("_s")), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    p = s.select(pair.alias("p")).groupBy(F.col("p.a").alias("state_a"), F.col("p.b").alias("state_b")).agg(F.count("*").alias("n_units"))
    if edges is None:
        return p
    e = edges.select(F.least("child", "parent").alias("state_a"), F.greatest("child", "parent").alias("state_b")).distinct().withColumn("is_dependent", F.lit(True))
    return p.join(e, ["state_a", "state_b"], "left").withColumn("is_dependent", F.coalesce("is_dependent", F.lit(False)))
