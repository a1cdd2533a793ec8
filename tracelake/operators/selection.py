"""Order-dependent selection, keyed overlays and prefix checks."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.core import ship


def greedy_cards(cards: DataFrame, family: str, case: str, signature: str, order: str, limit: int) -> DataFrame:
    """Per family up to ``limit`` cards in order: one a case; once half is taken a signature only once; then
    what was passed over fills up.

    What can be chosen is bounded before the cards of a family meet, without changing the choice. A card behind
    another of its case and signature is never chosen before the filling up. Of the rest, a card that is chosen
    has only taken cases, or taken signatures, before it: fewer than ``limit`` of either, so it is among the first
    ``limit`` of its case and of its signature. The filling up takes from the first ``limit`` cards of the family.
    """
    ship(cards.sparkSession)
    cols = list(dict.fromkeys([family, case, signature, order]))
    by = [F.col(order).asc_nulls_last(), F.col(case).asc_nulls_last(), F.col(signature).asc_nulls_last()]

    def first(d: DataFrame, keys: list[str], n: int) -> DataFrame:
        return d.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("_n") <= n).drop("_n")

    narrow = cards.select(*cols)
    candidates = first(narrow, [family, case, signature], 1)
    candidates = first(first(candidates, [family, case], limit), [family, signature], limit)
    per = candidates.withColumn("_fill", F.lit(False)).unionByName(first(narrow, [family], limit).withColumn("_fill", F.lit(True)))

    def choose(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values([order, case, signature], kind="stable")
        taken, cases, signatures = [], set(), set()
        for row in d.loc[~d["_fill"], cols].itertuples(index=False, name=None):
            _, c, s, _ = row
            if len(taken) >= limit:
                break
            if c in cases or (len(taken) * 2 >= limit and s in signatures):
                continue
            taken.append(row)
            cases.add(c)
            signatures.add(s)
        chosen = Counter(taken)
        for row in d.loc[d["_fill"], cols].itertuples(index=False, name=None):
            if chosen[row]:
                chosen[row] -= 1
            elif len(taken) < limit:
                taken.append(row)
        out = pd.DataFrame(taken, columns=cols)
        out["slot"] = range(1, len(out) + 1)
        return out

    types = dict(cards.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (family, case, signature, order)) + ", slot int"
    return per.groupBy(family).applyInPandas(choose, schema)


def overlay(current: DataFrame, proposed: DataFrame, key: str, protected: list[str], mode: str) -> DataFrame:
    """Keyed merge of two versions of a table.

    ``mode`` is a column of ``current``: ``free`` rows take the proposal, ``shared`` rows take it but keep the
    protected columns, all other rows stay.  New keys of the proposal are added.
    """
    cols = [c for c in current.columns if c not in (key, mode)]
    p = proposed.select(key, *[F.col(c).alias(f"_p_{c}") for c in cols], F.lit(True).alias("_has"))
    j = current.withColumn("_cur", F.lit(True)).join(p, key, "full_outer")
    out = [key]
    for c in cols:
        take = F.col("_has") & (F.col("_cur").isNull() | (F.col(mode) == "free") | ((F.col(mode) == "shared") & F.lit(c not in protected)))
        out.append(F.when(take, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c))
    keep = F.col("_cur").isNotNull() & ((F.col(mode) != "free") | F.col("_has")) | F.col("_cur").isNull()
    return j.where(keep).select(*out)


def changed_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or changed rows between two versions."""
    fp = lambda d, n: d.select(key, F.sha2(F.to_json(F.struct(*sorted(c for c in d.columns if c != key))), 256).alias(n))
    j = fp(before, "_b").join(fp(after, "_a"), key, "full_outer")
    return j.select(key, F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").alias("change")).where("change is not null")


def prefix_compatible(calls: DataFrame, entity: list[str], order: str, text: str) -> DataFrame:
    """Whether each call's text starts with the text of the call before it."""
    prev = F.lag(text).over(Window.partitionBy(*entity).orderBy(order))
    return calls.withColumn("is_extension", prev.isNull() | F.startswith(F.col(text), prev))


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Fixed-size batches in a total order, with the position in the batch."""
    from tracelake.operators.joins import running_total

    n = running_total(df.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", "_n")
    return n.withColumn("batch", F.expr(f"(_n - 1) div {size}")).withColumn("position", (F.col("_n") - 1) % size).drop("_one", "_n")
