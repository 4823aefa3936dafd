"""What a repair did to the child rows of filings: equal rows, allowed changes, and what nothing explains.

Rows are compared as multisets. Of what differs, blank placeholders may go and missing values may be filled in. A row
and what it may have become agree in all other columns, which makes them one group; where just one kind of row meets one, the pair is
forced, and only groups in which several compete go to a flow, each by itself, so that no filing is taken whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.operators.sets import dealt
from filigree.operators.transport import max_flow


def _number(c: str) -> Column:
    return F.col(c).try_cast("double")


def _allowed(before: str, after: str) -> Column:
    """Equal, or missing before and a number after."""
    return F.col(before).eqNullSafe(F.col(after)) | (F.col(before).isNull() & _number(after).isNotNull())


def explained(source: DataFrame, repaired: DataFrame, columns: Sequence[str], *, filled: Sequence[str], amount: str | None = None) -> DataFrame:
    """By filing: rows of both sides and how many are equal, filled in with zero, filled in otherwise, placeholders gone, and left over on either side.

    source and repaired have filing_id and columns (text). filled names columns whose missing value may become a number. A source row
    that has nothing but an amount of zero is a placeholder, which may be gone. status is "equal", "explained", "unexplained", or, where the
    source holds the repaired rows a whole number of times, "replayed".
    """
    base = [c for c in columns if c not in filled]
    blank = F.lit(False)
    if amount:
        others = [c for c in columns if c != amount]
        blank = (F.coalesce(_number(amount) == 0, F.lit(False))) & (F.concat_ws("", *(F.trim(F.col(c)) for c in others)) == "")
    # rows that may have become each other agree in all but the filled columns; a null there is a value of its own. Their digest stands
    # for those columns from here on, fields told apart by their lengths, so texts aren't shuffled
    fields = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("n:")) for c in base]
    digest = F.unhex(F.sha2(F.concat(F.lit(""), *fields), 256))
    values = [F.col(c).alias(f"v{i}") for i, c in enumerate(filled)]
    names = [f"v{i}" for i in range(len(filled))]

    def side(df: DataFrame, s: int, r: int) -> DataFrame:
        return df.select("filing_id", digest.alias("base"), *values, blank.alias("blank"), F.lit(s).cast("long").alias("s"), F.lit(r).cast("long").alias("r"))

    # dealt once: all that follows, up to the sums by filing, groups by these keys or more
    rows = dealt(side(source, 1, 0).unionByName(side(repaired, 0, 1)), "filing_id", "base")
    both = rows.groupBy("filing_id", "base", *names, "blank").agg(F.sum("s").alias("s"), F.sum("r").alias("r"))
    over, new = F.greatest(F.col("s") - F.col("r"), F.lit(0).cast("long")), F.greatest(F.col("r") - F.col("s"), F.lit(0).cast("long"))
    both = both.withColumns({"gone": F.when(F.col("blank"), over).otherwise(F.lit(0).cast("long")), "new": new}).withColumn("over", over - F.col("gone"))
    ratio = F.when(F.col("r") > 0, F.try_divide(F.col("s"), F.col("r")))
    lacks, placed = F.col("over") > 0, F.col("new") > 0
    ends = F.struct(*names, F.lit(0).alias("nothing"))
    groups = both.groupBy("filing_id", "base").agg(
        F.sum("s").alias("n_source"), F.sum("r").alias("n_repaired"), F.sum(F.least("s", "r")).alias("n_equal"), F.min(ratio).alias("lo"), F.max(ratio).alias("hi"), F.min("r").alias("lr"),
        F.sum("gone").alias("gone"), F.sum("over").alias("over"), F.sum("new").alias("new"), F.count_if(lacks).alias("na"), F.count_if(placed).alias("nb"),
        F.max(F.when(lacks, ends)).alias("a"), F.max(F.when(placed, ends)).alias("b"),
    )
    ok, zero = F.lit(bool(filled)), F.lit(True)
    for n in names:
        ok = ok & _allowed(f"a.{n}", f"b.{n}")
        zero = zero & (F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) | (_number(f"b.{n}") == 0))
    forced, to_zero = (F.col("na") == 1) & (F.col("nb") == 1) & ok, F.coalesce(zero, F.lit(False))
    units, nothing = F.least("over", "new"), F.lit(0).cast("long")
    sums = ["n_source", "n_repaired", "n_equal", "lo", "hi", "lr", "gone", "over", "new"]
    settled_groups = groups.select("filing_id", *sums, F.when(forced & to_zero, units).otherwise(nothing).alias("n_to_zero"), F.when(forced & ~to_zero, units).otherwise(nothing).alias("n_to_number"))
    kind = source.schema["filing_id"].dataType.simpleString()
    at = range(len(names))

    def flow(pdf: pd.DataFrame) -> pd.DataFrame:
        """Units that can be filled in with zero alone, then those that any filling can place; both are greatest."""
        a, b = pdf[pdf["over"] > 0].to_dict("records"), pdf[pdf["new"] > 0].to_dict("records")
        supply, demand = [int(x["over"]) for x in a], [int(x["new"]) for x in b]

        def equal(x: dict, y: dict, i: int) -> bool:
            return x[f"null{i}"] and y[f"null{i}"] or (not x[f"null{i}"] and not y[f"null{i}"] and x[f"v{i}"] == y[f"v{i}"])

        def most(fits: Callable[[dict, dict, int], bool]) -> int:
            return max_flow(supply, demand, {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if all(fits(x, y, k) for k in at)})

        zeros = most(lambda x, y, i: equal(x, y, i) or (x[f"null{i}"] and y[f"zero{i}"]))
        every = most(lambda x, y, i: equal(x, y, i) or (x[f"null{i}"] and y[f"number{i}"]))
        return pd.DataFrame([(pdf["filing_id"].iloc[0], zeros, every - zeros)], columns=["filing_id", "n_to_zero", "n_to_number"])

    moved = settled_groups
    if filled:
        group = Window.partitionBy("filing_id", "base")
        rivals = both.where(lacks | placed).withColumns({"na": F.count_if(lacks).over(group), "nb": F.count_if(placed).over(group)}).where("na > 0 and nb > 0 and na + nb > 2")
        said = [c for i, n in enumerate(names) for c in (F.col(n), F.col(n).isNull().alias(f"null{i}"), _number(n).isNotNull().alias(f"number{i}"), F.coalesce(_number(n) == 0, F.lit(False)).alias(f"zero{i}"))]
        contested = rivals.select("filing_id", "base", "over", "new", *said).groupBy("filing_id", "base").applyInPandas(flow, f"filing_id {kind}, n_to_zero long, n_to_number long")
        moved = settled_groups.unionByName(contested, allowMissingColumns=True)
    ends_of = {"lo": F.min("lo"), "hi": F.max("hi"), "lr": F.min("lr")}
    out = moved.groupBy("filing_id").agg(*(ends_of.get(c, F.sum(c)).alias(c) for c in (*sums, "n_to_zero", "n_to_number"))).withColumnRenamed("gone", "n_placeholders")
    out = out.withColumns({"left_source": F.col("over") - F.col("n_to_zero") - F.col("n_to_number"), "left_repaired": F.col("new") - F.col("n_to_zero") - F.col("n_to_number")})
    times = F.when((F.col("lr") > 0) & (F.col("lo") == F.col("hi")) & (F.col("lo") > 1) & (F.col("lo") == F.floor("lo")), F.col("lo").cast("int"))
    none = (F.col("left_source") == 0) & (F.col("left_repaired") == 0)
    status = F.when((F.col("n_source") == F.col("n_equal")) & (F.col("n_repaired") == F.col("n_equal")), "equal").when(times.isNotNull(), "replayed").when(none, "explained").otherwise("unexplained")
    return out.select("filing_id", "n_source", "n_repaired", "n_equal", "n_to_zero", "n_to_number", "n_placeholders", "left_source", "left_repaired", times.alias("replay_factor"), status.alias("status"))
