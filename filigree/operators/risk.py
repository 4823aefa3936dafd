"""Risk indicators and the score made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points by severity, bonus and caps; categories that carry no points.
POINTS = {"High": 20, "Medium": 9, "Low": 3}
RECURRENCE_MOST, CATEGORY_MOST, SCORE_MOST = 8, 30, 100
UNSCORED = ("Data Quality", "Disclosure Context", "External Coverage", "External Lead")


def indicator(df: DataFrame, condition: Column, severity: Column | str, category: str, title: str) -> DataFrame:
    """Rows that meet a condition, in the schema that all indicator families share."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.where(condition).select("ein", "tax_year", level.alias("severity"), F.lit(category).alias("category"), F.lit(title).alias("title"))


def financial(years: DataFrame) -> DataFrame:
    """years: ein, tax_year, revenue, expenses, net_assets, assets, liabilities, employees, grants_paid, lobbying.

    Private foundations, where years has private_foundation, may have no employees and mostly make grants.
    """
    operating = ~F.coalesce("private_foundation", F.lit(False)) if "private_foundation" in years.columns else F.lit(True)
    net = F.col("revenue") - F.col("expenses")
    deficit = F.abs(net) / F.greatest("revenue", "expenses", F.lit(1.0))
    debt = F.try_divide("liabilities", "assets")

    def part(c: str) -> Column:
        return F.coalesce(F.try_divide(c, "expenses"), F.lit(0.0))

    families = (
        indicator(years, net < 0, F.when(deficit >= 0.25, "High").otherwise("Medium"), "Financial", "Operating deficit"),
        indicator(years, F.col("net_assets") < 0, "High", "Financial", "Negative net assets"),
        indicator(years, (F.col("net_assets") >= 0) & (debt >= 0.8), "Medium", "Financial", "High liability-to-asset ratio"),
        indicator(years, (F.col("expenses") >= 500_000) & (F.col("employees") == 0) & operating, "Medium", "Operations", "High expenses with zero employees"),
        indicator(years, (part("grants_paid") >= 0.75) & operating, "Medium", "Grants", "Grants dominate expenses"),
        indicator(years, part("lobbying") >= 0.05, F.when(part("lobbying") >= 0.2, "High").otherwise("Medium"), "Political", "Material lobbying expense"),
    )
    return reduce(DataFrame.unionByName, families)


def share_indicators(shares: DataFrame, *, total: float, single: float, category: str, titles: tuple[str, str]) -> DataFrame:
    """shares: ein, tax_year, total_share, largest_share, n_parts. A large total, and one large part of several."""
    return indicator(shares, F.col("total_share") >= total, "Medium", category, titles[0]).unionByName(
        indicator(shares, (F.col("largest_share") >= single) & (F.col("n_parts") > 1), "Low", category, titles[1])
    )


def score(indicators: DataFrame) -> DataFrame:
    """ein and risk_score: the strongest weight of each title and a bonus when it recurs, capped by category and in all.

    The bonus is one point, for a high severity two, for each further occurrence.
    """
    points = F.create_map(*(F.lit(x) for kv in POINTS.items() for x in kv))
    scored = indicators.where(~F.col("category").isin(*UNSCORED)).withColumn("weight", points[F.col("severity")])
    titles = scored.groupBy("ein", "category", "title").agg(F.max("weight").alias("strongest"), F.count("*").alias("n"))
    bonus = F.least(F.lit(RECURRENCE_MOST).cast("long"), (F.col("n") - 1) * F.when(F.col("strongest") == POINTS["High"], 2).otherwise(1))
    categories = titles.groupBy("ein", "category").agg(F.least(F.lit(CATEGORY_MOST), F.sum(F.col("strongest") + bonus)).alias("points"))
    return categories.groupBy("ein").agg(F.least(F.lit(SCORE_MOST), F.sum("points")).cast("long").alias("risk_score"))


def audit_threshold(fiscal_start: Column) -> Column:
    """Federal spending from which an audit is due; null where the start isn't known."""
    return F.when(fiscal_start >= F.lit("2024-10-01").cast("date"), 1_000_000).when(fiscal_start.isNotNull(), 750_000)
