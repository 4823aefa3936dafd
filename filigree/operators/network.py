"""Relationship edges, node statistics and hubs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.functions.text import edge_id, network_name
from filigree.operators.sets import dealt

#: More organisations than this make a target a hub.
HUB_OVER = {"person": 25, "address": 50, "contractor": 50}


def edge(*, kind: str | Column, source: str | Column, row_id: Column, target: Column, confidence: Column, scored: Column) -> Column:
    """The edge of a row (ein, tax_year), with an id that follows from its contents."""
    kind, source = (c if isinstance(c, Column) else F.lit(c) for c in (kind, source))
    return F.struct(
        edge_id(source, row_id, kind, F.col("ein"), target).alias("edge_id"), kind.alias("edge_type"), F.col("ein").alias("source_ein"),
        target.alias("target_key"), F.col("tax_year"), confidence.alias("confidence"), scored.alias("scored"),
    )


def edges_of(rows: DataFrame, *made: Column) -> DataFrame:
    """All edges with a target that each row makes, from one pass over rows, whose joins and shuffles so happen once."""
    return rows.select(F.inline(F.array(*made))).where("target_key is not null")


def edges(rows: DataFrame, **about: str | Column) -> DataFrame:
    """Edges of one source table; see edge."""
    return edges_of(rows, edge(**about))


def address_key(*parts: Column) -> Column:
    return F.concat(F.lit("address:"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))


def person_key(name: Column) -> Column:
    return F.concat(F.lit("person:"), network_name(name))


def person_scored(normal: Column) -> Column:
    """A name of five letters and two words or more can tell people apart."""
    return (F.length(normal) >= 5) & (F.size(F.split(normal, " ")) >= 2)


# Names that name nobody, and which of the six related-organisation tables count when the number is exact.
NOBODY = ("", "N A", "NA", "NONE", "UNKNOWN", "VARIOUS", "SEE SCHEDULE")
RELATED_TABLES = (
    ("schedule_r_related_tax_exempt", True), ("schedule_r_related_taxable_corp_trust", True), ("schedule_r_related_taxable_partnership", True),
    ("schedule_r_unrelated_taxable_partnership", False), ("schedule_r_disregarded_entity", False), ("schedule_r_related_transaction", False),
)


#: Least confidence of a grant that counts, and the sources that count whatever the first match said.
GRANT_CONFIDENCE = 0.85
SCOREABLE_SOURCES = ("ai_assisted", "reported_ein_address_location", "reported_ein_identity_lookup", "reported_ein_rule")


def grant_edges(rows: DataFrame, *, source: str, row_id: Column) -> DataFrame:
    """Edges to recipients of grants (ein, tax_year, recipient_ein, recipient_name, confidence, match_status, match_source).

    A recipient without a number is known by its name, which never counts; one with a number counts if sure enough and its match is safe.
    """
    number, name = F.regexp_replace(F.coalesce(F.col("recipient_ein").cast("string"), F.lit("")), "[^0-9]", ""), network_name(F.col("recipient_name"))
    target = F.when(F.length(number) == 9, F.concat(F.lit("ein:"), number)).when(name != "", F.concat(F.lit("orgname:"), name))
    status, matched = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("match_status", "match_source"))
    safe = (status != "") & ~status.contains("unresolved") & ~status.contains("conflict")
    gate = F.when(matched == "deterministic", safe).otherwise(matched.isin(*SCOREABLE_SOURCES))
    sure = F.coalesce("confidence", F.lit(0.0))
    return edges(rows, kind="grant_paid", source=source, row_id=row_id, target=target, confidence=sure, scored=(F.length(number) == 9) & (sure >= GRANT_CONFIDENCE) & gate)


def person_edge(name: Column, *, source: str, row_id: Column) -> Column:
    """The edge to a person, whose name is in network_name's form: a telling full name counts, others are kept apart."""
    strong = person_scored(name) & ~name.isin(*NOBODY, "NOT APPLICABLE")
    return edge(kind="person_role", source=source, row_id=row_id, target=F.when(name != "", F.concat(F.lit("person:"), name)), confidence=F.when(strong, 0.90).otherwise(0.55), scored=strong)


def person_edges(rows: DataFrame, *, source: str, row_id: Column) -> DataFrame:
    """Edges to persons of a table of people (ein, tax_year, name)."""
    return edges_of(rows.withColumn("__n", network_name(F.col("name"))), person_edge(F.col("__n"), source=source, row_id=row_id))


def contractor_edge(name: Column, *, source: str, row_id: Column) -> Column:
    """The edge to a contractor, whose name is in network_name's form."""
    strong = (F.length(name) >= 4) & ~name.isin(*NOBODY)
    return edge(kind="contractor_payment", source=source, row_id=row_id, target=F.when(name != "", F.concat(F.lit("contractor:"), name)), confidence=F.when(strong, 0.88).otherwise(0.50), scored=strong)


def contractor_edges(rows: DataFrame, *, source: str, row_id: Column) -> DataFrame:
    """Edges to contractors (ein, tax_year, name)."""
    return edges_of(rows.withColumn("__n", network_name(F.col("name"))), contractor_edge(F.col("__n"), source=source, row_id=row_id))


def related_parts(number: str = "related_ein", names: Sequence[str] = ("name1", "name2")) -> tuple[Column, Column]:
    """A related organisation's number, digits only, and its name in network_name's form."""
    return F.regexp_replace(F.coalesce(F.col(number).cast("string"), F.lit("")), "[^0-9]", ""), network_name(F.concat_ws(" ", *(F.nullif(F.trim(c), F.lit("")) for c in names)))


def related_edge(number: Column, name: Column, *, kind: str | Column, counts: bool | Column, source: str | Column, row_id: Column) -> Column:
    """The edge to a related organisation: by number, else by name, which never counts."""
    exact = F.length(number) == 9
    target = F.when(exact, F.concat(F.lit("ein:"), number)).when(name != "", F.concat(F.lit("schedr-name:"), name))
    return edge(kind=kind, source=source, row_id=row_id, target=target, confidence=F.when(exact, 1.0).otherwise(0.60), scored=exact & (counts if isinstance(counts, Column) else F.lit(counts)))


def related_edges(rows: DataFrame, *, kind: str, counts: bool, source: str, row_id: Column) -> DataFrame:
    """Edges to related organisations (ein, tax_year, related_ein, name1, name2)."""
    number, name = related_parts()
    return edges_of(rows.withColumns({"__e": number, "__n": name}), related_edge(F.col("__e"), F.col("__n"), kind=kind, counts=counts, source=source, row_id=row_id))


def integrity_faults(all_edges: DataFrame) -> DataFrame:
    """(fault, edge_id) of edges that a finished graph may not hold; an empty result is a pass."""
    checks = {
        "repeated edge": F.col("__n") > 1, "no source": F.col("source_ein").isNull(), "confidence outside 0 to 1": ~F.col("confidence").between(0, 1) | F.col("confidence").isNull(),
        "number of other than nine digits": F.col("target_key").startswith("ein:") & ~F.col("target_key").rlike("^ein:[0-9]{9}$"), "name only, yet scored": F.col("target_key").startswith("schedr-name:") & F.col("scored"),
    }
    counted = all_edges.groupBy("edge_id").agg(F.count("*").alias("__n"), *(F.first(c).alias(c) for c in ("source_ein", "confidence", "target_key", "scored")))
    faults = F.array(*(F.when(c, F.lit(n)) for n, c in checks.items()))
    return counted.select(F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("fault"), "edge_id")


def node_stats(all_edges: DataFrame, hub_over: Column | None = None) -> DataFrame:
    """By target: distinct organisations, edges, years, and whether it is a hub (strictly above the limit)."""
    stats = dealt(all_edges.select("target_key", "source_ein", "tax_year"), "target_key", "source_ein").groupBy("target_key").agg(
        F.countDistinct("source_ein").alias("distinct_org_count"), F.count("*").alias("edge_count"), F.min("tax_year").alias("first_tax_year"), F.max("tax_year").alias("last_tax_year")
    )
    return with_hubs(stats, hub_over)


def refreshed(existing: DataFrame, new: DataFrame, filings: DataFrame) -> DataFrame:
    """Edges after some filings were read again: theirs are replaced, all others stay."""
    return existing.join(filings, "filing_id", "left_anti").unionByName(new.join(filings, "filing_id", "left_semi"))


def connection_rank(weight: Column, amount: Column) -> Column:
    """Relationship weight and the order of magnitude of the money."""
    return weight + F.log10(F.greatest(F.coalesce(amount, F.lit(0.0)), F.lit(1.0)))


# Years between money out and money back, recipients of a filer and of an intermediary that are followed, largest first, and findings of a kind that are reported.
WINDOW, FIRST_HOPS, SECOND_HOPS, RECIPROCAL_MOST, OVERLAP_MOST = 2, 8, 4, 3, 4
FINANCIAL = ("Grant paid", "Grant received", "Contractor")
IDENTITY = ("Schedule R", "Shared officer", "Shared employee/key person", "Shared person name", "Shared address")


def yearly(grants: DataFrame) -> DataFrame:
    """(source, target, total, dated, years) of grants (source, target, tax_year, amount): positive ones summed, and by year as an array of (year, amount, rows)."""
    paid = grants.where("amount > 0 and source is not null and target is not null and source <> target")
    each = paid.groupBy("source", "target", "tax_year").agg(F.sum("amount").alias("amount"), F.count("*").alias("rows"))
    year = F.struct(F.col("tax_year").alias("year"), "amount", "rows")
    return each.groupBy("source", "target").agg(F.sum("amount").alias("total"), F.sum(F.when(F.col("tax_year").isNotNull(), F.col("amount"))).alias("dated"), F.array_sort(F.collect_list(F.when(F.col("tax_year").isNotNull(), year))).alias("years"))


def _within(years: Column, others: Column, least: int, most: int) -> Column:
    """Of years those from which another one is least to most years later."""
    return F.filter(years, lambda y: F.exists(others, lambda o: (o["year"] - y["year"]).between(least, most)))


def _sum(years: Column, field: str, zero: Column) -> Column:
    return F.aggregate(years, zero, lambda s, y: s + y[field])


def grant_returns(flows: DataFrame, *, first: int = FIRST_HOPS, second: int = SECOND_HOPS, window: int = WINDOW) -> DataFrame:
    """Money that can have come back: ein paid via, and via paid ein in the same year or up to `window` years later.

    flows are those of yearly(). Only the largest recipients of ein (by dated money) and of via (by all money) are followed, as two
    cuts that meet by an equal pair of keys: no path that doesn't close is ever made.
    """
    out = flows.where(F.size("years") > 0).withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("dated"), "target"))).where(F.col("r") <= first)
    back = flows.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("total"), "target"))).where(F.col("r") <= second)
    pair = out.select(F.col("source").alias("ein"), F.col("target").alias("via"), F.col("years").alias("there")).join(back.select(F.col("target").alias("ein"), F.col("source").alias("via"), F.col("years").alias("back")), ["ein", "via"])
    there, later = _within(F.col("there"), F.col("back"), 0, window), _within(F.col("back"), F.col("there"), -window, 0)
    kept = pair.select("ein", "via", there.alias("there"), later.alias("back")).where(F.size("there") > 0)
    zero = F.lit(0.0)
    return kept.select(
        "ein", "via", _sum(F.col("there"), "amount", zero).alias("first_hop_amount"), _sum(F.col("back"), "amount", zero).alias("amount"), _sum(F.col("back"), "rows", F.lit(0).cast("long")).alias("rows"),
        F.transform("there", lambda y: y["year"]).alias("first_years"), F.transform("back", lambda y: y["year"]).alias("second_years"),
    )


def reciprocal_grants(flows: DataFrame, *, window: int = WINDOW, most: int = RECIPROCAL_MOST) -> DataFrame:
    """For each ein the others that it paid and that paid it, at most `window` years apart: the `most` of them with most money both ways."""
    there = flows.select(F.col("source").alias("ein"), F.col("target").alias("other"), F.col("years").alias("there"))
    pair = there.join(flows.select(F.col("target").alias("ein"), F.col("source").alias("other"), F.col("years").alias("back")), ["ein", "other"])
    paid, received = _within(F.col("there"), F.col("back"), -window, window), _within(F.col("back"), F.col("there"), -window, window)
    kept = pair.select("ein", "other", paid.alias("p"), received.alias("r")).where(F.size("p") > 0)
    sums = kept.select("ein", "other", *(_sum(F.col(c), "amount", F.lit(0.0)).alias(n) for c, n in (("p", "paid"), ("r", "received"))), *(F.transform(c, lambda y: y["year"]).alias(n) for c, n in (("p", "paid_years"), ("r", "received_years"))))
    least = F.least("paid", "received")
    ranked = sums.withColumn("__r", F.row_number().over(Window.partitionBy("ein").orderBy(least.desc(), "other"))).where(F.col("__r") <= most).drop("__r")
    return ranked.withColumn("severity", F.when(least >= 100_000, "High").otherwise("Medium"))


def money_and_identity(links: DataFrame, *, most: int = OVERLAP_MOST) -> DataFrame:
    """links (ein, other, relationship, scored): others tied to an ein by money and by a scored link of identity, with all relationships."""
    money, same = F.col("relationship").isin(*FINANCIAL), F.col("relationship").isin(*IDENTITY) & F.coalesce("scored", F.lit(True))
    found = links.groupBy("ein", "other").agg(F.bool_or(money).alias("m"), F.bool_or(same).alias("s"), F.array_sort(F.collect_set("relationship")).alias("relationships")).where("m and s")
    return found.withColumn("__r", F.row_number().over(Window.partitionBy("ein").orderBy(F.size("relationships").desc(), "other"))).where(F.col("__r") <= most).select("ein", "other", "relationships")


def hub_counts(edges: DataFrame) -> DataFrame:
    """(target_key, source_ein, tax_year, n): edges as multiplicities, from which some can be taken out again."""
    return edges.groupBy("target_key", "source_ein", "tax_year").agg(F.count("*").alias("n"))


def hub_stats_of(counts: DataFrame, hub_over: Column | None = None) -> DataFrame:
    """What node_stats() says, from multiplicities."""
    stats = counts.groupBy("target_key").agg(F.countDistinct("source_ein").alias("distinct_org_count"), F.sum("n").alias("edge_count"), F.min("tax_year").alias("first_tax_year"), F.max("tax_year").alias("last_tax_year"))
    return with_hubs(stats, hub_over)


def with_hubs(stats: DataFrame, hub_over: Column | None = None) -> DataFrame:
    kind = F.split_part("target_key", F.lit(":"), F.lit(1))
    limit = hub_over if hub_over is not None else F.when(kind == "person", HUB_OVER["person"]).when(kind == "address", HUB_OVER["address"]).when(kind == "contractor", HUB_OVER["contractor"])
    return stats.withColumn("is_hub", F.coalesce((F.col("distinct_org_count") > limit).cast("int"), F.lit(0)))


def hubs_after(counts: DataFrame, stats: DataFrame, removed: DataFrame, added: DataFrame, hub_over: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts, stats) after some edges were taken out and others put in; only targets that either touches are counted again.

    Taking out an edge that isn't there is an error of the caller and leaves no negative multiplicity behind.
    """
    keys = ["target_key", "source_ein", "tax_year"]
    change = hub_counts(added).unionByName(hub_counts(removed).withColumn("n", -F.col("n"))).groupBy(*keys).agg(F.sum("n").alias("n"))
    touched = change.select("target_key").distinct()
    rest = counts.join(touched, "target_key", "left_anti")
    again = counts.join(touched, "target_key", "left_semi").unionByName(change).groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")
    return rest.unionByName(again), stats.join(touched, "target_key", "left_anti").unionByName(hub_stats_of(again, hub_over))
