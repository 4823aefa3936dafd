"""Related organisations of Schedule R, from filings parsed by `layouts.FILING`."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.operators.core_data import number

Read = Callable[[Column], Column]
GROUPS = ("r_tax_exempt", "r_corporations", "r_partnerships", "r_disregarded", "r_transactions", "r_unrelated")
UNRELATED = "Unrelated Taxable Partnership"
# What the rows of each group are called, and the table that they are kept in.
CATEGORIES = {
    "r_tax_exempt": ("Related Tax-Exempt Org", "irs990_schedule_r_id_related_tax_exempt_org_grp"),
    "r_corporations": ("Related Taxable Corporation/Trust", "irs990_schedule_r_id_related_org_txbl_corp_tr_grp"),
    "r_partnerships": ("Related Taxable Partnership", "irs990_schedule_r_id_related_org_txbl_partnership_grp"),
    "r_disregarded": ("Disregarded Entity", "irs990_schedule_r_id_disregarded_entities_grp"),
    "r_transactions": ("Transactions with Related Org", "irs990_schedule_r_transactions_related_org_grp"),
    "r_unrelated": (UNRELATED, "irs990_schedule_r_unrelated_org_txbl_partnership_grp"),
}
#: Which columns name the organisation, first line and second, the first that is there.
NAMES = {
    "r_tax_exempt": ("business_name", "disregarded_entity_name_business_name"), "r_corporations": ("related_organization_name_business_name", "business_name"),
    "r_partnerships": ("related_organization_name_business_name", "business_name"), "r_disregarded": ("disregarded_entity_name_business_name",), "r_transactions": ("business_name",), "r_unrelated": ("business_name",),
}
#: Columns of the result, the group's column, and the groups that have it.
OTHERS = {
    "controlled_org_ind": ("controlled_organization_ind", GROUPS[:3]), "primary_activities": ("primary_activities_txt", (*GROUPS[:4], "r_unrelated")), "transaction_type": ("transaction_type_txt", ("r_transactions",)),
    "exempt_code_section": ("exempt_code_section_txt", ("r_tax_exempt",)), "public_charity_status": ("public_charity_status_txt", ("r_tax_exempt",)), "address_line1": ("address_line1_txt", (*GROUPS[:3], "r_unrelated")),
    "city": ("city_nm", (*GROUPS[:3], "r_unrelated")), "state_abbrev": ("state_abbreviation_cd", (*GROUPS[:3], "r_unrelated")), "domicile_state": ("legal_domicile_state_cd", (*GROUPS[:3], "r_unrelated")),
    "country": ("country_cd", ("r_tax_exempt",)),
}


def row_of(group: str) -> Read:
    """A row of one group in the columns that all share."""

    def read(r: Column) -> Column:
        def text(c: str, where: Sequence[str]) -> Column:
            return r[c] if group in where else F.lit(None).cast("string")

        def line(n: int) -> Column:
            return F.trim(F.coalesce(*(r[f"{name}_line{n}_txt"] for name in NAMES[group] if (group, n) != ("r_unrelated", 2)), F.lit("")))

        name = F.concat(line(1), F.when(line(2) != "", F.concat(F.lit(" "), line(2))).otherwise(""))
        values = {c: text(*source) for c, source in OTHERS.items()}
        if group == "r_unrelated":
            values["controlled_org_ind"] = r["general_or_managing_partner_ind"]
        category, table = CATEGORIES[group]
        return F.struct(
            F.lit(category).alias("relationship_category"), text("ein", (*GROUPS[:3], "r_unrelated")).alias("related_ein"), name.alias("related_name"),
            number(text("ownership_pct", (*GROUPS[1:3], "r_unrelated"))).alias("ownership_pct"), number(text("involved_amt", ("r_transactions",))).alias("involved_amt"),
            *(v.alias(c) for c, v in values.items()), F.lit(table).alias("table_source"),
        )

    return read


#: Columns of the result, in order.
COLUMNS = (
    "filer_ein", "filer_tax_year", "filing_id", "relationship_category", "related_ein", "related_name", "ownership_pct", "controlled_org_ind", "primary_activities", "transaction_type", "involved_amt",
    "exempt_code_section", "public_charity_status", "address_line1", "city", "state_abbrev", "domicile_state", "country", "table_source",
)


def schedule_r(filings: DataFrame, unrelated: bool = False) -> DataFrame:
    """Every related organisation of canonical filings (ein, tax_year, filing_id beside the parsed groups), 19 columns.

    The six groups of a filing are turned into one array and exploded, so filings are read once, not six times. Partnerships
    with unrelated organisations are left out unless asked for; names are both lines, trimmed; rows that say the same stay.
    """
    rows = F.concat(*(F.transform(g, row_of(g)) for g in GROUPS if unrelated or g != "r_unrelated"))
    found = filings.select(F.col("ein").alias("filer_ein"), F.col("tax_year").alias("filer_tax_year"), "filing_id", F.explode(rows).alias("r"))
    return found.select("filer_ein", "filer_tax_year", "filing_id", "r.*").select(*COLUMNS)
