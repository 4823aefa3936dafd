"""The layout of whole filings: header, main forms, Schedule C and every group of child rows."""

from __future__ import annotations

from filigree.sources.xml_filing import Layout, anywhere, schedule_c

FILER = "ReturnHeader/Filer"
US, FOREIGN = f"{FILER}/USAddress", f"{FILER}/ForeignAddress"

# Where the header's columns are.
HEADER = {
    "return_type": ("ReturnHeader/ReturnTypeCd",),
    "tax_year": ("ReturnHeader/TaxYr", "ReturnHeader/TaxYear"),
    "period_start": ("//TaxPeriodBeginDt",),
    "period_end": ("ReturnHeader/TaxPeriodEndDt",),
    "ein": (f"{FILER}/EIN",),
    "schema_version": ("@version",),
    "return_ts": ("ReturnHeader/ReturnTs", "ReturnHeader/ReturnTimestamp", "ReturnHeader/ReceivedDt"),
    "amended": ("ReturnHeader/AmendedReturnInd", *(f"ReturnData/IRS990{form}/AmendedReturnInd" for form in ("", "EZ", "PF"))),
    "org_name": (f"{FILER}/BusinessName/BusinessNameLine1Txt", f"{FILER}/Name/BusinessNameLine1Txt"),
    "dba_name": (f"{FILER}/DoingBusinessAsNm", f"{FILER}/DBANm", f"{FILER}/BusinessName/BusinessNameLine2Txt", f"{FILER}/Name/BusinessNameLine2Txt"),
    "in_care_of_name": (f"{FILER}/InCareOfNm", f"{US}/InCareOfNm", f"{FOREIGN}/InCareOfNm"),
    "us_address_line1": (f"{US}/AddressLine1Txt",),
    "us_address_line2": (f"{US}/AddressLine2Txt",),
    "city": (f"{US}/CityNm",),
    "state": (f"{US}/StateAbbreviationCd",),
    "zip": (f"{US}/ZIPCd", f"{US}/ZipCd"),
    "foreign_address_line1": (f"{FOREIGN}/AddressLine1Txt",),
    "foreign_city": (f"{FOREIGN}/CityNm",),
    "foreign_province": (f"{FOREIGN}/ProvinceOrStateNm",),
    "foreign_country": (f"{FOREIGN}/CountryCd",),
    "foreign_postal_code": (f"{FOREIGN}/ForeignPostalCd",),
    "website": ("ReturnHeader/WebsiteAddressTxt", f"{FILER}/WebsiteAddressTxt", "ReturnData/IRS990PF/StatementsRegardingActyGrp/WebsiteAddressTxt"),
}

# Who signed, who prepared, and who keeps the books: of its form, or of the whole filing where it hasn't that form.
SIGNERS = {
    "signer": ("//PersonNm",), "signer_title": ("//PersonTitleTxt",), "signed": ("//SignatureDt",), "preparer": ("//PreparerPersonNm",), "preparer_firm": ("//PreparerFirmNameBusinessNameLine1Txt",),
    "ptin": ("//PTIN",), "prepared": ("//PreparationDt",),
}
BOOKS = {
    "books_person": ("//IndividualWithBooksNm|PersonNm",), "books_address": ("//AddressLine1Txt",), "books_city": ("//CityNm",), "books_state": ("//StateAbbreviationCd",), "books_zip": ("//ZIPCd",),
    "books_phone": ("//PhoneNum",),
}

# Columns of each main form, beside those that all of them have.
COMMON = ("address_change_ind", "name_change_ind", "initial_return_ind", "final_return_ind", "amended_return_ind", "application_pending_ind", "website_address_txt")
PUBLIC = (
    "net_assets_or_fund_balances_boyamt", "net_assets_or_fund_balances_eoyamt", "membership_dues_amt", "organization501c3_ind", "organization501c_ind", "attr_organization501c_type_txt",
    "organization4947a1_not_pfind", "type_of_organization_corp_ind", "type_of_organization_trust_ind", "type_of_organization_assoc_ind", "type_of_organization_other_ind",
    "political_campaign_acty_ind", "lobbying_activities_ind", "total_revenue_amt",
)
FORM_990 = (
    "total_program_service_revenue_amt", "cyprogram_service_revenue_amt", "cyinvestment_income_amt", "cygrants_and_similar_paid_amt", "total_employee_cnt", "employee_cnt", "total_volunteers_cnt",
    "mission_desc", "activity_or_mission_desc", "formation_yr", "legal_domicile_state_cd", "other_organization_dsc", "cyother_revenue_amt", "cysalaries_comp_emp_bnft_paid_amt",
    "cytotal_prof_fndrsng_expns_amt", "cytotal_fundraising_expense_amt", "cyother_expenses_amt", "cyrevenues_less_expenses_amt", "total_assets_boyamt", "total_assets_eoyamt",
    "total_liabilities_boyamt", "total_liabilities_eoyamt", "cytotal_revenue_amt", "cytotal_expenses_amt", "total_functional_expenses_amt", "cycontributions_grants_amt",
    "contributions_gifts_grants_etc_amt", "government_grants_amt",
)
FORM_EZ = (
    "program_service_revenue_amt", "investment_income_amt", "grants_and_similar_amounts_paid_amt", "primary_exempt_purpose_txt", "type_of_organization_other_desc", "other_revenue_total_amt",
    "salaries_other_comp_empl_bnft_amt", "other_expenses_total_amt", "excess_or_deficit_for_year_amt", "total_expenses_amt", "boyamt", "eoyamt",
)
FORM_PF = (
    "organization501c3_exempt_pfind", "organization4947a1_trtd_pfind", "legislative_political_acty_ind", "more_than100_spent_ind", "form1120_pol_filed_ind", "influence_legislation_ind",
    "influence_election_ind", "total_grant_or_contri_pd_dur_yr_amt", "mission_desc_txt", "other_income_rev_and_expnss_amt", "oth_empl_slrs_wgs_rev_and_expnss_amt",
    "pension_empl_bnft_rev_and_expnss_amt", "other_expenses_rev_and_expnss_amt", "excess_revenue_over_expenses_amt", "interest_on_savings_temp_cash_investments_rev_and_expnss_amt",
    "dividends_interest_securities_rev_and_expnss_amt", "net_investment_income_amt", "contri_paid_rev_and_expnss_amt", "total_assets_boyamt", "total_assets_eoyamt", "total_liabilities_boyamt",
    "total_liabilities_eoyamt", "total_rev_and_expnss_amt", "total_expenses_rev_and_expnss_amt",
)
ACTIVITIES = ("media_advertisements", "mailings_members", "publications_or_broadcast", "grants_other_organizations", "direct_contact_legislators", "rallies_demonstrations", "other_activities")
SCHEDULE_C = (
    "political_expenditures_amt", "volunteer_hours_cnt", "expended527_activities_amt", "total_exempt_function_expend_amt", "form1120_pol_filed_ind", "lobbying_ceiling_amt", "grassroots_ceiling_amt",
    "organization_belongs_afflt_grp_ind", "volunteers_ind", "paid_staff_or_management_ind", *(f"{a}_{kind}" for a in ACTIVITIES for kind in ("ind", "amt")), "total_lobbying_expenditures_amt",
    "not_described_section501c3_ind", "dues_assessments_amt", "non_deductible_lbbyng_pltcl_cy_amt", "non_deductible_lbbyng_pltcl_tot_amt", "aggregate_reported_dues_ntc_amt", "carried_over_amt",
    "substantially_all_dues_nonded_ind",
)

# Tags of the rows of each child table, and its columns.
LINES = ("business_name_line1_txt", "business_name_line2_txt")
RELATED_LINES = tuple(f"related_organization_name_{c}" for c in LINES)
DISREGARDED_LINES = tuple(f"disregarded_entity_name_{c}" for c in LINES)
PLACE = ("address_line1_txt", "address_line2_txt", "city_nm", "state_abbreviation_cd", "legal_domicile_state_cd")
CONTROL = ("controlled_organization_ind", "direct_controlling_nacd", "primary_activities_txt")
SHARES = ("ownership_pct", "share_of_total_income_amt", "share_of_eoyassets_amt")
PERSON = ("person_nm", "title_txt")
CHILDREN = {
    "ez_officers": ("OfficerDirectorTrusteeEmplGrp|OfficerDirectorTrusteeEmployeeGrp", (*PERSON, "average_hrs_per_wk_devoted_to_pos_rt", "compensation_amt", "employee_benefit_program_amt", "expense_account_other_allwnc_amt")),
    "schedule_j": ("RltdOrgOfficerTrstKeyEmplGrp", (*PERSON, "base_compensation_filing_org_amt", "bonus_filing_organization_amount", "total_compensation_filing_org_amt", "total_compensation_rltd_orgs_amt")),
    "pf_officers": ("OfficerDirTrstKeyEmplGrp", (*PERSON, "average_hrs_per_wk_devoted_to_pos_rt", "compensation_amt", "employee_benefits_amt", "expense_account_amt")),
    "l_business": ("BusTrInvolveInterestedPrsnGrp", ("person_nm", "relationship_description_txt", "transaction_amt", "transaction_desc")),
    "l_excess_benefit": ("DisqualifiedPersonExBnftTrGrp", ("person_nm", "rln_disqualified_person_org_txt", "transaction_corrected_ind", "transaction_desc")),
    "l_grants": ("GrntAsstBnftInterestedPrsnGrp", ("person_nm", "relationship_with_org_txt", "cash_grant_amt", "type_of_assistance_txt", "assistance_purpose_txt")),
    "l_loans": ("LoansBtwnOrgInterestedPrsnGrp", ("person_nm", "relationship_with_org_txt", "original_principal_amt", "balance_due_amt", "loan_purpose_txt")),
    "r_tax_exempt": ("IdRelatedTaxExemptOrgGrp", ("ein", *LINES, *DISREGARDED_LINES, "exempt_code_section_txt", "public_charity_status_txt", *CONTROL, *PLACE, "country_cd", "foreign_postal_cd")),
    "r_corporations": ("IdRelatedOrgTxblCorpTrGrp", ("ein", *RELATED_LINES, *LINES, *CONTROL, *PLACE, "foreign_postal_cd", *SHARES)),
    "r_partnerships": ("IdRelatedOrgTxblPartnershipGrp", ("ein", *RELATED_LINES, *LINES, *CONTROL, *PLACE, "foreign_postal_cd", *SHARES, "ubicode_vamt")),
    "r_disregarded": ("IdDisregardedEntitiesGrp", (*DISREGARDED_LINES, "primary_activities_txt")),
    "r_transactions": ("TransactionsRelatedOrgGrp", (*LINES, "involved_amt", "transaction_type_txt", "method_of_amount_determination_txt")),
    "r_unrelated": ("UnrelatedOrgTxblPartnershipGrp", ("ein", "business_name_line1_txt", "general_or_managing_partner_ind", "primary_activities_txt", *PLACE, *SHARES, "ubicode_vamt")),
}
GRANTS = anywhere("recipient_ein", *LINES) | {
    "us_address_line1_txt": ("//AddressLine1Txt",), "us_address_line2_txt": ("//AddressLine2Txt",), "us_city_nm": ("//CityNm",), "us_state_abbreviation_cd": ("//StateAbbreviationCd",), "us_zip_cd": ("//ZIPCd",),
    "foreign_address_line1_txt": ("//ForeignAddressLine1Txt",), "foreign_city_nm": ("//ForeignCityNm",), "foreign_province_or_state_nm": ("//ProvinceOrStateNm",), "foreign_postal_cd": ("//ForeignPostalCd",),
    "foreign_country_cd": ("//CountryCd",), "ircsection_desc": ("//IRCSectionDesc",), "cash_grant_amt": ("//CashGrantAmt", "//Amt"), "non_cash_assistance_amt": ("//NonCashAssistanceAmt",),
    "non_cash_assistance_desc": ("//NonCashAssistanceDesc",), "valuation_method_used_desc": ("//ValuationMethodUsedDesc",), "purpose_of_grant_txt": ("//PurposeOfGrantTxt|GrantOrContributionPurposeTxt",),
}
CONTRACTORS = anywhere(*LINES, "person_nm", "address_line1_txt", "address_line2_txt", "city_nm", "country_cd", "foreign_postal_cd", "province_or_state_nm", "state_abbreviation_cd", "zipcd") | {
    "compensation_amt": ("//CompensationAmt", "//Amount"), "services_desc": ("//ServicesDesc|ServiceTypeTxt|DescriptionTxt|ServicesDescriptionTxt",),
}
OFFICERS = {
    "person_name": ("//PersonNm",), "title_txt": ("//TitleTxt",), "avg_hours_week": ("//AverageHoursPerWeekRt",), "avg_hours_week_related": ("//AverageHoursPerWeekRltdOrgRt",),
    "comp_from_org": ("//ReportableCompFromOrgAmt",), "comp_from_related": ("//ReportableCompFromRltdOrgAmt",), "other_compensation": ("//OtherCompensationAmt",), "is_officer": ("//OfficerInd",),
    "is_director": ("//IndividualTrusteeOrDirectorInd|InstitutionalTrusteeInd",), "is_key_employee": ("//KeyEmployeeInd",), "is_former": ("//FormerOfcrDirectorTrusteeInd",),
    "is_highest": ("//HighestCompensatedEmployeeInd",),
}

# Tags that say whether a filing makes grants, read from the whole filing.
TO_ORGANIZATIONS = ("GrantsToOrganizationsInd", "MoreThan5000KToOrgInd")
TO_INDIVIDUALS = ("GrantsToIndividualsInd", "MoreThan5000KToIndividualsInd")
CONTRIBUTIONS_PAID = ("ContriPaidRevAndExpnssAmt", "ContriPaidDsbrsChrtblAmt")
GRANT_AMOUNTS = (*CONTRIBUTIONS_PAID, "CYGrantsAndSimilarPaidAmt", "GrantsAndSimilarAmountsPaidAmt", "GrantAmt", "GrantsAndAllocationsAmt")
SIGNALS = (*TO_ORGANIZATIONS, *TO_INDIVIDUALS, *GRANT_AMOUNTS)

#: Header, forms and child tables of a filing. The amounts of form EZ's two balance groups are the first of that form, whichever group they are in.
FILING = Layout(
    header=HEADER | SIGNERS | BOOKS | {tag: (f"//{tag}",) for tag in SIGNALS},
    required=("return_type", "tax_year", "ein"),
    sections={
        "f990": ("//IRS990", anywhere(*COMMON, *PUBLIC, *FORM_990) | BOOKS),
        "ez": ("//IRS990EZ", anywhere(*COMMON, *PUBLIC, *FORM_EZ) | BOOKS),
        "pf": ("//IRS990PF", anywhere(*COMMON, *FORM_PF)),
        "sc": ("//IRS990ScheduleC", schedule_c(*SCHEDULE_C)),
    },
    groups={
        "grants": ("//RecipientTable|GrantsAndSimilarAmountsPaidGrp|GrantOrContributionPdDurYrGrp", GRANTS),
        "contractors": ("//ContractorCompensationGrp|IndependentContractorGrp|IndCntrctRcpntGrp|CompensationOfHghstPdCntrctGrp", CONTRACTORS),
        "part_vii": ("//Form990PartVIISectionAGrp", OFFICERS),
        **{name: (f"//{tags}", anywhere(*columns)) for name, (tags, columns) in CHILDREN.items()},
    },
)
