from filigree.operators import core_data, people_search, preflight, related
from filigree.sources import layouts, xml_filing

HEAD = "<ReturnHeader><ReturnTypeCd>{kind}</ReturnTypeCd><TaxYr>2017</TaxYr><Filer><EIN>{ein}</EIN></Filer></ReturnHeader>"


def filing(kind, body, ein="1", version=' returnVersion="2017v2.3"'):
    return f'<Return xmlns="u"{version}>{HEAD.format(kind=kind, ein=ein)}<ReturnData>{body}</ReturnData></Return>'


def parsed(spark, texts, layout=layouts.FILING):
    rows = [(f"/x/{name}.public.xml", bytearray(text.encode())) for name, text in texts.items()]
    return xml_filing.parse_filings(spark.createDataFrame(rows, "path string, content binary"), layout)


def codes(spark, texts):
    return {r.filing_id.split(".")[0]: [c.code for c in r.caveats] for r in preflight.preflight(parsed(spark, texts)).collect()}


def test_first_of_several_tags_in_document_order():
    below = xml_filing.Below(xml_filing.ElementTree.fromstring('<R a:myVersion="3" xmlns:a="q"><b> </b><c>1</c><B>2</B></R>'))
    assert (below.at("//B|C"), below.at("//b"), below.at("//d"), below.at("@version"), below.at("c")) == ("1", "2", None, "3", "1")
    assert [n.tag for n in below.nodes("//c|b")] == ["b", "c", "B"]


def test_forms(spark):
    texts = {
        "a": filing("990", "<IRS990><CYTotalRevenueAmt>0</CYTotalRevenueAmt><TotalRevenueAmt>1,234</TotalRevenueAmt><LobbyingActivitiesInd>n</LobbyingActivitiesInd></IRS990>"),
        "b": filing("990PF", "<IRS990PF><TotalAssetsEOYAmt>9</TotalAssetsEOYAmt></IRS990PF>", "2"),
        "c": filing("990EZ", "<IRS990EZ><Organization501cInd>1</Organization501cInd><Organization501cTypeTxt>4</Organization501cTypeTxt></IRS990EZ>", "3"),
        "d": filing("990T", "", "4"),
        "e": "<Return>",
    }
    rows = {r.ein: r for r in core_data.core_data(parsed(spark, texts)).collect()}
    assert core_data.core_data(parsed(spark, texts)).columns == list(core_data.COLUMNS) and len(core_data.COLUMNS) == 50
    assert sorted(rows) == ["1", "2", "3", "4"]
    assert (rows["1"].total_revenue, rows["1"].lobbying_activities_ind, rows["1"].filing_id) == (1234.0, "No", "a.public")
    assert (rows["2"].net_assets_eoy, rows["2"].total_liabilities_eoy, rows["2"].salaries_comp_emp_benefits) == (9.0, None, 0.0)
    assert (rows["3"].tax_exempt_status, rows["3"].political_campaign_activity_ind, rows["3"].formation_year) == ("501(c)(4)", "", None)
    assert (rows["4"].net_assets_boy, rows["4"].tax_exempt_status) == (None, "")


def test_lobbying_falls_back(spark):
    def sc(body):
        return filing("990", f"<IRS990/><IRS990ScheduleC>{body}</IRS990ScheduleC>")

    texts = {
        "a": sc("<TotalLobbyingExpendituresAmt>0</TotalLobbyingExpendituresAmt><MailingsMembersAmt>5</MailingsMembersAmt>"),
        "b": sc("<TotalDirectLobbyingGrp><FilingOrganizationsTotalAmt>3</FilingOrganizationsTotalAmt></TotalDirectLobbyingGrp><MailingsMembersAmt>5</MailingsMembersAmt>"),
        "c": sc("<MailingsMembersAmt>5</MailingsMembersAmt><OtherActivitiesAmt>2</OtherActivitiesAmt>"),
        "d": sc("<MailingsMembersAmt>0</MailingsMembersAmt>"),
    }
    got = {r.filing_id[0]: r.lobbying_expense for r in core_data.core_data(parsed(spark, texts)).collect()}
    assert got == {"a": 0.0, "b": 3.0, "c": 7.0, "d": None}


def test_preflight_caveats(spark):
    good = "<IRS990><CYTotalRevenueAmt>5</CYTotalRevenueAmt></IRS990>"
    one = "<RecipientTable><RecipientEIN>7</RecipientEIN></RecipientTable>"
    paid = "<IRS990PF><TotalRevAndExpnssAmt>1</TotalRevAndExpnssAmt><ContriPaidRevAndExpnssAmt>4</ContriPaidRevAndExpnssAmt>{}</IRS990PF>"
    got = codes(spark, {
        "fine": filing("990", good), "versionless": filing("990", good, version=""), "new": filing("990", good, version=' returnVersion="2030v1.0"'), "other": filing("990T", ""),
        "mixed": filing("990EZ", good), "blank": filing("990", "<IRS990/>"), "broken": "<Return", "headless": filing("990", good, ein=" "),
        "signal": filing("990", good + "<GrantsToOrganizationsInd>X</GrantsToOrganizationsInd>"), "told": filing("990", good + "<GrantsToOrganizationsInd>X</GrantsToOrganizationsInd>" + one),
        "empty": filing("990", good + "<GrantsToOrganizationsInd>X</GrantsToOrganizationsInd><RecipientTable><CashGrantAmt>0</CashGrantAmt></RecipientTable>"),
        "pf": filing("990PF", paid.format("")), "people": filing("990PF", paid.format("<GrantsToIndividualsInd>true</GrantsToIndividualsInd>")),
    })
    assert got == {
        "fine": [], "versionless": ["schema_version_missing"], "new": ["unknown_form_version_combo"], "other": ["unsupported_return_type", "no_recognized_main_form", "all_core_hot_fields_blank"],
        "mixed": ["return_type_form_mismatch", "all_core_hot_fields_blank"], "blank": ["all_core_hot_fields_blank"], "broken": ["parse_error"], "headless": ["missing_required_header"],
        "signal": ["grant_signal_without_detail_rows"], "told": [], "empty": ["grant_signal_without_detail_rows"],
        "pf": ["grant_signal_without_detail_rows", "pf_contributions_paid_without_detail_rows"], "people": [],
    }


def test_people_once_and_special(spark):
    def row(name, extra=""):
        return f"<Form990PartVIISectionAGrp>{name}<AverageHoursPerWeekRt>0</AverageHoursPerWeekRt><AverageHoursPerWeekRltdOrgRt>3</AverageHoursPerWeekRltdOrgRt>{extra}</Form990PartVIISectionAGrp>"

    ada = "<PersonNm>Ada</PersonNm>"
    texts = {"a": filing("990", row(ada, "<OfficerInd>X</OfficerInd>") + row(ada, "<OfficerInd>1</OfficerInd>") + row("<PersonNm>Bo</PersonNm>", "<KeyEmployeeInd>T</KeyEmployeeInd><HighestCompensatedEmployeeInd>y</HighestCompensatedEmployeeInd>") + row(""))}
    got = sorted((r.person_name, r.avg_hours_week, r.highest, r.former_or_key) for r in core_data.people(parsed(spark, texts, layouts.FILING.only("part_vii"))).collect())
    assert got == [("Ada", 3.0, False, False), ("Bo", 3.0, True, True)]


def test_schedule_r_of_the_filing_that_counts(spark):
    part = "<UnrelatedOrgTxblPartnershipGrp><BusinessNameLine1Txt>P</BusinessNameLine1Txt><BusinessNameLine2Txt>no</BusinessNameLine2Txt><GeneralOrManagingPartnerInd>X</GeneralOrManagingPartnerInd></UnrelatedOrgTxblPartnershipGrp>"
    gone = "<IdDisregardedEntitiesGrp><DisregardedEntityNameBusinessNameLine1Txt> D </DisregardedEntityNameBusinessNameLine1Txt><DisregardedEntityNameBusinessNameLine2Txt>two</DisregardedEntityNameBusinessNameLine2Txt></IdDisregardedEntitiesGrp>"
    texts = {"a": filing("990", "<IRS990><AmendedReturnInd>X</AmendedReturnInd></IRS990>" + part + gone), "b": filing("990", "<IRS990/>" + gone)}
    chosen = core_data.canonical(parsed(spark, texts))
    assert related.schedule_r(chosen).columns == list(related.COLUMNS) and len(related.COLUMNS) == 19
    assert [(r.filing_id, r.related_name) for r in related.schedule_r(chosen).collect()] == [("a.public", "D two")]
    assert sorted((r.related_name, r.controlled_org_ind) for r in related.schedule_r(chosen, unrelated=True).collect()) == [("D two", None), ("P", "X")]


def test_people_search_takes_its_budget_in_order(spark):
    loan = "<LoansBtwnOrgInterestedPrsnGrp><PersonNm>Ann Lee</PersonNm></LoansBtwnOrgInterestedPrsnGrp>"
    grant = "<RecipientTable><RecipientBusinessName><BusinessNameLine1Txt>ann</BusinessNameLine1Txt><BusinessNameLine2Txt>LEE fund</BusinessNameLine2Txt></RecipientBusinessName><CashGrantAmt>7.25</CashGrantAmt></RecipientTable>"
    df = parsed(spark, {"a": filing("990", loan + loan + grant, "9"), "b": filing("990", loan, "2")})

    def found(**kw):
        return [(r.ein, r.found_in.split(" (")[0], r.detail) for r in people_search.people_search(df, "ann lee", **kw).collect()]

    signer, kept = "Return Header", "Books In Care Of"
    assert [x[:2] for x in found()] == [("2", kept), ("2", kept), ("2", signer), ("2", "Schedule L"), ("9", kept), ("9", kept), ("9", "Grant Recipient"), ("9", signer), ("9", "Schedule L")]
    assert found(max_rows=1) == [("9", "Grant Recipient", "name=ann LEE fund | recp_ein= | cash=7.25 | noncash= | purpose= | city= | state= | country=")]
    assert "Grant Recipient" not in [x[1] for x in found(fuzzy=False)]
    assert found(years=(None, 2016)) == [] and found(state="CA") == [] and len(found(years=(2018, 2017))) == 9
    assert people_search.people_search(df, "  ").collect() == [] and people_search.people_search(df, "Ann\\").collect() == []


def test_no_content(spark):
    df = xml_filing.parse_filings(spark.createDataFrame([("/x/a.xml", None), (None, None)], "path string, content binary"), layouts.FILING)
    assert [(r.status, r.filing_id) for r in preflight.preflight(df).orderBy(preflight.F.col("source_file").desc()).collect()] == [("parse_error", "a"), ("parse_error", None)]


def test_no_files(spark):
    df = parsed(spark, {"a": filing("990", "")}).limit(0)
    none = spark.createDataFrame([], "path string, content binary")
    for table in (core_data.core_data(df), core_data.people(df), preflight.caveat_counts(preflight.preflight(df)), people_search.people_search(df, "x"), xml_filing.element_paths(none)):
        assert table.count() == 0


def test_element_paths(spark):
    rows = [("a", bytearray(b'<R version="1"><x>1</x><x/></R>')), ("b", bytearray(b'<R version="1"><x> </x></R>')), ("c", bytearray(b"<R/>")), ("d", bytearray(b"<")), ("e", None)]
    got = {(r.version, r.path): (r.filings, r.filled, r.files) for r in xml_filing.element_paths(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {("1", "/R"): (2, 0, 2), ("1", "/R/x"): (2, 1, 2), ("", "/R"): (1, 0, 1)}


def test_only_what_a_filing_has_is_looked_for(monkeypatch):
    """A layout's columns are many, a filing's elements few."""
    looked, at = [], xml_filing.Below.at
    monkeypatch.setattr(xml_filing.Below, "at", lambda self, path: looked.append(path) or at(self, path))
    people = "<Form990PartVIISectionAGrp><PersonNm>Ada</PersonNm></Form990PartVIISectionAGrp>"
    text = filing("990", f"<IRS990><AmendedReturnInd>X</AmendedReturnInd><WebsiteAddressTxt>w</WebsiteAddressTxt>{people}</IRS990>").encode()
    header, found, error = xml_filing.parse(text, layouts.FILING)
    assert error is None and list(header) == list(layouts.FILING.header) and (header["amended"], header["schema_version"], header["website"]) == ("X", "2017v2.3", None)
    assert found["f990"]["website_address_txt"] == "w" and found["part_vii"][0]["person_name"] == "Ada" and len(found["part_vii"][0]) == len(layouts.OFFICERS)
    assert len(looked) < 30
    least = layouts.FILING.only("part_vii", header=("amended",))
    assert xml_filing.parse(text, least) == ({c: header[c] for c in ("return_type", "tax_year", "ein", "amended")}, {"part_vii": found["part_vii"]}, None)
    mixed = xml_filing.Layout(header={"a": ("x/*/y", "@v"), "b": ("//P//C|D",), "c": ("*",), "d": ("X/y",)})
    assert xml_filing.parse(b'<r v="1"><x><q><y> 2 </y></q></x><P><t><d>3</d></t></P><z>4</z></r>', mixed)[0] == {"a": "2", "b": "3", "c": "4", "d": None}


def test_small_files_are_parsed_by_all_tasks(spark):
    from filigree.plans import ingest

    made = ingest.filings_parsed(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and "grants" not in made._jdf.queryExecution().analyzed().toString()


def test_only_names_that_are_asked_for_are_noted():
    root = xml_filing.ElementTree.fromstring('<R xmlns="u"><a>1</a><b><c>2</c></b><B>3</B></R>')
    assert set(xml_filing.Below(root, xml_filing.Names(["//b//C", "x/d"])).by_tag) == {"b", "c"}
    layout = xml_filing.Layout({"c": ("//C",), "first": ("a",)}, groups={"rows": ("//B", {"c": ("//c|z",), "own": ("c",)})})
    assert set(layout.named) == {"", "rows"} and layout.named["rows"].wanted == {"", "c", "z"}
    assert xml_filing.parse(b'<R xmlns="u"><a>1</a><b><c>2</c></b><B>3</B></R>', layout) == ({"c": "2", "first": "1"}, {"rows": [{"c": "2", "own": "2"}]}, None)


def test_searches_and_checks_read_only_their_parts(spark):
    text = {"a": filing("990", "<IRS990><PersonNm>Jo</PersonNm></IRS990><Form990PartVIISectionAGrp><PersonNm>Jo</PersonNm></Form990PartVIISectionAGrp>")}
    for operator, module in ((lambda f: people_search.people_search(f, "jo"), people_search), (preflight.preflight, preflight)):
        some = layouts.FILING.only(*module.PARTS, header=module.HEADER)
        assert operator(parsed(spark, text, some)).collect() == operator(parsed(spark, text)).collect()
        assert len(some.header) < len(layouts.FILING.header) and len(some.groups) < len(layouts.FILING.groups)


def test_paths_of_many_files_leave_their_task_once():
    counts = xml_filing.path_counts([b'<R myVersion="2"><a>1</a><a/></R>', b"<R", None, b'<R myVersion="2"><a/></R>'] * 50)
    assert counts == {("2", "/R", True): [100, 0], ("2", "/R/a", False): [100, 50]}
