import hashlib
import zipfile

from filigree.sources import screening_files as f


def hashed(*values):
    h = hashlib.sha256()
    for v in values:
        b = (v or "").encode()
        h.update(len(b).to_bytes(8, "big") + b)
    return h.hexdigest()


def write(folder, name, text, encoding="utf-8"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode(encoding))
    return f"file://{folder}"


def rejects(out):
    return sorted((r.row_no, r.reason) for r in out["rejects"].collect())


def test_pub78_with_and_without_header(spark, tmp_path):
    path = write(tmp_path / "p", "a.txt", "123456789|Café|Rome|NY|US|PC\nbad|X|||\n\n223456789|||||\n", "cp1252")
    write(tmp_path / "p", "b.txt", "Organization Name|EIN|STATE\nÉcole|32-3456789|VT\n", "utf-16")
    out = f.pub78(spark, path)
    got = {r.ein: (r.primary_name, r.region, r.record_id) for r in out["entities"].collect()}
    assert got == {"123456789": ("Café", "NY", hashed("123456789", "Café", "Rome", "NY", "US", "PC")), "323456789": ("École", "VT", hashed("323456789", "École", "", "VT", "", ""))}
    assert rejects(out) == [(2, "no nine-digit number"), (3, "no name")]


def test_revocations(spark, tmp_path):
    path = write(tmp_path / "r", "a.txt", "123456789|Acme|ACME|1 Elm|Rome|NY|1|US|03|01-Jan-2020|2020-02-03|\n223456789|Beta|Better|||||||20200105||1/9/2021\n")
    out = f.revocations(spark, path)
    got = {r.ein: (r.status, r.status_date, r.reinstatement_date, r.remarks) for r in out["entities"].collect()}
    assert got == {"123456789": ("automatically_revoked", "2020-01-01", None, "IRS posting date: 2020-02-03"), "223456789": ("reinstated_after_auto_revocation", "2020-01-05", "2021-01-09", "")}
    assert [(a.alias_name, a.name_norm) for a in out["aliases"].collect()] == [("Better", "BETTER")] and rejects(out) == []


def test_exclusions_and_missing_columns(spark, tmp_path):
    head = ",".join(c.upper() for c in f.LEIE)
    path = write(tmp_path / "l", "a.csv", f'{head}\nSmith,Jo,Q,,g,s,U1,0000000000,19700101,"1 Elm, Apt 2",Rome,NY,1,1128,20200101,00000000,,\n,,,Acme,g,s,,123,,,,,,1128,20200101,,,\n,,,,g,,,,,,,,,,,,,\n')
    write(tmp_path / "l", "b.csv", "LASTNAME,FIRSTNAME\nA,B\n")
    out = f.exclusions(spark, path)
    got = {r.primary_name: (r.entity_type, r.status_date, r.npi, r.birth_date, r.address) for r in out["entities"].collect()}
    assert got == {"Jo Q Smith": ("individual", "2020-01-01", "", "1970-01-01", "1 Elm, Apt 2"), "Acme": ("organization", "2020-01-01", "123", None, "")}
    assert [a.alias_name for a in out["aliases"].collect()] == ["Smith, Jo Q"] and sorted((i.kind, i.value) for i in out["identifiers"].collect()) == [("NPI", "123"), ("UPIN", "U1")]
    told = rejects(out)
    assert told[1] == (3, "no name") and told[0][1].startswith("missing columns: midname, busname") and len(told) == 2


def test_sanctions_remarks_run_on(spark, tmp_path):
    paths = [
        write(tmp_path / "s1", "sdn.csv", '36,"AEROLINE",-0- ,CUBA,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,"long rema"\n37,"",x,,,,,,,,,\n38,"SHORT"\n\x1a\n'), write(tmp_path / "s2", "alt.csv", "36,12,aka,AERO LINE,-0-\n99,13,aka,NOBODY,\n36,14,aka,,\n"),
        write(tmp_path / "s3", "add.csv", "36,,Av. 1,Habana,Cuba,-0-\n36,26,-0-,-0-,-0-,x\n"), write(tmp_path / "s4", "c.csv", '36,"rks go on"\n'),
    ]
    out = f.sanctions(spark, *paths, dataset="ofac_sdn", list_name="SDN")
    got = [(r.record_id, r.primary_name, r.entity_type, r.program, r.remarks) for r in out["entities"].collect()]
    assert got == [("36", "AEROLINE", "unknown", "CUBA", "long remarks go on")]
    assert [(a.alias_id, a.alias_name) for a in out["aliases"].collect()] == [("12", "AERO LINE")]
    assert [(a.address_id, a.address_norm) for a in out["addresses"].collect()] == [(hashed("Av. 1", "Habana", "Cuba", ""), "AV 1 HABANA CUBA")]
    assert sorted(r.reason for r in out["rejects"].collect()) == ["no address", "no name", "no name", "of no listed party", "too few fields: 2 of 12"]


def test_audit_files_in_archives(spark, tmp_path):
    folder = tmp_path / "a"
    folder.mkdir()
    with zipfile.ZipFile(folder / "audits.zip", "w") as z:
        z.writestr("general_2021.csv", "Report ID,EIN\nr1,1\n,2\n".encode("utf-8-sig"))
        z.writestr("x/general-2022.csv", "REPORT_ID;x\n")
    (folder / "general_2019.csv").write_bytes("report_id,ein\nr3,é\n".encode("cp1252"))
    out = f.audit_files(spark, f"file://{folder}", {"report_id": (), "ein": ("auditee_ein",)}, ("report_id",))
    rows = out["rows"].collect()
    assert sorted((r.report_id, r.ein, r.file_year) for r in rows) == [("r1", "1", 2021), ("r3", "é", 2019)]
    assert {r.encoding for r in rows} == {"utf-8-sig", "cp1252"} and {r.sha256 for r in rows} == {hashlib.sha256(p.read_bytes()).hexdigest() for p in folder.iterdir()}
    assert sorted((r.member, r.reason) for r in out["rejects"].collect()) == [("general_2021.csv", "no report_id"), ("x/general-2022.csv", "missing columns: report_id")]
