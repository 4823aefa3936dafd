from filigree.operators import manifest

SOURCES = "object_id string, filing_id string, relative_path string, source_file string, sha256 string, duplicate_status string, keep_source_file string, quarantine_status string, problem string"
LOADED = "object_id string, filing_id string, source_file string, problem int"


def source(o, path, status="unique", sha="a", keep=None, filing=None, quarantine=None):
    return (o, filing or f"{o}_public", path, path, sha, status, keep, quarantine, "clash")


def chosen(spark, sources, loaded):
    df = manifest.choose(spark.createDataFrame(sources, SOURCES), spark.createDataFrame(loaded, LOADED))
    assert df.columns == ["object_id", "relative_path", "strategy", "problem"]
    return {r.object_id: r.problem or (r.relative_path, r.strategy) for r in df.collect()}


def test_each_choice_and_problem(spark):
    c, p, x = manifest.CONFLICT, manifest.PRIMARY, manifest.COPY
    sources = [
        source("1", ".\\a//1.XML"), source("2", "a/2.xml", p, keep="a/2.xml"), source("2", "b/2.xml", x, keep="a/./2.xml"), source("3", "a/3.xml", c), source("3", "b/3.xml", c), source("4", "a_old/4.xml", c), source("4", "b/4.xml", c),
        source("5", "a/5.xml", c), source("5", "in/a/5.xml", c), source("6", "a/6.xml", c, filing="6_private"), source("7", "../7.xml"), source("8", "C:/8.xml"), source("9", "/9.xml"), source("10", "10.txt"),
        source("11", "11.xml", quarantine="x"), source("12", "12.xml", filing="13_public"), source("13", "a.xml", p, sha=None, keep="a.xml"), source("13", "b.xml", x, sha=None, keep="a.xml"), source("14", "14.xml"),
        source(None, "n.xml"), source("15", None), source("16", "16.xml", None), source("17", "17.xml"), source("18", "18.xml", c),
    ]
    at = {"3": "/in/B/3.xml", "4": "/in/a/4.xml", "5": "/x/in/a/5.xml", "6": "a/6.xml", "18": None}
    loaded = [(str(i), f"{i}_public", at.get(str(i), "q"), 1) for i in (*range(1, 17), 18, 14)] + [(None, "n", "n", 1)]
    assert chosen(spark, sources, loaded) == {
        "1": ("a/1.XML", "unique"), "2": ("a/2.xml", "exact_duplicate_primary"), "3": ("b/3.xml", "loaded_path"), "4": ("a_old/4.xml", "loaded_path_normalized_old"), "5": "conflict_ambiguous", "6": "conflict_other_filing",
        "7": "path_not_relative", "8": "path_not_relative", "9": "path_not_relative", "10": "not_xml", "11": "quarantined", "12": "inconsistent_filing_id", "13": "different_or_unhashed_bytes", "14": "loaded_more_than_once",
        "": "blank_object_id", "15": "path_not_relative", "16": "unresolved_duplicate_status", "17": "not_loaded", "18": "conflict_without_loaded_path",
    }


def test_empty(spark):
    assert chosen(spark, [], []) == {}
    assert chosen(spark, [], [("1", "f", "p", 1)]) == {"1": "no_source"}
