import pytest

from cohortvec.operators.firsts import first_per_key
from cohortvec.sources import rrf
from cohortvec.sources.events import scan_interactions

from .conftest import as_set


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("rrf")
    (root / "MRFILES.RRF").write_text("MRCONSO.RRF|names|CUI,LAT,STR|3|9|99|\nMRCOLS.RRF|cols|COL,DES,FIL|3|9|99|\n")
    (root / "MRCOLS.RRF").write_text(
        "CUI|concept|MRCONSO.RRF|\nLAT|language|MRCONSO.RRF|\nCUI|other file|MRREL.RRF|\n"
    )
    (root / "MRCONSO.RRF").write_text('C1|ENG|a "quoted" name\\|\nC2|FRE|NA|\nC3|ENG||\nC1|ENG|later|\n')
    return str(root)


def test_table_with_metadata_schema(spark, folder):
    df = rrf.read_table(spark, folder, "MRCONSO.RRF")
    assert df.columns == ["CUI", "LAT", "STR"]
    assert as_set(df.fillna("<null>")) == sorted(
        [("C1", "ENG", 'a "quoted" name\\'), ("C2", "FRE", "NA"), ("C3", "ENG", "<null>"), ("C1", "ENG", "later")]
    )


def test_selection_and_filter(spark, folder):
    df = rrf.read_table(spark, folder, "MRCONSO.RRF", columns=["STR", "CUI"], where="LAT = 'FRE'")
    assert df.columns == ["STR", "CUI"] and as_set(df) == [("NA", "C2")]
    with pytest.raises(ValueError):
        rrf.read_table(spark, folder, "MRCONSO.RRF", columns=["NOPE"])
    with pytest.raises(ValueError):
        rrf.read_table(spark, folder, "OTHER.RRF")


def test_broken_lines(spark, folder, tmp_path):
    for name in ("MRFILES.RRF",):
        (tmp_path / name).write_text(open(f"{folder}/{name}").read())
    (tmp_path / "MRCONSO.RRF").write_text("C1|ENG|whole|\nC2|FR\nC3|ENG|too|many|\n")
    with pytest.raises(Exception, match="broken line: C2"):
        rrf.read_table(spark, str(tmp_path), "MRCONSO.RRF", columns=["CUI"]).collect()
    kept = rrf.read_table(spark, str(tmp_path), "MRCONSO.RRF", columns=["CUI"], broken_lines="skip")
    assert as_set(kept) == [("C1",)]


def test_filter_is_below_the_line_numbers(spark, folder):
    df = rrf.read_table(spark, folder, "MRCONSO.RRF", where="LAT = 'ENG'", line_order="line_no")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(LAT,ENG)" in plan
    assert [r.STR for r in df.orderBy("line_no").collect()][-1] == "later"


def test_line_order_drives_first_per_key(spark, folder):
    df = rrf.read_table(spark, folder, "MRCONSO.RRF", line_order="line_no")
    got = {r.CUI: r.STR for r in first_per_key(df, "CUI", "line_no").collect()}
    assert got["C1"].startswith("a ")


def test_descriptions(spark, folder):
    got = rrf.column_descriptions(spark, folder, "MRCONSO.RRF", ["CUI"])
    assert [(r.COL, r.DES) for r in got.collect()] == [("CUI", "concept")]
    assert rrf.column_descriptions(spark, folder, "MRCONSO.RRF").count() == 2


def test_event_scan_reads_two_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([(1, "a", 0.5)], "person_id int, feature_name string, extra double").write.parquet(path)
    log = scan_interactions(spark, path)
    assert log.schema["person_id"].dataType.simpleString() == "bigint" and as_set(log) == [(1, "a")]
    assert "extra" not in log._jdf.queryExecution().toString()
