import json

import pytest

from disclosight.sources import documents, house_index, rosters, senate_index


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


MEMBER = ("<Member><Prefix /><Last> Doe </Last><First>Ann</First><Suffix>Jr.</Suffix><FilingType>P</FilingType><StateDst>MI04</StateDst>"
          "<Year>{year}</Year><FilingDate>{date}</FilingDate><DocID>{doc}</DocID></Member>")


def xml(*members, root="FinancialDisclosure"):
    return f'<?xml version="1.0"?>\n<{root}>' + "".join(members) + f"</{root}>"


def test_house_xml(spark, tmp_path):
    path = put(tmp_path / "a.xml", xml(MEMBER.format(year=2025, date="3/24/2025", doc="40003749"), MEMBER.format(year=2025, date="", doc="8")))
    rows = house_index.strict(house_index.read_xml(spark, path)).orderBy("doc_id").collect()
    assert (rows[0]["last"], rows[0]["prefix"], rows[0]["suffix"], str(rows[0]["filing_date"])) == ("Doe", "", "Jr.", "2025-03-24")
    assert rows[1]["filing_date"] is None and rows[1]["year"] == 2025


def test_house_xml_problems(spark, tmp_path):
    path = put(tmp_path / "a.xml", xml(MEMBER.format(year="20x", date="", doc="1"), MEMBER.format(year=2025, date="", doc=" ")))
    rows = house_index.read_xml(spark, path)
    assert sorted(r["problem"] for r in rows.collect()) == ["invalid Year", "missing DocID"]
    with pytest.raises(Exception, match="index row"):
        house_index.strict(rows).collect()
    other = put(tmp_path / "b.xml", xml(root="Other"))
    assert [r["root"] for r in house_index.check_xml_roots(spark, other).collect()] == ["Other"]
    assert house_index.check_xml_roots(spark, path).count() == 0
    other = put(tmp_path / "c.xml", xml(MEMBER.format(year=2025, date="", doc="1"), root="Other"))
    assert "unexpected root element Other" in [r["problem"] for r in house_index.read_xml(spark, other).collect()]
    with pytest.raises(Exception, match="unexpected root element"):
        house_index.strict(house_index.read_xml(spark, other)).collect()


def test_years_without_a_listing(spark, tmp_path):
    path = put(tmp_path / "a.xml", xml(MEMBER.format(year=2025, date="", doc="1")))
    header = "Prefix\tLast\tFirst\tSuffix\tFilingType\tStateDst\tYear\tFilingDate\tDocID"
    text = put(tmp_path / "b.txt", header + "\n\tDoe\tAnn\t\tP\tMI04\t2024\t\t7\n\tDoe\tAnn\t\tP\tMI04\t2025\t\t8\n")
    years = spark.createDataFrame([(2023,), (2024,), (2025,)], "year int")
    rows = house_index.prefer_xml(house_index.read_xml(spark, path), house_index.read_tsv(spark, text), years)
    assert sorted((r["year"], r["doc_id"], r["problem"]) for r in rows.collect()) == [
        (2023, None, "no listing of 2023"), (2024, "7", None), (2025, "1", None)]
    with pytest.raises(Exception, match="no listing of 2023"):
        house_index.strict(rows).collect()


def test_senators_fail_closed(spark, tmp_path):
    member = "<member><last_name>Arm</last_name><first_name>Al</first_name><state>OK</state></member>"
    page = lambda name, root, body: put(tmp_path / name, f'<?xml version="1.0"?>\n<{root}>{body}</{root}>')
    assert senate_index.read_senators(spark, page("a.xml", "contact_information", member)).count() == 1
    with pytest.raises(ValueError, match="unexpected root"):
        senate_index.read_senators(spark, page("b.xml", "other", member))
    with pytest.raises(ValueError, match="no senators"):
        senate_index.read_senators(spark, page("c.xml", "contact_information", ""))


def test_house_tsv(spark, tmp_path):
    header = "Prefix\tLast\tFirst\tSuffix\tFilingType\tStateDst\tYear\tFilingDate\tDocID"
    path = put(tmp_path / "a.txt", "﻿" + header + "\nHon.\tDoe\tAnn\t\tP\tMI04\t2025\t13/01/2025\t7\n")
    (row,) = house_index.strict(house_index.read_tsv(spark, path)).collect()
    assert (row["prefix"], row["suffix"], row["filing_date"], row["doc_id"]) == ("Hon.", "", None, "7")
    with pytest.raises(ValueError):
        house_index.read_tsv(spark, put(tmp_path / "b.txt", "Prefix\tLast\nA\tB\n"))


def listing(*rows, **extra):
    return json.dumps({"draw": 1, "recordsTotal": len(rows), "data": list(rows), **extra})


def test_senate_listing(spark, tmp_path):
    link = '<a href="/search/view/{}/{}/" target="_blank">Report</a>'
    path = put(tmp_path / "p" / "1.json", listing(
        ["Al", "Arm", "Arm, Alan (Senator)", link.format("ptr", "u-1"), "07/21/2026"], ["Al", "Arm", "Senator", link.format("paper", "77"), "x"],
        ["Al", "Arm", "", "<a>none</a>", ""], ["short"]))
    put(tmp_path / "p" / "2.json", '{"recordsTotal": 0}')
    rows = senate_index.read_listing(spark, str(tmp_path / "p")).collect()
    good = {r["doc_id"]: r for r in rows if r["problem"] is None}
    assert (good["u-1"]["first"], good["u-1"]["view_kind"]) == ("Alan", "electronic")
    assert (good["77"]["first"], good["77"]["view_kind"], good["77"]["filing_date"]) == ("Al", "paper", None)
    assert sorted(r["problem"] for r in rows if r["problem"]) == ["no data array", "unexpected row shape", "unrecognised link"]


def test_senators_keep_the_last_entry(spark, tmp_path):
    m = "<member><last_name>Peña</last_name><first_name>Al</first_name><state>{}</state></member>"
    path = put(tmp_path / "s.xml", xml(m.format("AA"), m.format("BB"), root="contact_information"))
    assert [tuple(r) for r in senate_index.read_senators(spark, path).collect()] == [("pena", "al", "BB")]
    with pytest.raises(Exception, match="senator entry"):
        senate_index.read_senators(spark, put(tmp_path / "t.xml", xml(m.format(""), root="contact_information"))).collect()


GOOD = {"bioguide_id": "A1", "last_name": "Doe", "first_name": "Ann", "state": "MI", "terms": [{"start": "2001-01-03", "end": None, "district": 4}]}


def test_house_roster(spark, tmp_path):
    path = put(tmp_path / "r.json", json.dumps({"members": [GOOD, {**GOOD, "bioguide_id": "A2", "last_name_alts": [" B Doe "]}]}))
    rows = {r["bioguide_id"]: r for r in rosters.read_house_roster(spark, path).collect()}
    assert rows["A1"]["given_name"] == "Ann" and rows["A1"]["last_name_alts"] == [] and rows["A2"]["last_name_alts"] == ["B Doe"]


@pytest.mark.parametrize("change", [
    {"last_name": ""}, {"terms": []}, {"last_name_alt": "x"}, {"last_name_alts": [" "]}, {"terms": [{"start": "2001-13-03", "district": 1}]},
    {"terms": [{"start": "2001-01-03", "end": "", "district": 1}]}, {"terms": [{"start": "2001-01-03"}]}])
def test_house_roster_fails_closed(spark, tmp_path, change):
    path = put(tmp_path / "r.json", json.dumps({"members": [{**GOOD, **change}]}))
    with pytest.raises(Exception, match="roster member"):
        rosters.read_house_roster(spark, path).collect()


def test_empty_or_malformed_roster_fails(spark, tmp_path):
    for text in ('{"members": []}', "{not json"):
        with pytest.raises(Exception, match="roster snapshot"):
            rosters.read_senate_roster(spark, put(tmp_path / "r.json", text)).collect()


def test_document_files(spark, tmp_path):
    put(tmp_path / "docs" / "20001.txt", "a\nb")
    put(tmp_path / "docs" / "x-1.html", "<p>")
    rows = documents.read_documents(spark, str(tmp_path / "docs")).collect()
    assert {(r["doc_id"], r["body"], r["path"].rpartition("/")[2]) for r in rows} == {("20001", "a\nb", "20001.txt"), ("x-1", "<p>", "x-1.html")}


def test_one_version_per_landed_document(spark, tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()
    for name, body in (("x.txt", "second words"), ("x.html", "first words"), ("y.txt", "same"), ("z.txt", "")):
        (folder / name).write_text(body)
    landed = documents.read_documents(spark, str(folder))
    rows = {r["doc_id"]: r for r in documents.first_landed(landed).collect()}
    assert (rows["x"]["body"], rows["x"]["landed"], rows["x"]["conflict"]) == ("first words", 2, True)
    assert rows["x"]["path"].endswith("x.html") and (rows["y"]["landed"], rows["y"]["conflict"]) == (1, False)


def test_versions_do_not_depend_on_arrival(spark):
    rows = [("a", "k", "long body", "p2"), ("a", "k", "b2", "p1"), ("a", "k", "b1", "p1"), ("b", "k", None, None), ("b", "k", "", None), ("c", "k", "t", "p")] + [("d", "k", "same", "q")] * 50
    frame = spark.createDataFrame(rows, "doc_id string, source string, body string, path string")
    for parts in (1, 7):
        got = sorted(documents.first_landed(frame.repartition(parts), "source").collect())
        assert [(r["doc_id"], r["body"], r["path"], r["landed"], r["conflict"]) for r in got if r["doc_id"] != "a"] == [
            ("b", None, None, 2, True), ("c", "t", "p", 1, False), ("d", "same", "q", 50, False)]
        assert got[0]["body"] in ("b1", "b2") and got[0]["landed"] == 3 and got[0]["conflict"]
    no_path = documents.first_landed(frame.drop("path", "source"))
    assert no_path.filter("doc_id = 'a'").first()["body"] in ("b1", "b2") and no_path.count() == 4
