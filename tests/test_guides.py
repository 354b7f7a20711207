"""Tabular guides: what is read, what is left to a person, and overlays of it."""

import pytest

from edigrain.sources import guides

INDEX = """ACME Corp
Heading:
Page Pos. Seg. Name
2 020 BEG Beginning Segment M M 1
2 050 REF Reference Identification O >1
3 310 N1 Party O M 1
9 999 ZZZ Nothing M 1
Page 1 of 5\f"""
BEG = """ACME Corp
BEG
Segment: Beginning Segment
Position: 020
Loop:
Level: Heading
Usage: Mandatory
Max Use: 1
Purpose: To begin
a purchase order
Notes: Send once.
Example follows
BEG|00|SA
Every order.
Data Element Summary
Ref. Data
BEG01 353 Purpose Code M ID 2/2 M
Code telling the purpose
00 Original
05 Replace
this order
BEG03 324 Number M AN 1/22
The number
22 is the most
BEG99 torn row
REF02 127 Reference X AN 1/30 M
Page 2 of 5\f"""
REST = """ACME Corp
REF
Segment: Reference Identification
Position: 050
Loop: N1 Optional
Usage: Mandatory
Data Element Summary
REF01 128 Qualifier M ID 2/3 M
IA Vendor
DP Department
REF02 127 Reference X AN 1/30 M
\f
ACME Corp
Segment: lost
Usage: Mandatory
\f
ACME Corp
PO1
Segment: Line
Position: 010
Usage: Mandatory
Data Element Summary
PO102 330 Quantity X R 1/15 M
PO106 235 Qualifier X ID 2/2 M
UP Code
PO107 234 Value X AN 1/48 M
N1
Segment: Party
Position: 310
Loop: N1 Mandatory
Usage: Perhaps
May 3, 2021"""


@pytest.fixture(scope="module")
def guide(spark):
    files = [("g", INDEX + BEG + REST), ("empty", ""), ("null", None)]
    return guides.Guide(guides.guide_lines(spark.createDataFrame(files, "file_id string, text string")))


def test_segments(guide):
    got = {r.seg_id: (r.name, r.pos, r.max_use, r.loop, r.usage, r.notes) for r in guide.segments().collect()}
    assert got == {
        "BEG": ("Beginning Segment", "020", "1", "", "must_use", "Send once. Every order."), "REF": ("Reference Identification", "050", "", "N1", "must_use", ""),
        "PO1": ("Line", "010", "", "", "must_use", ""), "N1": ("Party", "310", "", "N1", "", ""),
    }


def test_elements_and_codes(guide):
    got = {(r.ref, r.elem_ix, r.usage, r.type, r.longest) for r in guide.elements().where("seg_id = 'BEG'").collect()}
    assert got == {("BEG01", 1, "must_use", "ID", 2), ("BEG03", 3, "must_use", "AN", 22), ("REF02", None, "must_use", "AN", 30)}
    assert {(r.ref, r.code, r["name"]) for r in guide.codes().collect()} == {("BEG01", "00", "Original"), ("BEG01", "05", "Replace this order"), ("REF01", "IA", "Vendor"), ("REF01", "DP", "Department"), ("PO106", "UP", "Code")}


def test_reviews_and_coverage(guide):
    assert sorted((r.what, r.text[:9]) for r in guide.reviews().collect()) == [("code_of_no_list", "22 is the"), ("foreign_element", "REF02 127"), ("no_segment_id", "Segment: "), ("torn_element", "BEG99 tor"), ("unknown_usage", "Usage: Pe")]
    assert [(r.detected, r.confident) for r in guide.coverage().collect()] == [(18, 14)]


def test_cross_check(guide):
    assert {(r.seg_id, r.pos, r.what) for r in guide.cross_check().collect()} == {("ZZZ", "999", "no_block"), ("PO1", "010", "not_listed"), ("REF", "050", "usage"), ("N1", "310", "usage")}


def test_overlay(guide):
    got = {(r.segment, r.elem_ix, tuple(r.codes), r.loop) for r in guide.presence_rules().collect()}
    assert got == {
        ("BEG", 0, (), ""), ("BEG", 1, (), ""), ("BEG", 3, (), ""), ("REF", 0, ("IA", "DP"), "N1"), ("REF", 2, ("IA", "DP"), "N1"),
        ("PO1", 0, (), ""), ("PO1", 2, (), ""), ("PO1", None, ("UP",), ""),
    }


def test_furniture_needs_four_pages(spark):
    lines = guides.guide_lines(spark.createDataFrame([("a", "Head\nx\fHead\ny\fHead"), ("b", "Head\n1\fHead\n2\fHead\nUsage: Mandatory\fEnd\nPage 4")], "file_id string, text string"))
    kept = {(r.file_id, r.text) for r in guides.strip_furniture(lines).collect()}
    assert kept == {("a", "Head"), ("a", "x"), ("a", "y"), ("b", "1"), ("b", "2"), ("b", "Usage: Mandatory"), ("b", "End")}


TEMPLATED = """Contents
BEG Beginning Segment Pos: 020 Max: 1
Heading - Mandatory
Loop: N/A Elements: 2
User Option (Usage): Must use
Partner Note: Once only
BEG09 no row before the summary
Element Summary:
BEG01 353 Purpose Code M ID 2/2 Used
Description: What it is for
Code List Summary (Total Codes: 2)
Code Name
00 Original
05 Replace

06 after a blank line
User Option (Usage): Must use
Insight Note: Of an element
BEG02 92 torn
REF02 127 Reference X AN 1/30 Must use
Pos: 050 Max: >1
Pos: 060 Max: 2
REF Reference Identification (Long
name) Loop: N1 Elements: 1
User Option (Usage): Perhaps
Code List Summary
IA Vendor
Element Summary
REF01 128 Qualifier M ID 2/3 Not Used
Pos: 070 Max: 1
no name
Pos: 080 Max: 1
PER Contact Pos: 080 Max: 1
text Loop: PER
User Option (Usage): Used"""


def test_templated(spark):
    files = spark.createDataFrame([("t", TEMPLATED), ("empty", "")], "file_id string, text string")
    g = guides.TemplatedGuide(guides.guide_lines(files, blank=True))
    assert {(r.seg_id, r.name, r.pos, r.max_use, r.loop, r.usage, r.notes) for r in g.segments().collect()} == {
        ("BEG", "Beginning Segment", "020", "1", "", "must_use", "Once only"), ("REF", "Reference Identification (Long name)", "060", "2", "N1", "", ""), ("PER", "Contact", "080", "1", "PER", "used", ""),
    }
    assert {(r.ref, r.elem_ix, r.usage) for r in g.elements().collect()} == {("BEG01", 1, "must_use"), ("REF02", None, "must_use"), ("REF01", 1, "not_used")}
    assert {(r.ref, r.code, r["name"]) for r in g.codes().collect()} == {("BEG01", "00", "Original"), ("BEG01", "05", "Replace")}
    assert sorted(r.what for r in g.reviews().collect()) == ["code_of_no_element", "foreign_element", "no_segment_name", "no_segment_name", "text_before_loop", "torn_element", "unknown_usage"]
    assert [(r.detected, r.confident) for r in g.coverage().collect()] == [(13, 8)]
    assert {(r.segment, r.elem_ix) for r in g.presence_rules().collect()} == {("BEG", 0), ("BEG", 1)}
    assert g.cross_check().collect() == []


def test_families(spark):
    rows = [("a", TEMPLATED), ("b", INDEX + BEG), ("c", TEMPLATED + "\n" + BEG), ("d", "prose")]
    got = {r.file_id: r.family for r in guides.families(guides.guide_lines(spark.createDataFrame(rows, "file_id string, text string"))).collect()}
    assert got == {"a": "templated", "b": "tabular", "c": None, "d": None}


TERSE = """Data Segment Sequence for the Heading Area
Seg. Req. Max
ID Use Name
BEG Beginning Segment M 1
N1 Name O 1 N1 / 3
N1 Name again M >1
PO1 Baseline C 100000 PO1
GLOSSARY M 1
\fSegment BEG – Beginning Segment
Level Heading
Max Use 1
Comments
BEG*00*SA*123
Send one only.
Example: none
not this
ID ELEMENT NAME FEATURES COMMENTS
BEG01 Purpose Code M ID 2/2 00 = Original
BEG02 Type Code M ID 2/2
“SA” = Stand alone “NE” – New order
some prose
BEG03 Number
AB = no list is open
- 2 -
\fSegment N1 - Name
Max. Use 5
ID ELEMENT NAME FEATURES COMMENTS
N101 Entity Identifier Code M ID 2/3
BY = Buyer
N102 Name N
XX01 Odd O AN 1/9
\fSegment ZZ - Not listed
Purpose none
ID ELEMENT NAME FEATURES COMMENTS"""


def test_terse_guides(spark):
    files = spark.createDataFrame([("a", TERSE), ("b", TERSE.replace("N1 Name again M >1\n", "")), ("none", "Segment: x")], "file_id string, text string")
    g = guides.TerseGuide(guides.guide_lines(files.where("file_id != 'none'")))
    segs = {(r.file_id, r.seg_id): (r.name, r.max_use, r.loop, r.usage, r.notes) for r in g.segments().collect()}
    assert segs["a", "BEG"] == ("Beginning Segment", "1", "", "must_use", "Send one only.") and segs["a", "N1"] == ("Name", "5", "N1", "must_use", "") and segs["b", "N1"][3] == "used" and segs["a", "ZZ"] == ("Not listed", "", "", "", "")
    codes = [(r.ref, r.code, r.name) for r in g.codes().where("file_id = 'a'").orderBy("block", "row", "seq").collect()]
    assert codes == [("BEG01", "00", "Original"), ("BEG02", "SA", "Stand alone"), ("BEG02", "NE", "New order"), ("N101", "BY", "Buyer")]
    els = {r.ref: (r.elem_ix, r.usage, r.type, r.shortest) for r in g.elements().where("file_id = 'a'").collect()}
    assert els == {"BEG01": (1, "must_use", "ID", 2), "BEG02": (2, "must_use", "ID", 2), "N101": (1, "must_use", "ID", 2), "N102": (2, "not_used", "", None), "XX01": (None, "used", "AN", 1)}
    assert sorted((r.what, r.text) for r in g.reviews().where("file_id = 'a'").collect()) == [("foreign_element", "XX01 Odd O AN 1/9"), ("not_in_index", "Segment ZZ - Not listed"), ("torn_element", "BEG03 Number")]
    rules = {(r.segment, r.elem_ix, tuple(r.codes)) for r in g.presence_rules().where("file_id = 'a'").collect()}
    assert rules == {("BEG", 0, ()), ("BEG", 1, ()), ("BEG", 2, ()), ("N1", 0, ("BY",))}
    every = guides.AnyGuides(files)
    assert {r.file_id: r.family for r in every.families.collect()} == {"a": "terse", "b": "terse", "none": None}
    assert every.segments().count() == 6 and [r.what for r in every.reviews().where("file_id = 'none'").collect()] == ["no_family"]
    cover = {r.file_id: (r.detected, r.confident) for r in every.coverage().collect()}
    assert cover["a"] == (13, 11)
