"""Masked text byte for byte, diffs of runs with themselves, surplus lines."""

import hashlib

from pyspark.sql import functions as F

from edigrain.operators import history, judge, scrub, structure
from edigrain.plans.spec import PURCHASE_ORDER
from edigrain.plans.transactions import DEFINITIONS

HEAD = "ISA*00*          *00*          *ZZ*SENDER         *ZZ*RECEIVER       *260101*1200*U*00401*000000001*0*P*>~"
BODY = "\nGS*PO*SENDER*RECEIVER*20260101*1200*1*X*004010~\r\nN1*ST*Ann*92*7~ N1*BT~\tN1~REF*IA*ab-12~REF*DP*ab-12~N2*Ann~~\n"


def stream(salt, value):
    buf = hashlib.sha256(f"{salt}\0{value}".encode()).digest()
    while True:
        yield from buf
        buf = hashlib.sha256(buf).digest()


def fake(salt, value):
    s = stream(salt, value)
    return "".join(str(next(s) % 10) if c.isdigit() else chr(65 + next(s) % 26) if c.isalpha() else c for c in value)


def test_masked_text(spark):
    rows = [("plain", HEAD + BODY), ("odd", (HEAD + BODY).translate(str.maketrans("*~", "|'")).replace("Ann", "A*n~n")), ("bom", "﻿junk" + HEAD + BODY), ("none", "no header"), ("short", "ISA*00"), ("null", None), ("star", (HEAD + BODY).translate(str.maketrans("*~", "*+")))]
    masks = [scrub.Mask("N1", 2), scrub.Mask("REF", 2, "pseudonymize", when=(1, ("IA",))), scrub.Mask("N2", 1, "pseudonymize"), scrub.Mask("N4", 1)]
    got = {r.file_id: r for r in scrub.scrub_text(spark.createDataFrame(rows, "file_id string, text string"), masks, "s").collect()}
    want = HEAD + BODY
    for a, b in (("SENDER         ", fake("s", "SENDER         ")), ("RECEIVER       ", fake("s", "RECEIVER       ")), ("GS*PO*SENDER*RECEIVER", f"GS*PO*{fake('s', 'SENDER')}*{fake('s', 'RECEIVER')}"), ("N1*ST*Ann", "N1*ST*XXX"), ("REF*IA*ab-12", f"REF*IA*{fake('s', 'ab-12')}"), ("N2*Ann", f"N2*{fake('s', 'Ann')}")):
        want = want.replace(a, b)
    assert got["plain"].text == want and got["plain"].n_masked == 7
    assert got["bom"].text == "﻿junk" + want
    assert got["star"].text == want.translate(str.maketrans("*~", "*+"))
    odd = want.translate(str.maketrans("*~", "|'")).replace("XXX", "X*X~X").replace(f"N2|{fake('s', 'Ann')}", f"N2|{fake('s', 'A*n~n')}")
    assert got["odd"].text == odd
    assert all(got[k].text is None and got[k].n_masked is None for k in ("none", "short", "null"))
    same = scrub.scrub_text(spark.createDataFrame(rows[:2], "file_id string, text string"), [], envelope=False).collect()
    assert {r.file_id: r.text for r in same} == dict(rows[:2])


def test_a_run_equals_itself(spark):
    rows = [(1, "FAIL", "x", "R-1", "BEG01", "a", "e", "b"), (None, "FAIL", "control", None, "(envelope) F1", None, "3", "4"), (None, "FAIL", "control", None, "(envelope) F1", None, "5", "6"), (None, "PASS", None, None, "(envelope) F2", None, None, None)]
    kind = "doc long, status string, category string, row_id string, source_ref string, target string, expected string, actual string"
    run, none = spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)
    assert history.diff(run, run).count() == 0 and history.diff(none, none).count() == 0
    got = {(r.doc, r.kind, r.place, r.nth, r.regression) for r in history.diff(run.where("doc is not null"), run).collect()}
    assert got == {(None, "NEW", "(envelope) F1", 1, True), (None, "NEW", "(envelope) F1", 2, True)}
    got = {(r.doc, r.kind, r.place, r.regression) for r in history.diff(run, run.where("doc is null and expected != '5'")).collect()}
    assert got == {(1, "DOC REMOVED", None, True), (None, "RESOLVED", "(envelope) F1", False)}


def test_surplus_lines(spark):
    segs = [(1, i, s.split("*")[0], s.split("*")[1:]) for i, s in enumerate("ST*850*1~BEG*00*SA*P*~PO1*1*5*EA*2**VP*77~PID*F****text~CTT*1~SE*5*1".split("~"))]
    placed = structure.place(spark.createDataFrame(segs, "doc long, seq long, seg_id string, elements array<string>"), DEFINITIONS["850"])
    text = '{"lines": [{"line_no": 1, "qty": 5, "uom": "EACH", "price": 2.00, "part": "77", "text": "text"}, {"qty": 6, "uom": null}]}'
    docs = spark.createDataFrame([(1, text)], "doc long, text string").select("doc", F.try_parse_json("text").alias("v"))
    got = {(r.row_id, r.line_ix, r.status, r.category, r.source_ref) for r in judge.line_findings(placed, docs, PURCHASE_ORDER, DEFINITIONS["850"]).where("line_ix = 1").collect()}
    assert got == {(k, 1, "FAIL", "count_mismatch", "PO1 #2 (absent)") for k in ("R-21", "R-22")}
