import pytest

from edigrain.functions.values import spark_pattern
from edigrain.plans.spec import PURCHASE_ORDER, Rule, SpecError, Test, merge, parse_condition, parse_format, parse_outcome, split_context, split_element


def test_addresses():
    assert split_element("BEG03") == ("BEG", 3)
    assert split_element("N102") == ("N1", 2)
    assert split_context("LIN>QTY[QA]") == [("LIN", None), ("QTY", "QA")]
    for bad in ("beg03", "BEG3", ""):
        with pytest.raises(SpecError):
            split_element(bad)


def test_conditions():
    assert parse_condition("BEG02 = 'DS' AND EXISTS(REF02)") == (Test("=", "BEG02", ("DS",)), Test("exists", "REF02"))
    assert parse_condition("N103 IN ('92', '1')") == (Test("in", "N103", ("92", "1")),)
    for bad in ("BEG02", "BEG02 = DS", "A = 'x' OR B = 'y'", "EXISTS(", ""):
        with pytest.raises(SpecError):
            parse_condition(bad)


def test_formats_and_outcomes():
    f = parse_format("implied:2;places:2;len:1..5;tol:0.01;shift:-2w")
    assert (f.implied, f.places, f.length, f.tolerance, f.shift_days) == (2, 2, (1, 5), "0.01", -14)
    assert parse_format("%Y-%m-%d").pattern == "%Y-%m-%d"
    with pytest.raises(SpecError):
        parse_format("wide:3")
    assert parse_outcome("'x'") == ("LITERAL", "x") and parse_outcome("") == ("SKIP", None)
    with pytest.raises(SpecError):
        parse_outcome("bare")
    assert spark_pattern("%m/%d/%Y") == "MM/dd/yyyy"
    with pytest.raises(SpecError):
        spark_pattern("%Q")


def test_rule_checks():
    with pytest.raises(SpecError):
        Rule("X", None, "", "a.b", "DIRECT")
    with pytest.raises(SpecError):
        Rule("X", "BEG01", "", "a.b", "CODE_LIST")
    with pytest.raises(SpecError):
        Rule("X", "BEG01", "", "a.b", "NEW")


def test_delta_merge():
    new = Rule("R-04", "BEG03", "", "order.number", "DIRECT")
    out = merge(PURCHASE_ORDER, [("R-04", new), ("R-40", None), ("P-01", Rule("P-01", None, "", "order.x", "CONSTANT", default="1"))], {"UOM": {"EA": "UNIT"}})
    ids = [r.row_id for r in out.rules]
    assert ids.index("R-04") == 3 and "R-40" not in ids and ids[-1] == "P-01"
    assert out.code_lists["UOM"] == {"EA": "UNIT"} and "PO_TYPE" in out.code_lists
    with pytest.raises(SpecError):
        merge(PURCHASE_ORDER, [("R-99", None)], {})
