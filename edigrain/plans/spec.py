"""Mapping specs: rules, conditions, formats and their small grammars."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

ELEMENT = re.compile(r"([A-Z][A-Z0-9]{1,2})(\d{2})")
CONTEXT = re.compile(r"([A-Z][A-Z0-9]{1,2})(?:\[([^\]]+)\])?")
TOKEN = re.compile(r"\s*(?:'([^']*)'|(!=|=|\(|\)|,)|([\w.\[\]]+))")
RULE_TYPES = ("DIRECT", "CODE_LIST", "CONDITIONAL", "CONSTANT", "LOOP_COUNT", "TODO")


class SpecError(ValueError):
    pass


def split_element(text: str) -> tuple[str, int]:
    m = ELEMENT.fullmatch(text)
    if not m:
        raise SpecError(f"not an element reference: {text!r}")
    return m[1], int(m[2])


def split_context(text: str) -> list[tuple[str, str | None]]:
    """[(loop or segment, qualifier)], one entry more for each '>'."""
    out = []
    for part in text.split(">") if text else []:
        m = CONTEXT.fullmatch(part.strip())
        if not m:
            raise SpecError(f"not a loop context: {text!r}")
        out.append((m[1], m[2]))
    return out


@dataclass(frozen=True)
class Format:
    pattern: str | None = None
    implied: int | None = None
    places: int | None = None
    length: tuple[int, int] | None = None
    tolerance: str | None = None
    shift_days: int | None = None


def parse_format(text: str) -> Format:
    own: dict = {}
    for part in filter(None, (p.strip() for p in (text or "").split(";"))):
        key, _, value = part.partition(":")
        try:
            if part.startswith("%"):
                own["pattern"] = part
            elif key in ("implied", "places"):
                own[key] = int(value)
            elif key == "len":
                a, _, b = value.partition("..")
                own["length"] = (int(a), int(b or a))
            elif key == "tol":
                if not re.fullmatch(r"[0-9]*\.?[0-9]+", value):
                    raise ValueError(value)
                own["tolerance"] = value
            elif key == "shift":
                m = re.fullmatch(r"([+-]?\d+)([dw])", value)
                own["shift_days"] = int(m[1]) * (7 if m[2] == "w" else 1)
            else:
                raise SpecError(f"unknown format {part!r}")
        except (ValueError, TypeError) as e:
            raise SpecError(f"bad format {part!r}") from e
    return Format(**own)


@dataclass(frozen=True)
class Test:
    __test__ = False  # no test case, whatever its name
    op: str  # exists, =, !=, in
    name: str
    values: tuple[str, ...] = ()


def parse_condition(text: str) -> tuple[Test, ...]:
    """Tests joined by AND."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise SpecError(f"cannot read {text[at:]!r}")
        tokens.append(("str", m[1]) if m[1] is not None else ("op", m[2]) if m[2] else ("word", m[3]))
        at = m.end()
    out, i = [], 0

    def take(kind: str, value: str | None = None) -> str:
        nonlocal i
        if i >= len(tokens) or tokens[i][0] != kind or value not in (None, tokens[i][1]):
            raise SpecError(f"{text!r}: expected {value or kind}")
        i += 1
        return tokens[i - 1][1]

    while True:
        word = take("word")
        if word.upper() == "EXISTS":
            take("op", "(")
            out.append(Test("exists", take("word")))
            take("op", ")")
        elif i < len(tokens) and tokens[i][0] == "word" and tokens[i][1].upper() == "IN":
            i += 1
            take("op", "(")
            values = [take("str")]
            while i < len(tokens) and tokens[i] == ("op", ","):
                i += 1
                values.append(take("str"))
            take("op", ")")
            out.append(Test("in", word, tuple(values)))
        else:
            op = take("op")
            if op not in ("=", "!="):
                raise SpecError(f"{text!r}: expected = or !=")
            out.append(Test(op, word, (take("str"),)))
        if i == len(tokens):
            return tuple(out)
        if take("word").upper() != "AND":
            raise SpecError(f"{text!r}: expected AND")


def parse_outcome(text: str) -> tuple[str, str | None]:
    text = (text or "SKIP").strip()
    if text in ("SOURCE", "SKIP", "BLANK"):
        return text, None
    m = re.fullmatch(r"'([^']*)'", text)
    if not m:
        raise SpecError(f"not an outcome: {text!r}")
    return "LITERAL", m[1]


@dataclass(frozen=True)
class Rule:
    row_id: str
    source: str | None
    context: str
    target: str
    kind: str
    condition: str = ""
    then: str = ""
    otherwise: str = ""
    default: str | None = None
    code_list: str | None = None
    data_type: str = "string"
    fmt: str = ""

    def __post_init__(self):
        if self.kind not in RULE_TYPES:
            raise SpecError(f"{self.row_id}: unknown rule type {self.kind!r}")
        if self.kind in ("DIRECT", "CODE_LIST") and not self.source:
            raise SpecError(f"{self.row_id}: {self.kind} needs a source field")
        if self.kind == "CODE_LIST" and not self.code_list:
            raise SpecError(f"{self.row_id}: CODE_LIST needs a code list")
        if self.kind == "CONDITIONAL" and not (self.condition and self.then):
            raise SpecError(f"{self.row_id}: CONDITIONAL needs a condition and an outcome")
        if self.kind == "CONSTANT" and self.default is None:
            raise SpecError(f"{self.row_id}: CONSTANT needs a default value")
        parse_format(self.fmt)
        split_context(self.context)
        tests = parse_condition(self.condition) if self.condition else ()
        if ELEMENT.fullmatch(self.source or "") or not self.source:  # inbound: conditions read elements
            for t in tests:
                if "." not in t.name:
                    split_element(t.name)

    @property
    def is_line(self) -> bool:
        return "[]" in self.target or "[]." in (self.source or "")


@dataclass(frozen=True)
class Spec:
    set_code: str
    rules: tuple[Rule, ...]
    code_lists: dict[str, dict[str, str]] = field(default_factory=dict)
    list_path: str = "lines"


def merge(base: Spec, delta: list[tuple[str, Rule | None]], code_lists: dict[str, dict[str, str]]) -> Spec:
    """A partner's delta over a base spec: a rule replaces the one with its row
    id in place, None removes it, a new id is appended; code lists are replaced
    whole. Rules may use lists of either side."""
    rules = {r.row_id: r for r in base.rules}
    for row_id, rule in delta:
        if rule is None:
            if row_id not in rules:
                raise SpecError(f"{row_id} is not in the base spec")
            del rules[row_id]
        else:
            rules[row_id] = rule
    return Spec(base.set_code, tuple(rules.values()), base.code_lists | code_lists, base.list_path)


#: The purchase-order spec of the derived interchanges (see sources/derived.py).
PURCHASE_ORDER = Spec(
    "850",
    (
        Rule("R-01", "BEG01", "", "order.purpose", "CODE_LIST", code_list="PURPOSE"),
        Rule("R-02", "BEG02", "", "order.type", "CODE_LIST", code_list="PO_TYPE"),
        Rule("R-03", "BEG02", "", "order.drop_ship", "CONDITIONAL", "BEG02 = 'DS'", "'Y'", "'N'", fmt="len:1..1"),
        Rule("R-04", "BEG03", "", "order.po_number", "DIRECT", fmt="len:1..22"),
        Rule("R-05", "BEG05", "", "order.po_date", "DIRECT", data_type="date", fmt="%Y-%m-%d"),
        Rule("R-06", None, "", "order.record_type", "CONSTANT", default="PO_INBOUND"),
        Rule("R-07", "REF02", "REF[IA]", "order.vendor", "DIRECT"),
        Rule("R-08", "DTM02", "DTM[002]", "order.due_date", "DIRECT", data_type="date", fmt="%Y-%m-%d;shift:+1w"),
        Rule("R-09", "BEG04", "", "order.release", "DIRECT", default="NONE"),
        Rule("R-10", "N102", "N1[ST]", "ship_to.name", "DIRECT", fmt="len:1..60"),
        Rule("R-11", "N104", "N1[ST]", "ship_to.id", "CONDITIONAL", "N103 = '92'", "SOURCE", "SKIP"),
        Rule("R-12", "N401", "N1[ST]", "ship_to.city", "DIRECT"),
        Rule("R-13", "SAC05", "SAC[A]", "order.allowance", "DIRECT", data_type="decimal", fmt="implied:2;places:2"),
        Rule("R-20", "PO101", "PO1", "lines[].line_no", "DIRECT", data_type="integer"),
        Rule("R-21", "PO102", "PO1", "lines[].qty", "DIRECT", data_type="integer"),
        Rule("R-22", "PO103", "PO1", "lines[].uom", "CODE_LIST", code_list="UOM"),
        Rule("R-23", "PO104", "PO1", "lines[].price", "DIRECT", data_type="decimal", fmt="places:2;tol:0.01"),
        Rule("R-24", "PO107", "PO1", "lines[].part", "CONDITIONAL", "PO106 = 'VP'", "SOURCE", "SKIP"),
        Rule("R-25", "PID05", "PO1", "lines[].text", "CONDITIONAL", "EXISTS(PID05) AND PID01 = 'F'", "SOURCE", "SKIP"),
        Rule("R-30", "CTT01", "", "summary.line_count", "DIRECT", data_type="integer"),
        Rule("R-31", None, "PO1", "summary.line_count", "LOOP_COUNT", data_type="integer"),
        Rule("R-32", "AMT02", "AMT[TT]", "summary.total", "DIRECT", data_type="decimal", fmt="places:2"),
        Rule("R-40", None, "", "order.later", "TODO"),
    ),
    {
        "PURPOSE": {"00": "ORIGINAL", "01": "CANCELLATION", "05": "REPLACE"},
        "PO_TYPE": {"SA": "STANDALONE", "NE": "NEW_ORDER", "DS": "DROP_SHIP"},
        "UOM": {"EA": "EACH", "CA": "CASE", "DZ": "DOZEN"},
    },
)


#: The outbound mirror of some of its rules: documents to the X12 of the orders.
PURCHASE_ORDER_OUT = Spec(
    "850",
    (
        Rule("O-01", "order.po_number", "", "BEG03", "DIRECT", fmt="len:1..22"),
        Rule("O-02", "order.type", "", "BEG02", "CODE_LIST", code_list="PO_TYPE"),
        Rule("O-03", "order.po_date", "", "BEG05", "DIRECT", data_type="date"),
        Rule("O-04", "order.vendor", "REF[IA]", "REF02", "DIRECT"),
        Rule("O-05", "order.allowance", "SAC[A]", "SAC05", "DIRECT", data_type="decimal", fmt="implied:2"),
        Rule("O-06", None, "", "BEG01", "CONSTANT", default="00"),
        Rule("O-07", "lines[]", "", "CTT01", "LOOP_COUNT", data_type="integer"),
        Rule("O-10", "lines[].qty", "PO1", "PO102", "DIRECT", data_type="integer"),
        Rule("O-11", "lines[].uom", "PO1", "PO103", "CODE_LIST", code_list="UOM"),
        Rule("O-12", "lines[].price", "PO1", "PO104", "DIRECT", data_type="decimal", fmt="places:2"),
    ),
    {
        "PO_TYPE": {"STANDALONE": "SA", "NEW_ORDER": "NE", "DROP_SHIP": "DS"},
        "UOM": {"EACH": "EA", "CASE": "CA", "DOZEN": "DZ"},
    },
)
