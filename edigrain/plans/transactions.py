"""Transaction definitions: areas, loops, pairing and reconciliation of X12 sets.

A definition is plain data. An area has an opening segment (none for the first),
flat segments and loops; a loop has a trigger, member segments and, at most one
level deep, child loops. Operands of a reconciliation rule are

    ("value", "CTT01"[, context])      ("count", "PO1")
    ("sum", "HL[I]", "SN102")          ("product", "IT1", "IT102", "IT104")
    ("combine", [added ...], [subtracted ...])

and may carry implied decimals as ("implied", n, operand).
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Loop:
    trigger: str
    segments: tuple[str, ...] = ()
    max_repeats: int | None = None
    children: tuple["Loop", ...] = ()
    levels: dict[str, tuple[str, ...]] | None = None  # level code -> allowed child levels


@dataclass(frozen=True)
class Area:
    name: str
    segments: tuple[str, ...] = ()
    opener: str | None = None
    loops: tuple[Loop, ...] = ()


@dataclass(frozen=True)
class Recon:
    rule: str
    left: tuple
    right: tuple
    check: str = "equals"
    when: tuple | None = None
    severity: str = "WARNING"


@dataclass(frozen=True)
class Presence:
    """What must be there: a segment (element 0) at least once, or an element in each
    of its occurrences. Occurrences count if element `at` holds one of `codes`, if
    they lie in `loop` (N1, or N1[ST] for one qualifier), and if element `when` has a
    value, one of `values` if any are given."""

    segment: str
    element: int = 0
    codes: tuple[str, ...] = ()
    at: int = 1
    loop: str = ""
    when: int = 0
    values: tuple[str, ...] = ()
    origin: str = "base"

    @property
    def label(self) -> str:
        """REF, REF02, REF*IA or REF*{IA|DP}."""
        own = f"{self.segment}{self.element:02d}" if self.element else self.segment
        if not self.codes:
            return own
        return f"{own}*{self.codes[0]}" if len(self.codes) == 1 else f"{own}*{{{'|'.join(self.codes)}}}"


@dataclass(frozen=True)
class Definition:
    set_code: str
    name: str
    group: str
    areas: tuple[Area, ...]
    line_loop: str
    recon: tuple[Recon, ...] = ()
    required_elements: tuple[tuple, ...] = ()  # (segment, element[, when this element is present])
    version: str = "004010"
    extra: dict = field(default_factory=dict)


def _ctt(loop: str) -> Recon:
    return Recon("ctt-line-count", ("value", "CTT01"), ("count", loop), when=("value", "CTT01"))


# Fixed values, here and in DEFINITIONS: set codes, groups, loops and segments of a
# commonly used subset of the public X12 structures of these sets.
PARTY = Loop("N1", ("N2", "N3", "N4", "NX2", "REF", "PER", "SI", "FOB", "TD1", "TD5", "TD3", "TD4", "PKG"), 200)
PARTY_W = Loop("N1", ("N2", "N3", "N4", "PER"), 10)
PARTY10 = Loop("N1", ("N2", "N3", "N4", "REF", "PER"), 10)

DEFINITIONS = {
    d.set_code: d
    for d in (
        Definition("850", "Purchase Order", "PO", (
            Area("header", ("BEG", "CUR", "REF", "PER", "TAX", "FOB", "CTP", "PAM", "CSH", "TC2", "SAC", "ITD", "DIS", "INC", "DTM", "LIN", "SI", "PID", "MEA", "PWK", "PKG", "TD1", "TD5", "TD3", "TD4", "MAN", "PCT", "CTB", "TXI", "N9", "MSG"), loops=(PARTY,)),
            Area("detail", opener="PO1", loops=(Loop("PO1", ("LIN", "SI", "CUR", "CN1", "PO3", "CTP", "PAM", "MEA", "PID", "PWK", "PO4", "REF", "PER", "SAC", "IT8", "CSH", "ITD", "DIS", "INC", "TAX", "FOB", "SDQ", "IT3", "DTM", "TC2", "TD1", "TD5", "TD3", "TD4", "PCT", "MAN", "MSG", "AMT", "N9", "N1", "N2", "N3", "N4", "SLN"), 100000),)),
            Area("summary", ("CTT", "AMT"), opener="CTT"),
        ), "PO1", (_ctt("PO1"),), (("BEG", 3), ("PO1", 2, 3))),
        Definition("855", "Purchase Order Acknowledgment", "PR", (
            Area("header", ("BAK", "CUR", "REF", "PER", "TAX", "FOB", "CTP", "SAC", "ITD", "DIS", "INC", "DTM", "PID", "MEA", "PWK", "PKG", "TD1", "TD5", "TD3", "TD4", "MAN", "TXI", "N9", "MSG"), loops=(PARTY,)),
            Area("detail", opener="PO1", loops=(Loop("PO1", ("LIN", "SI", "CUR", "PO3", "CTP", "PAM", "MEA", "PID", "PWK", "PO4", "REF", "PER", "SAC", "IT8", "ITD", "DIS", "INC", "TAX", "FOB", "SDQ", "IT3", "DTM", "TC2", "TD1", "TD5", "TD3", "TD4", "MAN", "MSG", "ACK", "AMT", "N9", "N1", "N2", "N3", "N4", "SLN"), 100000),)),
            Area("summary", ("CTT", "AMT"), opener="CTT"),
        ), "PO1", (_ctt("PO1"), Recon("ack-qty-accounted", ("sum", "PO1", "ACK02"), ("sum", "PO1", "PO102")))),
        Definition("810", "Invoice", "IN", (
            Area("header", ("BIG", "NTE", "CUR", "REF", "PER", "ITD", "DTM", "FOB", "PID", "MEA", "PWK", "PKG", "L7", "BAL", "INC", "PAM"), loops=(Loop("N1", ("N2", "N3", "N4", "REF", "PER", "DMG"), 200),)),
            Area("detail", opener="IT1", loops=(Loop("IT1", ("CRC", "QTY", "CUR", "IT3", "TXI", "CTP", "PAM", "MEA", "PID", "PWK", "PKG", "PO4", "ITD", "REF", "PER", "SDQ", "DTM", "CAD", "SAC", "SLN", "TC2"), 200000),)),
            Area("summary", ("TDS", "TXI", "CAD", "AMT", "ISS", "CTT"), opener="TDS", loops=(Loop("SAC", ("TXI",), 25),)),
        ), "IT1", (_ctt("IT1"), Recon("tds-invoice-total", ("implied", 2, ("value", "TDS01")), ("combine", [("product", "IT1", "IT102", "IT104"), ("implied", 2, ("sum", "SAC[C]", "SAC05"))], [("implied", 2, ("sum", "SAC[A]", "SAC05"))]), when=("value", "TDS01")))),
        Definition("856", "Ship Notice/Manifest", "SH", (
            Area("header", ("BSN", "DTM")),
            Area("detail", opener="HL", loops=(Loop("HL", ("TD1", "TD5", "TD3", "TD4", "REF", "PER", "DTM", "FOB", "MAN", "PRF", "PID", "MEA", "PAL", "PO4", "LIN", "SN1", "SLN"), 200000, (Loop("N1", ("N2", "N3", "N4", "REF", "PER", "FOB")),), {"S": ("O",), "O": ("T", "P", "I"), "T": ("P", "I"), "P": ("I",), "I": ()}),)),
            Area("summary", ("CTT", "AMT"), opener="CTT"),
        ), "HL[I]", (
            Recon("ctt-hl-count", ("value", "CTT01"), ("count", "HL"), when=("value", "CTT01")),
            Recon("ctt02-unit-sum", ("value", "CTT02"), ("sum", "HL[I]", "SN102"), when=("value", "CTT02")),
            Recon("td1-carton-count", ("value", "TD102", "HL[S]"), ("count", "HL[P]"), when=("value", "TD102", "HL[S]")),
        )),
        Definition("812", "Credit/Debit Adjustment", "CD", (
            Area("header", ("BCD", "CUR", "REF", "DTM", "PER", "ITD"), loops=(PARTY10,)),
            Area("detail", opener="CDD", loops=(Loop("CDD", ("LIN", "PID", "REF", "DTM", "QTY", "AMT"), 10000),)),
        ), "CDD", (Recon("bcd-total-foots", ("value", "BCD04"), ("sum", "CDD", "CDD04"), when=("value", "BCD04")),)),
        Definition("845", "Price Authorization Acknowledgment/Status", "PA", (
            Area("header", ("BGN", "CUR", "REF", "DTM", "PER"), loops=(PARTY10,)),
            Area("detail", opener="LIN", loops=(Loop("LIN", ("CTP", "QTY", "REF", "PID", "DTM"), 100000),)),
        ), "LIN", (Recon("auth-window-sane", ("value", "DTM02", "DTM[007]"), ("value", "DTM02", "DTM[036]"), "not_after", ("value", "DTM02", "DTM[036]")),)),
        Definition("867", "Product Transfer and Resale Report", "PT", (
            Area("header", ("BPT", "CUR", "DTM", "REF", "PER", "QTY"), loops=(PARTY10,)),
            Area("detail", opener="PTD", loops=(Loop("PTD", ("LIN", "UIT", "CTP", "QTY", "AMT", "PID", "REF", "DTM", "MAN"), 100000),)),
            Area("summary", ("CTT",), opener="CTT"),
        ), "PTD", (_ctt("PTD"), Recon("total-qty", ("value", "QTY02", "QTY[TO]"), ("sum", "PTD", "QTY02"), when=("value", "QTY02", "QTY[TO]")))),
        Definition("945", "Warehouse Shipping Advice", "SW", (
            Area("header", ("W06", "N9", "G61", "G62", "W27", "W10", "W28", "W29"), loops=(PARTY_W,)),
            Area("detail", opener="LX", loops=(Loop("LX", ("W12", "G69", "N9", "QTY", "AMT"), 10000),)),
            Area("summary", ("W03",), opener="W03"),
        ), "LX", (
            Recon("w03-shipped-sum", ("value", "W0301"), ("sum", "LX", "W1203"), when=("value", "W0301")),
            Recon("short-ship-declared", ("combine", [("sum", "LX", "W1202")], [("sum", "LX", "W1203")]), ("sum", "LX", "W1204")),
        )),
        Definition("997", "Functional Acknowledgment", "FA", (
            Area("header", ("AK1", "AK9"), loops=(Loop("AK2", ("AK3", "AK4", "AK5"), 999999),)),
        ), "AK2", (
            Recon("accepted-lte-received", ("value", "AK904"), ("value", "AK903"), "not_greater", ("value", "AK904")),
            Recon("received-lte-included", ("value", "AK903"), ("value", "AK902"), "not_greater", ("value", "AK903")),
        )),
        Definition("844", "Product Transfer Account Adjustment", "CF", (
            Area("header", ("BGN", "CUR", "REF", "DTM", "AMT", "PER"), loops=(PARTY10,)),
            Area("detail", opener="LIN", loops=(Loop("LIN", ("QTY", "CTP", "AMT", "REF", "PID", "DTM"), 100000),)),
        ), "LIN", (Recon("request-total", ("value", "AMT02", "AMT[TT]"), ("sum", "LIN", "AMT02"), when=("value", "AMT02", "AMT[TT]")),)),
        Definition("846", "Inventory Inquiry/Advice", "IB", (
            Area("header", ("BIA", "CUR", "DTM", "REF", "PER"), loops=(PARTY10,)),
            Area("detail", opener="LIN", loops=(Loop("LIN", ("PID", "MEA", "DTM", "QTY", "UIT", "REF", "MAN", "SLN"), 100000),)),
            Area("summary", ("CTT",), opener="CTT"),
        ), "LIN", (_ctt("LIN"),)),
        Definition("849", "Response to Product Transfer Account Adjustment", "CF", (
            Area("header", ("BGN", "CUR", "REF", "DTM", "AMT", "PER"), loops=(PARTY10,)),
            Area("detail", opener="LIN", loops=(Loop("LIN", ("QTY", "CTP", "AMT", "LQ", "REF", "PID", "DTM"), 100000),)),
        ), "LIN", (Recon("approved-total", ("value", "AMT02", "AMT[TT]"), ("sum", "LIN", "AMT02"), when=("value", "AMT02", "AMT[TT]")),)),
        Definition("854", "Shipment Delivery Discrepancy Information", "AB", (
            Area("header", ("BGN", "REF", "DTM", "PER"), loops=(PARTY10,)),
            Area("detail", opener="LIN", loops=(Loop("LIN", ("QTY", "LQ", "REF", "PID", "DTM"), 100000),)),
            Area("summary", ("CTT",), opener="CTT"),
        ), "LIN", (_ctt("LIN"),)),
        Definition("940", "Warehouse Shipping Order", "OW", (
            Area("header", ("W05", "N9", "G61", "G62", "W09", "W66", "W6", "R2", "BNX", "NTE"), loops=(PARTY_W,)),
            Area("detail", opener="W01", loops=(Loop("W01", ("G69", "N9", "W20", "QTY", "AMT"), 10000),)),
            Area("summary", ("W76",), opener="W76"),
        ), "W01"),
        Definition("943", "Warehouse Stock Transfer Shipment Advice", "AR", (
            Area("header", ("W06", "N9", "G61", "G62", "W27", "W28"), loops=(PARTY_W,)),
            Area("detail", opener="W04", loops=(Loop("W04", ("G69", "N9", "QTY"), 10000),)),
            Area("summary", ("W03",), opener="W03"),
        ), "W04", (Recon("w03-transfer-sum", ("value", "W0301"), ("sum", "W04", "W0401"), when=("value", "W0301")),)),
        Definition("944", "Warehouse Stock Transfer Receipt Advice", "RE", (
            Area("header", ("W17", "N9", "G61", "G62", "W08", "W28"), loops=(PARTY_W,)),
            Area("detail", opener="W07", loops=(Loop("W07", ("G69", "N9", "QTY"), 10000),)),
            Area("summary", ("W14",), opener="W14"),
        ), "W07", (Recon("w14-receipt-sum", ("value", "W1401"), ("sum", "W07", "W0701"), when=("value", "W1401")),)),
        Definition("947", "Warehouse Inventory Adjustment Advice", "AW", (
            Area("header", ("W15", "N9", "G61", "G62"), loops=(PARTY_W,)),
            Area("detail", opener="W19", loops=(Loop("W19", ("G69", "N9", "QTY"), 10000),)),
        ), "W19"),
    )
}
