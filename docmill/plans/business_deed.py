"""Notarial deed and ministry decree (EX6, NRM7)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.cleaning import clean_prefix
from docmill.functions.dates import iso_or_text
from docmill.functions.text import drop, rx, strip, text_pattern
from docmill.plans.base import DocSpec, Fields, TextView, strings

# Field names, in record order.
SCHEMA = T.StructType(
    strings(
        "deed_type", "deed_number", "deed_date", "notary_name", "notary_address", "decision_number",
        "decision_issued_date",
    )
)

# Legal formulas and window sizes.
DECREE = (
    r"KEPUTUSAN\s+MENTERI\s+(?:HUKUM\s+DAN\s+HAK\s+ASASI\s+MANUSIA|KEHAKIMAN)\s+REPUBLIK\s+INDONESIA"
    r"\s*\n?\s*NOMOR\s*:?\s*([A-Z0-9][A-Z0-9.\-]*(?:TAHUN|TH)\.?\s*\d{2,4})"
)
DECREE_DATE = r"DITETAPKAN\s*DI\s+[A-Za-z\s]+?[,\n]\s*(?:PADA\s*)?TANGGAL\s*(\d{1,2}\s+\w+\s+\d{4})"
NUMBERED = r"\bNOMOR\s*:?\s*\d{1,5}\s*\."
OPENING = r"PADA\s+HARI\s+INI"
NOTARY = r"BERHADAPAN\s+DENGAN\s+SAYA,?\s*([A-Z][A-Za-z.\s\-]+?),\s*SARJANA\s+HUKUM"
OPENING_WINDOW = 80
DATE_WINDOW = 300
TITLE_WINDOW = 300


def parse(t: TextView) -> list[Fields]:
    # Every "NOMOR n." with the 80 characters behind it; the first one whose window holds the
    # whole opening formula is the deed's own number.  Windows are bounded, so the candidates of
    # a long text never add up to more than a fixed multiple of it.
    openings = F.regexp_extract_all(
        t.text, F.lit(text_pattern(rf"(?=({NUMBERED}.{{0,{OPENING_WINDOW}}})){NUMBERED}", "is")), F.lit(1)
    )
    opening = F.filter(openings, lambda w: F.rlike(w, F.lit(text_pattern(rf"^{NUMBERED}.*{OPENING}", "is"))))
    start = F.instr(t.text, t["opening"])
    after = F.substring(t.text, start + F.length(rx(t["opening"], rf"^{NUMBERED}", 0)), F.lit(DATE_WINDOW))
    title = F.substring(
        t.text, F.greatest(start - TITLE_WINDOW, F.lit(1)), F.least(start - 1, F.lit(TITLE_WINDOW))
    )
    return [
        {
            "decision_number": rx(t.text, DECREE),
            "decision_issued_date": rx(t.text, DECREE_DATE),
            "opening": F.get(opening, 0),
            "notary_name": strip(drop(rx(t.text, NOTARY), r"[\s\-]+", " ")),
        },
        {
            "deed_number": rx(t["opening"], r"^NOMOR\s*:?\s*(\d{1,5})"),
            "after_opening": after,
            "last_type_word": rx(title, "^.*(PENDIRIAN|PERUBAHAN)", 1, "is"),
        },
        {
            "deed_date": rx(t["after_opening"], r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{4})\b"),
            "deed_type": F.initcap(t["last_type_word"]),
        },
    ]


def normalize(raw: Fields) -> Fields:
    kind = F.upper(raw["deed_type"])
    return {
        "deed_type": F.when(F.contains(kind, F.lit("PENDIRIAN")), F.lit("Pendirian")).when(
            F.contains(kind, F.lit("PERUBAHAN")), F.lit("Perubahan")
        ),
        "deed_number": clean_prefix(raw["deed_number"], r"NO\.?\s*AKTA|NOMOR|NO\.?"),
        "deed_date": iso_or_text(raw["deed_date"]),
        "notary_name": clean_prefix(raw["notary_name"], r"NAMA\s*NOTARIS|NOTARIS"),
        "notary_address": clean_prefix(raw["notary_address"], r"ALAMAT\s*NOTARIS|ALAMAT|KANTOR"),
        "decision_number": clean_prefix(raw["decision_number"], r"NOMOR|NO\.?"),
        "decision_issued_date": iso_or_text(raw["decision_issued_date"]),
    }


SPEC = DocSpec(
    slug="business_deed",
    name="Business Deed & SK Kemenkumham",
    description="Notarial deed of a company in Indonesia and the decree that confirms it",
    schema=SCHEMA,
    parse=parse,
    normalize=normalize,
    prompt_subject="a company deed or the approval of one",
    field_rules={
        "deed_type": "Pendirian or Perubahan, from the title of the deed",
        "deed_number": "number of the deed",
        "deed_date": "date of signing as YYYY-MM-DD",
        "notary_name": "name of the notary with titles as printed",
        "notary_address": "office address of the notary",
        "decision_number": "number of the confirming decree",
        "decision_issued_date": "date of the decree as YYYY-MM-DD",
    },
)
