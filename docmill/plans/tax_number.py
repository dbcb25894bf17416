"""Taxpayer card (EX2, NRM2)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.cleaning import clean_prefix, tax_id
from docmill.functions.dates import iso_or_text
from docmill.functions.labels import strip_label
from docmill.functions.text import blank_to_null, drop, has, line_pattern, line_rx, rx, strip
from docmill.plans.base import DocSpec, Fields, TextView, strings

# Field names, in record order.
SCHEMA = T.StructType(
    strings("tax_number", "business_name", "tax_office", "tax_office_address", "tax_registration_date")
)

# Printed words and patterns of the card.
NAME_LABEL = r"(?:NAMA\s*(?:WAJIB\s*PAJAK)?|NAME)"
OFFICE_LABEL = r"(?:KANTOR\s*PELAYANAN\s*PAJAK|KPP)"
ADDRESS_LABEL = r"(?:ALAMAT|ADDRESS)"
DATE_LABEL = r"(?:TANGGAL\s*TERDAFTAR|TGL\s*DAFTAR|REGISTRATION\s*DATE)"
FORMATTED = r"\b(\d{2}[\.\s]\d{3}[\.\s]\d{3}[\.\s][0-9OobB][-\s]\d{3}(?:[\.\s]\d{3})?)\b"
LABELLED = r"NPWP\s*[:\.]?\s*([0-9OobB\.\-\s]{15,25})"
CARD_DATE = r"\d{2}[-/.]\d{2}[-/.]\d{4}"
NOT_A_NAME = r"\b(?:KPP|ALAMAT|TERDAFTAR|NPWP)\b"


def _name_in_order(body, number):
    """The first line, from the top, that names the holder: by label, or as the line below the id."""
    lines = F.split(body, "\n")
    labelled = line_pattern(rf"^(?>{NAME_LABEL}\s*[:.]?\s*)(\S.*)$")

    def candidate(line, i):
        below = F.get(lines, i + 1)
        return F.coalesce(
            blank_to_null(F.regexp_extract(line, labelled, 1)),
            F.when(F.contains(line, number) & ~has(below, NOT_A_NAME), below),
        )

    return F.get(F.filter(F.transform(lines, candidate), lambda x: x.isNotNull()), 0)


def parse(t: TextView) -> list[Fields]:
    return [
        {
            "tax_number": F.coalesce(
                F.replace(rx(t.text, FORMATTED, flags=""), F.lit(" "), F.lit("")),
                strip(rx(t.text, LABELLED)),
                rx(t.text, r"\b([0-9]{15,16})\b"),
            ),
            "office_line": line_rx(t.body, rf"^.*\b{OFFICE_LABEL}\b.*$", 0),
            "tax_office_address": strip_label(t.body, ADDRESS_LABEL),
            "tax_registration_date": F.translate(
                F.coalesce(
                    rx(t.text, rf"{DATE_LABEL}\s*[:\.]?\s*({CARD_DATE})"), rx(t.text, rf"\b({CARD_DATE})\b")
                ),
                "/.",
                "--",
            ),
        },
        {
            "tax_office": strip(drop(t["office_line"], rf"^.*{OFFICE_LABEL}\s*[:\.]?\s*", "KPP ")),
            "business_name": _name_in_order(t.body, blank_to_null(t["tax_number"])),
        },
    ]


def normalize(raw: Fields) -> Fields:
    return {
        "tax_number": tax_id(raw["tax_number"], "NPWP"),
        "business_name": clean_prefix(raw["business_name"], NAME_LABEL),
        "tax_office": clean_prefix(raw["tax_office"], OFFICE_LABEL, "KPP "),
        "tax_office_address": clean_prefix(raw["tax_office_address"], ADDRESS_LABEL),
        "tax_registration_date": iso_or_text(drop(strip(raw["tax_registration_date"]), rf"^{DATE_LABEL}\s*[:\.]?\s*")),
    }


SPEC = DocSpec(
    slug="tax_number",
    name="Nomor Pokok Wajib Pajak (NPWP)",
    description="Taxpayer identification card of Indonesia",
    schema=SCHEMA,
    parse=parse,
    normalize=normalize,
    prompt_subject="a taxpayer card (NPWP)",
    field_rules={
        "tax_number": "NPWP with 15 or 16 digits, punctuation as printed",
        "business_name": "name of the taxpayer",
        "tax_office": "tax office, written KPP and its name",
        "tax_office_address": "address after Alamat",
        "tax_registration_date": "registration date as YYYY-MM-DD",
    },
)
