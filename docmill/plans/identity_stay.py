"""Limited stay permit (EX7, NRM8)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.cleaning import clean, clean_date
from docmill.functions.labels import value_first
from docmill.functions.text import blank_to_null, drop, has, line_rx, next_line, rx, strip
from docmill.plans.base import DocSpec, Fields, TextView, strings

# Field names, in record order.
SCHEMA = T.StructType(
    strings(
        "permit_issuing_office", "permit_issuing_office_address", "permit_niora", "permit_number",
        "permit_expiry_date", "permit_index", "holder_full_name", "holder_birth_place",
        "holder_birth_date", "holder_passport_number", "holder_passport_expiry_date",
        "holder_nationality", "holder_gender", "holder_address", "holder_occupation",
        "holder_status", "holder_guarantor", "permit_issued_place", "permit_issued_date",
    )
)

# Printed label of each one-line field.
LABELS = {
    "permit_niora": r"NIORA",
    "permit_number": r"Permit\s*Number",
    "permit_expiry_date": r"Stay\s*/\s*Multiple\s*Entries\s*Permit\s*Expiry",
    "permit_index": r"Stay\s*Permit\s*Index",
    "holder_full_name": r"Full\s*Name",
    "holder_passport_number": r"Passport\s*Number",
    "holder_passport_expiry_date": r"Passport\s*Expiry",
    "holder_nationality": r"Nationality",
    "holder_gender": r"Gender",
    "holder_occupation": r"Occupation",
    "holder_status": r"Status",
    "holder_guarantor": r"Guarantor\s*Name",
}
# Other printed forms.
BIRTH_LABEL = r"Place\s*/\s*Date\s*of\s*Birth"
DAY_FIRST = r"\d{1,2}[-/.]\d{1,2}[-/.]\d{4}"
AFTER_ADDRESS = r"^(?:Occupation|Status|Guarantor\s*Name|DISCLAIMER)\b"
ISSUE_LINE = rf"^([A-Za-z][A-Za-z\s]+),\s*({DAY_FIRST})$\nHead\s+of\b"
# Labels that may still stand before a value that came from elsewhere.
OFFICE = r"ISSUING\s*OFFICE|IMMIGRATION\s*OFFICE"
OFFICE_ADDRESS = r"ISSUING\s*OFFICE\s*ADDRESS|IMMIGRATION\s*OFFICE\s*ADDRESS"

_DATES = ("permit_expiry_date", "holder_passport_expiry_date")


def parse(t: TextView) -> list[Fields]:
    office = r"KANIM\b"
    return [
        {name: value_first(t.body, label) for name, label in LABELS.items()}
        | {
            "birth": value_first(t.body, BIRTH_LABEL),
            "address": value_first(t.body, "Address"),
            "address_next": line_rx(t.body, r"^Address\s*:\s*\S.*(?:\n(.*))?$"),
            "permit_issuing_office": line_rx(t.body, rf"^{office}.*$", 0),
            "office_next": next_line(t.body, office),
            "permit_issued_place": line_rx(t.body, ISSUE_LINE, 1),
            "permit_issued_date": line_rx(t.body, ISSUE_LINE, 2),
        },
        {
            "holder_birth_place": rx(t["birth"], rf"^(.+?)\s*/\s*{DAY_FIRST}\s*$"),
            "holder_birth_date": rx(t["birth"], rf"^.+?\s*/\s*({DAY_FIRST})\s*$"),
            "holder_address": F.concat_ws(
                " ", t["address"], F.when(~has(t["address_next"], AFTER_ADDRESS), t["address_next"])
            ),
            "permit_issuing_office_address": F.when(
                has(t["office_next"], r"^(?:JL\.?|JALAN\b)"), t["office_next"]
            ),
        },
    ]


def normalize(raw: Fields) -> Fields:
    out = {
        name: clean_date(raw[name], label) if name in _DATES else clean(raw[name], label)
        for name, label in LABELS.items()
    }
    place = clean(raw["holder_birth_place"], rf"{BIRTH_LABEL}|PLACE\s*OF\s*BIRTH")
    return out | {
        "permit_issuing_office": clean(raw["permit_issuing_office"], OFFICE),
        "permit_issuing_office_address": clean(raw["permit_issuing_office_address"], OFFICE_ADDRESS),
        "holder_birth_place": blank_to_null(strip(drop(place, rf"\s*/\s*{DAY_FIRST}\s*$"))),
        "holder_birth_date": clean_date(raw["holder_birth_date"], rf"{BIRTH_LABEL}|DATE\s*OF\s*BIRTH"),
        "holder_address": clean(raw["holder_address"], "ADDRESS"),
        "permit_issued_place": clean(raw["permit_issued_place"], r"ISSUED\s*PLACE"),
        "permit_issued_date": clean_date(raw["permit_issued_date"], r"ISSUED\s*DATE"),
    }


SPEC = DocSpec(
    slug="identity_stay",
    name="Kartu Izin Tinggal Terbatas (KITAS)",
    description="Electronic limited stay permit of Indonesia",
    schema=SCHEMA,
    parse=parse,
    normalize=normalize,
    prompt_subject="a limited stay permit (KITAS)",
    field_rules={
        "permit_issuing_office": "immigration office in the heading",
        "permit_issuing_office_address": "address below the office",
        "permit_niora": "NIORA number",
        "permit_number": "number of the permit",
        "permit_expiry_date": "expiry of the permit as YYYY-MM-DD",
        "permit_index": "index of the permit",
        "holder_full_name": "name of the holder",
        "holder_birth_place": "place of birth without the date",
        "holder_birth_date": "birth date as YYYY-MM-DD",
        "holder_passport_number": "passport number",
        "holder_passport_expiry_date": "passport expiry as YYYY-MM-DD",
        "holder_nationality": "nationality as printed",
        "holder_gender": "gender as printed",
        "holder_address": "address in Indonesia",
        "holder_occupation": "occupation as printed",
        "holder_status": "stay status as printed",
        "holder_guarantor": "guarantor, when printed",
        "permit_issued_place": "place in the issue line",
        "permit_issued_date": "date in the issue line as YYYY-MM-DD",
    },
)
