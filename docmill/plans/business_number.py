"""Business identification number (EX3, NRM3, NRM4)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.cleaning import clean_prefix
from docmill.functions.dates import iso_or_text
from docmill.functions.labels import strip_label
from docmill.functions.text import after_first, blank_to_null, drop, rx, strip
from docmill.plans.base import DocSpec, Fields, TextView, strings

# Field names, in record order.
LICENSE = T.StructType(strings("license_type", "license_status", "license_remarks"))
FIELD = T.StructType(
    strings("field_number", "field_code", "field_title", "field_location", "field_postal_code", "field_risk")
    + [T.StructField("field_licenses", T.ArrayType(LICENSE))]
)
SCHEMA = T.StructType(
    strings(
        "business_number", "business_name", "business_address", "business_postal_code",
        "business_phone_number", "business_email", "business_investment_status",
        "document_issued_place", "document_issued_date", "amendment_number", "amendment_date",
        "document_printed_date", "signing_official_title",
    )
    + [T.StructField("business_fields", T.ArrayType(FIELD))]
)

# Printed labels and value patterns.
NUMBER_LABEL = r"NOMOR\s*INDUK\s*BERUSAHA"
NAME_LABEL = r"NAMA\s*PELAKU\s*USAHA"
ADDRESS_LABEL = r"ALAMAT\s*KANTOR"
POSTAL_LABEL = r"KODE\s*POS"
PHONE_LABEL = r"NO\.?\s*TELEPON"
STATUS_LABEL = r"STATUS\s*PENANAMAN\s*MODAL"
ISSUED_LABEL = r"DITERBITKAN\s*DI"
ANY_DATE = r"\d{1,2}\s+\w+\s+\d{4}|\d{2}[-/.]\d{2}[-/.]\d{4}"
SEP = r"\s*[:\.]?\s*"

_DATED = rf".*?TANGGAL{SEP}({ANY_DATE})"
_ISSUED = after_first(rf"{ISSUED_LABEL}{SEP}([A-Za-z\s]+?)[,\n]", _DATED)
_AMENDED = after_first(r"PERUBAHAN\s*KE[-\s]*(\d+)", _DATED)


def parse(t: TextView) -> list[Fields]:
    return [
        {
            "business_number": F.coalesce(
                rx(t.text, rf"{NUMBER_LABEL}{SEP}(\d{{13}})"), rx(t.text, r"\b(\d{13})\b")
            ),
            "business_name": strip_label(t.body, rf"(?:1\.\s*)?{NAME_LABEL}"),
            "business_address": strip_label(t.body, rf"(?:2\.\s*)?{ADDRESS_LABEL}"),
            "business_postal_code": rx(t.text, rf"{POSTAL_LABEL}{SEP}(\d{{5}})"),
            "business_phone_number": rx(t.text, rf"{PHONE_LABEL}{SEP}([\d\-\+\(\)\s]{{6,20}})"),
            "business_email": rx(t.text, rf"EMAIL{SEP}([\w\.\-]+@[\w\.\-]+\.\w+)"),
            "business_investment_status": F.upper(rx(t.text, rf"{STATUS_LABEL}{SEP}(PMDN|PMA)")),
            "issued_date": rx(t.text, _ISSUED, 2, "is"),
            "document_issued_place": F.coalesce(
                rx(t.text, _ISSUED, 1, "is"), rx(t.text, rf"{ISSUED_LABEL}{SEP}([A-Za-z\s]+)")
            ),
            "amendment_number": rx(t.text, _AMENDED, 1, "is"),
            "amendment_date": rx(t.text, _AMENDED, 2, "is"),
            "document_printed_date": rx(t.text, rf"DICETAK\s*TANGGAL{SEP}({ANY_DATE})"),
        },
        {"document_issued_date": t["issued_date"]},
    ]


def _license(item):
    def unbulleted(c):
        return blank_to_null(strip(drop(strip(c), r"^[-•]\s*")))

    remarks = strip(item["license_remarks"])
    return F.struct(
        unbulleted(item["license_type"]).alias("license_type"),
        unbulleted(item["license_status"]).alias("license_status"),
        F.when(~remarks.isin("", "-"), remarks).alias("license_remarks"),
    )


def _field(item):
    kept = [item[f.name].alias(f.name) for f in FIELD.fields if f.name != "field_licenses"]
    return F.struct(*kept, F.transform(item["field_licenses"], _license).alias("field_licenses"))


def normalize(raw: Fields) -> Fields:
    number = clean_prefix(raw["business_number"], rf"(?:{NUMBER_LABEL}|NIB)")

    def date(name):
        return iso_or_text(drop(strip(raw[name]), rf"^(?:TANGGAL|DICETAK\s*TANGGAL){SEP}"))

    return {
        "business_number": F.coalesce(rx(number, r"\b(\d{13})\b"), number),
        "business_name": clean_prefix(raw["business_name"], NAME_LABEL),
        "business_address": clean_prefix(raw["business_address"], ADDRESS_LABEL),
        "business_postal_code": clean_prefix(raw["business_postal_code"], POSTAL_LABEL),
        "business_phone_number": clean_prefix(raw["business_phone_number"], rf"(?:{PHONE_LABEL}|TELEPON)"),
        "business_email": clean_prefix(raw["business_email"], "EMAIL"),
        "business_investment_status": clean_prefix(raw["business_investment_status"], STATUS_LABEL),
        "document_issued_place": clean_prefix(raw["document_issued_place"], ISSUED_LABEL),
        "document_issued_date": date("document_issued_date"),
        "amendment_number": clean_prefix(raw["amendment_number"], r"PERUBAHAN\s*KE", sep=r"\s*[:\-\.]?\s*"),
        "amendment_date": date("amendment_date"),
        "document_printed_date": date("document_printed_date"),
        "business_fields": F.transform(raw["business_fields"], _field),
    }


SPEC = DocSpec(
    slug="business_identification_number",
    name="Nomor Induk Berusaha (NIB)",
    description="Business identification number certificate of Indonesia with its activity table",
    schema=SCHEMA,
    parse=parse,
    normalize=normalize,
    prompt_subject="a business registration (NIB)",
    unchecked=("signing_official_title",),
    field_rules={
        "business_number": "13-digit NIB",
        "business_name": "name of the business actor",
        "business_address": "office address",
        "business_postal_code": "5-digit office postal code",
        "business_phone_number": "office phone",
        "business_email": "office e-mail",
        "business_investment_status": "PMDN or PMA",
        "document_issued_place": "place of issue",
        "document_issued_date": "date of issue as YYYY-MM-DD",
        "amendment_number": "number of the amendment, when there is one",
        "amendment_date": "date of the amendment as YYYY-MM-DD",
        "document_printed_date": "print date as YYYY-MM-DD",
        "signing_official_title": "title of the signing official",
        "business_fields": "rows of the activity table with their licences",
    },
)
