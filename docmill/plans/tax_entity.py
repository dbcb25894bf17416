"""Taxable-entrepreneur letter (EX4, NRM6)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.cleaning import clean_prefix, tax_id
from docmill.functions.dates import iso_or_text
from docmill.functions.labels import strip_label
from docmill.functions.text import (
    after_first,
    blank_to_null,
    body,
    drop,
    has,
    is_upper_text,
    line_last,
    line_pattern,
    line_rx,
    rx,
    strip,
    text_pattern,
)
from docmill.plans.base import DocSpec, Fields, TextView, strings

# Field names, in record order.
FIELD = T.StructType(strings("field_code", "field_title"))
SCHEMA = T.StructType(
    strings(
        "letter_number", "tax_office_region", "tax_office_name", "tax_office_address",
        "business_tax_number", "business_name",
    )
    + [T.StructField("business_fields", T.ArrayType(FIELD))]
    + strings(
        "business_address", "business_trade", "tax_obligation", "letter_confirmed_since",
        "letter_issued_place", "letter_issued_date", "signing_official_title",
        "signing_official_name", "signing_official_number",
    )
)

# Printed labels and value patterns.
REGION = r"KANTOR\s*WILAYAH\s*DJP"
OFFICE_LINE = rf"(?!.*{REGION})(?:.*KPP\s*PRATAMA.*|KPP\b.*)"
CONTACT = r"TELEPON|LAYANAN|EMAIL|SURAT"
TAX_LABEL = r"NOMOR\s*POKOK\s*WAJIB\s*PAJAK"
CLASS_BLOCK = after_first(r"KLASIFIKASI\s*LAPANGAN\s*USAHA", r"\s*[:\.]?\s*(.+?)(?=\n\s*4\.\s*ALAMAT)")
CLASS_LINE = r"\d{4,5}\s*-\s*\S"
ADDRESS_BLOCK = after_first(r"4\.?\s*ALAMAT", r"\s*[:\.]?\s*(.+?)(?=\n\s*5\.)")
TRADE_LABEL = r"MERK\s*DAGANG(?:/USAHA)?"
SINCE = r"TERHITUNG\s*SEJAK\s*(\d{1,2}\s+\w+\s+\d{4}|\d{2}[-/.]\d{2}[-/.]\d{4})"
SIGNER = r"A\.?N\.?\s*KEPALA\s*KANTOR"
NIP = r"NIP\s*[:\.]?\s*(?=\d{9})"

# ``Place, d Month yyyy``: a run of letters and blanks that starts at a word boundary.  Every run is
# entered once, at its first boundary (past the rest of a word it hangs on, or past leading blanks),
# so the scan stays linear.
_ISSUED = (
    r"(?<![A-Za-z\s])(?:(?<=\w)[A-Za-z]*+|(?<!\w)\s*+(?=[A-Za-z]))([A-Za-z\s]++),\s*(\d{1,2}\s+\w+\s+\d{4})"
)


def _grouped_fields(block):
    """Split a classification block at its code lines; other lines continue the title (WIN6)."""
    parts = F.split(block, line_pattern(rf"\n(?={CLASS_LINE})", ""))
    coded = F.filter(parts, lambda p: F.rlike(p, F.lit(line_pattern(rf"\A{CLASS_LINE}", ""))))
    head = r"^(\d{4,5})\s*-\s*"
    return F.transform(
        coded,
        lambda p: F.struct(
            F.regexp_extract(p, text_pattern(head, ""), 1).alias("field_code"),
            strip(F.translate(drop(p, head), "\n", " ")).alias("field_title"),
        ),
    )


def parse(t: TextView) -> list[Fields]:
    steps = {
        "letter_number": rx(t.text, r"\bS-\d+PKP/[\w./]+", 0),
        "tax_office_region": line_last(t.body, rf"^.*{REGION}.*$", 0),
        "tax_office_name": line_last(t.body, rf"^{OFFICE_LINE}$", 0),
        "tax_office_address": line_last(t.body, rf"^{OFFICE_LINE}$(?=\n(?!.*(?:{CONTACT}))(.*)$)"),
        "business_tax_number": line_rx(t.body, rf"{TAX_LABEL}\s*[:\.]?\s*([0-9OobB.\-]{{15,25}})"),
        "business_name": strip_label(t.body, r"2\.?\s*NAMA"),
        "class_block": body(rx(t.text, CLASS_BLOCK, flags="is")),
        "business_address": drop(strip(rx(t.text, ADDRESS_BLOCK, flags="is")), r"\s*\n\s*", ", "),
        "business_trade": line_rx(t.body, rf"^(?>5\.?\s*{TRADE_LABEL}\s*[:.]?\s*)(.*)$"),
        "obligations": F.regexp_extract_all(
            rx(t.text, r"KEWAJIBAN\s*PAJAK\s*[:\.]?\s*(.+)"),
            F.lit(text_pattern(r"\[\s*[xX]\s*\]\s*([A-Za-z]+)", "")),
            F.lit(1),
        ),
        "letter_confirmed_since": rx(t.text, SINCE),
        "letter_issued_place": strip(rx(t.text, _ISSUED, 1, "")),
        "letter_issued_date": rx(t.text, _ISSUED, 2, ""),
        "signer_line": line_rx(t.body, rf"^{SIGNER}.*$", 0),
        "signer_next": line_rx(t.body, rf"^{SIGNER}.*\n(.*)$"),
        "signing_official_number": line_rx(t.body, r"NIP\s*[:\.]?\s*(\d{9,20})"),
        "before_nip": F.get(F.split(t.body, line_pattern(NIP), 2), 0),
    }
    above_nip = F.when(
        F.contains(t["before_nip"], F.lit("\n")),
        F.substring_index(F.substring_index(t["before_nip"], "\n", -2), "\n", 1),
    )
    fields = _grouped_fields(t["class_block"])
    return [
        steps,
        {
            "business_fields": F.when(F.size(fields) > 0, fields),
            "tax_obligation": F.when(F.size(t["obligations"]) > 0, F.array_join(t["obligations"], "; ")),
            "signing_official_title": F.concat_ws(
                " ", t["signer_line"], F.when(~has(t["signer_next"], "^NIP"), F.rtrim(t["signer_next"], F.lit(",")))
            ),
            "signing_official_name": F.when(
                t["signing_official_number"].isNotNull() & is_upper_text(above_nip), above_nip
            ),
        },
    ]


def normalize(raw: Fields) -> Fields:
    trade = clean_prefix(raw["business_trade"], TRADE_LABEL)
    nip = clean_prefix(raw["signing_official_number"], "NIP")
    return {
        "letter_number": blank_to_null(strip(raw["letter_number"])),
        "tax_office_region": clean_prefix(
            raw["tax_office_region"], r"KANTOR\s*WILAYAH(?:\s*DJP)?", "KANTOR WILAYAH DJP "
        ),
        "tax_office_name": clean_prefix(raw["tax_office_name"], r"KANTOR\s*PELAYANAN\s*PAJAK|KPP", "KPP "),
        "tax_office_address": clean_prefix(raw["tax_office_address"], "ALAMAT"),
        "business_tax_number": tax_id(raw["business_tax_number"], rf"{TAX_LABEL}|NPWP"),
        "business_name": clean_prefix(raw["business_name"], "NAMA"),
        "business_address": clean_prefix(raw["business_address"], "ALAMAT"),
        "business_trade": F.nullif(trade, F.lit("-")),
        "letter_confirmed_since": iso_or_text(raw["letter_confirmed_since"]),
        "letter_issued_place": blank_to_null(strip(raw["letter_issued_place"])),
        "letter_issued_date": iso_or_text(raw["letter_issued_date"]),
        "signing_official_title": blank_to_null(raw["signing_official_title"]),
        "signing_official_number": F.coalesce(blank_to_null(drop(nip, r"\D")), nip),
    }


SPEC = DocSpec(
    slug="tax_entity",
    name="Surat Pengukuhan Pengusaha Kena Pajak (SPPKP/PKP)",
    description="Confirmation letter for a taxable entrepreneur in Indonesia",
    schema=SCHEMA,
    parse=parse,
    normalize=normalize,
    prompt_subject="a letter that confirms a taxable business (SPPKP)",
    unchecked=("tax_obligation", "signing_official_title", "signing_official_name"),
    field_rules={
        "letter_number": "reference number of the letter",
        "tax_office_region": "regional tax office",
        "tax_office_name": "local tax office, written KPP and its name",
        "tax_office_address": "address of the local office",
        "business_tax_number": "NPWP, punctuation as printed",
        "business_name": "name of the taxpayer",
        "business_fields": "classification codes with their titles",
        "business_address": "address of the business, lines joined by commas",
        "business_trade": "trade name, null for a dash",
        "tax_obligation": "ticked obligations joined by a semicolon",
        "letter_confirmed_since": "start date as YYYY-MM-DD",
        "letter_issued_place": "place of issue",
        "letter_issued_date": "date of issue as YYYY-MM-DD",
        "signing_official_title": "title of the signing official",
        "signing_official_name": "name of the signing official",
        "signing_official_number": "digits of the NIP",
    },
)
