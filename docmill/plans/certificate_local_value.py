"""Domestic-content certificate (EX8, NRM9)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.cleaning import clean, clean_date, percent, years
from docmill.functions.labels import value_first
from docmill.functions.text import blank_to_null, has, line_pattern, line_rx, next_line, rx, strip
from docmill.plans.base import DocSpec, Fields, TextView, strings

# Field names, in record order.
SCHEMA = T.StructType(
    strings("product_name", "product_type", "product_specification", "product_hs", "product_brand")
    + [T.StructField("product_local_value", T.DoubleType())]
    + strings("product_standard", "product_certificate", "report_number")
    + [T.StructField("certificate_valid_year", T.IntegerType())]
    + strings(
        "business_name", "business_address", "business_tax_number", "business_field",
        "certificate_number", "certificate_issued_place", "certificate_issued_date",
        "signing_official_title", "signing_official_name", "certificate_qr_number",
    )
)

# Printed label of each field.
LABELS = {
    "product_name": r"Jenis\s*Produk",
    "product_type": r"Tipe",
    "product_specification": r"Spesifikasi",
    "product_hs": r"Kode\s*HS",
    "product_brand": r"Merk",
    "product_local_value": r"Nilai\s*TKDN",
    "product_standard": r"Standar(?:d)?\s*Produk",
    "product_certificate": r"Sertifikat\s*Produk",
    "report_number": r"No\.?\s*Laporan",
    "business_name": r"Nama\s*Perusahaan",
    "business_address": r"Alamat",
    "business_tax_number": r"NPWP",
    "business_field": r"(?:Bidang\s*Usaha|Jenis\s*Industri)",
    "certificate_number": r"No\.?\s*Tanda\s*Sah",
}
WRAPPED = ("product_specification", "business_address", "business_field")
# Lines that end a wrapped value, and the other printed forms.
STOP_WORDS = r"(?:yang\s+telah|diberikan\s+kepada|Jakarta\s*,|Kepala\s+Pusat)\b"
ISSUE_LINE = r"^([A-Za-z][A-Za-z\s]+),\s*(\d{1,2}\s+[A-Za-z]+\s+\d{4}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})$"
SIGNER = r"Kepala\s+Pusat\b"
PERSON = r"^[A-Za-z][A-Za-z .'-]+\z"

_STOP = rf"(?:(?:{'|'.join(LABELS.values())})\s*:|{STOP_WORDS})"


def _wrapped(body, label):
    """Value of a label and the lines after it up to the next label or stop line (WIN5)."""
    onward = line_rx(body, rf"^{label}\s*:\s*((?s:.*))\z")
    value = F.get(F.split(onward, line_pattern(rf"\n(?={_STOP})"), 2), 0)
    return blank_to_null(strip(F.translate(value, "\n", " ")))


def parse(t: TextView) -> list[Fields]:
    return [
        {
            name: _wrapped(t.body, label) if name in WRAPPED else value_first(t.body, label)
            for name, label in LABELS.items()
        }
        | {
            "certificate_valid_year": rx(t.text, r"\bberlaku\s+(\d+)\s+tahun\b"),
            "certificate_issued_place": line_rx(t.body, ISSUE_LINE, 1),
            "certificate_issued_date": line_rx(t.body, ISSUE_LINE, 2),
            "signing_official_title": line_rx(t.body, rf"^{SIGNER}.*$", 0),
            "signer_next": next_line(t.body, SIGNER),
            "certificate_qr_number": line_rx(t.body, r"^#\s*(\d+)$"),
        },
        {"signing_official_name": F.when(has(t["signer_next"], PERSON, ""), t["signer_next"])},
    ]


def normalize(raw: Fields) -> Fields:
    out = {name: clean(raw[name], label) for name, label in LABELS.items()}
    return out | {
        "product_local_value": percent(raw["product_local_value"], LABELS["product_local_value"]),
        "certificate_valid_year": years(raw["certificate_valid_year"], r"VALIDITY\s*YEARS"),
        "certificate_issued_place": clean(raw["certificate_issued_place"], r"ISSUED\s*PLACE"),
        "certificate_issued_date": clean_date(raw["certificate_issued_date"], r"ISSUED\s*DATE"),
        "signing_official_title": clean(raw["signing_official_title"], r"SIGNING\s*OFFICIAL\s*TITLE"),
        "signing_official_name": clean(raw["signing_official_name"], r"SIGNING\s*OFFICIAL\s*NAME"),
        "certificate_qr_number": clean(raw["certificate_qr_number"], "#", sep=r"\s*"),
    }


SPEC = DocSpec(
    slug="certificate_local_value",
    name="Sertifikat Tingkat Komponen Dalam Negeri (TKDN)",
    description="Domestic content certificate of Indonesia",
    schema=SCHEMA,
    parse=parse,
    normalize=normalize,
    prompt_subject="a certificate of local content (TKDN)",
    field_rules={
        "product_name": "Jenis Produk",
        "product_type": "Tipe",
        "product_specification": "Spesifikasi with its wrapped lines",
        "product_hs": "Kode HS",
        "product_brand": "Merk",
        "product_local_value": "percentage as a number, null for Terlampir",
        "product_standard": "Standar Produk",
        "product_certificate": "Sertifikat Produk",
        "report_number": "No. Laporan",
        "certificate_valid_year": "validity in whole years",
        "business_name": "Nama Perusahaan",
        "business_address": "Alamat with its wrapped lines",
        "business_tax_number": "NPWP",
        "business_field": "Bidang Usaha or Jenis Industri",
        "certificate_number": "No. Tanda Sah",
        "certificate_issued_place": "place in the issue line",
        "certificate_issued_date": "date in the issue line as YYYY-MM-DD",
        "signing_official_title": "title of the signing official",
        "signing_official_name": "name of the signing official",
        "certificate_qr_number": "number printed below the QR code",
    },
)
