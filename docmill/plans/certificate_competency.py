"""Course and competency certificate (EX11, NRM12)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.cleaning import clean, swapped_date
from docmill.functions.labels import after_marker, find_wide_colon
from docmill.functions.text import after_first, has, line_last, line_rx, rx, strip
from docmill.plans.base import SIGNATURE, DocSpec, Fields, strings, TextView

# Field names, in record order.
UNIT = T.StructType(strings("unit_code", "unit_name"))
SCHEMA = T.StructType(
    strings(
        "certificate_number", "certificate_holder", "training_title", "training_field",
        "training_institution", "training_start_date", "training_end_date", "training_grade",
        "certificate_issued_place", "certificate_issued_date", "certificate_expiry_date",
    )
    + [T.StructField("training_units", T.ArrayType(UNIT))]
)

# Printed label of each field.
LABELS = {
    "certificate_number": r"(?:No\.?|Nomor(?:\s+Sertifikat)?|Certificate\s+Number)",
    "certificate_holder": r"(?:Nama(?:\s+(?:Peserta|Pemegang))?|Name|Recipient)",
    "training_title": r"(?:Nama\s+(?:Pelatihan|Kursus)|Skema\s+Sertifikasi|Kualifikasi|Course(?:\s+Title)?|Qualification)",
    "training_field": r"(?:Bidang(?:\s+Pekerjaan)?|Competency\s+Field)",
    "training_institution": r"(?:Penyelenggara|Institution|Issuer)",
    "training_start_date": r"(?:Tanggal\s+Mulai|Start\s+Date)",
    "training_end_date": r"(?:Tanggal\s+Selesai|End\s+Date|Completion\s+Date)",
    "training_grade": r"(?:Nilai|Grade|Hasil)",
    "certificate_issued_place": r"(?:Tempat\s+Terbit|Issued\s+Place)",
    "certificate_issued_date": r"(?:Tanggal\s+Terbit|Issued\s+Date|Date\s+of\s+Issue)",
    "certificate_expiry_date": r"(?:Berlaku\s+Sampai|Expiry\s+Date|Valid\s+Until)",
}
# Marker lines and other printed forms.
MARKERS = {
    "certificate_holder": r"Dengan\s+ini\s+menyatakan\s+bahwa\s*[,.:]?",
    "training_title": r"(?:Dengan\s+Kualifikasi\s*/\s*Kompetensi|Telah\s+lulus\s+dari\s+kelas)\s*[:.]?",
    "training_field": r"(?:Pada\s+bidang\s+pekerjaan|Telah\s+kompeten\s+pada\s+bidang)\s*[:.]?",
}
LOOSE_NUMBER = r"^[^\S\n]*No\.?(?!\s*Reg\b)\s+([A-Z0-9][A-Z0-9 ./-]*\d)\s*$"
BODY_LINE = r"^Lembaga\s+Sertifikasi\s+Profesi\b.*$"
PROVIDER_LINE = r"^Dicoding(?:\s+Indonesia)?$"
AUTHORITY = r"\bBadan\s+Nasional\s+Sertifikasi\s+Profesi\b"
AUTHORITY_NAME = "Badan Nasional Sertifikasi Profesi"
UNIT_BLOCK = after_first(
    r"Telah\s+memenuhi\s+persyaratan\s+dan\s+kompeten\s+pada\s+kualifikasi\s*:", r"(.*?)Pada\s+bidang\s+pekerjaan"
)
UNIT_LINE = r"^[^\S\n]*\d+\.\s*([A-Z][A-Z0-9]*(?:[./-][A-Z0-9]+){2,}+)\s*$"
TAIL_LINES = 16

_DATES = ("training_start_date", "training_end_date", "certificate_issued_date", "certificate_expiry_date")


def parse(t: TextView) -> list[Fields]:
    fallback = {
        "certificate_number": strip(rx(t.text, LOOSE_NUMBER, flags="im")),
        "training_institution": F.coalesce(
            line_rx(t.body, BODY_LINE, 0),
            line_rx(t.body, PROVIDER_LINE, 0),
            find_wide_colon(t.body, "Authority"),
            F.when(has(t.text, AUTHORITY), F.lit(AUTHORITY_NAME)),
        ),
        "certificate_issued_place": strip(line_last(t.tail(TAIL_LINES), SIGNATURE, 1, "")),
        "certificate_issued_date": line_last(t.tail(TAIL_LINES), SIGNATURE, 2, ""),
    } | {name: after_marker(t.body, marker) for name, marker in MARKERS.items()}

    found = {
        name: F.coalesce(find_wide_colon(t.body, label), *([fallback[name]] if name in fallback else []))
        for name, label in LABELS.items()
    }
    codes = F.regexp_extract_all(rx(t.text, UNIT_BLOCK, flags="is"), F.lit(f"(?mUd){UNIT_LINE}"), F.lit(1))
    units = F.transform(
        t["unit_codes"], lambda c: F.struct(c.alias("unit_code"), F.lit(None).cast("string").alias("unit_name"))
    )
    return [
        found | {"unit_codes": codes},
        {"training_units": F.when(F.size(t["unit_codes"]) > 0, units)},
    ]


def normalize(raw: Fields) -> Fields:
    # Labels that may still stand before a value.
    labels = LABELS | {
        "certificate_number": r"NOMOR(?:\s+SERTIFIKAT)?|CERTIFICATE\s+NUMBER|NO\b\.?",
        "training_institution": "PENYELENGGARA|INSTITUTION|ISSUER|AUTHORITY",
    }
    return {
        name: swapped_date(raw[name], label) if name in _DATES else clean(raw[name], label)
        for name, label in labels.items()
    }


SPEC = DocSpec(
    slug="certificate_competency",
    name="Course / Competency Certificate",
    description="Certificates of courses, training and professional competency",
    schema=SCHEMA,
    parse=parse,
    normalize=normalize,
    prompt_subject="a training or competency certificate",
    field_rules={
        "certificate_number": "number of the certificate",
        "certificate_holder": "name of the recipient",
        "training_title": "course, scheme or qualification",
        "training_field": "occupational area",
        "training_institution": "provider or certification body",
        "training_start_date": "start date as YYYY-MM-DD",
        "training_end_date": "end date as YYYY-MM-DD",
        "training_grade": "result or grade as printed",
        "certificate_issued_place": "place in the issue line",
        "certificate_issued_date": "issue date as YYYY-MM-DD",
        "certificate_expiry_date": "printed expiry date as YYYY-MM-DD, never computed",
        "training_units": "unit codes and names",
    },
)
