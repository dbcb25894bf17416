"""Identity card (EX1, NRM1)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.cleaning import clean_prefix, gender, id_digits, repair_digits
from docmill.functions.dates import iso_or_text
from docmill.functions.labels import strip_label
from docmill.functions.text import (
    blank_to_null,
    drop,
    first_contained,
    first_hit,
    has,
    line_last,
    line_rx,
    rx,
    strip,
)
from docmill.plans.base import DocSpec, Fields, TextView, strings

# Field names, in record order.
SCHEMA = T.StructType(
    strings(
        "document_province", "document_city", "document_number", "holder_name", "holder_birth_place",
        "holder_birth_date", "holder_gender", "holder_blood_type", "holder_address",
        "holder_neighborhood_unit", "holder_village", "holder_district", "holder_religion",
        "holder_marital_status", "holder_occupation", "holder_nationality", "document_expiry_date",
    )
)

# Printed words and patterns of the card.
LIFELONG = "SEUMUR HIDUP"
RELIGIONS = ["ISLAM", "KRISTEN", "KATHOLIK", "KATOLIK", "HINDU", "BUDDHA", "KHONGHUCU"]
RELIGION_NAMES = {"KATOLIK": "KATHOLIK"}
MARITAL = ["BELUM KAWIN", "CERAI HIDUP", "CERAI MATI", "KAWIN"]
MALE = r"\bLAKI[- ]*LAKI\b"
FEMALE = r"\bPEREMPUAN\b"
CARD_DATE = r"\b\d{2}[-/]\d{2}[-/]\d{4}\b"
BIRTH_LABEL = r"TEMPAT[/\s]*(?:TGL|TANGGAL)?\s*LAHIR"
VILLAGE_LABEL = r"KEL(?:/|\.|\s*)DESA"
UNIT_LABEL = r"R[/\.]?T[/\s]*R[/\.]?W"
NEXT_LABELS = r"\b(?:NIK|NAMA|TEMPAT|ALAMAT|PROVINSI|AGAMA|GOL)\b"

_GENDERS = [(MALE, "LAKI-LAKI"), (FEMALE, "PEREMPUAN")]


def _before(c, pattern):
    """Stripped text before the first match of ``pattern``."""
    return strip(F.get(F.split(c, f"(?i){pattern}", 2), 0))


def _dashes(c):
    return F.translate(c, "/", "-")


def parse(t: TextView) -> list[Fields]:
    head6, head7 = t.head(6), t.head(7)
    cut = "KOTA|KABUPATEN|NIK"
    any_of = "|".join

    windows = {
        "province_run": line_rx(head6, rf"PROVINSI\s+(?!{cut})([A-Z][A-Z\s]*)"),
        "after_province": F.coalesce(
            line_rx(head7, rf"^.*PROVINSI\s+(?!{cut})[A-Z].*\n(.*)$"),
            line_last(head7, r"^.*PROVINSI\s+[A-Z\s].*\n(.*)$"),
        ),
        "city_type": line_rx(head6, r"\b(KOTA|KABUPATEN)\s+[A-Z\s]"),
        "city_run": line_rx(head6, r"\b(?:KOTA|KABUPATEN)\s+([A-Z\s]+)"),
        "number_run": rx(t.text, r"N[I1l!|][KCk]\s*[:\.]?\s*([0-9OobB\s]{16,20})"),
        "birth": line_rx(
            t.body, rf"^(?=.*{BIRTH_LABEL})(?>.*LAHIR\s*[:.]?\s*)(?=.*(?:,|{CARD_DATE}))(\S.*)$"
        ),
        "gender_line": line_rx(t.body, rf"^(?=.*JENIS\s*KELAMIN)(?=.*(?:{MALE}|{FEMALE})).*$", 0),
        "religion_value": F.upper(
            line_rx(t.body, rf"^(?=AGAMA\b)(?>AGAMA\s*[:.]?\s*)(.*(?:{any_of(RELIGIONS)}).*)$")
        ),
        "marital_value": F.upper(
            line_rx(t.body, rf"^(?>.*STATUS\s*PERKAWINAN\s*[:.]?\s*)(.*(?:{any_of(MARITAL)}).*)$")
        ),
        "nationality_line": F.upper(line_rx(t.body, r"^(?=.*KEWARGANEGARAAN)(?=.*WN[AI]).*$", 0)),
        "expiry_value": F.upper(strip_label(t.body, r".*BERLAKU\s*HINGGA")),
    }

    repaired = repair_digits(t["number_run"])
    has_comma = F.contains(t["birth"], F.lit(","))
    birth_date = rx(t["birth"], CARD_DATE, 0)
    date_after_comma = rx(F.regexp_extract(t["birth"], "(?s)^[^,]*,(.*)$", 1), CARD_DATE, 0)
    place = F.when(has_comma, strip(F.substring_index(t["birth"], ",", 1))).otherwise(
        F.btrim(F.replace(t["birth"], birth_date, F.lit("")), F.lit(" ,:-"))
    )
    fields = {
        "document_province": _before(t["province_run"], cut),
        "document_city": F.coalesce(
            F.when(
                t["city_type"].isNotNull(),
                strip(F.concat_ws(" ", F.upper(t["city_type"]), _before(t["city_run"], "NIK|PROVINSI"))),
            ),
            F.when(~has(t["after_province"], NEXT_LABELS), t["after_province"]),
        ),
        "document_number": F.coalesce(
            F.when(F.length(repaired) == 16, repaired), rx(t.text, r"\b([1-9][0-9]{15})\b")
        ),
        "holder_name": strip_label(t.body, "NAMA", guard=r"(?=NAMA\b)"),
        "holder_birth_place": blank_to_null(place),
        "holder_birth_date": _dashes(F.when(has_comma, date_after_comma).otherwise(birth_date)),
        "holder_gender": F.coalesce(first_hit(t["gender_line"], _GENDERS), first_hit(t.text, _GENDERS)),
        "holder_blood_type": line_rx(t.body, r"GOL(?:\.|\s*)\s*DARAH\s*[:\.]?\s*([ABO-]+)"),
        "holder_address": strip_label(t.body, "ALAMAT", guard=r"(?=ALAMAT\b)"),
        "holder_neighborhood_unit": line_rx(
            t.body, rf"^(?=.*\b{UNIT_LABEL}\b).*?{UNIT_LABEL}\s*[:\.]?\s*([0-9/]+)"
        ),
        "holder_village": strip_label(t.body, rf".*{VILLAGE_LABEL}"),
        "holder_district": strip_label(t.body, r".*KECAMATAN"),
        "holder_religion": F.coalesce(
            first_contained(t["religion_value"], RELIGIONS, RELIGION_NAMES),
            first_hit(t.text, [(rf"\b{w}\b", RELIGION_NAMES.get(w, w)) for w in RELIGIONS]),
        ),
        "holder_marital_status": first_contained(t["marital_value"], MARITAL),
        "holder_occupation": strip_label(t.body, "PEKERJAAN", guard=r"(?=PEKERJAAN\b)"),
        "holder_nationality": F.coalesce(
            first_contained(t["nationality_line"], ["WNA", "WNI"]), F.lit("WNI")
        ),
        "document_expiry_date": F.coalesce(
            F.when(F.contains(t["expiry_value"], F.lit("SEUMUR")), F.lit(LIFELONG)),
            _dashes(rx(t["expiry_value"], CARD_DATE, 0)),
            t["expiry_value"],
            F.when(has(t.text, r"SEUMUR\s*HIDUP"), F.lit(LIFELONG)),
        ),
    }
    return [windows, fields]


def normalize(raw: Fields) -> Fields:
    number = strip(drop(strip(raw["document_number"]), r"^NIK\s*[:\.]?\s*"))
    digits = id_digits(number)
    place = strip(drop(strip(raw["holder_birth_place"]), r",\s*\d{1,2}[-/.\s][\w\d\s/-]+$", flags=""))
    unit = strip(drop(strip(raw["holder_neighborhood_unit"]), r"^(?:R/?T/?R/?W|RT|RW)\s*[:\.]?\s*"))
    expiry = strip(drop(strip(raw["document_expiry_date"]), r"^BERLAKU\s*HINGGA\s*[:\.]?\s*"))
    return {
        "document_province": clean_prefix(raw["document_province"], r"PROVINSI\s+", sep=""),
        "document_number": F.when(
            raw["document_number"] != "", F.when(F.length(digits) == 16, digits).otherwise(strip(raw["document_number"]))
        ),
        "holder_birth_place": blank_to_null(strip(F.substring_index(place, ",", 1))),
        "holder_birth_date": iso_or_text(raw["holder_birth_date"]),
        "holder_gender": gender(raw["holder_gender"]),
        "holder_blood_type": clean_prefix(F.upper(raw["holder_blood_type"]), r"GOL(?:ONGAN)?\.?\s*DARAH"),
        "holder_neighborhood_unit": F.when(has(unit, r"\d"), drop(unit, r"\s*/\s*", "/")),
        "document_expiry_date": iso_or_text(
            F.when(has(raw["document_expiry_date"], "SEUMUR"), F.lit(LIFELONG)).otherwise(expiry)
        ),
    }


SPEC = DocSpec(
    slug="identity_card",
    name="Kartu Tanda Penduduk (KTP)",
    description="National identity card of Indonesia",
    schema=SCHEMA,
    parse=parse,
    normalize=normalize,
    defaults={"holder_nationality": "WNI", "document_expiry_date": LIFELONG},
    prompt_subject="a resident identity card (KTP)",
    unchecked=(
        "document_city", "holder_name", "holder_address", "holder_village", "holder_district",
        "holder_religion", "holder_marital_status", "holder_occupation", "holder_nationality",
    ),
    field_rules={
        "document_province": "province in the heading, without the word PROVINSI",
        "document_city": "city or regency in the heading",
        "document_number": "16-digit NIK",
        "holder_name": "name after Nama",
        "holder_birth_place": "place part of Tempat/Tgl Lahir",
        "holder_birth_date": "date part of Tempat/Tgl Lahir as YYYY-MM-DD",
        "holder_gender": "LAKI-LAKI or PEREMPUAN",
        "holder_blood_type": "blood group, or a dash as printed",
        "holder_address": "street address after Alamat",
        "holder_neighborhood_unit": "RT/RW numbers",
        "holder_village": "value of Kel/Desa",
        "holder_district": "value of Kecamatan",
        "holder_religion": "value of Agama",
        "holder_marital_status": "value of Status Perkawinan",
        "holder_occupation": "value of Pekerjaan",
        "holder_nationality": "WNI or WNA",
        "document_expiry_date": "date as YYYY-MM-DD, or SEUMUR HIDUP",
    },
)
