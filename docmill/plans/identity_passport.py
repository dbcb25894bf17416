"""Passport machine-readable zone (EX5, NRM5)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.dates import iso_or_text, mrz_date
from docmill.functions.text import INLINE_SPACE, blank_to_null, drop, strip
from docmill.plans.base import DocSpec, Fields, TextView, strings

# Field names, in record order.
SCHEMA = T.StructType(
    strings(
        "document_type", "document_issuing_country", "holder_surname", "holder_given_names",
        "holder_passport_number", "holder_nationality", "holder_birth_date", "holder_gender",
        "holder_birth_place", "document_issued_date", "document_expiry_date",
        "document_issuing_authority", "document_mrz_line1", "document_mrz_line2",
    )
)

# Layout of the two 44-character lines.
WIDTH = 44
CANDIDATE = r"(?m)^[A-Z0-9<]{40,}$"


def parse(t: TextView) -> list[Fields]:
    packed = F.upper(F.regexp_replace(t.body, rf"(?U){INLINE_SPACE}+", ""))
    found = F.regexp_extract_all(packed, F.lit(CANDIDATE), F.lit(0))

    def line(position):
        hit = F.when(F.size(t["zone"]) >= 2, F.try_element_at(t["zone"], F.lit(position)))
        return F.rpad(hit, WIDTH, "<")

    one, two = t["document_mrz_line1"], t["document_mrz_line2"]
    names = F.substring(one, 6, 39)
    return [
        {"zone": found},
        {"document_mrz_line1": line(-2), "document_mrz_line2": line(-1)},
        {
            "document_type": F.substring(one, 1, 2),
            "document_issuing_country": F.substring(one, 3, 3),
            "holder_surname": F.substring_index(names, "<<", 1),
            "holder_given_names": F.when(
                F.contains(names, F.lit("<<")), F.regexp_extract(names, "^.*?<<(.*)$", 1)
            ),
            "holder_passport_number": F.substring(two, 1, 9),
            "holder_nationality": F.substring(two, 11, 3),
            "holder_birth_date": mrz_date(F.substring(two, 14, 6), t.as_of),
            "holder_gender": F.substring(two, 21, 1),
            "document_expiry_date": mrz_date(F.substring(two, 22, 6)),
        },
    ]


def normalize(raw: Fields) -> Fields:
    def code(name):
        return blank_to_null(F.replace(F.upper(strip(raw[name])), F.lit("<"), F.lit("")))

    def person(name):
        bare = drop(strip(raw[name]), r"^(?:SURNAME|GIVEN\s*NAMES?)\s*[:\.]?\s*")
        return blank_to_null(strip(drop(F.translate(bare, "<", " "), r"\s+", " ")))

    def plain(name):
        return blank_to_null(strip(raw[name]))

    def zone(name):
        return blank_to_null(drop(F.upper(strip(raw[name])), r"\s+"))

    number = drop(strip(raw["holder_passport_number"]), r"^(?:PASSPORT\s*(?:NO\.?|NUMBER|N[°o])?)\s*[:\.]?\s*")
    return {
        "document_type": code("document_type"),
        "document_issuing_country": code("document_issuing_country"),
        "holder_surname": person("holder_surname"),
        "holder_given_names": person("holder_given_names"),
        "holder_passport_number": blank_to_null(strip(F.replace(number, F.lit("<"), F.lit("")))),
        "holder_nationality": code("holder_nationality"),
        "holder_birth_date": iso_or_text(raw["holder_birth_date"]),
        "holder_gender": code("holder_gender"),
        "holder_birth_place": plain("holder_birth_place"),
        "document_issued_date": iso_or_text(raw["document_issued_date"]),
        "document_expiry_date": iso_or_text(raw["document_expiry_date"]),
        "document_issuing_authority": plain("document_issuing_authority"),
        "document_mrz_line1": zone("document_mrz_line1"),
        "document_mrz_line2": zone("document_mrz_line2"),
    }


SPEC = DocSpec(
    slug="identity_passport",
    name="Passport",
    description="Data page of a passport, by its machine-readable zone",
    schema=SCHEMA,
    parse=parse,
    normalize=normalize,
    prompt_subject="the data page of a passport with its machine-readable zone",
    field_rules={
        "document_type": "document code, usually P",
        "document_issuing_country": "three-letter code of the issuer",
        "holder_surname": "surname, printed value before MRZ value",
        "holder_given_names": "given names, printed value before MRZ value",
        "holder_passport_number": "number of the passport",
        "holder_nationality": "three-letter nationality code",
        "holder_birth_date": "birth date as YYYY-MM-DD",
        "holder_gender": "M, F or X",
        "holder_birth_place": "place of birth, when printed",
        "document_issued_date": "issue date as YYYY-MM-DD",
        "document_expiry_date": "expiry date as YYYY-MM-DD",
        "document_issuing_authority": "issuing authority",
        "document_mrz_line1": "first MRZ line, all 44 characters",
        "document_mrz_line2": "second MRZ line, all 44 characters",
    },
)
