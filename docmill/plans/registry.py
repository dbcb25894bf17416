"""The document types, by slug, in registration order (SRC8, EXT1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmill.plans import (
    bank_account,
    business_deed,
    business_number,
    certificate_competency,
    certificate_education,
    certificate_local_value,
    identity_card,
    identity_passport,
    identity_stay,
    tax_entity,
    tax_number,
)
from docmill.plans.base import DocSpec

_SPECS: dict[str, DocSpec] = {}


def register(spec: DocSpec) -> None:
    """Add a document type; a later registration of the same slug replaces the earlier one."""
    _SPECS[spec.slug] = spec


def unregister(slug: str) -> None:
    _SPECS.pop(slug, None)


def get(slug: str) -> DocSpec:
    return _SPECS[slug]


def specs() -> list[DocSpec]:
    return list(_SPECS.values())


for _module in (
    identity_card,
    tax_number,
    business_number,
    tax_entity,
    identity_passport,
    business_deed,
    identity_stay,
    certificate_local_value,
    bank_account,
    certificate_education,
    certificate_competency,
):
    register(_module.SPEC)


def document_types(spark: SparkSession) -> DataFrame:
    """One row per registered type with its JSON schema; the size is the number of types."""
    rows = [(i, s.slug, s.name, s.description, s.schema.json()) for i, s in enumerate(specs())]
    return spark.createDataFrame(
        rows, "type_ord int, document_type string, name string, description string, json_schema string"
    )


def document_fields(spark: SparkSession) -> DataFrame:
    """One row per field of every registered type."""
    rows = [
        (s.slug, i, f.name, f.dataType.simpleString(), s.field_rules.get(f.name))
        for s in specs()
        for i, f in enumerate(s.schema.fields)
    ]
    return spark.createDataFrame(
        rows, "document_type string, field_ord int, field string, data_type string, description string"
    )
