"""Bank account papers: passbook, statement, letter (EX9, NRM10)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.cleaning import clean
from docmill.functions.labels import find_nonempty
from docmill.functions.text import blank_to_null, drop, first_hit, has, line_rx, rx, strip
from docmill.plans.base import DocSpec, Fields, TextView, strings

# Field names, in record order.
SCHEMA = T.StructType(strings("bank_name", "bank_branch", "account_number", "account_holder", "account_type"))

# Banks and products that are recognised by name, in order.
BANKS = [
    (r"\bBANK\s+CENTRAL\s+ASIA\b", "Bank Central Asia"),
    (r"\bBANK\s+RAKYAT\s+INDONESIA\b|\bBANK\s+BRI\b", "Bank Rakyat Indonesia"),
    (r"\bBANK\s+MANDIRI\b|\bmandiri\b", "Bank Mandiri"),
    (r"\bSeaBank\b", "SeaBank"),
    (r"\bBank\s+Danamon\b", "Bank Danamon"),
    (r"\bFirst\s+Bank\s+of\s+Wiki\b", "First Bank of Wiki"),
    (r"\bFirst\s+Bank\b", "First Bank"),
    (r"\bMinnesota\s+Bank\s+and\s+Trust\b", "Minnesota Bank and Trust"),
]
PRODUCTS = [
    (r"\bSimpedes\b", "Simpedes"),
    (r"\bBritAma\b", "BritAma"),
    (r"\bTAB\s+MANDIRI\b", "Tabungan Mandiri"),
    (r"\bCHEQUING\s+ACCOUNT\b", "Chequing"),
]
# Printed labels and value patterns.
ACCOUNT_LABEL = r"(?:No\.?\s*Rekening(?:\s*SeaBank)?|Account\s*(?:No\.?|Number)|ACC\.?\s*No\.?)"
HOLDER_LABEL = r"(?:Atas\s*Nama|Nama|Account\s*Holder)"
BRANCH_LABEL = r"(?:Kantor\s+Bank\s+BRI|Cabang|Branch)"
TYPE_LABEL = r"(?:Jenis\s*Rekening|Jenis\s*Tabungan|Account\s*(?:Type|Name))"
PERSON = r"^[A-Za-z][A-Za-z .'-]+\z"
PASSBOOK_BANK = "Bank Central Asia"
PASSBOOK = r"^KCP\s+.*\n(.*)\n(.*)$"


def parse(t: TextView) -> list[Fields]:
    account = find_nonempty(t.body, ACCOUNT_LABEL)
    found = {
        "bank_name": F.coalesce(first_hit(t.text, BANKS), find_nonempty(t.body, r"Bank\s*Name")),
        "account": account,
        "letter_account": rx(t.text, r"\baccount\s+is\s+(\d[\d-]{5,})\b"),
        "named_holder": find_nonempty(t.body, HOLDER_LABEL),
        "bank_branch": F.coalesce(
            find_nonempty(t.body, BRANCH_LABEL),
            strip(rx(t.text, r"\bBank\s+Danamon,\s*Cabang\s+([^,\n]+)")),
            line_rx(t.body, r"^KCP\s+[A-Z].*$", 0),
        ),
        "passbook_number": line_rx(t.body, PASSBOOK, 1),
        "passbook_holder": line_rx(t.body, PASSBOOK, 2),
        "account_type": F.coalesce(find_nonempty(t.body, TYPE_LABEL), first_hit(t.text, PRODUCTS)),
    }
    printed = F.when(t["account"].isNull(), t["letter_account"]).otherwise(
        blank_to_null(F.substring_index(t["account"], " - ", 1))
    )
    unlabelled = (
        (t["bank_name"] == PASSBOOK_BANK) & printed.isNull() & has(t["passbook_number"], r"^\d{8,16}\z")
    )
    beside_number = blank_to_null(strip(F.regexp_extract(t["account"], "(?s)^.*? - (.*)$", 1)))
    return [
        found,
        {
            "account_number": F.when(unlabelled, t["passbook_number"]).otherwise(printed),
            "account_holder": F.coalesce(
                F.when(unlabelled & has(t["passbook_holder"], PERSON, ""), t["passbook_holder"]),
                t["named_holder"],
                beside_number,
            ),
        },
    ]


def normalize(raw: Fields) -> Fields:
    number = F.get(F.split(clean(raw["account_number"], ACCOUNT_LABEL), r"(?U)\s+-\s+", 2), 0)
    packed = drop(number, r"\s+")
    return {
        "bank_name": clean(raw["bank_name"], r"BANK\s*NAME"),
        "bank_branch": clean(raw["bank_branch"], "KANTOR|CABANG|BRANCH"),
        "account_number": F.when(has(packed, r"^\d[\d-]*\z"), packed),
        "account_holder": clean(raw["account_holder"], r"ATAS\s*NAMA|NAMA|ACCOUNT\s*HOLDER|ACCOUNT\s*NAME"),
        "account_type": clean(
            raw["account_type"], r"JENIS\s*REKENING|JENIS\s*TABUNGAN|ACCOUNT\s*TYPE|ACCOUNT\s*NAME"
        ),
    }


SPEC = DocSpec(
    slug="bank_account",
    name="Bank Account",
    description="Account details on passbooks, statements and bank letters",
    schema=SCHEMA,
    parse=parse,
    normalize=normalize,
    prompt_subject="the first page of a savings book",
    field_rules={
        "bank_name": "bank that holds the account",
        "bank_branch": "branch, with KCP when printed",
        "account_number": "digits and printed hyphens, leading zeros kept",
        "account_holder": "owner of the account",
        "account_type": "product or type of the account",
    },
)
