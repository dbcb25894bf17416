"""Masking over the given texts and over nested rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import masking as M
from docmill.functions.text import text_pattern
from docmill.operators.masking import mask_frame, mask_logs
from docmill.queries.common import code, padded, query, spread_table, table

# The masks in the other SQL dialect; the account and permit labels do not occur in these tables.
_STEPS = [
    (r"\bBearer\s+[A-Za-z0-9_\-\.]+", "Bearer [REDACTED]", "gi"),
    (M.CLOUD_KEY, M.CLOUD_KEY_MASK, "g"),
    (M.SECRET, r"\1[REDACTED]\3", "gi"),
    (M.ID_16, r"\1******\2", "g"),
    (M.TAX_FORMATTED, r"\1.***.***.*-***.\2", "g"),
    (M.TAX_RAW, r"\1*******\2", "g"),
    (M.CARD, r"\1-****-****-\2", "g"),
    (M.PHONE, r"\1\2****\3", "g"),
    (
        r"\b([a-zA-Z0-9_.+-])[a-zA-Z0-9_.+-]*([a-zA-Z0-9_.+-])@([a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)\b",
        r"\1***\2@\3",
        "g",
    ),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def masked_sql(column: str) -> str:
    for pattern, mask, flags in _STEPS:
        column = f"regexp_replace({column}, {_quoted(pattern)}, {_quoted(mask)}, '{flags}')"
    return column


@query("pi_mask_documents", f"select doc_id, {masked_sql('text')} as text from documents")
def pi_mask_documents(spark, sf_dir):
    return M.mask_columns(spread_table(spark, sf_dir, "documents", "doc_id", "text"), "text")


@query("pi_mask_conversations", f"select conv_id, turn, role, {masked_sql('text')} as text from conversations")
def pi_mask_conversations(spark, sf_dir):
    return M.mask_columns(spread_table(spark, sf_dir, "conversations"), "text")


_COUNTED = [
    ("n_secrets", M.SECRET, "(?i)"),
    ("n_ids", M.ID_16, ""),
    ("n_tax_ids", M.TAX_RAW, ""),
    ("n_cards", M.CARD, ""),
    ("n_phones", M.PHONE, ""),
    ("n_emails", _STEPS[-1][0], ""),
]


@query(
    "pi_hit_counts",
    "select lang, count(*) as documents, "
    + ", ".join(
        f"cast(sum(len(regexp_extract_all(text, {_quoted(flag + p)}))) as bigint) as {name}" for name, p, flag in _COUNTED
    )
    + " from documents group by lang",
)
def pi_hit_counts(spark, sf_dir):
    counts = [
        F.sum(F.regexp_count("text", F.lit(text_pattern(p, flag.strip("(?)"))))).cast("bigint").alias(name)
        for name, p, flag in _COUNTED
    ]
    return spread_table(spark, sf_dir, "documents", "lang", "text").groupBy("lang").agg(F.count("*").alias("documents"), *counts)


_K = "c_custkey"
_ACCOUNT = f"concat({padded(_K + ' % 1000', 3)}, '-00-', {padded(_K, 7)}, '-', cast({_K} % 10 as varchar(1)))"


@query(
    "pi_labelled_ids",
    f"""
select {_K} as doc_id,
  'NIORA : A' || substr({code(_K)}, 1, 1) || '******' || substr({code(_K)}, 8, 2)
    || ' permit number: 2C******' || substr({padded(_K, 7)}, 7, 1) || 'Z; '
    || 'No. Rekening : ' || substr({padded(_K + ' % 1000', 3)}, 1, 2) || '*-**-******'
    || substr({padded(_K, 7)}, 7, 1) || '-' || cast({_K} % 10 as varchar)
    || ' Account No : 12345' as text
from customer
""",
)
def pi_labelled_ids(spark, sf_dir):
    text = (
        f"concat('NIORA : A', {code(_K)}, ' permit number: 2C', {padded(_K, 7)}, 'Z; ', "
        f"'No. Rekening : ', {_ACCOUNT}, ' Account No : 12345')"
    )
    rows = table(spark, sf_dir, "customer").selectExpr(f"{_K} as doc_id", f"{text} as text")
    return M.mask_columns(rows, "text")


@query(
    "pi_mask_nested",
    f"""
select {_K} as id, 'identity_card' as document_type,
  '310000******' || substr({padded(_K, 16)}, 13, 4) as nik,
  substr({padded(_K, 9)}, 1, 6) || substr({padded(_K, 9)}, 6, 4) as nomor_npwp,
  'k***y@mail.co.id' as contact_email, '0812****' || substr({padded(_K, 7)}, 5, 3) as phone, '[REDACTED]' as token,
  '[REDACTED]' as extra_password,
  substr({padded(_K, 9)}, 1, 2) || '*****' || substr({padded(_K, 9)}, 8, 2) as extra_account_number,
  'plain' as extra_note, 'm***e@x.id, none' as tags, '[REDACTED]' as kk
from customer
""",
)
def pi_mask_nested(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr(
        f"{_K} as id",
        "'identity_card' as document_type",
        f"concat('310000', substr({padded(_K, 16)}, 7, 10)) as nik",
        f"{padded(_K, 9)} as nomor_npwp",
        f"named_struct('contact_email', 'kept.by@mail.co.id', 'phone', concat('0812', {padded(_K, 7)}), 'token', 'abc') as metadata",
        f"map('password', 'x', 'account_number', {padded(_K, 9)}, 'note', 'plain') as extra",
        "array('me.e@x.id', 'none') as tags",
        f"cast({_K} as bigint) as kk",
    )
    return mask_frame(rows).select(
        "id", "document_type", "nik", "nomor_npwp", "metadata.contact_email", "metadata.phone", "metadata.token",
        F.col("extra")["password"].alias("extra_password"),
        F.col("extra")["account_number"].alias("extra_account_number"),
        F.col("extra")["note"].alias("extra_note"),
        F.array_join("tags", ", ").alias("tags"),
        "kk",
    )


@query(
    "pi_mask_maps",
    f"""
select {_K} as id, '[REDACTED]' as n_token, '310000******' || substr({padded(_K, 16)}, 13, 4) as n_nik, cast({_K} as varchar) as n_count,
  '[REDACTED]' as a_npwp, '["k***y@mail.co.id","x"]' as a_mail, '[REDACTED]' as s_secret, '{{"phone":"0812****' || substr({padded(_K, 7)}, 5, 3) || '","cvv":"[REDACTED]"}}' as s_person,
  '[REDACTED]' as z_kk, cast(null as varchar) as z_note, '5' as strict_input_tokens, '[REDACTED]' as strict_token
from customer
""",
)
def pi_mask_maps(spark, sf_dir):
    """Maps of numbers, arrays, structs and nulls, masked by key."""
    person = f"named_struct('phone', concat('0812', {padded(_K, 7)}), 'cvv', '123')"
    rows = table(spark, sf_dir, "customer").selectExpr(
        f"{_K} as id",
        f"map('access_token', 12345L, 'nik', cast(concat('310000', substr({padded(_K, 16)}, 7, 10)) as bigint), 'count', cast({_K} as bigint)) as n",
        "map('npwp', array('1', '2'), 'mail', array('kept.by@mail.co.id', 'x')) as a",
        f"map('secret', {person}, 'person', {person}) as s",
        "map('kk', cast(null as string), 'note', cast(null as string)) as z",
    )
    strict = mask_frame(rows.selectExpr("id as strict_id", "map('input_tokens', 5, 'token', 6) as strict"), strict_keys=True)
    return mask_frame(rows).join(strict, F.col("id") == F.col("strict_id")).select(
        "id", *[F.col(m)[k].alias(n) for m, k, n in (
            ("n", "access_token", "n_token"), ("n", "nik", "n_nik"), ("n", "count", "n_count"), ("a", "npwp", "a_npwp"), ("a", "mail", "a_mail"),
            ("s", "secret", "s_secret"), ("s", "person", "s_person"), ("z", "kk", "z_kk"), ("z", "note", "z_note"),
            ("strict", "input_tokens", "strict_input_tokens"), ("strict", "token", "strict_token"))]
    )


@query(
    "pi_mask_logs",
    f"""
select conv_id, turn, {masked_sql('text')} as message,
  case when turn % 2 = 0 then {masked_sql("'at ' || text")} end as stacktrace
from conversations
""",
)
def pi_mask_logs(spark, sf_dir):
    logs = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id",
        "turn",
        "text as message",
        "case when turn % 2 = 0 then named_struct('type', 'E', 'message', 'm', 'stacktrace', concat('at ', text)) end as exception",
    )
    return mask_logs(logs).select("conv_id", "turn", "message", "exception.stacktrace")
