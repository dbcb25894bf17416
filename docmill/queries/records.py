"""Extraction of every document type from texts rendered of the business tables.

The expected values come from the source columns, never from a pattern over the text.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.dispatch import extract_mixed, extract_routed, fill_rate
from docmill.plans import registry
from docmill.plans.base import extract
from docmill.queries.common import code, day, dmy, iso, lines, padded, query, spread_table, with_line_ends, worded

AS_OF = dt.date(2026, 1, 1)


def _rendered(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.selectExpr(f"{key} as doc_id", f"{text} as plain").selectExpr(
        "doc_id", f"{with_line_ends('doc_id', 'plain')} as text"
    )


def _fields(df: DataFrame, slug: str) -> DataFrame:
    return extract(df, registry.get(slug), as_of=F.lit(AS_OF)).select("doc_id", "record.*")


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_table(spark, sf_dir, name)


# --- identity card -------------------------------------------------------------------------------

_K = "c_custkey"
_BIRTH = day(_K)
_EXPIRY = day(_K, "2020-01-01", 5000)
_RELIGION = "case c_custkey % 6 when 0 then 'ISLAM' when 1 then 'KRISTEN' when 2 then '{kat}' when 3 then 'HINDU' when 4 then 'BUDDHA' else 'KHONGHUCU' end"
_MARITAL = "case c_custkey % 4 when 0 then 'BELUM KAWIN' when 1 then 'KAWIN' when 2 then 'CERAI HIDUP' else 'CERAI MATI' end"
_BLOOD = "case c_custkey % 4 when 0 then 'A' when 1 then 'B' when 2 then 'AB' else 'O' end"
_UNIT = f"concat({padded('c_custkey % 17', 3)}, '/', {padded('c_custkey % 13', 3)})"


def card_text() -> str:
    """One identity card per customer, with missing, empty, re-labelled and moved values by key."""
    return lines(
        f"concat('PROVINSI ', {code('c_nationkey')})",
        f"concat(case when {_K} % 3 = 0 then '' else 'KOTA ' end, {code(_K + ' % 97')})",
        f"case when {_K} % 10 <> 1 then concat('NIK : 31', {padded(_K, 14)}) end",
        f"case {_K} % 10 when 2 then 'Nama :' when 3 then concat('nama: ', {code(_K)}) "
        f"when 4 then concat('NAMA. ', {code(_K)}) when 7 then concat('Nama :\\n', {code(_K)}) "
        f"else concat('Nama : ', {code(_K)}) end",
        f"case when {_K} % 2 = 0 then concat('Tempat/Tgl Lahir : ', {code(_K + ' % 89')}, ', ', {dmy(_BIRTH)}) "
        f"else concat('TEMPAT TANGGAL LAHIR. ', {code(_K + ' % 89')}, ' ', {dmy(_BIRTH, '/')}) end",
        f"concat('Jenis Kelamin : ', case when {_K} % 2 = 0 then 'LAKI-LAKI' else 'PEREMPUAN' end, '  Gol. Darah : ', {_BLOOD})",
        f"concat('Alamat : JL ', {code(_K + ' % 83')}, ' NO. ', {_K} % 50)",
        f"concat('RT/RW : ', {_UNIT})",
        f"concat('Kel/Desa : ', {code(_K + ' % 79')})",
        f"concat('Kecamatan : ', {code(_K + ' % 73')})",
        f"case when {_K} % 10 <> 8 then concat('Agama : ', {_RELIGION.format(kat='KATOLIK')}) end",
        f"concat('Status Perkawinan : ', {_MARITAL})",
        f"concat('Pekerjaan : ', c_mktsegment)",
        f"concat('Kewarganegaraan : ', case when {_K} % 50 = 0 then 'WNA' else 'WNI' end)",
        f"concat('Berlaku Hingga : ', case when {_K} % 5 = 0 then {dmy(_EXPIRY)} else 'SEUMUR HIDUP' end)",
    )


def card_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(_source(spark, sf_dir, "customer"), _K, card_text())


_CARD_ORACLE = f"""
select {_K} as doc_id,
  {code('c_nationkey')} as document_province,
  case when {_K} % 3 = 0 then '' else 'KOTA ' end || {code(_K + ' % 97')} as document_city,
  case when {_K} % 10 <> 1 then '31' || {padded(_K, 14)} end as document_number,
  case when {_K} % 10 not in (2, 7) then {code(_K)} end as holder_name,
  {code(_K + ' % 89')} as holder_birth_place,
  {iso(_BIRTH)} as holder_birth_date,
  case when {_K} % 2 = 0 then 'LAKI-LAKI' else 'PEREMPUAN' end as holder_gender,
  {_BLOOD} as holder_blood_type,
  'JL ' || {code(_K + ' % 83')} || ' NO. ' || cast({_K} % 50 as varchar) as holder_address,
  {_UNIT} as holder_neighborhood_unit,
  {code(_K + ' % 79')} as holder_village,
  {code(_K + ' % 73')} as holder_district,
  case when {_K} % 10 <> 8 then {_RELIGION.format(kat='KATHOLIK')} end as holder_religion,
  {_MARITAL} as holder_marital_status,
  c_mktsegment as holder_occupation,
  case when {_K} % 50 = 0 then 'WNA' else 'WNI' end as holder_nationality,
  case when {_K} % 5 = 0 then {iso(_EXPIRY)} else 'SEUMUR HIDUP' end as document_expiry_date
from customer
"""


@query("extract_identity_card", _CARD_ORACLE)
def extract_identity_card(spark, sf_dir):
    return _fields(card_texts(spark, sf_dir), "identity_card")


@query(
    "fill_rate",
    f"""
with r as ({_CARD_ORACLE}),
c as (select count(*) as documents, {', '.join(f'count({f}) as {f}' for f in registry.get('identity_card').schema.fieldNames())} from r)
select field, documents, filled, cast(filled as double) / documents as fill_rate
from (unpivot c on columns(* exclude (documents)) into name field value filled)
""",
)
def fill_rate_query(spark, sf_dir):
    records = extract(card_texts(spark, sf_dir), registry.get("identity_card"), as_of=F.lit(AS_OF))
    return fill_rate(records, type_col=None)


# --- taxpayer card -------------------------------------------------------------------------------

_DIGITS = f"concat('02', {padded(_K, 13)})"
_TAXID = (
    f"concat(substr({_DIGITS}, 1, 2), '.', substr({_DIGITS}, 3, 3), '.', substr({_DIGITS}, 6, 3), '.', "
    f"substr({_DIGITS}, 9, 1), '-', substr({_DIGITS}, 10, 3), '.', substr({_DIGITS}, 13, 3))"
)
_REGISTERED = day(_K, "2000-01-01", 8000)


def tax_card_text() -> str:
    return lines(
        "'KEMENTERIAN KEUANGAN'",
        f"concat(case when {_K} % 3 = 0 then 'Kantor Pelayanan Pajak : ' else 'KPP ' end, 'PRATAMA ', {code(_K + ' % 41')})",
        f"case {_K} % 4 when 0 then concat('NPWP : ', {_TAXID}) when 1 then concat({_TAXID}, '\\nPT ', {code(_K)}) "
        f"when 2 then concat('Nomor ', {_DIGITS}) end",
        f"case when {_K} % 4 <> 1 and {_K} % 11 <> 0 then concat('Nama Wajib Pajak : PT ', {code(_K)}) end",
        f"case when {_K} % 5 = 0 then 'ALAMAT' else concat('Alamat. JL ', {code(_K + ' % 61')}) end",
        f"case when {_K} % 7 = 1 then concat('Tgl Daftar ', {dmy(_REGISTERED, '.')}) "
        f"when {_K} % 7 <> 0 then concat('Tanggal Terdaftar : ', {dmy(_REGISTERED, '/')}) end",
    )


def tax_card_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(_source(spark, sf_dir, "customer"), _K, tax_card_text())


@query(
    "extract_tax_number",
    f"""
select {_K} as doc_id,
  case {_K} % 4 when 0 then {_TAXID} when 1 then {_TAXID} when 2 then {_DIGITS} end as tax_number,
  case when {_K} % 4 = 1 or {_K} % 11 <> 0 then 'PT ' || {code(_K)} end as business_name,
  'KPP PRATAMA ' || {code(_K + ' % 41')} as tax_office,
  case when {_K} % 5 <> 0 then 'JL ' || {code(_K + ' % 61')} end as tax_office_address,
  case when {_K} % 7 <> 0 then {iso(_REGISTERED)} end as tax_registration_date
from customer
""",
)
def extract_tax_number(spark, sf_dir):
    return _fields(tax_card_texts(spark, sf_dir), "tax_number")


# --- business number -----------------------------------------------------------------------------

_P = "p_partkey"
_NIB = f"concat('2', {padded(_P, 12)})"
_ISSUED = day(_P, "2018-08-01", 2500)
_AMENDED = day(_P, "2021-01-01", 1500)
_PRINTED = day(_P, "2024-01-01", 700)


def business_number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lines(
        "'PEMERINTAH REPUBLIK INDONESIA'",
        f"case when {_P} % 3 = 0 then {_NIB} else concat('NOMOR INDUK BERUSAHA : ', {_NIB}) end",
        f"concat(case when {_P} % 2 = 0 then '1. ' else '' end, 'Nama Pelaku Usaha : CV ', {code(_P)})",
        f"case when {_P} % 10 = 2 then '2. Alamat Kantor :' else concat('2. Alamat Kantor : JL ', {code(_P + ' % 67')}, ', Kota') end",
        f"concat('Kode Pos : ', {padded(_P + ' % 100000', 5)})",
        f"case when {_P} % 10 <> 3 then concat('No. Telepon : 021', {padded(_P, 7)}) end",
        f"concat('Email : k', {_P}, '@usaha.co.id')",
        f"concat('3. Status Penanaman Modal : ', case when {_P} % 2 = 0 then 'pmdn' else 'PMA' end)",
        f"concat('Diterbitkan di : Jakarta, tanggal : ', {worded(_ISSUED)})",
        f"case when {_P} % 4 = 0 then concat('Perubahan ke-', {_P} % 9 + 1, ', tanggal : ', {worded(_AMENDED)}) end",
        f"concat('Dicetak tanggal : ', {dmy(_PRINTED, '/')})",
    )
    return _rendered(_source(spark, sf_dir, "part"), _P, text)


@query(
    "extract_business_identification_number",
    f"""
select {_P} as doc_id, {_NIB} as business_number, 'CV ' || {code(_P)} as business_name,
  case when {_P} % 10 <> 2 then 'JL ' || {code(_P + ' % 67')} || ', Kota' end as business_address,
  {padded(_P + ' % 100000', 5)} as business_postal_code,
  case when {_P} % 10 <> 3 then '021' || {padded(_P, 7)} end as business_phone_number,
  'k' || cast({_P} as varchar) || '@usaha.co.id' as business_email,
  case when {_P} % 2 = 0 then 'PMDN' else 'PMA' end as business_investment_status,
  'Jakarta' as document_issued_place, {iso(_ISSUED)} as document_issued_date,
  case when {_P} % 4 = 0 then cast({_P} % 9 + 1 as varchar) end as amendment_number,
  case when {_P} % 4 = 0 then {iso(_AMENDED)} end as amendment_date,
  {iso(_PRINTED)} as document_printed_date,
  cast(null as varchar) as signing_official_title
from part
""",
)
def extract_business_number(spark, sf_dir):
    return _fields(business_number_texts(spark, sf_dir), "business_identification_number").drop("business_fields")


# --- taxable-entrepreneur letter -----------------------------------------------------------------

_SINCE = day(_K, "1990-01-01", 9000)
_LETTER = day(_K, "2012-01-01", 4000)


def tax_entity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lines(
        f"concat('KANTOR WILAYAH DJP ', {code('c_nationkey')})",
        f"concat('KPP PRATAMA ', {code(_K + ' % 41')})",
        f"case when {_K} % 3 <> 0 then concat('JL ', {code(_K + ' % 43')}) end",
        "'TELEPON 021 1'",
        f"concat('S-', {_K}, 'PKP/WPJ.05/KP.1003/2015')",
        f"concat('1. Nomor Pokok Wajib Pajak : ', {_TAXID})",
        f"concat('2. Nama : PT ', {code(_K)})",
        f"concat('3. Klasifikasi Lapangan Usaha : ', {padded(_K + ' % 90000', 5)}, ' - JASA ', {code(_K + ' % 31')}, '\\nLANJUTAN')",
        f"case when {_K} % 2 = 0 then '46620 - GROSIR' end",
        f"concat('4. Alamat : JL ', {code(_K + ' % 53')}, '\\nKEBON')",
        f"concat('5. Merk Dagang/Usaha : ', case when {_K} % 3 = 0 then '-' else {code(_K + ' % 29')} end)",
        f"concat('6. Kewajiban Pajak : [', case when {_K} % 5 = 0 then ' ' else 'X' end, '] PPN [', case when {_K} % 2 = 0 then 'x' else ' ' end, '] PPnBM')",
        f"concat('terhitung sejak ', {worded(_SINCE)}, '.')",
        f"concat('Jakarta Barat, ', {worded(_LETTER)})",
        "'a.n. Kepala Kantor\\nKepala Seksi Pelayanan,'",
        f"case when {_K} % 4 = 0 then 'Sri' else {code(_K + ' % 37')} end",
        f"concat('NIP.1970', {padded(_K, 14)})",
    )
    return _rendered(_source(spark, sf_dir, "customer"), _K, text)


@query(
    "extract_tax_entity",
    f"""
select {_K} as doc_id, 'S-' || cast({_K} as varchar) || 'PKP/WPJ.05/KP.1003/2015' as letter_number,
  'KANTOR WILAYAH DJP ' || {code('c_nationkey')} as tax_office_region,
  'KPP PRATAMA ' || {code(_K + ' % 41')} as tax_office_name,
  case when {_K} % 3 <> 0 then 'JL ' || {code(_K + ' % 43')} end as tax_office_address,
  {_TAXID} as business_tax_number, 'PT ' || {code(_K)} as business_name,
  {padded(_K + ' % 90000', 5)} || '=JASA ' || {code(_K + ' % 31')} || ' LANJUTAN'
    || case when {_K} % 2 = 0 then '|46620=GROSIR' else '' end as business_fields,
  'JL ' || {code(_K + ' % 53')} || ', KEBON' as business_address,
  case when {_K} % 3 <> 0 then {code(_K + ' % 29')} end as business_trade,
  case when {_K} % 5 = 0 then case when {_K} % 2 = 0 then 'PPnBM' end
       else 'PPN' || case when {_K} % 2 = 0 then '; PPnBM' else '' end end as tax_obligation,
  {iso(_SINCE)} as letter_confirmed_since, 'Jakarta Barat' as letter_issued_place,
  {iso(_LETTER)} as letter_issued_date,
  'a.n. Kepala Kantor Kepala Seksi Pelayanan' as signing_official_title,
  case when {_K} % 4 <> 0 then {code(_K + ' % 37')} end as signing_official_name,
  '1970' || {padded(_K, 14)} as signing_official_number
from customer
""",
)
def extract_tax_entity(spark, sf_dir):
    found = _fields(tax_entity_texts(spark, sf_dir), "tax_entity")
    pairs = F.transform("business_fields", lambda f: F.concat(f["field_code"], F.lit("="), f["field_title"]))
    return found.withColumn("business_fields", F.array_join(pairs, "|"))


# --- passport ------------------------------------------------------------------------------------

_PBIRTH = day(_K, "1930-01-01", 40000)
_PEXPIRY = day(_K, "2020-01-01", 5000)


def passport_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = f"rpad(concat('P<IDN', {code(_K)}, '<<', {code(_K + ' % 23', 3)}, '<', {code(_K + ' % 19', 2)}), 44, '<')"
    two = (
        f"rpad(concat('A', {padded(_K, 8)}, '0IDN', "
        f"case when {_K} % 10 = 2 then '999999' else date_format({_PBIRTH}, 'yyMMdd') end, '0', "
        f"case when {_K} % 2 = 0 then 'M' else 'F' end, date_format({_PEXPIRY}, 'yyMMdd'), '0'), 44, '<')"
    )
    text = lines(
        "'PASPOR REPUBLIK INDONESIA'",
        f"case when {_K} % 10 <> 1 then case when {_K} % 10 = 3 then lower({one}) else {one} end end",
        f"case when {_K} % 10 = 4 then concat(substr({two}, 1, 20), ' ', substr({two}, 21, 24)) else {two} end",
    )
    return _rendered(_source(spark, sf_dir, "customer"), _K, text)


_ONE = f"rpad('P<IDN' || {code(_K)} || '<<' || {code(_K + ' % 23', 3)} || '<' || {code(_K + ' % 19', 2)}, 44, '<')"
# A two-digit year stands for the 2000s unless that day is after the reference day.
_PSEEN = (
    f"case when {_K} % 10 = 2 then null when try_cast('20' || strftime({_PBIRTH}, '%y-%m-%d') as date) is null then null "
    f"when try_cast('20' || strftime({_PBIRTH}, '%y-%m-%d') as date) > date '{AS_OF}' "
    f"then cast(try_cast('19' || strftime({_PBIRTH}, '%y-%m-%d') as date) as varchar) "
    f"else '20' || strftime({_PBIRTH}, '%y-%m-%d') end"
)
_PTWO = (
    f"rpad('A' || {padded(_K, 8)} || '0IDN' || case when {_K} % 10 = 2 then '999999' else strftime({_PBIRTH}, '%y%m%d') end "
    f"|| '0' || case when {_K} % 2 = 0 then 'M' else 'F' end || strftime({_PEXPIRY}, '%y%m%d') || '0', 44, '<')"
)


@query(
    "mrz_parse",
    f"""
with s as (select *, {_K} % 10 <> 1 as seen from customer)
select {_K} as doc_id, case when seen then 'P' end as document_type,
  case when seen then 'IDN' end as document_issuing_country,
  case when seen then {code(_K)} end as holder_surname,
  case when seen then {code(_K + ' % 23', 3)} || ' ' || {code(_K + ' % 19', 2)} end as holder_given_names,
  case when seen then 'A' || {padded(_K, 8)} end as holder_passport_number,
  case when seen then 'IDN' end as holder_nationality,
  case when seen then {_PSEEN} end as holder_birth_date,
  case when seen then case when {_K} % 2 = 0 then 'M' else 'F' end end as holder_gender,
  cast(null as varchar) as holder_birth_place, cast(null as varchar) as document_issued_date,
  case when seen then {iso(_PEXPIRY)} end as document_expiry_date,
  cast(null as varchar) as document_issuing_authority,
  case when seen then {_ONE} end as document_mrz_line1,
  case when seen then {_PTWO} end as document_mrz_line2
from s
""",
)
def mrz_parse(spark, sf_dir):
    return _fields(passport_texts(spark, sf_dir), "identity_passport")


# --- deed ----------------------------------------------------------------------------------------

_O = "o_orderkey"
_DEED_DAY = "cast(o_orderdate as date)"


def deed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lines(
        f"case when {_O} % 7 = 0 then concat('nomor ', {_O} % 50, '. lampiran ', repeat('kata ', 20)) end",
        f"case {_O} % 3 when 0 then 'AKTA PENDIRIAN' when 1 then 'Pendirian lama\\nPERUBAHAN ANGGARAN DASAR' end",
        f"concat('Nomor : ', {_O} % 999 + 1, '.')",
        f"concat('-Pada hari ini, Senin, tanggal ', {dmy(_DEED_DAY)})",
        f"case when {_O} % 5 <> 0 then concat('Berhadapan dengan saya, ', {code(_O)}, '\\n---\\nPUTRI, Sarjana Hukum, Notaris') end",
        "'dalam akta pendirian nomor 10 tanggal 01-01-2010'",
        f"case when {_O} % 4 = 0 then concat('KEPUTUSAN MENTERI HUKUM DAN HAK ASASI MANUSIA REPUBLIK INDONESIA\\n"
        f"NOMOR AHU-', {padded(_O, 7)}, '.AH.01.02.TAHUN 2022\\nDitetapkan di Jakarta, Tanggal ', {worded(_DEED_DAY)}) "
        f"when {_O} % 4 = 1 then concat('SK Menteri Hukum\\nNomor : AHU-', {_O}, '.TAHUN 2005') end",
    )
    return _rendered(_source(spark, sf_dir, "orders"), _O, text)


@query(
    "extract_business_deed",
    f"""
select {_O} as doc_id, case {_O} % 3 when 0 then 'Pendirian' when 1 then 'Perubahan' end as deed_type,
  cast({_O} % 999 + 1 as varchar) as deed_number, {iso(_DEED_DAY)} as deed_date,
  case when {_O} % 5 <> 0 then {code(_O)} || ' PUTRI' end as notary_name,
  cast(null as varchar) as notary_address,
  case when {_O} % 4 = 0 then 'AHU-' || {padded(_O, 7)} || '.AH.01.02.TAHUN 2022' end as decision_number,
  case when {_O} % 4 = 0 then {iso(_DEED_DAY)} end as decision_issued_date
from orders
""",
)
def extract_business_deed(spark, sf_dir):
    return _fields(deed_texts(spark, sf_dir), "business_deed")


# --- stay permit ---------------------------------------------------------------------------------


def stay_text() -> str:
    return lines(
        f"concat('KANIM KELAS I ', {code('c_nationkey')})",
        f"case when {_K} % 3 = 0 then 'ALAMAT KANTOR' else concat('JL. ', {code(_K + ' % 47')}) end",
        f"case when {_K} % 10 = 2 then 'NIORA :\\nNIORA : XX' else concat('NIORA : AB', {padded(_K, 8)}) end",
        f"concat('Permit Number : 2C', {padded(_K, 8)}, 'Z')",
        f"concat('Stay/Multiple Entries Permit Expiry : ', {dmy(_EXPIRY)})",
        "'Stay Permit Index : C312'",
        f"concat('Full Name : ', {code(_K)})",
        f"concat('Place / Date of Birth : ', {code(_K + ' % 89')}, ' / ', {dmy(_BIRTH)})",
        f"concat('Passport Number : ', case when {_K} % 10 = 3 then '-' else concat('P', {padded(_K, 7)}) end)",
        f"concat('Passport Expiry : ', case when {_K} % 10 = 4 then 'none' else {dmy(_PEXPIRY, '.')} end)",
        f"concat('Nationality : ', {code('c_nationkey', 3)})",
        f"concat('Gender : ', case when {_K} % 2 = 0 then 'MALE' else 'FEMALE' end)",
        f"concat('Address : JL ', {code(_K + ' % 71')}, case when {_K} % 4 = 0 then '' else '\\nKEBAYORAN' end)",
        "concat('Occupation : ', c_mktsegment)",
        "'Status : WORKING'",
        f"case when {_K} % 6 <> 0 then concat('Guarantor Name : PT ', {code(_K + ' % 59')}) end",
        f"concat('Jakarta, ', {dmy(_LETTER)})",
        f"case when {_K} % 8 <> 0 then 'Head of Kelas I Immigration Office' end",
    )


def stay_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(_source(spark, sf_dir, "customer"), _K, stay_text())


@query(
    "extract_identity_stay",
    f"""
select {_K} as doc_id, 'KANIM KELAS I ' || {code('c_nationkey')} as permit_issuing_office,
  case when {_K} % 3 <> 0 then 'JL. ' || {code(_K + ' % 47')} end as permit_issuing_office_address,
  case when {_K} % 10 <> 2 then 'AB' || {padded(_K, 8)} end as permit_niora,
  '2C' || {padded(_K, 8)} || 'Z' as permit_number, {iso(_EXPIRY)} as permit_expiry_date,
  'C312' as permit_index, {code(_K)} as holder_full_name, {code(_K + ' % 89')} as holder_birth_place,
  {iso(_BIRTH)} as holder_birth_date,
  case when {_K} % 10 <> 3 then 'P' || {padded(_K, 7)} end as holder_passport_number,
  case when {_K} % 10 <> 4 then {iso(_PEXPIRY)} end as holder_passport_expiry_date,
  {code('c_nationkey', 3)} as holder_nationality,
  case when {_K} % 2 = 0 then 'MALE' else 'FEMALE' end as holder_gender,
  'JL ' || {code(_K + ' % 71')} || case when {_K} % 4 = 0 then '' else ' KEBAYORAN' end as holder_address,
  c_mktsegment as holder_occupation, 'WORKING' as holder_status,
  case when {_K} % 6 <> 0 then 'PT ' || {code(_K + ' % 59')} end as holder_guarantor,
  case when {_K} % 8 <> 0 then 'Jakarta' end as permit_issued_place,
  case when {_K} % 8 <> 0 then {iso(_LETTER)} end as permit_issued_date
from customer
""",
)
def extract_identity_stay(spark, sf_dir):
    return _fields(stay_texts(spark, sf_dir), "identity_stay")


# --- local-value certificate ---------------------------------------------------------------------


def local_value_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lines(
        "'SERTIFIKAT TINGKAT KOMPONEN DALAM NEGERI'",
        "concat('Jenis Produk : ', p_name)",
        f"concat('Tipe : ', case when {_P} % 3 = 0 then '-' else p_type end)",
        f"concat('Spesifikasi : ukuran ', p_size, case when {_P} % 2 = 0 then '\\nlanjutan\\nakhir' else '' end)",
        f"concat('Kode HS : ', {padded(_P, 8)})",
        "concat('Merk : ', p_brand)",
        f"concat('Nilai TKDN : ', case when {_P} % 5 = 0 then 'Terlampir' else concat({_P} % 100, ',', {padded(_P + ' % 90 + 10', 2)}, '%') end)",
        "'Standard Produk : -'",
        f"concat('No. Laporan : LPA-', {_P}, '/X/22')",
        f"concat('berlaku ', {_P} % 4 + 1, ' tahun')",
        f"concat('Nama Perusahaan : PT ', {code(_P)})",
        f"concat('Alamat : Jl ', {code(_P + ' % 67')}, '\\nCikarang')",
        f"concat('NPWP : ', {_NIB})",
        f"case when {_P} % 2 = 0 then 'Bidang Usaha : Industri' else 'Jenis Industri : Listrik' end",
        f"concat('No. Tanda Sah : ', {_P}, '/SJ/2022')",
        f"concat('Jakarta, ', {worded(_ISSUED)})",
        "'Kepala Pusat Peningkatan'",
        f"case when {_P} % 6 = 0 then 'N1la' else 'Dewi Lestari' end",
        f"case when {_P} % 7 <> 0 then concat('#', {_P} + 1000) end",
    )
    return _rendered(_source(spark, sf_dir, "part"), _P, text)


@query(
    "extract_certificate_local_value",
    f"""
select {_P} as doc_id, p_name as product_name, case when {_P} % 3 <> 0 then p_type end as product_type,
  'ukuran ' || cast(p_size as varchar) || case when {_P} % 2 = 0 then ' lanjutan akhir' else '' end as product_specification,
  {padded(_P, 8)} as product_hs, p_brand as product_brand,
  case when {_P} % 5 <> 0 then ({_P} % 100 * 100 + {_P} % 90 + 10) / 100.0::double end as product_local_value,
  cast(null as varchar) as product_standard, cast(null as varchar) as product_certificate,
  'LPA-' || cast({_P} as varchar) || '/X/22' as report_number,
  cast({_P} % 4 + 1 as int) as certificate_valid_year, 'PT ' || {code(_P)} as business_name,
  'Jl ' || {code(_P + ' % 67')} || ' Cikarang' as business_address, {_NIB} as business_tax_number,
  case when {_P} % 2 = 0 then 'Industri' else 'Listrik' end as business_field,
  cast({_P} as varchar) || '/SJ/2022' as certificate_number, 'Jakarta' as certificate_issued_place,
  {iso(_ISSUED)} as certificate_issued_date, 'Kepala Pusat Peningkatan' as signing_official_title,
  case when {_P} % 6 <> 0 then 'Dewi Lestari' end as signing_official_name,
  case when {_P} % 7 <> 0 then cast({_P} + 1000 as varchar) end as certificate_qr_number
from part
""",
)
def extract_certificate_local_value(spark, sf_dir):
    return _fields(local_value_texts(spark, sf_dir), "certificate_local_value")


# --- bank account --------------------------------------------------------------------------------

_ACCOUNT = f"concat('1270-', {padded(_K, 10)})"
_BANKS = "case {k} % 4 when 0 then '{a}' when 1 then '{b}' when 2 then '{c}' else '{d}' end"


def bank_text() -> str:
    passbook = f"{_K} % 4 = 0 and {_K} % 3 = 0"
    bank = _BANKS.format(k=_K, a="BANK CENTRAL ASIA", b="Tabungan Bank BRI Simpedes", c="mandiri", d="Bank Name : Bank Desa")
    return lines(
        f"case when {passbook} then concat('KCP ', {code(_K + ' % 47')}, '\\n', {padded(_K, 10)}, '\\n', {code(_K)}) end",
        bank,
        f"case when {passbook} then null when {_K} % 5 = 0 then concat('Account No : ', {_ACCOUNT}, ' - PT ', {code(_K)}) "
        f"when {_K} % 5 = 1 then concat('Your account is ', {_ACCOUNT}, ' now') "
        f"when {_K} % 5 = 2 then 'No. Rekening : 0000****1234' "
        f"else concat('No. Rekening : ', {_ACCOUNT}) end",
        f"case when not ({passbook}) and {_K} % 5 <> 0 then concat('Atas Nama : ', {code(_K)}) end",
        f"case when not ({passbook}) then case when {_K} % 2 = 0 then concat('Branch :\\nCabang : ', {code(_K + ' % 43')}) else concat('KCP ', {code(_K + ' % 43')}) end end",
        f"case when {_K} % 7 = 0 then 'Jenis Rekening : Giro' when {_K} % 7 = 1 then 'produk TAB MANDIRI' end",
    )


def bank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(_source(spark, sf_dir, "customer"), _K, bank_text())


@query(
    "extract_bank_account",
    f"""
with s as (select *, {_K} % 4 = 0 and {_K} % 3 = 0 as passbook from customer)
select {_K} as doc_id,
  {_BANKS.format(k=_K, a="Bank Central Asia", b="Bank Rakyat Indonesia", c="Bank Mandiri", d="{d}").replace("'{d}'", f"case when {_K} % 7 = 1 then 'Bank Mandiri' else 'Bank Desa' end")} as bank_name,
  case when passbook then 'KCP ' || {code(_K + ' % 47')} when {_K} % 2 = 0 then {code(_K + ' % 43')}
       else 'KCP ' || {code(_K + ' % 43')} end as bank_branch,
  case when passbook then {padded(_K, 10)} when {_K} % 5 <> 2 then {_ACCOUNT} end as account_number,
  case when passbook then {code(_K)} when {_K} % 5 = 0 then 'PT ' || {code(_K)} else {code(_K)} end as account_holder,
  case when {_K} % 7 = 0 then 'Giro' when {_K} % 4 = 1 then 'Simpedes' when {_K} % 7 = 1 then 'Tabungan Mandiri' end as account_type
from s
""",
)
def extract_bank_account(spark, sf_dir):
    # the product line "TAB MANDIRI" also names the bank, by the word on its own
    return _fields(bank_texts(spark, sf_dir), "bank_account")


# --- transcript ----------------------------------------------------------------------------------

_START = day(_K, "2005-01-01", 3000)
_GRADUATED = day(_K, "2010-01-01", 4000)
_GPA = f"{_K} % 200 + 200"


def transcript_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lines(
        f"concat('UNIVERSITAS ', {code('c_nationkey')})",
        f"case when {_K} % 2 = 0 then concat('Fakultas ', {code(_K + ' % 11')}) end",
        f"case {_K} % 10 when 2 then 'Nama :' when 3 then concat('Name\\n: ', {code(_K)}) "
        f"when 4 then concat('Nama (Name)：', {code(_K)}) else concat('Nama Mahasiswa : ', {code(_K)}) end",
        f"concat('NIM : ', {padded(_K, 9)})",
        f"concat('No. Seri : S', {padded(_K, 6)})",
        f"case when {_K} % 3 = 0 then concat('Program Studi : ', {code(_K + ' % 13')}) end",
        f"concat('Jenjang Pendidikan : ', case {_K} % 4 when 0 then 'Diploma III' when 1 then 'Sarjana' when 2 then 'Magister' else 'Kursus' end)",
        f"concat('Mulai Pendidikan : ', case when {_K} % 2 = 0 then {worded(_START)} else date_format({_START}, 'MMMM d, yyyy') end)",
        f"concat('IPK : ', floor(({_GPA}) / 100), ',', {padded('(' + _GPA + ') % 100', 2)}, case when {_K} % 2 = 0 then ' (x)' else '' end)",
        f"concat('Jumlah SKS : ', {_K} % 60 + 100, ' kredit')",
        f"concat('Medan, ', {worded(_GRADUATED)})",
        "'Rektor'",
    )
    return _rendered(_source(spark, sf_dir, "customer"), _K, text)


@query(
    "extract_certificate_education",
    f"""
select {_K} as doc_id, 'S' || {padded(_K, 6)} as transcript_number,
  case when {_K} % 10 <> 2 then {code(_K)} end as student_name, {padded(_K, 9)} as student_number,
  case when {_K} % 3 = 0 then {code(_K + ' % 13')} when {_K} % 2 = 0 then 'Fakultas ' || {code(_K + ' % 11')} end as student_major,
  'UNIVERSITAS ' || {code('c_nationkey')} as student_institution,
  case {_K} % 4 when 0 then 'D3' when 1 then 'S1' when 2 then 'S2' else 'Kursus' end as enroll_level,
  {iso(_START)} as enroll_date, cast({_K} % 60 + 100 as varchar) as transcript_credit,
  cast({_GPA} as double) / 100 as transcript_grade, 'Medan' as transcript_issued_place,
  {iso(_GRADUATED)} as transcript_issued_date
from customer
""",
)
def extract_certificate_education(spark, sf_dir):
    return _fields(transcript_texts(spark, sf_dir), "certificate_education").drop("enroll_courses")


# --- competency certificate ----------------------------------------------------------------------


def competency_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = lines(
        f"concat('Nomor Sertifikat : C/', {_K}, '/21')",
        f"concat('Nama Peserta : ', {code(_K)})",
        f"concat('Course Title: Kursus ', {code(_K + ' % 17')})",
        "'Bidang : -'",
        f"case when {_K} % 3 = 0 then 'Issuer: LSP Satu' else 'Dicoding Indonesia' end",
        f"concat('Start Date: ', date_format({_START}, 'MMMM d, yyyy'))",
        f"concat('Tanggal Selesai: ', {worded(_START)})",
        f"concat('Grade: ', case when {_K} % 2 = 0 then 'A-' else 'B' end)",
        f"concat('Valid Until: ', {dmy(_GRADUATED, '/')})",
    )
    marked = lines(
        "'BADAN NASIONAL SERTIFIKASI PROFESI'",
        f"concat('No. 64141 4211 ', {_K})",
        f"concat('Dengan ini menyatakan bahwa,\\nThis is to certify that,\\n', {code(_K)})",
        "'No. Reg. KK 036 1'",
        f"concat('Telah memenuhi persyaratan dan kompeten pada kualifikasi:\\n1. PDB.EI.', {padded(_K, 6)}, '.01\\n2. PDB.EI.X9.02')",
        f"concat('Pada bidang pekerjaan:\\nIn the area of:\\n', {code(_K + ' % 7')})",
        f"case when {_K} % 5 = 0 then 'Dengan Kualifikasi / Kompetensi:\\nWith Qualification / Competency:\\nKASIR' end",
        f"concat('Jakarta, ', {worded(_GRADUATED)})",
        f"case when {_K} % 3 = 0 then 'Lembaga Sertifikasi Profesi LP' end",
    )
    return _rendered(
        _source(spark, sf_dir, "customer"), _K, f"case when {_K} % 2 = 0 then {labelled} else {marked} end"
    )


@query(
    "extract_certificate_competency",
    f"""
with s as (select *, {_K} % 2 = 0 as labelled from customer)
select {_K} as doc_id,
  case when labelled then 'C/' || cast({_K} as varchar) || '/21' else '64141 4211 ' || cast({_K} as varchar) end as certificate_number,
  {code(_K)} as certificate_holder,
  case when labelled then 'Kursus ' || {code(_K + ' % 17')} when {_K} % 5 = 0 then 'KASIR' end as training_title,
  case when not labelled then {code(_K + ' % 7')} end as training_field,
  case when labelled then case when {_K} % 3 = 0 then 'LSP Satu' else 'Dicoding Indonesia' end
       when {_K} % 3 = 0 then 'Lembaga Sertifikasi Profesi LP' else 'Badan Nasional Sertifikasi Profesi' end as training_institution,
  case when labelled then {iso(_START)} end as training_start_date,
  case when labelled then {iso(_START)} end as training_end_date,
  case when labelled then case when {_K} % 2 = 0 then 'A-' else 'B' end end as training_grade,
  case when not labelled then 'Jakarta' end as certificate_issued_place,
  case when not labelled then {iso(_GRADUATED)} end as certificate_issued_date,
  case when labelled then {iso(_GRADUATED)} end as certificate_expiry_date,
  case when not labelled then 'PDB.EI.' || {padded(_K, 6)} || '.01|PDB.EI.X9.02' end as training_units
from s
""",
)
def extract_certificate_competency(spark, sf_dir):
    found = _fields(competency_texts(spark, sf_dir), "certificate_competency")
    return found.withColumn("training_units", F.array_join(F.transform("training_units", lambda u: u["unit_code"]), "|"))


# --- all types in one pass -----------------------------------------------------------------------


def mixed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of several types in one table, with some unknown types and blank texts."""
    kinds = [
        ("identity_card", card_text),
        ("tax_number", tax_card_text),
        ("bank_account", bank_text),
        ("identity_stay", stay_text),
    ]
    slug = " ".join(f"when {i} then '{name}'" for i, (name, _) in enumerate(kinds))
    text = " ".join(f"when {i} then {make()}" for i, (_, make) in enumerate(kinds))
    return _source(spark, sf_dir, "customer").selectExpr(
        f"{_K} as doc_id",
        f"case when {_K} % 31 = 0 then 'recipe' else case {_K} % 4 {slug} end end as document_type",
        f"case when {_K} % 29 = 0 then ' \\n ' else case {_K} % 4 {text} end end as text",
    )


_MIXED_SQL = f"""
select {_K} as doc_id,
  case when {_K} % 31 = 0 then 'Unknown document type' when {_K} % 29 = 0 then 'Empty text provided for analysis' end as error,
  case when {_K} % 31 <> 0 and {_K} % 29 <> 0 then
    case {_K} % 4
      when 0 then case when {_K} % 10 not in (2, 7) then {code(_K)} end
      when 1 then 'PT ' || {code(_K)}
      when 2 then case when {_K} % 5 = 0 then 'PT ' || {code(_K)} else {code(_K)} end
      else {code(_K)} end end as party
from customer
"""


@query("extract_mixed", _MIXED_SQL)
def extract_mixed_query(spark, sf_dir):
    found = extract_routed(mixed_texts(spark, sf_dir), as_of=F.lit(AS_OF))
    names = ["holder_name", "business_name", "account_holder", "holder_full_name"]
    party = F.coalesce(*[F.get_json_object("data", f"$.{n}") for n in names])
    return found.select("doc_id", "error", party.alias("party"))


@query("extract_one_pass", _MIXED_SQL)
def extract_one_pass(spark, sf_dir):
    """The same rows by the plan for streams: all types in one pass."""
    found = extract_mixed(mixed_texts(spark, sf_dir), as_of=F.lit(AS_OF))
    names = ["holder_name", "business_name", "account_holder", "holder_full_name"]
    party = F.coalesce(*[F.get_json_object("data", f"$.{n}") for n in names])
    return found.select("doc_id", "error", party.alias("party"))
