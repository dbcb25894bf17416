"""Field extraction on small printed texts (EX1-EX11 with their normalisers)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docmill.plans import registry
from docmill.plans.base import extract

MRZ1 = "P<NLDVAN<DIJK<<ANNA<MARIA".ljust(44, "<")
MRZ2 = "SPECI20140NLD6503101F2403096".ljust(43, "<") + "4"

CASES = {
    "card": (
        "identity_card",
        """
        PROVINSI JAWA TIMUR
        KOTA SURABAYA
        NIK : 3578O1O1O1850002
        Nama : SITI RAHAYU
        Tempat/Tgl Lahir : SURABAYA, 17-08-1985
        Jenis Kelamin : PEREMPUAN  Gol. Darah : AB
        Alamat : JL KENARI NO. 12
        RT/RW : 003/007
        Kel/Desa : GUBENG
        Kecamatan : GUBENG
        Agama : KATOLIK
        Status Perkawinan : CERAI HIDUP
        Pekerjaan : GURU
        Kewarganegaraan : WNI
        Berlaku Hingga : 17/08/2027
        """,
        {
            "document_province": "JAWA TIMUR", "document_city": "KOTA SURABAYA",
            "document_number": "3578010101850002", "holder_name": "SITI RAHAYU",
            "holder_birth_place": "SURABAYA", "holder_birth_date": "1985-08-17",
            "holder_gender": "PEREMPUAN", "holder_blood_type": "AB", "holder_address": "JL KENARI NO. 12",
            "holder_neighborhood_unit": "003/007", "holder_village": "GUBENG", "holder_district": "GUBENG",
            "holder_religion": "KATHOLIK", "holder_marital_status": "CERAI HIDUP",
            "holder_occupation": "GURU", "holder_nationality": "WNI", "document_expiry_date": "2027-08-17",
        },
    ),
    "card_sparse": (
        "identity_card",
        "PROVINSI BALI\nDENPASAR\nNama :\nNama : I MADE\nTempat/Tgl Lahir : GIANYAR 01-02-1970\nlaki-laki hindu",
        {
            "document_province": "BALI", "document_city": "DENPASAR", "holder_name": "I MADE",
            "holder_birth_place": "GIANYAR", "holder_birth_date": "1970-02-01", "holder_gender": "LAKI-LAKI",
            "holder_religion": "HINDU", "holder_nationality": "WNI", "document_expiry_date": "SEUMUR HIDUP",
        },
    ),
    "card_id_swallows_next_line": (
        "identity_card",
        "NIK : 3171010101900001\nBOB : X",
        {"document_number": "3171010101900001", "holder_nationality": "WNI", "document_expiry_date": "SEUMUR HIDUP"},
    ),
    "taxpayer": (
        "tax_number",
        """KPP MADYA MALANG
        NPWP : 98.765.432.1-636.000
        Nama Wajib Pajak : PT ANGIN TIMUR
        Alamat : JL IJEN 5 MALANG
        Tanggal Terdaftar : 02/03/2019""",
        {
            "tax_number": "98.765.432.1-636.000", "business_name": "PT ANGIN TIMUR",
            "tax_office": "KPP MADYA MALANG", "tax_office_address": "JL IJEN 5 MALANG",
            "tax_registration_date": "2019-03-02",
        },
    ),
    "taxpayer_name_below_number": (
        "tax_number",
        "Kantor Pelayanan Pajak Pratama Batu\n98.765.432.1-636.000\nHARTONO\nTerdaftar 02.03.2019",
        {
            "tax_number": "98.765.432.1-636.000", "business_name": "HARTONO", "tax_office": "KPP Pratama Batu",
            "tax_registration_date": "2019-03-02",
        },
    ),
    "business_number": (
        "business_identification_number",
        """
        NOMOR INDUK BERUSAHA : 9120001234567
        1. Nama Pelaku Usaha : CV LAUT BIRU
        2. Alamat Kantor : JL. PELABUHAN 3, Kota Bitung
        Kode Pos : 95522
        No. Telepon : 0438 12345
        Email : kantor@lautbiru.co.id
        3. Status Penanaman Modal : pmdn
        Diterbitkan di : Bitung, tanggal : 7 Maret 2021
        Perubahan ke-2, tanggal : 08 Mei 2022
        Dicetak tanggal : 09/06/2022
        """,
        {
            "business_number": "9120001234567", "business_name": "CV LAUT BIRU",
            "business_address": "JL. PELABUHAN 3, Kota Bitung", "business_postal_code": "95522",
            "business_phone_number": "0438 12345", "business_email": "kantor@lautbiru.co.id",
            "business_investment_status": "PMDN", "document_issued_place": "Bitung",
            "document_issued_date": "2021-03-07", "amendment_number": "2", "amendment_date": "2022-05-08",
            "document_printed_date": "2022-06-09",
        },
    ),
    "tax_entity": (
        "tax_entity",
        """
        KANTOR WILAYAH DJP JAWA TENGAH I
        KPP PRATAMA SEMARANG BARAT
        JL. PEMUDA 1, SEMARANG
        TELEPON 024 123456
        S-12PKP/WPJ.10/KP.0503/2018
        1. Nomor Pokok Wajib Pajak : 02.468.135.7-503.000
        2. Nama : PT. KAYU JATI
        3. Klasifikasi Lapangan Usaha : 16221 - INDUSTRI BARANG BANGUNAN
        DARI KAYU
        46620 - PERDAGANGAN BESAR
        4. Alamat : JL. RAYA 9
        TUGU
        5. Merk Dagang/Usaha : -
        6. Kewajiban Pajak : [X] PPN [x] PPnBM [ ] PPh
        terhitung sejak 5 April 2010.
        Semarang, 11 Juni 2018
        a.n. Kepala Kantor
        Kepala Seksi Pelayanan,
        SRI WAHYUNI
        NIP.197001011990032001
        """,
        {
            "letter_number": "S-12PKP/WPJ.10/KP.0503/2018",
            "tax_office_region": "KANTOR WILAYAH DJP JAWA TENGAH I",
            "tax_office_name": "KPP PRATAMA SEMARANG BARAT", "tax_office_address": "JL. PEMUDA 1, SEMARANG",
            "business_tax_number": "02.468.135.7-503.000", "business_name": "PT. KAYU JATI",
            "business_fields": [
                ("16221", "INDUSTRI BARANG BANGUNAN DARI KAYU"), ("46620", "PERDAGANGAN BESAR"),
            ],
            "business_address": "JL. RAYA 9, TUGU", "tax_obligation": "PPN; PPnBM",
            "letter_confirmed_since": "2010-04-05", "letter_issued_place": "Semarang",
            "letter_issued_date": "2018-06-11",
            "signing_official_title": "a.n. Kepala Kantor Kepala Seksi Pelayanan",
            "signing_official_name": "SRI WAHYUNI", "signing_official_number": "197001011990032001",
        },
    ),
    "tax_entity_last_office_wins": (
        "tax_entity",
        "KPP PRATAMA SATU\nJL SATU\nKPP DUA\nEMAIL x@y.id\nbla",
        {"tax_office_name": "KPP DUA", "tax_office_address": "JL SATU"},
    ),
    "passport": (
        "identity_passport",
        f"PASPOR\n{MRZ1}\n{MRZ2}\n",
        {
            "document_type": "P", "document_issuing_country": "NLD", "holder_surname": "VAN DIJK",
            "holder_given_names": "ANNA MARIA", "holder_passport_number": "SPECI2014",
            "holder_nationality": "NLD", "holder_birth_date": "1965-03-10", "holder_gender": "F",
            "document_expiry_date": "2024-03-09", "document_mrz_line1": MRZ1, "document_mrz_line2": MRZ2,
        },
    ),
    "passport_none": ("identity_passport", "no zone here", {}),
    "deed": (
        "business_deed",
        "AKTA PENDIRIAN PERSEROAN TERBATAS\nNomor : 41.\xad\n-Pada hari ini, Selasa, tanggal 04-02-2020 (x).\n"
        "Berhadapan dengan saya, RINI\n----\nPUTRI, Sarjana Hukum, Notaris\n"
        "KEPUTUSAN MENTERI HUKUM DAN HAK ASASI MANUSIA REPUBLIK INDONESIA\n"
        "NOMOR AHU-0012345.AH.01.01.TAHUN 2020\nPERUBAHAN ANGGARAN DASAR\n"
        "Ditetapkan di Jakarta, Tanggal 20 Februari 2020.",
        {
            "deed_type": "Pendirian", "deed_number": "41", "deed_date": "2020-02-04",
            "notary_name": "RINI PUTRI", "decision_number": "AHU-0012345.AH.01.01.TAHUN 2020",
            "decision_issued_date": "2020-02-20",
        },
    ),
    "deed_amendment": (
        "business_deed",
        "nomor 3. " + "lain " * 20 + "\nPERUBAHAN ANGGARAN DASAR\nNomor 8.\nPada hari ini, Rabu, tanggal 05-06-2023.\n"
        "dalam akta pendirian nomor 10 tanggal 01-01-2010.",
        {"deed_type": "Perubahan", "deed_number": "8", "deed_date": "2023-06-05"},
    ),
    "deed_old_decree": (
        "business_deed",
        "KEPUTUSAN MENTERI KEHAKIMAN REPUBLIK INDONESIA\nNOMOR : C2-777.HT.01.01.TH.91.-\n",
        {"decision_number": "C2-777.HT.01.01.TH.91"},
    ),
    "deed_foreign_decree": (
        "business_deed", "SK Menteri Hukum dan Hak Asasi Manusia Republik Indonesia\nNomor : AHU-1.Tahun 2005", {},
    ),
    "stay": (
        "identity_stay",
        """
        KANIM KELAS I BANDUNG
        JALAN SURAPATI 82
        NIORA : CD98765432
        Permit Number : 2D11AB7654ZZ
        Stay/Multiple Entries Permit Expiry : 18-12-2024
        Stay Permit Index : C312
        Full Name : JOHN ROE
        Place / Date of Birth : PERTH / 04-03-1984
        Passport Number : P7654321
        Passport Expiry : 11-01-2029
        Nationality : AUSTRALIA
        Gender : MALE
        Address : JL. DAGO 10
        COBLONG
        Occupation : ENGINEER
        Status : WORKING
        Guarantor Name : -
        Bandung, 26-01-2024
        Head of Kelas I Bandung Immigration Office
        """,
        {
            "permit_issuing_office": "KANIM KELAS I BANDUNG", "permit_issuing_office_address": "JALAN SURAPATI 82",
            "permit_niora": "CD98765432", "permit_number": "2D11AB7654ZZ", "permit_expiry_date": "2024-12-18",
            "permit_index": "C312", "holder_full_name": "JOHN ROE", "holder_birth_place": "PERTH",
            "holder_birth_date": "1984-03-04", "holder_passport_number": "P7654321",
            "holder_passport_expiry_date": "2029-01-11", "holder_nationality": "AUSTRALIA",
            "holder_gender": "MALE", "holder_address": "JL. DAGO 10 COBLONG", "holder_occupation": "ENGINEER",
            "holder_status": "WORKING", "permit_issued_place": "Bandung", "permit_issued_date": "2024-01-26",
        },
    ),
    "stay_empty_first_label_decides": (
        "identity_stay", "NIORA :\nNIORA : X1\nAddress :\nAddress : JL A\nJL B\nPassport Expiry : -",
        {"holder_address": "JL B"},
    ),
    "local_value": (
        "certificate_local_value",
        """
        Jenis Produk : Panel Box
        Tipe : -
        Spesifikasi : Ukuran: 10x20 s.d.
        30x40 mm
        Kode HS : 85371011
        Merk : ELANG
        Nilai TKDN : 55,12%
        Standar Produk : SNI 1
        No. Laporan : LPA-1/X/22
        berlaku 3 tahun terhitung sejak tanggal tanda sah
        Nama Perusahaan : PT Panel Jaya
        Alamat : Jl. Industri 4
        Cikarang
        NPWP : 50.111.222.3-444.000
        Jenis Industri : Industri Listrik (KBLI: 27900)
        No. Tanda Sah : 16/SJ/2022
        Jakarta, 23 Oktober 2022
        Kepala Pusat Peningkatan
        Dewi Lestari
        # 4321
        """,
        {
            "product_name": "Panel Box", "product_specification": "Ukuran: 10x20 s.d. 30x40 mm",
            "product_hs": "85371011", "product_brand": "ELANG", "product_local_value": 55.12,
            "product_standard": "SNI 1", "report_number": "LPA-1/X/22", "certificate_valid_year": 3,
            "business_name": "PT Panel Jaya", "business_address": "Jl. Industri 4 Cikarang",
            "business_tax_number": "50.111.222.3-444.000", "business_field": "Industri Listrik (KBLI: 27900)",
            "certificate_number": "16/SJ/2022", "certificate_issued_place": "Jakarta",
            "certificate_issued_date": "2022-10-23", "signing_official_title": "Kepala Pusat Peningkatan",
            "signing_official_name": "Dewi Lestari", "certificate_qr_number": "4321",
        },
    ),
    "local_value_attached": ("certificate_local_value", "Nilai TKDN : Terlampir", {}),
    "passbook": (
        "bank_account",
        "Tabungan BRI Simpedes\nKantor BANK BRI : 3868 UNIT LABUAN\nNo. Rekening : 3868-01-000999-45-6\nNama : AGUS",
        {
            "bank_name": "Bank Rakyat Indonesia", "bank_branch": "3868 UNIT LABUAN",
            "account_number": "3868-01-000999-45-6", "account_holder": "AGUS", "account_type": "Simpedes",
        },
    ),
    "passbook_unlabelled": (
        "bank_account", "KCP DARMO\n0009998887\nJANE ROE\n16/06/2020\nBANK CENTRAL ASIA",
        {
            "bank_name": "Bank Central Asia", "bank_branch": "KCP DARMO", "account_number": "0009998887",
            "account_holder": "JANE ROE",
        },
    ),
    "statement": (
        "bank_account", "mandiri\nAccount No : 1270000009999 - PT JAYA\nBranch : KCP Cikini",
        {
            "bank_name": "Bank Mandiri", "bank_branch": "KCP Cikini", "account_number": "1270000009999",
            "account_holder": "PT JAYA",
        },
    ),
    "letter": (
        "bank_account", "Bank Danamon, Cabang Puri Indah\nthe account is 4101-9999\nAtas Nama : PT MAKMUR",
        {
            "bank_name": "Bank Danamon", "bank_branch": "Puri Indah", "account_number": "4101-9999",
            "account_holder": "PT MAKMUR",
        },
    ),
    "transcript": (
        "certificate_education",
        """
        UNIVERSITAS AIRLANGGA
        FAKULTAS KEDOKTERAN
        TRANSKRIP AKADEMIK PROGRAM PENDIDIKAN PROFESI DOKTER
        Nama (Name) : BAYU PUTRA
        No. Seri : 009876
        Nomor Induk Mahasiswa : 060100011
        Mulai Pendidikan : 1 Februari 2010
        Indeks Prestasi Kumulatif (IPK) : 3,41
        Jumlah SKS : 144
        Surabaya, 25 Februari 2012
        """,
        {
            "transcript_number": "009876", "student_name": "BAYU PUTRA", "student_number": "060100011",
            "student_institution": "UNIVERSITAS AIRLANGGA", "student_major": "FAKULTAS KEDOKTERAN",
            "enroll_level": "Profesi Dokter", "enroll_date": "2010-02-01", "transcript_credit": "144",
            "transcript_grade": 3.41, "transcript_issued_place": "Surabaya",
            "transcript_issued_date": "2012-02-25",
        },
    ),
    "transcript_english": (
        "certificate_education",
        "STATE UNIVERSITY OF MALANG\nName\n: RATNA\nStudy Program : Physics\nFaculty : Science\n"
        "Program : Strata Satu (Bachelor)\nGPA : 3.53\nTotal of Credits : 148 credits\nMalang, July 30, 2021",
        {
            "student_name": "RATNA", "student_institution": "STATE UNIVERSITY OF MALANG",
            "student_major": "Physics", "enroll_level": "S1", "transcript_grade": 3.53,
            "transcript_credit": "148", "transcript_issued_place": "Malang",
            "transcript_issued_date": "2021-07-30",
        },
    ),
    "competency": (
        "certificate_competency",
        """
        BADAN NASIONAL SERTIFIKASI PROFESI
        No. 64141 4211 2 000777 2019
        Dengan ini menyatakan bahwa,
        This is to certify that,
        DIAN SARI
        No. Reg. KK 036 00001 2018
        Telah kompeten pada bidang:
        Is competent in the area of:
        Koperasi
        Dengan Kualifikasi / Kompetensi:
        With Qualification / Competency:
        KASIR
        Jakarta, 21 Desember 2019
        Lembaga Sertifikasi Profesi Koperasi
        """,
        {
            "certificate_number": "64141 4211 2 000777 2019", "certificate_holder": "DIAN SARI",
            "training_title": "KASIR", "training_field": "Koperasi",
            "training_institution": "Lembaga Sertifikasi Profesi Koperasi",
            "certificate_issued_place": "Jakarta", "certificate_issued_date": "2019-12-21",
        },
    ),
    "competency_units": (
        "certificate_competency",
        """
        Dengan ini menyatakan bahwa,
        No. Reg. 1
        Telah memenuhi persyaratan dan kompeten pada kualifikasi:
        1. PDB.EI.01.001.01
        2. PDB.EI.01.005.01
        Pada bidang pekerjaan:
        In the area of:
        Ekspor
        """,
        {
            "training_field": "Ekspor",
            "training_units": [("PDB.EI.01.001.01", None), ("PDB.EI.01.005.01", None)],
        },
    ),
    "competency_course": (
        "certificate_competency",
        "Dicoding\nName： LIA\nCourse Title: Belajar SQL\nIssued Date: July 30, 2021\nValid Until: July 30, 2024\nGrade: A-",
        {
            "certificate_holder": "LIA", "training_title": "Belajar SQL", "training_institution": "Dicoding",
            "certificate_issued_date": "2021-07-30", "certificate_expiry_date": "2024-07-30", "training_grade": "A-",
        },
    ),
    "competency_authority": ("certificate_competency", "Authority: BNSP", {"training_institution": "BNSP"}),
}


@pytest.fixture(scope="module")
def records(spark):
    """All cases of a type in one job, so the text rules run on a real multi-row table."""
    found = {}
    for spec in registry.specs():
        rows = [(k, text) for k, (slug, text, _) in CASES.items() if slug == spec.slug]
        df = spark.createDataFrame(rows, "case string, text string")
        out = extract(df, spec, as_of=F.lit(dt.date(2026, 1, 1)))
        assert out.columns == ["case", "text", "record"]
        assert out.schema["record"].dataType.fieldNames() == spec.schema.fieldNames()
        found |= {r["case"]: r["record"] for r in out.collect()}
    return found


@pytest.mark.parametrize("case", CASES)
def test_record(records, case):
    expected = CASES[case][2]
    got = {k: v for k, v in records[case].asDict().items() if v is not None}
    got = {k: [tuple(x) for x in v] if isinstance(v, list) else v for k, v in got.items()}
    assert got == expected


def test_line_end_forms_give_the_same_record(spark):
    spec = registry.get("identity_card")
    text = CASES["card"][1]
    forms = [text, text.replace("\n", "\r\n"), text.replace("\n", "\t\r\n \n"), text.replace("\n", " ")]
    df = spark.createDataFrame(list(enumerate(forms)), "id int, text string")
    assert extract(df, spec).select("record").distinct().count() == 1
