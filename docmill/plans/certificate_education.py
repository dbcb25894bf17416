"""Academic transcript (EX10, NRM11)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.cleaning import number, small_number_text, wide, wide_date
from docmill.functions.labels import find_or_next
from docmill.functions.text import first_hit, line_last, line_rx, rx, strip
from docmill.plans.base import SIGNATURE, DocSpec, Fields, strings, TextView

# Field names, in record order.
COURSE = T.StructType(
    strings("course_code", "course_name")
    + [T.StructField("course_credits", T.DoubleType()), T.StructField("course_grade", T.DoubleType())]
    + strings("course_semester")
)
SCHEMA = T.StructType(
    strings(
        "transcript_number", "student_name", "student_number", "student_major",
        "student_institution", "enroll_level", "enroll_date", "transcript_credit",
    )
    + [T.StructField("transcript_grade", T.DoubleType())]
    + strings("transcript_issued_place", "transcript_issued_date")
    + [T.StructField("enroll_courses", T.ArrayType(COURSE))]
)

# Printed labels.
LABELS = {
    "student_name": r"(?:Nama(?:\s+(?:Mahasiswa|Lengkap|Karyawan))?|Student\s+Name|Name)",
    "institution": r"(?:Lembaga\s+Pendidikan|Education\s+Institution|Institution)",
    "faculty": r"(?:Fakultas|Faculty)",
    "program": r"(?:Jurusan\s*/\s*Program\s+Studi|Program\s+Studi|Jurusan|Study\s+Program)",
    "combined": r"(?:Jurusan\s*/\s*Fakultas|Major\s*/\s*Faculty)",
    "level": r"(?:Jenjang\s+(?:Pendidikan|Program)|Program\s+Pendidikan|Education\s+Level|Program)",
    "student_number": r"(?:NIM|NPM|Nomor\s+Induk\s+Mahasiswa|Student\s+Registration\s+Number|ID)",
    "transcript_number": r"(?:No\.?\s*Seri|Nomor\s+Seri|No\.?\s*Transkrip|Transcript\s+Number|Number)",
    "enroll_date": r"(?:Mulai\s+Pendidikan|Tanggal\s+Masuk|Date\s+of\s+Enrollment|Starting\s+Date)",
    "transcript_grade": r"(?:Indeks?\s+Prestasi(?:\s+Kumulatif)?(?:\s*\(IPK\))?|IPK|GPA|Grade\s+Point\s+Average)",
    "transcript_credit": r"(?:Jumlah\s+SKS(?:\s+Kumulatif)?|Total\s+(?:of\s+)?Credits?)",
}
# Heading words and level names.
INSTITUTION_LINE = (
    r"^(?:Universitas|University|State\s+University|Institut|Institute|Politeknik|Polytechnic"
    r"|Sekolah\s+Tinggi|Akademi)\b.*$"
)
LEVEL_WORD = r"Program|Jenjang|Diploma|Sarjana|Magister|Doktor|Profesi"
HEAD_LEVEL = (
    r"\b(?:Program\s+)?(?:Diploma\s*(?:III|IV|3|4)|D[34]|S[123]|Sarjana|Magister|Doktor|Profesi\s+Dokter)\b"
)
PROGRAM_LEVEL = r"\b(?:Diploma\s*(?:III|IV|3|4)|D[34]|S[123]|Sarjana|Magister|Profesi\s+Dokter)\b"
LEVELS = [
    (r"\bPROFESI\s+DOKTER\b", "Profesi Dokter"),
    (r"\b(?:DIPLOMA\s*(?:III|3)|D\s*3)\b", "D3"),
    (r"\b(?:DIPLOMA\s*(?:IV|4)|D\s*4)\b", "D4"),
    (r"\b(?:MAGISTER|MASTER|S\s*2)\b", "S2"),
    (r"\b(?:DOKTOR|DOCTORAL|S\s*3)\b", "S3"),
    (r"\b(?:SARJANA|BACHELOR|S\s*1)\b", "S1"),
]
HEAD_LINES, LEVEL_LINES, TAIL_LINES = 16, 20, 18


def parse(t: TextView) -> list[Fields]:
    head = t.head(HEAD_LINES)
    return [
        {name: find_or_next(t.body, label) for name, label in LABELS.items()}
        | {
            "head_institution": line_rx(head, INSTITUTION_LINE, 0),
            "head_faculty": line_rx(head, r"^(?:Fakultas|Faculty)\s+\S.*$", 0),
            "head_level": line_rx(t.head(LEVEL_LINES), rf"^(?=.*(?:{LEVEL_WORD})).*?({HEAD_LEVEL})"),
            "transcript_issued_place": strip(line_last(t.tail(TAIL_LINES), SIGNATURE, 1, "")),
            "transcript_issued_date": line_last(t.tail(TAIL_LINES), SIGNATURE, 2, ""),
        },
        {
            "student_institution": F.coalesce(t["institution"], t["head_institution"]),
            "student_major": F.coalesce(t["combined"], t["program"], t["faculty"], t["head_faculty"]),
            "enroll_level": F.coalesce(t["level"], t["head_level"], rx(t["program"], PROGRAM_LEVEL, 0)),
        },
    ]


def _course(item):
    return F.struct(
        item["course_code"].alias("course_code"),
        item["course_name"].alias("course_name"),
        number(item["course_credits"].cast("string"), r"SKS|CREDITS?").alias("course_credits"),
        number(item["course_grade"].cast("string"), "NILAI|GRADE|ANGKA|BOBOT").alias("course_grade"),
        item["course_semester"].alias("course_semester"),
    )


def normalize(raw: Fields) -> Fields:
    level = wide(
        raw["enroll_level"], r"JENJANG\s+(?:PENDIDIKAN|PROGRAM)|PROGRAM\s+PENDIDIKAN|EDUCATION\s+LEVEL"
    )
    return {
        "transcript_number": wide(
            raw["transcript_number"], r"NO\.?\s*SERI|NOMOR\s+SERI|NO\.?\s*TRANSKRIP|TRANSCRIPT\s+NUMBER"
        ),
        "student_name": wide(
            raw["student_name"],
            r"(?:NAMA(?:\s+(?:MAHASISWA|LENGKAP|KARYAWAN))?|STUDENT\s+NAME|NAME)\s*(?:\(NAME\))?",
        ),
        "student_number": wide(
            raw["student_number"], r"NIM|NPM|NOMOR\s+INDUK\s+MAHASISWA|STUDENT\s+REGISTRATION\s+NUMBER"
        ),
        "student_major": wide(
            raw["student_major"],
            r"JURUSAN\s*/\s*FAKULTAS|JURUSAN\s*/\s*PROGRAM\s+STUDI|JURUSAN|PROGRAM\s+STUDI|MAJOR\s*/\s*FACULTY",
        ),
        "student_institution": wide(
            raw["student_institution"], r"LEMBAGA\s+PENDIDIKAN|EDUCATION\s+INSTITUTION|INSTITUTION"
        ),
        "enroll_level": F.coalesce(first_hit(F.upper(level), LEVELS, ""), level),
        "enroll_date": wide_date(raw["enroll_date"], LABELS["enroll_date"]),
        "transcript_credit": small_number_text(wide(raw["transcript_credit"], LABELS["transcript_credit"])),
        "transcript_grade": number(
            raw["transcript_grade"], LABELS["transcript_grade"], sep=r"\s*[:：.=]?\s*"
        ),
        "transcript_issued_place": wide(raw["transcript_issued_place"], r"TEMPAT\s+TERBIT|ISSUED\s+PLACE"),
        "transcript_issued_date": wide_date(raw["transcript_issued_date"], r"TANGGAL\s+TERBIT|ISSUED\s+DATE"),
        "enroll_courses": F.transform(raw["enroll_courses"], _course),
    }


SPEC = DocSpec(
    slug="certificate_education",
    name="Ijazah / Academic Transcript",
    description="Graduation details on diplomas and academic transcripts of Indonesia",
    schema=SCHEMA,
    parse=parse,
    normalize=normalize,
    prompt_subject="a diploma or a transcript",
    field_rules={
        "transcript_number": "number of the transcript",
        "student_name": "name of the graduate",
        "student_number": "registration number, leading zeros kept",
        "student_major": "study program or major, else faculty",
        "student_institution": "issuing institution",
        "enroll_level": "level such as D3, S1 or Profesi Dokter",
        "enroll_date": "start date as YYYY-MM-DD",
        "transcript_credit": "total credits",
        "transcript_grade": "overall grade as a number",
        "transcript_issued_place": "place in the signature line",
        "transcript_issued_date": "date in the signature line as YYYY-MM-DD",
        "enroll_courses": "course rows with code, name, credits, grade and semester",
    },
)
