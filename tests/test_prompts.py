"""Prompts of documents without text or source."""

from docmill.operators.prompts import fill_prompts, render_prompts, visual_requests
from docmill.queries import book
from oracle import compare, connect

EMPTY = "Empty text provided for analysis"


def test_query_equals_its_sql_without_text_or_source(spark, tmp_path):
    texts = [None, "", " \t\r\n ", " Nama : X\n", "a\u0000b 😀 \"%s\"", "x" * 200_000]
    sources = [None, "", "%s", "src1"]
    rows = [(k + 12 * (i * 4 + j), t, s) for i, t in enumerate(texts) for j, s in enumerate(sources) for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = connect("/none")
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(book.queries()["prompt_render"](spark, str(tmp_path)), con, book.oracles()["prompt_render"]) == ""


def test_blank_texts_are_filled_in_but_not_sent(spark):
    rows = [("bank_account", " \n"), ("bank_account", None), ("bank_account", "x "), ("recipe", " "), ("recipe", "x")]
    df = spark.createDataFrame(rows, "document_type string, text string")
    ends = "(document_type, text, right(user_prompt, 15), error)"
    filled = {tuple(r[0]) for r in fill_prompts(df).selectExpr(ends).collect()}
    unknown = {("recipe", " ", None, "Unknown document type"), ("recipe", "x", None, "Unknown document type")}
    known = ("bank_account", "x ", "\n\n```text\nx\n```", None)
    assert filled == {known, ("bank_account", " \n", ".\n\n```text\n\n```", None), ("bank_account", None, None, None)} | unknown
    sent = {tuple(r[0]) for r in render_prompts(df).selectExpr(ends).collect()}
    assert sent == {known, ("bank_account", " \n", None, EMPTY), ("bank_account", None, None, EMPTY)} | unknown


def test_unknown_types_have_no_visual_prompt(spark):
    df = spark.createDataFrame([("recipe", [b"img"]), ("bank_account", [b"img"])], "document_type string, pages array<binary>")
    seen = {r.document_type: (r.user_prompt, r.error) for r in visual_requests(df, "pages").collect()}
    assert seen["recipe"] == (None, "Unknown document type")
    assert seen["bank_account"][0].startswith("The attached pages show: ") and seen["bank_account"][1] is None
