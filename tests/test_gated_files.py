"""The source of manifest and bytes opens only what passes the gates, and plans tasks by size."""

import pytest

from docmill.operators.gates import gate_files
from docmill.plans.registry import document_types
from docmill.sources.gated import read_gated

ROW = "file_id long, path string, size_bytes long, content_type string, document_type string, status_code int"


@pytest.fixture()
def files(spark, tmp_path):
    """Twelve files; those over 1,000 bytes or with a status are folders, which cannot be opened."""
    rows = []
    for i in range(12):
        stopped = i % 4 == 3
        path, size = tmp_path / f"f{i}.pdf", 5000 if i % 4 == 3 else 100 + i
        if stopped:
            path.mkdir()
        else:
            path.write_bytes(bytes([i]) * size)
        rows.append((i, str(path), size, "application/pdf" if i % 2 else None, "identity_card" if i != 5 else "recipe", 413 if stopped else None))
    rows += [(20, None, 10, "image/png", "identity_card", None), (21, str(tmp_path / "gone"), None, "image/png", "bank_account", None)]
    spark.createDataFrame(rows, ROW).coalesce(2).write.parquet(f"{tmp_path}/manifest")
    return f"{tmp_path}/manifest", rows


def test_gated_files_stay_closed(spark, files):
    path, rows = files
    df = read_gated(spark, path)
    with pytest.raises(Exception, match="(?i)directory|regular file"):
        df.count()
    found = df.where("status_code is null").collect()
    assert {r.file_id: r.content for r in found} == {i: bytes([i]) * n if p and n else None for i, p, n, *_, s in rows if s is None and i < 20} | {20: None, 21: None}
    assert {r.file_id for r in df.where("size_bytes <= 1000 and content_type = 'application/pdf'").collect()} == {1, 5, 9}
    assert {r.file_id for r in df.where("status_code is null and document_type in ('recipe', 'bank_account')").collect()} == {5, 21}
    assert {r.file_id for r in df.where("status_code is null and content_type not in ('image/png')").collect()} == {1, 5, 9}
    assert {r.file_id for r in df.where("status_code is null and path like '%f1%' and length(content) > 0").collect()} == {1, 10}
    assert df.where("status_code is null").select("content").where("content_type is null").count() == 6


def test_gates_before_bytes(spark, files):
    """The gates run on the manifest alone; their result selects what is opened."""
    path, rows = files
    gated = gate_files(read_gated(spark, path, with_content=False).drop("content", "status_code"), document_types(spark), max_file_mb=0.002)
    passed = [r.file_id for r in gated.where("status_code is null").collect()]
    assert passed == [i for i, _, n, _, t, _ in rows if n and n < 2000 and t != "recipe"]


def test_tasks_by_size(spark, files):
    path, _ = files
    df = read_gated(spark, path, partition_mb=250 / (1 << 20)).where("status_code is null")
    parts = [[r.size_bytes or 0 for r in p] for p in df.rdd.glom().collect()]
    assert sum(map(len, parts)) == 11 and all(sum(p) <= 250 for p in parts) and len(parts) >= 4
    assert read_gated(spark, path).where("file_id < 0").count() == 0
