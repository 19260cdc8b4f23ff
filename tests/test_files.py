"""The file index on files made from the tables: three kinds, a damaged one, an empty one, copies."""

import hashlib
import tempfile
from pathlib import Path

import duckdb
from payguard.sources.documents import index_files, index_summary

PDF, PNG, JPEG, TIFF = b"%PDF-1.7\n", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"MM\x00*"


def test_kinds_errors_and_copies(spark, sf):
    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "data set"
    texts = [t.encode() for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet' WHERE length(text) > 10 ORDER BY doc_id LIMIT 4").fetchall()]
    html = duckdb.sql(f"SELECT html FROM '{sf}/pages.parquet' ORDER BY page_id LIMIT 1").fetchall()[0][0].encode()
    files = {
        "a/one.pdf": PDF + b"<< /Font 1 >> " + texts[0], "a/two.pdf": PDF + texts[1], "b/c/three.png": PNG + texts[2], "b/copy.pdf": PDF + b"<< /Font 1 >> " + texts[0], "b/a copy.pdf": PDF + b"<< /Font 1 >> " + texts[0],
        "b/named.pdf": JPEG + texts[3], "four.tif": TIFF, "b/page.pdf": html, "b/empty.pdf": b"", "b/cut.pdf": b"%PD",
    }
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    got = {r.file: r for r in index_files(spark, str(root)).collect()}
    assert set(got) == set(files) - {"b/empty.pdf"}
    assert {f: (r.kind, r.media_type) for f, r in got.items() if r.error is None} == {
        "a/one.pdf": ("born_digital", "application/pdf"), "a/two.pdf": ("scan", "application/pdf"), "b/c/three.png": ("scan", "image/png"), "b/copy.pdf": ("born_digital", "application/pdf"),
        "b/a copy.pdf": ("born_digital", "application/pdf"), "b/named.pdf": ("scan", "image/jpeg"), "four.tif": ("scan", "image/tiff"),
    }
    assert {f: r.error for f, r in got.items() if r.error} == {"b/page.pdf": "unrecognised header: " + html[:8].hex().upper(), "b/cut.pdf": "unrecognised header: 255044"}
    assert {f: r.duplicate_of for f, r in got.items() if r.duplicate_of} == {"b/copy.pdf": "a/one.pdf", "b/a copy.pdf": "a/one.pdf"}
    assert all(r.sha256 == hashlib.sha256(files[f]).hexdigest() and r.n_bytes == len(files[f]) for f, r in got.items() if r.error is None)
    assert got["four.tif"].source == "(root)" and got["b/c/three.png"].source == "b/c" and got["b/cut.pdf"].n_bytes is None
    summary = {(r.what, r["item"]): r.n for r in index_summary(index_files(spark, str(root))).collect()}
    assert summary == {("source", "a"): 2, ("source", "b"): 5, ("source", "b/c"): 1, ("source", "(root)"): 1, ("kind", "born_digital"): 3, ("kind", "scan"): 4, ("unreadable", ""): 2, ("extra_copies", ""): 2, ("duplicated", ""): 1}
