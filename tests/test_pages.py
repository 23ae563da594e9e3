"""Page texts: files written here come back by page, and broken ones have no text."""

from __future__ import annotations

import random
import zlib

import pyarrow as pa
import pytest

from docev.functions import pages
from docev.plans.mechanisms import as_pdf
from docev.sources import readers

MAP = b"""/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0001> <5E9F> <0002> <6C340021> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0078> <0079>] endbfrange end"""


def test_pages_come_back():
    sheets = [["One (1) line", "", "zwölf 日本 \U0001f600"], ["second"], [""]]
    assert pages.texts(as_pdf(sheets)) == ["\n".join(s) for s in sheets] and pages.texts(as_pdf(sheets), 1) == ["\n".join(sheets[0])]


def test_plain_streams_operators_and_maps():
    content = rb"BT /F1 9 Tf 1 0 0 1 10 700 Tm (A\(b\)\101\
c) Tj 1 0 0 1 90 700 Tm [(d) -90 (e) -400 (f)] TJ 0 -12 Td (\374) ' ET BT /F2 9 Tf 1 0 0 1 10 600 Tm <000100020010001100200021> Tj ET"
    raw = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R 2 0 R] >> endobj\n"
    raw += b"3 0 obj << /Type /Page /Contents [6 0 R] /Resources << /Font << /F1 4 0 R /F2 5 0 R >> >> >> endobj 4 0 obj << /Subtype /Type1 >> endobj\n"
    raw += b"5 0 obj << /Subtype /Type0 /ToUnicode 7 0 R >> endobj 6 0 obj << /Length 8 0 R >>\nstream\n" + content + b"\nendstream endobj 8 0 obj %d endobj\n" % len(content)
    raw += b"7 0 obj << /Length %d >>\nstream\n" % len(MAP) + MAP + b"\nendstream endobj\ntrailer << /Root 1 0 R >>"
    assert pages.texts(raw) == ["A(b)Acde f\nü\n废水!ABxy"]


def test_packed_objects():
    inside = [b"<< /Type /Catalog /Pages 11 0 R >>", b"<< /Type /Pages /Kids [12 0 R] >>", b"<< /Type /Page /Contents 13 0 R >>"]
    offsets, at = [], 0
    for part in inside:
        offsets.append(at)
        at += len(part) + 1
    head = b" ".join(b"%d %d" % (10 + k, o) for k, o in enumerate(offsets)) + b" "
    packed = zlib.compress(head + b"\n".join(inside))
    raw = b"%PDF-1.5\n1 0 obj << /Type /ObjStm /N 3 /First " + b"%d" % len(head) + b" /Filter [/FlateDecode] /Length %d >>\nstream\n" % len(packed) + packed + b"\nendstream\nendobj\n"
    raw += b"13 0 obj << /Length 20 >>\nstream\nBT (packed text) Tj ET\nendstream\nendobj\n14 0 obj << /Type /XRef /Root 10 0 R >> endobj"
    assert pages.texts(raw) == ["packed text"]


@pytest.mark.parametrize("seed", range(20))
def test_broken_files_have_some_or_no_text(seed):
    draw = random.Random(seed)
    raw = bytearray(as_pdf([["a line of text"] * 5] * 3))
    for _ in range(30):
        raw[draw.randrange(len(raw))] = draw.randrange(256)
    raw = raw[: draw.randrange(len(raw))]
    assert all(isinstance(t, str) for t in pages.texts(bytes(raw)))
    assert pages.texts(None) == pages.texts(b"") == pages.texts(b"%PDF-1.4 ((((<<<<[[[") == []


def test_files_are_read_by_page(spark, tmp_path):
    sheets = [[f"page {k} " + "x" * 40] for k in range(8)]
    (tmp_path / "long.pdf").write_bytes(as_pdf(sheets))
    (tmp_path / "short.pdf").write_bytes(as_pdf([["little"]]))
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4 nothing")
    found = readers.files(spark, [f"file://{tmp_path}"])
    name = lambda r: r.path.rsplit("/", 1)[1]
    rows = {name(r): (r.body, r.parse_status) for r in readers.bodies(found).collect()}
    assert rows == {"long.pdf": ("\n".join(s[0] for s in sheets[: readers.SCAN_PAGES]), "ok"), "short.pdf": ("little", "ok"), "bad.pdf": ("", "pdf_text_empty")}
    assert readers.bodies(found, readers.RECORD_PAGES).where("path like '%long%'").first().body.count("\n") == 5
    whole = {name(r): r.body for r in readers.whole_pdfs(found).collect()}
    assert whole == {"long.pdf": "\n".join(s[0] for s in sheets), "short.pdf": None, "bad.pdf": None}


def test_a_batch_of_files_is_read_in_parts():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([b"x" * n if n is not None else None for n in (5, 5, 5, 30, None, 2)])], ["k", "content"])
    assert [p.column("k").to_pylist() for p in pages.parts(batch, "content", 10)] == [[0, 1], [2], [3], [4, 5]]
    assert [p.num_rows for p in pages.parts(batch.slice(0, 0), "content", 10)] == []


def test_batches_of_files_are_bounded(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    held = pages.page_texts(spark.createDataFrame([(1, bytearray(as_pdf([["a"], ["b"]])))], "id long, content binary"))
    assert held.first().pages == ["a", "b"] and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(pages.BATCH_BYTES)
