"""Text of PDF files that are put together here."""

import zlib

from tidemark.sources import pdf


def made(*streams):
    out = b"%PDF-1.4\n"
    for k, (body, deflated) in enumerate(streams):
        data = zlib.compress(body) if deflated else body
        head = b"/Length %d" % len(data) + (b" /Filter /FlateDecode" if deflated else b"")
        out += b"%d 0 obj\n<< %s >>\nstream\n%s\nendstream\nendobj\n" % (k + 1, head, data)
    return out + b"trailer\n<< /Root 1 0 R >>\n%%EOF"


def test_streams_strings_and_arrays():
    page = rb"BT /F1 12 Tf 72 720 Td (Hello \(PDF\)) Tj 0 -14 Td [(W) 80 (orld) -300 (a\351\n)] TJ T* <414243> Tj (x) ' ET"
    for deflated in (True, False):
        assert pdf.pdf_text(made((page, deflated), (b"q 1 0 0 1 0 0 cm Q", False))) == "Hello (PDF)\nWorld aé\nABC\nx"
    assert pdf.pdf_text(b"no pdf") is None and pdf.pdf_text(made()) is None
    assert pdf.pdf_text(made((b"broken", True))[:60]) is None


def test_parsers_are_tried_in_order(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.pdf").write_bytes(made((b"BT (local) Tj ET", True)))
    (tmp_path / "y.pdf").write_bytes(b"%PDF-1.4 empty")
    (tmp_path / "z.txt").write_bytes(b"%PDF-")

    def hosted(data):
        if b"empty" in data:
            return None
        raise ConnectionError

    rows = {r["file_path"].rsplit("/", 1)[1]: (r["text"], r["parser"]) for r in pdf.read_pdfs(spark, str(tmp_path), (hosted, pdf.pdf_text)).collect()}
    assert rows == {"x.pdf": ("local", 1), "y.pdf": (None, None)}
    assert {r["text"] for r in pdf.read_pdfs(spark, str(tmp_path), (lambda d: "hosted", pdf.pdf_text)).collect()} == {"hosted"}
