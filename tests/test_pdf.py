import zlib

from docscore.sources import pdf


def build(*objects, packed=()):
    out = b"%PDF-1.5\n"
    for number, body in objects:
        out += b"%d 0 obj\n%b\nendobj\n" % (number, body)
    if packed:
        head, rest = b"", b""
        for number, body in packed:
            head += b"%d %d " % (number, len(rest))
            rest += body + b" "
        data = zlib.compress(head + rest)
        out += b"90 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%b\nendstream\nendobj\n" % (len(packed), len(head), len(data), data)
    return out + b"%%EOF"


def stream(body, deflate=False, extra=b""):
    body = zlib.compress(body) if deflate else body
    return b"<< /Length %d %b%b >>\nstream\r\n%b\nendstream" % (len(body), b"/Filter /FlateDecode " if deflate else b"", extra, body)


FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"


def test_round_trip():
    lines = ["plain", "with (brackets) and \\ signs", "café 5 €", "שלום", ""] + [f"line {k}" for k in range(130)]
    got = pdf.text_layer(pdf.text_pdf(lines)).split("\n")
    assert got == ["plain", "with (brackets) and \\ signs", "café 5 €", "????"] + [f"line {k}" for k in range(130)]
    assert pdf.text_layer(pdf.text_pdf([])) == ""


def test_operators_and_strings():
    body = rb"BT /F1 10 Tf 10 700 Td (a\(b\)\\ \101\n) Tj 0 -12 Td [(sp) -300 (lit) 20 (ted)] TJ 30 0 Td <48 69> Tj (next) ' 1 0 0 1 10 500 Tm (moved) Tj 1 0 0 1 90 500 Tm (right) Tj T* (x (nested) y) Tj ET % comment"
    made = build((1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [4 0 R] /Count 1 /Resources << /Font << /F1 3 0 R >> >> >>"), (3, FONT), (4, b"<< /Type /Page /Contents [5 0 R 6 0 R] >>"), (5, stream(body, True)), (6, stream(b"BT (tail) Tj ET")))
    assert pdf.text_layer(made).split("\n") == ["a(b)\\ A", "sp litted Hi", "next", "moved right", "x (nested) ytail"]


def test_unicode_maps_and_packed_objects():
    cmap = b"1 beginbfchar <0003> <05E9> endbfchar 2 beginbfrange <0010> <0012> <05D0> <0020> <0021> [<0041> <00420043>] endbfrange"
    made = build(
        (5, stream(b"BT /F1 9 Tf <0003001000120021> Tj ET", True)), (6, stream(cmap)),
        packed=[(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [4 0 R] >>"), (3, b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>"), (4, b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F1 3 0 R >> >> >>")],
    )
    assert pdf.text_layer(made) == "שאבBC".replace("ב", "ג")[0:3] + "BC"


def test_what_cannot_be_read():
    assert pdf.text_layer(b"") is None and pdf.text_layer(b"no pdf") is None
    assert pdf.text_layer(b"%PDF-1.4\ntrailer << /Encrypt 5 0 R >>") is None
    assert pdf.text_layer(b"%PDF-1.4\n1 0 obj << /Type /Catalog") == ""
    data = pdf.text_pdf(["some text"] * 70)
    for k in range(0, len(data), 37):  # broken files never raise
        pdf.text_layer(data[:k])
        pdf.text_layer(data[:k] + b"\xff(" + data[k:])


def test_reader(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.PDF").write_bytes(pdf.text_pdf(["one", "two"]))
    (tmp_path / "b.pdf").write_bytes(b"junk")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in pdf.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.PDF": "one\ntwo", "b.pdf": None}


def test_ranking_keeps_wide_cells_apart(spark, tmp_path):
    from docscore.sources import writers

    cells = ["total_correct", "total_scorable", "present_correct", "present_scorable", "absent_correct", "absent_scorable"]
    counts = [57_600_000, 70_200_000, 57_600_001, 70_200_001, 1, 2]
    ranked = spark.createDataFrame([(1, "1", "e" * 30, "RANKED", *counts), (None, "—", "blocked", "BLOCKED", *[None] * 6)], "rank int, shown_rank string, engine_id string, status string, " + ", ".join(f"{c} long" for c in cells))
    writers.write_ranking_pdf(spark, ranked, f"file://{tmp_path}/ranking.pdf")
    lines = pdf.text_layer((tmp_path / "ranking.pdf").read_bytes()).split("\n")
    assert lines[2].split() == ["1", "e" * 30, "57600000/70200000", "57600001/70200001", "1/2"]
    assert lines[3].split()[1:] == ["blocked", "BLOCKED", "BLOCKED", "BLOCKED"]
