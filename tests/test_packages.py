"""Word packages made here: what they hold comes back, and whatever is wrong with one is a row with its reason."""

import io
import random
import struct
import zipfile

from textaudit.sources import packages as P

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
TYPES = f'<Types><Override PartName="/word/document.xml" ContentType="{P._TYPE.decode()}"/></Types>'
LINKS = '<Relationships><Relationship Type="x/officeDocument" Target="word/document.xml"/></Relationships>'
SMALL = P.Limits(file=600_000, total=300_000, part=150_000, xml=120_000, metadata=5000, parts=12, ratio=100.0, ratio_from=50_000)


def document(*paragraphs):
    return f'<?xml version="1.0"?><w:document xmlns:w="{W}"><w:body>{"".join(paragraphs)}</w:body></w:document>'


def paragraph(text, style=None, level=None):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{level}"/></w:numPr>' if level is not None else "")
    return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


def package(main=None, method=zipfile.ZIP_DEFLATED, leave=(), **parts):
    out, files = io.BytesIO(), {P.TYPES: TYPES, P.LINKS: LINKS, P.MAIN: main if main is not None else document(paragraph("one"))}
    with zipfile.ZipFile(out, "w", method) as z:
        for name, body in (files | {k.replace("__", "/"): v for k, v in parts.items()}).items():
            if name not in leave:
                z.writestr(name, body)
    return out.getvalue()


def raw(change):
    """A package whose archive `change` writes to as it likes."""
    out = io.BytesIO(package())
    with zipfile.ZipFile(out, "a", zipfile.ZIP_DEFLATED) as z:
        change(z)
    return out.getvalue()


def link(z):
    info = zipfile.ZipInfo("word/link")
    info.external_attr = 0o120777 << 16
    z.writestr(info, "target")


def encrypted():
    data = bytearray(package())
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        k = -1
        while (k := data.find(mark, k + 1)) >= 0:
            struct.pack_into("<H", data, k + at, 1)
    return bytes(data)


def larger_than_said():
    data, body = bytearray(package(method=zipfile.ZIP_STORED)), len(document(paragraph("one")))
    at = data.rfind(b"PK\x01\x02")
    assert struct.unpack_from("<I", data, at + 24)[0] == body
    struct.pack_into("<I", data, at + 24, body - 7)
    return bytes(data)


BAD = {
    "no_package": [b"", b"plain text", b"PK", None], "damaged": [package()[:-30], b"PK\x03\x04" + b"\0" * 60, larger_than_said()], "too_many_parts": [package(**{f"x{k}": "y" for k in range(10)})],
    "unsafe_part_name": [raw(lambda z, n=n: z.writestr(n, "x")) for n in ("../up", "/root", "a//b", "a/./b", "C:/x", "x" * 1025, ".")], "duplicate_part": [raw(lambda z: z.writestr(P.MAIN, document()))],
    "encrypted": [encrypted()], "link": [raw(link)], "compression_method": [package(method=zipfile.ZIP_BZIP2)], "part_too_large": [package(media="x" * 40_000 + "".join(chr(97 + random.Random(k).randrange(26)) for k in range(120_000))), package(**{P.TYPES: TYPES + " " * 5000})],
    "ratio": [package(media="x" * 90_000)], "too_large": [package(method=zipfile.ZIP_STORED, a="x" * 110_000, b="x" * 110_000, c="x" * 110_000)],
    "declaration": [package('<!DOCTYPE x [<!ENTITY a "b">]>' + document()), package(document(paragraph("x" * 30_000), "<!-- <!eNtItY -->")), package(word__styles="x.", **{"word__s.xml": "<!doctype x>"})],
    "missing_part": [package(leave=(P.MAIN,)), package(leave=(P.LINKS,))], "content_type": [package(**{P.TYPES: "<Types/>"})], "relationship": [package(**{P.LINKS: "<Relationships/>"})],
    "not_word": [package("<html/>"), package("")], "bad_xml": [package(document("<w:p>")), package(document(paragraph("&unknown;")))],
}


def test_every_fault_is_a_row_with_its_reason(spark, tmp_path):
    rows = [(f"{reason}/{k}.docx", len(x or b""), x) for reason, xs in BAD.items() for k, x in enumerate(xs)] + [("fine.docx", 1, package()), ("over.docx", 600_001, package())]
    df = spark.createDataFrame(rows, "path string, length long, content binary").repartition(5)
    got = {r.path: r for r in P.scan_packages(df, SMALL).collect()}
    assert len(got) == len(rows)
    for path, r in got.items():
        want = path.split("/")[0] if "/" in path else {"fine.docx": None, "over.docx": "file_too_large"}[path]
        assert (r.reason, r.ok) == (want, want is None), (path, r.reason)
    assert got["fine.docx"].text == "one" and got["fine.docx"].parts == 3
    assert P.scan_packages(df.where("false"), SMALL).count() == 0
    # nothing that a byte does makes a task fail
    rng, whole = random.Random(4), package(document(*(paragraph(f"text {k}") for k in range(40))))
    torn = []
    for k in range(200):
        data = bytearray(whole)
        for _ in range(rng.randrange(1, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        torn.append((str(k), len(data), bytes(data[: rng.randrange(1, len(data))] if k % 4 == 0 else data)))
    assert P.scan_packages(spark.createDataFrame(torn, df.schema), SMALL).select("path").distinct().count() == 200


def test_units_come_back_in_order(spark, tmp_path):
    table = f"<w:tbl><w:tr><w:tc>{paragraph('in a cell')}</w:tc></w:tr></w:tbl>"
    mixed = '<w:p><w:r><w:t>a</w:t><w:tab/><w:t xml:space="preserve"> b</w:t><w:br/></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:instrText>PAGE</w:instrText><w:t>c</w:t></w:r></w:p>'
    boxed = f"<w:p><w:r><w:t>around </w:t></w:r><w:r><w:drawing><w:txbxContent>{paragraph('inside', 'Box')}</w:txbxContent></w:drawing></w:r><w:r><w:t>it</w:t></w:r></w:p>"
    main = document(paragraph("Title &amp; more", "Heading1"), "<w:p/>", table, mixed, paragraph("item", level=2), boxed, paragraph("中文段落"))
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.docx").write_bytes(package(main)), (tmp_path / "in" / "none.docx").write_bytes(package(document())), (tmp_path / "in" / "b.txt").write_text("x"), (tmp_path / "in" / "c.docx").write_bytes(b"x")
    units = P.read_packages(spark, str(tmp_path / "in"))
    got = {}
    for r in units.orderBy("path", "unit").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.unit, r.style, r.level, r.in_table, r.text))
    assert got == {
        "a.docx": [(0, "Heading1", -1, False, "Title & more"), (1, None, -1, False, ""), (2, None, -1, True, "in a cell"), (3, None, -1, False, "a\t b\nc"), (4, None, 2, False, "item"), (5, None, -1, False, "around it"), (6, "Box", -1, False, "inside"), (7, None, -1, False, "中文段落")],
        "none.docx": [(None,) * 5], "c.docx": [(None,) * 5],
    }
    text = {r.path.rsplit("/", 1)[1]: r.text for r in P.plain_lines(units).collect()}
    assert text == {"a.docx": "Title & more\n\nin a cell\n\na\t b\nc\n\nitem\n\naround it\n\ninside\n\n中文段落", "none.docx": ""}
