"""Chunking, charsets and readers against plain Python and hand-made files."""

import io
import random
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmere.functions.charset import decode, newlines
from quillmere.functions.chunking import chunks
from quillmere.functions.text import extension, hard_split, paragraphs, trim
from quillmere.sources import formats
from quillmere.sources.formats import column_number, extract, html_text


def windows(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        out.append(text[start : start + size])
        if start + size >= len(text):
            break
        start += size - overlap
    return out


def reference_chunks(blocks, size, overlap):
    """A plain fold over (text, heading), written apart from the expression."""
    out, current, heading = [], "", None
    for text, own in blocks:
        if not current and len(text) > size:
            heading = own or heading
            out += [(w, heading) for w in windows(text, size, overlap)]
        elif current and len(current) + 1 + len(text) > size:
            out.append((current.strip(), heading))
            current, heading = current.strip()[-overlap:] + "\n" + text if overlap else text, own
        else:
            current = f"{current}\n{text}" if current else text
            heading = heading or own
    return out + ([(current.strip(), heading)] if current.strip() else [])


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expression.alias("x")).first().x


def test_sixty_short_paragraphs(spark):
    text = "\n\n".join(["first short one " * 3, "second paragraph " * 3, "the third of them " * 3] * 20)
    found = one(spark, chunks(F.col("t"), 200, 30), t=text)
    assert all(a.text[-30:].strip() in b.text for a, b in zip(found, found[1:]))
    assert all(len(c.text) <= 200 for c in found)


def test_windows_of_one_line(spark):
    line = "abcdefghij" * 43
    found = one(spark, chunks(F.col("t"), 90, 15), t=line)
    assert [c.text for c in found] == windows(line, 90, 15)


def test_time_grows_with_the_number_of_paragraphs(spark):
    import time

    def seconds(n):
        text = "\n\n".join(f"## part {k}\n" + "some words " * 5 for k in range(n))
        df = spark.createDataFrame([(text,)], "t string")
        began = time.perf_counter()
        assert df.select(F.size(chunks(F.col("t"), 500, 50)), F.size(paragraphs(F.col("t")))).first()[1] == n
        return time.perf_counter() - began

    seconds(100)
    assert seconds(64_000) < 2 * 32 * max(seconds(2_000), 0.1)


def test_chunks_equal_a_plain_fold(spark):
    rng = random.Random(5)
    for _ in range(25):
        blocks, last, parts = [], None, []
        for _ in range(rng.randrange(1, 12)):
            body = " ".join("".join(rng.choice("abcdé日") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 30)))
            if rng.random() < 0.3:
                last = f"head {rng.randrange(9)}"
                parts.append(f"## {last}\n{body}")
                blocks.append((f"## {last} {body}", last))
            else:
                parts.append(body)
                blocks.append((body, last))
        found = one(spark, chunks(F.col("t"), 90, 15), t="\n\n\n".join(parts))
        assert [(c.text, c.heading) for c in found] == reference_chunks(blocks, 90, 15)


@pytest.mark.parametrize("text", ["", "  \n\n ", None])
def test_blank_text_has_no_chunks(spark, text):
    assert not one(spark, chunks(F.col("t"), 100, 20), t=text)
    assert not one(spark, chunks(F.col("t"), 0, 0), t="abc")


def test_hard_split_shares_overlaps(spark):
    text = "".join(chr(97 + k % 26) for k in range(1234))
    found = one(spark, hard_split(F.col("t"), 100, 30), t=text)
    assert found == windows(text, 100, 30)
    assert found[0] + "".join(w[30:] for w in found[1:]) == text


def test_names_and_trim(spark):
    assert one(spark, extension(F.col("t")), t="a.b.TXT") == "txt"
    assert one(spark, extension(F.col("t")), t="a.") == ""
    assert one(spark, trim(F.col("t")), t="　﻿  x y   ") == "x y"


@pytest.mark.parametrize(
    ("data", "text", "encoding", "bom"),
    [
        ("河水很清\r\n山也很高\r\n".encode("gb18030"), "河水很清\n山也很高\n", "gb18030", False),
        ("é日本".encode(), "é日本", "utf-8", False),
        (b"\xef\xbb\xbfab", "ab", "utf-8", True),
        (b"\xff\xfea\x00", "a", "utf-16le", True),
        (b"\xff\xfe\x00\x00a\x00\x00\x00", "a", "utf-32", True),
        (b"caf\xe9 \x81", "café \x81", "windows-1252", False),
        (b"", "", "utf-8", False),
    ],
)
def test_charsets(data, text, encoding, bom):
    found = decode(data)
    assert (newlines(found.text), found.encoding, found.had_bom) == (text, encoding, bom)


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), data)
    return out.getvalue()


def test_docx_keeps_breaks_and_tabs():
    body = "<w:d xmlns:w='w'><w:p><w:r><w:t>one</w:t><w:tab/><w:t> two </w:t></w:r></w:p><w:p/><w:p><w:r><w:br/><w:t>three</w:t></w:r></w:p></w:d>"
    assert extract("a.docx", archive(word__document_xml=body)).text == "one\t two\n\nthree"


def test_pptx_slides_in_numeric_order():
    slide = "<s xmlns:a='a'><a:p><a:t>{}</a:t></a:p></s>"
    data = archive(**{f"ppt__slides__slide{n}_xml": slide.format(n) for n in (10, 2)})
    assert extract("a.pptx", data).text == "--- Slide 2 ---\n2\n--- Slide 10 ---\n10"


def test_xlsx_grid():
    sheet = "<w><row r='1'><c r='A1' t='s'><v>0</v></c><c r='C1' t='b'><v>1</v></c></row><row r='3'><c r='B3'><v>7</v></c><c r='a3'><v>9</v></c></row></w>"
    data = archive(xl__sharedStrings_xml="<s><si><t>name</t></si></s>", xl__worksheets__sheet1_xml=sheet)
    assert extract("a.xlsx", data).text == "--- Sheet xl/worksheets/sheet1.xml ---\nname\t\tTRUE\n\t7"
    assert [column_number(x) for x in ("A1", "Z9", "AA1", "a1", "")] == [0, 25, 26, -1, -1]


def test_legacy_office_and_broken_files():
    assert extract("a.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + "hello there".encode("utf-16-le")).text == "hello there"
    ole = bytes.fromhex("D0CF11E0A1B11AE1")
    assert extract("noext", ole + b"\x01plain words\x00\x01more here").text.endswith("plain words more here")
    found = extract("a.doc", ole + "hello there".encode("utf-16-le"))
    assert (found.kind, found.subtype, found.encoding, found.degraded, found.error) == ("office", "doc", "latin1", True, None)
    body = "<w:d xmlns:w='w'><w:p><w:r><w:t>a newer\r\nfile</w:t></w:r></w:p></w:d>"
    found = extract("a.doc", archive(word__document_xml=body))
    assert (found.text, found.subtype, found.degraded, found.error) == ("a newer\nfile", "doc", True, None)
    for other in (b"{\\rtf1 text}", b"plain words"):
        found = extract("a.doc", other)
        assert (found.text, found.kind, found.degraded) == ("", "office", True) and found.error
    assert extract("a.docx", b"PK\x03\x04broken").error
    found = extract("a.pdf", b"%PDF-1.4")
    assert (found.text, found.kind, found.subtype, found.encoding, found.degraded) == ("", "unknown", "pdf", "utf-8", True) and found.error
    assert extract("x", None).text == ""


def test_html_references_need_their_semicolon():
    assert html_text("<title>x&amp;&amp</title><p>&copy 1 &copy; 2 &ampx; &am</p>") == "x&&amp\n&copy 1 © 2 &ampx; &am"
    assert html_text("<p>&amp;lt; &lt;b&gt; &#65; &#x42; &#67 && &nosuch; &</p>") == "&lt; <b> A B &#67 && &nosuch; &"
    assert html_text("<a href='?a=1&copy=2'>a</a><script>a && b</script>&quot") == "a\n&quot"


def test_html_modes():
    assert html_text("<p>a &amp; b<br>c</p><script>x()</script>") == "a & b\nc"
    assert html_text("<p>a<b> b </b></p>", "strict") == "a\nb"
    assert html_text("no <i>tag</i> first") == "no  tag  first"
    with pytest.raises(Exception):
        html_text("<p><br></p>", "strict")
    assert extract("p.html", b"<html><body><br>x</body></html>", mode="strict").error


_LARGE_SHEET = """
import io, resource, sys, zipfile
from quillmere.sources import formats
data = io.BytesIO()
with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive, archive.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
    out.write(b"<w><cols/><sheetData>")
    row = b"".join(b'<c r="%c1" t="inlineStr"><is><t>some text of a cell that is long enough to matter %d</t></is></c>' % (65 + k, k) for k in range(20))
    size = 0
    while size < 100_000_000:
        out.write(b"<row>" + row + b"</row>")
        size += len(row) + 11
    out.write(b"</sheetData></w>")
content = data.getvalue()
now = int(open("/proc/self/statm").read().split()[0]) * resource.getpagesize()
resource.setrlimit(resource.RLIMIT_AS, (now + 370_000_000,) * 2)
found = formats.extract("large.xlsx", content)
assert found.error is None and found.char_count > 54_000_000, found.error or found.char_count
"""


def test_a_large_sheet_needs_little_more_than_its_text():
    """100 MB unpacked, 54 MB of text in lines and joined, under a limit that the tree of its elements would exceed."""
    subprocess.run([sys.executable, "-c", _LARGE_SHEET], cwd=Path(__file__).parent.parent, check=True, timeout=300)


def test_a_zip_bomb_is_a_failed_row(monkeypatch):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for name in ("word/document.xml", "ppt/slides/slide1.xml", "xl/worksheets/sheet1.xml"):
            archive.writestr(name, b"<w>" + b" " * 5_000_000 + b"</w>")
    assert len(data.getvalue()) < 50_000
    for name in ("a.docx", "a.pptx", "a.xlsx"):
        assert formats.extract(name, data.getvalue()).error is None
    monkeypatch.setattr(formats, "MOST_UNPACKED", 1_000_000)
    for name in ("a.docx", "a.pptx", "a.xlsx", "a.doc"):
        assert "5000007 bytes" in formats.extract(name, data.getvalue()).error


def test_nested_paragraphs_and_odd_sheets():
    def archive(**members):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, text in members.items():
                z.writestr(name.replace("__", "/") + ".xml", text)
        return data.getvalue()

    nested = "<w xmlns:a='a'><a:p>one<a:t>A</a:t><a:box><a:p><a:t>B</a:t></a:p></a:box></a:p><tbl><tr><tc><a:p><a:t>C</a:t></a:p></tc></tr></tbl></w>"
    assert formats.extract("n.docx", archive(word__document=nested)).text == "AB\nB\nC"
    rows = "<row><c r='B1'><v>x</v></c></row><row r='9'><c r='A9'><v>last</v></c></row><row><c r='A1'><v>after</v></c><c r='ZZZZZZ1'><v>far</v></c></row><row r='2'><c r='A2'><v>two</v></c></row>"
    assert formats.extract("s.xlsx", archive(xl__worksheets__sheet1=f"<w>{rows}</w>")).text == "--- Sheet xl/worksheets/sheet1.xml ---\n\tx\ntwo\nlast\nafter"
    assert formats.extract("b.xlsx", archive(xl__worksheets__sheet1="<w><row>")).error.startswith("ParseError")


def test_bytes_that_are_no_shift_jis():
    assert decode(b"\xa0")[:2] == ("�", "utf-8") and decode(b" \xfd\xfe")[1] == "windows-1252"
    assert decode("ｶﾅ ｱ 1".encode("cp932"))[:2] == ("ｶﾅ ｱ 1", "shift_jis") and decode("中文 1".encode("big5"))[:2] == ("中文 1", "big5")
