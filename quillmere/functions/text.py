"""Text functions as column expressions: names, signatures, newlines, paragraphs, headings, windows, markup."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space in the sense of the reference's language - Unicode spaces and line ends, and the byte order mark.
SPACES = "\t\n\x0b\x0c\r " + "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))

#: First bytes of containers.
ZIP_SIGNATURE, OLE2_SIGNATURE, PDF_SIGNATURE = "504B0304", "D0CF11E0A1B11AE1", "255044462D"

#: Elements that tell markup from text.
MARKUP = r"(?i)<(!doctype|html|head|body|div|p|span|td|a|script|style)\b"

#: The type of paragraphs and chunks with their headings.
PIECES = T.ArrayType(T.StructType().add("text", T.StringType()).add("heading", T.StringType()))

#: A heading line, once trimmed; its text ends where the line does.
_HEADING = re.compile(rf"#{{1,6}}[{SPACES}]+([^\n\r\u2028\u2029]+)$")


def trim(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.btrim(text, F.lit(SPACES))


def extension(name: Column) -> Column:
    """Lower-case part after the last dot; '' if there is none or it is empty."""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


#: Fixed value: the characters of file names that become underscores.
UNSAFE = r'[\\/:*?"<>|]'


def safe_name(name: Column) -> Column:
    """A file name without path separators and other characters that file systems refuse."""
    return F.regexp_replace(F.regexp_replace(name, UNSAFE, "_"), r"\.\.", "_")


def _starts(content: Column, signature: str) -> Column:
    return F.coalesce(F.hex(F.substring(content, 1, len(signature) // 2)) == signature, F.lit(False))


def is_zip(content: Column) -> Column:
    return _starts(content, ZIP_SIGNATURE)


def is_ole2(content: Column) -> Column:
    return _starts(content, OLE2_SIGNATURE)


def is_pdf(content: Column) -> Column:
    return _starts(content, PDF_SIGNATURE)


def reader_of(name: Column, content: Column) -> Column:
    """Which reader takes a file: ooxml, legacy, pdf or text, by the order of dispatch."""
    ext = extension(name)
    return (
        F.when(ext.isin("docx", "pptx", "xlsx") & is_zip(content), "ooxml")
        .when(ext.isin("doc", "ppt", "xls") | is_ole2(content), "legacy")
        .when((ext == "pdf") | is_pdf(content), "pdf")
        .otherwise("text")
    )


def looks_like_text(content: Column) -> Column:
    """Whether the first kilobyte has no NUL and is printable for more than 85 %; true for nothing at all."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")  # a character per byte
    good = F.length(F.regexp_replace(head, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    return F.coalesce((F.length(head) == 0) | (~F.contains(head, F.lit("\0")) & (good / F.nullif(F.length(head), F.lit(0)) > 0.85)), F.lit(True))


def normalize_newlines(text: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def collapse_blank(text: Column) -> Column:
    """Three line ends or more become two; the ends are trimmed."""
    return trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def is_markup(text: Column) -> Column:
    return text.rlike(MARKUP)


def strip_tags(text: Column) -> Column:
    """Tags become spaces: the way out for markup that no parser is used on."""
    return normalize_newlines(F.regexp_replace(text, r"<[^>]+>", " "))


def paragraph_list(text: str | None) -> list[tuple[str, str | None]]:
    """(text, heading) of the blocks between blank lines; a heading is carried to the blocks after it."""
    out, last = [], None
    for block in re.split("\n{2,}", (text or "").strip(SPACES)):
        lines = [x for line in block.split("\n") if (x := line.strip(SPACES))]
        own = next((m[1].strip(SPACES) for x in lines if (m := _HEADING.match(x))), None)
        last = last if own is None else own
        if lines:
            out.append((" ".join(lines), last))
    return out


@F.arrow_udf(PIECES)
def _paragraphs(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("text", pa.string()), ("heading", pa.string())]))
    done = [
        pa.array([[{"text": t, "heading": h} for t, h in paragraph_list(x)] for x in texts.slice(at, 64).to_pylist()], kind)
        for at in range(0, len(texts), 64)
    ]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def paragraphs(text: Column) -> Column:
    """array<struct<text, heading>>: what ``paragraph_list`` gives, in Arrow batches.

    The heading carried on makes this a running state, which an expression
    could only keep by copying its output at every step.
    """
    return _paragraphs(text)


def hard_split(text: Column, size: int, overlap: int) -> Column:
    """array<string>: windows of ``size`` characters, each starting ``size - overlap`` after the one before.

    The text is cut into cells of a step by one pass of a pattern; a window is
    the cells it covers, so no window counts characters from the beginning.
    """
    step = max(1, size - overlap)
    cells = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    count = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / F.lit(float(step)))).cast("int")
    windows = lambda found: F.transform(
        F.sequence(F.lit(0), count), lambda i: F.substring(F.array_join(F.slice(found, i + 1, -(-size // step)), ""), 1, size)
    )
    once = F.element_at(F.transform(F.array(cells), windows), 1)  # a name for the cells, so that they are found once
    return F.when(F.length(text) > 0, once).otherwise(F.array().cast("array<string>"))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def preview(text: Column, length: int = 200) -> Column:
    return F.substring(text, 1, length)


def column_index(reference: Column) -> Column:
    """Zero-based column of a cell reference such as AB12; -1 if it starts with no capital letter."""
    letters = F.split(F.regexp_extract(reference, r"^([A-Z]*)", 1), "")
    return F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64) - 1
