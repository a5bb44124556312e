"""Charset detection: marks, strict UTF-8, then a vote among legacy charsets."""

from __future__ import annotations

import codecs
import re
from typing import NamedTuple

#: Byte order marks, the four-byte ones first, and the name each is reported by.
MARKS = (
    (b"\xff\xfe\x00\x00", "utf-32-le", "utf-32"),
    (b"\x00\x00\xfe\xff", "utf-32-be", "utf-32"),
    (b"\xef\xbb\xbf", "utf-8", "utf-8"),
    (b"\xff\xfe", "utf-16-le", "utf-16le"),
    (b"\xfe\xff", "utf-16-be", "utf-16be"),
)
#: Legacy charsets in the order that wins ties, with the codec for each.
LEGACY = {"gb18030": "gb18030", "shift_jis": "cp932", "big5": "big5", "windows-1252": "cp1252"}

_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_HAN = re.compile(r"[㐀-䶿一-鿿]")
#: What the codec makes of the four bytes that are none of Shift_JIS (A0, FD, FE, FF).
_NO_SHIFT_JIS = re.compile("[\uf8f0-\uf8f3]")


class Decoded(NamedTuple):
    text: str
    encoding: str
    had_bom: bool


def _undefined_as_control(error: UnicodeDecodeError):
    """The five bytes that windows-1252 leaves open stand for the control characters of their numbers."""
    return "".join(chr(b) for b in error.object[error.start : error.end]), error.end


codecs.register_error("quillmere-c1", _undefined_as_control)


def plausibility(text: str) -> int:
    """Characters that can be read; Han characters count nine times."""
    return len(text) - len(_CONTROL.findall(text)) - text.count("�") + 8 * len(_HAN.findall(text))


def _strict(data: bytes, codec: str) -> str | None:
    try:
        text = data.decode(codec, "quillmere-c1" if codec == "cp1252" else "strict")
    except (UnicodeDecodeError, LookupError):
        return None
    return None if codec == "cp932" and _NO_SHIFT_JIS.search(text) else text


def decode(data: bytes, preferred: str | None = None) -> Decoded:
    """Text of bytes in an unknown charset; undecodable bytes become U+FFFD as a last resort."""
    for mark, codec, name in MARKS:
        if data.startswith(mark):
            return Decoded(data[len(mark) :].decode(codec, "replace"), name, True)
    strict = _strict(data, "utf-8")
    if strict is not None:
        return Decoded(strict, "utf-8", False)
    tried = [(preferred, LEGACY.get(preferred, preferred))] if preferred else []
    votes = [(text, name) for name, codec in [*tried, *LEGACY.items()] if (text := _strict(data, codec)) is not None]
    if votes:
        text, name = max(votes, key=lambda v: plausibility(v[0]))  # of equals the first
        if text.strip():
            return Decoded(text, name, False)
    return Decoded(data.decode("utf-8", "replace"), "utf-8", False)


def newlines(text: str) -> str:
    return re.sub(r"\r\n?", "\n", text)
