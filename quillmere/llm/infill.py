"""Fill-in-the-middle: texts cut at two unit boundaries and put together with the middle last.

A text is decoded into an array of UTF-32 code points. A unit is a run of ASCII
letters or any other single code point, so a boundary lies wherever two
neighbours aren't both letters; ``flatnonzero`` of that comparison gives all of
them. Two ranks drawn from a hash of the document's id pick the cuts, and the
three slices are encoded again. Which form a text takes follows from the same
hash, so reruns and lost executors give the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import column_or_null, map_rows

#: What marks the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Shares in percent: of texts that are rearranged, and of those that begin with the suffix.
REARRANGED, SUFFIX_FIRST = 90, 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def boundaries(points: np.ndarray) -> np.ndarray:
    """Places of code points where units begin, and the length at the end: n + 1 places for n units."""
    if not len(points):
        return np.zeros(1, np.int64)
    letter = (points | np.uint32(32)) - np.uint32(97) < 26  # below 97 it wraps around
    inner = np.flatnonzero(~(letter[1:] & letter[:-1])) + 1
    return np.concatenate([[0], inner, [len(points)]])


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits for a document; a missing id is an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def rearranged(doc_id: int | None, text: str | None, seed: int = 1, marks=MARKS, share: int = REARRANGED, suffix_first: int = SUFFIX_FIRST):
    """(n, form, prefix_chars, middle_chars, output) of one text; a plain one stays as it is and has no cuts."""
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = boundaries(points)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= share or any(m in text for m in marks):
        return n, "plain", None, None, text
    a, b = sorted((int(ends[h1 % (n + 1)]), int(ends[h2 % (n + 1)])))
    prefix, middle, suffix = (points[x].tobytes().decode("utf-32-le") for x in (slice(a), slice(a, b), slice(b, None)))
    p, s, m = marks
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, "".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a, b - a, "".join((p, prefix, s, suffix, m, middle))


def check_marks(marks) -> None:
    """Marks must stay recognisable whatever text stands beside them: no end of one may begin another or itself."""
    ends = {m[k:] for m in marks for k in range(1, len(m))}
    if len(set(marks)) != 3 or not all(marks) or any(x.startswith(e) for x in marks for e in ends) or any(x in y for x in marks for y in marks if x != y):
        raise ValueError("marks must differ, and no end of one may begin a mark")


def infill_documents(
    docs: DataFrame,
    seed: int = 1,
    marks: tuple[str, str, str] = MARKS,
    share: int = REARRANGED,
    suffix_first: int = SUFFIX_FIRST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: doc_id, n (units), form, prefix_chars, middle_chars, output. One map, no shuffle.

    Forms: psm is prefix, suffix, middle, each after its mark; spm has suffix
    and prefix exchanged; plain texts are as they were, without cuts. Defined
    cases: null and empty texts are plain, empty and of 0 units; so are texts
    that hold a mark, whatever is drawn; a null id is an empty one; rows that
    repeat give the same again; an empty table gives an empty one; other columns
    are ignored. Texts of any length are cut as a whole, at 4 bytes a code point.
    """
    check_marks(marks)

    def one(doc_id, text):
        return doc_id, *rearranged(doc_id, text, seed, marks, share, suffix_first)

    return map_rows(docs.select(column_or_null(docs, id_col, "long").alias("doc_id"), F.col(text_col).alias("text")), one, SCHEMA)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text as it was, from output and form alone."""
    p, s, m = marks
    at_m = F.instr(output, m)

    def pieces(first: str, second: str) -> tuple[Column, Column]:
        """What stands after the first mark and after the second."""
        begin, at = F.lit(len(first) + 1), F.instr(output, second)
        return F.substr(output, begin, at - begin), F.substr(output, at + len(second), at_m - at - len(second))

    (prefix, suffix), (suffix_, prefix_) = pieces(p, s), pieces(s, p)
    middle = F.substr(output, at_m + len(m))
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle, suffix_)).otherwise(output)
