"""Greedy chunking of paragraphs with overlapping tails and headings: one pass over the paragraphs of a document.

Each step needs what the one before left open, which no built-in expression
carries on without copying all earlier output again. So the pass is a plain
loop in Arrow batches; its time grows with the text, whatever the number of
paragraphs, and documents don't shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmere.functions.text import PIECES, SPACES, paragraph_list

_ARROW = pa.list_(pa.struct([("text", pa.string()), ("heading", pa.string())]))
#: Documents that Python holds as objects at once.
_SLICE = 64


def windows(text: str, size: int, overlap: int) -> Iterable[str]:
    """What ``hard_split`` gives, of one text."""
    step = max(1, size - overlap)
    return (text[at : at + size] for at in range(0, max(0, len(text) - size + step - 1) // step * step + 1, step))


def greedy(blocks: Iterable[tuple[str, str | None]], size: int, overlap: int, least: int = 1) -> list[tuple[str, str | None]]:
    """Chunks (text, heading) of paragraphs (text, heading).

    A paragraph joins the open text if both fit into ``size``. If not, the open
    text is closed and its last ``overlap`` characters open the next, before
    the paragraph. A paragraph that is too long by itself is cut into windows,
    but only where no text is open; its heading stays for a later paragraph.
    """
    out: list[tuple[str, str | None]] = []
    parts: list[str] = []
    length, heading = 0, None

    def close() -> str:
        whole = "\n".join(parts).strip(SPACES)
        if len(whole) < least:
            return ""
        out.append((whole, heading))
        return whole[-overlap:] if overlap > 0 else ""

    for text, own in blocks:
        if not length and len(text) > size:
            heading = heading if own is None else own
            out += [(w, heading) for w in windows(text, size, overlap)]
        elif length and length + 1 + len(text) > size:
            tail = close()
            parts, heading = [tail, text] if tail else [text], own
            length = len(text) + (len(tail) + 1 if tail else 0)
        else:
            length += len(text) + (1 if length else 0)
            parts.append(text)
            heading = own if heading is None else heading
    if "\n".join(parts).strip(SPACES):
        close()
    return out


def _batched(each):
    """An Arrow function out of one that gives (text, heading) pairs for one value; null and failing types give no chunk."""

    def run(values: pa.Array) -> pa.Array:
        done = []
        for at in range(0, len(values), _SLICE):
            rows = [[{"text": t, "heading": h} for t, h in each(v)] if v is not None else [] for v in values.slice(at, _SLICE).to_pylist()]
            done.append(pa.array(rows, _ARROW))
        return pa.concat_arrays(done) if done else pa.array([], _ARROW)

    return run


def chunks(text: Column, size: int = 1200, overlap: int = 150, least: int = 1) -> Column:
    """array<struct<text, heading>> of a text; empty for a null or blank text or a size of 0 and less."""
    if size <= 0:
        return F.array().cast(PIECES)
    return F.arrow_udf(_batched(lambda t: greedy(paragraph_list(t), size, overlap, least)), PIECES)(text)


def fold(blocks: Column, size: int, overlap: int, least: int = 1) -> Column:
    """Chunks of paragraphs that are there as array<struct<text, heading>>; those without text are left out."""
    pairs = lambda rows: [(r["text"], r["heading"]) for r in rows if r is not None and r["text"]]
    return F.arrow_udf(_batched(lambda rows: greedy(pairs(rows), size, overlap, least)), PIECES)(blocks)
