"""Secret scans: fixed patterns, and random strings found by token efficiency.

A byte-pair vocabulary packs ordinary text into few tokens; a random string
stays at one or two characters per token. Runs of key characters are encoded,
with or without digits, and a ratio under the limit marks a span, once known
digests, identifiers and numbers are left out. What patterns leave of a run is
tested whole and then in its parts, so that a path before a key doesn't hide it.
A run of many short parts packs badly whatever they say (paths, file names,
times), so parts that pack badly by themselves must make up half of it.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import SLICE, map_rows

KINDS = ("assign", "access", "hex", "random")
#: The patterns of the three base kinds, and the least length of what they must hold.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: Random strings have so many characters at least, and fewer characters per token than this.
RANDOM_LEAST, CHARS_PER_TOKEN = 20, 2.2
#: A part of a run says something about it from so many characters on; share of the run that such parts must make up.
PART_LEAST, PART_SHARE = 5, 0.5
#: In rows of shorter parts these have so many characters at least; share of a row that must pack badly part by part.
SHORT_LEAST, ROW_SHARE = 3, 0.75
#: Lengths in hex digits of common digests; they and identifiers are no secrets by themselves.
DIGESTS = frozenset({32, 40, 56, 64, 96, 128})
#: Characters of a digest in hex and in base 64, by the label that may stand before it.
DIGEST_CHARS = {"md5": (32, 22), "sha1": (40, 27), "sha256": (64, 43), "sha384": (96, 64), "sha512": (128, 86)}
_UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
#: A label makes a digest only of what has a digest's length.
_LABELLED = "|".join(rf"{name}[-_=](?:[0-9a-fA-F]{{{a}}}|[A-Za-z0-9+/]{{{b}}}=*)" for name, (a, b) in DIGEST_CHARS.items())
IDENTIFIER = rf"{_UUID}|{_LABELLED}|[0-9+/_=-]+"
#: What joins the parts of a run, and the known forms that are left out where they stand within one.
_JOINING = "+/_=-"
_PARTS = re.compile(rf"[^{_JOINING}]+")
_KNOWN = re.compile(rf"(?<![A-Za-z0-9])(?:{_UUID}|{_LABELLED})(?![A-Za-z0-9])")
_PLACEHOLDER = "[secret]"


def between(start: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What ``spans`` leave of start to end."""
    out = []
    for a, b in sorted(spans):
        if a > start:
            out.append((start, a))
        start = max(start, b)
    return out + [(start, end)] * (start < end)


class SecretScanner:
    """Finds spans (kind, start, end) in code points, ends exclusive."""

    def __init__(self, vocabulary_path: str, pattern: str, limit: float = CHARS_PER_TOKEN):
        import tiktoken

        with open(vocabulary_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.limit = limit
        self.run = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % min(RANDOM_LEAST, ACCESS_LEAST, HEX_LEAST))
        self.assign, self.access, self.hex = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)
        self.identifier, self.digest = re.compile(IDENTIFIER), re.compile(r"[0-9a-f]+|[0-9A-F]+")

    def is_random(self, run: str) -> bool:
        """Whether a run of key characters is neither digest nor identifier and packs badly."""
        bare = run.strip(_JOINING)
        if len(run) < RANDOM_LEAST or self.identifier.fullmatch(run) or self.identifier.fullmatch(bare):
            return False
        if len(bare) in DIGESTS and self.digest.fullmatch(bare):
            return False
        return self._packs_badly(run) and self._holds_random_parts(run)

    def _holds_random_parts(self, run: str) -> bool:
        """Whether half of the run or more is parts that pack badly themselves; a run without joining characters is one part.

        Parts of three or four characters say something only together: a row
        of them that is long enough and mostly packs badly is taken as one
        string without what joins it.
        """
        parts = _PARTS.findall(run)
        if len(parts) == 1:
            return True
        bad, row = 0, []
        for part in [*parts, ""]:
            if SHORT_LEAST <= len(part) < PART_LEAST and not part.isdigit():
                row.append(part)
                continue
            bad += self._random_row(row)
            row = []
            if len(part) >= PART_LEAST and not part.isdigit() and self._packs_badly(part):
                bad += len(part)
        return bad >= PART_SHARE * sum(map(len, parts))

    def _random_row(self, row: list[str]) -> int:
        """Characters of a row of short parts if these are one random string, else 0."""
        together = "".join(row)
        if len(together) < RANDOM_LEAST or (len(together) in DIGESTS and self.digest.fullmatch(together)):
            return 0
        bad = sum(len(x) for x in row if self._packs_badly(x))
        return len(together) if bad >= ROW_SHARE * len(together) and self._packs_badly(together) else 0

    def _packs_badly(self, run: str) -> bool:
        return len(run) / len(self.encoding.encode_ordinary(run)) < self.limit

    def _random_parts(self, run: str) -> list[tuple[int, int]]:
        """Random strings within a run that isn't random as a whole.

        Neighbouring parts that all pack badly are one string, since keys may
        hold the joining characters themselves; if it isn't random, each part
        stands alone. Numbers and digests are no part of a string.
        """
        if self.identifier.fullmatch(run):
            return []
        groups: list[list[tuple[int, int]]] = [[]]
        for start, end in between(0, len(run), [m.span() for m in _KNOWN.finditer(run)]):
            groups.append([])
            for m in _PARTS.finditer(run, start, end):
                part = m[0]
                digest = len(part) in DIGESTS and self.digest.fullmatch(part)
                if part.isdigit() or digest or not self._packs_badly(part):
                    groups.append([])
                else:
                    groups[-1].append(m.span())
        out = []
        for group in filter(None, groups):
            whole = (group[0][0], group[-1][1])
            out += [x for x in ([whole] if self.is_random(run[slice(*whole)]) else group) if self.is_random(run[slice(*x)])]
        return out

    def _random(self, run: str) -> list[tuple[int, int]]:
        return [(0, len(run))] if self.is_random(run) else self._random_parts(run) if len(run) >= RANDOM_LEAST else []

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """All spans by start, then kind as in KINDS."""
        text, found = text or "", []
        lowered = text.lower()
        if any(x in lowered for x in ("passw", "secret", "token", "api")):
            found += [("assign", m.start(), m.end()) for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        # the characters of access keys and hex runs are all characters of such runs, and both are at least as long
        assigned, at_assign = [(s, e) for _, s, e in found], 0
        for run in self.run.finditer(text):
            word, at = run[0], run.start()
            own = [("access", at + m.start(), at + m.end()) for m in self.access.finditer(word) if m.end() - m.start() >= ACCESS_LEAST]
            own += [("hex", at + m.start(), at + m.end()) for m in self.hex.finditer(word) if m.end() - m.start() >= HEX_LEAST]
            while at_assign < len(assigned) and assigned[at_assign][1] <= at:
                at_assign += 1  # assignments don't overlap, and those before this run are before all later ones
            base, k = [(s, e) for _, s, e in own], at_assign
            while k < len(assigned) and assigned[k][0] < run.end():
                base.append(assigned[k])
                k += 1
            for s, e in between(at, run.end(), base):
                own += [("random", s + a, s + b) for a, b in self._random(text[s:e])]
            found += own
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))

    def redacted(self, text: str | None) -> str | None:
        """The text with a placeholder for every span; overlapping spans are one."""
        spans = self.spans(text)
        if not spans:
            return text
        out, done, upto = [], 0, -1
        for _, start, end in spans:
            if start >= upto:
                out += [text[done:start], _PLACEHOLDER]
            done = upto = max(upto, end)
        return "".join([*out, text[done:]])


_SCANNERS: dict[tuple, SecretScanner] = {}


def scanner(vocabulary_path: str, pattern: str, limit: float = CHARS_PER_TOKEN) -> SecretScanner:
    """The scanner of a vocabulary file, built once in each worker process."""
    key = (vocabulary_path, pattern, limit)
    if key not in _SCANNERS:
        _SCANNERS[key] = SecretScanner(*key)
    return _SCANNERS[key]


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_documents(
    docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: float = CHARS_PER_TOKEN
) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of base spans, their digest, and all spans. No shuffle.

    Defined cases: null and empty texts have no spans; ids may be null or
    repeat; an empty table gives an empty one; other columns are ignored.
    """

    def per_task():
        own = scanner(vocabulary_path, pattern, limit)

        def one(doc_id, text):
            spans = own.spans(text)
            base = [x for x in spans if x[0] != "random"]
            counts = [sum(x[0] == kind for x in base) for kind in KINDS[:3]]
            return doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

        return one

    per_task.per_task = True
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(wanted, per_task, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_documents(
    docs: DataFrame, vocabulary_path: str, pattern: str, text_col: str = "text", length_col: str | None = "n_chars"
) -> DataFrame:
    """``docs`` with every secret replaced; ``length_col``, if there, is the new length of changed texts.

    Defined cases: null and empty texts and those without secrets stay as they
    are, with their lengths; overlapping spans are one placeholder; repeated
    rows are each replaced; an empty table gives an empty one; other columns,
    whatever their names, are returned as they are. No shuffle.
    """
    import pyarrow as pa

    schema = docs.schema
    place = schema.names.index(text_col)
    length = schema.names.index(length_col) if length_col in schema.names else None

    def run(batches):
        own = scanner(vocabulary_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(place).to_pylist()
                clean = [own.redacted(x) for x in texts]
                if clean != texts:
                    columns = list(part.columns)
                    columns[place] = pa.array(clean, columns[place].type)
                    if length is not None:
                        sizes = [n if a == b else len(b) for n, a, b in zip(columns[length].to_pylist(), texts, clean)]
                        columns[length] = pa.array(sizes, columns[length].type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    return docs.mapInArrow(run, schema)
