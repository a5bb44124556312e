"""SentencePiece merge-type encoding by backtracking, and decoding.

The library merges the best-scored neighbouring symbols until none is left.
The same sequence is found here from left to right: a sequence of pieces is the
right one when every piece and every two neighbours re-merge to themselves. At
each position the longest piece is tried first (all longest pieces of a unit
come from one Aho-Corasick pass over its reversal), then ever shorter prefixes;
a piece must be compatible with its left neighbour, which is decided by merging
the two anew and kept in a memo. Positions from which no sequence leads to the
end are set in a bit field and never entered again, so the work is linear.

Texts fall into units which no merge crosses: pieces hold the space mark only
at their start, so a unit is a run of marks and what follows it, and a line
break that no piece holds stands alone. Results of short units are kept in a
bounded memo, since words repeat.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import map_rows

MARK = "▁"
#: Entries of each memo, and the longest unit kept in one: they bound a worker's memory.
WORD_ENTRIES, UNIT_ENTRIES, PAIR_ENTRIES, MEMO_LENGTH = 120_000, 20_000, 300_000, 48
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class PieceCodec:
    """Encoder and decoder of one merge-type model file with byte fallback."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as file:
            model.ParseFromString(file.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        known = {p.type for p in model.pieces} <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}
        if train.model_type != 2 or not train.byte_fallback or not known or train.treat_whitespace_as_suffix:
            raise ValueError("a merge-type model with byte fallback and no user-defined pieces is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("a model whose normalisation only marks spaces is needed")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a model whose pieces hold the space mark at their start is needed")
        self.score = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == _CONTROL}
        self.special = self.silent | self.byte_of.keys()
        self.plain = [p.replace(MARK, " ") for p in self.pieces]
        self.digits = [str(i) for i in range(len(self.pieces))]
        self.break_alone = not any("\n" in p for p in self.ids)
        self.inside = {p[n : n + 2] for p in self.ids for n in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        self.lengths = [len(p) for p in self.pieces]
        self.single = {p: i for p, i in self.ids.items() if len(p) == 1}
        for piece, i in self.ids.items():
            if len(piece) > 1 or len(self.single) == len(self.ids):
                self.automaton.add_word(piece[::-1], i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.pairs: dict[int, int] = {}
        self.ends: dict[int, dict[int, tuple]] = {0: {}, -1: {}}
        self.units: dict[str, tuple] = {}
        self.words: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Best-scored neighbours are joined, leftmost first, until none can be."""
        score = self.score.get
        symbols = list(symbols)
        joined = [score(a + b) for a, b in zip(symbols, symbols[1:])]
        while True:
            best = max((s for s in joined if s is not None), default=None)
            if best is None:
                return symbols
            at = joined.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = score(symbols[at - 1] + symbols[at])
            if at < len(joined):
                joined[at] = score(symbols[at] + symbols[at + 1])

    def _steps(self, piece: int, end: int) -> tuple:
        """Merging a piece alone: (score of the next merge, symbol at its ``end``) before each and after the last; () if it isn't merged to itself."""
        found = self.ends[end].get(piece)
        if found is None:
            symbols, out, score = list(self.pieces[piece]), [], self.score.get
            while True:
                joined = [score(a + b) for a, b in zip(symbols, symbols[1:])]
                best = max((s for s in joined if s is not None), default=None)
                out.append((best, symbols[end]))
                if best is None:
                    break
                at = joined.index(best)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            found = self.ends[end][piece] = tuple(out) if len(symbols) == 1 else ()
        return found

    def _apart(self, left: tuple, right: tuple) -> bool:
        """Whether no merge crosses the boundary while both sides are merged, best first and of equals the leftmost."""
        if not left or not right:
            return False
        score, i, j = self.score.get, 0, 0
        (a, last), (b, first) = left[0], right[0]
        across = score(last + first)
        while True:
            if across is not None and (a is None or across > a) and (b is None or across >= b):
                return False
            if a is not None and (b is None or a >= b):
                i += 1
                a, now = left[i]
                if now is not last:
                    last = now
                    across = score(last + first)
            elif b is not None:
                j += 1
                b, now = right[j]
                if now is not first:
                    first = now
                    across = score(last + first)
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces, merged anew from single characters, stay these two."""
        return self._apart(self._steps(left, -1), self._steps(right, 0))

    def fitting(self, left: int, piece: int) -> int:
        """The longest of ``piece`` and the pieces it starts with that is compatible with ``left``; -1 if none."""
        key = left << 20 | piece
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            found = piece
            while found >= 0 and not self.compatible(left, found):
                found = self._prefix_of(found)
            self.pairs[key] = found
        return found

    def _prefix_of(self, piece: int) -> int:
        """The longest piece that ``piece`` starts with and that is shorter; -1 if none."""
        found = self.shorter.get(piece)
        if found is None:
            text = self.pieces[piece]
            found = next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), -1)
            self.shorter[piece] = found
        return found

    def split(self, unit: str) -> list[int]:
        """Piece ids of a unit; a character that no piece holds, and so nothing merges with, is -1 less its code point."""
        size, lengths, pairs, single = len(unit), self.lengths, self.pairs.get, self.single.get
        # matches that end at one place come longest first, and of equal keys a dictionary keeps the last;
        # pieces of one character are left to a dictionary, as each place has one and few are needed
        longest = dict([*self.automaton.iter(unit[::-1])][::-1]).get
        failed, out, at, left, fresh = 0, [], 0, -1, True
        piece = longest(size - 1)
        while at < size:
            if piece is None:
                piece = single(unit[at], -1)
            if piece >= 0:
                if left >= 0:
                    found = pairs(left << 20 | piece)
                    piece = self.fitting(left, piece) if found is None else found
                end = at + lengths[piece] if piece >= 0 else 0
            else:
                end = at + 1 if fresh else 0
            if end and not failed >> end & 1:
                left = piece if piece >= 0 else -1 - ord(unit[at])
                out.append(left)
                at, fresh, piece = end, True, longest(size - 1 - end)
                continue
            if not end or piece < 0:
                failed |= 1 << at
                if not out:
                    raise ValueError("no sequence of pieces fits")  # the merged sequence itself always does
                piece = out.pop()
                at -= lengths[piece] if piece >= 0 else 1
                left = out[-1] if out else -1
            piece, fresh = self._prefix_of(piece) if piece >= 0 else -1, False
        return out

    def ids_of(self, split: list[int]) -> list[int]:
        if not split or min(split) >= 0:
            return split
        found: list[int] = []
        for p in split:
            found.extend([p] if p >= 0 else [self.byte_ids[b] for b in chr(-1 - p).encode("utf-8", "surrogatepass")])
        return found

    def _unit(self, unit: str) -> tuple:
        """(number of ids, ids as text, decoded text) of a unit."""
        found, digits = self.units.get(unit), self.digits
        if found is None:
            ids = self.ids_of(self.split(unit))
            found = (len(ids), ",".join([digits[i] for i in ids]), self._plain(ids))
            if len(unit) <= MEMO_LENGTH:
                if len(self.units) >= UNIT_ENTRIES:
                    self.units.clear()
                self.units[unit] = found
        return found

    def _word(self, word: str) -> tuple:
        """What ``_unit`` gives for a mark and ``word``; a sign after a letter that no piece holds together is a unit of its own.

        The newer half of the memo replaces the older when it is full.
        """
        found, digits = self.older.get(word), self.digits
        if found is None and 1 < len(word) <= MEMO_LENGTH and word[-2:] not in self.inside and word[-2:-1].isalpha():
            (n, ids, plain), (m, last, sign) = self.words.get(word[:-1]) or self._word(word[:-1]), self._unit(word[-1])
            found = (n + m, f"{ids},{last}", plain + sign)
        elif found is None:
            ids = self.ids_of(self.split(MARK + word))
            found = (len(ids), ",".join([digits[i] for i in ids]), self._plain(ids))
        if len(word) <= MEMO_LENGTH:
            if len(self.words) >= WORD_ENTRIES:
                self.older, self.words = self.words, {}
            self.words[word] = found
        return found

    def units_of(self, text: str) -> list[tuple]:
        """What ``_unit`` gives for each unit of a text, in order."""
        if not text:
            return []
        marked = self.prefix + text.replace(" ", MARK)
        out: list[tuple] = []
        add = out.append
        for n, line in enumerate(marked.split("\n") if self.break_alone else [marked]):
            if n:
                add(self._unit("\n"))
            first, *words = line.split(MARK)
            if first:
                add(self._unit(first))
            if "" not in words:
                known, made = self.words.get, self._word
                out += [known(word) or made(word) for word in words]
                continue
            run = MARK
            for word in words:
                if not word:
                    run += MARK
                elif run is MARK:
                    add(self.words.get(word) or self._word(word))
                else:
                    add(self._unit(run + word))
                    run = MARK
            if len(run) > 1:
                add(self._unit(run[1:]))
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text, as the library gives them without begin, end and sampling."""
        return [int(i) for unit in self.units_of(text or "") for i in unit[1].split(",")]

    def both(self, text: str | None) -> tuple[np.ndarray, str]:
        """Ids of a whole text, and the text decoded from them unit by unit."""
        units = self.units_of(text or "")
        ids = np.fromstring(",".join([u[1] for u in units]), np.int32, sep=",")
        return ids, self._bare("".join([u[2] for u in units]))

    def _plain(self, ids) -> str:
        if self.special.isdisjoint(ids):
            plain = self.plain
            return "".join([plain[i] for i in ids])
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in self.silent:
                out.append(self.plain[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids) -> str:
        """Text of ids; the space that encoding puts first is taken off."""
        return self._bare(self._plain(ids))

    def _bare(self, plain: str) -> str:
        return plain[1:] if self.prefix and plain.startswith(" ") else plain

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids as text, SHA-256 of the decoded text)."""
        units = self.units_of(text or "")
        ids = ",".join([u[1] for u in units])
        plain = self._bare("".join([u[2] for u in units]))
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        return sum([u[0] for u in units]), sha(ids), sha(plain)


_CODECS: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """The codec of a model file, built once in each worker process."""
    if model_path not in _CODECS:
        _CODECS[model_path] = PieceCodec(model_path)
    return _CODECS[model_path]


def encode_documents(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: str = "ids"
) -> DataFrame:
    """Encode every whole text: one row per row of ``docs``, without a shuffle.

    outputs "ids": (doc_id, n_tokens, ids array<int>); "digests": (doc_id,
    n_tokens, ids_sha256, decoded_sha256), where decoding has been done too;
    "text": (doc_id, n_tokens, ids, decoded).
    Defined cases: null and empty texts have no ids and decode to ''; ids of
    documents may be null or repeat; an empty table gives an empty one; other
    columns of ``docs`` are ignored. ``model_path`` must exist on every machine.
    """
    schema = {
        "ids": "doc_id long, n_tokens long, ids array<int>",
        "digests": "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        "text": "doc_id long, n_tokens long, ids array<int>, decoded string",
    }[outputs]

    def per_task():
        own = codec(model_path)

        def one(doc_id, text):
            if outputs == "digests":
                return doc_id, *own.digests(text)
            ids, decoded = own.both(text)
            return (doc_id, len(ids), ids) if outputs == "ids" else (doc_id, len(ids), ids, decoded)

        return one

    per_task.per_task = True
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), per_task, schema)
