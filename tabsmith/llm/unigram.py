"""The lattice that token counts (operator 3) and encoding (operator 4) share: a SentencePiece model's pieces
and scores, read as a unigram vocabulary, found in text by an Aho-Corasick automaton.

Rules of the public unigram encoder: a space is U+2581 and one stands before the text; the best path has the
largest sum of scores; among equal sums the path wins whose last piece begins first; a character that is no
piece costs the least score less 10 and becomes its UTF-8 bytes (or the unknown id, neighbours merged, if the
model has no byte pieces). Sums are kept in double precision, so they are exact for the whole scores of rank
vocabularies, where 32-bit sums over long texts would round.

No piece holds U+2581 behind another character, and characters outside of longer pieces stand alone; so a
text falls into segments whose best paths don't touch: :meth:`Lattice.segments`. If a vocabulary breaks the
first rule, the whole text is one segment.
"""

from __future__ import annotations

import re
from itertools import chain

import ahocorasick
import sentencepiece

MARK = "▁"
#: Segments whose result a worker keeps, in each of two generations: some 250 bytes each, so 150 MB at most.
KEEP = 300_000


class Memo(dict):
    """Results by segment; of two generations the older is dropped when the newer is full."""

    def __init__(self, work, longest: int):
        super().__init__()
        self.work, self.longest, self.old = work, longest, {}

    def __missing__(self, segment: str):
        found = self.old.get(segment)
        if found is None:
            found = self.work(segment)
        if len(segment) <= self.longest:
            if len(self) >= KEEP:
                self.old = dict(self)
                self.clear()
            self[segment] = found
        return found


class Lattice:
    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        names = {i: sp.id_to_piece(i) for i in plain}
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(names[i], (len(names[i]), sp.get_score(i), i))
        if plain:
            self.automaton.make_automaton()
        self.longest = max(map(len, names.values()), default=1)
        self.unknown_score = min((sp.get_score(i) for i in plain), default=0.0) - 10.0
        self.unknown_id = sp.unk_id()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.single = {x for x in names.values() if len(x) == 1}
        self.surface = [b""] * len(ids)
        for i in ids:
            self.surface[i] = names[i].replace(MARK, " ").encode() if i in names else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b""
        inner = {c for x in names.values() if len(x) > 1 for c in x} - {MARK}
        whole = any(MARK in x.lstrip(MARK) for x in names.values())
        members = re.escape("".join(sorted(inner))) or MARK
        self._cut = re.compile(".+" if whole else f"{MARK}*[{members}]+|{MARK}+|.", re.DOTALL)
        self._counts, self._codes = Memo(self._count, 4 * self.longest), Memo(self._encode, 4 * self.longest)

    def segments(self, text: str) -> list[str]:
        return self._cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def unknown_ids(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "replace")] if self.bytes else [self.unknown_id]

    # -- operator 3 -----------------------------------------------------------------------------------

    def count(self, text: str) -> tuple[int, float]:
        """Pieces of the best path over ``text`` and its score."""
        if not text:
            return 0, 0.0
        counts, scores = zip(*map(self._counts.__getitem__, self.segments(text)))
        return (sum(counts) if self.bytes else len(self.encode(text))), sum(scores)

    def _count(self, segment: str) -> tuple[int, float]:
        """Forward only: a ring of the last ``longest`` + 1 places holds best score and piece count."""
        size = self.longest + 1
        best, count, last = [float("-inf")] * size, [0] * size, [0] * size
        best[0] = 0.0
        at = 0  # the place whose pieces are being gathered
        for end, (length, score, _) in self.automaton.iter(segment):
            while at <= end:
                self._pass(segment, at, best, count, last, size)
                at += 1
            value = best[(at - length) % size] + score
            if value > best[at % size] or (value == best[at % size] and length > last[at % size]):
                best[at % size], count[at % size], last[at % size] = value, count[(at - length) % size] + 1, length
        while at < len(segment):
            self._pass(segment, at, best, count, last, size)
            at += 1
        self._finish(segment, at, best, count, size)
        return count[at % size], best[at % size]

    def _pass(self, segment: str, at: int, best: list, count: list, last: list, size: int) -> None:
        """Close place ``at`` and open the next one."""
        if at:
            self._finish(segment, at, best, count, size)
        best[(at + 1) % size], count[(at + 1) % size], last[(at + 1) % size] = float("-inf"), 0, 0

    def _finish(self, segment: str, at: int, best: list, count: list, size: int) -> None:
        """Let an unknown character end at place ``at``; ties stay with the pieces, which begin earlier."""
        char = segment[at - 1]
        if char not in self.single:
            value = best[(at - 1) % size] + self.unknown_score
            if value > best[at % size]:
                best[at % size], count[at % size] = value, count[(at - 1) % size] + len(self.unknown_ids(char))

    # -- operator 4 -----------------------------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        ids = list(chain.from_iterable(map(self._codes.__getitem__, self.segments(text))))
        if self.bytes:
            return ids
        return [x for x, before in zip(ids, [-1, *ids]) if x != self.unknown_id or x != before]

    def _encode(self, segment: str) -> tuple[int, ...]:
        """Streaming Viterbi: places from the last committed boundary on are held; see :class:`Window`."""
        window, at = Window(self), 0
        for end, (length, score, i) in self.automaton.iter(segment):
            while at <= end:
                window.open(segment, at)
                at += 1
            window.offer(at, length, score, i)
        while at < len(segment):
            window.open(segment, at)
            at += 1
        return tuple(window.close(segment, at))

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


class Window:
    """Best scores and back pointers from the last committed boundary to the present place.

    Any later path runs through one of the last ``longest`` places. When the paths back from all of them meet
    in one boundary, nothing before it can change: its ids are committed and the places before it dropped.
    """

    def __init__(self, lattice: Lattice):
        self.lattice, self.base = lattice, 0
        self.best, self.back = [0.0], [(0, -1)]  # back: length of the last piece, its id (-1: unknown character)
        self.done: list[int] = []
        self.limit = 4 * lattice.longest

    def open(self, segment: str, at: int) -> None:
        self._finish(segment, at)
        if len(self.best) > self.limit:
            self._commit(segment, at)
        self.best.append(float("-inf"))
        self.back.append((0, -1))

    def offer(self, at: int, length: int, score: float, piece: int) -> None:
        value = self.best[at - length - self.base] + score
        if value > self.best[at - self.base] or (value == self.best[at - self.base] and length > self.back[at - self.base][0]):
            self.best[at - self.base], self.back[at - self.base] = value, (length, piece)

    def close(self, segment: str, at: int) -> list[int]:
        self._finish(segment, at)
        self.done += self._ids(segment, at)
        return self.done

    def _finish(self, segment: str, at: int) -> None:
        if at > self.base and segment[at - 1] not in self.lattice.single:
            value = self.best[at - 1 - self.base] + self.lattice.unknown_score
            if value > self.best[at - self.base]:
                self.best[at - self.base], self.back[at - self.base] = value, (1, -1)

    def _path(self, at: int) -> list[int]:
        """The boundaries of the best path to ``at``, last first."""
        out = [at]
        while at > self.base:
            at -= self.back[at - self.base][0]
            out.append(at)
        return out

    def _ids(self, segment: str, at: int) -> list[int]:
        out: list[int] = []
        path = self._path(at)[::-1]
        for start, end in zip(path, path[1:]):
            piece = self.back[end - self.base][1]
            ids = [piece] if piece >= 0 else self.lattice.unknown_ids(segment[start])
            if not (ids == [self.lattice.unknown_id] and out and out[-1] == self.lattice.unknown_id):
                out += ids
        return out

    def _commit(self, segment: str, at: int) -> None:
        alive = [p for p in range(at, max(self.base, at - self.lattice.longest), -1) if self.best[p - self.base] > float("-inf")]
        common = set(self._path(alive[0]))
        for p in alive[1:]:
            common &= set(self._path(p))
        boundary = max(common)
        if boundary > self.base:
            self.done += self._ids(segment, boundary)
            drop = boundary - self.base
            self.best, self.back, self.base = self.best[drop:], self.back[drop:], boundary
        self.limit = len(self.best) + 3 * self.lattice.longest
