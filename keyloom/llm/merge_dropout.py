"""SentencePiece encoding with seeded merge-dropout, and decoding.

Byte-pair merging by an agenda: the best pair of neighbours is taken first, of equal ones the
leftmost. Each candidate taken from the agenda is skipped with the dropout rate, by draws keyed
by (seed, document, place of the unit in the text), so every occurrence of a word is segmented
anew, and alike on every run. Whatever was skipped, the pieces spell the text: symbols outside the
vocabulary are written as bytes, as is a literal U+2581, which stands for a space inside pieces.

Texts are cut into units where no piece of the vocabulary has both neighbours side by side, so
no merge can cross. A draw says how many candidates are taken until the next one is skipped. A
worker keeps what units become without a skip and after the skips that come again; all others are
merged anew, thousands of them together: a row of symbols each, of which the best candidate is
taken in every step.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, padded
from .workers import kept, vocabulary_path

SPACE = "▁"
# Stands for a U+2581 of the text, which never merges; surrogates do not occur in texts.
LITERAL = "\ud800"
MASK = 2**64 - 1
# Units of up to so many symbols are merged in a list.
SHORT = 64
DROPOUT = 0.1
# Parts of units and segmentations kept by a worker. Beyond them the table starts anew.
PARTS = 400_000
NODES = 600_000
# Skips of a unit whose segmentation may be kept.
DEPTH = 3
# Units merged together.
MANY = 4096
# Characters of text worked on at once.
RUN = 1 << 19
# Rows decoded at once.
ROWS = 512
NEVER = np.iinfo(np.int32).max
FAR = 1 << 62
# In place of what is not kept: not met yet, met once, never kept.
NEW, ONCE, LONG = -1, -2, -3
TAIL = ".,!?;:%$*&#|"
TAILS = np.array([chr(b) in TAIL for b in range(256)])


class Column:
    """Numbers in a row, to which more are added."""

    def __init__(self) -> None:
        self.room, self.size = np.empty(1024, np.int32), 0

    def add(self, values: np.ndarray) -> int:
        """Where the first of the new ones stands."""
        at, need = self.size, self.size + len(values)
        if need > len(self.room):
            grown = np.empty(max(need, 3 * len(self.room) // 2), np.int32)
            grown[:at] = self.room[:at]
            self.room = grown
        self.room[at:need], self.size = values, need
        return at

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.room[at]


class Known:
    """What parts of units become, by the skips on the way.

    A node is a part and the candidates that were skipped: each as the number of candidates taken
    since the skip before. It has the number of candidates that follow if no more is skipped, the
    ids that then come out, and a node or a mark for the skip of each. A part without skips is a
    node itself, which ``root`` has at the number of the part.
    """

    def __init__(self) -> None:
        self.words = Words()
        self.said: list[str] = []
        self.nodes = 0
        # of nodes: the part, the node before the last skip, candidates since then; see above
        self.part, self.parent, self.gap, self.count = Column(), Column(), Column(), Column()
        self.start, self.length, self.kids = Column(), Column(), Column()
        self.ids, self.kid, self.root = Column(), Column(), Column()

    def full(self) -> bool:
        return len(self.said) > PARTS or self.nodes > NODES

    def of(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The nodes of parts without skips; parts met for the first time get theirs."""
        number, first = self.words.numbers(raw, starts, ends - starts)
        if len(first):
            first = first[np.argsort(number[first])]
            held = raw.tobytes()
            fresh = [held[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            n = len(fresh)
            marks = np.fromiter((LONG if len(p) > SHORT else NEW for p in fresh), np.int32, n)
            self.root.add(self._add(np.arange(len(self.said), len(self.said) + n), np.full(n, -1), np.zeros(n), marks))
            self.said += fresh
        return self.root[number]

    def _add(self, part: np.ndarray, parent: np.ndarray, gap: np.ndarray, count: np.ndarray) -> np.ndarray:
        for column, values in ((self.part, part), (self.parent, parent), (self.gap, gap), (self.count, count)):
            column.add(values)
        for column in (self.start, self.length, self.kids):
            column.add(np.zeros(len(part)))
        self.nodes += len(part)
        return np.arange(self.nodes - len(part), self.nodes)

    def after(self, parent: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """New nodes: one more skip after ``gap`` more candidates."""
        made = self._add(self.part[parent], parent, gap, np.full(len(parent), NEW))
        self.kid.room[self.kids[parent] + gap] = made
        return made

    def paths(self, nodes: np.ndarray) -> np.ndarray:
        """A row for each skip of the nodes, all of which have equally many: the candidates taken before it."""
        rows = []
        while len(nodes) and self.parent[nodes[0]] >= 0:
            rows.append(self.gap[nodes].astype(np.int64))
            nodes = self.parent[nodes]
        return np.array(rows[::-1], np.int64).reshape(len(rows), len(nodes))

    def texts(self, nodes: np.ndarray) -> list[str]:
        return [self.said[k] for k in self.part[nodes].tolist()]

    def keep(self, nodes: np.ndarray, count: np.ndarray, ids: list[bytes]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.start.room[nodes] = self.ids.add(np.frombuffer(b"".join(ids), np.int32)) + np.cumsum(sizes) - sizes
        self.length.room[nodes], self.count.room[nodes] = sizes, count
        self.kids.room[nodes] = self.kid.add(np.full(int(count.sum()), NEW)) + np.cumsum(count) - count


class Spelled:
    """What the pieces of a SentencePiece model spell."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.spelled: list[bytes] = []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.spelled.append(b"")
            else:
                self.spelled.append(piece.replace(SPACE, " ").encode())

    def decode(self, ids: bytes) -> str:
        spelled = b"".join(map(self.spelled.__getitem__, array("I", ids)))
        return spelled.decode("utf-8", "replace")[1:]


class Pieces(Spelled):
    """The vocabulary of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        super().__init__(path)
        model = SentencePieceProcessor(model_file=path)
        self.rank: dict[str, tuple[float, int]] = {}
        self.bytes: list[int] = [0] * 256
        self.texts: dict[int, str] = {}
        pairs = set()
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.rank[piece] = (-model.get_score(i), i)
                self.texts[i] = piece
                pairs.update(zip(piece, piece[1:]))
        self.pairs = pairs
        self.names = [b"%d" % i for i in range(model.vocab_size())]
        # line ends are units of their own if no piece has one inside; spaces begin units
        alone = "\n" if not any("\n" in p for pair in pairs for p in pair) else ""
        self.cut = re.compile(rf" *[^ {alone}]+| +|[{alone}]" if alone else r" *[^ ]+| +")
        self.spaces_join = all(a == SPACE for a, b in pairs if b == SPACE)
        self.known = Known()
        self.tails = np.array([ord(a) << 8 | ord(b) for a, b in pairs if b in TAIL], np.int64)
        self.line_ends = bool(alone)
        self.tabulate()

    def tabulate(self) -> None:
        """Symbols as numbers, and what two neighbours become: its place in the order of merges, and its number."""
        order = sorted(self.rank, key=self.rank.__getitem__)
        self.symbols = {piece: found[1] for piece, found in self.rank.items()}
        for c in sorted({c for pair in self.pairs for c in pair}):  # a piece may have characters that are none
            self.symbols.setdefault(c, len(self.names) + len(self.symbols))
        self.letters = np.full(0x110000, -2, np.int32)  # -2: one that never merges
        for c, number in self.symbols.items():
            if len(c) == 1:
                self.letters[ord(c)] = number
        self.letters[ord(" ")], self.letters[ord(SPACE)] = self.symbols.get(SPACE, -2), -2
        joined = []
        for place, piece in enumerate(order):
            for at in range(1, len(piece)):
                a, b = self.symbols.get(piece[:at]), self.symbols.get(piece[at:])
                if a is not None and b is not None:
                    joined.append((a << 32 | b, place))
        joined.sort()
        table = np.array(joined, np.int64).reshape(-1, 2)
        self.neighbours = np.append(table[:, 0], -1)
        self.places = np.append(table[:, 1], 0).astype(np.int32)
        self.becomes = np.array([self.rank[piece][1] for piece in order], np.int32)

    def proposed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place in the order of merges of each pair of symbols, ``NEVER`` where they do not merge."""
        keys = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self.neighbours[:-1], keys)
        return np.where((self.neighbours[at] == keys) & (b >= 0), self.places[at], NEVER)

    def merge_many(self, parts: list[str], ahead: np.ndarray, redraw: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
        """Candidates taken and ids of parts of up to ``SHORT`` symbols, all merged together.

        ``ahead`` says how many candidates each takes until it skips one; ``redraw`` then gives the
        next such numbers. What is left is in ``ahead`` at the end.
        """
        taken, ids = np.zeros(len(parts), np.int64), [b""] * len(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 20), (20, 36), (36, SHORT)):
            chosen = np.flatnonzero((sizes > low) & (sizes <= high))
            for at in range(0, len(chosen), MANY):
                self._merge(parts, chosen[at : at + MANY], high, ahead, redraw, taken, ids)
        return taken, ids

    def _merge(self, parts: list[str], which: np.ndarray, width: int, ahead, redraw, taken, ids) -> None:
        said = [parts[i] for i in which.tolist()]
        left = np.fromiter(map(len, said), np.int64, len(said))
        symbols = np.full((len(said), width + 1), -1, np.int32)
        symbols[np.arange(width + 1) < left[:, None]] = self.letters[np.frombuffer("".join(said).encode("utf-32-le"), np.uint32)]
        agenda = self.proposed(symbols[:, :-1], symbols[:, 1:])
        columns = np.arange(width + 1)
        while len(which):
            row = np.arange(len(which))
            best = agenda.argmin(1)  # the leftmost of equal ones
            place = agenda[row, best]
            done = place == NEVER
            if done.any():
                self._spell(parts, which[done], symbols[done], left[done], ids)
                go = ~done
                which, symbols, agenda, left, best, place = which[go], symbols[go], agenda[go], left[go], best[go], place[go]
                row = row[: len(which)]
                if not len(which):
                    return
            taken[which] += 1
            skip = ahead[which] == 0
            ahead[which] -= 1
            if skip.any():
                agenda[row[skip], best[skip]] = NEVER
                ahead[which[skip]] = redraw(which[skip])
            row = np.flatnonzero(~skip)
            if not len(row):
                continue
            best = best[row]
            # what stands right of the merged pair moves one to the left
            merged, order = symbols[row], agenda[row]
            behind = columns > best[:, None]
            np.copyto(merged[:, :-1], merged[:, 1:].copy(), where=behind[:, :-1])
            np.copyto(order[:, :-1], order[:, 1:].copy(), where=behind[:, :-2])
            every = np.arange(len(row))
            merged[every, best] = self.becomes[place[row]]
            order[every, best] = self.proposed(merged[every, best], merged[every, best + 1])
            inner = np.flatnonzero(best > 0)
            order[inner, best[inner] - 1] = self.proposed(merged[inner, best[inner] - 1], merged[inner, best[inner]])
            symbols[row], agenda[row] = merged, order
            left[row] -= 1

    def _spell(self, parts: list[str], which: np.ndarray, symbols: np.ndarray, left: np.ndarray, ids: list[bytes]) -> None:
        width, raw = 4 * symbols.shape[1], symbols.astype("<u4").tobytes()
        odd = ((symbols >= len(self.names)) | (symbols < -1)).any(1).tolist()
        for k, (i, n, strange) in enumerate(zip(which.tolist(), left.tolist(), odd)):
            if not strange:
                ids[i] = raw[k * width : k * width + 4 * n]
                continue
            out, at = [], 0
            for x in symbols[k, :n].tolist():
                if 0 <= x < len(self.names):
                    out.append(x)
                    at += len(self.texts[x])
                else:  # one character without a piece
                    c = parts[i][at]
                    out += [self.bytes[b] for b in (SPACE if c == " " else c).encode()]
                    at += 1
            ids[i] = array("I", out).tobytes()

    def segment(self, part: str, dropout: float, keyed: int) -> bytes:
        """Ids of one long part, in which a space is a space; candidates are skipped as ``keyed`` and ``dropout`` say."""
        symbols = [SPACE if c == " " else LITERAL if c == SPACE else c for c in part]
        ids = []
        for s in self.merge_long(symbols, int(dropout * 2**64), keyed):
            found = self.rank.get(s)
            if found:
                ids.append(found[1])
            else:
                ids += [self.bytes[b] for b in (SPACE if s == LITERAL else s).encode()]
        return array("I", ids).tobytes()

    def skipped(self, piece: int, left: int, limit: int, keyed: int) -> bool:
        return xxhash.xxh64_intdigest(self.names[piece], (keyed + left) & MASK) < limit

    def merge_long(self, symbols: list[str], limit: int, keyed: int) -> list[str]:
        """The agenda as a heap and symbols as a linked list, for units of any length."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple] = []

        def propose(left: int, right: int) -> None:
            if left >= 0 and right < n:
                found = self.rank.get(symbols[left] + symbols[right])
                if found:
                    heapq.heappush(agenda, (found, left, right, len(symbols[left]), len(symbols[right])))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            (_, piece), left, right, a, b = heapq.heappop(agenda)
            if len(symbols[left]) != a or len(symbols[right]) != b:
                continue  # one of them has been merged meanwhile
            if limit and self.skipped(piece, left, limit, keyed):
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            propose(before[left], left)
            propose(left, after[left])
        return [s for s in symbols if s]

    def parts(self, unit: str) -> list[str]:
        """A unit without its tail of punctuation, and the tail, if no merge can join them."""
        core = unit.rstrip(TAIL)
        if core and len(core) < len(unit) and (core[-1], unit[len(core)]) not in self.pairs and core[-1] != " ":
            return [core, unit[len(core) :]]
        return [unit]

    def units(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the units of texts in ``raw`` begin and end, as ``cut`` finds them, and where their tails begin, as in ``parts``."""
        n = int(bounds[-1])
        text = raw[:n]
        begins = np.zeros(n + 1, bool)
        begins[bounds] = True
        if self.spaces_join:
            space = text == 32
            begins[1:n] |= space[1:] & ~space[:-1]
            if self.line_ends:
                line = np.flatnonzero(text == 10)
                begins[line] = True
                begins[line + 1] = True
        starts = np.flatnonzero(begins[:n])
        stops = np.append(starts, n)[1:]
        core = np.flatnonzero(~TAILS[text])
        cores = stops.copy()
        tailed = np.flatnonzero(TAILS[text[stops - 1]])
        last = np.searchsorted(core, stops[tailed]) - 1
        last = np.where(last >= 0, core[last], -1) if len(core) else np.full(len(tailed), -1)
        chosen = (last >= starts[tailed]) & (raw[last] != 32)
        tailed, last = tailed[chosen], last[chosen]
        joins = np.isin(_character(raw, last) << 8 | raw[last + 1], self.tails)
        cores[tailed[~joins]] = last[~joins] + 1
        return starts, cores, stops

    def learn(self, nodes: np.ndarray) -> None:
        """What comes of nodes, all of equally many skips, if nothing more is skipped."""
        paths = self.known.paths(nodes)
        gaps_of = np.vstack([paths, np.full((1, len(nodes)), FAR)])
        met = np.zeros(len(nodes), np.int64)

        def redraw(these: np.ndarray) -> np.ndarray:
            met[these] += 1
            return gaps_of[met[these], these]

        taken, ids = self.merge_many(self.known.texts(nodes), gaps_of[0].copy(), redraw)
        self.known.keep(nodes, taken - paths.sum(0) - len(paths), ids)

    def walk(self, node: np.ndarray, ahead: np.ndarray, redraw: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Where each part ends up by its skips, and what it takes from ``ahead``; -1 if that is not kept.

        What is asked for again is worked out and kept.
        """
        known, end = self.known, np.full(len(node), -1, np.int32)
        here, active = node.copy(), np.flatnonzero(known.count[node] != LONG)
        unkept = here[active][known.count[here[active]] < 0]
        nodes, times = np.unique(unkept, return_counts=True)
        again = (times > 1) | (known.count[nodes] == ONCE)
        known.count.room[nodes[~again]] = ONCE
        self.learn(nodes[again])
        active = active[known.count[here[active]] >= 0]
        for depth in range(DEPTH + 1):
            follow = known.count[here[active]]
            done = ahead[active] >= follow
            end[active[done]] = here[active[done]]
            ahead[active[done]] -= follow[done]
            active = active[~done]
            if depth == DEPTH or not len(active):
                return end
            slots = known.kids[here[active]] + ahead[active]
            kids = known.kid[slots]
            asked, one, times = np.unique(slots[kids < 0], return_index=True, return_counts=True)
            again = (times > 1) | (known.kid[asked] == ONCE)
            known.kid.room[asked[~again]] = ONCE
            one = active[kids < 0][one[again]]
            self.learn(known.after(here[one], ahead[one]))
            kids = known.kid[slots]
            active = active[kids >= 0]
            here[active] = kids[kids >= 0]
            ahead[active] = redraw(active)
        return end

    def encode(self, text: str, dropout: float, seed: int, document: int) -> bytes:
        return self.encode_many([text], dropout, seed, [document])[0]

    def encode_many(self, texts: list[str], dropout: float, seed: int, documents: list[int]) -> list[bytes]:
        """Ids of each text."""
        if self.known.full():
            self.known = Known()
        known, digest = self.known, xxhash.xxh64_intdigest
        spaced = [(" " + t).encode() if t else b"" for t in texts]
        bounds = np.cumsum([0, *map(len, spaced)])
        raw = padded(b"".join(spaced))
        del spaced
        starts, cores, stops = self.units(raw, bounds)
        ends = np.searchsorted(starts, bounds[1:])
        many, n = np.diff(ends, prepend=0), len(starts)
        if not n:
            return [b""] * len(texts)
        # the parts in the order of the text; the tail of a unit follows its core
        pairs = np.flatnonzero(cores < stops)
        at = np.arange(n) + np.cumsum(cores < stops) - (cores < stops)
        begins, behind = np.empty(n + len(pairs), np.int64), np.empty(n + len(pairs), np.int64)
        begins[at], behind[at] = starts, cores
        begins[at[pairs] + 1], behind[at[pairs] + 1] = cores[pairs], stops[pairs]
        node = known.of(raw, begins, behind)
        unit, second = node[at], node[at[pairs] + 1]
        keys = [digest(b"%d,%d" % (seed, document)) for document in documents]
        drawn = [np.random.Generator(np.random.Philox(key=key)).random(k) for key, k in zip(keys, many.tolist())]
        ahead = gaps(np.concatenate(drawn), dropout)
        key = np.repeat(np.array(keys, np.uint64), many)
        place = np.arange(n) - np.repeat(ends - many, many)
        draws = np.zeros(n, np.int64)

        def redraw(who: np.ndarray) -> np.ndarray:
            draws[who] += 1
            found = zip(place[who].tolist(), draws[who].tolist(), key[who].tolist())
            return gaps(np.array([digest(b"%d,%d" % (p, d), k) for p, d, k in found], np.uint64) / 2**64, dropout)

        # where the ids of the parts of each unit stand: among those kept, or, below 0, among their own
        start, length, own = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64), Column()
        for turn, who, node in ((0, np.arange(n), unit), (1, pairs, second)):
            left, before = ahead[who], draws[who]
            end = self.walk(node, left, lambda these, who=who: redraw(who[these]))
            kept_ones = end >= 0
            ahead[who[kept_ones]] = left[kept_ones]
            start[who[kept_ones], turn] = known.start[end[kept_ones]]
            length[who[kept_ones], turn] = known.length[end[kept_ones]]
            others = np.flatnonzero(~kept_ones)
            these, nodes = who[others], node[others]
            draws[these] = before[others]
            long = known.count[nodes] == LONG
            ids = [b""] * len(these)
            for i in np.flatnonzero(long).tolist():
                k = these[i]
                ids[i] = self.segment(known.said[known.part[nodes[i]]], dropout, digest(b"%d" % place[k], int(key[k])))
            short = np.flatnonzero(~long)
            these, nodes = these[short], nodes[short]
            left = ahead[these]
            taken, made = self.merge_many(known.texts(nodes), left, lambda which, these=these: redraw(these[which]))
            ahead[these] = left
            for i, x in zip(short.tolist(), made):
                ids[i] = x
            # one that was met for the first time and skipped nothing
            plain = np.flatnonzero((known.count[nodes] < 0) & (draws[these] == before[others][short]))
            known.keep(nodes[plain], taken[plain], [made[i] for i in plain.tolist()])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            at = own.add(np.frombuffer(b"".join(ids), np.int32)) + np.cumsum(sizes) - sizes
            start[who[others], turn], length[who[others], turn] = -1 - at, sizes
        start = np.where(start < 0, known.ids.size - 1 - start, start).ravel()
        every = np.concatenate([known.ids.room[: known.ids.size], own.room[: own.size]])
        length = length.ravel()
        behind = np.cumsum(length)
        raw = every[np.repeat(start - behind + length, length) + np.arange(behind[-1])].astype("<u4").tobytes()
        marks = [0, *(4 * np.append(0, behind)[2 * ends]).tolist()]
        return [raw[s:e] for s, e in zip(marks, marks[1:])]

    def in_runs(self, texts: pa.Array, dropout: float, seed: int, documents: list[int]) -> Iterator[list[bytes]]:
        """The same in runs of about ``RUN`` characters, whatever the number and length of the texts."""
        start, held, size = 0, [], 0
        for x in texts:
            held.append(x.as_py())
            size += len(held[-1])
            if size > RUN:
                yield self.encode_many(held, dropout, seed, documents[start : start + len(held)])
                start, held, size = start + len(held), [], 0
        yield self.encode_many(held, dropout, seed, documents[start:])


def _character(raw: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The characters in UTF-8 that end with the bytes at ``last``."""
    a, b, c, d = (raw[last - i].astype(np.int64) for i in range(4))
    two = (b & 31) << 6 | a & 63
    three = (c & 15) << 12 | (b & 63) << 6 | a & 63
    four = (d & 7) << 18 | (c & 63) << 12 | (b & 63) << 6 | a & 63
    return np.where(a < 128, a, np.where(b >= 192, two, np.where(c >= 224, three, four)))


def gaps(draws: np.ndarray, dropout: float) -> np.ndarray:
    """Candidates until the next one that is skipped, by draws from 0 to 1."""
    if not 0 < dropout < 1:
        return np.full(len(draws), 0 if dropout >= 1 else FAR)
    return (np.log(np.maximum(draws, 1e-300)) / math.log1p(-dropout)).astype(np.int64)


def loaded(path: str | None, kind: type[Spelled] = Pieces) -> Spelled:
    path = vocabulary_path(path, "piece_bpe_32k.model")
    table = kept("pieces")
    if (path, kind.__name__) not in table:
        table[path, kind.__name__] = kind(path)
    return table[path, kind.__name__]


def _types(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def encode(
    docs: DataFrame,
    keep: list[str],
    text_col: str = "text",
    model: str | None = None,
    dropout: float = DROPOUT,
    seed: int = 42,
    id_col: str | None = None,
) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``ids``: little-endian unsigned 32-bit piece ids.

    A document is told by its text and, where ``id_col`` is given, its id. ``model`` is a file that
    every executor can read; by default ``piece_bpe_32k.model`` of the installed public
    tokenizers. A null or empty text has no ids. Repeated rows are encoded alike. An input
    column named ``ids`` must not be among ``keep``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.xxhash64(text, *([F.col(id_col)] if id_col else []))
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], name.alias("__document"), text.alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            names, texts = batch.columns[-2:]
            at = 0
            for ids in pieces.in_runs(texts, dropout, seed, names.to_pylist()):
                some = batch.columns[:-2]
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(at, len(ids)) for c in some], pa.array(ids, pa.binary())],
                    names=[*batch.schema.names[:-2], "ids"],
                )
                at += len(ids)

    return chosen.mapInArrow(run, _types(chosen, keep) + "ids binary")


def decode(encoded: DataFrame, keep: list[str], ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """Columns ``keep`` of ``encoded`` and ``text``; no or null ids give an empty text."""
    chosen = encoded.select(*[F.col(f"`{c}`") for c in keep], F.col(ids_col).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model, Spelled)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = [pieces.decode(x.as_py() or b"") for x in batch.column(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"]
                )

    return chosen.mapInArrow(run, _types(chosen, keep) + "text string")
