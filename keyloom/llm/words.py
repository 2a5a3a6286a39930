"""Numbers for short strings of bytes, thousands of them looked up together.

A string of up to 16 bytes is two 64-bit numbers, which are compared whole: the table is exact.
Longer strings, and those with a zero byte, are kept in a dict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Bytes of a string in the table, and of one that is kept at all.
WIDTH, LONGEST = 16, 40
# Strings looked up at once.
AT_ONCE = 1 << 15
_ONES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_LOW = _ONES[np.minimum(np.arange(WIDTH + 1), 8)]
_HIGH = _ONES[np.maximum(np.arange(WIDTH + 1) - 8, 0)]


def padded(raw: bytes | memoryview) -> np.ndarray:
    """The bytes, and behind them as many as a lookup may read."""
    out = np.zeros(len(raw) + WIDTH, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out


class Words:
    """Strings of bytes and their numbers from 0 on, in open addressing: ``number`` is where ``low`` is not 0."""

    def __init__(self) -> None:
        self.size, self.long = 0, {}
        self._room(AT_ONCE)

    def _room(self, need: int) -> None:
        self.bits = max(18, (2 * need - 1).bit_length())
        self.low, self.high = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.number = np.zeros(1 << self.bits, np.int32)

    def __iter__(self) -> Iterator[bytes]:
        at = np.flatnonzero(self.low)
        for a, b in zip(self.low[at].tolist(), self.high[at].tolist()):
            yield (a | b << 64).to_bytes(WIDTH, "little").rstrip(b"\0")
        yield from self.long

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = low * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed += high * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, given: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the strings, and which of them are new; new ones have the numbers given, or the next ones."""
        number, first = np.empty(len(low), np.int32), [np.zeros(0, np.int64)]
        todo, slot = np.arange(len(low)), self._slots(low, high)
        while len(todo):
            there, a, b = self.low[slot], low[todo], high[todo]
            done = (there == a) & (self.high[slot] == b)
            number[todo[done]] = self.number[slot[done]]
            free = np.flatnonzero(there == 0)
            if len(free):
                at = slot[free]
                self.number[at] = free
                won = free[self.number[at] == free]  # one of the strings that want the same place
                at, who = slot[won], todo[won]
                self.low[at], self.high[at] = low[who], high[who]
                new = self.size + np.arange(len(won)) if given is None else given[who]
                self.number[at] = number[who] = new
                self.size += len(won)
                first.append(who)
                done[won] = True
                slot[free] -= 1  # the others look there again
            left = ~done
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self.bits) - 1)
        return number, np.concatenate(first)

    def numbers(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, first): of the strings in ``raw``, which is ``padded``, and where each new number is met.

        Strings longer than ``LONGEST`` get a new number each time.
        """
        view = np.ndarray(len(raw) - 7, "<u8", raw.data, strides=(1,))
        out, first = np.empty(len(starts), np.int32), []
        odd = sizes > WIDTH
        zeros = np.flatnonzero(raw[:-WIDTH] == 0)
        if len(zeros):
            holder = np.searchsorted(starts, zeros, "right") - 1
            odd[holder[holder >= 0]] = True
        for begin in range(0, len(starts), AT_ONCE):
            part = slice(begin, begin + AT_ONCE)
            plain = np.flatnonzero(~odd[part]) + begin
            if 2 * (self.size + len(plain)) > 1 << self.bits:
                self._grow(self.size + len(plain))
            at, n = starts[plain], sizes[plain]
            found, new = self._find(view[at] & _LOW[n], view[at + 8] & _HIGH[n])
            out[plain] = found
            first.append(plain[new])
            fresh = []
            for i in (np.flatnonzero(odd[part]) + begin).tolist():
                a, n = int(starts[i]), int(sizes[i])
                said = raw[a : a + n].tobytes()
                known = self.long.get(said)
                if known is None:
                    known, self.size = self.size, self.size + 1
                    fresh.append(i)
                    if n <= LONGEST:
                        self.long[said] = known
                out[i] = known
            first.append(np.array(fresh, np.int64))
        return out, np.concatenate([np.zeros(0, np.int64), *first])

    def _grow(self, need: int) -> None:
        at = np.flatnonzero(self.low)
        low, high, number, size = self.low[at], self.high[at], self.number[at], self.size
        self._room(need)
        self._find(low, high, number)
        self.size = size

    def retain(self, chosen: np.ndarray) -> None:
        """Forget all numbers but those that ``chosen`` marks, which are numbered anew in the same order."""
        at = np.flatnonzero(self.low)
        at = at[chosen[self.number[at]]]
        place = np.cumsum(chosen) - 1
        low, high, number = self.low[at], self.high[at], place[self.number[at]]
        self.long = {said: int(place[n]) for said, n in self.long.items() if chosen[n]}
        size = int(chosen.sum())
        self._room(size)
        self._find(low, high, number)
        self.size = size
