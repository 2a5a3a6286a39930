"""Packing tokenised documents into fixed windows by order-preserving dynamic programming.

The documents of an input partition form one stream of tokens. A cut may fall at the end of a
document (free), after a sentence (``SENTENCE`` tokens of penalty), or, inside a stretch longer
than ``STRETCH`` tokens without either, anywhere on a grid (``INSIDE``). With T the position of
a cut in the stream,

    cost(i) = penalty(i) + capacity + min { cost(j) : T(i) - T(j) <= capacity }

is least where padding plus penalties are least, since the tokens themselves are given. The
candidates j form a sliding window, whose minimum a monotone queue keeps, so each cut is looked
at once. The stream is planned in blocks; what follows the last full window of a block goes on
into the next one, so only the last window of a partition is left short.

Nothing is shuffled: order within a partition is kept, documents never wait for other
partitions, and a task holds one block of tokens besides its input batch.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grammar import gather, runs_of
from .groups import schema_of
from .workers import kept, vocabulary_path

CAPACITY = 4096
SENTENCE, INSIDE = 24, 96
STRETCH, GRID = 512, 64
BLOCK = 1 << 20
END_ID = 2
ENDS = (b".", b"!", b"?")
# Characters that a word may shed before it is looked up; see ``Words.add``.
TAIL = b".,!?;:%$*&#|"
# Words of these letters are one piece to the tokenizer's first split.
LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
# Words kept by a worker. Beyond it the tables start anew.
WORDS = 500_000


class Words:
    """Token ids by word.

    The tokenizer drops white space and never joins what it separates, so a text's ids are
    those of its words in turn. ASCII letters are lowered first, which the tokenizer does as
    well, but for the strings of special tokens: texts with ``<|`` are encoded as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that end a word
        for token, number in self.tokenizer.get_vocab().items():
            self.last[number] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.code: dict[bytes, int] = {}
        self.ids: list[bytes] = []
        self.sizes = array("i")
        self.ends = array("b")

    def encode(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each word with its ids. Words of plain letters have one end mark, and go in one text."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [i for i, w in enumerate(texts) if LETTERS.fullmatch(w)]
        runs = [plain[at : at + 256] for at in range(0, len(plain), 256)]
        rest = set(range(len(words))).difference(plain)
        for run, e in zip(runs, self.many([" ".join([texts[i] for i in run]) for run in runs]), strict=True):
            ids = np.array(e.ids, np.uint32)
            stops = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(stops) != len(run):
                rest.update(run)
                continue
            raw = ids.tobytes()
            yield from zip([words[i] for i in run], map(raw.__getitem__, map(slice, [0, *stops], stops)))
        alone = sorted(rest)
        for i, e in zip(alone, self.many([texts[i] for i in alone]), strict=True):
            yield words[i], array("I", e.ids).tobytes()

    def many(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def add(self, words: set[bytes]) -> None:
        """Learn words. A tail of punctuation after an ASCII letter or digit is a token run of its own."""
        cut, plain = [], []
        for w in words:
            core = w.rstrip(TAIL)
            if core != w and core[-1:].isalnum():  # bytes: ASCII only
                cut.append((w, core, w[len(core) :]))
            else:
                plain.append(w)
        parts = {x for _, core, tail in cut for x in (core, tail)}.difference(self.code, plain)
        plain += parts
        for at in range(0, len(plain), 16384):
            for w, ids in self.encode(plain[at : at + 16384]):
                self.learn(w, ids)
        for w, core, tail in cut:
            if w not in self.code:
                self.learn(w, self.ids[self.code[core]] + self.ids[self.code[tail]])

    def learn(self, word: bytes, ids: bytes) -> None:
        self.code[word] = len(self.ids)
        self.ids.append(ids)
        self.sizes.append(len(ids) // 4)
        self.ends.append(word.endswith(ENDS))

    def tokens(self, texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
        """Ids of each text as little-endian unsigned 32-bit numbers, and positions after a sentence.

        A sentence ends with a word whose last character is ``.``, ``!`` or ``?``. Texts with
        ``<|`` are encoded whole and have no sentence ends.
        """
        marked = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        words = split.flatten().cast(pa.binary()).dictionary_encode()
        said = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        missing = [w for w in said if w not in self.code]
        if len(self.code) + len(missing) > WORDS:
            self.clear()
            missing = said
        self.add(set(missing))
        known = np.fromiter(map(self.code.__getitem__, said), np.int64, len(said))
        flat = np.frombuffer(b"".join(map(self.ids.__getitem__, known.tolist())), "<u4")
        size = np.array(self.sizes, np.int64)[known]
        at = words.indices.to_numpy()
        out = gather(flat, (np.cumsum(size) - size)[at], size[at]).tobytes()
        ends = np.concatenate([[0], np.cumsum(size[at])])
        stop = np.array(self.ends, bool)[known][at]
        for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
            if marked[i]:
                ids = self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids
                yield array("I", ids).tobytes(), np.zeros(0, np.int64)
            else:
                yield out[4 * ends[a] : 4 * ends[b]], ends[a + 1 : b + 1][stop[a:b]] - ends[a]


def best_cuts(at: list[int], penalty: list[int], capacity: int, last: bool) -> list[int]:
    """Indices of the cuts to make, from the candidate positions ``at`` (0 first).

    With ``last`` the stream ends at the last candidate; else it goes on, and the cheapest end
    within the last window is taken, counting what it leaves over as if it were padding.
    """
    n = len(at)
    cost, back = [0] * n, [0] * n
    queue: deque[int] = deque([0])
    for i in range(1, n):
        t = at[i] - capacity
        while at[queue[0]] < t:
            queue.popleft()
        j = queue[0]
        cost[i] = c = cost[j] + capacity + penalty[i]
        back[i] = j
        while queue and cost[queue[-1]] >= c:
            queue.pop()
        queue.append(i)
    end = n - 1
    if not last:
        ends = (i for i in range(n - 1, 0, -1) if at[n - 1] - at[i] < capacity)
        end = min(ends, key=lambda i: cost[i] + at[n - 1] - at[i])
    cuts = []
    while end:
        cuts.append(end)
        end = back[end]
    return cuts[::-1]


class Stream:
    """Documents of a partition that wait for their windows."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.ids = bytearray()
        self.docs: list[tuple] = []  # id, place in the stream (below 0: begun earlier), tokens
        self.at, self.penalty = [0], [0]

    def __len__(self) -> int:
        return len(self.ids) // 4

    def add(self, doc_id, ids: bytes, stops: np.ndarray) -> None:
        start = len(self)
        n = len(ids) // 4
        inner = np.unique(stops[stops < n])
        bounds = np.concatenate([[0], inner, [n]])
        wide = np.flatnonzero(np.diff(bounds) > min(STRETCH, self.capacity))
        extra = [np.arange(bounds[k] + GRID, bounds[k + 1], GRID) for k in wide]
        if GRID >= self.capacity:
            extra = [np.arange(bounds[k] + 1, bounds[k + 1]) for k in wide]
        cuts = np.concatenate([inner, *extra, [n]]).astype(np.int64)
        cost = np.concatenate([np.full(len(inner), SENTENCE), *[np.full(len(x), INSIDE) for x in extra], [0]])
        order = np.argsort(cuts, kind="stable")
        self.at += (cuts[order] + start).tolist()
        self.penalty += cost[order].astype(np.int64).tolist()
        self.ids += ids
        self.docs.append((doc_id, start, n))

    def windows(self, last: bool) -> Iterator[list[tuple]]:
        """Each window's pieces (id, start, ids, tokens of the document, offset); keeps the rest."""
        if not self.docs:
            return
        cuts = [self.at[i] for i in best_cuts(self.at, self.penalty, self.capacity, last)]
        view, d, begin = bytes(self.ids), 0, 0
        for end in cuts:
            pieces, at = [], begin
            while at < end:
                doc_id, start, n = self.docs[d]
                stop = min(end, start + n)
                pieces.append((doc_id, at - start, view[4 * at : 4 * stop], n, at - begin))
                at = stop
                d += stop == start + n
            yield pieces
            begin = end
        kept_at = [i for i, x in enumerate(self.at) if x > begin]
        self.penalty = [0] + [self.penalty[i] for i in kept_at]
        self.at = [0] + [self.at[i] - begin for i in kept_at]
        self.docs = [(i, s - begin, n) for i, s, n in self.docs[d:]]
        del self.ids[: 4 * begin]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): one row per piece.

    ``ids`` are little-endian unsigned 32-bit token ids, with id 2 after each document.
    ``tokenizer`` is a file that every executor can read; by default ``word_bpe_49k.json`` of
    the installed public tokenizers. ``sequence_id`` is unique and grows within a partition.
    Null and empty texts are one token. Repeated rows and null ids are packed like any others;
    empty input gives no rows; other columns are not read. A window is at most ``capacity``
    tokens, and short of it where a cut nearby was dearer than the padding.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path = vocabulary_path(tokenizer, "word_bpe_49k.json")
        table = kept("words")
        words = table.get(path)
        if words is None:
            words = table[path] = Words(path)
        stream, sequence = Stream(capacity), TaskContext.get().partitionId() << 40

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out, held = [], 0
            for pieces in stream.windows(last):
                for doc_id, start, ids, n, offset in pieces:
                    out.append((doc_id, start, len(ids) // 4, ids, n, sequence, offset))
                    held += len(ids)
                sequence += 1
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            names = batch.column(0).to_pylist()
            for at, texts in runs_of(batch.column(1)):
                for doc_id, (ids, stops) in zip(names[at:], words.tokens(texts)):
                    stream.add(doc_id, ids + end, stops)
                    if len(stream) > block:
                        yield from packed(False)
        yield from packed(True)

    return rows.mapInArrow(run, ddl)
