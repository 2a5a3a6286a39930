"""Token ids of a corpus in files compressed by a pair grammar (Re-Pair), read back by document.

Documents are dealt out in ascending order by range partitions; each becomes its token ids and
an end id. Consecutive documents of a partition form a shard of about ``SEGMENT`` ids, and each
shard has a grammar of its own: frequent pairs of neighbouring symbols are replaced by a new
symbol, again and again, the most frequent ones first. A round takes all pairs that occur at
least so often, the threshold falls by ``FALL`` from round to round; where two of them overlap
the more frequent one is replaced and the other waits for the next round.

The files are a Parquet table with a row per shard:

    first      ids before the shard in its file
    n_ids      ids of the shard
    docs       array of (doc_id, n): its documents in order and their ids
    segments   array of (n, base, rules, lengths, symbols): little-endian unsigned 32-bit numbers.
               Symbols from ``base`` on stand for the pair ``rules[symbol - base]``, which becomes
               ``lengths[symbol - base]`` ids. Only a document beyond SEGMENT ids has several.

``lengths`` make every stretch of a shard reachable: ``ids_between`` finds the symbols that hold
it without expanding the others. Files are written by Spark's own committer, so a lost executor
leaves no half file, and a task holds one shard besides its batch.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import compress as chosen_of

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import discard_on_exit, scratch_path
from .groups import schema_of
from .words import LONGEST as LONGEST
from .words import Words, padded
from .workers import kept, vocabulary_path

SEGMENT = 1 << 20
END_ID = 0
# A rule is kept when it replaces at least this many pairs; below it saves no space.
USES = 8
FALL = 4
# Rounds end when one shortens the shard by less than the 2**GAIN-th part.
GAIN = 6
BUCKET_BITS = 20
# Pieces of text kept by a worker, and their ids.
KNOWN, IDS = 1_500_000, 8_000_000
# Bytes of text looked up at once.
RUN = 4 << 20
# Characters that are a token run of their own behind a Latin letter or digit.
TAIL = ".,!?;:%$*&#|"
# Pieces encoded in one text.
JOINED = 4096
# Kinds of bytes: a space or line break, a tail character, a Latin letter or digit, a letter,
# surely no white space at the end of a character, at its beginning.
_GAP, _TAIL, _ALNUM, _LETTER, _SOLID, _OPENS = 1, 2, 4, 8, 16, 32


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[[32, 10]] |= _GAP
    kinds[[ord(c) for c in TAIL]] |= _TAIL
    for b in range(128):
        c = chr(b)
        kinds[b] |= _ALNUM * c.isalnum() | _LETTER * c.isalpha() | (_SOLID | _OPENS) * (32 < b < 127)
    kinds[128:] |= _SOLID | _OPENS
    return kinds


KINDS = _kinds()
# Latin letters and digits of two bytes.
LATIN = np.array([c > 127 and chr(c).isalnum() for c in range(0x250)] + [False] * 0x5B0)


def _white(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether a character of several bytes may be white space, by its first two."""
    return (
        (one == 0xC2) & ((two == 0x85) | (two == 0xA0))
        | (one == 0xE1) & ((two == 0x9A) | (two == 0xA0))
        | (one == 0xE2) & ((two == 0x80) | (two == 0x81))
        | (one == 0xE3) & (two == 0x80)
    )


def cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin in ``raw``, which is ``padded``; a text begins at each offset but the last.

    A piece begins at a single space or line break between two characters of which one is surely no
    white space, and at a tail character behind a Latin letter or digit: no token of a byte-level
    tokenizer crosses them, and what stands before such a place has the ids that it has alone.
    """
    n = int(offsets[-1])
    kind = KINDS[raw]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    gaps = np.flatnonzero(kind[:n] & _GAP)
    gaps = gaps[~begins[gaps]]
    one, two = raw[gaps - 1], raw[gaps - 2]
    before = ((kind[gaps - 1] & _SOLID) > 0) & ~((one >= 128) & (_white(two, one) | _white(raw[gaps - 3], two)))
    one, two = raw[gaps + 1], raw[gaps + 2]
    after = ((kind[gaps + 1] & _OPENS) > 0) & ~begins[gaps + 1] & ~_white(one, two)
    found = gaps[before | after]
    tails = np.flatnonzero(kind[:n] & _TAIL)
    tails = tails[~begins[tails]]
    last, lead = raw[tails - 1].astype(np.int64), raw[tails - 2].astype(np.int64)
    wide = (last >= 128) & (lead >= 0xC2) & (lead < 0xE0) & (tails > 1)
    latin = wide & LATIN[np.where(wide, (lead & 31) << 6 | last & 63, 0)]
    begins[found] = True
    begins[tails[((kind[tails - 1] & _ALNUM) > 0) | latin]] = True
    return np.flatnonzero(begins[:n])


def plain_words(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which pieces are a space and Latin letters."""
    before = np.concatenate([[0], flat[:-1]])
    lead = (flat >= 0xC3) & (flat <= 0xC9)
    held = (before >= 0xC3) & (before <= 0xC9) & ~((before == 0xC3) & ((flat == 0x97) | (flat == 0xB7)))
    odd = ~(((KINDS[flat] & _LETTER) > 0) | lead | held)
    sizes = np.diff(np.append(starts, len(flat)))
    return (flat[starts] == 32) & (np.add.reduceat(odd, starts, dtype=np.int64) == 1) & (sizes > 1)


class Encoder:
    """Token ids of texts by the tokenizers library, which sees each distinct piece once.

    A byte-level tokenizer splits a text before it merges; hence the ids of a text are those of its
    pieces (``cuts``) in turn. Pieces get numbers, a run of texts at once. Other tokenizers, and
    texts with the string of an added token, are encoded whole. A worker keeps the ids of ``KNOWN``
    pieces; beyond, those that came again stay if they are less than half.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shape = json.loads(self.tokenizer.to_str())
        split = shape["pre_tokenizer"] or {}
        self.by_piece = (
            shape["normalizer"] is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split["add_prefix_space"]
        )
        self.added = [t["content"] for t in shape["added_tokens"]]
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that begin a piece
        for token, number in self.tokenizer.get_vocab().items():
            self.begins[number] = token.startswith(("Ġ", "Ċ"))
        self.forget()

    def forget(self) -> None:
        self.words = Words()
        # of each number: its ids among all, and whether it came again
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.again = np.zeros(0, bool)

    @property
    def known(self) -> list[str]:
        """The pieces kept; an empty list or dict put there forgets all."""
        return [p.decode() for p in self.words]

    @known.setter
    def known(self, pieces: list | dict) -> None:
        if len(pieces):
            raise ValueError("pieces have no ids yet")
        self.forget()

    def many(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def rest(self) -> None:
        """Make room: what came again stays, unless that is much."""
        if self.words.size <= KNOWN and len(self.ids) <= IDS:
            return
        chosen, size = self.again, np.diff(self.at)
        if 2 * chosen.sum() > KNOWN or 2 * size[chosen].sum() > IDS:
            return self.forget()
        self.words.retain(chosen)
        self.ids = gather(self.ids, self.at[:-1][chosen], size[chosen])
        self.at = np.append(0, np.cumsum(size[chosen]))
        self.again = np.zeros(len(self.at) - 1, bool)

    def learn(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of new pieces, in the order of their numbers."""
        flat = gather(raw, starts, sizes)
        begins = np.cumsum(sizes) - sizes
        plain = plain_words(flat, begins)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # which pieces, their ids, how many
        which = np.flatnonzero(plain)
        others = [np.flatnonzero(~plain)]
        for at in range(0, len(which), JOINED):
            some = which[at : at + JOINED]
            ids, many = self.joined(gather(flat, begins[some], sizes[some]).tobytes().decode(), len(some))
            if ids is None:
                others.append(some)
            else:
                found.append((some, ids, many))
        held, ends = flat.tobytes(), begins + sizes
        left = np.concatenate(others)
        said = [held[a:b].decode() for a, b in zip(begins[left].tolist(), ends[left].tolist())]
        words = np.fromiter((s[0] == " " and s[1:].isalpha() for s in said), bool, len(said))
        for at in range(0, len(said), JOINED):
            run, simple, places = said[at : at + JOINED], words[at : at + JOINED], left[at : at + JOINED]
            ids, many = self.joined("".join(chosen_of(run, simple)), int(simple.sum()))
            if ids is None:
                simple = np.zeros(len(run), bool)
            else:
                found.append((places[simple], ids, many))
            each = self.many(list(chosen_of(run, ~simple)))
            many = np.fromiter(map(len, each), np.int64, len(each)) // 4
            found.append((places[~simple], _numbers(b"".join(each)), many))
        size = np.zeros(len(sizes), np.int64)
        order = np.concatenate([x[0] for x in found])
        size[order] = np.concatenate([x[2] for x in found])
        place = np.empty(len(sizes), np.int64)
        place[order] = np.cumsum(size[order]) - size[order]
        new = gather(np.concatenate([x[1] for x in found]), place, size)
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, new])
        self.again = np.concatenate([self.again, np.zeros(len(sizes), bool)])

    def joined(self, text: str, pieces: int) -> tuple[np.ndarray | None, np.ndarray]:
        """Ids of many words in one text, cut where a token begins with a space; None if that gives others."""
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        ids = np.array(found.ids, np.uint32)
        starts = np.flatnonzero(self.begins[ids])
        return ids if len(starts) == pieces else None, np.diff(np.append(starts, len(ids)))

    def tokens(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if not self.by_piece:
            return self.many(texts.to_pylist())
        odd = np.zeros(len(texts), bool)
        for a in self.added:
            odd |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        if odd.any():
            own = iter(self.many(texts.filter(pa.array(odd)).to_pylist()))
            others = iter(self.tokens(texts.filter(pa.array(~odd))))
            return [next(own if x else others) for x in odd.tolist()]
        self.rest()
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
        raw = padded(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]])
        offsets = offsets - offsets[0]
        starts = cuts(raw, offsets)
        sizes = np.diff(np.append(starts, offsets[-1]))
        number, first = self.words.numbers(raw, starts, sizes)
        old = len(self.again)
        if len(first):
            order = first[np.argsort(number[first])]
            self.learn(raw, starts[order], sizes[order])
        self.again[number[number < old]] = True
        size = (self.at[1:] - self.at[:-1])[number]
        out = gather(self.ids, self.at[number], size).tobytes()
        ends = np.append(0, np.cumsum(size))
        stops = (4 * ends[np.searchsorted(starts, offsets)]).tolist()
        return [out[a:b] for a, b in zip(stops, stops[1:])]


def gather(flat: np.ndarray, begins: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of ``flat``, one after the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(begins - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def runs_of(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Texts of a column in runs of about ``RUN`` bytes, each with its first row."""
    before = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(before // RUN)) + 1
    bounds = [0, *cuts.tolist(), len(column)]
    for a, b in zip(bounds, bounds[1:]):
        if a < b:
            yield a, column.slice(a, b - a)


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")


def frequent(seq: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, rank there, pairs): where pairs of symbols begin that occur at least so often.

    Pairs are ranked, the most frequent one first. Only pairs in buckets that are reached often
    enough are sorted; of two frequent pairs in a bucket the more frequent one is taken, and the
    other waits for a later round.
    """
    bucket = seq[:-1] * np.uint32(0x9E3779B1)
    bucket ^= seq[1:] * np.uint32(0x85EBCA77)
    bucket >>= np.uint32(32 - BUCKET_BITS)
    heavy = np.bincount(bucket, minlength=1 << BUCKET_BITS) >= threshold
    at = np.flatnonzero(heavy[bucket])
    keys, bucket = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1], bucket[at]
    ordered = np.sort(keys)
    ends = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], [True] * (len(ordered) > 0)))
    counts = np.diff(ends, prepend=-1)
    often = counts >= threshold
    pairs = ordered[ends[often]]
    pairs = pairs[np.lexsort((pairs, -counts[often]))]
    place = (pairs >> np.uint64(32)).astype(np.uint32) * np.uint32(0x9E3779B1)
    place ^= pairs.astype(np.uint32) * np.uint32(0x85EBCA77)
    place >>= np.uint32(32 - BUCKET_BITS)
    one = np.sort(np.unique(place, return_index=True)[1])
    pairs = pairs[one]
    if not len(pairs):
        return at[:0], at[:0], pairs
    of_bucket = np.zeros(1 << BUCKET_BITS, np.int32)
    of_bucket[place[one]] = np.arange(len(pairs))
    rank = of_bucket[bucket]
    true = pairs[rank] == keys
    return at[true], rank[true], pairs


def apart(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which positions to replace: better ranked than both neighbours, every other one of equal ones."""
    touches = at[1:] == at[:-1] + 1
    step = np.sign(rank[1:] - rank[:-1]) * touches
    best = np.ones(len(at), bool)
    best[1:] &= step <= 0
    best[:-1] &= step >= 0
    begins = np.arange(len(at))
    begins[1:][touches & (step == 0)] = 0
    return best & ((np.arange(len(at)) - np.maximum.accumulate(begins)) % 2 == 0)


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, symbols) of a pair grammar for ``ids``, which are all below ``base``."""
    seq = ids.astype(np.uint32)
    rules, lengths = [np.zeros((0, 2), np.uint32)], np.zeros(0, np.uint32)
    threshold = max(len(seq) >> 9, USES)
    while len(seq) > 1:
        at, rank, pairs = frequent(seq, threshold)
        chosen = apart(at, rank)
        at, rank = at[chosen], rank[chosen]
        used = np.bincount(rank, minlength=len(pairs)) >= USES
        worth = used[rank]
        at, rank = at[worth], rank[worth]
        number = (base + len(lengths) + np.cumsum(used) - 1).astype(np.uint32)
        made = pairs[used]
        pair = np.stack([made >> np.uint64(32), made & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        rules.append(pair)
        lengths = np.concatenate([lengths, sizes(pair, base, lengths).sum(1, dtype=np.uint32)])
        seq[at] = number[rank]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        done = threshold == USES and len(at) <= len(seq) >> GAIN
        seq = seq[keep]
        if done:
            break
        threshold = max(threshold // FALL, USES)
    return np.concatenate(rules), lengths, seq


def sizes(symbols: np.ndarray, base: int, lengths: np.ndarray) -> np.ndarray:
    """How many ids each symbol stands for."""
    deep = symbols >= base
    size = np.ones(symbols.shape, np.int64)
    size[deep] = lengths[symbols[deep] - base]
    return size


def expand(symbols: np.ndarray, base: int, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for: those of each rule are worked out once, then copied."""
    flat = np.arange(base, base + len(rules), dtype=np.uint32)
    while True:
        deep = flat >= base
        if not deep.any():
            break
        ends = np.cumsum(1 + deep)
        out = np.empty(ends[-1], np.uint32)
        pair = rules[flat[deep] - base]
        out[ends[~deep] - 1] = flat[~deep]
        out[ends[deep] - 2], out[ends[deep] - 1] = pair[:, 0], pair[:, 1]
        flat = out
    deep = symbols >= base
    size = sizes(symbols, base, lengths)
    ends = np.cumsum(size)
    if not len(ends):
        return symbols
    rule = symbols[deep] - base
    begins = (np.cumsum(lengths, dtype=np.int64) - lengths)[rule]
    out = np.empty(ends[-1], np.uint32)
    out[ends[~deep] - 1] = symbols[~deep]
    n = lengths[rule].astype(np.int64)
    held = np.ones(len(out), bool)
    held[ends[~deep] - 1] = False
    out[held] = gather(flat, begins, n)
    return out


def ids_between(symbols: np.ndarray, base: int, rules: np.ndarray, lengths: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of what symbols stand for; only symbols that hold them are expanded."""
    ends = np.cumsum(sizes(symbols, base, lengths))
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    before = int(ends[a - 1]) if a else 0
    return expand(symbols[a:b], base, rules, lengths)[start - before : stop - before]


def write(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    segment: int = SEGMENT,
) -> str:
    """Write the token ids of all documents as shards, in ascending order of ``id_col``; the path.

    ``tokenizer`` is a file that every executor can read; by default ``byte_bpe_50k.json`` of the
    installed public tokenizers. Without a path the files go to the shared folder and are dropped
    when the driver ends. Null and empty texts are the end id alone. Null ids come first, equal
    ids in any fixed order of their texts, repeated rows are documents each. Other columns are
    not read. An empty table gives files without shards.
    """
    spark = docs.sparkSession
    if path is None:
        path = scratch_path(spark, "shards")
        discard_on_exit(spark, path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    id_type = rows.schema["doc_id"].dataType.simpleString()
    part = "struct<n: bigint, base: int, rules: binary, lengths: binary, symbols: binary>"
    ddl = f"first long, n_ids long, docs array<struct<doc_id: {id_type}, n: bigint>>, segments array<{part}>"
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, table = vocabulary_path(tokenizer, "byte_bpe_50k.json"), kept("grammar")
        encoder = table.get(file)
        if encoder is None:
            encoder = table[file] = Encoder(file)
        base, end = max(len(encoder.begins), end_id + 1), array("I", [end_id]).tobytes()
        first, names, sizes, held, size = 0, [], [], [], 0

        def shard() -> pa.RecordBatch:
            ids = _numbers(b"".join(held))
            parts = []
            for at in range(0, len(ids), segment):
                rules, lengths, symbols = compress(ids[at : at + segment], base)
                parts.append(
                    {
                        "n": len(ids[at : at + segment]), "base": base, "rules": rules.tobytes(),
                        "lengths": lengths.tobytes(), "symbols": symbols.tobytes(),
                    }
                )
            listed = [{"doc_id": d, "n": n} for d, n in zip(names, sizes, strict=True)]
            return pa.RecordBatch.from_pylist(
                [{"first": first, "n_ids": len(ids), "docs": listed, "segments": parts}], schema=schema
            )

        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for at, texts in runs_of(batch.column(1)):
                for doc_id, raw in zip(ids_of[at:], encoder.tokens(texts)):
                    n = len(raw) // 4 + 1
                    if names and size + n > segment:
                        yield shard()
                        first, names, sizes, held, size = first + size, [], [], [], 0
                    names.append(doc_id)
                    sizes.append(n)
                    held += (raw, end)
                    size += n
        if names:
            yield shard()

    # one file per task: the ids before a shard are counted in its file
    shards = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, ddl)
    shards.write.option("maxRecordsPerFile", 0).parquet(path)
    return path


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a folder, with ``start``: the ids of all documents before them."""
    # files are named part-<task>-…, in the order of their ranges
    task = F.substring_index(F.substring("_metadata.file_name", 6, 20), "-", 1).cast("long")
    table = spark.read.parquet(path).withColumn("file", task)
    start, starts = 0, []
    for file, n in sorted(table.groupBy("file").agg(F.sum("n_ids")).collect()):  # one row per file
        starts.append((file, start))
        start += n
    offsets = spark.createDataFrame(starts, "file long, before long")
    return table.join(F.broadcast(offsets), "file").withColumn("start", F.col("before") + F.col("first")).drop("before")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the files.

    ``start`` is the number of ids before it, ``ids`` are little-endian unsigned 32-bit numbers.
    """
    table = shards(spark, path).select("start", "docs", "segments")
    id_type = table.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    ddl = f"doc_id {id_type}, start long, n_tokens long, ids binary"
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = []
                for s in batch.column(2)[i]:
                    rules, lengths, symbols = (_numbers(s[n].as_py()) for n in ("rules", "lengths", "symbols"))
                    found.append(expand(symbols, s["base"].as_py(), rules.reshape(-1, 2), lengths).tobytes())
                raw = b"".join(found)
                names, sizes = batch.column(1)[i].values.flatten()
                n = sizes.to_numpy()
                ends = np.cumsum(n)
                begins = ends - n
                ids = [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                start = begins + batch.column(0)[i].as_py()
                yield pa.RecordBatch.from_arrays([names, pa.array(start), sizes, pa.array(ids, pa.binary())], schema=schema)

    return table.mapInArrow(run, ddl)


def read_between(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of the whole corpus, from the shards that hold them alone."""
    inside = shards(spark, path).filter((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    found = []
    for row in inside.orderBy("start").select("start", "segments").toLocalIterator():
        at = row["start"]
        for s in row["segments"]:
            a, b = max(start - at, 0), min(stop - at, s["n"])
            if a < b:
                rules = _numbers(s["rules"]).reshape(-1, 2)
                found.append(ids_between(_numbers(s["symbols"]), s["base"], rules, _numbers(s["lengths"]), a, b))
            at += s["n"]
    return np.concatenate([np.zeros(0, np.uint32), *found])
