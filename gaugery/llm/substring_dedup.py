"""Substring deduplication by content-defined chunking with a gear rolling hash.

Texts are cut where the rolling hash of the last 32 bytes has `bits` zero bits, at least `least` and at most `most`
bytes after the cut before, never inside a character. Cuts depend on the bytes near them only, so an insertion shifts
no cut but its neighbours, and the same passage gives the same chunks wherever it stands. Chunks are known by 96 bits of
a digest. A chunk is repeated if two documents or more hold it (with inside=True, if it stands twice anywhere), and a
run of repeated chunks that follow each other in a text counts if it has at least `least_words` words.

Chunks at the ends of a shared passage differ, so a short passage may have no such run. Shingles of `least_words` whole
words (17 at least) go with the chunks therefore: of any neighbouring shingles that make up SURE words the one with the
least hash is taken. The hash is the gear's at the shingle's end and so depends on bytes inside it alone: two texts that
share SURE words or more, byte by byte, take the same shingle there. A repeated shingle counts as it stands.

Stretches of a run whose chunks all occur first elsewhere, by id and place, aren't kept if they have `least_words` words,
nor are shingles that occur first elsewhere. What is left of runs and shingles is kept where it holds first occurrences,
so that no text is lost from the corpus: what goes stands earlier. Overlapping parts of one kind are one passage.

1. Block: texts are chunked once, about `held` bytes to a block. A block's digests, each once with its number, its first
   place and whether two documents have it, and the places of its chunks are written as packed arrays, one row a block.
2. Count: slices of the sorted digests of blocks go to the bucket of their range, about `cell` digests to each; blocks that
   make up `gather` digests are sliced together, so that slices don't get thin. A bucket finds which are repeated, how
   often, and in which block they occur first. A digest comes once from a block, however often it stands there, so a
   frequent chunk is as many entries as there are blocks.
3. Judge: only numbers and first marks of repeated digests go back to their block, which has all chunks of its texts and
   puts passages together. Neither texts nor single chunks are shuffled, and no text is needed a second time.

Defined cases: a null or empty text has no chunks. A row's passages are its own, whether its id repeats or not: rows with
one id count as one document when documents are counted, and rows with equal id and text are judged alike. Rows with a
null id are documents of their own unless their texts are equal, and never keep against a row with an id. Without
`inside`, what is repeated inside one document alone isn't a repeated passage. Texts are read whole; a text longer than
`held` is a block of its own. Other columns are carried by `deduplicate`, and are not read else. Empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugery.llm.common import flagged, materialise
from gaugery.ship import ship, tidy

BITS = 5
LEAST = 16
MOST = 160
LEAST_WORDS = 24
#: Passages of so many words that two documents share are found without fail.
SURE = 51
#: Bytes of text in a block, digests in a bucket, and digests that are sliced at once, about.
HELD = 4 << 20
CELL = 400_000
GATHER = 2_000_000
#: Digests that a slice should have on average at least.
SLICE = 16
#: One 32-bit number for each byte, from a fixed seed.
GEAR = np.random.default_rng(1976).integers(0, 1 << 32, 256, np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: the sum over the last 32 bytes of GEAR[byte] shifted by the distance."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        moved = h[:-step] << np.uint32(step)
        h[step:] += moved
    return h


def cuts(data: bytes, bits: int = BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks, the last being the length."""
    n = len(data)
    if not n:
        return []
    a = np.frombuffer(data, np.uint8)
    starts = np.ones(n, bool)  # where a character begins
    starts[:] = (a & 0xC0) != 0x80
    zero = (gear(a) >> np.uint32(32 - bits)) == 0
    ends = np.flatnonzero(zero[:-1] & starts[1:]) + 1
    found, last = [], 0
    for e in [*ends.tolist(), n]:
        while e - last > most:
            at = last + most
            while at > last + 1 and not starts[at]:
                at -= 1
            found.append(at)
            last = at
        if e - last >= least or e == n:
            if e > last:
                found.append(e)
            last = e
    return found


def word_edges(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end, in bytes."""
    blank = np.ones(len(a) + 2, bool)
    blank[1:-1] = (a == 32) | ((a >= 9) & (a <= 13))
    return np.flatnonzero(blank[:-2] & ~blank[1:-1]), np.flatnonzero(~blank[1:-1] & blank[2:]) + 1


def shingles(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, least_words: int = LEAST_WORDS) -> list[int]:
    """First words of the shingles that are taken; a shingle has max(least_words, 17) words, so 32 bytes at least."""
    size = max(least_words, 17)
    near = max(SURE, size) - size + 1
    if len(starts) < size + near - 1:
        return []
    h = gear(a)[ends[size - 1 :] - 1]
    least = np.lib.stride_tricks.sliding_window_view(h, near).argmin(axis=1)
    return np.unique(least + np.arange(len(least))).tolist()


def planes(a: np.ndarray) -> bytes:
    """An array's first bytes, then its second bytes, and so on: small numbers become runs of zeros, which pack well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


class Entries(NamedTuple):
    """Digests of a block, sorted and each once: two parts of it; owner (a document's id, or of a null id a digest of the
    text), whether the id is null, and place of the first occurrence; whether two documents have it; how often it stands."""

    high: np.ndarray
    low: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    n: np.ndarray
    null: np.ndarray
    many: np.ndarray

    def pack(self) -> bytes:
        return b"".join((planes(self.high), planes(self.low), planes(self.owner), planes(self.place), planes(self.n), np.packbits(np.concatenate((self.null, self.many))).tobytes()))

    @classmethod
    def unpack(cls, data: bytes, size: int) -> Entries:
        at, out = 0, []
        for kind, width in ((np.uint64, 8), (np.uint32, 4), (np.int64, 8), (np.int32, 4), (np.int32, 4)):
            out.append(unplanes(data[at : at + width * size], kind))
            at += width * size
        bits = np.unpackbits(np.frombuffer(data[at:], np.uint8), count=2 * size).astype(bool)
        return cls(*out, bits[:size], bits[size:])

    def part(self, a: int, b: int) -> Entries:
        return Entries(*(x[a:b] for x in self))

    @classmethod
    def join(cls, parts: list[Entries]) -> Entries:
        return cls(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def grouped(e: Entries) -> tuple[Entries, np.ndarray, np.ndarray]:
    """Entries sorted and each digest once, the number of each given entry's digest, and whether the entry is a first one."""
    size = len(e.high)
    order = np.argsort(e.high, kind="stable")
    high = e.high[order]
    twin = np.zeros(size, bool)
    if size > 1:
        same = high[1:] == high[:-1]
        twin[1:] |= same
        twin[:-1] |= same
    # Few entries share a digest with another: only those are put in order by all that counts.
    at = np.flatnonzero(twin)
    some = order[at]
    order[at] = some[np.lexsort((e.place[some], e.owner[some], e.null[some], e.low[some], e.high[some]))]
    s = Entries(*(x[order] for x in e))
    head = np.ones(size, bool)
    head[1:] = (s.high[1:] != s.high[:-1]) | (s.low[1:] != s.low[:-1])
    first = np.flatnonzero(head)
    number = np.cumsum(head) - 1
    lead = first[number]
    many = s.many | (s.null != s.null[lead]) | (s.owner != s.owner[lead])
    out = Entries(s.high[first], s.low[first], s.owner[first], s.place[first], _sums(s.n, first), s.null[first], _sums(many, first) > 0)
    numbers, firsts = np.empty(size, np.int32), np.empty(size, bool)
    numbers[order] = number
    firsts[order] = (s.null == s.null[lead]) & (s.owner == s.owner[lead]) & (s.place == s.place[lead])
    return out, numbers, firsts


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums from each place of first to the next, as 32-bit numbers that end at their limit."""
    return np.minimum(np.add.reduceat(x, first, dtype=np.int64), (1 << 31) - 1).astype(np.int32) if len(x) else np.zeros(0, np.int32)


class _Block:
    """Texts and their chunks and shingles, gathered."""

    def __init__(self) -> None:
        self.bytes, self.docs, self.digests, self.spans = 0, [], [], []

    def add(self, own: int | None, data: bytes, row: bytes, bits: int, least: int, most: int, least_words: int) -> None:
        size = max(least_words, 17)
        a = np.frombuffer(data, np.uint8)
        starts, ends = word_edges(a)
        found = np.array(cuts(data, bits, least, most), np.int32)
        heads = np.concatenate((np.zeros(1, np.int32), found[:-1]))
        # A chunk's first word is the one that its start lies in or before; parts of words count.
        word = np.searchsorted(ends, heads, "right")
        words = np.maximum(np.searchsorted(starts, found, "left") - word, 0)
        taken = np.array(shingles(a, starts, ends, least_words), np.int64)
        s_start, s_end = starts[taken], ends[taken + size - 1]
        self.digests += [xxhash.xxh3_128_digest(data[x:y]) for x, y in zip(heads.tolist(), found.tolist(), strict=True)]
        self.digests += [xxhash.xxh3_128_digest(data[x:y], 1) for x, y in zip(s_start.tolist(), s_end.tolist(), strict=True)]
        self.docs.append((own, row, len(found), len(taken)))
        self.spans.append(np.array([np.concatenate(x) for x in ((heads, s_start), (found, s_end), (word, taken), (words, np.full(len(taken), size)))], np.int32))
        self.bytes += len(data)

    def row(self, block: int) -> tuple:
        ids = [own for own, *_ in self.docs]
        sizes = np.array([x[2:] for x in self.docs], np.int32)
        each = sizes.sum(axis=1)
        null = np.array([x is None for x in ids])
        owner = np.array([int.from_bytes(row[:8], "little", signed=True) if x is None else x for x, row, *_ in self.docs], np.int64)
        spans = np.concatenate(self.spans, axis=1)
        place = np.concatenate([np.concatenate((np.arange(x[2]), s[2, x[2] :])) for x, s in zip(self.docs, self.spans, strict=True)]).astype(np.int32)
        digests = np.frombuffer(b"".join(self.digests), np.uint64).reshape(-1, 2)
        one = np.ones(len(place), np.int32)
        entries = Entries(digests[:, 0].copy(), (digests[:, 1] >> np.uint64(32)).astype(np.uint32), np.repeat(owner, each), place, one, np.repeat(null, each), np.zeros(len(place), bool))
        entries, numbers, firsts = grouped(entries)
        start, end, word, words = spans
        gaps = start.copy()
        gaps[1:] -= end[:-1]
        steps = np.diff(word, prepend=np.int32(0))
        packed = b"".join((*map(planes, (gaps, end - start, steps.astype(np.int32), words, numbers)), np.packbits(firsts).tobytes()))
        return block, ids, b"".join(x[1] for x in self.docs), sizes.tobytes(), len(entries.high), entries.pack(), packed


_BLOCKS = "block long, ids array<long>, rows binary, sizes binary, digests long, entries binary, spans binary"


def _chunker(bits: int, least: int, most: int, least_words: int, held: int):
    types = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                if not data:
                    continue
                block.add(own, data, hashlib.md5(data, usedforsecurity=False).digest(), bits, least, most, least_words)
                if block.bytes >= held:
                    yield batch_of([block.row(at)])
                    at, block = at + 1, _Block()
        if block.docs:
            yield batch_of([block.row(at)])

    return run


def chunk(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, least: int = LEAST, most: int = MOST, least_words: int = LEAST_WORDS, held: int = HELD
) -> DataFrame:
    """One row per block of texts: their ids and MD5 digests, and packed arrays of their chunks and shingles. To be written
    before it is used, as blocks are numbered by the task that makes them."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(_chunker(bits, least, most, least_words, held)), _BLOCKS)


def _slicer(buckets: int, gather: int):
    """From (block, digests, entries), the entries of each range of digests, of all blocks that make up about `gather` of them:
    (bucket, blocks, bases, sizes, entries), where bases are the numbers in their blocks from which the sizes count."""
    edges = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)
    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    names = ["bucket", "first", "blocks", "bases", "sizes", "entries"]

    def sliced(held: list[tuple[int, Entries]]) -> Iterator[pa.RecordBatch]:
        blocks = np.array([block for block, _ in held], np.int64)
        cut = np.array([[0, *np.searchsorted(e.high, edges, "left").tolist(), len(e.high)] for _, e in held], np.int64)
        sizes = np.diff(cut, axis=1)
        joined = Entries.join([e for _, e in held])
        # By bucket, then by block.
        order = np.argsort(np.concatenate([np.repeat(np.arange(buckets), n) for n in sizes]), kind="stable")
        joined = Entries(*(x[order] for x in joined))
        ends = np.cumsum(sizes.sum(axis=0))
        some = np.flatnonzero(sizes.sum(axis=0))
        for i in range(0, len(some), 1000):
            rows = []
            for k in some[i : i + 1000].tolist():
                at = np.flatnonzero(sizes[:, k])
                part = joined.part(int(ends[k] - sizes[:, k].sum()), int(ends[k]))
                rows.append((k, int(blocks[at[0]]), planes(blocks[at]), planes(cut[at, k].astype(np.int32)), planes(sizes[at, k].astype(np.int32)), part.pack()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for block, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((block, Entries.unpack(data, n)))
                size += n
                if size >= gather:
                    yield from sliced(held)
                    held, size = [], 0
        if held:
            yield from sliced(held)

    return run


def _counter(inside: bool, cell: int):
    """Of slices sorted by bucket, what goes back to each block: (block, numbers, copies, firsts) of its repeated digests.

    A bucket with far more than `cell` digests is unpacked and counted by ranges, one after the other.
    """

    def counted(slices: list[tuple[int, int, int]], entries: Entries) -> Iterator[tuple]:
        total, number, first = grouped(entries)
        again = (total.n > 1 if inside else total.many)[number]
        at = 0
        for block, base, size in slices:
            own = np.flatnonzero(again[at : at + size])
            if len(own):
                yield block, planes((own + base).astype(np.int32)), planes(total.n[number[at + own]]), np.packbits(first[at + own]).tobytes()
            at += size

    def told(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        known = [(unplanes(blocks, np.int64).tolist(), unplanes(bases, np.int32).tolist(), unplanes(sizes, np.int32).tolist(), data) for _, _, blocks, bases, sizes, data in rows]
        whole = sum(sum(sizes) for _, _, sizes, _ in known)
        ranges = -(-whole // (4 * cell))
        low = high = None
        if ranges > 1:
            ends = [(int(e.high.min()), int(e.high.max())) for e in (Entries.unpack(data, sum(sizes)) for _, _, sizes, data in known)]
            low, high = min(x for x, _ in ends), max(x for _, x in ends)
        for k in range(ranges):
            slices, parts = [], []
            for blocks, bases, sizes, data in known:
                e, at = Entries.unpack(data, sum(sizes)), 0
                for block, base, size in zip(blocks, bases, sizes, strict=True):
                    a, b = 0, size
                    if ranges > 1:
                        edges = [low + -(-(high + 1 - low) * j // ranges) for j in (k, k + 1)]
                        a, b = (size if x > high else int(np.searchsorted(e.high[at : at + size], np.uint64(x), "left")) for x in edges)
                    if a < b:
                        slices.append((block, base + a, b - a))
                        parts.append(e.part(at + a, at + b))
                    at += size
            found = list(counted(slices, Entries.join(parts))) if parts else []
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "numbers", "copies", "firsts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and row[0] != rows[0][0]:
                    yield from told(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from told(rows)

    return run


class _Part(NamedTuple):
    shingle: bool
    mine: bool
    a: int
    b: int
    start: int
    end: int
    word: int
    word_end: int
    words: int
    chunks: int
    copies: int


def _union(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (start, end, words) that overlap or touch as one, with the most words of any."""
    out: list[tuple[int, int, int]] = []
    for start, end, n in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), max(n, out[-1][2]))
        else:
            out.append((start, end, n))
    return out


def _without(spans: list[tuple[int, int, int]], gone: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """What gone leaves of spans, both unions; words are 0 where something was taken."""
    at = 0
    for start, end, n in spans:
        while at < len(gone) and gone[at][1] <= start:
            at += 1
        last, k = start, at
        while k < len(gone) and gone[k][0] < end:
            if gone[k][0] > last:
                yield last, gone[k][0], 0
            last, n, k = gone[k][1], 0, k + 1
        if last < end:
            yield last, end, n


def _judged(parts: list[_Part], least_words: int) -> list[tuple]:
    """The passages of one text from its parts, which come by shingle and place."""
    runs: list[list[list[_Part]]] = []  # runs of stretches of parts
    reach = -2
    gone, held, used = [], [], []
    for x in parts:
        if x.shingle:
            (held if x.mine else gone).append((x.start, x.end, x.word_end - x.word))
            used.append(x)
        elif x.a > reach + 1:
            runs.append([[x]])
            reach = x.b
        else:
            if runs[-1][-1][0].mine == x.mine:
                runs[-1][-1].append(x)
            else:
                runs[-1].append([x])
            reach = max(reach, x.b)
    for run in runs:
        n = sum(x.words for part in run for x in part)
        if n < least_words:
            continue
        used += [x for part in run for x in part]
        if any(part[0].mine for part in run):
            held.append((min(part[0].start for part in run), max(x.end for part in run for x in part), n))
        for part in run:
            n = sum(x.words for x in part)
            if not part[0].mine and n >= least_words:
                gone.append((min(x.start for x in part), max(x.end for x in part), n))
    if not used:
        return []
    first, last = {}, {}  # the words at the edges
    for x in used:
        first[x.start] = min(x.word, first.get(x.start, x.word))
        last[x.end] = max(x.word_end, last.get(x.end, 0))
    out = []
    gone = _union(gone)
    for kept, spans in ((False, gone), (True, list(_without(_union(held), gone)))):
        counts = [[0, 0, 0] for _ in spans]
        ends = [end for _, end, _ in spans]
        for x in used:
            k = bisect_right(ends, x.start)
            while (kept or not x.mine) and k < len(spans) and spans[k][0] < x.end:
                c = counts[k]
                c[0], c[1], c[2] = c[0] + x.chunks, min(c[1] or x.copies, x.copies), c[2] + x.chunks * x.mine
                k += 1
        for (start, end, n), c in zip(spans, counts, strict=True):
            n = max(n, last.get(end, first.get(end, 0)) - first.get(start, last.get(start, 0)))
            if n >= least_words:
                out.append((start, end, n, *c, kept))
    return out


def _unspanned(data: bytes, size: int) -> tuple[np.ndarray, ...]:
    gaps, lengths, steps, words, numbers = (unplanes(data[4 * size * i : 4 * size * (i + 1)], np.int32) for i in range(5))
    first = np.unpackbits(np.frombuffer(data[20 * size :], np.uint8), count=size).astype(bool)
    end = np.cumsum(gaps.astype(np.int64) + lengths)
    return end - lengths, end, np.cumsum(steps), words, numbers, first


def _passages_of(ids: list, rows: bytes, sizes: bytes, digests: int, spans: bytes, told: list[tuple], least_words: int) -> list[tuple]:
    """The passages of a block: its own row and what came back to it."""
    sizes = np.frombuffer(sizes, np.int32).reshape(-1, 2)
    each = sizes.sum(axis=1)
    total = int(each.sum())
    start, end, word, words, number, first = _unspanned(spans, total)
    copies, leads = np.zeros(digests, np.int32), np.zeros(digests, bool)
    for numbers, n, firsts in told:
        at = unplanes(numbers, np.int32)
        copies[at] = unplanes(n, np.int32)
        leads[at] = np.unpackbits(np.frombuffer(firsts, np.uint8), count=len(at)).astype(bool)
    doc, begin = np.repeat(np.arange(len(sizes)), each), np.cumsum(each) - each
    inner = np.arange(total) - begin[doc]
    shingle = inner >= sizes[doc, 0]
    place = np.where(shingle, word, inner)
    again = np.flatnonzero(copies[number] > 0)
    if not len(again):
        return []
    mine = (first & leads[number])[again]
    d, s, p = doc[again], shingle[again], place[again]
    # Runs of neighbours that are all first occurrences or none.
    head = np.ones(len(again), bool)
    head[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (mine[1:] != mine[:-1]) | (p[1:] != p[:-1] + 1)
    a = np.flatnonzero(head)
    b = np.append(a[1:], len(again)) - 1
    most = lambda x: np.maximum.reduceat(x[again], a)
    columns = s[a], mine[a], p[a], p[b], start[again][a], most(end), word[again][a], most(word + words), np.add.reduceat(words[again], a), b - a + 1, np.minimum.reduceat(copies[number[again]], a)
    parts, out = list(map(_Part._make, zip(*(x.tolist() for x in columns), strict=True))), []
    edges = [*np.flatnonzero(np.diff(d[a], prepend=-1)).tolist(), len(a)]
    for x, y in zip(edges, edges[1:], strict=False):
        i = int(d[a[x]])
        out += [(ids[i], *found, rows[16 * i : 16 * (i + 1)].hex()) for found in _judged(parts[x:y], least_words)]
    return out


def _joiner(least_words: int):
    """Rows by block, the block's own first: (block, ids, rows, sizes, digests, spans, numbers, copies, firsts)."""
    names = ["id", "start", "end", "words", "chunks", "copies", "first_chunks", "kept", "text_md5"]
    types = [*[pa.int64()] * 7, pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, told = None, []

        def done() -> pa.RecordBatch:
            rows = _passages_of(*own[1:6], told, least_words) if own and told else []
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), types, strict=True)], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or row[0] != own[0]:
                    yield done()
                    own, told = row, []
                else:
                    told.append(row[6:])
        yield done()

    return run


def passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = BITS,
    least: int = LEAST,
    most: int = MOST,
    least_words: int = LEAST_WORDS,
    inside: bool = False,
    held: int = HELD,
    cell: int = CELL,
    gather: int = GATHER,
) -> DataFrame:
    """One row per repeated passage of a text: id, start and end (bytes), words, chunks (and shingles), copies (occurrences of
    its rarest chunk), first_chunks (how many of them occur here first), kept, and text_md5, by which rows that repeat an id
    are told apart."""
    # Rows of megabytes, whose values don't repeat: small row groups without dictionaries keep writers small.
    chunked = chunk(docs, id_col, text_col, bits, least, most, least_words, held)
    blocks = materialise(chunked, "chunks", parquet_block_size=str(16 << 20), parquet_enable_dictionary="false")
    digests = blocks.agg(F.sum("digests")).first()[0] or 0
    # A slice should have a good many digests, so beyond a terabyte of text buckets grow, and are counted by ranges; a greater
    # `gather` takes more memory and keeps them small.
    buckets = max(min(-(-digests // cell), gather // SLICE), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sliced = blocks.select("block", "digests", "entries").mapInArrow(tidy(_slicer(buckets, gather)), "bucket int, first long, blocks binary, bases binary, sizes binary, entries binary")
    told = sliced.repartition("bucket").sortWithinPartitions("bucket", "first").mapInArrow(tidy(_counter(inside, cell)), "block long, numbers binary, copies binary, firsts binary")
    own = blocks.select("block", "ids", "rows", "sizes", "digests", "spans")
    rows = own.unionByName(told, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("sizes").isNull())
    out = rows.mapInArrow(tidy(_joiner(least_words)), "id long, start long, end long, words long, chunks long, copies long, first_chunks long, kept boolean, text_md5 string")
    return out.withColumnRenamed("id", id_col)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the passages that aren't kept, all other columns as they were; a text may become empty.

    Texts find their passages by id and MD5 digest, so that rows which repeat an id lose none but their own.
    """
    gone = passages(docs, id_col, text_col, **options).filter(~F.col("kept"))
    gone = gone.groupBy(F.col(id_col).alias("__g_id"), F.col("text_md5").alias("__g_md5")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__g_gone"))
    gone = materialise(gone, "chunk-gone")
    some = F.coalesce(F.col(id_col).cast("bigint"), F.lit(0).cast("bigint"))
    ids = gone.select(F.coalesce("__g_id", F.lit(0).cast("bigint")).alias("__g_some"))
    touched = flagged(docs, some, ids)
    touched = touched.join(gone, F.col(id_col).cast("bigint").eqNullSafe(F.col("__g_id")) & (F.md5(F.col(text_col).cast("binary")) == F.col("__g_md5")), "left")
    rest = flagged(docs, some, ids, how="left_anti")
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if text and spans:
                    data, last, parts = text.encode("utf-8", "surrogatepass"), 0, []
                    for x in spans:
                        parts.append(data[last : x["start"]])
                        last = x["end"]
                    text = b"".join([*parts, data[last:]]).decode("utf-8", "surrogatepass")
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    cut = touched.select(*[f"`{c}`" for c in names], "__g_gone").mapInArrow(tidy(run), docs.schema)
    return cut.unionByName(rest)
