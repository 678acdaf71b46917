"""Packing of tokenised documents into sequences: first-fit decreasing with a tournament tree of bin capacities.

Texts are tokenised in Python on Arrow batches and cut into pieces: full pieces of the capacity and one rest. Pieces
are dealt to randomised groups by a hash of id, row and place, about `group_docs` documents to a group, and sorted by
falling length inside their group; neither a huge text nor rows that repeat fill one group. Each group is packed by itself as its pieces stream by: the leftmost bin with room is
found by descending a tree that holds the greatest free capacity below each node, so a step costs the logarithm of the
bins, and memory holds the tree, not the pieces. A group's bins are numbered from group * 2^32.

Ids: those of the `tokenizers` library for the given file, special tokens not added, then `end_id`. Where a text has
only characters for which the two libraries are tested to agree and not the text of a special token, the same vocabulary
is applied by `tiktoken`, which is several times faster.

Defined cases: a null text is empty and has the end id alone. A text of any length is tokenised whole. Rows that repeat
an id are documents of their own; a null id is carried. Ties in length are ordered by id and start. An empty table gives
an empty result. Only id and text are read from docs, so further columns don't matter. docs should be a table: rows are
told apart by their place in it, which must be the same when a lost task runs again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugery.ship import ship, tidy

CAPACITY = 2048
END_ID = 1
GROUP_DOCS = 1024
SEED = 41
#: Split of a text into pieces by byte-level vocabularies, as published with them.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these characters texts go to `tokenizers` itself.
PLAIN_CHARS = "\\x00-\\u024f\\u2010-\\u2027\\u20ac"
_beyond = re.compile(f"[^{PLAIN_CHARS}]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """ids(text) of a tokenizer file of the `tokenizers` library, as a numpy array."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        special = [x["content"] for x in said.get("added_tokens") or ()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.fast = self._fast(said, set(special))

    @staticmethod
    def _fast(said: dict, special: set[str]):
        """The same vocabulary by ranks, or None if the file says anything that ranks can't."""
        split, model = said.get("pre_tokenizer") or {}, said["model"]
        if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or said.get("normalizer"):
            return None
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
            return None
        # Ranks are merges only if every merged token comes by one merge, and later merges have greater ids.
        of, vocab = byte_letters(), model["vocab"]
        merged = [vocab.get("".join(x.split(" ") if isinstance(x, str) else x), -1) for x in model["merges"]]
        letters = {i for word, i in vocab.items() if word in of}
        if any(a >= b for a, b in zip([max(letters, default=-1), *merged], merged, strict=False)) or {i for w, i in vocab.items() if w not in special} != letters | set(merged) or len(letters) < 256:
            return None
        import tiktoken

        ranks = {bytes(of[c] for c in word): i for word, i in vocab.items() if word not in special}
        return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or (not text.isascii() and _beyond.search(text)) or (self.special and self.special.search(text)):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


def vocabulary_size(path: str) -> int:
    """One more than the greatest id of a tokenizer file; an encoder, which takes more memory, isn't made for that."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    vocab = said["model"]["vocab"]
    ids = vocab.values() if isinstance(vocab, dict) else range(len(vocab))
    return 1 + max([*ids, *(x["id"] for x in said.get("added_tokens") or ())])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _cutter(path: str, capacity: int, end_id: int, narrow: bool, groups: int):
    kind = np.uint16 if narrow else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows, bytes_held = ([], [], [], [], [], []), 0
            names = ["group", "id", "start", "length", "doc_tokens", "ids"]
            for group, own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.append(enc.ids(text or ""), np.uint32(end_id)).astype(kind)
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    # A text's pieces go to neighbouring groups.
                    for column, x in zip(rows, ((group + start // capacity) % groups, own, start, len(piece), len(ids), piece.tobytes()), strict=True):
                        column.append(x)
                    bytes_held += piece.nbytes
                if bytes_held > 16 << 20:
                    yield _pieces(rows, names, batch.column(1).type)
                    rows, bytes_held = ([], [], [], [], [], []), 0
            if rows[0]:
                yield _pieces(rows, names, batch.column(1).type)

    return run


def _pieces(rows: tuple, names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    types = (pa.int64(), id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=names)


class Bins:
    """First fit: a tournament tree over bins whose nodes hold the greatest free capacity below them."""

    def __init__(self, capacity: int, leaves: int = 1024):
        self.capacity, self.leaves = capacity, leaves
        self.tree = [capacity] * (2 * leaves)

    def _grow(self) -> None:
        old, n = self.tree[self.leaves :], self.leaves
        self.leaves *= 2
        self.tree = [self.capacity] * (2 * self.leaves)
        self.tree[self.leaves : self.leaves + n] = old
        for i in range(self.leaves - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) of the leftmost bin with room; takes the room."""
        tree = self.tree
        if tree[1] < length:
            self._grow()
            tree = self.tree
        i = 1
        while i < self.leaves:
            i *= 2
            if tree[i] < length:
                i += 1
        offset = self.capacity - tree[i]
        tree[i] -= length
        found = i - self.leaves
        i //= 2
        while i:
            most = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == most:
                break
            tree[i] = most
            i //= 2
        return found, offset


def _packer(capacity: int, narrow: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bins = None, Bins(capacity)
        for batch in batches:
            sequences, offsets = [], []
            for group, length in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if group != at:
                    at, bins = group, Bins(capacity)
                b, offset = bins.place(length)
                sequences.append((group << 32) + b)
                offsets.append(offset)
            ids = batch.column(5)
            if narrow:
                ids = pa.array([np.frombuffer(x, np.uint16).astype("<u4").tobytes() for x in ids.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(1, 5)), ids, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())],
                names=["id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, group_docs: int = GROUP_DOCS, seed: int = SEED
) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, ids (binary, little-endian unsigned 32-bit), sequence_id, offset.

    tokenizer: path of a file of the `tokenizers` library, on every machine. At scale docs should be a table, as it is
    counted once to set the number of groups.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    groups = max(1, -(-docs.count() // group_docs))
    narrow = max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16
    text = F.coalesce(F.col(text_col), F.lit(""))
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)).cast("bigint")
    pieces = docs.select(drawn.alias("group"), F.col(id_col).alias("id"), text.alias("text")).mapInArrow(
        tidy(_cutter(tokenizer, capacity, end_id, narrow, groups)), f"group long, id {id_type}, start long, length long, doc_tokens long, ids binary"
    )
    dealt = pieces.repartition("group").sortWithinPartitions("group", F.col("length").desc(), "id", "start")
    packed = dealt.mapInArrow(tidy(_packer(capacity, narrow)), f"id {id_type}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
