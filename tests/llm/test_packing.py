import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from gaugery.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(exact, text):
    return np.array(exact.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def holds(rows, texts, exact):
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for i, mine in pieces.items():
        ids, at = ids_of(exact, texts[i]), 0
        for r in sorted(mine, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and 0 < r["length"] <= 2048
            assert bytes(r["ids"]) == ids[at : at + r["length"]].tobytes()
            at += r["length"]
        assert at == len(ids)
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_pieces_hold_each_id_once(spark, exact):
    r = random.Random(1)
    texts = {i: " ".join(r.choice(["the", "ünd", "été", "x1y", "\n", "  "]) for _ in range(r.randrange(900))) for i in range(80)}
    texts |= {100: None, 101: "", 102: "日本語 и <|endoftext|> ​", 103: "a<|endoftext|>b", 104: "long " * 60_000, 105: "x" * 5000}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, ids int")
    holds(packing.pack(docs, PATH, group_docs=20).collect(), texts, exact)


def test_empty_table_nulls_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert packing.pack(docs, PATH).count() == 3
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_hot_rows_and_huge_texts_are_dealt_to_many_groups(spark):
    docs = spark.createDataFrame([(1, "same text")] * 400 + [(2, "x y " * 200_000)], "doc_id long, text string")
    rows = packing.pack(docs, PATH, group_docs=10).collect()
    groups = lambda i: {r["sequence_id"] >> 32 for r in rows if r["doc_id"] == i}
    assert len(groups(1)) > 30 and len(groups(2)) > 30


def test_files_that_ranks_cannot_express_go_to_the_exact_encoder(tmp_path):
    import json

    said = json.loads(open(PATH, encoding="utf-8").read())
    assert packing.Encoder(PATH).fast is not None
    changes = [("ignore_merges", True), ("dropout", 0.1), ("end_of_word_suffix", "</w>"), ("continuing_subword_prefix", "##")]
    odd = [said | {"model": said["model"] | {k: v}} for k, v in changes]
    odd += [said | {"pre_tokenizer": said["pre_tokenizer"] | {"use_regex": False}}, said | {"model": said["model"] | {"merges": said["model"]["merges"][1:]}}, said | {"model": said["model"] | {"merges": said["model"]["merges"][::-1]}}]
    assert all(packing.Encoder._fast(x, {"<|endoftext|>"}) is None for x in odd)


def test_query_digests_and_padding(spark, sf_dir, exact):
    rows = queries.op1_packing(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").collect()}
    used = {}
    for r in rows:
        ids = ids_of(exact, texts[r["doc_id"]])[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert sum(2048 - n for n in used.values()) < 0.02 * 2048 * len(used)


def test_fast_path_agrees_on_every_plain_character(exact):
    enc = packing.Encoder(PATH)
    plain = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC] if not packing._beyond.search(chr(c))]
    for c in plain:
        for text in (c, f"a{c}b", f" {c} 1", f"{c}{c}\n{c}", f"'{c}s {c}'ll"):
            assert enc.fast.encode_ordinary(text) == exact.encode(text, add_special_tokens=False).ids, hex(ord(c))
    r = random.Random(2)
    for _ in range(400):
        text = "".join(r.choice(plain) for _ in range(60))
        assert enc.fast.encode_ordinary(text) == exact.encode(text, add_special_tokens=False).ids


def test_bins_are_first_fit():
    r, bins, free, want, got = random.Random(4), packing.Bins(100, leaves=2), [], [], []
    for n in sorted((r.randrange(1, 100) for _ in range(500)), reverse=True):
        at = next((i for i, f in enumerate(free) if f >= n), len(free))
        if at == len(free):
            free.append(100)
        want.append((at, 100 - free[at]))
        free[at] -= n
        got.append(bins.place(n))
    assert got == want
