import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from gaugery.llm import quality_rules, queries, substring_dedup, url_filter
from gaugery.llm.common import table

URLS = [
    "http://Example.NET/en/x?y#z", "https://m.example.net/en/", "https://example.net/en", "http://a.example.com/de/1", "http://badexample.com/de/1", "http://w.org/fr/", "http://org/fr/a", "http://x.net", "http://x.net/",
    "ftp://x.net?/en/", "no scheme", "", None, "http://", "http:///net/", "http://x.net#/a", "http://x.org/casino/", "http://x.net/casino/", "http://x.net:80/en/", "http://x.org/a\nb/", "http://a://b.net/c", "http://İ.net/x",
]
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def by_hand(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(t), t, v) for v, t in RULES if f".{host}".endswith("." + t.partition("/")[0]) and path.startswith("/" + t.partition("/")[2])]
    rule = max(fits, default=None)
    glob = "/casino/" in host + path
    return host, path, rule and rule[1], rule[2] if rule else "block" if glob else "allow"


@pytest.mark.parametrize("inline", [0, 256])
def test_rules_by_hand(spark, inline):
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, regex string")
    rules = [*(url_filter.Rule(*x) for x in RULES), url_filter.Rule("block", "*/casino/*", glob=True)]
    got = {r["page_id"]: r for r in url_filter.judge(rows, rules, inline=inline).collect()}
    assert len(got) == 2 * len(URLS)
    for i, u in enumerate([*URLS, *URLS]):
        r = got[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == by_hand(u), u


def test_many_random_rules_agree_with_trying_all(spark):
    r = random.Random(1)
    part = lambda: r.choice(["a", "b", "cc", "d1", "e-f"])
    rules = [url_filter.Rule(r.choice(["allow", "block"]), f"{part()}.{part()}/{r.choice(['', part(), part() + '/'])}") for _ in range(60)]
    urls = [f"http://{part()}.{part()}.{part()}/{part()}/{part()}" for _ in range(300)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    for inline in (0, 10_000):
        got = {x["page_id"]: x["rule"] for x in url_filter.judge(df, rules, inline=inline).collect()}
        for i, u in enumerate(urls):
            fits = [x.text for x in rules if re.search(x.regex, u[7:])]
            assert got[i] == max(fits, key=lambda t: (len(t), t), default=None)


def test_tokens_and_empty_tables(spark):
    assert url_filter.Rule("block", "x.com/ab").tokens == ["x", "com"]
    assert url_filter.Rule("block", "*ab/cd*", glob=True).tokens == []
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, [url_filter.Rule("block", "net/")]).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.judge(one, []).first()["verdict"] == "allow"
    filed = url_filter.index(spark.createDataFrame([("a.net", "/en/"), ("b.net", "/")], "host string, path string"), [url_filter.Rule("allow", "net/en/")])
    assert list(filed) == ["en"]


def test_columns_named_like_the_verdict_are_carried(spark):
    rows = spark.createDataFrame([(1, "http://a.net/", "h", "v", 5)], "page_id long, url string, host string, verdict string, rule int")
    for inline in (0, 256):
        r = url_filter.judge(rows, [url_filter.Rule("block", "net/")], inline=inline).first()
        assert (r["host"], r["verdict"], r["rule"], r["host_in"], r["verdict_in"], r["rule_in"]) == ("a.net", "block", "net/", "h", "v", 5)


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, covered = Counter(triples), set()
    for i, x in enumerate(triples):
        if seen[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_rules_by_hand(spark, sf_dir):
    r = random.Random(2)
    texts = [None, "", " \n\t", "a", "a a a", "a a a a", "a b c a b c", "x\n\nx\n x\nx", "é ü\u00a0ñ 日本", "#$ %& |<>", "w " * 60_000]
    texts += ["".join(r.choice(["a ", "b ", "c ", "\n", "d\n", "#"]) for _ in range(r.randrange(200))) for _ in range(60)]
    texts += [x["text"] for x in table(spark, sf_dir, "documents").collect()]
    docs = spark.createDataFrame([(i, t, None, "k") for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept string")
    got = {x["doc_id"]: x for x in quality_rules.judge(docs).collect()}
    for i, t in enumerate(texts):
        x, want = got[i], base(t)
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert x["base_failed"] == failed and not (failed and x["kept"])
    assert quality_rules.judge(docs.limit(0)).count() == 0


def js(p, q):
    p, q = ([x / sum(v) for x in v] for v in (p, q))
    return math.sqrt(sum(x * math.log2(2 * x / (x + y)) + y * math.log2(2 * y / (x + y)) if x and y else x + y for x, y in zip(p, q, strict=True)) / 2)


def test_distance_by_hand(spark):
    pairs = [([1, 2, 3], [3, 2, 1]), ([0, 4], [5, 0]), ([2, 2], [1, 1]), ([0, 0, 7], [1, 1, 1])]
    df = spark.createDataFrame([(a, b, sum(a), sum(b)) for a, b in pairs], "a array<bigint>, b array<bigint>, n bigint, m bigint")
    got = df.select(quality_rules.js_distance(*(df[c] for c in ("a", "b", "n", "m")))).collect()
    for (a, b), r in zip(pairs, got, strict=True):
        assert r[0] == pytest.approx(js(a, b), abs=1e-12)


def test_clean_documents_stay_and_odd_ones_go(spark):
    rows = queries.op8_quality_rules(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").filter("not base_failed").collect()
    share = lambda q: sum(x["kept"] for x in rows if x["quality"] == q) / sum(x["quality"] == q for x in rows)
    assert share(1) > 0.98 and share(0) < 0.5


def test_every_language_has_its_reference(spark):
    # Each language has a text of its own, so its distance is 0; against the reference over all rows it is not.
    n = 1010
    texts = [(i, "x" * (1 + i % 7) + " " + " ".join(f"{'AB1é'[i % 4]}{i}w{k}" for k in range(100)), f"l{i}") for i in range(n)]
    docs = spark.createDataFrame([*texts, (n, texts[0][1], "l0"), (n + 1, texts[1][1], None)], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in quality_rules.judge(docs).collect()}
    assert len(got) == n + 2 and all(got[i]["js_chars"] < 1e-6 and got[i]["js_words"] < 1e-6 and got[i]["kept"] for i in range(n + 1))
    assert got[n + 1]["js_chars"] > 0.01


def test_gear_is_the_sum_over_the_last_bytes():
    import numpy as np

    data = np.random.default_rng(1).integers(0, 256, 200, np.uint8)
    for i in (0, 5, 31, 32, 199):
        want = sum(int(substring_dedup.GEAR[data[j]]) << (i - j) for j in range(max(0, i - 31), i + 1)) & 0xFFFFFFFF
        assert int(substring_dedup.gear(data)[i]) == want


def test_chunks_cover_a_text_and_resist_shifts():
    r = random.Random(3)
    text = " ".join("".join(r.choice("abcdéfgh日") for _ in range(r.randrange(1, 9))) for _ in range(2000))
    data = text.encode()
    ends = substring_dedup.cuts(data)
    assert ends[-1] == len(data) and sorted(set(ends)) == ends
    "".join(data[a:b].decode() for a, b in zip([0, *ends], ends, strict=False))
    chunk = lambda d: {d[a:b] for a, b in zip([0, *substring_dedup.cuts(d)], substring_dedup.cuts(d), strict=False)}
    assert len(chunk(data) & chunk(b"some words before " + data)) > 0.97 * len(chunk(data))
    assert substring_dedup.cuts(b"") == [] and max(b - a for a, b in zip([0, *ends], ends, strict=False)) <= substring_dedup.MOST


def shared_passages(texts, n=51):
    seen = defaultdict(set)
    for i, t in texts:
        w = (t or "").split()
        for k in range(len(w) - n + 1):
            seen[tuple(w[k : k + n])].add(i)
    return {i for ids in seen.values() if len(ids) > 1 for i in ids}


def test_planted_passages_are_found_and_clean_texts_left(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    planted = [prose(55) for _ in range(6)]
    texts = [(i, f"{prose(80)} {planted[i % 6]} {prose(80)}") for i in range(24)] + [(100 + i, prose(300)) for i in range(30)] + [(200, "loop " * 400), (201, None), (202, "")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, start int")
    got = substring_dedup.passages(docs).collect()
    assert {x["doc_id"] for x in got} == shared_passages(texts) == set(range(24))
    assert {x["doc_id"] for x in got if x["kept"]} == set(range(6))
    out = {x["doc_id"]: x["text"] for x in substring_dedup.deduplicate(docs).collect()}
    assert substring_dedup.deduplicate(docs).columns == docs.columns and set(out) == {i for i, _ in texts}
    assert all(out[i] == t for i, t in texts if i < 6 or i >= 100)
    assert all(len(out[i]) < len(t) - 150 for i, t in texts if 6 <= i < 24)


def test_no_passage_of_51_words_is_lost(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    planted = [prose(51) for _ in range(200)]
    texts = [(i, f"{prose(40 + i % 7)} {planted[i % 200]} {prose(40)}") for i in range(400)] + [(1000 + i, prose(150)) for i in range(100)]
    got = substring_dedup.passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {x["doc_id"] for x in got} == shared_passages(texts) == set(range(400))
    for x in got:
        part = texts[x["doc_id"]][1][x["start"] : x["end"]]
        assert x["words"] >= 24 and part in texts[(x["doc_id"] + 200) % 400][1]
    assert {x["doc_id"] for x in got if x["kept"]} == set(range(200))


def test_shared_passage_inside_a_copied_document_goes(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, short = prose(100), prose(12)
    whole = f"{prose(90)} {shared} {prose(90)} {short} {prose(90)}"
    texts = [(1, f"{prose(60)} {shared} {prose(60)}"), (2, whole), (3, whole), (4, f"{prose(60)} {short} {prose(60)}")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = substring_dedup.passages(docs).collect()
    (own,) = [x for x in got if x["doc_id"] == 2 and not x["kept"]]
    assert whole.encode()[own["start"] : own["end"]].decode() in shared and own["words"] >= 85 and own["first_chunks"] == 0
    assert len([x for x in got if x["doc_id"] == 2 and x["kept"] and x["first_chunks"]]) == 2
    out = {x["doc_id"]: x["text"] for x in substring_dedup.deduplicate(docs).collect()}
    assert out[1] == texts[0][1] and len(out[2]) <= len(whole) - len(shared) + 200 and short in out[2] and len(out[3]) < 50


def test_passages_on_supplied_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = shared_passages([(x["doc_id"], x["text"]) for x in docs.collect()])
    found = {x["doc_id"] for x in queries.op7_substring_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert len(truth & found) >= 0.99 * len(truth)


def test_passages_with_nulls_repeats_and_long_runs(spark):
    text = " ".join(f"w{i}q" for i in range(2000))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    for held, cell, gather in ((substring_dedup.HELD, substring_dedup.CELL, substring_dedup.GATHER), (1, 50, 100), (1, 5, 16)):
        rows = substring_dedup.passages(docs, held=held, cell=cell, gather=gather).collect()
        got = {x["doc_id"]: x for x in rows}
        assert len(rows) == 4 and set(got) == {1, 2, None} and got[2]["start"] == 0 and got[2]["end"] == len(text) and got[2]["words"] >= 2000
        assert got[1]["kept"] and not got[2]["kept"] and not got[None]["kept"] and all(x["copies"] == 4 for x in rows)
    assert substring_dedup.passages(docs.limit(0)).count() == 0
    assert substring_dedup.deduplicate(docs.limit(0)).count() == 0


def test_rows_that_repeat_an_id_lose_their_own_passages_alone(spark):
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijé") for _ in range(r.randrange(2, 9))) for _ in range(n))
    shared, null_a, null_b = prose(90), prose(120), prose(120)
    other = prose(300)
    rows = [(1, shared), (7, f"{prose(40)} {shared} {prose(40)}"), (7, other), (None, f"{null_a} {shared}"), (None, null_b), (None, f"{null_b} {prose(30)}"), (9, None)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(order)], "doc_id long, text string, words int")
        got = substring_dedup.passages(docs, held=200).collect()
        texts = {hashlib.md5(t.encode()).hexdigest(): t for _, t in rows if t}
        for x in got:
            part = texts[x["text_md5"]].encode()[x["start"] : x["end"]].decode()
            assert sum(part in t for t in texts.values()) == 2 or part in shared
        out = {x["words"]: x["text"] for x in substring_dedup.deduplicate(docs, held=200).collect()}
        back = [out[order.index(x)] for x in rows]
        assert back[0] == shared and back[2] == other and back[6] is None and sorted(map(len, back[4:6]))[1] >= 120
        assert len(back[1]) < len(rows[1][1]) - 300 and null_a[:300] in back[3] and len(back[3]) < len(rows[3][1]) - 300
        # Of the two texts without id that share a passage one keeps it.
        assert sum(null_b[100:300] in x for x in back[4:6]) == 1


def parts_of(text, least_words=24):
    """(start, end, digest) of all chunks and taken shingles of a text."""
    import numpy as np

    data = text.encode()
    ends = substring_dedup.cuts(data)
    a = np.frombuffer(data, np.uint8)
    starts, stops = substring_dedup.word_edges(a)
    out = [(x, y, (0, data[x:y])) for x, y in zip([0, *ends], ends, strict=False)]
    return out + [(int(starts[w]), int(stops[w + least_words - 1]), (1, data[starts[w] : stops[w + least_words - 1]])) for w in substring_dedup.shingles(a, starts, stops, least_words)]


def test_passages_against_counts_by_hand(spark):
    r = random.Random(10)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijé") for _ in range(r.randrange(2, 9))) for _ in range(n))
    shared = [prose(r.randrange(20, 140)) for _ in range(25)]
    texts = [" ".join(prose(r.randrange(5, 60)) if r.random() < 0.5 else r.choice(shared) for _ in range(r.randrange(1, 9))) for _ in range(120)]
    texts += texts[:10]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substring_dedup.passages(docs, held=3000, cell=30, gather=1000).collect()
    assert [tuple(x) for x in sorted(got)] == [tuple(x) for x in sorted(substring_dedup.passages(docs.repartition(7)).collect())]
    where, times = defaultdict(set), Counter()
    for i, t in enumerate(texts):
        for _, _, digest in parts_of(t):
            where[digest].add(i)
            times[digest] += 1
    out = {x["doc_id"]: x["text"].encode() for x in substring_dedup.deduplicate(docs).collect()}
    gone, whole, left = 0, [], b"\n".join(out.values())
    for x in got:
        inside = [d for a, b, d in parts_of(texts[x["doc_id"]]) if a < x["end"] and b > x["start"] and len(where[d]) > 1]
        assert x["copies"] in {times[d] for d in inside} and 0 < x["chunks"] <= len(inside) and x["first_chunks"] <= x["chunks"] and x["words"] >= 24
        if not x["kept"]:
            gone += 1
            # What goes stands elsewhere, in what is left of the corpus: every word, and but for the edges of passages every chunk.
            cut = texts[x["doc_id"]].encode()[x["start"] : x["end"]]
            assert all(w in left for w in cut.split()[1:-1])
            whole += [d[1] in left for a, b, d in parts_of(texts[x["doc_id"]]) if a >= x["start"] and b <= x["end"] and d[0] == 0]
    assert gone > 50 and sum(whole) > 0.97 * len(whole)
    # Of the whole corpus too.
    assert all(w in left for t in texts for w in t.encode().split())
    # No passage of 51 words that two documents share is without a passage found over it.
    spans = defaultdict(list)
    for x in got:
        spans[x["doc_id"]].append((x["start"], x["end"]))
    assert shared_passages(list(enumerate(texts))) <= set(spans)


def test_repeats_inside_one_document_on_demand(spark):
    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n))
    twice = prose(80)
    docs = spark.createDataFrame([(1, f"{twice} {prose(50)} {twice}"), (2, prose(100))], "doc_id long, text string")
    assert substring_dedup.passages(docs).count() == 0
    got = substring_dedup.passages(docs, inside=True).collect()
    assert {x["doc_id"] for x in got} == {1} and sorted(x["kept"] for x in got) == [False, True]


def test_packed_entries_round_trip_and_group():
    import numpy as np

    r = np.random.default_rng(3)
    n = 500
    high = r.integers(0, 200, n).astype(np.uint64)
    e = substring_dedup.Entries(high, r.integers(0, 2, n).astype(np.uint32), r.integers(-5, 5, n), r.integers(0, 3, n).astype(np.int32), r.integers(1, 4, n).astype(np.int32), r.random(n) < 0.1, r.random(n) < 0.05)
    assert all((x == y).all() for x, y in zip(substring_dedup.Entries.unpack(e.pack(), n), e, strict=True))
    out, number, first = substring_dedup.grouped(e)
    by = defaultdict(list)
    for i, x in enumerate(zip(*(c.tolist() for c in e), strict=True)):
        by[x[:2]].append((i, x))
    assert [tuple(x) for x in zip(out.high.tolist(), out.low.tolist(), strict=True)] == sorted(by)
    for k, key in enumerate(sorted(by)):
        rows = by[key]
        lead = min((x[5], x[2], x[3]) for _, x in rows)
        assert (out.null[k], out.owner[k], out.place[k], out.n[k]) == (*lead, sum(x[4] for _, x in rows))
        assert out.many[k] == (any(x[6] for _, x in rows) or len({(x[5], x[2]) for _, x in rows}) > 1)
        assert all(number[i] == k and first[i] == ((x[5], x[2], x[3]) == lead) for i, x in rows)
