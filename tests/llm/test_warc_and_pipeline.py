import gzip
from html.parser import HTMLParser

import corpus_pipeline
from gaugery.llm import queries, warc
from gaugery.llm.common import table

PAGE = (
    '<html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- <p>no</p> --><p title="a>b">One <b>two</b>&nbsp;&lt;x&gt;</p><ul><li><a href="/u?a=1&amp;b=2">L</a><li><A HREF=\'v\'>M</A></ul>'
    "<br>end < 3</body>"
)


def test_text_title_and_links():
    text, title, links = warc.plain_text(PAGE)
    assert text.split("\n") == ["One two <x>", "L", "M", "end < 3"]
    assert title == "A & B" and links == ["/u?a=1&b=2", "v"]
    assert warc.plain_text("") == ("", None, []) and warc.plain_text("<script>x")[0] == "" and warc.plain_text("<" * 100_000)[0]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, block string")


def test_derivatives_refer_to_their_source(spark):
    source = warc.responses(pages(spark, [(1, "http://a/é", PAGE, ""), (2, None, None, ""), (None, "http://b/", "", ""), (3, "http://c/", "x" * 1_000_000, "")]))
    by = {r["record_id"]: r.asDict() for r in source.collect()}
    got = [r.asDict() for r in warc.derive(source).collect()]
    assert len(got) == 2 * len(by) and len({r["record_id"] for r in got}) == len(got)
    for r in got:
        s = by[r["refers_to"]]
        assert (r["refers_to_target_uri"], r["refers_to_date"], r["target_uri"]) == (s["target_uri"], s["date"], s["target_uri"])
        said, own = dict(r["headers"]), dict(s["headers"])
        assert said["Source-Payload-Digest"] == s["payload_digest"] and said["Source-Block-Digest"] == s["block_digest"]
        assert said["Source-HTTP-Content-Type"] == "text/html; charset=utf-8" and said.get("X-Page-ID") == own.get("X-Page-ID")
        assert r["block_digest"] == warc.digest(bytes(r["block"]))
    one = {r["record_type"]: bytes(r["block"]).decode() for r in got if r["target_uri"] == "http://a/é"}
    assert one["conversion"].startswith("One two") and "title: A & B\r\n" in one["metadata"] and "outlink: /u?a=1&b=2 A/@href" in one["metadata"]
    assert sorted(r["record_id"] for r in warc.derive(source).collect()) == sorted(r["record_id"] for r in got)
    assert warc.derive(source.limit(0)).count() == 0


def test_files_round_trip(spark, tmp_path):
    source = warc.responses(pages(spark, [(1, "http://a/é", PAGE, ""), (2, None, None, ""), (3, "http://c/", "\r\n\r\nWARC/1.1\r\n", "")]))
    records = source.unionByName(warc.derive(source))
    want = sorted(repr(sorted(r.asDict().items(), key=str)) for r in records.collect())
    warc.write(records, str(tmp_path / "t"))
    back = warc.read(spark, str(tmp_path / "t"), table=True)
    assert sorted(repr(sorted(r.asDict().items(), key=str)) for r in back.collect()) == want
    members = [bytes(r["value"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "f" / "b.warc").write_bytes(b"".join(map(gzip.decompress, members)))
    twice = sorted(repr(sorted(r.asDict().items(), key=str)) for r in warc.read(spark, str(tmp_path / "f")).collect())
    assert twice == sorted(want * 2)


def test_other_records_and_plain_blocks(spark):
    assert warc.split_http(b"abc") == (None, [], b"abc")
    assert warc.split_http(b"HTTP/1.0 404 No\nA: b\n\nbody") == ("HTTP/1.0 404 No", [("A", "b")], b"body")
    source = warc.responses(pages(spark, [(1, "u", "x", "")])).selectExpr("* except (record_type)", "'request' as record_type")
    assert warc.derive(source).count() == 0


def record(block, **more):
    row = dict.fromkeys(warc.COLUMNS) | {"record_id": "<r>", "record_type": "response", "headers": [], "block": block} | more
    return [dict(zip(warc.COLUMNS, x, strict=True)) for x in warc._derivatives(row)]


def test_encodings_and_repeated_headers():
    page = "<p>é</p>" + "<!-- x -->" * 1000 + "<meta charset=latin-1>"
    meta, plain = record(page.encode("latin-1"))
    assert plain["block"].decode() == "é" and b"charset: latin-1" in meta["block"]
    for odd in ("undefined", "idna", "punycode", "nothing-known", "base64", "hex", "rot13", "unicode_escape", "utf-8\0"):
        _, plain = record(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={odd}\r\n\r\n<p>é\\x</p>".encode())
        assert plain["block"].decode() == "é\\x", odd
    _, plain = record(b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nContent-Type: TEXT/HTML; Charset=UTF-16\r\nSet-Cookie: b=2\r\n\r\n" + "hi".encode("utf-16"), headers=[{"name": "Via", "value": "1"}, {"name": "Via", "value": "2"}])
    assert [(x["name"], x["value"]) for x in plain["headers"] if x["name"] in ("Via", "Source-HTTP-Set-Cookie")] == [("Via", "1"), ("Via", "2"), ("Source-HTTP-Set-Cookie", "a=1"), ("Source-HTTP-Set-Cookie", "b=2")]
    assert plain["block"] == b"hi"
    back = list(warc.decode(warc.encode(plain)))
    assert back == [tuple(plain[c] for c in warc.COLUMNS)]


def test_exported_files_hold_the_records(spark, tmp_path):
    records = warc.derive(warc.responses(pages(spark, [(1, "http://a/é", PAGE, ""), (2, None, None, ""), (3, "http://c/", "WARC/1.1\r\n\r\n", "")])))
    warc.export(records, str(tmp_path / "out"))
    want = sorted(repr(sorted(r.asDict().items(), key=str)) for r in records.collect())
    got = sorted(repr(sorted(r.asDict().items(), key=str)) for r in warc.read(spark, str(tmp_path / "out" / "*.gz")).collect())
    assert got == want
    assert all(gzip.decompress(p.read_bytes())[:10] in (b"", b"WARC/1.1\r\n") for p in (tmp_path / "out").glob("*.gz"))


class Rebuilt(HTMLParser):
    """Text, title and links by another parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.names, self.links, self.titles = [], [], [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in warc.BLOCKS:
            self.out.append("\n")
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])
        if tag in ("script", "style", "noscript", "template", "title"):
            self.names.append(tag)

    def handle_endtag(self, tag):
        if tag in warc.BLOCKS:
            self.out.append("\n")
        if self.names and tag == self.names[-1]:
            self.names.pop()

    def handle_data(self, data):
        (self.titles if self.names == ["title"] else [] if self.names else self.out).append(data)

    @property
    def text(self):
        lines = (" ".join(x.replace("\u00a0", " ").split(" ")).split() for x in "".join(self.out).split("\n"))
        return "\n".join(" ".join(x) for x in lines if x)


def test_query_equals_a_rebuild(spark, sf_dir):
    rows = queries.op10_warc(spark, sf_dir).collect()
    source = {r["page_id"]: r for r in table(spark, sf_dir, "pages").collect()}
    assert len(rows) == 2 * len(source) and {r["record_type"] for r in rows} == {"metadata", "conversion"}
    ids = {}
    for r in rows:
        page = source[r["page_id"]]
        made = Rebuilt(page["html"] or "")
        assert r["target_uri"] == page["url"] and r["block_digest"] == warc.digest(r["text"].encode())
        if r["record_type"] == "conversion":
            assert [x.split() for x in r["text"].split("\n")] == [x.split() for x in made.text.split("\n")]
        else:
            title = " ".join("".join(made.titles).split())
            want = ([("title", title)] if title else []) + [("charset", "utf-8")] + [("outlink", f"{' '.join(x.split())} A/@href".strip()) for x in made.links]
            assert [tuple(x.split(": ", 1)) for x in r["text"].split("\r\n")[:-1]] == want
        ids.setdefault(r["page_id"], set()).add(r["refers_to"])
    assert all(len(x) == 1 for x in ids.values()) and len(set().union(*ids.values())) == len(source)


def test_stages_in_order_and_each_on_what_was_kept(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = table(spark, sf_dir, "documents")
    names, kept = docs.columns, [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf_dir).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
        if i < 4:
            assert kept[-1].columns == names
    start, lang, exact, near, mixed, pieces = ([r.asDict() for r in k.collect()] for k in kept)
    assert [r for r in start if any(map(str.isalpha, r["text"] or ""))] and len(lang) >= 0.98 * len(start)
    best = {}
    for r in lang:
        best[r["text"] or ""] = max(best.get(r["text"] or "", -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(best.values())
    import sys

    sys.path.insert(0, str(__file__).rsplit("/", 1)[0])
    from test_near_dedup import brute

    comps = brute([(r["doc_id"], r["text"]) for r in exact], 5)
    assert sorted(r["doc_id"] for r in near) == sorted(i for i, (_, c) in comps.items() if i == c)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near}
    words = sum(len((r["text"] or "").split()) for r in near)
    assert abs(sum(len((r["text"] or "").split()) for r in mixed) - 1.5 * words) < 0.1 * words
    tokens = {}
    for r in pieces:
        tokens.setdefault(r["doc_id"], [0, r["doc_tokens"]])[0] += r["length"]
    copies = {}
    for r in mixed:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert {i: n for i, (n, _) in tokens.items()} == {i: copies[i] * n for i, (_, n) in tokens.items()} and set(tokens) == set(copies)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(pieces)


def test_empty_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
