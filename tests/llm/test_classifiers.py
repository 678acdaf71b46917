import zlib

import numpy as np
import pytest

from gaugery.llm import common, language_id, queries, toxicity
from gaugery.llm.common import held_out, table


def remainder(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_on_held_out_documents(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op2_language_id(spark, sf_dir).collect()}
    rows = [r for r in table(spark, sf_dir, "documents").collect()]
    assert len(got) == len(rows)
    assert all(got[r["doc_id"]]["held_out"] == remainder(r["doc_id"]) for r in rows)
    kept = [r for r in rows if remainder(r["doc_id"])]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in kept]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


LANGS = {"xx": "alpha beta gamma delta ", "yy": "zwei drei vier fünf ", "zz": "один два три "}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, LANGS[k] * (1 + i % 5), k) for i, k in enumerate(["xx", "yy", "zz"] * 20)] + [(99, None, "xx"), (None, "zwei", "xx"), (98, "123", "yy")]
    return language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_edge_texts(spark, model):
    texts = ["alpha", "fünf", "три", None, "", "123 !!", "a" * 300_000, "alpha beta gamma delta zwei drei vier fünf"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(0, "alpha", "s")], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in range(6)] == ["xx", "yy", "zz", "und", "und", "und"]
    assert got[3]["score"] == 0 and not got[3]["ambiguous"]
    assert got[6]["lang_pred"] in LANGS
    assert {got[7]["lang_pred"], got[7]["second"]} == {"xx", "yy"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_an_even_mixture_is_ambiguous(model):
    plain, mixed = "alpha beta gamma delta " * 5, " ".join(["alpha beta gamma delta zwei drei vier fünf"] * 5)
    best, second, score, near = model.predict([plain, mixed])
    assert not near[0] and score[0] > 0.9 and score[1] < score[0]


def test_no_labels_and_one_language(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "xx")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.fit(docs)).collect()} == {"und"}
    one = spark.createDataFrame([(1, "abc", "xx"), (2, "1", "xx")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(one, language_id.fit(one)).collect()} == {1: "xx", 2: "und"}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 7, 8, 9, 12, 40, 200])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    distance = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert distance >= (2 ** (n - 2) if n <= 7 else 10)
    assert (abs(code.astype(int).sum(axis=0)) < n).all()
    columns = {c.tobytes() for c in (code * code[:1]).T}
    assert len(columns) == code.shape[1]


def bins_of(text, dimensions):
    """Hashed n-grams of a text, one by one."""
    t, mask = " ", (1 << 64) - 1
    for ch in f"{text.lower()} ":
        ch = ch if ch.isalpha() else " "
        t += "" if ch == t[-1] == " " else ch
    out = []
    for order in (1, 2, 3):
        for i in range(len(t) - order + 1):
            x = 0
            for ch in t[i : i + order]:
                x = (x + ord(ch)) * 0x9E3779B97F4A7C15 & mask
                x ^= x >> 32
            out.append((x * 0xD6E8FEB86659FD93 & mask) >> (64 - (dimensions.bit_length() - 1)))
    return out


def test_language_equals_a_decoder_by_hand(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").collect()
    size, counts = language_id.DIMENSIONS, {}
    for r in rows:
        if not remainder(r["doc_id"]) and r["lang"] and language_id.has_letters(r["text"]):
            np.add.at(counts.setdefault(r["lang"], np.full(size, language_id.SMOOTHING)), bins_of(r["text"], size), 1)
    langs = sorted(counts)
    p = {k: v / v.sum() for k, v in counts.items()}
    codes = language_id.codewords(len(langs))
    odds = [np.log(np.mean([p[k] for k, s in zip(langs, c, strict=True) if s > 0], axis=0) / np.mean([p[k] for k, s in zip(langs, c, strict=True) if s < 0], axis=0)).astype(np.float32).astype(float) for c in codes.T]
    margins = {}
    for i, r in enumerate(rows):
        if language_id.has_letters(r["text"]):
            b = bins_of(r["text"], size)
            margins[i] = [language_id.SCALE * o[b].sum() / (len(b) + language_id.SHRINK) for o in odds]
    right, seen = [0] * len(odds), 0
    for i, m in margins.items():
        if not remainder(rows[i]["doc_id"]) and rows[i]["lang"]:
            seen += 1
            right = [n + (x * codes[langs.index(rows[i]["lang"])][j] > 0) for j, (n, x) in enumerate(zip(right, m, strict=True))]
    accuracy = [min(0.999, max(0.51, (n + 1) / (seen + 2))) for n in right]
    weights = [np.log(a / (1 - a)) for a in accuracy]
    weights = [w / np.mean(weights) for w in weights]
    got = {r["doc_id"]: r for r in queries.op2_language_id(spark, sf_dir).collect()}
    for i, r in enumerate(rows):
        x = got[r["doc_id"]]
        if i not in margins:
            assert (x["lang_pred"], x["score"]) == ("und", 0.0)
            continue
        loss = [sum(w * np.log1p(np.exp(-s * m)) for w, s, m in zip(weights, c, margins[i], strict=True)) for c in codes]
        share = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        assert x["lang_pred"] == langs[int(np.argmin(loss))] and x["score"] == pytest.approx(share.max(), abs=1e-6)
        assert x["ambiguous"] == (np.sort(share)[-1] - np.sort(share)[-2] < language_id.AMBIGUOUS)


def test_rows_that_repeat_an_id_keep_their_labels(spark):
    rows = [(7, LANGS[k] * 5, k) for k in LANGS] * 30 + [(i, LANGS[k] * 3, k) for i, k in enumerate(["xx", "yy", "zz"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = common.row_sample(docs.selectExpr("doc_id as id", "lang as label", "text"), 40).collect()
    assert len(got) <= 3 * 4 and all(r["text"].startswith(LANGS[r["label"]].strip()) for r in got)
    model = language_id.fit(docs)
    assert [model.languages[i] for i in model.predict([t for t in LANGS.values()])[0]] == list(LANGS)
    # A label that stands apart holds for all texts of its id, within the bound.
    labels, many = spark.createDataFrame([(7, 1), (1, 0)], "id long, label int"), spark.createDataFrame([(7, f"t{i}") for i in range(500)] + [(1, "u")], "id long, text string")
    got = common.labelled_sample(labels, many, 64).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got}[0] == 1 and 30 < {r["label"]: r["count"] for r in got}[1] <= 64
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(docs, most_languages=2)


def test_columns_named_like_results_are_carried(spark, model):
    docs = spark.createDataFrame([(1, "alpha", "mine", 3, None)], "doc_id long, text string, score string, lang_pred int, score_in int")
    got = language_id.predict(docs, model).first().asDict()
    assert got["score_in_in"] == "mine" and got["lang_pred_in"] == 3 and got["score_in"] is None and got["lang_pred"] == "xx" and got["score"] > 0
    got = toxicity.predict(docs, toxicity.Model()).first().asDict()
    assert got["score_in_in"] == "mine" and got["lang_pred"] == 3 and got["predicted"] == 0
    assert list(common.carried(["a", "score", "score_in"], ["score"]).values()) == ["a", "score_in_in", "score_in"]


def test_long_texts_are_read_in_pieces(monkeypatch):
    r = np.random.default_rng(4)
    for _ in range(60):
        text = "".join(r.choice(list("abÉß ΣΑ 1\n-日"), int(r.integers(0, 60)))).replace("Σ", "s")
        want = sorted(np.concatenate([b for b, _ in language_id.ngrams([text], 1 << 12)]).tolist())
        for size in (1, 2, 3, 7, 100):
            assert sorted(np.concatenate(list(language_id.long_ngrams(text, 1 << 12, size))).tolist()) == want
    texts = ["alpha beta " * 40, "zwei drei " * 300, "x", "delta " * 500]
    table = r.normal(size=(1 << 12, 3)).astype(np.float32)
    model = language_id.Model(["a", "b", "c"], language_id.codewords(3), table, np.ones(3))
    whole = model.predict(texts)
    monkeypatch.setattr(language_id, "LONG", 1000)
    assert list(language_id.chunks(texts, 1500)) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    for x, y in zip(whole, model.predict(texts), strict=True):
        assert np.allclose(x, y)


def test_ngrams_do_not_cross_texts():
    alone = [sorted(np.concatenate([b for b, _ in language_id.ngrams([t], 1 << 12)]).tolist()) for t in ("ab c", "dé")]
    both = [[], []]
    for bins, first in language_id.ngrams(["ab c", "dé"], 1 << 12):
        both[0] += bins[: first[1]].tolist()
        both[1] += bins[first[1] :].tolist()
    assert [sorted(x) for x in both] == alone


def test_toxicity_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, sf_dir).collect()}
    docs = {r["doc_id"]: r["lang"] for r in table(spark, sf_dir, "documents").collect()}
    assert set(got) == set(docs)
    rows = [r for r in table(spark, sf_dir, "labels").collect() if remainder(r["doc_id"])]
    assert np.mean([got[r["doc_id"]]["predicted"] for r in rows if r["toxic"] == 0] or [0]) < 0.02
    # Some hundred labelled documents are enough for English alone.
    assert np.mean([got[r["doc_id"]]["predicted"] for r in rows if r["toxic"] == 1 and docs[r["doc_id"]] == "en"]) > 0.8
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == remainder(i) for i, r in got.items())


def test_folding():
    assert toxicity.fold("You 1D10T!").split() == ["you", "idiot"]
    assert toxicity.fold("іdiоt ѕcum").split() == ["idiot", "scum"]
    assert toxicity.fold("ｉｄｉｏｔ in 2024, 10 m3n 5x").split() == ["idiot", "in", "men", "x"]
    assert toxicity.fold("wow!! hare$$$ a$$ 1st").split() == ["wow", "hare", "a", "ist"]
    assert toxicity.fold(None).split() == [] and "été" in toxicity.fold("ÉTÉ")


def test_longest_match_and_exceptions():
    weights = {" clown ": 5.0, " idio": 4.0, " clown  fish ": 0.0, " idiomatic ": 0.0}
    total, length = toxicity.evidence(["a clown here", "a clown fish here", "idiots all", "idiomatic speech", None, "", "clown clown"], weights)
    assert total.tolist() == [5, 0, 4, 0, 0, 0, 10] and length.tolist()[:2] == [3, 4]


def test_fit_learns_words_and_stems(spark):
    r = np.random.default_rng(0)
    plain = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows, labels = [], []
    for i in range(600):
        words = list(r.choice(plain, 30))
        if i % 3 == 0:
            words[3] = ["badone", "grumpa", "grumpb", "grumpc", "grumpd", "grumpe"][i // 3 % 6]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    docs, marks = spark.createDataFrame([*rows, (900, None)], "id long, text string"), spark.createDataFrame([*labels, (900, 1), (None, 1), (901, None)], "id long, label int")
    model = toxicity.fit(marks, docs)
    assert " badone " in model.weights and any(" grumpz".startswith(x) for x in model.weights if not x.endswith(" "))
    test = spark.createDataFrame([(1, "waa b4done wab"), (2, "wab grumpz"), (3, "waa wab"), (4, None), (5, "wab " * 100_000)], "doc_id long, text string")
    got = {x["doc_id"]: x["predicted"] for x in toxicity.predict(test, model).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    nothing = toxicity.fit(marks.limit(0), docs)
    assert {x["predicted"] for x in toxicity.predict(test, nothing).collect()} == {0}
    assert toxicity.predict(test.limit(0), model).count() == 0


def naive_evidence(text, weights):
    """At each place the longest term, left to right, none over another."""
    t, at, total = toxicity.fold(text), 0, 0.0
    while at < len(t):
        term = max((x for x in weights if t.startswith(x, at)), key=len, default=None)
        total += weights.get(term, 0.0)
        at += len(term) if term else 1
    return total


def test_toxicity_equals_a_matcher_by_hand(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    marks = [(r["doc_id"], r["toxic"]) for r in table(spark, sf_dir, "labels").collect() if r["toxic"] is not None and not remainder(r["doc_id"]) and docs.get(r["doc_id"]) is not None]
    sizes, counts = [sum(x == k for _, x in marks) for k in (1, 0)], {}
    for i, label in marks:
        for term in toxicity._terms(docs[i]):
            counts.setdefault(term, [0, 0])[1 - label] += 1
    want = toxicity.choose([(x, t, c) for x, (t, c) in counts.items()], *sizes)
    labels = spark.createDataFrame(marks, "id long, label int")
    model = toxicity.fit(labels, table(spark, sf_dir, "documents").selectExpr("doc_id as id", "text"))
    phrases = {x for x in model.weights if len(x.split()) > 1}
    assert {x: pytest.approx(w) for x, w in want.items()} == {x: w for x, w in model.weights.items() if x not in phrases} and model.power > 0
    got = {r["doc_id"]: r for r in toxicity.predict(table(spark, sf_dir, "documents").select("doc_id", "text"), model).collect()}
    for i in list(docs)[::4]:
        total, n = naive_evidence(docs[i], model.weights), len(toxicity.fold(docs[i]).split())
        p = 1 / (1 + np.exp(-np.clip(model.slope * total / (1 + got[i]["n_words"] / 50) ** model.power + model.bias, -50, 50)))
        assert got[i]["evidence"] == pytest.approx(total) and got[i]["score"] == pytest.approx(p) and got[i]["predicted"] == (p >= 0.5) and abs(got[i]["n_words"] - n) <= 1


def test_a_rich_lexicon_is_fitted(spark):
    r = np.random.default_rng(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stems = ["".join(r.choice(list(letters), 5)) for _ in range(450)]
    rows, labels = [], []
    for i in range(1500):
        if i % 2:
            words = [s + "".join(r.choice(list(letters), 3)) for s in r.choice(stems, 40)]
        else:
            words = ["w" + "".join(r.choice(list(letters), 6)) for _ in range(40)]
        rows.append((i, " ".join(words)))
        labels.append((i, i % 2))
    model = toxicity.fit(spark.createDataFrame(labels, "id long, label int"), spark.createDataFrame(rows, "id long, text string"))
    assert sum(not x.endswith(" ") for x in model.weights) > 300


def test_held_out_rule(spark):
    ids = [0, 1, 5, 17, 99, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(held_out()).collect()
    assert [r[0] for r in got] == [i is None or remainder(i) for i in ids]
