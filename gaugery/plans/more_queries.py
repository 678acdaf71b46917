"""Further queries over the supplied tables, for operators that those of `queries` don't reach, with their SQL."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugery.functions import bleu, ifeval, labels, longbench, math_text, mlqa, numeric, qa_text, rouge, text
from gaugery.functions import multiple_choice as mc
from gaugery.operators import joins, metrics, requests, reshape, selection, shuffles
from gaugery.plans import registry
from gaugery.plans.queries import _PAIRED, DIGITS, _paired, table
from gaugery.plans.run import Windows, build, evaluate, recorded, with_shots
from gaugery.plans.suites import Suite, get
from gaugery.sources.readers import Source, read, read_rows
from gaugery.streaming import scoring

NAMES: list[str] = []


def query(name: str, sql: str | None = None):
    NAMES.append(name)
    return registry.query(name, sql)


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _str(c: str) -> Column:
    return F.col(c).cast("string")


def _of(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _pick(kind: Column, *cases: Column) -> Column:
    """The case that stands at the place `kind`."""
    return F.coalesce(*[F.when(kind == i, c) for i, c in enumerate(cases)])


# Scans and selection.


@query("scan_rows", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, doc_id FROM documents")
def scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file table with dense row numbers in the order of the file."""
    return read_rows(spark, Source(f"{sf_dir}/documents.parquet")).select("row_idx", "doc_id")


@query("row_cap", "SELECT count(*) AS total, count(*) FILTER (doc_id < 100) AS capped, count(*) FILTER (trim(coalesce(text, '')) <> '' AND lang = 'en') AS filled FROM documents")
def row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, Source(f"{sf_dir}/documents.parquet"))
    counts = d.agg(F.lit(0).alias("k"), F.count(F.lit(1)).alias("total"), F.count_if((F.btrim(_text()) != "") & (F.col("lang") == "en")).alias("filled"))
    capped = selection.limit_rows(d, 100, "doc_id").agg(F.lit(0).alias("k"), F.count(F.lit(1)).alias("capped"))
    return counts.join(capped, "k").select("total", "capped", "filled")


@query("order_hash", "SELECT count(*) AS n, count(*) AS places, 0::BIGINT AS first_place, count(*) - 1 AS last_place FROM documents")
def order_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order by seeded hashes is dense and has each place once."""
    o = selection.order_rows(table(spark, sf_dir, "documents").select("doc_id"), "hash|3", row_idx="doc_id")
    return o.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("exec_pos").alias("places"), F.min("exec_pos").alias("first_place"), F.max("exec_pos").alias("last_place"))


@query("parallel_rows", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS label FROM documents")
def parallel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and labels of two tables, joined by row number."""
    d = table(spark, sf_dir, "documents")
    label = F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("label")
    return joins.zip_by_row(selection.with_row_idx(d.select("doc_id")), selection.with_row_idx(d.select(label))).select("doc_id", "label")


# Reshaping.


@query(
    "flatten_articles",
    """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS problem_idx, role, turn FROM conversations)
SELECT conv_id, problem_idx::INT AS problem_idx, role, coalesce(string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS previous FROM t
""",
)
def flatten_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = reshape.group_structs(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", ["role", "turn"], "problems")
    flat = reshape.flatten_problems(g)
    return flat.select("conv_id", "problem_idx", "problem.role", F.array_join(F.transform("previous_problems", lambda p: p["role"]), ",").alias("previous"))


@query(
    "flatten_turns",
    """
WITH c AS (SELECT conv_id, row_number() OVER w - 1 AS turn, coalesce(text, '') AS question, role AS answer, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn::INT AS turn, question, answer, turns::INT AS turns, coalesce(string_agg(question || '/' || answer, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM c
""",
)
def flatten_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = reshape.group_structs(table(spark, sf_dir, "conversations").withColumn("text", _text()), ["conv_id"], "turn", ["text", "role"], "t")
    lists = g.select("conv_id", F.transform("t", lambda x: x["text"]).alias("questions"), F.transform("t", lambda x: x["role"]).alias("answers"))
    said = F.array_join(F.zip_with("history_questions", "history_answers", lambda q, a: F.concat(q, F.lit("/"), a)), "|")
    return reshape.flatten_turns(lists).select("conv_id", "turn", "question", "answer", "turns", said.alias("history"))


@query("flatten_squad", "SELECT r_name AS title, n_name AS context, n_nationkey::VARCHAR AS id, 'Where is ' || n_name || '?' AS question, r_name || '|' || r_regionkey AS answers FROM region JOIN nation ON r_regionkey = n_regionkey")
def flatten_squad(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    answers = F.array(*[F.struct(c.alias("text")) for c in (F.col("r_name"), _str("r_regionkey"))])
    qa = F.array(F.struct(_str("n_nationkey").alias("id"), _of("Where is ", F.col("n_name"), "?").alias("question"), answers.alias("answers")))
    paragraphs = F.collect_list(F.struct(F.col("n_name").alias("context"), qa.alias("qas"))).alias("paragraphs")
    nested = n.groupBy("r_name").agg(paragraphs).select(F.array(F.struct(F.col("r_name").alias("title"), "paragraphs")).alias("data"))
    return reshape.flatten_squad(nested).withColumn("answers", F.array_join("answers", "|"))


@query(
    "paper_answers",
    """
SELECT p_partkey, 'q' AS question, CASE p_size % 6 WHEN 0 THEN 'unanswerable' WHEN 1 THEN 'yes' WHEN 2 THEN p_name WHEN 3 THEN p_brand || ', ' || p_type WHEN 4 THEN 'no' END AS answer,
       CASE p_size % 6 WHEN 0 THEN 'unanswerable' WHEN 1 THEN 'bool' WHEN 2 THEN 'free_form' WHEN 3 THEN 'extractive' WHEN 4 THEN 'bool' END AS answer_type FROM part
""",
)
def paper_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_size") % 6
    yes = F.when(kind == 1, True).when(kind == 4, False)
    spans = F.when(kind == 3, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>"))
    a = F.struct((kind == 0).alias("unanswerable"), yes.alias("yes_no"), F.when(kind == 2, F.col("p_name")).otherwise("").alias("free_form_answer"), spans.alias("extractive_spans"))
    papers = table(spark, sf_dir, "part").select("p_partkey", F.array(F.struct(F.lit("q").alias("question"), F.array(a).alias("answers"))).alias("qas"))
    return reshape.paper_answers(papers)


@query("columns_to_rows", "SELECT p_partkey, unnest([0, 1]) AS item_idx, unnest(['A', 'B']) AS label, unnest([p_brand, p_type]) AS option FROM part")
def columns_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(F.lit("A"), F.lit("B")).alias("label"), F.array("p_brand", "p_type").alias("option"))
    return reshape.columns_to_rows(p, ["label", "option"])


@query("option_parse", "SELECT p_partkey, p_brand || '|' || p_size || ' , 5|' || p_type AS options FROM part")
def option_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _of("a ) ", F.col("p_brand"), " , b ) ", _str("p_size"), " , 5 , c ) ", F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(reshape.lettered_options(said), "|").alias("options"))


@query("blank_fill", "SELECT p_partkey, 'The ' || p_brand || '|The ' || p_type AS heads, ' was ' || p_name || '.' AS tail, 'See ' || p_name || ' now, ' || p_brand || '!' AS replaced FROM part")
def blank_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("sentence", _of("The _ was ", F.col("p_name"), "."))
    heads, tail = reshape.blank_parts(F.col("sentence"), F.array("p_brand", "p_type"))
    seen = _of("See it now, ", F.col("p_brand"), "!")
    return p.select("p_partkey", F.array_join(heads, "|").alias("heads"), tail.alias("tail"), reshape.replace_span(seen, F.lit(4), F.lit("it"), F.col("p_name")).alias("replaced"))


@query(
    "continuation_chunks",
    """
WITH e AS (SELECT vec_id, len(embedding) AS n, vec_id % 4 AS p FROM embeddings),
c AS (SELECT vec_id, n, greatest(p, 1) AS before, unnest(range(0, n, 5)) AS place FROM e)
SELECT vec_id, (place // 5)::INT AS chunk_idx, least(5, n - place)::INT AS tokens, least(before + place, 6 - least(5, n - place))::INT AS context FROM c
""",
)
def continuation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A continuation in chunks, each after as much as fits: prefixes of 0 to 3 tokens, an empty one being the start token."""
    ids = F.sequence(F.lit(0), F.size("embedding") - 1)
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.col("vec_id") % 4, F.lit(1)).cast("int")), lambda i: -i)
    prefix = F.when(F.col("vec_id") % 4 > 0, some).otherwise(F.array().cast("array<int>"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", ids.alias("ids"), prefix.alias("prefix"))
    return reshape.continuation_chunks(e, "prefix", "ids", 5, -1).select("vec_id", "chunk_idx", F.size("chunk_ids").alias("tokens"), F.size("context_ids").alias("context"))


# Requests and exemplars.


@query("chat_requests", "SELECT conv_id, turn, 'user,assistant,user' AS roles, 4 + 1 + 9 + 2 + 4 + length(coalesce(text, '')) AS size FROM conversations")
def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = F.array(F.struct(F.lit("q").alias("prompt"), F.lit("a1").alias("target")))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", requests.chat(_text(), shots).alias("m"))
    return c.select("conv_id", "turn", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), requests.length(messages=F.col("m")).cast("bigint").alias("size"))


@query("prepared_requests", "SELECT doc_id, coalesce(text, '') AS prompt, 'x|y' AS stop, 64 AS max_new_tokens, 1 AS num_beams, false AS do_sample, length(coalesce(text, '')) + 6 AS choices_size FROM documents")
def prepared_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = requests.choices_length(_text(), F.array(F.lit("yes"), F.lit("no!"))).cast("bigint").alias("choices_size")
    d = table(spark, sf_dir, "documents").select("doc_id", requests.generation(_text(), stops=("x", "y"), max_new_tokens=64).alias("r"), size)
    return d.select("doc_id", "r.prompt", F.array_join("r.stop", "|").alias("stop"), "r.max_new_tokens", "r.num_beams", "r.do_sample", "choices_size")


@query(
    "shots_by_subject",
    """
WITH p AS (SELECT p_partkey, p_type, 'Q: ' || p_name || chr(10) || 'A: ' || p_brand AS shot, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part),
s AS (SELECT p_type, string_agg(shot, chr(10) || chr(10) ORDER BY p_partkey) AS shots FROM p WHERE k <= 2 GROUP BY p_type)
SELECT p_partkey, 'On parts.' || chr(10) || chr(10) || shots || chr(10) || chr(10) || 'Q: ' || p_name || chr(10) || 'A:' AS prompt FROM part JOIN s USING (p_type)
""",
)
def shots_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions after a description and the first two exemplars of their subject."""
    suite = Suite("parts", "generate", prompt="{raw prefix}Q: {p_name}\nA:", shot="Q: {p_name}\nA: {p_brand}", description="On parts.")
    rows = table(spark, sf_dir, "part").withColumn("row_idx", F.col("p_partkey"))
    return build(with_shots(rows, rows, suite, 2, "p_type"), suite).select("p_partkey", "prompt")


@query(
    "first_others",
    """
WITH x AS (SELECT a.p_partkey, b.p_partkey AS shot, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) AS k FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_name <> b.p_name)
SELECT p_partkey, string_agg(shot, ',' ORDER BY shot) AS shots FROM x WHERE k <= 3 GROUP BY p_partkey
""",
)
def first_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three exemplars of a row's group that differ from it in content."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    got = joins.first_others(p, p, "p_type", ["p_name"], "p_partkey", 3).filter(F.size("shots") > 0)
    return got.select("p_partkey", F.array_join(F.transform("shots", lambda s: s["p_partkey"].cast("string")), ",").alias("shots"))


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join(str(r) for r in rows) + ")"


#: What Python's generator draws for 25 rows, for the SQL.
_ORDERS = [(i, *p) for i, p in enumerate(shuffles.shared_permutations(25, 3, 0))]
_DRAWN = [(i, ",".join(map(str, random.Random(3 + i).sample([j for j in range(6) if j != i], k=2)))) for i in range(25)]


@query(
    "seeded_choices",
    f"""
WITH o AS (SELECT * FROM {_values(_ORDERS)} v(n_nationkey, a, b, c)), d AS (SELECT * FROM {_values(_DRAWN)} v(n_nationkey, drawn))
SELECT n.n_nationkey, [n_name, 'none', 'all'][a + 1] || '|' || [n_name, 'none', 'all'][b + 1] || '|' || [n_name, 'none', 'all'][c + 1] AS options,
       CASE 0 WHEN a THEN 'A' WHEN b THEN 'B' ELSE 'C' END AS gold_label, drawn FROM nation n JOIN o USING (n_nationkey) JOIN d USING (n_nationkey)
""",
)
def seeded_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices in an order drawn by one generator for all rows, and exemplars drawn by one of each row."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("row_idx"), F.array(F.col("n_name"), F.lit("none"), F.lit("all")).alias("choices"))
    pool = F.array(*map(F.lit, range(6)))
    got = shuffles.shuffle_choices(n, "choices", 0, 3).withColumn("drawn", shuffles.sampled_rows("row_idx", pool, F.lit(2), F.lit(3)))
    drawn = F.array_join(F.transform("drawn", lambda x: x.cast("string")), ",").alias("drawn")
    return got.select(F.col("row_idx").cast("int").alias("n_nationkey"), F.array_join("options", "|").alias("options"), "gold_label", drawn)


@query("seeded_pairs", "SELECT p_partkey, true AS both, true AS marked FROM part")
def seeded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in an order that the first text seeds: both are there, and the mark says which comes first."""
    pair, first = shuffles.shuffle_pair(F.col("p_name"), F.col("p_brand"))
    got = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", pair.alias("pair"), first.alias("first"))
    both = F.array_sort("pair") == F.array_sort(F.array("p_name", "p_brand"))
    return got.select("p_partkey", both.alias("both"), (F.get("pair", 1 - F.col("first")) == F.col("p_name")).alias("marked"))


# Scores.


@query(
    "qa_exact",
    """
SELECT p_partkey, (p_partkey % 4 <> 3)::INT::DOUBLE AS em, CASE p_partkey % 4 WHEN 1 THEN 'unanswerable' WHEN 3 THEN 'no ' || p_name ELSE p_name END AS canonical,
       CASE WHEN p_partkey % 4 = 2 THEN 0 ELSE 1 END AS place, (p_partkey % 4 <> 3)::INT::DOUBLE AS best_em FROM part
""",
)
def qa_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match by normalised text, aliases of declining to answer, and the best of several references."""
    kind, name = F.col("p_partkey") % 4, F.col("p_name")
    said = _pick(kind, _of("The ", F.upper(name), "!"), F.lit("Cannot be answered."), _of(" a ", name, "\tthe"), _of("no ", name))
    gold = F.when(kind == 1, F.lit("No answer")).otherwise(name)
    other = F.lit(" zzz ")
    refs = F.when(kind == 2, F.array(gold, other, F.lit(""), gold)).otherwise(F.array(other, gold, F.lit(""), gold))
    p = table(spark, sf_dir, "part").select("p_partkey", said.alias("said"), gold.alias("gold"), qa_text.aliases(refs).alias("refs"))
    p = p.select("p_partkey", qa_text.exact_match(F.col("said"), F.col("gold")).alias("em"), qa_text.canonical(F.col("said")).alias("canonical"), qa_text.best(F.col("said"), F.col("refs")).alias("best"))
    return p.select("p_partkey", "em", "canonical", "best.place", F.col("best.em").alias("best_em"))


@query(
    "answer_labels",
    """
SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN '' ELSE chr(65 + (p_size % 4)) END AS hle,
       CASE p_partkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN '(B)' WHEN 2 THEN p_name WHEN 3 THEN '(C)' ELSE p_name || ' x' END AS bbh, (p_partkey % 5 < 4)::INT::DOUBLE AS short,
       CASE p_partkey % 3 WHEN 0 THEN '0,2' WHEN 1 THEN '' ELSE '1' END AS indices FROM part
""",
)
def answer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels after phrases or alone, answers in the shape of their targets, short answers, lists of integers."""
    kind, letter, name = F.col("p_partkey") % 5, F.char(65 + F.col("p_size") % 4), F.col("p_name")
    hle = _pick(kind, _of("I think the correct answer is (", letter, ")."), _of("Final answer: ", letter), _of("maybe Z; ", letter), F.lit("none of these"), _of("answer - d. No, Answer: ", letter))
    target = _pick(kind, F.lit("No"), F.lit("(A)"), name, F.lit("(C)"), name)
    bbh = _pick(kind, F.lit("Answer: Yes, no\nmore"), F.lit(" The answer is (B) or (C)"), _of("A: ", name, ".\nx"), F.lit("C"), _of(name, " x."))
    short = _pick(kind, _of("so the answer is ", F.upper(name)), _of("\\boxed{", name, "}"), _of("```\nx\nFinal answer: ", name, "\n```"), _of("x\n\n `", name, "`"), _of("other ", name))
    said = _pick(F.col("p_partkey") % 3, F.lit("2, 0 and 2; 7"), F.lit("None, or 1"), F.lit("1."))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", hle.alias("h"), target.alias("t"), bbh.alias("b"), short.alias("s"), said.alias("i"))
    found = F.array_join(F.transform(labels.indices(F.col("i"), F.lit(3)), lambda x: x.cast("string")), ",")
    return p.select("p_partkey", labels.hle_label(F.col("h")).alias("hle"), labels.bbh_answer(F.col("b"), F.col("t")).alias("bbh"), math_text.short_match("s", "p_name").alias("short"), found.alias("indices"))


@query(
    "text_helpers",
    r"""
SELECT p_partkey, 'uno dos ' || p_partkey AS headline, 'x = ' || p_size AS fenced, 'return ' || p_size AS humaneval, p_name || chr(39) || 's (a) "b" 3,000.5-day end, == h ==' AS wikitext,
       left('line\n' || p_name || ' and ' || p_type || ' more', 12) || '...' AS preview, p_brand || chr(10) || p_name AS lines, ' ' || p_name AS continuation FROM part
""",
)
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines without signs, code out of fences, undone tokenisation, previews, control characters as line ends."""
    key, size, name = _str("p_partkey"), _str("p_size"), F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        qa_text.headline_clean(_of("Uno, dos!  ", key, "...\n")).alias("headline"),
        text.livecodebench_code(_of("Here is it:\n```python\nx = ", size, "\n```\nand ```y```")).alias("fenced"),
        text.humaneval_code(_of("python\nreturn ", size, "\n```\nmore")).alias("humaneval"),
        text.wikitext(_of(name, ' \'s ( a ) " b " 3 @,@ 000 @.@ 5 @-@ day end , = = h = =')).alias("wikitext"),
        text.preview(_of("line\n", name, " and ", F.col("p_type"), " more"), 12).alias("preview"),
        qa_text.control_to_lines(_of("\u0001", F.col("p_brand"), "\u0002\u0007", name, "\u001f")).alias("lines"),
        text.continuation(F.when(F.col("p_partkey") % 2 == 0, name).otherwise(_of(" ", name))).alias("continuation"),
    )


@query("gold_numbers", "SELECT p_partkey, p_size::VARCHAR AS target, p_size || '000' AS normal, (p_partkey % 2 = 0) AS plus_equal FROM part")
def gold_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = _str("p_size")
    said = F.when(F.col("p_partkey") % 2 == 0, _of("so #### $", size, ",000.\n")).otherwise(_of("so #### ", size, "1"))
    gold = numeric.plus_normal(_of(" #### ", size, ",000"))
    return table(spark, sf_dir, "part").select("p_partkey", numeric.target_after_hashes(_of("a\n#### ", size)).alias("target"), gold.alias("normal"), (numeric.plus_normal(said) == gold).alias("plus_equal"))


_SIGNS = r"[\p{L}\p{N}_]+|[^\s\x1c-\x1f\x{85}\p{Z}\p{L}\p{N}_]"


def _grams(side: str, most: int) -> str:
    """Counts of a side's n-grams by document and order up to `most`, from t(doc_id, p, r)."""
    following = ", ".join(f"lead(w, {k}) OVER x AS w{k}" for k in range(1, most))
    grams = " ".join(f"WHEN {n} THEN " + " || chr(1) || ".join(["w", *(f"w{k}" for k in range(1, n))]) for n in range(1, most + 1))
    placed = f"SELECT doc_id, w, {following} FROM (SELECT doc_id, unnest({side}) AS w, unnest(range(len({side}))) AS i FROM t) WINDOW x AS (PARTITION BY doc_id ORDER BY i)"
    return f"(SELECT doc_id, n, g, count(*) AS c FROM (SELECT doc_id, n, CASE n {grams} END AS g FROM ({placed}), (SELECT unnest(range(1, {most + 1})) AS n)) WHERE g IS NOT NULL GROUP BY doc_id, n, g)"


@query(
    "bleu4_smoothed",
    f"""
WITH {_PAIRED},
t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(prediction), '{_SIGNS}') AS p, regexp_extract_all(lower(reference), '{_SIGNS}') AS r FROM p),
h AS (SELECT gp.n, sum(least(gp.c, gr.c))::DOUBLE AS correct FROM {_grams("p", 4)} gp JOIN {_grams("r", 4)} gr USING (doc_id, n, g) GROUP BY gp.n),
q AS (SELECT n, CASE WHEN n > 1 THEN 1 ELSE 0 END AS more, sum(greatest(len(p) - n + 1, 0))::DOUBLE AS guess FROM t, (SELECT unnest([1, 2, 3, 4]) AS n) GROUP BY n),
l AS (SELECT least(0, 1 - (sum(len(r))::DOUBLE + 1) / (sum(len(p))::DOUBLE + 1)) AS brevity FROM t)
SELECT round(exp(sum(ln(coalesce(correct, 0) + more + 2.2250738585072014e-308) - ln(guess + more + 2.2250738585072014e-308)) / 4 + any_value(brevity)) * 100, 9) AS bleu4 FROM q LEFT JOIN h USING (n), l
""",
)
def bleu4_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed corpus BLEU-4 of whole documents against their passages."""
    stats = _paired(spark, sf_dir).select(bleu.bleu4_stats("prediction", F.array("reference")).alias("s"))
    return stats.agg(F.round(bleu.bleu4(F.col("s")), DIGITS).alias("bleu4"))


@query(
    "rouge_n_scores",
    f"""
WITH {_PAIRED},
t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(prediction), '[a-z0-9]+') AS p, regexp_extract_all(lower(reference), '[a-z0-9]+') AS r FROM p),
h AS (SELECT gp.doc_id, gp.n, sum(least(gp.c, gr.c))::DOUBLE AS hits FROM {_grams("p", 2)} gp JOIN {_grams("r", 2)} gr USING (doc_id, n, g) GROUP BY gp.doc_id, gp.n),
f AS (SELECT t.doc_id, o.n, coalesce(hits, 0) / greatest(len(p) - o.n + 1, 1) AS pr, coalesce(hits, 0) / greatest(len(r) - o.n + 1, 1) AS re FROM t CROSS JOIN (SELECT unnest([1, 2]) AS n) o LEFT JOIN h ON h.doc_id = t.doc_id AND h.n = o.n)
SELECT doc_id, round(max(CASE WHEN n = 1 THEN CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END END), 9) AS rouge1,
       round(max(CASE WHEN n = 2 THEN CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END END), 9) AS rouge2 FROM f GROUP BY doc_id
""",
)
def rouge_n_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-1 and ROUGE-2 of whole documents against their passages, without stems."""
    r = _paired(spark, sf_dir).select("doc_id", rouge.rouge_column(F.col("prediction"), F.col("reference"), ("rouge1", "rouge2"), stemmed=False).alias("r"))
    return r.select("doc_id", *[F.round(f"r.{k}", DIGITS).alias(k) for k in ("rouge1", "rouge2")])


@query(
    "rouge_l_scores",
    """
WITH RECURSIVE t AS MATERIALIZED (
  SELECT a.item_id, regexp_extract_all(lower(a.text), '[a-z0-9]+') AS p, regexp_extract_all(lower(b.text), '[a-z0-9]+') AS r
  FROM benchmark a JOIN benchmark b ON b.item_id = (a.item_id + 1) % (SELECT count(*) FROM benchmark)),
i AS (SELECT item_id, unnest(r) AS w, unnest(range(1, len(r) + 1)) AS i FROM t),
j AS (SELECT item_id, unnest(p) AS w, unnest(range(1, len(p) + 1)) AS j FROM t),
m AS MATERIALIZED (SELECT item_id, j, row_number() OVER (PARTITION BY item_id ORDER BY i, j DESC) AS k FROM i JOIN j USING (item_id, w)),
x AS (SELECT item_id, 0::BIGINT AS k, []::BIGINT[] AS tails FROM t
      UNION ALL
      SELECT x.item_id, m.k, tails[1:len(list_filter(tails, lambda y: y < m.j))] || [m.j] || tails[len(list_filter(tails, lambda y: y < m.j)) + 2:] FROM x JOIN m ON m.item_id = x.item_id AND m.k = x.k + 1),
l AS (SELECT item_id, max(len(tails))::DOUBLE AS hits FROM x GROUP BY item_id)
SELECT item_id, round(2 * hits / (len(p) + len(r)), 9) AS rouge_l FROM t JOIN l USING (item_id)
""",
)
def rouge_l_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-L of passages against the next; in the SQL, the longest rising sequence of matching places."""
    b = table(spark, sf_dir, "benchmark")
    n = b.count()
    pairs = b.join(b.select(((F.col("item_id") - 1 + n) % n).alias("item_id"), F.col("text").alias("reference")), "item_id")
    return pairs.select("item_id", F.round(rouge.rouge_column(F.col("text"), F.col("reference"), ("rougeL",), stemmed=False)["rougeL"], DIGITS).alias("rouge_l"))


#: Tasks with, for item_id % 3 of 0, 1 and 2, what is answered, the reference and the score; {0} stands for a word of the item.
_LONG = {
    **dict.fromkeys(("qasper", "hotpotqa_e"), (("The {0}, x.", "a {0} x y", "z"), "{0} X", (1.0, 0.8, 0.0))),
    "triviaqa": (("\n{0} x\nz", "{0} x y\n{0}", "z\n{0} x"), "{0} X", (1.0, 0.8, 0.0)),
    "trec": (("it is {0}\nother", "{0} or other", "other"), "{0}", (1.0, 0.5, 0.0)),
    "passage_count": (("2 of 2", "2 or 3 or 2", "none"), "2", (1.0, 0.666666667, 0.0)),
    "passage_retrieval_en": (("Paragraph 5", "5 or 6", "6"), "Paragraph 5", (1.0, 0.5, 0.0)),
    "passage_retrieval_zh": (("段落5", "5 6", "x"), "段落5", (1.0, 0.5, 0.0)),
    "lcc": (("# c\nabcd\nz", "`x`\nabce", "// no"), "abcd", (1.0, 0.75, 0.0)),
    **dict.fromkeys(("gov_report", "samsum"), (("A {0} b", "a {0}", "z"), "a {0} b", (1.0, 0.8, 0.0))),
    "multifieldqa_zh": (("我爱。", "我爱他", "z"), "我爱", (1.0, 0.8, 0.0)),
    "dureader": (("ab，y", "ab x", "z"), "ab y", (1.0, 0.5, 0.0)),
}


@query(
    "longbench_scores",
    "SELECT item_id, task, CASE item_id % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE c END::DOUBLE AS score FROM benchmark, " + _values([(t, *x[2]) for t, x in _LONG.items()]) + " v(task, a, b, c)",
)
def longbench_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of long-context score, with answers that are right, partly right or wrong."""
    own = _of("w", _str("item_id"))
    put = lambda t: F.replace(F.lit(t), F.lit("{0}"), own)
    tasks = F.array(*[F.struct(F.lit(t).alias("task"), _pick(F.col("item_id") % 3, *map(put, said)).alias("said"), put(gold).alias("gold")) for t, (said, gold, _) in _LONG.items()])
    rows = table(spark, sf_dir, "benchmark").select("item_id", own.alias("own"), F.explode(tasks).alias("t")).select("item_id", "own", "t.*")
    got = longbench.longbench_score("task", "said", F.array(F.lit("qqq"), "gold"), F.array("own", F.lit("other"), F.lit("")))
    return rows.select("item_id", "task", F.round(got, DIGITS).alias("score"))


@query(
    "mlqa_scores",
    f"""
SELECT item_id, lang, (item_id % 3 = 0)::INT::DOUBLE AS em, CASE item_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.666666667 ELSE 0.0 END::DOUBLE AS f1, CASE WHEN item_id % 3 = 2 THEN 0 ELSE 1 END AS place
FROM benchmark, (SELECT unnest({list(mlqa.ARTICLES)}) AS lang)
""",
)
def mlqa_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language, with an article of its own where it has one; answers right, partly right or wrong."""
    article = {"en": "The ", "es": "los ", "vi": "những ", "de": "Den "}
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(*map(F.lit, mlqa.ARTICLES))).alias("lang"))
    before = F.coalesce(*[F.when(F.col("lang") == x, F.lit(a)) for x, a in article.items()], F.lit(""))
    word = F.when(F.col("lang") == "zh", F.lit("猫")).otherwise(_of("w", _str("item_id")))
    said = F.concat(before, _pick(F.col("item_id") % 3, _of(word, "."), _of(word, " q,"), F.lit("none")))
    got = rows.select("item_id", "lang", mlqa.mlqa_best(said, F.array(F.lit("zz"), word), "lang").alias("x"))
    return got.select("item_id", "lang", "x.em", F.round("x.f1", DIGITS).alias("f1"), "x.place")


_CHECKS_SQL = {
    "punctuation:no_comma": "NOT contains(t, ',')",
    "length_constraints:number_words": r"len(regexp_extract_all(t, '[\p{L}\p{N}_'']+')) >= 50",
    "length_constraints:number_sentences": r"trim(t) <> '' AND len(regexp_extract_all(regexp_replace(t, '^\s+|\s+$', '', 'g'), '[.!?]\s+')) + 1 >= 3",
    "length_constraints:number_paragraphs": r"len(list_filter(regexp_split_to_array(t, '\n\s*\n'), lambda x: trim(x, ' ' || chr(10)) <> '')) = 1",
    "keywords:existence": "contains(lower(t), 'the')",
    "keywords:frequency": "contains(lower(t), 'the')",
    "keywords:letter_frequency": "contains(lower(t), 'e')",
    "detectable_content:number_placeholders": r"regexp_matches(t, '\[[^\]]+\]')",
    "detectable_format:title": r"regexp_matches(t, '<<[^>]*[^>\s][^>]*>>')",
    "startend:end_checker": r"ends_with(regexp_replace(t, '\s+$', ''), '.')",
    "startend:quotation": "length(trim(t)) >= 2 AND starts_with(trim(t), '\"') AND ends_with(trim(t), '\"')",
    "change_case:english_lowercase": r"lower(t) = t AND regexp_matches(t, '\p{L}')",
}


@query(
    "instruction_strict",
    "WITH c AS (SELECT coalesce(text, '') AS t FROM conversations) " + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS turns, count(*) FILTER ({v}) AS strict FROM c" for k, v in _CHECKS_SQL.items()),
)
def instruction_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.lit('{"keyword": "the", "keywords": ["the"], "letter": "e", "num_words": 50, "num_sentences": 3, "num_paragraphs": 1, "end_phrase": "."}')
    each = table(spark, sf_dir, "conversations").select("text", F.explode(F.array(*map(F.lit, sorted(_CHECKS_SQL)))).alias("kind"))
    return each.withColumn("x", ifeval.followed("kind", "text", options)).groupBy("kind").agg(F.count(F.lit(1)).alias("turns"), F.count_if("x.strict").alias("strict"))


@query("choice_argmax", "SELECT vec_id, list_position(e, list_max(e)) - 1 AS best, len(list_filter(e, lambda x: x = list_max(e))) AS ties FROM (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 1)) AS e FROM embeddings)")
def choice_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the greatest of all values of an embedding, and how many are as great."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 1)).alias("e"))
    return e.select("vec_id", mc.argmax(F.col("e")).alias("best"), F.size(F.filter("e", lambda x: x == F.array_max("e"))).cast("bigint").alias("ties"))


@query(
    "row_perplexity",
    r"""
SELECT doc_id, round(exp(0.25 * w / greatest(w, 1)), 9) AS word_perplexity, round(0.25 * w / greatest(b, 1) / ln(2.0::DOUBLE), 9) AS bits_per_byte
FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x1c-\x1f\x{85}\p{Z}]+'), lambda x: x <> ''))::DOUBLE AS w, strlen(coalesce(text, ''))::DOUBLE AS b FROM documents)
""",
)
def row_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity by words and bits per byte of each row, from its own log-probability."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.token_count(_text()).alias("w"), text.byte_count(_text()).alias("b"))
    p = d.select("doc_id", metrics.row_perplexities(-0.25 * F.col("w"), F.greatest("w", F.lit(1)), F.greatest("b", F.lit(1))).alias("p"))
    return p.select("doc_id", *[F.round(f"p.{k}", DIGITS).alias(k) for k in ("word_perplexity", "bits_per_byte")])


# Runs.


def _sized(asked: DataFrame) -> DataFrame:
    """A scorer whose log-probabilities SQL can tell: by the length of what is continued, the row and the choice."""
    lp = -(F.length("continuation") + (F.col("row_idx") * 7 + F.col("choice_idx") * 3) % 5).cast("double") / 10
    return asked.select("row_idx", "choice_idx", lp.alias("logprob"), (F.col("row_idx") % 3 == 0).alias("is_greedy"), F.length("continuation").cast("int").alias("token_count"))


@query(
    "run_multiple_choice",
    """
WITH c AS (SELECT doc_id % 2 AS gold, -(3 + (doc_id * 7) % 5)::DOUBLE / 10 AS a, -(4 + (doc_id * 7 + 3) % 5)::DOUBLE / 10 AS b FROM documents)
SELECT 'boolq' AS suite, unnest(['acc,ll', 'acc,ll_avg']) AS metric, unnest([avg(((a < b)::INT = gold)::INT::DOUBLE), avg(((a / 3 < b / 4)::INT = gold)::INT::DOUBLE)]) AS value FROM c
""",
)
def run_multiple_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suite from rows to metrics, by log-likelihood of its choices."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), _text().alias("passage"), F.lit("is it").alias("question"), (F.col("doc_id") % 2).alias("label"))
    return evaluate(rows, get("boolq"), _sized).metrics.select("suite", "metric", "value")


@query(
    "run_rolling",
    r"""
WITH d AS (SELECT coalesce(text, '') AS t, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x1c-\x1f\x{85}\p{Z}]+'), lambda x: x <> '')) AS w FROM documents),
s AS (SELECT sum(w)::DOUBLE * -0.5 AS lp, sum(w)::DOUBLE AS w, sum(strlen(t))::DOUBLE AS b FROM d)
SELECT 'c4' AS suite, unnest(['word_perplexity', 'byte_perplexity', 'bits_per_byte']) AS metric, unnest([round(exp(-lp / w), 9), round(exp(-lp / b), 9), round(-lp / b / ln(2.0::DOUBLE), 9)]) AS value FROM s
""",
)
def run_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of texts that are scored window by window: every token costs 0.5, in whatever window it is."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), _text().alias("text"))
    windows = Windows(lambda c: F.transform(text.tokens(c), lambda x: F.length(x)), 64, 0)
    cost = lambda asked: asked.select("row_idx", "choice_idx", (F.size("continuation_ids") * -0.5).alias("logprob"), F.size("continuation_ids").alias("token_count"))
    return evaluate(rows, get("c4"), cost, windows=windows).metrics.select("suite", "metric", F.round("value", DIGITS).alias("value"))


@query(
    "run_single",
    """
WITH p AS (SELECT (p_partkey % 3 = 0)::INT::DOUBLE AS greedy, -(1 + length(split_part(p_name, ' ', -1)) + (p_partkey * 7) % 5)::DOUBLE / 10 AS lp FROM part)
SELECT 'lambada' AS suite, unnest(['acc,ll', 'ppl,ll']) AS metric, unnest([round(avg(greedy), 9), round(exp(-avg(lp)), 9)]) AS value FROM p
""",
)
def run_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_idx"), F.col("p_name").alias("text"))
    return evaluate(rows, get("lambada"), _sized).metrics.select("suite", "metric", F.round("value", DIGITS).alias("value"))


@query("run_generated", "SELECT 'gsm8k' AS suite, 'acc,num' AS metric, avg((p_partkey % 3 <> 0)::INT::DOUBLE) AS value FROM part")
def run_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded generations, cut at their stops, against gold numbers."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("row_idx"), F.col("p_name").alias("question"), _of("work\n#### ", _str("p_size")).alias("answer"))
    said = _pick(F.col("p_partkey") % 3, F.lit("I don't know"), _of("The answer is ", _str("p_size"), ".0\n\nQuestion: 77"), _of("it is ", _str("p_size")))
    return evaluate(rows, get("gsm8k"), recorded(p.select(F.col("p_partkey").alias("row_idx"), said.alias("text")))).metrics.select("suite", "metric", "value")


@query(
    "run_summaries",
    """
SELECT 'noticia' AS suite, unnest(['rouge1', 'average_len']) AS metric,
       unnest([round(avg(CASE p_partkey % 2 WHEN 0 THEN 1.0 ELSE 0.8 END::DOUBLE), 9), round(avg(CASE p_partkey % 2 WHEN 0 THEN 2.0 ELSE 3.0 END::DOUBLE), 9)]) AS value FROM part
""",
)
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = table(spark, sf_dir, "part"), _str("p_partkey")
    rows = p.select(F.col("p_partkey").alias("row_idx"), F.col("p_brand").alias("web_headline"), F.col("p_type").alias("web_text"), _of("Verdad w", key, ".").alias("summary"))
    said = F.when(F.col("p_partkey") % 2 == 0, _of("VERDAD, w", key, "\nmore")).otherwise(_of("verdad w", key, " pura"))
    found = evaluate(rows, get("noticia"), recorded(p.select(F.col("p_partkey").alias("row_idx"), said.alias("text")))).metrics
    return found.select("suite", "metric", F.round("value", DIGITS).alias("value"))


# Streams.


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file as a stream."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query("stream_windows", "SELECT date_trunc('hour', ts) AS began, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour of event time, with a watermark, drained from a stream."""
    got = scoring.drain(scoring.windowed_counts(_stream(spark, sf_dir, "events")), "gaugery_windows")
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("began"), "event_type", "n", F.round("total", 6).alias("total"))


@query("stream_running_mean", "SELECT event_type, count(*) AS samples, round(avg(value), 9) AS mean, count(*) FILTER (value < 1) AS invalid FROM events GROUP BY event_type")
def stream_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples so far, their mean and the invalid ones, by key, when the stream has been read."""
    events = _stream(spark, sf_dir, "events").withColumn("invalid", F.col("value") < 1)
    got = scoring.drain(scoring.running_mean(events, ["event_type"], "value"), "gaugery_means")
    return got.withColumn("mean", F.round("mean", DIGITS))
