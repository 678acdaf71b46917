"""Queries that write a small table as a file of some kind and read it again, with the SQL on the table itself.

The tables are `nation` and `region`, which have 25 and 5 rows at every scale; the driver makes the files from them.
"""

from __future__ import annotations

import base64
import csv
import gzip
import hashlib
import io
import json
import pickle
import tarfile
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugery.operators import reshape
from gaugery.plans import registry, spec_run
from gaugery.plans.more_queries import _of, _sized, _str, _text
from gaugery.plans.queries import DIGITS, table
from gaugery.scratch import materialise, put
from gaugery.sources import readers, sinks
from gaugery.sources.readers import Source, read
from gaugery.streaming import scoring

NAMES: list[str] = []
_NATION = "SELECT n_nationkey, n_name FROM nation"


def query(name: str, sql: str | None = None):
    NAMES.append(name)
    return registry.query(name, sql)


def _nations(spark: SparkSession, sf_dir: str) -> list[dict]:
    """The rows of `nation`, 25 at every scale, with their region's name."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return [r.asDict() for r in n.orderBy("n_nationkey").collect()]


def _zip(spark: SparkSession, **members: str) -> str:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "."), text)
    return put(spark, "a.zip", data.getvalue())


def _tar(spark: SparkSession, mode: str, **members: str) -> str:
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode=mode) as t:
        for name, text in members.items():
            info = tarfile.TarInfo(name.replace("__", "."))
            info.size = len(text.encode())
            t.addfile(info, io.BytesIO(text.encode()))
    return put(spark, "a.tar", data.getvalue())


def _lines(rows: list[dict]) -> str:
    return "".join(json.dumps({"n_nationkey": r["n_nationkey"], "n_name": r["n_name"]}) + "\n" for r in rows)


@query("file_json_lines", _NATION)
def file_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines in several files, given as a list."""
    rows = _nations(spark, sf_dir)
    paths = [put(spark, "a.jsonl", _lines(rows[:9]).encode()), put(spark, "b.jsonl.gz", gzip.compress(_lines(rows[9:]).encode()))]
    return read(spark, Source(paths, "json", "n_nationkey int, n_name string"))


@query("file_json_lines_in_zip", _NATION)
def file_json_lines_in_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _zip(spark, test__jsonl=_lines(_nations(spark, sf_dir)), other__txt="x")
    return read(spark, Source(path, "jsonl_in_archive", "n_nationkey int, n_name string")).select("n_nationkey", "n_name")


@query("file_json_lines_in_bz2", _NATION)
def file_json_lines_in_bz2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a tar archive that bzip2 has packed."""
    rows = _nations(spark, sf_dir)
    path = _tar(spark, "w:bz2", a__jsonl=_lines(rows[::2]), b__jsonl=_lines(rows[1::2]))
    return read(spark, Source(path, "jsonl_in_archive", "n_nationkey int, n_name string")).select("n_nationkey", "n_name")


@query("file_csv_in_zip", "SELECT n_nationkey, n_name, 'a, \"' || n_name || '\"' || chr(10) || 'b' AS note FROM nation")
def file_csv_in_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV by the names of its header, with quotes and line ends inside of fields."""
    data = io.StringIO()
    w = csv.writer(data)
    w.writerow(["note", "n_name", "n_nationkey"])
    w.writerows([f'a, "{r["n_name"]}"\nb', r["n_name"], r["n_nationkey"]] for r in _nations(spark, sf_dir))
    return read(spark, Source(_zip(spark, t__csv=data.getvalue()), "csv_in_archive", "n_nationkey int, n_name string, note string")).select("n_nationkey", "n_name", "note")


@query("file_csv_groups_in_tar", "SELECT n_nationkey // 4 AS group_id, count(*) AS members, min(n_name) AS first_name FROM nation GROUP BY ALL")
def file_csv_groups_in_tar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV in a tar archive, its rows grouped by fours in their order."""
    text = "n_name\n" + "".join(f"{r['n_name']}\n" for r in _nations(spark, sf_dir))
    rows = read(spark, Source(_tar(spark, "w", t__csv=text), "csv_in_archive", "n_name string")).withColumn("group_id", reshape.fixed_groups(F.col("line_no"), 4))
    return rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"), F.min("n_name").alias("first_name"))


@query("file_json_array", "SELECT n_nationkey, n_name, 'zip' AS kind FROM nation UNION ALL SELECT n_nationkey, n_name, 'plain' FROM nation")
def file_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of objects, plain and in an archive."""
    text = json.dumps([{"n_nationkey": r["n_nationkey"], "n_name": r["n_name"]} for r in _nations(spark, sf_dir)])
    schema = "n_nationkey int, n_name string"
    plain = read(spark, Source(put(spark, "a.json", text.encode()), "json_array", schema)).withColumn("kind", F.lit("plain"))
    zipped = read(spark, Source(_zip(spark, a__json=text), "json_array_in_archive", schema)).withColumn("kind", F.lit("zip"))
    return plain.unionByName(zipped.select(*plain.columns))


@query("file_json_by_id", "SELECT n_nationkey::VARCHAR AS id, n_name, 'zip' AS kind FROM nation UNION ALL SELECT n_nationkey::VARCHAR, n_name, 'plain' FROM nation")
def file_json_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of rows by id, plain and in an archive."""
    text = json.dumps({str(r["n_nationkey"]): {"n_name": r["n_name"]} for r in _nations(spark, sf_dir)})
    plain = read(spark, Source(put(spark, "a.json", text.encode()), "json_by_id", "n_name string")).withColumn("kind", F.lit("plain"))
    zipped = read(spark, Source(_zip(spark, a__json=text), "json_by_id_in_archive", "n_name string")).withColumn("kind", F.lit("zip"))
    return plain.unionByName(zipped.select(*plain.columns))


_SQUAD = "SELECT r_name AS title, n_name AS context, n_nationkey::VARCHAR AS id, 'Which?' AS question, r_name AS answers, kind FROM region JOIN nation ON r_regionkey = n_regionkey, (VALUES ('zip'), ('tar')) v(kind)"


@query("file_nested_json", _SQUAD)
def file_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON in a zip and in a tar archive that gzip has packed, flattened to questions."""
    by: dict[str, list] = {}
    for r in _nations(spark, sf_dir):
        qa = {"id": str(r["n_nationkey"]), "question": "Which?", "answers": [{"text": r["r_name"]}]}
        by.setdefault(r["r_name"], []).append({"context": r["n_name"], "qas": [qa]})
    text = json.dumps({"data": [{"title": k, "paragraphs": v} for k, v in by.items()]})
    schema = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string>>>>>>>>"
    parts = []
    for kind, path in (("zip", _zip(spark, a__json=text)), ("tar", _tar(spark, "w:gz", a__json=text))):
        parts.append(reshape.flatten_squad(read(spark, Source(path, "json_in_archive", schema))).withColumn("answers", F.array_join("answers", "|")).withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1])


@query("file_xml_in_zip", "SELECT r_regionkey::INT AS region, r_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY ALL")
def file_xml_in_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An XML document with repeated elements and attributes."""
    by: dict[tuple, list] = {}
    for r in _nations(spark, sf_dir):
        by.setdefault((r["r_regionkey"], r["r_name"]), []).append(r["n_name"])
    body = "".join(f'<Region id="{k}"><Name>{n}</Name>{"".join(f"<Nation>{x}</Nation>" for x in names)}</Region>' for (k, n), names in by.items())
    doc = read(spark, Source(_zip(spark, a__xml=f'<?xml version="1.0"?><Set>{body}</Set>'), "xml_in_archive", "Region array<struct<_id:int,Name:string,Nation:array<string>>>"))
    return doc.select(F.explode("Region").alias("r")).select(F.col("r._id").alias("region"), F.col("r.Name").alias("r_name"), F.array_join("r.Nation", ",").alias("names"))


@query("file_parallel_lines", "SELECT n_nationkey, n_name AS source, r_name AS target, kind FROM region JOIN nation ON r_regionkey = n_regionkey, (VALUES ('plain'), ('tar')) v(kind)")
def file_parallel_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files, line by line, plain and as members of an archive."""
    rows = _nations(spark, sf_dir)
    one, two = ("".join(f"{r[c]}\n" for r in rows) for c in ("n_name", "r_name"))
    plain = read(spark, Source([put(spark, "a.txt", one.encode()), put(spark, "b.txt", two.encode())], "parallel_lines")).withColumnRenamed("row_idx", "n_nationkey").withColumn("kind", F.lit("plain"))
    packed = read(spark, Source(_tar(spark, "w:gz", x__en=one, x__es=two), "parallel_lines_in_archive", None, {"source": r"\.en$", "target": r"\.es$"}))
    both = plain.unionByName(packed.withColumnRenamed("line_no", "n_nationkey").withColumn("kind", F.lit("tar")))
    return both.withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@query("file_text_blocks", "SELECT n_name AS label, 'in ' || r_name AS context, 'Which?' AS question, n_name || '|' || r_name AS options FROM region JOIN nation ON r_regionkey = n_regionkey")
def file_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of text parted by blank lines."""
    text = "\n\n".join(f"{r['n_name']}\nin {r['r_name']}\nWhich?\nA.{r['n_name']}\nB.{r['r_name']}" for r in _nations(spark, sf_dir))
    return read(spark, Source(put(spark, "a.txt", text.encode()), "blocks")).withColumn("options", F.array_join("options", "|"))


@query("file_workbook", "SELECT n_nationkey::VARCHAR AS key, n_name FROM nation")
def file_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook's first sheet, with shared strings and an empty cell between."""
    n, rows = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', _nations(spark, sf_dir)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {n}>" + "".join(f"<si><t>{r['n_name']}</t></si>" for r in rows) + "</sst>")
        cells = "".join(f'<row><c r="A{i}"><v>{r["n_nationkey"]}</v></c><c r="C{i}" t="s"><v>{i}</v></c></row>' for i, r in enumerate(rows))
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {n}><sheetData>{cells}</sheetData></worksheet>")
    got = read(spark, Source(put(spark, "a.xlsx", data.getvalue()), "xlsx"))
    return got.select(F.get("cells", F.lit(0)).alias("key"), F.get("cells", F.lit(2)).alias("n_name"))


@query("file_arrow_cache", _NATION)
def file_arrow_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An Arrow stream as caches of data sets hold them, with a further column that isn't asked for."""
    rows = _nations(spark, sf_dir)
    t = pa.table({"x": [1.5] * len(rows), "n_name": [r["n_name"] for r in rows], "n_nationkey": pa.array([r["n_nationkey"] for r in rows], pa.int64())})
    data = io.BytesIO()
    with pa.ipc.new_stream(data, t.schema) as w:
        w.write_table(t, 10)
    return read(spark, Source(put(spark, "a.arrow", data.getvalue()), "arrow_file", "n_nationkey int, n_name string", {"newest": "true"}))


@query("file_hidden_tests", "SELECT n_nationkey, n_name AS input, r_name AS output FROM region JOIN nation ON r_regionkey = n_regionkey")
def file_hidden_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests as JSON, or wrapped by pickle, zlib and base64."""

    def held(r: dict) -> str:
        text = json.dumps([{"input": r["n_name"], "output": r["r_name"], "testtype": "stdin"}])
        return text if r["n_nationkey"] % 2 else base64.b64encode(zlib.compress(pickle.dumps(text))).decode()

    rows = spark.createDataFrame([(r["n_nationkey"], held(r)) for r in _nations(spark, sf_dir)], "n_nationkey int, tests string")
    return rows.select("n_nationkey", F.explode(readers.hidden_tests_column("tests")).alias("t")).select("n_nationkey", "t.input", "t.output")


@query("file_checked_archive", "SELECT count(*) AS rows_read, true AS refused FROM nation")
def file_checked_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive whose digest is said is read, one with another digest or a member outside its folder isn't."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.jsonl", _lines(_nations(spark, sf_dir)))
    good = hashlib.sha256(data.getvalue()).hexdigest()
    path = put(spark, "a.zip", data.getvalue())
    refused = not readers.safe_member("../x") and not readers.safe_member("/x")
    try:
        readers.checked(data.getvalue(), "0" * 64)
        refused = False
    except ValueError:
        pass
    got = read(spark, Source(path, "jsonl_in_archive", "n_nationkey int", {"sha256": good}))
    return got.agg(F.count(F.lit(1)).alias("rows_read")).withColumn("refused", F.lit(refused))


# Sinks, specifications, streams of requests.


@query("sink_document", "SELECT r_name AS suite, 'nations' AS metric, count(*)::DOUBLE AS value, 'm' AS model FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def sink_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as one JSON document, read again; its form as a script and as a table is made as well."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    found = n.groupBy(F.col("r_name").alias("suite")).agg(F.lit("nations").alias("metric"), F.count(F.lit(1)).cast("double").alias("value"))
    document = sinks.result_document(found, {"model": "m", "versions": spec_run.versions(spark)})
    if "spark" not in document["versions"] or len(sinks.render(document["tests"]).split("\n")) != 2 + len(document["tests"]) or "spec_run.run" not in spec_run.as_python({"tests": []}):
        raise ValueError("a document without its parts")
    path = put(spark, "a.json", json.dumps(document).encode())
    got = read(spark, Source(path, "json_array", "model string, tests array<struct<name:string,metrics:map<string,double>>>"))
    each = got.select("model", F.explode("tests").alias("t")).select("model", F.col("t.name").alias("suite"), F.explode("t.metrics").alias("metric", "value"))
    return each.select("suite", "metric", "value", "model")


@query(
    "run_specification",
    """
WITH c AS (SELECT count(*) AS n, avg((doc_id % 2 = 0)::INT::DOUBLE) AS acc, avg((-(1 + doc_id % 5)::DOUBLE / 10)) AS lp FROM documents WHERE doc_id < 150)
SELECT 'lambada' AS suite, unnest(['acc,ll', 'ppl,ll']) AS metric, unnest([round(acc, 9), round(exp(-lp), 9)]) AS value FROM c
""",
)
def run_specification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A specification with recorded outputs, a cap and an order, from its text to the metrics of its document."""
    outputs = table(spark, sf_dir, "documents").filter("doc_id < 150").select(
        F.col("doc_id").alias("row_idx"), F.lit(0).alias("choice_idx"), (-(1 + F.col("doc_id") % 5).cast("double") / 10).alias("logprob"), (F.col("doc_id") % 2 == 0).alias("is_greedy"), F.lit(1).alias("token_count")
    )
    at = materialise(outputs, "outputs").inputFiles()[0].rsplit("/", 1)[0]
    rows = materialise(table(spark, sf_dir, "documents").select("doc_id", _of(F.lit("a b "), _str("doc_id")).alias("text")).coalesce(1).sortWithinPartitions("doc_id"), "rows").inputFiles()[0].rsplit("/", 1)[0]
    spec = spec_run.load(json.dumps({"engine": {"type": "recorded", "outputs": at}, "model": {"label": "m"}, "tests": [{"type": "lambada", "path": rows, "max_rows": 150, "order": "length|desc"}]}))
    results, document = spec_run.run(spark, spec)
    if results[0].samples.agg(F.max("exec_pos")).first()[0] != 149 or len(document["tests"]) != 1:
        raise ValueError("an order without its places")
    return results[0].metrics.select("suite", "metric", F.round("value", DIGITS).alias("value"))


@query("stream_scored", "SELECT doc_id AS row_idx, -(length(coalesce(text, '')) + (doc_id * 7) % 5)::DOUBLE / 10 AS logprob, doc_id % 3 = 0 AS is_greedy FROM documents")
def stream_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as a stream of files, scored batch by batch as they come."""
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), F.lit(0).alias("choice_idx"), F.lit("").alias("context"), _text().alias("continuation"))
    files = materialise(asked.repartition(6, "row_idx"), "requests")
    at = files.inputFiles()[0].rsplit("/", 1)[0]
    stream = scoring.request_stream(spark, at, files.schema.simpleString()[7:-1].replace(":", " "), 2)
    out, ck = put(spark, "_made", b""), put(spark, "_made", b"")
    scoring.score_stream(stream, _sized, f"{out}/outputs", f"{ck}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/outputs").select("row_idx", "logprob", "is_greedy")


