"""The queries op1 to op10 over the supplied tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugery.llm import exact_dedup, language_id, mixing, near_dedup, packing, quality_rules, substring_dedup, toxicity, url_filter, warc
from gaugery.llm.common import held_out, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, learnable=~held_out())
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "second", "ambiguous")


#: Names of folders and pairs of words in names of hosts that are blocked where no host rule fits.
URL_FOLDERS = "casino login porn signup wp-admin xxx".split()
URL_FIRST = "best buy cheap click daily discount easy fast free get hot instant live lucky mega my new now online quick real spam super top win your".split()
URL_SECOND = "bets bonus cash casino coupons credit crypto dating deals diet farm followers forex gifts girls jackpot leads links loans lottery meds money pharmacy pills poker prizes replica slots spins traffic viagra watches".split()
#: The host rules; the patterns are made of the words above, with a hyphen or without, in any label of a name.
URL_RULES = [
    url_filter.Rule("block", "net/"),
    url_filter.Rule("allow", "example.net/en/"),
    url_filter.Rule("block", "example.com/de/"),
    url_filter.Rule("allow", "org/fr/"),
    *[url_filter.Rule("block", f"*/{p}/*", glob=True) for p in URL_FOLDERS],
    *[url_filter.Rule("block", f"{lead}{a}{gap}{b}.*", glob=True) for a in URL_FIRST for b in URL_SECOND for gap in ("-", "") for lead in ("", "*.")],
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "pattern", "verdict")


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


OP3_SQL = (
    """
WITH n AS (SELECT unnest(FIRST) AS f), s AS (SELECT unnest(SECOND) AS s),
v AS (
  SELECT '*/' || unnest(FOLDERS) || '/*' AS g, NULL AS p
  UNION ALL SELECT l || f || h || s || '.*', f || h || s FROM n, s, (VALUES ('-'), ('')) a(h), (VALUES (''), ('*.')) b(l)),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM a),
c AS (
  SELECT page_id, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1), '') AS path FROM b),
d AS (
  SELECT *, CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/'
                 END AS rule FROM c),
u AS (SELECT DISTINCT host || path AS url FROM c),
m AS (
  SELECT url, arg_max(g, (length(g), g)) AS pattern FROM u, v
  WHERE CASE WHEN p IS NULL THEN contains(url, replace(g, '*', '')) WHEN starts_with(g, '*') THEN contains(url, '.' || p || '.') ELSE starts_with(url, p || '.') END GROUP BY url)
SELECT page_id, host, path, rule, pattern,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM d LEFT JOIN m ON d.host || d.path = m.url
""".replace("FIRST", _list(URL_FIRST)).replace("SECOND", _list(URL_SECOND)).replace("FOLDERS", _list(URL_FOLDERS))
)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    page = F.get(F.filter("headers", lambda x: x["name"] == "X-Page-ID"), F.lit(0))["value"].cast("bigint").alias("page_id")
    return made.select(page, *warc.FIELDS, F.to_json("headers").alias("headers"), F.decode("block", "UTF-8").alias("text"), "block_digest", "payload_digest")


_COMMON_SQL = "[" + ", ".join(f"'{w}'" for w in quality_rules.COMMON) + "]"
OP8_SQL = (
    r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, lang, t, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, regexp_replace(t, '[a-z\x20\x09-\x0D]+', '', 'g') AS rest,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, unnest(range(1, n_words - 1)) AS i, w FROM m WHERE n_words >= 3),
q AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
k AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM q, (VALUES (0), (1), (2)) v(j) WHERE n > 1 GROUP BY doc_id),
b AS (
  SELECT m.doc_id, lang, w, rest, n_words, word_chars, length(regexp_replace(rest, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(rest, '[^A-Z]', '', 'g')) AS upper_, length(regexp_replace(rest, '[^0-9]', '', 'g')) AS digit,
         length(regexp_replace(rest, '[^\x00-\x7f]', '', 'g')) AS plain FROM m LEFT JOIN k USING (doc_id)),
h AS (
  SELECT doc_id, lang, 'c' AS h, unnest(['a', 'b', 'c', 'd', 'e', 'f']) AS bin,
         unnest([word_chars - length(rest), upper_, digit, n_symbols, plain - upper_ - digit - n_symbols, length(rest) - plain]) AS n FROM b
  UNION ALL
  SELECT doc_id, lang, 'w', CASE WHEN list_contains(COMMON, x) THEN x ELSE '' END, count(*) FROM (SELECT doc_id, lang, unnest(w) AS x FROM b) GROUP BY ALL),
r AS (SELECT lang, h, bin, sum(n) AS n FROM h WHERE lang IS NOT NULL GROUP BY ALL UNION ALL SELECT NULL, h, bin, sum(n) FROM h GROUP BY ALL),
rt AS (SELECT lang, h, sum(n)::DOUBLE AS total FROM r GROUP BY ALL),
ht AS (SELECT doc_id, any_value(lang) AS lang, h, sum(n)::DOUBLE AS total FROM h GROUP BY doc_id, h HAVING sum(n) > 0),
u AS (
  SELECT ht.doc_id, ht.h, coalesce(h.n, 0) / ht.total AS p, r.n / rt.total AS q
  FROM ht JOIN rt ON ht.h = rt.h AND ht.lang IS NOT DISTINCT FROM rt.lang JOIN r ON r.h = ht.h AND r.lang IS NOT DISTINCT FROM ht.lang
  LEFT JOIN h ON h.doc_id = ht.doc_id AND h.h = ht.h AND h.bin = r.bin WHERE rt.total > 0),
j AS (SELECT doc_id, h, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS js FROM u GROUP BY ALL),
z AS (SELECT doc_id, sum(js) / 2 AS js FROM j GROUP BY doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b LEFT JOIN z USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (n_words < LEAST_WORDS OR coalesce(js, 0) <= MOST_DISTANCE) AS kept FROM f
""".replace("COMMON", _COMMON_SQL).replace("LEAST_WORDS", str(quality_rules.LEAST_WORDS)).replace("MOST_DISTANCE", str(quality_rules.MOST_DISTANCE))
)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out()).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    model = toxicity.fit(labels, docs.filter(~held_out()).withColumnRenamed("doc_id", "id"))
    return toxicity.predict(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weight=mixing.full_texts)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) WHEN len(w) = 1 THEN w ELSE [] END AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS low FROM documents UNION SELECT l.b, r.low FROM r JOIN l ON r.id = l.a WHERE r.low < l.b),
c AS (SELECT id, min(low) AS component_id FROM r GROUP BY id)
SELECT g.doc_id, len(g.g) AS n_shingles, c.component_id, g.doc_id = c.component_id AS kept FROM g JOIN c ON g.doc_id = c.id
"""


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(table(spark, sf_dir, "documents"), shingle=2)


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size * CASE WHEN size >= 50 THEN 2 ELSE 1 END)::BIGINT::DOUBLE AS weighed,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source),
r AS (SELECT *, source_size * 2 AS cap, (source_size * 2)::DOUBLE / w AS ratio FROM s),
l AS (
  SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS place,
         (1.5 * (sum(source_size) OVER ())::BIGINT::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT::DOUBLE)
         / (sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT::DOUBLE AS level
  FROM r),
f AS (SELECT min(place) AS place FROM l WHERE ratio > level),
t AS (
  SELECT l.source, l.source_size, l.weighed,
         CASE WHEN l.place >= f.place THEN l.w * (SELECT level FROM l l2 WHERE l2.place = f.place) ELSE l.cap::DOUBLE END AS target
  FROM l, f),
c AS (
  SELECT d.doc_id, d.source, d.size, d.u, t.source_size, t.target, coalesce(least(2.0::DOUBLE, t.target / nullif(t.weighed, 0) * CASE WHEN size >= 50 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END), 0) AS due
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, floor(due)::BIGINT AS whole, due - floor(due) AS f FROM c),
o AS (SELECT *, (u / (1 - u)) * CASE WHEN due < 2 THEN CASE WHEN f > 0 THEN (1 - f) / f ELSE 1e15 END END AS odds, target - sum(whole * size) OVER (PARTITION BY source) AS need FROM k),
q AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM o),
g AS (SELECT source, need - coalesce(max(run) FILTER (run <= need AND odds IS NOT NULL), 0) AS gap FROM q GROUP BY source, need),
b AS (
  SELECT q.source, arg_min(q.doc_id, (abs(q.size - g.gap), q.odds, q.doc_id)) AS fill
  FROM q JOIN g ON q.source IS NOT DISTINCT FROM g.source
  WHERE q.odds IS NOT NULL AND q.run > q.need AND q.need > 0 AND q.size > 0 AND abs(q.size - g.gap) < g.gap GROUP BY q.source),
e AS (
  SELECT q.*, CASE WHEN q.odds IS NOT NULL AND q.need > 0 AND (q.run <= q.need OR q.doc_id = b.fill) THEN 1 ELSE 0 END AS extra
  FROM q LEFT JOIN b ON q.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target, whole + extra AS copies, (whole + extra) * size AS taken FROM e
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_language_id": op2_language_id,
        "op3_url_filter": op3_url_filter,
        "op4_toxicity": op4_toxicity,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_near_dedup": op6_near_dedup,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_mixing": op9_mixing,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op6_near_dedup": OP6_SQL, "op8_quality_rules": OP8_SQL, "op9_mixing": OP9_SQL}
