"""The queries opN_<name>, thin over the operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haloforge.llm import brown, chunkdedup, decontam, divergence, linededup, nearcopies, packing, pii, quality, store, tokenfile, toxicity, urlrules, vectorcodes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_shingles")


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "token-file")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return tokenfile.read_tokens(spark, path)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_pages(table(spark, sf_dir, "pages"), urlrules.rules_table(spark, urlrules.RULES))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunkdedup.repeated_stretches(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum("n_words").alias("n_words"), F.min("first_doc_id").alias("first_doc_id"), spans.alias("spans"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_near_copies": op2_near_copies,
    "op3_token_file": op3_token_file,
    "op4_decontamination": op4_decontamination,
    "op5_quality": op5_quality,
    "op6_url_filter": op6_url_filter,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_personal_data": op9_personal_data,
    "op10_repeats": op10_repeats,
    "op11_vector_codes": op11_vector_codes,
    "op12_source_divergence": op12_source_divergence,
    "op13_class_model": op13_class_model,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"



def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _attribute(name: str) -> str:
    return "concat(" + ", ".join(f"regexp_extract(tag, {_q(urlrules.ATTRIBUTE.format(name))}, {k})" for k in (1, 2, 3)) + ")"


def _low(e: str) -> str:
    return f"translate({e}, '{_UPPER}', '{_LOWER}')"


def _dots(path: str) -> str:
    folded = f"array_to_string(list_reduce(list_transform(string_split({path}, '/'), lambda x: [x]), lambda a, b: CASE WHEN b[1] = '.' THEN a WHEN b[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] ELSE list_concat(a, b) END), '/')"
    return f"CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN {folded} || '/' ELSE {folded} END"


_NAME = (
    "CASE WHEN regexp_matches({u}, '(?s)^[^:/?#]+://[^/?#]*') THEN "
    + _low("regexp_extract({u}, '(?s)^([^:/?#]+://[^/?#]*)', 1)")
    + " || CASE WHEN starts_with(regexp_extract({u}, '(?s)^[^:/?#]+://[^/?#]*([^#]*)', 1), '/') THEN '' ELSE '/' END || regexp_extract({u}, '(?s)^[^:/?#]+://[^/?#]*([^#]*)', 1)"
    + " ELSE regexp_extract({u}, '(?s)^([^#]*)', 1) END"
)
_HOST = "coalesce(" + _low("regexp_extract(CASE WHEN {u} LIKE '%://%' THEN substr({u}, instr({u}, '://') + 3) END, '(?s)^([^/?#]*)', 1)") + ", '')"
_PATH = "coalesce(regexp_extract(CASE WHEN {u} LIKE '%://%' THEN substr({u}, instr({u}, '://') + 3) END, '(?s)^[^/?#]*([^?#]*)', 1), '')"
_URL_SQL = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, {_NAME.format(u="url")} AS name, {_HOST.format(u="url")} AS host, {_PATH.format(u="url")} AS path FROM pages
), tags AS (
  SELECT url AS src, unnest(regexp_extract_all(html, {_q(urlrules.TAG)})) AS tag FROM pages WHERE url LIKE '%://%'
), found AS (
  SELECT src, replace(regexp_replace(CASE WHEN {_low("substr(tag, 1, 5)")} = '<link' THEN CASE WHEN regexp_matches({_attribute("rel")}, {_q(urlrules.CANONICAL)}) THEN {_attribute("href")} END
    WHEN {_low("trim(" + _attribute("http-equiv") + ")")} = 'refresh' THEN regexp_extract({_attribute("content")}, {_q(urlrules.REFRESH)}, 1) END, {_q(urlrules.AROUND)}, '', 'g'), '&amp;', '&') AS t FROM tags
), parts AS (
  SELECT src, t, regexp_extract(t, '(?s)^([^?#]*)', 1) AS path, regexp_extract(t, '(?s)^[^?#]*(.*)$', 1) AS after, regexp_extract(src, '(?s)^([^:/?#]+://[^/?#]*)', 1) AS root,
    CASE regexp_extract(src, '(?s)^[^:/?#]+://[^/?#]*(/[^?#]*/|/)', 1) WHEN '' THEN '/' ELSE regexp_extract(src, '(?s)^[^:/?#]+://[^/?#]*(/[^?#]*/|/)', 1) END AS folder FROM found WHERE t <> ''
), l AS (
  SELECT src, CASE WHEN regexp_matches(t, '{urlrules.SCHEME}') THEN t WHEN starts_with(t, '//') THEN regexp_extract(src, '({urlrules.SCHEME})//', 1) || t
    WHEN starts_with(t, '?') THEN regexp_extract(src, '(?s)^([^?#]*)', 1) || t WHEN starts_with(t, '#') THEN src
    WHEN starts_with(t, '/') THEN root || {_dots("path")} || after ELSE root || {_dots("(folder || path)")} || after END AS dst FROM parts
), e AS (SELECT {_NAME.format(u="src")} AS a, {_NAME.format(u="dst")} AS b FROM l WHERE dst LIKE '%://%'
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), reach AS (SELECT a AS name, b AS other FROM both_ways UNION SELECT reach.name, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other
), rules AS (
  SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(verdict, rule_host, rule_path)
), linked AS (SELECT DISTINCT name, {_HOST.format(u="name")} AS host, {_PATH.format(u="name")} AS path FROM both_ways t(name, other)
), places AS (SELECT host, path FROM p UNION SELECT host, path FROM linked
), fits AS (
  SELECT host, path, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, verdict) AS k
  FROM places JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), best AS (SELECT host, path, rule, verdict FROM fits WHERE k = 1
), bad AS (SELECT name FROM linked JOIN best USING (host, path) WHERE verdict = 'block'
), aliased AS (SELECT DISTINCT reach.name FROM reach JOIN bad ON bad.name = reach.other)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict, CASE WHEN aliased.name IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN best ON best.host = p.host AND best.path = p.path LEFT JOIN aliased ON aliased.name = p.name
"""



def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """A pair of tables for each round: codes found with the books before, books made of those codes."""
    found = (
        "x{k} AS MATERIALIZED (SELECT row, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM (SELECT c.row, c.part, b.entry, sum((c.v - b.v) * (c.v - b.v))::BIGINT AS far"
        " FROM cut c JOIN b{k} b ON b.part = c.part AND b.place = c.place GROUP BY ALL) GROUP BY row, part)"
    )
    made = (
        ", b{n} AS MATERIALIZED (SELECT o.part, o.entry, o.place, coalesce(m.v, o.v) AS v FROM b{k} o LEFT JOIN (SELECT c.part, x.entry, c.place, floor(sum(c.v)::DOUBLE / count(*))::BIGINT AS v"
        " FROM cut c JOIN x{k} x ON x.row = c.row AND x.part = c.part GROUP BY ALL) m ON m.part = o.part AND m.entry = o.entry AND m.place = o.place)"
    )
    steps = ", ".join(found.format(k=k) + (made.format(k=k, n=k + 1) if k < rounds else "") for k in range(rounds + 1))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), flat AS (SELECT row, unnest(e) AS x, unnest(range(len(e))) AS i, len(e) // {parts} AS width FROM kept
), cut AS MATERIALIZED (SELECT row, i // width AS part, i % width AS place, floor(x::DOUBLE * {scale})::BIGINT AS v FROM flat
), b0 AS MATERIALIZED (SELECT part, row AS entry, place, v FROM cut WHERE row < {entries}
), {steps}
, coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM x{rounds} GROUP BY row
), books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row) CROSS JOIN books
"""


SQL: dict[str, str] = {
    "op11_vector_codes": _codes_sql(),
    "op12_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), w AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (SELECT lang, term, count(*) AS in_lang FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term
), g AS (SELECT DISTINCT lang, source FROM d
), f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.in_lang FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), t AS (SELECT lang, source, sum(n) AS n_all, sum(in_lang) AS lang_all, count(*) AS v FROM f GROUP BY lang, source
), s AS (
  SELECT f.lang, f.source, f.term, n, (1 + (1000000000::HUGEINT * (n + 5)) // (n_all + 5 * v)::HUGEINT)::BIGINT AS p, (1 + (1000000000::HUGEINT * (in_lang + 5)) // (lang_all + 5 * v)::HUGEINT)::BIGINT AS q
  FROM f JOIN t ON t.lang = f.lang AND t.source = f.source
), apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(apart.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
), both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
""",
    "op2_near_copies": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE both_have >= 0.8 * (x.n + y.n - both_have)
  UNION SELECT a.doc_id, b.doc_id FROM documents a JOIN documents b ON coalesce(a.text, '') = coalesce(b.text, '') AND a.doc_id <> b.doc_id
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.seen
), c AS (SELECT node, min(seen) AS class_id, count(*) AS class_size FROM reach GROUP BY node)
SELECT c.node AS doc_id, c.class_id, c.class_size, coalesce(n.n, 0) AS n_shingles FROM c LEFT JOIN n ON n.doc_id = c.node
""",
    "op6_url_filter": _URL_SQL,
    "op7_line_dedup": rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place FROM documents
), k AS (SELECT doc_id, place, line, translate(trim(line, {_WHITE}), '{_UPPER}', '{_LOWER}') AS key FROM l
), often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), m AS (SELECT k.*, often.key IS NOT NULL AS dropped FROM k LEFT JOIN often ON often.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}
