"""One query per operator over whole tables, with checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hard_negatives, html_extract, language_id, line_dedup, ngram_join, quality_classifier, quality_rules, spelling, suffix_dedup, token_files, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return wrap


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file; it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM d),
g AS (SELECT doc_id, generate_subscripts(words, 1) AS p, words FROM w WHERE len(words) >= 5),
g5 AS (SELECT doc_id, p, words[p:p + 4] AS gram FROM g WHERE p <= len(words) - 4),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g5) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM rep, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
raw AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, source, text, line,
    regexp_replace(regexp_replace(trim(lower(line), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      '[ \t\n\x0B\f\r]+', ' ', 'g'), '[0-9]', '0', 'g') AS norm FROM raw),
solid AS (SELECT * FROM lines WHERE norm <> ''),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM solid GROUP BY doc_id),
freq AS (SELECT source, norm, count(DISTINCT doc_id) AS docs FROM solid GROUP BY source, norm),
host AS (SELECT source, count(DISTINCT doc_id) AS total FROM solid GROUP BY source),
hot AS (SELECT freq.source, norm FROM freq JOIN host ON freq.source IS NOT DISTINCT FROM host.source
  WHERE docs > 10 AND docs > least(total * CAST(0.02 AS DOUBLE), 1000)),
gone AS (SELECT doc_id, CAST(sum(len(string_split(s.norm, ' '))) AS BIGINT) AS removed, count(*) AS n_hot
  FROM solid s JOIN hot h ON s.norm = h.norm AND s.source IS NOT DISTINCT FROM h.source GROUP BY doc_id),
base AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(removed, 0) AS removed_words, coalesce(n_hot, 0) AS removed_lines
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_lines, removed_words,
  NOT base_failed AND removed_words <= n_words * CAST(0.5 AS DOUBLE) AS kept FROM judged
"""


@query("op3_quality_rules", OP3_SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
lines AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM raw),
solid AS (SELECT doc_id, i, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p FROM lines WHERE s <> ''),
win AS (SELECT doc_id, p, s AS a, lead(s, 1) OVER d AS b, lead(s, 2) OVER d AS c FROM solid
  WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS r FROM win
  WHERE b IS NOT NULL AND c IS NOT NULL),
later AS (SELECT DISTINCT doc_id, p + k AS p FROM ranked, (SELECT unnest([0, 1, 2]) AS k) WHERE r > 1),
gone AS (SELECT solid.doc_id, i, p FROM solid JOIN later USING (doc_id, p)),
runs AS (SELECT doc_id, count(*) AS n_removed,
    count(*) FILTER (before IS NULL OR p - before > 1) AS n_spans
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS body
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i WHERE g.i IS NULL GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM solid GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(body, '')) END AS clean_sha256
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op9_line_dedup", OP9_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2("clean_text", 256).alias("clean_sha256"))


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_ids(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=2)
    return token_files.read_all(spark, path)


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(
        table(spark, sf_dir, "documents"), tokenizer_file(), columns=("n_tokens", "ids_sha256", "decoded_sha256")
    )


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(language_id.learnable(docs))
    out = language_id.identify(docs, model, with_spans=False)
    return out.select("doc_id", quality_classifier.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
f AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest,
  min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to, true AS verified
FROM f
"""


@query("op5_warc", OP5_SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archive(spark, warc.write_archive(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'),
    lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [words]
    ELSE list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4]) END) AS gram FROM w),
sets AS (SELECT DISTINCT doc_id, gram FROM s),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.gram = y.gram AND x.doc_id <> y.doc_id
  GROUP BY a, b),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query("op1_ngram_join", OP1_SQL)
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 48)) AS i FROM d WHERE len(h) >= 100),
k AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(h, 2 * i - 1, 100)) AS key FROM p),
f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key HAVING min(doc_id) < max(doc_id)),
dup AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k JOIN f USING (key) WHERE doc_id > first),
runs AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i - before > 50 THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY i) AS r FROM dup),
spans AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, r),
cuts AS (SELECT doc_id, r, a, b, lag(b, 1, 1) OVER (PARTITION BY doc_id ORDER BY r) AS z FROM spans),
tails AS (SELECT doc_id, max(b) AS b, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id),
parts AS (SELECT doc_id, string_agg(substr(h, 2 * z - 1, 2 * (a - z)), '' ORDER BY r) AS kept FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(CASE WHEN n IS NULL THEN encode(text) ELSE unhex(kept || substr(h, 2 * t.b - 1)) END) AS kept_sha256
FROM d LEFT JOIN tails t USING (doc_id) LEFT JOIN parts USING (doc_id)
"""


@query("op6_suffix_dedup", OP6_SQL)
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


OP12_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank,
  s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label_col=moved)


# The database compares bytes, so each letter beyond ASCII becomes a character of one byte; it has no crc32 either.
BEYOND = "".join(chr(c) for c in range(0xC0, 0x100))
ONE_BYTE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 !#$%&()*+,-./:;<=>?@[]^_{|}"[:64]
OP13_SQL = f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
bytes AS (SELECT run, times, flatten(list_transform(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: unicode(x)),
    lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + c // 64, 128 + c % 64] END)) AS b FROM own),
crc AS (SELECT run, times, xor(list_reduce([4294967295] || list_transform(b, lambda x: CAST(x AS BIGINT)),
    lambda c, x: xor(c // 256, t.t[xor(c, x) % 256 + 1])), 4294967295) AS h FROM bytes, t),
made AS (SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, times FROM crc),
words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n, translate(word, '{BEYOND}', '{ONE_BYTE}') AS w FROM made
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
keyed AS (SELECT word, n, w, m, k, CASE WHEN k THEN substr(w, 1, m // 2) ELSE right(w, m // 2) END AS part FROM words,
    LATERAL (SELECT unnest([length(w), length(w) - 1]) AS m), LATERAL (SELECT unnest([true, false]) AS k)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM keyed a JOIN keyed b USING (m, k, part)
  WHERE a.w <> b.w AND levenshtein(a.w, b.w) = 1),
best AS (SELECT word, count(*) AS n_near, arg_max(other, (other_n, -pos)) AS form, max(other_n) AS form_n
  FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY encode(other)) AS pos FROM near) GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form,
    CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
path AS (SELECT word, word AS root, form AS onward FROM forms UNION ALL
  SELECT p.word, f.word, f.form FROM path p JOIN forms f ON f.word = p.onward)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n FROM forms f JOIN path p ON p.word = f.word AND p.onward IS NULL
"""


@query("op13_spelling_variants", OP13_SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), drop_every=199)


@query("op11_html_extract")
def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))
