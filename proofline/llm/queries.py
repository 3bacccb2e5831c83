"""The registered query of each operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.catalog.compare import Registry
from proofline.llm import decontamination, licenses, mixing, neighbours, quality, quotes, scoring, search, simhash, spelling, suffixes, tokens, urls

REGISTRY = Registry()

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || md5('mix|' || doc_id)[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / CASE WHEN coalesce(strlen(text), 0) = 0 THEN 0.1
                  ELSE greatest(1 - (strlen(text) - strlen(translate(text, '#$%&*!|@<>{}[]\^~=+_', '')))::DOUBLE / strlen(text), 0.1) END AS key
  FROM documents),
each AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM each),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE
              / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level, 3 * source_size / weight AS room
  FROM named
  WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(level, room) FILTER (WHERE level <= room) AS level FROM levels),
targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * coalesce(chosen.level, 0)) AS target
  FROM levels, chosen),
drawn AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized JOIN targets USING (source))
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, round(target - whole * source_size) - start)))::BIGINT AS taken
FROM drawn
"""

OP5_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0) t),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) l WHERE len(w) >= n) t),
hits AS (SELECT doc_id, n, i, win FROM dw WHERE win IN (SELECT win FROM bw)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) t GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM hits JOIN bw USING (win)) t GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7_SQL = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
strings AS (
  SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM d) t),
earliest AS (SELECT s, min(doc_id) AS first FROM strings GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
  FROM (SELECT doc_id, i FROM strings JOIN earliest USING (s) WHERE first < doc_id) t),
runs AS (
  SELECT doc_id, count(*) AS n_removed, sum((before IS NULL OR before <> p - 1)::INT) AS n_spans
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) t GROUP BY doc_id),
bytes AS (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * p - 1, 2), '' ORDER BY p) AS k
  FROM bytes ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP11_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(list_reduce(list_concat([x], range(8)), lambda c, _ : CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY x) AS t
  FROM range(256) AS r(x)),
runs AS (
  SELECT doc_id, run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) r
  WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (
  SELECT run, times, xor(list_reduce(list_concat([4294967295], list_transform(range(1, strlen(message) + 1), lambda i : ('0x' || substr(hex(message), 2 * i - 1, 2))::BIGINT)),
                             lambda c, b : xor(t[xor(c, b) % 256 + 1], c // 256)), 4294967295) AS h
  FROM (SELECT run, times, doc_id || ':' || run AS message FROM runs) m, crc),
words AS (
  SELECT word, sum(times)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed) w
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
rests AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words) w),
near AS (
  SELECT a.word, b.word AS other, b.n FROM rests a JOIN rests b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT rests.word, words.word, words.n FROM rests JOIN words ON rest = words.word
  UNION SELECT words.word, rests.word, rests.n FROM rests JOIN words ON rest = words.word),
met AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * words.n THEN top END AS form_n,
         (SELECT min(other) FROM near WHERE near.word = words.word AND near.n = top AND top >= 5 * words.n) AS form
  FROM words LEFT JOIN met USING (word)),
chains AS (
  SELECT word, form AS root FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT chains.word, forms.form FROM chains JOIN forms ON forms.word = chains.root WHERE forms.form IS NOT NULL),
roots AS (SELECT chains.word, chains.root FROM chains JOIN forms ON forms.word = chains.root WHERE forms.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near::BIGINT AS n_near, form_n FROM forms LEFT JOIN roots USING (word)
"""

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
sized AS (SELECT r, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
tfs AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) u GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, whole GROUP BY term, n_docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sized USING (r), whole GROUP BY item_id, r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM scored JOIN sized USING (r) WHERE score > 0
QUALIFY rank <= 50
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@REGISTRY.query("op1_urls")
def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@REGISTRY.query("op2_mixing", OP2_SQL)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@REGISTRY.query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@REGISTRY.query("op4_neighbours")
def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@REGISTRY.query("op5_decontamination", OP5_SQL)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@REGISTRY.query("op6_quotes")
def op6_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


@REGISTRY.query("op7_suffixes", OP7_SQL)
def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


@REGISTRY.query("op8_licenses")
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@REGISTRY.query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


@REGISTRY.query("op10_tokens")
def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_sums(tokens.encoded_lengths(table(spark, sf_dir, "documents")))


@REGISTRY.query("op11_spelling", OP11_SQL)
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@REGISTRY.query("op12_scores")
def op12_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scores(table(spark, sf_dir, "documents"))


@REGISTRY.query("op13_search", OP13_SQL)
def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
