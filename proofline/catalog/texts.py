"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.catalog.compare import REGISTRY
from proofline.catalog.tables import spread_table, table
from proofline.functions import text as X
from proofline.functions.canonical import canonical_json
from proofline.operators import index as IX
from proofline.operators import phrases as PH
from proofline.operators import questions as QS
from proofline.operators import retrieval as R
from proofline.operators import selection as SEL
from proofline.plans import indexing as PL

WORDS_SQL = "' ' || trim(regexp_replace(lower({}), '[^0-9a-z]+', ' ', 'g')) || ' '"
FORBIDDEN = ("the", "and of", "leaux", "oui", "der")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", X.normalize_words(F.col("text")).alias("words"))


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase"))


HITS_SQL = (
    "WITH d AS (SELECT doc_id, " + WORDS_SQL.format("text") + " AS w FROM documents), "
    "p AS (SELECT item_id, " + WORDS_SQL.format("text") + " AS ph FROM benchmark) "
)


@REGISTRY.query("phrase_hits", HITS_SQL + "SELECT doc_id, item_id FROM d JOIN p ON contains(w, ph)")
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PH.phrase_hits(_words(spark, sf_dir), _phrases(spark, sf_dir), "doc_id", "item_id")


@REGISTRY.query(
    "phrase_anti", HITS_SQL + "SELECT doc_id FROM d WHERE NOT EXISTS (SELECT 1 FROM p WHERE contains(w, ph))"
)
def phrase_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PH.without_phrases(_words(spark, sf_dir), _phrases(spark, sf_dir), "doc_id", "item_id").select("doc_id")


@REGISTRY.query(
    "phrase_openings",
    HITS_SQL
    + """, o AS (SELECT item_id, n, ' ' || array_to_string(string_split(trim(ph), ' ')[1:n], ' ') || ' ' AS ph
          FROM p, (SELECT unnest([3, 4, 5, 6, 8, 11, 16]) AS n) WHERE len(string_split(trim(ph), ' ')) >= n)
        SELECT doc_id, item_id, n FROM d JOIN o ON contains(w, ph)""",
)
def phrase_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each item's opening is quoted: phrases that share their first words, met by whole runs."""
    words = F.split(F.btrim(X.normalize_words(F.col("phrase"))), " ")
    lengths = F.explode(F.array(*[F.lit(n) for n in (3, 4, 5, 6, 8, 11, 16)]))
    openings = _phrases(spark, sf_dir).select("item_id", words.alias("w"), lengths.alias("n")).where(F.size("w") >= F.col("n"))
    openings = openings.select(F.struct("item_id", "n").alias("key"), F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("phrase"))
    return PH.phrase_hits(_words(spark, sf_dir), openings, "doc_id", "key", most_chars=0).select("doc_id", "key.*")


@REGISTRY.query(
    "leakage_check",
    "WITH c AS (SELECT conv_id, turn, " + WORDS_SQL.format("text") + " AS w, lower(text) AS low FROM conversations WHERE role = 'user') "
    "SELECT conv_id, turn FROM c WHERE contains(low, 'der und') OR (conv_id % 2 = 0 AND ("
    + " OR ".join(f"contains(w, ' {n} ')" for n in FORBIDDEN)
    + "))",
)
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question"), F.when(F.col("conv_id") % 2 == 0, "eval").otherwise("dev").alias("split")
    )
    return QS.leaks(asked, list(FORBIDDEN), "der und").select("conv_id", "turn")


@REGISTRY.query("html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread_table(spark, sf_dir, "pages", "page_id", "html")
    read = pages.select("page_id", X.html_text(X.decode_document(F.encode("html", "utf-8"))).alias("text"))
    return read.select("page_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


BODY = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@REGISTRY.query(
    "section_split",
    r"""WITH t AS (SELECT doc_id, translate(text, '§', ' ') AS x FROM documents),
        b AS (SELECT doc_id, 'Item 1' AS item, 'Business' AS title, 'Business' || chr(10) || x || chr(10) AS body, 0 AS k FROM t
              UNION ALL SELECT doc_id, 'Item 7A', 'Market risk', 'Market risk' || chr(10) || x || x || chr(10), 1 FROM t),
        l AS (SELECT *, length(regexp_replace(regexp_replace(body, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '')) AS n FROM b),
        f AS (SELECT * FROM l WHERE n >= 200)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS section_no, item, title, n AS chars FROM f
        UNION ALL
        SELECT doc_id, 0, 'Full filing', 'Full filing',
          length('Contents' || chr(10) || 'Item 1. Business 3' || chr(10) || 'Item 7a: Market risk 9' || chr(10) || 'Item 1. Business' || chr(10) || x || chr(10) || 'ITEM  7a - Market risk' || chr(10) || x || x || chr(10))
        FROM t WHERE doc_id NOT IN (SELECT doc_id FROM f)""",
)
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text")
    x = F.translate("text", "§", " ")
    filed = F.concat(
        F.lit("Contents\nItem 1. Business 3\nItem 7a: Market risk 9\nItem 1. Business\n"), x,
        F.lit("\nITEM  7a - Market risk\n"), x, x, F.lit("\n"),
    )
    return docs.select("doc_id", F.posexplode(X.sections_of(filed)).alias("section_no", "s")).select(
        "doc_id", "section_no", "s.item", "s.title", F.length("s.text").alias("chars")
    )


@REGISTRY.query("chunk_windows")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text")
    chunks = PL.chunk_texts(docs.select(F.col("doc_id").alias("accession"), "text"))
    return chunks.groupBy("accession").agg(
        F.count("*").alias("chunks"),
        F.max(F.length("text")).alias("longest"),
        F.count_distinct("chunk_id").alias("distinct_ids"),
        F.sum(F.length("text")).alias("chars"),
    )


@REGISTRY.query(
    "split_sanity",
    """WITH c AS (SELECT source AS accession, CASE WHEN doc_id % 5 = 0 THEN 'Full filing' ELSE 'Item ' || doc_id % 3 END AS item, n_chars AS n FROM documents),
       i AS (SELECT accession, item, sum(n)::BIGINT AS size FROM c GROUP BY 1, 2)
       SELECT accession, count(*) FILTER (item <> 'Full filing') AS sections, sum(size)::BIGINT AS total, max(size) AS largest,
         (count(*) FILTER (item <> 'Full filing') >= 2 AND sum(size) > 0 AND max(size) <= 0.5 * sum(size))::INT AS split_is_sane
       FROM i GROUP BY 1""",
)
def split_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.when(F.col("doc_id") % 5 == 0, F.lit("Full filing")).otherwise(F.concat(F.lit("Item "), (F.col("doc_id") % 3).cast("string")))
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("accession"), item.alias("item"), "text")
    return IX.split_sanity(chunks).withColumn("split_is_sane", F.col("split_is_sane").cast("int"))


def _turn_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turns of its conversation as passages."""
    turns = spread_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    told = turns.where(F.col("role") == "assistant").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")
    )
    passages = F.transform(
        "t", lambda p: F.struct(F.concat(F.lit("Item "), p["turn"].cast("string")).alias("item"), p["text"].alias("text"))
    )
    return turns.where(F.col("role") == "user").join(told.select("conv_id", passages.alias("passages")), "conv_id")


@REGISTRY.query("prompt_sanitise")
def prompt_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _turn_passages(spark, sf_dir).withColumn("nonce", X.case_nonce(F.concat_ws(":", "conv_id", "turn")))
    built = asked.withColumn("prompt", X.build_prompt(F.col("text"), F.col("passages"), F.col("nonce")))
    read = built.withColumn("shown", X.passages_shown(F.col("prompt"), F.col("nonce")))
    return read.select(
        "conv_id", "turn", F.size("passages").alias("passages"), F.size("shown").alias("shown"),
        F.sha2("prompt", 256).alias("prompt_sha256"),
    )


@REGISTRY.query(
    "markers_and_sentences",
    r"""WITH b AS (SELECT conv_id, turn, regexp_replace(text, '[^0-9A-Za-z ]', '', 'g') AS x FROM conversations WHERE role = 'assistant')
        SELECT conv_id, turn, 4 AS sentences, '1,' || greatest(2, turn % 4 + 1) AS first_markers, '3' AS third_markers,
          length('A ' || x || ' in the U.S. [1][' || greatest(2, turn % 4 + 1) || '] [9] [0].') AS first_chars
        FROM b""",
)
def markers_and_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spread_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").where(F.col("role") == "assistant")
    body = F.regexp_replace("text", "[^0-9A-Za-z ]", "")
    marker = F.greatest(F.lit(2), F.col("turn") % 4 + 1).cast("string")
    answer = F.concat(
        F.lit("A "), body, F.lit(" in the U.S. [1]["), marker, F.lit("] [9] [0]. Then more!\n2. A list line. [3] [3]\n\n- Last?  "),
    )
    cut = told.select("conv_id", "turn", X.answer_sentences(answer).alias("s"))
    text = lambda i: F.array_join(F.transform(X.markers_in(F.get("s", F.lit(i)), 4), lambda n: n.cast("string")), ",")
    return cut.select(
        "conv_id", "turn", F.size("s").alias("sentences"), text(0).alias("first_markers"), text(2).alias("third_markers"),
        F.length(F.get("s", F.lit(0))).alias("first_chars"),
    )


@REGISTRY.query("quote_window")
def quote_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text")
    asked = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "question")
    count = asked.agg(F.count("*").alias("n"))
    placed = docs.crossJoin(F.broadcast(count)).withColumn("item_id", F.col("doc_id") % F.col("n"))
    quoted = placed.join(asked, "item_id").select("doc_id", X.quote_for(F.col("text"), F.col("question")).alias("quote"))
    return quoted.select("doc_id", F.length("quote").alias("chars"), F.sha2("quote", 256).alias("quote_sha256"))


@REGISTRY.query(
    "recording_join",
    """WITH t AS (SELECT *, sha256('{"input":' || to_json(text) || ',"kind":"generate"}') AS key FROM conversations),
       made AS (SELECT a.conv_id * 1000 + a.turn AS position, u.key, a.text AS response
                FROM t a JOIN t u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant'),
       last AS (SELECT key, max_by(response, position) AS response FROM made GROUP BY 1)
       SELECT conv_id, turn, t.key, length(response) AS response_chars, (response IS NULL)::INT AS missing
       FROM t LEFT JOIN last USING (key) WHERE role = 'user'""",
)
def recording_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    key = F.sha2(canonical_json(kind=F.lit("generate"), input=F.col("text")), 256)
    keyed = turns.withColumn("key", key)
    before = keyed.select("conv_id", (F.col("turn") + 1).alias("turn"), "key")
    made = turns.where(F.col("role") == "assistant").join(before, ["conv_id", "turn"]).select(
        F.lit("generate").alias("kind"), "key", F.col("text").alias("response"), (F.col("conv_id") * 1000 + F.col("turn")).alias("position")
    )
    asked = turns.where(F.col("role") == "user")
    found = R.with_recorded(asked, R.latest_recordings(made), key, "generate")
    return found.select(
        "conv_id", "turn", "key", F.length("response").alias("response_chars"), F.col("response").isNull().cast("int").alias("missing")
    )


@REGISTRY.query(
    "index_audit",
    """SELECT printf('%010d-24-%06d', label, label) AS accession, count(*) AS chunks,
         concat_ws(',', CASE WHEN label = 5 THEN 'not_in_manifest' END, CASE WHEN label = 4 THEN 'count' END,
           CASE WHEN label = 2 THEN 'not_finite' END, CASE WHEN label = 3 THEN 'chunk_id_prefix' END,
           CASE WHEN label = 6 THEN 'digest' END) AS problems
       FROM embeddings GROUP BY label
       UNION ALL SELECT '0000000099-24-000099', 0, 'missing'""",
)
def index_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    accession = F.format_string("%010d-24-%06d", "label", "label")
    broken = F.transform(
        "embedding", lambda x: F.lit(float("inf")).cast("float")
    )
    chunks = vectors.select(
        "label",
        accession.alias("accession"),
        F.concat(F.when(F.col("label") == 3, F.lit("x")).otherwise(accession), F.lit(":Item 7#"), F.col("vec_id").cast("string")).alias("chunk_id"),
        F.col("vec_id").alias("ordinal"),
        F.when(F.col("label") == 2, broken).otherwise(F.col("embedding")).alias("vector"),
    )
    sound = IX.filing_digests(chunks)
    label = F.substr("accession", F.lit(1), F.lit(10)).cast("int")
    manifest = sound.where(label != 5).select(
        "accession",
        (F.col("chunks") + (label == 4).cast("int")).alias("chunks"),
        F.when(label == 6, F.lit("another")).otherwise(F.col("digest")).alias("digest"),
    )
    absent = sound.agg(
        F.lit("0000000099-24-000099").alias("accession"), F.lit(7).cast("long").alias("chunks"), F.lit("gone").alias("digest")
    )
    found = IX.audit(chunks.drop("label"), manifest.unionByName(absent), 64)
    return found.select("accession", "chunks", F.array_join("problems", ",").alias("problems"))


# --- sampling ------------------------------------------------------------------------------------
@REGISTRY.query(
    "two_fold_split",
    f"""WITH h AS (SELECT c_custkey, ('0x' || substr(md5('7:' || c_custkey), 1, 15))::BIGINT AS o FROM customer)
        SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY o) <= count(*) OVER () // 2 THEN 0 ELSE 1 END AS fold FROM h""",
)
def two_fold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SEL.two_folds(table(spark, sf_dir, "customer").select("c_custkey"), 7, "c_custkey")


@REGISTRY.query(
    "even_allocation",
    """WITH c AS (SELECT c_mktsegment AS segment, c_nationkey AS name, count(*) AS cap FROM customer GROUP BY 1, 2),
       t AS (SELECT segment, sum(cap)::BIGINT * 2 // 3 AS total FROM c GROUP BY 1),
       slots AS (SELECT segment, name, cap, unnest(range(1, cap + 1)) AS slot FROM c),
       r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY slot, name) AS k FROM slots)
       SELECT c.segment, c.name, c.name AS "position", c.cap AS capacity, count(*) FILTER (k <= total) AS allocation
       FROM r JOIN t USING (segment) JOIN c ON c.segment = r.segment AND c.name = r.name GROUP BY 1, 2, 3, 4""",
)
def even_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = table(spark, sf_dir, "customer").groupBy(
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("name")
    ).agg(F.count("*").alias("capacity")).withColumn("position", F.col("name"))
    total = capacity.groupBy("segment").agg(F.floor(F.sum("capacity") * 2 / 3).alias("total"))
    return SEL.even_allocation(capacity, total, ["segment"])


@REGISTRY.query(
    "kind_quota",
    """WITH q AS (SELECT c_custkey, c_custkey % 17 AS total, c_custkey % 4 AS pos FROM customer),
       k AS (SELECT *, unnest(['wrong_year', 'other_company', 'unreported_concept', 'off_domain']) AS kind, unnest([0, 1, 2, 3]) AS i FROM q)
       SELECT c_custkey, kind, total // 4 + ((i - pos + 4) % 4 < total % 4)::INT AS quota FROM k""",
)
def kind_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotas = table(spark, sf_dir, "customer").select(
        "c_custkey", F.explode(SEL.kind_quota(F.col("c_custkey") % 17, F.col("c_custkey") % 4)).alias("q")
    )
    return quotas.select("c_custkey", "q.kind", "q.quota")


@REGISTRY.query(
    "spread_sample",
    """WITH c AS (SELECT p_partkey AS id, p_brand AS stratum, p_type AS concept, p_size % 5 AS g,
                    to_json({'g': {'concept': p_type, 'g': p_size % 5}}) AS grp FROM part),
       h AS (SELECT *, md5('11:' || stratum || ':' || grp) AS go, md5('11:' || stratum || ':' || id) AS co FROM c),
       m AS (SELECT *, row_number() OVER (PARTITION BY stratum, grp ORDER BY co, id) AS depth FROM h),
       r AS (SELECT stratum, concept, grp, row_number() OVER (PARTITION BY stratum, concept ORDER BY go, grp) AS round FROM (SELECT DISTINCT stratum, concept, grp, go FROM h)),
       p AS (SELECT m.*, round, row_number() OVER (PARTITION BY m.stratum ORDER BY depth, round, go, m.grp, co, id) AS pick
             FROM m JOIN r ON r.stratum = m.stratum AND r.grp = m.grp)
       SELECT id, stratum, pick, depth, round FROM p WHERE pick <= 12""",
)
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("stratum"), F.col("p_type").alias("concept"),
        (F.col("p_size") % 5).alias("g"), F.lit(12).alias("quota"),
    )
    picked = SEL.spread_sample(
        cases, ["stratum"], "quota", 12, 11, group=F.struct("concept", "g"), concept=F.col("concept")
    )
    return picked.select("id", "stratum", "pick", "depth", "round")
