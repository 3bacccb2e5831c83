"""Every query and every stage on tables with nulls, repeated rows, clashing column names, and no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from proofline.llm.queries import REGISTRY

PROSE = "the river runs past the old mill and the people of the town walk along it every day of the year "
DOCUMENTS = [
    (1, PROSE * 3, "en", "web", 1), (1, PROSE * 3, "en", "web", 1), (1, "another text of the same id", "en", "web", 2),
    (2, None, None, None, None), (3, "", "en", "", 0), (None, PROSE, "de", "web", 9), (None, None, None, None, None),
    (4, PROSE * 3 + "and more", None, None, 5), (5, "a" * 50_000, "en", "book", 3), (6, "word " * 8_000, "en", "book", 3),
    (7, "ünï \u2003 cödé \U0001f600 " * 40, "fr", "wiki", 4), (8, "   \n\t ", "fr", "wiki", 4), (9, "\x00\x01 zero " * 30, "fr", "wiki", 4),
]
TABLES = {
    "documents": (DOCUMENTS, "doc_id long, text string, lang string, source string, n_chars long"),
    "labels": ([(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 0), (3, 0, 1), (4, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int"),
    "benchmark": ([(1, PROSE), (1, PROSE), (None, "zero zero zero"), (2, None), (3, ""), (4, "!!!")], "item_id long, text string"),
    "pages": (
        [(1, "https://a.example.net/en/x?q"), (1, "https://a.example.net/en/x?q"), (2, None), (None, "no scheme"), (3, ""), (4, "http://org/fr/1"), (5, "x://" + "y" * 50_000)],
        "page_id long, url string",
    ),
    "conversations": (
        [(1, 0, "user", "hello there my friend"), (1, 1, "assistant", "> hello there my friend\nyes"), (1, 1, "assistant", "> hello there my friend\nyes"), (None, None, None, None), (2, None, "user", ""), (2, 0, None, None), (3, 0, "user", ">>> " * 1000)],
        "conv_id long, turn long, role string, text string",
    ),
    "embeddings": (
        [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (50, [0.0, 2.0], None), (1, None, 1), (2, [0.0, 0.0], 1), (3, [float("nan"), 1.0], 1), (4, [None, 1.0], 0), (5, [1.0, 1.0], 2), (None, [1.0, 2.0], 2)],
        "vec_id long, embedding array<float>, label int",
    ),
}
#: Names that operators give to columns of their own.
CLASHING = (
    "size source_size target taken key bucket block whole rest held_out score predicted n_words n_hit n_items items_sha256 contaminated "
    "n_bytes n_removed n_spans kept_sha256 fingerprint component_id query_id rank host path rule verdict decided judged kept weight count "
    "id item_id quality toxic part shard slot hash at start end value n term word form root token c ln code slice bundle item learned"
).split()


def write(spark, folder, empty=False, extra=()):
    for name, (rows, schema) in TABLES.items():
        table = spark.createDataFrame([] if empty else rows, schema)
        more = [c for c in extra if c not in table.columns]
        table.select("*", *[F.lit("clash").alias(c) for c in more]).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows(table, columns):
    """The rows in a fixed order; the last digits of a double may depend on the size of a batch."""
    found = [tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in table.select(*columns).collect()]
    return sorted(found, key=repr)


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("plain"))


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("clashing"), extra=CLASHING)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), empty=True)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_queries_do_not_see_other_columns_and_take_empty_tables(spark, plain, clashing, empty, name):
    of_plain = REGISTRY[name].run(spark, plain)
    expected = rows(of_plain, of_plain.columns)
    assert rows(REGISTRY[name].run(spark, clashing), of_plain.columns) == expected
    if name in ("op2_mixing", "op3_quality", "op5_decontamination", "op7_suffixes", "op9_simhash", "op12_scores"):
        assert len(expected) == len(DOCUMENTS)
    nothing = REGISTRY[name].run(spark, empty)
    assert nothing.columns == of_plain.columns
    nothing.collect()


@pytest.mark.parametrize("kind", ["plain", "clashing", "empty"])
def test_stages_keep_the_columns_of_documents(spark, request, kind):
    folder = request.getfixturevalue(kind)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for position, (_, stage) in enumerate(corpus_pipeline.STAGES):
        left = stage(spark, docs, folder)
        if position < len(corpus_pipeline.STAGES) - 1:
            assert left.columns == docs.columns
        before = docs.count()
        assert left.count() <= before
        docs = left
