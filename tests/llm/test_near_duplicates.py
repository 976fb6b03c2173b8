from fileguard.llm.components import components
from fileguard.llm.near_duplicates import near_duplicates
from tests.llm.cases import ROWS, awkward, documents, empty, near, noisy_family, rows

COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (12, 11), (12, 13), (7, 7), (None, 3), (4, 5)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert rows(found, "node", "component") == sorted(
        [(n, 1) for n in range(1, 6)] + [(n, 10) for n in range(10, 14)], key=repr
    )
    chain = spark.range(1, 300).selectExpr("id + 1 as a", "id as b")
    assert {r["component"] for r in components(chain).collect()} == {1}


def test_families_against_all_pairs(spark):
    """Copies around the threshold: many reach others only through a third one."""
    texts = noisy_family(60, 60, 0.05, 1) + noisy_family(40, 40, 0.08, 2) + noisy_family(20, 9, 0.1, 3)
    items = list(enumerate(texts + texts[:5]))
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(5)
    for block in (512, 8):
        assert rows(near_duplicates(df, width=2, block_rows=block), *COLUMNS) == near(items, 2)


def test_awkward_rows(spark):
    assert rows(near_duplicates(awkward(spark), width=2), *COLUMNS) == near(ROWS, 2)


def test_carried_columns(spark):
    found = near_duplicates(awkward(spark), carried=("text", "lang"))
    assert found.columns == [*COLUMNS, "text", "lang"]
    assert {r["lang"] for r in found.collect()} == {"clash"}


def test_empty(spark):
    assert near_duplicates(empty(spark)).count() == 0


def test_test_data(spark):
    docs = documents(spark)
    items = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows(near_duplicates(docs, width=2), *COLUMNS) == near(items, 2)
    assert rows(near_duplicates(docs), *COLUMNS) == near(items, 5)
