"""The pipeline's stages against brute force on their own inputs."""

import hashlib

import pytest

import corpus_pipeline
from provenant.llm.common import stored
from tests.llm.test_near_duplicates import brute
from tests.llm.test_passages import WORD, brute_contamination, brute_lines, lower

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], FOLDER)))
    return [{r.doc_id: r for r in d.collect()} for d in out], [d.columns for d in out]


def test_columns_and_rows(stages):
    rows, columns = stages
    assert all(c == columns[0] for c in columns[:-1])
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:], strict=False))


def test_lines(stages):
    rows, _ = stages
    want = {i: h for i, _, _, h in brute_lines([(i, r.text, r.source) for i, r in rows[1].items()], 10)}
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == want[i] for i, r in rows[2].items())


def test_one_document_of_each_class_stays(stages):
    rows, _ = stages
    classes = brute({i: r.text for i, r in rows[2].items()})
    assert set(rows[3]) == {i for i, c in classes.items() if i == c}


def test_contaminated_documents_go(spark, stages):
    rows, _ = stages
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    found = brute_contamination([(i, r.text) for i, r in rows[3].items()], items)
    assert set(rows[4]) == {i for i, *_, bad in found if not bad}
    assert set(rows[5]) == set(rows[4])


def test_empty_tables_and_repeats(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    two = docs.where("doc_id IN (1, 2)")
    odd = two.unionByName(two).unionByName(two.selectExpr("cast(NULL AS long) AS doc_id", "text", "lang", "source", "n_chars")).unionByName(
        two.selectExpr("doc_id + 1000 AS doc_id", "cast(NULL AS string) AS text", "cast(NULL AS string) AS lang", "cast(NULL AS string) AS source", "cast(NULL AS long) AS n_chars"))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name
        odd = stored(stage(spark, odd, FOLDER))
        if name == "near_duplicates":
            ids = sorted(str(r.doc_id) for r in odd.collect())
            assert ids == ["1", "1001", "1002", "2", "None", "None"]
    assert lower("ABC é") == "abc é" and WORD.findall("a-b") == ["a", "b"]
