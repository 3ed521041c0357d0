import pytest
from pyspark.sql import functions as F
from test_operators import CLASH, DOCS, odd_rows

import corpus_pipeline
import oracle
from tintlake.llm import queries
from tintlake.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert oracle.difference(spark, queries.QUERIES[name], queries.ORACLES[name], "/root/testdata/sf0.001") == ""


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, sf), "t")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0
    ids = {i for r in corpus_pipeline.run(spark, sf).select("doc_ids").collect() for i in r.doc_ids}
    assert ids == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_take_odd_rows_and_empty_tables(spark):
    """Null, empty, very long and repeated texts, null ids, clashing columns: each stage keeps the columns and doesn't fail; a
    repeated row is one document after near_duplicates, and rows without a word are in no mix."""
    sf = "/root/testdata/sf0.001"
    rows = [(*r, 1, 0.5, "h", "s", "g", "n", "o", 3) for r in odd_rows()]
    odd = spark.createDataFrame(rows + rows[5:8], DOCS + CLASH)
    for docs in (odd, odd.where("false"), odd.withColumn("maybe", F.lit(True)).withColumn("cell", F.lit(1))):
        columns, before = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.cut(stage(spark, docs, sf), "t")
            assert docs.columns == columns, name
            if name == "near_duplicates":
                own = [(r.doc_id, r.text) for r in docs.where("trim(text) <> ''").collect()]
                assert len(own) == len(set(own))
        assert docs.where("text IS NULL OR trim(text) = ''").isEmpty()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert (packed.count() == 0) == (before == 0)
