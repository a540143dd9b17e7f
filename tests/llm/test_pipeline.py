import sys
from pathlib import Path

import duckdb
import pytest
from helpers import frame, odd_rows, prose

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from linewise.llm import decontaminate, pii, simhash  # noqa: E402
from linewise.llm.oracle import ORACLE  # noqa: E402
from linewise.llm.queries import QUERIES  # noqa: E402
from tools.compare import compare  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_every_stage_on_odd_rows_and_extra_columns(spark):
    clashing = {"a": "spans", "b": "fp", "c": "row", "d": "score", "e": "key", "f": "items", "g": "ids"}
    docs = frame(spark, odd_rows())
    for name in clashing.values():
        docs = docs.selectExpr("*", f"'{name} stays' AS {name}")
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, SF)
            rows = out.collect()
            if name == "packing":
                assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in some.collect()}
            else:
                assert out.columns == docs.columns and len(rows) <= some.count()
                assert all(r[x] == f"{x} stays" for r in rows for x in clashing.values())


def test_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = at[name] = corpus_pipeline.materialize(stage(spark, docs, SF), "test-stage")
    texts = {name: {r["doc_id"]: r["text"] for r in df.collect()} for name, df in at.items() if name != "packing"}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [labels[d] for d in texts["quality"] if d in labels]
    assert sum(good) / len(good) > 0.95 and sum(good) >= 0.95 * sum(labels.values())
    groups = simhash.near_duplicates(at["quality"]).collect()
    assert set(texts["near_duplicates"]) == {r["component_id"] for r in groups}
    found = decontaminate.digest(decontaminate.find_phrases(at["decontamination"].select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert found.where("contaminated").count() == 0 and set(texts["decontamination"]) == set(texts["near_duplicates"])
    assert pii.digest(pii.find_private(at["private_data"].select("doc_id", "text"))).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    packed = at["packing"].collect()
    assert {r["doc_id"] for r in packed} == set(texts["private_data"]) and sum(len(r["ids"]) for r in packed) == sum(r["length"] for r in packed)


def test_pipeline_and_operators_are_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert all(any(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    status, n, _, note = compare(spark, con, "/root/testdata/sf0.01", name, QUERIES[name], ORACLE[name])
    assert status == "equal" and n > 0, note
