"""Benchmark items whose id is null."""

import duckdb

from tests.llm import cases as C
from wavelane.llm import catalog, common, decontamination as D


def test_items_without_id(spark, tmp_path):
    docs = spark.createDataFrame([(1, f"{C.prose(9, 2)} {C.PASSAGE}"), (2, f"{C.prose(3000, 3)} {C.PASSAGE} {C.prose(50, 4)}"), (3, C.prose(20, 20)), (4, None), (5, C.prose(40, 6))], "doc_id long, text string")
    items = spark.createDataFrame([(None, C.PASSAGE), (None, C.PASSAGE[: len(C.PASSAGE) // 2]), ("15", C.prose(20, 20)), ("16", C.PASSAGE)], "item_id string, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for k, some in enumerate([items, items.filter("item_id IS NULL")]):
        some.coalesce(1).write.parquet(f"{tmp_path}/{k}/benchmark.parquet")
        docs.coalesce(1).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        db = duckdb.connect()
        for t in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{k}/{t}.parquet/*.parquet'")
        want = db.execute(catalog.ORACLES["op1_decontamination"]).fetchall()
        got = D.op1_decontamination(spark, f"{tmp_path}/{k}").collect()
        assert sorted(map(tuple, got)) == sorted(want) and sum(r.n_hit for r in got) > 100
        left = {r.doc_id: r.text for r in D.decontaminate(docs, common.table(spark, f"{tmp_path}/{k}", "benchmark"), block_words=30).collect()}
        assert 1 not in left and left[2] == f"{C.prose(3000, 3)}  {C.prose(50, 4)}"
