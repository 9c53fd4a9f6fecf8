"""Registered queries against their SQL, and the pipeline's stages against brute force."""

import pytest

from tests.conftest import SF
from tests.llm import cases as C
from tests.oracle import assert_equal
from wavelane.llm import catalog, common, packing


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, name):
    assert_equal(catalog.queries()[name](spark, SF), catalog.ORACLES[name], SF)


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.queries()) == list(range(1, 11))


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = common.table(spark, SF, "documents")
    columns, made = docs.columns, []
    for k, (_, stage) in enumerate(P.STAGES):
        docs = common.stored(stage(spark, docs, SF), f"{common.shared_dir(spark)}/{k}")
        made.append(docs)
        assert k == len(P.STAGES) - 1 or docs.columns == columns
    rows = [[(r.doc_id, r.text) for r in df.collect()] for df in made[:4]]
    want = {i: sha for i, _, _, sha in C.line_dedup(rows[0])}
    assert all(want[i] == C.sha(t) for i, t in rows[1])
    gone = {i for i, _ in rows[0]} - {i for i, _ in rows[1]}
    assert len(gone) < 0.2 * len(rows[0])
    groups = C.near_groups(rows[1], 5, 80, 100)
    assert {i for i, _ in rows[2]} == {i for i, _, c in groups if c == i}
    items = [(str(r.item_id), r.text) for r in common.table(spark, SF, "benchmark").collect()]
    judged = dict(zip([i for i, _ in rows[2]], C.contamination([t for _, t in rows[2]], items), strict=True))
    assert {i for i, _ in rows[3]} == {i for i, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)}
    assert sum(hit for _, hit, _ in C.contamination([t for _, t in rows[3]], items)) == 0
    assert {r.doc_id for r in made[4].select("doc_id").distinct().collect()} == {i for i, _ in rows[3]}
    assert packing.padding(made[4]).first().sequences > 0


@pytest.mark.parametrize("with_docs", [True, False])
def test_pipeline_on_awkward_tables(spark, tmp_path, with_docs):
    """Null, empty, very long, repeated rows against an empty benchmark; no documents against some items."""
    import corpus_pipeline as P

    docs = (C.documents(spark) if with_docs else C.empty(spark)).select("doc_id", "text", "lang", "source", "n_chars")
    items = spark.createDataFrame([] if with_docs else [("1", C.PASSAGE)], "item_id string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    if not with_docs:
        assert out == []
        return
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in out} <= {i for i, t in rows if t and C.space_words(t)}
    for r in out:
        assert len(r.ids) == r.length and r.offset + r.length <= packing.CAPACITY
    # The long document, in lower case, is one of those that stay, whole.
    whole = [r for r in out if r.doc_id == 15]
    assert sum(r.length for r in whole) == whole[0].doc_tokens
