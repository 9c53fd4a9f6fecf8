"""Operators on texts against brute force, on awkward and on empty tables."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import cases as C
from wavelane.llm import decontamination as D, line_dedup as L, minhash as M, substring_dedup as S, vectext as V

ITEMS = [("7", C.prose(25, 20)), ("8", C.PASSAGE), ("12", "Two words"), ("13", ""), ("14", None), ("15", C.prose(20, 20)), (None, "one"), ("16", "alpha1 alpha1"), ("100", C.prose(13, 9))]


def texts(df):
    return [r.text for r in df.collect()]


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id string, text string")


@pytest.mark.parametrize("block", [200_000, 30])
def test_decontamination(spark, block):
    docs = C.documents(spark).cache()
    got = D.find_contamination(docs, items(spark), block_words=block).select("text", "contamination.*").collect()
    assert Counter((r.text, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == Counter((t, n, h, tuple(x)) for t, (n, h, x) in zip(texts(docs), C.contamination(texts(docs), ITEMS), strict=True))
    assert D.find_contamination(C.empty(spark), items(spark)).count() == 0
    none = D.find_contamination(docs, items(spark).limit(0)).select("contamination.*").collect()
    assert sum(r.n_hit for r in none) == 0 and len(none) == docs.count()


def test_decontamination_cuts_and_drops(spark):
    docs = spark.createDataFrame([(1, C.PASSAGE), (2, f"{C.prose(3000, 3)}; {C.PASSAGE}! {C.prose(50, 4)}"), (3, C.prose(50, 4)), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in D.decontaminate(docs, items(spark)).collect()}
    assert set(got) == {2, 3, 4} and got[2] == f"{C.prose(3000, 3)}; ! {C.prose(50, 4)}" and got[4] is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=6), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 5))
def test_automaton(its, doc, window):
    named = [(str(k), [w.encode() for w in ws]) for k, ws in enumerate(its)]
    auto = D.Automaton(named, window)
    spans, found = auto.stream([w.encode() for w in doc])
    n, hit, names = C.contamination([" ".join(doc)], [(k, " ".join(ws)) for (k, _), ws in zip(named, its, strict=True)], window)[0]
    assert sum(b - a for a, b in spans) == hit and {auto.names[k] for k in found} == set(names)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 3), (7, 2)])
def test_line_dedup(spark, batches, fanout):
    docs = C.documents(spark).cache()
    own = [(r.doc_id, r.text) for r in docs.collect()]
    x = F.col("lines")
    out = L.dedup_lines(docs, batches=batches, fanout=fanout)
    got = out.select("doc_id", x.n_lines, x.n_dropped, F.sha2(F.coalesce(x.kept, F.lit("")), 256)).collect()
    assert Counter(map(tuple, got)) == Counter(C.line_dedup(own))
    assert set(docs.columns) == set(out.columns)
    assert L.dedup_lines(C.empty(spark)).count() == 0


@pytest.mark.parametrize("batches", [1, 4])
def test_substring_dedup(spark, batches):
    docs = C.documents(spark).cache()
    x = F.col("repeats")
    out = S.remove_repeats(docs, batches=batches, fanout=2)
    got = out.select("text", x.n_words, x.n_removed, F.sha2(x.kept, 256)).collect()
    assert Counter(map(tuple, got)) == Counter((t, *r) for t, r in zip(texts(docs), C.substring_dedup(texts(docs)), strict=True))
    assert S.remove_repeats(C.empty(spark)).count() == 0


def test_substring_index_by_calls(spark, tmp_path):
    """Three calls give the spans of one; the index is opened anew each time."""
    docs = C.documents(spark).withColumn("k", F.pmod(F.xxhash64("doc_id", "text"), F.lit(3))).cache()
    spans, before = [], None
    for k in range(3):
        now = docs.filter(F.col("k") == k)
        index = S.SubstringIndex(spark, f"{tmp_path}/index")
        spans.append(index.add(now, f"{tmp_path}/call-{k}", earlier=before))
        index.close()
        before = now if before is None else before.unionAll(now)
    x = F.col("repeats")
    out = S.without_spans(docs, spans[0].unionAll(spans[1]).unionAll(spans[2]))
    got = out.select("text", x.n_words, x.n_removed, F.sha2(x.kept, 256)).collect()
    assert Counter(map(tuple, got)) == Counter((t, *r) for t, r in zip(texts(docs), C.substring_dedup(texts(docs)), strict=True))


def test_index_side_needs_no_exchange(spark, tmp_path):
    docs = C.documents(spark)
    index = L.LineIndex(spark, f"{tmp_path}/lines", docs.schema["doc_id"].dataType)
    for k in range(3):
        rows = L.line_hashes(docs.filter(F.col("doc_id") % 3 == k), "doc_id", "text", 10)
        rows.write.parquet(f"{tmp_path}/rows-{k}")
        index.add(spark.read.parquet(f"{tmp_path}/rows-{k}"), f"{tmp_path}/batch-{k}")
    runs = index.runs
    assert len(runs.runs()) == 2
    staged = runs.stage(spark.read.parquet(f"{tmp_path}/rows-0").groupBy("key").agg(F.min("doc_id").alias("owner")))
    plan = runs.run(lambda: runs.matched(staged)._jdf.queryExecution().executedPlan().toString())
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan and "Sort " not in plan


def test_line_index_by_calls(spark, tmp_path):
    """Calls in ascending order of ids that share an index are as one call."""
    docs = C.documents(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).cache()
    own = [(r.doc_id, r.text) for r in docs.collect()]
    x = F.col("lines")
    got = []
    for low, high in ((0, 17), (17, 18), (18, 1000)):
        out = L.dedup_lines(docs.filter(F.col("doc_id").between(low, high - 1)), batches=2, index=f"{tmp_path}/lines")
        got += out.select("doc_id", x.n_lines, x.n_dropped, F.sha2(F.coalesce(x.kept, F.lit("")), 256)).collect()
    assert Counter(map(tuple, got)) == Counter(C.line_dedup(own))


def test_hot_keys_are_dealt(spark, tmp_path, monkeypatch):
    from wavelane.llm import common

    monkeypatch.setattr(common, "FEW", 4)
    spark.range(500).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), F.col("id").alias("v")).write.parquet(f"{tmp_path}/many")
    many, one = spark.read.parquet(f"{tmp_path}/many"), spark.range(3, 14).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left"):
        assert Counter(map(tuple, common.spread_join(many, one, ["k"], ["v"], how).select("k", "v", "w").collect())) == Counter(map(tuple, many.join(one, "k", how).select("k", "v", "w").collect()))


def test_substring_dedup_of_random_overlaps(spark):
    import random

    r = random.Random(9)
    pool = [f"w{k}" for k in range(6)]
    parts = [" ".join(r.choice(pool) for _ in range(r.randint(5, 60))) for _ in range(25)]
    docs = spark.createDataFrame([(k, " ".join(r.choice(parts) for _ in range(r.randint(1, 4)))) for k in range(80)], "doc_id long, text string").cache()
    x = F.col("repeats")
    got = S.remove_repeats(docs, window=12, gram=4).select("text", x.n_words, x.n_removed, F.sha2(x.kept, 256)).collect()
    assert Counter(map(tuple, got)) == Counter((t, *b) for t, b in zip(texts(docs), C.substring_dedup(texts(docs), 12), strict=True))


@pytest.mark.parametrize("size,least", [(3, (85, 100)), (5, (80, 100))])
def test_near_duplicates(spark, size, least):
    docs = C.documents(spark).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # Row by row, whatever ids repeat or lack; a group is named by its smallest id.
    groups = C.near_groups([(k, t) for k, (_, t) in enumerate(rows)], size, *least)
    names = {}
    for k, n, c in groups:
        if n and rows[k][0] is not None:
            names[c] = min(names.get(c, rows[k][0]), rows[k][0])
    want = Counter((rows[k][0], n, names.get(c) if n else rows[k][0]) for k, n, c in groups)
    assert Counter(map(tuple, M.near_duplicates(docs, shingle=size, least=least).collect())) == want
    assert M.near_duplicates(C.empty(spark)).count() == 0


def test_near_duplicates_around_a_centre(spark):
    """Copies that each link with their base only, or with one another only, and a chain."""
    import random

    r = random.Random(2)
    base = [f"w{k}" for k in range(200)]
    docs = [(500, " ".join(base))]
    for k in range(60):
        ws = base.copy()
        for j in r.sample(range(200), r.randint(1, 8)):
            ws[j] = f"x{k}_{j}"
        docs.append((k, " ".join(ws)))
    chain = [f"c{k}" for k in range(100)]
    for k in range(20):
        docs.append((1000 + k, " ".join(chain[:k * 3] and [f"y{j}" for j in range(k * 3)] + chain[k * 3 :] or chain)))
    want = C.near_groups(docs, 3, 85, 100)
    got = M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), shingle=3, least=(85, 100)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_pigeonhole():
    """Signatures within the distance share a key."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (200, M.SYMBOLS)).astype("<u2")
    b = a.copy()
    for row in b:
        row[rng.choice(M.SYMBOLS, 2 * M.CHUNKS - 1, replace=False)] ^= 1
    assert (M.chunk_keys(a) == M.chunk_keys(b)).any(axis=1).all()


def test_representatives(spark):
    docs = C.documents(spark).filter("doc_id BETWEEN 11 AND 14")
    out = M.keep_representatives(docs)
    assert out.columns == docs.columns and {11, 14} <= {r.doc_id for r in out.collect()} and 13 not in {r.doc_id for r in out.collect()}
    odd = [(None, "a b c d e f g"), (None, "a b c d e f g"), (None, "A b c d e f g"), (None, None), (4, "other words than these are here"), (4, "not one of the same at all"), (5, "other words than these are here"), (None, "not one of the same at all")]
    kept = Counter((r.doc_id, r.text) for r in M.keep_representatives(spark.createDataFrame(odd, "doc_id long, text string")).collect())
    assert {(k, t) for k, t in kept if k == 4 or t is None} == {(4, odd[4][1]), (4, odd[5][1]), (None, None)} and (5, odd[6][1]) not in kept and (None, odd[7][1]) not in kept
    assert len([t for _, t in kept if t and t.lower() == odd[0][1]]) == 1


def test_hot_groups(spark, monkeypatch):
    """Hot classes, keys, centres and components are dealt and give what they give undealt."""
    from wavelane.llm import common

    monkeypatch.setattr(common, "FEW", 3)
    docs = C.documents(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    copies = spark.range(1000, 1031).select(F.col("id").alias("doc_id"), F.lit(docs.filter("doc_id = 11").first().text).alias("text"))
    docs = docs.select("doc_id", "text").union(copies).cache()
    want = C.near_groups([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100)
    assert sorted(map(tuple, M.near_duplicates(docs).collect())) == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab Zé\n\t.日", max_size=30), max_size=6))
def test_words_of_a_slice(docs):
    raw = [t.encode() for t in docs]
    off = np.cumsum([0] + [len(r) for r in raw])
    w = V.Words(np.frombuffer(b"".join(raw), np.uint8), off, V.byte_table(V.SPACES, lower=True))
    got = [[bytes(w.buf[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.ptr, w.ptr[1:], strict=False)]
    assert got == [C.space_words(t) for t in docs]
    flat = [C.lower(x) for ws in got for x in ws]
    assert len(set(w.hash.tolist())) == len(set(flat))
