"""Operators with tokenizers and trained models."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm import cases as C
from wavelane.llm import additive_quant as A, language_id as G, license_scan as I, packing as P, quality as Q, token_counts as K


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def test_tokens_are_those_of_the_library(tokenizer, spark):
    enc = P.encoder()
    docs = [t for t in C.texts()] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    docs += ["a\r\n\r\n  b", "don't I'LL we've", " x\u0085y", "tab\t\ttab ", " " * 300 + "x", "😀👍🏽 é", "12345 ٣٤٥", "<|endoftext|><|endoftext|>"]
    for t in docs:
        assert P.token_ids(t, enc).tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, P.END]


def check_packing(got, docs, tokenizer):
    ids = {}
    for k, t in docs:
        ids.setdefault(k, []).append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, P.END], "<u4"))
    want = sorted((k is None, k or 0, zlib.crc32(a[s : s + P.CAPACITY].tobytes()), s, len(a[s : s + P.CAPACITY]), len(a)) for k, xs in ids.items() for a in xs for s in range(0, len(a), P.CAPACITY))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_crc32, r.start, r.length, r.doc_tokens) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= P.CAPACITY
    return len(by)


def test_packing(spark, tokenizer):
    docs = C.documents(spark).cache()
    got = P.pack(docs, keep_ids=True).collect()
    check_packing(got, [(r.doc_id, r.text) for r in docs.collect()], tokenizer)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert P.pack(C.empty(spark)).count() == 0


def test_packing_pads_little(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = P.pack(docs).cache()
    total = P.padding(out).first()
    assert total.padding < 0.01 * total.tokens
    assert check_packing(out.collect(), [(r.doc_id, r.text) for r in docs.collect()], tokenizer) == total.sequences


def test_plan_holds_every_piece():
    rng = np.random.default_rng(1)
    for n, cap in ((1, 20), (40, 20), (5000, 64), (3, 256)):
        sizes = rng.integers(1, cap + 1, n)
        hist = dict(zip(*[x.tolist() for x in np.unique(sizes, return_counts=True)], strict=True))
        plan, got = P.sequences(hist, cap), {}
        for pattern, k in plan:
            assert sum(c * a for c, a in pattern.items()) <= cap and k > 0
            for c, a in pattern.items():
                got[c] = got.get(c, 0) + a * k
        assert got == hist
    assert P.sequences({}, 8) == []


def test_token_trees(tokenizer):
    import random

    enc, r = P.encoder(), random.Random(3)
    bits = ["the ", "foo", "  ", "\n", "é", "12", " x", "'s", "!!", "\t", "a" * 30, "日本", "<|endoftext|>", " "]
    count = lambda s: len(tokenizer.encode(s, add_special_tokens=False).ids)
    for _ in range(60):
        now = "".join(r.choice(bits) for _ in range(r.randint(0, 80)))
        tree = K.TokenTree(now.encode(), enc, leaf=r.choice([4, 16]))
        for _ in range(3):
            a = r.randint(0, len(now))
            b, put = min(len(now), a + r.choice([0, 1, 20])), r.choice([*bits, ""])
            tree.replace(len(now[:a].encode()), len(now[:b].encode()), put.encode())
            now = now[:a] + put + now[b:]
            assert tree.text() == now.encode() and tree.total == count(now)
    with pytest.raises(ValueError):
        tree.replace(0, 10**6, b"")


def test_leaves_stay_small(tokenizer):
    """Thousands of edits at one place, and in many: what is encoded again stays bounded."""
    import random

    enc, r = P.encoder(), random.Random(8)
    tree, now = K.TokenTree(b"start end", enc, leaf=64), b"start end"
    for k in range(2000):
        before = tree.encoded_bytes
        at = min(5, len(now)) if k % 2 else r.randint(0, len(now))
        stop = at if r.random() < 0.7 else min(len(now), at + r.randint(0, 12))
        put = r.choice([b" word", b"x", b" 12 ", b"\n", b""])
        tree.replace(at, stop, put)
        now = now[:at] + put + now[stop:]
        assert tree.encoded_bytes - before < 64 * 12
    assert tree.text() == now and max(map(len, tree.leaves)) < 64 * 4 and len(tree.leaves) > len(now) / 200
    assert tree.total == len(tokenizer.encode(now.decode(), add_special_tokens=False).ids)
    tree.replace(0, tree.length, b"")
    assert (tree.total, tree.text(), tree.leaves) == (0, b"", [b""])
    tree.replace(0, 0, "é new".encode())
    assert tree.text() == "é new".encode()


def test_edits_that_are_refused(spark):
    schema = "doc_id long, text string, edits array<struct<start: long, stop: long, put: string>>, tree string, tokens string"
    rows = [
        (1, "one été three", [(0, 3, "1"), (None, 2, "x"), (2, 5, "overlaps"), (5, 6, "cuts"), (4, 9, None), (9, 9, "a"), (9, 9, "b"), (3, 2, "x"), (0, 99, "x"), (-1, 0, "x"), (15, 15, "!"), None], "", ""),
        (2, None, [(0, 0, "x")], "", ""), (None, "", [(0, 0, "put")], "", ""), (3, "kept", None, "", ""), (3, "kept", [], "", ""),
    ]
    got = {(r.doc_id, r.n_edits, r.n_refused): r.edited for r in K.count_edited(spark.createDataFrame(rows, schema), "edits").select("doc_id", "tokens.*").collect()}
    assert got == {(1, 5, 7): "1 ab three!", (2, 0, 1): None, (None, 1, 0): "put", (3, 0, 0): "kept"}


def test_stored_trees_take_later_edits(spark, tokenizer, tmp_path):
    docs = C.documents(spark).withColumn("edits", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"), F.lit("new head ").alias("put"))))
    K.token_trees(docs, leaf=32).write.parquet(f"{tmp_path}/0")
    for k in range(3):
        out = K.edit_trees(spark.read.parquet(f"{tmp_path}/{k}"), "edits", leaf=32)
        out.write.parquet(f"{tmp_path}/{k + 1}")
    for r in spark.read.parquet(f"{tmp_path}/3").select("text", "tree", "tokens.*").collect():
        if r.text is None:
            assert r.tree is None and (r.n_edits, r.n_refused) == (0, 1)
        else:
            assert "".join(r.tree.leaves) == "new head " * 3 + r.text and r.n_edits == 1 and r.n_leaves_encoded <= 3
            assert sum(r.tree.tokens) == r.n_tokens_after == len(tokenizer.encode("new head " * 3 + r.text, add_special_tokens=False).ids)


def test_counts_after_edits(spark, tokenizer):
    mail = C.documents(spark).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" write to a.b@c.example.com or 10.0.0.1 now"))).otherwise(F.col("text")))
    out = K.count_edited(K.redactions(mail), "edits").select("text", "tokens.*").collect()
    for r in out:
        assert r.n_refused == 0 and r.n_tokens == len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        assert r.n_tokens_after == len(tokenizer.encode(r.edited or "", add_special_tokens=False).ids)
        assert r.n_edits == (2 if r.text and "@" in r.text else 0)
    long = [r for r in out if r.n_leaves > 50 and r.n_edits]
    assert long and all(r.n_leaves_encoded < 15 for r in long)
    assert K.count_edited(K.redactions(C.empty(spark)), "edits").count() == 0


def test_licenses(spark):
    s = I.Scanner(I.TEMPLATES)
    assert all(s.best(t.encode())[0] == name for name, t in I.TEMPLATES.items())
    assert s.best(b"We need your permission to enter the house tonight.") is None
    docs = spark.createDataFrame([(1, "x\n  licensed under the MIT license, that is: Released under the MIT License.\ny"), (2, None), (3, ""), (4, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0."), (4, "plain")], "doc_id long, text string")
    got = I.scan_licenses(docs).select("text", "licenses.*").collect()
    names = {r.text: [f.license for f in r.found] for r in got}
    assert names["Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0."] == ["CC-BY-NC-4.0", "CC-BY-4.0"] and names[None] == names[""] == names["plain"] == []
    assert any(v == ["MIT"] for v in names.values())
    planted = spark.read.parquet(f"{SF}/documents.parquet").filter(F.col("text").contains("GNU General Public License, version 3."))
    assert all("GPL-3.0" in [f.license for f in r.found] for r in I.scan_licenses(planted).select("licenses.*").collect())
    assert I.scan_licenses(C.empty(spark)).count() == 0 and I.scan_licenses(C.documents(spark)).count() == C.documents(spark).count()


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fitted = Q.fit(docs)
    assert (fitted[0].accuracy > 0.7).all()
    got = Q.judge(docs, fitted).join(labels.withColumnRenamed("quality", "good"), "doc_id").select("good", "quality.kept").collect()
    bad = [r.kept for r in got if r.good == 0]
    assert np.mean([r.kept for r in got if r.good == 1]) > 0.98 and np.mean(bad) < 0.1


def test_quality_edges(spark):
    docs = C.documents(spark)
    out = Q.judge(docs, Q.fit(docs)).select("text", "quality.*").collect()
    assert len(out) == docs.count() and all(not r.kept and r.score == 0 for r in out if not C.space_words(r.text))
    assert Q.fit(C.empty(spark)) is None and Q.judge(docs, None).filter("quality.kept").count() == 0
    assert Q.keep_good(docs).columns == docs.columns


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20000) < 0.7
    right = np.array([0.95, 0.85, 0.7, 0.9])
    v = np.where(rng.random((20000, 4)) < right, good[:, None], ~good[:, None]).astype(int) + 1
    v[rng.random(v.shape) < 0.2] = Q.ABSTAIN
    u, n = np.unique(Q.pattern(v), return_counts=True)
    m = Q.LabelModel(Q.unpack(u, 4), n.astype(float))
    assert np.abs(m.accuracy - right).max() < 0.03 and abs(m.prior[1] - 0.7) < 0.03


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = G.fit(docs)
    got = G.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").filter(G.held_out(F.col("doc_id"))).collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    odd = G.identify(C.documents(spark), net).collect()
    assert len(odd) == C.documents(spark).count() and all(0 <= r.score <= 1 for r in odd)
    none = G.identify(spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "der")], "doc_id long, text string"), net).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in none] == [True, True, True, False]
    assert G.fit(C.empty(spark)) is None and {r.lang_pred for r in G.identify(C.documents(spark), None).collect()} == {"und"}


def test_held_out_rule(spark):
    got = spark.range(200).select("id", G.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
    leaks = spark.createDataFrame([(k, "text", "held" if zlib.crc32(str(k).encode()) % 4 == 2 else "free") for k in range(100)], "doc_id long, text string, lang string")
    assert {r[0] for r in G.sample(leaks, "doc_id", "text", "lang", 1000).select("l").distinct().collect()} == {"free"}


def test_gradients():
    net = G.Network(["a", "b", "c"], hidden=4)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    p, s, y = np.random.default_rng(0).integers(0, 256, (5, 7)).astype(np.uint8), np.array([7, 7, 3, 1, 5]), np.array([0, 1, 2, 0, 1])

    def loss():
        pr = net.positions(net.states(G.both_ways(p)))
        return float(-(np.log(pr[:, np.arange(5), y]) * (np.arange(7)[:, None] < s)).sum() / s.sum())

    g = net.gradients(p, s, y)
    for name, at in (("e", (0, int(p[0, 2]), 3)), ("u", (1, 2, 5)), ("b", (0, 0, 7)), ("w", (1, 3, 2)), ("c", (1,))):
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-3
        up = loss()
        net.p[name][at] = keep - 1e-3
        assert abs((up - loss()) / 2e-3 - g[name][at]) < 1e-5
        net.p[name][at] = keep


def exact(rows, k, every):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        c = np.round(x @ x[i], 12)
        c[i] = -9
        out[ids[i]] = ids[np.lexsort((ids, -c))][: min(k, len(ids) - 1)].tolist()
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_neighbours(spark, sf):
    v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = A.search(v, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()
    want = exact([(r.vec_id, r.embedding) for r in v.collect()], 5, 50)
    own = {}
    for r in got:
        own.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(own[r.query_id])
    assert own.keys() == want.keys()
    assert np.mean([len(set(own[q]) & set(want[q])) / len(want[q]) for q in want]) >= 0.95


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [0.0, 1.0]), (9, [-1.0, 0.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [2.0, 4.0, 6.0]), (101, [0.0, 0.0, 1.0]), (150, [5.0])]
    df = spark.createDataFrame([(i, v, "x", i, 0.5) for i, v in rows], "vec_id long, embedding array<double>, rep string, id long, score double")
    got = A.search(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0] == [1, 2, 50, 8, 9] and [r.vec_id for r in got if r.query_id == 50] == [0, 1, 2, 8, 9]
    assert [r.score for r in got if r.query_id == 0] == [1.0, 1.0, 1.0, 0.0, -1.0]
    assert [(r.vec_id, r["rank"]) for r in got if r.query_id == 100] == [(10, 1), (101, 2)] and not [r for r in got if r.query_id == 150]
    assert A.search(df.limit(0), F.col("id") % 50 == 0).count() == 0
    few = A.search(df.filter("vec_id IN (0, 8)"), F.col("id") % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, 1, 8)]
    hot = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.when(F.col("id") < 2000, 0.5).otherwise(F.col("id") * 0.001)).alias("embedding"))
    assert [r.vec_id for r in A.search(hot, F.col("id") == 1500).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
