"""The scorer's sample, and scores that depend on the text alone."""

import numpy as np

from tests.llm import cases as C
from wavelane.llm import quality as Q


def test_scorer_sees_the_whole_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "Scorer", lambda x, y: seen.append((x.shape, x.sum(axis=1).min())))
    docs = spark.createDataFrame([(k, C.prose(4, k)) for k in range(4300)], "doc_id long, text string")
    assert Q.fit(docs) is not None and seen[0][0] == (4000, 4096) and seen[0][1] >= 10


def test_scores_depend_on_the_text_alone():
    rng = np.random.default_rng(0)
    scorer = Q.Scorer.__new__(Q.Scorer)
    scorer.w, scorer.b = rng.normal(size=Q.BUCKETS), 0.1
    texts = ["", "a", "ab", "abc", "", "Some words here, twice twice.", "é", "!!! 12", C.prose(9, 1), "x"]

    def run(docs):
        raw = [t.encode() for t in docs]
        off = np.cumsum([0] + [len(r) for r in raw])
        w = Q.V.Words(np.frombuffer(b"".join(raw), np.uint8), off, Q._WORDS)
        return dict(zip(docs, zip(scorer.scores(w, off).tolist(), Q._counts(w, off), strict=True), strict=True))

    alone = {t: run([t])[t] for t in texts}
    for order in (texts, texts[::-1], texts[3:] + texts[:3]):
        assert run(order) == alone
