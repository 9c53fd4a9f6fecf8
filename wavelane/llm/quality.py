"""Quality classifier: a weak-label model over heuristics, then a hashed linear scorer.

`LABELLERS` look at a text's shape and vote good, bad or abstain. Votes of all
documents are counted by pattern (at most 3 ** labellers of them), and
expectation-maximisation on these counts estimates how often each labeller votes
what in either class, and with that every pattern's posterior of being good. The
posteriors label at most `TRAIN` rows (least hashes of their ids, each text once), on which a
logistic scorer over `BUCKETS` hashed features is trained: four-byte runs of the
text with letters folded to their kind and words said twice in a row marked. Its score decides; a document is kept at
`KEEP` or more.

Defined results: null and word-less texts score 0 and are not kept. Rows that
repeat an id are judged row by row; a null id changes nothing but is never
trained on. Empty tables give empty results. Other columns aren't read, and an
input column named like the result column is replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import vectext as V
from .common import table, with_struct, without

TRAIN = 4000
BUCKETS = 4096
KEEP = 0.5
GOOD, BAD, ABSTAIN = 2, 1, 0

_WORDS = V.byte_table(V.SPACES, lower=False)


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _bytes("abcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = True
_DIGIT = _bytes("0123456789")
_SPACE = _bytes("\t\n\v\f\r ")
_PLAIN = _bytes(".,;:'\"()-?!/")
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _PLAIN)
_STOP = _bytes(".?!")

#: Letters of one case, digits and all of 80-FF fold to one code each.
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[97:123], _FOLD[65:91], _FOLD[48:58], _FOLD[128:] = 97, 65, 48, 97


def repeats(w: V.Words) -> np.ndarray:
    """Whether each word is the one before it in its document."""
    same = np.zeros(len(w.hash), bool)
    same[1:] = w.hash[1:] == w.hash[:-1]
    same[w.ptr[:-1][w.ptr[:-1] < len(same)]] = False
    return same


def shape(w: V.Words, off: np.ndarray) -> dict[str, np.ndarray]:
    """Numbers about each document of a slice."""

    def per(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return (total[off[1:]] - total[off[:-1]]).astype(float)

    def share(a, b):
        return a / np.maximum(b, 1)

    buf, n = w.buf, np.diff(w.ptr).astype(float)
    size = np.diff(off).astype(float)
    letters = per(_LETTER[buf])
    first = np.lexsort((w.hash, w.doc_of()))
    new = np.ones(len(first), bool)
    if len(first):
        doc, h = w.doc_of()[first], w.hash[first]
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        distinct = np.bincount(doc[new], minlength=w.docs).astype(float)
        ends = np.zeros(len(buf), bool)
        ends[w.end - 1] = True
        whole = per(ends & _STOP[buf])
        odd = per(ends & ~(_LETTER | _DIGIT | _PLAIN)[buf])
    else:
        distinct = whole = odd = np.zeros(w.docs)
    return {
        "words": n,
        "letters": share(letters, size),
        "symbols": share(per(_SYMBOL[buf]), size),
        "upper": share(per(_UPPER[buf]), letters),
        "digits": share(per(_DIGIT[buf]), size),
        "shouts": share(per(buf == ord("!")), n),
        "distinct": share(distinct, n),
        "sentences": share(whole, n),
        "odd_ends": share(odd, n),
        "word_size": share(letters, n),
        "repeats": share(np.bincount(w.doc_of()[repeats(w)], minlength=w.docs).astype(float), n),
    }


#: name, number, vote bad where this holds, vote good where that holds.
LABELLERS = (
    ("symbols", "symbols", lambda x: x > 0.03, lambda x: x < 0.008),
    ("capitals", "upper", lambda x: x > 0.4, lambda x: x < 0.15),
    ("letters", "letters", lambda x: x < 0.65, lambda x: x > 0.72),
    ("shouts", "shouts", lambda x: x > 0.3, lambda x: x < 0.1),
    ("word ends", "odd_ends", lambda x: x > 0.15, lambda x: x < 0.05),
    ("sentences", "sentences", lambda x: (x < 0.015) | (x > 0.6), lambda x: (x > 0.03) & (x < 0.4)),
    ("word size", "word_size", lambda x: (x < 2) | (x > 14), lambda x: (x > 3) & (x < 11)),
    ("digits", "digits", lambda x: x > 0.2, lambda x: x < 0.05),
    ("repeats", "repeats", lambda x: x > 0.2, lambda x: x < 0.05),
    ("variety", "distinct", lambda x: x < 0.15, lambda x: x > 0.3),
)


def votes(w: V.Words, off: np.ndarray) -> np.ndarray:
    """(documents, labellers) of GOOD, BAD and ABSTAIN."""
    s = shape(w, off)
    out = np.zeros((w.docs, len(LABELLERS)), np.int64)
    for k, (_, number, bad, good) in enumerate(LABELLERS):
        out[:, k] = np.where(bad(s[number]), BAD, np.where(good(s[number]), GOOD, ABSTAIN))
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1])


def unpack(patterns: np.ndarray, n: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(n) % 3


class LabelModel:
    """Two classes; rates[c, k, v] is how often labeller k votes v in class c."""

    def __init__(self, v: np.ndarray, counts: np.ndarray, rounds: int = 200):
        n = v.shape[1]
        good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
        post = np.clip((good + 1) / (good + bad + 2), 0.05, 0.95)
        hot = (v[:, :, None] == np.arange(3)).astype(float)
        for _ in range(rounds):
            self.prior = np.array([((1 - post) * counts).sum() + 1, (post * counts).sum() + 1])
            self.prior /= self.prior.sum()
            self.rates = np.stack([np.einsum("p,pkv->kv", c * counts, hot) + 0.5 for c in (1 - post, post)])
            self.rates /= self.rates.sum(axis=2, keepdims=True)
            new = self.posterior(v)
            if np.abs(new - post).max() < 1e-9:
                break
            post = new
        self.accuracy = np.array([(self.prior[0] * self.rates[0, k, BAD] + self.prior[1] * self.rates[1, k, GOOD]) / max(1e-9, 1 - self.prior @ self.rates[:, k, ABSTAIN]) for k in range(n)])

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of the class whose votes are good."""
        k = np.arange(v.shape[1])
        logs = [np.log(self.prior[c]) + np.log(self.rates[c][k, v]).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def features(w: V.Words, off: np.ndarray) -> np.ndarray:
    """The hashed feature at each byte: it and the three before it in its document, folded; a word said again is one letter R."""
    c = _FOLD[w.buf]
    again = np.flatnonzero(repeats(w))
    size = w.end[again] - w.start[again]
    c[np.repeat(w.start[again], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = 82
    run = c.copy()
    for k in (1, 2, 3):
        before = c[:-k] << V.U(8 * k)
        # The first k bytes of a document have none of its own so far before them.
        start = (off[:-1, None] + np.arange(k)).ravel() - k
        before[start[(start >= 0) & (start < len(before))]] = 0
        run[k:] |= before
    return (V.mix(run) >> V.U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _counts(w: V.Words, off: np.ndarray) -> list[bytes]:
    """Each document's feature counts; packed, as most are 0 and the driver collects them."""
    f = features(w, off)
    return [zlib.compress(np.minimum(np.bincount(f[a:b], minlength=BUCKETS), 65535).astype("<u2").tobytes(), 1) for a, b in zip(off[:-1], off[1:], strict=True)]


class Scorer:
    """Logistic regression on the shares of hashed features, trained on soft labels."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.3, decay: float = 1e-4):
        x /= np.maximum(x.sum(axis=1, keepdims=True), 1)  # in place: the driver holds one matrix
        self.scale = 1 / np.maximum(np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)), 1e-4)
        x *= self.scale
        weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
        weight /= weight.mean()
        w, b = np.zeros(x.shape[1], np.float32), 0.0
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(x @ w / 32 + b, -30, 30)))
            d = ((p - y) * weight / len(y)).astype(np.float32)
            g = np.append(x.T @ d / 32 + decay * w, d.sum())
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            step = rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            w, b = w - step[:-1].astype(np.float32), b - step[-1]
        self.w, self.b = (w * self.scale / 32).astype(np.float64), float(b)

    def scores(self, w: V.Words, off: np.ndarray) -> np.ndarray:
        # Added up from each document's start, so the rounding is its own as well.
        total = np.bincount(np.repeat(np.arange(w.docs), np.diff(off)), self.w[features(w, off)], w.docs)
        z = total / np.maximum(np.diff(off), 1) + self.b
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def vote_patterns(docs: DataFrame, text: str) -> DataFrame:
    """The vote pattern of each row that has words."""
    schema = T.StructType([T.StructField("pattern", T.LongType())])

    def go(batches):
        for batch in batches:
            for part in V.slices(batch, text):
                buf, off = V.utf8(part.column(text))
                w = V.Words(buf, off, _WORDS)
                yield pa.RecordBatch.from_arrays([pa.array(pattern(votes(w, off))[np.diff(w.ptr) > 0])], names=["pattern"])

    return docs.select(text).mapInArrow(go, schema)


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", train: int = TRAIN) -> tuple[LabelModel, Scorer] | None:
    rows = vote_patterns(docs, text).groupBy("pattern").count().collect()  # at most 3 ** labellers
    if not rows:
        return None
    rows.sort()
    model = LabelModel(unpack(np.array([r[0] for r in rows]), len(LABELLERS)), np.array([r[1] for r in rows], float))
    rows = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("k"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    least = rows.select("k", "th").orderBy(F.xxhash64("k"), "k", "th").limit(train).distinct()  # at most `train` rows
    few = rows.join(F.broadcast(least), ["k", "th"]).dropDuplicates(["k", "th"]).select("k", "t")
    schema = T.StructType([T.StructField("k", docs.schema[doc_id].dataType), T.StructField("pattern", T.LongType()), T.StructField("x", T.BinaryType())])

    def go(batches):
        for batch in batches:
            for part in V.slices(batch, "t"):
                buf, off = V.utf8(part.column("t"))
                w = V.Words(buf, off, _WORDS)
                out = pa.RecordBatch.from_arrays([part.column("k"), pa.array(pattern(votes(w, off))), pa.array(_counts(w, off), pa.binary())], names=schema.names)
                yield out.filter(pa.array(np.diff(w.ptr) > 0))

    got = few.mapInArrow(go, schema).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r[0], r[1], bytes(r[2])))
    x = np.empty((len(got), BUCKETS), np.float32)
    for i, r in enumerate(got):
        x[i] = np.frombuffer(zlib.decompress(r[2]), "<u2")
    y = model.posterior(unpack(np.array([r[1] for r in got]), len(LABELLERS)))
    del got
    return model, Scorer(x, y)


RESULT = T.StructType([T.StructField("votes", T.ArrayType(T.IntegerType())), T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])


def judge(docs: DataFrame, fitted: tuple[LabelModel, Scorer] | None, *, text: str = "text", into: str = "quality") -> DataFrame:
    """docs with a struct column `into`: votes, posterior, score, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    docs = without(docs, into)
    schema = with_struct(docs.schema, into, RESULT)

    def go(batches):
        arrow, fitted = to_arrow_schema(schema), shared.value
        for batch in batches:
            for part in V.slices(batch, text):
                buf, off = V.utf8(part.column(text))
                w = V.Words(buf, off, _WORDS)
                v, some = votes(w, off), np.diff(w.ptr) > 0
                post, score = (np.zeros(w.docs),) * 2 if fitted is None else (fitted[0].posterior(v), fitted[1].scores(w, off))
                made = [{"votes": a.tolist(), "posterior": float(p) if ok else 0.0, "score": float(s) if ok else 0.0, "kept": bool(ok and s >= KEEP)} for a, p, s, ok in zip(v, post, score, some, strict=True)]
                cols = [pa.array(made, arrow.field(into).type) if f.name == into else part.column(f.name) for f in schema.fields]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return docs.mapInArrow(go, schema)


def keep_good(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those rejected; all columns stay."""
    into = "__quality"
    return judge(docs, fit(docs, doc_id=doc_id, text=text), text=text, into=into).filter(F.col(f"{into}.kept")).drop(into)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = F.col("quality")
    return judge(docs, fit(docs)).select("doc_id", F.array_join(x.votes.cast("array<string>"), "").alias("votes"), x.posterior.alias("posterior"), x.score.alias("score"), x.kept.alias("kept"))
