"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are read as bytes, in pieces of `STEPS`. Two gated recurrent layers run over
each piece, one in either direction; at every position both states give a
distribution over the languages. A document's probabilities are the mean over all
positions of its whole text. The network is trained here, in numpy, by
backpropagation through time.

Training rows: at most `PER_LANG` of each language (least hashes of id and text;
repeated rows count once), `PIECES` pieces of each, spread over its text. What is
collected, broadcast and learnt is so bounded by the number of languages. Documents held out
(crc32 of the id as text, modulo 4, is 2) are never among them; a prediction sees
the text only.

Defined results: null text or text without a letter is `und` with score 0; so is
everything if no row has a language. Rows that repeat an id are judged row by
row; a null id isn't held out, and isn't trained on. Empty tables give empty
results. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as V
from .common import table

STEPS = 64
HIDDEN = 8
PER_LANG = 1500
PIECES = 6
UPDATES = 500
BATCH = 256
#: Pieces that go through the network at once in a prediction.
WIDTH = 1024
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    """Both directions at once: arrays have the direction as first axis."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        f = np.float32
        self.p = {
            "e": rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(f),
            "u": rng.normal(0, hidden**-0.5, (2, hidden, 3 * hidden)).astype(f),
            "b": np.zeros((2, 1, 3 * hidden), f),
            "w": rng.normal(0, (2 * hidden) ** -0.5, (2, hidden, len(langs))).astype(f),
            "c": np.zeros(len(langs), f),
        }

    def states(self, codes: np.ndarray, trace: list | None = None) -> np.ndarray:
        """codes: (2, steps, n), the second reversed; gives h: (2, steps, n, hidden) in each one's order."""
        k, (_, steps, n) = self.hidden, codes.shape
        e, u = self.p["e"] + self.p["b"], self.p["u"]
        h = np.zeros((2, n, k), np.float32)
        out = np.empty((2, steps, n, k), np.float32)
        for t in range(steps):
            x = np.stack([e[0].take(codes[0, t], axis=0), e[1].take(codes[1, t], axis=0)])
            a = h @ u
            gates = _sigmoid(x[:, :, : 2 * k] + a[:, :, : 2 * k])
            z, r = gates[:, :, :k], gates[:, :, k:]
            new = np.tanh(x[:, :, 2 * k :] + r * a[:, :, 2 * k :])
            if trace is not None:
                trace.append((h, z, r, new, a[:, :, 2 * k :]))
            h = new + z * (h - new)
            out[:, t] = h
        return out

    def positions(self, h: np.ndarray) -> np.ndarray:
        """(steps, n, languages): probabilities at every position."""
        s = h[0] @ self.p["w"][0] + h[1, ::-1] @ self.p["w"][1] + self.p["c"]
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        return s

    def gradients(self, pieces: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over positions; pieces: (n, steps)."""
        k, (n, steps) = self.hidden, pieces.shape
        codes = both_ways(pieces)
        trace: list = []
        h = self.states(codes, trace)
        d = self.positions(h)
        d[:, np.arange(n), label] -= 1
        d *= (np.arange(steps)[:, None] < sizes)[:, :, None] / max(1, int(sizes.sum()))
        back = np.stack([d, d[::-1]])
        g = {name: np.zeros_like(x) for name, x in self.p.items()}
        g["c"] = d.sum(axis=(0, 1))
        g["w"] = np.einsum("dtnk,dtnl->dkl", h, back)
        down = back @ self.p["w"].transpose(0, 2, 1)[:, None]
        dx = np.empty((2, steps, n, 3 * k), np.float32)
        dh = np.zeros((2, n, k), np.float32)
        for t in range(steps - 1, -1, -1):
            before, z, r, new, a = trace[t]
            dh = dh + down[:, t]
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (before - new) * z * (1 - z)
            dr = dnew * a * r * (1 - r)
            da = np.concatenate([dz, dr, dnew * r], axis=2)
            dx[:, t] = np.concatenate([dz, dr, dnew], axis=2)
            g["u"] += before.transpose(0, 2, 1) @ da
            dh = dh * z + da @ self.p["u"].transpose(0, 2, 1)
        flat = dx.reshape(2, -1, 3 * k)
        g["b"] = flat.sum(axis=1, keepdims=True)
        for s in range(2):
            at = codes[s].ravel()
            for j in range(3 * k):
                g["e"][s, :, j] = np.bincount(at, weights=flat[s, :, j], minlength=256)
        return g

    def train(self, pieces: np.ndarray, sizes: np.ndarray, label: np.ndarray, updates: int = UPDATES, rate: float = 0.02, seed: int = 5) -> None:
        """Adam; a batch draws languages alike, and pieces alike within one."""
        rng = np.random.default_rng(seed)
        m = {name: np.zeros_like(x) for name, x in self.p.items()}
        v = {name: np.zeros_like(x) for name, x in self.p.items()}
        of = [np.flatnonzero(label == k) for k in range(len(self.langs))]
        for step in range(1, updates + 1):
            own = np.concatenate([rng.choice(x, -(-BATCH // len(of))) for x in of])
            now = rate * (1 - 0.95 * step / updates)
            for name, g in self.gradients(pieces[own], sizes[own], label[own]).items():
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.01 * (g * g - v[name])
                self.p[name] -= now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-7)

    def documents(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean probabilities of each document of a slice."""
        pieces, sizes, doc = cut(buf, off)
        out = np.zeros((len(off) - 1, len(self.langs)))
        for i in range(0, len(pieces), WIDTH):
            p = pieces[i : i + WIDTH]
            probs = self.positions(self.states(both_ways(p)))
            probs *= (np.arange(p.shape[1])[:, None] < sizes[i : i + WIDTH])[:, :, None]
            np.add.at(out, doc[i : i + WIDTH], probs.sum(axis=0))
        return out / np.maximum(np.diff(off), 1)[:, None]


def both_ways(pieces: np.ndarray) -> np.ndarray:
    return np.stack([pieces.T, pieces.T[::-1]])


def cut(buf: np.ndarray, off: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces of all documents: (bytes padded with 0, sizes, document)."""
    lens = np.diff(off)
    n = -(-lens // steps)
    doc = np.repeat(np.arange(len(lens)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start, size = off[doc] + nth * steps, np.minimum(lens[doc] - nth * steps, steps)
    padded = np.append(buf, np.zeros(steps, np.uint8))
    pieces = padded[start[:, None] + np.arange(steps)]
    pieces[np.arange(steps) >= size[:, None]] = 0
    return pieces, size, doc


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _least(keyed: DataFrame, sizes: dict[str, int], per_lang: int, whole: bool = False) -> list:
    """(l, h) of the per_lang least hashes of each language in sizes.

    Only hashes below a mark are ranked that leaves somewhat more than per_lang of
    evenly spread ones; so no language's rows meet in one task.
    """
    marks = [(l, float(-(2**63) + 2**64 * (1.0 if whole else min(1.0, (per_lang + 8 * per_lang**0.5 + 32) / n)))) for l, n in sizes.items()]
    marks = keyed.sparkSession.createDataFrame(marks, "l string, mark double")
    low = keyed.join(F.broadcast(marks), "l").filter(F.col("h") <= F.col("mark")).select("l", "h").distinct()
    return low.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).filter(F.col("r") <= per_lang).select("l", "h").collect()


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, per_lang: int) -> DataFrame:
    """(l, piece, size): at most PIECES pieces of at most per_lang rows a language, rows that repeat id and text once."""
    key = F.col(doc_id)
    rows = docs.filter(key.isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).select(F.col(lang).alias("l"), F.xxhash64(key, text).alias("h"), F.col(text).alias("t"))
    sizes = {r[0]: r[1] for r in rows.groupBy("l").count().collect()}  # a row a language
    few = _least(rows, sizes, per_lang) if sizes else []
    had = {l: 0 for l in sizes}
    for l, _ in few:
        had[l] += 1
    # Where rows repeat, fewer hashes lie below the mark than the count let expect.
    if short := {l: n for l, n in sizes.items() if had[l] < min(per_lang, n)}:
        few = [r for r in few if r[0] not in short] + _least(rows, short, per_lang, whole=True)
    few = docs.sparkSession.createDataFrame(few, "l string, h long")
    rows = rows.join(F.broadcast(few), ["l", "h"]).dropDuplicates(["l", "h"])
    schema = T.StructType([T.StructField("l", T.StringType()), T.StructField("piece", T.BinaryType()), T.StructField("size", T.IntegerType())])

    def go(batches):
        for batch in batches:
            langs, pieces, sizes = [], [], []
            for l, t in zip(batch.column("l").to_pylist(), batch.column("t").to_pylist(), strict=True):
                raw = np.frombuffer(t.encode(), np.uint8)
                p, s, _ = cut(raw, np.array([0, len(raw)]))
                for j in sorted({len(p) * k // PIECES for k in range(PIECES)}) if len(p) else []:
                    langs.append(l)
                    pieces.append(p[j].tobytes())
                    sizes.append(int(s[j]))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pieces, pa.binary()), pa.array(sizes, pa.int32())], names=["l", "piece", "size"])

    return rows.select("l", "t").mapInArrow(go, schema)


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> Network | None:
    rows = sample(docs, doc_id, text, lang, per_lang).collect()  # at most per_lang * PIECES pieces a language
    if not rows:
        return None
    rows.sort(key=lambda r: (r[0], bytes(r[1])))
    langs = sorted({r[0] for r in rows})
    net = Network(langs)
    pieces = np.frombuffer(b"".join(bytes(r[1]) for r in rows), np.uint8).reshape(len(rows), STEPS)
    net.train(pieces, np.array([r[2] for r in rows]), np.array([langs.index(r[0]) for r in rows]))
    return net


def identify(docs: DataFrame, net: Network | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, probs (in the order of net.langs) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("probs", T.ArrayType(T.DoubleType()))])

    def go(batches):
        net = shared.value
        for batch in batches:
            for part in V.slices(batch, text):
                fine = np.array([x is True for x in part.column("__letter").to_pylist()], bool)
                if net is None:
                    probs, fine = np.zeros((part.num_rows, 0)), np.zeros(part.num_rows, bool)
                else:
                    probs = np.clip(net.documents(*V.utf8(part.column(text))), 0, 1)
                best = probs.argmax(axis=1) if probs.shape[1] else np.zeros(len(probs), int)
                names = [net.langs[b] if ok else UNKNOWN for b, ok in zip(best, fine, strict=True)]
                score = [float(p[b]) if ok else 0.0 for p, b, ok in zip(probs, best, fine, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(doc_id), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(list(probs), pa.list_(pa.float64()))], names=schema.names)

    return docs.select(doc_id, text, F.col(text).rlike(r"\p{L}").alias("__letter")).mapInArrow(go, schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
