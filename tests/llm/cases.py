"""Small documents with everything that may go wrong, and brute-force results."""

import hashlib
import random
import re

from pyspark.sql import types as T

# Extra columns are named like the operators' own.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())] + [T.StructField(n, T.StringType()) for n in ("n_words", "key", "batch", "node", "component", "a", "m", "d", "th", "n", "owner", "lines", "contamination", "repeats", "quality", "tokens", "licenses")])
rnd = random.Random(4)
VOCAB = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "ómicron", "pi"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + str(r.randint(0, 40)) for _ in range(n))


PASSAGE = prose(60, 1)
LINE = "This very line is in many documents, it is."


def texts():
    base = prose(120, 2).split()
    near = base.copy()
    near[50] = "changed"
    far = [w if k % 4 else f"x{k}" for k, w in enumerate(base)]
    long = " ".join(prose(400, s) for s in range(30, 50))
    out = [
        None, "", " \n\t ", "one", "Two words", "a b c", "A B C", "....", prose(34, 5), prose(35, 6), prose(35, 6), " ".join(base), " ".join(base), " ".join(near), " ".join(far), long, long.upper(),
        f"{LINE}\nshort\n{prose(20, 7)}", f"{prose(9, 8)}\n  {LINE.upper()}\t\nshort\n{LINE}", f"{LINE}\r\n{LINE}", f"head {PASSAGE} tail", f"{prose(10, 9)} {PASSAGE}", f"{PASSAGE} {PASSAGE}", "日本語 テキスト " * 20, "x" * 5000,
        "<|endoftext|> is text " + prose(8, 10), " 　 " + prose(14, 11),
    ]
    return out + [f"{prose(30, 100 + k)} {PASSAGE}" for k in range(12)] + [" ".join(w if j != 7 * k % 120 else f"e{k}" for j, w in enumerate(base)) for k in range(15)]


def rows():
    own = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts())]
    own += [(None, PASSAGE, None, None, None), (None, None, None, None, None), own[11], own[17], (3, "another text with the id of the third", None, "s", 5)]
    return [r + tuple("junk" for _ in SCHEMA.fields[5:]) for r in own]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def letter_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))


def contamination(docs, items, size=13):
    wins = [(name, tuple(ws[i : i + min(size, len(ws))])) for name, t in items if name is not None for ws in [letter_words(t)] if ws for i in range(len(ws) - min(size, len(ws)) + 1)]
    out = []
    for t in docs:
        ws, hit, names = letter_words(t), set(), set()
        for name, w in wins:
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    names.add(name)
        out.append((len(ws), len(hit), sorted(names)))
    return out


def line_dedup(docs, least=10):
    """docs: (id, text) rows."""
    key = lambda l: lower(l.strip(" \t\n\v\f\r"))
    held = {}
    for i, t in docs:
        for l in (t or "").split("\n"):
            if i is not None and len(key(l)) >= least:
                held.setdefault(key(l), set()).add(i)
    out = []
    for i, t in docs:
        ls = (t or "").split("\n")
        kept = [l for l in ls if i is None or len(key(l)) < least or min(held[key(l)]) == i]
        out.append((i, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


def substring_dedup(docs, size=35):
    words = [space_words(t) for t in docs]
    count = {}
    for ws in words:
        for i in range(len(ws) - size + 1):
            k = tuple(ws[i : i + size])
            count[k] = count.get(k, 0) + 1
    out = []
    for ws in words:
        gone = {j for i in range(len(ws) - size + 1) if count[tuple(ws[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((len(ws), len(gone), sha(" ".join(w for j, w in enumerate(ws) if j not in gone))))
    return out


def shingles(t, size):
    ws = space_words(lower(t or ""))
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def near_groups(docs, size, a, b):
    """(id, set size, smallest id reachable) of (id, text) rows whose ids differ."""
    sets = [(i, shingles(t, size)) for i, t in docs]
    comp = {i: i for i, _ in sets}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if s and t and b * len(s & t) >= a * len(s | t):
                u, v = sorted((top(i), top(j)))
                comp[v] = u
    return [(i, len(s), top(i)) for i, s in sets]
