"""Benchmark decontamination by a generalised suffix automaton.

The normalised test items are joined into one generalised suffix automaton over
word ids. Each document is streamed through it; after every word the state gives
the longest suffix of the stream that occurs in some item. A suffix of `window`
words, or a whole item that is shorter, marks the words it ends on.

Most of a corpus cannot match: a first pass in numpy looks every word hash up in
a bit table of the items' words, and only runs of possible words at least as
long as the shortest window are streamed, by their real bytes. As an automaton
starts anew at a word that no item holds, this changes no result.

Defined results: null or word-less text has n_words 0, no hits and is not
contaminated; items without words match nothing; repeated documents are judged
row by row; repeated item texts all count. Items whose id is null are left out by
default; op1 and `decontaminate` take them in: their words hit, and in a document's
items all of them are one null, which op1 counts in n_items and leaves out of
items_sha256, as its SQL does. An input column named like the result
column is replaced. Empty tables give empty (documents) or hit-free (items)
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import vectext as V
from .common import drop_dir, shared_dir, stored, table, with_struct

WINDOW = 13
#: A document is contaminated if at least 1/20 of its words are hit.
COVERAGE = (1, 20)
#: Words of items in one automaton (about 0.8 kB each in a worker); more items make more automata, which pass one after the other.
BLOCK_WORDS = 200_000
#: Automata in one pass over the documents; what a pass found is written to the shared folder before the next.
TOGETHER = 2
TABLE_BITS = 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TO_WORDS = bytes(32 if b in V.NOT_WORD else _LOWER[b] for b in range(256))
_TABLE = V.byte_table(V.NOT_WORD, lower=True)

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("after", T.LongType()), T.StructField("first_byte", T.LongType()), T.StructField("after_byte", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


class Automaton:
    """Generalised suffix automaton of the word lists of some items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.names = [name for name, ws in items if ws]
        lists = [[self.ids.setdefault(w, len(self.ids)) for w in ws] for _, ws in items if ws]
        self.shortest = min([min(len(x), window) for x in lists], default=0)
        for x in lists:
            last = 0
            for c in x:
                last = self._add(c, last)
        self.holders: list[set[int]] = [set() for _ in self.next]
        self.whole: dict[int, set[int]] = {}
        for k, x in enumerate(lists):
            state = 0
            for c in x:
                state = self.next[state][c]
                up = state
                while up > 0 and k not in self.holders[up]:
                    self.holders[up].add(k)
                    up = self.link[up]
            if len(x) < window:
                self.whole.setdefault(state, set()).add(k)
        self.short_up = self._short_ups()
        self.bits = np.zeros(1 << TABLE_BITS, bool)
        if self.ids:
            text = b" ".join(self.ids)
            h = V.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), _TABLE).hash
            self.bits[(h >> V.U(64 - TABLE_BITS)).astype(np.int64)] = True

    def _add(self, c: int, last: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        if (q := nxt[last].get(c)) is not None:
            if size[q] == size[last] + 1:
                return q
            return self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if size[q] == size[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def _short_ups(self) -> list[tuple[int, ...]]:
        """For each state, the states of whole short items that are its proper suffixes."""
        out: list[tuple[int, ...]] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.size.__getitem__):
            up = self.link[s]
            out[s] = out[up] + ((up,) if up in self.whole else ())
        return out

    def stream(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged [first, after) word spans hit, and the items with occurring windows."""
        spans: list[list[int]] = []
        found: set[int] = set()
        state, length, window = 0, 0, self.window
        nxt, link, size = self.next, self.link, self.size

        def mark(first: int, after: int) -> None:
            while spans and spans[-1][0] >= first:
                spans.pop()
            if spans and spans[-1][1] >= first:
                spans[-1][1] = after
            else:
                spans.append([first, after])

        for i, w in enumerate(ws):
            c = self.ids.get(w)
            if c is None:
                state = length = 0
                continue
            while state and c not in nxt[state]:
                state = link[state]
                length = size[state]
            state = nxt[state].get(c, 0)
            length = length + 1 if state else 0
            if length < self.shortest:
                continue
            best = 0
            if length >= window:
                at = state
                while size[link[at]] >= window:
                    at = link[at]
                found |= self.holders[at]
                best = window
                length = min(length, size[state])
            for s in self.short_up[state]:
                found |= self.whole[s]
                best = max(best, size[s])
            if state in self.whole and length >= size[state]:
                found |= self.whole[state]
                best = max(best, size[state])
            if best:
                mark(i + 1 - best, i + 1)
        return [(a, b) for a, b in spans], found


def _runs(possible: np.ndarray, ptr: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(document, first, after) of runs of at least `least` possible words."""
    n = len(possible)
    if not n:
        return []
    edge = np.zeros(n + 1, bool)
    edge[ptr] = True
    before = np.zeros(n, bool)
    before[1:] = possible[:-1]
    first = np.flatnonzero(possible & (~before | edge[:-1]))
    behind = np.zeros(n, bool)
    behind[:-1] = possible[1:]
    after = np.flatnonzero(possible & (~behind | edge[1:])) + 1
    long = after - first >= least
    first, after = first[long], after[long]
    doc = np.searchsorted(ptr, first, side="right") - 1
    return list(zip(doc.tolist(), first.tolist(), after.tolist(), strict=True))


def _sorted(names: set[str | None]) -> list[str | None]:
    """Null, which stands for all items without id, comes last."""
    return sorted(names, key=lambda x: (x is None, x))


def _scan(part: pa.RecordBatch, column: str, auto: Automaton) -> list[dict]:
    buf, off = V.utf8(part.column(column))
    w = V.Words(buf, off, _TABLE)
    out = [{"n_words": n, "n_hit": 0, "spans": [], "items": []} for n in np.diff(w.ptr).tolist()]
    if not auto.shortest:
        return out
    possible = auto.bits[(w.hash >> V.U(64 - TABLE_BITS)).astype(np.int64)]
    items: dict[int, set[int]] = {}
    for doc, first, after in _runs(possible, w.ptr, auto.shortest):
        text = buf[w.start[first] : w.end[after - 1]].tobytes().translate(_TO_WORDS).split()
        spans, found = auto.stream(text)
        base = int(w.ptr[doc])
        for a, b in spans:
            x, y = first + a, first + b
            out[doc]["spans"].append({"first": x - base, "after": y - base, "first_byte": int(w.start[x] - off[doc]), "after_byte": int(w.end[y - 1] - off[doc])})
            out[doc]["n_hit"] += b - a
        if found:
            items.setdefault(doc, set()).update(found)
    for doc, found in items.items():
        out[doc]["items"] = _sorted({auto.names[k] for k in found})
    return out


def _union(a: dict, b: dict) -> dict:
    """Hits of two automata over the same document."""
    if not b["spans"]:
        return a
    merged: list[dict] = []
    for s in sorted((dict(x) for x in [*a["spans"], *b["spans"]]), key=lambda s: s["first"]):
        if merged and s["first"] <= merged[-1]["after"]:
            if s["after"] > merged[-1]["after"]:
                merged[-1] |= {"after": s["after"], "after_byte": s["after_byte"]}
        else:
            merged.append(s)
    return {"n_words": a["n_words"], "n_hit": sum(s["after"] - s["first"] for s in merged), "spans": merged, "items": _sorted({*a["items"], *b["items"]})}


def item_blocks(items: DataFrame, item_id: str, item_text: str, block_words: int, unnamed: bool = False) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in blocks of a bounded number of words, as the driver reads them row by row; those without id only if `unnamed`."""
    block, held = [], 0
    for name, text in items.select(F.col(item_id).cast("string"), F.col(item_text)).toLocalIterator():
        ws = words(text)
        if (name is None and not unnamed) or not ws:
            continue
        if held and held + len(ws) > block_words:
            yield block
            block, held = [], 0
        block.append((name, ws))
        held += len(ws)
    yield block


def find_contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, together: int = TOGETHER, into: str = "contamination", cut: bool = False, unnamed: bool = False) -> DataFrame:
    """docs with a struct column `into`: n_words, n_hit, spans (words and bytes), items.

    Each `block_words` of item words make an automaton of that bounded size, and
    `together` of them are broadcast for one pass over the documents, so a worker's
    memory doesn't depend on the number of items. With cut, the last automaton's
    turn also takes the hit spans out of the text. With unnamed, items without id
    count.
    """
    spark, out = docs.sparkSession, docs
    folder, written, held = shared_dir(spark), [], []
    blocks = item_blocks(items, item_id, item_text, block_words, unnamed)
    block, later = next(blocks), False
    while block is not None:
        following = next(blocks, None)
        if len(held) == together:
            out = stored(out, f"{folder}/pass-{len(written)}")
            written.append(f"{folder}/pass-{len(written)}")
            drop_dir(spark, *written[:-1])
            for done in held:
                done.destroy()
            held = []
        shared = spark.sparkContext.broadcast(Automaton(block, window))
        held.append(shared)
        schema = with_struct(out.schema, into, RESULT)

        def go(batches, shared=shared, schema=schema, later=later, cut=cut and following is None):
            arrow = to_arrow_schema(schema)
            for batch in batches:
                for part in V.slices(batch, text):
                    found = _scan(part, text, shared.value)
                    if later:
                        found = [_union(a, b) for a, b in zip(part.column(into).to_pylist(), found, strict=True)]
                    new = {into: pa.array(found, arrow.field(into).type)}
                    if cut:
                        new[text] = pa.array(list(map(_cut, part.column(text).to_pylist(), (f["spans"] for f in found))), arrow.field(text).type)
                    yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else part.column(f.name) for f in schema.fields], names=schema.names)

        out, block, later = out.mapInArrow(go, schema), following, True
    return out


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (COVERAGE[1] * n_hit >= COVERAGE[0] * n_words)


def _cut(text: str | None, spans: list[dict]) -> str | None:
    if not spans:
        return text
    raw, at, out = text.encode(), 0, []
    for s in spans:
        out.append(raw[at : s["first_byte"]])
        at = s["after_byte"]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """docs without the contaminated ones, and without the hit spans of the others.

    Keeps all columns; only `text` changes, where a span goes.
    """
    into = "__contamination"
    found = find_contamination(docs, items, text=text, into=into, cut=True, **{"unnamed": True, **options})
    return found.filter(~contaminated(F.col(f"{into}.n_hit"), F.col(f"{into}.n_words"))).drop(into)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    c = F.col("contamination")
    return find_contamination(docs.select("doc_id", "text"), items, unnamed=True).select(
        "doc_id",
        c.n_words.alias("n_words"),
        c.n_hit.alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", c["items"]), 256).alias("items_sha256"),
        contaminated(c.n_hit, c.n_words).alias("contaminated"),
    )
