"""Edit-aware token counts over segment trees.

A document's text is cut into leaves of about `LEAF` bytes, only at places where
no pre-token can span: behind a printable ASCII character and before a space or
line feed. The document's tokens are the sum over its leaves, kept in a segment
tree. `token_trees` makes a tree of each document, a column that is stored with it;
`edit_trees` applies a column of edits to such trees, again and again if need be. An
edit re-encodes the leaves it touches and the nearest other leaf on either side, as
an edit may join words across a cut, and updates the sums above them; the rest of
the text is never encoded again. What it touched is cut anew, so leaves neither grow
nor wither however many edits meet in one place (a text without a safe place is one
leaf).

Defined results: null text has no tree, no tokens and takes no edits. Edits are in
bytes of the text as it is before a call and apply in order of their start;
insertions at one place apply in the order given. An edit is refused, and counted as
such, if it or its start or stop is null, if it lies outside the text or ends before
it starts, if it cuts a code point, or if it overlaps one that was applied. A null
put is empty; an edit list that is null or empty changes nothing. Rows are counted
one by one, so repeats and null ids change nothing. Empty tables give empty results.
An input column named like a result column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import vectext as V
from .common import shared_dir, stored, table, with_struct, without
from .packing import SPECIAL, encoder

LEAF = 384

TREE = T.StructType([T.StructField("leaves", T.ArrayType(T.StringType())), T.StructField("tokens", T.ArrayType(T.LongType()))])
COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_tokens", "n_edits", "n_refused", "n_tokens_after", "n_bytes_after", "n_leaves", "n_leaves_encoded", "n_bytes_encoded")])
EDITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("put", T.StringType())]))


def cuts(raw: bytes, leaf: int = LEAF) -> list[int]:
    """Ends of the leaves of a text."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) < 2:
        return [len(b)]
    before, here = b[:-1], b[1:]
    safe = np.flatnonzero(((here == 32) | (here == 10)) & (before > 32) & (before < 127)) + 1
    at = np.searchsorted(safe, np.arange(leaf, len(b), leaf))
    return [*np.unique(safe[at[at < len(safe)]]).tolist(), len(b)]


class TokenTree:
    """Leaves of one text with a segment tree of their token counts."""

    def __init__(self, raw: bytes, enc, leaf: int = LEAF):
        self.enc, self.leaf, self.encoded, self.encoded_bytes = enc, leaf, 0, 0
        self._put(0, 0, raw)

    @classmethod
    def kept(cls, leaves: list[bytes], tokens: list[int], enc, leaf: int = LEAF) -> TokenTree:
        """The tree that was stored with these leaves and counts; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.enc, tree.leaf, tree.encoded, tree.encoded_bytes = enc, leaf, 0, 0
        tree.leaves = list(leaves)
        tree._sum(np.array(tokens, np.int64))
        return tree

    def _sum(self, tokens: np.ndarray) -> None:
        """All sums anew, from the leaves' counts."""
        n = len(tokens)
        self.size = 1 << max(0, (n - 1).bit_length())
        self.tokens, self.bytes = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        self.tokens[self.size : self.size + n] = tokens
        self.bytes[self.size : self.size + n] = [len(x) for x in self.leaves]
        at = self.size
        while at > 1:
            for sums in (self.tokens, self.bytes):
                sums[at // 2 : at] = sums[at : 2 * at : 2] + sums[at + 1 : 2 * at : 2]
            at //= 2

    def _count(self, raw: bytes) -> int:
        if not raw:
            return 0
        self.encoded += 1
        self.encoded_bytes += len(raw)
        text = raw.decode()
        return len(self.enc.encode(text, allowed_special=set(SPECIAL), disallowed_special=()) if "<|" in text else self.enc.encode_ordinary(text))

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.bytes[1])

    def counts(self) -> list[int]:
        return self.tokens[self.size : self.size + len(self.leaves)].tolist()

    def text(self) -> bytes:
        return b"".join(self.leaves)

    def _find(self, byte: int) -> tuple[int, int]:
        """(leaf, byte within it); the last leaf for the end."""
        k = 1
        while k < self.size:
            left = int(self.bytes[2 * k])
            if byte < left or not self.bytes[2 * k + 1]:
                k = 2 * k
            else:
                k, byte = 2 * k + 1, byte - left
        return k - self.size, byte

    def cuts_character(self, byte: int) -> bool:
        """Whether a place lies within a code point."""
        k, at = self._find(byte)
        return at < len(self.leaves[k]) and self.leaves[k][at] & 0xC0 == 0x80

    def _put(self, low: int, after: int, raw: bytes) -> None:
        """Leaves low to after give way to those of raw."""
        ends = cuts(raw, self.leaf)
        parts = [raw[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        if not low and not after:
            self.leaves = parts
            self._sum(np.array([self._count(x) for x in parts], np.int64))
            return
        old, had = self.leaves[low:after], self.tokens[self.size + low : self.size + after].tolist()
        # Leaves at either end that came out as they were keep their counts.
        same = dict(zip(old, had, strict=True))
        now = [same[x] if x in same else self._count(x) for x in parts]
        if len(parts) != len(old):
            counts = [*self.counts()[:low], *now, *self.counts()[after:]]
            self.leaves[low:after] = parts
            self._sum(np.array(counts, np.int64))
            return
        self.leaves[low:after] = parts
        for k, n, x in zip(range(low, after), now, parts, strict=True):
            at = self.size + k
            self.tokens[at], self.bytes[at] = n, len(x)
            while at > 1:
                at //= 2
                self.tokens[at] = self.tokens[2 * at] + self.tokens[2 * at + 1]
                self.bytes[at] = self.bytes[2 * at] + self.bytes[2 * at + 1]

    def replace(self, start: int, stop: int, put: bytes) -> None:
        """Puts `put` in place of the bytes from start to stop."""
        if not 0 <= start <= stop <= self.length:
            raise ValueError(f"edit {start}..{stop} lies outside {self.length} bytes")
        first, a = self._find(start)
        last, b = self._find(stop)
        low, after = max(first - 1, 0), min(last + 2, len(self.leaves))
        head = b"".join(self.leaves[low:first]) + self.leaves[first][:a]
        raw = head + put + self.leaves[last][b:] + b"".join(self.leaves[last + 1 : after])
        self._put(low, after, raw)

    def apply(self, edits: list) -> tuple[int, int]:
        """Edits applied and refused."""
        size, done, moved, applied = self.length, 0, 0, 0
        fine = [e for e in edits if e is not None and e["start"] is not None and e["stop"] is not None]
        for e in sorted(fine, key=lambda e: e["start"]):
            start, stop = e["start"], e["stop"]
            if not done <= start <= stop <= size or self.cuts_character(start + moved) or self.cuts_character(stop + moved):
                continue
            put = (e["put"] or "").encode()
            self.replace(start + moved, stop + moved, put)
            moved += len(put) - (stop - start)
            done = stop
            applied += 1
        return applied, len(edits) - applied


def token_trees(docs: DataFrame, *, text: str = "text", leaf: int = LEAF, ranks: str | None = None, into: str = "tree") -> DataFrame:
    """docs with a struct column `into`: the leaves of each text and their tokens."""
    docs = without(docs, into)
    schema = with_struct(docs.schema, into, TREE)

    def go(batches):
        arrow, enc = to_arrow_schema(schema), encoder(ranks)
        for batch in batches:
            for part in V.slices(batch, text):
                made = []
                for t in part.column(text).to_pylist():
                    tree = None if t is None else TokenTree(t.encode(), enc, leaf)
                    made.append(None if tree is None else {"leaves": [x.decode() for x in tree.leaves], "tokens": tree.counts()})
                cols = [pa.array(made, arrow.field(into).type) if f.name == into else part.column(f.name) for f in schema.fields]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return docs.mapInArrow(go, schema)


def edit_trees(trees: DataFrame, edits: str, *, tree: str = "tree", leaf: int = LEAF, ranks: str | None = None, into: str = "tokens") -> DataFrame:
    """trees with column `tree` as the edits in column `edits` leave it, and a struct column `into` with counts.

    edits: array of (start, stop, put) in bytes of the text.
    """
    trees = without(trees, into)
    schema = with_struct(trees.schema, into, COUNTS)

    def go(batches):
        arrow, enc = to_arrow_schema(schema), encoder(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                after, counts = [], []
                for t, own in zip(part.column(tree).to_pylist(), part.column(edits).to_pylist(), strict=True):
                    own = own or []
                    if t is None:
                        after.append(None)
                        counts.append(dict.fromkeys(COUNTS.names, 0) | {"n_refused": len(own)})
                        continue
                    held = TokenTree.kept([x.encode() for x in t["leaves"]], t["tokens"], enc, leaf)
                    before = held.total
                    applied, refused = held.apply(own)
                    after.append({"leaves": [x.decode() for x in held.leaves], "tokens": held.counts()} if applied else t)
                    counts.append({"n_tokens": before, "n_edits": applied, "n_refused": refused, "n_tokens_after": held.total, "n_bytes_after": held.length, "n_leaves": len(held.leaves), "n_leaves_encoded": held.encoded, "n_bytes_encoded": held.encoded_bytes})
                new = {tree: after, into: counts}
                yield pa.RecordBatch.from_arrays([pa.array(new[f.name], arrow.field(f.name).type) if f.name in new else part.column(f.name) for f in schema.fields], schema=arrow)

    return trees.mapInArrow(go, schema)


def count_edited(docs: DataFrame, edits: str, *, text: str = "text", leaf: int = LEAF, ranks: str | None = None, into: str = "tokens") -> DataFrame:
    """docs with a struct column `into`: token counts before and after the edits in column `edits`, and the edited text."""
    kept = "__tree"
    out = edit_trees(token_trees(without(docs, into), text=text, leaf=leaf, ranks=ranks, into=kept), edits, tree=kept, leaf=leaf, ranks=ranks, into=into)
    return out.withColumn(into, F.struct(*[F.col(into)[n].alias(n) for n in COUNTS.names], F.array_join(F.col(kept)["leaves"], "").alias("edited"))).drop(kept)


def redactions(docs: DataFrame, *, text: str = "text", into: str = "edits") -> DataFrame:
    """docs with the edits that put a placeholder for mail addresses, network addresses and long numbers."""
    import re

    kinds = re.compile(rb"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|(?<!\d)\d{13,19}(?!\d)")
    docs = without(docs, into)
    schema = with_struct(docs.schema, into, EDITS)

    def go(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            made = []
            for t in batch.column(text).to_pylist():
                found = kinds.finditer((t or "").encode())
                made.append([{"start": m.start(), "stop": m.end(), "put": "[mail]" if b"@" in m[0] else "[address]" if b"." in m[0] else "[number]"} for m in found])
            cols = [pa.array(made, arrow.field(into).type) if f.name == into else batch.column(f.name) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return docs.mapInArrow(go, schema)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Trees of all documents are stored; redactions are then applied to the stored trees."""
    x = F.col("tokens")
    docs = redactions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    trees = stored(token_trees(docs).select("doc_id", "edits", "tree"), f"{shared_dir(spark)}/trees")
    return edit_trees(trees, "edits").select("doc_id", *[x[n].alias(n) for n in COUNTS.names])
