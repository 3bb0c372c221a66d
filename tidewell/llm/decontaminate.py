"""Benchmark decontamination by pigeonhole edit matching.

A passage within k edits of a test item leaves one of k + 1 pieces of the item untouched. Every
item is cut into its error budget plus one pieces, an Aho-Corasick automaton finds the pieces in
each text, and around each hit Myers' bit-parallel algorithm computes the smallest edit distance
between the item and any passage of the text there.

Texts and items are compared in lower case with runs of white space as one space. The items are
broadcast in blocks of at most about BLOCK_CHARS characters, with a pass over the documents for
each block, so that a benchmark of any size can be used.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.llm.common import whole_texts

ERROR_SHARE = 16
MIN_CHARS = 30
BLOCK_CHARS = 4_000_000

_worker: dict = {}


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(size: int, share: int = ERROR_SHARE) -> int:
    """The number of edits that an item of so many characters may differ by."""
    return max(1, size // share)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def distance(item: str, text: str) -> tuple[int, int]:
    """The smallest edit distance between item and a passage of text, and where the first such
    passage ends."""
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    plus, minus, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = (minus | ~(xh | plus)) & full
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, at
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
    return best, end


def _inside(text: str, at: int) -> bool:
    """Whether there is a letter or digit on either side of a position."""
    return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()


class Matcher:
    def __init__(self, items: list[tuple[object, str]], share: int = ERROR_SHARE):
        self.items = [(i, t, budget(len(t), share) if len(t) >= MIN_CHARS else 0) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for x, (_, t, k) in enumerate(self.items):
            for at, piece in pieces(t, k):
                where.setdefault(piece, []).append((x, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if where:
            self.automaton.make_automaton()

    def find(self, raw: str | None) -> list[tuple[object, int, int, int]]:
        """(item id, edits, start, end) of the best passage for each item that has one in the text;
        positions are characters of the normalised text."""
        if not raw or not self.items:
            return []
        text = normal(raw)
        begins: dict[int, list[int]] = {}
        for last, (size, uses) in self.automaton.iter(text):
            for x, at in uses:
                begins.setdefault(x, []).append(last - size + 1 - at)
        out = []
        for x, found in begins.items():
            item_id, item, k = self.items[x]
            if not k:
                whole = [b for b in sorted(set(found)) if not _inside(text, b) and not _inside(text, b + len(item))]
                out.extend((item_id, 0, b, b + len(item)) for b in whole[:1])
                continue
            best, done = None, None
            for b in sorted(set(found)):
                a, z = max(0, b - k), b + len(item) + k
                if done is not None and z <= done:
                    continue
                # Hits of the same passage are a few characters apart: one look serves them.
                z += 2 * k
                done = z
                errors, end = distance(item, text[a:z])
                if errors <= k and (best is None or errors < best[0]):
                    back, size = distance(item[::-1], text[a : a + end][::-1])
                    best = (errors, a + end - (size if back == errors else len(item)), a + end)
            if best:
                out.append((item_id, *best))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: int = ERROR_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and test item that it contains within the item's error budget
    (its length over `share`, at least 1): id_col, item_col, edits, start, end (characters of the
    normalised text, end exclusive) of the closest passage, the first of equals. Items of fewer
    than MIN_CHARS characters have to be there without an edit and in whole words; null and empty items
    are not searched for; null and empty texts contain nothing; texts may be of any length. Rows that repeat a document
    give rows of their own, items that repeat id and text count once. Empty tables give an empty result. Other columns
    are not read. If item_col is called like id_col, it is called item_<item_col> in the result."""
    item_name = item_col if item_col != id_col else f"item_{item_col}"
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_name, benchmark.schema[item_col].dataType), T.StructField("edits", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for matcher_of in _matchers(benchmark, item_col, item_text, share, block_chars):

        def match(batches, matcher_of=matcher_of):
            matcher = matcher_of()
            for batch in batches:
                rows, hits = [], []
                for i, text in enumerate(batch.column(1)):
                    for hit in matcher.find(text.as_py()):
                        rows.append(i)
                        hits.append(hit)
                columns = list(zip(*hits)) if hits else [(), (), (), ()]
                ids = batch.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, (item_type, pa.int64(), pa.int64(), pa.int64()))]], schema.names)

        found = docs.select(id_col, text_col).mapInArrow(match, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _matchers(benchmark: DataFrame, item_col: str, item_text: str, share: int, block_chars: int):
    """For each block of the items a function that gives its Matcher on a worker."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).alias("_item"), F.col(item_text).alias("_text")).filter(F.length("_text") > 0)
    total = items.agg(F.sum(F.length("_text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    for b in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == b)
        texts = sorted({(r[0], normal(r[1])) for r in own.toLocalIterator() if normal(r[1])}, key=repr)
        shared = spark.sparkContext.broadcast((b, share, texts))

        def matcher_of(shared=shared):
            if _worker.get("items") != shared.value:
                _worker.update(items=shared.value, matcher=Matcher(shared.value[2], shared.value[1]))
            return _worker["matcher"]

        yield matcher_of


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_without_id: bool = True) -> DataFrame:
    """docs without the rows whose own text contains a test item; rows without an id stay, or with
    keep_without_id unset are judged like all others. Null and empty texts contain nothing, repeated rows are judged
    each, of an empty table nothing is left, and columns stay as they are."""
    at, id_at, schema = docs.columns.index(text_col), docs.columns.index(id_col), docs.schema
    out = docs
    for matcher_of in _matchers(benchmark, "item_id", "text", ERROR_SHARE, BLOCK_CHARS):

        def clean(batches, matcher_of=matcher_of):
            matcher = matcher_of()
            for batch in batches:
                free = [keep_without_id and not i.is_valid or not matcher.find(t.as_py()) for i, t in zip(batch.column(id_at), batch.column(at))]
                yield batch.filter(pa.array(free, pa.bool_()))

        out = out.mapInArrow(clean, schema)
    whole_texts(docs.sparkSession)
    return out
