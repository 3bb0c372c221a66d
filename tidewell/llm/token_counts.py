"""Token counts by a map-side look-up in two tiers.

Tokenizers that normalise and split like SPLITTING drop white space and never let a token cross it, so
the tokens of a text are the sum over its words. The lengths of frequent words come from a compact table
that is broadcast: at most FREQUENT_WORDS entries, gathered in one task from a random sample of about
SAMPLE_ROWS rows of the whole table. It only saves time and never changes a count. Other words are encoded
by the tokenizer itself and kept in a bounded cache of the Python worker, which outlives the task. No word is
ever shuffled. A tokenizer file of another kind is not taken apart: it gets whole texts.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import text_bytes

FREQUENT_WORDS = 50_000
SAMPLE_ROWS = 1_000
CACHE_WORDS = 300_000
TOKEN_LIMIT = 2_048

#: Texts of these characters alone are cut into words here: blocks whose letters, digits,
#: spaces and lower case are the same in every version of Unicode that the libraries use.
#: Capital sigma is left out, its lower case depends on where it stands. Any other text goes
#: to the tokenizer whole.
_PLAIN = regex.compile("[\t-\r\x20-\x7e\x80-ɏΑ-ΡΤ-ϿЀ-ԯ -⁤぀-ヿ一-鿌가-힣]*+")

#: How a tokenizer has to treat a text for its words to count by themselves (fixed values of the file's format).
SPLITTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None, "truncation": None, "padding": None,
}

_worker: dict = {}


def splits_words(source: str) -> bool:
    """Whether the tokenizer file is of the kind that SPLITTING tells."""
    told = json.loads(source)
    return all(told.get(k) == v for k, v in SPLITTING.items())


def _tokenizer(source: str):
    if _worker.get("source") != source:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _worker.clear()
        tokenizer = Tokenizer.from_str(source)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        marks = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        _worker.update(source=source, tokenizer=tokenizer, cache={}, marks=marks, splits=splits_words(source))
    return _worker["tokenizer"]


def _lengths(words: list[str], tokenizer) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch(words, add_special_tokens=False)]


def _words(text: str) -> list[str] | None:
    """The words of a text, or None where only the tokenizer can tell them."""
    if not _worker["splits"] or any(mark in text for mark in _worker["marks"]) or not _PLAIN.fullmatch(text):
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return text.lower().split()


def count_tokens(texts: list[str | None], source: str, frequent: dict[str, int]) -> list[int]:
    tokenizer = _tokenizer(source)
    cache, out = _worker["cache"], []
    for text in texts:
        if not text:
            out.append(0)
            continue
        words = _words(text)
        if words is None:
            out.append(len(tokenizer.encode(text, add_special_tokens=False).ids))
            continue
        found = [*map(frequent.get, words)]
        if None in found:
            missed = [w for w, n in zip(words, found) if n is None]
            new = [*{w for w in missed if w not in cache}]
            if new:
                if len(cache) + len(new) > CACHE_WORDS:
                    cache.clear()
                    new = [*set(missed)]
                cache.update(zip(new, _lengths(new, tokenizer)))
            out.append(sum(n for n in found if n is not None) + sum(map(cache.__getitem__, missed)))
        else:
            out.append(sum(found))
    return out


def _pack(lengths: dict[str, int]) -> tuple[bytes, bytes]:
    return "\n".join(lengths).encode(), pa.array([*lengths.values()], pa.int32()).buffers()[1].to_pybytes()[: 4 * len(lengths)]


def _unpack(packed: tuple[bytes, bytes]) -> dict[str, int]:
    if _worker.get("packed") != packed:
        words = packed[0].decode().split("\n") if packed[0] else []
        _worker.update(packed=packed, frequent=dict(zip(words, memoryview(packed[1]).cast("i").tolist())))
    return _worker["frequent"]


def frequent_lengths(docs: DataFrame, text_col: str, source, rows: int = SAMPLE_ROWS, words: int = FREQUENT_WORDS) -> dict[str, int]:
    def top(batches):
        tokenizer, seen = _tokenizer(source.value), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(_words(text) or ())
            if len(seen) > 8 * words:
                seen = Counter(dict(seen.most_common(4 * words)))
        best = [w for w, _ in seen.most_common(words)]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(best), pa.array(_lengths(best, tokenizer), pa.int32())], ["word", "n"])

    n = docs.count()
    # The sample is all that moves: about `rows` rows, however large the table.
    few = docs.select(text_col).sample(min(1.0, rows / max(1, n)), 5).filter(F.col(text_col).isNotNull()).repartition(1)
    return {r.word: r.n for r in few.mapInArrow(top, "word string, n int").toLocalIterator()}


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per row of docs: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens above
    limit). The tokens are those of the tokenizers library for the file at tokenizer_path,
    without added begin or end; special strings inside texts count as its default has them.
    A null or empty text has 0 of both, texts may be of any length. Repeated rows are counted each, an empty
    table gives an empty result, other columns are not read."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    table = spark.sparkContext.broadcast(_pack(frequent_lengths(docs, text_col, source) if splits_words(source.value) else {}))
    id_type = docs.schema[id_col].dataType

    def count(batches):
        _tokenizer(source.value)
        frequent = _unpack(table.value)
        for batch in batches:
            n = pa.array(count_tokens(batch.column(2).to_pylist(), source.value, frequent), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], [id_col, "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    rows = docs.select(id_col, F.length(text_bytes(text_col)).cast("long").alias("n_bytes"), text_col)
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
