"""Exact dedup by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. One distributed sort brings equal
blocks together and gives each distinct block an integer name; neighbouring names of a
document are then paired and the pairs named in the same way, until one name per document is
left. Two documents have the same (number of rounds, last name) if and only if their bytes
are the same: names are given by comparing contents, hashes only order the sort.

Rows are dealt to the sort by (hash of the block, id, position), so a block that a third of
all rows hold is spread over many tasks. A block that lies in several tasks gets a name in
each; these tasks report their outermost blocks, and equal ones take the smallest name. Rows are told
apart by a number of their own, so neither repeated ids nor hashes can bring two of them together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import ROW, arrow_rows, first_of_groups, stored, text_bytes, with_rows

BLOCK_BYTES = 32_768


def _ranker(columns: list[str]):
    """A task's rows are sorted by (_hash, _key): numbers its distinct keys from 0 on. After
    them come rows with _edge set: the distinct keys under the task's first and last hash."""

    def rank(batches):
        base, last, first_hash, n = TaskContext.get().partitionId() << 33, None, None, -1
        first: dict[bytes, int] = {}
        tail: dict[bytes, int] = {}
        tail_hash, schema = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, hashes = batch.column("_key"), batch.column("_hash").to_numpy()
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(key.slice(1), key.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[0] = last is None or key[0].as_py() != last
            ranks = n + np.cumsum(new)
            last, n = key[batch.num_rows - 1].as_py(), int(ranks[-1])
            if first_hash is None:
                first_hash = hashes[0]
            for i in np.flatnonzero(new & (hashes == first_hash)):
                first[key[int(i)].as_py()] = base + int(ranks[i])
            if tail_hash != hashes[-1]:
                tail, tail_hash = {}, hashes[-1]
            for i in np.flatnonzero(new & (hashes == tail_hash)):
                tail[key[int(i)].as_py()] = base + int(ranks[i])
            out = [batch.column(c) for c in columns] + [pa.array(base + ranks), pa.nulls(batch.num_rows, pa.binary())]
            done = pa.RecordBatch.from_arrays(out, [*columns, "_name", "_edge"])
            schema = done.schema
            yield done
        if schema is not None:
            edges = first | tail
            out = [pa.nulls(len(edges), schema.field(c).type) for c in columns] + [pa.array(list(edges.values()), pa.int64()), pa.array(list(edges), pa.binary())]
            yield pa.RecordBatch.from_arrays(out, [*columns, "_name", "_edge"])

    return rank


def assign_names(rows: DataFrame, key: str, deal_by: list[str]) -> DataFrame:
    """rows with a long `_name` in place of the binary column `key`: equal for equal keys,
    else different."""
    columns = [c for c in rows.columns if c != key]
    schema = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in columns], T.StructField("_name", T.LongType()), T.StructField("_edge", T.BinaryType())])
    keyed = rows.select(*columns, F.col(key).alias("_key"), F.xxhash64(key).alias("_hash"))
    dealt = keyed.repartitionByRange("_hash", *deal_by).sortWithinPartitions("_hash", "_key")
    with arrow_rows(rows.sparkSession):
        named = stored(dealt.mapInArrow(_ranker(columns), schema))
    edges = named.filter("_edge is not null")
    # A task reports what lies under two hashes, its first and its last one: at most two names but for
    # collisions, so that moves, 16 bytes a row, has a few rows for each task, whatever the number of documents.
    same = edges.groupBy("_edge").agg(F.min("_name").alias("_to"))
    moves = edges.join(same, "_edge").filter("_to < _name").select("_name", "_to")
    kept = named.filter("_edge is null").drop("_edge")
    return kept.join(F.broadcast(moves), "_name", "left").select(*columns, F.coalesce("_to", "_name").alias("_name"))


def content_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, sha256 (binary), rounds, name. Rows have equal
    (rounds, name) if and only if their texts' bytes are equal; a null text is an empty one.
    Null ids and repeated ids are allowed; no column besides the two is read. Rows are numbered as docs gives them:
    docs has to be a table or a plan that gives its rows in the same order when a lost task runs again."""
    raw = text_bytes(text_col)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_bytes") / block_bytes).cast("int") - 1, F.lit(0))), lambda i: F.substring(F.col("_raw"), i * block_bytes + F.lit(1), F.lit(block_bytes)))
    base = docs.select(F.col(id_col).alias("_id"), raw.alias("_raw"), F.monotonically_increasing_id().alias("_row"))
    base = base.select("_id", "_raw", "_row", F.length("_raw").cast("long").alias("n_bytes"), F.sha2("_raw", 256).alias("_sha"))
    cut = base.select("_id", "_row", "n_bytes", "_sha", blocks.alias("_blocks")).select("_id", "_row", "n_bytes", F.size("_blocks").alias("_n"), "_sha", F.posexplode("_blocks").alias("_i", "_block"))
    first = F.col("_i") == 0
    cut = cut.withColumn("_sha", F.when(first, F.unhex("_sha"))).withColumn("_id", F.when(first, F.col("_id")))
    # Only ids and names travel from here on.
    level = assign_names(cut, "_block", ["_row", "_i"])
    heads = level.filter("_i = 0")
    done = heads.filter("_n = 1").select("_id", "n_bytes", "_sha", F.lit(0).alias("rounds"), "_name")
    longest = level.agg(F.max("_n")).first()[0] or 1
    current, rounds, finals = level.filter("_n > 1").select("_row", "_i", "_n", "_name"), 0, None
    while longest > 1:
        rounds, longest = rounds + 1, (longest + 1) // 2
        half = (F.col("_i") / 2).cast("int")
        side = lambda odd: F.max(F.when(F.col("_i") % 2 == odd, F.col("_name")))
        pairs = current.groupBy("_row", half.alias("_p"), F.ceil(F.col("_n") / 2).cast("int").alias("_m")).agg(side(0).alias("_l"), F.coalesce(side(1), F.lit(-1)).alias("_r"))
        pairs = pairs.select("_row", F.col("_p").alias("_i"), F.col("_m").alias("_n"), "_l", "_r")
        key = F.concat(F.lpad(F.hex("_l"), 16, "0"), F.lpad(F.hex("_r"), 16, "0")).cast("binary")
        current = assign_names(pairs.select("_row", "_i", "_n", key.alias("_pair")), "_pair", ["_row", "_i"])
        ended = current.filter("_n = 1").select("_row", F.lit(rounds).alias("rounds"), F.col("_name").alias("_ename"))
        finals = ended if finals is None else finals.unionByName(ended)
        current = current.filter("_n > 1")
    if finals is not None:
        long_ = heads.filter("_n > 1").join(finals, "_row")
        done = done.unionByName(long_.select("_id", "n_bytes", "_sha", "rounds", F.col("_ename").alias("_name")))
    return done.select(F.col("_id").alias(id_col), "n_bytes", F.col("_sha").alias("sha256"), "rounds", F.col("_name").alias("name"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: id_col, keep_id (the largest id of the rows with the same
    text), group_size, kept, n_bytes, text_sha256. Rows that repeat both id and text are one
    document read twice: each is returned and all of them have the same `kept`. Rows whose ids
    are all null keep each other's null id. An empty table gives an empty result."""
    named = stored(content_names(docs, id_col, text_col, block_bytes))
    # Groups of one need no look-up; the rest is a table of its own, so that a group that holds
    # a large share of the rows can be split by the join.
    groups = named.groupBy("rounds", "name").agg(F.max(id_col).alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    found = named.join(stored(groups), ["rounds", "name"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))
    return found.select(id_col, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col(id_col).eqNullSafe(keep).alias("kept"), "n_bytes", F.lower(F.hex("sha256")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with, of equal texts, only the row with the largest id, and one of rows that repeat id and
    text; rows that share an id and differ in text are documents of their own. A row without an id is kept
    where no row with an id has its text. Null and empty texts are equal. Of an empty table nothing is left;
    columns stay as they are."""
    rows = with_rows(docs)
    named = stored(content_names(rows, ROW, text_col)).select(ROW, F.struct("rounds", "name").alias("group"))
    return first_of_groups(rows, named, id_col, largest=True)
