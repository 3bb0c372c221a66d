"""The corpus pipeline: documents that are good, distinct and clean, with rates for a mixture.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of docs. run() writes
each stage's rows as Parquet into the shared folder, so a lost executor costs one stage's tasks
and no stage computes an earlier one again. Every stage decides on rows, not on ids: ids may repeat
or be null. Null and empty texts are texts without words; they are judged by their metadata, are copies of each
other for `exact`, have no near copy and hold no test item. Texts are read whole, however long. Rows that
repeat all but the id, or the id too, are copies: one stays. Of an empty table nothing is left. Further columns go
along, whatever their names; only `mixture` replaces columns called domain, rate and copies.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.common import documents, drop_stored, noted, remove, stored
from tidewell.llm.decontaminate import drop_contaminated
from tidewell.llm.exact_dedup import drop_exact_copies
from tidewell.llm.mixing import mixed
from tidewell.llm.near_dedup import drop_near_copies
from tidewell.llm.quality import keep_good
from tidewell.llm.queries import MIXTURE


#: What the stage before has stored on its way to its rows.
_left: list[str] = []


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage's rows are written before the next stage begins, so that one removes what this one has stored."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _left)
        with noted() as folders:
            out = f(spark, docs, sf_dir)
        _left[:] = folders
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the co-trained classifier takes for poor, and what it takes for toxic."""
    return keep_good(docs, documents(spark, sf_dir, "labels"))


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, and one of rows that repeat both."""
    return drop_exact_copies(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8) the row with the smallest id stays."""
    return drop_near_copies(docs)


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that contain a benchmark item."""
    return drop_contaminated(docs, documents(spark, sf_dir, "benchmark"), keep_without_id=False)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's domain, its rate in the mixture and the copies to take."""
    return mixed(docs, documents(spark, sf_dir, "labels"), MIXTURE)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminated", decontaminated), ("mixture", mixture)]

#: Trained classifiers and similarity of shingle sets are not for SQL; tests/llm holds the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, each in STAGES:
        docs = stored(each(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_stored(before)
        before = docs
    return docs
