"""Look-ups of the engine as joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table goes to every task only if it has at most so many rows.
SMALL_ROWS = 100_000


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it is small, which is counted; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Side of the cells that boxes are dealt to.
CELL = 128


#: Pairs whose boxes are compared at a time.
PAIRS = 1 << 20


def _meeting(cell: int, names: list[str]):
    """Rows (key, cx, cy, id, x, y, w, h) sorted by cell and x: the pairs whose boxes meet, by sweeps along x."""

    def whole(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            new = np.flatnonzero(_changes(table))
            yield table.slice(0, new[-1]) if len(new) > 1 else table.slice(0, 0)
            held = table.slice(new[-1])
        if held is not None:
            yield held

    def meet(batches):
        for table in whole(batches):
            if table.num_rows < 2:
                continue
            n, group = table.num_rows, np.cumsum(_changes(table))
            x, y, w, h, cx, cy = (table.column(c).to_numpy() for c in ("_x", "_y", "_w", "_h", "_cx", "_cy"))
            # Places on one line, a stretch for each cell: a row's rivals are the rows up to its far edge.
            last = np.flatnonzero(np.append(group[1:] != group[:-1], True))
            ranks = np.unique(x, return_inverse=True)
            far, wide = np.searchsorted(ranks[0], x + w, "left"), len(ranks[0]) + 1
            more = np.searchsorted(group * wide + ranks[1], group * wide + far, "left") - np.arange(n) - 1
            assert (more <= last[group - 1] - np.arange(n)).all()
            ends = np.cumsum(more)
            at = 0
            while at < n:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
                m = more[at:to]
                i = np.repeat(np.arange(at, to), m)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
                at = to
                ok = (y[i] < y[j] + h[j]) & (y[j] < y[i] + h[i])
                i, j = i[ok], j[ok]
                ok = (x[j] // cell == cx[i]) & (np.maximum(y[i], y[j]) // cell == cy[i])
                i, j = pa.array(i[ok]), pa.array(j[ok])
                if len(i):
                    one, two = table.take(i).combine_chunks(), table.take(j).combine_chunks()
                    ids = [t.column("_id") for t in (one, two)]
                    # The lesser id is a; of equal ids, or none, there is no pair.
                    swap = pc.greater(*ids).combine_chunks()
                    out = [one.column(names[0])]
                    for c in ("_id", "_x", "_y", "_w", "_h"):
                        out += [pc.if_else(swap, two.column(c), one.column(c)), pc.if_else(swap, one.column(c), two.column(c))]
                    found = pa.Table.from_arrays(out, names=names).filter(pc.not_equal(*ids))
                    yield from found.to_batches()

    return meet


def _changes(table: pa.Table) -> np.ndarray:
    """Whether a row is the first of its cell."""
    key = table.column(0).combine_chunks().dictionary_encode()
    key = (key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key).indices.to_numpy()
    each = [key, table.column("_cx").to_numpy(), table.column("_cy").to_numpy()]
    return np.concatenate(([True], np.any([v[1:] != v[:-1] for v in each], axis=0)))


def overlapping_pairs(df: DataFrame, key: str, ident: str, boxes: Column, cell: int = CELL) -> DataFrame:
    """(key, a, b, box_a, box_b) of the boxes under one key whose interiors meet, a before b. Boxes meet in the cells
    of a grid that they cover, so that a key of many boxes is many small groups; a pair counts in the cell of its
    common near corner alone. Within a cell a sweep along x compares only what meets there."""
    from tidewell.functions.geometry import bottom, box, right

    place = lambda x: F.floor(x / F.lit(cell)).cast("bigint")
    cells = lambda near, far: F.explode(F.sequence(place(near), F.greatest(place(near), place(far - 1))))
    b = F.col("_box")
    told = df.select(F.col(key), F.col(ident).alias("_id"), boxes.alias("_box")).filter((b["w"] > 0) & (b["h"] > 0) & F.col(key).isNotNull() & F.col("_id").isNotNull())
    dealt = told.withColumn("_cx", cells(b["x"], right(b))).withColumn("_cy", cells(b["y"], bottom(b)))
    flat = dealt.select(key, "_cx", "_cy", "_id", *[b[c].cast("bigint").alias(f"_{c}") for c in "xywh"]).repartition(key, "_cx", "_cy").sortWithinPartitions(key, "_cx", "_cy", "_x")
    kind = {f.name: f.dataType for f in told.schema}
    names = [key, "a", "b", *[f"_{c}{n}" for c in "xywh" for n in "ab"]]
    schema = T.StructType([T.StructField(n, kind[key] if n == key else kind["_id"] if n in "ab" else T.LongType()) for n in names])
    sides = {f.name: f.dataType for f in kind["_box"]}
    whole = lambda n: box(*[F.col(f"_{c}{n}").cast(sides[c]) for c in "xywh"]).alias(f"box_{n}")
    return flat.mapInArrow(_meeting(cell, names), schema).select(key, "a", "b", whole("a"), whole("b"))


def windows_of(df: DataFrame, boxes: Column, windows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """A row for each window (id, x, y, w, h) that a row's box meets, with the common box `part`.
    Windows are at most a few, so they are spelt out in the plan."""
    from tidewell.functions.geometry import box, intersection

    each = F.array(*[F.struct(F.lit(i).alias("window_id"), intersection(boxes, box(*map(F.lit, b))).alias("part")) for i, *b in windows])
    return df.withColumn("_w", F.explode(F.filter(each, lambda x: x["part"].isNotNull()))).select("*", F.col("_w.window_id").alias("window_id"), F.col("_w.part").alias("part")).drop("_w")


def first_window(x: Column, y: Column, windows: list[tuple[int, int, int, int, int]]) -> Column:
    """The first window that holds a point; 0 if none does or there is only one window."""
    out = F.lit(0)
    for i, wx, wy, w, h in reversed(windows if len(windows) > 1 else []):
        out = F.when((x >= wx) & (x < wx + w) & (y >= wy) & (y < wy + h), F.lit(i)).otherwise(out)
    return out


def nearest_entry(df: DataFrame, vector: str, entries: DataFrame, entry_id: str, entry: str, digits: int = 6) -> DataFrame:
    """df with the closest entry (Euclidean) and its distance; the smallest id of equals. The entries
    are a stated set of at most SMALL_ROWS, which is counted; every row is held against each of them."""
    if entries.limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
        raise ValueError(f"more than {SMALL_ROWS} entries")
    table = entries.agg(F.array_sort(F.collect_list(F.struct(F.col(entry_id).alias("id"), F.col(entry).alias("v")))).alias("_all"))
    square = lambda v: F.aggregate(F.zip_with(vector, v, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("_all", lambda e: F.struct(F.round(F.sqrt(square(e["v"])), digits).alias("distance"), e["id"].alias("id"))))
    return df.crossJoin(F.broadcast(table)).withColumn("_best", best).select("*", F.col("_best.id").alias("nearest_id"), F.col("_best.distance").alias("distance")).drop("_best", "_all")


def best_of_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str], lookback: int, score, smallest: bool = True) -> DataFrame:
    """For each row the best of the `lookback` rows before it: `best_back` (how many rows ago) and
    `best_score`; the nearest of equals. Rows without one have nulls. score(row, before) takes
    functions from column name to Column. A bounded frame, hence no self-join."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    held = df.withColumn("_before", F.collect_list(F.struct(*columns)).over(w.rowsBetween(-lookback, -1)))
    n = F.size("_before")
    each = F.transform("_before", lambda b, i: F.struct((score(F.col, lambda c: b[c]) if smallest else -score(F.col, lambda c: b[c])).alias("score"), (n - i).alias("back")))
    best = F.array_min(each)
    return held.withColumn("_best", best).withColumn("best_back", F.col("_best.back")).withColumn("best_score", F.col("_best.score") if smallest else -F.col("_best.score")).drop("_best", "_before")
