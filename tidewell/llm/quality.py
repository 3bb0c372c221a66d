"""Quality classification by co-training.

Two classifiers see a document from two sides: one its text (byte pairs, figures of its words), the other
its metadata, which are columns of the table (language, source, size) and nothing that is read from the
text. Both learn from labelled rows. Then, for ROUNDS rounds, each scores all rows that have no label, in
a pass over the whole table, and labels up to GIVEN rows of either class among those it is sure of (those
with the smallest hashes, so that they are spread over the table); these join the other one's training rows.
The views are calibrated on labelled rows that neither has seen. What a view adds to the log-odds of the
share of good rows is weighted by how far it can be trusted: of WEIGHTS for each view the pair with the
least log loss on the same rows. The sum scores every document.

Toxic rows are a second target, as most of them are of good quality. It is told by words: those WORDS whose
shares of toxic and other labelled rows differ most surely towards toxic are the features of a logistic model.

What is fitted is bounded: at most LABELLED labelled rows, chosen by a hash of the id, and the rows that the
views give each other. Models are fitted in one task, which returns their weights alone. Scoring reads every
whole text.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import arrow_rows, stored, whole_texts
from tidewell.llm.features import content, fit, metadata, sigmoid

LABELLED, ROUNDS, GIVEN, SURE = 4_000, 2, 250, 2.0
#: Every HELD-th labelled row of a class calibrates and the others are fitted.
HELD = 4
WEIGHTS = (1.0, 0.75, 0.5, 0.25, 0.125)
KEEP_FROM = 0.5
SCORES, CARRIED = ("text_score", "meta_score", "score", "toxic_score"), "_tidewell_scores"
WORDS, TOXIC_FROM = 64, 0.5
_WORD = re.compile(r"[^\W\d_]+")


def _views(texts, names, sizes) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([content(t) for t in texts]), np.stack([metadata(n, s) for n, s in zip(names, sizes)])


def log_odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w
    return z[:, 1] - z[:, 0]


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn a view's log-odds into calibrated ones (Platt's softened targets,
    damped Newton steps)."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, b = np.stack([z, np.ones_like(z)], 1).astype(float), np.array([1.0, 0.0])
    loss = lambda b: float(np.mean(np.logaddexp(0, x @ b) - t * (x @ b)))
    for _ in range(50):
        p = sigmoid(x @ b)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - t))
        while np.abs(step).max() > 1e-6 and loss(b - step) > loss(b):
            step = step / 2
        b = b - step
        if np.abs(step).max() < 1e-6:
            break
    return float(max(b[0], 0.0)), float(b[1])


def held_out(y: np.ndarray) -> np.ndarray:
    """Which of the labelled rows, in their order, calibrate: every HELD-th of a class."""
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[HELD - 1 :: HELD]] = True
    return held


def train(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic model in which both classes weigh the same."""
    rare = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    return fit(x, np.stack([1 - y, y], 1), rare)


def combined(views, models, y: np.ndarray):
    """Slope and offset of each view, the log-odds of the share of good rows and the weights of the views, from
    labelled rows (all that there are, where a class has none held out)."""
    held = held_out(y)
    if not 0 < y[held].sum() < held.sum():
        held[:] = True
    each = [(w, *_platt(log_odds(v[held], w), y[held])) for v, w in zip(views, models)]
    prior = float(np.log(y[held].mean() / (1 - y[held].mean())))
    odds = np.column_stack([a * log_odds(v[held], w) + b - prior for v, (w, a, b) in zip(views, each)])
    loss = lambda w: float(np.mean(np.logaddexp(0, prior + odds @ w) - y[held] * (prior + odds @ w)))
    return each, prior, min((np.array([a, b]) for a in WEIGHTS for b in WEIGHTS), key=loss)


def _fit_task(batches):
    """Rows (key, y, to_text, to_meta, c, m): labelled ones have y, others what the views gave each other.
    One row: the pickled weights of both views and, from combined(), the rest; or the share of good rows."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["key"], r["c"], r["m"]))
    labelled = [r for r in rows if r["y"] is not None]
    y = np.array([float(r["y"] >= 0.5) for r in labelled])
    if not 0 < y.sum() < len(y):
        found = ("share", (y.sum() + 1) / (len(y) + 2))
    else:
        arrays = lambda rows, x: np.stack([np.frombuffer(r[x], np.float32) for r in rows])
        views, models, fitted = [arrays(labelled, x) for x in "cm"], [], ~held_out(y)
        for v, x, given in ((views[0], "c", "to_text"), (views[1], "m", "to_meta")):
            more = [r for r in rows if r["y"] is None and r[given] is not None]
            own = [v[fitted], arrays(more, x)] if more else [v[fitted]]
            models.append(train(np.concatenate(own), np.concatenate([y[fitted], [float(r[given]) for r in more]])))
        found = ("models", models, combined(views, models, y))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["model"])


def _rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, name_cols: list[str], size_col: str | None, label_col: str) -> DataFrame:
    """(text, names, size, key, y, who) of docs. y: the mean of a document's labels, of at most LABELLED documents;
    who: a hash of the id of those."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_lid")).agg(F.avg(label_col).alias("y"))
    # Labels of documents that are not there would take the place of others.
    known = known.join(docs.select(F.col(id_col).alias("_lid")), "_lid", "left_semi").orderBy(F.xxhash64("_lid"), "_lid").limit(LABELLED)
    size = F.col(size_col).cast("long") if size_col else F.lit(None).cast("long")
    names = F.array(*[F.col(c).cast("string") for c in name_cols]).cast("array<string>")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), names.alias("names"), size.alias("size"))
    rows = rows.withColumn("key", F.xxhash64("_id", "text", "names", "size"))
    return rows.join(F.broadcast(stored(known)), F.col("_id") == F.col("_lid"), "left").select("text", "names", "size", "key", "y", F.xxhash64("_lid").alias("who"))


def _parts(batch, columns: list[str], rows: int = 500):
    for i in range(0, batch.num_rows, rows):
        part = batch.slice(i, rows)
        yield part, _views(*(part.column(c).to_pylist() for c in columns))


def _fitted(rows: DataFrame, given: dict[int, list]):
    """Models of the labelled rows and of those that given names (key: labels for the text view and the metadata view)."""
    spark = rows.sparkSession
    told = spark.createDataFrame([(k, *v) for k, v in given.items()], "gkey long, to_text int, to_meta int")
    few = rows.join(F.broadcast(told), F.col("key") == F.col("gkey"), "left").filter("y is not null or gkey is not null")

    def view(batches):
        for batch in batches:
            for part, (c, m) in _parts(batch, ["text", "names", "size"]):
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("key", "who", "y", "to_text", "to_meta")), pa.array([x.tobytes() for x in c], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary())], ["key", "who", "y", "to_text", "to_meta", "c", "m"])

    seen = few.mapInArrow(view, "key long, who long, y double, to_text int, to_meta int, c binary, m binary")
    # Of rows that share a labelled id, or repeat all that is read, one is fitted: at most LABELLED and what was given.
    columns = ["key", "y", "to_text", "to_meta", "c", "m"]
    seen = seen.groupBy(F.when(F.col("y").isNotNull(), F.col("who")).otherwise(F.col("key")), F.col("y").isNull()).agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    return pickle.loads(seen.repartition(1).mapInArrow(_fit_task, "model binary").first()[0])


def _sure(rows: DataFrame, models, given: dict[int, list]) -> None:
    """Adds to given what the models are sure of: for each view and class the GIVEN rows with the smallest keys
    among all rows without a label that the other view has not been given a label for."""
    shared = rows.sparkSession.sparkContext.broadcast((models, {k for k, v in given.items()}))

    def choose(batches):
        models, old = shared.value
        held: list[set[int]] = [set(), set(), set(), set()]
        for batch in batches:
            for part, views in _parts(batch, ["text", "names", "size"]):
                keys = part.column("key").to_numpy()
                for v in (0, 1):
                    z = log_odds(views[v], models[v])
                    for c, ok in ((0, z < -SURE), (1, z > SURE)):
                        held[2 * v + c].update(k for k in keys[ok].tolist() if k not in old)
            held = [set(sorted(x)[:GIVEN]) for x in held]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, x in enumerate(held) for _ in x], pa.int32()), pa.array([k for x in held for k in sorted(x)], pa.int64())], ["kind", "key"])

    found = stored(rows.filter("y is null").mapInArrow(choose, "kind int, key long").distinct())
    for kind in range(4):
        for r in found.filter(F.col("kind") == kind).orderBy("key").limit(GIVEN).collect():
            # What the text view (0, 1) knows goes to the metadata view, and the other way round.
            given.setdefault(r.key, [None, None])[1 if kind < 2 else 0] = kind % 2
    shared.destroy()


def co_train(rows: DataFrame, rounds: int = ROUNDS):
    """What _fit_task gives after so many rounds on rows of _rows()."""
    given: dict[int, list] = {}
    found = _fitted(rows, given)
    for _ in range(rounds if found[0] == "models" else 0):
        _sure(rows, found[1], given)
        found = _fitted(rows, given)
    return found


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _held(texts, words: list[str]) -> np.ndarray:
    """Which of the words each text holds, and a column of ones."""
    sets = [_words(t) for t in texts]
    return np.array([[*(w in s for w in words), True] for s in sets], np.float32).reshape(len(sets), len(words) + 1)


def fit_toxic(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, toxic_col: str):
    """(words, weights), or None where the labels have one kind of rows or none. Of several labels of a document the
    mean counts, of several texts the smallest."""
    if toxic_col not in labels.columns:
        return None
    known = labels.filter(F.col(toxic_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_lid")).agg((F.avg(toxic_col) >= 0.5).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64("_lid"), "_lid").limit(LABELLED)
    few = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), F.col("_id") == F.col("_lid"))
    few = stored(few.groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_y").alias("_y")))
    n, bad = few.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if not 0 < bad < n:
        return None

    def split(batches):
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = sorted(_words(text))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([y] * len(words), pa.int32())], ["word", "y"])

    counts = few.select("_text", "_y").mapInArrow(split, "word string, y int").groupBy("word").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    sure = (F.log(t / float(bad + 1)) - F.log(c / float(n - bad + 1))) / F.sqrt(1 / t + 1 / c)
    words = [r.word for r in counts.orderBy(sure.desc(), "word").limit(WORDS).select("word").collect()]

    def view(batches):
        for batch in batches:
            x = _held(batch.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)], ["id", "x", "y"])

    rows = few.select(F.xxhash64("_id"), "_text", "_y").mapInArrow(view, "id long, x binary, y int").collect()
    rows.sort(key=lambda r: (r.id, bytes(r.x)))
    y = np.array([r.y for r in rows])
    return words, fit(np.stack([np.frombuffer(r.x, np.float32) for r in rows]), np.stack([1 - y, y], 1), np.ones(len(y)))


def _toxic_scores(texts, fitted) -> np.ndarray:
    return np.zeros(len(texts)) if fitted is None else sigmoid(log_odds(_held(texts, fitted[0]), fitted[1])).astype(float)


def view_scores(views, fitted) -> list[np.ndarray]:
    """text_score, meta_score and score of rows, as co_train() has fitted them."""
    if fitted[0] == "share":
        return [np.full(len(views[0]), fitted[1])] * 3
    each, prior, weights = fitted[2]
    odds = np.column_stack([a * log_odds(x, w) + b for x, (w, a, b) in zip(views, each)])
    return [*sigmoid(odds).T, sigmoid(prior + (odds - prior) @ weights)]


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_cols: tuple[str, ...] = ("lang", "source"), size_col: str | None = "n_chars", label_col: str = "quality", keep_from: float = KEEP_FROM, carry: bool = False, toxic_col: str = "toxic", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: id_col, text_score, meta_score (each view's calibrated probability of
    good quality), score (both together), toxic_score (probability of being toxic; 0 where labels has no
    toxic_col or one kind of rows), good (score of at least keep_from), toxic (toxic_score of at least TOXIC_FROM)
    and keep (good and not toxic). Labels are 0 and 1. Null texts and metadata are scored as empty ones; texts may
    be of any length. Where the labels are all of one kind, or there are none, every score is the share of good ones
    among them and two more, one of each kind. Repeated rows are scored each; an empty table gives an empty result;
    columns that the table lacks are taken as null, and others are not read. With carry set, the columns of docs go
    along, and the rest is a struct CARRIED after them."""
    names = [c for c in name_cols if c in docs.columns]
    size_col = size_col if size_col in docs.columns else None
    with arrow_rows(docs.sparkSession):
        fitted = co_train(_rows(docs, labels, id_col, text_col, names, size_col, label_col), rounds)
        models = docs.sparkSession.sparkContext.broadcast((fitted, fit_toxic(docs, labels, id_col, text_col, toxic_col)))

    def score(batches):
        fitted, toxic = models.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = part.column(1).to_pylist()
                each = [*view_scores(_views(texts, part.column(2).to_pylist(), part.column(3).to_pylist()), fitted), _toxic_scores(texts, toxic)]
                good, bad = each[2] >= keep_from, each[3] >= TOXIC_FROM
                found = [*(pa.array(x, pa.float64()) for x in each), pa.array(good), pa.array(bad), pa.array(good & ~bad)]
                if carry:
                    yield pa.RecordBatch.from_arrays([*part.columns[4:], pa.StructArray.from_arrays(found, told.names)], [*docs_columns, CARRIED])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), *found], [id_col, *told.names])

    size = F.col(size_col).cast("long") if size_col else F.lit(None).cast("long")
    told = T.StructType([*[T.StructField(c, T.DoubleType()) for c in SCORES], *[T.StructField(c, T.BooleanType()) for c in ("good", "toxic", "keep")]])
    named = F.array(*[F.col(c).cast("string") for c in names]).cast("array<string>")
    wanted = [F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), named.alias("_names"), size.alias("_size")]
    docs_columns = docs.columns
    if carry:
        return docs.select(*wanted, "*").mapInArrow(score, T.StructType([*docs.schema, T.StructField(CARRIED, told)]))
    return docs.select(*wanted).mapInArrow(score, T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *told]))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the classifier rejects as poor or toxic, each judged by its own text and metadata,
    whatever its id; the columns stay."""
    scored = quality_scores(docs, labels, id_col, text_col, carry=True)
    whole_texts(docs.sparkSession)
    return scored.filter(f"{CARRIED}.keep").drop(CARRIED)
