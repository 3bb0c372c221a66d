"""Mixing to target weights with soft domain membership.

A classifier fitted on labelled rows gives each document a probability for every domain. With n
tokens and probabilities p a document adds r * n * p to the domains' totals when it is taken at
rate r. Projected gradient descent on the least-squares distance between totals and targets
finds rates r >= 0, starting from 1.

The gradient of a document is n * (p . e), where e is the domains' excess over their targets, so a
step is fully told by one number for each domain. Only these numbers are kept: every pass
replays them on each row (r = max(0, r - p . c) for each c in turn) and sums the totals of the
domains, a row from each batch. The descent is one in another metric: steps are scaled by 1 / n, so that
a long document is not taken out before a short one, and by the inverse of the domains' second-moment
matrix over the documents with a rate above 0, which makes it a projected Newton step. A step that does not
bring the totals closer to the targets is not taken but halved, so every step that is taken lowers the
distance. Passes end when the totals are within CLOSE of the targets, when halving no longer helps (targets
that no rates reach), or after PASSES with a warning that says how far off the totals are.
"""

from __future__ import annotations

import pickle
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import arrow_rows, stored
from tidewell.llm.features import content, fit, softmax

#: Labelled rows that the classifier is fitted on, passes at most, the relative distance of totals and targets
#: that is close enough, and the smallest share of a step that is tried.
LABELLED, PASSES, CLOSE, LEAST_STEP = 4_000, 100, 1e-4, 2.0**-30
#: Domains that are told apart; documents of any others count as OTHER.
DOMAINS, OTHER = 64, "other"
CARRIED = ("_tidewell_tokens", "_tidewell_p")


def _fit_task(batches):
    """Rows (spot, domain, x): a row with the pickled domains and weights."""
    rows = sorted(((r["spot"], r["domain"], r["x"]) for b in batches for r in b.to_pylist()))
    domains = sorted({r[1] for r in rows})
    found: tuple = (domains, None)
    if domains:
        x = np.stack([np.frombuffer(r[2], np.float32) for r in rows])
        found = (domains, fit(x, np.eye(len(domains), dtype=np.float32)[[domains.index(r[1]) for r in rows]], np.ones(len(rows))))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["model"])


def fit_domains(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, domain_col: str, asked: list[str] | None = None, rows: int = LABELLED):
    """(domains, weights) from at most `rows` documents that the label table covers, chosen by a hash of the id;
    of rows that share an id the smallest. They are fitted in one task, which returns the weights alone. Domains
    that are not asked for, or, if none are, all but the DOMAINS most frequent, are OTHER."""
    known = docs.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain"), F.col(text_col).alias("text")).filter("id is not null and domain is not null")
    spot = F.xxhash64("id", F.lit("domain"))
    chosen = known.select("id").join(labels.select(F.col(id_col).alias("id")), "id", "left_semi").distinct().orderBy(spot, "id").limit(rows)
    few = known.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("domain", "text")).alias("row")).select(spot.alias("spot"), "row.domain", "row.text")
    few = stored(few)
    if asked is None:
        asked = [r.domain for r in few.groupBy("domain").count().orderBy(F.desc("count"), "domain").limit(DOMAINS).collect()]

    def view(batches):
        for batch in batches:
            domains = [d if d in asked else OTHER for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(domains, pa.string()), pa.array([content(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())], ["spot", "domain", "x"])

    seen = few.mapInArrow(view, "spot long, domain string, x binary").repartition(1)
    return pickle.loads(seen.mapInArrow(_fit_task, "model binary").first()[0])


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", carry: bool = False, asked: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(id_col, n_tokens, p: array of a probability for each domain) and the domains in order, which are
    the values of domain_col among the documents that labels covers (see fit_domains); nothing else of it is read.
    Tokens are what white space separates. Without a labelled row there is one domain, `all`.
    With carry set, the columns of docs stand in the place of id_col, and the rest is called as in CARRIED."""
    with arrow_rows(docs.sparkSession):
        domains, weights = fit_domains(docs, labels, id_col, text_col, domain_col, asked)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def predict(batches):
        w = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = part.column(0).to_pylist()
                p = softmax(np.stack([content(t) for t in texts]) @ w).astype(np.float64) if w is not None else np.ones((len(texts), 1))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([len((t or "").split()) for t in texts], pa.int64()), flat], schema.names)

    names = CARRIED if carry else ("n_tokens", "p")
    own = docs.schema if carry else [docs.schema[id_col]]
    schema = T.StructType([*own, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.DoubleType()))])
    return docs.select(F.col(text_col).alias("_text"), *[docs[f.name] for f in own]).mapInArrow(predict, schema), domains or ["all"]


def replay(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    r = np.ones(len(p))
    for c in steps:
        r = np.maximum(0, r - p @ c)
    return r


def _arrays(batch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.column("n_tokens").to_numpy().astype(float)
    return n, batch.column("p").flatten().to_numpy().reshape(len(n), -1)


def _totals(rows: DataFrame, steps: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The domains' totals, and their second moments over the documents with a rate above 0."""

    def add(batches):
        for batch in batches:
            if batch.num_rows:
                n, p = _arrays(batch)
                r = replay(p, steps)
                out = np.concatenate([(r * n) @ p, ((p * (n * (r > 0))[:, None]).T @ p).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), pa.array(out)], ["i", "v"])

    got = {r.i: r.s for r in rows.select("n_tokens", "p").mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("s")).collect()}
    flat = np.array([got.get(i, 0.0) for i in range(k + k * k)])
    return flat[:k], flat[k:].reshape(k, k)


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, tokens: float | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang") -> DataFrame:
    """One row per row of docs: id_col, domain (the likeliest one, the first of equals), n_tokens,
    rate (0 or more) and copies: the rate rounded up or down at random, by a hash of the id, so
    that copies have the rate as their mean. targets are weights of the domains (others: 0; none at all: equal
    weights), and tokens is their sum (else what docs has). Null and empty texts have no tokens, and the rate of their
    posteriors like any other; texts may be of any length. Repeated rows count and are returned each; an empty table
    gives an empty result. Other columns are not read."""
    found, domains = posteriors(docs, labels, id_col, text_col, domain_col, asked=None if targets is None else sorted(targets))
    with arrow_rows(docs.sparkSession):
        rows = stored(found)
    taken = _steps(rows, domains, targets, tokens)

    def rates(batches):
        for batch in batches:
            _, p = _arrays(batch)
            best = p.argmax(1) if len(p) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([domains[b] for b in best], pa.string()), batch.column(1), pa.array(replay(p, taken))], [id_col, "domain", "n_tokens", "rate"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("domain", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("rate", T.DoubleType())])
    return rows.mapInArrow(rates, schema).withColumn("copies", _copies(F.xxhash64(F.col(id_col), F.lit("copies"))))


def _copies(hashed: Column) -> Column:
    chance = F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)
    return F.floor(F.col("rate") + chance).cast("long")


def _steps(rows: DataFrame, domains: list[str], targets: dict[str, float] | None, tokens: float | None) -> list[np.ndarray]:
    """The steps of the descent for rows (n_tokens, p)."""
    weight = np.array([1.0 if targets is None else float(targets.get(d, 0.0)) for d in domains])
    weight = weight / weight.sum() if weight.sum() > 0 else np.full(len(domains), 1 / len(domains))
    steps: list[np.ndarray] = []
    now, moments = _totals(rows, steps, len(domains))
    goal = weight * (now.sum() if tokens is None else tokens)
    scale, size, off = max(float(np.linalg.norm(goal)), 1.0), 1.0, 0.0
    for _ in range(PASSES):
        off = float(np.linalg.norm(now - goal)) / scale
        if off < CLOSE or not now.sum() or size < LEAST_STEP:
            break
        ridge = 1e-9 * max(float(np.trace(moments)), 1.0)
        step = size * np.linalg.solve(moments + ridge * np.eye(len(domains)), now - goal)
        then, later = _totals(rows, [*steps, step], len(domains))
        if np.linalg.norm(then - goal) / scale < off * (1 - 1e-6):
            steps, now, moments, size = [*steps, step], then, later, min(1.0, size * 2)
        else:
            size /= 2
    if off >= CLOSE and now.sum():
        warnings.warn(f"the totals are {off:.2%} off their targets", stacklevel=3)
    return steps


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang") -> DataFrame:
    """docs with domain, rate and copies as by mixing_rates, without the rows of rate 0; columns of docs with
    these names are replaced, all others stay. Each row has the rate of its own text, so ids may repeat or be null;
    copies of a row without an id are rounded by a hash of the text. Of an empty table nothing is left."""
    kept = docs.drop(*[c for c in ("domain", "rate", "copies") if c != domain_col])
    found, domains = posteriors(kept, labels, id_col, text_col, domain_col, carry=True, asked=None if targets is None else sorted(targets))
    with arrow_rows(docs.sparkSession):
        rows = stored(found)
    tokens, p = (F.col(c) for c in CARRIED)
    rate = F.lit(1.0)
    for c in _steps(rows.select(tokens.alias("n_tokens"), p.alias("p")), domains, targets, None):
        rate = F.greatest(F.lit(0.0), rate - sum(p[i] * float(x) for i, x in enumerate(c)))
    domain = F.element_at(F.array(*[F.lit(d) for d in domains]), F.array_position(p, F.array_max(p)).cast("int"))
    told = rows.withColumn("domain", domain).withColumn("rate", rate).filter("rate > 0")
    spot = F.when(F.col(id_col).isNull(), F.xxhash64(text_col, F.lit("copies"))).otherwise(F.xxhash64(id_col, F.lit("copies")))
    return told.withColumn("copies", _copies(spot)).drop(*CARRIED)
