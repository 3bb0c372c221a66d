"""Secret scans with a trigram index, in DataFrame functions alone.

Each rule's regular expression gives a Boolean query of trigrams that any match contains. The
index holds (trigram, document) postings of the trigrams that the rules ask for, over texts in
lower case. Postings are intersected by document; documents that satisfy a rule's query are
verified with the expression itself. A rule whose expression has no trigram that must occur
(a run of hex digits, say) is verified on every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import new_path


@dataclass(frozen=True)
class Rule:
    """A match counts if the given group has at least `least` characters. Matches are leftmost
    and do not overlap; those too short are dropped after matching."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
ADDED_RULES = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + ADDED_RULES

#: A query is a trigram, ("and", queries), ("or", queries) or None, which every text satisfies.
MOST_STRINGS = 64
MASK_BITS = 60
#: Candidates (id and rules, 16 bytes) are broadcast up to this many; more are joined, by a shuffle of the texts.
BROADCAST_IDS = 1_000_000


def _all(queries) -> object:
    parts = [q for q in queries if q is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))


def _any(queries) -> object:
    parts = list(dict.fromkeys(queries))
    if None in parts or not parts:
        return None
    # A branch that asks for more than another one is implied by it.
    needs = {q: trigrams_of(q) for q in parts if isinstance(q, str) or all(isinstance(x, str) for x in q[1]) and q[0] == "and"}
    parts = [q for q in parts if q not in needs or not any(needs[o] < needs[q] for o in needs)]
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> object:
    return _any(_all(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings))


def _parts(tree) -> tuple[set[str] | None, object]:
    """The strings that the expression can be, if they are few, and its query."""
    now, queries = {""}, []
    for op, arg in tree:
        name, few, query = str(op), None, None
        if name == "LITERAL":
            few = {chr(arg).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            few = {chr(c).lower() for _, c in arg}
        elif name == "SUBPATTERN":
            few, query = _parts(arg[3])
        elif name == "BRANCH":
            found = [_parts(x) for x in arg[1]]
            few = None if any(f is None for f, _ in found) else set().union(*(f for f, _ in found))
            query = _any(q for _, q in found)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            few, query = _parts(arg[2])
            if (arg[0], arg[1]) == (0, 1) and few is not None:
                few = few | {""}
            elif arg[0] == arg[1] and few is not None and len(few) ** arg[0] <= MOST_STRINGS:
                few = reduce(lambda a, _: {x + y for x in a for y in few}, range(arg[0]), {""})
            else:
                few, query = None, query if arg[0] else None
        if few is not None and len(few) * len(now) <= MOST_STRINGS:
            now = {x + y for x in now for y in few}
        else:
            queries += [_of_strings(now), query if few is None else _of_strings(few)]
            now = {""} if few is None else few
            if few is not None:
                continue
    if not queries:
        return now, _of_strings(now)
    return None, _all([*queries, _of_strings(now)])


def trigram_query(pattern: str) -> object:
    from re import _parser

    return _parts(_parser.parse(pattern))[1]


def trigrams_of(query: object) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def trigram_index(docs: DataFrame, trigrams: list[str], id_col: str, text_col: str) -> DataFrame:
    """Postings: a row (trigram, id) for each of the trigrams that a document's text has."""
    low = docs.select(id_col, F.lower(text_col).alias("_low"))
    there = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return low.select(id_col, F.explode(there).alias("trigram"))


def candidates(postings: DataFrame, queries: list[object], trigrams: list[str], id_col: str) -> DataFrame:
    """Intersects postings: id and `_rules`, the bits of the queries that the document satisfies."""
    place = {t: divmod(i, MASK_BITS) for i, t in enumerate(trigrams)}
    words = 1 + (len(trigrams) - 1) // MASK_BITS
    bit = F.expr(f"shiftleft(1L, trigram % {MASK_BITS})")
    held = postings.groupBy(id_col).agg(*[F.bit_or(F.when((F.col("trigram") / MASK_BITS).cast("int") == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"_m{w}") for w in range(words)])

    def holds(query) -> Column:
        if isinstance(query, str):
            w, b = place[query]
            return F.col(f"_m{w}").bitwiseAND(F.lit(1 << b)) != 0
        return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), map(holds, query[1]))

    rules = reduce(lambda a, b: a.bitwiseOR(b), [F.when(holds(q), F.lit(1 << i)).otherwise(F.lit(0)) for i, q in enumerate(queries) if q is not None])
    return held.select(id_col, rules.alias("_rules")).filter("_rules != 0")


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """array<struct<start, kind order, end, kind>> of a rule's matches in code points. The text
    between matches comes from split(), so that lengths add up to positions."""
    matches, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("size"), (F.length(F.regexp_extract(m, rule.pattern, rule.group)) if rule.group else F.length(m)).alias("held")))
    kind = "array<struct<start:int,k:int,end:int,kind:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["size"]
        one = F.array(F.struct(begin.alias("start"), F.lit(order).alias("k"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(x["held"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pairs, start, add, lambda acc: acc["out"])


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and `spans`, array<struct<start, k, end, kind>> in the
    order of start and then of the rules; positions are code points, the end is exclusive.
    Null and empty texts have no spans. Ids may repeat or be null: the index only narrows down
    which rules to try, and a row without an id is tried with all of them. Texts may be of any length, an empty
    table gives an empty result, and other columns are not read."""
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted(set().union(*map(trigrams_of, queries)))
    base = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text"))
    everywhere = sum(1 << i for i, q in enumerate(queries) if q is None)
    if trigrams:
        # Written by Spark's own writer, as no Python is to run here; it is counted before it is joined.
        spark, path = docs.sparkSession, new_path(docs.sparkSession, "candidates")
        candidates(trigram_index(docs, trigrams, id_col, text_col), queries, trigrams, id_col).withColumnRenamed(id_col, "_cid").write.parquet(path)
        found = spark.read.parquet(path)
        base = base.join(F.broadcast(found) if found.count() <= BROADCAST_IDS else found, F.col(id_col) == F.col("_cid"), "left")
        asked = F.when(F.col(id_col).isNull(), F.lit((1 << len(rules)) - 1)).otherwise(F.coalesce("_rules", F.lit(0)).bitwiseOR(F.lit(everywhere)))
    else:
        asked = F.lit(everywhere)
    base = base.select(id_col, "_text", asked.alias("_asked"))
    none = F.array().cast("array<struct<start:int,k:int,end:int,kind:string>>")

    def gate(i: int, r: Rule) -> Column:
        asks = F.col("_asked").bitwiseAND(F.lit(1 << i)) != 0
        # A cheaper look at texts where nothing is long enough.
        long_run = re.fullmatch(r"(\[[^\]]+\])\+", r.pattern)
        return asks & F.col("_text").rlike(f"{long_run[1]}{{{r.least},}}") if long_run and r.least else asks

    each = [F.when(gate(i, r), _spans(r, i, F.col("_text"))).otherwise(none) for i, r in enumerate(rules)]
    return base.select(id_col, F.array_sort(F.concat(*each)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
