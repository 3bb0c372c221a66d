"""Near duplicates by a chosen-path similarity join.

A document is the set of its distinct word shingles, kept as 64-bit hashes; equal sets are one node
from the start. In each of TREES independent trees a set is followed down the path of its smallest
shingles under one hash function after another (its minwise tokens). Sets at the same place of a tree
make a node. A node of at most SMALL sets is compared exhaustively; a larger one is never brought
together: its sets branch by the next token, down to DEPTH tokens, and what is still together then is
handled as described below. Two sets of similarity s meet at depth d of a tree with probability s**d;
at the threshold 0.8 and the start depth of 3 all 20 trees miss a pair with probability 6e-7. A large
node compares nothing at first, so a pair that meets there has to stay together further down. Large nodes
of depth START that are not of one component once links are known are then compared themselves, if at most
DIRECT of their sets are outside their largest component: each set with those, not all with all. The sets
of nodes with more outside are placed in MORE trees of their own hash functions instead, at depth DEPTH
at once, where nodes of any size are compared: at 0.8 these miss a pair with (1 - 0.8**6)**48 = 5e-7.
Whatever nodes a pair passes, it is missed with 1.1e-6 at most.

Within a node pairs are first held against sketches of one bit for each hash function. A pair
at the threshold agrees on 108 of 120 bits with a deviation of 3.3, and is let through from 88
on. Pairs let through are confirmed on the full sets.

Links come in waves, so that a group of copies does not bring a link for each set and tree. A node gives
at most one pair for each of its sets: the first set before it that the sketches let through. The pairs
of the first FIRST trees are confirmed and give components; of the pairs of the other trees only those
between different components are confirmed. At last come the nodes that still hold let-through pairs of
different components: these pairs are held against all minwise tokens (at 0.8 a pair agrees on 96 of 120
with a deviation of 4.4, and goes on from 72), and the sets of those that go on are compared exhaustively, each
time skipping what has been joined by then. What several trees find is compared once: units that share sets are merged where that is less work. Links inside a component would change nothing, so none that matters is lost. A node of more than
BLOCK sets is dealt out in pairs of blocks, without those that hold its largest component alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import ROW, arrow_rows, drop_stored, first_of_groups, stored, with_rows
from tidewell.llm.components import components, extended

TREES, START, DEPTH, SMALL = 20, 3, 6, 32
#: Trees whose links are confirmed first, and the bits of a path that hold the number of its tree.
FIRST, TREE = 3, 127
#: In the place of a tree: a unit that is of no tree.
ALL = TREE
#: Units are merged where that gives at most so many times the pairs.
MORE_PAIRS = 4
#: Further trees, from depth DEPTH on, for sets of large nodes that are not compared themselves.
MORE = 48
#: They are searched in waves, as after the first one little is left to join.
MORE_WAVES = (range(0, 6), range(6, MORE))
BITS = TREES * DEPTH
AGREE = 88
#: Of BITS minwise tokens; the expectation at 0.8 is 96 with a deviation of 4.4.
AGREE_TOKENS = 72
BLOCK = 1_024
#: Large nodes of depth START with at most so many sets outside their largest component are compared themselves. Of up to one
#: block each set is dealt out twice at most on the average, which is less in all of TREES than its places in MORE trees.
DIRECT = BLOCK
#: Bytes of full sets, and common values of them, that are compared at a time.
UNIT_BYTES, SPOTS = 32 << 20, 1 << 22
#: Ids, places and labels are broadcast up to this many (8 or 16 bytes each), else joined.
BROADCAST_IDS = 500_000
#: Up to so many places are named in a filter; more are joined.
FEW_PATHS = 256
#: Rows without texts or sets that Python functions get at a time.
NARROW_ROWS = 10_000

_U = np.uint64
_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(0, 2**63, BITS, dtype=np.uint64) * _U(2) + _U(1)
_FLIP = _rng.integers(0, 2**64, BITS, dtype=np.uint64)
_MORE_MULTIPLY = _rng.integers(0, 2**63, MORE * DEPTH, dtype=np.uint64) * _U(2) + _U(1)
_MORE_FLIP = _rng.integers(0, 2**64, MORE * DEPTH, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles. A-Z is lower-cased, words are
    what ASCII white space separates. Fewer words than a shingle make one of them all."""
    flat = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes = pc.list_value_length(flat).to_numpy(zero_copy_only=False)
    parts = pc.list_flatten(flat).dictionary_encode()
    names = parts.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
    empty = np.fromiter((not w for w in names), bool, len(names))
    codes = parts.indices.to_numpy()
    values, full = hashes[codes] if len(codes) else np.zeros(0, np.uint64), ~empty[codes] if len(codes) else np.zeros(0, bool)
    out, at = [], 0
    for n in sizes:
        own = values[at : at + n][full[at : at + n]]
        at += n
        m = len(own)
        if not m:
            out.append(own)
            continue
        k = min(m, words)
        joined = np.full(m - k + 1, _U(k))
        for j in range(k):
            joined = joined * _U(0x9E3779B97F4A7C15) + own[j : m - k + 1 + j]
        out.append(np.unique(mix(joined)))
    return out


def minima(shingles: np.ndarray, flip: np.ndarray = _FLIP, multiply: np.ndarray = _MULTIPLY) -> np.ndarray:
    """The smallest value of a set under each hash function."""
    best = np.full(len(flip), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 1024):
        part = shingles[a : a + 1024]
        np.minimum(best, ((part[None, :] ^ flip[:, None]) * multiply[:, None]).min(1), out=best)
    return best


def _signatures(words: int):
    def sign(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                sets = shingle_sets(part.column(1), words)
                prints, tokens, bits = [], [], []
                for s in sets:
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    low = minima(s) if len(s) else np.zeros(BITS, np.uint64)
                    tokens.append((low >> _U(32)).astype(np.uint32).tobytes())
                    bits.append(np.packbits(((mix(low) >> _U(7)) & _U(1)).astype(np.uint8), bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(tokens, pa.binary()), pa.array(bits, pa.binary())], ["id", "n", "print", "tokens", "bits"])

    return sign


def _more_tokens(words: int, trees: range):
    """(id, print, tokens) of each set that is not empty, for these of the further trees."""
    own = slice(trees.start * DEPTH, trees.stop * DEPTH)

    def sign(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), words)
            some = [i for i, s in enumerate(sets) if len(s)]
            prints = [xxhash.xxh3_128_digest(sets[i].tobytes()) for i in some]
            tokens = [(minima(sets[i], _MORE_FLIP[own], _MORE_MULTIPLY[own]) >> _U(32)).astype(np.uint32).tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), pa.array(prints, pa.binary()), pa.array(tokens, pa.binary())], ["id", "print", "tokens"])

    return sign


def _more_places(trees: range):
    """A row for each of these further trees: where the set stands at depth DEPTH, with its label."""

    def place(batches):
        for batch in batches:
            n, m = batch.num_rows, len(trees)
            if not n:
                continue
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(n, m, DEPTH)
            path = np.broadcast_to(np.arange(TREES + trees.start, TREES + trees.stop, dtype=np.uint64)[None, :], (n, m)).copy()
            for d in range(DEPTH):
                path = mix(path * _U(31) + tokens[:, :, d])
            path = path & ~_U(TREE) | np.arange(TREES + trees.start, TREES + trees.stop, dtype=np.uint64)
            bits = np.frombuffer(b"".join(x.ljust(16, b"\0") for x in batch.column("bits").to_pylist()), np.int64).reshape(n, 2)
            each = pa.array(np.repeat(np.arange(n), m))
            yield pa.RecordBatch.from_arrays([pa.array(path.ravel().view(np.int64)), batch.column("id").take(each), batch.column("n").take(each), pa.array(np.repeat(bits[:, 0], m)), pa.array(np.repeat(bits[:, 1], m)), batch.column("label").take(each)], [*_PLACE, "label"])

    return place


_PLACE = ["path", "id", "n", "s0", "s1"]
_NEXT = [f"t{d}" for d in range(START, DEPTH)]


def _places(batches):
    """A row for each tree: where the set stands at depth START, and its further tokens. The lowest bits
    of a path (TREE) tell the tree."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(n, TREES, DEPTH)
        path = np.broadcast_to(np.arange(TREES, dtype=np.uint64)[None, :], (n, TREES)).copy()
        for d in range(START):
            path = mix(path * _U(31) + tokens[:, :, d])
        path = path & ~_U(TREE) | np.arange(TREES, dtype=np.uint64)
        bits = np.frombuffer(b"".join(x.ljust(16, b"\0") for x in batch.column("bits").to_pylist()), np.int64).reshape(n, 2)
        rest = tokens[:, :, START:].reshape(n * TREES, DEPTH - START).view(np.int32)
        each = pa.array(np.repeat(np.arange(n), TREES))
        columns = [pa.array(path.ravel().view(np.int64)), batch.column("id").take(each), batch.column("n").take(each), pa.array(np.repeat(bits[:, 0], TREES)), pa.array(np.repeat(bits[:, 1], TREES))]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(np.ascontiguousarray(rest[:, d])) for d in range(DEPTH - START)], _PLACE + _NEXT)


def _agree(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    return BITS - np.bitwise_count((s ^ t).view(np.uint64)).sum(-1, dtype=np.int64)


def _like(n: np.ndarray, s: np.ndarray, a: np.ndarray, b: np.ndarray, ratio: tuple[int, int]) -> np.ndarray:
    """Whether sizes and sketches of the rows a and b allow for the threshold."""
    small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    ok = small * ratio[1] >= large * ratio[0]
    ok[ok] = _agree(s[a[ok]], s[b[ok]]) >= AGREE
    return ok


def _sketches(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("n").to_numpy(), np.stack([table.column("s0").to_numpy(), table.column("s1").to_numpy()], 1)


def _nodes(batches):
    """Rows sorted by path in tables that tear no node."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        path = table.column("path").to_numpy()
        last = int(np.searchsorted(path, path[-1], "left"))
        if last:
            yield table.slice(0, last)
        held = table.slice(last)
    if held is not None:
        yield held


def _found(table: pa.Table, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Pairs of rows of a table as (path, a, b), beside empty columns of a place."""
    ids = table.column("id").combine_chunks()
    none = [pa.nulls(len(a), table.schema.field(c).type) for c in [*_PLACE[1:], "path"]]
    return pa.RecordBatch.from_arrays([table.column("path").combine_chunks().take(pa.array(a)), ids.take(pa.array(a)), ids.take(pa.array(b)), *none], ["path", "a", "b", *_PLACE[1:], "first"])


def _small_nodes(ratio: tuple[int, int]):
    """Nodes of at most SMALL sets: pairs (path, a, b), and the rows of nodes that have more to compare. `first` is
    that of the rows, if they have one."""

    def compare(batches):
        for table in _nodes(batches):
            path = table.column("path").to_numpy()
            start = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
            size = np.diff(np.concatenate((start, [len(path)])))
            n, s = _sketches(table)
            lefts, rights, late = [], [], np.zeros(len(path), bool)
            for k in range(2, SMALL + 1):
                chosen = start[size == k]
                i, j = np.triu_indices(k, 1)
                for c in range(0, len(chosen), 20_000):
                    at = chosen[c : c + 20_000]
                    ok = _like(n, s, (at[:, None] + i).ravel(), (at[:, None] + j).ravel(), ratio).reshape(len(at), -1)
                    given = np.zeros(len(at), int)
                    for y in range(1, k):
                        own = ok[:, j == y]
                        some = own.any(1)
                        lefts.append((at + own.argmax(1))[some])
                        rights.append((at + y)[some])
                        given += some
                    more = at[ok.sum(1) > given]
                    late[(more[:, None] + np.arange(k)).ravel()] = True
            if lefts and sum(map(len, lefts)):
                yield _found(table, np.concatenate(lefts), np.concatenate(rights))
            if late.any():
                own = [c for c in ("first",) if c in table.column_names]
                rest = table.select([*_PLACE, *own]).filter(pa.array(late)).combine_chunks()
                none = pa.nulls(rest.num_rows, table.schema.field("id").type)
                first = rest.column("first").chunk(0) if own else pa.nulls(rest.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([rest.column("path").chunk(0), none, none, *(rest.column(c).chunk(0) for c in _PLACE[1:]), first], ["path", "a", "b", *_PLACE[1:], "first"])

    return compare


def _neighbours(ratio: tuple[int, int]):
    """Rows of large nodes, sorted by path and sketch: pairs of each row with the one before it and with
    the first of its run of SMALL rows, and of such firsts. Nothing depends on where a batch ends but
    which of these pairs there are."""

    def link(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = (table if last is None else pa.concat_tables([last, table])).combine_chunks()
            last = table.slice(table.num_rows - 1)
            path, at = table.column("path").to_numpy(), np.arange(table.num_rows)
            begin = np.maximum.accumulate(np.where(np.concatenate(([True], path[1:] != path[:-1])), at, 0))
            first = begin + (at - begin) // SMALL * SMALL
            before = np.where(first == at, at - SMALL, at - 1)
            a, b = np.concatenate([np.maximum(at - 1, 0), first, np.maximum(before, begin)]), np.tile(at, 3)
            ok = (a != b) & (path[a] == path[b])
            a, b = np.unique(np.stack([a[ok], b[ok]]), axis=1)
            ok = _like(*_sketches(table), a, b, ratio) if len(a) else np.zeros(0, bool)
            if ok.any():
                yield _found(table, a[ok], b[ok]).select(["path", "a", "b"])

    return link


def _linked_parts(m: int, like) -> list[np.ndarray]:
    """Of m rows those that have an open pair, by connected parts. like(i): the later rows that i has one with."""
    part, seen = np.arange(m), np.zeros(m, bool)
    for i in range(m - 1):
        b = like(i)
        if len(b):
            seen[i] = seen[b] = True
            for v in np.unique(part[b[part[b] != part[i]]]):
                part[part == max(v, part[i])] = min(v, part[i])
    return [np.flatnonzero((part == v) & seen) for v in np.unique(part[seen])]


def _units(table: pa.Table, units: list[np.ndarray], columns: list[str], trees: np.ndarray | None = None) -> pa.RecordBatch:
    """The rows of each unit, under a hash of the unit's ids in the place of the path: a unit that was found
    twice is one. trees: the number of the tree that each unit goes on with; then rows also get `first`, an id of
    the unit that stands for it."""
    ids, names, firsts = table.column("id").to_pylist(), [], []
    for k, u in enumerate(units):
        name = xxhash.xxh3_64_intdigest("\0".join(sorted(str(ids[i]) for i in u)))
        names.append(np.full(len(u), name if trees is None else name & ~TREE | int(trees[k]), np.uint64))
        firsts.append(np.full(len(u), min(u, key=lambda i: str(ids[i]))))
    take = table.select(columns).take(pa.array(np.concatenate(units))).combine_chunks()
    out = {"path": pa.array(np.concatenate(names).view(np.int64)), **{c: take.column(c).chunk(0) for c in columns}}
    if trees is not None:
        out["first"] = table.column("id").combine_chunks().take(pa.array(np.concatenate(firsts)))
    return pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _open_rows(ratio: tuple[int, int]):
    """Of late nodes, the rows that have a let-through pair in another component, by parts that such pairs
    connect: (path, id, label, first)."""

    def choose(batches):
        for table in _nodes(batches):
            path = table.column("path").to_numpy()
            cuts = [*np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1]))), len(path)]
            labels = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            n, s = _sketches(table)
            units = []
            for x, y in zip(cuts, cuts[1:]):
                if (labels[x:y] == labels[x]).all():
                    continue

                def like(i, x=x, y=y):
                    b = x + i + 1 + np.flatnonzero(labels[x + i + 1 : y] != labels[x + i])
                    return b[_like(n, s, np.full(len(b), x + i), b, ratio)] - x

                units += [x + u for u in _linked_parts(y - x, like)]
            if units:
                yield _units(table, units, ["id", "label"], path[[u[0] for u in units]] & TREE)

    return choose


def _alike_rows(ratio: tuple[int, int]):
    """The same by the minwise tokens of the first TREES trees, which tell similarities better than the sketches. A pair
    that stays together in some of these trees to the end is looked at in the first of them alone: it is in a node
    there that has compared it or is one of the late ones. In units of _merged(), whose tree is ALL, every pair is
    looked at. Parts of many or long sets are cut into pieces of about UNIT_BYTES of sets, and the pairs of these are the units."""

    def choose(batches):
        for table in _single_nodes(batches):
            labels = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            n = table.column("n").to_numpy()
            tokens = np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint32).reshape(len(n), BITS)
            tree = table.column("path")[0].as_py() & TREE

            def like(i):
                b = i + 1 + np.flatnonzero(labels[i + 1 :] != labels[i])
                small, large = np.minimum(n[b], n[i]), np.maximum(n[b], n[i])
                b = b[small * ratio[1] >= large * ratio[0]]
                same = tokens[b] == tokens[i]
                together = same.reshape(len(b), TREES, DEPTH).all(2)
                return b[(same.sum(1) >= AGREE_TOKENS) & ((tree == ALL) | ~together.any(1) | (together.argmax(1) == tree))]

            units = []
            for own in _linked_parts(len(n), like):
                own = own[np.argsort(n[own], kind="stable")]
                piece = np.cumsum(n[own] * 8) // UNIT_BYTES
                parts = [own[piece == v] for v in np.unique(piece)]
                units += parts if len(parts) == 1 else [np.concatenate([parts[u], parts[v]]) for u in range(len(parts)) for v in range(u + 1, len(parts)) if v == u + 1 or n[parts[u]].max() * ratio[1] >= n[parts[v]].min() * ratio[0]]
            if units:
                yield _units(table, units, ["id", "label"])

    return choose


def _exhaust(ratio: tuple[int, int]):
    """Compares the sets of each unit; gives the links that join components."""

    def exhaust(batches):
        for table in _single_nodes(batches):
            ids, sets = table.column("id"), [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
            label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy().copy()
            sizes = np.array([len(x) for x in sets])
            owner, values = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
            codes = np.unique(values, return_inverse=True)[1]
            by = np.argsort(codes, kind="stable")
            begin = np.concatenate(([0], np.cumsum(np.bincount(codes))))
            holders, at = owner[by], np.concatenate(([0], np.cumsum(sizes)))
            left, right = [], []
            for i in range(len(sets)):
                # How many of set i's values every other set holds, of so many values at a time that they have about SPOTS holders.
                own = codes[at[i] : at[i + 1]]
                width = begin[own + 1] - begin[own]
                both, part = np.zeros(len(sets), np.int64), np.cumsum(width) // SPOTS
                for x in np.unique(part):
                    o, w = own[part == x], width[part == x]
                    spots = np.repeat(begin[o] - (np.cumsum(w) - w), w) + np.arange(w.sum())
                    both += np.bincount(holders[spots], minlength=len(sets))
                for j in np.flatnonzero((both * ratio[1] >= ratio[0] * (sizes + sizes[i] - both)) & (label != label[i])):
                    if label[j] != label[i]:
                        left.append(i)
                        right.append(j)
                        label[label == label[j]] = label[i]
            if left:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)).combine_chunks() for x in (left, right)], ["a", "b"])

    return exhaust


def _single_nodes(batches):
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        path = table.column("path").to_numpy()
        cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1)]
        for x, y in zip(cuts, cuts[1:]):
            yield table.slice(x, y - x).combine_chunks()
        held = table.slice(cuts[-1])
    if held is not None:
        yield held.combine_chunks()


def _sets(words: int):
    def make(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), words)], pa.binary())], ["id", "set"])

    return make


def _confirm(ratio: tuple[int, int]):
    def confirm(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both * ratio[1] >= ratio[0] * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    return confirm


def _if_small(df: DataFrame) -> DataFrame:
    """A stored table of keys, to be broadcast if it has at most BROADCAST_IDS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def sets_of(docs: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(id, set) of the documents (id, text) that asked names."""
    wanted = _if_small(stored(asked.select("id").distinct()))
    id_type = docs.schema["id"].dataType.simpleString()
    return stored(docs.join(wanted, "id", "left_semi").mapInArrow(_sets(words), f"id {id_type}, set binary"), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, ratio: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of ids whose full sets are similar enough. pairs: stored, distinct; docs: (id, text)."""
    if not pairs.take(1):
        return pairs
    id_type = docs.schema["id"].dataType.simpleString()
    sets = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), words)
    left, right = (sets.select(F.col("id").alias(x), F.col("set").alias("s" + x)) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    out = stored(both.mapInArrow(_confirm(ratio), f"a {id_type}, b {id_type}"))
    drop_stored(sets)
    return out


def told(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """rows with label_col, the component of id_col; its own id where labels (node, label) has none."""
    by = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return rows.join(by, rows[id_col] == by["_node"], "left").withColumn(label_col, F.coalesce("_label", id_col)).drop("_node", "_label")


def _apart(rows: DataFrame, path: str) -> DataFrame:
    """(path, m, top, others) of the places whose rows (path, label) are of several components: rows, the
    largest component and the rows of all others."""
    each = rows.groupBy(path, "label").agg(F.count("*").alias("m"))
    found = each.groupBy(path).agg(F.sum("m").alias("m"), F.max(F.struct("m", "label")).alias("most"), F.count("*").alias("labels")).filter("labels > 1")
    return found.select(path, "m", F.col("most.label").alias("top"), (F.col("m") - F.col("most.m")).alias("others"))


def _with_tree(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~TREE)).bitwiseOR(F.col("path").bitwiseAND(F.lit(TREE)))


def _blocks(rows: DataFrame, apart: DataFrame) -> DataFrame:
    """Rows of places that are apart, as (path, id, n, s0, s1, label): places of more than BLOCK rows are
    dealt out in pairs of blocks of about BLOCK rows each, all but those of the largest component alone."""
    all_ = rows.join(_if_small(apart), "path")
    small = all_.filter(F.col("m") <= BLOCK).select(*_PLACE, "label")
    count = lambda c: F.ceil(c / BLOCK).cast("int")
    minor, major = count(F.col("others")), count(F.col("m") - F.col("others"))
    is_top = F.col("label") == F.col("top")
    big = all_.filter(F.col("m") > BLOCK).select(*_PLACE, "label", is_top.alias("is_top"), minor.alias("minor"), major.alias("major"))
    big = big.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("is_top"), F.col("major")).otherwise(F.col("minor"))).cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("is_top"), F.col("minor")).otherwise(F.col("minor") + F.col("major")) - 1)
    big = big.withColumn("other", F.explode(others))
    # Blocks are numbered with the minor ones first.
    at = F.when(F.col("is_top"), F.col("own") + F.col("minor")).otherwise(F.col("own"))
    unit = _with_tree(F.xxhash64("path", F.least(at, "other"), F.greatest(at, "other")))
    return small.unionByName(big.withColumn("path", unit).select(*_PLACE, "label"))


def _merged(nodes: DataFrame) -> DataFrame:
    """(path, id, label) of the units of nodes (path, id, label, first). A group of sets that stay apart comes back in
    a unit of each tree. So units that have sets in common, directly or by others, become one group, which is dealt
    out in pairs of blocks of about BLOCK sets wherever these are no more rows, and not many more pairs, than its
    units; any two sets of a unit are together in such a pair. Other groups keep their units."""
    groups = components(nodes.select(F.col("first").alias("a"), F.col("id").alias("b")).filter("a != b"))
    units = stored(nodes.groupBy("path", "first").agg(F.count("*").alias("m")).join(groups, F.col("first") == groups.node).select("path", "m", F.col("label").alias("group")))
    each = units.groupBy("group").agg(F.sum("m").alias("rows"), F.sum(F.col("m") * F.col("m")).alias("pairs"))
    blocks = F.ceil(F.col("sets") / BLOCK).cast("int")
    held = groups.groupBy(F.col("label").alias("group")).agg(F.count("*").alias("sets")).withColumn("blocks", blocks)
    whole = (F.col("sets") * F.greatest(F.lit(1), F.col("blocks") - 1) <= F.col("rows")) & (F.col("sets") * F.col("sets") <= MORE_PAIRS * F.col("pairs"))
    chosen = stored(held.join(each, "group").select("group", "blocks", whole.alias("whole")))
    kept = stored(units.join(_if_small(stored(chosen.filter("not whole").select("group"))), "group", "left_semi").select("path"))
    own = groups.withColumnRenamed("label", "group").join(_if_small(stored(chosen.filter("whole").select("group", "blocks"))), "group")
    own = nodes.select("id", "label").distinct().join(own, F.col("id") == F.col("node"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (x != F.col("mine")) | (F.col("blocks") == 1))
    dealt = own.withColumn("mine", mine).withColumn("other", F.explode(others))
    name = F.xxhash64("group", F.least("mine", "other"), F.greatest("mine", "other")).bitwiseOR(F.lit(ALL))
    return nodes.join(_if_small(kept), "path", "left_semi").select("path", "id", "label").unionByName(dealt.select(name.alias("path"), "id", "label"))


def _searched(left: DataFrame, alone: DataFrame, texts: DataFrame, words: int, ratio: tuple[int, int]) -> DataFrame:
    """Links (a, b) that join components, from a search of the places of left (path, id, n, s0, s1, label)."""
    apart = stored(_apart(left, "path"))
    if not apart.take(1):
        return left.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    name = left.schema["id"].dataType.simpleString()
    units = f"path long, id {name}, label {name}"
    with arrow_rows(left.sparkSession, NARROW_ROWS):
        dealt = _blocks(left, apart).repartition("path").sortWithinPartitions("path", "label", "id")
        nodes = stored(dealt.mapInArrow(_open_rows(ratio), f"{units}, first {name}").distinct())
    dealt = _merged(nodes).join(alone.select("id", "n", "tokens"), "id").repartition("path").sortWithinPartitions("path", "label", "id")
    nodes = stored(dealt.mapInArrow(_alike_rows(ratio), units).distinct())
    full = nodes.join(sets_of(texts, nodes, words), "id").select("path", "id", "label", "set")
    full = full.repartition("path").sortWithinPartitions("path", "label", "id")
    return stored(full.mapInArrow(_exhaust(ratio), f"a {name}, b {name}"))


def near_groups(docs: DataFrame, words: int = 5, ratio: tuple[int, int] = (8, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the smallest id that links
    reach, its own included), kept (it is that one). Sets of `words`-word shingles are linked
    from a similarity of ratio[0] / ratio[1] on. A text without words (null, empty, white space)
    has an empty set and no link. Rows that share an id are one document with several texts:
    each is returned and their links add up. A row without an id is linked only with rows of
    the same set; alone, its component is null and it is kept. An empty table gives an empty
    result, texts may be of any length, and no other column is read, whatever its name."""
    with arrow_rows(docs.sparkSession):
        return _near_groups(docs, words, ratio, id_col, text_col)


def _near_groups(docs: DataFrame, words: int, ratio: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType
    name, field = id_type.simpleString(), T.StructField
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([field("id", id_type), field("n", T.LongType()), field("print", T.BinaryType()), field("tokens", T.BinaryType()), field("bits", T.BinaryType())])
    signed = stored(texts.mapInArrow(_signatures(words), schema))
    # Equal sets: the smallest id stands for all of them.
    same = stored(signed.filter("print is not null").groupBy("print").agg(F.min("id").alias("rep"), F.count("*").alias("m")).filter("m > 1").drop("m"))
    members = stored(signed.select("id", "n", "print").join(same, "print", "left").select("id", "n", F.coalesce("rep", "id").alias("rep")), "members")
    known = signed.filter("n > 0 and id is not null").join(same, "print", "left")
    # Rows that repeat id and set are one. Tokens travel this once: all that follows reads what is written here.
    alone = stored(known.filter("rep is null or rep = id").dropDuplicates(["print"]).select("id", "n", "print", "tokens", "bits"), "alone")
    drop_stored(signed)
    drop_stored(same)
    place = [field("path", T.LongType()), field("id", id_type), *[field(c, T.LongType()) for c in _PLACE[2:]]]
    linked = T.StructType([place[0], field("a", id_type), field("b", id_type), *place[1:], field("first", T.LongType())])

    def union(all_: list[DataFrame]) -> DataFrame:
        out = all_[0]
        for df in all_[1:]:
            out = out.unionByName(df)
        return out

    with arrow_rows(spark, NARROW_ROWS):
        rows = alone.select("id", "n", "tokens", "bits").mapInArrow(_places, T.StructType([*place, *[field(c, T.IntegerType()) for c in _NEXT]]))
        pairs, late, crowded = [], [], None
        # From the second depth on rows have the large node of depth START that they come from.
        held = lambda: [*_PLACE, *(c for c in ("first",) if c in rows.columns)]
        for depth in range(START, DEPTH + 1):
            large = stored(rows.groupBy("path").agg(F.count("*").alias("m")).filter(F.col("m") > SMALL).select("path"))
            few = [r.path for r in large.take(FEW_PATHS + 1)]
            if len(few) <= FEW_PATHS:
                within = F.col("path").isin(few)
                small, inside = rows.filter(~within) if few else rows, rows.filter(within)
            else:
                keys = _if_small(large)
                small, inside = rows.join(keys, "path", "left_anti"), rows.join(keys, "path", "left_semi")
            node = stored(small.select(held()).repartition("path").sortWithinPartitions("path", "s0", "s1", "id").mapInArrow(_small_nodes(ratio), linked))
            pairs.append(node.filter("a is not null").select("path", "a", "b"))
            late.append(node.filter("a is null").select(*_PLACE, "first"))
            if not few:
                break
            if depth == DEPTH:
                inside = stored(inside.select(held()))
                dealt = inside.select(_PLACE).repartitionByRange("path", "s0", "s1", "id").sortWithinPartitions("path", "s0", "s1", "id")
                pairs.append(stored(dealt.mapInArrow(_neighbours(ratio), T.StructType(linked.fields[:3]))))
                late.append(inside)
                break
            if depth == START:
                inside = inside.withColumn("first", F.col("path"))
            rows = stored(inside.withColumn("path", _with_tree(F.xxhash64("path", f"t{depth}"))))
            crowded = rows.select("first", *_PLACE[1:]) if depth == START else crowded
    pairs = stored(union(pairs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("path").bitwiseAND(F.lit(TREE)) >= FIRST).cast("int").alias("wave")).filter("a != b").groupBy("a", "b").agg(F.min("wave").alias("wave")))
    labels = components(confirmed(pairs.filter("wave = 0").select("a", "b"), texts, words, ratio))
    # From here on only what lies between components counts.
    rest = told(told(pairs.filter("wave = 1").select("a", "b"), labels, "a", "la"), labels, "b", "lb").filter("la != lb").select("a", "b")
    labels = extended(labels, confirmed(stored(rest), texts, words, ratio))
    late = union(late)
    if crowded is not None:
        # Large nodes of depth START that are of several components are compared themselves, if that is little: then with
        # all that became of them further down.
        open_ = _if_small(stored(_apart(told(crowded, labels, "id", "label"), "first")))
        direct, others = (open_.filter(c).select("first") for c in (F.col("others") <= DIRECT, F.col("others") > DIRECT))
        own = crowded.join(direct, "first", "left_semi").select(F.col("first").alias("path"), *_PLACE[1:])
        late = late.join(direct, "first", "left_anti").select(_PLACE).unionByName(own)
        crowded = stored(crowded.join(others, "first", "left_semi").select("first", "id")) if others.take(1) else None
    left = told(late.select(_PLACE), labels, "id", "label")
    for trees in MORE_WAVES if crowded is not None else [range(0)]:
        if len(trees):
            # Sets whose large node is still of several components.
            among = stored(told(crowded, labels, "id", "label"))
            asked = stored(among.join(_if_small(stored(_apart(among, "first").select("first"))), "first", "left_semi").select("id").distinct())
            if left is None and not asked.take(1):
                continue
            tokens = texts.join(_if_small(asked), "id", "left_semi").mapInArrow(_more_tokens(words, trees), f"id {name}, print binary, tokens binary")
            # Rows that repeat id and set have the same tokens.
            tokens = stored(tokens).dropDuplicates(["id", "print"])
            placed = told(tokens.join(alone.select("id", "n", "print", "bits"), ["id", "print"]), labels, "id", "label").select("id", "n", "tokens", "bits", "label")
            more = placed.mapInArrow(_more_places(trees), T.StructType([*place, field("label", id_type)]))
            left = more if left is None else left.unionByName(more)
        labels, left = extended(labels, _searched(stored(left, "late"), alone, texts, words, ratio)), None
    out = members.join(labels, members.rep == labels.node, "left").select("id", "n", F.coalesce("label", "rep").alias("c"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.col("id").eqNullSafe(F.col("c")).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, ratio: tuple[int, int] = (8, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one with the smallest id, of equal ids any one; rows without
    an id come last. Each row is a document of its own here, whatever its id. Texts without words (null,
    empty) are kept, and of an empty table nothing is left. Other columns stay as they are."""
    rows = with_rows(docs)
    groups = stored(near_groups(rows, words, ratio, ROW, text_col).select(ROW, F.col("component_id").alias("group")))
    return first_of_groups(rows, groups, id_col)
