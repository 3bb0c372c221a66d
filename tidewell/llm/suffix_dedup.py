"""Repeated passages by a distributed merge sort of suffixes that knows common prefixes.

A byte goes when a string of LENGTH bytes that covers it also starts anywhere else. Such a
string is called a window here. Of the GRAM-byte grams inside a window, the one with the
smallest hash (the last of equal ones) is its anchor; equal windows have equal anchors at the
same distance, so it is enough to sort the suffixes that start at anchors, about one in 85,
and to look at the bytes before them as well. Nothing is lost by this choice.

1. Anchors are dealt by (hash, document); those whose hash occurs once cannot be in a repeated
   window. This keeps the sort to the repeated part of the corpus.
2. The windows of one anchor form one string: the bytes before the anchor and the suffix from
   it on. Each task sorts its suffixes, cuts them into ranges and sends each range as a
   front-coded run: for every suffix the length of the prefix that it shares with the one
   before, and the rest.
3. The runs of a range are merged by a loser tree that carries these lengths: two suffixes are
   compared only beyond what both are known to share with the last winner.
4. In the merged order the lengths cut the suffixes under an anchor into classes for each
   right part of a window; the same is done for the bytes before the anchor. Windows are equal
   when both classes are, and a window that occurs twice marks its bytes.

Equal strings of one task travel once, with their number, so a passage that a third of all
documents share is sent once by each task. Where the strings stand stays in a table of its own,
which is joined with the marks by an id of the string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import arrow_rows, partitions, stored, text_bytes

LENGTH, GRAM = 200, 32
#: Bytes that are hashed at a time, and bytes of suffixes that a task sorts at a time.
PIECE, SORTED = 1 << 18, 8 << 20
#: Ranges of suffixes for each partition, and anchors for each range that give the bounds.
RANGES, BOUND_GRAMS = 4, 20
#: Windows of a group of suffixes that are compared at a time.
CELLS = 250_000

_U = np.uint64
_POSITION = _U((1 << 20) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _gram_hashes(a: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place of a."""
    wide = np.zeros(len(a) - 7, np.uint64)
    for i in range(8):
        wide |= a[i : len(a) - 7 + i].astype(np.uint64) << _U(8 * i)
    m = len(a) - GRAM + 1
    h = wide[:m] * _U(0x9E3779B97F4A7C15)
    for j in range(8, GRAM, 8):
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9) + wide[j : j + m]
    return _mix(h)


def _window_minima(x: np.ndarray, w: int) -> np.ndarray:
    m = len(x) - w + 1
    blocks = np.concatenate([x, np.full(-len(x) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    before = np.minimum.accumulate(blocks, 1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:m], before[w - 1 : w - 1 + m])


def anchor_runs(texts: list[bytes]):
    """Yields arrays (text number, anchor, first window start, last window start, hash): each row
    is a run of consecutive windows of a text with the same anchor. A text of less than LENGTH
    bytes has none; a very long one is taken in pieces that overlap."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        a = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        lens = np.array([len(p) for _, _, p in parts])
        ends = np.cumsum(lens)
        owner = np.repeat(np.arange(len(parts)), lens)
        h = _gram_hashes(a)
        ranked = (h & ~_POSITION) | (_POSITION - np.arange(len(h), dtype=np.uint64))
        at = (_POSITION - (_window_minima(ranked, LENGTH - GRAM + 1) & _POSITION)).astype(np.int64)
        start = np.arange(len(at))
        start = start[start + LENGTH <= ends[owner[: len(at)]]]
        at, own = at[start], owner[start]
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (own[1:] != own[:-1])))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:] - 1, [len(start) - 1]))
        part = own[first]
        shift = np.array([o for _, o, _ in parts])[part] - (ends - lens)[part]
        return np.array([d for d, _, _ in parts])[part], at[first] + shift, start[first] + shift, start[last] + shift, h[at[first]]

    for d, text in enumerate(texts):
        for off in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
            piece = text[off : off + PIECE + LENGTH - 1]
            if size + len(piece) >= 2 * PIECE - LENGTH and parts:
                yield flush()
                parts, size = [], 0
            parts.append((d, off, piece))
            size += len(piece)
    if parts:
        yield flush()


def _anchors(batches):
    """(hash, document, packed run): an anchor's place in the upper bits, and in the lower 16 the distances of
    the first and the last window of its run, at most LENGTH - GRAM each."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            keys = part.column("k").to_numpy()
            for doc, at, s0, s1, h in anchor_runs(part.column("raw").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[doc]), pa.array(at << 16 | at - s0 << 8 | at - s1)], ["h", "k", "p"])


def _repeated(batches):
    """Of rows sorted by h, those whose h occurs twice. The first and last h of the task count as
    repeated, as others of them may be in the next task: that only lets more through."""
    first, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held[0], table])).combine_chunks()
        h = table.column("h").to_numpy()
        if first is None:
            first = h[0]
        same = h[1:] == h[:-1]
        twice = np.concatenate(([held is not None and held[1]], same)) | np.concatenate((same, [False])) | (h == first)
        out = table.slice(0, len(h) - 1).filter(pa.array(twice[:-1])).select(["k", "p"]).combine_chunks()
        yield from out.to_batches()
        held = (table.slice(len(h) - 1), bool(twice[-1]))
    if held is not None:
        yield from held[0].select(["k", "p"]).to_batches()


def _strings(batch):
    """(row, anchor, first window start, last window start, text) of the repeated anchors."""
    for d, (text, packed) in enumerate(zip(batch.column("raw").to_pylist(), batch.column("ps").to_pylist())):
        for x in sorted(packed):
            p = x >> 16
            yield d, p, p - (x >> 8 & 255), p - (x & 255), text


def _string_id(text: bytes, p: int, a: int, b: int) -> bytes:
    return xxhash.xxh3_128_digest(text[a : b + LENGTH] + b"%d,%d" % (p - a, p - b))


def _places(batches):
    for whole in batches:
        for x in range(0, whole.num_rows, 500):
            batch = whole.slice(x, 500)
            rows, at, ids = [], [], []
            for d, p, a, b, text in _strings(batch):
                rows.append(d)
                at.append(p)
                ids.append(_string_id(text, p, a, b))
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), batch.column("k").take(rows), batch.column("id").take(rows), pa.array(at, pa.int64())], ["sid", "k", "id", "p"])


def common_prefix(a: bytes, b: bytes, i: int = 0) -> int:
    """Length of the common prefix of a and b, of which i bytes are known."""
    n = min(len(a), len(b))
    while i < n:
        x, y = a[i : i + 64], b[i : i + 64]
        if x != y:
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return i + (m if not d else m - (d.bit_length() + 7) // 8)
        i += len(x)
    return n


def _front_code(rows: list[tuple]) -> bytes:
    """rows: sorted (suffix, bytes before, id, number, jlo, jhi) -> a run."""
    shared = [0, *(common_prefix(x[0], y[0]) for x, y in zip(rows, rows[1:]))]
    rest = [r[0][n:] for r, n in zip(rows, shared)]
    head = np.array([[n, len(x), len(r[1]), r[3], r[4], r[5]] for n, x, r in zip(shared, rest, rows)], np.int32)
    return len(rows).to_bytes(4, "little") + head.tobytes() + b"".join(r[2] for r in rows) + b"".join(x + r[1] for x, r in zip(rest, rows))


def _run(blob: bytes):
    """The rows of a run: (length shared with the row before, suffix, rest of the row)."""
    n = int.from_bytes(blob[:4], "little")
    head = np.frombuffer(blob, np.int32, 6 * n, 4).reshape(n, 6).tolist()
    ids, at, last = 4 + 24 * n, 4 + 40 * n, b""
    for i, (shared, size, before, number, lo, hi) in enumerate(head):
        last = last[:shared] + blob[at : at + size]
        at += size + before
        yield shared, last, (blob[at - before : at], blob[ids + 16 * i : ids + 16 * i + 16], number, lo, hi)


def _send(bounds: list[bytes]):
    import bisect

    def send(batches):
        held: dict[bytes, list] = {}
        size = 0

        def flush():
            ranges: dict[int, list] = {}
            rows = sorted((r[0], r[1], sid, *r[2:]) for sid, r in held.items())
            for r in rows:
                ranges.setdefault(bisect.bisect_right(bounds, r[0][:GRAM]), []).append(r)
            return pa.RecordBatch.from_arrays([pa.array([*ranges], pa.int32()), pa.array([_front_code(x) for x in ranges.values()], pa.binary())], ["range", "run"])

        for whole in batches:
            for x in range(0, whole.num_rows, 500):
                for _, p, a, b, text in _strings(whole.slice(x, 500)):
                    sid = _string_id(text, p, a, b)
                    if sid in held:
                        held[sid][2] += 1
                    else:
                        held[sid] = [text[p : b + LENGTH], text[a:p][::-1], 1, p - b, p - a]
                        size += b + LENGTH - a + 300
                if size > SORTED:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return send


def merge_runs(blobs: list[bytes]):
    """Merges runs; yields (length shared with the suffix before, suffix, rest of the row). A
    loser tree: every inner node holds the run that lost there and how much its suffix shares
    with the one that beat it."""
    runs = [_run(b) for b in blobs]
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    text: list = [b""] * leaves
    rest: list = [None] * leaves
    shared = [-1] * leaves  # with the last winner; -1: this run has ended

    def advance(r: int) -> None:
        row = next(runs[r], None) if r < len(runs) else None
        shared[r], text[r], rest[r] = row if row is not None else (-1, b"", None)

    def beats(x: int, y: int) -> int:
        """The winner of two runs; the loser's `shared` is then with the winner's suffix."""
        if shared[x] != shared[y]:
            return x if shared[x] > shared[y] else y
        if shared[x] < 0:
            return x
        n = common_prefix(text[x], text[y], shared[x])
        won, lost = (x, y) if (text[x][n : n + 1], x) < (text[y][n : n + 1], y) else (y, x)
        shared[lost] = n
        return won

    for r in range(leaves):
        advance(r)
    losers, winners = [0] * leaves, [*[0] * leaves, *range(leaves)]
    for node in range(leaves - 1, 0, -1):
        x, y = winners[2 * node], winners[2 * node + 1]
        winners[node] = won = beats(x, y)
        losers[node] = y if won == x else x
    best = winners[1] if leaves > 1 else 0
    while shared[best] >= 0:
        yield shared[best], text[best], rest[best]
        advance(best)
        node = (best + leaves) // 2
        while node:
            won = beats(best, losers[node])
            if won != best:
                best, losers[node] = won, best
            node //= 2


def repeated_windows(group: list[tuple]) -> list[tuple[bytes, int, int]]:
    """group: the merged rows under one anchor gram, (shared with the one before, suffix, (bytes
    before, id, number, jlo, jhi)). Returns (id, first, last distance) for each run of
    consecutive distances between window and anchor whose windows occur twice."""
    seen: dict[bytes, list] = {}
    low = LENGTH
    for shared, _, (before, sid, number, lo, hi) in group:
        low = min(low, shared)
        if sid in seen:
            seen[sid][1] += number
        else:
            seen[sid] = [low, number, lo, hi, before]
            low = LENGTH
    n = len(seen)
    if n == 1:
        sid, (_, number, lo, hi, _) = next(iter(seen.items()))
        return [(sid, lo, hi)] if number > 1 else []
    ids, rows = [*seen], [*seen.values()]
    right = np.array([0, *(r[0] for r in rows[1:])])
    order = sorted(range(n), key=lambda i: rows[i][4])
    left = np.array([0, *(common_prefix(rows[x][4], rows[y][4]) for x, y in zip(order, order[1:]))])
    number, lo, hi = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
    low, high = int(lo.min()), int(hi.max())
    twice = np.zeros((n, high - low + 1), bool)
    step = max(1, CELLS // n)
    for a in range(low, high + 1, step):
        j = np.arange(a, min(a + step, high + 1))
        cls = (right[:, None] < LENGTH - j).cumsum(0)
        before = np.empty_like(cls)
        before[order] = (left[:, None] < j).cumsum(0)
        valid = (lo[:, None] <= j) & (j <= hi[:, None])
        key = np.where(valid, before * (n + 1) + cls, -1 - np.arange(n)[:, None])
        by = key.argsort(0, kind="stable")
        key = np.take_along_axis(key, by, 0)
        same = key[1:] == key[:-1]
        flag = np.zeros(key.shape, bool)
        flag[1:] |= same
        flag[:-1] |= same
        out = np.zeros(key.shape, bool)
        np.put_along_axis(out, by, flag, 0)
        twice[:, a - low : a - low + len(j)] = out | (valid & (number > 1)[:, None])
    edge = np.diff(np.pad(twice, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (who, begin), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return [(ids[i], low + x, low + y - 1) for i, x, y in zip(who.tolist(), begin.tolist(), end.tolist())]


def _merge(batches):
    """Rows are sorted by range: merges the runs of each."""

    def done(blobs):
        out, group = [], []
        for row in merge_runs(blobs):
            if row[0] < GRAM and group:
                out += repeated_windows(group)
                group = []
            group.append(row)
        if group:
            out += repeated_windows(group)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ((), (), ()), (pa.binary(), pa.int32(), pa.int32()))], ["sid", "j0", "j1"])

    at, blobs = None, []
    for batch in batches:
        for r, blob in zip(batch.column("range").to_pylist(), batch.column("run").to_pylist()):
            if r != at and blobs:
                yield done(blobs)
                blobs = []
            at = r
            blobs.append(blob)
    if blobs:
        yield done(blobs)


def _bounds(b: DataFrame, ranges: int) -> list[bytes]:
    """Bounds of the ranges: quantiles of the grams at about BOUND_GRAMS anchors for each range, chosen by a hash
    among all. They decide how evenly the work is dealt and nothing else; their number grows with that of the
    ranges, not with documents or their lengths."""
    total = b.agg(F.sum(F.size("ps"))).first()[0] or 0
    share = min(1.0, BOUND_GRAMS * ranges / max(1, total))
    spot = F.pmod(F.xxhash64("k", "p"), F.lit(1_000_003))
    chosen = b.select("k", "raw", F.explode("ps").alias("p")).filter(spot <= int(share * 1_000_003))
    place = F.shiftright("p", 16).cast("int") + 1
    found = sorted({bytes(r.g) for r in chosen.select(F.substring(F.col("raw"), place, F.lit(GRAM)).alias("g")).toLocalIterator()})
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def _cut(batches):
    for batch in batches:
        removed, spans, kept = [], [], []
        for raw, found in zip(batch.column("raw").to_pylist(), batch.column("found").to_pylist()):
            merged: list[list[int]] = []
            for a, b in sorted((x["a"], x["b"]) for x in found):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            left, at = hashlib.sha256(), 0
            for a, b in merged:
                left.update(raw[at:a])
                at = b
            left.update(raw[at:])
            removed.append(sum(b - a for a, b in merged))
            spans.append([{"start": a, "end": b} for a, b in merged])
            kept.append(left.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("id"), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())], ["k", "id", "n_removed", "removed", "kept_sha256"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, removed (array of start and
    end of each maximal removed run, in bytes), kept_sha256 (of the remaining bytes). A null
    text is an empty one; texts of less than LENGTH bytes stay whole; longer ones may be
    of any length. Ids may repeat or be null (a row read twice repeats itself and goes); an empty table gives an empty
    result; no column besides the two is read."""
    with arrow_rows(docs.sparkSession):
        return _repeated_passages(docs, id_col, text_col)


def _repeated_passages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("raw")).withColumn("k", F.xxhash64("id", "raw"))
    parts = partitions(docs)
    field = T.StructField
    anchors = rows.filter(F.length("raw") >= LENGTH).select("k", "raw").mapInArrow(_anchors, "h long, k long, p long")
    twice = anchors.repartitionByRange("h", "k").sortWithinPartitions("h").mapInArrow(_repeated, "k long, p long")
    asked = twice.groupBy("k").agg(F.collect_set("p").alias("ps"))
    b = stored(rows.join(asked, "k").select("k", "id", "raw", "ps"), "repeating")
    ranges = RANGES * parts
    runs = b.mapInArrow(_send(_bounds(b, ranges)), "range int, run binary")
    marks = stored(runs.repartition("range").sortWithinPartitions("range").mapInArrow(_merge, "sid binary, j0 int, j1 int"))
    places = b.mapInArrow(_places, T.StructType([field("sid", T.BinaryType()), field("k", T.LongType()), field("id", id_type), field("p", T.LongType())]))
    found = places.join(marks, "sid").select("k", "id", F.struct((F.col("p") - F.col("j1")).alias("a"), (F.col("p") - F.col("j0") + LENGTH).alias("b")).alias("x"))
    found = found.groupBy("k", "id").agg(F.collect_set("x").alias("found"))
    hit = b.alias("b").join(found.alias("f"), (F.col("b.k") == F.col("f.k")) & F.col("b.id").eqNullSafe(F.col("f.id"))).select("b.k", "b.id", "raw", "found")
    span = T.ArrayType(T.StructType([field("start", T.LongType()), field("end", T.LongType())]))
    cut = hit.mapInArrow(_cut, T.StructType([field("k", T.LongType()), field("id", id_type), field("n_removed", T.LongType()), field("removed", span), field("kept_sha256", T.StringType())]))
    cut = stored(cut.dropDuplicates(["k", "id"]))
    base = rows.select("id", "k", F.length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("whole"))
    out = base.alias("d").join(cut.alias("c"), (F.col("d.k") == F.col("c.k")) & F.col("d.id").eqNullSafe(F.col("c.id")), "left")
    none = F.array().cast(span)
    return out.select(F.col("d.id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce("removed", none).alias("removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
