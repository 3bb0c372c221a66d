"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed against each
automaton into phrases, every phrase being the longest match from where the last one ended.
With m phrases of a text of n symbols and t symbols of training text, the language costs
m * log2(t) / n bits a symbol; the cheapest one wins.

A parse restarts at the automaton's root after each phrase, so that automaton and restart
together are one look-up of (state, symbol) -> (state, whether a phrase begins), and thousands of
lanes step through it at once. A text longer than LANE symbols takes several lanes. A lane starts as if a
phrase began there; then it is parsed again from the state in which the lane before it has ended, up to
the first place where both parses begin a phrase, as they are the same from there on. So a text has
the phrases that one parse from end to end gives, whatever its length.

Each language has an alphabet of its own. The look-up is a table of all states and symbols up to
DENSE_BYTES, else a hash table of the automaton's own transitions, of which there are at most three for each
symbol of training text.

The training text is bounded: rows of at most ROW_CHARS characters, about TRAIN_ROWS of each of the LANGUAGES
most frequent languages, chosen by a hash of the id. Their whole texts are taken until a language has SYMBOLS.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



#: Bounds of the training text (see above).
LANGUAGES, TRAIN_ROWS, ROW_CHARS, SYMBOLS = 64, 64, 30_000, 50_000
DENSE_BYTES = 48 << 20
#: Symbols of a lane, lanes that step at once, and symbols of texts that are parsed at a time.
LANE, LANES, STREAM = 2_048, 16_384, 4_000_000
UNDETERMINED = "und"

_worker: dict = {}


def _letter_table() -> np.ndarray:
    """For each code point the code point of its lower case if it is a letter, else 0."""
    if "letters" not in _worker:
        table = np.zeros(sys.maxunicode + 1, np.uint32)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(s := chr(c))[0] == "L":
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _worker["letters"] = table
    return _worker["letters"]


def letters_of(text: str) -> np.ndarray:
    """The text's letters in lower case, with one 0 for whatever stands between two of them."""
    codes = _letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    between = codes == 0
    return codes[~(between & np.concatenate(([True], between[:-1])))] if len(codes) else codes


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the root."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        state = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = state
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[state] = twin
        last = state
    return step


_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """Steps of a parse against one training text. Symbol 0 is the gap, the last one of `size` any letter that
    the training text lacks. A state is the number of an automaton's state times size."""

    def __init__(self, stream: np.ndarray, dense_bytes: int = DENSE_BYTES):
        alphabet = np.unique(np.concatenate([stream, np.zeros(1, np.uint32)]))
        self.letters, self.size, self.bits = alphabet, len(alphabet) + 1, float(np.log2(len(stream) + 1))
        step = suffix_automaton(np.searchsorted(alphabet, stream).tolist())
        self.states = len(step)
        self.root = np.zeros(self.size, np.int64)
        for c, to in step[0].items():
            self.root[c] = to * self.size
        self.dense = self.keys = None
        if len(step) * self.size * 4 <= dense_bytes:
            # The lowest bit: a phrase begins with this symbol.
            self.dense = np.tile(self.root.astype(np.int32) << 1 | 1, (len(step), 1))
            for state, ways in enumerate(step[1:], 1):
                for c, to in ways.items():
                    self.dense[state, c] = (to * self.size) << 1
            self.dense = self.dense.ravel()
        else:
            count = sum(map(len, step[1:]))
            self.shift = np.uint64(64 - (2 * count).bit_length())
            self.keys, self.to = np.full(1 << int(64 - self.shift), -1, np.int64), np.zeros(1 << int(64 - self.shift), np.int64)
            for state, ways in enumerate(step[1:], 1):
                for c, to in ways.items():
                    key = state * self.size + c
                    at = (key * int(_MULTIPLY) & (1 << 64) - 1) >> int(self.shift)
                    while self.keys[at] >= 0:
                        at = (at + 1) % len(self.keys)
                    self.keys[at], self.to[at] = key, to * self.size

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at, self.size - 1).astype(np.int32)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after the symbols, and whether a phrase begins with each."""
        if self.dense is not None:
            found = self.dense[state + symbol]
            return found >> 1, (found & 1).astype(bool)
        key = state + symbol
        at = ((key.astype(np.uint64) * _MULTIPLY) >> self.shift).astype(np.int64)
        to, open_ = np.zeros(len(key), np.int64), np.arange(len(key))
        while len(open_):
            there = self.keys[at[open_]]
            hit = there == key[open_]
            to[open_[hit]] = self.to[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
            at[open_] = (at[open_] + 1) % len(self.keys)
        begins = (to == 0) | (state == 0)
        return np.where(begins, self.root[symbol], to), begins


def phrases(automaton: Automaton, docs: list[np.ndarray], lane: int = LANE) -> np.ndarray:
    """The number of phrases of each text (code points as letters_of gives them)."""
    sizes = np.array([len(d) for d in docs], np.int64)
    if not sizes.sum():
        return np.zeros(len(docs), np.int64)
    stream = automaton.symbols(np.concatenate(docs))
    lanes = -(-sizes // lane)
    owner = np.repeat(np.arange(len(docs)), lanes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))[owner] + place * lane
    length = np.minimum(lane, sizes[owner] - place * lane)
    count, last, began = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64), np.zeros(len(stream), bool)
    several = lanes[owner] > 1
    for group, noted in ((np.flatnonzero(~several), False), (np.flatnonzero(several), True)):
        for a in range(0, len(group), LANES):
            own = group[a : a + LANES]
            own = own[np.argsort(-length[own], kind="stable")]
            live = np.searchsorted(-length[own], -np.arange(length[own[0]]), "left")
            state, n_begun, first = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), begin[own]
            for t, n in enumerate(live):
                state[:n], new = automaton.step(state[:n], stream[first[:n] + t])
                n_begun[:n] += new
                if noted:
                    began[first[:n] + t] = new
            count[own], last[own] = n_begun, state
    # Later lanes once more, from the state in which the lane before has ended.
    again = np.flatnonzero(place > 0)
    more, ends = np.zeros(len(owner), np.int64), last.copy()
    while len(again):
        own, t, state = again, 0, last[again - 1].copy()
        more[again] = 0
        unlike: list[int] = []
        while len(own):
            at = begin[own] + t
            state, new = automaton.step(state, stream[at])
            more[own] += new.astype(np.int64) - began[at]
            t += 1
            met = new & began[at]
            open_ = ~met & (length[own] != t)
            end = np.where(met, ends[own], state)
            other = ~open_ & (end != last[own])
            last[own[other]] = end[other]
            unlike += [i + 1 for i in own[other].tolist() if i + 1 < len(owner) and owner[i + 1] == owner[i]]
            own, state = own[open_], state[open_]
        again = np.array(sorted(unlike), np.int64)
    return np.bincount(owner, count + more, len(docs)).astype(np.int64)


class CrossParser:
    """Parses texts against the labelled text of each language."""

    def __init__(self, texts: dict[str, list[str]], symbols: int = SYMBOLS, dense_bytes: int = DENSE_BYTES):
        self.langs, self.automata = sorted(texts), []
        for lang in self.langs:
            parts, left = [np.zeros(1, np.uint32)], symbols
            for text in texts[lang]:
                if left <= 0:
                    break
                part = letters_of(text)
                parts += [part, np.zeros(1, np.uint32)]
                left -= len(part)
            self.automata.append(Automaton(np.concatenate(parts[1:] or parts), dense_bytes))

    def costs(self, docs: list[np.ndarray]) -> np.ndarray:
        """For each text and language the bits a symbol."""
        sizes = np.array([max(1, len(d)) for d in docs])
        return np.stack([phrases(a, docs) * a.bits / sizes for a in self.automata], 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. The score is how much cheaper the best language is
        than the second, as a share of the second's cost: 0 to 1."""
        docs = [letters_of(t or "") for t in texts]
        if not self.langs or not docs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        # Whole texts, of about STREAM symbols at a time.
        group = np.cumsum([len(d) for d in docs]) // STREAM
        cost = np.concatenate([self.costs([docs[i] for i in np.flatnonzero(group == g)]) for g in np.unique(group)])
        ranked = np.sort(cost, 1)
        score = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-12) if len(self.langs) > 1 else np.ones(len(texts))
        known = np.array([bool(d.any()) for d in docs], bool)
        return [self.langs[b] if k else UNDETERMINED for b, k in zip(cost.argmin(1), known)], np.where(known, np.clip(score, 0, 1), 0.0)


def training_texts(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = TRAIN_ROWS) -> dict[str, list[str]]:
    """About `rows` whole texts of each of the LANGUAGES most frequent languages, chosen by a hash of id and text
    among those of at most ROW_CHARS characters. The counts of these languages and the texts are all that
    reaches the driver."""
    fit = labelled.filter(F.length(text_col) <= ROW_CHARS).select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), F.col(id_col).alias("_id"))
    counts = fit.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(LANGUAGES).collect()
    if not counts:
        return {}
    share = labelled.sparkSession.createDataFrame([(r[0], int(min(1.0, rows / r[1]) * 1_000_000_007)) for r in counts], "_known string, _share long")
    spot = F.pmod(F.xxhash64("_id", "_text", F.lit("language")), F.lit(1_000_000_007))
    chosen = fit.withColumn("_at", spot).join(F.broadcast(share), F.col("_lang").cast("string") == F.col("_known")).filter("_at <= _share").select("_known", "_at", "_text")
    out: dict[str, list[str]] = {}
    for r in sorted(set(chosen.toLocalIterator()), key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r[2])
    return out


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, lang_pred, score, and the columns in keep. Learns from
    the rows of labelled with text and language; prediction reads the text alone. A text that
    is null or has no letter is `und` with score 0, as is every text if nothing is labelled;
    equal costs go to the first language by name. Texts are read whole, however long. Repeated rows are predicted
    each, an empty table gives an empty result, and no other column is read."""
    texts = training_texts(labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(texts)

    def predict(batches):
        if _worker.get("texts") != shared.value:
            _worker.update(texts=shared.value, parser=CrossParser(shared.value))
        parser = _worker["parser"]
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                part = batch.slice(a, 2_000)
                langs, scores = parser.predict(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names[1:], "lang_pred", "score"])

    columns = [id_col, *keep]
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in columns], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(text_col, *columns).mapInArrow(predict, schema)
