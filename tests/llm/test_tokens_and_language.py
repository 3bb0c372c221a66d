import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidewell.llm.language_id import Automaton, CrossParser, identify, letters_of, phrases, suffix_automaton
from tidewell.llm.token_counts import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["It's 'tis we'll GO", "ŒUVRE ΣΑΣ İx", "a <|endoftext|> b <|startoftext|>", "a\u0085b \x1c x １２ ①", "é don't!!'s", "𝒳 abc ẞ ǅ", "", None, "ﬁ ½ x²", "été", "中文 字 ひらがな 한국어", "x" * 3000, "word " * 3000, "\t\n  \r", "'s't're", "a b c", "naïve—test…"]


def test_tokens_are_the_librarys(docs_of):
    library = Tokenizer.from_file(PATH)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "null id")]
    got = token_counts(docs_of(rows), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)


def test_another_kind_of_tokenizer(docs_of):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = token_counts(docs_of(list(enumerate(TEXTS))), path).collect()
    assert all(r.n_tokens == len(library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids) for r in got)


def test_tokens_of_no_rows(docs_of):
    assert token_counts(docs_of([]), PATH).count() == 0


def test_automaton_knows_substrings():
    s = [1, 2, 1, 1, 2, 3, 1, 2, 1]
    step = suffix_automaton(s)

    def known(x):
        state = 0
        for c in x:
            if c not in step[state]:
                return False
            state = step[state][c]
        return True

    subs = {tuple(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)}
    import itertools

    for n in range(5):
        for x in itertools.product((1, 2, 3), repeat=n):
            assert known(x) == (x in subs)


def plain_phrases(text, train):
    """Longest-match phrases, one by one."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and tuple(text[at : at + size + 1]) in train and tuple(text[at : at + size]) in train:
            size += 1
        at, n = at + size, n + 1
    return n


def substrings(stream, most=60):
    return {tuple(stream[i:j]) for i in range(len(stream)) for j in range(i + 1, min(len(stream), i + most) + 1)}


def test_phrase_counts_against_brute_force():
    texts = {"a": ["the cat sat on the mat and the dog ran"], "b": ["le chat est sur la table et le chien"]}
    tests = [letters_of(t) for t in ("the cat on la table", "chien et chat", "zzz the q", "ж the ж", "a", "")]
    for dense in (1 << 20, 0):
        parser = CrossParser(texts, dense_bytes=dense)
        for lang, automaton in zip(parser.langs, parser.automata):
            train = substrings([*letters_of(texts[lang][0]).tolist(), 0])
            assert phrases(automaton, tests).tolist() == [plain_phrases(t.tolist(), train) for t in tests], lang


def test_long_texts_have_the_phrases_of_one_parse():
    rnd = random.Random(6)
    stream = np.array([rnd.choice([1, 2, 3, 4]) for _ in range(300)] + [7] * 40 + [0], np.uint32)
    train = substrings(stream.tolist(), 400)
    docs = [np.array([rnd.choice([1, 2, 3, 4, 5]) for _ in range(n)], np.uint32) for n in (0, 1, 7, 64, 65, 500, 1_000)]
    docs += [np.full(700, 7, np.uint32), np.tile(stream[:90], 8), np.concatenate([stream, stream, np.full(300, 5, np.uint32), stream])]
    want = [plain_phrases(d.tolist(), train) for d in docs]
    for dense in (1 << 20, 0):
        automaton = Automaton(stream, dense)
        for lane in (1, 2, 8, 64, 5_000):
            assert phrases(automaton, docs, lane).tolist() == want, lane


def test_costs_and_ties():
    parser = CrossParser({"y": ["abcab"], "x": ["abcab"], "z": ["qqqqq"]})
    langs, scores = parser.predict(["abcabc", "qq", "?", None])
    assert langs == ["x", "z", "und", "und"] and scores[0] == 0 and 0 < scores[1] <= 1 and scores[2] == 0
    text = letters_of("abcabc")
    assert np.allclose(parser.costs([text])[0], [plain_phrases(text.tolist(), substrings([*letters_of("abcab").tolist(), 0])) * np.log2(7) / 6] * 2 + [np.log2(7)])


def test_tables_of_a_large_alphabet():
    rnd = random.Random(7)
    chars = [chr(0x4E00 + i) for i in range(5_000)]
    texts = {"zh": ["".join(rnd.choice(chars) for _ in range(50_000))], "en": ["the cat sat on the mat " * 30]}
    parser = CrossParser(texts)
    held = sum(x.nbytes for a in parser.automata for x in (a.dense, a.keys, getattr(a, "to", None), a.root, a.letters) if x is not None)
    assert held < 64 << 20 and parser.predict([texts["zh"][0][:300], "the mat sat"])[0] == ["zh", "en"]


def test_languages(docs_of):
    en = ["the quick brown fox jumps over the lazy dog and runs away from the house", "there is nothing that they would not have done with this other thing"]
    fr = ["le renard brun saute par dessus le chien paresseux et court vers la maison", "il ne faut pas que nous ayons cette autre chose avec les enfants"]
    rows = [(i, t, "en", None, None) for i, t in enumerate(en * 3)] + [(10 + i, t, "fr", None, None) for i, t in enumerate(fr * 3)] + [(20, None, None, None, None), (21, "12 !?", "en", None, None), (22, "", None, None, None), (23, "the dog and the fox", None, None, None), (24, "le chien et la maison", None, None, None), (None, "the other house", None, None, None)]
    docs = docs_of(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, docs.filter("doc_id < 20")).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got.values())
    assert [got[i][0] for i in (20, 21, 22, 23, 24, None)] == ["und", "und", "und", "en", "fr", "en"]
    assert {r.lang_pred for r in identify(docs, docs.filter("doc_id < 0")).collect()} == {"und"}
    assert identify(docs.filter("doc_id < 0"), docs).count() == 0


def test_held_out_accuracy(spark):
    from tidewell.llm.queries import op1_language_id

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = op1_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
