import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm.decontaminate import contaminated, distance, drop_contaminated
from tidewell.llm.features import content, metadata
from tidewell.llm.mixing import mixed, mixing_rates, posteriors
from tidewell.llm.quality import _rows, combined, keep_good, log_odds, quality_scores, train, view_scores

WORDS = "alpha beta gamma delta river stone cloud paper light winter summer window garden music letter number system".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    best = min(row)
    return best, row.index(best)


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", min_size=1, max_size=90), st.text("ab c", max_size=60))
def test_distance(item, text):
    assert distance(item, text) == edit_distance(item, text)


def test_decontamination_against_brute_force(docs_of, spark):
    rnd = random.Random(2)
    items = [(i, sentence(rnd, 12)) for i in range(8)] + [(100, None), (101, "short"), (102, "")]
    rows = []
    for i in range(40):
        text = sentence(rnd, 30)
        if i % 3 == 0:
            item = list(rnd.choice(items[:8])[1])
            for _ in range(rnd.randrange(8)):
                at = rnd.randrange(len(item))
                item[at : at + rnd.randrange(2)] = rnd.choice(["", "x", "yz"])
            text = text[:40] + "\n" + "".join(item).upper() + "\t " + text[40:]
        rows.append((i, text))
    rows += [(50, None), (51, ""), (None, items[0][1]), (0, rows[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, text in rows:
        for j, item in items:
            norm = " ".join((item or "").lower().split())
            if len(norm) >= 30:
                e, _ = edit_distance(norm, " ".join((text or "").lower().split()))
                if e <= max(1, len(norm) // 16):
                    want.add((i, j, e))
    for block in (4_000_000, 200):
        got = {(r.doc_id, r.item_id, r.edits) for r in contaminated(docs_of(rows), bench, block_chars=block).collect()}
        assert got == want and any(e for _, _, e in want)
    bad = {i for i, _, _ in want}
    left = drop_contaminated(docs_of(rows), bench).collect()
    assert sorted((r.doc_id for r in left), key=repr) == sorted((i for i, _ in rows if i not in bad or i is None), key=repr)
    assert contaminated(docs_of([]), bench).count() == 0 and contaminated(docs_of(rows), bench.limit(0)).count() == 0


def test_short_items(docs_of, spark):
    bench = spark.createDataFrame([(1, "Who  am I?"), (2, "art")], "item_id long, text string")
    rows = [(1, "so: who am\ni? said"), (2, "who am it?"), (3, "party"), (4, "the ART."), (5, "party art")]
    got = sorted((r.doc_id, r.item_id, r.edits, r.start, r.end) for r in contaminated(docs_of(rows), bench).collect())
    assert got == [(1, 1, 0, 4, 13), (4, 2, 0, 4, 7), (5, 2, 0, 6, 9)]


def test_decontamination_of_long_texts_and_clashing_names(docs_of, spark):
    rnd = random.Random(4)
    item = sentence(rnd, 40)
    text = sentence(rnd, 40_000)
    rows = [(1, text), (2, text + " " + item + " " + text), (3, "\u2003".join(item.split()))]
    got = contaminated(docs_of(rows), spark.createDataFrame([(7, item), (8, "\u2003 \u2003")], "doc_id long, text string"), item_col="doc_id")
    assert got.columns == ["doc_id", "item_doc_id", "edits", "start", "end"]
    assert sorted((r.doc_id, r.item_doc_id, r.edits) for r in got.collect()) == [(2, 7, 0), (3, 7, 0)]


def quality_rows(n=200):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = sentence(rnd, rnd.randrange(20, 80)) if good else " ".join(w.upper() + "!!" for w in sentence(rnd, 30).split())
        rows.append((i, text, "en", f"src{i % 5}", len(text)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(good)))
    return rows, labels


def test_quality(docs_of, spark):
    rows, labels = quality_rows()
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (labels[0][0], labels[0][1])], "doc_id long, quality int")
    extra = [(900, None, None, None, None), (901, "", None, "src1", -1), (None, rows[1][1], "en", None, None), (1, rows[1][1], "en", "src1", 5)]
    got = quality_scores(docs_of(rows + extra), table).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    wrong = [r.doc_id for r in got if r.doc_id is not None and r.doc_id < 900 and r.keep != (r.doc_id % 4 != 0)]
    assert len(wrong) <= 2
    kept = {r.doc_id for r in keep_good(docs_of(rows), table).collect()}
    assert kept == {r.doc_id for r in quality_scores(docs_of(rows), table).collect() if r.keep}
    good = table.filter("quality = 1 and doc_id < 20")
    assert {r.score for r in quality_scores(docs_of(rows), good).collect()} == {(good.count() + 1) / (good.count() + 2)}
    assert {(r.score, r.keep) for r in quality_scores(docs_of(rows), table.limit(0)).collect()} == {(0.5, True)}
    two = quality_scores(docs_of(rows), table.filter("doc_id in (8, 9)")).collect()
    assert len({r.score for r in two}) > 2
    assert quality_scores(docs_of([]), table).count() == 0


def two_sided(n, labelled, seed=8):
    """Rows whose source and words both tell their quality, neither of them always."""
    rnd = random.Random(seed)
    rows, labels, truth = [], [], {}
    for i in range(n):
        good = rnd.random() < 0.7
        source = rnd.choice(["a", "b", "c"] if good == (rnd.random() < 0.95) else ["x", "y", "z"])
        text = "".join(rnd.choice("etaoinsh rdlu " if good == (rnd.random() < 0.8) else "zq$%#xj 0123") for _ in range(rnd.randrange(20, 60)))
        rows.append((i, text, "en", source, 500 if good else 40_000))
        truth[i] = int(good)
        if i < labelled:
            labels.append((i, int(good)))
    return rows, labels, truth


def brute_co_training(rows, rounds):
    """Plain loops over rows (key, y, text, names, size)."""
    rows = sorted(rows, key=lambda r: (r["key"], content(r["text"]).tobytes(), metadata(r["names"], r["size"]).tobytes()))
    views = [[content(r["text"]) for r in rows], [metadata(r["names"], r["size"]) for r in rows]]
    known = [i for i, r in enumerate(rows) if r["y"] is not None]
    y, own, seen = [float(rows[i]["y"]) for i in known], [[], []], {0: 0, 1: 0}
    fitted = []
    for i, c in zip(known, y):
        seen[int(c)] += 1
        if seen[int(c)] % 4:
            fitted.append((i, c))
    for turn in range(rounds + 1):
        models = []
        for v in (0, 1):
            at = fitted + own[v]
            models.append(train(np.stack([views[v][i] for i, _ in at]), np.array([c for _, c in at])))
        if turn == rounds:
            break
        taken = {i for x in own for i, _ in x}
        for v in (0, 1):
            for c in (0, 1):
                sure = []
                for i, r in enumerate(rows):
                    z = float(log_odds(views[v][i][None], models[v])[0])
                    if r["y"] is None and i not in taken and (z > 2 if c else z < -2):
                        sure.append((r["key"], i))
                own[1 - v] += [(i, float(c)) for _, i in sorted(sure)[:250]]
        own = [sorted(x) for x in own]
    both = [np.stack([views[v][i] for i in known]) for v in (0, 1)]
    told = ("models", models, combined(both, models, np.array(y)))
    return {r["key"]: s for r, s in zip(rows, view_scores([np.stack(v) for v in views], told)[2])}


def test_co_training_against_brute_force(docs_of, spark):
    rows, labels, _ = two_sided(1_200, 120)
    docs, table = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int")
    seen = [r.asDict() for r in _rows(docs, table, "doc_id", "text", ["lang", "source"], "n_chars", "quality").collect()]
    want = sorted(brute_co_training(seen, 2).values())
    got = sorted(r.score for r in quality_scores(docs, table).collect())
    assert np.allclose(got, want, atol=1e-3)


def test_rounds_lower_the_loss(docs_of, spark):
    losses = []
    for rounds in (0, 2):
        total = 0.0
        for seed in (8, 9):
            rows, labels, truth = two_sided(1_500, 40, seed)
            got = quality_scores(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int"), rounds=rounds).collect()
            total -= sum(np.log(max(1e-9, r.score if truth[r.doc_id] else 1 - r.score)) for r in got if r.doc_id >= 40)
        losses.append(total / 2920)
    print("log loss without and with rounds", losses)
    assert losses[1] < losses[0]


def test_metadata_view_reads_no_text():
    assert (metadata(("en", "a"), 5) == metadata(("en", "a"), 5)).all() and (metadata((None, "a"), None) != metadata(("en", "a"), 0)).any()


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter("doc_id % 2 = 0")
    got = quality_scores(docs, known).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r.good for r in got if r.quality == 1], [r.good for r in got if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15


def test_toxic_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality_scores(docs, labels.filter("doc_id % 2 = 0")).withColumnRenamed("toxic", "said").join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    caught, dropped = [r.said for r in got if r.toxic == 1], [r.said for r in got if r.toxic == 0]
    print(f"held out: caught {sum(caught)} of {len(caught)}, false drops {sum(dropped)} of {len(dropped)}")
    assert np.mean(caught) > 0.7 and np.mean(dropped) < 0.01


def dense_rates(n, p, goal, steps=20_000):
    """Nonnegative least squares by plain projected gradient descent."""
    a = (n[:, None] * p).T
    r = np.ones(len(n))
    size = 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(steps):
        r = np.maximum(0, r - size * a.T @ (a @ r - goal))
    return r


def test_mixing_against_dense_least_squares(docs_of, spark):
    rnd = random.Random(6)
    rows = [(i, sentence(rnd, rnd.randrange(5, 60)), "en", None, None) for i in range(30)] + [(50 + i, "".join(rnd.choice("zqxjv ") for _ in range(rnd.randrange(50, 400))), "xx", None, None) for i in range(20)]
    docs, labels = docs_of(rows), spark.createDataFrame([(i,) for i, *_ in rows], "doc_id long")
    found, domains = posteriors(docs, labels)
    got = found.orderBy("doc_id").collect()
    n, p = np.array([r.n_tokens for r in got], float), np.array([r.p for r in got])
    # The second target is beyond what the documents can give without too much of the first one.
    for targets, tokens in (({"en": 1.0, "xx": 3.0}, None), ({"en": 0.0, "xx": 1.0}, 50_000.0)):
        rates = {r.doc_id: r.rate for r in mixing_rates(docs, labels, targets, tokens).collect()}
        r = np.array([rates[x.doc_id] for x in got])
        goal = np.array([targets[d] for d in domains])
        goal = goal / goal.sum() * (n.sum() if tokens is None else tokens)
        off, best = (np.linalg.norm((x * n) @ p - goal) / np.linalg.norm(goal) for x in (r, dense_rates(n, p, goal)))
        assert (r >= 0).all() and off <= best + 2e-3, (off, best)


def test_targets_out_of_reach(docs_of, spark):
    rows = [(i, "all the same words", "en", None, None) for i in range(20)]
    labels = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    with pytest.warns(UserWarning, match="off their targets"):
        got = mixing_rates(docs_of(rows + [(30, "zq xj", "xx", None, None)]), labels.unionByName(spark.createDataFrame([(30,)], "doc_id long")), {"yy": 1.0, "en": 1.0}).collect()
    assert len(got) == 21 and all(r.rate >= 0 for r in got)


def test_mixing(docs_of, spark):
    rnd = random.Random(5)
    rows = [(i, sentence(rnd, 40), "en", None, None) for i in range(120)] + [(200 + i, "".join(rnd.choice("zqxjv ") for _ in range(200)), "xx", None, None) for i in range(30)]
    rows += [(400, None, "en", None, None), (401, "", None, None, None), (None, sentence(rnd, 5), "en", None, None)]
    labels = spark.createDataFrame([(i,) for i in range(0, 230, 2)], "doc_id long")
    got = mixing_rates(docs_of(rows), labels, {"en": 1.0, "xx": 3.0}).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 for r in got)
    total = sum(r.n_tokens for r in got)
    taken = {d: sum(r.rate * r.n_tokens for r in got if r.domain == d) for d in ("en", "xx")}
    assert abs(taken["xx"] / total - 0.75) < 0.03 and abs(taken["en"] / total - 0.25) < 0.03
    assert all(abs(r.copies - r.rate) < 1 for r in got)
    out = mixed(docs_of(rows), labels, {"en": 1.0, "xx": 3.0})
    assert {"domain", "rate", "copies"} <= set(out.columns) and out.count() == len(rows)
    assert mixing_rates(docs_of([]), labels).count() == 0
    assert mixed(docs_of([]), labels).count() == 0
    own = docs_of(rows).withColumn("rate", F.lit("mine"))
    assert dict(mixed(own, labels, {"en": 1.0, "xx": 3.0}).dtypes)["rate"] == "double"
    many = [(i, f"w{i % 90}", f"l{i % 90}", None, None) for i in range(300)]
    assert {r.domain for r in mixing_rates(docs_of(many), spark.createDataFrame([(i,) for i in range(300)], "doc_id long")).collect()} >= {"other"}
    assert {r.domain for r in mixing_rates(docs_of(rows), labels.limit(0)).collect()} == {"all"}
