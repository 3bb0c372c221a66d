import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests_support import brute_components
from tidewell.llm.common import stored

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    from tidewell.llm.common import documents, stored

    docs, out = documents(spark, SF), {}
    for name, stage in cp.STAGES:
        after = stored(stage(spark, docs, SF), name)
        out[name] = ({r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}, docs.columns, after.columns)
        docs = after
    return out


def test_columns_stay(stages):
    for name, (_, _, before, after) in stages.items():
        assert after == before if name != "mixture" else set(before) < set(after)


def test_quality(spark, stages):
    """Clean rows (good and not toxic) stay; poor and toxic ones go."""
    before, after, *_ = stages["quality"]
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean, poor, toxic = [i for i, x in labels.items() if x == (1, 0)], [i for i, x in labels.items() if x[0] == 0], [i for i, x in labels.items() if x[1] == 1]
    assert sum(i in after for i in clean) >= 0.98 * len(clean)
    assert sum(i in after for i in poor) <= 0.15 * len(poor) and sum(i in after for i in toxic) <= 0.3 * len(toxic)


def test_the_five_stages():
    assert [n for n, _ in cp.STAGES] == ["quality", "exact", "near", "decontaminated", "mixture"]


def test_exact(stages):
    before, after, *_ = stages["exact"]
    keep = {}
    for i, r in before.items():
        keep[r.text or ""] = max(i, keep.get(r.text or "", -1))
    assert set(after) == set(keep.values())


def test_near(stages):
    before, after, *_ = stages["near"]
    roots = brute_components([(i, r.text) for i, r in before.items()], 5, 8, 10)
    assert set(after) == set(roots.values())


def test_contamination(spark, stages):
    before, after, *_ = stages["decontaminated"]
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {i for i, r in before.items() if any(x in " ".join((r.text or "").lower().split()) for x in items)}
    assert hit and not hit & set(after) and len(set(before) - set(after)) <= len(hit) + 3


def test_mixture(stages):
    before, after, *_ = stages["mixture"]
    assert set(before) == set(after)
    total = {}
    for r in after.values():
        total[r.domain] = total.get(r.domain, 0) + r.rate * len(r.text.split())
    share = {d: n / sum(total.values()) for d, n in total.items()}
    assert all(abs(share[d] - w) < 0.02 for d, w in {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}.items())


def test_repeated_and_null_ids(spark, stages, tmp_path):
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    told = {r.doc_id for r in labels.collect()}
    final = sorted((r for i, r in stages["mixture"][1].items() if i not in told and 40 < len(r.text.split()) < 400 and r.lang == "en"), key=lambda r: r.doc_id)
    a, b, c, d = final[:4]
    item = max((r.text for r in bench.collect()), key=len)
    turned = lambda r: " ".join(r.text.split()[::-1])
    more = [(a.doc_id, a.text, a), (a.doc_id, a.text, a), (None, f"{turned(b)} {item}", b), (c.doc_id, f"{turned(c)} {item}", c), (None, turned(d), d), (None, turned(d), d)]
    more = spark.createDataFrame([(i, t, r.lang, r.source, len(t)) for i, t, r in more], docs.schema)
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    assert [r.text for r in got if r.doc_id == a.doc_id] == [a.text]
    assert [r.text for r in got if r.doc_id == c.doc_id] == [c.text]
    assert [(r.text, r.rate > 0) for r in got if r.doc_id is None] == [(turned(d), True)]
    assert len({r.doc_id for r in got}) == len(got)


def test_empty_and_odd_tables(spark, tmp_path):
    """Every stage on no rows, and on nulls, empty texts, repeated rows and columns of clashing names."""
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = [(None, None, None, None, None), (None, None, None, None, None), (1, "", None, "src1", 0), (1, "", None, "src1", 0), (2, " \n", "en", None, -5), (3, "word " * 200_000, "xx", "s", None)]
    schema = docs.schema
    few = spark.createDataFrame(odd, schema)
    for rows, least in ((docs.limit(0), 0), (few, 1)):
        now = rows.withColumn("label", F.lit("x")).withColumn("path", F.lit(1)).withColumn("rate", F.lit("mine")).withColumn("_tidewell_row", F.lit(None).cast("long")).drop("_tidewell_row")
        for name, stage in cp.STAGES:
            then = stored(stage(spark, now, str(tmp_path)))
            if name != "mixture":
                assert then.schema.simpleString() == now.schema.simpleString(), name
            assert least <= then.count() <= now.count() if name != "quality" else then.count() <= now.count(), name
            now = then if then.count() or not least else now
