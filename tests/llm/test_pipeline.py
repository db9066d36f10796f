import re

from helpers import docs
from test_packing import whole

import corpus_pipeline
from tidewheel.llm import decontamination, pii, quality, simhash


def test_stages_against_brute_force(spark, sf):
    import test_decontamination
    import test_near_copies
    import test_pii
    import test_quality
    import test_simhash

    table = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in table.collect()}
    one = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, table, sf).collect()}
    assert all(texts[d] == t and not test_quality.base(t)[-1] for d, t in one.items())
    two = {r.doc_id for r in corpus_pipeline.near_dedup(spark, table.where(table["doc_id"].isin(list(one))), sf).collect()}
    linked = {d for d, _, c in test_simhash.components([(d, test_simhash.fingerprint(t)) for d, t in one.items()]) if d == c}
    groups = set(test_near_copies.roots([(d, one[d]) for d in sorted(linked)]).values())
    assert groups <= two <= linked and len(two) <= len(groups) + 2
    three = {r.doc_id for r in corpus_pipeline.decontaminate(spark, table.where(table["doc_id"].isin(list(two))), sf).collect()}
    joined = {d: " ".join(test_decontamination.words(texts[d])) for d in two}
    assert not any(" ".join(test_decontamination.words(b)) in joined[d] for d in three for b in bench)
    assert all(any(test_decontamination.overlaps(texts[d], b) for b in bench) for d in two - three)
    four = {r.doc_id: r.text for r in corpus_pipeline.redact(spark, table.where(table["doc_id"].isin(list(three))), sf).collect()}
    for d in three:
        assert not test_pii.base(re.sub("<[A-Z]+>", " ", four[d]))
        if not pii_found(spark, texts[d]):
            assert four[d] == texts[d]
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == three
    whole(rows, four)


def pii_found(spark, text):
    return any(re.search(p.replace("++", "+").replace("*+", "*").replace(r"\G|", ""), text) for p in pii.PATTERNS.values())


def test_stages_keep_the_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "redact", "pack"]
    df = docs(spark, extra=False)
    for f in (quality.good, simhash.representatives, pii.redacted):
        assert f(df).columns == df.columns
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontamination.clean(df, bench).columns == df.columns
