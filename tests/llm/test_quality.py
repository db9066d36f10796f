import math

import duckdb
from helpers import ODD, WORD, docs

from tidewheel.llm import quality, queries


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {i + k for own in windows.values() if len(own) > 1 for i in own for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, rep = len(words), len(inside)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n)


def held(rows, texts):
    key = lambda x: (str(x[0]), *x[1:])
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=key)
    assert got == sorted(((d, *base(t)) for d, t in texts), key=key)
    assert not any(r.base_failed and r.kept for r in rows)


MORE = [
    (20, "a b c d e f g h i"), (21, "a b c d e f g h " * 2), (22, "x " * 9), (23, "x " * 8), (24, "l one\nl one\n \n \nl two\nl one"),
    (25, ("the quick brown fox jumps over the lazy dog again and so on " * 3) + "end"), (26, "# * $ | <b> && 100% \x0b\x0c\r\n é🙂"), (27, "a b c d"),
]


def test_whole_table(spark, sf):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.op8_quality_rules(spark, sf).collect()
    held(rows, table)
    documents = duckdb.read_parquet(f"{sf}/documents.parquet")  # noqa: F841
    want = {r[0]: r[-1] for r in duckdb.sql(quality.SQL).fetchall()}
    assert {r.doc_id: r.kept for r in rows} == want
    assert 0.6 < sum(want.values()) / len(want) < 1


def named(df):
    for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"):
        df = df.withColumnRenamed(f"_q_{n}", n)
    return df


def test_odd_rows(spark):
    held(named(quality.judged(docs(spark, [*ODD, *MORE]), ["doc_id"])).collect(), [*ODD, *MORE])
    assert quality.judged(docs(spark, []), ["doc_id"]).collect() == []


def test_thresholds_follow_the_source(spark):
    """A source that is full of symbols sets its own limit; elsewhere the same text is an outlier."""
    plain, rich = "word " * 3 + "another longer text of many plain words without any marks at all in it but some variety {} {}", "word| " * 3 + "another| longer| text| of| many| plain| words| without| any| marks| at| all| in| it| but| some| variety| {} {}"
    rows = [(i, plain.format(i, i * 7), "en", "a") for i in range(80)] + [(100 + i, rich.format(i, i * 7), "en", "b") for i in range(80)] + [(500, rich.format("x", "y"), "en", "a"), (501, rich.format("x", "y"), "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.good(df).collect()}
    assert 500 not in kept and set(range(80)) <= kept and set(range(100, 180)) <= kept
    assert quality.good(df).columns == df.columns


def test_quantiles_are_near(spark):
    rows = [(i, "a" * (i + 1), "en", "s") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sketch = quality.sketches(quality.measured(df, ["lang", "source"]))
    got = {r.measure: r for r in quality.quantiles(sketch, ["lang", "source"]).collect()}["word_length"]
    for q, v in ((0.25, got.q1), (0.5, got.q2), (0.75, got.q3)):
        assert math.isclose(v, math.ceil(q * 400), rel_tol=0.0101)


def test_plan_has_no_python(spark):
    plan = quality.good(docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
