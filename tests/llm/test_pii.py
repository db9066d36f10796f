import hashlib
import re
import time

import pytest
from helpers import ODD, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        n = re.sub("[^0-9]", "", m[0])
        if 14 <= len(n) <= 19 and luhn(n):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def listed(spans):
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in spans)


def held(rows, texts):
    assert len(rows) == len(texts)
    for r, (doc, text) in zip(sorted(rows, key=lambda r: (str(r.doc_id), r.spans)), sorted(texts, key=lambda x: (str(x[0]), listed(base(x[1])))), strict=True):
        own = base(text)
        assert r.doc_id == doc
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in own) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(listed(own).encode()).hexdigest()
        found = r.spans.split(",") if r.spans else []
        assert set(listed(own).split(",")) - {""} <= set(found)
        assert [int(x.split(":")[1]) for x in found] == sorted(int(x.split(":")[1]) for x in found)


def test_whole_table(spark, sf):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held(queries.op7_pii(spark, sf).collect(), table)


HARD = [
    (20, "a@b.com+x@c.org, a.b@c-d.e.f@g.h é a@b a@b. @c.d x@y.z"),
    (21, "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.2.3 9.9.9 1.2.3.4.5"),
    (22, "4111 1111 1111 1111 and 4111-1111-1111-1112 and 12 34  56 4111111111111111 5500 0000 0000 0004 1"),
    (23, "+1 (017) 555-7713 +12 +1234567890 ++1 234 567 890 1 (a) +1 ().-. 2 +99999999999999999999"),
    (24, "🙂é a@b.co 1.1.1.1 +1 222 333 4444"),
    (25, "7" * 40_000), (26, "a" * 40_000), (27, "a." * 20_000), (28, "1." * 20_000), (29, "+1" + " " * 40_000), (30, "1 " * 20_000),
    (31, "write to jane (at) example (dot) com or call 212-555-0187 today"), (32, 'token = "04dbebab91ab85687d33eeaf04dbebab91ab8568"'),
]


def test_odd_rows(spark):
    held(pii.report(docs(spark, [*ODD, *HARD])).collect(), [*ODD, *HARD])
    assert pii.report(docs(spark, [])).collect() == []


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="a1+@.-( )4\n", max_size=40), min_size=60, max_size=60))
def test_short_texts(spark, texts):
    rows = list(enumerate(texts))
    held(pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_method_adds_spans(spark):
    rows = {r.doc_id: r.spans for r in pii.report(docs(spark, HARD)).collect()}
    assert "email:9:36" in rows[31] and "secret:0:50" in rows[32]


def test_redaction(spark):
    rows = [(1, "mail a@b.com now"), (2, None), (3, ""), (4, "plain"), (5, "+1 (212) 555-0187 and 10.0.0.1"), (None, "x@y.org")]
    df = docs(spark, rows)
    out = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert pii.redacted(df).columns == df.columns
    assert out[1].text == "mail <EMAIL> now" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "" and out[4].text == "plain"
    assert out[5].text == "<PHONE> and <IP>" and out[None].text == "<EMAIL>"


def test_many_spans(spark):
    """Thousands of spans in a text: places and redaction are right, and time grows little faster than the text."""
    def timed(n):
        text = " é ".join(f"user{k}@site{k}.org and 10.{k % 256}.0.1 or" for k in range(n))
        began = time.time()
        held(pii.report(docs(spark, [(1, text)])).collect(), [(1, text)])
        out = pii.redacted(docs(spark, [(1, text)])).first()["text"]
        assert out == " é ".join("<EMAIL> and <IP> or" for _ in range(n))
        return time.time() - began

    timed(100)
    few, many = timed(2_000), timed(16_000)
    assert many < 8 * few + 8


def test_models():
    sure, poor = 0 * 108 + (2 + 3 * 2 + 9 * 2) * 4, 0 * 108 + (0 + 3 * 0 + 9 * 0) * 4
    counts = {sure: 90, poor: 40}
    soft = pii.reliabilities(counts)
    assert soft[sure] > 0.95 and soft[poor] < 0.05
    weights = pii.classifier(counts, soft)
    score = {c: sum(weights[f] for f in pii.features(c)) for c in counts}
    assert score[sure] > 0 > score[poor]
    assert pii.decoded(sure) == (0, (1, 1, 1), 0) and pii.decoded(poor) == (0, (-1, -1, -1), 0)
    assert pii.classifier({}, {}) == [0.0] * (len(pii.KINDS) + 16)


@pytest.mark.parametrize("op", ["report", "redacted"])
def test_plan_has_no_python(spark, op):
    plan = getattr(pii, op)(docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
