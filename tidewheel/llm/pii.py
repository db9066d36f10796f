"""Personal data by weak supervision, in DataFrame expressions only.

Candidates are spans of loose patterns. Three labelers vote on each (1 for, -1 against, 0 no vote): the strict pattern of its kind, a
gazetteer (domain endings, reserved address ranges, issuers, calling codes, key prefixes) and the words just before it.
Expectation-maximisation over the counts of vote patterns estimates, for each kind, how often a candidate is real and how reliable
each labeler is. Its posteriors are the soft labels from which a logistic span classifier is trained on votes, kind, length and
look (what stands before the span, few or mixed characters).
Spans that the strict contract patterns find always stay; the classifier adds others.

Scale: texts are searched once. What is counted has a fixed size (kind x votes x length class x look, 6,048 rows at most), so the driver fits both
models on counts over all documents, and the verdicts go back as a literal list. No row leaves its partition.

Patterns start only at the start of a run of their first characters, or where the last match ended, and take runs possessively:
what is found is the same, and a long run costs no more than its length. Positions count code points.

Defined results: null text is empty text; repeated rows are rows; an empty table gives no rows. Working columns start with _p_.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import let
from tidewheel.plans.scratch import materialize

#: Kinds in the order of the contract, then those the method adds.
KINDS = ("email", "ip", "card", "phone", "email_words", "phone_national", "secret")
LABEL = {"email_words": "email", "phone_national": "phone"}
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_words": r"(?i)\b[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++)++",
    "phone_national": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "secret": r"(?i)(?<![a-z])(?:api[_-]?key|access[_-]?key|token|secret|password)\x20?[=:]\x20?[\"']?[A-Za-z0-9_/+-]{16,}+[\"']?",
}
#: What a text must contain before a pattern is tried.
FIRST = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?){11}[0-9]", "phone": r"\+[0-9]", "email_words": r"(?i)[\[(]at[\])]", "phone_national": r"[0-9]{3}[\x20.-][0-9]{4}", "secret": r"(?i)(?:key|token|secret|password)\x20?[=:]"}
ENDINGS = "com|org|net|edu|gov|info|biz|io|co|uk|de|fr|es|it|nl|eu|us|ca|au|ch|at|be|mx|br|jp|cn|in|ru|pl|se"
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CONTEXT = {"email": "mail|contact|write|reply", "ip": "host|server|addr|login|ip", "card": "card|visa|master|amex|payment|credit|account", "phone": "phone|call|tel|fax|mobile|cell|contact", "secret": "key|token|secret|password|auth"}
AGAINST = "version|chapter|section|figure|table|isbn|page|no\\."
BEFORE, RUN, CHUNK = 32, 64, 4096
CODES = len(KINDS) * 108


def prefixes(values: Column, zero: int, op) -> Column:
    """For each of an array's values all earlier ones put together (zero for the first): within runs of RUN, and over whole runs, so that long arrays take little more time than their length."""
    empty = F.expr("CAST(array() AS array<int>)")
    fold = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(zero), op)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda b: F.slice(values, b * RUN + 1, F.lit(RUN)))

    def joined(of: Column) -> Column:
        totals = F.transform(of, lambda x: F.aggregate(x, F.lit(zero), op))
        heads = lambda t: F.transform(t, lambda _, b: fold(t, b))
        return F.flatten(let(heads(totals), lambda h: F.transform(of, lambda x, b: F.transform(x, lambda _, i: op(F.get(h, b), fold(x, i))))))

    return F.when(F.size(values) > 0, let(runs, joined)).otherwise(empty)


def spans(text: Column, kind: str) -> Column:
    """Array of (s, e, v, before): start, end and characters of each leftmost non-overlapping match, and up to BEFORE characters before it (back to the end of the match before the last)."""
    pattern = PATTERNS[kind]
    empty = F.expr("CAST(array() AS array<struct<s:int,e:int,v:string,before:string>>)")

    def placed(x: Column) -> Column:
        p, m = x["p"], x["m"]
        size = F.transform(m, lambda v, i: F.length(v) + F.length(F.get(p, i)))

        def one(v: Column, i: Column, at: Column) -> Column:
            start = F.get(at, i) + F.length(F.get(p, i))
            near = F.concat(F.when(i > 0, F.concat(F.get(p, i - 1), F.get(m, i - 1))).otherwise(""), F.get(p, i))
            return F.struct(start.alias("s"), (start + F.length(v)).alias("e"), v.alias("v"), F.right(near, F.lit(BEFORE)).alias("before"))

        return let(prefixes(size, 0, lambda a, b: a + b), lambda at: F.transform(m, lambda v, i: one(v, i, at)))

    found = let(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), placed)
    if kind == "card":  # shorter numbers are no candidates
        found = F.filter(found, lambda x: F.length(digits(x["v"])) >= 12)
    there = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(FIRST[kind])
    return F.when(there, found).otherwise(empty)


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    turned = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = turned.substr(i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + twice

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def strict(kind: str, v: Column) -> Column:
    """The pattern labeler: whether the characters keep the kind's own rules. For the first four kinds these are the contract's."""
    n = F.length(digits(v))
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    return {
        "email": F.lit(True),
        "ip": v.rlike(rf"^{part}\.{part}\.{part}\.{part}$"),
        "card": F.when(n.between(14, 19), luhn(digits(v))).otherwise(F.lit(False)),
        "phone": n.between(10, 15),
        "email_words": v.rlike(r"(?i)[\])]\x20?[a-z]{2,}$"),
        "phone_national": v.rlike(r"^\(?[2-9]"),
        "secret": v.rlike("[0-9]") & v.rlike("[A-Za-z]{2}"),
    }[kind]


def gazetteer(kind: str, v: Column) -> Column:
    """The gazetteer labeler's vote."""
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    never = F.lit(False)
    return {
        "email": vote(v.rlike(rf"(?i)\.(?:{ENDINGS})$"), v.rlike(r"[0-9-]$")),
        "ip": vote(never, v.rlike(r"^(?:0+|10|127|192\.168|169\.254|22[4-9]|2[3-5][0-9])\.")) + F.lit(0),
        "card": vote(v.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"), v.rlike("^0")),
        "phone": vote(v.rlike(CALLING), v.rlike(r"^\+0")),
        "email_words": vote(v.rlike(rf"(?i)(?:{ENDINGS})$"), never),
        "phone_national": vote(never, v.rlike(r"^\(?(?:000|555|123)")),
        "secret": vote(v.rlike(r"(?:sk-|AKIA|gh[pousr]_|xox[abp]-)|[0-9a-fA-F]{32}"), v.rlike(r"(?i)(?:xxxx|example|changeme|0000)")),
    }[kind]


def context(kind: str, before: Column) -> Column:
    """The vote of the words before the span."""
    return F.when(before.rlike(f"(?i)(?:{CONTEXT[LABEL.get(kind, kind)]})"), 1).when(before.rlike(f"(?i)(?:{AGAINST})"), -1).otherwise(0)


def look(x: Column) -> Column:
    """What no labeler says of a span, as a number from 0 to 7: whether a letter or digit stands just before it, whether it is of few different characters (a dummy), whether it has both letters and digits."""
    inside = x["before"].rlike("[A-Za-z0-9]$")
    few = F.length(x["v"]) >= 3 * F.size(F.array_distinct(F.split(x["v"].substr(F.lit(1), F.lit(64)), "")))
    mixed = x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]")
    return inside.cast("int") + 2 * few.cast("int") + 4 * mixed.cast("int")


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and _p_c, an array of the text's candidates: s, k (the kind's number), e, base (the contract's own) and code (kind, votes, length class and look as one number)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def seen(kind: str, x: Column) -> Column:
        k = KINDS.index(kind)
        ok = strict(kind, x["v"])
        votes = F.when(ok, 2).otherwise(0) + 3 * (gazetteer(kind, x["v"]) + 1) + 9 * (context(kind, x["before"]) + 1)
        size = F.when(F.length(x["v"]) < 12, 0).when(F.length(x["v"]) < 18, 1).when(F.length(x["v"]) < 30, 2).otherwise(3)
        return F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), (ok if k < 4 else F.lit(False)).alias("base"), (k * 108 + votes * 4 + size + CODES * look(x)).cast("int").alias("code"))

    def found(kind: str) -> Column:
        return F.transform(spans(text, kind), lambda x: seen(kind, x))

    each = [found(kind) for kind in KINDS]
    return docs.select(*keep, F.sort_array(F.concat(*each)).alias("_p_c"))


def decoded(code: int) -> tuple[int, tuple[int, int, int], int]:
    """Kind, the three votes and the length class of a code."""
    k, rest = divmod(code % CODES, 108)
    votes, size = divmod(rest, 4)
    return k, (votes % 3 - 1, votes // 3 % 3 - 1, votes // 9 - 1), size


def reliabilities(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """Expectation-maximisation: for each code the probability that its candidates are real. The labelers of a kind are independent given the truth; a vote against the truth starts out four times as unlikely as one for it, and that belief weighs as much as ten candidates. A real span breaks its own kind's rules at most once in fifty times: numbers that fail a checksum are look-alikes."""
    belief = {1: {1: 6.0, 0: 2.5, -1: 1.5}, 0: {1: 1.5, 0: 2.5, -1: 6.0}}
    out = {}
    for k in range(len(KINDS)):
        own = {c: n for c, n in counts.items() if decoded(c)[0] == k}
        prior, table = 0.5, {y: [{v: b / 10 for v, b in belief[y].items()} for _ in range(3)] for y in (0, 1)}
        table[1][0][-1] = 0.02
        real = {}
        for _ in range(rounds):
            for c in own:
                votes = decoded(c)[1]
                p = [math.log(q) + sum(math.log(table[y][j][v]) for j, v in enumerate(votes)) for y, q in ((0, 1 - prior), (1, prior))]
                real[c] = 1 / (1 + math.exp(max(-50.0, min(50.0, p[0] - p[1]))))
            total = sum(own.values())
            prior = (5 + sum(n * real[c] for c, n in own.items())) / (10 + total)
            for y in (0, 1):
                weight = {c: n * (real[c] if y else 1 - real[c]) for c, n in own.items()}
                mass = 10 + sum(weight.values())
                for j in range(3):
                    table[y][j] = {v: (b + sum(w for c, w in weight.items() if decoded(c)[1][j] == v)) / mass for v, b in belief[y].items()}
            table[1][0][-1] = min(table[1][0][-1], 0.02)
        out |= real
    return out


def features(code: int) -> list[int]:
    """Numbers of the features that are on: the kind, each labeler's vote, the length class, and what the span looks like."""
    k, votes, size = decoded(code)
    at = len(KINDS)
    return [k, *(at + 3 * j + v + 1 for j, v in enumerate(votes)), at + 9 + size, *(at + 13 + j for j in range(3) if code // CODES >> j & 1)]


def classifier(counts: dict[int, int], soft: dict[int, float], rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> list[float]:
    """Weights of the logistic span classifier, fitted to the soft labels by gradient descent over the counted codes."""
    weights, total = [0.0] * (len(KINDS) + 16), sum(counts.values()) or 1
    for _ in range(rounds):
        step = [-ridge * w for w in weights]
        for c, n in counts.items():
            on = features(c)
            p = 1 / (1 + math.exp(-sum(weights[f] for f in on)))
            for f in on:
                step[f] += n / total * (soft[c] - p)
        weights = [w + rate * s for w, s in zip(weights, step, strict=True)]
    return weights


def detected(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns `carry` of docs, _p_base (contract spans) and _p_all (with the method's), arrays of s, k, e by start, then kind."""
    rows = materialize(candidates(docs, carry), "candidates")
    counts = {r["code"]: r["n"] for r in rows.select(F.explode("_p_c.code").alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()}
    weights = classifier(counts, reliabilities(counts))
    accepted = [c for c in counts if sum(weights[f] for f in features(c)) > 0]
    taken = F.array(*(F.lit(c) for c in accepted)) if accepted else F.expr("CAST(array() AS array<int>)")
    plain = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    base = F.transform(F.filter("_p_c", lambda x: x["base"]), plain)
    added = F.filter("_p_c", lambda x: ~x["base"] & F.array_contains(taken, x["code"]))
    # an added span that touches a contract span is part of it, not another one
    free = lambda b: F.transform(F.filter(added, lambda x: ~F.exists(b, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))), plain)
    both = rows.select(*carry, base.alias("_p_base"), F.col("_p_c"))
    return both.select(*carry, "_p_base", F.sort_array(F.concat("_p_base", free(F.col("_p_base")))).alias("_p_all"))


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(LABEL.get(k, k)) for k in KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of contract spans by kind, the digest of their list and the list of all spans."""
    rows = detected(docs, ["doc_id"])
    n = lambda kind: F.size(F.filter("_p_base", lambda x: x["k"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *(n(k) for k in KINDS[:4]), F.sha2(listed(F.col("_p_base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("_p_all")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of its texts replaced by its kind in angle brackets, and n_chars, if there, counted anew. Overlapping spans become one."""
    columns = docs.columns
    rows = detected(docs, columns)
    text = F.col("text").cast("string")
    names = F.array(*(F.lit(f"<{LABEL.get(k, k).upper()}>") for k in KINDS))

    def cut(chunks: Column, a: Column, b: Column) -> Column:
        """The characters from a to b of a text in chunks of CHUNK."""
        i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        part = lambda k, lo, n: F.coalesce(F.get(chunks, k).substr(lo + 1, n), F.lit(""))
        whole = F.concat(part(i, a % CHUNK, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), part(j, F.lit(0), b % CHUNK))
        return F.when(i == j, part(i, a % CHUNK, F.greatest(b - a, F.lit(0)))).otherwise(whole)

    def told(x: Column) -> Column:
        piece = lambda y, i: F.when(y["s"] >= F.get(x["before"], i), F.concat(cut(x["chunks"], F.get(x["before"], i), y["s"]), F.get(names, y["k"]))).otherwise("")
        return F.concat(F.array_join(F.transform("_p_all", piece), ""), cut(x["chunks"], F.array_max(F.transform("_p_all", lambda y: y["e"])), x["n"]))

    before = prefixes(F.transform("_p_all", lambda y: y["e"]), 0, lambda a, b: F.greatest(a, b))
    new = let(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks"), before.alias("before"), F.length(text).alias("n")), told)
    out = rows.withColumn("text", F.when(F.size("_p_all") > 0, new).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size("_p_all") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)
