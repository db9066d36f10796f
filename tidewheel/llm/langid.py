"""Language identification by character language models.

For each language an interpolated Kneser-Ney model of character 4-grams inside words. All models share sorted arrays of n-gram
hashes, with a column for each language, so one binary search serves them all. A text goes to the language whose model gives the
lowest cross-entropy a character; `score` is that language's share of the models' likelihoods at a fixed temperature. A text whose
cross-entropy is beyond what `reject` of its language's own calibration texts reach is marked rejected; its prediction stands.

Bounded sample (parameter `per_language`): the models are fitted to about that many texts of each language, drawn by the hash of the
id, a fifth of them held back for calibration. Their gram counts are what comes to the driver. Scoring covers every whole text.

Only letters count; a text without any (null and empty ones too) is `und` with score 0, and so is every text if nothing was learned.
Ties go to the language that sorts first. Repeated rows are rows. Only id, text and lang are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import id_remainder, map_arrow, ranges, sliced

ORDER, PER_LANGUAGE, TEMPERATURE, REJECT, ALPHABET = 4, 3000, 12.0, 0.01, 1 << 16
EDGE = 1  # the character before the first letter of a word and after its last
_MULT = np.uint64(0x9E3779B97F4A7C15)


def hashes(letters: list[np.ndarray]) -> list[np.ndarray]:
    """letters: the last characters of grams, then the last but one, and so on. The hashes of the last 1, 2, ... characters."""
    out, h = [], np.zeros(len(letters[0]), dtype=np.uint64)
    for k, own in enumerate(letters):
        h = (h ^ (own.astype(np.uint64) + np.uint64(k << 32))) * _MULT
        h ^= h >> np.uint64(31)
        out.append(h | np.uint64(1))
    return out


def grams(codes: np.ndarray, start: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1..order the hash of the last k characters at each place of `codes` (words one after another, each with an edge at both ends; start: where the place's word begins). A gram that would reach before its word is padded with edges."""
    at = np.arange(len(codes))
    return hashes([np.where(at - k >= start, codes[np.maximum(at - k, 0)], EDGE) for k in range(order)])


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, the start of each place's word, and the place counts of the words (an edge, the letters, an edge)."""
    text = "\x01" + "\x01\x01".join(words) + "\x01"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    return codes, np.repeat(np.cumsum(n) - n, n), n


class Model:
    """Kneser-Ney estimates of all languages in sorted hash arrays."""

    def __init__(self, found: list[str], counts: np.ndarray, languages: list[str], order: int = ORDER):
        """counts[i, l]: how often the gram found[i] (of `order` characters, padded with edges in front) occurs in texts of language l."""
        self.languages, self.order = languages, order
        codes = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, order)
        at = hashes([codes[:, -1 - k] for k in range(order)])
        before = hashes([codes[:, -2 - k] for k in range(order - 1)])
        weight = counts.astype(np.float64)
        self.disc, self.back = [], []
        for k in range(order, 0, -1):
            keys, first, place = np.unique(at[k - 1], return_index=True, return_inverse=True)
            if k == order:
                total = np.zeros((len(keys), len(languages)))
                np.add.at(total, place, weight)
            else:  # continuation counts: in how many longer grams it ends
                total = np.zeros((len(keys), len(languages)))
                np.add.at(total, np.searchsorted(keys, self._suffix), self._seen)
            ones, twos = (total == 1).sum(axis=0), (total == 2).sum(axis=0)
            d = np.where(ones > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5)
            context = before[k - 2][first] if k > 1 else np.zeros(len(keys), dtype=np.uint64)
            heads, of = np.unique(context, return_inverse=True)
            mass, kinds = np.zeros((len(heads), len(languages))), np.zeros((len(heads), len(languages)))
            np.add.at(mass, of, total)
            np.add.at(kinds, of, (total > 0).astype(np.float64))
            safe = np.maximum(mass, 1e-9)
            self.disc.append((keys, (np.maximum(total - d, 0) / safe[of]).astype(np.float32)))
            self.back.append((heads, np.where(mass > 0, d * kinds / safe, 1.0).astype(np.float32)))
            if k > 1:
                self._suffix, self._seen = at[k - 2][first], (total > 0).astype(np.float64)
        self.disc.reverse()
        self.back.reverse()
        self._suffix = self._seen = None

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
        place = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return np.where((table[0][place] == keys)[:, None], table[1][place], np.float32(missing))

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its log probability in each language, and the number of predicted characters."""
        codes, start, n = spelled(words)
        firsts = np.cumsum(n - 1) - (n - 1)
        return np.add.reduceat(self._logs(codes, start, np.flatnonzero(ranges(n) > 0)), firsts, axis=0), n - 1

    def score_long(self, word: str, step: int = 1 << 14) -> tuple[np.ndarray, int]:
        """score() of one word, however long, in slices that overlap by order - 1 characters."""
        codes, _, _ = spelled([word])
        total = np.zeros(len(self.languages))
        for lo in range(1, len(codes), step):
            own = codes[max(0, lo - self.order + 1) : lo + step]
            total += self._logs(own, np.zeros(len(own), dtype=np.int64), np.arange(min(lo, self.order - 1), len(own))).sum(axis=0, dtype=np.float64)
        return total, len(codes) - 1

    def _logs(self, codes: np.ndarray, start: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """The log probability in each language of the characters at the places `inner`."""
        at = [h[inner] for h in grams(codes, start, self.order)]
        before = [h[inner - 1] for h in grams(codes, start, self.order - 1)]
        # a language that has seen nothing at all backs off to the alphabet
        p = self._look(self.disc[0], at[0], 0.0) + self.back[0][1][0] / ALPHABET
        for k in range(1, self.order):
            p = self._look(self.disc[k], at[k], 0.0) + self._look(self.back[k], before[k - 1], 1.0) * p
        return np.log(np.maximum(p, 1e-12))


class Scored(dict):
    """Letters of each word by its bytes ('' if it has none). Long words are not remembered."""

    most, long = 300_000, 64

    def __missing__(self, word: bytes) -> str:
        out = "".join(filter(str.isalpha, word.decode("utf-8", "replace").lower()))
        if len(word) <= 4 * self.long:
            if len(self) > self.most:
                self.clear()
            self[word] = out
        return out


def entropies(model: Model) -> callable:
    """A function from texts to their cross-entropies (texts x languages, infinite without letters). It remembers words it has scored, up to a bound."""
    letters, known, tables = Scored(), {}, []

    def run(texts: list[bytes]) -> np.ndarray:
        if len(known) > Scored.most:
            known.clear()
            tables.clear()
        each = [[x for w in t.split() if (x := letters[w])] for t in texts]
        total = np.zeros((len(texts), len(model.languages) + 1))
        for i, ws in enumerate(each):
            if ws and max(map(len, ws)) > Scored.long:
                for x in ws:
                    if len(x) > Scored.long:
                        total[i] += np.append(*model.score_long(x))
                each[i] = [x for x in ws if len(x) <= Scored.long]
        new = list({x for ws in each for x in ws if x not in known})
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            s, n = model.score(new)
            tables.append(np.concatenate([s, n[:, None]], axis=1).astype(np.float32))
            tables[:] = [np.concatenate(tables)]
        out = np.full((len(texts), len(model.languages)), np.inf)
        at = np.array([known[x] for ws in each for x in ws], dtype=np.int64)
        sizes = np.array([len(ws) for ws in each])
        if len(at):
            some = np.flatnonzero(sizes)
            firsts = (np.cumsum(sizes) - sizes)[some]
            total[some] += np.add.reduceat(tables[0][at].astype(np.float64), firsts, axis=0)
        read = total[:, -1] > 0
        out[read] = -total[read, :-1] / total[read, -1:]
        return out

    return run


def counted(words: Counter, order: int = ORDER) -> pa.RecordBatch:
    """lang, gram and n of the grams in words, counted by (language, word)."""
    out = Counter()
    for (lang, word), n in words.items():
        text = chr(EDGE) * (order - 1) + word + chr(EDGE)
        for i in range(len(word) + 1):
            out[lang, text[i : i + order]] += n
    cols = [pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()), pa.array(list(out.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["lang", "gram", "n"])


def _drawn(docs: DataFrame, where: Column, per_language: int) -> DataFrame:
    """Labelled texts, about per_language of each language, by the hash of the id; _turn is from 0 to 9,999, alike for every row of an id."""
    own = docs.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rates = {r["lang"]: min(1.0, per_language / r["n"]) for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rates:
        return own.withColumn("_turn", F.lit(0)).limit(0)
    rate = F.element_at(F.create_map(*(x for k, v in sorted(rates.items()) for x in (F.lit(k), F.lit(v)))), F.col("lang"))
    return own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000).withColumn("_turn", F.pmod(F.xxhash64("doc_id", F.lit("turn")), F.lit(10_000)))


def fitted(docs: DataFrame, where: Column, per_language: int = PER_LANGUAGE, reject: float = REJECT) -> tuple[Model | None, np.ndarray]:
    """The models of the languages in docs (doc_id, text, lang) where `where` holds, and for each the cross-entropy beyond which a text is rejected."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    drawn = _drawn(docs, where, per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, seen, held = Scored(), Counter(), 0
        for part, texts in sliced(batches, "text"):
            for lang, t in zip(part.column("lang").to_pylist(), texts, strict=True):
                own = [x for w in t.split() if (x := letters[w])]
                held += sum(n for n in map(len, own) if n > Scored.long)
                seen.update((lang, x) for x in own)
            if len(seen) > 200_000 or held > 1 << 20:
                yield counted(seen)
                seen.clear()
                held = 0
        if seen:
            yield counted(seen)

    # distinct grams of a bounded sample come to the driver, not its words
    counts = map_arrow(drawn.where("_turn >= 2000").select("lang", "text"), count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return None, np.zeros(0)
    languages = sorted(set(counts["lang"]))
    words = sorted(set(counts["gram"]))
    table = np.zeros((len(words), len(languages)))
    row, col = {w: i for i, w in enumerate(words)}, {x: i for i, x in enumerate(languages)}
    table[[row[w] for w in counts["gram"]], [col[x] for x in counts["lang"]]] = counts["n"]
    model = Model(words, table, languages)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at = entropies(sent.value), {x: i for i, x in enumerate(sent.value.languages)}
        for part, texts in sliced(batches, "text"):
            h = run(texts)
            langs = part.column("lang").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([float(h[i, at[x]]) if x in at else None for i, x in enumerate(langs)], pa.float64())], names=["lang", "h"])

    held = map_arrow(drawn.where("_turn < 2000").select("lang", "text"), own, "lang string, h double").where("h < 1e9")
    limits = {r["lang"]: r["h"] for r in held.groupBy("lang").agg(F.expr(f"percentile(h, {1 - reject})").alias("h")).collect()}
    return model, np.array([limits.get(x, np.inf) for x in languages])


def predicted(docs: DataFrame, model: Model | None, limits: np.ndarray, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy (nats a character) and rejected of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"
    sent = docs.sparkSession.sparkContext.broadcast((model, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, limits = sent.value
        of = entropies(model) if model else lambda texts: np.full((len(texts), 1), np.inf)
        languages = np.array([*(model.languages if model else []), "und"], dtype=object)
        for part, texts in sliced(batches, "text"):
            h = of(texts)
            best = h.argmin(axis=1)
            low = h[np.arange(len(h)), best]
            some = np.isfinite(low)
            share = np.zeros(len(h))
            share[some] = 1 / np.exp(-temperature * (h[some] - low[some, None])).sum(axis=1)
            far = ~some
            far[some] = low[some] > limits[best[some]] if model else True
            cols = [part.column("doc_id"), pa.array(languages[np.where(some, best, -1)], pa.string()), pa.array(share), pa.array(np.where(some, low, 0.0), mask=~some), pa.array(far)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return map_arrow(docs, run, schema)


def identified(docs: DataFrame, folds: int = 5, held: int = 0, **how) -> DataFrame:
    """predicted() of docs by models that learn from those whose id's remainder is not `held`, and held_out."""
    remainder = id_remainder(F.col("doc_id"), folds)
    model, limits = fitted(docs, remainder != held, **how)
    return predicted(docs, model, limits).withColumn("held_out", remainder == held)
