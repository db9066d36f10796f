"""Plain-Python versions that the operators are held against."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def crc(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


ODD = [
    (1, ""), (2, None), (3, "one"), (4, "one two"), (5, "one two three"), (6, "one two three"), (6, "one two three"),
    (None, "no id at all, twice"), (None, "no id at all, twice"), (7, " \t\n "), (8, "é ü ß 漢字 🙂 a\x00b   c"),
    (9, "x" * 50_000), (10, "w " * 30_000), (11, "<|endoftext|> and <|im_end|>"), (12, "A b C. " * 40),
]


def docs(spark, rows=ODD, extra=True):
    """Documents with clashing extra columns."""
    rows = [(d, t, "en" if (d or 0) % 2 else None, None if d == 3 else "s", len(t or ""), 1, 2, 3, 4) for d, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket int, fp int, length int, size int")
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")
