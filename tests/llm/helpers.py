"""Small tables with awkward rows, and brute-force counterparts."""

import random

from pyspark.sql import functions as F

ODD = [None, "", "   \n\t", "one", "one two three four", "one two three four five", "ÀÉ ß \U0001F600 漢字", "x" * 5000, "a b c d e f " * 400]


def documents(spark, texts, sources=("s1", "s2", None), clash=True):
    """doc_id, text, lang, source, n_chars, and (``clash``) columns whose names clash but for case."""
    rows = [(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", F.lit("other").alias("TEXT"), F.lit(-1).alias("Doc_ID"), F.lit("id").alias("id")) if clash else df


def copies(seed=1, groups=12, size=6, words=80):
    """Texts in groups of near copies of differing closeness, exact copies and unrelated ones."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnop"

    def word():
        return "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))

    passage, out = [word() for _ in range(25)], []
    for g in range(groups):
        base = [word() for _ in range(words)] + (passage if g % 2 else [])
        for c in range(size):
            text = list(base)
            for _ in range(c):
                text[rng.randrange(len(text))] = word()
            out.append(" ".join(text))
        out.append(" ".join(base).upper())
    return out
