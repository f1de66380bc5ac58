"""Small corpora with the awkward cases every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [None, "", " \t\n", "one", "two words", "é" * 40, "x" * 5000, "漢字 " * 30, "A-Z Ünïcode\x0b\x0cmixed  CASE\r\n end"]


def frame(spark, rows):
    """Rows (doc_id, text) as documents, with extra columns whose names operators use themselves."""
    full = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(full, DOCS)
    names = "shard slot ids label _id node key kept hash content n a b toxic score text_sha _sha _row _first _last _doc _several _gone _n"
    for name in f"{names} row sha doc first last several gone held_out votes hits decoded _hot_0 _crowded _salt _fact_0".split():
        df = df.withColumn(name, F.lit("clash"))
    return df


def corpus(seed: int = 3, n: int = 120):
    """Documents with exact copies, near copies of a few bases, nulls, repeated rows and awkward texts."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdeflnorst", k=rnd.randint(2, 7))) for _ in range(400)]
    write = lambda k: " ".join(rnd.choices(vocabulary, k=k))
    bases = [write(rnd.randint(60, 160)) for _ in range(6)]
    texts = list(AWKWARD)
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.3:
            words = rnd.choice(bases).split()
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            texts.append(rnd.choice(["  ", " "]).join(words))
        elif kind < 0.45:
            texts.append(rnd.choice(texts))
        else:
            texts.append(write(rnd.randint(1, 120)))
    rows = list(enumerate(texts))
    return rows + [rows[12], rows[12], (None, texts[20]), (None, None), (None, "alone without an id")]
