import math
import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from larderlog.llm import language_id
from tests.llm.fixtures import AWKWARD

DOCS = "doc_id long, text string, lang string"


def spelled(text):
    """Distinct n-grams by plain strings."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    words = letters.split()
    if not words:
        return set()
    line = f" {' '.join(words)} "
    return {line[i:i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1)}


def as_strings(keys):
    mask = (1 << 21) - 1
    return {"".join(chr(c) for c in (int(k) >> 42, int(k) >> 21 & mask, int(k) & mask) if c) for k in keys}


@pytest.mark.parametrize("text", [*AWKWARD, "Straße, ça va? 3x", "a" * 50 + " " * 50, "...", " ß ", "\U00010400\U0001F600b", "İ"])
def test_ngrams_against_plain_strings(text):
    for piece in (1_000_000, 7, 3, 2):
        got = language_id.ngrams_of(text, piece)
        assert as_strings(got) == spelled(text) and len(got) == len(spelled(text))


def test_weights_equal_the_explicit_kernel():
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abcdé ", k=rnd.randint(1, 60))) for _ in range(40)] + ["", "..."]
    grams = [language_id.ngrams_of(t) for t in texts]
    known, values = language_id.landmark_table(grams[:10])
    kernel = language_id.summed(grams, known, values)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:10]):
            x, y = spelled(a), spelled(b)
            assert kernel[i, j] == pytest.approx(len(x & y) / math.sqrt(max(len(x), 1) * max(len(y), 1)), abs=1e-5)
    weights = np.random.default_rng(1).standard_normal((10, 3))
    assert language_id.summed(grams, known, values @ weights) == pytest.approx(kernel @ weights, abs=1e-4)


def corpus(n=300):
    rnd = random.Random(9)
    syllables = {"xx": ["ba", "ko", "mi"], "yy": ["schu", "ler", "ung"], "zz": ["ção", "ña", "eux"]}
    rows = []
    for i in range(n):
        lang = rnd.choice(list(syllables))
        rows.append((i, " ".join("".join(rnd.choices(syllables[lang], k=3)) for _ in range(rnd.randint(1, 30))), lang))
    return rows


def clashing(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    for name in ("_sha", "_doc", "_place", "grams", "held_out", "lang_pred", "score", "row", "landmark", "cell", "_rank", "source"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_against_kernel_ridge_regression_by_hand(spark):
    rows = corpus(90)
    docs = clashing(spark, rows)
    fitted = language_id.fit_languages(docs)
    got = {r["doc_id"]: r for r in language_id.languages_of(docs, fitted).collect()}
    # All texts are few enough to be landmarks, so the regression is the exact one over all training texts.
    train = sorted({(lang, t) for i, t, lang in rows if crc32(str(i).encode()) % 4 != 2})
    sets = [spelled(t) for _, t in train]
    kernel = lambda x, y: len(x & y) / math.sqrt(len(x) * len(y))
    among = np.array([[kernel(x, y) for y in sets] for x in sets])
    langs = sorted({lang for lang, _ in train})
    y = np.array([[1.0 if lang == c else -1.0 for c in langs] for lang, _ in train])
    n = len(train)
    dual = np.linalg.lstsq(among @ among + language_id.RIDGE * n * among + 1e-9 * n * np.eye(n), among @ y, rcond=None)[0]
    for i, text, _ in rows:
        margin = np.array([kernel(spelled(text), s) for s in sets]) @ dual
        share = np.exp(language_id.SHARPNESS * (margin - margin.max()))
        assert got[i]["lang_pred"] == langs[int(margin.argmax())]
        assert got[i]["score"] == pytest.approx(1 / share.sum(), abs=1e-3)


def test_cases(spark):
    rows = corpus() + [(1000 + i, t, "xx") for i, t in enumerate([None, "", "123 ..", "komiba"])] + [
        (None, "bako miko", "xx"), (None, None, None), (5, "schuler ung", None), (7, "schulerung ung", "yy"), (7, "schulerung ung", "yy"),
    ]
    docs = clashing(spark, rows)
    got = language_id.languages_of(docs, language_id.fit_languages(docs)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[1000 + i]["lang_pred"] for i in range(4)] == ["und", "und", "und", "xx"]
    assert by_id[1000]["score"] == 0.0
    right = [by_id[i]["lang_pred"] == lang for i, _, lang in corpus() if i not in (5, 7)]
    assert sum(right) / len(right) > 0.98
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.languages_of(docs, language_id.fit_languages(nothing)).collect()} == {"und"}
    assert language_id.languages_of(docs.limit(0), language_id.fit_languages(docs.limit(0))).count() == 0


def test_held_out_rows_and_other_columns_are_not_read(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    turned = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("wrong")).otherwise(F.col("lang")))
    turned = turned.withColumn("text", F.when(language_id.held_out(), F.lit("wrong")).otherwise(F.col("text")))
    a, b = language_id.fit_languages(docs), language_id.fit_languages(turned)
    assert a.langs == b.langs and (a.known == b.known).all() and a.weights == pytest.approx(b.weights, abs=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang")
    got = language_id.op13_kernel_languages(spark, "/root/testdata/sf0.1").where("held_out").join(docs, "doc_id").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98
