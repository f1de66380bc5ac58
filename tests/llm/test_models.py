import math
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from larderlog.llm import lm_scoring, toxicity
from tests.llm.fixtures import corpus, frame

SF = "/root/testdata/sf0.01"


def test_label_model_recovers_accuracies_and_a_correlation():
    rnd = np.random.default_rng(1)
    y = rnd.random(20000) < 0.15
    votes = np.stack([rnd.random(20000) < np.where(y, p, q) for p, q in [(0.9, 0.02), (0.7, 0.05), (0.6, 0.01), (0.5, 0.1)]], 1)
    votes = np.hstack([votes, votes[:, :1] ^ (rnd.random((20000, 1)) < 0.05)])  # the last repeats the first
    patterns, counts = np.unique((votes << np.arange(5)).sum(1), return_counts=True)
    model = toxicity.LabelModel(5).fit(patterns, counts, np.full(len(patterns), -1))
    assert abs(model.prior - 0.15) < 0.03
    assert {(4, 0), (0, 4)} & {(v, p) for v, p in enumerate(model.parent)}
    q = model.posterior((votes << np.arange(5)).sum(1))
    assert ((q > 0.5) == y).mean() > 0.96


def test_toxicity_on_held_out_rows(spark):
    scores = toxicity.op9_label_model(spark, "/root/testdata/sf0.1")
    rows = scores.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == r["toxic"] == 1 for r in rows)
    assert hit >= 0.85 * sum(r["toxic"] for r in rows)
    assert hit >= 0.9 * sum(r["predicted"] for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_cases(spark):
    rows = corpus(13) + [(5000 + i, f"you pathetic idiot number {i} and your worthless stupid face") for i in range(40)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i >= 5000), "clash") for i, _ in rows if i is not None] + [(None, 1, "x"), (7, None, "x")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(rows)
    assert all((r["predicted"] == 1) == (r["doc_id"] is not None and r["doc_id"] >= 5000) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    unlabelled = toxicity.toxicity_scores(docs, labels.limit(0)).collect()
    assert len(unlabelled) == len(rows) and all(0 <= r["score"] <= 1 for r in unlabelled)
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", (1 - labels.toxic).cast("int")).where(toxicity.held_out()).unionByName(
        labels.withColumn("toxic", labels.toxic).where(~toxicity.held_out())
    , allowMissingColumns=True)
    plain = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    other = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, turned).collect()}
    assert plain == pytest.approx(other)


def _base(rows):
    texts = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    held = lambda i: i is not None and crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in texts if not held(i) for w in ws)
    n = sum(c.values())
    return [
        (i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in ws))
        for i, ws in texts
    ]


@pytest.mark.parametrize("frequent", [lm_scoring.FREQUENT, 20])
def test_base_scores_against_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    rows = corpus(17)
    got = lm_scoring.mixing_scores(frame(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    mine = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    for a, b in zip(mine, sorted(_base(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(r["score"] < 0 for r in got)


def test_lm_of_an_empty_table_and_of_held_out_rows_alone(spark):
    assert lm_scoring.mixing_scores(frame(spark, [])).count() == 0
    held = [(i, "some words here") for i in range(60) if crc32(str(i).encode()) % 7 == 2]
    got = lm_scoring.mixing_scores(frame(spark, held)).collect()
    assert len(got) == len(held) and {r["train_tokens"] for r in got} == {0} and {r["n_known"] for r in got} == {0}


def test_training_helps_on_held_out_texts(spark):
    got = lm_scoring.op10_context_mixing(spark, SF).where("held_out").collect()
    bits = -sum(r["score"] for r in got) * math.log2(10)
    size = sum(-r["score"] * math.log2(10) / r["bits_per_byte"] for r in got)
    assert bits / size < 2.6  # bytes alone have more than four


def test_classes_tell_kinds_of_text_apart():
    rnd = np.random.default_rng(5)
    kind = rnd.integers(0, 3, 200)
    doc = np.repeat(np.arange(200), 60)
    slot = rnd.integers(0, 400, len(doc)) + 400 * kind[doc]
    prior, log_p = lm_scoring.fit_classes(doc, slot, np.ones(len(doc)))
    best = np.array([(prior + log_p[slot[doc == d]].sum(0)).argmax() for d in range(200)])
    assert all(len({*best[kind == k]} & {*best[kind != k]}) == 0 for k in range(3))


def test_pair_probabilities_are_a_distribution():
    """Over all words of one byte and their continuations no more than everything is given out."""
    rnd = np.random.default_rng(3)
    code = lm_scoring.prefix_code(rnd.integers(0, 1000, 256))
    n = len(lm_scoring.FIRST) and int(lm_scoring.FIRST[-1])
    n0, n1 = rnd.integers(0, 9, n).astype(np.float32), rnd.integers(0, 9, n).astype(np.float32)
    owners = rnd.integers(1, 3, n).astype(np.int16)
    mixer = lm_scoring.Mixer()
    short = [bytes([b]) for b in range(256) if bytes([b]).strip()]
    weights, refined = lm_scoring.Mixer.averaged([(1.0, mixer.weights, mixer.hits)])
    total = (10 ** lm_scoring.log10_of([(1, w) for w in [*short, lm_scoring.END]], code, n0, n1, owners, weights, refined)).sum()
    assert 0 < total <= 1 + 1e-9


def test_most_contexts_of_rare_words_have_a_slot():
    rnd = np.random.default_rng(11)
    words = sorted({bytes(w) for w in rnd.integers(97, 123, (30000, 7), dtype=np.uint8)})
    code = lm_scoring.prefix_code(np.bincount(np.frombuffer(b"".join(words), dtype=np.uint8), minlength=256))
    pairs = pd.DataFrame({"cls": 0, "word": words, "n": 1, "part": 0})
    table = np.zeros(-(-int(lm_scoring.FIRST[-1]) // lm_scoring.BLOCK) * lm_scoring.BLOCK, dtype=lm_scoring.SLOT)
    for r in pd.concat(lm_scoring._slot_counts(code)(iter([pairs]))).itertuples():
        table[r.block * lm_scoring.BLOCK:(r.block + 1) * lm_scoring.BLOCK] = lm_scoring._block_of(r.data)
    n0, n1, owners = (table[c] for c in ("n0", "n1", "mark"))
    _, _, slots, marks = lm_scoring.bit_events([(0, w) for w in words], code)
    known = sum(lm_scoring.looked_up(slots, marks, n0, n1, owners)) > 0
    assert known[3].mean() > 0.78 and known[4].mean() > 0.78


def test_merged_blocks_against_brute_force(monkeypatch):
    rnd = np.random.default_rng(4)
    monkeypatch.setattr(lm_scoring, "BLOCK", 300)
    parts = []
    for _ in range(5):
        p = np.zeros(300, dtype=lm_scoring.SLOT)
        p["mark"] = rnd.integers(0, 4, 300)
        p["n0"], p["n1"] = rnd.integers(0, 9, 300) * (p["mark"] > 0), rnd.integers(0, 9, 300) * (p["mark"] > 0)
        assert (lm_scoring._block_of(lm_scoring.zlib.compress(lm_scoring._columns(p))) == p).all()
        parts.append(p)
    got = lm_scoring.merged_block(parts)
    for i in range(300):
        sums = Counter()
        for p in parts:
            sums[int(p["mark"][i])] += float(p["n0"][i]) + float(p["n1"][i])
        most = max((n for m, n in sums.items() if m), default=0)
        want = min((m for m, n in sums.items() if m and n == most and n > 0), default=0)
        assert got["mark"][i] == want
        for c in ("n0", "n1"):
            assert got[c][i] == sum(p[c][i] for p in parts if want and p["mark"][i] == want)


def test_classes_are_estimated_over_all_training_texts(spark):
    texts = [f"{k}a {k}b {k}c {k}d" for k in "xyz" for _ in range(50)] + ["", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    rnd = np.random.default_rng(2)
    start = (np.zeros(lm_scoring.CLASSES), rnd.normal(-8, 2, (1 << lm_scoring.WORD_BITS, lm_scoring.CLASSES)).astype(np.float32))
    prior, log_p = lm_scoring.refined_classes(docs, start)
    docs_of, own = np.zeros(lm_scoring.CLASSES), np.zeros((1 << lm_scoring.WORD_BITS, lm_scoring.CLASSES))
    for t in texts:
        slots = [lm_scoring._SLOTS[w] for w in lm_scoring.tokens_of(t)[:-1]]
        likely = start[0] + start[1][slots].sum(0, dtype=float)
        share = np.exp(likely - likely.max())
        share /= share.sum()
        docs_of += share
        for s in slots:
            own[s] += share
    overall = (own.sum(1) + 0.01) / (own.sum() + 0.01 * len(own))
    assert np.exp(prior) == pytest.approx((docs_of + 1) / (docs_of.sum() + lm_scoring.CLASSES), rel=1e-5)
    assert log_p == pytest.approx(np.log(0.95 * own / np.maximum(own.sum(0), 1e-9) + 0.05 * overall[:, None]), abs=1e-2)
    nothing = lm_scoring.refined_classes(docs.limit(0), start)
    assert nothing[0] is start[0]


def test_scores_do_not_depend_on_the_layout(spark):
    docs = frame(spark, corpus(23))
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], round(r["score"], 3))
    one = sorted(lm_scoring.mixing_scores(docs.coalesce(1)).collect(), key=key)
    many = sorted(lm_scoring.mixing_scores(docs.repartition(7)).collect(), key=key)
    assert [r["score"] for r in one] == pytest.approx([r["score"] for r in many], rel=1e-6)


def test_copies_of_one_toxic_text_leave_the_other_terms(spark):
    rnd = np.random.default_rng(7)
    word = lambda: "".join(chr(97 + c) for c in rnd.integers(0, 26, 9))
    marks, copied = [word() for _ in range(20)], " ".join(word() for _ in range(300))
    rows = [(i, f"{word()} {marks[i % 20]} {word()}", 1) for i in range(200)]
    rows += [(1000 + i, f"{word()} {word()} {word()}", 0) for i in range(800)]
    rows += [(5000 + i, copied, 1) for i in range(1000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    terms = toxicity.mine_terms(toxicity.distinct_texts(docs, labels))
    assert {*marks} <= {*terms} and not {*copied.split()} & {*terms}


def test_every_term_with_support_and_significance_is_mined(spark):
    named = [f"{a}{b}xyz" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    rows = [(w, 1) for w in named for _ in range(5)] + [("clean", 0)] * 9000
    terms = toxicity.mine_terms(spark.createDataFrame(rows, "text string, toxic int"))
    assert {*named} <= {*terms} and "clean" not in terms


def test_the_class_is_judged_at_every_token():
    tokens = lm_scoring.tokens_of("ein kurzer Text")
    log_p = np.full((1 << lm_scoring.WORD_BITS, lm_scoring.CLASSES), -9.0, dtype=np.float32)
    log_p[lm_scoring._SLOTS[tokens[0]], 3] = -1
    log_p[lm_scoring._SLOTS[tokens[2]], 5] = 5
    assert lm_scoring._classes_of(tokens, np.zeros(lm_scoring.CLASSES), log_p) == [0, 3, 3, 5]


def _some_pairs(n=3000):
    rnd = np.random.default_rng(6)
    return sorted({(int(k), bytes(w)) for k, w in zip(rnd.integers(0, 3, n), rnd.integers(97, 101, (n, 6), dtype=np.uint8))}) + [(0, b"x" * 5000), (1, b"\n")]


def test_common_beginnings_are_predicted_once(monkeypatch):
    pairs = _some_pairs()
    code = lm_scoring.prefix_code(np.bincount(np.frombuffer(b"".join(w for _, w in pairs), dtype=np.uint8), minlength=256))
    rnd, size = np.random.default_rng(8), int(lm_scoring.FIRST[-1])
    n0, n1 = (rnd.integers(0, 9, size).astype(np.float32) for _ in "01")
    owners = rnd.integers(1, 3, size).astype(np.int16)
    weights, refined = lm_scoring.Mixer.averaged([])
    owner, bit, slots, marks = lm_scoring.bit_events(pairs, code)
    st, gate = lm_scoring._opinions(*lm_scoring.looked_up(slots, marks, n0, n1, owners))
    x = np.einsum("if,fi->f", st, weights[gate])
    p = np.clip((3 * lm_scoring._squash(x) + refined[lm_scoring._cell(x, gate)]) / 4, 1e-7, 1 - 1e-7)
    want = np.bincount(owner, weights=np.log10(np.where(bit == 1, p, 1 - p)))
    events, plain = [], lm_scoring._bits_of
    monkeypatch.setattr(lm_scoring, "_bits_of", lambda *a: events.append(len(a[0])) or plain(*a))
    assert lm_scoring.log10_of(pairs, code, n0, n1, owners, weights, refined) == pytest.approx(want, rel=1e-4)
    assert sum(events) < sum(len(w) + 1 for _, w in pairs) * 0.6


def test_counts_of_distinct_events_equal_those_of_all():
    pairs = _some_pairs()
    n = np.random.default_rng(9).integers(1, 50, len(pairs)).astype(float)
    code = lm_scoring.prefix_code(np.ones(256))
    owner, bit, slots, marks = lm_scoring.bit_events(pairs, code)
    every = Counter()
    for key, w in zip(zip(bit.tolist(), *slots.tolist(), *marks.tolist()), n[owner]):
        every[key] += w
    weight, bit, slots, marks = lm_scoring.weighted_events(pairs, n, code)
    shared = Counter()
    for key, w in zip(zip(bit.tolist(), *slots.tolist(), *marks.tolist()), weight):
        shared[key] += w
    assert shared == every and list(shared) == list(every) and len(weight) < len(owner) * 0.6


def test_runs_of_classes():
    tokens = lm_scoring.tokens_of("ein kurzer Text mit Ende")
    rnd = np.random.default_rng(3)
    model = np.zeros(lm_scoring.CLASSES), rnd.normal(-8, 2, (1 << lm_scoring.WORD_BITS, lm_scoring.CLASSES)).astype(np.float32)
    runs = lm_scoring._class_runs(tokens, *model)
    assert [(k, w) for k, words in runs for w in words] == list(zip(lm_scoring._classes_of(tokens, *model), tokens))
    assert all(a[0] != b[0] for a, b in zip(runs, runs[1:]))


def test_told_scores_are_those_of_the_pairs():
    pairs = _some_pairs(200)
    hashes, classes = lm_scoring._word_hashes([w for _, w in pairs]), np.array([c for c, _ in pairs])
    keys = lm_scoring._pair_keys(hashes, classes)
    want, predicted = np.arange(len(pairs)) * -1.0, []
    place = {p: k for k, p in enumerate(pairs)}
    predict = lambda some: predicted.extend(some) or want[[place[p] for p in some]]
    for known in (np.arange(0, len(pairs), 2), np.arange(0)):
        order = known[np.argsort(keys[known])]
        predicted.clear()
        assert (lm_scoring._told_or_predicted(pairs, hashes, (keys[order], want[order]), predict) == want).all()
        assert len(predicted) == len(pairs) - len(known)


def test_scores_are_the_same_with_and_without_told_pairs(spark, monkeypatch):
    docs = frame(spark, corpus(29))
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], round(r["score"], 3))
    told = sorted(lm_scoring.mixing_scores(docs).collect(), key=key)
    monkeypatch.setattr(lm_scoring, "FREQUENT", 1)
    alone = sorted(lm_scoring.mixing_scores(docs).collect(), key=key)
    assert [r["score"] for r in told] == pytest.approx([r["score"] for r in alone], rel=1e-9)


def test_judged_slots_say_what_their_counts_say():
    rnd = np.random.default_rng(6)
    pairs = [(int(c), w) for c, w in zip(rnd.integers(0, 8, 300), (bytes(rnd.integers(97, 103, rnd.integers(1, 9)).astype(np.uint8)) for _ in range(300)))]
    code = lm_scoring.prefix_code(np.ones(256))
    n0, n1 = (rnd.integers(0, 30, int(lm_scoring.FIRST[-1])).astype(np.float32) for _ in range(2))
    _, _, slots, marks = lm_scoring.bit_events(pairs, code)
    owners = np.zeros(len(n0), dtype=np.int16)
    owners[slots[:, ::2]] = marks[:, ::2]
    want, gate = lm_scoring._opinions(*lm_scoring.looked_up(slots, marks, n0, n1, owners))
    got, known = lm_scoring._judgements(slots, marks, lm_scoring.judged(n0, n1, owners))
    assert (got == want).all() and (known == gate).all() and 0 < (got[4] == 0).mean() < 1


def test_classes_follow_the_sums_before_each_token():
    rnd = np.random.default_rng(8)
    prior, log_p = np.log(rnd.dirichlet(np.ones(8))), rnd.normal(size=(1 << lm_scoring.WORD_BITS, 8)).round().astype(np.float32)
    for n in (1, 2, 700):
        tokens = [b"%d" % i for i in rnd.integers(0, 50, n)]
        known = log_p[[lm_scoring._SLOTS[t] for t in tokens]]
        before = prior + np.cumsum(known, axis=0, dtype=np.float64) - known
        assert (lm_scoring._likeliest(tokens, prior, log_p) == before.argmax(1)).all()


def _classifier(seed=5):
    rnd = np.random.default_rng(seed)
    return rnd.normal(-2, 1, lm_scoring.CLASSES), rnd.normal(-8, 2, (1 << lm_scoring.WORD_BITS, lm_scoring.CLASSES)).astype(np.float32)


def test_groups_of_texts_hold_the_tokens_of_each_text(monkeypatch):
    texts = [*(t for _, t in corpus(31)), None, "", " ", "\x0b A\x1cb\u0085C\xa0d \r\n", "Ä" + " b" * 30, "\u1680 \u2003x"]
    batches = pa.table({"text": texts}).to_batches(max_chunksize=50)
    prior, log_p = _classifier()
    for size, tokens, texts_at_once in ((1 << 20, 8192, 1000), (2000, 7, 3)):
        monkeypatch.setattr(lm_scoring, "GROUP", size)
        monkeypatch.setattr(lm_scoring, "TOKENS_AT_ONCE", tokens)
        monkeypatch.setattr(lm_scoring, "TEXTS_AT_ONCE", texts_at_once)
        got = []
        for group in lm_scoring.Group.of(iter(batches)):
            cls, number = np.divmod(group.pairs(prior, log_p), len(group.words))
            assert len({*group.words}) == len(group.words) and (number == group.numbers).all()
            pairs, ends = list(zip(cls.tolist(), group.words[number])), np.cumsum(group.sizes)
            got += [pairs[b - n:b] for b, n in zip(ends, group.sizes)]
        want = [(lm_scoring._classes_of(lm_scoring.tokens_of(t), prior, log_p), lm_scoring.tokens_of(t)) for t in texts]
        assert got == [list(zip(*w)) for w in want]


def test_a_task_counts_a_pair_once_for_all_its_batches():
    texts = [t for _, t in corpus(37)]
    prior, log_p = _classifier()
    want = Counter(p for t in texts for p in zip(lm_scoring._classes_of(lm_scoring.tokens_of(t), prior, log_p), lm_scoring.tokens_of(t)))
    classes = type("Shared", (), {"value": (prior, log_p)})
    rows = pa.Table.from_batches(lm_scoring._pair_counts(classes)(iter(pa.table({"text": texts}).to_batches(max_chunksize=9)))).to_pylist()
    assert len(rows) == len(want) and {(r["cls"], r["word"]): r["n"] for r in rows} == want


def test_pairs_are_told_from_a_number_of_times_on(spark, monkeypatch):
    pairs = spark.createDataFrame([(n,) for n in [9, 5, 5, 3, 3, 3, 1]], "n long")
    for most, least in ((7, 1), (6, 3), (5, 5), (3, 5), (2, 9), (1, 9), (0, 2 ** 62)):
        monkeypatch.setattr(lm_scoring, "TOLD", most)
        assert lm_scoring._least_told(pairs) == (7, least)
    assert lm_scoring._least_told(pairs.limit(0)) == (0, 2 ** 62)


def test_scores_are_the_same_when_no_pair_is_told(spark, monkeypatch):
    docs = frame(spark, corpus(41))
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], round(r["score"], 3))
    told = sorted(lm_scoring.mixing_scores(docs).collect(), key=key)
    monkeypatch.setattr(lm_scoring, "TOLD", 0)
    alone = sorted(lm_scoring.mixing_scores(docs).collect(), key=key)
    assert [r["score"] for r in told] == pytest.approx([r["score"] for r in alone], rel=1e-9)
