import hashlib
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from larderlog.llm import decontamination, exact_dedup, near_dedup
from larderlog.llm.components import components
from tests.llm.fixtures import corpus, frame


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)


def _exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    return sorted(
        (str(i), str(min(g)[3]), len(g), i == min(g)[3], hashlib.sha256(n.encode()).hexdigest())
        for n, g in groups.items() for *_, i in g
    )


def _got(df):
    return sorted((str(r[0]), str(r[1]), *r[2:]) for r in df.collect())


def test_exact_groups_against_brute_force(spark):
    rows = corpus()
    assert _got(exact_dedup.exact_groups(frame(spark, rows), salts=3)) == _exact(rows)
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_exact_groups_when_chunk_hashes_clash(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "chunk_hash", lambda c: F.length(c).cast("long") % 2)
    rows = corpus(5)
    assert _got(exact_dedup.exact_groups(frame(spark, rows))) == _exact(rows)


def test_chunks_give_the_text_back_and_shift_with_it(spark):
    rnd = random.Random(2)
    text = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyzäöü", k=20000))
    cut = lambda t: [r[0] for r in spark.createDataFrame([(t,)], "t string").select(F.explode(exact_dedup.chunks_of(F.col("t")))).collect()]
    plain, shifted = cut(text), cut("insertion" + text)
    assert "".join(plain) == text and max(map(len, plain)) <= exact_dedup.MOST
    assert len(set(plain) & set(shifted)) > 0.9 * len(plain)


def _near(rows, percent):
    union, sets = Union(), [(i, shingles(t)) for i, t in rows if i is not None]
    for (i, x), (j, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            union.join(i, j)
    return {(i, len(s), union.find(i), union.find(i) == i) for i, s in sets}


@pytest.mark.parametrize(("percent", "members", "pairs"), [(85, 1024, 4), (80, 1024, 0), (85, 4, 4)])
def test_near_groups_against_brute_force(spark, monkeypatch, percent, members, pairs):
    """With four members a node, everything branches and ends in blocks; with no pair a member, all candidates are clusters."""
    monkeypatch.setattr(near_dedup, "NODE_MEMBERS", members)
    monkeypatch.setattr(near_dedup, "PAIRS_A_MEMBER", pairs)
    monkeypatch.setattr(near_dedup, "LEVELS", 2)
    rows = corpus(7)
    got = {tuple(r) for r in near_dedup.similar_groups(frame(spark, rows), percent).collect() if r["doc_id"] is not None}
    assert got == _near(rows, percent)


def test_near_rows_without_id(spark):
    base = " ".join(f"w{i}" for i in range(50))
    got = near_dedup.similar_groups(frame(spark, [(None, base), (4, base), (None, "other words than these five here"), (None, None)])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [
        ("4", "4", True), ("None", "4", False), ("None", "None", True), ("None", "None", True),
    ]
    assert near_dedup.similar_groups(frame(spark, [])).count() == 0


def test_a_hot_group_of_near_copies(spark):
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(9999)}" for _ in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rnd.randrange(200)] = f"own{i}"
        rows.append((i, " ".join(w)))
    got = near_dedup.similar_groups(frame(spark, rows + [(900 + i, f"alone {i} in a text of its own {i * i}") for i in range(9)]), 85).collect()
    assert {r["component_id"] for r in got if r["doc_id"] < 300} == {0}
    assert all(r["kept"] for r in got if r["doc_id"] >= 900)


def test_trees_reach_the_stated_recall():
    assert near_dedup.trees_for(0.85) == 10 and near_dedup.trees_for(0.8) == 12


def test_components_against_union_find(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 360)]
    union = Union()
    for x, y in links:
        union.join(x, y)
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: union.find(i) for pair in links for i in pair if len({*pair}) == 2}


def test_leaks_against_brute_force(spark):
    rnd = random.Random(6)
    items = [(k, " ".join(f"b{rnd.randrange(500)}" for _ in range(rnd.randint(6, 40)))) for k in range(20)]
    items += [(90, None), (91, "Short item"), (92, ""), (93, items[0][1])]
    rows = corpus(8)
    for k in range(30):
        w = items[rnd.randrange(20)][1].split()
        if k % 3 == 1:
            w[rnd.randrange(len(w))] = "changed"
        rows.append((1000 + k, "before it " * rnd.randint(0, 50) + " ".join(w).upper() + " and after"))
    rows += [(2000, "short ITEM"), (2001, "a short item here"), rows[-1]]
    docs = [(i, shingles(t)) for i, t in rows]
    want = {
        (i, k, len(b), len(s & b), len(s & b) / len(b))
        for i, s in docs for k, b in ((k, shingles(t)) for k, t in items) if b and len(s & b) >= 0.8 * len(b)
    }
    bench = spark.createDataFrame([(k, t, "clash") for k, t in items], "item_id long, text string, size string")
    assert {tuple(r) for r in decontamination.contaminated(frame(spark, rows), bench).collect()} == want
    assert decontamination.contaminated(frame(spark, rows), bench.limit(0)).count() == 0
    assert decontamination.contaminated(frame(spark, []), bench).count() == 0
