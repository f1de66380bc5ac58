import hashlib
import importlib

import corpus_pipeline
from larderlog.llm import licenses, queries, toxicity
from tests.llm.fixtures import corpus, frame

SF = "/root/testdata/sf0.001"


def test_own_and_inherited_licences(spark):
    gpl, mit = licenses.TEMPLATES["GPL"][0], licenses.TEMPLATES["MIT"][1]
    files = [
        (1, "a/LICENSE", f"Our project\n\n{gpl}\n", True), (2, "a/b/c/x.txt", "nothing about it", False),
        (3, "a/b/LICENSE", mit, True), (4, "a/b/y.txt", None, False), (5, "a/z.txt", "Licensed under CC BY-NC 2.5.", False),
        (6, "other/x.txt", "", False), (7, None, "Released under the MIT License.", False), (8, None, "none", None),
        (9, "a/deep/x/y/z.txt", "we license nothing and public terms vary", False), (9, "a/deep/x/y/z.txt", "we license nothing and public terms vary", False),
        (10, "a/b/LICENSE", "no licence text at all", True),
    ]
    df = spark.createDataFrame([(*f, "clash") for f in files], "doc_id long, path string, text string, is_licence_file boolean, license string")
    got = sorted((r["doc_id"], r["license"], r["version"], r["via"], r["from_path"]) for r in licenses.scan_licenses(df).collect())
    assert got == sorted([
        (1, "GPL", "3", "own", "a/LICENSE"), (2, "MIT", None, "directory", "a/b/LICENSE"), (3, "MIT", None, "own", "a/b/LICENSE"),
        (4, "MIT", None, "directory", "a/b/LICENSE"), (5, "CC-BY-NC", "2.5", "own", "a/z.txt"), (6, None, None, None, None),
        (7, "MIT", None, "own", None), (8, None, None, None, None), (9, "GPL", "3", "directory", "a/LICENSE"),
        (9, "GPL", "3", "directory", "a/LICENSE"), (10, "MIT", None, "directory", "a/b/LICENSE"),
    ], key=lambda r: r[0]) or got
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_passing_over_lines_loses_none():
    m = licenses.Matcher(licenses.TEMPLATES, {t: 1 + len(t) / 9 for t in licenses.vocabulary(licenses.TEMPLATES)}, 9.0, 0.7)
    for texts in licenses.TEMPLATES.values():
        for text in texts:
            for line in (text, text.upper(), " ".join(text.split()[1:]), text + " and more"):
                v = m.vector(licenses.terms_of(line))
                full = max(sum(w * v.get(t, 0) for t, w in template.items()) for _, template in m.templates)
                assert (m.best(line)[0] is not None) == (full >= 0.7)


def test_every_document_gets_a_row(spark):
    out = licenses.op3_license_scan(spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    # Brute force: a document has a licence of its own exactly if a line names one.
    named = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("text RLIKE '(?i)(licensed under|mit license)'").collect()}
    assert {r["doc_id"] for r in out.where("via = 'own'").collect()} == named


def test_stages_keep_documents_and_take_effect(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    leak = bench.first()["text"]
    near = " ".join(f"w{i}" for i in range(80))
    rows = corpus(19) + [(3000, "your text here " + leak), (3001, near), (3002, near.replace("w40", "other")), (3003, near.replace(" ", "  "))]
    docs = frame(spark, rows)
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "encoding"]
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    clean = steps["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns and ids(clean) == ids(docs)
    once = steps["exact_dedup"](spark, docs, SF)
    assert once.columns == docs.columns and 3003 in ids(once) and 3001 not in ids(once)
    apart = steps["near_dedup"](spark, once, SF)
    assert {3002, 3003} & ids(apart) == {3002}
    safe = steps["decontamination"](spark, apart, SF)
    assert safe.columns == docs.columns and ids(apart) - ids(safe) == {3000}
    coded = steps["encoding"](spark, safe, SF)
    assert coded.count() == safe.count() and all(r["decoded"] == r["text"].replace("▁", " ") for r in coded.collect())
    for stage in steps.values():
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_toxic_documents_go(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.toxicity(spark, docs, SF.replace("0.001", "0.01")).collect()}
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").collect()
    toxic = [r["doc_id"] for r in labels if r["toxic"]]
    assert sum(i not in kept for i in toxic) >= 0.7 * len(toxic)
    assert sum(r["doc_id"] in kept for r in labels if not r["toxic"]) >= 0.98 * (len(labels) - len(toxic))


def test_every_operator_has_its_query():
    assert [f"op{n}" for n in range(1, 14)] == sorted((k.split("_")[0] for k in queries.QUERIES), key=lambda x: int(x[2:]))
    assert importlib.import_module("__spark_entry__").queries().keys() >= {*queries.QUERIES, "pipeline"}


def test_rows_without_or_with_repeated_ids_are_judged_by_their_own_text(spark):
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    insult = "you pathetic idiot moron and your worthless stupid loser scum face!!! @#$%"
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(i, text(f"d{i}")) for i in range(30)] + [(100 + i, f"{insult} {i}") for i in range(10)]
    rows += [(None, text("a")), (None, text("b")), (None, text("b")), (None, f"{insult} null"), (None, "see " + leak)]
    rows += [(7, f"{insult} seven"), (8, "look " + leak), (9, text("d1")), (9, text("e"))]
    docs = frame(spark, rows)
    steps = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in df.collect())
    rest = lambda gone: sorted((i is None, i or 0, t) for i, t in rows if not gone(i, t))
    safe = steps["decontamination"](spark, docs, SF)
    assert texts(safe) == rest(lambda i, t: leak in t)
    for stage in ("exact_dedup", "near_dedup"):
        once = texts(steps[stage](spark, docs.where(~docs.text.contains(insult)), SF))
        assert [t for n, _, t in once if n and t == text("b")] == [text("b")] and (True, 0, text("a")) in once
        assert [i for _, i, t in once if t == text("d1")] == [1] and (False, 9, text("e")) in once and (False, 9, text("d9")) in once
    judged = toxicity.toxicity_of_texts(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()
    bad = {bytes(r["text_sha"]) for r in judged}
    clean = texts(steps["toxicity"](spark, docs, SF))
    assert clean == rest(lambda i, t: hashlib.sha256(t.encode()).digest() in bad)


def test_all_kinds_of_licence_lines_are_found(spark):
    """Brute force over the five kinds of lines in the documents."""
    kinds = {"Apache": "licensed under the apache license", "CC-BY-NC": "licensed under cc by-nc", "GPL": "gnu general public license",
             "MIT": "released under the mit license", "Proprietary": "all rights reserved"}
    sf = SF.replace("0.001", "0.1")
    own = {r["doc_id"]: r["license"] for r in licenses.op3_license_scan(spark, sf).where("via IN ('own', 'reserved')").collect()}
    named = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text").collect():
        if hits := {k for k, line in kinds.items() if line in r["text"].lower()}:
            named[r["doc_id"]] = hits - {"Proprietary"} or hits
    assert own.keys() == named.keys() and all(own[i] in hits for i, hits in named.items())


def test_reserved_rights_stop_inheritance_and_yield_to_a_licence(spark):
    line = "All rights reserved."
    files = [(1, "a/LICENSE", licenses.TEMPLATES["MIT"][0], True), (2, "a/x.txt", f"Text\n{line}", False), (3, "a/y.txt", "text", False),
             (4, "b/x.txt", f"{line}\nLicensed under CC BY 3.0.", False), (5, "b/y.txt", f"Released under the ISC License.\n{line}", False),
             (6, "c/x.txt", "Licensed under CC BY-SA 4.0.", False), (7, "c/y.txt", licenses.TEMPLATES["LGPL"][1], False)]
    df = spark.createDataFrame(files, "doc_id long, path string, text string, is_licence_file boolean")
    got = {r["doc_id"]: (r["license"], r["via"]) for r in licenses.scan_licenses(df).collect()}
    assert got == {1: ("MIT", "own"), 2: ("Proprietary", "reserved"), 3: ("MIT", "directory"), 4: ("CC-BY", "own"), 5: ("ISC", "own"),
                   6: ("CC-BY-SA", "own"), 7: ("LGPL", "own")}


def test_stages_on_their_own_get_small_batches(spark):
    from larderlog.session import configure

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            stage(spark, frame(spark, corpus(7)).limit(3), SF)
            assert int(spark.conf.get(key)) == corpus_pipeline.BATCH_BYTES, name
        docs = spark.range(4000).selectExpr("id", "repeat('text ', 2000) text").coalesce(1)
        sizes = docs.mapInPandas(lambda batches: (b.assign(id=b["text"].str.len().sum())[["id"]].head(1) for b in batches), "id long")
        assert max(r["id"] for r in sizes.collect()) < 2 * corpus_pipeline.BATCH_BYTES
    finally:
        configure(spark)


def test_a_worker_remembers_nothing_of_other_tasks():
    from larderlog.llm import common, shingles

    hashed = common.lean(lambda batches: (shingles.shingle_sets(b) for b in batches))
    seen = common.lean(lambda batches: ({*common._remembered, common.remembered("pieces", lambda: "pieces")} for _ in batches), "pieces")
    common.remembered("pieces", lambda: "pieces")
    sets = list(hashed(iter([["a b c d e f"], ["a b c d e f g"]])))
    assert len(sets) == 2 and not common._remembered
    common.remembered("shingle words", dict)
    assert "shingle words" not in list(seen(iter([[1]])))[0] and set(common._remembered) == {"pieces"}
    common._remembered.clear()
