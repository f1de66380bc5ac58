import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from larderlog.llm import sentencepieces, token_counts
from tests.llm.fixtures import AWKWARD, corpus, frame

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    *AWKWARD, " ", "it's we'll 'second  !'s", "a<|endoftext|> b<|endoftext|>", "  lead and trail  ", "1234 5678\n\n\n x",
    "=" * 700, " " * 90 + "x" + " " * 37, "▁ mark ▁▁ ", "a b c \x1c d", "👩‍👩‍👧 emoji 🎉", "\0 nul <0x0A> <s>", "word " * 300, "ab" * 900,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)


def _documents(spark):
    return frame(spark, [*enumerate(TEXTS), *[(1000 + i if i is not None else None, t) for i, t in corpus(11)]])


@pytest.mark.parametrize("chunk", [token_counts.CHUNK, 90])
def test_counts_equal_the_library(spark, library, chunk):
    docs = _documents(spark)
    got = token_counts.count_tokens(docs, BYTE_BPE, chunk, span=3).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(library[0].encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(docs.limit(0), BYTE_BPE).count() == 0


def test_state_maps_compose_associatively(library):
    t, rnd = token_counts.transducer(BYTE_BPE), random.Random(5)
    for text in [x for x in TEXTS if x]:
        cuts = sorted(rnd.sample(range(len(text) + 1), min(3, len(text))))
        maps = [t.state_map(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]
        left = maps[0]
        for m in maps[1:]:
            left = t.compose(left, m)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = t.compose(m, right)
        assert t.finish(left) == t.finish(right) == len(library[0].encode(text, add_special_tokens=False).ids), text[:40]


@pytest.mark.parametrize("chunk", [sentencepieces.CHUNK, 90])
def test_ids_equal_the_library_and_decode_to_the_text(spark, library, chunk):
    docs = _documents(spark)
    got = sentencepieces.decode_pieces(sentencepieces.encode_pieces(docs, PIECES, chunk, span=3), PIECES).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["ids"] == library[1].encode(r["text"]), r["text"][:40]
        assert r["decoded"] == library[1].decode(r["ids"]) == r["text"].replace("▁", " ")
    at_once = sentencepieces.encode_pieces(docs, PIECES, chunk, span=3, decode=True).collect()
    assert sorted(map(str, at_once)) == sorted(map(str, got))
    assert sentencepieces.encode_pieces(docs.limit(0), PIECES).count() == 0


def test_copies_of_a_giant_text_meet_their_ids_in_parts(spark, library):
    giant = "a giant text of many words " * 9
    docs = spark.createDataFrame([(i, giant) for i in range(450)] + [(None, giant), (900, "word " * 40), (901, "x")], "doc_id long, text string")
    got = sentencepieces.encode_pieces(docs, PIECES, 90, span=2).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.collect())
    assert all(r["ids"] == library[1].encode(r["text"]) for r in got)
    assert sum(r["text"] == giant for r in got) == 451


def test_max_plus_product_is_associative():
    rnd = np.random.default_rng(2)
    x, y, z = (np.where(rnd.random((3, 3)) < 0.4, -np.inf, rnd.random((3, 3))) for _ in range(3))
    c = sentencepieces.combined
    assert np.allclose(c(c(x, y), z), c(x, c(y, z)))


def test_transfer_matrices_find_the_only_path(library):
    """Without any safe place all states of a border have to be told apart."""
    p, rnd = sentencepieces.pieces_of(PIECES), random.Random(9)
    for text in ["".join(rnd.choices("abcdeirstn", k=400)), "antidisestablishmentarianism" * 12, "=-" * 130]:
        whole = sentencepieces.SPACE_MARK + text
        parts, size = [], 61
        n = -(-len(whole) // size)
        for i in range(n):
            a, b = i * size, (i + 1) * size
            parts.append((whole[max(0, a - p.longest):a], whole[a:b], whole[b:b + p.longest], i == 0, i == n - 1))
        ms = [p.transfer(*x) for x in parts]
        ahead, behind = sentencepieces._vectors(ms, np.zeros(1), np.zeros(1))
        ids = []
        for x, m, a, b in zip(parts, ms, ahead, behind):
            best = a[:, None] + m + b[None, :]
            assert best.max() == 0
            ids += p.traced_chunk(*x, *map(int, np.unravel_index(best.argmax(), best.shape)))
        assert ids == library[1].encode(text)


def test_remembered_segments_change_memory_and_no_ids(spark):
    import public_tokenizers

    from larderlog.llm import sentencepieces
    from larderlog.llm.common import lean

    file = public_tokenizers.path("piece_bpe_32k.model")
    p = sentencepieces.Pieces(file)
    texts = [p.marked(" ".join(f"word{i * k} other{k}" for i in range(40))) for k in range(30)]
    want = [p.encode_many([t])[0] for t in texts]
    few = sentencepieces.Pieces(file)
    few.most_segments = 60
    assert [few.encode_many([t])[0] for t in texts] == want and len(few.segments) <= 60 < len(p.segments)
    batches = [[1], [2]]
    assert list(lean(lambda b: (x * 2 for x in b))(iter(batches))) == [[1, 1], [2, 2]]


def test_segments_met_first_outlive_an_overflow(library):
    p = sentencepieces.Pieces(PIECES)
    p.most_segments = 40
    texts = [f"the of and {' '.join(f'new{i}x{k}' for i in range(25))}" for k in range(4)]
    for text in [*TEXTS, *texts]:
        text = text or ""
        assert sentencepieces.unpacked_ids(p.packed_many([p.cut(text)])[0]) == library[1].encode(text) == p.encode_many([p.marked(text)])[0], text[:40]
    p = sentencepieces.Pieces(PIECES)
    p.most_segments = 40
    for text in texts:
        p.packed_many([p.cut(text)])
        assert {"the", "of", "and"} <= p.segments.keys() and len(p.segments) <= 40


def test_many_texts_are_decoded_at_once(library):
    p = sentencepieces.pieces_of(PIECES)
    ids = [library[1].encode(t or "") for t in TEXTS]
    ends = np.cumsum(list(map(len, ids))).tolist()
    assert p.decode_many(np.concatenate(ids).astype(np.int32), ends) == [library[1].decode(x) for x in ids]
