"""SentencePiece encoding and decoding by a max-plus scan.

A text is a path through a lattice of vocabulary pieces.  For a byte-pair model
the right path is the one whose neighbouring pieces all stay apart when merged
on their own, so links weigh 0 or minus infinity and the best path is unique.
The state at a place of the text is the piece that ends at or spans it.

Giant documents are cut into chunks.  A chunk's transfer matrix holds the best
weight from every state at its left border to every state at its right border;
matrices are combined in (max, +) over spans of chunks and then over spans, a
forward and a backward vector give the best state at each border, and every
chunk is traced back on its own.  Where a space follows a visible character no
piece spans and no link is forbidden, so only the text up to the first and from
the last such place of a chunk tells its states apart.  A short word between two such places
has no state to hand on; its only path is found by merging it on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few_rows, lean, remembered, settled, table, text_of, warm_join

#: Characters of a chunk; longer documents are cut.  Chunks whose matrices one task combines.
CHUNK, SPAN = 32_768, 64
#: Word segments and pairs of pieces that a task remembers.
SEGMENTS, PAIRS = 200_000, 100_000
#: Segments of so many characters have the lattice's only path from merging, which is quadratic but short.
SHORT = 64
#: Texts that a task turns into ids at a time.
TEXTS_AT_ONCE = 200
#: Chunks that are traced back at a time.
CHUNKS_AT_ONCE = 16
SPACE_MARK = "▁"
NEVER = -np.inf
NO_MERGE = (1 << 31) - 1
#: Code points, and the factor of a pair's first symbol: symbols are pieces, then letters.
_LETTERS = 0x110000
_PAIR = 1 << 22

_SEGMENT = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}]*|^[^{SPACE_MARK}]+")
_SAFE = re.compile(f"(?<=[^{SPACE_MARK}])(?={SPACE_MARK})")


class Pieces:
    """Vocabulary of a byte-pair model file and the lattice over it."""

    def __init__(self, file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        plain = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.rank = {p: model.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        as_bytes = [b""] * model.vocab_size()
        for p, i in self.ids.items():
            as_bytes[i] = p.replace(SPACE_MARK, " ").encode("utf-8")
        for b, i in enumerate(self.byte_ids):
            as_bytes[i] = bytes([b])
        self.bytes_of = np.frombuffer(b"".join(as_bytes), dtype=np.uint8)
        self.n_bytes = np.array(list(map(len, as_bytes)), dtype=np.int64)
        self.bytes_at = np.cumsum(self.n_bytes) - self.n_bytes
        self.segments: dict[str, bytes] = {}  # packed ids of a segment, by its text behind the first mark
        self.most_segments = SEGMENTS
        self._number_merges()
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging, the best score first, then the leftmost."""
        parts, rank = list(text), self.rank
        scores = [rank.get(x + y, NEVER) for x, y in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > NEVER:
            i = scores.index(best)
            parts[i] += parts.pop(i + 1)
            del scores[i]
            if i:
                scores[i - 1] = rank.get(parts[i - 1] + parts[i], NEVER)
            if i < len(scores):
                scores[i] = rank.get(parts[i] + parts[i + 1], NEVER)
        return parts

    def _number_merges(self) -> None:
        """Merges as arrays: pairs of symbols, sorted, with the rank and the symbol of what they merge to."""
        names = list(self.ids)
        symbols = {p: k for k, p in enumerate(names)}
        for c in sorted({c for p in names for c in p} - symbols.keys()):  # letters of pieces that are no piece themselves
            symbols[c] = len(symbols)
        self.piece_ids = np.array([self.ids[p] for p in names], dtype=np.int32)
        self.n_symbols = len(symbols)
        self.spelled = {k: [self.byte_ids[b] for b in p.encode("utf-8")] for p, k in symbols.items() if p not in self.ids}
        self.letters = np.arange(self.n_symbols, self.n_symbols + _LETTERS, dtype=np.int32)  # any other letter is a symbol of its own
        for p, k in symbols.items():
            if len(p) == 1:
                self.letters[ord(p)] = k
        order = {p: k for k, p in enumerate(sorted(names, key=lambda p: -self.rank[p]))}
        made = [(symbols[p[:k]] * _PAIR + symbols[p[k:]], order[p], symbols[p])
                for p in names for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        made.sort()
        self.pair_keys, self.pair_ranks, self.pair_made = (np.array(c, dtype=t) for c, t in zip(zip(*made), (np.int64, np.int32, np.int32)))

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of merging two symbols (NO_MERGE without) and the symbol that results."""
        key = left.astype(np.int64) * _PAIR + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.int32(NO_MERGE)), self.pair_made[at]

    def merged_many(self, words: list[str]) -> list[bytes]:
        """Packed ids of many short texts; each has its own merges, one a round, all words at once."""
        out = [b""] * len(words)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbol = self.letters[flat]
        word = np.repeat(np.arange(len(words), dtype=np.int32), list(map(len, words)))
        rank, made = np.full(len(symbol), NO_MERGE, dtype=np.int32), np.zeros(len(symbol), dtype=np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside], made[inside] = self._ranked(symbol[inside], symbol[inside + 1])
        while len(word):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.concatenate((first, [len(word)])))
            best = np.minimum.reduceat(rank, first)
            done = best == NO_MERGE
            if done.any():
                ended = np.repeat(done, size)
                self._keep_ids(out, word[ended], symbol[ended])
                word, symbol, rank, made = (x[~ended] for x in (word, symbol, rank, made))
                continue
            hit = np.flatnonzero(rank == np.repeat(best, size))
            at = hit[np.concatenate(([True], word[hit][1:] != word[hit][:-1]))]  # the leftmost of each word
            symbol[at] = made[at]
            stays = np.ones(len(word), dtype=bool)
            stays[at + 1] = False
            at = at - np.arange(len(at))  # places after one symbol of each earlier word is gone
            word, symbol, rank, made = (x[stays] for x in (word, symbol, rank, made))
            # The new symbol's pairs with its neighbours.
            for left in (at - 1, at):
                left = left[(left >= 0) & (left + 1 < len(word))]
                same = word[left] == word[left + 1]
                rank[left[~same]] = NO_MERGE
                left = left[same]
                rank[left], made[left] = self._ranked(symbol[left], symbol[left + 1])
            if len(word):
                rank[-1] = NO_MERGE
        return out

    def _letter_ids(self, symbol: int) -> list[int]:
        """Ids of a symbol that is no piece: the bytes of its letter."""
        known = self.spelled.get(symbol)
        return known if known is not None else [self.byte_ids[b] for b in chr(symbol - self.n_symbols).encode("utf-8", "surrogatepass")]

    def _keep_ids(self, out: list[bytes], word: np.ndarray, symbol: np.ndarray) -> None:
        known = symbol < len(self.piece_ids)
        ids = self.piece_ids[np.where(known, symbol, 0)]
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        own = word[starts].tolist()
        if not known.all():
            spelled = [self._letter_ids(x) for x in symbol[~known].tolist()]
            size = np.ones(len(ids), dtype=np.int64)
            size[~known] = list(map(len, spelled))
            starts, ids, known = (np.cumsum(size) - size)[starts], np.repeat(ids, size), np.repeat(known, size)
            ids[~known] = list(chain.from_iterable(spelled))
        data, cuts = ids.tobytes(), [*(starts * ids.itemsize).tolist(), ids.nbytes]
        for w, a, b in zip(own, cuts, cuts[1:]):
            out[w] = data[a:b]

    def learn(self, fresh: dict[str, None]) -> None:
        """Remember the ids of the short ones of new segments, in order of appearance."""
        if len(self.segments) + len(fresh) > self.most_segments:
            # Frequent segments were met first, so the first ones stay.
            room = max(0, min(self.most_segments // 2, self.most_segments - len(fresh)))
            self.segments = dict(islice(self.segments.items(), room))
        short = [s for s in fresh if len(s) < SHORT]  # a mark goes in front
        for at in range(0, len(short), 20_000):
            some = short[at:at + 20_000]
            self.segments.update(zip(some, self.merged_many([SPACE_MARK + s for s in some])))

    def packed_many(self, parts: list[list[str]]) -> list[bytes]:
        """Packed ids of several texts, given as ``cut`` gives them; segments that are new are merged together."""
        found = [list(map(self.segments.get, own)) for own in parts]
        self.learn(dict.fromkeys(s for own, ids in zip(parts, found) for s, x in zip(own, ids) if x is None))
        known = self.segments.get
        return [b"".join([x or known(s) or self.segment(SPACE_MARK + s) for s, x in zip(own, ids)]) for own, ids in zip(parts, found)]

    @staticmethod
    def cut_marked(marked: str) -> list[str]:
        """Segments of a text that is empty or starts with a mark, each without its first mark."""
        if SPACE_MARK * 2 in marked or marked.endswith(SPACE_MARK):
            return [s[1:] for s in _SEGMENT.findall(marked)]
        return marked[1:].split(SPACE_MARK) if marked else []

    @classmethod
    def cut(cls, text: str) -> list[str]:
        """``cut_marked`` of ``marked``; a text with single spaces between words is split at once."""
        if not text or SPACE_MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return cls.cut_marked(cls.marked(text))
        return text.split(" ")

    def encode_many(self, marked: list[str]) -> list[list[int]]:
        """``encode`` of several texts."""
        heads = [m.partition(SPACE_MARK)[0] for m in marked]  # empty but where a text starts without a mark
        rest = self.packed_many([self.cut_marked(m[len(h):]) for h, m in zip(heads, marked)])
        return [unpacked_ids((self.segment(h) if h else b"") + ids) for h, ids in zip(heads, rest)]

    def stay_apart(self, x: str, y: str) -> bool:
        """Whether piece y may follow piece x; anything may follow the beginning."""
        if not x:
            return True
        behind = self.pairs.get(x)
        known = None if behind is None else behind.get(y)
        return self._told_apart(x, y) if known is None else known

    def _told_apart(self, x: str, y: str) -> bool:
        self.n_pairs += 1
        if self.n_pairs > PAIRS:
            self.pairs.clear()
            self.n_pairs = 1
        known = self.merged(x + y) == [x, y]
        self.pairs.setdefault(x, {})[y] = known
        return known

    def ends(self, text: str, start: int, entry: str) -> list[str | None]:
        """The piece that ends at each place behind ``start``, entered behind piece ``entry``."""
        last: list[str | None] = [None] * (len(text) + 1)
        last[start] = entry
        ids, longest, pairs = self.ids, self.longest, self.pairs
        open_at = [start]  # places that some piece ends at, within reach
        for i in range(start + 1, len(text) + 1):
            if i - open_at[0] > longest:
                del open_at[0]
                if not open_at:
                    break
            for j in open_at:  # long pieces are the likely ones
                piece = text[j:i]
                if piece in ids or i - j == 1:
                    before = last[j]
                    if before:
                        behind = pairs.get(before)
                        known = None if behind is None else behind.get(piece)
                        if known is None:
                            known = self._told_apart(before, piece)
                        if not known:
                            continue
                    last[i] = piece
                    open_at.append(i)
                    break
        return last

    @staticmethod
    def traced(last: list[str | None], start: int, end: int) -> list[str]:
        path = []
        while end > start:
            path.append(last[end])
            end -= len(last[end])
        return path[::-1]

    def id_list(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            known = self.ids.get(p)
            out += [known] if known is not None else [self.byte_ids[b] for b in p.encode("utf-8")]
        return out

    @staticmethod
    def marked(text: str) -> str:
        return SPACE_MARK + text.replace(" ", SPACE_MARK) if text else ""

    def segment(self, text: str) -> bytes:
        """Packed ids of a segment that is not remembered: long ones are walked through the lattice."""
        if len(text) > SHORT:
            return np.array(self.id_list(self.traced(self.ends(text, 0, ""), 0, len(text))), dtype=np.int32).tobytes()
        return self.merged_many([text])[0]

    def encode(self, marked: str) -> list[int]:
        """Ids of a marked text (see ``marked``) or of a stretch between safe places."""
        return self.encode_many([marked])[0]

    def decode_many(self, ids: np.ndarray, ends: list[int]) -> list[str]:
        """Texts of ids that lie one text behind the other, each up to its end."""
        size = self.n_bytes[ids]
        until = np.cumsum(size)
        raw = self.bytes_of[np.repeat(self.bytes_at[ids] - until + size, size) + np.arange(size.sum())].tobytes()
        cuts = np.concatenate(([0], until))[[0, *ends]].tolist()
        texts = (raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:]))
        return [t[1:] if t.startswith(" ") else t for t in texts]

    def decode(self, ids) -> str:
        return self.decode_many(np.asarray(ids, dtype=np.int64), [len(ids)])[0]

    def states(self, left: str, right: str) -> list[tuple[int, int]]:
        """(characters before, characters behind) of every piece that ends at or spans a border."""
        found = [(1, 0)]
        for a in range(1, min(self.longest, len(left)) + 1):
            for b in range(0, min(self.longest - a, len(right)) + 1):
                if (a, b) != (1, 0) and left[len(left) - a:] + right[:b] in self.ids:
                    found.append((a, b))
        return found

    def _borders(self, left, body, right, first, final):
        entries = [(0, 0)] if first else self.states(left, (body + right)[:self.longest])
        exits = [(0, 0)] if final else self.states((left + body)[-self.longest:], right)
        return entries, exits

    def _piece_at(self, left: str, body: str, right: str, at: int, state: tuple[int, int]) -> str:
        a, b = state
        return (left + body + right)[len(left) + at - a:len(left) + at + b]

    def transfer(self, left: str, body: str, right: str, first: bool, final: bool) -> np.ndarray:
        """Best weight from every state at the left border to every state at the right border."""
        entries, exits = self._borders(left, body, right, first, final)
        out = np.full((len(entries), len(exits)), NEVER)
        safe = [m.start() for m in _SAFE.finditer(body) if self.longest < m.start() < len(body) - self.longest]

        def leaves(last, start):
            weights = np.full(len(exits), NEVER)
            for k, (a, b) in enumerate(exits):
                at = len(body) - a
                if at >= start and last[at] is not None:
                    if final or self.stay_apart(last[at], self._piece_at(left, body, right, len(body), (a, b))):
                        weights[k] = 0.0
            return weights

        if safe:
            tail = self.ends(body[safe[-1]:], 0, "")
            behind = leaves([None] * safe[-1] + tail, safe[-1])
        for k, (a, b) in enumerate(entries):
            if b > len(body):
                continue
            entry = self._piece_at(left, body, right, 0, (a, b))
            if safe:
                last = self.ends(body[:safe[0]], b, entry)
                out[k] = behind if last[safe[0]] is not None else NEVER
            else:
                out[k] = leaves(self.ends(body, b, entry), b)
        return out

    def traced_chunk(self, left, body, right, first, final, came: int, went: int) -> list[int]:
        """Ids of the pieces that start in the chunk, between its two border states."""
        entries, exits = self._borders(left, body, right, first, final)
        (a, start), (back, ahead) = entries[came], exits[went]
        entry = self._piece_at(left, body, right, 0, (a, start))
        end = len(body) - back
        cuts = [m.start() for m in _SAFE.finditer(body) if start < m.start() <= end]
        if not cuts:
            ids = self.id_list(self.traced(self.ends(body[:end], start, entry), start, end))
        else:
            ids = self.id_list(self.traced(self.ends(body[:cuts[0]], start, entry), start, cuts[0]))
            ids += self.encode(body[cuts[0]:cuts[-1]])
            rest = body[cuts[-1]:end]
            ids += self.id_list(self.traced(self.ends(rest, 0, ""), 0, len(rest)))
        return ids if final else ids + self.id_list([self._piece_at(left, body, right, len(body), (back, ahead))])


def unpacked_ids(ids: bytes) -> list[int]:
    return memoryview(ids).cast("i").tolist()


def combined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(max, +) product."""
    return (x[:, :, None] + y[None, :, :]).max(axis=1)


def pieces_of(file: str) -> Pieces:
    """The task's vocabulary, kept by its Python worker until a task of another kind comes."""
    return remembered(file, lambda: Pieces(file))


def _as_marked(text: str) -> str:
    return text.replace(" ", SPACE_MARK)


def _packed(m: np.ndarray) -> tuple[int, bytes]:
    return m.shape[0], m.astype(np.float32).tobytes()


def _unpacked(rows: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float32).reshape(rows, -1)


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[list]:
    """Lists of rows that agree on ``keys``; rows come sorted by them."""
    held, here = [], None
    for batch in batches:
        for row in batch.itertuples(index=False):
            key = tuple(getattr(row, k) for k in keys)
            if key != here and held:
                yield held
                held = []
            here = key
            held.append(row)
    if held:
        yield held


def _short(file: str, decode: bool, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(file)
        p.most_segments = most
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                rows = whole.slice(at, TEXTS_AT_ONCE)
                packed = p.packed_many([p.cut(t) for t in rows.column("text").to_pylist()])
                flat = np.frombuffer(b"".join(packed), dtype=np.int32)
                ends = (np.cumsum(list(map(len, packed))) // flat.itemsize).tolist()
                out = {"doc_id": rows.column("doc_id"), "text": rows.column("text"),
                       "ids": pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(flat))}
                if decode:
                    out["decoded"] = pa.array(p.decode_many(flat, ends), pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return run


def _transfers(file: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces_of(file)
        for rows in batches:
            m = [_packed(p.transfer(*map(_as_marked, (r.left, r.body, r.right)), r.at == 0, r.at == r.last)) for r in rows.itertuples(index=False)]
            yield pd.DataFrame({"key": rows["key"], "at": rows["at"], "rows": [x[0] for x in m], "matrix": [x[1] for x in m]})

    return run


def _span_products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for group in _groups(batches, ["key", "span"]):
        m = _unpacked(group[0].rows, group[0].matrix)
        for r in group[1:]:
            m = combined(m, _unpacked(r.rows, r.matrix))
        rows, data = _packed(m)
        yield pd.DataFrame({"key": [group[0].key], "span": [group[0].span], "rows": [rows], "matrix": [data]})


def _vectors(ms: list[np.ndarray], ahead: np.ndarray, behind: np.ndarray) -> tuple[list, list]:
    """Forward vector at the left border and backward vector at the right border of each matrix."""
    forward, backward = [ahead], [behind]
    for m in ms[:-1]:
        forward.append((forward[-1][:, None] + m).max(axis=0))
    for m in ms[:0:-1]:
        backward.append((m + backward[-1][None, :]).max(axis=1))
    return forward, backward[::-1]


def _span_vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for group in _groups(batches, ["key"]):
        ms = [_unpacked(r.rows, r.matrix) for r in group]
        forward, backward = _vectors(ms, np.zeros(1, np.float32), np.zeros(1, np.float32))
        yield pd.DataFrame({"key": [r.key for r in group], "span": [r.span for r in group],
                            "ahead": [v.astype(np.float32).tobytes() for v in forward],
                            "behind": [v.astype(np.float32).tobytes() for v in backward]})


def _border_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for group in _groups(batches, ["key", "span"]):
        ms = [_unpacked(r.rows, r.matrix) for r in group]
        forward, backward = _vectors(ms, np.frombuffer(group[0].ahead, np.float32), np.frombuffer(group[0].behind, np.float32))
        came, went = [], []
        for m, f, b in zip(ms, forward, backward):
            best = f[:, None] + m + b[None, :]
            i, j = np.unravel_index(int(best.argmax()), best.shape)
            came.append(int(i))
            went.append(int(j))
        yield pd.DataFrame({"key": [r.key for r in group], "at": [r.at for r in group], "came": came, "went": went})


def _traced_chunks(file: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces_of(file)
        for rows in few_rows(batches, CHUNKS_AT_ONCE):
            ids = [p.traced_chunk(*map(_as_marked, (r.left, r.body, r.right)), r.at == 0, r.at == r.last, r.came, r.went)
                   for r in rows.itertuples(index=False)]
            yield pd.DataFrame({"key": rows["key"], "at": rows["at"], "body": rows["body"], "ids": [np.array(i, dtype=np.int32) for i in ids]})

    return run


def _decoded(file: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces_of(file)
        for rows in few_rows(batches, TEXTS_AT_ONCE):
            yield rows.assign(decoded=[p.decode(ids) for ids in rows["ids"]])

    return run


def encode_pieces(
    docs: DataFrame, file: str, chunk: int = CHUNK, span: int = SPAN, decode: bool = False, most: int = SEGMENTS
) -> DataFrame:
    """doc_id, text, ids (array<int>) of every row of (doc_id, text); with ``decode`` the text decoded from the ids, too.

    ``file`` is a SentencePiece BPE model; ids equal the library's, without
    begin or end.  Null and empty texts have no ids; repeated rows are encoded
    row by row; an empty table gives no rows; other columns are ignored.
    ``most`` bounds the segments whose ids a Python worker keeps, which changes its memory and no result.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    short = F.length("text") < chunk  # a mark goes in front
    schema = "doc_id long, text string, ids array<int>" + (", decoded string" if decode else "")
    done = rows.where(short).mapInArrow(lean(_short(file, decode, most), file), schema)

    # Chunks with as much of their neighbours as a piece may span; a space goes in front of the text.
    margin = pieces_of(file).longest
    giant = rows.where(~short).select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("key"))
    shifted = F.concat(F.lit(" "), "text")
    last = F.floor(F.length("text") / chunk).cast("int")
    cut = giant.dropDuplicates(["key"]).select("key", shifted.alias("line"), last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("at"))
    at = F.col("at") * chunk
    left_from = F.greatest(at - margin, F.lit(0))
    chunks = settled(cut.select(
        "key", "at", "last", F.substring("line", left_from + 1, at - left_from).alias("left"),
        F.substring("line", at + 1, F.lit(chunk)).alias("body"), F.substring("line", at + chunk + 1, F.lit(margin)).alias("right"),
    ).repartition("key", "at"), "chunks")
    matrices = chunks.mapInPandas(lean(_transfers(file), file), "key binary, at int, rows int, matrix binary")
    matrices = settled(matrices.withColumn("span", F.floor(F.col("at") / span)), "matrices")
    products = matrices.repartition("key", "span").sortWithinPartitions("key", "span", "at").mapInPandas(
        _span_products, "key binary, span long, rows int, matrix binary"
    )
    vectors = products.repartition("key").sortWithinPartitions("key", "span").mapInPandas(
        _span_vectors, "key binary, span long, ahead binary, behind binary"
    )
    borders = matrices.join(vectors, ["key", "span"]).repartition("key", "span").sortWithinPartitions("key", "span", "at")
    states = borders.mapInPandas(_border_states, "key binary, at int, came int, went int")
    traced = chunks.join(states, ["key", "at"]).mapInPandas(lean(_traced_chunks(file), file), "key binary, at int, body string, ids array<int>")
    parts = traced.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "body", "ids"))).alias("_parts"))
    whole = parts.select("key", F.expr("substring(array_join(_parts.body, ''), 2)").alias("text"), F.flatten("_parts.ids").alias("ids"))
    # The text comes back from its chunks, so the documents' own rows are narrow.
    joined = warm_join(giant.select("doc_id", "key"), whole, ["key"], ["doc_id"], "inner", hot=200)
    joined = joined.select("doc_id", "text", "ids")
    return done.unionByName(decode_pieces(joined, file) if decode else joined)


def decode_pieces(encoded: DataFrame, file: str) -> DataFrame:
    """Adds ``decoded`` to rows with ``ids``; bytes that are no UTF-8 become U+FFFD."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    return encoded.mapInPandas(lean(_decoded(file), file), schema)


def op4_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with the 32k piece model, and decoded again."""
    import public_tokenizers

    file = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode_pieces(table(spark, sf_dir, "documents"), file, decode=True)
    return coded.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        (F.col("decoded") == F.replace(F.col("text"), F.lit(SPACE_MARK), F.lit(" "))).alias("round_trip"),
    )
