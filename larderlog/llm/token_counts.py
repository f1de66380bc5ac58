"""Token counts by a compiled finite-state tokenizer, chunk by chunk.

The byte-pair tokenizer is compiled, as texts need it, into a deterministic
transducer whose transitions read one pre-token and are annotated with the
number of tokens it emits.  White space after a visible character always ends a
pre-token: there the transducer is in one known state whatever came before.  So
the state map of a chunk is short: the text up to its first such place (to be
read from the state the chunk is entered in), the tokens emitted from there to
its last such place, and the text behind it, which the next chunk continues.
Maps compose associatively; long documents are counted by composing the maps of
their chunks in spans and then the spans, on different tasks.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_join, table, text_of

#: Characters of a chunk; longer documents are cut.  Chunks whose maps one task composes.
CHUNK, SPAN = 32_768, 64
#: Pre-tokens a task remembers; pre-tokens longer than LONG are not remembered.
TRANSITIONS, LONG = 600_000, 64
OVER = 1024

_RESET = regex.compile(r"(?<=\S)(?=\s)")


class Transducer(dict):
    """Transitions: pre-token -> number of tokens emitted; compiled on first use."""

    def __init__(self, file: str):
        super().__init__()
        import public_tokenizers

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.at_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        # The printable character that stands for each byte in byte-level vocabularies.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        spare = iter(range(0x100, 0x200))
        self.shown = [chr(b) if b in plain else chr(next(spare)) for b in range(256)]

    def __missing__(self, pretoken: str) -> int:
        parts = [self.shown[b] for b in pretoken.encode("utf-8")]
        if len(parts) > LONG:
            return self._emitted_by_long(parts)
        if len(self) >= TRANSITIONS:
            self.clear()
        self[pretoken] = n = self._emitted(parts)
        return n

    def _emitted(self, parts: list[str]) -> int:
        ranks, never = self.ranks, 1 << 30
        waiting = [ranks.get(pair, never) for pair in zip(parts, parts[1:])]
        while waiting and (best := min(waiting)) < never:
            i = waiting.index(best)
            parts[i] += parts.pop(i + 1)
            del waiting[i]
            if i:
                waiting[i - 1] = ranks.get((parts[i - 1], parts[i]), never)
            if i < len(waiting):
                waiting[i] = ranks.get((parts[i], parts[i + 1]), never)
        return len(parts)

    def _emitted_by_long(self, parts: list[str]) -> int:
        """The same with a heap and linked neighbours, for pre-tokens of any length."""
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        waiting = [(r, i, pair) for i, pair in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get(pair)) is not None]
        heapq.heapify(waiting)
        left, end = len(parts), len(parts)
        while waiting:
            _, i, (x, y) = heapq.heappop(waiting)
            j = after[i]
            if parts[i] != x or j >= end or parts[j] != y:
                continue
            parts[i], parts[j] = x + y, None
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            left -= 1
            for u, v in ((before[i], i), (i, after[i])):
                if u >= 0 and v < end and (r := self.ranks.get((parts[u], parts[v]))) is not None:
                    heapq.heappush(waiting, (r, u, (parts[u], parts[v])))
        return left

    def count(self, text: str) -> int:
        """Tokens of a text that starts and ends at a reset (or is whole)."""
        if self.at_special is None or not self.at_special.search(text):
            return sum(map(self.__getitem__, self.pattern.findall(text)))
        pieces = self.at_special.split(text)
        return len(pieces) - 1 + sum(sum(map(self.__getitem__, self.pattern.findall(p))) for p in pieces)

    def state_map(self, text: str) -> Map:
        places = [m.start() for m in _RESET.finditer(text)]
        if not places:
            return Map(text, None, "")
        return Map(text[:places[0]], self.count(text[places[0]:places[-1]]), text[places[-1]:])

    def compose(self, x: Map, y: Map) -> Map:
        """First x, then y."""
        if x.emitted is None and y.emitted is None:
            # Without a reset in either, one may lie where they meet.
            return self.state_map(x.head + y.head)
        if x.emitted is None:
            inner = self.state_map(x.head + y.head)
            if inner.emitted is None:
                return Map(inner.head, y.emitted, y.tail)
            return Map(inner.head, inner.emitted + self.count(inner.tail) + y.emitted, y.tail)
        if y.emitted is None:
            inner = self.state_map(x.tail + y.head)
            if inner.emitted is None:
                return Map(x.head, x.emitted, inner.head)
            return Map(x.head, x.emitted + self.count(inner.head) + inner.emitted, inner.tail)
        return Map(x.head, x.emitted + self.count(x.tail + y.head) + y.emitted, y.tail)

    def finish(self, m: Map) -> int:
        if m.emitted is None:
            return self.count(m.head)
        return self.count(m.head) + m.emitted + self.count(m.tail)


class Map(NamedTuple):
    """State map of a piece of text; ``emitted`` is None if it has no reset (then ``head`` is all of it)."""

    head: str
    emitted: int | None
    tail: str


_COMPILED: dict[str, Transducer] = {}


def transducer(file: str) -> Transducer:
    """The task's transducer, kept as long as its Python worker lives."""
    if file not in _COMPILED:
        _COMPILED[file] = Transducer(file)
    return _COMPILED[file]


def _counts(file: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(file)
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "n_bytes": rows["n_bytes"], "n_tokens": [t.count(x) for x in rows["text"]]})

    return run


def _maps(file: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(file)
        for rows in batches:
            maps = [t.state_map(x) for x in rows["text"]]
            out = rows[["key", "at"]].copy()
            out["head"], out["tail"] = [m.head for m in maps], [m.tail for m in maps]
            out["emitted"] = pd.array([m.emitted for m in maps], dtype="Int64")
            yield out

    return run


def _composed(file: str, span: int):
    """Compose neighbouring maps of a key in its order, ``span`` at a time; rows come sorted."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, here, so_far = transducer(file), None, None

        def row():
            (key, at), m = here, so_far
            return pd.DataFrame({"key": [key], "at": [at], "head": [m.head], "tail": [m.tail],
                                 "emitted": pd.array([m.emitted], dtype="Int64")})

        for rows in batches:
            for key, at, head, tail, emitted in rows[["key", "at", "head", "tail", "emitted"]].itertuples(index=False):
                m = Map(head, None if pd.isna(emitted) else int(emitted), tail)
                if here == (key, at // span):
                    so_far = t.compose(so_far, m)
                else:
                    if here is not None:
                        yield row()
                    here, so_far = (key, at // span), m
        if here is not None:
            yield row()

    return run


def _finished(file: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(file)
        for rows in batches:
            maps = rows[["head", "emitted", "tail"]].itertuples(index=False)
            counts = [t.finish(Map(h, None if pd.isna(e) else int(e), x)) for h, e, x in maps]
            yield pd.DataFrame({"key": rows["key"], "n_tokens": counts})

    return run


_MAP = "key binary, at long, head string, tail string, emitted long"


def count_tokens(docs: DataFrame, file: str, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of (doc_id, text).

    Tokens are those of the byte-level BPE tokenizer in ``file``; its special
    strings count as one token each.  Null and empty texts have none; repeated
    rows and null doc_ids are counted row by row; an empty table gives no rows;
    other columns are ignored.
    """
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = rows.where(F.length("text") <= chunk)
    counted = short.mapInPandas(_counts(file), "doc_id long, n_bytes long, n_tokens long")

    long_ = rows.where(F.length("text") > chunk).withColumn("key", F.unhex(F.sha2("text", 256)))
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int")),
        lambda i: F.substring("text", i * chunk + 1, F.lit(chunk)),
    )
    chunks = long_.dropDuplicates(["key"]).select("key", F.posexplode(pieces).alias("at", "text"))
    maps = chunks.select("key", F.col("at").cast("long").alias("at"), "text").repartition("key", "at").mapInPandas(_maps(file), _MAP)
    spans = maps.withColumn("_span", F.floor(F.col("at") / span)).repartition("key", "_span").sortWithinPartitions("key", "at")
    spans = spans.drop("_span").mapInPandas(_composed(file, span), _MAP)
    whole = spans.repartition("key").sortWithinPartitions("key", "at").mapInPandas(_composed(file, 1 << 62), _MAP)
    totals = whole.mapInPandas(_finished(file), "key binary, n_tokens long")
    joined = spread_join(long_.select("doc_id", "n_bytes", "key"), totals, ["key"], ["doc_id"])
    return counted.unionByName(joined.select("doc_id", "n_bytes", "n_tokens"))


def op5_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the 50k byte-level vocabulary."""
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > OVER)
