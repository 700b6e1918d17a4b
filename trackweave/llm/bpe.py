"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words (matches of the tokenizer's pattern) of a block of the corpus form one array of symbols with links
to the neighbours left and right, and an inverted index from symbol pair to the positions where it stands. Merges are
replayed in rank order, each at all its positions at once; only the pairs that a merge touches are indexed anew.
Merges never cross words, so a word gets the tokens it would get alone, however the corpus is cut into blocks: the
blocks need no shuffle, and a lost one is made again from its rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary of the registered query; another file of ranks can be named.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bounds of a task's memory: characters of a block, words merged together, words kept from block to block, and
#: bytes of text whose results are handed on together.
BLOCK_CHARS, BATCH_WORDS, KEPT_WORDS, OUT_BYTES = 4_000_000, 60_000, 250_000, 2_000_000
#: Two ids make a key of one integer.
SHIFT = 20


class Vocabulary:
    """The ranks of a file: token bytes by id, the id of each byte, and what two ids merge into."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.spelled = {rank: token for token, rank in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Ids merge if their bytes joined are a token; its rank is the merge's rank.
        self.pairs = {ranks[t[:k]] << SHIFT | ranks[t[k:]]: rank for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.keys = np.sort(np.fromiter(self.pairs, np.int64, len(self.pairs)))
        self.key_ranks = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)
        self.words: dict[str, tuple[str, bytes]] = {}  # word -> ids joined by commas, decoded bytes


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def replay(words: list[bytes], v: Vocabulary) -> list[list[int]]:
    """The token ids of each word: all merges in rank order over all the words at once."""
    array = v.byte[np.frombuffer(b"".join(words), np.uint8)]
    ends = np.cumsum([len(w) for w in words])
    n = len(array)
    following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    following[ends[ends > 0] - 1] = n  # n and -1: none
    before[ends[ends < n]] = -1

    # The inverted index: the places of every pair. A token's rank stands for the pairs that merge into it.
    starts = np.flatnonzero(following < n)
    keys = array[starts] << SHIFT | array[starts + 1]
    at = np.minimum(np.searchsorted(v.keys, keys), len(v.keys) - 1)
    merging = v.keys[at] == keys
    ranks, starts = v.key_ranks[at[merging]], starts[merging]
    order = np.argsort(ranks, kind="stable")
    distinct, cuts = np.unique(ranks[order], return_index=True)
    waiting = distinct.tolist()  # in order, so a heap
    index = {r: x.tolist() for r, x in zip(waiting, np.split(starts[order], cuts[1:]), strict=True)} if waiting else {}

    symbols, right, left, pair = array.tolist(), following.tolist(), before.tolist(), v.pairs.get
    while waiting:
        rank = heapq.heappop(waiting)
        places = index.pop(rank)
        places.sort()  # the leftmost place of a word goes first
        done = 0
        for at in places:
            done += 1
            second = right[at]
            if second >= n or pair(symbols[at] << SHIFT | symbols[second]) != rank:
                continue  # an earlier merge has taken one of the two
            after = right[second]
            symbols[at], symbols[second], right[at], right[second] = rank, -1, after, n
            if after < n:
                left[after] = at
                found = pair(rank << SHIFT | symbols[after])
                if found is not None:
                    if found in index:
                        index[found].append(at)
                    else:
                        index[found] = [at]
                        heapq.heappush(waiting, found)
            ahead = left[at]
            if ahead >= 0:
                found = pair(symbols[ahead] << SHIFT | rank)
                if found is not None:
                    if found in index:
                        index[found].append(ahead)
                    else:
                        index[found] = [ahead]
                        heapq.heappush(waiting, found)
            if waiting and waiting[0] < rank:  # a merge that has become possible comes first
                if done < len(places):
                    if rank not in index:
                        heapq.heappush(waiting, rank)
                    index.setdefault(rank, []).extend(places[done:])
                break
    out, begin = [], 0
    for end in ends.tolist():
        out.append([s for s in symbols[begin:end] if s >= 0])
        begin = end
    return out


def _learn(words: set[str], v: Vocabulary) -> None:
    """Put the ids and decoded bytes of the words into v.words; what earlier blocks left is dropped if too much."""
    if len(v.words) > KEPT_WORDS:
        v.words.clear()
    missing = sorted(words.difference(v.words))
    for at in range(0, len(missing), BATCH_WORDS):
        some = missing[at : at + BATCH_WORDS]
        for word, ids in zip(some, replay([w.encode() for w in some], v), strict=True):
            v.words[word] = ",".join(map(str, ids)), b"".join(map(v.spelled.__getitem__, ids))


def encoded(texts: Iterator[str], find, v: Vocabulary) -> Iterator[tuple[str, bytes]]:
    """The ids of each text, joined by commas, and the bytes they decode to; block by block of BLOCK_CHARS."""
    block: list[list[str]] = []
    words: set[str] = set()
    size = 0

    def answers() -> Iterator[tuple[str, bytes]]:
        _learn(words, v)
        for found in block:
            pairs = [v.words[w] for w in found]
            yield ",".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])

    for text in texts:
        block.append(find(text))
        words.update(block[-1])
        size += len(text)
        if size >= BLOCK_CHARS:
            yield from answers()
            block, words, size = [], set(), 0
    yield from answers()


def encode(docs: DataFrame, path: str, pattern: str, ident: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """ident, n_tokens and either ids (array<int>) and decoded (binary), or the SHA-256 of both (digest).

    path: a file of ranks that every executor has, as installed with its tokenizer. Special tokens are ordinary text.
    Null text: as the empty text, no tokens. Null ident and rows that repeat: a result each. A text may be of any
    length; it is encoded whole. Empty table: no rows. Other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        v, find = vocabulary(path), regex.compile(pattern).findall
        for batch in batches:
            at, held, size = 0, [], 0
            for ids, data in encoded((t.as_py() or "" for t in batch.column(1)), find, v):
                if digest:
                    held.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(data).hexdigest()))
                else:
                    held.append((ids.count(",") + 1 if ids else 0, np.fromstring(ids, np.int32, sep=","), data))
                size += len(data)
                if size >= OUT_BYTES:
                    yield rows(batch.column(0).slice(at, len(held)), held)
                    at, held, size = at + len(held), [], 0
            yield rows(batch.column(0).slice(at, len(held)), held)

    def rows(own: pa.Array, held: list) -> pa.RecordBatch:
        counts, first, second = zip(*held, strict=True) if held else ((), (), ())
        if digest:
            columns = pa.array(first, pa.string()), pa.array(second, pa.string())
        else:
            ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            columns = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *first]))), pa.array(second, pa.binary())
        return pa.RecordBatch.from_arrays([own, pa.array(counts, pa.int64()), *columns], names=names)

    names = [ident, "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]
    kinds = [docs.schema[ident].dataType.simpleString(), "long", *(("string", "string") if digest else ("array<int>", "binary"))]
    return docs.select(F.col(ident), F.col(text)).mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with a binary column decoded: the bytes of the token ids. Null ids: null; an id without a token fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = vocabulary(path).spelled
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            data = [None if x is None else b"".join(map(spelled.__getitem__, x)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "decoded"])

    kept = rows.drop("decoded")
    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", decoded binary")
