"""Packing token sequences: best fit by length classes, then a swap-based local search.

Only lengths matter for packing, and lengths are integers from 1 to the sequence size.  The driver gets the
number of pieces of each length (at most ``size`` rows, whatever the corpus) and packs whole classes: a pattern
is the list of lengths in a bin, with the number of bins that look so.  Best fit decreasing over classes gives
the first solution; the local search then empties underfull bins, all of them and whole patterns at once, by moves and
exchanges of one or two items, each raising the sum of squared fills, until none does.  Pieces get ranks within their
length, salted so that a length that a third of all rows share is numbered by many tasks, and a rank's place in a
pattern gives sequence and offset.

Edge cases: a null text counts as empty (its one token is the end token); a very long text is cut into as many pieces as
it needs; pieces of one length are alike to the search, and go by id and piece; rows that repeat an id are packed as rows
of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from bisect import bisect_left, insort
from collections import Counter
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, as_documents, parts, read, settle
from .words import text_chunks, word_hashes, word_spans

SIZE, END = 4096, 1


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PUNCT = ".,;:!?"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes a byte as a character: itself where it prints, else the next character from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Token ids of whole chunks through a table of word encodings.

    The tokenizer lower-cases, drops white space and never joins what white space separates, so a text's ids are those
    of its words in turn; each distinct word is encoded once a task.  Words of Latin letters with closing punctuation go
    straight to the BPE model, which then sees what the full path would give it; all others take the full path.  The
    table is emptied beyond ``most`` words.
    """

    def __init__(self, path: str, most: int = 3 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        self.model, self.map, self.ends = self.tok.model, _byte_letters(), {}
        self._empty()

    def _empty(self) -> None:
        self.keys, self.first, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _fast(self, word: str) -> list[int] | None:
        core = word.rstrip(PUNCT)
        if not core.isalpha() or not (core.isascii() or (max(core) < "\u0180" and "\u0130" not in core)):
            return None
        end = word[len(core) :]
        if end and end not in self.ends:
            if len(self.ends) > 10_000:
                self.ends = {}
            self.ends[end] = [t.id for t in self.model.tokenize(end)]
        text = core.lower()
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.map)
        ids = [t.id for t in self.model.tokenize(text)]
        return ids + self.ends[end] if end else ids

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        words = [w.decode("utf-8", "replace") for w in words]
        got = [self._fast(w) for w in words]
        slow = [i for i, g in enumerate(got) if g is None]
        for k in range(0, len(slow), 4096):
            some = slow[k : k + 4096]
            for i, e in zip(some, self.tok.encode_batch_fast([words[i] for i in some], add_special_tokens=False), strict=True):
                got[i] = e.ids
        size = np.fromiter(map(len, got), np.int64, len(got))
        first = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))])
        at = np.searchsorted(self.keys, keys)  # both are sorted
        self.keys, self.first, self.size = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.size, at, size)

    def _look_up(self, buf: np.ndarray, off: np.ndarray, spans=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the table has each distinct word of a chunk, which of them each word is, and words per document."""
        starts, ends, counts = spans or word_spans(buf, off)
        uniq, at, back = np.unique(word_hashes(buf, starts, ends, lower=True), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self._empty()
        spot = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == uniq[inside]
        if not known.all():
            data = buf.tobytes()
            self._learn(uniq[~known], [data[a:b] for a, b in zip(starts[at[~known]].tolist(), ends[at[~known]].tolist(), strict=True)])
            spot = np.searchsorted(self.keys, uniq)
        return spot, back, counts

    def count(self, buf: np.ndarray, off: np.ndarray, spans=None) -> np.ndarray:
        """How many ids each document of a chunk has."""
        spot, back, counts = self._look_up(buf, off, spans)
        return np.diff(np.r_[0, np.cumsum(self.size[spot][back])][np.r_[0, np.cumsum(counts)]])

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk's documents in turn, and how many each has."""
        spot, back, counts = self._look_up(buf, off)
        size = self.size[spot][back]
        begin = np.cumsum(size) - size
        ids = self.flat[np.repeat(self.first[spot][back] - begin, size) + np.arange(int(size.sum()))]
        edge = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts)]]
        return ids, np.diff(edge)


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python process, which keeps its words from one task to the next."""
    kept = sys.modules.setdefault("_siftline_encoders", types.ModuleType("_siftline_encoders")).__dict__
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def _pieces(path: str, size: int, end: int, with_ids: bool):
    """Cut each document's ids into pieces of at most ``size``."""

    def run(batches):
        enc = worker_encoder(path)
        for batch in batches:
            docs = batch.column(0)
            for lo, hi, buf, off in text_chunks(batch.column(1)):
                ids, counts = enc.encode(buf, off)
                total = counts + 1
                stop = np.cumsum(total)
                out = np.full(int(stop[-1]), end, np.dtype("<u4"))
                text = np.ones(len(out), bool)
                text[stop - 1] = False
                out[text] = ids
                n = -(-total // size)
                owner = np.repeat(np.arange(hi - lo), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * size
                length = np.minimum(size, total[owner] - start)
                begin = (stop - total)[owner] + start
                view = memoryview(out).cast("B")
                crc = np.fromiter((zlib.crc32(view[4 * a : 4 * (a + b)]) for a, b in zip(begin.tolist(), length.tolist(), strict=True)), np.int64, len(owner))
                cols = [docs.slice(lo, hi - lo).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[begin, len(out)].astype(np.int32)), pa.array(out.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def token_pieces(docs: DataFrame, size: int = SIZE, end: int = END, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32 (of little-endian unsigned 32-bit ids), and
    the ids themselves if asked for."""
    docs = as_documents(docs, {"doc_id": "long", "text": "string"})
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.mapInArrow(_pieces(path or vocabulary_path(), size, end, with_ids), schema)


# -- packing of length classes, on the driver


def best_fit(classes: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over {length: how many}: patterns (lengths in a bin) and how many bins have them."""
    groups: dict[int, list[list]] = {}  # free space: [pattern as nested pairs, bins]
    frees: list[int] = []

    def put(free: int, pattern, bins: int) -> None:
        if free not in groups:
            groups[free] = []
            insort(frees, free)
        groups[free].append([pattern, bins])

    for length in sorted(classes, reverse=True):
        left = classes[length]
        while left:
            k = bisect_left(frees, length)
            if k == len(frees):
                many = size // length
                for items, bins in ((many, left // many), (left % many, 1)):
                    if items and bins:
                        pattern = None
                        for _ in range(items):
                            pattern = (length, pattern)
                        put(size - items * length, pattern, bins)
                break
            free = frees[k]
            pattern, bins = groups[free][-1]
            take = min(bins, left)
            if take == bins:
                groups[free].pop()
                if not groups[free]:
                    del groups[free]
                    frees.pop(k)
            else:
                groups[free][-1][1] = bins - take
            put(free - length, (length, pattern), take)
            left -= take

    def flat(p) -> tuple[int, ...]:
        out = []
        while p:
            out.append(p[0])
            p = p[1]
        return tuple(out)

    return [(flat(p), bins) for g in groups.values() for p, bins in g]


def _takes(pattern: tuple[int, ...]) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Sums that nothing, one or two items of ``pattern`` can have, rising, and items of each sum."""
    found: dict[int, tuple[int, ...]] = {0: ()}
    for x in set(pattern):
        found.setdefault(x, (x,))
    for a, b in {(a, b) for i, a in enumerate(pattern) for b in pattern[i + 1 :]}:
        found.setdefault(a + b, (a, b))
    sums = sorted(found)
    return np.array(sums, np.int64), [found[x] for x in sums]


def _swapped(pattern: tuple[int, ...], out: tuple[int, ...], into: tuple[int, ...]) -> tuple[int, ...]:
    left = list(pattern)
    for x in out:
        left.remove(x)
    return tuple(sorted([*left, *into], reverse=True))


def local_search(patterns: list[tuple[tuple[int, ...], int]], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Empty bins by moves and exchanges that raise the sum of squared fills, for all bins of a pattern at once.

    The emptiest pattern is the source, and every pattern that is not full and not emptier a target, so each underfull bin
    is either in turn.  One or two items go to the target for none, one or two of its own; of those that fit, a target
    takes what fills it most.  The bins of the source go to the targets by falling gain, a move a bin.  A full bin can
    take part in no such move.  Ends when no source has a move that gains, or when no fewer bins can hold the total.
    """
    counts: Counter[tuple[int, ...]] = Counter()
    for pattern, n in patterns:
        counts[tuple(sorted(pattern, reverse=True))] += n
    total = sum(sum(p) * n for p, n in counts.items())
    spare = sum(counts.values()) - -(-total // size)
    full = [(p, n) for p, n in counts.items() if sum(p) == size]
    for p, _ in full:
        del counts[p]
    takes = {p: _takes(p) for p in counts}
    gained = True
    while gained and spare > 0:
        gained = False
        queue = [(sum(p), p) for p in counts]
        heapify(queue)
        while queue and spare > 0:
            load, source = heappop(queue)
            if not counts.get(source):
                continue
            targets = list(counts)
            loads = np.fromiter(map(sum, targets), np.int64, len(targets))
            targets, loads = [targets[k] for k in np.flatnonzero(loads >= load)], loads[loads >= load]
            give, given = takes[source]
            per = np.array([len(takes[t][0]) for t in targets])
            back, home = np.concatenate([takes[t][0] for t in targets]), np.repeat(np.arange(len(targets)), per)
            pick = np.searchsorted(give, back + size - loads[home], "right") - 1
            more = give[pick] - back
            gain = np.where(more > 0, more * (loads[home] - load + more), 0)
            start = np.cumsum(per) - per
            best = np.maximum.reduceat(gain, start)
            moves, left = [], counts[source]
            for k in np.argsort(-best, kind="stable"):
                if best[k] <= 0 or not left:
                    break
                at = start[k] + int(gain[start[k] : start[k] + per[k]].argmax())
                n = left // 2 if targets[k] == source else min(left, counts[targets[k]])
                if n:
                    moves.append((targets[k], given[pick[at]], takes[targets[k]][1][at - start[k]], n))
                    left -= 2 * n if targets[k] == source else n
            for target, out, into, n in moves:
                counts[source] -= n
                counts[target] -= n
                for p in (_swapped(source, out, into), _swapped(target, into, out)):
                    if not p:
                        spare -= n
                    elif sum(p) == size:
                        full.append((p, n))
                    else:
                        counts[p] += n
                        if p not in takes:
                            takes[p] = _takes(p)
                        heappush(queue, (sum(p), p))
            gained = gained or bool(moves)
            for p in {source, *(m[0] for m in moves)}:
                if not counts[p]:
                    del counts[p]
            if moves and counts.get(source):
                heappush(queue, (load, source))
    return full + list(counts.items())


def plan_packing(classes: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns for all pieces: best fit by classes, then the local search over all of them."""
    return local_search(best_fit(classes, size), size)


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> pa.Table:
    """A row for each place of each pattern: pieces of ``length`` with ranks from ``first`` on, ``bins`` of them, go to the
    sequences from ``seq`` on, at ``offset``."""
    rows: tuple[list, ...] = ([], [], [], [], [])
    used: dict[int, int] = {}
    seq = 0
    for pattern, bins in patterns:
        offset = 0
        for length in pattern:
            at = used.get(length, 0)
            for col, v in zip(rows, (length, at, bins, seq, offset), strict=True):
                col.append(v)
            used[length] = at + bins
            offset += length
        seq += bins
    return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("length", "first", "bins", "seq", "offset"), rows, strict=True)})


def _place(size: int, length, first, seq, offset):
    """Give each (length, rank) its slot, by a search in the slots sorted by length and first rank."""

    def run(batches):
        base = 1 << 50
        # ranks stay below 2**50 and lengths below 2**13, so one number orders both
        key = length.value * base + first.value
        for batch in batches:
            ln, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(key, ln * base + rank, "right") - 1
            keep = [c for c in batch.schema.names if c != "rank"]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq.value[k] + rank - first.value[k]), pa.array(offset.value[k])], [*keep, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (doc_id, piece, length, and any more columns) with sequence_id and offset."""
    spark = pieces.sparkSession
    salts = max(16, parts(spark))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    per = settle(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    classes = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    slots = _slots(plan_packing(classes, size)).sort_by([("length", "ascending"), ("first", "ascending")])
    before = per.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("rank", rank.cast("long")).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id long, offset long"
    if slots.nbytes <= BROADCAST_BYTES:
        send = [spark.sparkContext.broadcast(slots.column(c).to_numpy()) for c in ("length", "first", "seq", "offset")]
        return ranked.mapInArrow(_place(size, *send), schema)
    wide = spark.createDataFrame(slots.to_pandas()).select("length", F.posexplode(F.expr("sequence(0L, bins - 1)")).alias("k", "step"), "first", "seq", "offset")
    wide = wide.select("length", (F.col("first") + F.col("step")).alias("rank"), (F.col("seq") + F.col("step")).alias("sequence_id"), "offset")
    return ranked.join(wide, ["length", "rank"]).drop("rank")


def pack_documents(docs: DataFrame, size: int = SIZE, end: int = END, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs``; one row a piece."""
    return pack(settle(token_pieces(docs, size, end, path, with_ids), "pieces"), size)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    out = pack_documents(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
