"""Substring de-duplication over a whole corpus: every repeated window of ``size`` words but its first is removed.

A word goes when a window covers it whose words also start earlier: in a document with a smaller id, or earlier in
the same document.  Windows are judged on the input.

1. Each window is named by its anchor, the smallest hash among its word 10-grams (a minimizer), so that about one
   window in six gives a row.  Anchors that several documents hold are counted; all other windows are out.
2. Windows with such an anchor go by 96 bits of hash to the smallest document id that holds them, aggregated before
   the shuffle, so a passage that a third of all documents share costs one row a task.  Among 2e13 windows (about
   100 TB of text) 0.003 pairs of different windows are expected to agree in 96 bits.
3. What is not first becomes word intervals of its document.  Repeats inside a document are found in place.

The shared anchors, and the intervals, are broadcast only under a checked size, and are joined by a shuffle beyond it.

``matching_spans`` is for a given reference text (such as benchmark passages): suffix automata of its shards are broadcast,
documents are streamed past them for matching statistics, and the words of maximal matches are removed.

Edge cases: null or empty texts have no words and keep the empty string; with fewer than ``size`` words nothing is
removed; a very long text is one document like any other; a null id never counts as earlier; rows that repeat an id do
not count as earlier than each other and, told apart by a hash of the text, lose their own words only; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, as_documents, forget, read, settle
from .words import _splitmix, mix, text_chunks, windows, word_hashes, word_spans

SIZE = 20


def _windows(buf: np.ndarray, off: np.ndarray, size: int):
    """Word starts, ends, counts and hashes; hash, anchor and first word of each window; windows per document."""
    starts, ends, counts = word_spans(buf, off)
    h = word_hashes(buf, starts, ends)
    w, at, per = windows(h, counts, size, seed=5)
    if not len(w):
        return starts, ends, counts, h, w, w, at, per
    gram = max(1, size // 2)
    g, where, _ = windows(h, counts, gram, seed=6)
    # grams of one document lie together, so a window's grams are size - gram + 1 neighbours
    place = np.full(len(h), -1, np.int64)
    place[where] = np.arange(len(where))
    low, span, want = g, 1, size - gram + 1
    while span < want:
        step = min(span, want - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    return starts, ends, counts, h, w, low[place[at]], at, per


def _distinct(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Where each distinct (owner, value) comes first."""
    order = np.lexsort((np.arange(len(value)), value, owner))
    new = np.r_[True, (value[order][1:] != value[order][:-1]) | (owner[order][1:] != owner[order][:-1])] if len(order) else np.zeros(0, bool)
    return np.sort(order[new])


def _anchors(size: int):
    def run(batches):
        for batch in batches:
            for _, _, buf, off in text_chunks(batch.column(1)):
                *_, anchor, _, per = _windows(buf, off, size)
                owner = np.repeat(np.arange(len(per)), per)
                keep = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]) if len(anchor) else np.zeros(0, np.int64)
                keep = keep[_distinct(owner[keep], anchor[keep])]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[keep].view(np.int64))], ["anchor"])

    return run


def _check(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """32 more bits of the windows that start at ``at``, from other multipliers."""
    mul = _splitmix(size, 7) | np.uint64(1)
    acc = np.zeros(len(at), np.uint64)
    for k in range(size):
        acc += h[at + k] * mul[k]
    return (mix(acc) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _shared_windows(size: int, shared):
    """First occurrences in their document of windows whose anchor is shared.  ``key`` tells rows of one id apart, if any are."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(2)
            for lo, hi, buf, off in text_chunks(batch.column(1)):
                _, _, _, h, w, anchor, at, per = _windows(buf, off, size)
                owner = np.repeat(np.arange(len(per)), per)
                if len(w):
                    short = (anchor >> np.uint64(32)).astype(np.uint32)
                    k = np.minimum(np.searchsorted(shared.value, short), max(0, len(shared.value) - 1))
                    keep = np.flatnonzero(shared.value[k] == short) if len(shared.value) else np.zeros(0, np.int64)
                else:
                    keep = np.zeros(0, np.int64)
                keep = keep[_distinct(owner[keep], w[keep])]
                first = np.cumsum(per) - per
                pos = keep - first[owner[keep]]
                of = pa.array(owner[keep])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).take(of), keys.slice(lo, hi - lo).take(of), pa.array(w[keep].view(np.int64)), pa.array(_check(h, at[keep], size)), pa.array(pos.astype(np.int32))],
                    ["doc_id", "key", "w", "x", "pos"],
                )

    return run


def _window_runs(size: int):
    """The same of all windows, a row a run of neighbours with one anchor: what is to be joined by anchor travels once a run."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(2)
            for lo, hi, buf, off in text_chunks(batch.column(1)):
                _, _, _, h, w, anchor, at, per = _windows(buf, off, size)
                owner = np.repeat(np.arange(len(per)), per)
                keep = _distinct(owner, w)
                if len(keep):
                    new = np.r_[True, (anchor[keep[1:]] != anchor[keep[:-1]]) | (owner[keep[1:]] != owner[keep[:-1]]) | (keep[1:] != keep[:-1] + 1)]
                else:
                    new = np.zeros(0, bool)
                top = keep[new]
                of, cut = pa.array(owner[top]), pa.array(np.r_[np.flatnonzero(new), len(keep)].astype(np.int32))
                pos = top - (np.cumsum(per) - per)[owner[top]]
                lists = [pa.ListArray.from_arrays(cut, x) for x in (pa.array(w[keep].view(np.int64)), pa.array(_check(h, at[keep], size)))]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(of), keys.slice(lo, hi - lo).take(of), pa.array(anchor[top].view(np.int64)), pa.array(pos.astype(np.int32)), *lists], ["doc_id", "key", "anchor", "pos", "w", "x"])

    return run


def _intervals(size: int):
    """Sorted window starts of each document, as the word intervals that they cover."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            pos = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(n)), n)
            new = np.r_[True, (owner[1:] != owner[:-1]) | (pos[1:] > pos[:-1] + size)] if len(pos) else np.zeros(0, bool)
            last = np.r_[new[1:], True] if len(pos) else new
            per = np.bincount(owner[new], minlength=len(n))
            cut = pa.array(np.r_[0, np.cumsum(per)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(cut, pa.array(pos[new].astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array((pos[last] + size).astype(np.int32)))],
                ["doc_id", "key", "begins", "ends"],
            )

    return run


def _removal(size: int, held, with_text: bool):
    """Remove words; intervals come from a broadcast table sorted by doc_id and key, or as columns 3 and 4."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, off in text_chunks(batch.column(1)):
                starts, ends, counts, _, w, _, at, per = _windows(buf, off, size)
                begin = np.cumsum(counts) - counts
                owner = np.repeat(np.arange(hi - lo), per)
                mark = np.zeros(len(starts) + 1, np.int64)
                first = np.zeros(len(w), bool)
                first[_distinct(owner, w)] = True
                np.add.at(mark, at[~first], 1)
                np.add.at(mark, at[~first] + size, -1)
                for d, b, e in _given(batch, lo, hi, held):
                    np.add.at(mark, begin[d] + b, 1)
                    np.add.at(mark, begin[d] + e, -1)
                gone = np.cumsum(mark[:-1]) > 0
                removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), begin) * (counts > 0) if len(counts) else counts
                keep = np.flatnonzero(~gone)
                length = ends[keep] - starts[keep] + 1
                stop = np.cumsum(length)
                out = buf[np.minimum(np.repeat(starts[keep] - (stop - length), length) + np.arange(int(length.sum())), max(0, len(buf) - 1))].copy() if len(keep) else np.zeros(0, np.uint8)
                out[stop - 1] = 0x20
                edge = np.r_[0, stop][np.searchsorted(keep, np.r_[begin, len(starts)])]
                data = memoryview(out)
                texts = [data[a : b - 1] if b > a else b"" for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                cols = [ids.slice(lo, hi - lo), pa.array(counts), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    cols.append(pa.array([bytes(t).decode() for t in texts], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _given(batch, lo, hi, held):
    """(document of the chunk, interval begins, interval ends) of rows that have any."""
    if held is not None:
        table_ids, table_keys, first, begins, ends = held.value
        ids, keys = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in (0, 2))
        for d, (i, key) in enumerate(zip(ids, keys, strict=True)):
            if i is not None:
                a, z = (int(np.searchsorted(table_ids, i, side)) for side in ("left", "right"))
                k = a + int(np.searchsorted(table_keys[a:z], key))
                if k < z and table_keys[k] == key:
                    yield d, begins[first[k] : first[k + 1]], ends[first[k] : first[k + 1]]
        return
    for d in range(lo, hi):
        if batch.column(3)[d].is_valid:
            yield d - lo, *(batch.column(c)[d].values.to_numpy().astype(np.int64) for c in (3, 4))


def substring_dedup(docs: DataFrame, size: int = SIZE, with_text: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one
    space), and kept_text if asked for."""
    spark = docs.sparkSession
    docs = as_documents(docs, {"doc_id": "long", "text": "string"})
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # one number for all costs nothing where every id is one row's
    docs = docs.withColumn("key", F.xxhash64("text") if ids.limit(1).count() else F.lit(0).cast("long"))
    named = docs.where("doc_id IS NOT NULL")
    often = named.select("doc_id", "text").mapInArrow(_anchors(size), "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    often = settle(often, "anchors")
    if often.count() * 4 <= broadcast_bytes:
        # half a hash is enough: one that fits by chance only makes more candidates
        top = often.select(F.shiftrightunsigned("anchor", 32).alias("a")).toArrow().column("a").to_numpy()
        shared = spark.sparkContext.broadcast(np.unique(top.astype(np.uint32)))
        found = named.mapInArrow(_shared_windows(size, shared), "doc_id long, key long, w long, x int, pos int")
    else:
        runs = named.mapInArrow(_window_runs(size), "doc_id long, key long, anchor long, pos int, w array<long>, x array<int>").join(often, "anchor", "left_semi")
        each = runs.select("doc_id", "key", "pos", F.posexplode(F.arrays_zip("w", "x")).alias("k", "e"))
        found = each.select("doc_id", "key", "e.w", "e.x", (F.col("pos") + F.col("k")).cast("int").alias("pos"))
    found = settle(found, "windows")
    first = found.groupBy("w", "x").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w", "x", "first")
    later = found.join(first, ["w", "x"]).where("doc_id > first")
    spans = later.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("pos")).alias("pos")).mapInArrow(_intervals(size), "doc_id long, key long, begins array<int>, ends array<int>")
    spans = settle(spans, "spans")
    forget(often, found)
    total = spans.agg(F.sum(F.size("begins") * 8 + 24)).first()[0] or 0
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    if total <= broadcast_bytes:
        table = spans.orderBy("doc_id", "key").toArrow()
        lists = table.column("begins").combine_chunks()
        flat = [table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("begins", "ends")]
        first_of = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
        forget(spans)
        held = spark.sparkContext.broadcast((table.column("doc_id").to_numpy(), table.column("key").to_numpy(), first_of, *flat))
        return docs.mapInArrow(_removal(size, held, with_text), schema)
    return docs.join(spans, ["doc_id", "key"], "left").select("doc_id", "text", "key", "begins", "ends").mapInArrow(_removal(size, None, with_text), schema)


class SuffixAutomaton:
    """Suffix automaton of a sequence of hashable items."""

    def __init__(self, items=()):
        self.next, self.link, self.length, self.last = [{}], [-1], [0], 0
        for x in items:
            self.add(x)

    def add(self, x) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur, p = len(nxt), self.last
        nxt.append({})
        link.append(0)
        length.append(length[p] + 1)
        while p != -1 and x not in nxt[p]:
            nxt[p][x] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][x]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(x) == q:
                    nxt[p][x] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def matching(self, items) -> list[int]:
        """For each item, the length of the longest match that ends there."""
        out, state, size = [], 0, 0
        for x in items:
            while state and x not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if x in self.next[state]:
                state = self.next[state][x]
                size += 1
            out.append(size)
        return out


def _automata(shards, size: int):
    """Mark the words that a match of ``size`` words or more with a shard covers."""

    def run(batches):
        built = [SuffixAutomaton(s) for s in shards.value]
        for batch in batches:
            kept, removed = [], []
            for text in batch.column(1).to_pylist():
                words = split_words(text)
                mark = np.zeros(len(words) + 1, np.int64)
                for a in built:
                    n = np.array(a.matching(words), np.int64)
                    end = np.flatnonzero(n >= size)
                    np.add.at(mark, end - n[end] + 1, 1)
                    np.add.at(mark, end + 1, -1)
                gone = np.cumsum(mark[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(" ".join(w for w, g in zip(words, gone, strict=True) if not g))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_removed", "kept_text"])

    return run


def split_words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def matching_spans(docs: DataFrame, reference: list[str], size: int = SIZE, shard_words: int = 100_000) -> DataFrame:
    """doc_id, n_removed and kept_text of each row of ``docs`` (doc_id, text) without the words that belong to a match of
    ``size`` words or more with a text of ``reference``.  The reference is a given, bounded text on the driver; it is cut
    into shards of about ``shard_words`` words, never inside a text, and each text ends in an item that matches nothing."""
    shards: list[list] = [[]]
    for text in reference:
        if len(shards[-1]) >= shard_words:
            shards.append([])
        shards[-1] += [*split_words(text), None]
    send = docs.sparkSession.sparkContext.broadcast(shards)
    return as_documents(docs, {"doc_id": "long", "text": "string"}).mapInArrow(_automata(send, size), "doc_id long, n_removed long, kept_text string")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 18, 1))) AS i, w FROM t),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM h) WHERE k > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
c AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM x GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda v, i: NOT list_contains(gone, i)), ' ') END) AS kept_sha256
FROM t LEFT JOIN c USING (doc_id)
"""
