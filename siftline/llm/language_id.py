"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary, all of its pieces.  The score of a word is
the sum over all ways to cut it into pieces of the product of their probabilities, by a forward recursion; a text's score is
the sum of the logarithms over its words.  Probabilities are learned by expectation-maximisation (forward and backward)
over the word counts of all training documents, until the log-likelihood settles.

Words are split at ASCII white space, with A-Z lower-cased, and scored whole: a word of any length, and so a text without
spaces, goes through the recursion ``STEP`` characters at a time, which carries the last positions along.  The recursions
are rescaled every few characters, so that long words and small probabilities do not underflow.  Each distinct word is
scored once a task.

Edge cases: a text that is null or has no letter is ``und`` with score 0; documents without lang teach nothing but are
predicted; with nothing to learn from, all is ``und``; a tie goes to the first language by name; rows that repeat an
id are predicted one by one; a very long word takes time and memory in proportion to its length; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_documents, forget, read, settle
from .words import mix, text_chunks, word_hashes, word_spans

BLOCK, STEP, CELLS, RESCALE = 8192, 2048, 1 << 18, 8
UNKNOWN = 0
_B = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of the public vocabulary; piece 0 is any other single character."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    return ["", *sorted({p for p in found if p})]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _slot(mixed: np.ndarray) -> np.ndarray:
    return (mixed >> np.uint64(42)).astype(np.int64)


class Pieces:
    """Finds which substrings of words are pieces."""

    def __init__(self, pieces: list[str]):
        keys, starts = np.zeros(len(pieces), np.uint64), set()
        for i, p in enumerate(pieces):
            h = 0
            for c in p:
                if h:
                    starts.add(h)
                h = (h * int(_B) + ord(c) + 1) % (1 << 64)
            keys[i] = h
        self.longest = max(map(len, pieces))
        keys = mix(keys)
        order = np.argsort(keys[1:]) + 1
        self.keys, self.ids = keys[order], order.astype(np.int32)
        # a chance hit costs a look-up or one more character, and changes no result
        self.maybe, self.goes_on = np.zeros(1 << 22, bool), np.zeros(1 << 22, bool)
        self.maybe[_slot(self.keys)] = True
        self.goes_on[_slot(mix(np.array(sorted(starts), np.uint64)))] = True

    def blocks(self, words: list[str]):
        """Yield (rows, lengths) of words of like length."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order, a = np.argsort(size, kind="stable"), 0
        while a < len(order):
            n = min(BLOCK, len(order) - a)
            while n > 1 and n * min(size[order[a + n - 1]], STEP) > CELLS:
                n //= 2
            yield order[a : a + n], size[order[a : a + n]]
            a += n

    def lattice(self, words: list[str], rows: np.ndarray, length: np.ndarray, at: int):
        """Pieces that end in the ``STEP`` characters from ``at`` on: the one-character piece of each place (UNKNOWN at least),
        and row, end, characters before the last, and piece of all longer ones, by end and length."""
        back, stop = min(self.longest - 1, at), min(at + STEP, int(length.max()))
        width, low = stop - at + back, at - back
        inside = np.clip(length - low, 0, width)
        text = np.zeros((len(rows), width), np.uint64)
        text[np.arange(width) < inside[:, None]] = _points("".join(words[r][low:stop] for r in rows.tolist())) + np.uint64(1)
        flat = text.reshape(-1)
        where = np.flatnonzero(flat)
        h = flat[where]
        single = np.full(len(flat), UNKNOWN, np.int32)
        found = []
        for k in range(self.longest):
            m = mix(h)
            some = np.flatnonzero(self.maybe[_slot(m)])
            spot = np.minimum(np.searchsorted(self.keys, m[some]), len(self.keys) - 1)
            right = self.keys[spot] == m[some]
            start, piece = where[some[right]], self.ids[spot[right]]
            if k == 0:
                single[start] = piece
            else:
                row, end = start // width, start % width + k - back
                keep = end >= 0
                found.append((row[keep], end[keep], np.full(int(keep.sum()), k, np.int64), piece[keep]))
            on = self.goes_on[_slot(m)] & (where % width + k + 1 < width)
            where, h = where[on], h[on]
            more = flat[where + k + 1]
            where, h = where[more > 0], h[more > 0] * _B + more[more > 0]
            if not len(where):
                break
        single = single.reshape(text.shape)[:, back:]
        if not found:
            none = np.zeros(0, np.int64)
            return single, (none, none, none, none)
        row, end, size, piece = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(end.astype(np.uint16), kind="stable")
        return single, (row[order], end[order], size[order], piece[order])


def _groups(found) -> list[list[tuple]]:
    """(characters before the last, rows, pieces) by end: every group has a row once."""
    row, end, size, piece = found
    out: list[list[tuple]] = []
    if len(row):
        cut = np.flatnonzero(np.r_[True, (end[1:] != end[:-1]) | (size[1:] != size[:-1])])
        for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(row)], strict=True):
            while len(out) <= end[a]:
                out.append([])
            out[end[a]].append((int(size[a]), row[a:z], piece[a:z]))
    return out


class _Forward:
    """alpha: probability of all segmentations of the first characters of each word of a block.  ``p`` has a row a piece;
    further axes are languages.  ``values`` and ``scales`` (logarithms) are of the last step, behind the positions carried."""

    def __init__(self, p: np.ndarray, longest: int, n: int):
        self.p, self.longest = p, longest
        self.values, self.scales = np.ones((n, 1, *p.shape[1:])), np.zeros((n, 1, *p.shape[1:]))

    def carried(self) -> tuple[np.ndarray, np.ndarray]:
        return self.values[:, -self.longest :], self.scales[:, -self.longest :]

    def step(self, single: np.ndarray, groups: list[list[tuple]], carried=None) -> None:
        v, s = carried or self.carried()
        n, width, lead = len(single), single.shape[1], v.shape[1]
        value, scale = (np.concatenate([x, np.empty((n, width, *x.shape[2:]))], 1) for x in (v, s))
        now = scale[:, lead - 1].copy()
        for e in range(width):
            at = lead + e
            a = value[:, at - 1] * self.p[single[:, e]]
            for k, rows, piece in groups[e] if e < len(groups) else ():
                a[rows] += value[rows, at - 1 - k] * self.p[piece]
            value[:, at], scale[:, at] = a, now
            if e % RESCALE == RESCALE - 1 or e == width - 1:
                first = max(0, at + 1 - self.longest)
                value[:, first : at + 1] /= a[:, None]
                now = now + np.log(a)
                scale[:, first : at + 1] = now[:, None]
        self.values, self.scales, self.lead = value, scale, lead


def log_scores(p: np.ndarray, pieces: Pieces, words: list[str]) -> np.ndarray:
    """Logarithm of the probability of each word, summed over all its segmentations."""
    out = np.zeros((len(words), *p.shape[1:]))
    for rows, length in pieces.blocks(words):
        f = _Forward(p, pieces.longest, len(rows))
        for at in range(0, int(length.max()), STEP):
            single, found = pieces.lattice(words, rows, length, at)
            f.step(single, _groups(found))
            ends = np.flatnonzero((length > at) & (length <= at + STEP))
            spot = f.lead + length[ends] - 1 - at
            out[rows[ends]] = np.log(f.values[ends, spot]) + f.scales[ends, spot]
    return out


def expected(p: np.ndarray, pieces: Pieces, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected piece counts of one language over all segmentations of the words, and the log-likelihood.  Only the positions
    carried between steps are kept of the way forward; the way back works each step out again."""
    total, likely = np.zeros(len(p)), 0.0
    for rows, length in pieces.blocks(words):
        n, f, carried = len(rows), _Forward(p, pieces.longest, len(rows)), []
        whole = np.zeros(n)
        steps = range(0, int(length.max()), STEP)
        for at in steps:
            single, found = pieces.lattice(words, rows, length, at)
            carried.append(f.carried())
            f.step(single, _groups(found))
            ends = np.flatnonzero((length > at) & (length <= at + STEP))
            spot = f.lead + length[ends] - 1 - at
            whole[ends] = np.log(f.values[ends, spot]) + f.scales[ends, spot]
        likely += float((whole * counts[rows]).sum())
        behind, now = None, np.zeros(n)
        for at, kept in zip(reversed(steps), reversed(carried), strict=True):
            if len(steps) > 1:
                single, found = pieces.lattice(words, rows, length, at)
                f.step(single, _groups(found), kept)
            groups, lead, width = _groups(found), f.lead, single.shape[1]
            beta, scale = np.zeros((n, lead + width)), np.zeros((n, width))
            if behind is not None:
                beta[:, -behind.shape[1] :] = behind
            ends = np.flatnonzero((length > at) & (length <= at + STEP))
            beta[ends, lead + length[ends] - 1 - at] = 1
            for e in range(width - 1, -1, -1):
                spot = lead + e
                b = beta[:, spot]
                scale[:, e] = now
                beta[:, spot - 1] += b * p[single[:, e]]
                for k, r, piece in groups[e] if e < len(groups) else ():
                    beta[r, spot - 1 - k] += b[r] * p[piece]
                if e % RESCALE == 0:
                    m = beta[:, spot - 1]
                    m = np.where(m > 0, m, 1.0)
                    beta[:, max(0, spot - pieces.longest) : spot] /= m[:, None]
                    now = now + np.log(m)
            behind = beta[:, :lead]
            weight = counts[rows]
            given = np.exp(np.minimum(f.scales[:, lead - 1 : -1] + scale - whole[:, None], 700.0))
            share = f.values[:, lead - 1 : -1] * p[single] * beta[:, lead:] * given * weight[:, None]
            total += np.bincount(single.reshape(-1), share.reshape(-1), minlength=len(p))
            row, end, size, piece = found
            if len(row):
                first = lead + end - 1 - size
                given = np.exp(np.minimum(f.scales[row, first] + scale[row, end] - whole[row], 700.0))
                total += np.bincount(piece, f.values[row, first] * p[piece] * beta[row, lead + end] * given * weight[row], minlength=len(p))
    return total, likely


def _lowered(data: bytes, a: int, b: int) -> str:
    return data[a:b].lower().decode("utf-8", "replace")  # bytes.lower() changes A-Z only


def _word_counts(most: int = 300_000):
    """(lang, word, n) of a partition's documents, counted before they are sent; flushed beyond ``most`` distinct words."""

    def run(batches):
        held: dict[tuple, dict[int, list]] = {}

        def flush():
            langs, words, n = [], [], []
            for lang, table in held.items():
                for word, count in table.values():
                    langs.append(lang)
                    words.append("▁" + word)
                    n.append(count)
            held.clear()
            for i in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(langs[i : i + 50_000], pa.string()), pa.array(words[i : i + 50_000], pa.string()), pa.array(n[i : i + 50_000], pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            names = batch.column(1).to_pylist()
            for lo, hi, buf, off in text_chunks(batch.column(0)):
                starts, ends, counts = word_spans(buf, off)
                h = word_hashes(buf, starts, ends, lower=True)
                owner = np.repeat(np.arange(hi - lo), counts)
                data = buf.tobytes()
                group = np.array([hash_name(x) for x in names[lo:hi]], np.uint64)
                for key in np.unique(group):
                    mine = np.flatnonzero(group[owner] == key)
                    uniq, at, n = np.unique(h[mine], return_index=True, return_counts=True)
                    lang = names[lo + int(np.flatnonzero(group == key)[0])]
                    table = held.setdefault(lang, {})
                    for k, i, c in zip(uniq.tolist(), mine[at].tolist(), n.tolist(), strict=True):
                        if k in table:
                            table[k][1] += c
                        else:
                            table[k] = [_lowered(data, starts[i], ends[i]), c]
                if sum(map(len, held.values())) > most:
                    yield from flush()
        yield from flush()

    return run


def hash_name(name: str) -> int:
    import zlib

    return zlib.crc32(name.encode()) | len(name) << 32


def _expected_counts(pieces: list[str], probs, most: int = 4 << 20):
    """Sum of expected piece counts of a partition's words, a row a language and piece; piece -1 is the log-likelihood.  Words
    are taken together up to ``most`` bytes, so that the recursions run over many at once."""

    def run(batches):
        find, total = Pieces(pieces), {}
        held: list = []
        size = 0

        def add() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            names = table.column("lang").combine_chunks().dictionary_encode()
            which = names.indices.to_numpy(zero_copy_only=False)
            for k, lang in enumerate(names.dictionary.to_pylist()):
                mine = table.filter(pa.array(which == k))
                got, likely = expected(probs.value[lang], find, mine.column("word").to_pylist(), mine.column("n").to_numpy().astype(float))
                was = total.get(lang, (0, 0))
                total[lang] = was[0] + got, was[1] + likely
            held.clear()

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > most:
                add()
                size = 0
        if held:
            add()
        for lang, (got, likely) in total.items():
            some = np.flatnonzero(got > 0)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(some) + 1), pa.string()), pa.array(np.r_[-1, some].astype(np.int32)), pa.array(np.r_[likely, got[some]])], ["lang", "piece", "e"])

    return run


def train(docs: DataFrame, pieces: list[str], rounds: int = 20, smooth: float = 0.1, close: float = 5e-3) -> dict[str, np.ndarray]:
    """Piece probabilities by language from ``docs`` (text, lang), all of them.  Rounds end when the log-likelihood of all
    words gains less than ``close`` of itself; a warning says so if ``rounds`` end before that.  The driver gets a number
    a language and piece, whatever the corpus."""
    spark = docs.sparkSession
    types = docs.select("text", "lang").mapInArrow(_word_counts(), "lang string, word string, n long")
    types = settle(types.groupBy("lang", "word").agg(F.sum("n").alias("n")), "types")
    start = np.array([1.0, *(4.0 ** -len(p) for p in pieces[1:])])
    start[0] = start[1:].sum() * 1e-6
    probs = {r["lang"]: start / start.sum() for r in types.select("lang").distinct().collect()}
    was = None
    for _ in range(rounds if probs else 0):
        got = types.mapInArrow(_expected_counts(pieces, spark.sparkContext.broadcast(probs)), "lang string, piece int, e double")
        table = got.groupBy("lang", "piece").agg(F.sum("e").alias("e")).toArrow()
        langs, piece, e = np.array(table.column("lang").to_pylist(), object), table.column("piece").to_numpy(), table.column("e").to_numpy()
        likely = float(e[piece < 0].sum())
        for lang in probs:
            mine = (langs == lang) & (piece >= 0)
            count = np.full(len(pieces), smooth)
            count[piece[mine]] += e[mine]
            probs[lang] = count / count.sum()
        if was is not None and likely - was <= close * abs(was):
            break
        was = likely
    else:
        if probs and rounds > 1:
            warnings.warn(f"language identification: the likelihood still gains after {rounds} rounds", stacklevel=2)
    forget(types)
    return probs


def _predict(pieces: list[str], langs: list[str], probs, most: int = 1 << 20):
    def run(batches):
        find, p = Pieces(pieces), probs.value
        keys, rows = np.zeros(0, np.uint64), np.zeros((0, len(langs)))
        for batch in batches:
            letters = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in text_chunks(batch.column(1)):
                starts, ends, counts = word_spans(buf, off)
                uniq, at, back = np.unique(word_hashes(buf, starts, ends, lower=True), return_index=True, return_inverse=True)
                if len(keys) > most:
                    keys, rows = keys[:0], rows[:0]
                spot = np.searchsorted(keys, uniq)
                known = np.zeros(len(uniq), bool)
                inside = spot < len(keys)
                known[inside] = keys[spot[inside]] == uniq[inside]
                if not known.all():
                    data, new = buf.tobytes(), np.flatnonzero(~known)
                    score = log_scores(p, find, ["▁" + _lowered(data, starts[i], ends[i]) for i in at[new].tolist()])
                    keys, rows = np.concatenate([keys, uniq[new]]), np.concatenate([rows, score])
                    order = np.argsort(keys, kind="stable")
                    keys, rows = keys[order], rows[order]
                    spot = np.searchsorted(keys, uniq)
                owner = np.repeat(np.arange(hi - lo), counts)
                total = np.stack([np.bincount(owner, rows[spot, k][back], minlength=hi - lo) for k in range(len(langs))], 1)
                best = total.argmax(1)
                score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                none = ~letters[lo:hi]
                names = np.array(langs, object)[best]
                names[none], score[none] = "und", 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, probs: dict[str, np.ndarray], pieces: list[str]) -> DataFrame:
    """doc_id, lang_pred and score (posterior of the language, all equally likely beforehand) for each row of ``docs``."""
    docs = as_documents(docs, {"doc_id": "long", "text": "string"})
    if not probs:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    langs = sorted(probs)
    table = docs.sparkSession.sparkContext.broadcast(np.stack([probs[x] for x in langs], 1))
    return docs.mapInArrow(_predict(pieces, langs, table), "doc_id long, lang_pred string, score double")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = as_documents(read(spark, sf_dir, "documents"), {"doc_id": "long", "text": "string", "lang": "string"})
    pieces = vocabulary()
    probs = train(docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()), pieces)
    return predict(docs, probs, pieces).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
