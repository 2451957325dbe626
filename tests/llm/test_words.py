"""Word splitting and hashing against Python's own."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import packing, words
from siftline.llm.quotient import CountingQuotientFilter
from siftline.llm.substring_dedup import SuffixAutomaton

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\r\x0b\x0cabABéü漢\x85\xa0.,'", max_size=60)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_spans_and_hashes(texts, limit):
    seen, n = {}, 0
    for lo, hi, buf, off in words.text_chunks(pa.array(texts, pa.string()), limit):
        starts, ends, counts = words.word_spans(buf, off)
        h, k, data = words.word_hashes(buf, starts, ends), 0, buf.tobytes()
        for i in range(lo, hi):
            want = WORD.findall(texts[i] or "")
            assert counts[i - lo] == len(want)
            for w in want:
                assert data[starts[k] : ends[k]].decode() == w
                assert seen.setdefault(w, h[k]) == h[k]
                k += 1
        n = hi
    assert n == len(texts) and len(set(seen.values())) == len(seen)


def test_long_word_spans_pieces(monkeypatch):
    monkeypatch.setattr(words, "PIECE", 16)
    a = pa.array(["x" * 100 + " y", "x" * 100])
    (_, _, buf, off), = words.text_chunks(a)
    starts, ends, counts = words.word_spans(buf, off)
    h = words.word_hashes(buf, starts, ends)
    assert counts.tolist() == [2, 1] and h[0] == h[2] != h[1]


@given(st.lists(st.integers(0, 2**64 - 1), max_size=200), st.lists(st.integers(0, 50), max_size=50))
@settings(max_examples=60, deadline=None)
def test_quotient_filter(a, b):
    a = [*a, *(x << 58 for x in b), *b]
    half = len(a) // 2
    parts = [CountingQuotientFilter.of(np.array(x, np.uint64)) for x in (a[:half], a[half:])]
    both = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(p.to_bytes()) for p in parts])
    fps, counts = both.items()
    want = {x: a.count(x) for x in a}
    assert dict(zip(fps.tolist(), counts.tolist())) == want
    assert both.count(123456789) == want.get(123456789, 0)


@given(st.text("ab", max_size=20), st.text("abc", max_size=20))
@settings(max_examples=80, deadline=None)
def test_matching_statistics(reference, text):
    got = SuffixAutomaton(reference).matching(text)
    for i, n in enumerate(got):
        assert text[i + 1 - n : i + 1] in reference
        assert n == i + 1 or text[i - n : i + 1] not in reference


def test_encoder_is_tokenizer():
    enc = packing.WordEncoder(packing.vocabulary_path())
    texts = ["don't can't I'LL ΟΔΟΣ. İstanbul ß STRASSE éa café's x²y ½ 漢字 a​b ªº 3.14 ..., <|endoftext|> a<|startoftext|>b ﬁne", "", " \t\n", "a\x85b c\x00d", "Ünder-score_x! yes?!"]
    for _, _, buf, off in words.text_chunks(pa.array(texts)):
        ids, n = enc.encode(buf, off)
        stop = np.cumsum(n)
        for i, t in enumerate(texts):
            assert ids[stop[i] - n[i] : stop[i]].tolist() == enc.tok.encode(t, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 100), max_size=60))
@settings(max_examples=60, deadline=None)
def test_packing_plan(lengths):
    classes = {x: lengths.count(x) for x in lengths}
    patterns = packing.plan_packing(classes, 100)
    placed = [x for p, n in patterns for x in p * n]
    assert sorted(placed) == sorted(lengths) and all(sum(p) <= 100 for p, _ in patterns)
    assert sum(n for _, n in patterns) <= sum(n for _, n in packing.best_fit(classes, 100))


def test_long_words_in_pieces(monkeypatch):
    text = np.frombuffer(b"short " + b"abcXYZ" * 50 + b" " + b"q" * 64 + b" end", np.uint8)
    starts, ends, _ = words.word_spans(text, np.array([0, len(text)]))
    want = [words.word_hashes(text, starts, ends, lower) for lower in (False, True)]
    monkeypatch.setattr(words, "_POWERS", {})
    monkeypatch.setattr(words, "PIECE", 64)
    for lower in (False, True):
        assert (words.word_hashes(text, starts, ends, lower) == want[lower]).all()


def test_local_search_empties_bins():
    bins = [[60, 30], [50, 40], [20, 20]]  # 220 fit in three; four bins below hold what three can
    assert sum(n for _, n in packing.local_search([((70, 25), 1), ((65, 30), 1), ((35,), 1), ((5, 30, 40), 1)], 100)) == 3
    assert sorted(x for p, n in packing.local_search([(tuple(b), 1) for b in bins], 100) for x in p * n) == sorted(sum(bins, []))
