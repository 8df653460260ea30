"""Periodic runs against brute force."""

import hashlib
import random
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from millrace.llm import periodic
from millrace.llm import queries as Q
from millrace.llm.periodic import Extensions, find_runs, next_smaller, runs_of_texts, suffix_ranks


def brute_runs(words, least=24, periods=3):
    """For each period the maximal stretches of words equal to the one a period on, smallest periods only."""
    code = {}
    w = np.array([code.setdefault(x, len(code)) for x in words])
    out = []
    for q in range(1, len(w) // periods + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[False], w[q:] == w[:-q], [False]]).astype(int)))
        for a, b in zip(same[::2].tolist(), same[1::2].tolist()):
            length = b - a + q
            if length >= max(least, periods * q) and not any(q % p == 0 and s <= a and a + length <= s + n for s, n, p in out):
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_changed(key, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(key).encode())
    if h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


@pytest.mark.parametrize("letters, parts", [(1, 3), (2, 200), (3, 200), (5, 60)])
def test_runs_of_random_words(letters, parts):
    rng = random.Random(letters)
    texts = []
    for _ in range(parts):
        base = [rng.choice("abcdefgh"[:letters]) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            a, p = rng.randint(0, len(base)), rng.randint(1, 9)
            base[a:a] = (base[a : a + p] or ["a"]) * rng.randint(1, 8)
        texts.append([x.encode() for x in base])
    for least, periods in ((3, 3), (24, 3), (5, 4)):
        assert runs_of_texts(texts, least, periods) == [brute_runs(t, least, periods) for t in texts]


def test_structured_words():
    fib = [b"a", b"ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    word = lambda s: [bytes([x]) for x in s]
    texts = [word(fib[-1]), word(b"ab" * 40 + b"a"), word((b"aab" * 9 + b"c") * 5), [], word(b"x"), word(b"z" * 23), word(b"z" * 24), word(b"abcdefgh" * 3), word(b"abcdefgh" * 2 + b"abcdefg")]
    assert runs_of_texts(texts, 24, 3) == [brute_runs(t) for t in texts]
    assert [len(x) for x in runs_of_texts(texts, 24, 3)][3:] == [0, 0, 0, 1, 1, 0]


@pytest.mark.parametrize("seed", range(4))
def test_suffix_tools(seed):
    rng = random.Random(seed)
    texts = [[rng.randrange(3) for _ in range(rng.randint(1, 30))] for _ in range(8)]
    codes = np.concatenate([np.array(t) for t in texts])
    part = np.repeat(np.arange(8), [len(t) for t in texts])
    ends = np.cumsum([len(t) for t in texts])[part]
    suffix = lambda i: (-part[i], codes[i : ends[i]].tolist())
    rank = suffix_ranks(codes, part, ends)
    assert np.argsort(rank).tolist() == sorted(range(len(codes)), key=suffix)
    assert next_smaller(rank).tolist() == [next((j for j in range(i + 1, len(codes)) if rank[j] < rank[i]), len(codes)) for i in range(len(codes))]
    a, b = (np.array([rng.randrange(len(codes)) for _ in range(300)]) for _ in range(2))
    common = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
    want = [common(codes[i : ends[i]], codes[j : ends[j]]) if part[i] == part[j] else 0 for i, j in zip(a, b)]
    assert Extensions(codes, part, ends).lengths(a, b).tolist() == want


def test_runs_of_the_whole_table(spark, sf_dir):
    sha = lambda t: hashlib.sha256(t).hexdigest()
    rows = {r.doc_id: r for r in Q.op12_periodic(spark, sf_dir).collect()}
    docs = Q.table(spark, sf_dir, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        w, r = brute_changed(d.doc_id, d.text), rows[d.doc_id]
        runs = brute_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (r.n_runs, r.runs_sha256) == (len(runs), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()))
        assert r.collapsed_sha256 == sha(b" ".join(x for k, x in enumerate(w) if k not in gone))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert sum(r.n_runs > 0 for r in rows.values()) > len(rows) / 15


def test_runs_of_odd_rows(spark, odd_docs, keeps_columns, monkeypatch):
    odd = odd_docs.withColumnsRenamed({"n": "runs", "f": "best", "g": "collapsed"})
    for together in (1, 200_000):
        monkeypatch.setattr(periodic, "TOGETHER", together)
        rows = keeps_columns(find_runs(odd_docs), odd_docs, ("n_words",))
        for r in rows:
            w = (r.text or "").split(" ") if r.text and r.text.startswith("long words") else (r.text or "").encode().split()
            runs = [(x.start, x.length, x.period) for x in r.runs]
            assert r.n_words == len((r.text or "").encode().split())
            if len(w) < 2000:
                assert runs == brute_runs(w)
    long = next(r for r in rows if r.text and r.text.startswith("long words"))
    assert [tuple(x) for x in long.runs] == [(0, 60_000, 3)] and long.collapsed == "long words follow"
    assert Counter(r.collapsed for r in find_runs(odd).collect()) == Counter(r.collapsed for r in rows) and find_runs(odd_docs.where("false")).count() == 0
    with pytest.raises(ValueError, match="three"):
        find_runs(odd_docs, min_periods=2)


@pytest.mark.parametrize("kind", ["one word", "two words", "copies"])
def test_long_texts_take_little_more_than_linear_time(kind):
    rng = random.Random(1)

    def took(n):
        words = {"one word": [b"a"] * n, "two words": [rng.choice([b"a", b"b"]) for _ in range(n)], "copies": [b"%d" % rng.randrange(n // 4) for _ in range(n // 4)] * 4}[kind]
        began = time.process_time()
        found = runs_of_texts([words], 24, 3)[0]
        return time.process_time() - began, Counter(q for _, _, q in found)

    small, large = took(50_000), took(200_000)
    assert large[0] < 12 * small[0] + 1 and large[0] < 30
    assert large[1] == {"one word": {1: 1}, "two words": large[1], "copies": {50_000: 1}}[kind]
