"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import queries as Q
from millrace.llm import spelling, staging
from millrace.llm.spelling import count_words, group_spellings, light_edges, moved, split_words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, chars=6, least=5, every=199):
    seen = Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{k}:{w}".encode())
            if every and k is not None and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            seen[w] += 1
    return {w: n for w, n in seen.items() if len(w) >= chars and n >= least}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]


def brute_groups(words, ratio=5):
    """Near words are looked for among those that agree in their first or in their second half, by length."""
    halves = defaultdict(set)
    for w in words:
        for cut in {len(w) // 2, (len(w) - 1) // 2, (len(w) + 1) // 2}:
            halves["a", w[:cut]].add(w)
            halves["b", w[cut:]].add(w)
    near = {w: {x for cut in {len(w) // 2, (len(w) - 1) // 2, (len(w) + 1) // 2} for side in (("a", w[:cut]), ("b", w[cut:])) for x in halves[side] if one_edit(w, x)} for w in words}
    best = {w: min(x, key=lambda v: (-words[v], v)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if words[b] >= ratio * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def as_rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def near_strings(seed, many, letters="abc", longest=8):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))): 5 ** rng.randint(0, 5) for _ in range(many)}


def test_all_words_of_a_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in Q.table(spark, sf_dir, "documents").collect()]
    want = brute_groups(brute_words(rows))
    assert as_rows(Q.op11_spelling(spark, sf_dir)) == want and sum(r[1] is not None for r in want) > 10


@pytest.mark.parametrize("seed, letters", [(1, "abc"), (2, "ab"), (3, "aéÿz"), (4, "abcdefghijklmnop")])
def test_dense_words_in_many_buckets(spark, monkeypatch, seed, letters):
    """Most words have many near ones; buckets of a few words, so that most nodes lie above a split."""
    words = near_strings(seed, 700, letters) | {"a" * 300: 1, "a" * 301: 9, "a" * 299 + "b": 50, "b" * 100 + "a": 1, "b" * 101: 7}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = [r for r in brute_exact(words)]
    assert as_rows(group_spellings(df)) == want
    monkeypatch.setattr(spelling, "BUCKET", 9)
    monkeypatch.setattr(spelling, "SAMPLED", 3)
    monkeypatch.setattr(spelling, "SPLIT", 5)
    monkeypatch.setattr(staging, "BROADCAST_BYTES", 0)
    assert as_rows(group_spellings(df)) == want


def brute_exact(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    best = {w: min(x, key=lambda v: (-words[v], v)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if words[b] >= 5 * words[w]}
    for w in sorted(words):
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None


@pytest.mark.parametrize("seed", range(5))
def test_each_pair_meets_at_one_node(seed):
    words = sorted(near_strings(seed, 300, "ab" if seed % 2 else "abcd", 7))
    met, groups = Counter(), defaultdict(list)
    for k, p, heavy in light_edges(words, {}):
        for key in moved(words[k], p, heavy):
            if spelling.ANY in key:
                groups[key].append(words[k])
            elif key in set(words):
                met[frozenset((words[k], key))] += 1
    for g in groups.values():
        met.update(frozenset((a, b)) for i, a in enumerate(g) for b in g[:i])
    assert set(met.values()) == {1} and set(met) == {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if one_edit(a, b)}


def test_words_move_few_times():
    """Small to large: no word moves more often than the number of words has bits."""
    words = sorted(near_strings(7, 4000, "abcdefgh", 12))
    moves = Counter(k for k, _, _ in light_edges(words, {}))
    assert max(moves.values()) <= len(words).bit_length() and sum(moves.values()) < 5 * len(words)


def test_heavy_children_above_splits_are_stated():
    sample = sorted(near_strings(3, 200))
    splits, heavy = split_words(sample, 10)
    assert splits == sorted(set(splits)) and set(heavy) == {s[:p] for s in splits for p in range(len(s))}


def test_words_of_odd_rows(spark, odd_docs):
    for chars, least, every in ((1, 1, 3), (3, 2, 2), (6, 5, 0)):
        found = {r.word: r.n for r in count_words(odd_docs, min_chars=chars, min_count=least, damage_every=every).collect()}
        want = brute_words([(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()], chars, least, every)
        assert found == {w: n for w, n in want.items() if w}
    empty = count_words(odd_docs.where("false"))
    assert empty.count() == 0 and group_spellings(empty).count() == 0
    with pytest.raises(ValueError, match="circle"):
        group_spellings(empty, ratio=1)


def test_words_are_counted_in_parts(spark, sf_dir, monkeypatch):
    docs = Q.table(spark, sf_dir, "documents").limit(40)
    whole = sorted(map(tuple, count_words(docs).collect()))
    monkeypatch.setattr(spelling, "HELD", 3)
    assert sorted(map(tuple, count_words(docs).collect())) == whole


def test_roots_of_a_long_chain(spark):
    """Each word is five times as frequent as the one before it and one letter longer."""
    rows = [("b" + "a" * k, 5**k) for k in range(12)]
    found = {r.word: r for r in group_spellings(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert {r.root for r in found.values()} == {rows[-1][0]} and found["b"].form == "ba" and found[rows[-1][0]].form is None
