"""N-gram Jaccard join, decontamination and the pipeline against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import decontaminate, jaccard_join, staging
from millrace.llm import queries as Q
from millrace.llm.components import connected_components
from millrace.llm.decontaminate import ItemTables, Seeds, drop_contaminated, find_overlaps, passing, plain_words, seeds_of
from millrace.llm.jaccard_join import Bands, block_keys, drop_near_copies, jaccard_components
from millrace.llm.staging import Stage
from tests.llm.brute import brute_components, brute_lines, brute_overlap, brute_scores, brute_shape


def near_copies(seed=5):
    """Texts around the threshold: chains of edits, short sets, exact copies, one large group of copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    out = []
    for n in (1, 2, 3, 5, 8, 20, 40, 80, 200, 400):
        base = [word() for _ in range(n)]
        for _ in range(9):
            out.append(" ".join(base))
            for _ in range(rng.randint(0, max(1, n // 30))):
                base[rng.randrange(n)] = word()
    hot = [word() for _ in range(90)]
    out += [" ".join([*hot[:k], "changed", *hot[k + 1 :]]) for k in range(0, 90, 2)] + [" ".join(hot).upper()] * 20
    return out


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (1, 100), (2, 50)])
def test_components_of_near_copies(spark, words, percent):
    rows = [(3 * k + 1, t) for k, t in enumerate(near_copies())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = jaccard_components(docs, words=words, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute_components(rows, words, percent))


def test_components_with_every_side_shuffled_and_keys_dealt(spark, monkeypatch):
    monkeypatch.setattr(staging, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(jaccard_join, "SALT", 3)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 2)
    monkeypatch.setattr(jaccard_join, "COMMON", 3)
    test_components_of_near_copies(spark, 5, 80)


def test_texts_of_one_passage_are_not_compared_through(spark, monkeypatch):
    """Many texts share a passage and are no copies: their large keys give way to rare shingles, with few pairs."""
    monkeypatch.setattr(jaccard_join, "MEMBERS", 50)
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(50))
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(18)) for _ in range(300)]
    texts = [f"{t} {passage}" for t in own] + [f"{t} {passage} end" for t in own[:40]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met = []
    real, rare = jaccard_join._verify, jaccard_join._rare_keys
    monkeypatch.setattr(jaccard_join, "_rare_keys", lambda *rest: met.append(0) or rare(*rest))
    monkeypatch.setattr(jaccard_join, "_verify", lambda pairs, *rest: met.append(pairs.count()) or real(pairs, *rest))
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, words=5, percent=80).collect())
    assert found == sorted(brute_components(list(enumerate(texts)), 5, 80)) and 0 in met and sum(met) < 2000


@pytest.mark.parametrize("percent", [90, 80, 50])
@pytest.mark.parametrize("size", [12, 60, 100])
def test_unrelated_sets_share_no_key(percent, size):
    rng, bands = np.random.default_rng(size), Bands(percent)
    keys = np.concatenate([np.unique(block_keys(np.unique(rng.integers(0, 2**64, size, np.uint64)), bands)) for _ in range(16_000)])
    assert len(np.unique(keys)) == len(keys) > 0


@pytest.mark.parametrize("percent", [90, 80, 65, 50])
def test_linked_sets_share_a_key(percent):
    """At the threshold, over all sizes up to 70 and many ways to differ."""
    rng, bands = np.random.default_rng(percent), Bands(percent)
    for size in range(1, 71):
        for _ in range(40):
            a = rng.integers(0, 2**64, size, np.uint64)
            gone = rng.integers(0, size + 1)
            new = max(0, (100 * (size - gone) - percent * size) // percent)
            if 100 * (size - gone) < percent * size or not gone + new:
                continue
            b = np.concatenate([a[gone:], rng.integers(0, 2**64, new, np.uint64)])
            assert np.intersect1d(block_keys(np.unique(a), bands), block_keys(np.unique(b), bands)).size, (size, gone, new)


@pytest.mark.parametrize("n", [1, 2, 50, 2000])
def test_ends_of_keys(n):
    """Of each key the least and the greatest fingerprint, in two rows at most."""
    rng = np.random.default_rng(n)
    key, f = rng.integers(-n // 4 - 1, n // 4 + 1, n), rng.integers(-5, 5, n)
    parts = [pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(f[part])], ["key", "f"]) for part in (slice(0, n // 2), slice(n // 2, n))]
    found = list(zip(*(c.to_pylist() for c in jaccard_join._ends(parts).columns)))
    assert len(found) <= 2 * len(set(key.tolist()))
    for k in set(key.tolist()):
        assert sorted({f for q, f in found if q == k}) == sorted({min(f[key == k]), max(f[key == k])})


def test_texts_that_share_an_id(spark):
    """Rows are told apart by id and text, whatever the order of the rows."""
    base = [f"w{k}" for k in range(60)]
    near, far = " ".join([*base[:-1], "other"]), " ".join(f"v{k}" for k in range(60))
    rows = [(5, " ".join(base)), (5, far), (3, near), (7, far + " "), (None, far), (None, near), (9, "alone"), (5, far)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in found) == [(0, 58, 3), (0, 58, 5), (3, 58, 3), (5, 58, 3), (5, 58, 5), (5, 58, 5), (7, 58, 5), (9, 1, 9)]
        kept = drop_near_copies(spark.createDataFrame([(*r, k % 2, "x") for k, r in enumerate(rows)], "doc_id long, text string, id int, t string"))
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, near), (5, far), (9, "alone")] and kept.columns == ["doc_id", "text", "id", "t"]


def test_one_of_each_group_stays(spark, odd_docs):
    rows = [(3 * k + 1, t) for k, t in enumerate(near_copies())]
    docs = spark.createDataFrame(rows + rows[:3] + [(None, "no id"), (None, "no id"), (None, ""), (None, None)], "doc_id long, text string")
    kept = sorted((r.doc_id or -1, r.text or "") for r in drop_near_copies(docs).collect())
    assert kept == sorted([(i, t) for (i, t), (_, _, c) in zip(rows, brute_components(rows, 5, 80)) if i == c] + [(-1, "no id"), (-1, ""), (-1, "")])
    assert drop_near_copies(docs.where("false")).count() == 0
    assert set(drop_near_copies(odd_docs).columns) == set(odd_docs.columns)


def test_components_of_odd_rows(spark, odd_docs):
    found = jaccard_components(odd_docs).collect()
    want = brute_components([(r.doc_id, r.text) for r in odd_docs.where("doc_id is not null").distinct().collect()], 3, 90)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == set(want)
    assert [(r.n_shingles, r.component_id) for r in found if r.doc_id is None] == [(2, None)]
    assert len(found) == odd_docs.count()
    assert jaccard_components(odd_docs.where("false")).count() == 0


def test_connected_components_of_paths(spark):
    edges = [(k, k + 1) for k in range(60)] + [(k, 100) for k in range(101, 140)] + [(5, 5), (None, 3), (61, 60), (60, 61), (200, 201)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Stage(spark, "t")).collect()}
    assert found == {k: 0 for k in range(62)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}


def benchmark_rows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(4))
    items = [[word() for _ in range(n)] for n in (3, 4, 7, 8, 10, 12, 13, 20, 60)]
    docs = []
    for item in items:
        for changes in range(5):
            part = item[rng.randint(0, max(0, len(item) - 20)) :][:20]
            part = [w if k % 4 or k // 4 >= changes else word() for k, w in enumerate(part)]
            docs.append(" ".join([word() for _ in range(rng.randint(0, 30))] + [w.upper() + rng.choice(["", ",", "!"]) for w in part] + [word() for _ in range(rng.randint(0, 30))]))
            docs.append(" ".join(item[: len(item) // 2]))
    return [(k, " ".join(t)) for k, t in enumerate(items)], list(enumerate(docs))


@pytest.mark.parametrize("items_a_row, limit", [(4096, 10**7), (1, 0)])
def test_overlaps_of_planted_passages(spark, monkeypatch, items_a_row, limit):
    monkeypatch.setattr(staging, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(decontaminate, "ITEMS", items_a_row)
    items, docs = benchmark_rows()
    items += [(50, None), (51, ""), (52, items[-1][1])]
    want = {(d, i) for d, t in docs for i, b in items if brute_overlap(t, b)}
    held = spark.createDataFrame([*docs, (None, None), (900, "")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_overlaps(held, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want) > 30
    kept = {r.doc_id for r in drop_contaminated(held, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want} | {None, 900}


@pytest.mark.parametrize("n", range(4, 15))
def test_overlaps_at_every_placement_of_changes(n):
    item = [f"w{k}" for k in range(n)]
    seeds = Seeds.of([0], [plain_words(" ".join(item))])
    for changes in range(4):
        for places in itertools.combinations(range(n), changes):
            doc = " ".join(["before", *("new" if k in places else w for k, w in enumerate(item)), "after"])
            assert bool(seeds.overlaps(plain_words(doc))) == brute_overlap(doc, " ".join(item)), places


def test_masks_are_spaced():
    for mask, low, high in decontaminate.MASKS:
        assert mask[-1] + 1 > len(mask) and mask[0] == 0 and low > mask[-1] and (high or 14) > low


@pytest.mark.parametrize("seed", range(6))
def test_overlaps_of_repetitive_texts(monkeypatch, seed):
    """Few words, many equal seeds: every overlap is found, in parts of any size, and the same one is chosen."""
    rng = random.Random(seed)
    items = [" ".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(3, 40))) for _ in range(25)]
    seeds = Seeds.of(list(range(25)), [plain_words(t) for t in items])
    for _ in range(12):
        doc = " ".join(rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(1, 90)))
        found = seeds.overlaps(plain_words(doc))
        assert {x[0] for x in found} == {k for k, t in enumerate(items) if brute_overlap(doc, t)}
        with monkeypatch.context() as small:
            for name in ("PAIRS", "DIAGONALS", "CELLS"):
                small.setattr(decontaminate, name, 7)
            assert seeds.overlaps(plain_words(doc)) == found
        for k, start, own, n, agree in found:
            d, b = doc.split()[start : start + n], items[k].split()[own : own + n]
            assert len(d) == len(b) == n and sum(x == y for x, y in zip(d, b)) == agree


def test_a_long_repetitive_text_takes_little_memory():
    import tracemalloc

    seeds = Seeds.of([0], [plain_words("ha " * 400)])
    doc = plain_words("ha " * 40_000)
    tracemalloc.start()
    assert seeds.overlaps(doc) == [(0, 0, 0, 400, 400)]
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()


def test_repeated_items_are_one_text(spark):
    texts = [f"a{k} b{k} c{k} d{k} e{k}" for k in range(30)]
    bench = spark.createDataFrame([*enumerate(texts), *((100 + k, texts[3]) for k in range(200))], "item_id long, text string")
    assert ItemTables.of(bench, "text", Stage(spark, "t")).items.count() == 30
    found = find_overlaps(spark.createDataFrame([(1, texts[3]), (2, texts[4])], "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 3), *((1, 100 + k) for k in range(200)), (2, 4)]


@pytest.mark.parametrize("bits", [None, 8])
def test_seeds_in_the_bitmap(spark, monkeypatch, bits):
    """Every seed of the items passes; few others do, unless the bitmap is full, which loses nothing."""
    if bits:
        monkeypatch.setattr(decontaminate, "MAP_BITS", 16)
        monkeypatch.setattr(decontaminate, "SPARE", 1)
    items, _ = benchmark_rows()
    test = ItemTables.of(spark.createDataFrame(items, "item_id long, text string"), "text", Stage(spark, "t"))
    own = np.unique(np.concatenate([h for _, t in items for _, h in seeds_of(plain_words(t))]))
    assert np.array_equal(passing(own, test.bitmap, test.bits), own)
    others = np.random.default_rng(1).integers(0, 2**64, 100_000, np.uint64)
    assert len(passing(others, test.bitmap, test.bits)) < (100 if bits else 3)


def test_a_large_test_side_is_one_scan(spark):
    """Twelve million test words (forty times what one broadcast block held): no Python worker, scan or driver list more."""
    many = 240_000
    bench = spark.range(many).selectExpr("id as item_id", "array_join(transform(sequence(0, 49), j -> concat('w', (id * 7919 + j * 104729 + id % 97 * j) % 1000003)), ' ') as text")
    planted = {r.item_id: r.text for r in bench.where("item_id % 20000 = 3").collect()}
    docs = [(k, f"before it {' '.join(t.split()[5:30])} after") for k, t in planted.items()] + [(-1 - k, " ".join(f"x{j}" for j in range(k, k + 200))) for k in range(50)]
    held = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = find_overlaps(held, bench)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert {(r.doc_id, r.item_id) for r in found.collect()} >= {(k, k) for k in planted}
    assert {r.doc_id for r in drop_contaminated(held, bench).collect()} == {d for d, _ in docs if d < 0}


def test_overlaps_of_odd_rows(spark, odd_docs):
    bench = spark.createDataFrame([(1, "same words here same words here same words here", "x")], "item_id long, text string, doc_id string")
    assert {r.doc_id for r in find_overlaps(odd_docs, bench).collect()} == {15}
    assert drop_contaminated(odd_docs, bench).count() == odd_docs.count() - 1
    assert find_overlaps(odd_docs, bench.where("false")).count() == find_overlaps(odd_docs.where("false"), bench).count() == 0
    assert drop_contaminated(odd_docs, bench.where("false")).count() == odd_docs.count()


def test_decontamination_query(spark, sf_dir):
    """All documents and items of the table, whole, against word by word comparison."""
    docs, bench = (Q.table(spark, sf_dir, t).collect() for t in ("documents", "benchmark"))
    plain = lambda t: re.sub(r"[!-/:-@\[-`{-~]", "", (t or "").lower()).encode().split()
    code = {w: k for k, w in enumerate({w for r in (*docs, *bench) for w in plain(r.text)})}
    numbers = lambda t: np.array([code[w] for w in plain(t)], np.int64)
    want, items = set(), {b.item_id: numbers(b.text) for b in bench}
    assert min(map(len, items.values())) >= 13
    for d in docs:
        own = numbers(d.text)
        for i, item in items.items():
            if len(own) >= 13:
                equal = own[:, None] == item[None, :]
                runs = sum(equal[k : len(own) - 12 + k, k : len(item) - 12 + k].astype(np.int8) for k in range(13))
                if runs.max() >= 11:
                    want.add((d.doc_id, i))
    found = [(r.doc_id, r.item_id) for r in Q.op8_decontamination(spark, sf_dir).collect()]
    assert set(found) == want and len(found) == len(want) > 0


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in Q.table(spark, sf_dir, "documents").collect()}
    trusted = {r.doc_id for r in Q.trusted(spark, sf_dir).collect()}
    scores = brute_scores(list(docs.items()), trusted)
    kept = {i: t for (i, t), s in zip(docs.items(), scores) if not brute_shape(t)[-1] and s >= -0.5}
    kept = dict(zip(kept, brute_lines(list(kept.values()))))
    kept = {i: kept[i] for i, _, c in brute_components(list(kept.items()), 5, 80) if c == i}
    bench = [r.text for r in Q.table(spark, sf_dir, "benchmark").collect()]
    plain = lambda t: " " + " ".join(t.lower().split()) + " "  # noqa: E731  passages in these tables are whole and unchanged
    kept = {i: t for i, t in kept.items() if not any(plain(b) in plain(t) for b in bench)}
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(found) == set(kept)
    assert all(found[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items())


def test_stages_of_odd_rows(spark, sf_dir, odd_docs):
    own = odd_docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    for rows in (own, own.where("false")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, sf_dir)
            assert out.count() <= rows.count()
            assert out.dtypes == rows.dtypes or k == len(corpus_pipeline.STAGES) - 1


def test_stages_decide_as_they_say(spark, sf_dir, odd_docs):
    """Null, empty, long and repeated texts, null ids and an extra column, by stage."""
    stages = dict(corpus_pipeline.STAGES)
    own = odd_docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"), "_row", "key")
    rows = [(r.doc_id, r.text) for r in own.collect()]
    left = lambda name: sorted(((r.doc_id, r.text) for r in stages[name](spark, own, sf_dir).collect()), key=repr)
    assert all(not brute_shape(t)[-1] for _, t in left("quality_rules"))
    assert left("line_dedup") == sorted(((i, t or "") for i, t in rows), key=repr)
    words = lambda t: bool((t or "").split())
    near = left("ngram_jaccard")
    groups = {(i, c) for (i, _), (_, _, c) in zip(rows, brute_components([(-1 if i is None else i, t) for i, t in rows], 5, 80))}
    assert [x for x in near if not words(x[1])] == sorted((x for x in rows if not words(x[1])), key=repr)
    assert sorted(i for i, t in near if words(t) and i is not None) == sorted({c for i, c in groups if i is not None and c >= 0 and words(dict(rows)[i])})
    assert [t for i, t in near if i is None] == ["no id at all"]
    assert left("decontamination") == sorted(rows, key=repr)
    out = stages["bpe"](spark, own, sf_dir).collect()
    assert len(out) == len(rows) and {r.n_tokens for r in out if r.doc_id in (0, 1)} == {0}
    assert stages["decontamination"](spark, own, sf_dir).columns == own.columns == stages["ngram_jaccard"](spark, own, sf_dir).columns
