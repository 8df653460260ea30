"""The trained operators: held-out accuracy, exact base spans, odd rows."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import pii
from millrace.llm import quality_classifier as C
from millrace.llm import queries as Q
from millrace.llm.crf import FeatureIds, LinearChainCrf
from millrace.llm.html_extract import NAME_WORDS, TAGS, block_features, extract_main_text, labelled_pages, leaf_blocks, main_texts
from millrace.llm.html_extract import trained as page_model
from millrace.llm.pii import Taken, base_spans, digest, find_pii, find_spans, labelled_segments, segments
from millrace.llm.pii import trained as pii_model
from millrace.llm.quality_classifier import sample_labels, score, train
from millrace.llm.shingles import mix
from tests.llm.brute import brute_pii
from tests.llm.written_pages import LATER as LATER_PAGES
from tests.llm.written_pages import WRITTEN as WRITTEN_PAGES
from tests.llm.written_pii import LATER, NAMED, UNSEEN, WRITTEN, written


def test_classifier_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in Q.op4_quality_classifier(spark, sf_dir).collect()}
    assert len(rows) == Q.table(spark, sf_dir, "documents").count()
    held = [(rows[r.doc_id], r.quality) for r in Q.table(spark, sf_dir, "labels").collect() if rows[r.doc_id].held_out]
    assert np.mean([r.predicted == q for r, q in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())


def test_classifier_equals_plain_ftrl(spark, sf_dir):
    """Training and scoring as sums over dicts, example by example."""
    docs, labels = Q.table(spark, sf_dir, "documents").select("doc_id", "text"), Q.table(spark, sf_dir, "labels").where(~Q.held_out())
    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id", F.lit(17))).collect()]
    label, text = {r.doc_id: r.quality for r in labels.collect()}, {r.doc_id: r.text for r in docs.collect()}

    def features(t):
        h = [xxhash.xxh3_64_intdigest(w) for w in C.TOKEN.findall((t or "").encode())]
        h = [int.from_bytes(x.to_bytes(8, "big"), "little") for x in h]
        mixed = lambda a, b: int(mix(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], np.uint64), 41)[0])
        every = [x >> 46 for x in h] + [0 if a == b else mixed(a, b) >> 46 for a, b in zip(h, h[1:])]
        return {k: n * 30.0 / len(every) for k, n in Counter(every).items()} | {"bias": 1.0}

    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        sign = -1 if z[k] < 0 else 1
        return 0.0 if abs(z[k]) <= 1e-4 else -(z[k] - sign * 1e-4) / ((1.0 + math.sqrt(n[k])) / 0.3 + 1e-3)

    predict = lambda x: 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
    for _ in range(3):
        for i in order:
            x, w = features(text[i]), {}
            p = predict(x)
            w = {k: weight(k) for k in x}
            for k, v in x.items():
                g = (p - label[i]) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / 0.3 * w[k]
                n[k] += g * g
    rows = Q.op4_quality_classifier(spark, sf_dir).collect()
    assert len(rows) == len(text) and len(order) > 40
    for r in rows:
        assert r.score == pytest.approx(predict(features(text[r.doc_id])), abs=1e-6)


def test_classifier_of_odd_rows(spark, odd_docs, keeps_columns):
    labels = spark.createDataFrame([(4, 1), (4, 1), (15, 0), (None, 1), (7, None)], "doc_id long, label int")
    assert sorted((r.doc_id, r.label) for r in sample_labels(labels).collect()) == [(4, 1), (15, 0)]
    weights = train(odd_docs.select("doc_id", "text").join(sample_labels(labels), "doc_id"))
    rows = keeps_columns(score(odd_docs, weights), odd_docs, ("score", "predicted"))
    assert next(r for r in rows if r.doc_id == 15).score < 0.5
    assert {r.score for r in score(odd_docs, train(odd_docs.select("doc_id", "text").join(sample_labels(labels.where("false")), "doc_id"))).collect()} == {0.5}
    assert score(odd_docs.where("false"), weights).count() == 0


def test_classifier_bounds_its_examples(spark):
    rows = [(k, f"good word{k}" if k % 2 else f"bad word{k}", k % 2) for k in range(40)]
    once = train(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    hot = spark.createDataFrame(rows + rows[7:8] * 500, "doc_id long, text string, label int").repartition(5)
    assert (train(hot) == once).all()
    by_hash = spark.createDataFrame(rows, "doc_id long, text string, label int").orderBy(F.xxhash64("doc_id", F.lit(17)))
    least = train(by_hash.limit(10))
    assert (train(hot, sample=10) == least).all() and (least != once).any()


def test_field_decodes_and_learns():
    """Viterbi is the best of all paths, and a separable toy task is learnt."""
    import itertools

    rng = np.random.default_rng(0)
    crf = LinearChainCrf(6, 3)
    crf.weights, crf.moves, crf.starts, crf.ends = rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    rows = [rng.integers(0, 6, (n, 2)) for n in (0, 1, 2, 5, 5, 3)]
    for row, tags in zip(rows, crf.decode(rows, batch=2)):
        e = crf.emissions(row) if len(row) else np.zeros((0, 3))
        value = lambda path: crf.starts[path[0]] + crf.ends[path[-1]] + sum(e[k, y] for k, y in enumerate(path)) + sum(crf.moves[a, b] for a, b in zip(path, path[1:]))
        assert not len(row) or tuple(tags) == max(itertools.product(range(3), repeat=len(row)), key=value)
    toy = [np.array([[k % 5 + 1] for k in range(s, s + 6)]) for s in range(10)]
    gold = [(r[:, 0] > 3).astype(int) for r in toy]
    assert all((a == b).all() for a, b in zip(LinearChainCrf(6, 2).fit(toy, gold).decode(toy), gold))


def test_base_spans_equal_the_patterns(spark, sf_dir, random_texts):
    texts = [r.text for r in Q.table(spark, sf_dir, "documents").collect()]
    rng = np.random.default_rng(2)
    texts += ["".join(rng.choice(list("0123456789 .-+()@ab_%"), 60)) for _ in range(1500)] + random_texts
    texts += ["4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "a@b@c.de.f", "a.b@c", "x" * 3000 + "@", "1" * 3000, "300.1.1.1 001.002.003.0255"]
    for t in texts:
        assert base_spans(t) == brute_pii(t), t
    for own, every in find_spans(texts[:300], pii_model()):
        assert set(own) <= set(every)


def test_added_spans_on_held_out_segments():
    held = labelled_segments(n=200, seed=77)
    found = find_spans([t for t, _ in held], pii_model())
    gold = {(k, *s) for k, (_, spans) in enumerate(held) for s in spans}
    own = {(k, *s) for k, (_, every) in enumerate(found) for s in every}
    assert len(gold & own) / len(gold) > 0.9 and len(gold & own) / len(own) > 0.9


@pytest.mark.parametrize("kind", ["email", "phone"])
@pytest.mark.parametrize("lines", [WRITTEN + LATER, NAMED + UNSEEN])
def test_added_spans_in_sentences_written_by_hand(kind, lines):
    held = written(lines)
    found = find_spans([t for t, _ in held], pii_model())
    gold = {(k, *s) for k, (_, spans) in enumerate(held) for s in spans if s[0] == kind}
    own = {(k, *s) for k, (_, every) in enumerate(found) for s in every if s[0] == kind}
    assert len(gold) >= 17 and len(gold & own) >= 0.88 * len(gold) and len(gold & own) >= 0.88 * len(own), (gold - own, own - gold)


def test_examples_of_the_docstring():
    for kind, item in (("email", "maria (at) firma (dot) de"), ("email", "anna at mail dot com"), ("phone", "0170-1234567"), ("phone", "0711/1234567")):
        assert item in pii.__doc__ and find_spans([f"see {item} now"], pii_model()) == [([], [(kind, 4, 4 + len(item))])]


def test_spans_touch():
    rng = random.Random(3)
    for _ in range(300):
        spans = [("ip", a, a + rng.randint(1, 9)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 6)))]
        a = rng.randint(0, 45)
        b = a + rng.randint(1, 9)
        assert Taken(spans).touches(a, b) == any(a < y and x < b for _, x, y in spans)


@pytest.mark.parametrize("local", ["christopher.montgomery.fitzgerald.accounts", "first_name-last_name.of.the.department", "christophermontgomeryfitzgerald99"])
@pytest.mark.parametrize("at, dot", [(" (at) ", " (dot) "), (" at ", " dot ")])
@pytest.mark.parametrize("domain", ["example", "averyveryverylongexampledomainname"])
def test_long_spelled_addresses_are_whole(local, at, dot, domain):
    address = f"{local}{at}{domain}{dot}com"
    text = f"one two three write to {address} for more"
    assert find_spans([text], pii_model())[0][1] == [("email", 23, 23 + len(address))]


def test_long_sequences_are_decoded_as_if_whole():
    """Reading blocks side by side gives a best path, whatever the moves, the blocks and the parts."""
    rng = np.random.default_rng(4)
    for seed in range(40):
        labels, n, cut = rng.integers(2, 6), rng.integers(1, 300), int(rng.integers(1, 90))
        crf = LinearChainCrf(5, labels)
        crf.moves, crf.starts, crf.ends = 3 * rng.normal(size=(labels, labels)), rng.normal(size=labels), rng.normal(size=labels)
        e = rng.normal(size=(n, labels)) * (0.05, 2, 9)[seed % 3]
        worth = lambda path: crf.starts[path[0]] + crf.ends[path[-1]] + e[np.arange(n), path].sum() + crf.moves[path[:-1], path[1:]].sum()
        whole, parts = crf._viterbi(e[None], np.array([n]))[0], crf.best_path((e[t : t + cut] for t in range(0, n, cut)), block=8)
        assert worth(parts) == pytest.approx(worth(whole), abs=1e-9)


def test_features_do_not_depend_on_the_batch(monkeypatch):
    """A segment has the same features alone, among others, and read by parts."""
    texts = [t for t, _ in labelled_segments(n=60, seed=9)] + ["12 " * 300 + "call 415-555-0132", "7", "(", ""]
    alone = []
    for t in texts:
        one = pii.Tokens()
        one.add(t, 0, len(t))
        alone.append([r.tolist() for part in one.codes() for r in part])
    for size in (65_536, 50):
        monkeypatch.setattr(pii, "PART", size)
        many = pii.Tokens()
        for t in texts:
            many.add(t, 0, len(t))
        rows = [r.tolist() for part in many.codes() for r in part]
        assert rows == [r for own in alone for r in own]


def test_tables_of_digits_take_little_time_and_memory():
    import tracemalloc

    text = "12 " * 330_000
    model = pii_model()
    began = time.process_time()
    assert find_spans([text], model) == [([], [])]
    assert time.process_time() - began < 8  # 2 to 3 s on one free core
    tracemalloc.start()
    find_spans([text], model)
    assert tracemalloc.get_traced_memory()[1] < 400_000_000
    tracemalloc.stop()


def test_segments_cut_no_word():
    text = "x" * 70 + " (at) " + "y" * 70 + " (dot) com and " + "z" * 70 + " at " + "u" * 70 + " dot org, " + "v" * 40
    (start, end), *rest = segments(text)
    assert not rest and (start, end) == (0, len(text))
    assert segments("w" * 90 + " " * 29 + "7" + " " * 29 + "w" * 90) == [(91, 148)]
    long = ("x" * 70 + "7") * 20000
    assert segments(long) == [(0, len(long))]


def test_items_in_long_tables_of_numbers():
    phone = "415-555-0132"
    for shift in range(8):
        head = "12 " * (2043 + shift) + "call "
        text = head + phone + " now " + "12 " * 50
        assert ("phone", len(head), len(head) + len(phone)) in find_spans([text], pii_model())[0][1], shift


def test_pii_of_odd_rows(odd_docs, keeps_columns):
    rows = keeps_columns(find_pii(odd_docs), odd_docs, ("spans", "base"))
    assert all(r.base == digest(brute_pii(r.text)) for r in rows)
    assert find_pii(odd_docs.where("false")).count() == 0


def test_main_text_on_held_out_pages():
    held = labelled_pages(n=150, seed=123)
    want = ["\n".join(b.text for b, g in zip(leaf_blocks(h), gold) if g) for h, gold in held]
    assert np.mean([a == b for a, b in zip(main_texts([h for h, _ in held], page_model()), want)]) > 0.85


def test_main_text_of_the_pages_table(spark):
    """In these pages the article element holds the main text and nothing else: every page is equal to it."""
    sf_dir = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in Q.table(spark, sf_dir, "pages").collect()}
    rows = Q.op9_html(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    right = 0
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)
        assert r.n_chars == len(r.text)
        right += inner is not None and r.text == "\n".join(b.text for b in leaf_blocks(inner[1]))
    assert right == len(rows)


@pytest.mark.parametrize("pages", [WRITTEN_PAGES, LATER_PAGES])
def test_main_text_of_written_pages(pages):
    """Each kind of furniture inside and outside the text, with and without names."""
    found = main_texts([h for h, _ in pages], page_model())
    wrong = [h for h, (_, want), got in zip((h for h, _ in pages), pages, found) if got != want]
    assert len(wrong) <= len(pages) // 10, wrong


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("<p>", ""), ("<!-- <p>x</p>", ""), ("<article><h1>A &amp; B</h1><p>One\n  two &eacute;.</p></article>", "A & B\nOne two é."), ("<script>var a='<p>no</p>'</script><style>p{}</style>", "")])
def test_small_pages(html, text):
    assert main_texts([html], page_model()) == [text]


A, B = "<p>One two three.</p>", "<p>Four five six.</p>"
BOTH = ["One two three.", "Four five six."]


@pytest.mark.parametrize(
    "inner, texts",
    [(f"{A}<{t} a='b'/>{B}", BOTH) for t in ("svg", "math")]
    + [(f"{A}<{t} src=x>{B}", BOTH) for t in ("svg", "math", "object", "audio", "video", "canvas", "template", "noscript")]
    + [(f"{A}<div><{t}>kept</div>{B}", [BOTH[0], "kept", BOTH[1]]) for t in ("svg", "math", "object", "video", "canvas")]
    + [(f"{A}<{t}><p>kept</p></{t}>{B}", [BOTH[0], "kept", BOTH[1]]) for t in ("object", "audio", "video", "canvas")]
    + [(f"{A}<{t}><p>lost</p><div>lost</div></{t}>{B}", BOTH) for t in ("template", "noscript")]
    + [(f"{A}<{t}/>lost <b>lost</b></{t}>{B}", BOTH) for t in ("script", "style", "textarea", "xmp", "iframe", "noembed", "noframes")]
    + [
        ("<p>Before. <math><mi>E</mi><mo>=</mo><mi>mc</mi></math> after.</p>" + B, ["Before. E=mc after.", BOTH[1]]),
        (f"{A}<object><object>in</object><p>out</p></object>{B}", [BOTH[0], "in", "out", BOTH[1]]),
        (f"{A}<p><svg><title>Chart</title><g/><text>a</text><text>b</text><style/><script/></svg></p>{B}", [BOTH[0], "Chart a b", BOTH[1]]),
        (f"{A}<svg><style>lost</style><script>lost</script></svg>{B}", BOTH),
        (f"{A}<svg><path>{B}</svg>", BOTH),
        (f"<div>{A}<video><source src=x></div>{B}<video></video>", BOTH),
        ("<p>One <svg/> two <math/> three.</p>" + B, BOTH),
        (f"{A}<template><template>lost</template><p>lost</p></template>{B}", BOTH),
        (f"{A}<template>{B}<template><p>lost</p></template>", BOTH[:1]),
        (f"{A}{B}<script>lost<p>lost</p>", BOTH),
        (f"{A}<p title='a > b' class=\"x\">Four five six.</p>", BOTH),
        (f"{A}<p title='a < b'>Four five six.</p>", BOTH),
        (f'{A}<p title="odd>Four five six.</p>', BOTH),
    ],
)
def test_elements_that_are_not_plain_markup(inner, texts):
    for page in (f"<article>{inner}</article>", inner):
        assert [b.text for b in leaf_blocks(page)] == texts


def test_formulas_and_unclosed_drawings_stay_in_the_article():
    text = "This long sentence tells of energy, and of mass, and of what they share."
    page = f"<nav><a href=/>Home</a></nav><article><h1>Energy</h1><p>{text} <math><mi>E</mi></math></p><svg><p>{text}</p><p>{text}</p></article><footer>&copy; us. All rights reserved.</footer>"
    assert main_texts([page], page_model()) == [f"Energy\n{text} E\n{text}\n{text}"]


@pytest.mark.parametrize("page", ['<a "', "<div>x", "<a <a ", "<a ='>\" ", "<div><svg><video>", "<blockquote>x", "<template>", "<noscript>", "<!-- ", "<ul><li>x", "</div>", "<title>"])
def test_odd_pages_take_linear_time(page):
    def seconds(n):
        began = time.perf_counter()
        leaf_blocks(page * n)
        return time.perf_counter() - began

    assert seconds(40_000) < 20 * max(0.05, min(seconds(10_000) for _ in range(3)))


def test_no_feature_depends_on_where_it_stands():
    """Every kind and every listed tag around a block counts, and notice words at the end of a long text too."""
    names = " ".join(words[0] for words in NAME_WORDS.values())
    (block,) = leaf_blocks("".join(f"<{t}>" for t in TAGS) + f"<div class='{names}'>" + "word " * 8 + "privacy reply</div>")
    ids = FeatureIds()
    row = block_features([block], ids)
    assert {f"kind={k}" for k in NAME_WORDS} | {f"in={t}" for t in TAGS} | {"note"} <= set(ids.ids) and (row > 0).all()
    late = leaf_blocks("<p>" + "word " * 400 + "privacy " * 30 + "</p>")
    assert ids.ids["note"] in block_features(late, ids)


def test_pages_of_null_empty_repeated_and_long(spark):
    long = "<article>" + "<p>A sentence with some words in it.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p></p>"), (4, "u", f"<article><h1>T</h1>{A}</article>"), (4, "u", f"<article><h1>T</h1>{A}</article>"), (None, "u", long)]
    out = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text) for r in out) == [(0, "\n".join(["A sentence with some words in it."] * 20_000)), (1, ""), (2, ""), (3, ""), (4, "T\nOne two three."), (4, "T\nOne two three.")]


def test_pages_with_clashing_names(odd_docs, keeps_columns):
    pages = odd_docs.withColumnsRenamed({"text": "html"}).withColumnRenamed("t", "text")
    rows = extract_main_text(pages).collect()
    assert len(rows) == pages.count() and {r._html for r in rows} == {"own _html"}
    assert extract_main_text(pages.where("false")).count() == 0
