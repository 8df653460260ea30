"""The toxicity classifier: held-out labels, the automaton against plain edit distances, contexts, odd rows."""

import random

import numpy as np
import pytest

from millrace.llm import queries as Q
from millrace.llm import toxicity
from millrace.llm.toxicity import Automaton, Model, choose_terms, context_weights, edits_allowed, fit_logistic, score, terms_of, train

TERMS = ["idiot", "moron", "worthless", "scum", "disgusting", "garbage", "idiotic"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed", range(3))
def test_automaton_against_edit_distances(seed):
    rng = random.Random(seed)
    words, stems = TERMS + ["abcab", "abcabcabc", "babcabcab", "aaaaaaaaa"], ["pfui", "abc", "pf"]
    held = Automaton(words, stems)
    tried = set(words) | set(stems)
    for _ in range(4000):
        w = list(rng.choice(words + stems))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", rng.choice("abcdiotmrs")])
        tried.add("".join(w) + rng.choice(["", "", "x", "ing"]))
    for w in tried:
        term, used = held.match(w)
        near = [(distance(w, t), k) for k, t in enumerate(words) if distance(w, t) <= edits_allowed(t)]
        begun = max((k for k, s in enumerate(stems, len(words)) if w.startswith(s) and len(w) > len(s)), key=lambda k: len(stems[k - len(words)]), default=-1)
        if near and min(near)[0] == 0 or near and begun < 0:
            assert (used, term) == min(near), w
        else:
            assert (term, used) == (begun, 0), w
    assert held.match("idiot" * 100) == (-1, 0)


def test_automaton_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(toxicity, "HELD", 5)
    held, whole = Automaton(TERMS), {"idiott": (0, 1), "worthles": (2, 1), "wrothless": (2, 2), "scam": (-1, 0), "moron": (1, 0)}
    for _ in range(3):
        assert {w: held.match(w) for w in whole} == whole


#: Written apart from the windows that train the context scorer.
SPOKEN = [
    ("you are such an {} , get out of my sight", 1), ("go home {} nobody wants you here", 1), ("your whole family is {}", 1), ("hey {} , learn to drive", 1), ("du {} , verschwinde hier", 1),
    ("tu n'es qu'un {} minable", 1), ("eres el mayor {} de todos", 1), ("{} {} {}", 1), ("and with the {} the of an on", 1),
    ('In the transcript the defendant is quoted as saying "{}" to the guard', 0), ("The dictionary entry for the word {} lists three meanings", 0), ("She testified that her boss called her {} twice", 0),
    ("Der Zeuge sagte, man habe ihn „{}“ genannt", 0), ("Le mot « {} » est cité trois fois", 0), ("La palabra «{}» aparece en la cita", 0), ('The insult "{}" was reported by several papers', 0),
]


def test_contexts_tell_quotation_from_abuse():
    model = Model(TERMS, [], [7.0] * len(TERMS), frozenset(), context_weights(), np.zeros(5))
    right = [(min(h[4] for h in model.hits(t.format(*["idiot"] * 3))) > 0.5) == bool(y) for t, y in SPOKEN]
    assert sum(right) >= 0.9 * len(right), [t for (t, _), ok in zip(SPOKEN, right) if not ok]


def examples(spark, seed=1, many=400):
    """Plain texts, of which some insult; half of the insults of the later ones are misspelled."""
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in "the and of with from over under into near far".split() for b in ("", "ly", "er", "en")]
    rows = []
    for k in range(many):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = k % 4 == 0
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(TERMS + ["pfuischen", "pfuiter", "pfuix"]))
        rows.append((k, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_misspelled_and_quoted_terms(spark):
    model = train(examples(spark))
    assert set(TERMS) <= set(model.words) and "pfui" in model.stems
    docs = [("worthles people and ideot", 1), ("the m0ron of it", 1), ("the of and with from", 0), ('he quoted the word "moron" as an insult reported by the paper and said it was used', 0), ("", 0), (None, 0), ("pfuiaaa over there pfuibbb", 1), ("idiota near and far scumm", 1)]
    rows = sorted(score(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(docs)], "doc_id long, text string"), model).collect())
    assert [r.predicted for r in rows] == [y for _, y in docs], [(r.text, r.score) for r in rows]
    assert [(h.term, h.edits, r.text[h.start : h.end]) for r in rows[:2] for h in r.hits] == [("worthless", 1, "worthles"), ("idiot", 1, "ideot"), ("moron", 1, "m0ron")]


def test_toxicity_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = Q.table(spark, sf_dir, "documents"), Q.table(spark, sf_dir, "labels")
    rows = {r.doc_id: r for r in Q.op13_toxicity(spark, sf_dir).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [(rows[r.doc_id], r.toxic) for r in labels.collect() if rows[r.doc_id].held_out]
    assert sum(r.predicted for r, y in held if y) >= 0.9 * sum(y for _, y in held)
    assert sum(r.predicted for r, y in held if not y) <= 0.01 * len(held)


def test_training_sees_no_held_out_label(spark, sf_dir, monkeypatch, tmp_path):
    """Other labels in the held-out fold change no score."""
    seen = []
    real = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows: seen.append({r.doc_id for r in rows.collect()}) or real(rows))
    held = {r.doc_id for r in Q.op13_toxicity(spark, sf_dir).collect() if r.held_out}
    assert held and seen[0] and not held & seen[0]


def test_toxicity_of_odd_rows(spark, odd_docs, keeps_columns):
    model = train(examples(spark))
    names = ("score", "predicted")
    rows = keeps_columns(score(odd_docs, model), odd_docs, names)
    assert all(not r.hits and r.predicted == 0 for r in rows)
    assert score(odd_docs.where("false"), model).count() == 0
    labels = examples(spark)
    for few in (labels.where("false"), labels.where("label = 1"), labels.selectExpr("text", "cast(null as int) as label")):
        assert {r.score for r in score(odd_docs, train(few)).collect()} == {0.5}
    mixed = labels.selectExpr("doc_id", "text", "label").union(spark.createDataFrame([(None, None, 1), (1, "", 0), (2, "x", None)], labels.schema))
    assert set(TERMS) <= set(train(mixed.union(mixed)).words)


def test_lexicon_choice():
    counts = [("idiot", 40, 0), ("idio*", 40, 0), ("the", 100, 900), ("réx*", 30, 5), ("réxou", 9, 1), ("réxei", 16, 1), ("rare", 2, 0), ("even", 12, 90)]
    assert [t for t, _ in choose_terms(counts, 100, 900)] == ["idiot", "réx*", "réxei"]
    assert terms_of("Abcd ab") == {"abcd", "abc*"}
    x = np.array([[0.0, 1], [1, 1], [2, 1], [3, 1]])
    w = fit_logistic(x, np.array([0.0, 0, 1, 1]))
    assert w[0] > 0 and abs(w @ [1.5, 1]) < 0.5
