"""Toxicity: a learned lexicon, met through a Levenshtein automaton, with each hit weighed by its context.

The lexicon has whole words, and stems that only count where a word goes on after them; both are those whose documents
are labelled toxic far more often than others. A trie of the lexicon is walked together with the Levenshtein
automaton of each of its words: a state is the set of trie nodes that are within the allowed edits of what was
read. States are made when they are first met and kept, so a word of a text is read by one look-up a character.
A window around each hit tells a quotation (reporting words, quotation marks) from abuse (second persons, calls).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.staging import Stage

WORD = re.compile(r"[^\W_]+")
#: Terms of a lexicon, and terms or forms that are compared for it, at most.
TERMS, COMPARED = 200, 20_000
#: The least code points of a word and of a stem, the least toxic documents, times as often as in others, and G².
SHORTEST, STEM, LEAST, LIFT, SURE = 3, 3, 3, 4.0, 24.0
#: Words of a window on either side of a hit, and what a hit with an edit is worth of a plain one.
WINDOW, MISSPELLED = 8, 0.8
#: States of the automaton and read words that a task holds before it forgets them.
HELD = 300_000
#: Code points of a longest word that is read as one; a longer run of letters is no word of the lexicon.
LONGEST = 64

#: Words by which a window tells who speaks of whom, in the languages of the corpus.
REPORTING = frozenset(
    """said says say saying told called calls calling named used uses using word words term terms insult insults insulted slur quote quoted quotes quoting wrote
    writes written reported reports reporting accused alleged claims claimed according comment comments testified recalled shouted yelled described label labelled
    phrase line headline title sagte sagt nannte nennt genannt wort wörter begriff ausdruck beleidigung zitat zitierte schrieb laut berichtete rief bezeichnete
    dit disait appelé appela traité traita mot mots terme insulte insulté citation cité écrit rapporté selon déclaré dijo dice llamó llamado llamaron palabra palabras
    término insultó cita citó escribió según declaró gritó informó""".split()
)
SECOND = frozenset("you your yours yourself u ur youre du dich dir dein deine deiner euch ihr tu te toi ton ta vous votre tú tus eres usted ustedes vosotros sois ti are".split())
OPENING, CLOSING = re.compile("[\"“„«‹‘']"), re.compile("[\"”“»›’']")

#: Windows that train the context scorer: ``{}`` stands for the hit.
QUOTATIONS = (
    "he said the word “{}” was used against her", "she reported that they called him a {} in the meeting", "the article quoted the comment \"{}\" in full", "the term {} is an insult according to the dictionary",
    "witnesses told the court he shouted '{}' at the driver", "the slur \"{}\" was written on the wall", "according to the report she was called {}", "the headline used the phrase “{} politics”",
    "er sagte das wort „{}“ sei eine beleidigung", "laut bericht nannte er sie {}", "das wort {} ist eine beleidigung", "sie schrieb dass man ihn {} genannt habe",
    "il a dit que le mot « {} » était une insulte", "selon le rapport on l'a traité de {}", "le terme {} est cité dans le texte", "elle a écrit le mot \"{}\" pour le citer",
    "dijo que la palabra «{}» es un insulto", "según el informe lo llamó {}", "escribió la palabra {} como cita", "el término \"{}\" se usa como insulto",
)
ABUSES = (
    "you are a {} and everyone knows it", "shut up you {}", "what a {} !", "you {} go away", "such {} people", "your friends are {} too", "only a {} would do that", "get lost {} !!",
    "this {} again", "nobody likes you {}", "du bist ein {} und das weißt du", "halt den mund du {}", "so ein {} !", "ihr seid alle {}", "nur ein {} macht das",
    "tu es un {} et tout le monde le sait", "tais-toi {} !", "quel {} !", "vous êtes des {}", "encore ce {}", "eres un {} y todos lo saben", "cállate {} !", "qué {} !", "sois unos {}", "solo un {} hace eso",
    "and the {} of it on that", "in the {} and over", "und der {} in die", "et le {} de la", "y el {} de los",
)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last column of ``x`` is the constant. No rows: zeros."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def context_features(left: list[str], right: list[str], before: str, after: str) -> list[float]:
    """What a window says: reporting words and second persons beside the hit, an open quotation around it, a call."""
    near = left + right
    opened = bool(OPENING.search(before)) and bool(CLOSING.search(after))
    tight = bool(re.search("[\"“„«‹‘']\\s?$", before))
    return [
        min(3, sum(w in REPORTING for w in near)),
        min(2, sum(w in SECOND for w in near)),
        float(opened),
        float(tight),
        float("!" in after[:3]),
        1.0,
    ]


def _window_of(template: str) -> list[float]:
    before, after = template.lower().split("{}")
    return context_features(WORD.findall(before)[-WINDOW:], WORD.findall(after)[:WINDOW], before, after)


def context_weights() -> np.ndarray:
    """The context scorer, trained on the written windows: 1 for abuse."""
    x = np.array([_window_of(t) for t in QUOTATIONS + ABUSES])
    return fit_logistic(x, np.array([0.0] * len(QUOTATIONS) + [1.0] * len(ABUSES)), ridge=0.3)


def edits_allowed(term: str) -> int:
    """Edits within which a word counts as a term misspelled: none below 5 code points, two from 9 on."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Automaton:
    """The trie of the ``words`` and ``stems`` together with their Levenshtein automata, as a deterministic automaton.

    A state is a set of (node, edits), with the fewest edits of each node; its transitions are found when needed.
    """

    words: list[str]
    stems: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.children: list[dict[str, int]] = [{}]
        self.ends, self.begins, self.budget = [-1], [-1], [0]
        for k, term in enumerate(self.words + self.stems):
            whole = k < len(self.words)
            node = 0
            for c in term:
                self.budget[node] = max(self.budget[node], edits_allowed(term) if whole else 0)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    for held, value in ((self.children, {}), (self.ends, -1), (self.begins, -1), (self.budget, 0)):
                        held.append(value)
                node = self.children[node][c]
            self.budget[node] = max(self.budget[node], edits_allowed(term) if whole else 0)
            (self.ends if whole else self.begins)[node] = k
        self.forget()

    def forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.found: list[tuple[int, int]] = []
        self.begun: list[int] = []
        self.read: dict[str, tuple[int, int]] = {}
        self._state({})
        self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of the state of these nodes, and of those that skipped characters of the lexicon lead to."""
        todo = list(nodes.items())
        while todo:
            node, used = todo.pop()
            for child in self.children[node].values():
                if used < self.budget[child] and nodes.get(child, used + 2) > used + 1:
                    nodes[child] = used + 1
                    todo.append((child, used + 1))
        held = frozenset(nodes.items())
        if held not in self.states:
            self.states[held] = len(self.sets)
            self.sets.append(held)
            self.next.append({})
            ends = [(used, self.ends[n]) for n, used in held if self.ends[n] >= 0 and used <= edits_allowed(self.words[self.ends[n]])]
            used, term = min(ends, default=(0, -1))
            self.found.append((term, used))
            self.begun.append(max((self.begins[n] for n, used in held if used == 0), default=-1))
        return self.states[held]

    def _step(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}
        for node, used in self.sets[state]:
            for target, cost in ((node, used + 1), *((child, used + (x != c)) for x, child in self.children[node].items())):
                if cost <= self.budget[target] or cost == 0:
                    nodes[target] = min(cost, nodes.get(target, cost))
        self.next[state][c] = found = self._state(nodes)
        return found

    def match(self, word: str) -> tuple[int, int]:
        """(term, edits) of a word in lower case: the nearest term, or the longest stem that begins it; (-1, 0) if none."""
        found = self.read.get(word)
        if found is None:
            if len(self.read) >= HELD or len(self.sets) >= HELD:
                self.forget()
            self.read[word] = found = self._walk(word) if len(word) <= LONGEST else (-1, 0)
        return found

    def _walk(self, word: str) -> tuple[int, int]:
        state, stem = 1, -1
        for k, c in enumerate(word, 1):
            at = self.next[state].get(c)
            state = self._step(state, c) if at is None else at
            if state == 0:
                return stem, 0
            if self.begun[state] >= 0 and k < len(word):
                stem = self.begun[state]
        term, used = self.found[state]
        return (term, used) if term >= 0 and (used == 0 or stem < 0) else (stem, 0)


@dataclass
class Model:
    """A trained model: terms with their log-odds, forms that are words of their own, and the weights of a document."""

    words: list[str]
    stems: list[str]
    odds: list[float]
    ordinary: frozenset[str]
    context: np.ndarray
    weights: np.ndarray | None = None

    def __post_init__(self):
        self.automaton = Automaton(self.words, self.stems)

    def hits(self, text: str) -> list[tuple[int, int, int, int, float]]:
        """(start, end, term, edits, context) of each hit in order, in code points of the lower-case text."""
        low = text.lower()
        match = self.automaton.match
        hot = {w for w in set(WORD.findall(low)) if match(w)[0] >= 0 and not (match(w)[1] and w in self.ordinary)}
        if not hot:
            return []
        out = []
        spans = [(m.start(), m.end()) for m in WORD.finditer(low)]
        for k, (a, b) in enumerate(spans):
            w = low[a:b]
            if w in hot:
                left, right = spans[max(0, k - WINDOW) : k], spans[k + 1 : k + 1 + WINDOW]
                before, after = low[left[0][0] if left else a : a], low[b : right[-1][1] if right else b + 3]
                x = context_features([low[i:j] for i, j in left], [low[i:j] for i, j in right], before[-200:], after[:200])
                out.append((a, b, *match(w), 1 / (1 + math.exp(-float(np.dot(self.context, x))))))
        return out

    def features(self, text: str, hits: list[tuple[int, int, int, int, float]]) -> list[float]:
        worth = [self.odds[t] * c * (MISSPELLED if used else 1.0) for _, _, t, used, c in hits]
        total = sum(worth)
        return [math.log1p(total), math.log1p(100 * total / max(1, len(text) / 6)) if hits else 0.0, max(worth, default=0.0), math.log1p(len({h[2] for h in hits})), 1.0]

    def score(self, x: list[list[float]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.array(x).reshape(-1, 5) @ self.weights, -35, 35)))


def g_squared(p: int, n: int, toxic: int, clean: int) -> float:
    """Twice the log-likelihood ratio of a term in ``p`` of ``toxic`` and ``n`` of ``clean`` documents."""
    total, seen = toxic + clean, p + n
    part = lambda a, e: a * math.log(a / e) if a else 0.0
    return 2 * (part(p, toxic * seen / total) + part(n, clean * seen / total) + part(toxic - p, toxic * (total - seen) / total) + part(clean - n, clean * (total - seen) / total))


def choose_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> list[tuple[str, float]]:
    """The lexicon from (term, toxic documents, other documents): terms and log-odds, at most ``TERMS``.

    A stem ends in ``*``. The surest come first, whole words before stems, longer before shorter ones. A stem is left
    out if a chosen term that it begins has nearly all of its documents, or if a chosen stem begins it, and a word if a
    chosen stem begins it and has over three times its documents.
    """
    rate = lambda p, n: (p + 0.5) / (toxic + 1) / ((n + 0.5) / (clean + 1))
    judged = [(g_squared(p, n, toxic, clean), t, p, n) for t, p, n in counts if p >= LEAST and rate(p, n) >= LIFT]
    chosen: list[tuple[str, int, float]] = []
    for g, t, p, n in sorted(judged, key=lambda x: (-x[0], x[1].endswith("*"), -len(x[1]), x[1])):
        body = t.rstrip("*")
        if g < SURE or len(chosen) >= TERMS:
            break
        if t.endswith("*") and any(c.startswith(body) and m >= 0.9 * p for c, m, _ in chosen):
            continue
        if any(c.endswith("*") and body.startswith(c[:-1]) and (t.endswith("*") or p < m / 3) for c, m, _ in chosen):
            continue
        chosen.append((t, p, math.log(rate(p, n))))
    return [(t, w) for t, _, w in chosen]


def _documents(rows: DataFrame, listed, worth: str, first: str) -> list[tuple[str, int, int]]:
    """(item, toxic rows ``p``, other rows ``n``) of what ``listed`` gives for the texts, where ``worth`` holds.

    At most ``COMPARED``, those of greatest ``first``.
    """

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                items = iter(listed(text or ""))
                while part := list(islice(items, 50_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([label] * len(part), pa.int64())], ["item", "y"])

    seen = rows.select("text", F.col("label").cast("long")).mapInArrow(give, "item string, y long").groupBy("item").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    return [tuple(r) for r in seen.select("item", "p", "n").where(worth).orderBy(F.desc(first), "item").limit(COMPARED).collect()]


def terms_of(text: str) -> set[str]:
    """The words of a text, and the beginnings of its words as stems."""
    words = {w for w in set(WORD.findall(text.lower())) if len(w) <= LONGEST}
    return {w for w in words if len(w) >= SHORTEST} | {w[:k] + "*" for w in words for k in range(STEM, len(w))}


def train(labelled: DataFrame, *, text: str = "text", label: str = "label") -> Model:
    """A model from ``labelled``, a bounded sample of rows with label 1 (toxic) or 0; others and null labels are no examples.

    Null and empty texts are examples without words. Without rows of both labels every score is 0.5.
    """
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").cast("int").alias("label")).where("label in (0, 1)")
    rows = Stage(labelled.sparkSession, "toxicity").write(rows, "labelled")
    sizes = Counter({r["label"]: r["count"] for r in rows.groupBy("label").count().collect()})
    toxic, clean = sizes[1], sizes[0]
    if not toxic or not clean:
        return Model([], [], [], frozenset(), context_weights(), np.zeros(5))
    often = f"p >= {LEAST} and (p + 0.5) / {toxic + 1} >= {LIFT} * (n + 0.5) / {clean + 1}"
    terms = choose_terms(_documents(rows, terms_of, often, "p"), toxic, clean)
    words, stems = [(t, w) for t, w in terms if not t.endswith("*")], [(t[:-1], w) for t, w in terms if t.endswith("*")]
    model = Model([t for t, _ in words], [t for t, _ in stems], [w for _, w in words + stems], frozenset(), context_weights())

    def misspelled(body: str) -> set[str]:
        match = model.automaton.match
        return {w for w in set(WORD.findall(body.lower())) if match(w)[1]}

    # a form that other documents have too is a word of its own
    model.ordinary = frozenset(w for w, _, _ in _documents(rows, misspelled, f"n > 1 or n * {LIFT} * {toxic} >= p * {clean}", "n"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [t or "" for t in batch.column(0).to_pylist()]
            x = [model.features(t, model.hits(t)) for t in bodies]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int64()), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    # a few numbers for each of the sampled rows; sorted, so that sums have one order
    found = sorted((r["y"], r["x"]) for r in rows.mapInArrow(measure, "y long, x array<double>").collect())
    model.weights = fit_logistic(np.array([x for _, x in found]), np.array([float(y) for y, _ in found]))
    return model


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The columns of ``docs``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and ``hits`` of every whole text.

    A hit has start and end (code points of the lower-case text), term (a stem ends in ``*``), edits and context (1: abuse, 0:
    quotation). Edge cases: null and empty texts have no hits and the score of the constant; repeated rows are scored
    each; an empty table gives an empty one; other columns are carried along; columns named like the new ones are replaced.
    """
    new = ["score", "predicted", "hits"]
    kept = [c for c in docs.columns if c not in new]
    place = kept.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*model.words, *(f"{t}*" for t in model.stems)]
    hit = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("edits", pa.int32()), ("context", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            x, listed = [], []
            for k in range(batch.num_rows):
                body = batch.column(place)[k].as_py() or ""
                hits = held.hits(body)
                x.append(held.features(body, hits))
                listed.append([{"start": a, "end": b, "term": names[t], "edits": used, "context": c} for a, b, t, used, c in hits])
            p = held.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(listed, pa.list_(hit))], [*kept, *new])

    slim = docs.select(*[F.col(f"`{c}`") for c in kept])
    kinds = slim.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.expr("cast(null as array<struct<start:bigint,end:bigint,term:string,edits:int,context:double>>)").alias("hits"))
    return slim.mapInArrow(run, kinds.schema)

