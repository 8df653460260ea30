"""Brute-force versions of operators that SQL cannot express, in plain Python."""

import math
import re
from collections import Counter
from functools import reduce

import regex
import xxhash

from millrace.llm.quality_rules import BUCKETS

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(SPACE).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute_shape(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    full = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(full) - len(set(full)), len(covered), failed


def brute_scores(rows, trusted):
    """Ids and texts to scores: hashed n-gram log-likelihood ratios in whole units of 2**-16."""
    h = lambda *t: reduce(lambda s, x: xxhash.xxh64_intdigest(x.encode(), s), t, 42)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    grams = []
    for _, text in rows:
        w = regex.findall(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+", text or "")
        grams.append([signed(h(a)) % BUCKETS for a in w] + [signed(h(a, b)) % BUCKETS for a, b in zip(w, w[1:])])
    raw, own = Counter(), Counter()
    for (i, _), g in zip(rows, grams):
        raw.update(g)
        own.update(g if i in trusted else ())
    n, m = sum(raw.values()), sum(own.values())
    weight = lambda b: round(math.log((own[b] + 1) / (m + BUCKETS) / ((raw[b] + 1) / (n + BUCKETS))) * 65536)
    return [sum(map(weight, g)) / 65536 / len(g) if g else None for g in grams]


def brute_lines(texts, least=10):
    """Texts without the lines whose key stands in ``least`` texts."""
    seen = Counter(k for t in texts for k in {key(x) for x in t.split("\n")})
    return ["\n".join(x for x in t.split("\n") if not key(x) or seen[key(x)] < least) for t in texts]


def brute_shingles(text, words):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def brute_components(rows, words, percent):
    """(id, text) rows to (id, size of the set, least id of the component), comparing all pairs."""
    sets = [brute_shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def brute_overlap(doc, item):
    """Whether some window of the item stands in the document, in place, with few words replaced."""
    plain = lambda t: re.sub(r"[!-/:-@\[-`{-~]", "", t.lower()).encode().split()
    d, b = plain(doc or ""), plain(item or "")
    n = min(13, len(b))
    needed = math.ceil(0.8 * n) if len(b) >= 8 else n
    if n < 4:
        return False
    return any(sum(x == y for x, y in zip(d[i : i + n], b[j : j + n])) >= needed for i in range(len(d) - n + 1) for j in range(len(b) - n + 1))


def brute_pii(text):
    """Base spans by the patterns as they are stated."""
    digits = lambda t: re.sub("[^0-9]", "", t)

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(d[::-1])) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(digits(t)) <= 19 and luhn(digits(t))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits(t)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text or "") if ok(m[0])]
