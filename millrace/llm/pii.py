"""Personal data: fixed patterns, and a linear-chain CRF over word shapes for what the patterns miss.

The patterns are matched on whole texts in linear time. The field reads segments: the surroundings of every
digit, @ sign and spelled-out at or dot of the text. It finds, for instance, addresses like maria (at) firma (dot) de
or anna at mail dot com, national phone numbers like 0170-1234567 or 0711/1234567, and numbers that a pattern skipped because of what stands next to them. What it
labels counts only if it also is a well-formed item of its kind and does not touch another span.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.crf import LinearChainCrf

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that long runs take linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def is_card(text: str) -> bool:
    digits = NOT_DIGIT.sub("", text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by kind as listed and then by start; offsets in code points, ends exclusive."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            out.append(("email", start, last))
        at = text.find("@", at + 1)
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if is_ip(m[0])]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if is_card(m[0])]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


#: Where the field looks: every digit and @, and at or dot as people spell addresses, in any case, bare ones too.
TRIGGER = re.compile(
    r"[0-9@]+|[\[({<]\s?(?i:at|dot)\s?[\])}>]|(?<=\s)(?i:dot)(?=\s)|(?<=[A-Za-z0-9])_(?i:at|dot)_(?=[A-Za-z0-9])|(?<=\s)(?i:at)(?=\s[A-Za-z0-9-]+\s?\.\s?[A-Za-z])"
)
#: Code points around a trigger that belong to its segment at least.
AROUND = 28
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
#: Words that tell what a number next to them is.
CUES = {"mail": "email", "email": "email", "mailto": "email", "correo": "email", "courriel": "email", "at": "at", "dot": "dot", "phone": "phone", "tel": "phone", "telefon": "phone", "telephone": "phone", "téléphone": "phone", "teléfono": "phone", "mobile": "phone", "mobil": "phone", "handy": "phone", "cell": "phone", "call": "phone", "fax": "phone", "whatsapp": "phone", "ip": "ip", "host": "ip", "server": "ip", "ping": "ip", "card": "card", "visa": "card", "mastercard": "card", "amex": "card", "order": "other", "invoice": "other", "isbn": "other", "page": "other", "version": "other", "total": "other", "id": "other", "token": "other"}
TOPS = frozenset("com org net edu gov info io eu uk de fr es it nl ch at pl ru be ie us ca au jp cn in br se no dk fi cz pt gr hu ro tr mx ar nz za biz".split())
CUES |= dict.fromkeys("com org net edu gov info io eu uk de fr es it nl ch at pl ru ie se dk fi cz pt br jp cn ca au biz".split(), "top") | {"at": "at"}
CUES |= dict.fromkeys("numéro número nummer rufnummer ring text dial anruf rufen appelez llame sms hotline reach".split(), "phone")
CUES |= dict.fromkeys("contact write schreib schreiben escribe écrivez address adresse kontakt send".split(), "email")
CUES |= dict.fromkeys("look looking looked pointed arrived played stayed based shown listed available found find hosted online site website visit read us more here".split(), "place")
CUES |= dict.fromkeys("isbn issn serial version ticket ref reference code total count population".split(), "other")
#: The tokens before and after one in which an at, dot or cue is sought, and tokens whose features are held at once.
REACH, PART = 8, 65_536


def in_word(c: str) -> bool:
    return c in LOCAL or c.isalnum() or c == "_"


#: An at without brackets, which is no trigger, where a segment starts or right before it.
AT_FIRST, AT_BEFORE = re.compile(r"at\s", re.I), re.compile(r"\sat\s", re.I)


def word_start(text: str, at: int, least: int) -> int:
    while at > least and in_word(text[at - 1]):
        at -= 1
    return at


def segments(text: str) -> list[tuple[int, int]]:
    """The stretches that the field reads, joined where they touch and never cutting a word or the part of a
    spelled address before its at. No code point is passed more than a few times."""
    out: list[list[int]] = []
    for start, end in _around(text):
        least = out[-1][1] if out else 0
        if start > least:
            start = word_start(text, start, least)
        if start > least and AT_FIRST.match(text, start) and text[start - 1].isspace():
            start = word_start(text, start - 1, least)
        elif start > max(least, 3) and AT_BEFORE.match(text, start - 4, start):
            start = word_start(text, max(start - 4, least), least)
        if end > least:
            while end < len(text) and in_word(text[end]):
                end += 1
        if out and start <= least:
            out[-1][1] = max(least, end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _around(text: str) -> list[list[int]]:
    """The surroundings of all triggers, joined where they touch."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        start, end = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def shape(token: str) -> str:
    first = token[0]
    if "0" <= first <= "9":
        return f"{'0' if first == '0' else '9'}{min(len(token), 20)}"
    if first.isspace():
        return "\n" if "\n" in token else " "
    if first.isalpha():
        cue = CUES.get(token.lower())
        if cue:
            return f"cue {cue}"
        size = "s" if len(token) < 4 else "m" if len(token) < 9 else "l"
        return ("X" if token.isupper() else "Xx" if first.isupper() else "x") + size
    return first if first in PUNCTUATION else "~"


PUNCTUATION = "@.-_+()[]{}<>,:;/#%$*&=\"'|!?"
#: Every shape by number; 0 stands for what lies before and after a segment. Fewer than 128.
SHAPES = ["", *(f"{z}{n}" for z in "09" for n in range(1, 21)), "\n", " ", "~", *PUNCTUATION, *(f"{c}{n}" for c in ("X", "Xx", "x") for n in "sml"), *(f"cue {c}" for c in sorted(set(CUES.values())))]
NUMBER = {x: k for k, x in enumerate(SHAPES)}
IS_CUE = np.array([x.startswith("cue") for x in SHAPES])
#: What spells an at or dot: 1 at, 2 dot, 3 @.
SPELLS = np.array([{"cue at": 1, "cue dot": 2, "@": 3}.get(x, 0) for x in SHAPES])
#: What may stand between the digits of one number.
BETWEEN = " ().-/+"


class Tokens:
    """The tokens of many segments, one segment after another, three empty tokens apart: arrays of one number a token."""

    def __init__(self):
        self.shapes: list[np.ndarray] = [np.zeros(3, np.int16)]
        self.digits: list[np.ndarray] = [np.zeros(3, np.int32)]
        self.signs: list[np.ndarray] = [np.full(3, -1, np.int8)]
        self.leads: list[np.ndarray] = [np.zeros(3, np.int8)]
        self.starts: list[np.ndarray] = []
        self.sizes: list[int] = []

    def add(self, text: str, start: int, end: int) -> None:
        held = TOKEN.findall(text, start, end)
        told = {t: _told(t) for t in set(held)}
        rows = np.array([told[t] for t in held], np.int32).reshape(-1, 4)
        for into, column, empty in zip((self.shapes, self.digits, self.signs, self.leads), rows.T, (0, 0, -1, 0)):
            into += [column.astype(into[0].dtype), np.full(3, empty, into[0].dtype)]
        self.starts.append(np.append(0, np.cumsum(np.fromiter(map(len, held), np.int32, len(held)))) + start)
        self.sizes.append(len(held))

    def codes(self) -> Iterator[np.ndarray]:
        """For each segment its features, (tokens, slots) codes, in parts of bounded size."""
        shapes, digits, signs, leads = (np.concatenate(x).astype(np.int64) for x in (self.shapes, self.digits, self.signs, self.leads))
        place = np.arange(len(shapes))
        part = np.cumsum(np.append(0, np.diff(np.repeat(np.arange(2 * len(self.sizes) + 1) % 2, np.array([3, *(n for size in self.sizes for n in (size, 3))])))) != 0)
        latest = lambda mask: np.maximum.accumulate(np.where(mask, place, -1))
        near = lambda at, far: (at >= 0) & (np.abs(place - at) <= far) & (part[at] == part)
        spell = SPELLS[shapes]
        before_at = np.append(-1, latest(spell > 0)[:-1])
        before = np.where(near(before_at, REACH), spell[before_at], 0)
        cue_at = np.append(-1, latest(IS_CUE[shapes])[:-1])
        cue = np.where(near(cue_at, REACH), shapes[cue_at], 0)
        # the next two, from the end of the array
        coming = len(shapes) - 1 - latest((spell > 0)[::-1])[::-1]
        next_at = np.append(coming[1:], len(shapes))
        then_at = np.append(next_at, len(shapes))[np.minimum(next_at, len(shapes))]
        after = sum(m * np.where((x < len(shapes)) & near(np.minimum(x, len(shapes) - 1), REACH), spell[np.minimum(x, len(shapes) - 1)], 0) for m, x in ((1, next_at), (4, then_at)))
        runs = self._runs(shapes, digits, signs, leads)
        begin = 3
        for size in self.sizes:
            yield from (self._coded(begin + t, min(begin + t + PART, begin + size), shapes, before, after, cue, runs) for t in range(0, size, PART))
            begin += size + 3

    @staticmethod
    def _coded(lo: int, hi: int, shapes, before, after, cue, runs) -> np.ndarray:
        a, b, c, d, e, f, g = (shapes[lo + k : hi + k] for k in range(-3, 4))
        cue, spelled = cue[lo:hi], before[lo:hi] * 16 + after[lo:hi]
        pair = lambda *xs: sum(x << (7 * k) for k, x in enumerate(xs))
        kinds = [d, c, e, b, f, a, g, pair(c, d), pair(d, e), pair(b, c, d), pair(d, e, f), pair(cue, d), pair(c, d, e), pair(spelled, d), pair(spelled, c, e), *(x[lo:hi] for x in runs)]
        return np.stack([x + (k << 48) for k, x in enumerate(kinds, 1)], axis=1)

    @staticmethod
    def _runs(shapes, digits, signs, leads) -> list[np.ndarray]:
        """What the run of digits and ``BETWEEN`` that a token is in looks like as a whole: how many digits in how many
        groups, how it begins, what parts its groups; five numbers, 0 where they say nothing."""
        n = len(shapes)
        inside = (digits > 0) | (signs >= 0)
        starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
        out = [np.zeros(n, np.int64) for _ in range(5)]
        if not len(starts):
            return out
        stops = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
        run = np.repeat(np.arange(len(starts)), stops - starts)
        at = np.concatenate([np.arange(a, b) for a, b in zip(starts, stops)]) if len(starts) < 64 else np.flatnonzero(inside)
        isdig = digits[at] > 0
        heads = starts - starts[0] - np.append(0, np.cumsum(starts[1:] - stops[:-1]))
        groups = np.add.reduceat(isdig.astype(np.int64), heads)
        total = np.add.reduceat(digits[at], heads)
        first = np.minimum.reduceat(np.where(isdig, at, n), heads)
        final = np.maximum.reduceat(np.where(isdig, at, -1), heads)
        real = groups > 0
        head = np.minimum(first, n - 1)
        sign = np.where((first > starts) & real, signs[np.maximum(head - 1, 0)], -1)
        sign = np.where(sign == BETWEEN.index("("), 1, np.where(sign == BETWEEN.index("+"), 2, 0))
        lead = sign * 4 + leads[head]
        between = (at > first[run]) & (at < final[run]) & ~isdig
        parts = np.bitwise_or.reduceat(np.where(between, 1 << np.maximum(signs[at], 0), 0), heads)
        order = np.cumsum(isdig) - isdig
        order = order - order[heads][run]
        few = groups < 7
        sizes = np.add.reduceat(np.where(isdig & few[run], np.minimum(digits[at], 9) * 10 ** np.minimum(order, 6), 0), heads)
        body = (at >= (first - (sign > 0))[run]) & (at <= final[run]) & real[run]
        r0 = np.where(~real[run], 1, np.where(body, 2, 3))
        many, short = np.minimum(groups, 9), np.minimum(total, 20)
        for column, value in zip(out[1:], (short, short * 16 + lead + 1024, (parts * 16 + many) * 16 + lead + 1, (sizes * 2 + few) * 16 + lead + 1)):
            column[at] = np.where(body, value[run], 0)
        out[0][at] = r0
        return out


def _told(token: str) -> tuple[int, int, int, int]:
    """Of a token: its shape, digits, number among ``BETWEEN`` (-1: none) and how it would begin a number."""
    digit = "0" <= token[0] <= "9"
    lead = (0 if token[:2] == "00" else 1 if token[0] == "0" else 2 if token == "1" else 3) if digit else 0
    return NUMBER[shape(token)], len(token) if digit else 0, BETWEEN.find(token) if len(token) == 1 else -1, lead


class Field:
    """A trained field and the codes of the features that it knows."""

    def __init__(self, known: np.ndarray, crf: LinearChainCrf):
        self.known, self.crf = known, crf

    def ids(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the codes, from 1 on; 0 for those that training did not meet."""
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        return np.where(self.known[at] == codes, at + 1, 0).astype(np.int32)

    def read(self, tokens: Tokens) -> list[np.ndarray]:
        """The labels of each segment."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(tokens.sizes)
        short, rows, parts = [], [], tokens.codes()
        for k, size in enumerate(tokens.sizes):
            own = -(-size // PART)
            if size > LONG:
                out[k] = self.crf.best_path(self.crf.emissions(self.ids(next(parts))) for _ in range(own))
            elif own:
                short.append(k)
                rows.append(next(parts))
        if rows:
            ids = self.ids(np.concatenate(rows))
            for k, tags in zip(short, self.crf.decode(np.split(ids, np.cumsum([len(r) for r in rows])[:-1]))):
                out[k] = tags
        return out


#: Tokens of a segment that is decoded by itself.
LONG = 4_096


def labelled_segments(n: int = 1500, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """The labelled table: short texts with their spans, and look-alikes without any."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9) if rng.random() < 0.85 else rng.randint(10, 24)))
    plain_word = lambda: pick((word, word, word, lambda: word().capitalize()))()
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = rng.choice("3456") + digits(14)
        body += next(str(c) for c in range(10) if luhn(body + str(c)))
        return rng.choice((body, " ".join(body[k : k + 4] for k in range(0, 16, 4)), "-".join(body[k : k + 4] for k in range(0, 16, 4))))

    pick = rng.choice

    def email() -> str:
        local = pick((word, word, word, word, lambda: pick(("info", "office", "service", "hr", "it"))))() + pick(("", "", "", "", "." + word(), "_" + word(), "-" + word(), digits(rng.randint(1, 3)), "-" + digits(1), "." + word()[:1]))
        label = lambda: pick((word, word, word, lambda: pick(("mail", "host", "server", "phone"))))() + pick(("", "", "", "-" + word(), digits(rng.randint(1, 2))))
        if rng.random() < 0.4:
            local, at, dot = plain_word() if rng.random() < 0.6 else local, pick((" at ", " at ", " AT ", " AT ", " At ", "[@]", " [@] ", " @ ", "_at_", "(@)")), "."
            dot = {"_at_": "_dot_", " @ ": pick((".", " . "))}.get(at, ".")
            label = lambda: pick((word, word, lambda: word() + "-" + word()))()
            return local + at + dot.join([label(), pick(("com", "org", "net", "de", "fr", "es", "eu", "io", "info"))])
        at, dot = pick((("@", "."), *[(" at ", " dot ")] * 3, *[(f"{gap}{a}at{b}{gap}", f"{gap}{a}dot{b}{gap}") for a, b in ("()", "()", "[]", "[]", "{}", "<>") for gap in (" ", " ", "")], (" {at} ", "."), (" [at] ", "."), (" (at) ", ".")))
        if rng.random() < 0.3:
            change = pick((str.upper, str.title))
            local, at, dot = local.title() if change == str.title else local, change(at), change(dot)
        top = pick(("com", "org", "net", "de", "fr", "es", "eu", "io", "info", "edu", "it", "uk", "co" + dot + "uk"))
        return local + at + dot.join([label() for _ in range(pick((1, 1, 1, 2)))] + [top])

    def grouped(total: int, gap: str) -> str:
        """Digits in groups of two to four."""
        out = []
        while total:
            out.append(digits(total if total < 5 and rng.random() < 0.5 or total < 4 else rng.randint(2, min(4, total - 2))))
            total -= len(out[-1])
        return gap.join(out)

    def phone() -> str:
        gap = pick((" ", "-", "."))
        area = "0" + digits(rng.randint(1, 4))
        rest = digits(rng.randint(6, 8)) if rng.random() < 0.5 else grouped(rng.randint(6, 8), pick((" ", "-")))
        return pick(
            (
                f"+{digits(2)} {digits(3)} {digits(7)}",
                f"+{digits(1)}-{digits(3)}-{digits(3)}-{digits(4)}",
                f"({digits(3)}) {digits(3)}-{digits(4)}",
                gap.join((pick("23456789") + digits(2), digits(3), digits(4))),
                "1" + gap + gap.join((digits(3), digits(3), digits(4))),
                area + pick((" ", "-", "/", " / ", " - ", "")) + rest,
                area + pick((" ", "-", "/")) + rest + "-" + digits(rng.randint(1, 2)),
                f"({area}) {rest}",
                "00" + digits(2) + " " + digits(rng.randint(2, 3)) + " " + rest,
                gap.join(["0" + digits(1), *(digits(2) for _ in range(4))]),
                gap.join((pick("6789") + digits(2), digits(3), digits(3))),
                "0" + digits(2) + gap + digits(4) + gap + digits(4),
                "0" + digits(rng.randint(8, 10)),
                pick("6789") + digits(9),
                " ".join([*(digits(2) for _ in range(4)), digits(pick((1, 2)))]),
                "0" + digits(rng.randint(2, 4)) + " " + digits(3) + " " + digits(3),
                "0800 " + digits(3) + " " + digits(3),
                f"1 ({digits(3)}) {digits(3)} {digits(4)}",
                f"{area} / {digits(4)} {digits(3)}",
                f"{area}/{digits(3)} {digits(2)} {digits(2)}",
            )
        )

    ip = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    before = {"email": ("mail ", "email: ", "write to ", "contact ", "reach us at ", ""), "ip": ("from ", "ip ", "host ", "server ", ""), "card": ("card ", "paid with ", "visa ", "number ", ""), "phone": ("call ", "tel. ", "Telefon ", "phone: ", "fax ", "mobil ", "reach me at ", "numéro ", "Nummer: ", "número ", "text me on ", "", "", "")}
    plain = (
        lambda: f"{rng.randint(1900, 2030)}",
        lambda: f"{digits(1)}.{digits(1)}.{digits(2)}",
        lambda: f"{rng.randint(1, 12)}:{digits(2)}",
        lambda: f"20{digits(2)}-0{digits(1)}-1{digits(1)}",
        lambda: f"${rng.randint(1, 999)},{digits(3)}.{digits(2)}",
        lambda: f"page {rng.randint(1, 99)} of {rng.randint(100, 999)}",
        lambda: f"order {digits(rng.randint(6, 18))}",
        lambda: "token = " + "".join(rng.choice("0123456789abcdef") for _ in range(40)),
        lambda: f"ISBN 978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        lambda: f"{pick(('ISBN ', 'ISBN: ', 'isbn '))}{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}",
        lambda: f"{pick(('order', 'invoice', 'ticket', 'id', 'serial', 'ref', 'code', 'total', word()))} {digits(rng.randint(8, 11))}",
        lambda: f"{pick(('look', 'found', 'available', 'read more', 'visit us', 'us', 'online', 'hosted'))} at {word()}.{pick(('com', 'org', 'de'))}",
        lambda: f"{word()} @ {word()}",
        lambda: f"{word()}_{word()}_{word()}",
        lambda: f"{digits(rng.randint(1, 5))}",
        lambda: f"{digits(rng.randint(1, 3))} {digits(3)} {digits(3)}",
        lambda: f"@{word()}",
        lambda: f"{word()} at {word()} {rng.randint(1, 40)}",
        lambda: f"the dot {word()}",
        lambda: f"{rng.randint(1, 99)}%",
        lambda: f"{rng.randint(1, 31)}/{rng.randint(1, 12)}/{rng.randint(1990, 2025)}",
        lambda: f"{rng.randint(1990, 2025)}-{digits(2)}-{digits(2)} {rng.randint(10, 23)}:{digits(2)}",
        lambda: f"{rng.randint(1900, 2025)}-{rng.randint(1900, 2030)}",
        lambda: f"{rng.randint(1900, 2025)} {rng.randint(1900, 2025)} {word()} {rng.randint(1900, 2025)}",
        lambda: f"{digits(1)},{digits(3)},{digits(3)}",
        lambda: f"{rng.randint(1, 99)}.{digits(3)}.{digits(3)}",
        lambda: f"{rng.randint(1, 9)} {digits(3)} 000 000",
        lambda: f"{rng.randint(1, 99)}.{digits(6)}, {rng.randint(1, 99)}.{digits(6)}",
        lambda: f"{rng.randint(2000, 2025)}{digits(10)}",
        lambda: f"{rng.randint(2000, 2025)}-{digits(6)}-{digits(2)}",
        lambda: " ".join(digits(rng.randint(1, 2)) for _ in range(rng.randint(2, 14))),
        lambda: f"#{word()}{digits(4)}",
        lambda: f"{word()} dot {word()}",
    )
    out = []
    for _ in range(n):
        text, spans = " ".join(plain_word() for _ in range(rng.randint(0, 5))), []
        for _ in range(rng.randint(1, 3)):
            text += rng.choice((" ", " ", "\n", ", ", " ("))
            if rng.random() < 0.6:
                kind = rng.choice(KINDS)
                text += rng.choice(before[kind])
                item = make[kind]()
                spans.append((kind, len(text), len(text) + len(item)))
                text += item
            else:
                text += rng.choice(plain)()
            text += rng.choice(("", "", ".", "###", "***", ",", ")", "$$$", "&&&")) + " " + " ".join(plain_word() for _ in range(rng.randint(0, 6)))
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field, trained once per process on the labelled table. Labels: 0, then begin and inside of each kind."""
    tokens, tags = Tokens(), []
    for text, spans in labelled_segments():
        tokens.add(text, 0, len(text))
        starts, ends = tokens.starts[-1][:-1], tokens.starts[-1][1:]
        tag = np.zeros(len(starts), np.int64)
        for kind, start, end in spans:
            inside = np.flatnonzero((starts >= start) & (ends <= end))
            tag[inside], tag[inside[0]] = 2 * KINDS.index(kind) + 2, 2 * KINDS.index(kind) + 1
        tags.append(tag)
    rows = list(tokens.codes())
    known = np.unique(np.concatenate([r.ravel() for r in rows]))
    labels = 2 * len(KINDS) + 1
    barred = np.zeros((labels + 1, labels), bool)
    for inside in range(2, labels, 2):  # goes on only from its own kind
        barred[:, inside] = True
        barred[inside - 1 : inside + 1, inside] = False
    field = Field(known, LinearChainCrf(len(known) + 1, labels, barred))
    field.crf.fit([field.ids(r) for r in rows], tags, rounds=60)
    return field


SPELLED = re.compile(r"[A-Za-z0-9._%+-]+?\s?(?:@|[\[({<]\s?(?:at|@)\s?[\])}>]|\sat\s|_at_)\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[({<]\s?(?:dot|\.)\s?[\])}>]|\sdot\s|_dot_)\s?[A-Za-z0-9-]+)+", re.I)
#: Ten or thirteen digits in the groups of a book's number, and its check digit.
BOOK = re.compile(r"(?:97[89][- ])?[0-9]{1,5}[- ][0-9]{1,7}[- ][0-9]{1,7}[- ][0-9]")


def is_book(text: str) -> bool:
    digits = [ord(c) - 48 for c in NOT_DIGIT.sub("", text)]
    if not BOOK.fullmatch(text) or len(digits) not in (10, 13):
        return False
    if len(digits) == 10:
        return sum((10 - k) * d for k, d in enumerate(digits)) % 11 == 0
    return sum((1 + 2 * (k % 2)) * d for k, d in enumerate(digits)) % 10 == 0


BARE = re.compile(r"(?<=\s)at(?=\s)|_at_", re.I)


def bare_top(text: str) -> int:
    """The length of the letters that a text ends in."""
    return len(text) - len(text.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))


LABEL_REST = re.compile(r"[A-Za-z0-9]*(?:-+[A-Za-z0-9]+)*")


def well_formed(kind: str, text: str) -> bool:
    if kind == "email":
        # an at without @ or brackets is a word of its own too, so there more must speak for an address
        bare = BARE.search(text)
        return SPELLED.fullmatch(text) is not None and (not bare or (text[-bare_top(text) :].lower() in TOPS and not re.search(r"\.\s|\s\.", text)))
    if kind == "ip":
        return IP.fullmatch(text) is not None and is_ip(text)
    if kind == "card":
        return CARD.fullmatch(text) is not None and is_card(text)
    digits = NOT_DIGIT.sub("", text)
    return 9 <= len(digits) <= 15 and re.fullmatch(r"\(?\+?[0-9][\x20().0-9/-]*[0-9]", text) is not None and len(set(digits)) > 2 and not is_book(text)


class Taken:
    """Spans, asked in a few steps whether one touches any of them."""

    def __init__(self, spans: list[Span]):
        spans = sorted(spans, key=lambda s: s[1])
        self.starts, self.reach = [s[1] for s in spans], list(accumulate((s[2] for s in spans), max))

    def touches(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.reach[k - 1] > start


def whole_address(text: str, span: Span, least: int, most: int, base: Taken) -> Span:
    """An address that the field cut inside its first or last word, with all of that word, if that lies between
    ``least`` and ``most`` and touches no base span."""
    start, end = span[1], LABEL_REST.match(text, span[2]).end()
    while start and text[start - 1] in LOCAL:
        start -= 1
    free = least <= start and end <= most and not base.touches(start, end)
    return ("email", start, end) if free and well_formed("email", text[start:end]) else span


def find_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text the base spans, and all spans, both by kind and then by start."""
    base = [base_spans(t) if t else [] for t in texts]
    tokens, places = Tokens(), []
    for k, text in enumerate(texts):
        for start, end in segments(text):
            # a segment is decoded whole: any cut could go through an item
            tokens.add(text, start, end)
            places.append(k)
    more: list[list[Span]] = [[] for _ in texts]
    for k, starts, tags in zip(places, tokens.starts, field.read(tokens)):
        for at in np.flatnonzero(tags % 2).tolist():
            stop = at + 1
            while stop < len(tags) and tags[stop] == tags[at] + 1:
                stop += 1
            start, end = int(starts[at]), int(starts[stop])
            while end > start and texts[k][end - 1].isspace():
                end -= 1
            kind = KINDS[(int(tags[at]) - 1) // 2]
            if well_formed(kind, texts[k][start:end]):
                more[k].append((kind, start, end))
    out = []
    for text, own, new in zip(texts, base, more):
        taken = Taken(own)
        free = [s for s in new if not taken.touches(s[1], s[2])]
        bounds = [0, *(s[2] for s in free)], [*(s[1] for s in free[1:]), len(text)]
        free = [whole_address(text, s, low, high, taken) if s[0] == "email" else s for s, low, high in zip(free, *bounds)]
        out.append((own, sorted({*own, *free}, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if free else own))
    return out


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, *, text: str = "text", batch: int = 128) -> DataFrame:
    """The columns of ``docs``, the numbers of base spans ``n_email n_ip n_card n_phone``, ``base`` and ``spans``.

    The last two list spans as kind:start:end in code points (end exclusive), by kind as in ``KINDS`` and then
    by start, joined by commas. Edge cases: null and empty texts have none; equal items count each; long texts
    are read whole; repeated rows are read each; an empty table gives an empty table; other columns are carried
    along; columns named like the new ones are replaced.
    """
    new = {f"n_{k}": "long" for k in KINDS} | {"base": "string", "spans": "string"}
    kept = [c for c in docs.columns if c not in new]
    place = kept.index(text)
    model = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                found = find_spans([t or "" for t in part.column(place).to_pylist()], model.value)
                counts = [pa.array([sum(s[0] == k for s in own) for own, _ in found], pa.int64()) for k in KINDS]
                texts = [pa.array([digest(s) for s in column], pa.string()) for column in zip(*found)]
                yield pa.RecordBatch.from_arrays([*part.columns, *counts, *texts], [*kept, *new])

    slim = docs.select(*[F.col(f"`{c}`") for c in kept])
    return slim.mapInArrow(run, slim.select("*", *[F.lit(None).cast(t).alias(c) for c, t in new.items()]).schema)
