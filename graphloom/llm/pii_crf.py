"""Personal data by patterns and a semi-Markov conditional random field.

Patterns give the base spans. The field finds more: it splits a zone of a text into segments, each an
entity of some units or a single unit outside, and scores whole segments - is it shaped like an
address, do its digits pass the check sum, how are they grouped, which word stands before it - as well
as neighbouring segments. Decoding is a dynamic programme over end positions with entities of at most
MOST_UNITS units, which chooses boundaries and types together, so its work is linear in the text.

Weights are learned at first use by maximum likelihood (forward-backward over segmentations) from
sentences that a seeded generator makes; nothing is read from the corpus.

Spans of the field are added where they overlap no base span. Defined cases: a null text counts as
empty and has no span. Repeated rows are scanned each.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from functools import lru_cache

from pyspark.sql import DataFrame

from graphloom.llm.spans import Span, span_rows

KINDS = ("email", "ip", "card", "phone")
MOST_UNITS = 16

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: What a word of a zone holds: a zone is a run of such words, one space apart.
HOLDS = re.compile("[0-9@+]")
SPACE = re.compile(r"\s")
#: The shortest entity, a@b.c; and the characters before a segment that are searched for a cue.
LEAST_ZONE, CUE_REACH = 5, 28
#: As far as a numeric entity can reach: 19 digits. With under four there is none.
NUMBER = re.compile(r"[+(]?(?:[\x20().+-]*[0-9]){4,19}")
#: Shapes kept by a worker, at about 500 bytes; a full store is emptied.
MOST_SHAPES = 100_000
UNIT = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
NUMERIC = frozenset(" ().-+")
CUES = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write)\W*$"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|addr)\W*$"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|credit|payment)\W*(?:no\.?|number)?\W*$"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|cell|fax|dial)\W*(?:no\.?|number)?\W*$"),
}
NOT_CUE = re.compile(r"(?i)\b(?:order|invoice|version|id|isbn|item|part|date|ref|serial|page|build)\W*(?:no\.?|number)?\W*$")


ONES = {c: int(c) for c in "0123456789"}
TWICE = {c: 2 * int(c) - 9 * (int(c) > 4) for c in "0123456789"}


def luhn(digits: str) -> bool:
    return (sum(map(ONES.__getitem__, digits[::-2])) + sum(map(TWICE.__getitem__, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        # The run before an at sign ends right there, so a match begins where the run does.
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def char_class(c: str) -> str:
    return CLASSES[c]


class Classes(dict):
    """Class of each character, found once."""

    def __missing__(self, c: str) -> str:
        found = class_of(c)
        if len(self) < 10000:
            self[c] = found
        return found


CLASSES = Classes()


def class_of(c: str) -> str:
    return "end" if not c else "digit" if c in "0123456789" else "letter" if c.isalpha() else "space" if c.isspace() else c if c in ".-+@/:_()," else "sign"


def segment_features(text: str, start: int, end: int, kind: str) -> list[str]:
    """Features of a whole span as an entity of a kind."""
    s = text[start:end]
    before = text[max(0, start - CUE_REACH) : start]
    out = ["bias", f"left {char_class(text[start - 1 : start])}", f"right {char_class(text[end : end + 1])}"]
    if CUES[kind].search(before):
        out.append("cue")
    if NOT_CUE.search(before):
        out.append("other cue")
    digits = [c for c in s if c.isdigit()]
    groups = re.findall("[0-9]+", s)
    if kind == "email":
        host = s.rpartition("@")[2]
        out += [f"at {min(s.count('@'), 2)}", "word end" if re.fullmatch("[A-Za-z]{2,10}", host.rpartition(".")[2]) else "odd end", "clean" if re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", s) else "broken"]
    elif kind == "ip":
        out += values(s, kind)
    elif kind == "card":
        out += [*values(s, kind), f"digits {len(digits)}", "fours" if all(len(g) == 4 for g in groups[:-1]) and len(groups) > 2 else "run" if len(groups) == 1 else "mixed"]
    else:
        out += ["plus" if s[0] == "+" else "no plus", f"digits {len(digits)}", "brackets" if re.search(r"\(\d{2,4}\)", s) else "none", f"groups {min(len(groups), 5)}", "last four" if len(groups[-1]) == 4 and len(groups) > 1 else "last other", f"first {len(groups[0])}" if len(groups) > 1 else "run", "open" if s.count("(") != s.count(")") else "closed", "dots" if "." in s else "no dots"]
    return [f"{kind} {f}" for f in out]


def candidates(text: str, units: list[tuple[int, int]], first: int | None = None) -> list[tuple[int, int, str]]:
    """Segments (first unit, unit after the last, kind) that could be an entity at all; with ``first`` only
    those that begin in so many first units."""
    out = []
    n = len(units)
    for i in range(n if first is None else min(first, n)):
        c = text[units[i][0]]
        if c in FIRST:
            digits = dots = 0
            plain = quad = c in "0123456789"
            for j in range(i, min(n, i + MOST_UNITS)):
                s, e = units[j]
                u = text[s:e]
                if u[0] in "0123456789" and u.isascii():
                    digits += e - s
                elif u in NUMERIC:
                    dots += u == "."
                    plain, quad = plain and u in " -", quad and u == "."
                    continue
                else:
                    break
                if digits > 19:
                    break
                if quad and dots == 3:
                    out.append((i, j + 1, "ip"))
                if plain and 13 <= digits:
                    out.append((i, j + 1, "card"))
                if 7 <= digits <= 15:
                    out.append((i, j + 1, "phone"))
        elif c == "@":
            out += around(text, units, i)
    return out


def around(text: str, units: list[tuple[int, int]], i: int) -> list[tuple[int, int, str]]:
    """Segments around an at sign, with at most half of MOST_UNITS units on either side."""
    left, k = [], i - 1
    while k >= 0 and i - k < MOST_UNITS // 2 and text[units[k][0]] in LOCAL_CHARS:
        if text[units[k][0]].isalnum():
            left.append(k)
        k -= 1
    out, k, dot = [], i + 1, False
    while k < len(units) and k - i <= MOST_UNITS // 2:
        c = text[units[k][0]]
        if c.isascii() and c.isalnum():
            if dot:
                out += [(x, k + 1, "email") for x in left]
        elif c == ".":
            dot = True
        elif c != "-":
            break
        k += 1
    return out


class Shapes(dict):
    """What stands for each character in a shape: its kind, as far as features without values see it."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "0" if c in "0123456789" else "a" if c.isascii() and c.isalpha() else "\u00e9" if c.isalpha() else c if c in " .-+@/:_(),%" else "\t" if c.isspace() else "\x01"
        return out


SHAPES = Shapes()
FIRST = frozenset("+(0123456789")
LETTER = re.compile("[A-Za-z]")
NO_CUES = (False,) * (len(KINDS) + 1)
#: Features of a segment's digits, not of its shape, and the pairs of them that can come together.
VALUES = {"card": [(a, b) for a in ("luhn", "no luhn") for b in ("issuer", "no issuer")], "ip": [(a, b) for a in ("octets", "too large") for b in ("padded", "plain")]}
BY_VALUE = frozenset(x for pairs in VALUES.values() for p in pairs for x in p) | {"cue", "other cue"}


def values(s: str, kind: str) -> list[str]:
    if kind == "card":
        digits = s.replace(" ", "").replace("-", "")
        return ["luhn" if luhn(digits) else "no luhn", "issuer" if digits[0] in "3456" else "no issuer"]
    if kind == "ip":
        groups = s.split(".")
        return ["octets" if all(len(g) <= 3 and int(g) <= 255 for g in groups) else "too large", "padded" if any(len(g) > 1 and g[0] == "0" for g in groups) else "plain"]
    return []


class Weights(dict):
    """What a unit outside scores, by its first character."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, c: str) -> float:
        self[c] = found = self.weights.get(f"out {char_class(c)}", 0.0)
        return found


class Field:
    """Weights of a semi-Markov field; segments outside have length one. The state is whether the last
    segment was an entity."""

    def __init__(self, weights: dict[str, float]):
        self.w = weights
        self.memo: dict[tuple, list[tuple[int, str, float, float]]] = {}

    def arcs(self, text: str) -> tuple[int, list[tuple[int, int]], list[list[tuple[int, str, list[str]]]]]:
        """For each end position the segments that end there: (start, kind or "", features)."""
        units = [m.span() for m in UNIT.finditer(text)]
        found = candidates(text, units)
        ending: list[list[tuple[int, str, list[str]]]] = [[] for _ in range(len(units) + 1)]
        for i, j, kind in found:
            ending[j].append((i, kind, segment_features(text, units[i][0], units[j - 1][1], kind)))
        for j in range(1, len(units) + 1):
            ending[j].append((j - 1, "", [f"out {char_class(text[units[j - 1][0]])}"]))
        return len(found), units, ending

    def score(self, features: list[str], state: int, kind: str) -> float:
        w = self.w
        total = w.get("beside", 0.0) if state and kind else 0.0
        for f in features:
            total += w.get(f, 0.0)
        return total

    def numeric(self, shape: str, left: str, cues: tuple[bool, ...]) -> list[tuple[int, str, float, float]]:
        """Of the numeric segments that begin a shape (0 for digits, a for letters) those that could be
        chosen: (length, kind, score without what the digits say, score of its units outside). One whose
        score can't reach that of its units outside, with two neighbours, is in no best segmentation."""
        w, out = self.w, []
        units = [m.span() for m in UNIT.finditer(shape)]
        beside = 2 * max(w.get("beside", 0.0), 0.0)
        outside = [w.get(f"out {char_class(shape[a])}", 0.0) for a, _ in units[:MOST_UNITS]]
        for i, j, kind in candidates(shape, units, 1):
            end = units[j - 1][1]
            features = segment_features(shape, i, end, kind)
            known = [f for f in features if f.partition(" ")[2] not in BY_VALUE and f.partition(" ")[2].partition(" ")[0] != "left"]
            score = sum(w.get(f, 0.0) for f in known) + w.get(f"{kind} left {left}", 0.0)
            score += sum(w.get(f"{kind} {name}", 0.0) for name, on in zip(("cue", "other cue"), (cues[KINDS.index(kind)], cues[-1])) if on)
            best = score + max(w.get(f"{kind} {a}", 0.0) + w.get(f"{kind} {b}", 0.0) for a, b in VALUES.get(kind, [("", "")]))
            rest = sum(outside[: j])
            if best + beside > rest:
                out.append((end, kind, score, rest))
        return out

    def decode(self, text: str, start: int = 0, end: int | None = None) -> list[Span]:
        """The entities of the best segmentation of a zone. Numeric segments are scored once a shape, which
        the zones of a table share; the rest of their score comes from their digits."""
        end = len(text) if end is None else end
        w, memo = self.w, self.memo
        said = {(k, v): w.get(f"{k} {v}", 0.0) for k, pairs in VALUES.items() for p in pairs for v in p}
        aside = Weights(w)
        units = [m.span() for m in UNIT.finditer(text, start, end)]
        beside = 2 * max(w.get("beside", 0.0), 0.0)
        found: dict[int, list[tuple[int, str, float]]] = {}
        at = None
        for i, (a, b) in enumerate(units):
            c = text[a]
            if c in FIRST:
                reach = NUMBER.match(text, a, end)
                if not reach:
                    continue
                near = text[max(0, a - CUE_REACH) : a]
                cues = tuple([bool(CUES[k].search(near)) for k in KINDS] + [bool(NOT_CUE.search(near))]) if LETTER.search(near) else NO_CUES
                left = char_class(text[a - 1 : a])
                # One more character for the right side; past the zone it is white space.
                key = text[a : reach.end() + 1].translate(SHAPES), left, cues
                scored = memo.get(key)
                if scored is None:
                    if len(memo) >= MOST_SHAPES:
                        memo.clear()
                    scored = memo[key] = self.numeric(*key)
                for size, kind, score, rest in scored:
                    if kind != "phone":
                        x, y = values(text[a : a + size], kind)
                        score += said[kind, x] + said[kind, y]
                    if score + beside > rest:
                        if at is None:
                            at = {y: k + 1 for k, (_, y) in enumerate(units)}
                        found.setdefault(at[a + size], []).append((i, kind, score))
            elif c == "@":
                for x, y, kind in around(text, units, i):
                    score = sum(w.get(f, 0.0) for f in segment_features(text, units[x][0], units[y - 1][1], kind))
                    found.setdefault(y, []).append((x, kind, score))
        if not found:
            return []
        joined = w.get("beside", 0.0)
        low = -math.inf
        plain, entity = [0.0], [low]
        back: dict[int, tuple[int, int, str]] = {}
        for j, (a, _) in enumerate(units, 1):
            plain.append(max(plain[-1], entity[-1]) + aside[text[a]])
            best = low
            for i, kind, score in found.get(j, ()):
                now, before = (plain[i], 0) if plain[i] >= entity[i] + joined else (entity[i] + joined, 1)
                if now + score > best:
                    best, back[j] = now + score, (i, before, kind)
            entity.append(best)
        out, j, state = [], len(units), entity[-1] > plain[-1]
        while j:
            if state:
                i, state, kind = back[j]
                out.append((kind, units[i][0], units[j - 1][1]))
                j = i
            else:
                j -= 1
                state = entity[j] > plain[j]
        return out[::-1]


def add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def gradient(field: Field, arcs, gold: set[tuple[int, int, str]], into: dict[str, float]) -> None:
    """Adds what the true segmentation has of each feature, less what the field expects."""
    _, units, ending = arcs
    n = len(units)
    scores = [[[field.score(f, s, k) for s in (0, 1)] for _, k, f in e] for e in ending]
    ahead = [[0.0, -math.inf]] + [[-math.inf] * 2 for _ in range(n)]
    for j in range(1, n + 1):
        for (i, kind, _), sc in zip(ending[j], scores[j]):
            for s in (0, 1):
                ahead[j][bool(kind)] = add(ahead[j][bool(kind)], ahead[i][s] + sc[s])
    behind = [[-math.inf] * 2 for _ in range(n)] + [[0.0, 0.0]]
    for j in range(n, 0, -1):
        for (i, kind, _), sc in zip(ending[j], scores[j]):
            for s in (0, 1):
                behind[i][s] = add(behind[i][s], sc[s] + behind[j][bool(kind)])
    total = add(*ahead[n])
    ends = {(i, j): k for i, j, k in gold}
    covered = {u for i, j, _ in gold for u in range(i, j)}
    last_entity = {j for _, j, _ in gold}
    for j in range(1, n + 1):
        for (i, kind, features), sc in zip(ending[j], scores[j]):
            true = ends.get((i, j)) == kind if kind else i not in covered
            expected = [math.exp(min(0.0, ahead[i][s] + sc[s] + behind[j][bool(kind)] - total)) for s in (0, 1)]
            change = true - sum(expected)
            if abs(change) > 1e-12:
                for f in features:
                    into[f] = into.get(f, 0.0) + change
            if kind:
                into["beside"] = into.get("beside", 0.0) + (true and i in last_entity) - expected[1]


def sentences(n: int, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Made zones with their entities: addresses, numbers and look-alikes with and without cues."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 8)))

    def card() -> str:
        body = r.choice("3456") + d(r.choice([13, 14, 14, 14, 15]))
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", " ", "-"])
        return sep.join(body[i : i + 4] for i in range(0, len(body), 4)) if sep else body

    def phone() -> str:
        return r.choice([f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{r.randint(10, 99)}{d(9)}"])

    make = {
        "email": lambda: r.choice([f"{word()}.{word()}@{word()}.{r.choice(['com', 'org', 'net', 'de'])}", f"{word()}{d(2)}@{word()}-{word()}.co.uk", f"{word()}+{word()}@{word()}.example.org"]),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": phone,
        "": lambda: r.choice([d(r.randint(1, 6)), f"{d(4)}-{d(2)}-{d(2)}", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", f"{r.randint(256, 999)}.{d(3)}.{d(3)}.{d(3)}", d(16), d(8), d(10), d(12), f"{d(3)}-{d(1)}-{d(5)}-{d(3)}-{d(1)}", word() + d(3), "a" + d(9) + "b" + d(7), f"@{word()}", f"{d(2)}:{d(2)}", f"{d(5)}-{d(4)}", f"{d(4)} {d(4)}", " ".join(d(r.randint(1, 4)) for _ in range(r.randint(3, 9))), " ".join([d(2)] * r.randint(3, 9))]),
    }
    cues = {"email": ["mail ", "contact: "], "ip": ["host ", "ip: "], "card": ["card ", "visa no. "], "phone": ["tel ", "call ", "phone: "], "": ["order ", "invoice no. ", "id ", "version ", "ref "]}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            kind = r.choice([*KINDS, "", "", ""])
            if r.random() < 0.5:
                text += r.choice(cues[kind])
            elif r.random() < 0.5:
                text += word() + " "
            s = make[kind]()
            if kind:
                spans.append((kind, len(text), len(text) + len(s)))
            text += s + r.choice([" ", ". ", ", ", " "])
        out.append((text.rstrip(), spans))
    return out


@lru_cache(maxsize=1)
def trained(n: int = 500, rounds: int = 30, ridge: float = 0.02) -> Field:
    """A field learned from made sentences, by adaptive gradient steps."""
    field, data = Field({}), []
    for text, spans in sentences(n):
        arcs = field.arcs(text)
        starts, ends = {a: i for i, (a, _) in enumerate(arcs[1])}, {b: i + 1 for i, (_, b) in enumerate(arcs[1])}
        gold = {(starts[s], ends[e], k) for k, s, e in spans}
        if all(any((i, k) == (a, kind) for a, kind, _ in arcs[2][j]) for i, j, k in gold for kind in [k]):
            data.append((arcs, gold))
    seen: dict[str, float] = {}
    for _ in range(rounds):
        change: dict[str, float] = {}
        for arcs, gold in data:
            gradient(field, arcs, gold, change)
        for f, g in change.items():
            g = g / len(data) - ridge * field.w.get(f, 0.0) / 10
            seen[f] = seen.get(f, 0.0) + g * g
            field.w[f] = field.w.get(f, 0.0) + 0.6 * g / (math.sqrt(seen[f]) + 1e-8)
    return field


def zones(text: str):
    """(start, end) of the zones, found from their digits and signs outwards, so in time linear in the text
    however long its words are."""
    start = end = -1
    m = HOLDS.search(text)
    while m:
        a, gone = m.start(), SPACE.search(text, m.end())
        b = gone.start() if gone else len(text)
        while a > max(end, 0) and not text[a - 1].isspace():
            a -= 1
        if end >= 0 and a == end + 1 and text[end] == " ":
            end = b
        else:
            if end >= 0:
                yield start, end
            start, end = a, b
        m = HOLDS.search(text, b)
    if end >= 0:
        yield start, end


def more_spans(text: str, field: Field, base: list[Span]) -> list[Span]:
    """The field's spans that overlap no base span."""
    found = [x for a, b in zones(text) if b - a >= LEAST_ZONE for x in field.decode(text, a, b)]
    if not found:
        return found
    taken = sorted((s, e) for _, s, e in base)
    starts, ends, top = [s for s, _ in taken], [], 0
    for _, e in taken:
        top = max(top, e)
        ends.append(top)
    return sorted({f for f in found if not ((k := bisect_left(starts, f[2])) and ends[k - 1] > f[1])}, key=lambda f: f[1])


def scanner(field: Field):
    def scan(text: str) -> tuple[list[Span], list[Span]]:
        base = base_spans(text)
        if "@" not in text and not DIGIT.search(text):
            return base, base
        return base, base + more_spans(text, field, base)

    return scan


def scan_pii(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    weights = trained().w
    return span_rows(docs, lambda: scanner(Field(weights)), KINDS, KINDS)
