"""Secret scans: a linear-chain conditional random field over tokens, decoded by Viterbi.

Fixed patterns find the base spans. A conditional random field then tags every token of a text, of
any length and any mix of signs, as the beginning of a secret, inside one, or outside, from the
token's shape, the words beside it and features of the whole file. A token is a maximal run of
secret characters. The best path over all tokens of a text is found; bounds show which tokens are
outside in it, so that features of the surroundings are made only for the others (see Field).

The field is trained here, by gradient ascent on the likelihood of generated token sequences with
known tags, all from one seed. Secrets (of letters and digits, letters alone, digits alone) stand in
assignments, headers and prose; look-alikes are hashes named as such, identifiers, numbers, dates,
addresses and long words. Generated secrets have SHORTEST to LONGEST characters; shorter and longer
tokens are tagged by the same weights.

Defined results: a null text is empty and has no spans; the digest of no spans is that of the empty
string. Repeated rows get equal results. Added spans never overlap base spans, which stay as they
are. Only the text is read, so other columns can't clash.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Fixed patterns of the base spans.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "crf")
LEAST_VALUE = 12

#: A token of the field: letters, digits, + / _ - of any number, and base64 padding.
TOKEN = re.compile(r"""[A-Za-z0-9+/_-]++(?:==?(?![A-Za-z0-9+/_="'-]))?""")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
SEED, STEPS, RATE = 5, 120, 0.5
#: Generated chains and their tokens; least and most characters of generated secrets.
CHAINS, CHAIN, SHORTEST, LONGEST = 2000, 8, 8, 48
#: Most tokens whose bounds a worker keeps (then it starts anew), and the longest that it keeps.
KNOWN, LONG_KEY = 300_000, 64

RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def entropy(token: str) -> float:
    counts = map(token.count, set(token))
    return math.log2(len(token)) - sum(c * math.log2(c) for c in counts if c > 1) / len(token)


#: Words whose neighbourhood speaks for or against a secret.
FOR = ("password", "passwd", "secret", "token", "api", "key", "auth", "bearer", "credential", "private", "pwd", "access")
AGAINST = ("sha", "md5", "commit", "checksum", "hash", "uuid", "id", "http", "https", "url", "digest", "version", "revision", "etag")
#: Common pairs of letters in words of English, German, French and Spanish.
PAIRS = frozenset(
    """th he in er an re on at en nd st es ed to it or ti ar te ng al is ou nt as ha le se ve of me de hi ea ne ri ro co io ic ra li ch ma si om ur
    il el la ta us di lo no ec ca pe ho ge so ce tr wh ll ee ss ly be wi wa ie ei un au eu ue qu ui ai oi au ux ng ke it ht sc hl hr gt rt ft
    rs rd rn rm rk rl ls ts ns ds ct pr pl bl br cl cr fr fl gr gl dr sp sh sk sm sn sw tw tt pp mm nn rr ff oo os ad do id am im em um po pa pi
    ap op ep ab ob ib ub bo bi ba bu da du fa fe fi fo fu ga gi go gu ki ka ko ku lu mo mi mu na ni nu ru sa su tu va vi vo vu we wo ye yo za ze
    zu ac ag eg ig og ug ut et ot ev av iv ov ow aw ew ay ey oy if ef af uf ir ul ol ip up ey ry ny ty gs ks ms ps ws nc nk nf lt ld lf rg rb rv rc tz""".split()
)
SHAPES = (
    "bias", "from_4", "from_6", "from_8", "from_10", "from_12", "from_16", "from_20", "from_28", "from_60", "digits", "many_digits", "all_digits", "letters_and_digits", "all_hex", "all_letters", "all_lower",
    "case_switches", "case_switches_5", "high_entropy", "low_entropy", "rare_pairs", "very_rare_pairs", "rare_pairs_from_10", "path", "parts", "uuid", "word_case", "mixed_from_8", "letters_from_20",
)
BESIDE = ("for", "for_last", "against", "against_last", "assigned", "quoted", "glued", "joined", "file_for", "file_code", "for_assigned", "for_odd", "assigned_odd", "for_inside")
FEATURES = SHAPES + BESIDE
HIGH, LOW = SHAPES.index("high_entropy"), SHAPES.index("low_entropy")
#: Lengths at which the shape of a word changes; words whose shape depends on little else than length.
STEPS_OF_LENGTH = (4, 6, 8, 10, 12, 16, 20, 28, 60)
PLAIN = re.compile(r"[A-Z]?[a-z]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
WORD_CASE = re.compile(r"(?:[A-Z]?[a-z]++[0-9]{0,2}+[-_/]?+)++")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
ASSIGNED = re.compile(r"[:=]\s*[\"'`]?$")


#: Classes of characters: upper case, lower case, digit; others stay.
CLASSES = {**dict.fromkeys(range(65, 91), "U"), **dict.fromkeys(range(97, 123), "L"), **dict.fromkeys(range(48, 58), "D")}


def rarity(common: int, pairs: int) -> int:
    """0, 1 or 2: under three tenths of the pairs of letters are not common, under a half, or more."""
    rare = 10 * (pairs - common)
    return 0 if rare < 3 * pairs or not pairs else 1 if rare < 5 * pairs else 2


def shape(token: str) -> list[float]:
    """Features of a token by itself, then: is a word for or against in it, is it no plain word, is it padded."""
    n, body = len(token), token.rstrip("=")
    low, kinds = body.lower(), body.translate(CLASSES)
    upper, lower, digits = kinds.count("U"), kinds.count("L"), kinds.count("D")
    letters = upper + lower
    switches = kinds.count("UL", 1) + kinds.count("LU", 1)
    pairs = list(map(str.__add__, low, low[1:]))
    if letters < len(body):
        pairs = [x for x in pairs if x.isalpha()]
    rare = rarity(sum(map(PAIRS.__contains__, pairs)), len(pairs))
    e = entropy(token) if n >= 8 else 2.0
    mixed = digits > 0 and letters > 0
    named = {low} if lower == len(body) else {x.lower() for x in NAMES.findall(body)} | {low}
    return [
        1, n >= 4, n >= 6, n >= 8, n >= 10, n >= 12, n >= 16, n >= 20, n >= 28, n >= 60, digits > 0, digits >= n / 4, digits == len(body), mixed, mixed and not re.search("[^0-9a-fA-F]", token), letters == len(body), lower == len(body),
        switches >= 2, switches >= 5, e >= 3.8, e < 3.0, rare > 0, rare > 1, rare > 0 and len(pairs) >= 9, body.count("/") >= 3, body.count("-") + body.count("_") >= 2, n == 36 and UUID.fullmatch(body) is not None, WORD_CASE.fullmatch(body) is not None, mixed and n >= 8, letters == len(body) and n >= 20,
        not named.isdisjoint(FOR), not named.isdisjoint(AGAINST), n >= 6 and (mixed or digits == len(body) or rare > 0 or switches >= 2), n > len(body),
    ]


def gap_shape(gap: str) -> tuple[bool, ...]:
    """What a gap says: an assignment at its end, a quote at its end, one at its start, a letter at its end, one at its start, a mark between tokens."""
    return ASSIGNED.search(gap[-40:]) is not None, gap[-1:] in ('"', "'", "`"), gap[:1] in ('"', "'", "`"), gap[-1:].isalpha(), gap[:1].isalpha(), 0 < len(gap) <= 2 and not gap.isspace()


def before(x: np.ndarray, by: int) -> np.ndarray:
    """x moved on by so many tokens, nothing before the first."""
    return np.concatenate([np.zeros(min(by, len(x))), x[: max(len(x) - by, 0)]])


def file_says(text: str) -> tuple[bool, bool]:
    low = text.lower()
    return any(k in low for k in FOR[:5]), any(c in text for c in "{};")


#: So many tokens before a token are looked at.
BACK = 3


def describe(text: str, spans: list[tuple[int, int]], first: int, last: int, says: tuple[bool, bool]) -> np.ndarray:
    """Features of the tokens from first up to last, from their shapes, the text beside them and the file."""
    at = max(0, first - BACK)
    own = spans[at:last]
    rows = np.array([shape(text[s:e]) for s, e in own], float)
    edges = [spans[at - 1][1] if at else 0, *(x for span in own for x in span), spans[last][0] if last < len(spans) else len(text)]
    g = np.array([gap_shape(text[s:e]) for s, e in zip(edges[::2], edges[1::2], strict=True)], float)
    n, shapes = len(own), len(SHAPES)
    speaks_for, against, odd, padded = rows[:, shapes:].T
    fors, againsts = before(speaks_for, 1), before(against, 1)
    near, far = np.maximum(np.maximum(fors, before(speaks_for, 2)), before(speaks_for, 3)), np.maximum(np.maximum(againsts, before(against, 2)), before(against, 3))
    assigned = np.maximum(g[:n, 0], before(padded, 1) * (g[:n, 5] == 0))
    out = [near, fors, far, againsts, assigned, g[:n, 1] * g[1:, 2], np.maximum(g[:n, 3], g[1:, 4]), g[:n, 5], np.full(n, says[0]), np.full(n, says[1]), near * assigned, near * odd, assigned * odd, speaks_for]
    return np.hstack([rows[:, :shapes], np.stack(out, 1)])[first - at :]


def spans_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def viterbi(unary: np.ndarray, step: np.ndarray) -> list[int]:
    """Best tags of one chain; INSIDE can't follow OUTSIDE or start a chain."""
    score, back = unary[0] + np.array([0, 0, -1e9]), []
    for u in unary[1:]:
        total = score[:, None] + step
        back.append(total.argmax(0))
        score = total.max(0) + u
    tags = [int(score.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


LETTERS, DIGITS, HEXES = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
SYLLABLES = "the er in an on re ti th st nd ing ed es or ou en ha at to as sh wh ly ble tion der die sch ung keit heit ver be ge ein ich ach le la de que ai eau eux ment elle ci el os as do ra ca ll ado mente o a e i".split()


def word(rng: random.Random) -> str:
    """A made-up word of prose, now and then a long compound."""
    out = "".join(rng.choice(SYLLABLES) for _ in range(rng.choice((1, 1, 2, 2, 3, 4, 6, 8))))
    return out.capitalize() if rng.random() < 0.15 else out


def made(rng: random.Random, least: int = SHORTEST) -> str:
    """A secret: letters and digits, letters of both cases, lower-case letters, digits, hexadecimal or base64."""
    size = rng.choice((rng.randint(least, 16), rng.randint(least, LONGEST)))
    signs = rng.choice((LETTERS + LETTERS.upper() + DIGITS,) * 3 + (LETTERS + LETTERS.upper(), LETTERS, DIGITS, HEXES, LETTERS + DIGITS, LETTERS.upper() + DIGITS, LETTERS + LETTERS.upper() + DIGITS + "+/"))
    return "".join(rng.choice(signs) for _ in range(size))


def example(rng: random.Random) -> tuple[str, list[tuple[int, int]], int]:
    """A text, the spans of its one secret's parts (none where it has none), and where its case starts."""
    name, other = rng.choice(FOR), rng.choice(AGAINST)
    quote, hexes = rng.choice("\"'"), "".join(rng.choice(HEXES) for _ in range(rng.choice((32, 40, 64))))
    label = rng.choice((name, name.upper(), f"{word(rng)}_{name}", f"{name}_{word(rng)}", name.capitalize()))
    secret, kind = None, rng.randrange(16)
    if kind == 0:
        start, secret, end = f"{label}{rng.choice((' = ', '=', ': '))}{quote}", made(rng), quote
    elif kind == 1:
        start, secret, end = f"{label}{rng.choice((': ', '=', ' = '))}", made(rng), rng.choice(("\n", " ", ", "))
    elif kind == 2:
        start, secret, end = rng.choice(("Authorization: Bearer ", "authorization: bearer ", "Bearer ", "auth: ")), made(rng), "\n"
    elif kind == 3:
        start, secret, end = f"the {name} is ", made(rng, 12), f" {word(rng)}"
    elif kind == 4:
        start, secret, end = rng.choice(("", word(rng) + " ", word(rng) + ": ")), "".join(rng.choice(LETTERS + LETTERS.upper() + DIGITS) for _ in range(rng.randint(20, LONGEST))), rng.choice((" ", "\n", ". "))
    elif kind == 5:
        start, end = f"{label} = {quote}", quote
        secret = made(rng, 16)
    elif kind in (6, 7):
        start, end = rng.choice((f"the {name} ", f"{label}: ", f"{label} = ", f"a {name} of ", f"{label}=")), f"{rng.choice((word(rng), 'required', 'string', 'none', 'true', 'your', 'is', 'was', str(rng.randint(0, 9999))))} {word(rng)}"
    elif kind == 8:
        start, end = f"{rng.choice((other, other.upper(), word(rng) + '_' + other))}{rng.choice((': ', ' ', '=', ' = '))}", hexes + "\n"
    elif kind == 9:
        start, end = f"{word(rng)} ", "-".join("".join(rng.choice(HEXES) for _ in range(k)) for k in (8, 4, 4, 4, 12)) + " "
    elif kind == 10:
        start, end = rng.choice((f"https://{word(rng)}.example/", f"{word(rng)}/", "/")), "/".join(word(rng).lower() + rng.choice(("", str(rng.randint(0, 99)))) for _ in range(4)) + " "
    elif kind == 11:
        start, end = f"{word(rng)} ", rng.choice((f"555-{rng.randint(0, 9999):04}", f"20{rng.randint(10, 30)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", str(rng.randint(0, 10 ** rng.randint(1, 16))), f"v{rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}", f"{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.7")) + " "
    elif kind == 12:
        start, end = f"{word(rng)}{rng.choice((' = ', '(', ' ', ': ', '=', ' = ' + quote))}", rng.choice(("_", "-", "")).join(word(rng).capitalize() if rng.random() < 0.5 else word(rng) for _ in range(rng.randint(2, 4))) + rng.choice(("", str(rng.randint(0, 99)))) + rng.choice((" ", ")", quote, ";"))
    elif kind == 13:
        start, end = "", f"{word(rng).lower()}.{word(rng).lower()}{rng.randint(0, 99)}@{word(rng).lower()}.example "
    else:
        start, end = "", word(rng) + rng.choice((". ", ", ", " ", "\n", " | ", "é", "ñ"))
    front = "".join(word(rng) + rng.choice((" ",) * 6 + (", ", ". ", ".\n", " | ", "é", "ñ")) for _ in range(rng.choice((0, 1, 2, 4, 7))))
    front += rng.choice(("", "", "", "{ ", "; "))
    text, spans = front + start, []
    if secret is not None:
        spans.append((len(text), len(text) + len(secret)))
        text += secret
        if kind not in (1, 3) and rng.random() < 0.3:  # a secret that goes on in a second token
            text += rng.choice((".", "\\\n    ", f"{quote}, {quote}" if end == quote else ".", f"{quote}\r\n{quote}" if end == quote else "."))
            more = "".join(rng.choice(LETTERS + LETTERS.upper() + DIGITS) for _ in range(rng.randint(12, LONGEST)))
            spans.append((len(text), len(text) + len(more)))
            text += more
    text += end
    if secret is not None and rng.random() < 0.4:  # what stands behind a secret is mostly none
        path = "/".join(word(rng).lower() + rng.choice(("", f"-{rng.randint(0, 99)}")) for _ in range(rng.randint(1, 3)))
        number = "-".join("".join(rng.choice(HEXES) for _ in range(k)) for k in (8, 4, 4, 4, 12))
        text += rng.choice(("\n", ",\n", " ")) + rng.choice((f"{word(rng).upper()} /{path} {rng.randint(0, 999)}", f"{other}: {number}", f"https://{word(rng).lower()}.example/{path}", f"{word(rng).lower()}_{word(rng).lower()} = {rng.randint(0, 10**6)}"))
    text += "".join(" " + word(rng) for _ in range(2 * CHAIN))
    return text, spans, len(front)


def generated(n: int, rng: random.Random) -> tuple[np.ndarray, np.ndarray]:
    """n chains of CHAIN tokens, cut from generated texts: features and tags."""
    x, y = [], []
    for _ in range(n):
        text, parts, case = example(rng)
        spans = spans_of(text)
        tags = [OUTSIDE] * len(spans)
        for part, (s, e) in enumerate(parts):
            for j, k in enumerate(k for k, x in enumerate(spans) if x[0] < e and x[1] > s):
                tags[k] = INSIDE if part or j else BEGIN
        at = max(0, sum(s < case for s, _ in spans) - rng.randrange(4))
        x.append(describe(text, spans, at, at + CHAIN, file_says(text)))
        y.append(tags[at : at + CHAIN])
    return np.array(x), np.array(y)


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (np.log(np.exp(a - top).sum(axis, keepdims=True)) + top).squeeze(axis)


@cache
def model() -> tuple[np.ndarray, np.ndarray]:
    """Weights of features by tag and of tag pairs, by gradient ascent on the log-likelihood."""
    x, y = generated(CHAINS, random.Random(SEED))
    w, step = np.zeros((x.shape[2], 3)), np.zeros((3, 3))
    banned = np.zeros((3, 3))
    banned[OUTSIDE, INSIDE] = -1e9
    start = np.array([0, 0, -1e9])
    hot, flat = np.eye(3)[y], x.reshape(-1, x.shape[2])
    for _ in range(STEPS):
        u, s = (flat @ w).reshape(*y.shape, 3), step + banned
        n = u.shape[1]
        ahead, behind = [u[:, 0] + start], [np.zeros_like(u[:, 0])]
        for t in range(1, n):
            ahead.append(log_sum(ahead[-1][:, :, None] + s, 1) + u[:, t])
            behind.append(log_sum(s[None] + (behind[-1] + u[:, n - t])[:, None, :], 2))
        behind.reverse()
        total = log_sum(ahead[-1], 1)
        single = np.exp(np.stack(ahead, 1) + np.stack(behind, 1) - total[:, None, None])
        gradient = flat.T @ (hot - single).reshape(-1, 3) / len(x) - 1e-3 * w
        pairs = np.zeros((3, 3))
        for t in range(1, n):
            both = np.exp(ahead[t - 1][:, :, None] + s + (u[:, t] + behind[t])[:, None, :] - total[:, None, None])
            pairs += (hot[:, t - 1, :, None] * hot[:, t, None, :] - both).mean(0)
        w += RATE * gradient
        step += RATE * (pairs - 1e-3 * step)
    return w, step + banned


class Field:
    """The trained field: finds the best path of a text, with work only where it can leave OUTSIDE.

    A secret, or the rest of one from any of its tokens on, can always be tagged OUTSIDE instead. So
    in the best path the most that its tokens can win, added up from each of them to its end, is
    above zero. A token for which no such end exists is OUTSIDE, and the chain falls apart there.
    The most that a token can win is bounded by its shape, by whether a word for a secret stands
    near, and by the best that may else stand beside it.
    """

    def __init__(self, w: np.ndarray, step: np.ndarray):
        self.w, self.step = w, step
        # the most that the tags beside a token add, with the step out of a secret counted at each token
        into = [step[p, BEGIN] - step[p, OUTSIDE] for p in range(3)] + [step[p, INSIDE] - step[q, OUTSIDE] for p in (BEGIN, INSIDE) for q in (p, OUTSIDE)]
        out = [step[p, q] - step[OUTSIDE, q] for p in (BEGIN, INSIDE) for q in (OUTSIDE, BEGIN)]
        self.gain = gain = max(0.0, *into) + max(0.0, *out)
        over = w[:, 1:] - w[:, :1]
        beside = dict(zip(BESIDE, over[len(SHAPES) :], strict=True))
        # rows: what may stand beside a token where no word for is near, and where one is
        near, odd = ("for", "for_last", "for_assigned"), ("for_odd", "assigned_odd")
        best = {k: np.maximum(v, 0) for k, v in beside.items()}
        apart = gain + sum(v for k, v in best.items() if k not in (*near, *odd, "for_inside"))
        self.rest = np.stack([apart, apart + sum(best[k] for k in near)])
        none = np.zeros(2)
        self.own = np.stack([np.vstack([over[: len(SHAPES)], beside["for_inside"], none, v, none]) for v in (best["assigned_odd"], best["assigned_odd"] + best["for_odd"])])
        self.apart: dict[str, float] = {}
        self.near: dict[str, float] = {}
        self.speaking: set[str] = set()
        self.plain: dict[tuple, list[float]] = {}

    def bound(self, names: list[str]) -> list[float]:
        """A bound on what each token can win."""
        if len(self.apart) > KNOWN:
            for x in (self.apart, self.near, self.speaking):
                x.clear()
        new = list(set(names).difference(self.apart))
        others = []
        for x in new:
            if PLAIN.fullmatch(x) is None:
                others.append(x)
                continue
            low = x.lower()
            common = sum(map(PAIRS.__contains__, map(str.__add__, low, low[1:])))
            kind = (bisect.bisect(STEPS_OF_LENGTH, len(x)), rarity(common, len(x) - 1), low == x, low in FOR)
            if (found := self.plain.get(kind)) is None:
                rows = np.array([shape(x)] * 3, float)  # any entropy: neither high nor low, high, low
                rows[:, [HIGH, LOW]] = [[0, 0], [1, 0], [0, 1]]
                found = self.plain[kind] = [float((rows @ own + rest).max()) for own, rest in zip(self.own, self.rest, strict=True)]
            self.apart[x], self.near[x] = found
            if low in FOR:
                self.speaking.add(x)
        if others:
            rows = np.array([shape(x) for x in others], float)
            for known, own, rest in zip((self.apart, self.near), self.own, self.rest, strict=True):
                known.update(zip(others, (rows @ own + rest).max(1).tolist(), strict=True))
            self.speaking.update(others[k] for k in np.flatnonzero(rows[:, len(SHAPES)]))
        out = list(map(self.apart.__getitem__, names))
        if here := self.speaking.intersection(names):
            for k in {j for k, x in enumerate(names) if x in here for j in range(k + 1, min(k + BACK + 1, len(names)))}:
                out[k] = self.near[names[k]]
        for x in new:
            if len(x) > LONG_KEY:
                del self.apart[x], self.near[x]
                self.speaking.discard(x)
        return out

    def tags(self, text: str) -> list[tuple[int, int, int]]:
        """(start, tag, end) of the tokens that the best path of all tokens tags as secrets."""
        names = TOKEN.findall(text)
        most = self.bound(names)
        if not names or max(most) <= 0:
            return []
        spans, says = spans_of(text), file_says(text)
        out, end = [], len(most)
        while end > 0:
            end -= 1
            if most[end] <= 0:
                continue
            first, won = end, most[end]
            while first and won + most[first - 1] > 0:
                first -= 1
                won = max(won, 0.0) + most[first]
            unary = describe(text, spans, first, end + 1, says) @ self.w
            if (unary[:, 1:] - unary[:, :1]).max() + self.gain > 0:
                held = np.array([[0, -1e9, -1e9]])
                best = viterbi(np.vstack([held, unary, held]), self.step)[1:-1]
                out += [(spans[first + k][0], tag, spans[first + k][1]) for k, tag in reversed(list(enumerate(best))) if tag]
            end = first
        return out[::-1]


@cache
def field(weights: bytes) -> Field:
    """One field for each worker; weights are those of kept()."""
    flat = np.frombuffer(weights).reshape(-1, 3)
    return Field(flat[:-3], flat[-3:])


@cache
def kept() -> bytes:
    return np.vstack(model()).tobytes()


def added_spans(text: str, base: list[tuple[int, int, int]], weights: bytes | None = None) -> list[tuple[int, int, int]]:
    """Spans that the field tags as secrets and that overlap no base span."""
    out = []
    for start, tag, end in field(weights or kept()).tags(text):
        if tag == BEGIN:
            out.append([start, 3, end])
        else:
            out[-1][2] = end
    # the furthest end of the base spans that start before a span's end
    starts, ends = [s for s, _, _ in base], list(itertools.accumulate((e for _, _, e in base), max))
    return [tuple(x) for x in out if not (n := bisect.bisect_left(starts, x[2])) or ends[n - 1] <= x[0]]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(text: str, weights: bytes | None = None) -> tuple[int, int, int, str, str]:
    base = base_spans(text)
    counts = [sum(k == kind for _, kind, _ in base) for k in range(3)]
    return *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added_spans(text, base, weights)))


def apply(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns named in keep and the spans of every row."""
    small_batches(docs.sparkSession)
    weights = kept()

    @F.pandas_udf(RESULT)
    def find(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan(t or "", weights) for t in texts], columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(*keep, find("text").alias("__found")).select(*keep, "__found.*")
