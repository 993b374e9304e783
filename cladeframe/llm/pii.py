"""Personal data by weak supervision, with DataFrame and SQL functions only.

Fixed patterns find the base spans. Beside them, a broad pattern proposes candidate spans, and
labelers vote on each (for, against, abstain): the strict pattern of the candidate's kind, its
checksum or range, a gazetteer of domains, words before it that speak for it or against it, and its
borders. Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is and how likely each pattern is personal data. A logistic span classifier is trained on
span features with these likelihoods as soft labels, and decides. Accepted candidates that overlap
no base span are added, unless their checksum or range is wrong; base spans stay.

Positions are code points. They come from the lengths of the pieces between matches, so regular
expressions run inside the JVM and no Python touches a row. Patterns use possessive repeats: each
is linear in the text, and no repeat recurses. Running totals are made in blocks of blocks, the words
beside a candidate come from the pieces beside it, and overlaps are counted by ranks in sorted
arrays, so the work on one text grows with its length, not with the square of its matches.

The table of vote patterns and features has at most 3 ** 6 times a few hundred rows, whatever the
data; the models are fitted on it by the driver.

Defined results: a null text is empty and has no spans; the digest of no spans is that of the empty
string. Repeated rows get equal results and each count in the estimates. Without candidates nothing
is added. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

#: Base patterns in Java's syntax. The e-mail pattern starts where a run of its characters starts or the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ \-]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9\-]+[0-9]"

#: Candidates: an address written out, a long number, and a phone number without its country.
SPELLED = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9\-]++(?: ?(?:[\[(] ?(?:dot|DOT) ?[\])]|\.) ?[A-Za-z0-9\-]++)++"
NUMBER = r"(?<![0-9])[0-9]{12,19}(?![0-9])"
LOCAL = r"(?<![0-9+])\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9])"
CANDIDATE = f"{EMAIL}|{SPELLED}|{NUMBER}|{LOCAL}|{IP}"

#: Gazetteers: ends of domains, and words that speak for or against personal data right before it.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|us|ca"
FOR = "mail|email|contact|kontakt|contacto|phone|tel|telefon|téléphone|teléfono|call|fax|mobile|card|visa|mastercard|karte|carte|tarjeta|ip|host|address|reach|write"
AGAINST = "version|isbn|issn|order|invoice|serial|sku|doi|part|model|build|release|section|figure|page|timestamp"
LABELERS = ("strict", "checked", "domain", "before_for", "before_against", "border")

EM_STEPS, FIT_STEPS, RATE, ACCEPT = 50, 400, 0.5, 0.9
#: Characters before a candidate that are looked at, and so many candidates as surely fill them.
BEFORE, FILLING = 24, 5
#: Elements of an array whose running totals are made at once, and how often blocks are made of blocks.
STEP, NESTED = 64, 2
#: Pseudo-counts of each vote given the truth: a labeler is right more often than wrong before any data.
PRIOR_RIGHT, PRIOR_WRONG, PRIOR_NONE = 8.0, 2.0, 5.0


SPANS = "array<struct<start:int,end:int,found:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(a: Column, nested: int = NESTED) -> Column:
    """Running totals of an array of ints. Blocks of STEP are summed by themselves and moved by the totals before them."""

    def add(state: Column, x: Column) -> Column:
        total = state["total"] + x
        return F.struct(total.alias("total"), F.concat(state["out"], F.array(total)).alias("out"))

    def plain(x: Column) -> Column:
        first = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, first, add, lambda s: s["out"])

    def shifted(inner: Column) -> Column:
        totals = running(F.transform(inner, lambda x: F.element_at(x, -1)), nested - 1)
        before = F.slice(F.concat(F.array(F.lit(0)), totals), 1, F.size(inner))
        return F.flatten(F.zip_with(inner, before, lambda x, n: F.transform(x, lambda y: y + n)))

    if not nested:
        return plain(a)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / STEP).cast("int")), lambda i: plain(F.slice(a, i * STEP + 1, STEP)))
    return F.when(F.size(a) <= STEP, plain(a)).otherwise(let(blocks, shifted))


def spans_between(pieces: Column, found: Column) -> Column:
    """Array of (start, end, found) of matches and the pieces between them, in code points."""
    ends = running(F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.char_length(p) + F.char_length(m)))
    return F.zip_with(ends, found, lambda e, m: F.struct((e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("found")))


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of a pattern's matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda p: spans_between(p, m))).otherwise(none()))


def with_context(pieces: Column, found: Column) -> Column:
    """Spans with the BEFORE characters before them and the one after.

    Where the piece before a match is shorter, the matches and pieces before it fill it up: a
    candidate has five characters or more, so FILLING of them do.
    """

    def tail(x: Column) -> Column:
        return F.right(x, F.lit(BEFORE))

    def all_of(spans: Column, tails: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            piece, after = F.get(pieces, i), F.get(pieces, i + 1)
            # get() of a negative place is null, which concat_ws leaves out
            filled = tail(F.concat_ws("", *[F.get(tails, i - k) for k in range(FILLING, 0, -1)], tail(piece)))
            before = F.when(F.char_length(piece) >= BEFORE, tail(piece)).otherwise(filled)
            right = F.when(after != "", F.left(after, F.lit(1))).otherwise(F.coalesce(F.left(F.get(found, i + 1), F.lit(1)), F.lit("")))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"), before.alias("before"), right.alias("right"))

        return F.transform(spans, one)

    tails = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.concat(tail(p), tail(m)))
    return let(spans_between(pieces, found), lambda s: let(tails, lambda t: all_of(s, t)))


def only(found: Column) -> Column:
    """The digits of a match."""
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, size - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return (size > 0) & (F.aggregate(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), F.lit(0), add) % 10 == 0)


def octets(found: Column) -> Column:
    """Whether each part of dotted numbers is at most 255."""
    return F.forall(F.split(found, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)


def none() -> Column:
    return F.array().cast(SPANS)


def base(text: Column) -> list[Column]:
    """Arrays of base spans, by kind; a cheap test first sorts out texts without any."""
    return [
        F.when(F.contains(text, F.lit("@")), located(text, EMAIL)).otherwise(none()),
        F.filter(F.when(F.regexp_like(text, F.lit(IP)), located(text, IP)).otherwise(none()), lambda s: octets(s["found"])),
        F.filter(F.when(F.regexp_like(text, F.lit(r"[0-9](?:[ \-]?[0-9]){15}")), located(text, CARD)).otherwise(none()), lambda s: F.length(only(s["found"])).between(16, 19) & luhn(only(s["found"]))),
        F.filter(F.when(F.contains(text, F.lit("+")), located(text, PHONE)).otherwise(none()), lambda s: F.length(only(s["found"])).between(8, 15)),
    ]


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def judged(text: Column) -> Column:
    """Candidates of a text with their kind, votes and features."""
    kind = "array<struct<start:int,end:int,found:string,before:string,right:string>>"
    possible = F.regexp_like(text, F.lit("[0-9@]|[\\[(] ?(?:at|AT) ?[\\])]"))
    found = F.when(possible, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    seen = let(found, lambda m: F.when(F.size(m) > 0, let(F.split(text, CANDIDATE, -1), lambda p: with_context(p, m))).otherwise(F.array().cast(kind)))

    def one(s: Column) -> Column:
        found, digits = s["found"], only(s["found"])
        email = F.contains(found, F.lit("@")) | F.regexp_like(found, F.lit(r"[\[(] ?(?:at|AT) ?[\])]"))
        ip = ~email & F.regexp_like(found, F.lit(f"^{IP}$"))
        phone = ~email & ~ip & F.regexp_like(found, F.lit("[^0-9]"))
        card = ~email & ~ip & ~phone
        before, left, right = F.lower(s["before"]), F.right(s["before"], F.lit(1)), s["right"]
        long = F.length(digits)
        strict = vote(F.regexp_like(found, F.lit(f"^(?:{EMAIL})$")) | (ip & octets(found)) | (card & long.between(16, 19)) | (phone & (long == 10)), card & (long < 16))
        checked = F.when(card, vote(luhn(digits), ~luhn(digits))).when(ip, vote(octets(found), ~octets(found))).otherwise(0)
        domain = F.when(email, vote(F.regexp_like(F.lower(found), F.lit(rf"(?:\.|[\])] ?)(?:{DOMAINS})$")), F.lit(True))).otherwise(0)
        says_for = vote(F.regexp_like(before, F.lit(rf"(?<!\pL)(?:{FOR})\PL{{0,4}}$")), F.lit(False))
        says_against = vote(F.lit(False), F.regexp_like(before, F.lit(rf"(?<!\pL)(?:{AGAINST})\PL{{0,4}}$")))
        glued = F.regexp_like(left, F.lit(r"[\pL\pN/#_=]")) | F.regexp_like(right, F.lit(r"[\pL\pN/_=]"))
        kind = F.when(email, 0).when(ip, 1).when(card, 2).otherwise(3)
        return F.struct(
            kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *[v.cast("int").alias(n) for n, v in zip(LABELERS, (strict, checked, domain, says_for, says_against, vote(~glued, glued)), strict=True)],
            F.least(F.floor(F.length(found) / 8), F.lit(5)).cast("int").alias("size"), F.least(long, F.lit(20)).cast("int").alias("digits"),
        )

    return F.transform(seen, one)


@dataclass
class Model:
    """Weights of the span classifier by feature; bounded by the features, not by the data."""

    weights: dict[tuple[str, int], float]


def expectation_maximisation(rows: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """Likelihood of personal data by vote pattern; rows: (votes, count). Dawid and Skene's model of conditionally independent labelers."""
    truth = {v: (1 + sum(x > 0 for x in v)) / (2 + sum(x != 0 for x in v)) for v, _ in rows}
    for _ in range(EM_STEPS):
        total = sum(n for _, n in rows)
        share = (1 + sum(n * truth[v] for v, n in rows)) / (2 + total)
        table = []
        for k in range(len(LABELERS)):
            counts = {(y, x): PRIOR_NONE if x == 0 else PRIOR_RIGHT if (x > 0) == bool(y) else PRIOR_WRONG for y in (0, 1) for x in (-1, 0, 1)}
            for v, n in rows:
                counts[1, v[k]] += n * truth[v]
                counts[0, v[k]] += n * (1 - truth[v])
            table.append({(y, x): c / sum(counts[y, z] for z in (-1, 0, 1)) for (y, x), c in counts.items()})
        for v in truth:
            yes = math.log(share) + sum(math.log(t[1, x]) for t, x in zip(table, v, strict=True))
            no = math.log(1 - share) + sum(math.log(t[0, x]) for t, x in zip(table, v, strict=True))
            truth[v] = 1 / (1 + math.exp(max(-40.0, min(40.0, no - yes))))
    return truth


#: What the classifier sees of a span.
SEEN = ("kind", "size", "digits", "checked", "domain", "before_for", "before_against", "border")


def fit(docs: DataFrame) -> Model:
    """Counts vote patterns and features over all documents, then fits both models on that bounded table."""
    names = [*LABELERS, "kind", "size", "digits"]
    spans = docs.select(F.explode(judged(F.coalesce("text", F.lit("")))).alias("s")).select(*[f"s.{n}" for n in names])
    rows = [(r.asDict(), r["count"]) for r in spans.groupBy(*names).count().orderBy(*names).collect()]
    votes: dict[tuple[int, ...], int] = {}
    for r, n in rows:
        v = tuple(r[x] for x in LABELERS)
        votes[v] = votes.get(v, 0) + n
    truth = expectation_maximisation(sorted(votes.items()))
    weights: dict[tuple[str, int], float] = {("bias", 0): 0.0}
    total = sum(n for _, n in rows)
    cells = [([("bias", 0), *[(f, r[f]) for f in SEEN]], n / total, truth[tuple(r[x] for x in LABELERS)]) for r, n in rows]
    for _ in range(FIT_STEPS):
        gradient: dict[tuple[str, int], float] = {}
        for keys, share, y in cells:
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, sum(weights.get(k, 0.0) for k in keys)))))
            for k in keys:
                gradient[k] = gradient.get(k, 0.0) + share * (y - p)
        for k, g in gradient.items():
            weights[k] = weights.get(k, 0.0) + RATE * (g - 1e-4 * weights.get(k, 0.0))
    return Model(weights)


def accepted(s: Column, model: Model) -> Column:
    """Whether the classifier accepts a judged candidate."""
    total = F.lit(model.weights[("bias", 0)])
    for f in SEEN:
        value = F.lit(0.0)
        for (name, x), w in sorted(model.weights.items()):
            if name == f:
                value = F.when(s[f] == x, F.lit(w)).otherwise(value)
        total = total + value
    return total >= math.log(ACCEPT / (1 - ACCEPT))


def apart(spans: Column, others: Column) -> Column:
    """Those of the spans, ordered and without overlaps among them, that overlap none of the others.

    A span overlaps as many others as start before its end, less those that end before its start.
    Both numbers are ranks in a sorted array.
    """

    def ranks(counted: str, asked: str, first: int) -> Column:
        def row(name: str, order: int, value: int) -> Callable[[Column], Column]:
            return lambda x: F.struct(x[name].alias("at"), F.lit(order).alias("order"), F.lit(value).alias("value"))

        events = F.sort_array(F.concat(F.transform(others, row(counted, 1 - first, 1)), F.transform(spans, row(asked, first, 0))))
        return let(events, lambda e: F.filter(F.zip_with(e, running(F.transform(e, lambda x: x["value"])), lambda x, n: F.when(x["value"] == 0, n)), lambda n: n.isNotNull()))

    overlaps = F.zip_with(ranks("start", "end", 0), ranks("end", "start", 1), lambda a, b: a - b)
    return F.transform(F.filter(F.zip_with(spans, overlaps, lambda s, n: F.struct(s.alias("s"), n.alias("n"))), lambda x: x["n"] == 0), lambda x: x["s"])


def apply(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns named in keep and the spans of every row."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(*keep, text.alias("__text")).withColumn("__base", F.array(*base(F.col("__text")))).withColumn("__more", judged(F.col("__text")))
    shape = "array<struct<kind:int,start:int,end:int>>"
    ours = F.flatten(F.transform("__base", lambda a, k: F.transform(a, lambda s: F.struct(k.alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))).cast(shape)
    good = F.transform(F.filter("__more", lambda m: (m["checked"] >= 0) & accepted(m, model)), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"))).cast(shape)
    out = slim.select(*keep, "__base", ours.alias("__ours"), good.alias("__good"))
    free = F.when(F.size("__good") > 0, apart(F.col("__good"), F.col("__ours"))).otherwise(F.col("__good"))
    out = out.select(*keep, "__base", "__ours", free.alias("__free"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    counts = [F.size(F.col("__base")[k]).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select(*keep, *counts, F.sha2(joined(F.col("__ours")), 256).alias("base_sha256"), joined(F.concat("__ours", "__free")).alias("spans"))
