"""Personal data by candidate gradient boosting, in SQL functions only.

Base spans follow the fixed patterns of the contract. High-recall generators
then propose further, overlapping spans: numbers written with other marks (every
window of neighbouring groups of digits),
spelled-out email addresses, addresses with spaced or bracketed dots. Each
proposal is scored by boosted trees on its format and its context; those above
the calibrated threshold of their kind that overlap no base span are added.

The trees (depth 2) are fitted on the driver, in a fraction of a second, on the
labelled examples below (a formula makes them; all words and digits are
invented), calibrated by a logistic curve on a held-out part, and written out
as CASE expressions.

Nulls and empty texts hold nothing. Of overlapping proposals of one kind the
trees choose the one with the highest odds; spans of different kinds may
overlap. Repeated rows are scanned by themselves. An empty table
gives no row. Further columns are passed by.
"""

from __future__ import annotations

import math
import random
import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_text, table

KINDS = ("email", "ip", "card", "phone")
# The patterns of the contract. Loops without a way back are possessive, which changes no match.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: The generators; each proposes spans of the kinds named. Of a whole row of numbers, or of a chain of octets, all
#: windows of neighbouring groups are proposed that have the digits, or the number of groups, of the kind.
LOOSE = {
    "number": r"[+(]?[0-9](?:[ ().\-]{0,2}[0-9])++",
    "address": r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]{1,64}(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{2,32}){1,4}",
    "quad": r"[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?[0-9]{1,3}){3,}+",
}
GROUP = {"number": "[+(]?[0-9]+", "quad": "[0-9]{1,3}"}
#: Fewest and most digits, fewest and most groups. Cards have 12 to 19 digits; phone numbers 7 without an area, 15 with 00 before them 17.
WINDOW = {"card": (12, 19, 1, 25), "phone": (7, 17, 1, 25), "ip": (4, 12, 4, 4)}
PROPOSES = {"email": "address", "ip": "quad", "card": "number", "phone": "number"}
CUES = {
    "email": r"(?:mail|contact|write|reach|address|from|to)\W*$",
    "ip": r"(?:ip|host|server|address|client|ping|addr)\W*$",
    "card": r"(?:card|visa|master|amex|credit|debit|pan)\W*(?:no|number|nr)?\W*$",
    "phone": r"(?:tel|phone|call|mobile|fax|cell|dial|ring)\W*(?:no|number|nr)?\W*$",
}
FEATURES = ("digits", "length", "gaps", "dots", "brackets", "plus", "luhn", "cue", "glued", "at", "wide", "high")
REACH = 24


def _octets(m: str) -> bool:
    return all(int(x) < 256 for x in re.findall("[0-9]{1,3}", m))


def _luhn(d: str) -> bool:
    return sum(n if i % 2 == 0 else n * 2 - 9 * (n > 4) for i, n in enumerate(int(c) for c in reversed(d))) % 10 == 0


def features(kind: str, before: str, m: str, after: str) -> list[int]:
    """The features of one proposal; `feature_columns` is the same in SQL."""
    d = re.sub("[^0-9]", "", m)
    return [
        len(d), len(m), len(re.findall("[ -]", m)), m.count("."), len(re.findall(r"[()\[\]]", m)), int(m.startswith("+")), int(len(d) > 0 and _luhn(d)),
        int(bool(re.search(CUES[kind], before.lower(), re.A))), int(bool(re.search("[A-Za-z0-9.]$", before))) + int(bool(re.match("[A-Za-z0-9]", after))),
        int("@" in m), len(re.findall("[ -]{2}", m)), int(bool(re.search("(?<![0-9])(?:2[6-9][0-9]|25[6-9]|[3-9][0-9]{2})(?![0-9])", m))),
    ]


def feature_columns(kind: str, before: Column, m: Column, after: Column) -> list[Column]:
    d = F.regexp_replace(m, "[^0-9]", "")
    count = lambda p: F.length(m) - F.length(F.regexp_replace(m, p, ""))
    flag = lambda c: c.cast("int")
    return [
        F.length(d), F.length(m), count("[ -]"), count(r"\."), count(r"[()\[\]]"), flag(m.startswith("+")), flag((F.length(d) > 0) & luhn(d)),
        flag(F.lower(before).rlike(CUES[kind])), flag(before.rlike("[A-Za-z0-9.]$")) + flag(after.rlike("^[A-Za-z0-9]")),
        flag(m.contains("@")), (count("[ -]{2}") / 2).cast("int"), flag(m.rlike("(?<![0-9])(?:2[6-9][0-9]|25[6-9]|[3-9][0-9]{2})(?![0-9])")),
    ]


def edges(m: str) -> list[int]:
    """Digits of the first and the last group, further features of the trees that choose; `edge_columns` is the same in SQL."""
    return [len(re.match("[^0-9]*([0-9]*)", m)[1]), len(re.search("[0-9]*$", m)[0])]


def edge_columns(m: Column) -> list[Column]:
    return [F.length(F.regexp_extract(m, "^[^0-9]*([0-9]*)", 1)), F.length(F.regexp_extract(m, "[0-9]*$", 0))]


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        x = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + F.coalesce(value(i), F.lit(0))) % 10 == 0


def examples(kind: str, n: int = 400, seed: str = "examples") -> list[tuple[str, str, str, int]]:
    """Labelled examples (before, span, after, 1 for personal data), made by a seeded formula."""
    rng = random.Random(f"{seed}-{kind}")
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("aeinorstl") for _ in range(rng.randint(3, 8)))
    cue = {"email": ["mail: ", "contact ", "write to "], "ip": ["host ", "server: ", "ip "], "card": ["card no. ", "visa ", "credit card: "], "phone": ["call ", "tel. ", "phone: "]}[kind]
    idle = ["order ", "version ", "item ", "on ", "about ", "page ", "isbn ", "", "with the ", "total "]

    def card_number(k: int) -> str:
        d = num(k - 1)
        return next(d + c for c in "0123456789" if _luhn(d + c))

    def one(yes: bool) -> str:
        if kind == "email":
            at, dot = rng.choice(["(at)", " (at) ", " [at] ", "[at]", " @ ", "@ "]), rng.choice([".", " [dot] ", "(dot)", " (dot) "])
            name = rng.choice([f"{word()}.{word()}", f"{word()}_{num(2)}", word()])
            ended = rng.choice(["com", "org", "net", "de", "fr", "io", "info"])
            return f"{name}{at}{word()}{dot}{ended}" if yes else f"{word()} @ {word()}{rng.choice(['. ', ' . '])}{word()}{rng.choice(['', ' . ' + word()])}"
        if kind == "ip":
            dot = rng.choice(["[.]", "(.)", " . ", "[dot]"])
            return dot.join(str(rng.randint(0, 255)) for _ in range(4)) if yes else dot.join(str(rng.randint(100, 999)) for _ in range(4)) if rng.random() < 0.5 else " . ".join(num(1) for _ in range(4))
        if kind == "card":
            d = card_number(16) if yes else num(16)
            sep = rng.choice([".", "  ", " - ", ". "])
            return sep.join(d[i : i + 4] for i in range(0, 16, 4)) if yes or rng.random() < 0.6 else rng.choice([num(8), f"{num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{num(1)}.{num(12)}"])
        if yes:
            return rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"00{num(2)} {num(2)} {num(6)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(3)} {num(7)}"])
        return rng.choice([f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.20{num(2)}", num(10), num(7), f"{num(1)}.{num(9)}", f"{num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{num(1)} {num(3)} {num(3)}", f"{num(4)} {num(4)} {num(4)} {num(4)}"])

    out = []
    for i in range(n):
        yes = i % 2 == 0
        lead = rng.choice(cue) if yes or rng.random() < 0.1 else rng.choice(idle)
        out.append((f"{word()} {lead}"[-REACH:], one(yes), rng.choice([" ", ".", ",", ""]), int(yes)))
    return out


def row_examples(kind: str, n: int = 60) -> list[tuple[str, str, str, int]]:
    """Labelled windows of rows of card and phone numbers, by a seeded formula: the numbers of `kind`, and for each three windows that cut or join numbers."""
    rng = random.Random(f"rows-{kind}")
    of = {k: [e for e in examples(k) if e[3]] for k in ("card", "phone")}

    def number(k: str) -> str:
        """A card number of any length there is, or a phone number of the examples."""
        if k == "phone":
            return rng.choice(of[k])[1]
        size = rng.choice([12, 13, 14, 15, 16, 16, 16, 17, 18, 19])
        d = "".join(rng.choice("0123456789") for _ in range(size - 1))
        d += next(c for c in "0123456789" if _luhn(d + c))
        cuts = [0, 4, 10, size] if size in (14, 15) and rng.random() < 0.7 else [*range(0, size, 4), size]
        return rng.choice([".", "  ", ". ", ".", " ."]).join(d[i:j] for i, j in zip(cuts, cuts[1:], strict=False))

    out = []
    for _ in range(n):
        lead, row = rng.choice(of[kind])[0], number(kind)
        true = [(0, len(row))]
        for _ in range(rng.randint(1, 3)):
            k = rng.choice(["card", "phone"])
            row += rng.choice([" ", " ", "  ", " - "[1:], ". "])
            m = number(k)
            if k == kind:
                true.append((len(row), len(row) + len(m)))
            row += m
        groups = [m.span() for m in re.finditer(GROUP["number"], row)]
        low, high, *_ = WINDOW[kind]
        spans = [(a, b) for i, (a, _) in enumerate(groups) for _, b in groups[i:] if low <= len(re.sub("[^0-9]", "", row[a:b])) <= high]
        cut = [x for x in spans if x not in true]
        for a, b in true + rng.sample(cut, min(len(cut), 3 * len(true))):
            out.append((lead + row[a - 1 : a] if a else lead, row[a:b], row[b : b + 1], int((a, b) in true)))
    return out


Tree = tuple[int, float, tuple[int, float, float, float], tuple[int, float, float, float]]


def _stump(rows: list[list[int]], slip: list[float], hess: list[float], at: list[int]) -> tuple[int, float, float, float, float]:
    """(feature, cut, left, right, gain) of the best split `feature <= cut` of the rows `at`."""
    g, h = sum(slip[i] for i in at), sum(hess[i] for i in at)
    best = (0, -1.0, -g / (h + 1), -g / (h + 1), 0.0)
    for f in range(len(rows[0])):
        sums: dict[int, list[float]] = {}
        for i in at:
            s = sums.setdefault(rows[i][f], [0.0, 0.0])
            s[0] += slip[i]
            s[1] += hess[i]
        gl = hl = 0.0
        values = sorted(sums)
        for v, w in zip(values, values[1:], strict=False):
            gl, hl = gl + sums[v][0], hl + sums[v][1]
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best[4] + 1e-9:
                best = (f, (v + w) / 2, -gl / (hl + 1), -(g - gl) / (h - hl + 1), gain)
    return best


def _leaf(tree: Tree, x: list[int]) -> float:
    f, cut, left, right = tree
    f2, cut2, a, b = left if x[f] <= cut else right
    return a if x[f2] <= cut2 else b


@cache
def boosted(kind: str, rounds: int = 24, rate: float = 0.3) -> tuple[tuple[Tree, ...], float, float]:
    """Trees, and scale and shift of the calibrated log odds."""
    made = examples(kind)
    return _boosted([features(kind, *e[:3]) for e in made], [e[3] for e in made], rounds, rate)


@cache
def choosing(kind: str, rounds: int = 24, rate: float = 0.3) -> tuple[tuple[Tree, ...], float, float]:
    """The same for the choice among overlapping windows of a row of numbers: fitted on windows as well, with their edges as features."""
    made = examples(kind) + (row_examples(kind) if PROPOSES[kind] == "number" else [])
    return _boosted([features(kind, *e[:3]) + edges(e[1]) for e in made], [e[3] for e in made], rounds, rate)


def _boosted(rows: list[list[int]], y: list[int], rounds: int, rate: float) -> tuple[tuple[Tree, ...], float, float]:
    fit, held = [i for i in range(len(y)) if i % 10 < 7], [i for i in range(len(y)) if i % 10 >= 7]
    z, trees = [0.0] * len(y), []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-v)) for v in z]
        slip, hess = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        f, cut, *_ = _stump(rows, slip, hess, fit)
        sides = [[i for i in fit if rows[i][f] <= cut], [i for i in fit if rows[i][f] > cut]]
        leaves = []
        for at in sides:
            s = _stump(rows, slip, hess, at or fit)
            leaves.append((s[0], s[1], rate * s[2], rate * s[3]))
        trees.append((f, cut, leaves[0], leaves[1]))
        z = [v + _leaf(trees[-1], x) for v, x in zip(z, rows, strict=True)]
    a, b = 1.0, 0.0
    for _ in range(200):
        slips = [(1 / (1 + math.exp(-(a * z[i] + b))) - (0.98 if y[i] else 0.02), z[i]) for i in held]
        a -= 0.02 * sum(s * v for s, v in slips) / len(held)
        b -= 0.02 * sum(s for s, _ in slips) / len(held)
    return tuple(trees), a, b


#: The share of redacted proposals that must be personal data, among examples that neither the trees nor their calibration saw.
PRECISION = 0.98
#: No proposal below this calibrated probability is redacted, however well the examples part.
LEAST = 0.9


@cache
def threshold(kind: str) -> float:
    """A calibrated probability from which proposals are personal data with PRECISION, on examples of another seed: midway to what must stay below."""
    told = sorted(((score(kind, *e[:3]), e[3]) for e in examples(kind, 600, "thresholds")), reverse=True)
    right, best = 0, 0.99
    for n, (p, y) in enumerate(told, 1):
        right += y
        if right >= PRECISION * n and (n == len(told) or told[n][0] < p):
            best = (p + (told[n][0] if n < len(told) else 0.0)) / 2
    return max(best, LEAST)


def score(kind: str, before: str, m: str, after: str) -> float:
    trees, a, b = boosted(kind)
    x = features(kind, before, m, after)
    return 1 / (1 + math.exp(-(a * sum(_leaf(t, x) for t in trees) + b)))


def _odds(fitted: tuple[tuple[Tree, ...], float, float], x: list[Column]) -> Column:
    """The calibrated log odds of the features `x`, as a SQL expression."""
    trees, a, b = fitted

    def summed(xs: Column) -> Column:
        out = F.lit(b)
        for f, cut, left, right in trees:
            side = [F.when(xs[s[0]] <= s[1], a * s[2]).otherwise(a * s[3]) for s in (left, right)]
            out = out + F.when(xs[f] <= cut, side[0]).otherwise(side[1])
        return out

    return F.get(F.transform(F.array(F.array(*x)), summed), F.lit(0))


def accepted(kind: str, before: Column, m: Column, after: Column) -> Column:
    """Whether a proposal is personal data of `kind`, as a SQL expression."""
    return _odds(boosted(kind), feature_columns(kind, before, m, after)) >= math.log(threshold(kind) / (1 - threshold(kind)))


SPANS = "array<struct<s:int,e:int,m:string>>"


def located(text: Column, pattern: str) -> Column:
    """The matches of `pattern`: start, end (code points) and text, from the gaps between them."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    both = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    both = F.filter(both, lambda x: x["hit"].isNotNull())
    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.length(x["hit"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("m")))).alias("out"))

    return F.aggregate(both, first, step, lambda acc: acc["out"])


def _valid(kind: str):
    digits = lambda x: F.regexp_replace(x["m"], "[^0-9]", "")
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["m"].rlike(rf"^{octet}(?:\.{octet}){{3}}$"),
        "card": lambda x: F.length(digits(x)).between(12, 19) & luhn(digits(x)),
        "phone": lambda x: F.length(digits(x)).between(9, 15),
    }[kind]


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _with_kind(c: Column, k: int) -> Column:
    return F.transform(c, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind number, end) and the number of base spans of each kind."""
    text = F.col("text")
    none = F.array().cast(SPANS)
    # a cheap test of the bytes keeps the patterns off most texts
    signs = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9](?:[ -]?[0-9]){11}"), "phone": text.contains("+")}
    df = docs.select("doc_id", clean_text("text").alias("text"))
    df = df.withColumns({f"b_{k}": F.when(signs[k], F.filter(located(text, BASE[k]), _valid(k))).otherwise(none) for k in KINDS})
    df = df.withColumn("base", F.array_sort(F.flatten(F.array(*[_with_kind(F.col(f"b_{k}"), i) for i, k in enumerate(KINDS)]))))
    hints = {"number": text.rlike("[0-9](?:[ ().-]{0,2}[0-9]){6}"), "address": text.contains("@") | text.contains("(at)") | text.contains("[at]"), "quad": text.rlike(r"[0-9] ?[.\[(]")}
    df = df.withColumns({f"l_{g}": F.when(hints[g], located(text, LOOSE[g])).otherwise(none) for g in LOOSE})

    def grouped(g: str) -> Column:
        return F.transform(f"l_{g}", lambda x: F.struct(x["s"].alias("s"), x["m"].alias("m"), located(x["m"], GROUP[g]).alias("g")))

    df = df.withColumns({f"g_{g}": grouped(g) for g in GROUP})

    def lead(s: Column) -> Column:
        return F.substring(text, F.greatest(s - REACH + 1, F.lit(1)), F.least(s, F.lit(REACH)))

    def windows(kind: str) -> Column:
        """Every window of an area with the digits and groups of `kind`; what stands before is told of the area, and the mark between."""
        low, high, few, many = WINDOW[kind]
        size = lambda w: F.length(F.regexp_replace(w["m"], "[^0-9]", ""))

        def of(x: Column) -> Column:
            g, last = x["g"], F.size(x["g"]) - 1

            def one(i: Column, j: Column) -> Column:
                s, e = g[i]["s"], g[j]["e"]
                before = F.concat(lead(x["s"]), F.when(s > 0, F.substring(x["m"], s, F.lit(1))).otherwise(""))
                whole = (i == 0) & (j == last)
                return F.struct((x["s"] + s).alias("s"), (x["s"] + e).alias("e"), F.substring(x["m"], s + 1, e - s).alias("m"), before.alias("before"), whole.alias("whole"))

            # sequence() would count down where an area has too few groups
            starts = F.filter(F.sequence(F.lit(0), last), lambda i: i + few - 1 <= last)
            return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(i + few - 1, F.least(i + many - 1, last)), lambda j: one(i, j))))

        wide = (7, 25) if PROPOSES[kind] == "number" else (low, high)  # a number that stands alone is proposed in any case
        areas = F.filter(f"g_{PROPOSES[kind]}", lambda x: size(x) >= min(low, wide[0]))
        return F.filter(F.flatten(F.transform(areas, of)), lambda w: size(w).between(low, high) | (w["whole"] & size(w).between(*wide)))

    def single(kind: str) -> Column:
        return F.transform(f"l_{PROPOSES[kind]}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), lead(x["s"]).alias("before"), F.lit(True).alias("whole")))

    df = df.withColumns({f"w_{k}": windows(k) if k in WINDOW else single(k) for k in KINDS})

    def free(x: Column) -> Column:
        return ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))

    def ranked(kind: str) -> Column:
        """The accepted proposals of `kind`, best first: by odds, then digits, then length, then place. A part of a row needs even odds as well."""

        def good(x: Column) -> Column:
            return free(x) & accepted(kind, x["before"], x["m"], F.substring(text, x["e"] + 1, F.lit(1)))

        def rank(x: Column) -> Column:
            z = _odds(choosing(kind), feature_columns(kind, x["before"], x["m"], F.substring(text, x["e"] + 1, F.lit(1))) + edge_columns(x["m"]))
            digits = F.length(F.regexp_replace(x["m"], "[^0-9]", ""))
            return F.struct(z.alias("z"), digits.alias("d"), (x["e"] - x["s"]).alias("n"), (-x["s"]).alias("p"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["whole"].alias("whole"))

        return F.sort_array(F.filter(F.transform(F.filter(f"w_{kind}", good), rank), lambda x: x["whole"] | (x["z"] >= 0)), asc=False)

    df = df.withColumns({f"r_{k}": F.when(F.size(f"w_{k}") > 0, ranked(k)) for k in KINDS})

    def chosen(kind: str) -> Column:
        """The best proposal, then the best of those that do not overlap it, and so on."""
        def take(acc: Column, x: Column) -> Column:
            meets = F.exists(acc, lambda k: (k["s"] < x["e"]) & (x["s"] < k["e"]))
            return F.when(meets, acc).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))))

        return F.coalesce(F.aggregate(f"r_{kind}", none, take), none)

    more = [_with_kind(chosen(k), i) for i, k in enumerate(KINDS)]
    df = df.withColumn("spans", F.array_sort(F.array_union("base", F.flatten(F.array(*more)))))
    return df.select("doc_id", "base", "spans", *[F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS])


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))
