"""URL filter: rules by host and path, and a logistic regression on hashed character n-grams.

The model is fitted on the labelled table below (told hosts with neutral paths,
hosts that tell nothing with told paths), on the driver in a fraction of a second; its
weights become one array literal of BUCKETS doubles, and every url is scored
by built-in SQL functions only.

Nulls: a null url, or one without `://`, has an empty host and path; no rule
fits it and the model allows it. Ties cannot occur between rules: the longest
rule that fits a url is unique. Repeated rows are judged alike; an empty table
gives no row; further columns are passed by, but for those named host, path,
rule, score or verdict, which the result replaces.
"""

from __future__ import annotations

import math
import random
from functools import cache
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: (verdict, rule): a rule is a host and a path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BUCKETS, GRAMS = 8192, (3, 4)

#: The labelled URL table: words that hosts of either class carry.
BLOCKED_HOSTS = (
    "spam-farm casino-win cheap-pills free-bets adult-x ads-track casino-royal online-casino win-cash free-spins best-bets bet-now "
    "sports-bets pills-shop cheap-meds viagra-store spam-links link-farm adult-cams xxx-video adult-video ads-server ad-tracker track-click "
    "click-ads popup-ads cheap-loans payday-loans free-money win-prize lucky-casino poker-win replica-shop cheap-watches malware-drop phish-login "
    "free-casino casino-bets spam-mail farm-links pills-online cheap-pharma adult-dating sexy-chat porn-hub torrent-free crack-keys warez-dl"
).split()
ALLOWED_HOSTS = (
    "news docs wiki blog library university archive museum weather science journal city health school research forum recipes travel "
    "garden music history maps parks theatre sports-club gazette herald tribune chronicle observer bulletin council ministry institute academy "
    "physics chemistry biology mathematics language grammar letters essays photos cinema radio station bakery kitchen market-hall bookshop"
).split()
#: Paths that say nothing of either class, and parts of paths that do.
PATHS = ("/", "/en/1", "/en/825.html", "/de/47?x=1", "/fr/930/", "/es/12#top", "/index.html", "/2020/05/story", "/en/300?page=2")
BLOCKED_PATHS = (
    "online-casino free-bets casino/win poker/bonus slots/jackpot viagra cheap-pills buy-meds-online porn xxx adult/cams sexy-girls payday-loan "
    "free-money win-prize replica-watches torrent crack-serial warez phishing/login malware/setup.exe ads/click popup/ad track/redirect spam/links"
).split()
ALLOWED_PATHS = (
    "about contact news/today articles/history docs/guide help/faq library/catalogue research/papers science/physics courses/biology recipes/bread travel/maps "
    "weather/forecast music/albums events/calendar museum/exhibits sports/results health/advice jobs/teacher blog/garden press/release images/photo.jpg"
).split()
PREFIXES = ("", "www.", "blog.", "m.")


def invented_words(n: int, seed: str = "hosts") -> list[str]:
    """Host words without a meaning, of random syllables: most hosts tell nothing, and are allowed."""
    rng = random.Random(seed)
    starts, vowels, ends = "b c d f g h k l m n p r s t v br cr st tr sh ch".split(), "a e i o u ea ou".split(), "n r s l t nd st ng ck m".split()
    return ["".join(rng.choice(starts) + rng.choice(vowels) + (rng.choice(ends) if rng.random() < 0.5 else "") for _ in range(rng.randint(2, 3))) for _ in range(n)]


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 for block): told hosts with neutral paths, and hosts that tell nothing with told paths."""
    out = []
    host = lambda i, p, w: f"{p}{w}.example.{('com', 'org', 'net')[i % 3]}"
    for y, words in ((1, BLOCKED_HOSTS), (0, ALLOWED_HOSTS)):
        for i, w in enumerate(words):
            for k, p in enumerate(PREFIXES):
                out.append((host(i + k, p, w), PATHS[(i * 3 + k) % len(PATHS)], y))
    plain = invented_words(3 * (len(BLOCKED_PATHS) + len(ALLOWED_PATHS)) + 120)
    for y, parts in ((1, BLOCKED_PATHS), (0, ALLOWED_PATHS)):
        for i, part in enumerate(parts):
            for k, lead in enumerate(("/", "/en/", "/2021/")):
                out.append((host(i + k, PREFIXES[(i + k) % len(PREFIXES)], plain.pop()), f"{lead}{part}{('', '/', '.html')[(i + k) % 3]}", y))
    out += [(host(i, PREFIXES[i % len(PREFIXES)], w), PATHS[i % len(PATHS)], 0) for i, w in enumerate(plain)]
    return out


def _features(host: str, path: str) -> dict[int, float]:
    out: dict[int, float] = {}
    for tag, s in (("h", f"^{host}$"), ("p", path)):
        for n in GRAMS:
            for i in range(len(s) - n + 1):
                k = crc32((tag + s[i : i + n]).encode()) % BUCKETS
                out[k] = out.get(k, 0.0) + 1.0
    return out


@cache
def fitted(rounds: int = 120, rate: float = 0.08, l2: float = 2e-3) -> tuple[float, tuple[float, ...]]:
    """Bias and weights by gradient descent on the labelled table (full batches, fixed order: always the same)."""
    rows = [(_features(h, p), y) for h, p, y in labelled_urls()]
    bias, w = 0.0, [0.0] * BUCKETS
    for _ in range(rounds):
        grad: dict[int, float] = {}
        slip = 0.0
        for x, y in rows:
            z = bias + sum(w[k] * v for k, v in x.items())
            e = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y
            slip += e
            for k, v in x.items():
                grad[k] = grad.get(k, 0.0) + e * v
        bias -= rate * slip / len(rows) * 4
        for k, g in grad.items():
            w[k] -= rate * (g / len(rows) * 40 + l2 * w[k])
    return bias, tuple(w)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path by the contract: after the first `://`, up to `/`, `?` or `#`; then up to `?` or `#`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rule in sorted(rules, key=lambda r: len(r[1])):
        at, prefix = rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def model_score(host: Column, path: Column) -> Column:
    """The log odds that a url is to be blocked."""
    bias, weights = fitted()
    lookup = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded into one literal

    def summed(tag: str, s: Column, n: int) -> Column:
        starts = F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - n + 1)).otherwise(F.array().cast("array<int>"))

        def add(acc: Column, i: Column) -> Column:
            bucket = F.pmod(F.crc32(F.encode(F.concat(F.lit(tag), F.substring(s, i, n)), "UTF-8")), F.lit(BUCKETS))
            return acc + F.element_at(lookup, (bucket + 1).cast("int"))

        return F.aggregate(starts, F.lit(0.0), add)

    marked = F.concat(F.lit("^"), host, F.lit("$"))
    return F.lit(bias) + sum((summed(tag, s, n) for tag, s in (("h", marked), ("p", path)) for n in GRAMS), F.lit(0.0))


#: Log odds above which a url is blocked: more than hosts without a meaning reach.
THRESHOLD = 1.0


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Adds host, path, rule, score (null host: none) and verdict to every row of `pages`."""
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    df = pages.select(F.struct(*own).alias("row"), *[c.alias(n) for n, c in zip(("host", "path"), split_url(F.col("url")), strict=True)])
    rule, told = rule_for(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "told": told})
    df = df.withColumn("score", F.when(F.col("told").isNull() & (F.col("host") != ""), model_score(F.col("host"), F.col("path"))))
    verdict = F.coalesce("told", F.when(F.col("score") > threshold, "block").otherwise("allow"))
    return df.select(*[F.col("row")[c].alias(c) for c in own], "host", "path", "rule", "score", verdict.alias("verdict"))


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
