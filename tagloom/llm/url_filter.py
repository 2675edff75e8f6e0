"""URL filter: rules for hosts and paths, and a character language model where no rule fits.

What the rules accept and reject teaches two Markov models of the characters of host and path. Their order varies: a
character's probability comes from its longest context that was seen often enough, smoothed towards the
shorter ones. The difference of both log-likelihoods, divided by the number of characters, is the score of a URL;
the score that parts accepted from rejected URLs best on a quarter of the ruled URLs, which the models do not learn
from, is the threshold.

Everything is DataFrame operations. With 32 classes of characters the difference is a table of
32^(order + 1) whole numbers, whatever the number of URLs, and a URL is scored where it lies by one walk along its characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.texts import LOWER, UPPER, whole
from tagloom.session import stable

#: (verdict, host, path): the host and its subdomains, paths with that beginning
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

CLASSES = 32  # of characters: none, 26 letters, digit, dot, slash, hyphen, any other
ORDER = 2  # characters of the longest context
LEAST = 4  # times a context must have been seen by a model that uses it
SMOOTH = 5  # weight of the shorter context's probability, in characters
HELD = 4  # one URL of so many is left to the calibration
NEVER = -(1 << 40)  # a threshold that rejects nothing


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(whole(url), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(whole(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits columns ``host`` and ``path``; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, at, below in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == at) | F.col("host").endswith("." + at)) & F.col("path").startswith(below)
        rule, verdict = F.when(fits, at + below).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def codes(text: Column) -> Column:
    """The classes of a text's characters: letters 1 to 26, digit 27, dot 28, slash 29, hyphen 30, any other 31."""
    plain = F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9./-]", "~")
    marked = F.translate(plain, "0123456789./-~", "{{{{{{{{{{|}~\x7f")  # the characters after z
    return F.transform(F.filter(F.split(marked, ""), lambda c: c != ""), lambda c: F.ascii(c) - 96)


def grams(characters: Column, order: int = ORDER) -> Column:
    """Per character its class and those of ``order`` characters before it, as one number; class 0 stands before the text."""
    def at(i: Column) -> Column:
        back = [F.coalesce(F.get(characters, i - k), F.lit(0)) * CLASSES ** k for k in range(order + 1)]
        return sum(back[1:], back[0]).cast("int")

    return F.transform(characters, lambda _, i: at(i))


def model(counts: DataFrame, order: int = ORDER, least: int = LEAST, smooth: int = SMOOTH) -> DataFrame:
    """(gram, weight) of all 32^(order + 1) grams: 1000 times the logarithm of how much likelier the gram's last character
    is after the others in an accepted URL than in a rejected one, rounded down.

    ``counts`` has one row per gram that occurs, with its times in both kinds, ``accepted`` and ``rejected``.
    """
    spark, sides = counts.sparkSession, ("accepted", "rejected")
    cells = spark.range(CLASSES ** (order + 1)).select(F.col("id").cast("int").alias("gram"))
    now = cells.join(counts, "gram", "left").select("gram", *[F.coalesce(s, F.lit(0)).cast("long").alias(s) for s in sides])
    rates = {s: F.lit(1.0 / CLASSES) for s in sides}
    out = now
    for k in range(order + 1):  # from no context to the longest; a shorter gram is the end of the long ones
        size = CLASSES ** (k + 1)
        suffix = (F.col("gram") % size).alias("suffix")
        per = now.groupBy(suffix).agg(*[F.sum(s).alias(f"n_{s}") for s in sides])
        per_context = now.groupBy(F.floor((F.col("gram") % size) / CLASSES).alias("context")).agg(
            *[F.sum(s).alias(f"all_{s}") for s in sides])
        out = out.withColumn("suffix", F.col("gram") % size).join(per, "suffix").withColumn(
            "context", F.floor(F.col("suffix") / CLASSES)).join(per_context, "context")
        for s in sides:
            finer = (F.col(f"n_{s}") + smooth * rates[s]) / (F.col(f"all_{s}") + smooth)
            out = out.withColumn(f"rate_{s}", finer if k == 0 else F.when(F.col(f"all_{s}") >= least, finer).otherwise(rates[s]))
            rates[s] = F.col(f"rate_{s}")
        out = out.select("gram", *sides, *[f"rate_{s}" for s in sides])
    return out.select("gram", F.floor(1000.0 * F.log(F.col("rate_accepted") / F.col("rate_rejected"))).alias("weight"))


@dataclass
class Filter:
    weights: list[int]  # by gram
    threshold: int  # thousandths per character; URLs below it are rejected
    order: int


def mean(characters: Column, weights: list[int], order: int = ORDER) -> Column:
    """Thousandths per character, rounded down; null for a text without characters."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # folded into a constant by the optimizer

    def walk(held: Column, code: Column) -> Column:
        gram = ((held["gram"] * CLASSES + code) % len(weights)).cast("int")
        return F.struct(gram.alias("gram"), (held["sum"] + F.get(table, gram)).alias("sum"))

    start = F.struct(F.lit(0).alias("gram"), F.lit(0).cast("long").alias("sum"))
    total = F.aggregate(characters, start, walk, lambda held: held["sum"])
    return F.when(F.size(characters) > 0, F.floor(total / F.size(characters)))


def calibrated(scores: DataFrame) -> int:
    """The threshold with the fewest errors, each kind of URL weighing the same, in the middle between two means that
    occur; of several the lowest.

    ``scores`` has ``mean`` and ``verdict``. It is counted per mean, of which there are as many as thousandths between the
    ends of the table; without one of the kinds the score rejects nothing.
    """
    accepted = F.count(F.when(F.col("verdict") == "allow", 1)).alias("a")
    rejected = F.count(F.when(F.col("verdict") == "block", 1)).alias("r")
    rows = sorted((r["mean"], r["a"], r["r"]) for r in scores.groupBy("mean").agg(accepted, rejected).collect())
    all_a, all_r = sum(a for _, a, _ in rows), sum(r for _, _, r in rows)
    best, below_a, below_r, before = (all_a * all_r, NEVER), 0, 0, None
    for at, a, r in rows:
        errors = below_a * all_r + (all_r - below_r) * all_a
        if errors < best[0]:
            best = (errors, at if before is None else (before + at + 1) // 2)
        below_a, below_r, before = below_a + a, below_r + r, at
    return best[1]


def parted(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """key, host, path, rule, and the rule's verdict as ``said``."""
    rule, said = ruled(rules)
    return pages.select(F.col(key).alias("key"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path")).select(
        "key", "host", "path", rule.alias("rule"), said.alias("verdict"))


def fit(pages: DataFrame, url: str = "url", rules=RULES, order: int = ORDER) -> Filter:
    """The models of the URLs that the rules settle, repeats included, and the threshold."""
    text = F.concat("host", "path")
    known = parted(pages, url, url, rules).filter(F.col("verdict").isNotNull()).select(
        "verdict", codes(text).alias("codes"), F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int").alias("place"))
    counted = known.filter(F.col("place") % HELD != 0).select("verdict", F.explode(grams(F.col("codes"), order)).alias("gram"))
    counts = counted.groupBy("gram").agg(
        F.count(F.when(F.col("verdict") == "allow", 1)).alias("accepted"),
        F.count(F.when(F.col("verdict") == "block", 1)).alias("rejected"))
    counts = stable(counts, "grams")
    both = counts.agg(F.sum("accepted"), F.sum("rejected")).first()
    if not both[0] or not both[1]:
        return Filter([0] * CLASSES ** (order + 1), NEVER, order)
    weights = [r["weight"] for r in model(counts, order).orderBy("gram").collect()]  # 32^(order + 1) rows, whatever the input
    scores = known.filter(F.col("place") % HELD == 0).select("verdict", mean(F.col("codes"), weights, order).alias("mean"))
    return Filter(weights, calibrated(scores), order)


def judge(pages: DataFrame, by: Filter, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict (``allow`` or ``block``), score.

    The verdict is that of the longest rule that fits, else the model's. A null URL and one without ``://`` have neither host nor
    path, no rule fits them, and a URL without characters is allowed (score null). Repeated rows are judged each. An
    empty table gives none. Other columns are not read.
    """
    parts = parted(pages, key, url, rules).withColumn("score", mean(codes(F.concat("host", "path")), by.weights, by.order))
    modelled = F.when(F.col("score") < by.threshold, "block").otherwise("allow")
    return parts.withColumn("verdict", F.coalesce("verdict", modelled))


def filtered(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """Every URL judged by rules and by the model that they teach on the same table."""
    return judge(pages, fit(pages, url, rules, order), key, url, rules)
