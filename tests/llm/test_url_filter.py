import math
import re
from collections import Counter

import pytest

from tagloom.llm import url_filter as uf

SCHEMA = "page_id long, url string, html string, score string, codes string"


def parts(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = found.groups() if found else ("", "")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path, rules=uf.RULES):
    fit = [(len(h + p), h + p, said) for said, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def classes(text):
    out = []
    for c in text:
        c = c.lower() if "A" <= c <= "Z" else c
        out.append(ord(c) - 96 if "a" <= c <= "z" else 27 if "0" <= c <= "9" else {".": 28, "/": 29, "-": 30}.get(c, 31))
    return out


def plain_weights(texts, order):
    """Weights of all grams, from one count per context of every length."""
    counts = {said: Counter() for said in ("allow", "block")}
    for said, text in texts:
        c = [0] * order + classes(text)
        for i in range(order, len(c)):
            counts[said][tuple(c[i - order:i + 1])] += 1

    def sums(said, k, full):
        n, every = Counter(), Counter()
        for gram, times in counts[said].items():
            n[gram[order - k:]] += times
            every[gram[order - k:-1]] += times
        return n[full[order - k:]], every[full[order - k:-1]]

    tables = {}
    for said in counts:
        per = []
        for k in range(order + 1):
            n, every = Counter(), Counter()
            for gram, times in counts[said].items():
                n[gram[order - k:]] += times
                every[gram[order - k:-1]] += times
            per.append((n, every))
        tables[said] = per
    out = []
    for g in range(32 ** (order + 1)):
        full = tuple(g // 32 ** (order - i) % 32 for i in range(order + 1))
        rate = {}
        for said in counts:
            p = 1 / 32
            for k, (n, every) in enumerate(tables[said]):
                if k == 0 or every[full[order - k:-1]] >= uf.LEAST:
                    p = (n[full[order - k:]] + uf.SMOOTH * p) / (every[full[order - k:-1]] + uf.SMOOTH)
            rate[said] = p
        out.append(math.floor(1000.0 * math.log(rate["allow"] / rate["block"])))
    return out


def plain_mean(text, weights, order):
    c = [0] * order + classes(text)
    if not text:
        return None
    total = sum(weights[sum(c[i - k] * 32 ** k for k in range(order + 1))] for i in range(order, len(c)))
    return math.floor(total / len(text))


URLS = ([f"https://www.Spam{i % 7}.net/x/{i}" for i in range(40)] + [f"http://good{i % 5}.org/fr/page-{i}?q=://z#t" for i in range(40)]
        + [f"http://spam{i}.com/x/{i}" for i in range(10)] + [f"http://good{i}.io/fr/page-{i}" for i in range(10)])
ODD = [None, "", "no scheme", "://", "http://net", "http://net/", "http://example.net/en/", "http://notexample.net/en/a",
       "http://a.example.com/de/x", "http://a.example.com/de", "http://é漢😀.org/fr/é", "x://A.ORG/fr/\nline", "a://b://net/", "http://h?://net/x",
       "http://q.org/fr/" + "long" * 5000]


@pytest.fixture(scope="module")
def pages(spark):
    urls = URLS + ODD + ODD[:3]
    return spark.createDataFrame([(i if i != 3 else None, u, "h", "s", "c") for i, u in enumerate(urls)], SCHEMA)


def test_hosts_paths_and_rules(spark, pages):
    for r in uf.parted(pages.selectExpr("url", "url AS u2"), "u2").collect():
        assert (r["host"], r["path"]) == parts(r["key"])
        assert (r["rule"], r["verdict"]) == rule(*parts(r["key"]))


@pytest.mark.parametrize("order", [1, 2])
def test_verdicts_are_those_of_a_plain_version(pages, order):
    by = uf.fit(pages, order=order)
    import hashlib

    known = [(rule(*parts(r["url"]))[1], "".join(parts(r["url"]))) for r in pages.collect() if rule(*parts(r["url"]))[1]]
    held = [int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % uf.HELD == 0 for _, t in known]
    weights = plain_weights([k for k, h in zip(known, held) if not h], order)
    assert by.weights == weights
    scored = [(said, plain_mean(t, weights, order)) for (said, t), h in zip(known, held) if h]

    def errors(at):
        allowed, blocked = ([m for s, m in scored if s == said] for said in ("allow", "block"))
        return sum(m < at for m in allowed) * len(blocked) + sum(m >= at for m in blocked) * len(allowed)

    assert errors(by.threshold) == min(map(errors, [uf.NEVER, *{m for _, m in scored}]))
    judged = uf.judge(pages, by).collect()
    assert len(judged) == pages.count()
    urls = {(r["page_id"], "".join(parts(r["url"]))): r["url"] for r in pages.collect()}
    for r in judged:
        said = rule(r["host"], r["path"])
        score = plain_mean(r["host"] + r["path"], weights, order)
        assert (r["rule"], r["score"]) == (said[0], score) and (r["key"], r["host"] + r["path"]) in urls
        assert r["verdict"] == (said[1] or ("block" if score is not None and score < by.threshold else "allow"))


def test_model_tells_unruled_urls_apart(pages):
    verdicts = {r["host"]: r["verdict"] for r in uf.filtered(pages).collect() if r["rule"] is None}
    assert all(verdicts[f"good{i}.io"] == "allow" for i in range(10))
    assert all(verdicts[f"spam{i}.com"] == "block" for i in range(10))


def test_without_one_kind_or_rows_nothing_is_rejected_by_the_score(spark, pages):
    only = pages.filter("url LIKE '%Spam%'")
    by = uf.fit(only)
    assert by.threshold == uf.NEVER and not any(by.weights)
    unruled = spark.createDataFrame([(1, "http://a.io/b", "", "", "")], SCHEMA)
    assert [r["verdict"] for r in uf.judge(unruled, by).collect()] == ["allow"]
    assert uf.filtered(pages.filter("1 = 0")).collect() == []
