"""Personal data and licenses against plain versions."""

import random
import re

import pytest

from tagloom.llm import licenses, pii

BITS = ["a@b.c", "1.2.3.4", "@", "..", "+1", "(23)", " 555", "-1234", "4111 1111 1111 1111", "x", "é", "%", "300.1.1.1", ".5", "+",
        "0000255", "12345678901234567890", "\n", "a.b-c_d", "4111-1111-1111-1111"]


def plain(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if max(map(int, m.group().split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        doubled = [n if i % 2 == 0 else sum(divmod(2 * n, 10)) for i, n in enumerate(reversed(d))]
        if 12 <= len(d) <= 19 and sum(doubled) % 10 == 0:
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_rules_like_the_patterns():
    rnd = random.Random(5)
    for _ in range(20_000):
        text = "".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 9)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_are_linear():
    assert pii.base_spans("a" * 300_000 + " " + "1" * 300_000 + "." * 5) == []
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []


def private(n):
    rnd = random.Random(n)
    out = []
    for i in range(n):
        kind = i % 5
        value = [f"joe.{rnd.randint(1, 99)}@mail{i % 7}.example.com", ".".join(str(rnd.randint(0, 255)) for _ in range(4)),
                 "4111 1111 1111 1111", f"+1 ({rnd.randint(100, 999)}) 555-{rnd.randint(1000, 9999)}", str(rnd.randint(1, 999_999))][kind]
        out.append((i, f"some words before {value} and words after"))
    return out


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(spark.createDataFrame(private(200), "doc_id long, text string"))


def test_field_adds_what_the_rules_miss(field):
    def found(text):
        return [(k, text[a:b]) for a, b, k in field.spans(text, pii.base_spans(text))]

    assert found("call (017) 555-7713 now") == [("phone", "(017) 555-7713")]
    assert found("two cards 4111111111111111 4111111111111111 here") == [("card", "4111111111111111")] * 2
    assert found("mail joe@example.com today") == [("email", "joe@example.com")]
    assert found("in 1999 we had 123456 of 2000, or 12.5 %") == []
    assert found("") == []


def test_find(field, odd, empty):
    got = pii.find(odd, field).collect()
    assert len(got) == 10 and not any(r.spans for r in got)
    assert pii.find(empty, field).count() == 0
    assert pii.fit(empty).spans("x +1 (017) 555-7713 y", []) is not None


def test_longest_segments_are_bounded(field):
    text = "7 " * 5000
    assert all(b - a <= 64 for a, b, _ in field.best(text))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def places(text):
    w = words(text)
    return [(i, label) for label, phrase in licenses.PHRASES for i in range(len(w))
            if w[i:i + len(phrase.split())] == phrase.split()]


def test_licenses(spark, odd, empty):
    passage = dict(reversed(licenses.PASSAGES))
    edited = passage["bsd"].replace("source and binary", "source, object and binary").replace(" that the", " that all the")
    texts = ["MIT-License, mit license; the MIT\nLicense!", "GNU General Public License", "mit the license", "é apache license mit license",
             f"x y z {edited}. end", "of the of the to the and the " * 50, passage["isc"].upper(), "redistribution and use in the source", None, "mit"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.key: r for r in licenses.scan(docs).collect()}
    for i, text in enumerate(texts):
        p, r = places(text), got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(words(text)), len(p), min((a for a, _ in p), default=None), max((a for a, _ in p), default=None),
            ",".join(sorted({b for _, b in p})))
    assert [got[i].labels for i in range(10)] == ["mit", "gpl", "", "apache,mit", "bsd", "", "isc", "", "", ""]
    assert got[4].score > 0.6 and got[6].score == 1.0 and got[5].score == 0.0
    scanned = licenses.scan(odd).collect()
    assert len(scanned) == 10 and {r.n_words for r in scanned if r.key in (3, 4, 5)} == {0}
    assert licenses.scan(empty).count() == 0
