"""Reply order against a plain version that walks each conversation."""

import random
import re

import pytest

from tagloom.llm import quotes
from tagloom.llm.texts import prepare

SCHEMA = "conv_id long, turn long, role string, text string, row int"


def fives(text):
    words = text.split(" ")
    return [tuple(words[i:i + 5]) for i in range(len(words) - 4)]


def origin_of(lines, said):
    """The last message that says the passage, or most of its runs of five words, or most of its lines."""
    def most(parts):
        votes = [said[p] for p in parts if p in said]
        return max(((votes.count(o), o) for o in votes), default=(0, None))

    whole, runs = " ".join(lines), fives(" ".join(lines))
    n, by_runs = most(runs)
    return said[whole] if whole in said else by_runs if n and n >= 0.8 * len(runs) else most(lines)[1]


def plain(messages):
    """(conv, turn) -> (reply_to, thread, position, n_quoted, n_linked, text) for unique turns."""
    out = {}
    for conv in {m[0] for m in messages}:
        own = sorted((m for m in messages if m[0] == conv), key=lambda m: m[1])
        said, head, previous, made = {}, None, None, []
        head_of, thread_of = {}, {}
        for _, turn, _, text, *_ in own:
            lines = []
            for raw in re.split(r"\r?\n", text or ""):
                marks = re.match(r"(?:[ \t]*>)*", raw).group()
                lines.append((marks.count(">"), raw[len(marks):]))
            normal = lambda s: re.sub(r"\s+", " ", s.lower()).strip()
            blocks, last = [], None
            for n, s in lines:
                if normal(s):
                    if last == n:
                        blocks[-1][1].append(normal(s))
                    else:
                        blocks.append((n, [normal(s)]))
                last = n if normal(s) else None
            quoted = [b for b in blocks if b[0]]
            found = [(n, len(" ".join(ls).split(" ")), origin_of(ls, said)) for n, ls in quoted]
            votes = {}
            for n, size, origin in found:
                if n == 1 and origin is not None:
                    votes[origin] = votes.get(origin, 0) + size
            origin = max(votes, key=lambda o: (votes[o], o)) if votes else None
            starts = bool(quoted) and origin is None
            if head is None or starts or origin is not None:
                head = turn
                thread_of[turn] = thread_of[head_of[origin]] if origin is not None else turn
            head_of[turn] = head
            kept = [s for i, (n, s) in enumerate(lines) if not n and not (
                re.match(r"(?i)^\s*on .{0,200} wrote:\s*$", s) and i + 1 < len(lines) and lines[i + 1][0])]
            made.append((turn, None if starts else origin if origin is not None else previous, thread_of[head], len(quoted),
                         sum(o is not None for *_, o in found), "\n".join(kept).strip("\n")))
            for n, ls in blocks:
                if not n:
                    said.update(dict.fromkeys([*ls, " ".join(ls)], turn))
            said.update(dict.fromkeys(fives(normal(" ".join(kept))), turn))
            previous = turn
        for place, m in enumerate(sorted(made, key=lambda m: (m[2], m[0]))):
            out[conv, m[0]] = (m[1], m[2], place, *m[3:])
    return out


def got(spark, messages, **kw):
    frame = spark.createDataFrame(messages, SCHEMA)
    return {(r.conv, r.turn): (r.reply_to, r.thread, r.position, r.n_quoted, r.n_linked, r.text)
            for r in quotes.threads(frame, **kw).collect()}


def story(seed, turns):
    rnd = random.Random(seed)
    words = ["yes", "no", "a b c d e f", "d e f g h", "a b c", "d e f g", "Why so?", "the  Plan", "ok then", "on Monday Ann wrote:", ""]
    out = []
    for conv in (1, 2):
        for turn in range(turns):
            lines = []
            for _ in range(rnd.randint(0, 4)):
                lines.append("> " * rnd.choice([0, 0, 0, 1, 1, 2]) + rnd.choice(words) + rnd.choice(["", "", f" {rnd.randint(0, turns)}"]))
            out.append((conv, turn * 3, "user", "\n".join(lines), 0))
    return out


@pytest.mark.parametrize("width", [4, 1024])
def test_like_the_plain_version(spark, monkeypatch, width):
    monkeypatch.setattr(quotes, "SLICE", width)
    messages = story(width, 30)
    assert got(prepare(spark), messages) == plain(messages)


def test_nested_levels_and_attribution(spark):
    messages = [(1, 0, "user", "How are you?\nAnd  the cat?", 0), (1, 1, "assistant", "> how are you?\nFine.", 0),
                (1, 2, "user", "Unrelated", 0), (1, 3, "user", "On May 2 Bob wrote:\n> Fine.\n>> How are you?\nGood.", 0),
                (1, 4, "user", "> said nowhere\nhm", 0), (1, 5, "user", "> and the CAT?\nasleep", 0)]
    assert got(spark, messages) == {
        (1, 0): (None, 0, 0, 0, 0, "How are you?\nAnd  the cat?"), (1, 1): (0, 0, 1, 1, 1, "Fine."), (1, 2): (1, 0, 2, 0, 0, "Unrelated"),
        (1, 3): (1, 0, 3, 2, 2, "Good."), (1, 4): (None, 4, 5, 1, 0, "hm"), (1, 5): (0, 0, 4, 1, 1, "asleep")}


def test_passages_however_they_are_wrapped(spark):
    """A re-wrapped passage, a part of a paragraph with a word changed, and a short line against a long passage."""
    long = "we should move the meeting to the second week of may because the hall is taken until then by the choir"
    words = long.split()
    wrap = lambda ws, width, mark: "\n".join(mark + " ".join(ws[i:i + width]) for i in range(0, len(ws), width))
    changed = [w if i != 14 else "hut" for i, w in enumerate(words)] + ["and", "so", "on", "it", "goes"]
    messages = [(1, 0, "user", "ok\n\n" + wrap(words, 6, ""), 0), (1, 1, "user", "unrelated\n\nok", 0),
                (1, 2, "user", wrap(words, 4, "> ") + "\nI agree", 0), (1, 3, "user", wrap(words[3:16], 5, "> ") + "\npart", 0),
                (1, 4, "user", wrap(changed, 7, "> ") + "\nnot the same", 0),
                (1, 5, "user", "> ok\n\n" + wrap(words, 9, "> ") + "\nboth", 0)]
    rows = got(spark, messages)
    assert rows == plain(messages)
    assert {t: r[0] for (_, t), r in rows.items()} == {0: None, 1: 0, 2: 0, 3: 0, 4: None, 5: 0}
    assert rows[1, 5][3:5] == (2, 2)


def test_nulls_repeats_and_empty(spark):
    assert got(spark, []) == {}
    frame = spark.createDataFrame([(None, 1, "user", None, 0), (None, 2, None, "> x", 0), (3, None, "user", "x", 0),
                                   (3, 1, "user", "> x", 0), (3, 1, "user", "> x", 0)], SCHEMA)
    rows = quotes.threads(frame).collect()
    assert len(rows) == 5
    assert sorted((r.conv, r.turn, r.position) for r in rows if r.conv) == [(3, -1, 0), (3, 1, 1), (3, 1, 2)]
    assert {(r.turn, r.text, r.thread) for r in rows if r.conv is None} == {(1, "", 1), (2, "", 2)}
    assert len(quotes.chat(frame).collect()) == 5
