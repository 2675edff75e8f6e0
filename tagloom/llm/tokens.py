"""Token ids of whole texts by a public tokenizer, with a memo of word pieces.

Byte-pair encoding never merges across the borders that the pre-tokenizer draws, and a space between two
other characters that are not white space always begins a new piece. So a batch is cut at its spaces and dictionary
encoded, each distinct piece that the worker does not know goes through the tokenizer, and the ids are gathered by
piece. A text in which white space comes before a space is encoded as a whole.

Where a tokenizer lowers letters and drops white space, as its own rules show on examples, capitals are lowered and white space
becomes spaces before the cut, and marks after a letter are cut off, so that many forms of a word are one piece.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tagloom.llm.workers import held_by_worker

PIECES = 400_000  # pieces a worker remembers during a stage, some 80 MB
MARKS = "\u00a7\u00b6\u00b0\u00a9\u00ae\u00b1\u241e"  # one stands between pieces that are encoded together: one id if there is such a mark
CLOSING = ".,!?;:#$%&*|"  # marks after a Latin letter are a piece of their own for the pre-tokenizers
LATIN = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"  # beyond, a letter may turn into a letter and a mark when lower-cased
LETTERS = [c for c in map(chr, range(256)) if c.isalpha()]
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"  # white space of any tokenizer
COMBINING = r"\p{M}"  # may compose with a small letter and not with its capital
GATHERED = 1 << 16  # pieces whose ids are gathered at a time
CAPITALS = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@cache
def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def strings(texts: pa.Array) -> list[str]:
    """The texts of an array without nulls; much quicker than element by element."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of texts, as ``Tokenizer.encode(text, add_special_tokens=False).ids`` gives them."""

    def __init__(self, path: str, pieces: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.mark = min(MARKS, key=lambda m: len(self._plain(" " + m)))
        self.mark_ids = self._plain(" " + self.mark)
        self.limit = pieces
        self._read_model()
        self._forget()

    def _read_model(self) -> None:
        """What the tokenizer's model is given for a word of Latin letters: one text, each letter replaced by itself.
        Where that does not hold, ``letters`` stays empty."""
        self.model, self.letters, self.folds = self.tokenizer.model, {}, False
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # the memo asks for no word twice
        rule, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if cut is None:
            return

        def given(text: str) -> str:
            return "".join(part for part, _ in cut.pre_tokenize_str(rule.normalize_str(text) if rule else text))

        self.lead = given(" a")[:-1]
        table = {ord(c): given(" " + c)[len(self.lead):] for c in LETTERS}
        every = "".join(LETTERS)
        if given(" " + every) == self.lead + every.translate(table):
            self.letters = table
        self._read_folding(lambda text: [part for part, _ in cut.pre_tokenize_str(rule.normalize_str(text) if rule else text)])

    def _read_folding(self, parts: Callable[[str], list[str]]) -> None:
        """Whether capitals count as small letters, white space only parts words, and closing marks after a letter stand apart."""
        capitals = "".join(map(chr, CAPITALS))
        blanks = [c for c in "\t\n\v\f\r" if parts(f"a{c}b.{c}{c} {c}.") == parts("a b. .")]
        alone = [c for c in CLOSING if all(parts(f"a{c}{e}") == parts("a") + parts(c + e) for e in ("", "a", "é", "1", "'s", *CLOSING))]
        self.folds = (
            bool(self.letters) and parts("  a  b ") == parts("a") + parts("b") and parts(" ") == []
            and all(parts(c) == parts(c.lower()) for c in [*capitals, capitals, *(f"'{c}" for c in capitals)])
            and all(t.special for t in self.tokenizer.get_added_tokens_decoder().values()))
        fold = {**CAPITALS, **dict.fromkeys(map(ord, blanks), ord(" "))}
        self.fold = bytes(fold.get(c, c) for c in range(256))
        self.closes = np.isin(np.arange(256), [ord(c) for c in alone])

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of Latin letters with a space before them, and how many each has, from the tokenizer's model."""
        tokenize, lead, table = self.model.tokenize, self.lead, self.letters
        ids, counts = array("I"), []
        for word in words:
            found = tokenize(lead + word.translate(table))
            ids.extend([t.id for t in found])
            counts.append(len(found))
        return np.frombuffer(ids, np.uint32), np.array(counts, np.int64)

    def _folded(self, texts: pa.Array) -> pa.Array:
        """The texts with small letters for capitals, spaces for white space, and a space before marks that close a word."""
        if not len(texts):
            return texts
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        first, last = offsets[[0, -1]].tolist()
        held = np.frombuffer(texts.buffers()[2][first:last].to_pybytes().translate(self.fold) if last > first else b"", np.uint8)
        offsets = offsets - first
        letter = held - np.uint8(97) < 26
        cuts = np.flatnonzero(letter[:-1] & self.closes[held[1:]]) + 1
        held = np.insert(held, cuts, 32)
        offsets = (offsets + np.searchsorted(cuts, offsets)).astype(np.int32)
        return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(held))

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # numbers of pieces after a space
        self.start = np.zeros(1 << 12, np.int32)
        self.count = np.zeros(1 << 12, np.int32)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.tails: dict[str, np.ndarray] = {}
        self.used = self.missed = 0

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces with a space before them, and how many each has: in one text, cut again at the marks."""
        joined = f" {self.mark} ".join(pieces)
        if pieces and joined.count(self.mark) == len(pieces) - 1:
            ids = self._plain(f" {joined} {self.mark}")
            n = len(self.mark_ids)
            hit = np.ones(max(0, len(ids) - n + 1), bool)
            for i, m in enumerate(self.mark_ids):
                hit &= ids[i:len(ids) - n + 1 + i] == m
            at = np.flatnonzero(hit)
            if len(at) == len(pieces):
                kept = np.ones(len(ids), bool)
                kept[(at[:, None] + np.arange(n)).reshape(-1)] = False
                return ids[kept], np.diff(at, prepend=-n) - n
        # a piece that holds the mark, or a tokenizer that does not keep it apart
        each = [self._plain(" " + p) for p in pieces]
        return np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(e) for e in each], np.int64)

    def _learn(self, pieces: pa.Array) -> None:
        """Encode new pieces. A word with closing punctuation is the word and the punctuation, each known or encoded once."""
        words = pc.utf8_rtrim(pieces, characters=CLOSING)
        parted = pc.and_(pc.not_equal(words, pieces), pc.match_substring_regex(words, f"{LATIN}$"))
        ends = strings(pieces.filter(parted))
        heads = strings(words.filter(parted))
        fresh = dict.fromkeys(strings(pieces.filter(pc.invert(parted))))
        fresh.update(dict.fromkeys(w for w in heads if w not in self.known))
        whole = pa.array(list(fresh), pa.string())
        words = pc.match_substring_regex(whole, f"^{LATIN}+$") if self.letters else pc.equal(whole, "")
        rest = whole.filter(pc.invert(words))
        marked = pc.match_substring(rest, self.mark)
        for way, group in ((self._words, whole.filter(words)), (self._encode, rest.filter(pc.invert(marked))),
                           (self._encode, rest.filter(marked))):
            if len(group):
                group = strings(group)
                self._add(group, *way(group))
        if not ends:
            return
        at = np.fromiter(map(self.known.__getitem__, heads), np.int64, len(heads))
        tails = [e[len(w):] for e, w in zip(ends, heads)]
        for tail in set(tails) - self.tails.keys():
            self.tails[tail] = self._plain(tail)
        lasts = [self.tails[t] for t in tails]
        n_head, n_tail = self.count[at].astype(np.int64), np.array([len(t) for t in lasts])
        ids = np.zeros(int((n_head + n_tail).sum()), np.uint32)
        in_tail = np.repeat(np.tile([False, True], len(at)), np.stack([n_head, n_tail], axis=1).reshape(-1))
        ids[in_tail] = np.concatenate(lasts)
        ids[~in_tail] = self._ids(at)
        self._add(ends, ids, n_head + n_tail)

    def _add(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        first = len(self.known)
        self.known.update(zip(pieces, range(first, first + len(pieces))))
        while len(self.known) > len(self.start):
            self.start, self.count = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.start[first:len(self.known)] = self.used + np.cumsum(counts) - counts
        self.count[first:len(self.known)] = counts
        self.used += len(ids)

    def _ids(self, at: np.ndarray) -> np.ndarray:
        """The ids of pieces, one after another."""
        counts = self.count[at]
        ends = np.cumsum(counts, dtype=np.int32)
        return self.flat[np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(self.start[at] - (ends - counts), counts)]

    def _trim(self, before: int) -> None:
        """A full memo keeps its oldest pieces, the frequent ones, until what it lacks is several times as much."""
        if len(self.known) <= self.limit:
            return
        self.missed += len(self.known) - before
        if self.missed > 4 * self.limit:
            self._forget()
            return
        while len(self.known) > max(before, self.limit):
            self.known.popitem()  # the youngest
        last = len(self.known) - 1
        self.used = int(self.start[last] + self.count[last]) if last >= 0 else 0

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (none is null); what the texts have of new pieces is encoded together."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        if not self.folds or texts.type != pa.string() or texts.nbytes > 1 << 30:  # more, cut again, might not fit the offsets
            return self._kept(texts)
        odd = pc.match_substring_regex(texts, COMBINING)
        if not pc.any(odd).as_py():
            return self._loose(texts)
        found = [iter(self._loose(texts.filter(pc.invert(odd)))), iter(self._kept(texts.filter(odd)))]
        return [next(found[o]) for o in odd.to_pylist()]

    def _numbers(self, coded: pa.DictionaryArray, names: list[str], wanted: np.ndarray) -> np.ndarray:
        """The numbers of a dictionary's pieces; new ones that are wanted are learned first."""
        numbers = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero((numbers < 0) & wanted)
        if len(new):
            self._learn(coded.dictionary.take(pa.array(new)))
            numbers[new] = [self.known[names[i]] for i in new.tolist()]
        return numbers

    def _loose(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts of a tokenizer that folds, without combining marks: a piece gives the same ids wherever it stands."""
        before = len(self.known)
        cut = pc.split_pattern(self._folded(texts), " ")
        coded = pc.list_flatten(cut).dictionary_encode()
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        names = strings(coded.dictionary)
        numbers = self._numbers(coded, names, np.ones(len(names), bool))
        place = coded.indices.to_numpy(zero_copy_only=False)
        out, start, i = [], 0, 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, start + GATHERED, "right")))
            at = numbers[place[start:ends[j - 1]]]
            upto = np.concatenate([[0], np.cumsum(self.count[at])])[np.concatenate([[start], ends[i:j]]) - start].tolist()
            ids = self._ids(at)
            out += [ids[a:b] for a, b in zip(upto[:-1], upto[1:])]
            start, i = int(ends[j - 1]), j
        self._trim(before)
        return out

    def _kept(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts of any tokenizer, cut at their spaces only."""
        before = len(self.known)
        cut = pc.split_pattern(texts, " ")
        coded = pc.list_flatten(cut).dictionary_encode()
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        place = coded.indices.to_numpy(zero_copy_only=False)
        # the first piece of a text has no space before it, and a piece that ends in white space is not to be cut from the next one
        first = np.zeros(len(place), bool)
        first[ends[:-1]] = True
        first[:1] = True
        blank = pc.or_(pc.equal(coded.dictionary, ""), pc.match_substring_regex(coded.dictionary, f"{BLANK}$"))
        blank = blank.to_numpy(zero_copy_only=False)
        used = np.zeros(len(coded.dictionary), bool)
        used[place[~first]] = True
        names = strings(coded.dictionary)
        numbers = self._numbers(coded, names, used & ~blank)
        out, start, plain = [], 0, [texts[i].as_py() if e - s < 2 else None for i, (s, e) in enumerate(zip([0, *ends[:-1]], ends))]
        for i, end in enumerate(ends.tolist()):
            at = place[start:end]
            if plain[i] is not None or blank[at].any() and (not blank[at[0]] or names[at[0]] or blank[at[1:]].any()):
                out.append(self._plain(texts[i].as_py()))
            else:
                tail = self._ids(numbers[at[1:]])
                out.append(np.concatenate([self._plain(names[at[0]]), tail]) if names[at[0]] else tail)
            start = end
        self._trim(before)
        return out


@cache
def encoder(path: str) -> Encoder:
    """The encoder of this worker; its memo is given back when a task of another stage begins."""
    found = Encoder(path)
    held_by_worker(found._forget)
    return found
