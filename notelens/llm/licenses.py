"""Operator 13: license scans by templates with markup.

A template is a license's wording with marked regions: ``<<beginOptional>>`` to
``<<endOptional>>`` may be missing, and ``<<var;name="..";original="..";match="..">>``
stands for other words. All other words are mandatory. ``match`` counts or tests words:
``.{m,n}`` is m to n words of any kind, ``.+`` and ``.*`` are up to ``VAR_WORDS`` of them,
and every other pattern is one word that matches it wholly (in lower case). Case and
everything but words is free.

All templates are compiled into one token automaton: words of templates are symbols of
their own, all others are told apart only by the patterns they match. Its subsets of
states are made when they are met. A text is accepted at a place if the automaton, from
there, ends in a template's last state: the mandatory wording is then there, word by
word, and nothing but marked regions differs. Of the ends of a template at one start the
last counts. Every start of a text is tried, so places may overlap. Plain phrases are
templates without regions (``base``).

A template must have mandatory words and may neither start nor end with any words
(``.+``, ``.*`` or ``.{m,n}``); its length is bounded by its markup. Texts without any of
the templates' anchors (a mandatory word of each) cannot be accepted and are only counted.
Words are read in blocks, with an overlap of the longest template, so that the work for a
text is linear and no list of all its words is held. A document is handled where it is
read: nothing is shuffled or sent to the driver, and a hot source does not matter.

Null and empty texts, and those without words, have no words and no places. Repeated rows
are scanned each, whatever their ids. Outputs replace kept columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.llm.tables import map_rows, slices

#: Most words of a region ``.+`` or ``.*``.
VAR_WORDS = 24
#: Words scanned at once.
BLOCK = 1 << 16
#: Words and subsets of states a task remembers.
REMEMBERED = 1 << 16

#: Words of lower-cased UTF-8: digits, a-z and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_MARKED = bytes(0x61 if b in _WORD_BYTES else 0x20 for b in range(256))
_MARKUP = re.compile(r"<<(?:(beginOptional)|(endOptional)|var;(.*?))>>", re.S)
_COUNTED = re.compile(r"\.(?:(\+)|(\*)|\{(\d+),(\d+)\})\Z")


@dataclass(frozen=True)
class Template:
    label: str
    markup: str
    base: bool = False


@dataclass(frozen=True)
class Word:
    text: bytes


@dataclass(frozen=True)
class Optional:
    items: tuple


@dataclass(frozen=True)
class Region:
    """``least`` to ``most`` words; any words if ``pattern`` is None."""

    pattern: str | None
    least: int
    most: int


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def parse(markup: str) -> tuple:
    """The words and regions of a template."""
    stack: list[list] = [[]]
    at = 0
    for found in _MARKUP.finditer(markup):
        stack[-1] += map(Word, words_of(markup[at:found.start()]))
        at = found.end()
        if found[1]:
            stack.append([])
        elif found[2]:
            if len(stack) == 1:
                raise ValueError("endOptional without a begin")
            inner = tuple(stack.pop())
            stack[-1].append(Optional(inner))
        else:
            match = re.search(r'match="(.*?)"', found[3], re.S)
            if not match:
                raise ValueError(f"a region without match: {found[0]}")
            counted = _COUNTED.match(match[1])
            if not counted:
                stack[-1].append(Region(match[1], 1, 1))
            elif counted[3]:
                stack[-1].append(Region(None, int(counted[3]), int(counted[4])))
            else:
                stack[-1].append(Region(None, 1 if counted[1] else 0, VAR_WORDS))
    if len(stack) > 1:
        raise ValueError("an optional region has no end")
    return tuple(stack[0] + list(map(Word, words_of(markup[at:]))))


def longest(items: tuple) -> int:
    """Most words of a place."""
    return sum(1 if isinstance(i, Word) else i.most if isinstance(i, Region) else longest(i.items) for i in items)


class Automaton:
    """One automaton of all templates; state 0 is the start, state 1 accepts nothing any more."""

    def __init__(self, templates: Sequence[Template]):
        self.templates = tuple(templates)
        self.moves: list[list[tuple]] = []  # of every place in a template: (test, next place)
        self.free: list[list[int]] = []  # next places without a word
        self.patterns: list[re.Pattern] = []
        self.words: set[bytes] = set()
        self.ends: dict[int, int] = {}
        self.longest = 0
        anchors: set[bytes] = set()
        starts = []
        for k, template in enumerate(self.templates):
            items = parse(template.markup)
            required = [i.text for i in items if isinstance(i, Word)]
            if not required:
                raise ValueError(f"template {template.label} has no mandatory word")
            if not anchors.intersection(required):
                anchors.add(max(required, key=len))
            start = self._place()
            end = self._add(items, start)
            self.ends[end] = k
            starts.append(start)
            self.longest = max(self.longest, longest(items))
        self.anchors = sorted(anchors)
        self._start = self._closed(starts)
        self._clear()
        for place in self._start:
            if any(test is None for test, _ in self.moves[place]):
                raise ValueError("a template starts with any words")
        for place, moves in enumerate(self.moves):
            if any(test is None and self._closed([to]) & self.ends.keys() for test, to in moves):
                raise ValueError("a template ends with any words")

    def _place(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _add(self, items: tuple, at: int) -> int:
        """Append ``items`` behind place ``at``; the place behind them."""
        for item in items:
            if isinstance(item, Word):
                self.words.add(item.text)
                to = self._place()
                self.moves[at].append((item.text, to))
            elif isinstance(item, Optional):
                inner = self._add(item.items, at)
                to = self._place()
                self.free[inner].append(to)
                self.free[at].append(to)
            else:
                test = None
                if item.pattern is not None:
                    test = len(self.patterns)
                    self.patterns.append(re.compile(item.pattern.encode()))
                for _ in range(item.least):
                    to = self._place()
                    self.moves[at].append((test, to))
                    at = to
                to = self._place()
                self.free[at].append(to)
                for _ in range(item.most - item.least):
                    following = self._place()
                    self.moves[at].append((test, following))
                    self.free[following].append(to)
                    at = following
            at = to
        return at

    def _closed(self, places) -> frozenset:
        found, todo = set(places), list(places)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in found:
                    found.add(to)
                    todo.append(to)
        return frozenset(found)

    def _clear(self) -> None:
        self.sets: list[frozenset] = [self._start, frozenset()]
        self.numbers = {s: k for k, s in enumerate(self.sets)}
        self.accepted: list[tuple[int, ...]] = [(), ()]
        self.steps: dict[tuple, int] = {}

    def symbol(self, word: bytes) -> tuple:
        """What the automaton can tell of a word."""
        return (word if word in self.words else None, *(k for k, p in enumerate(self.patterns) if p.fullmatch(word)))

    def step(self, state: int, symbol: tuple) -> int:
        known = self.steps.get((state, symbol))
        if known is not None:
            return known
        to = self._closed({
            to for place in self.sets[state] for test, to in self.moves[place]
            if test is None or (test == symbol[0] if isinstance(test, bytes) else test in symbol[1:])})
        if to not in self.numbers:
            self.numbers[to] = len(self.sets)
            self.sets.append(to)
            self.accepted.append(tuple(sorted(self.ends[p] for p in to if p in self.ends)))
        self.steps[state, symbol] = self.numbers[to]
        return self.numbers[to]

    def may_hold(self, low: bytes) -> bool:
        """Whether an anchor is a word of the lower-cased text."""
        for anchor in self.anchors:
            at = low.find(anchor)
            while at >= 0:
                end = at + len(anchor)
                if (at == 0 or low[at - 1] not in _WORD_BYTES) and (end == len(low) or low[end] not in _WORD_BYTES):
                    return True
                at = low.find(anchor, at + 1)
        return False


class Scanner:
    """Scans texts with an automaton; remembers the symbols of words."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.symbols: dict[bytes, tuple] = {}

    def _symbols(self, words: list[bytes]) -> list[tuple]:
        known = self.symbols
        if len(known) > REMEMBERED:
            known.clear()
        for word in set(words).difference(known):
            known[word] = self.automaton.symbol(word)
        return [known[w] for w in words]

    def places(self, low: bytes) -> list[tuple[int, int, int]]:
        """``(first word, words, template)`` of every place of a lower-cased text, in that order."""
        automaton = self.automaton
        stream = WORD.finditer(low)
        found, offset, ahead, more = [], 0, [], True
        while more or ahead:
            fresh = []
            for match in stream:
                fresh.append(match.group())
                if len(fresh) == BLOCK:
                    break
            more = len(fresh) == BLOCK
            ahead += self._symbols(fresh)
            if len(automaton.sets) > REMEMBERED:
                automaton._clear()
            starts = {s for s in set(ahead) if automaton.step(0, s) != 1}
            done = max(0, len(ahead) - automaton.longest) if more else len(ahead)
            for i in [i for i in range(done) if ahead[i] in starts]:
                state, last = 0, {}
                for j in range(i, min(i + automaton.longest, len(ahead))):
                    state = automaton.step(state, ahead[j])
                    if state == 1:
                        break
                    for k in automaton.accepted[state]:
                        last[k] = j + 1 - i
                found += [(offset + i, last[k], k) for k in sorted(last)]
            offset += done
            ahead = ahead[done:]
        return found


def count_words(low: bytes) -> int:
    marked = low.translate(_MARKED)
    return marked.count(b" a") + marked.startswith(b"a")


def covered(places: list[tuple[int, int, int]]) -> int:
    """Words inside of places."""
    total, end = 0, 0
    for first, count, _ in sorted(places):
        total += max(0, first + count - max(end, first))
        end = max(end, first + count)
    return total


PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()),
                      T.StructField("first", T.LongType()), T.StructField("count", T.LongType())])


def scan(df: DataFrame, templates: Sequence[Template], text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``n_words``, ``places`` (label, base, first word from 0, count of words) and ``n_covered`` of every text."""
    automaton = Automaton(templates)
    names = ("n_words", "places", "n_covered")
    kept = [c for c in keep if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(automaton)
        for batch in slices(batches):
            counts, lists, inside = [], [], []
            for value in batch.column(batch.num_columns - 1):
                low = (value.as_py() or "").encode().lower()
                counts.append(count_words(low))
                places = scanner.places(low) if automaton.may_hold(low) else []
                inside.append(covered(places))
                lists.append([{"label": automaton.templates[k].label, "base": automaton.templates[k].base, "first": i, "count": n}
                              for i, n, k in places])
            out = {c: batch.column(k) for k, c in enumerate(kept)}
            place = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("count", pa.int64())])
            yield pa.RecordBatch.from_pydict(out | {
                "n_words": pa.array(counts, pa.int64()), "places": pa.array(lists, pa.list_(place)), "n_covered": pa.array(inside, pa.int64())})

    fields = [df.schema[c] for c in kept] + [
        T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(PLACE)), T.StructField("n_covered", T.LongType())]
    return map_rows(df.select(*kept, F.col(text)), run, fields)
