import random
import re

import oracle
import pytest

from notelens.llm import licenses as op
from notelens.llm.license_queries import SQL, op13_license_scan
from notelens.llm.license_texts import TEMPLATES

SMALL = (
    op.Template("a", "free to use", base=True),
    op.Template("b", "use <<beginOptional>>and <<beginOptional>>or <<endOptional>>copy <<endOptional>>it"),
    op.Template("c", 'copy <<var;name="n";original="x";match=".{0,3}">> free'),
    op.Template("d", 'to <<var;name="n";original="1";match="[0-9]+">><<beginOptional>> or<<endOptional>> it'),
    op.Template("e", "<<beginOptional>>or <<endOptional>>it<<beginOptional>> is<<endOptional>>"),
)


def ends(items, words, at):
    """All places where ``items`` may end that start at ``at``."""
    if not items:
        return {at}
    item, rest = items[0], items[1:]
    if isinstance(item, op.Word):
        return ends(rest, words, at + 1) if at < len(words) and words[at] == item.text else set()
    if isinstance(item, op.Optional):
        return ends(rest, words, at) | {e for m in ends(item.items, words, at) for e in ends(rest, words, m)}
    out, n = set(), 0
    while n <= item.most:
        if n >= item.least:
            out |= ends(rest, words, at + n)
        if at + n >= len(words) or (item.pattern and not re.fullmatch(item.pattern.encode(), words[at + n])):
            break
        n += 1
    return out


def plain(text, templates):
    words = op.words_of(text)
    return [(i, max(found) - i, k) for i in range(len(words)) for k, t in enumerate(templates)
            if (found := ends(op.parse(t.markup), words, i))]


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_equals_definition(monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK", block)
    rng = random.Random(5)
    scanner = op.Scanner(op.Automaton(SMALL))
    for _ in range(300):
        text = " ".join(rng.choice(["free", "to", "use", "and", "or", "copy", "it", "is", "7", "42", "é"]) for _ in range(rng.randint(0, 40)))
        assert scanner.places(text.encode().lower()) == plain(text, SMALL)


def test_memory_is_refilled(monkeypatch):
    monkeypatch.setattr(op, "REMEMBERED", 2)
    monkeypatch.setattr(op, "BLOCK", 5)
    text = "copy a b c free to 7 or it is free to use and or copy it " * 9
    assert op.Scanner(op.Automaton(SMALL)).places(text.encode()) == plain(text, SMALL)


def test_words_and_cover():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("aZ09 .\n-é×漢_/:@[`{\x7f") for _ in range(rng.randint(0, 60)))
        low = text.encode().lower()
        lower = "".join(c.lower() if c < "\x7f" else c for c in text)
        assert op.count_words(low) == len(op.WORD.findall(low)) == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower))
    assert op.covered([(0, 3, 0), (1, 1, 1), (2, 4, 0), (9, 2, 0)]) == 8


@pytest.mark.parametrize("markup", [
    "", "<<beginOptional>>a<<endOptional>>", '<<var;match=".+">> a', 'a <<var;match=".*">>', "a <<beginOptional>> b", "a <<endOptional>>",
    "<<var;name=x>> a", '<<beginOptional>><<var;match=".{0,2}">><<endOptional>> a'])
def test_bad_templates(markup):
    with pytest.raises(ValueError):
        op.Automaton([op.Template("x", markup)])


def test_texts():
    automaton = op.Automaton(TEMPLATES)
    scanner = op.Scanner(automaton)

    def labels(text):
        return {TEMPLATES[k].label for _, _, k in scanner.places(text.encode().lower())}

    assert labels("Licensed under the Apache License, Version 2.0 (the terms)") == {"apache", "apache-2.0"}
    assert labels("licensed under the Apache License 1.1") == {"apache"}
    assert labels("This small work is licensed under CC BY-NC 4.0.") == {"cc-by", "cc-by-nc-notice"}
    assert labels("licensed under the terms of the GNU General Public License as published by the Free Software Foundation; "
                  "either version 2 of it") == {"gpl", "gpl-2.0"}
    mit = next(t for t in TEMPLATES if t.label == "mit-text").markup
    whole = re.sub(r'<<var;[^>]*original="(.*?)"[^>]*>>', "Ann and Bob", re.sub(r"<<(begin|end)Optional>>", "", mit).replace("<year> <holders>", "2020 A"))
    assert labels(whole) == {"mit", "mit-text"}
    assert labels(whole.replace("free of charge", "for a charge")) == {"mit"}
    bare = re.sub(r"<<beginOptional>>(?:(?!<<beginOptional>>).)*?<<endOptional>>", "", re.sub(
        r"<<beginOptional>>(?:(?!<<beginOptional>>).)*?<<endOptional>>", "", mit, flags=re.S), flags=re.S)
    assert labels(re.sub(r"<<var[^>]*>>", "we", bare)) == {"mit-text"}


def test_rows(spark, documents):
    long = "word " * 300_000 + "released under the MIT License " + "x" * 100_000
    rows = [(1, None), (2, ""), (3, "Free to use"), (3, "Free to use"), (None, "copy: x FREE!"), (4, "... \n"), (5, long)]
    got = op.scan(documents(rows, extra=["places", "n_words"]), [*SMALL, *TEMPLATES], keep=["doc_id", "places", "text"]).collect()
    found = sorted((r.doc_id or 0, r.n_words, tuple((p["label"], p["first"], p["count"]) for p in r.places), r.n_covered) for r in got)
    assert found == [
        (0, 3, (("c", 0, 3),), 3), (1, 0, (), 0), (2, 0, (), 0), (3, 3, (("a", 0, 3),), 3), (3, 3, (("a", 0, 3),), 3), (4, 0, (), 0),
        (5, 300_006, (("mit-notice", 300_000, 5), ("mit", 300_003, 2)), 5)]
    assert op.scan(documents([]), SMALL).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert oracle.compare(spark, oracle.connect(sf), sf, op13_license_scan, SQL) == ""
