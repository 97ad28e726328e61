"""Text expressions: columns in, columns out, no Python in the tasks."""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text formats below must not change, they decide the tokens.
PUNCTUATION = string.punctuation
DIGIT_TOKEN = "DIGITPARSED"
HEADER_PREFIX = "header="
DOCUMENT_PREFIX = "document="
SENTENCE_HEADER = "SENTENCE"
PAD = "<pad>"
TARGET = "TARGETWORD"
# All white space in the sense of Unicode plus the four ASCII separators.
SPACE_SET = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# Most characters fail the first, cheap half of the intersection below, which
# makes matching about twice as fast as the plain set.
SPACE = r"[\x{0}-\x{20}\x{7f}-\x{3000}&&[" + SPACE_SET + "]]"
NON_SPACE = f"[^{SPACE_SET}]"
SPACES = f"{SPACE}+"
# A noncharacter of Unicode, which is reserved for marks inside a process.
GUARD = "\ufdd0"
WORD_CHARS = r"\p{L}\p{N}_"
HEADER_BODY = rf"(?:^|{SPACE}{{4,}}|\n)[\p{{Nd}}.#]{{0,4}}{SPACE}*([A-Z][A-z0-9/ ]+[A-z]:)"
HEADER = "(?dm)" + HEADER_BODY
# The same with the characters ahead of the name inside the group.
HEADER_WHOLE = "(?dm)(" + HEADER_BODY.replace("([A-Z]", "[A-Z]").replace(":)", ":") + ")"
SENTENCE_BREAK = (
    rf"(?d)\.{SPACE}|\n{{2,}}|^{SPACE}{{0,}}\p{{Nd}}{{1,2}}{SPACE}{{0,}}[-).]{SPACE}{{1,}}"
)
DEID_SPAN = r"(?d)\[\*\*.*?\*\*\]"
DEID_WRAP = rf"_%#({NON_SPACE}+)#%_"
JOINERS = r"[_*?/()]+"
NUMBER = r"(?U)\b(-)?[\d.,]+(-)?\b"
# Symbols that stay out of the stop-word set, and extras that join it.
MATH_SYMBOLS = ["%", "+", "-", ">", "<", "="]
EXTRA_STOPS = ["'s", "`"]
# Uninformative phrases in inventory long forms.
LF_NOISE_PHRASES = [
    "unidentified", "otherwise", "specified", "nos", "procedure", "in abo system", "geographic location",
]
LF_NOISE_WORDS = ["unidentified", "otherwise", "specified", "nos", "procedure"]
PREPOSITIONS = [
    "about", "above", "across", "after", "against", "among", "around", "at", "before", "behind", "below",
    "beside", "between", "by", "down", "during", "except", "for", "from", "in", "inside", "into", "near",
    "of", "off", "on", "out", "over", "through", "to", "toward", "under", "up", "with",
]
# End of fixed values.


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row.

    A lambda evaluates whatever it captures once per element, so anything but
    a plain column has to be bound before an inner lambda refers to it.
    """
    return F.get(F.transform(F.array(value), use), 0)


def words_array(values: Sequence[str]) -> Column:
    """A string-array literal; an empty one keeps its type."""
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def split_spaces(text: Column) -> Column:
    """Non-empty white-space separated words."""
    return F.array_remove(F.split(text, SPACES), "")


def section_headers(text: Column) -> Column:
    """Upper-cased section names found in ``text``, in order, without the colon."""
    found = F.regexp_extract_all(text, F.lit(HEADER), F.lit(1))
    return F.transform(found, lambda h: F.btrim(F.btrim(F.upper(h)), F.lit(":")))


def split_keeping(text: Column, pattern: str) -> Column:
    """Split by ``pattern`` and keep its first group between the pieces.

    The result alternates piece, group, piece, ..., piece: the odd positions
    (counted from 0) are the delimiters.
    """
    pieces = F.split(text, pattern, -1)
    marks = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.flatten(
        F.transform(
            F.arrays_zip(pieces.alias("piece"), marks.alias("mark")),
            lambda p: F.when(p["mark"].isNull(), F.array(p["piece"])).otherwise(F.array(p["piece"], p["mark"])),
        )
    )


def clean(text: Column, collapse: bool = True) -> Column:
    """De-identified spans and joiners to spaces, numbers to one marker, spaces collapsed.

    Text that is split into words next may keep its runs of spaces.
    """
    out = F.regexp_replace(text, DEID_SPAN, " ")
    out = F.regexp_replace(out, JOINERS, " ")
    out = F.regexp_replace(out, NUMBER, f" {DIGIT_TOKEN} ")
    return F.regexp_replace(out, SPACES, " ") if collapse else out


def unwrap_deid(text: Column) -> Column:
    """``_%#X#%_`` becomes ``X``."""
    return F.regexp_replace(text, DEID_WRAP, "$1")


def tokenize(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Lower-cased words stripped of edge punctuation, without empties and stop words."""
    stripped = F.transform(F.split(F.lower(text), SPACES), lambda w: F.btrim(w, F.lit(PUNCTUATION)))
    if not stopwords:
        return F.filter(stripped, lambda w: w != "")
    return F.filter(stripped, lambda w: ~w.isin(["", *stopwords]))


def eval_tokenize(text: Column, blacklist: Sequence[str] = (), unique_only: bool = False) -> Column:
    """Tokens of an evaluation sentence, without the blacklist and the number marker."""
    banned = list(blacklist) + [DIGIT_TOKEN.lower()]
    tokens = tokenize(clean(unwrap_deid(text), collapse=False), banned)
    return F.array_distinct(tokens) if unique_only else tokens


def _pseudo_token(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.regexp_replace(name, f"(?::|{SPACE})+", "")))


def section_token(name: Column) -> Column:
    return _pseudo_token(HEADER_PREFIX, name)


def document_token(category: Column) -> Column:
    return _pseudo_token(DOCUMENT_PREFIX, category)


def is_section_token(token: Column) -> Column:
    return F.contains(token, F.lit(HEADER_PREFIX))


def is_document_token(token: Column) -> Column:
    return F.contains(token, F.lit(DOCUMENT_PREFIX))


def token_kind(token: Column) -> Column:
    return (
        F.when(is_section_token(token), F.lit("section"))
        .when(is_document_token(token), F.lit("category"))
        .otherwise(F.lit("token"))
    )


def note_pieces(text: Column, compat: bool = False) -> Column:
    """Non-blank pieces of a note as ``struct(is_header, is_empty, name, body)``.

    ``is_empty`` marks a header with no body before the next header. With
    ``compat`` a piece counts as a header whenever it *starts* like one, which
    also claims bodies that open with a second header-like phrase.
    """
    marked = F.regexp_replace(F.replace(text, F.lit(GUARD), F.lit("")), HEADER, f"{GUARD}$1{GUARD}")
    parts = F.transform(
        F.split(marked, GUARD, -1),
        lambda piece, i: F.struct((i % 2 == 1).alias("is_header"), piece.alias("body")),
    )
    parts = F.filter(parts, lambda p: p["body"].rlike(NON_SPACE))
    if compat:
        starts = rf"(?dm)\A{HEADER_BODY}"
        parts = F.transform(
            parts, lambda p: F.struct(p["body"].rlike(starts).alias("is_header"), p["body"].alias("body"))
        )
    return let(
        parts,
        lambda all_parts: F.transform(
            all_parts,
            lambda p, i: F.struct(
                p["is_header"].alias("is_header"),
                (p["is_header"] & F.coalesce(F.get(all_parts, i + 1)["is_header"], F.lit(True))).alias("is_empty"),
                F.when(p["is_header"], F.btrim(F.upper(p["body"]), F.lit(": "))).alias("name"),
                p["body"].alias("body"),
            ),
        ),
    )


def sentence_tokens(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Tokens of a body with a boundary token before every sentence but the first and the last."""
    sentences = F.filter(F.split(text, SENTENCE_BREAK), lambda s: s != "")
    mark = section_token(F.lit(SENTENCE_HEADER))
    nothing = words_array(())
    return let(
        sentences,
        lambda found: F.flatten(
            F.transform(
                found,
                lambda s, i: F.concat(
                    F.when((i > 0) & (i < F.size(found) - 1), F.array(mark)).otherwise(nothing),
                    tokenize(clean(s, collapse=False), stopwords),
                ),
            )
        ),
    )


def drop_adjacent_duplicates(tokens: Column) -> Column:
    return let(tokens, lambda all_: F.filter(all_, lambda t, i: (i == 0) | (t != F.get(all_, i - 1))))


def clean_long_form(lf: Column, sf: Column) -> Column:
    """Lower-cased, sorted, distinct synonyms without noise phrases and the short form itself."""
    noise = rf"{SPACES}[(]?(" + "|".join(LF_NOISE_PHRASES) + r")[)]?"
    low_sf = F.lower(sf)
    parts = F.transform(
        F.split(F.lower(lf), ";"),
        lambda s: F.replace(F.regexp_replace(s, noise, ""), F.concat(low_sf, F.lit(" - ")), F.lit("")),
    )
    kept = F.filter(parts, lambda s: s != low_sf)
    return F.array_join(F.array_sort(F.array_distinct(kept)), ";")


def standardize_entry(entry: Column, special: Sequence[str]) -> Column:
    """One vocabulary line: trimmed, lower-cased unless it is a special token."""
    trimmed = F.regexp_replace(entry, f"^{SPACES}|{SPACES}$", "")
    return F.when(trimmed.isin(list(special)), trimmed).otherwise(F.lower(trimmed))
