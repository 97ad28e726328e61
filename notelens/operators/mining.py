"""Mining labelled examples: dictionary scans over documents, contexts, sampling, splits.

A scan of every document with every dictionary entry is turned into an
equality join on anchors: two neighbouring parts of an entry, which documents
meet by hash before any phrase is built. Phrases are compared with runs of white
space as one space. An entry matches between boundaries, i.e. at white space or
where a word character meets another character.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelens.functions import text as tx
from notelens.functions.hashing import uniform
from notelens.functions.text import let
from notelens.operators.filters import key_filter, may_match
from notelens.operators.scale import fits_broadcast, first_k_in_group, lookup_join, number_rows, rank_in_group, sized, stage, wide_lookup
from notelens.sources.spread import spread

SEGMENTS = rf"[{tx.WORD_CHARS}]+|[^{tx.WORD_CHARS}]+"


def long_form_entries(senses: DataFrame, lf: str = "lf") -> DataFrame:
    """``entries(lf, phrase, n_words, priority)``: the synonyms of each long form.

    Longer synonyms come first, equally long ones keep their order.
    """
    synonym = F.posexplode(F.split(lf, ";")).alias("place", "synonym")
    phrases = senses.select(F.col(lf).alias("lf")).distinct().select("lf", synonym)
    words = tx.split_spaces(F.lower("synonym"))
    return (
        phrases.select("lf", "place", words.alias("words"))
        .where(F.size("words") > 0)
        .select(
            "lf", F.array_join("words", " ").alias("phrase"), F.size("words").alias("n_words"),
            F.struct((-F.size("words")).alias("longest"), F.col("place")).alias("priority"),
        )
        .groupBy("lf", "phrase", "n_words")
        .agg(F.min("priority").alias("priority"))
    )


def short_form_entries(senses: DataFrame, endings: bool = False, ignore_case: bool = True) -> DataFrame:
    """Dictionary of short forms, with plural and possessive endings on request."""
    forms = ["", "s", "'s", "s'"] if endings else [""]
    sf = F.lower("sf") if ignore_case else F.col("sf")
    form = F.explode(tx.words_array(forms)).alias("ending")
    return senses.select("sf").distinct().select("sf", form).select(
        F.col("sf").alias("lf"), F.concat(sf, F.col("ending")).alias("phrase"), F.lit(1).alias("n_words"),
        F.struct((-F.length("ending")).alias("longest"), F.lit(0).alias("place")).alias("priority"),
    )


def with_inflections(entries: DataFrame, word_forms: DataFrame) -> DataFrame:
    """Add entries whose words are replaced by other forms from ``word_forms(word, form)``.

    One word after another is looked up, so all combinations of forms arise.
    """
    longest = entries.agg(F.max("n_words")).first()[0] or 0
    forms = sized(
        word_forms.select("word", "form").union(word_forms.select("word", F.col("word").alias("form"))).distinct()
    )
    rows = entries.withColumn("words", F.split("phrase", " "))
    for i in range(longest):
        rows = (
            rows.withColumn("word", F.get("words", F.lit(i))).join(forms, "word", "left")
            .withColumn("words", F.transform("words", lambda w, k: F.when((k == i) & F.col("form").isNotNull(), F.col("form")).otherwise(w)))
            .drop("word", "form")
        )
    return rows.withColumn("phrase", F.array_join("words", " ")).groupBy("lf", "phrase", "n_words").agg(
        F.min("priority").alias("priority")
    )


def _segments(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit(SEGMENTS), F.lit(0))


#: Kinds of anchors: a lone part of a one-word entry, two neighbouring parts of one, parts on both sides of a word break.
LONE, PAIR, BREAK = "lone", "pair", "break"
FIRST = rf"\A(?:[{tx.WORD_CHARS}]+|[^{tx.WORD_CHARS}]+)"
# The look-behind keeps a search from trying every place inside of a part.
LAST = rf"(?<![{tx.WORD_CHARS}])[{tx.WORD_CHARS}]+\z|(?<![^{tx.WORD_CHARS}])[^{tx.WORD_CHARS}]+\z"


def _anchor(kind: str, a: Column, b: Column) -> Column:
    return F.xxhash64(F.lit(kind), a, b)


def with_anchors(entries: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``entries`` with ``kind``, ``key`` and ``place`` of the anchor of each, and the parts of its first and last word.

    An entry can occur only where its anchor does: two neighbouring parts of it, or its one part. Of several the one
    with the rarest part is taken by ``counts(segment, n)``, else the longest; ties go to the first.
    """
    words = F.split("phrase", " ")
    part = lambda pattern, word: F.regexp_extract(word, pattern, 0)
    option = lambda kind, place, a, b: F.struct(
        F.lit(kind).alias("kind"), place.alias("place"), a.alias("a"), b.alias("b"))
    none = F.lit("")
    inside = let(_segments(F.col("phrase")), lambda seg: F.when(
        F.size(seg) == 1, F.array(option(LONE, F.lit(0), F.get(seg, 0), none))).otherwise(F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(seg) - 2, F.lit(0))), lambda i: option(PAIR, i, F.get(seg, i), F.get(seg, i + 1)))))
    breaks = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 2, F.lit(0))), lambda j: option(
        BREAK, j, part(LAST, F.get(words, j)), part(FIRST, F.get(words, j + 1))))
    options = F.when(F.col("n_words") == 1, inside).otherwise(breaks)
    if counts is None:
        best = F.array_min(F.transform(options, lambda o: F.struct(
            (-F.length(o["a"]) - F.length(o["b"])).cast("bigint").alias("weight"), o["place"].alias("place"), o.alias("option"))))
        chosen = entries.withColumn("_best", best)
    else:
        named = lambda side: counts.select(F.col("segment").alias(side), F.col("n").alias(f"n_{side}"))
        tried = entries.select("lf", "phrase", F.explode(options).alias("option")).select(
            "*", F.col("option.a").alias("a"), F.nullif(F.col("option.b"), none).alias("b"))
        met = lookup_join(lookup_join(tried, named("a"), "a", "left", "n_a"), named("b"), "b", "left", "n_b")
        rare = F.least(F.coalesce("n_a", F.lit(0)), F.when(F.col("b").isNotNull(), F.coalesce("n_b", F.lit(0))))
        rank = F.struct(rare.cast("bigint").alias("weight"), F.col("option.place").alias("place"), F.col("option"))
        chosen = entries.join(met.groupBy("lf", "phrase").agg(F.min(rank).alias("_best")), ["lf", "phrase"])
    found = F.col("_best.option")
    n_parts = lambda i: F.size(_segments(F.get(words, i)))
    return chosen.select(
        *entries.columns, found["kind"].alias("kind"), found["place"].alias("place"),
        F.xxhash64(found["kind"], found["a"], found["b"]).alias("key"),
        n_parts(F.lit(0)).alias("n_first"), n_parts(F.col("n_words") - 1).alias("n_last"))


#: Words of an entry up to which places are cut by shifted arrays.
ZIPPED = 4


def anchor_places(words: DataFrame, kinds: Sequence[str], longest: int = 1) -> DataFrame:
    """A row for every place of ``words(doc_id, words)`` where an anchor may be: ``at``, ``seg``, ``key``, ``low``, ``words``.

    No phrase is built here; only the two parts on both sides of a break, or the parts of a word, are hashed. A row
    carries the words from number ``low`` on that an entry of ``longest`` words at most can reach, never the whole text:
    rows of long texts would else grow with the square of their length. Words beyond an end of the text are null or left out.
    """
    if longest <= ZIPPED:
        # whole arrays shifted against each other: no lambda runs for every word
        back = F.array_repeat(F.lit(None).cast("string"), longest - 1)
        shifted = F.concat(back, "words")
        window = [F.slice(shifted, k + 1, F.greatest(F.size(shifted) - k, F.lit(0))).alias(f"w{k}") for k in range(2 * longest)]
        # the first array may be longer than the text: places behind its end go
        zipped = words.select("doc_id", F.posexplode(F.arrays_zip(*window)).alias("at", "near"))
        rows = zipped.where(F.col(f"near.w{longest - 1}").isNotNull()).select(
            "doc_id", "at", F.col(f"near.w{longest - 1}").alias("word"), F.col(f"near.w{longest}").alias("following"),
            (F.col("at") - (longest - 1)).alias("low"), F.array(*[F.col(f"near.w{k}") for k in range(2 * longest - 1)]).alias("words"))
    else:
        low = lambda i: F.greatest(i - (longest - 1), F.lit(0))
        near = F.transform("words", lambda w, i: F.struct(
            i.alias("at"), w.alias("word"), F.get("words", i + 1).alias("following"), low(i).alias("low"),
            F.slice("words", low(i) + 1, i - low(i) + longest).alias("words")))
        rows = words.select("doc_id", F.inline(near))
    at_break = _anchor(BREAK, F.regexp_extract("word", LAST, 0), F.regexp_extract("following", FIRST, 0))
    if list(kinds) == [BREAK]:
        return rows.where("following is not null").select("doc_id", "words", "at", "low", F.lit(0).alias("seg"), at_break.alias("key"))
    key = lambda seg, k: F.struct(seg.alias("seg"), k.alias("key"))
    tried = []
    if BREAK in kinds:
        tried.append(F.when(F.col("following").isNotNull(), F.array(key(F.lit(0), at_break))).otherwise(
            F.array().cast("array<struct<seg:int,key:bigint>>")))
    if LONE in kinds:
        tried.append(F.transform(_segments(F.col("word")), lambda x, i: key(i, _anchor(LONE, x, F.lit("")))))
    if PAIR in kinds:
        tried.append(let(_segments(F.col("word")), lambda seg: F.transform(
            F.slice(seg, 1, F.size(seg) - 1), lambda x, i: key(i, _anchor(PAIR, x, F.get(seg, i + 1))))))
    return rows.select("doc_id", "words", "at", "low", F.inline(F.concat(*tried)))


def _held(met: DataFrame, offset: Column) -> DataFrame:
    """Hits among ``met`` rows: places whose words, from number ``offset`` of the text on, are the whole entry."""
    start = F.col("at") - F.col("place")
    one = F.col("n_words") == 1
    word = lambda i: _segments(F.get("words", start - offset + i))
    first = F.when(one, F.col("seg") - F.col("place")).otherwise(F.size(word(F.lit(0))) - F.col("n_first"))
    start = F.when(one, F.col("at")).otherwise(start)
    placed = met.select("*", start.cast("int").alias("_start"), first.alias("_from")).where("_start >= 0 and _from >= 0")
    parts = lambda i: _segments(F.get("words", F.col("_start") - offset + i))
    end = F.col("n_words") - 1
    # bounds hold for rows that the tests of places drop, too: Spark may compare first
    middle = F.slice("words", F.greatest(F.col("_start") - offset + 2, F.lit(1)), F.greatest(end - 1, F.lit(0)))
    rest = F.when(one, F.array().cast("array<string>")).otherwise(
        F.concat(middle, F.array(F.array_join(F.slice(parts(end), 1, F.col("n_last")), ""))))
    text = F.array_join(F.concat(F.array(F.array_join(F.slice(parts(F.lit(0)), F.greatest(F.col("_from") + 1, F.lit(1)), F.col("n_first")), "")), rest), " ")
    inside = F.col("_start") - offset + end < F.size("words")
    last = F.when(one, F.col("_from") + F.col("n_first")).otherwise(F.col("n_last"))
    return placed.where(inside).where(text == F.col("phrase")).select(
        "doc_id", "lf", F.col("_start").alias("at"), "n_words", F.col("_from").cast("int").alias("first"), last.cast("int").alias("last"), "priority")


def scan(docs: DataFrame, entries: DataFrame, ignore_case: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """``hits(doc_id, lf, at, n_words, first, last, priority)``: every place an entry occurs.

    ``docs(doc_id, text)``; ``entries`` must be staged. Entries are found by their anchors (``with_anchors``): anchors
    of the text meet those of the dictionary by hash, and only there the words are compared with the whole entry. A
    dictionary that fits is broadcast, and the text is not shuffled at all. Of a larger one a Bloom filter goes to the
    text first; what passes it meets the dictionary broadcast in parts (``wide_lookup``). Beyond that it is shuffled
    with the few words around it, anchors that are very frequent split off.
    """
    keyed = stage(with_anchors(entries, counts), "anchors")
    kinds, longest = keyed.agg(F.collect_set("kind"), F.max("n_words")).first()
    text = F.lower("text") if ignore_case else F.col("text")
    words = docs.select("doc_id", tx.split_spaces(text).alias("words"))
    places = anchor_places(words, sorted(kinds) or [BREAK], longest or 1)
    if fits_broadcast(keyed):
        return _held(places.join(F.broadcast(keyed), "key"), F.col("low"))
    near = may_match(places, "key", key_filter(stage(keyed.select("key").distinct(), "keys"), "key"))
    near = near.select("doc_id", "at", "seg", "key", "low", "words")
    rest = [c for c in keyed.columns if c != "key"]
    packed = stage(keyed.groupBy("key").agg(F.collect_list(F.struct(*rest)).alias("_entries")), "packed")
    found = wide_lookup(near, packed.withColumnRenamed("key", "id"), {"_found": "key"}, ["_entries"])
    if found is not None:
        return _held(found.where(F.col("_found").isNotNull()).select(*near.columns, F.inline("_found._entries")), F.col("low"))
    met = lookup_join(stage(near, "anchored"), packed, "key").select(*near.columns, F.inline("_entries"))
    return _held(met, F.col("low"))


def with_form_numbers(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``entries`` with numbers in place of their long forms, and ``forms(id, lf)``, both staged.

    A long form lists all its synonyms; hits that carry it grow with the dictionary, those that carry its number do not.
    """
    forms = stage(number_rows(stage(entries.select("lf").distinct(), "form-names"), ["lf"], "id"), "forms")
    numbered = lookup_join(entries, forms, "lf").drop("lf").withColumnRenamed("id", "lf")
    return stage(numbered.select(*entries.columns), "entries"), forms


def name_forms(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """``rows`` with the long forms that their numbers in ``lf`` stand for; where it can, without moving the rows."""
    found = wide_lookup(rows.withColumnRenamed("lf", "_form"), forms, {"_name": "_form"}, ["lf"])
    if found is None:
        named = lookup_join(rows.withColumnRenamed("lf", "_form"), forms.withColumnRenamed("id", "_form"), "_form")
        return named.select(*rows.columns)
    return found.select(*[F.col("_name.lf").alias("lf") if c == "lf" else F.col(c) for c in rows.columns])


def choose(hits: DataFrame) -> DataFrame:
    """Hits that do not overlap within one document and long form: leftmost, then longest.

    ``(doc_id, lf, kept)`` with the kept places in order.
    """
    place = F.struct("at", "first", "priority", "n_words", "last")
    per_lf = hits.repartition("doc_id").groupBy("doc_id", "lf").agg(F.array_sort(F.collect_list(place)).alias("places"))
    kept_type = "array<struct<at:int,first:int,n_words:int,last:int>>"
    folded = F.aggregate(
        "places",
        F.struct(F.lit(-1).alias("word"), F.lit(0).alias("segment"), F.array().cast(kept_type).alias("kept")),
        lambda acc, p: F.when(
            (p["at"] > acc["word"]) | ((p["at"] == acc["word"]) & (p["first"] >= acc["segment"])),
            F.struct(
                (p["at"] + p["n_words"] - 1).alias("word"),
                p["last"].alias("segment"),
                F.concat(acc["kept"], F.array(F.struct(p["at"], p["first"], p["n_words"], p["last"]))).alias("kept"),
            ),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    return per_lf.select("doc_id", "lf", folded.alias("kept"))


def _trim(words: Column, head: Column | bool, tail: Column | bool) -> Column:
    """Drop a lone symbol at either end of a word list where asked."""
    lone = lambda w: (F.length(w) == 1) & ~w.rlike(r"^[\p{L}\p{N}]$")
    cut_head = F.lit(head) if isinstance(head, bool) else head
    cut_tail = F.lit(tail) if isinstance(tail, bool) else tail
    drop_first = F.when(cut_head & F.coalesce(lone(F.get(words, 0)), F.lit(False)), 1).otherwise(0)
    one = F.slice(words, drop_first + 1, F.size(words))
    drop_last = lambda ws: F.when(
        cut_tail & F.coalesce(lone(F.get(ws, F.size(ws) - 1)), F.lit(False)), 1).otherwise(0)
    return let(one, lambda ws: F.slice(ws, 1, F.greatest(F.size(ws) - drop_last(ws), F.lit(0))))


def word_contexts(docs: DataFrame, chosen: DataFrame, size: int = 20, compat: bool = False) -> DataFrame:
    """``(doc_id, category, lf, at, first, lf_match, context)``: words around each hit.

    The hit itself becomes ``TARGETWORD``. Only slices of the word list are
    touched per hit. ``compat`` cuts short left sides the way a negative list
    start does.
    """
    per_doc = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("lf", "kept")).alias("found"))
    # white space at an end of the text hides a lone symbol there from trimming
    # the text meets its hits before it is cut: an array of its words is about three times as large
    both = docs.select("doc_id", "category", "text").join(per_doc, "doc_id").select(
        "doc_id", "category", "found", tx.split_spaces(F.col("text")).alias("words"),
        F.col("text").rlike(rf"\A{tx.SPACE}").alias("open_head"), F.col("text").rlike(rf"{tx.SPACE}\z").alias("open_tail"))

    def parts(words: Column, p: Column, head_seg: Column, tail_seg: Column) -> Column:
        """The match, and what its first and last word hold on both sides of it."""
        match = F.when(
            p["n_words"] == 1, F.array_join(F.slice(head_seg, p["first"] + 1, p["last"] - p["first"]), "")
        ).otherwise(F.concat_ws(
            " ", F.array_join(F.slice(head_seg, p["first"] + 1, F.size(head_seg)), ""),
            F.when(p["n_words"] > 2, F.array_join(F.slice(words, p["at"] + 2, F.greatest(p["n_words"] - 2, F.lit(0))), " ")),
            F.array_join(F.slice(tail_seg, 1, p["last"]), ""),
        ))
        return F.struct(
            F.array_join(F.slice(head_seg, 1, p["first"]), "").alias("left"), match.alias("match"),
            F.array_join(F.slice(tail_seg, p["last"] + 1, F.size(tail_seg)), "").alias("right"))

    def one(words: Column, lf: Column, p: Column) -> Column:
        end = p["at"] + p["n_words"] - 1
        some = lambda w: F.when(w != "", F.array(w)).otherwise(tx.words_array(()))
        start = F.lit(0) if compat else F.greatest(p["at"] - (size + 2), F.lit(0))
        if compat:
            cut = lambda ws: F.when(F.size(ws) >= size, F.size(ws) - size).otherwise(
                F.greatest(2 * F.size(ws) - size, F.lit(0)))
        else:
            cut = lambda ws: F.greatest(F.size(ws) - size, F.lit(0))
        last_cut = lambda ws: F.slice(ws, cut(ws) + 1, F.size(ws))

        def left(x: Column) -> Column:
            whole = F.concat(F.slice(words, start + 1, p["at"] - start), some(x["left"]))
            return let(let(whole, lambda ws: _trim(ws, (start == 0) & ~F.col("open_head"), True)), last_cut)

        def right(x: Column) -> Column:
            whole = F.concat(some(x["right"]), F.slice(words, end + 2, size + 2))
            ends = (end + size + 3 >= F.size(words)) & ~F.col("open_tail")
            return F.slice(let(whole, lambda ws: _trim(ws, True, ends)), 1, size)

        # the words of the match are cut into parts once a hit
        bound = let(_segments(F.get(words, p["at"])), lambda head: let(
            _segments(F.get(words, end)), lambda tail: parts(words, p, head, tail)))
        return let(bound, lambda x: F.struct(
            lf.alias("lf"), p["at"].alias("at"), p["first"].alias("first"), x["match"].alias("lf_match"),
            F.array_join(F.concat(left(x), F.array(F.lit(tx.TARGET)), right(x)), " ").alias("context")))

    rows = F.flatten(F.transform("found", lambda f: F.transform(f["kept"], lambda p: one(F.col("words"), f["lf"], p))))
    return both.select("doc_id", "category", F.inline(rows))


def long_form_contexts(docs: DataFrame, senses: DataFrame, size: int = 20, compat: bool = False) -> DataFrame:
    """Scan, choose and cut contexts for all long forms of an inventory."""
    entries, forms = with_form_numbers(stage(long_form_entries(senses), "entries"))
    return name_forms(word_contexts(docs, choose(scan(docs, entries)), size, compat), forms)


def paragraph_contexts(docs: DataFrame, chosen: DataFrame, size: int = 1) -> DataFrame:
    """``(doc_id, lf, at, first, context)``: lines around each hit up to the ``size``-th blank line each side.

    Where a side has no more than ``size`` blank lines, the one nearest to
    the hit (left) or farthest from it (right) bounds it, and without any
    blank line the whole side is taken.
    """
    line_break = r"[\n\r\x0b\f\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
    per_doc = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("lf", "kept")).alias("found"))
    split = docs.select(
        "doc_id", tx.split_spaces(F.col("text")).alias("words"),
        F.transform(F.split("text", line_break, -1), lambda x: F.size(tx.split_spaces(x))).alias("sizes"),
    )
    starts = F.aggregate(
        "sizes", F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    )
    both = split.withColumn("starts", starts).join(per_doc, "doc_id")
    nsp = tx.NON_SPACE
    some = lambda w: F.when(w != "", F.array(w)).otherwise(tx.words_array(()))

    def cut_lines(low: Column, high: Column, is_left: bool) -> Column:
        """Words ``low`` to ``high`` (exclusive) as lines; blank lines at the end of the text away from the hit stay."""
        blank_from = (lambda s: s >= low) if is_left else (lambda s: s > low)
        blank_to = (lambda s: s < high) if is_left else (lambda s: s <= high)
        inside = F.filter(
            F.transform("sizes", lambda n, i: F.struct(F.get("starts", i).alias("s"), (F.get("starts", i) + n).alias("e"))),
            lambda x: (x["e"] > low) & (x["s"] < high) | ((x["s"] == x["e"]) & blank_from(x["s"]) & blank_to(x["s"])),
        )
        return F.transform(inside, lambda x: F.array_join(F.slice(
            "words", F.greatest(x["s"], low) + 1, F.greatest(F.least(x["e"], high) - F.greatest(x["s"], low), F.lit(0))), " "))

    def trimmed(out: Column) -> Column:
        lone = lambda w: (F.length(w) == 1) & ~w.rlike(r"^[\p{L}\p{N}]$")
        drop = lambda ws, i, test: F.when(F.coalesce(test(F.get(ws, i)), F.lit(False)), 1).otherwise(0)
        empty = lambda w: w == ""
        head = lambda test: lambda ws: F.slice(ws, drop(ws, F.lit(0), test) + 1, F.size(ws))
        tail = lambda test: lambda ws: F.slice(
            ws, 1, F.greatest(F.size(ws) - drop(ws, F.size(ws) - 1, test), F.lit(0)))
        for cut in (head(lone), head(empty), tail(lone), tail(empty)):
            out = let(out, cut)
        return out

    def blanks(ws: Column) -> Column:
        return F.filter(F.transform(ws, lambda w, i: F.when(~w.rlike(nsp), i)), lambda i: i.isNotNull())

    def left_side(ws: Column) -> Column:
        return let(blanks(ws), lambda b: F.slice(ws, F.when(F.size(b) == 0, F.lit(0)).otherwise(
            F.get(b, F.when(F.size(b) > size, F.size(b) - size).otherwise(F.size(b) - 1)) + 1) + 1, F.size(ws)))

    def right_side(ws: Column) -> Column:
        return let(blanks(ws), lambda b: F.slice(ws, 1, F.when(F.size(b) == 0, F.size(ws)).otherwise(
            F.get(b, F.when(F.size(b) > size, F.lit(size - 1)).otherwise(F.size(b) - 1)))))

    def one(lf: Column, p: Column, before: Column) -> Column:
        end = p["at"] + p["n_words"]
        # the hit before may have taken the white space ahead of this one; its line ends then stay on the left
        taken = F.coalesce(
            (before["at"] + before["n_words"] == p["at"]) & (p["first"] == 0)
            & (before["last"] == F.size(_segments(F.get("words", p["at"] - 1)))), F.lit(False))
        head_seg = _segments(F.get("words", p["at"]))
        tail_seg = _segments(F.get("words", end - 1))
        left_part = F.array_join(F.slice(head_seg, 1, p["first"]), "")
        right_part = F.array_join(F.slice(tail_seg, p["last"] + 1, F.size(tail_seg)), "")
        opens = lambda w: F.array_contains("starts", w)
        glue = lambda a, b: F.concat_ws(" ", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))

        def left_lines(rows: Column) -> Column:
            n = F.size(rows)
            return F.when(taken & opens(p["at"]), F.concat(
                rows, F.array_repeat(F.lit(""), blank_lines(p["at"]) + 1))).when(left_part == "", rows).when(opens(p["at"]) | (n == 0), F.concat(
                rows, F.array_repeat(F.lit(""), blank_lines(p["at"])), some(left_part))).otherwise(
                F.concat(F.slice(rows, 1, F.greatest(n - 1, F.lit(0))), F.array(glue(F.get(rows, n - 1), left_part))))

        def right_lines(rows: Column) -> Column:
            return F.when(right_part == "", rows).when(opens(end) | (F.size(rows) == 0), F.concat(
                some(right_part), F.array_repeat(F.lit(""), blank_lines(end)), rows)).otherwise(
                F.concat(F.array(glue(right_part, F.get(rows, 0))), F.slice(rows, 2, F.size(rows))))

        context = F.concat(
            let(trimmed(let(cut_lines(F.lit(0), p["at"], True), left_lines)), left_side), F.array(F.lit(tx.TARGET)),
            let(trimmed(let(cut_lines(end, F.size("words"), False), right_lines)), right_side))
        return F.struct(lf.alias("lf"), p["at"].alias("at"), p["first"].alias("first"), F.array_join(context, " ").alias("context"))

    def blank_lines(word: Column) -> Column:
        """Blank lines right ahead of the line that opens with ``word``."""
        return F.greatest(F.size(F.filter("starts", lambda x: x == word)) - 1, F.lit(0))

    rows = F.flatten(F.transform("found", lambda f: F.transform(
        f["kept"], lambda p, i: one(f["lf"], p, F.get(f["kept"], i - 1)))))
    return both.select("doc_id", F.inline(rows))


def document_contexts(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``(doc_id, lf, context)``: the whole text of each document an entry occurs in."""
    return docs.select("doc_id", F.col("text").alias("context")).join(hits.select("doc_id", "lf").distinct(), "doc_id")


def attach_counts(labels: DataFrame, contexts: DataFrame, lf: str = "lf") -> DataFrame:
    """Add how many contexts each long form has, 0 when none."""
    counts = contexts.groupBy("lf").agg(F.count(F.lit(1)).alias("count"))
    return labels.join(counts.withColumnRenamed("lf", lf), lf, "left").withColumn(
        "count", F.coalesce("count", F.lit(0).cast("bigint"))
    )


def inventory_stats(counted: DataFrame) -> DataFrame:
    """One row: long forms in all, without and with fewer than five contexts, usable short forms."""
    per_sf = counted.groupBy("sf").agg(
        F.count(F.lit(1)).alias("n_lf"), F.count_if(F.col("count") == 0).alias("n_zero"),
        F.count_if(F.col("count") < 5).alias("n_few"), F.min("count").alias("least"),
    )
    return per_sf.agg(
        F.sum("n_lf").alias("n_lf"), F.sum("n_zero").alias("n_zero"), F.sum("n_few").alias("n_few"),
        F.count_if(F.col("least") > 1).alias("n_viable_sf"),
    )


def viable_senses(counted: DataFrame) -> DataFrame:
    """Rows of the short forms all of whose long forms have more than one context."""
    viable = counted.groupBy("sf").agg(F.min("count").alias("least")).where(F.col("least") > 1)
    return counted.join(sized(viable.select("sf")), "sf", "left_semi")


def label_contexts(contexts: DataFrame, labels: DataFrame) -> DataFrame:
    """Give each context its short form and sense; contexts without a label go."""
    return contexts.join(sized(labels), "lf")


def cap_per_long_form(contexts: DataFrame, keys: Sequence[str], cap: int = 500, seed: int = 0) -> DataFrame:
    """At most ``cap`` contexts of each long form, drawn by hash."""
    drawn = contexts.withColumn("_u", uniform(*keys, seed=seed))
    return first_k_in_group(drawn, ["lf"], ["_u", *keys], cap).drop("_u")


def split_per_long_form(examples: DataFrame, keys: Sequence[str], share: float = 0.8, seed: int = 0) -> DataFrame:
    """Mark ``share`` of each long form as training rows, at least one on each side where two exist."""
    drawn = stage(examples.withColumn("_u", uniform(*keys, seed=seed)), "split")
    sizes = drawn.groupBy("lf").agg(F.count(F.lit(1)).alias("_n"))
    ranked = rank_in_group(drawn, ["lf"], "_u", keys, "_rank").join(sizes, "lf")
    n_train = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    return ranked.withColumn("is_train", F.col("_rank") <= n_train).drop("_u", "_n", "_rank")


def without_documents(notes: DataFrame, used: DataFrame) -> DataFrame:
    """Notes that supplied no mined example."""
    return notes.join(used.select("doc_id").distinct(), "doc_id", "left_anti")


def header_entries(sections: DataFrame) -> DataFrame:
    """Section names with their colon as scan entries."""
    words = tx.split_spaces(F.lower("section"))
    return sections.select(F.concat(F.array_join(words, " "), F.lit(":")).alias("phrase"), F.size(words).alias("n_words")).distinct().select(
        F.lit("").alias("lf"), "phrase", "n_words",
        F.struct((-F.col("n_words")).alias("longest"), (-F.length("phrase")).alias("place")).alias("priority"),
    )


def tokenize_with_headers(contexts: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, tokens)`` of context texts in which known section names become header tokens.

    Names are found by the dictionary scan, longest first. A header directly
    before another header goes, and so do adjacent equal tokens.
    """
    docs = spread(contexts.select(F.col(key).alias("doc_id"), "text"), "doc_id")
    entries = stage(header_entries(sections), "header-entries")
    chosen = choose(scan(docs, entries)).select("doc_id", "kept")
    both = docs.select("doc_id", tx.split_spaces(F.col("text")).alias("words")).join(chosen, "doc_id", "left")
    none = F.array().cast("array<struct<at:int,first:int,n_words:int,last:int>>")
    both = both.withColumn("kept", F.coalesce("kept", none))

    def between(last_word: Column, last_seg: Column, at: Column, first: Column) -> Column:
        """Text behind segment ``last_seg`` of ``last_word`` up to segment ``first`` of word ``at``."""
        seg = lambda i: _segments(F.get("words", i))
        same = F.array_join(F.slice(seg(at), last_seg + 1, F.greatest(first - last_seg, F.lit(0))), "")
        spread_out = F.concat_ws(
            " ", F.array_join(F.slice(seg(last_word), last_seg + 1, F.greatest(F.size(seg(last_word)), F.lit(0))), ""),
            F.array_join(F.slice("words", last_word + 2, F.greatest(at - last_word - 1, F.lit(0))), " "),
            F.coalesce(F.array_join(F.slice(seg(at), 1, first), ""), F.lit("")),
        )
        return F.when(last_word == at, same).otherwise(spread_out)

    body = lambda text: F.struct(F.lit(False).alias("is_header"), text.alias("text"))
    clean_name = lambda p: F.regexp_replace(F.array_join(F.concat(
        F.array(let(_segments(F.get("words", p["at"])), lambda seg: F.array_join(F.slice(seg, p["first"] + 1, F.when(
            p["n_words"] == 1, p["last"] - p["first"]).otherwise(F.size(seg))), ""))),
        F.slice("words", p["at"] + 2, F.greatest(p["n_words"] - 2, F.lit(0))),
        F.when(p["n_words"] > 1, F.array(F.array_join(F.slice(_segments(F.get("words", p["at"] + p["n_words"] - 1)), 1, p["last"]), "")))
        .otherwise(tx.words_array(())),
    ), " "), ":$", "")
    head = lambda p: F.struct(F.lit(True).alias("is_header"), clean_name(p).alias("text"))
    n = F.size("kept")
    pieces = F.flatten(F.transform("kept", lambda p, i: F.array(
        body(F.when(i == 0, between(F.lit(-1), F.lit(0), p["at"], p["first"])).otherwise(
            let(F.get("kept", i - 1), lambda q: between(q["at"] + q["n_words"] - 1, q["last"], p["at"], p["first"])))),
        head(p),
    )))
    tail = F.when(n == 0, F.array_join("words", " ")).otherwise(
        let(F.get("kept", n - 1), lambda q: between(q["at"] + q["n_words"] - 1, q["last"], F.size("words"), F.lit(0))))
    filled = F.filter(F.concat(pieces, F.array(body(tail))), lambda x: x["is_header"] | x["text"].rlike(tx.NON_SPACE))
    rows = both.select("doc_id", filled.alias("pieces"))
    tokens = F.flatten(F.transform("pieces", lambda x, i: F.when(
        x["is_header"] & F.coalesce(F.get("pieces", i + 1)["is_header"], F.lit(False)), tx.words_array(()))
        .when(x["is_header"], F.array(tx.section_token(x["text"])))
        .otherwise(tx.tokenize(tx.clean(F.upper(x["text"]), collapse=False)))))
    return rows.select(F.col("doc_id").alias(key), tx.drop_adjacent_duplicates(tokens).alias("tokens"))


def header_marks(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """``(doc_id, at, header)``: known section headers by the number of words ahead of their body."""
    pieces = docs.select("doc_id", F.posexplode(tx.split_keeping(F.col("text"), tx.HEADER_WHOLE)).alias("piece_no", "piece"))
    order = Window.partitionBy("doc_id").orderBy("piece_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    glued = F.col("piece").rlike(rf"^{tx.NON_SPACE}") & F.lag("piece").over(order).rlike(rf"{tx.NON_SPACE}$")
    counted = pieces.withColumn("glued", F.coalesce(glued, F.lit(False))).withColumn(
        "at", F.sum(F.size(tx.split_spaces(F.col("piece"))) - F.when(F.col("glued"), 1).otherwise(0)).over(upto)
    )
    names = counted.where(F.col("piece_no") % 2 == 1).select(
        "doc_id", F.col("at").cast("int").alias("at"),
        F.btrim(F.btrim(F.upper(F.regexp_extract("piece", tx.HEADER, 1))), F.lit(":")).alias("section"),
    )
    known = names.join(sized(sections.select("section")), "section")
    return known.select("doc_id", "at", tx.section_token(F.col("section")).alias("header"))


def finish_examples(examples: DataFrame, tokens: DataFrame, headers: DataFrame, senses: DataFrame, window: int = 10) -> DataFrame:
    """Final example table: trimmed window, section, sense ordinal; unusable and repeated rows go.

    ``examples(row_idx, doc_id, at, lf, sf, ...)`` meets its ``tokens(row_idx,
    tokens)`` and the section headers of its document. A row is valid when the
    target is exactly one token. The section is the nearest header left of the
    target, else the last one in the document before it, else padding.
    """
    from notelens.operators.windows import last_before, nearest_headers, window_around

    target = F.lit(tx.TARGET.lower())
    hits = F.filter(F.transform("tokens", lambda t, i: F.when(t == target, i)), lambda i: i.isNotNull())
    valid = tokens.withColumn("hits", hits).where(F.size("hits") == 1).withColumn("target_at", F.get("hits", 0)).drop("hits")
    rows = examples.join(valid, "row_idx").withColumn("near", nearest_headers(F.col("tokens"), F.col("target_at")))
    found = last_before(headers, rows, "doc_id", "at", "header", tx.PAD)
    around = window_around(
        F.col("tokens"), F.col("target_at"), window,
        F.coalesce(F.col("near.left") + 1, F.lit(0)), F.coalesce(F.col("near.right"), F.size("tokens")),
    )
    done = found.select(
        "row_idx", "doc_id", "category", "sf", F.col("lf").alias("target_lf"), "is_train",
        F.when(F.size(around) == 0, F.lit(tx.PAD)).otherwise(F.array_join(around, " ")).alias("trimmed_tokens"),
        F.array_join("tokens", " ").alias("tokenized_context"),
        F.coalesce(F.get("tokens", F.col("near.left")), F.col("header")).alias("section"),
    )
    ordinal = senses.select("sf", F.col("lf").alias("target_lf"), F.col("lf_idx").alias("target_lf_idx"))
    labelled = done.join(sized(ordinal), ["sf", "target_lf"])
    rest = [c for c in labelled.columns if c not in ("target_lf", "tokenized_context")]
    first = labelled.groupBy("target_lf", "tokenized_context").agg(F.min_by(F.struct(*rest), "row_idx").alias("row"))
    return first.select("row.*", "target_lf", "tokenized_context")
