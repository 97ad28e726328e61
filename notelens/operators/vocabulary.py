"""Section lists, tokenized notes, token counts, subsampling, vocabularies, id streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelens.functions import text as tx
from notelens.functions.hashing import uniform
from notelens.operators.scale import carry_last, lookup_join, number_rows, running_total, sized, stage

#: Order of the kinds in a vocabulary.
KIND_RANK = {"pad": 0, "token": 1, "section": 2, "category": 3}


#: Steps of the uniforms that draw ids.
DRAW_STEPS = float(1 << 52)


def section_frequency(notes: DataFrame, min_count: int = 10, text: str = "text") -> DataFrame:
    """``sections(section, count)``: header names seen at least ``min_count`` times."""
    return (
        notes.select(F.explode(tx.section_headers(F.col(text))).alias("section"))
        .groupBy("section")
        .agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("count") >= min_count)
    )


def tokenize_notes(
    notes: DataFrame,
    sections: DataFrame,
    stopwords: Sequence[str] = (),
    split_sentences: bool = False,
    compat: bool = False,
) -> DataFrame:
    """``docs(doc_id, category, tokens)``: one token array per note.

    Pieces are joined to the section list by name, so the list may be of any
    size; the pieces of a note come together again in one grouping by
    ``doc_id``, whose partitioning later windows over documents reuse. On the
    way the words of a piece are one text, a third of what an array of short
    words takes.
    """
    pieces = notes.select(
        "doc_id", "category", F.posexplode_outer(tx.note_pieces(F.col("text"), compat)).alias("piece_no", "piece")
    ).select("doc_id", "category", "piece_no", "piece.*")
    known = sections.select(F.col("section").alias("name"), F.col("count").alias("seen"))
    pieces = lookup_join(pieces, known, "name", "left", weight="seen")
    body = F.col("body")
    words = tx.tokenize(tx.clean(body, collapse=False), stopwords)
    running = tx.sentence_tokens(body, stopwords) if split_sentences else words
    nothing = tx.words_array(())
    tokens = (
        F.when(body.isNull() | F.col("is_empty"), nothing)
        .when(F.col("is_header") & F.col("seen").isNotNull(), F.array(tx.section_token(F.col("name"))))
        .when(F.col("is_header"), words)
        .otherwise(running)
    )
    # no token is empty or holds white space, so a tab parts them
    part = F.struct("piece_no", F.array_join(tokens, "\t").alias("words"))
    again = lambda p: F.struct(p["piece_no"].alias("piece_no"), F.array_remove(F.split(p["words"], "\t"), "").alias("tokens"))
    return (
        pieces.select("doc_id", "category", part.alias("part"))
        .groupBy("doc_id")
        .agg(F.first("category").alias("category"), F.collect_list("part").alias("parts"))
        .select("doc_id", "category", F.array_sort(F.transform("parts", again)).alias("parts"))
        .select(
            "doc_id",
            "category",
            F.concat(F.array(tx.document_token(F.col("category"))), F.flatten("parts.tokens")).alias("tokens"),
        )
    )


def token_rows(docs: DataFrame) -> DataFrame:
    """``tokens(doc_id, pos, token, kind)``: one row per token."""
    return docs.select("doc_id", F.posexplode("tokens").alias("pos", "token")).withColumn(
        "kind", tx.token_kind(F.col("token"))
    )


def sentence_rows(docs: DataFrame) -> DataFrame:
    """Sentences of sentence-tagged notes: metadata tokens dropped, two tokens at least."""
    mark = f"{tx.HEADER_PREFIX}{tx.SENTENCE_HEADER}"
    joined = F.array_join("tokens", " ")
    sentence = F.posexplode(F.split(joined, mark, -1)).alias("sentence_no", "sentence")
    words = F.filter(
        tx.split_spaces(F.col("sentence")), lambda t: ~tx.is_section_token(t) & ~tx.is_document_token(t)
    )
    return (
        docs.select("doc_id", sentence)
        .select("doc_id", "sentence_no", words.alias("words"))
        .where(F.size("words") > 1)
        .select("doc_id", "sentence_no", F.array_join("words", " ").alias("sentence"))
    )


def token_counts(tokens: DataFrame) -> DataFrame:
    """``counts(token, kind, count)``."""
    return tokens.groupBy("token", "kind").agg(F.count(F.lit(1)).alias("count"))


def counts_with_total(tokens: DataFrame) -> DataFrame:
    """Token counts plus one row (null token) for all non-metadata tokens, in one pass."""
    total = F.sum(F.when(F.col("kind") == "token", 1).otherwise(0))
    return (
        tokens.rollup("token")
        .agg(F.count(F.lit(1)).alias("n"), total.alias("n_plain"), F.grouping("token").alias("is_total"))
        .select("token", F.when(F.col("is_total") == 1, F.col("n_plain")).otherwise(F.col("n")).alias("count"))
    )


def keep_probability(share: Column, threshold: float) -> Column:
    """Chance to keep a word that makes up ``share`` of the corpus."""
    ratio = share / F.lit(threshold)
    return F.least((F.sqrt(ratio) + 1) * (F.lit(threshold) / share), F.lit(1.0))


def kept_words(
    tokens: DataFrame, counts: DataFrame, min_count: int, threshold: float, seed: int = 0
) -> DataFrame:
    """Rows that survive the frequency floor and subsampling, and all metadata rows.

    ``counts`` must be staged. The draw of a position depends on the position
    and the seed only.
    """
    total = counts.where(F.col("kind") == "token").agg(F.sum("count")).first()[0] or 1
    chances = counts.where((F.col("kind") != "token") | (F.col("count") >= min_count)).select(
        "token",
        F.col("count").alias("seen"),
        F.when(F.col("kind") == "token", keep_probability(F.col("count") / F.lit(float(total)), threshold))
        .otherwise(F.lit(2.0))
        .alias("keep_p"),
    )
    joined = lookup_join(tokens, chances, "token", "inner", weight="seen")
    # uniforms are below 1: no draw where the chance is certain
    return joined.where((F.col("keep_p") >= 1) | (uniform("doc_id", "pos", seed=seed) < F.col("keep_p")))


def subsample(
    tokens: DataFrame, counts: DataFrame, min_count: int = 10, threshold: float = 0.001, seed: int = 0
) -> DataFrame:
    """``tokens(doc_id, pos, token, kind)`` after the corpus clean-up.

    Headers without a following word are dropped, rare and subsampled words go,
    and a token equal to the last surviving one goes. Empty headers still
    separate equal words.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("pos")
    follower = F.lead("kind").over(by_doc)
    empty = (F.col("kind") == "section") & (F.coalesce(follower, F.lit("section")) == "section")
    kept = kept_words(tokens.withColumn("is_empty", empty), counts, min_count, threshold, seed)
    previous = F.lag("token").over(by_doc)
    return (
        kept.withColumn("previous", previous)
        .where(F.col("previous").isNull() | (F.col("previous") != F.col("token")))
        .where(~F.col("is_empty"))
        .select("doc_id", "pos", "token", "kind")
    )


def build_vocabulary(tokens: DataFrame) -> DataFrame:
    """``vocab(id, token, support, kind)`` of a cleaned stream.

    Id 0 pads; words follow by first appearance, then sections and categories
    by name. Metadata and padding carry the supports 0 and 1.
    """
    first = F.min(F.struct("doc_id", "pos")).alias("first")
    entries = stage(tokens.groupBy("token", "kind").agg(F.count(F.lit(1)).alias("n"), first), "vocab-entries")
    words = entries.where(F.col("kind") == "token").select(
        "token", F.col("n").alias("support"), "kind", "first.doc_id", "first.pos"
    )
    n_words = words.count()
    words = number_rows(words, ["doc_id", "pos"], "id", 1)
    out = words.select("id", "token", "support", "kind")
    start = 1 + n_words
    for kind in ("section", "category"):
        meta = entries.where(F.col("kind") == kind).select("token", F.lit(0).cast("bigint").alias("support"), "kind")
        numbered = number_rows(meta, ["token"], "id", start)
        out = out.unionByName(numbered.select("id", "token", "support", "kind"))
        start += meta.count()
    pad = tokens.sparkSession.range(1).select(
        F.col("id"), F.lit(tx.PAD).alias("token"), F.lit(1).cast("bigint").alias("support"), F.lit("pad").alias("kind")
    )
    return pad.unionByName(out)


def token_ids(tokens: DataFrame, vocab: DataFrame, unknown: int = -1) -> DataFrame:
    """Look up ids; words outside the vocabulary get ``unknown``. ``vocab`` must be staged."""
    keys = vocab.select("token", "id")  # no support as weight: that of sections and categories is 0 by construction
    return lookup_join(tokens, keys, "token", "left").withColumn(
        "id", F.coalesce("id", F.lit(unknown).cast("bigint")))


def id_stream(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """``ids(doc_id, pos, gpos, id, kind)``: positions count inside the note and over the corpus.

    Fails when a token has no positive id.
    """
    found = token_ids(tokens, vocab)
    checked = found.withColumn(
        "id", F.when(F.col("id") > 0, F.col("id")).otherwise(F.raise_error(F.lit("token without id")).cast("bigint"))
    )
    by_doc = Window.partitionBy("doc_id").orderBy("pos")
    placed = checked.withColumn("rank", (F.row_number().over(by_doc) - 1).cast("bigint"))
    sizes = stage(tokens.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc-sizes")
    offsets = running_total(sizes, ["doc_id"], F.col("n"), "offset").select("doc_id", "offset")
    return placed.join(offsets, "doc_id").select(
        "doc_id", F.col("rank").alias("pos"), (F.col("offset") + F.col("rank")).alias("gpos"), "id", "token", "kind"
    )


def sampling_distribution(vocab: DataFrame, power: float = 0.75) -> DataFrame:
    """``(id, p)``: chance of each word to be drawn as a negative; padding never is."""
    mass = F.when(F.col("kind") == "pad", F.lit(0.0)).otherwise(F.pow(F.col("support").cast("double"), power))
    masses = vocab.select("id", mass.alias("mass"))
    total = masses.agg(F.sum("mass")).first()[0] or 1.0
    return masses.select("id", (F.col("mass") / F.lit(total)).alias("p"))


def cumulative(dist: DataFrame) -> DataFrame:
    """``(id, lo, hi)``: the slice of [0, 1) that draws each id. ``dist`` must be staged.

    Chances are added up as whole numbers of 2^-52, the steps of the uniforms, so every slice ends where the next one
    begins, however many buckets the sum is cut into.
    """
    units = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("p") * F.lit(DRAW_STEPS)).cast("bigint"))
    positive = dist.where(F.col("p") > 0).withColumn("units", units)
    summed = running_total(positive, ["id"], F.col("units"), "before")
    return summed.select(
        "id", (F.col("before") / F.lit(DRAW_STEPS)).alias("lo"), ((F.col("before") + F.col("units")) / F.lit(DRAW_STEPS)).alias("hi"))


def weighted_draw(draws: DataFrame, slices: DataFrame, u: str, name: str) -> DataFrame:
    """Turn uniforms into ids: the slice with ``lo <= u < hi``.

    A range join turned into an equality join: slices and draws meet in cells
    of [0, 1) that hold about one slice each. Draws spread evenly over the
    cells whatever the weights are. ``slices`` must be staged.
    """
    n = slices.count()
    cells = max(1, n)
    bounds = slices.agg(F.max_by("id", "hi")).first()[0]
    last = F.lit(cells - 1).cast("bigint")
    open_end = slices.withColumn("hi", F.when(F.col("id") == bounds, F.lit(2.0)).otherwise(F.col("hi")))
    cell = F.explode(
        F.sequence(
            F.least(F.floor(F.col("lo") * cells), last), F.least(F.floor(F.col("hi") * cells), last)
        )
    ).alias("_cell")
    table = sized(open_end.select(F.col("id").alias(name), "lo", "hi", cell))
    keyed = draws.withColumn("_cell", F.least(F.floor(F.col(u) * cells), last))
    return keyed.join(table, "_cell").where((F.col(u) >= F.col("lo")) & (F.col(u) < F.col("hi"))).drop(
        "_cell", "lo", "hi"
    )


def alias_table(dist: DataFrame) -> DataFrame:
    """``(cell, id, cut, other)``: as many cells of equal mass as ids; a cell is its id's up to ``cut``, then another one's.

    ``dist(id, p)`` must be staged. Masses are whole numbers whose sum the number of cells divides. Ids below a cell's mass
    lack something, the others have something over; both are added up along the ids. An id that lacks is filled by the one
    over whose stretch its own begins, wholly. Where that takes more than the stretch, the filler's own cell is filled
    by the next one over. So each cell has two ids at most, and all of it is running totals and as-of lookups: no
    queue of ids is worked off one by one.
    """
    positive = dist.where(F.col("p") > 0).select("id", "p")
    n, whole = positive.agg(F.count(F.lit(1)), F.sum("p")).first()
    if not n:
        return positive.select(F.lit(0).cast("bigint").alias("cell"), "id", F.lit(1.0).alias("cut"), F.col("id").alias("other"))
    mass = (1 << 52) // n
    total = mass * n
    units = F.floor(F.col("p") / F.lit(whole) * F.lit(total * (1 - 1e-9))).cast("bigint")
    numbered = stage(number_rows(stage(positive.withColumn("units", units), "masses"), ["id"], "cell"), "cells")
    left = total - numbered.agg(F.sum("units")).first()[0]
    own = F.col("units") + F.lit(left // n) + F.when(F.col("cell") < left % n, 1).otherwise(0)
    cells = numbered.select("id", "cell", own.cast("bigint").alias("own"))
    lack, over = F.greatest(F.lit(mass) - F.col("own"), F.lit(0)), F.greatest(F.col("own") - F.lit(mass), F.lit(0))
    lacking = running_total(stage(cells.where(F.col("own") < mass), "lacking"), ["cell"], lack, "at")
    having = running_total(stage(cells.where(F.col("own") >= mass), "having"), ["cell"], over, "at")
    lacking = stage(lacking.select("id", "cell", "own", "at", (F.col("at") + lack).alias("end")), "lacking")
    having = stage(having.select("id", "cell", "own", "at", (F.col("at") + over).alias("end")), "having")
    # ids over come first at equal places when they fill, so that the last one that begins there does
    none = F.lit(None).cast(cells.schema["id"].dataType)
    fill = having.select("at", F.lit(0).alias("kind"), "cell", "id", F.col("id").alias("filler"), "own").unionByName(
        lacking.select("at", F.lit(1).alias("kind"), "cell", "id", none.alias("filler"), "own"))
    filled = carry_last(stage(fill, "fill"), ["at", "kind", "cell"], "filler", "other").where("kind = 1")
    # how far the last one reaches that began before an id's end
    reach = having.select(F.col("end").alias("at"), F.lit(0).alias("kind"), "cell", "id", F.lit(None).cast("bigint").alias("reached")).unionByName(
        lacking.select("at", F.lit(1).alias("kind"), "cell", "id", F.col("end").alias("reached")))
    reached = carry_last(stage(reach, "reach"), ["at", "kind", "cell"], "reached", "most").where("kind = 0")
    following = carry_last(having.select("cell", "id"), [F.desc("cell")], "id", "other").select("cell", "other")
    taken = F.greatest(F.coalesce("most", F.lit(0)) - F.col("at"), F.lit(0))
    share = lambda x: x / F.lit(float(mass))
    return filled.select("cell", "id", share(F.col("own")).alias("cut"), "other").unionByName(
        reached.join(following, "cell").select("cell", "id", share(F.lit(mass) - taken).alias("cut"), F.coalesce("other", "id").alias("other")))


def alias_draw(draws: DataFrame, table: DataFrame, u: str, name: str) -> DataFrame:
    """Turn uniforms into ids by a staged ``alias_table``: every draw meets exactly one row, and draws spread evenly over them."""
    n = table.count()
    at = F.col(u) * F.lit(n)
    keyed = draws.withColumn("_cell", F.least(F.floor(at), F.lit(n - 1)).cast("bigint")).withColumn("_in", at - F.col("_cell"))
    cells = sized(table.select(F.col("cell").alias("_cell"), F.col("id").alias("_own"), F.col("cut").alias("_cut"), F.col("other").alias("_other")))
    found = F.when(F.col("_in") < F.col("_cut"), F.col("_own")).otherwise(F.col("_other"))
    return keyed.join(cells, "_cell").withColumn(name, found).drop("_cell", "_in", "_own", "_cut", "_other")


def frequency_export(vocab: DataFrame, special: Sequence[str] = ("<S>", "</S>", "<UNK>")) -> DataFrame:
    """``(line_no, line)``: special lines, then words by falling support. ``vocab`` must be staged."""
    words = vocab.where(F.col("kind") == "token")
    ordered = number_rows(words, [F.desc("support"), "id"], "line_no", len(special)).select(
        "line_no", F.col("token").alias("line")
    )
    head = vocab.sparkSession.range(1).select(
        F.posexplode(tx.words_array(special)).alias("line_no", "line")
    ).select(F.col("line_no").cast("bigint").alias("line_no"), "line")
    return head.unionByName(ordered)


def extend_vocabulary(vocab: DataFrame, new_tokens: DataFrame) -> DataFrame:
    """Add unseen tokens behind the last id, by name, with support 0. ``vocab`` must be staged."""
    unseen = stage(new_tokens.select("token").distinct().join(vocab.select("token"), "token", "left_anti"), "unseen")
    start = (vocab.agg(F.max("id")).first()[0] or 0) + 1
    added = number_rows(unseen, ["token"], "id", start).select(
        "id", "token", F.lit(0).cast("bigint").alias("support"), F.lit("token").alias("kind")
    )
    return vocab.select("id", "token", "support", "kind").unionByName(added)


def split_vocabulary(vocab: DataFrame) -> DataFrame:
    """Separate word ids from metadata ids; metadata is numbered from 1 again, in id order."""
    first_meta = vocab.where(F.col("kind").isin("section", "category")).agg(F.min("id")).first()[0] or 0
    is_meta = F.col("kind").isin("section", "category")
    return vocab.select(
        F.when(is_meta, F.lit("metadata")).otherwise(F.lit("token")).alias("part"),
        F.when(is_meta, F.col("id") - F.lit(first_meta) + 1).otherwise(F.col("id")).alias("id"),
        "token",
        "support",
    )


def merge_vocabularies(external: DataFrame, vocab: DataFrame, special: Sequence[str]) -> DataFrame:
    """Distinct standardized external tokens, our metadata tokens and the number marker."""
    pieces = external.select(tx.standardize_entry(F.col("token"), special).alias("token"))
    meta = vocab.where(F.col("kind").isin("section", "category")).select("token")
    marker = vocab.sparkSession.range(1).select(F.lit(tx.DIGIT_TOKEN.lower()).alias("token"))
    return pieces.unionByName(meta).unionByName(marker).distinct()


def stop_words(stops: DataFrame, kept: DataFrame) -> DataFrame:
    """(stop words ∪ punctuation ∪ extras − math symbols) − kept words, each a ``word`` column."""
    spark = stops.sparkSession
    marks = [c for c in tx.PUNCTUATION] + tx.EXTRA_STOPS
    extra = spark.range(1).select(F.explode(tx.words_array(marks)).alias("word"))
    out = stops.select("word").union(extra).distinct()
    return out.where(~F.col("word").isin(tx.MATH_SYMBOLS)).join(kept.select("word").distinct(), "word", "left_anti")


def long_form_tokens(senses: DataFrame, blacklist: Sequence[str], vocab: DataFrame | None = None, most: int = 5) -> DataFrame:
    """``(lf, token, rank)``: the words of all synonyms of a sense, at most ``most``, commonest first.

    Blacklisted words and words outside ``vocab`` count only when nothing else is left.
    """
    synonym = F.explode(F.split("lf", ";")).alias("synonym")
    words = senses.select("lf").distinct().select("lf", synonym).select("lf", F.explode(tx.tokenize(F.col("synonym"))).alias("token"))
    counted = words.groupBy("lf", "token").agg(F.count(F.lit(1)).alias("n"))
    good = ~F.col("token").isin(list(blacklist) or [""])
    if vocab is not None:
        counted = lookup_join(counted, vocab.select("token", F.col("id").alias("_id")), "token", "left")
        good = good & F.col("_id").isNotNull()
    counted = counted.withColumn("good", good)
    by_lf = Window.partitionBy("lf")
    usable = counted.withColumn("any_good", F.max("good").over(by_lf)).where(F.col("good") | ~F.col("any_good"))
    rank = F.row_number().over(by_lf.orderBy(F.desc("n"), "token"))
    return usable.withColumn("rank", rank).where(F.col("rank") <= most).select("lf", "token", "rank")
