import random
import re
import string

import pytest
from pyspark.sql import functions as F

from notelens.functions import text as tx
from notelens.operators import vocabulary as vo


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "text string").select(fn(F.col("text")).alias("x")).first().x


@pytest.mark.parametrize("text,names", [
    ("HPI: this patient. Social History : smoker", ["HPI"]),
    ("a\nPlan Notes: rest\n    12. Exam: x", ["PLAN NOTES", "EXAM"]),
    ("x Plan: no", []),
    ("A: too short", []),
])
def test_headers(spark, text, names):
    assert one(spark, text, tx.section_headers) == names


@pytest.mark.parametrize("text,cleaned", [
    ("a.b", "a DIGITPARSED b"),
    ("3.5mg", " DIGITPARSED 5mg"),
    ("see [**Name 12**] now", "see now"),
    ("a_b*c?d/e(f)", "a b c d e f "),
    ("x  \n\t y", "x y"),
])
def test_clean(spark, text, cleaned):
    assert one(spark, text, tx.clean) == cleaned


def test_tokenize_matches_plain_python(spark):
    rng = random.Random(3)
    alphabet = "abÉ ß.,;-'\"( )\t\n \x1c9_"
    rows = [("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))),) for _ in range(300)]
    got = spark.createDataFrame(rows, "text string").select("text", tx.tokenize(F.col("text"), ["a", "b"]).alias("t")).collect()
    for text, tokens in got:
        words = [w.strip(string.punctuation) for w in text.lower().split()]
        assert tokens == [w for w in words if w and w not in ("a", "b")], text


def test_split_keeping_matches_plain_python(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice("aab1,2") for _ in range(rng.randint(0, 20))),) for _ in range(200)]
    got = spark.createDataFrame(rows, "text string").select("text", tx.split_keeping(F.col("text"), "([0-9]+)").alias("t")).collect()
    for text, pieces in got:
        assert pieces == re.split("([0-9]+)", text)


def test_two_headers_on_one_line(spark):
    text = "HPI: Social History: smoker\nPlan Notes: rest"
    pieces = lambda compat: [p.body for p in one(spark, text, lambda c: tx.note_pieces(c, compat)) if not p.is_empty]
    assert pieces(False) == ["HPI:", " Social History: smoker", "Plan Notes:", " rest"]
    assert "HPI:" not in pieces(True)


def test_sentence_tags(spark):
    assert one(spark, "one a. two b. three c", lambda c: tx.sentence_tokens(c)) == [
        "one", "a", "header=SENTENCE", "two", "b", "three", "c"]


def test_adjacent_duplicates(spark):
    assert one(spark, "a a b a a", lambda c: tx.drop_adjacent_duplicates(F.split(c, " "))) == ["a", "b", "a"]


def test_long_form_cleaning(spark):
    row = spark.createDataFrame([("AA - Amino acids;Aa;amino acids procedure;Z (nos)", "AA")], "lf string, sf string")
    assert row.select(tx.clean_long_form(F.col("lf"), F.col("sf")).alias("x")).first().x == "amino acids;z"


def test_subsampling_order_of_steps(spark):
    """Against a plain restatement that walks the stream word by word."""
    rng = random.Random(5)
    words = ["header=A", "header=B", "w", "v", "u", "rare"]
    rows, counts = [], {}
    for doc in range(120):
        stream = ["document=C"] + [rng.choice(words) for _ in range(rng.randint(0, 15))]
        for pos, token in enumerate(stream):
            rows.append((doc, pos, token))
            counts[token] = counts.get(token, 0) + 1
    tokens = spark.createDataFrame(rows, "doc_id long, pos int, token string").withColumn("kind", tx.token_kind(F.col("token")))
    table = vo.token_counts(tokens)
    kept = {(r.doc_id, r.pos) for r in vo.kept_words(tokens, table, 1, 0.05).collect()}
    floor = counts["rare"] + 1
    got = [(r.doc_id, r.pos) for r in vo.subsample(tokens, table, 1, 0.05).orderBy("doc_id", "pos").collect()]
    by_doc = {}
    for doc, pos, token in rows:
        by_doc.setdefault(doc, []).append(token)
    want = []
    for doc, stream in by_doc.items():
        last = None
        for pos, token in enumerate(stream):
            if token == last:
                continue
            if token.startswith("header="):
                if pos + 1 < len(stream) and not stream[pos + 1].startswith("header="):
                    want.append((doc, pos))
            elif (doc, pos) in kept:
                want.append((doc, pos))
            else:
                continue
            last = token
    assert got == want and floor > 0


def test_long_form_tokens(spark):
    senses = spark.createDataFrame([("Stroke;stroke, NOS;stroke cerebral",), ("nos;procedure",)], "lf string")
    got = {(r.lf[:3], r.token) for r in vo.long_form_tokens(senses, tx.LF_NOISE_WORDS).collect()}
    assert got == {("Str", "stroke"), ("Str", "cerebral"), ("nos", "nos"), ("nos", "procedure")}


def test_labelled_file_keeps_pipes_quotes_and_line_ends(spark, tmp_path):
    from notelens.sources import files as fi

    rows = [("RA", "rheumatoid arthritis", 4, "HPI", 'the "RA" is | big'), ("RA", "right atrium", 0, "", 'a "quoted"\nsecond | line'),
            ("RA", None, 0, "", "x")]
    fi.write_labelled(spark.createDataFrame(rows, fi.LABELLED_SCHEMA), str(tmp_path / "labelled"))
    assert sorted(r.context for r in fi.read_labelled(spark, str(tmp_path / "labelled")).collect()) == sorted(r[4] for r in rows[:2])


def test_inventory_files(spark, tmp_path):
    from notelens.sources import files as fi

    senses = [("RA", 0, "right atrium"), ("RA", 1, "room air"), ("PT", 0, "physical therapy;patient")]
    fi.write_inventory(spark.createDataFrame(senses, "sf string, lf_idx int, lf string"), str(tmp_path / "lines"))
    assert sorted(map(tuple, fi.read_inventory(spark, str(tmp_path / "lines")).collect())) == sorted(senses)
    (tmp_path / "one.json").write_text('{"RA": ["right atrium",\n "room air"],\n "PT": ["physical therapy;patient"]}')
    assert sorted(map(tuple, fi.read_inventory(spark, str(tmp_path / "one.json"), one_object=True).collect())) == sorted(senses)
