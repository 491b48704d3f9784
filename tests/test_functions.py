"""Golden literals and edge cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from lexweft.functions import scoring, vectors
from lexweft.functions import text as tx

# Inputs whose results must equal the ones that existing reports hold.
A = "This is a sample text with several words"
B = "This is another sample text with more words than the first one"
X, Y = (0.5, 0.3, 0.2, 0.1), (0.4, 0.4, 0.1, 0.1)
NAMES = ("abdul-baha_wisdom_paris_talks", "wisdom_abdul_baha_paris_talks_processed")
OTHER_NAMES = ("some_other_document", "totally_different_file")
PHRASES = ("3. Tablet of the Seven Questions", "Título original en inglés: Epistle to the Son of the Wolf")


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_golden_values(spark):
    v = lambda x: F.array(*[F.lit(i) for i in x])
    a, b = F.lit(A), F.lit(B)
    r = one(spark, ca=tx.char_length(a), cb=tx.char_length(b), wa=tx.word_count(a), wb=tx.word_count(b), l=tx.length_similarity(a, b), w=tx.word_similarity(a, b), c=vectors.cosine(v(X), v(Y)), f=tx.filename_similarity(*map(F.lit, NAMES)), other=tx.filename_similarity(*map(F.lit, OTHER_NAMES)), j=tx.word_jaccard(*map(F.lit, PHRASES)))
    assert (r.ca, r.cb, r.wa, r.wb) == (40, 62, 8, 12)
    assert r.l == pytest.approx(0.6451612903) and r.w == pytest.approx(0.6666666667) and r.c == pytest.approx(0.9611613137)
    assert r.f == pytest.approx(5 / 6) and r.other == 0.0 and r.j == pytest.approx(2 / 14)
    s = one(spark, s=scoring.composite(F.lit(0.85), F.lit(r.l), F.lit(r.w))).s
    assert s == pytest.approx(0.7917741935)


def test_empty_texts(spark):
    r = one(spark, both=tx.length_similarity(F.lit(""), F.lit("")), one=tx.length_similarity(F.lit(""), F.lit("x")), words=tx.word_count(F.lit("")), jaccard=tx.word_jaccard(F.lit(""), F.lit(" ")))
    assert (r.both, r.one, r.words, r.jaccard) == (1.0, 0.0, 0, 1.0)


@pytest.mark.parametrize("blank", ["\u0085", " ", " ", "　", "\t", "\n"])
def test_unicode_blanks_split_words(spark, blank):
    assert one(spark, w=tx.word_count(F.lit(f"one{blank}two"))).w == 2


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    r = one(spark, c=vectors.cosine(v(3, 4), v(6, 8)), zero=vectors.cosine(v(0, 0), v(1, 0)), size=vectors.cosine(v(1, 2), v(1, 2, 3)))
    assert r.c == pytest.approx(1.0) and r.zero == 0.0 and r.size == 0.0


def test_filename_similarity(spark):
    r = one(spark, near=tx.filename_similarity(F.lit("red-fox_den"), F.lit("den red_fox tail")), far=tx.filename_similarity(F.lit("alpha-beta"), F.lit("gamma_delta")), case=tx.filename_similarity(F.lit("A"), F.lit("a")))
    assert r.near == pytest.approx(3 / 4) and r.far == 0.0 and r.case == 0.0


def test_prompt_is_cut_at_a_character(spark):
    p = one(spark, p=tx.prompt(F.lit("é" * 3000), "document")).p
    assert p == "search_document: " + "é" * 1991 and len(p.encode()) == 3999
    assert one(spark, p=tx.prompt(F.lit("x"), "query")).p == "search_query: x"


def test_prompt_keeps_a_replacement_character(spark):
    """A text's own U+FFFD before the cut stays; only a character that the cut would split goes."""
    for end, left in (("\ufffd", 3 * 5), ("\ufffd\U0001f600", 3 * 5), ("é", 2 * 5)):
        room = 4000 - len("search_document: ") - left + (1 if end[-1] == "\U0001f600" else 0)
        text = "x" * room + end * 40
        got = one(spark, p=tx.prompt(F.lit(text), "document")).p
        full = ("search_document: " + text).encode()
        assert got.encode() == full[: len(got.encode())] and 3997 <= len(got.encode()) <= 4000 and len(full) > 4000


def test_leading_text(spark):
    df = spark.createDataFrame([("q", i, f"t{i}") for i in reversed(range(40))] + [("q", None, None)], "k string, pos int, text string")
    assert df.groupBy("k").agg(tx.leading_text(F.col("pos"), F.col("text")).alias("t")).first().t == " ".join(f"t{i}" for i in range(30))
