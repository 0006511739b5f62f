import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonarloom.llm.forms import CYRILLIC, GREEK, MAPPING, consistent, consistent_form, form_digest, same_reading

SAME = [("ｆｕｌｌ　ｗ", "full w"), ("café", "café"), ("a​b﻿", "ab"), ("a b c d", "a b c d"), ("Сору", "Copy"), ("ΑΒο", "ABo"), ("е́", "é"), ("ё", "ë"), ("각", "각"), ("e​́", "é"), ("ﾊﾟ", "パ"), ("⁠", "")]
OTHER = [("A", "a"), ("1", "2"), ("café", "cafe"), ("a b", "ab"), ("a  b", "a b"), ("a\r\nb", "a\nb"), ("a\tb", "a b"), ("Λ", "A"), ("д", "g")]


@pytest.mark.parametrize("a,b", SAME)
def test_reads_the_same(a, b):
    assert consistent(a) == consistent(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_stays_different(a, b):
    assert consistent(a) != consistent(b)


ALPHABET = "aeo \n" + "".join(CYRILLIC)[:9] + "".join(GREEK)[:5] + "́̈​‍　Ａｅé각각가ﾊﾟﾞё☃😀"


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=12), st.text(ALPHABET, max_size=6))
def test_against_whole_text_rules(a, b):
    """The transducer equals mapping the decomposed text until nothing changes, in whichever form a text comes."""

    def brute(text):
        while True:
            new = unicodedata.normalize("NFC", "".join(MAPPING.get(x, x) for ch in text for x in (ch if ch in MAPPING else unicodedata.normalize("NFD", ch))))
            if new == text:
                return new
            text = new

    for text in (a, a + b):
        assert consistent(text) == brute(text)
        assert consistent(consistent(text)) == consistent(text)
        assert consistent(unicodedata.normalize("NFC", text)) == consistent(unicodedata.normalize("NFD", text))


def test_mapping_has_no_chains():
    assert all(MAPPING.get(x, x) == x for to in MAPPING.values() for x in to)


def test_columns(spark):
    texts = ["plain", "ｗ", "", None, "é" * 50_000 + "​"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(consistent_form(F.col("text")), form_digest(F.col("text")) == F.md5(consistent_form(F.col("text")))).collect()
    assert [r[0] for r in rows] == [None if t is None else consistent(t) for t in texts]
    assert [r[1] for r in rows] == [True, True, True, None, True]


def test_pairs_against_brute_force(spark):
    texts = ["Copy", "Сopy", "Copy", "ｃopy", "copy", "copy ", "copy ", "", "​", None, None, "Copy\n"]
    docs = [(i, t, "x", i) for i, t in enumerate(texts)]
    want = {(i, j) for i, s, *_ in docs for j, t, *_ in docs if i < j and s is not None and t is not None and s != t and consistent(s) == consistent(t)}
    classes, pairs = same_reading(spark.createDataFrame(docs, "doc_id long, text string, form string, id int"))
    assert {tuple(r) for r in pairs.collect()} == want and classes.count() == 10
    assert same_reading(spark.createDataFrame([], "doc_id long, text string"))[1].count() == 0


@pytest.mark.parametrize("a,b", [("\u0501\u04cf\u04c0\u0475\u0474", "dlIvV"), ("\u03f9\u037f", "CJ"), ("\u0477", "v\u030f"), ("\u0501", "d")])
def test_letters_identical_to_latin_ones(a, b):
    assert consistent(a) == consistent(b) and consistent(a) != consistent(b.swapcase())


def test_many_copies_and_variants(spark, monkeypatch):
    """Half of all rows are copies of one text: links are made between texts, and copies are spread."""
    monkeypatch.setattr("sonarloom.operators.skew.LEAST", 10)
    texts = ["Copy"] * 60 + ["Сopy"] * 30 + ["ｃopy", "ｃоpy", "Сοpy"] + ["other"] * 20 + [f"Cо{'​' * k}py" for k in range(15)]
    docs = list(enumerate(texts))
    want = {(i, j) for i, s in docs for j, t in docs if i < j and s != t and consistent(s) == consistent(t)}
    got = [tuple(r) for r in same_reading(spark.createDataFrame(docs, "doc_id long, text string"))[1].collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("a,b", [("ϜϺ", "FM"), ("a\U000e0100", "a"), ("ㅤaᅟﾠ", "a")])
def test_more_letters_and_fillers(a, b):
    assert consistent(a) == consistent(b)
