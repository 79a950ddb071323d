import unicodedata

import pytest
from conftest import rows

from lorekeep.llm.skeleton import LOOK_ALIKES, Prototypes, look_alike_classes, look_alike_pairs, published_look_alikes, skeleton, skeletons


@pytest.mark.parametrize(("a", "b"), [
    ("Report ready", "Rероrt rеаdу"), ("café", "café"), ("ABC 123", "ＡＢＣ １２３"), ("a b", "a b"), ("a b", "a　b"), ("word", "wo​rd﻿"),
    ("soft", "so­ft"), ("file", "ﬁle"), ("Kelvin", "Kelvin"), ("nów", "о".join(["n", "́w"])), ("A B", "Α Β"), ("x̣́", "x̣́"),
])
def test_same_to_a_reader(a, b):
    assert a != b and skeleton(a) == skeleton(b)


@pytest.mark.parametrize(("a", "b"), [("Word", "word"), ("cafe", "café"), ("v1", "v2"), ("l1", "ll"), ("O0", "OO"), ("a b", "ab"), ("a b", "a  b"), ("дом", "том"), ("naïve", "naive"), ("rn", "m"), ("a\nb", "a b"), ("x²", "x2"), ("H₂O", "H2O"), ("①", "1"), ("½", "1/2")])
def test_different_to_a_reader(a, b):
    assert skeleton(a) != skeleton(b)


def test_table_is_stable():
    assert len(LOOK_ALIKES) <= 200
    for c in LOOK_ALIKES:
        assert skeleton(skeleton(c)) == skeleton(c) and not unicodedata.normalize("NFKD", c).isascii()


def test_published_classes_give_letters_of_the_same_case(spark):
    known = published_look_alikes(spark)
    assert len(known) > len(LOOK_ALIKES) + 100 and known.items() >= LOOK_ALIKES.items()
    for c, to in known.items():
        if c not in LOOK_ALIKES:
            assert to.isascii() and to.isalpha() and (c.isupper() <= to.isupper()) and (c.islower() <= to.islower())
    protos = Prototypes(known)
    assert skeleton("\u13aa\u13be \u03c3ne", protos) == "GO one".replace("GO", skeleton("\u13aa\u13be", protos))  # Cherokee, Greek
    assert [skeleton(x, protos) for x in ("l1I0O", "дом", "том", "straße")] == ["l1I0O", skeleton("дом", protos), skeleton("том", protos), "straße"]
    assert skeleton("дом", protos) != skeleton("том", protos)


def test_forms_of_all_texts(spark):
    df = frame(spark, [(1, "abc"), (2, "аbс"), (3, None), (4, " "), (5, "\uff41bc\u200b")])
    assert rows(skeletons(df), "doc_id", "skeleton") == [(1, "abc"), (2, "abc"), (5, "abc")]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in texts], "doc_id long, text string, text_hash string, class_id int")


def test_pairs_and_classes(spark):
    texts = [(1, "abc"), (2, "аbс"), (3, "abc"), (4, None), (5, "  "), (6, "​  "), (7, "ABC"), (8, ""), (9, "ａbc"), (None, "abc"), (10, "z" * 200_000), (11, "z" * 199_999 + "ｚ"), (12, "x"), (13, "x")]
    df = frame(spark, [*texts, *texts[:3]])
    assert rows(look_alike_pairs(df)) == [(1, 2), (1, 9), (2, 3), (2, 9), (3, 9), (10, 11)]
    assert rows(look_alike_classes(df).distinct(), "doc_id", "class_id") == [(1, 1), (2, 1), (3, 1), (9, 1), (10, 10), (11, 10)]
    assert {r["doc_id"] for r in skeletons(df).collect()} == {1, 2, 3, 7, 9, 10, 11, 12, 13}


def test_empty(spark):
    assert look_alike_pairs(frame(spark, [])).count() == 0
