import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.operators import chunks as C
from corpusflow.operators import examples as E


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", column(F.col("t"))).collect())]


def test_sentences(spark):
    texts = ["One. Two!  Three?\nFour\n\n Five ", "v1.2 stays", "", None, "..."]
    assert values(spark, texts, X.sentences) == [["One.", "Two!", "Three?", "Four", "Five"], ["v1.2 stays"], [], [], ["..."]]


def test_tokens(spark):
    assert values(spark, ["Été 2x, don't", None], X.tokens) == [["été", "2x", "don", "t"], []]


def test_s_stem(spark):
    words = ["ponies", "zombeies", "movies", "boxes", "shoes", "trees", "cats", "bus", "glass", "s", "run"]
    want = ["pony", "zombeie", "movy", "boxe", "shoe", "tree", "cat", "bus", "glass", "", "run"]
    assert values(spark, words, X.s_stem) == want


# Examples from the published description of the algorithm.
PORTER = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor
sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz
failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form
formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow
inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ
angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll""".split()


def test_porter(spark):
    pairs = dict(zip(PORTER[::2], PORTER[1::2]))
    assert {w: X.porter(w) for w in pairs} == pairs
    assert X.porter("été") == "été" and X.porter("is") == "is"
    assert values(spark, list(pairs), X.porter_stem) == list(pairs.values())


def reference_cut(text, n):
    raw = text.encode()[:n]
    return raw.decode(errors="ignore").encode()


@pytest.mark.parametrize("n", [4, 5, 16])
def test_byte_vectors(spark, n):
    texts = ["", "abc", "abcé", "abéé", "a😀", "😀😀😀😀😀", "x" * 40, "aé" * 20, "ab\x00"]
    vectors = values(spark, texts, lambda c: X.byte_encode(c, n))
    assert all(len(v) == n for v in vectors)
    assert [bytes(v).rstrip(b"\0") for v in vectors] == [reference_cut(t, n).rstrip(b"\0") for t in texts]
    decoded = values(spark, texts, lambda c: X.byte_decode(X.byte_encode(c, n)))
    assert decoded == [reference_cut(t, n).decode().rstrip("\0") for t in texts]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"], blacklist_characters="\x00"), max_size=40), min_size=20, max_size=40))
def test_byte_round_trip(spark, texts):
    assert values(spark, texts, lambda c: X.byte_decode(X.byte_encode(c, 200))) == texts


def test_char_embedding(spark):
    got = values(spark, ["hello world", "hello world", "ab", None], lambda c: X.char_embedding(c, 16))
    assert got[0] == got[1] and abs(sum(v * v for v in got[0]) - 1) < 1e-9
    assert got[2] == got[3] == [0.0] * 16


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "A. B."), (2, ""), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in C.sentence_chunks(docs).collect()] == [(1, 0, "A.", 1.0), (1, 1, "B.", 1.0)]
    assert C.unary_chunks(docs).count() == 3
    rows = spark.createDataFrame([(1, '{"data": "X. Y."}'), (2, "{broken"), (3, '{"other": 1}')], "doc_id long, payload string")
    assert [r["text"] for r in C.json_chunks(rows).orderBy("offset").collect()] == ["X.", "Y."]


def test_pad_and_batches(spark):
    df = spark.createDataFrame([(i, list(range(i + 1))) for i in range(5)], "id long, cells array<int>")
    rows = C.pad_to_batch(C.batch_ids(df, ["id"], 2), "batch_id", "cells").collect()
    assert {r["id"]: len(r["padded"]) for r in rows} == {0: 2, 1: 2, 2: 4, 3: 4, 4: 5}
    assert {r["id"]: r["padded"] for r in rows}[2] == [0, 1, 2, 0]
    got = C.batches(df, ["id"], 2, ["id"]).orderBy("batch_id").collect()
    assert [(r["n"], r["id"]) for r in got] == [(2, [0, 1]), (2, [2, 3]), (1, [4])]


def test_map_batches(spark):
    got = C.map_batches(spark.range(10), lambda pdf: pdf.assign(y=pdf["id"] * 2), "id long, y long")
    assert got.agg(F.sum("y")).first()[0] == 90


def test_train_records(spark):
    lines = [
        '{"Query": "q", "Candidate": "c", "Label": 1}', '{"Query": "q", "Candidate": "c", "Label": "0.5"}',
        '{"Query": "q", "Label": 1}', '{"Query": "q", "Candidate": "c", "Label": "x"}', "oops",
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "id int, value string")
    good, bad = E.parse_train_records(df)
    assert sorted((r["id"], r["label"]) for r in good.collect()) == [(0, 1.0), (1, 0.5)]
    assert sorted(r["value"] for r in bad.collect()) == sorted(lines[2:])


def test_examples_and_labels(spark):
    df = spark.createDataFrame([("a", "b", "yes"), ("c", "d", "what")], "x string, y string, z string")
    three = E.examples(df, ["x", "y", "z"])
    assert [tuple(r) for r in three.collect()] == [("a", "b", "yes"), ("c", "d", "what")]
    assert E.examples(df, ["x", "z"]).first()["text_b"] is None
    known, unknown = E.index_labels(three, ["no", "yes"])
    assert [r["label_index"] for r in known.collect()] == [1] and unknown.count() == 1
    typed, rejected = E.numeric_labels(spark.createDataFrame([("1.5",), ("x",)], "label string"))
    assert typed.first()["target"] == 1.5 and rejected.count() == 1


@pytest.mark.parametrize("left", [True, False])
def test_sequence_features(spark, left):
    df = spark.createDataFrame(
        [(1, "a b c", "x y"), (2, "a b", None), (3, "a", "p q r s t u v w"), (4, "", "")], "id int, text_a string, text_b string"
    )
    vocab = E.vocabulary(df.filter("id < 3").fillna(""), ["text_a", "text_b"])
    ids = {r["term"]: r["term_id"] for r in vocab.collect()}
    assert ids == {"a": 4, "b": 5, "c": 6, "x": 7, "y": 8}
    rows = {r["id"]: r for r in E.sequence_features(df, "id", vocab, 7, left, "xlnet").collect()}
    assert all(len(r[c]) == 7 for r in rows.values() for c in ("input_ids", "attention_mask", "token_type_ids"))
    # Seven places: three marks, both tokens of b, and so two of a.
    assert rows[1]["input_ids"] == [2, 4, 5, 3, 7, 8, 3] and rows[1]["token_type_ids"] == [0, 0, 0, 0, 1, 1, 1]
    padded = [2, 4, 5, 3]
    assert rows[2]["input_ids"] == ([0] * 3 + padded if left else padded + [0] * 3)
    assert rows[2]["token_type_ids"] == ([4] * 3 + [0] * 4 if left else [0] * 4 + [4] * 3)
    assert rows[3]["input_ids"] == [2, 3, 1, 1, 1, 1, 3]
    assert sum(rows[4]["attention_mask"]) == 3
