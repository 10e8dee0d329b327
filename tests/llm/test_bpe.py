import random

import numpy as np
import public_tokenizers
import pytest
from corpusflow.llm import bpe, pretoken
from tests.llm.conftest import document_rows
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def table():
    return bpe.WordBpe(PATH)


def test_verified_guesses_equal_exact_merging(table):
    draw = random.Random(5)
    pieces = [t.replace("</w>", "") for t in table.ids]
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(1, 12))) for _ in range(3000)]
    words += [w for w in ("".join(draw.choice(pieces) for _ in range(2)) for _ in range(3000)) if w.isascii() and w]
    assert table.encode_words(words) == [table.exact(table.spelled(w)) for w in words]


def test_incompatible_pairs_are_found(table):
    pairs = np.array(list(table.merged), dtype=np.int64)
    assert not table.compatible(pairs[:, 0], pairs[:, 1]).any()


def test_equals_the_library(spark, awkward):
    library = Tokenizer.from_file(PATH)
    extra = ["Ᲊ newer letter", "á combining", "İstanbul", "日本語 テキスト", "<|startoftext|><|endoftext|>", "x" * 500, "😀😀 1234 '''s"]
    texts = [r[1] for r in document_rows()] + extra
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], dtype="<u4").tolist() == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_settled_letters_are_classified_alike():
    library = Tokenizer.from_file(PATH)
    for code in [*range(0x20, 0x3000, 7), *range(0x1C80, 0x1C90), *range(0xA7C0, 0xA7E0)]:
        text = f"a{chr(code)}b {chr(code)}1"
        if pretoken.settled(text):
            assert library.normalizer.normalize_str(text).replace(" ", "") == "".join(pretoken.lowered(text).split())


def test_empty_table(nothing):
    assert bpe.decode(bpe.encode(nothing, PATH), PATH).count() == 0
