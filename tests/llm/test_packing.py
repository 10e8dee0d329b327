import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from corpusflow.llm import packing
from tests.llm.conftest import document_rows
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("size,open_windows,slack", [(64, 4, 2), (2048, 32, 32)])
def test_pieces_give_back_every_document(spark, size, open_windows, slack):
    library = Tokenizer.from_file(PATH)
    texts = [r[1] for r in document_rows()] + [f"some words {i} " * (i % 23) for i in range(150)] + ["Ᲊ <|endoftext|> x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = packing.pack(docs, PATH, size, open_windows, slack).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in enumerate(texts):
        expected = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        found = sorted(pieces[i], key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in found) == expected
        assert all(r["doc_tokens"] == len(expected) // 4 for r in found)
        assert [r["start"] for r in found] == np.cumsum([0, *[r["length"] for r in found]])[:-1].tolist()
    short = 0
    for found in sequences.values():
        found.sort(key=lambda r: r["offset"])
        total = 0
        for r in found:
            assert r["offset"] == total
            total += r["length"]
        assert total <= size
        short += total < size - slack
    assert short <= 1


def test_windows_place_best_fit_and_emit_the_fullest():
    out = []
    windows = packing.Windows(10, 2, 1, out.append)
    ids = lambda n: b"\0" * (4 * n)
    windows.place("a", 0, ids(6), 6)
    windows.place("b", 0, ids(7), 7)
    windows.place("c", 0, ids(3), 3)  # fits the second exactly, the first with room to spare
    assert [[p[0] for p in w] for w in out] == [["b", "c"]]
    windows.place("d", 0, ids(9), 9)
    windows.place("e", 0, ids(8), 8)  # none fits: the fullest (d) goes as it is
    assert [p[0] for p in out[1]] == ["d"] and [[p[0] for p in w] for w in windows.left()] == [["e"], ["a"]]


def test_awkward_rows(awkward, nothing):
    rows = packing.pack(awkward, PATH).collect()
    assert sum(r["length"] == r["doc_tokens"] == 1 for r in rows) >= 2  # null and empty texts are the end alone
    assert {r["doc_id"] for r in rows} == {r[0] for r in document_rows()}
    assert all(zlib.crc32(r["ids"]) >= 0 and len(r["ids"]) == 4 * r["length"] for r in rows)
    assert packing.pack(nothing, PATH).count() == 0
