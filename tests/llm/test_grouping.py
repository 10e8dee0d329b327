import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from corpusflow.llm import grouping
from corpusflow.llm.grouping import Bins, crossed, evolve, first_people, fresh
from tests.llm.conftest import document_rows
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(person: Bins, lengths: list[int], size: int) -> bool:
    """Each piece in one window, no window over its size."""
    fits = all(sum(lengths[p] for p in pieces) == fill <= size for pieces, fill in zip(person.bins, person.fills))
    return fits and sorted(p for pieces in person.bins for p in pieces) == list(range(len(lengths)))


def test_children_are_whole_and_keep_the_injected_windows():
    draw = random.Random(4)
    for _ in range(30):
        lengths = [draw.randint(1, 100) for _ in range(draw.randint(1, 80))]
        orders = [draw.sample(range(len(lengths)), len(lengths)) for _ in range(2)]
        a, b = (fresh(order, lengths, 100) for order in orders)
        child = crossed(a, b, lengths, 100, draw)
        assert whole(a, lengths, 100) and whole(b, lengths, 100) and whole(child, lengths, 100)
        good = {frozenset(p) for p, f in zip(b.bins, b.fills) if f >= sum(b.fills) / len(b.fills)}
        old = {frozenset(p) for p in a.bins}
        assert all(any(kept <= set(p) for p in child.bins) for kept in good & {frozenset(p) for p in child.bins} | old & {frozenset(p) for p in child.bins})


def test_evolution_reaches_the_least_number_where_decreasing_best_fit_does_not():
    # Windows of known perfect packings: sums of random parts are exactly the size.
    better, draw = 0, random.Random(7)
    for seed in range(6):
        lengths = []
        for _ in range(40):
            cuts = sorted(draw.sample(range(1, 1000), 2))
            lengths += [cuts[0], cuts[1] - cuts[0], 1000 - cuts[1]]
        people = first_people(lengths, 1000, random.Random(seed))
        end = evolve(people, lengths, 1000, 200, random.Random(seed))
        assert whole(end[0], lengths, 1000) and len(end[0].bins) <= len(people[0].bins)
        better += len(end[0].bins) < len(people[0].bins) or end[0].fitness > max(p.fitness for p in people)
    assert better


def test_islands_place_every_piece_once(spark):
    draw = random.Random(2)
    lengths = [draw.choice([draw.randint(1, 64), draw.randint(1, 20), 64]) for _ in range(900)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "row long, length long").repartition(3)
    rows = grouping.place(pieces, 64, group=150).collect()
    assert sorted(r["row"] for r in rows) == list(range(900))
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append(r)
    for number, found in windows.items():
        found.sort(key=lambda r: r["offset"])
        sizes = [lengths[r["row"]] for r in found]
        assert [r["offset"] for r in found] == np.cumsum([0, *sizes])[:-1].tolist() and sum(sizes) <= 64
        assert number == min(r["row"] for r in found)
    assert len(windows) <= -(-sum(lengths) // 64) + 2
    # Pieces over half a window fit with none of their kind: more levels end.
    wide = spark.createDataFrame([(i, 40) for i in range(400)], "row long, length long")
    assert grouping.place(wide, 64, group=50).select("sequence_id").distinct().count() == 400


def test_pieces_give_back_every_document(spark, awkward, nothing):
    library = Tokenizer.from_file(PATH)
    rows = grouping.pack(awkward, PATH, 64).collect()
    by_length = defaultdict(int)
    for doc_id, text, *_ in document_rows():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = (len(ids) - 1) % 64 + 1
        for n, start in enumerate([0, *range(first, len(ids), 64)]):
            piece = ids[start : start + 64] if n else ids[:first]
            by_length[doc_id, n, start, zlib.crc32(piece.tobytes())] += 1
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        by_length[r["doc_id"], r["piece"], r["start"], zlib.crc32(r["ids"])] -= 1
    assert not any(by_length.values())
    seen = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == seen[r["sequence_id"]]
        seen[r["sequence_id"]] += r["length"]
    assert max(seen.values()) <= 64 and len(seen) <= -(-sum(r["length"] for r in rows) // 64) + 1
    assert grouping.pack(nothing, PATH).count() == 0
