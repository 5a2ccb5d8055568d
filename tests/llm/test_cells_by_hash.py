"""Suffix-array dedup: which bytes are sent and sorted, step by step in one process."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from lumenflow.llm import suffix_dedup
from lumenflow.llm.blocks import wire


def split(tables, column):
    whole = pa.concat_tables([*tables, wire([])])
    keys = np.asarray(whole.column(column))
    return {int(k): whole.filter(pa.array(keys == k)) for k in np.unique(keys)}


def steps(rows, blocks=3, common=2000):
    """Result rows, and MB of cells that were sent to be sorted."""
    own = {b: pa.table({"doc_id": pa.array([i for i, _ in rows[b::blocks]], pa.int64()), "text": [t for _, t in rows[b::blocks]]}) for b in range(blocks)}
    key, none = lambda k: (pa.scalar(k, pa.int32()),), wire([])
    anchors = split([suffix_dedup._anchors(blocks)(key(b), t) for b, t in own.items()], "key")
    shared = split([suffix_dedup._shared(common)(key(k), t) for k, t in anchors.items()], "block")
    cells = split([suffix_dedup._cells(2 * blocks)(key(b), t, shared.get(b, none)) for b, t in own.items()], "key")
    wanted = split([suffix_dedup._wanted(key(k), t) for k, t in cells.items()], "block")
    given = split([suffix_dedup._given(key(b), t, wanted.get(b, none)) for b, t in own.items()], "key")
    told = split([suffix_dedup._sorted(key(k), t, given.get(k, none)) for k, t in cells.items()], "block")
    done = pa.concat_tables([suffix_dedup._removed(key(b), t, told.get(b, none)) for b, t in own.items()])
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in done.to_pylist()}
    return out, sum(len(c or b"") for t in given.values() for c in t.column("c").to_pylist())


def prose(rng, n, syllables="th er on an in re ed nd"):
    return " ".join("".join(rng.choice(syllables.split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def equal(out, rows):
    import hashlib

    assert {i: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for i, x in out.items()} == brute.remove_repeats(rows)


def test_copies_are_not_sorted():
    """Whole copies have one cell for each anchor, whose windows are equal by its hash."""
    rng = random.Random(1)
    texts = [prose(rng, 60) for _ in range(8)]
    rows = [(i, texts[i % 8]) for i in range(32)]
    out, sent = steps(rows)
    equal(out, rows)
    assert sent < 100 and all(x[3] == b"" for i, x in out.items() if i >= 8)


def test_single_windows_are_not_sorted():
    """Windows of a very common anchor are equal by their hashes, and their bytes stay where they are."""
    rng = random.Random(2)
    line = prose(rng, 14)
    rows = [(i, f"{prose(rng, 12)} {line} {prose(rng, 12)}") for i in range(40)]
    out, sent = steps(rows, common=1)
    equal(out, rows)
    assert sent == 0 < steps(rows)[1]


def test_few_bytes_for_chance():
    """Texts of a few syllables hardly share grams of 24 bytes unless they share a passage."""
    rng = random.Random(3)
    rows = [(i, prose(rng, 250, "th er on an")) for i in range(100)]
    out, sent = steps(rows)
    equal(out, rows)
    assert sent < 0.15 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize(("size", "common"), [(1, 2000), (300, 2000), (300, 3)])
def test_sorting_part_by_part(monkeypatch, size, common):
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", size)
    rng = random.Random(4)
    passages = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (49, 50, 51, 80, 300)]
    rows = [(i * 7 % 90, "".join(rng.choice(passages) if rng.random() < 0.5 else prose(rng, rng.randrange(20)) for _ in range(rng.randrange(6)))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, "aaaa" * 60), (203, "a" * 100), (204, "ab" * 70)]
    out, _ = steps(rows, common=common)
    equal(out, rows)


def test_anchors_of_many_documents():
    """More documents in a block than the fast way numbers."""
    fp = np.array([7, 7, 9, 7, 2**48 - 1, 2**48 - 1, 9], np.uint64)
    doc = np.array([0, 3, 3, 3, 1, 2, 3], np.uint64)
    for far in (0, 1 << 16):
        anchors, docs = suffix_dedup.docs_of_anchors(fp, doc + np.uint64(far))
        assert anchors.tolist() == [7, 9, 2**48 - 1] and docs.tolist() == [2, 1, 2]
