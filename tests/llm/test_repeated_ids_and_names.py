"""Rows that repeat an id with another text, and columns whose names operators use themselves."""

import random
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from lumenflow.llm import decontaminate, minhash


def plain_components(rows, k, percent):
    """(doc_id, words) -> (set size, smallest id reachable), where all texts of an id but those without words hang together."""
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(brute.words(t) and tuple(brute.words(t)) or ("", i), []).append(i)
    nodes = {n: (w, ids) for n, (w, ids) in enumerate(texts.items())}
    sets, found = {}, brute.near_duplicates([(n, " ".join(w) if w[0] else "") for n, (w, _) in nodes.items()], k, percent)
    group = {n: c for n, (_, c) in found.items()}
    changed = True
    while changed:  # groups that share an id become one
        changed = False
        of = defaultdict(set)
        for n, (w, ids) in nodes.items():
            for i in ids if w[0] else ():
                of[i].add(group[n])
        for own in of.values():
            if len(own) > 1:
                group = {n: min(own) if c in own else c for n, c in group.items()}
                changed = True
                break
    least = defaultdict(lambda: 1 << 62)
    for n, c in group.items():
        least[c] = min(least[c], *nodes[n][1])
    for n, (w, ids) in nodes.items():
        for i in ids:
            sets[i, w] = (found[n][0], least[group[n]])
    return sets


def key(i, t):
    w = tuple(brute.words(t))
    return i, w or ("", i)


@pytest.mark.parametrize("sent", [10**6, 0])
def test_links_of_rows_that_repeat_an_id(spark, monkeypatch, sent):
    monkeypatch.setattr(minhash, "SENT_IDS", sent)
    rng = random.Random(11)
    base = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(30)) for _ in range(60)) for _ in range(30)]
    rows = []
    for i in range(160):
        words = rng.choice(base).split()
        if rng.random() < 0.7:
            words[rng.randrange(60)] = "changed" + str(rng.randrange(3))
        rows.append((rng.randrange(60), " ".join(words)))
    w, v, u = base[0] + " w", base[1] + " v", base[2]
    rows += [(1000, w), (1000, v), (1001, w + " x"), (1002, v + " y"), (1003, v + " y"), (1004, u), (1004, u), (1004, None), (None, w), (1005, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    want = plain_components(rows, 4, 80)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == Counter((i, *want[key(i, t)]) for i, t in rows if i is not None)
    comp = {(r.doc_id): r.component_id for r in got}
    assert comp[1002] == comp[1003] == comp[1001]  # by way of the two texts of 1000
    kept = minhash.near_duplicate_filter(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t in rows if i is None or want[key(i, t)][1] == i)


def test_filters_take_columns_of_any_name(spark):
    names = ["gone", "GONE_", "bad", "found", "text_digest", "digest", "rep", "own", "key", "__bad", "__found", "__gone"]
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, text), (2, text + " more"), (3, "nothing of that kind here at all"), (None, text), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    near = minhash.near_duplicate_filter(docs, 5, 80)
    assert near.columns == docs.columns and sorted((r.doc_id or 0) for r in near.collect()) == [0, 1, 3, 4]
    bench = spark.createDataFrame([(7, text)], "item_id long, text string").withColumns({n: F.lit(1) for n in names})
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted((r.doc_id or 0) for r in clean.collect()) == [0, 3, 4]
