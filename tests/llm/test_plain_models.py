"""Fitted models against plain versions of themselves, and what guards the fast way of token counts."""

import json
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow.llm import lang_id, quality, queries, token_counts

SCHEMA = "doc_id long, text string"


def plain_slots(text):
    """Slots of all n-grams of a text's bytes, n-gram by n-gram."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return [int(s) for slot, n in lang_id.gram_slots(data) for s in slot[: max(len(data) - n + 1, 0)]]


def plain_model(rows):
    sums = {}
    for lang, text in rows:
        if lang is not None and text is not None:
            own = sums.setdefault(lang, [0.0] * lang_id.SLOTS)
            for s in plain_slots(text):
                own[s] += 1
    names = sorted(sums)
    total = {x: sum(sums[x]) + 0.5 * lang_id.SLOTS for x in names}
    share = {x: [(v + 0.5) / total[x] for v in sums[x]] for x in names}
    code = lang_id.codewords(len(names))
    weights = []
    for b in range(code.shape[1]):
        yes, no = ([share[x] for x, c in zip(names, code[:, b], strict=True) if (c > 0) == side] for side in (True, False))
        weights.append([math.log(sum(y) / len(yes)) - math.log(sum(n) / len(no)) for y, n in zip(zip(*yes, strict=True), zip(*no, strict=True), strict=True)])
    leads = []
    for b, w in enumerate(weights):
        margins = [sum(s * v for s, v in zip(share[x], w, strict=True)) * code[k, b] for k, x in enumerate(names)]
        leads.append(min(max(min(margins), 1e-3), 1.0))
    return names, code, weights, [v / sum(leads) * min(4, code.shape[1]) for v in leads]


def test_language_as_a_plain_model(spark):
    rng = random.Random(3)
    words = {"en": "the of and house water light never", "de": "der und haus wasser licht niemals für", "fr": "le et maison eau lumière jamais où"}
    rows = [(lang, " ".join(rng.choice(w.split()) for _ in range(rng.randrange(1, 30)))) for lang, w in words.items() for _ in range(25)] + [(None, "the the"), ("en", None)]
    model = lang_id.train_language(spark.createDataFrame(rows, "lang string, text string"))
    names, code, weights, bits = plain_model(rows)
    assert list(model.languages) == names and np.allclose(model.weights, np.array(weights).T, atol=1e-4) and np.allclose(model.bit_weights, bits, rtol=1e-3)
    texts = [" ".join(rng.choice(words[rng.choice(list(words))].split()) for _ in range(rng.randrange(0, 12))) for _ in range(60)] + ["", "123 4", None, "é"]
    got = {r.doc_id: r for r in lang_id.identify_language(spark.createDataFrame(list(enumerate(texts)), SCHEMA), model).collect()}
    for i, t in enumerate(texts):
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        slots = plain_slots(t)
        margins = [sum(w[s] for s in slots) / max(len(slots), 1) for w in weights]
        loss = [sum(v * math.log1p(math.exp(-model.sharpness * m * code[k, b])) for b, (m, v) in enumerate(zip(margins, bits, strict=True))) for k in range(len(names))]
        belief = [math.exp(min(loss) - x) for x in loss]
        best = max(belief) / sum(belief)
        assert math.isclose(got[i].score, best, rel_tol=1e-2) and (got[i].lang_pred == names[loss.index(min(loss))] or sorted(belief)[-2] > 0.98 * max(belief))


@pytest.mark.parametrize("size", [3000, 12])
def test_quality_features_as_plain(spark, monkeypatch, size):
    """Dictionaries of many slices are made in turn from the slices' own, and each feature is what compressing block by block gives."""
    import zstandard as zstd

    monkeypatch.setattr(quality, "SLICE", size)
    rng = random.Random(5)
    good = [(i, " ".join(rng.choice("plain quiet words that flow over long calm pages of prose".split()) for _ in range(400)) + f" {i}") for i in range(60)]
    bad = [(100 + i, " ".join(rng.choice("BUY NOW!! CLICK | $$$ WIN FREE ###".split()) + str(rng.randrange(50)) for _ in range(400))) for i in range(60)]
    docs = spark.createDataFrame(good + bad, SCHEMA)
    labels = docs.select("doc_id", (F.col("doc_id") < 100).cast("int").alias("quality"))
    model = quality.train_quality(docs, labels, dict_bytes=4096)
    assert max(len(model.good), len(model.bad)) <= 4096
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    for i, t in good[:5] + bad[:5]:
        data, sizes = t.encode(), []
        for d in (model.good, model.bad):
            made = zstd.ZstdCompressor(level=quality.LEVEL, dict_data=zstd.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False)
            sizes.append(sum(len(made.compress(data[k : k + quality.BLOCK])) for k in range(0, len(data), quality.BLOCK)) / len(data))
        g, b = sizes
        x = sum(w * v for w, v in zip(model.weights, (1, 10 * (b - g), g, b, 10 * (b - g) * g, g * g, g == 0), strict=True))
        assert math.isclose(got[i], 1 / (1 + math.exp(-min(max(x, -30), 30))), rel_tol=1e-9)
        assert (got[i] > 0.5) == (i < 100)


def test_the_fast_way_is_taken_for_files_of_its_rules_only():
    spec = json.loads(Path(queries.vocabulary("byte_bpe_50k.json")).read_bytes())
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.vocabulary("byte_bpe_50k.tiktoken"), "rb"))}
    assert token_counts._same_rules(spec, ranks)
    for change in ("swap ids", "swap merges", "drop merge", "prefix", "odd character"):
        other = json.loads(json.dumps(spec))
        model = other["model"]
        if change == "swap ids":
            a, b = list(model["vocab"])[300:302]
            model["vocab"][a], model["vocab"][b] = model["vocab"][b], model["vocab"][a]
        elif change == "swap merges":
            model["merges"][5], model["merges"][6] = model["merges"][6], model["merges"][5]
        elif change == "drop merge":
            model["merges"].pop()
        elif change == "prefix":
            other["pre_tokenizer"]["add_prefix_space"] = True
        else:
            model["vocab"]["☃"] = 60_000
        assert not token_counts._same_rules(other, ranks), change


def test_mixtures_are_flagged_and_whole_texts_are_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL")
    fold = queries.fold("doc_id", 3)
    model = lang_id.train_language(docs.where(fold != 1))
    held = docs.where(fold == 1)
    assert lang_id.identify_language(held, model).where("ambiguous").count() <= 0.02 * held.count()
    rng, by = random.Random(1), {}
    for r in held.collect():
        by.setdefault(r.lang, []).append(r.text)
    mixed = []
    for i in range(200):
        x, y = (rng.choice(by[k])[:1500] for k in rng.sample(sorted(by), 2))
        n = min(len(x), len(y))
        mixed.append((i, x[:n] + " " + y[:n]))
    assert lang_id.identify_language(spark.createDataFrame(mixed, SCHEMA), model).where("ambiguous").count() >= 70
