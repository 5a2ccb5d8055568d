"""What the prefix table asks of pairs of tokens, and where it takes words apart."""

import random

import pytest

from lumenflow.llm import queries, sentencepiece_codec


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.PieceCodec(queries.vocabulary("piece_bpe_32k.model"))


def test_pairs_fit_as_plain_merging_says(codec):
    rng = random.Random(1)
    pieces = [p for p in codec.made if not p.startswith("▁▁")]
    assert len(pieces) > 30_000
    begins = {}
    for p in pieces:
        begins.setdefault(p[0], []).append(p)
    fit = 0
    for _ in range(8000):
        x = rng.choice(pieces)
        # Often a piece that begins as some rest of x does, or one that a part of x was made with.
        y = rng.choice(begins[x[rng.randrange(len(x))]] if rng.random() < 0.5 else pieces)
        if rng.random() < 0.3 and x in codec.halves:
            x, y = codec.halves[x]
        want = codec._merge(x + y) == [codec.id[x], codec.id[y]]
        assert codec._apart(x, y) == want, (x, y)
        fit += want
    assert 2000 < fit < 7000


def test_words_are_encoded_without_plain_merging(codec, monkeypatch):
    """Each new pair of tokens was merged anew."""
    monkeypatch.setattr(codec, "_merge", lambda text: pytest.fail(f"merged {text}"))
    codec.fits.clear()
    codec.words.clear()
    assert codec.encode_decode("Unthinkably odd, oueauauxoi (èanoique)")[2] == "Unthinkably odd, oueauauxoi (èanoique)"


def test_marks_behind_letters_are_remembered_once(codec):
    assert codec.word.findall("▁ththin,%%%▁a\n\n▁▁b.▁▁\n") == ["▁ththin", ",%%%", "▁a", "\n", "\n", "▁▁b", ".", "▁▁", "\n"]


def test_mixed_characters_equal_the_library(codec):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    rng = random.Random(2)
    signs = [*"aeinst TH  ,.;:!?%#&*$()[]{}^-_=+|/\\\"'~`<>@0123\n\r\t", "the", "ing", "é", "ß", "ж", "ств", "中", "数据", "ال", "£", "\u00a0", "\u200b", "😀", "\U0010ffff", "▁", "\ufffd", "...", "    ", "%%%"]
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randrange(1, 40)))
        ids = library.encode(text, add_bos=False, add_eos=False)
        joined, n, decoded = codec.encode_decode(text)
        assert (joined, n, decoded) == (" ".join(map(str, ids)), len(ids), library.decode(ids)), text
