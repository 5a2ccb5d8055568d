"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

In a merge-type vocabulary the encoding of a text's prefix ends in one certain
token, whatever follows. A table keeps that last token for each prefix: an
automaton gives the pieces that end at a place, longest first, and the first one
that is compatible with the last token of what stands before it is the one. The
ids are then read off backwards.

Two tokens are compatible when encoding their joint text gives just these two. That
is found by undoing their merges backwards: of the two parts at the border, the one
that was made later falls back into its own parts, and whatever two parts met there
must not have been due to merge before that. It is remembered. Text is taken word by word,
a word being spaces and what follows up to the next space: no piece holds a space
behind another character, so no merge crosses. Characters that no chain of pieces
connects, as letters and marks of punctuation often are, are words apart for the
same reason, so what stands before a mark is remembered but once. Runs of spaces, whose pieces share
one score so that place decides between them, are merged plainly.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched

SPACE = "▁"
#: Words of up to so many characters that a Python worker remembers with their ids, and pairs of tokens whose fit it
#: remembers; beyond either it begins anew. Together they stay below about 150 MB.
REMEMBERED, WORD_CHARS, FITS = 200_000, 48, 400_000


class PieceCodec:
    """Encoder and decoder of one .model file of kind BPE with byte fallback."""

    def __init__(self, model_path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        kinds = proto.ModelProto.SentencePiece
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("the prefix table needs a BPE model with byte fallback")
        if spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only the identity normaliser, which keeps all spaces, is supported")
        self.dummy = spec.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        if kinds.USER_DEFINED in self.kinds:
            raise ValueError("user-defined pieces are not supported")
        self.eos = model.trainer_spec.eos_id
        self.byte = [0] * 256
        self.byte_of: dict[int, int] = {}
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte[int(p.piece[1:-1], 16)] = i
                self.byte_of[i] = int(p.piece[1:-1], 16)
        self.rank = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece holds a space behind another character")
        self.id = {p: i for p, (_, i) in self.rank.items()}
        self.known = set("".join(self.rank)) & set(self.rank)
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.shown = [str(i) for i in range(len(self.pieces))]
        self.word = re.compile(self._words())
        self.automaton = ahocorasick.Automaton()
        #: The two parts that make each piece, and when: single characters are there before all else.
        self.halves: dict[str, tuple[str, str]] = {}
        self.made: dict[str, float] = {}
        for p, i in sorted(self.id.items(), key=lambda x: len(x[0])):
            parts, halves = self._parts(p)
            if parts != [p]:  # a piece that its own parts don't merge into never comes out
                continue
            self.automaton.add_word(p, (len(p), i))
            if not halves:
                self.made[p] = float("-inf")
            elif all(self.made.get(h, float("inf")) < self.rank[p][0] for h in halves):
                self.made[p], self.halves[p] = self.rank[p][0], halves
        self.automaton.make_automaton()

    def _words(self) -> str:
        """A pattern of words: characters that hang together by pieces, with the spaces before them."""
        group = {c: {c} for c in self.known - {SPACE}}
        for p in self.rank:
            held = [c for c in p.lstrip(SPACE) if c in group]
            for c in held[1:]:
                if group[c] is not group[held[0]]:
                    small, large = sorted((group[c], group[held[0]]), key=len)
                    large |= small
                    group.update(dict.fromkeys(small, large))
        joined = set("".join(p for p in self.rank if len(p) > 1))
        alone = {*group, "\n"} - joined
        within = lambda chars: "".join(map(re.escape, sorted(chars)))
        groups = sorted({id(g): g for c, g in group.items() if c not in alone}.values(), key=lambda g: (-len(g), min(g)))
        # The largest group first; characters without a piece are one, and those that no longer piece holds are words one by one.
        of = [f"[{within(g)}]+" for g in groups] + [f"[^{SPACE}{within({*group, '\n'})}]+"]
        return f"{SPACE}*(?:{'|'.join(of)})|{SPACE}+" + f"|[{within(alone)}]" * bool(alone)

    def _merge(self, text: str) -> list[int]:
        """Ids by plain merging: the best-scored pair first, the leftmost of equals; characters without a piece stand alone as bytes."""
        return [t for p in self._parts(text)[0] for t in self._ids(p)]

    def _parts(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The parts that plain merging leaves, and the two that it merged last."""
        last = None
        parts, n = list(text), len(text)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := self.rank.get(parts[i] + parts[j])):
                heapq.heappush(heap, (found[0], i, j, parts[i] + parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != whole:
                continue
            last = parts[i], parts[j]
            parts[i], parts[j] = whole, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p], last

    def _ids(self, part: str) -> list[int]:
        found = self.id.get(part)
        return [found] if found is not None else [self.byte[b] for b in part.encode("utf-8", "replace")]

    def _fit(self, a: int, b: int) -> bool:
        if len(self.fits) >= FITS:
            self.fits.clear()
        x, y = self.pieces[a], self.pieces[b]
        fit = self.fits[a, b] = self._apart(x, y) if x in self.made and y in self.made else self._merge(x + y) == [a, b]
        return fit

    def _apart(self, x: str, y: str) -> bool:
        """Whether plain merging of x + y ends in x and y. Either is made of parts that are made before it, so merges within it come in the order of scores."""
        rank, made, halves = self.rank, self.made, self.halves
        until, right = float("inf"), False  # when a part at the border is merged away from it, and whether that is y's
        while True:
            found = rank.get(x + y)
            if found and (found[0] < until or right and found[0] == until):  # of equals the leftmost is merged first
                return False
            mx, my = made[x], made[y]
            if mx > my:
                until, right, x = mx, False, halves[x][1]
            elif y in halves:
                until, right, y = my, True, halves[y][0]
            else:
                return True

    def _table(self, text: str) -> list[int]:
        """Ids of a text whose characters all have pieces, by the prefix table."""
        last, start, fits = [-1] * len(text), [0] * len(text), self.fits
        for end, (n, piece) in self.automaton.iter(text):  # the longest first, at each end
            if last[end] >= 0:
                continue
            if at := end + 1 - n:
                if (before := last[at - 1]) < 0:
                    continue
                if (fit := fits.get((before, piece))) is None:
                    fit = self._fit(before, piece)
                if not fit:
                    continue
            last[end], start[end] = piece, at
        ids, end = [], len(text) - 1
        while end >= 0:
            ids.append(last[end])
            end = start[end] - 1
        return ids[::-1]

    def word_ids(self, word: str) -> list[int]:
        if word.startswith(SPACE * 2):
            return self._merge(word)
        if self.known.issuperset(word):
            return self._table(word)
        ids, run = [], ""
        for c in word:
            if c in self.known:
                run += c
                continue
            ids += self._table(run) if run else []
            ids += self._ids(c)
            run = ""
        return ids + (self._table(run) if run else [])

    def normalised(self, text: str) -> str:
        return (SPACE if self.dummy else "") + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str) -> list[int]:
        return [i for w in self.word.findall(self.normalised(text)) for i in self.word_ids(w)]

    def encode_decode(self, text: str) -> tuple[str, int, str]:
        """Decimal ids joined by spaces, without the end id, their number, and the text that they decode to.

        Decoding goes word by word too: no run of bytes of one character crosses words.
        """
        remembered, odd, shown = self.words, self.odd, self.shown
        found = self.word.findall(self.normalised(text))
        out, texts = [], found
        for k, w in enumerate(found):
            if (known := remembered.get(w)) is None:
                ids = self.word_ids(w)
                known = " ".join([shown[i] for i in ids])
                decoded = w if self.known.issuperset(w) else self.decode(ids, False)
                if len(w) <= WORD_CHARS:
                    if len(remembered) >= REMEMBERED:
                        remembered.clear()
                        odd.clear()
                    remembered[w] = known
                    if decoded != w:
                        odd[w] = decoded
                texts[k] = decoded
            elif w in odd:
                texts[k] = odd[w]
            out.append(known)
        joined = " ".join(out)
        decoded = "".join(texts).replace(SPACE, " ")
        return joined, joined.count(" ") + 1 if joined else 0, decoded[1:] if self.dummy and decoded.startswith(" ") else decoded

    def decode(self, ids: list[int], whole: bool = True) -> str:
        """Text of ids: spaces from their marks, the added first one left out if ids are a whole text's, runs of byte pieces as UTF-8 (bad bytes become U+FFFD each)."""
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (4, 3, 2, 1):
                    try:
                        out.append(run[at : at + n].decode("utf-8"))
                        at += n
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    at += 1
            run.clear()

        first = whole
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                first = False
                continue
            if run:
                flush()
            kind = self.kinds[i]
            if kind == 3:  # control
                continue
            piece = " ⁇ " if kind == 2 else self.pieces[i]
            if first and self.dummy and piece.startswith(SPACE):
                piece = piece[1:]
            first = False
            out.append(piece.replace(SPACE, " ") if kind == 1 else piece)
        flush()
        return "".join(out)


@lru_cache(2)
def codec(model_path: str) -> PieceCodec:
    return PieceCodec(model_path)


def _digests(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            n, ids, texts = [], [], []
            for t in b.column(1).to_pylist():
                joined, k, decoded = c.encode_decode(t or "")
                joined = f"{joined} {c.eos}" if joined else str(c.eos)
                n.append(k + 1)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                texts.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            ids = [c.encode(t or "") + [c.eos] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decoded(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(ids or []) for ids in b.column(1).to_pylist()])], names=["doc_id", "text"])

    return run


def _rows(docs: DataFrame, id_col: str, col: str, kind: str) -> DataFrame:
    return batched(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(col).cast(kind).alias("x"))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, with the end id last, for every row of docs.

    Null and empty texts give the end id alone. Rows are taken one by one, so
    repeated rows, null ids and very long texts need nothing special; an empty
    table gives no rows, and other columns are ignored.
    """
    return _rows(docs, id_col, text_col, "string").mapInArrow(_encoded(model_path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row's ids; null ids give the empty text."""
    return _rows(encoded, id_col, ids_col, "array<int>").mapInArrow(_decoded(model_path), "doc_id long, text string")


def encode_decode_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs; cases as in encode."""
    return _rows(docs, id_col, text_col, "string").mapInArrow(_digests(model_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
