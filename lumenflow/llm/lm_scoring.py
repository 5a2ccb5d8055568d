"""Language-model scoring by an Elias-Fano n-gram trie.

The model is a bigram model, interpolated with the unigram model by absolute
discounting. Its trie has two levels: contexts, and each context's successors.
Hashes and pointers of a level are monotone, so each is an Elias-Fano sequence;
the smoothed probabilities are quantised to two bytes, which reach down to
10**-2621. A trie lies in a file that
is memory-mapped to answer queries: find the context, then search the successor
in the context's own range.

No machine holds the whole model. Blocks of documents (see blocks.py) ask for the
counts of their words, send each distinct pair of words once with how often
training documents have it, and get a quantised log-probability for each back.
The pairs of a context lie in one shard of the trie, those of a very frequent
context in as many shards as its count asks for; how many successors such a
context has is summed over its shards before they are built. Everything is
counted over all training documents; nothing is pruned, capped or estimated.

Words are known by 64-bit hashes, successors inside a context by 32 bits.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, WIRE, block_count, cuts, in_blocks, is_in, joined, number, wire
from .common import LOWERED, hash_spans, mixed, prefix_sums, raw, steps, stored, words

START, END = np.uint64(1), np.uint64(2)
DISCOUNT = 0.75
#: Log10 steps of a quantised probability, and occurrences of a context beyond which it is dealt over shards.
STEP, SHARE = 0.04, 20_000
#: Bytes of text counted before counts are sent on.
FLUSH = 48_000_000


# --- Elias-Fano sequences and the trie -------------------------------------


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(1).astype(np.uint8)
#: Place of the r-th one in a byte.
_PLACE = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.uint8)


class EliasFano:
    """A monotone sequence of numbers below 2**62: low bits packed, high bits as a unary bit row.

    The number of ones before each 64 bits of the row is all that is held beside
    it: half a bit for each bit.
    """

    def __init__(self, n: int, low_bits: int, lows: np.ndarray, highs: np.ndarray):
        self.n, self.low_bits, self.lows, self.highs = n, low_bits, lows, highs
        self._before: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = values & np.uint64((1 << bits) - 1)
        shifts = np.arange(bits, dtype=np.uint64)
        packed = [np.packbits(((low[i : i + 8192, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for i in range(0, n, 8192)]
        lows = np.concatenate([*packed, np.zeros(16, np.uint8)])
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        row = np.zeros(((int(ones[-1]) + 1 if n else 0) + 63) // 64 * 64, np.uint8)
        row[ones] = 1
        return cls(n, bits, lows, np.packbits(row, bitorder="little"))

    def _select(self, i: np.ndarray, bit: int) -> np.ndarray:
        """Places of the i-th ones or zeros of the row; a zero beyond the row counts as just behind it."""
        words = self.highs.reshape(-1, 8)
        if self._before is None:  # counted once when a sequence is first read
            self._before = np.append(0, np.cumsum(_ONES[words].sum(1, dtype=np.int64))).astype(np.uint32 if self.n < 1 << 32 else np.int64)
        before = self._before if bit else np.arange(len(self._before)) * 64 - self._before
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), 65536):
            x = i[at : at + 65536]
            w = np.minimum(np.searchsorted(before, x, "right") - 1, len(words) - 1)
            r = x - before[w].astype(np.int64)
            own = words[w] if bit else ~words[w]
            upto = np.cumsum(_ONES[own], axis=1, dtype=np.int64)
            byte = np.minimum((upto <= r[:, None]).sum(1), 7)
            rest = r - np.where(byte > 0, upto[np.arange(len(x)), byte - 1], 0)
            out[at : at + 65536] = np.where(r < upto[:, 7], w * 64 + byte * 8 + _PLACE[own[np.arange(len(x)), byte], np.minimum(rest, 7)], len(words) * 64)
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        word = np.zeros(len(i), np.uint64)
        if not self.low_bits:
            return word
        at = i * self.low_bits
        byte, shift = at >> 3, (at & 7).astype(np.uint64)
        for k in range((self.low_bits + 14) // 8 if self.low_bits <= 56 else 8):
            word |= self.lows[byte + k].astype(np.uint64) << np.uint64(8 * k)
        word >>= shift
        if self.low_bits > 56:
            word |= np.where(shift > 0, self.lows[byte + 8].astype(np.uint64) << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return word & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, 1) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x the first index whose value is x or more (n if there is none), and whether it is x."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high, low = (x >> np.uint64(self.low_bits)).astype(np.int64), x & np.uint64((1 << self.low_bits) - 1)
        # Values of one high part lie between two zeros of the row.
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0), 0) + 1 - high, 0)
        lo = np.clip(lo, 0, self.n)
        hi = np.clip(self._select(high, 0) - high, lo, self.n)
        end = hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        same = lo < end
        same[same] = self._low(lo[same]) == low[same]
        return lo, same

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64).view(np.uint8), self.lows, self.highs]

    @classmethod
    def from_arrays(cls, head: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> EliasFano:
        n, bits = np.frombuffer(head.tobytes(), np.int64)
        return cls(int(n), int(bits), lows, highs)


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / STEP), 0, 65535).astype(np.uint16)


def restored(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) * -STEP


def packed(code: np.ndarray) -> bytes:
    """All low bytes and then all high bytes, which are mostly 0 and compress to almost nothing."""
    return code.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    low, high = np.frombuffer(data, np.uint8).reshape(2, -1)
    return low.astype(np.uint16) | (high.astype(np.uint16) << np.uint16(8))


class NgramTrie:
    """Contexts (level 1: hash, pointer, quantised weight of the lower order) and successors (level 2: hash, quantised probability)."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, backoff: np.ndarray, successors: EliasFano, probs: np.ndarray):
        self.contexts, self.pointers, self.backoff, self.successors, self.probs = contexts, pointers, backoff, successors, probs

    @classmethod
    def build(cls, context: np.ndarray, successor: np.ndarray, count: np.ndarray, total: np.ndarray, lower: np.ndarray, known: np.ndarray, bare: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> NgramTrie:
        """From counted pairs sorted by context hash (below 2**62) and 32-bit successor hash.

        total: the context's count in training; lower: log10 probability of the
        successor alone; known: how many successors the context has over all
        shards, as far as that is more than the pairs given; bare: context, total
        and known of contexts whose successors all lie in other shards.
        """
        names, begins, kinds = np.unique(context, return_index=True, return_counts=True)
        total_of, known_of = total[begins], np.maximum(kinds, known[begins])
        if bare is not None:
            names, total_of, known_of, kinds = (np.append(x, y) for x, y in ((names, bare[0]), (total_of, bare[1]), (known_of, bare[2]), (kinds, np.zeros(len(bare[0]), np.int64))))
            o = np.argsort(names)
            names, total_of, known_of, kinds = names[o], total_of[o], known_of[o], kinds[o]
        weight = np.minimum(DISCOUNT * known_of / np.maximum(total_of, 1), 1.0)
        own = np.repeat(np.arange(len(names)), kinds)
        p = np.maximum(count - DISCOUNT, 0) / np.maximum(total, 1) + weight[own] * 10.0**lower
        # Successors of context k become monotone over the whole level by adding k * 2**32.
        level = successor.astype(np.uint64) + (own.astype(np.uint64) << np.uint64(32))
        return cls(EliasFano.of(names), EliasFano.of(np.append(0, np.cumsum(kinds))), quantised(np.log10(weight)) if len(weight) else np.zeros(0, np.uint16), EliasFano.of(level), quantised(np.log10(p)) if len(p) else np.zeros(0, np.uint16))

    def query(self, context: np.ndarray, successor: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Log10 probabilities: of the pair if the trie has it, else the context's weight of the lower order; the lower order alone for a new context."""
        out = lower.copy()
        for at in range(0, len(out), 1 << 18):
            part = slice(at, at + (1 << 18))
            self._query(context[part], successor[part], out[part])
        return out

    def _query(self, context: np.ndarray, successor: np.ndarray, out: np.ndarray) -> None:
        # Pairs come in order of context, so a context is looked up once for all its successors.
        begins = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
        at, same = self.contexts.successor(context[begins])
        if not same.any():
            return
        found = np.flatnonzero(same)
        c = at[found]
        lo, hi = self.pointers.get(c).astype(np.int64), self.pointers.get(c + 1).astype(np.int64)
        many = np.diff(np.append(begins, len(context)))[found]
        own = np.repeat(np.arange(len(found)), many)
        known = begins[found][own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        out[known] += restored(self.backoff[c])[own]
        s, same = self.successors.successor(successor[known].astype(np.uint64) + (c[own].astype(np.uint64) << np.uint64(32)))
        inside = np.flatnonzero(same & (lo[own] <= s) & (s < hi[own]))
        out[known[inside]] = restored(self.probs[s[inside]])

    def save(self, path: str) -> None:
        arrays = [*self.contexts.arrays(), *self.pointers.arrays(), *self.successors.arrays(), self.backoff.view(np.uint8), self.probs.view(np.uint8)]
        with open(path, "wb") as f:
            f.write(np.array([len(a) for a in arrays], np.int64).tobytes())
            for a in arrays:
                f.write(np.ascontiguousarray(a).tobytes())

    @classmethod
    def open(cls, path: str) -> NgramTrie:
        mapped = np.memmap(path, np.uint8, "r")
        sizes = np.frombuffer(mapped[: 11 * 8].tobytes(), np.int64)
        cut = 11 * 8 + np.append(0, np.cumsum(sizes))
        a = [mapped[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
        return cls(EliasFano.from_arrays(*a[0:3]), EliasFano.from_arrays(*a[3:6]), a[9].view(np.uint16), EliasFano.from_arrays(*a[6:9]), a[10].view(np.uint16))


# --- words and pairs of a block --------------------------------------------


def _short(h: np.ndarray) -> np.ndarray:
    """Word hashes below 2**62, apart from START and END."""
    return (h >> np.uint64(2)) | np.uint64(4)


def _sequences(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each row's words and then END, and their rows."""
    data, offs = raw(column)
    hashes, rows = [], []
    for i, j in steps(offs):
        part = offs[i : j + 1]
        bytes_ = data[part[0] : part[-1]]
        start, end, row = words(bytes_, part - part[0])
        hashes.append(_short(hash_spans(prefix_sums(LOWERED[bytes_]), start, end)))
        rows.append((row + i).astype(np.int32))
    n = len(offs) - 1
    h, row = joined([*hashes, np.full(n, END)]), joined([*rows, np.arange(n, dtype=np.int32)], np.int32)
    del hashes, rows
    o = np.argsort(row, kind="stable")
    h = h[o]
    return h, row[o]


class _Tokens:
    """A block's tokens; its distinct words in order of bucket and hash, which each visit of the block finds alike."""

    def __init__(self, table: pa.Table, buckets: int):
        self.rows = table.num_rows
        token, self.row = _sequences(table.column("text"))
        self.train = np.asarray(table.column("train").combine_chunks())
        distinct, place = np.unique(token, return_inverse=True)
        del token
        bucket = (mixed(distinct) % np.uint64(buckets)).astype(np.int64)
        o = np.argsort(bucket, kind="stable")
        back = np.empty(len(o), np.int32)
        back[o] = np.arange(len(o), dtype=np.int32)
        self.words, self.word = distinct[o], back[place]
        self.cut = cuts(bucket[o])

    def counts(self, told: pa.Table) -> np.ndarray:
        """Training counts of the words, from what the buckets have told."""
        out = np.zeros(len(self.words), np.int64)
        for key, kind, a in zip(*(told.column(x).to_pylist() for x in ("key", "b", "a")), strict=True):
            if kind == b"counts":
                out[self.cut[key]] = np.frombuffer(a, np.int64)
        return out

    def pairs(self, counts: np.ndarray, buckets: int, documents: int, share: int) -> dict[str, np.ndarray]:
        """The distinct pairs (context, successor) in order of shard, context and successor, and each token's pair."""
        n = len(self.words)
        before = np.full(len(self.word), n, np.int64)  # START
        before[1:] = np.where(self.row[1:] == self.row[:-1], self.word[:-1], n)
        before *= n + 1
        before += self.word
        code, place = np.unique(before, return_inverse=True)
        del before
        place = place.astype(np.int32)
        first, second = (code // (n + 1)).astype(np.int32), (code % (n + 1)).astype(np.int32)
        size = len(code)
        del code
        context = np.append(self.words, START)[first]
        total = np.append(counts, documents)[first]
        del first
        successor = (mixed(self.words[second]) >> np.uint64(32)).astype(np.uint32)
        spread = 1 + total // share
        salt = (successor.astype(np.int64) // 7) % spread
        shard = (mixed(context + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int32)
        del spread, salt
        o = np.lexsort((successor, context, shard))
        trained = np.bincount(place[self.train[self.row]], minlength=size).astype(np.uint32)
        back = np.empty(len(o), np.int32)
        back[o] = np.arange(len(o), dtype=np.int32)
        pair = back[place]
        del back, place
        return {"pair": pair, "context": context[o], "total": total[o], "successor": successor[o], "second": second[o], "trained": trained[o], "cut": cuts(shard[o])}


# --- what runs in blocks and buckets ---------------------------------------


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            bucket = (mixed(h) % np.uint64(buckets)).astype(np.int64)
            o = np.argsort(bucket, kind="stable")
            rows = [(k, 0, h[o[s]].tobytes(), n[o[s]].astype(np.int64).tobytes(), None, None) for k, s in cuts(bucket[o]).items()]
            yield from wire(rows).to_batches()

        for b in batches:
            h, _ = _sequences(pa.chunked_array([b.column(0)]))
            parts.append(h)
            size += 8 * len(h)
            if size > FLUSH:
                yield from flush()
                parts, size = [], 0
        if parts:
            yield from flush()

    return run


def _summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    h = joined([np.frombuffer(x, np.uint64) for x in table.column("a").to_pylist()])
    n = joined([np.frombuffer(x, np.int64) for x in table.column("b").to_pylist()], np.int64)
    words_, place = np.unique(h, return_inverse=True)
    total = np.bincount(place, n, len(words_)).astype(np.int64)
    ends = total[words_ == END]
    return pa.table({"key": pa.array([number(key)], pa.int32()), "words": pa.array([words_.tobytes()], pa.binary()), "counts": pa.array([total.tobytes()], pa.binary()), "tokens": [int(total.sum())], "kinds": [len(words_)], "documents": [int(ends.sum())]})


def _asked(buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t = _Tokens(table, buckets)
        return wire([(k, number(key), t.words[s].tobytes(), None, None, None) for k, s in t.cut.items()])

    return run


def _answered(key: tuple[pa.Scalar, ...], asked: pa.Table, known: pa.Table) -> pa.Table:
    words_ = joined([np.frombuffer(x, np.uint64) for x in known.column("words").to_pylist()])
    counts = joined([np.frombuffer(x, np.int64) for x in known.column("counts").to_pylist()], np.int64)
    rows = []
    for block, a in zip(asked.column("block").to_pylist(), asked.column("a").to_pylist(), strict=True):
        h = np.frombuffer(a, np.uint64)
        n = np.zeros(len(h), np.int64)
        if len(words_):
            at = np.minimum(np.searchsorted(words_, h), len(words_) - 1)
            n = np.where(words_[at] == h, counts[at], 0)
        rows.append((number(key), block, n.tobytes(), b"counts", None, None))
    return wire(rows)


def _lower(counts: np.ndarray, mass: float) -> np.ndarray:
    return np.log10((counts + 0.5) / mass)


def _paired(buckets: int, mass: float, documents: int, share: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        t = _Tokens(table, buckets)
        counts = t.counts(told)
        p = t.pairs(counts, buckets, documents, share)
        low = quantised(_lower(counts, mass))[p.pop("second")]
        del t, counts, p["pair"]
        rows = []
        for k, s in p["cut"].items():
            context = p["context"][s]
            begins = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            head = np.concatenate([context[begins].view(np.int64), p["total"][s][begins], np.diff(np.append(begins, len(context)))])
            rows.append((k, number(key), head.tobytes(), p["successor"][s].tobytes(), packed(low[s]), p["trained"][s].astype(np.uint32).tobytes()))
        return wire(rows)

    return run


def _found(buckets: int, share: int):
    """What the bucket's shard has of the contexts that are dealt over shards: each one's training count and distinct successors here, none too, to the context's home bucket."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        heads, pairs = [], []
        for a, b, d in zip(*(table.column(x).to_pylist() for x in ("a", "b", "d")), strict=True):
            context, total, n = np.frombuffer(a, np.int64).reshape(3, -1)
            dealt = total >= share
            if dealt.any():
                heads.append((context[dealt].view(np.uint64), total[dealt]))
                seen = np.repeat(dealt, n) & (np.frombuffer(d, np.uint32) > 0)
                pairs.append((np.repeat(context.view(np.uint64), n)[seen], np.frombuffer(b, np.uint32)[seen]))
        if not heads:
            return wire([])
        context, first = np.unique(np.concatenate([h[0] for h in heads]), return_index=True)
        total = np.concatenate([h[1] for h in heads])[first]
        code = np.concatenate([(np.searchsorted(context, c).astype(np.uint64) << np.uint64(32)) | s for c, s in pairs])
        kinds = np.bincount((np.unique(code) >> np.uint64(32)).astype(np.int64), minlength=len(context)).astype(np.int64)
        home = (mixed(context) % np.uint64(buckets)).astype(np.int64)
        return wire([(int(k), number(key), context[home == k].tobytes(), kinds[home == k].tobytes(), total[home == k].tobytes(), None) for k in np.unique(home)])

    return run


def _found_in_all(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Sums the shards' successors of each context and tells each shard that has it."""
    shards = table.column("block").to_pylist()
    contexts, kinds, totals = ([np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (("a", np.uint64), ("b", np.int64), ("c", np.int64)))
    names, place = np.unique(np.concatenate(contexts), return_inverse=True)
    sums = np.zeros(len(names), np.int64)
    np.add.at(sums, place, np.concatenate(kinds))
    return wire([(shard, number(key), c.tobytes(), sums[np.searchsorted(names, c)].tobytes(), t.tobytes(), None) for shard, c, t in zip(shards, contexts, totals, strict=True)])


def _scored_pairs(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
    """Builds the bucket's shard of the trie and gives each block the log-probabilities of its pairs, in its order."""
    parts = []
    for block, a, b, c, d in zip(*(table.column(x).to_pylist() for x in ("block", "a", "b", "c", "d")), strict=True):
        context, total, n = np.frombuffer(a, np.int64).reshape(3, -1)
        parts.append((block, np.repeat(context.view(np.uint64), n), np.repeat(total, n), np.frombuffer(b, np.uint32), unpacked(c), np.frombuffer(d, np.uint32)))
    blocks, ends = [p[0] for p in parts], np.cumsum([len(p[1]) for p in parts])
    context, total, successor, low, count = (np.concatenate([p[i] for p in parts]) for i in range(1, 6))
    del parts  # all that follows takes slices of the joined arrays
    trained = np.flatnonzero(count)
    o = trained[np.lexsort((successor[trained], context[trained]))]
    begins = np.flatnonzero(np.append(True, (context[o[1:]] != context[o[:-1]]) | (successor[o[1:]] != successor[o[:-1]]))) if len(o) else np.zeros(0, np.int64)
    first = o[begins]
    counts = np.add.reduceat(count[o].astype(np.int64), begins) if len(o) else np.zeros(0, np.int64)
    dealt, kinds, dealt_total = (joined([np.frombuffer(x, t) for x in found.column(c).to_pylist()], t) for c, t in (("a", np.uint64), ("b", np.int64), ("c", np.int64)))
    o = np.argsort(dealt)
    dealt, kinds, dealt_total = dealt[o], kinds[o], dealt_total[o]
    known = np.zeros(len(first), np.int64)
    if len(dealt):
        at = np.minimum(np.searchsorted(dealt, context[first]), len(dealt) - 1)
        known = np.where(dealt[at] == context[first], kinds[at], 0)
    bare = ~is_in(dealt, context[first])
    trie = NgramTrie.build(context[first], successor[first], counts, total[first], restored(low[first]), known, (dealt[bare], dealt_total[bare], kinds[bare]))
    del total, count, trained, begins, first, counts, known, bare
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "shard.trie")
        trie.save(path)
        trie = NgramTrie.open(path)
        own = [slice(int(i), int(j)) for i, j in zip(np.append(0, ends[:-1]), ends, strict=True)]
        rows = [(number(key), block, packed(quantised(trie.query(context[s], successor[s], restored(low[s])))), b"scores", None, None) for block, s in zip(blocks, own, strict=True)]
    return wire(rows)


def _documents(buckets: int, documents: int, share: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        t = _Tokens(table, buckets)
        counts = t.counts(told)
        p = t.pairs(counts, buckets, documents, share)
        codes = np.zeros(len(p["context"]), np.uint16)
        for k, kind, a in zip(*(told.column(x).to_pylist() for x in ("key", "b", "a")), strict=True):
            if kind == b"scores":
                codes[p["cut"][k]] = unpacked(a)
        c = counts[t.word]
        total = lambda x: np.bincount(t.row, x, t.rows)
        return pa.table({"doc_id": table.column("doc_id"), "n_tokens": pa.array(np.bincount(t.row, minlength=t.rows), pa.int64()), "n_known": pa.array(total(c > 0).astype(np.int64)), "log_counts": pa.array(total(np.log10(c + 0.5))), "score": pa.array(total(restored(codes)[p["pair"]]))})

    return run


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, share: int = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs.

    train says which rows the model learns from; held_out is its opposite. Tokens
    are a text's lower-cased words and one end, so null and empty texts have one.
    base_score is the add-half unigram score; score is the trie's log10
    probability. Rows are counted as they come, repeated ones too; null ids stay
    null; without training rows both scores rest on the empty model; an empty
    table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = block_count(rows, block_bytes)
    unigrams = rows.where("train").select("text").mapInArrow(_counted(blocks), WIRE).groupBy("key").applyInArrow(_summed, "key int, words binary, counts binary, tokens long, kinds long, documents long")
    unigrams = stored(unigrams, "unigrams")
    n = unigrams.agg(F.sum("tokens"), F.sum("kinds"), F.sum("documents")).first()
    tokens, kinds, documents = (int(x or 0) for x in n)
    mass = tokens + 0.5 * (kinds + 1)
    own = in_blocks(rows, blocks).groupBy("block")
    counts = own.applyInArrow(_asked(blocks), WIRE).groupBy("key").cogroup(unigrams.groupBy("key")).applyInArrow(_answered, WIRE)
    pairs = own.cogroup(counts.groupBy("block")).applyInArrow(_paired(blocks, mass, documents, share), WIRE)
    found = pairs.groupBy("key").applyInArrow(_found(blocks, share), WIRE).groupBy("key").applyInArrow(_found_in_all, WIRE)
    scores = pairs.groupBy("key").cogroup(found.groupBy("key")).applyInArrow(_scored_pairs, WIRE)
    done = own.cogroup(counts.unionByName(scores).groupBy("block")).applyInArrow(_documents(blocks, documents, share), "doc_id long, n_tokens long, n_known long, log_counts double, score double")
    return done.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("log_counts") - F.col("n_tokens") * F.lit(float(np.log10(mass)))).alias("base_score"), "score")
