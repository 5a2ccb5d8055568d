"""Suffix-array dedup: removes bytes of 50-byte strings that an earlier document has too.

Documents are dealt into blocks of bounded size by doc_id, strings into buckets
by content, and only arrays travel between the two:

1. Every 50-byte window has an anchor, the least hash among its 24-byte grams, so
   equal windows have equal anchors. Each block sends its distinct anchors once.
2. Buckets of anchors tell blocks which of theirs more than one document has, and
   which very many have.
3. Blocks cut their texts into cells, runs of windows with one shared anchor, and
   tell of each distinct cell once, by hash, with its smallest and largest document.
   Windows of a very common anchor go singly, dealt by their own content, so that
   no bucket gets more than a bounded part of them. Windows of an anchor that has
   one distinct cell, as in copies, and single windows are equal where their hashes
   are; of anchors with several cells the bucket asks one block for each one's bytes.
4. Each bucket builds suffix arrays of these cells by two-stage sorting: only
   suffixes smaller than their successors are sorted directly, the rest are
   induced by scanning the array bucket by bucket; neighbours whose common prefix
   reaches 50 bytes form a class, whose smallest document is sent back.
5. Blocks remove the bytes of windows whose class has a smaller document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, WIRE, block_count, cuts, grouped, in_blocks, joined, number, wire
from .common import hash_grams, hash_spans, prefix_sums, raw, steps

LENGTH = 50
#: Shorter grams meet by chance: of 16 bytes, which are a few syllables, ever more as the input grows.
GRAM = 24
REACH = LENGTH - GRAM + 1  # grams in a window
SEPARATOR = 255  # never a byte of UTF-8
#: Documents beyond which an anchor's windows go singly.
COMMON = 2000
#: Bytes of cells that are sorted at a time; the cells of an anchor stay together.
SORTED_BYTES = 1 << 20
#: Bytes of text whose windows are found at a time, so that arrays of them stay in a core's cache.
RUN_BYTES = 1 << 17


# --- two-stage suffix sorting ----------------------------------------------


def two_stage_sort(t: np.ndarray, depth: int = 56) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of bytes t, in order of the first `depth` bytes at least, and each place's 8 bytes as a number."""
    n = len(t)
    padded = np.concatenate([t, np.zeros(depth + 16, np.uint8)])
    word = np.zeros(n + depth + 8, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + n + depth + 8]
    if n < 2:
        return np.arange(n), word
    # Type B: smaller than its successor; equal neighbours have the type of what follows them.
    changes = t[:-1] != t[1:]
    change = np.flatnonzero(changes)
    at = np.append(0, np.cumsum(changes))  # changes before each place
    smaller = np.append(t[change] < t[change + 1], False)[at]  # beyond the last change: larger than the shorter rest
    direct = np.flatnonzero(smaller)
    order = direct[np.argsort(word[direct])]
    tied = np.arange(len(order))
    same = np.zeros(len(order), bool)
    same[1:] = word[order[1:]] == word[order[:-1]]
    for off in range(8, depth, 8):
        grouped = same[tied] | np.append(same[tied][1:] & (np.diff(tied) == 1), False)
        tied = tied[grouped]
        if not len(tied):
            break
        group = np.cumsum(~same[tied])
        key = word[order[tied] + off]
        o = np.lexsort((key, group))
        order[tied] = order[tied][o]
        key, group = key[o], group[o]
        equal = np.zeros(len(tied), bool)
        equal[1:] = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
        same[tied] = equal
    b_start = np.searchsorted(t[order], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[t[-1]].append(np.array([n - 1]))  # what stands before the empty suffix
    out = []
    for c in range(256):
        own = list(pending[c])
        wave = np.concatenate(own) if own else np.zeros(0, np.int64)
        while len(wave):  # runs of one byte
            wave = wave[wave > 0] - 1
            wave = wave[(t[wave] == c) & ~smaller[wave]]
            if len(wave):
                own.append(wave)
        own.append(order[b_start[c] : b_start[c + 1]])
        whole = np.concatenate(own)
        if not len(whole):
            continue
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[(t[before] > c) & ~smaller[before]]
        if len(before):
            ch = t[before]
            o = np.argsort(ch, kind="stable")
            before, ch = before[o], ch[o]
            cuts = np.flatnonzero(np.diff(ch)) + 1
            for part in np.split(before, cuts):
                pending[t[part[0]]].append(part)
    return np.concatenate(out), word


def classes_of_windows(text: np.ndarray, lens: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each window of each cell in turn, the smallest of docs among the cells that hold that window.

    text: the cells' bytes one after the other; lens and docs: of each cell.
    """
    cell = np.repeat(np.arange(len(lens)), lens)
    t = np.full(len(text) + len(lens), SEPARATOR, np.uint8)
    t[np.arange(len(text)) + cell] = text
    n_windows = lens - LENGTH + 1
    owner = np.repeat(np.arange(len(lens)), n_windows)
    first = np.cumsum(n_windows) - n_windows
    place = (np.cumsum(lens + 1) - (lens + 1) - first)[owner] + np.arange(len(owner))  # of each window in t
    window = np.full(len(t), -1, np.int64)
    window[place] = np.arange(len(place))
    sa, word = two_stage_sort(t)
    sa = sa[window[sa] >= 0]
    equal = np.ones(len(sa) - 1, bool)
    for off in (*range(0, LENGTH - 8, 8), LENGTH - 8):  # adjacent common prefix of LENGTH or more
        equal &= word[sa[1:] + off] == word[sa[:-1] + off]
    begins = np.flatnonzero(np.append(True, ~equal))
    w = window[sa]
    least = np.minimum.reduceat(docs[owner[w]], begins)
    found = np.empty(len(owner), np.int64)
    found[w] = np.repeat(least, np.diff(np.append(begins, len(w))))
    return found


# --- windows and cells of a block ------------------------------------------


def _slide_min(v: np.ndarray, width: int) -> np.ndarray:
    m, span = v, 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


class Block:
    """The texts of a block; rows without an id have no windows."""

    def __init__(self, table: pa.Table):
        t = table.select(["doc_id", "text"])
        ids = t.column("doc_id").combine_chunks()
        self.known = np.asarray(ids.is_valid())
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        self.data, self.offs = raw(t.column("text"))

    def runs(self) -> Iterator[tuple[np.ndarray, ...]]:
        """For steps of the text: its bytes' prefix sums, their place, and anchor, first and last window, and row of each run of windows with one anchor."""
        for i, j in steps(self.offs, RUN_BYTES):
            base = self.offs[i]
            data = self.data[base : self.offs[j]]
            if len(data) < LENGTH:
                continue
            sums = prefix_sums(data)
            least = _slide_min(hash_grams(sums, GRAM), REACH)
            # Windows of a row are those that begin in it and end in it; a run goes on while the anchor stays and the row does.
            start, end = self.offs[i:j] - base, self.offs[i + 1 : j + 1] - base - LENGTH + 1
            has = np.flatnonzero((end > start) & self.known[i:j])
            if not len(has):
                continue
            new = np.append(True, least[1:] != least[:-1])
            new[start[has]] = True
            outside = np.zeros(len(least) + 1, np.int8)  # 1 from a row's last window on, 0 again from the next one's first
            outside[0] = 1
            np.add.at(outside, start[has], -1)
            np.add.at(outside, end[has], 1)
            inside = np.cumsum(outside[:-1], dtype=np.int8) == 0
            k = np.flatnonzero(new & inside)
            row = has[np.searchsorted(start[has], k, "right") - 1]
            nxt = np.append(k[1:], len(least))
            yield sums, base, least[k] >> np.uint64(16), k, np.minimum(nxt, end[row]) - 1, i + row


class Among:
    """Sorted numbers, in which others are looked up: most that aren't there are known by a table of their last bits."""

    def __init__(self, sorted_: np.ndarray):
        self.sorted_ = sorted_
        self.seen = np.zeros(1 << min(22, (4 * len(sorted_)).bit_length()), bool)
        self.last = np.uint64(len(self.seen) - 1)
        self.seen[sorted_ & self.last] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of x are there, and where."""
        yes = np.flatnonzero(self.seen[x & self.last])
        if not len(yes):
            return yes, yes
        at = np.minimum(np.searchsorted(self.sorted_, x[yes]), len(self.sorted_) - 1)
        same = self.sorted_[at] == x[yes]
        return yes[same], at[same]


def packed(x: np.ndarray) -> bytes:
    """48-bit numbers in 6 bytes each."""
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (x >> np.uint64(32)).astype(np.uint16).tobytes()


def unpacked(b: bytes | None) -> np.ndarray:
    n = len(b or b"") // 6
    return np.frombuffer(b, np.uint32, n).astype(np.uint64) | np.frombuffer(b, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32) if n else np.zeros(0, np.uint64)


def docs_of_anchors(fp: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors, 48-bit numbers, and how many of the documents, numbered from 0, each has."""
    if doc.max() < 1 << 16:  # both in one number, which sorts much faster
        pairs = np.sort(fp << np.uint64(16) | doc)
        fp = pairs[np.append(True, pairs[1:] != pairs[:-1])] >> np.uint64(16)
    else:
        o, begins = grouped(fp, doc)
        fp = fp[o[begins]]
    begins = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
    return fp[begins], np.diff(np.append(begins, len(fp))).astype(np.uint32)


def _anchors(buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = Block(table)
        doc = np.unique(block.ids, return_inverse=True)[1].astype(np.uint64)
        anchors, docs = [], []
        for _, _, value, _, _, row in block.runs():
            anchors.append(value)
            docs.append(doc[row])
        if not anchors:
            return wire([])
        fp, docs = docs_of_anchors(joined(anchors), joined(docs))
        where = (fp % np.uint64(buckets)).astype(np.int64)
        o = np.argsort(where, kind="stable")
        fp, docs, where = fp[o], docs[o], where[o]
        rows = []
        for k, s in cuts(where).items():
            f, d = fp[s], docs[s]
            many = d > 1
            rows.append((k, number(key), packed(f[~many]), packed(f[many]), d[many].tobytes(), None))
        return wire(rows)

    return run


def _shared(common_from: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """For each block, its anchors that several documents have (a) and that very many have (b)."""
        fps, docs, blocks = [], [], []
        for block, a, b, c in zip(*(table.column(x).to_pylist() for x in ("block", "a", "b", "c")), strict=True):
            one, many = unpacked(a), unpacked(b)
            fps += [one, many]
            docs += [np.ones(len(one), np.int64), np.frombuffer(c, np.uint32).astype(np.int64)]
            blocks.append(np.full(len(one) + len(many), block, np.int32))
        fp, n, block = joined(fps), joined(docs, np.int64), joined(blocks, np.int32)
        o, begins = grouped(fp)
        total = np.empty(len(fp), np.int64)
        total[o] = np.repeat(np.add.reduceat(n[o], begins), np.diff(np.append(begins, len(o))))
        keep = total > 1
        fp, total, block = fp[keep], total[keep], block[keep]
        o = np.argsort(block, kind="stable")
        fp, total, block = fp[o], total[o], block[o]
        rows = []
        for k in np.unique(block):
            s = slice(*np.searchsorted(block, [k, k + 1]))
            common = total[s] > common_from
            rows.append((number(key), int(k), packed(fp[s][~common]), packed(fp[s][common]), None, None))
        return wire(rows)

    return run


def _block_cells(block: Block, told: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """The distinct cells of shared anchors and then the distinct windows of common ones: hash, anchor, smallest and largest document."""
    shared, common = (Among(np.sort(joined([unpacked(x) for x in told.column(k).to_pylist()]))) for k in "ab")
    cells, windows = [], []
    for sums, _, value, p0, p1, row in block.runs() if told.num_rows else ():
        yes, _ = shared.find(value)
        cells.append((hash_spans(sums, p0[yes], p1[yes] + LENGTH), value[yes], block.ids[row[yes]]))
        yes, _ = common.find(value)
        if len(yes):
            own, p = spread_windows(p0, p1, yes)
            windows.append((hash_spans(sums, p, p + LENGTH), value[own], block.ids[row[own]]))
    for parts in (cells, windows):
        h, fp, ids = (joined([x[k] for x in parts], kind) for k, kind in enumerate((np.uint64, np.uint64, np.int64)))
        o = np.argsort(h)
        h, ids = h[o], ids[o]
        begins = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        yield h[begins], fp[o[begins]], *((f.reduceat(ids, begins) if len(ids) else ids) for f in (np.minimum, np.maximum))


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n numbers from each start on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def spread_windows(p0: np.ndarray, p1: np.ndarray, yes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of the chosen runs one by one: their run and place."""
    n = (p1 - p0 + 1)[yes]
    return np.repeat(yes, n), spread(p0[yes], n)


def _cells(buckets: int):
    """Tells the buckets of the block's distinct cells: how many are no single windows, and hashes of these and of single windows (a), smallest and largest documents (b), anchors (c)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        cells, windows = _block_cells(Block(table), told)
        h, fp, low, high = (np.concatenate(x) for x in zip(cells, windows, strict=True))
        if not len(h):
            return wire([])
        single = np.arange(len(h)) >= len(cells[0])
        where = (np.where(single, h, fp) % np.uint64(buckets)).astype(np.int64)
        o = np.argsort(where, kind="stable")  # single windows stay behind the others
        rows = []
        for k, at in cuts(where[o]).items():
            s = o[at]
            rows.append((k, number(key), np.append(np.uint64((~single[s]).sum()), h[s]).tobytes(), np.concatenate([low[s], high[s]]).tobytes(), packed(fp[s]), None))
        return wire(rows)

    return run


class _Cells:
    """What all blocks have told a bucket, and the distinct cells in order of anchors and hashes."""

    def __init__(self, table: pa.Table):
        hashes, docs, anchors, single, self.blocks = [], [], [], [], table.column("block").to_pylist()
        for a, b, c in zip(*(table.column(x).to_pylist() for x in "abc"), strict=True):
            h = np.frombuffer(a, np.uint64)
            hashes.append(h[1:])
            docs.append(np.frombuffer(b, np.int64).reshape(2, -1))
            anchors.append(unpacked(c))
            single.append(np.arange(len(h) - 1) >= int(h[0]))
        n = [len(x) for x in hashes]
        self.ends = np.cumsum(n)  # of the blocks' parts of what was told
        self.told, self.high, self.told_fp, self.told_single = joined(hashes), joined([x[1] for x in docs], np.int64), joined(anchors), joined(single, bool)
        low, block = joined([x[0] for x in docs], np.int64), np.repeat(np.array(self.blocks, np.int64), n)
        o = np.lexsort((low, self.told, self.told_fp))
        h, fp = self.told[o], self.told_fp[o]
        first = np.append(True, (h[1:] != h[:-1]) | (fp[1:] != fp[:-1]))[: len(o)]
        self.which = np.empty(len(o), np.int64)  # of the distinct cells, for each that was told of
        self.which[o] = np.cumsum(first) - 1
        o = o[first]
        self.hashes, self.low, self.fp, self.holder = h[first], low[o], fp[first], block[o]
        begins = np.flatnonzero(np.append(True, self.fp[1:] != self.fp[:-1])[: len(o)])
        n_cells = np.diff(np.append(begins, len(o)))
        #: Whether windows may equal those of other cells.
        self.open = np.repeat(n_cells > 1, n_cells) & ~self.told_single[o]

    def held(self, block: int) -> np.ndarray:
        """The open cells whose bytes a block is asked for, in the order in which it gives them."""
        return np.flatnonzero(self.open & (self.holder == block))


def _wanted(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Asks the block of each open cell's smallest document for its bytes: hashes (c)."""
    cells = _Cells(table)
    return wire([(number(key), int(k), None, None, cells.hashes[cells.held(k)].tobytes(), None) for k in np.unique(cells.holder[cells.open])])


def _given(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
    """The asked cells: lengths (b) and bytes (c), in the order asked for."""
    asked = [(k, np.frombuffer(c, np.uint64)) for k, c in zip(told.column("key").to_pylist(), told.column("c").to_pylist(), strict=True)]
    if not asked:
        return wire([])
    block = Block(table)
    wanted = Among(np.sort(joined([x for _, x in asked])))
    parts = []
    for sums, base, _, p0, p1, _ in block.runs():
        h = hash_spans(sums, p0, p1 + LENGTH)
        yes, _ = wanted.find(h)
        parts.append((h[yes], base + p0[yes], p1[yes] - p0[yes] + LENGTH))
    h, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    o = np.argsort(h)
    sorted_ = h[o]
    rows = []
    for k, hashes in asked:
        i = o[np.searchsorted(sorted_, hashes)]
        rows.append((k, number(key), None, n[i].astype(np.uint32).tobytes(), block.data[spread(at[i], n[i])].tobytes(), None))
    return wire(rows)


def runs_of_cells(cells: _Cells, given: pa.Table) -> tuple[np.ndarray, ...]:
    """For the open cells in turn, the number of runs of windows with one smallest document, and the least of these; for the runs in turn, windows and document."""
    lens = joined([np.frombuffer(x, np.uint32) for x in given.column("b").to_pylist()]).astype(np.int64)
    text = np.frombuffer(b"".join(given.column("c").to_pylist()), np.uint8)
    place = joined([cells.held(k) for k in given.column("block").to_pylist()], np.int64)  # of the given cells among the distinct ones
    o = np.argsort(place)
    at, lens, place = (np.cumsum(lens) - lens)[o], lens[o], place[o]
    begins = np.flatnonzero(np.append(True, cells.fp[place[1:]] != cells.fp[place[:-1]])[: len(place)])
    part = (np.cumsum(lens) - lens)[begins] // SORTED_BYTES
    edges = np.append(begins[np.append(True, part[1:] != part[:-1])[: len(part)]], len(place))
    out = []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        n = lens[i:j]
        found = classes_of_windows(text[spread(at[i:j], n)], n, cells.low[place[i:j]])
        first = np.cumsum(n - LENGTH + 1) - (n - LENGTH + 1)
        new = np.append(True, found[1:] != found[:-1])
        new[first] = True
        run_at = np.flatnonzero(new)
        runs = np.diff(np.append(np.searchsorted(run_at, first), len(run_at)))
        out.append((runs, np.minimum.reduceat(found, first), np.diff(np.append(run_at, len(found))), found[run_at]))
    return tuple(joined([x[k] for x in out], np.int64) for k in range(4))


def _sorted(key: tuple[pa.Scalar, ...], table: pa.Table, given: pa.Table) -> pa.Table:
    """For each block and cell where something may go: how many go whole, and hashes of these and of others (a), runs of windows of the others (b), smallest documents of the cells that go whole and of the runs (c), the anchors of single windows (d)."""
    cells = _Cells(table)
    runs, least_open, run_len, run_doc = runs_of_cells(cells, given)
    run_first = np.cumsum(runs) - runs
    as_open = np.cumsum(cells.open) - 1
    least = cells.low.copy()
    least[cells.open] = least_open
    goes = cells.high > least[cells.which]  # otherwise none of the block's documents has anything to remove there
    rows = []
    for block, i, j in zip(cells.blocks, np.append(0, cells.ends[:-1]), cells.ends, strict=True):
        at = i + np.flatnonzero(goes[i:j])
        if len(at):
            opened = cells.open[cells.which[at]]
            whole, at = at[~opened], at[opened]
            k = as_open[cells.which[at]]
            r = spread(run_first[k], runs[k])
            rows.append((
                number(key), block, np.concatenate([np.array([len(whole)], np.uint64), cells.told[whole], cells.told[at]]).tobytes(), np.concatenate([runs[k], run_len[r]]).astype(np.int32).tobytes(),
                np.concatenate([cells.low[cells.which[whole]], run_doc[r]]).tobytes(), packed(np.unique(cells.told_fp[whole[cells.told_single[whole]]])),
            ))
    return wire(rows)


class _Told:
    """What the buckets have sent to a block."""

    def __init__(self, told: pa.Table):
        whole, whole_docs, opened, runs, lens, docs = [], [], [], [], [], []
        for a, b, c in zip(*(told.column(x).to_pylist() for x in "abc"), strict=True):
            h, nums, doc = np.frombuffer(a, np.uint64), np.frombuffer(b, np.int32), np.frombuffer(c, np.int64)
            w, n = int(h[0]), len(h) - 1 - int(h[0])
            whole.append(h[1 : 1 + w])
            whole_docs.append(doc[:w])
            opened.append(h[1 + w :])
            runs.append(nums[:n])
            lens.append(nums[n:])
            docs.append(doc[w:])
        self.common = Among(np.unique(joined([unpacked(x) for x in told.column("d").to_pylist()])))
        h = joined(whole)
        o = np.argsort(h)
        self.whole, self.whole_docs = Among(h[o]), joined(whole_docs, np.int64)[o]
        h, runs, self.lens, self.docs = joined(opened), joined(runs, np.int32).astype(np.int64), joined(lens, np.int32).astype(np.int64), joined(docs, np.int64)
        self.start = np.cumsum(self.lens) - self.lens
        o = np.argsort(h)
        self.opened, self.first, self.runs = Among(h[o]), (np.cumsum(runs) - runs)[o], runs[o]

    def in_whole(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h go whole, and the document."""
        yes, at = self.whole.find(h)
        return yes, self.whole_docs[at]

    def in_runs(self, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """For all runs of those of h that have some, the index in h, offset of the first window, number of windows, and document."""
        yes, at = self.opened.find(h)
        first, n = self.first[at], self.runs[at]
        r = spread(first, n)
        return np.repeat(yes, n), self.start[r] - np.repeat(self.start[first], n), self.lens[r], self.docs[r]


def _removed(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
    block, known = Block(table), _Told(told)
    step = np.zeros(len(block.data) + 1, np.int32)
    if told.num_rows:
        for sums, base, value, p0, p1, row in block.runs():
            h = hash_spans(sums, p0, p1 + LENGTH)
            i, doc = known.in_whole(h)
            i = i[doc < block.ids[row[i]]]
            np.add.at(step, base + p0[i], 1)
            np.add.at(step, base + p1[i] + LENGTH, -1)
            i, off, n, doc = known.in_runs(h)
            yes = doc < block.ids[row[i]]
            start = base + p0[i[yes]] + off[yes]
            np.add.at(step, start, 1)
            np.add.at(step, start + n[yes] - 1 + LENGTH, -1)
            common, _ = known.common.find(value)
            if len(common):
                own, p = spread_windows(p0, p1, common)
                i, doc = known.in_whole(hash_spans(sums, p, p + LENGTH))
                i = i[doc < block.ids[row[own[i]]]]
                np.add.at(step, base + p[i], 1)
                np.add.at(step, base + p[i] + LENGTH, -1)
    gone = np.cumsum(step[:-1], out=step[:-1]) > 0
    begins = gone.copy()  # of removed runs
    begins[1:] &= ~gone[:-1]
    first = block.offs[:-1][np.diff(block.offs) > 0]
    begins[first] = gone[first]
    step[0] = 0
    np.cumsum(gone, out=step[1:])
    n_bytes, n_removed, n_spans = np.diff(block.offs), np.diff(step[block.offs]), np.diff(np.searchsorted(np.flatnonzero(begins), block.offs))
    ends = np.append(0, np.cumsum(n_bytes - n_removed)).astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), len(n_bytes), [None, pa.py_buffer(ends), pa.py_buffer(block.data[~gone])])
    return pa.table([table.column("doc_id").cast(pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), kept], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, common: int = COMMON) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes (which may cut characters) of every row of docs.

    A byte goes when a 50-byte string that covers it also starts in a document
    with a smaller doc_id. Null counts as empty, and nothing shorter than 50 bytes
    goes. Rows that repeat a doc_id are no smaller than each other and lose
    nothing to each other; rows without an id lose nothing and take nothing. An
    empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks = block_count(rows, block_bytes)
    rows = in_blocks(rows, blocks)
    buckets = 2 * blocks  # where much is shared and differs, a bucket gets more than a block reads
    own = rows.groupBy("block")
    anchors = own.applyInArrow(_anchors(blocks), WIRE)
    shared = anchors.groupBy("key").applyInArrow(_shared(common), WIRE)
    cells = own.cogroup(shared.groupBy("block")).applyInArrow(_cells(buckets), WIRE)
    wanted = cells.groupBy("key").applyInArrow(_wanted, WIRE)
    given = own.cogroup(wanted.groupBy("block")).applyInArrow(_given, WIRE)
    told = cells.groupBy("key").cogroup(given.groupBy("key")).applyInArrow(_sorted, WIRE)
    return own.cogroup(told.groupBy("block")).applyInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeats_digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same by a table of all strings of LENGTH bytes, in hexadecimal.
SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
f AS MATERIALIZED (SELECT g, min(doc_id) AS low FROM p GROUP BY g HAVING min(doc_id) < max(doc_id)),
x AS MATERIALIZED (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM p JOIN f USING (g) WHERE low < doc_id),
y AS (SELECT doc_id, i, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM x),
z AS MATERIALIZED (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM y GROUP BY doc_id, run),
k AS (SELECT doc_id, run, b AS start, lead(a) OVER (PARTITION BY doc_id ORDER BY run) AS stop FROM (SELECT doc_id, run, a, b FROM z UNION ALL SELECT doc_id, 0, NULL, 0 FROM d)),
t AS (SELECT k.doc_id, string_agg(substr(h, 2 * start + 1, 2 * (coalesce(stop, len(h) // 2) - start)), '' ORDER BY run) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id),
n AS (SELECT doc_id, sum(b - a)::BIGINT AS removed, count(*) AS spans FROM z GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)
"""
