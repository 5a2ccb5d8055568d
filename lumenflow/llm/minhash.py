"""Near-duplicates by MinHash with sequential Bayesian verification.

1. A pass over the texts gives each document's set of word shingles as a size, a
   key (equal for equal sets) and a signature of `bands * rows` minima. Documents
   with equal sets are one class from here on, however many they are.
2. Classes whose signatures agree in a whole band are candidates. In each band's
   bucket all members meet the bucket's two ends (smallest and largest id), which
   are rows in proportion to the members.
3. A candidate's signatures are compared batch by batch. After each batch the
   posterior (uniform prior) that the similarity reaches the threshold is looked
   up, and the pair goes when it is below `miss`.
4. Survivors are verified on the full sets of their whole texts: first each
   class with its most similar end, then all pairs that still lie in different
   components.
5. What is left are pairs of a bucket's inner members. Survivors make clusters, and
   buckets whose inner members lie in several clusters are gone through in parts of
   bounded size: each pair of parts is a task, which prunes as before and puts
   out only survivors that connect clusters anew. Similar sets are of similar size, so
   members are dealt by classes of size, and only parts of the same or neighbouring
   classes meet. A cluster so completed that holds several components of verified
   links is cut into chunks likewise: there a set can share no more than what occurs
   in the other chunk at all, which with the sizes rules most pairs out; the others
   are compared and verified as before, and only links that connect something new
   are put out.
6. Components of the verified links, found without the driver, are the groups.

The rules are the same for buckets of all sizes: a pair that agrees in one band is a
candidate. At 40 bands of 6 rows, a pair at the threshold 0.8 fails to agree in any
band with probability 5e-6. Tasks are of bounded size, but their number grows with
the square of the members of one size class of one bucket or cluster that aren't
connected yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, mixed, raw, shingles, steps, stored, unused, word_hashes
from .graph import components, extended

BANDS, ROWS, BATCH = 40, 6, 40
#: Members of a part of a bucket at least, and at least so many times the root of all members: the rows sent to tasks
#: grow with the power 1.5 of a bucket's members. Rows of tasks that are worked off together.
PART, PART_ROOT, SLOT_ROWS = 512, 8, 4096
#: Members of a chunk, and ids up to which a list of documents is sent to all executors to pick their texts.
CHUNK, SENT_IDS = 256, 500_000
_rng = np.random.Generator(np.random.PCG64(5))
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for i, j in steps(offs):
        part = offs[i : j + 1]
        hashes, row = word_hashes(data[part[0] : part[-1]], part - part[0])
        s, own = shingles(hashes, row, j - i, k)
        cut = np.searchsorted(own, np.arange(j - i + 1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield np.unique(s[a:b])


def signature(s: np.ndarray) -> np.ndarray:
    """16 bits of each minimum of BANDS * ROWS hashes over the set."""
    least = np.full(len(_A), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(least, (_A[:, None] * s[None, at : at + 2048] + _B[:, None]).min(1), out=least)
    return ((least >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.uint16)


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, sig = [], [], []
            for s in shingle_sets(*raw(b.column(1)), k):
                n.append(len(s))
                key.append(np.array([len(s), mixed(s).sum(), mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64).tobytes() if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "digest", "n_shingles", "key", "sig"])

    return run


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """Signatures (rows x BANDS*ROWS) to band hashes (rows x BANDS)."""
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sigs), BANDS)) * np.uint64(0x9E3779B97F4A7C15)
    parts = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        h = mixed(h ^ parts[:, :, r]) + np.uint64(r)
    return h


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BANDS * ROWS)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), 1000):
            part = b.slice(at, 1000)
            keys = band_keys(_matrix(part.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["band", "rep"])


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """For each number of compared hashes, the fewest matches with which the posterior of reaching threshold is miss or more."""
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:  # P(J >= t | m of n match), J uniform before = P(Binomial(n + 1, t) <= m)
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _pruned(threshold: float, miss: float):
    bounds = least_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.slice(at, 2000)
                x, y = _matrix(part.column(2)), _matrix(part.column(3))
                left, done, m = np.arange(len(part)), 0, np.zeros(len(part), np.int64)
                for n, least in bounds:
                    m = m[: len(left)] + (x[left, done:n] == y[left, done:n]).sum(1)
                    stay = m >= least
                    left, m, done = left[stay], m[stay], n
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(left)), part.column(1).take(pa.array(left)), pa.array(m, pa.int64())], names=["x", "p", "equal"])

    return run


def _verified(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (s, t) in enumerate(zip(shingle_sets(*raw(b.column(2)), k), shingle_sets(*raw(b.column(3)), k), strict=True)):
                both = len(np.intersect1d(s, t, assume_unique=True))
                if len(s) and len(t) and 100 * both >= percent * (len(s) + len(t) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return run


class Forest:
    """Which labels hang together so far."""

    def __init__(self, labels: np.ndarray):
        self.parent = {int(c): int(c) for c in labels}

    def root(self, c: int) -> int:
        while self.parent[c] != c:
            self.parent[c] = c = self.parent[self.parent[c]]
        return c

    def join(self, a: int, b: int) -> None:
        self.parent[max(a, b)] = min(a, b)


def _similar(sig: np.ndarray, i: int, j: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Those of the rows j whose signatures may belong to sets similar to row i's, the most similar first."""
    m, done = np.zeros(len(j), np.int64), 0
    for size, least in bounds:
        m = m + (sig[j, done:size] == sig[i, done:size]).sum(1)
        j, m, done = j[m >= least], m[m >= least], size
    return j[np.argsort(-m, kind="stable")]


def _chunk_links(k: int, percent: int, miss: float):
    """Links between the two sides of a pair of chunks, as many as connect something new."""
    bounds = least_matches(percent / 100, miss)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids, comp, side = (np.asarray(t.column(c)) for c in ("rep", "c", "side"))
        sets = list(shingle_sets(*raw(t.column("text")), k))
        sig = _matrix(t.column("sig").combine_chunks())
        n = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(right):  # a chunk of many small components with itself
            left = right = np.arange(len(ids))
        share = np.zeros(len(ids), np.int64)  # shingles that occur on the other side
        for mine, other in ((left, right), (right, left)):
            every, count = np.unique(np.concatenate([sets[i] for i in other]), return_counts=True)
            every = every[count > 1] if left is right else every
            for i in mine:
                share[i] = np.isin(sets[i], every, assume_unique=True).sum()
        forest = Forest(comp)
        a, b = [], []
        for i in left:
            j = right[right > i] if left is right else right
            most = np.minimum(share[i], share[j])
            j = j[(comp[j] != comp[i]) & (100 * most >= percent * (n[i] + n[j] - most))]
            for x in _similar(sig, i, j, bounds):
                ri, rx = forest.root(int(comp[i])), forest.root(int(comp[x]))
                if ri == rx:
                    continue
                both = len(np.intersect1d(sets[i], sets[x], assume_unique=True))
                if 100 * both >= percent * (n[i] + n[x] - both):
                    forest.join(ri, rx)
                    a.append(ids[i])
                    b.append(ids[x])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _part_survivors(threshold: float, miss: float):
    """Survivors between the two sides of each of some tasks, as many as connect clusters anew in their task."""
    bounds = least_matches(threshold, miss)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        tasks, ids, comp, side = (np.asarray(t.column(c)) for c in ("task", "rep", "c", "side"))
        sig = _matrix(t.column("sig").combine_chunks())
        order = np.argsort(tasks, kind="stable")
        cut = np.append(np.flatnonzero(np.append(True, tasks[order][1:] != tasks[order][:-1])), len(order))
        x, p = [], []
        for at, end in zip(cut[:-1], cut[1:], strict=True):
            own = order[at:end]
            left, right = own[side[own] == 0], own[side[own] == 1]
            alone = not len(right)  # a part with itself
            forest = Forest(comp[own])
            for n, i in enumerate(left):
                j = left[n + 1 :] if alone else right
                for y in _similar(sig, i, j[comp[j] != comp[i]], bounds):
                    ri, ry = forest.root(int(comp[i])), forest.root(int(comp[y]))
                    if ri != ry:
                        forest.join(ri, ry)
                        x.append(max(ids[i], ids[y]))
                        p.append(min(ids[i], ids[y]))
        return pa.table({"x": pa.array(x, pa.int64()), "p": pa.array(p, pa.int64())})

    return run


def _cluster_links(nodes: DataFrame, texts: DataFrame, sigs: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """Links inside clusters between components; nodes(rep, cluster, c), sigs(rep, sig, cls)."""
    sizes = nodes.groupBy("cluster", "c").agg(F.count(F.lit(1)).alias("size"))
    open_ = sizes.groupBy("cluster").agg(F.count(F.lit(1)).alias("comps")).where("comps > 1").select("cluster")
    rows = stored(nodes.join(sizes.join(open_, "cluster"), ["cluster", "c"]).join(sigs.select("rep", "cls"), "rep"), "open-nodes")
    # A large component has chunks of its own; whole small components share chunks. Either has them for each class of sizes.
    rows = rows.withColumn("own", F.when(F.col("size") > CHUNK, F.col("c")).otherwise(-1))
    counts = rows.groupBy("cluster", "own", "cls").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    part = F.pmod(F.xxhash64(F.when(F.col("own") == -1, F.col("c")).otherwise(F.col("rep"))), F.col("parts")).cast("long")
    rows = stored(rows.join(counts, ["cluster", "own", "cls"]).select("rep", "cluster", "c", "own", "cls", part.alias("part")), "chunk-rows")
    chunks = stored(rows.select("cluster", "own", "cls", "part").distinct(), "chunks")
    other = chunks.select("cluster", F.col("own").alias("own2"), F.col("cls").alias("cls2"), F.col("part").alias("part2"))
    near = chunks.withColumn("cls2", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)))
    one, two = F.struct("own", "cls", "part"), F.struct(F.col("own2").alias("own"), F.col("cls2").alias("cls"), F.col("part2").alias("part"))
    small = (F.col("own") == -1) & (F.col("own2") == -1)
    pairs = stored(near.join(other, ["cluster", "cls2"]).where(((one < two) & (F.col("own") != F.col("own2"))) | ((one <= two) & small)), "chunk-pairs")
    task = F.xxhash64("cluster", "own", "cls", "part", "own2", "cls2", "part2").alias("task")
    first = pairs.join(rows, ["cluster", "own", "cls", "part"]).select(task, "rep", "c", F.lit(0).alias("side"))
    second = pairs.where(one != two).join(rows.withColumnsRenamed({"own": "own2", "cls": "cls2", "part": "part2"}), ["cluster", "own2", "cls2", "part2"]).select(task, "rep", "c", F.lit(1).alias("side"))
    full = rows.select("rep").join(texts, "rep").join(sigs.select("rep", "sig"), "rep")
    work = first.unionByName(second).join(stored(full, "chunk-texts"), "rep")
    return stored(work.groupBy("task").applyInArrow(_chunk_links(k, percent, miss), "a long, b long"), "links")


def _digest(text: Column) -> Column:
    """Tells the texts of one id apart, where rows repeat it."""
    return F.xxhash64(text.cast("string"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _digest(F.col(text_col)).alias("digest"))


def _picked(base: DataFrame, wanted: DataFrame, reps: DataFrame) -> DataFrame:
    """rep and text of some classes, each by the row that stands for it. A short list goes to where the texts are; beyond that both are dealt by id."""
    ids = stored(reps.join(wanted, "rep").select("rep", "own.doc_id", "own.digest"), "ids")
    ids = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    return stored(base.join(ids, ["doc_id", "digest"]).dropDuplicates(["rep"]).select("rep", "text"), "texts")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Sets are the distinct shingles of k lower-cased words; a shorter text's whole
    sequence is its one shingle; a text without words (null, empty, blank) has the
    empty set and is linked with nothing. Documents are linked when
    100 * intersection >= percent * union, and component_id is the smallest
    doc_id reachable. Repeated rows each get the same row. Rows that repeat an id with
    another text are one document with several sets: it is linked with what any of
    them is linked with, but a row of it without words with nothing. Rows without an id can neither be named nor name a
    group: they are linked with nothing, their component_id is null and they are kept.
    An empty table gives no rows; other columns are ignored. Texts are taken whole, one
    at a time where they are long. Shingles are told apart by 64-bit hashes.
    """
    return _grouped(docs, k, percent, miss, id_col, text_col).drop("digest")


def _grouped(docs: DataFrame, k: int, percent: int, miss: float, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates with the digest of each row's text."""
    base = _texts(batched(docs), id_col, text_col)
    signed = stored(base.mapInArrow(_signed(k), "doc_id long, digest long, n_shingles long, key binary, sig binary"), "signed")
    named_ = signed.where("key IS NOT NULL AND doc_id IS NOT NULL")
    # Sets of similar size are in the same or in neighbouring classes.
    cls = F.floor(F.log(F.first("n_shingles")) / float(np.log(100 / percent) * 1.0001)).alias("cls")
    # A class is a set, with a number of its own and a row that stands for it; an id may stand for several.
    reps = named_.groupBy("key").agg(F.min(F.struct("doc_id", "digest")).alias("own"), F.first("sig").alias("sig"), cls)
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()), "classes")
    sigs = reps.select("rep", "sig", "cls")
    bands = sigs.select("rep", "sig").mapInArrow(_banded, "band long, rep long")
    buckets = stored(bands.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi"), "buckets")
    members = stored(bands.join(buckets, "band"), "members")

    def pruned(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sigs.select(F.col("rep").alias("x"), F.col("sig").alias("sx")), "x").join(sigs.select(F.col("rep").alias("p"), F.col("sig").alias("sp")), "p")
        return stored(both.select("x", "p", "sx", "sp").mapInArrow(_pruned(percent / 100, miss), "x long, p long, equal long"), "survivors")

    def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        both = pairs.select("x", "p").join(texts.select(F.col("rep").alias("x"), F.col("text").alias("tx")), "x").join(texts.select(F.col("rep").alias("p"), F.col("text").alias("tp")), "p")
        return stored(both.select("x", "p", "tx", "tp").mapInArrow(_verified(k, percent), "a long, b long"), "links")

    def across(pairs: DataFrame, comps: DataFrame, x: str, p: str) -> DataFrame:
        """Those pairs whose ends lie in different components."""
        cx, cp = comps.select(F.col("node").alias(x), F.col("component").alias("cx")), comps.select(F.col("node").alias(p), F.col("component").alias("cp"))
        return pairs.join(cx, x, "left").join(cp, p, "left").where(F.coalesce("cx", x) != F.coalesce("cp", p)).drop("cx", "cp")

    ends = members.select(F.col("rep").alias("x"), F.explode(F.array("lo", "hi")).alias("p")).where("x <> p")
    found = pruned(ends.select(F.greatest("x", "p").alias("x"), F.least("x", "p").alias("p")).distinct())
    both = lambda pairs: pairs.select(F.explode(F.array("x", "p")).alias("rep")).distinct()
    clusters = components(found, "x", "p")
    more = _remaining(members, clusters, sigs, percent / 100, miss)
    if more.take(1):
        clusters = extended(clusters, more, "x", "p")
    texts = _picked(base, both(found.select("x", "p").unionByName(more)), reps)
    best = found.groupBy("x").agg(F.max(F.struct("equal", (-F.col("p")).alias("p"))).alias("top")).select("x", (-F.col("top.p")).alias("p"))
    links = verified(best, texts)
    comps = components(links)
    rest = stored(across(found.join(best, ["x", "p"], "left_anti"), comps, "x", "p"), "rest")
    if rest.take(1):
        comps = extended(comps, verified(rest, texts))
    same = stored(_same_document(named_, reps), "same-document")
    if same.take(1):
        comps = extended(comps, same)
    nodes = clusters.withColumnRenamed("component", "cluster").join(comps, "node", "left").select(F.col("node").alias("rep"), "cluster", F.coalesce("component", "node").alias("c"))
    comps = extended(comps, _cluster_links(stored(nodes, "nodes"), texts, sigs, k, percent, miss))
    named = stored(reps.select("key", "rep", F.col("own.doc_id").alias("least")).join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "least", F.coalesce("component", "rep").alias("component")), "named")
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "component").select("key", "component_id")
    rows = signed.select("doc_id", "digest", "n_shingles", "key")
    has = F.col("key").isNotNull() & F.col("doc_id").isNotNull()
    # Rows without a set or an id need no name, and would meet in one task.
    out = rows.where(has).join(named, "key").drop("key").unionByName(rows.where(~has).select("doc_id", "digest", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "digest", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _same_document(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Links a, b between the classes of ids that stand for several sets; rows(doc_id, key)."""
    several = rows.groupBy("doc_id").agg(F.min("key").alias("k0"), F.max("key").alias("k1")).where("k0 < k1").select("doc_id")
    sets = rows.join(several, "doc_id").select("doc_id", "key").distinct().join(reps.select("key", "rep"), "key")
    first = sets.groupBy("doc_id").agg(F.min("rep").alias("b"))
    return sets.join(first, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")


def _remaining(members: DataFrame, clusters: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Survivors x > p of buckets' inner members, as many as connect different clusters in a task; sigs(rep, sig, cls)."""
    inner = members.where("n > 3 AND rep <> lo AND rep <> hi").join(clusters.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("c"))
    several = inner.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("band")
    inner = stored(inner.join(stored(several, "open"), "band").join(sigs.select("rep", "cls"), "rep"), "inner")
    n = F.count(F.lit(1))
    counts = stored(inner.groupBy("band", "cls").agg(F.ceil(n / F.greatest(F.lit(PART), PART_ROOT * F.sqrt(n))).cast("long").alias("parts")), "parts")
    above = counts.select("band", (F.col("cls") - 1).alias("cls"), F.col("parts").alias("above"))
    below = counts.select("band", (F.col("cls") + 1).alias("cls"), F.col("parts").alias("below"))
    around = counts.join(above, ["band", "cls"], "left").join(below, ["band", "cls"], "left")
    rows = inner.join(around, ["band", "cls"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    # Each part goes to one task for each part of its own class, itself included, and of the classes above and below.
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).otherwise(F.array().cast("array<bigint>"))
    mate = lambda of, low, high, side: F.transform(upto(of), lambda m: F.struct(low(m).alias("low"), high(m).alias("high"), F.lit(of == "parts").alias("own"), side(m).cast("int").alias("side")))
    part = F.col("part")
    mates = F.concat(
        mate("parts", lambda m: F.least(part, m), lambda m: F.greatest(part, m), lambda m: part > m),
        mate("above", lambda m: part, lambda m: m, lambda m: F.lit(False)),
        mate("below", lambda m: m, lambda m: part, lambda m: F.lit(True)),
    )
    base = F.when(F.col("mate.own") | (F.col("mate.side") == 0), F.col("cls")).otherwise(F.col("cls") - 1)
    task = F.xxhash64("band", base, "mate.own", "mate.low", "mate.high").alias("task")
    work = stored(rows.withColumn("mate", F.explode(mates)).select(task, "rep", "c", F.col("mate.side").alias("side")), "tasks")
    spark = members.sparkSession
    slots = max(work.count() // SLOT_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    work = work.join(sigs.select("rep", "sig"), "rep").withColumn("slot", F.pmod("task", F.lit(slots)))
    return stored(work.groupBy("slot").applyInArrow(_part_survivors(threshold, miss), "x long, p long").distinct(), "remaining")


def near_duplicate_filter(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document, that of the smallest id, of each group of near-duplicates, with their columns; rows without an id stay.

    Rows that repeat an id with another text are judged one by one. Columns of docs may
    have any names.
    """
    gone, text = unused(docs, "gone"), unused(docs, "text_digest")
    grouped = _grouped(docs, k, percent, 1e-6, id_col, text_col).where(~F.col("kept"))
    ids = stored(grouped.select(F.col("doc_id").alias(gone), F.col("digest").alias(text)).distinct(), "gone")
    ids = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    return docs.join(ids, (F.col(id_col).cast("long") == F.col(gone)) & (_digest(F.col(text_col)) == F.col(text)), "left_anti")


#: The same by all pairs that share a shingle, for k = 4 and 80 per cent.
SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
c AS MATERIALIZED (SELECT md5(array_to_string(list_sort(s), chr(10))) AS key, min(doc_id) AS rep, any_value(s) AS s FROM s WHERE len(s) > 0 GROUP BY key),
g AS MATERIALIZED (SELECT rep, len(s) AS n, md5_number(unnest(s)) AS g FROM c),
e AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM g a JOIN g b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r(node, low) AS (SELECT rep, rep FROM c UNION SELECT x.b, r.low FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) x ON x.a = r.node WHERE r.low < x.b),
m AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(m.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON len(s.s) > 0 AND c.key = md5(array_to_string(list_sort(s.s), chr(10))) LEFT JOIN m ON m.node = c.rep
"""
