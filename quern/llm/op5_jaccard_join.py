"""N-gram Jaccard join by vertical partitioning.

All word n-grams stand in one global order (of their hashes), which is cut into fragments. A fragment
sees every document's n-grams of its range, and so

1. counts each n-gram's documents: one that is in a single document can not be part of an overlap, and
   a document most of whose n-grams are such can not have a link at all. Only n-grams of two documents
   or more leave this step, and only documents enough of whose n-grams did go on. An n-gram that many
   documents of one task have is counted there: it goes to its fragment as one weight, not as documents;
2. counts partial overlaps of candidates, which are summed per pair and compared with the threshold.

Documents with equal n-gram sets (size and two 64-bit sums) form a class, and one of them stands for
it. Candidates share one of the rarest n-grams that a link must hit (prefix filter); what such n-grams
connect is a candidate group. A large group is cut by size into bands, since linked sets differ in size
by no more than the threshold allows, and bands into blocks; blocks of one band or of neighbours are
compared. Of two blocks only rows that share one of their rarest n-grams with the other side go on;
the n-gram order of these is cut into fragments, each fragment's partial overlaps are counted for all
pairs of rows at once and added up. What leaves a task is no pair list (that of a group of copies would
grow with its square) but each row's link to the least row that it reaches there. Every pair of
candidates meets in one task, so no link is lost.

Defined results: a null text counts as empty; a text without words has 0 shingles and no link; a text
with fewer words than n has its whole sequence as one shingle; a very long text is read in pieces and
whole; rows that repeat key and text are links of each other; linked rows with one key are one; null
keys are linked but never name a component; of a component's keys the least names it; an empty table
gives an empty result; other columns are not read, so their names may be any. Keys are integers from
-2**62 to 2**62 - 1. N-grams are compared by 64-bit hashes. Tasks name documents by partition and place,
so ``docs`` has to give the same partitions when it is read again, as files and stored tables do.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import discard, named, release, released, settings, shared_folder, stored, text_batches
from ._text import FOLDED, STEP, chained, mix, slices, word_hashes

N = 5
PERCENT = 80
#: n-grams that a task counts, about; with 500 to a document this gives the number of parts of the n-gram order.
FRAGMENT_GRAMS = 1_500_000
#: n-grams that a task gathers before it deals them out to fragments.
GATHERED = 600_000
#: Documents of a lot at most: within it a document is known by two bytes.
LOT = 1 << 16
#: Bits of a lot's number within its task, and of a task's number.
LOT_BITS, TASK_BITS = 24, 21
#: An n-gram's bytes within its fragment, which has the bits above. Where data are few, one task counts several fragments.
KEY_BYTES = 7
LEAST_BITS = 8
#: Bits of the number of parts, at least: so that it does not follow small inputs, as a document has a row in each part.
LEAST_PARTS = 7
#: Documents of a lot that make an n-gram a common one. Beyond this number, counts do not matter: only their order does.
COMMON = 64
#: n-grams of a fragment when blocks are compared, and rows of a block.
FRAGMENT = 2048
BLOCK = 1000
#: n-grams that are hashed in one go.
STRETCH = 1 << 20
#: Labels from here on stand for rows without a key.
NO_KEY = 1 << 62


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = N) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a slice."""
    hashes, first = word_hashes(data, offsets, FOLDED)
    long = len(hashes) - n + 1
    rolled = np.zeros(max(long, 0), np.uint64)
    for at in range(0, long, STRETCH):
        some = min(long - at, STRETCH)
        rolled[at : at + some] = chained([hashes[at + k : at + k + some] for k in range(n)], n)
    if len(first) == 2 and long > 0:  # one text, maybe a very long one
        del hashes
        rolled.sort()
        return [rolled[np.concatenate([[True], rolled[1:] != rolled[:-1]])]]
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            out.append(chained([hashes[k : k + 1] for k in range(a, b)], int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _keys(packed: bytes | np.ndarray) -> np.ndarray:
    """Keys of KEY_BYTES bytes each, as uint64."""
    raw = np.frombuffer(packed, np.uint8).reshape(-1, KEY_BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :KEY_BYTES] = raw
    return wide.view(np.uint64).reshape(-1)


def _packed(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].reshape(-1)


def _binaries(counts: np.ndarray, width: int, data: np.ndarray) -> pa.Array:
    """Binary values of counts * width bytes each."""
    offsets = np.concatenate([[0], np.cumsum(counts * width)])
    if offsets[-1] >= 1 << 31:
        raise OverflowError("an Arrow batch holds less than 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def _joined(column: pa.ChunkedArray | pa.Array) -> bytes:
    return b"".join(x for x in column.to_pylist() if x)


#: After groups of so many bytes a worker gives unused memory back.
RELEASE_BYTES = 1 << 20

DEALT = "part long, fragment long, lot long, keys binary, counts binary, nodes binary, ids array<long>, sizes array<long>, sums array<long>, mixes array<long>"


def _deal(bits: int, n: int):
    """A task's rows for each fragment (of ``bits`` bits; LEAST_BITS at least): its n-grams, each with the number of documents of the lot that have it (0: it is a common one) and these documents.

    Facts about the documents, and the common n-grams of each, go to groups of negative numbers.
    """

    deep = max(bits, LEAST_BITS)

    def flush(lot: int, sets: list[np.ndarray], ids: list[int | None]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in sets], np.int64)
        every = np.concatenate(sets)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        sums, mixes = (np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (every, mix(every ^ STEP)))
        sums, mixes = sums[bounds[1:]] - sums[bounds[:-1]], mixes[bounds[1:]] - mixes[bounds[:-1]]
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat(np.arange(len(sets)).astype(np.uint16), sizes)[order]
        heads = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        often = np.diff(np.append(heads, len(every)))
        common = often >= COMMON
        of_common = np.repeat(common, often)
        grams = every[heads]
        fragment = (grams >> np.uint64(64 - deep)).astype(np.int64)
        found, at = np.unique(fragment, return_index=True)
        listed = np.where(common, 0, often)
        held = np.diff(np.append(at, len(grams)))
        nodes_in = np.add.reduceat(listed, at) if len(at) else listed
        # the documents' own rows: facts, and their common n-grams
        own = np.argsort(owner[of_common], kind="stable")
        per = np.bincount(owner[of_common], minlength=len(sets)).astype(np.uint32)
        k = len(found)
        spread = -1 - int(mix(np.array([lot], np.uint64))[0] >> np.uint64(64 - bits))
        none = np.zeros(0, np.uint8)
        last = [_binaries(np.array([len(x)]), 1, x) for x in (every[of_common][own].view(np.uint8), per.view(np.uint8), none)]
        first = [
            _binaries(held, KEY_BYTES, _packed(grams & np.uint64((1 << 64 - deep) - 1))),
            _binaries(held, 1, listed.astype(np.uint8)),
            _binaries(nodes_in, 2, owner[~of_common]),
        ]
        facts = [pa.array([None] * k + [x], pa.list_(pa.int64())) for x in (ids, *(x.view(np.int64) for x in (sizes, sums, mixes)))]
        columns = [pa.array([*(found >> deep - bits).tolist(), spread], pa.int64()), pa.array([*found.tolist(), -1], pa.int64()), pa.array(np.full(k + 1, lot)), *(pa.concat_arrays(x) for x in zip(first, last, strict=True)), *facts]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DEALT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        ids: list[int | None] = []
        size, task = 0, TaskContext.get().partitionId()
        if task >> TASK_BITS:
            raise ValueError(f"more than {1 << TASK_BITS} partitions")
        lot = task << LOT_BITS
        for b in (b.slice(at, LOT) for b in batches for at in range(0, b.num_rows, LOT)):
            keys = b.column(0).to_pylist()
            for first, end, data, offsets in slices(b.column(1)):
                found = shingles(data, offsets, n)
                if len(sets) + len(found) > LOT:
                    yield flush(lot, sets, ids)
                    sets, ids, size, lot = [], [], 0, lot + 1
                sets += found
                ids += keys[first:end]
                size += sum(map(len, found)) + len(found)
                if size >= GATHERED:
                    yield flush(lot, sets, ids)
                    sets, ids, size, lot = [], [], 0, lot + 1
        if sets:
            yield flush(lot, sets, ids)

    return run


PARTS = "node long, n int, grams binary, often binary, id long, size long, sum long, mixed long"


def _count(bits: int):
    deep = max(bits, LEAST_BITS)
    names = [x.split()[0] for x in PARTS.split(", ")]

    def rows(node: np.ndarray, n: np.ndarray, grams: np.ndarray, often: np.ndarray, facts: list[pa.Array] | None = None) -> pa.Table:
        facts = facts or [pa.nulls(len(node), pa.int64())] * 4
        return pa.Table.from_arrays([pa.array(node), pa.array(n.astype(np.int32)), _binaries(n, 8, grams), _binaries(n, 1, often), *facts], names=names)

    def of_documents(table: pa.Table) -> pa.Table:
        """Facts and common n-grams, as they came."""
        found = []
        for lot, grams, per, *facts in zip(*(table.column(c).to_pylist() for c in ("lot", "keys", "counts", "ids", "sizes", "sums", "mixes")), strict=True):
            n = np.frombuffer(per, np.uint32).astype(np.int64)
            node = lot << 16 | np.arange(len(n))
            found.append(rows(node, n, np.frombuffer(grams, np.uint64), np.full(n.sum(), COMMON, np.uint8), [pa.array(x, pa.int64()) for x in facts]))
        return pa.concat_tables(found)

    def run(table: pa.Table) -> pa.Table:
        """Of a part of the order: each document's n-grams that others have too, and in how many documents they are."""
        if table.column("part")[0].as_py() < 0:
            return of_documents(table)
        packed = table.column("keys").to_pylist()
        fragment = np.repeat(table.column("fragment").to_numpy().astype(np.uint64) << np.uint64(64 - deep), [len(x) // KEY_BYTES for x in packed])
        keys = _keys(b"".join(packed)) | fragment
        del packed, fragment
        listed = np.frombuffer(_joined(table.column("counts")), np.uint8)
        nodes = np.frombuffer(_joined(table.column("nodes")), np.uint16)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
        weight = np.where(listed == 0, COMMON, listed).astype(np.int64)
        total = np.minimum(np.add.reduceat(weight[order], heads), COMMON).astype(np.uint8) if len(heads) else listed
        often = np.empty(len(keys), np.uint8)
        often[order] = np.repeat(total, np.diff(np.append(heads, len(ranked))))
        del order, ranked
        # of each lot's documents, those of n-grams that are in two or more
        held = np.array([len(x) // 2 for x in table.column("nodes").to_pylist()], np.int64)
        node = np.repeat(table.column("lot").to_numpy() << 16, held) | nodes
        keep = np.repeat(often > 1, listed)
        node, entry = node[keep], np.repeat(np.arange(len(keys)), listed)[keep]
        order = np.argsort(node, kind="stable")
        node, entry = node[order], entry[order]
        heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        out = rows(node[heads], np.diff(np.append(heads, len(node))), keys[entry], often[entry])
        if table.nbytes >= RELEASE_BYTES:
            release()
        return out

    return run


def _least(size: np.ndarray, percent: int) -> np.ndarray:
    """Shared n-grams that a set of this size has with whatever it is linked to, at least."""
    return -(-percent * size // 100)


def _assembled(percent: int):
    """A class's n-grams, the rarest first, and those of them one of which it shares with all that it may be linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = np.array(b.column(1).to_pylist(), np.int64)
            lot = np.cumsum(every + 1000) // GATHERED
            for at in np.flatnonzero(np.diff(lot, prepend=-1)):
                part = b.slice(at, np.searchsorted(lot, lot[at], "right") - at)
                size = every[at : at + part.num_rows]
                segments = [(i, s["grams"], s["often"]) for i, row in enumerate(part.column(2).to_pylist()) for s in row]
                row = np.repeat(np.array([s[0] for s in segments]), [len(s[2]) for s in segments])
                token = np.frombuffer(b"".join(s[1] for s in segments), np.uint64)
                often = np.frombuffer(b"".join(s[2] for s in segments), np.uint8)
                held = np.bincount(row, minlength=len(size))
                order = np.lexsort((token, often, row))
                token = token[order]
                most = np.maximum(held - _least(size, percent) + 1, 0)
                take = np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held) < np.repeat(most, held)
                rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.minimum(held, most))]).astype(np.int32)), pa.array(token[take].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _binaries(held, 8, token), rare], names=["class", "size", "grams", "rare"])

    return run


def _partial_sums(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlaps of all sets of two blocks, counted for one fragment of the n-gram order at a time and summed."""
    flat = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(v) for v in x]), len(x)) for x in ((left,) if left is right else (left, right))]
    if left is right:
        order, n = np.unique(flat[0][0], return_counts=True)
        order = order[n > 1]
    else:
        order = np.intersect1d(flat[0][0], flat[1][0])
    overlap = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(order), FRAGMENT):
        fragment = order[low : low + FRAGMENT]
        sides = []
        for t, r, n in flat:
            inside = np.flatnonzero((t >= fragment[0]) & (t <= fragment[-1]))
            spot = np.searchsorted(fragment, t[inside])
            hit = fragment[spot] == t[inside]
            held = np.zeros((n, len(fragment)), np.float32)
            held[r[inside[hit]], spot[hit]] = 1
            sides.append(held)
        overlap += sides[0] @ sides[-1].T
    return overlap


def _meeting(left: list[np.ndarray], right: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of two blocks that share one of their rarest n-grams (the first a or b of each) with a set of the other block; of the same block, if left is right."""
    flat = [(np.concatenate([v[:k] for v, k in zip(x, most, strict=True)]), np.repeat(np.arange(len(x)), np.minimum([len(v) for v in x], most))) for x, most in ((left, a), (right, b))]
    if left is right:
        grams, n = np.unique(flat[0][0], return_counts=True)
        grams = grams[n > 1]
    else:
        grams = np.intersect1d(flat[0][0], flat[1][0])
    return tuple(np.unique(row[np.isin(rare, grams)]) for rare, row in flat)


def _linked(percent: int):
    """Links of a bin of candidate groups: each row's class with the least class that it reaches there."""

    def run(table: pa.Table) -> pa.Table:
        group, side = (table.column(c).to_numpy() for c in ("group", "side"))
        order = np.lexsort((side, group))
        group, side = group[order], side[order]
        classes, size = (table.column(c).to_numpy()[order] for c in ("class", "size"))
        grams = table.column("grams")
        edges: list[np.ndarray] = []
        for first, end in zip(heads := np.flatnonzero(np.diff(group, prepend=group[0] - 1)), np.append(heads[1:], len(group)), strict=True):
            cut = first + int(np.searchsorted(side[first:end], side[first], "right"))
            rows = [np.arange(first, end)] * 2 if cut == end else [np.arange(first, cut), np.arange(cut, end)]
            sets = [[np.frombuffer(grams[int(order[i])].as_buffer(), np.uint64) for i in x] for x in rows[: 1 + (cut != end)]]
            rarest = [np.maximum([len(v) for v in s] - _least(size[x], percent) + 1, 0) for s, x in zip(sets, rows, strict=False)]
            some = _meeting(sets[0], sets[-1], rarest[0], rarest[-1])
            if not len(some[0]):
                continue
            rows = [x[s] for x, s in zip(rows, some, strict=True)]
            sets = [[s[i] for i in k] for s, k in zip(sets, some, strict=False)]
            overlap = _partial_sums(sets[0], sets[-1])
            total = size[rows[0]][:, None] + size[rows[1]][None, :]
            a, b = np.nonzero(overlap * 100 >= (total - overlap) * percent)
            x, y = rows[0][a] - first, rows[1][b] - first
            label = np.arange(end - first)
            while len(x):  # least row that links reach
                before = label.copy()
                np.minimum.at(label, x, label[y])
                np.minimum.at(label, y, label[x])
                label = label[label]
                if (label == before).all():
                    break
            moved = np.flatnonzero(label != np.arange(end - first))
            edges.append(np.stack([classes[first + moved], classes[first + label[moved]]]))
        x, y = np.concatenate(edges, 1) if edges else np.zeros((2, 0), np.int64)
        if table.nbytes >= RELEASE_BYTES:
            release()
        return pa.Table.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    return run


def _merged(labels: DataFrame, links: DataFrame, folder: str, name: str) -> DataFrame:
    """labels (class, label) after joining the components that links (x, y) connect: least label, by steps with pointer jumping."""
    spark = labels.sparkSession
    of = lambda side: labels.select(F.col("class").alias(side), F.col("label").alias(f"l{side}"))
    edges = links.join(of("x"), "x").join(of("y"), "y").filter("lx != ly").select("lx", "ly")
    edges = stored(edges.unionAll(edges.select(F.col("ly").alias("lx"), F.col("lx").alias("ly"))).distinct(), folder, f"{name}-edges")
    roots = edges.groupBy(F.col("lx").alias("v")).agg(F.least(F.min("ly"), F.col("lx")).alias("root"))
    step = 0
    roots = stored(roots, folder, f"{name}-0")
    while True:
        step += 1
        near = edges.join(roots.select(F.col("v").alias("ly"), "root"), "ly").groupBy(F.col("lx").alias("v")).agg(F.min("root").alias("near"))
        low = roots.select("v", "root").join(near, "v").select("v", F.least("root", "near").alias("low"), F.col("root").alias("was"))
        jump = roots.select(F.col("v").alias("low"), F.col("root").alias("next"))
        roots = low.join(jump, "low", "left").select("v", F.least("low", F.coalesce("next", "low")).alias("root"), "was")
        roots = stored(roots, folder, f"{name}-{step}")
        discard(spark, f"{folder}/{name}-{step - 1}")
        if roots.filter("root != was").isEmpty():
            break
    roots = roots.select(F.col("v").alias("label"), "root")
    merged = stored(labels.join(roots, "label", "left").select("class", F.coalesce("root", "label").alias("label")), folder, f"{name}-labels")
    for used in (f"{name}-{step}", f"{name}-edges"):
        discard(spark, f"{folder}/{used}")
    return merged


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id (the least key that links reach) of every row."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    text_batches(docs.sparkSession)
    slim = docs.select(named(key).cast("long").alias("id"), named(text).alias("text"))
    bits = min(32, max(LEAST_PARTS, ceil(log2(max(1, docs.count() * 500 / FRAGMENT_GRAMS)))))
    dealt = slim.mapInArrow(released(_deal(bits, n)), DEALT)
    parts = stored(dealt.groupBy("part").applyInArrow(_count(bits), PARTS), folder, "parts")

    same = ["size", "sum", "mixed"]
    facts = parts.filter("size is not null").select("id", "node", *same)
    shared = parts.filter("n > 0").select("node", "n", "grams", "often")
    enough = shared.groupBy("node").agg(F.sum("n").alias("held"))
    able = facts.join(enough, "node").filter(F.col("held") * 100 >= F.col("size") * percent)
    # a class is known by the least of its documents
    label = F.coalesce(F.min("id"), F.min("node") + NO_KEY)
    reps = stored(able.groupBy(*same).agg(F.min("node").alias("class"), label.alias("label")), folder, "reps")
    segments = shared.join(reps.filter("size > 0").select(F.col("class").alias("node"), "size"), "node").groupBy("node", "size").agg(F.collect_list(F.struct("grams", "often")).alias("segments"))
    # so few of the rows are wanted that a Bloom filter of the nodes is worth building, if they are not too many for one
    with settings(spark, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0"):
        sets = stored(segments.select("node", "size", "segments").mapInArrow(released(_assembled(percent)), "class long, size long, grams binary, rare array<long>"), folder, "sets")

    # candidate groups: what the rare n-grams connect
    rare = sets.select("class", F.explode("rare").alias("token"))
    leaders = rare.groupBy("token").agg(F.min("class").alias("lead"), F.max("class").alias("other")).filter("lead < other").select("token", "lead")
    near = rare.join(stored(leaders, folder, "leaders"), "token").filter("class != lead").select(F.col("class").alias("x"), F.col("lead").alias("y")).distinct()
    alone = sets.select("class", F.col("class").alias("label"))
    groups = _merged(alone, stored(near, folder, "near"), folder, "groups").withColumnRenamed("label", "group")
    counts = groups.groupBy("group").agg(F.count("*").alias("rows")).filter("rows > 1")
    counts = stored(counts, folder, "counts")
    # sets of a band differ from those of the bands beside it by more than linked sets may; a little more leaves room for rounding
    band = F.floor(F.log("size") / log(100 / percent * 1.01)).cast("long").alias("band")
    placed = groups.join(counts, "group").select("class", "group", "rows").join(sets.select("class", "size", "grams", band), "class")
    bins = max(1, sets.count() // BLOCK)
    small = placed.filter(F.col("rows") <= BLOCK).select(F.pmod(F.xxhash64("group"), F.lit(bins)).alias("bin"), "group", F.lit(0).cast("long").alias("side"), "class", "size", "grams")
    # a row of a large group goes to each pair of blocks that its own is in
    wide = placed.filter(F.col("rows") > BLOCK)
    bands = wide.groupBy("group", "band").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    bands = stored(bands.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("bands")), folder, "bands")
    place = lambda b, k: F.shiftleft(b, 32) + k
    blocks_of = lambda b: F.transform(F.sequence(F.lit(0).cast("long"), F.col("bands")[b] - 1), lambda k: place(b, k))
    beside = F.flatten(F.transform(F.filter(F.array(*(F.col("band") + d for d in (-1, 0, 1))), lambda b: F.array_contains(F.map_keys("bands"), b)), blocks_of))
    wide = wide.join(bands, "group").withColumn("block", place(F.col("band"), F.pmod(F.xxhash64("class"), F.col("bands")[F.col("band")]))).withColumn("partner", F.explode(beside))
    pair = F.xxhash64("group", F.least("block", "partner"), F.greatest("block", "partner"))
    wide = wide.select(pair.alias("bin"), pair.alias("group"), F.col("block").alias("side"), "class", "size", "grams")
    links = stored(small.unionAll(wide).groupBy("bin").applyInArrow(_linked(percent), "x long, y long").distinct(), folder, "links")
    labels = _merged(reps.select("class", "label"), links, folder, "components")
    # of classes of one key the name is that key's already
    labels = stored(labels.join(reps.select("class", *same), "class").select(*same, "label"), folder, "labels")
    for used in ("sets", "leaders", "near", "groups-labels", "counts", "bands", "links", "reps", "components-labels"):
        discard(spark, f"{folder}/{used}")

    found = facts.join(labels, same, "left")
    reached = F.when(F.col("label") < NO_KEY, F.col("label")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(key), F.col("size").alias("n_shingles"), reached.alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLE_SQL: dict[str, str] = {}
