"""Near-duplicate records: an exact similarity join on sets of words or of word shingles.

Records with the same set form one class and are joined once.  Every set is ordered rare-first by a
count-min sketch of fixed size, which knows every element however many there are (a count that is
too high changes only the order, which is the same for all sets), and only the prefix that a partner must touch is indexed.  A pair that meets in a prefix must pass
the length filter, the positional filter and a suffix filter (the Hamming distance of two 128-bit
bitmaps never exceeds that of the sets); what remains is verified once on the whole sets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import pick, stored

WORD = re.compile(r"[^\W_]+")
SKETCH = 1 << 20  #: counters in each of two rows: element counts are known to the larger of what shares them
BLOCK_ROWS = 16_384  #: the index of an element that more records hold is cut into blocks of about this many
TILE_CELLS = 500_000
INDEX, PROBE, BOTH = range(3)
_HASH_MASK = (1 << 56) - 1


def words(text: str) -> list[str]:
    """Maximal runs of letters or digits, in lower case."""
    return WORD.findall(text.lower())


def elements(text: str, shingle: int) -> set[str]:
    """The set a record is compared by: its words, or its runs of ``shingle`` words (the whole
    sequence as one element if it is shorter)."""
    found = words(text)
    if shingle <= 1:
        return set(found)
    if len(found) <= shingle:
        return {" ".join(found)} if found else set()
    return {" ".join(found[i : i + shingle]) for i in range(len(found) - shingle + 1)}


def counters(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two counters of the sketch that count an element."""
    return hashes % SKETCH, SKETCH + (hashes >> 24) % SKETCH


def least_overlap(n: int, m: int, threshold: float) -> int:
    return math.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)


def similar_classes(df: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """``members(id, class)`` and ``pairs(class_a, class_b, overlap, size_a, size_b)``, class_a < class_b.

    Rows with a null id or text, or without any word, belong to no class.  Rows that repeat an id
    with the same set count once; an id with different texts is a member of several classes.

    A class is 63 bits of a hash of its set.  Members are never gathered: copies are counted and
    joined as rows, however many share a class.
    """

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            ids, names, offsets, values = [], [], [0], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = []
                for w in elements(text, shingle):
                    h = seen.get(w)
                    if h is None:
                        h = xxhash.xxh3_64_intdigest(w) & _HASH_MASK
                        if len(seen) < 200_000:
                            seen[w] = h
                    hashes.append(h)
                if hashes:
                    row = np.unique(np.array(hashes, dtype=np.int64))
                    ids.append(key)
                    names.append(xxhash.xxh3_64_intdigest(row.tobytes()) >> 1)
                    values.append(row)
                    offsets.append(offsets[-1] + len(row))
            lists = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.string()), pa.array(names, type=pa.int64()), lists], names=["id", "class", "set"])

    rows = pick(df, id=id_col, text=text_col).where("id is not null and text is not null")
    sets = stored(rows.select(F.col("id").cast("string"), "text").mapInArrow(to_sets, "id string, class bigint, set array<bigint>"), "word-sets")
    members = sets.select("id", "class").distinct()
    classes = sets.groupBy("class").agg(F.first("set").alias("set"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SKETCH, dtype=np.int64)
        for batch in batches:
            for slot in counters(batch.column(0).flatten().to_numpy()):
                total += np.bincount(slot, minlength=2 * SKETCH)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    held = sets.select("set").mapInArrow(counts, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # a row a counter at most
    sketch = np.zeros(2 * SKETCH, dtype=np.int64)
    sketch[held.column("slot").to_numpy()] = held.column("n").to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(sketch)

    def to_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        for batch in batches:
            lists = batch.column(1)
            values, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            one, other = counters(values)
            ranks = np.minimum(sketch[one], sketch[other])
            cut = -(-ranks // BLOCK_ROWS)
            n = np.diff(offsets).astype(np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((values, ranks, owner))
            values, cut = values[order], cut[order]
            pos = np.arange(len(values)) - np.repeat(offsets[:-1], n)
            bit = (values ^ (values >> 23)) & 127
            one = np.left_shift(np.int64(1), bit & 63)
            low = np.bitwise_or.reduceat(np.where(bit < 64, one, 0), offsets[:-1]) if len(n) else np.zeros(0, dtype=np.int64)
            high = np.bitwise_or.reduceat(np.where(bit >= 64, one, 0), offsets[:-1]) if len(n) else np.zeros(0, dtype=np.int64)
            probe = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            index = n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int64) + 1
            keep = np.flatnonzero(pos < probe[owner])
            names = batch.column(0).to_numpy()
            indexed = (pos < index[owner])[keep]
            # One row in the only block of its element; in a hot element, an index row in the block
            # of the class and a probe in every block.
            single, hot = keep[cut[keep] == 1], keep[cut[keep] > 1]
            home = keep[indexed & (cut[keep] > 1)]
            many = np.repeat(hot, cut[hot])
            row = np.concatenate([single, home, many])
            block = np.concatenate([np.zeros(len(single), dtype=np.int64), names[owner[home]] % cut[home], np.arange(len(many)) - np.repeat(np.cumsum(cut[hot]) - cut[hot], cut[hot])])
            kind = np.repeat([BOTH, INDEX, PROBE], [len(single), len(home), len(many)])
            who = owner[row]
            packed = (n[who] << 32) | (pos[row] << 4) | ((pos[row] < index[who]).astype(np.int64) << 2) | kind
            cols = [values[row], block.astype(np.int32), packed, names[who], low[who], high[who]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["t", "s", "m", "c", "b0", "b1"])

    prefixes = classes.select("class", "set").mapInArrow(to_prefixes, "t bigint, s int, m bigint, c bigint, b0 bigint, b1 bigint")
    met = prefixes.repartition("t", "s").sortWithinPartitions("t", "s", F.expr("m & 3")).mapInArrow(lambda batches: _meetings(batches, threshold), "a bigint, b bigint")
    candidates = met.distinct()
    whole = classes.select("class", "set")
    verified = (
        candidates.join(whole.select(F.col("class").alias("a"), F.col("set").alias("set_a")), "a")
        .join(whole.select(F.col("class").alias("b"), F.col("set").alias("set_b")), "b")
        .select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("overlap"), F.size("set_a").alias("na"), F.size("set_b").alias("nb"))
        .where(F.col("overlap") >= threshold * (F.col("na") + F.col("nb") - F.col("overlap")) - 1e-9)
    )
    forward = F.col("a") < F.col("b")
    pairs = verified.select(
        F.least("a", "b").alias("class_a"),
        F.greatest("a", "b").alias("class_b"),
        "overlap",
        F.when(forward, F.col("na")).otherwise(F.col("nb")).alias("size_a"),
        F.when(forward, F.col("nb")).otherwise(F.col("na")).alias("size_b"),
    )
    return members, pairs


def _passing(x: tuple, y: tuple, threshold: float) -> np.ndarray:
    """Whether rows ``x`` and ``y`` (size and position, class, bitmaps; broadcast against each
    other) may be similar: ``y`` is an index row of a class that comes before that of ``x`` by
    size, and length, positional and suffix filter let the pair through."""
    (xm, xc, x0, x1), (ym, yc, y0, y1) = x, y
    nx, ny = xm >> 32, ym >> 32
    ok = ((ny < nx) | ((ny == nx) & (yc < xc))) & ((ym & 4) > 0) & (ny >= nx * threshold - 1e-9)
    need = np.ceil(threshold / (1 + threshold) * (nx + ny) - 1e-9).astype(np.int64)
    ok &= np.minimum(nx - ((xm >> 4) & 0xFFFFFFF), ny - ((ym >> 4) & 0xFFFFFFF)) >= need
    differ = np.bitwise_count(x0 ^ y0).astype(np.int16)
    differ += np.bitwise_count(x1 ^ y1)
    return ok & (differ <= nx + ny - 2 * need)


def _tile(x: tuple, y: tuple, threshold: float, out: list) -> None:
    """All passing pairs of a row of ``x`` and one of ``y``, a block of cells at a time."""
    by_size = np.argsort(y[0] >> 32, kind="stable")
    y = tuple(c[by_size] for c in y)
    sizes = y[0] >> 32
    step = max(1, TILE_CELLS // max(1, len(sizes)))
    order = np.argsort(x[0] >> 32, kind="stable")
    for lo in range(0, len(order), step):
        part = tuple(c[order[lo : lo + step], None] for c in x)
        a = np.searchsorted(sizes, int(np.floor((part[0][0, 0] >> 32) * threshold - 1e-9)))
        b = np.searchsorted(sizes, int(part[0][-1, 0] >> 32), side="right")
        if a < b:
            i, j = np.nonzero(_passing(part, tuple(c[None, a:b] for c in y), threshold))
            out.append((part[1][i, 0], y[1][a + j]))


def _meetings(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Candidate pairs from prefix rows sorted by element, block and kind."""
    near, out = 24, []
    open_key, index = None, None  # a run that goes on in the next batch
    names = ("m", "c", "b0", "b1")

    def done(index: tuple | None, out: list) -> None:
        if index is not None and len(index[1]) > 1 and (index[0][0] & 3) == BOTH:
            _tile(index, tuple(c[(index[0] & 4) > 0] for c in index), threshold, out)

    for batch in batches:
        if not batch.num_rows:
            continue
        t, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rows = tuple(batch.column(batch.schema.get_field_index(n)).to_numpy() for n in names)
        rows = (*rows[:2], rows[2].view(np.uint64), rows[3].view(np.uint64))  # all 64 bits count
        kind = rows[0] & 3
        edge = np.flatnonzero((t[1:] != t[:-1]) | (s[1:] != s[:-1])) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(t)]])
        small = (ends - starts <= near) & (kind[starts] == BOTH)
        small[[0, -1]] = False
        inside = np.repeat(small, ends - starts)
        run = np.repeat(np.arange(len(starts)), ends - starts)
        for d in range(1, near):
            i = np.flatnonzero(inside[:-d] & (run[:-d] == run[d:])) if len(run) > d else np.zeros(0, dtype=np.int64)
            if not len(i):
                break
            for x, y in ((i, i + d), (i + d, i)):
                hit = _passing(tuple(c[x] for c in rows), tuple(c[y] for c in rows), threshold)
                if hit.any():
                    out.append((rows[1][x[hit]], rows[1][y[hit]]))
        for r in np.flatnonzero(~small):
            lo, hi = starts[r], ends[r]
            key = (t[lo], s[lo])
            if key != open_key:
                done(index, out)
                open_key, index = key, None
            held = hi if kind[lo] == BOTH else lo + int((kind[lo:hi] == INDEX).sum())
            if held > lo:
                own = tuple(c[lo:held] for c in rows)
                index = own if index is None else tuple(np.concatenate(z) for z in zip(index, own, strict=True))
            if held < hi and index is not None:
                _tile(tuple(c[held:hi] for c in rows), index, threshold, out)
        if sum(len(x) for x, _ in out) > 50_000:
            yield _pairs_batch(out)
            out = []
    done(index, out)
    yield _pairs_batch(out)


def _pairs_batch(out: list) -> pa.RecordBatch:
    a, b = (np.concatenate([x[j] for x in out]) if out else np.zeros(0, dtype=np.int64) for j in range(2))
    ab = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])


def near_duplicates(df: DataFrame, id_col: str = "id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """``(id, class, copies, links)``: one row per id and set: its class, how many ids share the
    set, and how many other classes are at least ``threshold`` similar (Jaccard) to it.

    See :func:`similar_classes` for null, empty and repeated rows.  An empty table gives no rows.
    """
    members, pairs = similar_classes(df, id_col, text_col, threshold, shingle)
    ends = pairs.select(F.col("class_a").alias("class")).unionAll(pairs.select(F.col("class_b").alias("class")))
    links = ends.groupBy("class").agg(F.count("*").alias("links"))
    copies = members.groupBy("class").agg(F.count("*").alias("copies"))
    per_class = copies.join(links, "class", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return members.join(per_class, "class").select("id", "class", "copies", "links")


def near_duplicate_pairs(df: DataFrame, id_col: str = "id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """``(id_a, id_b)`` with id_a < id_b: all pairs of ids whose sets are similar, copies expanded.

    The rows number as many as there are such pairs; :func:`near_duplicates` has one row per id.
    """
    members, pairs = similar_classes(df, id_col, text_col, threshold, shingle)
    a = members.select(F.col("id").alias("x"), F.col("class").alias("class_a"))
    b = members.select(F.col("id").alias("y"), F.col("class").alias("class_b"))
    across = pairs.select("class_a", "class_b").join(a, "class_a").join(b, "class_b").where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    shared = members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class").alias("class_a"))
    within = a.join(shared, "class_a").join(b.withColumnRenamed("class_b", "class_a"), "class_a").where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return across.unionByName(within).distinct()
