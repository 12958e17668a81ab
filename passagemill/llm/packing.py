"""Filling containers of a fixed capacity from a histogram of lengths.

Only the histogram (at most ``capacity`` rows) reaches the driver.  Best fit, largest length
first, runs over counts instead of documents and gives a plan: for each length, ranges of ranks
and the containers they go to.  Each document takes the slot that its rank within its length has
in the plan.  Ranks come from counts per written part, so no length is ever sorted in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import pick, stored
from passagemill.llm.tokens import counter, token_path

CAPACITY = 2_048


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """``(length, first rank, first container, items per container, items)`` rows and the number of containers.

    A row says that the ranks from ``first rank`` on, ``items`` in all, go into the containers from
    ``first container`` on, ``items per container`` into each.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    spaces: list[int] = []  # different remaining spaces, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # space -> ranges of containers (first, how many)
    made = 0

    def put(space: int, first: int, many: int) -> None:
        if space > 0 and many > 0:
            if space not in groups:
                groups[space] = []
                insort(spaces, space)
            groups[space].append((first, many))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if length > capacity or length < 0:
            raise ValueError(f"length {length} is not within 0 and {capacity}")
        while left > 0:
            at = bisect_left(spaces, max(length, 1))
            if at < len(spaces):
                space = spaces[at]
                first, many = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    spaces.pop(at)
            else:
                space, first = capacity, made
                each = capacity // length if length else left
                many = -(-left // each)
                made += many
            each = min(space // length if length else left, left)
            full = min(many, left // each)
            rows.append((length, rank, first, each, full * each))
            put(space - each * length, first, full)
            put(space, first + full, many - full)
            rank += full * each
            left -= full * each
    return rows, made


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = "byte_bpe_multi_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """``(doc_id, piece int, tokens int, container bigint)``: every row assigned to one container.

    Sizes are tokens of a public tokenizer.  A text of more than ``capacity`` tokens counts as as
    many full pieces as it holds and a last one with the rest, numbered from 0; all others are
    piece 0 and stay whole.  A null or empty text has size 0 and takes no space, but is assigned;
    rows with a null id are too.  Repeated rows are separate items.  An empty table gives no rows.
    """
    spark = df.sparkSession
    path = token_path(tokenizer, folder)
    kind = dict(pick(df, doc_id=id_col).dtypes)["doc_id"]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            n = np.array([count(t) if t else 0 for t in batch.column(1).to_pylist()], dtype=np.int64)
            pieces = np.maximum(1, -(-n // capacity))
            at = np.repeat(np.arange(len(n)), pieces)
            number = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            tokens = np.minimum(capacity, n[at] - number * capacity)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(number.astype(np.int32)), pa.array(tokens.astype(np.int32))], names=["doc_id", "piece", "tokens"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rank of each row among the rows of its length in this task."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            tokens = batch.column(2).to_numpy()
            order = np.argsort(tokens, kind="stable")
            ordered = tokens[order]
            start = np.searchsorted(ordered, ordered, side="left")
            rank = np.empty(len(tokens), dtype=np.int64)
            rank[order] = np.arange(len(tokens)) - start + seen[ordered]
            seen += np.bincount(tokens, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(tokens), part, dtype=np.int32)), pa.array(rank)], names=["doc_id", "piece", "tokens", "part", "local"])

    sized = pick(df, doc_id=id_col, text=text_col).mapInArrow(sizes, f"doc_id {kind}, piece int, tokens int")
    items = stored(sized.mapInArrow(numbered, f"doc_id {kind}, piece int, tokens int, part int, local bigint"), "token-sizes")
    per_part = items.groupBy("tokens", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("tokens", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    histogram = {r["tokens"]: r["n"] for r in items.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    rows, _ = plan_containers(histogram, capacity)
    by_length: dict[int, np.ndarray] = {}
    for row in rows:
        by_length.setdefault(row[0], []).append(row[1:])  # type: ignore[arg-type]
    plan = spark.sparkContext.broadcast({k: np.array(v, dtype=np.int64) for k, v in by_length.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rank = batch.column(2).to_numpy(), batch.column(3).to_numpy() + batch.column(4).to_numpy()
            where = np.zeros(len(tokens), dtype=np.int64)
            order = np.argsort(tokens, kind="stable")
            cuts = np.flatnonzero(np.diff(tokens[order])) + 1
            for at in np.split(order, cuts) if len(order) else []:
                slots = plan.value[int(tokens[at[0]])]
                i = np.searchsorted(slots[:, 0], rank[at], side="right") - 1
                where[at] = slots[i, 1] + (rank[at] - slots[i, 0]) // slots[i, 2]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(where)], names=["doc_id", "piece", "tokens", "container"])

    ranked = items.join(offsets, ["tokens", "part"]).select("doc_id", "piece", "tokens", "local", "offset")
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, tokens int, container bigint")
