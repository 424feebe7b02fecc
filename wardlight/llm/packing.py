"""Packing of token ids into sequences: best-fit decreasing by a segment tree, and bin completion by branch and bound."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.common import cut, free_name, read, slices
from wardlight.llm.tokens import Encoder


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CapacityTree:
    """Segment tree over free capacities 0..most: how many open sequences have each, and the least free capacity that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, free: int, n: int = 1) -> None:
        at = self.leaves + free
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, need: int) -> int:
        """The least free capacity of need or more that a sequence has, or -1."""
        at, count = self.leaves + need, self.count
        if count[at]:
            return need
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit_decreasing(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: the longest item first (ties by place), each into the open bin with the least room that is enough."""
    tree, room, bins = CapacityTree(capacity), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        free = tree.least(need)
        if free < 0:
            bins.append([])
            b, free = len(bins) - 1, capacity
        else:
            b = room[free].pop()
            tree.add(free, -1)
        bins[b].append(i)
        room.setdefault(free - need, []).append(b)
        tree.add(free - need)
    return bins


def _dominates(a: list[int], b: list[int]) -> bool:
    """Whether the items of b fit into bins as large as the items of a, one bin each (Martello and Toth)."""
    if sum(b) > sum(a):
        return False
    rooms = sorted(a, reverse=True)

    def place(k: int) -> bool:
        if k == len(items):
            return True
        tried = set()
        for j, r in enumerate(rooms):
            if r >= items[k] and r not in tried:
                tried.add(r)
                rooms[j] -= items[k]
                if place(k + 1):
                    return True
                rooms[j] += items[k]
        return False

    items = sorted(b, reverse=True)
    return place(0)


def fillings(count: list[int], sizes: list[int], room: int, most: int = 64, width: int = 12) -> list[list[int]]:
    """Undominated fillings of `room` from a multiset (count by size; sizes: those present, descending), the least waste first.

    One item of exactly the room dominates all others and is returned alone. Maximal fillings are enumerated from the
    largest item on, `most` at a time in a node; `width` undominated ones of least waste are kept. With few items that
    is all of them, so that the search is exact. With over 64 sizes a pair that fills the room exactly is looked up
    first, and taken alone: it leaves no waste. Dominance is tested between fillings of up to 6 items. These limits bound
    the search, never the result: all items are packed, and what a search may miss is a better packing.
    """
    if room <= 0 or not sizes or sizes[-1] > room:
        return [[]]
    if count[room]:
        return [[room]]
    if len(sizes) > 64:
        for a in sizes:
            if a < room and count[room - a] - (2 * a == room) > 0:
                return [[a, room - a]]
    found: list[list[int]] = []
    budget = [20 * most]

    def grow(i: int, left: int, chosen: list[int]) -> None:
        if len(found) >= most or budget[0] <= 0:
            return
        budget[0] -= 1
        grew = False
        for j in range(i, len(sizes)):
            s = sizes[j]
            if s <= left and count[s]:
                grew = True
                count[s] -= 1
                chosen.append(s)
                grow(j, left - s, chosen)
                chosen.pop()
                count[s] += 1
                if len(found) >= most or budget[0] <= 0:
                    return
        if not grew and not any(x <= left and count[x] for x in reversed(sizes)):
            found.append(list(chosen))

    grow(0, room, [])
    found.sort(key=lambda f: (-sum(f), len(f), f))
    kept: list[list[int]] = []
    for f in found:
        if len(kept) < width and not any(len(k) <= 6 and len(f) <= 6 and _dominates(k, f) for k in kept):
            kept.append(f)
    return kept or [[]]


def bin_completion(lengths: Sequence[int], capacity: int, nodes: int = 3_000) -> list[list[int]]:
    """Bins of item numbers: branch and bound over fillings around the largest item left, best-fit decreasing as the first incumbent.

    A branch is dropped when its waste so far exceeds what one bin fewer than the incumbent allows; a solution at the
    lower bound ceil(total / capacity) ends the search, as does the number of nodes, which then returns the incumbent.
    How far that is from the lower bound is in the README for the given tables and for hard instances.
    """
    best = best_fit_decreasing(lengths, capacity)
    total = sum(lengths)
    least = -(-total // capacity)
    if len(best) <= least:
        return best
    count = [0] * (capacity + 1)
    for x in lengths:
        count[x] += 1
    present = sorted({x for x in lengths if x}, reverse=True)
    plan: list[list[int]] = []
    waste, spent = 0, 0
    found: list[list[int]] | None = None
    stack: list[tuple[list[list[int]], int]] = []  # the fillings still to try at each depth, and their largest item

    def options() -> tuple[list[list[int]], int]:
        largest = next(x for x in present if count[x])
        count[largest] -= 1
        usable = [x for x in present if x <= capacity - largest and count[x]]
        out = fillings(count, usable, capacity - largest)
        count[largest] += 1
        return out[::-1], largest

    bound, left = len(best), total
    if left:
        stack.append(options())
    while stack and spent < nodes + len(best) and bound > least:
        tries, largest = stack[-1]
        if len(plan) == len(stack):  # back from below: take this bin apart
            bin_ = plan.pop()
            for x in bin_:
                count[x] += 1
            waste -= capacity - sum(bin_)
            left += sum(bin_)
        if not tries:
            stack.pop()
            continue
        spent += 1
        bin_ = [largest, *tries.pop()]
        for x in bin_:
            count[x] -= 1
        plan.append(bin_)
        waste += capacity - sum(bin_)
        left -= sum(bin_)
        if not left:
            if len(plan) < bound:
                bound, found = len(plan), [list(b) for b in plan]
            continue
        if waste <= (bound - 1) * capacity - total and len(plan) + 1 < bound:
            stack.append(options())
    if found is None:
        return best
    by_size: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        by_size.setdefault(lengths[i], []).append(i)
    out = [[by_size[x].pop() for x in b] for b in found]
    return out


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """docs (doc_id, text) → doc_id, piece, start, length, ids_crc32: every document's ids and end_id, cut losslessly at `capacity`.

    A null or blank text is the end id alone. Each text is read whole; repeated rows give repeated pieces.
    """
    path = path or vocabulary()
    id_type = dict(docs.dtypes)["doc_id"]

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.get(path)
        for batch in slices(batches):
            ids, offsets = coder.encode(batch.column("text"), end_id)
            sizes = np.diff(offsets)
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            at = offsets[row] + start
            raw = ids.astype("<u4").data.cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array(crc, pa.int64())
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select("doc_id", "text").mapInArrow(tokenize, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, capacity: int = 4096, per_group: int = 16_384) -> DataFrame:
    """Adds sequence_id and offset to pieces (…, length), a written table: bin completion within groups of about per_group pieces dealt out evenly.

    Pieces of full length are sequences of their own. The others are dealt out by their place in the table, equal rows
    too, each group with its own search, so that the number of tasks grows with the pieces and a group costs at most the
    closing sequence or two more than one search over everything. Columns named sequence_id and offset are replaced;
    pieces of equal length are packed in the order of doc_id, piece and start, and equal ones are interchangeable.
    """
    pieces = pieces.drop("sequence_id", "offset")
    full = pieces.where(F.col("length") == capacity)
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, round(rest.count() / per_group))
    group = free_name(pieces, "group_no")
    dealt = rest.withColumn(group, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    order = [c for c in pieces.columns if c in ("doc_id", "piece", "start")]

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        lengths = table.column("length").to_pylist()
        bins = bin_completion(lengths, capacity)
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                seq[i], off[i] = b, at
                at += lengths[i]
        seq = seq * groups + key[0].as_py()
        return table.drop_columns(group).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    packed = dealt.groupBy(group).applyInArrow(pack, schema)
    alone = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = 1, per_group: int = 16_384) -> DataFrame:
    """token_pieces, written once, and packed by pack_pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id; a null or blank text is end_id alone. Rows with null or repeated ids are documents
    of their own; an empty table gives an empty one; texts are read whole, and only longer ones are cut, at `capacity`.
    The documents' other columns are not read.
    """
    return pack_pieces(cut(token_pieces(docs, path, capacity, end_id)), capacity, per_group)


def packed_matrices(docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = 1, pool: int = 6_000_000) -> DataFrame:
    """docs (doc_id, text) → one row per packed sequence, best-fit decreasing within each task.

    sequence_id; doc_ids, pieces, starts (of the segments in order); cu_seqlens (cumulative segment lengths from 0);
    input_ids and position_ids: little-endian unsigned 16-bit matrices' rows of cu_seqlens[-1] entries, positions
    starting at 0 in every segment (a later piece of a cut document too); a vocabulary beyond 65,536 ids raises.
    A document's ids end with end_id. Documents longer than `capacity` are cut at it, losslessly: `starts` tells where.

    A task packs what it reads, in pools of about `pool` tokens, so that nothing is shuffled, ids are made once, and
    memory is bounded by a pool and one document. A pool's last sequences may stay unfilled, so that the number of
    sequences depends a little on how the input is dealt out: on the 0.1 scale they are 0.1 percent more than the tokens
    need. A document's ids and their order do not depend on it.
    Null and blank texts are the end id alone; repeated rows, and rows with null or equal ids of any type, are packed
    each on its own; of equally long pieces the earlier is packed first; an empty table gives an empty one; other columns
    are ignored.
    """
    path = path or vocabulary()
    id_type = dict(docs.dtypes)["doc_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part = Encoder.get(path), TaskContext.get().partitionId()
        state = {"made": 0}

        def flush(held: list) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            ids = np.concatenate([h[0] for h in held])
            if len(ids) and int(ids.max()) > 65535:
                raise ValueError("token ids need more than 16 bits")
            ids = ids.astype("<u2")
            sizes = np.concatenate([np.diff(h[1]) for h in held])
            names = [x for h in held for x in h[2]]
            begin = np.cumsum(sizes) - sizes
            count = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            at, lengths = (begin[row] + start).tolist(), length.tolist()
            count_up = np.arange(capacity, dtype="<u2")
            rows = []
            for items in best_fit_decreasing(lengths, capacity):
                rows.append((
                    (part << 40) + state["made"],
                    [names[row[i]] for i in items],
                    [int(piece[i]) for i in items],
                    [int(start[i]) for i in items],
                    np.concatenate([[0], np.cumsum([lengths[i] for i in items])]).tolist(),
                    b"".join(ids[at[i] : at[i] + lengths[i]].tobytes() for i in items),
                    b"".join(count_up[: lengths[i]].tobytes() for i in items),
                ))
                state["made"] += 1
                if len(rows) == 1024:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

        def batch_of(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.list_(state["kind"]), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["sequence_id", "doc_ids", "pieces", "starts", "cu_seqlens", "input_ids", "position_ids"]
            )

        held, tokens = [], 0
        for batch in slices(batches):
            ids, offsets = coder.encode(batch.column("text"), end_id)
            state["kind"] = batch.schema.field("doc_id").type
            held.append((ids, offsets, batch.column("doc_id").to_pylist()))
            tokens += len(ids)
            if tokens >= pool:
                yield from flush(held)
                held, tokens = [], 0
        yield from flush(held)

    return docs.select("doc_id", "text").mapInArrow(
        pack,
        f"sequence_id long, doc_ids array<{id_type}>, pieces array<int>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"
    )


def op4_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_matrices(read(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
