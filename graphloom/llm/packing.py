"""Best-fit packing of documents into sequences of tokens, by bin completion.

What fits together depends on lengths alone, so the packing is solved over the histogram of lengths:
at most ``capacity`` counts, however many documents there are. Best-fit decreasing over the histogram
is the first incumbent; if it meets the lower bound it is the answer. Bin completion else looks for fewer
sequences: it takes the largest length left, enumerates the undominated fillings of the room beside it,
those of the greatest sum first, by a table of the sums that the lengths can reach, and branches over
them and over how often each is used, most first; a branch whose waste can't lead below the incumbent is
cut. The search is made twice, for fillings of few long and of many short pieces. The result is a short
list of patterns with counts. Bounds: a node combines at most TRIED lengths, the longest and the shortest
that fit, looks at the FOUND fillings of greatest sum and branches over at most FILLINGS undominated ones,
of which one counts as undominated if the proof takes over PROOF steps; a search ends after ``nodes`` steps
with the incumbent it has. They can cost sequences, never a piece: every piece is placed in any case.

Pieces are ranked within their length in salted groups, and rank and pattern give the place.

Defined cases: a null text counts as empty and has the end id alone. Repeated rows are packed each.
An empty table gives no row.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_map, materialize, pick

#: (lengths of one sequence, largest first; how many such sequences)
Pattern = tuple[tuple[int, ...], int]
NODES = 2500
TRIED = 768
FOUND = 24
FILLINGS = 8
PROOF = 16
MOST_SALTS = 1024


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram. Sequences alike are kept as one entry, so the work follows
    the number of lengths."""
    open_: dict[int, list[Pattern]] = {}
    rooms: list[int] = []
    done: list[Pattern] = []

    def put(items: tuple[int, ...], n: int, room: int) -> None:
        if not room:
            done.append((items, n))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((items, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                items, n, room = (), left, capacity
            else:
                room = rooms[k]
                items, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[k]
            each = room // length
            filled = min(n, left // each)
            if filled:
                put(items + (length,) * each, filled, room - each * length)
                left, n = left - filled * each, n - filled
            if left and n and not left // each:
                put(items + (length,) * left, 1, room - left * length)
                left, n = 0, n - 1
            if n and items:
                put(items, n, room)
    return done + [x for room in rooms for x in open_[room]]


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of b fit into those of a, several into one if need be: then a leaves no harder
    rest than b. Given up, as not shown, after PROOF steps."""
    room, steps = list(a), 0

    def place(k: int) -> bool:
        nonlocal steps
        if k == len(b):
            return True
        steps += 1
        if steps > PROOF:
            return False
        tried = set()
        for i, r in enumerate(room):
            if r >= b[k] and r not in tried:
                tried.add(r)
                room[i] -= b[k]
                if place(k + 1):
                    return True
                room[i] += b[k]
        return False

    return sum(a) >= sum(b) and place(0)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that are needed in any case: by the sum of lengths, and by how many lengths over a
    (k + 1)th of the capacity there are, of which k fit into one."""
    least, over = -(-sum(x * n for x, n in counts.items()) // capacity), 0
    longest = sorted(counts, reverse=True)
    for x, after in zip(longest, [*longest[1:], 0]):
        over += counts[x]
        k = capacity // x
        if not after or capacity // after > k:
            least = max(least, -(-over // k))
    return least


def fillings(lengths: list[int], counts: dict[int, int], room: int, waste: int, short_first: bool = False) -> list[tuple[int, ...]]:
    """Undominated fillings of a room that waste at most ``waste``, the greatest sums first. lengths:
    ascending. Bit s of reach[k] tells whether the first k lengths can add up to s, so no step of the
    enumeration leads nowhere."""
    usable, mask = lengths[: bisect_right(lengths, room)], (1 << (room + 1)) - 1
    if len(usable) > TRIED:
        usable = usable[: TRIED // 2] + usable[-(TRIED // 2) :]
    if short_first:
        usable.reverse()
    reach = [1]
    for x in usable:
        sums, left, size = reach[-1], min(counts[x], room // x), 1
        while left > 0:
            take = min(size, left)
            sums |= sums << (take * x)
            left, size = left - take, size * 2
        reach.append(sums & mask)
    found: list[tuple[int, ...]] = []

    def add_up(total: int, k: int, items: tuple[int, ...]) -> None:
        """Every way to get a total from the first k lengths, the last of them first."""
        if not total:
            found.append(items)
            return
        if not short_first:
            k = min(k, bisect_right(usable, total))
        while k and reach[k] >> total & 1 and len(found) < FOUND:
            k -= 1
            x = usable[k]
            if x < total and reach[k] >> (total - x) & 1 == 0 and counts[x] == 1:
                continue
            for times in range(min(counts[x], total // x), 0, -1):
                if reach[k] >> (total - times * x) & 1:
                    add_up(total - times * x, k, items + (x,) * times)

    sums = reach[-1]
    while sums and len(found) < FOUND:
        total = sums.bit_length() - 1
        if room - total > waste:
            break
        add_up(total, len(usable), ())
        sums ^= 1 << total
    kept: list[tuple[int, ...]] = []
    for f in found:
        if not any(dominates(g, f) for g in kept):
            kept.append(f)
        if len(kept) == FILLINGS:
            break
    return kept


def bin_completion(counts: dict[int, int], capacity: int, most: int, nodes: int = NODES, short_first: bool = False) -> list[Pattern] | None:
    """A packing into fewer than ``most`` sequences, or None if the search finds none. Counts are changed
    in place and put back on the way up, so the search holds one histogram."""
    rest, lengths = dict(counts), sorted(counts)
    total, least = sum(k * n for k, n in counts.items()), lower_bound(counts, capacity)
    best: list[Pattern] | None = None
    used: list[Pattern] = []
    bins = wasted = spent = 0
    # Of each sequence pattern on the way down: the patterns not tried yet, the next one last.
    open_: list[list[Pattern]] = []

    def change(items: tuple[int, ...], times: int) -> None:
        """Takes the items out, or with negative times puts them back."""
        for x in items:
            was = rest[x]
            rest[x] = was - times
            if not rest[x]:
                del lengths[bisect_left(lengths, x)]
            elif not was:
                insort(lengths, x)

    def branches() -> list[Pattern]:
        """Each filling as often as its lengths last and the waste allows, then each once less, and so on."""
        allowed, big = (most - 1) * capacity - total - wasted, lengths[-1]
        if allowed < 0 or spent > nodes:
            return []
        rest[big] -= 1
        found = [(big, *f) for f in fillings(lengths if rest[big] else lengths[:-1], rest, capacity - big, allowed, short_first)]
        rest[big] += 1
        out = []
        for items in found:
            waste = capacity - sum(items)
            times = min(rest[x] // items.count(x) for x in items)
            out.append((items, max(1, min(times, allowed // waste)) if waste else times))
        fewer = [(f, t) for f, times in out for t in range(times - 1, max(0, times - FILLINGS), -1)]
        return (out + sorted(fewer, key=lambda p: -p[1]))[::-1]

    while True:
        if lengths:
            spent += 1
            open_.append(branches())
        else:
            if bins < most:
                best, most = list(used), bins
            open_.append([])
        # Up to the last pattern with a branch left, then down along that one.
        while open_ and not open_[-1]:
            open_.pop()
            if open_:
                items, times = used.pop()
                change(items, -times)
                bins, wasted = bins - times, wasted - times * (capacity - sum(items))
        if not open_ or spent > nodes or most <= least:
            return best
        items, times = open_[-1].pop()
        change(items, times)
        used.append((items, times))
        bins, wasted = bins + times, wasted + times * (capacity - sum(items))


def pack(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[Pattern]:
    """Patterns that place every length of the histogram."""
    rest = {k: n for k, n in counts.items() if n and k < capacity}
    out: list[Pattern] = [((capacity,), counts[capacity])] if counts.get(capacity) else []
    if not rest:
        return out
    found = best_fit_decreasing(rest, capacity)
    for short_first in (False, True):
        bins = sum(n for _, n in found)
        if bins > lower_bound(rest, capacity):
            found = bin_completion(rest, capacity, bins, nodes, short_first) or found
    return out + found


def places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, offset), by rank. Ranks of a length run on from slot
    to slot, and within a slot from sequence to sequence."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for items, times in patterns:
        offset = 0
        for x in items:
            out.setdefault(x, []).append((used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 1, kind: str = "word", with_ids: bool = False) -> DataFrame:
    """documents (doc_id, text) -> pieces of at most ``capacity`` ids; only longer documents are cut."""

    def run(batches):
        from graphloom.llm.tokens import encoder

        encode = encoder(tokenizer, kind).encode
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc_id, got in zip(b.column(0).to_pylist(), encode([t or "" for t in b.column(1).to_pylist()])):
                got += end
                for k, at in enumerate(range(0, len(got), 4 * capacity)):
                    part = got[at : at + 4 * capacity]
                    row = doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int64) if with_ids else None
                    for c, v in zip(cols, row):
                        c.append(v)
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(cols[5], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return arrow_map(pick(docs, doc_id="doc_id", text="text"), run, PIECES + (", ids array<bigint>" if with_ids else ""))


def pack_pieces(pieces: DataFrame, capacity: int, nodes: int = NODES) -> DataFrame:
    """Pieces with a column ``length`` -> the same rows with sequence_id and offset.

    To the driver come the counts by length and salt, at most ``capacity`` times MOST_SALTS rows."""
    spark = pieces.sparkSession
    salts = min(MOST_SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    rows = salted.groupBy("length", "salt").count().toPandas()
    held = np.zeros((capacity + 1, salts), np.int64)
    held[rows["length"], rows["salt"]] = rows["count"]
    first = np.cumsum(held, axis=1) - held
    slots = places(pack({int(k): int(n) for k, n in enumerate(held.sum(axis=1)) if n}, capacity, nodes))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    shared = spark.sparkContext.broadcast((first, slots))
    kept = [c for c in ranked.columns if c not in ("salt", "rank")]

    def run(batches):
        first, slots = shared.value
        for b in batches:
            lengths, salt, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "salt", "rank"))
            nth = first[lengths, salt] + rank - 1
            sequence, offset = np.empty(len(nth), np.int64), np.empty(len(nth), np.int64)
            for length in np.unique(lengths):
                at, slot = lengths == length, slots[int(length)]
                hit = slot[np.searchsorted(slot[:, 0], nth[at], "right") - 1]
                sequence[at], offset[at] = hit[:, 1] + nth[at] - hit[:, 0], hit[:, 2]
            cols = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name in kept)
    return arrow_map(ranked, run, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """documents -> their pieces with sequence and offset. The pieces are written once, so texts are
    encoded once."""
    return pack_pieces(materialize(token_pieces(docs, tokenizer, capacity, end_id, with_ids=with_ids), "pieces"), capacity)
