"""Removal of byte strings that an earlier document has too, exactly, over whole texts.

Which documents share a string of ``least`` bytes is found by minimizers: of every ``least``
bytes the smallest hash of their 26-byte strings is selected, so equal strings select the same
one. A first shuffle, by hash, tells which selected hashes occur in two texts; a second brings
the bytes around these together (equal surroundings once per task). Equal texts are one text in
both: only the row with the smallest id is compared, the others lose everything.

In a group, surroundings are compared through a Burrows-Wheeler transform: intervals of suffixes
are extended backwards breadth first, so common prefixes come out by increasing length, each
boundary once; at ``least`` the expansion stops, and rows whose boundaries are still open share
``least`` bytes. Every removal is decided on the bytes themselves, never on a hash.

A seed with many different surroundings would be one large group. The first shuffle counts them;
beyond HOT, the seed's interval is extended by the remaining bytes where it is read: every string
of ``least`` bytes that selected the seed is a group of its own, dealt by all of its bytes, and
all that is left to find is the smallest id that has it. So no seed's surroundings meet in one
place, and equal strings are one per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityspark.llm.textio import keep, steps, text_buffer

SEED_BYTES = 26
#: Text bytes that one group of the shuffles stands for, about.
GROUP_BYTES = 12 << 20
#: Surroundings of one seed, told apart by 16 bits, beyond which its strings are dealt one by one.
HOT = 2048
#: Marks such a seed's code, and its strings among the surroundings.
_HOT_CODE, _ALONE = 1 << 62, 255
_BASE = 0x9E3779B97F4A7C15
_VALUE = np.array([(_BASE * (2 * b + 1) ^ (b << 40)) % (1 << 64) | 1 for b in range(256)], dtype=np.uint64)
_TOP = np.uint64(2**64 - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out, have = np.ones(n, np.uint64), 1
    while have < n:
        end = min(n, 2 * have)
        out[have:end] = out[: end - have] * np.uint64(pow(base, have, 1 << 64))
        have = end
    return out


def _slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x, have = f(x[:-have], x[have:]), 2 * have
    rest = width - have
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def _scattered(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class Hashes:
    """Hashes of any strings of a buffer, from sums over its beginnings."""

    def __init__(self, raw: np.ndarray) -> None:
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUE[raw] * _powers(_BASE, len(raw)), dtype=np.uint64, out=self.sums[1:])
        self.back = _powers(pow(_BASE, -1, 1 << 64), len(raw) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _scattered((self.sums[end] - self.sums[start]) * self.back[start])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _scattered((self.sums[size:] - self.sums[:n]) * self.back[:n])


def minimizers(raw: np.ndarray, offsets: np.ndarray, least: int, seed: int = SEED_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, Hashes]:
    """Positions and hashes of the selected ``seed``-byte strings, none of which crosses two rows.

    Also the hash that each ``least``-byte string selects (0 if it crosses two rows), and all sums.
    """
    n, window, sums = len(raw) - seed + 1, least - seed + 1, Hashes(raw)
    if len(raw) < least:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64), sums
    h = sums.all(seed)
    crossing = np.zeros(len(raw) + 1, np.int32)  # strings that begin less than their length before a row's end
    for size, at in ((seed, 0), (least, 1)):
        marks = np.zeros(len(raw) + 1, np.int32)
        np.add.at(marks, np.maximum(offsets[1:] - size + 1, offsets[:-1]), 1)
        np.add.at(marks, offsets[1:], -1)
        crossing = crossing + (np.cumsum(marks) > 0) * (1 << at)
    h[(crossing[:n] & 1) > 0] = _TOP
    low = _slide(h, window, np.minimum)
    low[(crossing[: len(low)] & 2) > 0] = 0
    edge = np.zeros(window - 1, np.uint64)
    at = np.flatnonzero((_slide(np.concatenate([edge, low, edge]), window, np.maximum) == h) & (h != _TOP))
    return at, h[at], low, sums


def _bounds(at: np.ndarray, row: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the surroundings of seeds: all strings of ``least`` bytes that hold them, inside their rows."""
    return np.maximum(at - (least - SEED_BYTES), offsets[row]), np.minimum(at + least, offsets[row + 1])


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the ``depth`` bytes from there on (zeros after the end), by doubling."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    have = 8
    while True:
        order = np.argsort(key, kind="stable")
        if have >= depth:
            return order
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]])) + 1
        later = np.zeros(n, np.uint64)
        later[: max(0, n - have)] = rank[have:]
        key, have = rank << np.uint64(32) | later, 2 * have


def shared_prefix_blocks(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix positions in order, and the block of each: suffixes of a block share ``least`` bytes.

    Breadth-first backward extension: an interval of the suffixes that begin with some string of
    length v is extended by every byte before them; the new interval's right boundary, if open,
    gets the common prefix length v and the interval is extended in the next round.
    """
    order = suffix_order(data, least)
    n = len(order)
    before = data[order - 1]  # the transform
    target = np.empty(n, np.int64)
    target[np.argsort(before, kind="stable")] = np.arange(n)
    closed = np.zeros(n + 1, bool)
    closed[[0, n]] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(least):
        width = high - low
        single = low[width == 1]
        new_low, new_high = [target[single]], [target[single] + 1]
        wide, size = low[width > 1], width[width > 1]
        if len(wide):
            which = np.repeat(np.arange(len(wide)), size)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + wide[which]
            key = which << 8 | before[rows]
            by = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
            counts = np.diff(np.append(first, len(by)))
            begin = target[rows[by[first]]]
            new_low.append(begin)
            new_high.append(begin + counts)
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        open_ = ~closed[high]
        low, high = low[open_], high[open_]
        closed[high] = True
        if not len(low):
            break
    return order, np.cumsum(closed[:n]) - 1


def _listed(names: list[str], part: np.ndarray, *values: np.ndarray) -> pa.Table:
    """One row per distinct part: the part, and a list of each value."""
    by = np.argsort(part, kind="stable")
    parts, first = np.unique(part[by], return_index=True)
    offsets = pa.array(np.append(first, len(by)).astype(np.int32))
    return pa.Table.from_arrays([pa.array(parts), *(pa.ListArray.from_arrays(offsets, pa.array(v[by])) for v in values)], names=names)


def _dealt(names: list[str], slots: int, part: np.ndarray, *values: np.ndarray) -> pa.Table:
    """One row per slot of the parts: the slot, its parts and values as bytes. Their number doesn't grow with the parts."""
    slot = part % slots
    by = np.argsort(slot, kind="stable")
    groups = np.split(by, np.flatnonzero(np.diff(slot[by])) + 1) if len(by) else []
    columns = [pa.array([x[g].tobytes() for g in groups], pa.binary()) for x in (part, *values)]
    return pa.Table.from_arrays([pa.array([int(slot[g[0]]) for g in groups], pa.int32()), *columns], names=["slot", *names])


def _gathered(names: list[str], kinds: list[type]):  # noqa: ANN202
    """Of a slot: one row per part with the lists of all buckets."""

    def run(group: pa.Table) -> pa.Table:
        columns = [np.concatenate([np.frombuffer(x, k) for x in group.column(c).to_pylist()]) for c, k in zip(names, kinds)]
        return _listed(names, *columns)

    return run


def _seed_rows(buckets: int, least: int):  # noqa: ANN202
    """Per task and bucket: the selected hashes with the rows that have them, and 16 bits that tell their surroundings apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            hashes, near, part = (np.concatenate(x) for x in zip(*held))
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            for chosen in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
                names, who = np.unique(part[chosen], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[chosen[0]])], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in ((hashes[chosen] >> np.uint64(32)).astype(np.uint32), near[chosen], who.astype(np.uint32), names))], names=["bucket", "codes", "near", "who", "parts"])

        for batch in steps(batches, "t"):
            raw, offsets = text_buffer(batch.column(1))
            at, hashes, _, sums = minimizers(raw, offsets, least)
            if len(at):
                row = np.searchsorted(offsets, at, "right") - 1
                near = (sums.of(*_bounds(at, row, offsets, least)) >> np.uint64(48)).astype(np.uint16)
                held.append((hashes, near, batch.column(0).to_numpy()[row]))
                size += len(at)
            if size > 4_000_000:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return run


def _repeated_seeds(slots: int, hot: int):  # noqa: ANN202
    """The hashes of a bucket that two different texts have, by text."""
    return lambda group: _dealt(["part", "codes"], slots, *_seeds_of_two(group, hot))


def _seeds_of_two(group: pa.Table, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts and codes; a code of more than ``hot`` different surroundings is marked."""
    key, part = [], []
    for c, n, w, p in zip(*(group.column(x).to_pylist() for x in ("codes", "near", "who", "parts"))):
        key.append(np.frombuffer(c, np.uint32).astype(np.uint64) << np.uint64(16) | np.frombuffer(n, np.uint16))
        part.append(np.frombuffer(p, np.int64)[np.frombuffer(w, np.uint32)])
    key, part = np.concatenate(key), np.concatenate(part)
    by = np.argsort(key)
    key, part = key[by], part[by]
    code = (key >> np.uint64(16)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    counts = np.diff(np.append(first, len(code)))
    many = np.minimum.reduceat(part, first) < np.maximum.reduceat(part, first)
    kinds = np.add.reduceat(np.concatenate([[True], key[1:] != key[:-1]]).astype(np.int64), first)
    chosen = np.repeat(many, counts)
    mark = np.repeat(np.where(kinds > hot, _HOT_CODE, 0), counts)
    return part[chosen], np.int64(group.column("bucket")[0].as_py()) << 32 | code[chosen] | mark[chosen]


def _surroundings(buckets: int, least: int):  # noqa: ANN202
    """Per task and bucket: the distinct surroundings of repeated seeds, or the strings of hot ones, and where each occurs."""
    side = least - SEED_BYTES
    whole = SEED_BYTES + 2 * side

    def taken(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        place = start[:, None] + np.arange(whole)
        return np.where(place < end[:, None], raw[np.minimum(place, len(raw) - 1)], 0).astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "t", 8 << 20):
            held = []
            for piece in steps(iter([batch]), "t"):
                raw, offsets = text_buffer(piece.column(2))
                lists = piece.column(3)
                own = piece.column(4).to_numpy(zero_copy_only=False)
                begins = lists.offsets.to_numpy()
                wanted = np.diff(begins) * own
                if not len(raw) or not wanted.sum():
                    continue
                at, hashes, low, sums = minimizers(raw, offsets, least)
                row = np.searchsorted(offsets, at, "right") - 1
                code = (hashes % np.uint64(buckets)).astype(np.int64) << 32 | (hashes >> np.uint64(32)).astype(np.int64)
                # a row's own codes: pairs of row and code as one number (a chance match costs one more comparison)
                paired = lambda r, c: _scattered((r.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE) ^ c.astype(np.uint64))
                values = lists.values.to_numpy()[begins[0] : begins[-1]]
                of_row = np.repeat(np.arange(piece.num_rows), np.diff(begins))
                mine = own[of_row]
                hot = values >= _HOT_CODE
                pairs = paired(row, code)
                is_hot = np.isin(pairs, paired(of_row[mine & hot], values[mine & hot] ^ _HOT_CODE))
                cold = np.flatnonzero(np.isin(pairs, paired(of_row[mine & ~hot], values[mine & ~hot])) & ~is_hot)
                part, ids = piece.column(0).to_numpy(), piece.column(1).fill_null(0).to_numpy()
                if len(cold):
                    start, end = _bounds(at[cold], row[cold], offsets, least)
                    held.append((code[cold] >> 32, taken(raw, start, end), (end - start | (at[cold] - start) << 8).astype(np.uint16), part[row[cold]], ids[row[cold]], start - offsets[row[cold]]))
                if is_hot.any():  # the strings that selected the seed; others that hold it selected another one
                    start = at[is_hot][:, None] - np.arange(side + 1)
                    fits = (start >= 0) & (start < len(low)) & (low[np.clip(start, 0, len(low) - 1)] == hashes[is_hot][:, None])
                    start = np.unique(start[fits])
                    of = np.searchsorted(offsets, start, "right") - 1
                    bucket = (sums.of(start, start + least) % np.uint64(buckets)).astype(np.int64)
                    held.append((bucket, taken(raw, start, start + least), np.full(len(start), least | _ALONE << 8, np.uint16), part[of], ids[of], start - offsets[of]))
            if not held:
                continue
            bucket, around, shape, part, ids, start = (np.concatenate(x) for x in zip(*held))
            by = np.argsort(bucket, kind="stable")
            for chosen in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
                text, which = _distinct(around[chosen], shape[chosen])
                names, first, who = np.unique(part[chosen], return_index=True, return_inverse=True)
                columns = (around[chosen][text], shape[chosen][text], which.astype(np.uint32), who.astype(np.uint32), start[chosen].astype(np.int32), names, ids[chosen][first])
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[chosen[0]])], pa.int32()), pa.array([pa.compress(columns[0].tobytes(), codec="zstd", asbytes=True)], pa.binary()), *(pa.array([x.tobytes()], pa.binary()) for x in columns[1:])], names=["bucket", *_AROUND])

    return run


_AROUND = ["around", "shape", "which", "who", "start", "parts", "ids"]


def _distinct(around: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index per distinct surrounding, and the number of each one's; equality is by bytes."""
    wide = np.zeros((len(around), -(-around.shape[1] // 8) * 8), np.uint8)
    wide[:, : around.shape[1]] = around
    key = (wide.view(np.uint64) * _powers(_BASE, wide.shape[1] // 8)).sum(axis=1, dtype=np.uint64) * np.uint64(31) + shape
    by = np.argsort(key, kind="stable")
    new = np.ones(len(by), bool)
    new[1:] = (key[by][1:] != key[by][:-1]) | (shape[by][1:] != shape[by][:-1]) | (around[by][1:] != around[by][:-1]).any(axis=1)
    which = np.empty(len(by), np.int64)
    which[by] = np.cumsum(new) - 1
    return by[new], which


def _decided(slots: int, least: int):  # noqa: ANN202
    """Of a bucket: the runs of string starts in each row that a row with a smaller id has too."""
    side = least - SEED_BYTES
    whole = SEED_BYTES + 2 * side

    def run(group: pa.Table) -> pa.Table:
        around, shape, text, part, ids, start = [], [], [], [], [], []
        known = 0
        for row in zip(*(group.column(x).to_pylist() for x in _AROUND)):
            s, w, who, st, p, d = (np.frombuffer(x, k) for x, k in zip(row[1:], (np.uint16, np.uint32, np.uint32, np.int32, np.int64, np.int64)))
            a = np.frombuffer(pa.decompress(row[0], len(s) * whole, codec="zstd", asbytes=True), np.uint8)
            around.append(a.reshape(-1, whole))
            shape.append(s)
            text.append(w.astype(np.int64) + known)
            part.append(p[who])
            ids.append(d[who])
            start.append(st)
            known += len(s)
        around, shape, text, part, ids, start = (np.concatenate(x) for x in (around, shape, text, part, ids, start))
        one, which = _distinct(around, shape)
        around, shape, text = around[one], shape[one], which[text]
        fitting = (shape & 255).astype(np.int64) - least  # last place of a string
        earliest = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(earliest, text, ids)
        source = np.repeat(earliest[:, None], whole - least + 1, axis=1)
        usable = np.arange(whole - least + 1) <= fitting[:, None]
        for chosen in _by_seed(around, shape):
            flat = np.zeros((len(chosen), whole + 1), np.uint8)
            flat[:, :whole] = around[chosen]
            order, block = shared_prefix_blocks(flat.reshape(-1), least)
            which_text, at = order // (whole + 1), order % (whole + 1)
            fit = at <= fitting[chosen][which_text]
            order, block, which_text, at = order[fit], block[fit], chosen[which_text[fit]], at[fit]
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.empty(0, np.int64)
            if len(first):
                source[which_text, at] = np.repeat(np.minimum.reduceat(earliest[which_text], first), np.diff(np.append(first, len(block))))
        begins, lengths, owners = [], [], []
        for i in range(0, len(text), 1 << 17):
            j = slice(i, i + (1 << 17))
            hit = np.zeros((len(text[j]), whole - least + 3), np.int8)
            hit[:, 1:-1] = (source[text[j]] < ids[j][:, None]) & usable[text[j]]
            edge = np.diff(hit, axis=1)
            row, begin = np.nonzero(edge == 1)
            _, end = np.nonzero(edge == -1)
            begins.append(start[j][row] + begin)
            lengths.append(end - begin)
            owners.append(part[j][row])
        begins, lengths, owners = (np.concatenate(x) for x in (begins, lengths, owners))
        return _dealt(["part", "begins", "lengths"], slots, owners, begins.astype(np.int32), lengths.astype(np.int32))

    return run


def _by_seed(around: np.ndarray, shape: np.ndarray, limit: int = 1 << 19) -> Iterator[np.ndarray]:
    """Portions, of about ``limit`` bytes, of the surroundings whose seed another one has as well.

    Equal seeds are together. A surrounding that is alone with its seed needs no comparison, nor
    does a hot seed's string: all its bytes are fixed.
    """
    lead = (shape >> 8).astype(np.int64)
    compared = np.flatnonzero(lead != _ALONE)
    seed = np.take_along_axis(around[compared], lead[compared][:, None] + np.arange(SEED_BYTES), axis=1)
    key = (_VALUE[seed] * _powers(_BASE, SEED_BYTES)).sum(axis=1, dtype=np.uint64)
    by = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))[: len(key)]
    counts = np.diff(np.append(first, len(by)))
    by = compared[by[np.repeat(counts > 1, counts)]]
    ends = np.cumsum(counts[counts > 1])
    begin, last = 0, 0
    while begin < len(by):
        last = max(last + 1, int(np.searchsorted(ends, begin + limit // around.shape[1], "right")))
        yield by[begin : ends[last - 1]]
        begin = int(ends[last - 1])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """``(id_col, n_bytes, n_removed, n_spans, kept_sha256)`` per row, and ``kept`` (bytes) on request.

    A byte goes if it lies in a string of ``least`` bytes that also starts in a row with a smaller
    id. Ids are integers. Null texts count as empty. Rows without an id neither lose bytes nor make others lose
    any. Rows that repeat an id never take bytes from each other. Other columns are not read. Texts
    are told apart by two 64-bit hashes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.xxhash64(text).alias("part"), F.xxhash64(F.lit(1), text).alias("proof"), F.col(id_col).alias("id"), text.alias("t"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(8, -(-int(total) // GROUP_BYTES))
    slotted = lambda kinds: ", ".join(["slot int", *(f"{k} binary" for k in kinds)])
    seeds = given.where(F.col("id").isNotNull()).select("part", "t").mapInArrow(_seed_rows(buckets, least), "bucket int, codes binary, near binary, who binary, parts binary")
    repeated = seeds.groupBy("bucket").applyInArrow(_repeated_seeds(buckets, hot), slotted(("part", "codes")))
    of_text = repeated.groupBy("slot").applyInArrow(_gathered(["part", "codes"], [np.int64, np.int64]), "part long, codes array<long>")
    first = given.groupBy("part", "proof").agg(F.min("id").alias("first"))
    known = keep(first.join(of_text, "part", "left"))
    near = given.join(known, ["part", "proof"], "left").select("part", F.col("id").cast("long").alias("id"), "t", "codes", F.coalesce(F.col("id") == F.col("first"), F.lit(False)).alias("own"))
    around = near.mapInArrow(_surroundings(buckets, least), "bucket int, " + ", ".join(f"{x} binary" for x in _AROUND))
    found = around.groupBy("bucket").applyInArrow(_decided(buckets, least), slotted(("part", "begins", "lengths")))
    spans = found.groupBy("slot").applyInArrow(_gathered(["part", "begins", "lengths"], [np.int64, np.int32, np.int32]), "part long, begins array<int>, lengths array<int>")
    decided = known.select("part", "proof", "first").join(spans, "part", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "t"):
            raw, offsets = text_buffer(batch.column(1))
            n, removed, runs, digest, kept = [], [], [], [], []
            begins, lengths, copy = (batch.column(c).to_pylist() for c in (2, 3, 4))
            for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
                text = raw[a:b]
                gone = np.zeros(len(text) + 1, np.int32)
                if copy[i] and len(text) >= least:
                    gone[0] = 1
                elif begins[i] and not copy[i]:
                    begin = np.array(begins[i])
                    np.add.at(gone, begin, 1)
                    np.add.at(gone, begin + np.array(lengths[i]) + least - 1, -1)
                cut = np.cumsum(gone[:-1]) > 0
                rest = text[~cut].tobytes()
                n.append(len(text))
                removed.append(int(cut.sum()))
                runs.append(int(np.count_nonzero(np.diff(cut.astype(np.int8), prepend=0) == 1)))
                digest.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_text, names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    joined = given.join(decided, ["part", "proof"], "left").select("id", "t", F.when(F.col("id").isNotNull(), F.col("begins")).alias("begins"), "lengths", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("copy"))
    return joined.mapInArrow(finish, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
