"""Draws counted by ranges of slots, so that no draw is a row.

A stratum's slots are cut into blocks and into ranges. A task takes a block's draws of all replicates, sorts them by the range that they hit and hands each range its part, two bytes for a draw. A range
then counts, replicate by replicate, how often each of its slots was drawn. No task holds a stratum, nothing is broadcast, and the draws are the hashes of ``resampling.draw``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.sources.scratch import task_count

#: Most slots of a block and of a range, most draws of a block, and fewest slots for which hashes are computed side by side.
BLOCK, RANGE, DRAWS, ASIDE = 1 << 14, 1 << 16, 1 << 22, 256
_TURNS = [t for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for t in turns]
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_PARTS = pa.schema([("of", pa.string()), ("part", pa.int64()), ("times", pa.binary()), ("places", pa.binary())])


# --- hashes


def md5_heads(prefix: bytes, first: int, count: int) -> np.ndarray:
    """The first 60 bits of md5(prefix + decimal number) for ``count`` numbers from ``first`` on."""
    out, at, end = np.empty(count, np.uint64), first, first + count
    while at < end:
        width = len(str(at))
        stop = min(end, 10**width)
        side = _side_by_side(prefix, at, stop - at, width) if stop - at >= ASIDE and len(prefix) + width <= 55 else None
        if side is None:
            digests = b"".join([hashlib.md5(prefix + b"%d" % i).digest()[:8] for i in range(at, stop)])
            side = np.frombuffer(digests, ">u8").astype(np.uint64)
        out[at - first : stop - first] = side >> np.uint64(4)
        at = stop
    return out


def _side_by_side(prefix: bytes, first: int, count: int, width: int) -> np.ndarray:
    """The first 64 bits of md5 of messages of one length and one block, all of them a step at a time."""
    length, numbers = len(prefix) + width, np.arange(first, first + count)
    fixed = int.from_bytes((prefix + bytes(width) + b"\x80").ljust(56, b"\0") + (8 * length).to_bytes(8, "little"), "little")
    words: list = [fixed >> 32 * k & 0xFFFFFFFF for k in range(16)]
    for j in range(width):
        k, shift = divmod(len(prefix) + j, 4)
        digit = ((numbers // 10 ** (width - 1 - j) % 10 + 48) << 8 * shift).astype(np.uint32)
        words[k] = digit + np.uint32(words[k]) if isinstance(words[k], int) else words[k] + digit
    a, b, c, d = (np.full(count, x, np.uint32) for x in _START)
    t, u = np.empty(count, np.uint32), np.empty(count, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
            k = i
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
            k = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
            k = (3 * i + 5) % 16
        else:
            np.bitwise_not(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
            k = 7 * i % 16
        np.add(t, a, out=t)
        if isinstance(words[k], int):
            np.add(t, np.uint32((words[k] + _SINES[i]) & 0xFFFFFFFF), out=t)
        else:
            np.add(t, words[k], out=t)
            np.add(t, np.uint32(_SINES[i]), out=t)
        np.left_shift(t, np.uint32(_TURNS[i]), out=u)
        np.right_shift(t, np.uint32(32 - _TURNS[i]), out=t)
        np.bitwise_or(t, u, out=t)
        np.add(t, b, out=a)
        a, b, c, d = d, a, b, c
    high, low = ((x + np.uint32(s)).byteswap().astype(np.uint64) for x, s in ((a, _START[0]), (b, _START[1])))
    return high << np.uint64(32) | low


# --- draws of blocks, dealt to ranges


def _dealt(seed: int, resamples: int, span: int, hashed: bool):
    """Of blocks (of, label, size, first, count, drawn), for each range that is hit how often in each replicate, and the places hit, ordered by replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of, label, size, first, count = (batch.column(j)[i].as_py() for j in range(5))
                keys = np.empty((resamples, count), np.uint64)
                ready = None if hashed else np.asarray(batch.column(5)[i].values, np.int64).reshape(resamples, count)
                for b in range(resamples):
                    if hashed:
                        heads = md5_heads(f"{seed}|{label}|{b}|".encode(), first, count)
                        at = heads - heads // np.uint64(size) * np.uint64(size)
                    else:
                        at = ready[b].astype(np.uint64)
                    part = at // np.uint64(span)
                    keys[b] = (part * np.uint64(resamples) + np.uint64(b)) << np.uint64(16) | (at - part * np.uint64(span))
                keys = np.sort(keys, axis=None)
                places, owner = keys.astype(np.uint16), (keys >> np.uint64(16)).astype(np.int64)
                begin = np.flatnonzero(np.concatenate([[True], owner[1:] // resamples != owner[:-1] // resamples]))
                rows = []
                for x, y in zip(begin.tolist(), [*begin[1:].tolist(), len(owner)]):
                    part = int(owner[x] // resamples)
                    times = np.bincount(owner[x:y] - part * resamples, minlength=resamples).astype(np.uint16)  # a block has fewer draws in a replicate
                    rows.append({"of": of, "part": part, "times": times.tobytes(), "places": places[x:y].tobytes()})
                yield pa.RecordBatch.from_pylist(rows, _PARTS)

    return run


def _tallies(right: pa.Table, resamples: int, span: int) -> Iterator[tuple[int, np.ndarray]]:
    """(replicate, how often each place of a range was drawn in it), from all that blocks handed to the range."""
    held = []
    for times, places in zip(right.column("times").to_pylist(), right.column("places").to_pylist()):
        ends = np.concatenate([[0], np.cumsum(np.frombuffer(times, np.uint16), dtype=np.int64)]).tolist()
        held.append((ends, np.frombuffer(places, np.uint16)))
    for b in range(resamples):
        parts = [places[ends[b] : ends[b + 1]] for ends, places in held]
        yield b, np.bincount(np.concatenate(parts) if parts else np.empty(0, np.uint16), minlength=span)


def key(strata: list[str]) -> Column:
    """A text that names a stratum."""
    return F.to_json(F.struct(*strata)) if strata else F.lit("")


def label(strata: list[str]) -> Column:
    """A stratum's name in the hashes of its draws."""
    return F.concat_ws("/", *(F.col(s).cast("string") for s in strata)) if strata else F.lit("")


def there(strata: list[str]) -> Column:
    """Whether a row has a stratum at all; without one it is drawn by none."""
    out = F.lit(True)
    for s in strata:
        out = out & F.col(s).isNotNull()
    return out


def ranged(units: DataFrame, sizes: DataFrame, strata: list[str], rows: int, resamples: int, seed: int, mode: str, draw: Callable) -> tuple[DataFrame, int]:
    """(of, part, times, places) of ``resamples`` draws with replacement from each stratum of ``sizes`` (strata, size), and the slots of a range; ``rows`` is about how many slots there are in all."""
    tasks = task_count(units)
    span = max(256, min(RANGE, -(-rows // tasks), 4 * DRAWS // resamples))
    hashed = mode == "md5"
    block = max(64, min(BLOCK, -(-rows // (4 * tasks)), (DRAWS if hashed else DRAWS // 16) // resamples))
    each = sizes.where(there(strata)).select(key(strata).alias("of"), label(strata).alias("label"), F.col("size").cast("long").alias("size"))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long")))
    blocks = each.where("size > 0").withColumn("first", first).withColumn("count", F.least(F.lit(block).cast("long"), F.col("size") - F.col("first"))).repartition(tasks)  # few rows that become many
    number = lambda i: draw(F.col("size"), seed, F.col("label"), F.floor(i / F.col("count")).cast("long"), F.col("first") + i % F.col("count"), mode=mode)
    drawn = F.lit(None).cast("array<long>") if hashed else F.transform(F.sequence(F.lit(0).cast("long"), F.col("count") * resamples - 1), number)
    return blocks.withColumn("drawn", drawn).mapInArrow(_dealt(seed, resamples, span, hashed), "of string, part long, times binary, places binary"), span


def _cogrouped(left: DataFrame, right: DataFrame, run, kinds: str) -> DataFrame:
    return left.groupBy("of", "part").cogroup(right.groupBy("of", "part")).applyInArrow(run, kinds)


# --- what ranges give


def _kinds(df: DataFrame, columns: list[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{c}` {types[c]}, " for c in columns)


def _slots(table: DataFrame, strata: list[str], span: int, columns: list[str]) -> DataFrame:
    """Units with their range and their place in it."""
    return table.where(there(strata)).select(key(strata).alias("of"), F.floor(F.col("slot") / span).cast("long").alias("part"), (F.col("slot") % span).cast("int").alias("place"), *columns)


def _summed(by: list[str], sums: list[str], extremes: dict[str, str], resamples: int, span: int):
    """Of a range, the sums of what each replicate drew; null where it drew nothing but nulls."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], left.schema.field(c).type) for c in by} | {"b": pa.array([], pa.int64())} | {c: pa.array([], left.schema.field(c).type) for c in sums})
        left = left.sort_by("place")
        place = np.asarray(left.column("place"), np.int64)
        null = np.stack([np.asarray(left.column(c).is_null()) for c in sums], axis=1)
        values = np.stack([np.asarray(left.column(c).cast(pa.float64(), safe=False).fill_null(0.0), np.float64) for c in sums], axis=1)
        added = [i for i, c in enumerate(sums) if c not in extremes]
        odd = [i for i in added if not np.isfinite(values[:, i]).all()]  # times 0 these would be NaN
        plain = [i for i in added if i not in odd]
        out, gone = np.zeros((resamples, len(sums))), np.zeros((resamples, len(sums)), bool)
        for b, counts in _tallies(right, resamples, span):
            own = counts[place]
            out[b, plain] = own @ values[:, plain]
            hit = own > 0
            for i in odd:
                out[b, i] = (own[hit] * values[hit, i]).sum()
            for c, kind in extremes.items():
                i = sums.index(c)
                pick = values[hit & ~null[:, i], i]
                out[b, i] = (pick.min() if kind == "min" else pick.max()) if len(pick) else 0.0
            gone[b] = ~(hit[:, None] & ~null).any(axis=0) if null.any() else not hit.any()
        head = {c: pa.array([left.column(c)[0].as_py()] * resamples, left.schema.field(c).type) for c in by}
        cols = {c: pa.array(out[:, i], pa.float64(), mask=gone[:, i]).cast(left.schema.field(c).type, safe=False) for i, c in enumerate(sums)}
        return pa.table({**head, "b": pa.array(np.arange(resamples)), **cols})

    return run


def slot_sums(table: DataFrame, strata: list[str], by: list[str], sums: list[str], extremes: dict[str, str], rows: int, resamples: int, seed: int, mode: str, draw: Callable) -> DataFrame:
    """(by, b, sums) of each range of an indexed ``table``, to be combined: as many draws from each stratum as it has units; ``by`` are strata, ``extremes`` sums that are a min or a max."""
    dealt, span = ranged(table, table.select(*strata, "size").distinct(), strata, rows, resamples, seed, mode, draw)
    return _cogrouped(_slots(table, strata, span, [*by, *sums]), dealt, _summed(by, sums, extremes, resamples, span), _kinds(table, by) + "b long, " + _kinds(table, sums)[:-2])


def _occurring(columns: list[str], resamples: int, span: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place = np.asarray(left.column("place"), np.int64)
        out = np.ones((len(place), resamples + 1), np.uint16)
        out[:, :resamples] = 0
        for b, counts in _tallies(right, resamples, span):
            out[:, b] = np.minimum(counts[place], 65535)
        return pa.table({**{c: left.column(c) for c in columns}, "times": pa.array([x.tobytes() for x in out], pa.binary())})

    return run


def slot_times(table: DataFrame, strata: list[str], columns: list[str], rows: int, resamples: int, seed: int, mode: str, draw: Callable) -> DataFrame:
    """(columns, times): how often each unit of an indexed ``table`` occurs in each replicate, as bytes of 16-bit numbers; one more is 1."""
    dealt, span = ranged(table, table.select(*strata, "size").distinct(), strata, rows, resamples, seed, mode, draw)
    return _cogrouped(_slots(table, strata, span, columns), dealt, _occurring(columns, resamples, span), _kinds(table, columns) + "times binary")


def _hit(columns: list[str], resamples: int, span: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        low, high = (np.asarray(left.column(c), np.int64) for c in ("low", "high"))
        rows, bs, times = [], [], []
        for b, counts in _tallies(right, resamples, span):
            below = np.concatenate([[0], np.cumsum(counts)])
            own = below[high] - below[low]
            hit = np.flatnonzero(own)
            rows.append(hit)
            bs.append(np.full(len(hit), b))
            times.append(own[hit])
        at = pa.array(np.concatenate(rows))
        return pa.table({"b": pa.array(np.concatenate(bs)), **{c: left.column(c).take(at) for c in columns}, "times": pa.array(np.concatenate(times))})

    return run


def cell_times(placed: DataFrame, stratum: str, columns: list[str], resamples: int, seed: int, mode: str, draw: Callable) -> DataFrame:
    """(b, columns, times) of each range, to be added up: draws of rows where ``placed`` has k equal ones in a row from slot ``first`` of its stratum on, of ``size`` slots."""
    sizes = placed.select(stratum, "size").distinct()
    rows = int(sizes.agg(F.sum("size")).first()[0] or 0)
    dealt, span = ranged(placed, sizes, [stratum], rows, resamples, seed, mode, draw)
    cells = placed.where(F.col(stratum).isNotNull()).withColumn("part", F.explode(F.sequence(F.floor(F.col("first") / span).cast("long"), F.floor((F.col("first") + F.col("k") - 1) / span).cast("long"))))
    begin = F.col("part") * span
    left = cells.select(key([stratum]).alias("of"), "part", F.greatest(F.col("first") - begin, F.lit(0)).cast("int").alias("low"), F.least(F.col("first") + F.col("k") - begin, F.lit(span)).cast("int").alias("high"), *columns)
    return _cogrouped(left, dealt, _hit(columns, resamples, span), "b long, " + _kinds(placed, columns) + "times long")


__all__ = ["cell_times", "md5_heads", "ranged", "slot_sums", "slot_times"]
