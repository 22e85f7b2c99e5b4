"""MinHash near-duplicate classes.

Texts become sets of five-word shingles (``words`` defines a word). DartMinHash signatures are cut into
bands; texts with a common band (a bucket) are candidates, and a pair of them is linked if its exact similarity, from its shingles (as
32-bit hashes), is at least the threshold. Classes are the connected components of links.

Equal shingle sets are one set from the start, so copies never meet each other. In LEADING bands each text is compared with one
text of its bucket, the leader: the text that shares most buckets with most others, which in a group of near copies is the one
that they were made from. Buckets whose texts are of one class by then are done. In all others, of any band, every text is compared
exactly with every text of another class: a task takes a bucket with the shingles of its texts, finds all intersections by products of
0/1 matrices, and gives only the links that join classes, fewer than the bucket has texts. A bucket that is too large for a task is dealt to tiles, each
pair of which meets in a task; the texts of its largest class aren't compared with each other and so are sent to few tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import blocks, drop_stored, large_text, small, stored, unused, worker_store
from quillmark.llm.components import components
from quillmark.llm.dartminhash import bands, signatures
from quillmark.llm.words import mix, shingles, words

#: Words in a shingle, least similarity, coordinates of a band, bands (a pair at 0.8 is missed with probability 5e-6).
SIZE, THRESHOLD, ROWS, BANDS = 5, 0.8, 6, 40
#: Bands whose buckets link each text to their leader before any other comparison.
LEADING = 8
#: Texts, and bytes of shingles, of a bucket that a task compares at once; columns of a matrix.
TILE, TILE_BYTES, _COLUMNS = 1024, 8 << 20, 2048
_BLOCK = 1 << 19


def _sketch_block(ids, data, offsets, size, rows, count):
    hashes, before = words(data, offsets)
    runs, start = shingles(hashes, before, size)
    row = np.repeat(np.arange(len(ids)), np.diff(start))
    order = np.lexsort((runs, row))
    runs, row = runs[order], row[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (row[1:] != row[:-1])
    runs, row = runs[new], row[new]
    start = np.searchsorted(row, np.arange(len(ids) + 1))
    signature = signatures(runs, start, rows * count)
    key = bands(signature, rows)
    total = np.zeros((2, len(runs) + 1), np.uint64)
    np.cumsum(mix(runs ^ np.uint64(0x5851F42D4C957F2D)), out=total[0, 1:])
    np.cumsum(mix(runs ^ np.uint64(0x14057B7EF767814F)), out=total[1, 1:])
    digest = (total[:, start[1:]] - total[:, start[:-1]]).view(np.int64)
    short = (runs & np.uint64(0xFFFFFFFF)).astype("<u4")
    return np.diff(start), key, digest, short, start


def _sketcher(size: int, rows: int, count: int):
    import hashlib

    def run(batches):
        worker_store("near_dedup")
        for batch in batches:
            data, offsets = large_text(batch.column(2))
            for low, high in blocks(offsets, _BLOCK):
                at = offsets[low : high + 1]
                part = data[at[0] : at[-1]]
                n, key, digest, short, start = _sketch_block(range(high - low), part, at - at[0], size, rows, count)
                for i in np.flatnonzero(n == 0):  # no words: only equal texts are copies
                    raw = hashlib.blake2b(part[at[i] - at[0] : at[i + 1] - at[0]].tobytes(), digest_size=16).digest()
                    digest[:, i] = np.frombuffer(raw, np.int64)
                flat = pa.array(key[n > 0].reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * count)]).astype(np.int32)), flat)
                blob = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer((start * 4).astype(np.int32)), pa.py_buffer(short)])
                own = [batch.column(c).slice(low, high - low) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(digest[0]), pa.array(digest[1]), pa.array(n.astype(np.int32)), lists, blob], ["doc_id", "hash", "set_a", "set_b", "size", "bands", "shingles"]
                )

    return run


def _shared(batches):
    """Of rows (band, bucket, rep, size) sorted by bucket, those whose bucket has more of them, and those at a partition's ends; ``n`` counts the bucket's rows in the partition."""
    rows = [x for x in batches if x.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    bucket = table.column("bucket").to_numpy()
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    length = np.diff(np.append(first, len(bucket)))
    keep = length > 1
    keep[[0, -1]] = True  # the bucket may go on in the neighbouring partition
    chosen = np.repeat(keep, length)
    kept = table.filter(pa.array(chosen)).append_column("n", pa.array(np.repeat(length, length)[chosen]))
    yield from kept.to_batches(max_chunksize=50_000)


def _groups(batches, keys: list[str]):
    """The rows of each run of equal ``keys`` as a table; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        of = np.stack([batch.column(k).to_numpy() for k in keys])
        first = np.flatnonzero(np.concatenate([[True], (of[:, 1:] != of[:, :-1]).any(axis=0)]))
        for low, high in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows]):
            key = tuple(of[:, low].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def joining_links(rep: np.ndarray, own: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links between texts of ``left`` and of ``right`` (places in ``sets``) that are similar enough and join different classes ``own``: enough of them to join all classes that any such link joins."""
    size = np.array([len(x) for x in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count > 1  # the others are in one text
    place = np.cumsum(common) - 1
    kept = common[column]
    row, column = row[kept], place[column][kept]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    wide = int(common.sum())
    both = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, wide, _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        matrix = np.zeros((len(sets), min(_COLUMNS, wide - low)), np.float32)
        matrix[row[a:b], column[a:b] - low] = 1
        both += matrix[left] @ matrix[right].T
    label, out = own.copy(), []
    for i, x in enumerate(left.tolist()):
        same = both[i].astype(np.float64)
        near = right[(same >= threshold * (size[x] + size[right] - same) - 1e-9) & (label[right] != label[x])]
        if len(near):
            classes, at = np.unique(label[near], return_index=True)
            out.extend((int(rep[x]), int(y)) for y in rep[near[at]])
            label[np.isin(label, classes)] = label[x]
    return out


def _compared(threshold: float):
    """For rows (bucket, low, high, tile, rep, component, shingles) sorted by the first three: links that join classes, between the tiles ``low`` and ``high`` of each bucket."""

    def run(batches):
        out = []
        for table in _groups(batches, ["bucket", "low", "high"]):
            tile, rep, own = (table.column(c).to_numpy() for c in ("tile", "rep", "component"))
            if own.min() == own.max():
                continue
            low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
            sets = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("shingles")]
            every = np.arange(len(rep))
            left, right = (every[tile == low], every[tile == high]) if low != high else (every, every)
            if low == high:  # the largest class isn't compared with itself
                classes, count = np.unique(own, return_counts=True)
                left = every[own != classes[count.argmax()]]
            if len(left) and len(right):
                out += joining_links(rep, own, sets, left, right, threshold)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _verifier(threshold: float):
    """Keeps pairs whose shingle sets have at least the similarity ``threshold``."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = []
            for x, y in zip(left, right):
                p, q = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                both = len(np.intersect1d(p, q))
                good.append(both >= threshold * (len(p) + len(q) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity is enough, stored; ``sets`` has (rep, shingles)."""
    pairs = stored(pairs.where("a <> b").distinct(), "pairs")
    needed = stored(pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct(), "needed")
    used = stored(sets.join(small(needed), "rep"), "used")
    one, two = used.select(F.col("rep").alias("a"), F.col("shingles").alias("p")), used.select(F.col("rep").alias("b"), F.col("shingles").alias("q"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "p", "q")
    out = stored(joined.mapInArrow(_verifier(threshold), "a long, b long"), "links")
    for table in (pairs, needed, used):
        drop_stored(table)
    return out


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after further links: the classes themselves are the nodes of a small graph."""
    named = lambda c: links.select(F.col(c).alias("node")).join(labels, "node", "left")
    both = links.join(named("a").distinct().select(F.col("node").alias("a"), F.coalesce("component", "node").alias("x")), "a").join(named("b").distinct().select(F.col("node").alias("b"), F.coalesce("component", "node").alias("y")), "b")
    moved = components(both.select(F.col("x").alias("a"), F.col("y").alias("b")))
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    every = labels.select("node", "component").union(new).join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    out = stored(every.select("node", F.coalesce("to", "component").alias("component")), "labels")
    drop_stored(labels)
    drop_stored(moved)
    return out


def _led(buckets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of each text and the leader of its bucket, if their sizes allow the similarity ``threshold``."""
    central = buckets.groupBy("rep").agg(F.sum("n").alias("central"))
    first = buckets.where(F.col("band") < LEADING)
    lead = first.join(central, "rep").groupBy("bucket").agg(F.max(F.struct("central", "rep", "size")).alias("lead"))
    pairs = first.join(lead, "bucket").select(F.col("rep").alias("x"), F.col("size").alias("n"), F.col("lead.rep").alias("y"), F.col("lead.size").alias("m"))
    near = pairs.where((F.col("x") != F.col("y")) & (F.least("n", "m") >= F.lit(threshold) * F.greatest("n", "m")))
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _mixed(buckets: DataFrame, labels: DataFrame, tile: int) -> DataFrame:
    """Rows (bucket, low, high, tile, rep, component) of the buckets of several classes, once for each pair of tiles that a text is part of.

    A bucket that fits in a task is one tile. In others, the texts of the largest class have tiles of their own, which meet those of the
    other texts but not each other.
    """
    owned = buckets.select("bucket", "rep", "size").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    each = owned.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("size").cast("long") * 4).alias("bytes"))
    of = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.sum("k").alias("k"), F.sum("bytes").alias("bytes"), F.max(F.struct("k", "bytes", "component")).alias("top"))
    tiles = lambda k, size: F.greatest(F.ceil(k / tile), F.ceil(size / TILE_BYTES), F.lit(1))
    whole = (F.col("k") <= tile) & (F.col("bytes") <= TILE_BYTES)
    of = of.where("classes > 1").select(
        "bucket", F.when(~whole, F.col("top.component")).alias("top"),
        F.when(whole, F.lit(1)).otherwise(tiles(F.col("k") - F.col("top.k"), F.col("bytes") - F.col("top.bytes"))).alias("others"),
        F.when(whole, F.lit(0)).otherwise(tiles(F.col("top.k"), F.col("top.bytes"))).alias("tops"),
    )
    turn, is_top = F.xxhash64("rep"), F.coalesce(F.col("component") == F.col("top"), F.lit(False))
    placed = owned.join(of, "bucket").withColumn("tile", F.when(is_top, F.col("others") + F.pmod(turn, F.col("tops"))).otherwise(F.pmod(turn, F.col("others"))))
    most = F.when(is_top, F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1
    rows = placed.select("bucket", "tile", "rep", "component", F.explode(F.sequence(F.lit(0).cast("long"), most.cast("long"))).alias("other"))
    return rows.select("bucket", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "rep", "component")


def _classified(docs: DataFrame, key: str, text: str, size: int, threshold: float, rows: int, count: int, tile: int) -> DataFrame:
    """(doc_id, hash, class_id, component, n_shingles) of every row, stored; ``hash`` is that of the text, ``component`` names the class for keys that are null too."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    own = F.col(f"`{key}`")
    own = own.cast("long") if dict(docs.dtypes)[key] in ("tinyint", "smallint", "int") else own
    named = docs.select(own.alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("hash"), "text")
    kinds = f"doc_id {named.schema['doc_id'].dataType.simpleString()}, hash long, set_a long, set_b long, size int, bands array<long>, shingles binary"
    sketch = stored(named.mapInArrow(_sketcher(size, rows, count), kinds).withColumn("row", F.monotonically_increasing_id()), "sketch")
    # one row stands for each set of shingles and gives it its name, "rep"
    head = stored(sketch.groupBy("set_a", "set_b").agg(F.min("row").alias("rep"), F.min("doc_id").alias("doc_id"), F.max("size").alias("size")), "heads")
    reps = head.where("size > 0").select("rep")
    sets = sketch.select(F.col("row").alias("rep"), "shingles")
    banded = sketch.select(F.col("row").alias("rep"), "size", "bands").join(small(reps), "rep", "left_semi").select(F.posexplode("bands").alias("band", "bucket"), "rep", "size")
    ordered = banded.repartitionByRange(parts, "bucket", "rep").sortWithinPartitions("bucket")
    buckets = stored(ordered.mapInArrow(_shared, "band int, bucket long, rep long, size int, n long"), "buckets")
    links = _verified(_led(buckets, threshold), sets, threshold)
    labels = components(links)
    drop_stored(links)
    mixed = stored(_mixed(buckets, labels, tile), "mixed")
    asked = stored(mixed.select("rep").distinct(), "asked")
    held = mixed.join(sets.join(small(asked), "rep"), "rep").repartition(parts, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    links = stored(held.mapInArrow(_compared(threshold), "a long, b long").distinct(), "links")
    for table in (mixed, asked, buckets):
        drop_stored(table)
    labels = _joined(labels, links)
    owned = head.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    owned = stored(owned.select("set_a", "set_b", "doc_id", "component"), "owned")
    smallest = stored(owned.groupBy("component").agg(F.min("doc_id").alias("class_id")), "smallest")  # a table, so that the join can split a large class
    classes = owned.join(smallest, "component").select("set_a", "set_b", "class_id", "component")
    out = stored(sketch.join(classes, ["set_a", "set_b"]).select("doc_id", "hash", "class_id", "component", F.col("size").alias("n_shingles")), "classes")
    for table in (links, labels, head, owned, smallest, sketch):
        drop_stored(table)
    return out


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, threshold: float = THRESHOLD, rows: int = ROWS, count: int = BANDS, tile: int = TILE
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the smallest doc_id of its class), n_shingles.

    Null text counts as empty. A text of one to four words is one shingle; texts without words are a class only with
    equal texts. Rows with equal doc_id are separate texts, each with its own row. A null doc_id stays null and its row belongs
    to the class of its text; class_id is null only where no text of the class has a key. Keys may be numbers or text. Other columns don't matter, texts may have any length, and an empty table
    gives no rows. The result is a table in the shared folder.
    """
    return _classified(docs, key, text, size, threshold, rows, count, tile).select("doc_id", "class_id", "n_shingles")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` of each class, with the columns that it had: that of the smallest key.

    Null keys come after all others; of rows with the same key and different texts, that of the smallest hash of its text is taken, and of
    rows with the same key and text any one. Clashing names of other columns don't matter.
    """
    choice = {"size": SIZE, "threshold": THRESHOLD, "rows": ROWS, "count": BANDS, "tile": TILE} | options
    found = _classified(docs, key, text, **choice)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")
    counted = stored(found.groupBy("component", "doc_id", "hash").agg(F.count(F.lit(1)).alias("copies")), "counted")
    first = stored(counted.groupBy("component").agg(F.min(rank).alias("first")), "first")  # tables, so that the join can split a large class
    each = counted.join(first, "component")
    chosen = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash"))
    id_, hash_ = unused(docs, "__key", "__hash")
    each = stored(each.select(F.col("doc_id").alias(id_), F.col("hash").alias(hash_), "copies", chosen.alias("chosen")), "survivors")
    for table in (found, counted, first):
        drop_stored(table)
    at = F.col(f"`{key}`").cast(each.schema[id_].dataType).eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))) == F.col(hash_))
    gone, again = each.where("not chosen").select(id_, hash_), each.where("chosen and copies > 1").select(id_, hash_)
    kept = docs.join(small(gone), at, "left_anti")
    if again.isEmpty():
        return kept
    once = kept.join(small(again), at, "left_anti")
    return once.unionByName(kept.join(small(again), at).dropDuplicates([id_, hash_]).select(*(F.col(f"`{c}`") for c in docs.columns)))
