"""Near duplicates: SuperMinHash signatures, banding, exact verification, grouping.

1. Documents with equal shingle sets collapse to one class, so copies cost one row.
2. Every class gets a SuperMinHash signature; bands of it are bucket keys.
3. Members of a bucket are compared with its smallest id on their full sets, and
   the links are grouped by distributed union-find (star contraction).
4. Where a bucket still spans several groups, the members outside the group of a
   pivot, another one in each bucket, are compared with it, a few times over.
5. Where a bucket spans several groups even then, all its pairs from different
   groups that can still reach the similarity are compared, in blocks, so no link
   between groups is lost. Bitmaps of the sets bound every overlap from above
   (each differing shingle flips a bit, so sets differ in no less than the
   bitmaps do), which leaves few pairs besides the true links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import extended, mixed, named, row_slices, text_bytes, written
from panelspark.llm.graph import components
from panelspark.llm.words import shingle_sets

BANDS, BAND_ROWS = 32, 5
_SLICE_BYTES = 1 << 20
_BLOCK_ELEMENTS = 60_000
_BUCKET_BLOCK = 1_000
_PIVOT_ROUNDS = 1
_BITMAP_LONGS = 32
_NEVER = np.uint64(2**64 - 1)


def super_minhash(hashes: np.ndarray, owners: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """SuperMinHash of the sets ``owners`` -> ``hashes``, as a rows x slots table.

    In step j every element draws a number and the next place of its own random
    permutation, and offers j + number there. A row stops once no later step can
    lower any of its places, after a few steps for large sets. Elements are
    taken in blocks; later blocks start from the table so far.
    """
    table = np.full(rows * slots, _NEVER, np.uint64)
    grid = table.reshape(rows, slots)
    for begin in range(0, len(hashes), _BLOCK_ELEMENTS):
        block, owner = hashes[begin : begin + _BLOCK_ELEMENTS], owners[begin : begin + _BLOCK_ELEMENTS]
        order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(block), 1))
        active = np.arange(len(block))
        present = np.unique(owner)
        for step in range(slots):
            draw = mixed(block[active] + np.uint64((step + 1) * 0xE7037ED1A0B428DB & (2**64 - 1)))
            offer = (np.uint64(step) << np.uint64(40)) | (draw >> np.uint64(24))
            place = step + ((draw & np.uint64(0xFFFFFF)) % np.uint64(slots - step)).astype(np.int64)
            slot = order[active, place]
            order[active, place] = order[active, step]
            np.minimum.at(table, owner[active] * slots + slot, offer)
            present = present[grid[present].max(axis=1) >= (np.uint64(step + 1) << np.uint64(40))]
            if not len(present):
                break
            going = np.zeros(rows, bool)
            going[present] = True
            active = active[going[owner[active]]]
    return grid


def band_keys(signatures: np.ndarray, bands: int, band_rows: int) -> np.ndarray:
    """One 64-bit key for each row and band."""
    keys = np.zeros((len(signatures), bands), np.uint64)
    for k in range(band_rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + signatures[:, k::band_rows][:, :bands])
    return mixed(keys + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)).view(np.int64)


def _shingles(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(batch.column("text"))
    for first, last in row_slices(offsets, _SLICE_BYTES):
        low, high = offsets[first], offsets[last]
        hashes, owners = shingle_sets(data[low:high], offsets[first : last + 1] - low, size)
        yield first, last, hashes, owners


def _signed(batches: Iterator[pa.RecordBatch], size: int, bands: int, band_rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, hashes, owners in _shingles(batch, size):
            rows = last - first
            counts = np.bincount(owners, minlength=rows)
            sums = np.zeros((2, rows), np.uint64)
            for k, salt in enumerate((0x2545F4914F6CDD1D, 0x94D049BB133111EB)):
                np.add.at(sums[k], owners, mixed(hashes ^ np.uint64(salt)))
            keys = band_keys(super_minhash(hashes, owners, rows, bands * band_rows), bands, band_rows)
            part = batch.slice(first, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(c) for c in part.schema.names if c != "text"],
                    pa.array(counts.astype(np.int64)),
                    pa.array(sums[0].view(np.int64)),
                    pa.array(sums[1].view(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(rows + 1, dtype=np.int32) * bands), pa.array(keys.ravel())
                    ),
                ],
                names=[*[c for c in part.schema.names if c != "text"], "n_shingles", "set_a", "set_b", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, hashes, owners in _shingles(batch, size):
            rows = last - first
            ends = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=rows))])
            width = 64 * _BITMAP_LONGS
            flips = np.bincount(owners * width + (hashes % np.uint64(width)).astype(np.int64), minlength=rows * width)
            bits = np.packbits((flips & 1).astype(bool).reshape(rows, width), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, rows),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes.view(np.int64))),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(rows + 1, dtype=np.int32) * _BITMAP_LONGS), pa.array(bits.ravel())
                    ),
                ],
                names=["doc_id", "members", "bits"],
            )


def _close_sizes(a: Column, b: Column, percent: int) -> Column:
    """Two sets can only reach the similarity if their sizes are this close."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _reachable_pairs(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one bucket and pair of blocks, from different groups, that sizes and
    bitmaps allow to be links."""
    rep, n, group = (table.column(c).to_numpy() for c in ("rep", "n", "component"))
    block, i, j = (table.column(c).to_numpy() for c in ("block", "i", "j"))
    bits = table.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, _BITMAP_LONGS)
    left = np.flatnonzero(block == i)
    right = left if i[0] == j[0] else np.flatnonzero(block == j)
    found_a, found_b = [], []
    for k in left:
        other = right[(group[right] != group[k]) & (rep[right] < rep[k] if i[0] == j[0] else True)]
        other = other[100 * np.minimum(n[other], n[k]) >= percent * np.maximum(n[other], n[k])]
        if len(other):
            differ = np.bitwise_count(bits[other] ^ bits[k]).sum(axis=1, dtype=np.int64)
            other = other[(100 + percent) * differ <= (100 - percent) * (n[other] + n[k])]
            found_a.append(np.maximum(rep[other], rep[k]))
            found_b.append(np.minimum(rep[other], rep[k]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (band, i, j) to the pairs of each such run."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        keys = np.stack([table.column(c).to_numpy() for c in ("band", "i", "j")])
        starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1])
        for begin, end in zip(starts[:-1], starts[1:]):
            a, b = _reachable_pairs(table.slice(begin, end - begin), percent)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        rest = table.slice(starts[-1]) if table.num_rows else None
    if rest is not None and rest.num_rows:
        a, b = _reachable_pairs(rest, percent)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def verified_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left, right = sets.toDF("a", "set_of_a"), sets.toDF("b", "set_of_b")
    common = F.size(F.array_intersect("set_of_a", "set_of_b"))
    whole = F.size("set_of_a") + F.size("set_of_b")
    return (
        pairs.groupBy("a").agg(F.collect_list("b").alias("others"))
        .join(left, "a")
        .select("a", "set_of_a", F.explode("others").alias("b"))
        .join(right, "b")
        .where(100 * common >= percent * (whole - common))
        .select("a", "b")
    )


def near_groups(
    df: DataFrame,
    text_column: str = "text",
    id_column: str = "doc_id",
    shingle_words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
    carry: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased. A document's set
    holds its distinct runs of ``shingle_words`` words; one with fewer words has
    its whole sequence, one without words (or null) an empty set that links to
    nothing. Documents are linked when 100 * intersection >= ``percent`` * union
    of the full sets. ``component_id`` is the smallest id reachable through
    links; ``kept`` marks one row for each component. Repeated rows share a
    component and one is kept. A row with a null id has its component in its set's
    class only. An empty table gives an empty result. ``carry`` adds the input
    row as the struct ``row``.

    A link of similarity s is a candidate with probability
    1 - (1 - s^band_rows)^bands: at 0.8 all but 3 in a million with the defaults.
    """
    picked = df.select(
        named(df, id_column).cast("long").alias("doc_id"),
        named(df, text_column).alias("text"),
        *([F.struct(*[named(df, c) for c in df.columns]).alias("row")] if carry else []),
    )
    base = written(
        picked.mapInArrow(
            partial(_signed, size=shingle_words, bands=bands, band_rows=band_rows),
            extended(picked, "text", "n_shingles long, set_a long, set_b long, bands array<long>"),
        ).withColumn("row_no", F.monotonically_increasing_id()),
        "signatures",
    )
    filled = base.where("n_shingles > 0")
    # the representative's signature is the class's: equal sets have equal bands
    classes = written(
        filled.groupBy("set_a", "set_b", "n_shingles").agg(
            F.min("doc_id").alias("rep"),
            F.coalesce(F.min_by("row_no", "doc_id"), F.min("row_no")).alias("rep_row"),
        ),
        "set-classes",
    )
    signed = filled.select("row_no", "bands").join(
        classes.where("rep IS NOT NULL").select(F.col("rep_row").alias("row_no"), "rep", F.col("n_shingles").alias("n")),
        "row_no",
    )
    entries = written(signed.select("rep", "n", F.explode("bands").alias("band")), "band-entries")
    hubs = (
        entries.groupBy("band")
        .agg(F.count("*").alias("n_members"), F.min("rep").alias("hub"), F.min_by("n", "rep").alias("hub_n"))
        .where("n_members > 1")
    )
    buckets = written(entries.join(written(hubs, "band-hubs"), "band"), "buckets")
    star = written(
        buckets.where((F.col("rep") != F.col("hub")) & _close_sizes(F.col("n"), F.col("hub_n"), percent))
        .select(*_ordered(F.col("rep"), F.col("hub"))).distinct(),
        "star-pairs",
    )
    nodes = written(buckets.select(F.col("rep").alias("doc_id")).distinct(), "candidates")
    # one text per candidate class: its representative row
    texts = picked.select("doc_id", "text").where("doc_id IS NOT NULL").join(nodes, "doc_id", "left_semi")
    sets = written(
        texts.dropDuplicates(["doc_id"])
        .mapInArrow(partial(_sets, size=shingle_words), "doc_id long, members array<long>, bits array<long>"),
        "shingle-sets",
    )
    sets, bitmaps = sets.select("doc_id", "members"), sets.select(F.col("doc_id").alias("rep"), "bits")
    grouped = written(components(written(verified_links(star, sets, percent), "links")), "groups")
    done, split = star, buckets.select("band", "rep", "n", "n_members")
    for step in range(_PIVOT_ROUNDS + 1):
        split = _spanning(split, grouped)
        pairs = (
            _pivot_pairs(split, step, percent)
            if step < _PIVOT_ROUNDS
            else _all_pairs(split.join(bitmaps, "rep"), percent)
        )
        pairs = written(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        more = written(verified_links(pairs, sets, percent), "links")
        done = done.unionByName(pairs)
        if not more.isEmpty():
            old = grouped.select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
            grouped = written(components(old.unionByName(more)), "groups")
    members = classes.join(grouped.toDF("rep", "component"), "rep", "left").select(
        F.col("set_a").alias("class_a"), F.col("set_b").alias("class_b"), F.col("n_shingles").alias("class_n"),
        F.coalesce("component", "rep").alias("component"),
        F.when(F.coalesce("component", "rep").eqNullSafe(F.col("rep")), F.col("rep_row")).alias("kept_row"),
    )
    members = written(members, "class-groups")
    same = (base.set_a == members.class_a) & (base.set_b == members.class_b) & (base.n_shingles == members.class_n)
    empty = F.col("n_shingles") == 0
    if carry:  # whole rows move once, at every size alike
        members = members.hint("merge")
    return base.join(members, same, "left").select(
        "doc_id",
        "n_shingles",
        F.when(empty, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        (empty | F.coalesce(F.col("row_no") == F.col("kept_row"), F.lit(False))).alias("kept"),
        *(["row"] if carry else []),
    )


def _spanning(buckets: DataFrame, grouped: DataFrame) -> DataFrame:
    """The members of the buckets that span several groups, with their groups."""
    placed = written(
        buckets.select("band", "rep", "n", "n_members")
        .join(grouped.toDF("rep", "component"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep")),
        "bucket-groups",
    )
    return _of_several_groups(placed)


def _of_several_groups(placed: DataFrame) -> DataFrame:
    split = (
        placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high").select("band")
    )
    return written(placed.join(written(split, "split-buckets"), "band"), "spanning")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _pivot_pairs(members: DataFrame, step: int, percent: int) -> DataFrame:
    """Each bucket's pivot, chosen by a hash, against the members of other groups."""
    place = F.xxhash64("band", "rep", F.lit(step))
    pivots = members.groupBy("band").agg(
        F.min_by("rep", place).alias("pivot"), F.min_by("n", place).alias("pivot_n"),
        F.min_by("component", place).alias("pivot_component"),
    )
    return (
        members.join(written(pivots, "pivots"), "band")
        .where((F.col("component") != F.col("pivot_component")) & _close_sizes(F.col("n"), F.col("pivot_n"), percent))
        .select(*_ordered(F.col("rep"), F.col("pivot"))).distinct()
    )


def _all_pairs(members: DataFrame, percent: int) -> DataFrame:
    """All pairs of one bucket from different groups that may be links.

    A bucket is cut into blocks of about a thousand members; each pair of blocks
    is compared in one task, whatever the bucket's size, and only what the
    exact bounds leave is given out.
    """
    blocks = F.ceil(F.col("n_members") / _BUCKET_BLOCK).cast("int")
    members = members.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = members.select(
        "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "rep", "n", "component", "bits",
    )
    return (
        placed.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
        .mapInArrow(partial(_compared, percent=percent), "a long, b long").distinct()
    )


def near_dedup(df: DataFrame, text_column: str = "text", id_column: str = "doc_id", **options) -> DataFrame:
    """One whole row of each group of near duplicates; rules as in ``near_groups``."""
    return near_groups(df, text_column, id_column, carry=True, **options).where("kept").select("row.*")
