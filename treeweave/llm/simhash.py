"""SimHash near-duplicate groups by pigeonhole blocks (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeweave.operators.components import connected_components
from treeweave.runtime import col_of, fresh_name, materialize, shuffle_partitions

#: 64 bits in five blocks; with at most three differing bits, two blocks agree.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
MAX_DISTANCE = 3
#: Fingerprints of a bucket that are compared in one go; larger buckets are cut into pairs of tiles.
TILE = 1024
_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, as an unsigned number.

    A text of fewer words is one shingle; a text without words gives zero.
    """
    words = (text or b"").lower().split()  # bytes: only A-Z and the six ASCII white spaces count
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    spans = range(max(1, len(words) - width + 1))
    ones, n = np.zeros(64, np.int64), len(spans)
    for lo in range(0, n, _SHINGLES_AT_ONCE):
        some = spans[lo : lo + _SHINGLES_AT_ONCE]
        if width == 3 and n > 1:
            part = words[lo : lo + len(some) + 2]
            hashes = [digest(b"%b %b %b" % w, seed) for w in zip(part, part[1:], part[2:])]
        else:
            hashes = [digest(b" ".join(words[i : i + width]), seed) for i in some]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, print, fp)`` for each row; fp is the fingerprint as a signed long, print a hash that tells texts of one id apart."""
    text = col_of(text_col).cast("string")
    narrow = docs.select(col_of(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("print"), pa.array(fps.view(np.int64))], ["doc_id", "print", "fp"])

    return narrow.mapInArrow(run, "doc_id long, print long, fp long")


def block_keys(fp: Column) -> Column:
    """The ten keys of a fingerprint: each pair of its five blocks, tagged with the pair."""
    part = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << wide) - 1)) for at, wide in BLOCKS]
    pairs = [(i, j) for i in range(len(BLOCKS)) for j in range(i)]
    return F.array(
        *[F.shiftleft(F.shiftleft(F.lit(k).cast("long"), 13).bitwiseOR(part[i]), 13).bitwiseOR(part[j]) for k, (i, j) in enumerate(pairs)]
    )


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: no more links than fingerprints."""
    left, out = np.arange(1, len(fps)), []
    stack = [0] if len(fps) else []
    while stack or len(left):
        if not stack:
            stack, left = [int(left[0])], left[1:]
            continue
        u = stack.pop()
        near = np.bitwise_count(fps[left] ^ fps[u]) <= MAX_DISTANCE
        for v in left[near].tolist():
            out.append((u, v))
            stack.append(v)
        left = left[~near]
    return out


def _links_of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of rows with one cell; a run may span batches, and holds two tiles at most."""
    rest: tuple = (np.empty((0, 3), np.int64), np.empty(0, np.uint64))

    def links(cells: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        ends = np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1
        src, dst = [], []
        for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(fps)]):
            if hi - lo > 1:
                run = fps[lo:hi]
                if hi - lo == 2:
                    found = [(0, 1)] if int(run[0] ^ run[1]).bit_count() <= MAX_DISTANCE else []
                else:
                    found = spanning_links(run)
                src += [run[u] for u, _ in found]
                dst += [run[v] for _, v in found]
        pair = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (src, dst)]
        return pa.RecordBatch.from_arrays(pair, ["src", "dst"])

    for b in batches:
        cells = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
        fps = b.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
        cells, fps = np.concatenate([rest[0], cells]), np.concatenate([rest[1], fps])
        if not len(fps):
            continue
        whole = np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1))
        cut = int(whole[-1]) + 1 if len(whole) else 0
        if cut:
            yield links(cells[:cut], fps[:cut])
        rest = cells[cut:], fps[cut:]
    if len(rest[1]):
        yield links(*rest)


def close_links(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """Links ``(src, dst)`` that connect all distinct fingerprints within three bits.

    Each pair within three bits shares one of ten block keys. A bucket of more
    than ``tile`` fingerprints is cut into tiles by hash, and each pair of tiles
    is a cell of its own, so no task holds a large bucket; each cell gives a
    spanning forest, never all its pairs.
    """
    spark = fps.sparkSession
    keyed = fps.select(F.explode(block_keys(F.col("fp"))).alias("key"), "fp")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    t = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("fp", "key"), F.col("tiles")).cast("int")
    tiled = keyed.join(sizes, "key").withColumn("tiles", t).withColumn("own", own)
    cells = tiled.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    cells = cells.select("key", F.least("own", "other").cast("long").alias("a"), F.greatest("own", "other").cast("long").alias("b"), "fp")
    dealt = cells.repartition(shuffle_partitions(spark), "key", "a", "b").sortWithinPartitions("key", "a", "b")
    return dealt.mapInArrow(_links_of_cells, "src long, dst long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` and ``component_id``.

    component_id is the smallest doc_id that links of three bits or fewer reach.
    Equal fingerprints are one node, so copies cost no links. Null and empty
    texts have fingerprint zero and link as any other. A repeated doc_id gives
    a row each time; a null doc_id gives a row and never names a group, unless
    no member has an id: then component_id is null. Texts are read whole, a
    long one shingle after shingle. An empty table gives no rows. Other columns are ignored.
    """
    prints, by_print = _grouped(docs, id_col, text_col)
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of each row, and each fingerprint's group: ``fp, root, component_id``."""
    prints = materialize(with_fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    labels = connected_components(materialize(close_links(nodes.select("fp")), "links"))
    named = nodes.join(labels, nodes.fp == labels.vertex, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints, named.join(smallest, "root").select("fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each SimHash group: that of the smallest id, or any row where no member has an id.

    All columns stay. Where rows repeat the kept id, and for groups without ids,
    the row with the smallest hash of its text stays, and of rows that repeat
    that text too the one with the smallest hash of all its columns. An empty
    table gives no rows.
    """
    prints, groups = _grouped(docs, id_col, text_col)
    rows = prints.groupBy("fp", "doc_id", "print").agg(F.count(F.lit(1)).alias("n")).join(groups, "fp")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print", "n")
    first = rows.groupBy("root").agg(F.min(rank).alias("k"))
    id_, text = [fresh_name(docs, x) for x in ("kept_id", "kept_print")]
    first = materialize(first.select(F.col("k.doc_id").alias(id_), F.col("k.print").alias(text), F.col("k.n").alias("n")), "kept")
    own = col_of(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(col_of(text_col).cast("string")) == F.col(text))
    once = docs.join(first.where("n = 1").drop("n"), own, "left_semi")
    # Rows that bear one id and one text: a rank filter, which Spark cuts to a row a task before the shuffle.
    again = docs.join(first.where("n > 1").drop("n"), own)
    place = fresh_name(docs, "place")
    numbered = again.withColumn(place, F.row_number().over(W.partitionBy(id_, text).orderBy(F.xxhash64(*[_hashable(docs, c) for c in docs.columns]))))
    return once.unionByName(numbered.where(F.col(place) == 1).select(*[col_of(c) for c in docs.columns]))


def _hashable(docs: DataFrame, name: str) -> Column:
    """A column as a hash takes it: maps can't be hashed as they are."""
    return F.to_json(F.struct(col_of(name))) if "map<" in docs.schema[name].dataType.simpleString() else col_of(name)
