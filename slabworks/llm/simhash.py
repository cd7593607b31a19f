"""SimHash near-dedup by pigeonhole blocks.

A fingerprint has 64 bits. It is split into six blocks; two fingerprints that differ
in at most three bits agree in at least three blocks, so both get the same key for one
of the 20 ways to choose three blocks (32 bits or so each). Fingerprints are joined on
these keys and pairs are verified by Hamming distance. Equal fingerprints are one node
throughout, and a key's fingerprints give the edges of a spanning forest, never all
pairs; components come from label propagation over these edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, keep_rows, keyed, saved, scratch, texts, with_id

BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
SLICE = 1 << 16


def fingerprint(raw: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash over XXH64 of the ``width``-word shingles of the ASCII-lower-cased text.

    Words are what ASCII white space parts; repeats count; fewer words than ``width``
    are one shingle; no word gives zero. A bit is 1 if set in over half the hashes.
    """
    words = raw.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(line, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - width] + 1).tolist()]
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), SLICE):
        bits = np.unpackbits(h[k : k + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _fingerprint_rows(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(raw, width, seed) for raw in texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``id, fp``: the fingerprint of each row as a signed long; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(_fingerprint_rows(width, seed), with_id(docs, id_col, "fp long"))


def _masks(distance: int) -> list[int]:
    """Masks of the blocks that must agree, for each choice of them."""
    block = [((1 << n) - 1) << at for at, n in BLOCKS]
    return [sum(c) for c in combinations(block, len(BLOCKS) - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs within ``distance``, for the distinct fingerprints of a key.

    Each step takes the neighbours of one fingerprint out of those not yet reached,
    which holds one row of distances at a time and never lists the pairs.
    """
    edges, left = [], fps
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            a = stack.pop()
            near = np.bitwise_count(left ^ a) <= distance
            if near.any():
                edges += [(int(a), int(b)) for b in left[near]]
                stack += list(left[near])
                left = left[~near]
    return edges


def _pairs(fps: np.ndarray, distance: int, free: int) -> list[tuple[int, int]]:
    """As ``_forest``; a large key is split again by blocks of the bits it leaves free."""
    if len(fps) <= 4096:
        return _forest(fps, distance)
    bits = [b for b in range(64) if free >> b & 1]
    if len(bits) <= distance + 1:
        return _forest(fps, distance)
    out = []
    for k in range(distance + 1):  # pairs agree in one of distance + 1 blocks
        mask = sum(1 << b for b in bits[k :: distance + 1])
        key = fps & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        part, key = fps[order], key[order]
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1
        start = 0
        for end in ends.tolist():
            if end - start > 1:
                out += _pairs(part[start:end], distance, free & ~mask)
            start = end
    return out


def _edge_rows(distance: int):
    masks = _masks(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []  # of the last key, which may go on in the next batch

        def found(way, key, fp):
            """Edges of the keys that are complete here."""
            ends = np.flatnonzero(np.append((way[1:] != way[:-1]) | (key[1:] != key[:-1]), True)) + 1
            starts = np.append(0, ends[:-1])
            edges = []
            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                edges += _pairs(fp[a:b], distance, ~masks[way[a]] & (1 << 64) - 1)
            e = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

        for batch in batches:
            way, key, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(way):
                continue
            fp = fp.view(np.uint64)
            other = np.flatnonzero((way != way[-1]) | (key != key[-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            if rest and (last or (rest[0][0][0], rest[0][1][0]) != (way[0], key[0])):
                parts = [*rest, (way[:last], key[:last], fp[:last])]
                rest = []
                yield found(*map(np.concatenate, zip(*parts, strict=True)))
            elif last:
                yield found(way[:last], key[:last], fp[:last])
            rest.append((way[last:], key[last:], fp[last:]))
        if rest:
            yield found(*map(np.concatenate, zip(*rest, strict=True)))

    return run


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """``a, b``: edges that connect what pairs of distinct ``fp`` within ``distance`` bits connect."""
    if not 0 <= distance < len(BLOCKS):
        raise ValueError(f"distance must be below {len(BLOCKS)}")
    ways = F.array(*[F.struct(F.lit(k).alias("way"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(_masks(distance))])
    rows = fps.select("fp", F.explode(ways).alias("w")).select("w.way", "w.key", "fp")
    rows = rows.repartition("way", "key").sortWithinPartitions("way", "key", "fp")
    return rows.mapInArrow(_edge_rows(distance), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: connected components of ``a, b`` by alternating large and small stars.

    Every node of an edge gets the smallest node that it reaches. Each round halves
    the paths or so; its rows are written to the shared folder and deleted after the next.
    The joins have unique nodes on one side, so that a node with very many edges is split
    by Spark's adaptive skew join.
    """

    def lowest(both: DataFrame) -> DataFrame:
        return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def star(e: DataFrame, small: bool) -> DataFrame:
        if small:  # edges point from the larger node to the smaller
            out = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        else:
            out = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = lowest(out)
        linked = out.join(m, "u")
        if small:
            made = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
        else:
            made = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return made.where("u != v").distinct()

    with scratch(edges.sparkSession) as save:
        e = save(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        state = None
        while True:
            now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == state:
                break
            state = now
            e = save(star(star(e, small=False), small=True), "edges")
        stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return saved(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """``id_col, fp, component_id, component_size`` of every row.

    Texts whose fingerprints differ in ``distance`` bits or fewer are linked, and
    ``component_id`` is the smallest id that links reach, itself included. Null and
    empty texts have fingerprint zero and are linked like any other; null ids take
    part but are the component's id only where it has no other; repeated rows share
    a component. Other columns aren't read; no rows give no rows.
    """
    rows = saved(fingerprints(docs, id_col, text, width, seed), "fingerprints")
    nodes = saved(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("group_size")), "nodes")
    found = components(links(nodes.select("fp"), distance))
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", "group_size", F.coalesce("root", "fp").alias("root"))
    rooted = saved(rooted, "rooted")
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("group_size").alias("component_size"))
    groups = saved(rooted.join(roots, "root").select("fp", "group_size", "component_id", "component_size"), "groups")
    return join_groups(rows, groups, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "component_size")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component.

    The row with the smallest id stays, before rows without one; of rows that repeat
    the id, the one whose text's digest is smallest.
    """
    found = near_duplicates(keyed(docs, id_col, text).select("__key", text), "__key", text, width, distance)
    return keep_rows(docs, found.withColumn("kept", F.expr("__key = component_id")), id_col, text, "component_size")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
