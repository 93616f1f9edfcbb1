"""SimHash near-duplicate groups with pivot distance tables.

Fingerprints: 64 majority bits of the XXH64 (seed 42) of each word shingle.
Two fingerprints link at ``max_distance`` (3) or fewer differing bits; linked
fingerprints form components.

Search. Equal fingerprints are one row (grouped with map-side sums), so a group
of exact copies costs one row from then on. For each fingerprint the Hamming
distances to ``PIVOTS`` reference fingerprints are its coordinates. By the
triangle inequality a pair whose coordinates differ by more than 3 anywhere
cannot link: it is discarded by its maximum coordinate difference, and only the
survivors are verified bit by bit. One coordinate lets about half of all pairs
through, so the tables alone would need all pairs of a large corpus to meet.
Rows therefore meet in lossless cells: with 3 differing bits at most, one of four
16-bit blocks is equal, and one of four quarters of the other 48 bits. That gives
16 cell keys of 28 bits a fingerprint. A cell with more than ``WIDE`` rows is
divided again by the quarters of its remaining 36 bits, before the shuffle. In a
cell the pivot tables do the search: rows are ordered by the first coordinate,
and from each row reached the search goes on to those not reached yet. What
leaves a cell is a spanning forest, never all its pairs, and a dense group of any
size costs about its rows, not their square.

Components: alternating large-star and small-star over the forest edges, each
round written to shared storage.

Defined results: null and empty texts have fingerprint zero, linked like any
other. Repeated rows are kept; each has its component. A null id is never the
smallest; where a component has null ids alone, its id is null. Very long texts
are read whole, 32,768 shingles at a time. An empty table has no rows. Other
columns are not touched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import documents, keyed, slices, text_bytes, text_digest, without, words_of, written

SEED = 42
PIVOTS = 32
WIDE = 2048


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints by rule: the SplitMix64 sequence from 1."""
    out, x, mask = [], 1, (1 << 64) - 1
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & mask
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes, rows of 64-bit words, have each bit."""
    bits = np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
    return np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def majority(sums: np.ndarray, n: int) -> np.ndarray:
    """64-bit words of the bits that over half of ``n`` hashes have."""
    return np.packbits(2 * sums > n, bitorder="little").view("<u8")


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the shingle hashes; 0 without words."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        total += bit_sums(np.array(hashes[i : i + (1 << 15)], dtype="<u8")[:, None])
    return int(majority(total, len(hashes))[0])


def fingerprints(df: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """``id_col``, ``digest`` (a hash of the whole text) and ``fp`` (the 64 bits as a long) of each row; no shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column("text"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(fps, pa.int64())], ["id", "digest", "fp"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).withColumn("digest", text_digest("text"))
    return rows.mapInArrow(run, f"id {kind}, digest long, fp long").withColumnRenamed("id", id_col)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _bits(column: Column, spans: list[tuple[int, int]]) -> Column:
    """The bits of the spans (offset, width), packed to the right."""
    out = F.lit(0).cast("long")
    for offset, width in spans:
        out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(column, offset).bitwiseAND(F.lit((1 << width) - 1)))
    return out


def _cells() -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """For each of the 16 tables: the spans of its key, and the spans left over."""
    out = []
    for a in range(4):
        rest = [(16 * b + 4 * q, 4) for b in range(4) if b != a for q in range(4)]
        for q in range(4):
            key = rest[3 * q : 3 * q + 3]
            out.append(([(16 * a, 16), *key], [s for s in rest if s not in key]))
    return out


def celled(distinct: DataFrame) -> DataFrame:
    """``cell, fp`` rows: 16 for each fingerprint, and four in the place of one whose cell is wide."""
    keys = [F.lit(t << 28).bitwiseOR(_bits(F.col("fp"), key)) for t, (key, _) in enumerate(_cells())]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("cell"))
    wide = rows.groupBy("cell").count().filter(F.col("count") > WIDE).select("cell", F.lit(True).alias("wide"))
    finer = None
    for t, (_, rest) in enumerate(_cells()):
        quarters = [F.struct(F.lit(q).alias("q"), _bits(F.col("fp"), rest[slice_]).alias("v")) for q, slice_ in enumerate(_quarters(len(rest)))]
        finer = F.when(F.shiftright("cell", 28) == t, F.array(*quarters)).otherwise(finer) if finer is not None else F.array(*quarters)
    whole = F.array(F.struct(F.lit(-1).alias("q"), F.lit(0).cast("long").alias("v")))
    joined = rows.join(wide, "cell", "left").select("cell", "fp", F.explode(F.when(F.col("wide"), finer).otherwise(whole)).alias("f"))
    return joined.select("cell", F.col("f.q").alias("q"), F.col("f.v").alias("v"), "fp")


def _quarters(n: int) -> list[slice]:
    """Four parts of the left-over spans, as even as can be."""
    cuts = [n * i // 4 for i in range(5)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def linked(fp: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray, max_distance: int = 3) -> np.ndarray:
    """Which pairs link: discarded by the largest coordinate difference, survivors verified."""
    alive = np.arange(len(i))
    for k in range(0, table.shape[1], 4):  # a few columns at a time, over what is left
        if not len(alive):
            break
        gap = np.abs(table[i[alive], k : k + 4] - table[j[alive], k : k + 4]).max(axis=1)
        alive = alive[gap <= max_distance]
    out = np.zeros(len(i), dtype=bool)
    out[alive] = distances(fp[i[alive]], fp[j[alive]]) <= max_distance
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits; a fingerprint is one word or a row of words."""
    bits = np.bitwise_count(x ^ y)
    return bits if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int16)


def search_from(members: np.ndarray, fp: np.ndarray, table: np.ndarray, max_distance: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of one large cell: a search that goes from each member to those not reached yet.

    The rest is kept in order of its first pivot coordinate, so a member meets
    only the range that this coordinate allows; further coordinates discard, and
    survivors are verified. What is linked leaves the rest at once: in a dense
    group nearly all leave with the first few members, so copies of each other
    are not compared pair by pair.
    """
    rest = members[np.argsort(table[members, 0], kind="stable")]
    child: list[np.ndarray] = []
    parent: list[np.ndarray] = []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            first = table[rest, 0]
            a, b = np.searchsorted(first, table[x, 0] - max_distance), np.searchsorted(first, table[x, 0] + max_distance, side="right")
            near = rest[a:b]
            near = near[linked(fp, np.full(len(near), x), near, table, max_distance)]
            if len(near):
                child.append(near)
                parent.append(np.full(len(near), x))
                queue += near.tolist()
                rest = rest[~np.isin(rest, near, assume_unique=True)]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *child]), np.concatenate([none, *parent])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        open_ = label[a] != label[b]
        if not open_.any():
            break
        a, b = a[open_], b[open_]
    while (deeper := label[label] != label).any():
        label = label[label]
    return label


def cell_forest(group: np.ndarray, fp: np.ndarray, max_distance: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (fingerprints) of the links inside each cell; ``group`` is sorted and numbers the cells."""
    nodes, at = np.unique(fp, return_inverse=True)
    table = np.bitwise_count(nodes[:, None] ^ pivots()[None, :]).astype(np.int16)
    a, b = group_forest(group, at, nodes, table, max_distance)
    return nodes[a], nodes[b]


def group_forest(group: np.ndarray, at: np.ndarray, nodes: np.ndarray, table: np.ndarray, max_distance: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of ``nodes`` (by index), whose pivot distances are ``table``; row k of the sorted ``group`` holds node ``at[k]``."""
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        ok = (i != j) & linked(nodes, i, j, table, max_distance)
        if ok.any():
            edges.append((i[ok], j[ok]))

    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(group)]]))
    small = np.repeat(sizes <= 64, sizes)
    row = np.flatnonzero(small)
    for shift in range(1, int(sizes[sizes <= 64].max(initial=1))):
        row = row[row + shift < len(group)]
        row = row[group[row] == group[row + shift]]
        if not len(row):
            break
        for part in range(0, len(row), 1 << 20):
            r = row[part : part + (1 << 20)]
            keep(at[r], at[r + shift])
    for start, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        edges.append(search_from(np.unique(at[start : start + size]), nodes, table, max_distance))
        if len(edges) > 16:  # hold a forest, not all edges
            edges[:] = [forest(len(nodes), edges)]
    return forest(len(nodes), edges)


def forest(n: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not edges:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    label = roots(n, np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def forest_edges(distinct: DataFrame, max_distance: int = 3) -> DataFrame:
    """``a, b`` (longs): enough links to connect what is connected."""
    if not 0 <= max_distance <= 3:
        raise ValueError("the cells are lossless up to 3 differing bits")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = fps = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("cell", "q", "v")], axis=1).astype(np.int64)
            fp = batch.column("fp").to_numpy().view(np.uint64)
            keys, fps = (key, fp) if keys is None else (np.concatenate([keys, key]), np.concatenate([fps, fp]))
            last = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut >= 50_000:  # whole cells only
                yield solve(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if keys is not None and len(keys):
            yield solve(keys, fps)

    def solve(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).any(axis=1)]))
        a, b = cell_forest(group, fps, max_distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    cells = celled(distinct).repartition("cell", "q", "v").sortWithinPartitions("cell", "q", "v", "fp")
    return cells.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node of each component, for nodes that have an edge.

    Large-star and small-star in turn, until nothing changes. Minima are grouped
    with map-side sums; the join back is a plain one, which Spark can split
    where a node has very many edges.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "cc-edges")
    for _ in range(max_rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = written(large.distinct(), "cc-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b")
        after = written(small.distinct(), "cc-small")
        now, then = (x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in (after, edges))
        edges = after
        if now == then:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")


def near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """``id_col, digest, fp, root, component_id`` of each row; ``root`` names the component, whatever its ids."""
    marked = written(fingerprints(df, text, id_col, shingle), "simhash-fp")
    distinct = written(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    return named_components(marked, distinct, components(forest_edges(distinct, max_distance)), id_col)


def named_components(marked: DataFrame, distinct: DataFrame, tree: DataFrame, id_col: str) -> DataFrame:
    """``id_col, digest, fp, root, component_id`` of ``marked`` rows: the smallest id of the component of their ``fp``."""
    root = F.coalesce("root", "fp").alias("root")
    labelled = written(distinct.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("fp", root, "least"), "simhash-members")
    best = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    # Components of one fingerprint need no join: they are named by themselves.
    several = labelled.join(best.filter("n > 1").drop("n"), "root", "left").select("fp", "root", F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(written(several, "simhash-named"), "fp").select(id_col, "digest", "fp", "root", "component_id")


def one_of_each(df: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3, max_distance: int = 3, rows: DataFrame | None = None) -> DataFrame:
    """One row of ``df`` for each component: the one with the smallest id.

    Of rows that share this id the one with the smallest digest stays, once. A
    null id counts as the largest. ``rows`` are those of ``near_duplicates``, or
    of another search with the same columns. Whole rows are shuffled once:
    repeated rows are one from their map task on, and what goes is a list of
    keys that they meet in a merge join on the same partitioning.
    """
    rows = rows if rows is not None else near_duplicates(df, text, id_col, shingle, max_distance)
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("digest").alias("digest"))
    keys = written(rows.select("root", order.alias("key")).distinct(), "dedup-keys")
    best = keys.groupBy("root").agg(F.min("key").alias("best"), F.count("*").alias("n")).filter("n > 1").select("root", "best")
    go = keys.join(best, "root").filter("key <> best").select("key.none", F.coalesce(F.col("key.id").cast("string"), F.lit("")).alias("id"), "key.digest")
    once = keyed(df, id_col, text).groupBy("none", "id", "digest").agg(F.first("row").alias("row"))
    return without(once, written(go, "dedup-go")).select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
