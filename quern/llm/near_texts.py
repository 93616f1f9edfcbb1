"""Near-duplicate texts by word shingles: Jaccard similarity of at least ``threshold``.

This is the wider search that the pipeline's near_dedup stage makes with the
SimHash operator (``simhash_dedup``): three differing bits of 64 miss most edited
copies of short texts, so its fingerprints are wider here and so is its radius.
An exact check of whole shingle sets follows.

Fingerprints. Texts with equal sets of five-word shingles are one row from the
start. Each set has ``BITS`` majority bits. A bit of two sets of similarity s
differs with a probability of arccos(2s / (1 + s)) / pi or little more (0.152 at
0.8, 0.1875 for sets of four and five). The radius is 4.5 standard
deviations above the larger one (76 bits of 256); unrelated texts differ in 128
bits, give or take 8.

Search. At such a radius no division into cells is lossless. Rows meet in cells by
``CELL_BITS`` bits of each of the 32 bytes, and inside a cell by finer keys of
further bits; how many bits follows from the rows in the cell, how many keys from
the bits, so that nothing is capped and a pair at the radius's similarity is
missed as seldom at any size. Among rows that meet, the operator's pivot distance
tables discard pairs by the triangle inequality and the survivors are verified
bit by bit. Pivots are rows of the cell: only those near a large group tell it
from the rest at this radius. What leaves a cell are the components of its rows.
Simulated misses of 200,000 pairs, at 4, 8 and 14 bits of a finer key: none at a
difference of 0.1515 a bit; 6, 11 and 14 at 0.1875. The radius misses 8 in a
million pairs at 0.1875 and none to speak of at 0.1515.

Links. All pairs of a large group of copies must not be formed, and need not be.
Near copies meet in many of the 32 cells, so what the cells found is put together
before any text is read: groups that share a set are one, and each set is one row
from then on. Each set is first compared with one anchor, the most central set of
most of the cells it was found in. What this links is one component. Groups whose
sets are then in different components are searched in full, so that no candidate
link between components is left out, not even one that no cell has found: from
the sets of one component the search goes to those not reached yet. No pairs are
formed as rows; a group whose sets take more than ``BLOCK_BYTES`` is searched by
pairs of blocks. All comparisons are of whole sets.

Defined results: texts under five words are one shingle; null and empty texts
have no shingle and are copies of each other. Very long texts are read whole. An
empty table has no rows. Repeated rows each have theirs. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.bottom_k import shingle_hashes
from quern.llm.common import slices, text_bytes, text_digest, tidied, written
from quern.llm.simhash_dedup import bit_sums, components, distances, forest, group_forest, majority, named_components, roots
from quern.llm.word_table import gathered

BITS, CELL_BITS, PIVOTS = 256, 6, 4
BLOCK_BYTES = 8 << 20
SALTS = np.random.default_rng(42).integers(1, 1 << 63, BITS // 64, dtype=np.uint64)
#: Share of pairs at the radius's similarity that the finer keys of one cell may miss; there are 32 cells.
MISSED = 0.03


def shingles(text: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(shingle_hashes(text, n)).view(np.uint64)


def wide_fingerprint(grams: np.ndarray) -> np.ndarray:
    """``BITS`` majority bits of a set of shingle hashes, as 64-bit words."""
    sums = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(grams), 1 << 12):
        h = (grams[i : i + (1 << 12), None] ^ SALTS) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        sums += bit_sums(h ^ (h >> np.uint64(32)))
    return majority(sums, len(grams))


def differing(threshold: float) -> float:
    """Probability that a bit of two sets of this similarity differs, with what the ties of the smallest sets add."""
    return float(np.arccos(2 * threshold / (1 + threshold)) / np.pi) + 0.036


def spread(p: float, deviations: float) -> float:
    """The share of differing bits so many standard deviations above ``p``."""
    return p + deviations * (p * (1 - p) / BITS) ** 0.5


def radius(threshold: float) -> int:
    return int(BITS * spread(differing(threshold), 4.5))


def _set_key(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes())


def sketches(df: DataFrame, text: str, id_col: str, threshold: float) -> DataFrame:
    """``id_col, digest, fp`` (a hash of the shingle set) and ``words`` (its wide fingerprint) of each row.

    ``words`` is null for sets so small that only an equal one can be similar enough.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            fps, words = [], []
            for t in text_bytes(batch.column("text")):
                grams = shingles(t)
                fps.append(_set_key(grams))
                words.append(wide_fingerprint(grams).tobytes() if len(grams) >= threshold * (len(grams) + 1) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(words, pa.binary())], ["id", "digest", "fp", "words"])
            tidied()

    rows = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).withColumn("digest", text_digest("text"))
    return rows.mapInArrow(run, f"id {kind}, digest long, fp long, words binary").withColumnRenamed("id", id_col)


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), BITS // 64)


def celled(distinct: DataFrame) -> DataFrame:
    """``cell, fp, words``: a row for each byte of the fingerprint, in the cell of its first ``CELL_BITS`` bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = BITS // 8
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                first = _words(part.column("words")).view(np.uint8).astype(np.int32) & ((1 << CELL_BITS) - 1)
                again = pa.array(np.repeat(np.arange(part.num_rows), n))
                yield pa.RecordBatch.from_arrays([pa.array((first + (np.arange(n, dtype=np.int32) << CELL_BITS)).ravel()), part.column("fp").take(again), part.column("words").take(again)], ["cell", "fp", "words"])

    return distinct.filter("words IS NOT NULL").select("fp", "words").mapInArrow(run, "cell int, fp long, words binary")


def finer_keys(words: np.ndarray, cell: int, p: float) -> Iterator[np.ndarray]:
    """Keys of the rows of a cell that share few rows each; a pair whose bits differ with probability ``p`` has one in common but for ``MISSED``, be it 1.5 deviations above."""
    p = spread(p, 1.5)
    n = max(0, int(np.ceil(np.log2(len(words) / 16))))
    rng = np.random.default_rng(cell >> CELL_BITS)
    for _ in range(int(np.ceil(np.log(MISSED) / np.log1p(-((1 - p) ** n)))) if n else 1):
        key = np.zeros(len(words), dtype=np.int64)
        for bit in rng.permutation(BITS)[:n].tolist():
            key = key << 1 | (words[:, bit >> 6] >> np.uint64(bit & 63) & np.uint64(1)).astype(np.int64)
        yield key


def cell_components(words: np.ndarray, cell: int, most: int, p: float) -> np.ndarray:
    """The smallest index of the component of each row: those at ``most`` or fewer differing bits that share a finer key."""
    pivots = words[np.linspace(0, len(words) - 1, PIVOTS).astype(np.int64)]
    table = np.stack([distances(words, x) for x in pivots], axis=1)
    a = b = np.zeros(0, dtype=np.int64)
    for key in finer_keys(words, cell, p):
        order = np.argsort(key, kind="stable")
        a, b = forest(len(words), [(a, b), group_forest(key[order], order, words, table, most)])
    return roots(len(words), a, b)


def central(words: np.ndarray) -> int:
    """The row that differs least from the majority of all rows in each bit."""
    sums = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(words), 1 << 12):
        sums += bit_sums(words[i : i + (1 << 12)])
    return int(distances(words, majority(sums, len(words))).argmin())


def near_groups(cells: DataFrame, most: int, p: float) -> DataFrame:
    """``fp, least, o``: the sets of each component of two or more inside a cell, with its smallest and its most central set."""

    def solved(cell: int, fps: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        root = cell_components(words, cell, most, p)
        order = np.argsort(root, kind="stable")
        groups = [g for g in np.split(order, np.flatnonzero(np.diff(root[order])) + 1) if len(g) > 1]
        none = np.zeros(0, dtype=np.int64)
        sizes = np.array([len(g) for g in groups], dtype=np.int64)
        least, o = (np.repeat(np.array([pick(g) for g in groups], dtype=np.int64), sizes) for pick in (lambda g: fps[g].min(), lambda g: fps[g[central(words[g])]]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (fps[np.concatenate([none, *groups])], least, o)], ["fp", "least", "o"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fps, words = None, [], []
        for batch in batches:
            all_ = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(all_)) + 1).tolist(), len(all_)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if fps and cell != int(all_[x]):
                    yield solved(cell, np.concatenate(fps), np.concatenate(words))
                    fps, words = [], []
                cell = int(all_[x])
                fps.append(batch.column("fp").slice(x, y - x).to_numpy())
                words.append(_words(batch.column("words").slice(x, y - x)))
        if fps:
            yield solved(cell, np.concatenate(fps), np.concatenate(words))

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "fp long, least long, o long")


def _pair(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose whole sets are similar enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(*(batch.column(c).to_pylist() for c in ("x", "y"))):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                small, large = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if small >= threshold * large else 0
                ok.append(both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = sets.select(F.col("fp").alias("a"), F.col("grams").alias("x")), sets.select(F.col("fp").alias("b"), F.col("grams").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def candidates(members: DataFrame) -> DataFrame:
    """``fp, key, o``: a row for each set, with the group that all cells together make of it and the anchor that most of them name.

    The cells' sets are linked to their smallest ones, never to each other.
    """
    named = members.groupBy("fp", "o").agg(F.count("*").alias("n")).groupBy("fp").agg(F.max(F.struct("n", "o"))["o"].alias("o"))
    tree = components(members.select(F.col("fp").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("fp"), "root")
    return named.join(tree, "fp", "left").select("fp", F.coalesce("root", "fp").alias("key"), "o")


def group_links(root: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Spanning links between the components of one group; sets of equal ``root`` are linked already.

    A set that is similar enough holds so many shingles of ``x`` that it has one
    of any ``few`` of them: those that fewest of the sets not reached yet have
    tell which of these are compared. Where those are most of them, all are.
    """
    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    flag = np.zeros(int(codes.max(initial=-1)) + 1, dtype=bool)
    few = np.minimum(sizes, sizes - np.ceil(threshold * sizes - 1e-6).astype(np.int64) + 1)
    _, kind, members = np.unique(root, return_inverse=True, return_counts=True)
    links: list[tuple[int, int]] = []
    queue = np.flatnonzero(kind == members.argmax()).tolist()
    alive = kind != members.argmax()
    left, built = int(alive.sum()), 0
    while left:
        if not queue:
            queue = np.flatnonzero(alive & (kind == kind[alive.argmax()])).tolist()
            alive[queue] = False
            left -= len(queue)
            continue
        if not built or 4 * left < 3 * built:  # who holds each shingle, of the sets not reached yet
            rest, built = np.flatnonzero(alive), left
            held = gathered(codes, starts[rest], sizes[rest])
            owner = np.repeat(rest, sizes[rest])[np.argsort(held, kind="stable")]
            often = np.bincount(held, minlength=len(flag))
            first = np.cumsum(often) - often
        x = queue.pop()
        own = codes[starts[x] : starts[x] + sizes[x]]
        rare = own[np.argpartition(often[own], few[x] - 1)[: few[x]]]
        if 4 * often[rare].sum() < built:
            near = np.unique(gathered(owner, first[rare], often[rare]))
            near = near[alive[near]]
            theirs = gathered(codes, starts[near], sizes[near])
        else:
            near, theirs = rest, held
        if not len(near):
            continue
        flag[own] = True
        both = np.add.reduceat(flag[theirs], np.cumsum(sizes[near]) - sizes[near], dtype=np.int64)
        flag[own] = False
        near = near[alive[near] & (both >= threshold * (sizes[x] + sizes[near] - both))]
        if len(near):
            reached, at = np.unique(kind[near], return_index=True)
            links += [(x, int(near[k])) for k in at]
            go = np.flatnonzero(alive & np.isin(kind, reached))
            queue += go.tolist()
            alive[go] = False
            left -= len(go)
    return links


def open_links(members: DataFrame, tree: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: links that connect different components inside the groups."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held_rows = None, []

        def solved() -> pa.RecordBatch:
            fps = [r[0] for r in held_rows]
            found = group_links(np.array([r[1] for r in held_rows]), [np.frombuffer(r[2], "<u8") for r in held_rows], threshold) if len(fps) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([min(fps[i], fps[j]) for i, j in found], pa.int64()), pa.array([max(fps[i], fps[j]) for i, j in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for key, x, y, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "x", "y", "fp", "root", "grams"))):
                if group != (key, x, y) and held_rows:
                    yield solved()
                    held_rows = []
                group = (key, x, y)
                held_rows.append(row)
        if held_rows:
            yield solved()

    rows = members.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    several = rows.groupBy("key").agg((F.min("root") < F.max("root")).alias("open")).filter("open").select("key")
    rows = written(rows.join(several, "key").join(sets, "fp"), "near-open")
    sizes = rows.groupBy("key").agg(F.ceil(F.sum(F.octet_length("grams")) / BLOCK_BYTES).cast("int").alias("n"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(F.least(j, "i").alias("x"), F.greatest(j, "i").alias("y")))
    spread = rows.join(sizes, "key").withColumn("i", F.pmod(F.xxhash64("fp"), "n").cast("int")).select("key", "fp", "root", "grams", F.explode(blocks).alias("b"))
    dealt = spread.select("key", "b.x", "b.y", "fp", "root", "grams").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_texts(df: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """``id_col, digest, fp, root, component_id`` of each row, as ``simhash_dedup.near_duplicates``."""

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array([shingles(t).tobytes() for t in text_bytes(batch.column("text"))], pa.binary())], ["fp", "grams"])
            tidied()

    marked = written(sketches(df, text, id_col, threshold), "near-sketches")
    distinct = written(marked.groupBy("fp").agg(F.min(id_col).alias("least"), F.min("digest").alias("digest"), F.first("words").alias("words")), "near-distinct")
    members = written(near_groups(celled(distinct), radius(threshold), differing(threshold)), "near-members")
    near = written(candidates(members), "near-candidates")
    wanted = written(distinct.select("fp", "digest").join(near.select("fp"), "fp"), "near-wanted").hint("merge")
    texts = df.select(F.col(text).cast("string").alias("text")).withColumn("digest", text_digest("text")).join(wanted, "digest")
    sets = written(texts.select("fp", "text").mapInArrow(grams, "fp long, grams binary").dropDuplicates(["fp"]), "near-sets")
    anchored = near.filter("fp <> o").select(*_pair("fp", "o")).distinct()
    edges = written(verified(anchored, sets, threshold), "near-edges")
    rest = written(open_links(near.select("key", "fp"), components(edges), sets, threshold), "near-rest")
    return named_components(marked.select(id_col, "digest", "fp"), distinct.select("fp", "least"), components(edges.unionByName(rest)), id_col)
