"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct 5-word shingles (64-bit hashes).  Documents
link when ``100 * |A & B| >= 80 * |A | B|``; the result is connected components.

Tokens are XOR-ed into sketches.  Two sets that differ in d tokens have sketches
that differ in at most d bits, and in at most d of any parts the sketch is cut
into.  Linked sets have ``d <= (|A| + |B|) / 9`` and sizes within 5/4.

1. Sizes are cut into bands.  In the join of band i every set has
   ``parts(i) > D(i)`` parts, D(i) the largest d of a linked pair; so linked sets
   agree in a part (pigeonhole).  The key of a part is the XOR of its tokens.
   Empty parts agree by chance, so there are more parts than D + 1 and they are
   left out where a set fills more than D parts (then an agreeing part is among
   those it fills); a set that doesn't also brings its empty ones.
2. Keys are dealt into shards; sorting a shard shows which sets share a key.  In
   each such bucket all are paired with one set only, its hub: the one with the
   most shared keys, which in a group of near copies is the least edited.
3. Pairs are cut by size and by the Hamming distance of bit sketches, which
   bounds d from below, then verified on the sets.  Links give components.
4. Buckets whose sets lie in several components are gone through in full:
   pairs across components, in blocks, by sketches, then verified.  So no link
   between different components is lost, and no bucket of near copies is expanded.

Sets with equal tokens are one node (64-bit hash of the set and its size), so
copies are neither paired nor shuffled more than once a task.

Defined cases: null and empty texts have no shingles and link with nothing, not
even each other; texts of fewer than five words have one shingle, the whole;
repeated rows share a component; null ids get a component (its smallest id, null
only if it has none); extra columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import stored, task_count, text_of
from tocsin.llm.components import components
from tocsin.llm.exact_dedup import located

WORDS = 5
BAND_RATIO = 1.5
SPARE_PARTS = 1.15
SHARDS_PER_TASK = 4
BLOCK = 2048  # sets of a bucket compared by one task with as many others
SKETCH_BITS = 4  # bits of a sketch for each token, then up to a power of two
LEAST_BITS = 256
PIECE = 1 << 18  # bytes of a text hashed at a time
_U = np.uint64
#: Odd multipliers: one for each place in a shingle, then one for the length.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                    0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=_U)


def length_mark(n: int) -> np.uint64:
    return _U(n * int(_PLACES[-1]) % 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


# Words are hashed by polynomials over random numbers for the bytes; with the
# powers' inverses all words of a piece come from one running sum.
_BYTES = np.random.default_rng(2024).integers(0, 2**64, 256, dtype=_U)
_BASE = 0x5851F42D4C957F2D
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, _U(base), dtype=_U)
    p[0] = 1
    return np.cumprod(p, dtype=_U)


class Powers:
    """Powers of the base and of its inverse, as long as the longest piece so far."""

    def __init__(self) -> None:
        self.up, self.down = self._of(PIECE)

    @staticmethod
    def _of(n: int) -> tuple[np.ndarray, np.ndarray]:
        return _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > PIECE:  # one word longer than a piece: not kept
            return self._of(n)
        return self.up[:n], self.down[:n]


def _piece_hashes(b: np.ndarray, powers: Powers) -> np.ndarray:
    blank = np.ones(len(b) + 2, dtype=bool)
    blank[1:-1] = _BLANK[b]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers.upto(len(b))
    total = np.zeros(len(b) + 1, dtype=_U)
    np.cumsum(_BYTES[b] * up, out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _PLACES[0])


def word_hashes(raw: bytes, powers: Powers) -> np.ndarray:
    """A hash for each word; words stand between blanks and tab to CR."""
    b = np.frombuffer(raw, dtype=np.uint8)
    if len(b) <= PIECE:
        return _piece_hashes(b, powers) if len(b) else np.zeros(0, dtype=_U)
    out, at = [], 0
    while at < len(b):
        size = PIECE
        while True:  # up to the last blank of the piece
            piece = b[at:at + size]
            blanks = np.flatnonzero(_BLANK[piece])
            if at + size >= len(b) or len(blanks):
                break
            size *= 2
        stop = len(b) if at + size >= len(b) else at + int(blanks[-1]) + 1
        out.append(_piece_hashes(b[at:stop], powers))
        at = stop
    return np.concatenate(out)


def shingles(text: str, powers: Powers, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles.  On bytes lower() is A-Z only."""
    h = word_hashes(text.encode("utf-8", "surrogatepass").lower(), powers)
    n = len(h)
    if not n:
        return h
    width = min(n, words)
    total = np.full(n - width + 1, length_mark(width), dtype=_U)
    for k in range(width):
        total += h[k:n - width + 1 + k] * _PLACES[k]
    return np.unique(mixed(total))


def node_of(tokens: np.ndarray) -> int:
    """Names a set, signed 64 bits."""
    x = np.array([np.bitwise_xor.reduce(tokens)], dtype=_U) + length_mark(len(tokens))
    return int(mixed(x).view(np.int64)[0])


def sketch_bits(size: int) -> int:
    return max(LEAST_BITS, 1 << (SKETCH_BITS * size - 1).bit_length())


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the tokens at each bit."""
    n = sketch_bits(len(tokens))
    counts = np.bincount((tokens & _U(n - 1)).astype(np.int64), minlength=n)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The sketch of fewer bits: the halves XOR-ed."""
    while len(bits) > words:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def hamming(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, dtype=_U), np.frombuffer(b, dtype=_U)
    n = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, n) ^ folded(y, n)).sum())


def lower_edges() -> list[int]:
    """Smallest size of each band; sets under 4 link with equal sets only."""
    edges = [4]
    while edges[-1] < 2**31:
        edges.append(math.ceil(edges[-1] * BAND_RATIO))
    return edges


EDGES = lower_edges()


def bands_of(size: int) -> list[int]:
    """The joins that a set takes part in: its own band's, and that of the band
    below if a set there may be large enough."""
    if size < EDGES[0]:
        return []
    own = bisect_right(EDGES, size) - 1
    return [own] + ([own - 1] if own and 4 * size <= 5 * (EDGES[own] - 1) else [])


def band_shape(band: int) -> tuple[int, int]:
    """(D, parts) of a band's join."""
    most = (EDGES[band + 1] - 1) // 4  # (a + b) / 9 with b = 5/4 a, a the largest of the band
    return most, max(most + 1, math.ceil(SPARE_PARTS * most) + 2)


def part_keys(tokens: np.ndarray) -> np.ndarray:
    """The keys under which a set is found."""
    values, places = [], []
    upper = tokens >> _U(32)
    for band in bands_of(len(tokens)):
        most, parts = band_shape(band)
        # by the tokens' upper halves: as the tokens are sorted, so are their parts
        part = upper * _U(parts) >> _U(32)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        filled, value = part[first], np.bitwise_xor.reduceat(tokens, first)
        if len(filled) <= most:  # agreement may lie in empty parts only
            empty = np.setdiff1d(np.arange(parts, dtype=_U), filled)
            filled, value = np.concatenate([filled, empty]), np.concatenate([value, np.zeros(len(empty), _U)])
        values.append(value)
        places.append(filled << _U(6) | _U(band))
    if not values:
        return np.zeros(0, dtype=_U)
    return mixed(np.concatenate(values) ^ mixed(np.concatenate(places) * _PLACES[0]))


def signatures(docs: DataFrame, *kept: str) -> DataFrame:
    """(doc_id, n_shingles, node, sketch, *kept); node and sketch null without shingles."""
    carried = ("doc_id", *kept)
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried)

    def signed(batches):
        powers = Powers()
        for b in batches:
            sets = [shingles(t, powers) for t in b["text"]]
            yield pd.DataFrame({**{c: b[c] for c in carried}, "n_shingles": [len(s) for s in sets],
                                "node": pd.array([node_of(s) if len(s) else None for s in sets], dtype="Int64"),
                                "sketch": [sketch(s) if len(s) else None for s in sets]})

    return (docs.select(*carried, text_of().alias("text"))
            .mapInPandas(signed, f"{kinds}, n_shingles long, node long, sketch binary"))


def sharded_keys(docs: DataFrame, shards: int, at_once: int = 2000) -> DataFrame:
    """(shard, keys, nodes): packed keys and the sets they belong to."""
    def dealt(batches):
        powers = Powers()
        for b in batches:
            for start in range(0, len(b), at_once):
                seen, keys, nodes = set(), [], []
                for text in b["text"].iloc[start:start + at_once]:
                    tokens = shingles(text, powers)
                    if len(tokens) >= EDGES[0] and (node := node_of(tokens)) not in seen:
                        seen.add(node)
                        keys.append(part_keys(tokens))
                        nodes.append(np.full(len(keys[-1]), node))
                if not keys:
                    continue
                key, node = np.concatenate(keys), np.concatenate(nodes)
                shard = (key % _U(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                found, first = np.unique(shard[order], return_index=True)
                cuts = [*first, len(order)]
                key, node = key[order], node[order]
                yield pd.DataFrame({"shard": found,
                                    "keys": [key[i:j].tobytes() for i, j in zip(cuts, cuts[1:])],
                                    "nodes": [node[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]})

    return (docs.select(text_of().alias("text")).mapInPandas(dealt, "shard long, keys binary, nodes binary"))


def buckets(keys: DataFrame) -> DataFrame:
    """(bucket, members): the sets that share a key, smallest first; each
    combination of sets once per shard, named by its hash."""
    def shared(part: pd.DataFrame) -> pd.DataFrame:
        key = np.frombuffer(b"".join(part["keys"]), dtype=_U)
        node = np.frombuffer(b"".join(part["nodes"]), dtype=np.int64)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])  # copies from several tasks
        key, node = key[new], node[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        size = np.diff([*first, len(key)])
        name = np.add.reduceat(mixed(node.view(_U)), first) if len(first) else np.zeros(0, _U)
        first, size, name = first[size > 1], size[size > 1], name[size > 1]
        _, once = np.unique(name, return_index=True)
        return pd.DataFrame({"bucket": name[once].view(np.int64),
                             "members": [node[i:i + n] for i, n in zip(first[once], size[once])]})

    return keys.groupBy("shard").applyInPandas(shared, "bucket long, members array<bigint>")


def may_link(a_size: Column, b_size: Column) -> Column:
    return (4 * a_size <= 5 * b_size) & (4 * b_size <= 5 * a_size)


def sketched(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches let through."""
    def side(name: str) -> DataFrame:
        return info.select(F.col("node").alias(name), F.col("n_shingles").alias(f"{name}_size"),
                           F.col("sketch").alias(f"{name}_sketch"))

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([hamming(x, y) <= d for x, y, d in zip(a, b, most)], dtype=bool)

    return (pairs.join(side("a"), "a").join(side("b"), "b").where(may_link(F.col("a_size"), F.col("b_size")))
            .where(near("a_sketch", "b_sketch", F.floor((F.col("a_size") + F.col("b_size")) / 9)))
            .select("a", "b"))


def token_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, tokens) of ``nodes`` (node, doc_id: a document that has this set)."""
    def listed(batches):
        powers = Powers()
        for b in batches:
            sets = [shingles(t, powers) for t in b["text"]]
            yield pd.DataFrame({"node": b["node"], "tokens": [s.tobytes() for s in sets],
                                "own": [len(s) > 0 and node_of(s) == n for s, n in zip(sets, b["node"])]})

    wanted = nodes.withColumnRenamed("doc_id", "_id")
    rows = (docs.select(F.col("doc_id").alias("_d"), text_of().alias("text"))
            .join(wanted, F.col("_d").eqNullSafe(F.col("_id"))))
    # Should an id stand for several texts, only the one that the node names stays.
    return (rows.select("node", "text").mapInPandas(listed, "node long, tokens binary, own boolean")
            .where("own").dropDuplicates(["node"]).select("node", "tokens"))


def verified(docs: DataFrame, pairs: DataFrame, info: DataFrame) -> DataFrame:
    """The pairs whose sets link."""
    left = stored(sketched(pairs, info), "jaccard-near")
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(info.select("node", "doc_id"), "node")
    sets = stored(token_sets(docs, nodes), "jaccard-sets")

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y):
            a, b = np.frombuffer(a, dtype=_U), np.frombuffer(b, dtype=_U)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= 80 * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    x = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return left.join(x, "a").join(y, "b").where(linked("x", "y")).select("a", "b")


def hub_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): each set of a bucket with the bucket's hub."""
    degree = (shared.select(F.explode("members").alias("node")).groupBy("node")
              .agg(F.count(F.lit(1)).alias("degree")))
    hubs = (shared.select("bucket", F.explode("members").alias("node")).join(degree, "node")
            .groupBy("bucket").agg(F.max(F.struct(F.col("degree"), F.col("node"))).alias("hub"))
            .select("bucket", F.col("hub.node").alias("hub")))
    pairs = shared.join(hubs, "bucket").select("hub", F.explode("members").alias("node")).where("hub <> node")
    return pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def across(shared: DataFrame, parts: DataFrame, info: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs in one bucket but in different components that their sketches allow.

    A bucket's sets are dealt into blocks; each two blocks are one cell, worked
    on in one task."""
    rows = shared.select("bucket", F.explode("members").alias("node")).join(parts, "node", "left")
    several = (rows.groupBy("bucket")
               .agg(F.min(F.coalesce("component", "node")).alias("low"), F.max(F.coalesce("component", "node")).alias("high"))
               .where("low <> high").select("bucket"))
    held = shared.join(several, "bucket", "left_semi").dropDuplicates(["bucket"])
    known = (info.join(parts, "node", "left")
             .select("node", "n_shingles", "sketch", F.coalesce("component", "node").alias("component")))
    rows = (held.select("bucket", F.ceil(F.size("members") / block).cast("long").alias("blocks"),
                        F.explode("members").alias("node"))
            .join(known, "node")
            .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
                    "node", "component", "n_shingles", "sketch")
            .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"))

    def compared(batches):
        rest = None
        for b in batches:
            if rest is not None:
                b = pd.concat([rest, b], ignore_index=True)
            # the last cell may go on in the next batch
            last = (b["bucket"] == b["bucket"].iloc[-1]) & (b["i"] == b["i"].iloc[-1]) & (b["j"] == b["j"].iloc[-1])
            rest = b[last]
            yield cell_pairs(b[~last])
        if rest is not None:
            yield cell_pairs(rest)

    return rows.mapInPandas(compared, "a long, b long").distinct()


def cell_pairs(cells: pd.DataFrame) -> pd.DataFrame:
    """Pairs of each cell (bucket, i, j) across components, cut by size, by the
    sketches folded to ``LEAST_BITS``, then by whole sketches.  Rows come sorted."""
    n = len(cells)
    cells = cells.reset_index(drop=True)
    bucket, i, j, own, node, comp, size = (cells[c].to_numpy() for c in (
        "bucket", "i", "j", "own", "node", "component", "n_shingles"))
    sketches = [np.frombuffer(x, dtype=_U) for x in cells["sketch"]]
    small = np.stack([folded(x, LEAST_BITS // 64) for x in sketches]) if n else np.zeros((0, 1), _U)
    new = np.ones(n, dtype=bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    first = np.flatnonzero(new)
    end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n))) if n else np.zeros(0, int)
    found = set()
    x = np.arange(n)
    apart = 1
    while True:
        x = x[x + apart < end[x]]  # rows with a row of their cell ``apart`` places on
        if not len(x):
            break
        y = x + apart
        ok = (comp[x] != comp[y]) & (4 * size[x] <= 5 * size[y]) & (4 * size[y] <= 5 * size[x])
        ok &= (i[x] == j[x]) | (own[x] != own[y])  # pairs inside a block are the cell's with i = j
        u, v = x[ok], y[ok]
        most = (size[u] + size[v]) // 9
        ok = np.bitwise_count(small[u] ^ small[v]).sum(axis=1) <= most
        for a, b, d in zip(u[ok], v[ok], most[ok]):
            w = min(len(sketches[a]), len(sketches[b]))
            if np.bitwise_count(folded(sketches[a], w) ^ folded(sketches[b], w)).sum() <= d:
                found.add((min(node[a], node[b]), max(node[a], node[b])))
        apart += 1
    return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")


def grouped(docs: DataFrame, block: int = BLOCK, kept: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *kept, n_shingles, component, component_id) for each row of ``docs`` (doc_id,
    text, *kept).  ``component`` names the group of linked rows, null without shingles."""
    signed = stored(signatures(docs, *kept), "jaccard-signatures")
    info = stored(signed.where("node IS NOT NULL").groupBy("node")
                  .agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"),
                       F.max("sketch").alias("sketch")), "jaccard-nodes")
    shards = SHARDS_PER_TASK * task_count(docs.sparkSession)
    shared = stored(buckets(sharded_keys(docs, shards)), "jaccard-buckets")
    near = stored(verified(docs, hub_pairs(shared), info), "jaccard-links")
    parts = stored(components(near), "jaccard-components")
    # Two sets of a bucket were compared; of more, those in several components are now.
    rest = stored(across(shared.where(F.size("members") > 2), parts, info, block), "jaccard-across")
    if not rest.isEmpty():
        more = stored(verified(docs, rest, info), "jaccard-links")
        if not more.isEmpty():
            parts = stored(components(near.unionByName(more)), "jaccard-components")
    named = (info.select("node", "doc_id").join(parts, "node", "left")
             .select("node", "doc_id", F.coalesce("component", "node").alias("component")))
    named = stored(named, "jaccard-named")
    lowest = stored(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "jaccard-lowest")
    of_node = stored(named.join(lowest, "component").select("node", "component", "component_id"), "jaccard-ids")
    return signed.select("doc_id", *kept, "n_shingles", "node").join(of_node, "node", "left").select(
        "doc_id", *kept, "n_shingles", "component",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text)."""
    return grouped(docs, block).drop("component")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which each group keeps one: that with the smallest id (a
    null one last), of several such the first by its place in the table's files.  Rows
    are told apart by their place, so an id that stands for several texts, or none,
    takes no other row along.  Rows without shingles stay.  Columns are unchanged."""
    own = docs.columns
    rows = located(docs, F.struct(*[F.col(f"`{c}`") for c in own]).alias("_all"))
    found = stored(grouped(rows.drop("_all"), kept=("file", "row")).where("component IS NOT NULL")
                   .select("component", F.col("doc_id").isNull().alias("nameless"), "doc_id", "file", "row"), "jaccard-rows")
    place = F.struct("nameless", "doc_id", "file", "row")
    stays = found.groupBy("component").agg(F.min(place).alias("stays"))
    dropped = (found.join(stays, "component").where((F.col("file") != F.col("stays.file")) | (F.col("row") != F.col("stays.row")))
               .select("file", "row"))
    return (rows.join(dropped, ["file", "row"], "left_anti")
            .select(*[F.col("_all").getField(c).alias(c) for c in own]))
