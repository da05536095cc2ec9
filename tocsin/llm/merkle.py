"""Merkle manifest of a document table, with a proof for every row.

A row's leaf is the SHA-256 of its fields; per source the leaves, in order of
doc_id, are hashed in runs of three, level by level, to the source's subroot,
and the subroots likewise to the root of the whole table.

Positions: leaves are dealt to ranges of (source, doc_id) and written with the
number of their range, so counts per range make positions global without a sort
in one task.  Levels are one aggregation each.  Proofs come by pointer jumping:
every node holds the siblings of the path from itself up to, but without, the
ancestor it points at (at first its parent).  Each round joins the nodes with
the ancestors they point at, appends the ancestors' segments and takes over
their pointers, so the distance doubles until every leaf points past the root.
As all leaves of a source share their high ancestors, nodes are joined per block
of leaves: an ancestor is repeated for each block below it, and no join key has
more than a block of rows.  In later rounds only leaves and nodes that are high
enough to be pointed at take part.

Defined cases: null fields count as ``-``; a row with null doc_id is a leaf like
any other, before those with an id; rows of the same source and id are ordered
by their leaf, so repeated rows are leaves of their own and get proofs of their
own (identical rows may exchange them); a null source is a source, before the
empty string; texts of any length are hashed whole; a table of one row has that
leaf as root and the digest of nothing as proof; an empty table gives no rows;
columns beyond the five fields are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tocsin.llm.common import stored, task_count

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 3
#: Leaves that meet an ancestor under one join key.
BLOCK = 3 ** 7
#: Names the tree over the subroots; other trees go by the place of their first leaf.
TOP = -1


def field(value: Column) -> Column:
    """Byte count, colon and value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    parts = [field(F.col(c)) for c in FIELDS[:-1]] + [field(text)]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def joined(values: Column) -> Column:
    """Binary values of an array, end to end, as hex text."""
    return F.array_join(F.transform(values, hex_text), "")


def is_tampered() -> Column:
    """Rows whose newlines the tampering deletes."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): ``tampered`` is null where tampering leaves
    the leaf as it is."""
    text = F.col("text")
    return docs.select("doc_id", "source", leaf_of(text).alias("leaf"),
                       F.when(is_tampered() & text.contains("\n"), leaf_of(F.translate(text, "\n", ""))).alias("tampered"))


def positioned(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``place``, their number among all by (source, ``order``) from 0, and
    ``first`` and ``size``: the place of their source's first row and its row count."""
    dealt = rows.repartitionByRange(task_count(rows.sparkSession), *[F.asc(c) for c in ("source", *order)])
    # Written with the number of the range, which so outlives a repeated task.
    dealt = stored(dealt.withColumn("_range", F.spark_partition_id()), name)
    counts = dealt.groupBy("_range", "source").agg(F.count(F.lit(1)).alias("_n"))
    ranges = counts.groupBy("_range").agg(F.sum("_n").alias("_n"))
    ranges = ranges.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.sum("_n").over(W.partitionBy("_range").orderBy("source")) - F.col("_n")
    runs = (counts.withColumn("_inside", inside).join(ranges, "_range")
            .withColumn("_start", F.col("_before") + F.col("_inside"))
            .withColumn("first", F.min("_start").over(W.partitionBy("source")))
            .withColumn("size", F.sum("_n").over(W.partitionBy("source")))
            .select(F.col("_range").alias("_r"), F.col("source").alias("_s"), "_start", "first", "size"))
    number = F.row_number().over(W.partitionBy("_range", "source").orderBy(*order)) - 1
    same = (F.col("_range") == F.col("_r")) & F.col("source").eqNullSafe(F.col("_s"))
    return (dealt.withColumn("_number", number).join(stored(runs, name + "-runs"), same)
            .select(*rows.columns, (F.col("_start") + F.col("_number")).alias("place"), "first", "size"))


def height_of(size: Column) -> Column:
    """Levels above the leaves of a tree of ``size`` leaves."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(39)), lambda h: F.pow(F.lit(float(RUN)), h) < size))


def grown(base: DataFrame, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """The levels and runs of all trees over ``base`` (tree, height, idx, lo, hi, digest,
    doc_id, tampered).  A level has the nodes of one height, a run the up to three
    nodes of a level that are hashed together."""
    levels, runs = [base], []
    top = base.agg(F.max("height")).first()[0] or 0
    for h in range(top):
        kid = F.struct("idx", "lo", "hi", "digest", *(("doc_id", "tampered", "own_tree", "own_height") if h == 0 else ()))
        run = (levels[-1].where(F.col("height") > h)
               .groupBy("tree", "height", F.expr(f"idx div {RUN}").alias("up")).agg(F.sort_array(F.collect_list(kid)).alias("kids")))
        runs.append(stored(run, f"{name}-runs{h}"))
        digests = F.transform("kids", lambda k: k["digest"])
        levels.append(runs[-1].select("tree", "height", F.col("up").alias("idx"), F.col("kids")[0]["lo"].alias("lo"),
                                      F.element_at("kids", -1)["hi"].alias("hi"),
                                      F.unhex(F.sha2(joined(digests), 256)).alias("digest")))
    return levels, runs


def siblings(kids: Column, at: Column) -> Column:
    """The digests before and after place ``at`` of a run."""
    def together(part: Column) -> Column:
        return F.aggregate(part, F.lit(bytearray()), lambda found, k: F.concat(found, k["digest"]))
    return F.struct(together(F.slice(kids, F.lit(1), at)).alias("before"),
                    together(F.slice(kids, at + 2, F.lit(RUN))).alias("after"))


def nodes(runs: DataFrame, h: int, own: bool = False) -> DataFrame:
    """The nodes of height ``h`` in ``runs``, each with the siblings in its run and a
    pointer to its parent; with ``own`` under the names they have in another tree."""
    each = runs.select("tree", "up", "kids", F.posexplode("kids").alias("at", "kid"))
    name = ((F.col("kid.own_tree"), F.col("kid.own_height"), F.lit(0).cast("long")) if own
            else (F.col("tree"), F.lit(h), F.col("kid.idx")))
    found = (("tree", name[0]), ("h", name[1]), ("idx", name[2]), ("lo", F.col("kid.lo")), ("hi", F.col("kid.hi")),
             ("subroot", F.col("kid.digest") if own else F.lit(None).cast("binary")),
             ("path", F.array(siblings(F.col("kids"), F.col("at")))),
             ("to_tree", F.col("tree")), ("to_h", F.lit(h + 1)), ("to_idx", F.col("up")))
    extra = ("kid.digest", "kid.doc_id", "kid.tampered") if h == 0 else ()
    return each.select(*[value.alias(key) for key, value in found], *extra)


POINTER = ("to_tree", "to_h", "to_idx")


def jumped(rows: DataFrame, ancestors: DataFrame) -> DataFrame:
    """``rows`` after appending the paths of the ancestors that they point at."""
    right = ancestors.select(F.explode(F.sequence(F.expr(f"lo div {BLOCK}"), F.expr(f"hi div {BLOCK}"))).alias("_block"),
                             F.col("tree").alias("_tree"), F.col("h").alias("_h"), F.col("idx").alias("_idx"),
                             F.col("subroot").alias("_subroot"), F.col("path").alias("_path"),
                             *[F.col(c).alias("_" + c) for c in POINTER])
    left = rows.withColumn("_at", F.expr(f"lo div {BLOCK}"))
    met = ((F.col("_at") == F.col("_block")) & (F.col("to_tree") == F.col("_tree")) & (F.col("to_h") == F.col("_h"))
           & (F.col("to_idx") == F.col("_idx")))
    kept = [F.col(c) for c in rows.columns if c not in ("subroot", "path", *POINTER)]
    return left.join(right, met, "left").select(
        *kept, F.coalesce("subroot", "_subroot").alias("subroot"),
        F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("path", "_path")).alias("path"),
        *[F.col("_" + c).alias(c) for c in POINTER])


def proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, tampered, subroot, root, path) of each row: binary digests, and
    the siblings ``before`` and ``after`` it on every level up to the root."""
    placed = positioned(stored(leaves(docs), "merkle-leaves"), ["doc_id", "leaf"], "merkle-ranges")
    base = stored(placed.select(F.col("first").alias("tree"), height_of(F.col("size")).alias("height"),
                                (F.col("place") - F.col("first")).alias("idx"), F.col("place").alias("lo"),
                                F.col("place").alias("hi"), F.col("leaf").alias("digest"), "doc_id", "tampered",
                                F.col("first").alias("own_tree"), F.lit(0).alias("own_height")), "merkle-base")
    levels, runs = grown(base, "merkle-source")
    subroots = levels[0].where("height = 0").select("tree", "height", "lo", "hi", "digest", "doc_id", "tampered")
    for h, level in enumerate(levels[1:], 1):
        subroots = subroots.unionByName(level.where(F.col("height") == h).drop("idx"), allowMissingColumns=True)
    ordered = positioned(stored(subroots.withColumn("source", F.lit("")), "merkle-subroots"), ["lo"], "merkle-order")
    top = stored(ordered.select(F.lit(TOP).cast("long").alias("tree"), height_of(F.col("size")).alias("height"),
                                F.col("place").alias("idx"), "lo", "hi", "digest", "doc_id", "tampered",
                                F.col("tree").alias("own_tree"), F.col("height").alias("own_height")), "merkle-top")
    top_levels, top_runs = grown(top, "merkle-top")
    root = top_levels[-1].select("digest").first()

    # Leaves, and the nodes that something may point at.
    nowhere = [F.lit(None).cast(t).alias(c) for c, t in zip(POINTER, ("long", "int", "long"))]
    columns = ["digest", "doc_id", "tampered", "lo", "subroot", "path", *POINTER]
    start = top.where("height = 0 and own_height = 0").select(
        "digest", "doc_id", "tampered", "lo", F.col("digest").alias("subroot"),
        F.array().cast("array<struct<before:binary,after:binary>>").alias("path"), *nowhere)
    inner = [nodes(r, h).drop("digest", "doc_id", "tampered") for h, r in enumerate(runs) if h]
    if runs:
        start = start.unionByName(nodes(runs[0], 0).select(columns))
    if top_runs:
        first = nodes(top_runs[0], 0, own=True)
        start = start.unionByName(first.where("h = 0").select(columns))
        inner += [first.where("h > 0").drop("digest", "doc_id", "tampered")]
        inner += [nodes(r, h) for h, r in enumerate(top_runs) if h]
    depth, distance = len(runs) + len(top_runs), 1
    if inner:
        above = stored(reduce(DataFrame.unionByName, inner), "merkle-nodes")
        while distance < depth:
            start = jumped(start, above)
            distance *= 2
            if distance < depth:  # only what is high enough can still be pointed at by a leaf
                high = above.where((F.col("tree") == TOP) | (F.col("h") >= distance))
                above = stored(jumped(high, above), f"merkle-nodes{distance}")
    whole = F.lit(bytearray(root["digest"]) if root else None).cast("binary")
    return start.select("doc_id", F.col("digest").alias("leaf"), "tampered", F.coalesce("subroot", whole).alias("subroot"),
                        whole.alias("root"), "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root (hex text) that a leaf (hex text) and its siblings give."""
    return F.aggregate(path, leaf, lambda node, run: F.sha2(F.concat(hex_text(run["before"]), node, hex_text(run["after"])), 256))


def verified(proved: DataFrame) -> DataFrame:
    """The digests of ``proofs`` as hex text, and whether a row's untampered siblings
    lead from its leaf, tampered with or not, to the root."""
    path = F.array_join(F.transform("path", lambda run: hex_text(F.concat(run["before"], run["after"]))), "")
    return proved.select("doc_id", hex_text(F.col("leaf")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"),
                         hex_text(F.col("root")).alias("root"), F.sha2(path, 256).alias("proof_sha256"),
                         folded(hex_text(F.coalesce("tampered", "leaf")), F.col("path")).alias("folded_root")
                         ).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 13) -> str:
    """DuckDB text, for trees of up to 3 ** levels leaves: siblings by a window over each
    level, paths by one join per level."""
    def body(text: str) -> str:
        def part(c: str) -> str:
            return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
        return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    # CRC-32 bit by bit: -1 stands for a shift, other numbers for a byte to mix in.
    steps = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) "
           "WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)")
    ctes = [f"""leaf AS (SELECT doc_id, source, {body("text")} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc} % 2 = 0 THEN {body("replace(text, chr(10), '')")} ELSE {body("text")} END AS given FROM documents)""",
            """placed AS (SELECT *, row_number() OVER () AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaf)"""]

    def grow(name: str, base: str) -> None:
        ctes.append(f"{name}0 AS ({base})")
        for h in range(levels + 1):
            ctes.append(f"""{name}_links{h} AS (SELECT *, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS nodes FROM {name}{h}) WINDOW run AS (PARTITION BY tree, idx // 3 ORDER BY idx))""")
            ctes.append(f"""{name}{h + 1} AS (SELECT tree, idx // 3 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest
  FROM {name}_links{h} WHERE nodes > 1 GROUP BY tree, idx // 3)""")
        ctes.append(f"{name}_root AS (" + " UNION ALL ".join(
            f"SELECT tree, digest FROM {name}_links{h} WHERE nodes = 1" for h in range(levels + 1)) + ")")

    def climb(name: str, start: str) -> None:
        ctes.append(f"{name}_path0 AS ({start})")
        for h in range(levels + 1):
            ctes.append(f"""{name}_path{h + 1} AS (SELECT n, p.tree, p.idx // 3 AS idx, proof || coalesce(before || after, '') AS proof,
  CASE WHEN before IS NULL THEN fold ELSE sha256(before || fold || after) END AS fold
  FROM {name}_path{h} p LEFT JOIN {name}_links{h} l ON l.tree = p.tree AND l.idx = p.idx AND l.nodes > 1)""")

    grow("own", "SELECT tree, idx, leaf AS digest FROM placed")
    climb("own", "SELECT n, tree, idx, '' AS proof, given AS fold FROM placed")
    grow("top", "SELECT 0 AS tree, tree AS idx, digest FROM own_root")
    climb("top", f"SELECT n, 0 AS tree, tree AS idx, proof, fold FROM own_path{levels + 1}")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.digest AS verified
FROM placed d JOIN top_path{levels + 1} p ON p.n = d.n JOIN own_root s ON s.tree = d.tree CROSS JOIN top_root r"""
