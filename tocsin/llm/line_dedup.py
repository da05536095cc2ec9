"""Line dedup by a log-template tree: lines whose template recurs are dropped.

A line is parsed to a leaf of a tree of fixed depth: the number of its tokens,
then its first ``LEADING`` tokens.  Tokens with a digit are variable fields
(``<*>``) everywhere.  Lines of a leaf that agree in at least ``similarity`` of
their tokens share a template, in which the places where they differ become
``<*>``.  A template that stands in ``min_docs`` different texts or more is
dropped from all documents; equal texts and near copies count once, however many
copies, so what only copies of one document share stays in all of them.  A template of
``LONG_WORDS`` tokens or more goes at ``LONG_DOCS`` texts.

1. A scan turns each text into the (leaf, line key) pairs of its lines; the key
   is the hash of the line with variable fields masked.
2. Texts per key are counted after partial sums, so a line that stands in a
   third of all documents is a few rows.  A key that is alone in its leaf is a
   template of its own.
3. Leaves with several keys and enough texts have their lines fetched and
   parsed one after the other, most frequent first.  Leaves of more than
   ``BLOCK`` keys are dealt into cells by content: lines that could share a
   template are linked by a group of places in which they agree, and what is
   linked is parsed in one task.  The result is the same for every ``BLOCK``.
4. Texts per template are counted exactly.  Where they are enough, near copies are
   told apart: a text that is a near copy of one already counted counts no more,
   however many there are.  Some texts of each template settle most of them; only
   for templates that these leave open are all others compared, with the few
   texts counted so far and once for each pair of texts.  Texts are compared by
   sketches of fixed size of their 5-word shingles.
5. Each text gets the keys of its lines that go.

Defined cases: null text counts as empty (no lines); blank lines are no lines
and stay as they are; repeated rows and null ids keep their number of rows;
lines may be of any length; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tocsin.llm.collocations import bitmap
from tocsin.llm.common import stored, task_count, text_of
from tocsin.llm.components import components
from tocsin.llm.exact_dedup import HIT_BITS, in_bitmap

LEADING = 3
SIMILARITY = 0.7
MIN_DOCS = 10
LONG_WORDS = 50
LONG_DOCS = 2
#: Near copies: Jaccard of the 5-word shingles of the texts' lines, and of what is left of
#: them without long recurring lines (unrelated texts share nothing there).
NEAR_TEXT, NEAR_REST = 0.5, 0.1
SKETCH = 64  # smallest shingle hashes kept of a text, and of its rest
BLOCK = 2048
SCANNED = 32  # lines of which a parse compares all templates
VARIABLE = "<*>"
FILTER_BITS = 1 << 20  # bitmap of leaves: what the broadcast is bounded by
KEY_BITS = 1 << 25  # bitmap of long recurring lines
_DIGIT = re.compile(r"\d")
_KEY = ("_hash", "_size")
_LINE = ("leaves", "keys", "long")


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - 2**64 if h >= 2**63 else h


def tokens_of(line: str) -> list[str]:
    """The tokens of a line, variable fields masked; none of a blank line."""
    tokens = line.split()
    if _DIGIT.search(line):
        tokens = [VARIABLE if _DIGIT.search(t) else t for t in tokens]
    return tokens


def leaf_of(tokens: list[str]) -> int:
    return _hash(f"{len(tokens)} {' '.join(tokens[:LEADING])}")


def parsed(line: str) -> tuple[int, int, str] | None:
    """(leaf, key, masked line) of a line, None for a blank one."""
    tokens = tokens_of(line)
    if not tokens:
        return None
    masked = " ".join(tokens)
    return leaf_of(tokens), _hash(masked), masked


def _signed(docs: DataFrame) -> DataFrame:
    body = text_of()
    return docs.select("doc_id", F.xxhash64(body).alias("_hash"), F.char_length(body).alias("_size"), body.alias("text"))


def line_index(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(_hash, _size, leaves, keys, long): the distinct lines of each different text;
    ``long``: whether they have ``long_words`` tokens or more."""
    def indexed(batches):
        for b in batches:
            once = b.drop_duplicates(["_hash", "_size"])
            found = [list({p[1]: (*p[:2], p[2].count(" ") + 1 >= long_words) for p in map(parsed, t.split("\n")) if p}.values())
                     for t in once["text"]]
            yield pd.DataFrame({"_hash": once["_hash"], "_size": once["_size"],
                                **{n: [np.array([p[k] for p in f], dtype=kind) for f in found]
                                   for k, (n, kind) in enumerate(zip(_LINE, (np.int64, np.int64, bool)))}})

    rows = _signed(docs).select("_hash", "_size", "text").mapInPandas(
        indexed, "_hash long, _size int, leaves array<bigint>, keys array<bigint>, long array<boolean>")
    return rows.groupBy("_hash", "_size").agg(*[F.first(n).alias(n) for n in _LINE])


def tolerated(size: int, similarity: float) -> int:
    """In how many places a line of ``size`` tokens may differ from its template;
    -1 if none fits."""
    need = similarity * size
    return next((m for m in range(min(size, int(max(0.0, size - need)) + 1), -1, -1) if size - m >= need), -1)


def dealt(places: list[int], n: int) -> list[list[int]]:
    """``places`` in ``n`` groups: lines that differ in fewer than ``n`` places agree in
    all of some group."""
    return [places[k::n] for k in range(n)]


def parse_leaf(lines: list[tuple[int, list[str]]], similarity: float) -> list[tuple[int, list[str]]]:
    """(key, template) of a leaf's lines (key, tokens), each joined to the most
    similar template so far or the first of a new one."""
    if not lines:
        return []
    number: dict[str, int] = {VARIABLE: 0}
    rows = np.array([[number.setdefault(t, len(number)) for t in tokens] for _, tokens in lines], dtype=np.int32)
    n, width = rows.shape
    held = np.empty_like(rows)  # the templates so far
    count, need = 0, similarity * width
    member: list[int] = []
    # Of many templates, only those that agree with the line in a whole group can be similar enough.
    groups = None
    if n > SCANNED:
        varied = np.flatnonzero((rows != rows[0]).any(axis=0)).tolist()
        groups = [np.array(g, dtype=np.intp) for g in dealt(varied, tolerated(width, similarity) + 1)]
    index = defaultdict(list)
    for row in rows:
        if groups is None:
            near = np.arange(count)
        else:
            names = [(g, row[places].tobytes()) for g, places in enumerate(groups)]
            near = np.array(sorted({k for name in names for k in index.get(name, ())}), dtype=np.intp)
        same = (held[near] == row).sum(axis=1)
        best = int(np.argmax(same)) if len(same) else 0
        if not len(same) or same[best] < need:
            at = count
            held[at] = row
            count += 1
            for name in names if groups is not None else ():
                index[name].append(at)
        else:
            at = int(near[best])
            if same[best] < width:
                differ = held[at] != row
                changed = differ & (held[at] != 0)
                held[at][differ] = 0
                for g, places in enumerate(groups or ()):
                    if changed[places].any():
                        index[(g, held[at][places].tobytes())].append(at)
        member.append(at)
    words = list(number)
    templates = [[words[k] for k in held[at]] for at in range(count)]
    return [(key, templates[k]) for (key, _), k in zip(lines, member)]


def linked(lines: DataFrame, similarity: float) -> DataFrame:
    """(key, salt): lines (leaf, key, masked) of a leaf with different salts share no
    template, in whatever order they are parsed.

    A line that joins a template agrees with each of its lines wherever neither
    has a variable field, but for the tolerated places.  The places without any
    variable field in the leaf are dealt into one group more than that, so both
    lines have the same tokens in one of them.  Lines and groups are linked."""
    def variable(batches):
        for b in batches:
            found = {(leaf, p) for leaf, m in zip(b["leaf"], b["masked"]) if VARIABLE in m
                     for p, t in enumerate(m.split(" ")) if t == VARIABLE}
            yield pd.DataFrame(sorted(found), columns=["leaf", "place"])

    wild = (lines.select("leaf", "masked").mapInPandas(variable, "leaf long, place int")
            .groupBy("leaf").agg(F.collect_set("place").alias("wild")))

    def cells(batches):
        for b in batches:
            out = []
            for leaf, key, masked, places in zip(b["leaf"], b["key"], b["masked"], b["wild"]):
                tokens = masked.split(" ")
                skipped = set() if places is None else set(places)
                fixed = [p for p in range(LEADING, len(tokens)) if p not in skipped]
                for g, group in enumerate(dealt(fixed, tolerated(len(tokens), similarity) + 1)):
                    out.append((key, _hash(" ".join([str(leaf), str(g), *[tokens[p] for p in group]]))))
            yield pd.DataFrame(out, columns=["a", "b"])

    links = lines.join(wild, "leaf", "left").select("leaf", "key", "masked", "wild").mapInPandas(cells, "a long, b long")
    return components(links).select(F.col("node").alias("key"), F.col("component").alias("salt"))


def templates(docs: DataFrame, counted: DataFrame, min_docs: int, similarity: float, block: int,
              long_docs: int = LONG_DOCS) -> DataFrame:
    """(key, template) of the keys in leaves with several.  ``counted``: (leaf,
    key, long, texts)."""
    least = F.when(F.col("long"), F.least(F.lit(long_docs), F.lit(min_docs))).otherwise(F.lit(min_docs))
    leaves = (counted.groupBy("leaf", "long").agg(F.count(F.lit(1)).alias("held"), F.sum("texts").alias("all_texts"))
              .where((F.col("held") > 1) & (F.col("all_texts") >= least)).select("leaf", "held"))
    leaves = stored(leaves, "lines-leaves")
    # A bitmap of the leaves spares the scan lines that the join would drop: at most
    # FILTER_BITS numbers, whatever the number of leaves.
    bits = np.zeros(FILTER_BITS, dtype=bool)
    for r in leaves.select(F.pmod("leaf", F.lit(FILTER_BITS)).alias("bit")).distinct().toLocalIterator():
        bits[r.bit] = True
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def listed(batches):
        wanted = np.unpackbits(packed.value).astype(bool)
        for b in batches:
            seen = {}
            for text in b["text"]:
                for line in text.split("\n"):
                    tokens = tokens_of(line)
                    if tokens and wanted[(leaf := leaf_of(tokens)) % FILTER_BITS]:
                        masked = " ".join(tokens)
                        key = _hash(masked)
                        seen[key] = (leaf, key, masked)
            yield pd.DataFrame(list(seen.values()), columns=["leaf", "key", "masked"])

    lines = (docs.select(text_of().alias("text")).mapInPandas(listed, "leaf long, key long, masked string")
             .join(leaves, "leaf").groupBy("leaf", "held", "key").agg(F.first("masked").alias("masked"))
             .join(counted.select("key", "texts"), "key"))
    if leaves.where(F.col("held") > block).isEmpty():
        lines = lines.withColumn("salt", F.lit(0).cast("long"))
    else:
        lines = stored(lines, "lines-of-leaves")
        salts = stored(linked(lines.where(F.col("held") > block), similarity), "lines-salts")
        lines = (lines.join(salts, "key", "left")
                 .withColumn("salt", F.when(F.col("held") > block, F.coalesce("salt", "key")).otherwise(F.lit(0))))

    # Leaves lie one after the other in sorted partitions; the last of a batch may go on.
    lines = (lines.repartition(task_count(docs.sparkSession), "leaf", "salt")
             .sortWithinPartitions("leaf", "salt", F.desc("texts"), "key").select("leaf", "salt", "key", "masked"))

    def parse(batches):
        name, held = None, []
        for b in batches:
            out = []
            for leaf, salt, key, masked in zip(b["leaf"], b["salt"], b["key"], b["masked"]):
                if (leaf, salt) != name:
                    out += parse_leaf(held, similarity)
                    name, held = (leaf, salt), []
                held.append((key, masked.split(" ")))
            yield parsed_rows(out)
        yield parsed_rows(parse_leaf(held, similarity))

    return lines.mapInPandas(parse, "key long, template long")


def parsed_rows(found: list[tuple[int, list[str]]]) -> pd.DataFrame:
    return pd.DataFrame([(k, _hash(" ".join(t))) for k, t in found], columns=["key", "template"], dtype="int64")


class Words(dict):
    """Token -> its hash, made when first met."""

    def __missing__(self, token: str) -> int:
        h = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


def shingles(lines: list[list[str]], known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-word shingles of each line, a shorter line as one; and the number
    of the line that each is from."""
    sizes = list(map(len, lines))
    words = np.fromiter(map(known.__getitem__, chain.from_iterable(lines)), dtype=np.uint64, count=sum(sizes))
    line = np.repeat(np.arange(len(lines)), sizes)
    n = max(0, len(words) - 4)
    found = np.zeros(n, dtype=np.uint64)
    for k in range(5):
        found = (found ^ words[k:n + k]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    inside = line[:n] == line[len(line) - n:]
    short = [(xxhash.xxh3_64_intdigest(" ".join(tokens).encode("utf-8", "surrogatepass")), k)
             for k, tokens in enumerate(lines) if len(tokens) < 5]
    return (np.concatenate([found[inside], np.array([h for h, _ in short], dtype=np.uint64)]),
            np.concatenate([line[:n][inside], np.array([k for _, k in short], dtype=line.dtype)]))


def smallest(found: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The sketch of some shingles: their smallest hashes, in order, as signed numbers."""
    if len(found) > 4 * size:
        few = np.unique(np.partition(found, 2 * size)[:2 * size])
        if len(few) >= size:  # without too many repeated ones, the rest can't be among them
            return few[:size].astype(np.int64)
    return np.unique(found)[:size].astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity from two sketches: exact where they hold everything."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    ends = [x[-1] for x in (a, b) if len(x) == SKETCH]
    if ends:  # beyond the end of a full sketch nothing is known
        a, b = a[a <= min(ends)], b[b <= min(ends)]
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(1, len(a) + len(b) - shared)


def near_copies(a: tuple, b: tuple) -> bool:
    """Whether two texts, given as the sketches (whole, rest), are copies but for edits."""
    if likeness(a[0], b[0]) < NEAR_TEXT:
        return False
    return not (len(a[1]) and len(b[1])) or likeness(a[1], b[1]) >= NEAR_REST


def sketches(docs: DataFrame, names: DataFrame, long_keys) -> DataFrame:
    """(name, whole, rest) of the texts in ``names`` (name): sketches of all lines and
    of those that aren't long and recurring (a broadcast bitmap of ``long_keys``; a
    collision takes a line out of the rest of all texts alike)."""
    def slot(h: str):
        return F.pmod(F.col(h), F.lit(HIT_BITS))

    # A bitmap of fixed size keeps most other texts from leaving the scan.
    near = _signed(docs).where(in_bitmap(names.select(slot("name._hash").alias("slot")), slot("_hash")))

    def sketched(batches):
        out_of_rest, known = long_keys.value, Words()
        for b in batches:
            out = []
            for h, n, text in zip(b["_hash"], b["_size"], b["text"]):
                lines = [tokens for x in text.split("\n") if (tokens := tokens_of(x))]
                found, line = shingles(lines, known)
                keys = [_hash(" ".join(tokens)) % KEY_BITS for tokens in lines]
                kept = np.array([not out_of_rest[k >> 3] >> (k & 7) & 1 for k in keys], dtype=bool)
                out.append((h, n, smallest(found), smallest(found[kept[line]])))
                if len(known) > 1 << 18:
                    known.clear()
            yield pd.DataFrame(out, columns=["_hash", "_size", "whole", "rest"])

    rows = near.select(*_KEY, "text").mapInPandas(sketched, "_hash long, _size int, whole array<bigint>, rest array<bigint>")
    return (rows.select(F.struct(*_KEY).alias("name"), "whole", "rest").dropDuplicates(["name"])
            .join(names, "name", "left_semi"))


def apart(docs: DataFrame, holders: DataFrame, long_keys) -> DataFrame:
    """(template) of those with ``need`` texts or more that are no near copies.
    ``holders``: (template, need, name), each text of a template once.

    Texts are taken in the order of their names; one that is no near copy of a text
    counted before is counted.  Each round settles the templates whose first texts are
    enough, and drops the other texts that are near copies of the counted ones."""
    spark = docs.sparkSession
    tasks = task_count(spark)
    open_, counted, gone = holders, None, []
    text = "struct<name:struct<_hash:bigint,_size:int>,whole:array<bigint>,rest:array<bigint>>"

    def count(batches):
        for b in batches:
            out = []
            for need, before, found in zip(b["need"], b["before"], b["found"]):
                chosen = [] if before is None else list(before)
                parts = [(np.asarray(t["whole"]), np.asarray(t["rest"])) for t in chosen]
                for t in sorted(found, key=lambda t: (t["name"]["_hash"], t["name"]["_size"])):
                    own = (np.asarray(t["whole"]), np.asarray(t["rest"]))
                    if len(chosen) < need and not any(near_copies(own, p) for p in parts):
                        chosen.append(t)
                        parts.append(own)
                out.append(chosen)
            yield pd.DataFrame({"template": b["template"], "need": b["need"], "counted": out})

    def compare(batches):
        for b in batches:
            near = [near_copies((a, ar), (c, cr)) for a, ar, c, cr in zip(b["whole"], b["rest"], b["t_whole"], b["t_rest"])]
            yield b.loc[near, ["n_hash", "n_size", "t_hash", "t_size"]]

    while True:
        order = W.partitionBy("template").orderBy("name")
        first = stored(open_.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= 24)
                       .where(F.col("_n") <= 2 * F.col("need") + 4).drop("_n"), "lines-first")
        known = sketches(docs, first.select("name").distinct(), long_keys)
        rows = (first.join(known, "name").groupBy("template", "need")
                .agg(F.collect_list(F.struct("name", "whole", "rest")).alias("found")))
        rows = (rows.join(counted.select("template", F.col("counted").alias("before")), "template", "left") if counted is not None
                else rows.withColumn("before", F.lit(None).cast(f"array<{text}>")))
        counted = stored(rows.repartition(tasks, "template").mapInPandas(count, f"template long, need int, counted array<{text}>"),
                         "lines-counted-texts")
        gone.append(counted.where(F.size("counted") >= F.col("need")).select("template"))
        rest = stored(open_.join(counted.where(F.size("counted") < F.col("need")).select("template"), "template", "left_semi")
                      .join(first.select("template", "name"), ["template", "name"], "left_anti"), "lines-others")
        if rest.isEmpty():
            break
        chosen = counted.select("template", F.explode("counted").alias("t"))
        pairs = rest.join(chosen.select("template", F.col("t.name").alias("chosen")), "template").select("name", "chosen").distinct()
        pairs = stored(pairs, "lines-pairs")
        known = sketches(docs, pairs.select("name").distinct(), long_keys)
        theirs = chosen.select("t.*").dropDuplicates(["name"])
        sides = (pairs.join(known, "name").join(theirs.select(F.col("name").alias("chosen"), F.col("whole").alias("t_whole"),
                                                              F.col("rest").alias("t_rest")), "chosen")
                 .select(F.col("name._hash").alias("n_hash"), F.col("name._size").alias("n_size"), F.col("chosen._hash").alias("t_hash"),
                         F.col("chosen._size").alias("t_size"), "whole", "rest", "t_whole", "t_rest"))
        near = sides.mapInPandas(compare, "n_hash long, n_size int, t_hash long, t_size int").select(
            F.struct(F.col("n_hash").alias("_hash"), F.col("n_size").alias("_size")).alias("name"),
            F.struct(F.col("t_hash").alias("_hash"), F.col("t_size").alias("_size")).alias("chosen"))
        covered = (rest.join(chosen.select("template", F.col("t.name").alias("chosen")), "template")
                   .join(stored(near, "lines-near"), ["name", "chosen"], "left_semi").select("template", "name").distinct())
        open_ = stored(rest.join(covered, ["template", "name"], "left_anti"), "lines-open")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, gone).distinct()


def recurring(docs: DataFrame, index: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY,
              block: int = BLOCK, long_docs: int = LONG_DOCS) -> DataFrame:
    """(key) of the lines that go."""
    pairs = index.select("_hash", "_size", F.explode(F.arrays_zip(*_LINE)).alias("line"))
    pairs = pairs.select("_hash", "_size", F.col("line.leaves").alias("leaf"), F.col("line.keys").alias("key"),
                         F.col("line.long").alias("long"))
    counted = stored(pairs.groupBy("leaf", "key", "long").agg(F.count(F.lit(1)).alias("texts")), "lines-counted")
    grouped = stored(templates(docs, counted, min_docs, similarity, block, long_docs), "lines-templates")
    # A key that is alone in its leaf is its template.  Those that stand in enough texts
    # by themselves or through others are looked at again.
    least = F.when(F.col("long"), F.least(F.lit(long_docs), F.lit(min_docs))).otherwise(F.lit(min_docs))
    named = (counted.join(grouped.select("key", "template"), "key", "left")
             .where((F.col("texts") >= least) | F.col("template").isNotNull())
             .select("key", "long", F.coalesce("template", "key").alias("template"), least.alias("need")))
    named = stored(named, "lines-named")
    held = pairs.select(F.struct(*_KEY).alias("name"), "key").join(named, "key")
    held = stored(held.groupBy("template", "name").agg(F.min("need").alias("need")), "lines-held")
    enough = held.groupBy("template").agg(F.count(F.lit(1)).alias("texts"), F.min("need").alias("least")).where("texts >= least")
    enough = stored(enough.select("template", F.col("least").alias("need")), "lines-enough")
    if enough.isEmpty():
        return named.where(F.lit(False)).select("key")
    long_keys = docs.sparkSession.sparkContext.broadcast(bitmap(
        named.where("long").join(enough, "template", "left_semi"), F.pmod("key", F.lit(KEY_BITS)), F.lit(1), 1, KEY_BITS).tobytes())
    gone = apart(docs, held.drop("need").join(enough, "template"), long_keys)
    return named.join(gone, "template").select("key").distinct()


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY,
                         block: int = BLOCK, long_words: int = LONG_WORDS, long_docs: int = LONG_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for each row of ``docs`` (doc_id, text)."""
    index = stored(line_index(docs, long_words), "lines-index")
    gone = stored(recurring(docs, index, min_docs, similarity, block, long_docs), "lines-dropped")
    of_text = stored(index.select(*_KEY, F.explode("keys").alias("key")).join(gone, "key")
                     .groupBy(*_KEY).agg(F.collect_list("key").alias("gone")), "lines-of-texts")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cleaned(batches):
        for b in batches:
            out = []
            for text, gone_here in zip(b["text"], b["gone"]):
                lines = text.split("\n")
                n = sum(1 for x in lines if not (x == "" or x.isspace()))
                if gone_here is None:
                    out.append((n, 0, text))
                    continue
                drop = set(gone_here)
                kept = [x for x in lines if not (tokens := tokens_of(x)) or _hash(" ".join(tokens)) not in drop]
                out.append((n, len(lines) - len(kept), "\n".join(kept)))
            yield pd.DataFrame({"doc_id": b["doc_id"], **{
                name: [row[k] for row in out] for k, name in enumerate(("n_lines", "n_dropped", "text"))}})

    return (_signed(docs).join(of_text, list(_KEY), "left").select("doc_id", "text", "gone")
            .mapInPandas(cleaned, f"doc_id {kind}, n_lines long, n_dropped long, text string"))
