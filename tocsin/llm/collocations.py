"""Phrase collocations by best-first branch-and-bound growth.

A phrase of two or three words scores by its count squared over the product of
its parts' counts, at its lowest-scoring cut.  Words are counted first, then
pairs of words that are frequent enough.  A pair's own counts bound every phrase
that grows from it: a phrase x y z can't score above f(x y) / f(x), nor above
f(y z) / f(z).  So each language's frontier is expanded best first, down to a
trial threshold: the pairs whose bound reaches it are grown, and pairs that
reach it themselves are grown on both sides, as a longer phrase may cover them.
Below the threshold nothing can rank; above it every phrase is known with its
count.  Where 2000 survive at the threshold or above, ties included, the
language is settled; for the others the threshold is lowered, at last to zero,
where everything is expanded.

Counting: each task numbers the words it meets and counts packed numbers with
numpy, handing on partial sums before they outgrow a fixed size.  What is worth
counting comes to the tasks as a bitmap of fixed size over hashes: a collision
lets something be counted in vain, never left out, and what is counted is counted
everywhere.  Counts are summed by Spark; languages, however frequent, never
group rows by themselves but for 64 lists of the best ones each.

Defined cases: null text counts as empty; null lang counts as ``und``; texts are
taken whole, in slices of a few MB; texts without words, and repeated rows, count
as they stand; ties in score and count go by the phrase's bytes; an empty table
gives no rows; columns beyond text and lang are not read.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tocsin.llm.common import stored, text_of

MIN_COUNT = 10
TOP = 2_000
#: A phrase is covered by a longer one with this share of its count, in percent.
COVER = 50
SCALE = 1_000_000
#: The first trial threshold is the score of the pair with this rank (times TOP); each round
#: goes this many times deeper than the one before.
FIRST, DEEPER = 2, 8
SALTS = 64

SLICE = 1 << 21  # bytes of text taken at a time
WORDS = 1 << 20  # words numbered before a task starts anew; with those of a slice, below 2 ** 21
BITS = 21
RAW, HELD = 1 << 22, 1 << 21  # packed numbers before counting, counts before they are handed on
ROWS = 1 << 16  # rows handed on at a time
WORD_SLOTS = 1 << 25
PAIR_SLOTS = 1 << 23
#: What a pair's slot says: its bound as a prefix, as a suffix and its score reach the
#: threshold; it is frequent.
PREFIX, SUFFIX, SETTLE, FREQUENT = 1, 2, 4, 8
#: Multipliers of the hash of a pair.
LEFT, RIGHT = 40_503, 30_011

# Fixed values of the phrase rule: A-Z are lowered, pieces end at . , ; : ! ? and line
# breaks (here all as '.'), blanks and tabs part words.
ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(46 if b in ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def slices(texts: list[bytes], size: int = SLICE):
    """Lists of words and ``.`` of some texts, about ``size`` bytes each; they continue
    one another."""
    body = b".".join(texts).translate(TABLE)
    at = 0
    while at < len(body):
        stop = at + size
        if stop < len(body):
            stop = min((k for k in (body.find(b" ", stop), body.find(b".", stop)) if k > 0), default=len(body))
        yield body[at:stop].replace(b".", b" . ").split()
        at = stop


def by_language(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    found: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        found.setdefault(lang, []).append(text)
    return found


def rows_out(lang: str, columns: list[pa.Array], counts: np.ndarray, names: list[str]):
    for at in range(0, len(counts), ROWS):
        part = [c.slice(at, ROWS) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part[0]), pa.string()), *part,
                                          pa.array(counts[at:at + ROWS], pa.int64())], names=["lang", *names, "a"])


def count_words(batches):
    """(lang, x, a): partial counts of words; under a null word those of all."""
    from collections import Counter

    held: dict[str, Counter] = {}

    def flushed():
        for lang, counts in held.items():
            counts.pop(b".", None)
            numbers = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
            words = [pa.array([*counts, None], pa.binary()).cast(pa.string())]
            yield from rows_out(lang, words, np.append(numbers, numbers.sum()), ["x"])
        held.clear()

    for batch in batches:
        for lang, texts in by_language(batch).items():
            for tokens in slices(texts):
                held.setdefault(lang, Counter()).update(tokens)
                if sum(map(len, held.values())) > WORDS:
                    yield from flushed()
    yield from flushed()


class Numbered(dict):
    """Word -> number in this task; 0 for words that are surely not frequent."""

    def __init__(self, lang: str, bits: bytes):
        self.seed = zlib.crc32(lang.encode() + b".")
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        super().clear()
        self[b"."] = 0
        self.words: list[bytes] = [b""]
        self.hashes: list[int] = [0]

    def __missing__(self, word: bytes) -> int:
        h = zlib.crc32(word, self.seed)
        slot = h & (WORD_SLOTS - 1)
        number = 0
        if self.bits[slot >> 3] >> (slot & 7) & 1:
            number = len(self.words)
            self.words.append(word)
            self.hashes.append(h)
        self[word] = number
        return number


class Grams:
    """Counts of packed pairs or triples of numbered words of one language."""

    def __init__(self, lang: str, size: int, bits: bytes, flags: np.ndarray | None):
        self.lang, self.size, self.flags = lang, size, flags
        self.number = Numbered(lang, bits)
        self.tail = np.zeros(0, dtype=np.int64)
        self.fresh()

    def fresh(self) -> None:
        self.raw: list[np.ndarray] = []
        self.n_raw = 0
        self.keys, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, tokens: list[bytes]) -> None:
        ids = np.fromiter(map(self.number.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        ids = np.concatenate([self.tail, ids])
        self.tail = ids[len(ids) - min(len(ids), self.size - 1):]
        if len(ids) < self.size:
            return
        x, y = ids[:-1], ids[1:]
        both = (x > 0) & (y > 0)
        if self.size == 2:
            found = (x[both] << BITS) | y[both]
        else:
            h = np.array(self.number.hashes, dtype=np.uint64)
            flags = np.zeros(len(x), dtype=np.uint8)
            flags[both] = self.flags[((h[x[both]] * np.uint64(LEFT) + h[y[both]] * np.uint64(RIGHT)) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)]
            first, second = flags[:-1], flags[1:]
            wanted = (first & second & FREQUENT > 0) & (((first & PREFIX > 0) & (second & SUFFIX > 0)) | ((first | second) & SETTLE > 0))
            at = np.flatnonzero(wanted)
            found = (ids[at] << (2 * BITS)) | (ids[at + 1] << BITS) | ids[at + 2]
        self.raw.append(found)
        self.n_raw += len(found)

    def compact(self) -> None:
        if self.n_raw:
            keys, counts = np.unique(np.concatenate(self.raw), return_counts=True)
            keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            self.keys, self.counts = keys[starts], np.add.reduceat(counts, starts)
            self.raw, self.n_raw = [], 0

    def flushed(self):
        """Hands on what is counted and numbers words anew."""
        self.compact()
        words = pa.array(self.number.words, pa.binary()).cast(pa.string())
        mask = (1 << BITS) - 1
        columns = [words.take(pa.array((self.keys >> (BITS * k)) & mask)) for k in reversed(range(self.size))]
        yield from rows_out(self.lang, columns, self.counts, ["x", "y", "z"][:self.size])
        self.fresh()

    def added(self, tokens: list[bytes]):
        self.add(tokens)
        if self.n_raw > RAW:
            self.compact()
        if len(self.keys) > HELD or len(self.number) > WORDS:
            yield from self.flushed()
            tail = [self.number.words[k] for k in self.tail.tolist()]
            self.number.clear()
            self.tail = np.array([self.number[w] if w else 0 for w in tail], dtype=np.int64)


def count_grams(size: int, bits, flags=None):
    """A task's partial counts of runs of ``size`` words, as rows (lang, x, y[, z], a)."""
    def counted(batches):
        held: dict[str, Grams] = {}
        slots = None if flags is None else unpacked(flags.value)
        for batch in batches:
            for lang, texts in by_language(batch).items():
                if slots is not None and not slots[zlib.crc32(lang.encode()) % PAIR_SLOTS] & FREQUENT:
                    continue  # settled
                if lang not in held:
                    if sum(len(g.keys) + g.n_raw for g in held.values()) > RAW:
                        for g in held.values():
                            yield from g.flushed()
                        held.clear()
                    held[lang] = Grams(lang, size, bits.value, slots)
                own = held[lang]
                own.tail = own.tail[:0]
                for tokens in slices(texts):
                    yield from own.added(tokens)
        for g in held.values():
            yield from g.flushed()
    return counted


def unpacked(packed: np.ndarray) -> np.ndarray:
    """A byte for each slot, from four bits each."""
    halves = packed.view(np.uint8)
    return np.stack([halves & 15, halves >> 4], axis=1).ravel()


def bitmap(rows: DataFrame, slot: Column, value: Column, width: int, slots: int) -> np.ndarray:
    """Values of ``width`` bits by slot, joined by "or", in 64-bit numbers: at most
    ``slots * width / 64`` of them come to the driver, whatever the rows."""
    per = 64 // width
    packed = (rows.select((slot / per).cast("long").alias("_at"),
                          F.call_function("shiftleft", value.cast("long"), (slot % per * width).cast("int")).alias("_bits"))
              .groupBy("_at").agg(F.bit_or("_bits").alias("_bits")).toArrow())
    out = np.zeros(slots // per, dtype=np.int64)
    out[packed.column("_at").to_numpy()] = packed.column("_bits").to_numpy()
    return out


def hashed(word: str) -> Column:
    return F.crc32(F.concat("lang", F.lit("."), word))


def pair_slot() -> Column:
    return (hashed("x") * LEFT + hashed("y") * RIGHT) % PAIR_SLOTS


def ratio(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)), exact."""
    def big(c: str) -> str:
        return f"CAST({c} AS DECIMAL(38,0))"
    return F.expr(f"({SCALE} * {big(a)} * {big(a)}) div ({big(left)} * {big(right)})")


def per_language(rows: DataFrame, langs: DataFrame) -> DataFrame:
    """``rows`` with the columns of the small table ``langs``; a frequent language is
    met under several keys."""
    salted = langs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
            .join(salted, ["lang", "_salt"]).drop("_salt"))


def best(rows: DataFrame, order: list[Column], count: int) -> DataFrame:
    """The first ``count`` rows of each language with their ``rank``: best ones of
    several lists first, then of those."""
    parts = F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).orderBy(*order))
    few = rows.withColumn("_in", parts).where(F.col("_in") <= count).drop("_in")
    return few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= count)


def thresholds(pairs: DataFrame, langs: DataFrame, rank: int) -> DataFrame:
    """(lang, least): the score of the pair with that rank, 0 where there are fewer."""
    last = best(pairs.select("lang", "x", "y", "score"), [F.desc("score")], rank).where(F.col("rank") == rank)
    return langs.join(last.select("lang", F.col("score").alias("least")), "lang", "left").fillna(0, ["least"])


def mine(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, cover: int = COVER, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two and
    three words in ``docs`` (text, lang)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of().cast("binary").alias("text"))
    words = texts.mapInArrow(count_words, "lang string, x string, a long").groupBy("lang", "x").agg(F.sum("a").alias("a"))
    words = stored(words.where(F.col("x").isNull() | (F.col("a") >= min_count)), "phrase-words")
    totals = words.where("x IS NULL").select("lang", F.col("a").alias("n"))
    words = words.where("x IS NOT NULL")
    slot = hashed("x") % WORD_SLOTS
    bits = spark.sparkContext.broadcast(bitmap(words, slot, F.lit(1), 1, WORD_SLOTS).tobytes())

    counted = texts.mapInArrow(count_grams(2, bits), "lang string, x string, y string, a long")
    counted = counted.groupBy("lang", "x", "y").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)
    pairs = (counted.join(words.select("lang", "x", F.col("a").alias("fx")), ["lang", "x"])
             .join(words.select("lang", F.col("x").alias("y"), F.col("a").alias("fy")), ["lang", "y"]))
    pairs = stored(pairs.select("lang", "x", "y", "a", "fx", "fy", ratio("a", "fx", "fy").alias("score"),
                                F.expr(f"({SCALE} * CAST(a AS DECIMAL(38,0))) div fx").alias("as_prefix"),
                                F.expr(f"({SCALE} * CAST(a AS DECIMAL(38,0))) div fy").alias("as_suffix")), "phrase-pairs")

    settled: list[DataFrame] = []
    open_langs, rank = totals.select("lang"), first * top
    while True:
        trial = stored(thresholds(pairs, open_langs, rank), "phrase-thresholds")
        found = stored(ranked(spark, texts, bits, per_language(pairs, trial), trial, min_count, top, cover), "phrase-found")
        state = trial.join(found.groupBy("lang").agg(F.max("rank").alias("held")), "lang", "left")
        done = F.col("least").eqNullSafe(0) | (F.coalesce("held", F.lit(0)) >= top)
        settled.append(found.join(state.where(done).select("lang"), "lang", "left_semi"))
        open_langs = stored(state.where(~done).select("lang"), "phrase-open")
        if open_langs.isEmpty():
            break
        rank *= DEEPER
    result = reduce(DataFrame.unionByName, settled).join(totals, "lang")
    return result.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def ranked(spark, texts: DataFrame, bits, pairs: DataFrame, trial: DataFrame, min_count: int, top: int, cover: int) -> DataFrame:
    """The best surviving phrases at or above each language's threshold ``least``."""
    flag = (F.when(F.col("as_prefix") >= F.col("least"), PREFIX).otherwise(0)
            .bitwiseOR(F.when(F.col("as_suffix") >= F.col("least"), SUFFIX).otherwise(0))
            .bitwiseOR(F.when(F.col("score") >= F.col("least"), SETTLE).otherwise(0)).bitwiseOR(F.lit(FREQUENT)))
    slots = pairs.select(pair_slot().alias("slot"), flag.alias("flag")).unionByName(
        trial.select((F.crc32(F.col("lang")) % PAIR_SLOTS).alias("slot"), F.lit(FREQUENT).alias("flag")))
    flags = spark.sparkContext.broadcast(bitmap(slots, F.col("slot"), F.col("flag"), 4, PAIR_SLOTS))
    counted = texts.mapInArrow(count_grams(3, bits, flags), "lang string, x string, y string, z string, a long")
    counted = counted.groupBy("lang", "x", "y", "z").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)
    heads = pairs.select("lang", "x", "y", F.col("a").alias("fxy"), "fx", "least")
    tails = pairs.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("fyz"), F.col("fy").alias("fz"))
    longer = (counted.join(heads, ["lang", "x", "y"]).join(tails, ["lang", "y", "z"])
              .withColumn("s1", ratio("a", "fx", "fyz")).withColumn("s2", ratio("a", "fxy", "fz")))
    longer = stored(longer, "phrase-longer")

    # The longer phrase with the highest count tells whether a pair is covered.
    over = longer.select("lang", "x", "y", "a").unionByName(longer.select("lang", F.col("y").alias("x"), F.col("z").alias("y"), "a"))
    over = over.groupBy("lang", "x", "y").agg(F.max("a").alias("most"))
    kept = (pairs.where("score >= least").join(over, ["lang", "x", "y"], "left")
            .where(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("a"))))
    phrases = kept.select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), "a", F.col("fx").alias("l"), F.col("fy").alias("r"), "score")
    early = F.col("s1") <= F.col("s2")
    phrases = phrases.unionByName(longer.where("least(s1, s2) >= least").select(
        "lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), "a", F.when(early, F.col("fx")).otherwise(F.col("fxy")).alias("l"),
        F.when(early, F.col("fyz")).otherwise(F.col("fz")).alias("r"), F.least("s1", "s2").alias("score")))
    return best(phrases, [F.desc("score"), F.desc("a"), F.asc("phrase")], top)


#: All phrases counted, without bounds.
ORACLE = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
runs AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (SELECT lang, unnest(flatten([list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1)) for k in [1, 2, 3]])) AS g FROM runs),
f AS (SELECT lang, g, count(*)::HUGEINT AS a FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang),
cuts AS (SELECT c.lang, c.g, c.a, k, p.a AS l, q.a AS r, (1000000 * c.a * c.a) // (p.a * q.a) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1 AND a >= 10) c
  JOIN f p ON p.lang = c.lang AND p.g = list_slice(c.g, 1, k) JOIN f q ON q.lang = c.lang AND q.g = list_slice(c.g, k + 1, len(c.g))),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
covered AS (SELECT lang, list_slice(g, i, i + 1) AS g, max(a) AS most FROM (SELECT *, unnest([1, 2]) AS i FROM lowest WHERE len(g) = 3) GROUP BY ALL),
kept AS (SELECT w.*, array_to_string(w.g, ' ') AS phrase FROM lowest w LEFT JOIN covered c ON c.lang = w.lang AND c.g = w.g
  WHERE c.most IS NULL OR 100 * c.most < 50 * w.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""
