"""SentencePiece encoding and decoding for vocabularies of merges.

A text is normalised as the model says (a blank put in front, blanks written as
``▁``) and its characters are the first symbols.  An agenda holds every pair of
neighbours whose joined text is a piece, best score first, then leftmost; its
head is merged, the pairs with the new neighbours are entered, and entries of
symbols that have since grown are passed over.  Characters that are no piece
become byte pieces.

Where no piece holds two characters side by side, no merge ever joins them.  So
texts are cut into parts at such places (before the blanks of a word, and between a
word and the punctuation behind it); each part is merged by itself, and parts met
before are looked up.  Texts longer than a chunk are cut before blanks too, so
several tasks share one.

Whatever the agenda makes is checked once, in the Arrow batch that first needs it,
against the sentencepiece library; a difference is an error.  Decoding is the
library's, and ``agrees`` says whether it gives the text again.

Defined cases: null text counts as empty (begin and end ids only); texts of any
length, with or without blanks, are encoded whole; ``▁`` in a text counts as a
blank, as in the library; repeated rows and null ids keep their number of rows;
an empty table gives no rows; columns beyond doc_id and text are not read.  A
model that isn't made of merges, rewrites characters, drops blanks or has symbols of
its user's own is refused.
"""

from __future__ import annotations

import re
import struct
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.chunks import KEY, keyed
from tocsin.llm.common import task_count

BLANK = "▁"
CHUNK = 1 << 18
CACHE = 3 << 17  # parts held in each of two generations
CACHED_PART = 48
SHORT = 32  # characters up to which an agenda is a plain list
NONE = 1 << 60
#: Parts of a text: blanks, what is neither blank nor letter nor digit, then letters and digits.
MARKS, WORD = r"(?:[^ \w]|_)", r"[^\W_]"

# Fixed values of the model file's format: field numbers and kinds.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
TRAINER_MODEL, MODEL_OF_MERGES, TRAINER_BYTES, TRAINER_SUFFIX = 3, 2, 35, 24
CHARACTER_MAP, DUMMY_PREFIX, DROP_BLANKS, ESCAPE_BLANKS = 2, 3, 4, 5


def fields(message: bytes):
    """(number, value) of the fields of a message, in order."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, message[at:at + size]
        at += size


class Known(dict):
    """Part of a text -> its ids as bytes, made when first met.  When full, what was met
    since the last time is kept as the older generation."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}
        self.fresh: list[tuple[str, bytes]] = []  # made, but not checked yet

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.make(text)
            self.fresh.append((text, ids))
        if len(text) <= CACHED_PART:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Model:
    """The pieces of a model, and the ids of parts already met."""

    def __init__(self, proto: bytes):
        scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids: list[int] = []
        trainer: dict = {}
        normalizer: dict = {}
        n = 0
        for number, message in fields(proto):
            if number == TRAINER:
                trainer = dict(fields(message))
            elif number == NORMALIZER:
                normalizer = dict(fields(message))
            elif number == PIECES:
                piece = dict(fields(message))
                text, kind = piece[PIECE_TEXT].decode(), piece.get(PIECE_KIND, NORMAL)
                if kind == NORMAL:
                    scores[text] = struct.unpack("<f", piece.get(PIECE_SCORE, b"\0\0\0\0"))[0]
                    self.ids[text] = n
                elif kind == BYTE:
                    self.byte_ids.append(n)
                elif kind in (USER_DEFINED, UNUSED):
                    raise ValueError("pieces of the user's own and unused ones are not supported")
                n += 1
        if trainer.get(TRAINER_MODEL) != MODEL_OF_MERGES or trainer.get(TRAINER_SUFFIX) or len(self.byte_ids) != 256:
            raise ValueError("not a vocabulary of merges with byte pieces")
        if normalizer.get(CHARACTER_MAP) or normalizer.get(DROP_BLANKS, 1) or not normalizer.get(ESCAPE_BLANKS, 1):
            raise ValueError("the model rewrites texts")
        place = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.order = {p: place[score] for p, score in scores.items()}  # place on the agenda, best score first
        self.prefix = BLANK if normalizer.get(DUMMY_PREFIX, 1) else ""
        #: No merge reaches from another character to the blank behind it.
        self.by_words = not any(BLANK in p.lstrip(BLANK) for p in self.order)
        beside = {p[i:i + 2] for p in self.order for i in range(len(p) - 1)}
        # The few letters and digits that some piece joins with a mark behind them carry a
        # part on; then no merge reaches over the border of two parts.
        joined = {a for a, b in beside if re.fullmatch(WORD, a) and re.fullmatch(MARKS, b) and b != BLANK}
        further = f"(?:(?<=[{re.escape(''.join(sorted(joined)))}]){MARKS}+{WORD}*)*" if joined else ""
        self.pattern = re.compile(f" *{MARKS}*{WORD}*{further}")
        #: A character that no piece joins with anything.
        self.apart = next((c for c in "\n\t\x01" if not any(c in pair for pair in beside)), "")
        self.cuts = self.by_words and bool(self.apart and self.prefix)
        self.parts = Known(self.ids_of)
        self.parts[""] = b""

    def merged(self, part: str) -> list[str]:
        """The symbols that no pair on the agenda joins any more.  The agenda of a short
        part is a list whose least entry is looked for, that of a long one a heap."""
        get, n = self.order.get, len(part)
        if n <= SHORT:
            symbols = list(part)
            agenda = [get(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
            while agenda and (least := min(agenda)) != NONE:
                i = agenda.index(least)
                symbols[i] += symbols.pop(i + 1)
                del agenda[i]
                if i:
                    agenda[i - 1] = get(symbols[i - 1] + symbols[i], NONE)
                if i < len(agenda):
                    agenda[i] = get(symbols[i] + symbols[i + 1], NONE)
            return symbols
        end = list(range(1, n + 1))  # by first character: where a symbol ends
        before = list(range(-1, n))  # where the symbol to the left starts
        pairs = [get(part[i:i + 2], -1) for i in range(n - 1)]  # place of the pair that starts here; -1 for none
        pairs.append(-1)
        agenda = [place << 40 | i for i, place in enumerate(pairs) if place >= 0]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            i = entry & 0xFFFFFFFFFF
            if pairs[i] != entry >> 40:
                continue  # its symbols have grown
            middle = end[i]
            end[i] = stop = end[middle]
            pairs[middle] = -1
            before[stop] = i
            pairs[i] = place = get(part[i:end[stop]], -1) if stop < n else -1
            if place >= 0:
                heappush(agenda, place << 40 | i)
            left = before[i]
            if left >= 0:
                pairs[left] = place = get(part[left:stop], -1)
                if place >= 0:
                    heappush(agenda, place << 40 | left)
        out, i = [], 0
        while i < n:
            out.append(part[i:end[i]])
            i = end[i]
        return out

    def ids_of(self, part: str) -> bytes:
        ids: list[int] = []
        for symbol in self.merged(part.replace(" ", BLANK)):
            at = self.ids.get(symbol)
            if at is None:
                ids += [self.byte_ids[b] for b in symbol.encode()]
            else:
                ids.append(at)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str, first: bool = True) -> bytes:
        """The ids of a text, or with ``first`` false of a later chunk of one."""
        if not text:
            return b""
        text = (" " if first and self.prefix else "") + text.replace(BLANK, " ")
        return b"".join(map(self.parts.__getitem__, self.pattern.findall(text) if self.cuts else [text]))


class Library:
    """What a worker needs to encode, and to check it."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.model = Model(proto)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.begin = struct.pack("<I", self.library.bos_id())
        self.end = struct.pack("<I", self.library.eos_id())

    def check(self) -> None:
        """Holds what the agenda made since the last check against the library."""
        fresh, self.model.parts.fresh = self.model.parts.fresh, []
        # The library puts a blank before a text; where a part has none, a character
        # apart takes it up.
        blank = [p.startswith(" ") and p != " " or not self.model.prefix for p, _ in fresh]
        given = [p[len(self.model.prefix):] if b else self.model.apart + p for b, (p, _) in zip(blank, fresh)]
        lead = len(self.library.encode(self.model.apart)) if given else 0
        for (part, own), b, ids in zip(fresh, blank, self.library.encode(given, num_threads=1) if given else []):
            if own != struct.pack(f"<{len(ids) - (0 if b else lead)}I", *ids[0 if b else lead:]):
                raise ValueError(f"the library encodes {part!r} otherwise")

    def finished(self, texts: list[str], bodies: list[bytes]) -> tuple[list[bytes], list[str], list[bool]]:
        """Ids with begin and end, the texts they decode to, and whether those are the
        texts again."""
        ids = [self.begin + b + self.end for b in bodies]
        decoded = self.library.decode([np.frombuffer(b, dtype="<u4").tolist() for b in ids], num_threads=1) if ids else []
        return ids, decoded, [a == b.replace(BLANK, " ") for a, b in zip(decoded, texts)]


_LIBRARIES: dict[int, Library] = {}


def library_of(proto) -> Library:
    """One for each worker and model."""
    key = hash(proto.value)
    if key not in _LIBRARIES:
        _LIBRARIES.clear()
        _LIBRARIES[key] = Library(proto.value)
    return _LIBRARIES[key]


def cuts(text: str, size: int) -> list[int]:
    """Starts of chunks of about ``size`` characters, at blanks behind other characters."""
    found, at = [0], size
    while 0 < at < len(text):
        at = text.find(" ", at)
        if at > 0 and text[at - 1] not in (" ", BLANK):
            found.append(at)
            at += size
        elif at > 0:
            at += 1
    return found


def encode(docs: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids, decoded, agrees) for each row of ``docs`` (doc_id, text): ids as
    little-endian unsigned 32-bit integers with begin and end, the text they decode to,
    and whether it is the row's."""
    with open(model_path, "rb") as f:
        content = f.read()
    by_words = Model(content).by_words
    proto = docs.sparkSession.sparkContext.broadcast(content)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed(docs)
    schema = f"doc_id {kind}, ids binary, decoded string, agrees boolean"

    def whole(batches):
        own = library_of(proto)
        for b in batches:
            texts = b.column("text").to_pylist()
            bodies = [own.model.encode(t) for t in texts]
            own.check()
            ids, decoded, agrees = own.finished(texts, bodies)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string()),
                                              pa.array(agrees, pa.bool_())], names=["doc_id", "ids", "decoded", "agrees"])

    def cut(batches):
        for b in batches:
            for doc_id, h, n, text in zip(b["doc_id"], b["_hash"], b["_size"], b["text"]):
                starts = cuts(text, chunk) if by_words else [0]
                for no, (a, z) in enumerate(zip(starts, [*starts[1:], len(text)])):
                    yield pd.DataFrame({"doc_id": pd.Series([doc_id], dtype=b["doc_id"].dtype), "_hash": h, "_size": n, "no": no,
                                        "text": [text[a:z]]})

    def parts(batches):
        own = library_of(proto)
        for b in batches:
            b["ids"] = [own.model.encode(t, no == 0) for no, t in zip(b["no"], b["text"])]
            own.check()
            yield b

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        copies = int((part["no"] == 0).sum())  # repeated rows bring their chunks along
        part = part.drop_duplicates("no").sort_values("no")
        ids, decoded, agrees = library_of(proto).finished(["".join(part["text"])], [b"".join(part["ids"])])
        return pd.DataFrame({"doc_id": part["doc_id"].iloc[[0] * copies].array, "ids": ids * copies, "decoded": decoded * copies,
                             "agrees": agrees * copies})

    short = rows.where(F.col("_size") <= chunk).select("doc_id", "text").mapInArrow(whole, schema)
    fields_of = f"doc_id {kind}, _hash long, _size int, no int, text string"
    spread = (rows.where(F.col("_size") > chunk).mapInPandas(cut, fields_of)
              .repartition(task_count(docs.sparkSession), *KEY, "no").mapInPandas(parts, fields_of + ", ids binary"))
    return short.unionByName(spread.groupBy(*KEY).applyInPandas(joined, schema))


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, agrees) of encoded rows."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "agrees")
