"""Token counts: a finite-state splitter, and counts of runs composed over chunks.

The tokenizer (lower case, white space dropped, BPE with word ends) has a
splitter that is a deterministic machine over character classes: its transitions
say where a pre-token ends (contractions, letter runs, single digits, symbol
runs).  The merges are not compiled into transitions: a run without white space is
merged when first met, and its count is looked up from then on.

White space brings the splitter back to its start.  So the state map of a chunk
of text needs no state set: it is (head, count, tail): what stands before the
first blank and is still to be joined to what came before, the tokens emitted
for certain, and what is pending at the end.  Maps compose associatively; the
chunks of a long text are mapped in parallel by many tasks, and their maps are
composed in pairs by the task that has gathered them.

Special tokens are found in the raw text before it is normalised and count one
each, as the library does by default.  No begin or end tokens, no truncation.

Defined cases: null text counts as empty (0 tokens); texts of any length, one
unbroken run included; repeated rows and null ids keep their number of rows; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.chunks import KEY, chunked, keyed
from tocsin.llm.merges import merged

CHUNK = 32_768
CACHE = 1 << 19
CACHED_RUN = 64
#: White space of the tokenizer's pattern.  str.split() takes four more, 1C to 1F.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
MORE_WHITE = re.compile("[\x1c-\x1f]")
#: Capitals newer than Python's tables whose small letter the tokenizer knows.
NEWER_CAPITALS = {0xA7CB: 0x0264, 0xA7DC: 0x019B}
CAPITAL = re.compile("[\uA7CB\uA7DC\u03A3]")

# States of the splitter: what of the current pre-token has been read.
START, LETTERS, SYMBOLS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
# Classes of characters; the letters that contractions are made of stand alone.
CLASSES = ("letter", "s", "t", "m", "d", "r", "v", "l", "e", "number", "quote", "symbol")


def compile_splitter() -> list[dict[str, tuple[int, int | None, bool]]]:
    """state -> class -> (next state, cut, ended): ``cut`` is how many characters
    before this one a pre-token ended (None: nowhere), ``ended`` whether one
    ends with this character."""
    letters = CLASSES[:9]
    after_quote = {"r": QUOTE_R, "v": QUOTE_V, "l": QUOTE_L}
    closes = {QUOTE_R: "e", QUOTE_V: "e", QUOTE_L: "l"}
    table: list[dict[str, tuple[int, int | None, bool]]] = []
    for state in range(7):
        row: dict[str, tuple[int, int | None, bool]] = {}
        for c in CLASSES:
            kind = "letter" if c in letters else c
            fresh = {"letter": LETTERS, "number": START, "quote": QUOTE, "symbol": SYMBOLS}[kind]
            ends = kind == "number"
            if state == QUOTE and c in ("s", "t", "m", "d"):
                row[c] = (START, None, True)  # 's 't 'm 'd
            elif state == QUOTE and c in after_quote:
                row[c] = (after_quote[c], None, False)
            elif closes.get(state) == c:
                row[c] = (START, None, True)  # 're 've 'll
            elif state in closes and kind == "letter":
                row[c] = (LETTERS, 1, False)  # no contraction: the quote stood alone
            elif state in closes:
                row[c] = (fresh, -1, ends)  # the same, and the letter stood alone too
            elif state == LETTERS and kind == "letter":
                row[c] = (LETTERS, None, False)
            elif state in (SYMBOLS, QUOTE) and kind in ("symbol", "quote"):
                row[c] = (SYMBOLS, None, False)
            else:
                row[c] = (fresh, None if state == START else 0, ends)
        table.append(row)
    return table


class Transducer(dict):
    """Run -> tokens that it emits; the compiled tokenizer."""

    def __init__(self, model: dict):
        super().__init__()
        self.ranks = model["ranks"]
        self.special = re.compile("|".join(map(re.escape, model["special"]))) if model["special"] else None
        self.splitter = compile_splitter()
        self.classes: dict[str, str] = {}
        self.letter, self.number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
        self.byte_names = byte_names()
        self.words: dict[str, int] = {}

    def class_of(self, char: str) -> str:
        if char in "stmdrvle":
            return char
        if char == "'":
            return "quote"
        return "letter" if self.letter.match(char) else "number" if self.number.match(char) else "symbol"

    def pieces(self, run: str) -> list[str]:
        """Pre-tokens of a normalised run, by the splitter."""
        out, state, begin, classes = [], START, 0, self.classes
        for i, char in enumerate(run):
            kind = classes.get(char)
            if kind is None:
                kind = classes[char] = self.class_of(char)
            state_then, (state, cut, ended) = state, self.splitter[state][kind]
            if cut == -1:
                out += [run[begin:i - 1], run[i - 1:i]]
                begin = i
            elif cut is not None:
                out.append(run[begin:i - cut])
                begin = i - cut
            if ended:
                out.append(run[begin:i + 1])
                begin = i + 1
        if state in (QUOTE_R, QUOTE_V, QUOTE_L):
            out += [run[begin:-1], run[-1:]]
        elif begin < len(run):
            out.append(run[begin:])
        return out

    def word(self, piece: str) -> int:
        """Tokens of a pre-token."""
        n = self.words.get(piece)
        if n is None:
            names = self.byte_names
            symbols = [names[b] for b in piece.encode("utf-8")]
            symbols[-1] += "</w>"
            ranks = self.ranks
            n = len(merged(symbols, lambda a, b: ranks.get((a, b))))
            if len(piece) <= CACHED_RUN:
                if len(self.words) >= CACHE:
                    self.words.clear()
                self.words[piece] = n
        return n

    def tokens(self, run: str) -> int:
        """Tokens of a raw run without white space."""
        if self.special is None:
            parts, n = [run], 0
        else:
            parts = self.special.split(run)
            n = len(parts) - 1
        for part in parts:
            part = unicodedata.normalize("NFC", part)
            if CAPITAL.search(part):
                # Lower case goes character by character: no final sigma.
                part = part.translate(NEWER_CAPITALS).replace("Σ", "σ")
            n += sum(map(self.word, self.pieces(part.lower())))
        return n

    def __missing__(self, run: str) -> int:
        n = self.tokens(run)
        if len(run) <= CACHED_RUN:
            if len(self) >= CACHE:
                self.clear()
            self[run] = n
        return n

    def runs(self, text: str) -> list[str]:
        if MORE_WHITE.search(text):
            return [r for r in re.split(f"[{WHITE}]+", text) if r]
        return text.split()

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.runs(text)))

    def chunk_map(self, text: str) -> tuple[str, int, str, bool]:
        """(head, count, tail, blank): ``blank`` tells whether the chunk holds white
        space; without it all of the text is head."""
        first = re.search(f"[{WHITE}]", text)
        if not first:
            return text, 0, "", False
        last = len(text) - re.search(f"[{WHITE}]", text[::-1]).start()
        return text[:first.start()], self.count(text[first.start():last]), text[last:], True

    def compose(self, a: tuple, b: tuple) -> tuple:
        if not b[3]:
            return (a[0], a[1], a[2] + b[0], True) if a[3] else (a[0] + b[0], 0, "", False)
        if not a[3]:
            return (a[0] + b[0], b[1], b[2], True)
        between = a[2] + b[0]
        return (a[0], a[1] + (self[between] if between else 0) + b[1], b[2], True)

    def scan(self, maps: list[tuple]) -> tuple:
        """The maps composed in pairs, log n rounds."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def total(self, composed: tuple) -> int:
        head, n, tail, _ = composed
        return n + (self[head] if head else 0) + (self[tail] if tail else 0)


def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: itself if printable in Latin-1, else the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def load_model(path: str) -> dict:
    """Merge ranks and special strings of a tokenizer file of this kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>":
        raise ValueError("the compiler takes BPE with the word end </w>")
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {"ranks": {pair: k for k, pair in enumerate(pairs)},
            "special": [t["content"] for t in spec["added_tokens"] if t["special"]]}


def token_counts(docs: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of ``docs`` (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(load_model(model_path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    schema = f"doc_id {kind}, n_bytes long, n_tokens long"

    def whole(batches):
        machine = Transducer(model.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"],
                                "n_tokens": [machine.count(t) for t in b["text"]]})

    def mapped(batches):
        machine = Transducer(model.value)
        for b in batches:
            maps = [machine.chunk_map(t) for t in b["text"]]
            out = b[[*KEY, "no"]].copy()
            out["n_bytes"] = [len(t.encode("utf-8")) for t in b["text"]]
            for k, name in enumerate(("head", "count", "tail", "blank")):
                out[name] = [m[k] for m in maps]
            yield out

    state: dict = {}

    def composed(part: pd.DataFrame) -> pd.DataFrame:
        if not state:
            state["machine"] = Transducer(model.value)
        machine = state["machine"]
        copies = int((part["no"] == 0).sum())  # repeated rows bring their chunks along
        part = part.drop_duplicates("no").sort_values("no")
        n = machine.total(machine.scan(list(zip(part["head"], part["count"], part["tail"], part["blank"]))))
        return pd.DataFrame({"doc_id": part["doc_id"].iloc[[0] * copies].array,
                             "n_bytes": int(np.sum(part["n_bytes"])), "n_tokens": n})

    short = rows.where(F.col("_size") <= chunk).mapInPandas(whole, schema)
    parts = chunked(rows.where(F.col("_size") > chunk), chunk, 0)
    maps = parts.mapInPandas(mapped, f"doc_id {kind}, _hash long, _size int, no int, n_bytes long, head string, "
                                     "count long, tail string, blank boolean")
    return short.unionByName(maps.groupBy(*KEY).applyInPandas(composed, schema))
