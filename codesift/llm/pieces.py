"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

A model is compiled once into three transducers. The normaliser adds the
prefix and writes blanks as U+2581. The piece transducer is a tree that reads characters
and writes a piece at the end of one. Byte fallback reads a character without
a piece and writes its UTF-8 bytes. Composed with an input they give a lattice whose
edges are pieces, and its shortest path in the tropical semiring (weights add along a path,
the least sum wins) is the encoding:

- unigram models: the weight of a piece is minus its score; byte fallback costs what the
  library charges for an unknown character;
- pair-merging models: an encoding is right if and only if each two neighbouring pieces
  are what merging their joint text gives. An acceptor of such pairs is composed with
  the lattice: allowed neighbours weigh 0, others infinity, and one path of finite weight
  is left.

Where no piece has certain characters next to each other, no path crosses the place
between them: common models have no piece with a word mark behind other characters, or
with a letter before another character. Which of these hold is found when a model is compiled;
the paths of the words between such places are found one by one and kept for the next time.

Defined cases: null and empty texts have no pieces; repeated rows are encoded alike; a
U+2581 in a text reads back as a blank, as the library has it. Models with a character map,
or with user-defined or unused pieces, are refused when compiled. Only the columns
named are read.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Field numbers and piece kinds of the model format.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, MERGES = 1, 2
UNKNOWN_COST = 10.0
KEPT_WORDS = 300_000
KEPT_LENGTH = 48
# Rows coded at a time; what is held for them is a few times their texts.
ROWS = 256


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a serialized message: number and plain value or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at:at + size]
        at += size


class KnownWords(dict):
    """Encodings of words, found when first asked for. Long words are not kept, and when
    there are many, those not asked for since the last time there were many are dropped."""

    def __init__(self, encode: Callable[[str], tuple[int, ...]], most: int = KEPT_WORDS) -> None:
        super().__init__()
        self.encode, self.most = encode, most
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.older.get(word)
        if found is None:
            found = self.encode(word)
        if len(word) <= KEPT_LENGTH:
            if 2 * len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class PieceTransducer:
    """A compiled model."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        trainer, normaliser = {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        if normaliser.get(2):
            raise ValueError("a model with a character map of its own is not supported")
        self.prefix = bool(normaliser.get(3, 1))
        self.one_blank = bool(normaliser.get(4, 1))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, MERGES):
            raise ValueError("only unigram and pair-merging models are supported")
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        # What a piece reads back as; None for a byte.
        written = {NORMAL: lambda p: p.replace(MARK, " "), UNKNOWN: lambda p: " ⁇ ", CONTROL: lambda p: "", BYTE: lambda p: None}
        self.plain = [written[k](p) for p, k in zip(self.pieces, self.kinds, strict=True)]
        self._compile()

    def _compile(self) -> None:
        self.tree: dict = {}
        for piece in self.ids:
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece
        alphabet = {c for piece in self.ids for c in piece}
        # A character that is only part of pieces can stand alone too; it is then written as bytes.
        for c in alphabet:
            self.tree.setdefault(c, {}).setdefault("", c)
        letters = {c for c in alphabet if c.isalpha()}
        others = alphabet - letters - {MARK}
        beside = {(x, y) for piece in self.ids for x, y in zip(piece, piece[1:], strict=False)}
        kept_apart = lambda ones, twos: not any(x in ones and y in twos for x, y in beside)
        # U+FFFF is no character; it keeps a class from being empty.
        one, two = (re.escape("".join(sorted(c or {"\uffff"}))) for c in (letters, others))
        # A word is marks and a run of letters or of others; characters without a piece stand alone.
        if not kept_apart(letters | others, {MARK}):
            known = f"[{MARK}{one}{two}]+"
        elif not kept_apart(letters, others):
            known = f"{MARK}+[{one}{two}]*|[{one}{two}]+"
        elif not kept_apart(others, letters):
            known = f"{MARK}*(?:[{one}]+|[{two}]+[{one}]*)|{MARK}+"
        else:
            known = f"{MARK}*(?:[{one}]+|[{two}]+)|{MARK}+"
        self.words = re.compile(f"{known}|.", re.DOTALL)
        # Pieces by their text, so that what is kept holds one string for each.
        self.known = {p: p for p in [*alphabet, *self.ids]}
        # The longest piece with each beginning of three characters.
        self.longest: dict[str, int] = {}
        for piece in self.ids:
            if len(piece) > 2:
                self.longest[piece[:3]] = max(len(piece), self.longest.get(piece[:3], 0))
        self.least = min(self.scores, default=0.0) - UNKNOWN_COST
        self.kept = KnownWords(self._word)
        self.pairs: dict[tuple[str, str], bool] = {}

    def normalise(self, text: str) -> str:
        if self.one_blank:
            text = re.sub(" +", " ", text.strip(" "))
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", MARK)

    def _merged(self, text: str) -> list[str]:
        """What merging gives: the pair with the best score first, the leftmost of equals."""
        parts = list(text)
        while True:
            found = [(-self.scores[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                return parts
            k = min(found)[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    def _allowed(self, one: str, other: str) -> bool:
        """The acceptor of neighbours; what it says is kept in ``pairs``."""
        if len(self.pairs) >= KEPT_WORDS:
            self.pairs.clear()
        found = self.pairs[one, other] = self._merged(one + other) == [one, other]
        return found

    def _edges(self, word: str, start: int) -> list[str]:
        """The pieces of the lattice that begin at a place, short ones first."""
        node, found = self.tree, []
        for c in word[start:]:
            node = node.get(c)
            if node is None:
                break
            if "" in node:
                found.append(node[""])
        return found

    def _allowed_path(self, word: str) -> list[str]:
        """The one path of finite weight. With weights of 0 and infinity the first complete
        path is the shortest, so edges are tried depth first, long ones before short ones;
        a piece at a place from which no path was complete is not tried again."""
        known, pairs, longest, size = self.known, self.pairs, self.longest, len(word)
        path: list[str] = []
        # The length to try next at each place of the path.
        lengths, at, before = [longest.get(word[:3], 2)], 0, None
        dead: set[tuple[int, str]] = set()
        while at < size:
            for length in range(min(lengths[-1], size - at), 0, -1):
                piece = known.get(word[at:at + length])
                if piece is None:
                    continue
                if before is not None:
                    allowed = pairs.get((before, piece))
                    if not (self._allowed(before, piece) if allowed is None else allowed):
                        continue
                if not dead or (at + length, piece) not in dead:
                    break
            else:
                lengths.pop()
                dead.add((at, before))
                at -= len(path.pop())
                before = path[-1] if path else None
                continue
            lengths[-1] = length - 1
            path.append(piece)
            at += length
            before = piece
            lengths.append(longest.get(word[at:at + 3], 2))
        return path

    def _cheapest_path(self, word: str) -> list[str]:
        """Least sum of weights, place by place; of equal sums the one found first."""
        size = len(word)
        best: list[str] = [""] * (size + 1)
        cost = [0.0] + [float("inf")] * size
        for start in range(size):
            for piece in self._edges(word, start):
                i, end = self.ids.get(piece), start + len(piece)
                total = cost[start] - (self.least if i is None else self.scores[i])
                if total < cost[end]:
                    best[end], cost[end] = piece, total
        path, at = [], size
        while at:
            path.append(best[at])
            at -= len(best[at])
        return path[::-1]

    def _bytes_of(self, text: str) -> list[int]:
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in text.encode("utf-8", "surrogatepass")]

    def _word(self, word: str) -> tuple[int, ...]:
        if word[0] not in self.known:
            return tuple(self._bytes_of(word))
        ids: list[int] = []
        for piece in self._allowed_path(word) if self.kind == MERGES else self._cheapest_path(word):
            i = self.ids.get(piece)
            ids.extend(self._bytes_of(piece) if i is None else (i,))
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.kept.__getitem__, self.words.findall(self.normalise(text)))))

    def decode(self, ids: list[int]) -> str:
        parts: list[str] = []
        held = bytearray()
        plain = self.plain
        for i in ids:
            piece = plain[i]
            if piece is not None:
                if held:
                    parts.append(held.decode("utf-8", "replace"))
                    held.clear()
                parts.append(piece)
            else:
                held.append(int(self.pieces[i][3:5], 16))
        parts.append(held.decode("utf-8", "replace"))
        text = "".join(parts)
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def compiled(model: bytes) -> PieceTransducer:
    """One transducer for each Python worker, so that known words stay known."""
    return PieceTransducer(model)


def _coding(model: bytes, names: list[str], text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the pieces, and what they read back as, a few rows at a time."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                flat, ends, decoded = array("i"), [0], []
                for value in rows.column(rows.schema.get_field_index(text)).to_pylist():
                    ids = transducer.encode(value or "")
                    flat.extend(ids)
                    ends.append(len(flat))
                    decoded.append(transducer.decode(ids))
                pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
                columns = [rows.column(rows.schema.get_field_index(name)) for name in names]
                yield pa.RecordBatch.from_arrays([*columns, pieces, pa.array(decoded, pa.string())], [*names, "ids", "decoded"])

    return code


def decode_column(model: bytes) -> Callable[[Column | str], Column]:
    """The text of a column of pieces."""
    @F.pandas_udf(StringType())
    def decode(ids: pd.Series) -> pd.Series:
        transducer = compiled(model)
        return pd.Series([transducer.decode(i.tolist()) for i in ids], dtype=object)

    return decode


def model_bytes(path: str = MODEL) -> bytes:
    """The model is read on the driver and sent with the tasks: about half a megabyte."""
    with open(path, "rb") as file:
        return file.read()


def encoded(docs: DataFrame, path: str = MODEL, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``; columns of these names are replaced."""
    kept = docs.drop("ids", "decoded")
    schema = StructType([*kept.schema.fields]).add("ids", ArrayType(IntegerType())).add("decoded", StringType())
    return kept.mapInArrow(_coding(model_bytes(path), kept.columns, text), schema)


def encoding_report(docs: DataFrame, path: str = MODEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip`` for every row of ``docs``."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return encoded(named, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"),
    )
