"""SentencePiece encoding and decoding with offsets.

A text is normalised by the model's compiled character map: at each place the longest prefix that the map
knows is replaced, and every byte of the result remembers the byte of the text that it came from. Pairs of symbols are then merged by
score, by the sentencepiece library with its own normaliser switched off, and each piece is projected through that alignment
to a span of bytes of the original text.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Rows whose tokens a task holds at once.
ROWS = 256
#: Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
OFFSETS = "ids array<int>, begins array<int>, ends array<int>"


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes and the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.replacements = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of data[at:]."""
        units, found = self.units, None
        if not units:
            return None
        node, i = offset(units[0]), at
        while i < len(data) and data[i]:
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            has_leaf, node, i = units[node] >> 8 & 1, node ^ offset(units[node]), i + 1
            if has_leaf:
                start = units[node] & 0x7FFFFFFF
                found = (i - at, self.replacements[start:self.replacements.index(b"\0", start)])
        return found


def offset(unit: int) -> int:
    return unit >> 10 << ((unit & 0x200) >> 6)


@dataclass(frozen=True)
class PieceModel:
    """Vocabulary and rules of one model; as large as the model file, whatever the corpus."""

    pieces: tuple[tuple[str, int], ...]
    merges: bytes  # the model with a normaliser that changes nothing
    charmap: bytes
    dummy_prefix: bool
    trim: bool
    escape: bool
    begin: int
    end: int

    @staticmethod
    def load(path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        t, n = m.trainer_spec, m.normalizer_spec
        if t.model_type != pb.TrainerSpec.BPE or t.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with white space as prefix is needed")
        if not t.byte_fallback or any(p.type in (USER, UNUSED) for p in m.pieces):
            raise ValueError("a model with byte fallback and without user-defined or unused pieces is needed")
        rules = n.precompiled_charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces
        n.precompiled_charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = b"", False, False, False
        return PieceModel(tuple((p.piece, p.type) for p in m.pieces), m.SerializeToString(), *rules, t.bos_id, t.eos_id)


class Encoder:
    def __init__(self, model: PieceModel):
        from sentencepiece import SentencePieceProcessor

        self.model, self.map = model, CharMap(model.charmap)
        self.merge = SentencePieceProcessor(model_proto=model.merges).encode
        self.raw = {i: int(p[3:5], 16) for i, (p, kind) in enumerate(model.pieces) if kind == BYTE}
        self.surface = [b"" if kind == CONTROL else bytes([self.raw[i]]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN
                        else p.replace(SPACE, " ").encode() for i, (p, kind) in enumerate(model.pieces)]
        self.control = {i for i, (_, kind) in enumerate(model.pieces) if kind == CONTROL}
        self.length = np.array([1 if kind == BYTE else len(p.encode()) for p, kind in model.pieces], np.int64)

    @cached_property
    def plain(self) -> bool:
        """The map changes nothing but white space."""
        return not self.map.units and not self.model.trim and self.model.escape

    def prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Bytes of the longest prefix of data[at:] that the map knows, or else of one character, and what stands for them."""
        if found := self.map.longest(data, at):
            return found
        one = re.match(rb"(?s).[\x80-\xbf]*", data[at:at + 4])[0]
        return len(one), one

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the byte of the text where its source begins."""
        if self.plain and SPACE not in text:
            out = (SPACE if self.model.dummy_prefix and text else "") + text.replace(" ", SPACE)
            lead = [0] * (3 * (len(out) - len(text)))
            data = text.encode()
            width = np.where(np.frombuffer(data, np.uint8) == 32, 3, 1)
            return out, np.concatenate([np.array(lead, np.int64), np.repeat(np.arange(len(data)), width), [len(data)]])
        data, at, sources, blank = text.encode(), 0, [], self.model.trim
        out = bytearray()
        mark = SPACE.encode() if self.model.escape else b" "
        while blank and at < len(data) and (found := self.prefix(data, at))[1] == b" ":
            at += found[0]
        if at == len(data):
            return "", np.zeros(1, np.int64)
        if self.model.dummy_prefix:  # before the first place that is no blank, even if the map deletes it
            out += mark
            sources += [at] * len(out)
        while at < len(data):
            n, new = self.prefix(data, at)
            if blank and self.model.trim:
                new = new.lstrip(b" ")
            if new:
                blank = new.endswith(b" ")
                new = new.replace(b" ", mark)
                out += new
                same = new.replace(SPACE.encode(), b" ") == data[at:at + n] or new == data[at:at + n]
                sources += [at + min(k, n - 1) if same and len(new) == n else at for k in range(len(new))]
            at += n
        end = len(data)
        while self.model.trim and out.endswith(mark):
            end = sources[len(out) - len(mark)]
            del out[-len(mark):], sources[len(out):]
        return out.decode(), np.array([*sources, end], np.int64)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, first and end byte of each in the text; begin and end ids stand at the ends, with empty spans."""
        normal, source = self.normalise(text or "")
        ids = np.array(self.merge(normal, num_threads=1), "<u4")
        stops = self.length[ids].cumsum()
        starts = stops - self.length[ids]
        return (np.concatenate([[self.model.begin], ids, [self.model.end]]).astype("<u4"),
                np.concatenate([[0], source[starts], source[-1:]]), np.concatenate([[0], source[stops], source[-1:]]))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; a run of byte pieces is read as UTF-8, bytes that are none become U+FFFD each."""
        surface = self.surface
        data = b"".join([surface[i] for i in ids])
        try:  # bytes on two sides of a control piece are not one character
            out = data.decode() if self.control.isdisjoint(ids[1:-1]) else self.decode_runs(ids)
        except UnicodeDecodeError:
            out = self.decode_runs(ids)
        first = next((i for i in ids if i not in self.control), None)
        strip = first is not None and self.model.dummy_prefix and self.model.pieces[first][0].startswith(SPACE)
        return out[1:] if strip else out

    def decode_runs(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and i in self.raw:
                run.append(self.raw[i])
                continue
            while run:
                n = next((n for n in (1, 2, 3, 4) if valid(run[:n])), 0)
                out.append(run[:n].decode() if n else "�")
                del run[:n or 1]
            if i is not None:
                out.append(self.surface[i].decode())
        return "".join(out)


def valid(data: bytes) -> bool:
    try:
        return len(bytes(data).decode()) == 1
    except UnicodeDecodeError:
        return False


def encode(docs: DataFrame, model: PieceModel, digests: bool = False) -> DataFrame:
    """doc_id with ids, begins and ends of every whole text, begin and end ids included; or, with ``digests``, with n_tokens, ids_sha256,
    decoded_sha256 and spans_sha256 of the same, so that no token leaves its task.

    Null texts count as empty and have the two outer ids alone. Rows stay as they are, repeated ones and null ids too; other columns are
    left out. The model goes to the tasks as a broadcast of the size of its file."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def digest(encoder: Encoder, text: str | None) -> tuple:
        ids, begins, ends = encoder.encode(text)
        spans = np.stack([begins, ends], 1).astype("<u4")
        sha = [hashlib.sha256(x).hexdigest() for x in (ids.tobytes(), encoder.decode(ids.tolist()).encode(), spans.tobytes())]
        return len(ids), *sha

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for b in (batch.iloc[at:at + ROWS] for batch in batches for at in range(0, len(batch), ROWS)):
            rows = [(digest if digests else Encoder.encode)(encoder, t) for t in b["text"]]
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string" if digests else OFFSETS
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, f"doc_id long, {schema}")


def decode(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [encoder.decode(list(x)) if x is not None else "" for x in b["ids"]]})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInPandas(run, "doc_id long, text string")
