"""SentencePiece encoding that keeps the source positions of every piece, and decoding.

A text is normalised as the model prescribes: at each position the longest prefix found in the
model's compiled character map (a double-array trie) is replaced, or one character is taken as
it is; white space is trimmed, escaped and marked by the model's flags. Every byte of the
normalised text records the source byte it came from, so a piece's place in the normalised text
gives the span of source bytes it stands for. Where a character becomes several byte pieces, the
last of them has the character's span and the others are empty at its start.

The normalised text is segmented by the sentencepiece library with its own normaliser switched
off. If no piece of the vocabulary has a space mark behind another character, no merge crosses
such a place, so the text is cut there, and the pieces of a part are remembered in the task.
A text of any length is cut into blocks at these places, never shortened.

Decoding joins the pieces' bytes, drops control pieces, turns space marks into spaces and takes
off the marked prefix that encoding added; bytes that are not UTF-8 become U+FFFD. Byte pieces
on either side of a control piece are not joined to one character.

Defined results: null and empty texts have no pieces but the begin and end ids that were asked
for; each byte that is not UTF-8 is read as U+FFFD, as the library does; repeated rows each get
their result; null ids are kept; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from ratewright.llm.text import utf8

SPACE_MARK = "▁"
_MARK = SPACE_MARK.encode()
_UNREADABLE = "\N{REPLACEMENT CHARACTER}".encode()
# Characters cut into parts at a time, parts a task remembers, and bytes of text in a batch.
BLOCK_CHARS = 1 << 20
REMEMBERED_PARTS = 400_000
LONGEST_REMEMBERED = 48
BATCH_BYTES = 8 << 20

# Kinds of piece in a model file (fixed values of the format).
_NORMAL, _UNKNOWN, _CONTROL, _USER_DEFINED, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6

_PARTS = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")
_CUT = re.compile(f"[^{SPACE_MARK}](?={SPACE_MARK})")
_CROSSES = re.compile(f"[^{SPACE_MARK}]{SPACE_MARK}")


class CharMap:
    """A compiled character map: the longest source prefix that has a replacement."""

    def __init__(self, compiled: bytes) -> None:
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if compiled else []
        self.texts = compiled[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    @staticmethod
    def _child(unit: int) -> int:
        """Where a unit's children are, as a number to be XORed to its own place."""
        return (unit >> 10) << 8 if unit & 0x200 else unit >> 10

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest prefix at ``at``, and that prefix's length."""
        units, found = self.units, None
        node = self._child(units[0])
        for i in range(at, len(text)):
            byte = text[i]
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._child(unit)
            if unit & 0x100:  # a source ends here; the unit below holds its value
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        start, length = found
        return self.texts[start : self.texts.index(b"\0", start)], length


def _character(text: bytes, at: int) -> tuple[bytes, int]:
    """The character at ``at``, U+FFFD for a byte that starts none, and its length."""
    lead = text[at]
    length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    one = text[at : at + length]
    try:
        one.decode()
    except UnicodeDecodeError:
        return _UNREADABLE, 1
    return one, length


class Normaliser:
    """Normalisation by a model's specification, with the source byte of every result byte."""

    def __init__(self, spec, marks_behind: bool = False) -> None:
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix = spec.add_dummy_prefix
        self.trim = spec.remove_extra_whitespaces
        self.space = _MARK if spec.escape_whitespaces else b" "
        self.marks_behind = marks_behind

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the place in ``text``."""
        if not text:
            return b"", np.zeros(1, np.int64)
        if self.map or self.trim or not _readable(text):
            return self._by_prefix(text)
        # Every character stands for itself: only spaces change their length.
        width = len(self.space)
        raw = np.frombuffer(text, np.uint8)
        places = np.arange(len(text) + 1, dtype=np.int32 if len(text) < 1 << 30 else np.int64)
        if width > 1:
            places = np.repeat(places, np.append(np.where(raw == 0x20, width, 1), 1))
        out = text.replace(b" ", self.space)
        if not self.prefix:
            return out, places
        if self.marks_behind:
            return out + self.space, np.append(places, np.full(width, places[-1]))
        return self.space + out, np.concatenate([np.zeros(width, places.dtype), places])

    def _step(self, text: bytes, at: int) -> tuple[bytes, int]:
        found = self.map.longest(text, at) if self.map else None
        return found or _character(text, at)

    def _by_prefix(self, text: bytes) -> tuple[bytes, np.ndarray]:
        at = 0
        while self.trim and at < len(text):
            shown, length = self._step(text, at)
            if shown != b" ":
                break
            at += length
        if at == len(text):
            return b"", np.full(1, at, np.int64)
        # A prefix is there before trailing space is taken off, a mark behind comes after that.
        out = bytearray(self.space if self.prefix and not self.marks_behind else b"")
        places = [at] * len(out)
        after_space = self.trim
        while at < len(text):
            shown, length = self._step(text, at)
            if after_space:
                shown = shown.lstrip(b" ")
            if shown:
                after_space = self.trim and shown.endswith(b" ")
                shown = shown.replace(b" ", self.space)
                out += shown
                places += [at] * len(shown)
            at += length
        if self.trim:
            while out.endswith(self.space):
                at = places[len(out) - len(self.space)]
                del out[-len(self.space) :], places[-len(self.space) :]
        if self.prefix and self.marks_behind:
            out += self.space
            places += [at] * len(self.space)
        places.append(at)
        return bytes(out), np.array(places, np.int64)


def _readable(text: bytes) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


def _text(joined: bytes) -> str:
    """The text of bytes, U+FFFD for each that is not UTF-8."""
    try:
        return joined.decode()
    except UnicodeDecodeError:
        out, at = bytearray(), 0
        while at < len(joined):
            one, length = _character(joined, at)
            out += one
            at += length
        return out.decode()


class Encoded(NamedTuple):
    """Piece ids, and the source bytes that each piece stands for: [begin, end)."""

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray


class Codec:
    """A sentencepiece model: encoding with spans, and decoding."""

    def __init__(self, model: bytes) -> None:
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.normalise = Normaliser(
            proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix
        )
        # Fields of a message that follow replace those before them: no normaliser.
        plain = sentencepiece_model_pb2.ModelProto()
        spec = plain.normalizer_spec
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self._raw = sentencepiece.SentencePieceProcessor(
            model_proto=model + plain.SerializeToString()
        )
        self.begin_id, self.end_id = self._raw.bos_id(), self._raw.eos_id()
        kinds = [p.type for p in proto.pieces]
        names = [p.piece for p in proto.pieces]
        self._cuts = not any(
            _CROSSES.search(n) for n, k in zip(names, kinds, strict=True) if k not in (_CONTROL, _BYTE)
        )
        # Bytes of the normalised text that a piece covers; 0 where the id does not tell.
        whole = (_NORMAL, _USER_DEFINED)
        self._width = np.array([len(n.encode()) if k in whole else 0 for n, k in zip(names, kinds, strict=True)])
        shown = {_UNKNOWN: proto.trainer_spec.unk_surface.encode(), _CONTROL: b""}
        self._shown = [
            bytes([int(n[1:-1], 16)]) if k == _BYTE else shown.get(k, n.replace(SPACE_MARK, " ").encode())
            for n, k in zip(names, kinds, strict=True)
        ]
        self._value = np.array([int(n[1:-1], 16) if k == _BYTE else 0 for n, k in zip(names, kinds, strict=True)])
        self._controls = np.array([k == _CONTROL for k in kinds])
        self._bytes = np.array([k == _BYTE for k in kinds])
        self._unknown = np.array([k == _UNKNOWN for k in kinds])
        spec = proto.normalizer_spec
        self._strip = spec.add_dummy_prefix or spec.remove_extra_whitespaces
        self._strip_all = spec.remove_extra_whitespaces
        self._memo: dict[str, bytes] = {}

    def _parts(self, normalised: str) -> Iterator[list[str]]:
        if not self._cuts:
            yield [normalised] if normalised else []
            return
        at = 0
        while at < len(normalised):
            cut = _CUT.search(normalised, at + BLOCK_CHARS)
            stop = cut.end() if cut else len(normalised)
            yield _PARTS.findall(normalised, at, stop)
            at = stop

    def _widths(self, ids: np.ndarray, text: str) -> np.ndarray:
        """Bytes of the normalised text that each piece covers."""
        widths = self._width[ids]
        if widths.all():
            return widths
        if self._unknown[ids].any():
            ends = [p.end for p in self._raw.encode(text, return_type="proto").pieces]
            return np.diff(np.array([0, *ends], np.int64))
        # Byte pieces: the last of a character has its length.
        places = np.flatnonzero(self._bytes[ids])
        values = self._value[ids[places]]
        leads = values & 0xC0 != 0x80
        length = 1 + (values >= 0xC0) + (values >= 0xE0) + (values >= 0xF0)
        widths[places[leads] + length[leads] - 1] = length[leads]
        return widths

    def _segment(self, parts: list[str]) -> dict[str, bytes]:
        """Ids and widths, by turns, of parts that are not remembered. Where one part may follow
        another with a cut between them, they are segmented together."""
        apart = [p for p in parts if p[0] != SPACE_MARK or p[-1] == SPACE_MARK]
        if apart and len(parts) > 1:
            both = set(apart)
            found = self._segment([p for p in parts if p not in both]) if len(both) < len(parts) else {}
            for part in apart:
                found |= self._segment([part])
            return found
        joined = "".join(parts)
        ids = self._raw.encode(joined, return_type="numpy").astype(np.int64)
        widths = self._widths(ids, joined)
        sizes = np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts))
        stops = 8 * (np.searchsorted(np.cumsum(widths), np.cumsum(sizes)) + 1)
        both = np.stack([ids, widths], axis=1).astype("<u4").tobytes()
        starts = [0, *stops[:-1].tolist()]
        return {p: both[a:b] for p, a, b in zip(parts, starts, stops.tolist(), strict=True)}

    def encode(self, text: bytes) -> Encoded:
        """The pieces of a whole text, without begin and end."""
        normalised, places = self.normalise(text)
        rows: list[bytes] = []
        memo = self._memo
        for parts in self._parts(normalised.decode()):
            if len(memo) > REMEMBERED_PARTS:
                memo.clear()
            known = list(map(memo.get, parts))
            if None in known:
                new = self._segment(list({p for p, v in zip(parts, known, strict=True) if v is None}))
                memo.update((p, v) for p, v in new.items() if len(p) <= LONGEST_REMEMBERED)
                known = [v or new[p] for p, v in zip(parts, known, strict=True)]
            rows += known
        pieces = np.frombuffer(b"".join(rows), "<u4").reshape(-1, 2)
        ends = np.cumsum(pieces[:, 1], dtype=np.int64)
        at = places[np.concatenate([np.zeros(1, np.int64), ends])]
        return Encoded(pieces[:, 0], at[:-1], at[1:])

    def decode(self, ids: np.ndarray) -> str:
        """The text that the ids stand for."""
        kept = np.flatnonzero(~self._controls[ids])
        ids = ids[kept]
        shown = list(map(self._shown.__getitem__, ids.tolist()))
        if self._strip and shown and not (self._bytes[ids[0]] or self._unknown[ids[0]]):
            shown = self._without_prefix(ids, shown)
        byte = self._bytes[ids]
        cuts = np.flatnonzero(byte[:-1] & byte[1:] & (np.diff(kept) > 1)) + 1
        parts = pairwise([0, *cuts.tolist(), len(shown)])
        return "".join(_text(b"".join(shown[a:b])) for a, b in parts)

    def _without_prefix(self, ids: np.ndarray, shown: list[bytes]) -> list[bytes]:
        if not self._strip_all:
            return [shown[0].removeprefix(b" "), *shown[1:]]
        for i, piece in enumerate(shown):
            if self._bytes[ids[i]] or self._unknown[ids[i]]:
                break
            shown[i] = piece.removeprefix(b" ")
            if shown[i]:
                break
        return shown


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a model file, kept in the process."""
    if path not in _codecs:
        with open(path, "rb") as f:
            _codecs[path] = Codec(f.read())
    return _codecs[path]


def encode(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    begin: bool = True,
    end: bool = True,
    spans: bool = True,
) -> DataFrame:
    """For every row ``id_col``, ``ids`` (unsigned 32-bit little-endian, as token files hold
    them), ``decoded`` (the text that the ids give back) and ``covered`` (bytes of the text that
    some piece stands for); with ``spans`` also ``begins`` and ``ends``, the source bytes of each
    piece but begin and end. ``model_path`` must be readable on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, ids binary, decoded string, covered bigint"
    if spans:
        schema += ", begins array<bigint>, ends array<bigint>"

    def rows(batch: pa.RecordBatch, own: Codec) -> Iterator[pa.RecordBatch]:
        head = np.array([own.begin_id] if begin else [], "<u4")
        tail = np.array([own.end_id] if end else [], "<u4")
        out, start, size = [], 0, 0
        for i, text in enumerate(batch.column(1)):
            found = own.encode(text.as_py())
            ids = np.concatenate([head, found.ids, tail])
            covered = int((found.end - found.begin).sum())
            out.append((ids.tobytes(), own.decode(ids), covered, found.begin, found.end))
            size += len(text.as_py())
            if size > BATCH_BYTES or i == batch.num_rows - 1:
                kinds = [pa.binary(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                columns = list(zip(*out, strict=True))[: 5 if spans else 3]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
                names = ["id", "ids", "decoded", "covered", "begins", "ends"][: len(arrays) + 1]
                yield pa.RecordBatch.from_arrays([batch.column(0)[start : i + 1], *arrays], names=names)
                out, start, size = [], i + 1, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            yield from rows(batch, own)

    found = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t")).mapInArrow(run, schema)
    return found.withColumnRenamed("id", id_col)
