"""Cutting a text where every byte-level pre-tokeniser of this family must cut, and encoding the distinct cuts.

The pattern's alternatives take a blank only at their start, or in runs of blanks, never mix letters or digits
with punctuation, and take a single line feed alone. So a text may be cut before any single blank or line feed
that follows a non-blank, and between a letter or digit and the punctuation after it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Opens a piece that has no blank before it; texts that hold the character itself are cut the long way.
_MARK = "\x01"
#: Two blanks of any kind in a row, or the mark.
_LONG = r"[\t-\r \x{1c}-\x{1f}\x{85}\p{Z}]{2}|\x{1}"
#: A letter or digit that every Unicode version knows as such, and ASCII punctuation after it.
_BORDER = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}\x{410}-\x{44F}\x{4E00}-\x{9FA5}])([!-/:-@\[-`{-~])"
#: Blanks as the pattern knows them: Python's own class also holds the controls 1C to 1F.
_BLANK, _OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
_RUN = re.compile(rf"{_BLANK}*{_OTHER}+|{_BLANK}+\Z")


def spaced_chunks(text: str) -> list[str]:
    """The long way: a run of blanks with the word after it. Chunks' separate encodings join to that of the text."""
    return _RUN.findall(text)


def marked_pieces(column: pa.Array) -> pa.ListArray:
    """The pieces of texts without two blanks in a row; a piece stands for itself after a blank, or, marked, without one."""
    opened = pc.binary_join_element_wise(pa.scalar(_MARK), column, "")
    lines = pc.replace_substring(opened, "\n", f" {_MARK}\n")
    return pc.split_pattern(pc.replace_substring_regex(lines, _BORDER, rf"\1 {_MARK}\2"), " ")


def _chunk(piece: str) -> str:
    return piece[1:] if piece.startswith(_MARK) else " " + piece


class TextEncoder:
    """Ids of texts through a memo of pieces, in Arrow; only pieces not in the memo meet Python.

    `encode_many` encodes chunks, each to little-endian unsigned 32-bit integers. The memo holds at most
    `limit` bytes of pieces and ids, whatever the input; when full, its least used half goes.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = 32 << 20) -> None:
        self.encode_many, self.limit = encode_many, limit
        self.pieces, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())
        self.uses = np.zeros(0, np.int64)

    def encode(self, texts: list[str | None] | pa.Array) -> pa.BinaryArray:
        """The ids of each text; a null text is empty."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        long = pc.match_substring_regex(column, _LONG).to_numpy(zero_copy_only=False)
        if not long.any():
            return self._encode_lists(marked_pieces(column))
        plain, other = np.flatnonzero(~long), np.flatnonzero(long)
        cut = [[_MARK + c for c in spaced_chunks(t)] for t in column.take(pa.array(other)).to_pylist()]
        parts = [self._encode_lists(marked_pieces(column.take(pa.array(plain)))), self._encode_lists(pa.array(cut, pa.list_(pa.string())))]
        back = np.argsort(np.concatenate((plain, other)), kind="stable")
        return pa.concat_arrays(parts).take(pa.array(back))

    def _encode_lists(self, lists: pa.ListArray) -> pa.BinaryArray:
        if not len(lists):
            return pa.array([], pa.binary())
        flat = lists.flatten()
        at = pc.index_in(flat, value_set=self.pieces).to_numpy(zero_copy_only=False)
        unknown = np.flatnonzero(np.isnan(at)) if at.dtype.kind == "f" else np.zeros(0, np.int64)
        if len(unknown):
            fresh = flat.take(pa.array(unknown)).dictionary_encode()
            at[unknown] = fresh.indices.to_numpy() + len(self.pieces)
            self._learn(fresh.dictionary)
        at = at.astype(np.int64)
        found = self.ids.take(pa.array(at))
        self.uses += np.bincount(at, minlength=len(self.uses))
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        _, ends, data = found.buffers()
        ends = np.frombuffer(ends, np.int32)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int32)
        out = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends[bounds].astype(np.int32)), data])
        self._shrink()
        return out

    def _learn(self, fresh: pa.Array) -> None:
        new = self.encode_many([_chunk(p) for p in fresh.to_pylist()])
        self.pieces = pa.concat_arrays([self.pieces, fresh])
        self.ids = pa.concat_arrays([self.ids, pa.array(new, pa.binary())])
        self.uses = np.concatenate((self.uses, np.zeros(len(new), np.int64)))

    def _shrink(self) -> None:
        if not len(self.pieces):
            return
        held = pc.binary_length(self.pieces).to_numpy().astype(np.int64) + pc.binary_length(self.ids).to_numpy()
        if held.sum() <= self.limit:
            return
        order = np.argsort(-self.uses, kind="stable")
        keep = pa.array(np.sort(order[np.cumsum(held[order]) <= self.limit // 2]))
        self.pieces, self.ids = self.pieces.take(keep), self.ids.take(keep)
        self.uses = self.uses[keep.to_numpy()] // 2
