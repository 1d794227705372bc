"""SentencePiece BPE encoding by vectorised merge rounds, and decoding by table lookup.

Many words are merged at once. Their symbols lie in one flat numpy array; a round looks up the rank of every
adjacent pair, takes the least rank of each segment, merges its occurrences from the left, and compacts the
array; a segment without a mergeable pair leaves it. The library merges one pair at a time, always the best
and, on ties, the leftmost, and a merge may bring about a better or equal pair: the occurrences after such a
merge wait for the next round, so the result is the library's.

Words are cut where no vocabulary entry crosses, which splits their merges exactly. A segment of more than
`LONG` symbols would need a pass for each of its ranks; its merges are taken from a heap instead, in
O(n log n). Texts are cut before a blank after a non-blank, words are memoised in bounded memory.

Defined results: null and empty texts have no ids; repeated rows are encoded alike; an empty table gives an
empty result; other columns pass through, and columns with the names of the results are replaced. A model
that is not BPE with byte fallback and identity normalisation is refused with ValueError.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewater.llm.common import sliced, tidy
from tidewater.llm.pieces import TextEncoder

#: The character that stands for a blank in pieces.
BLANK = "▁"
#: Segments of more symbols are merged by a heap.
LONG = 512
#: Rank of a pair that does not merge.
_NEVER = np.int64(1 << 40)

_MARK = "\x01"
#: A blank at the start or after another blank, the blank's stand-in, and the mark: texts to be cut the long way.
_ODD = rf"^ |  |{BLANK}|{_MARK}"
_UNIT = re.compile(rf"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: An ASCII letter or digit and the punctuation after it.
_BORDER = r"([0-9A-Za-z])([!-/:-@\[-`{-~])"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message: varints as integers, the rest as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def read_model(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces, scores and types (1 normal, 2 unknown, 3 control, 6 byte) of a model file."""
    with open(path, "rb") as f:
        parts = list(_fields(f.read()))
    pieces, scores, kinds = [], [], []
    for number, value in parts:
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0), 3: 1} | dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0])
            kinds.append(piece[3])
    trainer = {k: v for n, value in parts if n == 2 for k, v in _fields(value)}
    rules = {4: 1} | {k: v for n, value in parts if n == 3 for k, v in _fields(value)}
    plain = not rules.get(2) and rules.get(3, 1) == 1 and rules[4] == 0 and rules.get(5, 1) == 1 and not trainer.get(24)
    if trainer.get(3) != 2 or not trainer.get(35) or not plain or not set(kinds) <= {1, 2, 3, 6}:
        raise ValueError(f"{path} is no BPE model with byte fallback, identity normalisation and plain pieces")
    return pieces, np.array(scores), np.array(kinds)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where `wanted` stand in sorted `keys`, and whether they do."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Merger:
    """Ids of words by merge rounds over flat arrays."""

    def __init__(self, pieces: list[str], scores: np.ndarray, kinds: np.ndarray) -> None:
        own = {p: i for i, p in enumerate(pieces) if kinds[i] == 1}
        self.byte_ids = np.zeros(256, np.int64)
        for i in np.flatnonzero(kinds == 6):
            self.byte_ids[int(pieces[i][3:5], 16)] = i
        #: symbols below `size` are piece ids, those above stand for single characters outside the vocabulary
        self.size = len(pieces)
        chars = sorted({c for p in own for c in p})
        symbol = own | {c: self.size + ord(c) for c in chars if c not in own}
        self.chars = np.array([ord(c) for c in chars], np.int64)
        self.char_symbols = np.array([symbol[c] for c in chars], np.int64)
        self.span = self.size + 0x110000
        _, rank = np.unique(-scores, return_inverse=True)
        pairs = {}
        for p, i in own.items():
            for k in range(1, len(p)):
                if p[:k] in symbol and p[k:] in symbol:
                    pairs[symbol[p[:k]] * self.span + symbol[p[k:]]] = (int(rank[i]), i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs) or [-1], np.int64)
        found = [pairs.get(k, (int(_NEVER), 0)) for k in self.keys.tolist()]
        self.ranks, self.merged = (np.array(x, np.int64) for x in zip(*found, strict=True))
        #: character pairs inside any piece; words may be cut between all others
        self.inner = np.array(sorted({ord(a) << 21 | ord(b) for p in own for a, b in zip(p, p[1:], strict=False)}) or [-1], np.int64)

    def crosses(self, before: str, after: str) -> bool:
        """Whether any piece holds a character of `before` and then one of `after`."""
        wanted = np.array([ord(a) << 21 | ord(b) for a in before for b in after], np.int64)
        return bool(_at(self.inner, wanted)[1].any())

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, known = _at(self.keys, left * self.span + right)
        return np.where(known, self.ranks[at], _NEVER), self.merged[at]

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        at, known = _at(self.chars, points)
        symbols = np.where(known, self.char_symbols[at], self.size + points)
        first = np.ones(len(points), bool)
        if len(points) > 1:
            first[1:] = ~_at(self.inner, points[:-1] << 21 | points[1:])[1]
        first[starts[sizes > 0]] = True
        segment = np.cumsum(first) - 1
        done = np.full(len(points), -1, np.int64)  # final symbols, where their first character stood
        length = np.bincount(segment)[segment] if len(segment) else segment
        for begin in np.flatnonzero(first & (length > LONG)):
            end = begin + length[begin]
            self._by_heap(symbols[begin:end], done[begin:end])
        short = np.flatnonzero(length <= LONG)
        self._rounds(symbols[short], segment[short], short, done)
        return self._ids(done, starts, sizes)

    def _rounds(self, symbols: np.ndarray, segment: np.ndarray, place: np.ndarray, done: np.ndarray) -> None:
        while len(symbols):
            rank, merged = np.full(len(symbols), _NEVER), np.zeros(len(symbols), np.int64)
            rank[:-1], merged[:-1] = self._look(symbols[:-1], symbols[1:])
            edge = np.flatnonzero(np.diff(segment, append=-1))  # the last symbol of each segment
            rank[edge] = _NEVER
            begin = np.concatenate(([0], edge[:-1] + 1))
            least = np.repeat(np.minimum.reduceat(rank, begin), np.diff(begin, append=len(symbols)))
            final = least == _NEVER
            done[place[final]] = symbols[final]
            hit = (rank == least) & ~final
            chosen = self._leftmost(hit)
            if not len(chosen):
                return
            chosen = chosen[self._undisturbed(symbols, segment, rank, merged, chosen)]
            keep = ~final
            keep[chosen + 1] = False
            symbols[chosen] = merged[chosen]
            symbols, segment, place = symbols[keep], segment[keep], place[keep]

    @staticmethod
    def _leftmost(hit: np.ndarray) -> np.ndarray:
        """Places of pairs to merge: of neighbours that share a symbol, every other one from the left."""
        at = np.flatnonzero(hit)
        if not len(at):
            return at
        opens = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        run = np.repeat(opens, np.diff(opens, append=len(at)))
        return at[(np.arange(len(at)) - run) % 2 == 0]

    def _undisturbed(self, symbols: np.ndarray, segment: np.ndarray, rank: np.ndarray, merged: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Which of the chosen merges come before any pair of an equal or better rank that they bring about."""
        new, own = merged[chosen], segment[chosen]
        left = symbols[chosen - 1]
        follows = np.flatnonzero(np.diff(chosen) == 2) + 1
        left[follows] = np.where(own[follows] == own[follows - 1], new[follows - 1], left[follows])
        past = np.minimum(chosen + 2, len(symbols) - 1)
        before = np.where((chosen > 0) & (segment[chosen - 1] == own), self._look(left, new)[0], _NEVER)
        after = np.where((chosen + 2 < len(symbols)) & (segment[past] == own), self._look(new, symbols[past])[0], _NEVER)
        disturbs = np.minimum(before, after) <= rank[chosen]
        earlier = np.cumsum(disturbs) - disturbs
        opens = np.flatnonzero(np.diff(own, prepend=-1))
        return earlier == np.repeat(earlier[opens], np.diff(opens, append=len(own)))

    def _by_heap(self, symbols: np.ndarray, done: np.ndarray) -> None:
        """One long segment, pair by pair: best rank first, leftmost on ties."""
        own, span, pairs = symbols.tolist(), self.span, self.pairs
        n = len(own)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*pairs[k], i, k) for i in range(n - 1) if (k := own[i] * span + own[i + 1]) in pairs]
        heap = [(rank, i, k, new) for rank, new, i, k in heap]
        heapq.heapify(heap)
        while heap:
            _, i, key, new = heapq.heappop(heap)
            j = after[i]
            if own[i] < 0 or j >= n or own[i] * span + own[j] != key:
                continue  # one of the two has been merged since
            own[i], own[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (pair := own[a] * span + own[b]) in pairs:
                    rank, made = pairs[pair]
                    heapq.heappush(heap, (rank, a, pair, made))
        done[:] = own

    def _ids(self, done: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Final symbols to ids, characters outside the vocabulary to the ids of their bytes."""
        place = np.flatnonzero(done >= 0)
        symbols = done[place]
        outside = np.flatnonzero(symbols >= self.size)
        count = np.ones(len(symbols), np.int64)
        points = symbols[outside] - self.size
        count[outside] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        ends = np.cumsum(count)
        ids = np.repeat(symbols, count)
        spelled = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        ids[np.repeat(symbols >= self.size, count)] = self.byte_ids[spelled]
        edges = np.searchsorted(place, np.append(starts, starts[-1:] + sizes[-1:]))
        bounds = np.concatenate(([0], ends))[edges]
        raw, at = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


class WordEncoder(TextEncoder):
    """Ids of texts through the memo of words; a word unknown to it joins the next merge rounds."""

    def __init__(self, merger: Merger, limit: int = 32 << 20) -> None:
        super().__init__(lambda chunks: merger.encode([c.replace(" ", BLANK) for c in chunks]), limit)
        letters, signs = "".join(filter(str.isalnum, map(chr, range(128)))), "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
        every = "".join(map(chr, merger.chars.tolist()))
        #: places where this model's pieces let words be cut
        self.at_blanks = not merger.crosses(every.replace(BLANK, ""), BLANK)
        self.at_lines, self.at_signs = not merger.crosses(every, "\n"), not merger.crosses(letters, signs)

    def encode(self, texts: list[str | None] | pa.Array) -> pa.BinaryArray:
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.at_blanks:
            return self._encode_lists(pa.array([[_MARK + BLANK + t.replace(" ", BLANK)] if t else [] for t in column.to_pylist()], pa.list_(pa.string())))
        odd = pc.or_(pc.match_substring_regex(column, _ODD), pc.equal(column, "")).to_numpy(zero_copy_only=False)
        plain, other = np.flatnonzero(~odd), np.flatnonzero(odd)
        words = column.take(pa.array(plain))
        if self.at_lines:
            words = pc.replace_substring(words, "\n", f" {_MARK}\n")
        if self.at_signs:
            words = pc.replace_substring_regex(words, _BORDER, rf"\1 {_MARK}\2")
        cut = [[_MARK + u for u in _UNIT.findall(BLANK + t.replace(" ", BLANK))] if t else [] for t in column.take(pa.array(other)).to_pylist()]
        parts = [self._encode_lists(pc.split_pattern(words, " ")), self._encode_lists(pa.array(cut, pa.list_(pa.string())))]
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate((plain, other)), kind="stable")))


class WordDecoder:
    """Ids back to text by a table of the pieces' bytes; rows of unusual ids go to the library."""

    def __init__(self, path: str) -> None:
        pieces, _, kinds = read_model(path)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled = [bytes([int(p[3:5], 16)]) if k == 6 else p.replace(BLANK, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.table = pa.array(spelled, pa.binary())
        #: a text starts with the blank that the encoder put there
        self.opens = np.array([k == 1 and p.startswith(BLANK) for p, k in zip(pieces, kinds, strict=True)])
        self.odd = np.isin(kinds, (2, 3))

    def decode(self, ids: pa.ListArray) -> pa.StringArray:
        """The text of each list of ids; a null list is empty. Ids outside the vocabulary raise."""
        bounds = ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py()
        flat = pc.fill_null(ids.flatten(), 0).to_numpy()
        if len(flat) and not (0 <= flat.min() and flat.max() < len(self.opens)):
            raise ValueError("an id is out of the vocabulary")
        found = self.table.take(pa.array(flat))
        _, ends, data = found.buffers()
        ends = np.frombuffer(ends, np.int32)[: len(found) + 1] if len(found) else np.zeros(1, np.int32)
        raw = memoryview(data) if data is not None else memoryview(b"")
        odd = np.concatenate(([0], np.cumsum(self.odd[flat])))
        out = []
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            if a == b:
                out.append("")
                continue
            if self.opens[flat[a]] and odd[a] == odd[b]:
                try:
                    out.append(str(raw[ends[a] + 1 : ends[b]], "utf-8"))
                    continue
                except UnicodeDecodeError:
                    pass  # bytes that make no character: the library says what stands for them
            out.append(self.model.decode(flat[a:b].tolist()))
        return pa.array(out, pa.string())


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(Merger(*read_model(path)))


@functools.lru_cache(maxsize=2)
def decoder(path: str) -> WordDecoder:
    return WordDecoder(path)


def _lists(raw: pa.BinaryArray) -> pa.ListArray:
    """Rows of little-endian 32-bit ids as lists, without copying them."""
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(raw).to_numpy().astype(np.int64)))) // 4
    first = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset] if len(raw) else 0
    data = raw.buffers()[2]
    flat = np.frombuffer(data, np.int32, int(ends[-1]), int(first)) if ends[-1] else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """Adds (or replaces) an `array<int>` of ids; with `decoded_col` also the text they decode to, in the same pass."""
    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    if decoded_col is not None:
        added.append(T.StructField(decoded_col, T.StringType()))
    names = {f.name for f in added}
    fields = [f for f in docs.schema.fields if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for batch in sliced(batches, 10_000, text_col, 4 << 20):
            table = {f.name: batch.column(f.name) for f in fields}
            table[ids_col] = _lists(own.encode(batch.column(text_col)))
            if decoded_col is not None:
                table[decoded_col] = decoder(model_path).decode(table[ids_col])
            yield pa.RecordBatch.from_pydict(table)

    return docs.mapInArrow(tidy(run), T.StructType([*fields, *added]))


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds (or replaces) the text that an `array<int>` of ids stands for."""
    fields = [f for f in encoded.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(model_path)
        for batch in sliced(batches, 1024):
            table = {f.name: batch.column(f.name) for f in fields}
            table[text_col] = own.decode(batch.column(ids_col))
            yield pa.RecordBatch.from_pydict(table)

    return encoded.mapInArrow(tidy(run), T.StructType([*fields, T.StructField(text_col, T.StringType())]))
