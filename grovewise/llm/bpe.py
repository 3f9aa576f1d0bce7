"""Byte-level BPE of a public vocabulary: ids of every text of a table, and back."""

from __future__ import annotations

import base64
import codecs
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Where the vocabulary file of a public tokenizer lies (lines of base64 token and rank).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The white space of \s in the tokenizer's pattern, and the endings that it splits off.
_SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_SLICE_BYTES = 2 << 20
_PIECE_BYTES = 1 << 16


def _class_of(point: int) -> int:
    if point in _SPACES:
        return _SPACE
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(point))[0], _OTHER)


_ASCII = np.array([_class_of(p) if p < 128 else _OTHER for p in range(256)], np.uint8)


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    """The merges as a finite-state transducer over bytes, determinised as far as texts need it.

    A state is what the bytes read so far allow as the token being read: for each place where a token may
    have begun, the node of the vocabulary's prefix tree that its bytes lead to, and the token before it.
    A token may follow another exactly if merging the bytes of both gives the two; so each prefix of a
    text has one last token. Steps are computed when first met and kept. Tokens are emitted once all
    places where the next may begin agree on them.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = 200_000):
        self.ranks, self.most_states = ranks, most_states
        self.width = {i: len(t) for t, i in ranks.items()}
        self.text = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token, self.depth, self.inner = [-1], [0], [False]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                nxt = self.child.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.child[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = nxt
            self.token[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[bytes, int]] | None] = {}
        self.forget()

    def forget(self) -> None:
        self.fits.clear()
        self.states = [((0, -1),)]
        self.number = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}

    def merged(self, piece: bytes, least: int = 1) -> list[bytes]:
        """The merges applied one by one to the few bytes of a token, until ``least`` parts are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]] | None:
        """The parts that stand at one edge of a token (0: left, 1: right) while it is merged, each with the
        rank of the merge that ends it; None if merging the token's bytes doesn't give the token."""
        known = self.edges.get((token, side), 0)
        if known != 0:
            return known
        piece = self.text[token]
        parts = self.merged(piece, 2) if len(piece) > 1 else [piece]
        found = [(piece, 1 << 30)]
        if len(parts) > 2:
            found = None
        elif len(parts) == 2:
            inner = [self.edge(self.ranks[part], i) if part in self.ranks else None for i, part in enumerate(parts)]
            found = None if None in inner else [*inner[side][:-1], (parts[side], token), *found]
        self.edges[token, side] = found
        return found

    def follows(self, before: int, token: int) -> bool:
        """Whether no merge crosses from one token into the next: a merge of two edge parts would have to come
        while both stand. Of equal ranks, the merge further left comes first."""
        known = self.fits.get((before, token))
        if known is None:
            right = self.edge(token, 0)
            left = self.edge(before, 1) if before >= 0 else []
            known = right is not None and left is not None
            if known:
                for a, a_ends in left:
                    for b, b_ends in right:
                        rank = self.ranks.get(a + b)
                        if rank is not None and rank < a_ends and rank <= b_ends:
                            known = False
            self.fits[before, token] = known
        return known

    def step(self, state: int, byte: int) -> tuple[int, int]:
        ahead, last = [], -1
        for node, before in self.states[state]:
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            token = self.token[nxt]
            if last < 0 and token >= 0 and self.follows(before, token):
                last = token
            if self.inner[nxt]:
                ahead.append((nxt, before))
        key = (*ahead, (0, last))
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.states)
            self.states.append(key)
        self.steps[state << 8 | byte] = found, last
        return found, last

    def back(self, lasts: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(lasts[end - 1])
            end -= self.width[lasts[end - 1]]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None and self.follows(-1, whole):
            return [whole]
        if len(self.states) > self.most_states:
            self.forget()
        steps, state, out, lasts = self.steps, 0, [], []
        for byte in piece:
            state, last = steps.get(state << 8 | byte) or self.step(state, byte)
            lasts.append(last)
            if len(lasts) & 1023 == 0:
                # all places where the token being read may begin lead back to one place: what lies before it is final
                places = {len(lasts) - self.depth[node] for node, _ in self.states[state]}
                while len(places) > 1:
                    far = max(places)
                    places.remove(far)
                    places.add(far - self.width[lasts[far - 1]])
                (at,) = places
                out += self.back(lasts, at)
                del lasts[:at]
        return out + self.back(lasts, len(lasts))


def cut(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces begin that merges don't cross; ``offsets`` are where the texts begin, and the end."""
    if not len(data):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    kind = _ASCII[lead]
    wide = np.flatnonzero(lead >= 0x80)
    if len(wide):
        p, b = at[wide], lead[wide].astype(np.int32)
        more = [(np.take(data, p + k, mode="clip") & 0x3F).astype(np.int32) for k in (1, 2, 3)]
        points = np.where(b < 0xE0, (b & 0x1F) << 6 | more[0], np.where(b < 0xF0, (b & 0xF) << 12 | more[0] << 6 | more[1], (b & 7) << 18 | more[0] << 12 | more[1] << 6 | more[2]))
        distinct, which = np.unique(np.minimum(points, 0x10FFFF), return_inverse=True)
        kind[wide] = np.array([_class_of(int(x)) for x in distinct], np.uint8)[which]
    n = len(at)
    first = np.zeros(n + 1, bool)
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[np.searchsorted(at, begins)] = True
    first[n] = True
    begin = first[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    last = space.copy()  # the last white space before something else, in the same text
    last[:-1] &= ~space[1:]
    last &= ~first[1:]
    begin |= last
    joins = np.flatnonzero(last & (lead == 32))  # a blank belongs to what follows it
    begin[joins + 1] = False
    marks = np.flatnonzero(begin & (lead == 39))
    if len(marks):
        padded = np.r_[lead, np.zeros(3, np.uint8)]
        edge = np.r_[first, True, True]
        for ending in _ENDINGS:
            hit = marks
            for k, letter in enumerate(ending, 1):
                hit = hit[(padded[hit + k] == ord(letter)) & ~edge[hit + k]]
            begin[hit + 1] = False
            after = hit + len(ending) + 1
            begin[after[after < n]] = True
    return at[begin]


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Encoder:
    """Texts to ids: pieces are cut and told apart with array operations; each distinct piece is transduced."""

    def __init__(self, ranks: dict[bytes, int], most_pieces: int = 500_000):
        self.transducer, self.most_pieces = Transducer(ranks), most_pieces
        self.known: dict[bytes, list[int]] = {}

    def piece(self, piece: bytes) -> list[int]:
        ids = self.known.get(piece)
        if ids is None:
            if len(self.known) >= self.most_pieces:
                self.known.clear()
            ids = self.transducer.encode(piece)
            if len(piece) <= 64:
                self.known[piece] = ids
        return ids

    def encode(self, data: np.ndarray, offsets: np.ndarray, want_ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """All ids, one text after the other (or None), and where each text's ids begin and end."""
        begin = cut(data, offsets)
        end = np.r_[begin[1:], len(data)]
        size = end - begin
        raw = data.tobytes() + bytes(16)
        words = np.ndarray((len(data) + 9,), "<u8", raw, strides=(1,))
        one = words[begin] & _MASKS[np.minimum(size, 8)]
        two = words[np.minimum(begin + 8, len(data))] & _MASKS[np.clip(size - 8, 0, 8)]
        mixed = one * np.uint64(0x9E3779B97F4A7C15) ^ (two + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ size.astype(np.uint64) << np.uint64(57)
        _, sample, which = np.unique(mixed, return_index=True, return_inverse=True)
        # pieces that only look alike by their hash, and long ones, are taken one by one
        apart = np.flatnonzero((size > 16) | (one != one[sample][which]) | (two != two[sample][which]) | (size != size[sample][which]))
        tokens = [self.piece(raw[b : b + s]) for b, s in zip(begin[sample].tolist(), size[sample].tolist())]
        if len(apart):
            which[apart] = np.arange(len(tokens), len(tokens) + len(apart))
            tokens += [self.piece(raw[b : b + s]) for b, s in zip(begin[apart].tolist(), size[apart].tolist())]
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        each = counts[which]
        ends = np.r_[0, np.cumsum(each)]
        bounds = ends[np.searchsorted(begin, offsets)]
        if not want_ids:
            return None, bounds
        flat = np.fromiter((i for t in tokens for i in t), np.int32, int(counts.sum()))
        from_ = (np.cumsum(counts) - counts)[which]
        return flat[np.repeat(from_ - ends[:-1], each) + np.arange(ends[-1])], bounds


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary: tuple[str, dict[bytes, int]]) -> Encoder:
    """One a worker and vocabulary, told by a digest of its content; it lasts over tasks."""
    digest, ranks = vocabulary
    if digest not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[digest] = Encoder(ranks)
    return _ENCODERS[digest]


def _sent(df: DataFrame, path: str):
    """The vocabulary (under 1 MB) with its digest, sent to the executors once."""
    with open(path, "rb") as file:
        digest = hashlib.sha256(file.read()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((digest, read_vocabulary(path)))


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``_SLICE_BYTES``: first and end row, bytes, offsets."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _SLICE_BYTES, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def token_ids(texts: DataFrame, key: str, text: str, out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and the ids of each text as an array of ints, without special tokens.

    One row for each row of ``texts``; an empty and a null text have an empty list; strings that look like
    special tokens are plain text. The vocabulary (under 1 MB) is sent to the executors once.
    """
    sent = _sent(texts, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches:
            for row, end, data, offsets in _slices(batch.column(1)):
                flat, bounds = encoder.encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), lists], names=[key, out])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(encode, f"`{key}` {kind}, `{out}` array<int>")


def token_counts(texts: DataFrame, key: str, text: str, out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and the number of ids of each text; 0 for an empty and a null text."""
    sent = _sent(texts, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches:
            parts = [np.diff(encoder.encode(data, offsets, False)[1]) for _, _, data, offsets in _slices(batch.column(1))]
            numbers = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers.astype(np.int64))], names=[key, out])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(count, f"`{key}` {kind}, `{out}` bigint")


def decoded(rows: DataFrame, key: str, ids: str, out: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and the text of each list of ids.

    The bytes of all tokens of a run of lists are joined by array operations; each list's bytes then go, a
    piece at a time, through an incremental UTF-8 state machine, since a character may spread over tokens and
    pieces. Bytes that are no UTF-8 become U+FFFD. A null list gives null, a null id nothing; an id that the
    vocabulary lacks is an error.
    """
    sent = _sent(rows, vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [b""] * (max(sent.value[1].values(), default=-1) + 1)
        known = np.zeros(len(tokens), bool)
        for token, i in sent.value[1].items():
            tokens[i], known[i] = token, True
        size = np.array([len(t) for t in tokens], np.int64)
        begin, letters = np.cumsum(size) - size, np.frombuffer(b"".join(tokens), np.uint8)
        for batch in batches:
            lists = batch.column(1)
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]
            values, texts, row = lists.flatten(), [], 0
            while row < len(lists):
                end = max(row + 1, int(np.searchsorted(ends, ends[row] + _SLICE_BYTES // 4, "right")) - 1)
                some = values.slice(ends[row], ends[end] - ends[row])
                there = some.is_valid().to_numpy(False)
                ids_ = pc.fill_null(some, 0).to_numpy()
                if not known[np.clip(ids_[there], 0, len(tokens) - 1)].all() or (there & ((ids_ < 0) | (ids_ >= len(tokens)))).any():
                    raise ValueError("an id that the vocabulary lacks")
                each = np.where(there, size[ids_], 0)
                at = np.cumsum(each)
                total = int(at[-1]) if len(at) else 0
                joined = letters[np.repeat(begin[ids_] - (at - each), each) + np.arange(total)].tobytes()
                cuts = np.r_[0, at][ends[row : end + 1] - ends[row]]
                for k in range(row, end):
                    machine, a, b = codecs.getincrementaldecoder("utf-8")("replace"), int(cuts[k - row]), int(cuts[k - row + 1])
                    pieces = [machine.decode(joined[x : min(x + _PIECE_BYTES, b)]) for x in range(a, b, _PIECE_BYTES)]
                    texts.append("".join([*pieces, machine.decode(b"", True)]) if lists[k].is_valid else None)
                row = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, out])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, ids).mapInArrow(decode, f"`{key}` {kind}, `{out}` string")
