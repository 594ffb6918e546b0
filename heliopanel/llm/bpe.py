"""Byte-level BPE: texts to token ids and byte offsets, and back.

Pre-tokenisation uses no regular expression. Every code point gets a class (letter, number, white space,
other), white space and apostrophes with what follows them. A finite automaton over these classes finds
the boundaries. A class is a map on the automaton's states; the maps reachable by composition are few, so
they are numbered once and composed by table lookup, which is associative: chunks are scanned side by side,
their totals are composed by a doubling scan, and each position then knows its state. The resulting
slices are merged pair by pair, lowest rank first, with a cache of bounded size.

Ids come with the byte offset of each token. Decoding copies the bytes of each token to its offset.

Null texts count as empty and have no tokens. Repeated rows are encoded each for itself; texts of any
length are taken whole. Columns of the input named like an output column are replaced by it. An empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from heliopanel.llm.common import without

#: Code points of Unicode's White_Space property (fixed values).
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that part after an apostrophe (fixed values of the pattern).
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")

# Classes as the automaton sees them.
LETTER, NUMBER, OTHER, SHORT, LONG, WHITE_ON, SPACE_LAST, WHITE_LAST = range(8)
CLASSES = 8
# States: what the last token is, or where inside it we are. NEW: the next character opens a token.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, NEW, ENDING_1, ENDING_2 = range(8)
STATES = 8
#: Texts of about this many code points are scanned together.
PASS_CHARS = 1_000_000
CHUNK = 256
CACHED_SLICES = 600_000


def step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a token starts before the character."""
    if kind == LETTER:
        if state == ENDING_2:
            return ENDING_1, False
        if state == ENDING_1:
            return NEW, False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if kind in (OTHER, SHORT, LONG):
        if kind == OTHER or state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS, state not in (IN_OTHERS, AFTER_SPACE)
        return (ENDING_1 if kind == SHORT else ENDING_2), True
    if kind == WHITE_ON:  # more white space or the end of the text follows
        return IN_WHITE, state != IN_WHITE
    return (AFTER_SPACE if kind == SPACE_LAST else NEW), True


class Automaton:
    """The automaton's maps, numbered and composed. A class plus CLASSES is the same class at a text's start."""

    def __init__(self) -> None:
        maps = [tuple(step(s, k)[0] for s in range(STATES)) for k in range(CLASSES)]
        maps += [(step(NEW, k)[0],) * STATES for k in range(CLASSES)]
        maps.append(tuple(range(STATES)))  # padding changes nothing
        number: dict[tuple, int] = {}
        of_class = [number.setdefault(m, len(number)) for m in maps]
        queue = list(number)
        while queue:
            first = queue.pop()
            for then in maps:
                both = tuple(then[s] for s in first)
                if both not in number:
                    number[both] = len(number)
                    queue.append(both)
        self.apply = np.array(list(number), np.uint8)
        self.of_class = np.array(of_class, np.uint8 if len(number) < 256 else np.uint16)
        self.compose = np.array([[number[tuple(b[s] for s in a)] for b in number] for a in number], self.of_class.dtype)
        self.identity = number[tuple(range(STATES))]
        self.opens = np.array([[step(s, k)[1] for k in range(CLASSES)] + [True] * CLASSES + [False] for s in range(STATES)])
        self.padding = 2 * CLASSES

    def boundaries(self, kinds: np.ndarray) -> np.ndarray:
        """Whether a token starts before each character."""
        n = len(kinds)
        chunks = -(-n // CHUNK)
        padded = np.full(chunks * CHUNK, self.padding, np.uint8)
        padded[:n] = kinds
        lanes = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
        own = self.of_class[lanes]
        width = len(self.compose)
        table = self.compose.ravel()
        for j in range(1, CHUNK):
            own[j] = table[own[j - 1].astype(np.int32) * width + own[j]]
        # Compose the chunks' totals by doubling.
        total, reach = own[-1].copy(), 1
        while reach < chunks:
            total[reach:] = table[total[:-reach].astype(np.int32) * width + total[reach:]]
            reach *= 2
        entry = np.full(chunks, NEW, np.uint8)
        entry[1:] = self.apply[total[:-1], NEW]
        before = np.empty_like(lanes)
        before[0] = entry
        before[1:] = self.apply.ravel()[own[:-1].astype(np.int32) * STATES + entry]
        return self.opens.ravel()[before.astype(np.int32) * (2 * CLASSES + 1) + lanes].T.ravel()[:n]


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton()


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE_ON for each code point."""
    codes = np.concatenate([np.arange(0xD800), np.arange(0xE000, sys.maxunicode + 1)]).astype(np.uint32)
    every = codes.tobytes().decode("utf-32-le")
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for name, kind in (("L", LETTER), ("N", NUMBER)):  # the character database of the regex module is a recent one
        for found in regex.finditer(rf"\p{{{name}}}+", every):
            kinds[codes[found.start():found.end()]] = kind
    kinds[WHITE] = WHITE_ON
    return kinds


def classes(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Class of each code point; texts start at `firsts`."""
    kinds = class_table()[codes]
    n = len(codes)
    ends = np.append(firsts[1:], n)
    last = np.zeros(n, bool)
    last[ends - 1] = True
    # White space with a visible character after it in the same text.
    white = np.flatnonzero((kinds == WHITE_ON) & ~last)
    white = white[kinds[white + 1] != WHITE_ON]
    quotes = np.flatnonzero(codes == ord("'"))
    kinds[white] = np.where(codes[white] == 32, SPACE_LAST, WHITE_LAST)
    if len(quotes):
        left = ends[np.searchsorted(firsts, quotes, side="right") - 1] - quotes - 1
        one = np.where(left >= 1, codes[np.minimum(quotes + 1, n - 1)], 0)
        two = np.where(left >= 2, codes[np.minimum(quotes + 2, n - 1)], 0)
        kinds[quotes[np.isin(one, [ord(c) for c in SHORT_ENDINGS])]] = SHORT
        long = np.zeros(len(quotes), bool)
        for a, b in LONG_ENDINGS:
            long |= (one == ord(a)) & (two == ord(b))
        kinds[quotes[long]] = LONG
    kinds[firsts] += CLASSES
    return kinds


class Vocabulary:
    """Ranks of a tiktoken file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[bytes, bytes] = {}

    def merged(self, piece: bytes) -> bytes:
        """Ids of one slice as packed 32-bit integers."""
        ranks = self.ranks
        if piece in ranks:
            return ranks[piece].to_bytes(4, "little")
        parts = [piece[i:i + 1] for i in range(len(piece))]
        if len(parts) > 100:
            parts = self.merged_long(parts)
        else:
            pairs = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            while pairs:
                lowest = min(pairs)
                if lowest == 1 << 30:
                    break
                at = pairs.index(lowest)
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
                del pairs[at]
                if at < len(pairs):
                    pairs[at] = ranks.get(parts[at] + parts[at + 1], 1 << 30)
                if at:
                    pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], 1 << 30)
        return b"".join([ranks[p].to_bytes(4, "little") for p in parts])

    def merged_long(self, parts: list[bytes]) -> list[bytes]:
        """The same with a heap of pairs: n log n steps for a slice of n bytes."""
        n, ranks = len(parts), self.ranks
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[parts[i] + parts[i + 1]], i, parts[i] + parts[i + 1]) for i in range(n - 1) if parts[i] + parts[i + 1] in ranks]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or parts[i] + parts[j] != joined:
                continue
            parts[i], alive[j], right[i] = joined, False, right[j]
            if right[i] < n:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (rank := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (rank, a, parts[a] + parts[b]))
        return [p for p, here in zip(parts, alive) if here]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in texts])
        full = np.flatnonzero(sizes)
        none = np.zeros(0, np.int32)
        if not len(full):
            return [none] * len(texts)
        firsts = (np.cumsum(sizes) - sizes)[full]
        opens = automaton().boundaries(classes(codes, firsts))
        at_byte = np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64))
        starts = np.flatnonzero(opens)
        begin = np.where(starts > 0, at_byte[starts - 1], 0)
        raw = "".join(texts).encode()
        cuts = [*begin.tolist(), len(raw)]
        first_slice = [*np.searchsorted(starts, firsts).tolist(), len(starts)]
        ids = [none] * len(texts)
        for place, a, b in zip(full.tolist(), first_slice, first_slice[1:]):
            slices = [raw[i:j] for i, j in zip(cuts[a:b], cuts[a + 1:b + 1])]
            packed = list(map(self.cache.get, slices))
            if None in packed:
                for k, known in enumerate(packed):
                    if known is None:
                        packed[k] = self.remember(slices[k])
            ids[place] = np.frombuffer(b"".join(packed), np.int32)
        return ids

    def remember(self, piece: bytes) -> bytes:
        found = self.merged(piece)
        if len(piece) <= 100:
            if len(self.cache) >= CACHED_SLICES:
                self.cache.clear()
            self.cache[piece] = found
        return found

    def decode(self, ids: np.ndarray, offsets: np.ndarray, size: int) -> bytes:
        """The bytes of the tokens, each at its offset."""
        lengths = self.lengths[ids]
        out = np.empty(size, np.uint8)
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(offsets, lengths) + inside] = self.bytes[np.repeat(self.starts[ids], lengths) + inside]
        return out.tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def passes(texts: list[str]) -> Iterator[list[str]]:
    run, chars = [], 0
    for text in texts:
        if run and chars + len(text) > PASS_CHARS:
            yield run
            run, chars = [], 0
        run.append(text)
        chars += len(text)
    if run:
        yield run


def int_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]), pa.int32()))


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str, place: int) -> Iterator[pa.RecordBatch]:
    words = vocabulary(path)
    for batch in batches:
        done = 0
        for texts in passes([t or "" for t in batch.column(place).to_pylist()]):
            ids = words.encode(texts)
            offsets = []
            for tokens in ids:
                lengths = words.lengths[tokens]
                offsets.append((np.cumsum(lengths) - lengths).astype(np.int32))
            part = batch.slice(done, len(texts))
            done += len(texts)
            yield pa.RecordBatch.from_arrays([*part.columns, int_lists(ids), int_lists(offsets)],
                                             names=[*batch.schema.names, "token_ids", "token_offsets"])


def decoded_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    words = vocabulary(path)
    for batch in batches:
        out = []
        for ids, offsets in zip(batch.column("token_ids"), batch.column("token_offsets")):
            ids, offsets = ids.values.to_numpy(zero_copy_only=False), offsets.values.to_numpy(zero_copy_only=False)
            size = int(offsets[-1] + words.lengths[ids[-1]]) if len(ids) else 0
            out.append(words.decode(ids, offsets, size))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])


TOKEN_FIELDS = [StructField("token_ids", ArrayType(IntegerType(), False)), StructField("token_offsets", ArrayType(IntegerType(), False))]


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All rows with token_ids and token_offsets (the byte at which each token starts)."""
    df = without(df, "token_ids", "token_offsets")
    place = df.columns.index(text)
    return df.mapInArrow(lambda batches: encoded_batches(batches, path, place), StructType([*df.schema.fields, *TOKEN_FIELDS]))


def decode(df: DataFrame, path: str) -> DataFrame:
    """All rows with `decoded`, the bytes that token_ids and token_offsets stand for."""
    df = without(df, "decoded")
    return df.mapInArrow(lambda batches: decoded_batches(batches, path), StructType([*df.schema.fields, StructField("decoded", BinaryType())]))


def round_trip(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` with token_ids and decoded: both steps in one task, without going through the JVM between them."""
    place = df.columns.index(text)
    columns = [*keep, "token_ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decoded_batches(encoded_batches(batches, path, place), path):
            yield batch.select(columns)

    return df.mapInArrow(run, StructType([*[df.schema[k] for k in keep], TOKEN_FIELDS[0], StructField("decoded", BinaryType())]))
