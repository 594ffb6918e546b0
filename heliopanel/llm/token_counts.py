"""Token counts by a transducer that is compiled from a sentencepiece BPE model.

The tokens of a prefix of a word end in one last token. Reading one more character, the new last token is
the one piece that ends there and keeps its place beside the last token of the prefix before it; two
pieces keep their places if they are what merging their joined text gives. So a deterministic transducer
that reads characters has to remember, for each suffix that can still grow into a piece, the last token
before that suffix and how many tokens fewer the prefix before it has. Its transitions are annotated with
the change in the number of tokens. States and transitions are compiled when a text first needs them, up
to `MOST_STATES`; then compilation starts afresh, so the tables have a bounded size.

A space that follows another character, and a character that no piece holds, bring every state to the
start state: no piece spans them. Texts are cut into chunks there, so the state map of a chunk is constant
and is stored as its emitted count alone; maps compose by a prefix sum over the chunks. All chunks of a
batch run through the transducer side by side, one character of each per step. Characters outside the
model count one token per byte, as byte fallback has it.

Null texts count as empty, empty ones have no tokens. Repeated rows each get their counts. Columns of the
input named like an output column are replaced by it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from heliopanel.llm.common import without

SPACE = "▁"
MOST_STATES = 400_000
#: Transitions lie in an open-addressing table of 2 ** SLOT_BITS slots; it doubles where one long text fills half of it.
SLOT_BITS = 21
#: Characters that one pass through the transducer reads, about.
PASS_CHARS = 2_000_000
#: A transition is kept as next state and change in the count, the change shifted to be positive.
SHIFT, BIAS = 64, 32
SYMBOLS = 65_536
SPREAD = 0x9E3779B97F4A7C15


class Transducer:
    """Transition table of a model, compiled as far as texts have needed it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        if model.normalize("ﬁ  a ") != "▁ﬁ▁▁a▁" or not any(model.is_byte(i) for i in ids):
            raise ValueError(f"{path}: needs byte fallback and no normalisation")
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in ids
                       if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError(f"{path}: a piece goes on behind a space")
        self.prefixes = {p[:n] for p in self.scores for n in range(1, len(p))}
        singles = sorted(p for p in self.scores if len(p) == 1)
        self.chars = ["", *singles]
        #: Symbol of each code point; 0 is a character outside the model.
        self.symbol = np.zeros(0x110000, np.uint16)
        self.symbol[[ord(c) for c in singles]] = np.arange(1, len(self.chars))
        self.apart: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        start = (("", "", 0),)
        self.states, self.number, self.entries = [start], {start: 0}, {}
        self.transitions = 0
        self.allot(SLOT_BITS)

    def allot(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int64)

    def keep(self, key: int, value: int) -> None:
        slot = (key * SPREAD & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while self.keys[slot] != -1:
            slot = (slot + 1) & ((1 << self.bits) - 1)
        self.keys[slot], self.values[slot] = key, value

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Transitions by state and symbol, -1 where not compiled."""
        slot = ((keys.astype(np.uint64) * np.uint64(SPREAD)) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        found = self.values[slot]
        found[held == -1] = -1
        other = np.flatnonzero((held != keys) & (held != -1))
        while len(other):
            slot[other] = (slot[other] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[other]]
            found[other] = np.where(held == -1, -1, self.values[slot[other]])
            other = other[(held != keys[other]) & (held != -1)]
        return found

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: the best-scored, then leftmost, neighbours merge first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def beside(self, left: str, right: str) -> bool:
        if not left:  # start of the word: the piece must only be what its own text gives
            left, pair = "", [right]
        else:
            pair = [left, right]
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) > 500_000:
                self.apart.clear()
            known = self.apart[left, right] = self.merged(left + right) == pair
        return known

    def compile(self, key: int) -> None:
        """Add the transition of one state on one symbol."""
        state, char = key // SYMBOLS, self.chars[key % SYMBOLS]
        entries = self.states[state]
        last, change = next((suffix + char, fewer + 1) for suffix, before, fewer in entries
                            if suffix + char in self.scores and self.beside(before, suffix + char))
        after = [(suffix + char, before, fewer - change) for suffix, before, fewer in entries if suffix + char in self.prefixes]
        after.append(("", last, 0))
        after = tuple(self.entries.setdefault(e, e) for e in after)
        following = self.number.get(after)
        if following is None:
            following = self.number[after] = len(self.states)
            self.states.append(after)
        if self.transitions >= 1 << (self.bits - 1):
            full = self.keys >= 0
            held = list(zip(self.keys[full].tolist(), self.values[full].tolist()))
            self.allot(self.bits + 1)
            for old in held:
                self.keep(*old)
        self.keep(key, following * SHIFT + change + BIAS)
        self.transitions += 1

    def counts(self, codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Tokens of each text; texts lie one behind the other and start at `firsts`, spaces already marked."""
        if len(self.states) > MOST_STATES or self.transitions > MOST_STATES:
            self.clear()
        symbols = self.symbol[codes]
        known = symbols > 0
        space = codes == ord(SPACE)
        opens = np.ones(len(codes), bool)
        opens[1:] = ~known[:-1] | (space[1:] & ~space[:-1])
        opens[firsts] = True
        opens |= ~known
        begin = np.flatnonzero(opens)
        length = np.diff(begin, append=len(codes))
        tokens = np.zeros(len(begin), np.int64)
        single = ~known[begin]
        code = codes[begin[single]]
        tokens[single] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)

        lanes = np.flatnonzero(~single)
        lanes = lanes[np.argsort(-np.minimum(length[lanes], 32_000).astype(np.int16), kind="stable")]
        if len(lanes) and length[lanes].max() > 32_000:
            lanes = lanes[np.argsort(-length[lanes], kind="stable")]
        at, size = begin[lanes], length[lanes]
        still = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right") if len(size) else []
        state, count = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int32)
        for step, n in enumerate(still):
            key = state[:n] * SYMBOLS + symbols[at[:n] + step]
            found = self.find(key)
            missing = found < 0
            if missing.any():
                for k in np.unique(key[missing]).tolist():
                    self.compile(k)
                found = self.find(key)
            state[:n] = found // SHIFT
            count[:n] += found % SHIFT - BIAS
        tokens[lanes] = count
        # Composing constant maps is adding: one prefix sum, read at the texts' ends.
        total = np.concatenate([[0], np.cumsum(tokens)])
        edges = np.searchsorted(begin, np.append(firsts, len(codes)))
        return total[edges[1:]] - total[edges[:-1]]


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def passes(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about PASS_CHARS characters; a longer text is a run of its own."""
    run, chars = [], 0
    for text in texts:
        if run and chars + len(text) > PASS_CHARS:
            yield run
            run, chars = [], 0
        run.append(text)
        chars += len(text)
    if run:
        yield run


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Token counts of the texts."""
    machine = transducer(path)
    found = []
    for run in passes(texts):
        counts = np.zeros(len(run), np.int64)
        full = [i for i, t in enumerate(run) if t]
        if full:
            marked = [SPACE + run[i].replace(" ", SPACE) for i in full]
            codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
            firsts = np.cumsum([0] + [len(m) for m in marked[:-1]])
            counts[full] = machine.counts(codes, firsts)
        found.append(counts)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def add_token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """All rows with n_bytes, n_tokens and over_limit (more than `limit` tokens)."""
    from pyspark.sql import functions as F

    df = without(df, "n_bytes", "n_tokens", "over_limit")
    schema = StructType([*df.schema.fields, StructField("n_tokens", LongType())])
    place = df.columns.index(text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count_texts(texts, path), pa.int64())],
                                             names=[*batch.schema.names, "n_tokens"])

    counted = df.mapInArrow(count, schema)
    return counted.withColumn("n_bytes", F.octet_length(F.coalesce(counted[text], F.lit(""))).cast("long")).withColumn(
        "over_limit", counted["n_tokens"] > limit)
