"""Byte-level BPE as a finite-state transducer, and its streaming decoder.

After a prefix w the next token of any continuation starts at a *live* boundary p, one where w[p:] is empty or begins
some token. The encoding of each w[:p] is unique: a token sequence is the encoding of its bytes exactly when every
adjacent pair is the encoding of its own bytes. A state is the set of live boundaries, each with the last token before
it and the trie node of w[p:]. For each byte the transducer puts out the token that ends there when the text does; a
piece's tokens are among these outputs and are read from its end, each telling where the one before it ends. States and
transitions are made when first reached (lazy determinisation) and dropped when there are too many.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import Scratch, give_back, table

#: Bounds of a task's memory: states of the transducer, remembered pairs and pieces, and bytes of pieces that are remembered.
MAX_STATES, MAX_PAIRS, MAX_PIECES, MAX_PIECE = 180_000, 250_000, 300_000, 64
#: Parts of decoded text that are hashed at once.
PART = 1 << 14
#: Rows of a batch of results.
OUT_ROWS = 250
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class _State(dict):
    """Transitions by byte, each made when it is first taken; ``last`` is the token that ends here."""

    __slots__ = ("last", "live", "owner")

    def __init__(self, owner: Transducer, live: tuple[int, ...], last: int):
        self.owner, self.live, self.last = owner, live, last

    def __missing__(self, byte: int) -> _State:
        return self.owner._step(self, byte)


class Transducer:
    """Encoder of one vocabulary: ``ranks`` maps a token's bytes to its id, which is also its merge rank."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.vocabulary = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, k in ranks.items():
            self.vocabulary[k] = token
        # trie of the tokens: node << 8 | byte to node, a node's token (-1: none), and whether longer tokens follow
        self.children: dict[int, int] = {}
        self.token_at, self.inner = [-1], [True]
        for token, k in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                key = node << 8 | byte
                node = self.children.get(key, -1)
                if node < 0:
                    node = self.children[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
            self.token_at[node] = k
        # a live boundary is one number: the token before it plus one (0: none), then the node in the lower bits; a pair likewise
        self.bits = max(len(self.token_at), len(self.vocabulary)).bit_length()
        self.lengths = [len(token) for token in self.vocabulary]
        self._pairs: dict[int, bool] = {}
        self._heads: dict[int, list[tuple[bytes, int]]] = {}
        self._tails: dict[int, list[tuple[bytes, int]]] = {}
        self._reset()

    def _reset(self) -> None:
        for state in getattr(self, "states", {}).values():
            state.clear()  # states refer to each other; so they go without the garbage collector
        self.states: dict[tuple[int, ...], _State] = {}
        self.start = self.states[(0,)] = _State(self, (0,), -1)

    def forget(self) -> None:
        self._pairs.clear()
        self._heads.clear()
        self._tails.clear()
        self._reset()

    def merge(self, data: bytes, below: int | None = None) -> list[bytes]:
        """The merges themselves: join the adjacent pair of lowest rank, the leftmost first, until none is a token."""
        ranks, none = self.ranks, len(self.vocabulary)
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, i = min((ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
            if best == none or below is not None and best >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _edge(self, token: int, side: int, memo: dict) -> list[tuple[bytes, int]]:
        """What stands at one end of a token while its bytes are merged: each part, and the rank that ends it."""
        found = memo.get(token)
        if found is None:
            data = self.vocabulary[token]
            if len(data) == 1:
                found = [(data, 1 << 40)]
            else:
                part = self.merge(data, token)[side]
                inner = self._edge(self.ranks[part], side, memo)
                found = [*inner[:-1], (part, token), (data, 1 << 40)]
            memo[token] = found
        return found

    def _fits(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side are the encoding of their bytes.

        Their own merges go on as if each stood alone, by rank, until a merge over the boundary comes first; of equal
        ranks the leftmost goes first.
        """
        tail, head = self._edge(left, -1, self._tails), self._edge(right, 0, self._heads)
        i = j = 0
        ranks = self.ranks
        while True:
            (a, a_ends), (b, b_ends) = tail[i], head[j]
            over = ranks.get(a + b)
            if over is not None and over < a_ends and over <= b_ends:
                return False
            if i + 1 == len(tail) and j + 1 == len(head):
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def _step(self, state: _State, byte: int) -> _State:
        children, token_at, inner, pairs, bits = self.children, self.token_at, self.inner, self._pairs, self.bits
        low = (1 << bits) - 1
        live, last = [], -1
        for at in state.live:
            node = at & low
            grown = children.get(node << 8 | byte)
            if grown is None:
                continue
            if inner[grown]:
                live.append(at - node + grown)
            if last < 0 and (token := token_at[grown]) >= 0:
                pair = at - node + token
                fits = at <= low or pairs.get(pair)
                if fits is None:
                    if len(pairs) >= MAX_PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self._fits((at >> bits) - 1, token)
                if fits:
                    last = token
        if last < 0:
            raise ValueError("the vocabulary isn't closed under its merges")
        live.append(last + 1 << bits)
        key = tuple(live)
        to = self.states.get(key)
        if to is None:
            if len(self.states) >= self.max_states:
                self._reset()
            to = self.states[key] = _State(self, key, last)
        state[byte] = to
        return to

    def encode(self, piece: bytes) -> list[int]:
        state, ends, lengths = self.start, [], self.lengths
        for byte in piece:
            state = state[byte]
            ends.append(state.last)
        out, i = [], len(ends)
        while i:
            token = ends[i - 1]
            out.append(token)
            i -= lengths[token]
        out.reverse()
        return out


class _Pieces(dict):
    """Little-endian ids of the pieces met lately: when half of what may be kept is new, what wasn't met since the last time goes."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", self.transducer.encode(piece.encode())).tobytes()
            if len(piece) > MAX_PIECE:
                return ids
        if len(self) >= MAX_PIECES // 2:
            self.older = self.copy()
            self.clear()
        self[piece] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.older = {}


class Utf8:
    """Incremental UTF-8 state machine: bytes in, complete characters out; ill-formed bytes become U+FFFD.

    A state is how many bytes a character still needs, the range that the next one must be in, the bits so far, and whether
    any are held. A byte out of its range ends the character as U+FFFD and is read again in the start state.
    """

    START = (0, 0x80, 0xBF, 0)
    #: Where the second byte is restricted: overlong forms, surrogates, and numbers beyond the last character.
    SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}

    def __init__(self):
        self.state = self.START

    @classmethod
    def step(cls, state: tuple[int, int, int, int], data: bytes) -> tuple[str, tuple[int, int, int, int]]:
        """Characters that ``data`` completes, and the state after it."""
        need, low, high, bits = state
        out = []
        for byte in data:
            if need:
                if low <= byte <= high:
                    need, low, high, bits = need - 1, 0x80, 0xBF, bits << 6 | byte & 0x3F
                    if not need:
                        out.append(chr(bits))
                        bits = 0
                    continue
                out.append("\ufffd")
                need, low, high, bits = cls.START
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                need = 3 if byte >= 0xF0 else 2 if byte >= 0xE0 else 1
                low, high = cls.SECOND.get(byte, (0x80, 0xBF))
                bits = byte & (0x3F >> need)
            else:
                out.append("\ufffd")
        return "".join(out), (need, low, high, bits)

    @classmethod
    def over(cls, state: tuple[int, int, int, int], data: bytes) -> tuple[str, tuple[int, int, int, int]]:
        """As ``step``; the start state is always the same object."""
        text, to = cls.step(state, data)
        return text, to if to[0] else cls.START

    def push(self, data: bytes, last: bool = False) -> str:
        text, self.state = self.step(self.state, data)
        if last and self.state[0]:
            text, self.state = text + "\ufffd", self.START
        return text


class _Plain(dict):
    """What a token gives in the start state of the decoder, with the state after it; its step is made once."""

    def __init__(self, vocabulary: list[bytes]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: int) -> tuple[str, tuple]:
        found = self[token] = Utf8.over(Utf8.START, self.vocabulary[token])
        return found


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.find = regex.compile(pattern).findall
        self.pieces = _Pieces(self.transducer)
        self.plain = _Plain(self.transducer.vocabulary)

    def forget(self) -> None:
        """Drop what was remembered: the worker's next task may be another operator's."""
        self.pieces.forget()
        self.plain.clear()
        self.transducer.forget()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        assert sys.byteorder == "little" and array("I").itemsize == 4
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes complete, token by token."""
        plain, vocabulary, start = self.plain, self.transducer.vocabulary, Utf8.START
        state = start
        for k in ids:
            text, state = plain[k] if state is start else Utf8.over(state, vocabulary[k])
            if text:
                yield text
        if state is not start:
            yield "\ufffd"

    def decoded_sha256(self, ids: bytes) -> str:
        """Checksum of the text as the stream gives it, piece by piece."""
        out, stream = hashlib.sha256(), self.decode_stream(memoryview(ids).cast("I"))
        while text := "".join(islice(stream, PART)):
            out.update(text.encode())
        return out.hexdigest()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(k) for token, k in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str, pattern: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Token ids of every whole text, and checksums of the ids and of the decoded bytes.

    ``path`` is a rank file that every executor has. Null and empty texts have no tokens. Repeated rows are encoded each;
    other columns are left out. The ids come as a list of integers if ``with_ids``.
    """
    ids = ", ids array<int>" if with_ids else ""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = codec(path, pattern)
        # the collector would walk all states again and again; nothing here leaves cycles behind
        gc.disable()
        try:
            yield from encoded(own, batches)
        finally:
            own.forget()
            gc.enable()
            gc.collect()
            give_back()

    def encoded(own, batches):
        for whole in batches:
            for i in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(i, OUT_ROWS)
                packed = [own.encode(text.as_py() or "") for text in batch.column(1)]
                counts = np.array([len(x) // 4 for x in packed], np.int64)
                columns = [batch.column(0), pa.array(counts), pa.array([hashlib.sha256(x).hexdigest() for x in packed]), pa.array([own.decoded_sha256(x) for x in packed])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    flat = pa.Array.from_buffers(pa.int32(), int(counts.sum()), [None, pa.py_buffer(b"".join(packed))])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return scratch.keep(docs.select(id_col, text_col).mapInArrow(run, f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string{ids}"), "tokens")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), *default_vocabulary(), Scratch(spark, "bpe"), with_ids=False)
