"""Byte-level BPE as a lazily determinised finite-state transducer.

A sequence of tokens is the encoding of its bytes exactly if every adjacent pair is: merging the bytes of the two gives
the two back. So the encoding of a prefix has one possible last token, and reading left to right needs no more of the
past than the bytes after the last token that every continuation keeps. A state is (last emitted token, pending
bytes, last token of each cut). Reading a byte extends the pending bytes and finds the last token of the new prefix; when
the lookahead is full, the cuts that no token can still cross are dropped and the tokens that all others share are emitted.
States and transitions are made when first needed and kept while there is room, as are the ids of whole pre-tokens.

The merges are the vocabulary's ranks: a pair may merge if its bytes are a token, the lowest rank first.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from quillmark.llm._spark import bounded_batches
from quillmark.llm._words import release, trimmed

# What a Python worker holds: 60,000 states of about 700 bytes, 240,000 pairs of 100 and two generations of 200,000 pre-tokens of 180
# bytes at most, some 140 MB whatever the texts.
MAX_STATES = 60_000
MAX_PIECES = 200_000
#: Deeper states are made for long pre-tokens only.
SHARED_PREFIX = 6
LOOKAHEAD = 24
#: Longer pre-tokens aren't kept, only run.
KEEP_BYTES = 64
DECODE_BYTES = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Bytes of one pre-token in, token ids out.

    A state is a dict from the next byte to the next state; under ``LASTS`` it holds the last token of each cut of its
    pending bytes (or -1), under ``ALIVE`` the places where a token may have begun with their nodes in the trie of tokens,
    under ``BEFORE`` the last emitted token, and under ``TAIL`` the ids that end the text here.
    Up to ``lookahead`` pending bytes nothing is emitted; beyond, what all live cuts share is.
    """

    ALIVE, LASTS, BEFORE, TAIL = -1, -2, -3, -4

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES, lookahead: int = LOOKAHEAD):
        self.ranks, self.max_states, self.lookahead = ranks, max_states, lookahead
        self.size = {i: len(t) for t, i in ranks.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.merge: dict[int, int] = {}
        self.sound: set[int] = set()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = self._merged(token)
            if len(parts) == 1:
                self.sound.add(rank)
                self.left[rank] = self.right[rank] = rank
            elif len(parts) == 2:
                a, b = ranks[parts[0]], ranks[parts[1]]
                self.sound.add(rank)
                self.left[rank], self.right[rank] = a, b
                self.merge[a << 20 | b] = rank
        self.trie: dict = {}  # byte -> node; under -1 the token that ends here
        for token, rank in ranks.items():
            node = self.trie
            for byte in token:
                node = node.setdefault(byte, {})
            if rank in self.sound:
                node[-1] = rank
        self.pairs: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states = 1
        self.root = {self.ALIVE: [], self.LASTS: (), self.BEFORE: -1}
        self.joined: dict[tuple, dict] = {}

    def _merged(self, data: bytes) -> list[bytes]:
        """The parts just before the last merge that makes the token (or the byte itself)."""
        parts, get, none = [data[i : i + 1] for i in range(len(data))], self.ranks.get, 1 << 60
        while len(parts) > 2:
            best, at = none, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1], none)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether b can follow a (-1: the start): no merge across the border comes before the merges on its two sides."""
        if a < 0:
            return True
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4 * self.max_states:
                self.pairs.clear()
            known = self.pairs[key] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        limit = 1 << 60
        while True:
            if self.merge.get(a << 20 | b, limit) < limit:
                return False
            if a > b:  # undo the later of the two tokens' last merges; a single byte can't be undone
                limit, inner = a, self.right[a]
                if inner == a:
                    limit, inner = b + 1, self.left[b]
                    if inner == b:
                        return True
                    b = inner
                else:
                    a = inner
            else:
                limit, inner = b + 1, self.left[b]
                if inner == b:
                    limit, inner = a, self.right[a]
                    if inner == a:
                        return True
                    a = inner
                else:
                    b = inner

    def step(self, state: dict, byte: int) -> dict:
        """The state after one more byte, made and linked."""
        lasts, before = state[-2], state[-3]
        n, last, alive = len(lasts), -1, []
        for i, node in state[-1]:
            node = node.get(byte)
            if node is not None:
                alive.append((i, node))
        if not n or lasts[-1] >= 0:
            node = self.trie.get(byte)
            if node is not None:
                alive.append((n, node))
        for i, node in alive:  # the longest first; only one token fits
            t = node.get(-1)
            if t is not None and self.fits(lasts[i - 1] if i else before, t):
                last = t
                break
        new = state[byte] = {-1: alive, -2: lasts + (last,), -3: before}
        self.states += 1
        return new

    def _walk(self, state: dict, rest: bytes) -> list[int]:
        """The ids of a text that goes on from a state with bytes not seen there before: as ``step``, but the states on the
        way aren't kept, as so long a prefix seldom comes again in another pre-token."""
        lasts, before, alive, trie, pairs = list(state[-2]), state[-3], state[-1], self.trie, self.pairs
        n = len(lasts)
        for byte in rest:
            last, found = -1, []
            if lasts[-1] >= 0:
                alive = alive + [(n, trie)]
            for i, node in alive:
                node = node.get(byte)
                if node is not None:
                    found.append((i, node))
                    if last < 0 and -1 in node:
                        t = node[-1]
                        a = lasts[i - 1] if i else before
                        fits = pairs.get(a << 20 | t) if a >= 0 else True
                        if fits or (fits is None and self.fits(a, t)):
                            last = t
            lasts.append(last)
            alive = found
            n += 1
        return self._chain(lasts, n)

    def emit(self, state: dict) -> tuple[dict, list[int]]:
        """The tokens that all live cuts share, and the state without them."""
        lasts = state[self.LASTS]
        n = len(lasts)
        live = [n] + [i for i, node in state[self.ALIVE] if len(node) > (-1 in node)]
        chains = [self._chain(lasts, i) for i in live]
        shared = 0
        while shared < min(map(len, chains)) and all(c[shared] == chains[0][shared] for c in chains):
            shared += 1
        out = chains[0][:shared]
        if not out:
            return state, out
        cut = sum(self.size[t] for t in out)
        keep = set()
        for c in chains:
            at = cut
            for t in c[shared:]:
                at += self.size[t]
                keep.add(at)
        rest = tuple(lasts[i - 1] if i in keep else -1 for i in range(cut + 1, n + 1))
        alive = [(i - cut, node) for i, node in state[self.ALIVE] if i in live]
        key = (out[-1], rest, tuple((i, id(node)) for i, node in alive))
        after = self.joined.get(key)
        if after is None:
            after = self.joined[key] = {self.ALIVE: alive, self.LASTS: rest, self.BEFORE: out[-1]}
            self.states += 1
        return after, out

    def _chain(self, lasts, at: int) -> list[int]:
        out = []
        while at:
            t = lasts[at - 1]
            out.append(t)
            at -= self.size[t]
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:  # a vocabulary may hold pre-tokens that merging alone doesn't reach
            return [whole]
        if self.states > self.max_states:
            self.clear()
        state, step = self.root, self.step
        if len(data) <= self.lookahead:
            for k, byte in enumerate(data):
                after = state.get(byte)
                if after is None:
                    if k >= SHARED_PREFIX:
                        return self._walk(state, data[k:])
                    after = step(state, byte)
                state = after
            tail = state.get(self.TAIL)
            if tail is None:
                tail = state[self.TAIL] = self._chain(state[self.LASTS], len(data))
            return tail
        out: list[int] = []
        for byte in data:
            state = state.get(byte) or step(state, byte)
            if len(state[self.LASTS]) > self.lookahead:
                state, tokens = self.emit(state)
                out += tokens
                if self.states > self.max_states:  # start afresh from a copy of this state
                    copy = {k: state[k] for k in (self.ALIVE, self.LASTS, self.BEFORE)}
                    self.clear()
                    state = copy
        return out + self._chain(state[self.LASTS], len(state[self.LASTS]))


class Encoder:
    """Texts to ids: the pattern cuts pre-tokens, the transducer encodes each that isn't kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.machine = Transducer(ranks)
        self.kept: dict[str, bytes] = {}  # full, it becomes ``older``; what is met again moves back
        self.older: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """The ids as 32-bit numbers."""
        get, new = self.kept.get, self._new
        return b"".join([get(p) or new(p) for p in self.find(text)])

    def _new(self, piece: str) -> bytes:
        data = piece.encode()
        out = self.older.get(piece)
        if out is None:
            ids = self.machine.encode(data)
            out = struct.pack(f"<{len(ids)}i", *ids)
        if len(data) <= KEEP_BYTES:
            if len(self.kept) >= MAX_PIECES:
                self.older = self.kept.copy()
                self.kept.clear()
            self.kept[piece] = out
        return out


class Utf8Stream:
    """Incremental UTF-8 state machine: bytes in any cuts, text out as soon as characters are complete.

    The state is (bytes still to come, code bits so far, range of the next byte); what can't continue a character becomes
    U+FFFD, and the byte that broke it is read again from the initial state.
    """

    def __init__(self):
        self.need, self.held, self.low, self.high = 0, b"", 0x80, 0xBF

    def _lead(self, b: int) -> bool:
        self.low, self.high = 0x80, 0xBF
        if 0xC2 <= b <= 0xDF:
            self.need = 1
        elif 0xE0 <= b <= 0xEF:
            self.need = 2
            self.low = 0xA0 if b == 0xE0 else 0x80
            self.high = 0x9F if b == 0xED else 0xBF
        elif 0xF0 <= b <= 0xF4:
            self.need = 3
            self.low = 0x90 if b == 0xF0 else 0x80
            self.high = 0x8F if b == 0xF4 else 0xBF
        else:
            return False
        self.held = bytes((b,))
        return True

    def feed(self, data: bytes) -> str:
        out, at, n = [], 0, len(data)
        while at < n:
            if not self.need:
                # everything up to the last possible lead byte is whole if it decodes: no need to walk through it
                end = n
                while end > at and n - end < 3 and data[end - 1] & 0xC0 == 0x80:
                    end -= 1
                end -= end > at and data[end - 1] >= 0xC0
                if end > at:
                    try:
                        out.append(data[at:end].decode())
                        at = end
                        continue
                    except UnicodeDecodeError as e:
                        out.append(data[at : at + e.start].decode())
                        at += e.start
                b = data[at]
                at += 1
                if b < 0x80:
                    out.append(chr(b))
                elif not self._lead(b):
                    out.append("�")
                continue
            b = data[at]
            if not self.low <= b <= self.high:
                out.append("�")
                self.need, self.held = 0, b""
                continue
            at += 1
            self.held += bytes((b,))
            self.need -= 1
            self.low, self.high = 0x80, 0xBF
            if not self.need:
                out.append(self.held.decode())
                self.held = b""
        return "".join(out)

    def close(self) -> str:
        rest = "�" if self.need else ""
        self.need, self.held = 0, b""
        return rest


class Decoder:
    """Ids to bytes by one gather over the vocabulary, in bounded steps."""

    def __init__(self, by: list[bytes]):
        self.size = np.array([len(t) for t in by], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(by), np.uint8)

    def chunks(self, ids: np.ndarray, limit: int = DECODE_BYTES):
        """The bytes in pieces of about ``limit`` bytes, cut at tokens, wherever characters end."""
        size = self.size[ids]
        end = np.cumsum(size)
        a = 0
        while a < len(ids):
            done = end[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(end, done + limit, "right")))
            s = size[a:b]
            src = np.repeat(self.at[ids[a:b]] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))
            yield self.data[src].tobytes()
            a = b


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    by = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        by[i] = t
    return by


_SHARED: dict[tuple[str, str], tuple] = {}


@contextmanager
def _codec(path: str, pattern: str):
    """(encoder, from ids to their bytes, from ids to their decimals with a space after each), made once in this Python worker.

    Spark keeps workers for later tasks, so what is made stays within the bounds above. The states have no cycles, and
    looking for some again and again took a third of the time: meanwhile the collector rests, and afterwards it no longer sees them.
    """
    on = gc.isenabled()
    gc.disable()
    try:
        key = (path, pattern)
        if key not in _SHARED:
            ranks = load_ranks(path)
            by = token_bytes(ranks)
            _SHARED[key] = Encoder(ranks, pattern), Decoder(by), Decoder([b"%d " % i for i in range(len(by))])
        yield _SHARED[key]
    finally:
        gc.freeze()
        if on:
            gc.enable()
        release()


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) per row; null reads as empty, and an empty text has no ids. Special tokens are ordinary text.

    ``path`` is a file of base64 tokens and ranks that every executor can read. Repeated rows repeat; other columns are ignored.
    """

    bounded_batches(docs)
    def run(batches):
        with _codec(path, pattern) as (coder, _, _):
            for b in trimmed(batches):
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    lists = [np.frombuffer(coder.ids(t or ""), np.int32) for t in part.column(1).to_pylist()]
                    off = np.cumsum([0] + [len(x) for x in lists])
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(lists)))], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are no UTF-8 become U+FFFD, null ids give the empty text."""

    bounded_batches(encoded)
    def run(batches):
        decoder = Decoder(token_bytes(load_ranks(path)))
        for b in trimmed(batches):
            texts = []
            for ids in b.column(1):
                machine, ids = Utf8Stream(), np.array(ids.as_py() or [], np.int64)
                texts.append("".join([machine.feed(x) for x in decoder.chunks(ids)] + [machine.close()]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def _digest(coder: Encoder, decoder: Decoder, decimals: Decoder, text: str) -> tuple[int, str, str, int]:
    ids = np.frombuffer(coder.ids(text), np.int32)
    told, back, machine, chars = hashlib.sha256(), hashlib.sha256(), Utf8Stream(), 0
    for x in decimals.chunks(ids[:-1]):
        told.update(x)
    told.update(b"%d" % ids[-1] if len(ids) else b"")
    for x in decoder.chunks(ids):
        back.update(x)
        chars += len(machine.feed(x))
    return len(ids), told.hexdigest(), back.hexdigest(), chars + len(machine.close())


def bpe_digest(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_chars): every text encoded and its ids decoded, digested in the task.

    Null reads as empty: no tokens, and the digests of nothing. Repeated rows repeat, other columns are ignored, an empty table
    gives no rows.
    """

    bounded_batches(docs)
    def run(batches):
        with _codec(path, pattern) as (coder, decoder, decimals):
            for b in trimmed(batches):
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    rows = [_digest(coder, decoder, decimals, t or "") for t in part.column(1).to_pylist()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, decoded_chars bigint")
