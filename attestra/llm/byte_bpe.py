"""Byte-level BPE by a lazily determinised transducer, and a streaming decoder.

Encoding rests on one property of BPE: the encoding of a prefix ends in exactly one token, the one that is
stable next to the last token of the prefix before it. A state of the transducer is the set of positions at
which a vocabulary token may still be open, each with the tokens pending up to it. Reading a byte closes the
one stable token, drops positions that no token continues, and emits what all live positions have in common,
so output lags by no more than the longest token. States and transitions are made when first met and kept.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import in_worker, slices

#: Kept transitions and kept matches; beyond these the tables start anew, so memory stays bounded.
MAX_TRANSITIONS = 600_000
MAX_MATCHES = 900_000
MAX_PAIRS = 1_000_000
_NEVER = 1 << 62
_BYTES = [bytes((b,)) for b in range(256)]


class Transducer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.token[i] = piece
        self.open = {piece[:n] for piece in ranks for n in range(1, len(piece))}
        self.split = regex.compile(pattern)
        self._pairs: dict[int, bool] = {}
        self._edges: dict[int, tuple[list, list]] = {}
        self._matches: dict[str, bytes] = {}
        self._restart()

    def _restart(self) -> None:
        self._states: list[tuple] = [((b"", -1, ()),)]
        self._known = {self._states[0]: 0}
        self._moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self._made = 0

    def _spines(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """The parts at a token's left and right edge while it is merged from bytes, each with the rank of the
        merge that ends it (none ends the token itself)."""
        known = self._edges.get(token)
        if known is None:
            data = self.token[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            left, right = [], []
            rank_of = self.ranks.get
            while len(parts) > 1:
                ranked = [rank_of(parts[i] + parts[i + 1], _NEVER) for i in range(len(parts) - 1)]
                rank = min(ranked)
                if rank == _NEVER:
                    raise ValueError(f"token {token} can't be merged from its bytes")
                best = ranked.index(rank)
                if best == 0:
                    left.append((parts[0], rank))
                if best == len(parts) - 2:
                    right.append((parts[-1], rank))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            known = self._edges[token] = ([*left, (data, _NEVER)], [*right, (data, _NEVER)])
        return known

    def stable(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart: no parts that are at the border together merge before either ends.
        Of merges of one rank the leftmost comes first, hence < for the left part and <= for the right one."""
        if left < 0:
            return True
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            ends, starts, rank_of = self._spines(left)[1], self._spines(right)[0], self.ranks.get
            known = self._pairs[key] = not any((rank := rank_of(p + q, _NEVER)) < end_p and rank <= end_q for p, end_p in ends for q, end_q in starts)
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one transition: the next state and the tokens now certain."""
        live, closed = [], None
        ranks, opened, letter = self.ranks, self.open, _BYTES[byte]
        for path, last, pending in self._states[state]:
            path += letter
            if closed is None and (token := ranks.get(path)) is not None and self.stable(last, token):
                closed = (b"", token, (*pending, token))
            if path in opened:
                live.append((path, last, pending))
        if closed is None:
            raise ValueError("the vocabulary lacks a single byte")
        live.append(closed)
        first, shared = live[0][2], 0
        for token in first:
            if any(x[2][shared : shared + 1] != (token,) for x in live):
                break
            shared += 1
        key = tuple((path, last, pending[shared:]) for path, last, pending in live) if shared else tuple(live)
        to = self._known.get(key)
        if to is None:
            to = self._known[key] = len(self._states)
            self._states.append(key)
            self._moves.append({})
        done = self._moves[state][byte] = (to, first[:shared])
        self._made += 1
        return done

    def run(self, data: bytes) -> list[int]:
        if self._made > MAX_TRANSITIONS:
            self._restart()
        out: list[int] = []
        moves, state = self._moves, 0
        for byte in data:
            move = moves[state].get(byte) or self._move(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        return [*out, *self._states[state][-1][2]]

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        known = self._matches
        if len(known) > MAX_MATCHES:
            known.clear()
        if len(self._pairs) > MAX_PAIRS:
            self._pairs.clear()
        matches = self.split.findall(text)
        missing = set(matches).difference(known)
        for match in missing:
            ids = self.run(match.encode())
            known[match] = struct.pack(f"<{len(ids)}I", *ids)
        packed = b"".join(map(known.__getitem__, matches))
        for match in missing:
            if len(match) > 64:
                del known[match]
        return packed


#: Lead bytes by the number of bytes that must follow and the range of the first of them.
_LEADS = (
    [(b, 1, 0x80, 0xBF) for b in range(0xC2, 0xE0)]
    + [(0xE0, 2, 0xA0, 0xBF)]
    + [(b, 2, 0x80, 0xBF) for b in (*range(0xE1, 0xED), 0xEE, 0xEF)]
    + [(0xED, 2, 0x80, 0x9F), (0xF0, 3, 0x90, 0xBF), (0xF4, 3, 0x80, 0x8F)]
    + [(b, 3, 0x80, 0xBF) for b in range(0xF1, 0xF4)]
)
_LEAD = {b: (n, lo, hi) for b, n, lo, hi in _LEADS}
_REST = (b"", 0, 0x80, 0xBF)


class Decoder:
    """Tokens in, text out as soon as code points are complete. The state is the open code point's bytes, how
    many must follow and the range of the next one. What a token does to a state is worked out once and kept."""

    def __init__(self, token: list[bytes]):
        self.token = token
        self._moves: dict[tuple, dict[int, tuple[tuple, str]]] = {_REST: {}}

    @staticmethod
    def feed(state: tuple, data: bytes) -> tuple[tuple, str]:
        held, need, low, high = state
        out = []
        for b in data:
            if need and low <= b <= high:
                held, need, low, high = held + bytes((b,)), need - 1, 0x80, 0xBF
                if not need:
                    out.append(held.decode())
                    held = b""
                continue
            if need:
                out.append("�")
                held, need = b"", 0
            if b < 0x80:
                out.append(chr(b))
            elif b in _LEAD:
                held = bytes((b,))
                need, low, high = _LEAD[b]
            else:
                out.append("�")
        return ((held, need, low, high) if need else _REST), "".join(out)

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        state, moves = _REST, self._moves[_REST]
        for i in ids:
            move = moves.get(i)
            if move is None:
                move = moves[i] = self.feed(state, self.token[i])
                self._moves.setdefault(move[0], {})
            if move[0] is not state:
                state = move[0]
                moves = self._moves[state]
            yield move[1]
        if state[1]:
            yield "�"

    def text(self, packed: bytes) -> str:
        return "".join(self.stream(np.frombuffer(packed, "<u4").tolist()))


def load(path: str, pattern: str) -> tuple[Transducer, Decoder]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    fst = Transducer(ranks, pattern)
    return fst, Decoder(fst.token)


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded with ids=True).

    A null text counts as empty: no tokens, digests of no bytes. A null id stays null; repeated rows give
    repeated results; other columns are not read. Rows are handled one by one in Arrow batches, so nothing is
    shuffled and memory follows the longest text. ranks_path must be readable on every executor.
    """

    def work(batches):
        fst, decoder = in_worker(("byte-bpe", ranks_path, pattern), lambda: load(ranks_path, pattern))
        for batch in slices(batches):
            rows = {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if ids else {})
            for value in batch.column(1):
                packed = fst.encode(value.as_py() or "")
                back = decoder.text(packed)
                rows["n_tokens"].append(len(packed) // 4)
                rows["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                if ids:
                    rows["ids"].append(np.frombuffer(packed, "<u4").astype("int64"))
                    rows["decoded"].append(back)
            types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, types.get(k, pa.string())) for k, v in rows.items()], list(rows))

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return src.mapInArrow(work, schema + (", ids array<long>, decoded string" if ids else ""))
