"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Every task packs the documents it reads, largest piece first, each into the fullest sequence it still fits.
Nearly full sequences are done. The others, as items of their summed length, are dealt to fewer tasks and
packed again, round after round, until one task holds them all or they no longer combine.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestra.llm.common import Workspace, in_worker, slices

CAPACITY, END_ID = 4096, 1
#: A sequence with at most this many free places is done.
SLACK = 8
#: Items that a task packs at a time; this bounds its memory.
CHUNK = 200_000
#: Pieces, and words, that a worker knows at most (about 250 MB of them).
MAX_WORDS = 800_000

#: The tokenizer's own splitting pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Without one of these a text is composed already, lower() maps each character by itself, and split() cuts
#: where the tokenizer sees white space.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"  # marks of the pattern's last part, whole runs of which are one word
_UNUSUAL = re.compile("[^\t\n\r -~\xa0-\u012f\u0131-\u024f]")


class Words:
    """Ids of whole texts. No token crosses white space, so what stands between is encoded by the tokenizer once
    and kept; texts with characters beyond Latin letters, or with a special token's string, go to it whole."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(PATTERN)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        """Pieces are put together from words; words never met are encoded in one call and parted at word ends."""
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        find, words = self.split.findall, self.words
        parts = {}
        for p in pieces:  # mostly letters with some marks behind them, which need no pattern
            letters = p.rstrip(_TAIL)
            parts[p] = ((letters, p[len(letters) :]) if len(letters) < len(p) else (p,)) if letters.isalpha() else find(p)
        new = list({w for ws in parts.values() for w in ws if w not in words})
        if new:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            packed, at = ids.tobytes(), 0
            for w, cut in zip(new, cuts, strict=True):
                words[w] = packed[at:cut]
                at = cut
        for p, ws in parts.items():
            self.known[p] = b"".join([words[w] for w in ws])

    def packed(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text, then of the end of a document."""
        return next(self.all_packed([text]))

    def all_packed(self, texts: list[str]) -> Iterator[bytes]:
        """packed() of each text; what the texts have that isn't known is encoded together."""
        end, known = END_ID.to_bytes(4, "little"), self.known
        odd = [k for k, t in enumerate(texts) if _UNUSUAL.search(t) or any(s in t for s in self.special)]
        whole = dict(zip(odd, self.tokenizer.encode_batch_fast([texts[k] for k in odd], add_special_tokens=False))) if odd else {}
        parts = [None if k in whole else t.lower().split() for k, t in enumerate(texts)]
        if len(known) > MAX_WORDS:
            known.clear()
        if missing := set(chain.from_iterable(p for p in parts if p)).difference(known):
            self._learn(missing)
        for k, p in enumerate(parts):
            yield (np.array(whole[k].ids, "<u4").tobytes() if p is None else b"".join(map(known.__getitem__, p))) + end


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Items, largest first, each into the open bin with the least room that still holds it: bins of item numbers.

    Open bins are kept by their room, and the rooms in use as bits of one number, so an item costs one shift.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        if room > size:
            by_room[room - size].append(at)
            rooms |= 1 << (room - size)
    return bins


def _member_type(id_type: pa.DataType) -> pa.StructType:
    return pa.struct([("doc_id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])


class _Bins:
    """Collects bins (lists of members) of one task, packs them in chunks and gives Arrow batches."""

    def __init__(self, round_: int, id_type: pa.DataType, capacity: int):
        self.first = (round_ << 56) + (TaskContext.get().partitionId() << 32)
        self.made, self.id_type, self.capacity, self.items, self.members = 0, id_type, capacity, [], 0

    def add(self, members: list[tuple]) -> Iterator[pa.RecordBatch]:
        self.items.append(members)
        self.members += len(members)
        if self.members >= CHUNK:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        sizes = [m[-1][5] + m[-1][3] for m in self.items]
        out = []
        for bin_ in best_fit(sizes, self.capacity):
            members, base = [], 0
            for i in bin_:
                members += [(*m[:5], m[5] + base) for m in self.items[i]]
                base += sizes[i]
            out.append((self.first + self.made, base, members))
            self.made += 1
        self.items, self.members = [], 0
        names = ("doc_id", "piece", "start", "length", "ids_crc32", "offset")
        for at in range(0, len(out), 2000):
            part = out[at : at + 2000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b[0] for b in part], pa.int64()), pa.array([b[1] for b in part], pa.int32()), pa.array([[dict(zip(names, m)) for m in b[2]] for b in part], pa.list_(_member_type(self.id_type)))],
                ["sequence_id", "used", "members"],
            )


def pack(ws: Workspace, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then id 1, so a null or empty text is one id. Documents longer than capacity are
    cut into pieces of capacity ids, the last one may be shorter; no other is cut. Places in a sequence have no
    gap. A null id stays null; repeated rows are packed as often as they come; an empty table gives no rows;
    only id and text are read. Texts never leave the task that reads them; what later rounds shuffle is the
    underfull sequences, which is a small part of the pieces unless few pieces combine at all.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"sequence_id long, used int, members array<struct<doc_id:{kind},piece:int,start:long,length:long,ids_crc32:long,offset:long>>"

    def tokenise(batches):
        words, bins = in_worker(("words", tokenizer_path), lambda: Words(tokenizer_path)), None
        for batch in slices(batches, 64):  # the ids of so many texts are in memory at a time
            bins = bins or _Bins(0, batch.schema.field(0).type, capacity)
            for doc_id, packed in zip(batch.column(0).to_pylist(), words.all_packed([t or "" for t in batch.column(1).to_pylist()])):
                for piece, start in enumerate(range(0, len(packed) // 4, capacity)):
                    part = packed[4 * start : 4 * (start + capacity)]
                    yield from bins.add([(doc_id, piece, start, len(part) // 4, zlib.crc32(part), 0)])
        if bins is not None:
            yield from bins.flush()

    def repack(round_: int):
        def work(batches):
            bins = None
            for batch in slices(batches):
                bins = bins or _Bins(round_, batch.schema.field(0).type.value_type.field("doc_id").type, capacity)
                for members in batch.column(0).to_pylist():
                    yield from bins.add([tuple(m.values()) for m in members])
            if bins is not None:
                yield from bins.flush()

        return work

    done = []
    level = ws.save(src.mapInArrow(tokenise, schema), "round0")
    open_ = F.col("used") < capacity - slack
    size = level.where(open_).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("members")), F.lit(0)).alias("m")).first()
    round_ = 0
    while size["n"] > 1 and round_ < 60:
        round_ += 1
        tasks = max(1, -(-size["m"] // CHUNK))
        done.append(level.where(~open_))
        level = ws.save(level.where(open_).select("members").repartition(tasks).mapInArrow(repack(round_), schema), f"round{round_}")
        before, size = size, level.where(open_).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("members")), F.lit(0)).alias("m")).first()
        if tasks == 1 or size["n"] > 0.98 * before["n"]:
            break
    for more in done:
        level = level.unionByName(more)
    return level.select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
