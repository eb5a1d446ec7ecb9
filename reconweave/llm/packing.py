"""Packing of documents into fixed-length training sequences.

Method: shortest-pack-first over the length histogram. Documents become
pieces (whole, or full chunks and a remainder); only the histogram of piece
lengths, at most ``capacity`` numbers, goes to the driver. Lengths are placed
longest first, each into the pack with most room left, whole groups of equal
packs at a time, which updates counts of packing patterns. The patterns then
join back to the pieces by (length, rank).

Edge cases: a null or empty text is a document with the end token alone; a
null doc_id is carried; repeated rows are packed as often as they occur; a very
long text is tokenized block by block and fills as many whole sequences as it
can; pieces of one length are alike, so ties are settled by the task that cut
them; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconweave.llm.common import durable, map_batches

CAPACITY = 2048
END_ID = 1
#: Words whose ids a Python worker remembers (some 10 MB); the memory is emptied when full.
REMEMBERED = 60_000
#: Bytes of text whose words are looked up together.
BLOCK_BYTES = 1 << 19

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


class WordIds(dict):
    """UTF-8 words to their ids as little-endian uint32 bytes.

    The vocabulary's pre-tokenizer drops white space, so ids of a text are the
    ids of its words in order. Unknown words are encoded in one call a batch.
    Latin letter words go through the same merges in tiktoken's form,
    with the word end as a byte of its own; all others go through tokenizers.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tails: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}

        def raw(token: str) -> bytes:
            whole = token.endswith("</w>")
            return bytes(byte[c] for c in (token[:-4] if whole else token)) + b"\x01" * whole

        ranks = {bytes([b]): b for b in range(256)}
        ranks |= {bytes([b, 1]): 256 + b for b in range(256)}
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            ranks.setdefault(raw(left) + raw(right), len(ranks))
        known = {raw(token): i for token, i in model["vocab"].items()}
        self.id_of = np.array([known.get(token, 0) for token in ranks], "<u4")
        self.ends = np.array([token.endswith(b"\x01") for token in ranks])
        self.words = tiktoken.Encoding("words", pat_str="[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def latin(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of Latin letters."""
        if not words:
            return []
        got = np.array(self.words.encode_ordinary("\x01".join(words) + "\x01"), np.int64)
        ids, ends = self.id_of[got].tobytes(), ((np.flatnonzero(self.ends[got]) + 1) * 4).tolist()
        return [ids[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]

    def learn(self, words: set[bytes]) -> None:
        new = words - self.keys()
        if not new:
            return
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = words
        bare = [w for w in new if w.isalpha() and len(w) <= 64]
        self.update(zip(bare, self.latin(b"\n".join(bare).lower().decode().split("\n")) if bare else [], strict=True))
        other = [w for w in new if w not in self]
        if not other:
            return
        cores, at = [], []
        for w, text in zip(other, b"\n".join(other).decode().lower().split("\n"), strict=True):
            core = text.rstrip(".,!:;?|&%$#*")
            if core.isalpha() and (core.isascii() or max(core) < "\u0250") and len(core) <= 64:
                cores.append(core)
                at.append((w, text[len(core) :]))
            else:
                self[w] = self.encode(w.decode())
        for (w, tail), ids in zip(at, self.latin(cores), strict=True):
            self[w] = ids + self.tail(tail) if tail else ids

    def tail(self, text: str) -> bytes:
        key = text.encode()
        if key not in self.tails:
            if len(self.tails) > REMEMBERED:
                self.tails.clear()
            self.tails[key] = self.encode(text)
        return self.tails[key]


_ids: dict[str, WordIds] = {}


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def blocks(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of a text of about ``most`` bytes, cut at white space only."""
    at = 0
    while len(text) - at > most and (space := _SPACE.search(text, at + most)):
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]


def token_ids(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of UTF-8 texts as little-endian uint32 bytes, equal to those of tokenizers on the whole text."""
    if path not in _ids:
        _ids[path] = WordIds(path)
    cache = _ids[path]
    special = [t.encode() for t in ("<|startoftext|>", "<|endoftext|>")]
    out: list[list[bytes]] = [[] for _ in texts]
    block, size = [], 0

    def flush():
        nonlocal block, size
        cache.learn(set().union(*(words for _, words in block)))
        for i, words in block:
            out[i].append(b"".join(map(cache.__getitem__, words)))
        block, size = [], 0

    for i, text in enumerate(texts):
        for part in blocks(text, BLOCK_BYTES):
            if any(s in part for s in special):
                flush()
                out[i].append(cache.encode(part.decode()))
                continue
            block.append((i, part.split()))
            size += len(part)
            if size > BLOCK_BYTES:
                flush()
    flush()
    return [b"".join(parts) for parts in out]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocab: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of (doc_id, text) rows, one row each.

    ``part`` is the task that cut the piece and ``nth`` its place among the
    task's pieces of that length, from 0: written out once, they let ranks be
    built from counts by (length, part).
    """
    vocab = vocab or vocabulary()

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        end = np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                texts = some["text"].cast(pa.binary()).fill_null(b"").to_pylist()
                rows, binary = [], []
                for doc_id, ids in zip(some["doc_id"].to_pylist(), token_ids(texts, vocab), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        length = len(piece) // 4
                        rows.append((doc_id, start, length, zlib.crc32(piece), n, part, int(seen[length])))
                        seen[length] += 1
                        if with_ids:
                            binary.append(piece)
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                if with_ids:
                    arrays, names = [*arrays, pa.array(binary, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    return map_batches(rows, cut, PIECES + (", ids binary" if with_ids else ""))


def pack_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shortest-pack-first on a histogram {length: pieces}: (number of packs, [(length, times), ...]) each."""
    groups: dict[int, list] = {}
    rooms: list[int] = []
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def put(room: int, count: int, pattern: list[tuple[int, int]]) -> None:
        if not count:
            return
        if not room:
            done.append((count, pattern))
            return
        if room not in groups:
            groups[room] = []
            heapq.heappush(rooms, -room)
        groups[room].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            while rooms and not groups.get(-rooms[0]):
                groups.pop(-heapq.heappop(rooms), None)
            if rooms and -rooms[0] >= length:
                room = -rooms[0]
                count, pattern = groups[room].pop()
                took = min(count, n)
                put(room, count - took, pattern)
                more = pattern[:-1] + [(length, pattern[-1][1] + 1)] if pattern[-1][0] == length else [*pattern, (length, 1)]
                put(room - length, took, more)
                n -= took
            else:
                each = capacity // length
                put(capacity - each * length, n // each, [(length, each)])
                rest = n % each
                put(capacity - rest * length, int(rest > 0), [(length, rest)])
                n = 0
    for room in sorted(groups):
        done += groups[room]
    return done


def slot_table(patterns: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[str, np.ndarray]:
    """Rank ranges of each length with the packs they fill, sorted by (length, first rank)."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for count, pattern in patterns:
        offset = 0
        for length, times in pattern:
            rank = used.get(length, 0)
            rows.append((length, rank, times, first, offset))
            used[length] = rank + count * times
            offset += length * times
        first += count
    length, rank, times, first_pack, offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return {"key": (length << 44) + rank, "rank": rank, "times": times, "first": first_pack, "offset": offset}


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocab: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pack all documents: each piece with its ``sequence_id`` and ``offset`` there.

    ``with_ids`` adds the piece's token ids as little-endian uint32 bytes; a
    sequence is the pieces of its id by offset, padded to ``capacity``.
    """
    pieces = durable(cut_documents(docs, capacity, end_id, vocab, with_ids), "pieces")
    counts = durable(pieces.groupBy("length", "part").count(), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = slot_table(pack_patterns(histogram, capacity), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "nth", "part")
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(slots["key"], (length << 44) + rank, "right") - 1
            pack_no, nth = np.divmod(rank - slots["rank"][at], slots["times"][at])
            columns = [batch[n] for n in batch.schema.names if n != "rank"]
            columns += [pa.array(slots["first"][at] + pack_no), pa.array(slots["offset"][at] + nth * length)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return map_batches(ranked.select(*[n for n in schema.names if n in ranked.columns], "rank"), place, schema)


def in_order(packed: DataFrame, order: DataFrame) -> DataFrame:
    """``packed`` with sequences numbered anew, without gaps, in the order of documents that (doc_id, at) rows give.

    A sequence stands where its longest piece's document stands, of equal ones
    the first; a repeated doc_id stands where it occurs first. Sequences are
    numbered chunk by chunk of their sorted places.
    """
    first = order.groupBy(F.col("doc_id").cast("long").alias("__doc_id")).agg(F.min("at").alias("at"))
    packed = durable(packed, "packed")
    placed = packed.join(first, F.col("doc_id").eqNullSafe(F.col("__doc_id"))).select("sequence_id", F.struct((-F.col("length")).alias("by"), "at").alias("piece"))
    stand = placed.groupBy("sequence_id").agg(F.min("piece").alias("piece")).select("sequence_id", F.col("piece.at").alias("at"))
    # written, so that a lost chunk comes back the same
    dealt = durable(stand.repartitionByRange("at", "sequence_id").withColumn("chunk", F.spark_partition_id()), "dealt")
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("chunk").agg(F.count("*").alias("n")).select("chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("chunk").orderBy("at", "sequence_id")) - 1
    named = dealt.withColumn("nth", nth).join(base, "chunk").select("sequence_id", (F.col("base") + F.col("nth")).cast("long").alias("number"))
    return packed.join(named, "sequence_id").withColumn("sequence_id", F.col("number")).select(*packed.columns)
