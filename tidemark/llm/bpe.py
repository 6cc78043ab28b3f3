"""Byte-level BPE: texts in overlapping chunks, stitched where the pre-token boundaries meet again, then merged by rank."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

_LOADED: dict[str, dict[bytes, int]] = {}
#: Pieces that a worker remembers at most for a vocabulary, twice: the ones met lately, and those before them. Tasks that
#: follow each other in a worker find them there; some 100 MB at most.
REMEMBERED = 250_000
_REMEMBERED: dict[str, list[dict[str, bytes]]] = {}
NO_RANK = 1 << 60


def _sent(spark: SparkSession, ranks_path: str) -> str:
    """Send the vocabulary file to the executors; its name there."""
    common.ship(spark)
    spark.sparkContext.addFile(ranks_path)
    return ranks_path.rsplit("/", 1)[-1]


def load_ranks(name: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file that Spark has sent to this worker: lines of a base64 token and its rank."""
    if name not in _LOADED:
        with open(SparkFiles.get(name), "rb") as lines:
            _LOADED[name] = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return _LOADED[name]


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one piece: the neighbouring pair of lowest rank is joined, the leftmost first, until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    if n > 256:
        return _merge_long([piece[i : i + 1] for i in range(n)], ranks)
    get = ranks.get
    starts = list(range(n + 1))
    pairs = [get(piece[i : i + 2], NO_RANK) for i in range(n - 1)]
    while pairs:
        least = min(pairs)
        if least == NO_RANK:
            break
        at = pairs.index(least)
        del starts[at + 1], pairs[at]
        if at < len(pairs):
            pairs[at] = get(piece[starts[at] : starts[at + 2]], NO_RANK)
        if at:
            pairs[at - 1] = get(piece[starts[at - 1] : starts[at + 1]], NO_RANK)
    return tuple([ranks[piece[i:j]] for i, j in zip(starts, starts[1:], strict=False)])


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same with a heap and links, for pieces of any length."""
    import heapq

    n = len(parts)
    after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i], alive[j], after[i] = parts[i] + parts[j], False, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else -1
            if right >= 0 and (r := ranks.get(parts[left] + parts[right])) is not None:
                heapq.heappush(heap, (r, left, len(parts[left]) + len(parts[right])))
    return tuple(ranks[p] for i, p in enumerate(parts) if alive[i])


def _encoder(name: str):
    """A function of pieces that gives their ids as little-endian 32-bit numbers; it remembers the pieces met lately."""
    ranks = load_ranks(name)
    memory = _REMEMBERED.setdefault(name, [{}, {}])

    def learn(p: str) -> bytes:
        lately, before = memory
        got = lately.get(p) or before.get(p)
        if got is None:
            ids = merge(p.encode("utf-8"), ranks)
            got = struct.pack(f"<{len(ids)}i", *ids)
        if len(p) < 64:
            if len(lately) >= REMEMBERED:
                memory[:] = {}, lately
            memory[0][p] = got
        return got

    def encode(pieces: list[str]) -> bytes:
        found = list(map(memory[0].get, pieces))
        if None in found:
            found = [learn(p) if x is None else x for p, x in zip(pieces, found, strict=True)]
        return b"".join(found)

    return encode


def _whole(name: str, pattern: str):
    """Texts of one chunk: pre-tokenised and encoded where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, split = _encoder(name), regex.compile(pattern).findall
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [encode(split(t.as_py())) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _ends(pattern: str, text: str, last: bool) -> list[int]:
    """Where the pre-tokens of a chunk end. The last ones of a chunk that is cut may be longer than they seem."""
    ends = [m.end() for m in regex.finditer(pattern, text)]
    return ends if last else ends[:-2]


def _cut(size: int, overlap: int):
    """Lines (doc_id, row_key, at, last, text) of the overlapping chunks of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                chunks = -(-(len(text) - overlap) // size)
                doc, key = (pa.repeat(batch.column(c)[i], chunks) for c in (0, 1))
                parts = pa.array([text[at * size : (at + 1) * size + overlap] for at in range(chunks)], pa.string())
                last = pa.array([at == chunks - 1 for at in range(chunks)])
                whole = pa.RecordBatch.from_arrays([doc, key, pa.array(range(chunks), pa.int32()), last, parts], ["doc_id", "row_key", "at", "last", "text"])
                yield from (whole.slice(lo, 64) for lo in range(0, chunks, 64))

    return run


def _edges(pattern: str, size: int, overlap: int):
    """Adds to each chunk the boundaries near its head and those near its tail, as places in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, last, text = (batch.column(c)[i].as_py() for c in (2, 3, 4))
                start = at * size
                ends = [start, *(start + e for e in _ends(pattern, text, last))]
                places = [[e for e in ends if e < start + overlap], [e for e in ends if e >= start + size]]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, 1) for c in range(5)), *(pa.array([p], pa.list_(pa.int64())) for p in places)],
                    ["doc_id", "row_key", "at", "last", "text", "head", "tail"],
                )

    return run


def _between(name: str, pattern: str, size: int):
    """The ids of the pre-tokens of a chunk between the two places where it is stitched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, compiled = _encoder(name), regex.compile(pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                at, text, lo, hi = (batch.column(c)[i].as_py() for c in (3, 4, 5, 6))
                # A pre-token ends where the next one starts, so the chunk may end there as well.
                pieces = compiled.findall(text, lo - at * size, len(text) if hi is None else hi - at * size)
                ids = pa.array([encode(pieces)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in range(4)), ids], ["doc_id", "row_key", "copy", "at", "ids"])

    return run


def stitched(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Chunks (doc_id, row_key, at, last, text) with the places (lo, hi) where they are stitched to their neighbours.

    ``met`` tells whether all chunks of the text could be stitched. Equal rows get different copy numbers.
    """
    schema = "doc_id long, row_key long, at int, last boolean, text string, head array<bigint>, tail array<bigint>"
    edges = chunks.mapInArrow(_edges(pattern, chunk, overlap), schema).repartition("doc_id", "row_key")
    edges = edges.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "row_key", "at").orderBy("at")))
    text = Window.partitionBy("doc_id", "row_key", "copy")
    out = F.array_min(F.array_intersect("tail", F.lead("head").over(text.orderBy("at"))))
    places = edges.withColumn("hi", out).withColumn("lo", F.coalesce(F.lag("hi").over(text.orderBy("at")), F.when(F.col("at") == 0, F.lit(0).cast("long"))))
    whole = F.min((F.col("last") | F.col("hi").isNotNull()).cast("int")).over(text) == 1
    return places.select("doc_id", "row_key", "copy", "at", "text", "lo", "hi", "last", whole.alias("met"))


def _then(first: Callable, second: Callable | None) -> Callable:
    """Both in one worker, batch by batch."""
    return first if second is None else lambda batches: second(first(batches))


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, chunk: int = 32_768, overlap: int = 1_024, finish: tuple[Callable, str] | None = None) -> DataFrame:
    """(doc_id, ids binary): the token ids of each text as little-endian 32-bit numbers.

    Texts longer than a chunk are cut into chunks that overlap. The chunks are pre-tokenised in parallel; the pieces of
    one chunk end where a boundary of it is also one of the next, and from there the next one's pieces count, since what
    the pattern matches depends only on what follows. Where no boundary agrees in an overlap, the text is encoded whole.

    ``finish`` may give a function of batches (doc_id, ids), applied where they are made, and the schema of its result.

    * a null text counts as empty and has no ids; doc_id may be null;
    * repeated rows stay repeated; an empty table gives an empty result; further columns are ignored.
    """
    name = _sent(docs.sparkSession, ranks_path)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.string_or_empty("text").alias("text"))
    fits = F.length("text") <= chunk + overlap
    ids = "ids binary"
    last, schema = finish or (None, f"doc_id long, {ids}")
    short = texts.where(fits).mapInArrow(_then(_whole(name, pattern), last), schema)
    long = texts.where(~fits).select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    # Cut in one pass over each text.
    chunks = long.mapInArrow(_cut(chunk, overlap), "doc_id long, row_key long, at int, last boolean, text string")
    places = stitched(chunks, pattern, chunk, overlap)
    met = places.where("met").select("doc_id", "row_key", "copy", "at", "text", "lo", "hi")
    parts = met.mapInArrow(_between(name, pattern, chunk), f"doc_id long, row_key long, copy int, at int, {ids}")
    unmet = places.where("NOT met").groupBy("doc_id", "row_key", "copy").agg(F.array_sort(F.collect_list(F.struct("at", "last", "text"))).alias("c"))
    rest = unmet.select("doc_id", F.array_join(F.transform("c", lambda c: F.when(c["last"], c["text"]).otherwise(F.substring(c["text"], 1, chunk))), "").alias("text"))
    joined = parts.groupBy("doc_id", "row_key", "copy").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("c"))
    joined = joined.select("doc_id", F.aggregate("c", F.lit(b"").cast("binary"), lambda a, c: F.concat(a, c["ids"])).alias("ids"))
    joined = joined.mapInArrow(last, schema) if last else joined
    return short.unionByName(joined).unionByName(rest.mapInArrow(_then(_whole(name, pattern), last), schema))


def _digests(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = decoder_table(load_ranks(name))
        decimals = [str(i) for i in range(len(tokens))]
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for value in batch.column(1):  # one text's ids at a time, for they are many objects
                ids = np.frombuffer(value.as_buffer(), "<i4").tolist()
                counts.append(len(ids))
                encoded.append(hashlib.sha256(",".join([decimals[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([tokens[i] for i in ids])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def decoder_table(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id; ids without a token are empty."""
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return tokens


def _decode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = decoder_table(load_ranks(name))
        for batch in batches:
            out = [b"".join([tokens[i] for i in np.frombuffer(x.as_buffer(), "<i4").tolist()]) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return run


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, decoded binary): the raw bytes of the ids of each row, joined."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(_sent(encoded.sparkSession, ranks_path)), "doc_id long, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, **cuts: int) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text: encoded, and decoded again, in the same worker.

    Null texts, null and repeated ids, empty tables and further columns as for ``encode``; of merges of equal rank, which a
    vocabulary does not have at one place, the leftmost comes first.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encode(docs, ranks_path, pattern, finish=(_digests(_sent(docs.sparkSession, ranks_path)), schema), **cuts)
