"""Byte-level BPE by a global shuffle of distinct words.

1. Texts are cut into pre-tokens, a block of documents at a time. A block's distinct pre-tokens are
   numbered; each document keeps its sequence of numbers, which are the positions of its pre-tokens.
   Words are numbered part by part: a part holds the words of one hash class.
2. The parts of all blocks are exploded and dealt out by hash class, so equal words of all blocks meet in
   one task, and each distinct word is encoded once there, by merging the pair of lowest rank until none
   is left. A part's ids go back in the order of its words. (One row per word instead of one per part is
   the same shuffle, but 4 times as many bytes on the corpus that was measured; see the README.)
3. Parts are gathered by block and joined to the block's documents, which put ids together by position.
   Decoding joins the token-byte table to the blocks, nested to one row per vocabulary (50,256 tokens here,
   about half a megabyte: broadcast), and puts the bytes of the ids together. decode_ids() does it row by
   row for any table of ids.

Blocks are written bucketed by their name to the shared folder, so the documents are not shuffled at all
and a lost executor doesn't cost the tokenisation. Blocks are bounded by text and documents, parts by
blocks, so no group grows with the table; a very common word is one entry per block. Classes and buckets
grow with the partitions of the input. A worker remembers at most WORDS_HELD words (then it starts anew),
which bounds its memory. The result is written to the shared folder too, and the blocks are dropped then.

Defined results: a null text is the empty text, which has no ids; repeated rows give repeated results;
an empty table gives an empty table; other columns of the input are not read. A null array of ids
decodes to no bytes; an id beyond the table raises.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import drop_path, own_scratch, read_table, scratch, shared_dir, texts, trimmed

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: A block of documents ends at this many characters of text or documents.
BLOCK_CHARS, BLOCK_DOCS = 8 << 20, 8192
#: Ids in a batch of results, beside 512 documents.
OUT_IDS = 1 << 19
#: Hash classes for each bucket; fewest and most buckets; words that a worker remembers; from how many bytes on a word's merges are kept in a heap.
CLASSES, BUCKETS, WORDS_HELD, LONG_WORD = 4, (64, 4096), 1_000_000, 40


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merger:
    """Encodes words by the ranks of a vocabulary: of all neighbouring pairs the one of lowest rank merges, the leftmost first."""

    held: dict[str, Merger] = {}

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    @classmethod
    def of(cls, path: str) -> Merger:
        """Loaded once per Python worker."""
        if path not in cls.held:
            cls.held[path] = cls(load_ranks(path))
        return cls.held[path]

    def encode(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        parts = self._heaped(word) if len(word) >= LONG_WORD else self._scanned(word)
        return [self.ranks[p] for p in parts]

    def _scanned(self, word: bytes) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        rank, none = self.ranks.get, len(self.ranks) + (1 << 32)
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return parts

    def _heaped(self, word: bytes) -> list[bytes]:
        """The same in n log n steps: parts by their start, with the starts of their neighbours."""
        stop, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))  # of the part that starts here
        heap: list[tuple[int, int, int]] = []

        def offer(start: int) -> None:
            if start >= 0 and stop[start] < len(word):
                end = stop[stop[start]]
                rank = self.ranks.get(word[start:end])
                if rank is not None:
                    heapq.heappush(heap, (rank, start, end))

        for start in range(len(word)):
            offer(start)
        while heap:
            _, start, end = heapq.heappop(heap)
            if stop[start] == 0 or stop[start] >= len(word) or stop[start] >= end or stop[stop[start]] != end:
                continue  # one of the two has merged since
            stop[stop[start]], stop[start] = 0, end
            if end < len(word):
                before[end] = start
            offer(start)
            offer(before[start])
        starts, at = [], 0
        while at < len(word):
            starts.append(at)
            at = stop[at]
        return [word[a:b] for a, b in zip(starts, [*starts[1:], len(word)], strict=True)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            size += len(row[1] or "")
            if size >= BLOCK_CHARS or len(rows) >= BLOCK_DOCS:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), "<u4", len(words))
    return len(words).to_bytes(4, "little") + zstandard.compress(lengths.tobytes() + b"".join(words), 3)


def unpack_words(data: bytes) -> list[bytes]:
    n, raw = int.from_bytes(data[:4], "little"), zstandard.decompress(data[4:])
    ends = (4 * n + np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in zip([4 * n, *ends[:-1]], ends, strict=False)]


SPLIT = "block long, vocabulary string, doc_ids binary, null_ids binary, sizes binary, places binary, parts array<binary>"


def split_blocks(frame: DataFrame, pattern: str, parts: int, vocabulary: str) -> DataFrame:
    """One row per block: the words of its parts, and for each document the numbers of its pre-tokens in order."""

    def run(batches):
        find, names = regex.compile(pattern).findall, [x.split()[0] for x in SPLIT.split(", ")]
        for rows in _blocks(batches):
            numbers, found = _Numbers(), []
            for _, text in rows:
                own = find(text or "")
                found.append(np.fromiter(map(numbers.__getitem__, own), np.uint32, len(own)))
            words = [w.encode() for w in numbers]
            classes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % parts
            order = np.argsort(classes, kind="stable")
            renumbered = np.empty(len(words), np.uint32)
            renumbered[order] = np.arange(len(words), dtype=np.uint32)
            cuts = np.searchsorted(classes[order], np.arange(parts + 1)).tolist()
            listed = order.tolist()
            packed = [pack_words([words[i] for i in listed[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
            ids = np.array([r[0] or 0 for r in rows], np.int64)
            nulls = bytes(r[0] is None for r in rows)
            block = int.from_bytes(uuid.uuid4().bytes[:8], "little", signed=True)  # written once, then fixed
            places = renumbered[np.concatenate(found)] if words else np.zeros(0, np.uint32)
            cells = ids.tobytes(), nulls, pack(np.array([len(p) for p in found])), pack(places)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([vocabulary]), *(pa.array([c], pa.binary()) for c in cells), pa.array([packed], pa.list_(pa.binary()))], names)

    return texts(frame).mapInArrow(trimmed(run), SPLIT)


def _bucketed(blocks: DataFrame, buckets: int) -> tuple[str, str]:
    """(table, path), written once, bucketed by block: later joins on block leave it where it is."""
    spark = blocks.sparkSession
    name = f"ql_bpe_blocks_{uuid.uuid4().hex}"
    path = own_scratch(spark, f"{shared_dir(spark)}/{name}")
    blocks.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(name)
    return name, path


def encode_parts(parts: DataFrame, path: str, classes: int) -> DataFrame:
    """block, part, words -> block, part, n, ids: the number of words; packed, how many ids each has and then the ids."""

    def run(batches):
        own, held = Merger.of(path), {}
        for batch in batches:
            for k in range(batch.num_rows):
                words = unpack_words(batch.column(2)[k].as_py())
                if len(held) > WORDS_HELD:
                    held.clear()
                for word in words:
                    if word not in held:
                        held[word] = own.encode(word)
                lists = [held[word] for word in words]
                numbers = [len(x) for x in lists] + [i for x in lists for i in x]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([len(words)], pa.int32()), pa.array([pack(np.array(numbers))], pa.binary())], ["block", "part", "n", "ids"])

    return parts.select("block", "part", "words").repartition(classes, "part").mapInArrow(trimmed(run), "block long, part int, n int, ids binary")


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """id, token (bytes) of every rank of the vocabulary file."""
    ranks = load_ranks(path)
    return spark.createDataFrame(pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "token": pa.array(list(ranks), pa.binary())}))


def nested_tokens(spark: SparkSession, path: str) -> DataFrame:
    """vocabulary (its path), tokens: the bytes of all ids in the order of ids; null where an id is free."""
    ranks = load_ranks(path)
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return spark.createDataFrame(pa.table({"vocabulary": [path], "tokens": pa.array([tokens], pa.list_(pa.binary()))}))


def decode_ids(frame: DataFrame, key: str, ids: str, tokens: DataFrame) -> DataFrame:
    """key, decoded (binary): explodes the ids, joins the token-byte table, reassembles by position.

    Keys must be distinct. Hex digits stand for the bytes while they are concatenated.
    """
    parts = frame.select(F.col(key).alias("_key"), F.posexplode_outer(ids).alias("_at", "_id"))
    joined = parts.join(F.broadcast(tokens.select(F.col("id").alias("_id"), F.hex("token").alias("_hex"))), "_id", "left")  # as many rows as ranks
    checked = F.when(F.col("_id").isNotNull() & F.col("_hex").isNull(), F.raise_error(F.lit("an id is not in the token table"))).otherwise(F.col("_hex"))
    cells = F.array_sort(F.collect_list(F.struct("_at", checked.alias("_hex"))))
    return joined.groupBy("_key").agg(cells.alias("_cells")).select(
        F.col("_key").alias(key), F.unhex(F.array_join(F.transform("_cells", lambda c: F.coalesce(c["_hex"], F.lit(""))), "")).alias("decoded")
    )


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"
_ENCODED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32()))])


class _Dictionary:
    """The ids of a block's words, by their numbers."""

    def __init__(self, cells: list[dict]):
        counts, flat = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for cell in cells:  # in the order of parts
            numbers = unpack(cell["ids"]).astype(np.int32)
            counts.append(numbers[: cell["n"]])
            flat.append(numbers[cell["n"] :])
        self.counts, self.flat = np.concatenate(counts), np.concatenate(flat)
        self.starts = np.cumsum(self.counts, dtype=np.int64) - self.counts
        ids = list(map(str, self.flat.tolist()))
        self.written = [",".join(ids[a : a + n]) for a, n in zip(self.starts.tolist(), self.counts.tolist(), strict=True)]

    def ids(self, places: np.ndarray) -> np.ndarray:
        size = self.counts[places]
        upto = np.cumsum(size)
        return self.flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.starts[places] - (upto - size), size)]


def _reassemble(with_ids: bool):
    """Documents of blocks that stand beside the cells of their words and the bytes of all tokens."""
    schema = _ENCODED_ARROW if with_ids else pa.schema(list(_ENCODED_ARROW)[:4])

    def batch_of(rows: list[tuple], arrays: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)]
        if with_ids:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        known, token = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column("vocabulary")[k].as_py()
                if name != known:  # one row per vocabulary: the same table beside every block
                    known, token = name, batch.column("tokens")[k].as_py().__getitem__
                ids_bytes, nulls, sizes, packed, cells = (batch.column(c)[k].as_py() for c in ("doc_ids", "null_ids", "sizes", "places", "cells"))
                words = _Dictionary(cells or [])
                places, rows, arrays, start, held = unpack(packed), [], [], 0, 0
                for doc_id, null, size in zip(np.frombuffer(ids_bytes, np.int64).tolist(), nulls, unpack(sizes).tolist(), strict=True):
                    at = places[start : start + size]
                    start += size
                    ids = words.ids(at)
                    listed = ",".join(map(words.written.__getitem__, at.tolist()))
                    decoded = b"".join(map(token, ids.tolist()))
                    rows.append((None if null else doc_id, len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                    arrays.append(ids if with_ids else ids[:0])
                    held += len(arrays[-1])
                    if len(rows) == 512 or held > OUT_IDS:
                        yield batch_of(rows, arrays)
                        rows, arrays, held = [], [], 0
                if rows:
                    yield batch_of(rows, arrays)

    return run


def encode_documents(frame: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of each document."""
    path, spark = path or public_tokenizers.path(VOCABULARY), frame.sparkSession
    buckets = min(BUCKETS[1], max(BUCKETS[0], frame.rdd.getNumPartitions()))
    name, place = _bucketed(split_blocks(frame, pattern, CLASSES * buckets, path), buckets)
    blocks = spark.table(name)
    parts = blocks.select("block", F.posexplode("parts").alias("part", "words"))
    encoded = encode_parts(parts, path, buckets).repartition(buckets, "block")  # where the bucketed blocks are
    cells = encoded.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "n", "ids"))).alias("cells"))
    both = blocks.drop("parts").join(cells, "block", "left")
    both = both.join(F.broadcast(nested_tokens(spark, path)), "vocabulary")
    out = scratch(both.mapInArrow(trimmed(_reassemble(with_ids)), ENCODED if with_ids else ENCODED.rpartition(",")[0]), "bpe-encoded")
    spark.sql(f"DROP TABLE {name}")
    drop_path(spark, place)
    return out


def op7_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op7_bpe_encode": op7_bpe_encode}
ORACLE_SQL: dict[str, str] = {}
