"""Token files in canonical length-limited Huffman code.

File format: a folder with two Parquet tables.

* `codebook` (id, length): code length of each id that occurs. Codes are canonical: counted up by (length, id).
* `blocks`, one row per block: part (int), block (long), doc_ids and doc_tokens (whole documents in order), checkpoints (bit offset of
  every CHECKPOINT-th token of the block), n_bits and payload (codes from the highest bit of the first byte on).
  Parts follow each other in ascending doc_id order, and so do the blocks of a part.

A block is decoded without any other one, and a block's checkpoints let its runs of tokens be decoded side by side: one
table lookup per token, for all runs of a batch of blocks at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, text_bytes, written
from .tokens import END_ID, encoder

#: Longest code in bits: the decoding table has 2 ** MAX_BITS entries.
MAX_BITS = 18
#: Tokens between two checkpoints, and tokens from which on a block ends with its document.
CHECKPOINT = 512
BLOCK_TOKENS = 1 << 16
#: Bytes of payload decoded at once.
DECODE_BYTES = 8 << 20
BLOCK_SCHEMA = "part int, block long, doc_ids array<long>, doc_tokens array<long>, checkpoints array<long>, n_bits long, payload binary"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for a count of 0, 1 for a lone symbol.

    A pass pairs the cheapest items into packages and merges them with the symbols again. Only how many symbols each pass
    takes has to be kept, as packages stand in order of cost.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit into {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    is_symbol, packages = [], np.zeros(0)
    for _ in range(limit):
        costs = np.concatenate([weights, packages])
        by_cost = np.argsort(costs, kind="stable")
        is_symbol.append(by_cost < len(weights))
        costs = costs[by_cost]
        packages = costs[0 : len(costs) // 2 * 2 : 2] + costs[1::2][: len(costs) // 2]
    taken = 2 * len(used) - 2
    for marks in reversed(is_symbol):
        symbols = int(marks[:taken].sum())
        lengths[order[:symbols]] += 1
        taken = 2 * (taken - symbols)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code of each symbol, counted up by (length, symbol)."""
    codes, code, last = np.zeros(len(lengths), np.int64), 0, 0
    used = np.flatnonzero(lengths)
    for symbol in used[np.argsort(lengths[used], kind="stable")].tolist():
        code <<= int(lengths[symbol]) - last
        last = int(lengths[symbol])
        codes[symbol] = code
        code += 1
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, int, np.ndarray]:
    """Payload, its number of bits, and the bit offset of every CHECKPOINT-th token."""
    if not len(ids):
        return b"", 0, np.zeros(0, np.int64)
    size = lengths[ids]
    ends = np.cumsum(size)
    starts, total = ends - size, int(ends[-1])
    # each code stands in a 64-bit frame that begins at a 32-bit word; frames that begin at one word are added up
    word = starts >> 5
    frame = codes[ids].astype(np.uint64) << (64 - size - (starts & 31)).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.bitwise_or.reduceat(frame, first)
    words = np.zeros((total + 31) // 32 + 1, np.uint64)
    words[word[first]] |= sums >> np.uint64(32)
    words[word[first] + 1] |= sums & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], total, starts[::CHECKPOINT]


def decoding_table(lengths: np.ndarray, limit: int) -> np.ndarray:
    """For each window of `limit` bits: symbol * 64 + code length."""
    codes, used = canonical_codes(lengths), np.flatnonzero(lengths)
    by_code = used[np.argsort(codes[used] << (limit - lengths[used]), kind="stable")]
    table = np.repeat(by_code * 64 + lengths[by_code], 1 << (limit - lengths[by_code]))
    return np.concatenate([table, np.full((1 << limit) - len(table), 64, np.int64)])


def decode_runs(payload: np.ndarray, offsets: np.ndarray, tokens: np.ndarray, table: np.ndarray, limit: int) -> np.ndarray:
    """Ids of runs: run i has tokens[i] codes from bit offsets[i] on. All runs go forward together, a token at a time."""
    padded = np.concatenate([payload, np.zeros(16, np.uint8)])
    windows = (padded[:-3].astype(np.uint32) << 24) | (padded[1:-2].astype(np.uint32) << 16) | (padded[2:-1].astype(np.uint32) << 8) | padded[3:]
    order = np.argsort(-tokens, kind="stable")  # runs that end early stand last
    place, size = offsets[order].astype(np.int64), tokens[order]
    longest = int(size[0]) if len(size) else 0
    out = np.zeros((longest, len(size)), np.uint32)
    alive = np.searchsorted(-size, -np.arange(longest), side="left")
    shift = 32 - limit
    for step in range(longest):
        n = alive[step]
        at = place[:n]
        found = table[((windows[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(shift)).astype(np.int64)]
        out[step, :n] = found >> 6
        at += found & 63
    inverse = np.argsort(order, kind="stable")
    columns = out.T[inverse]
    return columns[np.arange(longest)[None, :] < tokens[:, None]]


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        end = np.array([end_id], words.dtype).tobytes()
        for batch in batches:
            ids = [found + end for found in words.encode(text_bytes(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // words.dtype.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _counts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            more = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), f"<u{width}"))
            size = max(len(counts), len(more))
            counts = np.pad(counts, (0, size - len(counts))) + np.pad(more, (0, size - len(more)))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["id", "n"])

    return run


def _blocks(width: int, lengths: np.ndarray, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, codes = TaskContext.get().partitionId(), 0, canonical_codes(lengths)

        def row(doc_ids: list, held: list[bytes]) -> pa.RecordBatch:
            payload, bits, checkpoints = pack_bits(np.frombuffer(b"".join(held), f"<u{width}").astype(np.int64), codes, lengths)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([[len(x) // width for x in held]], pa.list_(pa.int64())),
                 pa.array([checkpoints.tolist()], pa.list_(pa.int64())), pa.array([bits], pa.int64()), pa.array([payload], pa.binary())],
                names=["part", "block", "doc_ids", "doc_tokens", "checkpoints", "n_bits", "payload"],
            )

        doc_ids, held, tokens = [], [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids.append(doc_id)
                held.append(ids)
                tokens += len(ids) // width
                if tokens >= block_tokens:
                    yield row(doc_ids, held)
                    doc_ids, held, tokens, block = [], [], 0, block + 1
        if held:
            yield row(doc_ids, held)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, limit: int = MAX_BITS, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode the text of every row, each followed by end_id, into a token folder at path (see the module).

    Ids are counted over all documents before any is coded. Rows go in ascending doc_id order, null first; rows with
    one doc_id in the order of a hash of their ids. A null text is empty, so its row holds end_id alone. An empty table
    gives an empty codebook and no block. Only the code lengths (one per id of the vocabulary) pass through the driver.
    """
    spark = docs.sparkSession
    prepare(spark)
    width = encoder(tokenizer).dtype.itemsize
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ids = written(rows.mapInArrow(_tokenize(tokenizer, end_id), "doc_id long, n_tokens long, ids binary"), "token-ids")
    counted = ids.select("ids").mapInArrow(_counts(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([0, *(r["id"] + 1 for r in counted)]), np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, limit)
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    ordered = ids.select("doc_id", "ids").withColumn("tie", F.xxhash64("ids")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "ids").mapInArrow(_blocks(width, lengths, block_tokens), BLOCK_SCHEMA).write.parquet(f"{path}/blocks")


def _decoded(blocks: list[dict], table: np.ndarray, limit: int) -> Iterator[tuple[dict, np.ndarray]]:
    """Each block with its ids; the runs of all blocks are decoded together."""
    starts = np.cumsum([0] + [len(b["payload"]) for b in blocks])
    tokens, offsets, sizes = [], [], []
    for at, b in zip(starts.tolist(), blocks, strict=False):
        n = int(sum(b["doc_tokens"]))
        sizes.append(n)
        offsets.append(np.array(b["checkpoints"], np.int64) + 8 * at)
        tokens.append(np.minimum(CHECKPOINT, n - CHECKPOINT * np.arange(len(b["checkpoints"]))))
    payload = np.frombuffer(b"".join(b["payload"] for b in blocks), np.uint8)
    ids = decode_runs(payload, np.concatenate(offsets), np.concatenate(tokens), table, limit)
    for b, end, n in zip(blocks, np.cumsum(sizes).tolist(), sizes, strict=True):
        yield b, ids[end - n : end]


def read_tokens(spark: SparkSession, path: str, limit: int = MAX_BITS) -> DataFrame:
    """(doc_id, part, block, start_in_block, n_tokens, ids binary of unsigned 32-bit little-endian ids) of each document of a folder."""
    return _read(spark, path, limit, "ids binary", pa.binary(), lambda ids: ids.astype("<u4").tobytes())


def _read(spark: SparkSession, path: str, limit: int, column: str, kind: pa.DataType, made) -> DataFrame:
    prepare(spark)
    book = spark.read.schema("id long, length int").parquet(f"{path}/codebook").collect()  # as many rows as the vocabulary at most
    lengths = np.zeros(max([1, *(r["id"] + 1 for r in book)]), np.int64)
    for r in book:
        lengths[r["id"]] = r["length"]
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths, limit)
        for batch in batches:
            rows, held, waiting = batch.to_pylist(), 0, []
            for i, row in enumerate(rows):
                waiting.append(row)
                held += len(row["payload"])
                if held < DECODE_BYTES and i + 1 < len(rows):
                    continue
                out = [[], [], [], [], [], []]
                for b, ids in _decoded(waiting, table, limit):
                    at = 0
                    for doc_id, n in zip(b["doc_ids"], b["doc_tokens"], strict=True):
                        for column, value in zip(out, (doc_id, b["part"], b["block"], at, n, made(ids[at : at + n])), strict=True):
                            column.append(value)
                        at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()), pa.array(out[5], kind)],
                    names=["doc_id", "part", "block", "start_in_block", "n_tokens", name],
                )
                held, waiting = 0, []

    schema = f"doc_id long, part int, block long, start_in_block long, n_tokens long, {column}"
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").mapInArrow(run, schema)


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, block_start): ids in all blocks before; summed within parts, and over the totals of the parts."""
    from pyspark.sql import Window

    sizes = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").select(
        "part", "block", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    totals = {r["part"]: r["n"] for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row per written file
    offsets, before = [], 0
    for part in sorted(totals):
        offsets.append((part, before))
        before += totals[part]
    parts = spark.createDataFrame(offsets, "part int, part_start long")
    within = F.sum("n").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    inner = sizes.select("part", "block", F.coalesce(within, F.lit(0)).alias("within"))
    return inner.join(F.broadcast(parts), "part").select("part", "block", (F.col("within") + F.col("part_start")).alias("block_start"))


def digests(spark: SparkSession, path: str, limit: int = MAX_BITS) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of a token folder, from the decoded ids."""
    found = _read(spark, path, limit, "ids_crc32 long", pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))
    start = (F.col("block_start") + F.col("start_in_block")).alias("start")
    return found.join(block_starts(spark, path), ["part", "block"]).select("doc_id", start, "n_tokens", "ids_crc32")
