"""Shared pieces of the text operators: saved tables, Arrow batches of text as numpy arrays, rolling hashes, components.

Texts travel in Arrow batches and are handled in slices of about ``SLICE`` bytes, so that the memory of a task depends
on the slice and on its longest single text, not on the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ids import with_row_number
from ..tables import release, saved, shared_dir  # noqa: F401

SLICE = 1 << 20
U64 = np.uint64
_MASK = (1 << 64) - 1


# ---- tables and columns ----------------------------------------------------------------------------------------------


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Up to so many ids (8 MB) are broadcast.
FEW_IDS = 1_000_000


def anti_join(df: DataFrame, ids: DataFrame, on: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id is not among ``ids``; nothing is shuffled where the ids are counted to be few."""
    few = ids.limit(FEW_IDS + 1).count() <= FEW_IDS
    return df.join(F.broadcast(ids) if few else ids, on, "left_anti").select(*df.columns)


def with_own_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, text, own_id): ``docs`` with doc_ids that tell rows of different texts apart, and in own_id those they have.

    Where ids repeat or are missing, which narrow counts tell, rows are numbered anew in the order of their ids, missing ones
    first, then of a hash of their texts; rows that agree in both share a number. Else the ids stay.
    """
    rows = docs.select("doc_id", "text", F.col("doc_id").alias("own_id"))
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count():
        return rows
    pairs = docs.select(F.col("doc_id").alias("_own"), F.md5(F.coalesce("text", F.lit(""))).alias("_md5")).distinct()
    numbers = with_row_number(pairs, [F.asc_nulls_first("_own"), "_md5"], "_number")
    same = F.col("doc_id").eqNullSafe(F.col("_own")) & (F.md5(F.coalesce("text", F.lit(""))) == F.col("_md5"))
    return saved(rows.join(numbers, same).select(F.col("_number").alias("doc_id"), "text", "own_id"))


# ---- text as arrays --------------------------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows (one more than rows). A null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together; a longer row makes a range of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def text_slices(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each slice of a batch."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(name)))
    for a, b in slices(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Powers:
    """base**i and its inverse modulo 2**64, for i from 0 on, as far as they have been asked for."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U64), np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.base, -k, 1 << 64))])
        return self.up, self.down


_POWERS: dict[int, _Powers] = {}
#: Odd multipliers for independent rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Hashes of any ranges of a sequence of small integers or 64-bit words, in constant time each."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        self.powers = _POWERS.setdefault(base, _Powers(base))
        up, self.down = self.powers.upto(len(values) + 1)
        self.sums = np.empty(len(values) + 1, U64)
        self.sums[0] = 0
        np.cumsum((values.astype(U64) + U64(1)) * up[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end) of each pair; equal contents hash alike wherever they stand."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all windows of k values."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U64)


#: What parts words where punctuation doesn't count: ASCII but letters and digits.
NOT_ALNUM = np.arange(256) < 128
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def words(
    data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes that are not ``between``; by default ``[^\\x20\\x09-\\x0D]+``) of all rows.

    Byte starts, byte ends, offsets of the rows in words, 64-bit hashes.
    """
    if lower:
        data = _LOWER[data]
    ink = ~between[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = ink[inner]
    last[inner - 1] = ink[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets), Rolling(data)(starts, ends)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` of a function that turns one batch into dicts of columns, one dict for each batch it returns."""
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in function(batch):
                yield as_batch(columns, target)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        values = columns[field.name]
        arrays.append(values.cast(field.type) if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def key_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by the keys. Only the group that goes on is held back."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        last = [batch.column(batch.schema.get_field_index(k))[-1] for k in keys]
        table = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(table.num_rows, bool)
        for k, v in zip(keys, last, strict=True):
            import pyarrow.compute as pc

            same &= np.asarray(pc.fill_null(pc.equal(table[k], v), v.as_py() is None))
        cut = int(np.argmax(same))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        count = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def packed(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, packed, ...): the texts as zstandard frames, which is what travels where whole texts are shuffled."""
    kinds = dict(docs.dtypes)

    def pack(batch: pa.RecordBatch) -> Iterator[dict]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        texts = batch.column(1).cast(pa.large_binary())
        for a in range(0, batch.num_rows, 1000):
            part = [None if x is None else squeeze.compress(x) for x in texts.slice(a, 1000).to_pylist()]
            yield {"doc_id": batch.column(0).slice(a, 1000), "packed": part, **{c: batch.column(2 + i).slice(a, 1000) for i, c in enumerate(more)}}

    return map_arrow(docs.select("doc_id", "text", *more), pack, ", ".join(["doc_id long, packed binary", *[f"{c} {kinds[c]}" for c in more]]))


def unpack(values: list[bytes | None]) -> list[bytes]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return [b"" if x is None else d.decompress(x) for x in values]


def joined_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


# ---- connected components --------------------------------------------------------------------------------------------


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of each node of the edges (a, b): the smallest id that is reachable by edges.

    Alternates the large-star and small-star steps: every node points its neighbours at the smallest id that it knows.
    The work of a round is proportional to the edges; a hub's minimum is pre-aggregated before the shuffle.
    """
    e = saved(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    before = None
    for _ in range(max_rounds):
        last = e
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        e = saved(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        release(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
