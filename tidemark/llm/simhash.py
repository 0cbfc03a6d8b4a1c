"""SimHash near-duplicates: Golay-code keys for 64-bit fingerprints, joined and verified."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.ship import ship

from .common import cut, join_groups, map_text
from .components import components

SEED = 42
#: Fixed value: the generator polynomial of the (23, 12) Golay code.
GOLAY = 0b101011100011
#: Lowest bit and width of the three segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """Unsigned 64-bit SimHash: bit b is 1 if it is set in over half the hashes of the text's
    word shingles, repeats included. Fewer words than ``size`` make one shingle, none make 0."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    h, join = xxhash.xxh64_intdigest, b" ".join
    return majority(np.array([h(join(s), SEED) for s in zip(*(words[i:] for i in range(size)))], "<u8"))  # noqa: B905


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the unsigned 64-bit hashes; none have none."""
    hashes = np.ascontiguousarray(hashes, "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * counts > len(hashes)).astype(object)).sum()) if (2 * counts > len(hashes)).any() else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None, size: int = 3) -> DataFrame:
    """Add fp (long, the 64 bits as a signed number) for every whole text; null counts as empty."""

    def make():
        return lambda texts: [[_signed(fingerprint(t, size)) for t in texts]]

    return map_text(df, text, [T.StructField("fp", T.LongType())], make, keep)


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(remainder of each message, error pattern of each syndrome, steps from each syndrome's
    nearest codeword index to all indices of codewords at distance 4 or less, padded with it)."""
    rem = np.zeros(4096, np.int64)
    for m in range(4096):
        x = m << 11
        for b in range(22, 10, -1):
            if x >> b & 1:
                x ^= GOLAY << (b - 11)
        rem[m] = x
    words = np.arange(4096) << 11 | rem
    error = np.zeros(2048, np.int64)
    syndrome = lambda x: rem[x >> 11] ^ (x & 2047)
    for t in range(4):
        for bits in combinations(range(23), t):
            e = sum(1 << b for b in bits)
            error[syndrome(e)] = e
    sevens = words[np.bitwise_count(words) == 7]
    near = np.zeros((2048, 6), np.int64)
    for s, e in enumerate(error):
        if int(e).bit_count() == 3:
            near[s, 1:] = sevens[sevens & e == e] >> 11
    return rem, error, near


def golay_keys(seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest codeword, the up to 6 indices within distance 4, padded by the
    nearest) of 23-bit words. Words that differ in one bit or none: the nearest of either is
    among the indices of the other, as it is at most 3 + 1 away."""
    rem, error, near = golay()
    syn = rem[seg >> 11] ^ (seg & 2047)
    own = (seg ^ error[syn]) >> 11
    return own, own[:, None] ^ near[syn]


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key) of what is indexed and (row, key) of what is looked up.

    Fingerprints at 3 bits or fewer have either a segment alike and another that differs in at
    most one bit, or one bit of difference in each of the three segments. The first have a key of
    the segment alike and a codeword of the other in common, for one of the six ordered pairs; the
    others a codeword of the first segment and those halves of the second and third that are alike.
    """
    x = fps.view(np.uint64)
    seg = [((x >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    code = [golay_keys(s) for s in seg]
    rows = np.arange(len(x))
    index, probe = [], []
    for tag, (i, j) in enumerate(permutations(range(3), 2)):
        base = tag << 50 | seg[i] << 12
        index.append(base | code[j][0])
        probe.append(base[:, None] | code[j][1])
    half = lambda s, h: s & 2047 if h == 0 else s >> 11
    for tag in range(4):
        base = (6 + tag) << 50 | half(seg[1], tag & 1) << 23 | half(seg[2], tag >> 1) << 12
        index.append(base | code[0][0])
        probe.append(base[:, None] | code[0][1])
    row = np.repeat(rows, 6)
    found, sought = np.stack(index, 1), np.stack(probe, 1).reshape(len(x), -1, 6)
    new = np.ones(sought.shape, bool)
    new[:, :, 1:] = sought[:, :, 1:] != sought[:, :, :1]
    row = np.broadcast_to(rows[:, None, None], sought.shape)
    return np.repeat(rows, found.shape[1]), found.reshape(-1), row[new], sought[new]


def links(distinct: DataFrame, most: int = 3) -> DataFrame:
    """(a, b) with a < b: all pairs of the distinct longs in fp at ``most`` (3 at most) bits or
    fewer; a pair may come more than once."""
    if most > 3:
        raise ValueError("the segments hold for at most 3 differing bits")
    ship(distinct.sparkSession)

    def run(batches, which):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 2000):
                some = np.ascontiguousarray(fps[at : at + 2000])
                row, key = keys(some)[2 * which : 2 * which + 2]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some[row])], names=["key", "fp"])

    schema = "key long, fp long"
    index = distinct.select("fp").mapInArrow(lambda b: run(b, 0), schema).withColumnRenamed("fp", "x")
    probe = distinct.select("fp").mapInArrow(lambda b: run(b, 1), schema).withColumnRenamed("fp", "y")
    apart = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    # Merged: Spark takes either for about as large as the fingerprints, of which they have 10 and up
    # to 60 rows each, and would gather and send a side that grows with the data.
    pairs = index.join(probe.hint("merge"), "key").filter((F.col("x") != F.col("y")) & (apart <= most))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row.

    Rows link if their fingerprints differ in ``most`` bits or fewer; component_id is the smallest
    doc_id reachable. Null and empty texts have fingerprint 0, linked like any other; rows with a
    null id link others but name no component, which is null if no row of it has an id; repeated
    rows stay; no rows give no rows.
    """
    each = cut(fingerprints(df, text, [doc_id]).select(F.col(f"`{doc_id}`").alias("doc_id"), "fp"), "fp")
    distinct = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")), "distinct")
    joined = components(links(distinct, most)).withColumnRenamed("id", "fp").withColumnRenamed("component_id", "group")
    known = distinct.join(joined, "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    named = known.groupBy("group").agg(F.min("least").alias("component_id"))
    groups = cut(known.select("fp", "times", "group").join(named, "group").select("fp", "times", "component_id"), "groups")
    return join_groups(each, groups, ["fp"], ["doc_id"]).select("doc_id", "fp", "component_id")


def hex16(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
