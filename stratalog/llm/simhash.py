"""Near-duplicate documents: SimHash fingerprints joined by Golay-code fuzzy keys."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.common import (
    by_text, components, counted, discard, free_name, in_few_parts, keeps_columns, map_batches, row_key, stored,
)

#: Words of a shingle, hash seed, and differing bits up to which fingerprints link.
SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Fingerprints of a bucket above which it is searched by a further byte, and buckets to which a
#: fingerprint goes, about.
LARGE_BUCKET, BUCKETS = 4096, 21

# Fixed value: a generator polynomial of the binary (23, 12, 7) Golay code.
_GENERATOR = 0b101011100011

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_OFFSET = 256 * np.arange(8)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text: bit set where it is set in over half of the shingle hashes."""
    import xxhash

    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)))) if len(w) >= SHINGLE else [b" ".join(w)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _OFFSET).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: list | None = None) -> DataFrame:
    """(doc_id, fp), or the given long columns in place of doc_id: fp is the fingerprint as a
    signed long."""
    keyed = docs.select(*(key or [F.col("doc_id").cast("long")]), "text")
    names = keyed.columns[:-1]

    def run(columns):
        fps = np.array([fingerprint(t) for t in columns[-1]], np.uint64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(fps)], names=[*names, "fp"])

    return by_text(keyed, keyed.columns, ", ".join(f"{n} long" for n in (*names, "fp")), run)


def _nearest_codeword() -> np.ndarray:
    """Index of the codeword nearest to each 16-bit segment, taken as a 23-bit word.

    The code is perfect: each of the 2048 syndromes belongs to one error of at most three
    bits. Any twelve bits in a row tell codewords apart; the top ones are the index.
    """

    def syndrome(word: np.ndarray) -> np.ndarray:
        word = word.copy()
        for bit in range(22, 10, -1):
            word ^= np.where(word >> bit & 1, _GENERATOR << (bit - 11), 0)
        return word

    errors = np.array([sum(1 << b for b in c) for n in range(4) for c in combinations(range(23), n)])
    leader = np.zeros(2048, np.int64)
    leader[syndrome(errors)] = errors
    word = np.arange(1 << 16)
    return (word ^ leader[syndrome(word)]) >> 11


def _neighbour_keys() -> tuple[np.ndarray, np.ndarray]:
    """(start, keys): the codeword indices of each segment and of all segments one bit away.

    Two segments that differ in at most one bit share a key: the index of either is among
    those of the other.
    """
    nearest = _nearest_codeword()
    flips = np.array([0, *(1 << b for b in range(16))])
    near = np.sort(nearest[np.arange(1 << 16)[:, None] ^ flips], axis=1)
    new = np.concatenate([np.ones((1 << 16, 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
    return np.concatenate([[0], np.cumsum(new.sum(1))]), near[new]


_start, _keys = _neighbour_keys()


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fps, key): several keys for each 64-bit fingerprint.

    Of four segments with at most three differing bits in all, going round there is one
    without a difference whose successor has at most one. So a key is the place and value
    of a segment and a codeword index of the next one.
    """
    segments = np.stack([(fps >> np.uint64(48 - 16 * i)).astype(np.int64) & 0xFFFF for i in range(4)])
    rows, keys = [], []
    for i in range(4):
        exact, fuzzy = segments[i], segments[(i + 1) % 4]
        n = _start[fuzzy + 1] - _start[fuzzy]
        row = np.repeat(np.arange(len(fps)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        rows.append(row)
        keys.append((i << 28) | (exact[row] << 12) | _keys[_start[fuzzy[row]] + within])
    return np.concatenate(rows), np.concatenate(keys)


def spanning_links(members: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect what links of at most distance bits connect among members.

    A search from each member not yet reached compares with those still unreached only: a
    group of near copies costs about its size, and yields fewer links than it has members.
    """
    left, links = members, []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            near = np.bitwise_count(left ^ one) <= distance
            if near.any():
                reached = left[near]
                left = left[~near]
                links += zip(repeat(one), reached)
                todo += list(reached)
    return links


def bucket_links(key: int, members: np.ndarray) -> list[tuple[int, int]]:
    """spanning_links of the members of a bucket. Of the four bytes outside the two segments
    of its key at least one is equal in fingerprints that link, so a large bucket is searched
    by the values of each of them."""
    if len(members) <= LARGE_BUCKET:
        return spanning_links(members)
    place, found = (key >> 28) & 3, []
    for i in ((place + 2) % 4, (place + 3) % 4):
        for shift in (48 - 16 * i, 56 - 16 * i):
            value = (members >> np.uint64(shift)).astype(np.uint8)
            order = np.argsort(value, kind="stable")
            for part in np.split(members[order], np.flatnonzero(np.diff(value[order])) + 1):
                found += spanning_links(part)
    return found


def links(fps: DataFrame, rows: int) -> DataFrame:
    """(u, v) fingerprints, both of fps(fp) (distinct, rows of them), whose links connect all
    that differ in at most three bits.

    Each fingerprint goes to about 21 buckets. A bucket is read in key order and holds
    distinct fingerprints only, so copies of a text never add to it.
    """

    def expand(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            row, key = fuzzy_keys(fp.view(np.uint64))
            for at in range(0, len(row), 500_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[at : at + 500_000]), pa.array(fp[row[at : at + 500_000]])], names=["key", "fp"]
                )

    def connect(batches):
        last, rest = None, []

        def flush():
            found = bucket_links(int(last), np.concatenate(rest).view(np.uint64)) if rest else []
            u = np.array([a for a, _ in found], np.uint64).astype(np.int64)
            v = np.array([b for _, b in found], np.uint64).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            bounds = [0, *cut.tolist(), len(key)]
            if len(key) and key[0] != last:
                yield flush()
                rest = []
            found = []
            # buckets that begin and end inside this batch; only those with company matter
            for a, b in zip(bounds[1:-1], bounds[2:-1]):
                if b - a > 1:
                    found += bucket_links(int(key[a]), fp[a:b].view(np.uint64))
            if len(bounds) > 2:
                last = key[0]
                rest.append(fp[: bounds[1]])
                yield flush()
                rest = [fp[bounds[-2] :]]
            elif len(key):
                rest.append(fp)
            last = key[-1] if len(key) else last
            if found:
                u, v = (np.array(x, np.uint64).astype(np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        yield flush()

    keyed = map_batches(fps.select("fp"), expand, "key long, fp long")
    buckets = in_few_parts(keyed.repartition("key"), BUCKETS * rows).sortWithinPartitions("key")
    return map_batches(buckets, connect, "u long, v long")


def component_labels(prints: DataFrame, key: str = "doc_id", rows: int | None = None) -> DataFrame:
    """(fp, component_id) of prints(key, fp), stored: the least key that links reach. rows: how
    many prints has, if known."""
    least = prints.groupBy("fp").agg(F.min(key).alias("least"))
    least, seen = counted(least if rows is None else in_few_parts(least, rows), "fingerprints")
    rows = seen["rows"]
    found = components(links(least, rows))
    of = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).join(least, F.col("node") == F.col("fp"))
    of = stored(in_few_parts(of.select("root", "fp", "least"), rows), "linked")
    # written out, so that the join meets plain shuffles, whose hot partitions Spark splits
    roots = stored(in_few_parts(of.groupBy("root").agg(F.min("least").alias("component_id")), rows), "roots")
    alone = least.join(of, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    out = stored(in_few_parts(of.join(roots, "root").select("fp", "component_id").unionByName(alone), rows), "labels")
    discard(least, of, roots)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    Null, empty and blank texts have fingerprint zero and link like others. Repeated rows
    come back as given; rows without doc_id too, and a component of such rows only has no
    id. An empty table gives none; other columns are not read.
    """
    prints, seen = counted(fingerprints(docs), "prints")
    labels = component_labels(prints, rows=seen["rows"])
    return in_few_parts(prints.join(labels, "fp"), seen["rows"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@keeps_columns
def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that with the least doc_id and then the least hash
    of id and text; of rows equal in both, that whose columns have the least hash.

    Rows are told apart by id and text, so that unlike texts under one id are judged each for
    itself. Rows without id come after all others. Null, empty and blank texts are alike. All
    columns are kept; an empty table gives none.
    """
    prints, seen = counted(fingerprints(docs, row_key(docs)).withColumn("place", F.struct("id", "row")), "prints")
    labels = component_labels(prints, "place", seen["rows"])
    key = {c: free_name(docs, c) for c in ("id", "row", "nth")}
    kept = labels.select(F.col("component_id.id").alias(key["id"]), F.col("component_id.row").alias(key["row"])).distinct()
    keyed = docs.select("*", *(c.alias(key[n]) for n, c in zip(("id", "row"), row_key(docs))))
    named = keyed.join(kept, [key["id"], key["row"]], "left_semi")
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = Window.partitionBy(key["id"], key["row"]).orderBy(F.xxhash64(*plain))
    once = named.withColumn(key["nth"], F.row_number().over(order))
    discard(prints)
    return once.where(F.col(key["nth"]) == 1).select(*docs.columns)
