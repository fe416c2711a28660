"""Fuzzy line deduplication: MinHash over character shingles, verified, one line of each
component kept.

Lines are compared in lower case with single spaces; those shorter than a shingle are alike
only if equal, and blank ones are not compared. A one-permutation MinHash signature,
its empty bins filled from others, is cut into bands; lines that share a band are
candidates, candidates are verified by the exact Jaccard similarity of their shingle sets,
and verified links are joined into components. Band keys travel as packed arrays, a row for
each batch and bucket of keys, so that their exchange costs bytes and not rows.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import by_text, components, discard, free_name, keeps_columns, map_batches, row_key, stored

#: Characters of a shingle, bands, values of a band, and least similarity.
SHINGLE, BANDS, BAND_ROWS, SIMILARITY = 8, 12, 4, 0.8
#: Lines of a block of a large group, lines of a group that is compared set by set, shingles
#: in the sets that a task keeps, cells of the matrix of a larger group, and bytes of line ids
#: up to which they are broadcast.
BLOCK, FEW, KEPT_SHINGLES, MATRIX_CELLS, BROADCAST_BYTES = 2000, 12, 300_000, 2_000_000, 32 << 20
#: Lines of a batch on one key from which the key is hot whatever else it has, (key, line)
#: entries that a task holds before it looks for hot keys, and lines of a hot key that all
#: its lines are compared with before blocks are paired, and times that the lines of a hot
#: key are told apart.
HOT_IN_BATCH, HELD, PIVOTS, LEVELS = 256, 2_000_000, 8, 3

_BINS = BANDS * BAND_ROWS
_EMPTY = np.uint32(0xFFFFFFFF)
_P = np.uint64(0x9E3779B97F4A7C15)


_BLANKS = re.compile(r"[ \t\r\x0b\x0c]+")


def normal_lines(text: str) -> list[str]:
    """The lines of a text in lower case, runs of ASCII blanks being one space."""
    lines = text.lower().split("\n")
    if any(c in text for c in ("  ", "\t", "\r", "\x0b", "\x0c")):
        lines = [_BLANKS.sub(" ", line) for line in lines]
    return [line.strip(" ") for line in lines]


def line_hash(line: str) -> tuple[int, int]:
    """Two 64-bit hashes of a line: the first names it, both together tell lines apart."""
    import xxhash

    return divmod(xxhash.xxh3_128_intdigest(line.encode("utf-8", "replace")), 1 << 64)


def _borrow_order() -> np.ndarray:
    """For each bin, the order in which it looks for a filled one: a fixed permutation."""
    rng = np.random.default_rng(11)
    return np.stack([rng.permutation(_BINS) for _ in range(_BINS)])


_ORDER = _borrow_order()


def shingle_hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hash of the SHINGLE (a power of two) code points from each place on."""
    h, step, p = codes.astype(np.uint64), 1, _P
    with np.errstate(over="ignore"):
        while step < SHINGLE:
            h = h[: len(h) - step] * p + h[step:]
            step, p = 2 * step, p * p
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def line_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of each shingle of lines of at least SHINGLE characters, in their order."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32)
    length = np.array([len(s) for s in lines], np.int64)
    count = length - SHINGLE + 1
    start = np.cumsum(length) - length
    line = np.repeat(np.arange(len(lines)), count)
    place = np.arange(len(line)) + np.repeat(start - (np.cumsum(count) - count), count)
    return line, shingle_hashes(codes)[place]


def band_keys(lines: list[str]) -> np.ndarray:
    """(line, band) keys of lines of at least SHINGLE characters."""
    line, h = line_shingles(lines)
    bin_ = ((h >> np.uint64(40)) * np.uint64(_BINS) >> np.uint64(24)).astype(np.int64)
    signature = np.full(len(lines) * _BINS, _EMPTY, np.uint32)
    np.minimum.at(signature, line * _BINS + bin_, (h & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    signature = signature.reshape(-1, _BINS)
    filled = signature.copy()
    row, col = np.nonzero(signature == _EMPTY)
    for k in range(_BINS):
        if not len(row):
            break
        found = signature[row, _ORDER[col, k]]
        filled[row, col] = found
        row, col = row[found == _EMPTY], col[found == _EMPTY]
    keys = np.full((len(lines), BANDS), np.uint64(0), np.uint64)
    with np.errstate(over="ignore"):
        keys += np.arange(1, BANDS + 1, dtype=np.uint64)
        for r in range(BAND_ROWS):
            keys = (keys ^ filled[:, r::BAND_ROWS].astype(np.uint64)) * _P
            keys ^= keys >> np.uint64(31)
    return keys


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def _packed(part: np.ndarray, *columns: np.ndarray):
    """(part, packed columns) for each value of part, -1 or more."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order], prepend=-2))
    for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(part)]):
        yield int(part[order[a]]), *(c[order[a:z]].tobytes() for c in columns)


def extract_lines(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (id, row, line_no, line, mark) of every line that is not blank, by its hashes, and rows
    (bucket, keys, members): the band keys that fall in a bucket of a batch's lines, and the
    lines they belong to, packed. Entries of keys that are hot in a batch are in bucket -1,
    which goes to no single task; their own bucket has the keys, without members."""
    schema = "id long, row long, line_no int, line long, mark long, bucket int, keys binary, members binary"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(columns):
        rows, new = [], {}
        for doc, row, text in zip(*columns):
            for no, line in enumerate(normal_lines(text or "")):
                if line:
                    h, mark = line_hash(line)
                    rows.append((doc, row, no, h, mark))
                    if len(line) >= SHINGLE:
                        new.setdefault(h, line)
        if not rows:
            return
        *places, hashes, marks = zip(*rows)
        n = len(rows)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, k) for c, k in zip(places, kinds)), *(pa.array(np.array(c, np.uint64).view(np.int64)) for c in (hashes, marks)),
             *(pa.nulls(n, k) for k in kinds[5:])], names=names,
        )
        if not new:
            return
        keys, fresh, at = [], list(new.values()), 0
        while at < len(fresh):  # few enough characters a step for the cache
            to, size = at, 0
            while to < len(fresh) and (size < 150_000 or to == at):
                size += len(fresh[to])
                to += 1
            keys.append(band_keys(fresh[at:to]))
            at = to
        flat = np.concatenate(keys).ravel()
        member = np.repeat(np.fromiter(new, np.uint64, len(new)), BANDS)
        number, back, count = np.unique(flat, return_inverse=True, return_counts=True)
        hot, bucket = number[count >= HOT_IN_BATCH], (flat % np.uint64(buckets)).astype(np.int64)
        bucket[count[back] >= HOT_IN_BATCH] = -1
        packed = list(_packed(bucket, flat, member))
        if len(hot):
            packed += [(b, k, b"") for b, k in _packed((hot % np.uint64(buckets)).astype(np.int64), hot)]
        packed = list(zip(*packed))
        n = len(packed[0])
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(n, k) for k in kinds[:5]), *(pa.array(c, k) for c, k in zip(packed, kinds[5:]))], names=names
        )

    return by_text(docs.select(*row_key(docs), "text"), ["id", "row", "text"], schema, run)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return x ^ (x >> np.uint64(27))


def group_members(keys: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home, unit, line): the lines of each key that two or more lines share.

    A unit is named by its lines, so keys with the same lines are one unit; home is the
    place where it is compared: its least line for small units, so that a line's shingle
    set is made once for several, else the unit itself. A key with more than BLOCK lines
    becomes a unit for every two of its blocks: no unit grows with its key, and every two
    lines meet in one.
    """
    order = np.lexsort((members, keys))
    keys, members = keys[order], members[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (members[1:] != members[:-1])
    keys, members = keys[new], members[new]
    start = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(keys)))
    found = []
    fits = (size > 1) & (size <= BLOCK)
    if fits.any():
        n, first = size[fits], start[fits]
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        line = members[at]
        unit = _mixed(np.add.reduceat(_mixed(line), np.cumsum(n) - n) + n.astype(np.uint64))
        home = np.where(n <= FEW, members[first], unit)
        found.append((np.repeat(home, n), np.repeat(unit, n), line))
    for a, n in zip(start[size > BLOCK].tolist(), size[size > BLOCK].tolist()):
        blocks = [members[a + k : min(a + k + BLOCK, a + n)] for k in range(0, n, BLOCK)]
        for i, x in enumerate(blocks):
            for y in blocks[i + 1 :] or [members[:0]]:
                line = np.concatenate([x, y])
                unit = np.full(len(line), _mixed(np.add.reduce(_mixed(line), keepdims=True) + np.uint64(len(line)))[0])
                found.append((unit, unit, line))
    if not found:
        return members[:0], members[:0], members[:0]
    return tuple(np.concatenate(c) for c in zip(*found))


def split_hot(keys: np.ndarray, members: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries of hot keys, the others, hot keys) of distinct (key, member) entries, as
    pairs of arrays: hot are known keys and those with more than BLOCK members."""
    order = np.lexsort((members, keys))
    keys, members = keys[order], members[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (members[1:] != members[:-1])
    keys, members = keys[new], members[new]
    number, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    known = np.union1d(known, number[count > BLOCK])
    hot = np.isin(number, known)[back]
    return (keys[hot], members[hot]), (keys[~hot], members[~hot]), known


def candidate_units(lines: DataFrame) -> DataFrame:
    """(home, unit, line): the groups of lines that share a band, each once. Rows without
    home are the lines of hot keys, unit being the key: they leave the task as they come."""

    def rows(home, unit, line):
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(unit), pa.int64()) if home is None else pa.array(home.view(np.int64)),
             *(pa.array(c.view(np.int64)) for c in (unit, line))], names=["home", "unit", "line"],
        )

    def run(batches):
        at, held, hot, n, limit = None, [], np.zeros(0, np.uint64), 0, HELD

        def sort_out():
            nonlocal held, hot, n
            keys, members = (np.frombuffer(b"".join(c), np.uint64) for c in zip(*held))
            gone, left, hot = split_hot(keys, members, hot)
            held, n = [tuple(c.tobytes() for c in left)], len(left[0])
            for k in range(0, len(gone[0]), 100_000):
                yield rows(None, *(c[k : k + 100_000] for c in gone))

        def flush():
            yield from sort_out()
            yield rows(*group_members(*(np.frombuffer(c, np.uint64) for c in held[0])))

        for batch in batches:
            for bucket, keys, members in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at:
                    if held:
                        yield from flush()
                    held, hot, n, limit = [], hot[:0], 0, HELD
                at = bucket
                if not members:
                    hot = np.union1d(hot, np.frombuffer(keys, np.uint64))
                    continue
                held.append((keys, members))
                n += len(keys) // 8
                if n > limit:
                    yield from sort_out()
                    limit = max(HELD, 2 * n)
        if held:
            yield from flush()

    def unpack(batches):
        for batch in batches:
            for keys, members in zip(*(c.to_pylist() for c in batch.columns)):
                yield rows(None, np.frombuffer(keys, np.uint64), np.frombuffer(members, np.uint64))

    packed = lines.where("bucket IS NOT NULL").select("bucket", "keys", "members")
    placed = packed.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket")
    schema = "home long, unit long, line long"
    hot = map_batches(packed.where("bucket < 0").select("keys", "members"), unpack, schema)
    return map_batches(placed, run, schema).unionByName(hot).distinct()


def _size_band(n: int) -> int:
    """Sets with numbers of shingles that let them be similar are in one band or in two that
    follow each other (the base leaves room for rounding)."""
    return int(np.log(n) / -np.log(SIMILARITY - 0.001))


def _n_telling(n: int, share: float) -> int:
    """Of n shingles, how many stand first in any order in which one of each `share` of them does."""
    return n - int(np.ceil(share * n - 1e-9)) + 1


def telling(tokens: np.ndarray, common: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, int]:
    """Those of a line's distinct shingle hashes by which it can meet all that are similar, and
    how many of these suffice to meet lines with no fewer shingles.

    Shingles are ordered by how many of some sampled lines have a shingle (common, times), then
    by their hash. Two similar sets have at least 0.8 of the larger and 1.6 / 1.8 of the
    smaller in common, so that the first shingle they share stands in each before which no
    more than the rest can be, and one. Any order is exact; this one makes few meet.
    """
    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    seen = np.where(common[at] == tokens, times[at], 0)
    n, share = len(tokens), 2 * SIMILARITY / (1 + SIMILARITY)
    size, enough = _n_telling(n, SIMILARITY), _n_telling(n, share)
    return tokens[np.lexsort((_mixed(tokens), seen))][:size], enough


def _tokens(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)))


def _tasks(df: DataFrame) -> int:
    """How many tasks compare lines: as many as a shuffle has, however few bytes they read."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _by_key(rows: DataFrame, per_key, names: list[str], kinds: list[pa.DataType], schema: str) -> DataFrame:
    """per_key(pivots)(key, line, text, n, more) for each of rows(key, line, text, n, more, pivots). Lines of
    a key are spread over tasks; in a task they follow each other, so that what per_key makes of
    the pivots is made once."""

    def run(batches):
        at, each = None, None
        for batch in batches:
            out = []
            for key, *row, pivots in zip(*(c.to_pylist() for c in batch.columns)):
                if each is None or key != at:
                    at, each = key, per_key(pivots)
                out.append(each(key, *row))
            columns = zip(*out) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    rows = rows.select("key", "line", "text", "n", "more", "pivots").repartition(_tasks(rows), "key", "line")
    return map_batches(rows.sortWithinPartitions("key"), run, schema)


def _marked(hot: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n, line, band, pivot, rows): each line of a key of n lines with its size band, the first
    of PIVOTS lines of the key that is similar, and how many telling shingles it has. And
    (key, n, pivots), a table to discard."""
    some = [F.min_by("line", F.xxhash64("line", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)]
    chosen = hot.groupBy("key").agg(F.count("*").alias("n"), *some)
    chosen = chosen.select("key", "n", F.explode(F.array_distinct(F.array(*(f"p{i}" for i in range(PIVOTS))))).alias("line"))
    pivots = chosen.join(texts, "line").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("pivots"))
    pivots = stored(pivots, "pivots")
    met = hot.join(texts, "line").join(pivots, "key").withColumn("more", F.lit(None).cast("long"))

    def per_key(pivots):
        sets = [(p["line"], shingles(p["text"])) for p in pivots]

        def mark(key, line, text, n, _):
            own = shingles(text)
            pivot = next((p for p, other in sets if similar(own, other)), None)
            return key, n, line, _size_band(len(own)), pivot, _n_telling(len(own), SIMILARITY)

        return mark

    names = ["key", "n", "line", "band", "pivot", "rows"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return stored(_by_key(met, per_key, names, kinds, "key long, n long, line long, band int, pivot long, rows long"), "marked"), pivots


def _with_tokens(marked: DataFrame, texts: DataFrame, pivots: DataFrame) -> DataFrame:
    """(key, line, pivot, tokens, enough): marked lines with what telling() gives."""
    met = marked.select("key", "line", F.col("pivot").alias("more")).join(texts, "line").join(pivots, "key")

    def per_key(pivots):
        counts = np.unique(np.concatenate([_tokens(p["text"]) for p in pivots]), return_counts=True)

        def tell(key, line, text, _, pivot):
            tokens, enough = telling(_tokens(text), *counts)
            return key, line, pivot, tokens.view(np.int64), enough

        return tell

    names = ["key", "line", "pivot", "tokens", "enough"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32()]
    return stored(_by_key(met, per_key, names, kinds, "key long, line long, pivot long, tokens array<long>, enough int"), "told")


def _linked(links: DataFrame) -> DataFrame:
    """(line, root) of all lines that links(u, v) connect: root is the least line of its component."""
    found = components(links)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "line")


def _in_large_groups(marked: DataFrame, roots: DataFrame) -> DataFrame:
    """marked, pivot being the root of the line's component. Components with less than an eighth of
    a block's lines in a key have none there: they are compared like lines that are alone."""
    with_root = marked.drop("pivot").join(roots, "line", "left")
    large = with_root.where("root IS NOT NULL").groupBy("key", "root").agg(F.count("*").alias("in_key"))
    large = large.where(F.col("in_key") * 8 >= BLOCK).select("key", "root", F.col("root").alias("pivot"))
    return stored(with_root.join(large, ["key", "root"], "left").drop("root"), "marked")


def _by_shingles(marked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(unit, line) of marked lines that share a key and a telling shingle, (key, line) of such
    meetings that are hot themselves, and a table to discard.

    A meeting is needed where a line is present by one of its first `enough` shingles, unless
    all its lines have one pivot. Such lines meet every block of the others.
    """
    met = marked.select("line", "key", "pivot", "enough", F.posexplode("tokens").alias("at", "token"))
    met = met.select("line", "pivot", F.xxhash64("key", "token").alias("key"), (F.col("at") < F.col("enough")).alias("first"))
    sizes = met.groupBy("key").agg(
        F.count("*").alias("n"), F.count_if("first").alias("n_first"), F.count("pivot").alias("n_pivot"),
        F.min("pivot").alias("a"), F.max("pivot").alias("b"),
    )
    needed = (F.col("n") > 1) & (F.col("n_first") > 0) & ((F.col("n_pivot") < F.col("n")) | (F.col("a") != F.col("b")))
    is_hot = (F.col("n_first") > BLOCK).alias("is_hot")
    sizes = stored(sizes.where(needed).select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"), is_hot), "sizes")
    met = met.join(sizes, "key")
    own = F.array(F.pmod(F.xxhash64("line"), "blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    units = met.where("NOT is_hot").select("key", "line", F.explode(F.when(F.col("first"), every).otherwise(own)).alias("block"))
    return units.select(F.xxhash64("key", "block").alias("unit"), "line"), met.where("is_hot").select("key", "line"), sizes


def hot_links(hot: DataFrame, texts: DataFrame, besides: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Links (u, v), and units (home, unit, line, root) still to be compared, of hot(key, line), after the
    other units, if there are any; and the tables to discard after both were read. root names
    what the links connect, in the other units too; it is null where they have no line.

    Each line of a key is compared with PIVOTS of its lines and linked to the first that is
    similar. What these links of all keys connect needs no more comparing among each other.
    Of the rest, blocks of about BLOCK lines are paired, but for those whose sizes differ too
    much. A line names the pairs of its block itself, row by row; no task has a key's list.
    Where a line would be in more pairs of blocks than it has telling shingles, lines meet by
    these instead, which also misses none; meetings that are hot again are treated alike, the
    last of LEVELS times by blocks alone.
    """
    links, units, used = [], [], []
    for level in range(LEVELS):
        last = level + 1 == LEVELS
        first, pivots = _marked(hot, texts)
        links.append(first.where("pivot <> line").select(F.col("line").alias("u"), F.col("pivot").alias("v")))
        roots = stored(_linked(reduce(DataFrame.unionByName, links)), "roots")
        marked = _in_large_groups(first, roots)
        # line ids can be any number, so a line without a pivot has a group of its own kind
        group = F.struct(F.col("pivot").isNull().alias("loose"), F.coalesce("pivot", F.lit(0)).alias("pivot"), "band")
        can_be_told = F.lit(False) if last else F.col("n") >= BLOCK
        grouped = marked.select("key", "line", group.alias("g"), F.when(can_be_told, F.col("rows")).otherwise(0).alias("rows"))
        sizes = grouped.groupBy("key", "g").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.sum("rows").alias("rows"))
        blocks = stored(sizes, "blocks")
        others = blocks.select("key", F.col("g").alias("h"), F.col("blocks").alias("h_blocks"))
        near = (F.abs(F.col("g.band") - F.col("h.band")) <= 1) & (
            F.col("g.loose") | F.col("h.loose") | (F.col("g.pivot") != F.col("h.pivot"))
        )
        pairs = stored(blocks.join(others, "key").where(near), "blocks")
        used += [first, pivots, roots, marked, blocks, pairs]
        dear = pairs.groupBy("key").agg(F.sum(F.col("blocks") * F.col("h_blocks")).alias("pairs"))
        rows = blocks.groupBy("key").agg(F.sum("rows").alias("rows")).where("rows > 0")
        dear = stored(dear.join(rows, "key").where(F.col("pairs") * BLOCK > F.col("rows")).select("key"), "dear")
        used.append(dear)
        few = last or dear.isEmpty()
        own = F.struct("g", F.pmod(F.xxhash64("line"), "blocks").alias("block"))
        units.append(
            grouped.join(pairs if few else pairs.join(dear, "key", "left_anti"), ["key", "g"])
            .select("key", "line", "h", own.alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("h_blocks") - 1)).alias("k"))
            .withColumn("y", F.struct(F.col("h").alias("g"), F.col("k").alias("block")))
            .select(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")).alias("unit"), "line")
        )
        if few:
            break
        told = _with_tokens(marked.join(dear, "key"), texts, pivots)
        met, again, table = _by_shingles(told)
        units.append(met)
        used += [told, table]
        if table.where("is_hot").isEmpty():
            break
        hot = stored(again, "hot")
        used.append(hot)
    links, units = (reduce(DataFrame.unionByName, part) for part in (links, units))
    units = units.select(F.col("unit").alias("home"), "unit", "line")
    units = units if besides is None else besides.unionByName(units)
    return links, units.join(roots, "line", "left").select("home", "unit", "line", "root"), used


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, text) of wanted(line, id, row, line_no): the documents that hold them are read
    again. What is wanted is broadcast where its bytes were counted to be few, and joined
    otherwise."""
    by_doc = wanted.groupBy("id", "row").agg(F.collect_list(F.struct("line_no", "line")).alias("wanted"))
    by_doc = stored(by_doc, "wanted")
    few = by_doc.select(F.coalesce(F.sum(64 + 32 * F.size("wanted")), F.lit(0))).first()[0] <= BROADCAST_BYTES
    found = docs.select(*row_key(docs), "text").join(F.broadcast(by_doc) if few else by_doc, ["id", "row"])

    def run(columns):
        texts, lists = columns
        out = {}
        for text, some in zip(texts, lists):
            split = normal_lines(text or "")
            for w in some:
                if w["line_no"] < len(split) and line_hash(split[w["line_no"]])[0] == w["line"] % (1 << 64):
                    out[w["line"]] = split[w["line_no"]]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.string())], names=["line", "text"]
            )

    return by_text(found, ["text", "wanted"], "line long, text string", run).dropDuplicates(["line"])


def similar(a: set[str], b: set[str]) -> bool:
    """Whether two shingle sets have at least SIMILARITY of their union in common."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= SIMILARITY * (len(a) + len(b) - both)


def _reach(n: int, near, group: np.ndarray | None = None, one_near=None, order: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what near(one, others) connects among n members, those of one group
    being connected already: from each member reached, only those not yet reached are looked
    at. Where fewer are left than are to be looked from, each of them looks for any of these
    instead (one_near, which may stop at the first), so that the many lines of a large component
    are not gone through for the few beside it. order: of the members, those first that may reach most."""
    left, links, one_near = np.arange(n) if order is None else order, [], one_near or near
    with_group = lambda hit: hit if group is None or not hit.any() else np.isin(group[left], group[left[hit]])
    while len(left) > 1:
        taken = with_group(left == left[0])
        todo, left = left[taken].tolist(), left[~taken]
        while todo and len(left):
            if len(left) < len(todo):
                others, hit = np.array(todo), np.zeros(len(left), bool)
                for i, k in enumerate(left.tolist()):
                    if len(found := others[one_near(k, others)]):
                        hit[i] = True
                        links.append((int(found[0]), k))
                todo = []
            else:
                one = todo.pop(0)
                hit = near(one, left)
                links += [(one, k) for k in left[hit].tolist()]
            taken = with_group(hit)
            todo, left = todo + left[taken].tolist(), left[~taken]
    return links


def unit_links(texts: list[str], sets: list[set[str]] | None = None, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among the lines of a unit, of which those of one group are connected already. Few
    lines are compared by their sets, more by a matrix of the shingles, known by 64-bit hashes, that
    two or more of them have. Where that is large, lines are looked up by their telling shingles,
    in an order by how often these stand in the unit, so that lines of a template that are unlike
    each other hardly meet; those that meet are compared by all their shingles at once."""
    n = len(texts)
    if n <= FEW:
        sets = sets or [shingles(t) for t in texts]
        return _reach(n, lambda one, left: np.array([similar(sets[one], sets[k]) for k in left.tolist()], bool), group)
    line, h = line_shingles(texts)
    number, flat = np.unique(h, return_inverse=True)
    times = np.bincount(flat)
    by_times = np.argsort(times, kind="stable")
    rarity = np.empty(len(number), np.int64)
    rarity[by_times] = np.arange(len(number))
    # shingles are numbered by how often they stand, so that each line has its rare ones first
    both = np.sort(line * len(number) + rarity[flat])
    line, flat = np.divmod(both[np.diff(both, prepend=-1) > 0], len(number))
    times = times[by_times]
    size, shared = np.bincount(line, minlength=n), times > 1
    order = np.argsort(-np.bincount(line, times[flat], n) / size, kind="stable")  # lines of common shingles first
    start, width = np.cumsum(size) - size, int(shared.sum())
    if n * width <= MATRIX_CELLS:
        has, in_many = np.zeros((n, width), np.float32), shared[flat]
        has[line[in_many], (np.cumsum(shared) - 1)[flat[in_many]]] = 1

        def close(one, left):
            both = (has[left] @ has[one]).astype(np.int64)  # sums of small whole numbers are exact
            return both >= SIMILARITY * (size[left] + size[one] - both)

        return _reach(n, close, group, order=order)
    rank = np.arange(len(flat)) - np.repeat(start, size)
    need = size - np.ceil(SIMILARITY * size - 1e-9).astype(np.int64) + 1
    first = np.flatnonzero(rank < np.repeat(need, size))  # in order of lines
    own = np.split(flat[first], np.cumsum(need)[:-1])
    by_shingle = first[np.argsort(flat[first], kind="stable")]
    ends = np.searchsorted(flat[by_shingle], np.arange(len(number) + 1))
    having, seen = line[by_shingle], np.zeros(len(number), bool)

    def near(one, left, any_will_do=False):
        meets, hit = np.zeros(n, bool), np.zeros(n, bool)
        for t in own[one].tolist():
            meets[having[ends[t] : ends[t + 1]]] = True
        met = left[meets[left]]
        step = 50 if any_will_do else 500
        for at in range(0, len(met), step):
            some = met[at : at + step]
            seen[flat[start[one] : start[one] + size[one]]] = True
            length = size[some]
            place = np.repeat(start[some] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            both = np.add.reduceat(seen[flat[place]].astype(np.int64), np.cumsum(length) - length)
            hit[some] = both >= SIMILARITY * (length + size[one] - both)
            if any_will_do and hit[some].any():
                break
        seen[flat[start[one] : start[one] + size[one]]] = False
        return hit[left]

    return _reach(n, near, group, lambda one, left: near(one, left, True), order)


def line_links(docs: DataFrame, lines: DataFrame, classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(u, v): links that connect all lines that share a band and are similar; and the tables
    to discard after they were read.

    Only lines in a unit have their texts looked up. A unit is compared by one task; it
    gives fewer links than it has lines.
    """
    found = stored(candidate_units(lines), "units")
    units, hot = found.where("home IS NOT NULL"), found.where("home IS NULL").select(F.col("unit").alias("key"), "line")
    ids = found.select("line").distinct()
    texts = stored(texts_of(docs, ids.join(classes, "line").select("line", "first.id", "first.row", "first.line_no")), "texts")
    links, used = None, [found, texts]
    if hot.isEmpty():
        units = units.withColumn("root", F.lit(None).cast("long"))
    else:
        links, units, tables = hot_links(hot, texts, units)
        used += tables

    def run(batches):
        at, ids, held, roots, kept, size = None, [], [], [], {}, 0

        def flush():
            nonlocal size
            sets = None
            if len(ids) <= FEW:
                if size > KEPT_SHINGLES:
                    kept.clear()
                    size = 0
                for i, t in zip(ids, held):
                    if i not in kept:
                        kept[i] = shingles(t)
                        size += len(kept[i])
                sets = [kept[i] for i in ids]
            group = None
            if any(r is not None for r in roots):  # a line without root is alone, whatever its number
                number = {}
                group = np.array([number.setdefault((r is None, k if r is None else r), len(number)) for k, r in enumerate(roots)])
                if len(number) == 1:
                    return []
            return [(ids[a], ids[b]) for a, b in unit_links(held, sets, group)]

        for batch in batches:
            found = []
            for unit, line, text, root in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                if unit != at:
                    if len(ids) > 1:
                        found += flush()
                    at, ids, held, roots = unit, [], [], []
                ids.append(line)
                held.append(text)
                roots.append(root)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["u", "v"])
        if len(ids) > 1 and (found := flush()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["u", "v"])

    placed = units.join(texts, "line").select("home", "unit", "line", "text", "root").repartition(_tasks(docs), "home")
    compared = map_batches(placed.sortWithinPartitions("home", "unit", "line"), run, "u long, v long")
    return compared if links is None else compared.unionByName(links), used


def going(lines: DataFrame, keep: DataFrame) -> DataFrame:
    """(id, row, line_no) of lines(id, row, line_no, line, mark) for which keep(line, own, mixed,
    keep) has another place. Of lines named alike by accident (mixed), those marked as own are
    meant; others are alike only where their marks are, too."""
    place, named = F.struct("id", "row", "line_no"), lines.join(keep, "line")
    gone = named.where((place != F.col("keep")) & (F.col("mark") == F.col("own")))
    others = lines.join(keep.where("mixed").select("line", "own"), "line").where("mark <> own")
    least = others.groupBy("line", "mark").agg(F.min(place).alias("keep"))
    again = others.join(least, ["line", "mark"]).where(place != F.col("keep"))
    return gone.select("id", "row", "line_no").unionByName(again.select("id", "row", "line_no"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(id, row, removed): the sorted numbers, from 0, of the lines that go from a row, which
    row_key names.

    Of each component the line with the least (id, row, line number) stays. Rows with equal
    ids and texts are one row, met several times. Lines are equal if 128 bits of their hashes are;
    should two unlike lines have the first 64 in common, one takes part in the fuzzy
    comparison and the other loses its equal copies only.
    """
    # a few buckets for each shuffle partition, so that a task holds a bucket at a time
    buckets = 4 * _tasks(docs)
    both = stored(extract_lines(docs, buckets), "lines")
    lines = both.where("line IS NOT NULL").select("id", "row", "line_no", "line", "mark")
    first = F.min(F.struct("id", "row", "line_no", "mark")).alias("first")
    mixed = (F.min("mark") != F.max("mark")).alias("mixed")
    classes = stored(lines.groupBy("line").agg(first, F.count("*").alias("n"), mixed), "classes")
    links, used = line_links(docs, both, classes)
    found = components(links)
    discard(*used)
    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "line")
    some = stored(classes.join(members, "line", "left").where("root IS NOT NULL OR n > 1"), "repeated")
    linked, alone = some.where("root IS NOT NULL"), some.where("root IS NULL")
    # written out, like what is joined next: a join of plain shuffles, whose hot partitions Spark splits
    of_first = F.struct("first.id", "first.row", "first.line_no")
    kept = stored(linked.groupBy("root").agg(F.min(of_first).alias("keep")), "kept")
    named = ("line", F.col("first.mark").alias("own"), "mixed")
    keep = linked.join(kept, "root").select(*named, "keep").unionByName(alone.select(*named, of_first.alias("keep")))
    keep = stored(keep, "keep")
    gone = going(lines, keep)
    out = stored(gone.groupBy("id", "row").agg(F.array_sort(F.collect_set("line_no")).alias("removed")), "removed")
    discard(both, classes, some, kept, keep)
    return out


def dedup_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) for every row of docs(doc_id, text).

    removed: line numbers from 0, comma-joined. A null text has no lines, an empty one has one
    empty line; blank lines always stay. Rows with one id and different texts are compared
    like any others, rows with equal ids and texts count as one row and come back as given,
    rows without id come after all others; an empty table gives none; other columns are not
    read.
    """
    n_lines = F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    gone = removed_lines(docs)
    return (
        docs.select(F.col("doc_id").cast("long"), n_lines.cast("long").alias("n_lines"), *row_key(docs))
        .join(gone, ["id", "row"], "left")
        .select(
            "doc_id",
            "n_lines",
            F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
            F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed"),
        )
    )


@keeps_columns
def without_repeats(docs: DataFrame) -> DataFrame:
    """docs without the lines that go; a document that loses all its text goes too.

    All columns are kept; n_chars, where there is one, follows the text. Ids may repeat or be
    null, as in dedup_report: no line goes that is not found in a line that stays. Null and
    blank texts stay as they are; an empty table gives none.
    """
    names, schema = docs.columns, docs.schema
    text_at = names.index("text")
    key = {c: free_name(docs, c) for c in ("id", "row", "removed")}
    gone = removed_lines(docs).withColumnsRenamed(key)
    keyed = docs.select("*", *(c.alias(key[n]) for n, c in zip(("id", "row"), row_key(docs))))
    joined = keyed.join(gone, [key["id"], key["row"]], "left").select(*names, key["removed"])

    def run(batches):
        for batch in batches:
            texts, gone, keep = batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist(), []
            for i, some in enumerate(gone):
                if some:
                    out = set(some)
                    texts[i] = "\n".join(s for k, s in enumerate(texts[i].split("\n")) if k not in out)
                keep.append(not some or bool(texts[i].strip()))
            columns = list(batch.columns[:-1])
            columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    out = map_batches(joined, run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out
