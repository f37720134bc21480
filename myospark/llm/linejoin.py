"""Line deduplication by an exact set-similarity join (Xiao et al., 2008).

A line is the set of its words (A-Z in lower case, runs of other than ASCII white space), known by 48 bits of hash beside
their rarity. Words are ordered by rarity over all lines: by the counts of their hash buckets, which all tasks know, and
words that are nowhere else are in no list. Two sets with a Jaccard similarity of 4/5 or more share a word among the first
n - ceil(4n/5) + 1 of each; so lines meet in the lists of those words, where length and positional filters and a bound on
the symmetric difference (a parity sketch) leave few pairs. What they connect is verified exactly, group by group; very large groups, which may be long chains, list by list.

Lines of one set of words (told by two 64-bit sums) are one class, and only classes are joined, however often their lines
are repeated. Long lists are cut by lengths, and then into parts that are joined in pairs; so are large groups.

A line is removed if a line before it, in the order of (doc_id, row, line number), is similar to it. Links are counted
between classes. Lines without words are never removed. A null text has no lines; rows with a null doc_id come first; rows
that share a doc_id are rows of their own, and equal rows too. Lines of any length are compared whole. An empty table gives
an empty table. Columns other than doc_id and text may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from myospark.llm.components import connected
from myospark.llm.spread import BROADCAST_ROWS, fresh, join_dealt, numbered, small, written
from myospark.llm.words import BETWEEN_BLANKS, Splitter, mix, pieces
from myospark.session import batch_rows, cut, ensure_workers, give_back

#: Jaccard threshold, as a fraction.
UP, DOWN = 4, 5
#: Words are counted in 2^BUCKET_BITS hash buckets, whose levels every task knows (a byte each), in blocks of 2^BLOCK_BITS.
BUCKET_BITS, BLOCK_BITS, KEY_BITS, POSITION_BITS = 24, 12, 48, 9
#: Words a task counts before it sends counts on; postings looked at together; classes compared in one task.
COUNTED, BUFFER, GROUP = 4_000_000, 200_000, 1024
#: Rows of groups of classes that are taken from Arrow together, about.
COMPARED = 4096
#: Classes of a component that are all compared with each other.
LARGE = 8192
#: Words of a level above LIST_LEVEL may have long lists; these are cut into parts of LIST classes.
LIST_LEVEL, LIST = 13, 8192
#: Similar lines are in the same or in neighbouring bands of lengths (a little wider than the threshold asks).
BAND = math.log(1.26)
#: Longest sketch, in 64-bit words.
SKETCH = 64

LINE = "class long, twin long, doc_id long, row long, line_no int, n int, sketch0 long, sketch1 long, wide array<long>, keys array<long>"


def word_levels(docs: DataFrame, bits: int = BUCKET_BITS) -> np.ndarray:
    """The binary logarithm of the number of words in each of 2^bits hash buckets, plus 1; 0 for none.

    A word whose bucket holds 1 is nowhere else. Tasks send on blocks of counts, which are added up block by block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, kept, held = Splitter(BETWEEN_BLANKS), [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal kept, held
            buckets, n = np.unique(np.concatenate(kept), return_counts=True)
            kept, held = [], 0
            blocks, first = np.unique(buckets >> BLOCK_BITS, return_index=True)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(first, len(x)), pa.int32()), pa.array(x.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), lists(buckets & ((1 << BLOCK_BITS) - 1)), lists(n)], ["block", "bucket", "n"])

        for b in batches:
            for _, data, offsets in pieces(b.column(0)):
                hashes, _, _ = splitter.of(data, offsets)
                kept.append((hashes >> np.uint64(64 - bits)).astype(np.uint32))
                held += len(hashes)
                if held > COUNTED:
                    yield from sent()
        if held:
            yield from sent()

    def add(group: pa.Table) -> pa.Table:
        flat = lambda c: group[c].combine_chunks().flatten().to_numpy()
        total = np.bincount(flat("bucket"), flat("n"), 1 << BLOCK_BITS)
        levels = np.where(total > 0, np.floor(np.log2(np.maximum(total, 1))) + 1, 0).astype(np.uint8)
        return pa.table({"block": group["block"].slice(0, 1), "levels": pa.array([levels.tobytes()], pa.binary())})

    counts = docs.select(F.col("text").cast("binary")).mapInArrow(run, "block int, bucket array<int>, n array<int>")
    found = counts.groupBy("block").applyInArrow(add, "block int, levels binary").toArrow()  # as many bytes as buckets, at most
    out = np.zeros((1 << (bits - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    for block, levels in zip(found["block"].to_pylist(), found["levels"].to_pylist(), strict=True):
        out[block] = np.frombuffer(levels, np.uint8)
    return out.ravel()


class Lines:
    """The lines of texts as sets of keys: a key is the level of a word's bucket, then 48 bits of its hash."""

    def __init__(self, levels: np.ndarray):
        self.levels, self.splitter = levels, Splitter(BETWEEN_BLANKS)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each line with words: text, line number and size; then all keys, line by line, ascending."""
        hashes, starts, _ = self.splitter.of(data, offsets)
        feeds = np.zeros(len(data) + 1, np.int32)
        np.cumsum(data == 10, out=feeds[1:])
        text = np.searchsorted(offsets, starts, "right") - 1
        number = feeds[starts] - feeds[offsets[text]]
        new = np.ones(len(starts), bool)
        new[1:] = (text[1:] != text[:-1]) | (number[1:] != number[:-1])
        first, line = np.flatnonzero(new), np.cumsum(new) - 1
        level = self.levels[(hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64)
        keys = level << np.uint64(KEY_BITS) | hashes >> np.uint64(64 - KEY_BITS)
        if len(first) <= 1 << (64 - 6 - KEY_BITS):  # one sort of line and key in a number
            both = np.sort(line.astype(np.uint64) << np.uint64(6 + KEY_BITS) | keys)
            line, keys = (both >> np.uint64(6 + KEY_BITS)).astype(np.int64), both & np.uint64((1 << (6 + KEY_BITS)) - 1)
        else:
            order = np.lexsort((keys, line))
            line, keys = line[order], keys[order]
        once = np.ones(len(keys), bool)
        once[1:] = (keys[1:] != keys[:-1]) | (line[1:] != line[:-1])
        return text[first], number[first].astype(np.int32), np.bincount(line[once], minlength=len(first)), keys[once]


def sketch_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of a sketch: two for lines of up to 128 words, or the power of two that gives each word two bits or more."""
    return np.where(n <= 128, 2, np.minimum(SKETCH, 1 << np.ceil(np.log2(np.maximum(n / 32, 1))).astype(np.int64)))


def line_rows(docs: DataFrame, levels: np.ndarray, whole: bool) -> DataFrame:
    """A row for each line (LINE) of docs (doc_id, row, text): keys are all, or those of the prefix whose words may be elsewhere, with their positions.

    Positions are in the lowest POSITION_BITS, as far as these go, which only weakens the positional filter. Lines of
    fewer than 4 words are similar to none but their equals, and have no prefix.

    sketch0 and sketch1 hold 128 bits of parity; lines of more than 128 words have a wider sketch in `wide`.
    """

    def rows(lines: Lines, ids: list[pa.Array], first: int, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch | None:
        owner, number, n, keys = lines.of(data, offsets)
        if not len(n):
            return None
        starts = np.cumsum(n) - n
        hashes = mix(keys & np.uint64((1 << KEY_BITS) - 1))
        classes, twins = (mix(np.add.reduceat(x, starts) + n.astype(np.uint64)) for x in (hashes, mix(~hashes)))
        size = sketch_words(n)
        width = np.repeat(size, n)
        bit = (hashes >> np.uint64(20)).astype(np.int64) & (64 * width - 1)
        one = np.uint64(1) << (bit & 63).astype(np.uint64)
        even = bit >> 6 & 1 == 0
        sketch = [np.bitwise_xor.reduceat(np.where(side, one, np.uint64(0)), starts).view(np.int64) for side in (even, ~even)]
        wide = np.where(size > 2, size, 0)
        flat = np.zeros(int(wide.sum()), np.uint64)
        some = width > 2
        np.bitwise_xor.at(flat, np.repeat(np.cumsum(wide) - wide, n)[some] + bit[some] // 64, one[some])
        position = np.arange(len(keys)) - np.repeat(starts, n)
        if whole:
            inside, kept = np.ones(len(keys), bool), n
        else:
            prefix = np.where(n < 4, 0, n - (UP * n + DOWN - 1) // DOWN + 1)
            inside = (position < np.repeat(prefix, n)) & (keys >> np.uint64(KEY_BITS) > 1)
            keys = keys << np.uint64(POSITION_BITS) | np.minimum(position, (1 << POSITION_BITS) - 1).astype(np.uint64)
            kept = np.add.reduceat(inside, starts, dtype=np.int64)
        lists = lambda x, k, mask=None: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]), pa.int32()), pa.array(x), mask=mask)
        columns = [classes.view(np.int64), twins.view(np.int64), *(x.take(pa.array(first + owner)) for x in ids), number, pa.array(n, pa.int32()), *sketch, lists(flat.view(np.int64), wide, pa.array(wide == 0)), lists(keys[inside].view(np.int64), kept)]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.split()[0] for c in LINE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        lines = Lines(levels)
        for b in batches:
            for piece in pieces(b.column(2)):
                if (found := rows(lines, b.columns[:2], *piece)) is not None:
                    yield found

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row", F.col("text").cast("binary").alias("text")).mapInArrow(run, LINE)


def line_classes(lines: DataFrame) -> DataFrame:
    """One row for each set of words: id, class, twin, held (lines), own (where the first of them stands), and the rest of LINE."""
    first = F.min(F.struct("doc_id", "row", "line_no", "n", "sketch0", "sketch1", "wide", "keys")).alias("x")
    found = lines.groupBy("class", "twin").agg(first, F.count(F.lit(1)).alias("held"))
    own = F.struct("x.doc_id", "x.row", "x.line_no").alias("own")
    return written(found.select(F.monotonically_increasing_id().alias("id"), "class", "twin", "held", own, "x.n", "x.sketch0", "x.sketch1", "x.wide", "x.keys"))


class Wide:
    """The wide sketches of rows, null where lines are short. Two are compared at the lesser of their widths, folded when that is asked."""

    def __init__(self, sketches: pa.ListArray):
        self.bits, self.edges = sketches.values.to_numpy().view(np.uint64), sketches.offsets.to_numpy()
        self.known = sketches.is_valid().to_numpy(zero_copy_only=False)

    def apart(self, x: int, y: int) -> int:
        """Bits that tell x from y; 0 where one has no wide sketch."""
        if not self.known[x] or not self.known[y]:
            return 0
        a, b = (self.bits[self.edges[i] : self.edges[i + 1]] for i in (x, y))
        while len(a) != len(b):
            a, b = (a, b) if len(a) > len(b) else (b, a)
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        return int(np.bitwise_count(a ^ b).sum())


def join_lists(key: np.ndarray, cls: np.ndarray, n: np.ndarray, pos: np.ndarray, sketches: list[np.ndarray], wide: Wide, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes that pass the filters, rows sorted by (key, n): as many as connect what they connect. at: where rows stand in wide."""
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    list_ = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    root, out, d = np.arange(len(key)), [], 1
    i = np.flatnonzero((UP + DOWN) * (n - pos) >= 2 * UP * n)  # from elsewhere no later row is in reach
    while True:
        i = i[i < len(key) - d]
        j = i + d
        going = (list_[i] == list_[j]) & (UP * n[j] <= DOWN * n[i])  # later rows of a list are longer
        i = i[going]
        if not len(i):
            break
        j = i + d
        total = n[i] + n[j]
        rest = np.minimum(n[i] - pos[i], n[j] - pos[j])
        some = (cls[i] != cls[j]) & (root[i] != root[j]) & ((UP + DOWN) * rest >= UP * total)
        a, b = i[some], j[some]
        apart = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in sketches)
        near = (UP + DOWN) * apart <= (DOWN - UP) * total[some]
        for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
            if root[x] == root[y] or (UP + DOWN) * wide.apart(at[x], at[y]) > (DOWN - UP) * (n[x] + n[y]):
                continue
            part = root[edges[list_[x]] : edges[list_[x] + 1]]
            part[part == root[y]] = root[x]
            out.append((cls[x], cls[y]))
        d += 1
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def band_of(n: Column) -> Column:
    return F.floor(F.log(n) / BAND).cast("int")


def postings(classes: DataFrame) -> DataFrame:
    """(key, id, n, sketches): a row for each class in each list that it is in; key is the list, then the position.

    Where a word may be in many classes, its list is cut into lists for two neighbouring bands of lengths each, and these
    into parts of LIST classes, which meet in pairs.
    """
    posted = classes.select(F.explode("keys").alias("key"), "id", "n", "sketch0", "sketch1", "wide")
    often = F.shiftright("key", KEY_BITS + POSITION_BITS) > LIST_LEVEL
    band = band_of(F.col("n"))
    long_ = posted.where(often).withColumns({"list": F.shiftright("key", POSITION_BITS), "band": F.explode(F.array(band, band + 1))})
    sizes = long_.groupBy("list", "band").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("parts")).where("parts > 1")
    dealt = long_.join(small(cut(sizes)), ["list", "band"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    paired = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = F.xxhash64("list", "band", F.least("part", "other"), F.greatest("part", "other"))
    position = F.col("key").bitwiseAND((1 << POSITION_BITS) - 1)
    key = F.shiftleft(F.shiftrightunsigned(group, 64 - 6 - KEY_BITS), POSITION_BITS).bitwiseOR(position)
    return posted.where(~often).unionByName(paired.withColumn("key", key).select(*posted.columns))


def join_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of classes that lists connect: batches of postings, in the order of their keys."""
    kept: list[pa.RecordBatch] = []

    def joined(t: pa.Table) -> pa.RecordBatch:
        packed, n = t["key"].to_numpy(), t["n"].to_numpy().astype(np.int64)
        key = packed >> POSITION_BITS
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        list_ = np.cumsum(starts) - 1
        some = np.flatnonzero(np.bincount(list_)[list_] > 1)
        at = some[np.argsort(list_[some] << 32 | n[some], kind="stable")]
        pos, sketches = packed[at] & ((1 << POSITION_BITS) - 1), [t[c].to_numpy().view(np.uint64)[at] for c in ("sketch0", "sketch1")]
        a, b = join_lists(key[at], t["id"].to_numpy()[at], n[at], pos, sketches, Wide(t["wide"].combine_chunks()), at)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for b in batches:
        kept.append(b)
        if sum(x.num_rows for x in kept) >= BUFFER:
            t = pa.Table.from_batches(kept)
            key = t["key"].to_numpy() >> POSITION_BITS
            end = int(np.searchsorted(key, key[-1]))  # the last list may go on
            if end:
                yield joined(t.slice(0, end))
                kept = t.slice(end).to_batches()
    if kept:
        yield joined(pa.Table.from_batches(kept))


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b): ids of classes that some prefix word's list connects after the filters."""
    return postings(classes).repartition(F.shiftright("key", POSITION_BITS)).sortWithinPartitions("key").mapInArrow(join_postings, "a long, b long")


def compare(keys: list[np.ndarray], n: np.ndarray, rows: np.ndarray, columns: np.ndarray, first: int | None = None) -> np.ndarray:
    """Whether the Jaccard similarity of rows and columns is at the threshold or above, and `first`, if given, their first common word."""
    size = np.array([len(k) for k in keys])
    words, word = np.unique(np.concatenate(keys), return_inverse=True)
    owner = np.repeat(np.arange(len(keys)), size)
    both, before = (np.zeros((len(rows), len(columns)), np.float32) for _ in range(2))
    below = 0 if first is None else int(np.searchsorted(words, first))  # words before the first common one
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    for low in range(0, int(word[-1]) + 1, 4096):
        span = slice(*np.searchsorted(word, [low, low + 4096]))
        m = np.zeros((len(keys), min(4096, len(words) - low)), np.float32)
        m[owner[span], word[span] - low] = 1
        both += m[rows] @ m[columns].T
        if low < below:
            some = m[:, : below - low]
            before += some[rows] @ some[columns].T
    return ((UP + DOWN) * both >= UP * (n[rows][:, None] + n[columns][None, :])) & (before == 0)


def in_units(members: DataFrame) -> DataFrame:
    """members (root, id, n) with the pairs (x, y) of units that they are compared in, and their own `unit`.

    A unit has GROUP classes, about. Groups above that are cut into bands of lengths, and bands into units; a unit meets
    those of its own band and of the bands beside it, each once.
    """
    banded = members.select("root", "id", band_of(F.col("n")).alias("band"))
    counts = banded.groupBy("root", "band").agg(F.count(F.lit(1)).alias("n"))
    shape = counts.groupBy("root").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("band", "n"))).alias("bands"))  # as many as bands
    dealt = join_dealt(banded, shape, ["root"], "all", F.col("id"))
    one = F.col("all") <= GROUP
    dealt = dealt.withColumn("band", F.when(one, 0).otherwise(F.col("band")))
    parts = lambda b: F.when(one, F.when(b == 0, 1).otherwise(0)).otherwise(F.coalesce(F.ceil(F.try_element_at("bands", b) / GROUP), F.lit(0))).cast("int")
    unit = lambda band, part: F.shiftleft(band.cast("long"), 32) + part
    own = unit(F.col("band"), F.pmod(F.xxhash64("id"), parts(F.col("band"))))
    units = lambda b: F.transform(F.slice(F.sequence(F.lit(0), parts(b)), F.lit(1), parts(b)), lambda q: unit(b, q))
    near = F.flatten(F.transform(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1), units))
    met = dealt.withColumn("unit", own).withColumn("other", F.explode(near))
    return met.select("root", "id", "unit", F.least("unit", "other").alias("x"), F.greatest("unit", "other").alias("y"))


def by_lists(members: DataFrame) -> DataFrame:
    """members once for each word of its prefix that others may have, which becomes its `root`: two similar sets share their first common word's list."""
    prefix = F.slice("keys", 1, F.col("n") - F.ceil(F.lit(UP) * F.col("n") / DOWN).cast("int") + 1)
    known = F.filter(prefix, lambda k: F.shiftright(k, KEY_BITS) > 1)
    return members.where("n >= 4").withColumn("root", F.explode(known)).select(*members.columns)


def verify(members: DataFrame) -> DataFrame:
    """(id, links, first): how many classes are similar to each, and where the first of them stands.

    members: (root, id, n, keys, doc_id, row, line_no). Components of up to LARGE classes are compared whole. Larger ones may be chains in
    which few are similar: only classes that share a prefix word are compared, and a pair counts where that word is its first common one.
    """
    large = cut(members.groupBy("root").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > LARGE).select("root"))
    found = compared(members, False)
    if large.count():
        found = compared(members.join(large, "root", "left_anti"), False).union(compared(by_lists(members.join(large, "root", "left_semi")), True))
    return found.groupBy("id").agg(F.sum("links").alias("links"), F.min(F.struct("doc_id", "row", "line_no")).alias("first"))


def compared(members: DataFrame, lists: bool) -> DataFrame:
    """(id, links, doc_id, row, line_no): similar classes of each in a pair of units, and where the first of them stands. lists: roots are words."""
    pairs = in_units(members).withColumnRenamed("unit", "part").join(members, ["root", "id"]) if lists else in_units(members).withColumnRenamed("unit", "part").join(members.drop("root"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def groups(t: pa.Table) -> list[int]:
            """Where the groups of a table begin."""
            ids = np.stack([t[c].to_numpy() for c in ("root", "x", "y")])
            return [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist()]

        def done(t: pa.Table, begins: list[int]) -> pa.RecordBatch:
            root, x, y, part, n = (t[c].to_numpy() for c in ("root", "x", "y", "part", "n"))
            n, flat = n.astype(np.int64), t["keys"].combine_chunks()
            edges = np.concatenate([[0], np.cumsum(flat.value_lengths().to_numpy())]).tolist()
            values, linked, links, firsts = flat.flatten().to_numpy(), [], [], []
            for low, high in zip(begins, [*begins[1:], t.num_rows], strict=True):
                own = part[low:high]
                rows, columns = np.flatnonzero(own == x[low]), np.flatnonzero(own == y[low])
                if not len(rows) or not len(columns):
                    continue
                keys = [values[a:b] for a, b in zip(edges[low:high], edges[low + 1 : high + 1], strict=True)]
                alike = np.zeros((high - low, high - low), bool)
                alike[np.ix_(rows, columns)] = compare(keys, n[low:high], rows, columns, int(root[low]) if lists else None)
                alike |= alike.T
                np.fill_diagonal(alike, False)
                held = alike.sum(axis=1)
                some = np.flatnonzero(held)
                linked.append(low + some)
                links.append(held[some])
                firsts.append(low + alike[some].argmax(axis=1))  # rows stand in the order of (doc_id, row, line_no)
            some, links, firsts = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (linked, links, firsts))
            of = lambda c, at: t[c].combine_chunks().take(pa.array(at))
            return pa.RecordBatch.from_arrays([of("id", some), pa.array(links), *(of(c, firsts) for c in ("doc_id", "row", "line_no"))], ["id", "links", "doc_id", "row", "line_no"])

        for b in batches:
            kept.append(b)
            if sum(k.num_rows for k in kept) >= COMPARED:
                t = pa.Table.from_batches(kept)
                *begins, last = groups(t)  # the last group may go on
                if begins:
                    yield done(t.slice(0, last), begins)
                    kept = t.slice(last).to_batches()
        if sum(k.num_rows for k in kept):
            t = pa.Table.from_batches(kept)
            yield done(t, groups(t))

    columns = ["root", "x", "y", "part", "id", "n", "keys", "doc_id", "row", "line_no"]
    return pairs.select(*columns).repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "doc_id", "row", "line_no").mapInArrow(run, "id long, links long, doc_id long, row long, line_no int")


def class_sets(docs: DataFrame, levels: np.ndarray, members: DataFrame) -> DataFrame:
    """members (id, root, class, twin, own) with n and keys, from the texts that they stand in."""
    ids = small(members.select(F.col("own.doc_id").alias("_id")).distinct())
    some = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    whole, keys, wanted = line_rows(some, levels, whole=True).select("class", "twin", "n", "keys"), ["class", "twin"], members.select("class", "twin")
    if members.count() <= BROADCAST_ROWS:
        sets = whole.join(F.broadcast(wanted), keys, "left_semi").dropDuplicates(keys)
    else:  # copies go before the shuffle
        sets = whole.dropDuplicates(keys).join(wanted, keys, "left_semi")
    return sets.join(small(members), keys).select("root", "id", "n", "keys", "own.*")


def similar_lines(docs: DataFrame, row: str | None = None) -> DataFrame:
    """A row for each line with words.

    doc_id, row, line_no; class_doc_id, class_row, class_line_no: where the first line of its set of words stands;
    n_links: sets that are similar to its own; removed. row: a column that numbers the rows of docs, if there is one.
    """
    ensure_workers(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col("text").alias("text"))
    levels = word_levels(rows)
    lines = written(line_rows(rows, levels, whole=False))
    classes = line_classes(lines)
    with batch_rows(docs.sparkSession, 32_768):
        roots = small(cut(connected(candidates(classes)).withColumnRenamed("vertex", "id")))
    members = cut(classes.select("id", "class", "twin", "own").join(roots, "id"))
    found = small(cut(verify(cut(class_sets(rows, levels, members)))))
    known = classes.select("id", "class", "twin", "held", "own").join(found, "id", "left")
    known = known.select("class", "twin", "held", "own", F.coalesce("links", F.lit(0)).alias("n_links"), F.least("own", F.coalesce("first", "own")).alias("earliest"))
    each = join_dealt(lines.select("class", "twin", "doc_id", "row", "line_no"), known, ["class", "twin"], "held", F.xxhash64("row", "line_no"))
    removed = F.struct(F.col("doc_id"), F.col("row"), F.col("line_no")) > F.col("earliest")
    own = [F.col(f"own.{c}").alias(f"class_{c}") for c in ("doc_id", "row", "line_no")]
    return each.select("doc_id", "row", "line_no", *own, "n_links", removed.alias("removed"))


def remove_lines(docs: DataFrame) -> DataFrame:
    """docs without the removed lines; rows that lose all their words go, as every line of theirs is elsewhere."""
    row = fresh(docs, "row")
    rows = numbered(docs, row)
    lost_lines = fresh(rows, "lost")
    found = similar_lines(rows, row).where("removed")
    lost = found.groupBy(F.col("row").alias(row)).agg(F.collect_set("line_no").alias(lost_lines))
    lines = F.col(lost_lines)
    kept = F.filter(F.split("text", "\n"), lambda _line, i: ~F.array_contains(lines, i))
    text = F.when(lines.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    blank = lines.isNotNull() & ~text.rlike(r"[^\x20\x09-\x0D]")
    return rows.join(lost, row, "left").where(~blank).withColumn("text", text).select(*docs.columns)


#: All pairs of word sets that share a word, by length; a line goes if a line before it is similar.
ORACLE_SQL = r"""
WITH split_ AS (SELECT doc_id, unnest(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
lines AS (
  SELECT doc_id, line_no, list_sort(list_distinct(list_filter(string_split_regex(line, '[ \t-\r]+'), lambda w: w <> ''))) AS words FROM split_),
numbered AS (SELECT *, dense_rank() OVER (ORDER BY words) AS c FROM lines WHERE len(words) > 0),
classes AS (SELECT c, any_value(words) AS words, min((doc_id, line_no)) AS own FROM numbered GROUP BY c),
posted AS (SELECT c, len(words) AS n, unnest(words) AS w FROM classes),
pairs AS (
  SELECT a.c AS a, b.c AS b FROM posted a JOIN posted b ON a.w = b.w AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n AND a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
found AS (SELECT a AS c, count(*) AS n_links, min(own) AS first FROM pairs JOIN classes ON b = c GROUP BY a)
SELECT doc_id, line_no, struct_extract_at(own, 1) AS class_doc_id, struct_extract_at(own, 2) AS class_line_no,
  coalesce(n_links, 0)::BIGINT AS n_links, (doc_id, line_no) > least(own, coalesce(first, own)) AS removed
FROM numbered JOIN classes USING (c) LEFT JOIN found USING (c)
"""


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, class_doc_id, class_line_no, n_links, removed, for every line with words."""
    number = lambda c: F.col(c).cast("long").alias(c)
    return similar_lines(docs).select("doc_id", number("line_no"), "class_doc_id", number("class_line_no"), "n_links", "removed")
