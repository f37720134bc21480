"""Near copies by Jaccard similarity: every pair of shingle sets at UP / DOWN or above is linked.

SimHash finds most of them: fingerprints of the sets are linked by covering tables (`simhash.links`), and the links checked on
whole sets. But sets at 0.8 differ in about ten of 64 bits, and tables for that radius would be too many. So what SimHash
leaves apart goes through an exact set-similarity join with prefix and positional filters: all sets are ordered alike, rare
shingles first; a pair at UP / DOWN or above shares a shingle among the first n - ceil(UP n / DOWN) + 1 of each, and from its
first common shingle on there is room for the overlap. Shingles of rare words are taken for rare: words are counted over all documents, so that
prefixes of unlike documents share few shingles however many documents there are. What is frequent beyond that is learned from a sample, and then
from the prefixes of all documents: a phrase that many of them hold, and nothing else, leaves their prefixes, so that it makes no pairs. Any order finds the same.

Documents of one shingle set are one class. Classes that share a prefix shingle are first compared with a leader, one for
each shingle and band of sizes, picked by hash. Pairs that this leaves in different components are then all compared, so
a large group of copies costs about as much as its size, and nothing is left out.

Words: A-Z in lower case, runs of other than ASCII white space. Fewer words than a shingle has give one shingle, none gives
the empty set, whose documents are copies of each other. A null text is an empty one. Texts of any length are compared whole.
Of each component the row of the least key stays (null keys last), and one row of those that share it. An empty table gives
an empty table. Columns other than key and text may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from myospark.llm.components import connected
from myospark.llm.linear import bounded_sample, sampled_texts
from myospark.llm.linejoin import word_levels
from myospark.llm.simhash import links as near_links
from myospark.llm.simhash import majority
from myospark.llm.spread import fresh, join_dealt, numbered, small, without, written
from myospark.llm.words import BETWEEN_BLANKS, Splitter, mix, pieces, powers
from myospark.session import batch_rows, cut, ensure_workers, give_back

#: The least similarity, as a fraction; bits that SimHash's links differ in at most.
UP, DOWN, RADIUS = 4, 5, 3
#: Documents whose shingles are counted, and the most frequent ones that every task knows.
COUNT_DOCS, COUNTED = 8000, 1 << 18
#: Shingles in the prefixes of more components than CROWD are as frequent as those of the sample: where they make more pairs than CROWD times the rows, prefixes are taken again without them, at most RANKINGS times.
CROWD, RANKINGS = 64, 4
#: Texts whose shingles are sorted together: their numbers stand above KEY_BITS of hash.
TOGETHER, KEY_BITS = 1024, 54
#: Words are counted in 2^WORD_BITS hash buckets. A shingle of a prefix is known by LEVEL_BITS of its words' levels, summed and divided by STEP, above its hash.
WORD_BITS, LEVEL_BITS, STEP = 22, 6, 4

#: Classes that one task compares with a leader, about.
MEMBERS = 512
#: Bytes of texts that are sent to Python together, about.
SENT = 1 << 21


class Shingles:
    """The sets of texts' shingles, as ascending hashes of KEY_BITS; with `levels` of words (`word_levels`) those of rare words come first."""

    def __init__(self, words: int, levels: np.ndarray | None = None):
        self.words, self.levels, self.splitter = words, levels, Splitter(BETWEEN_BLANKS)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All sets in turn, and their sizes; at most TOGETHER texts."""
        found, starts, _ = self.splitter.of(data, offsets)
        n = np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=len(offsets) - 1)
        ends = np.cumsum(n)
        size = np.where(n > 0, np.maximum(n - self.words + 1, 1), 0)
        text = np.repeat(np.arange(len(n)), size)
        at = np.repeat(ends - n, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        hashes, factors = np.zeros(len(at), np.uint64), powers(self.words + 1)[0]
        level, total = None if self.levels is None else self.levels[(found >> np.uint64(64 - WORD_BITS)).astype(np.int64)], np.zeros(len(at), np.uint64)
        for j in range(self.words):
            inside = at + j < ends[text]
            hashes[inside] += found[at[inside] + j] * factors[j + 1]
            if level is not None:
                total[inside] += level[at[inside] + j]
        names = mix(hashes) >> np.uint64(64 - KEY_BITS)
        if level is not None:  # the sum of logarithms is that of how often the shingle would be by chance
            names = np.minimum(total // np.uint64(STEP), (1 << LEVEL_BITS) - 1).astype(np.uint64) << np.uint64(KEY_BITS - LEVEL_BITS) | names >> np.uint64(LEVEL_BITS)
        keys = np.sort(text.astype(np.uint64) << np.uint64(KEY_BITS) | names)
        keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
        sizes = np.bincount((keys >> np.uint64(KEY_BITS)).astype(np.int64), minlength=len(n))
        return (keys & np.uint64((1 << KEY_BITS) - 1)).astype(np.int64), sizes

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, sets, sizes) of runs of texts."""
        for low in range(0, len(texts), TOGETHER):
            for first, data, offsets in pieces(texts.slice(low, TOGETHER)):
                yield low + first, *self.of(data, offsets)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, pa.int64()))


def binary(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def whole_sets(texts: DataFrame, words: int, levels: np.ndarray) -> DataFrame:
    """texts (id, text) as (id, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words, levels)
        for b in batches:
            for first, keys, sizes in shingles.batches(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(sizes)), lists(keys, sizes)], ["id", "keys"])

    return texts.select("id", "text").mapInArrow(run, "id long, keys array<long>")


def frequent(docs: DataFrame, words: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the most frequent shingles of a sample of docs (row, text); bounded by COUNTED."""
    chosen = bounded_sample(docs.select("row"), "row", COUNT_DOCS)
    texts = sampled_texts(docs, chosen, "row", "text").select(F.col("row").alias("id"), binary("text").alias("text"))
    counts = whole_sets(texts, words, levels).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    found = counts.orderBy(F.desc("n"), "key").limit(COUNTED).toArrow()
    hashes, n = found["key"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def ranks(keys: np.ndarray, ranked: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    hashes, n = ranked
    if not len(hashes):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return np.where(hashes[at] == keys, n[at], 0)


def described(docs: DataFrame, words: int) -> DataFrame:
    """docs (row, key, text) as (row, key, class, twin, n, fingerprint): a set by two 64-bit sums, its size and its SimHash."""
    key_type = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for b in batches:
            for first, keys, sizes in shingles.batches(b.column(2)):
                starts, hashes, some = np.cumsum(sizes) - sizes, mix(keys.astype(np.uint64)), sizes > 0
                sums = np.zeros((2, len(sizes)), np.uint64)
                for i, x in enumerate((hashes, mix(~hashes)) if some.any() else ()):
                    sums[i, some] = np.add.reduceat(x, starts[some])
                prints = [majority(hashes[a : a + n]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                names = [pa.array(mix(x + sizes.astype(np.uint64)).view(np.int64)) for x in sums]
                columns = [*(c.slice(first, len(sizes)) for c in b.columns[:2]), *names, pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "key", "class", "twin", "n", "fingerprint"])

    return docs.select("row", "key", binary("text").alias("text")).mapInArrow(run, f"row long, key {key_type}, class long, twin long, n int, fingerprint long")


def prefixes(docs: DataFrame, words: int, levels: np.ndarray, ranked: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, id, at) of docs (row, text): the shingles of which a similar set shares one, the rarest first; at is size << 32 | position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        shingles = Shingles(words, levels)
        for b in batches:
            for first, keys, sizes in shingles.batches(b.column(1)):
                level, chosen = ranks(keys, ranked), [keys[:0]]
                length = np.where(sizes > 0, sizes - -(-UP * sizes // DOWN) + 1, 0)
                for a, n, m in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), length.tolist(), strict=True):
                    part = keys[a : a + n]
                    chosen.append(part[np.argsort(level[a : a + n], kind="stable")[:m]] if level[a : a + n].any() else part[:m])
                position = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
                id_ = b.column(0).slice(first, len(sizes)).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(chosen)), pa.array(np.repeat(id_, length)), pa.array(np.repeat(sizes, length) << 32 | position)], ["key", "id", "at"])

    return docs.select("row", binary("text").alias("text")).mapInArrow(run, "key long, id long, at long")


def shared(posted: DataFrame) -> DataFrame:
    """The rows of posted (key, ...) whose key is held by more than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, twice = None, True  # the last row of all so far, and whether it has been sent
        for b in batches:
            if not b.num_rows:
                continue
            both = pa.Table.from_batches([b] if last is None else [last, b]).combine_chunks().to_batches()[0]
            key = both.column(0).to_numpy()
            same = key[1:] == key[:-1]
            kept = np.append(False, same) | np.append(same, False)
            if last is not None:
                kept[0] &= not twice
            twice = bool(kept[-1]) or (len(key) == 1 and twice)
            last = both.slice(len(key) - 1)
            yield both.filter(pa.array(kept))

    return posted.repartition("key").sortWithinPartitions("key").mapInArrow(run, posted.schema)


def may_reach(x: str, y: str) -> Column:
    """Whether sizes and positions of a shared shingle leave room for the overlap."""
    rest = F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos"))
    return (UP + DOWN) * rest >= UP * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def roots_of(links: DataFrame) -> DataFrame:
    """(id, root) of the ids in links (a, b)."""
    return connected(links).withColumnRenamed("vertex", "id")


def rooted(ids: DataFrame, roots: DataFrame) -> DataFrame:
    """ids (id, ...) with the root of the component that each id is in."""
    return ids.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def crowds(left: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys of left (key, root, ...), sorted, that classes of more than CROWD components hold, and how many; the COUNTED most held, which bounds them."""
    counts = left.groupBy("key", "root").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
    found = counts.orderBy(F.desc("n"), "key").limit(COUNTED).toArrow()
    hashes, n = found["key"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def merged(ranked: tuple[np.ndarray, np.ndarray], crowded: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Both, with the greater count of keys that are in both."""
    keys, n = (np.concatenate(x) for x in zip(ranked, crowded, strict=True))
    order = np.lexsort([-n, keys])
    keys, n = keys[order], n[order]
    first = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    return keys[first], n[first]


class Classes:
    """The sets of docs (row, key, text): `rows` has a row for each of docs, and `own` for each set; its id is its first row."""

    def __init__(self, docs: DataFrame, words: int):
        self.docs, self.words, self.levels = docs, words, None
        self.rows = cut(described(docs, words))
        place = F.struct(F.col("key").isNull().alias("none"), "key", "row")
        found = self.rows.groupBy("class", "twin").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("held"), F.first("fingerprint").alias("fingerprint"))
        self.own = cut(found.withColumn("id", F.col("least.row")))

    def first(self) -> DataFrame:
        """One document of each set."""
        copies = self.rows.select("row").join(self.own.select(F.col("id").alias("row")), "row", "left_anti")
        return without(self.docs, cut(copies), "row")

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) whose whole sets are similar. The texts of each `a` are sent to those of its `b`."""
        pairs = cut(pairs)
        counts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        parts = F.ceil(F.col("n") / MEMBERS).cast("int")
        dealt = join_dealt(pairs, counts, ["b"], "n", F.col("a")).select(F.col("a").alias("row"), "b", F.pmod(F.xxhash64("a"), parts).cast("int").alias("part"), F.lit(True).alias("member"))
        leaders = counts.select(F.col("b").alias("row"), "b", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(False).alias("member"))
        sent = self.docs.select("row", binary("text").alias("text")).join(small(cut(dealt.union(leaders))), "row")
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles, leader = Shingles(words), np.zeros(0, np.int64)
            for b in batches:
                row, of, member, found = b["row"].to_numpy(), b["b"].to_numpy(), b["member"].to_numpy(zero_copy_only=False), []
                for first, keys, sizes in shingles.batches(b["text"]):
                    for i, (z, n) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True), first):
                        one = keys[z - n : z]
                        if not member[i]:
                            leader = one
                        elif (UP + DOWN) * len(np.intersect1d(one, leader, assume_unique=True)) >= UP * (n + len(leader)):
                            found.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(row[found]), pa.array(of[found])], ["a", "b"])

        return cut(sent.repartition("b", "part").sortWithinPartitions("b", "part", "member").mapInArrow(run, "a long, b long"))

    def near_fingerprints(self) -> DataFrame:
        """(a, b): classes whose SimHash fingerprints are equal or that its covering tables link."""
        prints = self.own.select("id", "fingerprint")
        least = cut(prints.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
        same = join_dealt(prints, least, ["fingerprint"], "n", F.col("id")).where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
        linked = near_links(least.select("fingerprint"), RADIUS)
        name = lambda c: least.select(F.col("fingerprint").alias(c), F.col("least").alias(f"{c}_id"))
        return same.union(linked.join(name("a"), "a").join(name("b"), "b").select("a_id", "b_id"))

    def links(self) -> DataFrame:
        """(a, b): similar classes; between any two that are similar there is a path."""
        found = self.similar(self.near_fingerprints())
        self.levels = word_levels(self.docs, WORD_BITS)
        ranked = frequent(self.docs, self.words, self.levels)
        posted = self.posted(ranked)
        left = self.apart(posted, roots_of(found))
        leader = F.min_by(F.struct("id", "n", "pos", "root"), F.xxhash64("key", "id")).alias("l")
        leaders = left.groupBy("key", "band").agg(leader, F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "band", "l.*", "m")
        met = join_dealt(left.withColumnsRenamed({"id": "x", "n": "x_n", "pos": "x_pos", "root": "x_root"}), leaders, ["key", "band"], "m", F.col("x"))
        met = met.select(F.struct(F.col("x").alias("id"), F.col("x_n").alias("n"), F.col("x_pos").alias("pos"), F.col("x_root").alias("root")).alias("x"), F.struct("id", "n", "pos", "root").alias("y"))
        met = met.where((F.col("x.root") != F.col("y.root")) & may_reach("x", "y")).groupBy(F.col("x.id").alias("id"), F.col("y.id").alias("leader")).agg(F.count(F.lit(1)).alias("m"))
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("m"), "leader"))
        led = cut(met.withColumn("rank", rank).where("rank = 1").select(F.col("id").alias("a"), F.col("leader").alias("b")))
        found = found.union(self.similar(led))

        roots = roots_of(found)
        left = self.apart(posted, roots)
        for _ in range(RANKINGS):
            crowded = crowds(left)
            if float((crowded[1].astype(float) ** 2).sum()) <= CROWD * left.count():  # no more pairs than all other keys may make
                break
            ranked = merged(ranked, crowded)
            left = self.apart(self.posted(ranked), roots)
        met = left.alias("x").join(left.alias("y"), "key").where((F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & may_reach("x", "y"))
        rest = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(led.select(*ordered(F.col("a"), F.col("b"))), ["a", "b"], "left_anti")
        return found.union(self.similar(rest))

    def posted(self, ranked: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        """(key, id, n, pos, band): the prefixes of all classes, without keys that only one of them holds."""
        with batch_rows(self.docs.sparkSession, 32_768, SENT):  # texts go in, short rows come out
            found = written(shared(prefixes(self.first(), self.words, self.levels, ranked)))
        n, pos = F.shiftright("at", 32), F.col("at").bitwiseAND((1 << 32) - 1)
        return found.select("key", "id", n.alias("n"), pos.alias("pos"), F.floor(F.log(n) / math.log(DOWN / UP)).alias("band"))

    def apart(self, posted: DataFrame, roots: DataFrame) -> DataFrame:
        """posted with roots, without the keys whose classes are all in one component."""
        known = rooted(posted, roots)
        keys = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        return cut(known.join(keys, "key", "left_semi"))


def judged(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs (row, key, text) as (row, first): the least (none, key, row) that similar pairs lead to."""
    ensure_workers(docs.sparkSession)
    classes = Classes(docs, words)
    known = rooted(classes.own, roots_of(classes.links()))
    least = known.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("n"))
    named = join_dealt(known.select("root", "class", "twin", "held"), least, ["root"], "n", F.col("class"))
    return join_dealt(classes.rows, named.select("class", "twin", "held", "first"), ["class", "twin"], "held", F.col("row")).select("row", "first")


def keep_one(docs: DataFrame, text: str = "text", words: int = 5, key: str = "doc_id") -> DataFrame:
    """docs without near copies: of each component one row stays."""
    row = fresh(docs, "row")
    rows = numbered(docs, row)
    found = judged(rows.select(F.col(row).alias("row"), F.col(key).alias("key"), F.col(text).alias("text")), words)
    return without(rows, found.where(F.col("row") != F.col("first.row")).select(F.col("row").alias(row)), row).select(*docs.columns)
