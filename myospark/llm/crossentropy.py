"""Language-model scoring by cross-entropy difference (Moore and Lewis, 2010).

Two bigram models of one kind share one vocabulary, all words of all documents: the target model is counted on documents
marked as target, the background model on all. A document's score is its mean loss a token under the background model less
that under the target model: high scores read like the target.

Words: A-Z in lower case, runs of other than ASCII white space, known by 64 bits of hash. A document's end is a token too,
and the history of its first word. p(w) = (c(w) + 1) / (N + V), p(w | h) = (c(h w) + MU p(w)) / (c(h) + MU).

No task holds all words or bigrams. Each task cuts its documents into blocks of bounded size, whatever their ids; each block's
distinct words, and then its distinct bigrams, are sent to the parts of the table of counts, added up there, and the sums sent
back to the blocks; beyond ROUTED parts in two steps, by groups of blocks and of parts. A part knows its keys by 48 bits of hash. All numbers travel by byte planes, compressed.

A null text is an empty one: no tokens, null losses. A null doc_id is never target. Repeated rows count as often as they
occur. A text of any length is counted whole, in one block. No order of words matters, so there are no ties. An empty table
gives an empty table. Columns other than doc_id and text may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from myospark.llm.spread import written
from myospark.llm.words import BETWEEN_BLANKS, Splitter, mix, pieces
from myospark.session import ensure_workers

MU = 100.0
#: Tokens of one block, about.
BLOCK_TOKENS = 1_500_000
#: Parts that each block asks directly, at most.
ROUTED = 4096
#: Target ids are broadcast up to this number (8 bytes each); beyond it they are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: The hash that stands for a document's end; multipliers of a bigram's hash.
END, HISTORY, WORD = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)

BLOCK = "tokens long, ends long, target_tokens long, target_ends long, words binary, numbers binary, doc_ids array<long>, targets array<boolean>, sizes array<int>"
#: Bytes of a key, of a count and of a word's number.
KEY, COUNT, NUMBER = 6, 8, 4
ASKED = "part int, block long, keys binary, n binary, n_target binary, sizes array<int>"
SUMS = "block long, part int, pairs boolean, n binary, n_target binary, kinds long"
RESULT = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"


def mark_target(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, text, target): whether the doc_id is in target (doc_id)."""
    ids = target.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.join(ids, rows["doc_id"] == ids["_id"], "left").select("doc_id", "text", F.col("_id").isNotNull().alias("target"))


def planes(x: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of unsigned numbers, all lowest first, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)


def numbers_of(raw: bytes, width: int) -> np.ndarray:
    """planes, back, as 64-bit integers."""
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(width, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :width] = flat.T
    return out.view("<i8").ravel()


def encode(marked: DataFrame) -> DataFrame:
    """Blocks of documents (block, *BLOCK): the words' hashes, most frequent first, and each token as a number of one of them.

    Written, so that a block stays the same however often it is read.
    """

    def block(ids: list[pa.Array], targets: list[np.ndarray], sizes: list[np.ndarray], tokens: list[np.ndarray]) -> pa.RecordBatch:
        n, own = np.concatenate(sizes), np.concatenate(targets)
        values, at, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order))
        numbers = number[at]
        one = lambda x, kind: pa.array([x], kind)
        columns = [*(one(int(x), pa.int64()) for x in (n.sum(), (n > 0).sum(), n[own].sum(), (n[own] > 0).sum())), one(planes(values[order], 8), pa.binary()), one(planes(numbers, NUMBER), pa.binary())]
        both = pa.concat_arrays(ids)
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        columns += [whole(both), whole(pa.array(own)), whole(pa.array(n.astype(np.int32)))]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, held, kept = Splitter(BETWEEN_BLANKS), 0, ([], [], [], [])
        for b in batches:
            own = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for first, data, offsets in pieces(b.column(1)):
                found, starts, _ = splitter.of(data, offsets)
                n = np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=len(offsets) - 1)
                for x, to in zip((b.column(0).slice(first, len(n)), own[first : first + len(n)], n, found), kept, strict=True):
                    to.append(x)
                held += len(found)
                if held >= BLOCK_TOKENS:
                    yield block(*kept)
                    held, kept = 0, ([], [], [], [])
        if kept[0]:
            yield block(*kept)

    return written(marked.select("doc_id", "text", "target").mapInArrow(run, BLOCK).withColumn("block", F.monotonically_increasing_id()))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash, by its leading 32 bits: up to 2^32 parts of like sizes."""
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


class Keys:
    """Distinct keys and their counts, in the order of (part, key)."""

    def __init__(self, hashes: np.ndarray, n: np.ndarray, n_target: np.ndarray, parts: int):
        part, key = part_of(hashes, parts), hashes & np.uint64((1 << 48) - 1)
        self.order = np.lexsort([key, part])
        self.part, self.first = np.unique(part[self.order], return_index=True)
        self.key, self.n, self.n_target = key[self.order], n[self.order], n_target[self.order]

    def requests(self, width: int = 1) -> Iterator[tuple[int, bytes, bytes, bytes, list[int]]]:
        """(part // width, keys, n, n_target, keys of each of the `width` parts) of the parts that there are keys for."""
        edges = np.append(self.first, len(self.key))
        coarse, at = np.unique(self.part // width, return_index=True)
        for part, low, high in zip(coarse.tolist(), at.tolist(), [*at[1:].tolist(), len(self.part)], strict=True):
            a, b, sizes = edges[low], edges[high], np.zeros(width, np.int64)
            sizes[self.part[low:high] % width] = np.diff(edges[low : high + 1])
            yield part, planes(self.key[a:b], KEY), planes(self.n[a:b], NUMBER), planes(self.n_target[a:b], NUMBER), sizes.tolist()


class Counts:
    """A block's distinct words and bigrams, and what its tokens are of them."""

    def __init__(self, words: np.ndarray, numbers: np.ndarray, own: np.ndarray, sizes: np.ndarray, parts: int):
        end = len(words)
        self.sizes = np.where(sizes > 0, sizes + 1, 0).astype(np.int64)
        token = np.full(int(self.sizes.sum()), end, np.int64)
        inside = np.ones(len(token), bool)
        inside[np.cumsum(self.sizes)[sizes > 0] - 1] = False
        token[inside] = numbers
        before = np.append(end, token[:-1])[: len(token)]
        owned = np.repeat(own, self.sizes)
        grams, self.at = np.unique(before * (end + 1) + token, return_inverse=True)
        self.before, self.word = grams // (end + 1), grams % (end + 1)
        hashes = np.append(words.view(np.uint64), END)[: end + 1 if len(token) else 0]
        count = lambda x, n, weights=None: np.bincount(x, weights, n).astype(np.int64)
        k = len(hashes)
        self.singles = Keys(mix(hashes), count(token, k), count(token, k, owned), parts)
        pairs = mix(hashes[self.before] * HISTORY + hashes[self.word] * WORD)
        self.pairs = Keys(pairs, count(self.at, len(grams)), count(self.at, len(grams), owned), parts)

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch, row: int, parts: int) -> Counts:
        value = lambda c: table[c][row].values.to_numpy(zero_copy_only=False)
        return cls(numbers_of(table["words"][row].as_py(), 8), numbers_of(table["numbers"][row].as_py(), NUMBER), value("targets").astype(bool), value("sizes"), parts)

    def losses(self, singles: np.ndarray, pairs: np.ndarray, total: float, kinds: int) -> np.ndarray:
        """Each document's mean loss under the model with these counts, which are in the order of the keys."""
        single, pair = np.empty(len(singles)), np.empty(len(pairs))
        single[self.singles.order], pair[self.pairs.order] = singles, pairs
        means = np.zeros(len(self.sizes))
        some = self.sizes > 0
        if some.any():
            p = (single[self.word] + 1.0) / (total + kinds)
            loss = -np.log((pair + MU * p) / (single[self.before] + MU))
            means[some] = np.add.reduceat(loss[self.at], (np.cumsum(self.sizes) - self.sizes)[some]) / self.sizes[some]
        return means


def requests(blocks: DataFrame, parts: int, pairs: bool, width: int = 1) -> DataFrame:
    """(ASKED): each block's distinct words, or bigrams, and counts, by part of the table, or by `width` neighbouring parts together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                counts = Counts.of(b, row, parts)
                sent = list(zip(*(counts.pairs if pairs else counts.singles).requests(width), strict=True)) or [()] * 5
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()))
                part, *lists = (pa.array(x, kind) for x, kind in zip(sent, kinds, strict=True))
                yield pa.RecordBatch.from_arrays([part, pa.array([b["block"][row].as_py()] * len(part), pa.int64()), *lists], [c.split()[0] for c in ASKED.split(", ")])

    found = blocks.select("block", "words", "numbers", "targets", "sizes").mapInArrow(run, ASKED)
    return found if width > 1 else found.drop("sizes")


def in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("block")


def gathered(asked: DataFrame, width: int) -> DataFrame:
    """(part, block, keys, n, n_target): what a group of blocks asks of each part, in one row; `block` is the group.

    asked: rows for `width` parts together, with their `group`.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows, out = in_order(rows), []
        ends = np.cumsum(np.array(rows["sizes"].to_pylist(), np.int64).reshape(-1, width), axis=1)
        columns = [[numbers_of(x, size) for x in rows[c].to_pylist()] for c, size in (("keys", KEY), ("n", NUMBER), ("n_target", NUMBER))]
        for w in range(width):
            spans = [(e[w - 1] if w else 0, e[w]) for e in ends.tolist()]
            if any(a < b for a, b in spans):
                own = [np.concatenate([x[a:b] for x, (a, b) in zip(c, spans, strict=True)]) for c in columns]
                out.append((key[1].as_py() * width + w, key[0].as_py(), *(planes(x, size) for x, size in zip(own, (KEY, NUMBER, NUMBER), strict=True))))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 3]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["part", "block", "keys", "n", "n_target"])

    return asked.groupBy("group", "part").applyInArrow(run, "part int, block long, keys binary, n binary, n_target binary")


def dealt_back(asked: DataFrame, answers: DataFrame, width: int, pairs: bool) -> DataFrame:
    """(SUMS) of each block, from those of groups of blocks: the inverse of `gathered`."""

    def run(_key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = in_order(rows)
        sizes = np.array(rows["sizes"].to_pylist(), np.int64).reshape(-1, width)
        out = {}
        for c in ("n", "n_target"):
            cells: list[list[np.ndarray]] = [[] for _ in range(len(sizes))]
            for part, raw in sorted(zip(found["part"].to_pylist(), found[c].to_pylist(), strict=True)):
                edges = np.append(0, np.cumsum(sizes[:, part % width])).tolist()
                sums = numbers_of(raw, COUNT)
                for cell, a, b in zip(cells, edges, edges[1:], strict=False):
                    cell.append(sums[a:b])
            out[c] = pa.array([planes(np.concatenate(x), COUNT) for x in cells], pa.binary())
        same = lambda x, kind: pa.array([x] * len(sizes), kind)
        return pa.table({"block": rows["block"], "part": rows["part"], "pairs": same(pairs, pa.bool_()), "n": out["n"], "n_target": out["n_target"], "kinds": same(0, pa.int64())})

    sent = asked.select("group", "part", "block", "sizes").groupBy("group", "part")
    return sent.cogroup(answers.withColumn("of", F.floor(F.col("part") / width).cast("int")).groupBy("block", "of")).applyInArrow(run, SUMS)


def answered(blocks: DataFrame, n_blocks: int, parts: int, pairs: bool) -> tuple[DataFrame, DataFrame]:
    """(SUMS) of each block, and the sums by part with their `kinds`.

    Up to ROUTED parts, each block asks each part. Beyond, blocks ask `width` parts at once, and groups of blocks ask each part, so that for B
    blocks and parts there are about 2 B^1.5 rows instead of B^2.
    """
    if parts <= ROUTED:
        sums = add_up(requests(blocks, parts, pairs), pairs)
        sums = sums if pairs else written(sums)  # words are read twice: for their kinds, and by the blocks
        return sums, sums
    width, groups = max(2, math.isqrt(parts)), max(1, math.isqrt(n_blocks))
    asked = requests(blocks, parts, pairs, width).withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("long"))
    sums = written(add_up(gathered(asked, width), pairs))
    return dealt_back(asked, sums, width, pairs), sums


def add_up(asked: DataFrame, pairs: bool) -> DataFrame:
    """(SUMS): the sums over all blocks, in the order of each request's keys; kinds: distinct keys of the part."""

    def run(group: pa.Table) -> pa.Table:
        keys = [numbers_of(x, KEY) for x in group["keys"].to_pylist()]
        values, at = np.unique(np.concatenate(keys), return_inverse=True)
        edges = np.append(0, np.cumsum([len(x) for x in keys])).tolist()

        def sums(c: str) -> pa.Array:
            found = np.bincount(at, np.concatenate([numbers_of(x, NUMBER) for x in group[c].to_pylist()]), len(values)).astype(np.int64)[at]
            return pa.array([planes(found[a:b], COUNT) for a, b in zip(edges, edges[1:], strict=False)], pa.binary())

        same = lambda x, kind: pa.array([x] * len(keys), kind)
        return pa.table({"block": group["block"], "part": group["part"], "pairs": same(pairs, pa.bool_()), "n": sums("n"), "n_target": sums("n_target"), "kinds": same(len(values), pa.int64())})

    return asked.groupBy("part").applyInArrow(run, SUMS)


def score_documents(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row for each document: tokens (with its end), mean losses in nats under both models, and their difference."""
    ensure_workers(docs.sparkSession)
    blocks = encode(mark_target(docs, target))
    sums = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "ends", "target_tokens", "target_ends")), F.count(F.lit(1))).first()
    totals, parts = (sums[0] + sums[1], sums[2] + sums[3]), max(1, sums[4], -(-(sums[0] + sums[1]) // BLOCK_TOKENS))
    singles, by_part = answered(blocks, sums[4], parts, False)
    kinds = by_part.groupBy("part").agg(F.max("kinds").alias("kinds")).agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    answers = singles.union(answered(blocks, sums[4], parts, True)[0])

    def run(_key: tuple, group: pa.Table, found: pa.Table) -> pa.Table:
        c = Counts.of(group, 0, parts)
        found = sorted(zip(*(found[x].to_pylist() for x in ("pairs", "part", "n", "n_target")), strict=True))
        none = np.zeros(0, np.int64)
        counts = lambda pairs, i: np.concatenate([none, *(numbers_of(r[i], COUNT) for r in found if r[0] == pairs)])
        background, own = (c.losses(counts(False, 2 + k), counts(True, 2 + k), totals[k], kinds) for k in (0, 1))
        column = lambda x: pa.array(x, pa.float64(), mask=c.sizes == 0)
        return pa.table({"doc_id": group["doc_ids"].combine_chunks().flatten(), "n_tokens": pa.array(c.sizes), "loss_target": column(own), "loss_background": column(background), "score": column(background - own)})

    sent = blocks.select("block", "words", "numbers", "targets", "sizes", "doc_ids")
    return sent.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, RESULT)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores against documents that are labelled as good, rounded to six places."""
    scored = score_documents(docs, labels.where(F.col("quality") == 1).select("doc_id"))
    return scored.withColumns({c: F.round(c, 6) for c in ("loss_target", "loss_background", "score")})


#: The same counts and formulas, plainly. Losses are rounded on both sides, as sums run in another order.
ORACLE_SQL = r"""
WITH good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
docs AS (
  SELECT row_number() OVER () AS row, d.doc_id, g.doc_id IS NOT NULL AS own,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') AS words
  FROM documents d LEFT JOIN good g ON d.doc_id = g.doc_id),
tokens AS (
  SELECT row, own, unnest(list_append(words, '')) AS w, generate_subscripts(list_append(words, ''), 1) AS i FROM docs WHERE len(words) > 0),
pairs AS (SELECT row, own, w, coalesce(lag(w) OVER (PARTITION BY row ORDER BY i), '') AS h FROM tokens),
single AS (SELECT w, count(*)::DOUBLE AS n, count(*) FILTER (own)::DOUBLE AS n_own FROM pairs GROUP BY w),
both_ AS (SELECT h, w, count(*)::DOUBLE AS n, count(*) FILTER (own)::DOUBLE AS n_own FROM pairs GROUP BY h, w),
total AS (SELECT sum(n) AS n, sum(n_own) AS n_own, count(*)::DOUBLE AS v FROM single),
p AS (
  SELECT b.h, b.w,
    -ln((b.n + 100 * (s.n + 1) / (t.n + t.v)) / (h.n + 100)) AS loss_background,
    -ln((b.n_own + 100 * (s.n_own + 1) / (t.n_own + t.v)) / (h.n_own + 100)) AS loss_target
  FROM both_ b JOIN single s ON b.w = s.w JOIN single h ON b.h = h.w, total t)
SELECT doc_id, (CASE WHEN len(words) > 0 THEN len(words) + 1 ELSE 0 END)::BIGINT AS n_tokens, round(x.loss_target, 6) AS loss_target, round(x.loss_background, 6) AS loss_background, round(x.score, 6) AS score
FROM docs LEFT JOIN (
  SELECT row, avg(loss_target) AS loss_target, avg(loss_background) AS loss_background, avg(loss_background - loss_target) AS score
  FROM pairs JOIN p USING (h, w) GROUP BY row) x USING (row)
"""
