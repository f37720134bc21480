"""Lexical retrieval packing into training sequences.

Documents are tokenised and cut into whole windows; what is left of each is packed. Remainders are dealt into shards of
bounded size, each with its own BM25 inverted index over token ids. In a shard, a seed document opens a window; the
index is asked with all its distinct token ids and returns its unused neighbours, best first (of equal scores, the first in
the shard), which fill the window greedily; the neighbour that overflows is cut,
and its rest opens the next window. So only a shard's last window has padding.

Shards keep documents together that share token shingles (by the least hash of the whole text), so copies and overlapping texts are
neighbours; a shard above the bound is split by document. Document frequencies are counted over all remainders.

A null text is an empty one (its only token is the end). Null ids and repeated rows are packed like others. A text of any
length is cut into whole windows and one remainder. Columns other than key and text may have any names. An empty table
gives an empty table.
"""

from __future__ import annotations

import codecs
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from myospark.llm.words import Splitter, hashed, looked_up, mix, pieces, powers
from myospark.session import cut, ensure_workers, give_back, kept

WINDOW, END = 4096, 2
#: Tokens of one shard, about; token ids are below VOCABULARY.
SHARD_TOKENS, VOCABULARY = 1 << 21, 1 << 16
#: BM25's constants; terms held by more than one in DENSE of a shard's documents are kept as columns of a matrix.
K1, B, DENSE = 1.2, 0.75, 16
SHINGLE = 8
#: Ranges that are split are broadcast up to this number.
BROADCAST_RANGES = 100_000
#: Words whose ids a worker remembers from task to task (30 bytes each); bytes of texts encoded together, about; words asked for in one call.
REMEMBERED, ENCODED, ASKED = 1_000_000, 1 << 19, 512

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, score double"


#: ASCII characters that are neither letters, digits nor blanks.
MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())
#: Kinds of bytes, in bits: ASCII letters, those marks, second bytes of À to ÿ but × and ÷, and of these those of capitals. A-Z in lower case.
LETTER, MARK, SECOND, CAPITAL = 1, 2, 4, 8
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
KINDS[list(MARKS.encode())] = MARK
KINDS[0x80:0xC0] = SECOND
KINDS[0x80:0x9F] |= CAPITAL
KINDS[[0x97, 0xB7]] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Marks behind a word that are taken from it; words with more are remembered whole.
BEHIND = 8
#: The byte-level alphabet: printable bytes stand for themselves, the others, in turn, for characters from 256 on.
PRINTABLE = [i for i in range(256) if 33 <= i <= 126 or 161 <= i and i != 173]
ALPHABET = {i: i for i in PRINTABLE} | {b: 256 + n for n, b in enumerate(i for i in range(256) if i not in PRINTABLE)}
#: The same for lines, each a word.
LINES = "".join(chr(ALPHABET[i]) if i != 10 else "\n" for i in range(256))
#: Words on which the short way must agree with the tokenizer before it is taken.
PROBES = ["the", "École", "straße", "Ñandú", "antidisestablishment", "qqzx", "Über!?", "word,"]


class Table:
    """Ids of words by hash: a large sorted part and a small one, looked up by sorted hashes."""

    def __init__(self) -> None:
        none = np.zeros(0, np.int64)
        self.parts = [(none.astype(np.uint64), none, none)] * 2
        self.flat = np.zeros(0, np.uint16)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word begin in `flat`, and how many there are; -1 for unknown words."""
        first, n = np.zeros(len(values), np.int64), np.full(len(values), -1, np.int64)
        for h, f, k in self.parts:
            if len(h):
                at = np.minimum(np.searchsorted(h, values), len(h) - 1)
                hit = h[at] == values
                first[hit], n[hit] = f[at[hit]], k[at[hit]]
        return first, n

    def add(self, values: np.ndarray, found: list[bytes]) -> None:
        if len(self.parts[0][0]) > REMEMBERED:  # forget all but the latest
            self.__init__()
        n = np.array([len(f) // 2 for f in found], np.int64)
        new = values, len(self.flat) + np.cumsum(n) - n, n
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(found) or b"", np.uint16)])
        self.parts[1] = self._merged(self.parts[1], new)
        if 4 * len(self.parts[1][0]) > len(self.parts[0][0]):
            self.parts = [self._merged(*self.parts), tuple(x[:0] for x in self.parts[1])]

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        both = [np.concatenate(x) for x in zip(a, b, strict=True)]
        order = np.argsort(both[0], kind="stable")  # two sorted runs
        return tuple(x[order] for x in both)


class Encoder:
    """Token ids of texts. Blanks and line feeds part tokens, so the ids of what stands between them are remembered;
    of Latin letters with marks behind them, the ids of the letters in lower case and of the marks.

    Words of Latin letters go to the tokenizer's model without its normaliser and regular expressions: many at once, in lower case and in
    the byte-level alphabet. If that isn't what the tokenizer does, all go through it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model = tokenizer.encode, Tokenizer(tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit("\n")
        self.table = Table()
        self.splitter = Splitter(~np.isin(np.arange(256), [32, 10]), lower=False)
        self.short = True
        probes = np.frombuffer(" ".join(PROBES).encode(), np.uint8)
        self.short = self.of(probes, np.array([0, len(probes)]))[0][:-1].tobytes() == b"".join(map(self.whole, PROBES))
        self.table = Table()

    def whole(self, word: str) -> bytes:
        return array("H", self.encode(word, add_special_tokens=False).ids).tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Words without line feeds."""
        if not self.short:
            return [self.whole(w) for w in words]
        lows = [w.lower() if w.isalpha() else "" for w in words]
        lows = [x if x.isascii() or max(x) < "\u0100" else "" for x in lows]
        asked = [x for x in lows if x]
        found = chain.from_iterable(self.heads(asked[i : i + ASKED]) for i in range(0, len(asked), ASKED))
        return [next(found) if x else self.whole(w) for w, x in zip(words, lows, strict=True)]

    def heads(self, heads: list[str]) -> list[bytes]:
        """Ids of words of Latin letters in lower case, from one call of the model."""
        found = self.model.encode(codecs.charmap_decode("\n".join(heads).encode(), "strict", LINES)[0], add_special_tokens=False)
        ids, stops = np.array(found.ids, np.uint16).tobytes(), (2 * np.cumsum(np.bincount(found.word_ids, minlength=len(heads)))).tolist()
        return [ids[a:z] for a, z in zip([0, *stops], stops)]  # noqa: B905

    def parted(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """data with words of Latin letters in lower case, and where words and the marks behind such words start and stop."""
        starts, stops = self.splitter.spans(data, offsets)
        if not self.short:
            return data, starts, stops
        kinds = looked_up(KINDS, data)
        second = np.zeros(len(data), bool)  # bytes of letters of two
        second[1:] = (data[:-1] == 0xC3) & (kinds[1:] & SECOND > 0)
        second[offsets[offsets < len(data)]] = False
        odd = (kinds != LETTER) & ~second  # not of letters
        odd[:-1] &= ~second[1:]
        ends, some = stops.copy(), np.arange(len(stops))
        for _ in range(BEHIND):
            some = some[(ends[some] > starts[some]) & (kinds[ends[some] - 1] == MARK)]
            ends[some] -= 1
        n = np.zeros(len(data) + 1, np.int32)
        np.cumsum(odd, out=n[1:])
        latin = (ends > starts) & (n[ends] == n[starts])
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[latin]] += 1
        inside[ends[latin]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        low = np.where(inside, looked_up(LOWER, data), data)
        low[np.flatnonzero(second & inside & (kinds & CAPITAL > 0))] += 32
        cuts = ends[latin & (ends < stops)]
        return low, *(np.sort(np.append(x, cuts)) for x in (starts, stops))

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """16-bit ids of all texts data[offsets[i]:offsets[i + 1]] in turn, each with its end, and how many each has."""
        if not len(data):
            return np.full(len(offsets) - 1, END, np.uint16), np.ones(len(offsets) - 1, np.int64)
        raw, starts, stops = self.parted(data, offsets)
        values, at = np.unique(hashed(raw, starts, stops), return_inverse=True)
        first, size = self.table.find(values)
        if len(new := np.flatnonzero(size < 0)):
            last = np.zeros(len(values), np.int64)
            last[at] = np.arange(len(at))
            raw = raw.tobytes()
            words = b"\n".join([raw[a:z] for a, z in zip(starts[last[new]].tolist(), stops[last[new]].tolist(), strict=True)])
            self.table.add(values[new], self.words(words.decode("utf-8", "replace").split("\n")))
            first, size = self.table.find(values) if len(self.table.flat) else (first, size)
            if (size < 0).any():  # the table was full, and forgot
                return self.of(data, offsets)
        n, text = size[at], np.searchsorted(offsets, starts, "right") - 1
        total = np.bincount(text, n, len(offsets) - 1).astype(np.int64) + 1
        out = np.full(int(total.sum()), END, np.uint16)
        run = np.arange(int(n.sum()))
        begin = np.cumsum(n) - n
        out[np.repeat(text, n) + run] = self.table.flat[np.repeat(first[at] - begin, n) + run]
        return out, total


def encoder_of(path: str) -> Encoder:
    """This process's encoder."""
    return kept(path, lambda: Encoder(path))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def shingle_hashes(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The least hash of SHINGLE ids in a row in each run of ids, spread evenly over 31 bits; shorter runs are hashed whole."""
    up, down = powers(len(ids) + 1)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    stops = np.minimum(np.arange(len(ids)) + SHINGLE, np.repeat(starts + sizes, sizes))
    hashes = mix((sums[stops] - sums[:-1]) * down[:-1])
    whole = np.arange(len(ids)) - np.repeat(starts, sizes) <= np.repeat(np.maximum(sizes - SHINGLE, 0), sizes)
    return (mix(np.minimum.reduceat(np.where(whole, hashes, np.uint64((1 << 64) - 1)), starts)) >> np.uint64(33)).astype(np.int64)


def tokenize(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, doc_tokens, start, ids): whole windows and remainders, `near` for remainders only."""
    schema = "doc_id long, doc_tokens long, start long, length int, near int, ids_crc32 long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(path)
        encoder = encoder_of(path)
        for b in batches:
            for begin, data, offsets in pieces(b.column(1), ENCODED):
                ids, sizes = encoder.of(data, offsets)
                starts = np.cumsum(sizes) - sizes
                near = shingle_hashes(ids, starts, sizes).tolist()
                out = []
                for doc, a, n, h in zip(b.column(0).slice(begin, len(sizes)).to_pylist(), starts.tolist(), sizes.tolist(), near, strict=True):
                    whole = n - n % WINDOW
                    out += [(doc, n, i, WINDOW, None, crc(ids[a + i : a + i + WINDOW]), None) for i in range(0, whole, WINDOW)]
                    if whole < n:
                        out.append((doc, n, whole, n - whole, h, None, ids[a + whole : a + n].tobytes()))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, schema)


def term_weights(remainders: DataFrame) -> tuple[np.ndarray, float]:
    """BM25's inverse document frequency of every token id, and the mean length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, total = np.zeros(VOCABULARY, np.int64), 0, 0
        for b in batches:
            parts = [np.frombuffer(x, np.uint16) for x in b.column(0).to_pylist()]
            n, total = n + len(parts), total + sum(map(len, parts))
            for i in range(0, len(parts), 256):
                some = parts[i : i + 256]
                both = np.sort(np.repeat(np.arange(len(some), dtype=np.uint32), [len(x) for x in some]) << np.uint32(16) | np.concatenate(some))
                once = both[np.append(True, both[1:] != both[:-1])]
                held += np.bincount(once & np.uint32(0xFFFF), minlength=VOCABULARY)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1, -2], pa.int32()), pa.array([*held[some].tolist(), n, total], pa.int64())], ["id", "n"])

    counts = remainders.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most 65,538 rows
    found = dict(zip(counts["id"].to_pylist(), counts["n"].to_pylist(), strict=True))
    n, total = found.pop(-1, 0), found.pop(-2, 0)
    held = np.zeros(VOCABULARY)
    held[list(found)] = list(found.values())
    return np.log1p((n - held + 0.5) / (held + 0.5)), total / max(n, 1)


class Index:
    """A shard's inverted index: for each token id the documents that hold it, with their BM25 weights.

    Ids that many documents hold are columns of a matrix instead of lists; scores are sums of both.
    """

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = n = len(ids)
        sizes = np.array([len(x) for x in ids])
        owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
        terms, times = np.unique(np.concatenate(ids).astype(np.int64) * n + owner, return_counts=True)
        doc, term = terms % n, terms // n
        norm = K1 * (1 - B + B * sizes[doc] / max(mean, 1.0))
        weight = (idf[term] * times * (K1 + 1) / (times + norm)).astype(np.float32)
        held = np.bincount(term, minlength=VOCABULARY)
        column = np.cumsum(held > n // DENSE) - 1
        often = held[term] > n // DENSE
        self.matrix = np.zeros((int(column[-1]) + 1, n), np.float32)
        self.matrix[column[term[often]], doc[often]] = weight[often]
        rare = ~often
        self.doc, self.weight = doc[rare], weight[rare].astype(np.float64)
        self.first = np.searchsorted(term[rare], np.arange(VOCABULARY + 1))
        by_doc = np.argsort(doc, kind="stable")
        starts = np.searchsorted(doc[by_doc], np.arange(n + 1))
        term, often = term[by_doc], often[by_doc]
        spans = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
        self.rare = [term[a:b][~often[a:b]] for a, b in spans]
        self.often = [column[term[a:b][often[a:b]]] for a, b in spans]

    def scores(self, seed: int) -> np.ndarray:
        out = self.matrix[self.often[seed]].sum(axis=0).astype(np.float64) if len(self.often[seed]) else np.zeros(self.n)
        a, b = self.first[self.rare[seed]], self.first[self.rare[seed] + 1]
        size = b - a
        if total := int(size.sum()):
            at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(total)
            out += np.bincount(self.doc[at], self.weight[at], self.n)
        return out


def fill(sizes: list[int], index: Index) -> Iterator[tuple[int, int, int, int, int, float]]:
    """(document, start, length, window, offset, score) of each piece. Every document is used once, whole or cut up."""
    free, window, offset, cut_at = np.ones(len(sizes), bool), 0, 0, None
    unused = iter(range(len(sizes)))

    def neighbours(seed: int) -> Iterator[tuple[int, int, float]]:
        scores = index.scores(seed)
        some = np.flatnonzero(free)
        for d in some[np.argsort(-scores[some], kind="stable")].tolist():
            free[d] = False
            yield d, 0, float(scores[d])

    while True:
        if cut_at is None:
            seed = next((d for d in unused if free[d]), None)
            if seed is None:
                return
            free[seed] = False
            cut_at = seed, 0
        for d, at, score in chain([(*cut_at, 0.0)], neighbours(cut_at[0])):
            length = min(sizes[d] - at, WINDOW - offset)
            yield d, at, length, window, offset, score
            offset += length
            if offset == WINDOW:
                window, offset = window + 1, 0
                cut_at = (d, at + length) if at + length < sizes[d] else None
                break
        else:
            return


def deal(rest: DataFrame, shard_tokens: int) -> DataFrame:
    """rest with `shard`: by least shingle hash, and by row where the documents of one range exceed the bound."""
    total = rest.agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    ranged = rest.withColumn("range", F.floor(F.col("near").cast("double") * F.lit(float(shards)) / F.lit(float(1 << 31))))
    large = ranged.groupBy("range").agg(F.ceil(F.sum("length") / F.lit(1.5 * shard_tokens)).alias("splits")).where("splits > 1")
    large = F.broadcast(large) if large.count() <= BROADCAST_RANGES else large
    split = F.pmod(F.xxhash64("row"), F.coalesce("splits", F.lit(1)))
    return ranged.join(large, "range", "left").withColumn("shard", F.col("range") * (1 << 16) + split).drop("range", "splits")


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each piece (PIECE). Whole windows of one document are sequences below 0, a shard's windows others."""
    ensure_workers(docs.sparkSession)
    pieces = cut(tokenize(docs, path, key, text).withColumn("row", F.monotonically_increasing_id()))
    whole, rest = pieces.where("ids is null"), pieces.where("ids is not null")
    idf, mean = term_weights(rest)

    def run(group: pa.Table) -> pa.Table:
        give_back(path)
        group = group.take(pa.array(np.lexsort([group[c].to_numpy() for c in ("row", "near")])))
        ids = [np.frombuffer(x, np.uint16) for x in group["ids"].to_pylist()]
        filled = list(zip(*fill([len(x) for x in ids], Index(ids, idf, mean)), strict=True))
        d, at, n, window, offset = (np.array(x, np.int64) for x in filled[:5])
        of = lambda c: group[c].combine_chunks().take(pa.array(d))  # noqa: E731  ids stay in Arrow: some are null
        sums = pa.array([crc(ids[i][a : a + k]) for i, a, k in zip(d.tolist(), at.tolist(), n.tolist(), strict=True)], pa.int64())
        first = group["shard"][0].as_py() << 20
        columns = [of("doc_id"), pa.array(of("start").to_numpy() + at), pa.array(n), sums, of("doc_tokens"), pa.array(first + window), pa.array(offset), pa.array(filled[5], pa.float64())]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in PIECE.split(", ")])

    packed = deal(rest, shard_tokens).select("shard", "doc_id", "start", "doc_tokens", "near", "row", "ids").groupBy("shard").applyInArrow(run, PIECE)
    single = whole.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0.0).alias("score"))
    return single.unionByName(packed)


def packing_report(docs: DataFrame) -> DataFrame:
    """pack() with the public 49k word tokenizer."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
