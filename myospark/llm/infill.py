"""Fill-in-the-middle transformation (Bavarian et al., 2022) over succinct rank and select.

Texts stay UTF-8 bytes. A bit for each byte tells whether a code point begins there; the bits are packed, and a directory has how
many ones come before each block of BLOCK bytes. The ones between a text's ends are its number of code points, n, and a cut at code point k
is the place of one number k, found by binary search in the directory and a count inside one block: no text is decoded or indexed.

Draws are taken from a hash of the id: where the two cuts are, whether the text stays plain, and the order of the parts. Texts that are empty
or contain a sentinel stay plain, so `restored` gives back every text from its output and form alone.

A null text is an empty one; a null doc_id draws like the empty string. Repeated rows give equal results. A text of any length is
transformed whole; the directory adds an eighth of its bytes. An empty table gives an empty table. Columns of docs are carried along, and
results get other names where docs has theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from myospark.llm.spread import fresh
from myospark.llm.words import pieces
from myospark.session import ensure_workers

#: Sentinels before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred texts, so many are transformed, and of a hundred of these so many start with the suffix.
RATE, SPM_RATE, SEED = 90, 20, 1
#: Bytes of packed bits in a block of the directory; bytes of texts looked at together, about.
BLOCK, PIECE = 64, 1 << 20

RESULT = ["n", "form", "prefix_chars", "middle_chars", "output"]


def byte_select() -> np.ndarray:
    """For each byte and k, where its one number k is (lowest bit first)."""
    table = np.zeros((256, 8), np.int64)
    for value in range(256):
        ones = [i for i in range(8) if value >> i & 1]
        table[value, : len(ones)] = ones
    return table


SELECT = byte_select()


class Boundaries:
    """Where code points begin in UTF-8 bytes, as packed bits with a directory of popcounts."""

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        packed = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        blocks = len(packed) // BLOCK + 1  # the last one is never full
        self.bits = np.zeros(blocks * BLOCK, np.uint8)
        self.bits[: len(packed)] = packed
        self.bits = self.bits.reshape(blocks, BLOCK)
        self.before = np.zeros(blocks + 1, np.int64)
        np.cumsum(np.bitwise_count(self.bits).sum(1, dtype=np.int64), out=self.before[1:])

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that begin before each place."""
        block, rest = at // (8 * BLOCK), at % (8 * BLOCK)
        own = self.bits[block]
        whole, bits = rest // 8, (rest % 8).astype(np.uint8)
        counts = np.bitwise_count(own).astype(np.int64)
        counts[np.arange(BLOCK) >= whole[:, None]] = 0
        last = own[np.arange(len(at)), whole] & ((np.uint8(1) << bits) - np.uint8(1))
        return self.before[block] + counts.sum(1) + np.bitwise_count(last)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Where code point number k begins (from 0); the end for k = total."""
        block = np.minimum(np.searchsorted(self.before, k, "right") - 1, len(self.bits) - 1)
        own, rest = self.bits[block], k - self.before[block]
        sums = np.cumsum(np.bitwise_count(own), axis=1, dtype=np.int64)
        at = np.minimum((sums <= rest[:, None]).sum(1), BLOCK - 1)
        row = np.arange(len(k))
        rest = rest - np.where(at > 0, sums[row, at - 1], 0)
        found = block * 8 * BLOCK + 8 * at + SELECT[own[row, at], np.minimum(rest, 7)]
        return np.where(k >= self.total, self.size, found)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers of an id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12)]


def transform(doc_ids: list[int | None], texts: pa.Array, rate: int, spm_rate: int, seed: int) -> list[tuple[int, str, int | None, int | None, bytes]]:
    """(n, form, prefix_chars, middle_chars, output) of each text."""
    out = []
    for first, data, offsets in pieces(texts, PIECE):
        marks = Boundaries(data)
        base = marks.rank(offsets)
        n = np.diff(base)
        h = np.array([draws(i, seed) for i in doc_ids[first : first + len(n)]], np.int64).reshape(-1, 4)
        low, high = np.sort(h[:, :2] % (n + 1)[:, None], axis=1).T
        cuts = marks.select(np.concatenate([base[:-1] + low, base[:-1] + high])).reshape(2, -1).tolist()
        rows = zip(offsets.tolist(), offsets[1:].tolist(), *cuts, n.tolist(), low.tolist(), high.tolist(), h[:, 2].tolist(), h[:, 3].tolist(), strict=False)
        for a, b, p, m, size, k, l, h3, h4 in rows:
            text = data[a:b].tobytes()
            if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
                out.append((size, "plain", None, None, text))
                continue
            prefix, middle, suffix = text[: p - a], text[p - a : m - a], text[m - a :]
            spm = h4 % 100 < spm_rate
            both = SUFFIX + suffix + PREFIX + prefix if spm else PREFIX + prefix + SUFFIX + suffix
            out.append((size, "spm" if spm else "psm", k, l - k, both + MIDDLE + middle))
    return out


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """docs with n (code points), form (plain, psm or spm), prefix_chars, middle_chars and output, the transformed text. Narrow: no shuffle.

    Where docs has a column of a result's name, the result's gets an underscore.
    """
    ensure_workers(docs.sparkSession)
    names = [fresh(docs, c) for c in RESULT]
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(names, kinds, strict=True))])
    at, own = docs.columns.index(text), docs.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = transform(b.column(own).to_pylist(), b.column(at), rate, spm_rate, seed)
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ([],) * 5
            made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed. No part contains a sentinel, so the first ones are those that were put there."""
    parts = lambda marks: F.split(F.substr(output, F.lit(len(PREFIX) + 1)), marks, 3)
    psm, spm = parts(f"{SUFFIX.decode()}|{MIDDLE.decode()}"), parts(f"{PREFIX.decode()}|{MIDDLE.decode()}")
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def infill_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, the lengths of prefix and middle, and digests of the output and of the text restored from it."""
    done = fill_in_middle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, least(('0x' || h[1:8])::BIGINT % (n + 1), ('0x' || h[9:16])::BIGINT % (n + 1)) AS p, greatest(('0x' || h[1:8])::BIGINT % (n + 1), ('0x' || h[9:16])::BIGINT % (n + 1)) AS m,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM docs)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || substr(text, 1, p) || '<S>' || substr(text, m + 1) || '<M>' || substr(text, p + 1, m - p)
    ELSE '<S>' || substr(text, m + 1) || '<P>' || substr(text, 1, p) || '<M>' || substr(text, p + 1, m - p) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM drawn
"""
