"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in whole texts. The value of each candidate is hashed and counted over the corpus by distinct
repositories and owners: values that many hold are copied examples; values that one owner holds in few places, and
that look random, look live. Each live-looking value is reported as a span of its own kind, beside the pattern's.

Nulls: a null text is an empty one; null owners or repositories count as one owner or repository. Repeated rows are
rows of their own. Texts of any length are scanned whole, one at a time. Columns beyond the named ones are ignored, whatever
their names. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from myospark.llm.spread import join_dealt
from myospark.session import cut, ensure_workers

#: The base patterns, over UTF-8 bytes. Letters of `assign` are of either case.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: Published prefixes of service tokens.
SERVICE = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
#: Spans that start together are listed in this order.
KINDS = ["assign", "access", "hex", "service", "live"]
LEAST_ASSIGN = 6

SPAN = "struct<start:long,kind:int,end:long>"
SCAN = f"doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<{SPAN}>, candidates array<struct<start:long,end:long,value:string,bits:double>>"


def entropy(value: bytes) -> float:
    """Bits of Shannon entropy a byte."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def find(text: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans (start, kind, end), and candidate values (start, end, kind), in bytes."""
    spans, values = [], []
    if b":" in text or b"=" in text:  # an assignment has one of them
        for m in ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= LEAST_ASSIGN:
                spans.append((m.start(), 0, m.end()))
                values.append((*m.span(1), 0))
    for kind, pattern, mark in ((1, ACCESS, b"AKIA"), (2, HEX, b""), (3, SERVICE, b"")):
        if mark in text:
            for m in pattern.finditer(text):
                spans.append((m.start(), kind, m.end()))
                values.append((*m.span(), kind))
    return sorted(spans), values


def code_points(text: bytes, at: list[int]) -> dict[int, int]:
    """Byte offsets as code point offsets."""
    out, last, chars = {}, 0, 0
    for x in sorted(set(at)):
        chars += len(text[last:x].decode("utf-8", "replace"))
        last = x
        out[x] = chars
    return out


def scan_text(text: bytes) -> tuple[list[int], str, list[dict], list[dict]]:
    spans, values = find(text)
    chars = code_points(text, [x for s in spans for x in (s[0], s[2])] + [x for v in values for x in v[:2]]) if spans else {}
    found = [{"start": chars[a], "kind": k, "end": chars[b]} for a, k, b in spans]
    base = ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in found if s["kind"] < 3)
    seen = {}
    for a, b, _ in values:
        seen.setdefault((a, b), {"start": chars[a], "end": chars[b], "value": hashlib.blake2b(text[a:b], digest_size=16).hexdigest(), "bits": entropy(text[a:b])})
    return [sum(s["kind"] == k for s in found) for k in range(3)], hashlib.sha256(base.encode()).hexdigest(), found, list(seen.values())


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row for each document, with its spans and hashed candidate values (SCAN)."""
    ensure_workers(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    value = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("bits", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan_text(t or b"") for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:3],
                    *(pa.array([r[0][k] for r in rows], pa.int64()) for k in range(3)),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], kind),
                    pa.array([r[3] for r in rows], value),
                ],
                ["doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "found", "candidates"],
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.col(text).cast("binary").alias("text")
    ).mapInArrow(run, SCAN)


def ownership(candidates: DataFrame) -> DataFrame:
    """value, n_owners, n_repositories, held (candidates). Counted by holder first, so that a value of a third of all rows is summed in parts."""
    holders = candidates.select("value", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"))
    pairs = holders.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = pairs.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("held"))


def find_secrets(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", most_owners: int = 1, most_repositories: int = 3, least_bits: float = 2.5) -> DataFrame:
    """One row for each document: counts, base digest, `found` (spans with kinds), n_live and n_copied.

    A value is live if at most `most_owners` owners hold it in at most `most_repositories` repositories and its
    characters have `least_bits` bits of entropy; it is copied if it is in more hands.
    """
    rows = cut(scan(docs, text, owner, repository).withColumn("row", F.monotonically_increasing_id()))
    each = rows.where(F.size("candidates") > 0).select("row", "owner", "repository", F.explode("candidates").alias("c")).select("row", "owner", "repository", "c.*")
    held = join_dealt(each, ownership(each), ["value"], "held", F.col("row"))
    few = (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)
    live = few & (F.col("bits") >= least_bits)
    span = F.struct(F.col("start"), F.lit(KINDS.index("live")).alias("kind"), F.col("end"))
    judged = held.groupBy("row").agg(F.collect_list(F.when(live, span)).alias("live"), F.count_if(live).alias("n_live"), F.count_if(~few).alias("n_copied"))
    spans = F.array_sort(F.concat("found", F.coalesce("live", F.expr(f"cast(array() as array<{SPAN}>)"))))
    return rows.join(judged, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("found"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied")
    )


def secret_report(docs: DataFrame) -> DataFrame:
    """find_secrets with `spans` as text: kind:start:end, joined by commas."""
    named = F.transform("found", lambda s: F.concat_ws(":", F.element_at(F.lit(KINDS), s["kind"] + 1), s["start"], s["end"]))
    return find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(named, ",").alias("spans"), "n_live", "n_copied")


#: Matches are placed by the lengths of what stands between them; then the same counts and thresholds.
ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner, coalesce(doc_id::VARCHAR, '') AS repository, coalesce(text, '') AS text FROM documents),
patterns AS (SELECT * FROM (VALUES
  (0, 'assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
  (1, 'access', '(AKIA[A-Z0-9]+)', 20), (2, 'hex', '([0-9a-f]+)', 24),
  (3, 'service', '(gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})', 1)) AS p(kind, name, pattern, least)),
matched AS (SELECT row, owner, repository, kind, name, least, string_split_regex(text, pattern) AS gaps, regexp_extract_all(text, pattern) AS hits, regexp_extract_all(text, pattern, 1) AS groups FROM docs, patterns),
listed AS (SELECT row, owner, repository, kind, name, least, unnest(list_transform(gaps, lambda x: len(x))) AS gap, unnest(list_transform(hits, lambda x: len(x))) AS size, unnest(groups) AS value, generate_subscripts(gaps, 1) AS i FROM matched WHERE len(hits) > 0),
placed AS (
  SELECT row, owner, repository, kind, name, least, size, value, (sum(gap + coalesce(size, 0)) OVER (PARTITION BY row, kind ORDER BY i))::BIGINT AS stop FROM listed),
spans AS (SELECT row, owner, repository, kind, name, stop - size AS start, stop, value FROM placed WHERE size IS NOT NULL AND len(value) >= least),
candidates AS (SELECT DISTINCT row, owner, repository, stop - len(value) AS start, stop, value FROM spans),
held AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM candidates GROUP BY value),
bits AS (
  SELECT value, -sum(n / len(value) * log2(n / len(value))) AS bits FROM (SELECT value, c, count(*)::DOUBLE AS n FROM (SELECT value, unnest(string_split(value, '')) AS c FROM held) GROUP BY value, c) GROUP BY value),
judged AS (SELECT row, start, stop, owners <= 1 AND repositories <= 3 AS few, owners <= 1 AND repositories <= 3 AND bits >= 2.5 AS live FROM candidates JOIN held USING (value) JOIN bits USING (value)),
said AS (SELECT row, start, kind, stop, name FROM spans UNION ALL SELECT row, start, 4, stop, 'live' FROM judged WHERE live),
joined AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS spans
  FROM said GROUP BY row),
counted AS (SELECT row, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT few) AS n_copied FROM judged GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM docs LEFT JOIN joined USING (row) LEFT JOIN counted USING (row)
"""
