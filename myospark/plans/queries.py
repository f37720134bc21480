"""The operators as queries over the driver's tables, and DuckDB SQL for the same results.

Series are users' events, matrices are embeddings by label, descriptions and raw counts come from parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from myospark.functions import columns as C
from myospark.functions.butterworth import Bandpass, design
from myospark.operators import filters, grids, layout, long_series, tracks
from myospark.session import ensure_checkpoints, ensure_workers, read
from myospark.sources import encode, headers, mat, source
from myospark.sources.files import decode_files

RATE = 2048.0
#: Order, cut-offs and rate of the filters that the queries use.
EVENTS_FILTER, MATRIX_FILTER = (4, 20.0, 450.0, 2048.0), (4, 20.0, 400.0, 1000.0)
CATALOG = [(0, "hd04mm0102", 7), (1, "HD08MM0303", 64), (2, "HD04MM0102", 99), (3, "HD12MM1305", 65)]
#: Descriptions of a recording of 40 channels for each 40 parts, in SQL of both engines.
DESCRIBED = """CASE p_partkey % 7
  WHEN 0 THEN concat('x HD', lpad(cast(4 + 4 * (p_partkey % 3) AS {text}), 2, '0'), 'MM', lpad(cast(p_size % 13 + 1 AS {text}), 2, '0'), lpad(cast(p_size % 5 + 1 AS {text}), 2, '0'), ' ', p_brand)
  WHEN 3 THEN concat('Requested Path ', p_name) WHEN 5 THEN concat('performed path ', p_name) ELSE p_type END"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def long(name: str, alias: str | None = None):
    return F.col(name).cast("long").alias(alias or name)


SERIES_SQL = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx, value FROM events"


@query(f"SELECT user_id, sample_idx, sample_idx::DOUBLE / 2048::DOUBLE AS t FROM ({SERIES_SQL})")
def time_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.number_rows(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])
    return rows.select("user_id", long("sample_idx"), C.time_axis(F.col("sample_idx"), RATE).alias("t"))


@query("""SELECT page_id, path, CASE regexp_extract(lower(path), '(\\.[^./]+)$', 1) WHEN '.mat' THEN 'mat' WHEN '.otb+' THEN 'otb' WHEN '.otb' THEN 'otb' WHEN '.otb4' THEN 'otb4' END AS file_type
FROM (SELECT page_id, concat('a.b/rec', page_id, list_extract(['.mat', '.OTB+', '.otb', '.Otb4', '.csv'], page_id % 5 + 1)) AS path FROM pages)""")
def suffix_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.lit([".mat", ".OTB+", ".otb", ".Otb4", ".csv"]), (F.col("page_id") % 5 + 1).cast("int"))
    rows = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("a.b/rec"), F.col("page_id").cast("string"), ending).alias("path"))
    return rows.withColumn("file_type", C.file_type(F.col("path")))


@query("SELECT p_partkey, (p_size * 100 - 2500)::DOUBLE * 4.8::DOUBLE / pow(2::DOUBLE, 16 + 8 * (p_partkey % 2)) * 1000::DOUBLE / CASE WHEN p_partkey % 4 = 0 THEN 1::DOUBLE ELSE (p_partkey % 4)::DOUBLE END AS mv FROM part")
def otb_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k, C.otb_scale(F.col("p_size") * 100 - 2500, k % 4, 16 + 8 * (k % 2)).alias("mv"))


@query("SELECT p_partkey, (p_size * 100 - 2500)::DOUBLE * (5::DOUBLE / pow(2::DOUBLE, 16 + 8 * (p_partkey % 2)) * 1000::DOUBLE / (1 + p_partkey % 3)::DOUBLE) AS mv FROM part")
def otb4_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k, C.otb4_scale(F.col("p_size") * 100 - 2500, F.lit(5.0), 16 + 8 * (k % 2), 1 + k % 3).alias("mv"))


@query("SELECT p_partkey, a * coalesce(c, a) AS gain FROM (SELECT p_partkey, (1 + p_partkey % 5)::DOUBLE AS a, CASE WHEN p_partkey % 3 <> 0 THEN p_size::DOUBLE END AS c FROM part)")
def effective_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    channel = F.when(k % 3 != 0, F.col("p_size").cast("double"))
    return read(spark, sf_dir, "part").select(k, C.effective_gain((1 + k % 5).cast("double"), channel).alias("gain"))


PARTS_OF = ["concat(' ', p_brand, ' ')", "CASE WHEN p_partkey % 4 = 0 THEN 'Not defined' WHEN p_partkey % 4 = 1 THEN ' Not defined ' ELSE p_type END", "CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN '  ' END", "p_name"]


@query(f"SELECT p_partkey, array_to_string(list_transform(list_filter([{', '.join(PARTS_OF)}], lambda x: x IS NOT NULL AND x <> '' AND lower(x) <> 'not defined' AND trim(x) <> ''), lambda x: trim(x)), '-') AS description FROM part")
def channel_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", C.channel_description(*map(F.expr, PARTS_OF)).alias("description"))


@query("SELECT p_partkey, printf('%s-%s-%s-ch%d', p_brand, p_type, p_name, p_size) AS description FROM part")
def otb4_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", C.track_description(*map(F.col, ("p_brand", "p_type", "p_name", "p_size"))).alias("description"))


STREAM = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]


@query(f"""SELECT l_suppkey, p % 4 AS channel_idx, p // 4 AS sample_idx, value FROM (
  SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(STREAM)}) - 1 AS p, count(*) OVER (PARTITION BY l_suppkey) AS n, l_quantity AS value FROM lineitem)
WHERE p < n - n % 4""")
def deinterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.number_rows(read(spark, sf_dir, "lineitem"), ["l_suppkey"], STREAM, "p").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_suppkey")))
    return layout.deinterleave(rows, "p", F.col("n"), 4).select("l_suppkey", long("channel_idx"), long("sample_idx"), F.col("l_quantity").alias("value"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, row_idx, col_idx, value): embeddings as matrices."""
    rows = layout.number_rows(read(spark, sf_dir, "embeddings"), ["label"], ["vec_id"], "row_idx")
    return rows.select("label", "row_idx", F.posexplode("embedding").alias("col_idx", "value"))


CELLS_SQL = "SELECT label, r AS row_idx, unnest(range(len(embedding))) AS col_idx, unnest(embedding)::DOUBLE AS value FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings)"


@query(f"SELECT label, CASE WHEN n < 64 THEN col_idx ELSE row_idx END AS row_idx, CASE WHEN n < 64 THEN row_idx ELSE col_idx END AS col_idx, value FROM ({CELLS_SQL}) JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label)")
def orient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.orient(cells(spark, sf_dir), ["label"]).select("label", long("row_idx"), long("col_idx"), F.col("value").cast("double").alias("value"))


@query("""WITH sized AS (SELECT n_regionkey, n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL),
ranged AS (SELECT *, sum(n) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS high FROM sized),
channels AS (SELECT n_regionkey, unnest(range(sum(n)::BIGINT)) AS channel_idx FROM sized GROUP BY n_regionkey)
SELECT c.n_regionkey, n_nationkey, channel_idx, (channel_idx - (high - n))::BIGINT AS local_idx FROM channels c JOIN ranged r ON c.n_regionkey = r.n_regionkey AND channel_idx >= high - n AND channel_idx < high""")
def track_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    sized = read(spark, sf_dir, "nation").join(sizes, F.col("n_nationkey") == F.col("s_nationkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return tracks.track_channels(sized, ["n_regionkey"], "n_nationkey", "n").select("n_regionkey", "n_nationkey", long("channel_idx"), long("local_idx"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) ON o_custkey = c_custkey AND n = 1")
def first_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return tracks.first_match(read(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey", "o_totalprice")


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(F.floor(k / 40).cast("long").alias("file_id"), (k % 40).cast("long").alias("channel_idx"), F.expr(DESCRIBED.format(text="string")).alias("description"))


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, grids.CATALOG)


PARSED_SQL = f"""SELECT file_id, channel_idx, description, nullif(regexp_extract(description, 'HD([0-9][0-9])MM([0-9][0-9])([0-9][0-9])'), '') AS token,
  CASE WHEN token IS NOT NULL THEN substr(token, 3, 2)::INTEGER END AS ied_mm, CASE WHEN token IS NOT NULL THEN substr(token, 7, 2)::INTEGER END AS "rows",
  CASE WHEN token IS NOT NULL THEN substr(token, 9, 2)::INTEGER END AS cols, "rows" || 'x' || cols AS grid_key
FROM (SELECT p_partkey // 40 AS file_id, p_partkey % 40 AS channel_idx, {DESCRIBED.format(text='VARCHAR')} AS description FROM part)"""
CATALOG_SQL = "(VALUES " + ", ".join(f"({i}, '{p}', {e})" for i, p, e in CATALOG) + ") AS c(ord, product, electrodes)"
ELECTRODES_SQL = f'coalesce((SELECT arg_min(electrodes, ord) FROM {CATALOG_SQL} WHERE upper(product) = upper(token)), "rows" * cols)'


@query(f"SELECT file_id, channel_idx, token, ied_mm, \"rows\", cols, grid_key FROM ({PARSED_SQL})")
def grid_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).withColumns(grids.parse_token(F.col("description"))).drop("description")


@query(f"SELECT file_id, channel_idx, token, {ELECTRODES_SQL}::INTEGER AS electrodes FROM ({PARSED_SQL}) WHERE token IS NOT NULL")
def electrode_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = described(spark, sf_dir).withColumns(grids.parse_token(F.col("description"))).where("token is not null")
    return grids.electrode_lookup(rows, catalog(spark)).select("file_id", "channel_idx", "token", "electrodes")


GRIDS_SQL = f"""SELECT file_id, key AS grid_key, arg_min("rows", channel_idx) FILTER (token IS NOT NULL) AS "rows", arg_min(cols, channel_idx) FILTER (token IS NOT NULL) AS cols,
  arg_min(ied_mm, channel_idx) FILTER (token IS NOT NULL) AS ied_mm, arg_min(electrodes, channel_idx) FILTER (token IS NOT NULL) AS electrodes,
  coalesce(string_agg(channel_idx, ',' ORDER BY channel_idx) FILTER (token IS NOT NULL), '') AS emg_indices, coalesce(string_agg(channel_idx, ',' ORDER BY channel_idx) FILTER (token IS NULL), '') AS ref_indices,
  max(channel_idx) FILTER (token IS NULL AND contains(lower(description), 'requested path')) AS requested_path_idx, max(channel_idx) FILTER (token IS NULL AND contains(lower(description), 'performed path')) AS performed_path_idx,
  min(channel_idx) FILTER (token IS NOT NULL) AS first_idx
FROM (SELECT *, last_value(grid_key IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY channel_idx ROWS UNBOUNDED PRECEDING) AS key, {ELECTRODES_SQL}::INTEGER AS electrodes FROM ({PARSED_SQL}))
WHERE key IS NOT NULL GROUP BY file_id, key"""


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("emg_indices", "ref_indices")}
    return grids.extract_grids(described(spark, sf_dir), catalog(spark)).withColumns(joined).drop("grid_uid")


@query(GRIDS_SQL)
def grid_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grids(spark, sf_dir)


@query(f"SELECT * FROM ({GRIDS_SQL}) WHERE grid_key = '3x2'")
def get_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.get_grid(_grids(spark, sf_dir), grid_key="3x2")


@query(f"SELECT user_id, sample_idx, value FROM ({SERIES_SQL}) WHERE sample_idx < (SELECT min(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id))")
def min_length_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.stack_shortest(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", long("sample_idx"), "value")


DIFFERENCE_SQL = f"SELECT label, row_idx - 1 AS diff_idx, col_idx AS sample_idx, value - before AS raw FROM (SELECT *, lag(value) OVER (PARTITION BY label, col_idx ORDER BY row_idx) AS before FROM ({CELLS_SQL})) WHERE before IS NOT NULL"


@query(DIFFERENCE_SQL)
def differential_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.differential_arrays(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return rows.select("label", long("diff_idx"), F.posexplode("raw").alias("sample_idx", "raw")).withColumn("sample_idx", F.col("sample_idx").cast("long"))


@query(DIFFERENCE_SQL)
def differential_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.differential_raw(cells(spark, sf_dir), "label", "row_idx", "col_idx", "value")
    return rows.select("label", long("diff_idx"), long("col_idx", "sample_idx"), "raw")


def filter_sql(series: str, f: Bandpass) -> str:
    """SQL for (key, i, filtered) of series (key, i, x): odd extension, then a recurrence for each direction."""
    number = lambda x: f"({x!r})::DOUBLE"
    n, steps, states = len(f.sections), [], []
    for k, (b0, b1, b2, a1, a2) in enumerate(f.sections.tolist()):
        into = "e.x" if k == 0 else f"o{k - 1}"
        steps += [f"{number(b0)} * {into} + r.s{k} AS o{k}", f"{number(b1)} * {into} - {number(a1)} * o{k} + r.z{k} AS s{k}_", f"{number(b2)} * {into} - {number(a2)} * o{k} AS z{k}_"]
        states += [f"s{k}_ AS s{k}", f"z{k}_ AS z{k}"]
    begin = ", ".join(f"{number(a)} * x AS s{k}, {number(b)} * x AS z{k}" for k, (a, b) in enumerate(f.initial.tolist()))

    def run(name: str, source: str) -> str:
        return f"""{name} AS (SELECT key, -1::BIGINT AS i, NULL::DOUBLE AS y, {begin} FROM {source} WHERE i = 0
  UNION ALL SELECT key, i, y, {', '.join(states)} FROM (SELECT e.key AS key, e.i AS i, {', '.join(steps)}, o{n - 1} AS y FROM {name} r JOIN {source} e ON e.key = r.key AND e.i = r.i + 1))"""

    p = f.pad
    return f"""WITH RECURSIVE base AS MATERIALIZED ({series}), sized AS (SELECT key, max(i) AS m, arg_min(x, i) AS a, arg_max(x, i) AS z FROM base GROUP BY key),
ext AS MATERIALIZED (SELECT key, i + {p} AS i, x FROM base
  UNION ALL SELECT b.key, {p} - b.i, 2 * a - x FROM base b JOIN sized s ON b.key = s.key WHERE b.i BETWEEN 1 AND {p}
  UNION ALL SELECT b.key, {p} + 2 * m - b.i, 2 * z - x FROM base b JOIN sized s ON b.key = s.key WHERE b.i BETWEEN m - {p} AND m - 1),
{run('forth', 'ext')},
turned AS MATERIALIZED (SELECT f.key, m + {2 * p} - f.i AS i, y AS x FROM forth f JOIN sized s ON f.key = s.key WHERE f.i >= 0),
{run('back', 'turned')}
SELECT b.key AS key, m + {p} - b.i AS i, y AS filtered FROM back b JOIN sized s ON b.key = s.key WHERE b.i BETWEEN {p} AND m + {p}"""


@query(f"SELECT key AS user_id, i AS sample_idx, round(filtered, 6) AS filtered FROM ({filter_sql(f'SELECT user_id AS key, sample_idx AS i, value AS x FROM ({SERIES_SQL})', design(*EVENTS_FILTER))})")
def bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    ensure_workers(spark)
    series = events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("r"))
    done = series.select("user_id", filters.bandpass_arrays(F.col("r.value"), *EVENTS_FILTER).alias("y"))
    return done.select("user_id", F.posexplode("y").alias("sample_idx", "filtered")).select("user_id", long("sample_idx"), F.round("filtered", 6).alias("filtered"))


@query(f"""SELECT user_id, event_id, round(filtered, 6) AS filtered FROM ({filter_sql(f'SELECT user_id AS key, sample_idx AS i, value AS x FROM ({SERIES_SQL})', design(*EVENTS_FILTER))}) f
JOIN (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) e ON e.user_id = f.key AND e.i = f.i""")
def bandpass_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = long_series.bandpass_long(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", *EVENTS_FILTER)
    return done.select("user_id", "event_id", F.round("filtered", 6).alias("filtered"))


@query(f"SELECT key // 1000000 AS label, key % 1000000 AS diff_idx, i AS sample_idx, round(filtered, 6) AS filtered FROM ({filter_sql(f'SELECT label * 1000000 + diff_idx AS key, sample_idx AS i, raw AS x FROM ({DIFFERENCE_SQL})', design(*MATRIX_FILTER))})")
def differential_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_workers(spark)
    rows = filters.differential_arrays(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    done = rows.select("label", "diff_idx", filters.bandpass_arrays(F.col("raw"), *MATRIX_FILTER).alias("y"))
    return done.select(long("label"), long("diff_idx"), F.posexplode("y").alias("sample_idx", "filtered")).select("label", "diff_idx", long("sample_idx"), F.round("filtered", 6).alias("filtered"))


SPANS_SQL = "SELECT s_suppkey AS track, s_suppkey % 7 AS file_id, (s_suppkey * 37) % 500 AS low, (s_suppkey * 37) % 500 + CASE WHEN s_suppkey % 5 = 0 THEN 200 ELSE s_suppkey % 13 END AS high FROM supplier"


@query(f"""SELECT p_partkey, track, p - low AS local_idx FROM (SELECT p_partkey, p_partkey % 7 AS file_id, (p_partkey * 11) % 700 AS p FROM part) p
JOIN ({SPANS_SQL}) s ON p.file_id = s.file_id AND p.p >= s.low AND p.p < s.high""")
def track_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as channels, suppliers as tracks that overlap and leave gaps."""
    k, t = F.col("p_partkey"), F.col("s_suppkey")
    channels = read(spark, sf_dir, "part").select("p_partkey", (k % 7).alias("file_id"), (k * 11 % 700).alias("p"))
    spans = read(spark, sf_dir, "supplier").select(t.alias("track"), (t % 7).alias("file_id"), (t * 37 % 500).alias("low"))
    spans = spans.withColumn("high", F.col("low") + F.when(F.col("track") % 5 == 0, 200).otherwise(F.col("track") % 13))
    return tracks.interval_join(channels, spans, ["file_id"], "p").select("p_partkey", "track", (F.col("p") - F.col("low")).alias("local_idx"))


@query(f"""SELECT p_partkey // 40 AS file_id, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey) - 1 AS channel_idx, p_brand AS adapter_id,
  (1 + p_partkey % 5)::DOUBLE * CASE WHEN p_partkey % 3 <> 0 THEN p_size::DOUBLE ELSE (1 + p_partkey % 5)::DOUBLE END AS gain,
  array_to_string(list_transform(list_filter([{', '.join(PARTS_OF)}], lambda x: x IS NOT NULL AND x <> '' AND lower(x) <> 'not defined' AND trim(x) <> ''), lambda x: trim(x)), '-') AS description FROM part""")
def xml_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of 40 parts as XML texts, each part an adapter with one channel, read by Spark's XML functions."""
    parts = read(spark, sf_dir, "part").withColumns({f"x{i}": F.expr(x) for i, x in enumerate(PARTS_OF)}).withColumn("file_id", F.floor(F.col("p_partkey") / 40).cast("long"))
    n = F.row_number().over(Window.partitionBy("file_id").orderBy("p_partkey")) - 1
    said = lambda name, value: F.coalesce(F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"')), F.lit(""))
    own = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size"))
    adapter = F.concat(
        F.lit("<Adapter"), said("ID", F.col("x0")), said("Description", F.col("x1")), said("Gain", 1 + F.col("p_partkey") % 5), said("ChannelStartIndex", F.col("n")), F.lit(">"),
        F.lit('<Channel Index="0"'), said("ID", F.col("x2")), said("Muscle", F.col("x3")), said("Gain", own), F.lit("/></Adapter>"),
    )
    xml = F.concat(F.lit('<Device Name="Q" SampleFrequency="2048"><Channels>'), F.array_join(F.sort_array(F.collect_list(F.concat(F.lpad(F.col("n").cast("string"), 9, "0"), adapter))), ""), F.lit("</Channels></Device>"))
    files = parts.withColumn("n", n).groupBy("file_id").agg(F.regexp_replace(xml, r"[0-9]{9}<Adapter", "<Adapter").alias("xml"))
    found = headers.otb_channels(files, "file_id", "xml")
    return found.select("file_id", long("channel_idx"), F.trim("adapter_id").alias("adapter_id"), "gain", "description")


@query("""SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY p_partkey, c) - 1 AS channel_idx, printf('%s-%s-%s-ch%d', p_brand, p_type, p_name, c) AS description,
  5::DOUBLE / 65536::DOUBLE * 1000::DOUBLE / (1 + p_partkey % 3)::DOUBLE AS factor
FROM (SELECT p_partkey // 40 AS file_id, p_partkey, p_brand, p_type, p_name, unnest(range(p_partkey % 4)) AS c FROM part)""")
def xml_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of 40 tracks as XML texts, a part each, read by Spark's XML functions."""
    parts = read(spark, sf_dir, "part").withColumn("file_id", F.floor(F.col("p_partkey") / 40).cast("long"))
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))
    info = F.concat(
        F.lit("<TrackInfo>"), tag("Device", F.concat(F.lit(" "), "p_brand", F.lit(" "))), tag("SignalStreamPath", F.col("p_type")), tag("SubTitle", F.col("p_name")),
        tag("NumberOfChannels", F.col("p_partkey") % 4), tag("Gain", 1 + F.col("p_partkey") % 3), F.lit("</TrackInfo>"),
    )
    listed = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", info.alias("x")))), lambda r: r["x"])
    files = parts.groupBy("file_id").agg(F.concat(F.lit("<ArrayOfTrackInfo>"), F.array_join(listed, ""), F.lit("</ArrayOfTrackInfo>")).alias("xml"))
    return headers.otb4_channels(files, "file_id", "xml").select("file_id", long("channel_idx"), "description", "factor")


@query("SELECT user_id, count(DISTINCT event_type) AS channel_count FROM events GROUP BY user_id")
def channel_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.channel_count(read(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("SELECT event_id, value::FLOAT::DOUBLE AS value FROM events")
def cast_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", C.single(F.col("value")).alias("value"))


@query("SELECT event_id, epoch(TIMESTAMP '2024-01-20 00:00:00') - floor(epoch(ts)) < 604800 AS fresh FROM events")
def cache_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return read(spark, sf_dir, "events").select("event_id", C.fresh(F.col("ts").cast("timestamp"), now).alias("fresh"))


def _encoded(parts: DataFrame, run: Callable[[object], bytes], suffix: str, of: Callable[[pd.DataFrame], object] = lambda group: group) -> DataFrame:
    """Recordings of 40 parts as files: (path, length, content)."""
    ensure_workers(parts.sparkSession)

    def files(group: pd.DataFrame) -> pd.DataFrame:
        content = run(of(group.sort_values("p_partkey")))
        return pd.DataFrame({"path": [f"/{group['file_id'].iloc[0]}{suffix}"], "length": [len(content)], "content": [content]})

    keyed = parts.select(F.floor(F.col("p_partkey") / 40).cast("long").alias("file_id"), "p_partkey", "p_size", "p_retailprice")
    return keyed.groupBy("file_id").applyInPandas(files, "path string, length long, content binary")


def _samples(files: DataFrame) -> DataFrame:
    return _renamed(layout.explode_samples(decode_files(files)))


def _renamed(samples: DataFrame) -> DataFrame:
    rows = samples.withColumn("file_id", F.regexp_extract("file_id", r"/(\d+)\.", 1).cast("long"))
    return rows.select("file_id", long("channel_idx"), long("sample_idx"), "description", "value", "t")


#: Parts as two channels of whole samples; a last odd part is left out.
PAIRS_SQL = "SELECT p_partkey // 40 AS file_id, n % 2 AS channel_idx, n // 2 AS sample_idx, v FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey) - 1 AS n, count(*) OVER (PARTITION BY p_partkey // 40) AS m, (p_size * 100 - 2500)::DOUBLE AS v FROM part) WHERE n < m - m % 2"


def pairs(group: pd.DataFrame) -> np.ndarray:
    x = (group["p_size"].to_numpy() * 100 - 2500).astype(np.int64)
    return x[: len(x) // 2 * 2].reshape(-1, 2).T


@query(f"SELECT file_id, channel_idx, sample_idx, CASE channel_idx WHEN 0 THEN 'A1-mat-c0-left' ELSE 'A1-mat-c1' END AS description, v * 4.8::DOUBLE / 65536::DOUBLE * 1000::DOUBLE / CASE channel_idx WHEN 0 THEN 10::DOUBLE ELSE 25::DOUBLE END AS value FROM ({PAIRS_SQL})")
def otb_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(_encoded(read(spark, sf_dir, "part"), otb_file, ".otb+")).drop("t")


def otb_file(group: pd.DataFrame) -> bytes:
    channels = [{"Index": 0, "Gain": 2, "ID": "c0", "Side": " left "}, {"Index": 1, "ID": "c1", "Side": "Not defined"}]
    adapter = {"Gain": 5, "ChannelStartIndex": 0, "ID": "A1", "Description": "mat"}
    return encode.encode_otb({"Name": "Q", "SampleFrequency": 2048, "ad_bits": 16, "DeviceTotalChannels": 2}, [(adapter, channels)], pairs(group), tail=b"\x01\x00")


@query(f"SELECT file_id, channel_idx, sample_idx, CASE channel_idx WHEN 0 THEN 'S-a.sig-one-ch0' ELSE 'S-a.sig-two-ch0' END AS description, v * (5::DOUBLE / 65536::DOUBLE * 1000::DOUBLE / CASE channel_idx WHEN 0 THEN 4::DOUBLE ELSE 8::DOUBLE END) AS value FROM ({PAIRS_SQL})")
def otb4_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(group: pd.DataFrame) -> bytes:
        track = {"Device": "S", "ADC_Nbits": 16, "ADC_Range": 5, "SignalStreamPath": "a.sig", "NumberOfChannels": 1}
        return encode.encode_otb4([track | {"Gain": 4, "SubTitle": " one "}, track | {"Gain": 8, "SubTitle": "two"}], {"a.sig": encode.interleaved(pairs(group), "<i2")}, "zip")

    return _samples(_encoded(read(spark, sf_dir, "part"), run, ".otb4")).drop("t")


@query(f"SELECT file_id, channel_idx, sample_idx, CASE channel_idx WHEN 0 THEN 'Novecento+-a.sig-one-ch0' ELSE 'Novecento+-b.sig-two-ch0' END AS description, v * (5::DOUBLE / 16777216::DOUBLE * 1000::DOUBLE / CASE channel_idx WHEN 0 THEN 4::DOUBLE ELSE 8::DOUBLE END) AS value FROM ({PAIRS_SQL})")
def novecento_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(group: pd.DataFrame) -> bytes:
        x = pairs(group)
        track = {"Device": "Novecento+", "ADC_Nbits": 24, "ADC_Range": 5, "NumberOfChannels": 1}
        tracks_ = [track | {"Gain": 4, "SubTitle": "one", "SignalStreamPath": "a.sig"}, track | {"Gain": 8, "SubTitle": "two", "SignalStreamPath": "b.sig"}]
        longer = np.concatenate([x[1], [7, 7]])
        return encode.encode_otb4(tracks_, {"a.sig": encode.interleaved(x[:1], "<i4"), "sub/b.sig": encode.interleaved(longer[None, :], "<i4"), "c.sig": b"\0" * 8})

    return _samples(_encoded(read(spark, sf_dir, "part"), run, ".otb4")).drop("t")


@query("""SELECT file_id, CASE WHEN m < 4 THEN 0 ELSE n % 2 END AS channel_idx, CASE WHEN m < 4 THEN n ELSE n // 2 END AS sample_idx,
  CASE WHEN m >= 4 AND n % 2 = 1 THEN 'two' ELSE 'é' END AS description, v / 8::DOUBLE AS value,
  CASE WHEN m < 4 THEN n::DOUBLE / 2048::DOUBLE ELSE 0.5::DOUBLE + ((n // 2) * (n // 2))::DOUBLE / 2048::DOUBLE END AS t
FROM (SELECT p_partkey // 40 AS file_id, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey) - 1 AS n, count(*) OVER (PARTITION BY p_partkey // 40) AS m, (p_size * 100 - 2500)::DOUBLE AS v FROM part)
WHERE n < m - m % 2""")
def mat_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With uneven times. One sample of two channels is read as two samples of one, whose time vector then isn't aligned."""
    return _samples(_encoded(read(spark, sf_dir, "part"), mat.write_mat, ".mat", variables))


def variables(group: pd.DataFrame) -> dict[str, object]:
    x = pairs(group) / 8.0
    at = np.arange(x.shape[1])
    return {"Data": x, "Time": (0.5 + at * at / RATE)[:, None], "Description": ["é", "two"], "SamplingFrequency": np.array([[RATE]])}


@query(ORACLE["mat_roundtrip"])
def mat4_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in files of level 4."""
    return _samples(_encoded(read(spark, sf_dir, "part"), mat.write_mat4, ".mat", variables))


@query(ORACLE["otb_roundtrip"].replace("SELECT file_id", "SELECT * FROM (SELECT file_id", 1) + ") WHERE channel_idx = 1")
def source_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of parts as files in the shared folder, read by the data source, which takes the filter on channels."""
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/recordings-{uuid.uuid4()}"
    encode.write_files(_encoded(read(spark, sf_dir, "part"), otb_file, ".otb+"), folder)
    source.register(spark)
    found = spark.read.format("recording").load(folder).where("channel_idx = 1")
    return _renamed(layout.explode_samples(found)).drop("t")


@query("SELECT p_partkey, concat('é', p_name) AS text FROM part")
def entry_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("é"), F.col("p_name"))
    raw = F.when(F.col("p_partkey") % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    return read(spark, sf_dir, "part").select("p_partkey", C.entry_text(raw).alias("text"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
