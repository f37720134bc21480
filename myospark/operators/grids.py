"""Electrode grids, found in channel descriptions, and the catalogue of grid products."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from myospark.sources.stores import system_of

#: Fixed value: product names in descriptions: distance in mm, rows, columns.
TOKEN = r"HD(\d{2})MM(\d{2})(\d{2})"
CATALOG = "ord int, product string, electrodes int"
WEEK = 7 * 24 * 3600


def parse_token(text: Column) -> dict[str, Column]:
    """token, ied_mm, rows, cols, grid_key of the first product name in a text; null without one."""
    found = text.rlike(TOKEN)
    part = lambda i: F.when(found, F.regexp_extract(text, TOKEN, i).cast("int"))
    return {"token": F.when(found, F.regexp_extract(text, TOKEN, 0)), "ied_mm": part(1), "rows": part(2), "cols": part(3), "grid_key": F.when(found, F.concat_ws("x", part(2), part(3)))}


def electrode_lookup(df: DataFrame, catalog: DataFrame, token: str = "token") -> DataFrame:
    """df with electrodes: those of the first product of that name in any case, else rows x cols."""
    name = F.upper("product")
    first = catalog.groupBy(name.alias("_product")).agg(F.min_by("electrodes", "ord").alias("_electrodes"))
    joined = df.join(first, F.upper(F.col(token)) == F.col("_product"), "left")
    return joined.withColumn("electrodes", F.coalesce("_electrodes", F.col("rows") * F.col("cols"))).drop("_product", "_electrodes")


def extract_grids(channels: DataFrame, catalog: DataFrame, file: str = "file_id") -> DataFrame:
    """One row for each grid of each file: geometry, and the channels of electrodes and of references.

    A description with a product name opens its grid or goes on with it; others, path markers included, are references
    of the grid that is open. Geometry is that of the first description. A null description is no text. One shuffle by
    file; then the aggregate by (file, grid) needs none, as the rows are already together.
    """
    marked = channels.withColumns(parse_token(F.col("description")))
    w = Window.partitionBy(file).orderBy("channel_idx").rowsBetween(Window.unboundedPreceding, 0)
    head, i, text = F.col("token").isNotNull(), F.col("channel_idx"), F.lower("description")
    filled = marked.withColumn("_key", F.last("grid_key", ignorenulls=True).over(w)).where("_key is not null")
    listed = lambda c: F.sort_array(F.collect_list(F.when(c, i)))
    first = lambda c: F.min_by(F.when(head, F.col(c)), F.when(head, i))
    grids = filled.groupBy(file, F.col("_key").alias("grid_key")).agg(
        first("token").alias("token"), *(first(c).alias(c) for c in ("rows", "cols", "ied_mm")),
        listed(head).alias("emg_indices"), listed(~head).alias("ref_indices"),
        F.max(F.when(~head & text.contains("requested path"), i)).alias("requested_path_idx"),
        F.max(F.when(~head & text.contains("performed path"), i)).alias("performed_path_idx"),
        F.min(F.when(head, i)).alias("first_idx"),
    )
    return electrode_lookup(grids, catalog).withColumn("grid_uid", grid_uid(F.col(file), F.col("grid_key"))).drop("token")


def grid_uid(file: Column, key: Column) -> Column:
    """A UUID's text from file and key: the same in each evaluation."""
    h = F.md5(F.concat_ws("\u0000", file.cast("string"), key))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def get_grid(grids: DataFrame, grid_key: str | None = None, grid_uid: str | None = None, file: str = "file_id") -> DataFrame:
    """For each file the first grid with this key, or else the first with this uid; no row without either."""
    by_key = F.col("grid_key") == grid_key if grid_key is not None else F.lit(False)
    by_uid = F.col("grid_uid") == grid_uid if grid_uid is not None else F.lit(False)
    rank = F.row_number().over(Window.partitionBy(file).orderBy(F.when(by_key, 0).otherwise(1), "first_idx"))
    return grids.where(by_key | by_uid).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


class GridCatalog:
    """The catalogue of grid products: from memory, from a cache file younger than a week, or from `fetch`.

    cache: a path or URI that Arrow's file systems know; it may be shared, as it is replaced whole.
    fetch: a function without arguments that returns a list of {product, electrodes}, such as a web request. What fails
    counts as an empty catalogue, which is remembered too.
    """

    def __init__(self, cache: str | None = None, fetch: Callable[[], list[dict]] | None = None, clock: Callable[[], float] = time.time):
        self.cache, self.fetch, self.clock, self.known = cache, fetch, clock, None

    def entries(self) -> list[dict]:
        if self.known is None:
            self.known = self._cached()
        if self.known is None:
            try:
                self.known = self.fetch() if self.fetch else []
                if self.cache and self.fetch:
                    self._replace()
            except Exception:
                self.known = []
        return self.known

    def _replace(self) -> None:
        """Write the cache under another name and move it into place, so that whoever reads it finds a whole file."""
        system, at = system_of(self.cache)
        part = f"{at}.{uuid.uuid4()}"
        with system.open_output_stream(part) as f:
            f.write(json.dumps(self.known).encode())
        system.move(part, at)

    def _cached(self) -> list[dict] | None:
        if not self.cache:
            return None
        try:
            system, at = system_of(self.cache)
            written = system.get_file_info(at).mtime
            if written is not None and self.clock() - written.timestamp() < WEEK:
                with system.open_input_stream(at) as f:
                    return json.loads(f.read())
        except (OSError, ValueError):
            return None
        return None

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, e["product"], int(e["electrodes"])) for i, e in enumerate(self.entries())], CATALOG)
