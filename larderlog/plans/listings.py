"""Whether a paged company listing was read whole.

A capture reads pages from ``FIRST_PAGE`` on until ``totalPages``.  Between two
requests the service may lose a page, answer one twice, or move companies
from one page to another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST_PAGE = 0
CAPTURE = ["city_id", "captured_at"]


def page_intervals(listing: DataFrame) -> DataFrame:
    """Runs of consecutive pages per capture: ``from_page`` to ``to_page``."""
    pages = listing.select(*CAPTURE, F.col("currentPage").alias("page")).dropna(subset=["page"]).distinct()
    order = Window.partitionBy(*CAPTURE).orderBy("page")
    island = F.col("page") - F.row_number().over(order)
    return pages.withColumn("_island", island).groupBy(*CAPTURE, "_island").agg(
        F.min("page").alias("from_page"), F.max("page").alias("to_page")
    ).drop("_island")


def _missing(listing: DataFrame) -> DataFrame:
    """The stretches between and behind the runs of pages, up to the largest ``totalPages`` seen."""
    ends = listing.groupBy(*CAPTURE).agg(F.max("totalPages").alias("_total"))
    # A run of nothing stands before the first page, so that one may be missing, too.
    bounds = page_intervals(listing).unionByName(ends.select(
        *CAPTURE, F.lit(FIRST_PAGE - 1).alias("from_page"), F.lit(FIRST_PAGE - 1).alias("to_page")
    )).unionByName(ends.dropna().select(
        *CAPTURE, (F.col("_total") + FIRST_PAGE).alias("from_page"), (F.col("_total") + FIRST_PAGE).alias("to_page")
    ))
    following = F.lead("from_page").over(Window.partitionBy(*CAPTURE).orderBy("from_page", "to_page"))
    return bounds.withColumn("_next", following).where(F.col("_next") > F.col("to_page") + 1).select(
        *CAPTURE, F.lit("missing").alias("kind"), (F.col("to_page") + 1).alias("from_page"), (F.col("_next") - 1).alias("to_page"),
        F.lit(None).cast("bigint").alias("companies"),
    )


def _repeated(listing: DataFrame) -> DataFrame:
    again = listing.dropna(subset=["currentPage"]).groupBy(*CAPTURE, F.col("currentPage").alias("from_page")).agg(F.count(F.lit(1)).alias("_n"))
    return again.where("_n > 1").select(
        *CAPTURE, F.lit("repeated").alias("kind"), "from_page", F.col("from_page").alias("to_page"), F.lit(None).cast("bigint").alias("companies")
    )


def _shifted(listing: DataFrame) -> DataFrame:
    """Pages with companies that an earlier page of the capture had already: so many others were pushed past unread."""
    seen = listing.select(*CAPTURE, F.col("currentPage").alias("page"), F.explode("searchData.name").alias("company_id")).distinct()
    first = F.min("page").over(Window.partitionBy(*CAPTURE, "company_id"))
    moved = seen.withColumn("_first", first).where(F.col("page") > F.col("_first"))
    return moved.groupBy(*CAPTURE, F.col("page").alias("from_page")).agg(F.count(F.lit(1)).alias("companies")).select(
        *CAPTURE, F.lit("shifted").alias("kind"), "from_page", F.col("from_page").alias("to_page"), "companies"
    )


def listing_gaps(listing: DataFrame) -> DataFrame:
    """city_id, captured_at, kind, from_page, to_page, companies: what is wrong with each capture.

    ``missing`` pages as intervals, each page ``repeated`` within a capture, and
    each page ``shifted`` with its number of companies listed before.  A capture without
    ``totalPages`` is known to end at its last page only.  A complete listing has no row.
    """
    return _missing(listing).unionByName(_repeated(listing)).unionByName(_shifted(listing))


def complete_captures(listing: DataFrame) -> DataFrame:
    """Captures that can be trusted to name every company of their city."""
    return listing.select(*CAPTURE).distinct().join(listing_gaps(listing).select(*CAPTURE).distinct(), CAPTURE, "left_anti")
