"""Listings, filters, totals and per-party rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import iso_millis, local_day, trim_all


def newest_first(txns: DataFrame) -> DataFrame:
    return txns.orderBy(F.desc("date"), "id")


def open_credit() -> Column:
    """Credit not settled; unknown counts as not settled."""
    return (F.col("type") == "credit") & ~F.coalesce("settled", F.lit(False))


def history(txns: DataFrame, search: str = "", type_: str = "all", channel: str = "all") -> DataFrame:
    """Rows of a type, of a channel, and with the search text in party, reference and note joined by spaces."""
    if type_ != "all":
        txns = txns.where(F.col("type") == type_)
    if channel != "all":
        txns = txns.where(F.col("channel") == channel)
    needle = search.strip().lower()
    if needle:
        empty = F.lit("")
        hay = F.lower(F.concat_ws(" ", "party", F.coalesce("reference", empty), F.coalesce("note", empty)))
        txns = txns.where(F.contains(hay, F.lit(needle)))
    return txns


def _sum(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("amountSantim"))), F.lit(0)).cast("long")


def _count(n: Column | None) -> Column:
    """Number of rows, or `n` where a row stands for several."""
    return (F.count("*") if n is None else n).alias("n")


def history_totals(txns: DataFrame, n: Column | None = None) -> DataFrame:
    """Money in, everything else, and the count of a listing."""
    return txns.agg(_sum(F.col("type") == "in").alias("in_sum"), _sum(F.col("type") != "in").alias("out_sum"), _count(n))


def tiles(txns: DataFrame, as_of_ms: int, tz: str, day: Column | None = None) -> DataFrame:
    """Today's sums in zone tz, and all open credit; `day` is the rows' day there, if they have it."""
    today = (local_day(iso_millis("date"), tz) if day is None else day) == local_day(F.lit(as_of_ms), tz)
    kinds = [_sum(today & (F.col("type") == t)).alias(f"{t}_today") for t in ("in", "out", "airtime")]
    return txns.agg(*kinds, _sum(open_credit()).alias("open_credit"))


def export_totals(txns: DataFrame, n: Column | None = None) -> DataFrame:
    return txns.agg(_count(n), _sum(F.col("type") == "in").alias("in_sum"), _sum(F.col("type") == "out").alias("out_sum"))


def party_name() -> Column:
    """The party without white space at both ends; blank ones are Unknown."""
    return F.coalesce(F.nullif(trim_all("party"), F.lit("")), F.lit("Unknown"))


def party_rollup(txns: DataFrame, n: Column | None = None) -> DataFrame:
    """Sums, count and last date of every party; out is what is neither in nor open credit."""
    is_in = F.col("type") == "in"
    return txns.groupBy(party_name().alias("party")).agg(
        _sum(is_in).alias("in_sum"),
        _sum(~is_in & ~open_credit()).alias("out_sum"),
        _sum(open_credit()).alias("credit_sum"),
        _count(n),
        F.max("date").alias("last"),
    )


def party_ranking(txns: DataFrame, n: Column | None = None) -> DataFrame:
    """The rollup by turnover; ties go to the party seen last, then by name."""
    rolled = party_rollup(txns, n).withColumn("net", F.col("in_sum") - F.col("out_sum"))
    return rolled.orderBy(F.desc(F.col("in_sum") + F.col("out_sum") + F.col("credit_sum")), F.desc("last"), "party")
