"""Ledger tables made from the event and order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A table read, dealt out if it comes in fewer partitions than there are cores (one small file does) and costly work follows."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def _amount_fine() -> Column:
    return F.floor(F.col("value") * 100 + 0.5).cast("long")


def _amount_coarse() -> Column:
    base = F.floor(F.col("value") / 100).cast("long") * 10_000
    return base * F.when((F.col("event_type") == "click") & (F.dayofmonth("ts") == 15), 20).otherwise(1)


def transactions(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """Events as transactions; coarse amounts collide, fine ones hardly ever."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "out").when(F.col("event_type").isin("signup", "view"), "in").when(F.col("event_type") == "click", "airtime").otherwise("credit")
    agent = F.when(F.col("event_id") % 2 == 0, "Agent ").otherwise("agent ")
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int") % 3
    return e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        kind.alias("type"),
        (_amount_coarse() if coarse else _amount_fine()).alias("amountSantim"),
        F.concat(agent, (F.col("user_id") % 7).cast("string")).alias("party"),
        F.when(k == 0, "CBE").when(k == 1, "Telebirr").otherwise("Cash").alias("channel"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("R"), F.col("user_id").cast("string"))).alias("reference"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('=n,"'), F.col("event_type"))).alias("note"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("date"),
        (F.col("event_id") % 2 == 0).alias("settled"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msg_id, text): money alerts made from orders and customers, one template after another."""
    o = spread(read(spark, sf_dir, "orders")).join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    amount, name, ref = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.regexp_replace("c_name", "#", " "), F.concat(F.lit("Ref: TB"), F.col("o_orderkey").cast("string"))
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    templates = [
        s("Telebirr: You have received ETB ", amount, " from ", name, ". ", ref),
        s("Telebirr: You have paid ETB ", amount, " to ", name, " on 2026-07-15. ", ref),
        s("Telebirr: Airtime purchase ETB ", amount, " successful."),
        s("CBE: Your account has been credited with ETB ", amount, " from ", name, ", ", ref),
        s("CBE: Your account has been debited ETB ", amount, ". ", ref),
        s("Awash: Your account credited Br. ", amount, " from ", name, ". ", ref),
        s("Dashen: withdrawn ETB ", amount, " to ", name, ". ", ref),
        s("Payment ETB ", amount, " to ", name, " on 2026-01-01"),
        s("Loan alert about ETB ", amount, " due"),
        s("A vague alert about ETB ", amount, " that happened"),
        s("no money here, ", ref),
    ]
    text = F.lit(None)
    for i, t in enumerate(templates):
        text = F.when(F.col("o_orderkey") % len(templates) == i, t).otherwise(text)
    return o.select(F.col("o_orderkey").alias("msg_id"), text.alias("text"))


def screenshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): refill lists of three entries made from every order."""
    o = spread(read(spark, sf_dir, "orders"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    amount = F.format_number(F.col("o_totalprice"), 2)
    entry = lambda h, n: F.concat(day, F.lit(f" {h}:05 PM\n{n} Abebe\n"), amount, F.lit(" Birr\n"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Refill History\n===\n"), entry(1, "Almaz"), entry(2, "Kebede"), entry(3, "Sara"), F.lit("Birr\n")).alias("text"))


def pasted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, n, text): each message alone and twice in blocks, and each screenshot; n is their order."""
    m, shots = messages(spark, sf_dir), screenshots(spark, sf_dir)
    named = lambda df, letter, key, text, place: df.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("doc"), (F.col(key) * 3 + place).alias("n"), text.alias("text"))
    twice = F.concat("text", F.lit("\n \n"), "text")
    return named(m, "m", "msg_id", F.col("text"), 0).unionByName(named(m, "b", "msg_id", twice, 1)).unionByName(named(shots, "s", "doc_id", F.col("text"), 2))


def form_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed entries made from customers: signed amounts with separators, padded and blank parties."""
    c = read(spark, sf_dir, "customer")
    name = F.concat(F.lit(" \t"), F.regexp_replace("c_name", "#", " "), F.lit("\u00a0"))
    return c.select(
        "c_custkey",
        F.concat(F.lit("ETB "), F.format_number("c_acctbal", 2)).alias("amount"),
        F.when(F.col("c_custkey") % 7 == 0, "  ").otherwise(name).alias("party"),
        F.lit("").alias("reference"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(" ").alias("note"),
    )
