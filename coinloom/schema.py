"""Schemas and fixed value lists of the ledger."""

from pyspark.sql import types as T

TRANSACTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("amountSantim", T.LongType()),
        T.StructField("party", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("reference", T.StringType()),
        T.StructField("note", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("settled", T.BooleanType()),
        T.StructField("createdAt", T.StringType()),
    ]
)

FINDING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("txnIds", T.ArrayType(T.StringType())),
    ]
)

PARSED = T.StructType(
    [
        T.StructField("ok", T.BooleanType()),
        T.StructField("raw", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("amountSantim", T.LongType()),
        T.StructField("party", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("reference", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("note", T.StringType()),
        T.StructField("needsReview", T.BooleanType()),
    ]
)

#: Suggested channels, and labels of transaction types.
CHANNELS = ("CBE", "Telebirr", "Awash", "Dashen", "Abyssinia", "Wegagen", "M-Pesa", "Cash", "Other")
TYPE_LABELS = {"in": "Money In", "out": "Money Out", "airtime": "Airtime", "credit": "Credit"}
