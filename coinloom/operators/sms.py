"""Money-alert texts to typed rows: an ordered list of patterns as one CASE expression.

The first pattern that is found decides. Everything runs in the JVM; cheap substring tests
stand before the patterns. The parts of a pattern follow each other with anything between:
the first place of a part leaves the most room for the others, so each part is searched once
(atomically, from the text's start), in time linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import BLANK, text_to_santim, trim_all
from ..schema import PARSED

# Fixed values of the patterns: ASCII word boundaries, amounts, party names and what ends them.
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_ANY = r".*?"  # under the flag s: a class of all characters takes several times as long
_AMOUNT = r"([0-9,]+(?:\.[0-9]+)?)"
_ETB = rf"ETB{BLANK}*{_AMOUNT}"
_ETB_BR = rf"(?:ETB|Br\.?){BLANK}*{_AMOUNT}"
_PARTY = rf"{BLANK}+([A-Za-z0-9 .'-]+?)(?:\.|,|{BLANK}+(?:on|Ref))"
_BANK_WORDS = ("awash", "dashen", "abyssinia", "wegagen")
_BANKS = rf"{_L}(Awash|Dashen|Abyssinia|Wegagen){_R}"
_STOP = rf"(?={BLANK}+(?:on|Ref|Txn|TrxID%s){_R}|[.,;\n]|\z)"
_FREE_PARTY = r"([A-Za-z0-9.'-][A-Za-z0-9 .'-]*?)"
_LOOSE_PARTY = rf"{_L}(?:to|from){BLANK}+([A-Za-z0-9.'-][A-Za-z0-9 .'-]{{1,40}}?)" + _STOP % "|via"
_REFERENCE = rf"{_L}(?:Ref|Transaction ID|Txn|TrxID)[:# ]*([A-Za-z0-9]{{4,}})"
_AIRTIME = rf"{_L}(airtime|top[- ]?up|recharge|data bundle|mobile package){_R}"
_CREDIT = rf"{_L}(loan|borrow|owe|credit due|installment|repay(?:ment)?){_R}"
_IN = rf"{_L}(received|credited|deposit(?:ed)?|refund(?:ed)?|incoming|transferred to your|added to your){_R}"
_OUT = rf"{_L}(paid|debited|withdrawn|withdrew|purchase(?:d)?|bought|sent|transfer(?:red)? to|payment to|charged|bill|utility|topped? up|recharge){_R}"
_OCR_SMS_WORDS = ("credited", "debited", "your current balance", "transaction number", "account has been", "transfer id")
_OCR_SMS = rf"{_L}({'|'.join(_OCR_SMS_WORDS)}){_R}"


def _chain(*parts: str) -> str:
    """The parts in this order, anything before and between them."""
    return r"\A" + "".join(f"(?>{_ANY}{part})" for part in parts)


def _has(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


@dataclass(frozen=True)
class Rule:
    """A pattern, sets of words of each of which a text has one if the pattern is found, and what it gives: texts, or numbers of its groups. Without a type or party the whole text decides."""

    pattern: str
    guard: tuple[tuple[str, ...], ...]
    amount: int
    channel: str | int
    type_: str | int
    party: str | int
    party_optional: bool = False


_PREPOSITION = rf"{_ETB_BR}{BLANK}*(to|from){BLANK}+{_FREE_PARTY}" + _STOP % ""

#: In order; the first that is found decides.
RULES = (
    Rule(_chain("telebirr", "(?:received|credited)", _ETB, "from" + _PARTY), (("telebirr",), ("received", "credited"), ("etb",), ("from",)), 1, "Telebirr", "in", 2),
    Rule(_chain("telebirr", "(?:paid|debited|sent)", _ETB, "to" + _PARTY), (("telebirr",), ("paid", "debited", "sent"), ("etb",), ("to",)), 1, "Telebirr", "out", 2),
    Rule(_chain("telebirr", "airtime", _ETB), (("telebirr",), ("airtime",), ("etb",)), 1, "Telebirr", "airtime", "Airtime"),
    Rule(_chain(f"{_L}CBE{_R}", "(?:credited|received)", _ETB, "from" + _PARTY), (("cbe",), ("credited", "received"), ("etb",), ("from",)), 1, "CBE", "in", 2),
    Rule(_chain(f"{_L}CBE{_R}", "(?:debited|withdrawn|paid)", _ETB) + f"(?>{_ANY}(?:to|for){_PARTY})?+", (("cbe",), ("debited", "withdrawn", "paid"), ("etb",)), 1, "CBE", "out", 2, True),
    Rule(_chain(_BANKS, "(?:credited|received)", _ETB_BR, "from" + _PARTY), (_BANK_WORDS, ("credited", "received"), ("etb", "br"), ("from",)), 2, 1, "in", 3),
    Rule(_chain(_BANKS, "(?:debited|withdrawn|paid)", _ETB_BR) + f"(?>{_ANY}to{_PARTY})?+", (_BANK_WORDS, ("debited", "withdrawn", "paid"), ("etb", "br")), 2, 1, "out", 3, True),
    Rule(rf"\A{_ANY}" + _PREPOSITION, (("etb", "br"), ("to", "from")), 1, "Other", 2, 3),
    Rule(rf"\A{_ANY}" + _ETB_BR, (("etb", "br"),), 1, "Other", "", "", True),
)
_LAST = str(len(RULES) - 1)
#: Words one of which a reference needs.
_REFERENCE_WORDS = ("ref", "transaction id", "txn", "trxid")
#: What stands before a rule's finding and between its parts; no part of a pattern takes either.
_FINDING, _PART = "\x02", "\x01"


def _any_of(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(low, F.lit(word)) for word in words])


def _subject(text: Column) -> Column:
    """The text to search: no character of a finding stands in it."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(_FINDING), F.lit("\x03"))


def _findings(subject: Column, low: Column, rules: range) -> Column:
    """Number, amount, channel, type and party of the first of the rules that is found, as texts one after another; empty where none is.

    Each pattern is searched once: the text becomes what its groups found. Patterns whose
    words the text lacks aren't searched, nor those after the one that is found.
    """
    found = []
    for i in rules:
        rule = RULES[i]
        parts = [f"${x}" if isinstance(x, int) else x for x in (rule.amount, rule.channel, rule.type_, rule.party)]
        said = F.regexp_replace(subject, "(?is)" + rule.pattern + r".*\z", _FINDING + _PART.join([str(i), *parts]))
        has_words = reduce(Column.__and__, [_any_of(low, words) for words in rule.guard])
        found.append(F.when(has_words, F.get(F.split(said, _FINDING), F.lit(1))))
    return F.coalesce(*found, F.lit(""))


def _named(subject: Column, low: Column) -> Column:
    """By the rules that ask for a sender's name."""
    return _findings(subject, low, range(len(RULES) - 2))


def _loose(subject: Column, low: Column, named: Column) -> Column:
    """By the one that asks for a party only, if those give nothing."""
    return F.when(named == "", _findings(subject, low, range(len(RULES) - 2, len(RULES) - 1))).otherwise(named)


def _parts(subject: Column, low: Column, found: Column) -> Column:
    """What is found, in parts; one part only where nothing is."""
    return F.split(F.when(found == "", _findings(subject, low, range(len(RULES) - 1, len(RULES)))).otherwise(found), _PART)


def _signs(subject: Column, found: Column) -> Column:
    """What a text that only names an amount speaks of."""
    return F.when(found[0] == _LAST, F.struct(*[_has(subject, p).alias(n) for n, p in (("airtime", _AIRTIME), ("credit", _CREDIT), ("inward", _IN), ("outward", _OUT))]))


def _row(text: Column, subject: Column, low: Column, found: Column, signs: Column, as_of: Column) -> Column:
    none = F.lit(None).cast("string")
    ok, rule = F.size(found) > 1, found[0]
    optional = rule.isin([str(i) for i, r in enumerate(RULES) if r.party_optional])
    loose = F.when(rule == _LAST, F.regexp_extract(subject, "(?i)" + _LOOSE_PARTY, 1)).otherwise(found[4])
    party = trim_all(F.when(optional & (loose == ""), "Unknown").otherwise(loose))
    worded = F.when(F.lower(found[3]).isin("to", "from"), F.when(F.lower(found[3]) == "from", "in").otherwise("out")).otherwise(found[3])
    spoken = F.when(signs["airtime"], "airtime").when(signs["credit"], "credit").when(signs["inward"] & ~signs["outward"], "in").otherwise("out")
    type_ = F.when(rule == _LAST, spoken).otherwise(worded)
    review = F.coalesce(~signs["airtime"] & ~signs["credit"] & (signs["inward"] == signs["outward"]), F.lit(False))
    reference = F.when(_any_of(low, _REFERENCE_WORDS), F.regexp_extract(subject, "(?i)" + _REFERENCE, 1))
    reference = F.when(reference != "", reference)
    values = {"ok": ok, "raw": F.coalesce(text, F.lit("")), "type": type_, "amountSantim": text_to_santim(found[1]), "party": party, "channel": found[2], "reference": reference, "date": as_of, "note": none, "needsReview": review}
    always = ("ok", "raw")
    return F.struct(*[(values[f.name] if f.name in always else F.when(ok, values[f.name])).cast(f.dataType).alias(f.name) for f in PARSED])


def _literal(x: str | Column) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def parse_one(text: Column, as_of: str | Column) -> Column:
    """The row of one message; `ok` is false where no pattern is found. Dates in a text aren't read: the date is as_of."""
    once = lambda x, use: F.element_at(F.transform(F.array(x), use), 1)  # noqa: E731  x is computed once for all its uses
    last = lambda s, low, found: once(_signs(s, found), lambda signs: _row(text, s, low, found, signs, _literal(as_of)))
    found = lambda s, low: once(_named(s, low), lambda a: once(_loose(s, low, a), lambda b: once(_parts(s, low, b), lambda parts: last(s, low, parts))))
    return once(_subject(text), lambda s: once(F.lower(s), lambda low: found(s, low)))


def parse_each(df: DataFrame, text: str, as_of: str | Column) -> DataFrame:
    """df with `__row`, the row of the message in column `text`. Each step is a projection of its own, which Spark doesn't merge as the next uses it more than once."""
    s, low, found = F.col("__subject"), F.col("__low"), F.col("__found")
    steps = df.withColumn("__subject", _subject(F.col(text))).withColumn("__low", F.lower(s)).withColumn("__named", _named(s, low))
    steps = steps.withColumn("__loose", _loose(s, low, F.col("__named"))).withColumn("__found", _parts(s, low, F.col("__loose"))).withColumn("__signs", _signs(s, found))
    # in a generator: filters on its fields can't be pushed below it, where Spark would parse again for each
    row = F.explode_outer(F.array(_row(F.col(text), s, low, found, F.col("__signs"), _literal(as_of)))).alias("__row")
    return steps.select(*[F.col(f"`{c}`") for c in df.columns], row)


def is_ocr(text: Column) -> Column:
    """Whether a text looks like a refill-history screenshot."""
    date = r"\d{4}-\d{2}-\d{2}"
    low = F.lower(text)
    return (F.length(text) > 80) & F.contains(low, F.lit("birr")) & _has(text, rf"{_L}Birr{_R}") & text.rlike(f"(?s){date}.*?{date}") & ~(_any_of(low, _OCR_SMS_WORDS) & _has(text, _OCR_SMS))


def split_messages(df: DataFrame, text_col: str, boilerplate: Callable[[Column], Column] | None = None) -> DataFrame:
    """df with `__blocks` (texts cut at blank lines, or at line ends where there is one block only) and `__many`."""
    full = lambda parts: F.filter(F.transform(parts, trim_all), lambda b: b != "")
    text = F.coalesce(F.col(text_col), F.lit(""))
    broken = F.contains(text, F.lit("\n"))
    parts = F.when(broken, full(F.split(text, rf"\n{BLANK}*\n+"))).otherwise(F.array(trim_all(text)))
    df = df.withColumn("__parts", parts).withColumn("__many", F.size("__parts") > 1)
    none = F.array().cast("array<string>")
    single = F.when(F.get("__parts", F.lit(0)) == "", none).otherwise(F.col("__parts"))
    blocks = F.when(F.col("__many"), F.col("__parts")).when(broken, full(F.split(text, r"\n+"))).otherwise(single)
    return df.withColumn("__blocks", F.filter(blocks, lambda b: ~boilerplate(b)) if boilerplate else blocks).drop("__parts")


def no_transfer_list(text: Column) -> Column:
    """The default for texts that look like another app's list of transfers: none does."""
    return F.lit(False)


def parse_many(
    df: DataFrame,
    text_col: str,
    as_of: str,
    boilerplate: Callable[[Column], Column] | None = None,
    is_transfer_list: Callable[[Column], Column] = no_transfer_list,
    transfer_rows: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row a message: df's columns, `pos` and the parsed fields; columns of df named like these are left out.

    Failures stay, except that a text of several blocks of which one at most is good, but
    which is good as a whole, is one message. Of a text without a good message that
    is_transfer_list holds for, the rows are those of transfer_rows (an array of parsed rows).
    """
    return _parse(df, text_col, as_of, None, boilerplate, is_transfer_list, transfer_rows)


def _parse(df: DataFrame, text_col: str, as_of: str, shots: Column | None, boilerplate=None, is_transfer_list=no_transfer_list, transfer_rows=None) -> DataFrame:
    """parse_many, but of a text with entries in `shots` (arrays of parsed rows) these are the rows."""
    kept, text = _kept(df), F.col(f"`{text_col}`")
    if shots is None:
        split = split_messages(df, text_col, boilerplate)
    else:  # a text with entries isn't split
        df = df.withColumn("__shots", shots)
        split = split_messages(df.withColumn("__split", F.when(F.coalesce(F.size("__shots") > 0, F.lit(False)), "").otherwise(text)), "__split", boilerplate)
    # every pattern holds an amount, and the last asks for no more: a text is good if it has one
    several = F.col("__many") & (F.size("__blocks") > 1)
    good = F.size(F.filter("__blocks", lambda b: _has(b, _ETB_BR)))
    split = split.withColumn("__good", good if transfer_rows else F.when(several, good))
    good = F.col("__good")
    mixed = F.coalesce(several & (good <= 1) & (good < F.size("__blocks")), F.lit(False)) & _has(F.coalesce(text, F.lit("")), _ETB_BR)
    split = split.withColumn("__mixed", mixed)
    split = split.withColumn("__texts", F.when(F.col("__mixed"), F.array(text)).otherwise(F.col("__blocks"))).withColumn("__given", F.lit(None).cast(T.ArrayType(PARSED)))
    if transfer_rows:
        alone = F.col("__many") & (F.size("__blocks") == 1)
        listed = (good == 0) & ~F.col("__mixed") & ~alone & F.coalesce(is_transfer_list(text), F.lit(False))
        rows = F.coalesce(transfer_rows(text).cast(T.ArrayType(PARSED)), F.array().cast(T.ArrayType(PARSED)))
        split = split.withColumn("__given", F.when(listed, rows))
    if shots is not None:
        split = split.withColumn("__given", F.when(F.size("__shots") > 0, F.col("__shots")).otherwise(F.col("__given")))
    split = split.withColumn("__number", F.when(F.col("__given").isNotNull(), F.size("__given")).otherwise(F.size("__texts")))
    places = F.when(F.col("__number") > 0, F.sequence(F.lit(0), F.col("__number") - 1))
    # the outer form: Spark would push the plain one's "there are places" below, and split every text again for it
    each = split.select(*kept, "__texts", "__given", F.explode_outer(places).alias("pos")).where("pos IS NOT NULL")
    block = F.when(F.col("__given").isNull(), F.get("__texts", F.col("pos")))
    each = each.select(*kept, "pos", block.alias("__block"), F.get("__given", F.col("pos")).alias("__given"))
    rows = parse_each(each, "__block", as_of)
    return rows.select(*kept, "pos", *[F.when(F.col("__given").isNotNull(), F.col("__given")[n]).otherwise(F.col("__row")[n]).alias(n) for n in PARSED.names])


def _kept(df: DataFrame) -> list[Column]:
    results = {"pos", *PARSED.names}
    return [F.col(f"`{c}`") for c in df.columns if c not in results]


def parse_text(df: DataFrame, text_col: str, as_of: str, tz: str = "Africa/Addis_Ababa", **hooks) -> DataFrame:
    """parse_many for any pasted text: one that looks like a refill screenshot and has entries gives these, every other its messages."""
    from .ocr import entries

    text = F.col(f"`{text_col}`")
    return _parse(df, text_col, as_of, entries(tz)(F.when(is_ocr(text), text)), **hooks)
