"""Refill-history screenshots (text from OCR) to rows.

Which amount and which name belong to a date depends on the lines used before, so one
document's lines are matched in an Arrow-batched Python step; only documents that pass
the native gate reach it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..schema import PARSED
from .sms import is_ocr

# Lines that carry nothing, words that are no names, date and amount formats, month names.
NOISE_LINE = re.compile(r"[=–—\-]+$|→|[0-9]{1,2}%$|[0-9]{1,2}:[0-9]{2}$|4G$|5G$|LTE$|Link to agent|Review$", re.I)
NOISE_WORD = re.compile(r"(?a:\b)(Refill History|Agents|Add Agent|Refill|Sent|Received|Transfers)(?a:\b)", re.I)
LABELS = {"Birr", "ETB", "EVD"}
NOT_NAMES = re.compile(r"\bbariso|\bhaji\b|\b(Refill|Agents|Add Agent|Review|Link|Sent|Received|Transfers|Birr|ETB|EVD)\b", re.I | re.A)
NAME, NAME_END = re.compile(r"[A-Za-z\s.'\-]+"), re.compile(r"[^A-Za-z\s]+$")
CLOCK = re.compile(r"\b(\d{4})-(\d{2})-(\d{2})\s*(\d{1,2}):(\d{2})\s*(AM|PM)\b", re.I | re.A)
DAY = re.compile(r"\b(\d{1,2})\s+([A-Za-z]{3,4})\s+(\d{4})\b", re.A)
AMOUNT = re.compile(r"(-?)\D*(\d{1,3}(?:,\d{3})*\.\d{2})", re.A)
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12}
REACH, SPAN = 4, 3
_ROWS = to_arrow_type(T.ArrayType(PARSED))
REVIEW_BELOW = 100_000
#: Lines and times whose reading a worker keeps.
LINES_KEPT = 32_768


def _wall_clock(year: int, month: int, day: int, hour: int = 0, minute: int = 0) -> datetime | None:
    """Fields beyond their range run over into the next."""
    months = year * 12 + month - 1
    if not 12 <= months < 9999 * 12:
        return None
    return datetime(months // 12, months % 12 + 1, 1) + timedelta(days=day - 1, hours=hour, minutes=minute)


def read_date(line: str) -> datetime | None:
    if m := CLOCK.search(line):
        hour = int(m[4])
        if m[6].upper() == "PM":
            hour += 12 * (hour != 12)
        elif hour == 12:
            hour = 0
        return _wall_clock(int(m[1]), int(m[2]), int(m[3]), hour, int(m[5]))
    if (m := DAY.search(line)) and (month := MONTHS.get(m[2].lower())):
        return _wall_clock(int(m[3]), month, int(m[1]))
    return None


def read_amount(line: str) -> tuple[int, bool] | None:
    """(santim, whether a minus stands before it); two decimals are needed, whole years don't count."""
    m = AMOUNT.search(line)
    if not m:
        return None
    cents = int(m[2].replace(",", "").replace(".", ""))
    if cents == 0 or (200_000 <= cents <= 210_000 and cents % 100 == 0):
        return None
    return cents, m[1] == "-"


def read_name(line: str) -> str | None:
    line = line.strip()
    if not 2 <= len(line) <= 40:
        return None
    name = NAME_END.sub("", line).strip()
    if not NAME.fullmatch(name) or NOT_NAMES.search(name):
        return None
    letters = sum(c.isascii() and c.isalpha() for c in name)
    return name if letters >= 2 else None


class Line(NamedTuple):
    """What a line says by itself; `kind` has a bit for each."""

    date: datetime | None
    amount: tuple[int, bool] | None
    name: str | None
    kind: int


_DATE, _AMOUNT, _NAME = 1, 2, 4


@lru_cache(maxsize=LINES_KEPT)
def read_line(line: str) -> Line | None:
    """None for a line that carries nothing. Lists repeat their lines (names, days, headings), so a worker keeps the last ones."""
    if line in LABELS or NOISE_LINE.match(line) or NOISE_WORD.search(line):
        return None
    date, amount, name = read_date(line), read_amount(line), read_name(line)
    return Line(date, amount, name, _DATE * (date is not None) + _AMOUNT * (amount is not None) + _NAME * (name is not None))


@lru_cache(maxsize=LINES_KEPT)
def _moment(local: datetime, tz: str) -> tuple[str, str]:
    """A wall-clock time in zone tz as an ISO date in UTC, and as a note has it."""
    when = local.replace(tzinfo=ZoneInfo(tz)).astimezone(ZoneInfo("UTC"))
    return when.strftime("%Y-%m-%dT%H:%M:%S.000Z").rjust(24, "0"), local.strftime("%d/%m/%Y, %H:%M:%S")


def _places(kinds: bytes) -> list[tuple[int, int, int, int, int]]:
    """Of lines of these kinds the places of each entry's date, amount and name, and the first and the end of the lines around them."""
    free, out = bytearray(kinds), []
    for at, kind in enumerate(kinds):
        if not kind & _DATE:
            continue
        first, end = max(0, at - REACH), min(len(free), at + REACH + 1)
        amount_at = None
        for away in range(REACH + 1):  # of two the earlier
            if at - away >= first and free[at - away] & _AMOUNT:
                amount_at = at - away
                break
            if at + away < end and free[at + away] & _AMOUNT:
                amount_at = at + away
                break
        if amount_at is None:
            continue
        name_at, best = None, REACH + 1
        for i in range(first, end):
            if free[i] & _NAME:
                away = abs(i - at)
                # a name must be nearer in lines than the best so far counts, which is halved across the date
                if away < best:
                    counts = away / 2 if (i > at) != (amount_at > at) else away
                    if counts < best:
                        name_at, best = i, counts
        if name_at is None or abs(name_at - amount_at) > SPAN:
            continue
        free[amount_at] &= ~_AMOUNT
        free[name_at] &= ~_NAME
        out.append((at, amount_at, name_at, max(0, min(at, amount_at, name_at) - 1), max(at, amount_at, name_at) + 2))
    return out


#: Lists of few lines are laid out in few ways, which a worker keeps.
_known_places, SHORT_LIST = lru_cache(maxsize=4_096)(_places), 256


class Entries:
    """Rows of documents one after another, what differs between them column by column; `numbers` has how many each document has."""

    def __init__(self, tz: str):
        self.tz, self.numbers = tz, []
        self.columns = {"raw": [], "amountSantim": [], "party": [], "date": [], "note": [], "needsReview": []}

    def add(self, text: str | None) -> None:
        """The rows of one document: each date takes the nearest free amount and name within REACH lines."""
        raws, santims, parties, dates, notes, reviews = self.columns.values()
        stripped = [s for line in (text or "").split("\n") if (s := line.strip())]
        said = [*map(read_line, stripped)]
        lines, known = [s for s, x in zip(stripped, said) if x], [x for x in said if x]
        kinds = bytes([x.kind for x in known])
        seen = set()
        for at, amount_at, name_at, first, end in (_known_places if len(kinds) <= SHORT_LIST else _places)(kinds):
            (santim, minus), party = known[amount_at].amount, known[name_at].name
            iso, written = _moment(known[at].date, self.tz)
            key = (party, santim, iso[:10])
            if key not in seen:
                seen.add(key)
                raws.append("\n".join(lines[first:end]))
                santims.append(santim)
                parties.append(party)
                dates.append(iso)
                notes.append(f"EVD refill to {party} — {written}")
                reviews.append(minus or santim < REVIEW_BELOW)
        self.numbers.append(len(seen))

    def rows(self) -> pa.StructArray:
        n = sum(self.numbers)
        alike = {"ok": pa.repeat(pa.scalar(True), n), "type": pa.repeat("airtime_evd", n), "channel": pa.repeat("Other", n), "reference": pa.nulls(n, pa.string())}
        fields = list(_ROWS.value_type)
        return pa.StructArray.from_arrays([alike[f.name] if f.name in alike else pa.array(self.columns[f.name], f.type) for f in fields], fields=fields)


def _read(texts: Iterable[str | None], tz: str) -> Entries:
    found = Entries(tz)
    for text in texts:
        found.add(text)
    return found


def match_lines(text: str, tz: str) -> list[dict]:
    """Rows of one document."""
    return _read([text], tz).rows().to_pylist()


def entries(tz: str):
    """A column function: the array of parsed rows of each document's text."""

    @F.arrow_udf(T.ArrayType(PARSED))
    def read(texts: pa.Array) -> pa.Array:
        found = _read(texts.to_pylist(), tz)
        ends = pa.array(accumulate(found.numbers, initial=0), pa.int32())
        return pa.ListArray.from_arrays(ends, found.rows(), type=_ROWS)

    return read


def parse_ocr(df: DataFrame, id_col: str, text_col: str, tz: str = "Africa/Addis_Ababa") -> DataFrame:
    """(id_col, pos, parsed fields) of every document that passes the gate."""
    names = [id_col, "pos", *PARSED.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _read(batch.column(1).to_pylist(), tz)
            of = pa.array([at for at, n in enumerate(found.numbers) for _ in range(n)], pa.int64())
            pos = pa.array([k for n in found.numbers for k in range(n)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pos, *found.rows().flatten()], names)

    # in a generator: the gate can't be pushed below it, where Spark would make a computed text again for each of its tests
    whole = df.select(id_col, F.explode_outer(F.array(text_col)).alias("__text"))
    gated = whole.where(is_ocr(F.col("__text")))
    schema = T.StructType([df.schema[id_col], T.StructField("pos", T.IntegerType()), *PARSED.fields])
    return gated.mapInArrow(run, schema)
