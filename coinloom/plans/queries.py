"""The ledger's queries over the test tables, each with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import DAY_MS, entry_to_santim, format_day, format_etb, format_moment, iso_millis, local_day, millis_iso, signed_etb, start_of_day, text_to_santim, type_label
from ..operators import findings as rules
from ..operators import ingest, listing, ocr, sms
from ..sources import document, store
from ..sources.adapters import form_entries as entries
from ..sources.adapters import messages, pasted, screenshots, transactions
from ..sources.scratch import scratch_path
from ..streaming.findings import LedgerFindings
from ..streaming.views import LedgerTotals

#: 2024-01-31 and 2024-03-10, midnight UTC.
AS_OF, AS_OF_CREDIT = 1_706_659_200_000, 1_710_028_800_000
AS_OF_ISO = "2026-01-01T00:00:00.000Z"
TODAY, ZONE = 1_705_320_000_000, "Africa/Addis_Ababa"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _txn(amount: str) -> str:
    return rf"""WITH txn AS (
        SELECT 'e' || event_id AS id,
               CASE event_type WHEN 'purchase' THEN 'out' WHEN 'signup' THEN 'in' WHEN 'view' THEN 'in' WHEN 'click' THEN 'airtime' ELSE 'credit' END AS type,
               {amount} AS amount,
               (CASE WHEN event_id % 2 = 0 THEN 'Agent ' ELSE 'agent ' END) || (user_id % 7) AS party,
               CASE regexp_extract(props, '([0-9]+)', 1)::INT % 3 WHEN 0 THEN 'CBE' WHEN 1 THEN 'Telebirr' ELSE 'Cash' END AS channel,
               CASE WHEN event_id % 3 = 0 THEN 'R' || user_id END AS reference,
               CASE WHEN event_id % 4 = 0 THEN '=n,"' || event_type END AS note,
               strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') || 'Z' AS date,
               epoch_us(ts) // 1000 AS ms, event_id % 2 = 0 AS settled FROM events) """


FINE = _txn("floor(value * 100 + 0.5)::BIGINT")
COARSE = _txn("floor(value / 100)::BIGINT * 10000 * CASE WHEN event_type = 'click' AND day(ts) = 15 THEN 20 ELSE 1 END")
ROW = "id, type, amount AS amountSantim, party, channel, reference, note, date, settled"


def _duplicates(source: str) -> str:
    return f"""SELECT 'dup:' || prev || ':' || id AS id, 'medium' AS severity, 'duplicate' AS kind, 'Possible duplicate transaction' AS title,
        'Same ' || type || ' of the same amount to "' || party || '" via ' || channel || ' within 10 minutes.' AS reason, [prev, id] AS "txnIds"
        FROM (SELECT *, lag(id) OVER w AS prev, lag(ms) OVER w AS prev_ms FROM {source} WINDOW w AS (PARTITION BY type, amount, lower(party), channel ORDER BY ms, id)) WHERE ms - prev_ms <= 600000"""


def _large(source: str) -> str:
    return f"""SELECT 'large:' || id AS id, 'high' AS severity, 'large_outflow' AS kind, 'Unusually large outflow' AS title, 'More than 3× your 30-day median outflow.' AS reason, [id] AS "txnIds"
        FROM (SELECT *, median(amount) OVER () AS m FROM {source} WHERE type = 'out' AND {AS_OF} - ms < 2592000000) WHERE m > 0 AND amount > 3 * m"""


def _spikes(source: str) -> str:
    return f"""SELECT 'airspike:' || day AS id, 'medium' AS severity, 'airtime_spike' AS kind, 'Airtime spike on ' || day AS title, 'Airtime that day is more than 3× your daily average.' AS reason, ids AS "txnIds"
        FROM (SELECT *, avg(total) OVER () AS average, sum(n) OVER () AS all_n FROM (SELECT date[1:10] AS day, sum(amount) AS total, count(*) AS n, list_sort(list(id)) AS ids FROM {source} WHERE type = 'airtime' GROUP BY 1))
        WHERE all_n > 3 AND total > 3 * average AND total > 5000"""


def _aging(source: str, as_of: int) -> str:
    return f"""SELECT 'aging:' || id AS id, CASE WHEN {as_of} - ms > 5184000000 THEN 'high' ELSE 'medium' END AS severity, 'aging_credit' AS kind,
        'Open credit ' || (({as_of} - ms) // 86400000) || 'd old' AS title, 'Credit to "' || party || '" hasn''t been marked settled.' AS reason, [id] AS "txnIds"
        FROM {source} WHERE type = 'credit' AND NOT settled AND {as_of} - ms > 2592000000"""


def _probes(source: str) -> str:
    return f"""SELECT 'test:' || prev || ':' || id AS id, 'low' AS severity, 'test_before_large' AS kind, 'Small test transfer before a large one' AS title,
        'A tiny round transfer to "' || party || '" was followed by a much larger one within 30 minutes.' AS reason, [prev, id] AS "txnIds"
        FROM (SELECT *, lag(id) OVER w AS prev, lag(ms) OVER w AS prev_ms, lag(amount) OVER w AS prev_amount, lag(party) OVER w AS prev_party FROM {source} WHERE type = 'out' WINDOW w AS (ORDER BY ms, id))
        WHERE ms - prev_ms < 1800000 AND prev_party = party AND prev_amount <= 10000 AND prev_amount % 100000 = 0 AND amount > 20 * prev_amount"""


def _all(source: str) -> str:
    return " UNION ALL ".join([_duplicates(source), _large(source), _spikes(source), _aging(source, AS_OF), _probes(source)])


_IGNORED = f"SELECT 'aging:' || id AS id FROM txn WHERE ms % 2 = 0 UNION ALL SELECT id FROM ({_duplicates('txn')}) WHERE right(id, 1) IN ('0', '2', '4', '6', '8')"


def ignored_ids(txns: DataFrame) -> DataFrame:
    """Dismissed: credits of even milliseconds, duplicates whose later row has an even number."""
    aging = txns.where(F.substring("date", 23, 1).cast("int") % 2 == 0).select(F.concat(F.lit("aging:"), "id").alias("id"))
    return aging.union(rules.duplicates(txns).where(F.right("id", F.lit(1)).isin(*"02468")).select("id"))


@query(FINE + f"SELECT {ROW} FROM txn")
def listing_newest_first(spark, sf_dir):
    return listing.newest_first(transactions(spark, sf_dir))


@query(FINE + f"SELECT {ROW} FROM txn WHERE type = 'out' AND channel = 'CBE' AND contains(lower(party || ' ' || coalesce(reference, '') || ' ' || coalesce(note, '')), '3 r1')")
def history_filter(spark, sf_dir):
    return listing.history(transactions(spark, sf_dir), " 3 R1 ", "out", "CBE")


@query(FINE + "SELECT coalesce(sum(amount) FILTER (type = 'in'), 0)::BIGINT AS in_sum, coalesce(sum(amount) FILTER (type <> 'in'), 0)::BIGINT AS out_sum, count(*) AS n FROM txn WHERE contains(lower(party), 'agent 2')")
def history_totals(spark, sf_dir):
    return listing.history_totals(listing.history(transactions(spark, sf_dir), "agent 2"))


@query(
    FINE
    + ", t AS (SELECT *, ((ms + 10800000) // 86400000) = ((1705320000000 + 10800000) // 86400000) AS today FROM txn) SELECT "
    + ", ".join(f"coalesce(sum(amount) FILTER (today AND type = '{t}'), 0)::BIGINT AS {t}_today" for t in ("in", "out", "airtime"))
    + ", coalesce(sum(amount) FILTER (type = 'credit' AND NOT settled), 0)::BIGINT AS open_credit FROM t"
)
def tiles_today(spark, sf_dir):
    return listing.tiles(transactions(spark, sf_dir), TODAY, ZONE)


@query(FINE + "SELECT count(*) AS n, coalesce(sum(amount) FILTER (type = 'in'), 0)::BIGINT AS in_sum, coalesce(sum(amount) FILTER (type = 'out'), 0)::BIGINT AS out_sum FROM txn")
def export_totals(spark, sf_dir):
    return listing.export_totals(transactions(spark, sf_dir))


_ROLLUP = """SELECT coalesce(nullif(trim(party), ''), 'Unknown') AS party, coalesce(sum(amount) FILTER (type = 'in'), 0)::BIGINT AS in_sum,
    coalesce(sum(amount) FILTER (type <> 'in' AND NOT (type = 'credit' AND NOT settled)), 0)::BIGINT AS out_sum,
    coalesce(sum(amount) FILTER (type = 'credit' AND NOT settled), 0)::BIGINT AS credit_sum, count(*) AS n, max(date) AS last FROM txn GROUP BY 1"""


@query(FINE + _ROLLUP)
def party_rollup(spark, sf_dir):
    return listing.party_rollup(transactions(spark, sf_dir))


@query(FINE + f"SELECT *, in_sum - out_sum AS net FROM ({_ROLLUP})")
def party_rank(spark, sf_dir):
    return listing.party_ranking(transactions(spark, sf_dir))


@query(FINE + f"SELECT {ROW} FROM txn WHERE type = 'credit' AND NOT settled")
def open_credit(spark, sf_dir):
    return transactions(spark, sf_dir).where(listing.open_credit())


@query(COARSE + _duplicates("txn"))
def leak_duplicate(spark, sf_dir):
    return rules.duplicates(transactions(spark, sf_dir, coarse=True))


@query(FINE + _large("txn"))
def leak_large_outflow(spark, sf_dir):
    return rules.large_outflows(transactions(spark, sf_dir), AS_OF)


@query(COARSE + _spikes("txn"))
def leak_airtime_spike(spark, sf_dir):
    return rules.airtime_spikes(transactions(spark, sf_dir, coarse=True))


@query(FINE + _aging("txn", AS_OF_CREDIT))
def leak_aging_credit(spark, sf_dir):
    return rules.aging_credits(transactions(spark, sf_dir), AS_OF_CREDIT)


@query(COARSE + _probes("txn"))
def leak_test_before_large(spark, sf_dir):
    return rules.probes(transactions(spark, sf_dir, coarse=True))


@query(COARSE + _all("txn"))
def findings_all(spark, sf_dir):
    return rules.all_findings(transactions(spark, sf_dir, coarse=True), AS_OF)


@query(COARSE + f"SELECT * FROM ({_all('txn')}) WHERE id NOT IN ({_IGNORED})")
def findings_active(spark, sf_dir):
    t = transactions(spark, sf_dir, coarse=True)
    return rules.active(rules.all_findings(t, AS_OF), ignored_ids(t))


@query(COARSE + f"SELECT * FROM ({_all('txn')}) WHERE id IN ({_IGNORED})")
def findings_dismissed(spark, sf_dir):
    t = transactions(spark, sf_dir, coarse=True)
    return rules.dismissed(rules.all_findings(t, AS_OF), ignored_ids(t))


@query(COARSE + f"""SELECT f.id AS finding_id, (u.pos - 1)::INTEGER AS position, t.id, t.amount AS "amountSantim" FROM ({_all('txn')}) f, LATERAL (SELECT unnest(f."txnIds") AS m, generate_subscripts(f."txnIds", 1) AS pos) u JOIN txn t ON t.id = u.m""")
def finding_members(spark, sf_dir):
    t = transactions(spark, sf_dir, coarse=True)
    return rules.members(rules.all_findings(t, AS_OF), t).select("finding_id", "position", "id", "amountSantim")


#: The order of the SQL: rows come as they happened, whatever their numbers.
_AS_HAPPENED = ("ms", "id")


def _numbered(spark, sf_dir):
    return transactions(spark, sf_dir, coarse=True).withColumn("seq", F.substring("id", 2, 20).cast("long")).withColumn("ms", iso_millis("date"))


_DEDUPE = """, k AS (SELECT *, dense_rank() OVER (ORDER BY type, amount, lower(party), channel) AS key FROM txn),
    n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, id) AS pos, min(ms) OVER (PARTITION BY key ORDER BY ms RANGE BETWEEN 600001 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ms FROM k),
    r AS MATERIALIZED (SELECT key, ms, next_ms, pos, id FROM n)"""


@query("WITH RECURSIVE " + COARSE[5:] + _DEDUPE + """, g AS (SELECT key, id, next_ms FROM r WHERE pos = 1
        UNION ALL SELECT r.key, r.id, r.next_ms FROM g JOIN r ON r.key = g.key AND r.ms = g.next_ms)
    SELECT id, id IN (SELECT id FROM g) AS kept FROM txn""")
def ingest_dedupe(spark, sf_dir):
    return ingest.dedupe(_numbered(spark, sf_dir), order=_AS_HAPPENED).select("id", "kept")


@query("WITH RECURSIVE " + COARSE[5:] + _DEDUPE + """, g AS (SELECT key, id, next_ms FROM r WHERE pos = 1
        UNION ALL SELECT r.key, r.id, r.next_ms FROM g JOIN r ON r.key = g.key AND r.ms = g.next_ms)
    SELECT (SELECT count(*) FROM g) AS inserted, count(*) - (SELECT count(*) FROM g) AS skipped FROM txn""")
def ingest_counts(spark, sf_dir):
    return ingest.ingest_counts(ingest.dedupe(_numbered(spark, sf_dir), order=_AS_HAPPENED))


_KNOWN = COARSE.replace("WITH txn AS (", "every AS (") + """, txn AS (SELECT * FROM every a WHERE id[2:]::BIGINT % 5 <> 0 AND NOT EXISTS (
        SELECT 1 FROM every b WHERE b.id[2:]::BIGINT % 5 = 0 AND a.type = b.type AND a.amount = b.amount AND lower(a.party) = lower(b.party) AND a.channel = b.channel AND abs(a.ms - b.ms) <= 600000))"""


@query("WITH RECURSIVE " + _KNOWN + _DEDUPE + """, g AS (SELECT key, id, next_ms FROM r WHERE pos = 1
        UNION ALL SELECT r.key, r.id, r.next_ms FROM g JOIN r ON r.key = g.key AND r.ms = g.next_ms)
    SELECT id, id IN (SELECT id FROM g) AS kept FROM every WHERE id[2:]::BIGINT % 5 <> 0""")
def ingest_dedupe_known(spark, sf_dir):
    """Every fifth row is in the ledger already."""
    t = _numbered(spark, sf_dir)
    return ingest.dedupe(t.where("seq % 5 <> 0"), t.where("seq % 5 = 0").drop("seq"), order=_AS_HAPPENED).select("id", "kept")


@query(FINE + f"SELECT {ROW.replace('amount AS', 'CASE WHEN type = $$out$$ THEN 7 ELSE amount END AS')} FROM txn")
def upsert_by_id(spark, sf_dir):
    t = transactions(spark, sf_dir)
    new = [t.where("type = 'out'").withColumn("amountSantim", F.lit(a).cast("long")).withColumn("seq", F.lit(a)) for a in (5, 7)]
    return ingest.upsert(t, new[0].unionByName(new[1]), "seq")


@query(FINE + f"SELECT {ROW} FROM txn WHERE type <> 'credit'")
def delete_by_id(spark, sf_dir):
    t = transactions(spark, sf_dir)
    return ingest.delete(t, t.where("type = 'credit'").select("id"))


@query("""WITH RECURSIVE txn AS (SELECT 'e' || event_id AS id, event_id * 60000 + (event_id % 7) * 1000 AS ms FROM events),
        r AS MATERIALIZED (SELECT id, ms, min(ms) OVER (ORDER BY ms RANGE BETWEEN 600001 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ms, row_number() OVER (ORDER BY ms) AS pos FROM txn),
        g AS (SELECT id, next_ms FROM r WHERE pos = 1 UNION ALL SELECT r.id, r.next_ms FROM g JOIN r ON r.ms = g.next_ms)
    SELECT id, id IN (SELECT id FROM g) AS kept FROM txn""")
def ingest_long_island(spark, sf_dir):
    """All rows are of one key, a minute apart: one island."""
    number = F.substring("id", 2, 20).cast("long")
    alike = {"type": "in", "party": "one", "channel": "CBE"}
    rows = transactions(spark, sf_dir).withColumns({c: F.lit(v) for c, v in alike.items()}).withColumn("amountSantim", F.lit(1).cast("long"))
    rows = rows.withColumn("date", millis_iso(number * 60_000 + number % 7 * 1000)).withColumn("seq", number)
    return ingest.dedupe(rows, long_island=2_000).select("id", "kept")


@query("WITH RECURSIVE " + COARSE[5:] + _DEDUPE + """, g AS (SELECT key, id, next_ms FROM r WHERE pos = 1
        UNION ALL SELECT r.key, r.id, r.next_ms FROM g JOIN r ON r.key = g.key AND r.ms = g.next_ms) SELECT id FROM g""")
def ledger_concurrent_insert(spark, sf_dir):
    """Two writers insert the same rows at once."""
    path = scratch_path(spark, "ledger")
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda _: store.Ledger(spark, path).add_deduped(_numbered(spark, sf_dir), _AS_HAPPENED), range(2)))
    return store.Ledger(spark, path).transactions().select("id")


@query(FINE + f"SELECT {ROW.replace('amount AS', 'CASE WHEN type = $$out$$ THEN 7 ELSE amount END AS')} FROM txn WHERE type <> 'credit'")
def ledger_update_delete(spark, sf_dir):
    """Rows put over others and rows deleted, read back without a rewrite."""
    t = transactions(spark, sf_dir)
    ledger = store.Ledger(spark, scratch_path(spark, "ledger"))
    ledger.add(t, now=AS_OF_ISO)
    ledger.restore(t.where("type = 'out'").withColumn("amountSantim", F.lit(7).cast("long")).withColumn("seq", F.lit(0)))
    ledger.delete(t.where("type = 'credit'").select("id"))
    return ledger.transactions().select(*t.columns)


@query(FINE + f"SELECT {ROW} FROM txn WHERE ms BETWEEN 1705276800000 AND 1705363199999")
def ledger_one_day(spark, sf_dir):
    """One day of a ledger, from the files that hold it."""
    t = transactions(spark, sf_dir)
    ledger = store.Ledger(spark, scratch_path(spark, "ledger"))
    ledger.add(t, now=AS_OF_ISO)
    return ledger.transactions(1_705_276_800_000, 1_705_363_199_999).select(*t.columns)


_CHANGED = FINE + ", changed AS (SELECT * REPLACE (CASE WHEN type = 'out' THEN 7 ELSE amount END AS amount) FROM txn WHERE type <> 'credit' OR id[2:]::BIGINT % 3 <> 0) "


def _changed_totals(spark, sf_dir) -> LedgerTotals:
    """Totals that followed two insertions, an update of all outflows and a deletion of every third credit."""
    t = transactions(spark, sf_dir)
    number = F.substring("id", 2, 20).cast("long")
    ledger = store.Ledger(spark, scratch_path(spark, "ledger"))
    totals = LedgerTotals(ledger, scratch_path(spark, "totals"), ZONE)
    changed = t.where("type = 'out'").withColumn("amountSantim", F.lit(7).cast("long")).withColumn("seq", F.lit(0))
    for change in (
        lambda: ledger.add(t.where(number % 2 == 0), now=AS_OF_ISO),
        lambda: ledger.add(t.where(number % 2 == 1), now=AS_OF_ISO),
        lambda: ledger.restore(changed),
        lambda: ledger.delete(t.where((F.col("type") == "credit") & (number % 3 == 0)).select("id")),
    ):
        change()
        totals.refresh()
    return totals


#: Outflows of even ids become tenfold, so that outflows, probes and duplicates change; every third credit goes.
_REVISED = COARSE + ", revised AS (SELECT * REPLACE (CASE WHEN type = 'out' AND id[2:]::BIGINT % 2 = 0 THEN amount * 10 ELSE amount END AS amount) FROM txn WHERE type <> 'credit' OR id[2:]::BIGINT % 3 <> 0) "


@query(_REVISED + _all("revised"))
def findings_incremental(spark, sf_dir):
    """Findings that followed two insertions, an update and a deletion."""
    t = transactions(spark, sf_dir, coarse=True)
    number = F.substring("id", 2, 20).cast("long")
    ledger = store.Ledger(spark, scratch_path(spark, "ledger"))
    found = LedgerFindings(ledger, scratch_path(spark, "findings"))
    for change in (
        lambda: ledger.add(t.where(number % 5 < 3), now=AS_OF_ISO),
        lambda: ledger.add(t.where(number % 5 >= 3), now=AS_OF_ISO),
        lambda: ledger.restore(t.where((F.col("type") == "out") & (number % 2 == 0)).withColumn("amountSantim", F.col("amountSantim") * 10).withColumn("seq", F.lit(0))),
        lambda: ledger.delete(t.where((F.col("type") == "credit") & (number % 3 == 0)).select("id")),
    ):
        change()
        found.refresh()
    return found.findings(AS_OF)


@query(_CHANGED + _ROLLUP.replace("FROM txn", "FROM changed"))
def party_rollup_incremental(spark, sf_dir):
    return _changed_totals(spark, sf_dir).party_rollup()


@query(
    _CHANGED
    + ", t AS (SELECT *, ((ms + 10800000) // 86400000) = ((1705320000000 + 10800000) // 86400000) AS today FROM changed) SELECT "
    + ", ".join(f"coalesce(sum(amount) FILTER (today AND type = '{t}'), 0)::BIGINT AS {t}_today" for t in ("in", "out", "airtime"))
    + ", coalesce(sum(amount) FILTER (type = 'credit' AND NOT settled), 0)::BIGINT AS open_credit FROM t"
)
def tiles_incremental(spark, sf_dir):
    return _changed_totals(spark, sf_dir).tiles(TODAY)


_CELL = """CASE WHEN regexp_matches(x, '[",\\n]') THEN '"' || replace(x, '"', '""') || '"' ELSE x END"""


def _cell(x: str) -> str:
    guarded = f"""(CASE WHEN regexp_matches(coalesce({x}, ''), '^[=+\\-@\\t\\r]') THEN '''' || {x} ELSE coalesce({x}, '') END)"""
    return f"""(CASE WHEN regexp_matches({guarded}, '[",\\n]') THEN '"' || replace({guarded}, '"', '""') || '"' ELSE {guarded} END)"""


@query(FINE + f"SELECT coalesce(median(amount), 0)::DOUBLE AS median FROM txn WHERE type = 'out' AND {AS_OF} - ms < 2592000000")
def outflow_median(spark, sf_dir):
    recent = transactions(spark, sf_dir).where((F.col("type") == "out") & (F.lit(AS_OF) - iso_millis("date") < 30 * DAY_MS))
    return rules.exact_median(recent, "amountSantim")


@query(FINE + "SELECT date[1:10] AS day, sum(amount)::BIGINT AS total, count(*) AS n FROM txn WHERE type = 'airtime' GROUP BY 1")
def airtime_days(spark, sf_dir):
    return rules.airtime_days(transactions(spark, sf_dir))


@query(COARSE + f"SELECT id FROM ({_IGNORED}) UNION SELECT id FROM ({_aging('txn', AS_OF_CREDIT)})")
def ignored_add(spark, sf_dir):
    t = transactions(spark, sf_dir, coarse=True)
    return rules.ignore(ignored_ids(t), rules.aging_credits(t, AS_OF_CREDIT))


@query(COARSE + f"SELECT id FROM ({_IGNORED}) WHERE id NOT IN (SELECT id FROM ({_aging('txn', AS_OF_CREDIT)}))")
def ignored_remove(spark, sf_dir):
    t = transactions(spark, sf_dir, coarse=True)
    return rules.restore(ignored_ids(t), rules.aging_credits(t, AS_OF_CREDIT))


@query(FINE + f"SELECT {ROW} FROM txn")
def backup_round_trip(spark, sf_dir):
    t = transactions(spark, sf_dir)
    path = scratch_path(spark, "backup")
    store.write_backup(t, path)
    return store.read_backup(spark, path).select(*t.columns)


@query(FINE + f"SELECT {ROW} FROM txn")
def backup_document_round_trip(spark, sf_dir):
    """One document, written as one file and read by many tasks."""
    t = transactions(spark, sf_dir)
    path = scratch_path(spark, "document")
    document.write_document(t, path)
    return document.read_document(spark, path).select(*t.columns)


@query(r"""SELECT c_custkey, replace(c_name, '#', ' ') AS party, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS note,
    floor(round(abs(c_acctbal), 2)::DOUBLE * 100 + 0.5)::BIGINT AS "amountSantim" FROM customer WHERE c_custkey % 7 <> 0 AND floor(round(abs(c_acctbal), 2)::DOUBLE * 100 + 0.5) > 0""")
def form_entries(spark, sf_dir):
    return store.from_form(entries(spark, sf_dir)).select("c_custkey", "party", "note", "amountSantim")


@query(FINE + r"""SELECT id, (CASE WHEN type = 'in' THEN '+' ELSE '−' END) || regexp_replace((amount // 100)::VARCHAR, '(\d)(\d{3})$', '\1,\2') || '.' || lpad((amount % 100)::VARCHAR, 2, '0') || ' ETB' AS text FROM txn""")
def signed_amounts(spark, sf_dir):
    return transactions(spark, sf_dir).select("id", signed_etb(F.col("type") == "in", "amountSantim").alias("text"))


@query(FINE + """, l AS (SELECT id, ms + 10800000 AS here FROM txn), z AS (SELECT id, here, make_timestamp(here * 1000) AS clock FROM l)
    SELECT id, clock::DATE::VARCHAR AS day, strftime(clock, '%b %d, %Y') AS day_text, strftime(clock, '%b %d, %Y, %H:%M') AS moment_text,
        strftime(make_timestamp((here // 86400000 * 86400000 - 10800000) * 1000), '%Y-%m-%dT%H:%M:%S.000Z') AS day_start FROM z""")
def local_dates(spark, sf_dir):
    ms = iso_millis("date")
    return transactions(spark, sf_dir).select("id", local_day(ms, ZONE).cast("string").alias("day"), format_day(ms, ZONE).alias("day_text"), format_moment(ms, ZONE).alias("moment_text"), start_of_day(ms, ZONE).alias("day_start"))


@query(FINE + "SELECT id, date, " + " || ',' || ".join(_cell(x) for x in ("date", "type", "(amount::DECIMAL(20,0) / 100)::DECIMAL(20,2)::VARCHAR", "party", "channel", "reference", "note", "(CASE WHEN type = 'credit' THEN CASE WHEN settled THEN 'yes' ELSE 'no' END END)")) + " AS value FROM txn")
def csv_rows(spark, sf_dir):
    return store.csv_rows(transactions(spark, sf_dir))


@query("SELECT o_orderkey, floor(round(o_totalprice, 2)::DOUBLE * 100 + 0.5)::BIGINT AS typed, floor(round(o_totalprice, 2)::DOUBLE * 100 + 0.5)::BIGINT AS entered FROM orders")
def santim_parse(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("t", F.format_number("o_totalprice", 2))
    return o.select("o_orderkey", text_to_santim(F.concat(F.lit(" "), "t")).alias("typed"), entry_to_santim(F.concat(F.lit("ETB -"), "t")).alias("entered"))


@query(FINE + r"""SELECT id, regexp_replace((amount // 100)::VARCHAR, '(\d)(\d{3})$', '\1,\2') || '.' || lpad((amount % 100)::VARCHAR, 2, '0') || ' ETB' AS text,
    CASE type WHEN 'in' THEN 'Money In' WHEN 'out' THEN 'Money Out' WHEN 'airtime' THEN 'Airtime' WHEN 'credit' THEN 'Credit' END AS label FROM txn""")
def format_amounts(spark, sf_dir):
    return transactions(spark, sf_dir).select("id", format_etb("amountSantim").alias("text"), type_label("type").alias("label"))


_SMS = """WITH m AS (SELECT o_orderkey AS k, floor(round(o_totalprice, 2)::DOUBLE * 100 + 0.5)::BIGINT AS a, replace(c_name, '#', ' ') AS c, 'TB' || o_orderkey AS ref FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT k AS msg_id, k % 11 <> 10 AS ok, CASE WHEN k % 11 IN (0, 3, 5) THEN 'in' WHEN k % 11 = 2 THEN 'airtime' WHEN k % 11 = 8 THEN 'credit' WHEN k % 11 <> 10 THEN 'out' END AS type,
        CASE WHEN k % 11 <> 10 THEN a END AS "amountSantim",
        CASE WHEN k % 11 IN (0, 1, 3, 5, 6, 7) THEN c WHEN k % 11 = 2 THEN 'Airtime' WHEN k % 11 <> 10 THEN 'Unknown' END AS party,
        CASE WHEN k % 11 < 3 THEN 'Telebirr' WHEN k % 11 < 5 THEN 'CBE' WHEN k % 11 = 5 THEN 'Awash' WHEN k % 11 = 6 THEN 'Dashen' WHEN k % 11 < 10 THEN 'Other' END AS channel,
        CASE WHEN k % 11 IN (0, 1, 3, 4, 5, 6) AND length(ref) >= 4 THEN ref END AS reference,
        CASE WHEN k % 11 <> 10 THEN k % 11 = 9 END AS "needsReview" FROM m"""


@query(_SMS)
def sms_parse(spark, sf_dir):
    rows = sms.parse_many(messages(spark, sf_dir), "text", AS_OF_ISO)
    return rows.select("msg_id", "ok", "type", "amountSantim", "party", "channel", "reference", "needsReview")


@query("WITH p AS (" + _SMS + ") SELECT msg_id, type, \"amountSantim\", party, channel, reference FROM p WHERE ok")
def sms_import(spark, sf_dir):
    rows = store.from_parsed(sms.parse_many(messages(spark, sf_dir), "text", AS_OF_ISO), AS_OF_ISO)
    return rows.select("msg_id", "type", "amountSantim", "party", "channel", "reference")


_OCR = """o AS (SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%d/%m/%Y') AS dm, format('{:,.2f}', o_totalprice) AS a FROM orders),
    e AS (SELECT *, unnest([0, 1, 2]) AS pos, floor(replace(a, ',', '')::DOUBLE * 100 + 0.5)::BIGINT AS cents FROM o),
    n AS (SELECT *, ['Almaz Abebe', 'Kebede Abebe', 'Sara Abebe'][pos + 1] AS party FROM e WHERE NOT (cents BETWEEN 200000 AND 210000 AND cents % 100 = 0)),
    shot AS (SELECT doc_id, pos, true AS ok, CASE WHEN pos > 0 THEN a || ' Birr' || chr(10) ELSE '' END || d || ' ' || (pos + 1) || ':05 PM' || chr(10) || party || chr(10) || a || ' Birr'
            || CASE WHEN pos < 2 THEN chr(10) || d || ' ' || (pos + 2) || ':05 PM' ELSE '' END AS raw,
        'airtime_evd' AS type, cents AS "amountSantim", party, 'Other' AS channel, NULL::VARCHAR AS reference, d || 'T' || (10 + pos) || ':05:00.000Z' AS date,
        'EVD refill to ' || party || ' — ' || dm || ', ' || (13 + pos) || ':05:00' AS note, cents < 100000 AS "needsReview" FROM n)"""


@query("WITH " + _OCR + " SELECT * FROM shot")
def ocr_parse(spark, sf_dir):
    return ocr.parse_ocr(screenshots(spark, sf_dir), "doc_id", "text")


#: Each message alone and twice in one text, and each screenshot.
_PASTED = "WITH " + _OCR + ", m AS (" + _SMS + f"""), p AS (
        SELECT 'm' || msg_id AS doc, 0 AS pos, * EXCLUDE (msg_id), '{AS_OF_ISO}' AS date FROM m
        UNION ALL SELECT 'b' || msg_id, unnest([0, 1]), * EXCLUDE (msg_id), '{AS_OF_ISO}' FROM m
        UNION ALL SELECT 's' || doc_id, pos, ok, type, "amountSantim", party, channel, reference, "needsReview", date FROM shot) """


@query(_PASTED + """SELECT doc, pos, ok, type, "amountSantim", party, channel, reference, "needsReview", CASE WHEN ok THEN date END AS date FROM p""")
def text_parse(spark, sf_dir):
    rows = sms.parse_text(pasted(spark, sf_dir), "text", AS_OF_ISO, ZONE)
    return rows.select("doc", "pos", "ok", "type", "amountSantim", "party", "channel", "reference", "needsReview", "date")


@query(_PASTED + f"""SELECT DISTINCT type, "amountSantim", party, channel, date, true AS has_id, '{AS_OF_ISO}' AS "createdAt" FROM p WHERE ok""")
def paste_import(spark, sf_dir):
    """Pasted texts parsed and inserted without the repeats, then the ledger read back."""
    ledger = store.Ledger(spark, scratch_path(spark, "ledger"))
    ledger.paste(pasted(spark, sf_dir), "text", AS_OF_ISO, "n", ZONE)
    return ledger.transactions().select("type", "amountSantim", "party", "channel", "date", (F.length("id") == 24).alias("has_id"), "createdAt")
