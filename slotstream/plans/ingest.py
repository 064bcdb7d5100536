"""Queries over events and updates: fan-in, deduplication in time, routing, rates and runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotstream.functions import decode
from slotstream.operators import dedupe, sequential
from slotstream.plans.registry import query

FRESH = "f AS (SELECT * FROM v_update QUALIFY row_number() OVER (PARTITION BY logical_key, source ORDER BY seq) = 1)"
MS = "(epoch_us(ts) // 1000)"


def _ms():
    return F.unix_millis(F.col("ts").cast("timestamp"))


def _by_source(*order):
    return Window.partitionBy("source").orderBy(*order)


@query("SELECT seq, source, logical_key, row_number() OVER (PARTITION BY logical_key, source ORDER BY seq) > 1 AS suppressed, sha256(concat(logical_key, '#', CAST(source AS VARCHAR))) AS fingerprint FROM v_update")
def provider_dedupe(v_update):
    turn = F.row_number().over(Window.partitionBy("logical_key", "source").orderBy("seq"))
    return v_update.select("seq", "source", "logical_key", (turn > 1).alias("suppressed"), F.sha2(F.concat_ws("#", "logical_key", F.col("source").cast("string")), 256).alias("fingerprint"))


@query("SELECT logical_key, min(seq) AS seq, arg_min(source, seq) AS source FROM v_update GROUP BY logical_key")
def provider_first_seen(v_update):
    return dedupe.first_per_key(v_update.select("logical_key", "seq", "source"), ("logical_key",), "seq")


@query(f"WITH {FRESH}, r AS (SELECT *, max(priority) OVER (PARTITION BY logical_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM f) SELECT seq, source, priority, logical_key FROM r WHERE best IS NULL OR priority > best")
def provider_promote(v_update):
    return dedupe.promoted(v_update, "logical_key", "source", "priority", "seq").where("emitted").select("seq", "source", "priority", "logical_key")


@query("SELECT source, count(*) AS n, count(DISTINCT logical_key) AS keys, min(seq) AS first_seq FROM (SELECT * FROM v_update WHERE source = 0 UNION ALL SELECT * FROM v_update WHERE source = 1 UNION ALL SELECT * FROM v_update WHERE source = 2) GROUP BY source")
def fanin_union(v_update):
    """The three sources fanned in by name; each identity occurs once."""
    parts = [v_update.where(F.col("source") == i) for i in range(3)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("logical_key").alias("keys"), F.min("seq").alias("first_seq"))


HEALTH = "h AS (SELECT source, arg_max(kind, seq) AS last_kind, max(seq) AS seq FROM v_event GROUP BY source)"
STATE = "CASE last_kind WHEN 'view' THEN 'Healthy' WHEN 'click' THEN 'Healthy' WHEN 'purchase' THEN 'Reconnecting' WHEN 'signup' THEN 'Removed' ELSE 'Unhealthy' END"


@query(f"""WITH {HEALTH}, s AS (SELECT source, source % 3 = 0 AS required, {STATE} AS status FROM h)
SELECT source % 10 AS pool, count(*) AS sources, count(*) FILTER (status IN ('Reconnecting', 'Unhealthy')) AS degraded,
coalesce(CASE WHEN count(*) FILTER (required) > 0 THEN bool_and(status = 'Healthy') FILTER (required) ELSE bool_or(status = 'Healthy') END, false) AS ready FROM s WHERE status <> 'Removed' GROUP BY 1""")
def source_health_ready(v_event):
    """Readiness of each pool: all required sources healthy, or without such, any optional one."""
    last = v_event.groupBy("source").agg(F.max_by("kind", "seq").alias("kind"))
    status = F.when(F.col("kind").isin("view", "click"), "Healthy").when(F.col("kind") == "purchase", "Reconnecting").when(F.col("kind") == "signup", "Removed").otherwise("Unhealthy")
    state = last.select("source", (F.col("source") % 3 == 0).alias("required"), status.alias("status")).where("status <> 'Removed'")
    healthy = F.col("status") == "Healthy"
    ready = F.when(F.count_if("required") > 0, F.bool_and(F.when(F.col("required"), healthy))).otherwise(F.bool_or(healthy))
    return state.groupBy((F.col("source") % 10).alias("pool")).agg(F.count("*").alias("sources"), F.count_if(F.col("status").isin("Reconnecting", "Unhealthy")).alias("degraded"), F.coalesce(ready, F.lit(False)).alias("ready"))


@query("""SELECT seq, source, max(CASE WHEN kind IN ('click', 'purchase') THEN slot END) OVER w AS confirmed, max(CASE WHEN kind = 'purchase' THEN slot END) OVER w AS finalized FROM v_event WINDOW w AS (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def watermark_running(v_event):
    """Running confirmed and finalized slots of each source; finalized also raises confirmed."""
    upto = _by_source("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.col("slot"))).over(upto)
    return v_event.select("seq", "source", top("click", "purchase").alias("confirmed"), top("purchase").alias("finalized"))


@query("""SELECT e.seq, e.slot, (SELECT max(m.slot) FROM v_event m WHERE m.kind = 'purchase' AND m.source = e.source AND m.seq <= e.seq) AS finalized FROM v_event e WHERE e.kind = 'view'""")
def asof_commitment(v_event):
    """Views with the latest finalized slot of their source at that time: an as-of join in one sorted pass."""
    upto = _by_source("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.max(F.when(F.col("kind") == "purchase", F.col("slot"))).over(upto)
    return v_event.withColumn("finalized", latest).where("kind = 'view'").select("seq", "slot", "finalized")


@query("""WITH b AS (SELECT seq, source, slot, props AS hash, max(slot) OVER w AS top, lag(props) OVER (PARTITION BY source ORDER BY seq) AS before FROM v_event WINDOW w AS (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT seq, source, slot, hash FROM b WHERE top IS NULL OR (slot >= top AND before IS DISTINCT FROM hash)""")
def recent_blockhash_changes(v_event):
    """Newer or equal slots whose hash differs from the one before, per source."""
    top = F.max("slot").over(_by_source("seq").rowsBetween(Window.unboundedPreceding, -1))
    before = F.lag("props").over(_by_source("seq"))
    marked = v_event.select("seq", "source", "slot", F.col("props").alias("hash"), top.alias("top"), before.alias("before"))
    return marked.where(F.col("top").isNull() | ((F.col("slot") >= F.col("top")) & ~F.col("before").eqNullSafe(F.col("hash")))).select("seq", "source", "slot", "hash")


@query(f"""WITH a AS (SELECT seq, source, kind, {MS} AS ms, value > 50 AS ok, lag({MS}) OVER w AS before, lag(value > 50) OVER w AS before_ok FROM v_event WINDOW w AS (PARTITION BY source, kind ORDER BY seq))
SELECT seq, source, kind, coalesce(ms - before < CASE WHEN before_ok THEN 30000000 ELSE 3000000 END, false) AS recent_duplicate FROM a""")
def attempt_dedupe(v_event):
    """Attempts soon after the last of the same key: 30,000 s after a success, 3,000 s after a failure."""
    w = Window.partitionBy("source", "kind").orderBy("seq")
    ok = F.col("value") > 50
    limit = F.when(F.lag(ok).over(w), 30_000_000).otherwise(3_000_000)
    return v_event.select("seq", "source", "kind", F.coalesce(_ms() - F.lag(_ms()).over(w) < limit, F.lit(False)).alias("recent_duplicate"))


@query(f"""WITH e AS (SELECT source, seq, {MS} AS ms, row_number() OVER (PARTITION BY source ORDER BY {MS}, seq) AS k FROM v_event),
r(source, seq, k, fresh, anchor) AS (SELECT source, seq, k, true, ms FROM e WHERE k = 1 UNION ALL SELECT e.source, e.seq, e.k, e.ms - anchor >= 86400000, CASE WHEN e.ms - anchor >= 86400000 THEN e.ms ELSE anchor END FROM r JOIN e ON e.source = r.source AND e.k = r.k + 1)
SELECT source, seq, fresh FROM r""", recursive=True)
def signature_ttl_dedupe(v_event):
    """One accepted event per source and day, the day running from the last accepted one."""
    return sequential.expiring(v_event.select("source", "seq", _ms().alias("ms")), "source", "ms", 86_400_000).select("source", "seq", "fresh")


@query(f"WITH e AS (SELECT seq, source, CAST(floor({MS} / 86400000) AS BIGINT) AS w FROM v_event), r AS (SELECT *, row_number() OVER (PARTITION BY source, w ORDER BY seq) AS turn FROM e) SELECT seq, source, w AS window_index, turn <= 3 AS admitted FROM r")
def rate_budget(v_event):
    """At most three requests of a source in each tumbling day."""
    day = F.floor(_ms() / 86_400_000).cast("bigint")
    turn = F.row_number().over(Window.partitionBy("source", day).orderBy("seq"))
    return v_event.select("seq", "source", day.alias("window_index"), (turn <= 3).alias("admitted"))


@query("""WITH e AS (SELECT source, CAST(floor(value) AS BIGINT) AS x, row_number() OVER (PARTITION BY source ORDER BY seq) AS k FROM v_event),
r(source, k, ema) AS (SELECT source, k, x FROM e WHERE k = 1 UNION ALL SELECT e.source, e.k, (7 * ema + e.x) // 8 FROM r JOIN e ON e.source = r.source AND e.k = r.k + 1)
SELECT source, max(k) AS samples, arg_max(ema, k) AS ema FROM r GROUP BY source""", recursive=True)
def rtt_ema(v_event):
    """Integer moving average of each source, streamed in order."""
    each = sequential.moving_average(v_event.select("source", "seq", F.floor("value").cast("bigint").alias("x")), "source", "x", "seq")
    return each.groupBy("source").agg(F.count("*").alias("samples"), F.max_by("ema", "seq").alias("ema"))


SUBSCRIPTIONS = [("a", "view", None, None), ("b", None, 7, None), ("c", "click", None, 3), ("d", None, None, None)]


@query("""WITH s AS (SELECT * FROM (VALUES ('a', 'view', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)), ('b', NULL, 7, NULL), ('c', 'click', NULL, 3), ('d', NULL, NULL, NULL)) AS t(name, kind, source, lane))
SELECT e.seq, s.name FROM v_event e JOIN s ON (s.kind IS NULL OR s.kind = e.kind) AND (s.source IS NULL OR s.source = e.source) AND (s.lane IS NULL OR s.lane = e.seq % 10)""")
def subscription_match(v_event):
    """Events by subscription: null selectors match all.  The literal subscriptions fold into one projection."""
    def matches(s):
        wanted = [(F.col("kind"), s[1]), (F.col("source"), s[2]), (F.col("seq") % 10, s[3])]
        out = F.lit(True)
        for c, v in wanted:
            out = out if v is None else out & (c == v)
        return F.when(out, F.lit(s[0]))

    names = F.filter(F.array(*[matches(s) for s in SUBSCRIPTIONS]), lambda x: x.isNotNull())
    return v_event.select("seq", F.explode(names).alias("name"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 AS even FROM events")
def json_props(events):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select("event_id", k.alias("k"), (k % 2 == 0).alias("even"))


@query(f"""WITH e AS (SELECT seq, source, {MS} AS ms, {MS} - lag({MS}) OVER (PARTITION BY source ORDER BY seq) > 43200000 AS stalled FROM v_event),
g AS (SELECT *, seq - seq + row_number() OVER (PARTITION BY source ORDER BY seq) - row_number() OVER (PARTITION BY source, coalesce(stalled, false) ORDER BY seq) AS run FROM e)
SELECT source, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS ticks, count(*) >= 2 AS sustained FROM g WHERE coalesce(stalled, false) GROUP BY source, run""")
def stall_runs(v_event):
    """Runs of long gaps of each source; two in a row are a sustained stall."""
    w = _by_source("seq")
    stalled = F.coalesce(_ms() - F.lag(_ms()).over(w) > 43_200_000, F.lit(False))
    marked = v_event.select("seq", "source", stalled.alias("stalled"))
    run = F.row_number().over(w) - F.row_number().over(Window.partitionBy("source", "stalled").orderBy("seq"))
    runs = marked.withColumn("run", run).where("stalled").groupBy("source", "run").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("ticks"))
    return runs.select("source", "first_seq", "last_seq", "ticks", (F.col("ticks") >= 2).alias("sustained"))


@query("SELECT source, kind, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total, max(CAST(floor(value) AS BIGINT)) AS worst, arg_max(CAST(floor(value) AS BIGINT), seq) AS latest FROM v_event GROUP BY source, kind")
def latency_summary(v_event):
    ms = F.floor("value").cast("bigint")
    return v_event.groupBy("source", "kind").agg(F.count("*").alias("n"), F.sum(ms).alias("total"), F.max(ms).alias("worst"), F.max_by(ms, "seq").alias("latest"))


@query("""WITH h AS (SELECT slot % 64 AS lane, max(slot) AS head, max(slot) FILTER (kind = 'view') AS tracked FROM v_event GROUP BY 1)
SELECT e.seq, e.slot, e.kind FROM v_event e JOIN h ON h.lane = e.slot % 64 WHERE e.slot BETWEEN greatest(greatest(h.tracked - 31, 0), h.head + 1 - 128) AND h.head QUALIFY row_number() OVER (PARTITION BY e.slot, e.kind ORDER BY e.seq) = 1""")
def replay_gap_scan(v_event):
    """Replay after reconnect, per lane: from the tracked slot less 31, at most 128 slots back, then deduplicated."""
    lane = (F.col("slot") % 64).alias("lane")
    heads = v_event.groupBy(lane).agg(F.max("slot").alias("head"), F.max(F.when(F.col("kind") == "view", F.col("slot"))).alias("tracked"))
    lo = F.greatest(F.greatest(F.col("tracked") - 31, F.lit(0)), F.col("head") + 1 - 128)
    tail = v_event.select("*", lane).join(heads, "lane").where(F.col("slot").between(lo, F.col("head")))
    return dedupe.first_per_key(tail.select("slot", "kind", "seq"), ("slot", "kind"), "seq").select("seq", "slot", "kind")


@query("""WITH m AS (SELECT seq, slot, source, CASE kind WHEN 'view' THEN 'Processed' WHEN 'click' THEN 'Confirmed' WHEN 'purchase' THEN 'Finalized' ELSE 'Orphaned' END AS status FROM v_event)
SELECT seq, source, slot, lag(status) OVER (PARTITION BY source ORDER BY seq) AS previous, status FROM m QUALIFY lag(status) OVER (PARTITION BY source ORDER BY seq) IS DISTINCT FROM status""")
def slot_status_changes(v_event):
    status = F.when(F.col("kind") == "view", "Processed").when(F.col("kind") == "click", "Confirmed").when(F.col("kind") == "purchase", "Finalized").otherwise("Orphaned")
    mapped = v_event.select("seq", "source", "slot", status.alias("status"))
    marked = mapped.withColumn("previous", F.lag("status").over(_by_source("seq")))
    return marked.where(~F.col("previous").eqNullSafe(F.col("status"))).select("seq", "source", "slot", "previous", "status")


@query("""SELECT seq, kind, CASE WHEN kind IN ('view', 'click') THEN 'transaction_applied' WHEN kind = 'purchase' THEN 'slot_status' ELSE 'control' END AS feed, CASE WHEN value > 90 THEN 'inline' ELSE 'deferred' END AS scope FROM v_event WHERE kind = 'purchase' OR value > 10""")
def feed_projection(v_event):
    """Events onto feed kinds and dispatch scope; status changes always pass, others above a floor."""
    feed = F.when(F.col("kind").isin("view", "click"), "transaction_applied").when(F.col("kind") == "purchase", "slot_status").otherwise("control")
    return v_event.where("kind = 'purchase' or value > 10").select("seq", "kind", feed.alias("feed"), F.when(F.col("value") > 90, "inline").otherwise("deferred").alias("scope"))


@query("""WITH x AS (SELECT * FROM (VALUES ('own', true, 'a', 1), ('ingress', true, 'b', 2), ('plain', false, 'b', 3)) AS t(extension, can_ingress, tag, owner))
SELECT e.seq, x.extension FROM v_event e CROSS JOIN x WHERE (e.kind = 'view' AND x.can_ingress) OR e.source % 5 = x.owner OR (x.tag = 'b' AND e.kind = 'click')""")
def extension_visibility(v_event):
    """Which extension may see an event: capability, ownership or shared tag (the extensions are literals)."""
    own = F.col("source") % 5
    rules = {"own": (F.col("kind") == "view") | (own == 1), "ingress": (F.col("kind") == "view") | (own == 2) | (F.col("kind") == "click"), "plain": (own == 3) | (F.col("kind") == "click")}
    seen = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return v_event.select("seq", F.explode(seen).alias("extension"))


@query(f"""WITH n AS (SELECT max({MS}) AS now FROM v_event) SELECT source, round(sum(2 * power(0.5, floor((now - {MS}) / 86400000.0))), 6) AS score FROM v_event, n GROUP BY source""")
def decayed_source_score(v_event):
    """Scores halved each day of age."""
    now = v_event.agg(F.max(_ms()).alias("now"))
    age = F.floor((F.col("now") - _ms()) / 86_400_000)
    return v_event.crossJoin(F.broadcast(now)).groupBy("source").agg(F.round(F.sum(2 * F.pow(F.lit(0.5), age)), 6).alias("score"))


@query(f"""WITH n AS (SELECT max({MS}) AS now FROM v_event) SELECT kind, max(abs(now - {MS})) AS skew_ms FROM v_event, n GROUP BY kind""")
def clock_skew_max(v_event):
    now = v_event.agg(F.max(_ms()).alias("now"))
    return v_event.crossJoin(F.broadcast(now)).groupBy("kind").agg(F.max(F.abs(F.col("now") - _ms())).alias("skew_ms"))


@query("SELECT kind, count(*) AS n, count(*) FILTER (value > 50) AS inserted, count(*) FILTER (value <= 50) AS failed FROM v_event GROUP BY kind")
def outcome_counts(v_event):
    return v_event.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("inserted"), F.count_if(F.col("value") <= 50).alias("failed"))


@query("SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS sequence FROM v_event")
def global_sequence(v_event):
    """Gap-free global numbers: a number within a block of 4096, before it the counts of all earlier blocks.

    Those are summed in two levels, within groups of 4096 blocks and over the groups, so that the
    one ordered table has a row for 16 million numbers.  The join reuses the blocks' shuffle.
    """
    block = F.floor(F.col("seq") / 4096).cast("bigint")
    upto = lambda w, by: w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    sizes = v_event.groupBy(block.alias("block")).agg(F.count("*").alias("n")).withColumn("top", F.floor(F.col("block") / 4096))
    tops = sizes.groupBy("top").agg(F.sum("n").alias("n")).select("top", F.coalesce(F.sum("n").over(upto(Window.partitionBy(F.lit(0)), "top")), F.lit(0)).alias("below"))
    inner = F.coalesce(F.sum("n").over(upto(Window.partitionBy("top"), "block")), F.lit(0))
    base = sizes.withColumn("inner", inner).join(tops, "top").select("block", (F.col("inner") + F.col("below")).alias("base"))
    turn = F.row_number().over(Window.partitionBy("block").orderBy("seq"))
    return v_event.select("seq", block.alias("block")).withColumn("turn", turn).join(base, "block").select("seq", (F.col("base") + F.col("turn") - 1).alias("sequence"))


@query(f"WITH e AS (SELECT seq, source, {MS} AS ms, min({MS}) OVER (PARTITION BY source) AS first_ms, lag({MS}) OVER (PARTITION BY source ORDER BY seq) AS before FROM v_event) SELECT seq, source, ms - first_ms >= 3600000 AND coalesce(ms - before >= 7200000, true) AS can_request FROM e")
def request_cooldown(v_event):
    """Whether a source may ask again: an hour settled and two hours since its last request."""
    first = F.min(_ms()).over(Window.partitionBy("source"))
    gap = _ms() - F.lag(_ms()).over(_by_source("seq"))
    return v_event.select("seq", "source", ((_ms() - first >= 3_600_000) & F.coalesce(gap >= 7_200_000, F.lit(True))).alias("can_request"))


@query("""WITH s AS (SELECT seq, source, value, CASE WHEN value >= 80 THEN 1 WHEN value <= 40 THEN 0 END AS edge FROM v_event)
SELECT seq, source, coalesce(last_value(edge IGNORE NULLS) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS shedding FROM s""")
def load_shed_hysteresis(v_event):
    """Load shedding per source: on from 80, off at 40 and below."""
    edge = F.when(F.col("value") >= 80, True).when(F.col("value") <= 40, False)
    state = F.last(edge, ignorenulls=True).over(_by_source("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return v_event.select("seq", "source", F.coalesce(state, F.lit(False)).alias("shedding"))


@query(f"""WITH e AS (SELECT seq, source, {MS} AS ms, max(CASE WHEN kind = 'click' THEN {MS} END) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pong FROM v_event)
SELECT seq, source, coalesce(ms - pong <= 172800000, false) AS verified, coalesce(ms - pong > 21600000, true) AS ping_again FROM e""")
def ping_validity(v_event):
    """Whether the last pong still counts (two days) and whether a new ping is due (an eighth of that)."""
    pong = F.max(F.when(F.col("kind") == "click", _ms())).over(_by_source("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    age = _ms() - pong
    return v_event.select("seq", "source", F.coalesce(age <= 172_800_000, F.lit(False)).alias("verified"), F.coalesce(age > 21_600_000, F.lit(True)).alias("ping_again"))


@query(f"""WITH n AS (SELECT max({MS}) AS now FROM v_event)
SELECT seq, CASE WHEN length(props) < 8 THEN 'short_payload' WHEN source % 13 = 0 THEN 'wrong_recipient' WHEN now - {MS} > 1728000000 THEN 'expired' WHEN kind = 'error' THEN 'bad_signature' ELSE 'ok' END AS verdict FROM v_event, n""")
def repair_request_check(v_event):
    """First reason to reject a request, in order."""
    now = v_event.agg(F.max(_ms()).alias("now"))
    verdict = F.when(F.length("props") < 8, "short_payload").when(F.col("source") % 13 == 0, "wrong_recipient").when(F.col("now") - _ms() > 1_728_000_000, "expired").when(F.col("kind") == "error", "bad_signature").otherwise("ok")
    return v_event.crossJoin(F.broadcast(now)).select("seq", verdict.alias("verdict"))


@query("""SELECT seq, CASE WHEN value < 5 THEN 'stale_opportunity' WHEN source % 17 = 0 THEN 'suppressed' WHEN kind = 'signup' THEN 'replay_pending' WHEN kind = 'error' THEN 'unsafe_plane' WHEN abs(slot % 40 - 20) > 15 THEN 'state_drift' ELSE 'accepted' END AS outcome,
CASE WHEN value >= 50 THEN 'rpc' WHEN value >= 20 THEN 'direct' WHEN value >= 5 THEN 'relay' END AS route FROM v_event""")
def submit_guard(v_event):
    """First guard that rejects a submission, and the first route that takes it."""
    outcome = F.when(F.col("value") < 5, "stale_opportunity").when(F.col("source") % 17 == 0, "suppressed").when(F.col("kind") == "signup", "replay_pending").when(F.col("kind") == "error", "unsafe_plane").when(F.abs(F.col("slot") % 40 - 20) > 15, "state_drift").otherwise("accepted")
    route = F.when(F.col("value") >= 50, "rpc").when(F.col("value") >= 20, "direct").when(F.col("value") >= 5, "relay")
    return v_event.select("seq", outcome.alias("outcome"), route.alias("route"))


@query("""SELECT seq, CASE seq % 4 WHEN 0 THEN 'logs' WHEN 1 THEN 'transaction' WHEN 2 THEN 'account' END AS method, CASE WHEN seq % 4 < 3 THEN slot END AS slot, CASE WHEN seq % 4 = 0 THEN CAST(source % 3 = 0 AS BOOLEAN) END AS failed, CASE WHEN seq % 4 = 0 THEN 2 END AS n_logs,
CASE WHEN seq % 4 IN (1, 2) AND length(props) <= 10 THEN md5(props) END AS payload, CASE WHEN seq % 4 = 3 THEN 'not_a_notification' WHEN seq % 4 IN (1, 2) AND length(props) > 10 THEN 'too_large' END AS error FROM v_event""")
def notifications(v_event):
    """Websocket messages of three kinds onto events: logs with their verdict, transactions and accounts with a
    base64 payload under its size cap; other messages are reported."""
    seq = F.col("seq")
    logs = F.to_json(F.struct(F.lit("logsNotification").alias("method"), F.struct(F.struct(F.struct(F.col("slot").alias("slot")).alias("context"), F.struct(F.when(F.col("source") % 3 == 0, "failed").alias("err"), F.array(F.lit("a"), F.lit("b")).alias("logs")).alias("value")).alias("result")).alias("params")))
    body = lambda method: F.to_json(F.struct(F.lit(method).alias("method"), F.struct(F.struct(F.struct(F.col("slot").alias("slot")).alias("context"), F.struct(F.array(F.base64(F.encode("props", "UTF-8")), F.lit("base64")).alias("data")).alias("value")).alias("result")).alias("params")))
    message = F.when(seq % 4 == 0, logs).when(seq % 4 == 1, body("transactionNotification")).when(seq % 4 == 2, body("accountNotification")).otherwise(F.lit('{"jsonrpc":"2.0","result":7}'))
    return decode.notification(v_event.select("seq", message.alias("message")), "message", most=10).select("seq", "method", "slot", "failed", "n_logs", F.md5("payload").alias("payload"), "error")
