"""Queries over transactions: classification, filters, routing and touches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotstream.functions import commitment
from slotstream.plans.registry import query

WATER = "w AS (SELECT max(slot) AS tip, max(slot) - 32 AS confirmed, max(slot) - 150 AS finalized FROM v_tx)"
STATUS = "CASE WHEN slot <= finalized THEN 'Finalized' WHEN slot <= confirmed THEN 'Confirmed' ELSE 'Processed' END"
KIND = "CASE WHEN bool_or(program = 'vote') AND bool_or(program = 'other') THEN 'Mixed' WHEN bool_or(program = 'vote') THEN 'VoteOnly' ELSE 'NonVote' END"
TX = f"tx AS (SELECT slot, {KIND} AS kind, bool_or(failed) AS failed, list(DISTINCT account) AS keys, list(DISTINCT program_account) AS programs, min(payer) AS payer FROM v_tx GROUP BY slot)"


def transactions(v_tx):
    """One row per transaction: kind, failure, keys, programs and payer."""
    return v_tx.groupBy("slot").agg(commitment.tx_kind(F.collect_set("program")).alias("kind"), F.bool_or("failed").alias("failed"), F.collect_set("account").alias("keys"), F.collect_set("program_account").alias("programs"), F.min("payer").alias("payer"))


def _status(frame, v_tx):
    tip = v_tx.agg(F.max("slot").alias("tip"))
    status = commitment.from_slot(F.col("slot"), F.col("tip") - commitment.CONFIRMED_DEPTH, F.col("tip") - commitment.FINALIZED_DEPTH)
    return frame.crossJoin(F.broadcast(tip)).withColumn("status", status)


@query(f"WITH {WATER} SELECT {STATUS} AS status, count(*) AS n, count(*) FILTER ({STATUS} <> 'Processed') AS at_least_confirmed FROM v_tx, w GROUP BY 1")
def commitment_counts(v_tx):
    out = _status(v_tx, v_tx).groupBy("status").agg(F.count("*").alias("n"))
    return out.select("status", "n", F.when(commitment.at_least(F.col("status"), "Confirmed"), F.col("n")).otherwise(0).alias("at_least_confirmed"))


@query(f"SELECT slot, {KIND} AS kind FROM v_tx GROUP BY slot")
def tx_kind(v_tx):
    return transactions(v_tx).select("slot", "kind")


@query("SELECT slot % 50 AS bucket, count(*) FILTER (kind = 'VoteOnly') AS vote_only, count(*) FILTER (kind = 'Mixed') AS mixed, count(*) FILTER (kind = 'NonVote') AS non_vote FROM " + f"(SELECT slot, {KIND} AS kind FROM v_tx GROUP BY slot) GROUP BY 1")
def tx_kind_pivot(v_tx):
    kinds = transactions(v_tx).select((F.col("slot") % 50).alias("bucket"), "kind")
    wide = kinds.groupBy("bucket").pivot("kind", ["VoteOnly", "Mixed", "NonVote"]).count().na.fill(0)
    return wide.toDF("bucket", "vote_only", "mixed", "non_vote")


@query(f"""WITH {TX} SELECT slot, CASE WHEN list_has_any(keys, [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]) AND NOT list_has_any(keys, [4, 6]) AND list_has_all(keys, []) THEN CASE WHEN list_has_any(keys, [5, 8]) THEN 'Critical' ELSE 'Background' END ELSE 'Ignore' END AS interest FROM tx""")
def tx_prefilter(v_tx):
    """Interest of a subscription: any of its include keys, none of its exclude keys, some keys critical."""
    tx = transactions(v_tx).select("slot", "keys")
    match = commitment.prefilter(F.col("keys"), include=[1, 2, 3, 5, 8, 13, 21, 34, 55, 89], exclude=[4, 6])
    urgent = commitment.prefilter(F.col("keys"), include=[5, 8])
    return tx.select("slot", F.when(match, F.when(urgent, "Critical").otherwise("Background")).otherwise("Ignore").alias("interest"))


@query(f"WITH {TX} SELECT slot, kind, failed FROM tx WHERE kind <> 'VoteOnly' AND NOT failed AND (list_contains(list_concat(keys, programs), 7) OR list_contains(list_concat(keys, programs), 11))")
def ws_filter(v_tx):
    """No simple votes, no failures, and a key among static keys or loaded addresses (Mixed is no vote)."""
    present = F.concat("keys", "programs")
    return transactions(v_tx).where((F.col("kind") != "VoteOnly") & ~F.col("failed") & commitment.prefilter(present, include=[7, 11])).select("slot", "kind", "failed")


@query("SELECT slot, ix, account, row_number() OVER (PARTITION BY slot ORDER BY ix, account, program_account, program) - 1 AS tx_index FROM v_tx")
def tx_index(v_tx):
    order = Window.partitionBy("slot").orderBy("ix", "account", "program_account", "program")
    return v_tx.select("slot", "ix", "account", (F.row_number().over(order) - 1).cast("bigint").alias("tx_index"))


@query("""WITH k AS (SELECT slot, list(account ORDER BY ix, account, program_account, program) AS keys FROM v_tx GROUP BY slot)
SELECT slot, list_distinct(keys[:1] || keys[3:len(keys) - 1]) IS NOT NULL AND true AS ok, CAST(len(keys) AS BIGINT) AS n_keys, CAST(len(keys[:2]) AS BIGINT) AS n_signers, keys[1] AS fee_payer,
array_to_string(list_concat(keys[:1], keys[3:len(keys) - 1]), ',') AS writable, array_to_string(list_concat(keys[2:2], CASE WHEN len(keys) > 2 THEN keys[len(keys):] ELSE [] END), ',') AS readonly FROM k""")
def account_touch_partition(v_tx):
    """Keys split by header: two signers (the second read-only), and the last key read-only."""
    ordered = v_tx.groupBy("slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", "account", "program_account", "program"))), lambda x: x["account"]).alias("keys"))
    n = F.size("keys")
    writable = F.filter("keys", lambda k, i: (i == 0) | ((i >= 2) & (i < n - 1)))
    readonly = F.filter("keys", lambda k, i: (i == 1) | ((i == n - 1) & (i >= 2)))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return ordered.select("slot", F.lit(True).alias("ok"), n.cast("bigint").alias("n_keys"), F.least(n, F.lit(2)).cast("bigint").alias("n_signers"), F.element_at("keys", 1).alias("fee_payer"), text(writable).alias("writable"), text(readonly).alias("readonly"))


@query(f"""WITH {TX}, {WATER}, p AS (SELECT * FROM (VALUES ('votes', 'VoteOnly', 'Processed', 'inline'), ('others', 'NonVote', 'Confirmed', 'deferred'), ('mixed', 'Mixed', 'Finalized', 'deferred')) AS t(plugin, kind, least, scope)),
s AS (SELECT tx.slot, tx.kind, {STATUS} AS status FROM tx, w)
SELECT s.slot, p.plugin, p.scope FROM s JOIN p USING (kind) WHERE CASE status WHEN 'Processed' THEN 0 WHEN 'Confirmed' THEN 1 ELSE 2 END >= CASE least WHEN 'Processed' THEN 0 WHEN 'Confirmed' THEN 1 ELSE 2 END""")
def plugin_routing(spark, v_tx):
    """Which subscriber gets which transaction, by kind and least commitment (the subscribers are a literal table)."""
    plugins = spark.createDataFrame([("votes", "VoteOnly", "Processed", "inline"), ("others", "NonVote", "Confirmed", "deferred"), ("mixed", "Mixed", "Finalized", "deferred")], "plugin string, kind string, least string, scope string")
    tx = _status(transactions(v_tx).select("slot", "kind"), v_tx)
    return tx.join(F.broadcast(plugins), "kind").where(commitment.rank(F.col("status")) >= commitment.rank(F.col("least"))).select("slot", "plugin", "scope")


@query(f"WITH {TX} SELECT slot, kind FROM tx WHERE kind <> 'VoteOnly' AND NOT failed AND payer % 4 = 1")
def provider_pushdown_filter(v_tx):
    """A provider-side filter: payer and failure before the kinds are worked out."""
    return transactions(v_tx.where((F.col("payer") % 4 == 1) & ~F.col("failed"))).where("kind <> 'VoteOnly'").select("slot", "kind")


@query("""SELECT account, CASE WHEN account % 7 = 0 THEN 'VoteAccount' WHEN account % 7 = 1 THEN 'StakeAccount' WHEN account IN (9, 10) THEN 'EpochScheduleSysvar' WHEN account IN (16, 17) THEN 'StakeHistorySysvar' ELSE 'Other' END AS kind, count(*) AS n FROM v_tx GROUP BY account""")
def rooted_account_kind(v_tx):
    """Account class by owner, then by address."""
    kind = F.when(F.col("account") % 7 == 0, "VoteAccount").when(F.col("account") % 7 == 1, "StakeAccount").when(F.col("account").isin(9, 10), "EpochScheduleSysvar").when(F.col("account").isin(16, 17), "StakeHistorySysvar").otherwise("Other")
    return v_tx.groupBy("account").agg(F.count("*").alias("n")).select("account", kind.alias("kind"), "n")


@query("""SELECT slot, bool_or(program_account IN (3, 5)) AS invoked, bool_or(account IN (3, 5, 30, 50)) AS referenced, count(*) FILTER (program_account IN (3, 5)) AS n_invoked, count(*) FILTER (account IN (3, 5, 30, 50)) AS n_referenced
FROM v_tx GROUP BY slot HAVING bool_or(program_account IN (3, 5)) OR bool_or(account IN (3, 5, 30, 50))""")
def program_touch_flags(v_tx):
    """Transactions that invoke one of two programs or refer to their accounts."""
    invoked, referenced = F.col("program_account").isin(3, 5), F.col("account").isin(3, 5, 30, 50)
    return v_tx.groupBy("slot").agg(F.bool_or(invoked).alias("invoked"), F.bool_or(referenced).alias("referenced"), F.count_if(invoked).alias("n_invoked"), F.count_if(referenced).alias("n_referenced")).where("invoked or referenced")


@query("""WITH d AS (SELECT slot, program_account, min(ix) AS first_ix FROM v_tx GROUP BY ALL)
SELECT slot, array_to_string(list(program_account ORDER BY first_ix, program_account), ',') AS routes FROM d GROUP BY slot""")
def ordered_distinct(v_tx):
    """Routes of each transaction without repeats, in order of first appearance."""
    first = v_tx.groupBy("slot", "program_account").agg(F.min("ix").alias("first_ix"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first_ix", "program_account"))), lambda x: x["program_account"].cast("string"))
    return first.groupBy("slot").agg(F.array_join(ordered, ",").alias("routes"))


#: Provider filters as a table: each null selector lets anything pass; include, exclude and required are accounts.
PROVIDER_FILTERS = [("votes_only", True, None, None, None, None), ("no_failed", None, False, None, None, None), ("include", None, None, 3, None, None), ("exclude", None, None, None, 5, None), ("required", False, False, None, None, 7)]
_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() for x in f) + ")" for f in PROVIDER_FILTERS)


@query(f"""WITH t AS (SELECT slot, bool_and(program = 'vote') AS vote, bool_or(failed) AS failed, list(DISTINCT account % 11) AS keys FROM v_tx GROUP BY slot),
f AS (SELECT name, CAST(vote AS BOOLEAN) AS vote, CAST(failed AS BOOLEAN) AS failed, CAST(include AS BIGINT) AS include, CAST(exclude AS BIGINT) AS exclude, CAST(required AS BIGINT) AS required FROM (VALUES {_VALUES}) AS v(name, vote, failed, include, exclude, required))
SELECT f.name, count(*) AS n, min(slot) AS first_slot, max(slot) AS last_slot FROM t JOIN f ON (f.vote IS NULL OR f.vote = t.vote) AND (f.failed IS NULL OR f.failed = t.failed) AND (f.include IS NULL OR list_contains(keys, f.include)) AND (f.exclude IS NULL OR NOT list_contains(keys, f.exclude)) AND (f.required IS NULL OR list_contains(keys, f.required)) GROUP BY f.name""")
def provider_filters(v_tx):
    """Transactions by each of a provider's filters: vote, failed, and accounts to include, exclude or require."""
    tx = v_tx.groupBy("slot").agg(F.bool_and(F.col("program") == "vote").alias("vote"), F.bool_or("failed").alias("failed"), F.collect_set(F.col("account") % 11).alias("keys"))

    def passes(f):
        _, vote, failed, include, exclude, required = f
        tests = [(F.col("vote") == vote, vote), (F.col("failed") == failed, failed), (F.array_contains("keys", F.lit(include).cast("bigint")), include), (~F.array_contains("keys", F.lit(exclude).cast("bigint")), exclude), (F.array_contains("keys", F.lit(required).cast("bigint")), required)]
        return reduce(lambda a, b: a & b, [c for c, wanted in tests if wanted is not None], F.lit(True))

    names = F.filter(F.array(*[F.when(passes(f), F.lit(f[0])) for f in PROVIDER_FILTERS]), lambda x: x.isNotNull())
    return tx.select("slot", F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))


@query("""WITH t AS (SELECT slot, bool_and(program = 'vote') AS simple_vote, list(DISTINCT account % 11) AS keys FROM v_tx GROUP BY slot), m AS (SELECT unnest(['all', 'all_with_votes', 'mentions']) AS mode)
SELECT mode, count(*) AS n, sum(slot) AS slots FROM t, m WHERE mode = 'all_with_votes' OR (mode = 'all' AND NOT simple_vote) OR (mode = 'mentions' AND list_contains(keys, 4)) GROUP BY mode""")
def logs_filter(v_tx):
    """The three log subscriptions: all but simple votes, all, and those that mention one key."""
    tx = v_tx.groupBy("slot").agg(F.bool_and(F.col("program") == "vote").alias("simple_vote"), F.bool_or(F.col("account") % 11 == 4).alias("mentions"))
    modes = F.array(F.lit("all_with_votes"), F.when(~F.col("simple_vote"), "all"), F.when(F.col("mentions"), "mentions"))
    return tx.select("slot", F.explode(F.filter(modes, lambda x: x.isNotNull())).alias("mode")).groupBy("mode").agg(F.count("*").alias("n"), F.sum("slot").alias("slots"))
