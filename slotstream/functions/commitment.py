"""Commitment, classification and scoring as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hops below the tip at which a slot is confirmed and finalized.
CONFIRMED_DEPTH, FINALIZED_DEPTH = 32, 150
RANKS = ("Processed", "Confirmed", "Finalized")


def from_slot(slot: Column, confirmed: Column, finalized: Column) -> Column:
    """Finalized at or below the finalized watermark, else Confirmed, else Processed; a null watermark never matches."""
    return F.when(slot <= finalized, "Finalized").when(slot <= confirmed, "Confirmed").otherwise("Processed")


def rank(status: Column) -> Column:
    """Order of a commitment status: 0, 1, 2."""
    return F.array_position(F.array(*[F.lit(x) for x in RANKS]), status) - 1


def at_least(status: Column, least: str) -> Column:
    return rank(status) >= RANKS.index(least)


def saturating_sub(a: Column, b: Column | int) -> Column:
    return F.greatest(a - b, F.lit(0))


def tx_kind(programs: Column) -> Column:
    """VoteOnly, Mixed or NonVote of an array of instruction programs; compute-budget instructions don't count."""
    vote = F.exists(programs, lambda p: p == "vote")
    other = F.exists(programs, lambda p: ~p.isin("vote", "budget"))
    return F.when(vote & other, "Mixed").when(vote, "VoteOnly").otherwise("NonVote")


def prefilter(keys: Column, include: list[int] | None = None, exclude: list[int] | None = None, required: list[int] | None = None) -> Column:
    """Any of ``include``, none of ``exclude``, all of ``required``; an empty list asks nothing."""
    array = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    out = F.lit(True)
    if include:
        out &= F.arrays_overlap(keys, array(include))
    if exclude:
        out &= ~F.arrays_overlap(keys, array(exclude))
    if required:
        out &= F.size(F.array_intersect(keys, array(required))) == len(set(required))
    return out


def source_score(data: Column, code: Column, complete: Column, last: Column) -> Column:
    """Weight of a source: data twice, code once, boundaries eight times, last fragments sixteen times."""
    return 2 * data + code + 8 * complete + 16 * last


def peer_score(rtt_ms: Column, send_ok: Column, ping_ok: Column, hits: Column, errors: Column) -> Column:
    """Score of a repair peer: fast and reliable peers first; an unknown round trip counts 1000."""
    cap = lambda c, n: F.least(c, F.lit(n))
    speed = F.when(rtt_ms.isNull(), F.lit(1000)).otherwise(2500 - cap(rtt_ms, 2500))
    return speed + cap(send_ok, 4096) + cap(ping_ok, 4096) + 2 * cap(hits, 8192) - 8 * cap(errors, 4096)


def freshness(observed: Column, tip: Column, most_lag: int) -> Column:
    """Missing, Unknown, Stale or Fresh of an input seen at slot ``observed``."""
    return F.when(observed.isNull(), "Missing").when(tip.isNull(), "Unknown").when(saturating_sub(tip, observed) > most_lag, "Stale").otherwise("Fresh")


def spread(*slots: Column) -> Column:
    """Greatest less least of the non-null slots."""
    return F.greatest(*slots) - F.least(*slots)


def quality(states: list[Column], spread_: Column, most_spread: int, tip: Column, confirmed: Column, finalized: Column) -> Column:
    """Control-plane quality: the first rule that holds."""
    some = lambda *names: F.exists(F.array(*states), lambda s: s.isin(*names))
    return (
        F.when(some("Missing", "Unknown"), "IncompleteControlPlane")
        .when(some("Stale"), "Stale")
        .when(spread_ > most_spread, "Degraded")
        .when(finalized.isNull() | (finalized != tip), F.when(confirmed == tip, "Provisional").otherwise("ReorgRisk"))
        .otherwise("Stable")
    )
