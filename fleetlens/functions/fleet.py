"""Scalar rules of the fleet as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds 2^0 .. 2^30 of the latency histogram's buckets 0 .. 30; 31 takes the rest.
BOUNDS = [float(1 << b) for b in range(31)]


def latency_bucket(value: Column) -> Column:
    """log2 bucket: how many of the bounds lie below the value (no logarithm, so edges are exact)."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in BOUNDS]), lambda b: b < value))


def bit_length_bucket(value: Column) -> Column:
    """0 for 0, else the number of bits, 63 at most."""
    return F.when(value <= 0, 0).otherwise(F.least(F.length(F.bin(value)), F.lit(63)))


def backoff(attempt: Column, base: int, most: int) -> Column:
    """base * 2^(attempt - 1), at most `most`, without overflow."""
    power = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(63))
    return F.least(F.lit(most).cast("double"), F.lit(base) * F.pow(F.lit(2.0), power)).cast("long")


def degradation(pressure: Column, queue_percent: Column, reconnecting: Column) -> Column:
    """Network ladder at 40/60/75/90 of the larger of pressure and queue fill."""
    level = F.greatest(pressure, queue_percent)
    return (
        F.when(reconnecting & (level >= 90), "control_only").when(level >= 90, "reject_large_remote").when(level >= 75, "pause_remote_batch")
        .when(level >= 60, "reduce_checkpointing").when(level >= 40, "stop_pre_replication").otherwise("normal")
    )


def remote_load_action(pressure: Column, most: int) -> Column:
    """What a loaded worker does with remote work, by distance from its pressure limit."""
    return (
        F.when(pressure < max(most - 20, 0), "continue").when(pressure < most, "reduce_concurrency")
        .when(pressure < min(most + 10, 100), "pause_checkpointable_batch").otherwise("cancel_remote_background")
    )


def checkpoint_interval(cost: Column, lost: Column, remaining: Column, pressure: Column) -> Column:
    """Twice the cost (four times under pressure), at most what remains; null where a checkpoint doesn't pay."""
    useless = (cost == 0) | (lost == 0) | (remaining == 0) | F.isnan(pressure) | (pressure >= 0.8)
    return F.when(~useless, F.least(F.greatest(cost * F.when(pressure >= 0.5, 4).otherwise(2), F.lit(1)), remaining))


def effect_recovery(quorum: Column, outbox: Column, retry: Column, supported: Column) -> Column:
    """How an interrupted effect is resumed; supported: the retry class has what it needs (key, verifier or hook)."""
    return (
        F.when(~quorum, "reject_while_quorum_lost").when(outbox, "transactional_outbox")
        .when(supported & (retry == "idempotent"), "retry_with_idempotency_key").when(supported & (retry == "verifiable"), "verify_external_state")
        .when(supported & (retry == "compensatable"), "compensate_then_retry").otherwise("recovery_required")
    )


def recoverable(policy: Column, healthy: Column, least: int) -> Column:
    return F.when(policy == "ephemeral", F.lit(False)).when(policy == "reconstructible", F.lit(True)).otherwise(healthy >= least)


def has_bits(owned: Column, required: Column) -> Column:
    return owned.bitwiseAND(required) == required


def lower_digest(value: Column) -> Column:
    """A SHA-256 id in lower-case hex, as localisation wants it."""
    return value.rlike("^[0-9a-f]{64}$")


def any_digest(value: Column) -> Column:
    """A SHA-256 id in hex of either case, as the content store takes it."""
    return value.rlike("^[0-9a-fA-F]{64}$")
