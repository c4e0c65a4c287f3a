"""Rules of the store as functions over columns: quorum sizes, guards, health, retries, error codes, limits, estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("one", "quorum", "all")

# Error codes of the store, of its calls and of its HTTP answers.
CALL_OF_STORE = {
    "OK": "OK", "INVALID_ARGUMENT": "InvalidArgument", "KEY_TOO_LARGE": "InvalidArgument", "VALUE_TOO_LARGE": "InvalidArgument", "INVALID_TENANT_ID": "InvalidArgument", "INVALID_KEY": "InvalidArgument",
    "KEY_NOT_FOUND": "NotFound", "DISK_FULL": "ResourceExhausted", "RESOURCE_EXHAUSTED": "ResourceExhausted", "DISK_THROTTLED": "Unavailable", "CHECKSUM_FAILED": "DataLoss", "CORRUPTED_DATA": "DataLoss", "UNAVAILABLE": "Unavailable",
}
HTTP_OF_CALL = {
    "OK": 200, "InvalidArgument": 400, "OutOfRange": 400, "Unauthenticated": 401, "PermissionDenied": 403, "NotFound": 404, "AlreadyExists": 409, "Aborted": 409,
    "FailedPrecondition": 412, "ResourceExhausted": 429, "Unimplemented": 501, "Unavailable": 503, "DeadlineExceeded": 504,
}
API_OF_CALL = {"InvalidArgument": "INVALID_REQUEST", "PermissionDenied": "FORBIDDEN", "Unauthenticated": "UNAUTHORIZED", "ResourceExhausted": "RATE_LIMITED", "Unavailable": "SERVICE_UNAVAILABLE", "DeadlineExceeded": "TIMEOUT"}
RETRYABLE = ("Unavailable", "DeadlineExceeded", "Aborted", "ResourceExhausted")
NEXT_STATES = {"BOOTSTRAPPING": ("NORMAL", "DOWN"), "NORMAL": ("LEAVING", "DOWN"), "LEAVING": ("DOWN",), "DOWN": ("BOOTSTRAPPING",)}
STREAM_STEPS = {("copying", "copied"): "streaming", ("streaming", "drained"): "syncing", ("syncing", "verified"): "completed"}


def _lookup(table: dict, key: Column, other) -> Column:
    """table[key], or `other`: a constant map, no join."""
    made = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(made, key), F.lit(other))


def consistency(level: Column) -> Column:
    """The level asked for, quorum where it is none of them."""
    return F.when(level.isin(*LEVELS), level).otherwise("quorum")


def required(level: Column, n: Column) -> Column:
    """Answers that a level needs of `n` replicas: one, all, or more than half for any other."""
    return F.when(level == "one", F.lit(1)).when(level == "all", n).otherwise(F.floor(n / 2) + 1).cast("long")


def factor_valid(rf: Column, most: int = 10) -> Column:
    return F.coalesce(rf.between(1, most), F.lit(False))


def port_valid(port: Column) -> Column:
    return F.coalesce(port.between(1, 65535), F.lit(False))


def clock_error(clock: Column, most: int = 1000) -> Column:
    """The first fault of a clock: too many entries, an id of none or more than 128 bytes or with a NUL, a count below 0; null
    where there is none."""
    ids, counts = F.map_keys(clock), F.map_values(clock)
    return (
        F.when(F.size(clock) > most, "clock_too_large")
        .when(F.exists(ids, lambda x: (F.octet_length(x) < 1) | (F.octet_length(x) > 128)), "clock_id_length")
        .when(F.exists(ids, lambda x: F.contains(x, F.lit("\x00"))), "clock_id_nul")
        .when(F.exists(counts, lambda x: x < 0), "clock_negative")
    )


def _cut(text: Column, most: int) -> Column:
    """At most `most` bytes of a text, and no broken character at the end."""
    raw = text.cast("binary")
    lead = lambda i: F.conv(F.hex(F.substring(raw, F.lit(most + 1) - i, F.lit(1))), 16, 10).cast("int")
    # the byte behind the cut goes on a character if its two upper bits are 10; a character has four bytes at most
    goes_on = lambda i: lead(i).between(128, 191)
    keep = F.when(~goes_on(0), most).when(~goes_on(1), most - 1).when(~goes_on(2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(raw, F.lit(1), keep).cast("string"))


def sanitize_tenant(text: Column, most: int = 256) -> Column:
    """Without control characters and colons, without white space at the ends, at most `most` bytes."""
    return _cut(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f:]", ""), r"^\s+|\s+$", ""), most)


def sanitize_key(text: Column, most: int = 1024) -> Column:
    """Without control characters but tab and line feed, without white space at the ends, at most `most` bytes."""
    return _cut(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", ""), r"^\s+|\s+$", ""), most)


def expired(created: Column, now: Column, ttl: Column) -> Column:
    """Whether more than `ttl` seconds have passed."""
    return now - created > ttl


def disk_gate(used_pct: Column, estimate: Column, available: Column) -> Column:
    """Whether a node takes a write of `estimate` bytes."""
    return F.when((used_pct >= 95) | (estimate > available) | ((used_pct >= 90) & (estimate > available / 10)), "reject").otherwise("accept")


def health(cpu: Column, memory: Column, disk: Column, errors: Column) -> Column:
    return F.when(F.greatest(cpu, memory, disk) > 90, "degraded").when(errors > 0.1, "unhealthy").otherwise("healthy")


def retryable(code: Column) -> Column:
    return F.coalesce(code.isin(*RETRYABLE), F.lit(False))


def backoff_ms(attempt: Column, base: int = 100) -> Column:
    """Wait before a repeated call, doubled with each attempt from 1."""
    return (F.lit(base) * F.pow(F.lit(2.0), attempt - 1)).cast("long")


def call_code(store_code: Column) -> Column:
    return _lookup(CALL_OF_STORE, store_code, "Internal")


def http_status(call: Column) -> Column:
    return _lookup(HTTP_OF_CALL, call, 500)


def api_code(call: Column, message: Column) -> Column:
    """The code that a client sees; what was not found or exists already is told from the message."""
    says = lambda word: F.contains(F.lower(message), F.lit(word))
    missing = F.when(says("tenant"), "TENANT_NOT_FOUND").when(says("key"), "KEY_NOT_FOUND").when(says("migration"), "MIGRATION_NOT_FOUND").otherwise("INVALID_REQUEST")
    there = F.when(says("tenant"), "TENANT_EXISTS").when(says("idempotency"), "IDEMPOTENCY_CONFLICT").otherwise("INVALID_REQUEST")
    return F.when(call == "NotFound", missing).when(call == "AlreadyExists", there).otherwise(_lookup(API_OF_CALL, call, "INTERNAL_ERROR"))


def state_allowed(old: Column, new: Column) -> Column:
    """Whether a node may turn from one state into another."""
    return F.coalesce(F.array_contains(F.try_element_at(F.create_map(*[x for k, v in NEXT_STATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), old), new), F.lit(False))


def stream_state(state: Column, step: Column) -> Column:
    """The state of a range stream after a step; an error fails it unless it has completed."""
    out = F.when((step == "error") & (state != "completed"), "failed")
    for (old, done), new in STREAM_STEPS.items():
        out = out.when((state == old) & (step == done), new)
    return out.otherwise(state)


def cleanup_verdict(status: Column, progress: Column, completed_at: Column, updated_at: Column, now: Column, normal_nodes: Column, rf: int = 3, grace: int = 86_400) -> Column:
    """Why data of a topology change may not be removed, or safe.

    `progress` maps a source node to the state of its stream; times are seconds. The grace period is over at its last second.
    Ranges need `rf` nodes in state NORMAL.
    """
    ended = F.coalesce(completed_at, updated_at)
    return (
        F.when(status != "completed", "not completed")
        .when(F.exists(F.map_values(progress), lambda s: s != "completed"), "streaming still active")
        .when(now - ended < grace, "grace period not elapsed")
        .when(normal_nodes < rf, "quorum not met")
        .otherwise("safe")
    )


def cache_score(count: Column, age_s: Column, frequency: float = 0.5, recency: float = 0.5) -> Column:
    """Accesses count for an entry, its age in seconds against it."""
    return F.lit(frequency) * count - F.lit(recency) * age_s


def range_share(lo: Column, hi: Column) -> Column:
    """The share of the ring from `lo` to `hi` (16 hex digits each), around its end where hi is below lo; equal ends: 0."""
    number = lambda h: F.conv(h, 16, 10).cast("decimal(20,0)").cast("double")
    width = number(hi) - number(lo)
    return F.when(width >= 0, width).otherwise(width + F.lit(2.0**64)) / F.lit(2.0**64)


def pool_rates(queued: Column, capacity: Column, active: Column, workers: Column, done: Column, failed: Column) -> Column:
    """Percentages of a worker pool: queue used, workers busy, tasks that succeeded (100 before the first)."""
    share = lambda a, b, none: F.when(b > 0, a * 100.0 / b).otherwise(F.lit(none))
    return F.struct(share(queued, capacity, 0.0).alias("queue_pct"), share(active, workers, 0.0).alias("worker_pct"), share(done, done + failed, 100.0).alias("success_pct"))
