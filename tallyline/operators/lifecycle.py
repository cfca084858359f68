"""Case lifecycle: views, guarded state changes, clean-up and metrics in batch form."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The path of a case, and the states in which it may still change.
START = "queued"
STAGES = ("retrieving", "analyzing", "doc_analysis")
PATH = (*STAGES, "complete")
FAILED = "error"
ACTIVE = (START, *STAGES)
TERMINAL = ("complete", FAILED)
TIMEOUT = "TIMEOUT"


def dedupe_submissions(submissions: DataFrame) -> DataFrame:
    """One case per idempotency key: the first submission wins."""
    first = F.struct("created_at", "event_id")
    return submissions.groupBy("idempotency_key").agg(
        F.min_by("case_id", first).alias("case_id"), F.min_by("owner_sub", first).alias("owner_sub"),
        F.min("created_at").alias("created_at"), F.count("*").alias("submissions"),
    )


def claim_cases(claims: DataFrame) -> DataFrame:
    """The one winning claim per case: the earliest."""
    return claims.groupBy("case_id").agg(
        F.min_by("worker", F.struct("claimed_at", "event_id")).alias("claimed_by"),
        F.min("claimed_at").alias("claimed_at"), (F.count("*") - 1).alias("lost_claims"),
    )


def idempotent_stages(results: DataFrame) -> DataFrame:
    """One result per (case, stage): the first written."""
    first = F.struct("completed_at", "event_id")
    return results.groupBy("case_id", "stage").agg(
        F.min_by("output", first).alias("output"), F.min("completed_at").alias("completed_at"),
    )


def case_status_view(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Current stage, completed stages in path order, and where a case failed."""
    done = idempotent_stages(results).groupBy("case_id").agg(
        *[F.max(F.when(F.col("stage") == s, s)).alias(f"_{s}") for s in STAGES]
    )
    listed = F.array_compact(F.array(*[F.col(f"_{s}") for s in STAGES]))
    failed = F.col("status") == FAILED
    return cases.join(done, "case_id", "left").select(
        "case_id", "status", F.when(~F.col("status").isin(*TERMINAL), F.col("status")).alias("current_stage"),
        F.concat_ws(",", listed).alias("completed_stages"), F.when(failed, F.col("failed_stage")).alias("failed_stage"),
        F.when(failed, F.col("error_reason")).alias("error_reason"),
    )


def case_summary_view(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Stage outputs side by side for finished cases; a failed case shows what it has."""
    done = idempotent_stages(results).groupBy("case_id").pivot("stage", list(STAGES)).agg(F.max("output"))
    outputs = [F.col(s).alias(f"{s}_output") for s in STAGES]
    return (
        cases.filter(F.col("status").isin(*TERMINAL))
        .join(done, "case_id", "left")
        .select("case_id", "status", *outputs, (F.col("status") == FAILED).alias("is_partial"))
    )


MAX_PAGE = 50


def list_cases(cases: DataFrame, owner: str | None = None, cursor: tuple | None = None, limit: int = MAX_PAGE) -> DataFrame:
    """One page of cases, newest first. ``cursor`` is (created_at, case_id) of the last row seen.

    ``next_cursor`` of a page says where the next one starts. A page longer than ``MAX_PAGE`` is refused.
    """
    if not 0 < limit <= MAX_PAGE:
        raise ValueError(f"a page has 1 to {MAX_PAGE} cases, not {limit}")
    rows = cases if owner is None else cases.filter(F.col("owner_sub") == owner)
    if cursor is not None:
        at = F.lit(cursor[0]).cast(cases.schema["created_at"].dataType)
        # The first test says nothing new, but it is one the scan can skip files by.
        before = F.struct("created_at", "case_id") < F.struct(at.alias("created_at"), F.lit(cursor[1]).alias("case_id"))
        rows = rows.filter((F.col("created_at") <= at) & before)
    page = rows.orderBy(F.desc("created_at"), F.desc("case_id")).limit(limit)
    return page.select("case_id", "owner_sub", "status", "created_at")


def next_cursor(page: DataFrame, limit: int = MAX_PAGE) -> DataFrame:
    """One row with the cursor of the page after this one; no row if this page is not full, so the last."""
    last = F.min(F.struct("created_at", "case_id")).alias("last")
    return page.agg(F.count("*").alias("n"), last).filter(F.col("n") == limit).select("last.created_at", "last.case_id")


# What a state is in a transition map: its place on the path; beyond that, failed from that place.
NAMES = (START, *PATH)
ENDED = len(PATH)
# Where every state leads, how many events were accepted on the way and which was the last: nothing has happened yet.
NOWHERE = "CAST(NULL AS STRUCT<ts: {ts}, event_id: BIGINT>)"


def _leads(to: str, n: str, at: str) -> str:
    return f"named_struct('to', {to}, 'n', {n}, 'at', {at})"


def transition_maps(events: DataFrame, bucket: str = "hour") -> DataFrame:
    """One map per case and time bucket: what the bucket's events make of each state a case may come in with.

    ``map`` has an entry for each active state: the state it leads to, the events accepted on the way and the last of
    them. Maps compose: what a bucket does to a case does not depend on the buckets before, so all buckets of a case are folded at
    the same time.
    """
    at = events.schema["ts"].dataType.simpleString()
    nothing = NOWHERE.format(ts=at)
    start = "array(" + ", ".join(_leads(str(i), "0L", nothing) for i in range(ENDED)) + ")"
    step = event_steps().alias("step")
    taken = f"s.to < {ENDED} AND (e.step = -1 OR e.step = s.to + 1)"
    after = _leads(f"if(e.step = -1, {ENDED + 1} + s.to, e.step)", "s.n + 1", "named_struct('ts', e.ts, 'event_id', e.event_id)")
    folded = F.expr(f"aggregate(array_sort(events), {start}, (m, e) -> transform(m, s -> if({taken}, {after}, s)))")
    rows = events.select("case_id", F.date_trunc(bucket, "ts").alias("bucket"), F.struct("ts", F.col("event_id").cast("bigint").alias("event_id"), step).alias("e"))
    grouped = rows.groupBy("case_id", "bucket").agg(F.collect_list("e").alias("events"))
    return grouped.select("case_id", "bucket", F.size("events").cast("bigint").alias("events"), folded.alias("map"))


def compose_maps(maps: DataFrame, ts: str, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Rows (keys, events, end): the maps of a key composed in the order of their buckets, from the first state on."""
    nothing = NOWHERE.format(ts=ts)
    on = "element_at(b.map, s.to + 1)"
    then = _leads(f"{on}.to", f"s.n + {on}.n", f"coalesce({on}.at, s.at)")
    end = F.expr(f"aggregate(array_sort(maps), {_leads('0', '0L', nothing)}, (s, b) -> if(s.to < {ENDED}, {then}, s))")
    grouped = maps.groupBy(*keys).agg(F.sum("events").alias("events"), F.collect_list(F.struct("bucket", "map")).alias("maps"))
    return grouped.select(*keys, "events", end.alias("end"))


def guarded_transitions(events: DataFrame, bucket: str = "hour") -> DataFrame:
    """Final state per case, accepted and dropped events, from unordered events.

    An event is accepted only if its predecessor is the current state; an error is accepted in any active state and
    ends the case. The events of a case and time bucket become a map of states (``transition_maps``), and a case is its maps in
    order: one scan, no join, and a case that holds any share of the events is split over its buckets. A ``bucket`` (a
    unit of time) is to hold no more events of one case than fit one task. Events without a time come first.
    """
    done = compose_maps(transition_maps(events, bucket), events.schema["ts"].dataType.simpleString())
    names = F.array(*map(F.lit, NAMES))
    to = F.col("end.to")
    failed = to > ENDED
    return done.select(
        "case_id", F.when(failed, FAILED).otherwise(F.get(names, to)).alias("status"), F.when(failed, F.get(names, to - ENDED - 1)).alias("failed_stage"),
        F.col("end.n").alias("accepted"), (F.col("events") - F.col("end.n")).alias("dropped"), F.col("end.at.ts").alias("changed_at"),
    )


# A transition map as a number: for each active state the state it leads to, in four bits. How many events are accepted on
# the way follows from the two states, since an accepted event moves a case one place on or fails it.
_STAY = range(ENDED)


def _as_number(leads) -> int:
    return sum(to << 4 * i for i, to in enumerate(leads))


def event_steps(status: str = "to_status") -> Column:
    """An event's place on the path, -1 for a failure, 0 for anything else."""
    steps = " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(NAMES) if i)
    return F.expr(f"CASE {status} {steps} WHEN '{FAILED}' THEN -1 ELSE 0 END")


def map_number(events: str) -> Column:
    """The transition map of a list of events (ts, event_id, step) in any order, as a number."""
    single = [_as_number(ENDED + 1 + i for i in _STAY), *(_as_number(k if i == k - 1 else i for i in _STAY) for k in range(ENDED + 1))]
    of = "element_at(array(" + ", ".join(map(str, single)) + "), {}.step + 2)"
    digits = []
    for i in _STAY:
        d = f"(shiftright(m, {4 * i}) & 15)"
        digits.append(f"shiftleft(if({d} < {ENDED}, shiftright({of.format('e')}, 4 * {d}) & 15, {d}), {4 * i})")
    folded = f"aggregate(array_sort({events}), {_as_number(_STAY)}, (m, e) -> {' | '.join(digits)})"
    return F.expr(f"if(size({events}) = 1, {of.format(f'{events}[0]')}, {folded})")


def case_states(parts: DataFrame) -> DataFrame:
    """State per case out of the map numbers (case_id, bucket, _seq, number, events) of its time buckets, the newest ``_seq`` of each."""
    grouped = parts.groupBy("case_id").agg(F.collect_list(F.struct("bucket", (-F.col("_seq")).alias("age"), "number", "events")).alias("parts"))
    to = f"if(s.to < {ENDED}, shiftright(p.number, 4 * s.to) & 15, s.to)"
    start = f"named_struct('to', 0, 'events', 0L, 'n', 0, 'bucket', CAST(NULL AS {parts.schema['bucket'].dataType.simpleString()}))"
    then = f"named_struct('to', {to}, 'events', s.events + p.events, 'n', 1, 'bucket', p.bucket)"
    done = grouped.select("case_id", F.expr(f"aggregate(array_sort(parts), {start}, (s, p) -> if(s.n > 0 AND s.bucket <=> p.bucket, s, {then}))").alias("end"))
    names, to = F.array(*map(F.lit, NAMES)), F.col("end.to")
    failed = to > ENDED
    accepted = F.when(failed, to - ENDED).otherwise(to).cast("bigint")
    return done.select(
        "case_id", F.when(failed, FAILED).otherwise(F.get(names, to)).alias("status"), F.when(failed, F.get(names, to - ENDED - 1)).alias("failed_stage"),
        accepted.alias("accepted"), (F.col("end.events") - accepted).alias("dropped"),
    )


def time_outs(parts: DataFrame, minutes: int, wait: str) -> DataFrame:
    """Cases without an end within ``minutes`` of their first event, out of their events per time bucket of so many minutes.

    Rows (case_id, bucket, _seq, events, last): lists of (ts, event_id, to_status) and their latest time; the newest ``_seq`` of a
    bucket counts. A case is out once the newest event of all lies more than ``wait`` past its limit. The limit lies in the first
    bucket or the one after, and of these one is even, one odd: so the least even and the least odd bucket of a case are all it
    takes. Events without a time come first, and have no others within their limit.
    """
    width = int(minutes) * 60_000_000
    odd = F.pmod(F.floor(F.unix_micros("bucket") / width), F.lit(2)) == 1
    part = F.struct("bucket", (-F.col("_seq")).alias("age"), "events")
    timed = F.col("bucket").isNotNull()
    per = parts.groupBy("case_id").agg(
        F.min(F.when(timed & ~odd, part)).alias("even"), F.min(F.when(timed & odd, part)).alias("odd"), F.min(F.when(~timed, part)).alias("timeless")
    )
    step = F.expr(f"INTERVAL {int(minutes)} MINUTES")
    first, second = F.least("even", "odd"), F.greatest("even", "odd")
    follows = F.col("even").isNotNull() & F.col("odd").isNotNull() & (second["bucket"] == first["bucket"] + step)
    near = F.when(follows, F.concat(first["events"], second["events"])).otherwise(first["events"])
    per = per.select("case_id", "timeless", near.alias("near"), F.array_min(first["events"])["ts"].alias("since"))
    inside = F.filter("near", lambda e: e["ts"] <= F.col("since") + step)
    newest = parts.select("last").agg(F.max("last")).scalar()
    per = per.filter(F.col("timeless").isNotNull() | (F.col("since") + step < newest - F.expr(f"INTERVAL {wait}")))
    per = per.select(
        "case_id", F.coalesce("timeless.events", inside).alias("events"), F.when(F.col("timeless").isNull(), F.col("since")).alias("since")
    )
    stuck = per.filter(~F.exists("events", lambda e: F.coalesce(e["to_status"].isin(*TERMINAL), F.lit(False))))
    return stuck.select(
        "case_id", F.lit(FAILED).alias("status"), F.array_max("events")["to_status"].alias("failed_stage"),
        F.lit(TIMEOUT).alias("error_reason"), "since",
    )


def reap_stuck(cases: DataFrame, as_of: datetime, minutes: int = 15) -> DataFrame:
    """Active cases whose claim (or creation, when unclaimed) is too old, as they look once timed out."""
    since = F.coalesce("claimed_at", "created_at")
    cut = F.lit(as_of).cast(cases.schema["created_at"].dataType) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    stuck = cases.filter(~F.col("status").isin(*TERMINAL) & (since < cut))
    return stuck.select(
        "case_id", "owner_sub", F.lit(FAILED).alias("status"), F.col("status").alias("failed_stage"),
        F.lit(TIMEOUT).alias("error_reason"), since.alias("since"),
    )


def active_case_cap(cases: DataFrame, n: int = 5) -> DataFrame:
    """Owners with at least ``n`` active cases."""
    per = cases.groupBy("owner_sub").agg(F.count_if(~F.col("status").isin(*TERMINAL)).alias("active_cases"))
    return per.filter(F.col("active_cases") >= n)


CREATED = "created"


def lifecycle_metrics(events: DataFrame, window: str = "1 day", submissions: DataFrame | None = None) -> DataFrame:
    """Events per stage, cases completed and failed, in tumbling windows; with ``submissions`` also cases created.

    A case is created by the first submission of its idempotency key. A window with creations alone has no events.
    """
    rows = events.select("ts", "to_status")
    counted = (*STAGES, *TERMINAL)
    if submissions is not None:
        born = dedupe_submissions(submissions).select(F.col("created_at").alias("ts"), F.lit(CREATED).alias("to_status"))
        rows, counted = rows.unionByName(born), (CREATED, *counted)
    s = F.col("to_status")
    per = rows.groupBy(F.window("ts", window).alias("w")).agg(
        F.count_if(s.isNull() | (s != CREATED)).alias("events"), *[F.count_if(s == x).alias(x) for x in counted]
    )
    return per.select(F.col("w.start").alias("window_start"), "events", *counted)


def stage_durations(results: DataFrame) -> DataFrame:
    """Median and 95th percentile of whole seconds between consecutive first stage results."""
    t = idempotent_stages(results).groupBy("case_id").pivot("stage", list(STAGES)).agg(F.min("completed_at"))
    steps = F.array(
        *[
            F.struct(F.lit(b).alias("stage"), F.timestamp_diff("SECOND", F.col(a), F.col(b)).alias("seconds"))
            for a, b in zip(STAGES, STAGES[1:], strict=False)
        ]
    )
    long = t.select(F.inline(steps)).filter("seconds >= 0")
    # Equal durations are counted first: the percentile then works on (value, count) pairs.
    counts = long.groupBy("stage", "seconds").agg(F.count("*").alias("n"))
    q = F.expr("percentile(seconds, array(0.5, 0.95), n)")
    return counts.groupBy("stage").agg(F.sum("n").alias("cases"), q.alias("q")).select(
        "stage", "cases", F.round(F.col("q")[0], 6).alias("median_seconds"), F.round(F.col("q")[1], 6).alias("p95_seconds")
    )


def silent_sessions(events: DataFrame, as_of: datetime, minutes: int = 10) -> DataFrame:
    """Cases that started but saw no terminal event within ``minutes`` of their start."""
    at = F.col("ts")
    per = events.groupBy("case_id").agg(F.min(at).alias("started_at"))
    limit = F.col("started_at") + F.expr(f"INTERVAL {int(minutes)} MINUTES")
    ends = events.filter(F.col("to_status").isin(*TERMINAL)).groupBy("case_id").agg(F.min(at).alias("ended_at"))
    due = limit <= F.lit(as_of).cast(events.schema["ts"].dataType)
    return (
        per.join(ends, "case_id", "left")
        .filter(due & (F.col("ended_at").isNull() | (F.col("ended_at") > limit)))
        .select("case_id", "started_at", "ended_at")
    )


def poll_rate(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """Events per window and how many cases sent them."""
    return events.groupBy(F.window("ts", window).alias("w")).agg(
        F.count("*").alias("polls"), F.count_distinct("case_id").alias("cases")
    ).select(F.col("w.start").alias("window_start"), "polls", "cases")


PART_ENTRIES = 5000


def _sessions(entries: DataFrame) -> DataFrame:
    """One row per session: its first terminal entry, first and last time, in one pass."""
    last = F.when(F.col("type").isin("done", "error"), F.col("entry_id"))
    return entries.groupBy("session_id").agg(
        F.min(last).alias("end_id"), F.min_by("type", last).alias("status"), F.min_by("ts", last).alias("ended_at"),
        F.min("ts").alias("started_at"), F.max("ts").alias("last_ts"), F.count("*").alias("entries"),
    )


def assemble_stream(entries: DataFrame, part_entries: int = PART_ENTRIES) -> DataFrame:
    """Text of each session in entry order up to its first done or error.

    A session comes back in parts of at most ``part_entries`` entry numbers, so no task
    ever collects more than that many chunks however long a session is; nearly all sessions
    are the single part 0. Concatenating the parts in order gives the whole text.
    """
    chunks = entries.filter("type = 'chunk'").join(_sessions(entries).select("session_id", "end_id", "status"), "session_id")
    chunks = chunks.filter(F.col("end_id").isNull() | (F.col("entry_id") < F.col("end_id")))
    part = F.expr(f"(entry_id - 1) div {int(part_entries)}")
    pieces = F.array_sort(F.collect_list(F.struct("entry_id", "data")))
    return chunks.groupBy("session_id", part.alias("part_no")).agg(
        F.array_join(F.transform(pieces, lambda p: p["data"]), "").alias("text"),
        F.count("*").alias("chunks"), F.coalesce(F.max("status"), F.lit("streaming")).alias("status"),
    )


def resume_from(entries: DataFrame, session_id: str | None = None, last_id: int = 0) -> DataFrame:
    """Entries after the last one seen, in order; from the start by default."""
    rows = entries if session_id is None else entries.filter(F.col("session_id") == session_id)
    return rows.filter(F.col("entry_id") > last_id).orderBy("session_id", "entry_id")


def expire_streams(
    entries: DataFrame, as_of: datetime, chunk_minutes: int = 15, session_hours: int = 24
) -> DataFrame:
    """Entries that are kept: chunk data goes ``chunk_minutes`` after its session ended, and
    everything ``session_hours`` after the session's first entry."""
    now = F.lit(as_of).cast(entries.schema["ts"].dataType)
    known = entries.join(_sessions(entries).select("session_id", "started_at", "ended_at"), "session_id")
    young = now < F.col("started_at") + F.expr(f"INTERVAL {int(session_hours)} HOURS")
    fresh = F.col("ended_at").isNull() | (now < F.col("ended_at") + F.expr(f"INTERVAL {int(chunk_minutes)} MINUTES"))
    return known.filter(young & ((F.col("type") != "chunk") | fresh)).select("session_id", "entry_id", "type", "data", "ts")


def open_sessions(entries: DataFrame) -> DataFrame:
    """Session rows: state, entries and last activity."""
    return _sessions(entries).select(
        "session_id", "entries", "last_ts", F.coalesce("status", F.lit("streaming")).alias("status")
    )

