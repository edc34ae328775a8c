"""Decisions of people as a log of events that is folded, in order, into the state of checks and protocols.

Nothing is updated in place. A check and the atoms of its composite are one
unit; the events of a unit are sorted by (at, event_id) and folded one after the
other over the states of its members, since whether an event is allowed depends
on what those before it left behind: a split shows the atoms, a promotion makes
a candidate, a first verdict may be changed later. Units don't touch each
other, so they are folded in parallel, each in one row; a unit is a composite
with the decisions on it. How many candidates of a process are open after each
event is a running sum of what the units' events added or took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reconlake.operators import metrics, views

VERDICTS = ("CONFIRMED_VIOLATION", "NEGATIVE_VERIFIED", "CLARIFICATION_REQUIRED")


def decidable(status: Column, verified_by: Column) -> Column:
    """May a person decide on it: open, or decided before."""
    return F.coalesce(status.isin(*views.OPEN), F.lit(False)) | verified_by.isNotNull()


def _folded(split: Column, members: Column, events: Column) -> Column:
    """array of struct<refused,before,after>: of each of a unit's sorted events its refusal and the unit's open candidates before and after it.

    members: array of (check_id, is_top, status, verified_by); events: array of
    (at, event_id, check_id, kind, decision, user_id, unexplained, closed).
    """
    atoms = lambda m: F.filter(m, lambda x: ~x["is_top"])

    def open_ones(split: Column, m: Column) -> Column:
        candidate = F.filter(m, lambda x: F.coalesce(x["status"] == "CANDIDATE", F.lit(False)) & (x["is_top"] != split))
        return F.size(candidate).cast("bigint")

    def refused(acc: Column, e: Column, me: Column) -> Column:
        verdict, split, promote = (e["kind"] == k for k in ("verdict", "split", "promote"))
        composite = me["is_top"] & (F.size(atoms(acc["members"])) > 0)
        return (
            F.when(verdict & e["unexplained"], "REJECTION_REQUIRES_REASON")
            .when(split & ~composite, "NOT_A_COMPOSITE").when(split & acc["split"], "ALREADY_SPLIT")
            .when(promote & ~F.coalesce(me["status"] == "SUSPICION", F.lit(False)), "NOT_A_SUSPICION").when(e["closed"].isNotNull(), e["closed"])
            .when(verdict & composite & ~acc["split"], "COMPOSITE_NOT_SPLIT").when(verdict & ~me["is_top"] & ~acc["split"], "NOT_A_CANDIDATE")
            .when(verdict & ~decidable(me["status"], me["verified_by"]), "NOT_A_CANDIDATE")
        )

    def after(acc: Column, e: Column, why: Column) -> Column:
        allowed, verdict = why.isNull(), e["kind"] == "verdict"

        def changed(m: Column) -> Column:
            status = F.when(verdict, e["decision"]).otherwise("CANDIDATE")
            by = F.when(verdict, e["user_id"]).otherwise(m["verified_by"])
            return F.struct(m["check_id"].alias("check_id"), m["is_top"].alias("is_top"), status.alias("status"), by.alias("verified_by"))

        sets = allowed & (e["kind"] != "split")
        new = F.when(sets, F.transform(acc["members"], lambda m: F.when(m["check_id"] == e["check_id"], changed(m)).otherwise(m))).otherwise(acc["members"])
        return F.struct((acc["split"] | (allowed & (e["kind"] == "split"))).alias("split"), new.alias("members"), why.alias("why"))

    def step(acc: Column, e: Column) -> Column:
        me = F.filter(acc["members"], lambda m: m["check_id"] == e["check_id"])
        # Each step is bound once by a one-element transform, so that no later step computes it again.
        why = F.transform(F.slice(me, 1, 1), lambda x: F.struct(refused(acc, e, x).alias("why")))
        state = F.transform(why, lambda w: after(acc, e, w["why"]))
        counted = F.transform(state, lambda s: F.struct(s.alias("s"), open_ones(s["split"], s["members"]).alias("open")))

        def told(x: Column) -> Column:
            now = F.struct(x["s"]["why"].alias("refused"), acc["open"].alias("before"), x["open"].alias("after"))
            return F.struct(x["s"]["split"].alias("split"), x["s"]["members"].alias("members"), x["open"].alias("open"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.transform(counted, told)[0]

    none = F.array().cast("array<struct<refused:string,before:bigint,after:bigint>>")
    return F.aggregate(events, F.struct(split.alias("split"), members.alias("members"), open_ones(split, members).alias("open"), none.alias("out")), step, lambda acc: acc["out"])


def folded(checks: DataFrame, events: DataFrame, protocols: DataFrame) -> DataFrame:
    """`events` with process_id, refused (why a verdict, split or promotion is not allowed at its place in the log, or null) and the unit's open candidates `before` and `after` it.

    checks: check_id, process_id, parent_id, split_at, status, verified_by.
    events: event_id (unique), at, check_id, kind ('verdict', 'split',
    'promote'), decision, reason_code, comment, user_id. protocols: process_id,
    version, status; the last version counts, as it is when the log begins.
    An event on a check that isn't there is refused and has no process; an atom
    whose composite isn't there stays hidden.
    """
    last = views.latest(protocols.select("process_id", "version", F.col("status").alias("protocol_status")), "process_id", "version")
    closed = F.when(F.col("protocol_status").isNull(), "PROTOCOL_NOT_FOUND").when(F.col("protocol_status") == "PROTOCOL_FINALIZED", "PROTOCOL_FINALIZED")
    reason = F.nullif("reason_code", F.lit("")).isNull() | (F.coalesce(F.trim("comment"), F.lit("")) == "")
    unexplained = F.coalesce(F.col("decision") == "NEGATIVE_VERIFIED", F.lit(False)) & reason
    # Events meet their check, then all of a unit meet once, members and events alike; what is told of an event stands beside it, so nothing is joined back.
    unit = F.coalesce("parent_id", "check_id").alias("unit")
    known = checks.select("check_id", "process_id", unit).join(last, "process_id", "left").select("check_id", "process_id", "unit", closed.alias("closed"))
    placed = events.withColumn("unexplained", unexplained).join(known, "check_id", "left")
    order = ["at", "event_id"]
    rest = [c for c in (*events.columns, "process_id", "unexplained", "closed") if c not in order]
    # An event without a check is a unit by itself.
    said = placed.select(F.coalesce("unit", "check_id").alias("unit"), F.col("unit").isNull().alias("lost"), F.struct(*order, *rest).alias("e"))
    is_top = F.col("parent_id").isNull()
    held = checks.select(unit, F.lit(False).alias("lost"), F.struct("check_id", is_top.alias("is_top"), "status", "verified_by").alias("m"), (is_top & F.col("split_at").isNotNull()).alias("split"))
    met = said.unionByName(held, allowMissingColumns=True).repartition("unit", "lost").groupBy("unit", "lost").agg(
        F.array_sort(F.collect_list("e")).alias("events"), F.collect_list("m").alias("members"), F.coalesce(F.bool_or("split"), F.lit(False)).alias("split")
    )
    absent = lambda e: F.when((e["kind"] == "verdict") & e["unexplained"], "REJECTION_REQUIRES_REASON").otherwise("FINDING_NOT_FOUND")
    none = F.lit(None).cast("bigint")
    lost = F.transform("events", lambda e: F.struct(absent(e).alias("refused"), none.alias("before"), none.alias("after")))
    done = met.where(F.size("events") > 0).withColumn("out", F.when(F.col("lost"), lost).otherwise(_folded(F.col("split"), F.col("members"), F.col("events"))))
    told = done.select(F.explode(F.arrays_zip("events", "out")).alias("x"))
    return told.select(*[F.col(f"x.events.{c}").alias(c) for c in (*events.columns, "process_id")], "x.out.refused", "x.out.before", "x.out.after")


def refusal(checks: DataFrame, events: DataFrame, protocols: DataFrame) -> DataFrame:
    """`events` with `refused` (see folded)."""
    return folded(checks, events, protocols).select(*events.columns, "refused")


def protocol_log(checks: DataFrame, events: DataFrame, protocols: DataFrame, processes: DataFrame) -> DataFrame:
    """process_id, at, event_id, kind, refused, pending, protocol_status, process_status after each event of `folded` on a check that is there.

    events: as from folded. processes: process_id, status when the log begins.
    A verdict sets both states by the candidates that are left; a promotion
    takes completed work up again; a split and a refused event change neither.
    """
    first = views.latest(protocols.select("process_id", "version", F.col("status").alias("protocol_was")), "process_id", "version")
    start = views.visible(checks).groupBy("process_id").agg(F.count_if(F.col("status") == "CANDIDATE").alias("pending_was"))
    by = Window.partitionBy("process_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    known = events.where("process_id is not null").join(start, "process_id", "left").join(first, "process_id", "left").join(processes.select("process_id", F.col("status").alias("process_was")), "process_id", "left")
    counted = known.withColumn("pending", F.coalesce("pending_was", F.lit(0)) + F.sum(F.col("after") - F.col("before")).over(by))
    allowed = F.col("refused").isNull()
    verdict = allowed & (F.col("kind") == "verdict")
    place = F.row_number().over(Window.partitionBy("process_id").orderBy("at", "event_id"))
    seen = counted.withColumn("place", place).withColumns({
        "said": F.last(F.when(verdict, F.struct("place", (F.col("pending") == 0).alias("done"))), ignorenulls=True).over(by),
        "promoted": F.max(F.when(allowed & (F.col("kind") == "promote"), F.col("place"))).over(by),
    })
    again = F.col("promoted").isNotNull() & (F.col("said").isNull() | (F.col("promoted") > F.col("said.place")))

    def state(was: str, done: str, working: str) -> Column:
        now = F.when(F.col("said").isNull(), F.col(was)).when(F.col("said.done"), done).otherwise(working)
        return F.when(again & (now == done), working).otherwise(now)

    return seen.select(
        "process_id", "at", "event_id", "kind", "refused", "pending", state("protocol_was", "VERIFICATION_COMPLETED", "VERIFYING").alias("protocol_status"),
        state("process_was", "COMPLETED", "VERIFYING").alias("process_status"),
    )


def applied(checks: DataFrame, events: DataFrame) -> DataFrame:
    """`checks` (check_id, process_id, parent_id, status, engine_status, verified_by, split_at) after events that were allowed (check_id, at, event_id, kind, decision, user_id).

    The last verdict or promotion gives the status; the first of them that
    finds a status fixes what the engine had said; a split is set once.
    """
    order = F.struct("at", "event_id")
    sets = F.col("kind").isin("verdict", "promote")
    new = F.when(F.col("kind") == "verdict", F.col("decision")).otherwise("CANDIDATE")
    folded = events.groupBy("check_id").agg(
        F.max_by(F.when(sets, new), F.when(sets, order)).alias("new_status"), F.max_by(F.when(F.col("kind") == "verdict", F.col("user_id")), F.when(F.col("kind") == "verdict", order)).alias("by"),
        F.count_if(sets).alias("sets"), F.min_by(F.when(sets, new), F.when(sets, order)).alias("first_status"), F.min(F.when(F.col("kind") == "split", F.col("at"))).alias("split"),
    )
    joined = checks.join(folded, "check_id", "left")
    return joined.select(
        "check_id", "process_id", "parent_id", F.coalesce("new_status", "status").alias("status"),
        F.when(F.col("sets") > 0, F.coalesce("engine_status", "status", F.when(F.col("sets") > 1, F.col("first_status")))).otherwise(F.col("engine_status")).alias("engine_status"),
        F.coalesce("by", "verified_by").alias("verified_by"), F.coalesce("split_at", "split").alias("split_at"),
    )


def protocol_states(checks: DataFrame) -> DataFrame:
    """process_id, pending, protocol_status, process_status after decisions, from the visible candidates that remain."""
    open_ = views.visible(checks).groupBy("process_id").agg(F.count_if(F.col("status") == "CANDIDATE").alias("pending"))
    done = F.col("pending") == 0
    return open_.select(
        "process_id", "pending", F.when(done, "VERIFICATION_COMPLETED").otherwise("VERIFYING").alias("protocol_status"), F.when(done, "COMPLETED").otherwise("VERIFYING").alias("process_status")
    )


def finalizable(protocols: DataFrame, states: DataFrame) -> DataFrame:
    """protocol_id, process_id, refused: why a protocol can't be finalized, or null."""
    pending = F.coalesce("pending", F.lit(0)) > 0
    why = F.when(F.col("status") == "PROTOCOL_FINALIZED", "ALREADY_FINALIZED").when(F.col("status") == "SUPERSEDED", "PROTOCOL_SUPERSEDED").when(pending, "CANDIDATES_PENDING")
    return protocols.join(states.select("process_id", "pending"), "process_id", "left").select("protocol_id", "process_id", why.alias("refused"))


def finalized(checks: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold labels (protocol_id, check_id, label, engine_status) and transfers (protocol_id, status) of protocols that may be finalized (protocol_id, process_id)."""
    labelled = views.visible(checks).withColumn("label", metrics.label_of(F.col("status"))).where("label is not null")
    labels = labelled.join(allowed, "process_id").select("protocol_id", "check_id", "label", "engine_status")
    return labels, allowed.select("protocol_id", F.lit("PENDING").alias("status"))


def unfinalized(protocols: DataFrame, labels: DataFrame, transfers: DataFrame, reopened: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without what finalizing the `reopened` protocols (protocol_id) had brought: status back, labels gone, pending transfers cancelled. Only finalized ones are reopened."""
    final = protocols.where("status = 'PROTOCOL_FINALIZED'").join(reopened.select("protocol_id").distinct(), "protocol_id", "left_semi").select("protocol_id", F.lit(True).alias("__again"))
    state = protocols.join(final, "protocol_id", "left").withColumn("status", F.when(F.col("__again"), "VERIFICATION_COMPLETED").otherwise(F.col("status"))).drop("__again")
    cancelled = transfers.join(final, "protocol_id", "left").withColumn("status", F.when(F.col("__again") & (F.col("status") == "PENDING"), "CANCELLED").otherwise(F.col("status"))).drop("__again")
    return state, labels.join(final, "protocol_id", "left_anti"), cancelled


def rejections(events: DataFrame) -> DataFrame:
    """check_id, reason, comment of every rejection among allowed events: negative examples."""
    return events.where("kind = 'verdict' and decision = 'NEGATIVE_VERIFIED'").select("check_id", F.col("reason_code").alias("reason"), "comment")


def mark_read(notifications: DataFrame, requests: DataFrame) -> DataFrame:
    """`notifications` (notification_id, user_id, read_at) after requests (notification_id, user_id, at): the first time stays, and only of one's own."""
    first = requests.groupBy("notification_id", "user_id").agg(F.min("at").alias("__at"))
    return notifications.join(first, ["notification_id", "user_id"], "left").withColumn("read_at", F.coalesce("read_at", "__at")).drop("__at")


def next_versions(protocols: DataFrame, incoming: DataFrame) -> DataFrame:
    """`incoming` (object_id, seq) with version: on from the object's last, in the order of seq."""
    last = protocols.groupBy("object_id").agg(F.max("version").alias("__last"))
    at = F.row_number().over(Window.partitionBy("object_id").orderBy("seq"))
    return incoming.withColumn("__at", at).join(last, "object_id", "left").withColumn("version", F.coalesce("__last", F.lit(0)) + F.col("__at")).drop("__last", "__at")
