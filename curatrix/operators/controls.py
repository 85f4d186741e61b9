"""A cleanup plan under human control: commands folded into the state of each decision, and what an execution does with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.semantics import ladder
from curatrix.operators.numbering import numbered

#: Actions that an execution carries out, with the suffix of what it writes; states of an approval.
ELIGIBLE = {"CLEAN_LIGHT": "clean_light", "CLEAN_MEDIUM": "clean_medium", "CLEAN_STRONG": "clean_strong", "CAPTION_ONLY": "caption_only"}
APPROVALS = ("not_requested", "pending", "approved", "rejected")


def controlled(plan: DataFrame, commands: DataFrame) -> DataFrame:
    """plan (item_id, action) with generated_action, action, approval, status, overridden, locked, eligible and refused (commands without effect).

    commands (item_id, command, value, at): override to a value, lock (at a value, or what holds), unlock, approve, reject, in
    the order of `at`; a reset, whatever its item, undoes all before it on every item, locked or not. While an item is locked
    only unlock and approve take effect. Whether it is locked before a command is the last lock or unlock before it, so a fold
    over the log is a window over an item's commands and minima and maxima.
    """
    reset = commands.filter("command = 'reset'").agg(F.max("at").alias("_reset"))  # one row
    commands = commands.filter("command <> 'reset'").crossJoin(F.broadcast(reset)).filter("_reset IS NULL OR at > _reset").drop("_reset")
    before = Window.partitionBy("item_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    lock = F.when(F.col("command").isin("lock", "unlock"), F.col("command") == "lock")
    marked = commands.withColumn("_locked", F.coalesce(F.last(lock, ignorenulls=True).over(before), F.lit(False)))
    done = ~F.col("_locked") | F.col("command").isin("unlock", "approve")
    sets = done & (F.col("command").isin("override", "lock")) & F.col("value").isNotNull()
    last = lambda when, value: F.max(F.when(when, F.struct("at", value.alias("v"))))["v"]
    verdict = ladder((F.col("command") == "reject", "rejected"), otherwise="approved")
    state = marked.groupBy("item_id").agg(
        last(sets, F.col("value")).alias("override"), last(done & F.col("command").isin("approve", "reject", "lock"), verdict).alias("approval"),
        last(done & F.col("command").isin("lock", "unlock"), F.col("command") == "lock").alias("locked"), F.count_if(~done).alias("refused"),
    )
    rows = plan.join(state, "item_id", "left").withColumns({"approval": F.coalesce("approval", F.lit("proposed")), "locked": F.coalesce("locked", F.lit(False)), "refused": F.coalesce("refused", F.lit(0)).cast("long")})
    # an override can't change under a lock, so what is locked is what is overridden, or else generated
    rows = rows.withColumns({"generated_action": F.col("action"), "overridden": F.col("override").isNotNull()}).withColumn("action", F.coalesce("override", "generated_action"))
    status = ladder((F.col("locked"), "locked"), (F.col("overridden"), "overridden"), otherwise=F.col("approval"))
    return rows.withColumn("status", status).withColumn("eligible", (F.col("approval") == "approved") | F.col("locked")).drop("override")


def control_summary(controlled_: DataFrame) -> DataFrame:
    """One row: decisions, approved, rejected, locked, and whether each is resolved."""
    resolved = F.col("approval").isin("approved", "rejected") | F.col("locked")
    return controlled_.agg(F.count("*").alias("decisions"), F.count_if(F.col("approval") == "approved").alias("approved"), F.count_if(F.col("approval") == "rejected").alias("rejected"), F.count_if("locked").alias("locked"), (F.count_if(resolved) == F.count("*")).alias("complete"))


class ApprovalRequired(RuntimeError):
    """A plan isn't resolved, so nothing of it may be carried out."""


#: Fixed value: what is said of a plan that isn't resolved.
UNRESOLVED = "The approved cleanup plan is incomplete. Approve, reject, or lock every decision before expensive or destructive execution."


def gate(controlled_: DataFrame, *by: str) -> DataFrame:
    """decisions, unresolved, allowed and reason, of the plan or of each: whether it may be carried out. A plan without decisions may."""
    resolved = F.col("approval").isin("approved", "rejected") | F.col("locked")
    sums = controlled_.groupBy(*by).agg(F.count("*").alias("decisions"), F.count_if(~resolved).alias("unresolved"))
    allowed = F.col("unresolved") == 0
    return sums.select(*by, "decisions", "unresolved", allowed.alias("allowed"), F.when(allowed, "").otherwise(UNRESOLVED).alias("reason"))


def require_approved(controlled_: DataFrame, yes: bool = False) -> None:
    """Raises ApprovalRequired unless every decision is approved, rejected or locked, or `yes` says to go on."""
    if not yes:
        found = gate(controlled_).first()
        if not found.allowed:
            raise ApprovalRequired(f"{found.reason} ({found.unresolved} of {found.decisions} are left.)")


def execution(controlled_: DataFrame, sources: DataFrame, previous: DataFrame, limit: int | None = None, dry_run: bool = True) -> DataFrame:
    """item_id, action, status, reason of each decision: what an execution does, in the order of the items.

    A plan that isn't resolved is refused (ApprovalRequired) before anything else, a dry run of it too.

    sources: item_id of items whose file is known; previous: item_id, action of what was completed before. With a limit, the
    first `limit` of those that are left are run: only these are numbered.
    """
    require_approved(controlled_)
    rows = controlled_.select("item_id", "action", "approval", "eligible").join(sources.select("item_id").distinct().withColumn("_source", F.lit(True)), "item_id", "left")
    rows = rows.join(previous.select("item_id", "action").distinct().withColumn("_done", F.lit(True)), ["item_id", "action"], "left")
    step = ladder(
        (~F.col("action").isin(*ELIGIBLE), F.concat(F.lit("action not eligible for execution: "), F.col("action"))), (F.col("approval") == "rejected", F.lit("decision rejected")), (~F.col("eligible"), F.lit("decision not approved or locked")),
        (F.col("_source").isNull(), F.lit("source not found")), (F.col("_done"), F.lit("already completed (resume)")), otherwise=F.lit(None).cast("string"),
    )
    rows = rows.select("item_id", "action", step.alias("reason"))
    settled = rows.filter("reason IS NOT NULL").withColumn("status", F.when(F.col("reason") == "source not found", "failed").otherwise("skipped"))
    left = rows.filter("reason IS NULL")
    if limit is not None:
        left = numbered(left, "item_id", name="_n").withColumn("reason", F.when(F.col("_n") > limit, "execution limit reached")).drop("_n")
    ran = "dry-run" if dry_run else "completed"
    left = left.withColumn("status", F.when(F.col("reason").isNotNull(), "skipped").otherwise(ran)).withColumn("reason", F.coalesce("reason", F.lit("dry-run: no files written" if dry_run else "")))
    return settled.select("item_id", "action", "status", "reason").unionByName(left.select("item_id", "action", "status", "reason"))


def approvals_updated(previews: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """previews (item_id, approval) after updates (item_id, state, at), and each update's outcome (item_id, state, at, outcome).

    An update holds if its state is known and exactly one preview has its item; of several, the last.
    """
    known = previews.groupBy("item_id").agg(F.count("*").alias("_n"))
    outcome = ladder((F.col("item_id").isNull() | (F.trim("item_id") == ""), "no item"), (~F.col("state").isin(*APPROVALS) | F.col("state").isNull(), "unknown state"), (F.col("_n").isNull(), "no preview"), (F.col("_n") > 1, "ambiguous"), otherwise="updated")
    judged = updates.join(known, "item_id", "left").withColumn("outcome", outcome).drop("_n")
    last = judged.filter("outcome = 'updated'").groupBy("item_id").agg(F.max(F.struct("at", "state"))["state"].alias("_state"))
    after = previews.join(last, "item_id", "left").withColumn("approval", F.coalesce("_state", "approval")).drop("_state")
    return after, judged


#: Fixed value: how many items each list shows.
GALLERY_COLUMNS = 5


def capped_gallery(items: DataFrame, severity: Column, z: Column, columns: int = GALLERY_COLUMNS, gate: float = 1.0) -> DataFrame:
    """group, place, item_id: the most severe (A), the medium (B), those nearest the gate among all others (C) and the cleanest (D).

    Each list is a top-k, partial on each task; the boundary list is of items that neither A nor B shows.
    """
    rows = items.select("item_id", severity.alias("severity"), z.alias("z"))

    def top(df: DataFrame, name: str, *order: Column) -> DataFrame:
        first = df.orderBy(*order, "item_id").limit(columns)
        return first.select(F.lit(name).alias("group"), "item_id", "z")

    high, medium = (top(rows.filter(F.col("severity") == s), g, F.desc("z")) for s, g in (("HIGH", "A"), ("MEDIUM", "B")))
    shown = F.broadcast(high.union(medium).select("item_id"))  # at most twice `columns` rows
    near = top(rows.join(shown, "item_id", "left_anti"), "C", F.abs(F.col("z") - gate))
    clean = top(rows.filter(F.col("severity") == "NONE"), "D", F.asc("z"))
    lists = high.union(medium).union(near).union(clean)
    order = Window.partitionBy("group").orderBy(F.when(F.col("group") == "D", F.col("z")).otherwise(-F.col("z")), "item_id")
    return lists.select("group", F.row_number().over(order).cast("long").alias("place"), "item_id")
