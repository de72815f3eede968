"""Policy: changing its dials, judging open invoices again, and what was in force when."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import verify
from ..schemas import POLICY, REVERIFIABLE
from ..sources.stores import store
from . import dedupe, partners

# The ranges of the dials.
RANGES = {"amount_review_threshold": (0, None), "confidence_floor": (0, 1), "duplicate_window_days": (0, 365)}


def changed(policy: dict, patch: dict) -> dict | None:
    """policy with patch's values, or None if nothing changes; a value out of range is an error."""
    for name, value in patch.items():
        low, high = RANGES.get(name, (None, None))
        if name not in POLICY or (low is not None and value < low) or (high is not None and value > high):
            raise ValueError(f"{name}: {value}")
    new = {**policy, **patch}
    return None if new == policy else new


#: What a judgement works out, and what matching does: both are made anew.
JUDGED = ("checks", "status", "reason", "dup_exact", "dup_near", "text_layer", "accounting_id", "error_code", "error_message")
MATCHED = ("by_registration", "by_name", "agreement", "partner_code", "method", "match_confidence", "fuzzy_score")
FACTS = ("arrival", "partner_code", "invoice_number", "total_amount", "issue_date", "status")


def judged_again(rows: DataFrame, invoices: DataFrame, policy: dict = POLICY, master: DataFrame | None = None) -> DataFrame:
    """Stored rows judged anew among all invoices. What a stored row no longer holds stays lost: the text layer and
    unmapped rates; handwriting is taken from its checks. With a master their suppliers are matched again, and a known
    supplier that a row stands by (reviewer_code, or else its own) wins over another match."""
    of = lambda name: F.get(F.filter("checks", lambda c: c["name"] == name), F.lit(0))
    pays = F.coalesce(~of("handwriting.on_payment_details")["passed"], F.lit(False))
    marked = pays | F.coalesce(~of("handwriting.detected")["passed"], F.lit(False))
    carried = rows.withColumns(
        {
            "unmapped_tax_rates": F.array().cast("array<string>"),
            "handwriting_notes": F.when(pays, F.lit("")).otherwise(F.coalesce(of("handwriting.detected")["detail"], F.lit(""))),
            "handwriting_affects_payment": pays,
            "has_handwriting": marked,
        }
    ).drop(*JUDGED)
    if master is not None:
        if "reviewer_code" not in carried.columns:
            carried = carried.withColumn("reviewer_code", F.col("partner_code"))
        # written down once: the judgement takes its rows three times, and would plan and match each time anew
        asked = carried.select(*[c for c in partners.ASKED if c in carried.columns], "reviewer_code")
        matched = store(partners.chosen_by_reviewer(partners.resolve(asked, master), master).drop("reviewer_code"))
        return verify.judge(matched, policy, existing=invoices.select(*FACTS), scope="all", rest=carried.drop(*MATCHED, "reviewer_code"))
    return verify.judge(carried, policy, existing=invoices.select(*FACTS), scope="all")


def reverify(invoices: DataFrame, policy: dict = POLICY, master: DataFrame | None = None) -> DataFrame:
    """Open invoices (checked) judged anew among all others; was is the state before."""
    return judged_again(invoices.filter(F.col("status").isin(*REVERIFIABLE)).withColumn("was", F.col("status")), invoices, policy, master)


def what_if(invoices: DataFrame, policy: dict, patch: dict, master: DataFrame | None = None) -> DataFrame:
    """How many open invoices a change would judge again and how many would move, by state before and after."""
    new = changed(policy, patch) or policy
    return reverify(invoices, new, master).groupBy("was", F.col("status").alias("now")).agg(F.count(F.lit(1)).alias("invoices"))


#: Checks that the dials of a policy decide; every other check stays as it is, whatever the policy.
DIALLED = ("amount.threshold", "confidence.floor", "dedupe.near")


def breakpoints(invoices: DataFrame, policy: dict = POLICY, master: DataFrame | None = None) -> DataFrame:
    """Open invoices judged once, with the values of the dials at which their states flip: arrival, was, blocked and
    doubtful (by checks that no dial decides), total_amount (a smaller limit fails it), min_confidence (a higher floor
    does, and any where it is null) and near_gap (a window as long or longer does)."""
    judged = reverify(invoices, policy, master)
    fails = lambda severity: F.exists("checks", lambda c: ~c["passed"] & (c["severity"] == severity) & ~c["name"].isin(*DIALLED))
    gaps = dedupe.nearest_days(judged, invoices.select(*FACTS))
    flat = judged.join(gaps, "arrival", "left")
    return flat.select("arrival", "was", fails("BLOCKER").alias("blocked"), fails("ERROR").alias("doubtful"), "total_amount", "min_confidence", "near_gap")


def what_if_grid(points: DataFrame, limits: Sequence[int], floors: Sequence[float], windows: Sequence[int]) -> DataFrame:
    """What each policy of a grid would make of invoices, from their breakpoints: was, now and invoices by the three
    dials. Every invoice is put in one cell of the grid, by the mildest values that fail it, and cells are summed up
    along the dials, so a policy more costs a cell and no judgement."""
    # from strict to mild: a limit of 0 is none
    ranked = {
        "amount_review_threshold": (sorted(set(limits), key=lambda v: (v == 0, v)), "bigint", lambda v: (v != 0) & (v < F.col("total_amount"))),
        "confidence_floor": (sorted(set(floors), reverse=True), "double", lambda v: F.coalesce(v > F.col("min_confidence"), F.lit(True))),
        "duplicate_window_days": (sorted(set(windows), reverse=True), "int", lambda v: v >= F.col("near_gap")),
    }
    values = {name: F.array(*[F.lit(v) for v in grid]).cast(f"array<{kind}>") for name, (grid, kind, _) in ranked.items()}
    place = {name: F.size(F.filter(values[name], lambda v: F.coalesce(fails(v), F.lit(False)))) for name, (_, _, fails) in ranked.items()}
    cells = points.filter("not blocked and not doubtful").groupBy("was", *[c.alias(name) for name, c in place.items()]).agg(F.count(F.lit(1)).alias("n"))
    of = lambda c: F.count(F.when(c, F.lit(1)))
    grid = points.groupBy("was").agg(of(F.col("blocked")).alias("BLOCKED"), of(~F.col("blocked")).alias("_open"))
    for name, (steps, _, _) in ranked.items():
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    clean = grid.join(cells, ["was", *ranked], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    for name in ranked:
        others = [c for c in ranked if c != name]
        clean = clean.withColumn("n", F.sum("n").over(Window.partitionBy("was", *others).orderBy(name)))
    shown = [F.get(values[name], F.col(name)).alias(name) for name in ranked]
    states = F.explode(F.array(*[F.struct(F.lit(s).alias("now"), c.alias("invoices")) for s, c in (("BLOCKED", F.col("BLOCKED")), ("NEEDS_REVIEW", F.col("_open") - F.col("n")), ("EXTRACTED", F.col("n")))]))
    return clean.select(*shown, "was", states.alias("s")).select(*ranked, "was", "s.*").filter("invoices > 0")


def history(changes: DataFrame, n: int = 25) -> DataFrame:
    """The newest n changes (Spark keeps only n rows of each partition)."""
    return changes.orderBy(F.col("change_id").desc()).limit(n)


def in_force(events: DataFrame, changes: DataFrame, slot: str = "day") -> DataFrame:
    """events (event_id, at) each with the last change (change_id, at, value) not after it, or nulls.

    Events and changes lie together in time slots and each event takes the last change before it in its slot, by one
    sort of the slot; a slot's first events take the last change of the slots before, of which there is one row each.
    """
    made = F.struct("change_id", "at", "value")
    of_changes = changes.select(F.date_trunc(slot, "at").alias("slot"), "at", F.lit(None).cast(dict(events.dtypes)["event_id"]).alias("event_id"), made.alias("change"), F.lit(0).alias("turn"))
    of_events = events.select(F.date_trunc(slot, "at").alias("slot"), "at", "event_id", F.lit(None).cast(of_changes.schema["change"].dataType).alias("change"), F.lit(1).alias("turn"))
    both = of_changes.unionByName(of_events)
    within = Window.partitionBy("slot").orderBy("at", "turn", F.col("change.change_id")).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("inside", F.last("change", ignorenulls=True).over(within)).filter("turn = 1")
    last = both.groupBy("slot").agg(F.max_by("change", F.when(F.col("turn") == 0, F.struct("at", F.col("change.change_id")))).alias("last"))
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("slot", F.last("last", ignorenulls=True).over(before).alias("carried"))
    chosen = inside.join(carried, "slot", "left").withColumn("chosen", F.coalesce("inside", "carried"))
    return chosen.select("event_id", "at", F.col("chosen.change_id").alias("change_id"), F.col("chosen.value").alias("value"))
