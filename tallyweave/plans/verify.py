"""The whole verification as one plan: normalise, resolve, find duplicates, check, register."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, dedupe, ledger, normalize, partners
from ..schemas import POLICY
from ..sources.stores import store, unbroadcast


def verify(raw: DataFrame, master: DataFrame, policy: dict = POLICY, existing: DataFrame | None = None, scope: str = "earlier") -> DataFrame:
    """Checked invoices from raw transcriptions with arrival. existing is what duplicates are looked for in; without
    it, the batch itself."""
    rows = store(normalize.normalize(raw))
    return judge(store(partners.resolve(rows.select(*partners.ASKED), master)), policy, existing, scope, rows)


def judge(resolved: DataFrame, policy: dict = POLICY, existing: DataFrame | None = None, scope: str = "earlier", rest: DataFrame | None = None) -> DataFrame:
    """Checked invoices from resolved ones. rest has the columns that matching and duplicates do not need, by arrival, where
    resolved is without them: whole invoices are dealt once then, when all is known that is put to them."""
    within = resolved if existing is None else existing
    rows = dedupe.with_duplicates(resolved, within, scope, policy["duplicate_window_days"])
    if rest is not None:
        rows = rest.join(unbroadcast(rows.select("arrival", *[c for c in rows.columns if c not in rest.columns])), "arrival")
    return checks.run_checks(rows, policy)


def register(checked: DataFrame, master: DataFrame, held: DataFrame | None = None, policy: dict = POLICY, start: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(invoices, records): checked with their state after registration, and the new ledger records. Only clean
    invoices are sent, and none where the policy says so."""
    clean = checked.filter("status = 'EXTRACTED'") if policy["auto_post_enabled"] else checked.filter(F.lit(False))
    requests = ledger.build_payload(clean).filter("gap is null").drop("gap")
    if held is not None and "bucket" in held.columns:
        requests = store(requests)
        held = ledger.touched(requests, held)
    answers, records = ledger.admit(requests, master, held, start)
    told = answers.select("arrival", "accounting_id", "error_code", "error_message", F.lit(True).alias("sent"))
    out = checked.join(told, "arrival", "left")
    out = out.withColumn("checks", ledger.refusal_check(F.col("checks"), F.col("error_code"), F.col("error_message")))
    return out.withColumn("status", F.when(F.col("sent"), ledger.status_after(F.col("error_code"))).otherwise(F.col("status"))).drop("sent"), records
