"""Applying human decisions (J1-J6, O5-O9): typed joins on ids, never positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.functions.text import text

#: Reasons behind the note codes of a removal, any case.
REASONS = {"H": "Hollow Abstract", "G": "Grey Literature", "DUP": "Duplicate", "NOT DUP": "Not Duplicate", "IRRELEVANT": "Irrelevant"}


def combined_view(active: DataFrame, log: DataFrame) -> DataFrame:
    """Both tables as one; they are disjoint by design."""
    return active.unionByName(log, allowMissingColumns=True)


def full_outer(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """J1 for overlapping tables: a full outer merge on shared columns."""
    return left.join(right, on, "full")


def last_of(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row for each key: the last by ``order``, else the last as the table is read. Rows with a null key go."""
    at = F.col(order) if order else F.monotonically_increasing_id()
    rest = [c for c in df.columns if c != key]
    last = df.where(F.col(key).isNotNull()).withColumn("__at", at).groupBy(key).agg(F.max_by(F.struct(*rest), "__at").alias("__r"))
    return last.select(*[F.col(f"__r.{c}").alias(c) if c != key else F.col(key) for c in df.columns])


def updated(left: DataFrame, right: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """Non-blank values of the right table replace the left's, matched by key (D24). Of a repeated key the last row counts."""
    r = last_of(right, key, order).select(key, *[F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)).alias(f"__{c}") for c in columns])
    joined = left.join(r, key, "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in left.columns])


def with_reason(df: DataFrame, code: Column, step: str, default: str = "Unknown reason") -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return df.withColumns({"reason_for_removal": F.coalesce(F.element_at(table, F.upper(F.trim(code))), F.lit(default)), "removal_step": F.lit(step)})


def apply_manual(active: DataFrame, log: DataFrame, decisions: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """U and G rows take the reviewer's values, G sets ``grey_flag``, R moves the row to the log.

    ``decisions``: ``orig_index, update_flag`` and some of ``columns``. Of a repeated id the last row counts.
    """
    d = last_of(decisions, "orig_index").withColumn("update_flag", F.upper(F.trim(text("update_flag"))))
    gone_ids = d.where("update_flag = 'R'").select("orig_index")
    gone = active.join(gone_ids, "orig_index", "left_semi").withColumns({"reason_for_removal": F.lit("REVIEW"), "removal_step": F.lit("Manual DOI Update")})
    kept = updated(active.join(gone_ids, "orig_index", "left_anti"), d.where("update_flag in ('U', 'G')"), "orig_index", [c for c in columns if c in d.columns])
    grey = d.where("update_flag = 'G'").select("orig_index", F.lit(True).alias("__g"))
    before = F.col("grey_flag") if "grey_flag" in kept.columns else F.lit(False)
    kept = kept.join(grey, "orig_index", "left").withColumn("grey_flag", F.coalesce("__g", before, F.lit(False))).drop("__g")
    return kept, log.unionByName(gone, allowMissingColumns=True)


def apply_duplicate_decisions(active: DataFrame, log: DataFrame, decisions: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """R removes with its note's reason, K restores from the log; also the action log.

    ``decisions``: ``orig_index, update_flag, flag_note``. Merges (M) go through ``dedup.resolve_merges``. Of a repeated id the
    last row counts (by ``order``, else as the table is read), so no row is logged or restored twice.
    """
    d = last_of(decisions, "orig_index", order).select("orig_index", F.upper(F.trim(text("update_flag"))).alias("update_flag"), text("flag_note").alias("flag_note"))
    removed = d.where("update_flag = 'R'")
    gone = with_reason(active.join(removed.select("orig_index", "flag_note"), "orig_index"), F.col("flag_note"), "Duplicate review").drop("flag_note")
    back = last_of(log.join(d.where("update_flag = 'K'"), "orig_index", "left_semi"), "orig_index")
    new_log = log.join(back.select("orig_index"), "orig_index", "left_anti").unionByName(gone, allowMissingColumns=True)
    restored = back.drop("reason_for_removal", "removal_step", "dup_doi_cnt")
    new_active = active.join(removed, "orig_index", "left_anti").unionByName(restored, allowMissingColumns=True)
    actions = d.where("update_flag in ('R', 'K', 'M')").select(F.element_at(F.create_map(*[F.lit(x) for x in ("R", "removed", "K", "kept", "M", "merged")]), F.col("update_flag")).alias("action"), F.col("orig_index").alias("article_id"))
    return new_active, new_log, actions


def apply_final(active: DataFrame, log: DataFrame, review: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R removes, A takes the reviewed row in place of the active one; without a Decision column nothing changes."""
    if "Decision" not in review.columns:
        return active, log
    r = last_of(review, "orig_index").withColumn("Decision", F.upper(F.trim(text("Decision"))))
    out = r.where("Decision = 'R'").select("orig_index")
    again = r.where("Decision = 'A'").drop("Decision")
    gone = active.join(out, "orig_index", "left_semi").withColumns({"reason_for_removal": F.lit("Final review"), "removal_step": F.lit("Final QC")})
    kept = active.join(out.unionAll(again.select("orig_index")), "orig_index", "left_anti")
    same = [c for c in active.columns if c in again.columns]
    return kept.unionByName(again.select(*same), allowMissingColumns=True), log.unionByName(gone, allowMissingColumns=True)
