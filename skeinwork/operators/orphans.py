"""References to records that do not exist at the time of the referring row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.skew import HOT_ROWS, hot_split_join
from skeinwork.session import cut


@dataclass(frozen=True)
class Reference:
    """One foreign key: `key` of `child` at the time `at` must be `parent_key` of a parent valid at that time."""

    table: str
    child: DataFrame
    row_id: str
    key: Column
    at: str
    period: Column
    parent: DataFrame
    parent_key: Column
    valid_from: str
    valid_to: str


def _children(ref: Reference) -> DataFrame:
    return ref.child.select(F.col(ref.row_id).alias("row_id"), ref.key.alias("__key"), F.col(ref.at).alias("__at"), ref.period.alias("period")).filter(F.col("__key").isNotNull())


def _orphan_keys(ref: Reference, children: DataFrame) -> DataFrame:
    """Distinct (key, time, period) that have no valid parent, with the rows of each.

    Keys are made distinct before anything is shuffled, so a key that a third of the rows refer to is as cheap
    as any other; the anti-join sees distinct keys only.
    """
    refs = children.groupBy("__key", "__at", "period").agg(F.count("*").alias("__n"))
    parents = ref.parent.select(ref.parent_key.alias("__pk"), F.col(ref.valid_from).alias("__from"), F.col(ref.valid_to).alias("__to")).filter(F.col("__pk").isNotNull()).distinct()
    valid = (refs["__key"] == parents["__pk"]) & (parents["__from"] <= refs["__at"]) & (parents["__to"].isNull() | (parents["__to"] > refs["__at"]))
    return refs.join(parents, valid, "left_anti")


def orphan_rows(ref: Reference, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(table_name, row_id) of every row whose reference has no valid target.

    A null key is no reference. A row without a time has no valid target. Repeated rows each count.
    An empty child gives no row; an empty parent makes every reference an orphan.
    """
    children = _children(ref)
    keys = cut(_orphan_keys(ref, children), "orphans")
    found = hot_split_join(children, keys, ["__key", "__at", "period"], "__n", hot_rows, null_safe=True)
    return found.select(F.lit(ref.table).alias("table_name"), "row_id")


def orphan_counts(ref: Reference) -> DataFrame:
    """(table_name, period, n_references, n_orphans, n_orphan_keys) for every period that has references."""
    children = _children(ref)
    refs = children.groupBy("period").agg(F.count("*").alias("n_references"))
    bad = _orphan_keys(ref, children).groupBy("period").agg(F.sum("__n").alias("__o"), F.countDistinct("__key").alias("__k")).withColumnRenamed("period", "__p")
    out = refs.join(bad, refs["period"].eqNullSafe(bad["__p"]), "left")
    return out.select(F.lit(ref.table).alias("table_name"), "period", "n_references", F.coalesce("__o", F.lit(0)).alias("n_orphans"), F.coalesce("__k", F.lit(0)).alias("n_orphan_keys"))
