"""What changed between consecutive full snapshots of a table.

Rows become compact arrays (two 64-bit halves of the key's hash, the ordinal of
the snapshot within its scope, a 64-bit row hash), hash-bucketed by key.  Within
a bucket numpy sorts them and ``searchsorted`` gives the set differences of each
snapshot with its predecessor; full values are fetched for differing keys only.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.sources.workspace import Workspace

ROWS_PER_BUCKET = 1_000_000
_KNOWN, _LOW = 1 << 62, Decimal(1 << 63)
_DIFF = "k1 long, k2 long, seq int, change string"


def _ordinal(version: Column, kind: str) -> Column:
    """A timestamp's microseconds, a date's days or a whole number, in order; null is least."""
    number = {"timestamp_ntz": F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), version), "timestamp": F.unix_micros(version), "date": F.unix_date(version)}.get(kind, version)
    return F.coalesce(number.cast("long"), F.lit(-(1 << 63)))


def _packed(version: Column, digest: Column) -> Column:
    """(version, whether the digest is known, 62 bits of its hash) as one number, so that the greatest row of a key is
    found by hash aggregation."""
    low = F.when(digest.isNull(), F.lit(0)).otherwise(F.shiftrightunsigned(F.xxhash64(digest), 2) + F.lit(_KNOWN))
    return version.cast("decimal(19,0)") * F.lit(_LOW) + low.cast("decimal(19,0)")


def _key_ids(keys: np.ndarray) -> np.ndarray:
    """Dense ids of 128-bit keys: equal keys, equal id."""
    order = np.lexsort((keys["k2"], keys["k1"]))
    a, b = keys["k1"][order], keys["k2"][order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    ids = np.empty(len(order), dtype=np.int64)
    ids[order] = np.cumsum(new) - 1
    return ids


def bucket_differences(pdf: pd.DataFrame) -> pd.DataFrame:
    """Differences of one bucket; a key appears at most once per snapshot ordinal."""
    seq = pdf["seq"].to_numpy(np.int64)
    last = pdf["last_seq"].to_numpy(np.int64)
    known = pdf["known"].to_numpy(bool)
    row_hash = pdf["row_hash"].to_numpy(np.int64)
    k1, k2 = pdf["k1"].to_numpy(np.int64), pdf["k2"].to_numpy(np.int64)
    keys = np.empty(len(pdf), dtype=[("k1", np.int64), ("k2", np.int64)])
    keys["k1"], keys["k2"] = k1, k2
    width = int(last.max()) + 3
    code = _key_ids(keys) * width + seq
    order = np.argsort(code, kind="stable")
    ranked = code[order]

    def position(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(ranked, wanted), len(ranked) - 1)
        return ranked[at] == wanted, order[at]

    before, old = position(code - 1)
    after, _ = position(code + 1)
    parts = [
        (~before & (seq > 1), 0, "added"),
        (before & known & known[old] & (row_hash != row_hash[old]), 0, "changed"),
        (~after & (seq < last), 1, "removed"),
    ]
    return pd.concat(
        [pd.DataFrame({"k1": k1[m], "k2": k2[m], "seq": (seq[m] + step).astype(np.int32), "change": name}) for m, step, name in parts],
        ignore_index=True,
    )


def snapshot_changes(
    records: DataFrame,
    snapshots: DataFrame,
    *,
    scope: Column,
    snapshot: Column,
    key: Column,
    digest: Column,
    version: Column,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Rows (scope, key, snapshot, change) that differ from the scope's previous snapshot.

    ``snapshots`` holds the complete snapshots as (scope, snapshot); records of
    others are passed over, and a scope's first one yields nothing.  Of several
    records of a key in one snapshot the greatest ``version`` (a timestamp, a date
    or a whole number) holds (null is oldest; ties go to a known digest, then to the one of the
    greater hash).  ``changed`` needs two
    known (not null) digests.  Records without scope, snapshot or key are left
    out; a snapshot listed as complete without any record counts as empty only
    for keys of its own scope (all of them are removed).  Extra columns are
    ignored, empty tables give no rows.
    """
    spark = records.sparkSession
    work = Workspace(spark, "snapshots")
    seqs = snapshots.select("scope", "snapshot").where("scope is not null and snapshot is not null").distinct()
    seqs = seqs.select(
        "scope",
        "snapshot",
        F.row_number().over(W.partitionBy("scope").orderBy("snapshot")).alias("seq"),
        F.count(F.lit(1)).over(W.partitionBy("scope")).cast("int").alias("last_seq"),
    )
    rows = records.select(
        scope.alias("scope"), snapshot.alias("snapshot"), key.alias("key"), digest.alias("digest"), version.alias("version")
    ).where("scope is not null and snapshot is not null and key is not null")
    hashes = [F.xxhash64("scope", "key").alias("k1"), F.xxhash64(F.lit("k2"), F.col("key"), F.col("scope")).alias("k2")]
    compact = rows.join(seqs, ["scope", "snapshot"]).select(
        *hashes,
        "seq",
        "last_seq",
        _packed(_ordinal(F.col("version"), dict(rows.dtypes)["version"]), F.col("digest")).alias("row"),
    )
    buckets = max(1, -(-records.count() // rows_per_bucket), int(spark.conf.get("spark.sql.shuffle.partitions")))
    compact = (
        compact.groupBy("k1", "k2", "seq", "last_seq")
        .agg(F.pmod(F.max("row"), F.lit(_LOW)).cast("long").alias("row_hash"))
        .select("k1", "k2", "seq", "last_seq", (F.col("row_hash") >= F.lit(_KNOWN)).alias("known"), "row_hash", F.pmod("k1", F.lit(buckets)).alias("bucket"))
    )
    diffs = work.write(compact.groupBy("bucket").applyInPandas(lambda pdf: bucket_differences(pdf), _DIFF), "diffs")
    # Full values only for the keys that differ.
    wanted = diffs.select("k1", "k2").distinct()
    named = rows.select(*hashes, "scope", "key").distinct().join(wanted, ["k1", "k2"], "left_semi")
    return (
        diffs.join(named, ["k1", "k2"])
        .join(seqs.select("scope", "seq", "snapshot"), ["scope", "seq"])
        .select("scope", "key", "snapshot", "change")
    )
