"""Secret scans with an incremental ledger of blobs.

Every version of every path is content-addressed. The ledger holds what each version of the rules found in each blob; a
scan reads only blobs that this version of the rules hasn't seen, one row for each, and joins findings back to all paths
and versions with that content.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import durable, map_tables

#: The rules, in the order in which spans that start together are listed. A match whose group is shorter
#: than the length given is dropped.
RULES = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 12),
    "access": (r"AKIA[A-Z0-9]+", re.A, 0, 18),
    "hex": (r"[0-9a-f]+", re.A, 0, 16),
    "github": (r"gh[pousr]_[A-Za-z0-9]+", re.A, 0, 36),
    "slack": (r"xox[baprs]-[A-Za-z0-9-]+", re.A, 0, 16),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", re.A, 0, 24),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", re.A, 0, 0),
}
BASE = ("assign", "access", "hex")
RULE_VERSION = "rules-1"
LEDGER = "blob string, rule_version string, spans array<struct<kind:string,start:int,stop:int>>"

#: Rules whose failing matches can't hide a match that passes may ask for the length at once.
_FAST = {"hex": r"[0-9a-f]{16,}", "access": r"AKIA[A-Z0-9]{14,}"}
_COMPILED = [(kind, re.compile(_FAST.get(kind, pattern), flags), group, least) for kind, (pattern, flags, group, least) in RULES.items()]
_RANK = {kind: i for i, kind in enumerate(RULES)}


def spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of secrets in code points, end exclusive, by start and then by rule; leftmost and not overlapping for each rule."""
    found = [(m.start(), _RANK[kind], kind, m.end()) for kind, rule, group, least in _COMPILED for m in rule.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, stop) for start, _, kind, stop in sorted(found)]


def scan(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings for all rows of ``path, version, text``, and the ledger with what was scanned now.

    Findings have ``path, version, blob, spans``. Blobs that the ledger (``blob, rule_version, spans``) has under this
    rule version aren't read. A null text equals an empty one and has no spans; null paths and versions stay; rows that
    repeat share their blob and its findings; other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blob = F.sha2(F.encode("text", "UTF-8"), 256).alias("blob")
    read = versions.select("path", "version", text.alias("text"))
    addressed = durable(read.select("path", "version", blob))
    unseen = addressed.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("one"))
    if ledger is not None:
        unseen = unseen.join(ledger.filter(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    ones = unseen.select(F.col("one.path").alias("_path"), F.col("one.version").alias("_version"), F.col("blob").alias("_blob"))
    # One row of each unseen blob brings its text; Spark broadcasts the list when it is small, as it is in a later scan.
    todo = read.join(ones, F.col("path").eqNullSafe(F.col("_path")) & F.col("version").eqNullSafe(F.col("_version")), "inner").filter(blob == F.col("_blob")).select(F.col("_blob").alias("blob"), "text")

    def find(rows: pa.Table) -> pa.Table:
        found = [[{"kind": k, "start": a, "stop": b} for k, a, b in spans(t)] for t in rows["text"].to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        return pa.table([rows["blob"], pa.array(found, kind)], names=["blob", "spans"])

    fresh = map_tables(todo, find, "blob string, spans array<struct<kind:string,start:int,stop:int>>")
    fresh = durable(fresh.groupBy("blob").agg(F.first("spans").alias("spans")).select("blob", F.lit(rule_version).alias("rule_version"), "spans"))
    full = fresh if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(fresh)
    now = full.filter(F.col("rule_version") == rule_version).select("blob", "spans")
    return addressed.join(now, "blob").select("path", "version", "blob", "spans"), full


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found, _ = scan(docs.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    base = joined(F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    return found.select(F.col("path").alias("doc_id"), *map(count, BASE), F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
