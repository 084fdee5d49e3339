"""Secret scans over an incremental blob ledger, on the JVM alone.

Every version of every text is a blob, addressed by its SHA-256. The ledger records the findings of each pair of blob and rule
version that was ever scanned; a scan takes up only pairs not yet there, each distinct blob once, however many rows hold it. Findings
are joined back to all rows.

A scan's findings are a folder of their own in the ledger, which counts once it is complete: a scan that fails leaves nothing behind that
is read. Two scans at a time may both take up a blob; the findings of a pair are the same whoever found them, and are read once.

Defined cases: a null text is the empty blob; repeated rows give a row each; an empty table gives none; columns other than the id
and text are ignored; a text of any length is read whole, in time linear in its length and its matches; kinds that match at the same
place are all reported, in the order listed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import native
from .common import new_path, text_or_empty

RULES_VERSION = "1"
KINDS = ("assign", "access", "hex")
_KEY = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
BASE = {
    "assign": _KEY + r"""["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
    "access": "AKIA[A-Z0-9]{16,}+",
    "hex": "[0-9a-f]{24,}+",
}
# Published token formats. Kinds that the method adds.
MORE = {
    "github": "(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,255}+",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "pem": "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}+",
}
FINDINGS = "array<struct<start:int,order:int,end:int,kind:string>>"


def _assign(x: Column) -> Column:
    value = F.regexp_extract(x["match"], rf"""^{_KEY}["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)$""", 1)
    return F.length(value) >= 6


def findings(text: Column) -> Column:
    """All spans of a text as sorted (start, order, end, kind)."""
    parts = []
    for i, (kind, pattern) in enumerate((BASE | MORE).items()):
        found = native.matches(text, pattern)
        parts.append(native.kind_spans(F.filter(found, _assign) if kind == "assign" else found, kind, i))
    return F.sort_array(F.concat(*parts))


#: Parts that the rows of a blob are dealt to where findings are joined back, as a third of all rows may be copies of one.
SPLIT = 16


class Ledger:
    """A table of (blob, rules, findings) in a folder that all executors share: a Parquet folder for each scan."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: str = RULES_VERSION):
        self.spark, self.path, self.rules = spark, path or new_path(spark, "ledger"), rules

    def read(self) -> DataFrame | None:
        """All complete scans' rows; a pair that two scans took up at a time stands there twice."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        scans = [x.getPath() for x in fs.listStatus(p)] if fs.exists(p) else []
        done = sorted(x.toString() for x in scans if fs.exists(x.suffix("/_SUCCESS")))
        return self.spark.read.schema(f"blob binary, rules string, findings {FINDINGS}").parquet(*done) if done else None

    def scan(self, versions: DataFrame) -> DataFrame:
        """versions: blob, text. Scans the blobs that the ledger lacks under these rules, adds them and returns the ledger of these rules."""
        known = self.read()
        fresh = versions
        if known is not None:
            fresh = fresh.join(known.where(F.col("rules") == self.rules).select("blob"), "blob", "left_anti")
        once = fresh.groupBy("blob").agg(F.first("text").alias("text"))
        once.select("blob", F.lit(self.rules).alias("rules"), findings(F.col("text")).alias("findings")).write.parquet(f"{self.path}/scan-{uuid.uuid4().hex}")
        return self.read().where(F.col("rules") == self.rules)


def scan(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, findings (array of start, order, end, kind)."""
    ledger = ledger or Ledger(docs.sparkSession)
    text = text_or_empty()
    blob = F.unhex(F.sha2(text, 256))
    known = ledger.scan(docs.select(blob.alias("blob"), text.alias("text")))
    # only blobs with findings travel back, once each; a blob's rows are split over tasks
    hits = known.where(F.size("findings") > 0).groupBy("blob").agg(F.first("findings").alias("findings"))
    hits = hits.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob.alias("blob")).withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(SPLIT)).cast("int"))
    d = d.join(hits, ["blob", "_part"], "left")
    every = F.coalesce("findings", F.expr(f"cast(array() AS {FINDINGS})"))
    d = d.select("doc_id", every.alias("findings"))
    base = F.filter("findings", lambda s: s["order"] < len(KINDS))
    of = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long")
    return d.select(
        "doc_id", *(of(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(native.joined(base), 256).alias("base_sha256"), native.joined(F.col("findings")).alias("spans"), "findings",
    )
