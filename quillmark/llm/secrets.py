"""Secrets in texts, scanned by an incremental ledger of contents. All of it is native columns.

A text is a version of a blob, named by its SHA-256. The ledger holds a row for each blob and version of the rules that were
scanned, with the findings. A scan takes the blobs of a table that the ledger lacks under the present rules, one text of each,
appends their findings, and joins the ledger back to every row that holds the blob.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import scratch, small, stored, unused
from quillmark.llm.native_spans import SPAN, counted, listed, masked, matches, merged, of_kind, spans

BASE = ("assign", "access", "hex")
#: Kinds in the order that ties take; the last three are the method's own.
KINDS = (*BASE, "private_key", "service_token", "web_token")
#: The base patterns, without matches that would be dropped where the pattern can leave them out.
_NAME = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = rf"""({_NAME})["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?:\G|(?<![0-9a-f]))[0-9a-f]{16,}+"
PRIVATE_KEY = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
SERVICE_TOKEN = r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+)"
WEB_TOKEN = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"
#: What the masks cover besides: a key's body up to the matching END line, or its base64 lines if there is none.
_GAP = r"""(?:\s|\\[nr]|["'+>#*|])"""
KEY_BLOCK = (
    r"-----BEGIN ([A-Z ]{0,40})PRIVATE KEY-----(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END \1PRIVATE KEY-----"
    rf"|(?:\s*+(?:Proc-Type|DEK-Info):[^\n]*+)*+(?:{_GAP}++[A-Za-z0-9/][A-Za-z0-9+/]{{31,}}+=*+)*+(?:{_GAP}++[A-Za-z0-9+/]++=*+(?=[\x20\t\r]*+(?:\n|$)))?+)"
)
COVERS = ("key_block",)
MARK = "[secret]"
#: Version of the rules above, which changes with any of them; findings of other versions aren't used.
VERSION = hashlib.sha256("\n".join((*KINDS, *COVERS, ASSIGN, ACCESS, HEX, PRIVATE_KEY, SERVICE_TOKEN, WEB_TOKEN, KEY_BLOCK)).encode()).hexdigest()[:16]
_LEDGER = f"blob string, rules string, found {SPAN}"


def found_spans(text: Column) -> Column:
    """All spans of a text column without nulls: those of KINDS, and those of COVERS, which count for masks alone."""
    has = lambda s: F.contains(text, F.lit(s))
    checks = {
        "assign": (ASSIGN, has("=") | has(":"), lambda x: F.length(F.regexp_extract(x, ASSIGN, 2)) >= 12),
        "access": (ACCESS, has("AKIA"), None),
        "hex": (HEX, text.rlike("[0-9a-f]{16}"), None),
        "private_key": (PRIVATE_KEY, has("-----BEGIN "), None),
        "service_token": (SERVICE_TOKEN, has("gh") | has("xox") | has("sk_live_"), None),
        "web_token": (WEB_TOKEN, has("eyJ"), None),
        "key_block": (KEY_BLOCK, has("-----BEGIN "), None),
    }
    return merged(*(spans(matches(text, pattern, hint), kind, rank, keep) for rank, (kind, (pattern, hint, keep)) in enumerate((k, checks[k]) for k in (*KINDS, *COVERS))))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none if nothing was scanned yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(path)


def known_blobs(spark: SparkSession, ledger: str, version: str) -> DataFrame:
    """(blob, found) of the ledger under one version, once for each blob, stored."""
    return stored(read_ledger(spark, ledger).where(F.col("rules") == version).select("blob", "found").dropDuplicates(["blob"]), "known")


def scan_unseen(docs: DataFrame, ledger: str, version: str = VERSION, key: str = "doc_id", text: str = "text") -> None:
    """Scans the blobs that ``ledger`` lacks under ``version``, one text of each, and appends their findings to it.

    A scan that fails appends nothing; one that is run again scans what is still unseen. Rows that repeat both key and text are scanned each, and one result is kept.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(f"`{key}`").cast("string")).alias("owner"), F.sha2(whole, 256).alias("blob"), whole.alias("text"))
    seen = read_ledger(spark, ledger).where(F.col("rules") == version).select("blob")
    first = rows.groupBy("blob").agg(F.min("owner").alias("owner")).join(seen, "blob", "left_anti")
    unseen = rows.join(first, ["owner", "blob"], "left_semi")
    found = unseen.select("blob", F.lit(version).alias("rules"), found_spans(F.col("text")).alias("found")).groupBy("blob", "rules").agg(F.first("found").alias("found"))
    found.write.mode("append").option("compression", "zstd").parquet(ledger)


def scan(docs: DataFrame, ledger: str, version: str = VERSION, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, blob, found) of every row, after ``scan_unseen``.

    Null text is the empty blob; texts may have any length. Rows with the same key and several texts have their own findings each, repeated rows a row each. Keys may be of any
    simple type and may be null. Other columns don't matter. An empty table gives no rows.
    """
    scan_unseen(docs, ledger, version, key, text)
    known = known_blobs(docs.sparkSession, ledger, version)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256).alias("blob"))
    return rows.join(known, "blob", "left").select("doc_id", "blob", "found")


def secrets_digest(docs: DataFrame, ledger: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob) of every row, by a new ledger unless one is given; see ``scan`` for nulls and other cases."""
    found = F.col("found")
    return scan(docs, ledger or scratch(docs.sparkSession, "ledger"), key=key, text=text).select(
        F.col("doc_id").cast("long").alias("doc_id"), *(counted(found, k).alias(f"n_{k}") for k in BASE), F.sha2(listed(of_kind(found, *BASE)), 256).alias("base_sha256"), listed(of_kind(found, *KINDS)).alias("spans"), "blob"
    )


def without_secrets(docs: DataFrame, ledger: str | None = None, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mark, and ``length``, if there is such a column, set anew where text was changed.

    No row is dropped; rows without secrets stay as they are, null texts too. Texts may have any length, repeated rows are changed alike, and other columns may have any names and types.
    """
    spark = docs.sparkSession
    ledger = ledger or scratch(spark, "ledger")
    scan_unseen(docs, ledger, key="doc_id" if "doc_id" in docs.columns else text, text=text)
    blob, found = unused(docs, "__blob", "__found")
    dirty = known_blobs(spark, ledger, VERSION).where(F.size("found") > 0).select(F.col("blob").alias(blob), F.col("found").alias(found))
    own = F.col(f"`{text}`")
    joined = docs.withColumn(blob, F.sha2(F.coalesce(own, F.lit("")), 256)).join(small(dirty), blob, "left")
    changed = F.col(found).isNotNull()
    out = joined.withColumn(text, F.when(changed, masked(own, F.col(found), MARK)).otherwise(own))
    if length in docs.columns:
        kind = docs.schema[length].dataType
        out = out.withColumn(length, F.when(changed, F.length(F.col(f"`{text}`")).cast(kind)).otherwise(F.col(f"`{length}`")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
