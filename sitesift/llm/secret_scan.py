"""Secret scans over an incremental ledger of content-addressed blobs.

Every historical version of a file is addressed by the SHA-256 of its text.
The ledger remembers which (blob, rule version) pairs were scanned and what
was found. A scan reads distinct blobs only, and of those only pairs that the
ledger lacks; findings are joined back to all paths and versions that hold
the blob. Column functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, stage


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and without overlap; those whose
    ``group`` is shorter than ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Rule versions, in the order that breaks ties of spans with one start.
RULES: dict[str, tuple[Rule, ...]] = {
    "base-1": (
        Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        Rule("access", r"(AKIA[A-Z0-9]+)", 1, 16),
        Rule("hex", r"([0-9a-f]{32,})", 1, 32),  # a run of 32 or more, from its start
    ),
    "issued-2": (
        # from BEGIN to END; where the key is cut, its runs of 16 and more. Possessive, so that long keys are no recursion.
        Rule("pem", r"(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?:[^-]++|-{1,4}+[^-])*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
             r"|(?:[\x20\t\r\n]*+[A-Za-z0-9+/=]{16,}+)*+))", 1),
        Rule("github", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1),
        Rule("slack", r"(xox[abprs]-[A-Za-z0-9-]{10,})", 1),
        Rule("jwt", r"(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 1),
    ),
}
#: What a PEM key may have between its characters: breaks, also escaped ones, and marks of quoting.
_BREAK = r"""[\s\\>#*|"',]*+"""
_KEY = "[A-Za-z0-9+/=]"
#: From BEGIN to the END of the same label; without one, the legacy headers and
#: the base64 block: long runs and lines of nothing else, and one last short run.
#: Possessive, so that long texts are no recursion.
_PEM = (
    r"(-----BEGIN ([A-Z ]{0,40})PRIVATE KEY-----(?:"
    r"(?:[^-]|-(?!----))*+-----END \2PRIVATE KEY-----|"
    rf"(?:{_BREAK}(?:Proc-Type:\x20*+[0-9],[A-Z-]++|DEK-Info:\x20*+[A-Z0-9-]++,[0-9A-Fa-f]++))*+"
    rf"(?:{_BREAK}(?:{_KEY}{{16,}}+|{_KEY}++(?=[\x20\t]*+(?:[\r\n\\]|\z))))*+"
    rf"(?:(?<={_KEY}{{16}}){_BREAK}{_KEY}++)?))"
)
#: What redaction blanks. PEM goes first, as other rules would break up a key's
#: header and body, and with a more generous idea of where a cut key ends.
WHOLE_RULES: dict[str, tuple[Rule, ...]] = {
    "whole-pem-1": (Rule("pem", _PEM, 1),),
    "base-1": RULES["base-1"],
    "whole-1": (
        Rule("github", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1),
        Rule("slack", r"(xox[abprs]-[A-Za-z0-9-]{10,})", 1),
        *(r for r in RULES["issued-2"] if r.kind == "jwt"),
    ),
}
SCANNED = "blob string, rule_version string"
FOUND = "blob string, rule_version string, kind string, start long, end long"


class Ledger:
    """Two Parquet tables under ``folder``: scanned pairs and findings.
    Findings are appended before their pairs, and both are read as sets, so a
    scan that dies half-way is simply done again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            fields = (f.split() for f in schema.split(", "))
            return self.spark.range(0).select(*(F.lit(None).cast(kind).alias(c) for c, kind in fields))  # local rows would start Python workers
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").distinct()

    def scanned(self) -> DataFrame:
        return self._table("scanned", SCANNED)

    def findings(self) -> DataFrame:
        return self._table("findings", FOUND)

    def scan(self, texts: DataFrame, rules: dict[str, tuple[Rule, ...]] | None = None, text: str = "text") -> None:
        """Scan what the ledger lacks of the distinct texts under each rule version."""
        rules = RULES if rules is None else rules
        blobs = texts.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
        seen = self.scanned()
        if not seen.isEmpty():
            seen = seen.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
            blobs = blobs.join(seen, "blob", "left")
        else:
            blobs = blobs.withColumn("seen", F.lit(None).cast("array<string>"))
        versions = F.array(*map(F.lit, rules))
        todo = blobs.withColumn("todo", F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>"))))
        todo = stage(
            todo.select("blob", "todo", matches("text", F.col("todo"), rules).alias("found")).where(F.size("todo") > 0), "blobs"
        )
        rows = todo.select("blob", F.inline("found"))
        run = Window.partitionBy("blob", "rule_version", "kind").orderBy("pos")
        end = F.sum(F.col("gap") + F.col("size")).over(run)
        spans = rows.select("blob", "rule_version", "kind", (end - F.col("size")).alias("start"), end.alias("end"), "valid")
        spans.where("valid").drop("valid").write.mode("append").parquet(f"{self.folder}/findings")
        todo.select("blob", F.explode("todo").alias("rule_version")).write.mode("append").parquet(f"{self.folder}/scanned")


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _match(version: str, rule: Rule):
    return lambda p, i: F.struct(
        F.lit(version).alias("rule_version"), F.lit(rule.kind).alias("kind"), i.alias("pos"),
        p["gap"].cast("long").alias("gap"), p["size"].cast("long").alias("size"), (p["value"] >= rule.least).alias("valid"),
    )


def _rewrite(rule: Rule):
    mark = F.lit(f"[REDACTED:{rule.kind}]")
    return lambda p: F.concat(p["gap"], F.coalesce(F.when(F.char_length(p["value"]) >= rule.least, mark), p["whole"], F.lit("")))


def matches(text: str, todo: Column, rules: dict[str, tuple[Rule, ...]]) -> Column:
    """Array of (rule_version, kind, pos, gap, size, valid) of all matches: the
    characters between a match and the one before, and its own. Gaps and
    matches come from the same pattern, so their running sum is the position."""
    parts = []
    for version, own in rules.items():
        for rule in own:
            whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
            value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
            gaps = F.split(text, rule.pattern, -1)
            pairs = F.arrays_zip(
                F.transform(gaps, lambda g: F.char_length(g)).alias("gap"),
                F.transform(whole, lambda m: F.char_length(m)).alias("size"),
                F.transform(value, lambda v: F.char_length(v)).alias("value"),
            )
            found = F.transform(F.filter(pairs, lambda p: p["size"].isNotNull()), _match(version, rule))
            none = F.array().cast("array<struct<rule_version:string,kind:string,pos:int,gap:bigint,size:bigint,valid:boolean>>")
            parts.append(F.when(F.array_contains(todo, version) & F.col(text).rlike(rule.pattern), found).otherwise(none))
    return F.concat(*parts)


def scan_versions(versions: DataFrame, ledger: Ledger, *, keys: Sequence[str] = ("doc_id",), text: str = "text",
                  rules: dict[str, tuple[Rule, ...]] | None = None) -> DataFrame:
    """One row per input row: keys, blob and findings (array of start, order,
    kind, end; sorted), after scanning what the ledger lacks.

    Positions are code points, ends exclusive. Null and empty text are one
    blob without findings. Null keys and repeated rows: each row gets its
    blob's findings. Empty table: empty result. Other columns are not looked
    at. Findings are collected per blob, so a list is no longer than its text;
    a blob that very many rows share is scanned once, and its rows meet one
    findings row in a join whose skewed partitions Spark splits.
    """
    rules = RULES if rules is None else rules
    ledger.scan(versions, rules, text)
    order = {r.kind: i for i, r in enumerate(r for own in rules.values() for r in own)}
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in order.items() for x in kv)), F.col("kind"))
    found = ledger.findings().where(F.col("rule_version").isin(*rules)).groupBy(F.col("blob").alias("b")).agg(
        F.sort_array(F.collect_list(F.struct("start", rank.alias("order"), "kind", "end"))).alias("findings")
    )
    held = versions.select(*keys, blob_of(F.col(text)).alias("blob"))
    none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
    return held.join(found, F.col("blob") == F.col("b"), "left").select(*keys, "blob", F.coalesce("findings", none).alias("findings"))


def spans_text(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def redacted(docs: DataFrame, ledger: Ledger, *, text: str = "text", rules: dict[str, tuple[Rule, ...]] | None = None) -> DataFrame:
    """The rows of ``docs``, in which every secret found is replaced by
    ``[REDACTED:kind]``, rule by rule; n_chars follows. Texts without findings
    stay as they are. Without ``rules``, those of whole secrets."""
    rules = WHOLE_RULES if rules is None else rules
    ledger.scan(docs, rules, text)
    blob, hit, body = (fresh(docs, c) for c in ("secret_blob", "secret_hit", "secret_body"))
    found = ledger.findings().where(F.col("rule_version").isin(*rules)).select(F.col("blob").alias(hit)).distinct()
    out = docs.withColumn(blob, blob_of(F.col(text))).join(found, F.col(blob) == F.col(hit), "left")
    out = out.withColumn(body, F.when(F.col(hit).isNotNull(), F.col(text)))
    for rule in (r for own in rules.values() for r in own):
        pairs = F.arrays_zip(
            F.split(body, rule.pattern, -1).alias("gap"),
            F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(0)).alias("whole"),
            F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(rule.group)).alias("value"),
        )
        # most texts hold no match of a rule: they skip the rewriting
        rewritten = F.array_join(F.transform(pairs, _rewrite(rule)), "")
        out = out.withColumn(body, F.when(F.col(body).rlike(rule.pattern), rewritten).otherwise(F.col(body)))
    new = {text: F.coalesce(F.col(body), F.col(text))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(body).isNotNull(), F.char_length(body)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))
