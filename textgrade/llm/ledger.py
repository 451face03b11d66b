"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger, a Parquet table, holds one
row for each (blob, rule, rule version) ever scanned with the spans found. A run scans only the pairs it lacks, each
blob once however many paths hold it, adds them, and joins the findings back to all paths.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from textgrade.llm.common import broadcast_if_small, same
from textgrade.sources.settled import settle, shared_folder


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    name: str
    pattern: str
    group: int
    least: int
    version: int = 1


# What counts as a secret. Runs of one class are maximal, so their least length can stand in the pattern.
RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)

#: For dropping documents: of hex runs only those with a letter, as bare numbers are seldom secrets.
SURE_RULES = (*RULES[:2], Rule("hex", r"(?<![0-9a-f])(?=[0-9]*[a-f])[0-9a-f]{16,}", 0, 16))


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def new_ledger(spark: SparkSession) -> str:
    """A place for a fresh ledger in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"


def _read(spark: SparkSession, ledger: str) -> DataFrame | None:
    try:
        return spark.read.parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _matches(text: Column, rule: Rule) -> Column:
    """Of each match: the characters between it and the one before, its own, and whether it counts."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    good = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda v: F.length(v) >= rule.least)
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), good.alias("good"))
    fields = F.transform(
        zipped, lambda m: F.struct(m["gap"].alias("gap"), m["hit"].alias("hit"), m["good"].alias("good"))
    )
    return F.when(text.rlike(rule.pattern), fields)


def scan_texts(texts: DataFrame, rules=RULES) -> DataFrame:
    """``blob``, ``rule`` and ``spans`` (sorted structs of start and end) of texts ``(blob, text, rules)``.

    ``rules`` names the rules to apply to the row. Only pairs with findings are returned. Ends are exclusive and
    offsets count code points.
    """
    found = [
        F.struct(
            F.lit(rule.name).alias("rule"),
            F.when(F.array_contains("rules", rule.name), _matches(F.col("text"), rule)).alias("matches"),
        )
        for rule in rules
    ]
    pairs = (
        texts.select("blob", F.explode(F.array(*found)).alias("f"))
        .select("blob", "f.rule", "f.matches")
        .where("matches is not null")
        .groupBy("blob", "rule")
        .agg(F.first("matches").alias("matches"))
    )
    each = pairs.select("blob", "rule", F.posexplode("matches").alias("at", "m"))
    so_far = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum((F.col("m.gap") + F.col("m.hit")).cast("long")).over(so_far))
    return (
        placed.where("m.good")
        .groupBy("blob", "rule")
        .agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("m.hit")).alias("start"), "end"))).alias("spans"))
    )


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, rules=RULES
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``blob`` and ``spans``, an array of (start, kind number, end, rule), sorted.

    ``ledger`` is the path of the ledger to go on with; without it a fresh one is made. A null text counts as empty.
    Rows that repeat an id or a text each get their findings. An empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    ledger = ledger or new_ledger(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = source.withColumn("blob", blob_of(F.col("text")))
    versions = settle(texts.select("doc_id", "blob"))
    blobs = versions.groupBy("blob").agg(F.min("doc_id").alias("pick"))
    names = F.array(*[F.lit(r.name) for r in rules])
    current = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.version)])
    past = _read(spark, ledger)
    if past is None:
        todo = settle(blobs.withColumn("rules", names))
        # nearly every text is to be scanned: leave out the copies, so that texts stay where they are
        chosen = todo.select(F.col("blob").alias("b"), F.col("pick").alias("p"))
        copies = settle(
            versions.join(chosen, same(F.col("blob"), F.col("b")) & same(F.col("doc_id"), F.col("p")), "left_anti").distinct()
        ).select(F.col("blob").alias("b"), F.col("doc_id").alias("p"))
        on = same(F.col("blob"), F.col("b")) & same(F.col("doc_id"), F.col("p"))
        unseen = texts.join(broadcast_if_small(copies), on, "left_anti").withColumn("rules", names)
    else:
        known = past.where(F.col("version") == current[F.col("rule")]).select("blob", "rule").distinct()
        pairs = blobs.select("blob", "pick", F.explode(names).alias("rule")).join(known, ["blob", "rule"], "left_anti")
        todo = settle(pairs.groupBy("blob", "pick").agg(F.collect_set("rule").alias("rules")))
        wanted = todo.select(F.col("blob").alias("b"), F.col("pick").alias("p"), "rules")
        on = same(F.col("blob"), F.col("b")) & same(F.col("doc_id"), F.col("p"))
        unseen = texts.join(broadcast_if_small(wanted), on)
    found = settle(scan_texts(unseen.select("blob", "text", "rules"), rules))
    hits = found.select(F.col("blob").alias("b"), F.col("rule").alias("r"), "spans")
    entries = todo.select("blob", F.explode("rules").alias("rule")).join(
        broadcast_if_small(hits), (F.col("blob") == F.col("b")) & (F.col("rule") == F.col("r")), "left"
    )
    entries.select(
        "blob",
        "rule",
        current[F.col("rule")].alias("version"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
    ).write.mode("append").parquet(ledger)

    kind = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
    seen = (
        spark.read.parquet(ledger)
        .where((F.size("spans") > 0) & (F.col("version") == current[F.col("rule")]))
        .select("blob", "rule", F.explode("spans").alias("s"))
        .select("blob", F.struct("s.start", kind[F.col("rule")].alias("kind"), "s.end", "rule").alias("span"))
    )
    per_blob = settle(
        seen.groupBy(F.col("blob").alias("b")).agg(F.sort_array(F.collect_set("span")).alias("spans"))
    )
    none = F.array().cast(per_blob.schema["spans"].dataType)
    return versions.join(broadcast_if_small(per_blob), F.col("blob") == F.col("b"), "left").select(
        "doc_id", "blob", F.coalesce("spans", none).alias("spans")
    )


def span_digest(found: DataFrame, rules=RULES) -> DataFrame:
    """Counts for each rule, ``spans`` as text and its SHA-256, for rows of :func:`scan_secrets`."""

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] < len(RULES))
    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == name)).cast("long").alias(f"n_{name}")

    return found.select(
        "doc_id",
        *[count(r.name) for r in rules],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def without_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=SURE_RULES, **how) -> DataFrame:
    """The rows of ``docs`` whose texts hold no finding of ``rules``. Columns are those of ``docs``; texts are not shuffled."""
    found = scan_secrets(docs, id_col, text_col, rules=rules, **how)
    bad = settle(found.where(F.size("spans") > 0).select(F.col("doc_id").alias("_bad_id"), F.col("blob").alias("_bad_blob")).distinct())
    on = same(docs[id_col], F.col("_bad_id")) & (blob_of(docs[text_col]) == F.col("_bad_blob"))
    return docs.join(broadcast_if_small(bad), on, "left_anti")
