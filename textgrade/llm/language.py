"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the likelihood of the text under letter trigram models, how likely a language
is declared as it is (in markup or metadata), how likely its pages have the address suffix, and the prior of the host.
The models are fitted on a bounded sample of declared rows. The other three come from counts over all rows by grouped
aggregation; host priors are smoothed towards their domain's, and those towards the whole collection's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from textgrade.llm.common import broadcast_if_small, same
from textgrade.sources.settled import settle, settle_texts

#: Rows for each declared language that the models are fitted on. Every declared value is a language, the most common
#: ones if there are more than LANGUAGES; so the models have at most 64 MB.
FIT_ROWS, LANGUAGES = 2000, 1024
BUCKETS = 1 << 14
#: Letters that a prior counts as, weight of overlapping trigrams, and the posterior below which a text is rejected.
STRENGTH, OVERLAP, THRESHOLD = 20.0, 1 / 3, 0.5
#: How likely a text is in none of the languages before it is read.
BACKGROUND = 0.01
#: A language whose text is less likely by so many nats than the best one's is out: what is declared, suffix and host
#: together cannot make up for it in a table of less than 10^15 rows.
MARGIN = 200.0
_STEP = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the letter trigrams of the text in lower case; one non-letter stands for any run of them."""
    text = text.lower()
    for low in range(0, len(text), _STEP):
        piece = f" {text[max(low - 2, 0) : low + _STEP]} "
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        table = _letters()
        letter = (codes >= len(table)) | table[np.minimum(codes, len(table) - 1)]
        codes = np.where(letter, codes, 0)
        keep = letter | np.concatenate(([True], letter[:-1]))
        codes = codes[keep]
        if len(codes) < 3:
            continue
        mixed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed + codes[2:] * np.uint64(0x165667B19E3779F9)) ^ (codes[1:-1] << np.uint64(29))
        mixed = mixed[codes[1:-1] > 0] * np.uint64(0xD6E8FEB86659FD93)
        yield (mixed >> np.uint64(50)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        # one text at a time as a Python string, whatever the size of the batch
        for name, text in zip(batch.column("declared"), batch.column("text"), strict=True):
            total = totals.setdefault(name.as_py(), np.zeros(BUCKETS, dtype=np.int64))
            for part in trigrams(text.as_py()):
                total += np.bincount(part, minlength=BUCKETS)
    for name, total in totals.items():
        used = np.flatnonzero(total)
        columns = [pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])]
        yield pa.RecordBatch.from_arrays(columns, names=["declared", "bucket", "n"])


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities by bucket, from rows ``(doc_id, text, declared)``.

    At most ``fit_rows`` rows of each language are fitted, those with the smallest hashes of id and text.
    """
    labelled = rows.where("declared is not null and text is not null")
    shares = labelled.groupBy(F.col("declared").alias("of")).agg(F.count(F.lit(1)).alias("rows"))
    shares = settle(shares.orderBy(F.desc("rows"), "of").limit(languages))
    names = sorted(r["of"] for r in shares.select("of").collect())
    if not names:
        return [], np.zeros((BUCKETS, 0))
    drawn = labelled.withColumn("draw", F.xxhash64("doc_id", "text")).join(F.broadcast(shares), F.col("declared") == F.col("of"))
    # hashes are uniform: of a common language only the lowest part of their range is put in order
    low = drawn.where(F.col("draw") / 2.0**64 + 0.5 <= (2 * fit_rows + 100) / F.col("rows"))
    order = Window.partitionBy("declared").orderBy("draw")
    first = low.select("declared", "draw").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= fit_rows)
    cuts = settle(first.groupBy(F.col("declared").alias("_of")).agg(F.max("draw").alias("cut")))
    within = (F.col("declared") == F.col("_of")) & (F.col("draw") <= F.col("cut"))
    sample = low.join(F.broadcast(cuts), within, "left_semi").dropDuplicates(["declared", "draw"])
    counts = sample.select("declared", "text").mapInArrow(_counted, "declared string, bucket int, n long")
    table = np.full((BUCKETS, len(names)), 0.5, dtype=np.float32)
    place = {n: k for k, n in enumerate(names)}
    found = counts.groupBy("declared", "bucket").agg(F.sum("n").alias("n")).toArrow()
    columns = [place[n] for n in found.column("declared").to_pylist()]
    table[found.column("bucket").to_numpy(), np.array(columns, dtype=int)] += found.column("n").to_numpy()
    table /= table.sum(axis=0, dtype=np.float64).astype(np.float32)
    return names, np.log(table, out=table)


_SCORED = "declared string, host string, domain string, suffix string, letters long, own int, sure boolean, foreign double, ks array<int>, logs array<double>"


def _scored(weights, background: float):
    """Adds what the text says: the likeliest language, whether that is sure, how likely it is none, and the logarithms of those in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        several = table.shape[1]
        for batch in batches:
            rows = {name: [] for name in ("letters", "own", "sure", "foreign", "ks", "logs")}
            for text in batch.column("text"):
                total, n = np.zeros(several), 0
                for part in trigrams(text.as_py() or ""):
                    buckets, times = np.unique(part, return_counts=True)
                    total += times @ table[buckets].astype(np.float64)
                    n += len(part)
                total *= OVERLAP
                own, foreign, p = None, None, 0.0
                if several:
                    own = int(total.argmax())
                    odds = np.exp(total - total[own])
                    p = 1 / odds.sum()
                    flat = -n * np.log(BUCKETS) * OVERLAP + np.log(background / (1 - background) * several)
                    most = max(flat, total[own])
                    none = np.exp(flat - most)
                    foreign = none / (none + np.exp(total - most).sum())
                near = np.flatnonzero(total >= total.max() - MARGIN) if several else []
                rows["letters"].append(n)
                rows["own"].append(own)
                rows["sure"].append(bool(n and p >= 0.9 and foreign < 0.5))
                rows["foreign"].append(foreign)
                rows["ks"].append(near)
                rows["logs"].append(total[near] if several else [])
            kinds = {"letters": pa.int64(), "own": pa.int32(), "sure": pa.bool_(), "foreign": pa.float64(), "ks": pa.list_(pa.int32()), "logs": pa.list_(pa.float64())}
            given = ["doc_id", "declared", "host", "domain", "suffix"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in given], *[pa.array(rows[c], kind) for c, kind in kinds.items()]], names=[*given, *kinds]
            )

    return run


def host_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, domain (its last two labels) and suffix (the last) of an address, or of a bare host name."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), url))
    labels = F.split(host, r"\.")
    dotted = F.size(labels) > 1
    domain = F.when(dotted, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)
    return host, domain, F.when(dotted, F.element_at(labels, -1))


_COUNTS = "array<struct<k:int,n:bigint>>"


def _counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``counts``: of every value how many rows are surely in which language, without the languages of none."""
    k = F.when(F.col("sure"), F.col("own")).alias("k")
    by_language = rows.where(F.col(keys[0]).isNotNull()).groupBy(*keys, k).agg(F.count(F.lit(1)).alias("n"))
    one = F.when(F.col("k").isNotNull(), F.struct("k", "n"))
    return by_language.groupBy(*keys).agg(F.collect_list(one).cast(_COUNTS).alias("counts"))


def _totals(table: DataFrame, several: int) -> tuple[np.ndarray, int]:
    """Rows of each language over all values, and the number of values."""
    totals = np.zeros(several)
    for r in table.select(F.explode("counts").alias("c")).groupBy("c.k").agg(F.sum("c.n").alias("n")).collect():
        totals[r["k"]] = r["n"]
    return totals, table.count()


def _dense(counts: list[dict] | None, several: int) -> np.ndarray:
    out = np.zeros(several)
    for c in counts or ():
        out[c["k"]] = c["n"]
    return out


def host_log_prior(host: np.ndarray, domain: np.ndarray, everywhere: np.ndarray, strength: float) -> np.ndarray:
    """Log prior of the languages on a host: its counts smoothed by its domain's, and those by all hosts'."""
    base = (everywhere + 1) / (everywhere + 1).sum()
    of_domain = (domain + strength * base) / (domain.sum() + strength)
    return np.log((host + strength * of_domain) / (host.sum() + strength))


def log_likelihood(value: np.ndarray, totals: np.ndarray, values: int) -> np.ndarray:
    """Log probability of a declaration or suffix in each language, one row added to each of its values."""
    return np.log((value + 1) / (totals + max(values, 1)))


_FUSED = "language string, confidence double, text_language string, declared string, letters long, kept boolean"


def _fused(facts):
    """The posterior of the languages in reach from all evidence; evidence is worked out once for each value in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, everywhere, declared, suffix, strength, threshold = facts.value
        several = len(names)
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            keys = {c: column[c].to_pylist() for c in ("host", "declared", "suffix")}
            known: dict[str, dict] = {c: {None: np.zeros(several)} for c in keys}

            def evidence(kind: str, row: int) -> np.ndarray:
                key = keys[kind][row]
                if key not in known[kind]:
                    own = _dense(column[f"{kind}_counts"][row].as_py(), several)
                    if kind == "host":
                        wider = _dense(column["domain_counts"][row].as_py(), several)
                        known[kind][key] = host_log_prior(own, wider, everywhere, strength)
                    else:
                        known[kind][key] = log_likelihood(own, *(declared if kind == "declared" else suffix))
                return known[kind][key]

            out = {c: [] for c in ("language", "confidence", "text_language", "kept")}
            letters = column["letters"].to_pylist()
            for row, (n, own, foreign) in enumerate(zip(letters, column["own"].to_pylist(), column["foreign"].to_pylist(), strict=True)):
                ks = column["ks"][row].values.to_numpy()
                logs = column["logs"][row].values.to_numpy() + sum(evidence(c, row)[ks] for c in keys)
                best = int(logs.argmax())
                p = float(1 / np.exp(logs - logs[best]).sum()) * (1 - foreign if n else 1.0)
                out["language"].append(names[ks[best]])
                out["confidence"].append(p)
                out["text_language"].append(names[own] if n else None)
                out["kept"].append(bool(n and p >= threshold))
            yield pa.RecordBatch.from_arrays(
                [
                    column["doc_id"], pa.array(out["language"], pa.string()), pa.array(out["confidence"], pa.float64()),
                    pa.array(out["text_language"], pa.string()), column["declared"], column["letters"], pa.array(out["kept"], pa.bool_()),
                ],
                names=["doc_id", "language", "confidence", "text_language", "declared", "letters", "kept"],
            )

    return run


def identify_language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str | None = "lang",
    address_col: str | None = "source",
    fit_rows: int = FIT_ROWS,
    strength: float = STRENGTH,
    threshold: float = THRESHOLD,
    languages: int = LANGUAGES,
    background: float = BACKGROUND,
) -> DataFrame:
    """Per row: ``doc_id, language, confidence, text_language, declared, letters, kept``.

    The address is a URL or a bare host name. Every declared value is a language, whatever else the table holds, in lower case and
    without a region behind ``-`` or ``_``; beyond ``languages`` values the most common ones are, and other declarations
    speak for none of their own. The confidence is the posterior of the language among them, times the
    probability that the text is in one of them at all and not from a background model, in which all trigrams are
    equally likely. A row is kept if its text has letters and the confidence reaches ``threshold``; what is declared or
    where it comes from never rejects a text by itself. Null or letterless texts have no text language; the other evidence
    still names one. Null declarations and addresses are no evidence. Without any declared row the language is null
    and every text with letters is kept. Repeated rows are each judged; an empty table gives an empty result; other
    columns are ignored.
    """
    nothing = F.lit(None).cast("string")
    address = nothing if address_col is None else F.col(address_col).cast("string")
    host, domain, suffix = host_parts(address)
    said = nothing if declared_col is None else F.lower(F.trim(F.col(declared_col).cast("string")))
    said = F.regexp_replace(said, "[-_].*$", "")
    source = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.when(said != "", said).alias("declared"),
        host.alias("host"),
        domain.alias("domain"),
        suffix.alias("suffix"),
    )
    context = docs.sparkSession.sparkContext
    names, table = fit(source.select("doc_id", "text", "declared"), fit_rows, languages)
    kind = source.schema["doc_id"].dataType.simpleString()
    scored = settle_texts(source.mapInArrow(_scored(context.broadcast(table), background), f"doc_id {kind}, {_SCORED}"))
    if not names:
        return scored.select(
            "doc_id", nothing.alias("language"), F.lit(None).cast("double").alias("confidence"), nothing.alias("text_language"),
            "declared", "letters", (F.col("letters") > 0).alias("kept"),
        )
    hosts = settle(_counts(scored, ["host", "domain"]))
    in_domain = F.explode_outer("counts").alias("c")
    domains = hosts.select("domain", in_domain).groupBy("domain", "c.k").agg(F.sum("c.n").alias("n"))
    one = F.when(F.col("k").isNotNull(), F.struct("k", "n"))
    domains = settle(domains.groupBy(F.col("domain").alias("of")).agg(F.collect_list(one).cast(_COUNTS).alias("domain_counts")))
    of_hosts = settle(
        hosts.join(broadcast_if_small(domains), same(F.col("domain"), F.col("of"))).select(
            F.col("host").alias("host_k"), F.col("counts").alias("host_counts"), "domain_counts"
        )
    )
    everywhere, _ = _totals(hosts, len(names))
    facts, fused = [], scored.join(broadcast_if_small(of_hosts), F.col("host") == F.col("host_k"), "left")
    for key in ("declared", "suffix"):
        values = settle(_counts(scored, [key]).select(F.col(key).alias(f"{key}_k"), F.col("counts").alias(f"{key}_counts")))
        facts.append(_totals(values.select(F.col(f"{key}_counts").alias("counts")), len(names)))
        fused = fused.join(broadcast_if_small(values), F.col(key) == F.col(f"{key}_k"), "left")
    shared = context.broadcast((names, everywhere, *facts, strength, threshold))
    given = ["doc_id", "declared", "host", "suffix", "letters", "own", "foreign", "ks", "logs"]
    given += ["host_counts", "domain_counts", "declared_counts", "suffix_counts"]
    return fused.select(*given).mapInArrow(_fused(shared), f"doc_id {kind}, {_FUSED}")


def in_a_language(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that are not rejected. Columns are those of ``docs``; texts are not shuffled.

    An id that some row of it keeps is kept with all its rows; of rows without an id those with letters stay.
    """
    found = identify_language(docs, id_col, **how)
    judged = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    rejected = settle(judged.where("not kept").select(F.col("doc_id").alias("_rejected")))
    kept = docs.join(broadcast_if_small(rejected), docs[id_col] == F.col("_rejected"), "left_anti")
    text = F.coalesce(docs[how.get("text_col", "text")].cast("string"), F.lit(""))
    return kept.where(docs[id_col].isNotNull() | text.rlike(r"\p{L}"))
