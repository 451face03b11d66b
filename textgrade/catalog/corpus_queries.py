"""Queries over sources, sinks, contract checks, filters, text functions and windowing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from textgrade.catalog import sql, views
from textgrade.catalog.registry import query, r6, rounded
from textgrade.functions.numbers import as_number, clip
from textgrade.functions.text import (
    difficulty_proxy,
    evenly_spaced,
    normal_form,
    paragraphs,
    strip,
    token_count,
    window_text,
    word_slice,
)
from textgrade.operators.metrics import value_counts
from textgrade.operators.quality import dedup_against, drop_repeats, filter_corpus, keep_in_band
from textgrade.operators.ranks import percentile_within_corpus
from textgrade.operators.splits import group_id
from textgrade.plans.corpus import build_external_pool, prepare_corpus, union_corpora
from textgrade.plans.labelling import gold_rows
from textgrade.schema import canonical, coerce, validate, with_defaults
from textgrade.sources.corpora import (
    decode_text,
    excerpt_rows,
    fetch_texts,
    level_tree_to_canonical,
    load_levelled_csv,
    load_wide_corpus,
    levelled_to_canonical,
    read_wide_corpus,
    repair_columns,
    wide_to_canonical,
)
from textgrade.sources.settled import settle, shared_folder
from textgrade.sources.tables import read_table, write_result, write_table
from textgrade.streaming.ingest import ingest_pool, read_pool


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


PROFILE = """SELECT corpus, count(*)::BIGINT AS n, sum(length_tokens)::BIGINT AS tokens,
  sum(length(text))::BIGINT AS chars, count(native_label) AS labelled FROM canon GROUP BY corpus"""


def _profile(df: DataFrame) -> DataFrame:
    return df.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("length_tokens").alias("tokens"),
        F.sum(F.length("text")).alias("chars"),
        F.count("native_label").alias("labelled"),
    )


@query(
    "corpus_difficulty_by_language",
    f"""WITH {sql.canonical('source')},
    kept AS {sql.filtered('canon', 3, 600, "'en','de','es','fr'")},
    ranked AS (SELECT language, CASE WHEN language = 'en' THEN 1 - r / n ELSE r / n END AS d FROM (
      SELECT language, {sql.avg_rank('native_label', 'language')} AS r,
             count(*) OVER (PARTITION BY language) AS n FROM kept))
    SELECT language, count(*)::BIGINT AS n, round(avg(d), 6) AS mean_difficulty FROM ranked GROUP BY language""",
)
def corpus_difficulty(spark, sf_dir):
    """Documents to canonical rows, filtered, ranked inside their language: count and mean."""
    kept = filter_corpus(views.canonical_docs(spark, sf_dir), languages=("en", "de", "es", "fr"))
    narrow = settle(kept.select("id", "native_label", "language"))
    ranked = percentile_within_corpus(
        narrow, corpus_col="language", polarity=views.POLARITY_BY_LANG
    )
    return ranked.groupBy("language").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("harmonized_difficulty")).alias("mean_difficulty")
    )


@query("s1_read_parquet_table", f"WITH {sql.canonical(label='quality')} {PROFILE}")
def read_parquet_table(spark, sf_dir):
    path = _place(spark, "table")
    write_table(views.canonical_docs(spark, sf_dir, label="quality"), path)
    return _profile(read_table(spark, path))


@query("s1_read_csv_table", f"WITH {sql.canonical(label='quality')} {PROFILE}")
def read_csv_table(spark, sf_dir):
    path = _place(spark, "table") + ".csv"
    write_table(views.canonical_docs(spark, sf_dir, label="quality"), path, fmt="csv")
    return _profile(read_table(spark, path))


def _wide(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    return docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 9 != 0, F.concat(F.col("doc_id"), F.lit(".0"))).alias("ID"),
        F.col("text").alias("Excerpt"),
        F.when(F.col("doc_id") % 11 == 0, "n/a").otherwise(F.concat(F.lit("-"), F.col("n_chars"))).alias("BT_easiness"),
        F.when(F.col("doc_id") % 7 != 0, "0.5").alias("s.e."),
        F.element_at(F.array(F.lit("Lit"), F.lit("INFO"), F.lit("misc"), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int")).alias("Categ"),
    )


WIDE = """SELECT CASE WHEN doc_id % 9 <> 0 THEN 'clear:' || doc_id ELSE 'clear:row' || doc_id END AS id,
  CASE WHEN doc_id % 11 <> 0 THEN -n_chars::DOUBLE END AS native_label,
  CASE WHEN doc_id % 7 <> 0 THEN 0.5::DOUBLE END AS std_error,
  CASE doc_id % 4 WHEN 0 THEN 'literary' WHEN 1 THEN 'informational' ELSE 'unknown' END AS domain,
  'unknown' AS license, 'clear_bt_easiness' AS native_scale, md5(text) AS text_md5 FROM documents"""


@query(
    "s2_read_wide_with_aliases",
    """SELECT count(CASE WHEN doc_id % 11 <> 0 THEN 1 END)::BIGINT AS labels,
      count(CASE WHEN doc_id % 7 <> 0 THEN 1 END)::BIGINT AS errors,
      count(CASE WHEN doc_id % 4 <> 3 THEN 1 END)::BIGINT AS categories FROM documents""",
)
def read_wide_with_aliases(spark, sf_dir):
    path = _place(spark, "wide")
    write_result(_wide(spark, sf_dir), path, fmt="csv")
    wide = read_wide_corpus(spark, path)
    return wide.agg(
        F.count(as_number(F.col("BT Easiness"))).alias("labels"),
        F.count(F.expr("`BT s.e.`")).alias("errors"),
        F.count("Category").alias("categories"),
    )


@query("s3_wide_to_canonical", WIDE)
def wide_canonical(spark, sf_dir):
    rows = wide_to_canonical(repair_columns(_wide(spark, sf_dir)), "doc_id")
    return rows.select(
        "id", "native_label", "std_error", "domain", "license", "native_scale", F.md5("text").alias("text_md5")
    )


@query("s3_wide_file", WIDE.replace("doc_id % 9 <> 0", "true"))
def wide_file(spark, sf_dir):
    """The wide corpus through a CSV file with the odd column names."""
    path = _place(spark, "wide")
    wide = _wide(spark, sf_dir).withColumn("ID", F.concat("doc_id", F.lit(".0")))
    write_result(wide, path, fmt="csv")
    return load_wide_corpus(spark, path).select(
        "id", "native_label", "std_error", "domain", "license", "native_scale", F.md5("text").alias("text_md5")
    )


@query(
    "s4_level_tree",
    f"""WITH named AS (
      SELECT 'a-' || doc_id || '-' || ['ele', 'int', 'adv'][doc_id % 3 + 1] AS k, doc_id % 3 AS level,
        replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents WHERE doc_id % 7 <> 0),
    {sql.chunks('named')}
    SELECT 'onestop:' || regexp_replace(c.k, '-([a-z]+)$', ':\\1') || ':' || chunk AS id, level::DOUBLE AS native_label,
      'onestop_level' AS native_scale, md5(c.text) AS text_md5 FROM chunks c JOIN named n USING (k)""",
)
def level_tree(spark, sf_dir):
    """Documents as files of a level tree: some names in two folders, some files outside of the tree."""
    d = F.col("doc_id")
    level = F.element_at(F.array(F.lit("ele"), F.lit("int"), F.lit("adv")), (d % 3 + 1).cast("int"))
    folder = F.when(d % 7 == 0, "/data/other").otherwise("/data/Texts-SeparatedByReadingLevel")
    files = views.paragraph_docs(spark, sf_dir).select(
        "doc_id",
        F.concat(folder, F.lit("/b/a-"), d, F.lit("-"), level, F.lit(".txt")).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    )
    twice = files.where(d % 5 == 0).select(
        F.replace("path", F.lit("/b/"), F.lit("/c/")).alias("path"), F.encode(F.lit("later path"), "UTF-8").alias("content")
    )
    rows = level_tree_to_canonical(files.select("path", "content").unionByName(twice))
    return rows.select("id", "native_label", "native_scale", F.md5("text").alias("text_md5"))


@query(
    "s5_decode_mixed_encodings",
    r"""SELECT doc_id, md5(regexp_replace(text, '[^\x00-\x7f]', '~', 'g')
      || CASE WHEN doc_id % 2 = 0 THEN 'é' ELSE 'è ' END) AS text_md5 FROM documents""",
)
def decode_mixed(spark, sf_dir):
    """Documents as bytes, half of them UTF-8 with a byte order mark, half Latin-1."""
    plain = F.regexp_replace("text", r"[^\x00-\x7f]", "~")
    utf8 = F.encode(F.concat(F.lit("\ufeff"), plain, F.lit("é")), "UTF-8")
    latin = F.encode(F.concat(plain, F.lit("è ")), "ISO-8859-1")
    content = F.when(F.col("doc_id") % 2 == 0, utf8).otherwise(latin)
    raw = views.documents(spark, sf_dir).select("doc_id", content.alias("content"))
    return raw.select("doc_id", F.md5(decode_text(F.col("content"))).alias("text_md5"))


LEVELS = "['A1', ' a2 ', 'b1', 'B2', 'c1', 'C2 ', 'D1']"


@query(
    "s6_levelled_texts",
    f"""WITH {sql.PARAGRAPHS}, {sql.chunks('paras')},
    named AS (SELECT *, upper(trim({LEVELS}[k % 7 + 1])) AS level FROM chunks)
    SELECT 'cefr:' || level || ':' || k || ':' || chunk AS id,
      (list_position(['A1','A2','B1','B2','C1','C2'], level) - 1)::DOUBLE AS native_label,
      {sql.tokens('text')}::BIGINT AS length_tokens FROM named WHERE level <> 'D1'""",
)
def levelled_texts(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("A1", " a2 ", "b1", "B2", "c1", "C2 ", "D1")])
    docs = views.paragraph_docs(spark, sf_dir)
    rows = docs.withColumn("label", F.element_at(names, (F.col("doc_id") % 7 + 1).cast("int")))
    return levelled_to_canonical(rows, "doc_id").select("id", "native_label", "length_tokens")


@query(
    "s6_levelled_file",
    f"""WITH {sql.PARAGRAPHS}, {sql.chunks('paras')},
    named AS (SELECT *, upper(trim({LEVELS}[k % 7 + 1])) AS level FROM chunks)
    SELECT (list_position(['A1','A2','B1','B2','C1','C2'], level) - 1)::DOUBLE AS native_label, chunk::VARCHAR AS chunk,
      md5(text) AS text_md5 FROM named WHERE level <> 'D1'""",
)
def levelled_file(spark, sf_dir):
    """The same through CSV files, whose rows are named by their places."""
    names = F.array(*[F.lit(x) for x in ("A1", " a2 ", "b1", "B2", "c1", "C2 ", "D1")])
    docs = views.paragraph_docs(spark, sf_dir)
    path = _place(spark, "levelled")
    labelled = docs.select("text", F.element_at(names, (F.col("doc_id") % 7 + 1).cast("int")).alias("label"))
    write_result(labelled, path, fmt="csv")
    return load_levelled_csv(spark, path).select(
        "native_label", F.element_at(F.split("id", ":"), -1).alias("chunk"), F.md5("text").alias("text_md5")
    )


@query(
    "s7_stream_ingest",
    f"""WITH {sql.pool(None)} SELECT id, corpus, length_tokens, md5(text) AS text_md5 FROM rows_
    WHERE length_tokens BETWEEN 50 AND 320
    QUALIFY row_number() OVER (PARTITION BY corpus, text ORDER BY split_part(id, ':', 2)::BIGINT % 3, id) = 1""",
)
def stream_ingest(spark, sf_dir):
    """A pool taken in over three arrivals. Each later one brings all earlier documents again under other numbers."""
    docs = settle(
        fetch_texts(views.free_text(spark, sf_dir), None, "doc_id").select("source", "doc_index", "domain", "text")
    )
    arrivals, pool, progress = (_place(spark, name) for name in ("arrivals", "pool", "progress"))
    turn = F.col("doc_index") % 3
    for k in range(3):
        again = docs.where(turn < k).withColumn("doc_index", F.col("doc_index") + 10**9 * k)
        docs.where(turn == k).unionByName(again).write.mode("append").parquet(arrivals)
        ingest_pool(spark, arrivals, pool, progress)
    return read_pool(spark, pool).select("id", "corpus", "length_tokens", F.md5("text").alias("text_md5"))


@query(
    "s9_fetch_first_documents",
    f"""WITH {sql.FREE}, firsts AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM free)
    SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS doc_index
    FROM firsts WHERE r <= 30 AND text <> ''""",
)
def fetch_first(spark, sf_dir):
    rows = fetch_texts(views.free_text(spark, sf_dir), 30, "doc_id")
    return rows.select("source", "doc_id", "doc_index")


@query(
    "k1_partitioned_write",
    f"""WITH {sql.canonical('lang')} SELECT id, 'unassigned' AS split, corpus, native_label, length_tokens,
    md5(text) AS text_md5 FROM canon""",
)
def partitioned_write(spark, sf_dir):
    path = _place(spark, "table")
    write_table(views.canonical_docs(spark, sf_dir, "lang"), path)
    return read_table(spark, path).select(
        "id", "split", "corpus", "native_label", "length_tokens", F.md5("text").alias("text_md5")
    )


@query(
    "k2_canonical_projection",
    f"""WITH {sql.canonical()} SELECT id, corpus, native_label, 'none' AS mapping_method, std_error, format_type,
    language, length_tokens, 'unassigned' AS split, false AS is_pseudo FROM canon""",
)
def canonical_projection(spark, sf_dir):
    wide = views.canonical_docs(spark, sf_dir).withColumn("extra", F.lit(1))
    return canonical(wide).select(
        "id", "corpus", "native_label", "mapping_method", "std_error", "format_type", "language",
        "length_tokens", "split", "is_pseudo",
    )


@query(
    "k3_write_predictions",
    f"WITH {sql.SMALL} SELECT id, round(p, 6) AS pred FROM small",
)
def write_predictions(spark, sf_dir):
    path = _place(spark, "preds")
    write_result(views.metric_small(spark, sf_dir).select("id", F.col("p").alias("pred")), path)
    return rounded(spark.read.schema("id string, pred double").parquet(path))


@query(
    "p1_rows_with_defaults",
    f"""SELECT 'docs:' || doc_id AS id, 'none' AS mapping_method, 'prose' AS format_type,
    CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS language,
    CASE WHEN doc_id % 4 = 0 THEN 7 ELSE {sql.tokens('text')} END::BIGINT AS length_tokens,
    'unassigned' AS split, false AS is_pseudo FROM documents""",
)
def rows_with_defaults(spark, sf_dir):
    docs = views.documents(spark, sf_dir).select(
        F.concat(F.lit("docs:"), F.col("doc_id")).alias("id"),
        "text",
        F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("language"),
        F.when(F.col("doc_id") % 4 == 0, F.lit(7)).alias("length_tokens"),
    )
    return with_defaults(docs).select(
        "id", "mapping_method", "format_type", "language", "length_tokens", "split", "is_pseudo"
    )


@query(
    "p2_coerce",
    """SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 5 IN (0, 1) THEN NULL ELSE n_chars / 2.0 END::DOUBLE AS native_label,
    n_chars::BIGINT AS length_tokens, coalesce(doc_id % 2 = 0 AND doc_id % 3 = 0, false) AS is_pseudo,
    NULL::VARCHAR AS split FROM documents""",
)
def coerce_messy(spark, sf_dir):
    d = F.col("doc_id")
    half = (F.col("n_chars") / F.lit(2.0)).cast("string")
    messy = views.documents(spark, sf_dir).select(
        d.alias("id"),
        "text",
        F.when(d % 5 == 0, "abc").when(d % 5 == 1, "NaN").otherwise(half).alias("native_label"),
        F.col("n_chars").cast("string").alias("length_tokens"),
        F.when(d % 2 == 0, d % 3 == 0).alias("is_pseudo"),
        F.lit("gone").alias("extra"),
    )
    return coerce(messy).select("id", "native_label", "length_tokens", "is_pseudo", "split")


@query(
    "p3_validate",
    """WITH bad AS (SELECT doc_id, CASE WHEN doc_id % 29 <> 0 THEN text END AS text,
      CASE WHEN doc_id % 17 = 0 THEN 'odd' WHEN doc_id % 19 = 0 THEN 'strange' ELSE 'train' END AS split,
      CASE WHEN doc_id % 23 = 0 THEN 2.0 ELSE 0.5 END AS h
      FROM (SELECT * FROM documents UNION ALL SELECT * FROM documents WHERE doc_id % 50 = 0))
    SELECT 'duplicate_id' AS issue, (count(*) - count(DISTINCT doc_id))::BIGINT AS n, NULL AS detail FROM bad
    UNION ALL SELECT 'null_id_or_text', count(*) FILTER (WHERE text IS NULL), NULL FROM bad
    UNION ALL SELECT 'difficulty_out_of_band', count(*) FILTER (WHERE h > 1.5), NULL FROM bad
    UNION ALL SELECT 'unknown_split', count(*), split FROM bad WHERE split <> 'train' GROUP BY split""",
)
def validate_bad(spark, sf_dir):
    docs = views.canonical_docs(spark, sf_dir)
    d = F.split("id", ":")[1].cast("long")
    twice = docs.unionByName(docs.where(d % 50 == 0))
    bad = twice.withColumns(
        {
            "text": F.when(d % 29 != 0, F.col("text")),
            "split": F.when(d % 17 == 0, "odd").when(d % 19 == 0, "strange").otherwise("train"),
            "harmonized_difficulty": F.when(d % 23 == 0, 2.0).otherwise(0.5),
        }
    )
    return validate(bad)


@query("p4_token_count", f"SELECT doc_id, {sql.tokens('text')}::BIGINT AS tokens FROM documents")
def token_counts(spark, sf_dir):
    return views.documents(spark, sf_dir).select("doc_id", token_count("text").alias("tokens"))


@query(
    "p5_row_predicates",
    f"""WITH {sql.canonical('lang', 'quality')}
    SELECT count(*) FILTER (WHERE corpus = 'en' AND native_label IS NOT NULL)::BIGINT AS gold,
      count(*) FILTER (WHERE doc_id % 3 <> 2)::BIGINT AS pool, count(*) FILTER (WHERE doc_id % 4 <> 0)::BIGINT AS human FROM canon""",
)
def row_predicates(spark, sf_dir):
    docs = views.canonical_docs(spark, sf_dir, "lang", "quality")
    d = F.split("id", ":")[1].cast("long")
    rows = docs.withColumns(
        {
            "split": F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("ood_corpus")), (d % 3 + 1).cast("int")),
            "is_pseudo": F.when(d % 4 == 0, True).when(d % 4 == 1, F.lit(None)).otherwise(False),
        }
    )
    human = ~F.coalesce(F.col("is_pseudo"), F.lit(False))
    return rows.agg(
        F.count_if((F.col("corpus") == "en") & F.col("native_label").isNotNull()).alias("gold"),
        F.count_if(F.col("split").isin("train", "val")).alias("pool"),
        F.count_if(human).alias("human"),
    )


@query(
    "p5_gold_rows",
    f"WITH {sql.canonical('lang', 'quality')} SELECT id FROM canon WHERE corpus = 'en' AND native_label IS NOT NULL",
)
def gold_predicate(spark, sf_dir):
    return gold_rows(views.canonical_docs(spark, sf_dir, "lang", "quality"), "en").select("id")


@query(
    "q1_length_and_language_filter",
    f"""WITH {sql.canonical()} SELECT id, length_tokens FROM canon WHERE {sql.strip('text')} <> ''
    AND length_tokens BETWEEN 3 AND 600 AND language IN ('en', 'de')""",
)
def length_filter(spark, sf_dir):
    docs = views.canonical_docs(spark, sf_dir)
    return keep_in_band(docs, languages=("en", "de")).select("id", "length_tokens")


@query(
    "q2_first_of_equal_texts",
    f"""WITH {sql.canonical('lang')} SELECT id, corpus, md5(text) AS text_md5 FROM canon
    QUALIFY row_number() OVER (PARTITION BY corpus, text ORDER BY id) = 1""",
)
def first_of_equal(spark, sf_dir):
    kept = drop_repeats(views.canonical_docs(spark, sf_dir, "lang"))
    return kept.select("id", "corpus", F.md5("text").alias("text_md5"))


@query("q3_normal_form", f"SELECT doc_id, md5({sql.normal('text')}) AS form FROM documents")
def normal_forms(spark, sf_dir):
    return views.documents(spark, sf_dir).select("doc_id", F.md5(normal_form("text")).alias("form"))


@query(
    "q4_drop_known_texts",
    f"""WITH own AS (SELECT 'docs:' || doc_id AS id, text FROM documents
      UNION ALL SELECT 'copy:' || doc_id, '  ' || translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || ' ' || chr(10) FROM documents WHERE doc_id % 20 = 0),
    known AS (SELECT text FROM documents WHERE doc_id % 20 = 0 UNION ALL SELECT text FROM benchmark)
    SELECT id FROM own WHERE {sql.normal('text')} NOT IN (SELECT {sql.normal('text')} FROM known)""",
)
def drop_known(spark, sf_dir):
    own, known = views.copied_docs(spark, sf_dir)
    return dedup_against(own, known).select("id")


@query(
    "w1_window_text",
    f"""WITH {sql.PARAGRAPHS}, {sql.chunks('paras')}
    SELECT k AS doc_id, chunk::BIGINT AS chunk, md5(text) AS text_md5 FROM chunks""",
)
def windows(spark, sf_dir):
    docs = views.paragraph_docs(spark, sf_dir).select("doc_id", window_text("text").alias("w"))
    rows = docs.select("doc_id", F.posexplode_outer("w").alias("chunk", "text")).where("text is not null")
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("text").alias("text_md5"))


@query(
    "w2_chunk_ids",
    f"""WITH {sql.PARAGRAPHS}, {sql.chunks('paras')}
    SELECT 'docs:' || k || ':' || lang || ':' || chunk AS id, quality::DOUBLE AS native_label
    FROM chunks JOIN documents ON k = doc_id LEFT JOIN labels USING (doc_id)""",
)
def chunk_ids(spark, sf_dir):
    labels = views.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("native_label"))
    docs = views.paragraph_docs(spark, sf_dir).join(labels, "doc_id", "left")
    rows = excerpt_rows(docs, "doc_id", "lang", "native_label")
    return rows.select(
        F.concat_ws(":", F.lit("docs"), "doc_id", "lang", "chunk").alias("id"), "native_label"
    )


@query(
    "w3_evenly_spaced_chunks",
    f"""WITH {sql.PARAGRAPHS}, {sql.chunks('paras', 60, 90, 20)}, {sql.capped(3)}
    SELECT k AS doc_id, chunk::BIGINT AS chunk, md5(text) AS text_md5 FROM capped""",
)
def spaced_chunks(spark, sf_dir):
    docs = views.paragraph_docs(spark, sf_dir).select("doc_id", window_text("text", 60, 90, 20).alias("w"))
    kept = docs.select("doc_id", evenly_spaced(F.col("w"), 3).alias("w"))
    rows = kept.select("doc_id", F.posexplode_outer("w").alias("chunk", "text")).where("text is not null")
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("text").alias("text_md5"))


def _pool_sql(limit: int | None) -> str:
    return f"""WITH {sql.pool(limit)} SELECT id, corpus, language, length_tokens, md5(text) AS text_md5,
    'unlabeled' AS split, NULL::DOUBLE AS native_label FROM pool"""


def _pool(spark, sf_dir, limit: int | None):
    pool = build_external_pool(views.free_text(spark, sf_dir), limit, "doc_id")
    return pool.select(
        "id", "corpus", "language", "length_tokens", F.md5("text").alias("text_md5"), "split", "native_label"
    )


@query("w4_external_pool", _pool_sql(30))
def external_pool(spark, sf_dir):
    return _pool(spark, sf_dir, 30)


@query("w4_external_pool_whole", _pool_sql(None))
def external_pool_whole(spark, sf_dir):
    return _pool(spark, sf_dir, None)


@query("f1_difficulty_proxy", f"SELECT doc_id, round({sql.proxy('text')}, 6) AS proxy FROM documents")
def proxies(spark, sf_dir):
    return views.documents(spark, sf_dir).select("doc_id", r6(difficulty_proxy("text")).alias("proxy"))


@query(
    "f2_strip_and_case",
    f"""SELECT doc_id, md5({sql.strip("chr(160) || text || chr(28)")}) AS stripped, md5(lower(text)) AS lowered FROM documents""",
)
def strip_and_case(spark, sf_dir):
    padded = F.concat(F.lit("\xa0"), "text", F.lit("\x1c"))
    return views.documents(spark, sf_dir).select(
        "doc_id", F.md5(strip(padded)).alias("stripped"), F.md5(F.lower("text")).alias("lowered")
    )


@query(
    "f3_blank_line_split",
    f"""WITH {sql.PARAGRAPHS} SELECT k AS doc_id,
    len(list_filter(regexp_split_to_array(text, '\\n[{sql.BLANK}]*\\n'), lambda p: {sql.strip('p')} <> ''))::BIGINT AS paragraphs FROM paras""",
)
def blank_line_split(spark, sf_dir):
    return views.paragraph_docs(spark, sf_dir).select(
        "doc_id", F.size(paragraphs("text")).cast("long").alias("paragraphs")
    )


@query(
    "f4_word_slices",
    f"""SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '[^{sql.BLANK}]+')[11:20], ' ')) AS words FROM documents""",
)
def word_slices(spark, sf_dir):
    return views.documents(spark, sf_dir).select("doc_id", F.md5(word_slice("text", 10, 10)).alias("words"))


@query(
    "f5_numeric_coercion",
    "SELECT conv_id, turn, try_cast(trim(split_part(text, ' ', 1)) AS DOUBLE) AS number FROM conversations",
)
def numeric_coercion(spark, sf_dir):
    return views.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", as_number(F.split_part("text", F.lit(" "), F.lit(1))).alias("number")
    )


@query(
    "f6_value_maps",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 END AS level FROM documents""",
)
def value_maps(spark, sf_dir):
    from textgrade.sources.corpora import _lookup

    return views.documents(spark, sf_dir).select(
        "doc_id", _lookup({"en": 0, "de": 1, "fr": 2}, F.col("lang")).alias("level")
    )


@query(
    "f7_id_parts",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'docs:' || doc_id ELSE 'docs:' || doc_id || ':x' END AS head FROM documents",
)
def id_parts(spark, sf_dir):
    d = F.col("doc_id")
    long_id = F.concat_ws(":", F.lit("docs"), d, F.lit("ele"), F.lit("0"))
    flat_id = F.concat_ws(":", F.lit("docs"), d, F.lit("x"))
    return views.documents(spark, sf_dir).select(
        "doc_id", group_id(F.when(d % 2 == 0, long_id).otherwise(flat_id)).alias("head")
    )


@query(
    "f8_clip_and_sign",
    """SELECT c_custkey, greatest(least(c_acctbal / 5000, 1), 0)::DOUBLE AS clipped, abs(c_acctbal) AS size,
    sign(c_acctbal)::DOUBLE AS side, round(sqrt(abs(c_acctbal)), 6) AS root FROM customer""",
)
def clip_and_sign(spark, sf_dir):
    b = F.col("c_acctbal")
    return views.table(spark, sf_dir, "customer").select(
        "c_custkey",
        clip(b / 5000, 0.0, 1.0).alias("clipped"),
        F.abs(b).alias("size"),
        F.signum(b).alias("side"),
        r6(F.sqrt(F.abs(b))).alias("root"),
    )


@query(
    "f9_even_places",
    """SELECT doc_id, list_distinct(list_transform(range(5), lambda j: round_even(j * (n_chars / 4.0::DOUBLE), 0)::BIGINT))
    .list_sort().array_to_string(',') AS places FROM documents""",
)
def even_places(spark, sf_dir):
    items = F.sequence(F.lit(0).cast("long"), F.col("n_chars"))
    picked = F.when(F.col("n_chars") >= 5, evenly_spaced(items, 5)).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.rint(i * (F.col("n_chars") / 4)).cast("long")))
    )
    return views.documents(spark, sf_dir).select(
        "doc_id", F.array_join(F.transform(picked, lambda x: x.cast("string")), ",").alias("places")
    )


@query(
    "u1_union_corpora",
    f"""WITH {sql.canonical()} SELECT corpus, count(*)::BIGINT AS n FROM (SELECT corpus FROM canon UNION ALL
    SELECT 'benchmark' FROM benchmark) GROUP BY corpus""",
)
def union_of_corpora(spark, sf_dir):
    items = views.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("benchmark:"), F.col("item_id")).alias("id"), "text", F.lit("benchmark").alias("corpus")
    )
    return value_counts(union_corpora([views.canonical_docs(spark, sf_dir), items]), "corpus")


@query(
    "m16_value_counts",
    f"WITH {sql.canonical('lang')} SELECT corpus, count(*)::BIGINT AS n FROM canon GROUP BY corpus",
)
def counts(spark, sf_dir):
    return value_counts(views.canonical_docs(spark, sf_dir, "lang"), "corpus")


@query(
    "prepare_unified_table",
    f"""WITH {sql.canonical('lang', 'quality')},
    kept AS {sql.filtered('canon', 3, 600, "'en','de','es','fr'")},
    ranked AS (SELECT k.*, CASE WHEN native_label IS NOT NULL THEN
        CASE WHEN corpus = 'en' THEN 1 - r / n ELSE r / n END END AS h FROM kept k LEFT JOIN (
          SELECT id AS rid, {sql.avg_rank('native_label', 'corpus')} AS r, count(*) OVER (PARTITION BY corpus) AS n
          FROM kept WHERE native_label IS NOT NULL) ON id = rid),
    based AS (SELECT *, CASE WHEN native_label IS NULL THEN 'unlabeled' WHEN format_type = 'poetry' THEN 'ood_format'
        WHEN corpus = 'fr' THEN 'ood_corpus' ELSE 'train' END AS base FROM ranked),
    drawn AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY {sql.draw("'42'", 'id')}, id) AS r,
        count(*) OVER (PARTITION BY base) AS m FROM based)
    SELECT id, corpus, round(h, 6) AS harmonized_difficulty, 'percentile_within_corpus' AS mapping_method,
      CASE WHEN h IS NOT NULL THEN 1.0::DOUBLE END AS mapping_confidence,
      CASE WHEN base = 'train' AND r <= floor(m * 0.1::DOUBLE) THEN 'val' ELSE base END AS split FROM drawn""",
)
def unified_table(spark, sf_dir):
    """The whole preparation: union, filter, dedup, difficulty axis, splits."""
    out = prepare_corpus(
        [views.canonical_docs(spark, sf_dir, "lang", "quality")],
        languages=("en", "de", "es", "fr"),
        polarity=views.POLARITY_BY_LANG,
        holdout_corpora=["fr"],
        holdout_formats=["poetry"],
    )
    return rounded(
        out.select("id", "corpus", "harmonized_difficulty", "mapping_method", "mapping_confidence", "split")
    )
