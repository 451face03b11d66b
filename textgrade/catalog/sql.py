"""SQL pieces shared by the oracle queries."""

from __future__ import annotations

BLANK = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"


def tokens(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{BLANK}]+'))"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def normal(text: str) -> str:
    return f"regexp_replace(lower({strip(text)}), '[{BLANK}]+', ' ', 'g')"


def draw(*keys: str) -> str:
    return "md5(concat_ws(':', " + ", ".join(keys) + "))"


def number(*keys: str) -> str:
    return f"('0x' || substr({draw(*keys)}, 1, 8))::UBIGINT::BIGINT"


def proxy(text: str) -> str:
    w = f"len(regexp_extract_all({text}, '[A-Za-z'']+'))"
    s = f"greatest(len(regexp_extract_all({text}, '[.!?]+')), 1)"
    c = f"length(regexp_replace({text}, '[^A-Za-z'']', '', 'g'))"
    return (
        f"CASE WHEN {w} = 0 THEN 0.0::DOUBLE ELSE 0.39::DOUBLE * ({w}::DOUBLE / {s})"
        f" + 5.8::DOUBLE * ({c}::DOUBLE / {w}) END"
    )


def canonical(corpus: str = "source", label: str = "n_chars") -> str:
    """CTE ``canon``: documents as corpus rows."""
    col = "l.quality" if label == "quality" else "d.n_chars"
    return f"""canon AS (
      SELECT 'docs:' || d.doc_id AS id, d.doc_id, d.text, d.{corpus} AS corpus,
             {col}::DOUBLE AS native_label,
             CASE WHEN d.doc_id % 7 <> 0 THEN 0.5::DOUBLE END AS std_error,
             CASE WHEN d.doc_id % 10 = 0 THEN 'poetry' ELSE 'prose' END AS format_type,
             d.lang AS language, {tokens('d.text')}::BIGINT AS length_tokens
      FROM documents d LEFT JOIN labels l USING (doc_id))"""


def avg_rank(value: str, group: str) -> str:
    """Average-tie rank of ``value`` among the rows of ``group`` (rows must be non-null)."""
    return (
        f"(rank() OVER (PARTITION BY {group} ORDER BY {value})"
        f" + (count(*) OVER (PARTITION BY {group}, {value}) - 1) / 2.0)::DOUBLE"
    )


def filtered(source: str, low: int, high: int, langs: str) -> str:
    """Quality filter and first of each (corpus, text) over a canonical CTE."""
    return f"""(SELECT * FROM {source}
      WHERE {strip('text')} <> '' AND length_tokens BETWEEN {low} AND {high}
        AND language IN ({langs})
      QUALIFY row_number() OVER (PARTITION BY corpus, text ORDER BY id) = 1)"""


def chunks(source: str, target: int = 180, most: int = 320, least: int = 50) -> str:
    """CTEs ending in ``chunks(k, chunk, text)`` for a CTE ``source(k, text)``."""
    return f"""
    cut AS (
      SELECT k, unnest(parts) AS p, unnest(range(len(parts))) AS i FROM (
        SELECT k, regexp_split_to_array(text, '\\n[{BLANK}]*\\n') AS parts FROM {source})),
    para AS (
      SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) AS i, p,
             regexp_extract_all(p, '[^{BLANK}]+') AS ws
      FROM (SELECT k, i, {strip('p')} AS p FROM cut) WHERE p <> ''),
    sized AS (SELECT k, i, p, ws, len(ws) AS n FROM para),
    packed AS (
      WITH RECURSIVE walk(k, i, first, last, open) AS (
        SELECT k, i, 0::BIGINT, CASE WHEN n > {most} THEN ceil(n / {target}.0)::BIGINT - 1 ELSE 0 END,
               CASE WHEN n > {most} THEN 0 ELSE n END FROM sized WHERE i = 1
        UNION ALL
        SELECT s.k, s.i,
               CASE WHEN s.n <= {most} AND w.open > 0 AND w.open + s.n <= {target} THEN w.last
                    ELSE w.last + 1 END,
               CASE WHEN s.n > {most} THEN w.last + ceil(s.n / {target}.0)::BIGINT
                    WHEN w.open > 0 AND w.open + s.n <= {target} THEN w.last ELSE w.last + 1 END,
               CASE WHEN s.n > {most} THEN 0
                    WHEN w.open > 0 AND w.open + s.n <= {target} THEN w.open + s.n ELSE s.n END
        FROM walk w JOIN sized s ON s.k = w.k AND s.i = w.i + 1)
      SELECT * FROM walk),
    piece AS (
      SELECT s.k, w.first AS chunk, s.i, s.p AS text, s.n
      FROM packed w JOIN sized s USING (k, i) WHERE s.n <= {most}
      UNION ALL
      SELECT k, first + j, i, array_to_string(ws[j * {target} + 1 : (j + 1) * {target}], ' '),
             least(n - j * {target}, {target})
      FROM (SELECT s.k, w.first, s.i, s.ws, s.n, unnest(range(ceil(s.n / {target}.0)::BIGINT)) AS j
            FROM packed w JOIN sized s USING (k, i) WHERE s.n > {most})),
    loose AS (
      SELECT k, chunk, string_agg(text, ' ' ORDER BY i) AS text, sum(n) AS n
      FROM piece GROUP BY k, chunk),
    tail AS (
      SELECT *, max(chunk) OVER (PARTITION BY k) AS last FROM loose),
    chunks AS (
      SELECT k, to_chunk AS chunk, string_agg(text, ' ' ORDER BY chunk) AS text FROM (
        SELECT *, CASE WHEN chunk = last AND last > 0 AND n < {least} THEN chunk - 1 ELSE chunk END
                  AS to_chunk FROM tail)
      GROUP BY k, to_chunk)"""


FREE = """free AS (
      SELECT source, doc_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE replace(text, chr(10), chr(10) || chr(10)) END AS text
      FROM documents)"""

PARAGRAPHS = """paras AS (
      SELECT doc_id AS k, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)"""


def capped(keep: int) -> str:
    """CTE ``capped(k, chunk, text)``: evenly spaced chunks, numbered anew."""
    return f"""
    counted AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM chunks),
    capped AS (
      SELECT k, row_number() OVER (PARTITION BY k ORDER BY chunk) - 1 AS chunk, text FROM counted
      WHERE n <= {keep} OR chunk IN (
        SELECT round_even(j * ((n - 1) / {max(keep - 1, 1)}.0::DOUBLE), 0)::BIGINT
        FROM range({keep}) r(j)))"""


def pool(limit: int | None, keep: int = 5) -> str:
    """CTEs ending in ``pool``: the external pool of the first ``limit`` texts (all, if None) per source."""
    first = "true" if limit is None else f"r <= {limit}"
    return f"""{FREE},
    firsts AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM free),
    fetched AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS doc_index
      FROM firsts WHERE {first} AND text <> ''),
    texts AS (SELECT source || ':' || doc_index AS k, text FROM fetched),
    {chunks('texts')},
    {capped(keep)},
    rows_ AS (
      SELECT c.k || ':' || chunk AS id, c.text, source AS corpus, 'en' AS language,
             {tokens('c.text')}::BIGINT AS length_tokens
      FROM capped c JOIN fetched f ON c.k = f.source || ':' || f.doc_index),
    pool AS (SELECT * FROM {filtered('rows_', 50, 320, "'en'")})"""


SMALL = """small AS (
      SELECT c_custkey::VARCHAR AS id, c_acctbal AS t, p, c_mktsegment AS slice
      FROM customer LEFT JOIN (
        SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS p FROM orders GROUP BY 1)
      ON c_custkey = o_custkey)"""

CLEAN = """clean AS (
      SELECT * FROM {source} WHERE isfinite(t) AND isfinite(p))"""


def scores(source: str, keys: str, pairs: bool = True) -> str:
    """CTEs ending in ``scored``: all metrics of ``source(<keys>, t, p)`` per key."""
    join = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    pair_part = f"""
    pairs AS (
      SELECT {', '.join('a.' + k for k in keys.split(', '))}, count(*) AS n0,
             count(*) FILTER (WHERE sign(a.t - b.t) * sign(a.p - b.p) > 0) AS c,
             count(*) FILTER (WHERE sign(a.t - b.t) * sign(a.p - b.p) < 0) AS d,
             count(*) FILTER (WHERE a.t = b.t) AS tx, count(*) FILTER (WHERE a.p = b.p) AS ty
      FROM ranked a JOIN ranked b ON {join} AND a.rn < b.rn GROUP BY ALL),""" if pairs else ""
    pair_cols = """
             CASE WHEN any_value(n) >= 3 THEN any_value((c - d) / nullif(sqrt((n0 - tx)::DOUBLE) * sqrt((n0 - ty)::DOUBLE), 0)) END AS kendall,
             any_value(c / nullif(n0 - tx, 0)::DOUBLE) AS pairwise_acc,""" if pairs else ""
    pair_join = f"LEFT JOIN pairs USING ({keys})" if pairs else ""
    return f"""
    sized_ AS (SELECT {keys}, count(*) FILTER (WHERE isfinite(t)) AS n_all FROM {source} GROUP BY ALL),
    cleaned AS (SELECT * FROM {source} WHERE isfinite(t) AND isfinite(p)),
    ranked AS (
      SELECT *, {avg_rank('t', keys)} AS rt, {avg_rank('p', keys)} AS rp,
             count(*) OVER (PARTITION BY {keys}) AS n,
             row_number() OVER (PARTITION BY {keys} ORDER BY t, p) AS rn
      FROM cleaned),{pair_part}
    values_ AS (
      SELECT {keys},
             CASE WHEN any_value(n) >= 3 THEN sum((rt - (n + 1) / 2.0) * (rp - (n + 1) / 2.0))
               / nullif(sqrt(sum(pow(rt - (n + 1) / 2.0, 2))) * sqrt(sum(pow(rp - (n + 1) / 2.0, 2))), 0) END AS spearman,{pair_cols}
             CASE WHEN any_value(n) >= 2 THEN sqrt(avg(pow((rt - rp) / n, 2))) END AS rank_rmse,
             sqrt(avg(pow(t - p, 2))) AS rmse, avg(abs(t - p)) AS mae, avg(p - t) AS mean_signed_error
      FROM ranked {pair_join} GROUP BY {keys}),
    scored AS (SELECT * FROM sized_ LEFT JOIN values_ USING ({keys}))"""


GOLD = """gold AS (
      SELECT 'gold:' || vec_id AS id, embedding::DOUBLE[] AS v, {label} AS native_label,
             CASE WHEN vec_id % 14 <> 0 THEN 2.0::DOUBLE END AS std_error FROM embeddings WHERE vec_id % 2 = 0),
    gold_axis AS (
      SELECT *, 1 - (rank() OVER (ORDER BY native_label)
        + (count(*) OVER (PARTITION BY native_label) - 1) / 2.0)::DOUBLE / count(*) OVER () AS axis FROM gold)"""
GOLD_TIED = GOLD.format(label="label::DOUBLE")
GOLD_DISTINCT = GOLD.format(label="label + vec_id / 1000.0::DOUBLE")

POOL_IDS = """pool_ids AS (
      SELECT 'pool:' || vec_id AS id, vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 2 = 1
      UNION ALL
      SELECT 'copy:' || vec_id, vec_id, embedding::DOUBLE[], label FROM embeddings WHERE vec_id % 40 = 0)"""

PREDS = """preds AS (
      SELECT id, k AS teacher, (label + vec_id % (5 + k) - 2)::DOUBLE AS pred FROM pool_ids, range(3) r(k)),
    stats AS (SELECT id, avg(pred) AS mean, stddev_pop(pred) AS std FROM preds GROUP BY id)"""

NEAR = """near AS (
      SELECT p.id, g.id AS neighbour, round(list_cosine_distance(p.v, g.v), 9) AS distance
      FROM pool_ids p, gold g
      QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY round(list_cosine_distance(p.v, g.v), 9), g.id) = 1)"""


def axis(pred: str, source: str) -> str:
    """CTEs ending in ``placed``: ``source`` with ``axis_value`` extrapolated from gold knots."""
    return f"""
    knots AS (
      SELECT *, lead(x) OVER (ORDER BY x) AS nx, lead(y) OVER (ORDER BY x) AS ny,
             row_number() OVER (ORDER BY x) AS r, count(*) OVER () AS m
      FROM (SELECT native_label AS x, any_value(axis) AS y, count(*) AS ties FROM gold_axis GROUP BY 1)),
    low AS (SELECT x, y, CASE WHEN ties = 1 THEN (ny - y) / (nx - x) ELSE 0 END AS s FROM knots WHERE r = 1),
    high AS (SELECT b.x, b.y, CASE WHEN b.ties = 1 THEN (b.y - a.y) / (b.x - a.x) ELSE 0 END AS s
             FROM knots a JOIN knots b ON b.r = a.r + 1 WHERE b.r = b.m),
    placed AS (
      SELECT s.*, CASE
          WHEN s.{pred} < low.x THEN low.y + low.s * (s.{pred} - low.x)
          WHEN s.{pred} >= high.x THEN high.y + high.s * (s.{pred} - high.x)
          ELSE k.y + (k.ny - k.y) / (k.nx - k.x) * (s.{pred} - k.x) END AS axis_value
      FROM {source} s CROSS JOIN low CROSS JOIN high ASOF LEFT JOIN knots k ON s.{pred} >= k.x)"""


def judged(dedup: float, k_se: float = 1.0) -> str:
    return f"""{GOLD_TIED}, {POOL_IDS}, {PREDS}, {NEAR},
    joined AS (
      SELECT n.id, mean, std, distance, g.native_label AS neighbour_label,
             coalesce(g.std_error, (SELECT avg(std_error) FROM gold)) AS neighbour_se
      FROM near n JOIN stats USING (id) JOIN gold g ON g.id = n.neighbour),
    judged AS (
      SELECT *, abs(mean - neighbour_label) <= {k_se} * neighbour_se AS near_se,
             std <= (SELECT median(std) FROM joined) AS agreed, distance < {dedup} AS near_dup FROM joined),
    kept AS (SELECT * FROM judged WHERE near_se AND agreed AND NOT near_dup)"""


VARIANTS = f"""{SMALL},
    runs AS (SELECT * FROM (VALUES ('full', 4000.0::DOUBLE), ('no_pairwise', 8000.0), ('no_pseudo', 16000.0)) v(variant, width),
                           (VALUES (42), (43), (44)) s(seed)),
    vpreds AS (
      SELECT variant, seed, id, t + ({number("'7'", 'variant', 'seed', 'id')} / 4294967296.0::DOUBLE - 0.5) * width AS pred
      FROM small, runs),
    held AS (SELECT id, t FROM small WHERE id::BIGINT % 3 <> 0)"""
