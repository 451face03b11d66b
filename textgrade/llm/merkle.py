"""Merkle manifest of a table: a subtree for each group, a root over the groups, and a proof for every row.

Every row is a leaf, and every three consecutive nodes of a level become one. The leaves of a group are ranked, and the
base-3 digits of a rank say where the leaf sits in the tree. A block of ``3 ** DIGITS`` consecutive leaves is one
unit of work: its digit columns are grouped away one after the other, each grouping nesting the nodes below as structs
in their parent. Blocks are partitioned once; grouping by fewer columns of the same key needs no other exchange. The
tops of blocks are nodes like leaves and are rolled up in the same way, until one is left in each group. Then proofs
are read off the nested structs by transform and explode, without joining leaves to anything: only the one row of a
block meets the path of its top.

A block is bounded, so no task or row holds more than ``3 ** DIGITS`` leaves at a time, however large a group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textgrade.llm.common import broadcast_if_small, same
from textgrade.operators.ranks import unique_rank
from textgrade.sources.settled import settle

FAN = 3
#: Levels in a block, so 729 nodes, and rows in a stretch when nodes are put in order.
DIGITS, STRETCH = 6, 1 << 14
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value that cannot be mistaken for another one next to it: byte count, colon, value; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _levels(n: Column) -> Column:
    """How often ``n`` nodes are grouped by three until one is left. Exact: powers of three are compared as integers."""
    powers = F.array(*[F.lit(FAN**k) for k in range(40)])
    return F.size(F.filter(powers, lambda p: p < n))


def _roll_up(nodes: DataFrame) -> DataFrame:
    """Blocks of ``(grp, rank, levels, digest, what)``: one row a block with its nested tree and its top's digest.

    A level at which the group has one node left already passes it on as it is. ``what`` is carried inside the tree.
    """
    size = FAN**DIGITS
    digits = [f"d{k}" for k in range(DIGITS)]
    block = nodes.select(
        "grp",
        F.expr(f"rank div {size}").alias("block"),
        *[F.expr(f"cast(rank div {FAN**k} % {FAN} as int)").alias(d) for k, d in enumerate(digits)],
        "levels",
        F.struct("digest", "what").alias("node"),
    ).repartition("grp", "block")
    for k in range(DIGITS):
        above = digits[k + 1 :]
        grouped = block.groupBy("grp", "block", *above).agg(
            F.array_sort(F.collect_list(F.struct(F.col(digits[k]).alias("digit"), "node"))).alias("below"),
            F.first("levels").alias("levels"),
        )
        of = F.col("below.node.digest")
        joined = F.sha2(F.array_join(of, "").cast("binary"), 256)
        block = grouped.select(
            "grp",
            "block",
            *above,
            "levels",
            F.struct(F.when(F.col("levels") > k, joined).otherwise(of[0]).alias("digest"), "below").alias("node"),
        )
    return block


def _beside(below: Column, levels: Column, level: int) -> Column:
    """Each child with its place's step: the digests to its left and right, or no step where the level is none."""

    def step(child: Column) -> Column:
        def part(of: Column) -> Column:
            return F.array_join(F.transform(of, lambda c: c["node"]["digest"]), "")

        left = part(F.filter(below, lambda c: c["digit"] < child["digit"]))
        right = part(F.filter(below, lambda c: c["digit"] > child["digit"]))
        one = F.array(F.struct(left.alias("left"), right.alias("right")))
        return F.when(levels > level, one).otherwise(F.array().cast(_STEPS))

    return F.transform(below, lambda child: F.struct(child["node"].alias("node"), step(child).alias("step")))


def _explode(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """The nodes that went into the blocks, each with its steps from the bottom up to and behind ``steps``."""
    out = blocks
    for level in reversed(range(DIGITS)):
        out = out.withColumn("child", F.explode(_beside(F.col("node.below"), F.col("levels"), level))).select(
            *keep, "levels", F.concat(F.col("child.step"), F.col("steps")).alias("steps"), F.col("child.node").alias("node")
        )
    return out.select(*keep, "steps", F.col("node.digest").alias("digest"), "node.what")


def _ordered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Nodes with ``rank`` from 0 in their group and the ``levels`` above them."""
    ranked = unique_rank(nodes, order, ["grp"], STRETCH)
    return ranked.withColumns({"rank": F.col("rank") - 1, "levels": _levels(F.col("rows"))}).drop("rows")


def _trees(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Nodes ``(grp, digest, what)`` with the ``top`` of their group and the ``steps`` up to it.

    Going up, the tops of blocks are the nodes of the next pass until each group is one block: a pass for every
    ``DIGITS`` levels. Going down, a block's row takes the path of its top along and is opened.
    """
    level = _ordered(nodes, order)
    passes = []
    while True:
        blocks = settle(_roll_up(level))
        passes.append(blocks)
        if blocks.where("block > 0").isEmpty():
            break
        level = blocks.select(
            "grp",
            F.col("block").alias("rank"),
            F.greatest(F.col("levels") - DIGITS, F.lit(0)).alias("levels"),
            F.col("node.digest").alias("digest"),
            F.struct("grp", "block").alias("what"),
        )
    top = passes.pop()
    found = _explode(top.select("*", F.array().cast(_STEPS).alias("steps"), F.col("node.digest").alias("top")), ["grp", "top"])
    while passes:
        path = settle(found.select("steps", "top", F.col("what.grp").alias("_grp"), F.col("what.block").alias("_block")))
        here = passes.pop()
        # the path comes behind the block's own steps
        met = here.join(
            broadcast_if_small(path, BROADCAST_PATHS), same(F.col("grp"), F.col("_grp")) & (F.col("block") == F.col("_block"))
        )
        found = _explode(met, ["grp", "top"])
    return found


#: Paths of blocks, at most 5 kB each, that are broadcast.
BROADCAST_PATHS = 4000


def merkle_manifest(
    df: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "source",
    changed: dict[str, Column] | None = None,
) -> DataFrame:
    """``id_col, leaf, subroot, root, proof, proof_sha256, folded_root, verified`` of every row.

    ``proof`` is the path from the leaf to the root: for each level the digests left and right of the node, in a row.
    ``changed`` gives other values of fields; the root is then folded again from the changed row and the original path,
    and ``verified`` tells whether it comes out the same. Without it every row is verified against itself.

    Leaves of a group ascend by id, nulls first, rows with the same id by their digest; equal rows are leaves of their
    own. A null group is one like any other and comes first. Null fields, empty and long texts are framed as
    they are; an empty table has no rows; other columns are ignored, whatever their names.
    """

    def leaf_of(values: dict[str, Column]) -> Column:
        return digest(*[framed(values[f]) for f in fields])

    own = {f: F.col(f) for f in fields}
    leaves = settle(
        df.select(
            F.col(group_col).cast("string").alias("grp"),
            F.col(id_col).alias("id"),
            leaf_of(own).alias("digest"),
            leaf_of({**own, **(changed or {})}).alias("other"),
        )
    )
    nodes = leaves.select("grp", "digest", F.struct("id", "other").alias("what"), "id")
    below = _trees(nodes, ["id", "digest"])
    inner = settle(below)
    subroots = inner.groupBy("grp").agg(F.first("top").alias("digest"))
    tops = subroots.select(
        F.lit(0).alias("grp"), "digest", F.struct(F.col("grp").alias("name")).alias("what"), F.col("grp").alias("name")
    )
    outer = settle(_trees(tops, ["name"]).select(F.col("what.name").alias("_name"), F.col("top").alias("root"), F.col("steps").alias("_up")))
    whole = inner.join(broadcast_if_small(outer, BROADCAST_PATHS), same(F.col("grp"), F.col("_name")))
    steps = F.concat("steps", "_up")
    parts = F.transform(steps, lambda s: F.concat(s["left"], s["right"]))
    folded = F.aggregate(
        steps, F.col("what.other"), lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]).cast("binary"), 256)
    )
    return whole.select(
        F.col("what.id").alias(id_col),
        F.col("digest").alias("leaf"),
        F.col("top").alias("subroot"),
        "root",
        steps.alias("proof"),
        F.sha2(F.array_join(parts, "").cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def without_line_breaks(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """What the query tampers with: the line breaks of texts whose id has an even checksum."""
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    return {text_col: F.when(even, F.translate(text_col, "\n", "")).otherwise(F.col(text_col))}


def _sql_tree(name: str, order: str, levels: int) -> list[str]:
    """DuckDB CTEs over nodes ``name(grp, digest, ..)``: each with its steps to the top of its group, in ``<name>_out``."""
    ctes = [
        f"{name}_r as materialized (select *, row_number() over (partition by grp order by {order}) - 1 as rank from {name})",
        f"{name}_0 as materialized (select grp, rank as pos, digest, count(*) over (partition by grp) as n from {name}_r)",
    ]
    for k in range(levels):
        ctes.append(
            f"{name}_{k + 1} as materialized (select grp, pos // {FAN} as pos, sha256(string_agg(digest, '' order by pos)) as digest, "
            f"(any_value(n) + {FAN - 1}) // {FAN} as n from {name}_{k} where n > 1 group by grp, pos // {FAN} "
            f"union all select grp, pos, digest, n from {name}_{k} where n = 1)"
        )
    runs = " union all ".join(
        f"select {k} as k, {FAN**k} as width, grp, pos // {FAN} as up, list(digest order by pos) as ds from {name}_{k} where n > 1 group by all"
        for k in range(levels)
    )
    place = f"rank // width % {FAN}"
    return [
        *ctes,
        f"{name}_runs as materialized ({runs})",
        f"{name}_steps as (select r.grp, rank, list({{'l': array_to_string(ds[1:{place}], ''), 'r': array_to_string(ds[{place} + 2:], '')}} order by k) as steps "
        f"from {name}_r r join {name}_runs u on u.grp is not distinct from r.grp and up = rank // (width * {FAN}) group by r.grp, rank)",
        f"{name}_out as materialized (select r.*, t.digest as top, coalesce(steps, []) as steps from {name}_r r "
        f"join {name}_{levels} t on t.grp is not distinct from r.grp "
        f"left join {name}_steps s on s.grp is not distinct from r.grp and s.rank = r.rank)",
    ]


def merkle_sql(docs: str = "documents", levels: int = 20) -> str:
    """DuckDB SQL for the query, for up to ``3 ** levels`` rows a group: the nodes of all groups level by level."""

    def leaf(text: str) -> str:
        values = [text if f == "text" else f for f in FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}::varchar) || ':' || {v}::varchar, '-')" for v in values) + ")"

    crc = (
        "xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::ubigint)), "
        "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], "
        "lambda x, y: xor(x >> 1, 3988292384::ubigint * (x & 1)))), 4294967295::ubigint)"
    )
    ctes = [
        f"d as (select *, case when {crc} % 2 = 0 then replace(text, chr(10), '') else text end as changed from {docs})",
        f"t as materialized (select doc_id, source as grp, {leaf('text')} as digest, {leaf('changed')} as other from d)",
        *_sql_tree("t", "doc_id nulls first, digest", levels),
        "s as (select 0 as grp, grp as name, any_value(top) as digest from t_out group by t_out.grp)",
        *_sql_tree("s", "name nulls first", levels),
        "w as (select t.doc_id, t.digest as leaf, t.top as subroot, s.top as root, t.other, list_concat(t.steps, s.steps) as steps "
        "from t_out t join s_out s on s.name is not distinct from t.grp)",
        "v as (select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x.l || x.r), '')) as proof_sha256, "
        "list_reduce(list_prepend({'l': other, 'r': ''}, steps), lambda a, x: {'l': sha256(x.l || a.l || x.r), 'r': ''}).l as folded_root from w)",
    ]
    return "with " + ",\n".join(ctes) + "\nselect *, folded_root = root as verified from v"
