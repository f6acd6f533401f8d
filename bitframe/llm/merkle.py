"""A Merkle tree over the rows of a dataset, with a proof for each row.

Rows are leaves, in order within their group; groups are the leaves of a tree of their own. At a level, a window over the group and
the parent's number collects the digests of the run in order over the full frame: joined they are what the parent hashes, and the other one is
the sibling in the proof. A node that stands for many leaves is collected once, from the first of them, and after ``LEVELS``
levels one row for each parent is left, so that the next levels have a thousandth of the rows. Nodes are dealt out by (group, block of 1,024
neighbours), which serves all windows of these levels: a group of any size spreads over all tasks, and each block of levels costs one
shuffle of digests. Texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .scratch import written

LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else its length in bytes, a colon and its text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    """The digest of a row, as bytes."""
    return F.unhex(F.sha2(F.concat(*[_field(v) for v in values]), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _climbed(nodes: DataFrame, group: str) -> DataFrame:
    """Nodes (group, i, n, h) with ``path``, their siblings in up to LEVELS levels (null: none), and ``top``, the digest of their ancestor there."""
    out = nodes.withColumn("__block", F.shiftright("i", LEVELS)).repartition(group, "__block").withColumn("__h", F.col("h"))
    for k in range(LEVELS):
        run = Window.partitionBy(group, "__block", "__parent").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first = F.col("i").bitwiseAND(2**k - 1) == 0
        out = out.withColumn("__parent", F.shiftright("i", k + 1)).withColumn("__run", F.collect_list(F.when(first, F.col("__h"))).over(run))
        sibling = F.get("__run", F.lit(1) - F.shiftright("i", k).bitwiseAND(1).cast("int"))
        parent = F.unhex(F.sha2(F.array_join(F.transform("__run", _hex), ""), 256))
        out = out.withColumn(f"__s{k}", sibling).withColumn("__h", F.when(F.col("n") > 2**k, parent).otherwise(F.col("__h")))
    levels = sum(((F.col("n") > 2**k).cast("int") for k in range(LEVELS)), F.lit(0))
    path = F.slice(F.array(*[f"__s{k}" for k in range(LEVELS)]), F.lit(1), levels)
    return out.select(*nodes.columns, path.alias("path"), F.col("__h").alias("top"))


def tree(nodes: DataFrame, group: str) -> DataFrame:
    """Nodes (group, i from 0, n of the group, h) with ``path``, all siblings from level to level, and ``top``, the group's root."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    parts = []
    while True:
        parts.append(written(_climbed(nodes, group)))
        most = -(-most // 2**LEVELS)
        if most <= 1:
            break
        one = parts[-1].where(F.col("i").bitwiseAND(2**LEVELS - 1) == 0)
        nodes = one.select(group, F.shiftright("i", LEVELS).alias("i"), F.ceil(F.col("n") / 2**LEVELS).cast("bigint").alias("n"), F.col("top").alias("h"))
    out = parts.pop()
    while parts:
        above = out.select(F.col(group).alias("__g"), F.col("i").alias("__i"), F.col("path").alias("__path"), F.col("top").alias("__top"))
        below = parts.pop()
        out = below.join(above, F.col(group).eqNullSafe(F.col("__g")) & (F.shiftright("i", LEVELS) == F.col("__i")))
        out = out.select(*[c for c in below.columns if c not in ("path", "top")], F.concat("path", "__path").alias("path"), F.col("__top").alias("top"))
    return out


def folded(digest: Column, place: Column, path: Column) -> Column:
    """The root that a digest, its place and its siblings lead to, as hexadecimal text."""

    def step(so_far: Column, sibling: Column) -> Column:
        own, other = so_far["h"], _hex(sibling)
        both = F.when(sibling.isNull(), own).when(so_far["i"].bitwiseAND(1) == 0, F.concat(own, other)).otherwise(F.concat(other, own))
        return F.struct(F.sha2(both, 256).alias("h"), F.shiftright(so_far["i"], 1).alias("i"))

    return F.aggregate(path, F.struct(digest.alias("h"), place.alias("i")), step, lambda x: x["h"])


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of ``docs``, by the columns of documents.

    ``changed`` replaces columns in rows that hold ``where``, after the tree was made: folded_root is what their changed leaves lead to
    with the siblings of the tree, and verified says whether that is the root. Null values are hashed as ``-``; a null language is a group, the
    first one; null ids come first. Rows of equal language and id are ordered by their digests. An empty table has no
    rows. Other columns are ignored.
    """
    own = leaf([F.col(c) for c in FIELDS])
    other = leaf([(changed or {}).get(c, F.col(c)) for c in FIELDS])
    rows = written(docs.select("doc_id", "lang", own.alias("h"), F.when(F.coalesce(F.lit(False) if where is None else where, F.lit(False)), other).alias("other")))
    placed = numbered(rows, ["lang"], ["doc_id", "h"], "place", "n").withColumn("i", F.col("place") - 1).drop("place")
    below = tree(placed, "lang")
    groups = below.where("i = 0").select(F.lit(0).alias("all"), "lang", F.col("top").alias("h"))
    above = tree(numbered(groups, ["all"], ["lang"], "place", "n").withColumn("i", F.col("place") - 1).drop("place"), "all")
    above = above.select(F.col("lang").alias("__lang"), F.col("i").alias("__i"), F.col("path").alias("__path"), F.col("top").alias("__root"))
    both = below.join(above, F.col("lang").eqNullSafe(F.col("__lang")))
    proof = F.sha2(F.array_join(F.transform(F.array_compact(F.concat("path", "__path")), _hex), ""), 256)
    root = folded(folded(_hex(F.coalesce("other", "h")), F.col("i"), F.col("path")), F.col("__i"), F.col("__path"))
    out = both.select("doc_id", _hex(F.col("h")).alias("leaf"), _hex(F.col("top")).alias("subroot"), _hex(F.col("__root")).alias("root"), proof.alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def report(docs: DataFrame) -> DataFrame:
    """The manifest where every row whose id's CRC-32 is a multiple of seven has one added to n_chars; nulls stay."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    return manifest(docs, {"n_chars": more}, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


_ENC = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_ENC.format(c) for c in FIELDS) + ")"
_BYTE = "CASE WHEN j % 8 = 0 THEN xor(c, ascii(d[j // 8 + 1])) ELSE c END"
_CRC = f"xor(list_reduce(range(8 * length(d)), lambda c, j: xor(({_BYTE}) >> 1, 3988292384 * (({_BYTE}) & 1)), 4294967295::BIGINT), 4294967295)"


def _fold(first: str, nodes: str, group: str) -> str:
    return (
        f"{first} UNION ALL SELECT f.grp, f.id, f.i // 2, (f.n + 1) // 2, f.k + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.i % 2 = 0 THEN f.h || s.h ELSE s.h || f.h END), f.proof || coalesce(s.h, '') "
        f"FROM {group} f LEFT JOIN {nodes} s ON s.grp IS NOT DISTINCT FROM f.grp AND s.k = f.k AND s.i = xor(f.i, 1) WHERE f.n > 1"
    )


_UP = "SELECT grp, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)), k + 1 FROM {0} WHERE n > 1 GROUP BY grp, i // 2, n, k"
ORACLE_SQL = f"""
WITH RECURSIVE made AS (SELECT doc_id, lang, {_LEAF} AS leaf, {_LEAF.replace("n_chars::VARCHAR", "(n_chars::HUGEINT + 1)::VARCHAR")} AS other, doc_id::VARCHAR AS d FROM documents),
leaves AS (SELECT doc_id, lang AS grp, leaf, CASE WHEN {_CRC} % 7 = 0 THEN other ELSE leaf END AS used, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM made),
lower AS (SELECT grp, i, n, leaf AS h, 0 AS k FROM leaves UNION ALL {_UP.format("lower")}),
subs AS (SELECT grp AS lang, h AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS j, count(*) OVER () AS m FROM lower WHERE n = 1),
upper AS (SELECT 0 AS grp, j AS i, m AS n, subroot AS h, 0 AS k FROM subs UNION ALL {_UP.format("upper")}),
folds AS ({_fold("SELECT grp, i AS id, i, n, 0 AS k, used AS h, '' AS proof FROM leaves", "lower", "folds")}),
tops AS ({_fold("SELECT 0 AS grp, {{'lang': f.grp, 'i': f.id}} AS id, j AS i, m AS n, 0 AS k, h, proof FROM folds f JOIN subs ON f.grp IS NOT DISTINCT FROM lang WHERE n = 1".replace("{{", "{").replace("}}", "}"), "upper", "tops")})
SELECT doc_id, leaf, subroot, u.h AS root, sha256(t.proof) AS proof_sha256, t.h AS folded_root, t.h = u.h AS verified
FROM leaves l JOIN subs s ON l.grp IS NOT DISTINCT FROM s.lang JOIN tops t ON t.n = 1 AND t.id.lang IS NOT DISTINCT FROM l.grp AND t.id.i = l.i JOIN upper u ON u.n = 1
"""
