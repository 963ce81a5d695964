"""Merkle manifest of a dataset: window-based levels, proofs of inclusion and their verification.

Every row is a leaf. Within a group (lang) leaves stand in the order of their ids; while a group has more than one
node, each run of FAN consecutive nodes becomes one parent, the hash of the run. What remains is the group's
subroot; the subroots, in the order of the groups' names (null first, by bytes), give the root in the same way.

A level is one window: partition by group and parent index, ordered by index, full frame. Its ``collect_list`` (at
most FAN digests) is the preimage of the parent and holds the siblings of each node at once. One node of each run
goes on as the parent, so the levels shrink by FAN. On the way down a node's proof is its own step followed by its
parent's proof: each level is joined to the one above, an eighth of its size.

Places of leaves come from a range sort and one count a partition, and windows and joins go by group and place, so
a group of any size is no single task's work. A row's digest is computed once; texts are not shuffled.

Edge cases: a null field is hashed as ``-``, an empty one as ``0:``. Rows with a null id come first in their group
and are never tampered with; rows that share an id stand in the order of their leaf digests, and equal rows are
leaves of their own with equal digests. A null group is a group. A group of one row has its leaf as subroot, a
dataset of one group its subroot as root; a proof without siblings is the hash of nothing. An empty table gives no
rows. Columns beside those named are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistrack.plans.ranking import global_rank
from vistrack.session import join_checked, stored

#: Nodes of a run, and the fields of a leaf in their order.
FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(row: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(row[c]) for c in FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(id, grp, leaf, claimed): the digest of each row, and of those tampered with (a third of the ids) that of the
    row with its text's capital letters lowered, else null."""
    row = {c: F.col(f"`{c}`") for c in FIELDS}
    lowered = row | {"text": F.translate(row["text"].cast("string"), UPPER, LOWER)}
    claimed = F.when(F.crc32(row["doc_id"].cast("string")) % 3 == 0, leaf(lowered))
    return docs.select(row["doc_id"].alias("id"), row["lang"].cast("string").alias("grp"), leaf(row).alias("leaf"), claimed.alias("claimed"))


def same(a: DataFrame, b: DataFrame, by: list[str]) -> list[Column]:
    return [a[c].eqNullSafe(b[f"{c}_"]) for c in by]


def renamed(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}_") for c in by), *(c for c in df.columns if c not in by))


def placed(rows: DataFrame) -> DataFrame:
    """Rows of ``leaves`` as nodes (grp, place, n, node) with id and claimed: 0-based place in a group of n."""
    ranked, _ = global_rank(rows, "grp", "id", "leaf", "claimed")
    groups = stored(ranked.groupBy("grp").agg(F.min("rn").alias("first"), F.count("*").alias("n")), "merkle-groups")
    on = renamed(groups, ["grp"])
    both = join_checked(ranked, on, ranked["grp"].eqNullSafe(on["grp_"]), "inner")
    return both.select("grp", (F.col("rn") - F.col("first")).alias("place"), "n", F.col("leaf").alias("node"), "id", "claimed")


def climb(nodes: DataFrame, by: list[str], what: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels from the lowest up, each with ``run``, the digests of a node's run in order, and the tops
    (by, height, node). nodes has (by, place, n, node), n being the nodes of the group; its further columns stay
    in the lowest level. A group takes no part in the levels above its top."""
    parent = F.expr(f"place div {FAN}")
    w = Window.partitionBy(*by, parent).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops, height = [], nodes.where("n = 1").select(*by, F.lit(0).alias("height"), "node"), 0
    level = stored(nodes.withColumn("run", F.collect_list("node").over(w)), what)
    while True:
        levels.append(level)
        if most <= 1:
            return levels, stored(tops, f"{what}-tops")
        height, most = height + 1, -(-most // FAN)
        # the first node of a run stands for it, so that each parent comes once
        up = level.where((F.col("n") > 1) & (F.col("place") % FAN == 0))
        nodes = up.select(*by, parent.alias("place"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.sha2(F.array_join("run", ""), 256).alias("node"))
        level = stored(nodes.withColumn("run", F.collect_list("node").over(w)), what)
        tops = tops.union(level.where("n = 1").select(*by, F.lit(height), "node"))
        level = level.where("n > 1")


def proofs(levels: list[DataFrame], tops: DataFrame, by: list[str], what: str) -> DataFrame:
    """The lowest level with ``proof``, an array of (l, r) from the leaf to the root: the digests left and right of the
    node in its run, joined. tops has (by, height, proof) and any further columns, which come along."""
    at = (F.col("place") % FAN).cast("int")
    step = F.array(F.struct(F.array_join(F.slice("run", F.lit(1), at), "").alias("l"), F.array_join(F.slice("run", at + 2, F.lit(FAN)), "").alias("r")))
    kept = [c for c in tops.columns if c not in (*by, "height")]
    above = None
    for k in range(len(levels) - 1, -1, -1):
        ends = tops.where(F.col("height") == k + 1).select(*by, F.lit(0).cast("long").alias("up"), *kept)
        if k == 0:  # tops that are leaves
            ends = ends.union(tops.where("height = 0").select(*by, F.lit(-1).cast("long"), *kept))
        ends = renamed(ends if above is None else ends.unionByName(above.select(*by, F.col("place").alias("up"), *kept)), by)
        own = levels[k].withColumn("parent", F.when(F.col("n") == 1, F.lit(-1).cast("long")).otherwise(F.expr(f"place div {FAN}")))
        joined = own.join(ends, [*same(own, ends, by), own["parent"] == ends["up"]])
        proof = F.when(F.col("n") == 1, F.col("proof")).otherwise(F.concat(step, F.col("proof")))
        above = joined.select(*levels[k].drop("run").columns, proof.alias("proof"), *(c for c in kept if c != "proof"))
        above = stored(above, what) if k else above
    return above


def fold(start: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(proof, start, lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: id, grp, leaf, claimed, subroot, root, proof (array of l, r) and folded, the root that follows from
    the claimed leaf and the proof."""
    levels, tops = climb(placed(leaves(docs)), ["grp"], "merkle")
    ranked, n = global_rank(tops, "grp")
    groups = ranked.select((F.col("rn") - 1).alias("place"), F.lit(n).cast("long").alias("n"), "node", "grp", F.col("height").alias("own"))
    upper, top = climb(groups, [], "merkle-roots")
    root = top.select("node").first()
    none = F.array().cast("array<struct<l:string,r:string>>")
    tails = proofs(upper, top.select("height", none.alias("proof")), [], "merkle-tails")
    tails = stored(tails.select("grp", F.col("own").alias("height"), "proof", F.col("node").alias("subroot")), "merkle-tails")
    rows = proofs(levels, tails, ["grp"], "merkle-proofs").withColumnRenamed("node", "leaf")
    return rows.select("id", "grp", "leaf", "claimed", "subroot", F.lit(root["node"] if root else None).cast("string").alias("root"), "proof", fold(F.coalesce("claimed", "leaf"), F.col("proof")).alias("folded"))


def query(spark, sf_dir: str) -> DataFrame:
    got = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["l"], s["r"])), "")
    return got.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS[:-1]) + " || {0})"
#: A level is an aggregate in the recursion; a proof climbs from a leaf by its runs. crc32 goes bit by bit over the digits.
SQL = f"""WITH RECURSIVE d AS (SELECT *, CASE WHEN doc_id IS NOT NULL THEN list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) END AS c FROM documents),
l AS (SELECT doc_id, lang, {_LEAF.format(_FIELD.format('text'))} AS leaf, CASE WHEN xor(c, 4294967295) % 3 = 0 THEN {_LEAF.format(_FIELD.format(f"translate(text, '{UPPER}', '{LOWER}')"))} END AS claimed FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (SELECT lang, 0 AS h, place, n, leaf AS node FROM p UNION ALL
      SELECT lang, any_value(h) + 1, place // {FAN}, (any_value(n) + {FAN - 1}) // {FAN}, sha256(string_agg(node, '' ORDER BY place)) FROM t WHERE n > 1 GROUP BY lang, place // {FAN}),
g AS (SELECT lang, h AS own, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS h, place, n, node FROM g UNION ALL
      SELECT any_value(h) + 1, place // {FAN}, (any_value(n) + {FAN - 1}) // {FAN}, sha256(string_agg(node, '' ORDER BY place)) FROM u WHERE n > 1 GROUP BY place // {FAN}),
tl AS (SELECT x.lang, x.h, x.place, coalesce(string_agg(y.node, '' ORDER BY y.place) FILTER (WHERE y.place < x.place), '') AS l, coalesce(string_agg(y.node, '' ORDER BY y.place) FILTER (WHERE y.place > x.place), '') AS r
       FROM t x JOIN t y ON x.lang IS NOT DISTINCT FROM y.lang AND x.h = y.h AND x.place // {FAN} = y.place // {FAN} WHERE x.n > 1 GROUP BY x.lang, x.h, x.place),
ul AS (SELECT x.h, x.place, coalesce(string_agg(y.node, '' ORDER BY y.place) FILTER (WHERE y.place < x.place), '') AS l, coalesce(string_agg(y.node, '' ORDER BY y.place) FILTER (WHERE y.place > x.place), '') AS r
       FROM u x JOIN u y ON x.h = y.h AND x.place // {FAN} = y.place // {FAN} WHERE x.n > 1 GROUP BY x.h, x.place),
s AS (SELECT p.doc_id, p.lang, p.place, p.leaf, p.claimed, tl.h AS k, tl.l, tl.r FROM p JOIN tl ON p.lang IS NOT DISTINCT FROM tl.lang AND tl.place = p.place // ({FAN} ** tl.h)::BIGINT
      UNION ALL SELECT p.doc_id, p.lang, p.place, p.leaf, p.claimed, 1000 + ul.h, ul.l, ul.r FROM p JOIN g ON p.lang IS NOT DISTINCT FROM g.lang JOIN ul ON ul.place = g.place // ({FAN} ** ul.h)::BIGINT),
w AS (SELECT p.lang, p.place, p.doc_id, p.leaf, p.claimed, list(struct_pack(l := s.l, r := s.r) ORDER BY s.k) FILTER (WHERE s.k IS NOT NULL) AS steps
      FROM p LEFT JOIN s ON p.lang IS NOT DISTINCT FROM s.lang AND p.place = s.place GROUP BY ALL),
f AS (SELECT lang, place, 0 AS i, coalesce(claimed, leaf) AS acc, steps FROM w UNION ALL SELECT lang, place, i + 1, sha256(steps[i + 1].l || acc || steps[i + 1].r), steps FROM f WHERE i < coalesce(len(steps), 0)),
root AS (SELECT node AS root FROM u WHERE n = 1)
SELECT w.doc_id, w.leaf, g.node AS subroot, root.root, sha256(coalesce(list_aggregate(list_transform(w.steps, lambda x: x.l || x.r), 'string_agg', ''), '')) AS proof_sha256, f.acc AS folded_root, f.acc = root.root AS verified
FROM w JOIN g ON w.lang IS NOT DISTINCT FROM g.lang JOIN f ON f.lang IS NOT DISTINCT FROM w.lang AND f.place = w.place AND f.i = coalesce(len(w.steps), 0), root"""
