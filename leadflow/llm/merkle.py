"""A Merkle manifest of a dataset: every row a leaf, a tree for each language, and one root over their roots.

Each level of a tree is one table of nodes {g, i, d, n}: tree, place, digest, and the tree's nodes on this level.
Nodes meet their siblings by equijoins on computed places (i XOR 1 in a binary tree, else the other slots of the
run of `fanout` places), and the rows in slot 0 emit the parents. A tree's last run may be shorter; a node that
is alone in it becomes the hash of itself. A tree of one node has that node as root.
Only DataFrame functions are used, and no task holds a tree or a level.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import crc32_sql
from leadflow.operators.ranking import group_rank
from leadflow.plans.session import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32
#: So many levels of proofs are put together before what is there is written down.
LEVELS_A_PLAN = 10


def _nothing() -> Column:
    return F.unhex(F.lit(""))


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hash(*texts: Column) -> Column:
    """SHA-256 of texts put together, as bytes."""
    return F.unhex(F.sha2(F.concat(*texts).cast("binary"), 256))


def leaf_digest(values: dict[str, Column]) -> Column:
    """SHA-256 of a row: each value as `bytes:value`, `-` for a null, in the order of FIELDS."""

    def field(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return _hash(*[field(values[c]) for c in FIELDS])


def siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """nodes {g, i, d, n} with `others`: the digests of the run's other nodes, left to right, in bytes."""
    slot = F.col("i") % fanout
    out = nodes
    for j in range(1, fanout):
        place = F.col("i").bitwiseXOR(F.lit(1)) if fanout == 2 else F.col("i") - slot + (slot + j) % fanout
        right = nodes.select("g", place.alias("i"), F.col("d").alias(f"d{j}"))  # the node at i is sibling j of the node at `place`
        out = out.join(right, ["g", "i"], "left")
    # the node that came over shift j stands in slot (own - j)
    by_slot = [reduce(lambda c, j, t=t: c.when((slot - j + fanout) % fanout == t, F.coalesce(f"d{j}", _nothing())), range(1, fanout), F.when(slot == t, _nothing())) for t in range(fanout)]
    return out.select("g", "i", "d", "n", F.concat(*by_slot).alias("others"))


def parents(level: DataFrame, fanout: int) -> DataFrame:
    """The nodes above a level of more than one node: slot 0 hashes its run."""
    up = lambda c: ((c - c % fanout) / fanout).cast("long")
    return level.where((F.col("n") > 1) & (F.col("i") % fanout == 0)).select("g", up(F.col("i")).alias("i"), _hash(_text(F.col("d")), _text(F.col("others"))).alias("d"), up(F.col("n") + fanout - 1).alias("n"))


def height(n: int, fanout: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


@dataclass
class Tree:
    """levels: tables {g, i, d, n, others}, leaves first; roots: {g, d}; fanout."""

    levels: list[DataFrame]
    roots: DataFrame
    fanout: int

    @property
    def height(self) -> int:
        return len(self.levels) - 1

    def proofs(self) -> DataFrame:
        """{g, i, proof} for every leaf: the digests of its siblings, level by level from below.

        Goes down from the roots: a node's proof is its siblings and its parent's proof. So all joins together
        move about twice what the leaves' proofs take."""
        k = self.fanout
        above = None
        for depth, level in enumerate(reversed(self.levels)):
            top = level.where("n = 1").select("g", "i", _nothing().alias("proof"))
            if above is not None:
                up = above.select("g", F.col("i").alias("_up"), F.col("proof").alias("_proof"))
                inner = level.where("n > 1").withColumn("_up", ((F.col("i") - F.col("i") % k) / k).cast("long"))
                top = top.unionByName(inner.join(up, ["g", "_up"]).select("g", "i", F.concat("others", "_proof").alias("proof")))
            above = materialise(top, "merkle-proofs") if depth % LEVELS_A_PLAN == LEVELS_A_PLAN - 1 else top
        return above


def build(nodes: DataFrame, fanout: int = 2) -> Tree:
    """Trees over nodes {g, i (from 0, without gaps), d, n (nodes of the tree)}."""
    if fanout < 2:
        raise ValueError("fanout is two or more")
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = []
    for _ in range(height(most, fanout) + 1):
        levels.append(materialise(siblings(nodes, fanout), "merkle-level"))
        nodes = parents(levels[-1], fanout)
    roots = reduce(DataFrame.unionByName, [level.where("n = 1").select("g", "d") for level in levels])
    return Tree(levels, roots, fanout)


def fold(digest: Column, proof: Column, place: Column, size: Column, levels: int, fanout: int = 2) -> Column:
    """The root (hex text) that a leaf (hex text) at `place` of `size` leaves leads to with the siblings of `proof` (bytes)."""
    start = F.struct(digest.alias("d"), place.cast("long").alias("i"), size.cast("long").alias("n"), F.lit(1).alias("at"))

    def step(s: Column, _: Column) -> Column:
        slot = s["i"] % fanout
        first = s["i"] - slot
        others = (F.least(F.lit(fanout).cast("long"), s["n"] - first) - 1).cast("int")
        left, right = slot.cast("int") * DIGEST, others * DIGEST
        part = lambda at, length: _text(F.substring(proof, at, length))
        up = F.struct(
            F.sha2(F.concat(part(s["at"], left), s["d"], part(s["at"] + left, right - left)).cast("binary"), 256).alias("d"),
            (first / fanout).cast("long").alias("i"), ((s["n"] + (fanout - 1) - (s["n"] + (fanout - 1)) % fanout) / fanout).cast("long").alias("n"), (s["at"] + right).alias("at"),
        )
        return F.when(s["n"] > 1, up).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, step, lambda s: s["d"]) if levels else digest


def tampered(every: int = 7, by: int = 1) -> Column:
    """n_chars after tampering: `by` more where `every` divides crc32 of the decimal doc_id (null: never); a null stays."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return F.when(F.coalesce(hit, F.lit(False)), F.col("n_chars").cast("long") + by).otherwise(F.col("n_chars").cast("long"))


def manifest(docs: DataFrame, fanout: int = 2, changed: Column | None = None) -> tuple[DataFrame, str | None]:
    """documents -> ({doc_id, place, size, leaf, subroot, root, proof, folded}, the root).

    One row per row of documents; digests are lower-case hex text, proof is bytes (32 a sibling, from the leaf to
    the root, left to right). Leaves of a language ascend by doc_id (null first), then by digest, so rows that
    share an id have a defined order and repeated rows are equal leaves side by side. A null language is a tree of
    its own, before the others. Columns other than FIELDS are not part of a leaf. changed: n_chars as it is found
    later (default: unchanged); `folded` is the root that such a row leads to. No rows: no rows, and no root.
    """
    values = {c: F.col(c) for c in FIELDS}
    later = values["n_chars"] if changed is None else changed
    rows = docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(values).alias("d"),
        F.when(~later.eqNullSafe(values["n_chars"]), leaf_digest(values | {"n_chars": later})).alias("found"),
    )
    ranked = group_rank(rows, [F.col("g")], [F.col("doc_id"), F.col("d")], "i", size="n").withColumn("i", F.col("i") - 1)
    leaves = materialise(ranked, "merkle-leaves")
    low = build(leaves.select("g", "i", "d", "n"), fanout)
    tops = materialise(group_rank(low.roots, [], [F.col("g")], "i", size="n").withColumn("i", F.col("i") - 1), "merkle-subroots")
    high = build(tops.withColumn("lang", F.col("g")).select(F.lit("").alias("g"), "i", "d", "n"), fanout)
    found = high.roots.first()
    root = found["d"].hex() if found else None
    langs = tops.join(high.proofs().select("i", F.col("proof").alias("high_proof")), "i").select("g", F.col("i").alias("high_i"), F.col("n").alias("high_n"), "high_proof", _text(F.col("d")).alias("subroot"))
    both = leaves.join(low.proofs(), ["g", "i"]).join(materialise(langs, "merkle-langs"), "g")
    at_subroot = fold(_text(F.coalesce("found", "d")), F.col("proof"), F.col("i"), F.col("n"), low.height, fanout)
    with_fold = both.withColumn("_sub", at_subroot)
    out = with_fold.select(
        "doc_id", F.col("i").alias("place"), F.col("n").alias("size"), _text(F.col("d")).alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"),
        F.concat("proof", "high_proof").alias("proof"), fold(F.col("_sub"), F.col("high_proof"), F.col("high_i"), F.col("high_n"), high.height, fanout).alias("folded"),
    )
    return out, root


def manifest_rows(docs: DataFrame, every: int = 7) -> DataFrame:
    """documents -> doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered rows), verified."""
    out, _ = manifest(docs, 2, tampered(every))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(_text(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _field(c: str) -> str:
    return f"coalesce(strlen(cast({c} AS VARCHAR)) || ':' || cast({c} AS VARCHAR), '-')"


#: The same rows in DuckDB: both trees level by level, then each leaf's way up.
MANIFEST_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, n_chars, text, coalesce('1' || lang, '0') AS g, doc_id IS NOT NULL AND {crc32_sql("cast(doc_id AS VARCHAR)")} % 7 = 0 AS hit FROM documents),
leaves AS (
  SELECT r, doc_id, g, sha256({" || ".join(map(_field, FIELDS))}) AS leaf,
    sha256({" || ".join(_field("(n_chars + CASE WHEN hit THEN 1 ELSE 0 END)" if c == "n_chars" else c) for c in FIELDS)}) AS found FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
low(level, g, i, digest, n) AS (
  SELECT 0, g, i, leaf, n FROM placed
  UNION ALL SELECT level + 1, g, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY level, g, i // 2),
tops AS (SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, i, digest, n) AS (
  SELECT 0, i, digest, n FROM tops
  UNION ALL SELECT level + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY level, i // 2),
way(r, g, level, tree, i, n, proof, folded) AS (
  SELECT r, g, 0, 'low', i, n, '', found FROM placed
  UNION ALL
  SELECT w.r, w.g, CASE WHEN w.tree = 'low' AND w.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN w.n = 1 THEN 'high' ELSE w.tree END,
    CASE WHEN w.n = 1 THEN t.i ELSE w.i // 2 END, CASE WHEN w.n = 1 THEN t.n ELSE (w.n + 1) // 2 END,
    w.proof || CASE WHEN w.n = 1 THEN '' ELSE coalesce(l.digest, h.digest, '') END,
    CASE WHEN w.n = 1 THEN w.folded WHEN w.i % 2 = 0 THEN sha256(w.folded || coalesce(l.digest, h.digest, '')) ELSE sha256(coalesce(l.digest, h.digest, '') || w.folded) END
  FROM way w LEFT JOIN tops t ON t.g = w.g
    LEFT JOIN low l ON w.tree = 'low' AND l.level = w.level AND l.g = w.g AND l.i = xor(w.i, 1)
    LEFT JOIN high h ON w.tree = 'high' AND h.level = w.level AND h.i = xor(w.i, 1)
  WHERE w.n > 1 OR w.tree = 'low')
SELECT p.doc_id, p.leaf, t.digest AS subroot, z.digest AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = z.digest AS verified
FROM placed p JOIN tops t USING (g) JOIN way w ON w.r = p.r AND w.tree = 'high' AND w.n = 1, (SELECT digest FROM high WHERE n = 1) z
"""
