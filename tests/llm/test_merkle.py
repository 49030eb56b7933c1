import hashlib
import zlib

import duckdb
import pandas as pd
import pytest

from leadflow.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars, *_):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes, fanout):
    """The root of some nodes and the siblings of each, level by level."""
    way, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j, i in enumerate(at):
            run = range(i - i % fanout, min(len(nodes), i - i % fanout + fanout))
            way[j].append(([nodes[x] for x in run if x < i], [nodes[x] for x in run if x > i]))
        nodes, at = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)], [i // fanout for i in at]
    return nodes[0], way


def brute(rows, fanout):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees.append((own, *climb([leaf(*r) for r in own], fanout)))
    root, high = climb([t[1] for t in trees], fanout)
    out = []
    for (own, sub, low), up in zip(trees, high):
        for r, way in zip(own, low):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            folded = leaf(*r[:4], r[4] + 1) if hit else leaf(*r)
            for left, right in way + up:
                folded = h(*left, folded, *right)
            out.append((r[0], leaf(*r), sub, root, h(*[x for a, b in way + up for x in a + b]), folded, folded == root))
    return sorted(out, key=repr)


def rows_of():
    rows = [(i, f"text {i} ☃" if i % 5 else None, ["en", "de", None, "é", "z"][(i * i) % 5], "s" if i % 3 else None, i if i % 4 else None, "x", "y") for i in range(60)]
    return rows + [(7, "other", "de", "s", 3, None, None), rows[8], rows[8], (None, None, None, None, None, None, None), (None, "a", "en", "", 0, "", ""), (-3, "w" * 200_000, "lone", "s", 200_000, "", "")]


@pytest.mark.parametrize("fanout", [2, 3])
def test_rows_equal_brute_force(spark, fanout):
    rows = rows_of()
    out, root = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), fanout, merkle.tampered(7))
    got = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], hashlib.sha256(r["proof"].hex().encode()).hexdigest(), r["folded"], r["folded"] == root) for r in out.collect()]
    want = brute(rows, fanout)
    assert sorted(got, key=repr) == want and len({w[6] for w in want}) == 2


def test_rows_equal_sql(spark):
    rows = rows_of()
    out = merkle.manifest_rows(spark.createDataFrame(rows, SCHEMA))
    documents = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64", "n_chars": "Int64"})  # noqa: F841
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == brute(rows, 2) == sorted(duckdb.sql(f"SELECT {', '.join(out.columns)} FROM ({merkle.MANIFEST_SQL})").fetchall(), key=repr)


def test_one_row_and_none(spark):
    (only,) = merkle.manifest_rows(spark.createDataFrame([(1, "a", "en", "s", 1, "", "")], SCHEMA)).collect()
    assert only["leaf"] == only["subroot"] == only["root"] and only["proof_sha256"] == h()
    assert merkle.manifest_rows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_on_the_way(spark):
    out = merkle.manifest_rows(spark.createDataFrame(rows_of(), SCHEMA))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Cartesian" not in plan
