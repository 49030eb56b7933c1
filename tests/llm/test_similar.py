from itertools import combinations

import corpus_pipeline
from leadflow.llm import common, similar, simhash

NONE = -(2**63)


def plain_components(rows):
    """Smallest id reachable over pairs of five-word Jaccard similarity 0.8 or more, by comparing all pairs."""
    sets = [(NONE if d is None else d, frozenset(simhash.shingle_hashes(t, 5, 42))) for d, t in rows]
    up = {d: d for d, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (d, a), (e, b) in combinations(sets, 2):
        small, large = sorted((len(a), len(b)))
        if a == b or (5 * small >= 4 * large and 5 * len(a & b) >= 4 * len(a | b)):
            x, y = sorted((top(d), top(e)))
            up[y] = x
    return {d: top(d) for d in up}


def test_stage_finds_what_brute_force_finds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()]
    assert sorted(kept) == sorted(d for d, c in want.items() if d == c)


def test_edges_of_the_contract(spark, docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    words = [f"w{i * i}" for i in range(60)]
    for i in range(40):  # a chain in which not all pairs are similar, and texts just under the bound
        now = list(words)
        now[i : i + 1 + i % 3] = ["x"] * (1 + i % 3)
        rows.append((100 + i, " ".join(now)))
    shared = [(200, "one text"), (200, "another text of the same id"), (201, "Another TEXT of the same id"), (None, "text without an id, one"), (None, "text without an id, two")]
    got = similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_components(rows)
    assert len(got) == len(rows) and similar.near_duplicates(empty).count() == 0
    assert {(NONE if r["doc_id"] is None else r["doc_id"]): (NONE if r["component_id"] is None else r["component_id"]) for r in got} == want
    for keep in (similar.keep_first, simhash.keep_first):  # a text stays unless it is like another one, whatever its id
        out = keep(spark.createDataFrame(shared + shared[:1], "doc_id long, text string")).collect()
        assert sorted((r["doc_id"] or 0, r["text"]) for r in out) == sorted((d or 0, t) for d, t in shared if d != 201)
    kept = similar.keep_first(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None if d == NONE else d for d, c in plain_components([(r["doc_id"], r["text"]) for r in docs.collect()]).items() if d == c}


def test_a_large_group_of_near_copies_does_not_make_all_its_pairs(spark, monkeypatch):
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(240):  # each is near the first, and two of them are similar only if they change like words
        now = list(words)
        for j in (i % 7, 40 + i % 11):
            now[j] = f"x{i}"
        rows.append((i, " ".join(now)))
    made = []
    plain = similar._met
    monkeypatch.setattr(similar, "_met", lambda *a: made.append(plain(*a)) or made[-1])
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)
    assert sum(m.count() for m in made) < 240 * 239 // 20


def test_maps_of_keys_miss_none(spark):
    df = spark.range(20000).selectExpr("id", "cast(id as string) as name")
    keys = df.where("id % 100 = 7")
    told = common.may_be_among(df, keys, ["id", "name"]).selectExpr("id % 100 = 7 as real", "_maybe").groupBy("real", "_maybe").count().collect()
    found = {(r["real"], r["_maybe"]): r["count"] for r in told}
    assert found[True, True] == 200 and (True, False) not in found and found.get((False, True), 0) < 20
