import random

from leadflow.operators import similarity


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def score(a, b):
    return 2 * slow_lcs(a, b) / (len(a) + len(b)) if a or b else 0.0


def strings(rng, n):
    made = ["", "x", "honda cb 190 r", "☃ñ💡", "long " * 30]
    while len(made) < n:
        base = rng.choice(made)
        made.append("".join(c for c in base if rng.random() > 0.15) + "".join(rng.choice("abc 12") for _ in range(rng.randint(0, 4))))
    return made


def test_lcs_of_one_and_of_many():
    rng = random.Random(1)
    names = strings(rng, 60)
    held = similarity.Names.of(names)
    for a in strings(rng, 60) + ["q" * 63, "ab" * 32, "ab" * 40]:
        want = [slow_lcs(a, b) for b in names]
        assert [similarity.lcs(a, b) for b in names] == want == held.common(a).tolist()


def test_nearest_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(2)
    names = [(f"{i:04}", n) for i, n in enumerate(strings(rng, 220))] + [("9001", "x"), ("9002", "honda cb 190 r")]
    keys = list({*strings(rng, 60), "honda cb190r", "zzz", "", "long " * 25})
    for size in (256, 4):  # one or many blocks
        monkeypatch.setattr(similarity, "BLOCK", size)
        monkeypatch.setattr(similarity, "TOGETHER", 5)
        got = similarity.nearest(spark.createDataFrame([(k,) for k in keys * 2] + [(None,)], "key string"), spark.createDataFrame(names + [(None, "n"), ("9003", None)], "id string, name string"), 3).collect()
        want = {(k, p + 1, i, n, score(k, n)) for k in keys for p, (i, n) in enumerate(sorted(names, key=lambda x: (-score(k, x[1]), x[0]))[:3])}
        assert {(r["key"], r["place"], r["id"], r["name"], r["score"]) for r in got} == want and len(got) == len(want)


def test_few_names_and_none(spark):
    keys = spark.createDataFrame([("ab",)], "key string")
    names = spark.createDataFrame([("1", "abc")], "id string, name string")
    assert [(r["id"], r["place"]) for r in similarity.nearest(keys, names, 2).collect()] == [("1", 1)]
    assert similarity.nearest(keys, names.limit(0), 2).count() == 0 and similarity.nearest(keys.limit(0), names, 2).count() == 0


def test_far_blocks_are_not_opened():
    names = [f"{c * 12}{i}" for c in "abcdefgh" for i in range(40)]
    pivots = similarity.choose_pivots(names, 8)
    held, d = similarity.Names.of(names), {}
    for i, n in enumerate(names):
        d.setdefault(n[0], []).append([similarity.Names.of([n]).distance(p)[0] for p in pivots])
    shape = {"lo": [], "hi": [], "shortest": [], "longest": []}
    import numpy as np

    for rows in d.values():
        shape["lo"].append(np.min(rows, 0)), shape["hi"].append(np.max(rows, 0)), shape["shortest"].append(13), shape["longest"].append(14)
    shape = {k: np.array(v) for k, v in shape.items()}
    bound = similarity.upper_bounds(13, similarity.Names.of(pivots).distance("a" * 12 + "z"), shape)
    best = 2 * held.common("a" * 12 + "z") / (held.length + 13)
    assert all(best[[n[0] == c for n in names]].max() <= b + 1e-9 for c, b in zip(d, bound)) and (bound < 0.9).sum() >= 6
