import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pandas as pd

from leadflow.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, id string, part int, ids string"


def brute(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + v[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                children[tuple(v[: d - 1])].add(v[d - 1])
    out = []
    for path, cs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        ends = [c for c in sorted(cs) if len(whole[c]) == len(path)]
        out.append((
            min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(children[path]), sum(not children[p] for p in under),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def hard_rows():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "ça va ☃", "long " * 900]), "x", 1, "y") for c in (*range(0, 320, 3), 1000, 7005) for t in range(rng.randint(1, 8))]
    rows += [(c, t, "user", f"turn {t % 7}", None, None, None) for c in (400, 450, 499) for t in range(700 if c < 499 else 256)]  # longer than segments, and copies
    rows += [(600, None, "b", "late"), (600, None, "a", "early"), (600, 3, "a", "same"), (600, 3, "a", "same"), (None, 1, "user", "nobody"), (999, 0, "user", "alone"), (-5, 1, "user", "below")]  # ties, repeats, null ids
    rows = [(*r, "x", 1, "y")[:7] if len(r) == 4 else r for r in rows]
    rng.shuffle(rows)
    return rows


def test_nodes_equal_brute_force_and_sql(spark):
    rows = [r for r in hard_rows() if r[0] != -5]
    out = prefix_trie.prefix_nodes(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == brute(rows)
    conversations = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    assert sorted(duckdb.sql(f"SELECT {', '.join(out.columns)} FROM ({prefix_trie.NODES_SQL})").fetchall(), key=repr) == got


def test_empty_and_turnless(spark):
    assert prefix_trie.prefix_nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = next(c for c in range(501, 600) if zlib.crc32(str(c).encode()) % 6 >= 1)  # no conversation 500, and its only turn goes
    (root,) = prefix_trie.prefix_nodes(spark.createDataFrame([(lone, 0, "user", "x", "", 0, "")], SCHEMA)).collect()
    assert tuple(root)[:7] == (lone, 0, None, 1, 0, 1, 0) and root["ends_sha256"] == hashlib.sha256(str(lone).encode()).hexdigest()


def test_small_trees_and_runs_give_the_same(spark, monkeypatch):
    rows = hard_rows()[:400]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, prefix_trie.prefix_nodes(frame).collect()), key=repr)
    for name, value in (("TREE_KEYS", 3), ("RUN", 2), ("TURNS", 3), ("BLOCK_CHARS", 4)):
        monkeypatch.setattr(prefix_trie, name, value)
    assert sorted(map(tuple, prefix_trie.prefix_nodes(frame).collect()), key=repr) == want


def test_radix_tree_grows_and_compresses():
    rng = random.Random(1)
    letters = [bytes([i]) for i in range(256)]
    keys = [rng.choice(letters[: rng.choice([2, 5, 17, 49, 256])]) * 3 + rng.choice(letters) * 37 for _ in range(3000)] + [b"", b"z" * 20, b"z" * 60]
    tree = prefix_trie.RadixTree(lambda a, b: (a[0] + b[0],))
    stack = []
    want = defaultdict(int)
    for k in keys:
        k = k[: len(k) // 20 * 20]
        tree.insert(k, (1,))
        for d in range(0, len(k) + 1, 20):
            want[k[:d]] += 1
    assert {k: v[0] for k, v in tree.nodes()} == want
    stack.append(tree.root)
    while stack:
        node = stack.pop()
        inside = list(node.children.items())
        assert len(inside) <= node.children.most and all(child.path[0] == b for b, child in inside)
        stack.extend(child for _, child in inside)
    grown = prefix_trie.Small()
    seen = []
    for b in range(256):
        grown = grown.put(b, b)
        seen.append(type(grown).__name__)
    assert [seen[3], seen[4], seen[15], seen[16], seen[47], seen[48], seen[255]] == ["Small", "Medium", "Medium", "Indexed", "Indexed", "Full", "Full"]
    assert list(grown.items()) == [(b, b) for b in range(256)]
