import duckdb
import pandas as pd

from leadflow.llm import chat


def test_every_participant_has_every_part(spark):
    rows = [(1, t, "ana" if t < 300 else "bob", f"m{t}") for t in range(600)] + [(2, None, "ana", f"n{i:03}") for i in range(300)] + [(2, 7, "bob", f"t{i:03}") for i in range(300)]
    out = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part_turns=256).collect()
    by = {(r["conv_id"], r["part"], r["perspective"]): r for r in out}
    assert len(out) == len(by) == 12 and set(by) == {(c, p, who) for c in (1, 2) for p in (0, 1, 2) for who in ("ana", "bob")}
    for c in (1, 2):
        assert [by[c, p, "bob"]["n_messages"] for p in range(3)] == [256, 256, 88]
        assert [by[c, p, "bob"]["n_target"] for p in range(3)] == [0, 212, 88]
        assert [by[c, p, "ana"]["n_target"] for p in range(3)] == [256, 44, 0] and by[c, 2, "ana"]["mask"] == []
    whole = "".join(by[1, p, "ana"]["text"] for p in range(3))
    assert [whole.count(f"\nm{t}<|end|>") for t in range(600)] == [1] * 600


def test_long_dialogue_with_a_late_speaker_equals_its_sql(spark):
    rows = [(1, t, "eve" if t == 999 else ["ana", "bob", "system"][t % 3], f"m{t} <|x") for t in range(1000)] + [(2, 0, "ana", f"n{i:05}") for i in range(2 * chat.PART_TURNS + 3)] + [(2, 1, "bob", None), (None, 3, None, "x"), (None, 3, None, "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.rotation_rows(frame)
    got = out.collect()
    whole = {r["perspective"]: r for r in got if r["conv_id"] == 1}
    assert set(whole) == {"ana", "bob", "eve"} and {r["n_messages"] for r in whole.values()} == {1000} and whole["eve"]["n_target"] == 1
    assert sum(r["conv_id"] == 2 for r in got) == 6 and chat.rotation_rows(frame.limit(0)).count() == 0
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64"})  # noqa: F841
    want = duckdb.sql(f"SELECT {', '.join(out.columns)} FROM ({chat.ROTATION_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_names_cannot_end_a_header(spark):
    rows = [(1, 0, "a|>\nb", "hi", "x"), (1, 1, "c<|d", "yo <|end|>", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    got = {r["perspective"]: r["text"] for r in chat.rotate(frame).collect()}
    assert got["c< |d"] == "<|user:a| > b|>\nhi<|end|>\n<|assistant|>\nyo < |end|><|end|>\n" and set(got) == {"a| > b", "c< |d"}
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "part"])  # noqa: F841
    out = chat.rotation_rows(frame)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, duckdb.sql(f"SELECT {', '.join(out.columns)} FROM ({chat.ROTATION_SQL})").fetchall()))
