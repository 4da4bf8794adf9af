import duckdb
import pyarrow as pa

from cloister.llm.chat import OP1_SQL, format_chats

SCHEMA = "conv_id long, turn long, role string, text string, rendered string"


def _run(spark, rows):
    return {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}


def _oracle(rows):
    conversations = pa.table({k: [r[i] for r in rows] for i, k in enumerate(("conv_id", "turn", "role", "text"))})  # noqa: F841
    return {r[0]: (r[1], r[2]) for r in duckdb.sql(OP1_SQL).fetchall()}


def test_snapshots_collapse(spark):
    rows = [
        (1, 0, "user", "a", "x"), (1, 1, "assistant", "b", "x"),
        (2, 0, "user", "a", "x"), (2, 1, "assistant", "b", "x"), (2, 2, "user", "c", "x"),
        (3, 0, "user", "a", "x"), (3, 1, "assistant", "other", "x"),
        (4, 0, "user", "a", "x"),
        (5, 5, "user", "a", "x"), (5, 6, "assistant", "b", "x"), (5, 9, "user", "c", "x"),  # a copy of 2
        (6, 0, "user", "a", "x"), (6, 0, "user", "a", "x"), (6, 1, "assistant", "z", "x"),  # a repeated row
    ]
    got = _run(spark, rows)
    assert set(got) == {2, 3, 6}
    assert got[2] == (3, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n")
    assert got == _oracle(rows)


def test_nulls_ties_and_empty(spark):
    rows = [
        (1, None, "user", None, "x"), (1, 0, None, "", "x"),
        (2, 0, "user", "", "x"),
        (3, 0, "user", "b", "x"), (3, 0, "user", "a", "x"),  # tied turns are put in order of their text
        (None, 0, "user", "q", "x"),
        (7, 0, "user", "long " * 200_000, "x"),
    ]
    got = _run(spark, rows)
    assert set(got) == {1, 2, 3, None, 7}  # an empty text is not a null one
    assert got[1][1] == "<|im_start|>user\n<|im_end|>\n<|im_start|>unknown\n<|im_end|>\n"
    assert got[3][1].index("a<|") < got[3][1].index("b<|")
    assert _run(spark, []) == {}


def test_hot_first_turn(spark):
    rows = [(i, 0, "user", "hello", "x") for i in range(3000)] + [(i, 1, "assistant", str(i % 7), "x") for i in range(1000)]
    got = _run(spark, rows)
    assert set(got) == set(range(7))


def test_rows_without_conversation_are_their_own(spark):
    rows = [(None, k, "user", "same", "x") for k in range(5)] + [(None, 1, "user", "lone", "x"), (None, 1, None, None, "x"), (None, 2, "user", "first", "x"), (4, 0, "user", "first", "x"), (4, 1, "user", "b", "x"), (9, 0, "user", "same", "x")]
    found = [(r["conv_id"], r["n_turns"], r["rendered"]) for r in format_chats(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted((c, n, t.split("\n")[1][:-10]) for c, n, t in found if c is not None) == [(4, 2, "first"), (9, 1, "same")]
    assert sorted(t.split("\n")[1][:-10] for c, n, t in found if c is None) == ["", "lone"]
    conversations = pa.table({k: [r[i] for r in rows] for i, k in enumerate(("conv_id", "turn", "role", "text"))})  # noqa: F841
    assert sorted(map(str, found)) == sorted(str(r[:3]) for r in duckdb.sql(OP1_SQL).fetchall())


def test_long_conversation(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"turn {k}", "x") for k in range(5000)] + [(2, k, "user" if k % 2 else "assistant", f"turn {k}", "x") for k in range(4999)]
    assert _run(spark, rows).keys() == {1}
