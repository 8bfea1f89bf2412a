"""Edit scripts and hunks of two versions of a text."""

import random

from tracewell.functions import diffs
from tracewell.operators import sessions


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_scripts():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 14))] for _ in range(2))
        s = diffs.script(a, b)
        assert [x["line"] for x in s if x["op"] != "add"] == a and [x["line"] for x in s if x["op"] != "remove"] == b
        assert sum(x["op"] == "keep" for x in s) == plain_common(a, b) == diffs.common(a, b)
        assert all(a[x["old"] - 1] == x["line"] for x in s if x["old"]) and all(b[x["new"] - 1] == x["line"] for x in s if x["new"])


def test_hunks(spark):
    keep = [f"line {i}" for i in range(12)]
    cases = {
        "same": (keep, keep),
        "cosmetic": (keep + ["a  b"], keep + ["a b "]),
        "content": (keep + ["x"], keep + ["y"]),
        "structural": (keep, keep + ["import os"]),
        "two": (["x"] + keep + ["y"], ["z"] + keep + ["w"]),
        "near": (["x"] + keep[:3] + ["y"], ["z"] + keep[:3] + ["w"]),
        "reorder": (["p", "q", "r"], ["r", "p", "q"]),
    }
    df = spark.createDataFrame([(k, "\n".join(a), "\n".join(b)) for k, (a, b) in cases.items()], "id string, a string, b string")
    got = {}
    for r in diffs.hunks(df, "id", "a", "b").orderBy("id", "hunk").collect():
        got.setdefault(r.id, []).append((r.kind, r.added, r.removed))
    assert got == {"cosmetic": [("cosmetic", 1, 1)], "content": [("content", 1, 1)], "structural": [("structural", 1, 0)], "two": [("content", 1, 1)] * 2, "near": [("content", 2, 2)], "reorder": [("cosmetic", 1, 1)]}


def test_stuck_outputs(spark):
    rows = [("up", 1, "output", "a"), ("up", 2, "error", "zzz"), ("up", 3, "output", "ab"), ("flat", 1, "output", "aaa"), ("flat", 2, "tool_result", "aa"), ("flat", 3, "output", "aa"), ("one", 1, "output", "x")]
    df = spark.createDataFrame(rows, "session_id string, pos long, type string, text string")
    assert {r.session_id: r.growing for r in sessions.stuck_outputs(df).collect()} == {"up": True, "flat": False}


def test_unified_hunks(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -3,6 +3,7 @@ def f():\n keep\n-old line\n+new line\n+import os\n keep\n-  same   text\n+same text\n@@ -20,3 +21,2 @@\n-one\n-two\n+two\n+one\n\\ No newline at end of file"
    df = spark.createDataFrame([(1, diff), (2, "--- a\n+++ b\n-not in a hunk"), (3, None), (4, "@@ -1,2 +1,2 @@\n- a b\n+a  b")], "id int, diff string")
    got = [tuple(r) for r in diffs.unified_hunks(df, "id").orderBy("id", "change").drop("change").collect()]
    assert got == [
        (1, "structural", ["new line", "import os"], ["old line"], 4, 5), (1, "cosmetic", ["same text"], ["  same   text"], 6, 7), (1, "reorder", ["two", "one"], ["one", "two"], 20, 22), (4, "cosmetic", ["a  b"], [" a b"], 1, 2),
    ]
    verdicts = lambda **o: {r.id: r.meaningful for r in diffs.meaningful_unified(df, "id", **o).collect()}
    assert verdicts() == {1: True, 2: False, 3: False, 4: False}
    assert verdicts(substantive=False, least=2) == {1: True, 2: False, 3: False, 4: False} and verdicts(least=2)[1] is False
