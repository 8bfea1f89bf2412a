"""Claims of a trace against its recorded tool results."""

import json

from tracewell.operators import claims


def test_check_trace(spark):
    ok, bad = json.dumps({"exit_code": 0, "stdout": "Score=91 fine"}), json.dumps({"is_error": True, "stderr": "no"})
    rows = [
        ("a", 1, "decision", None, None, "All tests pass and the build passed.", "I think it compiles"),
        ("a", 2, "tool_call", "run_build", json.dumps({"exit_code": 2}), "build passed", None),
        ("a", 3, "tool_call", "run_build", ok, None, None),
        ("a", 4, "tool_call", "git_push", bad, None, None),
        ("a", 5, "output", None, None, "I pushed it; it scored well", None),
        ("a", 6, "tool_call", "fetch", None, None, "Just a thought"),
        ("b", 1, "output", None, None, "Tests passed", None),
        ("b", 2, "tool_call", "", "plain text", None, None),
    ]
    df = spark.createDataFrame(rows, "session_id string, pos long, type string, tool_name string, tool_output string, output_data string, reasoning string")
    checked = claims.check_trace(df).cache()
    got = {(r.session_id, r.pos, r.source, r.predicate): (r.verdict, r.proof_pos) for r in checked.collect()}
    assert got == {
        ("a", 1, "narration", "tests:pass"): ("unverifiable", None),
        ("a", 1, "narration", "build:pass"): ("verified", 3),
        ("a", 1, "reasoning", "build:pass"): ("verified", 3),
        ("a", 2, "tool_invocation", "tool:run_build"): ("contradicted", 2),
        ("a", 3, "tool_invocation", "tool:run_build"): ("verified", 3),
        ("a", 4, "tool_invocation", "tool:git_push"): ("contradicted", 4),
        ("a", 5, "narration", "push"): ("contradicted", 4),
        ("a", 5, "narration", "score:green"): ("verified", 3),
        ("a", 6, "tool_invocation", "tool:fetch"): ("unverifiable", None),
        ("a", 6, "reasoning", "narrative"): ("unverifiable", None),
        ("b", 1, "narration", "tests:pass"): ("unverifiable", None),
        ("b", 2, "tool_invocation", "tool:<unknown>"): ("verified", 2),
    }
    gaps = {r.session_id: (r.gaps, r.within) for r in claims.instrumentation_gaps(checked, 2).collect()}
    assert gaps == {"a": (3, False), "b": (1, True)}
    integrity = {r.session_id: (r.verified, r.contradicted, r.integrity) for r in claims.claim_integrity(checked).collect()}
    assert integrity == {"a": (4, 3, round(4 / 7, 6)), "b": (1, 0, 1.0)}
