import json

import pytest
from fixtures import VERDICTS, text_of
from hypothesis import given, settings
from hypothesis import strategies as st

from histlens import cli
from histlens.functions import dsl
from histlens.model import Level
from histlens.plans.trace import trace_text


def test_sessions_and_transactions():
    assert [len(t["events"]) for t in dsl.parse("[x:=1 y:=1] [z==2 z:=3]\n[y:=3]\n")[0]] == [2, 2, 1]
    assert [len(s) for s in dsl.parse("[x:=1]\n---\n---\n[y:=2]\n")] == [1, 0, 1]
    assert len(dsl.parse("[x==1][y==1]\n")[0]) == 2
    assert dsl.parse("// just a comment\n") == [[]] and dsl.parse("") == [[]]
    assert dsl.parse("[x==?]!\n") == [[{"events": [{"op": "R", "variable": "x", "version": None}], "committed": False}]]


@pytest.mark.parametrize("text, line, column", [("[x:=1]\n@bad\n", 2, 1), ("[x:=1]", 1, 7), ("[]\n", 1, 2), ("[ x:=1]\n", 1, 2), ("[x:=1 ]\n", 1, 7), ("[x:=]\n", 1, 3), ("[x:=1]\r\n", 1, 7), ("[x=1]\n", 1, 3), ("[x:=18446744073709551616]\n", 1, 5)])
def test_errors_have_places(text, line, column):
    with pytest.raises(dsl.ParseError) as e:
        dsl.parse(text)
    assert (e.value.line, e.value.column) == (line, column)


EVENT = st.one_of(
    st.tuples(st.just("W"), st.from_regex(r"[a-z0-9_é]{1,4}", fullmatch=True), st.integers(0, 2**63 - 1)),
    st.tuples(st.just("R"), st.from_regex(r"[a-z0-9_é]{1,4}", fullmatch=True), st.one_of(st.none(), st.integers(0, 2**63 - 1))),
).map(lambda e: dict(zip(("op", "variable", "version"), e, strict=True)))
SESSIONS = st.lists(st.lists(st.fixed_dictionaries({"events": st.lists(EVENT, min_size=1, max_size=4), "committed": st.booleans()}), max_size=3), min_size=1, max_size=3)


@settings(max_examples=100, deadline=None)
@given(SESSIONS)
def test_round_trip(sessions):
    assert dsl.parse(dsl.format_sessions(sessions)) == sessions


def test_tokens():
    got = dsl.tokenize("// é\n[x:=1 y==?]!\r\n--- @")
    assert [k for k, *_ in got] == ["Comment", "Newline", "BracketOpen", "Ident", "ColonEquals", "Integer", "Whitespace", "Ident", "DoubleEquals", "QuestionMark", "BracketClose", "Bang", "Newline", "Dash", "Whitespace"]
    data = "// é\n[x:=1 y==?]!\r\n--- @".encode()
    assert all(data[a:b].decode() == t for _, a, b, t in got)


def test_fmt_command(tmp_path, capsys):
    f = tmp_path / "a.hist"
    f.write_text("// note\n[x:=1]   [y:=2]\n--\n[x==1]\n")
    assert cli.main(["fmt", "--check", str(tmp_path)]) == 1 and f.read_text().startswith("//")
    assert cli.main(["fmt", str(tmp_path)]) == 0 and f.read_text() == "[x:=1]\n[y:=2]\n---\n[x==1]\n"
    assert cli.main(["fmt", "--check", str(tmp_path)]) == 0


def test_schema_command(capsys):
    assert cli.main(["schema"]) == 0
    assert json.loads(capsys.readouterr().out)["items"]["type"] == "array"


def test_traces():
    out = json.loads(trace_text(text_of(VERDICTS["write skew"][0]), Level.SNAPSHOT_ISOLATION))
    assert out["ok"] and len(out["witness"]["SplitCommitOrder"]) == 6 and out["wr_edges"]
    bad = json.loads(trace_text(text_of(VERDICTS["write skew"][0]), "serializable"))
    assert not bad["ok"] and bad["error"]["kind"] == "Invalid" and bad["sessions"][1][0]["reads"] == {"x": 1}
    assert not json.loads(trace_text("@", "causal"))["ok"]
    with pytest.raises(ValueError):
        trace_text("[x:=1]\n", "strong")
