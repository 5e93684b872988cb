"""Operators on DataFrames, against the in-memory kernel and the fixtures."""

import json
import random

import pytest
from fixtures import ALL, ERRORS, VERDICTS, history, text_of
from test_kernel import random_history

from histlens import queries
from histlens.functions import dsl
from histlens.model import SHIFT, Histories, Level, from_nested, to_nested
from histlens.operators import graph, reach, relations, validate
from histlens.plans import check as checks
from histlens.plans import saturation, witness
from histlens.plans.kernel import check_levels
from histlens.sources import generate, json_files

CASES = {**{k: v[0] for k, v in VERDICTS.items()}, **{f"error {k}": v[0] for k, v in ERRORS.items()}, "empty sessions": "/ /", "nothing": ""}


@pytest.fixture(scope="module")
def hs(spark):
    df = spark.createDataFrame([(k, text_of(v)) for k, v in CASES.items()], "h string, text string")
    return dsl.read_histories(df).persisted()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_all_levels_by_table(hs):
    got = {(r["h"], r["level"]): r["ok"] for r in checks.check(hs).collect()}
    for name, (_, passed) in VERDICTS.items():
        assert [x for x in ALL if got[name, str(x)]] == passed, name
    assert all(got["empty sessions", str(x)] for x in ALL)


@pytest.mark.parametrize("compat", [True, False])
@pytest.mark.parametrize("level", list(saturation.PLANS))
def test_joins_agree_with_kernel(spark, hs, level, compat):
    rng = random.Random(3)
    extra = [random_history(rng, 3, rng.choice([2, 3]), 3, 2) for _ in range(160)]
    for h in extra[60:]:  # some abort, most of them unread
        read = {w[0] for w in h.seen.values() if w}
        h.committed.update({t: rng.random() < (0.9 if t in read else 0.4) for t in h.committed})
    ev = [(f"r{k}", *e) for k, h in enumerate(extra) for e in h.events]
    tx = [(f"r{k}", t, c) for k, h in enumerate(extra) for t, c in h.committed.items()]
    more = Histories(spark.createDataFrame(ev, hs.events.schema), spark.createDataFrame(tx, "h string, txn long, committed boolean"), spark.createDataFrame([(f"r{k}", h.n_sessions) for k, h in enumerate(extra)], "h string, n_sessions int"))
    both = Histories(hs.events.union(more.events), hs.txns.union(more.txns), hs.hist.union(more.hist))
    want = {r["h"]: (r["ok"], r["error_kind"], r["error_level"], r["error_code"]) for r in checks.check(both, level, witness=False, compat=compat).collect()}
    got = {r["h"]: (r["ok"], r["error_kind"], r["error_level"], r["error_code"]) for r in saturation.check(both, level, compat).collect()}
    assert got == want and {True, False} <= {ok for ok, *_ in got.values()}


def test_first_errors(hs):
    got = {r["h"]: (r["code"], r["txn"], r["pos"]) for r in validate.first_error(hs).collect()}
    for name, (_, code, (s, t, p)) in ERRORS.items():
        if code != validate.NON_REPEATABLE:
            assert got[f"error {name}"] == (code, (s << SHIFT) + t, p)
    nrr = validate.non_repeatable_reads(hs, validate.resolve_reads(hs)).where("h = 'error non-repeatable'").collect()
    assert [(r["txn"], r["pos"], r["first_txn"]) for r in nrr] == [(3 << SHIFT, 1, 1 << SHIFT)]


def test_witnesses_hold(hs):
    sound = hs.where_histories(hs.hist.where("n_sessions > 1"))
    for level in (Level.SERIALIZABLE, Level.SNAPSHOT_ISOLATION, Level.PREFIX):
        for engine in checks.ENGINES:
            order = witness.order_rows(checks.check(sound, level, engine=engine), level)
            assert order.count() and witness.invalid_orders(sound, order, level).count() == 0
    bad = witness.order_rows(checks.check(sound, Level.SERIALIZABLE), Level.SERIALIZABLE).where("h = 'serial pair'").withColumn("i", -1 * __import__("pyspark").sql.functions.col("i"))
    assert witness.invalid_orders(sound.where_histories(sound.hist.where("h = 'serial pair'")), bad, Level.SERIALIZABLE).count() > 0


def test_wrong_prefix_orders(spark):
    """The third transaction reads after the second and before the fourth, wherever its own write stands."""
    hs = dsl.read_histories(spark.createDataFrame([("late", text_of("[x:=1] [y:=1] / [x==1 y==1 z:=1] / [x:=2]"))], "h string, text string"))
    ids = {"a": (1 << 32), "b": (1 << 32) + 1, "c": (2 << 32), "d": (3 << 32)}
    for names, why in (("abcd", set()), ("abdc", set()), ("dabc", set()), ("adbc", {"overwritten"}), ("bacd", {"visibility"}), ("acbd", {"visibility"}), ("abc", {"missing"})):
        order = spark.createDataFrame([("late", i, ids[k], True) for i, k in enumerate(names)], "h string, i int, txn long, is_write boolean")
        assert {r["why"] for r in witness.invalid_orders(hs, order, Level.PREFIX).collect()} == why, names


def test_witness_shapes(spark):
    texts = {"apart": "[x:=1] / [x==1] / [y:=1] / [y==1] / [z:=1]", "shared": "[x:=1] / [x==1] [y:=1] / [y==1]", "one": "[x:=1] [x==1 y:=1]"}
    hs = dsl.read_histories(spark.createDataFrame([(k, text_of(v)) for k, v in texts.items()], "h string, text string"))
    got = {(r["h"], r["level"]): r for r in checks.check(hs, "prefix", "serializable", "snapshot-isolation").collect()}
    for name, n in (("apart", 5), ("shared", 4), ("one", 2)):
        assert len(got[name, "serializable"]["commit_order"]) == len(got[name, "prefix"]["commit_order"]) == n
        assert len(got[name, "snapshot-isolation"]["split_order"]) == 2 * n


def test_nested_and_json_round_trips(spark, hs):
    want = {r["h"]: r["sessions"] for r in to_nested(hs).collect()}
    assert len(want["empty sessions"]) == 3 and len(want["nothing"]) == 1
    again = from_nested(to_nested(hs))
    assert rows(again.events) == rows(hs.events) and rows(again.txns) == rows(hs.txns) and rows(again.hist) == rows(hs.hist)
    for compact in (False, True):
        decoded = json_files.decode(json_files.encode(hs, compact))
        assert {r["h"]: r["sessions"] for r in decoded.collect()} == want


def test_json_shapes_and_errors(spark):
    data = '[[{"events":[["w",0,1],{"Read":{"variable":0,"version":null}}],"committed":true}]]'
    df = spark.createDataFrame([("raw", data), ("wrapped", json.dumps({"params": {"id": 3}, "info": "i", "data": json.loads(data)})), ("tag", '[[{"events":[["q",0,1]],"committed":true}]]'), ("bad", "{")], "h string, json string")
    got = {r["h"]: r for r in json_files.decode(df).collect()}
    assert got["raw"]["sessions"] == got["wrapped"]["sessions"] and got["wrapped"]["params"]["id"] == 3
    assert [(e["op"], e["variable"], e["version"]) for e in got["raw"]["sessions"][0][0]["events"]] == [("W", "0", 1), ("R", "0", None)]
    assert got["tag"]["message"] == "unknown event" and got["bad"]["message"] == "not a history"


def test_files(spark, tmp_path):
    (tmp_path / "a.hist").write_text("[x:=1]\n")
    (tmp_path / "b.txt").write_text("@")
    (tmp_path / "c.json").write_text('[[{"events":[["w",0,1]],"committed":true}]]')
    got = {r["h"].rsplit("/", 1)[1]: r for r in json_files.read(spark, str(tmp_path)).collect()}
    assert got["a.hist"]["sessions"] and got["c.json"]["sessions"] and (got["b.txt"]["line"], got["b.txt"]["column"]) == (1, 1)


def test_formats(hs):
    got = {r["h"]: r["text"] for r in dsl.format_histories(hs).collect()}
    for name, short in CASES.items():
        assert got[name] == dsl.format_sessions(dsl.parse(text_of(short))), name


def test_graphs(spark):
    e = spark.createDataFrame([("chain", i, i + 1) for i in range(9)] + [("loop", 1, 2), ("loop", 2, 3), ("loop", 3, 1), ("loop", 3, 4), ("self", 1, 1)], "h string, src long, dst long")
    closed = graph.closure(e)
    assert closed.where("h = 'chain'").count() == 45 and rows(graph.cyclic(closed)) == [("loop",), ("self",)]
    assert rows(graph.cycle_vertices(closed)) == [("loop", 1), ("loop", 2), ("loop", 3), ("self", 1)]
    assert rows(graph.cycle_edge(e, closed)) == [("loop", 1, 2), ("self", 1, 1)]
    levels = {(r["h"], r["v"]): r["level"] for r in graph.topo_levels(e).collect()}
    assert levels["chain", 9] == 9 and levels["loop", 4] is None
    base = graph.closure(spark.createDataFrame([("g", 1, 2), ("g", 3, 4)], e.schema))
    more = graph.incremental_closure(base, spark.createDataFrame([("g", 2, 3), ("g", 3, 5)], e.schema))
    assert {(1, 5), (2, 5), (3, 5), (1, 4)} <= {(r["src"], r["dst"]) for r in more.collect()}
    u = spark.createDataFrame([("u", 0, 1), ("u", 1, 2), ("u", 5, 6)], "h string, a long, b long")
    v = spark.createDataFrame([("u", i) for i in (0, 1, 2, 5, 6, 9)], "h string, v long")
    assert rows(graph.connected_components(u, v)) == [("u", 0, 0), ("u", 1, 0), ("u", 2, 0), ("u", 5, 5), ("u", 6, 5), ("u", 9, 9)]
    assert [r["block"] for r in graph.biconnected_components(u, v).orderBy("block").collect()] == [[0, 1], [1, 2], [5, 6], [9]]
    assert graph.blocks_overlap(graph.biconnected_components(u, v)).first()["overlap"]


def test_blocks():
    edges = [(0, 1), (0, 2), (1, 2), (0, 3), (3, 4), (3, 5)]
    cut, groups, alone = graph.blocks(list(range(7)), edges)
    assert cut == {0, 3} and {tuple(sorted(g)) for g in groups} == {(0, 1, 2), (0, 3), (3, 4), (3, 5)} and alone == [frozenset([6])]
    assert graph.blocks([0, 1], [(0, 1)]) == (set(), [], [frozenset([0, 1])])


def test_reader_before_writer_edges(spark):
    hs = dsl.read_histories(spark.createDataFrame([("h", text_of("[x:=1] / [x==1] / [x==1 x:=2]"))], "h string, text string"))
    resolved = validate.resolve_reads(hs)
    vis = graph.closure(relations.visibility_base(hs, resolved))
    got = rows(relations.read_write(hs, relations.write_read(resolved), vis))
    assert got == [("h", "x", 2 << SHIFT, 3 << SHIFT)]
    assert rows(relations.write_write(hs, relations.write_read(resolved), vis)) == [("h", "x", 1 << SHIFT, 3 << SHIFT)]


def test_generated(spark):
    made = generate.generate(spark, 20, 3, 4, 3, 3, seed=5)
    a, b = ({r["id"]: r["sessions"] for r in made.collect()} for _ in range(2))
    assert a == b and len(a) == 20 and all(len(s) == 3 and len(s[0]) == 4 for s in a.values())
    got = checks.check(generate.histories(made), "committed-read", witness=False)
    assert got.where("ok").count() == 20
    with pytest.raises(ValueError):
        generate.generate(spark, 1, 1, 0, 1, 1)


def test_generated_by_definition(spark):
    """Each history read in order: reads return what was latest before their transaction, at most one a variable; writes count up."""
    made = {r["id"]: r for r in generate.generate(spark, 30, 3, 3, 4, 5, seed=2).collect()}
    other = {r["id"]: r["sessions"] for r in generate.generate(spark, 5, 3, 3, 4, 5, seed=3).collect()}
    ops = []
    for r in made.values():
        count = dict.fromkeys("012", 0)
        first, *rest = (t for s in r["sessions"] for t in s)
        assert [(e["op"], e["variable"], e["version"]) for e in first["events"]] == [("W", x, 0) for x in "012"]
        for t in rest:
            before, read = dict(count), set()
            assert t["committed"] and len(t["events"]) == 5
            for e in t["events"]:
                if e["op"] == "R":
                    assert e["variable"] not in read and e["version"] == before[e["variable"]]
                    read.add(e["variable"])
                else:
                    count[e["variable"]] += 1
                    assert e["version"] == count[e["variable"]]
                ops.append(e["op"])
        assert r["seconds"] >= 0 and r["params"]["n_event"] == 5
    assert 0.25 < ops.count("R") / len(ops) < 0.5 and all(other[i] != made[i]["sessions"] for i in other)
    shape = lambda *a: [len(s) for s in generate.generate(spark, 1, *a).first()["sessions"]]
    assert shape(2, 1, 0, 3) == [1, 0] and shape(2, 1, 2, 0) == [3, 2] and shape(0, 1, 2, 2) == []


def test_large_versions(spark):
    """Unsigned 64-bit versions, in text and both JSON encodings."""
    top = (1 << 64) - 1
    text = f"[x:={top} y:={1 << 63}]\n---\n[x=={top} y=={1 << 63} z=={(1 << 63) - 1}]\n"
    assert dsl.format_sessions(dsl.parse(text)) == text
    with pytest.raises(dsl.ParseError):
        dsl.parse(f"[x:={top + 1}]\n")
    hs = dsl.read_histories(spark.createDataFrame([("h", text)], "h string, text string"))
    assert dsl.format_histories(hs).first()["text"] == text
    for compact in (False, True):
        made = json_files.encode(hs, compact)
        assert str(top) in made.first()["json"]
        assert rows(from_nested(json_files.decode(made)).events) == rows(hs.events)
    odd = spark.createDataFrame([(str(v), f'[[{{"events":[["w",0,{v}]],"committed":true}}]]') for v in (top + 1, -1)], "h string, json string")
    assert {r["message"] for r in json_files.decode(odd).collect()} == {"unknown event"}
    found = relations.write_read(validate.resolve_reads(hs)).where("variable <> 'z'").collect()
    assert {(r["src"], r["dst"]) for r in found} == {(1 << SHIFT, 2 << SHIFT)}


def test_verify(spark, tmp_path, capsys):
    from histlens import cli

    (tmp_path / "a.hist").write_text("[x:=1]\n---\n[x==1]\n")
    (tmp_path / "b.txt").write_text("[x:=1]!\n---\n[x==1]\n")
    (tmp_path / "c.json").write_text("{")
    cli._spark = lambda: spark
    assert cli.main(["verify", "--consistency", "serializable", str(tmp_path)]) == 1
    said = capsys.readouterr().out.splitlines()
    assert [x.split(" (")[0] for x in said] == ["a.hist: PASS", "b.txt: FAIL", "c.json: FAIL"] and "UncommittedWrite" in said[1]
    assert cli.main(["verify", "--consistency", "causal", "--json", str(tmp_path / "a.hist")]) == 0
    assert "SaturationOrder" in json.loads(capsys.readouterr().out)["witness"]
    assert cli.main(["generate", "--n-hist", "2", "--output-dir", str(tmp_path / "made")]) == 0
    made = json.loads((tmp_path / "made" / "1.json").read_text())
    assert made["params"]["id"] == 1 and len(made["data"]) == 3 and json_files.read(spark, str(tmp_path / "made")).where("message IS NULL").count() == 2


def test_unrolled_rounds_are_enough():
    """A further round of write-write order adds nothing to the SQL's last, on the tables compared."""
    import duckdb

    from histlens import sql

    con = duckdb.connect()
    con.sql("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    more = sql._with(f"SELECT count(*) FROM (SELECT h, src, dst FROM ({sql._ww('causal')}) EXCEPT SELECT h, src, dst FROM causal)", *sql._causal(), **sql.SOUND)
    assert con.sql(more).fetchall() == [(0,)]


def test_workload(spark):
    hs = generate.workload(spark, 3, 2, 3, 3)
    assert hs.events.count() == 54 and checks.check(hs, "committed-read", witness=False).where("ok").count() == 3


def test_causal_steps(hs):
    steps = checks.causal_steps(hs).where("h = 'lost update'").collect()
    assert {r["phase"] for r in steps} == {"vis", "ww"} or {r["phase"] for r in steps} == {"ww"}
    assert max(r["step"] for r in steps if r["phase"] == "ww") == max(r["step"] for r in steps)


def test_budget_gives_unknown():
    h = history(VERDICTS["write skew"][0])
    assert check_levels(h, [Level.SERIALIZABLE], budget=0)[Level.SERIALIZABLE].ok is None


def test_reach_says_what_the_closure_does(spark, hs):
    """On sound fixtures and a long chain: pairs, and cycles where there are any."""
    long = "[x:=1] " + " ".join(f"[y:={i}]" for i in range(200)) + " / [y==150] [x==1 y:=900]"
    more = dsl.read_histories(spark.createDataFrame([("long", text_of(long))], "h string, text string"))
    for part in (hs.where_histories(hs.hist.where("h NOT LIKE 'error%' AND n_sessions > 0")), more):
        resolved = validate.resolve_reads(part).where("w_txn IS NOT NULL")
        composed = reach.composed(reach.chain(part).unionByName(reach.edges_of(relations.write_read(resolved))))
        closed = graph.closure(relations.visibility_base(part, resolved, closed=False))
        assert rows(reach.pairs_of(part, composed)) == rows(closed)
        assert rows(reach.on_cycles(composed)) == rows(graph.cycle_vertices(closed))


def test_empty_tables(spark):
    hs = Histories(spark.createDataFrame([], "h long, txn long, pos long, op string, variable string, version long"), spark.createDataFrame([], "h long, txn long, committed boolean"), spark.createDataFrame([], "h long, n_sessions int"))
    assert checks.check(hs).count() == 0 and validate.first_error(hs).count() == 0
    assert all(saturation.check(hs, x).count() == 0 for x in saturation.PLANS)


def test_unknown_is_no_violation(spark):
    """Two sessions over the same variables: a search is needed, and with no nodes for it the strong levels stay open."""
    text = "[x:=1] [y:=2] / [x==1 y:=3] [x:=4]"
    hs = dsl.read_histories(spark.createDataFrame([("both", text_of(text))], "h string, text string"))
    open_ = checks.level_summary(hs, budget=0).first()
    assert (open_["strongest"], open_["first_failed"], open_["error_kind"]) == ("causal", None, None)
    assert [open_[x] for x in ("prefix", "snapshot_isolation", "serializable")] == [None] * 3
    settled = checks.level_summary(hs).first()
    assert (settled["strongest"], settled["first_failed"]) == ("serializable", None)
    for f in (checks.check, checks.level_summary, check_levels):
        assert __import__("inspect").signature(f).parameters["budget"].default is None


@pytest.fixture(scope="module")
def mixed(spark, hs):
    """The fixtures and random histories, sound or not."""
    rng = random.Random(11)
    extra = {f"r{k}": random_history(rng, 3, rng.choice([2, 4]), 3, 2) for k in range(80)}
    ev = [(k, *e) for k, h in extra.items() for e in h.events]
    tx = [(k, t, c) for k, h in extra.items() for t, c in h.committed.items()]
    n = [(k, h.n_sessions) for k, h in extra.items()]
    more = Histories(spark.createDataFrame(ev, hs.events.schema), spark.createDataFrame(tx, "h string, txn long, committed boolean"), spark.createDataFrame(n, "h string, n_sessions int"))
    both = Histories(hs.events.union(more.events), hs.txns.union(more.txns), hs.hist.union(more.hist)).persisted()
    return both, relations.write_read(validate.resolve_reads(both)).persist()


@pytest.fixture(scope="module")
def atomic(mixed):
    """All edges of atomic visibility, and their closure in pairs."""
    hs, wr = mixed
    vis = relations.visibility_base(hs, validate.resolve_reads(hs))
    edges = vis.union(relations.write_write(hs, wr, vis).select("h", "src", "dst")).distinct().persist()
    return edges, graph.closure(edges)


@pytest.mark.parametrize("most", [graph.MOST, 20, 0])
def test_first_edge_without_pairs(mixed, atomic, most, monkeypatch):
    """What the closure of all edges says, by histories in tasks or by tables of reach, with no closure of pairs."""
    hs, wr = mixed
    want = rows(graph.cycle_edge(*atomic))
    monkeypatch.setattr(graph, "closure", None)
    assert len(want) > 20 and rows(reach.first_edge(hs, wr, reach.cycles(reach.atomic_rows(hs, wr), most))) == want


def test_cycle_edge_lists_no_pairs(spark, monkeypatch):
    for module, name in ((graph, "closure"), (relations, "session_order")):
        monkeypatch.setattr(module, name, None)
    assert queries.cycle_edge(spark, "/root/testdata/sf0.001").count() == 0


@pytest.mark.parametrize("most", [graph.MOST, 20, 0])
def test_cycle_vertices_without_pairs(mixed, atomic, most):
    hs, wr = mixed
    assert rows(reach.cycles(reach.atomic_rows(hs, wr), most).select("h", "v")) == rows(graph.cycle_vertices(atomic[1]))


def test_cycle_vertices_lists_no_pairs(spark, monkeypatch):
    for module, name in ((graph, "closure"), (relations, "session_order")):
        monkeypatch.setattr(module, name, None)
    assert queries.cycle_vertices(spark, "/root/testdata/sf0.001").count() == 0


def test_components(spark, monkeypatch):
    """Two cycles with a vertex between, a vertex of its own, a long cycle, over several calls a task."""
    monkeypatch.setattr(graph, "CHUNK", 3)
    pairs = {"a": [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (5, 6)], "b": [(7, 7), (7, 8)], "c": [(i, (i + 1) % 3000) for i in range(3000)], "d": [(1, 2)]}
    e = spark.createDataFrame([(h, *p) for h, ps in pairs.items() for p in ps], "h string, src long, dst long")
    assert rows(graph.components(e)) == sorted([("a", 1, 1), ("a", 2, 1), ("a", 4, 4), ("a", 5, 4), ("b", 7, 7), *(("c", i, 0) for i in range(3000))], key=str)


def test_levels_of_a_long_chain(spark, monkeypatch):
    """A layer costs no job, and histories beyond a task's size have the same levels."""
    made = []
    monkeypatch.setattr(graph, "written", lambda df, name, f=graph.written: made.append(name) or f(df, name))
    pairs = {"long": [(i, i + 1) for i in range(400)], "loop": [(1, 2), (2, 3), (3, 2), (3, 4)], "fan": [(1, 3), (2, 3), (1, 2), (1, 3)]}
    e = spark.createDataFrame([(h, *p) for h, ps in pairs.items() for p in ps], "h string, src long, dst long")
    v = spark.createDataFrame([("alone", 5), ("fan", 1), ("fan", 9), ("loop", 7)], "h string, v long")
    got = rows(graph.topo_levels(e, v))
    fixed = [("alone", 5, 0), ("fan", 1, 0), ("fan", 2, 1), ("fan", 3, 2), ("fan", 9, 0), ("loop", 1, 0), ("loop", 2, None), ("loop", 3, None), ("loop", 4, None), ("loop", 7, 0)]
    assert got == sorted([*fixed, *(("long", i, i) for i in range(401))], key=str) and len(made) < 5
    short = e.where("h <> 'long'")
    for most in (0, 3):
        assert rows(graph.topo_levels(short, v, most)) == sorted(fixed, key=str)


def test_plain_read_write_is_the_general_one(spark, mixed, monkeypatch):
    hs, wr = mixed
    want = rows(relations.read_write(hs, wr, relations.visibility_base(hs, validate.resolve_reads(hs))))
    assert len(want) > 200 and rows(relations.plain_read_write(hs, wr)) == want
    monkeypatch.setattr(relations, "session_order", None)
    assert queries.rw_edges(spark, "/root/testdata/sf0.001").count() >= 0


def test_plain_write_write_is_the_general_one(spark, mixed, monkeypatch):
    hs, wr = mixed
    want = rows(relations.write_write(hs, wr, relations.visibility_base(hs, validate.resolve_reads(hs))))
    assert len(want) > 200 and rows(relations.plain_write_write(hs, wr)) == want
    monkeypatch.setattr(relations, "session_order", None)
    assert queries.ww_edges(spark, "/root/testdata/sf0.001").count() >= 0
