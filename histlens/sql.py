"""DuckDB SQL for the registered queries."""

from __future__ import annotations

_SHIFT = 4294967296


def _events(stale: bool = False, all_committed: bool = False, lossy: bool = False, reused: bool = False, turned: bool = False) -> str:
    """CTEs e(h, txn, pos, op, variable, version), x(h, txn, committed), n(h, n_sessions), r (resolved reads), and what is derived from them."""
    version = "CASE WHEN op = 'W' THEN event_id + 1" + (" WHEN event_id % 11 = 0 AND prior > 0 THEN prior" if stale else "") + " ELSE last END"
    ok = "true" if all_committed else f"(h * 31 + (txn // {_SHIFT}) * 7 + txn % {_SHIFT}) % 13 <> 0"
    e = "SELECT h, txn, pos, op, variable, version % 997 AS version FROM e0 WHERE op = 'R' OR (version - 1) % 13 <> 0" if lossy else "SELECT * FROM e0"
    e = "SELECT h, txn, pos, op, variable, version % 7 AS version FROM e0" if reused else "SELECT h, txn, 1 - pos AS pos, op, variable, version FROM e0" if turned else e
    before = "OVER (PARTITION BY h, variable ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
ev AS (
  SELECT CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0) AS BIGINT) AS h, user_id % 4 AS u, ts, event_id,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'W' ELSE 'R' END AS op, CAST(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 5 AS VARCHAR) AS variable
  FROM events
), rk AS (
  SELECT *, dense_rank() OVER (PARTITION BY h ORDER BY u) AS s, row_number() OVER (PARTITION BY h, u ORDER BY ts, event_id) - 1 AS rn,
         last_value(CASE WHEN op = 'W' THEN event_id + 1 END IGNORE NULLS) {before} AS last
  FROM ev
), pr AS (
  SELECT *, last_value(CASE WHEN op = 'W' THEN coalesce(last, -1) END IGNORE NULLS) {before} AS prior FROM rk
), e0 AS (
  SELECT h, CAST(s * {_SHIFT} + rn // 2 AS BIGINT) AS txn, CAST(rn % 2 AS BIGINT) AS pos, op, variable, CAST({version} AS BIGINT) AS version FROM pr
), e AS MATERIALIZED ({e}
), x AS MATERIALIZED (
  SELECT h, txn, {ok} AS committed FROM (SELECT DISTINCT h, txn FROM e0)
), n AS MATERIALIZED (
  SELECT h, CAST(max(txn // {_SHIFT}) AS INTEGER) AS n_sessions FROM e0 GROUP BY h
), w0 AS (
  SELECT h, variable, version, max(struct_pack(txn := txn, pos := pos)) AS w FROM e WHERE op = 'W' GROUP BY ALL
), r AS MATERIALIZED (
  SELECT e.h, e.txn, e.pos, e.variable, e.version, CAST(CASE WHEN e.version IS NULL OR (e.version = 0 AND w IS NULL) THEN 0 ELSE w.txn END AS BIGINT) AS w_txn, w.pos AS w_pos
  FROM e LEFT JOIN w0 ON e.h = w0.h AND e.variable = w0.variable AND e.version = w0.version WHERE op = 'R'
), f AS MATERIALIZED (
  SELECT h, txn, variable, max_by(version, pos) AS version, max(pos) AS pos FROM e JOIN x USING (h, txn) WHERE op = 'W' AND committed GROUP BY h, txn, variable
), dup AS (
  SELECT h, txn, pos, lag(txn) OVER d AS other_txn, lag(pos) OVER d AS other_pos FROM e WHERE op = 'W' WINDOW d AS (PARTITION BY h, variable, version ORDER BY txn, pos)
), inc AS (
  SELECT h, txn, pos, variable, version FROM r WHERE w_txn IS NULL
), own AS (
  SELECT h, txn, pos, op, last_value(CASE WHEN op = 'W' THEN pos END IGNORE NULLS) OVER (PARTITION BY h, txn, variable ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own_pos FROM e
), loc AS (
  SELECT h, txn, pos, w_txn, w_pos FROM r JOIN own USING (h, txn, pos) WHERE own.op = 'R' AND version IS NOT NULL AND w_txn = txn AND own_pos IS DISTINCT FROM w_pos
), ex AS (
  SELECT r.*, f.pos AS final_pos FROM r LEFT JOIN f ON r.h = f.h AND r.w_txn = f.txn AND r.variable = f.variable WHERE w_txn <> 0
), v AS (
  SELECT h, 0 AS stage, txn, pos, 'SameVersionWrite' AS code FROM dup WHERE other_txn IS NOT NULL
  UNION ALL SELECT h, 1, txn, pos, 'IncompleteHistory' FROM inc UNION ALL SELECT h, 1, txn, pos, 'InconsistentLocalRead' FROM loc
  UNION ALL SELECT h, 2, txn, pos, 'UncommittedWrite' FROM ex WHERE final_pos IS NULL UNION ALL SELECT h, 2, txn, pos, 'OverwrittenRead' FROM ex WHERE final_pos <> w_pos
), first AS MATERIALIZED (
  SELECT h, v.code, v.txn, v.pos FROM (SELECT h, min(struct_pack(stage := stage, txn := txn, pos := pos, code := code)) AS v FROM v GROUP BY h)
), a AS (
  SELECT e.h, e.txn, e.pos, e.op, e.variable, struct_pack(t := r.w_txn, p := coalesce(r.w_pos, 0)) AS seen FROM e LEFT JOIN r USING (h, txn, pos)
), ae AS (
  SELECT *, coalesce(last_value(CASE WHEN op = 'W' THEN struct_pack(t := txn, p := pos) END IGNORE NULLS) OVER k, first_value(CASE WHEN op = 'R' THEN seen END IGNORE NULLS) OVER k) AS want
  FROM a WINDOW k AS (PARTITION BY h, txn, variable ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), nrr AS MATERIALIZED (
  SELECT h, txn, pos, seen.t AS w_txn, seen.p AS w_pos, want.t AS first_txn, want.p AS first_pos FROM ae WHERE op = 'R' AND want IS NOT NULL AND seen.t IS NOT NULL AND seen <> want
), so AS (
  SELECT a.h, a.txn AS src, b.txn AS dst FROM x a JOIN x b ON a.h = b.h AND a.txn // {_SHIFT} = b.txn // {_SHIFT} AND a.txn < b.txn UNION ALL SELECT h, CAST(0 AS BIGINT), txn FROM x
), wr AS MATERIALIZED (
  SELECT DISTINCT h, variable, w_txn AS src, txn AS dst FROM r WHERE w_txn <> txn
), wx AS MATERIALIZED (
  SELECT DISTINCT h, txn, variable FROM e WHERE op = 'W'
), vis AS MATERIALIZED (
  SELECT h, src, dst FROM so UNION SELECT h, src, dst FROM wr
), rcx AS (
  SELECT h, lag(w_txn) OVER (PARTITION BY h, txn, variable ORDER BY pos) AS prev, w_txn, txn FROM r WHERE w_txn <> txn AND w_txn <> 0
), rc AS MATERIALIZED (
  SELECT h, txn - 1 AS src, txn AS dst FROM x WHERE txn % {_SHIFT} > 0 UNION SELECT h, 0, CAST(unnest(range(1, n_sessions + 1)) AS BIGINT) * {_SHIFT} FROM n
  UNION SELECT h, w_txn, txn FROM rcx UNION SELECT h, prev, w_txn FROM rcx WHERE prev IS NOT NULL
)"""


def _ww(vis: str) -> str:
    return f"""
  SELECT a.h, a.variable, a.txn AS src, b.txn AS dst FROM wx a JOIN wx b ON a.h = b.h AND a.variable = b.variable AND a.txn <> b.txn
  WHERE EXISTS (SELECT 1 FROM {vis} g WHERE g.h = a.h AND g.src = a.txn AND g.dst = b.txn)
     OR EXISTS (SELECT 1 FROM wr JOIN {vis} g ON g.h = wr.h AND g.dst = wr.dst WHERE wr.h = a.h AND wr.variable = a.variable AND wr.src = b.txn AND wr.dst <> a.txn AND g.src = a.txn)"""


def _closure(name: str, edges: str) -> str:
    return f"{name}(h, src, dst) AS (SELECT h, src, dst FROM {edges} UNION SELECT t.h, t.src, g.dst FROM {name} t JOIN {edges} g ON t.h = g.h AND t.dst = g.src)"


def _with(final: str, *more: str, **kind: bool) -> str:
    return "WITH RECURSIVE " + ", ".join([_events(**kind), *more]) + "\n" + final


SOUND = {"stale": True, "all_committed": True}
#: Rounds of write-write order that the SQL unrolls; a test shows that a further one adds nothing on the tables compared.
ROUNDS = 3


def _atomic() -> list[str]:
    return [f"wwa AS MATERIALIZED ({_ww('vis')})", "atom AS MATERIALIZED (SELECT h, src, dst FROM vis UNION SELECT h, src, dst FROM wwa)"]


def _causal() -> list[str]:
    out = [_closure("c0", "vis")]
    for k in range(ROUNDS):
        out += [f"m{k} AS MATERIALIZED (SELECT * FROM c{k})", f"g{k} AS MATERIALIZED (SELECT h, src, dst FROM vis UNION SELECT h, src, dst FROM m{k} UNION SELECT h, src, dst FROM ({_ww(f'm{k}')}))", _closure(f"c{k + 1}", f"g{k}")]
    return [*out, f"causal AS MATERIALIZED (SELECT * FROM c{ROUNDS})"]


def _steps() -> list[str]:
    """What each round adds to visibility, in sound histories."""
    rounds = (f"SELECT DISTINCT h, {k} AS step, src, dst FROM ({_ww(f'm{k}')}) w WHERE NOT EXISTS (SELECT 1 FROM m{k} g WHERE g.h = w.h AND g.src = w.src AND g.dst = w.dst)" for k in range(ROUNDS))
    return [*_causal(), f"sn AS (SELECT h FROM n WHERE h NOT IN (SELECT h FROM first) AND h NOT IN (SELECT h FROM nrr)), st AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(rounds)}) SEMI JOIN sn USING (h))"]


def _verdict(depth: int) -> str:
    """From the first failing stage of: structure, read committed, repeatable read, atomic read or causal."""
    kinds = ["WHEN f.h IS NOT NULL THEN {0}", "WHEN c.h IS NOT NULL THEN {1}", "WHEN q.h IS NOT NULL THEN {2}", "WHEN l.h IS NOT NULL THEN {3}"][: depth + 1]
    level = "'atomic-read'" if depth == 3 else "'causal'"
    if depth == 4:
        kinds.append("WHEN l.h IS NOT NULL THEN {3}")
        kinds = ["WHEN f.h IS NOT NULL THEN {0}", "WHEN c.h IS NOT NULL THEN {1}", "WHEN q.h IS NOT NULL THEN {2}", "WHEN l.h IS NOT NULL THEN {3}"]

    def case(*values: str) -> str:
        return "CASE " + " ".join(k.format(*values) for k in kinds) + " END"

    loops = {3: "LEFT JOIN (SELECT DISTINCT h FROM tl WHERE src = dst) l ON l.h = n.h", 4: "LEFT JOIN (SELECT DISTINCT h FROM causal WHERE src = dst) l ON l.h = n.h"}.get(depth, "")
    ok = " AND ".join(f"{k}.h IS NULL" for k in ("f", "c", "q", "l")[: min(depth, 3) + 1])
    return f"""SELECT n.h, {ok} AS ok, {case("'NonAtomic'", "'Cycle'", "'NonAtomic'", "'Cycle'")} AS error_kind, CAST({case('NULL', "'committed-read'", 'NULL', level)} AS VARCHAR) AS error_level,
  CAST({case('f.code', 'NULL', "'NonRepeatableRead'", 'NULL')} AS VARCHAR) AS error_code
FROM n LEFT JOIN first f ON f.h = n.h LEFT JOIN (SELECT DISTINCT h FROM tr WHERE src = dst) c ON c.h = n.h LEFT JOIN (SELECT DISTINCT h FROM nrr) q ON q.h = n.h {loops}"""


def _search(halves: bool, exclusive: bool = False, tag: str = "") -> list[str]:
    """Frontier states of every history that passes the causal level: placed counts of four sessions and the last writer of five variables."""
    at = lambda s: "CASE " + s + " " + " ".join(f"WHEN {k} THEN st.p{k}" for k in (1, 2, 3, 4)) + " END"
    last = "CASE rd.v " + " ".join(f"WHEN {k} THEN st.l{k}" for k in range(5)) + " END"
    per = 2 if halves else 1
    write = "tx.half = 1" if halves else "true"
    placed = f"{at('rd.s')} <= {per} * rd.k"
    free = f"NOT EXISTS (SELECT 1 FROM rd WHERE rd.h = st.h AND list_contains(tx.ws, rd.v) AND rd.writer = {last} AND rd.reader <> tx.txn AND {placed})"
    move = f"(NOT ({write}) OR {free})"
    if exclusive:
        open_ = f"(({at('o.s')}) % 2 = 1 AND o.k = ({at('o.s')}) // 2)"
        move += f" AND (({write}) OR NOT EXISTS (SELECT 1 FROM t0 o WHERE o.h = st.h AND o.txn <> tx.txn AND {open_} AND list_has_any(o.ws, tx.ws)))"
    ready = " AND ".join(f"({'tx.half = 1 OR ' if halves else ''}st.p{k} >= {per} * tx.n{k})" for k in (1, 2, 3, 4))
    nexts = ", ".join(f"CAST(st.p{k} + (CASE WHEN tx.s = {k} THEN 1 ELSE 0 END) AS BIGINT)" for k in (1, 2, 3, 4))
    lasts = ", ".join(f"CASE WHEN {write} AND list_contains(tx.ws, {k}) THEN tx.txn ELSE st.l{k} END" for k in range(5))
    zeros = ", ".join(["CAST(0 AS BIGINT)"] * 9)
    shared = [] if tag else _frontier()
    return [
        *shared,
        f"t1{tag} AS MATERIALIZED (SELECT *, half, {per} * k + half AS place FROM t0, (SELECT unnest({[0, 1] if halves else [0]}) AS half))",
        f"st{tag}(h, p1, p2, p3, p4, l0, l1, l2, l3, l4) AS (SELECT h, {zeros} FROM cok UNION SELECT st.h, {nexts}, {lasts} FROM st{tag} st JOIN t1{tag} tx ON tx.h = st.h AND tx.place = {at('tx.s')} WHERE {ready} AND {move})",
        f"solved{tag} AS MATERIALIZED (SELECT DISTINCT st.h FROM st{tag} st JOIN (SELECT h, {per} * count(*) AS total FROM t0 GROUP BY h) c ON c.h = st.h AND p1 + p2 + p3 + p4 = total)",
    ]


def _frontier() -> list[str]:
    return [
        "cok AS MATERIALIZED (SELECT h FROM n WHERE n_sessions > 1 AND h NOT IN (SELECT h FROM first) AND h NOT IN (SELECT h FROM tr WHERE src = dst) AND h NOT IN (SELECT h FROM nrr) AND h NOT IN (SELECT h FROM causal WHERE src = dst))",
        f"need AS (SELECT h, dst AS txn, {', '.join(f'max(CASE WHEN src // {_SHIFT} = {k} THEN src % {_SHIFT} + 1 ELSE 0 END) AS n{k}' for k in (1, 2, 3, 4))} FROM causal GROUP BY h, dst)",
        f"t0 AS MATERIALIZED (SELECT x.h, x.txn, x.txn // {_SHIFT} AS s, x.txn % {_SHIFT} AS k, n1, n2, n3, n4, coalesce((SELECT list(CAST(variable AS BIGINT)) FROM wx WHERE wx.h = x.h AND wx.txn = x.txn), []) AS ws FROM x JOIN need USING (h, txn) JOIN cok USING (h))",
        f"rd AS MATERIALIZED (SELECT h, CAST(variable AS BIGINT) AS v, src AS writer, dst AS reader, dst // {_SHIFT} AS s, dst % {_SHIFT} AS k FROM wr)",
    ]


def _searched(level: str) -> str:
    """The causal verdict, and Invalid for histories of several sessions without an accepting state."""
    return f"""SELECT c.h, c.ok AND (c.h NOT IN (SELECT h FROM cok) OR c.h IN (SELECT h FROM solved)) AS ok,
  CASE WHEN c.ok AND c.h IN (SELECT h FROM cok) AND c.h NOT IN (SELECT h FROM solved) THEN 'Invalid' ELSE error_kind END AS error_kind,
  CASE WHEN c.ok AND c.h IN (SELECT h FROM cok) AND c.h NOT IN (SELECT h FROM solved) THEN '{level}' ELSE error_level END AS error_level, error_code
FROM ({_verdict(4)}) c"""


def _summary() -> str:
    """level_summary(): every level's verdict, the strongest passed, the first failed and its error."""
    names = ("committed-read", "repeatable-read", "atomic-read", "causal", "prefix", "snapshot-isolation", "serializable")
    col = [x.replace("-", "_") for x in names]
    up_to = ["f.h IS NULL AND c.h IS NULL", "q.h IS NULL", "a.h IS NULL", "l.h IS NULL"]
    oks = [up_to[0], f"{up_to[0]} AND {up_to[1]}", f"{up_to[0]} AND {up_to[1]} AND {up_to[2]}", f"{up_to[0]} AND {up_to[1]} AND {up_to[3]}"]
    oks += [f"{oks[3]} AND (k.h IS NULL OR n.h IN (SELECT h FROM solved{t}))" for t in ("_pc", "_si", "_ser")]
    flags = ", ".join(f"({o}) AS {x}" for o, x in zip(oks, col, strict=True))
    last = "CASE " + " ".join(f"WHEN {x} THEN '{y}'" for x, y in reversed(list(zip(col, names, strict=True)))) + " END"
    first = "CASE " + " ".join(f"WHEN NOT {x} THEN '{y}'" for x, y in zip(col, names, strict=True)) + " END"
    return f"""SELECT h, {last} AS strongest, {first} AS first_failed,
  CASE WHEN code IS NOT NULL OR nr THEN 'NonAtomic' WHEN NOT causal OR NOT atomic_read THEN 'Cycle' WHEN NOT prefix OR NOT snapshot_isolation OR NOT serializable THEN 'Invalid' END AS error_kind,
  CASE WHEN code IS NOT NULL THEN code WHEN nr THEN 'NonRepeatableRead' END AS error_code, {", ".join(col)}
FROM (SELECT n.h, f.code, committed_order_fine AND q.h IS NOT NULL AS nr, {flags}
  FROM (SELECT n.h, n.h NOT IN (SELECT h FROM tr WHERE src = dst) AS committed_order_fine FROM n) n LEFT JOIN first f ON f.h = n.h LEFT JOIN (SELECT DISTINCT h FROM tr WHERE src = dst) c ON c.h = n.h
  LEFT JOIN (SELECT DISTINCT h FROM nrr) q ON q.h = n.h LEFT JOIN (SELECT DISTINCT h FROM tl WHERE src = dst) a ON a.h = n.h
  LEFT JOIN (SELECT DISTINCT h FROM causal WHERE src = dst) l ON l.h = n.h LEFT JOIN cok k ON k.h = n.h)"""


def _all_levels() -> list[str]:
    return [*_RC, *_atomic(), _closure("tl", "atom"), *_causal(), *_frontier(), *_search(True, False, "_pc"), *_search(True, True, "_si"), *_search(False, False, "_ser")]


_RC = [_closure("tr", "rc")]
_TXT = "t AS (SELECT h, txn, '[' || string_agg(variable || CASE WHEN op = 'W' THEN ':=' ELSE '==' END || coalesce(CAST(version AS VARCHAR), '?'), ' ' ORDER BY pos) || ']' || CASE WHEN committed THEN '' ELSE '!' END AS text FROM e JOIN x USING (h, txn) GROUP BY h, txn, committed)"
_PAGES = f"p AS (SELECT h, txn // {_SHIFT} AS s, string_agg(text || chr(10), '' ORDER BY txn) AS body FROM t GROUP BY ALL), page AS (SELECT h, string_agg(body, '---' || chr(10) ORDER BY s) AS text FROM p GROUP BY h)"
_COMM = f"ac AS (SELECT DISTINCT h, variable, txn // {_SHIFT} AS s FROM e), cg AS MATERIALIZED (SELECT DISTINCT p.h, p.s AS a, q.s AS b FROM ac p JOIN ac q ON p.h = q.h AND p.variable = q.variable AND p.s < q.s)"

#: Blocks by definition, for up to four sessions as bit sets: two that are linked, three that all are, four any three of which hang together;
#: the largest of them, and sessions without a link.
_BLOCKS = f"""vm AS (SELECT h, CAST(bit_or(1 << (txn // {_SHIFT} - 1)) AS INTEGER) AS everything FROM x GROUP BY h),
em AS (SELECT h, CAST((1 << (a - 1)) | (1 << (b - 1)) AS INTEGER) AS e FROM cg),
sm AS MATERIALIZED (SELECT v.h, v.m, bit_count(v.m) AS n, count(e) AS links FROM (SELECT h, everything, CAST(unnest(range(1, 16)) AS INTEGER) AS m FROM vm) v LEFT JOIN em ON em.h = v.h AND (em.e & v.m) = em.e WHERE (v.everything & v.m) = v.m GROUP BY v.h, v.m),
bi AS (SELECT h, m FROM sm WHERE (n = 2 AND links = 1) OR (n = 3 AND links = 3) OR (n = 4 AND NOT EXISTS (SELECT 1 FROM sm z WHERE z.h = sm.h AND z.n = 3 AND z.links < 2))),
blk AS MATERIALIZED (SELECT h, m FROM bi WHERE NOT EXISTS (SELECT 1 FROM bi z WHERE z.h = bi.h AND z.m <> bi.m AND (z.m & bi.m) = bi.m)
  UNION ALL SELECT h, m FROM sm WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM em WHERE em.h = sm.h AND (em.e & sm.m) = sm.m))"""
_LEX = r"-+|\[|\]|:=|==|\?|!|[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+|\r?\n|[ \t]+"

SQL: dict[str, str] = {
    "scan_events": _with("SELECT * FROM e"),
    "scan_transactions": _with("SELECT * FROM x"),
    "resolve_reads": _with("SELECT * FROM r"),
    "same_version_writes": _with("SELECT * FROM dup WHERE other_txn IS NOT NULL", reused=True),
    "final_writes": _with("SELECT * FROM f"),
    "incomplete_reads": _with("SELECT * FROM inc", lossy=True),
    "inconsistent_local_reads": _with("SELECT * FROM loc", turned=True),
    "dirty_reads": _with("SELECT h, txn, pos, w_txn, w_pos FROM ex WHERE final_pos IS NULL"),
    "overwritten_reads": _with("SELECT h, txn, pos, w_txn, w_pos, final_pos FROM ex WHERE final_pos <> w_pos", **SOUND),
    "non_repeatable_reads": _with("SELECT * FROM nrr", **SOUND),
    "first_error": _with("SELECT * FROM first", lossy=True),
    "session_order": _with("SELECT * FROM so"),
    "wr_edges": _with("SELECT * FROM wr"),
    "wr_union": _with("SELECT DISTINCT h, src, dst FROM wr"),
    "ww_edges": _with(_ww("vis"), **SOUND),
    "rw_edges": _with(
        """SELECT DISTINCT wr.h, wr.variable, wr.dst AS src, b.txn AS dst FROM wr JOIN wx b ON b.h = wr.h AND b.variable = wr.variable WHERE wr.src <> 0 AND b.txn <> wr.src AND b.txn <> wr.dst
  AND EXISTS (SELECT 1 FROM vis g WHERE g.h = wr.h AND g.dst = b.txn AND (g.src = wr.src OR g.src = wr.dst))""",
        **SOUND,
    ),
    "rc_order_edges": _with("SELECT * FROM rc", **SOUND),
    "edge_closure": _with("SELECT * FROM tc", "wu AS MATERIALIZED (SELECT DISTINCT h, src, dst FROM wr)", _closure("tc", "wu"), **SOUND),
    "vis_closure": _with("SELECT * FROM tc", _closure("tc", "vis"), **SOUND),
    "cycle_vertices": _with("SELECT h, src AS v FROM tl WHERE src = dst", *_atomic(), _closure("tl", "atom"), **SOUND),
    "cycle_edge": _with(
        "SELECT h, c.src, c.dst FROM (SELECT atom.h, min(struct_pack(src := atom.src, dst := atom.dst)) AS c FROM atom JOIN tl ON tl.h = atom.h AND tl.src = atom.dst AND tl.dst = atom.src GROUP BY atom.h)",
        *_atomic(), _closure("tl", "atom"), **SOUND,
    ),
    "topo_levels": _with(
        # the longest path to a vertex; one as long as there are vertices has been around a cycle, which ends at every vertex behind it within as many again
        "SELECT tp.h, tp.v, CAST(nullif(least(max(level), any_value(nv)), any_value(nv)) AS INTEGER) AS level FROM tp JOIN sz USING (h) GROUP BY tp.h, tp.v",
        f"sp AS MATERIALIZED (SELECT h, coalesce(lag(txn) OVER (PARTITION BY h, txn // {_SHIFT} ORDER BY txn), 0) AS src, txn AS dst FROM x UNION SELECT h, src, dst FROM wr)",
        "sz AS MATERIALIZED (SELECT h, count(*) + 1 AS nv FROM x GROUP BY h)",
        "tp(h, v, level) AS (SELECT DISTINCT h, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM sp UNION SELECT sp.h, sp.dst, level + 1 FROM tp JOIN sp ON sp.h = tp.h AND sp.src = tp.v JOIN sz ON sz.h = tp.h WHERE level < 2 * nv)",
    ),
    "comm_graph": _with("SELECT * FROM cg", _COMM),
    "connected_components": _with(
        "SELECT h, v, min(c) AS component FROM cc GROUP BY h, v", _COMM,
        f"cc(h, v, c) AS (SELECT DISTINCT h, txn // {_SHIFT}, txn // {_SHIFT} FROM x UNION SELECT cc.h, g.w, cc.c FROM cc JOIN (SELECT h, a AS u, b AS w FROM cg UNION ALL SELECT h, b, a FROM cg) g ON g.h = cc.h AND g.u = cc.v)",
    ),
    "biconnected_components": _with("SELECT h, array_to_string(list_filter([1, 2, 3, 4], lambda x: (m & (1 << (x - 1))) > 0), ',') AS block FROM blk", _COMM, _BLOCKS),
    "block_overlap": _with("SELECT h, sum(bit_count(m)) <> bit_count(bit_or(m)) AS overlap FROM blk GROUP BY h", _COMM, _BLOCKS),
    "check_rc": _with(_verdict(1), *_RC, **SOUND),
    "check_rr": _with(_verdict(2), *_RC, **SOUND),
    "check_ra": _with(_verdict(3), *_RC, *_atomic(), _closure("tl", "atom"), **SOUND),
    "check_causal": _with(_verdict(4), *_RC, *_causal(), **SOUND),
    "check_prefix": _with(_searched("prefix"), *_RC, *_causal(), *_search(halves=True), **SOUND),
    "check_si": _with(_searched("snapshot-isolation"), *_RC, *_causal(), *_search(halves=True, exclusive=True), **SOUND),
    "check_ser": _with(_searched("serializable"), *_RC, *_causal(), *_search(halves=False), **SOUND),
    "level_summary": _with(_summary(), *_all_levels(), **SOUND),
    "check_observed": _with(_summary(), *_all_levels()),
    "causal_steps": _with(
        """SELECT h, CAST(step AS INTEGER) AS step, 'vis' AS phase, src, dst FROM st
UNION ALL SELECT h, CAST(coalesce(max(step) + 1, 0) AS INTEGER), 'ww', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM sn LEFT JOIN st USING (h) GROUP BY h""",
        *_steps(), **SOUND,
    ),
    "invalid_witnesses": "SELECT CAST(NULL AS BIGINT) AS h, CAST(NULL AS VARCHAR) AS why, CAST(NULL AS VARCHAR) AS level WHERE false",
    "invalid_orders": _with(
        """SELECT DISTINCT v.h, 'visibility' AS why FROM vis v JOIN od a ON a.h = v.h AND a.txn = v.src JOIN od b ON b.h = v.h AND b.txn = v.dst WHERE a.i >= b.i
UNION SELECT DISTINCT wr.h, 'overwritten' FROM wr JOIN od a ON a.h = wr.h AND a.txn = wr.src JOIN od b ON b.h = wr.h AND b.txn = wr.dst
  JOIN wx ON wx.h = wr.h AND wx.variable = wr.variable AND wx.txn <> wr.src AND wx.txn <> wr.dst JOIN od c ON c.h = wx.h AND c.txn = wx.txn WHERE a.i < c.i AND c.i < b.i""",
        f"od AS MATERIALIZED (SELECT h, txn, row_number() OVER (PARTITION BY h ORDER BY txn % {_SHIFT}, txn) AS i FROM x UNION ALL SELECT h, 0, -1 FROM n)", **SOUND,
    ),
    "witness_pairs": _with("SELECT * FROM (SELECT h, row_number() OVER k - 1 AS i, txn AS src, lead(txn) OVER k AS dst FROM x WINDOW k AS (PARTITION BY h ORDER BY txn)) WHERE dst IS NOT NULL"),
    "format_txn": _with("SELECT * FROM t", _TXT),
    "format_txn_debug": _with("SELECT * FROM t", _TXT.replace("':='", "'<='").replace("'=='", "'=>'")),
    "tokenize_dsl": _with(
        """SELECT h, CAST(i - 1 AS INTEGER) AS i, CASE WHEN tok[1] = '-' THEN 'Dash' WHEN tok = '[' THEN 'BracketOpen' WHEN tok = ']' THEN 'BracketClose' WHEN tok = ':=' THEN 'ColonEquals' WHEN tok = '==' THEN 'DoubleEquals'
  WHEN tok = '?' THEN 'QuestionMark' WHEN tok = '!' THEN 'Bang' WHEN regexp_full_match(tok, '[0-9]+') THEN 'Integer' WHEN ends_with(tok, chr(10)) THEN 'Newline' WHEN trim(tok, ' ' || chr(9)) = '' THEN 'Whitespace' ELSE 'Ident' END AS kind,
  CAST(sum(length(tok)) OVER k - length(tok) AS INTEGER) AS start, CAST(sum(length(tok)) OVER k AS INTEGER) AS "end", tok AS text
FROM (SELECT h, unnest(ts) AS tok, generate_subscripts(ts, 1) AS i FROM lx) WINDOW k AS (PARTITION BY h ORDER BY i)""",
        _TXT, _PAGES, f"lx AS (SELECT h, regexp_extract_all(text, '{_LEX}') AS ts FROM page)",
    ),
    "format_history": _with("SELECT h, string_agg(body, '---' || chr(10) ORDER BY s) AS text FROM p GROUP BY h", _TXT, f"p AS (SELECT h, txn // {_SHIFT} AS s, string_agg(text || chr(10), '' ORDER BY txn) AS body FROM t GROUP BY ALL)"),
    "dictionary_encode": _with("SELECT h, variable, row_number() OVER (PARTITION BY h ORDER BY seen) - 1 AS id FROM (SELECT h, variable, min(struct_pack(t := txn, p := pos)) AS seen FROM e GROUP BY h, variable)"),
    "parse_dsl": _with("SELECT * FROM e"),
    "json_round_trip": _with("SELECT * FROM e"),
    "json_compact_round_trip": _with("SELECT * FROM e"),
}
for _level in ("rc", "rr", "ra", "causal"):
    SQL[f"check_{_level}_by_joins"] = SQL[f"check_{_level}"]
for _level in ("prefix", "si", "ser"):
    SQL[f"check_{_level}_by_ordering"] = SQL[f"check_{_level}"]
