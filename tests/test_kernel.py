import itertools
import random

import pytest
from fixtures import ALL, ERRORS, VERDICTS, history

from histlens.model import SHIFT, Level
from histlens.plans import ordering
from histlens.plans.kernel import History, Relations, check_levels, closed, saturate, topological


@pytest.mark.parametrize("name", VERDICTS)
def test_levels(name):
    text, passed = VERDICTS[name]
    got = check_levels(history(text))
    assert [x for x in ALL if got[x].ok] == passed


@pytest.mark.parametrize("name", ERRORS)
def test_errors(name):
    text, code, (s, t, p) = ERRORS[name]
    v = check_levels(history(text))[Level.REPEATABLE_READ]
    assert (v.ok, v.kind, v.code, v.where) == (False, "NonAtomic", code, ((s << SHIFT) + t, p))


def test_no_transactions_pass():
    for n in (0, 3):
        assert all(v.ok and v.order == [] for v in check_levels(History([], {}, n)).values())


def test_compat_off_allows_repeated_reads():
    assert check_levels(history("[x:=5] / [x==5 x==5]"), compat=False)[Level.SERIALIZABLE].ok


def test_compat_off_lifts_aborted_transactions():
    """An aborted write stands in nobody's way; reading it is an error still."""
    text = "[x:=1]! [x==?] / [x==?]"
    assert not check_levels(history(text))[Level.SERIALIZABLE].ok
    assert all(v.ok for v in check_levels(history(text), compat=False).values())
    assert all(v.ok and v.order == [] for v in check_levels(history("[x:=1]! / [y:=1]!"), compat=False).values())
    assert check_levels(history("[x:=1]! / [x==1]"), compat=False)[Level.COMMITTED_READ].code == "UncommittedWrite"
    gap = check_levels(history("[x:=1] [x:=2]! [x:=3] / [x==3] [x==1]"), compat=False)
    assert gap[Level.REPEATABLE_READ].ok and not gap[Level.CAUSAL].ok


def fits(rel: Relations, vis: list[int], level: Level, order: list[tuple[int, bool]]) -> bool:
    """Whether an order of all halves (or transactions), by index, keeps the level's rules."""
    n = len(rel.ids)
    at = {x: k for k, x in enumerate(order)}
    split = level != Level.SERIALIZABLE
    r = lambda i: at[i, not split]
    w = lambda i: at[i, True]
    if split and any(r(i) > w(i) for i in range(1, n)):
        return False
    if any(vis[i] >> j & 1 and w(i) > r(j) for i in range(1, n) for j in range(1, n)):
        return False
    for (x, src), readers in rel.readers.items():
        for t in readers:
            for other in rel.writers.get(x, ()):
                if other not in (src, t) and (src == 0 or w(src) < w(other)) and w(other) < r(t):
                    return False
    if level == Level.SNAPSHOT_ISOLATION:
        for a, b in itertools.combinations(range(1, n), 2):
            if rel.writes[a] & rel.writes[b] and not (w(a) < r(b) or w(b) < r(a)):
                return False
    return True


def brute(rel: Relations, vis: list[int], level: Level) -> bool:
    """Whether some order of all halves (or transactions) fits, by trying all orders."""
    halves = [(i, w) for i in range(1, len(rel.ids)) for w in ((False, True) if level != Level.SERIALIZABLE else (True,))]
    return any(fits(rel, vis, level, list(order)) for order in itertools.permutations(halves))


def random_history(rng: random.Random, sessions: int, txns: int, events: int, variables: int) -> History:
    out, committed, written, n = [], {}, {}, 0
    for s in range(1, sessions + 1):
        for t in range(txns):
            i = (s << SHIFT) + t
            committed[i] = True
            seen = set()
            for p in range(rng.randint(1, events)):
                x = f"x{rng.randrange(variables)}"
                if rng.random() < 0.5 and x not in seen:
                    pool = [None, *(v for w, v in written.get(x, ()) if w != i)]
                    out.append((i, p, "R", x, rng.choice(pool)))
                else:
                    n += 1
                    written.setdefault(x, []).append((i, n))
                    out.append((i, p, "W", x, n))
                seen.add(x)
    return History(out, committed, sessions)


@pytest.mark.parametrize("seed", range(4))
def test_search_against_all_orders(seed):
    rng = random.Random(seed)
    checked = {True: 0, False: 0}
    for _ in range(400):
        h = random_history(rng, 3, 1, 3, 2)
        got = check_levels(h)
        if not got[Level.CAUSAL].ok:
            continue
        rel = Relations(h)
        vis = saturate(rel)
        for level in (Level.PREFIX, Level.SNAPSHOT_ISOLATION, Level.SERIALIZABLE):
            want = brute(rel, vis, level)
            assert got[level].ok == want, (h.events, level)
            assert (ordering.solve(rel, vis, [1, 2, 3], level) is not None) == want, (h.events, level)
            checked[want] += 1
    assert min(checked.values()) > 5


@pytest.mark.parametrize("seed", range(4))
def test_engines_agree_and_order_by_the_rules(seed):
    """Beyond what all orders can tell: the same verdicts, and orders that keep every rule."""
    rng = random.Random(100 + seed)
    passed = {True: 0, False: 0}
    for k in range(300):
        h = random_history(rng, 4, rng.randint(1, 4), 3, 2 + k % 3)
        one, two = check_levels(h), check_levels(h, solve=ordering.solve)
        assert [(x, one[x].ok, one[x].kind, one[x].level) for x in ALL] == [(x, two[x].ok, two[x].kind, two[x].level) for x in ALL], h.events
        if not one[Level.CAUSAL].ok:
            continue
        rel = Relations(h)
        vis, members = saturate(rel), list(range(1, len(rel.ids)))
        for level in (Level.PREFIX, Level.SNAPSHOT_ISOLATION, Level.SERIALIZABLE):
            order = ordering.solve(rel, vis, members, level)
            assert order is None or (sorted(order) == sorted({*order}) and fits(rel, vis, level, order)), (h.events, level)
            passed[one[level].ok] += 1
    assert min(passed.values()) > 5


def test_ordering_out_of_budget_is_unknown():
    rng, unknown = random.Random(5), 0
    for _ in range(200):
        h = random_history(rng, 4, 3, 3, 2)
        full, cut = check_levels(h, solve=ordering.solve), check_levels(h, solve=ordering.solve, budget=0)
        for level in ALL:
            assert cut[level].ok in (None, full[level].ok)
            unknown += cut[level].ok is None
    assert unknown


def test_cyclic_facts_have_no_order():
    rel = Relations(history("[x:=1] / [y:=1]"))
    assert ordering.solve(rel, [0, 0b100, 0b010], [1, 2], Level.SERIALIZABLE) is None
    assert ordering.solve(rel, [0, 0, 0], [], Level.PREFIX) == []


def test_closure_of_cycles_and_long_chains():
    rows = [0b0010, 0b0100, 0b0001, 0]
    assert closed(rows) == [0b111, 0b111, 0b111, 0] and topological(rows) is None
    n = 5000
    chain = closed([1 << (i + 1) if i + 1 < n else 0 for i in range(n)])
    assert chain[0].bit_count() == n - 1


def test_stronger_levels_pass_weaker_ones():
    rng = random.Random(9)
    for _ in range(200):
        got = check_levels(random_history(rng, 3, 2, 3, 3))
        oks = [got[x].ok for x in (*ALL[:5], Level.SNAPSHOT_ISOLATION)]
        assert oks == sorted(oks, reverse=True)
        assert got[Level.SNAPSHOT_ISOLATION].ok or not got[Level.SERIALIZABLE].ok
