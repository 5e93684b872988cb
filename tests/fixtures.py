"""Small histories and the levels they pass, strongest first. ``/`` separates sessions."""

from histlens.functions.dsl import parse
from histlens.model import Level
from histlens.plans.kernel import History

ALL = list(Level)
RC, RR, RA, CC, PC, SI, SER = ALL

#: name: (history, levels passed)
VERDICTS = {
    "serial pair": ("[x:=1 y:=1] / [x==1 y==1]", ALL),
    "dirty read": ("[x:=1]! / [x==1]", []),
    "non-repeatable": ("[x:=1] / [x:=2] / [x==1 x==2]", [RC]),
    "commit-order cycle": ("[x:=2 y:=1] / [x:=3 y==1] / [x==3 x==2]", []),
    "fractured": ("[x:=1 y:=1] / [y==1 x:=2 z:=1] / [x==1 z==1]", [RC, RR]),
    "causal cycle over seven": ("[x:=1 a:=1] / [x==1 y:=1] / [y==1 z:=1] / [z==1 a:=2] / [a==2 p:=1] / [p==1 q:=1] / [q==1 a==1]", [RC, RR, RA]),
    "causal cycle over six": ("[x:=1 b:=1] / [x==1 y:=1] / [y==1 z:=1] / [z==1 b:=2] / [b==2 c:=1] / [c==1 b==1]", [RC, RR, RA]),
    "stale crossover": ("[x:=1 y:=1] / [x==1 x:=2] / [y==1 y:=2] / [x==2 y==1] / [y==2 x==1]", [RC, RR, RA, CC]),
    "lost update": ("[x:=1] / [x==1 x:=2] / [x==1 x:=3]", [RC, RR, RA, CC, PC]),
    "write skew": ("[x:=1 y:=1] / [x==1 y:=2] / [y==1 x:=2]", [RC, RR, RA, CC, PC, SI]),
    "version-zero lost update": ("[x==0 x:=1] / [x==0 x:=2]", [RC, RR, RA, CC, PC]),
    "version-zero single": ("[x==0 x:=1]", ALL),
    "explicit zero writer": ("[x:=0] / [x==0 x:=1]", ALL),
    "newer then older": ("[x:=1] [x:=2] / [x==2] [x==1]", [RC, RR, RA]),
    "stale initial value": ("[a:=1] / [a==1 b:=1] / [b==1 a==?]", [RC, RR, RA, CC]),
    "clusters, one bad": ("[x:=1] / [x==1] / [a:=1 b:=1] / [a==1 b:=2] / [b==1 a:=2]", [RC, RR, RA, CC, PC, SI]),
    "disjoint writers": ("[x:=1] / [y:=1]", ALL),
    "same value, two transactions": ("[x:=5] / [x==5] [x==5]", ALL),
    "repeated external read": ("[x:=5] / [x==5 x==5]", []),
    "stale in one session": ("[x:=1] [x==0]", ALL),
    "stale, and an empty session": ("[x:=1] [x==0] /", [RC, RR, RA, CC]),
    "own overwritten read": ("[x:=1 x==1 x:=2]", []),
    "aborted conflict": ("[x==? x:=1]! / [x==? x:=2]", [RC, RR, RA, CC, PC]),
    "uninitialised after own write": ("[x:=1 x==?]", [RC]),
    "zero writer unseen": ("[x:=0] / [x==?]", ALL),
    "split but serial fails": ("[x:=1 y:=2] [y==2 x:=3] / [x==1 y:=4]", [RC, RR, RA, CC, PC, SI]),
}
#: name: (history, error code, (session, height, position))
ERRORS = {
    "incomplete": ("[a==?] / [a:=0] / [a==1]", "IncompleteHistory", (3, 0, 0)),
    "uncommitted": ("[a:=0]! / [a==0]", "UncommittedWrite", (2, 0, 0)),
    "overwritten": ("[a:=0 a:=1] / [a==0]", "OverwrittenRead", (2, 0, 0)),
    "local too early": ("[a:=0 a==1 a:=1]", "InconsistentLocalRead", (1, 0, 1)),
    "local before": ("[a==1 a:=1]", "InconsistentLocalRead", (1, 0, 0)),
    "non-repeatable": ("[x:=2] / [x:=3] / [x==2 x==3]", "NonRepeatableRead", (3, 0, 1)),
    "same version": ("[x:=1] / [x:=1]", "SameVersionWrite", (2, 0, 0)),
}


def text_of(short: str) -> str:
    """The text form: a session a line, ``---`` between."""
    return "---\n".join(f"{s.strip()}\n" if s.strip() else "" for s in short.split("/"))


def history(short: str) -> History:
    sessions = parse(text_of(short))
    events, committed = [], {}
    for s, txns in enumerate(sessions, 1):
        for t, txn in enumerate(txns):
            i = (s << 32) + t
            committed[i] = txn["committed"]
            events += [(i, p, e["op"], e["variable"], e["version"]) for p, e in enumerate(txn["events"])]
    return History(events, committed, len(sessions))
