"""Secrets, quality rules, language ID: results of a row depend on that row alone."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_corpus import rows, sha, words

from histlens.llm import langid, quality, secrets


def brute_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def test_secrets(docs, none):
    got = secrets.digest(secrets.find_secrets(docs)).collect()
    text = {}
    for d in rows():
        text.setdefault(d[0], d[1])
    assert len(got) == len(rows())
    for r in got:
        base = brute_spans(text[r["doc_id"]])
        assert r["base_sha256"] == sha(",".join(base))
        assert [x for x in r["spans"].split(",") if x and not x.startswith("guess")] == base
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))
    special = next(r for r in got if r["doc_id"] == 38)
    assert (special["n_assign"], special["n_access"], special["n_hex"], special["n_guess"]) == (2, 1, 1, 3)
    assert secrets.digest(secrets.find_secrets(none)).count() == 0


def brute_cost(value, ranks):
    """The least over all cuts, each piece of a cut tried as every kind of segment, from the definitions alone."""
    beside = lambda a, b: any(b == row[x] for y, row in enumerate(secrets.KEY_ROWS) for x in range(len(row)) for k, d in near_places(a) if (y, x) == (k, d))
    place = {c: (y, x) for y, row in enumerate(secrets.KEY_ROWS) for x, c in enumerate(row)}

    def near_places(c):
        if c not in place:
            return []
        y, x = place[c]
        return [(y, x - 1), (y, x + 1), (y - 1, x), (y - 1, x + 1), (y + 1, x), (y + 1, x - 1)]

    def kinds(piece):
        low = piece.lower()
        plain = low.translate(secrets.LEET)
        yield sum(math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33) for c in piece)
        if len(piece) > 1 and plain in ranks:
            caps = sum(c.isupper() for c in piece)
            yield math.log10(ranks[plain]) + math.log10(2) * ((1 if caps in (1, len(piece)) else caps) + sum(a != b for a, b in zip(low, plain, strict=True)))
        if re.fullmatch(r"(19|20)\d\d", piece):
            yield math.log10(200)
        for sep in ("", "-", "/", "."):
            for form in (f"(19|20)\\d\\d{re.escape(sep)}(0[1-9]|1[0-2]){re.escape(sep)}(0[1-9]|[12]\\d|3[01])", f"(0[1-9]|[12]\\d|3[01]){re.escape(sep)}(0[1-9]|1[0-2]){re.escape(sep)}(19|20)\\d\\d"):
                if re.fullmatch(form, piece):
                    yield math.log10(200 * 365.25) + (math.log10(4) if sep else 0)
        if len(piece) >= 3 and all(beside(a, b) for a, b in zip(low, low[1:], strict=False)):
            ways = [(place[b][0] - place[a][0], place[b][1] - place[a][1]) for a, b in zip(low, low[1:], strict=False)]
            yield math.log10(47 * len(piece)) + math.log10(4) * (1 + sum(a != b for a, b in zip(ways, ways[1:], strict=False)))
        for p in range(1, len(piece) // 2 + 1):
            k = len(piece) // p
            if len(piece) % p == 0 and piece == piece[:p] * k and k >= (2 if p > 1 else 3):
                yield whole(piece[:p]) + math.log10(k)

    def whole(v):
        if v not in known:
            known[v] = min(sum(piece_cost(v[a:b]) for a, b in zip((0, *cut), (*cut, len(v)), strict=True)) for r in range(len(v)) for cut in itertools.combinations(range(1, len(v)), r)) if v else 0.0
        return known[v]

    def piece_cost(piece):
        if piece not in pieces:
            pieces[piece] = min(kinds(piece)) + secrets.SEGMENT
        return pieces[piece]

    known, pieces = {}, {}
    return whole(value)


def test_guess_cost_is_the_least_of_all_cuts():
    rng = __import__("random").Random(3)
    parts = ["love", "Pa55", "qwe", "rty", "wert", "1999", "2024", "12-31", "aa", "ab", "abab", "me", "45", "x", "!", "zz", "111", "1999-12-31", "asdf", "xyz"]
    values = ["45me45", "lovewert", "abcabc", "aaaa", "aabaab", "20240506", "31.12.1999", "qwerfv", "p4ssw0rd", "abababab", "xyxyxyxy1", "MEme", "passpass12"]
    values += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))[:10] for _ in range(1500)]
    values += ["".join(rng.choice("ab1q!") for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    for v in values:
        assert abs(secrets.guess_cost(v) - brute_cost(v, secrets.RANKS)) < 1e-9, v


def test_the_corpus_is_the_dictionary(spark):
    """Frequent words of any language are cheap; a value beside a name that the patterns don't know is found."""
    prose = "Die Verbindung wurde geschlossen, el servidor responde; être (Verbindung) Verbindung. " * 5
    df = spark.createDataFrame([(1, prose + "login is Verbindung"), (2, "pwd=Verbindung7 passphrase: k9#Vt!x2Lq"), (3, None), (4, ""), (2, "pwd=Verbindung7 passphrase: k9#Vt!x2Lq")], "doc_id long, text string").withColumn("spans", __import__("pyspark").sql.functions.lit(1))
    assert secrets.frequent_words(df, 2) == ["verbindung", "die"] and secrets.frequent_words(df.limit(0)) == []
    got = [(r["doc_id"], [(s["kind"], s["start"]) for s in r["spans"]]) for r in secrets.find_secrets(df).orderBy("doc_id").collect()]
    assert got == [(1, []), (2, [("guess", 28)]), (2, [("guess", 28)]), (3, []), (4, [])]
    assert {r["n_assign"] for r in secrets.digest(secrets.find_secrets(df)).collect()} == {0}


def test_guess_cost_orders():
    cost = secrets.guess_cost
    assert cost("") == 0 and cost("aaaaaaaaaaaa") < 5 and cost("abcabcabcabc") < cost("abcxyzqrsjkw")
    assert cost("qwertyuiop") < cost("qpwoeiruty") and cost("1999-12-31") < cost("7391-82-46") and cost("password") < 2
    assert math.isfinite(cost("x1$" * 5000))


def test_quality(docs, none):
    text = {d[0]: d[1] for d in rows()}
    got = quality.apply_policy(quality.ledger(docs), quality.POLICIES["v1"]).collect()
    assert len(got) == len(rows()) and quality.ledger(none).count() == 0
    for r in got:
        t = text[r["doc_id"]] or ""
        w = words(t)
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(win)
        again = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(again))
        assert want == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_lines"], r["n_dup_lines"], r["n_repeat_words"])
        assert (r["fail_bits"] & 1 != 0) == (len(w) < 50) and (r["fail_bits"] & 2 != 0) == (100 * len(again) > 50 * len(w))
        assert r["kept"] == (r["fail_bits"] & quality.POLICIES["v1"] == 0)
        assert r["n_letters"] == sum(c.isalpha() or ord(c) > 126 or ord(c) < 32 for x in w for c in x)


def test_rules_on_lines_and_stop_words(spark):
    """Measurements, and the bits of the four rules after the first six."""
    prose = "the cat sat on the mat and looked to the end of it"
    cases = {
        None: ((0, 0, 0, 0), {"few_stop_words"}),
        "": ((0, 0, 0, 0), {"few_stop_words"}),
        prose: ((38, 0, 0, 4), set()),
        "\n".join(["- " + prose, "\t\u2022 " + prose, "*" + prose]): ((3 * 38 + 1, 3, 0, 4), {"bullets"}),
        "\r\n".join([prose, "-", prose]): ((2 * 38, 1, 0, 4), set()),
        f"{prose}... \n\n{prose}\u2026\t": ((2 * 38 + 1, 0, 2, 4), {"ellipses"}),
        f"{prose}...\n{prose}.. .\n{prose}\n{prose}": ((4 * 38, 0, 1, 4), set()),
        "12 34 und 56": ((3, 0, 0, 1), {"few_letters", "few_stop_words"}),
        "The THE der \u00e9\u00e9": ((11, 0, 0, 1), {"few_stop_words"}),
    }
    led = quality.ledger(spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)], "doc_id long, text string, w string"))
    got = {r["doc_id"]: r for r in quality.apply_policy(led, quality.POLICIES["v2"]).collect()}
    for i, (measured, failed) in enumerate(cases.values()):
        r = got[i]
        assert (r["n_letters"], r["n_bullet_lines"], r["n_ellipsis_lines"], r["n_stop_words"]) == measured, i
        assert {x.name for x in quality.RULES[6:] if r["fail_bits"] & quality.BIT[x.name]} == failed, i
        assert r["kept"] == (r["fail_bits"] == 0)


def test_repeated_windows(spark):
    texts = ["a b c a b c", "a a a a", "a a a", "a b", "x " * 50 + "y", "a b c d a b c e a b c"]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 6, 1: 4, 2: 0, 3: 0, 4: 50, 5: 9}


def test_ablation(docs):
    led = quality.ledger(docs).persist()
    got = {r["rule"]: r for r in quality.ablation(led, quality.POLICIES["base"]).collect()}
    bits = [r["fail_bits"] & 3 for r in led.collect()]
    assert got["too_few_words"]["n_failed"] == sum(b & 1 for b in bits) and got["too_few_words"]["n_failed_alone"] == bits.count(1)
    assert got["too_few_words"]["n_kept_without"] == bits.count(0) + bits.count(1)


def test_gradients():
    m = langid.fresh(["a", "b"], 3)
    seq = np.random.default_rng(0).integers(0, 256, (5, 4)).astype(np.int16)
    seq[4, 0] = 256
    labels = np.array([0, 1, 1, 0])
    _, grads = langid.backward(m, seq, labels)
    for p, g in zip(m.params(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = p[at], 1e-2
        p[at] = old + e
        a, _ = langid.backward(m, seq, labels)
        p[at] = old - e
        b, _ = langid.backward(m, seq, labels)
        p[at] = old
        assert abs(g[at] - (a - b) / 2 / e) < 1e-3
    p = langid.probabilities(m, langid.states(m, seq)) * (seq < 256)[:, :, None]
    assert np.abs(p.sum(0) - langid.pooled(m, seq)[0]).max() < 1e-5


def plain_labels(m, text):
    """(language, mean probability) of one text: each piece by itself, a byte at a time, with the network's definition."""
    data = [256] * langid.CONTEXT + list(text.encode())
    data += [256] * (-len(text.encode()) % langid.SEGMENT + langid.CONTEXT)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    hid = m.u.shape[1]

    def read(k, seq):
        h, out = np.zeros(hid), []
        for b in seq:
            a, g = m.x[k][b].astype(float), h @ m.u[k].astype(float)
            z, r = sigmoid(a[:hid] + g[:hid]), sigmoid(a[hid : 2 * hid] + g[hid : 2 * hid])
            n = np.tanh(a[2 * hid :] + r * (g[2 * hid :] + m.c[k]))
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    total, count = np.zeros(len(m.langs)), 0
    for at in range(0, len(data) - 2 * langid.CONTEXT, langid.SEGMENT):
        seq = data[at : at + langid.SEGMENT + 2 * langid.CONTEXT]
        forth, back = read(0, seq), read(1, seq[::-1])[::-1]
        for k in range(langid.CONTEXT, langid.CONTEXT + langid.SEGMENT):
            if seq[k] < 256:
                e = np.exp(np.concatenate([forth[k], back[k]]) @ m.out + m.bias)
                total, count = total + e / e.sum(), count + 1
    return m.langs[int(total.argmax())], total.max() / count


def test_prediction_against_a_plain_network():
    m = langid.fresh(["a", "b", "c"], 4, seed=3)
    texts = ["x", "some words é of a text", "ab " * 31 + "c", "longer than many pieces " * 40, "exactly ninety-six bytes " * 3 + "and padding to be so."]
    got = langid.predict(m, [None, *texts, "12 !"], width=3)
    assert got[0] == got[-1] == ("und", 0.0)
    for t, (lang, score) in zip(texts, got[1:-1], strict=True):
        want = plain_labels(m, t)
        assert lang == want[0] and abs(score - want[1]) < 1e-4


def test_sample_takes_every_language_and_whole_texts(spark, monkeypatch):
    """A language in one row of a thousand is learned; rows are bounded by language; what stands after any number of characters counts."""
    seen = {}
    monkeypatch.setattr(langid, "train", lambda texts, langs: seen.update(texts=texts, langs=langs))
    rare = [(5000 + i, "12 " * 5000 + f"end{i}", "rare") for i in range(3)]
    df = spark.createDataFrame([(i, f"text {i}", "hot") for i in range(3000)] + rare + [(1, None, "none"), (2, "", "none"), (3, "x", None)], "doc_id long, text string, lang string")
    langid.fit(df, rows=40)
    assert Counter(seen["langs"]) == {"hot": 40, "rare": 3} and sum("end" in t for t in seen["texts"]) == 3


def test_language_id(spark):
    """Held-out accuracy on two invented languages; odd texts."""
    import random

    rng = random.Random(2)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(60))
    data = [(i, make(["ka", "lo", "mi"] if i % 2 else ["sch", "en", "tr"]), "ka" if i % 2 else "sch") for i in range(150)]
    data += [(200, None, "ka"), (201, "12 !", "ka"), (202, "", None), (203, "kalomi " * 3000, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(df.where(langid.fold() != 1))
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    held = [d for d in data if d[0] < 150 and zlib.crc32(str(d[0]).encode()) % 3 == 1]
    assert len(held) > 30 and np.mean([got[d[0]]["lang_pred"] == d[2] for d in held]) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (200, 201, 202))
    assert got[203]["lang_pred"] == "ka" and 0 <= got[203]["score"] <= 1
    kept = {r["doc_id"] for r in langid.accepted(df, model).collect()}
    assert kept & {200, 201, 202} == set() and 203 in kept and len(kept) > 140
    named = {r["doc_id"]: r["lang"] for r in langid.accepted(df, model, label="lang").collect()}
    assert named == {i: got[i]["lang_pred"] for i in kept} and named[203] == "ka"
    assert langid.fit(df.limit(0)).langs == [] and langid.identify(df, langid.fresh([])).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(df.limit(0), model).count() == 0
