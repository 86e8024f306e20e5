import hashlib
import random
import re

import pytest

from weftline.llm import queries
from weftline.llm import secretscan as S
from weftline.llm.automata import Automaton


def plain(text, rules=S.RULES):
    """By Python's regular expressions, rule by rule."""
    out = []
    for k, r in enumerate(rules):
        for m in re.finditer(f"(?:{r.head})(?P<value>{r.value})", text or "", re.ASCII):
            if len(m["value"]) >= r.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_against_regular_expressions():
    rng, scanner = random.Random(1), S.Scanner(S.RULES)
    pieces = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "\"", "'", " ", "  ", ":", "=", "==", "AKIA", "AKIAAKIA", "ABC123", "0123456789abcdef", "deadbeef", "é", "日本", "\U0001f511", "ſecret", "\n", "\0",
              "ghp_" + "a1" * 18, "xoxb-" + "1-a" * 9, "sk_live_" + "z" * 24, "AIza" + "B_" * 18, "eyJab.eyJ" + "c" * 40 + ".d" + "-" * 20, "Authorization: Bearer ", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "x" * 13, ".", "_"]
    hits = 0
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        found = scanner.spans(text)
        assert found == plain(text), text
        hits += len(found)
    assert hits > 4000
    # a match that is too short takes its characters with it
    assert plain('token="secret:abcdefghijklmn') == [] == scanner.spans('token="secret:abcdefghijklmn')


def test_automaton_of_any_rule_of_its_kind():
    rng = random.Random(2)
    for p in ("a(b|cd)*e?", "(ab|abc|abcd)x?", "[a-c]{2,4}d", "a{0,2}b+", "(?i:aB)c", "(a|b)*abb", "a(bc)?(bcd)?"):
        auto, want = Automaton([p]), re.compile(p)
        scanner = S.Scanner([S.Rule("x", "", p)]) if not want.fullmatch("") else None
        for _ in range(500):
            t = "".join(rng.choices("abcdexAB", k=rng.randint(0, 9)))
            ends = [z for z in range(len(t) + 1) if want.fullmatch(t, 0, z)]
            assert auto.longest(t.encode().translate(auto.classes), 0) == max(ends, default=-1)
            if scanner:  # leftmost, longest, not overlapping
                out, at = [], 0
                while at < len(t):
                    z = max((z for z in range(at + 1, len(t) + 1) if want.fullmatch(t, at, z)), default=None)
                    out += [(at, 0, z)] if z else []
                    at = z or at + 1
                assert scanner.spans(t) == out
    assert Automaton(["(a|b)*abb"]).states == 5  # as small as can be: four and the dead one


def test_rules_that_cannot_be():
    for bad in ("é", "[^a]", "a$", r"\d", "(?=a)b"):
        with pytest.raises(ValueError):
            Automaton([bad])
    with pytest.raises(ValueError):
        S.Scanner([S.Rule("x", "", "a"), S.Rule("x", "", "b")])


def test_size_and_long_texts():
    scanner = S.Scanner(S.RULES)
    assert scanner.begins.states < 2000
    long = "f" * 300_000 + " é token = " + "Z" * 200_000
    assert scanner.spans(long) == [(0, 2, 300_000), (300_003, 0, 500_011)]


def test_edge_cases(spark, clashing, docs):
    rows = [(1, None), (2, ""), (3, "é token: 0123456789abcdef"), (3, "é token: 0123456789abcdef"), (None, "password=abcdefghijkl")]
    out = S.find_secrets(clashing(rows))
    got = {(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in out.collect()}
    assert got == {(1, ()), (2, ()), (3, (("assign", 2, 25), ("hex", 9, 25))), (None, (("assign", 0, 21),))}
    assert out.count() == 5 and out.columns.count("spans") == 1
    clean = {r.text for r in S.redacted(clashing(rows)).collect()}
    assert clean == {None, "", "é [assign]", "[assign]"}
    assert S.find_secrets(docs([])).collect() == []


def test_query_on_whole_table(spark, sf):
    want = {}
    for r in queries.documents(spark, sf).collect():
        found = plain(r.text)
        base = ",".join(f"{S.RULES[k].kind}:{a}:{z}" for a, k, z in found if k < 3)
        n = [sum(k == i for _, k, _ in found) for i in range(3)]
        want[r.doc_id] = (*n, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{S.RULES[k].kind}:{a}:{z}" for a, k, z in found))
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in queries.op11_secret_scan(spark, sf).collect()}
    assert got == want and sum(w[0] + w[2] for w in want.values()) > 0
