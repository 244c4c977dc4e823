"""Rules, canonical forms and codes, without Spark."""

from __future__ import annotations

import itertools
import random

import pytest

from hornlake.plans.dfs_code import min_code
from hornlake.plans.rule import (
    Atom,
    Rule,
    at_most_one_open,
    body_connected,
    canonical,
    check,
    connected,
    enumerate_graphs,
    free_signature,
    head_index,
    heads,
    is_closed,
    is_minimal,
    key,
    no_isolated_variable,
    open_variables,
    parse,
    render,
    render_numbers,
    rule,
    signature,
    without,
)

R = rule("p(x,y)", "q(x,z)", "r(z,y)")


def renamed(r: Rule, names: dict[int, int]) -> Rule:
    move = lambda a: Atom(names[a.s], a.p, names[a.o])
    return Rule(move(r.head), tuple(map(move, r.body)))


def test_bias():
    assert is_closed(R) and check(R, [is_closed, body_connected, at_most_one_open, no_isolated_variable])
    loose = rule("p(x,y)", "q(x,z)")
    assert open_variables(loose) == [1, 2] and not is_closed(loose) and not body_connected(loose)
    assert not connected(rule("p(x,y)", "q(x,z)", "r(y,w)").body)
    assert not no_isolated_variable(R, [0, 1, 7])
    with pytest.raises(ValueError):
        rule("p(x,x)", "q(x,y)")


def test_signature_ignores_names():
    rng = random.Random(3)
    r = rule("p(x,y)", "q(x,z)", "q(w,z)", "r(w,y)")
    for _ in range(20):
        other = rng.sample(range(10, 20), 4)
        changed = renamed(r, dict(zip(r.variables, other, strict=True)))
        changed = Rule(changed.head, tuple(rng.sample(changed.body, 3)))
        assert signature(changed) == signature(r) and key(changed) == key(r)
        assert canonical(changed) == canonical(r) and is_minimal(canonical(changed))


def test_heads_that_are_parallel_atoms():
    a, b = rule("p(x,y)", "q(x,y)"), rule("q(x,y)", "p(x,y)")
    assert signature(a) == signature(b) and key(a, marked=False) == key(b, marked=False)
    assert key(a) != key(b) and {head_index(a), head_index(b)} == {0, 1}


def test_printing():
    assert render(R, 3) == "Rule 3: p(a, b) <= q(a, c), r(c, b)"
    number, read = parse(render(R, 3))
    assert number == 3 and key(read) == key(R) and parse(render(R))[0] is None
    assert render_numbers(R) == "p(0, 1) <= q(0, 2), r(2, 1)"
    assert [h.head.p for h in heads(R)] == ["p", "q", "r"]
    assert without(R.atoms, [R.head]) == R.body


def test_corruption():
    assert R.corrupted("y")[-1] == Atom(0, "p", -1) and R.corrupted("x")[-1] == Atom(-1, "p", 1)
    with pytest.raises(ValueError):
        R.corrupted("z")


def test_codes_and_signatures_tell_the_same_graphs_apart():
    for level in enumerate_graphs(["p", "q"], 3):
        codes = set()
        for g in level:
            names = sorted({v for a in g for v in a.ends})
            own = {min_code([Atom(n[a.s], a.p, n[a.o]) for a in g]) for n in (dict(zip(names, p, strict=True)) for p in itertools.permutations(names))}
            assert len(own) == 1
            codes |= own
        assert len(codes) == len(level)
    with pytest.raises(ValueError):
        min_code([Atom(0, "p", 1), Atom(2, "p", 3)])


def test_enumeration_reaches_random_graphs():
    level = enumerate_graphs(["p", "q"], 3)[2]
    rng = random.Random(1)
    for _ in range(50):
        atoms = [Atom(0, rng.choice("pq"), 1)]
        while len(atoms) < 3:
            names = sorted({v for a in atoms for v in a.ends})
            u = rng.choice(names)
            v = rng.choice([*names, len(names)])
            a = Atom(u, rng.choice("pq"), v) if rng.random() < 0.5 else Atom(v, rng.choice("pq"), u)
            if u != v and a not in atoms:
                atoms.append(a)
        assert free_signature(atoms) in level
