"""Horn rules as small labelled multigraphs: atoms, language bias, rewrites, canonical signatures, printing."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import count, permutations

X, Y = 0, 1
#: The variable that takes the place of a corrupted head variable.
FREE = -1


@dataclass(frozen=True, order=True)
class Atom:
    s: int
    p: str
    o: int

    @property
    def ends(self) -> frozenset[int]:
        return frozenset((self.s, self.o))


@dataclass(frozen=True)
class Rule:
    """head(x, y) <= body; x and y are the head's variables, whatever their numbers."""

    head: Atom
    body: tuple[Atom, ...]

    def __post_init__(self) -> None:
        if any(a.s == a.o for a in self.atoms):
            raise ValueError("an atom cannot join a variable to itself")

    @property
    def atoms(self) -> tuple[Atom, ...]:
        return (self.head, *self.body)

    @property
    def length(self) -> int:
        return len(self.atoms)

    @property
    def variables(self) -> list[int]:
        return sorted({v for a in self.atoms for v in a.ends})

    @property
    def body_predicates(self) -> list[str]:
        return sorted({a.p for a in self.body})

    def corrupted(self, corrupt: str) -> tuple[Atom, ...]:
        """The PCA query: the body and the head with one variable set free."""
        if corrupt not in ("x", "y"):
            raise ValueError("corrupt is 'x' or 'y'")
        h = self.head
        return (*self.body, Atom(FREE, h.p, h.o) if corrupt == "x" else Atom(h.s, h.p, FREE))


def rule(head: str, *body: str) -> Rule:
    """Reads atoms like 'p(x,y)'; the head's variables become 0 and 1, others follow in order of appearance."""
    numbers: dict[str, int] = {}

    def atom(text: str) -> Atom:
        p, _, rest = text.partition("(")
        s, o = (v.strip() for v in rest.rstrip(")").split(","))
        return Atom(numbers.setdefault(s, len(numbers)), p.strip(), numbers.setdefault(o, len(numbers)))

    return Rule(atom(head), tuple(map(atom, body)))


# Language bias


def degrees(atoms: Iterable[Atom]) -> Counter:
    return Counter(v for a in atoms for v in (a.s, a.o))


def open_variables(r: Rule) -> list[int]:
    """Variables of a single atom end."""
    return sorted(v for v, n in degrees(r.atoms).items() if n == 1)


def is_closed(r: Rule) -> bool:
    return not open_variables(r)


def at_most_one_open(r: Rule) -> bool:
    return len(open_variables(r)) <= 1


def no_isolated_variable(r: Rule, variables: Iterable[int] | None = None) -> bool:
    """Every one of the given variables is in some atom: weaker than connection."""
    found = degrees(r.atoms)
    return all(found[v] for v in (r.variables if variables is None else variables))


def connected(atoms: Iterable[Atom]) -> bool:
    atoms = list(atoms)
    if not atoms:
        return False
    reached, rest = set(atoms[0].ends), atoms[1:]
    while rest:
        near = [a for a in rest if a.ends & reached]
        if not near:
            return False
        reached.update(*(a.ends for a in near))
        rest = [a for a in rest if not a.ends & reached]
    return True


def body_connected(r: Rule) -> bool:
    """The rule without its head joins all of the rule's variables."""
    return connected(r.body) and set(r.variables) == {v for a in r.body for v in a.ends}


def check(r: Rule, biases: Iterable[Callable[[Rule], bool]]) -> bool:
    return all(bias(r) for bias in biases)


def without(atoms: Iterable[Atom], drop: Iterable[Atom]) -> tuple[Atom, ...]:
    """The atoms but for one occurrence of each dropped one."""
    left = Counter(drop)
    out = []
    for a in atoms:
        if left[a]:
            left[a] -= 1
        else:
            out.append(a)
    return tuple(out)


# Canonical forms


Signature = tuple[Atom, ...]


def _least(atoms: tuple[Atom, ...], fixed: dict[int, int], first: int) -> tuple[Signature, dict[int, int]]:
    others = sorted({v for a in atoms for v in a.ends} - set(fixed))
    best: tuple[Signature, dict[int, int]] | None = None
    for numbers in permutations(range(first, first + len(others))):
        names = fixed | dict(zip(others, numbers, strict=True))
        form = tuple(sorted((Atom(names[a.s], a.p, names[a.o]) for a in atoms), key=lambda a: (a.s, a.o, a.p)))
        key = [(a.s, a.o, a.p) for a in form]
        if best is None or key < [(a.s, a.o, a.p) for a in best[0]]:
            best = form, names
    assert best
    return best


def signature(r: Rule) -> Signature:
    """The least sorted atoms over all numberings that give the head's variables 0 and 1.

    Parallel atoms may stand for the head as well as the head itself; `key` tells such rules apart.
    """
    return _least(r.atoms, {r.head.s: X, r.head.o: Y}, 2)[0]


def head_index(r: Rule) -> int:
    """Place of the head in the signature."""
    return signature(r).index(Atom(X, r.head.p, Y))


def key(r: Rule, marked: bool = True) -> str:
    """A rule's identity as text; not `marked`, rules whose heads are parallel atoms are one."""
    form = ";".join(f"{a.s},{a.p},{a.o}" for a in signature(r))
    return f"{form}|{head_index(r)}" if marked else form


def is_minimal(r: Rule) -> bool:
    """The rule's own numbering gives its signature."""
    own = tuple(sorted(r.atoms, key=lambda a: (a.s, a.o, a.p)))
    return (r.head.s, r.head.o) == (X, Y) and own == signature(r)


def canonical(r: Rule) -> Rule:
    form = signature(r)
    head = Atom(X, r.head.p, Y)
    return Rule(head, without(form, [head]))


def free_signature(atoms: Iterable[Atom], first: int = 2) -> Signature:
    """The least form of a graph without a head."""
    return _least(tuple(atoms), {}, first)[0]


def enumerate_graphs(predicates: list[str], length: int) -> list[set[Signature]]:
    """For each number of atoms up to `length` the connected graphs, each once, grown atom by atom."""
    levels: list[set[Signature]] = []
    for n in range(1, length + 1):
        if n == 1:
            levels.append({free_signature([Atom(0, p, 1)]) for p in predicates})
            continue
        found = set()
        for form in levels[-1]:
            names = sorted({v for a in form for v in a.ends})
            new = max(names) + 1
            ends = [(u, v) for u in names for v in names if u != v] + [(u, new) for u in names] + [(new, u) for u in names]
            found |= {free_signature((*form, Atom(u, p, v))) for u, v in ends for p in predicates if Atom(u, p, v) not in form}
        levels.append(found)
    return levels


# Printing


def _letters(names: Iterable[int], start: str = "a") -> dict[int, str]:
    found = count(ord(start))
    out: dict[int, str] = {}
    for v in names:
        if v not in out:
            n = next(found) - ord("a")
            out[v] = chr(ord("a") + n % 26) + (str(n // 26) if n >= 26 else "")
    return out


def render(r: Rule, rule_id: int | None = None) -> str:
    """'Rule 3: p(a, b) <= q(a, c), ...': the head's variables are a and b, others the next letters."""
    names = _letters([r.head.s, r.head.o, *(v for a in r.body for v in (a.s, a.o))])
    text = f"{r.head.p}({names[r.head.s]}, {names[r.head.o]}) <= " + ", ".join(f"{a.p}({names[a.s]}, {names[a.o]})" for a in r.body)
    return text if rule_id is None else f"Rule {rule_id}: {text}"


def render_numbers(r: Rule) -> str:
    """The same with the variables' numbers."""
    return f"{r.head.p}({r.head.s}, {r.head.o}) <= " + ", ".join(f"{a.p}({a.s}, {a.o})" for a in r.body)


def parse(text: str) -> tuple[int | None, Rule]:
    """What `render` wrote."""
    number, sep, rest = text.partition(": ")
    left, _, right = (rest if sep else text).partition(" <= ")
    body = [part + ")" for part in right.rstrip(")").split("), ")]
    return (int(number.removeprefix("Rule ")) if sep else None), rule(left, *body)


def heads(r: Rule) -> Iterator[Rule]:
    """The rule with each atom in turn as its head."""
    for a in dict.fromkeys(r.atoms):
        yield Rule(a, without(r.atoms, [a]))
