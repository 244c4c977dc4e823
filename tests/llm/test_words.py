"""Words and n-grams of batches against regular expressions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from hornlake.llm.components import forest
from hornlake.llm.streams import whole_groups
from hornlake.llm.words import ALNUM, SPACED, Words, slices, text_arrays

_A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB3 é\n\t_-.\x0b\x1c\x85 中", max_size=30)), max_size=8)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_are_those_of_the_patterns(texts):
    for separators, lower, pattern in ((SPACED, False, r"[^\x20\x09-\x0D]+"), (ALNUM, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = Words(*text_arrays(pa.array(texts, pa.string())), separators, lower)
        expected = [re.findall(pattern, (t or "").translate(_A_Z) if lower else t or "") for t in texts]
        raw = w.data.tobytes()
        found = [[raw[w.start[k] : w.end[k]].decode() for k in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        assert found == expected
        by_hash = dict(zip(w.hash.tolist(), (x for t in expected for x in t), strict=True))
        assert len(set(by_hash.values())) == len(by_hash)
        grams, inside = w.grams(3)
        flat = [(i, tuple(t[k : k + 3])) for i, t in enumerate(expected) for k in range(len(t) - 2)]
        assert inside.sum() == len(flat)
        names: dict = {}
        for h, (_, g) in zip(grams[inside].tolist(), flat, strict=True):
            assert names.setdefault(h, g) == g
        assert len(names) == len({g for _, g in flat})


def test_slices_keep_rows():
    batch = pa.RecordBatch.from_pydict({"id": list(range(50)), "text": ["x" * (i * 7 % 31) if i % 5 else None for i in range(50)]})
    parts = list(slices(iter([batch, batch.slice(0, 0)]), "text", limit=40))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(50)) and len(parts) > 5
    assert list(slices(iter([batch.slice(3, 4)]), "text", limit=1))[1].column(1)[0].as_py() == batch.column(1)[4].as_py()


def test_whole_groups_over_batches():
    keys = np.sort(np.random.default_rng(1).integers(0, 9, 100))
    batch = pa.RecordBatch.from_pydict({"k": keys, "v": np.arange(100)})
    seen = []
    for rows, bounds in whole_groups((batch.slice(i, 7) for i in range(0, 100, 7)), 1):
        for a, b in bounds:
            part = rows.column("k").to_numpy()[a:b]
            assert (part == part[0]).all()
            seen.append((part[0], b - a))
    assert seen == [(k, (keys == k).sum()) for k in np.unique(keys)]


def test_forest_connects_like_the_links():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.integers(0, 40, (2, 25))
        node, root = forest(a, b)
        parent = {}

        def find(x, parent=parent):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
        expected = {x: find(x) for x in {*a.tolist(), *b.tolist()}}
        assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {x: r for x, r in expected.items() if x != r}
