import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from multitopic.llm import text as T

from .messy import alnum_words, space_words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ09 \t\n\x0b-é ß_.", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_are_those_of_the_pattern(texts, limit):
    column = pa.array(texts, pa.string())
    for kind, brute in ((T.ALNUM, alnum_words), (T.NON_SPACE, space_words)):
        seen = {}
        rows = 0
        for s in T.slices(column, limit):
            w = T.words(s, kind)
            for k in range(s.hi - s.lo):
                want = brute(texts[s.lo + k])
                a, b = w.rows[k], w.rows[k + 1]
                got = [bytes(s.data[x:y]).decode() for x, y in zip(w.start[a:b], w.end[a:b])]
                assert [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in got] == want
                for word, h in zip(want, w.hash[a:b].tolist()):
                    assert seen.setdefault(word, h) == h
                rows += 1
        assert rows == len(texts)
        assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_shingle_sets(texts):
    got = [x for s in T.slices(pa.array(texts, pa.string()), 25) for x in T.shingles(T.words(s, T.NON_SPACE), 4)]
    names = {}
    for text, have in zip(texts, got, strict=True):
        w = space_words(text)
        want = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
        assert len(have) == len(want) and (np.diff(have.astype(object)) > 0).all()
        names.setdefault(frozenset(want), tuple(have.tolist()))
        assert names[frozenset(want)] == tuple(have.tolist())
    assert len(set(names.values())) == len(names)


def test_prefix_hash_and_sliced_columns():
    column = pa.array(["abcdef abcxyz", "abc", "éa éb"]).slice(0, 3)
    (s,) = T.slices(column)
    p = T.words(s, T.ALNUM).prefix_hash(3)
    assert p[0] == p[1] == p[2] and p[3] != p[0]
    assert re.fullmatch(r"\d+", str(p[0]))
    (t,) = T.slices(pa.array(["zz", "abc def", "q"]).slice(1, 1))
    assert len(T.words(t, T.ALNUM).hash) == 2
