"""Multi-pattern search: which of many terms occur in a text, in one pass over the text.

Spark can test one term at a time (``contains``); testing hundreds of terms that way reads every text hundreds of
times. ``find_terms`` is the one primitive the rule operators need on top of built-in expressions: an Arrow UDF over
an Aho-Corasick automaton, or a compiled alternation where that package is missing. It returns term positions in the
given list; scoring stays in Spark expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_finders: dict[tuple, object] = {}


def _finder(terms: tuple[str, ...]):
    """Function text -> indexes of all term occurrences, overlapping ones included; built once per Python worker."""
    if terms not in _finders:
        try:
            import ahocorasick
        except ImportError:
            _finders[terms] = _regex_finder(terms)
        else:
            automaton = ahocorasick.Automaton()
            for i, term in enumerate(terms):
                automaton.add_word(term, i)
            automaton.make_automaton()
            _finders[terms] = lambda text: [i for _, i in automaton.iter(text)]
    return _finders[terms]


def _regex_finder(terms: tuple[str, ...]):
    """Longest alternative first: any other term starting at the same place is a prefix of the longest one."""
    index = {t: i for i, t in enumerate(terms)}
    prefixes = {t: [index[t[:n]] for n in range(1, len(t) + 1) if t[:n] in index] for t in terms}
    pattern = re.compile("(?=(" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + "))")
    return lambda text: [i for m in pattern.findall(text) for i in prefixes[m]]


def find_terms(text: Column, terms: Sequence[str], *, repeats: bool = False) -> Column:
    """Sorted indexes into ``terms`` of the terms that occur in ``text`` as substrings; null for null text.

    With ``repeats`` an index appears once per occurrence.
    """
    terms = tuple(terms)
    if len(set(terms)) != len(terms) or not all(terms):
        raise ValueError("Search terms must be distinct and non-empty.")
    if not terms:
        return F.when(text.isNotNull(), F.array().cast("array<int>"))

    def search(text: str) -> list[int]:
        hits = _finder(terms)(text)
        return sorted(hits if repeats else set(hits))

    return F.arrow_udf(lambda texts: once_per_text(texts, search, _INDEXES), "array<int>")(text)


_INDEXES = pa.list_(pa.int32())


def once_per_text(texts: pa.Array, function: Callable[[str], object], kind: pa.DataType) -> pa.Array:
    """``function`` of every text of a batch, called once per distinct text; null for null."""
    coded = pc.dictionary_encode(texts)
    return pa.array([function(t) for t in coded.dictionary.to_pylist()], kind).take(coded.indices)


def find_terms_or(text: Column, terms: Sequence[str], rest: Callable[[str], str], others: Sequence[str]) -> Column:
    """Struct of ``hits``, as ``find_terms`` gives them, and ``others``: null where there are hits, else the occurrences of the
    other terms in ``rest(text)``. Both searches are one pass in one worker."""
    terms, others = tuple(terms), tuple(others)

    def search(text: str) -> dict[str, list[int] | None]:
        hits = _finder(terms)(text) if terms else []
        return {"hits": sorted(set(hits)), "others": None if hits or not others else sorted(_finder(others)(rest(text)))}

    kind = pa.struct([("hits", _INDEXES), ("others", _INDEXES)])
    return F.arrow_udf(lambda texts: once_per_text(texts, search, kind), "hits array<int>, others array<int>")(text)


def literal_table(rows: Sequence, element: str) -> Column:
    """A small constant array of structs (or of arrays of structs), indexed by term position instead of joined.

    The rows travel as one JSON literal that constant folding turns into the array.
    """
    return F.from_json(F.lit(json.dumps(rows)), f"array<{element}>")
