"""Large tables of terms, matched by an Aho-Corasick automaton in Arrow batches.

Tables beyond ``FEW`` terms are broadcast rather than written into the plan as
literals. Each Python worker builds an automaton once, and a text is passed
over once for all terms, however many there are.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from callwatch.runtime import ship_package

#: Terms that are written into a plan as literals; more go to an automaton.
FEW = 200
#: Automata that a worker keeps.
KEPT = 4

_BUILT: OrderedDict[str, Terms] = OrderedDict()


class Terms:
    """The places of terms in their list that occur in a text, overlapping ones
    and terms inside others too. A blank term occurs everywhere."""

    def __init__(self, terms: list[str]):
        places: dict[str, list[int]] = {}
        for i, term in enumerate(terms):
            places.setdefault(term, []).append(i)
        self.always = places.pop("", [])
        self.automaton = ahocorasick.Automaton()
        for term, own in places.items():
            self.automaton.add_word(term, own)
        self.automaton.make_automaton()
        self.empty = not places

    def among(self, text: str) -> set[int]:
        found = set(self.always)
        if not self.empty:
            for _, own in self.automaton.iter(text):
                found.update(own)
        return found

    def first(self, text: str, start: int) -> int | None:
        """The first place, from ``start`` on, of a term that occurs."""
        return min((i for i in self.among(text) if i >= start), default=None)


def _terms(token: str, make: Callable[[], list[str]]) -> Terms:
    if token not in _BUILT:
        _BUILT[token] = Terms(make())
        if len(_BUILT) > KEPT:
            _BUILT.popitem(last=False)
    _BUILT.move_to_end(token)
    return _BUILT[token]


def hits(x: Column, words: list[str]) -> Column:
    """The words whose lower-cased forms occur in x, in the list's order."""
    spark = SparkSession.active()
    ship_package(spark)
    token, table = uuid.uuid4().hex, spark.sparkContext.broadcast(list(words))

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        terms = _terms(token, lambda: [w.lower() for w in table.value])
        return texts.map(lambda t: [table.value[i] for i in sorted(terms.among(t or ""))])

    return found(x)


def replaced(x: Column, rules: list[tuple[str, str]]) -> Column:
    """(text, hits) after rules (alias, canonical) in order, each of which sees what
    those before it made: the automaton names the next rule that applies, and
    the text is looked through again after each replacement."""
    spark = SparkSession.active()
    ship_package(spark)
    token, table = uuid.uuid4().hex, spark.sparkContext.broadcast(list(rules))

    @F.pandas_udf("struct<text:string,hits:array<struct<alias:string,canonical:string>>>")
    def corrected(texts: pd.Series) -> pd.DataFrame:
        terms = _terms(token, lambda: [alias for alias, _ in table.value])
        out = []
        for text in texts:
            text, made, at = text or "", [], 0
            while (at := terms.first(text, at)) is not None:
                alias, name = table.value[at]
                text = text.replace(alias, name)
                made.append({"alias": alias, "canonical": name})
                at += 1
            out.append((text, made))
        return pd.DataFrame(out, columns=["text", "hits"])

    return corrected(x)
