"""Many regular expressions over many texts: one automaton finds the literals that rules need, rules run only where theirs are."""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType


def needed(rule: str) -> tuple[str, ...]:
    """Texts one of which occurs wherever the rule matches, as long as can be told from the rule; none where nothing can."""
    tree = _parser.parse(rule)
    return () if tree.state.flags & re.IGNORECASE else _needed(tree)


def _needed(tree) -> tuple[str, ...]:
    best: tuple[str, ...] = ()
    run = ""

    def better(new: tuple[str, ...]) -> None:
        nonlocal best
        if new and min(map(len, new)) > min(map(len, best), default=0):
            best = new

    for op, arg in tree:
        if op is sre.LITERAL:
            run += chr(arg)
            continue
        if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):  # no width: a run goes on behind it
            continue
        better((run,) if run else ())
        run = ""
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] >= 1:
            better(_needed(arg[2]))
        elif op is sre.SUBPATTERN and not arg[1] & re.IGNORECASE:
            better(_needed(arg[3]))
        elif op is sre.ATOMIC_GROUP:
            better(_needed(arg))
        elif op is sre.BRANCH:
            parts = [_needed(x) for x in arg[1]]
            better(tuple(dict.fromkeys(y for x in parts for y in x)) if all(parts) else ())
    better((run,) if run else ())
    return best


class Patterns:
    """Compiled rules and the automaton of what they need."""

    def __init__(self, rules: dict[str, str]) -> None:
        self.rules = [(name, re.compile(rule)) for name, rule in rules.items()]
        self.always: list[int] = []
        by_text: dict[str, set[int]] = {}
        for i, rule in enumerate(rules.values()):
            texts = needed(rule)
            if not texts:
                self.always.append(i)
            for x in texts:
                by_text.setdefault(x, set()).add(i)
        # A single character is found faster alone, and may occur so often that its hits are slow to walk.
        self.single = {x: r for x, r in by_text.items() if len(x) == 1}
        self.automaton = ahocorasick.Automaton()
        self.tracked: set[int] = set()
        for x, r in by_text.items():
            if len(x) > 1:
                self.automaton.add_word(x, r)
                self.tracked |= r
        if len(self.automaton):
            self.automaton.make_automaton()

    def possible(self, text: str) -> list[int]:
        """Rules that may match, in order."""
        got = set(self.always)
        for x, r in self.single.items():
            if x in text:
                got |= r
        if len(self.automaton):
            seen: set[int] = set()
            for _, r in self.automaton.iter(text):
                if not r <= seen:
                    seen |= r
                    if seen == self.tracked:
                        break
            got |= seen
        return sorted(got)

    def hits(self, text: str) -> Iterator[tuple[str, int, int]]:
        """(rule, matches, line of the first) of every rule that matches."""
        for i in self.possible(text):
            name, rule = self.rules[i]
            n, first = 0, 0
            for m in rule.finditer(text):
                n, first = n + 1, m.start() if not n else first
            if n:
                yield name, n, text.count("\n", 0, first) + 1


def scan(rows: DataFrame, key: str, text: str, rules: dict[str, str]) -> DataFrame:
    """(key, rule, n, line) of every rule that matches a whole text; null texts match nothing."""
    schema = StructType([rows.schema[key]]).add("rule", StringType()).add("n", LongType()).add("line", LongType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Patterns(rules)
        for b in batches:
            at, found = [], []
            for i, t in enumerate(b[text]):
                for hit in own.hits(t.as_py() or ""):
                    at.append(i)
                    found.append(hit)
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b[key].take(pa.array(at, pa.int64())).cast(arrow.field(key).type), *[pa.array(c, f.type) for c, f in zip(cols, list(arrow)[1:], strict=True)]], schema=arrow)

    return rows.select(key, text).mapInArrow(run, schema)
