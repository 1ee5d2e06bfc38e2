"""Rules as data: a table of patterns matched in one pass, and ordered rules of conditions that set properties.

Patterns: of each regular expression a set of literals is derived such that every match holds at least one of them. One automaton of all
rules' literals runs over a line once and names the candidate rules; only these run their expression. So the cost of a line
follows what it holds, not how many rules there are.

Properties: conditions are trees (dicts) and rules are kept in order; a later rule sees what earlier ones set. They are compiled to columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shorter literals single out too few lines.
LEAST_LITERAL = 3
#: A rule table is configuration; a larger one than this many characters of patterns isn't sent to all tasks.
MOST_CHARACTERS = 64 << 20
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def required_literals(pattern: str) -> frozenset[str] | None:
    """Literals (A-Z lowered) of which every match of ``pattern`` holds at least one, as long as can be found; None if there are none of LEAST_LITERAL characters."""
    best = _cover(re._parser.parse(pattern, re.ASCII))
    return best if best and min(map(len, best)) >= LEAST_LITERAL else None


def _cover(nodes) -> frozenset[str] | None:
    found: list[frozenset[str]] = []
    run: list[str] = []

    def close() -> None:
        if run:
            found.append(frozenset(["".join(run)]))
            run.clear()

    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            run.append(chr(arg).translate(_LOWER))
            continue
        if name == "AT":  # takes no characters
            continue
        close()
        inner = None
        if name == "SUBPATTERN":
            inner = _cover(arg[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            inner = _cover(arg[2])
        elif name == "ATOMIC_GROUP":
            inner = _cover(arg)
        elif name == "BRANCH":
            ways = [_cover(way) for way in arg[1]]
            inner = frozenset().union(*ways) if all(ways) else None
        if inner:
            found.append(inner)
    close()
    return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)


class Matcher:
    """The rules (rule, pattern, context, language or None) compiled; ``tried`` counts expressions that were run."""

    def __init__(self, rules: list[tuple[str, str, str, str | None]]):
        self.rules = [(rule, re.compile(pattern, re.ASCII), context, language) for rule, pattern, context, language in rules]
        self.always: dict[str, list[int]] = {}
        by_literal: dict[str, dict[str, list[int]]] = {}
        for i, (_, pattern, context, _) in enumerate(rules):
            literals = required_literals(pattern)
            if literals is None:
                self.always.setdefault(context, []).append(i)
            for literal in literals or ():
                by_literal.setdefault(context, {}).setdefault(literal, []).append(i)
        self.automata = {}
        for context, literals in by_literal.items():
            automaton = ahocorasick.Automaton()
            for literal, own in literals.items():
                automaton.add_word(literal, own)
            automaton.make_automaton()
            self.automata[context] = automaton
        self.tried = 0

    def find(self, text: str, context: str, language: str | None) -> list[tuple[str, int, int]]:
        """(rule, first, last) of each rule's leftmost match, positions from 1, in the rules' order."""
        candidates = set(self.always.get(context, ()))
        if context in self.automata:
            for _, own in self.automata[context].iter(text.translate(_LOWER)):
                candidates.update(own)
        out = []
        for i in sorted(candidates):
            rule, pattern, _, wanted = self.rules[i]
            if wanted is not None and wanted != language:
                continue
            self.tried += 1
            if m := pattern.search(text):
                out.append((rule, m.start() + 1, m.end()))
        return out


def line_contexts(lines: DataFrame) -> DataFrame:
    """``lines`` (line) with other texts that rules may look at: code (comments of one line blanked out), imports (modules) and calls
    (names before a bracket), joined by line ends."""
    from factgraph.functions.scalars import imports_of

    blank = F.regexp_replace("line", r"/\*.*?\*/", " ")
    code = F.regexp_replace(blank, r"(^|\s)(//|#).*$", "$1")
    calls = F.regexp_extract_all(code, F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)\s*\("), F.lit(1))
    return lines.withColumns({"code": code, "imports": F.array_join(imports_of(F.col("line")), "\n"), "calls": F.array_join(calls, "\n")})


def pattern_findings(lines: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """The ``keys`` of ``lines``, rule, first, last, found for the leftmost match of every rule (rule, pattern and, if there are, context: a column
    of ``lines``, by default line, and language: all if null). Null texts have no matches. Letter case counts unless a pattern says (?i), which
    concerns A-Z only; \\w, \\d, \\s and \\b know ASCII only."""
    columns = [F.col(c) if c in rules.columns else F.lit(d).cast("string").alias(c) for c, d in (("rule", None), ("pattern", None), ("context", "line"), ("language", None))]
    rules = rules.select(*columns).distinct()
    if (rules.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]) > MOST_CHARACTERS:
        raise ValueError(f"the rules' patterns have more than {MOST_CHARACTERS} characters")
    held = sorted(map(tuple, rules.collect()), key=lambda r: (r[0], r[2], r[3] or "", r[1]))
    if not held:
        return lines.select(*keys, F.lit("").alias("rule"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit("").alias("found")).limit(0)
    shared = lines.sparkSession.sparkContext.broadcast(held)
    contexts = sorted({r[2] for r in held})
    language = F.col("language") if "language" in lines.columns else F.lit(None).cast("string")
    read = lines.select(F.struct(*keys).alias("_keys"), language.alias("_language"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(contexts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for b in batches:
            at, rows = [], []
            languages = b.column(1).to_pylist()
            for c, context in enumerate(contexts):
                for i, text in enumerate(b.column(2 + c).to_pylist()):
                    for rule, first, last in matcher.find(text, context, languages[i]) if text else ():
                        at.append(i)
                        rows.append((rule, first, last, text[first - 1 : last]))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True))], names=["_keys", "rule", "first", "last", "found"])

    kind = read.schema["_keys"].dataType.simpleString()
    return read.mapInArrow(run, f"_keys {kind}, rule string, first int, last int, found string").select(*(F.col(f"_keys.{k}").alias(k) for k in keys), "rule", "first", "last", "found")


def truthy(column: Column, kind: str) -> Column:
    """Neither null, false, zero, not a number, nor empty."""
    if kind == "string":
        return F.coalesce(column != "", F.lit(False))
    if kind == "boolean":
        return F.coalesce(column, F.lit(False))
    if kind.startswith("array"):
        return F.coalesce(F.size(column), F.lit(0)) > 0
    return F.coalesce((column != 0) & ~F.isnan(column.cast("double")), F.lit(False))


def as_text(column: Column, kind: str) -> Column:
    """The text that comparisons see; of a missing value ``undefined``."""
    text = F.array_join(column, ",") if kind.startswith("array") else column.cast("string")
    return F.coalesce(text, F.lit("undefined"))


class Properties:
    """Compiles rules over findings (pattern and inputs) into columns. ``kinds`` has the Spark types of the inputs, ``regexes`` named expressions, ``lookups`` named tables."""

    def __init__(self, kinds: dict[str, str], regexes: dict[str, str], lookups: dict[str, dict[str, object]]):
        self.kinds, self.regexes, self.lookups = kinds, regexes, lookups

    def when(self, tree: dict, outputs: dict[str, Column]) -> Column:
        """A condition: always, notSet, exists, regex, equals, anyOf, allOf or not."""
        (kind, arg), = tree.items()
        if kind == "always":
            return F.lit(bool(arg))
        if kind == "notSet":
            return outputs[arg].isNull() if arg in outputs else F.lit(True)
        if kind == "exists":
            return truthy(F.col(arg), self.kinds[arg])
        if kind == "regex":
            return F.coalesce(F.col(arg["input"]).rlike(self.regexes[arg["regex"]]), F.lit(False))
        if kind == "equals":
            return as_text(F.col(arg["input"]), self.kinds[arg["input"]]) == F.lit(_text(arg["value"]))
        if kind == "not":
            return ~self.when(arg, outputs)
        if kind in ("anyOf", "allOf"):
            parts = [self.when(t, outputs) for t in arg]
            return reduce(lambda a, b: a | b if kind == "anyOf" else a & b, parts, F.lit(kind == "allOf"))
        raise ValueError(f"no such condition: {kind}")

    def value(self, assignment: object) -> Column:
        """What an assignment sets, as JSON; null where it sets nothing."""
        if not isinstance(assignment, dict):
            return F.lit(json.dumps(assignment))
        (kind, arg), = assignment.items()
        if kind == "fromInput":
            return self._json(arg)
        if kind == "preferInputOrConstant":
            return F.when(truthy(F.col(arg["input"]), self.kinds[arg["input"]]), self._json(arg["input"])).otherwise(F.lit(json.dumps(arg["fallback"])))
        if kind == "lookup":
            key, table = F.col(arg["keyInput"]), self.lookups[arg["map"]]
            key = F.lower(key) if arg.get("transform") == "lowercase" else key
            if not table:
                return F.lit(None).cast("string")
            return F.try_element_at(F.create_map(*(F.lit(x) for k, v in sorted(table.items()) for x in (k, json.dumps(v)))), key)
        raise ValueError(f"no such assignment: {kind}")

    def _json(self, name: str) -> Column:
        column, kind = F.col(name), self.kinds[name]
        if kind == "string":
            return F.when(column.isNotNull(), F.regexp_replace(F.to_json(F.struct(column.alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1"))
        return F.when(column.isNotNull(), F.to_json(column) if kind.startswith("array") else column.cast("string"))


def infer_by_rules(findings: DataFrame, rules: dict[str, list[dict]], regexes: dict[str, str], lookups: dict[str, dict[str, object]]) -> DataFrame:
    """``findings`` (pattern and inputs) with a column for each property that a rule sets: its value as JSON text, null where none did.

    ``rules`` has lists of rules by pattern; a rule is {"when": condition, "set": {property: assignment}}. All rules of the row's pattern are
    taken in order and all that hold set their properties, so the last one counts; conditions and sets see what the rules before have set. A lookup without the key
    and a missing input set nothing. Rules that don't depend on each other share one projection.
    """
    inputs = dict(findings.dtypes)
    compiler = Properties(inputs, regexes, lookups)
    names = sorted({p for own in rules.values() for r in own for p in r["set"]})
    out = findings.withColumns({f"_p_{p}": F.lit(None).cast("string") for p in names})
    for layer in _layers(rules):
        outputs = {p: F.col(f"_p_{p}") for p in names}
        now = dict(outputs)
        for pattern, rule in layer:
            holds = (F.col("pattern") == pattern) & compiler.when(rule["when"], outputs)
            for p, assignment in rule["set"].items():
                now[p] = F.coalesce(F.when(holds, compiler.value(assignment)), now[p])
        out = out.withColumns({f"_p_{p}": now[p] for p in {q for _, r in layer for q in r["set"]}})
    return out.select(*findings.columns, *(F.col(f"_p_{p}").alias(p) for p in names))


def _reads(tree: dict) -> set[str]:
    (kind, arg), = tree.items()
    if kind == "notSet":
        return {arg}
    if kind == "not":
        return _reads(arg)
    return set().union(*map(_reads, arg)) if kind in ("anyOf", "allOf") else set()


def _layers(rules: dict[str, list[dict]]) -> list[list[tuple[str, dict]]]:
    """The rules in as few layers as keep the order: one that asks whether a property is set comes in a later layer than those of its pattern that set it, and
    none comes in an earlier layer than one before it that sets or asks for what it sets."""
    layers: list[list[tuple[str, dict]]] = []
    for pattern, own in rules.items():
        written: dict[str, int] = {}  # the last layer that sets a property
        asked: dict[str, int] = {}
        for rule in own:
            reads = _reads(rule["when"])
            at = max([0, *(written[p] + 1 for p in reads if p in written), *(written[p] for p in rule["set"] if p in written), *(asked[p] for p in rule["set"] if p in asked)])
            while len(layers) <= at:
                layers.append([])
            layers[at].append((pattern, rule))
            written |= {p: max(at, written.get(p, 0)) for p in rule["set"]}
            asked |= {p: max(at, asked.get(p, 0)) for p in reads}
    return layers


def _text(value: object) -> str:
    """A constant as comparisons see it."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return ",".join(map(_text, value)) if isinstance(value, list) else str(value)
