"""A rule's left side as one DataFrame: a row for each complete match.

Everything is declared: alphas are filters on the fact tables' own columns, joins are joins, absence and universals
are anti-joins, folds are aggregates. Catalyst orders and places them. Where facts carry a session column every
join also equates it, so one plan serves one session or a million.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import Val, condition, emit, result, typed
from ..functions.expressions import parse, paths
from ..functions.values import dumps
from ..model import Expr, Fold, Join, Literal, Pattern, Range, Ref, Rule, Value
from ..model import Test as FieldTest
from ..operators.predicates import Cell, cell, join_column, kind_of, negated, part, test_column


@dataclass(frozen=True)
class Facts:
    """One fact type: its rows, what numbers them, and what orders and separates them."""

    rows: DataFrame
    handle: Column
    recency: Column | None = None
    session: Column | None = None
    finite: bool = False  # its numbers are declared free of NaN and infinities


SourceMap = Mapping[str, Facts]


def _needed(rule: Rule) -> dict[str, set[str]]:
    """By alias, the paths that joins, expressions and actions read."""
    out: dict[str, set[str]] = {p.alias: set() for p in rule.when}
    for p in rule.when:
        for j in p.joins:
            out[p.alias].add(j.path)
            out[j.ref.alias].add(j.ref.path or "")
        if p.fold and p.fold.path:
            out[p.alias].add(p.fold.path)
        if p.quantifier == "forAll":
            out[p.alias] |= {c.path for c in p.alphas}
        if p.condition:
            for alias, path in paths(parse(p.condition)):
                out.get(alias, set()).add(path)
    for action in rule.then:
        for v in _values(action):
            if isinstance(v, Ref) and v.path is not None and v.alias in out:
                out[v.alias].add(v.path)
            if isinstance(v, Expr):
                for alias, path in paths(parse(v.text)):
                    out.get(alias, set()).add(path)
    return out


def _values(action) -> list[Value]:
    pairs = getattr(action, "payload", None) or getattr(action, "args", None) or ()
    return [v for _, v in pairs] + ([action.value] if hasattr(action, "value") else [])


def _name(alias: str, path: str) -> str:
    return f"{alias}::{path}"


class Matches:
    """Builds the plan pattern by pattern; columns are named alias::path, handles alias::#, recency alias::^."""

    def __init__(self, rule: Rule, sources: SourceMap):
        self.rule, self.sources, self.needed = rule, sources, _needed(rule)
        self.kinds: dict[str, Cell] = {}
        self.has_session = all(sources[p.fact].session is not None for p in rule.when)

    def side(self, p: Pattern, keep_alphas: bool = True) -> DataFrame:
        """The facts of a pattern that pass its alphas, with just the columns that the rule reads."""
        source = self.sources[p.fact]
        df = source.rows
        if keep_alphas:
            for t in p.alphas:
                df = df.filter(test_column(cell(source.rows, t.path, source.finite), t))
        columns = [source.handle.alias(_name(p.alias, "#"))]
        if p.positive:
            columns.append((source.recency if source.recency is not None else source.handle).alias(_name(p.alias, "^")))
        if self.has_session:
            columns.append(source.session.alias(_name(p.alias, "$")))
        for path in sorted(self.needed[p.alias]):
            c = cell(source.rows, path, source.finite)
            if c.value is not None:
                columns.append(c.value.alias(_name(p.alias, path)))
            name = _name(p.alias, path)
            shown = F.col(f"`{name}`") if c.value is not None else None
            self.kinds[name] = Cell(shown, c.kind, shown.isNotNull() if c.variant is not None else None, shown if c.variant is not None else None, c.dtype)
        return df.select(*columns)

    def on(self, p: Pattern, earlier: list[Pattern]) -> Column | None:
        """The pattern's joins, the session, and that facts of one type under two names differ."""
        parts = [join_column(self.kinds[_name(p.alias, j.path)], self.kinds[_name(j.ref.alias, j.ref.path or "")], j) for j in p.joins]
        if self.has_session and earlier:
            parts.append(F.col(f"`{_name(p.alias, '$')}`") == F.col(f"`{_name(earlier[0].alias, '$')}`"))
        parts += [F.col(f"`{_name(p.alias, '#')}`") != F.col(f"`{_name(e.alias, '#')}`") for e in earlier if e.fact == p.fact]
        return reduce(lambda a, b: a & b, parts) if parts else None

    def build(self) -> DataFrame:
        positives = self.rule.positives
        out: DataFrame | None = None
        done: list[Pattern] = []
        waiting = list(positives)
        while waiting:  # a pattern joined to what is there comes before one that would multiply it
            ready = [p for p in waiting if all(any(d.alias == j.ref.alias for d in done) for j in p.joins)]
            p = next((x for x in ready if x.joins), ready[0]) if done else ready[0]
            waiting.remove(p)
            right = self.side(p)
            if out is None:
                out = right
            else:
                on = self.on(p, done)
                out = out.crossJoin(right) if on is None else out.join(right, on, "inner")
            done.append(p)
        assert out is not None
        for p in self.rule.when:
            if p.quantifier == "notExists":
                out = self.without(out, self.side(p), self.on(p, list(positives)))
            elif p.quantifier == "forAll":
                right = self.side(p, keep_alphas=False)
                source = self.sources[p.fact].rows
                fails = [negated(test_column(self.kinds[_name(p.alias, t.path)] if t.path in self.needed[p.alias] else cell(source, t.path), t)) for t in p.alphas]
                right = right.filter(reduce(lambda a, b: a | b, fails, F.lit(False)))
                out = self.without(out, right, self.on(p, list(positives)))
        for p in self.rule.when:
            if p.quantifier == "accumulate":
                out = self.fold(out, p, list(positives))
        for p in self.rule.when:  # last, for their errors are seen
            if p.condition:
                said = f"rule '{self.rule.id}', '{p.alias}': no overload or no such key in: {p.condition}"
                out = out.filter(condition(parse(p.condition), self, said))
        return out

    def value(self, alias: str, path: str) -> Val:
        """A field, or for path '' the answer of an accumulate, as expressions see it."""
        c = self.kinds.get(_name(alias, path or "="))
        if c is None or c.value is None or c.dtype is None:
            return Val()
        return typed(c.value, c.dtype, nullable=path != "")

    def present(self, alias: str, path: str) -> Column:
        c = self.kinds.get(_name(alias, path))
        return F.lit(c is not None and c.value is not None) if c is None or c.present is None else c.present

    @staticmethod
    def without(out: DataFrame, right: DataFrame, on: Column | None) -> DataFrame:
        """The matches that no row of ``right`` goes with; where nothing links the two, one row of it is enough to know."""
        return out.join(right, on, "left_anti") if on is not None else out.join(F.broadcast(right.limit(1)), F.lit(True), "left_anti")

    def _of_own_key(self, p: Pattern, earlier: list[Pattern]) -> bool:
        """Whether a fold counts the others with the same keys as a match's only fact of that type, which passes its tests as well."""
        same = [e for e in earlier if e.fact == p.fact]
        return (
            p.fold.function == "count" and len(same) == 1 and bool(p.joins) and all(t in same[0].alphas for t in p.alphas)
            and all(j.op == "eq" and j.ref.alias == same[0].alias and j.ref.path == j.path and self.kinds[_name(p.alias, j.path)].value is not None and self.kinds[_name(p.alias, j.path)].variant is None for j in p.joins)
        )

    def _fold_but_own(self, out: DataFrame, right: DataFrame, p: Pattern, answer: str) -> DataFrame:
        """Counts by key, less the match's own fact: no pairs are made."""
        keys = [(f"__k{i}", _name(p.alias, j.path), _name(j.ref.alias, j.path)) for i, j in enumerate(p.joins)]
        if self.has_session:
            keys.append(("__s", _name(p.alias, "$"), _name(p.joins[0].ref.alias, "$")))
        counts = right.groupBy(*(F.col(f"`{mine}`").alias(k) for k, mine, _ in keys)).agg((F.count(F.lit(1)) - 1).alias(answer))
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"`{other}`")) for k, _, other in keys])
        return out.join(counts, on).drop(*(k for k, *_ in keys))

    def _in_time(self, p: Pattern, earlier: list[Pattern]) -> Join | None:
        """The join of a fold over the facts in a span of time before or after a match's, beside equalities of the same types."""
        spans = [j for j in p.joins if j.op in ("after", "before")]
        same = [e.alias for e in earlier if e.fact == p.fact]
        if len(spans) != 1 or len(p.joins) < 2 or any(j.op != "eq" for j in p.joins if j is not spans[0]) or same not in ([], [spans[0].ref.alias]):
            return None
        mine = [self.kinds[_name(p.alias, j.path)] for j in p.joins]
        other = [self.kinds[_name(j.ref.alias, j.ref.path or "")] for j in p.joins]
        if any(a.value is None or b.value is None or a.variant is not None or a.dtype != b.dtype for a, b in zip(mine, other, strict=True)):
            return None
        if same and spans[0].path != spans[0].ref.path:  # a fact might be in its own span
            return None
        t = self.kinds[_name(p.alias, spans[0].path)].dtype
        return spans[0] if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.IntegralType)) and float(spans[0].within) >= 0 else None

    def _fold_in_time(self, out: DataFrame, right: DataFrame, p: Pattern, span: Join, answer: str) -> tuple[DataFrame, T.DataType]:
        """Matches and facts in one order of time by key, and a frame of it for each match: no pairs are made."""
        keys = [j for j in p.joins if j.op == "eq"]
        is_time = not isinstance(self.kinds[_name(p.alias, span.path)].dtype, T.IntegralType)
        clock = lambda n: F.unix_micros(F.col(f"`{n}`").cast("timestamp")) if is_time else F.col(f"`{n}`").cast("long")
        within = int(float(span.within) * 1_000_000) if is_time else int(span.within)
        side = [(f"__k{i}", j.path, j.ref) for i, j in enumerate(keys)]
        if self.has_session:
            first = self.rule.positives[0].alias
            side.append(("__s", "$", Ref(first, "$")))
        left = out.select(F.struct(*(F.col(f"`{c}`") for c in out.columns)).alias("__match"), *(F.col(f"`{_name(r.alias, r.path or '')}`").alias(k) for k, _, r in side), clock(_name(span.ref.alias, span.ref.path or "")).alias("__t"), F.lit(None).cast(out.schema[_name(span.ref.alias, "#")].dataType).alias("__h"))
        source = self.kinds.get(_name(p.alias, p.fold.path or "")) if p.fold.path else None
        facts = right.select(F.lit(None).cast(left.schema["__match"].dataType).alias("__match"), *(F.col(f"`{_name(p.alias, x)}`").alias(k) for k, x, _ in side), clock(_name(p.alias, span.path)).alias("__t"), F.col(f"`{_name(p.alias, '#')}`").alias("__h"), *([source.value.alias("__v")] if source is not None and source.value is not None else []))
        held = replace(source, value=F.col("__v")) if source is not None and source.value is not None else source
        aggregate, dtype = _aggregate(p.fold, held, F.col("__h"))
        low, high = (1, within) if span.op == "after" else (-within, -1)
        frame = Window.partitionBy(*(k for k, *_ in side)).orderBy("__t").rangeBetween(low, high)
        every = left.unionByName(facts, allowMissingColumns=True).withColumn(answer, F.when(F.col("__t").isNotNull(), aggregate.over(frame)))
        return every.filter(F.col("__match").isNotNull()).select("__match.*", f"`{answer}`"), dtype

    def fold(self, out: DataFrame, p: Pattern, earlier: list[Pattern]) -> DataFrame:
        fold = p.fold
        assert fold is not None
        right = self.side(p)
        answer = _name(p.alias, "=")
        source = self.kinds.get(_name(p.alias, fold.path or ""))
        aggregate, dtype = _aggregate(fold, source, F.col(f"`{_name(p.alias, '#')}`"))
        alone = all(j.op == "eq" for j in p.joins) and not any(e.fact == p.fact for e in earlier)
        on = self.on(p, earlier)
        span = self._in_time(p, earlier) if p.fold.function in ("count", "sum", "average") and (source is None or source.variant is None) else None
        if self._of_own_key(p, earlier):
            out = self._fold_but_own(out, right, p, answer)
        elif span is not None:
            out, dtype = self._fold_in_time(out, right, p, span, answer)
        elif alone and on is not None:  # equal keys only: sum by key once, however many matches ask
            keys = [_name(p.alias, j.path) for j in p.joins] + ([_name(p.alias, "$")] if self.has_session else [])
            right = right.groupBy(*{f"`{k}`": 0 for k in keys}).agg(aggregate.alias(answer))
            out = out.join(right, on, "left").drop(*[k for k in dict.fromkeys(keys)])
        elif on is None:
            out = out.crossJoin(F.broadcast(right.agg(aggregate.alias(answer))))  # one row
        else:
            handles = [f"`{_name(e.alias, '#')}`" for e in earlier] + ([f"`{_name(earlier[0].alias, '$')}`"] if self.has_session else [])
            read = sorted({_name(j.ref.alias, j.ref.path or "") for j in p.joins})
            left = out.select(*handles, *(f"`{n}`" for n in read if f"`{n}`" not in handles))
            summed = left.join(right, on).groupBy(*handles).agg(aggregate.alias(answer))
            same = reduce(lambda a, b: a & b, [F.col(h) == F.col(f"`r_{h[1:-1]}`") for h in handles])
            summed = summed.select(*(F.col(h).alias(f"r_{h[1:-1]}") for h in handles), f"`{answer}`")
            out = out.join(summed, same, "left").drop(*(f"r_{h[1:-1]}" for h in handles))
        shown = F.col(f"`{answer}`")
        if fold.function in ("count", "sum"):
            out = out.withColumn(answer, F.coalesce(shown, F.lit(0).cast(dtype)))
        is_variant = isinstance(dtype, T.VariantType)
        held = self.kinds[answer] = Cell(shown, kind_of(dtype), shown.isNotNull() if is_variant else None, shown if is_variant else None, dtype)
        if fold.having:
            out = out.filter(F.coalesce(test_column(held, _having(*fold.having)), F.lit(False)))
        return out


def _having(op: str, bound) -> Range | FieldTest:
    if op in ("gt", "gte"):
        return Range("", low=bound, low_inclusive=op == "gte")
    if op in ("lt", "lte"):
        return Range("", high=bound, high_inclusive=op == "lte")
    return FieldTest("", op, bound)


def _aggregate(fold: Fold, c: Cell | None, handle: Column) -> tuple[Column, T.DataType]:
    """The fold as an aggregate, and its type: sums and averages of what is a number, extremes by the class of the first value."""
    if fold.function == "count":
        return F.count(handle), T.LongType()
    numbers = part(c, "number") if c is not None else None
    if fold.function in ("sum", "average"):
        if numbers is None:
            return (F.lit(0).cast("long"), T.LongType()) if fold.function == "sum" else (F.max(F.lit(None).cast("double")), T.DoubleType())
        if fold.function == "sum" and isinstance(c.dtype, T.IntegralType):
            return F.sum(numbers), T.LongType()
        total = F.sum(numbers) if fold.function == "sum" else F.sum(numbers) / F.count(numbers)
        return total.cast("double"), T.DoubleType()
    best = {"min": F.min, "max": F.max}[fold.function]
    if c is None or c.value is None:
        return F.max(F.lit(None).cast("double")), T.DoubleType()
    if c.variant is None:
        if c.kind in ("number", "float", "string", "time"):
            return best(c.value), c.dtype
        return F.min_by(c.value, F.when(c.value.isNotNull(), handle)), c.dtype  # no order: the first value
    texts = part(c, "string")
    kind = F.when(numbers.isNotNull(), 1).when(texts.isNotNull(), 2).when(c.variant.isNotNull() & ~F.is_variant_null(c.variant), 3)
    first = F.min(F.when(kind.isNotNull(), F.struct(handle.alias("handle"), kind.alias("kind"))))["kind"]
    most = best(numbers)
    number = F.when((most == F.floor(most)) & (F.abs(most) < 2**62), most.cast("long").cast("variant")).otherwise(most.cast("double").cast("variant"))
    other = F.min_by(c.variant, F.when(kind == 3, handle))
    return F.when(first == 1, number).when(first == 2, best(texts).cast("variant")).when(first == 3, other), T.VariantType()


def value_column(v: Value, m: Matches) -> Column:
    """A value of an action; a field that isn't there is null."""
    if isinstance(v, Literal):
        return F.lit(v.value) if not isinstance(v.value, (dict, list)) else F.parse_json(F.lit(dumps(v.value)))
    if isinstance(v, Ref):
        if v.path is None:
            return F.col(f"`{_name(v.alias, '=')}`")
        c = m.kinds[_name(v.alias, v.path)]
        return F.lit(None) if c.value is None else c.value
    return result(emit(parse(v.text), m), f"rule '{m.rule.id}': no overload or no such key in: {v.text}")


def matches(rule: Rule, sources: SourceMap) -> DataFrame:
    """The matches of a rule: columns alias::# for the handles of its positive patterns, and what it reads."""
    return Matches(rule, sources).build()


def emitted(rule: Rule, sources: SourceMap, event: str | None = None) -> DataFrame:
    """The payloads that a rule's emit makes, one row a match, columns as the payload names them."""
    m = Matches(rule, sources)
    df = m.build()
    emit = next(a for a in rule.then if hasattr(a, "event") and event in (None, a.event))
    return df.select(*(value_column(v, m).alias(k) for k, v in emit.payload))


def ranked(rules: list[Rule], sources: SourceMap) -> DataFrame:
    """Firings of rules that change nothing, in their order: session_id, rule_id, handles, seq.

    The order is salience, then recency of the newest fact, both descending, then rule id and handles.
    """
    parts = []
    for place, r in enumerate(sorted(rules, key=lambda r: r.id.encode("utf-16-be"))):
        m = Matches(r, sources)
        df = m.build()
        newest = [F.col(f"`{_name(p.alias, '^')}`").cast("long") for p in r.positives]
        parts.append(
            df.select(
                (F.col(f"`{_name(r.positives[0].alias, '$')}`").cast("string") if m.has_session else F.lit("")).alias("session_id"),
                F.lit(r.id).alias("rule_id"),
                F.lit(r.salience).alias("salience"),
                F.lit(place).alias("place"),
                (F.greatest(*newest) if len(newest) > 1 else newest[0]).alias("recency"),
                F.array(*(F.col(f"`{_name(p.alias, '#')}`").cast("long") for p in r.positives)).alias("handles"),
            )
        )
    every = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("session_id").orderBy(F.desc("salience"), F.desc("recency"), "place", "handles")
    return every.withColumn("seq", F.row_number().over(order).cast("long")).select("session_id", "rule_id", "handles", "seq")


__all__ = ["Facts", "Matches", "SourceMap", "emitted", "matches", "ranked", "value_column"]
