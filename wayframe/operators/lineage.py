"""Which columns of the sources a column comes of, by the analysed plan, and gates that refuse what comes of the future or of another split.

A future column is found under whatever name, inside a struct, or as part of an expression it reaches the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import FUTURE

Paths = frozenset[tuple[str, ...]]


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _leaves(name: tuple[str, ...], kind) -> Paths:
    """Paths of a column and the fields in its structs, arrays and maps."""
    which = kind.getClass().getSimpleName()
    if which == "StructType":
        return frozenset().union(*[_leaves((*name, f.name()), f.dataType()) for f in kind.fields()], frozenset() if kind.fields() else {name})
    if which == "ArrayType":
        return _leaves(name, kind.elementType())
    if which == "MapType":
        return _leaves(name, kind.valueType()) | _leaves(name, kind.keyType())
    return frozenset({name})


class _Plan:
    def __init__(self, df: DataFrame):
        #: by id of an attribute: the paths that it comes of, and whether it is such a column itself, maybe renamed
        self.known: dict[int, tuple[Paths, bool]] = {}
        self.plan = df._jdf.queryExecution().analyzed()
        self.visit(self.plan)

    def of(self, attribute) -> tuple[Paths, bool]:
        return self.known.get(attribute.exprId().id(), (frozenset(), False))

    def chain(self, e) -> tuple[Paths, bool, int]:
        """Paths, whether e is a column or field of a source, and how deep the field is."""
        which = e.getClass().getSimpleName()
        if which == "AttributeReference":
            paths, direct = self.of(e)
            return paths, direct, 1
        if which in ("GetStructField", "GetArrayStructFields"):
            paths, direct, depth = self.chain(e.child())
            name = e.extractFieldName() if which == "GetStructField" else e.field().name()
            if direct:
                return frozenset(p for p in paths if len(p) > depth and p[depth] == name), True, depth + 1
            return paths, False, depth
        found = frozenset().union(*[self.chain(c)[0] for c in _each(e.children())])
        if hasattr(e, "plan") and which.endswith("Subquery"):
            found |= self.visit(e.plan())
        return found, False, 1

    def visit(self, node) -> Paths:
        children = _each(node.children())
        below = frozenset().union(*[self.visit(c) for c in children])
        output, which = _each(node.output()), node.getClass().getSimpleName()
        if not children:
            for a in output:
                self.known[a.exprId().id()] = _leaves((a.name(),), a.dataType()), True
        elif which == "Union":
            for i, a in enumerate(output):
                parts = [self.of(_each(c.output())[i]) for c in children]
                self.known[a.exprId().id()] = frozenset().union(*[p for p, _ in parts]), False
        else:
            for e in _each(node.expressions()):
                if e.getClass().getSimpleName() == "Alias":
                    paths, direct, depth = self.chain(e.child())
                    self.known[e.exprId().id()] = paths, direct and depth == 1
            rest = frozenset().union(*[self.chain(e)[0] for e in _each(node.expressions())]) if which == "Generate" else below
            for a in output:  # what generators and functions over whole rows make
                self.known.setdefault(a.exprId().id(), (rest, False))
        return frozenset().union(*[self.of(a)[0] for a in output])


def sources(rows: DataFrame) -> dict[str, set[str]]:
    """By column of rows, the columns and fields of sources, with dots, that its values come of. Conditions of filters and joins do not count."""
    plan = _Plan(rows)
    return {a.name(): {".".join(p) for p in plan.of(a)[0]} for a in _each(plan.plan.output())}


def assert_no_future(rows: DataFrame, forbidden: tuple[str, ...] = FUTURE) -> DataFrame:
    """rows, or an error that names the columns that come of a forbidden column or field, whatever they are called now."""
    named = {c: {c} for c in rows.columns}
    for column, paths in sources(rows).items():
        named[column] = named.get(column, set()) | paths
    if leaked := sorted(c for c, paths in named.items() if any(part.lower() in forbidden for p in paths for part in p.split("."))):
        raise ValueError(f"columns of the future: {leaked}")
    return rows


def train_only(rows: DataFrame, split: str = "source_split") -> DataFrame:
    """rows of which each must be of the train split, if they have a column of that name; a fit on any other row fails as it runs."""
    if split not in rows.columns:
        return rows
    name = F.lower(F.trim(split))
    other = F.raise_error(F.concat(F.lit("a fit on the split "), F.coalesce(name, F.lit("null")))).cast("boolean")
    return rows.where(F.when(F.coalesce(name == "train", F.lit(False)), True).otherwise(other))
