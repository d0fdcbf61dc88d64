"""One expression parser, four dialects, compiled to Columns.

``field``: calculations over table columns. ``raster``: map algebra over band variables. ``index``: spectral formulas over band
names. ``where``: row selection. Text is parsed here (nothing is evaluated as Python), names are resolved at
compile time and the result stays inside whole-stage code generation.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<str>'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\")|\[(?P<col>[^\]]+)\]|(?P<name>\$?[^\W\d]\w*)|(?P<op>\*\*|//|<>|<=|>=|==|!=|[-+*/%^<>=(),&|~]))")
_COMPARE = {"=": "==", "==": "==", "<>": "!=", "!=": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
_MIRROR = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}


class ExpressionError(ValueError):
    """The text isn't an expression of the dialect, or names something unknown."""


@dataclass
class Node:
    kind: str
    value: object = None
    args: list = field(default_factory=list)


class _Parser:
    """Precedence climbing over: if/else, or, and, not, comparison, | &, + -, * / // %, sign, power."""

    def __init__(self, text: str, longest: int = 2000):
        if not text or not text.strip():
            raise ExpressionError("empty expression")
        if len(text) > longest:
            raise ExpressionError(f"more than {longest} characters")
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"can't read {text[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.i = 0

    def peek(self, *words: str) -> bool:
        kind, value = self.tokens[self.i]
        return (kind == "op" and value in words) or (kind == "name" and value.lower() in words)

    def take(self, *words: str) -> str | None:
        if self.peek(*words):
            self.i += 1
            return self.tokens[self.i - 1][1].lower()
        return None

    def need(self, word: str) -> None:
        if not self.take(word):
            raise ExpressionError(f"expected {word!r} before {self.tokens[self.i][1]!r}")

    def whole(self) -> Node:
        node = self.choice()
        if self.tokens[self.i][0] != "end":
            raise ExpressionError(f"unexpected {self.tokens[self.i][1]!r}")
        return node

    def choice(self) -> Node:
        node = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Node("if", args=[test, node, self.choice()])
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", args=[node, self.both()])
        return node

    def both(self) -> Node:
        node = self.negation()
        while self.take("and"):
            node = Node("and", args=[node, self.negation()])
        return node

    def negation(self) -> Node:
        return Node("not", args=[self.negation()]) if self.take("not") else self.comparison()

    def comparison(self) -> Node:
        left, parts = self.bits(), []
        while True:
            if op := self.take(*_COMPARE):
                right = self.bits()
                parts.append(Node("cmp", _COMPARE[op], [left, right]))
                left = right
            elif self.peek("in", "like") or (self.peek("not") and self.tokens[self.i + 1][1].lower() in ("in", "like")):
                no = bool(self.take("not"))
                word = self.take("in", "like")
                node = Node(word, args=[left, self.listing() if word == "in" and self.peek("(") else self.bits()])
                parts.append(Node("not", args=[node]) if no else node)
            elif self.take("is"):
                no = bool(self.take("not"))
                self.need("null")
                node = Node("missing", args=[left])
                parts.append(Node("not", args=[node]) if no else node)
            else:
                break
        return left if not parts else reduce(lambda a, b: Node("and", args=[a, b]), parts)

    def listing(self) -> Node:
        self.need("(")
        items = []
        while not self.take(")"):
            items.append(self.choice())
            if not self.take(","):
                self.need(")")
                break
        return Node("list", args=items)

    def bits(self) -> Node:
        node = self.sums()
        while op := self.take("&", "|"):
            node = Node("and" if op == "&" else "or", args=[node, self.sums()])
        return node

    def sums(self) -> Node:
        node = self.products()
        while op := self.take("+", "-"):
            node = Node("math", op, [node, self.products()])
        return node

    def products(self) -> Node:
        node = self.signed()
        while op := self.take("*", "/", "//", "%"):
            node = Node("math", op, [node, self.signed()])
        return node

    def signed(self) -> Node:
        if self.take("-"):
            return Node("minus", args=[self.signed()])
        if self.take("+"):
            return self.signed()
        if self.take("~"):
            return Node("not", args=[self.signed()])
        return self.power()

    def power(self) -> Node:
        node = self.atom()
        return Node("math", "**", [node, self.signed()]) if self.take("**", "^") else node

    def atom(self) -> Node:
        kind, value = self.tokens[self.i]
        self.i += 1
        if kind == "num":
            return Node("num", float(value))
        if kind == "str":
            body = value[1:-1]
            return Node("str", re.sub(r"\\(.)", r"\1", body.replace("''", "'") if value[0] == "'" else body))
        if kind == "col":
            return Node("col", value)
        if kind == "name":
            if self.peek("("):
                return Node("call", value.lower(), self.listing().args)
            return Node("name", value)
        if value == "(":
            node = self.choice()
            self.need(")")
            return node
        raise ExpressionError(f"unexpected {value!r}")


def parse(text: str, longest: int = 2000) -> Node:
    return _Parser(text, longest).whole()


def names_in(node: Node) -> set[str]:
    """Column names and bare names of an expression: what a projection must keep."""
    own = {node.value} if node.kind in ("col", "name") else set()
    return own.union(*(names_in(a) for a in node.args)) if node.args else own


@dataclass
class Value:
    """A Column and what it is: num, text, bool or null."""

    col: Column
    kind: str


def _null() -> Value:
    return Value(F.lit(None).cast("double"), "null")


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != math.inf), c)


def number_text(c: Column) -> Column:
    """A double as text; whole ones without a fraction."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))


def kind_of(dtype: T.DataType) -> str:
    """The logical kind of a column: integer, number, boolean, date or text."""
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "number"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "date" if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "text"


class Dialect:
    """Columns of a schema by name, and what operators and functions mean. Subclasses say what differs."""

    constants: Mapping[str, float] = {"pi": math.pi, "e": math.e}

    def __init__(self, schema: T.StructType | Sequence[str], extra: Mapping[str, Value] | None = None):
        fields = schema.fields if isinstance(schema, T.StructType) else [T.StructField(n, T.DoubleType()) for n in schema]
        self.fields = {f.name: f.dataType for f in fields}
        self.extra = dict(extra or {})

    # Names
    def column(self, name: str) -> Value:
        if name in self.extra:
            return self.extra[name]
        if name not in self.fields:
            raise ExpressionError(f"unknown name {name!r}")
        c, kind = F.col(f"`{name.replace('`', '``')}`"), kind_of(self.fields[name])
        if kind in ("integer", "number"):
            return Value(finite(c.cast("double")), "num")
        return Value(c, "bool") if kind == "boolean" else Value(c.cast("string"), "text")

    def name(self, name: str) -> Value:
        low = name.lower()
        if name not in self.fields and name not in self.extra:
            if low in ("true", "false"):
                return Value(F.lit(low == "true"), "bool")
            if low in ("null", "none"):
                return _null()
            if low in self.constants:
                return Value(F.lit(self.constants[low]), "num")
        return self.column(name)

    # Coercions
    def num(self, v: Value) -> Column:
        if v.kind == "text":
            return F.trim(v.col).try_cast("double")
        return v.col.cast("double") if v.kind in ("bool", "null") else v.col

    def text(self, v: Value) -> Column:
        if v.kind == "null":
            return F.lit("")
        c = number_text(v.col) if v.kind == "num" else v.col.cast("string")
        return F.coalesce(c, F.lit(""))

    def truth(self, v: Value) -> Column:
        if v.kind == "bool":
            return F.coalesce(v.col, F.lit(False))
        if v.kind == "text":
            return F.coalesce(~F.lower(F.trim(v.col)).isin("", "false", "0", "no"), F.lit(False))
        return F.coalesce(v.col != 0, F.lit(False))

    # Operators
    def compare(self, op: str, a: Value, b: Value) -> Column:
        if "text" in (a.kind, b.kind) and op in ("==", "!="):
            x, y = self.text(a), self.text(b)
        else:
            x, y = self.num(a), self.num(b)
        made = {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return F.coalesce(made, F.lit(op == "!="))

    def math(self, op: str, a: Value, b: Value) -> Value:
        if op == "+" and "text" in (a.kind, b.kind):
            return Value(F.concat(self.text(a), self.text(b)), "text")
        x, y = self.num(a), self.num(b)
        if op in ("+", "-", "*"):
            return Value({"+": x + y, "-": x - y, "*": x * y}[op], "num")
        if op == "**":
            return Value(finite(F.pow(x, y)), "num")
        ratio = F.try_divide(x, y)
        return Value({"/": ratio, "//": F.floor(ratio).cast("double"), "%": x - y * F.floor(ratio)}[op], "num")

    def member(self, a: Value, items: list[Value]) -> Column:
        return reduce(lambda p, q: p | q, (self.compare("==", a, i) for i in items), F.lit(False))

    def inside(self, a: Value, b: Value) -> Column:
        """Whether the text b contains a."""
        return F.contains(F.lower(self.text(b)), F.lower(self.text(a)))

    def pick(self, test: Column, a: Value, b: Value) -> Value:
        if "text" in (a.kind, b.kind):
            side = lambda v: v.col if v.kind == "text" else F.lit(None).cast("string") if v.kind == "null" else self.text(v)
            return Value(F.when(test, side(a)).otherwise(side(b)), "text")
        if a.kind == b.kind == "bool":
            return Value(F.when(test, a.col).otherwise(b.col), "bool")
        return Value(F.when(test, self.num(a)).otherwise(self.num(b)), "num")

    # Functions: name -> (least, most arguments, maker)
    def functions(self) -> dict:
        n, t = self.num, self.text
        one = lambda f: (1, 1, lambda a: Value(finite(f(n(a))), "num"))
        word = lambda f, kind="text": (1, 1, lambda a: Value(f(t(a)), kind))
        pair = lambda f: (2, 2, lambda a, b: Value(f(t(a), t(b)), "bool"))
        return {
            "abs": one(F.abs), "sqrt": one(F.sqrt), "log": one(F.log), "log10": one(F.log10), "exp": one(F.exp),
            "floor": one(lambda c: F.floor(c).cast("double")), "ceil": one(lambda c: F.ceil(c).cast("double")),
            "sin": one(F.sin), "cos": one(F.cos), "tan": one(F.tan),
            "round": (1, 2, self._round),
            "min": (1, 99, lambda *a: Value(F.least(*map(n, a)) if len(a) > 1 else n(a[0]), "num")),
            "max": (1, 99, lambda *a: Value(F.greatest(*map(n, a)) if len(a) > 1 else n(a[0]), "num")),
            "clip": (3, 3, lambda a, lo, hi: Value(F.when(n(a).isNotNull(), F.least(F.greatest(n(a), n(lo)), n(hi))), "num")),
            "iif": (3, 3, lambda c, a, b: self.pick(self.truth(c), a, b)),
            "coalesce": (1, 99, lambda *a: reduce(lambda x, y: self.pick(self.empty(x), y, x), a)),
            "isnull": (1, 1, lambda a: Value(self.empty(a), "bool")),
            "upper": word(F.upper), "lower": word(F.lower), "strip": word(F.trim), "title": word(title_case),
            "len": word(lambda c: F.length(c).cast("double"), "num"),
            "concat": (1, 99, lambda *a: Value(F.concat(*map(t, a)), "text")),
            "replace": (3, 3, lambda a, b, c: Value(F.replace(t(a), t(b), t(c)), "text")),
            "substr": (2, 3, self._substr),
            "contains": pair(lambda a, b: F.contains(F.lower(a), F.lower(b))), "startswith": pair(F.startswith), "endswith": pair(F.endswith),
            "number": (1, 1, lambda a: Value(finite(n(a)), "num")), "text": word(lambda c: c),
            "integer": one(lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("double")),
        }

    def empty(self, v: Value) -> Column:
        return v.col.isNull() | (v.col == "") if v.kind == "text" else v.col.isNull()

    def _round(self, a: Value, digits: Value | None = None) -> Value:
        if digits is None:
            return Value(F.bround(self.num(a)), "num")
        scale = F.pow(F.lit(10.0), self.num(digits))
        return Value(F.bround(self.num(a) * scale) / scale, "num")

    def _substr(self, a: Value, start: Value, length: Value | None = None) -> Value:
        c, s = self.text(a), self.num(start).cast("int")
        # 1-based; 0 reads as 1; a negative start counts from the end, less one.
        first = F.when(s > 0, s).when(s < 0, F.greatest(F.lit(1), F.length(c) + s)).otherwise(1)
        return Value(F.substring(c, first, self.num(length).cast("int") if length else F.length(c)), "text")

    # Compilation
    def build(self, node: Node) -> Value:
        k, args = node.kind, node.args
        if k == "num":
            return Value(F.lit(node.value), "num")
        if k == "str":
            return Value(F.lit(node.value), "text")
        if k == "col":
            return self.column(node.value)
        if k == "name":
            return self.name(node.value)
        if k == "math":
            return self.math(node.value, *map(self.build, args))
        if k == "minus":
            return Value(-self.num(self.build(args[0])), "num")
        if k == "cmp":
            return Value(self.compare(node.value, *map(self.build, args)), "bool")
        if k in ("and", "or"):
            a, b = (self.truth(self.build(x)) for x in args)
            return Value(a & b if k == "and" else a | b, "bool")
        if k == "not":
            return Value(~self.truth(self.build(args[0])), "bool")
        if k == "missing":
            return Value(self.empty(self.build(args[0])), "bool")
        if k == "if":
            test, a, b = map(self.build, args)
            return self.pick(self.truth(test), a, b)
        if k == "in":
            left = self.build(args[0])
            if args[1].kind == "list":
                return Value(self.member(left, [self.build(x) for x in args[1].args]), "bool")
            return Value(self.inside(left, self.build(args[1])), "bool")
        if k == "like":
            return Value(F.coalesce(F.like(F.lower(self.text(self.build(args[0]))), F.lower(self.text(self.build(args[1])))), F.lit(False)), "bool")
        if k == "call":
            least, most, make = self.functions().get(node.value, (0, 0, None))
            if make is None:
                raise ExpressionError(f"unknown function {node.value!r}")
            if not least <= len(args) <= most:
                raise ExpressionError(f"{node.value} takes {least} to {most} arguments")
            return make(*map(self.build, args))
        raise ExpressionError(f"{k} isn't allowed here")

    def compile(self, text: str, longest: int = 2000) -> Value:
        v = self.build(parse(text, longest))
        return Value(finite(v.col), "num") if v.kind == "num" else v


def title_case(c: Column) -> Column:
    """Capitals after every non-letter, the rest in lower case (also after apostrophes and digits)."""
    letters = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(letters, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


class FieldDialect(Dialect):
    """The field calculator."""


class RasterDialect(Dialect):
    """Map algebra: numbers only; null where any variable is null; booleans as 0 and 1; min and max propagate missing values."""

    def functions(self) -> dict:
        base, n = super().functions(), self.num
        keep = {k: base[k] for k in ("abs", "sqrt", "log", "log10", "exp", "floor", "ceil", "round", "clip", "sin", "cos", "tan")}
        some = lambda f: (2, 99, lambda *a: Value(F.when(reduce(lambda p, q: p & q, (n(x).isNotNull() for x in a)), f(*map(n, a))), "num"))
        return keep | {
            "where": (3, 3, lambda c, a, b: self.pick(self.truth(c), a, b)),
            "min": some(F.least), "max": some(F.greatest),
            "isnan": (1, 1, lambda a: Value(n(a).isNull(), "bool")),
            "nan_to_num": (1, 1, lambda a: Value(F.coalesce(n(a), F.lit(0.0)), "num")),
            "arctan": (1, 1, lambda a: Value(F.atan(n(a)), "num")), "arctan2": (2, 2, lambda a, b: Value(F.atan2(n(a), n(b)), "num")),
        }

    def compile(self, text: str, longest: int = 2000) -> Value:
        node = parse(text, longest)
        v = self.build(node)
        used = [self.name(x).col for x in sorted(names_in(node)) if x in self.fields]
        if not used:
            raise ExpressionError("no variable in the expression")
        known = reduce(lambda p, q: p & q, (c.isNotNull() for c in used))
        return Value(F.when(known, finite(v.col.cast("double"))), "num")


#: Names that formulas use for a sensor's bands.
BAND_NAMES = {
    "B02": ("blue",), "B03": ("green",), "B04": ("red",), "B05": ("rededge1", "rededge"), "B06": ("rededge2",), "B07": ("rededge3",),
    "B08": ("nir",), "B8A": ("nir2", "narrownir"), "B11": ("swir1", "swir"), "B12": ("swir2",), "VV": (), "VH": (),
}


def band_name(name: str) -> str | None:
    """The band a name stands for: B8, b08 and NIR all mean B08."""
    low = name.lower().replace("_", "")
    for band, others in BAND_NAMES.items():
        if low in (band.lower(), *others) or low == band.lower().replace("b0", "b"):
            return band
    return None


class IndexDialect(RasterDialect):
    """Spectral formulas: band names, arithmetic and a few functions; at least one band; min and max skip missing values."""

    def __init__(self, bands: Mapping[str, Column]):
        self.bands = {band_name(b) or b: c for b, c in bands.items()}
        super().__init__([])

    def name(self, name: str) -> Value:
        band = band_name(name)
        if band is None or band not in self.bands:
            raise ExpressionError(f"no band {name!r}")
        return Value(finite(self.bands[band].cast("double")), "num")

    column = name

    def functions(self) -> dict:
        base = Dialect.functions(self)
        return {k: base[k] for k in ("sqrt", "abs", "log", "log10", "exp", "min", "max")}

    def compile(self, text: str, longest: int = 500) -> Value:
        node = parse(text, longest)
        if not names_in(node):
            raise ExpressionError("no band in the formula")
        return Value(finite(self.build(node).col), "num")


class WhereDialect(Dialect):
    """Row selection: names without case; an unknown bare word is text; numbers where both sides read as numbers, else text without case."""

    def column(self, name: str) -> Value:
        match = {f.lower(): f for f in reversed(list(self.fields))}.get(name.lower())
        if match is None and name not in self.extra:
            return Value(F.lit(name), "text")
        return super().column(match or name)

    def compare(self, op: str, a: Value, b: Value) -> Column:
        if a.kind == "null" or b.kind == "null":
            other = b if a.kind == "null" else a
            absent = F.lit(True) if other.kind == "null" else other.col.isNull()
            return absent if op == "==" else ~absent if op == "!=" else F.lit(False)
        x, y = self.num(a), self.num(b)
        s, t = (F.lower(number_text(v.col) if v.kind == "num" else v.col.cast("string")) for v in (a, b))
        ops = {"==": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}
        f = ops[op]
        made = f(x, y) if "text" not in (a.kind, b.kind) else F.when(x.isNotNull() & y.isNotNull(), f(x, y)).otherwise(f(s, t))
        both_null = a.col.isNull() & b.col.isNull()
        return F.coalesce(made, both_null if op == "==" else ~both_null if op == "!=" else F.lit(False))

    def inside(self, a: Value, b: Value) -> Column:
        return F.coalesce(a.col.isNotNull() & super().inside(a, b), F.lit(False))

    def functions(self) -> dict:
        base, t = super().functions(), lambda v: F.coalesce(F.lower(number_text(v.col) if v.kind == "num" else v.col.cast("string")), F.lit("none"))
        pair = lambda f: (2, 2, lambda a, b: Value(f(t(a), t(b)), "bool"))
        return base | {"contains": pair(F.contains), "startswith": pair(F.startswith), "endswith": pair(F.endswith), "lower": (1, 1, lambda a: Value(t(a), "text"))}


def calculate(df: DataFrame, name: str, text: str, where: str | None = None, kind: str | None = None) -> DataFrame:
    """``df`` with the field ``name`` calculated; only in rows ``where`` selects (others keep the old value or null)."""
    col = FieldDialect(df.schema).compile(text).col
    if kind:
        col = cast_column(col, kind)
    if where:
        old = F.col(f"`{name}`") if name in df.columns else F.lit(None)
        col = F.when(select_condition(df, where), col).otherwise(old)
    return df.withColumn(name, col)


def select_condition(df: DataFrame, where: str) -> Column:
    d = WhereDialect(df.schema)
    return d.truth(d.compile(where))


def select_where(df: DataFrame, where: str) -> DataFrame:
    """Rows that the selection text picks."""
    return df.where(select_condition(df, where))


def cast_column(c: Column, kind: str) -> Column:
    """A column as number, integer, text or boolean; values that can't be read become null."""
    if kind == "number":
        return finite(c.try_cast("double"))
    if kind == "integer":
        return F.bround(finite(c.try_cast("double"))).try_cast("long")
    if kind == "boolean":
        word = F.lower(F.trim(c.cast("string")))
        return F.when(word.isin("true", "1", "yes", "1.0"), True).when(word.isin("false", "0", "no", "0.0"), False)
    if kind == "text":
        return c.cast("string")
    raise ExpressionError(f"unknown type {kind!r}")
