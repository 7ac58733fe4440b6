"""Alert-rule conditions as columns.

A condition is text written by a tenant and therefore untrusted.  It is never
handed to SQL: the few spellings that differ are replaced (``&&`` by ``and`` and
so on), the standard library's ``ast`` reads the result as one expression, and
only the node kinds below are turned into column expressions.  Everything else
raises ``ConditionError`` and the rule matches nothing.

Evaluation errors matter: a method on a null value fails the *whole* condition,
unless an earlier operand of ``&&`` / ``||`` already decided it.  A boolean
column is therefore read as three states - true, false, and null for "failed" -
and values of other kinds carry a separate error column next to nulls.

Conditions that differ in their texts and numbers only have one *shape*, in which
these are parameters (see ``lifted``). The driver compiles shapes; the values stay
columns of the rules, so a condition per rule costs the driver nothing.
"""

from __future__ import annotations

import ast
import keyword
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.functions.risk import risk_ordinal, type_ordinal
from trailwarden.functions.text import is_blank, iso_instant, strip_blanks

# --- Fixed values -----------------------------------------------------------
PROPERTIES = {
    "eventId": "string", "customerId": "string", "userId": "string",
    "sessionId": "string", "timestamp": "instant", "type": "type",
    "resource": "string", "action": "string", "query": "string",
    "ipAddress": "string", "userAgent": "string", "location": "string",
    "controls": "list", "riskLevel": "risk", "anomalous": "boolean",
    "tags": "map", "rawLog": "string",
}
WORDS = {
    "and": "and", "or": "or", "not": "~", "eq": "==", "ne": "!=", "lt": "<",
    "le": "<=", "gt": ">", "ge": ">=", "matches": "in", "true": "True",
    "false": "False", "null": "None",
}
SIGNS = {"&&": "and", "||": "or", "!": "~", "?.": "._if_present_."}
TRUE_WORDS = ("true", "on", "yes", "1")
FALSE_WORDS = ("false", "off", "no", "0")
MAX_LENGTH = 10_000
TOO_LONG = "condition is too long"
# Starts a shape; before s, i or d it stands for a text, an integer or a decimal.
MARK = "\x01"
# Columns of the rules that hold the values of their shapes' parameters.
PARAMETERS = {"s": "ruleTexts", "i": "ruleIntegers", "d": "ruleDecimals"}
# ----------------------------------------------------------------------------

_TOKEN = re.compile(
    r"""\s*(?:(?P<text>'(?:[^']|'')*'|"(?:[^"]|"")*")
          |(?P<number>\d+(?:\.\d+)?(?![\w.]))
          |(?P<word>[A-Za-z_]\w*)
          |(?P<sign>&&|\|\||==|!=|<=|>=|\?\.|[!<>().,\[\]-])
          |\x01(?P<parameter>[sid]))""",
    re.X | re.A,
)
# The same tokens for Spark. Texts behind "matches" are patterns and stay.
_TEXT = r"""(?:'[^']*+(?:''[^']*+)*+'|"[^"]*+(?:""[^"]*+)*+")"""
_TEXTS = rf"\b(?i:matches)\b[\s(]*+{_TEXT}(?:\s*+{_TEXT})*+|{_TEXT}"
_NUMBERS = r"(?<![\w.])(?:\d+\.\d+|\d{1,18})(?![\w.])"


class ConditionError(ValueError):
    """The condition is outside the accepted language."""


@dataclass
class Value:
    """A typed operand. ``failed`` is a column, or None if it cannot fail.

    For booleans a failure is a null ``column``; ``shaky`` tells if there may be one.
    """

    kind: str
    column: Column
    failed: Column | None = None
    shaky: bool = False
    literal: object = None
    name: str | None = None
    parameter: int | None = None


@dataclass
class Compiled:
    matches: Column
    warnings: list[str] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)
    #: Property and text parameter that must be equal for the condition to hold.
    key: tuple[str, int] | None = None


def lifted(text: Column) -> Column:
    """The shape of a condition and the values of its parameters, as a struct.

    A shape is the text with a mark in place of each text and number; a
    condition without any is its own shape, an over-long one has none.
    """

    def marked(c: Column, tokens: Column, pattern: str, mark: Callable[[Column], Column]) -> Column:
        parts = F.transform(F.split(c, pattern, -1), lambda p, i: F.concat(p, F.coalesce(mark(F.get(tokens, i)), F.lit(""))))
        return F.array_join(parts, "")

    def plain(token: Column) -> Column:
        quote = F.substring(token, 1, 1)
        return F.replace(token.substr(F.lit(2), F.length(token) - 2), F.concat(quote, quote), quote)

    def given(value: Column, then: Callable[[Column], Column]) -> Column:  # worked out once, however often it is named
        return F.get(F.transform(F.array(value), then), F.lit(0))

    quoted = lambda t: F.substring(t, 1, 1).isin("'", '"')
    decimal = lambda t: F.contains(t, F.lit("."))

    def of_texts(whole: Column, texts: Column) -> Column:
        once = marked(whole, texts, _TEXTS, lambda t: F.when(quoted(t), F.lit(MARK + "s")).otherwise(t))
        return given(once, lambda c: given(numbers_in(c), lambda numbers: of_numbers(whole, texts, c, numbers)))

    def numbers_in(once: Column) -> Column:  # beside a pattern they stay as they are
        return F.when(F.regexp_like(once, F.lit("['\"]")), F.array().cast("array<string>")).otherwise(
            F.regexp_extract_all(once, F.lit(_NUMBERS), F.lit(0)))

    def of_numbers(whole: Column, texts: Column, once: Column, numbers: Column) -> Column:
        mark = lambda t: F.when(decimal(t), F.lit(MARK + "d")).when(t.isNotNull(), F.lit(MARK + "i"))
        twice = F.when(F.size(numbers) == 0, once).otherwise(marked(once, numbers, _NUMBERS, mark))
        odd = F.contains(whole, F.lit(MARK))  # refused outside a text, where it must not be taken for a mark
        kept = F.when(F.startswith(whole, F.lit(MARK)), F.concat(F.lit(" "), whole)).otherwise(whole)
        unlike = lambda c: F.when(odd, kept).when(c == whole, c).otherwise(F.concat(F.lit(MARK), c))
        return F.struct(
            given(twice, unlike).alias("ruleShape"),
            F.transform(F.filter(texts, quoted), plain).alias(PARAMETERS["s"]),
            F.transform(F.filter(numbers, lambda t: ~decimal(t)), lambda t: t.cast("bigint")).alias(PARAMETERS["i"]),
            F.transform(F.filter(numbers, decimal), lambda t: t.cast("double")).alias(PARAMETERS["d"]),
        )

    short = F.when(F.length(text) <= MAX_LENGTH, text)
    return given(short, lambda c: given(F.regexp_extract_all(c, F.lit(_TEXTS), F.lit(0)), lambda texts: of_texts(c, texts)))


def _respell(text: str) -> str:
    out, position = [], 0
    seen = dict.fromkeys(PARAMETERS, 0)
    is_shape = text.startswith(MARK)
    text = text.removeprefix(MARK).strip()
    while position < len(text):
        token = _TOKEN.match(text, position)
        if not token or (token["parameter"] and not is_shape):
            raise ConditionError(f"unexpected character {text[position:].lstrip()[:1]!r}")
        position = token.end()
        if token["text"]:
            quote = token["text"][0]
            out.append(repr(token["text"][1:-1].replace(quote * 2, quote)))
        elif token["number"]:
            number = token["number"]
            out.append(number if "." in number else str(int(number)))
        elif token["word"]:
            word = WORDS.get(token["word"].lower(), token["word"])
            if word == token["word"] and keyword.iskeyword(word) and word not in ("and", "or"):
                raise ConditionError(f"unexpected word {word!r}")
            out.append(word)
        elif token["parameter"]:  # texts side by side are one, as in the language read; no condition spells bytes
            kind = token["parameter"]
            out.append(repr(f"{MARK}{seen[kind]}{MARK}") if kind == "s" else f"b'{kind}{seen[kind]}'")
            seen[kind] += 1
        else:
            out.append(SIGNS.get(token["sign"], token["sign"]))
    return " ".join(out)


def _any_failed(*values: Value) -> Column | None:
    total = None
    for value in values:
        mine = value.failed
        if value.kind == "boolean" and value.shaky:
            mine = value.column.isNull()
        if mine is not None:
            total = mine if total is None else total | mine
    return total


def _boolean(test: Column, failed: Column | None) -> Value:
    if failed is None:
        return Value("boolean", test)
    return Value("boolean", F.when(~failed, test), shaky=True)


class _Compiler:
    def __init__(self, is_shape: bool = False) -> None:
        self.is_shape = is_shape
        self.warnings: list[str] = []
        self.patterns: list[str] = []

    # -- operands ------------------------------------------------------------
    def value(self, node: ast.AST) -> Value:
        build = getattr(self, f"_{type(node).__name__.lower()}", None)
        if build is None:
            raise ConditionError(f"{type(node).__name__} is not allowed")
        return build(node)

    def _constant(self, node: ast.Constant) -> Value:
        value = node.value
        if value is None:
            return Value("null", F.lit(None), literal=None)
        if isinstance(value, bytes):
            which = re.fullmatch(rb"([id])(\d+)", value)
            if not which:
                raise ConditionError("numbers side by side")
            return Value("number", F.get(F.col(PARAMETERS[which[1].decode()]), F.lit(int(which[2]))), literal=value)
        if self.is_shape and isinstance(value, str) and MARK in value:
            parts = [int(k) for k in value.split(MARK)[1::2]]
            columns = [F.get(F.col(PARAMETERS["s"]), F.lit(k)) for k in parts]
            one = len(parts) == 1
            return Value("string", columns[0] if one else F.concat(*columns), literal=parts, parameter=parts[0] if one else None)
        kinds = {bool: "boolean", str: "string", int: "number", float: "number"}
        kind = kinds.get(type(value))
        if kind is None or (type(value) is int and abs(value) >= 2**63):
            raise ConditionError("unsupported literal")
        return Value(kind, F.lit(value), literal=value)

    def _name(self, node: ast.Name) -> Value:
        kind = PROPERTIES.get(node.id)
        if kind is None:
            raise ConditionError(f"unknown property {node.id!r}")
        if kind == "boolean":
            return Value(kind, F.coalesce(F.col(node.id), F.lit(False)))
        return Value(kind, F.col(node.id), name=node.id)

    def _subscript(self, node: ast.Subscript) -> Value:
        target = self.value(node.value)
        index = node.slice
        if target.kind != "map":
            raise ConditionError("only tags can be indexed")
        if isinstance(index, ast.Name):  # tags[k] names the key "k"
            return Value("string", F.element_at(target.column, index.id))
        key = self.value(index)
        if key.kind != "string" or key.literal is None:
            raise ConditionError("a tag key must be a text literal")
        return Value("string", F.element_at(target.column, key.column))

    def _call(self, node: ast.Call) -> Value:
        if node.keywords or any(isinstance(a, ast.Starred) for a in node.args):
            raise ConditionError("unsupported arguments")
        arguments = [self.value(a) for a in node.args]
        if isinstance(node.func, ast.Name):  # a getter of the event itself
            return self._getter(node.func.id, arguments)
        if not isinstance(node.func, ast.Attribute):
            raise ConditionError("not callable")
        target, name = node.func.value, node.func.attr
        optional = isinstance(target, ast.Attribute) and target.attr == "_if_present_"
        return self.method(self.value(target.value if optional else target), name, arguments, optional)

    def _getter(self, name: str, arguments: list[Value]) -> Value:
        found = re.fullmatch(r"(?:get|is)([A-Z]\w*)", name)
        prop = found and found[1][0].lower() + found[1][1:]
        if arguments or prop not in PROPERTIES or name.startswith("is") != (prop == "anomalous"):
            raise ConditionError(f"unknown method {name!r}")
        return self._name(ast.Name(prop))

    def method(self, x: Value, name: str, arguments: list[Value], optional: bool) -> Value:
        c = x.column
        if x.kind in ("type", "risk"):
            ordinal = type_ordinal(c) if x.kind == "type" else risk_ordinal(c)
            table = {("name", 0): ("string", c), ("toString", 0): ("string", c), ("ordinal", 0): ("number", ordinal)}
        elif x.kind == "instant":
            table = {("toString", 0): ("string", iso_instant(c))}
        elif x.kind in ("list", "map"):
            size = F.size(c)
            table = {("isEmpty", 0): ("boolean", size == 0), ("size", 0): ("number", size)}
            if x.kind == "map" and len(arguments) == 1 and arguments[0].kind == "string":
                key = arguments[0].column
                table[("get", 1)] = ("string", F.element_at(c, key))
                table[("containsKey", 1)] = ("boolean", F.map_contains_key(c, key))
        elif x.kind == "string":
            table = self._text_methods(c, arguments)
        else:
            table = {}
        found = table.get((name, len(arguments)))
        if found is None:
            raise ConditionError(f"no method {name}/{len(arguments)} on {x.kind}")
        kind, column = found
        # A null target is an error; with ?. it is a null result instead.
        failed = _any_failed(x, *arguments)
        if not optional:
            failed = c.isNull() if failed is None else failed | c.isNull()
        if name in ("contains", "startsWith", "endsWith"):
            missing = arguments[0].column.isNull()
            failed = missing & c.isNotNull() if failed is None else failed | (missing & c.isNotNull())
        if kind != "boolean":
            return Value(kind, column, failed)
        if optional and failed is None:
            return Value(kind, column, shaky=True)
        return _boolean(column, failed)

    @staticmethod
    def _text_methods(c: Column, arguments: list[Value]) -> dict:
        table = {
            ("isEmpty", 0): ("boolean", c == ""),
            ("isBlank", 0): ("boolean", is_blank(c)),
            # counted in UTF-16 units
            ("length", 0): ("number", F.length(F.encode(c, "UTF-16BE")) / F.lit(2)),
            ("toLowerCase", 0): ("string", F.lower(c)),
            ("toUpperCase", 0): ("string", F.upper(c)),
            ("trim", 0): ("string", strip_blanks(c)),
            ("toString", 0): ("string", c),
        }
        if len(arguments) == 1 and arguments[0].kind == "string":
            a = arguments[0].column
            same = F.lower(F.upper(c)) == F.lower(F.upper(a))
            table |= {
                ("contains", 1): ("boolean", F.contains(c, a)),
                ("startsWith", 1): ("boolean", F.startswith(c, a)),
                ("endsWith", 1): ("boolean", F.endswith(c, a)),
                ("equals", 1): ("boolean", F.coalesce(c == a, F.lit(False))),
                ("equalsIgnoreCase", 1): ("boolean", F.coalesce(same, F.lit(False))),
            }
        return table

    # -- booleans ------------------------------------------------------------
    def truth(self, x: Value) -> Value:
        """The operand as a boolean; texts such as 'yes' convert."""
        if x.kind == "boolean":
            return x
        if x.kind == "null":
            return Value("boolean", F.lit(None).cast("boolean"), shaky=True)
        if x.kind != "string":
            raise ConditionError(f"a {x.kind} is not a boolean")
        word = F.lower(strip_blanks(x.column))
        test = F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))
        return Value("boolean", F.when(~x.failed, test) if x.failed is not None else test, shaky=True)

    def _boolop(self, node: ast.BoolOp) -> Value:
        operands = [self.truth(self.value(v)) for v in node.values]
        decides = isinstance(node.op, ast.Or)
        return self._fold(operands, decides)

    def _fold(self, operands: list[Value], decides: bool) -> Value:
        # Both operators are associative, so a long chain becomes a shallow tree.
        if len(operands) == 1:
            return operands[0]
        middle = len(operands) // 2
        a, b = self._fold(operands[:middle], decides), self._fold(operands[middle:], decides)
        if not a.shaky:  # then SQL's own logic gives the same three states
            column = a.column | b.column if decides else a.column & b.column
        else:
            # picked by a's value; a null (failed) a picks null
            by_value = [b.column, F.lit(True)] if decides else [F.lit(False), b.column]
            column = F.get(F.array(*by_value), a.column.cast("int"))
        return Value("boolean", column, shaky=a.shaky or b.shaky)

    def _unaryop(self, node: ast.UnaryOp) -> Value:
        if isinstance(node.op, ast.USub):
            operand = self.value(node.operand)
            if operand.kind == "number" and operand.literal is not None:
                return Value("number", -operand.column, literal=operand.literal)
        if not isinstance(node.op, ast.Invert):
            raise ConditionError("unsupported operator")
        inner, negated = node.operand, True
        while isinstance(inner, ast.UnaryOp) and isinstance(inner.op, ast.Invert):  # a run of them is one or none
            inner, negated = inner.operand, not negated
        operand = self.truth(self.value(inner))
        return Value("boolean", ~operand.column if negated else operand.column, shaky=operand.shaky)

    def _compare(self, node: ast.Compare) -> Value:
        if len(node.ops) != 1:
            raise ConditionError("comparisons cannot be chained")
        a, b = self.value(node.left), self.value(node.comparators[0])
        op = type(node.ops[0]).__name__
        if op == "In":
            return self._matches(a, b)
        if op in ("Eq", "NotEq"):
            test = self._equal(a, b)
            return _boolean(test if op == "Eq" else ~test, _any_failed(a, b))
        if op in ("Lt", "LtE", "Gt", "GtE"):
            return _boolean(self._ordered(op, a, b), _any_failed(a, b))
        raise ConditionError("unsupported comparison")

    def _equal(self, a: Value, b: Value) -> Column:
        if a.kind == "null" or b.kind == "null":
            other = b if a.kind == "null" else a
            return F.lit(other.kind == "null") if other.kind in ("null", "boolean") else other.column.isNull()
        if a.kind == b.kind:
            if a.kind in ("list", "map"):
                raise ConditionError(f"{a.kind}s cannot be compared")
            return a.column.eqNullSafe(b.column)
        if {a.kind, b.kind} == {"type", "risk"}:
            raise ConditionError("an event type cannot be compared with a risk level")
        if "string" in (a.kind, b.kind) and {"type", "risk"} & {a.kind, b.kind}:
            self.warnings.append("an enumerated value never equals a text; use .name()")
        return a.column.isNull() & b.column.isNull()

    def _ordered(self, op: str, a: Value, b: Value) -> Column:
        kinds = {a.kind, b.kind} - {"null"}
        if len(kinds) > 1 or kinds & {"boolean", "list", "map"}:
            raise ConditionError("values cannot be ordered")
        x, y = a.column, b.column
        if kinds & {"type", "risk"}:
            rank = type_ordinal if "type" in kinds else risk_ordinal
            x, y = (x if a.kind == "null" else rank(x)), (y if b.kind == "null" else rank(y))
        # null ranks below every value
        if not kinds:
            return F.lit(op in ("LtE", "GtE"))
        less = F.when(x.isNull(), y.isNotNull()).when(y.isNull(), F.lit(False)).otherwise(x < y)
        more = F.when(y.isNull(), x.isNotNull()).when(x.isNull(), F.lit(False)).otherwise(x > y)
        return {"Lt": less, "Gt": more, "LtE": ~more, "GtE": ~less}[op]

    def _matches(self, a: Value, b: Value) -> Value:
        if a.kind not in ("string", "type", "risk") or b.kind != "string" or not isinstance(b.literal, str):
            raise ConditionError("matches needs a text and a literal pattern")
        whole = rf"\A(?:{b.literal})\z"
        self.patterns += [b.literal, whole]
        failed = a.column.isNull() if a.failed is None else a.failed | a.column.isNull()
        return _boolean(F.regexp_like(a.column, F.lit(whole)), failed)

    # -- keys ----------------------------------------------------------------
    def key(self, node: ast.AST) -> tuple[str, int] | None:
        """A ``property == text parameter`` that holds wherever the whole does."""
        if isinstance(node, ast.BoolOp) and isinstance(node.op, ast.And):
            return next(filter(None, map(self.key, node.values)), None)
        if not (isinstance(node, ast.Compare) and len(node.ops) == 1 and isinstance(node.ops[0], ast.Eq)):
            return None
        a, b = self.value(node.left), self.value(node.comparators[0])
        for x, y in ((a, b), (b, a)):
            if x.kind == "string" and x.name and y.parameter is not None:
                return x.name, y.parameter
        return None


def compile_condition(text: str) -> Compiled:
    """Column that is true exactly for the events the condition, or its shape, matches."""
    if len(text) > MAX_LENGTH and not text.startswith(MARK):
        raise ConditionError(TOO_LONG)
    try:
        tree = ast.parse(_respell(text), mode="eval")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise ConditionError(f"not a condition: {e}") from e
    compiler = _Compiler(text.startswith(MARK))
    try:
        result = compiler.truth(compiler.value(tree.body))
        warnings, patterns = list(compiler.warnings), list(compiler.patterns)
        key = compiler.key(tree.body)
    except RecursionError as e:
        raise ConditionError("nested too deeply") from e
    return Compiled(F.coalesce(result.column, F.lit(False)), warnings, patterns, key)


def patterns_work(spark: SparkSession, patterns: list[str]) -> bool:
    """Whether the engine accepts all the patterns (one tiny job)."""
    tests = [F.regexp_like(F.lit(""), F.lit(p)).alias(f"p{i}") for i, p in enumerate(patterns)]
    try:
        spark.range(1).select(*tests).collect()
    except Exception:
        return False
    return True


@dataclass
class ConditionSet:
    """The distinct conditions, or shapes, of a rule set, numbered for cheap matching."""

    compiled: dict[int, Compiled]
    ids: dict[str, int]
    errors: dict[str, str]
    #: Numbers of those that many rules share.
    common: set[int] = field(default_factory=set)

    def match(self, condition_id: Column) -> Column:
        """True where the row's own condition holds; id 0 is "no condition".

        A balanced tree over the numbers: a row evaluates its own condition
        after as many comparisons as the set's size has bits.
        """
        numbers = sorted(self.compiled)

        def among(low: int, high: int) -> Column:
            if high - low == 1:
                number = numbers[low]
                return F.when(condition_id == number, self.compiled[number].matches).otherwise(F.lit(False))
            middle = (low + high) // 2
            return F.when(condition_id < numbers[middle], among(low, middle)).otherwise(among(middle, high))

        own = among(0, len(numbers)) if numbers else F.lit(False)
        return F.when(condition_id == 0, F.lit(True)).otherwise(own)


def compile_all(spark: SparkSession, texts: list[str]) -> ConditionSet:
    """Compile every condition; what is rejected only disables its own rules."""
    result = ConditionSet({}, {text: n for n, text in enumerate(texts, start=1)}, {})
    for text, number in result.ids.items():
        try:
            result.compiled[number] = compile_condition(text)
        except ConditionError as e:
            result.errors[text] = str(e)
    patterns = [p for c in result.compiled.values() for p in c.patterns]
    if patterns and not patterns_work(spark, patterns):
        # A malformed pattern must not stop the job: find the conditions to drop.
        for text, number in result.ids.items():
            found = result.compiled.get(number)
            if found and found.patterns and not patterns_work(spark, found.patterns):
                del result.compiled[number]
                result.errors[text] = f"malformed pattern {found.patterns[0]!r}"
    return result


def rule_errors(rules: DataFrame, conditions: ConditionSet) -> DataFrame:
    """Rules whose condition was rejected, over-long ones included, with the reason."""
    table = pa.table(
        {"_text": pa.array(conditions.errors.keys(), pa.string()), "_why": pa.array(conditions.errors.values(), pa.string())}
    )
    listed = F.broadcast(rules.sparkSession.createDataFrame(table))  # the driver has them
    shape = lifted(F.col("conditionExpression"))["ruleShape"]
    joined = rules.withColumn("_shape", shape).join(listed, F.col("_shape") == F.col("_text"), "left")
    error = F.when(F.length("conditionExpression") > MAX_LENGTH, F.lit(TOO_LONG)).otherwise(F.col("_why"))
    return joined.select("ruleId", "customerId", "conditionExpression", error.alias("error")).where("error IS NOT NULL")


__all__ = [
    "Compiled", "ConditionError", "ConditionSet",
    "compile_all", "compile_condition", "lifted", "rule_errors",
]
