"""Data contracts compiled into column expressions.

A contract becomes two things: boolean conditions, one per rule, and the message
of each rule. The row status needs only the conditions, so counting or routing
rows never builds a message, and a row that breaks no rule never does either.
Everything is a built-in expression evaluated in one pass over the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractflow.functions import numbers, text
from contractflow.model import CONTRACTS, DataContract, FieldConstraint, ViolationPolicy

PASS, COERCED, QUARANTINE, REJECT, DUPLICATE, ERROR = (
    "PASS", "COERCED", "QUARANTINE", "REJECT", "DUPLICATE", "ERROR")
ACCEPTED = (PASS, COERCED)

STATUS, VIOLATIONS, COERCIONS = "_status", "_violations", "_coercions"
#: The text of a row whose fields don't fit the header, NULL for all others; see the CSV scan.
MALFORMED = "_malformed"
MALFORMED_MESSAGE = "Row does not have the fields of the header."
FIXED_PREFIX = "_fixed_"


@dataclass(frozen=True)
class Rule:
    """One compiled rule: when it is broken and what to say then.

    The message is made on demand, so plans that only route rows stay small.
    """

    code: str
    broken: Column
    message: Callable[[], Column]


@dataclass(frozen=True)
class _Cell:
    """What the rules need to know about a value, before or after coercion."""

    absent: Column
    mistyped: Column
    type_name: str
    shown: Callable[[], Column]      # as str() prints it
    literal: Callable[[], Column]    # as repr() prints it
    number: Callable[[], Column | None]


def contract_of(source_id: str) -> DataContract:
    """The registered contract; an unknown source is an error."""
    if source_id not in CONTRACTS:
        raise KeyError(f"Source not found: {source_id}")
    return CONTRACTS[source_id]


def _either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _bound_text(bound: float | int) -> str:
    return repr(bound)


def _set_text(values: tuple[str, ...]) -> str:
    """The allowed set in sorted order, so the message is stable."""
    return "{" + ", ".join(repr(value) for value in sorted(values)) + "}"


class _Field:
    """One constrained column of a given DataFrame."""

    def __init__(self, df: DataFrame, rule: FieldConstraint, typed_per_value: bool):
        self.rule = rule
        self.value = F.col(f"`{rule.name}`")
        self.kind = text.kind_of(df.schema[rule.name].dataType)
        # Text read from a file under a numeric rule is judged value by value.
        self.per_value = typed_per_value and self.kind == "str" and rule.dtype in ("int", "float")

    # -- the value as it arrived ------------------------------------------------

    def _number(self) -> Column | None:
        if self.kind == "str":
            return numbers.nan_to_null(numbers.parse_float(self.value))
        if self.kind in ("int", "float", "bool"):
            return self.value.cast("double")
        return None

    def original(self) -> _Cell:
        absent = self.value.isNull()
        if self.kind == "float":
            absent = absent | F.isnan(self.value)
        if self.per_value:
            mistyped = self._number().isNull()
        elif self.rule.dtype == "str":
            mistyped = F.lit(self.kind != "str")
        elif self.rule.dtype == "int":
            mistyped = F.lit(self.kind not in ("int", "float", "bool"))
        elif self.rule.dtype == "float":
            mistyped = F.lit(self.kind != "float")
        else:
            mistyped = F.lit(False)
        return _Cell(
            absent, mistyped, self.kind,
            lambda: text.as_text(self.value, self.kind), lambda: text.as_literal(self.value, self.kind), self._number,
        )

    # -- the value after a cast to the declared type ------------------------------

    def _castable(self) -> bool:
        """Whether coercion touches this column at all."""
        target = self.rule.dtype
        if target == "str":
            return self.kind != "str"
        if target == "int":
            return self.kind in ("float", "str")
        if target == "float":
            return self.kind in ("int", "bool") or (self.kind == "str" and not self.per_value)
        return False

    def _cast(self) -> Column:
        """The cast value; NULL where the cast fails and the value stays as it was."""
        target = self.rule.dtype
        if target == "str":
            return text.as_text(self.value, self.kind)
        if target == "float":
            return numbers.parse_float(self.value) if self.kind == "str" else self.value.cast("double")
        if self.kind == "float":
            return numbers.whole_part(numbers.nan_to_null(self.value.cast("double")))
        if self.per_value:
            return numbers.whole_part(numbers.nan_to_null(numbers.parse_float(self.value)))
        return numbers.parse_int(self.value)

    def _cast_text(self, cast: Column) -> Column:
        target = self.rule.dtype
        if target == "float":
            return text.float_text(cast)
        if target == "int" and (self.kind == "float" or self.per_value):
            return F.coalesce(
                F.when(F.abs(cast) < 1e18, cast.cast("decimal(38,0)").cast("string")), text.float_text(cast))
        return cast.cast("string")

    def _changes(self) -> Column:
        """True where coercion really replaces the value."""
        cast_worked = self._cast().isNotNull()
        if self.per_value:  # an integral number read from text already counts as int
            return cast_worked & numbers.parse_int(self.value).isNull()
        return cast_worked & self.value.isNotNull()

    def overflows(self) -> Column | None:
        """int() of an infinity is not a failed cast but a failed row."""
        if self.rule.dtype == "int" and self._castable():
            if self.kind == "float":
                return F.coalesce(F.abs(self.value.cast("double")) == float("inf"), F.lit(False))
            if self.per_value:
                return F.coalesce(F.abs(numbers.parse_float(self.value)) == float("inf"), F.lit(False))
        return None

    def coerced(self) -> _Cell:
        before = self.original()
        if not self._castable():
            return before
        cast = self._cast()
        worked = cast.isNotNull()
        absent, number = before.absent, before.number
        if self.rule.dtype == "float":
            absent = absent | F.coalesce(F.isnan(cast), F.lit(False))
            number = lambda: cast
        elif self.rule.dtype == "int":
            number = lambda: F.coalesce(cast.cast("double"), self._number())
        quote = text.quoted if self.rule.dtype == "str" else (lambda shown: shown)
        return _Cell(
            absent, before.mistyped & ~worked, before.type_name,
            lambda: F.when(worked, self._cast_text(cast)).otherwise(before.shown()),
            lambda: F.when(worked, quote(self._cast_text(cast))).otherwise(before.literal()), number,
        )

    def coercion(self) -> tuple[Column, Column] | None:
        if not self._castable():
            return None
        cast = self._cast()
        shown = self._cast_text(cast)
        shown = text.quoted(shown) if self.rule.dtype == "str" else shown
        before = text.as_text(self.value, self.kind) if self.per_value else text.as_literal(self.value, self.kind)
        return self._changes(), F.concat(F.lit(f"'{self.rule.name}': "), before, F.lit(" → "), shown)

    def accepted(self, was_coerced: Column) -> Column | None:
        """The value an accepted row carries, where it differs from the plain column."""
        if self.per_value:
            number = numbers.parse_float(self.value)
            if self.rule.dtype == "int":
                return F.when(was_coerced, numbers.whole_part(number)).otherwise(number)
            return number
        if not self._castable():
            return None
        if self.kind == "float":
            return F.when(was_coerced, self._cast()).otherwise(self.value.cast("double"))
        return self._cast()

    # -- rules ---------------------------------------------------------------------

    def rules(self, cell: _Cell) -> list[Rule]:
        name, rule = self.rule.name, self.rule
        present = ~cell.absent
        found: list[Rule] = []
        if not rule.nullable:
            found.append(Rule(
                f"{name}:null", cell.absent, lambda: F.lit(f"Field '{name}' is NULL but not nullable.")))
        if rule.dtype in ("str", "int", "float"):
            found.append(Rule(
                f"{name}:type", present & cell.mistyped,
                lambda: F.concat(F.lit(f"Field '{name}' expected {rule.dtype}, got {cell.type_name} (value="),
                                 cell.literal(), F.lit(").")),
            ))
        if rule.allowed_values:
            outside = ~self.value.isin(*rule.allowed_values) if self.kind == "str" else F.lit(True)
            found.append(Rule(
                f"{name}:enum", present & outside,
                lambda: F.concat(F.lit(f"Field '{name}' value "), cell.literal(),
                                 F.lit(f" not in allowed set {_set_text(rule.allowed_values)}.")),
            ))
        bounded = rule.min_value is not None or rule.max_value is not None
        number = cell.number() if bounded else None
        if number is not None:
            if rule.min_value is not None:
                found.append(self._bound(cell, "min", number < rule.min_value, "below min", rule.min_value))
            if rule.max_value is not None:
                found.append(self._bound(cell, "max", number > rule.max_value, "above max", rule.max_value))
        return found

    def _bound(self, cell: _Cell, code: str, beyond: Column, words: str, bound: float | int) -> Rule:
        return Rule(
            f"{self.rule.name}:{code}",
            ~cell.absent & F.coalesce(beyond, F.lit(False)),
            lambda: F.concat(
                F.lit(f"Field '{self.rule.name}' value "), cell.shown(), F.lit(f" {words} {_bound_text(bound)}.")),
        )


class CompiledContract:
    """A contract bound to the columns of one DataFrame."""

    def __init__(self, df: DataFrame, contract: DataContract, typed_per_value: tuple[str, ...] = ()):
        self.contract = contract
        self.names = set(df.columns)
        self.fields = [
            _Field(df, rule, rule.name in typed_per_value) for rule in contract.fields if rule.name in self.names]

    @cached_property
    def first_check(self) -> list[Rule]:
        """Required fields first, then every field's rules in declaration order."""
        required = [
            Rule(
                f"{name}:required",
                F.col(f"`{name}`").isNull() if name in self.names else F.lit(True),
                lambda name=name: F.lit(f"Required field '{name}' is missing or null."),
            )
            for name in self.contract.required_fields
        ]
        return required + [r for f in self.fields for r in f.rules(f.original())]

    @cached_property
    def second_check(self) -> list[Rule]:
        """The field rules over coerced values; required fields are not asked again."""
        return [r for f in self.fields for r in f.rules(f.coerced())]

    def violated(self) -> Column:
        return _either([rule.broken for rule in self.first_check])

    def still_violated(self) -> Column:
        return _either([rule.broken for rule in self.second_check])

    def first_messages(self) -> Column:
        return text.optional_items(*[(r.broken, r.message()) for r in self.first_check])

    def first_codes(self, kind: str | None = None) -> Column:
        """Short ``field:rule`` names of the broken rules, in message order; one kind of rule or all."""
        asked = [r for r in self.first_check if kind is None or r.code.endswith(":" + kind)]
        return text.optional_items(*[(r.broken, F.lit(r.code)) for r in asked])

    def remaining_messages(self) -> Column:
        return text.optional_items(*[(r.broken, r.message()) for r in self.second_check])

    def coercion_messages(self) -> Column:
        return text.optional_items(*[item for f in self.fields if (item := f.coercion()) is not None])

    def status(self) -> Column:
        policy = self.contract.policy
        if policy is ViolationPolicy.REJECT:
            return F.when(self.violated(), F.lit(REJECT)).otherwise(F.lit(PASS))
        if policy is ViolationPolicy.QUARANTINE:
            return F.when(self.violated(), F.lit(QUARANTINE)).otherwise(F.lit(PASS))
        overflow = _either([c for f in self.fields if (c := f.overflows()) is not None])
        return (
            F.when(~self.violated(), F.lit(PASS))
            .when(overflow, F.lit(ERROR))
            .when(self.still_violated(), F.lit(QUARANTINE))
            .otherwise(F.lit(COERCED))
        )

    def violations(self, status: Column) -> Column:
        coercing = self.contract.policy is ViolationPolicy.AUTO_COERCE
        messages = self.remaining_messages() if coercing else self.first_messages()
        return F.when(status.isin(QUARANTINE, REJECT), messages).otherwise(text.optional_items())

    def coercions(self, status: Column) -> Column:
        if self.contract.policy is not ViolationPolicy.AUTO_COERCE:
            return text.optional_items()
        return F.when(status == COERCED, self.coercion_messages()).otherwise(text.optional_items())

    def fixed_columns(self, status: Column) -> dict[str, Column]:
        """Accepted values by field, only for fields whose type or value may change."""
        coercing = self.contract.policy is ViolationPolicy.AUTO_COERCE
        was_coerced = (status == COERCED) if coercing else F.lit(False)
        fixed = {}
        for bound in self.fields:
            if not (coercing or bound.per_value):
                continue
            value = bound.accepted(was_coerced)
            if value is not None:
                fixed[bound.rule.name] = value
        return fixed


def apply_contract(
    df: DataFrame,
    contract: DataContract | None,
    typed_per_value: tuple[str, ...] = (),
    duplicate: str | None = None,
) -> DataFrame:
    """Add status, messages and accepted values to every row.

    ``duplicate`` names a boolean column; where it is true the row is a
    DUPLICATE and is not checked. Without a contract every row passes that has the
    fields of its header.
    """
    skip = F.col(duplicate) if duplicate else F.lit(False)
    torn = F.col(MALFORMED).isNotNull() if MALFORMED in df.columns else F.lit(False)
    if contract is None:
        plain = F.when(torn, F.lit(QUARANTINE)).when(skip, F.lit(DUPLICATE)).otherwise(F.lit(PASS))
        return df.withColumns({
            STATUS: plain, VIOLATIONS: F.when(torn, F.array(F.lit(MALFORMED_MESSAGE))).otherwise(text.optional_items()),
            COERCIONS: text.optional_items()})
    compiled = CompiledContract(df, contract, typed_per_value)
    status = F.col(STATUS)
    judged = df.withColumn(STATUS, F.when(skip & ~torn, F.lit(DUPLICATE)).when(torn, F.lit(QUARANTINE)).otherwise(compiled.status()))
    return judged.withColumns({
        VIOLATIONS: F.when(torn, F.array(F.lit(MALFORMED_MESSAGE))).otherwise(compiled.violations(status)),
        COERCIONS: compiled.coercions(status),
        **{FIXED_PREFIX + name: value for name, value in compiled.fixed_columns(status).items()},
    })


def accepted_payload(judged: DataFrame, payload: list[str]) -> list[Column]:
    """The payload columns as an accepted row carries them."""
    names = set(judged.columns)
    return [
        F.col(FIXED_PREFIX + name).alias(name) if FIXED_PREFIX + name in names else F.col(f"`{name}`")
        for name in payload
    ]


def payload_columns(df: DataFrame) -> list[str]:
    """Columns that are data, not bookkeeping."""
    return [name for name in df.columns if not name.startswith("_")]


def explain_rules(df: DataFrame, contract: DataContract, kind: str | None = None, alias: str = "codes") -> DataFrame:
    """The broken rules of every row as ``field:rule`` codes."""
    return df.withColumn(alias, CompiledContract(df, contract).first_codes(kind))
