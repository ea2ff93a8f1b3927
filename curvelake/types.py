"""The schema of a field: its columns by name, each in a role.

Keys tell curves apart, one axis at most orders a curve's points, and values
are what they hold.  Keys and axis together are the field's inputs, values its
outputs; inputs come first.  ``schema`` is the way to make one: it gives the
columns their roles and checks that names differ.  A schema is a plain
mapping, so ``name in s`` and ``s[name]`` work; the checked lookups below raise
errors that say what there is instead.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from typing import NamedTuple

from curvelake.errors import FieldError

KEY, AXIS, VALUE = "key", "axis", "value"


class Column(NamedTuple):
    """A column and its role.

    ``exact`` inputs are shared and matched by equality, others are
    interpolated.  An output is a float that may be missing; ``error`` names
    the output that holds its error bar.
    """

    name: str
    role: str
    dtype: str = "float"
    exact: bool = True
    unit: str | None = None
    error: str | None = None

    def but(self, **changes) -> Column:
        return self._replace(**changes)


def given(name: str, dtype: str = "float", exact: bool = True, unit: str | None = None) -> Column:
    """An input."""
    return Column(name, KEY, dtype, exact, unit)


def made(name: str, unit: str | None = None, error: str | None = None) -> Column:
    """An output."""
    return Column(name, VALUE, unit=unit, error=error)


def schema(inputs: Iterable[Column] = (), outputs: Iterable[Column] = (), axis: str | None = None) -> Schema:
    """Columns in their roles.  An axis that is no input any more is none."""
    columns = [c.but(role=AXIS if c.name == axis else KEY) for c in inputs] + [c.but(role=VALUE) for c in outputs]
    many = [n for n, k in Counter(c.name for c in columns).items() if k > 1]
    if many:
        raise FieldError(f"columns of one name: {', '.join(sorted(many))}; give them names of their own with rename")
    return Schema({c.name: c for c in columns})


class Schema(Mapping):
    """``[inputs -> outputs]``; see ``schema``."""

    def __init__(self, columns: dict[str, Column]):
        self._columns = columns

    def __getitem__(self, name: str) -> Column:
        return self._columns[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._columns)

    def __len__(self) -> int:
        return len(self._columns)

    def __hash__(self) -> int:
        return hash(tuple(self._columns.values()))

    def _of(self, *roles: str) -> tuple[Column, ...]:
        return tuple(c for c in self._columns.values() if c.role in roles)

    inputs = property(lambda self: self._of(KEY, AXIS))
    outputs = property(lambda self: self._of(VALUE))
    ins = property(lambda self: [c.name for c in self.inputs])
    outs = property(lambda self: [c.name for c in self.outputs])

    @property
    def axis(self) -> str | None:
        return next((c.name for c in self._of(AXIS)), None)

    def but(self, **parts) -> Schema:
        """The same with other inputs, outputs or axis."""
        return schema(**({"inputs": self.inputs, "outputs": self.outputs, "axis": self.axis} | parts))

    def drop(self, *names: str) -> Schema:
        """The same without some of its inputs."""
        return self.but(inputs=[c for c in self.inputs if c.name not in names])

    # --- checked lookups

    def _find(self, name: str, there: tuple[Column, ...], what: str) -> Column:
        found = self.get(name)
        if found not in there:
            raise FieldError(f"no {what} {name}; {what}s are {', '.join(c.name for c in there) or 'none'}")
        return found

    def input(self, name: str) -> Column:
        return self._find(name, self.inputs, "input")

    def output(self, name: str) -> Column:
        return self._find(name, self.outputs, "output")

    def number(self, name: str) -> Column:
        """An input that can be reckoned with."""
        if self.input(name).dtype == "str":
            raise FieldError(f"{name} is text; a number is needed here")
        return self[name]

    def only(self) -> Column:
        """The output, where there must be one."""
        if len(self.outs) == 1:
            return self.outputs[0]
        raise FieldError(f"one output is needed, there are {len(self.outs)}: {', '.join(self.outs) or 'none'}")

    def along(self, name: str | None) -> str:
        """The input to work along: the one named, or the axis."""
        if name is not None:
            return self.input(name).name
        if self.axis is not None:
            return self.axis
        raise FieldError("there is no axis: name the input to work along")

    def key(self, along: str | None = None) -> list[str]:
        """The inputs that tell curves apart."""
        x = along or self.axis
        return [n for n in self.ins if n != x]

    def __str__(self) -> str:
        stars = ", ".join(c.name + "*" * (c.role == AXIS) for c in self.inputs)
        bars = ", ".join(c.name if c.error is None else f"{c.name}±{c.error}" for c in self.outputs)
        return f"[{stars} → {bars}]"

    __repr__ = __str__
