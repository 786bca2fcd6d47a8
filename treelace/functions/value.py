"""Dynamic values: trees of leaves, lists and sorted objects held by the driver."""

from __future__ import annotations

import copy
from collections.abc import Callable

from treelace.functions.errors import TreeError
from treelace.functions.paths import Path
from treelace.functions.scalars import NULL, Scalar, scalar


class Value:
    """A leaf (Scalar), a list (list of Value) or a node (dict of Value)."""

    __slots__ = ("data",)

    def __init__(self, data: Scalar | list | dict = NULL):
        self.data = data

    @classmethod
    def leaf(cls, value=None, label: str | None = None) -> Value:
        return cls(scalar(value, label))

    @classmethod
    def list(cls, items=()) -> Value:
        return cls([of(x) for x in items])

    @classmethod
    def node(cls, items=()) -> Value:
        return cls({k: of(v) for k, v in dict(items).items()})

    @property
    def kind(self) -> str:
        return "leaf" if isinstance(self.data, Scalar) else "list" if isinstance(self.data, list) else "object"

    def as_leaf(self) -> Scalar | None:
        return self.data if self.kind == "leaf" else None

    def as_list(self) -> list | None:
        return self.data if self.kind == "list" else None

    def as_node(self) -> dict | None:
        return self.data if self.kind == "object" else None

    def at(self, index: int) -> Value | None:
        items = self.as_list()
        return items[index] if items is not None and 0 <= index < len(items) else None

    def get(self, key: str) -> Value | None:
        return (self.as_node() or {}).get(key)

    def contains_key(self, key: str) -> bool:
        return key in (self.as_node() or {})

    def keys(self) -> list[str]:
        return sorted(self.as_node() or {}, key=str.encode)

    def clear(self) -> None:
        """A leaf becomes null; a container becomes empty."""
        self.data = NULL if self.kind == "leaf" else type(self.data)()

    def push(self, item) -> None:
        if self.kind == "list":
            self.data.append(of(item))

    def insert(self, key: str, item) -> None:
        if self.kind == "object":
            self.data[key] = of(item)

    def remove_key(self, key: str) -> Value | None:
        return self.data.pop(key, None) if self.kind == "object" else None

    def remove_at(self, index: int) -> Value | None:
        """Raises IndexError beyond the list; does nothing on another kind."""
        if self.kind != "list":
            return None
        if not 0 <= index < len(self.data):
            raise IndexError(index)
        return self.data.pop(index)

    def merge(self, other: Value) -> None:
        """Lists take the other's items, or the other as one; nodes take its entries; all else is replaced."""
        other = copy.deepcopy(other)
        if self.kind == "list":
            self.data.extend(other.data if other.kind == "list" else [other])
        elif self.kind == other.kind == "object":
            self.data.update(other.data)
        else:
            self.data = other.data

    def get_value(self, path: str | Path) -> Value | None:
        """A copy of what stands at the path; None if nothing does or the path is none."""
        try:
            at: Value | None = self
            for s in Path.parse(path).segments:
                at = at.at(s) if isinstance(s, int) else at.get(s)
                if at is None:
                    return None
            return copy.deepcopy(at)
        except TreeError:
            return None

    def set_value(self, path: str | Path, item) -> bool:
        """Set what stands at the path and make what is missing on the way; all or nothing.

        Lists grow at their end only, a new list starts at [0], leaves are never walked through.
        """
        try:
            segments = Path.parse(path).segments
        except TreeError:
            return False
        new = of(item)
        if not segments:
            self.data = new.data
            return True
        apply: Callable[[], None] | None = None
        at: Value = self
        for k, s in enumerate(segments):
            nxt = at.at(s) if isinstance(s, int) else at.get(s)
            right = at.kind == ("list" if isinstance(s, int) else "object")
            if not right or isinstance(s, int) and s > len(at.data):
                return False
            if nxt is None or k + 1 == len(segments):
                made = new
                for r in reversed(segments[k + 1 :]):
                    if isinstance(r, int) and r:
                        return False
                    made = Value([made] if isinstance(r, int) else {r: made})
                apply = (lambda a=at, s=s, m=made: a.data.append(m) if isinstance(s, int) and s == len(a.data) else a.data.__setitem__(s, m))
                break
            at = nxt
        apply()
        return True

    def __eq__(self, other) -> bool:
        return isinstance(other, Value) and self.data == other.data

    def __repr__(self) -> str:
        return f"Value({self.data!r})"


def of(x) -> Value:
    """Value of plain Python data: dicts, lists and scalars."""
    if isinstance(x, Value):
        return x
    if isinstance(x, dict):
        return Value({str(k): of(v) for k, v in x.items()})
    if isinstance(x, (list, tuple)):
        return Value([of(v) for v in x])
    return Value(scalar(x))
