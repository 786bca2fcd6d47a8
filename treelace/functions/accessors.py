"""Lazy accessors: a transaction and a path; nothing is read before it is asked for."""

from __future__ import annotations

from treelace.functions.errors import IndexOutOfRange
from treelace.functions.mapping import to_value
from treelace.functions.paths import Path
from treelace.functions.value import Value


class View:
    """Read accessor for a leaf, a list, a map or a struct."""

    def __init__(self, txn, path: Path):
        self._txn, self._path = txn, path

    def _rel(self) -> str:
        n = len(self._txn._root.segments)
        return str(Path(self._path.segments[n:]))

    def path(self) -> str:
        return str(self._path)

    def key(self) -> str | None:
        return self._txn.key(self._rel())

    def kind(self) -> str | None:
        return self._txn.kind(self._rel())

    def value(self) -> Value | None:
        return self._txn.load_value(self._rel())

    def get(self, label: str):
        """The leaf, of exactly this kind."""
        return self._txn.get(self._rel(), label)

    def is_none(self) -> bool:
        v = self.value()
        return v is None or v.as_leaf() is not None and v.data.label == "null"

    def field(self, name: str) -> View:
        return type(self)(self._txn, self._path.push_name(name))

    # lists

    def __len__(self) -> int:
        return self._txn.list_len(self._rel())

    def is_empty(self) -> bool:
        return len(self) == 0

    def at(self, index: int) -> View:
        n = len(self)
        if not 0 <= index < n:
            raise IndexOutOfRange(index, n)
        return type(self)(self._txn, self._path.push_index(index))

    def items(self) -> list[Value]:
        v = self.value()
        return list(v.data) if v is not None and v.kind == "list" else [v.data[k] for k in v.keys()] if v is not None and v.kind == "object" else []

    def __iter__(self):
        return iter(self.items())

    def __reversed__(self):
        return reversed(self.items())

    def first(self) -> Value | None:
        return next(iter(self.items()), None)

    def last(self) -> Value | None:
        return next(reversed(self.items()), None)

    def contains(self, item) -> bool:
        return to_value(item) in self.items()

    # maps

    def keys(self) -> list[str]:
        return self._txn.object_keys(self._rel())

    def contains_key(self, key: str) -> bool:
        return self._txn.exists(str(self.field(key)._rel()))

    def lookup(self, key: str) -> View | None:
        return self.field(key) if self.contains_key(key) else None

    def entries(self) -> list[tuple[str, Value]]:
        v = self.value()
        return [(k, v.data[k]) for k in v.keys()] if v is not None and v.kind == "object" else []


class MutView(View):
    """Write accessor; changes are staged in the transaction."""

    def set(self, item) -> None:
        self._txn.store_value(self._rel(), to_value(item))

    def push(self, item) -> None:
        self.field_at(len(self)).set(item)

    def field_at(self, index: int) -> MutView:
        return MutView(self._txn, self._path.push_index(index))

    def insert_at(self, index: int, item) -> None:
        n = len(self)
        self.push(item)
        if index < n:
            self._txn.list_move(self._rel(), n, index)

    def remove_at(self, index: int) -> bool:
        return self._txn.remove(self.field_at(index)._rel())

    def remove_range(self, start: int, end: int) -> None:
        self._rewrite(lambda x: x[:start] + x[max(start, end) :])

    def _rewrite(self, change) -> None:
        self._txn.store_value(self._rel(), Value(change(self.items())))

    def swap(self, i: int, j: int) -> None:
        self._txn.list_swap(self._rel(), i, j)

    def move(self, source: int, target: int) -> None:
        self._txn.list_move(self._rel(), source, target)

    def swap_remove(self, index: int) -> Value | None:
        items = self.items()
        if index >= len(items):
            return None
        out = items[index]
        if index + 1 < len(items):
            self._txn.list_swap(self._rel(), index, len(items) - 1)
        self.remove_at(len(items) - 1)
        return out

    def pop_first(self):
        v = self.value()
        if v is not None and v.kind == "object":
            return self._pop(v.keys()[:1])
        out = self.first()
        if out is not None:
            self.remove_at(0)
        return out

    def pop_last(self):
        v = self.value()
        if v is not None and v.kind == "object":
            return self._pop(v.keys()[-1:])
        out = self.last()
        if out is not None:
            self.remove_at(len(v.data) - 1)
        return out

    def _pop(self, keys: list[str]):
        if not keys:
            return None
        out = (keys[0], self.value().data[keys[0]])
        self.remove(keys[0])
        return out

    def clear(self) -> None:
        self._txn.clear_children(self._rel())

    def retain(self, keep) -> None:
        """Keep what the function says: of a value for lists, of key and value for maps."""
        v = self.value()
        if v.kind == "object":
            self._txn.store_value(self._rel(), Value({k: x for k, x in v.data.items() if keep(k, x)}))
        else:
            self._rewrite(lambda items: [x for x in items if keep(x)])

    def drain(self, start: int = 0, end: int | None = None):
        """Remove and return a range of a list, or all entries of a map."""
        v = self.value()
        if v.kind == "object":
            self.clear()
            return [(k, v.data[k]) for k in v.keys()]
        end = len(v.data) if end is None else end
        if end > len(v.data):
            raise IndexOutOfRange(end, len(v.data))
        self.remove_range(start, end)
        return v.data[start:end]

    def extend(self, items) -> None:
        if isinstance(items, dict):
            v = self.value()
            old = v.data if v is not None else {}
            self._txn.store_value(self._rel(), Value(old | {k: to_value(x) for k, x in items.items()}))
        else:
            self._rewrite(lambda old: old + [to_value(x) for x in items])

    def insert(self, key: str, item) -> None:
        MutView(self._txn, self._path.push_name(key)).set(item)

    def remove(self, key: str) -> bool:
        return self._txn.remove(self.field(key)._rel())
