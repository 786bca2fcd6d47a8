"""Paths: slash-separated names with bracketed list positions, such as orders/42/lines[0]/qty."""

from __future__ import annotations

import re
from dataclasses import dataclass

from treelace.functions.errors import InvalidPath

_TOKEN = re.compile(r"(?P<name>[^/\[\]]*)(?P<steps>(?:\[[0-9]+\])*)\Z")
_STEP = re.compile(r"\[([0-9]+)\]")
MAX_INDEX = (1 << 64) - 1


def _token(token: str, whole: str) -> list[str | int]:
    m = _TOKEN.match(token)
    if m is None or not token:
        raise InvalidPath(whole)
    steps = [int(s) for s in _STEP.findall(m["steps"])]
    if any(s > MAX_INDEX for s in steps) or m["name"] in (".", ".."):
        raise InvalidPath(whole)
    return ([m["name"]] if m["name"] else []) + steps


@dataclass(frozen=True)
class Path:
    """An immutable sequence of names (str) and list positions (int)."""

    segments: tuple[str | int, ...] = ()

    @classmethod
    def parse(cls, text: str | Path) -> Path:
        if isinstance(text, Path):
            return text
        if text == "":
            return cls()
        out: list[str | int] = []
        for token in text.split("/"):
            if token == ".":
                continue
            if token == "..":
                if not out:
                    raise InvalidPath(text)
                out.pop()
                continue
            out += _token(token, text)
        return cls(tuple(out))

    def __str__(self) -> str:
        out = ""
        for s in self.segments:
            out += f"[{s}]" if isinstance(s, int) else ("/" if out else "") + s
        return out

    @property
    def is_root(self) -> bool:
        return not self.segments

    def push_name(self, name: str) -> Path:
        """A child by name; `.` stays, `..` goes up (and stays at the root). Reserved characters are refused."""
        if name == ".":
            return self
        if name == "..":
            return self.parent() or self
        if not name or any(c in name for c in "/[]"):
            raise InvalidPath(name)
        return Path((*self.segments, name))

    def push_index(self, index: int) -> Path:
        return Path((*self.segments, index))

    def join(self, other: str | Path) -> Path:
        return Path(self.segments + Path.parse(other).segments)

    __truediv__ = join

    def parent(self) -> Path | None:
        return Path(self.segments[:-1]) if self.segments else None

    def last(self) -> str | int | None:
        return self.segments[-1] if self.segments else None

    def starts_with(self, root: Path) -> bool:
        return self.segments[: len(root.segments)] == root.segments

    def encoded(self) -> list[str]:
        """Segments as they stand in the column `segs`: names as they are, positions in brackets."""
        return [f"[{s}]" if isinstance(s, int) else s for s in self.segments]


WILD = "*"


@dataclass(frozen=True)
class Pattern:
    """A path in which a whole `*` token stands for any one child of an object or a list."""

    segments: tuple[str | int, ...]

    @classmethod
    def parse(cls, text: str) -> Pattern:
        if text == "":
            return cls(())
        out: list[str | int] = []
        for token in text.split("/"):
            out += _token(token, text)
        return cls(tuple(out))

    def __str__(self) -> str:
        return str(Path(self.segments))

    def reaches_below(self, path: Path) -> bool:
        return len(self.segments) > len(path.segments) and all(p in (WILD, s) for p, s in zip(self.segments, path.segments))

    def matches(self, path: Path) -> bool:
        return len(path.segments) == len(self.segments) and all(p == s or p == WILD for p, s in zip(self.segments, path.segments))
