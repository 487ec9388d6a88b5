"""JSON whose number text survives: parsing, compact and canonical text, leaves, selection, dotted paths."""

from __future__ import annotations

import json

ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
SEP = "."


class Num:
    """A number by its source text."""

    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text

    def __eq__(self, other):
        return isinstance(other, Num) and other.text == self.text

    def __hash__(self):
        return hash(self.text)

    def __repr__(self):
        return self.text


def _constant(text):
    raise ValueError(text)  # NaN and infinities are no JSON


def parse(raw: str):
    """Raises ValueError if raw is no JSON. Of repeated keys the last wins."""
    try:
        return json.loads(raw, parse_float=Num, parse_int=Num, parse_constant=_constant)
    except RecursionError as e:
        raise ValueError("too deep") from e


def try_parse(raw: str):
    """(value, True), or (None, False)."""
    try:
        return parse(raw), True
    except ValueError:
        return None, False


def has_duplicate_keys(raw: str) -> bool:
    found = False

    def pairs(items):
        nonlocal found
        found |= len({k for k, _ in items}) < len(items)
        return dict(items)

    try:
        json.loads(raw, object_pairs_hook=pairs, parse_float=Num, parse_int=Num, parse_constant=_constant)
    except (ValueError, RecursionError):
        return False
    return found


def quote(s: str) -> str:
    return '"' + "".join(ESCAPES.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in s) + '"'


def dump(v, ordered: bool = False) -> str:
    """Compact text; with sorted keys if ordered."""
    if isinstance(v, str):
        return quote(v)
    if isinstance(v, Num):
        return v.text
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, list):
        return "[" + ",".join(dump(x, ordered) for x in v) + "]"
    keys = sorted(v, key=lambda k: k.encode("utf-8", "surrogatepass")) if ordered else v
    return "{" + ",".join(f"{quote(k)}:{dump(v[k], ordered)}" for k in keys) + "}"


def canonical(v) -> str:
    return dump(v, True)


def leaves(v) -> list[tuple[str, str]]:
    """(class, text) of keys and scalars, depth first."""
    if isinstance(v, dict):
        return [x for k, c in v.items() for x in [("key", k), *leaves(c)]]
    if isinstance(v, list):
        return [x for c in v for x in leaves(c)]
    kind = "text" if isinstance(v, str) else "number" if isinstance(v, Num) else "null" if v is None else "bool"
    return [(kind, v if kind == "text" else dump(v))]


def is_scalar(v) -> bool:
    return not isinstance(v, dict | list)


def select(block: str, selector: str) -> str | None:
    """`L2-5`: lines, from 1; else a path of `field`, `[n]`, `field=value` (first element of an array) parts."""
    if selector.startswith("L"):
        a, _, b = selector[1:].partition("-")
        if not (a.strip().isdecimal() and b.strip().isdecimal()) or not 0 < int(a) <= int(b):
            return None
        rows = block.split("\n")
        rows = [r.removesuffix("\r") for r in (rows[:-1] if rows[-1] == "" else rows)]
        return "\n".join(rows[int(a) - 1 : int(b)]) if int(a) <= len(rows) else None
    at, ok = try_parse(block)
    for part in filter(None, selector.split("/")):
        if not ok:
            return None
        ok = False
        if part[0] == "[" and part[-1] == "]":
            if isinstance(at, list) and part[1:-1].isdecimal() and int(part[1:-1]) < len(at):
                at, ok = at[int(part[1:-1])], True
        elif "=" in part:
            k, _, want = part.partition("=")
            rows = [x for x in at if isinstance(x, dict) and k in x and is_scalar(x[k]) and x[k] is not None and (x[k] if isinstance(x[k], str) else dump(x[k])) == want] if isinstance(at, list) else []
            if rows:
                at, ok = rows[0], True
        elif isinstance(at, dict) and part in at:
            at, ok = at[part], True
    return None if not ok else at if isinstance(at, str) else canonical(at)


def _open(v) -> bool:
    """Whether an object can become dotted columns and come back."""
    return isinstance(v, dict) and bool(v) and all(SEP not in k and (not isinstance(c, dict) or not c or _open(c)) for k, c in v.items())


def flatten(obj: dict, closed: frozenset = frozenset()) -> dict | None:
    """Dotted paths to leaves; fields in `closed` stay whole. None if a key at the root has a dot."""
    if any(SEP in k for k in obj):
        return None
    out: dict = {}

    def walk(prefix, o):
        for k, v in o.items():
            path = f"{prefix}{SEP}{k}" if prefix else k
            if _open(v) and not (not prefix and k in closed):
                walk(path, v)
            else:
                out[path] = v

    walk("", obj)
    return out


def unflatten(flat: dict) -> dict | None:
    """Inverse of flatten; None where a path runs through a leaf."""
    out: dict = {}
    for path, v in flat.items():
        *way, last = path.split(SEP)
        at = out
        for k in way:
            at = at.setdefault(k, {})
            if not isinstance(at, dict):
                return None
        at[last] = v
    return out


def sparse_fields(flats: list[dict]) -> frozenset:
    """Fields whose dotted columns, four or more, are filled in less than two fifths of the rows."""
    filled: dict[str, int] = {}
    for f in flats:
        for k in f:
            filled[k] = filled.get(k, 0) + 1
    groups: dict[str, list[int]] = {}
    for k, n in filled.items():
        head, dot, _ = k.partition(SEP)
        if dot:
            groups.setdefault(head, []).append(n)
    return frozenset(h for h, ns in groups.items() if len(ns) >= 4 and 5 * sum(ns) < 2 * len(ns) * len(flats))


def unique_field(records: list[dict]) -> str | None:
    """The first field of the first record that each record has, as string or number, with a value of its own."""
    for k in records[0]:
        values = [r.get(k) for r in records]
        if all(isinstance(v, str | Num) for v in values) and len({dump(v) for v in values}) == len(values):
            return k
    return None
