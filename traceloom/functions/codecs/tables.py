"""Structured codecs: arrays of records as tables, with nested, side and embedded tables, and a recursive transpose."""

from __future__ import annotations

from types import SimpleNamespace

from traceloom.functions import jsontext as js

MARK = "#tl:"
NONE = (None, False)
SIDE_MAP, FIELD_MAP = 4, 8  # entries from which a map is worth a side table, an embedded table


def _codec(name, encode, decode):
    head = MARK + name + "\n"

    def enc(value) -> str | None:
        body = encode(value)
        if body is None:
            return None
        back, ok = dec(head + body)
        return head + body if ok and js.canonical(back) == js.canonical(value) else None

    def dec(wire: str):
        if not wire.startswith(head):
            return NONE
        try:
            return decode(wire[len(head) :]), True
        except (ValueError, KeyError, IndexError, TypeError, AttributeError):
            return NONE

    return SimpleNamespace(name=name, encode=enc, decode=dec)


def _plain(values) -> bool:
    return all(isinstance(v, str) and "\t" not in v and "\n" not in v for v in values)


def _cell(v, text: bool) -> str:
    return v if text else js.dump(v)


def _uncell(c: str, text: bool):
    return c if text else js.parse(c)


def _table(columns: list[str], rows: list[list], fixed: dict | None = None) -> str:
    """A JSON head - columns, which hold plain text, values that all rows share - and a line of cells a row.
    A cell of Ellipsis is empty: the row lacks the field; plain columns have none."""
    text = [_plain([r[i] for r in rows]) for i in range(len(columns))]
    head = js.dump({"cols": columns, "text": [c for c, t in zip(columns, text) if t], "same": fixed or {}, "rows": js.Num(str(len(rows)))})
    return "\n".join([head, *("\t".join("" if v is ... else _cell(v, t) for v, t in zip(r, text)) for r in rows)])


def _untable(lines: list[str]) -> list[dict]:
    head = js.parse(lines[0])
    text, cols, n = set(head["text"]), head["cols"], int(head["rows"].text)
    if len(lines) != n + 1:
        raise ValueError("rows")
    out = []
    for line in lines[1:]:
        cells = line.split("\t") if cols else []
        if len(cells) != len(cols):
            raise ValueError("cells")
        row = dict(head["same"])
        for c, x in zip(cols, cells):
            if c in text or x != "":
                row[c] = _uncell(x, c in text)
        out.append(row)
    return out


def _records(v, least: int = 2) -> list[dict] | None:
    return v if isinstance(v, list) and len(v) >= least and all(isinstance(x, dict) for x in v) else None


def _columnar(value):
    rows = _records(value)
    if not rows or not rows[0] or any(r.keys() != rows[0].keys() or not all(map(js.is_scalar, r.values())) for r in rows):
        return None
    cols = sorted(rows[0])
    return _table(cols, [[r[c] for c in cols] for r in rows])


columnar = _codec("columnar", _columnar, lambda body: _untable(body.split("\n")))


def _nested(value):
    rows = _records(value)
    flats = [js.flatten(r) for r in rows] if rows else [None]
    if None in flats:
        return None
    closed = js.sparse_fields(flats)
    if closed:
        flats = [js.flatten(r, closed) for r in rows]
    names = list(dict.fromkeys(k for f in flats for k in f))
    if not names:
        return None
    fixed = {k: flats[0][k] for k in names if k in flats[0] and all(k in f and js.dump(f[k]) == js.dump(flats[0][k]) for f in flats)}
    cols = [k for k in names if k not in fixed]
    return _table(cols, [[f.get(k, ...) for k in cols] for f in flats], fixed)


def _unnested(body: str):
    rows = [js.unflatten(r) for r in _untable(body.split("\n"))]
    if None in rows:
        raise ValueError("paths")
    return rows


nested = _codec("nested", _nested, _unnested)


def _free_name(rows: list[dict], name: str) -> str:
    while any(name in r for r in rows):
        name = "_" + name
    return name


def _as_rows(v) -> tuple[str, list[dict]] | None:
    if isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
        return "list", v
    if isinstance(v, dict) and len(v) >= SIDE_MAP:
        return "map", [{"key": k, "value": x} for k, x in v.items()]
    return None


def _from_rows(shape: str, rows: list[dict]):
    return rows if shape == "list" else {r["key"]: r["value"] for r in rows}


def _blocks(parts: list[tuple[dict, str]]) -> str:
    """Parts with a JSON head that counts the lines of what follows."""
    return "\n".join(f"{js.dump(h | {'lines': js.Num(str(w.count(chr(10)) + 1))})}\n{w}" for h, w in parts)


def _unblocks(lines: list[str]):
    at = 0
    while at < len(lines):
        head = js.parse(lines[at])
        n = int(head["lines"].text)
        if at + n >= len(lines):
            raise ValueError("lines")
        yield head, "\n".join(lines[at + 1 : at + 1 + n])
        at += 1 + n


def _norm(value):
    rows = _records(value)
    key = js.unique_field(rows) if rows else None
    if key is None:
        return None
    shapes: dict[str, set] = {}
    for r in rows:
        for k, v in r.items():
            got = _as_rows(v) if k != key else None
            if got:
                shapes.setdefault(k, set()).add(got[0])
    if not shapes or any(len(s) > 1 for s in shapes.values()):
        return None
    main, sides = [], {k: [] for k in shapes}
    for r in rows:
        kept = {}
        for k, v in r.items():
            got = _as_rows(v) if k in sides else None
            if got:
                sides[k] += [(r[key], x) for x in got[1]]
            else:
                kept[k] = v
        main.append(kept)
    parts = [({"key": key}, nested.encode(main))]
    for k, found in sides.items():
        link = _free_name([x for _, x in found], "ref")
        parts.append(({"field": k, "shape": next(iter(shapes[k])), "ref": link}, nested.encode([x | {link: f} for f, x in found])))
    return None if any(w is None for _, w in parts) else _blocks(parts)


def _unnorm(body: str):
    (head, wire), *sides = _unblocks(body.split("\n"))
    rows, _ = nested.decode(wire)
    for h, w in sides:
        found: dict[str, list] = {}
        for x in nested.decode(w)[0]:
            found.setdefault(js.dump(x.pop(h["ref"])), []).append(x)
        for r in rows:
            if (of := js.dump(r[head["key"]])) in found:
                r[h["field"]] = _from_rows(h["shape"], found[of])
    return rows


norm = _codec("norm", _norm, _unnorm)


def _field_rows(v) -> tuple[str, str, list[dict]] | None:
    """Shape, name of the key column, rows: of an array of records, a map of records, a map of values."""
    if _records(v):
        return "list", "", v
    if isinstance(v, dict) and len(v) >= FIELD_MAP:
        if all(isinstance(x, dict) for x in v.values()):
            name = _free_name(list(v.values()), "key")
            return "records", name, [x | {name: k} for k, x in v.items()]
        return "map", "", [{"key": k, "value": x} for k, x in v.items()]
    return None


def _doc(value):
    if not isinstance(value, dict) or not value:
        return None
    parts, tables = [], 0
    for k, v in value.items():
        plain, got = js.dump(v), _field_rows(v)
        wires = [w for w in (nested.encode(got[2]), norm.encode(got[2])) if w] if got else []
        best = min(wires, key=lambda w: len(w.encode()), default=None)
        if best is not None and len(best.encode()) < len(plain.encode()):
            parts.append(({"field": k, "shape": got[0], "key": got[1]}, best))
            tables += 1
        else:
            parts.append(({"field": k}, plain))
    return _blocks(parts) if tables else None


def _undoc(body: str):
    out = {}
    for h, w in _unblocks(body.split("\n")):
        if "shape" not in h:
            out[h["field"]] = js.parse(w)
            continue
        rows, ok = norm.decode(w)
        rows = rows if ok else nested.decode(w)[0]
        out[h["field"]] = {r.pop(h["key"]): r for r in rows} if h["shape"] == "records" else _from_rows(h["shape"], rows)
    return out


doc = _codec("doc", _doc, _undoc)


def _split(v):
    """A tree of nodes: a record array is its fields' streams with presence marks; other arrays and objects keep their form."""
    if _records(v) and any(v):
        names = list(dict.fromkeys(k for r in v for k in r))
        orders = [[js.Num(str(names.index(k))) for k in r] for r in v]
        same = all(o == orders[0] for o in orders)
        return {"t": "rows", "n": js.Num(str(len(v))), "names": names, "order": orders[0] if same else orders, "same": same, "cols": [_split([r[k] for r in v if k in r]) for k in names]}
    if isinstance(v, list) and len(v) >= 2 and all(isinstance(x, list) for x in v):
        return {"t": "lists", "lens": [js.Num(str(len(x))) for x in v], "all": _split([y for x in v for y in x])}
    if isinstance(v, dict):
        return {"t": "object", "keys": list(v), "vals": [_split(x) for x in v.values()]}
    return {"t": "leaf", "v": v}


def _join(node):
    t = node["t"]
    if t == "leaf":
        return node["v"]
    if t == "object":
        return dict(zip(node["keys"], map(_join, node["vals"]), strict=True))
    if t == "lists":
        flat, out, at = _join(node["all"]), [], 0
        for n in node["lens"]:
            out.append(flat[at : at + int(n.text)])
            at += int(n.text)
        return out
    streams = [iter(_join(c)) for c in node["cols"]]
    orders = [node["order"]] * int(node["n"].text) if node["same"] else node["order"]
    return [{node["names"][int(i.text)]: next(streams[int(i.text)]) for i in o} for o in orders]


shred = _codec("shred", lambda v: js.dump(_split(v)) if _split(v)["t"] != "leaf" else None, lambda body: _join(js.parse(body)))
