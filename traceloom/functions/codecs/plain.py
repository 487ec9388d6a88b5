"""Text codecs: listings, trees, lock files, and dictionaries, templates and columns of lines."""

from __future__ import annotations

import re
from collections import Counter
from types import SimpleNamespace

from traceloom.functions import jsontext as js
from traceloom.functions.codecs import tables

MARK = tables.MARK


def _codec(name, encode, decode):
    head = MARK + name + "\n"

    def dec(wire: str) -> str | None:
        if not wire.startswith(head):
            return None
        try:
            return decode(wire[len(head) :])
        except (ValueError, KeyError, IndexError, TypeError, AttributeError):
            return None

    def enc(raw: str) -> str | None:
        body = encode(raw)
        return head + body if body is not None and dec(head + body) == raw else None

    return SimpleNamespace(name=name, encode=enc, decode=dec)


def _rows(raw: str, least: int) -> tuple[list[str], str] | None:
    """Lines, and whether a line break ends the text (1 or 0)."""
    body = raw.removesuffix("\n")
    lines = body.split("\n")
    return (lines, "1" if body != raw else "0") if body and len(lines) >= least else None


def _text(lines, ended: str) -> str:
    return "\n".join(lines) + ("\n" if ended == "1" else "")


GREP = re.compile(r":[0-9]+:")


def _grouped(raw):
    got = _rows(raw, 3)
    if not got:
        return None
    lines, ended = got
    shaped = [bool(GREP.search(x)) for x in lines]
    if any(shaped):
        if not all(shaped):
            return None
        cut = [x[: x.index(":")].rfind("/") + 1 for x in lines]
    else:
        if any("\t" in x or not x for x in lines) or not any("/" in x for x in lines):
            return None
        cut = [x.rfind("/") + 1 for x in lines]
    dirs = [x[:n] for x, n in zip(lines, cut)]
    if len(set(dirs)) == len(lines):
        return None  # no directory repeats
    out, last = [ended], None
    for x, d in zip(lines, dirs):
        if d != last:
            out.append("@" + d)
            last = d
        out.append("\t" + x[len(d) :])
    return "\n".join(out)


def _ungrouped(body):
    ended, *rows = body.split("\n")
    out, at = [], ""
    for r in rows:
        if r[:1] == "\t":
            out.append(at + r[1:])
        elif r[:1] == "@":
            at = r[1:]
        else:
            return None
    return _text(out, ended)


grouped = _codec("grouped", _grouped, _ungrouped)

BAR, GAP, TEE, ELL = "│   ", "    ", "├── ", "└── "


def _node(line: str) -> tuple[int, bool, str]:
    """Depth, whether it is a node (not a label between bars), text."""
    depth = 0
    while line.startswith((BAR, GAP)):
        line, depth = line[4:], depth + 1
    if line.startswith((TEE, ELL)):
        return depth + 1, True, line[4:]
    return depth, depth == 0, line


def _tree(raw):
    got = _rows(raw, 4)
    if not got:
        return None
    nodes = [_node(x) for x in got[0]]
    if not any(d for d, _, _ in nodes):
        return None
    return "\n".join([got[1], *("  " * d + ("- " if node and d else "" if node else ": ") + t for d, node, t in nodes)])


def _untree(body):
    ended, *rows = body.split("\n")
    nodes = []
    for r in rows:
        m = re.fullmatch(r"((?:  )*)(- |: )?(.*)", r)
        nodes.append((len(m[1]) // 2, m[2] != ": ", m[3]) if m[2] else (0, True, r))
    # from the end: whether a later sibling stands at a depth before the parent does
    more: list[bool] = []
    drawn = []
    for d, node, t in reversed(nodes):
        more = more[: d + 1] + [False] * (d + 1 - len(more))
        if not node:
            bars = "".join(BAR if more[i + 1] else GAP for i in range(d)) if len(more) > d else ""
            drawn.append(bars + t)
            more = more[: d + 1]
            continue
        drawn.append("".join(BAR if more[i] else GAP for i in range(1, d)) + ((TEE if more[d] else ELL) if d else "") + t)
        more[d] = d > 0
    return _text(drawn[::-1], ended)


tree = _codec("tree", _tree, _untree)

PACKAGE = "[[package]]"
SCALARS = ["name", "version", "source", "checksum"]


def _lock(raw):
    at = raw.find(PACKAGE + "\n")
    if at < 0:
        return None
    records = []
    for block in raw[at:].rstrip("\n").split("\n\n"):
        first, *rest = block.split("\n")
        if first != PACKAGE:
            return None
        rec, rows = {}, iter(rest)
        for row in rows:
            k, eq, v = row.partition(" = ")
            if not eq:
                return None
            if v == "[":
                rec[k] = [js.parse(x.strip().rstrip(",")) for x in iter(lambda: next(rows, "]"), "]")]
            else:
                rec[k] = js.parse(v)
        records.append(rec)
    table = tables.nested.encode(records) if len(records) >= 3 else None
    if table is None:
        return None
    before = raw[:at]
    return f"{js.quote(before)}\n{len(raw) - len(raw.rstrip(chr(10)))}\n{table}"


def _safe_lock(raw):
    try:
        return _lock(raw)
    except ValueError:
        return None


def _unlock(body):
    before, ends, table = body.split("\n", 2)
    blocks = []
    for r in tables.nested.decode(table)[0]:
        rows = [PACKAGE, *(f"{k} = {js.dump(r[k])}" for k in SCALARS if k in r)]
        if "dependencies" in r:
            rows += ["dependencies = [", *(f" {js.dump(x)}," for x in r["dependencies"]), "]"]
        blocks.append("\n".join(rows))
    return js.parse(before) + "\n\n".join(blocks) + "\n" * int(ends)


lock = _codec("lock", _safe_lock, _unlock)

CODES, LEAST_BYTES, LEAST_COUNT = 400, 5, 3


def _dictionary(raw):
    """Frequent words, most bytes saved first, as a private-use character each."""
    if re.search("[\ue000-\uf8ff]", raw):
        return None
    count = Counter(re.findall(r"[^\s]+", raw))
    best = sorted((w for w, n in count.items() if n >= LEAST_COUNT and len(w.encode()) >= LEAST_BYTES), key=lambda w: (-len(w.encode()) * count[w], w))[:CODES]
    if not best:
        return None
    code = {w: chr(0xE000 + i) for i, w in enumerate(best)}
    return js.dump(best) + "\n" + re.sub(r"[^\s]+", lambda m: code.get(m[0], m[0]), raw)


def _undictionary(body):
    head, _, text = body.partition("\n")
    words = js.parse(head)
    return re.sub("[\ue000-\uf8ff]", lambda m: words[ord(m[0]) - 0xE000], text)


dictionary = _codec("dictionary", _dictionary, _undictionary)


def _lines(raw):
    got = raw.split("\n")
    count = Counter(got)
    best = sorted((x for x, n in count.items() if n >= 2 and len(x.encode()) >= LEAST_BYTES), key=lambda x: (-len(x.encode()) * count[x], x))[:CODES]
    if not best:
        return None
    code = {x: f"={i}" for i, x in enumerate(best)}
    return "\n".join([js.dump(best), *(code.get(x, "+" + x) for x in got)])


def _unlines(body):
    head, *rows = body.split("\n")
    known = js.parse(head)
    return "\n".join(r[1:] if r[0] == "+" else known[int(r[1:])] for r in rows)


lines = _codec("lines", _lines, _unlines)


def shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _front(raw):
    got = raw.split("\n")
    if len(got) < 4:
        return None
    out, last = [], ""
    for x in got:
        n = shared_prefix(last, x)
        out.append(f"{n}|{x[n:]}")
        last = x
    return "\n".join(out)


def _unfront(body):
    out, last = [], ""
    for r in body.split("\n"):
        n, _, rest = r.partition("|")
        last = last[: int(n)] + rest
        out.append(last)
    return "\n".join(out)


frontlines = _codec("frontlines", _front, _unfront)


def _columns(cols: dict[str, list[str]]) -> str:
    """Each column as a constant, run lengths, a dictionary or a list: the shortest, the first of equals."""
    out = []
    for name, v in cols.items():
        runs: list = []
        for x in v:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        known = list(dict.fromkeys(v))
        forms = [
            {"f": "runs", "v": [x for x, _ in runs], "n": [js.Num(str(n)) for _, n in runs]},
            {"f": "dict", "v": known, "i": [js.Num(str({x: i for i, x in enumerate(known)}[x])) for x in v] if len(known) < 200 else v},
            {"f": "list", "v": v},
        ]
        out.append(min((js.dump(x) for x in forms if not (x["f"] == "dict" and len(known) >= 200)), key=len))
    return "\n".join([js.dump(list(cols)), *out])


def _uncolumns(text: str) -> dict[str, list[str]]:
    head, *rows = text.split("\n")
    out = {}
    for name, row in zip(js.parse(head), rows, strict=True):
        x = js.parse(row)
        out[name] = [v for v, n in zip(x["v"], x["n"]) for _ in range(int(n.text))] if x["f"] == "runs" else [x["v"][int(i.text)] for i in x["i"]] if x["f"] == "dict" else x["v"]
    return out


def _by_pattern(name, pattern, fields, least):
    """Lines that match become columns; the others stay whole, in a column of kinds."""
    p = re.compile(pattern)

    def enc(raw):
        got = raw.split("\n")
        found = [p.fullmatch(x) for x in got]
        if sum(m is not None for m in found) < least:
            return None
        cols = {"kind": ["m" if m else "o" for m in found]} | {f: [m[f] for m in found if m] for f in fields} | {"other": [x for x, m in zip(got, found) if not m]}
        return _columns(cols)

    def dec(body):
        c = _uncolumns(body)
        matched, other = zip(*[c[f] for f in fields]) if c[fields[0]] else iter(()), iter(c["other"])
        matched = iter(matched)
        return "\n".join(glue(next(matched)) if k == "m" else next(other) for k in c["kind"])

    glue = {"search": lambda v: f"{v[0]}:{v[1]}:{v[2]}", "kv": lambda v: f"{v[0]}={v[1]}"}[name]
    return _codec(name, enc, dec)


search = _by_pattern("search", r"(?P<path>[^:\s]+):(?P<line>[0-9]+):(?P<content>.*)", ["path", "line", "content"], 2)
kv = _by_pattern("kv", r"(?P<key>[^=\s]+)=(?P<value>.*)", ["key", "value"], 4)


def _log(raw):
    got = raw.split("\n")
    if len(got) < 4 or "\x00" in raw:
        return None
    masks = [re.sub("[0-9]+", "\x00", x) for x in got]
    known = list(dict.fromkeys(masks))
    if len(known) * 2 > len(got):
        return None
    at = {m: i for i, m in enumerate(known)}
    return js.dump(known) + "\n" + js.dump([[js.Num(str(at[m])), *re.findall("[0-9]+", x)] for x, m in zip(got, masks)])


def _unlog(body):
    known, rows = map(js.parse, body.split("\n"))
    out = []
    for i, *params in rows:
        parts = known[int(i.text)].split("\x00")
        out.append("".join(a + b for a, b in zip(parts, [*params, ""], strict=True)))
    return "\n".join(out)


log = _codec("log", _log, _unlog)


def _period(raw):
    got = raw.split("\n")
    forms = [(len(w), w) for p in range(2, 17) if len(got) >= 2 * p and len(got) % p == 0 for w in [f"{p}\n" + _columns({str(i): got[i::p] for i in range(p)})]]
    return min(forms, key=lambda x: x[0])[1] if forms else None


def _unperiod(body):
    p, _, rest = body.partition("\n")
    cols = list(_uncolumns(rest).values())
    if len(cols) != int(p):
        return None
    return "\n".join(x for row in zip(*cols, strict=True) for x in row)


recordcol = _codec("recordcol", _period, _unperiod)


def _textcol(raw):
    """Lines of the most frequent number of words become columns of words and of the gaps before them."""
    got = raw.split("\n")
    parts = [re.findall(r"[ \t]*[^ \t]+", x) for x in got]
    whole = ["".join(p) == x for p, x in zip(parts, got)]
    sizes = Counter(len(p) for p, w in zip(parts, whole) if w and len(p) >= 2)
    if not sizes:
        return None
    n = min(sizes, key=lambda k: (-sizes[k], k))
    if sizes[n] < 3:
        return None
    hit = [w and len(p) == n for p, w in zip(parts, whole)]
    cols = {"kind": ["m" if h else "o" for h in hit], "other": [x for x, h in zip(got, hit) if not h]}
    for i in range(n):
        words = [p[i] for p, h in zip(parts, hit) if h]
        cols[f"g{i}"] = [w[: len(w) - len(w.lstrip(" \t"))] for w in words]
        cols[f"w{i}"] = [w.lstrip(" \t") for w in words]
    return _columns(cols)


def _untextcol(body):
    c = _uncolumns(body)
    n = (len(c) - 2) // 2
    rows = iter(zip(*[[g + w for g, w in zip(c[f"g{i}"], c[f"w{i}"], strict=True)] for i in range(n)], strict=True))
    other = iter(c["other"])
    return "\n".join("".join(next(rows)) if k == "m" else next(other) for k in c["kind"])


textcol = _codec("textcol", _textcol, _untextcol)
