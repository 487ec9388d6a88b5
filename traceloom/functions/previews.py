"""Previews of blocks that are stored away: what stands in their place, by the first form that fits."""

from __future__ import annotations

import re

from traceloom.functions import jsontext as js

LEAST_BUDGET, SHARE = 160, 20  # bytes: a twentieth of the block
HEAD_CHARS = 80
TABLE_BYTES, TABLE_COLUMNS, CELL_CHARS = 512, 16, 160
DECLARATION = re.compile(r"\s*(?:(?:pub(?:\([^)]*\))?|export|default|public|private|protected|static|async|abstract|final|unsafe|const|virtual|inline)\s+)*(?:fn|def|class|struct|enum|trait|impl|interface|function|func|type|module|namespace|record|mod)\b\s*[\w<({]")
TERMS = re.compile(r"[^\W_]{6,}")


def size(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def budget(text: str) -> int:
    return max(LEAST_BUDGET, size(text) // SHARE)


def fit(items: list[str], room: int, glue: str = "\n") -> str:
    """As many first items as fit the room in bytes, and how many are left."""
    out, used = [], 0
    for i, x in enumerate(items):
        used += size(x) + (size(glue) if i else 0)
        if used > room and out:
            return glue.join([*out, f"+{len(items) - i} more"])
        out.append(x)
    return glue.join(out)


def diff_summary(text: str, room: int) -> str | None:
    """Per file: lines added and removed, and the sections that hunks name."""
    if "diff --git" not in text:
        return None
    files: list[list] = []
    for line in text.split("\n"):
        if line.startswith("diff --git"):
            files.append([line.rsplit(" b/", 1)[-1], 0, 0, []])
        elif files:
            m = re.match(r"@@[^@]*@@ ?(.*)", line)
            if m:
                if m[1].strip() and m[1].strip() not in files[-1][3]:
                    files[-1][3].append(m[1].strip())
            elif line[:1] == "+" and not line.startswith("+++"):
                files[-1][1] += 1
            elif line[:1] == "-" and not line.startswith("---"):
                files[-1][2] += 1
    return fit([f"{name} +{a} -{d}" + (f" in {'; '.join(s)}" if s else "") for name, a, d, s in files], room)


GREP = re.compile(r"([^:\s]*[/.][^:\s]*):([0-9]+):")


def location_map(text: str, room: int) -> str | None:
    """Paths of at least two matches `path:line:`, in order of first sight, with their line numbers."""
    found: dict[str, list[str]] = {}
    for line in text.split("\n"):
        if m := GREP.match(line):
            found.setdefault(m[1], []).append(m[2])
    return fit([f"{p}: {','.join(n)}" for p, n in found.items()], room) if sum(map(len, found.values())) >= 2 else None


def outline(text: str, room: int) -> str | None:
    """Declarations with their line numbers; at least three."""
    found = [f"{i}: {line.strip().rstrip('{:').strip()}" for i, line in enumerate(text.split("\n"), 1) if DECLARATION.match(line)]
    return fit(found, room) if len(found) >= 3 else None


def _scalars(row: dict) -> dict:
    """Scalars of a record and, one level down, of its objects."""
    flat = {}
    for k, v in row.items():
        inner = v.items() if isinstance(v, dict) else [(None, v)]
        for n, x in inner:
            if js.is_scalar(x) and x is not None and x != "":
                flat[k if n is None else f"{k}.{n}"] = re.sub(r"[\t\n]", " ", x if isinstance(x, str) else js.dump(x))[:CELL_CHARS]
    return flat


def content_table(text: str) -> str | None:
    """Of a JSON array of records, or an object's largest: columns that are best filled and most varied."""
    value, ok = js.try_parse(text)
    if not ok or size(text) < TABLE_BYTES:
        return None
    if isinstance(value, dict):
        value = max((v for v in value.values() if isinstance(v, list)), key=len, default=None)
    if not isinstance(value, list) or len(value) < 2 or not all(isinstance(x, dict) for x in value):
        return None
    rows = [_scalars(r) for r in value]
    names = {k for r in rows for k in r}
    dull = lambda k: re.search(r"(?i)(url|href|sha|hash|_id$|node_id|etag)", k.rsplit(".", 1)[-1])
    rank = lambda k: (-sum(k in r for r in rows), -len({r.get(k) for r in rows}), k)
    cols = sorted((k for k in names if not dull(k)), key=rank)[:TABLE_COLUMNS]
    return fit(["\t".join(cols), *("\t".join(r.get(k, "") for k in cols) for r in rows)], max(1024, size(text) // 5)) if cols else None


def json_index(text: str, room: int) -> str | None:
    value, ok = js.try_parse(text)
    if not ok or js.is_scalar(value) or not value:
        return None
    kind = lambda v: f"[{len(v)}]" if isinstance(v, list) else f"{{{len(v)}}}" if isinstance(v, dict) else ""
    if isinstance(value, list):
        return f"{len(value)} items" + (f" of {fit(list(value[0]), room, ', ')}" if isinstance(value[0], dict) and value[0] else "")
    return fit([k + kind(v) for k, v in value.items()], room, ", ")


def sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n", text) if s.strip()]


def is_prose(s: str) -> bool:
    """Eight words or more, three quarters letters and blanks."""
    return len(s.split()) >= 8 and sum(c.isalpha() or c == " " for c in s) >= 0.75 * len(s)


def digest(text: str, room: int) -> str | None:
    """Sentences, in order, that each add most terms not yet covered; of text that is mostly prose."""
    every = sentences(text)
    prose = [s for s in every if is_prose(s)]
    terms = {t.lower() for s in prose for t in TERMS.findall(s)}
    if len(prose) < 3 or 2 * sum(map(size, prose)) < size(text) or len(terms) < 8:
        return None
    left, chosen, used = set(terms), [], 0
    has = [{t.lower() for t in TERMS.findall(s)} for s in prose]
    while left:
        i = max((i for i in range(len(prose)) if i not in chosen), key=lambda i: (len(has[i] & left) / (size(prose[i]) + 1), -i), default=None)
        if i is None or not has[i] & left or used + size(prose[i]) > room and chosen:
            break
        chosen.append(i)
        used += size(prose[i])
        left -= has[i]
    return " ".join(prose[i] for i in sorted(chosen))


def head(text: str) -> str:
    return text[:HEAD_CHARS]


def preview(text: str) -> tuple[str, str]:
    """(kind, text)."""
    room = budget(text)
    for kind, made in (("diff summary", diff_summary(text, room)), ("match map", location_map(text, room)), ("code outline", outline(text, room)), ("content table", content_table(text)), ("json index", json_index(text, room)), ("prose digest", digest(text, room))):
        if made:
            return kind, made
    return "head", head(text)


def worth_storing(text: str) -> bool:
    """Small blocks are; prose digests aren't, and a bare head only stands for 2 KB or more."""
    if size(text) < 512:
        return True
    kind, _ = preview(text)
    return kind != "prose digest" and (kind != "head" or size(text) >= 2048)
