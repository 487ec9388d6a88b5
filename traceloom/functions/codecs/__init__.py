"""Lossless block encodings. A codec's encode gives None where it declines; decode gives None for other wires.

Wires begin with `#tl:` and the codec's name. `encode` functions check their own round trip, so what they
return decodes to the same bytes (text codecs) or the same canonical JSON (structured codecs)."""

from __future__ import annotations

from traceloom.functions import jsontext as js
from traceloom.functions.codecs import plain, tables

#: Structured codecs: value -> wire -> value. The order breaks ties.
STRUCTURED = {"columnar": tables.columnar, "doc": tables.doc, "nested": tables.nested, "norm": tables.norm}
#: Text codecs that are tried by default, the first that works; then those that only an opt-in search tries.
TEXT = {"grouped": plain.grouped, "tree": plain.tree, "lock": plain.lock}
MORE_TEXT = {n: getattr(plain, n) for n in ("dictionary", "lines", "frontlines", "search", "log", "kv", "recordcol", "textcol")}
MORE_STRUCTURED = {"shred": tables.shred}


def decode(wire: str) -> str:
    """The block of a wire: canonical JSON or text; a wire of no codec is the block itself."""
    for c in (*STRUCTURED.values(), *MORE_STRUCTURED.values()):
        v, ok = c.decode(wire)
        if ok:
            return js.canonical(v)
    for c in (*TEXT.values(), *MORE_TEXT.values()):
        t = c.decode(wire)
        if t is not None:
            return t
    return wire
