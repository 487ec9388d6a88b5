"""Every codec over blocks of its own shape, made of all events: one block for each user.

A block's lines are one SQL expression that both engines read; the answer says, for each block, its size, whether the
wire decodes to the block (JSON: to its canonical text), and whether it is smaller than the block."""

import pandas as pd
from pyspark.sql import functions as F

from traceloom.functions import codecs
from traceloom.functions import jsontext as js
from traceloom.plans import adapters as ad
from traceloom.plans.registry import query

E, T = "CAST(event_id AS STRING)", "event_type"


def _mod(n):
    return f"CAST(event_id % {n} AS STRING)"


#: Codec: what stands before the lines, a line, between lines, after them.
JSON_SHAPES = {
    "columnar": ("[", f"""'{{"event_id":' || {E} || ',"event_type":"' || {T} || '","share":' || {_mod(7)} || '}}'""", ",", "]"),
    "nested": ("[", f"""'{{"event_id":' || {E} || ',"at":{{"kind":"' || {T} || '","slot":' || {_mod(7)} || '}}}}'""", ",", "]"),
    "norm": ("[", f"""'{{"event_id":' || {E} || ',"lines":[{{"part":' || {_mod(5)} || ',"quantity":' || {_mod(3)} || '}},{{"part":' || {_mod(11)} || ',"quantity":1}}]}}'""", ",", "]"),
    "doc": ('{"source":"events","pages":2,"records":[', f"""'{{"event_id":' || {E} || ',"event_type":"' || {T} || '"}}'""", ",", "]}"),
    "shred": ("[", f"""'{{"event_id":' || {E} || ',"labels":["' || {T} || '"],"share":{{"of_seven":' || {_mod(7)} || '}}}}'""", ",", "]"),
}
NL = "\n"
TEXT_SHAPES = {
    "grouped": ("", f"'src/modules/of/events/' || {T} || {E} || '.rs'", NL, NL),
    "tree": ("package v1" + NL, f"'├── ' || {T} || ' v' || {_mod(9)} || chr(10) || '│   └── event v' || {E}", NL, NL + "└── last v2" + NL),
    "lock": ("# made by a tool" + NL + "version = 3" + NL + NL, f"""'[[package]]' || chr(10) || 'name = "' || {T} || {E} || '"' || chr(10) || 'version = "1.' || {_mod(9)} || '"'""", NL + NL, NL),
    "dictionary": ("", f"'an event of the kind ' || {T} || ' was read from the table, number ' || {E}", NL, NL),
    "lines": ("", f"'an event of the kind ' || {T} || ' was read from the table'", NL, NL),
    "frontlines": ("", f"'/data/warehouse/events/by-kind/' || {T} || '/' || {E}", NL, NL),
    "search": ("", f"'src/modules/' || {T} || '.rs:' || {E} || ':    let slot = ' || {_mod(10)} || ';'", NL, NL),
    "log": ("", f"'2024-01-0' || {_mod(9)} || ' 12:00:0' || {_mod(7)} || ' INFO worker ' || {E} || ' done with the kind ' || {T}", NL, NL),
    "kv": ("", f"'setting_of_the_slot_' || {_mod(3)} || '=value ' || {E}", NL, NL),
    "recordcol": ("", f"{T} || chr(10) || 'number of the event' || chr(10) || {E}", NL, ""),
    "textcol": ("", f"'  ' || {E} || '   ' || {T} || '   in the table   x' || {_mod(4)}", NL, NL),
}


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def blocks(spark, d, shape):
    """id, raw."""
    head, line, between, tail = shape
    e = ad.table(spark, d, "events").select(F.col("user_id").alias("id"), F.struct("event_id", F.expr(line).alias("line")).alias("x"))
    joined = F.array_join(F.array_sort(F.collect_list("x"))["line"], between)
    return e.groupBy("id").agg(F.concat(F.lit(head), joined, F.lit(tail)).alias("raw"))


def oracle(shape) -> str:
    head, line, between, tail = shape
    return f"SELECT user_id AS id, CAST(strlen({_literal(head)} || string_agg({line}, {_literal(between)} ORDER BY event_id) || {_literal(tail)}) AS BIGINT) AS bytes, true AS faithful, true AS smaller FROM events GROUP BY 1"


def _round_trip(codec, structured):
    @F.pandas_udf("struct<faithful: boolean, smaller: boolean>")
    def trip(raws: pd.Series) -> pd.DataFrame:
        out = []
        for raw in raws:
            value = js.parse(raw) if structured else raw
            wire = codec.encode(value)
            out.append((None, None) if wire is None else (codecs.decode(wire) == (js.canonical(value) if structured else raw), len(wire.encode()) < len(raw.encode())))
        return pd.DataFrame(out, columns=["faithful", "smaller"])

    return trip


def _register(name, codec, shape, structured):
    @query(f"c_{name}", oracle(shape))
    def _(spark, d):
        told = blocks(spark, d, shape).select("id", F.octet_length("raw").cast("long").alias("bytes"), _round_trip(codec, structured)("raw").alias("t"))
        return told.select("id", "bytes", "t.faithful", "t.smaller")


for _n, _c in (codecs.STRUCTURED | codecs.MORE_STRUCTURED).items():
    _register(_n, _c, JSON_SHAPES[_n], True)
for _n, _c in (codecs.TEXT | codecs.MORE_TEXT).items():
    _register(_n, _c, TEXT_SHAPES[_n], False)
