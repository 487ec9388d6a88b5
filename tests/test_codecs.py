"""Round trips of the codecs on random blocks, and refusals."""

import random

import pytest

from traceloom.functions import codecs
from traceloom.functions import jsontext as js

SCALARS = ["a", "x\ty", 'q"\\\n', "é中", "", js.Num("1.50"), js.Num("1e5"), js.Num("12"), True, False, None]


def value(r, depth):
    k = r.random()
    if not depth or k < 0.5:
        return r.choice(SCALARS)
    if k < 0.75:
        return {r.choice("abcdefg") + r.choice(["", "1", ".z"]): value(r, depth - 1) for _ in range(r.randint(0, 6))}
    return [value(r, depth - 1) for _ in range(r.randint(0, 4))]


def block(r, i):
    keys = [f"k{j}" for j in range(r.randint(1, 5))]
    if i % 3 == 0:
        return [{k: r.choice(SCALARS) for k in keys} for _ in range(r.randint(1, 6))]
    if i % 3 == 1:
        return [{"id": js.Num(str(j)), **{k: value(r, 2) for k in keys if r.random() < 0.8}} for j in range(r.randint(1, 6))]
    return {"meta": value(r, 2), "m": {f"e{j}": {"a": r.choice(SCALARS), "b": js.Num("1")} for j in range(12)}, "l": [{"long_field_name": js.Num(str(j)), "another_field": "x"} for j in range(9)]}


@pytest.mark.parametrize("name", sorted(codecs.STRUCTURED | codecs.MORE_STRUCTURED))
def test_structured_round_trip(name):
    c, r, hits = (codecs.STRUCTURED | codecs.MORE_STRUCTURED)[name], random.Random(name), 0
    for i in range(900):
        v = block(r, i)
        wire = c.encode(v)
        if wire is not None:
            hits += 1
            assert codecs.decode(wire) == js.canonical(v)
    assert hits > 20


TEXTS = {
    "tree": "root\n├── a v1\n│   ├── b\n│   └── c\n│       └── d\n└── e\n    ├── f\n    │   └── g\n    └── h\n",
    "lock": "# auto\nversion = 3\n\n" + "\n\n".join(f'[[package]]\nname = "p{i}"\nversion = "1.{i}"\ndependencies = [\n "x",\n "y 1",\n]' for i in range(5)) + "\n",
    "grouped": "src/a/b.rs\nsrc/a/c.rs\nsrc/d/e.rs\n",
    "search": "src/a.rs:1:fn x\nsrc/a.rs:22:let y = 3\nlib/b.rs:3:z\nother",
    "log": "\n".join(f"2024-01-0{i % 9} 12:0{i % 6}:11 INFO worker {i} done" for i in range(12)),
    "kv": "\n".join(f"key{i % 3}=value {i}" for i in range(8)) + "\nnote",
    "textcol": "\n".join(f"  {i}   name{i % 2}\t x{i}" for i in range(6)) + "\ntotal",
    "dictionary": "hello world again hello world again hello world again",
    "lines": "one line\ntwo\none line\nthree\none line",
    "frontlines": "/a/b/c\n/a/b/d\n/a/e\n/f",
    "recordcol": "a\n1\na\n2\na\n3\na\n4",
}


@pytest.mark.parametrize("name", sorted(codecs.TEXT | codecs.MORE_TEXT))
def test_text_round_trip(name):
    c = (codecs.TEXT | codecs.MORE_TEXT)[name]
    assert c.encode(TEXTS[name]) is not None
    for t in [*TEXTS.values(), "", " ", "\n\n\n\n", "a\r\nb\n", "é/ü\né/x\n\n"]:
        wire = c.encode(t)
        assert wire is None or codecs.decode(wire) == t


def test_wires_of_no_codec_are_text():
    assert codecs.decode("plain") == "plain"
    assert codecs.decode("#tl:columnar\nbroken") == "#tl:columnar\nbroken"


def test_number_text_survives_and_duplicates_show():
    assert js.canonical(js.parse('{"b": 1.50, "a": [1e5, -0]}')) == '{"a":[1e5,-0],"b":1.50}'
    assert js.has_duplicate_keys('[{"a":1,"a":2}]') and not js.has_duplicate_keys('{"a":1') and not js.has_duplicate_keys('{"a":1}')


def test_select():
    b = '[{"id":7,"s":"x"},{"id":8,"s":{"t":[1,2.0]}}]'
    assert js.select(b, "id=8/s/t/[1]") == "2.0"
    assert js.select(b, "[0]/s") == "x"
    assert js.select(b, "[9]") is None and js.select("no json", "a") is None
    assert js.select("a\nb\nc\n", "L2-9") == "b\nc"
    assert js.select("a", "L0-1") is None and js.select("a", "L2-2") is None
