"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties,
repeated rows and extra columns."""

import gc
import hashlib
import random
import re
import string
import zlib

import numpy as np
import pytest

from traceloom.llm import op1_lines, op2_licenses, op3_near_duplicates, op4_sharding, op5_packing, op6_decontamination, op7_language, op8_records, op9_audio, op10_suffixes, tokens
from traceloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, length int, rank int"


def docs(spark, rows, schema=SCHEMA):
    """rows of (doc_id, text); the other columns clash with names that operators use."""
    return spark.createDataFrame([(k, t, "en", f"s{(k or 0) % 3}", len(t or ""), "x", 1, 2) for k, t in rows], schema)


def word(r):
    return "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(1, 7)))


def corpus(seed, n=60):
    """Random texts with copies, near copies, shared passages, nulls, empties and repeated rows."""
    r = random.Random(seed)
    passage = " ".join(word(r) for _ in range(30))
    out = []
    for k in range(n):
        t = " ".join(word(r) for _ in range(r.randint(1, 120)))
        if out and r.random() < 0.3:
            w = (r.choice(out)[1] or "").split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word(r)
            t = " ".join(w)
        if r.random() < 0.3:
            at = r.randrange(len(t) + 1)
            t = t[:at] + "\n" + passage + "\n" + t[at:]
        out.append((k * 3 % n if n % 3 else k, t))
    return [*out, (n + 1, None), (n + 2, ""), (n + 3, " \n\t"), (n + 4, "é" * 3000), (n + 5, "One two"), (n + 6, "one  TWO"), (n + 7, "a " * 4000), (None, out[0][1]), out[5], out[5]]


def test_empty_tables(spark, tmp_path):
    none = docs(spark, [])
    assert op1_lines.drop_boilerplate(none).count() == 0
    assert op2_licenses.scan(none).count() == 0
    assert op3_near_duplicates.link(none).count() == 0
    assert op4_sharding.shuffle(none.select("doc_id", "text")).count() == 0
    assert op5_packing.pack(none).count() == 0
    assert op6_decontamination.decontaminate(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert op7_language.predict(none, op7_language.fit(none)).count() == 0
    assert op9_audio.digests(op9_audio.features(op9_audio.media(none))).count() == 0
    assert op10_suffixes.remove_repeats(none).count() == 0
    op8_records.write_records(none, str(tmp_path / "r"))
    assert op8_records.read_records(spark, str(tmp_path / "r")).count() == 0


def test_lines_drop_what_is_common_on_a_host(spark):
    rows = [(i, f"menu \n{i}\n\n menu") for i in range(0, 30, 3)] + [(i, f"menu\n{i}") for i in range(1, 30, 9)] + [(31, None)]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in op1_lines.drop_boilerplate(docs(spark, rows), ratio=0.5, min_pages=5).collect()}
    assert got[0] == ("0\n", 4, 2) and got[1] == ("menu\n1", 2, 0) and got[31] == (None, -1, -1)
    assert "key" in op1_lines.drop_boilerplate(docs(spark, rows)).columns


def test_licenses(spark):
    rows = [(1, "x y\nLicensed under the Apache License, Version 2.0.\nfoo bar"), (2, "Released under the MIT License."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under CC BY-NC 4.0."), (5, "licensed under the"), (6, None), (7, ""), (8, "plain words about nothing in particular"), (2, "Released under the MIT License.")]
    got = sorted((r["doc_id"], r["paragraph"], r["family"], r["confirmed"]) for r in op2_licenses.scan(docs(spark, rows)).collect() if r["confirmed"])
    assert got == [(1, 1, "apache", True), (2, 0, "mit", True), (2, 0, "mit", True), (3, 0, "gpl", True), (4, 0, "cc-by-nc", True)]


def test_licence_classifier_on_wordings_it_has_not_seen():
    weights, bias, heat = op2_licenses.train(["some ordinary text about the weather and the sea"] * 50)
    for family, text in {"mit": "our tool is released under the MIT license today", "gpl": "licensed under the gnu general public license version 2 or later", "unknown": "the cat sat on the mat under the tree"}.items():
        z = sum((weights[g] for g in op2_licenses.grams(op2_licenses.words(text)) if g in weights), np.zeros(len(bias))) + bias
        assert [*op2_licenses.FAMILIES, "unknown"][int(np.argmax(z))] == family


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("seed", [1])
def test_near_duplicates_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = op3_near_duplicates.link(docs(spark, rows)).collect()
    sets = {}
    for k, t in rows:
        if k is not None:
            sets[k] = shingles(t)
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])


def test_large_groups_of_near_copies(spark):
    """A base and copies of it with many edits each: buckets in several components, beyond SMALL."""
    r = random.Random(4)
    base = [word(r) for _ in range(150)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(r.choice([0, 2, 3, 5, 6])):
            w[r.randrange(150)] = word(r) + "q"
        rows.append((k, " ".join(w)))
    for k in range(60, 70):  # a second family near the first
        w = rows[59][1].split()
        w[5 + k % 3] = "zz"
        rows.append((k, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in op3_near_duplicates.link(docs(spark, rows)).collect()}
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}
    for _ in range(70):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_signatures_within_the_guaranteed_distance_share_a_key():
    r = np.random.default_rng(1)
    m = op3_near_duplicates.CHUNKS * op3_near_duplicates.WIDTH
    for _ in range(300):
        a = r.integers(0, 65536, m).astype("<u2")
        b = a.copy()
        at = r.choice(m, 2 * op3_near_duplicates.CHUNKS - 1, replace=False)
        b[at] ^= 1
        ka, kb = op3_near_duplicates.index_keys(np.stack([a, b]))
        assert set(ka) & set(kb)


def test_components_of_chains_stars_and_rings(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 15) for i in range(15)] + [(5, 5)]
    r.shuffle(edges)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, **{200 + i: 200 for i in range(15)}}


@pytest.mark.parametrize("bin_rows", [3, 10**6])
def test_shards_are_exact_and_gapless(spark, tmp_path, bin_rows):
    rows = corpus(3)
    docs(spark, rows).select("doc_id", "text", "key").repartition(5).write.parquet(str(tmp_path / "in"))
    got = op4_sharding.shuffle(spark.read.parquet(str(tmp_path / "in")), 7, 3, bin_rows).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert {len(v) for v in by.values()} <= {len(rows) // 7, len(rows) // 7 + 1} and len(by) == 7
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got) == sorted((k is None, k or 0, t or "") for k, t in rows)


def test_matrix_sums_and_spread():
    m = op4_sharding.matrix([100, 0, 37, 63, 1000], 8, 1)
    assert m.sum(1).tolist() == [100, 0, 37, 63, 1000] and set(m.sum(0)) == {150}
    draws = np.array([op4_sharding.matrix([50, 50], 2, s)[0, 0] for s in range(400)])
    assert abs(draws.mean() - 25) < 0.6 and 4 < draws.var() < 9  # hypergeometric: 25 and 6.3


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokens.default_path()).encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_gives_the_library_s_ids():
    e = tokens.Encoder(tokens.default_path())
    for t in ["It's WE'LL don't 'tis '''s ..'s", "é é naïve ÀÉ ß ẞ ﬁ x² 5½ x×y a÷b µ ª º", "a​b a\x0bb c\x1cd　中文 İstanbul ÿŸ Σας ΟΔΟΣ", "<|endoftext|> a<|b", "", None, " \n", "x" * 5000, *[t for _, t in corpus(9)]]:
        assert [*np.frombuffer(e.encode(t), "<u4").tolist(), 1] == ids_of(t)


def test_encoder_asks_the_model_once_for_a_piece():
    e = tokens.Encoder(tokens.default_path())
    asked = []

    class Model:
        def tokenize(self, piece, of=e.model):
            asked.append(piece)
            return of.tokenize(piece)

    next(x for x in gc.get_objects() if isinstance(x, tokens._Pieces) and x.model is e.model).model = Model()
    r = random.Random(11)
    many = sorted({"".join(r.choices(string.ascii_lowercase, k=7)) for _ in range(250_000)})
    first = e.encode(" ".join(many))
    # more pieces than the cache held before, the same ones between other marks
    assert len(asked) == len(many) and e.encode("\n".join(many).upper()) == first and len(asked) == len(many)
    e.encode(", ".join(many))
    assert asked[len(many) :] == [","]
    long = "ab1" + "é" * 200 + "!?" * 90
    assert [*np.frombuffer(e.encode(long), "<u4").tolist(), 1] == ids_of(long)


def test_packing_keeps_every_id_once(spark):
    rows = corpus(5)
    got = op5_packing.pack(docs(spark, rows), window=64).collect()
    want = sorted(((k is None, k or 0), ids_of(t)) for k, t in rows)
    have = {}
    for r in got:
        have.setdefault(((r["doc_id"] is None, r["doc_id"] or 0), r["doc_tokens"]), []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["ids_crc32"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    assert sum(r["length"] for r in got) == sum(len(i) for _, i in want)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(seqs) == list(range(len(seqs)))
    assert len(seqs) * 64 < 1.1 * sum(r["length"] for r in got) + 64


def test_packing_solution_covers_any_histogram():
    r = random.Random(6)
    for _ in range(20):
        hist = {r.randint(1, 64): r.randint(1, 500) for _ in range(r.randint(1, 40))}
        slots = op5_packing.solve(hist, 64)
        for n, c in hist.items():
            assert sorted(x for a, lo, hi, *_ in slots if a == n for x in range(lo, hi)) == list(range(c))
        fill = {}
        for n, lo, hi, times, first, offset in slots:
            for k in range(hi - lo):
                fill.setdefault(first + k // times, []).append((offset + k % times * n, n))
        for s in fill.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= 64
        if len(hist) > 30:
            assert len(fill) <= sum(n * c for n, c in hist.items()) / 64 * 1.05 + len(hist)


def test_decontamination_against_brute_force(spark):
    r = random.Random(7)
    items = [(i, " ".join(word(r) for _ in range(r.choice([0, 1, 3, 12, 13, 14, 40])))) for i in range(12)] + [(20, None), (21, "..."), (1, "one two three")]
    rows = []
    for k in range(40):
        w = [word(r) for _ in range(r.randint(0, 60))]
        i = r.choice(items)[1] or ""
        w[r.randint(0, len(w)) : 0] = i.upper().replace(" ", r.choice([" ", ", ", "\n"])).split(" ")
        rows.append((k, " ".join(w) + r.choice(["", "!", " é’x"])))
    rows += [(50, None), (51, ""), (52, "?! .")]

    def norm(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    wins = {(str(i), tuple(w[j : j + 13])) for i, t in items for w in [norm(t)] for j in range(max(1, len(w) - 12) if w else 0)}
    got = {x["doc_id"]: x for x in op6_decontamination.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for k, t in rows:
        w, hit, found = norm(t), set(), set()
        for i, g in wins:
            for j in range(len(w) - len(g) + 1):
                if tuple(w[j : j + len(g)]) == g:
                    hit |= set(range(j, j + len(g)))
                    found.add(i)
        x = got[k]
        assert (x["n_words"], x["n_hit"], x["items"]) == (len(w), len(hit), sorted(found))
        assert [y for s in x["spans"] for y in norm(t[s["start"] : s["end"]])] == [w[j] for j in sorted(hit)]


def test_a_benchmark_beyond_a_block_gives_the_same(spark):
    items = spark.createDataFrame([(i, f"alpha beta gamma w{i}") for i in range(30)], "item_id long, text string")
    rows = [(k, f"x alpha beta gamma w{k} alpha BETA gamma w{k + 1} y") for k in range(40)] + [(50, None), (51, ""), (3, "alpha beta gamma w3")]
    told = lambda **a: sorted((tuple(map(repr, r)) for r in op6_decontamination.decontaminate(docs(spark, rows), items, **a).collect()))
    whole = told()
    assert whole == told(block_bytes=100) and sum("['1', '2']" in r[3] for r in whole) == 1


def test_an_item_without_id_hits_words_only(spark):
    items = spark.createDataFrame([(None, "alpha beta"), (7, "beta gamma")], "item_id long, text string")
    got = op6_decontamination.decontaminate(docs(spark, [(1, "x alpha beta gamma"), (2, "alpha beta")]), items).orderBy("doc_id").collect()
    assert [(r["n_hit"], r["items"]) for r in got] == [(3, ["7"]), (2, [])]


def test_patterns_of_many_words_match_at_words_only():
    many = [(str(i), f"w{i} w{i + 256} w{i + 65536}") for i in range(0, 70_000, 97)]
    windows = op6_decontamination.Windows(many, 13)
    n, mark, found = op6_decontamination.scan("w97 w353 w65633 w97 w0 w256 w65536 w353 w65633", windows)
    assert (n, mark.tolist(), found) == (9, [True] * 3 + [False] + [True] * 3 + [False] * 2, {"97", "0"})


def test_language(spark):
    r = random.Random(8)
    syllables = {"aa": ["ka", "to", "mi", "ra"], "bb": ["schl", "ung", "ein", "ver"], "cc": ["eau", "ille", "ou", "ç"]}
    text = lambda l: " ".join("".join(r.choice(syllables[l]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 60)))
    rows = [(i, text(l), l) for i in range(150) for l in [r.choice(list(syllables))]]
    df = spark.createDataFrame(rows + [(200, None, "aa"), (201, "", "bb"), (202, "12 34 !", "cc"), (203, "ka to mi", None), (204, "½ ² ① Ⅷ", "aa")], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in op7_language.predict(df, op7_language.fit(df.where("doc_id < 100 or doc_id > 190"))).collect()}
    assert all(got[i]["lang_pred"] == l for i, _, l in rows[100:])
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (200, 201, 202, 204)) and got[203]["lang_pred"] == "aa"
    assert all(0 <= x["score"] <= 1 for x in got.values())


def test_every_labelled_row_is_learned_from(spark):
    r = random.Random(9)
    rows = [(i, f"{word(r)} {word(r)}", l) for i in range(2600) for l in ("aa", "bb")[: 1 + (i < 40)]] + [(None, "no key", "aa"), (7, "12", "bb"), (8, None, "bb"), (9, "no label", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    vectors = {l: [v for _, t, x in rows if x == l and (v := op7_language.vector(t)) is not None] for l in ("aa", "bb")}
    unit = {l: (s := np.sum(vs, 0, np.float64)) / np.linalg.norm(s) for l, vs in vectors.items()}
    mean = (unit["aa"] + unit["bb"]) / 2
    prototypes = op7_language.fit(df)
    assert sorted(prototypes) == ["aa", "bb"]
    assert all(np.allclose(prototypes[l], (unit[l] - mean) / np.linalg.norm(unit[l] - mean), atol=1e-4) for l in unit)
    told = op7_language.predict(df, prototypes, keep=["lang"])
    cosines = sorted(x["cosine"] for x in told.collect() if x["lang"] and x["lang_pred"] != "und")
    assert len(cosines) == 2641 and op7_language.least_cosine(told) == cosines[26] / 2
    assert op7_language.least_cosine(told.where("lang is null")) == 0.0


def test_vectors_are_bound_and_bundled():
    v = op7_language.vector("ab")
    raw = sum(np.roll(op7_language.letter(ord(a)), 2).astype(float) * np.roll(op7_language.letter(ord(b)), 1) * op7_language.letter(ord(c)) for a, b, c in (" ab", "ab "))
    assert np.allclose(v, raw / np.linalg.norm(raw), atol=1e-6)


def test_records_round_trip(spark, tmp_path):
    rows = corpus(10)
    op8_records.write_records(docs(spark, rows), str(tmp_path / "r"))
    got = op8_records.read_records(spark, str(tmp_path / "r"), with_ids=True).orderBy("start").collect()
    assert len(got) == len(rows)
    at, last = 0, -1
    for r in got:
        assert r["start"] == at and (r["key"] or -1) >= last
        at, last = at + r["n_tokens"], r["key"] or -1
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    assert sorted((r["key"] is not None, r["key"] or 0, r["ids"]) for r in got) == sorted((k is not None, k or 0, ids_of(t)) for k, t in rows)
    index = spark.read.parquet(str(tmp_path / "r" / "index"))
    some = op8_records.fetch(spark, str(tmp_path / "r"), index.where("key % 7 = 0")).collect()
    assert sorted((r["key"], r["ids"]) for r in some) == sorted((k, ids_of(t)) for k, t in rows if k is not None and k % 7 == 0)


def test_damaged_records_are_found():
    good = op8_records.frame(5, np.array([1, 70000], "<u4")) + op8_records.frame(None, np.array([1], "<u4"))
    assert [(k, v.tolist()) for _, _, k, v in op8_records.frames(good)] == [(5, [1, 70000]), (None, [1])]
    for at in (0, 9, 14, 30):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises((ValueError, Exception)):
            list(op8_records.frames(bytes(bad)))


def from_payload(text):
    return op9_audio.from_wave(op9_audio.to_wave(op9_audio.payload(text)[1]))


def test_audio(spark):
    rows = [(1, "hello world " * 200), (2, None), (3, ""), (4, "é" * 5000), (5, "hello world " * 200)]
    stored = op9_audio.media(docs(spark, rows))
    clips = op9_audio.features(stored)
    got = {x["doc_id"]: x for x in op9_audio.digests(clips).collect()}
    for k, t in rows:
        raw = (t or "").encode()
        data = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = got[k]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert got[1]["feature"] == got[5]["feature"] != got[4]["feature"]
    f = op9_audio.unpacked(clips).where("doc_id = 1").orderBy("part").collect()
    stream = clips.where("doc_id = 1").first()["tensors"]
    assert op9_audio.tensors_of(stream).schema.field("log_mel").type == op9_audio.TENSOR
    whole, spans, found = op9_audio.clip_features(from_payload(rows[0][1]))
    assert [x["log_mel"] for x in f] == whole.reshape(len(f), -1).tolist() and [[x["start_s"], x["end_s"]] for x in f] == spans.tolist()
    assert [y for x in f for y in x["segments"]] == found.tolist()
    assert all(len(x["log_mel"]) == op9_audio.TENSOR_FRAMES * op9_audio.MELS for x in f)
    assert f[0]["start_s"] == 0 and all(a["end_s"] == b["start_s"] for a, b in zip(f, f[1:]))


def test_polyphase_resampling_keeps_a_tone_and_drops_what_would_alias():
    t = np.arange(16000) / op9_audio.RATE
    low, high = (op9_audio.resample(np.sin(2 * np.pi * f * t).astype(np.float32))[200:-200] for f in (500, 7000))
    assert len(low) == 12000 - 400 and 0.65 < low.std() < 0.76 and high.std() < 0.05


@pytest.mark.parametrize("up, down", [(3, 4), (1, 2), (2, 3), (5, 3), (1, 1)])
def test_polyphase_resampling_is_filtering_between_zeros(up, down):
    x = np.random.default_rng(1).normal(size=101).astype(np.float32)
    h = op9_audio._phases(up, down).T.reshape(-1).astype(float)
    fine = np.zeros(len(x) * up)
    fine[::up] = x
    want = np.concatenate([np.convolve(fine, h), np.zeros(len(h))])[len(h) // 2 :][: len(fine)][::down]
    assert np.allclose(op9_audio.resample(x, up, down), want, atol=1e-4)


def test_hysteresis_keeps_a_segment_over_a_short_dip():
    mel = np.zeros((50, op9_audio.MELS), np.float32)
    mel[10:30] = 5
    mel[20] = mel.mean() + 0.2
    assert op9_audio.segments(mel) == [(10, 30)]


@pytest.mark.parametrize("seed", [11, 12])
def test_suffix_dedup_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = op10_suffixes.remove_repeats(docs(spark, rows)).collect()
    least = {}
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if k is not None:
                least[b[i : i + 50]] = min(k, least.get(b[i : i + 50], k))
    want = []
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if k is not None and least[b[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        want.append((k is not None, k or 0, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    have = [(r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in got]
    assert sorted(have) == sorted(want)
    assert any(w[3] for w in want)


def test_suffix_ranks_are_those_of_sorted_prefixes():
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(350)
    want = {s: i for i, s in enumerate(sorted({data[i : i + 50].tobytes() for i in starts}))}
    assert op10_suffixes.suffix_classes(data, starts).tolist() == [want[data[i : i + 50].tobytes()] for i in starts]


@pytest.mark.parametrize("letters, depth", [("ab", 50), ("abcd", 50), ("a", 50), ("abc", 12)])
def test_longest_previous_factors_against_brute_force(letters, depth):
    r = random.Random(len(letters))
    texts = ["".join(r.choice(letters) for _ in range(r.randint(depth, 150))) for _ in range(12)]
    texts += [t[r.randint(0, 30) :] + t for t in texts[:6]]
    data = "".join(texts).encode()
    ends = np.cumsum([len(t) for t in texts])
    starts = np.array([i for e, t in zip(ends, texts) for i in range(e - len(t), e - depth + 1)])
    key = np.array([r.randint(0, 8) for _ in texts])[np.searchsorted(ends, starts, "right")]
    same = lambda a, b: next((i for i in range(depth) if data[a + i] != data[b + i]), depth)
    want = [max((same(a, b) for b, y in zip(starts, key) if y < x), default=0) for a, x in zip(starts, key)]
    assert op10_suffixes.longest_previous_factor(np.frombuffer(data, np.uint8), starts, key, depth).tolist() == want


def test_a_phrase_in_many_contexts_is_dealt_by_window(spark, monkeypatch):
    r = random.Random(5)
    phrase = "in the middle of all this"
    rows = [(k, "".join(r.choice(string.ascii_letters) for _ in range(90)) + phrase + "".join(r.choice(string.ascii_letters) for _ in range(90))) for k in range(1500)]
    rows += [(2000 + k, rows[k][1][20:] + "x") for k in range(0, 1500, 100)]
    monkeypatch.setattr(op10_suffixes, "HOT", 200)
    df = docs(spark, rows)
    got = {x["doc_id"]: [tuple(s) for s in x["spans"]] for x in op10_suffixes.remove_repeats(df).collect()}
    assert all(got[k] == ([(0, len(t) - 1)] if k >= 2000 else []) for k, t in rows)
    blocks = op10_suffixes.pack(df).collect()
    hot = op10_suffixes.sieve(spark.createDataFrame(blocks), 6).where("hot <> X''").count()
    assert 0 < hot < 20


def test_near_dedup_keeps_different_texts_of_one_doc_id(spark, tmp_path):
    import corpus_pipeline as cp

    r = random.Random(2)
    a, b, c = (" ".join(word(r) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (1, b), (1, a), (2, b + " more"), (3, c), (None, c), (4, None), (4, "")]
    d = docs(spark, rows).selectExpr("doc_id", "text", "'en' lang", "'src0' source", "length(text) n_chars")
    got = sorted(((x["doc_id"], x["text"]) for x in cp.near_dedup(spark, d, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (3, c), (None, c), (4, None), (4, "")], key=repr)


def test_language_stage_rejects_letter_junk(spark):
    import corpus_pipeline as cp

    r = random.Random(8)
    syllables = {"aa": ["ka", "to", "mi", "ra"], "bb": ["schl", "ung", "ein", "ver"], "cc": ["eau", "ille", "ou", "so"]}
    text = lambda l: " ".join("".join(r.choice(syllables[l]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(30, 60)))
    junk = [(1000 + i, " ".join("".join(r.choice("qwxzjvpf") for _ in range(9)) for _ in range(60)), None) for i in range(20)]
    rows = [(i, text(l), l) for i in range(200) for l in [r.choice(list(syllables))]]
    d = spark.createDataFrame([(k, t, l, "s", len(t)) for k, t, l in rows + junk], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x["doc_id"] for x in cp.language(spark, d, "").collect()) == list(range(200))


def test_columns_named_like_results_give_way(spark):
    rows = spark.createDataFrame([(1, "a b\nc", "s", 9, 9, 9, 9, 9, 9)], "doc_id long, text string, source string, n_lines int, n_dropped int, shard int, slot int, items int, lang_pred int")
    assert op1_lines.drop_boilerplate(rows).first()["n_lines"] == 2
    assert op4_sharding.shuffle(rows).first()["slot"] == 0
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert op6_decontamination.decontaminate(rows, items, keep=rows.columns).first()["items"] == ["1"]
    assert op7_language.predict(rows, {}, keep=rows.columns).first()["lang_pred"] == "und"


def test_files_are_read_in_order_of_their_numbers(spark):
    names = ["part-100000-x.txt", "part-99999-x.txt", "part-00002-x.txt"]
    got = spark.createDataFrame([(n,) for n in names], "file string").orderBy(*op8_records.file_order("file")).collect()
    assert [r["file"] for r in got] == names[::-1]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rows = corpus(13)
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = [d.count()]
    for i, (name, stage) in enumerate(cp.STAGES):
        d = stage(spark, d, str(tmp_path))
        d.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        assert i == len(cp.STAGES) - 1 or d.columns == cp.COLUMNS
        sizes.append(d.count())
    assert sizes[1] == sizes[0] - 3  # without a letter: null, empty, blanks
    assert sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] < sizes[3]


def test_near_dedup_stage_takes_five_words(spark, tmp_path):
    import corpus_pipeline as cp

    r = random.Random(9)
    base = [f"{word(r)}{i}" for i in range(100)]
    edited = list(base)
    edited[30] = edited[60] = "changed"
    pair = [(1, " ".join(base)), (2, " ".join(edited))]  # 89 of 105 with four words, 86 of 106 with five
    far = list(base)
    far[30] = far[60] = "changed"
    far[99] = "end"
    far[0] = "start"
    apart = [(1, " ".join(base)), (3, " ".join(far))]  # 87 of 107 with four words, 84 of 108 with five
    d = lambda rows: docs(spark, rows).selectExpr("doc_id", "text", "'en' lang", "'src0' source", "length(text) n_chars")
    assert op3_near_duplicates.link(docs(spark, apart)).where("not kept").count() == 1
    assert sorted(x["doc_id"] for x in cp.near_dedup(spark, d(apart), str(tmp_path)).collect()) == [1, 3]
    assert [x["doc_id"] for x in cp.near_dedup(spark, d(pair), str(tmp_path)).collect()] == [1]


def test_the_end_of_a_clip_is_in_its_features():
    one = bytes(range(128, 160)) * 18  # 576 bytes: 432 resampled samples, 48 of them beyond the last whole frame
    two = one[:-24] + bytes(24)
    (a, _, _), (b, _, _) = op9_audio.clip_features(one), op9_audio.clip_features(two)
    assert (a != b).any()
    assert len(op9_audio.log_mel(np.ones(416, np.float32))) == 3 and len(op9_audio.log_mel(np.ones(384, np.float32))) == 2


def test_licenses_bare_reservation_and_wrapped_statements(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met"
    rows = [(1, "x y\nAll rights reserved.\nfoo bar"), (2, "foo bar\n" + bsd), (3, bsd.replace("without\n", "without\n\n")), (4, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (5, "plain words about nothing in particular")]
    got = sorted((r["doc_id"], r["paragraph"], r["family"]) for r in op2_licenses.scan(docs(spark, rows)).collect() if r["confirmed"])
    assert got == [(1, 1, "proprietary"), (2, 1, "bsd"), (4, 0, "mit"), (4, 1, "cc-by-nc")]
