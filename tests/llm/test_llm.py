"""Small tables with nulls, empty and long texts, ties, repeats and clashing columns, against brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import components, kneserney, langid, licenses, linededup, media, mixing, neardup, pieces, quality, queries, warc

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, score string"
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def rows():
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base = text(200).split()
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "One"), (4, "one"), (5, "ça va été là"), (6, "12 34 !!"), (7, text(30_000))]
    out += [(10 + i, " ".join(base[:k] + ["x"] * (i % 7) + base[k:])) for i, k in enumerate(r.sample(range(200), 40))]
    out += [(60 + i, text(r.randint(1, 90)) + "\nThis line is shared by many documents\n" + text(9)) for i in range(40)]
    out += [(100 + i, out[20][1]) for i in range(5)] + [(110, "Released under the MIT License."), (60, "other text of an id that is there already")]
    return [(i, t, "en" if i % 2 else "fr", [None, "a", "b", "hot"][min(i % 9, 3)], 5, "s") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(docs, empty):
    sets = defaultdict(set)
    texts = []
    for i, t, *_ in rows():
        w = words((t or "").translate(FOLD))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        texts.append((i, s))
        sets[i] |= {frozenset(s)}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in texts:
        for j, b in texts:
            if j < i and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.n_shingles) for r in got) == sorted((i, len(s)) for i, s in texts)
    assert {r.doc_id: r.component_id for r in got if r.doc_id != 60} == {i: find(i) for i in sets if i != 60}
    assert neardup.near_duplicates(empty).count() == 0


def near_groups():
    """Texts around the threshold: a base with few or many words changed, in lists that stay mixed after the star step."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    out = []
    for i in range(90):
        t = list(base)
        for at in r.sample(range(120), r.choice([1, 2, 3, 4, 5, 6])):
            t[at] = f"x{r.randrange(8)}"
        out.append((1000 + i, " ".join(t[: r.choice([120, 118, 110])])))
    long = [f"v{i}" for i in range(900)]
    for i in range(30):
        t = list(long)
        for at in r.sample(range(900), r.choice([5, 15, 20, 25, 30])):
            t[at] = f"y{i}"
        out.append((2000 + i, " ".join(t)))
    return out


def components_by_hand(texts, percent):
    sets = {}
    for i, t in texts:
        w = words((t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    held = defaultdict(set)
    for i in sorted(sets):
        near = Counter(j for s in sets[i] for j in held[s])
        for j, n in near.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
        for s in sets[i]:
            held[s].add(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_in_long_mixed_lists(spark, percent, monkeypatch):
    monkeypatch.setattr(neardup, "_SHORT", 3)
    monkeypatch.setattr(neardup, "_BLOCK", 16)
    monkeypatch.setattr(neardup, "_WIDE", 128)
    monkeypatch.setattr(neardup, "_HUB", 10)
    monkeypatch.setattr(components, "ONE_TASK", 0 if percent == 80 else components.ONE_TASK)
    rows_ = near_groups()
    got = neardup.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string").repartition(4), percent=percent).collect()
    want = components_by_hand(rows_, percent)
    assert 5 < len({c for _, c in want.values()}) < len(want) - 5
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_registered_near_dedup_equals_brute_force(spark):
    """The query's own 85 % on whole documents; recall of links is 1."""
    sf = "/root/testdata/sf0.01"
    docs_ = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = components_by_hand([(r.doc_id, r.text) for r in docs_], 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.queries()["op2_minhash_near_dedup"](spark, sf).collect()} == want


def test_line_dedup(docs, empty):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    held = defaultdict(set)
    for i, t, *_ in rows():
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    gone = lambda i, x: len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != i
    want = sorted((i, "\n".join(x for x in (t or "").split("\n") if not gone(i, x))) for i, t, *_ in rows())
    out = linededup.dedup_lines(docs)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == want
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    full = linededup.dedup_lines(docs, most_bits=1 << 10)  # filters that let nearly all lines through
    assert sorted((r.doc_id, r.text) for r in full.collect()) == want
    assert linededup.dedup_lines(empty).count() == 0


def test_mixing(docs, empty):
    plan = mixing.schedule(docs, "doc_id", "source", "text").collect()
    taken, size, target = Counter(), Counter(), {}
    for r in plan:
        taken[r.source] += r.copies * r.size
        size[r.source] += r.size
        target[r.source] = r.target
        assert r.copies <= 2
    total = sum(size.values())
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 and all(target[s] <= 2 * size[s] for s in size)
    largest = max(len(words(t)) for _, t, *_ in rows())
    assert sum(taken.values()) <= 1.5 * total and all(abs(taken[s] - target[s]) <= 2 * largest for s in size)
    assert mixing.mix(docs).count() == sum(r.copies for r in plan)
    assert sorted(map(str, plan)) == sorted(map(str, mixing.schedule(docs, "doc_id", "source", "text").collect()))
    assert mixing.mix(empty).count() == 0


def test_quality(spark, docs, empty):
    policy = spark.conf.get("spark.sql.mapKeyDedupPolicy")
    found = quality.quality(docs.withColumn("__a", F.lit(1)).withColumn("kept", F.lit("mine")))
    assert found.count() == len(rows()) and found.schema["kept"].dataType.typeName() == "boolean"
    assert spark.conf.get("spark.sql.mapKeyDedupPolicy") == policy
    assert {tuple(r)[1:] for r in found.where("doc_id < 3").select("doc_id", "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()} == {(0, 0, 0, 0, True, False)}
    for r in found.collect():
        text = next(t for i, t, *_ in rows() if i == r.doc_id and len(words(t)) == r.n_words)
        w = words(text)
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        assert r.n_repeat_words == len({i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)})
        assert r.word_chars == sum(map(len, w)) and r.base_failed == (len(w) < 50 or 2 * r.n_repeat_words > len(w))
    assert quality.quality(empty).count() == 0


def test_pieces(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = pieces.read_model(MODEL)
    out = pieces.decode(pieces.encode(docs, model), model)
    for r in out.collect():
        assert r.ids == sp.encode(r.text or "") and r.decoded == (r.text or "")
    fused = pieces.round_trip(docs.withColumn("Decoded", F.lit(1)), model, keep=["doc_id", "Decoded"])
    assert fused.columns == ["doc_id", "ids", "decoded"]
    key = lambda r: (r.doc_id, r.ids, r.decoded)
    assert sorted(map(key, fused.collect())) == sorted(map(key, out.collect()))
    assert pieces.encode(empty, model).count() == 0 and pieces.round_trip(empty, model).count() == 0
    lists = docs.sparkSession.createDataFrame([(0, None), (1, []), (2, [None, -1, 10**6, 1, 2]), (3, sp.encode("a ▁ b")), (4, [sp.piece_to_id("<0xE2>")])], "n int, ids array<int>")
    assert [r.decoded for r in pieces.decode(lists, model).orderBy("n").collect()] == ["", "", "", "a   b", "\ufffd"]
    r = random.Random(3)
    v = pieces.Vocabulary(model)
    odd = ["▁▁a", " " * 50 + "x", "a" * 5000, *("".join(r.choice("abetx ▁é\n🤷日\0") for _ in range(r.randint(1, 60))) for _ in range(500))]
    import numpy as np

    assert [np.frombuffer(x, np.int32).tolist() for x in v.encode(odd)[0]] == sp.encode(odd)


def test_pieces_with_full_tables(monkeypatch):
    import numpy as np
    import sentencepiece

    monkeypatch.setattr(pieces, "_MOST_CUTS", 8)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    v = pieces.Vocabulary(pieces.read_model(MODEL))
    first = " ".join(f"a{i}" for i in range(12))
    for text in (first, "b1 " + " ".join(f"id{i}" for i in range(30)) + " a11 a1", first, ""):
        assert [np.frombuffer(x, np.int32).tolist() for x in v.encode([text])[0]] == [sp.encode(text)]
    assert len(v.cuts) <= 8 + 12


def test_pieces_cut_wherever_no_piece_reaches():
    import numpy as np
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    v = pieces.Vocabulary(pieces.read_model(MODEL))
    numbers = [f"k{i}={i * 7919};" for i in range(3000)]
    assert [np.frombuffer(x, np.int32).tolist() for x in v.encode(numbers)[0]] == sp.encode(numbers)
    assert len(v.cuts) < 100  # not one for each number
    for text in ("x", " ", "12345", "é\n"):  # blocks shorter than the longest piece
        assert [np.frombuffer(x, np.int32).tolist() for x in pieces.Vocabulary(pieces.read_model(MODEL)).encode([text])[0]] == [sp.encode(text)]
    r = random.Random(5)
    letters = ["0123456789.,;:-_=/()[]{}<>\t\r\n ▁", "éèßñäe ▁ns", "日本語한국русскийह🤷\0", "".join(map(chr, range(1, 128)))]
    odd = ["", " ", "▁", "\n \n", *("".join(r.choice(r.choice(letters)) for _ in range(r.randint(1, 80))) for _ in range(1000)), *("".join(r.choices(x, k=99)) for x in letters for _ in range(200))]
    ids, sizes = v.encode(odd)
    assert [np.frombuffer(x, np.int32).tolist() for x in ids] == sp.encode(odd)
    assert v.decode(np.frombuffer(b"".join(ids), np.int32), np.cumsum([0, *sizes])) == [x.replace("▁", " ") for x in odd]
    mixed = np.array([r.choice([r.randrange(-2, len(v.raw) + 2), r.choice(v.bytes)]) for _ in range(4000)])  # characters broken off
    for text, i in zip(v.decode(mixed, np.arange(0, 4001, 8)), range(0, 4000, 8), strict=True):
        plain = b"".join(v.raw[k] for k in mixed[i : i + 8] if 0 <= k < len(v.raw)).decode("utf-8", "replace").replace("▁", " ")
        assert text == plain.removeprefix(" ")


def test_media(docs):
    out = media.features(media.store(docs)).collect()
    by = defaultdict(set)
    for r in out:
        raw = (r.text or "").encode()
        assert r.payload[: r.n_bytes] == raw and len(r.payload) % 576 == 0 and len(r.payload) > 0 and set(r.payload[r.n_bytes :]) <= {255}
        assert r.tail_crc32 == zlib.crc32(r.payload[-32:]) and r.times == sorted(r.times) and len(r.times) == len(r.codes) > 0
        by[r.text].add(tuple(r.codes))
    assert all(len(x) == 1 for x in by.values())


def test_warc_round_trip_and_salvage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, "http://x/\r\n", None), (4, "u", "ü" * 50_000), (5, None, "")], "page_id long, url string, html string")
    files = warc.write(pages, folder=f"file://{tmp_path}/w", file_bytes=1 << 20)
    records, gaps = warc.read(files)
    got = {r.page_id: r for r in records.collect()}
    assert {i: (r.record_type, r.refers_to, r.payload_bytes) for i, r in got.items()} == {1: ("revisit", 2, 4), 2: ("response", None, 4), 3: ("revisit", 5, 0), 4: ("response", None, 100_000), 5: ("response", None, 0)}
    assert gaps.count() == 0
    made = [warc.record(i, "u", bytes([i]) * 500, None) for i in range(5)]
    hurt = made[0] + made[1][:40] + b"junk" + made[1][44:] + b"noise" + made[2] + made[3][:-20] + made[4]
    parts = list(warc.salvage(hurt))
    assert [warc._number(p[2]["warc-record-id"]) for p in parts if p[0] == "record"] == [0, 2, 4]
    assert [p[1:3] for p in parts if p[0] == "gap"] == [(len(made[0]), len(made[1]) + 5), (len(hurt) - len(made[4]) - len(made[3]) + 20, len(made[3]) - 20)]
    plain = [zlib.decompress(x, 31) for x in made]
    parts = list(warc.salvage(plain[0] + plain[1][:-30] + plain[2]))
    assert [warc._number(p[2]["warc-record-id"]) for p in parts if p[0] == "record"] == [0, 2]
    assert list(warc.salvage(b"")) == []


def test_warc_reads_damaged_files_as_streams(spark, tmp_path, monkeypatch):
    made = [warc.record(i, "u" * (1 << 20 if i == 3 else 9), random.Random(i).randbytes(3000).hex().encode(), None) for i in range(40)]
    hurt = bytearray(b"".join(made))
    begins = [sum(map(len, made[:i])) for i in range(41)]
    for i in (0, 7, 8, 39):
        hurt[begins[i] + len(made[i]) // 2] ^= 255
    (tmp_path / "d.warc.gz").write_bytes(hurt)
    files = spark.createDataFrame([(f"file://{tmp_path}/d.warc.gz", 0)], "path string, records int")
    records, gaps = warc.read(files)
    assert sorted(r.page_id for r in records.collect()) == [i for i in range(40) if i not in (0, 7, 8, 39)]
    assert sorted((g.offset, g.length) for g in gaps.collect()) == [(0, begins[1]), (begins[7], begins[9] - begins[7]), (begins[39], len(made[39]))]
    whole = list(warc.salvage(bytes(hurt)))
    monkeypatch.setattr(warc, "_WINDOW", 1000)
    assert list(warc.salvage(bytes(hurt))) == whole


def test_warc_of_repeated_ids_clashes_and_nothing(spark, tmp_path):
    rows_ = [(7, "u", "a", 1), (7, "u", "a", 2), (None, None, "a", 3), (3, "v", "a", 4), (9, "w", None, 5)]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string, payload int")
    records, gaps = warc.read(warc.write(pages, folder=f"file://{tmp_path}/a"))
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in records.collect()), key=str)
    assert got == sorted([(7, "response", None), (7, "response", None), (None, "response", None), (3, "revisit", 7), (9, "response", None)], key=str)
    records, gaps = warc.read(warc.write(pages.limit(0), folder=f"file://{tmp_path}/b"))
    assert records.count() == 0 and gaps.count() == 0


def test_warc_salvages_mixed_archives(spark, tmp_path):
    made = [warc.record(i, "u", bytes([65 + i]) * 500, None) for i in range(5)]
    plain = [zlib.decompress(x, 31) for x in made]
    found = lambda parts: [warc._number(p[2]["warc-record-id"]) for p in parts if p[0] == "record"]
    gaps = lambda parts: [p[1:3] for p in parts if p[0] == "gap"]
    parts = list(warc.salvage(b"XARC" + plain[0][4:] + plain[1] + plain[2]))
    assert found(parts) == [1, 2] and gaps(parts) == [(0, len(plain[0]))]
    parts = list(warc.salvage(made[0] + made[1][:-20] + plain[2] + made[3] + plain[4]))
    assert found(parts) == [0, 2, 3, 4] and gaps(parts) == [(len(made[0]), len(made[1]) - 20)]
    pack = lambda x: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(x) + z.flush()
    several = pack(plain[0] + plain[1][:-9] + plain[2])
    parts = list(warc.salvage(several + made[3]))
    assert found(parts) == [0, 2, 3] and gaps(parts) == [(0, len(several))]
    assert found(warc.salvage(pack(b"".join(plain)))) == [0, 1, 2, 3, 4]
    url = "http://x/" + "a" * 100_000
    pages = spark.createDataFrame([(1, url, "page")], "page_id long, url string, html string")
    records, lost = warc.read(warc.write(pages, folder=f"file://{tmp_path}/w"))
    assert [(r.page_id, r.url, bytes(r.payload)) for r in records.collect()] == [(1, url, b"page")] and lost.count() == 0
    assert found(warc.salvage(zlib.decompress(warc.record(7, url, b"page", None), 31))) == [7]


def test_language_model(docs, empty):
    model = kneserney.train(docs)
    assert model.tokens == sum(len(words(t)) + 1 for _, t, *_ in rows())
    out = kneserney.score(docs, model).collect()
    assert len(out) == len(rows()) and all(r.score < 0 and r.base_score < 0 and r.n_known == r.n_tokens for r in out)
    assert sum(r.score for r in out if r.doc_id >= 10) > sum(r.base_score for r in out if r.doc_id >= 10)
    nothing = kneserney.train(empty)
    assert nothing.tokens == 0 and {r.score for r in kneserney.score(docs.where("doc_id < 3"), nothing).collect()} == {0.0}


def test_language_id(spark, docs, empty):
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(empty)).collect()} == {"und"}
    train = spark.createDataFrame([(i, t, lang) for i in range(30) for t, lang in ((f"the house of the {i} and that was in the town", "en"), (f"das haus und der garten ist nicht {i} in der stadt", "de"))], "doc_id long, text string, lang string")
    model = langid.learn(train)
    asked = spark.createDataFrame([(1, "the garden and the house"), (2, "der garten und das haus"), (3, None), (4, ""), (5, "123 !?"), (6, "the town of " * 400_000)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(asked, model).collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "en"}


def test_language_id_rejects_what_it_did_not_learn(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.learn(docs.where("doc_id % 5 <> 0"))
    r = random.Random(5)
    unlearned = {
        1: "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью. " * 3,
        2: "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待" * 4,
        3: "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。" * 4,
        4: "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler. " * 3,
        5: "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki. " * 3,
        6: " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(60)),
        7: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(600)),
    }
    asked = spark.createDataFrame(list(unlearned.items()), "doc_id long, text string")
    assert {x.doc_id for x in langid.identify(asked, model).collect() if not x.rejected} == set()
    held = langid.identify(docs.where("doc_id % 5 = 0 AND length(text) > 0"), model).collect()
    assert sum(x.rejected for x in held) <= len(held) // 50
    short = [(i, x.text[:n]) for n in (12, 25, 50) for i, x in enumerate(held)]
    got = langid.identify(spark.createDataFrame(short, "doc_id long, text string"), model).collect()
    assert sum(x.rejected for x in got) <= len(got) // 30


def test_licenses(spark):
    f = spark.createDataFrame(
        [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "code"), (3, "a/b/y.py", "x\nLicensed under CC BY-NC 4.0.\n"), (4, "z.py", None), (5, None, ""), (6, "q/COPYING", "the text of the thing")], "id long, path string, text string"
    )
    got = {r.id: (r.own_license, r.license, r.inherited_from) for r in licenses.scan(f).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: (None, "MIT", "a"), 3: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 4: (None, None, None), 5: (None, None, None), 6: (None, None, None)}
    assert licenses.scan(f.limit(0)).count() == 0


def test_licenses_in_wrapped_headers_and_whole_files(spark):
    from pathlib import Path

    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {}General Public License as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version."
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    isc = "// Permission to use, copy, modify, and distribute this software for any\n// purpose with or without fee is hereby granted, provided that"
    line = "This project is released under the MIT License; see the LICENSE file in the root directory for the full text of it."
    text = lambda name: (Path(licenses.__file__).parent / "licence_texts" / f"{name}.txt").read_text()
    cases = [("a.py", gpl.format("", 3), "GPL-3.0"), ("b.py", gpl.format("", 2), "GPL-2.0"), ("c.py", gpl.format("Affero ", 3), "AGPL-3.0"), ("d.py", gpl.format("", 1), None)]
    cases += [("e.c", bsd, "BSD-3-Clause"), ("f.c", isc, "ISC"), ("g.md", line, "MIT"), ("h.md", "MIT License\n\nCopyright (c) 2020 A", "MIT")]
    cases += [("i", "Released under the BSD License.", None), ("j", "Released under the XYZ License.", None), ("k", "Licensed under CC BY-ND 4.0", None), ("l", "Licensed under CC BY-NC-SA 4.0", None)]
    cases += [(f"{name}/LICENSE", text(name), name) for name in ("Apache-2.0", "BSD-3-Clause", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")] + [("m/COPYING", licenses._MIT, "MIT")]
    cases += [("n", "The MIT press printed the licence for the house. " * 9, None), ("n", line, "MIT"), ("n", line, "MIT")]
    f = spark.createDataFrame([(i, "top/" + p, t) for i, (p, t, _) in enumerate(cases)], "id long, path string, text string").repartition(3)
    got = {r.id: r.own_license for r in licenses.scan(f).collect()}
    assert got == {i: name for i, (_, _, name) in enumerate(cases)}


def mixed_by_hand(docs):
    """How often each (doc_id, source, size) is taken: exact water filling and the queue, item by item."""
    size = Counter()
    for _, s, n in docs:
        size[s] += n
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(size.values()), set(names), {}
    while True:
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * size[s]
        left, open_ = left - sum(target[s] for s in over), open_ - over
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    items, so_far = [], Counter()
    for i, s, n in sorted(docs, key=lambda d: hashlib.md5(str(d[0]).encode()).hexdigest()):
        so_far[s] += n
        if n:
            items += [((so_far[s] + k * size[s]) / target[s], n, i) for k in (0, 1)]
    taken, used = Counter(), 0
    for _, n, i in sorted(items):
        used += n
        if used > 1.5 * sum(size.values()):
            break
        taken[i] += 1
    return taken


def test_pipeline_equals_brute_force(spark):
    """Languages are the operator's own (tested for themselves); all later stages are recomputed without Spark."""
    import sentencepiece

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs_ = {r.doc_id: r for r in langid.identify(table, langid.learn(table)).where("NOT rejected").collect()}
    held = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    for i, r in docs_.items():
        for x in r.text.split("\n"):
            held[key(x)].add(i)
    gone = lambda i, x: len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != i
    text = {i: "\n".join(x for x in r.text.split("\n") if not gone(i, x)) for i, r in docs_.items()}
    groups = components_by_hand(list(text.items()), 80)
    kept = [i for i in text if groups[i][1] == i]
    taken = mixed_by_hand([(i, docs_[i].source, len(words(text[i]))) for i in kept])
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in out) == +taken and len(taken) > 50
    for r in out:
        assert (r.text, r.lang, r.source, r.n_chars) == (text[r.doc_id], docs_[r.doc_id].lang_pred, docs_[r.doc_id].source, len(text[r.doc_id]))
        assert r.ids == sp.encode(r.text) and r.n_ids == len(r.ids) and r.round_trip
