import gzip
import hashlib
import random
import re
import struct
from base64 import b32encode
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_cases import frame, hard_rows

from provena.llm import decontamination, sentencepiece_codec, warc

ITEMS = [(0, "At dawn Anna buys 12 apples and 7 pears , then gives Ben 12 of them for 5 km of walking home"), (1, "the quick brown fox jumps over the lazy dog near quiet river banks every single morning"), (2, "too short"), (3, None), (4, "3 4 5 6 7 8 9 10 11 12 13 14 15 16 17"), (5, "take 5 red boxes then add 5 blue boxes then take 5 green boxes then add 5 more")]


def leaks(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}


def test_decontamination(spark):
    found = leaks(
        spark,
        "Some text. " + ITEMS[0][1] + " and so on",
        "He said at dawn Carla buys 30 apples and 9 pears, then gives Dora 30 of them for 8 mi of walking home",  # other slots, one to one
        "take 6 red boxes then add 7 blue boxes then take 8 green boxes then add 9 more",  # 5 stands for many values in every window
        "take 6 red boxes, then add 6 blue boxes, then take 6 green boxes, then add 6 more",
        "lead in. The QUICK brown fox jumps over the lazy dog near quiet river banks every single morning!",
        "the quick brown fox jumps under the lazy dog near quiet river",
        "too short",
        None,
        "",
        "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18",
        " ".join(["filler"] * 5000) + " " + ITEMS[1][1],
    )
    assert found - {(4, 1)} == {(0, 0), (1, 0), (3, 5), (10, 1)}


APPLES = "Anna has 5 red apples in her bag. Ben gives her 3 more apples today. Carla takes 2 of them away. Dora then eats 1 of the apples that are left over"


def hits(items, texts):
    """{(text, item): (windows, first word)}, with the tables joined by a dictionary."""
    table, shapes = {}, set()
    for g in decontamination.item_windows(items, decontamination.WINDOW, decontamination.SHORTEST, decontamination.PLAIN):
        shapes.add((g["width"], g["size"], g["exact"]))
        for i, key in enumerate(g["key"].tolist()):
            table.setdefault((key, g["size"], g["exact"]), []).append((int(g["text"][i]), int(g["start"][i]), g["payload"][i]))
    out = {}
    for g in decontamination.Filter(list(shapes), 16, {0: b"\xff" * (1 << 13)}).candidates(texts):
        for i, key in enumerate(g["key"].tolist()):
            for item, start, theirs in table.get((key, g["size"], g["exact"]), ()):
                if decontamination.consistent(g["payload"][i : i + 1], theirs[None], g["size"], g["exact"], decontamination.PLAIN)[0]:
                    out.setdefault((int(g["text"][i]), item), set()).add((int(g["first_word"][i]), int(g["at"][i]), start))
    return {k: (len({x[1:] for x in v}), min(x[0] for x in v)) for k, v in out.items()}


class index:
    """Items, with match() for the old shape of results: (text, item, windows, first word)."""

    def __init__(self, *items):
        self.items = list(items)

    def match(self, texts):
        return sorted((*k, *v) for k, v in hits(self.items, texts).items())


def test_names_that_open_sentences():
    renamed = APPLES
    for a, b in [("Anna", "Erik"), ("Ben", "Fay"), ("Carla", "Gus"), ("Dora", "Hal"), ("5", "8"), ("3", "4")]:
        renamed = renamed.replace(a, b)
    n = len(APPLES.split()) - 12
    one = index(APPLES)
    assert one.match([APPLES]) == [(0, 0, n, 0)] and one.match([renamed]) == [(0, 0, n, 0)]
    assert one.match(["It says " + renamed[0].lower() + renamed[1:]])  # no name at the start
    short = "Anna has 5 red apples in her bag. Ben gives her 3"
    assert index(short).match([short.replace("Ben", "Eve")]) and not index(short).match([short.replace("Ben", "Anna")])  # two names, not one
    assert index("At dawn Anna buys 12 apples . Ben gives them all to his old friend").match(["so at dawn Ida buys 9 apples . Joe gives them all to his old friend"])


def test_text_before_an_item_does_not_hide_it():
    for item in ("Name the river that runs through the old town near us", "In the year of the flood who was king over us", "Every single morning the quick brown fox jumps over two lazy dogs"):
        for before in ("", "Question ", "Question: ", "the end. "):
            assert index(item).match([before + item]), (before, item)


def test_many_openings():
    item = "\n".join("Alpha Beta gamma Delta epsilon Zeta eta Theta iota Kappa lambda Mu nu Xi omicron Pi rho".split())
    one = index(item)
    assert one.match([item]) and one.match([item.lower()]) and one.match([item.replace("Beta", "beta").replace("Mu", "Omega")])


def test_items_without_enough_plain_words():
    items = ["Who was the first president of France?", "Compute 12 3 45 6 78 9 10 11 12 13 14 15 16 and add 7", "Solve 1 2 3 and 4 5 6 or 7 8 9 then stop"]
    for item in [*items, "Ann Ben Cat Dan Eve Fay Gus Hal Ida Joe Kim Lea Max"]:
        one = index(item)
        assert one.match([item]) and one.match(["so " + item + " it says"]) and one.match([item.lower()]), item
        assert not one.match([item[:-2]]) or len(item.split()) > 13
    assert not index(items[0]).match(["Who was the last president of France?"])
    assert not index(items[1]).match([items[1].replace("45", "46").replace("78", "79").replace("10", "20").replace("14", "24")])  # exact only
    edge = "Add 1 2 3 4 5 6 7 and then stop right here"  # five plain words where 'Add' is a name
    assert index(edge).match(["so Add" + edge[3:]])
    late = "add 1 2 3 4 and 5 6 or 7 8 then stop here"  # 14 words, enough plain ones only in all of it
    assert index(late).match([late.replace("7", "77")])


def canonical(text):
    """(folded word, kind, opens) of each word that is not punctuation alone."""
    import string

    out, opens, last = [], True, None
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        if last is not None:
            opens = last[-1] in ".!?:" or "\n" in text[end : m.start()]
        last, end = m[0], m.end()
        word = m[0].strip(string.punctuation)
        folded = word.lower()
        number = word[:1] in tuple(string.digits)
        after = bool(out) and out[-1][1] == "number" and out[-1][3] == m.start()
        if not word:
            continue
        kind = "number" if number else "name" if word[0].isupper() and not opens else "unit" if folded in decontamination.UNITS or (folded in decontamination.SMALL_UNITS and after) else "plain"
        out.append((folded, kind, word[0].isupper() and opens and not number, m.end() + 1))
    return [x[:3] for x in out]


def leaks_brute(docs, items, window=13, shortest=8, plain=5):
    """The rules once more, window by window."""
    found = {}
    for i, item in enumerate(items):
        c = canonical(item)
        n = len(c)
        plains = lambda a, z: sum(k == "plain" for _, k, _ in c[a:z])  # noqa: E731, B023
        surely = lambda a, z: sum(k == "plain" and not o for _, k, o in c[a:z])  # noqa: E731, B023
        wanted = []
        for a in range(n - min(window, n) + 1 if n >= 3 else 0):
            size, told = min(window, n), False
            first = size
            while n >= shortest:
                if plains(a, a + size) >= plain:
                    wanted.append((a, size, False))
                    told |= surely(a, a + size) >= plain
                if surely(a, a + size) >= plain or a + size >= n or size >= 2 * window:
                    break
                size = min(size + 4, n - a)
            if not told and any(k != "number" for _, k, _ in c[a : a + first]):
                wanted.append((a, first, True))
        for d, doc in enumerate(docs):
            t = canonical(doc)
            for a, size, exact in wanted:
                for at in range(len(t) - size + 1):
                    mine, own = t[at : at + size], c[a : a + size]
                    if exact:
                        good = [x[0] for x in mine] == [x[0] for x in own]
                    else:
                        good = any(agree(mine, own, names, plain) for names in (False, True))
                    if good:
                        found.setdefault((d, i), set()).add((at, a))
    return {k: len(v) for k, v in found.items()}


def agree(mine, own, names, plain):
    there, back, count = {}, {}, 0
    for (x, k, o), (y, j, p) in zip(mine, own):
        k = "name" if o and names else k
        j = "name" if p and k == "name" else j
        if k != j or (k == "plain" and x != y):
            return False
        count += k == "plain"
        if k != "plain" and (there.setdefault((k, x), y) != y or back.setdefault((k, y), x) != x):
            return False
    return count >= plain


def planted(rng, n_items, n_docs):
    plain = "take give box apple river walk then over under every small old town near moon light stone bread in m second".split()
    names, units = "Anna Ben Carla Dora Émile Žofie Фёдор".split(), "km kg dollars hours m in".split()

    def word():
        kind = rng.random()
        return str(rng.randrange(12)) + rng.choice(["", ",", " " + rng.choice(units)]) if kind < 0.2 else rng.choice(names) if kind < 0.35 else rng.choice(plain) + rng.choice(["", "", "", "", ".", ",", "?"])

    def say(n):
        words = [word() for _ in range(n)]
        return " ".join(w.capitalize() if i == 0 or words[i - 1][-1] in ".?" else w for i, w in enumerate(words))

    items = [say(rng.randrange(1, 30)) for _ in range(n_items)]
    swap = dict(zip(names, rng.sample(names, len(names)))) | {str(i): str(i + 20) for i in range(12)}
    docs = []
    for _ in range(n_docs):
        item = rng.choice(items)
        how = rng.randrange(5)
        if how == 1:  # other numbers and names
            item = " ".join(swap.get(w, w) for w in item.split(" "))
        elif how == 2:  # other line breaks
            item = "".join(rng.choice([" ", " ", "\n"]) if x == " " else x for x in item)
        elif how == 3:  # after a word
            item = item[:1].lower() + item[1:]
        docs.append(say(rng.randrange(0, 12)) + rng.choice(["", " ", ": ", "\n"]) + item + " " + say(rng.randrange(0, 9)))
    return items, docs


@pytest.mark.parametrize("seed", range(4))
def test_decontamination_against_brute_force(seed):
    items, docs = planted(random.Random(seed), 14, 30)
    assert {k: v[0] for k, v in hits(items, docs).items()} == leaks_brute(docs, items)


def test_verbatim_and_changed_copies_are_found():
    item = "Weng earns 12 dollars an hour for babysitting every day"
    texts = ["so " + item, "Q3) " + item, item.replace("Weng", "Peter").replace("12", "18"), item.replace(" an ", "\nan "), "It says: " + item + ".", item.replace("day", "week")]
    assert {t for t, _ in hits([item], texts)} == {0, 1, 2, 3, 4, 5}
    assert not hits([item], [item.replace("babysitting", "cleaning"), "Weng earns 12 dollars"])
    assert hits(["What is 12 + 30 ?"], ["Q: what is 12 + 30?"]) and not hits(["What is 12 + 30 ?"], ["what is 12 + 31"])


def test_decontamination_query_on_hard_rows(spark):
    items, texts = planted(random.Random(9), 12, 25)
    rows = [*hard_rows(), *((100 + i, t) for i, t in enumerate(texts)), (100, texts[0]), (None, texts[1])]
    docs = frame(spark, rows).withColumnRenamed("h", "item_id").withColumnRenamed("k1", "row").withColumnRenamed("score", "kept").withColumnRenamed("lang", "key")
    again = "".join(str((int(x) + 1) % 10) if x.isdigit() else x for x in ITEMS[0][1])
    bench = [*enumerate(items), (50, ITEMS[0][1]), (51, ITEMS[0][1]), (52, again), (53, None), (None, "")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in bench], "item_id long, text string, class int")
    classes = {r.item_id: r.class_id for r in decontamination.item_classes(bench).collect()}
    assert classes[51] == classes[50] == 50
    got = decontamination.contaminated(docs, bench, keep=("doc_id", "item_id", "row"))
    assert got.columns == ["doc_id", "item_id", "row", "item_id", "n_items", "n_windows", "first_word"]
    got = Counter((r[0], r[3], r[5]) for r in got.collect())
    want = leaks_brute([t or "" for _, t in rows], items)
    want = Counter((rows[d][0], classes[i], n) for (d, i), n in want.items() if classes[i] == i)
    assert got == want
    assert decontamination.contaminated(docs, bench.filter("false")).count() == 0
    assert decontamination.contaminated(docs.filter("false"), bench).count() == 0



def piece(text, score, kind):
    raw = text.encode()
    return b"\x0a" + bytes([len(raw)]) + raw + b"\x15" + struct.pack("<f", score) + (b"\x18" + bytes([kind]) if kind != 1 else b"")


def unigram_model(squeeze=0):
    """A small unigram model file, made by hand."""
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{i:02X}>", 0, 6) for i in range(256)]
    pieces += [("▁", -2, 1), ("▁▁", -3, 1), ("a", -3, 1), ("b", -3.5, 1), ("▁a", -2.5, 1), ("ab", -2.7, 1), ("▁ab", -2.2, 1), ("ba", -4, 1), ("aba", -3.9, 1), ("é", -5, 1)]
    body = b"".join(b"\x0a" + bytes([len(p)]) + p for p in (piece(*x) for x in pieces))
    trainer = b"\x18\x01\x98\x02\x01"  # unigram, byte fallback
    normalizer = b"\x0a\x08identity\x12\x00\x18\x01\x20" + bytes([squeeze]) + b"\x28\x01"
    return body + b"\x12" + bytes([len(trainer)]) + trainer + b"\x1a" + bytes([len(normalizer)]) + normalizer


TEXTS = ["", " ", "a", "abab aba  ab é", " a  b ", "<s> x </s>", "<unk>", "\n\n  tab\tx", "é́ 𝔘 \0 日本語", " " * 70 + "x", "a" * 300, "ЖЩ 123 4,5", "▁x ▁", "<0x41>"]


@pytest.mark.parametrize("data", [None, unigram_model(), unigram_model(1)], ids=["bpe", "unigram", "unigram-squeezed"])
def test_codec_parity(data):
    if data is None:
        with open(sentencepiece_codec.default_path(), "rb") as f:
            data = f.read()
    codec = sentencepiece_codec.Codec(data)
    ids, bounds, same, back = codec.encode([*TEXTS, None])
    for i, t in enumerate([*TEXTS, ""]):
        own = ids[bounds[i] : bounds[i + 1]]
        assert own.tolist() == codec.original.encode(t)
        if codec.spec.kind == sentencepiece_codec.BPE:
            assert own.tolist() == codec.whole.encode(t, add_special_tokens=False).ids
        assert codec.decode(own) == codec.original.decode(own.tolist())
        assert back[i] == (codec.decode(own) == t)
    assert same.all()


def test_codec_table(spark):
    rows = hard_rows()
    out = sentencepiece_codec.encode(frame(spark, rows))
    got = out.collect()
    assert len(got) == len(rows) and all(r.parity and r.round_trip for r in got)
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)
    texts = sorted((str(r.doc_id), r.text) for r in sentencepiece_codec.decode(out).collect())
    assert texts == sorted((str(i), t or "") for i, t in rows)
    assert sentencepiece_codec.encode(frame(spark, rows).filter("false")).count() == 0


def pages(spark):
    rows = [(i, f"http://x/{i}", h) for i, h in [(5, "same"), (3, "same"), (9, "same"), (1, None), (2, ""), (4, "é" * 5000), (6, "<p>\r\n\r\nWARC/1.1\r\n"), (7, "x" * 100000), (7, "x" * 100000)]]
    rows += [(8, None, "no address"), (None, "http://x/n", "same")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", 1 << 63), i if i is not None else 1 << 63)
    want = []
    for i, _, h in rows:
        raw, f = (h or "").encode(), first[h or ""]
        want.append((i, len(raw), b32encode(hashlib.sha1(raw).digest()).decode(), *(("response", None) if i == f else ("revisit", f))))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.filter("false")).count() == 0


def test_warc_files_and_pushdown(spark, tmp_path, monkeypatch):
    _, df = pages(spark)
    warc.register(spark)
    warc.archive(df, str(tmp_path / "w"))
    names = list((tmp_path / "w").glob("*.warc.gz"))
    plain = b"".join(gzip.open(n).read() for n in names)  # any gzip reader can read them
    assert plain.count(b"WARC/1.1\r\nWARC-Type: response") == 7
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(plain)
    (tmp_path / "gz").mkdir()
    (tmp_path / "gz" / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in [plain]))
    read = lambda path, **o: spark.read.format("warc").options(**o).load(str(path))
    full = sorted(map(str, read(tmp_path / "w").collect()))
    assert sorted(map(str, read(tmp_path / "plain").collect())) == full
    some = read(tmp_path / "w", payload="false").filter("record_type = 'revisit' and target_uri like 'http://x/%'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan warc" in plan and "Filter (" not in plan
    kept = some.filter("payload_bytes > 3")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (isnotnull(payload_bytes" in kept and "record_type" not in kept.split("Filter", 1)[1].split("BatchScan")[0]
    assert {r.record_id for r in some.collect()} == {"urn:page:5", "urn:page:9", f"urn:page:{(1 << 63) - 1}", "urn:page:2"}
    assert {r.payload for r in read(tmp_path / "w", payload="false").collect()} == {None}
    reader = warc.WarcReader({"path": str(tmp_path / "w"), "payload": "true"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 1)]))
    assert len(left) == 1
    decoded = []
    monkeypatch.setattr(warc._Member, "take", lambda self, n, own=warc._Member.take: (decoded.append(n), own(self, n))[1])
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 4
    assert not decoded  # revisits have no payload, and responses were left out by their headers


def test_warc_appends(spark, tmp_path):
    warc.register(spark)
    path = str(tmp_path / "w")
    for rows in ([(1, "u", "a")], [(2, "u", "b"), (3, "u", "b")]):
        warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    assert sorted(r.record_id for r in spark.read.format("warc").load(path).collect()) == ["urn:page:1", "urn:page:2", "urn:page:3"]


def test_warc_odd_records(tmp_path):
    """No end of HTTP headers, repeated and differently cased headers, a record after them."""
    http = b"HTTP/1.1 200 OK\r\nno end of headers"
    first = b"WARC/1.1\r\nwarc-type: response\r\nWARC-Record-ID: <a>\r\nX: 1\r\nX: 2\r\nContent-Type: application/http\r\nCONTENT-LENGTH: %d\r\n\r\n%b\r\n\r\n" % (len(http), http)
    second = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <b>\r\nContent-Type: text/plain\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    for name, raw in (("a.warc", first + second), ("b.warc.gz", gzip.compress(first) + gzip.compress(second)), ("c.warc.gz", warc.gzip_member(first) + warc.gzip_member(second))):
        (tmp_path / name).write_bytes(raw)
        rows = list(warc.WarcReader({"path": str(tmp_path / name)}).records(str(tmp_path / name)))
        assert [(r["record_id"], r["record_type"], r["payload"], r["payload_bytes"]) for r in rows] == [("a", "response", http, len(http)), ("b", "response", b"hi", 2)]
        assert dict(rows[0]["headers"])["X"] == "1, 2"



def test_base32(spark):
    texts = ["", "a", "日本"] + [str(i) for i in range(20)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.base32(F.sha1("t")).alias("b")).collect()
    assert all(r.b == b32encode(hashlib.sha1(r.t.encode()).digest()).decode() for r in got)


def test_units_are_sorted():
    assert (np.diff(decontamination.UNIT_HASHES.astype(float)) >= 0).all()
