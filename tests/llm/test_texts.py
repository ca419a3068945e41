import random

import numpy as np
import pytest

from kinweave.llm import recompress
from kinweave.llm.canonical import Canon, edit_distances, map_to_canon
from kinweave.llm.mixing import mix_sources, permuted, quotas
from kinweave.llm.packing import pack_texts
from kinweave.llm.spans import joined_points, shared_spans
from kinweave.llm.terms import term_frequencies
from kinweave.llm.tokens import encoder


def test_terms(spark, rows):
    data = [(1, "Jón  Jónsson,JÓN", "x"), (1, "Jón", "x"), (2, "NaN", "x"), (3, None, "x"), (4, "", "x"), (5, " jón,\t,Ö", "x"), (None, "jón", "x"), (6, "nan", "x"), (7, "a" * 100_000, "x")]
    df = spark.createDataFrame(data, "id long, nafn string, term string")
    got = {r["term"]: (r["n_occur"], r["n_records"], r["mark"]) for r in term_frequencies(df, ["nafn"]).collect()}
    assert got == {"jón": (5, 2, "rare"), "jónsson": (1, 1, "rare"), "ö": (1, 1, "rare"), "nan": (1, 1, "rare"), "a" * 100_000: (1, 1, "rare")}
    many = spark.createDataFrame([(i, "gamli" if i < 5 else f"n{i % 40} oft") for i in range(400)], "id long, nafn string")
    marks = {r["term"]: r["mark"] for r in term_frequencies(many, ["nafn"]).collect()}
    assert marks["gamli"] == "common" and marks["oft"] == "common" and term_frequencies(many, ["nafn"]).where("mark = 'usable'").count() == 0
    assert term_frequencies(many.limit(0), ["nafn"]).count() == 0


def shared_slowly(docs, width):
    at = {}
    for d, t in docs:
        for p in range(len(t or "") - width + 1):
            at.setdefault(t[p : p + width], set()).add(d)
    out = set()
    for d in {d for d, _ in docs if d is not None}:
        hits = sorted({p for e, t in docs if e == d and t for p in range(len(t) - width + 1) if len(at[t[p : p + width]] - {None}) > 1})
        while hits:
            low = high = hits[0]
            while hits and hits[0] <= high + width:
                high = hits.pop(0)
            out.add((d, low, high + width))
    return sorted(out)


def texts(r, n, alphabet):
    return "".join(r.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize(("width", "alphabet", "cap"), [(60, "ab ", 512), (200, "abcdefgh é\U0001f600þ", 512), (200, "abcdefgh é\U0001f600þ", 2), (30, "xy", 3)])
def test_shared_spans(spark, rows, width, alphabet, cap):
    r = random.Random(width + cap)
    common, other = texts(r, width * 2, alphabet), texts(r, width, alphabet)
    docs = [(i, texts(r, r.randrange(width * 3), alphabet) + (common[r.randrange(9) :] if i % 3 == 0 else other if i % 4 == 1 else "") + texts(r, r.randrange(width), alphabet)) for i in range(24)]
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, common), (103, other * 4), (103, other), (104, other[1:]), (105, None), (106, ""), (None, common), (107, "a" * width * 3), (108, "b" + "a" * width), (109, "ab" * width), (110, "ba" * width)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, span_start int")
    got = rows(shared_spans(df, width=width, cap=cap))
    want = shared_slowly([(d, t) for d, t in docs if d is not None], width)
    assert sorted(got) == want and want


def test_no_documents(spark):
    assert shared_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert pack_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_windows_choose_equal_anchors():
    r = random.Random(4)
    core = texts(r, 700, "abcdefghij")
    for _ in range(20):
        points, breaks = joined_points([texts(r, r.randrange(300), "abcdefghij") + core + texts(r, r.randrange(300), "abcdefghij") for _ in range(2)])
        key, at, p1, p2 = recompress.anchors(points, breaks, 200)
        by = {}
        for k, a, x, y in zip(key.tolist(), at.tolist(), p1.tolist(), p2.tolist()):
            d = int(np.searchsorted(breaks, x, "right")) - 1
            for p in range(x, y + 1):
                by[d, p] = (k, a - p)
        text = points.tolist()
        assert len(by) == sum(max(0, int(breaks[i + 1] - breaks[i]) - 1 - 199) for i in range(2))
        first = {tuple(text[p : p + 200]): v for (d, p), v in by.items() if d == 0}
        assert all(first[w] == v for (d, p), v in by.items() if d == 1 and (w := tuple(text[p : p + 200])) in first)


def test_edit_distances():
    from kinweave.llm.names import edits

    r = random.Random(1)
    words = ["", "a", "ab", "ba"] + [texts(r, r.randrange(9), "abc") for _ in range(40)]
    d = edit_distances(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert d[i, j] == edits(a, b, 99)


LIST = [(1, "Vinnumaður", "griðmaður"), (2, "Barn húsráðanda", "heimabarn"), (3, "Barnakennari", ""), (4, "Háseti", None), (5, "Kaupmaður", "höndlari")]


def test_canon():
    c = Canon([(i, [n, *(a or "").split(";")]) for i, n, a in LIST], {2: 5.0, 3: 9.0})
    cases = {
        "vinnumaður": 1, "GRIDMADUR": 1, "vinnu-maður": 1, "hér vinnumaður (70 ára)": 1, "vinnumðaur": 1, "barn hús ráðanda": 2, "heima barn": 2, "barnak.": 3, "barn.": 3, "er háseti": 4, "hásti": 4, "hásetinn": 4,
        "draugafæla": 0, "--": 0, "?": 0, "do. 7": 0, "kaupmaður og griðmaður": 1, "höndlari": 5, "x" * 5000: 0, "  ": 0,
    }
    got = dict(zip(cases, c.map(list(cases))))
    got["kaupmaður og griðmaður"] = 1 if got["kaupmaður og griðmaður"] in (1, 5) else 0  # equally long names
    assert got == cases
    assert Canon([]).map(["vinnumaður"]) == [0]


def test_sets_of_tokens_in_any_order():
    canon = Canon([(1, ["Barn húsráðanda"]), (2, ["Vinnumaður"]), (3, ["Húsbóndi"])])
    assert canon.map(["husradenda barn", "barm husradanda", "vinumaður hér", "husradenda", "xx yy"]) == [1, 1, 2, 1, 0]


def test_map_to_canon(spark, rows):
    listed = spark.createDataFrame([(i, n, a, "x") for i, n, a in LIST], "stada_id int, cleaned_status string, onnur_heiti string, stada string")
    data = [(1, "griðmaður", None), (1, "griðmaður", ""), (2, "háseti", "Háseti"), (3, None, None), (4, "NaN", None), (5, "draugafæla", "NaN"), (None, "háseti", None), (6, "", None)]
    df = spark.createDataFrame([(*x, 9) for x in data], "id long, stada string, cleaned_status string, stada_id int")
    assert rows(map_to_canon(df, listed)) == [(1, 1), (5, 0)]
    assert rows(map_to_canon(df, listed.limit(0))) == [(1, 0), (5, 0)]
    assert map_to_canon(df.limit(0), listed).count() == 0


def test_packing(spark):
    r = random.Random(1)
    words = ["hestur", "fjall", "kirkja", "bóndi", "sauður", "prestur", "á", "og"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 260))), 1) for i in range(300)] + [(1000, "orð " * 4000, 1), (5, "endurtekin lína", 1), (5, "endurtekin lína", 1), (7, None, 1), (8, "", 1), (None, "x", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, piece int")
    got = [x.asDict() for x in pack_texts(df, capacity=256, shard_items=128).collect()]
    encode = encoder()
    size = {}
    for x in got:
        size[x["container_id"]] = size.get(x["container_id"], 0) + x["n_tokens"]
    assert max(size.values()) <= 256
    want = {}
    for d, t, _ in docs:
        if t and d is not None:
            want[d] = want.get(d, 0) + len(encode(t))
    have = {}
    for x in got:
        have[x["doc_id"]] = have.get(x["doc_id"], 0) + x["n_tokens"]
    assert have == want
    parts = {}
    for x in got:
        parts.setdefault(x["doc_id"], []).append(x)
    for d, t, _ in docs[:300]:
        n = len(encode(t))
        if d != 5:
            assert len(parts[d]) == -(-n // 256) and sum(x["n_tokens"] == 256 for x in parts[d]) >= n // 256
    assert sum(size.values()) / len(size) / 256 > 0.93


def test_permutation_and_quotas():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    share, caps = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 2, "c": 4}
    q = quotas({"a": 100, "b": 100, "c": 100}, share, caps, total=200)
    assert q == {"a": 100.0, "b": 60.0, "c": 40.0}
    q = quotas({"a": 100, "b": 10, "c": 100}, share, caps, total=200)
    assert q["b"] == 20 and q["a"] == 100 and round(q["c"]) == 80
    q = quotas({"a": 100, "c": 100}, share, caps)
    assert q["b"] == 0 and q["a"] == 100 and round(q["c"]) == 40
    assert sum(quotas({}, share, caps).values()) == 0


def test_mixing(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["hestur", "fjall", "prestur"]) for _ in range(r.randrange(5, 200))), "a" if i % 2 else "b" if i % 3 else "c") for i in range(600)]
    docs += [(900, "x", None), (901, None, "a"), (902, "", "b"), (None, "y", "a"), (903, "z", "other")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, slot int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.1, 1), ("c", 0.3, 4), ("d", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixture, report = mix_sources(df, targets, block=64, shard_slots=32)
    held = [x.asDict() for x in mixture.collect()]
    seen = {}
    for x in held:
        for t in range(x["tok_start"], x["tok_end"]):
            seen[x["doc_id"], t] = seen.get((x["doc_id"], t), 0) + 1
    source = {d[0]: d[2] for d in docs}
    cap = {"a": 1, "b": 1, "c": 4}
    assert all(n <= cap[source[d]] for (d, _), n in seen.items())
    encode = encoder()
    assert all(t < len(encode(next(x[1] for x in docs if x[0] == d))) for d, t in list(seen)[:200])
    slots = {}
    for x in held:
        slots.setdefault((x["out_shard"], x["slot"]), []).append(x)
    assert all(len({y["source"] for y in v}) == 1 and sum(y["tok_end"] - y["tok_start"] for y in v) <= 64 for v in slots.values())
    got = {x["source"]: x.asDict() for x in report.collect()}
    assert got["d"]["used_tokens"] == 0 and not got["d"]["met"] and got["a"]["met"] and got["c"]["met"]
    assert abs(got["c"]["actual_share"] / got["a"]["actual_share"] - 0.6) < 0.02
    again = mix_sources(df, targets, block=64, shard_slots=32)[0].collect()
    assert sorted(map(tuple, again)) == sorted(tuple(x.values()) for x in held)
    empty, none = mix_sources(df.limit(0), targets)
    assert empty.count() == 0 and none.count() == 4


def test_rows_of_a_hot_key_all_of_one_document_pass():
    import pyarrow as pa

    from kinweave.llm.spans import _shared_classes

    doc, hot = [1] * 5 + [2] * 3, [False] * 5 + [True] * 3
    flat = pa.array(range(8), pa.int32())
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 8, pa.int64()), pa.array(doc, pa.int64()), flat, flat, flat, pa.array(hot)], names=["key", "doc_id", "at", "p1", "p2", "hot"])
    for parts in ([batch], [batch.slice(i, 1) for i in range(8)]):
        out = pa.Table.from_batches(list(_shared_classes(4)(iter(parts))))
        assert out.column("doc_id").to_pylist() == doc and all(out.column("hot").to_pylist())


def test_spans_of_a_key_with_a_copy_and_another_text(spark, rows):
    import random

    from kinweave.llm.spans import shared_spans

    r = random.Random(9)
    a, b = ("".join(r.choice("abcdefghij ") for _ in range(400)) for _ in range(2))
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, f"x{b}y")], "doc_id long, text string")
    assert rows(shared_spans(df)) == [(1, 0, 400), (2, 0, 400), (3, 1, 401)]
