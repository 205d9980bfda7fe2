"""The operators of the llm subpackage against brute force and in the corner cases."""

import random

import numpy as np
import pytest

from ctmcflow.llm import encode, language, leak, splits, topn
from ctmcflow.session import Scratch

REPORT = "report_id long, load_id int, sequence string, system string, dps_dir string, root string, key string"


def report(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], REPORT)


def brute_groups(rows):
    import re

    def plain(x):
        x = re.sub(r"(nocap)+$", "", re.sub(r"[^a-z0-9]", "", (x or "").lower()))
        return None if x in splits.PLACEHOLDERS else x

    par: dict = {}

    def root(a):
        while par[a] != a:
            a = par[a]
        return a

    keys = []
    for _, _, s, y, p in rows:
        parts = [x for x in (p or "").replace("\\", "/").strip().split("/") if x.strip() not in ("", ".")]
        k = [(i, v) for i, v in enumerate((plain(s), plain(y), plain(parts[-1] if parts else None))) if v]
        for a in k:
            par.setdefault(a, a)
        for a in k[1:]:
            x, z = sorted((root(k[0]), root(a)))
            par[z] = x
        keys.append(k)
    names: dict = {}
    for a in par:
        if a[0] == 0:
            names[root(a)] = min(names.get(root(a), "~"), a[1])
    return {r[0]: names.get(root(k[0])) if k else None for r, k in zip(rows, keys)}


def test_groups(spark):
    rnd = random.Random(4)
    names = [f"{a}{b}cdef" for a in "acdefg" for b in "klmnpq"]
    rows = []
    for i in range(300):
        s, y, d = (rnd.choice(names) if rnd.random() < 0.3 else names[i % 36] for _ in range(3))
        rows.append((i, i % 4, rnd.choice([s, s.upper(), "-".join(s), f" {s} ", None, "n/a"]), rnd.choice([f"{y}_nocap", f"{y.upper()}-nocap/", "unknown_nocap", None]), rnd.choice([f"/a/{d}_19sb_nocap/", f"C:\\x\\{d}_19sb", f"/b/./{d}_19SB_nocap//", "", "tmp/"])))
    rows += [(1000, 0, None, None, None), (1001, 0, "", "n/a", "/tmp/"), (1002, 1, "zz" * 50_000, None, None), *[(2000 + i, 2, "chain", f"l{i}xx", f"/q/l{i + 1}xx") for i in range(12)]]
    df = report(spark, rows)
    got = {r["report_id"]: r["group_seq"] for r in splits.groups(Scratch(spark, "t"), df).collect()}
    assert got == brute_groups(rows)


def test_placeholders_with_separators_tie_nothing(spark):
    """Folders stated by hand: whole values that are placeholders name none, also where they hold a separator."""
    folders = {"n/a": None, " N/A ": None, "N\\A": None, "n / a": None, "N/A/": None, "/tmp/": None, "None": None, "/x/na/": None, "/x/a": "a", "C:\\x\\A\\": "a", "/x/a_nocap": "a", "/x/n/b": "b", "b": "b"}
    rows = [(2 * i + k, 0, f"{'pq'[k]}{'abcdefghijklmnop'[i]}seq", None, p) for i, p in enumerate(folders) for k in range(2)]
    got = {r["report_id"]: r["group_seq"] for r in splits.groups(Scratch(spark, "t"), report(spark, rows)).collect()}
    names = {r[0]: r[2] for r in rows}
    want = {}
    for i, folder in enumerate(folders.values()):
        for k in range(2):
            same = [names[2 * j + m] for j, f in enumerate(folders.values()) for m in range(2) if folder and f == folder]
            want[2 * i + k] = min(same) if same else names[2 * i + k]
    assert got == want


def test_long_chain_and_empty(spark):
    rows = [(i, 0, None, f"s{i}", f"/x/s{i // 2}d") for i in range(2)] + [(10 + i, 0, f"a{i}" if i == 0 else None, f"y{(i + 1) // 2}k", f"/x/f{i // 2}k") for i in range(60)]
    got = {r["report_id"]: r["group_seq"] for r in splits.groups(Scratch(spark, "t"), report(spark, rows)).collect()}
    assert got == brute_groups(rows) and got[69] == "a0"
    assert splits.groups(Scratch(spark, "t"), report(spark, [])).count() == 0


def test_incremental_state_keeps_splits_and_quarantines(spark, tmp_path):
    rows = [(i, 0, f"seq{i}x", None, None) for i in range(400)]
    first = report(spark, rows)
    keys = ["k_seq", "k_sys", "k_dir"]
    s = Scratch(spark, "t")
    one = splits.ComponentTable(spark, f"file://{tmp_path}/c")
    one.extend(s, splits.report_keys(first), keys)
    before = {r["key"]: r["split"] for r in one.state().collect()}
    share = {x: sum(v == x for v in before.values()) for x in splits.SPLITS}
    assert all(abs(share[x] - 400 * p) <= 1 for x, p in splits.SPLITS.items()) and len(before) == 400
    a, b, c, d = (next(k[2:] for k, v in before.items() if v == x and k[2:] not in used) for x, used in (("train", ()), ("test", ()), ("validation", ()), ("validation", (next(k[2:] for k, v in before.items() if v == "validation"),))))
    more = [(900, 1, a, "bridge", None), (901, 1, b, "bridge", None), (902, 1, "brandnew", None, None), (903, 1, c, "same", None), (904, 1, d, "same", None)]
    two = splits.ComponentTable(spark, f"file://{tmp_path}/c")  # as a later session reads it
    assert two.batches == 1
    two.extend(s, splits.report_keys(report(spark, more)), keys)
    rows = {r["key"]: (r["root"], r["split"]) for r in two.state().collect()}
    got = {k: v[1] for k, v in rows.items()}
    assert got[f"0:{a}"] == got[f"0:{b}"] == got["1:bridge"] == "quarantine" and got["0:brandnew"] in splits.SPLITS
    assert got[f"0:{c}"] == got[f"0:{d}"] == got["1:same"] == "validation" and rows[f"0:{c}"][0] == rows[f"0:{d}"][0] == min(f"0:{c}", f"0:{d}")
    assert all(got[k] == v for k, v in before.items() if k not in (f"0:{a}", f"0:{b}"))
    # a second merge moves what the first one hooked, and only that
    two.extend(s, splits.report_keys(report(spark, [(910, 2, c, "bridge", None)])), keys)
    last = {r["key"]: (r["root"], r["split"]) for r in two.state().collect()}
    assert {last[f"0:{x}"] for x in (a, b, c, d)} == {(min(f"0:{x}" for x in (a, b, c, d)), "quarantine")} and len(last) == 403
    assert two._read("roots", splits._ROOTS).filter("batch = 2").count() < 8


def test_many_loads_equal_one(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, i % 5, rnd.choice([f"s{rnd.randint(0, 60)}", None]), rnd.choice([f"y{rnd.randint(0, 60)}", None]), None) for i in range(150)]
    s, keys = Scratch(spark, "t"), ["k_seq", "k_sys", "k_dir"]
    t = splits.ComponentTable(spark, f"file://{tmp_path}/m")
    for load in range(5):
        t.extend(s, splits.report_keys(report(spark, [r for r in rows if r[1] == load])), keys)
    one = splits.ComponentTable(spark, f"file://{tmp_path}/o")
    one.extend(s, splits.report_keys(report(spark, rows)), keys)
    assert {(r["key"], r["root"]) for r in t.state().collect()} == {(r["key"], r["root"]) for r in one.state().collect()}


def test_splits_parameter_holds_for_all_rows(spark, tmp_path):
    rows = [(i, 0, f"q{i}z" if i % 2 else None, None, None) for i in range(2000)]
    keys = ["k_seq", "k_sys", "k_dir"]
    t = splits.ComponentTable(spark, f"file://{tmp_path}/p")
    df, want = splits.report_keys(report(spark, rows)), {"train": 0.5, "test": 0.5}
    t.extend(Scratch(spark, "t"), df, keys, want)
    got = splits.with_state(df.drop("root", "key"), t.state(), keys, "report_id", want).groupBy("split").count().collect()
    assert {r["split"] for r in got} == set(want) and all(abs(r["count"] - 1000) < 120 for r in got)


def test_top_n(spark):
    rnd = random.Random(8)
    rows = [("hot" if rnd.random() < 0.4 else f"n{rnd.randint(0, 9)}", rnd.randint(0, 3) if rnd.random() < 0.9 else None, rnd.randint(0, 40), rnd.choice([None, float("nan"), float("inf"), -0.0, 0.0, 1.5, rnd.random()]), 1) for _ in range(5000)]
    df = spark.createDataFrame(rows, "network_id string, src long, dst long, score double, rank int").repartition(6)
    best: dict = {}
    for g, s, d, v, _ in rows:
        if s is not None and v is not None and np.isfinite(v):
            best[g, s, d] = max(best.get((g, s, d), -1e9), v + 0.0)
    want = set()
    for g in {k[:2] for k in best}:
        for r, (d, v) in enumerate(sorted(((k[2], v) for k, v in best.items() if k[:2] == g), key=lambda x: (-x[1], x[0]))[:3], 1):
            want.add((*g, d, v, r))
    for run_rows in (50, 100_000):
        assert {tuple(r) for r in topn.top_n(df, "network_id", "src", "dst", "score", 3, run_rows).collect()} == want
    assert topn.top_n(df.limit(0), "network_id", "src", "dst", "score").count() == 0


def test_loser_tree_merges_in_order():
    rnd = random.Random(1)
    for k in range(1, 9):
        runs = [sorted((rnd.randint(0, 9), rnd.randint(0, 9)) for _ in range(rnd.randint(0, 6))) for _ in range(k)]
        tree, out = topn.LoserTree(runs), []
        while (x := tree.pop()) is not None:
            out.append(x)
        assert out == sorted(x for r in runs for x in r)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_encoding_equals_library(spark, library):
    rnd = random.Random(5)
    letters = "abcdefghij   etaoin éüßñ\n\t\x1c\x85 ABC123.,!?'sß漢字😀‍\"<|>ąć"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    texts += ["<|endoftext|>", "a" * 20_000, " " * 5000, "the quick brown fox " * 3000, "don't we'll I'VE"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(9000, None, None), (9001, "", None), (0, "again", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode.encode_column(df)
    got = sorted((r["doc_id"], r["ids"]) for r in out.collect())
    assert got == sorted((i, library.encode(t, add_special_tokens=False).ids if t else []) for i, t, _ in rows)
    back = sorted((r["doc_id"], r["text"]) for r in encode.decode_column(out).collect())
    assert back == sorted((i, t or "") for i, t, _ in rows)
    assert encode.encode_column(df.limit(0)).count() == 0


def test_incremental_utf8():
    rnd = random.Random(2)
    text = "aé漢😀߿ࠀ￿𐀀\U0010ffff" * 20
    b = text.encode()
    cut = sorted(rnd.sample(range(len(b)), 30))
    pieces = [b[i:j] for i, j in zip([0, *cut], [*cut, len(b)])]
    assert "".join(encode.decode_stream(iter(pieces))) == text
    assert "".join(encode.decode_stream(iter([b"a\xc3", b"(", b"\xed\xa0\x80", b"\xf0\x9f"]))).replace("�", "?")[:3] == "a?("


def brute_leak(docs, items):
    out = set()
    for d, t in docs:
        w = [x for x, _, _ in leak.words(t or "")]
        for e, x in items:
            v = [y for y, _, _ in leak.words(x)]
            for g in range(-len(v) + 1, len(w)):
                a, b = max(0, -g), min(len(v), len(w) - g)
                same = [w[g + i] == v[i] for i in range(a, b)]
                run = 0
                for s in same:
                    run = run + 1 if s else 0
                    if run >= leak.EXACT:
                        out.add((d, e))
                for i in range(len(same)):
                    for j in range(i + leak.FUZZY, len(same) + 1):
                        if 6 * same[i:j].count(False) <= j - i:
                            out.add((d, e))
    return out


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(6)
    word = lambda: rnd.choice(["alpha", "beta", "gamma", "delta", "été", "x1", "kilo", "über"])
    items = [(i, " ".join(word() + str(rnd.randint(0, 30)) for _ in range(rnd.randint(5, 45)))) for i in range(12)]
    docs = []
    for d in range(120):
        v = rnd.choice(items)[1].split()
        n = rnd.randint(8, 30)
        at = rnd.randint(0, max(0, len(v) - n))
        p = [("wrong" if rnd.random() < rnd.choice([0, 0.1, 0.2]) else w) for w in v[at : at + n]]
        p = rnd.choice([" ", "\n", "  ", ", ", " <b>", "\u00a0"]).join(p)
        p = rnd.choice([p, p.upper(), p.replace("é", "&eacute;"), p.replace("a", "a\u200b")])
        docs.append((d, " ".join(word() for _ in range(rnd.randint(0, 20))) + " " + p + " " + " ".join(word() for _ in range(5))))
    docs += [(500, None), (501, ""), (502, "word " * 30_000 + items[0][1] + " " + items[1][1]), (503, items[2][1]), (503, items[2][1])]
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, eval_id string")
    e = spark.createDataFrame(items, "eval_id long, text string")
    want = brute_leak([x for x in docs if x[0] != 502], items)
    got = {tuple(r) for r in leak.leaks(d, e).collect()}
    assert {x for x in got if x[0] != 502} == want and len(want) > 20
    assert {x[1] for x in got if x[0] == 502} >= {i for i in (0, 1) if len(items[i][1].split()) >= 12}
    assert {tuple(r) for r in leak.leaks(d, e, block_words=60).collect()} == got
    spans = leak.removal_spans(d, e).filter("doc_id = 503").collect()
    assert all(s["items"] >= 1 and s["end_char"] <= len(items[2][1]) for s in spans)
    assert leak.leaks(d.limit(0), e).count() == 0 and leak.leaks(d, e.limit(0)).count() == 0


def local_search(docs, items, overlap=20):
    """The index and the search of one task, without Spark: (doc_id, eval_id, first_word, last_word)."""
    import pyarrow as pa

    class Block:
        value = leak.Items([i for i, _ in items], [np.array([leak.word_hash(w) for w, _, _ in leak.words(t)], "uint64") for _, t in items])

    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([0] * len(docs)), pa.array([t for _, t in docs])], names=["doc_id", "hash", "text"])
    index = leak.index_batches(overlap)(iter([batch]))
    return [(r["doc_id"], r["eval_id"], r["first_word"], r["last_word"]) for b in leak._search(Block, {})(index) for r in b.to_pylist()]


def test_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(leak, "SHARD_WORDS", 50)
    monkeypatch.setattr(leak, "LONG_CHARS", 100)
    item = " ".join(f"w{i}" for i in range(14))
    docs = [(i, "o " * i + item + " o" * 90) for i in range(0, 120, 7)]
    # a piece may also hold part of a stretch; the whole one is always there
    assert set(local_search(docs, [(1, item)], 14)) >= {(d, 1, d, d + 13) for d, _ in docs}


def test_short_repeated_documents_end_and_are_found():
    item = " ".join(f"w{i}" for i in range(30))
    docs = ["w1 w2 w3 w4 w5", "q w0 w1 w2 w3", "w2 w3 w4 w5 w6", "w0 w1 w2 w3", "w0 w1 w2 w3"]
    assert local_search(list(enumerate(docs)), [(1, item)]) == []
    long = [(i, x) for i, x in enumerate(docs)] + [(9, " ".join(f"w{i}" for i in range(3, 17)))]
    assert local_search(long, [(1, item)]) == [(9, 1, 0, 13)]


def test_planted_inexact_runs_at_the_start_of_a_text():
    rnd = random.Random(12)
    items = [(e, " ".join(f"v{rnd.randint(0, 400)}" for _ in range(40))) for e in range(50)]
    docs, want = [], set()
    for d in range(2000):
        e, text = rnd.choice(items)
        v = text.split()[:20]
        for i in rnd.sample(range(20), 3):
            v[i] = "wrong"
        docs.append((d, " ".join(v + [f"z{rnd.randint(0, 50)}" for _ in range(rnd.randint(0, 4))])))
        want.add((d, e))
    assert {r[:2] for r in local_search(docs, items)} >= want


def test_fm_index_finds_all_places():
    rng = np.random.default_rng(3)
    text = np.r_[rng.integers(1, 5, 400), 0].astype("int64")
    fm = leak.FMIndex.of(text)
    pats = rng.integers(1, 5, (50, 3))
    low, high = fm.search(pats)
    for p, a, z in zip(pats, low, high):
        want = [i for i in range(len(text) - 2) if (text[i : i + 3] == p).all()]
        assert sorted(fm.locate(np.arange(a, z))) == want


def test_fm_index_over_many_documents():
    """Shards of short, repeated documents: every row is located where the sorted suffixes say."""
    rng = np.random.default_rng(5)
    for _ in range(1000):
        kinds = rng.integers(1, 4)
        some = [rng.integers(0, kinds + 1, rng.integers(0, 7)) for _ in range(3)]
        docs = [some[i] for i in rng.integers(0, 3, rng.integers(1, 9))]
        flat: list[int] = []
        for i, d in enumerate(docs):
            flat += [*d, 100 + i]
        text = np.array(flat, "int64")
        fm = leak.FMIndex.of(text)
        order = sorted(range(len(flat)), key=lambda i: flat[i:])
        assert fm.locate(np.arange(len(flat))).tolist() == order


SENTENCES = {
    "en": ["the handle broke off although we treated it with great care", "this was clearly the quietest of them all and we like it", "the support team answered within two hours and was friendly"],
    "de": ["der griff ist abgebrochen obwohl wir sehr vorsichtig damit waren", "das war eindeutig das leiseste von allen und wir mögen es", "der kundendienst antwortete nach zwei stunden und war freundlich"],
    "fr": ["la poignée s'est cassée alors que nous y faisions très attention", "c'était nettement le plus silencieux de tous et nous l'aimons", "le service client a répondu en deux heures et était aimable"],
    "es": ["el asa se rompió aunque la tratábamos con mucho cuidado", "era claramente el más silencioso de todos y nos gusta mucho", "el servicio técnico respondió en dos horas y fue amable"],
}


def test_language_passages(spark):
    rows = []
    for i in range(240):
        lang = list(SENTENCES)[i % 4]
        rows.append((i, " ".join(random.Random(i).sample(SENTENCES[lang], 3)), lang if i % 9 else "en", "c"))
    rows += [(1000, SENTENCES["de"][0] + " " + SENTENCES["fr"][0], "de", "c"), (1001, SENTENCES["en"][0] + " c'est la vie", "en_US", "c"), (1002, None, None, "c"), (1003, "", "de", "c"), (1004, "12 34 😀", None, "c"), (1005, SENTENCES["es"][1], "n/a", "c"), (1008, "❤️ 👍🏽 😀", None, "c"), (1009, "❤️ 👩‍🔧", "es", "c"), (1006, (SENTENCES["de"][1] + " ") * 3000, "German", "c"), (1007, SENTENCES["fr"][1].upper(), "FR", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, seg string")
    f = language.train(df)
    got = {(r["doc_id"], r["lang"]) for r in language.wrong_labels(df, f).collect()}
    want = {(i, list(SENTENCES)[i % 4]) for i in range(240) if i % 9 == 0 and i % 4} | {(1000, "de"), (1000, "fr"), (1005, "es")}
    assert got == want
    p = language.passages(df, f).filter("doc_id IN (1000, 1002, 1003, 1004)").collect()
    assert [(r["lang"], r["n_words"]) for r in sorted(p, key=lambda r: r["seg"]) if r["doc_id"] == 1000] == [("de", 10), ("fr", 11)]
    assert all(r["lang"] is None and r["confidence"] == 0 for r in p if r["doc_id"] != 1000)
    assert language.wrong_labels(df.limit(0), f).count() == 0
    assert language.wrong_labels(df, language.train(df.limit(0))).count() == 0
