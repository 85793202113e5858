"""Every operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows,
no rows, and extra columns whose names clash with those the operators use inside."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import bpe, components, decontaminate, fmindex, hdlang, html, repeats, rules, simhash, tokencounts, warc

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "b", "the", "é", "ß", " ", "\n", "'s", "'", "Σ", "İ", "日本", "1", "½", "<|endoftext|>", "!!", "  ", "\x1c", "\xa0", "don't", "ing", "é", "😀", "\t", "#"]


def odd_texts(n, seed=7):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 80))) for _ in range(n)]


def clashing(df):
    """Extra columns named as the operators' own inner columns."""
    return df.withColumns({c: F.lit(1) for c in ("key", "bucket", "blob", "fp", "node", "th_", "row_key", "ids", "n_words", "kept", "hash", "a", "b")})


# ---------------------------------------------------------------- 1 and 6: tokenizers


def encoded(texts):
    t = Tokenizer.from_file(WORD)
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return [(i, t.decode(i, skip_special_tokens=False)) for i in ids]


def test_bpe_equals_the_library(docs):
    texts = [None, "", " \n", *odd_texts(200), "abcdefgh" * 4000, "word " * 20_000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "no id")]
    got = bpe.encode(clashing(docs(rows)), WORD, long_bytes=60, leaf_bytes=24).collect()
    want = Counter((i, tuple(ids), d) for (i, _), (ids, d) in zip(rows, encoded([t for _, t in rows]), strict=True))
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == want


@pytest.mark.parametrize("leaf", [3, 7, 50])
def test_tree_concatenation_does_not_depend_on_the_cuts(leaf):
    b = bpe.loaded(WORD)
    for text in [*odd_texts(60, leaf), "aaaa" * 300, "x" * 1000]:
        for seg in b.segments(text):
            if isinstance(seg, str):
                whole = b.leaf(seg.encode())
                tree = b.joined([b.leaf(x) for x in bpe.halves(seg.encode(), leaf)])
                assert (tree.ids, tree.starts) == (whole.ids, whole.starts)


def test_decode_is_the_inverse_of_names(spark):
    df = spark.createDataFrame([(1, [320, 321]), (2, []), (3, None)], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in bpe.decode(df, WORD).collect()}
    assert got == {1: Tokenizer.from_file(WORD).decode([320, 321], skip_special_tokens=False), 2: "", 3: None}


def test_token_counts_equal_the_library(docs):
    texts = [None, "", *odd_texts(300), "a" * 3000, "ab" * 1500]
    rows = list(enumerate(texts)) + [(None, "no id"), (4, texts[4])]
    t = Tokenizer.from_file(BYTE)
    want = Counter((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for i, x in rows)
    assert Counter(tuple(r) for r in tokencounts.token_counts(clashing(docs(rows)), BYTE).collect()) == want


# ---------------------------------------------------------------- 9: SimHash


def brute_fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    votes = [sum(xxhash.xxh64_intdigest(s.encode(), seed=42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles)) if shingles else 0


def brute_components(prints, tau):
    parent = {i: i for i, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, f in prints:
        for j, g in prints:
            if (f ^ g).bit_count() <= tau:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in prints}


def near_texts():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    base = [rnd.choice(words) for _ in range(300)]
    out = [None, "", " ", "One", "one", "ONE two"]
    for k in range(60):
        own = list(base)
        for _ in range(k % 6):
            own[rnd.randrange(300)] = rnd.choice(words)
        out.append(" ".join(own))
    return out + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(60)]


def test_simhash_components_equal_all_pairs(docs):
    rows = list(enumerate(near_texts(), 10))
    prints = [(i, brute_fingerprint(t, 4)) for i, t in rows]
    want = brute_components(prints, 4)
    got = simhash.simhash_components(clashing(docs(rows)), shingle_words=4).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, format(f, "016x"), want[i]) for i, f in prints}


@pytest.mark.parametrize("tau", [0, 1, 2, 4, 6])
def test_generalised_pigeonhole_loses_no_link(spark, tau):
    rnd = random.Random(tau)
    centres = [rnd.getrandbits(64) for _ in range(30)]
    fps = list({c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 7))) for c in centres for _ in range(8)})
    rows = [(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)]
    got = simhash.linked(spark.createDataFrame(rows, "doc_id long, fp long"), tau).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(list(enumerate(fps)), tau)


def test_thresholds_are_those_of_least_cost():
    costs = [[0.0, 5.0, 9.0], [0.0, 1.0, 50.0], [0.0, 4.0, 6.0]]
    cost, chosen = simhash.allocate(costs, 2)
    assert sum(t + 1 for t in chosen) == 3 and cost == min(a + b + c for i, a in enumerate(costs[0]) for j, b in enumerate(costs[1]) for k, c in enumerate(costs[2]) if i + j + k == 3)


def test_simhash_with_null_ids_repeated_rows_and_no_rows(docs):
    got = simhash.simhash_components(docs([(5, "a b"), (5, "a b"), (None, "a b"), (None, "else here"), (2, "A B")]), shingle_words=4).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 2), (2, 2), (5, 2), (5, 2)]
    assert simhash.simhash_components(docs([])).count() == 0
    stay = simhash.near_deduplicated(docs([(5, "a b"), (5, "a b"), (None, "a b"), (None, None), (9, "c")]), shingle_words=4).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in stay if r["text"]) == [(5, "a b"), (9, "c")] and len(stay) == 3


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


# ---------------------------------------------------------------- 8: repeated strings


def brute_repeats(rows, n=100):
    seen, out = set(), {}
    for i, x in sorted(rows):
        hit = bytearray(len(x))
        for p in range(len(x) - n + 1):
            w = x[p : p + n]
            if w in seen:
                hit[p : p + n] = b"\1" * n
            seen.add(w)
        out[i] = (sum(hit), bytes(b for b, h in zip(x, hit, strict=True) if not h))
    return out


def repeat_texts():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(40) for _ in range(4)]
    out = [None, "", "a" * 99, "a" * 100, "a" * 700, "ab" * 300, "é" * 200, "\x00" * 250, shared[0], shared[0]]
    for _ in range(60):
        s = rnd.choice(shared)
        cut = rnd.randrange(60)
        out.append(line(rnd.randint(0, 30)) + s[cut : cut + rnd.randint(60, 160)] + line(rnd.randint(0, 30)))
    return out


def test_repeated_strings_equal_brute_force(docs):
    rows = list(enumerate(repeat_texts()))
    random.Random(1).shuffle(rows)
    want = brute_repeats([(i, (t or "").encode()) for i, t in rows])
    got = repeats.without_repeats(clashing(docs(rows))).collect()
    assert {r["doc_id"]: (sum(s["end"] - s["begin"] for s in r["repeat_spans"]), bytes(r["kept_bytes"])) for r in got} == want


def test_long_texts_are_taken_in_stretches(monkeypatch, docs):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 256)
    rows = [(k, t.encode()) for k, t in enumerate(x or "" for x in repeat_texts())]
    ids = [np.arange(len(rows)), np.zeros(len(rows), np.int64)]
    cut = list(repeats._cut_long([t for _, t in rows], ids, 100))
    windows = Counter((int(d), int(p) - o) for c in cut for d, p, hi, lo in zip(c[2], c[4], c[5].tolist(), c[6].tolist(), strict=True) for o in range(lo, hi + 1))
    assert windows == Counter((i, p) for i, t in rows for p in range(len(t) - 99))


def test_levels_hand_back_every_later_place():
    rnd = np.random.default_rng(5)
    index, late = repeats.Levels(), []
    places = [(int(k), int(d), 0, int(p)) for k, d, p in zip(rnd.integers(0, 300, 4000), rnd.integers(0, 50, 4000), rnd.integers(0, 1000, 4000), strict=True)]
    for at in range(0, 4000, 170):
        cols = [np.array(c) for c in zip(*places[at : at + 170], strict=True)]
        for x in index.add([cols[0].astype(np.uint64), *cols[1:]]):
            late += list(zip(*(c.tolist() for c in x), strict=True))
    first = {}
    for k, *place in sorted(places):
        first.setdefault(k, tuple(place))
    assert set(late) == {p for p in places if p[1:] != first[p[0]]}
    sizes = [len(x[0]) for x in index.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_repeats_with_null_ids_equal_rows_and_no_rows(docs):
    x = "".join(random.Random(1).choices("abcdefgh", k=154))
    got = repeats.without_repeats(docs([(None, x), (1, x), (1, x), (2, x)])).collect()
    assert sorted((r["doc_id"] or -1, len(r["kept_bytes"])) for r in got) == [(-1, 154), (1, 0), (1, 0), (2, 0)]
    assert repeats.without_repeats(docs([])).count() == 0
    cut = repeats.deduplicated(docs([(1, "é" * 120), (2, "x" + "é" * 120), (3, None)])).collect()
    assert all(set(r["text"]) <= {"x", "é"} for r in cut) and len(cut) == 3


# ---------------------------------------------------------------- 10: decontamination


def test_fm_index_finds_every_occurrence():
    rnd = np.random.default_rng(0)
    for _ in range(120):
        n, k = int(rnd.integers(1, 150)), int(rnd.integers(1, 5))
        s = rnd.integers(0, k + 1, n).astype(np.int32)
        s[-1] = 0
        index = fmindex.FmIndex(s, k)
        p = rnd.integers(1, k + 1, int(rnd.integers(1, 5)))
        lo, hi = index.ranges(p[None, :].astype(np.int32), np.array([len(p)]))
        assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == [i for i in range(n - len(p) + 1) if (s[i : i + len(p)] == p).all()]


def test_repeats_keep_columns_of_any_name(docs):
    line = " ".join(f"w{k}" for k in range(60))
    table = docs([(1, line), (2, line), (3, None)]).withColumns({c: F.lit(c) for c in ("did", "th", "bucket_of", "bucket", "blob", "other_0")})
    got = {r["doc_id"]: r.asDict() for r in repeats.deduplicated(table).collect()}
    assert [got[k]["text"] for k in (1, 2, 3)] == [line, "", ""] and all(got[1][c] == c for c in ("did", "th", "bucket_of", "bucket", "blob", "other_0"))


def brute_hits(rows, items, window):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    asked = defaultdict(set)
    for i, t in items:
        w = find(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            asked[tuple(w[k : k + window])].add(None if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, named = find(t), set(), set()
        for n in {len(x) for x in asked}:
            for k in range(len(w) - n + 1):
                if own := asked.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    named |= own - {None}
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 120])
def test_hits_equal_brute_force(spark, docs, block_bytes):
    rnd = random.Random(5)
    line = lambda n: " ".join(rnd.choice(["Aa", "b", "ç", "d1", "e"]) for _ in range(n))
    items = [(k, line(rnd.randint(0, 16))) for k in range(14)] + [(3, "b e b"), (None, "d1 d1"), (20, None), (21, "zz zz")]
    rows = [(k, line(rnd.randint(0, 80))) for k in range(60)] + [(7, "b"), (None, "b e, b!"), (8, None), (9, ""), (10, "e " * 5000)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))
    got = decontaminate.report(decontaminate.hits(clashing(docs(rows)), bench, window=6, block_bytes=block_bytes)).collect()
    assert Counter(tuple(r) for r in got) == brute_hits(rows, items, 6)


def test_cut_out_words_and_empty_tables(spark, docs):
    bench = spark.createDataFrame([(1, "one two three"), (2, "five six")], "item_id long, text string")
    rows = [(1, "Zero ONE, two -- three! four five six"), (2, None), (3, "nothing here"), (4, "one two")]
    for block in (1 << 20, 8):
        got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminated(docs(rows), bench, block_bytes=block).collect()}
        assert got == {1: "Zero ! four ", 2: None, 3: "nothing here", 4: "one two"}
    assert decontaminate.hits(docs(rows), bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.hits(docs([]), bench).count() == 0


def test_long_texts_and_items_are_cut_without_losing_a_window(docs, spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 37)
    rnd = random.Random(9)
    line = lambda n: " ".join(rnd.choice("abcdef") for _ in range(n))
    rows = [(k, line(rnd.choice([0, 3, 36, 37, 38, 45, 400]))) for k in range(40)]
    rows += rows[:3]
    items = [(1, line(300)), (2, rows[5][1]), (3, "a b c"), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    files = decontaminate.phrase_files(bench, 6, "item_id", "text", 64)
    counts, spans, named = decontaminate.searched([t.encode() for _, t in rows], files, 6)
    got = Counter((i, n, sum(b - a for a, b in s), len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), bool(s)) for (i, _), n, s, x in zip(rows, counts, spans, named, strict=True))
    assert len(files) > 5 and got == brute_hits(rows, items, 6)


# ---------------------------------------------------------------- 4: quality rules


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for k in range(len(words) - 7):
        at[tuple(words[k : k + 8])].append(k)
    again = {q for own in at.values() if len(own) > 1 for k in own for q in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), n < 20 or 100 * len(again) > 30 * n)


def test_statistics_equal_brute_force(docs):
    rnd = random.Random(9)
    texts = [None, "", "\n\n", *odd_texts(80)] + ["".join(rnd.choice(["a ", "b ", "é\n", "c\x0b", "d# "]) for _ in range(rnd.randint(0, 120))) for _ in range(80)] + ["x y " * 3000]
    rows = list(enumerate(texts)) + [(0, None), (None, "a b")]
    got = rules.with_statistics(clashing(docs(rows))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *brute_statistics(t)) for i, t in rows)


def test_a_decision_list_is_learned_and_emitted_in_order(spark, docs):
    rnd = random.Random(2)
    good = lambda: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(60))
    rows, labels = [], []
    for k in range(240):
        bad = k % 4 == 0
        text = good()
        rows.append((k, re.sub(" ", "# ", text) if bad and k % 8 == 0 else text.upper() if bad else text))
        labels.append((k, 0 if bad else 1))
    rows += [(1000, None), (1001, "")]
    df = spark.createDataFrame([*labels, (None, 0), (5, None)], "doc_id long, quality int")
    learned = rules.learn(docs(rows), df)
    assert 1 <= len(learned.rules) <= rules.MOST_RULES
    got = {r["doc_id"]: r["kept"] for r in rules.judged(docs(rows), learned).collect()}
    assert got == {k: k % 4 != 0 for k in range(240)} | {1000: False, 1001: False}
    plan = rules.judged(docs(rows), learned).where("kept")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert rules.learn(docs(rows), df.limit(0)).rules == [] and rules.judged(docs([]), learned).count() == 0


# ---------------------------------------------------------------- 7: language


def test_prototypes_tell_languages_apart(spark, docs):
    rnd = random.Random(4)
    make = lambda parts: " ".join("".join(rnd.choice(parts) for _ in range(3)) for _ in range(rnd.randint(5, 40)))
    parts = {"xx": ["tho", "ing", "ed", "ea"], "yy": ["chu", "ung", "ver", "ß"]}
    rows = [(k, make(parts[lang]), lang) for k, lang in enumerate(["xx", "yy"] * 80)] + [(900, None, "xx"), (901, "123 !?", "yy"), (902, "", None), (None, "thoing", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    model = hdlang.learn(df.where(~hdlang.held_out()))
    got = hdlang.predict(df, model, keep=[F.col("doc_id"), F.col("lang"), hdlang.held_out().alias("h")]).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got if r["lang"] and r["doc_id"] < 900) and any(r["h"] for r in got)
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (900, 901, 902)} == {k: ("und", 0.0) for k in (900, 901, 902)}
    assert {r["lang_pred"] for r in hdlang.predict(df, {}).collect()} == {"und"} and hdlang.predict(df.limit(0), model).count() == 0


def test_bundles_equal_the_sum_of_bound_trigrams():
    texts = ["ab c", "", "日本 ab", "12"]
    got, has = hdlang.bundles(texts)
    for row, ok, text in zip(got, has, texts, strict=True):
        line = re.sub(r"[\W\d_]+", " ", f" {text} ")
        want = np.zeros(hdlang.DIMENSIONS, np.int64)
        for k in range(len(line) - 2):
            a, b, c = (hdlang.letter_vector(ord(x)).astype(np.int64) for x in line[k : k + 3])
            want += np.roll(a, 2) * np.roll(b, 1) * c
        assert (row == want).all() and ok == any(x.isalpha() for x in text)


# ---------------------------------------------------------------- 5: WARC


def test_archives_are_read_back_and_deterministic(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(k, f"http://h{k % 3}.example/{k}\n", "".join(rnd.choice(["<p>", "é", "x\r\n\r\n", "y"]) for _ in range(rnd.randint(0, 400)))) for k in range(120)]
    rows += [(200 + k, "http://same.example/", "same") for k in range(30)] + [(None, None, None), (300, "u", ""), (301, "u", None), (None, "v", "same"), (7, "w", rows[7][2]), (7, "w", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    names = []
    for k, n in ((0, 3), (1, 5)):
        where = f"file://{tmp_path}/{k}"
        manifest = warc.write(pages.repartition(n), where, roll_bytes=3000, shard_bytes=20_000)
        assert not (tmp_path / str(k) / "_temporary").exists()
        names.append((tmp_path / str(k) / "_MANIFEST").read_text())
        got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(spark, where, manifest).collect())
        last = {}
        for i, _, h in rows:
            last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
        want = Counter()
        for i, _, h in rows:
            body, to = (h or "").encode(), last[h or ""]
            mine = to == (-1 if i is None else i)
            want[(i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if mine else "revisit", None if mine else to)] += 1
        assert got == want
    assert names[0] == names[1] and names[0].count("\n") > 3
    payloads = {r["page_id"]: bytes(r["payload"]) for r in warc.read(spark, f"file://{tmp_path}/0", manifest).where("record_type = 'response' and page_id < 100 and page_id <> 7").collect()}
    assert payloads == {i: h.encode() for i, _, h in rows[:100] if i != 7 and last[h] == i}
    empty = warc.write(pages.limit(0), f"file://{tmp_path}/none")
    assert empty.count() == 0 and warc.read(spark, f"file://{tmp_path}/none", empty).count() == 0


# ---------------------------------------------------------------- 2: HTML


def page(body, nav="<nav><a href=/>Home</a></nav>"):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{nav}<div class='box'>Read our terms</div>{body}<footer>&copy; x</footer></body></html>"


def test_templates_recurring_on_a_host_go_and_articles_stay(spark):
    rows = [(k, "http://a.example/%d" % k, page(f"<div><p>Only {k} &amp; this<p>and\n that {k}</div>")) for k in range(8)]
    rows += [(20 + k, "http://b.example/%d" % k, page(f"<article><h1>Head {k}</h1><p>Same words<div class='ad-box'>buy</div><ul><li>one<li>two</ul><script>1<2</script></article><div id=comments>me too</div>")) for k in range(8)]
    rows += [(40, None, None), (41, "x", ""), (None, "http://c.example/", "<p>a<br>b</p><!-- no --><p>5 < 6 &eacute;"), (42, "http://c.example/", "<div>unclosed <b>bold")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts == {k: f"Only {k} & this\nand that {k}" for k in range(8)} | {20 + k: f"Head {k}\nSame words\none\ntwo" for k in range(8)} | {40: "", 41: "", None: "a b\n5 < 6 é", 42: "unclosed bold"}
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
