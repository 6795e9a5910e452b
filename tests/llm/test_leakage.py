import random

import numpy as np

from lumenspar.llm import leakage as L

WORDS = [a + b for a in ("ka", "mo", "tir", "ves", "lun", "por", "zel", "qui") for b in ("na", "dor", "lis", "ven", "tu", "mak", "sor", "bel")]


def test_words():
    assert L.words("Thé <b>qui</b>ck<br>Brown_Fox, jumps­ over​ **13**  dogs &amp; cats") == ["the", "quick", "brown", "fox", "jumps", "over", "13", "dogs", "cats"]
    assert L.words("") == [] and L.words("…!?") == []


def test_lcs_and_runs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.choice("abcd") for _ in range(rng.randrange(12))], [rng.choice("abcd") for _ in range(rng.randrange(12))]
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        r = 0
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                    k += 1
                r = max(r, k)
        assert L.lcs(a, b) == t[-1, -1] and L.longest_run(a, b) == r


def test_spans_hold_every_run():
    for n in range(1, 120):
        w = L.spans(n, 24, 12)
        for s in range(max(0, n - 11)):
            assert any(a <= s and s + 12 <= b for a, b in w)
        v = L.spans(n, 18, 6)
        for s in range(max(0, n - 11)):
            assert any(a <= s and s + 12 <= b for a, b in v)


def test_recall_is_whole_and_paraphrases_are_reported(spark):
    rng = random.Random(7)
    say = lambda n: [rng.choice(WORDS) + rng.choice(["", str(rng.randrange(900))]) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([40, 90]))), None if i % 3 else f"answer{i}") for i in range(60)] + [(60, None, None), (61, "too short", None)]
    docs, want = [], set()
    for d in range(400):
        text = say(rng.choice([0, 30, 120]))
        if d % 4 == 0:
            i, p, _ = items[rng.randrange(60)]
            w = p.split()
            n = rng.choice([11, 12, 15, 30])
            s = rng.randrange(len(w) - n)
            at = rng.randrange(len(text) + 1)
            text[at:at] = w[s : s + n]
        sep = rng.choice([" ", "\n", " <br>", ", "])
        docs.append((d, sep.join(text).upper() if d % 3 else sep.join(text), "k"))
    docs += [(1000, None, "k"), (1001, "", "k"), docs[0], (1002, " ".join(say(60_000)) + " " + items[3][1], "k")]
    grams = {}
    for i, p, _ in items:
        w = L.words(p or "")
        for a in range(len(w) - 11):
            grams.setdefault(tuple(w[a : a + 12]), set()).add(i)
    for d, t, _ in docs:
        w = L.words(t or "")
        for a in range(len(w) - 11):
            want |= {(d, i) for i in grams.get(tuple(w[a : a + 12]), ())}
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame(items, "item_id bigint, passage string, answer string")
    hd = L.hashed(df, "text", "doc_id")
    f = L.LeakFinder.fit(hd, it)
    got = {tuple(r) for r in f.verbatim(hd).collect()}
    assert got == want and (1002, 3) in got
    small = L.LeakFinder.fit(hd, it, block_items=7)  # in several blocks
    assert len(small.blocks) > 5 and {tuple(r) for r in small.verbatim(hd).collect()} == want
    para = items[5][1].split()[:36]
    para[5::9] = ["changed"] * len(para[5::9])
    p = spark.createDataFrame([(1, " ".join(para) + " answer5", "k")], "doc_id bigint, text string, item_id string")
    r = [x for x in f.report(L.hashed(p, "text", "doc_id")).collect() if x["item_id"] == 5]
    assert r and r[0]["longest_run"] < 12 and r[0]["lcs"] >= 0.8
    assert f.verbatim(hd.where("false")).count() == 0


def test_recall_of_paraphrases_against_brute_force(spark):
    """Of all window pairs whose words are the same for 80 %, in order, the cells must find at least nine in ten."""
    rng = random.Random(5)
    word = lambda: WORDS[min(len(WORDS) - 1, int(rng.expovariate(0.08)))] + rng.choice(["", "", str(rng.randrange(40))])
    items = [(i, " ".join(word() for _ in range(72)), None) for i in range(300)]
    docs, planted = [], set()
    for d in range(600):
        text = [word() for _ in range(60)]
        if d % 2:
            i = rng.randrange(300)
            part = items[i][1].split()[18:54]
            for x in rng.sample(range(36), 6):  # six words in 36 replaced, dropped or doubled
                part[x] = rng.choice([word(), "", part[x] + " " + word()])
            text[20:20] = part
            planted.add((d, i))
        docs.append((d, " ".join(text)))
    hd = L.hashed(spark.createDataFrame(docs, "doc_id bigint, text string"), "text", "doc_id")
    it = spark.createDataFrame(items, "item_id bigint, passage string, answer string")
    f = L.LeakFinder.fit(hd, it)
    assert len(f.blocks[0].cells) > 4 * f.probes
    full = L.LeakFinder(f.table, f.blocks, f.run, f.cosine, 1 << 30)  # every cell
    pick = lambda x: {(r["doc_id"], r["item_id"]) for r in x.report(hd, similar=0.6, common=0.6).collect()}
    got, brute = pick(f), pick(full)
    assert got <= brute and len(got) >= 0.9 * len(brute)
    assert len(got & planted) >= 0.9 * len(planted)


def test_empty_sides(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    it = spark.createDataFrame([(1, "a b c", None), (None, "x y", None)], "item_id bigint, passage string, answer string")
    hd = L.hashed(d, "text", "doc_id")
    assert L.LeakFinder.fit(hd, it, rank=8).verbatim(hd).count() == 0
    one = L.hashed(spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "...")], "doc_id bigint, text string"), "text", "doc_id")
    f = L.LeakFinder.fit(one, it.where("false"), rank=8)
    assert f.verbatim(one).count() == 0 and f.report(one).count() == 0
    assert L.LeakFinder.fit(one, it, rank=8).report(one).count() == 1  # the three words of item 1 are its whole window
