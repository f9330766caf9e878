from textloom.llm import decontaminate as dc
from textloom.llm import exact_dedup as ed
from textloom.llm import ngram_join as nj
from textloom.llm.common import components

LONG = " ".join(f"w{i}" for i in range(60))


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_exact_dedup_cases(docs):
    df = docs([(1, "a b"), (2, "ab"), (3, "a\tb "), (4, None), (5, ""), (6, " \n"), (7, "x"), (7, "x"), (None, "ab  ")])
    found = ed.exact_dedup(df)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = rows(found, "doc_id", "keep_id", "group_size", "kept")
    # "a\tb " and "ab  " have four code points; the null key comes last
    assert got == sorted([(1, 3, 4, False), (2, 3, 4, False), (3, 3, 4, True), (None, 3, 4, False), (4, 6, 3, False), (5, 6, 3, False), (6, 6, 3, True), (7, 7, 2, False), (7, 7, 2, True)], key=repr)


def test_exact_dedup_heavy_and_light_agree(docs):
    df = docs([(i, "copy " * 3) for i in range(300)] + [(1000 + i, f"t{i // 2}") for i in range(200)])
    for heavy, counters in ((1, 64), (256, 4096)):
        assert rows(ed.exact_dedup(df, heavy=heavy, counters=counters), "doc_id", "keep_id", "group_size", "kept") == rows(ed.exact_dedup(df), "doc_id", "keep_id", "group_size", "kept")
    assert ed.exact_dedup(docs([])).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)], "a int, b int")
    found = dict(rows(components(edges), "node", "label"))
    assert all(found[i] == 0 for i in range(41)) and found[100] == found[101] == 100


def brute(texts, n=5, least=0.8):
    def grams(t):
        w = (t or "").split()
        return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])

    sets = [grams(t) for _, t in texts]
    close = lambda a, b: a == b or len(a & b) >= least * len(a | b) - 1e-9
    label = list(range(len(texts)))
    links = [sum(close(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if close(a, b):
                    label[i] = label[j] = min(label[i], label[j])
    least_key = {}
    for (k, _), c in zip(texts, label, strict=True):
        least_key[c] = min(least_key.get(c, k), k)
    return sorted(((k, least_key[c], n) for (k, _), c, n in zip(texts, label, links, strict=True)), key=repr)


def near_copies():
    words = LONG.split()
    out = [(i, " ".join([*words[: i % 50], f"edit{i}", *words[i % 50 :]])) for i in range(24)]
    out += [(100, LONG), (101, LONG + "  "), (102, "one two"), (103, "one  two"), (104, "one three"), (105, None), (106, ""), (107, " ".join(f"z{i}" for i in range(3000))), (100, LONG)]
    return out


def test_ngram_join_equals_brute_force(docs):
    texts = near_copies()
    for block in (512, 5):  # one block, and many that must find the same pairs
        assert rows(nj.classes(docs(texts), block=block), "doc_id", "class_id", "n_links") == brute(texts)
    assert nj.classes(docs([])).count() == 0


def test_one_of_each(docs):
    df = docs(near_copies() + [(None, "only one with a null key here")])
    kept = nj.one_of_each(df)
    assert kept.columns == df.columns
    assert rows(kept, "doc_id") == sorted([(0,), (102,), (104,), (105,), (107,), (None,)], key=repr)


def test_rows_without_or_of_one_key_are_judged_each(spark, docs):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    near = texts[0] + " end"
    data = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, near), (5, texts[2]), (5, texts[3]), (5, texts[3]), (6, texts[3]), (None, texts[2]), (7, None), (7, "")]
    kept = [tuple(r) for r in nj.one_of_each(docs(data)).select("doc_id", "text").collect()]
    assert sorted(k for k, t in kept if k == 5) == [5, 5] and {t for k, t in kept if k == 5} == {texts[2], texts[3]}
    free = [t for k, t in kept if k is None]
    assert len(free) == 2 and texts[1] in free and (texts[0] in free or near in free)
    assert len([k for k, _ in kept if k == 7]) == 1 and len(kept) == 5
    items = spark.createDataFrame([(1, texts[4])], "item_id long, text string")
    data = [(None, texts[0]), (None, "x " + texts[4]), (None, texts[1]), (5, texts[2]), (5, texts[4] + " y"), (6, texts[3]), (None, None)]
    left = [tuple(r) for r in dc.decontaminate(docs(data), items).select("doc_id", "text").collect()]
    assert sorted(left, key=repr) == sorted([(None, texts[0]), (None, texts[1]), (5, texts[2]), (6, texts[3]), (None, None)], key=repr)
    halves = [(9, texts[4][:100]), (9, texts[4][100:])]  # no row holds the item
    assert dc.decontaminate(docs(halves), items).count() == 2


def test_banding_meets_recall():
    for recall in (0.99, 0.99999):
        bands, r = nj.banding(0.8, recall)
        assert 1 - (1 - 0.8**r) ** bands >= recall and bands * r <= 128


def test_containment_cases(spark, docs):
    item = " ".join(f"q{i}" for i in range(30))
    part = " ".join(item.split()[:26])
    items = spark.createDataFrame([(1, item), (2, "two words"), (3, None), (4, ""), (5, "never seen before in any of these")], "item_id long, text string")
    df = docs([(1, LONG + " " + item + " " + LONG), (2, part), (3, " ".join(item.split()[:20])), (4, "these two words here"), (5, None), (6, ""), (7, item), (7, item), (None, item), (8, item.upper().replace(" ", "!! "))])
    found = dc.contained(df, items)
    assert rows(found, "doc_id", "item_id", "shared", "item_shingles") == sorted([(1, 1, 26, 26), (2, 1, 22, 26), (4, 2, 1, 1), (7, 1, 26, 26), (8, 1, 26, 26), (None, 1, 26, 26)], key=repr)
    left = dc.decontaminate(df, items)
    assert left.columns == df.columns and rows(left, "doc_id") == [(3,), (5,), (6,)]
    assert dc.contained(docs([]), items).count() == 0 and dc.contained(df, items.limit(0)).count() == 0


def test_sketch_sizes():
    assert dc.sketch_size(1) == 1 and dc.sketch_size(8) == 2  # all but one of the few that can be missing
    assert all(dc.sketch_size(2**p) <= 12 for p in range(20))


def test_blocks_are_bounded_by_bytes(spark, docs, monkeypatch):
    from textloom.llm import ngram_join

    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:-1] + [f"x{i}"])) for i in range(40)] + [(100 + i, " ".join(f"y{i}-{j}" for j in range(50))) for i in range(5)]
    expected = sorted(map(tuple, ngram_join.classes(docs(rows)).drop("th").collect()))
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(ngram_join.chunked, "__defaults__", (2000,))
    assert sorted(map(tuple, ngram_join.classes(docs(rows)).drop("th").collect())) == expected
