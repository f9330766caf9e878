import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_take_effect(spark, sf):
    from textloom.llm import common

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    before = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.cut(stage(spark, before, sf))
        counts.append(docs.count())
        if i < 3:
            assert docs.columns == columns and docs.exceptAll(before).isEmpty()
        elif i == 3:
            assert docs.columns == columns and docs.distinct().exceptAll(before).isEmpty()
        else:
            assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and counts[-1] == counts[-2]
        before = docs
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0


def brute_pipeline(docs, score, items, accept):
    """The first three stages in plain Python: accepted texts, one of each group of near copies, none that holds an item."""
    from test_dedup_join_leaks import brute

    kept = [r for r in docs if score[r[0]] >= accept]
    group = {k: c for k, c, _ in brute(kept)}
    one = [r for r in kept if group[r[0]] == r[0]]

    def grams(text):
        w = "".join(c if c.isalnum() or c in " \t\n\x0b\x0c\r" else "" for c in (text or "").lower()).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    return sorted(k for k, t in one if not any(len(grams(t) & g) >= 0.8 * len(g) for g in map(grams, items) if g))


def test_stages_equal_brute_force(spark, docs, tmp_path):
    """Each stage takes what the one before kept; the rows after three stages, the words of the mix and the ids of the last
    are those of brute force."""
    import random

    import numpy as np
    import public_tokenizers
    from test_mix_quality_tokens import targets

    from textloom.llm import quality, token_output
    from textloom.llm.common import cut

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    item = " ".join(word() for _ in range(20))
    data = []
    for i in range(240):
        ws = [word() for _ in range(rng.randint(25, 70))]
        data.append((i, " ".join(w.upper() + "!!|" for w in ws) if i % 5 == 0 else " ".join(ws) + "."))
    near = [(1000 + i, data[1][1] + f" end{i}") for i in range(6)] + [(1100, data[2][1])]
    leaks = [(1200 + i, data[3 + i][1] + " " + item.upper() + " " + data[4 + i][1]) for i in range(3)]
    data += near + leaks + [(1300, "x " * 3_000 + "end of a very long text")]
    sf = str(tmp_path)
    df = docs([(k, t, "ab"[k % 2]) for k, t in data])
    df.write.parquet(f"{sf}/documents.parquet")
    clash = "key text_ doc_id_ label_ word h n row item".split()
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, 0, *clash) for i in range(240)], "doc_id long, quality int, toxic int, " + ", ".join(f"{c} string" for c in clash))
    labels.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item, *clash), (None, None, *clash), (2, "", *clash)], "item_id long, text string, " + ", ".join(f"{c} string" for c in clash)).write.parquet(f"{sf}/benchmark.parquet")
    score = {r["doc_id"]: r["score"] for r in quality.score(df, labels).collect()}
    want = brute_pipeline(data, score, [item], quality.ACCEPT)
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    for stage in stages[:3]:
        rows = cut(stage(spark, rows, sf))
    got = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert sorted(got) == want and 100 < len(want) < len(data) - 50 and all(got[k] == t for k, t in data if k in got)
    mixed = cut(stages[3](spark, rows, sf))
    words = lambda frame: {s: sum(len((r["text"] or "").split()) for r in frame if r["source"] == s) for s in "ab"}
    before, after = words(rows.collect()), words(mixed.collect())
    wanted = targets(before)
    assert all(abs(after[s] - wanted[s]) <= 1_510 for s in "ab")  # half of the longest document
    last = stages[4](spark, mixed, sf).collect()
    encoder = token_output.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    import zlib

    ids = lambda t: np.frombuffer(encoder.encode([t])[0], "<u2").astype("<u4")
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in last) == sorted((r["doc_id"], len(ids(r["text"])), zlib.crc32(ids(r["text"]).tobytes())) for r in mixed.collect())
    run = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, last))


def test_stages_take_odd_rows_and_empty_tables(spark, docs, tmp_path):
    from textloom.llm.common import cut

    for name, data in (("odd", [(None, None, None), (None, "a text without a key"), (1, ""), (1, ""), (1, "two"), (2, "w " * 50_000), (3, "two")]), ("empty", [])):
        sf = f"{tmp_path}/{name}"
        docs(data).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        rows = spark.read.parquet(f"{sf}/documents.parquet")
        counts = []
        for _, stage in corpus_pipeline.STAGES:
            rows = cut(stage(spark, rows, sf))
            counts.append(rows.count())
        # of (1, ""), (1, ""), (None, None) one stays, of the two "two" one
        assert counts[:3] == ([7, 4, 4] if data else [0, 0, 0]) and counts[3] == counts[4]
