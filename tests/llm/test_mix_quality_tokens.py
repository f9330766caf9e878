import random
import tempfile
import zlib

import numpy as np
import pytest

from textloom.llm import mixing as m
from textloom.llm import quality as q
from textloom.llm import token_counts as tc
from textloom.llm import token_output as to
from textloom.llm.tokenfile import Reader, Writer, key_bytes, key_value

tokenizers = pytest.importorskip("public_tokenizers")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def corpus():
    rng = random.Random(3)
    sources = [None, "b", "a", "ä", "big"]
    return [(i, " ".join(["w"] * rng.choice([1, 3, 20, 60])), "big" if i % 3 == 0 else sources[i % 5]) for i in range(600)] + [(900, None, "a"), (901, "", "b"), (902, " \n", None)]


def targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    stopped: set = set()
    while True:
        left = sum(sizes.values()) - sum(cap * sizes[s] for s in stopped)
        free = sum(w[s] for s in order if s not in stopped)
        t = {s: cap * sizes[s] if s in stopped else w[s] * left / free for s in order}
        over = {s for s in order if t[s] > cap * sizes[s] + 1e-9}
        if not over:
            return t
        stopped |= over


def test_mix_targets_and_draws(docs):
    data = corpus()
    df = docs(data)
    size = {k: len((t or "").split()) for k, t, _ in data}
    source = {k: s for k, _, s in data}
    sums: dict = {}
    for k, s in source.items():
        sums[s] = sums.get(s, 0) + size[k]
    wanted = targets(sums)
    got = m.taken(df, block_words=300, shards=7).collect()
    assert len(got) == len(data)
    took: dict = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[s] and abs(r["target"] - wanted[s]) < 1e-6
        assert r["taken"] <= 3 * r["size"]
        took[s] = took.get(s, 0) + r["taken"]
    assert all(abs(took[s] - wanted[s]) <= 40 for s in sums)
    assert rows(m.taken(df, block_words=300, shards=7), "doc_id", "taken") == rows(m.taken(df, block_words=300, shards=7), "doc_id", "taken")
    mixed = m.mix(df, block_words=300, shards=7)
    assert mixed.columns == df.columns  # docs have a column shard of their own here
    drawn: dict = {}
    for r in mixed.collect():
        drawn[r["doc_id"]] = drawn.get(r["doc_id"], 0) + 1
    assert all(drawn.get(r["doc_id"], 0) * r["size"] == r["taken"] for r in got)
    assert all(drawn.get(r["doc_id"], 0) == len(r["shards"]) <= 3 for r in got)  # also without words
    in_shard: dict = {}
    for r in got:
        for x in r["shards"]:
            in_shard[x] = in_shard.get(x, 0) + r["size"]
    assert set(in_shard) == set(range(7)) and max(in_shard.values()) < 2 * sum(took.values()) / 7


def test_mix_of_one_source_takes_no_text_a_fourth_time(docs):
    """One source of all words has a target of its own size; a text without words goes along once at most."""
    got = m.taken(docs([(1, "a b", "x"), (2, "", "x"), (3, None, "x"), (None, "c " * 50_000, "y")])).collect()
    assert all(len(r["shards"]) <= 3 and r["taken"] == r["size"] * len(r["shards"]) for r in got)


def test_mix_without_words(docs):
    assert m.taken(docs([])).count() == 0 and m.mix(docs([])).count() == 0
    assert rows(m.taken(docs([(1, None), (2, "")])), "doc_id", "size", "target", "taken") == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_splitting_tree_deals_every_draw_once():
    import pandas as pd

    leaves = pd.concat(m.split_quotas(iter([pd.DataFrame({"id": range(9)})]), [1, 2, 5], [40, 7, 100], 9, 1))
    for sid, n in ((1, 40), (2, 7), (5, 100)):
        own = leaves[leaves.sid == sid].sort_values("first")
        assert [x for f, k in zip(own["first"], own["quota"], strict=True) for x in range(f, f + k)] == list(range(n))
    assert leaves.groupby("shard")["quota"].sum().between(16, 17).all()


def test_quality_learns_and_leaves_held_out_labels(spark, docs):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    data = []
    for i in range(400):
        ws = [word() for _ in range(rng.randint(20, 60))]
        data.append((i, " ".join(w.upper() + "!!" for w in ws) if i % 4 == 0 else " ".join(ws) + "."))
    data += [(900, None), (901, ""), (None, "no key at all")]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(400)] + [(3, None, 0), (5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in q.score(docs(data), labels).collect()}
    assert len(got) == len(data)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if i is not None and got[i]["held_out"]} - {900, 901} == set(held)
    assert sum(got[i]["predicted"] == (i % 4 != 0) for i in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert q.accepted(docs(data), labels).columns == docs(data).columns
    assert {r["score"] for r in q.score(docs(data), labels.limit(0)).collect()} == {0.5}
    assert q.score(docs([]), labels).count() == 0


def test_compiled_rules_equal_rules_in_python(spark, docs):
    """The statistics of texts by plain Python, and the score by walking the rules, are those of the columns."""
    import math
    import re

    rng = random.Random(6)
    texts = ["".join(rng.choice("abcXY 12.,!|#\n ") for _ in range(rng.randint(0, 120))) for _ in range(60)] + [None, "", "the the cat", "a | b |", "é É x"]
    df = docs(list(enumerate(texts)))
    rows, names = q.with_statistics(df.select("doc_id", "text"), "text")

    def stats(t):
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if x.strip(" ")]
        over = lambda part, whole: part / whole if whole else 0.0
        return {
            "log_chars": math.log1p(len(t)), "log_words": math.log1p(len(ws)), "word_length": over(sum(map(len, ws)), len(ws)), "upper": over(sum(c.isupper() for c in t), len(t)),
            "symbols": over(sum(c in "#$%&*|<>{}=_~^@\\/+!" for c in t), len(t)), "marks": over(sum(c in ".,;:?" for c in t), len(t)), "digits": over(sum(c in "0123456789" for c in t), len(t)),
            "bars": over(ws.count("|"), len(ws)), "odd_ends": over(sum(w[-1] in "!#$%&*|<>=+~^_" for w in ws), len(ws)), "distinct_words": over(len(set(ws)), len(ws)),
            "short_words": over(sum(len(w) <= 3 for w in ws), len(ws)), "distinct_lines": over(len(set(lines)), len(lines)), "line_words": over(len(ws), len(lines)),
        }

    found = {r["doc_id"]: r.asDict() for r in rows.drop("text").collect()}
    for i, t in enumerate(texts):
        for k, v in stats(t).items():
            assert abs(found[i][f"s_{k}"] - v) < 1e-9, (k, t)
    label = {i: int(v["s_upper"] < 0.1) for i, v in found.items()}
    labelled = rows.join(spark.createDataFrame(list(label.items()), "doc_id int, label int"), "doc_id")
    model = q.fit(labelled.select("label", *names), names)
    assert model.weights
    got = {r["doc_id"]: r["p"] for r in rows.select("doc_id", model.score().alias("p")).collect()}
    for i, v in found.items():
        logit = model.intercept + sum(w for rule, w in model.weights.items() if all((v[n] <= at) == most for n, most, at in rule))
        assert abs(got[i] - 1 / (1 + math.exp(-logit))) < 1e-9


def test_token_counts_equal_brute_force(docs):
    path = tokenizers.path("piece_bpe_32k.model")
    scores, unknown = tc.pieces(path)

    def best(word):
        f = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            width = len(word[i - 1].encode())
            options = [(f[i - 1][0] + width * unknown, -f[i - 1][1] - width)] + [(f[j][0] + scores[word[j:i]], -f[j][1] - 1) for j in range(i) if word[j:i] in scores]
            s, n = max(options)
            f.append((s, -n))
        return f[-1][1]

    texts = [(1, "the quick the"), (2, None), (3, ""), (4, " \n\t"), (5, "été 漢字 ☃ x̂ " * 3), (5, "again"), (None, "a" * 300), (6, "word " * 100_000)]
    want = [(k, len((t or "").encode().split()), sum(best(tc.WORD_MARK + w.decode()) for w in (t or "").encode().split())) for k, t in texts]
    assert rows(tc.token_counts(docs(texts), path), "doc_id", "n_words", "n_tokens") == sorted(want, key=repr)
    assert tc.token_counts(docs([]), path).count() == 0


def test_trie_restart_changes_no_count(monkeypatch):
    scores, unknown = tc.pieces(tokenizers.path("piece_bpe_32k.model"))
    words = [f"word{i % 50}ing".encode() for i in range(200)]
    whole = [tc.Trie(scores, unknown).count(w) for w in words]
    monkeypatch.setattr(tc, "MOST_NODES", 20)
    trie = tc.Trie(scores, unknown)
    assert [trie.count(w) for w in words] == whole


ODD = ["a b  ćd ́x e<|endoftext|>f <|startoftext|> HİΣ", "", "  \n", None, "it's don't 'S 123 4  5", "ᄀ ᅡᆨ ffiﬃ \u0085 x\x1cy", "µm ªº x×y ÷ ÀÉß. a.b, (x) x)) |||", "x" * 5000, "don's l'été d'Ê'll ''s !'s", "ÀÉÞß, Ø! ×a ÷b ÿ? <|STARTOFTEXT|> <|startoftext|>, A,b B., ,a Ã. a\u0301, É\u0301!"]


def test_words_give_the_ids_of_the_whole_text(monkeypatch):
    path = tokenizers.path("word_bpe_49k.json")
    for kept in (to.KEPT_PIECES, 3):
        monkeypatch.setattr(to, "KEPT_PIECES", kept)
        encoder = to.Encoder(path)
        for text, ids in zip(ODD, encoder.encode(ODD), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_token_files_round_trip(spark, docs):
    path = tokenizers.path("word_bpe_49k.json")
    data = [(i * 7 % 50 - 10, t) for i, t in enumerate(ODD * 4)] + [(None, "null key"), (3, "twice"), (3, "twice")]
    folder, manifest = to.write_tokens(docs(data), path, shards=4)
    got = to.read_tokens(folder, manifest).collect()
    assert len(got) == len(data)
    encoder = to.Encoder(path)
    want, start = [], 0
    for k, t in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = np.frombuffer(encoder.encode([t])[0], "<u2").astype(int).tolist()
        want.append((k, start, len(ids), ids))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids"]) for r in got), key=lambda r: r[1]) == want
    found = to.lookup(folder, manifest, [3, 4, 999]).collect()
    assert sorted((r["key"], r["ids"]) for r in found) == sorted((k, ids) for k, _, _, ids in want if k in (3, 4))
    folder, manifest = to.write_tokens(docs([]), path)
    assert to.read_tokens(folder, manifest, digest=True).count() == 0


def test_rows_of_one_key_fill_several_shards(spark, docs):
    data = [(None, f"{i:03} text without a key") for i in range(400)]
    folder, manifest = to.write_tokens(docs(data), tokenizers.path("word_bpe_49k.json"), shards=4)
    entries = [r["entries"] for r in manifest.collect()]
    assert len(entries) > 1 and sum(entries) == 400 and max(entries) < 300
    encoder = to.Encoder(tokenizers.path("word_bpe_49k.json"))
    got = sorted(to.read_tokens(folder, manifest).collect(), key=lambda r: r["start"])
    assert [r["ids"] for r in got] == [np.frombuffer(encoder.encode([t])[0], "<u2").astype(int).tolist() for _, t in data]


def test_table_file_blocks_and_lookup():
    file = tempfile.TemporaryFile()
    writer = Writer(file, 2)
    keys = list(range(-300, 3000, 3))
    for k in keys:
        writer.add(key_bytes(k), np.arange(k % 200, dtype="<u2").tobytes())
    writer.add(key_bytes(2997), b"\x05\x00")
    writer.close()
    reader = Reader(file, file.tell())
    assert len(reader.blocks) > 2
    assert [key_value(k) for k, _, _ in reader] == [*keys, 2997]
    assert [len(x) for x in reader.get(key_bytes(2997))] == [2997 % 200, 1]
    assert reader.get(key_bytes(1)) == [] and len(reader.get(key_bytes(-300))[0]) == -300 % 200
    file.seek(100)
    file.write(b"\xff\xff")
    with pytest.raises(ValueError):
        list(Reader(file, file.seek(0, 2)).block(0))


def test_more_draws_than_the_generator_takes():
    quota = np.array([10**12, 3 * 10**11, 7, 0, 5 * 10**9], np.int64)
    total, out = int(quota.sum()), []
    for take in (0, 5, total // 3, total - 5, total):
        got = m.dealt_draws(np.random.default_rng([1, take % 97]), quota, take)
        assert got.sum() == take and (got >= 0).all() and (got <= quota).all()
        out.append(got)
    assert abs(out[2][0] / quota[0] - 1 / 3) < 1e-4
    again = m.dealt_draws(np.random.default_rng([1, (total // 3) % 97]), quota, total // 3)
    assert (again == out[2]).all()
