"""Merkle manifest, WARC archives and token alignment against plain Python on small tables."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

merkle = pytest.importorskip("textloom.llm.merkle")
from textloom.llm import token_alignment, warc  # noqa: E402
from textloom.llm.common import shared_folder  # noqa: E402

PAGES = "page_id long, url string, html string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(nodes):
    """(root, siblings by leaf as (left, right) texts from below to above)"""
    paths, level, members = [[] for _ in nodes], nodes, [[i] for i in range(len(nodes))]
    while len(level) > 1:
        up, groups = [], []
        for at in range(0, len(level), 8):
            run = level[at : at + 8]
            for k in range(len(run)):
                for i in members[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(run))
            groups.append(sum(members[at : at + 8], []))
        level, members = up, groups
    return level[0], paths


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_manifest(rows):
    by_lang = {}
    for doc_id, text, lang, source, n in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        fields = (doc_id, source, lang, n)
        by_lang.setdefault(lang, []).append((doc_id, leaf_of((*fields, text)), leaf_of((*fields, lowered(text) if hit else text))))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = tree([r[1] for r in by_lang[lang]])
    root, tops = tree([trees[x][0] for x in langs])
    found = []
    for lang, top in zip(langs, tops, strict=True):
        for (doc_id, leaf, changed), path in zip(by_lang[lang], trees[lang][1], strict=True):
            folded = changed
            for left, right in path + top:
                folded = h((left, folded, right))
            found.append((doc_id, leaf, trees[lang][0], root, h(a + b for a, b in path + top), folded, folded == root))
    return sorted(found, key=repr)


def manifest_of(df):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf(*fields, F.translate("text", merkle.CAPITALS, merkle.LOWER)))
    return sorted((tuple(r) for r in merkle.manifest(df, "doc_id", "lang", merkle.leaf(*fields, F.col("text")), changed).collect()), key=repr)


CLASHING = "key tree digest place n row block path over root subroot part spot tampered leaf".split()


def test_manifest_of_odd_rows(spark):
    texts = [None, "", "Aé\n", "plain", "X" * 300_000, "ÀÉ", "Ab"]
    rows = [(i % 29 if i % 13 else None, texts[i % 7], [None, "", "de", "en", "z"][i % 5] if i % 3 else "en", None if i % 6 == 0 else "s", i % 4 or None) for i in range(90)]
    rows += rows[:20]  # repeated
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in CLASHING})
    assert manifest_of(df.repartition(3)) == brute_manifest(rows)


@pytest.mark.parametrize("n", [1, 8, 9])
def test_manifest_of_one_tree(spark, n):
    rows = [(i, f"T{i}", "en", "s", 2) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest_of(df) == brute_manifest(rows)


def test_manifest_of_several_stories_of_blocks(spark):
    rows = [(i * 7 % 9001, f"T{i % 11}", "en" if i % 3000 else "fr", "s", 2) for i in range(9001)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest_of(df) == brute_manifest(rows)


def test_manifest_of_no_rows(spark):
    assert manifest_of(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")) == []


def brute_warc(rows):
    best = {}
    for i, (page_id, _, html) in enumerate(rows):
        raw = (html or "").encode()
        if len(raw) >= 1000:
            best[raw] = max(best.get(raw, (False, 0, 0, 0)), (page_id is not None, page_id or 0, -i, i))
    found = []
    for i, (page_id, _, html) in enumerate(rows):
        raw = (html or "").encode()
        first = best.get(raw, (0, 0, 0, i))[3]
        found.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "response" if first == i else "revisit", None if first == i else rows[first][0]))
    return sorted(found, key=repr)


def archives(spark, rows, **conf):
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(1) for c in "key row same winner refers sha1 payload_bytes file at to size n".split()})
    folder = f"{shared_folder(spark)}/warc-test-{id(rows)}"
    return folder, warc.write_archives(df.coalesce(1), folder, **conf)


INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Payload-Digest: sha1:0\r\nContent-Length: {}\r\n\r\nHTTP/1.1 200 OK\r\n\r\nfalse\r\n\r\n"


def odd_pages():
    inner = INNER.format(24)
    texts = [None, "", "a" * 999, "b" * 1000, "é" * 500, inner, inner * 40, INNER.format(0) * 30, "WARC/1.1\r\n" * 200, "WARC/1.1\r\nContent-Length: 9", "x" * 9000, "WARC/1.1\r\n" + "X: y\r\n" * 300, INNER.format(10**17), "\r\n\r\n" * 300]
    rows = [(i if i % 9 else None, None if i % 5 == 0 else f"http://h/{'ü ' * (i % 3)}\r\nWARC-Type: x{i}" + "p" * (i % 4 * 3000), texts[i % len(texts)]) for i in range(70)]
    return rows + rows[20:30]


@pytest.mark.parametrize("chunk", [300, 4096, 8 << 20])
def test_archives_round_trip(spark, chunk):
    rows = odd_pages()
    folder, manifest = archives(spark, rows, file_bytes=40_000)
    assert manifest.count() > 2
    found = warc.read_archives(manifest, folder, payload=False, chunk=chunk).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == brute_warc(rows)


def test_archives_give_payloads_back(spark):
    rows = odd_pages()
    folder, manifest = archives(spark, rows)
    found = warc.read_archives(manifest, folder, chunk=1000).where("record_type = 'response'").collect()
    assert {bytes(r.payload) for r in found} == {(html or "").encode() for _, _, html in rows}


def test_damaged_archive_is_an_error(spark):
    folder, manifest = archives(spark, odd_pages())
    with pytest.raises(ValueError, match="do not reach"):
        warc.entries(manifest.withColumn("size", F.col("size") - 3), folder, 1000)


def test_no_pages(spark):
    folder, manifest = archives(spark, [])
    assert manifest.count() == 0
    assert warc.read_archives(manifest, folder).count() == 0


@pytest.fixture(scope="module")
def paths():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def brute_alignment(paths, rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tool_a, tool_b = Tokenizer.from_file(paths[0]), SentencePieceProcessor(model_file=paths[1])
    tool_a.encode_special_tokens = True
    letters = token_alignment.byte_letters()

    def bytes_b(i):
        piece = tool_b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if tool_b.is_byte(i) else piece.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for _, text in rows:
        groups, links, a, b = [], [], [], []
        if text:
            a, b = tool_a.encode(" " + text, add_special_tokens=False).ids, tool_b.encode(text)
            raw_a, raw_b = [bytes(letters[c] for c in tool_a.id_to_token(i)) for i in a], [bytes_b(i) for i in b]
            if b"".join(raw_a) == (" " + text).encode() == b"".join(raw_b):
                owners = list(zip([i for i, r in enumerate(raw_a) for _ in r], [j for j, r in enumerate(raw_b) for _ in r], strict=True))
                group = ([], [])
                for k, (i, j) in enumerate(owners):
                    if k and i != owners[k - 1][0] and j != owners[k - 1][1]:
                        groups.append(group)
                        group = ([], [])
                    if k == 0 or owners[k - 1] != (i, j):
                        links.append((a[i], b[j]))
                    for side, x in zip(group, (i, j), strict=True):
                        if x not in side:
                            side.append(x)
                groups.append(group)
            else:
                a = b = []
        docs.append((a, b, groups, links))
        counts.update(links)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    found = []
    for (key, _), (a, b, groups, links) in zip(rows, docs, strict=True):
        line = ";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[j]) for j in y) for x, y in groups)
        found.append((key, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(line.encode()).hexdigest() if a else ""))
    return sorted(found, key=repr)


def hostile(n, seed=7):
    import random

    random.seed(seed)
    pool = [*"ab c  \n\t\r'sé▁<>0x|2.!?—日本\xa0　\x85 \x1c\x1d​ ñ\x00\x0b😀", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "'ll", " 's", "   ", "\n\n", "the ", " of", "ABC"]
    return ["".join(random.choice(pool) for _ in range(random.randint(0, 40))) for _ in range(n)]


def test_alignment_of_hostile_texts(spark, docs, paths, monkeypatch):
    texts = [None, "", " ", "  ", "\n", "the same", "the same", "word " * 3000, "no" * 9000, *hostile(600)]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)]
    found = token_alignment.align_tokens(docs(rows).repartition(3), *paths)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_alignment(paths, rows)


def test_segments_give_the_tokens_of_whole_texts(paths):
    splitter = token_alignment.Splitter(*paths)
    texts = [t for t in hostile(4000, 11) if t]
    (a, n_a), _ = splitter.encode(texts)
    ends = n_a.cumsum()
    for text, end, n in zip(texts, ends, n_a, strict=True):
        if n:
            assert a[end - n : end].tolist() == splitter.a.encode(" " + text, add_special_tokens=False).ids


def test_alignment_of_blank_and_no_rows(spark, docs, paths):
    assert [tuple(r)[1:] for r in token_alignment.align_tokens(docs([(1, None), (2, "")]), *paths).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert token_alignment.align_tokens(docs([(1, "a")]).where("false"), *paths).count() == 0
