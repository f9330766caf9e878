"""Unigram token counts; distinct pre-tokens share a trie of forward scores."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark that opens a word in the vocabulary (a fixed value of its format).
WORD_MARK = "▁"
#: Trie nodes after which a worker starts a new trie: a bound on its memory, not on words.
MOST_NODES = 1_500_000


def pieces(path: str) -> tuple[dict[str, float], float]:
    """Pieces of a sentencepiece vocabulary with log probabilities, and the score of a byte that no piece covers. Ids
    follow frequency, so probabilities follow Zipf's law over the ids."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    norm = log(sum(1 / (rank + 1) for rank in range(len(plain))))
    scores = {model.id_to_piece(i): -log(rank + 1) - norm for rank, i in enumerate(plain)}
    return scores, min(scores.values()) - 10.0


class Trie:
    """Forward scores of the prefixes of pre-tokens.

    A node is a prefix; it has the score and the number of tokens of its best split. They depend on the prefix alone, so
    they are computed when the node is made and then serve every pre-token that starts with it; a word's count is read
    from the node where it ends, and stored. Of equal scores the split with fewer tokens counts. Pieces that end at a
    character are found backwards, in a trie of reversed pieces.
    """

    def __init__(self, scores: dict[str, float], unknown: float):
        self.unknown = unknown
        self.backwards: dict = {}
        for piece, score in scores.items():
            at = self.backwards
            for char in reversed(piece):
                at = at.setdefault(char, {})
            at[""] = score
        self.restart()

    def restart(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.tokens = [0.0], [0]
        self.ends: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        if (known := self.ends.get(word)) is not None:
            return known
        if len(self.score) > MOST_NODES:
            self.restart()
        text = WORD_MARK + word.decode()
        child, score, tokens, node, path = self.child, self.score, self.tokens, 0, [0]
        for i, char in enumerate(text):
            key = node << 21 | ord(char)
            node = child.get(key)
            if node is None:
                best, count, back, j = None, 0, self.backwards.get(char), i
                if back is None or "" not in back:
                    width = len(char.encode())
                    best, count = score[path[i]] + width * self.unknown, tokens[path[i]] + width
                while back is not None:
                    if (piece := back.get("")) is not None:
                        before = path[j]
                        found = score[before] + piece
                        if best is None or found > best or found == best and tokens[before] + 1 < count:
                            best, count = found, tokens[before] + 1
                    if j == 0:
                        break
                    j -= 1
                    back = back.get(text[j])
                node = child[key] = len(score)
                score.append(best)
                tokens.append(count)
            path.append(node)
        self.ends[word] = tokens[node]
        return tokens[node]


_tries: dict[str, Trie] = {}


def counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _tries:
        _tries[path] = Trie(*pieces(path))
    trie = _tries[path]
    for batch in batches:
        words, tokens = [], []
        for text in batch.column("text"):
            split = (text.as_py() or "").encode().split()
            words.append(len(split))
            count = {w: trie.count(w) for w in set(split)}
            tokens.append(sum(map(count.__getitem__, split)))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(words, pa.int64()), pa.array(np.array(tokens, np.int64))], names=["key", "n_words", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_words (pre-tokens) and n_tokens (pieces of the best unigram split of
    each word, opened by the word mark; bytes that no piece covers count one each). The public vocabulary states no
    probabilities, so the scores are assumed: Zipf's law over its ids. Counts are those of the best split by these scores, and
    not of the vocabulary's own tokenizer.

    The work is one pass without a shuffle: a worker keeps its trie from batch to batch. Null, empty and
    blank texts have no tokens; very long texts and words are counted whole. Repeated rows and null or repeated keys are
    counted each. Other columns, whatever their names, are ignored. No rows give no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = rows.mapInArrow(lambda it: counted(it, vocabulary), f"key {kind}, n_words long, n_tokens long")
    return found.withColumnRenamed("key", key)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
