"""Token counts by dynamic programming shared over a trie of pre-tokens.

A unigram model cuts a pre-token into the pieces of greatest total score. The
best score of a prefix depends on the prefix alone, so the distinct pre-tokens
of a chunk of texts are inserted in a trie, the forward scores are computed
once per trie node, and the counts at the terminals are stored; a document's
count is the sum over its words. The trie is walked in sorted order, so only
the path to the current node is held. Terminal counts are remembered over a
worker's chunks up to a bound.

The pieces come from a public tokenizer's vocabulary file; a piece's score is
the logarithm of a Zipf law in its rank, as the file lists pieces by
frequency. A pre-token is the mark U+2581 and a word, a run without ASCII
blanks. A character that no piece covers falls back to its UTF-8 bytes, a
token each, at the least score. Equal scores prefer fewer tokens.

Defined cases: null and empty texts have no tokens; words of any length are
counted whole; rows and other columns stay, names added replace others; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, types as T

from .common import hidden, importable, remembered, shown, texts_of

MARK = "▁"
#: Terminal counts that a Python worker remembers, and words that it takes
#: into one trie.
CACHE_WORDS, CHUNK_WORDS = 300_000, 1 << 17


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log-probability of each piece by its rank."""
    total = sum(1 / (r + 2.7) for r in range(len(pieces)))
    return {p: -math.log((r + 2.7) * total) for r, p in enumerate(pieces)}


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, by rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class TrieCounter(dict):
    """Token count of a word (bytes), for all words that were inserted."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.tails = {p[i:] for p in scores for i in range(len(p))}  # no piece ends in anything else
        self.least = min(scores.values(), default=0.0) - 10.0

    def insert(self, words) -> None:
        """Counts the distinct words not yet known."""
        new = sorted({w.decode() for w in words if w not in self})
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = sorted({w.decode() for w in words})
        path, best = "", [(0.0, 0)]  # forward state of each prefix on the path
        get, tails = self.scores.get, self.tails
        for word in new:
            token = MARK + word
            shared = 0
            for a, b in zip(path, token):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:]
            for i in range(shared + 1, len(token) + 1):
                score, count = best[i - 1]
                size = len(token[i - 1].encode())
                top, n = score + size * self.least, count + size
                for j in range(i - 1, -1, -1):
                    piece = token[j:i]
                    if piece not in tails:
                        break
                    s = get(piece)
                    if s is not None:
                        s += best[j][0]
                        if s > top or s == top and best[j][1] + 1 < n:
                            top, n = s, best[j][1] + 1
                best.append((top, n))
            path = token
            self[word.encode()] = best[-1][1]


def counter(path: str) -> TrieCounter:
    return remembered(("trie", path), lambda: TrieCounter(zipf_scores(vocabulary(path))))


def _file(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text") -> DataFrame:
    """``docs`` with n_words and n_tokens. ``model`` names a sentencepiece file
    that every executor can open, or a public_tokenizers file name."""
    importable(docs.sparkSession)
    docs, names = hidden(docs)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    at = docs.columns.index(names[text])

    def run(batches):
        import pyarrow as pa

        trie = counter(_file(model))
        for batch in batches:
            n_words, n_tokens, waiting, size = [], [], [], 0

            def flush():
                trie.insert({w for words in waiting for w in words})
                n_tokens.extend(sum(map(trie.__getitem__, words)) for words in waiting)

            for t in texts_of(batch.column(at)):
                words = (t or b"").split()
                n_words.append(len(words))
                waiting.append(words)
                size += len(words)
                if size >= CHUNK_WORDS:
                    flush()
                    waiting, size = [], 0
            flush()
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=[f.name for f in schema])

    return shown(docs.mapInArrow(run, schema), names, "n_words", "n_tokens")
