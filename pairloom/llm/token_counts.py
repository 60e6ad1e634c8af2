"""Token counts of a unigram tokenizer: count-only Viterbi over Aho-Corasick matches.

The automaton lists the vocabulary pieces that end at each character; the dynamic programme carries, for each prefix, the
best score and the number of tokens on the best path, and keeps no back pointers. Ties as in the ``tokenizers``
library's Unigram model: of equal scores the path whose last piece is longest wins (it is met first), a character that no
piece covers is an unknown one at the lowest score less 10, and is written as its UTF-8 bytes.

Normalisation: "▁" is put in front and each space becomes "▁". No piece holds "▁" behind another character, and
none holds certain white space at all, so a text splits there without changing any path, and each worker keeps
the counts of the stretches it has met.

Public files hold BPE vocabularies only and tokenizers are never trained here; the vocabulary is piece_bpe_32k's pieces with
the file's own scores, read as a unigram model.

Edge cases: null and empty texts count 0; repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 500_000
_counters: dict[str, "Counter"] = {}


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton, score = ahocorasick.Automaton(), {}
        for piece, s in pieces:
            score.setdefault(piece, s)
        for piece, s in score.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), s))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p in score if len(p) == 1}
        used = set().union(*score) if score else set()
        assert not any(SPACE in p.lstrip(SPACE) for p in score), "a piece holds a space mark behind another character"
        free = "".join(c for c in "\n\t\v\f" if c not in used)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{free}]+|{SPACE}+" + (f"|[{free}]+" if free else ""))
        self.known: dict[str, int] = {}

    def viterbi(self, text: str) -> int:
        n = len(text)
        best, count = [0.0] + [None] * n, [0] * (n + 1)
        ends: list[list] = [[] for _ in range(n)] if n > 1 else [[]]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        single, unknown = self.single, self.unknown
        for end in range(n):
            top, tokens = None, 0
            for length, score in ends[end]:  # longest first
                total = best[end + 1 - length] + score
                if top is None or total > top:
                    top, tokens = total, count[end + 1 - length] + 1
            if text[end] not in single:
                total = best[end] + unknown
                if top is None or total > top:
                    top, tokens = total, count[end] + len(text[end].encode("utf-8", "surrogatepass"))
            best[end + 1], count[end + 1] = top, tokens
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        stretches = self.cut.findall(SPACE + text.replace(" ", SPACE))
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for s in set(stretches).difference(known):
            known[s] = self.viterbi(s)
        return sum(map(known.__getitem__, stretches))


def pieces_of(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def counter(spark, pieces: list[tuple[str, float]]):
    """A column function: text -> number of tokens. The vocabulary is sent out once; its size is that of the model file."""
    name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(pieces)

    def count(texts: pd.Series) -> pd.Series:
        if name not in _counters:
            _counters.clear()
            _counters[name] = Counter(sent.value)
        return pd.Series([_counters[name].count(t) for t in texts], dtype="int64")

    return F.pandas_udf(count, "long")


def op4_token_counts(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    count = counter(spark, pieces_of(path or str(public_tokenizers.path("piece_bpe_32k.model"))))
    return table(spark, sf_dir, "documents").select("doc_id", count("text").alias("n_tokens"))
