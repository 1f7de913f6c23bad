"""Token counts of whole texts by a vocabulary file of a public tokenizer.

An Arrow function returns lengths only. A text is cut at spaces and line ends, which no token of
the supported vocabularies spans (``cut`` is "space"); the distinct pieces that a batch has not met
before are encoded together, in calls of about ``call_bytes`` bytes, and their lengths are summed.
A piece is never cut elsewhere, so counts are those of the whole text. Vocabularies whose tokens
hold the space before a word are cut before a space that stands between two ASCII letters or digits.

Defined cases: a null text counts as empty and has no tokens; other columns may be null, repeated
or of any name; every row gives one row; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, ship, small_batches, text_of

#: Pieces whose counts a worker remembers (memory is bounded by these and PIECE_CHARS).
REMEMBERED = 500_000
PIECE_CHARS = 64


class Counter:
    """Counts tokens in one Python worker. source: the text of a tokenizer's .json, or a .model's bytes."""

    def __init__(self, source: str | bytes, cut: str, call_bytes: int):
        self.call_bytes, self.known = call_bytes, {}
        if isinstance(source, bytes):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=source)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_str(source)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        self.pieces = {
            "space": lambda text: text.replace("\n", " ").split(" "),
            "before_space": re.compile(r"(?<=[A-Za-z0-9])(?= [A-Za-z0-9])").split,
            "none": lambda text: [text],
        }[cut]

    def learn(self, pieces: list[str]) -> dict[str, int]:
        """Counts of pieces, by calls of about call_bytes bytes."""
        out, call, size = {}, [], 0
        for piece in sorted(pieces, key=len):  # calls of like lengths
            call.append(piece)
            size += len(piece.encode("utf-8", "replace"))
            if size >= self.call_bytes:
                out.update(zip(call, self.encode(call), strict=True))
                call, size = [], 0
        if call:
            out.update(zip(call, self.encode(call), strict=True))
        return out

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(self.pieces(text))
            size += len(text)
            if size >= 2_000_000:
                out += self._count(group)
                group, size = [], 0
        return out + self._count(group)

    def _count(self, group: list[list[str]]) -> list[int]:
        known, met = self.known, set().union(*group)
        known.update(self.learn([p for p in met if p not in known]))
        out = [sum(map(known.__getitem__, pieces)) for pieces in group]
        if len(known) > REMEMBERED:
            self.known = {p: known[p] for p in met if len(p) <= PIECE_CHARS}
        else:
            for p in met:
                if len(p) > PIECE_CHARS:
                    del known[p]
        return out


def token_count(spark: SparkSession, text: Column, path: str, cut: str = "space", call_bytes: int = 1 << 18) -> Column:
    """Tokens of a text column by the vocabulary file at ``path``, which the driver reads."""
    small_batches(spark)
    with open(path, "rb") as f:
        data = f.read()
    shared = spark.sparkContext.broadcast(data if path.endswith(".model") else data.decode())

    @F.pandas_udf("long")
    def counted(batches: pd.Series) -> pd.Series:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = kept(f"tokens {path} {cut}", lambda: Counter(shared.value, cut, call_bytes))
        return pd.Series(counter.count(batches.tolist()), dtype="int64")

    return counted(text)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, cut: str = "space") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""
    return docs.select(
        "doc_id",
        F.octet_length(text_of()).cast("long").alias("n_bytes"),
        token_count(docs.sparkSession, text_of(), path, cut).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)


ship(__name__)
