"""Token counts from a cache of digests.

A count is stored under the digest of the normalised content and the digest of the tokenizer file. Documents meet the
cache by digest; every distinct content that it lacks is encoded once, and the new counts are appended. Copies, in one
table or over many runs, cost one encoding. Only digests and counts are joined back to the rows, so a content that
a third of the rows share is a small key on a join that adaptive execution may split.

Normalising is what leaves the count as it is for every tokenizer: null becomes the empty text, nothing else changes.

A miss is encoded by the tokenizer's own library. Where a byte-level pattern surely starts a new word, its text is cut;
the counts of the parts add up to the count of the whole, and every worker remembers the parts it has met, up to a
bound. A text in which a special string occurs goes to the library whole, and so does every text for a tokenizer of
another kind.

Defined results: null and empty texts have 0 bytes and 0 tokens. Repeated rows get equal counts. Further columns are
kept; one whose name a result column has is replaced by it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.text import plus_columns, unused

CACHE_SCHEMA = "content string, tokenizer string, n_tokens bigint"
RESULT = ("n_bytes", "n_tokens", "over_limit")

#: Parts a worker remembers before it starts anew.
REMEMBERED = 1_000_000


class _JsonCounter:
    """Counts of a `tokenizers` file.

    For a byte-level pattern a text is cut at its blanks, provided that each lies between two printable characters of
    the Latin blocks: there a new word starts, blank included. A part made of letters, ASCII marks (no apostrophe) and
    single line feeds is cut further, where letters meet marks; the pattern always ends a word there too.
    """

    LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
    MARKS = r"!-&(-/:-@\[-`{-~"
    BESIDE_BLANK = re.compile(" [^!-~¡-ɏ]|[^!-~¡-ɏ] ")
    SIMPLE = re.compile(f"(?:[{LATIN}{MARKS}]+(?:\n(?!\n))?)+")
    UNITS = re.compile(f"[{LATIN}]+|[{MARKS}]+|\n")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        self.by_parts = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        self.parts: dict[str, int] = {}  # by what follows a blank
        self.units: dict[str, int] = {}

    def _cut(self, text: str) -> list[str] | None:
        """The parts between blanks, the first one with a blank of its own; None where the text must stay whole."""
        if not self.by_parts or any(x in text for x in self.special):
            return None
        if not text or text[0] == " " or text[-1] == " " or self.BESIDE_BLANK.search(text):
            return None
        return text.split(" ")

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(x) for at in range(0, len(texts), 4096) for x in self.tokenizer.encode_batch(texts[at:at + 4096], add_special_tokens=False)]

    def _learn(self, parts: set[str]) -> None:
        units = {}
        for part in parts:
            found = self.UNITS.findall(part) if self.SIMPLE.fullmatch(part) and part[-1] != "\n" else [part]
            found[0] = " " + found[0]
            units[part] = found
        new = [x for x in set().union(*units.values()) if x not in self.units]
        self.units.update(zip(new, self._encoded(new)))
        self.parts.update((part, sum(map(self.units.__getitem__, found))) for part, found in units.items())

    def __call__(self, texts: list[str]) -> list[int]:
        cuts = [self._cut(t) for t in texts]
        first = self._encoded([t if cut is None else cut[0] for t, cut in zip(texts, cuts)])
        met = set().union(*(cut[1:] for cut in cuts if cut))
        new = {x for x in met if x not in self.parts}
        if len(self.parts) + len(new) > REMEMBERED:
            self.parts.clear()
            new = met
        if len(self.units) > REMEMBERED:
            self.units.clear()
        self._learn(new)
        return [n + sum(map(self.parts.__getitem__, cut[1:])) if cut else n for n, cut in zip(first, cuts)]


class _ModelCounter:
    """Counts of a `sentencepiece` file."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(self.processor.encode(t)) for t in texts]


@functools.lru_cache(maxsize=4)
def counter(path: str):
    return _JsonCounter(path) if path.endswith(".json") else _ModelCounter(path)


def tokenizer_digest(path: str) -> str:
    """The digest of the tokenizer file's bytes; every executor has the file at the same path."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _batches(texts: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size > chars:
            yield some
            some, size = [], 0
    if some:
        yield some


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The stored counts; none where the folder does not exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(folder) if there else spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, path: str, cache: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Every row with the bytes and tokens of its text and whether they exceed the limit.

    `path` is the tokenizer file, `cache` the folder of stored counts, which gains the counts of all contents that it
    lacked. An append that was repeated, or two runs at once, may store a count twice; equal digests have equal
    counts, so reading takes any.
    """
    spark, version = docs.sparkSession, tokenizer_digest(path)
    columns = plus_columns(docs.columns, list(RESULT))
    digest, size, tokens = unused(docs.columns, "_content", "_bytes", "_tokens")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns({digest: F.sha2(whole.cast("binary"), 256), size: F.octet_length(whole).cast("bigint")})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for batch in batches:
            n = [x for some in _batches(list(batch["text"])) for x in count(some)]
            yield pd.DataFrame({"content": batch["content"], "tokenizer": version, "n_tokens": n})

    contents = rows.select(F.col(digest).alias("content"), whole.alias("text"))
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version)
    # the texts of misses are shuffled once; copies within a task are already one
    misses = contents.join(stored, "content", "left_anti").groupBy("content").agg(F.first("text").alias("text"))
    misses.mapInPandas(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)

    known = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy(F.col("content").alias(digest)).agg(F.max("n_tokens").alias(tokens))
    out = rows.join(known, digest)
    return out.select(*[F.col(f"`{c}`") for c in columns], F.col(size).alias("n_bytes"), F.col(tokens).alias("n_tokens"), (F.col(tokens) > limit).alias("over_limit"))
