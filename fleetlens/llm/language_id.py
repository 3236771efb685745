"""Language identification by cross-parsing.

A text is cut into phrases, each the longest match from where the last one ended in a sample of one language. The
fewer phrases a language needs, each counted with the logarithm of its sample's size, the fewer bits that language
spends on the text; the language with the fewest bits a letter wins.

Learning takes a bounded sample: `per_lang` documents of each language with the smallest hashes, and of their folded
text at most `sample_chars` characters. Only these samples travel: every Python worker builds one suffix automaton
per language from them. Prediction reads every text whole, in one pass without a shuffle. The texts of an Arrow batch
are folded at once and cut into blocks; all blocks step through all automata together as arrays, so a very long text
is many blocks and not one long loop. A block starts a phrase anew, for every language alike.

Defined results: a null text, or one without a letter, is `und` with score 0 and no phrases; so is every text when
nothing was learned. Equal bits go to the language first by code point. Repeated rows get equal results, further
columns are kept, and one whose name a result column has is replaced by it.
"""

from __future__ import annotations

import functools
import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.text import plus_columns, unused
from fleetlens.llm.worker_memory import kept

UNKNOWN = "und"
RESULT = "lang_pred string, score double, bits_per_letter double"
BLOCK = 512
LANES = 4096
#: Characters that are folded together; a task holds some 50 bytes for each.
PART = 500_000


@functools.lru_cache(maxsize=1)
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the symbol after folding (lower case; everything that is no letter is one blank), and whether it is a letter."""
    fold = np.zeros(sys.maxunicode + 1, np.uint32)
    letter = np.zeros(sys.maxunicode + 1, bool)
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        if c.isalpha():
            letter[code] = True
            low = c.lower()
            fold[code] = ord(low) if len(low) == 1 else code
        else:
            fold[code] = 32
    return fold, letter


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def fold(text: str) -> str:
    """Lower-case letters with one blank for every run of other characters."""
    kinds, _ = _folding()
    x = kinds[_codes(text)]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    return x[keep].astype("<u4").tobytes().decode("utf-32-le")


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The edges of the suffix automaton of a sequence; state 0 is the root, and paths from it are the factors of the sequence."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return edges


class CrossParser:
    """The automata of all languages as one table of steps.

    `steps[state * width + symbol]` is the next state; where no match goes on, it is the state after the first
    symbol of a new phrase, as its complement (a negative number).
    """

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        alphabet = sorted({ord(c) for _, sample in samples for c in sample} - {32})
        self.width = len(alphabet) + 2  # 0: letters no sample has, 1: blank
        self.symbol = np.zeros(sys.maxunicode + 1, np.int32)
        self.symbol[alphabet] = np.arange(2, self.width)
        kinds, self.letter = _folding()
        self.symbol = np.where(kinds == 32, 1, self.symbol[kinds]).astype(np.int32)
        self.blank = kinds == 32
        self.roots, tables, base = [], [], 0
        for _, sample in samples:
            edges = suffix_automaton(self.symbol[_codes(sample)].tolist())
            start = np.full(self.width, base, np.int32)
            for c, to in edges[0].items():
                start[c] = base + to
            table = np.repeat(~start[None, :], len(edges), axis=0)
            states = np.repeat(np.arange(len(edges)), [len(x) for x in edges])
            symbols = np.fromiter((c for x in edges for c in x), np.int64, len(states))
            table[states, symbols] = base + np.fromiter((t for x in edges for t in x.values()), np.int64, len(states))
            self.roots.append(base)
            tables.append(table.ravel())
            base += len(edges)
        self.steps = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.bits = np.array([math.log2(len(sample) + 1) for _, sample in samples])

    def phrases(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of every block in every language; blocks are slices of `symbols`."""
        out = np.zeros((len(self.roots), len(starts)), np.int64)
        order = np.argsort(-sizes, kind="stable")
        for at in range(0, len(order), LANES):
            lanes = order[at:at + LANES]
            begin, left = starts[lanes], sizes[lanes]
            state = np.repeat(np.array(self.roots, np.int64)[:, None], len(lanes), axis=1)
            count = np.ones(state.shape, np.int64)
            live = len(lanes)
            for i in range(int(left[0]) if len(left) else 0):
                while live and left[live - 1] <= i:
                    live -= 1
                to = self.steps[state[:, :live] * self.width + symbols[begin[:live] + i]]
                ended = to < 0
                count[:, :live] += ended
                state[:, :live] = np.where(ended, ~to, to)
            out[:, lanes] = count
        return out

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a letter of every text.

        The score is what the runner-up needs more, as a share of its bits: 0 is a tie, 1 a text that only one
        language was learned for.
        """
        lang, score, cost = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
        rows = [i for i, t in enumerate(texts) if t]
        if not rows or not self.langs:
            return lang, score, cost
        codes = [_codes(texts[i]) for i in rows]
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in codes])
        codes = np.concatenate(codes)
        blank = self.blank[codes]
        keep = np.ones(len(codes), bool)
        keep[1:] = ~(blank[1:] & blank[:-1]) | (owner[1:] != owner[:-1])
        letters = np.bincount(owner[self.letter[codes]], minlength=len(rows))
        symbols, owner = self.symbol[codes[keep]], owner[keep]
        size = np.bincount(owner, minlength=len(rows))
        first = np.cumsum(size) - size
        blocks = -(-size // BLOCK)
        which = np.repeat(np.arange(len(rows)), blocks)
        number = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        phrases = self.phrases(symbols, first[which] + number * BLOCK, np.minimum(BLOCK, size[which] - number * BLOCK))
        for k, i in enumerate(rows):
            lo, hi = int(np.searchsorted(which, k)), int(np.searchsorted(which, k, "right"))
            if not letters[k]:
                continue
            bits = phrases[:, lo:hi].sum(axis=1) * self.bits
            ranked = np.argsort(bits, kind="stable")
            best, lang[i] = bits[ranked[0]], self.langs[ranked[0]]
            score[i] = 1.0 if len(ranked) == 1 else 1.0 - best / bits[ranked[1]]
            cost[i] = best / letters[k]
        return lang, score, cost


def _parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return kept(("language_id", samples), lambda: CrossParser(samples))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 48, sample_chars: int = 32_000) -> tuple[tuple[str, str], ...]:
    """The sample of every language, in order of the languages.

    Of each language, `per_lang` slots by a hash of the key hold one document each, the one with the smallest hash;
    their folded texts, in order of the hash, are cut at `sample_chars` characters. Nothing else comes to the driver.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).alias("lang"), F.xxhash64(F.col(key).cast("string")).alias("dice"), F.substring(F.col(text), 1, 2 * sample_chars).alias("text"))
    slots = rows.groupBy("lang", F.pmod("dice", F.lit(per_lang)).alias("slot")).agg(F.min("dice").alias("dice")).drop("slot")
    # `per_lang` rows a language, whatever the input
    chosen = rows.join(F.broadcast(slots), ["lang", "dice"], "left_semi").groupBy("lang", "dice").agg(F.min("text").alias("text"))
    found: dict[str, list[tuple[int, str]]] = {}
    for r in chosen.toLocalIterator():
        found.setdefault(r["lang"], []).append((r["dice"], fold(r["text"])))
    return tuple((k, " ".join(t for _, t in sorted(found[k]))[:sample_chars]) for k in sorted(found))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], text: str = "text") -> DataFrame:
    """Every document with its language, the score of that choice and the bits it took."""
    sent = docs.sparkSession.sparkContext.broadcast(samples)  # at most `sample_chars` characters a language
    names = [f.split(" ")[0] for f in RESULT.split(", ")]
    columns = plus_columns(docs.columns, names)

    @F.pandas_udf(RESULT)
    def judged(texts: pd.Series) -> pd.DataFrame:
        parser = _parser(sent.value)
        parts, part, chars = [], [], 0
        for t in texts:
            part.append(t)
            chars += len(t or "")
            if chars > PART:
                parts.append(parser.judge(part))
                part, chars = [], 0
        parts.append(parser.judge(part))
        return pd.DataFrame({"lang_pred": [x for p in parts for x in p[0]], "score": np.concatenate([p[1] for p in parts]),
                             "bits_per_letter": pd.array(np.concatenate([p[2] for p in parts]), dtype="Float64")})

    (found,) = unused(docs.columns, "_judged")
    # not deterministic to the optimiser, which would else run it once more for every filter on its result
    out = docs.withColumn(found, judged.asNondeterministic()(F.col(text)))
    return out.select(*[F.col(f"`{c}`") for c in columns], *[F.col(found)[n].alias(n) for n in names])


def held_out(key: Column) -> Column:
    """The third of the documents that learning leaves out."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1
