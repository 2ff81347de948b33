"""Language ID by cross-parsing entropy.

For each language a suffix automaton of sample text accepts every substring of the sample. A text is parsed
greedily into longest matches against it: while the automaton can follow the text it does, and where it can't a
new phrase begins at the root. Text of the same language needs few, long phrases. Each phrase costs log2(sample
length) bits; the language with the fewest bits per character wins (ties: the smaller name).

Sample: of the labelled training rows, per language the DOCS_PER_LANG texts of MIN_CHARS to MAX_CHARS characters
with the smallest hash of their id, whole texts until SAMPLE_CHARS are reached. Those limits bound what the
driver collects and the automata that tasks build. Every text is then parsed in full.

Texts are lower-cased, runs of other characters than letters become one space, and a letter that no sample
holds is a phrase of its own. The parse starts again every SEGMENT characters, which lets numpy walk thousands
of segments in step; that adds at most one phrase per segment, for all languages alike.

Defined cases: null text, or text without letters: ``und`` with score 0; no training rows at all: every text is
``und``; null doc_id: never a training row, not held out; a null lang is not learned; repeated rows get equal
answers; other columns are kept by ``identify`` and ignored by the query.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relevo.llm import held
from relevo.llm import words as W
from relevo.session import bounded_batches

DOCS_PER_LANG = 200
MIN_CHARS, MAX_CHARS = 200, 20_000
SAMPLE_CHARS = 20_000
SEGMENT = 512
LANES = 2048
#: Distinct letters that get a symbol; more share the one for unseen letters.
ALPHABET = 120
UND = "und"

PAD, SPACE, OTHER = 0, 1, 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame) -> dict[str, str]:
    """Training text by language, at most about SAMPLE_CHARS + MAX_CHARS characters each."""
    n = F.length("text")
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (n <= MAX_CHARS)).where(F.col("text").rlike(r"\p{L}"))
    order = [F.col("short"), F.xxhash64("doc_id"), F.col("doc_id")]
    ids = rows.select("lang", "doc_id", (n < MIN_CHARS).alias("short"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("salt"))
    # of a language that holds most rows, each salt keeps its first rows before they meet
    for by in (["lang", "salt"], ["lang"]):
        ids = ids.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= DOCS_PER_LANG)
    picked = rows.join(F.broadcast(ids.select("lang", "doc_id", "rn")), ["lang", "doc_id"]).select("lang", "rn", "text").collect()
    out: dict[str, str] = {}
    for r in sorted(picked, key=lambda r: (r.lang, r.rn, r.text)):
        if len(out.get(r.lang, "")) < SAMPLE_CHARS:
            out[r.lang] = f"{out.get(r.lang, '')} {r.text}"
    return out


@lru_cache(maxsize=2)
def symbols(letters: str) -> np.ndarray:
    """Symbol of every code point: SPACE unless it is a letter, OTHER unless its lower case is in ``letters``."""
    table = np.full(0x110000, SPACE, dtype=np.uint8)
    known = {c: OTHER + 1 + i for i, c in enumerate(letters)}
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = known.get(c.lower()[0], OTHER)
    return table


def to_symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts with runs of SPACE made one, and where each text starts."""
    ends = np.cumsum([0] + [len(t) for t in texts])
    code = table[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != SPACE) | (code[:-1] != SPACE)
    first = ends[:-1][ends[:-1] < len(code)]
    keep[first] = code[first] != SPACE
    return code[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def automaton(code: list[int], size: int) -> np.ndarray:
    """Suffix automaton of a symbol sequence as one flat table. Entry ``state * size + symbol`` holds
    ``next state * size * 4 + phrases that end here``; a missing edge starts a new phrase with the symbol."""
    edges, link, length, last = [{}], [-1], [0], 0
    for c in code:
        cur = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    root = np.zeros(size, dtype=np.int64)
    for c, to in edges[0].items():
        root[c] = to
    table = np.empty((len(edges), size), dtype=np.int64)
    # no edge: the open phrase ends; a symbol that the root can't follow either is a phrase of its own
    table[:] = root * size * 4 + 1 + (root == 0)
    table[0] = root * size * 4 + (root == 0)
    table[:, PAD] = np.arange(len(edges)) * size * 4
    for state, out in enumerate(edges):
        for c, to in out.items():
            table[state, c] = to * size * 4
    return table.astype(np.int32).reshape(-1)


class Identifier:
    """Automata of a sample, built once per Python worker."""

    def __init__(self, texts: dict[str, str]):
        letters: dict[str, int] = {}
        for t in texts.values():
            for c in t:
                if c.isalpha():
                    letters[c.lower()[0]] = letters.get(c.lower()[0], 0) + 1
        self.table = symbols("".join(sorted(letters, key=lambda c: (-letters[c], c))[:ALPHABET]))
        self.size = int(self.table.max()) + 1
        self.langs = sorted(texts)
        codes = {lang: to_symbols([texts[lang]], self.table)[0] for lang in self.langs}
        self.cost = np.array([np.log2(max(2, len(codes[lang]))) for lang in self.langs])
        self.walks = [automaton(codes[lang].tolist(), self.size) for lang in self.langs]

    def phrases(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        n = np.diff(first)
        parts = -(-n // SEGMENT)
        text = np.repeat(np.arange(len(n)), parts)
        start = first[:-1][text] + SEGMENT * (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts))
        end = np.minimum(start + SEGMENT, first[1:][text])
        out = np.zeros((len(n), len(self.langs)), dtype=np.int64)
        padded = np.concatenate([code, np.zeros(SEGMENT, dtype=np.uint8)])
        for a in range(0, len(text), LANES):
            s, e = start[a:a + LANES], end[a:a + LANES]
            grid = s + np.arange(int((e - s).max()))[:, None]
            lanes = np.where(grid < e, padded[grid], PAD).astype(np.int32)
            for k, walk in enumerate(self.walks):
                state = np.zeros(len(s), dtype=np.int32)
                count = np.zeros(len(s), dtype=np.int32)
                for row in lanes:
                    state = walk[(state >> 2) + row]
                    count += state & 3
                count += (state >> 2) > 0
                np.add.at(out[:, k], text[a:a + LANES], count)
        return out

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits per character of each text. The score is the share of the winner when
        each language weighs 2 to the minus bits."""
        code, first = to_symbols(texts, self.table)
        n = np.diff(first)
        letter = np.concatenate([[0], np.cumsum(code != SPACE)])[first]
        some = np.diff(letter) > 0
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        bits = self.phrases(code, first) * self.cost
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(bits)), best]
        score = 1 / np.exp2(np.maximum(least[:, None] - bits, -60)).sum(axis=1)
        names = [self.langs[b] if s else UND for b, s in zip(best, some, strict=True)]
        return names, np.where(some, score, 0.0), np.where(some, least / np.maximum(n, 1), 0.0)


def _identify(model, text: str):
    def run(batches):
        texts = model.value
        identifier = held.one("language", hash(tuple(sorted(texts.items()))), lambda: Identifier(texts))
        for batch in batches:
            for part in W.slices(batch, text):
                lang, score, bits = identifier([t or "" for t in part.column(text).to_pylist()])
                cols = [*part.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(bits)]
                yield pa.RecordBatch.from_arrays(cols, names=[*part.schema.names, "lang_pred", "score", "bits_per_char"])

    return held.tidy(run, "language")


def identify(docs: DataFrame, texts: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_char (columns of those names are replaced)."""
    bounded_batches(docs.sparkSession)
    rows = docs.drop("lang_pred", "score", "bits_per_char")
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_char", T.DoubleType())])
    return rows.mapInArrow(_identify(docs.sparkSession.sparkContext.broadcast(texts), text), schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "text"), sample(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_char")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is known, with all their columns: texts that are ``und`` or whose language
    isn't likelier than all others together go. A null lang becomes the predicted one."""
    own = docs.withColumnsRenamed({c: f"_own_{c}" for c in ("lang_pred", "score", "bits_per_char") if c in docs.columns})
    known = identify(own, sample(docs)).where((F.col("lang_pred") != UND) & (F.col("score") > 0.5))
    known = known.withColumn("lang", F.coalesce("lang", "lang_pred")).drop("lang_pred", "score", "bits_per_char")
    return known.withColumnsRenamed({f"_own_{c}": c for c in ("lang_pred", "score", "bits_per_char")}).select(*docs.columns)
