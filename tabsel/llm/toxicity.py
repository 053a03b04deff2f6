"""Toxicity by noisy-channel deobfuscation.

A character language model (interpolated 4-grams, counted over all documents) and a channel of leetspeak, spacing and
repetition give each stretch of text a lattice of readings; Viterbi decoding restores the likeliest one, and the
restored words are scored by a lexicon. The lexicon is fitted on a bounded sample of labelled documents.

Only stretches that have some reading with a lexicon word can change a score. One regular expression describes just
these (every letter as a run or one of its look-alikes, any number of separators, line breaks and digits in between),
so the executors find them in the JVM and decode them alone: no path of any other stretch that starts and ends beside
neither letter nor digit spells a lexicon word, whatever the language model says.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, text_slices

ORDER, BITS = 4, 5
SIZE = 1 << (ORDER * BITS)
#: Bound on the labelled documents that the lexicon is fitted on, the first by hash of their id.
MAX_LABELLED = 8000
#: The lower 97.5 % bound of its log odds that a word of the lexicon needs, its toxic documents counted by distinct contexts.
LEAST_LOG_ODDS = 2.0
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "×": "x"}
#: Costs in nats: a look-alike, a literal mark, a repeated letter dropped (of a pair, of a longer run), a separator dropped (between single letters, otherwise).
SUBSTITUTE, LITERAL, PAIR, RUN, SPACED, SEPARATOR = 2.0, 1.0, 3.0, 0.7, 1.0, 6.0


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Code point -> 1..26 for a letter whose base is Latin, else 0."""
    table = np.zeros(0x110000, np.uint8)
    for cp in [*range(0x41, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp).lower())[0]
        if "a" <= base <= "z":
            table[cp] = ord(base) - 96
    return table


def base_letter(c: str) -> str:
    n = int(_fold()[ord(c)])
    return chr(96 + n) if n else ""


def count_ngrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all character 4-grams of all texts, white space and marks being one boundary symbol; SIZE cells at most."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE, np.int64)
        for batch in it:
            for a, b in text_slices(batch.column(0)):
                texts = [t.as_py() or "" for t in batch.column(0).slice(a, b - a)]
                s = _fold()[np.frombuffer(("\n" * 3 + "\n\n\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)]
                s = s[(s > 0) | np.concatenate([[True], s[:-1] > 0])].astype(np.int64)
                if len(s) >= ORDER:
                    key = (s[:-3] << 15) | (s[1:-2] << 10) | (s[2:-1] << 5) | s[3:]
                    total += np.bincount(key, minlength=SIZE)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["k", "n"])

    parts = docs.select(text_col).mapInArrow(run, "k int, n bigint")
    found = parts.groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SIZE, np.float64)
    out[found.column("k").to_numpy()] = found.column("n").to_numpy()
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(last | first three) for all 4-grams: Witten-Bell interpolation down to a uniform distribution."""
    c4 = counts.reshape((32,) * 4)
    p = np.full(32, 1 / 27)
    for c in (c4.sum((0, 1, 2)), c4.sum((0, 1)), c4.sum(0), c4):
        kinds, total = (c > 0).sum(-1, keepdims=True), c.sum(-1, keepdims=True)
        p = np.where(total > 0, (c + kinds * p) / np.maximum(total + kinds, 1), p)
    return np.log(np.maximum(p, 1e-12)).astype(np.float32)


def fit_lexicon(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> dict[str, float]:
    """Words (in base letters) with their log odds of toxicity, from at most max_labelled labelled documents.

    Toxic documents count by distinct contexts (the words before and after a word): what only copies of one document
    share has few. The lower confidence bound of the log odds decides.
    """
    lab = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    lab = lab.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    marked = "".join(x for x in map(chr, range(0xC0, 0x250)) if x == x.lower() and base_letter(x))
    text = docs.select(F.col(id_col).alias("_id"), F.translate(F.lower(F.col(text_col)), marked, "".join(map(base_letter, marked))).alias("_t"))
    own = text.join(F.broadcast(lab), "_id")  # bounded by max_labelled
    sizes = {int(r["toxic"]): int(r["n"]) for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    words = F.array_distinct(F.split(F.coalesce("_t", F.lit("")), r"[^\p{L}]+"))
    stats = own.select("toxic", F.explode(words).alias("w")).where("length(w) between 3 and 24")
    stats = stats.groupBy("w").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    found = {r["w"]: (r["t"], r["c"]) for r in stats.where(F.col("t") >= 3).where(F.col("t") * (clean + 1) > 4 * F.col("c") * (toxic + 1)).toLocalIterator() if re.fullmatch("[a-z]+", r["w"])}
    contexts = defaultdict(set)
    for r in own.where("toxic = 1").select("_t").toLocalIterator() if found else ():
        tokens = ["", *re.findall(r"[^\W\d_]+", r["_t"] or ""), ""]
        for before, w, after in zip(tokens, tokens[1:], tokens[2:]):
            if w in found:
                contexts[w].add((before, after))
    out = {}
    for w, (n, c) in sorted(found.items()):
        t = min(n, len(contexts[w])) + 0.5
        odds = math.log(t / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        if odds - 1.96 * math.sqrt(1 / t + 1 / (c + 0.5)) >= LEAST_LOG_ODDS:
            out[w] = odds
    return out


def prior(labels: DataFrame) -> float:
    r = labels.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).first()
    return math.log((r["t"] + 1) / (r["c"] + 1))


@lru_cache(maxsize=1)
def _alike() -> tuple[dict[str, str], dict[str, str]]:
    """The letters and the marks that can be read as a letter."""
    letters, marks = defaultdict(str), defaultdict(str)
    for cp in np.flatnonzero(_fold()):
        letters[base_letter(chr(cp))] += chr(cp)
    for mark, read in LEET.items():
        for x in read:
            marks[x] += mark
    return dict(letters), dict(marks)


def _ranges(cps: np.ndarray) -> str:
    """Rising code points as the inside of a character class."""
    return "".join(f"{chr(r[0])}-{chr(r[-1])}" if len(r) > 1 else chr(r[0]) for r in np.split(cps, np.flatnonzero(np.diff(cps) > 1) + 1))


def pattern(lexicon: dict[str, float]) -> str:
    """Matches every stretch with a reading that is a lexicon word (Java and Python syntax).

    All that is no letter may be dropped, so a gap has any length. Among the marks of one gap the first that can be
    read as the next letter leaves most for those after it; the other choice is the letter that ends the gap. A place
    is therefore tried in at most two ways, whatever the gap.
    """
    letters, marks = _alike()
    escape = lambda cs: "".join(re.escape(c) if c.isascii() and not c.isalnum() else c for c in cs)
    every = _ranges(np.flatnonzero(_fold()))
    end = r"(?![\p{L}\p{N}])"
    trie: dict = {}
    for w in lexicon:
        node = trie
        for x in w:
            node = node.setdefault(x, {})
        node[""] = {}

    def read(x: str, node: dict, first: bool) -> str:
        """One letter and what may follow: words share their beginnings, so a place in the text is tried once for each first letter."""
        own, alike = f"[{letters[x]}]", escape(marks.get(x, ""))
        gap = "" if first else f"[^{every}]*+"
        rest = "|".join(read(y, node[y], False) for y in sorted(node) if y)
        out = []
        if rest:
            spelled = f"{gap}{own}+" + "+" * (x not in node)  # a doubled letter may take the rest of its run
            if alike:
                spelled = f"(?:{f'[^{every}{alike}]*+' if not first else ''}[{alike}]|{spelled})"
            out.append(f"{spelled}(?:{rest})")
        if "" in node:
            out.append(f"{gap}{own}++{end}")
            if alike:
                out.append(f"{f'[^{every}]*?' if not first else ''}[{alike}]++{end}")
        return out[0] if len(out) == 1 else f"(?:{'|'.join(out)})"

    body = "|".join(read(x, trie[x], True) for x in sorted(trie))
    return rf"(?<![\p{{L}}\p{{N}}])(?:{body})"


def decode(observed: str, log_p: np.ndarray) -> str:
    """The likeliest reading of a stretch of text, marks that are taken literally left in place (Viterbi)."""
    lone = _lone(observed)
    states: dict[tuple[int, int, int], tuple[float, str]] = {(0, 0, 0): (0.0, "")}
    run = 0
    for i, c in enumerate(observed):
        letter = base_letter(c)
        run = run + 1 if i and letter and letter == base_letter(observed[i - 1]) else 1
        options: list[tuple[str | None, float]] = [(letter, 0.0)] if letter else [(None, LITERAL)] + [(x, SUBSTITUTE) for x in LEET.get(c, "")]
        drop = math.inf
        if letter and run > 1:
            drop = PAIR if run == 2 and base_letter(observed[i + 1 : i + 2] or " ") != letter else RUN
        elif not letter:
            drop = (SPACED if lone[i] else SEPARATOR) + (SUBSTITUTE if c.isalnum() else 0.0)
        new: dict[tuple[int, int, int], tuple[float, str]] = {}
        for (a, b, d), (cost, read) in states.items():
            if drop < math.inf:
                _keep(new, (a, b, d), cost + drop, read)
            for x, extra in options:
                s = ord(x) - 96 if x else 0
                step = 0.0 if not s and not d else -float(log_p[a, b, d, s])  # boundaries in a row are one
                _keep(new, (b, d, s) if s or d else (a, b, d), cost + extra + step, read + (x or c))
        states = new
    ends = ((cost + (-float(log_p[a, b, d, 0]) if d else 0.0), read) for (a, b, d), (cost, read) in states.items())
    return min(ends)[1]


def _keep(states: dict, state: tuple, cost: float, read: str) -> None:
    if state not in states or (cost, read) < states[state]:
        states[state] = (cost, read)


def _lone(observed: str) -> list[bool]:
    """For each place, whether it is a separator between characters that stand alone (runs of one letter count as one)."""
    sep = [not c.isalnum() and (c not in LEET or c in "!|+(") for c in observed]
    parts, out, at = [], [False] * len(observed), 0
    for i in range(len(observed) + 1):
        if i == len(observed) or sep[i]:
            if i > at:
                parts.append((at, i, len(re.sub(r"(.)\1+", r"\1", observed[at:i].lower())) == 1))
            at = i + 1
    for (_, end, one), (start, _, other) in zip(parts, parts[1:]):
        for i in range(end, start):
            out[i] = one and other
    return out


def scored(docs: DataFrame, text_col: str, lexicon: dict[str, float], log_p: np.ndarray, base: float) -> tuple[DataFrame, list[str]]:
    """docs with three columns more, and their names: restored lexicon words (distinct, sorted), score, toxic."""
    names = fresh(docs, "restored", "score", "toxic")
    if not lexicon:
        return docs.withColumn(names[0], F.array().cast("array<string>")).withColumn(names[1], F.lit(base)).withColumn(names[2], F.lit(False)), names

    shared = docs.sparkSession.sparkContext.broadcast(log_p)  # 4 MB, whatever the corpus
    known: dict[str, list[str]] = {}

    def restore(stretch: str) -> list[str]:
        if stretch not in known:
            if len(known) > 100_000:
                known.clear()
            text = decode(stretch, shared.value)
            known[stretch] = [w for w in set(re.split(r"[^a-z]+", text)) if w in lexicon]
        return known[stretch]

    @F.pandas_udf("array<string>")
    def restored(found: pd.Series) -> pd.Series:
        return pd.Series([sorted({w for s in (x if x is not None else ()) for w in restore(s)}) for x in found])

    stretches = F.regexp_extract_all(F.lower(F.col(f"`{text_col}`")), F.lit(pattern(lexicon)), F.lit(0))
    weights = F.create_map(*(F.lit(x) for k, v in lexicon.items() for x in (k, float(v))))
    out = docs.withColumn(names[0], restored(stretches))
    score = F.aggregate(F.col(names[0]), F.lit(float(base)), lambda s, w: s + F.element_at(weights, w))
    return out.withColumn(names[1], score).withColumn(names[2], F.col(names[1]) > 0), names


def model(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, float], np.ndarray, float]:
    """Lexicon, language model and prior log odds; the language model counts all documents."""
    return fit_lexicon(docs, labels, max_labelled, id_col, text_col), language_model(count_ngrams(docs, text_col)), prior(labels)


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, restored, score, toxic), one for each row of docs: the log odds of the lexicon words in its restored text.

    A null or empty text has no words and the prior as its score; a null id stays null; repeated rows give repeated
    rows; a word counts once. Without toxic labels the lexicon is empty and nothing is toxic. Other columns aren't read.
    """
    lexicon, log_p, base = model(docs, labels, max_labelled, id_col, text_col)
    rows, _ = scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", lexicon, log_p, base)
    return rows.drop("text")


def drop_toxic(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that toxicity() doesn't call toxic, with the columns they had."""
    lexicon, log_p, base = model(docs, labels, max_labelled, id_col, text_col)
    rows, names = scored(docs, text_col, lexicon, log_p, base)
    return rows.where(~F.col(names[2])).drop(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
