"""Language of documents and of passages in mixed ones, from bit-sliced n-gram filters.

Training counts words of labelled rows by language (all rows, in Spark), turns the distinct words into
n-grams, and keeps with each n-gram the set of languages in which it is about as frequent as anywhere: one bit
per language. The masks go into a Bloom filter whose slots hold all languages' bits side by side, so one
lookup answers for all of them. A word's popcounts by language, less what the filter's fill would give by
chance, are its evidence; a path of least cost through a text's words, with a price on each change of
language, yields passages, each with a confidence.

Sizes are bounded: n-grams rarer than ``LEAST_RATE`` of a language's n-grams are left out, which
leaves at most 1/LEAST_RATE of them per language, and the filter has ``SLOTS`` bytes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ctmcflow.session import Scratch

LANGUAGES = ["en", "de", "fr", "es", "it", "pt"]
# Spellings of the languages' names, lower case, without regions.
SPELLINGS = {
    "en": "en eng english anglais englisch inglés inglese inglês",
    "de": "de deu ger german deutsch allemand alemán tedesco alemão",
    "fr": "fr fra fre french français francais französisch francés francese francês",
    "es": "es spa spanish español espanol castellano spanisch espagnol spagnolo espanhol",
    "it": "it ita italian italiano italienisch italien",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portoghese",
}
SLOTS = 1 << 22
HASHES = 3
LEAST_RATE = 2e-6
LEAST_COUNT = 3
NEAR = 0.2  # an n-gram belongs to every language with at least this part of its highest rate
CHANGE = 3.0  # price of a change of language, in words of clear evidence
PASSAGE = 8
LEAST_CONFIDENCE = 0.05  # below it, and with less than LEAST_EVIDENCE, a text is too short to tell and does not refute its label
LEAST_EVIDENCE = 1.0  # evidence, in clear words, that the language has over the runner-up; it grows with the text
CELLS = 200_000  # words of a batch of texts handled together
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:['’]\p{L}[\p{L}\p{M}]*)*|\p{N}+")


def label_code(c: Column) -> Column:
    """Two-letter code of a written label (``en``, ``EN``, ``en_US``, ``English``); null for missing, unknown or other ones."""
    x = F.lower(F.trim(c))
    head = F.split(x, "[-_ ]").getItem(0)
    out = F.lit(None).cast("string")
    for code, names in SPELLINGS.items():
        out = F.when(head.isin(names.split()), code).otherwise(out)
    return out


def grams(word: Column) -> Column:
    """The word itself and its 3- and 4-letter grams with bounds."""
    w = F.concat(F.lit("_"), word, F.lit("_"))
    n = F.length(w)
    cut = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(w, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.concat(F.lit("="), word)), cut(3), cut(4))


def word_grams(w: str) -> list[str]:
    x = f"_{w}_"
    return [f"={w}", *(x[i : i + 3] for i in range(len(x) - 2)), *(x[i : i + 4] for i in range(len(x) - 3))]


class Filters:
    """Bit-sliced Bloom filter: slot -> one bit per language."""

    def __init__(self, slots: np.ndarray):
        if len(LANGUAGES) > 8 * slots.itemsize:
            raise ValueError(f"a slot of {slots.dtype} holds {8 * slots.itemsize} languages")
        self.slots, self.flat = slots, slots.tobytes()
        fill = np.array([float(((slots >> b) & 1).mean()) for b in range(len(LANGUAGES))])
        self.chance = fill**HASHES
        self.bits = (np.arange(256)[:, None] >> np.arange(len(LANGUAGES))) & 1
        self.clear()

    def clear(self) -> None:
        self.words = _Numbers(self)
        self.rows = np.zeros((1024, len(LANGUAGES)))

    def mask(self, gram: str) -> int:
        h = xxhash.xxh64_intdigest(gram.encode(), seed=42)
        bits, m = 0xFF, len(self.flat)
        for i in range(HASHES):
            bits &= self.flat[(h >> (20 * i)) % m]
        return bits

    def evidence(self, word: str) -> np.ndarray:
        """Corrected share of the word's n-grams that each language has; the whole word weighs as much as all grams."""
        if word.isdigit():
            return np.zeros(len(LANGUAGES))
        hit = self.bits[[self.mask(x) for x in word_grams(word)]]
        n = len(hit) - 1
        share = (hit[0] * max(1, n) + hit[1:].sum(0)) / (max(1, n) + n)
        got = np.maximum(0, (share - self.chance) / (1 - self.chance))
        # letters no language knows say nothing; a word that all know says nothing either
        return got - got.mean()

    def scores(self, words: list[str]) -> np.ndarray:
        """Evidence of every word, one row each; a word is worked out once until ``clear``."""
        at = list(map(self.words.__getitem__, words))
        return self.rows[at] if at else np.zeros((0, len(LANGUAGES)))


class _Numbers(dict):
    """Word -> its row of the filters' evidence, filled as words come."""

    def __init__(self, filters: Filters):
        self.filters = filters

    def __missing__(self, word: str) -> int:
        f, n = self.filters, len(self)
        if n == len(f.rows):
            f.rows = np.concatenate([f.rows, np.zeros_like(f.rows)])
        f.rows[n] = f.evidence(word)
        self[word] = n
        return n


def train(df: DataFrame, slots: int = SLOTS) -> Filters:
    """Filters from all rows whose label is one of the languages. No such row: filters that know nothing."""
    rows = df.select(label_code(F.col("lang")).alias("lang"), "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    words = rows.select("lang", F.explode(F.split(F.lower("text"), "[^\\p{L}\\p{M}'’]+")).alias("word")).filter("length(word) BETWEEN 1 AND 40")
    # distinct words are few beside the texts: written once, read for the totals and for the n-grams
    words = Scratch(df.sparkSession, "words").put(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    # quotes around a word and marks without a letter (as in emoji) are no part of it
    words = words.withColumn("word", F.regexp_replace("word", "^[^\\p{L}]+|['’]+$", "")).filter("word <> ''")
    g = words.select("lang", F.explode(grams(F.col("word"))).alias("gram"), "n").groupBy("gram").pivot("lang", LANGUAGES).agg(F.sum("n"))
    g = g.fillna(0)
    total = words.select("lang", (F.col("n") * F.size(grams(F.col("word")))).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")).collect()
    total = {r["lang"]: r["n"] for r in total}
    if not total:
        return Filters(np.zeros(slots, "uint8"))
    rate = {x: F.col(x) / float(total.get(x) or 1) for x in LANGUAGES}
    most = F.greatest(*rate.values())
    mask = F.lit(0)
    for b, x in enumerate(LANGUAGES):
        mask = mask + F.when((F.col(x) >= LEAST_COUNT) & (rate[x] >= LEAST_RATE) & (rate[x] >= NEAR * most), 1 << b).otherwise(0)
    h = F.xxhash64("gram")
    at = F.array(*[F.pmod(F.shiftrightunsigned(h, 20 * i), F.lit(slots)) if i else F.pmod(h.bitwiseAND((1 << 62) - 1), F.lit(slots)) for i in range(HASHES)])
    got = g.select(mask.alias("mask"), at.alias("at")).filter("mask > 0").select(F.explode("at").alias("at"), "mask").groupBy("at").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(slots, "uint8")
    out[got["at"].to_numpy()] = got["mask"].to_numpy()
    return Filters(out)


def split_words(text: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFC", text).lower())


def paths(scores: list[np.ndarray], change: float = CHANGE) -> list[np.ndarray]:
    """Best language of every word, for many texts at once; texts of like length are handled together."""
    order = sorted((i for i, s in enumerate(scores) if len(s)), key=lambda i: len(scores[i]))
    found = [np.empty(0, int)] * len(scores)
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(scores[order[end]]) <= CELLS:
            end += 1
        for i, p in zip(order[at:end], _batch_paths([scores[i] for i in order[at:end]], change)):
            found[i] = p
        at = end
    return found


def _batch_paths(part: list[np.ndarray], change: float) -> list[np.ndarray]:
    longest = max(map(len, part))
    s = np.zeros((len(part), longest, len(LANGUAGES)))
    for r, x in enumerate(part):
        s[r, : len(x)] = x
    v = s[:, 0].copy()
    back = np.zeros((len(part), longest, len(LANGUAGES)), "int8")
    for t in range(1, longest):
        best = v.argmax(1)
        top = np.take_along_axis(v, best[:, None], 1) - change
        stay = v >= top
        back[:, t] = np.where(stay, np.arange(len(LANGUAGES)), best[:, None])
        v = np.where(stay, v, top) + s[:, t]
    at = v.argmax(1)
    path = np.zeros((len(part), longest), int)
    for t in range(longest - 1, -1, -1):
        path[:, t] = at
        at = np.take_along_axis(back[:, t], at[:, None], 1)[:, 0]
    return [path[r, : len(x)] for r, x in enumerate(part)]


def _confidence(total: np.ndarray, best: int) -> tuple[float, float]:
    """Share of the evidence above the mean that the best language has over the runner-up, from 0 to 1, and that evidence itself."""
    rest = np.delete(total, best)
    top = float(total[best] - rest.max()) if len(rest) else 0.0
    return round(max(0.0, min(1.0, top / max(1e-9, abs(total[best]) + abs(rest.max())))), 4), round(top, 4)


def passages(df: DataFrame, filters: Filters, passage: int = PASSAGE) -> DataFrame:
    """One row per passage: doc_id, seg, lang, n_words, confidence, main (the document's language), words (of the document), evidence (over the runner-up).

    Passages are maximal stretches of one language; those under ``passage`` words are taken into the main
    language. Texts without letters have one row with null lang and confidence 0; null texts likewise.
    """
    shared = df.sparkSession.sparkContext.broadcast(filters.slots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Filters(shared.value)
        for pdf in batches:
            out = []
            if len(f.words) > 300_000:
                f.clear()
            texts = [split_words(t) if isinstance(t, str) else [] for t in pdf["text"]]
            scores = [f.scores(t) for t in texts]
            for doc, t, s, p in zip(pdf["doc_id"], texts, scores, paths(scores)):
                letters = sum(not w.isdigit() for w in t)
                if not letters or not s.any():
                    out.append((doc, 0, None, len(t), 0.0, None, letters, 0.0))
                    continue
                cut = np.r_[0, 1 + np.flatnonzero(p[1:] != p[:-1]), len(t)]
                segs = [(int(a), int(z), int(p[a])) for a, z in zip(cut[:-1], cut[1:])]
                size = np.bincount(p, minlength=len(LANGUAGES))
                long = [x for x in segs if x[1] - x[0] >= passage]
                main = int(size.argmax()) if not long else int(np.bincount([x[2] for x in long], [x[1] - x[0] for x in long], len(LANGUAGES)).argmax())
                if not long:  # a short text is taken as one passage
                    main = int(s.sum(0).argmax())
                merged: list[list[int]] = []
                for a, z, lang in segs:
                    lang = lang if z - a >= passage and long else main
                    if merged and merged[-1][2] == lang:
                        merged[-1][1] = z
                    else:
                        merged.append([a, z, lang])
                for n, (a, z, lang) in enumerate(merged):
                    sure, evidence = _confidence(s[a:z].sum(0), lang)
                    out.append((doc, n, LANGUAGES[lang], z - a, sure, LANGUAGES[main], letters, evidence))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "seg", "lang", "n_words", "confidence", "main", "words", "evidence"])

    return df.select("doc_id", "text").mapInPandas(run, "doc_id long, seg int, lang string, n_words int, confidence double, main string, words int, evidence double")


def document_languages(df: DataFrame, filters: Filters) -> DataFrame:
    """One row per document and language: doc_id, lang, confidence (of its surest passage), n_words, main."""
    p = passages(df, filters)
    return p.groupBy("doc_id", "lang").agg(F.max("confidence").alias("confidence"), F.sum("n_words").alias("n_words"), F.max((F.col("lang") == F.col("main"))).alias("main"))


def wrong_labels(df: DataFrame, filters: Filters, passage: int = PASSAGE) -> DataFrame:
    """doc_id, lang: the languages of every document whose label is missing, of another language, or one of several.

    A language counts beside the main one from ``passage`` words in one stretch. Texts without words (also those of
    emoji and lone combining marks) are no case, nor are texts of one language that contradict their label with a
    confidence under ``LEAST_CONFIDENCE`` and less than ``LEAST_EVIDENCE``.
    """
    p = passages(df, filters, passage).filter("lang IS NOT NULL")
    # a document has at most six languages
    many = p.groupBy("doc_id").agg(F.collect_set("lang").alias("langs"), F.max("main").alias("main"), F.max("confidence").alias("confidence"), F.max("evidence").alias("evidence"))
    told = df.select("doc_id", label_code(F.col("lang")).alias("told"))
    case = many.join(told, "doc_id").filter(f"size(langs) > 1 OR told IS NULL OR (told <> main AND (confidence >= {LEAST_CONFIDENCE} OR evidence >= {LEAST_EVIDENCE}))")
    return case.select("doc_id", F.explode("langs").alias("lang")).distinct()
