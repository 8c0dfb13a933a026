r"""Toxicity by a weighted lexicon.

A text is folded (homoglyphs, accents and case to plain letters, digits and signs that stand for letters to those
letters, signs inside words dropped) and matched by one Aho-Corasick automaton that holds the lexicon's entries and
the exception phrases.  Words with accents are matched in a second form too, which keeps them.  Entries begin at a
word's beginning; those that end in a blank are whole words.  An entry inside an exception phrase does not count.  The
sum of weights is normalised by the length of the text.

The lexicon is learnt from labelled rows: words and beginnings of words, with or without their accents, that occur at
different rates in the labels' texts, every repetition counted; weights are log ratios of those rates.  Fitting reads
at most ``SAMPLE`` labelled texts, those with the smallest hashes of their ids; the bound is a parameter.  Executors
count entries and measure densities; the driver gets the counts of frequent entries and a few numbers per text.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, text_of, trim, written

SAMPLE = 20_000
#: Different entries that a task counts before it hands them on to be added up.
HELD = 50_000
#: Letters of other scripts and full-width forms that look like Latin ones.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ո": "n", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ß": "ss", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "æ": "ae", "œ": "oe"}
#: Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
#: Clean words and phrases of the four languages that begin as common insults do ("pathetic", "worthless", "idiot",
#: "moron", "disgusting", "loser", "stupid", "trash", "clown"), so that learnt beginnings of words do not count in them.
EXCEPTIONS = tuple(
    "path|paths|pathway|pathways|pathology|pathological|pathos|worth|worthy|worthwhile|idiom|idioms|idiomatic|idiosyncratic|idiosyncrasy|morocco|moroccan|disguise|disguised|lose|loses|stupor|stupendous|trash can|trash bin|clown fish"
    "|wort|worte|worten|wortes|wortlaut|wortschatz|pathologie|idiomatisch|idiome"
    "|tras|trasero|trasera|trasladar|traslado|trasfondo|idioma|idiomas|patología|morosidad|moroso"
    "|pathologique|idiomatique|morose|morosité|stupeur".split("|")
)
_WORD = re.compile(r"\S+")
_LETTER = re.compile(r"[^\W\d_]")
_BEGIN = re.compile(r"[\w@$€]")


def _inside(word: str) -> str:
    """A word without the signs at its ends, in one look at each."""
    begin, end = _BEGIN.search(word), len(word)
    if not begin:
        return ""
    while not (word[end - 1].isalnum() or word[end - 1] in "_$€"):
        end -= 1
        if end <= begin.start():
            return ""
    return word[begin.start() : end]


def fold_forms(word: str) -> tuple[str, str]:
    """A word in plain small letters, and the same with its accents.  Words without a letter are kept as they are, without signs."""
    return _known_forms(word) if len(word) < 64 else _forms(word)


def _forms(word: str) -> tuple[str, str]:
    word = _inside(unicodedata.normalize("NFKD", word.casefold()))
    if not _LETTER.search(word):
        return (re.sub(r"\W", "", word),) * 2
    out, accented = [], []
    for c in word:
        c = HOMOGLYPHS.get(c, c)
        c = SUBSTITUTES.get(c, c)
        if c.isalpha():
            out.append(c)
            accented.append(c)
        elif out and unicodedata.combining(c):
            accented.append(c)
    return "".join(out), unicodedata.normalize("NFC", "".join(accented))


_known_forms = functools.lru_cache(maxsize=30_000)(_forms)


def fold_word(word: str) -> str:
    return fold_forms(word)[0]


def fold_both(text: str) -> tuple[str, str]:
    """The folded words with a blank before and after each, and the same with accents; both have the same words in order."""
    forms = [f for f in map(fold_forms, _WORD.findall(text)) if f[0]]
    return f" {' '.join(f[0] for f in forms)} ", f" {' '.join(f[1] for f in forms)} "


def fold(text: str) -> str:
    return fold_both(text)[0]


@dataclass
class Lexicon:
    """Weights of entries, phrases within which entries do not count, and the logistic scale of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    #: The score is logistic(slope * (density - middle)), density being the summed weight over sqrt(words + 1).
    slope: float = 1.0
    middle: float = 1.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            found.add_word(entry, (len(entry), w))
        for phrase in self.exceptions:
            for form in fold_both(phrase):
                found.add_word(form, (len(form), None))
        if len(found):
            found.make_automaton()
        return found

    def density(self, automaton, text: str) -> float:
        return self._sum(self.found(automaton, text))

    def found(self, automaton, text: str) -> tuple[list[float], int]:
        """The weights of the words that count, and the number of words."""
        plain, accented = fold_both(text)
        words = plain.count(" ") - 1
        if words < 1 or not len(automaton):
            return [], 0
        best: dict[int, float] = {}  # a word counts once, by its weightiest entry in either form
        for form in (plain,) if plain == accented else (plain, accented):
            spared, hits = [], []
            for end, (n, w) in automaton.iter(form):
                (spared if w is None else hits).append((end - n + 1, end, w))
            at = word = 0
            for a, b, w in sorted(hits):
                if not any(x <= a and b <= y for x, y, _ in spared):
                    word, at = word + form.count(" ", at, a), a  # a word has the same number in both forms
                    best[word] = max(best.get(word, w), w) if w > 0 else min(best.get(word, 0.0), w) if best.get(word, 0.0) <= 0 else best[word]
        return list(best.values()), words

    @staticmethod
    def _sum(found: tuple[list[float], int], least: float = -math.inf) -> float:
        return sum(w for w in found[0] if w >= least) / math.sqrt(found[1] + 1)

    def score(self, automaton, text: str) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * (self.density(automaton, text) - self.middle)))))


@functools.lru_cache(maxsize=10_000)
def _word_entries(plain: str, accented: str) -> frozenset[str]:
    """What of a word may become an entry: the whole word, and beginnings of 4 to 7 letters of a longer one, in either form."""
    found = set()
    for word in (plain, accented):
        if len(word) > 2:
            found.add(f" {word} ")
            found.update(f" {word[:n]}" for n in range(4, min(8, len(word))))
    return frozenset(found)


def _entries(plain: str, accented: str) -> Counter:
    """How often a folded text, given in both forms, has each possible entry."""
    found = Counter()
    for forms, k in Counter(zip(plain.split(), accented.split())).items():
        for entry in _word_entries(*forms):
            found[entry] += k
    return found


def _limit(clean: list[float], toxic: list[float]) -> tuple[float, float, float]:
    """The errors that the best limit on densities makes, and the neighbouring densities that it parts.

    Errors are shares of the texts of either label, added.  Of equal limits the one within the widest gap is taken."""
    every = sorted([(d, 0) for d in clean] + [(d, 1) for d in toxic])
    spared, missed, best = len(clean), 0, (1.0, 0.0, every[0][0] - 1.0, every[0][0])
    for k, (d, y) in enumerate(every):
        spared, missed = spared - (1 - y), missed + y
        after = every[k + 1][0] if k + 1 < len(every) else d + 1.0
        if after > d:
            best = min(best, (spared / len(clean) + missed / len(toxic), d - after, d, after))
    return best[0], best[2], best[3]


#: Least weights that are tried, from few entries to many.
CUTS = (5.0, 4.5, 4.0, 3.5, 3.0, 2.5, 2.0, 1.5, 1.0)


class Counts:
    """How many different texts of label 1 have an entry, and by label how much of it all texts have together: each
    occurrence divided by the root of the text's length, as in the score."""

    def __init__(self):
        self.held, self.rates = Counter(), (Counter(), Counter())

    def add(self, forms: tuple[str, str], y: int) -> None:
        size = math.sqrt(forms[0].count(" "))
        for entry, k in _entries(*forms).items():
            self.held[entry] += y
            self.rates[y][entry] += k / size


def weights_of(held: dict[str, int], rates: tuple[dict, dict], n0: int, n1: int, middle_length: float) -> dict[str, float]:
    """Weights of entries: log ratios of what one text of either label has of them in the mean, so that a stem counts which
    other texts have once and these repeat.  A longer entry stays beside its beginning, and an accented one beside its
    plain form, only if it weighs 0.5 more."""
    half = 0.5 / math.sqrt(middle_length)  # half an occurrence in a middling text
    weights = {}
    for entry in sorted(held, key=lambda e: (len(e), fold(e).strip() != e.strip(), e)):
        w = math.log((rates[1].get(entry, 0) + half) / (n1 + 1)) - math.log((rates[0].get(entry, 0) + half) / (n0 + 1))
        plain = " " + fold(entry).strip()
        stems = [x for n in range(5, len(entry) + 1) for x in (entry[:n], plain[:n]) if x != entry] + [plain + " "] * (entry[-1] == " " and plain != entry[:-1])
        if w >= CUTS[-1] and all(w >= weights.get(x, 0.0) + 0.5 for x in stems):
            weights[entry] = w
    return weights


def densities(lexicon: Lexicon, automaton, text: str) -> list[float]:
    """A text's density by the entries that reach each of CUTS."""
    found = lexicon.found(automaton, text)
    return [lexicon._sum(found, cut) for cut in CUTS]


def limited(lexicon: Lexicon, rows: list[tuple[int, list[float]]]) -> Lexicon:
    """Leaves the group of entries, and sets the limit, that make the fewest errors on (label, densities); the scale puts a
    score of 0.7 between the two texts that the limit parts."""
    tried = []
    for k, cut in enumerate(CUTS):
        clean, toxic = ([d[k] for y, d in rows if y == label] for label in (0, 1))
        tried.append((*_limit(clean, toxic), cut))
    _, low, high, cut = min(tried, key=lambda x: x[0])  # the fewest entries of equals
    slope = 8 / max(high - low, 0.2)
    return Lexicon({e: w for e, w in lexicon.weights.items() if w >= cut}, lexicon.exceptions, slope, (low + high) / 2 - math.log(0.7 / 0.3) / slope)


def learn(labelled: list[tuple[str, int]], *, least: int = 5, share: float = 0.015, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from (text, label) pairs; :func:`fit` does the same for tables.

    An entry needs ``least`` different texts of label 1, and a ``share`` of them."""
    labelled = sorted({(t or "", int(y)) for t, y in labelled})
    counts, lengths = Counts(), []
    for t, y in labelled:
        forms = fold_both(t)
        counts.add(forms, y)
        lengths.append(forms[0].count(" "))
    n1 = sum(y for _, y in labelled)
    n0 = len(labelled) - n1
    if not n1 or not n0:
        return Lexicon(exceptions=exceptions)
    held = {entry: k for entry, k in counts.held.items() if k >= max(least, share * n1)}
    lexicon = Lexicon(weights_of(held, counts.rates, n0, n1, sorted(lengths)[len(lengths) // 2]), exceptions)
    automaton = lexicon.automaton()
    return limited(lexicon, [(y, densities(lexicon, automaton, t)) for t, y in labelled])


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, train=None, least: int = 5, share: float = 0.015, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learns from at most ``sample`` labelled texts, those with the smallest hashes of their ids.

    ``train``: a condition on ``id_col`` that rows must meet; null ids and labels are left out, and equal texts of one
    label count once.  The driver gets the entries that reach ``share``, at most (entries of a text) / share of them.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    if train is not None:
        rows = rows.where(train(F.col("id")))
    chosen = rows.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    every = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    # at most ``sample`` ids, then at most as many texts, whatever repeats
    lean = every.select("id", "h").join(F.broadcast(chosen), "id").groupBy("h", "y").agg(F.min("id").alias("id")).orderBy(F.xxhash64("id"), "id", "h", "y").limit(sample)
    texts = written(every.join(F.broadcast(lean), ["id", "h"]).dropDuplicates(["h", "y"]).select("t", "y"), "labelled")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lengths = Counts(), [Counter(), Counter()]

        def rows(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        def entries():
            for some in itertools.batched(list(counts.held), 10_000):
                yield rows(some, [None] * len(some), *([c[e] for e in some] for c in (counts.held, *counts.rates)))

        for b in batches:
            for t, y in zip(b.column("t"), b.column("y").to_pylist()):
                forms = fold_both(t.as_py())
                counts.add(forms, y)
                lengths[y][forms[0].count(" ")] += 1
                if len(counts.held) > HELD:
                    yield from entries()
                    counts = Counts()
        yield from entries()
        # lengths: how many texts of either label have so many blanks
        sizes = sorted(lengths[0].keys() | lengths[1].keys())
        yield rows([None] * len(sizes), sizes, [0] * len(sizes), *([float(n[k]) for k in sizes] for n in lengths))
        del counts, lengths
        _word_entries.cache_clear()
        trim()

    names, kinds = ["entry", "length", "held", "rate0", "rate1"], (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    sums = written(texts.mapInArrow(counted, "entry string, length long, held long, rate0 double, rate1 double").groupBy("entry", "length").agg(*(F.sum(c).alias(c) for c in names[2:])), "counts")
    lengths = sorted((r["length"], r["rate0"], r["rate1"]) for r in sums.where("entry IS NULL").collect())  # at most ``sample`` rows
    n0, n1 = (int(sum(r[k] for r in lengths)) for k in (1, 2))
    if not n0 or not n1:
        return Lexicon(exceptions=exceptions)
    seen, middle = 0, 1
    for middle, a, b in lengths:
        seen += a + b
        if seen > (n0 + n1) // 2:
            break
    frequent = sums.where((F.col("entry").isNotNull()) & (F.col("held") >= max(least, share * n1))).collect()
    held = {r["entry"]: r["held"] for r in frequent}
    rates = {r["entry"]: r["rate0"] for r in frequent}, {r["entry"]: r["rate1"] for r in frequent}
    lexicon = Lexicon(weights_of(held, rates, n0, n1, middle), exceptions)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([densities(lexicon, automaton, t.as_py()) for t in b.column("t")], pa.list_(pa.float64()))], names=["y", "d"])

    out = limited(lexicon, [(r["y"], r["d"]) for r in texts.mapInArrow(measured, "y int, d array<double>").collect()])  # at most ``sample`` rows
    discard(texts)
    discard(sums)
    return out


def apply(docs: DataFrame, lexicon: Lexicon, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1; a null text counts as empty.  Replaces a column of that name."""
    kept = [c for c in docs.columns if c != score_col]
    out = T.StructType([*(docs.schema[c] for c in kept), T.StructField(score_col, T.DoubleType())])
    at = kept.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in batches:
            values = [lexicon.score(automaton, t.as_py() or "") for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.float64())], names=out.names)

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(scored, out)


def train_rows(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **options) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document; learns without the held-out third."""
    lexicon = fit(docs, labels, train=train_rows, **options)
    scored = apply(docs.select("doc_id", "text"), lexicon)
    return scored.select("doc_id", (~F.coalesce(train_rows(F.col("doc_id")), F.lit(True))).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
