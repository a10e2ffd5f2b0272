"""Toxicity by a weighted finite-state pattern grammar.

A text is read as clauses of words. A *lexicon transducer* turns each word into a class (insult, threat, target,
negation, reported speech, intensifier, intent, other): its entries are whole words, seeds and those that labelled
documents show to be toxic, and stems with any ending where many words of one stem are. Edit arcs let a spelling vary:
a letter repeated, a digit for a letter, up to CUT letters cut off a long word. Five *grammar transducers* read the
classes of a clause, each handing its output to the next:

    insult    an insult behind an intensifier is marked strong ("utter fool")
    threat    a threat behind a word of intent is marked strong ("will hurt")
    target    an insult or threat near a person is marked aimed, on either side
    negation  what follows a negation is marked negated
    report    what is said to have been said, before or after, is marked reported

They are composed into two deterministic machines, one read from the clause's begin and one from its end; at each
insult or threat the marks of both are joined. Arcs have weights: one for the class, one for each mark, one for the
lexicon's log odds and one for each edit. Weights add up along a path, the best path is the clause's weight z, and
a text is toxic if any of its clauses is: p = 1 - (1 - p0) * product over matched clauses of 1 - sigmoid(z).
Only matched clauses count, and one whose arcs weigh little ("is not an idiot", "was called an idiot") adds next to nothing.

The arcs' weights are learned from labelled documents by maximum likelihood, with a Gaussian prior around ARCS.

Results: null, empty and word-free texts get the score of a text without matches; every document gets
one row, repeated ids repeated rows; an empty table gives none; with no labelled rows the grammar's own weights hold.
Texts of any length are used whole. lang, source, doc_id and labels are never inputs of a score; other columns are not
read. The model is fitted on at most about FIT_ROWS labelled ids (a hash sample of those whose crc32(doc_id) mod 5 is
not 0, with one text each, the least, and one label each, the largest); everything is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import crc_remainder, in_pandas

FIT_ROWS = 16_000
#: A word or stem becomes an insult if its toxic documents exceed what its number of documents leads to expect by
#: this many standard deviations, and its log odds reach LEAST_ODDS.
LEAST_DEVIATIONS, LEAST_ODDS = 6.0, 2.0
#: A stem of which one longer stem or word has this share is that one; words of a stem have odds of their own from so many documents on.
CLOSED, KNOWN_DOCS = 0.8, 8
#: Letters of stems, and letters that may be cut off words of CUT_FROM letters or more.
STEM_LETTERS, CUT, CUT_FROM = (3, 8), 2, 7
#: Longer words are classified anew each time, so that a worker's memory does not grow with them.
KEPT_WORDS, KEPT_LETTERS = 200_000, 40

WORD = re.compile(r"[^\W_]+(?:'[a-z]+)?|[.!?;:\n]")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENSIFIER, INTENT, STOP = range(9)

# Seed words of the classes.
SEEDS = {
    INSULT: "idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown filth vermin imbecile fool jerk",
    THREAT: "kill hurt destroy shoot stab burn beat hang strangle crush",
    TARGET: "you your yours yourself he him his she her they them their who these those people everyone tu vous toi du dich euch ihr tú usted ustedes",
    NEGATION: "not no never neither nor without hardly isn't aren't wasn't don't doesn't didn't won't can't nicht kein keine nie pas jamais sin nunca",
    REPORT: "said says say claimed claims called wrote quoted quote reported allegedly dit sagte dijo",
    INTENSIFIER: "utter complete total absolute absolutely totally such so real fucking bloody damn total très so muy",
    INTENT: "will shall must should gonna going i'll we'll want let werde vais voy",
}
SEED_ODDS = 3.0
#: What digits stand for.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}

#: A symbol is a class and the marks that transducers have put on it.
KIND, STRONG, AIMED, NEGATED, REPORTED = 15, 16, 32, 64, 128
MARKS = (STRONG, AIMED, NEGATED, REPORTED)


@dataclass(frozen=True)
class Transducer:
    """Deterministic, one output for each input: after `cue`, symbols of the classes `over` within `reach` words get `mark`."""

    cue: int
    reach: int
    mark: int
    over: tuple[int, ...] = (INSULT, THREAT)

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, output); a state is the number of words that the cue still reaches."""
        kind = symbol & KIND
        if kind == STOP:
            return 0, symbol
        if kind == self.cue:
            return self.reach, symbol
        return max(0, state - 1), symbol | self.mark if state and kind in self.over else symbol


#: Read from the clause's begin: insult, threat, target, negation, report; from its end: target, report.
FORTH = (Transducer(INTENSIFIER, 2, STRONG, (INSULT,)), Transducer(INTENT, 3, STRONG, (THREAT,)), Transducer(TARGET, 5, AIMED), Transducer(NEGATION, 3, NEGATED), Transducer(REPORT, 8, REPORTED))
BACK = (Transducer(TARGET, 3, AIMED), Transducer(REPORT, 4, REPORTED))


def compose(machines: tuple[Transducer, ...]) -> list[list[tuple[int, int]]]:
    """The product machine: rows are states, columns input classes, entries (next state, output)."""
    names = {(0,) * len(machines): 0}
    rows, waiting = [], [(0,) * len(machines)]
    while waiting:
        states, row = waiting.pop(0), []
        for symbol in range(STOP + 1):
            nexts, out = [], symbol
            for machine, state in zip(machines, states, strict=True):
                state, out = machine.step(state, out)
                nexts.append(state)
            key = tuple(nexts)
            if key not in names:
                names[key] = len(names)
                waiting.append(key)
            row.append((names[key], out))
        rows.append(row)
    return rows


MACHINE, REVERSED = compose(FORTH), compose(BACK)

#: The arcs that have weights, what they weigh without labels, and the logit of a text without matches.
ARC_NAMES = ("insult", "threat", "strong", "aimed", "negated", "reported", "log odds", "edit")
ARCS = np.array([-1.5, -2.0, 0.7, 1.0, -3.0, -2.0, 0.7, -0.5])
BASE = -4.0


class Lexicon:
    """The first transducer, as a trie with edit arcs: the best path of a word decides its class, log odds and edits."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        entries: dict[str, tuple[int, float]] = {w: (kind, SEED_ODDS) for kind, listed in SEEDS.items() for w in listed.split()}
        for word, odds in words.items():
            kind = entries.get(word, (INSULT, 0.0))[0]
            if kind in (INSULT, THREAT):  # other classes keep their meaning
                # a word of a stem that is no insult is none; a seed stays one, whatever its odds
                entries[word] = (kind if odds >= LEAST_ODDS / 2 or word in entries else OTHER, max(odds, 0.0))
        self.entries, self.stems, self.kept = entries, stems, {}
        self.longest = max(map(len, stems), default=0)
        self.trie: dict = {}
        for word, known in entries.items():
            if known[0] in (INSULT, THREAT):
                node = self.trie
                for k, letter in enumerate(word):
                    node = node.setdefault(letter, {})
                    left = len(word) - k - 1
                    if left and left <= CUT and len(word) >= CUT_FROM:
                        node.setdefault("", []).append((left, known))
                node.setdefault("", []).append((0, known))

    def varied(self, word: str) -> tuple[int, float, int]:
        """The best reading of a spelling that is no entry: fewest edits, then the greatest log odds."""
        states: dict[int, tuple[dict, str, int]] = {id(self.trie): (self.trie, "", 0)}
        for c in word:
            new: dict[tuple[int, str], tuple[dict, str, int]] = {}
            for node, last, edits in states.values():
                plain = DIGITS.get(c)
                for letter, cost in ((c, 0), (plain, 1)):
                    if letter and letter in node:
                        key = (id(node[letter]), letter)
                        if key not in new or new[key][2] > edits + cost:
                            new[key] = (node[letter], letter, edits + cost)
                if last and last in (c, plain):
                    key = (id(node), last)
                    if key not in new or new[key][2] > edits + 1:
                        new[key] = (node, last, edits + 1)
            if not new:
                return OTHER, 0.0, 0
            states = new
        ends = [(edits + left, -odds, kind) for node, _, edits in states.values() for left, (kind, odds) in node.get("", ())]
        if not ends:
            return OTHER, 0.0, 0
        edits, odds, kind = min(ends)
        # a short word with many edits is another word
        return (kind, -odds, edits) if edits * 2 <= len(word) else (OTHER, 0.0, 0)

    def word(self, word: str) -> tuple[int, float, int]:
        """(class, log odds, edits) of a lower-case word or a stop."""
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        if word in ".!?;:\n":
            known = STOP, 0.0, 0
        elif word in self.entries:
            known = *self.entries[word], 0
        else:
            stem = next((word[:n] for n in range(min(len(word) - 1, self.longest), STEM_LETTERS[0] - 1, -1) if word[:n] in self.stems), None)
            known = (INSULT, self.stems[stem], 0) if stem else self.varied(word)
        if len(word) <= KEPT_LETTERS:
            self.kept[word] = known
        return known


def clause_matches(clause: list[tuple[int, float, int]]) -> list[tuple[int, float, int]]:
    """(symbol, log odds, edits) of each insult and threat of one clause, the symbol with the marks of both machines."""
    behind, state = [], 0
    for kind, *_ in reversed(clause):
        state, written = REVERSED[state][kind]
        behind.append(written)
    out, state = [], 0
    for (kind, odds, edits), back in zip(clause, reversed(behind), strict=True):
        state, written = MACHINE[state][kind]
        if kind == INSULT or kind == THREAT:
            out.append((written | back, odds, edits))
    return out


def matched_clauses(text: str, lexicon: Lexicon) -> list[list[tuple[int, float, int]]]:
    """The matches of each clause that has any."""
    kept, classify = lexicon.kept.get, lexicon.word
    classes = [kept(w) or classify(w) for w in WORD.findall(text.lower())]
    out, done = [], 0
    for i in (i for i, c in enumerate(classes) if c[0] == INSULT or c[0] == THREAT):
        if i < done:
            continue
        begin = i
        while begin > done and classes[begin - 1][0] != STOP:
            begin -= 1
        done = i
        while done < len(classes) and classes[done][0] != STOP:
            done += 1
        out.append(clause_matches(classes[begin:done]))
    return out


def arc_counts(symbol: int, odds: float, edits: int) -> list[float]:
    """How often a match's path takes each of ARC_NAMES (the log odds: how much of it)."""
    return [float(symbol & KIND == INSULT), float(symbol & KIND == THREAT), *(float(symbol & m > 0) for m in MARKS), odds, float(edits)]


def told_clauses(text: str, lexicon: Lexicon) -> list[tuple[int, list[list[float]]]]:
    """The distinct matched clauses of a text: how often each occurs, and the arc counts of its matches."""
    found = Counter(tuple(sorted(set(m))) for m in matched_clauses(text, lexicon))
    return [(n, [arc_counts(*m) for m in matches]) for matches, n in found.items()]


@dataclass
class ToxicityModel:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    arcs: np.ndarray = field(default_factory=ARCS.copy)
    base: float = BASE

    def __post_init__(self) -> None:
        # the arcs of a symbol's class and marks, added up
        self.of_symbol = [float(np.dot(arc_counts(s, 0.0, 0), self.arcs)) for s in range(256)]

    def clause_weight(self, matches: list[tuple[int, float, int]]) -> float:
        """The weight of the best path."""
        return max(self.of_symbol[symbol] + self.arcs[6] * odds + self.arcs[7] * edits for symbol, odds, edits in matches)

    def score(self, clauses: list[list[tuple[int, float, int]]]) -> float:
        """The probability that any clause is toxic."""
        clean = -np.logaddexp(0, self.base)
        for matches in clauses:
            clean -= np.logaddexp(0, self.clause_weight(matches))
        return float(-np.expm1(clean))


def _spellings(text: str) -> Counter:
    """How often each word (with $) and each of its stems occurs."""
    out: Counter = Counter()
    for word, n in Counter(w for w in WORD.findall(text.lower()) if len(w) > 2).items():
        out[word + "$"] += n
        for k in range(STEM_LETTERS[0], min(len(word), STEM_LETTERS[1]) + 1):
            out[word[:k]] += n
    return out


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their log odds, from the sample's (text, toxic) rows; counted in Spark.

    An entry has to stand in many of the sample's toxic rows, so the sample bounds them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, list[int]] = {}
        for pdf in batches:
            for text, toxic in zip(pdf.text, pdf.toxic, strict=True):
                for spelling in _spellings(text):
                    counts.setdefault(spelling, [0, 0])[0 if toxic else 1] += 1
        yield pd.DataFrame([(s, *c) for s, c in counts.items()], columns=["spelling", "toxic_docs", "clean_docs"])

    totals = sample.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    toxic, clean = totals.t or 0, totals.c or 0
    if not toxic:
        return {}, {}
    counted = sample.select("text", "toxic").mapInPandas(run, "spelling string, toxic_docs long, clean_docs long")
    odds = F.log((F.col("toxic_docs") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean_docs") + 0.5) / (clean + 1.0))
    summed = counted.groupBy("spelling").agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("clean_docs").alias("clean_docs")).withColumn("odds", odds).persist()
    expected = (F.col("toxic_docs") + F.col("clean_docs")) * (toxic / (toxic + clean))
    unlikely = (F.col("toxic_docs") - expected >= LEAST_DEVIATIONS * F.sqrt(expected)) & (F.col("odds") >= LEAST_ODDS)
    found = {r.spelling: (r.odds, r.toxic_docs) for r in summed.filter(unlikely).collect()}
    longer: Counter = Counter()
    for spelling, (_, docs) in found.items():
        for k in range(STEM_LETTERS[0], len(spelling)):
            longer[spelling[:k]] = max(longer[spelling[:k]], docs)
    stems = {s: min(5.0, o) for s, (o, docs) in found.items() if not s.endswith("$") and longer[s] < CLOSED * docs}
    stems = {s: o for s, o in stems.items() if not any(s[:k] in stems for k in range(STEM_LETTERS[0], len(s)))}
    words = {s[:-1]: min(5.0, o) for s, (o, _) in found.items() if s.endswith("$")}
    if stems:
        of_stem = F.col("spelling").rlike("^(?:" + "|".join(sorted(stems)) + ").*[$]$") & (F.col("toxic_docs") + F.col("clean_docs") >= KNOWN_DOCS)
        words |= {r.spelling[:-1]: min(5.0, r.odds) for r in summed.filter(of_stem).collect()}
    summed.unpersist()
    return words, stems


def labelled_sample(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, text and toxic of about fit_rows labelled ids at most, one row each, and `part`, 0 to 9; held-out ids are never among them."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(crc_remainder("doc_id", 5) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, fit_rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < int(share * 1_000_000))
    # ids and labels of the sample are broadcast; of an id's texts the least, by a partial aggregate
    mine = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = mine.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return sample.withColumn("part", F.pmod(F.crc32(F.concat(F.lit("fold"), F.col("doc_id"))), F.lit(10)))


def fit_toxicity(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learns the lexicon on most of the sample and the arcs' weights on the rest of it."""
    sample = labelled_sample(documents, labels, fit_rows).persist()
    words, stems = learn_lexicon(sample.filter("part < 7"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(words, stems)
        for pdf in batches:
            told = [[{"times": n, "matches": m} for n, m in told_clauses(t, lexicon)] for t in pdf.text]
            yield pd.DataFrame({"clauses": told, "toxic": pdf.toxic})

    # a row for each id of the sample
    rows = sample.filter("part >= 7").select("text", "toxic").mapInPandas(run, "clauses array<struct<times: long, matches: array<array<double>>>>, toxic int").collect()
    sample.unpersist()
    if not rows:
        return ToxicityModel(words, stems)
    clauses = [[(c.times, np.array(c.matches, float)) for c in r.clauses] for r in rows]
    arcs, base = fit_arcs(clauses, np.array([r.toxic for r in rows], float))
    return ToxicityModel(words, stems, arcs, base)


def fit_arcs(documents: list[list[tuple[int, np.ndarray]]], toxic: np.ndarray, strength: float = 1.0, rounds: int = 4) -> tuple[np.ndarray, float]:
    """The arcs' weights and the base that make the labels likeliest, with a Gaussian prior around ARCS and BASE.

    documents: for each one its matched clauses, as how often they occur and a row of arc counts for each match. The best
    path of each clause is chosen by the weights so far, then these are fitted to the chosen paths, and again.
    """
    of = np.array([i for i, d in enumerate(documents) for _ in d], int)
    times = np.array([n for d in documents for n, _ in d], float)
    matches = [m for d in documents for _, m in d]
    prior = np.append(ARCS, BASE)
    w = prior.copy()

    def clean_logs(w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = x @ w[:-1]
        return z, -np.logaddexp(0, w[-1]) - np.bincount(of, weights=times * np.logaddexp(0, z), minlength=len(documents))

    def loss(w: np.ndarray, x: np.ndarray) -> float:
        log = np.minimum(clean_logs(w, x)[1], -1e-12)
        return float(-np.where(toxic > 0, np.log(-np.expm1(log)), log).sum() + strength / 2 * ((w - prior) ** 2).sum())

    for _ in range(rounds):
        x = np.array([m[np.argmax(m @ w[:-1])] for m in matches]).reshape(-1, len(ARCS))
        for _ in range(200):
            z, log = clean_logs(w, x)
            log = np.minimum(log, -1e-12)
            # d loss / d log p(clean): -1 for clean rows, p(clean) / p(toxic) for toxic ones
            pull = np.where(toxic > 0, np.exp(log) / -np.expm1(log), -1.0)
            by_clause = pull[of] * -times / (1 + np.exp(-z)) if len(of) else np.zeros(0)
            slope = np.append(by_clause @ x if len(of) else np.zeros(len(ARCS)), (pull * -1 / (1 + np.exp(-w[-1]))).sum()) + strength * (w - prior)
            curve = strength * np.eye(len(w))
            rows = np.zeros((len(documents), len(w)))
            if len(of):
                for k in range(len(ARCS)):
                    rows[:, k] = np.bincount(of, weights=times * x[:, k] / (1 + np.exp(-z)), minlength=len(documents))
            rows[:, -1] = 1 / (1 + np.exp(-w[-1]))
            # the information of each row about log p(clean)
            told = np.exp(log) / -np.expm1(log)
            curve += (rows * np.minimum(told, 1e6)[:, None]).T @ rows
            change = -np.linalg.solve(curve, slope)
            before, step = loss(w, x), 1.0
            while step > 1e-6 and loss(w + step * change, x) > before:
                step /= 2
            if step <= 1e-6 or np.abs(step * change).max() < 1e-7:
                break
            w = w + step * change
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method, steps halved until they help, with a Gaussian prior around given weights; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + strength / 2 * ((w - prior) ** 2).sum())

    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - strength * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        change = np.linalg.solve(curve, slope)
        before = loss(w)
        while np.abs(change).max() > 1e-9 and loss(w + change) > before:
            change = change / 2
        w = w + change
        if np.abs(change).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and `score` in 0 to 1. One pass over whole texts, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(model.words, model.stems)
        for pdf in batches:
            pdf["score"] = [model.score(matched_clauses(t or "", lexicon)) for t in pdf["__text"]]
            yield pdf[[*keep, "score"]]

    return in_pandas(docs.select(*keep, F.col("text").alias("__text")), run, keep, "score double")
