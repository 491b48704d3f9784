"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become classes (insult, violent verb, intent, target, negation, reporting, parts of insulting phrases, clause end,
other). Five Mealy machines rewrite the class stream: insults (single words and phrases), threats (an intent, a
violent verb and its target, in any order that begins with the intent), reported speech, negation, target. Their
composition is one machine whose output symbols are clause patterns: an insult or threat, plain or aimed at
someone, negated, reported. Each pattern has a weight, each lexicon entry its own. A clause counts by its
strongest pattern, however often words repeat in it; a document's score is the noisy-or of its matched clauses.
Lexicon entries (words and stems) and pattern weights are learnt from labels, with priors. A stem is a word beginning
at which the toxic forms branch out, so the beginning of a single insult, which ordinary words share, is none; and a
form that was never seen itself needs an aim or a second insult beside it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, discard, held_out, keep_rows, made, scratch, tidied, training_sample

# Word classes that don't depend on labels.
TARGETS = frozenset("you your yours yourself u ur they them he she him her du dich dir ihr euch sie er tu te toi vous il elle ils usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't doesn't didn't hardly nicht kein keine keinen nie niemals ne pas jamais aucun nunca tampoco jamás ni".split())
REPORTING = frozenset("said says say wrote writes claimed claims quoted reported called told sagte sagt schrieb behauptet nannte dit écrit prétend affirme dijo dice escribió afirma llamó".split())
VIOLENCE = frozenset("kill murder strangle stab shoot hurt destroy beat burn umbringen töten erschießen schlagen verletzen tuer égorger frapper matar apuñalar disparar golpear".split())
INTENTS = frozenset("will i'll we'll gonna going shall should must want wanna werde werden wirst will'st soll sollte vais va allons veux dois voy vamos quiero debo".split())
REFLEXIVES = frozenset("yourself urself yourselves".split())
#: Phrases such as "piece of trash": an opener, a link, a thing.
OPENERS = frozenset("piece waste sack bag pile heap stück haufen tas morceau pedazo montón".split())
LINKS = frozenset("of de d'".split())
THINGS = frozenset("trash garbage crap shit filth dirt dreck scheiße merde ordures mierda basura space oxygen".split())
#: Seeds used beside what labels teach.
INSULTS = frozenset("idiot idiots moron morons scum loser losers stupid worthless pathetic imbecile bastard vermin filth dumbass dummkopf arschloch abschaum connard crétin ordure imbécil basura escoria".split())

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;\n]|[\"“”«»]")
LETTERS = re.compile(r"[^\W\d_]+")
BREAK = re.compile(r"[.!?;\n]")


@dataclass
class Mealy:
    """A deterministic letter-to-letter transducer; ``step`` gives (next state, output symbol)."""

    start: tuple
    step: object
    table: dict = field(default_factory=dict)

    def run(self, symbols: list[str]) -> list[str]:
        state, out = self.start, []
        for s in symbols:
            if (state, s) not in self.table:
                self.table[state, s] = self.step(state, s)
            state, o = self.table[state, s]
            out.append(o)
        return out


def compose(first: Mealy, second: Mealy) -> Mealy:
    """The machine that feeds first's output to second; its transition table fills as states are reached."""

    def step(state, symbol):
        a, middle = first.step(state[0], symbol)
        b, out = second.step(state[1], middle)
        return (a, b), out

    return Mealy((first.start, second.start), step)


def _insults() -> Mealy:
    """Insulting words (I) stand for themselves; an opener, a link and a thing in a row (P F G) make one too."""

    def step(state, s):
        at = state[0]
        if s == "P":
            return (1,), "O"
        if s == "F" and at == 1:
            return (2,), "O"
        if s == "G":
            return (0,), "I" if at == 2 else "O"
        if s == "T" and at == 2:  # piece of your trash
            return state, s
        return (0,), "O" if s == "F" else s

    return Mealy((0,), step)


def _threats(reach: int = 5) -> Mealy:
    """An intent (M), then a violent verb (V) and a target (T) in either order, each within ``reach`` words of the one
    before, make a threat (H) at the last of them; so does a verb with a reflexive target (Y) right behind it."""

    def step(state, s):
        intent, verb, target, bare = state
        less = (max(0, intent - 1), max(0, verb - 1), max(0, target - 1), 0)
        if s == "E":
            return (0, 0, 0, 0), s
        if s == "M":
            return (reach, *less[1:]), "O"
        if s == "V":
            if target:
                return (less[0], 0, 0, 1), "H"
            return (less[0], reach if intent else 0, 0, 1), "O"
        if s in ("T", "Y"):
            if verb or (bare and s == "Y"):
                return (0, 0, 0, 0), "H"
            return (less[0], less[1], reach if intent else less[2], 0), "T"
        return less, s

    return Mealy((0, 0, 0, 0), step)


def _reported() -> Mealy:
    """After a reporting verb, up to the clause's end, insults (I) and threats (H) are reported (R-)."""

    def step(state, s):
        if s == "E":
            return (0,), s
        if s == "S":
            return (1,), s
        return state, f"R{s}" if state[0] and s[-1] in "IH" else s

    return Mealy((0,), step)


def _negated(reach: int = 3) -> Mealy:
    """An insult or threat within ``reach`` words after a negation is negated (N-)."""

    def step(state, s):
        left = state[0]
        if s == "E":
            return (0,), s
        if s == "N":
            return (reach,), s
        return (max(0, left - 1),), f"N{s}" if left and s[-1] in "IH" else s

    return Mealy((0,), step)


def _aimed(reach: int = 4) -> Mealy:
    """An insult or threat within ``reach`` words after a target is aimed (T-); a target soon after one becomes A."""

    def step(state, s):
        target, hit = state
        if s == "E":
            return (0, 0), s
        if s == "T":
            return (reach, max(0, hit - 1)), "A" if hit else "T"
        if s[-1] in "IH":
            return (max(0, target - 1), reach), f"T{s}" if target else s
        return (max(0, target - 1), max(0, hit - 1)), s

    return Mealy((0, 0), step)


def grammar() -> Mealy:
    return compose(compose(compose(compose(_insults(), _threats()), _reported()), _negated()), _aimed())


#: Prior probability that a document whose only match has this pattern is toxic; R reported, N negated, T aimed.
PRIORS = {"I": 0.7, "TI": 0.85, "NI": 0.3, "RI": 0.35, "NRI": 0.2, "H": 0.8, "NH": 0.15, "RH": 0.25, "NRH": 0.1}
PRIOR_ROWS = 6.0
#: Continuations that a word beginning must have in toxic documents to be a stem; what a plain match of a stem alone weighs.
BRANCHES, UNSEEN = 4, 0.6
#: Share of the sampled toxic documents that an entry must newly explain.
EXPLAINS = 0.005
#: A score of documents without any match.
NOTHING = 0.02


def pattern(symbol: str) -> str:
    """The weight class of an output symbol: aim is kept only for plain insults, as threats have a target anyway."""
    core = symbol.replace("T", "")
    return "TI" if symbol[0] == "T" and core == "I" else core


@dataclass(frozen=True)
class ToxicityModel:
    """entries: lexicon key -> evidence (words, and stems ending in *); patterns: probability by pattern."""

    entries: dict[str, float]
    patterns: dict[str, float]


class Matcher:
    """Finds clauses with insults or threats and reads them with the composed machine."""

    def __init__(self, entries: dict[str, float]):
        self.words = {k: v for k, v in entries.items() if not k.endswith("*")}
        self.begins = {k[:-1]: v for k, v in entries.items() if k.endswith("*")}
        self.lengths = sorted({len(k) for k in self.begins})
        self.machine = grammar()
        self.auto = ahocorasick.Automaton()
        for key in {*self.words, *self.begins, *VIOLENCE, *THINGS}:
            self.auto.add_word(key, len(key))
        self.auto.make_automaton()

    def evidence(self, word: str) -> float:
        """The lexicon's probability for a word; 0 for a word outside it."""
        own = self.words.get(word, 0.0)
        for n in self.lengths:
            if n > len(word):
                break
            own = max(own, self.begins.get(word[:n], 0.0))
        return own

    def kind(self, token: str) -> str:
        if len(token) == 1 and token in ".!?;\n":
            return "E"
        if self.evidence(token):
            return "I"
        return _CLASSES.get(token, "O")

    def matches(self, text: str | None) -> list[list[tuple[str, float, str, bool]]]:
        """For each clause with insults or threats their (pattern, evidence, word, whether that very word is known)."""
        if not text:
            return []
        low, found, done = text.lower(), [], 0
        for end, n in self.auto.iter(low):
            start = end - n + 1
            if end < done or start and low[start - 1].isalpha():
                continue
            left = done  # the clause is read whole, so that no machine forgets how it began
            for m in BREAK.finditer(low, done, start):
                left = m.end()
            stop = BREAK.search(low, end + 1)
            done = stop.start() if stop else len(low)
            tokens = WORD.findall(low, left, done)
            out = self.machine.run([*map(self.kind, tokens)])
            clause = []
            for k, (token, s) in enumerate(zip(tokens, out, strict=True)):
                if s[-1] in "IH":
                    aimed = s if s[0] == "T" or "A" not in out[k + 1 : k + 5] else f"T{s}"
                    clause.append((pattern(aimed), self.evidence(token) or 1.0, token, s[-1] == "H" or token in self.words or token in THINGS))
            if clause:
                found.append(clause)
        return found


#: Classes of words outside the lexicon; a word of several sets has the last one's.
_CLASSES = {w: c for c, words in (("F", LINKS), ("P", OPENERS), ("G", THINGS), ("M", INTENTS), ("S", {*REPORTING, *'"“”«»'}), ("T", TARGETS), ("Y", REFLEXIVES), ("N", NEGATIONS), ("V", VIOLENCE)) for w in words}


def _weight(p: float) -> float:
    return -math.log1p(-min(p, 0.999))


def combine(clauses: list[list[tuple[str, float, str, bool]]], patterns: dict[str, float]) -> float:
    """Noisy-or over clauses: 1 - exp(-sum of each clause's largest pattern weight * evidence), from NOTHING upwards.

    Where a document's matches are all one word, known by its stem only, its plain clauses together weigh UNSEEN at most.
    """
    alone = len({w for own in clauses for _, _, w, _ in own}) < 2
    total = doubtful = 0.0
    for own in clauses:
        weight, sure = max((_weight(patterns[p]) * e, known or p != "I" or not alone) for p, e, _, known in own)
        total, doubtful = total + weight * sure, doubtful + weight * (not sure)
    return 1 - (1 - NOTHING) * math.exp(-total - min(doubtful, UNSEEN))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 8000, max_bytes: int = 40_000, least: float = 16.0, max_entries: int = 20_000) -> ToxicityModel:
    """Learns the lexicon and pattern weights from at most ``per_class`` labelled rows of each class.

    A word, or a stem of 4 to 8 letters, enters if nearly all sampled documents that hold it are toxic, with odds
    against chance of e**least. A stem is a beginning that goes on in BRANCHES ways at least in toxic documents, and the
    fewer they are, the less it tells of forms not seen. The ``max_entries`` most telling ones are kept, of which those
    enter that newly explain a share EXPLAINS of the toxic documents. Pattern weights are the share of toxic ones among
    documents with that pattern only, drawn to their priors.

    Null labels, null ids, null and empty texts, and texts over ``max_bytes`` teach nothing. Equal texts count once, as
    toxic if any of them is. Empty tables give the seeds and priors.
    """
    before = made()
    sample = scratch(training_sample(docs, labels, "toxic", per_class, max_bytes).groupBy("text").agg(F.max("y").alias("y")), "toxicity-sample")  # documents are read once

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def flush() -> pd.DataFrame:
            rows = [(k, n * (1 - y), n * y) for y in (0, 1) for k, n in seen[y].items()]
            for c in seen.values():
                c.clear()
            return pd.DataFrame(rows, columns=["entry", "clean", "toxic"])

        for batch in batches:
            for text, y in zip(batch["text"], batch["y"], strict=True):
                words = set(LETTERS.findall(text.lower()))
                seen[y].update(words | {f"{w[:n]}*" for w in words for n in range(4, min(9, len(w)) + 1)})
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield flush()
        yield flush()

    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    entries = {k: 0.9 for k in INSULTS}
    if 0 < share < 1:
        counts = sample.mapInPandas(tidied(count), "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        counts = counts.persist()
        stem, odds = F.col("entry").endswith("*"), F.col("toxic") * -math.log(share) - F.col("clean") * 8
        # One letter less than a beginning, and all of a word: what branches out of a shorter beginning.
        parent = F.when(stem, F.expr("concat(left(entry, char_length(entry) - 2), '*')")).otherwise(F.concat("entry", F.lit("*")))
        ways = counts.where("toxic > 0").groupBy(parent.alias("entry")).agg(F.count("*").alias("ways"))
        able = counts.where((F.col("toxic") >= 4) & (odds >= least) & (F.col("toxic") >= 30 * F.col("clean")))
        able = able.join(ways, "entry", "left").where(~stem | ((F.col("ways") >= BRANCHES) & (F.char_length("entry") <= 9)))
        top = able.orderBy(F.desc("toxic"), "entry").limit(max_entries).collect()
        counts.unpersist()
        pure = {r["entry"]: (r["toxic"] + 1) / (r["toxic"] + r["clean"] + 1.1) * (r["ways"] / (r["ways"] + 1) if r["entry"].endswith("*") else 1) for r in top}
        entries |= _cover(sample.where("y = 1"), pure, totals[1])
    patterns = dict(PRIORS)
    if totals:
        matched = _pattern_counts(sample, entries)
        for p, prior in PRIORS.items():
            toxic, n = matched.get(p, (0, 0))
            patterns[p] = (toxic + PRIOR_ROWS * prior) / (n + PRIOR_ROWS)
    discard(before)
    return ToxicityModel(entries, patterns)


def _cover(toxic: DataFrame, pure: dict[str, float], n: int) -> dict[str, float]:
    """The entries that explain the ``n`` toxic documents: greedily by size, those that newly explain a share EXPLAINS of
    them, those a tenth as frequent as the most frequent one, and whole words of chosen stems, which are known then.

    Words that merely belong to a much-copied toxic document explain nothing new and stay out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = []
            for text in batch["text"]:
                words = set(LETTERS.findall(text.lower()))
                held.append(sorted(k for w in words for k in (w, *(f"{w[:n]}*" for n in range(4, min(8, len(w)) + 1))) if k in pure))
            yield pd.DataFrame({"held": held})

    docs_of: dict[str, set[int]] = {k: set() for k in pure}
    for i, r in enumerate(toxic.mapInPandas(tidied(run), "held array<string>").collect()):
        for k in r["held"]:
            docs_of[k].add(i)
    chosen, explained = {}, set()
    most = max(map(len, docs_of.values()), default=0)
    for k in sorted(docs_of, key=lambda k: (-len(docs_of[k]), k)):
        if len(docs_of[k] - explained) >= max(1, EXPLAINS * n) or 10 * len(docs_of[k]) >= most:
            chosen[k] = pure[k]
            explained |= docs_of[k]
    stems = {k[:-1] for k in chosen if k.endswith("*")}
    return chosen | {k: p for k, p in pure.items() if not k.endswith("*") and any(k[:i] in stems for i in range(4, min(8, len(k)) + 1))}


def _pattern_counts(sample: DataFrame, entries: dict[str, float]) -> dict[str, tuple[int, int]]:
    """By pattern: toxic documents and all documents among those whose matches all have it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, found = Matcher(entries), Counter()
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"], strict=True):
                kinds = {p for own in matcher.matches(text) for p, *_ in own}
                if len(kinds) == 1:
                    found[kinds.pop(), int(y)] += 1
        yield pd.DataFrame([(p, y, n) for (p, y), n in found.items()], columns=["pattern", "y", "n"])

    out: dict[str, tuple[int, int]] = {}
    for r in sample.mapInPandas(tidied(run), "pattern string, y int, n long").groupBy("pattern", "y").agg(F.sum("n").alias("n")).collect():
        toxic, n = out.get(r["pattern"], (0, 0))
        out[r["pattern"]] = (toxic + r["n"] * r["y"], n + r["n"])
    return out


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and n_matches (matched clauses) of every whole text.

    Clauses end at stops, semicolons and line feeds and are read whole, however long. Null and empty texts match nothing and get the lowest score. Repeated rows are scored alike; other columns
    are not read; an empty table gives no rows.
    """

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")

    def factory():
        matcher = Matcher(model.entries)

        def make(texts: list) -> dict[str, list]:
            found = [matcher.matches(t) for t in texts]
            return {"score": [combine(m, model.patterns) for m in found], "n_matches": [len(m) for m in found]}

        return make

    scored = add_columns(own, "text", "score double, n_matches int", factory)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_matches")


def reject(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text scores below ``threshold``.

    Null and empty texts stay; repeated rows stay or go together; an empty table gives no rows.
    """

    def factory():
        matcher = Matcher(model.entries)
        return lambda texts: [combine(matcher.matches(t), model.patterns) < threshold for t in texts]

    return keep_rows(docs, "text", factory)
