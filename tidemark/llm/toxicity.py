"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns words into symbols: insult, slur, threat, target, negation, reporting word, clause
end, other. Three transducers are composed behind it into one deterministic machine: negation marks what it
reaches, reported speech marks what stands behind a reporting word in the same clause, and the last one
reads a clause to its end and says what it holds as a whole: one insult or several, a threat, each with or
without a target anywhere in the clause, and what was negated or reported. The machine gives a text's matched
clauses by kind; a score adds up weights of kinds, not of words, times the binary length of their number, so
that each doubling counts as much as the one before. A slur says little alone: what counts beside the number
of clauses with slurs is their share of all clauses. The weights and the bias are the most probable ones given
the labels, from a starting guess for each kind (PRIOR).

Insults are those listed here and words and beginnings of words learned from labels (`learn_words`): they
stand in toxic texts so much more often than in others that chance would bring less than one such among all,
with several different words before them, so the words of one text that was copied often do not count. Those
found in toxic texts nearly alone are insults; slurs are those that make up a share of the words of toxic
texts many times that of others. They are learned on at most LEXICON_ROWS labelled training rows, the least by
a hash of their ids, which bounds them too.

The fit of weights sees all labelled training documents as a histogram of those binary lengths.

Defined cases: null and blank texts match nothing and get the score of texts without a match, as long texts do
by their whole length. Null labels and labels without a document are passed over; several labels of a
document count each. Null doc_ids hash as the empty text. Without labels the starting guess is used.
Repeated rows are rows of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import operator
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

# Word lists: fixed values.
INSULTS = """idiot idiots moron morons stupid dumb trash garbage pathetic worthless disgusting clown clowns scum loser losers
imbecile imbeciles cretin fool fools jerk pig filth vermin parasite parasites degenerate coward liar freak creep
idiote idiotes connard connards conne abruti abrutis crétin débile minable dégoûtant salaud ordure pourriture
dummkopf idioten trottel arschloch blödmann widerlich erbärmlich abschaum drecksack versager
idiota idiotas estúpido estúpida imbécil basura asqueroso asquerosa patético patética escoria inútil""".split()
THREATS = """kill hurt destroy beat smash shoot stab murder burn hang strangle crush punish
tuer frapper brûler détruire töten schlagen umbringen vernichten matar golpear quemar destruir""".split()
TARGETS = """you your yours u he him his she her they them their people everyone women men
tu toi vous votre il elle ils elles du dich dir ihr sie euch er usted ustedes ellos ellas""".split()
NEGATIONS = """not no never nobody isn't aren't wasn't don't doesn't didn't won't can't without neither nor
pas jamais ne sans nicht kein keine nie ohne nunca jamás sin""".split()
REPORTS = """said says say called calls claimed claims wrote writes reported reports quoted shouted alleged stated tweeted
dit écrit déclaré appelé sagte schrieb nannte behauptet dijo escribió llamó declaró""".split()

KINDS = ("insult", "insult_at_target", "insults", "insults_at_target", "threat", "threat_at_target", "negated", "reported", "slur")
#: Starting guess of the weights, the last one for the share of clauses with a slur, and of the bias.
PRIOR = (1.5, 2.5, 2.5, 4.0, 0.5, 3.0, 0.2, 0.2, 0.3, 0.3)
BIAS = -2.5
REACH = 4
#: Labelled rows on which insults are learned, at most about.
LEXICON_ROWS = 50_000
#: Letters of a beginning that is learned; how much oftener it must stand than the longest sure word or beginning in it.
STEM = (4, 8)
GATHERS = 1.5
#: Share of toxic texts among those with a learned insult; how many times as frequent slurs are in toxic texts as
#: in others; different words before either; odds against chance.
PRECISION = 0.85
RATIO = 8.0
NEIGHBOURS = 3
SURENESS = 100
THRESHOLD = 0.7


class Transducer:
    """Deterministic: arcs[state][symbol] = (state, outputs). State 0 is the start."""

    def __init__(self, arcs: list[dict[str, tuple[int, tuple[str, ...]]]]) -> None:
        self.arcs = arcs

    def compose(self, after: Transducer) -> Transducer:
        """The machine that feeds this one's outputs to the other."""
        number, arcs, todo = {(0, 0): 0}, [], [(0, 0)]
        while len(arcs) < len(todo):
            p, q = todo[len(arcs)]
            own = {}
            for symbol, (p2, outputs) in self.arcs[p].items():
                q2, said = q, []
                for x in outputs:
                    q2, more = after.arcs[q2][x]
                    said += more
                if (p2, q2) not in number:
                    number[p2, q2] = len(todo)
                    todo.append((p2, q2))
                own[symbol] = (number[p2, q2], tuple(said))
            arcs.append(own)
        return Transducer(arcs)

    def run(self, symbols) -> Iterator[str]:
        state = 0
        for s in symbols:
            state, outputs = self.arcs[state][s]
            yield from outputs


def _negation() -> Transducer:
    """I and T become i and t within REACH words behind a negation, S nothing."""
    arcs = []
    for since in range(REACH + 1):  # 0: no negation near by
        step = (since + 1) % (REACH + 1) if since else 0
        own = {"N": (1, ("o",)), "b": (0, ("b",)), "R": (step, ("R",)), "Y": (step, ("Y",)), "o": (step, ("o",))}
        own |= {"I": (0, ("i" if since else "I",)), "T": (0, ("t" if since else "T",)), "S": (step, ("o" if since else "S",))}
        arcs.append(own)
    return Transducer(arcs)


def _reported() -> Transducer:
    """I and T become r behind a reporting word in a clause; what is negated is i."""
    arcs = []
    for heard in (0, 1):
        own = {x: (heard, (x,)) for x in "iYo"} | {"t": (heard, ("i",)), "b": (0, ("b",)), "R": (1, ("o",))}
        own |= {x: (heard, ("r" if heard else x,)) for x in "IT"} | {"S": (heard, ("o" if heard else "S",))}
        arcs.append(own)
    return Transducer(arcs)


def _clauses() -> Transducer:
    """What each clause holds, at its end."""
    states = list(itertools.product(range(3), *[range(2)] * 5))
    number, arcs = {x: n for n, x in enumerate(states)}, []
    for state in states:
        insults, threat, target, negated, reported, slur = state
        at = "_at_target" if target else ""
        said = [("", "insult", "insults")[insults] + at] if insults else []
        said += ["threat" + at] * threat + ["negated"] * negated + ["reported"] * reported + ["slur"] * slur
        to = lambda k, x=1: (number[(*state[:k], x, *state[k + 1 :])], ())  # noqa: E731, B023
        arcs.append({"I": to(0, min(insults + 1, 2)), "T": to(1), "Y": to(2), "i": to(3), "r": to(4), "S": to(5), "o": (number[state], ()), "b": (0, tuple(said))})
    return Transducer(arcs)


class Grammar:
    """insults and slurs: words, and beginnings of words with an asterisk behind them."""

    _WORDS = re.compile(r"[\w']+|[.!?;:\n|]")

    def __init__(self, insults: frozenset[str] = frozenset(), slurs: frozenset[str] = frozenset()) -> None:
        learned = dict.fromkeys(slurs, "S") | dict.fromkeys(insults, "I")
        self.symbol = {w: s for w, s in learned.items() if not w.endswith("*")}
        self.symbol |= {w: s for s, words in (("R", REPORTS), ("Y", TARGETS), ("N", NEGATIONS), ("T", THREATS), ("I", INSULTS)) for w in words}
        self.starts = frozenset(w for w, s in self.symbol.items() if s in "IST")
        self.symbol |= dict.fromkeys(".!?;:\n|", "b")
        self.machine = _negation().compose(_reported()).compose(_clauses())
        stems = {w[:-1]: s for w, s in learned.items() if w.endswith("*")}
        #: Beginnings by their length, the longest first, and what cuts a word to it.
        self.stems = [(n, {x: s for x, s in stems.items() if len(x) == n}, operator.itemgetter(slice(n))) for n in sorted({len(x) for x in stems}, reverse=True)]

    def _symbol(self, word: str) -> str:
        found = self.symbol.get(word)
        if found is None:
            found = next((stems[word[:n]] for n, stems, _ in self.stems if word[:n] in stems), "o")
        return found

    def clauses(self, text: str) -> list[int]:
        """Number of matched clauses of each kind, and of all clauses."""
        found = dict.fromkeys(KINDS, 0)
        words = self._WORDS.findall(text.lower())
        # without an insult, slur or threat no clause matches
        if not self.starts.isdisjoint(words) or any(not stems.keys().isdisjoint(map(cut, words)) for _, stems, cut in self.stems):
            for kind in self.machine.run([*map(self._symbol, words), "b"]):
                found[kind] += 1
        ends = [self.symbol.get(w) == "b" for w in words]
        return [*found.values(), sum(a and not b for a, b in zip([*ends, True], [True, *ends]))]


def clauses(docs: DataFrame, insults: frozenset[str] = frozenset(), slurs: frozenset[str] = frozenset()) -> DataFrame:
    """doc_id, the number of matched clauses of each kind, and that of all clauses."""
    names = [*KINDS, "clauses"]

    def matched(batches: Iterator) -> Iterator:
        import pyarrow as pa

        grammar = Grammar(insults, slurs)
        for b in batches:
            rows = [grammar.clauses(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names)))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(matched, ", ".join(["doc_id long", *(f"{k} long" for k in names)]))


_LETTERS = re.compile(r"[^\W\d_]+")


def _parts(word: str) -> list[str]:
    """A word of letters, and its beginnings."""
    least, most = STEM
    return [word, *(word[:n] + "*" for n in range(least, min(len(word), most + 1)))]


def _gathering(sure: dict[str, int], among: dict[str, int]) -> frozenset[str]:
    """Of words and beginnings with their numbers of texts: the beginnings that gather several of `among`, the longest
    of equally good ones, and the words that no such beginning has."""
    longest: dict[str, int] = {}
    for x, n in among.items():
        bare = x.rstrip("*")
        for k in range(STEM[0], len(bare) + (not x.endswith("*"))):
            longest[bare[:k]] = max(longest.get(bare[:k], 0), n)
    kept = {x for x, n in sure.items() if x.endswith("*") and n >= GATHERS * longest.get(x[:-1], 0)}
    covered = lambda x: any(x[:k] + "*" in kept for k in range(STEM[0], len(x)))
    return frozenset(x for x in sure if (x in kept or not x.endswith("*")) and not covered(x.rstrip("*")))


def learn_words(docs: DataFrame, known: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """(insults, slurs): words of toxic texts, and beginnings of such words. known: doc_id, toxic (0 or 1) of
    training rows.

    Two passes over the sampled texts: first documents and places of each label by word or beginning, then, for
    those that pass, the different words before them in toxic texts."""
    none = frozenset(), frozenset()
    n = known.count()
    if not n:
        return none
    part = F.pmod(F.xxhash64("doc_id", F.lit("lexicon")), F.lit(1 << 20)) < min(1 << 20, (LEXICON_ROWS << 20) // n)
    sample = materialize(known.filter(part).select("doc_id", "toxic").distinct(), "lexicon")
    share = sample.agg(F.avg("toxic")).first()[0]
    if not share or share >= 1:
        return none
    # about LEXICON_ROWS rows, whatever the corpus
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")

    def by_word(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["word", "clean", "toxic", "clean_places", "toxic_places"]

        def rows(found: dict):
            w, counts = list(found), list(zip(*found.values())) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], names=names)

        found: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                own: dict[str, int] = {}
                for w, times in Counter(_LETTERS.findall((text or "").lower())).items():
                    for x in _parts(w):
                        own[x] = own.get(x, 0) + times
                    own[""] = own.get("", 0) + times  # all words
                for x, times in own.items():
                    c = found.setdefault(x, [0, 0, 0, 0])
                    c[toxic] += 1
                    c[2 + toxic] += times
                if len(found) > 500_000:
                    yield rows(found)
                    found = {}
        yield rows(found)

    sums = [F.sum(x).alias(x) for x in ("clean", "toxic", "clean_places", "toxic_places")]
    counts = materialize(texts.mapInArrow(by_word, "word string, clean long, toxic long, clean_places long, toxic_places long").groupBy("word").agg(*sums), "words")
    whole = counts.filter("word = ''").first()
    if whole is None:
        return none
    # chance brings a share of toxic texts that much above the mean, or more, with a probability of exp(-far) at most
    of, p = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    far = of * (p * F.log(p / share) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0))
    sure = counts.filter("word <> ''").filter((p > share) & (F.col("toxic") >= NEIGHBOURS)).filter(far >= math.log(SURENESS * counts.count()))
    often = F.col("toxic_places") * whole["clean_places"] >= RATIO * F.col("clean_places") * whole["toxic_places"]
    rows = sure.filter((p >= PRECISION) | often).select("word", "toxic", (p >= PRECISION).alias("insult")).collect()
    among = {r["word"]: r["toxic"] for r in rows}
    insults = _gathering(*[{r["word"]: r["toxic"] for r in rows if r["insult"]}] * 2)
    slurs = _gathering({r["word"]: r["toxic"] for r in rows if not r["insult"]}, among)
    words = insults | slurs
    if not words:
        return none

    def before(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            pairs = set()
            for text in b.column("text").to_pylist():
                own = _LETTERS.findall((text or "").lower())
                for v, w in zip(["", *own], own):
                    pairs.update((x, v) for x in _parts(w) if x in words)
            w, v = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(v, pa.string())], names=["word", "before"])

    near = texts.filter("toxic = 1").mapInArrow(before, "word string, before string").distinct().groupBy("word").count()
    found = {r["word"] for r in near.filter(F.col("count") >= NEIGHBOURS).collect()}
    return insults & found, slurs & found


def fit(histogram: list[tuple[tuple[int, ...], int, int]], strength: float = 0.05, steps: int = 50) -> list[float]:
    """Weights and bias (last) of highest posterior, by Newton's method. histogram: counts, label, documents."""
    import numpy as np

    guess = np.array([*PRIOR, BIAS])
    if not histogram:
        return guess.tolist()
    x = np.array([[*c, 1] for c, _, _ in histogram], float)
    y, n = (np.array([h[k] for h in histogram], float) for k in (1, 2))
    hold = np.full(len(guess), strength)

    def loss(w):
        z = x @ w
        return (n * (np.logaddexp(0, z) - y * z)).sum() + (hold * (w - guess) ** 2).sum() / 2

    w = guess.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (n * (p - y)) + hold * (w - guess)
        move = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.diag(hold), slope)
        part = 1.0
        while part > 1e-4 and loss(w - part * move) > loss(w):
            part /= 2
        w = w - part * move
        if abs(part * move).max() < 1e-9:
            break
    # a clause never speaks for a text being clean
    return [max(v, 0.0) for v in w[:-1]] + [float(w[-1])]


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the clause counts of every document."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)")
    found = materialize(clauses(docs, *learn_words(docs, known.filter(~held_out()))), "clauses").withColumn("held_out", held_out())
    level = lambda c: F.when(c > 0, F.length(F.bin(c))).otherwise(0).cast("int")
    share = F.floor(64 * F.col("slur") / F.greatest("clauses", F.lit(1))).cast("long")
    levels = [*(level(F.col(k)).alias(k) for k in KINDS), level(share).alias("slur_share")]
    names = [*KINDS, "slur_share"]
    rows = found.filter(~F.col("held_out")).join(known, "doc_id").groupBy(*levels, "toxic").count().collect()
    weights = fit(sorted((tuple(r[k] for k in names), r["toxic"], r["count"]) for r in rows))
    total = sum((F.lit(w) * c for w, c in zip(weights, levels)), F.lit(weights[-1]))
    scored = 1 / (1 + F.exp(-total))
    return found.select("doc_id", "held_out", scored.alias("score"), (scored >= THRESHOLD).cast("int").alias("predicted"), *KINDS, "clauses")
