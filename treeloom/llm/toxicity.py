"""Toxicity by a weighted finite-state pattern grammar.

A weighted trie reads a word and gives its symbol (insult, threat, intent, target, negation, report, other)
with a weight. Five small transducers read the symbols of a clause: negation marks insults and threats in its
scope, target marks insults aimed at somebody, threat joins a violent verb to whom it names, insult lets
only matches through, and reported speech marks what stands behind a verb of saying. They are composed
into one deterministic machine; the best path through a clause (lexical weight and weight of the kind of match) is
the clause's match. A document's score is logistic in the weights of its clauses by kind of match, so a
word scores by the clause it stands in and not by itself.

Learned are, from labelled rows that are not held out: word stems beyond the fixed lists, as weights on the trie
(boosting over stems, on two thirds of the sample), and the weights of the kinds (from the last third, drawn towards fixed
ones, which also hold where nothing can be learned). The fit reads about ``sample`` documents a label at most, by a hash
of doc_id, equal texts once.

Cases: a null text counts as empty; a text without any match, such as an empty one, has the score of the bias; texts of any
length are read whole; a null doc_id counts as not held out and never teaches; null labels teach nothing and
contradicting ones both ways; no labels: the fixed lists and weights; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import Workspace
from treeloom.llm.language_id import held_out

#: Documents of a label that are fitted on, about; candidate stems at most.
SAMPLE, STEMS = 3000, 4000
#: A stem needs as many toxic documents, as much evidence (log-likelihood ratio), and to explain as many that others leave.
LEAST, EVIDENCE, UNEXPLAINED = 6, 16.0, 5
#: Lengths of stems; a whole word is a stem too.
SHORTEST, LONGEST = 3, 8
#: Words that a negation reaches, that a target stands before or behind an insult, that stand between verb and target.
NEGATES, BEFORE, BEHIND, BETWEEN = 3, 5, 2, 3
THRESHOLD = 0.7

# Words by symbol, lower case.
INSULT_WORDS = """
arsehole asshole bastard bitch clown coward cretin crook degenerate dimwit disgrace disgusting dumbass dummy
fool freak fuckwit garbage gutless halfwit hypocrite idiot idiotic idiots imbecile loser losers lowlife maggot
moron moronic morons nitwit parasite pathetic pig retard scum scumbag shithead sleazy slut stupid swine traitor
trash twat useless vermin weakling whore worthless wretch
arschloch blödmann depp dummkopf trottel vollidiot abruti connard crétin imbécile salaud cabrón estúpido gilipollas imbécil
""".split()
THREAT_WORDS = "attack beat bomb break burn butcher choke crush cut destroy drown execute gut hang harm hunt hurt kill lynch maim murder punch rape shoot slap slaughter smash stab strangle torture".split()
INTENT_WORDS = "gonna going ll must shall should want wanna will would".split()
TARGET_WORDS = "anyone everyone he her him his people she their them these they those u ur you your yours yourself du ihr dich euch tu toi vous usted ustedes".split()
NEGATION_WORDS = "no not never neither nor nobody none cannot cant dont doesnt didnt isnt arent wasnt werent wont wouldnt without hardly kein keine nicht nie pas jamais aucun nunca jamás".split()
REPORT_WORDS = "according alleged allegedly called claimed claims quote quoted replied reported reportedly said says shouted stated tells told tweeted wrote writes sagte schrieb dit écrit dijo escribió".split()

SYMBOLS = {w: s for s, words in (("R", REPORT_WORDS), ("T", TARGET_WORDS), ("M", INTENT_WORDS), ("V", THREAT_WORDS), ("I", INSULT_WORDS), ("N", NEGATION_WORDS)) for w in words}
#: Weight of a word of the fixed lists.
FIXED = 2.5

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;\n]+")


# --- transducers ---------------------------------------------------------------------------


class Transducer:
    """A deterministic transducer over symbols: ``arcs[state][symbol]`` is (next state, symbol given out); state 0 starts a clause."""

    def __init__(self, arcs: list[dict[str, tuple[int, str]]]):
        self.arcs = arcs

    @classmethod
    def of(cls, symbols: list[str], start, step) -> "Transducer":
        """The machine of ``step(state, symbol) -> (state, out)`` over all states that can be reached."""
        at, order, arcs = {start: 0}, [start], []
        for state in order:
            row = {}
            for x in symbols:
                then, out = step(state, x)
                if then not in at:
                    at[then] = len(order)
                    order.append(then)
                row[x] = at[then], out
            arcs.append(row)
        return cls(arcs)

    def outputs(self) -> list[str]:
        return sorted({out for row in self.arcs for _, out in row.values()})

    def then(self, other: "Transducer") -> "Transducer":
        """The composition: what this one gives out, the other reads."""

        def step(state, x):
            mine, out = self.arcs[state[0]][x]
            theirs, out = other.arcs[state[1]][out]
            return (mine, theirs), out

        return Transducer.of(list(self.arcs[0]), (0, 0), step)

    def run(self, symbols: list[str]) -> list[str]:
        state, out = 0, []
        for x in symbols:
            state, y = self.arcs[state][x]
            out.append(y)
        return out


def _negation() -> Transducer:
    """Insults and threats in reach of a negation become ``I!`` and ``V!``."""

    def step(left, x):
        if x == "N":
            return NEGATES, "O"
        return max(0, left - 1), x + "!" if left and x in "IV" else x

    return Transducer.of(list("OIVMTNR"), 0, step)


def _target() -> Transducer:
    """Insults with a target before or behind them are aimed: ``Ia``, ``Ia!``; one behind gives ``Ta`` or ``Ta!``, which also stays a target."""

    def step(state, x):
        seen, insult, mark = state
        seen, insult = max(0, seen - 1), max(0, insult - 1)
        if x[0] == "T":
            return (BEFORE, 0, ""), "Ta" + mark if insult else "T"
        if x[0] == "I":
            return (seen, 0, "") if seen else (0, BEHIND + 1, x[1:]), "Ia" + x[1:] if seen else x
        return (seen, insult, mark if insult else ""), x

    return Transducer.of(["O", "I", "I!", "V", "V!", "M", "T", "R"], (0, 0, ""), step)


def _threat() -> Transducer:
    """A threat verb that names a target within reach becomes ``H`` there, with intent before it ``Hm``."""

    def step(state, x):
        intent, verb, kind = state
        intent, verb = max(0, intent - 1), max(0, verb - 1)
        if x == "M":
            return (BETWEEN + 1, verb, kind if verb else ""), "O"
        if x[0] == "V":
            return (0, BETWEEN + 1, ("m" if intent else "") + x[1:]), "O"
        if x[0] == "T" and verb:
            return (intent, 0, ""), "H" + kind
        return (intent, verb, kind if verb else ""), "O" if x == "T" else x

    return Transducer.of(_target().outputs(), (0, 0, ""), step)


def _insult() -> Transducer:
    """Only matches go on; an insult aimed by a target behind it is ``Ia``."""
    names = {"Ta": "Ia", "Ta!": "Ia!"}
    return Transducer.of(_threat().outputs(), 0, lambda s, x: (s, names.get(x, x)))


def _report() -> Transducer:
    """Matches behind a verb of saying are reported: marked ``r``."""

    def step(said, x):
        if x == "R":
            return 1, "O"
        return said, "r" + x if said and x != "O" else x

    return Transducer.of(_insult().outputs(), 0, step)


def grammar() -> Transducer:
    return _negation().then(_target()).then(_threat()).then(_insult()).then(_report())


KINDS = [f"{r}{k}{n}" for r in ("", "r") for k in ("I", "Ia", "H", "Hm") for n in ("", "!")]
#: Fixed weights of the kinds in a document's score: an insult, an aimed one, a threat, one with intent; less for negated and reported ones.
PRIOR = np.array([{"I": 2.5, "Ia": 3.2, "H": 3.0, "Hm": 3.6}[k.strip("r!")] * (0.1 if "!" in k else 1) * (0.35 if k[0] == "r" else 1) for k in KINDS])
BIAS, SPREAD = -3.0, 1.5
#: What the kind adds to the lexical weight on a clause's path.
ON_PATH = {k: (0.5 if "a" in k else 0.0) + (1.0 if "H" in k else 0.0) - (2.0 if "!" in k else 0.0) - (1.0 if k[0] == "r" else 0.0) for k in KINDS}


# --- lexicon and scores -------------------------------------------------------------------


def stems(word: str) -> list[str]:
    """Proper beginnings of a word (marked by ``+``), shortest first, and the whole word (marked by ``$``)."""
    return [word[:n] + "+" for n in range(SHORTEST, min(LONGEST, len(word) - 1) + 1)] + [word + "$"]


class Model:
    """Learned stems with weights on the trie, and weights of the kinds."""

    MEMO = 100_000

    def __init__(self, learned: dict[str, float], weights: np.ndarray, bias: float):
        self.learned, self.weights, self.bias = learned, np.asarray(weights), float(bias)

    def __getstate__(self):
        return self.learned, self.weights, self.bias

    def __setstate__(self, state):
        self.learned, self.weights, self.bias = state
        self.memo: dict[str, tuple[str, float]] = {}
        self.arcs = grammar().arcs

    def symbol(self, word: str) -> tuple[str, float]:
        """Symbol and weight: along the word's path through the trie the weights of stems add up."""
        out = self.memo.get(word)
        if out is None:
            plain = word.replace("’", "'")
            fixed = SYMBOLS.get(plain) or SYMBOLS.get(plain.replace("'", "")) or ("N" if plain.endswith("n't") else SYMBOLS.get(plain.rpartition("'")[2] if plain.endswith("'ll") else "", "O"))
            weight = sum(self.learned.get(s, 0.0) for s in stems(word)) if self.learned else 0.0
            if fixed == "O" and weight > 0:
                fixed = "I"
            out = fixed, max(weight, FIXED) if fixed in ("I", "V") and word in SYMBOLS else weight
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            self.memo[word] = out
        return out

    def features(self, text: str | None) -> np.ndarray:
        """For each kind the lexical weights of the clauses whose best path is of it, as log2(1 + sum)."""
        sums = dict.fromkeys(KINDS, 0.0)
        text = (text or "").lower()
        if any(self.symbol(w)[0] in ("I", "V") for w in set(_WORD.findall(text))):
            for clause in _CLAUSE.split(text):
                best, state, weight = None, 0, 0.0
                for word in _WORD.findall(clause):
                    x, own = self.symbol(word)
                    state, out = self.arcs[state][x]
                    if x in ("I", "V"):
                        weight = own
                    if out != "O":
                        path = weight + ON_PATH[out]
                        if best is None or path > best[0]:
                            best = path, out, weight
                if best:
                    sums[best[1]] += best[2]
        return np.log2(1 + np.array(list(sums.values())))

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.features(text) @ self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _ready(model: Model) -> Model:
    model.__setstate__(model.__getstate__())
    return model


# --- learning ------------------------------------------------------------------------------


def boosted(present: np.ndarray, toxic: np.ndarray, least: int = UNEXPLAINED) -> dict[int, float]:
    """Weights of columns of ``present`` (documents x stems): each round takes the stem that explains most of what is left."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return {}
    x, out, eps = present.astype(np.float64), {}, 0.5 / (n1 + n0)
    w = np.where(toxic, 0.5 / n1, 0.5 / n0)
    for _ in range(x.shape[1]):
        up, down = (w * toxic) @ x, (w * ~toxic) @ x
        gain = np.sqrt(up) - np.sqrt(down)
        j = int(np.argmax(gain))
        if gain[j] < math.sqrt(least * 0.5 / n1):
            break
        a = 0.5 * math.log((up[j] + eps) / (down[j] + eps))
        out[j] = out.get(j, 0.0) + a
        w = w * np.exp(np.where(toxic, -a, a) * x[:, j])
    return out


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, bias: float, spread: float, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps, drawn towards the prior; classes count as one half each."""
    m = np.hstack([x, np.ones((len(x), 1))])
    mean = w = np.append(prior, bias)
    share = np.where(y, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (~y).sum())))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        grad = m.T @ (share * (p - y)) + (w - mean) / spread**2
        step = np.linalg.solve(m.T @ (m * (share * p * (1 - p) + 1e-9)[:, None]) + np.eye(len(w)) / spread**2, grad)
        step *= min(1.0, 2.0 / max(float(np.abs(step).max()), 1e-300))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return np.maximum(w[:-1], 0.0), float(w[-1])  # a match never speaks for a text


def _count_stems(batches):
    counts: tuple[Counter, Counter] = Counter(), Counter()

    def out():
        names = sorted(set(counts[0]) | set(counts[1]))
        for at in range(0, len(names), 20_000):
            part = names[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([counts[1][s] for s in part]), pa.array([counts[0][s] for s in part])], names=["stem", "t", "c"])
        counts[0].clear()
        counts[1].clear()

    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"].to_pylist()):
            words = set(_WORD.findall(text.as_py().lower()))
            counts[toxic].update({s for w in words for s in stems(w)})
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield from out()
    yield from out()


def _find_stems(names: list[str]):
    at = {s: i for i, s in enumerate(names)}

    def run(batches):
        for batch in batches:
            found = [np.unique(np.array([at[s] for w in set(_WORD.findall(t.as_py().lower())) for s in stems(w) if s in at], "<i4")).tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(found, pa.binary())], names=["toxic", "found"])

    return run


def _features(model: Model):
    def run(batches):
        ready = _ready(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array([ready.features(t.as_py()).tobytes() for t in batch["text"]], pa.binary())], names=["toxic", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = STEMS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic) that may be learned from.

    The driver gets the stems with evidence (``most`` at most), and of the sample's documents which stems they hold, and their features.
    """
    ws = Workspace(docs.sparkSession, "toxicity")
    marks = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    n = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n:
        return _ready(Model({}, PRIOR, BIAS))
    share = F.when(F.col("toxic") == 1, min(1.0, sample / n.get(1, 1))).otherwise(min(1.0, sample / n.get(0, 1)))
    marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)) / float(1 << 30) < share)
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(marks), "doc_id")  # marks: about 2 * sample rows
    rows = rows.groupBy(F.sha2(F.col("text"), 256).alias("key"), "toxic").agg(F.first("text").alias("text"))
    rows = ws.save(rows.select("text", "toxic", (F.pmod(F.xxhash64("key", F.lit(7)), F.lit(3)) > 0).alias("first")), "sample")
    one, two = rows.where("first"), rows.where("NOT first")
    sizes = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    learned: dict[str, float] = {}
    if n1 and n0:
        counted = one.select("text", "toxic").mapInArrow(_count_stems, "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        part = lambda k, of, n: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) * float(n1 + n0) / (float(n) * (F.col("t") + F.col("c"))))).otherwise(0.0)
        counted = counted.where((F.col("t") >= LEAST) & (F.col("t") * float(n0) > 2 * F.col("c") * float(n1)))
        counted = counted.withColumn("evidence", 2 * (part("t", "c", n1) + part("c", "t", n0))).where(F.col("evidence") >= EVIDENCE)
        # of stems that stand in the same documents the longest comes first
        best = counted.orderBy(F.desc("evidence"), F.desc(F.length("stem")), "stem").limit(most).collect()
        names = [r["stem"] for r in best]
        if names:
            found = one.select("text", "toxic").mapInArrow(_find_stems(names), "toxic int, found binary").collect()
            present = np.zeros((len(found), len(names)), bool)
            for i, r in enumerate(found):
                present[i, np.frombuffer(r["found"], "<i4")] = True
            learned = {names[j]: a for j, a in boosted(present, np.array([r["toxic"] == 1 for r in found])).items()}
    known = two.select("text", "toxic").mapInArrow(_features(Model(learned, PRIOR, BIAS)), "toxic int, x binary").collect()
    y = np.array([r["toxic"] == 1 for r in known], bool)
    if not y.any() or y.all():
        return _ready(Model(learned, PRIOR, BIAS))
    weights, bias = logistic(np.stack([np.frombuffer(r["x"], np.float64) for r in known]), y, PRIOR, BIAS, SPREAD)
    # classes counted as halves; as they are in the labels
    return _ready(Model(learned, weights, bias + math.log(n.get(1, 1) / n.get(0, 1))))


def _scores(shared):
    def run(batches):
        model = _ready(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array([model.score(t.as_py()) for t in batch["text"]], pa.float64())], names=["row", "score"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with score and predicted; columns of these names are replaced."""
    Workspace(docs.sparkSession, "toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most STEMS stems
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(_scores(shared), rows.select("row").schema.add("score", "double"))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in keep), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs.where(~held_out()), labels.where(~held_out()))
    # only the doc_id travels with a text
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
