"""Toxicity by a weighted finite-state grammar over clauses.

A text is cut into clauses at sentence marks and line ends. Each word gets a class: insult, threat, target, negation,
reporting or other. Five transducers are composed into one machine over classes: insult (after an insult a threat counts more),
threat (one alone counts half, and after one an insult counts more), target (an insult or threat with a target before it in the
clause counts more), negation (an insult or threat within three words after a negation is softened) and reported speech (after
a reporting word, to the end of the clause, it is quoted). The machine's weight for a clause is the largest along its path;
words are never scored outside a clause.

The lexicon has fixed English words and what labelled rows teach: words, and prefixes of words of 3 to 64 characters, that
toxic rows have far more often (a word takes the strongest of its prefixes). Terms of other languages for targets, negation and
reporting are taken up where labelled rows show it: where insults and threats that stand behind them are more, or less, often in
toxic rows than others. Only rows whose crc32(doc_id) mod 4 is not 2 teach, at most `sample_rows` of them.

Null or empty text: the score of a text without matches. Null or unlabelled ids: scored like others. Labels other than 0 and 1
teach nothing. Repeated rows: scored alike. Rows labelled more than once count once per label row. No documents or no labels: an
empty result, or the fixed lexicon alone. Texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_crc, rows_of, texts, written

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)

# The lexicon's own words by class.
INSULTS = "idiot moron stupid loser scum trash clown worthless pathetic disgusting imbecile filth vermin fool jerk pig dumb ugly coward freak"
THREATS = "kill hurt destroy beat crush strangle stab shoot murder"
TARGETS = "you your you're youre u he she they them him her his their these those"
NEGATIONS = "not never no isn't aren't wasn't don't doesn't nobody without hardly"
REPORTS = "said says quoted quote wrote called reported claims claimed according allegedly"

# Terms of German, French and Spanish that labels may show to be targets, negations or reporting words.
ELSEWHERE = {
    TARGET: "du dich dir dein deine ihr euch euer sie tu toi te ton ta tes vous vos votre tú ti tu tus usted ustedes vosotros él ella ellos",
    NEGATION: "nicht kein keine keinen nie niemals ohne ne pas jamais aucun aucune sans no nunca jamás ningún ninguna sin",
    REPORT: "sagte sagt schrieb nannte laut angeblich dit disait selon appelé prétend dijo dice escribió llamó según",
}
#: Characters of a prefix, at least and at most; words of any length teach as wholes.
STEM, LONGEST = 3, 64

_CLAUSE = re.compile(r"[.!?;\n]+")
_ELSEWHERE = {kind: frozenset(terms.split()) for kind, terms in ELSEWHERE.items()}
_EDGE = "\"'`,:()[]{}*%&$#|<>-_"
_FIXED_WEIGHT = 4.0


def lexicon() -> dict[str, tuple[int, float]]:
    found = {}
    for kind, words, weight in ((TARGET, TARGETS, 0.0), (NEGATION, NEGATIONS, 0.0), (REPORT, REPORTS, 0.0), (THREAT, THREATS, 1.5), (INSULT, INSULTS, _FIXED_WEIGHT)):
        found |= {w: (kind, weight) for w in words.split()}
    return found


class Transducer:
    """A deterministic weighted transducer: step(state, symbol) -> (state, output symbol, factor)."""

    def __init__(self, states: int, symbols: int, step):
        self.states, self.symbols = states, symbols
        self.table = {(s, a): step(s, a) for s in range(states) for a in range(symbols)}

    def compose(self, other: "Transducer") -> "Transducer":
        """This one's outputs are the other's inputs; factors multiply."""

        def step(state: int, symbol: int):
            a, b = divmod(state, other.states)
            a, out, f = self.table[a, symbol]
            b, out, g = other.table[b, out]
            return a * other.states + b, out, f * g

        return Transducer(self.states * other.states, self.symbols, step)


def machines() -> list[Transducer]:
    """The five machines; classes pass through each, and the factor of a step multiplies the weight of its word."""
    hit = (INSULT, THREAT)

    def after(kind: int, factors: dict, before: dict | None = None) -> Transducer:
        """Once `kind` has been seen, words of a class take its factor of `factors`, until then that of `before`."""
        return Transducer(2, 6, lambda s, a: (1 if a == kind else s, a, (factors if s else before or {}).get(a, 1.0)))

    insult = after(INSULT, {THREAT: 1.5})
    threat = after(THREAT, {INSULT: 1.25, THREAT: 0.5}, {THREAT: 0.5})
    target = after(TARGET, {INSULT: 1.25, THREAT: 6.0})
    report = after(REPORT, dict.fromkeys(hit, 0.6))
    negation = Transducer(4, 6, lambda s, a: (3, a, 1.0) if a == NEGATION else (max(0, s - 1), a, 0.4 if s and a in hit else 1.0))
    return [insult, threat, target, negation, report]


def grammar() -> Transducer:
    """The composition of the machines."""
    whole, *rest = machines()
    for other in rest:
        whole = whole.compose(other)
    return whole


class Scorer:
    """Matches of a text: the largest clause weight, the sum of the clause weights, and that sum for each 100 words."""

    def __init__(self, words: dict[str, tuple[int, float]], stems: dict[str, float], limit: int = 100_000):
        self.words, self.stems, self.table = words, stems, grammar().table
        scorer, firsts = self, {x[:STEM] for x in stems}

        class Classes(dict):
            def __missing__(self, word):
                if len(self) >= limit:
                    self.clear()
                key = word.strip(_EDGE)
                found = scorer.words.get(key)
                if not found and key[:STEM] in firsts:
                    odds = max((scorer.stems[key[:i]] for i in range(STEM, min(len(key), LONGEST) + 1) if key[:i] in scorer.stems), default=0.0)
                    found = (INSULT, odds) if odds else None
                if len(word) <= LONGEST:
                    self[word] = found
                return found

        self.classes = Classes()

    def beside(self, text: str) -> set[tuple[int, str]]:
        """(kind, term) of the terms of other languages with an insult or threat behind them in the clause, a negation within three
        words, and (OTHER, "") if there is an insult or threat at all."""
        out = set()
        for clause in _CLAUSE.split(text.lower()):
            own = clause.split()
            hits = [i for i, w in enumerate(own) if (x := self.classes[w]) and x[1]]
            if hits:
                out.add((OTHER, ""))
                keys = [w.strip(_EDGE) for w in own[: hits[-1]]]
                for kind, terms in _ELSEWHERE.items():
                    out.update((kind, k) for i, k in enumerate(keys) if k in terms and (kind != NEGATION or any(i < h <= i + 3 for h in hits)))
        return out

    def __call__(self, text: str) -> tuple[float, float, float]:
        best, total, n = 0.0, 0.0, 20
        for clause in _CLAUSE.split(text.lower()):
            found = list(map(self.classes.__getitem__, clause.split()))
            n += len(found)
            if not any(x and x[1] for x in found):
                continue
            state, most = 0, 0.0
            for x in found:
                kind, weight = x or (OTHER, 0.0)
                state, _, factor = self.table[state, kind]
                most = max(most, weight * factor)
            best, total = max(best, most), total + most
        return best, total, 100 * total / n


def _shown(row: tuple[str, int, int], toxic: int, clean: int, m: int) -> float | None:
    """Log odds of a word that shows toxic rows, or None. The bar allows for the `m` words that were tried."""
    _, t, c = row
    share = toxic / (toxic + clean)
    n = t + c
    if t / n <= share:
        return None
    p = t / n
    g = 2 * (t * math.log(p / share) + (c * math.log((1 - p) / (1 - share)) if c else 0.0))
    odds = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
    return odds if g > 2 * math.log(m / 0.2) and odds > 3.0 else None


def _beside(found: dict, words: dict) -> dict:
    """The terms of other languages that labels show, of counts (toxic, clean) of the rows where an insult or threat stands behind
    them; the counts of all rows with one stand under (OTHER, "")."""
    toxic, clean = found.get((OTHER, ""), (0, 0))
    out = {}
    if not toxic or not clean:
        return out
    share = toxic / (toxic + clean)
    for (kind, word), (t, c) in found.items():
        if kind == OTHER or word in words:
            continue
        p = t / (t + c)
        g = 2 * ((t * math.log(p / share) if t else 0.0) + (c * math.log((1 - p) / (1 - share)) if c else 0.0))
        odds = math.log((t + 0.5) / (c + 0.5)) - math.log(toxic / clean)
        if g > 2 * math.log(len(found) / 0.05) and (odds > 1.5 if kind == TARGET else odds < -1.5):
            out[word] = (kind, 0.0)
    return out


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> dict:
    """The learned words and stems and the logistic map, from at most `sample_rows` labelled rows by a hash of their ids;
    equal texts count once.

    The sample is written once. Words and prefixes of its toxic rows that two of them have are tried: their counts are added up on
    the executors, first in toxic rows, then theirs alone in clean ones. What is tried comes to the driver, bounded by the sample.
    """
    marks = labels.where(F.col("toxic").cast("int").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    teach = marks.where(F.pmod(id_crc(F.col("doc_id")), F.lit(4)) != 2).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)
    rows = written(texts(docs).join(F.broadcast(teach), "doc_id").dropDuplicates(["text", "toxic"]).select("text", "toxic"), "taught")
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}

    def counts(toxic: int, wanted=None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()

            def out():
                return pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

            for batch in batches:
                for text, _ in rows_of(batch):
                    own = {w.strip(_EDGE) for w in _CLAUSE.sub(" ", text.lower()).split()} - {""}
                    own |= {f"{w[:i]}\x00" for w in own for i in range(STEM, min(len(w), LONGEST) + 1)}
                    seen.update(own if wanted is None else own & wanted.value)
                if len(seen) > 500_000:
                    yield out()
                    seen = Counter()
            if seen:
                yield out()

        return rows.where(F.col("toxic") == toxic).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))

    words, stems = lexicon(), {}
    if len(size) == 2:
        tried = {r["word"]: r["n"] for r in counts(1).where("n > 1").collect()}
        clean = {r["word"]: r["n"] for r in counts(0, docs.sparkSession.sparkContext.broadcast(frozenset(tried))).collect()}
        for word, t in sorted(tried.items()):
            odds = _shown((word, t, clean.get(word, 0)), size[1], size[0], len(tried))
            if odds is None:
                continue
            if word.endswith("\x00"):
                stems[word[:-1]] = odds
            elif word not in words or words[word][0] == INSULT:
                words[word] = (INSULT, odds)

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, seen = Scorer(words, stems), (Counter(), Counter())
        for batch in batches:
            for text, toxic in rows_of(batch):
                seen[toxic].update(score.beside(text))
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.record_batch([pa.array([k for k, _ in keys], pa.int32()), pa.array([w for _, w in keys], pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["kind", "word", "t", "c"])

    found = rows.mapInArrow(beside, "kind int, word string, t long, c long").groupBy("kind", "word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()
    words |= _beside({(r["kind"], r["word"]): (r["t"], r["c"]) for r in found}, words)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(words, stems)
        for batch in batches:
            out = [(*score(text), toxic) for text, toxic in rows_of(batch)]
            if out:
                yield pa.record_batch([pa.array(c, pa.float64()) for c in zip(*out)], names=["best", "total", "rate", "toxic"])

    grid = rows.mapInArrow(features, "best double, total double, rate double, toxic double").collect()
    discard(rows)
    return {"words": words, "stems": stems, "map": _fit([tuple(r) for r in grid])}


def _inputs(best: float, total: float, rate: float) -> tuple[float, ...]:
    return 1.0, best, math.log1p(total), math.log1p(rate)


def _fit(rows: list[tuple[float, ...]]) -> tuple[float, ...]:
    """Logistic regression on the inputs of matches, by Newton's steps with a weak pull to a prior map."""
    import numpy as np

    prior = np.array([-4.0, 1.0, 0.3, 0.0])
    w = prior.copy()
    if rows:
        x, y = np.array([_inputs(*r[:3]) for r in rows]), np.array([r[3] for r in rows])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(prior))
            step = np.linalg.solve(h, x.T @ (p - y) + 0.5 * (w - prior))
            w = w - step / max(1.0, float(np.abs(step).max()))
    return tuple(float(v) for v in w)


def probability(match: tuple[float, float, float], weights: tuple[float, ...]) -> float:
    z = sum(w * x for w, x in zip(weights, _inputs(*match)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """`docs` without the documents scored at `threshold` or more; no shuffle."""
    model, at = learn(docs, labels, **params), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Scorer(model["words"], model["stems"])
        for batch in batches:
            yield batch.filter(pa.array([probability(match(t or ""), model["map"]) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def score(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of each document; no shuffle. The model is bounded by its parameters and sent with the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Scorer(model["words"], model["stems"])
        for batch in batches:
            out = []
            for doc_id, text in rows_of(batch):
                p = probability(match(text), model["map"])
                out.append((doc_id, p, int(p >= threshold)))
            if out:
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.int32()))], names=["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, score and predicted of each document, by a grammar learned from the labelled rows."""
    scored = score(docs, learn(docs, labels, **params))
    return scored.select("doc_id", (F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 2).alias("held_out"), "score", "predicted")
