"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters are noisy yes-or-nothing tests of a text: fixed lexicons of insults in four
languages, text patterns, and lexicons of words and word beginnings mined from
two halves of a bounded labelled sample. The label model is a class-conditional tree of
voters (each voter depends on the class and on the voter it is most informative about),
fitted by EM to the counts of all vote patterns of all documents; rows with a training
label have their class given. It yields each voter's accuracy, the voters' correlations and a
posterior for every pattern. A sparse logistic classifier over words and word
beginnings is then trained on the posteriors of the sample and scores every whole text.

At most 2 ** VOTERS patterns reach the driver. Bounds of the sample: ``EACH`` rows a class
(see :mod:`labels`). Labels of the held-out fold are used nowhere.

Defined cases: a null or empty text has no votes and no features, its score is that of
the intercept; texts of any length are scored whole; repeated rows get the same score; without
labels the label model starts from the fixed voters; an empty table gives an empty
result; columns other than id and text are ignored (``keep`` passes all on unchanged).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .batches import pieces, two_columns
from .labels import fold, sample

#: Training rows of each class, at most; most features of the classifier.
EACH, FEATURES = 1000, 3000
THRESHOLD = 0.3
#: Word beginnings of these lengths are features beside the whole word (0).
LENGTHS = (0, 4, 5, 6, 7)

# The voters' word lists.
INSULTS = {
    "en": "idiot idiots moron morons stupid scum loser losers trash pathetic worthless disgusting clown dumb imbecile jerk bastard filthy vermin retard scumbag dumbass asshole bitch whore slut",
    "de": "idiot idioten dummkopf trottel arschloch abschaum versager widerlich dreckig wertlos schlampe hurensohn depp vollidiot missgeburt",
    "fr": "idiote crétin imbécile connard connasse salaud salope abruti débile raclure ordure minable pathétique dégoûtant merdeux",
    "es": "idiota imbécil estúpido estúpida basura escoria inútil patético asqueroso payaso perdedor cabrón puta pendejo gilipollas",
}
# Patterns over whole texts.
PATTERNS = {
    "threat": rb"(?i)\b(?:i will|i'll|gonna|going to) (?:kill|hurt|destroy|beat)\b",
    "address": rb"(?i)\byou(?:'re| are)? (?:a |an |such a |so )?(?:idiot|moron|stupid|loser|scum|trash|worthless|pathetic|disgusting|clown)",
    "shouting": rb"[A-Z]{4,}[ ]?!{2,}",
}
WORD = re.compile(r"[^\W\d_]+")
VOTERS = len(INSULTS) + len(PATTERNS) + 2 * len(LENGTHS)


def words_of(text: bytes) -> list[str]:
    return WORD.findall(text.decode("utf-8", "replace").lower())


def features_of(word: str) -> list[str]:
    """The whole word, and its beginnings marked by a star."""
    return [word] + [word[:n] + "*" for n in LENGTHS if 0 < n <= len(word)]


def graded(counts: Counter) -> set[str]:
    """Each counted feature, and once more with a plus if it occurs twice or more."""
    return {*counts, *(f + "+" for f, n in counts.items() if n > 1)}


def document_features(text: bytes) -> set[str]:
    counts: Counter = Counter()
    for w, n in Counter(words_of(text)).items():
        for f in features_of(w):
            counts[f] += n
    return graded(counts)


@dataclass
class Sample:
    """Features of the training texts as sorted 64-bit hashes; names are looked up for the few that are chosen."""

    texts: list[bytes]
    hashes: list[np.ndarray]

    @classmethod
    def of(cls, texts: list[bytes]) -> Sample:
        digest = xxhash.xxh64_intdigest
        return cls(texts, [np.unique(np.fromiter(map(digest, document_features(x)), np.uint64)) for x in texts])

    def counts(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, texts with each, sum of their ``weights``)."""
        every = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)
        features, at = np.unique(every, return_inverse=True)
        of = np.repeat(weights, [len(h) for h in self.hashes])
        return features, np.bincount(at, minlength=len(features)), np.bincount(at, weights=of, minlength=len(features))

    def names(self, chosen: np.ndarray) -> dict[int, str]:
        wanted = set(chosen.tolist())
        out: dict[int, str] = {}
        for x, h in zip(self.texts, self.hashes):
            if len(out) < len(wanted) and np.isin(h, chosen).any():
                out.update((k, f) for f in document_features(x) if (k := xxhash.xxh64_intdigest(f)) in wanted)
        return out


def mine(some: Sample, labels: list[int], least: int = 4, precision: float = 0.9) -> list[set[str]]:
    """Per length, the features of at least ``least`` toxic texts that are toxic's with that (smoothed) precision."""
    features, n, bad = some.counts(np.array(labels, np.float64))
    kept = some.names(features[(bad >= least) & ((bad + 0.1) / (n + 0.2) >= precision)]).values()
    return [{f for f in kept if (len(f.rstrip("+")) - 1 if "*" in f else 0) == k} for k in LENGTHS]


@dataclass
class Voters:
    """Votes as bit masks; ``of`` maps a word feature to the bits of the lexicons that hold it."""

    of: dict[str, int]

    @classmethod
    def build(cls, found: Sample, labels: list[int]) -> Voters:
        lexicons = [set(words.split()) for words in INSULTS.values()]
        for half in (0, 1):
            lexicons += mine(Sample(found.texts[half::2], found.hashes[half::2]), labels[half::2])
        of: dict[str, int] = {}
        for bit, lexicon in enumerate(lexicons):
            for f in lexicon:
                of[f] = of.get(f, 0) | 1 << bit
        return cls(of)

    def votes(self, texts: list[bytes]) -> np.ndarray:
        hits = _hits(texts, self.of)
        patterns = [re.compile(p) for p in PATTERNS.values()]
        first = VOTERS - len(patterns)
        out = np.zeros(len(texts), np.int64)
        for i, x in enumerate(texts):
            mask = 0
            for f in hits.get(i, ()):
                mask |= self.of[f]
            for k, p in enumerate(patterns):
                if p.search(x):
                    mask |= 1 << first + k
            out[i] = mask
        return out


def _hits(texts: list[bytes], known: dict) -> dict[int, set[str]]:
    """The known features of each text that has any; every distinct word is looked up once."""
    split = [words_of(x) for x in texts]
    encoded = pa.array([w for words in split for w in words], pa.string()).dictionary_encode()
    found = [[f for f in features_of(w) if f in known or f + "+" in known] for w in encoded.dictionary.to_pylist()]
    ids = encoded.indices.to_numpy()
    at = np.flatnonzero(np.fromiter(map(bool, found), bool, len(found))[ids]) if len(ids) else ids
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
    out: dict[int, Counter] = {}
    for i, w in zip(np.searchsorted(ends, at, side="right").tolist(), ids[at].tolist()):
        out.setdefault(i, Counter()).update(found[w])
    return {i: graded(counts) & known.keys() for i, counts in out.items()}


@dataclass
class LabelModel:
    """Posterior of each vote pattern, and what was learned of the voters."""

    posterior: dict[int, float]
    accuracy: np.ndarray
    correlation: np.ndarray


def fit_label_model(masks: np.ndarray, unlabelled: np.ndarray, clean: np.ndarray, toxic: np.ndarray, rounds: int = 15) -> LabelModel:
    """EM over pattern counts. The tree is the one of greatest mutual information given the class."""
    v = (masks[:, None] >> np.arange(VOTERS) & 1).astype(np.float64)
    k = np.arange(VOTERS)
    if toxic.sum() and clean.sum():
        p = (toxic + 0.1) / (toxic + clean + 0.2) * (toxic + clean > 0) + (toxic + clean == 0) * (v.sum(1) > 0) * 0.8
    else:
        p = np.where(v.sum(1) > 0, 0.8, 0.02)
    order, parent = k, np.full(VOTERS, -1)
    for step in range(rounds):
        # class weights of every pattern: given where labelled, expected elsewhere
        weight = [clean + unlabelled * (1 - p), toxic + unlabelled * p]
        joint = np.zeros((2, 2, 2, VOTERS, VOTERS))
        for y in (0, 1):
            for a in (0, 1):
                for b in (0, 1):
                    joint[y, a, b] = (weight[y][:, None] * (v == a)).T @ (v == b)
        n = np.array([w.sum() for w in weight])
        if step < 4:
            q = (joint + 0.25) / (n + 1)[:, None, None, None, None]
            one = q.sum(2, keepdims=True), q.sum(1, keepdims=True)
            information = (q * np.log(q / (one[0] * one[1]))).sum((1, 2))
            gain = (information * (n / n.sum())[:, None, None]).sum(0)
            order, parent = [0], np.full(VOTERS, -1)
            while len(order) < VOTERS:  # grow the tree by its strongest edge
                rest = [j for j in k if j not in order]
                i, j = max(((i, j) for i in order for j in rest), key=lambda e: gain[e])
                parent[j] = i
                order.append(j)
        odds = np.full(len(masks), np.log((n[1] + 1) / (n[0] + 1)))
        for j in k:
            i = parent[j]
            for a in (0, 1):  # the vote of its parent
                for b in (0, 1):
                    at = (v[:, j] == b) & ((v[:, i] == a) if i >= 0 else a == 0)
                    like = []
                    for y in (0, 1):
                        top, all_ = (joint[y, a, b, i, j], joint[y, a, :, i, j].sum()) if i >= 0 else (joint[y, b, b, j, j], n[y])
                        # a vote is rarer than none: the prior leans to abstaining
                        like.append((top + (0.02 if b else 0.98)) / (all_ + 1))
                    odds[at] += np.log(like[1] / like[0])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    total = unlabelled + clean + toxic
    right = np.array([(total * np.where(v[:, j] == 1, p, 1 - p)).sum() / max(1, total.sum()) for j in k])
    centred = v - (v * total[:, None]).sum(0) / max(1, total.sum())
    cov = (centred * total[:, None]).T @ centred
    spread = np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
    return LabelModel(dict(zip(masks.tolist(), p.tolist())), right, np.divide(cov, spread, out=np.zeros_like(cov), where=spread > 0))


def pattern_counts(docs: DataFrame, labels: DataFrame, voters: Voters, target: str, folds: int, held: int) -> DataFrame:
    """(mask, label, n): vote patterns of all documents by training label (null for all others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(voters.votes(texts))], ["doc_id", "mask"])

    rows = two_columns(docs, "doc_id", "text")
    votes = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, mask bigint")
    known = labels.where(F.col(target).isin(0, 1) & ~fold(F.col("doc_id"), folds, held)).groupBy("doc_id").agg(F.max(target).alias("label"))
    return votes.join(known, "doc_id", "left").groupBy("mask", "label").agg(F.count("*").alias("n"))


@dataclass
class Classifier:
    weights: dict[str, float]
    intercept: float
    model: LabelModel

    def score(self, texts: list[bytes]) -> np.ndarray:
        odds = np.full(len(texts), self.intercept)
        for i, fs in _hits(texts, self.weights).items():
            odds[i] += sum(self.weights[f] for f in sorted(fs))
        return 1 / (1 + np.exp(-odds))


def train_linear(found: Sample, soft: np.ndarray, penalty: float = 1e-3, rounds: int = 300) -> tuple[dict[str, float], float]:
    """Logistic regression on soft labels with an absolute-value penalty, by accelerated proximal steps.

    Features are those that lean to the toxic side most, by log odds of their soft counts.
    """
    features, n_texts, up = found.counts(soft)
    base = soft.sum() / max(1, len(soft))
    lean = n_texts * np.log((up + 0.1) / (n_texts + 0.2) / max(base, 1e-6)) * ((n_texts >= 3) & (up > 1.5 * base * n_texts))
    # the most leaning ones, equal ones by their hash
    chosen = np.sort(features[np.lexsort((features, -lean))[:min(FEATURES, int((lean > 0).sum()))]])
    x = np.zeros((len(found.hashes), len(chosen) + 1), np.float32)
    x[:, -1] = 1
    for r, h in enumerate(found.hashes):
        x[r, :-1] = np.isin(chosen, h)
    n = max(1, len(found.hashes))
    # Lipschitz bound of the gradient by a few power steps
    u = np.ones(x.shape[1], np.float32)
    for _ in range(10):
        u = x.T @ (x @ u)
        u /= max(np.linalg.norm(u), 1e-9)
    rate = 4 * n / max(float(np.linalg.norm(x @ u) ** 2), 1e-6)
    w = z = np.zeros(x.shape[1], np.float32)
    t = 1.0
    for _ in range(rounds):
        g = x.T @ (1 / (1 + np.exp(-(x @ z))) - soft.astype(np.float32)) / n
        new = z - rate * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = (new + (t - 1) / t_new * (new - w)).astype(np.float32)
        w, t = new, t_new
    used = np.flatnonzero(w[:-1])
    names = found.names(chosen[used])
    return {names[k]: float(v) for k, v in zip(chosen[used].tolist(), w[used])}, float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", folds: int = 4, held: int = 2, each: int = EACH, gold: float = 0.95) -> Classifier:
    """``gold`` is the reliability that a training label has as one more voter of its own row."""
    texts, y, _ = sample(docs, labels, target, folds, held, each)
    found = Sample.of(texts)
    voters = Voters.build(found, y)
    counts = pattern_counts(docs, labels, voters, target, folds, held).toPandas()
    masks = np.unique(counts["mask"].to_numpy(np.int64)) if len(counts) else np.zeros(1, np.int64)
    of = [np.zeros(len(masks)) for _ in range(3)]
    for m, label, n in counts.itertuples(index=False):
        of[2 if label != label or label is None else int(label)][np.searchsorted(masks, m)] += n
    model = fit_label_model(masks, of[2], of[0], of[1])
    if not texts:
        return Classifier({}, -2.0, model)
    prior = np.clip([model.posterior.get(int(m), 0.5) for m in voters.votes(texts)], 1e-6, 1 - 1e-6)
    odds = prior / (1 - prior) * np.where(np.array(y) == 1, gold / (1 - gold), (1 - gold) / gold)
    weights, intercept = train_linear(found, odds / (1 + odds))
    return Classifier(weights, intercept, model)


def score(docs: DataFrame, model: Classifier, folds: int = 4, held: int = 2, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scorer = Classifier(model.weights, model.intercept, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, "text"):
            p = scorer.score(texts)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = two_columns(docs, id_col, text_col).withColumn("held_out", fold(F.col("doc_id"), folds, held))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below ``threshold``."""
    scorer = Classifier(model.weights, model.intercept, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, text_col):
            yield rows.filter(pa.array(scorer.score(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
