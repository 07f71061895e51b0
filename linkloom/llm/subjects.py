"""Subjects of documents from latent Dirichlet topic models.

Distributed topic models are fitted to what all texts say of each term: the terms that stand near it,
counted over the whole corpus, are the term's own document, so a fit costs the same for any number of
texts. The top terms of each topic are inspected against the labelled examples, which tells how far
the topic is about each subject. The topic proportions of a document are inferred from its sentences
and the fitted models, and with them those of each sentence; a document has the subjects of at least
a quarter of its sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import LDA
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: Topics of a model, models with different seeds, and steps of a fit; each step sees all terms.
TOPICS, MODELS, STEPS = 60, 3, 8
#: Terms so far apart (terms outside the vocabulary don't count) are near each other.
WINDOW = 6
#: What the counts near a term are scaled to, so that a topic needs many terms, not one frequent one.
CONTEXT = 60.0
#: Terms: least and largest share of distinct texts that have them, and how many texts at least.
LEAST_SHARE, MOST_SHARE, LEAST_DOCS = 0.0007, 0.25, 3
#: A word in the examples of so many subjects belongs to none.
COMMON = 4
#: Labelled examples of each subject that are read at most; they are a given sample.
EXAMPLES = 10_000
TOP_TERMS = 40
#: Topics whose top terms are less clear than this are about no subject.
CLEAR = 0.1
#: Share of a document's sentences that a subject needs, and how many subjects a document may have.
QUARTER, MOST_SUBJECTS = 0.25, 2
#: Rounds in which the topic proportions of a document settle, and what each topic has beforehand.
ROUNDS, PRIOR = 12, 0.02
#: Pairs of terms that a task counts before it merges them, and terms of documents that are compared at a time.
HELD, CHUNK = 1 << 21, 1 << 15

#: Words of three letters on; hyphens make one word of several.
_WORD = re.compile(r"[^\W\d_]{3,}(?:-[^\W\d_]+)*|[^\W\d_]+(?:-[^\W\d_]+)+")
_FENCE = re.compile(r"(?s)```.*?(```|$)")
#: A link, with a short remark in brackets after it.
_LINK = re.compile(r"(?:!?\[[^\]\n]*\]\([^)\n]*\)|\S*https?://\S+)(?:[ \t]*\([^()\n]{0,40}\))?")
_MARKUP = re.compile(r"<[^<>]{1,200}>|&[a-z]{2,8};")
#: Lines that look like code: braces, semicolons at the end, prompts, assignments, calls.
_CODE = re.compile(r"(?m)^[ \t]*([{}]|//|#include|#!|\$ |>>> |(def|class|import|from|return|for|while|if|int|let|const|var|public|select|export|function|print)\b.*[;:({})=].*|\S+\s*=\s*\S+.*;|.*[;{}])[ \t]*$")
#: No line is code without one of these.
_MAYBE_CODE = re.compile(r"[;:({})=$]|//|#|>>>")
_SPLIT = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n+")


def sentences(text: str | None) -> list[str]:
    """Sentences without code, links and markup; each has a letter."""
    if not text:
        return []
    if "```" in text:
        text = _FENCE.sub("\n", text)
    if "http" in text or "](" in text:
        text = _LINK.sub(" ", text)
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    if _MAYBE_CODE.search(text):
        text = _CODE.sub(" ", text)
    return [s for s in _SPLIT.split(text) if any(c.isalpha() for c in s)]


def words(text: str | None) -> list[list[str]]:
    """The words of each sentence."""
    return [_WORD.findall(s.lower()) for s in sentences(text)]


#: A document in words: these, the sentence of each, and how many sentences it has.
CUT = "words array<string>, place array<int>, n_sentences int"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_k, _h, _t) with their texts in words."""
    for batch in batches:
        flat, place, ends, n = [], [], [0], []
        for t in batch.column(2).to_pylist():
            cut = words(t)
            for i, ws in enumerate(cut):
                flat += ws
                place += [i] * len(ws)
            ends.append(len(flat))
            n.append(len(cut))
        offsets = pa.array(ends, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.string())), pa.ListArray.from_arrays(offsets, pa.array(place, pa.int32())), pa.array(n, pa.int32())],
            ["_k", "_h", "words", "place", "n_sentences"],
        )


def cut_texts(rows: DataFrame) -> DataFrame:
    """Rows _k, _t as _k, _h (equal for copies of a text), words, place, n_sentences."""
    schema = T.StructType([rows.schema["_k"], *T.StructType.fromDDL(f"_h string, {CUT}").fields])
    return rows.select("_k", F.md5("_t").alias("_h"), "_t").mapInArrow(_cut, schema)


def _ids(batch: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number (-1: unknown), document and sentence in the document of each word of a batch."""
    at = batch.schema.get_field_index
    lists = batch.column(at("words"))
    term = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return term, np.repeat(np.arange(batch.num_rows), n), batch.column(at("place")).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def vocabulary(texts: DataFrame, common: set[str], tied: set[str] = frozenset()) -> list[str]:
    """Terms by how many of the distinct texts have them; `tied` ones stay however frequent they are.

    Bounded by the mean number of terms of a text over LEAST_SHARE, whatever the number of texts.
    """
    n = texts.count()
    least = max(LEAST_DOCS, int(LEAST_SHARE * n))
    most = max(int(MOST_SHARE * n), least)
    counts = texts.select(F.explode(F.array_distinct("words")).alias("t")).groupBy("t").agg(F.count("*").alias("c")).filter(F.col("c") >= least)
    known = texts.sparkSession.createDataFrame([(t, True) for t in sorted(tied)], "t string, tied boolean")
    rows = counts.join(F.broadcast(known), "t", "left").filter((F.col("c") <= most) | F.col("tied")).orderBy(F.desc("c"), "t").collect()
    return [r["t"] for r in rows if r["t"] not in common]


def _near(terms, window: int):
    """code (term * terms + other), cnt: pairs of known terms at most `window` known terms apart in a text, both ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms.value, pa.string())
        size, held, n = len(known), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return code, np.bincount(at, np.concatenate([k for _, k in held])).astype(np.int64)

        for batch in batches:
            term, doc, _ = _ids(batch, known)
            term, doc = term[term >= 0], doc[term >= 0]
            for d in range(1, window + 1):
                same = doc[d:] == doc[:-d]
                a, b = term[:-d][same], term[d:][same]
                code = np.r_[a * size + b, b * size + a]
                held.append((code, np.ones(len(code), np.int64)))
                n += len(code)
            if n >= HELD:
                held = [merged()]
                n = len(held[0][0])
                if n >= HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["code", "cnt"])
                    held, n = [], 0
        if n:
            code, cnt = merged()
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(cnt)], ["code", "cnt"])

    return run


def contexts(texts: DataFrame, terms: list[str], window: int = WINDOW, parts: int = 24) -> DataFrame:
    """features: for each term the counts of the terms near it over all texts, scaled to CONTEXT; a row has at most as many entries as there are terms."""
    size, known = len(terms), texts.sparkSession.sparkContext.broadcast(terms)
    pairs = texts.select("words", "place").mapInArrow(_near(known, window), "code long, cnt long").groupBy("code").agg(F.sum("cnt").alias("cnt"))
    rows = pairs.groupBy((F.col("code") / size).cast("int").alias("term")).agg(F.sort_array(F.collect_list(F.struct((F.col("code") % size).cast("int").alias("at"), F.col("cnt").cast("double").alias("cnt")))).alias("near"))

    @F.udf(VectorUDT())
    def vector(at, cnt):
        total = sum(cnt)
        return Vectors.sparse(size, at, [CONTEXT * c / total for c in cnt])

    # In a fixed order, as the fit draws rows by their place.
    return rows.repartition(parts, "term").sortWithinPartitions("term").select(vector("near.at", "near.cnt").alias("features"))


def _examples(examples: DataFrame) -> tuple[list[str], list[tuple[str, list[str]]], set[str], set[str]]:
    """Subjects, examples with their words, words of too many subjects, and words that tell some subjects from others."""
    some = examples.filter("subject is not null and text is not null").select("subject", "text")
    rows = some.withColumn("_r", F.row_number().over(W.partitionBy("subject").orderBy("text"))).filter(F.col("_r") <= EXAMPLES).collect()
    labelled = [(r["subject"], [w for s in words(r["text"]) for w in s]) for r in rows]
    by_word: dict[str, set[str]] = {}
    for s, ws in labelled:
        for w in ws:
            by_word.setdefault(w, set()).add(s)
    subjects = sorted({s for s, _ in labelled})
    tied = {w for w, s in by_word.items() if len(s) < min(COMMON, len(subjects))}
    return subjects, labelled, {w for w, s in by_word.items() if len(s) >= COMMON}, tied


def inspect_topics(topics: np.ndarray, seen: np.ndarray, top: int = TOP_TERMS) -> np.ndarray:
    """topics x subjects: how far each topic is about each subject, by how its top terms stand in the examples.

    `topics` is terms x topics, `seen` terms x subjects (counts in the examples). Rows of topics that
    are about no subject are 0; the others sum to 1.
    """
    phi = topics / topics.sum(0, keepdims=True)
    share = seen / np.maximum(seen.sum(1, keepdims=True), 1)
    out = np.zeros((topics.shape[1], seen.shape[1]))
    for j in range(topics.shape[1]):
        best = np.argsort(-phi[:, j], kind="stable")[:top]
        out[j] = (phi[best, j][:, None] * share[best]).sum(0)
    out /= np.maximum(out.sum(1, keepdims=True), 1e-12)
    # Clear topics stay clear, mixed ones count for their main subjects.
    sharp = out**2
    return np.where(sharp.max(1, keepdims=True) > CLEAR, out, 0)


@dataclass
class Topics:
    """Fitted models together: their topics stand side by side."""

    subjects: list[str]
    terms: list[str]
    of_term: np.ndarray  # terms x topics: how the uses of a term are shared by the topics
    about: np.ndarray  # topics x subjects: how far a topic is about a subject


def fit(texts: DataFrame, examples: DataFrame, topics: int = TOPICS, models: int = MODELS, steps: int = STEPS) -> Topics:
    """Topic models of texts in words (each text once), with their topics mapped to the subjects of the examples."""
    subjects, labelled, common, tied = _examples(examples)
    terms = vocabulary(texts, common, tied) if subjects else []
    none = Topics(subjects, [], np.zeros((0, 0)), np.zeros((0, len(subjects))))
    if not terms:
        return none
    number = {w: i for i, w in enumerate(terms)}
    seen = np.zeros((len(terms), len(subjects)))
    for s, ws in labelled:
        for w in ws:
            if w in number:
                seen[number[w], subjects.index(s)] += 1
    near = contexts(texts, terms).persist()
    if not near.limit(1).count():
        return none
    found, about = [], []
    for m in range(models):
        lda = LDA(k=topics, maxIter=steps, optimizer="online", subsamplingRate=1.0, learningOffset=1.0, seed=m + 1, docConcentration=[0.05] * topics, topicConcentration=0.02)
        matrix = lda.fit(near).topicsMatrix().toArray()
        found.append(matrix / matrix.sum(0, keepdims=True))
        about.append(inspect_topics(matrix, seen))
    near.unpersist()
    phi = np.concatenate(found, 1)
    return Topics(subjects, terms, phi / np.maximum(phi.sum(1, keepdims=True), 1e-300), np.concatenate(about, 0))


def _summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the stretches of rows that begin at `first`; none is empty."""
    return np.add.reduceat(values, first, axis=0)


def proportions(model: Topics, term: np.ndarray, sentence: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentences with terms, in order: their number, their document, and the proportions of the topics in each.

    `term`, `sentence` and `doc` have a row a term, in order of documents and sentences. A sentence
    draws from the topics of its document, so these settle together: a document's proportions are the
    mean of those of its sentences.
    """
    first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    log = np.log(model.of_term + 0.01).astype(np.float32)
    like = _summed(log[term], first)
    like = np.exp(like - like.max(1, keepdims=True))
    owner = doc[first]
    at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    which = np.cumsum(np.r_[0, owner[1:] != owner[:-1]])
    theta = np.full((len(at), like.shape[1]), 1 / like.shape[1], np.float32)
    for _ in range(rounds):
        own = like * theta[which]
        own /= own.sum(1, keepdims=True)
        theta = _summed(own, at) + np.float32(PRIOR)
        theta /= theta.sum(1, keepdims=True)
    return sentence[first], owner, own


def subject_sentences(model: Topics, term: np.ndarray, doc: np.ndarray, sentence: np.ndarray, docs: int) -> np.ndarray:
    """docs x subjects: how many sentences of each document are about each subject, by their topic proportions."""
    out = np.zeros((docs, len(model.subjects)))
    if not len(term):
        return out
    # Terms that don't tell subjects apart say nothing; a sentence needs some that do.
    clear = (model.of_term @ model.about).max(1)
    use = (term >= 0) & (clear[term] >= 0.25)
    term, doc, sentence = term[use], doc[use], sentence[use]
    # Sentences numbered through all documents.
    own = np.cumsum(np.r_[1, (sentence[1:] != sentence[:-1]) | (doc[1:] != doc[:-1])][: len(term)]) - 1
    strength = np.bincount(own, clear[term]) if len(term) else np.zeros(0)
    use = strength[own] >= 0.5
    term, doc, own = term[use], doc[use], own[use]
    # Documents are taken together until they have so many terms.
    ends = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True]) + 1 if len(doc) else []
    start = 0
    for end in ends:
        if end - start < CHUNK and end < len(doc):
            continue
        _, owner, share = proportions(model, term[start:end], own[start:end], doc[start:end])
        subject = share @ model.about
        best = subject.argmax(1)
        sure = subject.max(1) >= 0.5
        np.add.at(out, (owner[sure], best[sure]), 1)
        start = end
    return out


def _assign(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        terms = pa.array(m.terms, pa.string())
        for batch in batches:
            if not m.terms:
                continue
            term, doc, sentence = _ids(batch, terms)
            n = batch.column(batch.schema.get_field_index("n_sentences")).to_numpy(zero_copy_only=False).astype(np.int64)
            share = subject_sentences(m, term, doc, sentence, batch.num_rows) / np.maximum(n, 1)[:, None]
            # The subjects with the largest shares; of equal ones the first by name.
            order = np.argsort(-share, 1, kind="stable")[:, :MOST_SUBJECTS]
            d, j = np.nonzero(np.take_along_axis(share, order, 1) >= QUARTER)
            s = order[d, j]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(d)), pa.array([m.subjects[i] for i in s], pa.string()), pa.array(share[d, s]), pa.array(n[d], pa.int64())],
                ["_k", "subject", "share", "n_sentences"],
            )

    return run


def subjects_of(df: DataFrame, key: str, text: str, examples: DataFrame, **how: int) -> DataFrame:
    """(key, subject, share, n_sentences): the subjects of at least a quarter of a document's sentences, two at most.

    Copies of a text count once in all that is learned, so that a text of many rows neither makes its
    terms look like stop words nor outweighs the others; each row gets its subjects. Null and empty
    texts, and texts of code and links alone, have no subject. Without examples, or for an empty
    table, there are no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    cut = cut_texts(df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).filter("_t is not null")).persist()
    once = cut.filter("size(words) > 0").groupBy("_h").agg(F.first("words").alias("words"), F.first("place").alias("place")).persist()
    model = fit(once, examples, **how)
    once.unpersist()
    schema = T.StructType([cut.schema["_k"], *T.StructType.fromDDL("subject string, share double, n_sentences long").fields])
    done = cut.mapInArrow(_assign(spark.sparkContext.broadcast(model)), schema)
    return done.select(F.col("_k").alias(key), "subject", "share", "n_sentences")


def held_out_accuracy(df: DataFrame, text: str, examples: pd.DataFrame, **how: int) -> float:
    """Share of examples whose main subject is found by models that saw the labels of the other half of them."""
    right, examples = 0, examples.sample(frac=1, random_state=1)
    once = cut_texts(df.select(F.lit(0).alias("_k"), F.col(text).alias("_t")).filter("_t is not null").distinct())
    for half in (0, 1):
        known, asked = examples.iloc[half::2], examples.iloc[1 - half :: 2]
        model = fit(once, df.sparkSession.createDataFrame(known), **how)
        number = {w: i for i, w in enumerate(model.terms)}
        rows = [(number.get(w, -1), d, i) for d, t in enumerate(asked["text"]) for i, ws in enumerate(words(t)) for w in ws]
        term, doc, sentence = np.array(rows, np.int64).T
        best = subject_sentences(model, term, doc, sentence, len(asked)).argmax(1)
        right += sum(model.subjects[b] == s for b, s in zip(best, asked["subject"], strict=True))
    return right / max(1, len(examples))
