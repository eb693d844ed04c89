"""Subject areas of documents: topics of a latent Dirichlet allocation, mapped to subjects by their top terms."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.session import cut

#: Topics, rounds of their fit, and the weight each word's context has in it, however often the word comes.
TOPICS, ROUNDS, CONTEXT = 128, 30, 1000.0
#: Weight of each topic in a document, and of the words that are on no topic, beside the words on it.
TOPIC_PRIOR, PLAIN_PRIOR = 0.05, 5.0
#: A word needs this share of all documents, and five of them, to be in the vocabulary.
RARE_SHARE, RARE_DOCS = 0.001, 5
#: How many times as often as by chance two words must share documents, and by how many standard deviations more, to be in each other's context.
OFTEN, ABOVE_CHANCE = 1.5, 2.0
#: Terms by which a topic is known, and how far above chance their labels must agree to name it.
TOP_TERMS, NAMED = 25, 0.2
#: Labelled documents that name topics, at most: a bound on what is broadcast, not on what is scored.
LABELLED = 50_000
#: Rounds in which documents' topics are inferred, and words that are inferred together.
INFERENCE_ROUNDS, INFERENCE_WORDS = 5, 4096
#: Words on a subject that a sentence on it has at least, and share of sentences from which a text is on it: a fifth, with room for one sentence missed in thirty.
SENTENCE_WORDS, SENTENCE_SHARE = 0.5, 0.17
SEED = 7
_BLOCK, _CELLS = 2048, 1 << 21

# Letters written alike by people and scanners fold to one.
_FROM, _TO = "áàäâãåéèëêíìïîóòöôõúùüûñçl1|c0", "aaaaaaeeeeiiiiooooouuuuneiiieo"
_FOLD = str.maketrans(_FROM, _TO)
# A short phrase in quotes that a sentence's own words lead to or go on from; whole sentences in quotes are none.
_QUOTED = re.compile(r'(?<=\w\s)"[^".!?\n]{0,60}(?<!,)"|"[^".!?\n]{0,60}(?<!,)"(?=,?\s[a-zäöüßáéíóúñ])')
_ASIDE = re.compile(r"\(([^()]*)\)")
_TOKEN = re.compile(r"[^\W_]+|[.!?]+(?=\s|$)|\n+")
#: Codes of words out of the vocabulary, of numbers, and of the end of a sentence.
_OTHER, _NUMBER, _END = -1, -2, -3


def fold(word: str) -> str:
    return word.replace("rn", "m").translate(_FOLD)


def body(text: str) -> str:
    """The text in lower case without short quoted phrases and bracketed asides; an aside of its own is a sentence without words."""
    if '"' in text:
        text = _QUOTED.sub(" ", text).replace('"', " ")
    if "(" in text:
        text = _ASIDE.sub(lambda m: " xx. " if m[1].rstrip()[-1:] in (".", "!", "?") else " ", text)
    return text.lower()


class Codes(dict):
    """Tokens as written to the codes of their folded words of three letters or more, of ``index`` or, if it is to ``grow``, added to it."""

    def __init__(self, index: dict[str, int], grow: bool = False) -> None:
        super().__init__()
        self.index, self.grow = index, grow

    def __missing__(self, token: str) -> int:
        if token[0] in ".!?\n":
            code = _END
        elif len(token) < 3 or token.isdecimal():
            code = _OTHER if any(c.isalpha() for c in token) else _NUMBER
        else:
            word = fold(token)
            code = self.index.setdefault(word, len(self.index)) if self.grow else self.index.get(word, _OTHER)
        if len(self) > _CELLS:
            self.clear()
        self[token] = code
        return code

    def of(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all texts' tokens, each text with an end after it, and the text that each is in."""
        codes: list[int] = []
        sizes = []
        for t in texts:
            mine = [self[x] for x in _TOKEN.findall(body(t))]
            mine.append(_END)
            codes += mine
            sizes.append(len(mine))
        return np.array(codes, np.int64), np.repeat(np.arange(len(sizes)), sizes)


def _distinct(text: np.ndarray, code: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, word) with their numbers, of the codes that are words."""
    at, n = np.unique(text[code >= 0] * words + code[code >= 0], return_counts=True)
    return at // words, at % words, n


def _texts(documents: DataFrame) -> DataFrame:
    return documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.coalesce(F.lower("lang"), F.lit("")).alias("lang"))


def word_counts(documents: DataFrame) -> DataFrame:
    """``(lang, t, docs, words)``: in how many documents of a language a word is and how often; ``t`` is '' for the documents themselves."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], np.ndarray] = {}

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(*k, *n) for k, n in held.items()], columns=["lang", "t", "docs", "words"])
            held.clear()
            return out

        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                codes = Codes({}, grow=True)
                code, text = codes.of(texts)
                size = max(1, len(codes.index))
                docs, words = np.bincount(_distinct(text, code, size)[1], minlength=size), np.bincount(code[code >= 0], minlength=size)
                for t, n in [("", (len(texts), 0)), *zip(codes.index, zip(docs.tolist(), words.tolist()))]:
                    held[lang, t] = held.get((lang, t), 0) + np.array(n)
            if len(held) > _CELLS:
                yield rows()
        yield rows()

    each = _texts(documents).select("text", "lang").mapInPandas(count, "lang string, t string, docs bigint, words bigint")
    return each.groupBy("lang", "t").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))


class _Cells:
    """Sums by (row, column) in sorted arrays, so that memory follows the cells in use."""

    def __init__(self, columns: int) -> None:
        self.columns, self.at, self.of = columns, np.zeros(0, np.int64), np.zeros(0)

    def add(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> None:
        at = np.concatenate([self.at, rows.astype(np.int64) * self.columns + columns])
        self.at, where = np.unique(at, return_inverse=True)
        self.of = np.bincount(where, np.concatenate([self.of, values]), len(self.at))

    def frame(self, kind: int) -> pd.DataFrame:
        out = pd.DataFrame({"kind": kind, "i": self.at // self.columns, "j": self.at % self.columns, "n": self.of})
        self.at, self.of = self.at[:0], self.of[:0]
        return out


def word_pairs(documents: DataFrame, told: DataFrame, index: dict[str, int], subjects: int) -> DataFrame:
    """``(kind, i, j, n)``: of kind 0 in how many documents words i < j are both, of kind 1 labels of subject j on documents with word i.

    ``told (lid, given)`` has the label weights of each labelled document, one per subject. A task adds up
    its documents before anything is shuffled.
    """
    v = len(index)
    rows = _texts(documents).join(F.broadcast(told), F.col("doc_id") == F.col("lid"), "left").select("text", "given")

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, labels, codes = _Cells(v), _Cells(subjects), Codes(index)
        for b in batches:
            for begin in range(0, len(b), _BLOCK):
                part = b.iloc[begin : begin + _BLOCK]
                code, text = codes.of(part["text"])
                text, word, _ = _distinct(text, code, v)
                has = np.zeros((len(part), v), np.float32)
                has[text, word] = 1
                for low in range(0, v, _BLOCK):
                    both = np.triu(has[:, low : low + _BLOCK].T @ has[:, low:], 1)
                    i, j = np.nonzero(both)
                    pairs.add(i + low, j + low, both[i, j])
                labelled = np.flatnonzero(part["given"].notna().to_numpy())
                if len(labelled):
                    sums = has[labelled].T @ np.stack(part["given"].iloc[labelled].to_numpy())
                    i, j = np.nonzero(sums)
                    labels.add(i, j, sums[i, j])
                if len(pairs.at) > _CELLS:
                    yield pairs.frame(0)
        yield pairs.frame(0)
        yield labels.frame(1)

    return rows.mapInPandas(pair, "kind int, i bigint, j bigint, n double").groupBy("kind", "i", "j").agg(F.sum("n").alias("n"))


def contexts(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``(i, features)``: for each word how much more often than by chance it shares documents with others.

    ``pairs (i, j, n)``, ``words (i, f)``: ``f`` has per language the word's documents over the square root
    of all of them, so that a product of two words' ``f`` is the number of documents they share by chance,
    and languages of any size form no topics of their own. Every context has the same total.
    """
    f = F.broadcast(words)
    both = pairs.join(f.select(F.col("i").alias("a"), F.col("f").alias("fa")), F.col("i") == F.col("a")).join(f.select(F.col("i").alias("b"), F.col("f").alias("fb")), F.col("j") == F.col("b"))
    chance = F.aggregate(F.zip_with("fa", "fb", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    above = both.select("i", "j", F.when(F.col("n") > OFTEN * chance + ABOVE_CHANCE * F.sqrt(chance), F.col("n") - chance).alias("x")).filter("x > 0")
    each = above.unionByName(above.select(F.col("j").alias("i"), F.col("i").alias("j"), "x"))
    size = words.count()

    @F.udf(VectorUDT())
    def vector(cells):
        total = sum(c["x"] for c in cells)
        return Vectors.sparse(size, [(c["j"], c["x"] / total * CONTEXT) for c in cells])

    return each.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("cells")).select("i", vector("cells").alias("features"))


def named_topics(topic_words: np.ndarray, everywhere: np.ndarray, labelled: np.ndarray) -> np.ndarray:
    """The subject of each topic (-1: none), after inspection of the topics' top terms.

    ``topic_words`` are the topics' weights (words x topics, each topic's sum 1), ``everywhere`` the words'
    shares in all texts, ``labelled`` counts of labelled documents (words x subjects), already brought to
    equal sums per subject. A topic's top terms are those it uses most beyond their use everywhere. It is
    on the subject that their labels have in common, if they agree well enough above chance.
    """
    n = labelled.shape[1]
    of_word = (labelled + 0.3) / (labelled + 0.3).sum(1, keepdims=True)
    telling = topic_words * np.maximum(np.log(topic_words / everywhere[:, None]), 0)
    out = np.full(topic_words.shape[1], -1)
    for t in range(len(out)):
        top = np.argsort(-telling[:, t], kind="stable")[:TOP_TERMS]
        if (total := telling[top, t].sum()) > 0:
            share = (telling[top, t] @ of_word[top]) / total
            if share.max() - 1 / n >= NAMED * (1 - 1 / n) or n == 1:
                out[t] = int(share.argmax())
    return out


@dataclass(frozen=True)
class Topics:
    """A fitted topic model whose topics have subjects."""

    index: dict[str, int]
    #: Words x (topics + 1), each column's sum 1; the last column has the words' shares in all texts.
    words: np.ndarray
    #: (Topics + 1) x subjects: 1 where the topic is on the subject.
    subjects: np.ndarray

    def proportions(self, at: np.ndarray, n: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Topic proportions of documents (documents x topics) and of their words (words x topics).

        The documents' distinct words ``at``, each ``n`` times there, lie one document after the other, each from ``begin`` on.
        """
        k = self.words.shape[1]
        of = self.words[at]
        prior = np.full(k, TOPIC_PRIOR, np.float32)
        prior[-1] = PLAIN_PRIOR
        doc = np.repeat(np.arange(len(begin)), np.diff([*begin, len(at)]))
        size = np.add.reduceat(n, begin)[:, None] + prior.sum()
        share = np.full((len(begin), k), 0.5 / (k - 1) if k > 1 else 0.5, np.float32)
        share[:, -1] = 0.5
        for _ in range(INFERENCE_ROUNDS):
            weight = n / np.einsum("wk,wk->w", of, share[doc])
            share = ((share * np.add.reduceat(of * weight[:, None], begin, axis=0) + prior) / size).astype(np.float32)
        each = of * share[doc]
        return share, each / each.sum(1, keepdims=True)


def sentence_shares(texts: Sequence[str], model: Topics, codes: Codes | None = None) -> list[dict[int, float]]:
    """For each text the share of its sentences on each subject; a sentence is on one subject or none.

    The topic proportions of the texts are inferred from all their words; with them those of each word
    in its text, and a sentence is on the subject whose topics have most of its words.
    """
    out: list[dict[int, float]] = [{} for _ in texts]
    v = len(model.index)
    code, text = (codes or Codes(model.index)).of(texts)
    place = np.cumsum(code == _END) - (code == _END)  # the sentence of each token
    of_text = text[code == _END]
    sizes = np.bincount(of_text[np.unique(place[(code >= 0) | (code == _OTHER)])], minlength=len(out))
    place, word, _ = _distinct(place, code, v)  # a word counts once a sentence
    if not len(word):
        return out
    at, back, n = np.unique(of_text[place] * v + word, return_inverse=True, return_counts=True)
    owner = at // v
    begin = np.flatnonzero(np.diff(owner, prepend=-1))
    weights = np.zeros((len(at), model.subjects.shape[1]), np.float32)
    low = 0
    while low < len(begin):  # some texts at a time, so that memory doesn't follow the batch
        high = max(low + 1, int(np.searchsorted(begin, begin[low] + INFERENCE_WORDS, side="right")) - 1)
        first, last = begin[low], begin[high] if high < len(begin) else len(at)
        _, each = model.proportions(at[first:last] % v, n[first:last].astype(np.float32), begin[low:high] - first)
        weights[first:last] = each @ model.subjects
        low = high
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    score = np.add.reduceat(weights[back], starts, axis=0)
    told = score.max(1) >= SENTENCE_WORDS
    subjects = score.shape[1]
    pairs, times = np.unique(of_text[place[starts]][told] * subjects + score.argmax(1)[told], return_counts=True)
    for d, s, x in zip((pairs // subjects).tolist(), (pairs % subjects).tolist(), times.tolist()):
        out[d][s] = x / sizes[d]
    return out


def fitted_topics(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> tuple[list[str], Topics | None]:
    """The subjects, and the topics fitted to the documents; None without subjects or topics.

    The documents of the allocation are the vocabulary's words, each with its context in all texts
    (``contexts``): a word network. So the fit has as many rows as the vocabulary, whatever the number
    of texts, and each text has its part in it. Words are counted in one pass over the texts, pairs of words
    in a second. What reaches the driver is bounded by the vocabulary: a word needs ``RARE_SHARE`` of the
    documents, so there are at most (mean words a document) / ``RARE_SHARE`` of them; beside it there is a
    number for each word and language mark.
    """
    described: dict[str, str] = {}
    for r in areas.filter("subject IS NOT NULL").select("subject", "description").distinct().orderBy("subject", "description").toLocalIterator():
        described[r["subject"]] = f"{described.get(r['subject'], r['subject'])} {r['description'] or ''}"
    subjects = sorted(described)
    at = {s: i for i, s in enumerate(subjects)}
    counts = cut(word_counts(documents))
    sizes = {r["lang"]: r["docs"] for r in counts.filter("t = ''").collect()}
    least = max(RARE_DOCS, RARE_SHARE * sum(sizes.values()))
    kept = counts.filter("t != ''").groupBy("t").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"), F.collect_list(F.struct("lang", "docs")).alias("langs")).filter(F.col("docs") >= least).orderBy("t").collect()
    if not kept or not subjects:
        return subjects, None
    index, marks = {r["t"]: i for i, r in enumerate(kept)}, {k: i for i, k in enumerate(sorted(sizes))}
    by_lang = np.zeros((len(kept), len(marks)))
    for i, r in enumerate(kept):
        for x in r["langs"]:
            by_lang[i, marks[x["lang"]]] = x["docs"] / sizes[x["lang"]] ** 0.5
    spark = documents.sparkSession
    words = spark.createDataFrame([(i, f) for i, f in enumerate(by_lang.tolist())], "i bigint, f array<double>")

    given = labels.filter("doc_id IS NOT NULL").join(F.broadcast(spark.createDataFrame([(s, i) for s, i in at.items()], "known string, s int")), F.col("subject") == F.col("known")).groupBy("doc_id", "s").agg(F.count("*").alias("c"))
    shares = given.groupBy(F.col("doc_id").alias("lid")).agg(F.sum("c").alias("all"), F.map_from_entries(F.collect_list(F.struct("s", "c"))).alias("c"))
    told = shares.select("lid", F.transform(F.lit(list(range(len(subjects)))), lambda s: F.coalesce(F.try_element_at("c", s), F.lit(0)) / F.col("all")).alias("given")).orderBy(F.xxhash64("lid"), "lid").limit(LABELLED)
    cells = cut(word_pairs(documents, told, index, len(subjects)))

    data = cut(contexts(cells.filter("kind = 0").select("i", "j", "n"), words))
    if data.isEmpty():
        return subjects, None
    fit = LDA(k=TOPICS, maxIter=ROUNDS, optimizer="em", docConcentration=[1.01], topicConcentration=1.001, seed=SEED).fit(data.select("features"))
    weights = np.asarray(fit.topicsMatrix().toArray()) + 1e-3 / len(index)
    topic_words = weights / weights.sum(0)
    everywhere = np.array([r["words"] for r in kept], float)
    everywhere /= everywhere.sum()

    labelled, total = np.zeros((len(index), len(subjects))), np.array(told.agg(*[F.sum(F.col("given")[i]).alias(f"_{i}") for i in range(len(subjects))]).first(), dtype=float)
    for r in cells.filter("kind = 1").collect():
        labelled[r["i"], r["j"]] = r["n"]
    total = np.nan_to_num(total)
    for s, text in described.items():  # each description counts as one labelled document
        total[at[s]] += 1
        code, text = Codes(index).of([text])
        labelled[_distinct(text, code, len(index))[1], at[s]] += 1
    names = named_topics(topic_words, everywhere, labelled / total * total.mean())
    on = np.zeros((TOPICS + 1, len(subjects)), np.float32)
    on[np.flatnonzero(names >= 0), names[names >= 0]] = 1
    return subjects, Topics(index, np.hstack([topic_words, everywhere[:, None]]).astype(np.float32), on)


def subject_shares(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """``(doc_id, subject, share)``: each subject of each document with its share of the sentences.

    Subjects come from the topics inferred for each document (``sentence_shares``); labels only name the
    topics. Shares are counted over sentences rather than tokens. Every document is scored over its whole
    text. Documents with a null id or text, and subjects without a sentence, give no row; the same id twice
    gives each row's own subjects. Without labels, topics are named by the subjects' descriptions alone.
    """
    subjects, topics = fitted_topics(documents, labels, areas)
    if topics is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, subject string, share double")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes(topics.index)
        for b in batches:
            rows = []
            for begin in range(0, len(b), _BLOCK):
                part = b.iloc[begin : begin + _BLOCK]
                rows += [(d, subjects[s], x) for d, shares in zip(part["doc_id"], sentence_shares(part["text"], topics, codes)) for s, x in shares.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "share"])

    return _texts(documents).select("doc_id", "text").mapInPandas(score, "doc_id bigint, subject string, share double")


def subjects_of(documents: DataFrame, labels: DataFrame, areas: DataFrame, least: float = SENTENCE_SHARE) -> DataFrame:
    """``(doc_id, subject)`` where a share of ``least`` or more of the sentences is on the subject."""
    return subject_shares(documents, labels, areas).filter(F.col("share") >= least).select("doc_id", "subject").distinct()


def composition(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """Per subject the documents on it and their part of all documents with a text; documents may have several."""
    total = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").agg(F.countDistinct("doc_id")).first()[0]
    return subjects_of(documents, labels, areas).groupBy("subject").agg(F.count("*").alias("documents")).select("subject", "documents", (F.col("documents") / F.lit(max(1, total))).alias("part"))
