"""Problem 10: subject areas of documents by term weighting, truncated SVD and centroids refined from seeds."""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphoquarry.session import Cut
from morphoquarry.sources.tables import table

#: A term belongs to the vocabulary if at least this share of the documents (and LEAST_DOCS of them) hold it. With d
#: distinct terms in the mean document it has at most 5 000 · d terms, however large the corpus is.
TERM_SHARE, LEAST_DOCS = 2e-4, 3
#: Languages with a statistic of their own hold at least this share of the documents; the others share one.
LANGUAGE_SHARE = 0.005
#: Dimensions of the embedding, and of the random start of its subspace.
RANK, EXTRA = 96, 16
ROUNDS = 3
#: A subject counts for a document from this share of its sentences on.
SHARE = 0.25
#: Lift shares at which a term begins to count and counts fully, standard deviations for full trust, and the least weight that makes a sentence speak of a subject.
LIFT_LOW, LIFT_FULL, TRUST, SPEAKS = 0.2, 0.5, 3.0, 0.3
#: A sentence must be at least so near its centroid, as a share of the mean nearness of the subject's own terms.
COSINE = 0.5
#: Rows of the partial sums that are added at a time, and documents that are computed at a time.
BLOCK, CHUNK = 256, 1000

_INLINE = re.compile(r"</?(?:a|abbr|b|code|em|font|i|mark|s|small|span|strong|sub|sup|tt|u)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[^<>]*>")
_MARKS = re.compile(r"^\s*(?:(?:[>|*+#•\-–—]+|\d{1,4}[.):]|\[\d{1,2}:\d{2}(?::\d{2})?\](?:\s*\w+:)?)\s*)+")
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"(?:(?!\n)[\W\d_])+")
#: ASCII letters in lower case and line ends; all else parts terms.
_LOWER = bytes(c if c == 10 or chr(c).isalpha() and c < 128 else 32 for c in bytes(range(256)).lower())


def _spoken(text: str | None) -> str:
    """One sentence a line, without markup; headings and lines that only announce others are none, wrapped lines are joined."""
    if not text:
        return ""
    if "&" in text or not text.isascii():
        text = unicodedata.normalize("NFKC", html.unescape(text))
    if "<" in text:
        text = _TAG.sub("\n", _INLINE.sub("", text))
    out: list[str] = []
    open_ = False  # whether the last line goes on
    for line in text.replace("\t", " ").split("\n"):
        bare = line.strip()
        if bare and not bare[0].isalpha():
            bare = "" if bare[0] == "#" else _MARKS.sub("", bare).strip()
        if not bare or bare[-1] == ":":
            open_ = False
            continue
        if open_:
            out[-1] += " " + bare
        else:
            out.append(bare)
        open_ = bare[-1] not in ".!?"
    return "\n".join(out).replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n")


def sentences(text: str | None) -> list[str]:
    return [s.strip() for s in _spoken(text).split("\n") if _LETTER.search(s)]


def words(text: str | None) -> str:
    """The terms of a text, parted by spaces, one sentence a line; some lines may be blank."""
    spoken = _spoken(text)
    if spoken.isascii():
        return spoken.encode().translate(_LOWER).decode()
    return _OTHER.sub(" ", spoken.casefold())


def language(code: str | None) -> str:
    return (code or "").strip().casefold()[:2]


def _worded(batches):
    """Documents as the terms of their sentences, one sentence a line: what the counts and the encoding read."""
    for pdf in batches:
        yield pd.DataFrame({"id": pdf["id"], "lang": [language(x) for x in pdf["lang"]], "words": [words(t) for t in pdf["text"]], "subjects": pdf["subjects"]})


def _count_terms(batches):
    """Per batch: documents by language and term; the term '' counts documents."""
    for pdf in batches:
        counts: dict[str, Counter] = {}
        for lang, held in zip(pdf["lang"], pdf["words"]):
            count = counts.setdefault(lang, Counter())
            count[""] += 1
            count.update(set(held.split()))
        rows = [(lang, t, n) for lang, count in counts.items() for t, n in count.items()]
        yield pd.DataFrame(rows, columns=["lang", "term", "n"])


def _encoder(shared):
    """Documents as term numbers, with −1 after each sentence, and their distinct terms."""

    def run(batches):
        number, languages = shared.value
        known, unknown = {".": -1, **number}.get, itertools.repeat(-2)
        for pdf in batches:
            streams = [list(map(known, (held.replace("\n", " . ") + " .").split(), unknown)) for held in pdf["words"]]
            doc = np.repeat(np.arange(len(streams)), [len(x) for x in streams])
            flat = np.fromiter(itertools.chain.from_iterable(streams), np.int32, len(doc))
            # an end counts if a term stands before it in its document, be it in the vocabulary or not
            keep = (flat != -1) | (np.append(-1, flat[:-1]) != -1) & (np.append(-1, doc[:-1]) == doc)
            keep &= flat != -2
            both = np.sort(doc[flat >= 0] << 32 | flat[flat >= 0])
            both = both[np.diff(both, prepend=-1) != 0]
            ids, terms = _parted(doc[keep], flat[keep], len(pdf)), _parted(both >> 32, (both & 0xFFFFFFFF).astype(np.int32), len(pdf))
            yield pd.DataFrame({"id": pdf["id"], "lang": [languages.get(x, 0) for x in pdf["lang"]], "ids": ids, "terms": terms, "subjects": pdf["subjects"]})

    return run


def _parted(doc: np.ndarray, numbers: np.ndarray, docs: int) -> list[bytes]:
    """Each document's numbers as bytes; documents ascend."""
    at, raw = np.searchsorted(doc, np.arange(docs + 1)) * 4, numbers.tobytes()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:])]


def _flat(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, number) of documents' numbers."""
    return np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw]), np.frombuffer(b"".join(raw), np.int32)


def _chunks(column: pd.Series):
    held = column.tolist()
    for at in range(0, len(held), CHUNK):
        yield at, held[at : at + CHUNK]


def _rows(terms: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents' distinct terms: (document, term, weight); the weights of a document have length 1."""
    doc, term = _flat(terms)
    w = weights[term]
    known = w > 0
    doc, term, w = doc[known], term[known], w[known]
    norm = np.sqrt(np.bincount(doc, w * w, minlength=len(terms)))
    return doc, term, (w / np.maximum(norm[doc], 1e-12)).astype(np.float32)


def _grouped_sum(table: np.ndarray, rows: np.ndarray, keys: np.ndarray, size: int, scale: np.ndarray | None = None) -> np.ndarray:
    """Sums of the table's named rows (times ``scale``) by key; keys ascend. The k-th rows of all keys are added at once."""
    out = np.zeros((size, table.shape[1]), np.float32)
    if len(keys):
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        counts = np.diff(np.append(starts, len(keys)))
        order = np.argsort(-counts, kind="stable")
        starts, counts = starts[order], counts[order]
        total = np.zeros((len(starts), table.shape[1]), np.float32)
        for k in range(counts[0]):
            at = starts[: np.searchsorted(-counts, -k, "left")] + k
            total[: len(at)] += table[rows[at]] if scale is None else table[rows[at]] * scale[at, None]
        out[keys[starts]] = total
    return out


def _project(shared):
    """Partial Aᵀ(A·Q) of the partition's documents, in blocks of terms; A has unit rows of weighted terms."""

    def run(batches):
        weights, q = shared.value
        total = np.zeros(q.shape, np.float32)
        for pdf in batches:
            for _, part in _chunks(pdf["terms"]):
                doc, term, w = _rows(part, weights)
                if len(doc):
                    y = _grouped_sum(q, term, doc, len(part), w)
                    found, at = np.unique(term, return_inverse=True)
                    order = np.argsort(at, kind="stable")
                    total[found] += _grouped_sum(y, doc[order], at[order], len(found), w[order])
        for b in range(0, len(total), BLOCK):
            part = total[b : b + BLOCK]
            if part.any():
                yield pd.DataFrame({"block": [b // BLOCK], "data": [part.tobytes()]})

    return run


def _add_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(pdf["data"].iloc[0], np.float32).copy()
    for data in pdf["data"].iloc[1:]:
        total += np.frombuffer(data, np.float32)
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "data": [total.tobytes()]})


def _members(ids: list[bytes], model: dict, subjects: int) -> np.ndarray:
    """Documents × subjects: whether at least SHARE of the sentences are about the subject."""
    doc, stream = _flat(ids)
    end = stream < 0
    sentence = np.cumsum(end) - end
    of = doc[end]
    known = ~end
    known[known] = model["trust"][stream[known]] > 0
    s, t = sentence[known], stream[known]
    vec = _grouped_sum(model["vector"], t, s, len(of))
    trust = np.zeros(len(of), np.float32)
    if len(s):
        starts = np.flatnonzero(np.diff(s, prepend=-1))
        trust[s[starts]] = np.maximum.reduceat(model["trust"][t], starts)
    norm = np.linalg.norm(vec, axis=1)
    cosine = vec @ model["centroid"].T
    best = cosine.argmax(1)
    told = (cosine[np.arange(len(of)), best] >= model["least"][best] * np.maximum(norm, 1e-12)) & (trust >= SPEAKS)
    count = np.bincount(of[told] * subjects + model["subject"][best[told]], minlength=len(ids) * subjects).reshape(len(ids), subjects)
    return (count > 0) & (count >= SHARE * np.bincount(of, minlength=len(ids))[:, None])


def _evidence(shared, subjects: int):
    """Documents that belong to a subject, by (term, subject, language); the term −1 counts documents. Members are those labelled, or found by the model."""

    def run(batches):
        model = shared.value
        for pdf in batches:
            if model is None:
                member = np.zeros((len(pdf), subjects), bool)
                for d, given in enumerate(pdf["subjects"]):
                    member[d, np.asarray(given, int)] = True
            else:
                member = np.vstack([np.zeros((0, subjects), bool), *[_members(part, model, subjects) for _, part in _chunks(pdf["ids"])]])
            doc, term = _flat(pdf["terms"].tolist())
            doc, term = np.concatenate([doc, np.arange(len(pdf))]), np.concatenate([term.astype(np.int64), np.full(len(pdf), -1)])
            keys = (term + 1) << 32 | pdf["lang"].to_numpy(np.int64)[doc]
            for k in range(subjects):
                found, n = np.unique(keys[member[doc, k]], return_counts=True)
                yield pd.DataFrame({"term": (found >> 32) - 1, "subject": k, "lang": found & 0xFFFFFFFF, "n": n})

    return run


def _term_trust(seen: np.ndarray, expected: np.ndarray, alpha: float) -> np.ndarray:
    """Trust by term: how far its documents' subjects depart from what its languages would give by chance."""
    lift = (seen + alpha) / (expected + alpha)
    share = lift / lift.sum(1, keepdims=True)
    best, row = lift.argmax(1), np.arange(len(lift))
    sure = (seen[row, best] - expected[row, best]) / np.sqrt(expected[row, best] + 0.5)
    return (np.clip((share[row, best] - LIFT_LOW) / (LIFT_FULL - LIFT_LOW), 0, 1) * np.clip(sure / TRUST, 0, 1)).astype(np.float32)


def _orthonormal(y: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, by their Gram matrix; directions without length are left out."""
    gram = np.zeros((y.shape[1], y.shape[1]))
    for at in range(0, len(y), 10_000):
        part = y[at : at + 10_000].astype(float)
        gram += part.T @ part
    value, vector = np.linalg.eigh(gram)
    some = value > 1e-9 * max(value[-1], 1e-30)
    return (y @ (vector[:, some] / np.sqrt(value[some])).astype(np.float32)).astype(np.float32)


def _embedding(encoded: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Leading right singular vectors (terms × at most RANK) of the documents' weighted unit rows: a random subspace, iterated over all documents."""
    spark = encoded.sparkSession
    rank = min(RANK + EXTRA, int((weights > 0).sum()))
    q = _orthonormal(np.random.default_rng(3).standard_normal((len(weights), rank), np.float32) * (weights[:, None] > 0))
    for step in range(2):
        sent = spark.sparkContext.broadcast((weights, q))
        added = encoded.select("terms").mapInPandas(_project(sent), "block int, data binary").groupBy("block").applyInPandas(_add_blocks, "block int, data binary").toPandas()
        y = np.zeros(q.shape, np.float32)
        for b, data in zip(added["block"], added["data"]):
            part = np.frombuffer(data, np.float32).reshape(-1, q.shape[1])
            y[b * BLOCK : b * BLOCK + len(part)] = part
        sent.unpersist()
        if step == 0:
            q = _orthonormal(y)
    small = q.T @ y
    return (q @ np.linalg.eigh((small + small.T) / 2)[1][:, ::-1][:, :RANK].astype(np.float32)).astype(np.float32)


def subject_areas(documents: DataFrame, id_col: str, text_col: str, lang_col: str, labels: DataFrame, label_id: str, label_subject: str, subjects: list[str]) -> DataFrame:
    """(id, subject): subjects of at least a quarter of a document's sentences.

    Seeds are the documents with known subjects, of which some may be wrong; labels with other subjects are not used.
    Documents are embedded by the leading right singular vectors of their terms, weighted by inverse document frequency.
    Terms count as far as their documents' subjects depart from what the language explains; each subject has a centroid
    per language. Each sentence goes to the nearest centroid, if it holds a term that tells subjects apart. The documents
    so found are the next round's seeds, which changes the terms' trust and the centroids.
    NULL and empty texts and documents without sentences have no subject. Rows with a NULL id are left out. Without
    labels that fit, nothing is assigned. All counts, the embedding and the centroids are made over all documents.
    """
    spark, cut = documents.sparkSession, Cut(documents.sparkSession)
    if not subjects:
        return documents.select(F.col(id_col).cast("long").alias("id"), F.lit("").alias("subject")).limit(0)
    number = {s: k for k, s in enumerate(subjects)}
    index = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    given = labels.where(F.col(label_subject).isin(subjects)).groupBy(F.col(label_id).cast("long").alias("id")).agg(F.collect_set(index[F.col(label_subject)]).alias("subjects"))
    docs = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    worded = cut.table(docs.join(given, "id", "left").select("id", "lang", "text", "subjects").mapInPandas(_worded, "id long, lang string, words string, subjects array<int>"))
    counts = cut.table(worded.select("lang", "words").mapInPandas(_count_terms, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")))
    by_language = counts.where("term = ''").select("lang", "n")
    total = by_language.agg(F.sum("n")).first()[0] or 0
    large = {r["lang"]: r["n"] for r in by_language.where((F.col("lang") != "") & (F.col("n") >= LANGUAGE_SHARE * total)).collect()}
    languages = {c: i + 1 for i, c in enumerate(sorted(large))}
    width = len(languages) + 1
    in_language = np.array([total - sum(large.values()), *[large[c] for c in sorted(large)]], float)
    least = max(LEAST_DOCS, TERM_SHARE * total)
    frequent = counts.where("term <> ''").groupBy("term").agg(F.sum("n").alias("df")).where(F.col("df") >= least).select("term")
    pooled = F.when(F.col("lang").isin(list(languages)), F.col("lang")).otherwise("").alias("lang") if languages else F.lit("").alias("lang")
    rows = counts.join(frequent, "term").groupBy("term", pooled).agg(F.sum("n").alias("n")).toPandas().sort_values(["term", "lang"], ignore_index=True)
    vocabulary = {t: i for i, t in enumerate(rows["term"].drop_duplicates())}
    size = len(vocabulary)
    if not size:
        return worded.select("id", F.lit("").alias("subject")).limit(0)
    held_term, held_lang, held_n = rows["term"].map(vocabulary).to_numpy(), rows["lang"].map(lambda c: languages.get(c, 0)).to_numpy(), rows["n"].to_numpy(float)
    idf = np.log(max(total, 1) / np.bincount(held_term, held_n, minlength=size)).astype(np.float32)
    coder = spark.sparkContext.broadcast((vocabulary, languages))
    encoded = cut.table(worded.mapInPandas(_encoder(coder), "id long, lang int, ids binary, terms binary, subjects array<int>"))
    cut.drop(counts)
    cut.drop(worded)
    basis = _embedding(encoded, idf)
    model = None
    for round_ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        seeds = encoded.where("subjects IS NOT NULL") if model is None else encoded
        told = seeds.select("ids", "terms", "lang", "subjects").mapInPandas(_evidence(shared, len(subjects)), "term int, subject int, lang int, n long").groupBy("term", "subject", "lang").agg(F.sum("n").alias("n")).toPandas()
        shared.unpersist()
        t, s, lg, n = (told[c].to_numpy(int) for c in ("term", "subject", "lang", "n"))
        members, seen, expected = np.zeros((len(subjects), width)), np.zeros((size, len(subjects))), np.zeros((size, len(subjects)))
        members[s[t < 0], lg[t < 0]] = n[t < 0]
        t, s, lg, n = t[t >= 0], s[t >= 0], lg[t >= 0], n[t >= 0]
        np.add.at(seen, (t, s), n)
        for c in range(width):
            mine = held_lang == c
            expected[held_term[mine]] += (held_n[mine] / max(in_language[c], 1))[:, None] * members[None, :, c]
        trust = _term_trust(seen, expected, 1.0 if round_ == 0 else 3.0)
        if not trust.any():
            return encoded.select("id", F.lit("").alias("subject")).limit(0)
        vector = basis * (idf * trust)[:, None]
        sizes = np.linalg.norm(vector, axis=1)
        centroid, subject, least_cosine = [], [], []
        for k in range(len(subjects)):
            for c in range(width):
                mine = (s == k) & (lg == c)
                mean = n[mine].astype(np.float32) @ vector[t[mine]]
                length = np.linalg.norm(mean)
                if length > 0:
                    centroid.append(mean / length)
                    subject.append(k)
                    least_cosine.append(COSINE * length / (n[mine] @ sizes[t[mine]]))
        model = {"trust": trust, "vector": vector, "least": np.array(least_cosine, np.float32), "centroid": np.array(centroid, np.float32), "subject": np.array(subject, np.int64)}
    last = spark.sparkContext.broadcast(model)

    def assign(batches):
        for pdf in batches:
            for at, part in _chunks(pdf["ids"]):
                doc, k = np.nonzero(_members(part, last.value, len(subjects)))
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[at + doc], "subject": np.array(subjects, object)[k]})

    return encoded.select("id", "ids").mapInPandas(assign, "id long, subject string").distinct()


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    names = [r[0] for r in table(spark, folder, "subjects").select("subject").where("subject IS NOT NULL").distinct().sort("subject").collect()]
    return subject_areas(table(spark, folder, "documents"), "doc_id", "text", "lang", table(spark, folder, "labels"), "doc_id", "subject", names).withColumnRenamed("id", "doc_id")


QUERIES = {"p10_found": p10_found}
