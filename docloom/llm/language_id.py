"""Language identification with string kernels.

The kernel of two texts is the mean, over n from 1 to 4, of the cosine of their sets of byte n-grams
(lower-cased letters; everything else is a blank): a blended spectrum of presences. N-grams fall into
hashed bins. Presences say little once most n-grams occur, so a text is taken in pieces of one size, and its
score is the mean over all its pieces. A bounded sample of pieces of labelled documents is fitted on the driver:
landmarks among them give the Nystroem features, and kernel ridge regression, one language against the rest,
the weights. With presences, a kernel value is a product of feature vectors, so landmarks and weights fold into
one matrix; all pieces of whole texts are then scored by products of batches with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import hash32, ship_package
from docloom.llm.textbuffer import strings

#: Bins of the n-grams of length 1, 2, 3 and 4, several times what a piece can fill. Bytes of a piece.
BINS = (256, 2048, 8192, 16384)
PIECE = 4096
#: The bound of the training sample, and of the landmarks, for each language.
SAMPLE_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE = 300, 64
RIDGE, SHARPNESS = 1e-2, 4.0
UNDETERMINED = "und"

_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[np.arange(97, 123)] = np.arange(97, 123)
_FOLD[np.arange(65, 91)] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_OFFSETS = np.concatenate([[0], np.cumsum(BINS)])
_LETTER = regex.compile(r"\p{L}")


def presences(texts: list[np.ndarray]) -> np.ndarray:
    """A row for each text (its bytes): which n-grams occur, each block scaled to length 1."""
    seen = np.zeros((len(texts), _OFFSETS[-1]), dtype=np.float32)
    for row, raw in zip(seen, texts, strict=True):
        b = _FOLD[raw]
        code = b
        row[code] = 1
        for n in range(2, len(BINS) + 1):
            if len(b) < n:
                break
            code = code[:-1] * np.uint32(256) + b[n - 1 :] if n < 4 else (code[:-1] << np.uint32(8)) | b[n - 1 :]
            bins = (code * np.uint32(2654435761)) >> np.uint32(32 - BINS[n - 1].bit_length() + 1)
            row[_OFFSETS[n - 1] + bins] = 1
    for n in range(len(BINS)):
        block = seen[:, _OFFSETS[n] : _OFFSETS[n + 1]]
        block /= np.sqrt(np.maximum(block.sum(axis=1, keepdims=True), 1)) * np.float32(np.sqrt(len(BINS)))
    return seen


class KernelModel:
    """Languages and the folded matrix that scores presences."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> KernelModel:
        languages = sorted(set(labels))
        if not languages:
            return cls([], np.zeros((_OFFSETS[-1], 0), dtype=np.float32))
        x = presences([np.frombuffer(t.encode(), dtype=np.uint8) for t in texts])
        y = np.array([[1.0 if label == k else -1.0 for k in languages] for label in labels])
        chosen = [i for k in languages for i in [i for i, label in enumerate(labels) if label == k][:LANDMARKS_PER_LANGUAGE]]
        z = x[chosen]
        values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64) + 1e-6 * np.eye(len(z)))
        root = vectors / np.sqrt(np.maximum(values, 1e-9)) @ vectors.T
        phi = (x @ z.T) @ root
        counts = y.clip(0).sum(axis=0)
        weight = 1 / (y.clip(0) @ counts)  # each language counts the same
        weight *= len(y) / weight.sum()
        w = np.linalg.solve(phi.T @ (phi * weight[:, None]) + RIDGE * np.eye(len(z)), phi.T @ (y * weight[:, None]))
        return cls(languages, (z.T @ (root @ w)).astype(np.float32))

    def values(self, texts: list[np.ndarray], block: int = 64) -> np.ndarray:
        """Decision values of each whole text (its bytes, at least one) for each language: the mean over its pieces by length."""
        pieces = [(row, raw[at : at + PIECE]) for row, raw in enumerate(texts) for at in range(0, len(raw), PIECE)]
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(pieces), block):
            part = pieces[at : at + block]
            rows, share = [row for row, _ in part], np.array([len(raw) / len(texts[row]) for row, raw in part])
            np.add.at(out, rows, (presences([raw for _, raw in part]) @ self.weights) * share[:, None])
        return out

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language of each text, and its probability."""
        f = SHARPNESS * self.values(texts)
        p = np.exp(f - f.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def fit(labelled: DataFrame, *, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> KernelModel:
    """Fit on about ``per_language`` documents of each label, never more than twice that.

    The sample is what has the smallest hashes of the id; how small follows from the label's count. Of each
    of its documents one piece of at most PIECE characters is taken, at a place that the hash chooses, so that
    the sample is bounded in bytes too. Rows without a label or text do not take part.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = usable.select(F.col(lang_col).cast("string").alias("lang"), hash32(F.col(id_col), "lang/").alias("h"), _piece(F.col(text_col), hash32(F.col(id_col), "piece/")).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    limits = [F.when(F.col("lang") == k, F.lit(int(min(1.0, per_language / n) * (1 << 32)))) for k, n in counts.items()]
    if not limits:
        return KernelModel.fit([], [])
    sample = rows.where(F.col("h") < F.coalesce(*limits)).orderBy("h", "text").limit(2 * per_language * len(counts)).collect()
    return KernelModel.fit([r["text"] for r in sample], [r["lang"] for r in sample])


def _piece(text: Column, h: Column) -> Column:
    """The text itself, or PIECE characters of a longer one from a hashed place on."""
    return F.substring(text, (F.pmod(h, F.greatest(F.lit(1), F.length(text) - PIECE + 1)) + 1).cast("int"), F.lit(PIECE))


def predict(docs: DataFrame, model: KernelModel, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` (and the columns ``keep``) for each row, from its whole text alone.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if the model has
    learned no language. Empty tables, repeated rows and other columns need no care.
    """
    label = _labeller(model)

    def run(batches):
        for batch in batches:
            labels, scores = label(batch.column("text"))
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(labels, pa.string()), pa.array(scores)], names=[*names, "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), *(c for c in keep), F.col(text_col).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    ship_package(docs.sparkSession)
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")


def keep_determined(docs: DataFrame, model: KernelModel, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language the model can tell, with all their columns; ``und`` ones go.

    A model that has learned no language (a corpus without labels) rejects only texts that have none: those that are
    null or without a letter go, all others stay as they are. Where ``lang_col`` is a string column of ``docs``, its nulls become the predicted language.
    """
    label, at = _labeller(model), docs.columns.index(text_col)
    named = docs.columns.index(lang_col) if lang_col in docs.columns and docs.schema[lang_col].dataType.simpleString() == "string" else None

    def run(batches):
        for batch in batches:
            if not model.languages:
                texts, valid = strings(batch.column(at))
                yield batch.filter(pa.array([bool(v) and _has_letter(t) for t, v in zip(texts, valid, strict=True)], pa.bool_()))
                continue
            labels, _ = label(batch.column(at))
            if named is not None:
                batch = batch.set_column(named, batch.schema.field(named), pc.coalesce(batch.column(named), pa.array(labels, batch.schema.field(named).type)))
            yield batch.filter(pa.array([x != UNDETERMINED for x in labels], pa.bool_()))

    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def _labeller(model: KernelModel, block: int = 64):
    """A function from a string column to its languages and scores, 64 texts at a time."""
    languages, weights = model.languages, model.weights

    def label(column: pa.Array) -> tuple[list[str], np.ndarray]:
        own = KernelModel(languages, weights)
        texts, valid = strings(column)
        labels, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        for at in range(0, len(texts) if languages else 0, block):
            rows = [i for i in range(at, min(at + block, len(texts))) if valid[i] and _has_letter(texts[i])]
            if rows:
                best, p = own.score([texts[i] for i in rows])
                scores[rows] = p
                for i, k in zip(rows, best, strict=True):
                    labels[i] = languages[k]
        return labels, scores

    return label


def _has_letter(raw: np.ndarray) -> bool:
    if ((raw | 32) - 97 < 26).any():  # unsigned: anything below a wraps round
        return True
    return bool((raw >= 128).any() and _LETTER.search(raw.tobytes().decode("utf-8", "replace")))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1 (null: empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1
