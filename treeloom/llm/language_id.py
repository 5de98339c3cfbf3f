"""Language ID by hierarchical discrimination.

Linear support vector machines over hashed character trigrams of the whole text: first
one-versus-one among language families, then one-versus-one among the languages of the
family that won. Each machine is fitted by its own task on a sample of at most about
``sample`` labelled documents a language, chosen by a hash of doc_id.

Cases: a null text, or one without any letter, is ``und`` with score 0; so is every text if
nothing was learned; languages that no family lists are a family of their own; ties between machines go to
the larger sum of margins, then to the first name; rows with a null lang teach nothing; a
null doc_id counts as not held out; texts of any length are read whole, in pieces.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import bounded_batches

DIM, SAMPLE, PIECE = 4096, 600, 1 << 20

# Languages (ISO 639-1) by family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "semitic": ("ar", "he", "mt"),
    "celtic": ("br", "cy", "ga", "gd"),
    "baltic": ("lt", "lv"),
    "austronesian": ("id", "jv", "ms", "tl"),
    "dravidian": ("kn", "ml", "ta", "te"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTER = re.compile(r"[^\W\d_]")
_SPACE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, f"only:{lang}")


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def features(text: str, dim: int = DIM) -> np.ndarray:
    """Square roots of hashed trigram counts of the lower-cased letters and spaces, of length 1."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACE).split()) + b" "
    total = np.zeros(dim, np.int64)
    for at in range(0, max(1, len(data) - 2), PIECE):
        a = np.frombuffer(data, np.uint8, min(PIECE + 2, len(data) - at), at).astype(np.uint32)
        code = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
        total += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=dim)[:dim] if dim == 4096 else np.bincount((code * np.uint32(2654435761)) % np.uint32(dim), minlength=dim)
    x = np.sqrt(total.astype(np.float32))
    return x / max(float(np.linalg.norm(x)), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights and bias of a squared-hinge linear SVM by accelerated gradient; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    step, t = 1.0 / (reg + 4.0), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (reg * v - 2 * x.T @ (share * y * slack))
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w, v, t = new, new + (t - 1) / u * (new - w), u
    return w


class Model:
    """Machines of all levels; (side a, side b) -> weights, a's side positive."""

    def __init__(self, langs: list[str], machines: dict[tuple[str, str], np.ndarray]):
        self.langs = sorted(langs)
        self.families: dict[str, list[str]] = {}
        for x in self.langs:
            self.families.setdefault(family_of(x), []).append(x)
        self.at = {pair: i for i, pair in enumerate(machines)}
        self.weights = np.stack(list(machines.values()), 1) if machines else np.zeros((DIM + 1, 0), np.float32)

    def _best(self, names: list[str], margins: np.ndarray, mark: str) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        votes = {n: [0, 0.0, np.inf] for n in names}
        for a, b in combinations(names, 2):
            m = float(margins[self.at[mark + a, mark + b]])
            for n, own in ((a, m), (b, -m)):
                votes[n][0] += own > 0
                votes[n][1] += own
                votes[n][2] = min(votes[n][2], own)
        won = max(names, key=lambda n: (votes[n][0], votes[n][1]))
        return won, float(1 / (1 + np.exp(-4 * np.clip(votes[won][2], -10, 10))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        margins = features(text) @ self.weights[:-1] + self.weights[-1]
        family, a = self._best(sorted(self.families), margins, "family:")
        lang, b = self._best(self.families[family], margins, "lang:")
        return lang, round(a * b, 6)


def _sample_rows(langs: list[str]):
    families = sorted({family_of(x) for x in langs})

    def run(batches):
        for batch in batches:
            keys, ids, sides, xs = [], [], [], []
            for i, text, lang in zip(batch["tie"].to_pylist(), batch["text"], batch["lang"].to_pylist()):
                text = text.as_py()
                if not has_letter(text):
                    continue
                x = features(text).tobytes()
                mine = family_of(lang)
                pairs = [("family:", a, b, mine) for a, b in combinations(families, 2) if mine in (a, b)]
                pairs += [("lang:", a, b, lang) for a, b in combinations([k for k in langs if family_of(k) == mine], 2) if lang in (a, b)]
                for mark, a, b, own in pairs:
                    keys.append(f"{mark}{a}\t{mark}{b}")
                    ids.append(i)
                    sides.append(1 if own == a else -1)
                    xs.append(x)
            if keys:
                yield pa.RecordBatch.from_pydict({"machine": keys, "tie": pa.array(ids, pa.int64()), "side": pa.array(sides, pa.int32()), "x": pa.array(xs, pa.binary())})

    return run


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["tie", "side"], kind="stable")
    x = np.stack([np.frombuffer(b, np.float32) for b in pdf["x"]])
    return pd.DataFrame({"machine": [pdf["machine"].iloc[0]], "w": [fit_svm(x, pdf["side"].to_numpy(np.float32)).tobytes()]})


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from (doc_id, text, lang). Of languages with more than ``sample`` documents about so many are read.

    The bound holds for what is fitted on, and so for what the driver gets: the weights.
    """
    bounded_batches(labelled.sparkSession)
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row for each language
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return Model([], {})
    share = F.create_map(*(F.lit(v) for r in counts for v in (r["lang"], min(1.0, sample / r["n"]))))
    # texts of one doc_id or of none differ by their own hash
    tie = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    rows = labelled.withColumn("tie", tie).where((F.pmod("tie", F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")])
    fitted = rows.select("tie", "text", "lang").mapInArrow(_sample_rows(langs), "machine string, tie long, side int, x binary").groupBy("machine").applyInPandas(_fit, "machine string, w binary").collect()
    machines = {tuple(r["machine"].split("\t")): np.frombuffer(r["w"], np.float32) for r in sorted(fitted, key=lambda r: r["machine"])}
    zero = np.zeros(DIM + 1, np.float32)
    for names, mark in ((sorted({family_of(x) for x in langs}), "family:"), *(([x for x in langs if family_of(x) == f], "lang:") for f in {family_of(x) for x in langs})):
        for a, b in combinations(names, 2):
            machines.setdefault((mark + a, mark + b), zero)
    return Model(langs, machines)


def _predict(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            out = [model.predict(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["row", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred and score; columns of these names are replaced."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(_predict(shared), rows.select("row").schema.add("lang_pred", "string").add("score", "double"))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in keep), "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
