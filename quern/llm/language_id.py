"""Language identification by error-correcting output codes.

Every language has a codeword of bits; one binary classifier over byte n-grams predicts each bit from the
whole text. A classifier is a table of weights for hashed n-grams (log-odds of smoothed counts in the
languages on either side of the bit); its margin, the mean weight of a text's n-grams, is calibrated by a
logistic fit. Decoding is loss-weighted: each bit votes with its reliability, the language
with the least loss wins, and where the runner-up is about as near the text is flagged ambiguous.

Fitting uses at most `per_lang` labelled rows of each language (those with the smallest hash of doc_id) and the
`max_langs` labels with the most rows, two documented bounds; predictions read every row and whole texts.

Defined results: null text and text without a letter (general category L; digits and number signs of
any script aren't letters) give `und`, score 0; with nothing to learn
from every row is `und`; rows with null or repeated ids are predicted like others; a null doc_id is in
neither fold's training (held_out false); extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from quern.llm._io import release

GRAMS = 1 << 15
LETTER = regex.compile(r"\p{L}")
AMBIGUOUS = 0.05


def gram_ids(text: str) -> np.ndarray:
    """Hashed 2- to 4-grams of the lower-cased UTF-8 bytes, blanks and digits folded."""
    b = np.frombuffer(" ".join(f" {text.lower()} ".split(" ")).encode("utf-8", "surrogatepass"), np.uint8)
    out, h = [], b.astype(np.uint32)
    for n in (1, 2, 3):
        if len(b) <= n:
            break
        h = h[:-1] * np.uint32(0x01000193) ^ (b[n:].astype(np.uint32) * np.uint32(0x9E3779B1))
        out.append(((h ^ (h >> np.uint32(13))) * np.uint32(0x85EBCA6B)) >> np.uint32(17))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n x bits of -1 and 1: all distinct splits for few languages, else the best-separated random code."""
    if n <= 6:
        rows = [[1 if (c >> i) & 1 else -1 for i in range(n)] for c in range(1, 2 ** (n - 1))] or [[1] * n]
        return np.array(rows).T
    rng, best = np.random.default_rng(seed), None
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        c = rng.choice([-1, 1], (n, bits))
        c = c[:, np.abs(c.sum(0)) < n]
        apart = ((c[:, None] != c[None]).sum(2) + np.eye(n, dtype=int) * bits).min()
        if best is None or apart > best[0]:
            best = apart, c
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # n-grams x bits, calibrated
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit

    def margins(self, text: str) -> np.ndarray | None:
        ids = gram_ids(text)
        if not len(ids):
            return None
        out = np.zeros(self.weights.shape[1])
        for s in range(0, len(ids), 1 << 16):
            out += self.weights[ids[s : s + (1 << 16)]].sum(0, dtype=np.float64)
        return out / len(ids) + self.bias

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        loss = (self.trust * np.logaddexp(0, -self.code * margins)).sum(1)
        order = np.argsort(loss, kind="stable")
        p = np.exp(loss[order[0]] - loss)
        score = float(1 / p.sum())
        apart = (loss[order[1]] - loss[order[0]]) / self.trust.sum() if len(loss) > 1 else np.inf
        return self.langs[order[0]], score, bool(apart < AMBIGUOUS)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not text or not LETTER.search(text):
            return "und", 0.0, True
        m = self.margins(text)
        return self.decode(m) if m is not None else ("und", 0.0, True)


def fit(counts: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Model:
    """counts: for each language the (n-grams, counts) of its rows, kept sparse as the driver holds them all."""
    langs = sorted(counts)
    if not langs:
        return Model([], np.empty((0, 0)), np.empty((GRAMS, 0), np.float32), np.empty(0), np.empty(0))
    code = codewords(len(langs))
    rows = [(i, at, n / n.sum()) for i, x in enumerate(langs) for at, n in counts[x]]
    share = np.zeros((len(langs), GRAMS))
    for i, at, part in rows:
        share[i, at] += part / len(counts[langs[i]])  # languages count alike
    weights = np.empty((GRAMS, code.shape[1]))
    for bit in range(code.shape[1]):
        yes, no = (share[code[:, bit] == v].mean(0) if (code[:, bit] == v).any() else np.full(GRAMS, 1 / GRAMS) for v in (1, -1))
        weights[:, bit] = np.log((yes + 0.02 / GRAMS) / (no + 0.02 / GRAMS))
    x = np.array([part @ weights[at] for _, at, part in rows])
    y = code[[i for i, _, _ in rows]]
    w = np.array([1 / len(counts[langs[i]]) for i, _, _ in rows])
    w /= w.sum()
    scale, bias = np.empty(code.shape[1]), np.empty(code.shape[1])
    for bit in range(code.shape[1]):  # logistic calibration by Newton steps, with a small ridge
        a, b = 1 / max(x[:, bit].std(), 1e-6), 0.0
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a * x[:, bit] + b, -30, 30)))
            e, h = w * (p - (y[:, bit] > 0)), w * p * (1 - p)
            g = np.array([(e * x[:, bit]).sum() + 1e-3 * a, e.sum() + 1e-3 * b])
            hess = np.array([[(h * x[:, bit] ** 2).sum() + 1e-3, (h * x[:, bit]).sum()], [(h * x[:, bit]).sum(), h.sum() + 1e-3]])
            step = np.linalg.solve(hess, g)
            a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        scale[bit], bias[bit] = a, b
    right = (w[:, None] * (np.sign(x * scale + bias) == y)).sum(0)
    err = np.clip(1 - right, 0.01, 0.49)
    trust = 0.5 * np.log((1 - err) / err)
    return Model(langs, code, (weights * scale).astype(np.float32), bias, trust * len(trust) / trust.sum())


def training_rows(docs: DataFrame, per_lang: int, max_langs: int) -> DataFrame:
    """doc_id, lang, text of the rows to learn from.

    Rows over a hash threshold, set for each label so that four times per_lang are expected under it, are left out by the scan;
    the window sees the others only, so a label with a third of all rows costs no more than a small one.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    seen = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != 1)).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    langs = seen.groupBy("lang").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "lang").limit(max_langs)
    near = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 40)).cast("double") < F.lit(float(1 << 42) * per_lang) / F.col("c")
    ids = seen.select("doc_id", "lang").join(F.broadcast(langs), "lang").where(near)  # max_langs rows are broadcast
    pick = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 40)), "doc_id")
    ids = ids.withColumn("n", F.row_number().over(pick)).where(F.col("n") <= per_lang).select("doc_id", "lang").distinct()
    return seen.join(F.broadcast(ids), ["doc_id", "lang"])  # per_lang rows of each of max_langs labels at most


def train(docs: DataFrame, *, per_lang: int = 400, max_langs: int = 256) -> Model:
    """Only text and lang of rows whose crc32(doc_id) mod 3 isn't 1 are learned from."""

    def count(batches):
        release()
        for x in batches:
            for s in range(0, x.num_rows, 200):
                part = x.slice(s, 200)
                got = [np.bincount(gram_ids(t), minlength=GRAMS) for t in part.column("text").to_pylist()]
                nz = [np.flatnonzero(g) for g in got]
                yield pa.record_batch([part.column("lang"), pa.array([i.astype("<i4").tobytes() for i in nz]), pa.array([g[i].astype("<i4").tobytes() for g, i in zip(got, nz, strict=True)])], ["lang", "at", "n"])

    counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in training_rows(docs, per_lang, max_langs).mapInArrow(count, "lang string, at binary, n binary").toLocalIterator():
        if len(counts.setdefault(r["lang"], [])) < per_lang and len(r["at"]):
            counts[r["lang"]].append((np.frombuffer(bytes(r["at"]), "<i4"), np.frombuffer(bytes(r["n"]), "<i4")))
    return fit({k: v for k, v in counts.items() if v})


def predict(docs: DataFrame, model: Model, added: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """docs with the language, its score and the ambiguity flag added (columns of these names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # GRAMS x bits floats, whatever the data
    names = [c for c in docs.columns if c not in added]
    schema = docs.select(*names).schema.add(added[0], "string").add(added[1], "double").add(added[2], "boolean")

    def run(batches):
        release()  # what an idle worker still holds of earlier work would come on top
        m = shared.value
        for x in batches:
            for s in range(0, x.num_rows, 500):
                part = x.slice(s, 500)
                got = [m.predict(t) for t in part.column("text").to_pylist()]
                yield pa.record_batch([*part.columns, pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got])], [*part.schema.names, *added])
        release()

    return docs.select(*names).mapInArrow(run, schema)


def identify(docs: DataFrame, *, per_lang: int = 400) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous."""
    slim = docs.select(F.col("doc_id"), "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    return predict(slim, train(docs, per_lang=per_lang)).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, *, per_lang: int = 400, least_score: float = 0.0) -> DataFrame:
    """The rows of docs whose language is told: not `und`, and not under least_score."""
    found = predict(docs, train(docs, per_lang=per_lang), ("__lang", "__score", "__ambiguous"))
    return found.where((F.col("__lang") != "und") & (F.col("__score") >= least_score)).select(*docs.columns)
