"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over character n-grams (ridge regression on the
square roots of n-gram frequencies) predicts whether the text's language has that bit set. Decoding is loss-weighted: the
language whose codeword has the smallest sum of exponential losses, each bit weighted by how reliable its classifier was
for that language under leave-one-out, wins. ``score`` is the winner's share of the softmax of negative losses; a text
is ``ambiguous`` when the runner-up comes within ``MARGIN`` of the winner.

Training takes at most ``PER_LANGUAGE`` labelled documents a language and about ``SAMPLE`` in all, chosen by hash, but at
least one of every language that has a document with a letter, so that every labelled language has a codeword; the training
matrix grows with the languages only beyond ``SAMPLE`` of them. Features come from whole texts. Prediction sees the text only.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any labelled document all are
``und``; with one language every text with a letter has it, with score 1; repeated rows get equal results.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, rows_of, to_arrow

PER_LANGUAGE = 300
#: Documents in all (or the number of languages, if that is more): the training matrix takes 20 kB a document.
SAMPLE = 3000
TRIGRAMS, BIGRAMS = 4096, 1024
RIDGE = 0.05
MARGIN = 0.003
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
STEP = 1 << 20


def held_out(id_col: Column) -> Column:
    """Documents that no model may learn from."""
    return F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(3)) == 1


class NGrams:
    """Hashed character n-gram frequencies of letters; anything else is one boundary."""

    size = TRIGRAMS + BIGRAMS

    def __init__(self):
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)

    def __call__(self, text: str | None) -> np.ndarray | None:
        """The feature vector, or None for a text without a letter. Long texts are counted a block at a time."""
        total = np.zeros(self.size)
        any_letter = False
        for at in range(0, len(text or ""), STEP):
            block = text[at : at + STEP].lower()
            c = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), "<u4")
            ok = self.letter[np.minimum(c, 0xFFFF)]
            if (high := np.flatnonzero(c > 0xFFFF)).size:
                ok = ok.copy()
                ok[high] = [chr(x).isalpha() for x in c[high]]
            if not ok.any():
                continue
            any_letter = True
            c = np.where(ok, c, 32).astype(np.uint32)
            c = c[ok | np.concatenate([[True], ok[:-1]])]
            c = np.concatenate([[32], c, [32]]).astype(np.uint32)
            two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
            three = two[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
            two, three = two ^ (two >> np.uint32(15)), three ^ (three >> np.uint32(13))
            total[:TRIGRAMS] += np.bincount((three * np.uint32(0x165667B1)) >> np.uint32(20), minlength=TRIGRAMS)
            total[TRIGRAMS:] += np.bincount((two * np.uint32(0x2C1B3C6D)) >> np.uint32(22), minlength=BIGRAMS)
        if not any_letter:
            return None
        return np.sqrt(total / max(1.0, total.sum()))


def codewords(n: int) -> np.ndarray:
    """n codewords of +1/-1: all distinct dichotomies for up to 7 languages, else the best of several random codes."""
    if n <= 7:
        bits = range(1, 2 ** (n - 1)) if n > 1 else range(1)
        return np.array([[1 if lang == 0 else (-1 if b >> (lang - 1) & 1 else 1) for b in bits] for lang in range(n)])
    r, best, far = np.random.default_rng(11), None, -1
    tries = max(1, min(200, 2_000_000 // (n * n)))
    while tries > 0 or best is None:
        tries -= 1
        code = r.choice([-1, 1], (n, int(np.ceil(10 * np.log2(n)))))
        bits = code.astype(np.float32)
        apart = (code.shape[1] - bits @ bits.T) / 2
        if (d := apart[~np.eye(n, dtype=bool)].min()) > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, d
    return best


class Model:
    """Classifiers for the bits, and the decoder."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.langs = langs
        self.code = codewords(len(langs)) if langs else np.zeros((0, 0))
        if len(langs) < 2:
            return
        self.mean = x.mean(0)
        x -= self.mean
        target = self.code[y].astype(np.float32)
        weight = 1.0 / np.bincount(y, minlength=len(langs))[y]  # languages count alike
        weight /= weight.mean()
        root = np.sqrt(weight)[:, None].astype(np.float32)
        x *= root  # in place: the matrix is held once
        k = np.linalg.inv((x @ x.T).astype(np.float64) + RIDGE * np.eye(len(x)))
        dual = k @ (root * target)
        left_out = target - dual / np.diag(k)[:, None] / root  # leave-one-out predictions
        self.scale = 1.0 / max(1e-6, float(np.abs(left_out).mean()))
        self.weights = (x.T @ dual.astype(np.float32)).astype(np.float32)
        right = left_out * target > 0
        self.trust = np.array([right[y == i].mean(0) if (y == i).any() else np.full(target.shape[1], 0.5) for i in range(len(langs))])
        self.trust = (self.trust + 1e-3) / (self.trust + 1e-3).sum(1, keepdims=True)

    def __call__(self, features: np.ndarray | None) -> tuple[str, float, bool]:
        if features is None or not self.langs:
            return UNKNOWN, 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        margin = (features - self.mean) @ self.weights * self.scale
        loss = (self.trust * np.exp(-np.clip(self.code * margin, -20, 20))).sum(1)
        share = np.exp(-4 * (loss - loss.min()))
        share /= share.sum()
        first, second = np.argsort(loss, kind="stable")[:2]
        return self.langs[first], float(share[first]), bool(loss[second] - loss[first] < MARGIN * loss[first])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on labelled documents that aren't held out."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.coalesce(~held_out(F.col(id_col)), F.lit(False)))
    usable = usable.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    pick = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)).cast("double") / (1 << 30)
    first = F.min(F.when(F.col("text").rlike(r"\p{L}"), F.struct(pick.alias("pick"), F.col("id"))))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"), first.alias("first")).orderBy(F.desc("n"), "lang").collect()
    counts = [r for r in counts if r.first is not None]  # a row a language
    if not counts:
        return Model([], np.zeros((0, 0)), np.zeros(0, int))
    spark, per_language = docs.sparkSession, min(per_language, max(1, SAMPLE // len(counts)))
    share = spark.createDataFrame([(r.lang, min(1.0, 1.3 * per_language / r.n), r.first.id) for r in counts], "lang string, share double, first long")
    # the hash picks about 1.3 * per_language rows a language, and its first with a letter; the smallest hashes are taken
    chosen = usable.withColumn("pick", pick).join(F.broadcast(share), "lang").where("pick < share OR id = first").select("lang", "pick", "id", "text")

    def make():
        grams = NGrams()

        def each(row):
            lang, pick, doc, text = row
            if (v := grams(text)) is not None:
                yield lang, pick, doc, v.astype(np.float32).tobytes()

        return each

    rows = map_rows(chosen, make, "lang string, pick double, id long, v binary")
    arrow = to_arrow(spark, "model binary")

    def fit(it):
        """One task fits the model: about 1.3 * ``SAMPLE`` rows, and one a language. A worker has one thread for linear algebra."""
        import pyarrow as pa

        by: dict[str, list] = {}
        for lang, pick, doc, v in sorted(r for batch in it for r in rows_of(batch)):
            if len(own := by.setdefault(lang, [])) < per_language:
                own.append(np.frombuffer(v, np.float32))
        langs = sorted(by)
        x = np.array([v for k in langs for v in by[k]], np.float32)
        made = Model(langs, x, np.array([i for i, k in enumerate(langs) for _ in by[k]], int))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], schema=arrow)

    return pickle.loads(bytes(rows.repartition(1).mapInArrow(fit, "model binary").first().model))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every document."""
    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(held_out(F.col(id_col)), F.lit(False)), F.col(text_col))

    def make():
        grams = NGrams()

        def each(row):
            doc, held, text = row
            yield doc, held, *model(grams(text))

        return each

    return map_rows(rows, make, SCHEMA)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, whose language is known and unambiguous. One map: rows keep their place."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(it):
        import pyarrow as pa

        grams = NGrams()
        for batch in it:
            keep = [not model(grams(text.as_py()))[2] for text in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, **options) -> DataFrame:
    return predict(docs, train(docs, **options))
