"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's vector is the mean of the embeddings of its hashed byte n-grams
(lower-cased letters, everything else a space); a linear layer and a softmax give
the languages. Embeddings and layer are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled rows: about ``PER_LANGUAGE``
documents of each language, chosen by a hash of their id, each with its whole text
and some short fragments. Every fifth sampled document is kept from the training
and serves to calibrate: a temperature for the probabilities, and the score above
which a prediction is accepted (``ACCURACY`` of the accepted ones right).

Both layers are linear before the softmax, so a worker needs only each n-gram's
contribution to each language, and adds these up over whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and
not accepted; a null doc_id is neither held out nor learned from; without
labelled rows every prediction is ``und``; ties go to the language that sorts
first; repeated rows get equal predictions; an empty table gives an empty result;
columns other than the id, the text and (for learning) the language are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from neardup.llm.bytewords import mix
from neardup.llm.common import by_bytes
from neardup.session import ship_by_value

ship_by_value(__name__)

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
DIMENSIONS = 16
EPOCHS, RATE = 12, 2.0
#: Bounds of the sample: documents of a language (about), fragments of a document, words of one.
PER_LANGUAGE, FRAGMENTS, FRAGMENT_WORDS = 400, 3, 12
ACCURACY = 0.99
BATCH_BYTES = 1 << 19
UNDETERMINED = "und"
NTH = "_neardup_nth"
LETTER = re.compile(r"[^\W\d_]")   # also numbers such as a half, which are no letters


class Model(NamedTuple):
    languages: list[str]
    table: object        # BUCKETS x languages: what each n-gram adds
    bias: object
    temperature: float
    accept: float


def grams(data: bytes):
    """Buckets of all n-grams of ``data``, lower-case UTF-8."""
    import numpy as np
    octets = np.frombuffer(data, dtype=np.uint8)
    letter = ((octets >= 97) & (octets <= 122)) | (octets >= 128)
    codes = np.where(letter, octets, 32).astype(np.uint64)
    out = []
    for n in GRAMS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = (h << np.uint64(8)) | codes[k:len(codes) - n + 1 + k]
            out.append((mix(h) & np.uint64(BUCKETS - 1)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int32)


def padded(text: str) -> bytes:
    return (" " + text.lower() + " ").encode("utf-8", "replace")


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode's letter categories."""
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def examples(docs: DataFrame, id_col: str, text: str, lang: str) -> list[tuple[str, bool, object, object]]:
    """(language, for calibration, buckets, weights) of the sampled texts and fragments.

    A bounded number of rows of each language reaches the driver, each of at most BUCKETS numbers.
    """
    import numpy as np
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    sizes = known.groupBy(lang).count().orderBy(F.desc("count"), lang).collect()
    if not sizes:
        return []
    unit = 1 << 40
    place = F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(unit))
    shares: dict[int, list] = {}
    for r in sizes:
        shares.setdefault(int(unit * min(1.0, PER_LANGUAGE / r["count"])), []).append(r[lang])
    chosen = F.lit(False)
    for share, languages in shares.items():
        chosen = chosen | (F.col(lang).isin(languages) & (place < share))
    # ids that repeat can choose more rows than the share; each language has its own bound
    nth = F.row_number().over(Window.partitionBy(lang).orderBy(place, F.xxhash64(text), id_col))
    rows = (known.where(chosen).withColumn(NTH, nth).where(F.col(NTH) <= 2 * PER_LANGUAGE)
            .select(F.col(lang).alias("_lang"), (F.pmod(F.xxhash64(F.lit(8), F.col(id_col)), F.lit(5)) == 0).alias("_calibrate"),
                    F.xxhash64(F.lit(9), F.col(id_col)).alias("_seed"), F.col(text).alias("_text")))

    def counted(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch, first, end in by_bytes(batches, "_text", BATCH_BYTES):
            part = batch.slice(first, end - first)
            took, found, weights = [], [], []
            for i, (t, seed) in enumerate(zip(part.column("_text").to_pylist(), part.column("_seed").to_pylist())):
                words = t.split()
                rng = np.random.default_rng(seed & 0xFFFFFFFF)
                parts = [t]
                if len(words) > 2 * FRAGMENT_WORDS:
                    parts += [" ".join(words[p:p + FRAGMENT_WORDS])
                              for p in rng.integers(0, len(words) - FRAGMENT_WORDS, FRAGMENTS)]
                for x in parts:
                    if has_letter(x):
                        bucket, n = np.unique(grams(padded(x)), return_counts=True)
                        took.append(i)
                        found.append(bucket.astype("<i4").tobytes())
                        weights.append((n / n.sum()).astype("<f4").tobytes())
            if took:
                own = part.take(pa.array(took, pa.int64()))
                yield pa.RecordBatch.from_arrays([own.column("_lang"), own.column("_calibrate"), pa.array(found, pa.binary()),
                                                  pa.array(weights, pa.binary())], names=["lang", "calibrate", "bucket", "weight"])

    got = rows.mapInArrow(counted, "lang string, calibrate boolean, bucket binary, weight binary").collect()
    out = [(r["lang"], r["calibrate"], np.frombuffer(r["bucket"], "<i4"), np.frombuffer(r["weight"], "<f4")) for r in got]
    return sorted(out, key=lambda x: (x[0], x[1], len(x[2]), x[2].tobytes(), x[3].tobytes()))


def train(found: list, seed: int = 5) -> Model | None:
    """The model of ``examples``; None without any."""
    import numpy as np
    if not found:
        return None
    languages = sorted({x[0] for x in found})
    number = {x: i for i, x in enumerate(languages)}
    learn = [x for x in found if not x[1]] or found
    check = [x for x in found if x[1]] or found
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((DIMENSIONS, len(languages)), dtype=np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    steps, step = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(learn)):
            lang, _, bucket, weight = learn[i]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            vector = weight @ embed[bucket]
            score = vector @ layer + bias
            wrong = np.exp(score - score.max())
            wrong /= wrong.sum()
            wrong[number[lang]] -= 1
            embed[bucket] -= rate * weight[:, None] * (layer @ wrong)[None, :]
            layer -= rate * np.outer(vector, wrong)
            bias -= np.float32(0.1) * rate * wrong
    table = embed @ layer
    scores = np.stack([weight @ table[bucket] + bias for _, _, bucket, weight in check]).astype(np.float64)
    truth = np.array([number[x[0]] for x in check])

    def probability(t: float):
        p = np.exp((scores - scores.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    rows = np.arange(len(truth))
    temperature = float(min(np.geomspace(0.1, 10, 41), key=lambda t: -np.log(probability(t)[rows, truth] + 1e-12).sum()))
    p = probability(temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-best, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) / (rows + 1) >= ACCURACY)
    accept = float(best[order][good[-1]]) if len(good) else 1.0
    return Model(languages, table, bias, temperature, accept)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred, score (calibrated probability) and accepted of each whole text."""
    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), F.col(text).alias("_text"))
    # BUCKETS numbers for each language; a plain tuple, since workers need not have this package
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else tuple(model))

    def scored(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        m = shared.value
        languages, table, bias, temperature, accept = m or (None,) * 5
        for batch, first, end in by_bytes(batches, "_text", BATCH_BYTES):
            part = batch.slice(first, end - first)
            langs, scores, accepted = [], [], []
            for t in part.column("_text").to_pylist():
                if m is None or not t or not has_letter(t):
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    accepted.append(False)
                    continue
                data, total, n = padded(t), np.zeros(len(languages)), 0
                longest = max(GRAMS) - 1
                for at in range(0, len(data), BATCH_BYTES):   # n-grams across the cuts are added by themselves
                    bucket = grams(data[at:at + BATCH_BYTES])
                    total += np.bincount(bucket, minlength=BUCKETS) @ table
                    n += len(bucket)
                    if at + BATCH_BYTES < len(data):
                        cut = data[at + BATCH_BYTES - longest:at + BATCH_BYTES + longest]
                        edge = across(cut, longest)
                        total += table[edge].sum(axis=0)
                        n += len(edge)
                s = (total / n + bias) / temperature
                p = np.exp(s - s.max())
                p /= p.sum()
                langs.append(languages[int(p.argmax())])
                scores.append(float(p.max()))
                accepted.append(scores[-1] >= accept)
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("held_out"), pa.array(langs, pa.string()),
                                              pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())],
                                             names=["_id", "held_out", "lang_pred", "score", "accepted"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean"
                           ).withColumnRenamed("_id", id_col)


def across(cut: bytes, middle: int):
    """Buckets of the n-grams of ``cut`` that lie on both sides of place ``middle``."""
    import numpy as np
    out = []
    for n in GRAMS:
        for first in range(max(0, middle - n + 1), min(middle, len(cut) - n + 1)):
            out.append(one_gram(cut[first:first + n]))
    return np.array(out, dtype=np.int64)


def one_gram(data: bytes) -> int:
    """The bucket of the n-gram that is all of ``data``."""
    return int(grams(data)[-1])


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the documents that aren't held out, and predict all."""
    return predict(docs, train(examples(docs, id_col, text, lang)), id_col, text)
